"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinloom.llm.common import pick, place_of, positional, raw_texts, sized, written

ORDER = 5
#: Training rows a language: about as many rows as these are drawn; of a longer text a passage of so many
#: characters is.
SAMPLE_ROWS = 600
SAMPLE_CHARS = 100_000
#: Expected characters of the whole sample at most, shared alike by the languages.
SAMPLE_TOTAL = 32_000_000
#: One in so many of a language's drawn rows calibrates score and rejection and trains nothing.
CALIBRATE = 5
#: A text is rejected if its cross-entropy is above its language's mean by more than half-way from the
#: quantile OWN of what calibration texts are, to the quantile FOREIGN of what those of a language are
#: under the best of the other languages' models, as if theirs had not been learned. Of the languages
#: the one whose texts are least above counts.
OWN, FOREIGN = 0.995, 0.05
#: Characters that are scored at a time, languages that they are scored for at a time, and rows whose
#: texts are decoded at a time.
SLAB, ACROSS, ROWS = 1 << 19, 32, 256
MIX = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Each code point's lower-case letter, or a space for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normal(text: str) -> np.ndarray:
    """Lower-case letters with one space for what stands between them, and one at either end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kept = np.empty(len(points) + 2, np.uint32)
    kept[0] = kept[-1] = 32
    kept[1:-1] = _letters()[points]
    space = kept == 32
    keep = np.ones(len(kept), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return kept[keep]


def gram_hashes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """out[n - 1][i]: the hash of the n characters that end at i. Hashes that would begin before the
    array wrap around and are not to be used."""
    return list(_orders(points, order))


def _orders(points: np.ndarray, order: int) -> Iterator[np.ndarray]:
    wide = points.astype(np.uint64) + np.uint64(1)
    hashes, power = wide * MIX, MIX
    yield hashes
    for n in range(2, order + 1):
        power = np.uint64(int(power) * int(MIX) * 2 % 2**64 | 1)
        hashes = hashes + np.roll(wide, n - 1) * power
        yield hashes


def _three(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of n - 1, n and n + 1 characters; for n = 1 the first is no use."""
    last = [x for k, x in enumerate(_orders(points, n + 1), 1) if k >= n - 1]
    return tuple(last) if n > 1 else (last[0], *last)


@dataclass
class Model:
    """hashes[n - 1]: sorted hashes of the n-grams that any language has. The languages that have n-gram
    i, by number and in order, are lang[n - 1][start[n - 1][i] : start[n - 1][i + 1]]; logp has their
    interpolated log probabilities, and back, for contexts, their log weights of the lower order. So a
    language costs what its own n-grams take, however many others there are. index: see _index().
    floor: the log probability of an unseen character."""

    languages: list[str]
    hashes: list[np.ndarray]
    index: list[tuple[np.ndarray, np.uint64]]
    start: list[np.ndarray]
    lang: list[np.ndarray]
    logp: list[np.ndarray]
    back: list[np.ndarray]
    floor: np.ndarray
    means: np.ndarray
    bound: float = np.inf
    sharp: float = 1.0


def no_model() -> Model:
    return Model([], [], [], [], [], [], [], np.zeros(0, np.float32), np.zeros(0))


def _language(points: np.ndarray, order: int, alphabet: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By order: a language's n-grams as sorted hashes, their log probabilities, and the log weight that
    each leaves to the lower order when it is a context. Interpolated Kneser-Ney: the highest order
    counts occurrences, lower ones distinct left neighbours; one discount n1 / (n1 + 2 n2) an order."""
    out: list[list[np.ndarray]] = []
    for n in range(1, order + 1):
        low, grams, high = _three(points, n)
        ends = np.arange(order - 1, len(points))  # whose n-grams have their full context
        if n < order:  # continuation counts: distinct (n + 1)-grams by their last n characters
            _, one = np.unique(high[order - 1 :], return_index=True)
            ends = ends[one]
        own, first, count = np.unique(grams[ends], return_index=True, return_counts=True)
        ends = ends[first]
        ones, twos = np.count_nonzero(count == 1), np.count_nonzero(count == 2)
        cut = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.05
        context = np.searchsorted(out[-1][0], low[ends - 1]) if n > 1 else np.zeros(len(own), np.int64)
        many = len(out[-1][0]) if n > 1 else 1
        total, kinds = np.bincount(context, count, minlength=many), np.bincount(context, minlength=many)
        seen = total > 0
        left = np.ones(many)
        left[seen] = cut * kinds[seen] / total[seen]
        p = (count - cut) / total[context]
        if n == 1:
            p += left[0] / alphabet
            floor = left[0] / alphabet
        else:
            p += left[context] * lower[np.searchsorted(out[-1][0], low[ends])]
            out[-1][2] = np.log(left).astype(np.float32)
        out.append([own, np.log(p).astype(np.float32), np.zeros(len(own), np.float32)])
        lower = p
    return [*map(tuple, out), np.log(floor)]


def train(texts: dict[str, list[str]], order: int = ORDER) -> Model:
    """A model of each language, and all of them in one set of sorted arrays. One language's text is
    held as code points and hashes at a time."""
    languages = sorted(texts)
    pad = np.full(order - 1, 32, np.uint32)

    def stream(lang: str) -> np.ndarray:
        return np.concatenate([x for t in texts[lang] for x in (pad, normal(t))] or [pad])

    alphabet = len(np.unique(np.concatenate([np.unique(stream(lang)[order - 1 :]) for lang in languages]))) + 1
    models = [_language(stream(lang), order, alphabet) for lang in languages]
    out = Model(languages, [], [], [], [], [], [], np.array([m[order] for m in models], np.float32), np.zeros(len(languages)))
    for n in range(order):
        hashes, logp, back = (np.concatenate([m[n][k] for m in models]) for k in range(3))
        lang = np.repeat(np.arange(len(models), dtype=np.int32), [len(m[n][0]) for m in models])
        by = np.argsort(hashes, kind="stable")
        hashes = hashes[by]
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        out.hashes.append(hashes[first])
        out.index.append(_index(hashes[first]))
        out.start.append(np.r_[first, len(hashes)])
        out.lang.append(lang[by])
        out.logp.append(logp[by])
        out.back.append(back[by])
    return out


def _index(table: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """Where in a sorted array of hashes those with each value of their first bits begin, and how far
    to shift a hash for these; about one hash has each."""
    bits = max(1, len(table).bit_length())
    return np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), np.uint64(64 - bits)


def _place(table: np.ndarray, index: tuple[np.ndarray, np.uint64], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the sorted table has, and where."""
    first, shift = index
    at = first[keys >> shift]
    out = np.full(len(keys), -1)
    left = np.flatnonzero(at < len(table))
    while len(left):
        have, want = table[at[left]], keys[left]
        here = left[have == want]
        out[here] = at[here]
        left = left[have < want]
        at[left] += 1
        left = left[at[left] < len(table)]
    some = np.flatnonzero(out >= 0)
    return some, out[some]


def _different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different key, and for each key which of them it is."""
    by = np.argsort(keys)
    sorted_ = keys[by]
    new = np.r_[True, sorted_[1:] != sorted_[:-1]]
    which = np.empty(len(keys), np.int64)
    which[by] = np.cumsum(new) - 1
    return by[new], which


def _entries(model: Model, n: int, rows: np.ndarray, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows that are at n-grams `at`: (row, language - low, entry) of the languages low .. high - 1
    that have them."""
    first = model.start[n - 1][at]
    many = model.start[n - 1][at + 1] - first
    entry = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
    lang = model.lang[n - 1][entry]
    row = np.repeat(rows, many)
    if low or high < len(model.languages):
        own = (lang >= low) & (lang < high)
        entry, lang, row = entry[own], lang[own], row[own]
    return row, lang - low, entry


def _logs(model: Model, grams: list[np.ndarray], ends: np.ndarray, low: int = 0, high: int | None = None) -> np.ndarray:
    """Log probability, by language from low to high, of the characters at ends: that of the longest
    n-gram that the language has, with the weights that the longer ones' contexts leave."""
    high = len(model.languages) if high is None else high
    out = np.repeat(model.floor[None, low:high], len(ends), axis=0)
    known = np.arange(len(ends))  # whose shorter n-grams some language has
    after = known  # whose contexts some language has
    for n in range(1, len(model.hashes) + 1):
        if n > 1:
            some, at = _place(model.hashes[n - 2], model.index[n - 2], grams[n - 2][ends[after] - 1])
            after = after[some]
            row, lang, entry = _entries(model, n - 1, after, at, low, high)
            out[row, lang] += model.back[n - 2][entry]
        some, at = _place(model.hashes[n - 1], model.index[n - 1], grams[n - 1][ends[known]])
        known = known[some]
        row, lang, entry = _entries(model, n, known, at, low, high)
        out[row, lang] = model.logp[n - 1][entry]
    return out


def entropies(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's nats a character by language, and its number of characters after normalising; texts
    without letters have none. Texts are scored whole, in slabs of bounded size."""
    order = len(model.hashes)
    sums, lengths = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    pad = np.full(order - 1, 32, np.uint32)
    pieces: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        if not pieces:
            return
        points = np.concatenate([p for _, p in pieces])
        stops = np.cumsum([len(p) for _, p in pieces])
        scored = np.ones(len(points), bool)
        for stop, (_, p) in zip(stops, pieces, strict=True):
            scored[stop - len(p) : stop - len(p) + order - 1] = False
        ends = np.flatnonzero(scored)
        grams = gram_hashes(points, order)
        one, which = _different(grams[-1][ends])
        counts = np.array([len(p) - order + 1 for _, p in pieces])
        firsts, rows = np.cumsum(counts) - counts, [i for i, _ in pieces]
        for low in range(0, len(model.languages), ACROSS):
            high = min(low + ACROSS, len(model.languages))
            logs = _logs(model, grams, ends[one], low, high)
            np.add.at(sums[:, low:high], rows, -np.add.reduceat(logs[which], firsts, axis=0, dtype=np.float64))
        np.add.at(lengths, rows, counts)
        pieces.clear()

    for i, text in enumerate(texts):
        if not text:
            continue
        whole = normal(text)
        if len(whole) < 2:
            continue
        whole = np.concatenate([pad, whole])
        for at in range(0, len(whole) - order + 1, SLAB):
            part = whole[at : at + SLAB + order - 1]
            pieces.append((i, part))
            size += len(part)
            if size >= SLAB:
                flush()
                size = 0
    flush()
    return sums / np.maximum(lengths, 1)[:, None], lengths


def decide(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best language's number (-1: no letter), its calibrated probability, and whether the text is
    like that language's at all."""
    nats, n = entropies(model, texts)
    best = nats.argmin(axis=1)
    sure = _posterior(nats, n, model.sharp).max(axis=1)
    off = nats[np.arange(len(nats)), best] - model.means[best]
    none = n == 0
    return np.where(none, -1, best), np.where(none, 0.0, sure), ~none & (off <= model.bound)


def _posterior(nats: np.ndarray, n: np.ndarray, sharp: float) -> np.ndarray:
    score = -nats * (np.minimum(n, 1000) * sharp)[:, None]
    score -= score.max(axis=1, keepdims=True)
    score = np.exp(score)
    return score / score.sum(axis=1, keepdims=True)


def calibrate(model: Model, texts: list[str], langs: list[str]) -> Model:
    """Sets the sharpness that gives the rows' languages the highest likelihood, each language's mean
    cross-entropy, and how far above it a text may be: each language's rows are judged by the other
    languages' models too (of one language alone: text of unseen characters is). At least OWN of the
    rows stay within the bound, also where languages are too alike to tell."""
    nats, n = entropies(model, texts)
    fit = np.flatnonzero(n > 0)
    nats, n = nats[fit], n[fit]
    truth = np.array([model.languages.index(langs[i]) for i in fit], np.int64)
    if len(fit):
        grid = [2.0**k for k in np.arange(-7, 1.5, 0.5)]
        cost = [-np.log(np.maximum(1e-12, _posterior(nats, n, s)[np.arange(len(fit)), truth])).sum() for s in grid]
        model.sharp = grid[int(np.argmin(cost))]
        own = nats[np.arange(len(fit)), truth]
        overall = own.mean()
        for k in range(len(model.languages)):
            model.means[k] = own[truth == k].mean() if (truth == k).any() else overall
        high = float(np.quantile(own - model.means[truth], OWN))
        if len(model.languages) > 1:
            nats[np.arange(len(fit)), truth] = np.inf
            next_best = nats.argmin(axis=1)
            above = nats[np.arange(len(fit)), next_best] - model.means[next_best]
            low = min(float(np.quantile(above[truth == k], FOREIGN)) for k in np.unique(truth))
        else:
            low = -float(model.floor[0]) - overall
        model.bound = max(high, (high + low) / 2)
    return model


def learn(documents: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, total: int = SAMPLE_TOTAL, order: int = ORDER) -> Model:
    """The model from documents (doc_id, text, lang), of those with a text and a lang: about `rows`
    rows a language, drawn by a hash of doc_id and text, of a text above `chars` characters a drawn
    passage of that length, and about `total` characters in all. The driver holds that sample and the
    model of it, which is in proportion to it, whatever the number of languages. A language of which
    rows are drawn keeps one at least for training. No rows: a model without languages."""
    usable = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    length = F.least(F.length("text"), F.lit(chars))
    counts, _ = written(documents.sparkSession, usable.groupBy("lang").agg(F.count("*").alias("count"), F.sum(length).alias("chars")), "languages")
    languages = counts.count()
    if not languages:
        return no_model()
    whole = 1 << 30
    share = F.least(F.lit(float(whole)), F.ceil(F.lit(float(whole * rows)) / F.col("count")), F.ceil(F.lit(float(whole) * total / languages) / F.greatest(F.lit(1), "chars")))
    shares = counts.select("lang", share.alias("share"))
    by_text = F.xxhash64(F.lit(5), "doc_id", F.xxhash64("text"))
    begin = F.pmod(F.xxhash64(F.lit(6), by_text), F.greatest(F.lit(1), F.length("text") - chars + 1)) + 1
    passage = F.substring("text", begin.cast("int"), F.lit(chars))
    drawn = usable.withColumn("dealt", F.pmod(by_text, F.lit(whole))).join(sized(shares, languages), "lang").where("dealt < share")
    drawn = drawn.select("dealt", "doc_id", "lang", passage.alias("text")).collect()
    drawn.sort(key=lambda r: (r["lang"], r["dealt"], r["doc_id"] or 0, r["text"]))
    texts: dict[str, list[str]] = {}
    held: list[tuple[str, str]] = []
    for lang, own in itertools.groupby(drawn, key=lambda r: r["lang"]):
        own = [r["text"] for r in own if any(c.isalpha() for c in r["text"])]
        if own:
            texts[lang] = [t for k, t in enumerate(own) if k % CALIBRATE < CALIBRATE - 1]
            held += [(t, lang) for k, t in enumerate(own) if k % CALIBRATE == CALIBRATE - 1]
    if not texts:
        return no_model()
    return calibrate(train(texts, order), [t for t, _ in held], [lang for _, lang in held])


def learned_rows(documents: DataFrame) -> DataFrame:
    """Those of the documents that may be learned from: crc32 of the doc_id as text, mod 3, is not 1.
    Rows without a doc_id are never learned from."""
    docs = pick(documents, "doc_id", "text", "lang")
    return docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def predict(spark: SparkSession, documents: DataFrame, model: Model) -> DataFrame:
    """documents(doc_id, text) to doc_id, lang_pred, score double, accepted boolean, nats double.

    lang_pred is the language whose model has the lowest cross-entropy a character over the whole
    text, ties to the first by name; `und` if the text is null or has no letter, or no language was
    learned. score: the calibrated probability, 0 for und. accepted is false for und and for texts
    that are unlike their language. A row for each row; other columns are ignored."""
    docs = pick(documents, "doc_id", "text")
    shipped = spark.sparkContext.broadcast(model)  # in proportion to the sample it is made from

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            best, score, fits = judged(own, batch.column(1))
            names = np.array([*own.languages, UNKNOWN], object)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(fits, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.mapInArrow(judge, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")


def judged(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not model.languages:
        return np.full(len(column), -1), np.zeros(len(column)), np.zeros(len(column), bool)
    parts = [decide(model, [None if x is None else x.decode() for x in raw_texts(column.slice(at, ROWS))]) for at in range(0, len(column), ROWS)]
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate((np.int64, float, bool)))


def accepted(spark: SparkSession, documents: DataFrame, model: Model) -> DataFrame:
    """The documents, whole and with their columns as they were, that the model doesn't reject: null and
    empty texts and texts without letters go, texts of any length are judged whole, and each of repeated
    rows is. If no language was learned, as of a corpus without labels, nothing can be told foreign and
    all documents stay. No rows: no rows. The first column named text counts, in any case."""
    if not model.languages:
        return documents
    at = place_of(documents, "text")
    flat = positional(documents)
    shipped = spark.sparkContext.broadcast(model)  # in proportion to the sample it is made from

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judged(shipped.value, batch.column(at))[2], pa.bool_()))

    return flat.mapInArrow(keep, flat.schema).toDF(*documents.columns)
