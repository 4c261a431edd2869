"""URL filters: host rules, and naive Bayes, learned from the rules' verdicts, over Viterbi-split names."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joinloom.llm.common import LOWER_ASCII, pick, raw_texts, sized, written

#: (verdict, host, path). Fixed values.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Host words that are expected among what is to be blocked or allowed. They label nothing: each counts for
#: so many occurrences more in its class, and what the labelled urls say can outweigh it. Fixed values.
UNWANTED = ("spam", "casino", "adult", "porn", "sex", "bet", "bets", "betting", "gamble", "pills", "pharma", "viagra", "ads", "track", "tracker", "cheap", "win", "prize", "loan", "loans", "xxx", "clickbait", "warez", "crack", "torrent")
WANTED = ("news", "wiki", "edu", "school", "university", "library", "science", "research", "docs", "blog", "museum", "journal", "book", "books", "archive", "gov", "history", "health", "forum", "learn")
#: The occurrences that each of them counts for: a share of all there are, and so many at least.
SEED_SHARE, SEED_LEAST = 50, 20
#: Letters of a name at most: those of a host's label. Longer runs are no names, and a token as they are.
NAME = 63
#: Log odds are summed as whole numbers of so many to one, so that a sum has no order.
UNIT = 1 << 20
#: What of a page is no text; an end that is missing is the page's.
MARKUP = re.compile(rb"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[^>]*(?:>|\Z)|&#?\w+;", re.DOTALL | re.IGNORECASE)
#: What stands in an address and in no other word.
ADDRESS = re.compile(rb"\w[.@:/]+\w")
WORD = re.compile(rb"[a-z\x80-\xff]+")
PIECES = r"[a-z]+|[0-9]+|[^\x00-\x7f]+"
BATCH_WORDS = 200_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, what: str) -> Column:
    """The longest rule that fits: its text (like net/) or its verdict; null if none fits. A rule
    fits its host and all subdomains if the path starts with the rule's."""
    out = None
    for verdict, rule_host, rule_path in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        value = F.lit(f"{rule_host}{rule_path}" if what == "rule" else verdict)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


@dataclass
class Words:
    """Unigram log probabilities; an unknown stretch of n letters has one that falls with n."""

    logs: dict[str, float]
    total: int

    def unknown(self, n: int) -> float:
        return -log(self.total + 2) - 2.5 * n

    def split(self, name: str) -> list[str]:
        """The most probable split by Viterbi; of equal ones that with the shorter last word."""
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            top, at = -np.inf, end - 1
            for start in range(end):
                score = best[start] + self.logs.get(name[start:end], self.unknown(end - start))
                if score >= top:
                    top, at = score, start
            best.append(top)
            back.append(at)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return out[::-1]


def visible_words(raw: bytes | None) -> list[bytes]:
    """The words of a page's text: runs of letters, in lower case, of which those of a-z alone and two
    letters or more count. Mark-up, scripts, styles, entities and addresses are no text."""
    text = MARKUP.sub(b" ", raw or b"").translate(LOWER_ASCII)
    if ADDRESS.search(text):
        text = b" ".join(w for w in text.split() if not ADDRESS.search(w))
    return [w for w in WORD.findall(text) if len(w) > 1 and w.isascii()]


def word_counts(texts: DataFrame) -> DataFrame:
    """texts(html) to (word, n), from whole pages. Each task counts before it sends; it holds
    BATCH_WORDS different words and those of a page at most."""

    def pairs(held: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                held.update(visible_words(raw))
                if len(held) > BATCH_WORDS:
                    yield pairs(held)
                    held.clear()
        yield pairs(held)

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def splits(spark: SparkSession, pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """pieces(piece): different runs of 2 to NAME letters; counts(word, n). Returns (piece, words): each
    split by Viterbi over the counts of all words. The counts stay a table: each piece meets those of
    the words in it, of which it has some two thousand at most, by a join."""
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    seeds = UNWANTED + WANTED
    more = max(SEED_LEAST, total // SEED_SHARE // len(seeds))
    whole = total + more * len(seeds)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [(p, w) for p in batch.column(0).slice(at, 256).to_pylist() for w in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)}]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*found, strict=True)] or [pa.array([], pa.string())] * 2, names=["piece", "word"])

    def viterbi(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for piece, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = {x["word"]: x["n"] for x in known or []}
                for w in seeds:
                    if w in piece:
                        n[w] = n.get(w, 0) + more
                out.append(Words({w: log(k / whole) for w, k in n.items()}, whole).split(piece))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["piece", "words"])

    known = pieces.mapInArrow(inside, "piece string, word string").join(counts, "word").groupBy("piece").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return pieces.join(known, "piece", "left").select("piece", "known").mapInArrow(viterbi, "piece string, words array<string>")


def _pieces(kind: Column, name: Column) -> Column:
    """Runs of letters, of digits and of other characters; of a host without its last label, if it has
    more than that."""
    front = F.substring(name, F.lit(1), F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1)
    text = F.when((kind == "h") & (F.length(front) > 0), front).otherwise(F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def tokens(spark: SparkSession, names: DataFrame, counts: DataFrame) -> DataFrame:
    """names(kind, name, block, allow), different by kind (h: host, p: path) and name, to a row for each
    token: kind, name, block, allow, at, part, word. Digits are one token; the rest of ASCII stands
    between tokens."""
    pieces = names.select("*", F.posexplode(_pieces(F.col("kind"), F.col("name"))).alias("at", "piece"))
    pieces, _ = written(spark, pieces, "pieces")
    is_name = F.col("piece").rlike(rf"\A[a-z]{{2,{NAME}}}\z")
    found = splits(spark, pieces.where(is_name).select("piece").distinct(), counts)
    whole = F.array(F.when(F.col("piece").rlike(r"\A[0-9]"), F.lit("#")).otherwise(F.col("piece")))
    split = pieces.where(is_name).join(found, "piece").unionByName(pieces.where(~is_name).withColumn("words", whole))
    return split.select("kind", "name", "block", "allow", "at", F.posexplode("words").alias("part", "word"))


def learn_bayes(spark: SparkSession, found: DataFrame, blocked: int, allowed: int) -> tuple[DataFrame, int]:
    """found: tokens(); blocked and allowed: how many urls are labelled so. Returns (kind, word, odds
    long) for the tokens that labelled urls or the seeds have, to be broadcast if they are few, and the
    prior, both as log odds of block against allow in 1 / UNIT. Multinomial naive Bayes with Laplace smoothing. What nothing
    labelled has seen speaks for neither class, and has no row."""
    counts = found.groupBy("kind", "word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    counts, _ = written(spark, counts.where("block + allow > 0"), "tokens")
    total = counts.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).first()
    given = {side: max(SEED_LEAST, (total[side] or 0) // SEED_SHARE) for side in ("block", "allow")}
    seeds = spark.createDataFrame([("h", w, given["block"], 0) for w in UNWANTED] + [("h", w, 0, given["allow"]) for w in WANTED], counts.schema)
    counts = counts.unionByName(seeds).groupBy("kind", "word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    kinds = counts.count()
    # What the seeds are given is no observation, so it adds to no class's total.
    share = {side: (F.col(side) + 1) / F.lit(float((total[side] or 0) + kinds)) for side in given}
    odds = counts.select("kind", "word", F.round((F.log(share["block"]) - F.log(share["allow"])) * UNIT).cast("long").alias("odds"))
    return sized(odds, kinds), round((log(blocked + 1) - log(allowed + 1)) * UNIT)


def judge(spark: SparkSession, pages: DataFrame, learn_from: Column | None = None) -> DataFrame:
    """pages(page_id, url, html) to page_id, host, path, rule, verdict, log_odds double, words array.

    The rules judge first: the longest that fits. Their verdicts are also what the method learns from,
    and it judges the urls that no rule fits: names in hosts and paths are split into words by Viterbi
    over unigram counts of all pages' text, and naive Bayes sums the words' log odds of block against
    allow; above zero blocks, and a tie allows. log_odds and words, those of the host and then of the
    path, are the method's for every url. learn_from: a condition on page_id, host and path that urls to
    be learned from meet, so that others can be held out.

    A null url, and one without ://, has empty host and path, fits no rule, and gets the prior's
    verdict; where no rule fits any url, all that the seed words don't decide is allowed. Null html has no
    words, very long pages count whole, and runs of more than NAME letters are a token unsplit. A row
    for each row. All counts are over all rows and stay tables, which hosts and paths, each once, are
    joined with; a host of very many pages is met by partial aggregation and by the adaptive splitting
    of skewed joins. No rows: no rows. Other columns are ignored."""
    rows = pick(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    rows = rows.select("page_id", "host", "path", rule_of(host, path, "rule").alias("rule"), rule_of(host, path, "verdict").alias("ruled"))
    rows, _ = written(spark, rows, "urls")
    learned = F.coalesce(F.lit(True) if learn_from is None else learn_from, F.lit(False))
    sides = [F.coalesce(((F.col("ruled") == side) & learned).cast("long"), F.lit(0)).alias(side) for side in ("block", "allow")]
    each = rows.select("host", "path", *sides).groupBy("host", "path").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    labelled = each.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).first()
    both = F.explode(F.array(F.struct(F.lit("h").alias("kind"), host.alias("name")), F.struct(F.lit("p").alias("kind"), path.alias("name"))))
    names = each.select(both.alias("x"), "block", "allow").groupBy("x.kind", "x.name").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))

    counts, _ = written(spark, word_counts(pick(pages, "html")), "words")
    found, _ = written(spark, tokens(spark, names, counts), "url-tokens")
    odds, prior = learn_bayes(spark, found, labelled["block"] or 0, labelled["allow"] or 0)
    said = F.array_sort(F.collect_list(F.struct("at", "part", "word")))
    scored = found.join(odds, ["kind", "word"], "left").groupBy("kind", "name").agg(F.sum("odds").alias("odds"), F.transform(said, lambda x: F.concat_ws(":", "kind", x["word"])).alias("words"))
    scored, _ = written(spark, scored, "names")
    out = rows
    for kind, name in (("h", "host"), ("p", "path")):
        own = scored.where(F.col("kind") == kind).select(F.col("name").alias(name), F.col("odds").alias(f"{kind}_odds"), F.col("words").alias(f"{kind}_words"))
        out = out.join(own, name, "left")
    total = F.coalesce("h_odds", F.lit(0)) + F.coalesce("p_odds", F.lit(0)) + F.lit(prior)
    none = F.array().cast("array<string>")
    verdict = F.coalesce("ruled", F.when(total > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), (total / UNIT).alias("log_odds"), F.concat(F.coalesce("h_words", none), F.coalesce("p_words", none)).alias("words"))


def held_out(spark: SparkSession, pages: DataFrame, one_in: int = 5) -> tuple[int, int]:
    """How many urls that a rule fits have one of the hosts held out, one in `one_in`, and for how many of
    them the method, which learned from the other hosts, says what the rule does."""
    own = F.pmod(F.crc32(F.col("host").cast("binary")), F.lit(one_in)) == 0
    got = judge(spark, pages, ~own).where(own & F.col("rule").isNotNull())
    right = (F.col("log_odds") > 0) == (F.col("verdict") == "block")
    r = got.agg(F.count("*").alias("n"), F.sum(right.cast("long")).alias("right")).first()
    return r["n"], r["right"] or 0
