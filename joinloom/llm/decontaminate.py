"""Benchmark decontamination by an Aho-Corasick automaton over word windows."""

from __future__ import annotations

import functools
import pickle
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinloom.llm.common import file_system, fresh_path, pick, place_of, positional, raw_texts, written

WINDOW = 10
#: Nodes of one automaton, of about 40 bytes each; there is a node for each byte of a window at most. The
#: windows of a larger benchmark are dealt to several automata, of which a task holds one at a time.
AUTOMATON_NODES = 8_000_000
#: Bytes of text that a task holds while it goes through several automata.
HELD_BYTES = 64_000_000

#: A-Z become a-z; other bytes below 0x80 but digits and letters become spaces. UTF-8 keeps all
#: further characters above 0x7F, so this is the word rule [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on bytes.
NORMAL = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

def item_windows(raw: bytes | None, window: int = WINDOW) -> set[bytes]:
    words = (raw or b"").translate(NORMAL).split()
    if not words:
        return set()
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def automaton(windows: dict[bytes, set[str]]) -> ahocorasick.Automaton | None:
    """Over windows, each between spaces. A value: (words in it, ids of its items)."""
    if not windows:
        return None
    found = ahocorasick.Automaton()
    for w, own in windows.items():
        found.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(own)))
    found.make_automaton()
    return found


def word_hits(found: ahocorasick.Automaton | None, raw: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
    """The text's number of words, the runs [from, to) of hit words, and the items' ids."""
    words = raw.translate(NORMAL).split()
    if not words or found is None:
        return len(words), [], set()
    line = f" {b' '.join(words).decode('latin-1')} "  # a character for each byte
    runs: list[tuple[int, int]] = []
    items: set[str] = set()
    at = seen = 0  # words that end before character `seen`
    for end, (length, own) in found.iter(line):
        at += line.count(" ", seen, end)
        seen = end
        items.update(own)
        if runs and at - length <= runs[-1][1]:
            # ends only grow, but a longer window can begin before earlier runs
            low = at - length
            while runs and low <= runs[-1][1]:
                low = min(low, runs.pop()[0])
            runs.append((low, at))
        else:
            runs.append((at - length, at))
    return len(words), runs, items


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code-point offsets [start, end) in the text as it was."""
    if not runs:
        return []
    words = [m.span() for m in WORD.finditer(text)]
    return [(words[a][0], words[b - 1][1]) for a, b in runs]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _window_batches(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(item, text) to (item, window): each item's windows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                if own := sorted(item_windows(raw, window)):
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.string()), pa.array(own, pa.binary())], names=["item", "window"])

    return run


def _builder(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(part, window, item), sorted by part, to a file with each part's automaton, which gets its name
    when it is whole; yields (part, windows)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, at = file_system(folder)
        fs.create_dir(at, recursive=True)
        attempt = TaskContext.get().taskAttemptId()

        def stored(part: int, windows: dict[bytes, set[str]]) -> pa.RecordBatch:
            with fs.open_output_stream(f"{at}/_{part}-{attempt}", compression=None) as out:
                out.write(pickle.dumps(automaton(windows)))
            fs.move(f"{at}/_{part}-{attempt}", f"{at}/{part}")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(windows)], pa.int64())], names=["part", "windows"])

        now, held, names = -1, {}, {}
        for batch in batches:
            for part, window, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if held:
                        yield stored(now, held)
                    now, held, names = part, {}, {}
                own = held.setdefault(window, set())
                if item is not None:
                    own.add(names.setdefault(item, item))
        if held:
            yield stored(now, held)

    return build


def build(spark: SparkSession, benchmark: DataFrame, window: int = WINDOW, nodes: int = AUTOMATON_NODES) -> tuple[str, list[int]]:
    """Writes the automaton over all items' windows to the shared folder; returns the folder and its
    parts' numbers: one, unless the windows have more than `nodes` bytes. Tasks make the windows and
    build the automata, and the driver gets a number for each."""
    items = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item"), "text")
    windows, _ = written(spark, items.mapInArrow(_window_batches(window), "item string, window binary"), "windows")
    distinct = windows.select("window").distinct()
    total = distinct.agg(F.sum(F.length("window") + 2).alias("n")).first()["n"] or 0
    parts, folder = -(-total // nodes), fresh_path(spark, "automaton")
    if not parts:
        return folder, []
    dealt = windows.select(F.pmod(F.xxhash64("window"), F.lit(parts)).alias("part"), "window", "item")
    built = dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_builder(folder), "part long, windows long")
    return folder, sorted(r["part"] for r in built.collect())


@functools.lru_cache(1)
def _loaded(folder: str, part: int) -> ahocorasick.Automaton:
    """A process reads an automaton once, and holds one at a time."""
    fs, at = file_system(folder)
    with fs.open_input_stream(f"{at}/{part}", compression=None) as source:
        return pickle.loads(source.read())


def _hits(batches: Iterator[pa.RecordBatch], at: int, folder: str, parts: list[int], held_bytes: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[tuple]]]:
    """Each batch, its texts, and word_hits() of them. Where there is more than one automaton, texts are
    held up to held_bytes and go through one automaton after the other, the last first next time."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[tuple]]]:
        found: list[list[tuple]] = []
        for k, part in enumerate(parts or [-1]):
            own = _loaded(folder, part) if parts else None
            for i, batch in enumerate(held):
                got = [word_hits(own, raw or b"") for raw in raw_texts(batch.column(at))]
                if k:
                    got = [(n, merged(a + b) if b else a, x | y if y else x) for (n, a, x), (_, b, y) in zip(found[i], got, strict=True)]
                    found[i] = got
                else:
                    found.append(got)
        parts.reverse()
        for batch, got in zip(held, found, strict=True):
            yield batch, raw_texts(batch.column(at)), got

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(at).nbytes
        if len(parts) < 2 or size >= held_bytes:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


def find(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, nodes: int = AUTOMATON_NODES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """documents(doc_id, text), benchmark(item_id, text) to doc_id, n_words long, runs array of (from, to)
    word runs that windows cover, items array of item ids as sorted strings, spans array of (start,
    end) code points of the runs in the text as it was.

    A window is `window` consecutive words of an item, or all words of an item that has fewer. One
    automaton over all windows is built by a task, written to the shared folder, read once by each
    worker process, and scans each text once. The windows of a benchmark with more than `nodes` bytes of
    them are dealt by hash to as many automata as that takes; a task then holds up to held_bytes of
    texts and one automaton, and takes the texts through one after the other.

    Null and empty texts have no words and no hits; items without words have no windows. Items with
    a null id mark words but are not listed. Repeated item ids are one item; repeated documents are a
    row each. No documents: no rows. Other columns are ignored, whatever their names."""
    docs = pick(documents, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    folder, parts = build(spark, benchmark, window, nodes)
    run, span = (pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())])) for a, b in (("from", "to"), ("start", "end")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, found in _hits(batches, 1, folder, list(parts), held_bytes):
            runs = [[{"from": a, "to": b} for a, b in hit] for _, hit, _ in found]
            spans = [[{"start": a, "end": b} for a, b in original_spans((raw or b"").decode(), hit)] if hit else [] for raw, (_, hit, _) in zip(texts, found, strict=True)]
            columns = [pa.array([n for n, _, _ in found], pa.int64()), pa.array(runs, run), pa.array([sorted(own) for _, _, own in found], pa.list_(pa.string())), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "runs", "items", "spans"])

    return docs.mapInArrow(scan, f"doc_id {kind}, n_words long, runs array<struct<from: long, to: long>>, items array<string>, spans array<struct<start: long, end: long>>")


def clean(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, nodes: int = AUTOMATON_NODES, held_bytes: int = HELD_BYTES, least: int | None = None) -> DataFrame:
    """The documents, whole and with their columns as they were, without those in which a run of `least`
    words or more is hit, a window's number unless told otherwise: an item of few words, which may be
    a common phrase, doesn't take documents away on its own.

    Null and empty texts stay, texts of any length are scanned whole, each of repeated rows is judged,
    and a benchmark without words takes nothing away. No rows: no rows. The first column named text
    counts, in any case."""
    at, least = place_of(documents, "text"), window if least is None else least
    flat = positional(documents)
    folder, parts = build(spark, benchmark, window, nodes)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, found in _hits(batches, at, folder, list(parts), held_bytes):
            yield batch.filter(pa.array([all(b - a < least for a, b in hit) for _, hit, _ in found], pa.bool_()))

    return flat.mapInArrow(keep, flat.schema).toDF(*documents.columns)
