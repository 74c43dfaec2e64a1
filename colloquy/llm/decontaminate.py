"""Benchmark decontamination: find, verify and remove passages of evaluation items in training documents.

Every window of ten consecutive words of an item (or the whole item, where it has fewer) is looked up in every
document. The windows are broadcast as a hash set while they number at most ``max_windows``; beyond that the same
windows meet the documents' windows in an equi-join, with equal results. Either way each row is judged, and cut, by
its own text, also where ids repeat or are null.

Defined results: a null or empty text has no words and no hit; an item without a word has no window; items that share
a window are each counted; an item with a null id marks words but is in no list of items; repeated rows each give a
row; other columns are not read. Empty tables give an empty result, or documents without hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import map_batches, map_stream, text_key, written
from colloquy.llm.words import FOLD, split_words, word_ids

WINDOW = 10
MAX_WINDOWS = 200_000
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def windows_of(words: list, size: int = WINDOW) -> list[tuple]:
    """All windows of ``size`` consecutive words; a shorter list, but no empty one, is one window."""
    if not words:
        return []
    return [tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, n, window): the distinct windows of each item, words joined by spaces."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, len(w), b" ".join(w).decode()) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in set(windows_of(split_words(t), size))]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["item_id", "n", "window"])

    source = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    return map_batches(source, run, "item_id string, n int, window string").distinct()


class WindowSet:
    """Hash set of item windows, grouped by their number of words."""

    def __init__(self, rows: list[tuple[str | None, int, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.exact: dict[int, dict[bytes, set]] = {}
        for item, n, window in rows:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in window.encode().split(b" ")], np.int32)
            self.exact.setdefault(n, {}).setdefault(ids.tobytes(), set()).add(item)
        self.hashes = {n: np.unique(self.hash(np.frombuffer(b"".join(keys), np.int32), np.arange(len(keys)) * n, n)) for n, keys in self.exact.items()}

    @staticmethod
    def hash(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """Hash of the window of ``n`` ids at each start."""
        out = np.zeros(len(starts), np.uint64)
        for j in range(n):
            out = (out ^ ids[starts + j].astype(np.uint64)) * _MIX
            out ^= out >> np.uint64(29)
        return out

    def scan(self, text: bytes | None) -> tuple[int, np.ndarray | None, set]:
        """Number of words, which of them are hit (None: none), and the items that occur."""
        ids = word_ids(text, self.vocabulary)
        hit, items = None, set()
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for n, exact in self.exact.items():
            starts = np.flatnonzero(unknown[n:] == unknown[:-n])  # windows of known words only
            if not len(starts):
                continue
            starts = starts[np.isin(self.hash(ids, starts, n), self.hashes[n])]
            for i in starts.tolist():
                if found := exact.get(ids[i:i + n].tobytes()):
                    if hit is None:
                        hit = np.zeros(len(ids), bool)
                    hit[i:i + n] = True
                    items |= found
        return len(ids), hit, items - {None}

    def spans(self, text: bytes) -> list[tuple[int, int]]:
        """Byte ranges of the stretches of hit words."""
        _, hit, _ = self.scan(text)
        if hit is None:
            return []
        return stretches(text, hit)


def stretches(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of the stretches of words marked in ``hit``."""
    starts, ends = word_bounds(text)
    step = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the byte ranges ``spans``."""
    kept, last = [], 0
    for a, b in spans:
        kept.append(text[last:a])
        last = b
    return b"".join([*kept, text[last:]])


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte, and the byte after the last, of each word."""
    inside = np.frombuffer(b" " + text.translate(FOLD) + b" ", np.uint8) != 32
    step = np.diff(inside.astype(np.int8))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def window_set(benchmark: DataFrame, size: int = WINDOW, max_windows: int = MAX_WINDOWS) -> WindowSet | None:
    """The windows as a set for broadcast; None where they exceed the bound."""
    rows = written(item_windows(benchmark, size), "windows")
    if rows.limit(max_windows + 1).count() > max_windows:
        return None
    return WindowSet(sorted(((r[0], r[1], r[2]) for r in rows.collect()), key=str))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per document: words, hit words, items that occur, and the digest of their ids."""
    found = window_set(benchmark, size, max_windows)
    if found is None:
        return _by_join(docs, benchmark, size)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scans = [shared.value.scan(t) for t in batch.column(1).to_pylist()]
        hits = [0 if h is None else int(h.sum()) for _, h, _ in scans]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([n for n, _, _ in scans], pa.int64()), pa.array(hits, pa.int64()), pa.array([len(i) for _, _, i in scans], pa.int64()), pa.array([digest(i) for _, _, i in scans]), pa.array([h > 0 for h in hits])],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    return map_batches(docs.select("doc_id", F.col("text").cast("binary")), run, RESULT)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text (``_text``), text."""
    return docs.select("doc_id", text_key().alias("_text"), F.col("text").cast("binary").alias("text"))


def _places(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``items`` (n, window, ...) and the word number ``at`` of each of their windows in ``rows``; the windows are shuffled."""
    sizes = sorted(r[0] for r in items.select("n").distinct().collect())

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc, key, text = (batch.column(k)[row].as_py() for k in range(3))
                words = split_words(text)
                for n in sizes:
                    for at in range(0, len(words) - n + 1, 10_000):
                        out = [b" ".join(words[i:i + n]).decode() for i in range(at, min(at + 10_000, len(words) - n + 1))]
                        yield pa.RecordBatch.from_arrays([pa.array([doc] * len(out), pa.int64()), pa.array([key] * len(out)), pa.array(range(at, at + len(out)), pa.int64()), pa.array(out)], ["doc_id", "_text", "at", "window"])

    return map_stream(rows, windows, "doc_id long, _text string, at long, window string").join(items, "window").drop("window")


def _by_join(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """The same result with the windows shuffled by their words; used for large benchmarks."""
    rows = _rows(docs)
    hits = written(_places(rows.distinct(), item_windows(benchmark, size)).select("doc_id", "_text", "at", "n", "item_id"), "hits")
    same = ["doc_id", "_text"]
    hit = hits.select(*same, F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("w")).distinct().groupBy(same).agg(F.count("*").alias("n_hit"))
    ids = hits.where(F.col("item_id").isNotNull()).select(*same, "item_id").distinct().groupBy(same).agg(F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("ids"), F.count("*").alias("n_items"))
    count = map_batches(rows, lambda b: pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(split_words(t)) for t in b.column(2).to_pylist()], pa.int64())], ["doc_id", "_text", "n_words"]), "doc_id long, _text string, n_words long")
    out = count
    for k, part in enumerate((hit, ids)):
        part = part.withColumnsRenamed({"doc_id": f"_doc{k}", "_text": f"_key{k}"})
        out = out.join(part, F.col("doc_id").eqNullSafe(F.col(f"_doc{k}")) & (F.col("_text") == F.col(f"_key{k}")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _cut_by_join(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """``docs`` with the stretches of hit words cut out, for large benchmarks.

    A round finds the places of the windows, and cuts, in the texts that the round before has changed.
    """
    items = written(item_windows(benchmark, size).select("n", "window").distinct(), "windows")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, at, n in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
            hit = np.zeros(len(split_words(text)), bool)
            for i, m in zip(at, n):
                hit[i:i + m] = True
            out.append(without(text, stretches(text, hit)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "_text", "text"])

    now, rounds = _rows(docs).distinct(), []
    while True:
        places = _places(now, items).groupBy("doc_id", "_text").agg(F.collect_list(F.struct("at", "n")).alias("hits"))
        places = written(places.select(F.col("doc_id").alias("_doc"), F.col("_text").alias("_key"), "hits.at", "hits.n"), "places")
        if places.isEmpty():
            break
        hit = now.join(places, now["doc_id"].eqNullSafe(F.col("_doc")) & (now["_text"] == F.col("_key"))).select("doc_id", "_text", "text", "at", "n")
        now = written(map_batches(hit, cut, "doc_id long, _text string, text binary"), "cut")
        rounds.append(now.withColumn("_round", F.lit(len(rounds))))
    if not rounds:
        return docs
    done = reduce(DataFrame.unionByName, rounds).groupBy("doc_id", "_text").agg(F.max_by("text", "_round").cast("string").alias("_cut"))
    done = done.withColumnsRenamed({"doc_id": "_doc", "_text": "_key"})
    out = docs.join(done, docs["doc_id"].eqNullSafe(done["_doc"]) & (text_key(docs["text"]) == done["_key"]), "left")
    return out.select(*(F.coalesce(done["_cut"], docs[c]).alias(c) if c == "text" else docs[c] for c in docs.columns))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", size: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with all its columns, without the documents that hold an item's window (``mode="documents"``), or with
    the stretches of hit words cut out of their texts (``mode="spans"``; the text around a cut is kept as it is).

    A cut may bring together words that form a new window; spans are cut until none is left.
    """
    found = window_set(benchmark, size, max_windows)
    if found is None:
        if mode != "documents":
            return _cut_by_join(docs, benchmark, size)
        items = item_windows(benchmark, size).select("n", "window").distinct()
        bad = _places(_rows(docs).distinct(), items).select(F.col("doc_id").alias("_doc"), F.col("_text").alias("_key")).distinct()
        return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_doc"]) & (text_key(docs["text"]) == bad["_key"]), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(found)
    at = docs.columns.index("text")

    def clean(text: bytes) -> bytes:
        while spans := shared.value.spans(text):
            text = without(text, spans)
        return text

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).cast(pa.binary()).to_pylist()
        if mode == "documents":
            return batch.filter(pa.array([shared.value.scan(t)[1] is None for t in texts], pa.bool_()))
        new = pa.array([t if t is None else clean(t).decode() for t in texts], pa.string())
        return pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=pa.schema([f.with_type(pa.string()) if i == at else f for i, f in enumerate(batch.schema)]))

    return map_batches(docs, run, docs.schema)
