"""Periodic runs of words (maximal repetitions), found through suffix trees, and texts with each run cut to one period.

A run is a stretch of consecutive words with a smallest period q, a length of at least max(``min_length``, 2 q), that no
neighbouring word extends with that period. Every run holds a Lyndon word of length q that is the longest one to begin
at its place, under the order of the words or under the opposite order; so there are at most two candidates a place.
Each is extended in both directions by two longest-common-extension queries, one on the suffix tree of the text and one
on that of its reversal. The trees are built by Ukkonen's method; an Euler tour notes the depth of the shallowest node
between neighbouring leaves, and a sparse table over these depths answers the depth of a lowest common ancestor in
constant time.

Trees are built only where a run can be: its first (length - q) >= ``min_length`` / 2 words stand again q words later, so
each of its words lies in a stretch of ceil(min_length / 2) words that occurs twice in the text. Texts are cut to the
parts covered by such stretches until nothing changes; no run is lost and none is cut.

Defined results: words are cut at spaces and the ASCII controls 9 to 13; null and empty texts have no words, no runs and
an empty collapsed text; runs may overlap, all are returned; repeated rows and ids each give their own row; an empty
table gives an empty result; other columns are not read by ``periodic_runs`` and all kept by ``collapse_runs``. Very
long texts are read in pieces and held as one number a word; memory and time are linear in the length of the repeated
parts, but for a factor log2(length) of four bytes a word in the sparse tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import map_batches, map_stream
from colloquy.llm.words import pieces

MIN_LENGTH = 12
RUN = "array<struct<start:long,length:long,period:long>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class SuffixTree:
    """Suffix tree of ``word`` (numbers from 1 on) and an end mark 0; nodes are rows of the lists, edges a dictionary."""

    def __init__(self, word: np.ndarray):
        self.size = len(word) + 1
        text = [*word.tolist(), 0]
        self.width = width = int(word.max(initial=0)) + 1
        begin, end, link, edges = [0], [0], [0], {}
        node = first = along = waiting = 0  # the active point: a node, the place of its edge's first word, words along the edge
        for i, w in enumerate(text):
            waiting += 1
            unlinked = 0
            while waiting:
                if not along:
                    first = i
                key = node * width + text[first]
                below = edges.get(key)
                if below is None:
                    edges[key] = len(begin)
                    begin.append(i)
                    end.append(self.size)
                    link.append(0)
                    tip = node
                else:
                    span = end[below] - begin[below]
                    if along >= span:
                        node, first, along = below, first + span, along - span
                        continue
                    middle = begin[below] + along
                    if text[middle] == w:
                        if unlinked:
                            link[unlinked] = node
                        along += 1
                        break
                    tip = len(begin)
                    edges[key] = tip
                    edges[tip * width + text[middle]] = below
                    edges[tip * width + w] = tip + 1
                    begin += (begin[below], i)
                    end += (middle, self.size)
                    link += (0, 0)
                    begin[below] = middle
                if unlinked:
                    link[unlinked] = tip
                unlinked = tip
                waiting -= 1
                if node:
                    node = link[node]
                elif along:
                    along -= 1
                    first = i - waiting + 1
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        self.children = np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.symbols = keys[order] % width
        self.bounds = np.searchsorted(keys[order] // width, np.arange(len(begin) + 1))
        self.span = np.array(end) - np.array(begin)

    def tour(self, descending: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order of the leaves, and the depth of the shallowest node visited since the leaf before.

        The end mark comes first at every node, also where the words are taken in ``descending`` order.
        """
        children = self.children
        if descending:
            rows = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
            children = children[np.lexsort((np.where(self.symbols > 0, self.width - self.symbols, 0), rows))]
        children, bounds, span, size = children.tolist(), self.bounds.tolist(), self.span.tolist(), self.size
        suffixes, depths, shallow = [], [], 0
        todo = [(0, 0, -1)]
        while todo:
            node, depth, turn = todo.pop()
            if turn >= 0:  # not the first child: the tour has come back to its parent
                shallow = turn
            lo, hi = bounds[node], bounds[node + 1]
            if lo == hi:
                suffixes.append(size - depth)
                depths.append(shallow)
                continue
            for k in range(hi - 1, lo, -1):
                todo.append((children[k], depth + span[children[k]], depth))
            todo.append((children[lo], depth + span[children[lo]], -1))
        return np.array(suffixes), np.array(depths, np.int32)


class CommonExtension:
    """Length of the longest common beginning of two suffixes, many pairs at a time."""

    def __init__(self, suffixes: np.ndarray, depths: np.ndarray):
        self.rank = np.empty(len(suffixes), np.int64)
        self.rank[suffixes] = np.arange(len(suffixes))
        self.table = [depths]
        step = 1
        while 2 * step <= len(depths):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.table[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(k)) + 1])
        return out


def lyndon_lengths(suffixes: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place: the way to the next smaller suffix."""
    n = len(suffixes) - 1
    rank = np.empty(n + 1, np.int64)
    rank[suffixes] = np.arange(n + 1)
    rank, out, open_ = rank.tolist(), [0] * n, []
    for i in range(n + 1):
        r = rank[i]
        while open_ and rank[open_[-1]] > r:
            j = open_.pop()
            out[j] = i - j
        open_.append(i)
    return np.array(out, np.int64)


def maximal_runs(word: np.ndarray, min_length: int) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of numbers from 1 on."""
    n = len(word)
    tree = SuffixTree(word)
    up, depths = tree.tour()
    down = tree.tour(descending=True)[0]
    del tree
    forward, backward = CommonExtension(up, depths), CommonExtension(*SuffixTree(word[::-1]).tour())
    start = np.concatenate([np.arange(n), np.arange(n)])
    period = np.concatenate([lyndon_lengths(up), lyndon_lengths(down)])
    right, left = forward(start, start + period), backward(n - start, n - start - period)
    found = (left + right >= period) & (left + right + period >= min_length)
    rows = np.stack([start - left, left + right + period, period], axis=1)[found]
    return np.unique(rows, axis=0)


def repeated_parts(ids: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Bounds of the parts in which every word belongs to ``size`` words that occur twice in the same part."""
    n = len(ids)
    if n <= size:
        return []
    value = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(29)
    gram = np.zeros(n - size + 1, np.uint64)
    for j in range(size):  # equal stretches have equal values; a chance collision only keeps a part
        gram = gram * np.uint64(0xBF58476D1CE4E5B9 | 1) + value[j:n - size + 1 + j]
    part = np.zeros(n, np.int64)
    while True:
        inside = np.flatnonzero((part[:n - size + 1] >= 0) & (part[:n - size + 1] == part[size - 1:]))
        key = gram[inside] + part[inside].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = inside[count[which] > 1]
        if not len(twice):
            return []
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, twice, 1)
        np.add.at(step, twice + size, -1)
        covered = np.cumsum(step[:-1]) > 0
        fresh = covered & np.concatenate([[True], ~covered[:-1] | (part[1:] != part[:-1])])
        after = np.where(covered, np.cumsum(fresh), -1)
        if np.array_equal(covered, part >= 0):
            starts = np.flatnonzero(fresh)
            ends = np.flatnonzero(covered & np.concatenate([~covered[1:] | (after[1:] != after[:-1]), [True]])) + 1
            return list(zip(starts.tolist(), ends.tolist()))
        part = after


def word_numbers(text: bytes | None) -> tuple[np.ndarray, list[bytes]]:
    """The whole text as numbers of its distinct words, and these words."""
    index: dict[bytes, int] = {}
    parts = [np.zeros(0, np.int32)]
    for piece in pieces(text or b""):
        words = piece.split()
        parts.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words)))
    return np.concatenate(parts), list(index)


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period."""
    found = [np.zeros((0, 3), np.int64)]
    for lo, hi in repeated_parts(ids, -(-min_length // 2)):
        if hi - lo >= min_length:
            _, word = np.unique(ids[lo:hi], return_inverse=True)
            found.append(maximal_runs(word + 1, min_length) + (lo, 0, 0))
    rows = np.concatenate(found)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapsed(ids: np.ndarray, vocabulary: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds behind its first period, joined by one space."""
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([vocabulary[i] for i in ids[np.cumsum(step[:-1]) == 0].tolist()])


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text of each row."""
    if min_length < 2:
        raise ValueError("a run has at least two words")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, runs, texts = [], [], []
        for text in batch.column(1).to_pylist():
            ids, vocabulary = word_numbers(text)
            rows = runs_of(ids, min_length)
            sizes.append(len(ids))
            runs.append(rows)
            texts.append(collapsed(ids, vocabulary, rows))
        flat = np.concatenate([np.zeros((0, 3), np.int64), *runs])
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(RUN_TYPE.value_type))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), items), pa.array(texts, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"],
        )

    return map_batches(docs.select("doc_id", F.col("text").cast("binary")), run, f"doc_id long, n_words long, runs {RUN}, collapsed string")


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with all its columns; texts that hold a run are replaced by their collapsed form, others stay as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, text in enumerate(texts):
                ids, vocabulary = word_numbers((text or "").encode())
                rows = runs_of(ids, min_length)
                if len(rows):
                    texts[k] = collapsed(ids, vocabulary, rows).decode()
            columns = [pa.array(texts, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_stream(docs, run, docs.schema)


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; in one document of ten, chosen by crc32 of its id, the words from a place on repeat with a period.

    With h = crc32(doc_id as text), g = floor(h / 10) and n words: where h % 10 = 0, each word i >= a = g % n becomes
    word a + (i - a) % p with p = 1 + floor((n - a) / (3 + g % 8)). Other texts are unchanged.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    cut = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, cut).alias("_w"), F.floor(h / 10).alias("_g"))
    rows = rows.withColumn("_a", F.when(F.size("_w") > 0, F.col("_g") % F.size("_w")).cast("int"))
    rows = rows.withColumn("_p", (1 + F.floor((F.size("_w") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    tail = F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_w", F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(runs: DataFrame) -> DataFrame:
    """One row a document: number of runs, the longest one, digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    joined = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_b"), digest(joined).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("_b.start")).alias("start"), F.col("_b.length").alias("length"), (-F.col("_b.period")).alias("period"),
        F.floor(1000 * F.col("_b.length") / -F.col("_b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
