"""Quality rules: counted base rules, and a hashed word and character n-gram logistic regression.

The classifier is trained on a bounded sample of labelled rows (``per_class`` rows of each label), calibrated by
Platt scaling on other labelled rows (``calibration`` rows of each label, weighed to the labels' shares among all such
rows), and scored in Arrow batches over whole
texts. A document is kept when it passes the base rules and its probability of label 1 is at least ``threshold``.

Features are shares: of each hashed word and word pair among the words, and of each hashed run of three or five bytes.
A document's score is the mean weight of its n-grams, so it needs no sparse row.

Defined results: a null or empty text has no words and fails the base rules; without labels of both kinds the
probability is 0.5 for all and only the base rules decide; repeated rows each give a row; other columns are not read by
``quality_rules`` and are all returned by ``keep_quality``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import WHITE, bounded_sample, distinct_texts, fold, fold_column, labelled, map_batches, text_key, texts_of, written
from colloquy.llm.linear import Rows, fit_logistic, platt, sigmoid

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
WIDTH = 1 << 16
RUNS = (3, 5)
SCALE = 100.0
PER_CLASS = 800
CALIBRATION = 300
THRESHOLD = 0.3
PIECE = 1 << 19
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def numbered(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Each word's number in order of first appearance, and the distinct words."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return ids, list(seen)


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-1] * n_distinct + ids[1:]
    if n_distinct ** 3 >= 1 << 62:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * n_distinct + ids[2:]
    order = np.argsort(windows, kind="stable")
    s = windows[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for j in range(3):
        covered[j:len(windows) + j] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


def base_counts(text: bytes, words: list[bytes], ids: np.ndarray, n_distinct: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    tails = len(text) - len(text.translate(None, _TAILS))  # bytes that continue a code point
    chars = len(text) - tails - (len(text) - len(text.translate(None, WHITE)))
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), duplicate_lines(text), repeated_words(ids, n_distinct)


_TAILS = bytes(range(128, 192))


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def run_hashes(text: bytes, n: int):
    """Hashes of all runs of ``n`` bytes, a piece of the text at a time."""
    for at in range(0, max(0, len(text) - n + 1), PIECE):
        a = np.frombuffer(text, np.uint8, min(PIECE + n - 1, len(text) - at), at).astype(np.uint32)
        h = np.zeros(len(a) - n + 1, np.uint32)
        for j in range(n):
            h = h * np.uint32(0x01000193) + a[j:len(a) - n + 1 + j]
        yield _mixed(h) % np.uint32(WIDTH)


def word_hashes(ids: np.ndarray, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of all word pairs."""
    h = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))[ids]
    return h % np.uint32(WIDTH), _mixed(h[:-1] * np.uint32(0x85EBCA6B) + h[1:]) % np.uint32(WIDTH)


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of one document's sparse row."""
    text = text or b""
    ids, distinct = numbered(text.split())
    count = np.zeros((2, WIDTH))
    out = []
    words = list(word_hashes(ids, distinct)) if len(ids) else []
    for block, groups in ((0, [[w] for w in words]), (1, [run_hashes(text, n) for n in RUNS])):
        for group in groups:
            c = np.zeros(WIDTH)
            for h in group:
                c += np.bincount(h, minlength=WIDTH)
            if total := c.sum():
                count[block] += c * (SCALE / total)
        cols = np.flatnonzero(count[block])
        out.append((cols + block * WIDTH, count[block][cols]))
    return np.concatenate([c for c, _ in out]), np.concatenate([v for _, v in out])


class Model:
    """Weights of words and of byte runs, and the calibration."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.words, self.runs = (weights[:WIDTH] * SCALE).astype(np.float32), (weights[WIDTH:] * SCALE).astype(np.float32)
        self.bias, self.slope, self.shift = bias, slope, shift

    def logit(self, text: bytes, ids: np.ndarray, distinct: list[bytes]) -> float:
        z = self.bias
        for h in word_hashes(ids, distinct) if len(ids) else ():
            if len(h):
                z += float(self.words[h].mean(dtype=np.float64))
        for n in RUNS:
            total = 0.0
            for h in run_hashes(text, n):
                total += float(self.runs[h].sum(dtype=np.float64))
            z += total / max(1, len(text) - n + 1)
        return z

    def probability(self, text: bytes, ids: np.ndarray, distinct: list[bytes]) -> float:
        return float(sigmoid(self.slope * self.logit(text, ids, distinct) + self.shift))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, calibration: int = CALIBRATION, ridge: float = 1e-4) -> Model:
    """Fit on ``per_class`` texts of each label and calibrate on ``calibration`` other texts of each label.

    Rows whose crc32(doc_id) mod 5 is 0 calibrate, the others train. Copies of a text under one label are sampled as one,
    by their smallest id; the calibration weighs the labels by the documents of its fold that hold them.
    """
    marked, held = labelled(labels, "quality"), fold_column(F.col("doc_id"), 5) == 0
    known = written(distinct_texts(docs, marked), "texts")
    sample = bounded_sample(known.where(~held), ["y"], per_class, ties=["_text"]).unionByName(bounded_sample(known.where(held), ["y"], calibration, ties=["_text"])).drop("_n")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(t) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.astype(np.int32).tobytes() for c, _ in rows], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in rows], pa.binary())], ["doc_id", "y", "cols", "vals"])

    source = texts_of(docs, sample).where(text_key() == F.col("_text")).dropDuplicates(["doc_id", "_text", "y"]).select("doc_id", "y", F.col("text").cast("binary"))
    got = sorted(map_batches(source, run, "doc_id long, y int, cols binary, vals binary").toLocalIterator(), key=lambda r: (r["doc_id"], bytes(r["cols"]), bytes(r["vals"])))
    rows = lambda some: Rows([(np.frombuffer(bytes(r["cols"]), np.int32), np.frombuffer(bytes(r["vals"]), np.float32)) for r in some], 2 * WIDTH)
    fitting, checking = [r for r in got if fold(r["doc_id"], 5)], [r for r in got if not fold(r["doc_id"], 5)]
    y = np.array([r["y"] for r in fitting], float)
    weights, bias = fit_logistic(rows(fitting), y, ridge)
    slope, shift = 1.0, 0.0
    if weights.any():
        documents = {r["y"]: r["count"] for r in marked.where(held).groupBy("y").count().collect()}
        drawn = np.array([r["y"] for r in checking], int)
        each = {k: documents[k] / n for k, n in zip(*(a.tolist() for a in np.unique(drawn, return_counts=True)))}
        slope, shift = platt(rows(checking).dot(weights) + bias, drawn.astype(float), weights=np.array([each[k] for k in drawn.tolist()]))
    return Model(weights, bias, slope, shift)


def judge(model: Model, text: bytes | None, threshold: float) -> tuple:
    """The five counts, base_failed, kept, probability."""
    text = text or b""
    words = text.split()
    ids, distinct = numbered(words)
    counts = base_counts(text, words, ids, len(distinct))
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > 50 * counts[0]
    p = model.probability(text, ids, distinct)
    return (*counts, failed, not failed and p >= threshold, p)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **training) -> DataFrame:
    """One row per document: base counts, base verdict, verdict, calibrated probability."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **training))
    kinds = (pa.int64(),) * 5 + (pa.bool_(), pa.bool_(), pa.float64())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [judge(model.value, t, threshold) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], [x.split()[0] for x in RESULT.split(", ")])

    return map_batches(docs.select("doc_id", F.col("text").cast("binary")), run, RESULT)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **training) -> DataFrame:
    """The kept rows of ``docs`` with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **training))
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([judge(model.value, t, threshold)[6] for t in batch.column(at).cast(pa.binary()).to_pylist()], pa.bool_()))

    return map_batches(docs, run, docs.schema)
