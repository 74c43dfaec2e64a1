"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Sixteen statistics of the whole text are transformed towards normal shapes. Class means and covariances come from sums
of all labelled training rows, added up on the executors; the covariances are shrunk towards the pooled one and its
mean diagonal. The score is the logistic of the difference of the two log densities, from Mahalanobis distances with
cached Cholesky factors, and the log prior odds.

Defined results: a null text counts as empty and gets the statistics of an empty text; without labels of both classes
every score is 0.5; a class of one row takes the pooled covariance; repeated rows each give a row; other columns
are not read by ``quality_scores`` and are all returned by ``keep_good``.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import WHITE, fold_column, labelled, map_batches, map_stream, written

NAMES = ("words", "word_length", "long_words", "distinct", "top_word", "second_word", "upper", "digits", "symbols", "marks", "sentence_marks", "lines", "repeated_lines", "bars", "compressed", "last_char_mix")
SHRINK = 0.2
RIDGE = 0.02
FOLDS, HELD_OUT = 3, 1
RESULT = "doc_id long, held_out boolean, score double, predicted int"
PIECE = 1 << 16

_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOL = b"#*$%&|<>@^~_=+{}[]\\"
_MARK = b"!?;:,.\"'()-/"


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def _odds(part: float, whole: float) -> float:
    """Smoothed log odds of a share."""
    return math.log((part + 0.5) / (max(0.0, whole - part) + 0.5)) if whole > part else math.log((part + 0.5) / 0.5)


def statistics(text: bytes | None) -> list[float]:
    text = text or b""
    words = text.split()
    n, size = len(words), len(text)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(2)] + [0, 0]
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    packed = sum(len(zlib.compress(text[i:i + PIECE], 1)) for i in range(0, size, PIECE))
    endings = Counter(w[-1] for w in words)
    return [
        math.log1p(n),
        math.log1p((size - n) / max(1, n)),
        _odds(sum(map((14).__lt__, map(len, words))), n),
        _odds(len(counts), n),
        _odds(top[0], n),
        _odds(top[1], n),
        _odds(_count(text, _UPPER), size),
        _odds(_count(text, _DIGIT), size),
        _odds(_count(text, _SYMBOL), size),
        _odds(_count(text, _MARK), size),
        _odds(_count(text, b".!?"), size),
        math.log1p(n / max(1, len(lines))),
        _odds(len(lines) - len(set(lines)), len(lines)),
        _odds(counts.get(b"|", 0), n),
        _odds(packed, max(size, packed)),
        -sum(c / n * math.log(c / n) for c in endings.values()) if n else 0.0,
    ]


class Model:
    """Per class the mean, the inverse Cholesky factor and the log density's constant."""

    def __init__(self, count: np.ndarray, first: np.ndarray, second: np.ndarray, shrink: float = SHRINK, ridge: float = RIDGE):
        self.ready = bool((count > 0).all())
        if not self.ready:
            return
        p = first.shape[1]
        mean = first / count[:, None]
        scatter = second - count[:, None, None] * mean[:, :, None] * mean[:, None, :]
        pooled = scatter.sum(0) / max(1.0, count.sum() - 2)
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        self.mean, self.whiten, self.constant = mean / self.scale, [], []
        pooled = pooled / np.outer(self.scale, self.scale)
        for k in (0, 1):
            own = scatter[k] / max(1.0, count[k] - 1) / np.outer(self.scale, self.scale) if count[k] > 1 else pooled
            cov = (1 - shrink) * own + shrink * pooled
            cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / p, 1e-6) * np.eye(p)
            factor = np.linalg.cholesky(cov)
            self.whiten.append(np.linalg.inv(factor))
            self.constant.append(math.log(count[k] / count.sum()) - np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        if not self.ready:
            return np.full(len(x), 0.5)
        z = x / self.scale
        log = [self.constant[k] - 0.5 * (((z - self.mean[k]) @ self.whiten[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1.0 / (1.0 + np.exp(-np.clip(log[1] - log[0], -40.0, 40.0)))


def measure(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the vector of statistics as bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [np.array(statistics(t)).tobytes() for t in batch.column(len(keep)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], [*keep, "stats"])

    kinds = dict(rows.dtypes)
    return map_batches(rows.select(*keep, F.col("text").cast("binary")), run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", stats binary")


def train(measured: DataFrame, shrink: float = SHRINK, ridge: float = RIDGE) -> Model:
    """Model from rows of (y, stats): each task sends its sums, which Spark adds up by position."""
    p = len(NAMES)

    def sums(batches):
        total = np.zeros((2, 1 + p + p * p))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, p)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at])], ["at", "v"])

    out = np.zeros(2 * (1 + p + p * p))
    for r in map_stream(measured.select("y", "stats"), sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    out = out.reshape(2, -1)
    return Model(out[:, 0], out[:, 1:1 + p], out[:, 1 + p:].reshape(2, p, p), shrink, ridge)


def fitted(measured: DataFrame, labels: DataFrame, shrink: float, ridge: float) -> Model:
    """Model from the statistics (doc_id, stats) of all documents whose labels may be learnt from."""
    known = labelled(labels, "quality").where(fold_column(F.col("doc_id"), FOLDS) != HELD_OUT)
    return train(measured.join(known, "doc_id"), shrink, ridge)


def quality_scores(docs: DataFrame, labels: DataFrame, shrink: float = SHRINK, ridge: float = RIDGE) -> DataFrame:
    """One row per document: whether its label was held out, score, prediction."""
    measured = written(measure(docs, ["doc_id"]), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(fitted(measured, labels, shrink, ridge))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.value.score(np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, len(NAMES)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_batches(measured.select("doc_id", "stats", (fold_column(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")), run, RESULT)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, shrink: float = SHRINK, ridge: float = RIDGE) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(measure(docs, ["doc_id"]), labels, shrink, ridge))
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]).reshape(-1, len(NAMES))
        return batch.filter(pa.array(model.value.score(x) >= threshold))

    return map_batches(docs, run, docs.schema)
