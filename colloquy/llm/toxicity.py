"""Toxicity: a counterfactual-regularised sentence classifier.

Labelled documents are cut into sentences (of at most ``LONGEST`` words); hashed words that
at least ``MIN_DOCS`` of the sampled documents hold, present or not, are the features. In every
labelled sentence that names a group, the identity term is swapped for the other terms of its set, and the squared
change of the score is added to the loss, so that a group's name by itself moves the score little. The first fit takes
each sentence's label from its document; the second keeps as positive only those sentences of toxic documents that
the first finds most toxic. A document's score is the calibrated score of its most toxic sentence.

The fit uses a bounded sample of distinct texts: ``per_class`` toxic ones and three times as many others, and
``calibration`` other texts of each label, weighed to the labels' shares among all documents. A sampled text stands for all its copies where documents are counted. Equal
sentences of the sample are one row of the fit, and belong to each document that holds them.

Defined results: null and empty texts have one empty sentence, whose score is the intercept's; without labels of both
classes every score is 0.5; repeated rows each give a row; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import bounded_sample, distinct_texts, fold_column, labelled, map_batches, text_key, texts_of, written
from colloquy.llm.linear import Rows, fit_logistic, platt, sigmoid
from colloquy.llm.words import PIECE, pieces

WIDTH = 1 << 22
MIN_DOCS = 5
PER_CLASS, CALIBRATION = 800, 300
RIDGE, FAIRNESS = 5e-5, 1.0
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
RESULT = "doc_id long, held_out boolean, score double, predicted int"
KNOWN_WORDS = 300_000
LONGEST = 40

# Sets of identity terms that may be swapped for each other.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("african", "european", "american", "mexican", "chinese", "arab"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("deaf", "blind", "disabled"),
    ("old", "young"),
)

# Lower case; sentence ends become line feeds; other ASCII marks become spaces.
_FOLD = bytes(10 if c in b"\n.!?" else c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def sentences(text: bytes | None):
    """Lists of words, one list a sentence; a longer sentence gives several."""
    for piece in pieces((text or b"").translate(_FOLD), PIECE):
        for line in piece.split(b"\n"):
            words = line.split()
            for at in range(0, len(words), LONGEST):
                yield words[at:at + LONGEST]


def columns(words: list[bytes]) -> set[int]:
    """Hashed words of a sentence."""
    return {h % WIDTH for h in map(zlib.crc32, words)}


def swaps(words: list[bytes], identity=IDENTITY) -> list[list[bytes]]:
    """The sentence with each identity term replaced by each other term of its set, one at a time."""
    out = []
    for group in identity:
        terms = [t.encode() for t in group]
        for i, w in enumerate(words):
            if w in terms:
                out += [[*words[:i], t, *words[i + 1:]] for t in terms if t != w]
    return out


class Weights(dict):
    """Weight of each word, remembered for at most ``KNOWN_WORDS`` words."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table

    def __missing__(self, word: bytes) -> float:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = v = float(self.table[zlib.crc32(word) % WIDTH])
        return v


class Model:
    """Weights of the hashed words ``cols``, intercept and calibration."""

    def __init__(self, cols: np.ndarray, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.cols, self.weights, self.bias, self.slope, self.shift = cols, weights, bias, slope, shift
        table = np.zeros(WIDTH, np.float32)
        table[cols] = weights
        self.of = Weights(table).__getitem__

    def __reduce__(self):
        return Model, (self.cols, self.weights, self.bias, self.slope, self.shift)

    def logit(self, text: bytes | None) -> float:
        """Of the most toxic sentence; words that a sentence repeats count once."""
        return self.bias + max((sum(map(self.of, dict.fromkeys(words))) for words in sentences(text)), default=0.0)

    def score(self, text: bytes | None) -> float:
        return float(sigmoid(self.slope * self.logit(text) + self.shift)) if self.weights.any() else 0.5


def fit(texts: list[bytes | None], y: np.ndarray, ridge: float = RIDGE, fairness: float = FAIRNESS, identity=IDENTITY, copies: np.ndarray | None = None) -> Model:
    """Model of labelled texts, not calibrated; each text stands for ``copies`` documents (default: one)."""
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    copies = np.ones(len(y), np.int64) if copies is None else np.asarray(copies, np.int64)
    owner, line, label, rows, pairs, seen = [], [], [], [], [], np.zeros(WIDTH, np.int64)
    met: dict[tuple, int] = {}
    for doc in np.argsort(-y, kind="stable").tolist():
        held, lines = set(), set()
        for words in sentences(texts[doc]):
            here = columns(words)
            held |= here
            mark = tuple(words)
            lines.add(at := met.setdefault(mark, len(rows)))
            if at < len(rows):  # a copied sentence is one row, toxic if any copy is
                continue
            label.append(y[doc])
            rows.append(np.fromiter(here, np.int64, len(here)))
            for other in swaps(words, identity):
                there = columns(other)
                gone, come = np.array(sorted(here - there), np.int64), np.array(sorted(there - here), np.int64)
                pairs.append((np.concatenate([gone, come]), np.concatenate([np.ones(len(gone)), -np.ones(len(come))])))
        owner += [doc] * len(lines)
        line += sorted(lines)
        seen[list(held)] += copies[doc]
    common = seen >= min(MIN_DOCS, max(1, int(copies.sum()) // 10))
    used = np.flatnonzero(common)
    place = np.full(WIDTH, -1, np.int64)
    place[used] = np.arange(len(used))

    def compact(cols, vals):
        at = place[cols]
        return at[at >= 0], vals[at >= 0]

    rows = [compact(r, np.ones(len(r))) for r in rows]
    data, owner, line, label = Rows(rows, len(used)), np.array(owner), np.array(line), np.array(label)
    apart = Rows([compact(*p) for p in pairs], len(used)) if pairs else None
    weights, bias = fit_logistic(data, label, ridge, apart, fairness)
    z = data.dot(weights) + bias
    top = np.full(len(y), -np.inf)
    np.maximum.at(top, owner, z[line])
    most = (y[owner] > 0) & (z[line] >= np.minimum(top[owner], 0.5 * top[owner]))
    toxic = np.zeros(len(rows), bool)
    toxic[line[most]] = True
    use = np.flatnonzero(toxic | (label == 0))
    weights, bias = fit_logistic(Rows([rows[i] for i in use], len(used)), toxic[use].astype(float), ridge, apart, fairness)
    return Model(used, weights, bias)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, calibration: int = CALIBRATION, ridge: float = RIDGE, fairness: float = FAIRNESS, identity=IDENTITY) -> Model:
    """Fit and calibrate on bounded samples of texts that are not held out; every fifth id by crc32 calibrates.

    Copies of a text under one label are sampled as one, by their smallest id.
    """
    known = labelled(labels, "toxic").where(fold_column(F.col("doc_id"), FOLDS) != HELD_OUT)
    texts = written(distinct_texts(docs, known), "texts")
    check = fold_column(F.col("doc_id"), 5) == 0
    sample = bounded_sample(texts.where(~check), ["y"], 3 * per_class, ties=["_text"]).where((F.col("y") == 0) | (F.col("_n") <= per_class)).drop("_n").withColumn("c", F.lit(False)).unionByName(bounded_sample(texts.where(check), ["y"], calibration, ties=["_text"]).drop("_n").withColumn("c", F.lit(True)))
    found = texts_of(docs, sample).where(text_key() == F.col("_text")).dropDuplicates(["doc_id", "_text"])
    rows = sorted(((r["c"], r["doc_id"], bytes(r["text"] or b""), r["y"], r["copies"]) for r in found.select("c", "doc_id", F.col("text").cast("binary"), "y", "copies").toLocalIterator()))
    fitting = [r for r in rows if not r[0]]
    model = fit([r[2] for r in fitting], np.array([r[3] for r in fitting]), ridge, fairness, identity, np.array([r[4] for r in fitting]))
    if model.weights.any():
        z = np.array([model.logit(r[2]) for r in rows if r[0]])
        y = np.array([r[3] for r in rows if r[0]], int)
        documents = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.sum("copies").alias("n")).collect()}
        each = {k: documents[k] / n for k, n in zip(*(a.tolist() for a in np.unique(y, return_counts=True)))}
        model.slope, model.shift = platt(z, y, weights=np.array([each[k] for k in y.tolist()]))
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **training) -> DataFrame:
    """One row per document: whether its label was held out, score, prediction."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **training))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = np.array([model.value.score(t) for t in batch.column(2).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_batches(docs.select("doc_id", (fold_column(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("binary")), run, RESULT)
