"""Language ID by mixture inference.

Each language has a smoothed distribution over hashed character n-grams, counted over a bounded sample of labelled
rows (``per_language`` texts of each language, copies as one). Every word of a document has a likelihood under each language.
Expectation-maximisation estimates the document's language proportions from its words; the set of languages is the one
with the largest likelihood less a penalty for each further language. The prediction is the language with the largest
proportion in that set and the score is that proportion.

A document is tried with more than one language where the mixture of all of them, after at most ``ROUNDS`` rounds, beats
the best single language by more than one penalty. Larger sets are then tried in one order, by the proportions in that
mixture, each with the next language added; so the set is a greedy choice among these, not among all sets.

Defined results: texts that are null or have no letter give ``und`` with score 0; without any labelled row every text
gives ``und``; ties take the first language by name; repeated rows each give a row; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import bounded_sample, fold_column, map_batches, map_stream, text_key

WIDTH = 1 << 16
PER_LANGUAGE = 1500
FOLDS, HELD_OUT = 4, 2
ROUNDS = 30
KNOWN_WORDS = 200_000
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, languages string"

_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case. Superscripts, fractions and Roman numerals are word characters, but no letters."""
    words = _WORD.findall(text.lower()) if text else []
    return words if all(map(str.isalpha, words)) else _LETTERS.findall(text.lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams (one to three characters, with word edges) of all words, and the word of each."""
    data = ("^" + "$^".join(words) + "$").encode("utf-32-le")
    c = np.frombuffer(data, np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    out, own = [], []
    for n in (1, 2, 3):
        if len(c) < n:
            continue
        keep = owner[n - 1:] == owner[:len(c) - n + 1]
        h = np.full(len(c) - n + 1, n, np.uint32)
        for j in range(n):
            h = (h ^ c[j:len(c) - n + 1 + j]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(13)
        out.append((h % np.uint32(WIDTH))[keep])
        own.append(owner[:len(c) - n + 1][keep])
    return np.concatenate(out), np.concatenate(own)


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, penalty: float = 1.0):
        """``counts``: n-grams by language and hash."""
        self.languages, self.penalty = languages, penalty
        total = counts.sum(1, keepdims=True)
        back = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * WIDTH)
        self.log = np.log((counts + 200.0 * back) / (total + 200.0)).astype(np.float32).T.copy() if len(languages) else None
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(languages)))

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "rows": self.rows[:0]}

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """Mean log likelihood of each word's n-grams times its length, by language; remembered for frequent words."""
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        if new:
            h, own = grams(new)
            ll = np.zeros((len(new), len(self.languages)))
            size = np.bincount(own, minlength=len(new))
            for k in range(len(self.languages)):
                ll[:, k] = np.bincount(own, self.log[h, k], len(new))
            ll *= (np.fromiter(map(len, new), np.float64, len(new)) / size)[:, None]
            at = len(self.known)
            self.known.update(zip(new, range(at, at + len(new))))
            if at + len(new) > len(self.rows):
                grown = np.zeros((2 * (at + len(new)), len(self.languages)))
                grown[:at] = self.rows[:at]
                self.rows = grown
            self.rows[at:at + len(new)] = ll
        return self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def infer(self, text: str | None) -> tuple[str, float, str]:
        """Prediction, score, and the language set with its proportions."""
        words = words_of(text)
        if not words or not self.languages:
            return "und", 0.0, ""
        ll = self.likelihoods(words)
        alone = ll.sum(0)
        best = int(alone.argmax())
        cost = self.penalty * (len(self.languages) + np.log(len(words)))
        chosen, share, value = [best], np.ones(1), alone[best]
        if ll.max(1).sum() - value > cost:
            p = np.exp(ll - ll.max(1, keepdims=True))
            shift = ll.max(1).sum()
            full, top = mixture(p)
            if top + shift - value > cost:
                order = np.argsort(-full, kind="stable")
                for k in range(2, len(order) + 1):
                    part, got = mixture(p[:, order[:k]], full[order[:k]])
                    if got + shift - cost * (k - 1) > value - cost * (len(chosen) - 1):
                        chosen, share, value = list(order[:k]), part, got + shift
        top = int(np.argmax(share))
        return self.languages[chosen[top]], float(min(1.0, share[top])), ",".join(f"{self.languages[k]}:{s:.3f}" for s, k in sorted(zip(share, chosen), key=lambda x: (-x[0], x[1])))


def mixture(p: np.ndarray, start: np.ndarray | None = None, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and the log likelihood."""
    share = np.full(p.shape[1], 1.0 / p.shape[1]) if start is None else np.maximum(start, 1e-6) / np.maximum(start, 1e-6).sum()
    before = -np.inf
    for _ in range(rounds):
        mix = p @ share + 1e-300
        value = float(np.log(mix).sum())
        if value - before < 1e-3:
            break
        before, share = value, share * (p.T @ (1.0 / mix)) / len(p)
    return share / share.sum(), float(np.log(p @ share + 1e-300).sum())


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, penalty: float = 1.0) -> Model:
    """Count n-grams on ``per_language`` sampled texts of each language that are not held out; copies are sampled as one."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_column(F.col("doc_id"), FOLDS) != HELD_OUT))
    marked = known.select("lang", "text", "doc_id", text_key().alias("_text"))
    texts = marked.groupBy("lang", "_text").agg(F.min("doc_id").alias("_first"))
    sample = bounded_sample(texts, ["lang"], per_language, by="_text").select("lang", "_text", "_first")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if words := words_of(text):
                    for at in range(0, len(words), 50_000):
                        c = np.bincount(grams(words[at:at + 50_000])[0], minlength=WIDTH)
                        total[lang] = total[lang] + c if lang in total else c
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "gram", "n"])

    same = marked.join(F.broadcast(sample), ["lang", "_text"]).where(F.col("doc_id").eqNullSafe(F.col("_first")))
    rows = same.dropDuplicates(["lang", "_text"]).select("lang", "text")
    by = map_stream(rows, count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    packed = by.groupBy("lang").agg(F.collect_list("gram").alias("gram"), F.collect_list("n").alias("n")).collect()  # at most WIDTH numbers a language
    packed = sorted(packed, key=lambda r: r["lang"])
    counts = np.zeros((len(packed), WIDTH))
    for k, r in enumerate(packed):
        counts[k][np.array(r["gram"])] = r["n"]
    return Model([r["lang"] for r in packed], counts, penalty)


def language_mixture(docs: DataFrame, per_language: int = PER_LANGUAGE, penalty: float = 1.0) -> DataFrame:
    """One row per document: whether it was held out, predicted language, score, and the language set."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, per_language, penalty))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [model.value.infer(t) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.string()), (1, pa.float64()), (2, pa.string())))], ["doc_id", "held_out", "lang_pred", "score", "languages"])

    return map_batches(docs.select("doc_id", (fold_column(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text"), run, RESULT)
