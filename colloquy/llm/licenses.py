"""License scan: find licence notices through the rarest words of their key phrases.

Document frequencies of all licence words are counted over every document. Each key phrase is indexed by its two
rarest words with their positions in the notice. In a document, the places of the two words are shifted by these
positions and intersected; where they meet, the whole key phrase is compared word by word. So every place of every
key phrase is found. The score is the largest share, weighted by rarity, of a notice's words that stand where the
notice has them, over all verified places; 0 without any.

Defined results: null and empty texts have no words, empty labels and score 0; phrases of one word are looked up by
that word alone; repeated rows each give a row; overlapping places all count; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import map_batches, map_stream
from colloquy.llm.words import word_ids

RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

# Phrases that a document's base labels are read from.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Label, key phrase, and the notice that holds it, in the words of the public licence texts.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "apache license version 2", "licensed under the apache license version 2 0"),
    ("gpl-2", "gnu general public license version 2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3", "licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license", "licensed under the gnu lesser general public license"),
    ("agpl-3", "gnu affero general public license", "licensed under the gnu affero general public license"),
    ("mpl-2", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "free and unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("cc0", "cc0 1 0 universal", "creative commons cc0 1 0 universal"),
    ("cc-by-nc", "creative commons attribution noncommercial", "licensed under a creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike", "licensed under a creative commons attribution sharealike"),
    ("cc-by", "creative commons attribution 4 0 international", "licensed under a creative commons attribution 4 0 international license"),
)


class Notice:
    def __init__(self, label: str, phrase: str, notice: str, base: bool):
        self.label, self.base = label, base
        self.words, self.key = notice.encode().split(), phrase.encode().split()
        self.at = next(i for i in range(len(self.words)) if self.words[i:i + len(self.key)] == self.key)


def notices(base=BASE, more=NOTICES) -> list[Notice]:
    return [Notice(a, p, p, True) for a, p in base] + [Notice(a, p, t, False) for a, p, t in more]


def vocabulary_of(templates: list[Notice]) -> dict[bytes, int]:
    return {w: i + 1 for i, w in enumerate(sorted({w for t in templates for w in t.words}))}


def document_frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Documents that hold each licence word; at 0 the number of documents. Counted over all rows."""
    size = len(vocabulary) + 1

    def run(batches):
        count = np.zeros(size, np.int64)
        for batch in batches:
            count[0] += batch.num_rows
            for text in batch.column(0).to_pylist():
                seen = np.unique(word_ids(text, vocabulary))
                count[seen[seen > 0]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(count)], ["id", "n"])

    out = np.zeros(size, np.int64)
    for r in map_stream(docs.select(F.col("text").cast("binary")), run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


class PhraseIndex:
    """Key phrases indexed by the positions of their two rarest words."""

    def __init__(self, templates: list[Notice], vocabulary: dict[bytes, int], frequencies: np.ndarray):
        self.templates, self.vocabulary = templates, vocabulary
        self.idf = np.log((1.0 + frequencies[0]) / (1.0 + frequencies)) + 1.0
        self.rows = []
        for t in templates:
            key, words = (np.array([vocabulary[w] for w in x], np.int32) for x in (t.key, t.words))
            rare = sorted(range(len(key)), key=lambda i: (-self.idf[key[i]], i))
            self.rows.append((t, key, words, rare[0], rare[min(1, len(key) - 1)]))

    def places(self, ids: np.ndarray, key: np.ndarray, one: int, two: int) -> np.ndarray:
        """All starts of the key phrase."""
        starts = np.flatnonzero(ids == key[one]) - one
        if two != one and len(starts):
            starts = np.intersect1d(starts, np.flatnonzero(ids == key[two]) - two, assume_unique=True)
        starts = starts[(starts >= 0) & (starts + len(key) <= len(ids))]
        for j in range(len(key)):
            if not len(starts):
                break
            starts = starts[ids[starts + j] == key[j]]
        return starts

    def aligned(self, ids: np.ndarray, words: np.ndarray, start: int) -> float:
        """Share by rarity of the notice's words that stand in place when it begins at ``start``."""
        at = np.arange(start, start + len(words))
        inside = (at >= 0) & (at < len(ids))
        same = np.zeros(len(words), bool)
        same[inside] = ids[at[inside]] == words[inside]
        weight = self.idf[words]
        return float(weight[same].sum() / weight.sum())

    def scan(self, text: bytes | None) -> tuple:
        ids = word_ids(text, self.vocabulary)
        present = np.zeros(len(self.vocabulary) + 1, bool)
        present[ids] = True
        base, labels, places, score = set(), set(), [], 0.0
        for t, key, words, one, two in self.rows:
            if present[key[one]] and present[key[two]] and len(found := self.places(ids, key, one, two)):
                labels.add(t.label)
                if t.base:
                    base.add(t.label)
                    places.append(found)
                score = max(score, *(self.aligned(ids, words, int(s) - t.at) for s in found))
        flat = np.concatenate(places) if places else None
        return len(ids), 0 if flat is None else len(flat), None if flat is None else int(flat.min()), None if flat is None else int(flat.max()), ",".join(sorted(base)), ",".join(sorted(labels)), min(1.0, score)


def license_scan(docs: DataFrame, base=BASE, more=NOTICES) -> DataFrame:
    """One row per document: words, places of base phrases, labels and score."""
    templates = notices(base, more)
    vocabulary = vocabulary_of(templates)
    index = docs.sparkSession.sparkContext.broadcast(PhraseIndex(templates, vocabulary, document_frequencies(docs, vocabulary)))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [index.value.scan(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return map_batches(docs.select("doc_id", F.col("text").cast("binary")), run, RESULT)
