"""The corpus pipeline against its operators applied in sequence, and against plain words for copies and passages."""

import hashlib
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from colloquy.llm import decontaminate as dc, near_dup as nd, quality_density as qd, quality_rules as qr
from colloquy.llm.common import read

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_run_equals_the_operators_in_sequence(spark, sf):
    docs, labels, bench = read(spark, sf, "documents"), read(spark, sf, "labels"), read(spark, sf, "benchmark")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in cp.run(spark, sf).collect()}

    some = lambda keep: docs.where(docs.doc_id.isin(keep))
    left = ids(qr.quality_rules(docs, labels).where("kept"))
    assert 0 < len(left) < len(texts)
    scores = qd.quality_scores(some(left), labels)
    left = ids(scores.where("predicted = 1"))
    left = ids(nd.near_duplicates(some(left)).where("kept"))
    left = ids(dc.contamination(some(left), bench).where("not contaminated"))
    assert sorted(got) == left

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i in left:
        encoded = library.encode(texts[i] or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(encoded) and got[i]["ids_sha256"] == hashlib.sha256(np.array(encoded, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(encoded, skip_special_tokens=False).encode()).hexdigest()

    passages = {tuple(w) for r in bench.collect() for w in dc.windows_of(words(r["text"]))}
    kept = [words(texts[i]) for i in left]
    assert len({tuple(w) for w in kept if w}) == len([w for w in kept if w])
    for w in kept:
        assert not any(tuple(w[i:i + n]) in passages for n in {len(p) for p in passages} for i in range(len(w) - n + 1))


def test_stages_keep_the_columns_of_documents(spark, sf):
    docs = read(spark, sf, "documents")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "decontamination", "bpe"] and cp.ORACLE_SQL is None
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, sf).schema == docs.schema
