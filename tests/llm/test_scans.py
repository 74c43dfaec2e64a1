"""Decontamination and licence scan against brute force."""

import hashlib
import random
import re

import pytest

from colloquy.llm import decontaminate as dc, licenses as lic
from tests.llm.helpers import rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    words, hit, found = plain_words(text), set(), set()
    for item, t in items:
        for w in {tuple(x) for x in dc.windows_of(plain_words(t))}:
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i:i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünit", "naïve", "日本", "A1"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([3, 9, 10, 11, 25]))) for i in range(25)] + [(100, None), (101, ""), (102, "!!"), (None, say(12)), (103, "One, two"), (3, say(10))]
    docs = [say(rng.randrange(0, 60)) for _ in range(60)]
    for i in range(0, 60, 3):
        t = rng.choice([t for _, t in items if t])
        docs[i] = docs[i] + ". " + t.upper().replace("Ï", "ï").replace("Ü", "Ü") + "! " + docs[i]
    docs += [None, "", " \n", "one TWO three", "w1 " * 3000, docs[3], docs[3]]
    return docs, items


def test_contamination_equals_brute_force_on_both_paths(spark, make, passages):
    docs, items = passages
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = [(i, *brute(t, items)) for i, t in enumerate(docs)]
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(dc.contamination(make(docs), benchmark), *names) == want
    assert rows_of(dc.contamination(make(docs), benchmark, max_windows=5), *names) == want


def test_documents_or_spans_go(spark, make, passages):
    docs, items = passages
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    source = make(docs)
    clean = {i for i, t in enumerate(docs) if not brute(t, items)[4]}
    for bound in (200_000, 5):
        kept = dc.decontaminate(source, benchmark, max_windows=bound)
        assert kept.columns == source.columns and {r["doc_id"] for r in kept.collect()} == clean
    cut = {r["doc_id"]: r["text"] for r in dc.decontaminate(source, benchmark, mode="spans").collect()}
    assert len(cut) == len(docs)
    for i, t in enumerate(docs):
        assert not brute(cut[i], items)[4]
        if i in clean:
            assert cut[i] == t


def test_rows_go_by_their_own_text_on_both_paths(spark, make, passages):
    docs, items = passages
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    first = "left " + " ".join(plain_words(items[4][1])[:5]) + " " + items[0][1] + " " + " ".join(plain_words(items[4][1])[5:]) + " right"
    rows = [(i if i % 4 else None, t) for i, t in enumerate(docs)] + [(i, f"clean text {i}") for i in (3, 3, 7)] + [(None, "clean text"), (3, first), (None, docs[3]), (None, docs[3])]
    source = make(rows)
    want = sorted(((i, t) for i, t in rows if not brute(t, items)[4]), key=str)
    for bound in (200_000, 5):
        kept = dc.decontaminate(source, benchmark, max_windows=bound)
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == want
    cut = [dc.decontaminate(source, benchmark, mode="spans", max_windows=b) for b in (200_000, 5)]
    assert cut[1].columns == source.columns
    got = [sorted(((r["doc_id"], r["text"]) for r in c.collect()), key=str) for c in cut]
    assert got[0] == got[1] and len(got[1]) == len(rows) and not any(brute(t, items)[4] for _, t in got[1])
    clean = make(["clean", None])
    assert rows_of(dc.decontaminate(clean, benchmark, mode="spans", max_windows=5), "doc_id", "text") == [(0, "clean"), (1, None)]


def test_spans_are_cut_until_none_is_left_on_both_paths(spark, make):
    benchmark = spark.createDataFrame([(1, "a b c"), (2, "x y z"), (3, "p q r")], "item_id long, text string")
    source = make(["u a b x y p q r z c v", "a b", "p q r"])
    for bound in (200_000, 1):
        got = rows_of(dc.decontaminate(source, benchmark, mode="spans", max_windows=bound), "doc_id", "text")
        assert [(i, t.split()) for i, t in got] == [(0, ["u", "v"]), (1, ["a", "b"]), (2, [])]


def test_empty_tables(spark, make):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(make([]), benchmark).count() == 0
    assert rows_of(dc.contamination(make(["a b c"]), benchmark), "doc_id", "n_words", "n_hit") == [(0, 3, 0)]
    assert lic.license_scan(make([])).count() == 0


def test_licence_places_equal_brute_force(make):
    rng = random.Random(5)
    parts = [p for _, p in lic.BASE] + [t for _, _, t in lic.NOTICES] + ["license", "under the", "CC BY-NC 4.0", "nc", "cc by", "Apache License, Version 2.0.", "gnu general public", "mit", "wörd"]
    docs = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 9))) for _ in range(80)] + [None, "", "cc by nc cc by nc", "cc cc by nc by nc", "under the MIT License " * 4000]
    got = {r["doc_id"]: r for r in lic.license_scan(make(docs)).collect()}
    keys = [(a, p.split(), True) for a, p in lic.BASE] + [(a, p.split(), False) for a, p, _ in lic.NOTICES]
    for i, t in enumerate(docs):
        words = plain_words(t)
        at = [(label, base, s) for label, key, base in keys for s in range(len(words)) if words[s:s + len(key)] == key]
        base = [s for _, b, s in at if b]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(base))
        assert (r["first_word"], r["last_word"]) == ((min(base), max(base)) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for x, b, _ in at if b}))
        assert r["labels"] == ",".join(sorted({x for x, _, _ in at}))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(at)


def test_document_frequencies_count_all_documents(make):
    templates = lic.notices()
    vocabulary = lic.vocabulary_of(templates)
    n = lic.document_frequencies(make(["mit mit license", "license", None, "x"]), vocabulary)
    assert n[0] == 4 and n[vocabulary[b"mit"]] == 1 and n[vocabulary[b"license"]] == 2
