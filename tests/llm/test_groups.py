"""Near-duplicates against brute force, and archives with damage."""

import gzip
import random
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import near_dup as nd, warc_fixity as wf
from colloquy.llm.common import file_system
from colloquy.llm.words import split_words
from tests.llm.helpers import rows_of


def multiset(text):
    w = split_words((text or "").encode())
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(docs):
    bags = {i: multiset(t) for i, t in docs}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in bags:
        for b in bags:
            if a < b and bags[a] and bags[b]:
                both = sum((bags[a] & bags[b]).values())
                if 9 * both >= 4 * (sum(bags[a].values()) + sum(bags[b].values())):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: find(i) for i in bags}


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(9)
    say = lambda n: [f"t{rng.randrange(3000)}" for _ in range(n)]
    docs, shared = [], say(60)
    for _ in range(12):
        base = say(rng.choice([3, 8, 60, 150]))
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = "new"
            docs.append(" ".join(copy))
    docs += [" ".join(say(40) + shared + say(40)) for _ in range(8)]
    docs += [" ".join(say(2) + ["again"] * n) for n in (50, 52, 90, 300)]
    big = say(200)
    docs += [" ".join(big[:i] + ["x%d" % i] + big[i + 1:]) for i in range(0, 200, 5)]
    docs += [None, "", "!!", "one two", "One, TWO", docs[0], docs[0].upper()]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(order[i] + 10, t) for i, t in enumerate(docs)]


def test_classes_equal_brute_force(make, copies):
    got = dict(rows_of(nd.near_duplicates(make(copies)), "doc_id", "class_id"))
    assert got == brute_classes(copies)


def test_one_document_of_each_class_stays(make, copies):
    source = make([*copies, copies[3], (None, "no id"), (None, "no id")])
    kept = nd.deduplicate(source)
    assert kept.columns == source.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(brute_classes(copies).values())) and ids.count(None) == 2
    assert nd.near_duplicates(make([])).count() == 0 and nd.deduplicate(make([])).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(20):
        d = rng.integers(0, 2**63, 80).astype(np.uint64)
        wa, wb = rng.integers(0, 9, 80), rng.integers(0, 9, 80)
        true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        a, b = ((d[w > 0], w[w > 0]) for w in (wa, wb))
        s = nd.signatures([a, b], 512)
        errors.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.04


def test_signature_does_not_depend_on_its_batch():
    rng = np.random.default_rng(4)
    bags = [(np.sort(rng.integers(0, 2**63, n).astype(np.uint64)), rng.integers(1, top, n)) for n, top in ((1, 300), (2, 90), (5, 60), (50, 30), (4000, 30))]
    together = nd.signatures(bags)
    for k, b in enumerate(bags):
        assert (nd.signatures([b])[0] == together[k]).all()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (150, 200)], "a long, b long")
    assert rows_of(nd.components(links), "node", "label") == [(i, 0) for i in range(61)] + [(100, 100), (150, 100), (200, 100)]


PAGES = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 7)) for i in range(200)] + [(None, None, None), (3, "again", "é"), (500, None, "")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS level", "2 AS idx").repartition(3)


def test_damaged_records_are_located(pages):
    got = wf.audit(pages, "page_id % 50 = 7").collect()
    assert len(got) == len(PAGES)
    assert all(r["replica_0_intact"] for r in got)
    assert sorted(r["page_id"] for r in got if not r["replica_1_intact"]) == [7, 57, 107, 157]
    assert all(r["replica_1_intact"] for r in wf.audit(pages).collect())


def test_archives_are_warc_and_cut_files_are_noticed(spark, pages):
    archives, folders = wf.write_archives(pages, 1)
    name = archives.first()["archive"]
    entries = np.concatenate(list(wf.manifest(folders[0], name)))
    fs, base = file_system(folders[0])
    with fs.open_input_file(f"{base}/{name}") as f:
        data = f.read()
    assert entries["offset"].tolist() == np.concatenate([[0], np.cumsum(entries["length"])[:-1]]).tolist()
    for e in entries[:20]:
        record = gzip.decompress(data[e["offset"]:e["offset"] + e["length"]])
        assert record.startswith(b"WARC/1.1\r\n") and e["payload"] in record
    reference = wf.reference_tree(archives, folders[0]).cache()
    with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
        f.write(data[:int(entries["offset"][-2]) + 1])
    bad = wf.differing_records(reference, wf.replica_tree(archives, folders[0], folders[0])).collect()
    assert sorted(r["idx"] for r in bad) == [len(entries) - 2, len(entries) - 1] and {r["archive"] for r in bad} == {name}


def test_appended_bytes_and_changed_records_are_noticed(spark, pages):
    archives, folders = wf.write_archives(pages, 2)
    name = archives.first()["archive"]
    n = {r["archive"]: r["n_records"] for r in archives.collect()}
    reference = wf.reference_tree(archives, folders[0]).cache()
    assert wf.differing_records(reference, wf.replica_tree(archives, folders[0], folders[1])).count() == 0
    fs, base = file_system(folders[1])
    with fs.open_input_file(f"{base}/{name}") as f:
        data = f.read()
    with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
        f.write(data + b"x" * 700)
    bad = wf.differing_records(reference, wf.replica_tree(archives, folders[0], folders[1])).collect()
    assert [(r["archive"], r["idx"], r["stop"] - r["start"]) for r in bad] == [(name, n[name], 0)]
    assert not wf.roots_equal(reference, wf.replica_tree(archives, folders[0], folders[1]))


def test_only_differing_branches_are_visited(spark):
    nodes = []
    tree = wf.Tree()
    for i in range(1000):
        tree.add(i * 10, i * 10 + 10, f"h{i}")
    tree.finish()
    nodes = tree.take()
    by = Counter(n[0] for n in nodes)
    assert by == {0: 1000, 1: 63, 2: 4, 3: 1}
    children = [(a, b, h) for level, i, a, b, h in sorted(nodes) if level == 0 and i // 16 == 5]
    assert next(n[4] for n in nodes if n[:2] == (1, 5)) == wf.join_hashes(children)


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert wf.audit(empty).count() == 0
