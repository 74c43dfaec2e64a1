"""URL filter and periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import periodic_runs as pr, url_filter as uf
from tests.llm.helpers import rows_of

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("Example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "", "block"), ("a.org", "/x", "allow"), (None, "/", "block"), ("", "/", "block")]
URLS = [
    "http://x.example.net/en/1", "https://x.example.net/de/1", "http://example.net", "http://net/", "http://planet/", "HTTP://WWW.Example.COM/de/9?b=2&a=1#f", "http://notexample.com/de/1",
    "http://b.a.org/fr/3", "http://a.org", "http://a.org?x", "http://a.org/x/y", "http://a.org/y", "ftp://u:p@m.site.io:80/path//?utm_source=z&q=1&&ref=k#t", "https://site.io/path?q=1", "site.io/path?q=1",
    "//site.io/path", "://", "http://", "http:///path", "http://?q", "", None, "a://b://c/d", "http://site.io./path/?q=1", "http://é.net/ü", "http://" + "s." * 60 + "net/" + "p/" * 500, "http://www.m.site.io/", "http://site.io/#x?y=1",
]


def plain_parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    authority = re.match(r"[^/?#]*", rest).group()
    tail = rest[len(authority):]
    query = re.match(r"[^?#]*\?([^#]*)", tail)
    return re.sub("[A-Z]", lambda m: m.group().lower(), authority), re.match(r"[^?#]*", tail).group(), query.group(1) if query else ""


def plain_canonical(url):
    host, path, query = plain_parts(url)
    host = re.sub(r"^(www|m)\.", "", re.sub(r"\.$", "", re.sub(r":[0-9]*$", "", re.sub(r"^.*@", "", host))))
    params = sorted(p for p in query.split("&") if p and not p.startswith("utm_") and p.split("=")[0] not in ("ref", "fbclid", "gclid"))
    return host + path.rstrip("/") + ("?" + "&".join(params) if params else "") if host else None


def plain_verdict(url, listed):
    host, path, _ = plain_parts(url)
    fits = [(h.lower() + p, v) for h, p, v in RULES if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    if fits:
        return (host, path, *max(fits, key=lambda r: len(r[0])))
    c = plain_canonical(url)
    return host, path, None, "block" if c is not None and c in {plain_canonical(x) for x in listed} else "allow"


@pytest.fixture(scope="module")
def urls():
    rng = random.Random(4)
    more = [f"http://{rng.choice(['', 'www.', 'm.', 'b.'])}h{rng.randrange(30)}.{rng.choice(['net', 'org', 'com', 'example.net', 'a.org'])}/{rng.choice(['en', 'fr', 'x'])}/{rng.randrange(9)}{rng.choice(['', '/', '?ref=1', '?z=1&a=2', '#k'])}" for _ in range(400)]
    return URLS + more + ["http://b.com/hot"] * 300 + ["http://q.net/hot"] * 300, more[:60] + ["http://b.com/hot/", "http://site.io/path/?q=1&utm_x=3", None, ""]


@pytest.mark.parametrize("blocks,hot", [(1 << 18, 256), (1, 2)])
def test_verdicts_equal_brute_force_whatever_the_filter_lets_pass(spark, urls, monkeypatch, blocks, hot):
    monkeypatch.setattr(uf, "MAX_BLOCKS", blocks)
    monkeypatch.setattr(uf, "HOT", hot)
    rows, listed = urls
    pages = spark.createDataFrame([(i if i % 7 else None, u, "x", "y", 1, "z") for i, u in enumerate(rows)], "page_id long, url string, html string, rule string, host int, key string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = uf.url_filter(pages, rules, spark.createDataFrame([(u,) for u in listed], "url string"))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((i if i % 7 else None, *plain_verdict(u, listed)) for i, u in enumerate(rows)), key=key)
    kept = uf.allowed_pages(pages, rules, spark.createDataFrame([(u,) for u in listed], "url string"))
    assert kept.columns == pages.columns
    assert sorted(str(r["url"]) for r in kept.collect()) == sorted(str(u) for u in rows if plain_verdict(u, listed)[3] == "allow")


def test_filter_keeps_all_listed_keys_and_few_others(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = uf.blocks_for(20000)
    table = uf.blocked_filter(keys, blocks)
    assert table.count() <= blocks
    assert uf.possible_hits(keys, table, blocks).count() == 20000
    other = spark.range(20000).select(F.concat(F.lit("other"), "id").alias("key"))
    assert uf.possible_hits(other, table, blocks).count() < 100
    assert uf.blocks_for(0) == 1 and uf.blocks_for(10**12) == uf.MAX_BLOCKS


def test_empty_url_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    rules, listed = spark.createDataFrame([], "host string, path string, verdict string"), spark.createDataFrame([], "url string")
    assert rows_of(uf.url_filter(pages, rules, listed), "page_id", "rule", "verdict") == [(1, None, "allow")]
    assert uf.url_filter(pages.limit(0), rules, listed).count() == 0


def brute_runs(w, least):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if i > s and size >= max(least, 2 * q) and not any(all(w[k] == w[k + r] for k in range(s, s + size - r)) for r in range(1, q)):
                out.append((s, size, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng, n, k):
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        a, p, m = rng.randrange(n), rng.randrange(1, 9), rng.randrange(40)
        for i in range(a, min(n, a + m)):
            w[i] = w[a + (i - a) % p] if a + (i - a) % p < n else 0
    return w


def test_runs_equal_brute_force():
    rng = random.Random(2)
    for t in range(600):
        w = periodic(rng, rng.randrange(1, 90), rng.choice([1, 2, 3, 5, 20]))
        for least in (2, 3, 12):
            assert [tuple(r) for r in pr.runs_of(np.array(w, np.int32), least).tolist()] == brute_runs(w, least), (w, least)


def test_suffix_tree_lists_suffixes_and_common_beginnings():
    rng = random.Random(5)
    for _ in range(100):
        w = periodic(rng, rng.randrange(1, 60), rng.choice([1, 2, 4]))
        tree = pr.SuffixTree(np.array(w) + 1)
        order, depths = tree.tour()
        assert order.tolist() == sorted(range(len(w) + 1), key=lambda i: w[i:])
        assert tree.tour(descending=True)[0].tolist() == sorted(range(len(w) + 1), key=lambda i: [-x for x in w[i:]])
        common = pr.CommonExtension(order, depths)
        i, j = np.array([(i, j) for i in range(len(w) + 1) for j in range(len(w) + 1) if i != j]).T
        want = [next((k for k in range(len(w)) if i + k >= len(w) or j + k >= len(w) or w[i + k] != w[j + k]), 0) for i, j in zip(i, j)]
        assert common(i, j).tolist() == want


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    docs = [" ".join(f"w{x}" for x in periodic(rng, rng.randrange(1, 120), rng.choice([2, 6, 50]))) for _ in range(120)]
    docs += [None, "", " \n\t", "ab " * 12, "ab " * 11, "x\u00a0y " * 20, "a b\x0bc\x0cd\r\n" * 9, "É É é é " * 4, docs[0], docs[0]]
    return docs


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_documents_with_and_without_runs(make, texts):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)]
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in pr.periodic_runs(make(rows)).collect())
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute_runs(words, 12)
        want.append((str(i), len(words), runs, plain_collapse(words, runs)))
    assert got == sorted(want)
    source = make(rows)
    out = pr.collapse_runs(source)
    assert out.columns == source.columns
    clean = {c for (_, t), (_, _, r, c) in zip(rows, want) if r}
    assert sorted(str(r["text"]) for r in out.collect()) == sorted(c if r else str(t) for (_, t), (_, _, r, c) in zip(rows, want)) and clean
    assert pr.periodic_runs(make([])).count() == 0


def test_planted_tails_and_digests(make, texts):
    want = []
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        runs = brute_runs(words, 12)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(plain_collapse(words, runs))))
    got = pr.run_digests(pr.periodic_runs(pr.with_planted_tails(make(texts))))
    assert rows_of(got, "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256") == want
    assert pr.run_digests(pr.periodic_runs(pr.with_planted_tails(make([])))).count() == 0


def test_a_long_text_is_read_whole(make):
    rng = random.Random(1)
    words = [f"q{rng.randrange(3000)}" for _ in range(300_000)]
    words[150_000:190_000] = (words[150_000:160_000] * 4)
    r = pr.periodic_runs(make([" ".join(words)])).collect()[0]
    assert r["n_words"] == 300_000 and any(x["period"] == 10_000 and x["length"] >= 40_000 for x in r["runs"])
