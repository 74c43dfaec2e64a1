"""Importance resampling against plain sums, and draws with ties, nulls and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import resampling as rs
from tests.llm.helpers import rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, run):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return w, [" ".join(w[i:i + k]) for k in range(1, run + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, run=1, buckets=10000, seed=2024, percent=10, least=20):
    of = lambda t: Counter(zlib.crc32(f.encode()) % buckets for f in features(t, run)[1])
    s, t = Counter(), Counter()
    for _, x in rows:
        s += of(x)
    for x in target:
        t += of(x)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        words, f = features(x, run)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(n * gain[b] for b, n in of(x).items())
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = [None] * len(out)
    for k, r in enumerate(order[:percent * len(order) // 100]):
        ranks[next(j for j, x in enumerate(out) if x is r)] = k + 1
    return [(*r[:4], k) for r, k in zip(out, ranks)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(200)] + ["Ünit", "NAÏVE", "日本", "A1"]
    say = lambda n, k: " ".join(rng.choice(vocabulary[:k]) for _ in range(n))
    docs = [(i, say(rng.randrange(0, 90), rng.choice([5, 60, 204]))) for i in range(300)]
    docs += [(None, say(30, 20)), (None, say(40, 20)), (7, say(50, 50)), (900, None), (901, ""), (902, "!?"), (903, "w1 " * 5000), (904, say(40000, 204))]
    docs += [(910, say(60, 20))] * 5
    return docs, [say(30, 10) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("run,buckets,percent", [(1, 10000, 10), (3, 1000, 37), (2, 100, 100)])
def test_weights_scores_and_ranks_equal_plain_sums(spark, make, corpus, run, buckets, percent):
    docs, target = corpus
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = rs.weights(make(docs), bench, max_run=run, buckets=buckets, percent=percent)
    want = brute(docs, target, run, buckets, percent=percent)
    plain = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
    assert plain([tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()]) == plain(want)
    drawn = rs.resample(make(docs), bench, max_run=run, buckets=buckets, percent=percent)
    assert drawn.columns == make(docs).columns
    texts = Counter((docs[k][0], docs[k][1]) for k, r in enumerate(want) if r[4] is not None)
    assert Counter((r["doc_id"], r["text"]) for r in drawn.collect()) == texts


def test_planes_are_exact_for_any_counts_and_gains():
    rng = np.random.default_rng(1)
    for buckets in (1, 63, 64, 65, 1000):
        gains = rng.integers(-20000, 20000, buckets)
        gains[rng.random(buckets) < 0.2] = 0
        counts = []
        for _ in range(9):
            b = np.flatnonzero(rng.random(buckets) < 0.5)
            counts.append((b, rng.integers(1, 1 << int(rng.integers(1, 40)), len(b))))
        planes, powers = rs.gain_planes(gains)
        assert rs.plane_weights(counts, planes, powers, buckets).tolist() == [int((n * gains[b]).sum()) for b, n in counts]
    assert rs.gain_planes(np.zeros(5, np.int64))[0].any() == False  # noqa: E712


def test_words_follow_from_features():
    for run in (1, 2, 5):
        assert all(rs.words_of(sum(max(0, n - k + 1) for k in range(1, run + 1)), run) == n for n in range(40))


def test_pieces_of_long_texts_count_alike(monkeypatch):
    text = (" ".join(f"a{i % 37}" for i in range(3000))).encode()
    whole = [rs.bucket_counts(text, run, rs.BucketOf(500)) for run in (1, 2, 4)]

    def cut(t):
        at = [0, 2, 5, t.index(b" ", 900), t.index(b" ", 5000), len(t)]
        return [t[a:b] for a, b in zip(at, at[1:])]

    monkeypatch.setattr(rs, "pieces", cut)
    for run, (b, n) in zip((1, 2, 4), whole):
        c, m = rs.bucket_counts(text, run, rs.BucketOf(500))
        assert b.tolist() == c.tolist() and n.tolist() == m.tolist()


def test_empty_tables(spark, make):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert rs.weights(make([]), bench).count() == 0 and rs.resample(make([]), bench).count() == 0
    assert rows_of(rs.weights(make(["a b", None]), bench), "doc_id", "n_features", "rank") == [(0, 2, None), (1, 0, None)]
