"""Seeded draws, replicates, ranks and quantiles against numpy and brute force; large keys and many equal values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.operators import scan as sc
from colloquy.stats import components as cp, draws, models as md, resample as rs


def ranks(x):
    return pd.Series(x).rank().to_numpy()


def corr(x, y):
    return np.corrcoef(x, y)[0, 1]


def test_counts_are_poisson_and_follow_the_unit():
    w = draws.counts(np.arange(3000), np.arange(400), 42).astype(float)
    assert w.mean() == pytest.approx(1, abs=0.005) and w.var() == pytest.approx(1, abs=0.01)
    for k in range(5):
        assert (w == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.002)
    assert abs(corr(w[:, 0], w[:, 1])) < 0.08 and abs(corr(w[0], w[1])) < 0.2
    u = np.array([5, -5, 5 + (1 << 32), 1 << 60])
    a = draws.counts(u, np.arange(300), 1)
    assert (draws.counts(u[::-1], np.arange(300), 1)[::-1] == a).all() and (draws.counts(u[2:3], np.arange(300), 1) == a[2:3]).all()
    assert len({bytes(r) for r in a}) == 4


def test_permutations_are_one_to_one_and_spread():
    for n in [*range(1, 40), 255, 256, 257, 1025]:
        p = draws.permuted(np.arange(n), n, np.arange(7), 3)
        assert (np.sort(p, axis=0) == np.arange(n)[:, None]).all()
    p = draws.permuted(np.arange(4), 4, np.arange(24000), 5)
    _, k = np.unique(p.T, axis=0, return_counts=True)
    assert len(k) == 24 and ((k - 1000.0) ** 2 / 1000).sum() < 60
    some = draws.permuted(np.array([7, 3]), 50, np.array([2, 9]), 5)
    assert (some == draws.permuted(np.arange(50), 50, np.arange(10), 5)[[7, 3]][:, [2, 9]]).all()


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    frames = []
    for k, n, step in [("a", 70, 0), ("hot", 300, 4), ("one", 1, 0), ("flat", 5, 0)]:
        x = rng.normal(size=n)
        y = x + rng.normal(size=n)
        if step:  # many equal values, one of them in four of five rows
            x, y = np.round(x * step) / step, np.round(y)
            x[: n * 4 // 5] = 0.0
        if k == "flat":
            x[:] = 2.0
        frames.append(pd.DataFrame({"k": k, "unit": np.arange(n) * 3 - 7, "x": x, "y": y}))
    pdf = pd.concat(frames, ignore_index=True)
    d = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("a", 999, None, 1.0), ("a", 998, 1.0, None)], "k string, unit long, x double, y double"))
    return pdf, d.repartition(5)


@pytest.mark.parametrize("rows,block", [(1 << 14, 64), (16, 8)])
def test_replicates_equal_numpy_for_any_chunk(table, monkeypatch, rows, block):
    monkeypatch.setattr(rs, "CHUNK_ROWS", rows)
    monkeypatch.setattr(rs, "BLOCK", block)
    pdf, d = table
    got = {(m, r.k, r.b): r.stat for m in ("spearman", "pearson") for r in rs.bootstrap_correlations(d, ["k"], 20, m).collect()}
    obs, perm = rs.permutation_correlations(d, ["k"], 20)
    perm = {(r.k, r.b): r.stat for r in perm.collect()}
    obs = {r.k: r.rho for r in obs.collect()}
    for k in ("a", "hot"):
        g = pdf[pdf.k == k].reset_index(drop=True)
        w = draws.counts(g.unit.to_numpy(), np.arange(20), 42)
        for b in range(20):
            i = np.repeat(np.arange(len(g)), w[:, b])
            assert got["pearson", k, b] == pytest.approx(corr(g.x[i], g.y[i]))
            assert got["spearman", k, b] == pytest.approx(corr(ranks(g.x[i]), ranks(g.y[i])))
        g = g.sort_values(["x", "unit"]).reset_index(drop=True)
        to = draws.permuted(np.arange(len(g)), len(g), np.arange(20), 42)
        rx, ry = ranks(g.x), ranks(g.y)
        assert obs[k] == pytest.approx(corr(rx, ry))
        for b in range(20):
            assert perm[k, b] == pytest.approx(corr(rx[to[:, b]], ry))
    assert got["spearman", "flat", 0] is None and got["pearson", "flat", 0] is None
    p = {r.k: r.p_perm for r in rs.permutation_p(d, ["k"], 20).collect()}
    assert p["a"] == pytest.approx(1 / 21)


def test_replicate_moments_move_no_row(spark, table, capsys):
    pdf, d = table
    m = rs.replicate_moments(d.select("unit", "x", "y"), [], "unit", ["x", "y"], 200)
    assert abs(m.agg(F.avg("n")).first()[0] - len(pdf)) < 6
    m = rs.replicate_moments(spark.range(1000).select(F.col("id").alias("unit"), F.rand(1).alias("x"), F.rand(2).alias("y")), [], "unit", ["x", "y"], 200)
    m.explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(b") or "Join" not in plan
    assert "MapInPandas" in plan and plan.index("MapInPandas") > 0 and "Join" not in plan
    g = pdf[pdf.k == "a"]
    w = draws.counts(g.unit.to_numpy(), np.arange(3), 42).astype(float)
    got = {r.b: r for r in rs.replicate_moments(table[1].where("k = 'a'"), ["k"], "unit", ["x", "y"], 3).collect()}
    for b in range(3):
        assert (got[b].n, got[b].s0, got[b].q0_1, got[b].q1_1) == pytest.approx((w[:, b].sum(), (w[:, b] * g.x).sum(), (w[:, b] * g.x * g.y).sum(), (w[:, b] * g.y * g.y).sum()))


def test_wishart_draws_are_like_random_rows():
    n, p = 60, 4
    rng = np.random.default_rng(2)
    rows = np.sort([np.linalg.eigvalsh(np.corrcoef(rng.normal(size=(n, p)), rowvar=False)) for _ in range(4000)], axis=1)
    drawn = np.linalg.eigvalsh(cp.wishart_correlations(n, p, np.arange(4000), 1))
    assert np.quantile(drawn, 0.95, axis=0) == pytest.approx(np.quantile(rows, 0.95, axis=0), abs=0.02)
    assert drawn.mean(0) == pytest.approx(rows.mean(0), abs=0.01)
    assert np.isfinite(cp.wishart_correlations(3, 5, np.arange(5), 1)).all()


def test_parallel_analysis_keeps_real_components(spark):
    rng = np.random.default_rng(3)
    f = rng.normal(size=(300, 1))
    x = np.hstack([f + 0.5 * rng.normal(size=(300, 3)), rng.normal(size=(300, 2))])
    d = spark.createDataFrame(pd.DataFrame(x, columns=list("abcde")))
    r = {x.component: x for x in cp.parallel_analysis(d, list("abcde"), 1000).collect()}
    assert [r[i].retained for i in range(1, 6)] == [True, False, False, False, False]
    assert r[1].threshold > r[2].threshold > r[5].threshold and len(r) == 5


def test_component_stability_and_indirect_effect(spark):
    rng = np.random.default_rng(4)
    f = rng.normal(size=200)
    pdf = pd.DataFrame({"u": range(200), "a": f + 0.3 * rng.normal(size=200), "b": f + 0.3 * rng.normal(size=200), "c": rng.normal(size=200)})
    d = spark.createDataFrame(pdf)
    load, comp = cp.bootstrap_stability(d, "u", ["a", "b", "c"], 1, 300)
    load, comp = {r.feature: r for r in load.collect()}, comp.first()
    z = (pdf[["a", "b", "c"]] - pdf[["a", "b", "c"]].mean()).to_numpy()
    w = draws.counts(pdf.u.to_numpy(), np.arange(300), 42)
    first = []
    for b in range(300):
        v = np.linalg.eigh(np.corrcoef(np.repeat(z, w[:, b], axis=0), rowvar=False))[1][:, -1]
        first.append(v * np.sign(v[0]))
    assert load["b"].loading_mean == pytest.approx(np.mean(first, axis=0)[1], abs=1e-6) and load["b"].n_boot == 300
    assert load["a"].ci_low == pytest.approx(np.quantile(np.array(first)[:, 0], 0.025), abs=1e-6) and comp.cosine_mean > 0.99
    e = md.indirect_effect(d, "u", "a", "b", "c", 500).first()
    assert e.ci_low < e.indirect < e.ci_high


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": ["hot"] * 8000 + [f"k{i % 40}" for i in range(2000)], "v": rng.normal(size=10000) * 10.0 ** rng.integers(-5, 5, 10000), "u": np.arange(10000)})
    pdf.loc[pdf.index % 5 < 2, "v"] = np.round(pdf.v)
    return pdf, spark.createDataFrame(pdf).repartition(6)


def test_quantiles_and_ranks_with_most_rows_in_one_key(skewed):
    pdf, d = skewed
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.975, "e": 1.0}
    got = {r.k: [r[n] for n in probs] for r in sc.quantiles(d, ["k"], "v", probs).collect()}
    for k, g in pdf.groupby("k"):
        assert got[k] == pytest.approx(list(np.quantile(g.v, list(probs.values()))))
    whole = sc.quantiles(d, [], "v", {"m": 0.5}).collect()
    assert [r.m for r in whole] == [pytest.approx(np.median(pdf.v))]
    r = {x.u: x.r for x in sc.average_rank(d, ["k"], "v", "r").collect()}
    want = pdf.groupby("k").v.rank()
    assert all(r[u] == want[u] for u in range(0, 10000, 7))
    p = {x.u: x.p for x in sc.places(sc.ranges(d, ["k", "v", "u"]), ["k"], "p").collect()}
    s = pdf.sort_values(["k", "v", "u"]).reset_index(drop=True)
    assert [p[u] for u in s.u] == list(s.groupby("k").cumcount())


def test_quantiles_of_empty_missing_and_single_values(spark):
    d = spark.createDataFrame([("a", None), ("b", 3.0), ("c", float("nan")), ("d", 1.0), ("d", -2.0), ("d", None)], "k string, v double")
    got = {r.k: (r.lo, r.m) for r in sc.quantiles(d, ["k"], "v", {"lo": 0.1, "m": 0.5}).collect()}
    assert got == {"b": (3.0, 3.0), "d": (pytest.approx(-1.7), -0.5)}
    assert sc.quantiles(d.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def test_fdr_of_large_families_and_tiny_p(spark):
    rng = np.random.default_rng(10)
    p = np.concatenate([rng.random(3000) ** 40, np.zeros(500), np.ones(500), rng.random(50)])
    pdf = pd.DataFrame({"f": ["x"] * 4000 + ["y"] * 50, "i": np.arange(4050), "p": p})
    got = {r.i: r.p_fdr for r in rs.bh_fdr(spark.createDataFrame(pdf).repartition(5), ["f"]).collect()}
    for _, g in pdf.groupby("f"):
        o = g.sort_values("p", kind="stable")
        q = np.minimum.accumulate((o.p * len(o) / np.arange(1, len(o) + 1)).to_numpy()[::-1])[::-1]
        assert [got[i] for i in o.i] == pytest.approx(np.minimum(q, 1))


def test_removal_is_minimal_where_one_unit_suffices_and_never_above_subsets(spark):
    from itertools import combinations

    rng = np.random.default_rng(12)
    rows, want = [], {}
    for k in range(6):
        x = rng.normal(size=12)
        y = x + rng.normal(size=12) * (0.3 + 0.2 * k)
        rows += [(k, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
        for m in range(1, 5):
            best = min(corr(ranks(np.delete(x, c)), ranks(np.delete(y, c))) for c in combinations(range(12), m))
            if best < 0.7:
                want[k] = m
                break
    d = spark.createDataFrame([*rows, (0, 99, None, 1.0)], "g int, unit int, x double, y double")
    steps = {}
    for r in sorted(rs.minimal_removal(d, ["g"]).collect(), key=lambda r: (r.g, r.k)):
        steps.setdefault(r.g, []).append(r)
    assert set(steps) == set(range(6))
    for g, taken in steps.items():
        xy = np.array([(a, b) for k, _, a, b in rows if k == g])
        left = np.delete(xy, [r.unit for r in taken], axis=0)
        assert taken[-1].rho_after == pytest.approx(corr(ranks(left[:, 0]), ranks(left[:, 1])))
        assert [r.reached for r in taken[:-1]] == [False] * (len(taken) - 1)
        if taken[-1].reached:
            assert want[g] <= len(taken) and (want[g] == 1) == (len(taken) == 1)


def test_groups_are_dealt_by_their_draws(spark, monkeypatch):
    d = spark.createDataFrame([("p", i, float(i * 7 % 40), float(i * 11 % 37)) for i in range(40)], "k string, unit long, x double, y double")
    few = {r.b: r.stat for r in rs.permutation_correlations(d, ["k"], 20)[1].collect()}
    # Adaptive execution does not merge the parts again, however small they are.
    assert rs.dealt(d, ["unit"], 5 * rs.DEALT).groupBy("unit").count().rdd.getNumPartitions() == 5
    monkeypatch.setattr(rs, "DEALT", 100)
    monkeypatch.setattr(rs, "CHUNK_ROWS", 2)
    many = {r.b: r.stat for r in rs.permutation_correlations(d, ["k"], 20)[1].collect()}
    assert len(many) == 20 and all(abs(many[b] - few[b]) < 1e-12 for b in few)
