"""Statistics against worked cases, small numpy recomputations and printed tables."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.stats import components as cp, dist, models as md, moments as mo, network as nw, reliability as rl, resample as rs, tests as ts


def test_distributions_against_printed_values():
    assert dist.t_sf2(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert dist.t_sf2(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert dist.f_sf(np.array([4.964602744]), np.array([1.0]), np.array([10.0]))[0] == pytest.approx(0.05, abs=1e-8)
    assert dist.gammaincc(np.array([0.5, 5.0]), np.array([3.841458821 / 2, 18.307038053 / 2])) == pytest.approx([0.05, 0.05], abs=1e-8)
    assert dist.norm_cdf(1.959963985) == pytest.approx(0.975, abs=1e-9)
    assert dist.norm_ppf(np.array([0.975]))[0] == pytest.approx(1.959963985, abs=1e-8)
    assert dist.t_ppf(np.array([0.975]), np.array([10.0]))[0] == pytest.approx(2.228138852, abs=1e-7)


def test_pearson_constant_and_spearman_ties(spark):
    d = spark.createDataFrame([(1, 2.0, float(i)) for i in range(4)], "k int, x double, y double")
    assert mo.pearson_by(d, ["k"], "x", "y").first().r is None
    d = spark.createDataFrame(list(zip([1] * 5, [1.0, 2.0, 2.0, 3.0, 5.0], [2.0, 1.0, 4.0, 3.0, 5.0])), "k int, x double, y double")
    assert mo.spearman_by(d, ["k"], "x", "y").first().rho == pytest.approx(0.666886, abs=1e-6)


def test_fdr(spark):
    d = spark.createDataFrame([(1, i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005])] + [(1, 9, None)], "f int, i int, p double")
    got = {r.i: r.p_fdr for r in rs.bh_fdr(d, ["f"]).collect()}
    assert [got[i] for i in range(4)] == pytest.approx([0.02, 0.04, 0.04, 0.02]) and got[9] is None


MATRIX = [(1, 2, 2), (2, 3, 3), (3, 3, 5), (4, 5, 5)]


def long_matrix(spark):
    rows = [(f"p{i}", "D", f"q{j}", float(v)) for i, r in enumerate(MATRIX) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "participant string, dimension string, item string, score double")


def test_alpha_icc(spark):
    d = long_matrix(spark)
    assert rl.cronbach_alpha(d).first().alpha == pytest.approx(0.95)
    r = rl.icc(d, [], "participant", "item", "score").first()
    assert (r.icc2k, r.icc21, r.icc1) == pytest.approx((0.890625, 0.730769, 0.716216), abs=1e-6)


def test_item_statistics_against_numpy(spark):
    m = np.array(MATRIX, float)
    got = {r.item: r for r in rl.item_statistics(long_matrix(spark)).collect()}
    for j in range(3):
        rest = np.delete(m, j, axis=1)
        assert got[f"q{j}"].r_drop == pytest.approx(np.corrcoef(m[:, j], rest.sum(1))[0, 1])
        a = 2 * (1 - rest.var(0, ddof=1).sum() / rest.sum(1).var(ddof=1))
        assert got[f"q{j}"].alpha_if_deleted == pytest.approx(a)


def test_rwg(spark):
    rows = [("g", f"r{k}", f"i{j}", float(v)) for j, vs in enumerate([(7, 8, 7), (6, 6, 7)]) for k, v in enumerate(vs)]
    d = spark.createDataFrame(rows, "g string, rater string, item string, v double")
    assert rl.rwg_j(d, ["g"], "rater", "item", "v").first().rwg_j == pytest.approx(0.974359, abs=1e-6)


def average_ranks(x):
    return pd.Series(x).rank().to_numpy()


def test_leave_one_out_equals_brute_force(spark):
    rnd = random.Random(5)
    x = [rnd.randrange(6) / 1.0 for _ in range(40)]
    y = [rnd.randrange(7) / 1.0 + xi / 3 for xi in x]
    d = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(zip(x, y))], "k int, unit int, x double, y double")
    got = {r.unit: r.stat for r in rs.leave_one_out_spearman(d, ["k"]).collect()}
    jk = {r.unit: r.stat for r in rs.jackknife(d, ["k"]).collect()}
    for u in range(40):
        a, b = np.delete(x, u), np.delete(y, u)
        assert got[u] == pytest.approx(np.corrcoef(average_ranks(a), average_ranks(b))[0, 1])
        assert jk[u] == pytest.approx(np.corrcoef(a, b)[0, 1])


@pytest.mark.parametrize("order", [1, -1])
def test_leave_one_out_names_the_smallest_of_equal_units(spark, order):
    x, y = [1, 2, 3, 4, 5, 9], [2, 1, 3, 5, 4, 0]
    rows = [(i + 100 * copy, float(a), float(b)) for copy in range(4) for i, (a, b) in enumerate(zip(x, y))]
    d = spark.createDataFrame(rows[::order], "unit int, x double, y double")
    assert rs.leave_one_out_range(d, []).first().loo_unit == 5


def test_bootstrap_is_reproducible_and_brackets(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    y = x + rng.normal(size=60)
    d = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k int, unit int, x double, y double")
    a = rs.bootstrap_correlations(d, ["k"], 40).orderBy("b").collect()
    b = rs.bootstrap_correlations(d.repartition(7), ["k"], 40).orderBy("b").collect()
    assert [r.stat for r in a] == pytest.approx([r.stat for r in b])
    ci = rs.percentile_ci(rs.bootstrap_correlations(d, ["k"], 40), ["k"]).first()
    assert ci.ci_low < np.corrcoef(average_ranks(x), average_ranks(y))[0, 1] < ci.ci_high
    assert rs.permutation_p(d, ["k"], 39).first().p_perm == pytest.approx(1 / 40)


def frame(spark, n=50):
    rng = np.random.default_rng(3)
    x1, x2 = rng.normal(size=n), rng.normal(size=n) * 2 + 10
    y = 4 + 2 * x1 - 0.5 * x2 + rng.normal(size=n)
    pdf = pd.DataFrame({"u": range(n), "x1": x1, "x2": x2, "y": y, "g": [f"g{i % 4}" for i in range(n)]})
    return pdf, spark.createDataFrame(pdf)


def test_ols_against_numpy(spark):
    pdf, d = frame(spark)
    X = np.column_stack([np.ones(50), pdf.x1, pdf.x2])
    beta, *_ = np.linalg.lstsq(X, pdf.y, rcond=None)
    res = pdf.y - X @ beta
    s2 = (res**2).sum() / 47
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * s2)
    f = {r.term: r for r in md.ols(d, "y", ["x1", "x2"]).collect()}
    assert [f[t].beta for t in ("const", "x1", "x2")] == pytest.approx(beta)
    assert [f[t].se for t in ("const", "x1", "x2")] == pytest.approx(se)
    assert f["x1"].r2 == pytest.approx(1 - (res**2).sum() / ((pdf.y - pdf.y.mean()) ** 2).sum())
    meat = sum(np.outer(v, v) for v in ((X[pdf.g == g] * res[pdf.g == g].to_numpy()[:, None]).sum(0) for g in sorted(set(pdf.g))))
    inv = np.linalg.inv(X.T @ X)
    v = inv @ meat @ inv * (4 / 3) * (49 / 47)
    cr = {r.term: r.se_cluster for r in md.cluster_robust(d, "y", ["x1", "x2"], "g").collect()}
    assert [cr[t] for t in ("const", "x1", "x2")] == pytest.approx(np.sqrt(np.diag(v)))


def test_kfold_equals_direct_fit(spark):
    pdf, d = frame(spark)
    r = md.repeated_kfold(d, "u", "y", ["x1", "x2"], 5, 1)
    fold = {x.u: x.f for x in d.select("u", F.pmod(F.xxhash64(F.lit(42), F.lit(0), F.col("u")), F.lit(5)).alias("f")).collect()}
    f = pdf.u.map(fold)
    sse = 0.0
    for k in sorted(set(f)):
        tr, te = pdf[f != k], pdf[f == k]
        X = lambda q: np.column_stack([np.ones(len(q)), q.x1, q.x2])
        b, *_ = np.linalg.lstsq(X(tr), tr.y, rcond=None)
        sse += ((te.y - X(te) @ b) ** 2).sum()
    assert r.first().cv_rmse_mean == pytest.approx(math.sqrt(sse / 50))


def test_pca_against_numpy(spark):
    pdf, d = frame(spark)
    c = np.corrcoef(pdf[["x1", "x2", "y"]].T)
    w = np.sort(np.linalg.eigvalsh(c))[::-1]
    fit = cp.pca_fit(d, ["x1", "x2", "y"], 3)
    got = [r.eigenvalue for r in fit.select("component", "eigenvalue").distinct().orderBy("component").collect()]
    assert sorted({round(x, 9) for x in got}, reverse=True) == pytest.approx(w)
    s = cp.pca_scores(d, fit, ["x1", "x2", "y"], 1).toPandas()
    assert s.PC1.var(ddof=0) == pytest.approx(w[0])


def test_anova_two_factor_balanced(spark):
    rows = [(a, b, v) for (a, b), vs in {("p", "s"): (3, 4), ("p", "t"): (6, 7), ("q", "s"): (4, 6), ("q", "t"): (9, 12)}.items() for v in vs]
    d = spark.createDataFrame([(a, b, float(v)) for a, b, v in rows], "a string, b string, y double")
    got = {r.term: r for r in md.two_factor_anova(d, "y", "a", "b", ["p", "q"], ["s", "t"]).collect()}
    y = np.array([r[2] for r in rows], float)
    m = lambda f: np.mean([v for v, r in zip(y, rows) if f(r)])
    g = y.mean()
    ssa = sum(4 * (m(lambda r, l=l: r[0] == l) - g) ** 2 for l in "pq")
    ssb = sum(4 * (m(lambda r, l=l: r[1] == l) - g) ** 2 for l in "st")
    cells = sum(2 * (m(lambda r, l=l, k=k: r[0] == l and r[1] == k) - g) ** 2 for l in "pq" for k in "st")
    assert got["a"].ss == pytest.approx(ssa) and got["b"].ss == pytest.approx(ssb) and got["a:b"].ss == pytest.approx(cells - ssa - ssb)


def test_prune_correlated_equals_sequential(spark):
    rnd = random.Random(11)
    fs = [f"f{i:02d}" for i in range(14)]
    edges = [(a, b, round(rnd.uniform(-1, 1), 2)) for a, b in itertools.combinations(fs, 2)]
    info = {f: (rnd.randrange(3), rnd.randrange(5)) for f in fs}
    key = lambda f: (info[f][0], info[f][1], len(f), f)
    out = set()
    for a, b, r in sorted((e for e in edges if abs(e[2]) > 0.5), key=lambda e: (-abs(e[2]), e[0], e[1])):
        if a not in out and b not in out:
            out.add(max(a, b, key=key))
    e = spark.createDataFrame(edges, "x string, y string, r double")
    f = spark.createDataFrame([(k, *v) for k, v in info.items()], "feature string, n_missing int, priority int")
    got = {r.feature for r in cp.prune_correlated(e, f, 0.5).where("not kept").collect()}
    assert got == out


def test_network(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", -0.5), ("a", "c", 0.6), ("x", "y", 0.7)], "x string, y string, rho double")
    assert {r.node: r.component for r in nw.connected_components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert {r.node: r.hops for r in nw.hop_distance(e, "a").collect()} == {"a": 0, "b": 1, "c": 1}
    c = {r.node: r.clustering for r in nw.clustering_coefficient(e).collect()}
    assert c["a"] == pytest.approx((1 * 0.5 / 0.9 * 0.6 / 0.9) ** (1 / 3)) and c["x"] == 0.0
    v = {r.node: r.eigenvector for r in nw.eigenvector_centrality(e.where("x != 'x'"), 200).collect()}
    m = np.array([[0, 0.9, 0.6], [0.9, 0, 0.5], [0.6, 0.5, 0]])
    w, q = np.linalg.eigh(m)
    assert [v[n] for n in "abc"] == pytest.approx(np.abs(q[:, -1]), abs=1e-6)


def test_mann_whitney_against_pairs(spark):
    a, b = [1.0, 3.0, 3.0, 8.0], [2.0, 3.0, 5.0]
    d = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, v double")
    r = ts.mann_whitney(d, [], "g", "v", "a", "b").first()
    assert r.u == sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_distributions_hold_for_large_shapes():
    """At its mean the upper tail of a chi-square stays close to one half, and the expansions agree where they meet."""
    import numpy as np

    from colloquy.stats import dist

    for df in (1e4, 1e6, 1e7, 1e8, 1e12):
        assert dist.gammaincc(df / 2, df / 2).item() == pytest.approx(0.5 - 1 / (3 * math.sqrt(math.pi * df)), abs=2e-6)
    a, z = 1.2e5, np.array([-3.0, -0.5, 0.0, 0.1, 2.0, 5.0])
    x = a + z * math.sqrt(a)
    large = dist.gammaincc(np.full(6, a), x)
    dist_small, dist.LARGE_SHAPE = dist.LARGE_SHAPE, 1e9
    try:
        assert dist.gammaincc(np.full(6, a), x) == pytest.approx(large, abs=1e-7)
    finally:
        dist.LARGE_SHAPE = dist_small
    assert dist.betainc(np.array([5e5]), np.array([5e5]), np.array([0.5])).item() == pytest.approx(0.5, abs=1e-9)


def test_shares_of_few_groups_do_not_move_the_rows(spark):
    from colloquy.operators import aggregates as ag

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = ag.share_of_total(spark.range(1000).selectExpr("id", "id % 3 g", "cast(id as double) v"), "v", ["g"])
        assert "Exchange hashpartitioning" not in d._jdf.queryExecution().executedPlan().toString()
        total = [sum(range(g, 1000, 3)) for g in range(3)]
        assert all(r.share == r.id / total[r.g] for r in d.collect()) and d.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
