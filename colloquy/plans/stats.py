"""Statistics queries on supplier features and questionnaire answers."""

from pyspark.sql import functions as F

from colloquy.functions import scalars as fn
from colloquy.operators import aggregates as ag
from colloquy.plans import draws as dw, eigen, query
from colloquy.plans import tables as t
from colloquy.plans.gaze import plus_zero, rnd
from colloquy.session import cut
from colloquy.stats import components as cp, models as md, moments as mo, network as nw, reliability as rl, resample as rs, synthesis as sy, tests as ts

NUM = ["quantity", "price", "discount", "tax", "rebate", "lines"]
FULL = ["quantity", "price", "discount", "tax", "lines"]
PAIRS = mo.combinations(NUM)


def pairs(spark, sf, cols=NUM):
    return mo.pair_rows(t.features(spark, sf), ["unit_id"], mo.combinations(cols)).withColumnRenamed("unit_id", "unit")


def _pair_sql(cols):
    return "pr AS (" + " UNION ALL ".join(
        f"SELECT unit_id, '{a}' x, '{b}' y, {a}::DOUBLE vx, {b}::DOUBLE vy FROM feat" for a, b in mo.combinations(cols)
    ) + ")"


PR = _pair_sql(NUM)
RK = """cc AS (SELECT * FROM pr WHERE vx IS NOT NULL AND vy IS NOT NULL),
rk AS (SELECT x, y, unit_id, rank() OVER (PARTITION BY x, y ORDER BY vx) + (count(*) OVER (PARTITION BY x, y, vx) - 1) / 2.0 rx, rank() OVER (PARTITION BY x, y ORDER BY vy) + (count(*) OVER (PARTITION BY x, y, vy) - 1) / 2.0 ry FROM cc),
sp AS (SELECT x, y, count(*) n, corr(rx::DOUBLE, ry::DOUBLE) rho FROM rk GROUP BY ALL)"""
# Two-sided p of t with integer degrees of freedom, as a finite sum.
TP = """CASE WHEN (n - 2) % 2 = 0
 THEN 1 - sin(th) * list_sum(list_transform(range(0, ((n - 2) // 2)::BIGINT), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow(cos(th), 2 * j)))
 ELSE 1 - 2 / pi() * (th + CASE WHEN n - 2 > 1 THEN sin(th) * cos(th) * list_sum(list_transform(range(0, ((n - 3) // 2)::BIGINT), lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow(cos(th), 2 * j))) ELSE 0 END) END"""
PV = f"pv AS (SELECT *, {TP} AS p FROM (SELECT *, atan(abs(rho) * sqrt((n - 2) / (1 - rho * rho)) / sqrt(n - 2)) th FROM sp))"
FDR = """fd AS (SELECT *, least(1, min(p * m / k) OVER (PARTITION BY y ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) p_fdr FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY p) k, count(*) OVER (PARTITION BY y) m FROM pv))"""


@query("p01_pearson", t.with_(t.FEAT, PR) + "SELECT x, y, count(*) FILTER (vx IS NOT NULL AND vy IS NOT NULL) n, round(corr(vx, vy), 6) r FROM pr GROUP BY ALL")
def _(spark, sf):
    return rnd(mo.pearson_by(pairs(spark, sf), ["x", "y"], "vx", "vy"), "r")


@query("p02_spearman", t.with_(t.FEAT, PR, RK) + "SELECT x, y, n, round(rho, 6) rho FROM sp")
def _(spark, sf):
    return rnd(mo.spearman_by(pairs(spark, sf), ["x", "y"], "vx", "vy"), "rho")


@query("p03_correlation_matrix", t.with_(t.FEAT, PR) + "SELECT x, y, count(*) FILTER (vx IS NOT NULL AND vy IS NOT NULL) n, round(corr(vx, vy), 6) r FROM pr GROUP BY ALL")
def _(spark, sf):
    return rnd(mo.correlation_matrix(t.features(spark, sf), NUM), "r")


@query("p04_correlation_p", t.with_(t.FEAT, PR, RK, PV) + "SELECT x, y, n, round(p, 6) p FROM pv")
def _(spark, sf):
    s = mo.spearman_by(pairs(spark, sf), ["x", "y"], "vx", "vy")
    return rnd(s.select("x", "y", "n", rs.correlation_p(F.col("rho"), F.col("n")).alias("p")), "p")


@query("p05_bh_fdr", t.with_(t.FEAT, PR, RK, PV, FDR) + "SELECT x, y, round(p, 6) p, round(p_fdr, 6) p_fdr FROM fd")
def _(spark, sf):
    s = mo.spearman_by(pairs(spark, sf), ["x", "y"], "vx", "vy")
    s = cut(s.select("x", "y", rs.correlation_p(F.col("rho"), F.col("n")).alias("p")))
    return rnd(rs.bh_fdr(s, ["y"]), "p", "p_fdr")


@query("p12_correlation_table", t.with_(t.FEAT, PR, RK, PV, FDR) + """SELECT x, y, n, round(rho, 6) rho, round(p, 6) p, round(p_fdr, 6) p_fdr, CASE WHEN p_fdr < 0.001 THEN '***' WHEN p_fdr < 0.01 THEN '**' WHEN p_fdr < 0.05 THEN '*' ELSE '' END stars, abs(rho) > 0.95 AND n < 10 artefact_suspect FROM fd""")
def _(spark, sf):
    return rnd(rs.correlation_table(pairs(spark, sf)), "rho", "p", "p_fdr")


def two(spark, sf):
    f = t.features(spark, sf)
    return f.select(F.col("unit_id").alias("unit"), F.col("price").alias("x"), F.col("rebate").alias("y"))


PRICE_REBATE = "d AS (SELECT 0 k, unit_id unit, price x, rebate y FROM feat WHERE rebate IS NOT NULL)"


@query("p06_bootstrap_ci", t.with_(t.FEAT, PRICE_REBATE, dw.replicates(2000), dw.counted("d"), dw.SPEARMAN, dw.INTERVAL) + "SELECT round(ci_low, 6) ci_low, round(ci_high, 6) ci_high FROM ci")
def _(spark, sf):
    return rnd(rs.percentile_ci(cut(rs.bootstrap_correlations(two(spark, sf), [], 2000)), []), "ci_low", "ci_high")


@query("p06_bootstrap_replicates", t.with_(t.FEAT, PRICE_REBATE, dw.replicates(200), dw.counted("d")) + """, m AS (SELECT b, sum(w) n, sum(w * x) / sum(w) mx, sum(w * y) / sum(w) my FROM dr GROUP BY ALL)
SELECT b::INT b, round(sum(w * (x - mx) * (y - my)) / sqrt(sum(w * (x - mx) ** 2)) / sqrt(sum(w * (y - my) ** 2)), 6) stat FROM dr JOIN m USING (b) GROUP BY ALL""")
def _(spark, sf):
    return rnd(rs.bootstrap_correlations(two(spark, sf), [], 200, "pearson"), "stat")


# The bias correction is found by halving the interval that holds the normal quantile.
BCA = f"""m AS (SELECT b, sum(w * x) / sum(w) mx, sum(w * y) / sum(w) my FROM dr GROUP BY ALL),
st AS (SELECT b, sum(w * (x - mx) * (y - my)) / sqrt(sum(w * (x - mx) ** 2)) / sqrt(sum(w * (y - my) ** 2)) stat FROM dr JOIN m USING (b) GROUP BY ALL),
th AS (SELECT corr(x, y) theta FROM d), jk AS (SELECT u.unit, corr(d.x, d.y) stat FROM d u JOIN d ON u.unit <> d.unit GROUP BY ALL),
ac AS (SELECT sum((m - stat) ** 3) / (6 * pow(sum((m - stat) ** 2), 1.5)) acc FROM jk, (SELECT avg(stat) m FROM jk)),
bl AS (SELECT avg((stat < theta)::INT::DOUBLE) below, count(*) nb FROM st, th),
bs AS (SELECT greatest(least(below, 1 - 0.5 / nb), 0.5 / nb) p, -8.0::DOUBLE lo, 8.0::DOUBLE hi, 0 s FROM bl
 UNION ALL SELECT p, CASE WHEN f < p THEN mid ELSE lo END, CASE WHEN f < p THEN hi ELSE mid END, s + 1 FROM (SELECT *, (lo + hi) / 2 mid, {dw.phi('mid')} f FROM bs WHERE s < 55)),
z AS (SELECT (lo + hi) / 2 z0 FROM bs WHERE s = 55), ad AS (SELECT z0 + (z0 - 1.959963984540054) / (1 - acc * (z0 - 1.959963984540054)) zl, z0 + (z0 + 1.959963984540054) / (1 - acc * (z0 + 1.959963984540054)) zh FROM z, ac),
pq AS (SELECT {dw.phi('zl')} pl, {dw.phi('zh')} ph FROM ad), so AS (SELECT stat, row_number() OVER (ORDER BY stat) r, count(*) OVER () nb FROM st)"""


@query("p07_bca_ci", t.with_(t.FEAT, PRICE_REBATE, dw.replicates(2000), dw.counted("d"), BCA).replace("WITH", "WITH RECURSIVE", 1) + """SELECT round((SELECT theta FROM th), 6) theta, round(min(stat) FILTER (r >= pl * (nb - 1) + 1e-9), 6) ci_low, round(min(stat) FILTER (r >= ph * (nb - 1) + 1e-9), 6) ci_high FROM so, pq""")
def _(spark, sf):
    return rnd(rs.bca_ci(two(spark, sf), [], 2000), "theta", "ci_low", "ci_high")


@query("p08_permutation_p", t.with_(t.FEAT, PRICE_REBATE, dw.replicates(1000), dw.permuted()).replace("WITH", "WITH RECURSIVE", 1) + "SELECT round(rho, 6) rho, round(p_perm, 6) p_perm FROM pp")
def _(spark, sf):
    return rnd(rs.permutation_p(two(spark, sf), [], 1000), "rho", "p_perm")


@query("p08_permutation_replicates", t.with_(t.FEAT, PRICE_REBATE, dw.replicates(100), dw.permuted()).replace("WITH", "WITH RECURSIVE", 1) + "SELECT b::INT b, round(stat, 6) stat FROM ps")
def _(spark, sf):
    return rnd(rs.permutation_correlations(two(spark, sf), [], 100)[1], "stat")


def metrics(replicates, *source):
    """CTEs up to mt: correlation metrics of d (k, unit, x, y)."""
    parts = [*source, dw.replicates(replicates), dw.counted("d"), dw.SPEARMAN, dw.INTERVAL, dw.permuted(), dw.LEAVE_ONE_OUT,
             f"pv AS (SELECT *, {TP} AS p FROM (SELECT *, atan(abs(rho) * sqrt((n - 2) / (1 - rho * rho)) / sqrt(n - 2)) th FROM ob))",
             "mt AS (SELECT k, n, pv.rho, p, ci_low, ci_high, p_perm, loo_min, loo_max, loo_unit FROM pv JOIN ci USING (k) JOIN pp USING (k) JOIN (SELECT k, min(stat) loo_min, max(stat) loo_max, arg_max(unit, abs(stat)) loo_unit FROM lo GROUP BY ALL) USING (k))"]
    return t.with_(*parts).replace("WITH", "WITH RECURSIVE", 1)


METRICS = "n, round(rho, 6) rho, round(p, 6) p, round(ci_low, 6) ci_low, round(ci_high, 6) ci_high, round(p_perm, 6) p_perm, round(loo_min, 6) loo_min, round(loo_max, 6) loo_max, loo_unit"
METRIC_COLS = ("rho", "p", "ci_low", "ci_high", "p_perm", "loo_min", "loo_max")


@query("p09_correlation_metrics", metrics(2000, t.FEAT, PRICE_REBATE) + f"SELECT {METRICS} FROM mt")
def _(spark, sf):
    return rnd(rs.correlation_metrics(two(spark, sf), [], 2000), *METRIC_COLS)


@query("p10_jackknife_pearson", t.with_(t.FEAT) + """, d AS (SELECT unit_id, price x, rebate y FROM feat WHERE rebate IS NOT NULL)
SELECT u.unit_id unit, round(corr(d.x, d.y), 6) stat FROM d u JOIN d ON u.unit_id <> d.unit_id GROUP BY ALL""")
def _(spark, sf):
    return rnd(rs.jackknife(two(spark, sf), []), "stat")


# Rounded values have ties on both sides.
LOO = """d AS (SELECT unit_id, round(price / 5000) x, round(quantity) y FROM feat), j AS (SELECT u.unit_id unit, d.x, d.y FROM d u JOIN d ON u.unit_id <> d.unit_id),
r AS (SELECT unit, rank() OVER (PARTITION BY unit ORDER BY x) + (count(*) OVER (PARTITION BY unit, x) - 1) / 2.0 rx, rank() OVER (PARTITION BY unit ORDER BY y) + (count(*) OVER (PARTITION BY unit, y) - 1) / 2.0 ry FROM j),
lo AS (SELECT unit, corr(rx::DOUBLE, ry::DOUBLE) stat FROM r GROUP BY ALL)"""


def tied(spark, sf):
    f = t.features(spark, sf)
    return f.select(F.col("unit_id").alias("unit"), F.round(F.col("price") / 5000).alias("x"), F.round("quantity").alias("y"))


@query("p10_leave_one_out", t.with_(t.FEAT, LOO) + "SELECT unit, round(stat, 6) stat FROM lo")
def _(spark, sf):
    return rnd(rs.leave_one_out_spearman(tied(spark, sf), []), "stat")


@query("p10_leave_one_out_range", t.with_(t.FEAT, LOO) + "SELECT round(min(stat), 6) loo_min, round(max(stat), 6) loo_max FROM lo")
def _(spark, sf):
    return rnd(rs.leave_one_out_range(tied(spark, sf), []).select("loo_min", "loo_max"), "loo_min", "loo_max")


# One step removes the unit without which the correlation is lowest.
def removal_step(i, threshold=0.72):
    src = "d" if i == 1 else f"d{i}"
    left = "" if i == 1 else f"d{i} AS (SELECT * FROM {'d' if i == 2 else f'd{i - 1}'} WHERE unit NOT IN (SELECT unit FROM s{i - 1}) AND NOT (SELECT bool_or(reached) FROM s{i - 1})), "
    return left + f"""j{i} AS (SELECT u.unit, v.x, v.y FROM {src} u JOIN {src} v ON u.unit <> v.unit),
r{i} AS (SELECT unit, rank() OVER (PARTITION BY unit ORDER BY x) + (count(*) OVER (PARTITION BY unit, x) - 1) / 2.0 rx, rank() OVER (PARTITION BY unit ORDER BY y) + (count(*) OVER (PARTITION BY unit, y) - 1) / 2.0 ry FROM j{i}),
s{i} AS (SELECT {i} k, unit, stat rho_after, stat < {threshold} reached FROM (SELECT unit, corr(rx::DOUBLE, ry::DOUBLE) stat FROM r{i} GROUP BY ALL) ORDER BY stat, unit LIMIT 1)"""


@query("p11_minimal_removal", t.with_(t.FEAT, PRICE_REBATE, *[removal_step(i) for i in range(1, 5)]) + " UNION ALL ".join(f"SELECT k, unit, round(rho_after, 6) rho_after, reached FROM s{i}" for i in range(1, 5)))
def _(spark, sf):
    return rnd(rs.minimal_removal(two(spark, sf), [], 0.72), "rho_after")


ALPHA = """it AS (SELECT dimension, item, var_samp(score) v, count(*) n, avg(score) m, stddev_samp(score) s FROM resp GROUP BY ALL), tt AS (SELECT dimension, participant, sum(score) t FROM resp GROUP BY ALL),
al AS (SELECT dimension, k n_items, n, k / (k - 1.0) * (1 - sv / tv) alpha FROM (SELECT dimension, count(*)::DOUBLE k, sum(v) sv FROM it GROUP BY ALL) JOIN (SELECT dimension, var_samp(t) tv, count(*) n FROM tt GROUP BY ALL) USING (dimension))"""


@query("p13_cronbach_alpha", t.with_(t.RESP, ALPHA) + "SELECT dimension, n_items::BIGINT n_items, n, round(alpha, 6) alpha FROM al")
def _(spark, sf):
    return rnd(rl.cronbach_alpha(t.responses(spark, sf)), "alpha")


LW = """fu AS (SELECT dimension, participant FROM (SELECT dimension, participant, count(*) c FROM resp GROUP BY ALL) JOIN (SELECT dimension, count(DISTINCT item) k FROM resp GROUP BY ALL) USING (dimension) WHERE c = k), lw AS (SELECT resp.* FROM resp JOIN fu USING (dimension, participant))"""


@query("p13_cronbach_alpha_listwise", t.with_(t.RESP, LW) + """, i AS (SELECT dimension, item, var_samp(score) v FROM lw GROUP BY ALL), t AS (SELECT dimension, participant, sum(score) t FROM lw GROUP BY ALL)
SELECT dimension, k::BIGINT n_items, n, round(k / (k - 1.0) * (1 - sv / tv), 6) alpha FROM (SELECT dimension, count(*)::DOUBLE k, sum(v) sv FROM i GROUP BY ALL) JOIN (SELECT dimension, var_samp(t) tv, count(*) n FROM t GROUP BY ALL) USING (dimension)""")
def _(spark, sf):
    return rnd(rl.cronbach_alpha(t.responses(spark, sf), na="listwise"), "alpha")


@query("p13_standardised_alpha", t.with_(t.RESP, LW) + """, z AS (SELECT dimension, participant, item, (score - avg(score) OVER w) / stddev_samp(score) OVER w z FROM lw WINDOW w AS (PARTITION BY dimension, item)), t AS (SELECT dimension, participant, sum(z) t FROM z GROUP BY ALL)
SELECT dimension, any_value(k)::BIGINT n_items, count(*) n, round(any_value(k) / (any_value(k) - 1.0) * (1 - any_value(k) / var_samp(t)), 6) alpha_std FROM t JOIN (SELECT dimension, count(DISTINCT item)::DOUBLE k FROM lw GROUP BY ALL) USING (dimension) GROUP BY dimension""")
def _(spark, sf):
    return rnd(rl.standardised_alpha(t.responses(spark, sf)), "alpha_std")


ITEMS = """ra AS (SELECT dimension, item, corr(score, t - score) r FROM resp JOIN tt USING (dimension, participant) GROUP BY ALL),
rv AS (SELECT it.dimension, it.item, var_samp(tt.t - coalesce(r.score, 0)) v FROM it JOIN tt USING (dimension) LEFT JOIN resp r ON r.dimension = it.dimension AND r.item = it.item AND r.participant = tt.participant GROUP BY ALL),
st AS (SELECT dimension, item, it.n, m, s, r, (k - 1) / (k - 2.0) * (1 - (sv - it.v) / rv.v) ad FROM it JOIN ra USING (dimension, item) JOIN rv USING (dimension, item) JOIN (SELECT dimension, count(*)::DOUBLE k, sum(v) sv FROM it GROUP BY ALL) USING (dimension))"""


@query("p14_item_statistics", t.with_(t.RESP, ALPHA, ITEMS) + "SELECT dimension, item, n, round(m, 6) mean, round(s, 6) sd, round(r, 6) r_drop, round(ad, 6) alpha_if_deleted FROM st")
def _(spark, sf):
    return rnd(rl.item_statistics(t.responses(spark, sf)), "mean", "sd", "r_drop", "alpha_if_deleted")


@query("p15_prune_by_rdrop", t.with_(t.RESP, ALPHA, ITEMS) + """, b AS (SELECT *, count(*) OVER (PARTITION BY dimension) k, sum(CASE WHEN r IS NULL OR r < 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY dimension) nb FROM st)
SELECT dimension, item, round(r, 6) r_drop, round(alpha, 6) alpha, NOT (alpha >= 0.7 OR k - nb < 2) AS "drop", CASE WHEN alpha >= 0.7 THEN 'alpha acceptable' WHEN k - nb < 2 THEN 'too few items left' END kept_because FROM b JOIN al USING (dimension) WHERE r IS NULL OR r < 0.3""")
def _(spark, sf):
    return rnd(rl.prune_by_rdrop(t.responses(spark, sf)), "r_drop", "alpha")


@query("p16_prune_items_greedy")
def _(spark, sf):
    return rl.prune_greedy(t.responses(spark, sf))


def icc_sql(*keys):
    """CTEs up to ic: two-way layout of participants and items per key, participants with every item of the key only."""
    k = ", ".join(keys)
    return f"""it AS (SELECT {k}, count(DISTINCT item) ni FROM resp GROUP BY ALL), fl AS (SELECT {k}, participant FROM resp JOIN it USING ({k}) GROUP BY {k}, participant, ni HAVING count(*) = ni), c AS (SELECT resp.*, score x FROM resp SEMI JOIN fl USING ({k}, participant)),
q AS (SELECT {k}, count(DISTINCT participant)::DOUBLE n, count(DISTINCT item)::DOUBLE k, avg(x) g, sum(x * x) - sum(x) * sum(x) / count(*) st FROM c GROUP BY ALL),
ta AS (SELECT {k}, sum(pow(m - g, 2)) a FROM (SELECT {k}, participant, avg(x) m FROM c GROUP BY ALL) JOIN q USING ({k}) GROUP BY ALL), ra AS (SELECT {k}, sum(pow(m - g, 2)) b FROM (SELECT {k}, item, avg(x) m FROM c GROUP BY ALL) JOIN q USING ({k}) GROUP BY ALL),
ms AS (SELECT {k}, n, k, st, k * a sst, n * b ssr FROM q JOIN ta USING ({k}) JOIN ra USING ({k}) WHERE n >= 2 AND k >= 2),
mm AS (SELECT {k}, n, k, sst / (n - 1) mst, ssr / (k - 1) msr, (st - sst - ssr) / ((n - 1) * (k - 1)) mse, (st - sst) / (n * (k - 1)) msw FROM ms),
ic AS (SELECT {k}, n::BIGINT n, k::BIGINT k, round(CASE WHEN abs(mst + (k - 1) * msw) >= 1e-12 THEN (mst - msw) / (mst + (k - 1) * msw) END, 6) + 0.0 icc1,
 round(CASE WHEN abs(mst + (k - 1) * mse + k * (msr - mse) / n) >= 1e-12 THEN (mst - mse) / (mst + (k - 1) * mse + k * (msr - mse) / n) END, 6) + 0.0 icc21, round(CASE WHEN abs(mst + (msr - mse) / n) >= 1e-12 THEN (mst - mse) / (mst + (msr - mse) / n) END, 6) + 0.0 icc2k FROM mm)"""


@query("p17_icc", t.with_(t.RESP, icc_sql("dimension")) + "SELECT * FROM ic")
def _(spark, sf):
    return plus_zero(rnd(rl.icc(t.responses(spark, sf), ["dimension"], "participant", "item", "score"), "icc1", "icc21", "icc2k"), "icc1", "icc21", "icc2k")


@query("p62_agreement_from_survey", t.with_(t.RESP, icc_sql("dimension", "group_id")) + "SELECT * FROM ic")
def _(spark, sf):
    return plus_zero(rnd(rl.icc(t.responses(spark, sf), ["dimension", "group_id"], "participant", "item", "score"), "icc1", "icc21", "icc2k"), "icc1", "icc21", "icc2k")


@query("p17_variance_components", t.with_(t.RESP) + """, g AS (SELECT dimension, group_id, count(*) n, avg(score) m, var_pop(score) v FROM resp GROUP BY ALL), a AS (SELECT dimension, avg(score) g FROM resp GROUP BY ALL),
s AS (SELECT dimension, sum(n)::DOUBLE n, count(*)::DOUBLE k, sum(n * n)::DOUBLE n2, sum(n * pow(m - g, 2)) b, sum(n * v) w FROM g JOIN a USING (dimension) GROUP BY ALL), m AS (SELECT *, b / (k - 1) msb, w / (n - k) msw, (n - n2 / n) / (k - 1) n0 FROM s)
SELECT dimension, n::BIGINT n, k::BIGINT n_groups, round(msb, 6) ms_between, round(msw, 6) ms_within, round(n0, 6) n0, round(greatest((msb - msw) / n0, 0), 6) var_between, round(msw, 6) var_within, round(greatest((msb - msw) / n0, 0) / (greatest((msb - msw) / n0, 0) + msw), 6) icc1 FROM m""")
def _(spark, sf):
    o = rl.variance_components(t.responses(spark, sf), "group_id", "score", ["dimension"])
    return rnd(o, "ms_between", "ms_within", "n0", "var_between", "var_within", "icc1")


RWG = """c AS (SELECT group_id, dimension, item, participant r, avg(score) x FROM resp GROUP BY ALL), nr AS (SELECT group_id, dimension, count(DISTINCT r) nr FROM c GROUP BY ALL),
v AS (SELECT group_id, dimension, item, var_samp(x) v, count(*) k FROM c GROUP BY ALL), w AS (SELECT v.*, nr FROM v JOIN nr USING (group_id, dimension) WHERE k = nr),
g AS (SELECT group_id, dimension, any_value(nr) n_raters, count(*) n_items, avg(v) / (80 / 12.0::DOUBLE) q FROM w GROUP BY ALL),
sr AS (SELECT group_id, dimension, max(s) - min(s) score_range, stddev_samp(s) score_sd FROM (SELECT group_id, dimension, r, avg(x) s FROM c SEMI JOIN w USING (group_id, dimension, item) GROUP BY ALL) GROUP BY ALL),
rw AS (SELECT g.*, CASE WHEN n_raters >= 2 THEN least(1, greatest(0, n_items * (1 - q) / (n_items * (1 - q) + q))) END rwg_j, score_range, score_sd FROM g JOIN sr USING (group_id, dimension))"""


def rwg(spark, sf):
    return rl.rwg_j(t.responses(spark, sf), ["group_id", "dimension"], "participant", "item", "score")


@query("p18_rwg_j", t.with_(t.RESP, RWG) + "SELECT group_id, dimension, n_raters, n_items, round(rwg_j, 6) rwg_j, round(score_range, 4) score_range, round(score_sd, 6) score_sd FROM rw")
def _(spark, sf):
    return rnd(rnd(rwg(spark, sf), "rwg_j", "score_sd"), "score_range", d=4)


@query("p18_agreement_summary", t.with_(t.RESP, RWG) + "SELECT count(rwg_j) n_units, sum((rwg_j >= 0.7)::INT)::BIGINT n_agree, round(avg(rwg_j), 6) rwg_mean, round(avg((rwg_j >= 0.7)::INT::DOUBLE), 6) share_agree FROM rw")
def _(spark, sf):
    return rnd(rl.agreement_summary(rwg(spark, sf)), "rwg_mean", "share_agree")


@query("p19_filter_by_agreement", t.with_(t.RESP, RWG) + "SELECT resp.participant, group_id, item, dimension, score FROM resp SEMI JOIN (SELECT * FROM rw WHERE rwg_j >= 0.7) USING (group_id, dimension)")
def _(spark, sf):
    return rl.filter_by_agreement(t.responses(spark, sf), rwg(spark, sf), ["group_id", "dimension"])


# ---- models -------------------------------------------------------------------------
REG = """rg AS (SELECT count(*) n, regr_slope(price, quantity) b, regr_intercept(price, quantity) a, regr_r2(price, quantity) r2, regr_syy(price, quantity) syy, regr_sxx(price, quantity) sxx FROM feat)"""


@query("p30_ols_simple", t.with_(t.FEAT, REG) + """, s AS (SELECT *, syy * (1 - r2) rss FROM rg)
SELECT 'quantity' term, n, round(b, 4) beta, round(sqrt(rss / (n - 2) / sxx), 4) se, round(r2, 6) r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) adj_r2, round(2 * 2 + n * (ln(2 * pi()) + ln(rss / n) + 1), 4) aic, round(2 * ln(n) + n * (ln(2 * pi()) + ln(rss / n) + 1), 4) bic FROM s""")
def _(spark, sf):
    f = md.ols(t.features(spark, sf), "price", ["quantity"]).where("term = 'quantity'")
    return rnd(rnd(f.select("term", "n", "beta", "se", "r2", "adj_r2", "aic", "bic"), "beta", "se", "aic", "bic", d=4), "r2", "adj_r2")


TWO = """mm AS (SELECT count(*) n, covar_pop(price, quantity) c1, covar_pop(price, discount) c2, var_pop(quantity) v1, var_pop(discount) v2, covar_pop(quantity, discount) v12, var_pop(price) vy, avg(price) my, avg(quantity) m1, avg(discount) m2 FROM feat),
bb AS (SELECT *, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) b1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) b2 FROM mm)"""


@query("p30_ols_two", t.with_(t.FEAT, TWO) + "SELECT unnest(['const', 'quantity', 'discount']) term, unnest([round(my - b1 * m1 - b2 * m2, 3), round(b1, 3), round(b2, 3)]) beta, round((b1 * c1 + b2 * c2) / vy, 6) r2 FROM bb")
def _(spark, sf):
    f = md.ols(t.features(spark, sf), "price", ["quantity", "discount"])
    return rnd(rnd(f.select("term", "beta", "r2"), "beta", d=3), "r2")


@query("p30_ols_by_group", t.with_(t.FEAT) + "SELECT condition, count(*) n, round(regr_slope(price, quantity), 3) beta, round(regr_r2(price, quantity), 6) r2 FROM feat GROUP BY ALL")
def _(spark, sf):
    f = md.ols(t.features(spark, sf), "price", ["quantity"], ["condition"]).where("term = 'quantity'")
    return rnd(rnd(f.select("condition", "n", "beta", "r2"), "beta", d=3), "r2")


FACTOR = "fi AS (SELECT price, quantity, discount, (condition = 'VR')::INT::DOUBLE condition_VR, (quantity - avg(quantity) OVER ()) * (discount - avg(discount) OVER ()) quantity_x_discount FROM feat)"


@query("p30_ols_factor_interaction", t.with_(t.FEAT, FACTOR) + f"SELECT term, n, round(beta, 3) beta, round(se, 3) se, round(r2, 6) r2 FROM ({eigen.least_squares('fi', 'price', ['quantity', 'discount', 'condition_VR', 'quantity_x_discount'], 'ols')})")
def _(spark, sf):
    d, names = md.dummies(t.features(spark, sf), "condition", ["PC", "VR"])
    d, x = md.centred_interaction(d, "quantity", "discount")
    f = md.ols(d, "price", ["quantity", "discount", *names, x]).where("term != 'const'").select("term", "n", "beta", "se", "r2")
    return rnd(rnd(f, "beta", "se", d=3), "r2")


@query("p31_standardised_path", t.with_(t.FEAT, TWO) + "SELECT unnest(['quantity', 'discount']) term, unnest([round(b1 * sqrt(v1 / vy), 6), round(b2 * sqrt(v2 / vy), 6)]) beta, round((b1 * c1 + b2 * c2) / vy, 6) r2 FROM bb")
def _(spark, sf):
    return rnd(md.standardised_path(t.features(spark, sf), "price", ["quantity", "discount"]).select("term", "beta", "r2"), "beta", "r2")


# Standardised variables: path x -> m, path m -> y given x, and their product, from weighted covariances.
INDIRECT = """d AS (SELECT unit_id unit, (quantity - avg(quantity) OVER ()) / stddev_samp(quantity) OVER () x, (price - avg(price) OVER ()) / stddev_samp(price) OVER () m, (tax - avg(tax) OVER ()) / stddev_samp(tax) OVER () y FROM feat)"""
PATHS = """SELECT {k} sum(w * x * m) - sum(w * x) * sum(w * m) / sum(w) xm, sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w) xx, sum(w * m * m) - sum(w * m) * sum(w * m) / sum(w) mm,
 sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w) xy, sum(w * m * y) - sum(w * m) * sum(w * y) / sum(w) my FROM {src} GROUP BY ALL"""
PB = f"""cv AS ({PATHS.format(k="b,", src="dr")}), st AS (SELECT b, xm / xx * (my * xx - xm * xy) / (mm * xx - xm * xm) stat FROM cv),
ev AS ({PATHS.format(k="", src="(SELECT *, 1 w FROM d)")}), es AS (SELECT xm / xx a, (my * xx - xm * xy) / (mm * xx - xm * xm) b FROM ev)"""


@query("p32_indirect_effect", t.with_(t.FEAT, INDIRECT, dw.replicates(5000), dw.counted("d"), PB) + """SELECT round(a, 6) a, round(b, 6) b, round(a * b, 6) indirect,
 round((SELECT quantile_cont(stat, 0.025) FROM st), 6) ci_low, round((SELECT quantile_cont(stat, 0.975) FROM st), 6) ci_high FROM es""")
def _(spark, sf):
    return rnd(md.indirect_effect(t.features(spark, sf), "unit_id", "quantity", "price", "tax", 5000), "a", "b", "indirect", "ci_low", "ci_high")


PATH_MODEL = """z AS (SELECT *, (quantity - avg(quantity) OVER ()) / stddev_samp(quantity) OVER () zq, (lines - avg(lines) OVER ()) / stddev_samp(lines) OVER () zl, (discount - avg(discount) OVER ()) / stddev_samp(discount) OVER () zd, -(tax - avg(tax) OVER ()) / stddev_samp(tax) OVER () zt FROM feat),
pm AS (SELECT price, (zq + zl) / 2 load, (zd + 0.5 * zt) / 1.5 deal FROM z)"""


@query("p33_path_model", t.with_(t.FEAT, PATH_MODEL) + f"SELECT model, term, n, round(beta, 4) beta, round(se, 4) se, round(r2, 6) r2 FROM ({eigen.least_squares('pm', 'price', ['load', 'deal'], 'price')} UNION ALL {eigen.least_squares('pm', 'deal', ['load'], 'deal')})")
def _(spark, sf):
    d = cut(md.composites(t.features(spark, sf), {"load": {"quantity": 1.0, "lines": 1.0}, "deal": {"discount": 1.0, "tax": 0.5}}, ["tax"]))
    f = md.fit_models(d, {"price": ("price", ["load", "deal"]), "deal": ("deal", ["load"])}).where("term != 'const'")
    return rnd(rnd(f.select("model", "term", "n", "beta", "se", "r2"), "beta", "se", d=4), "r2")


@query("c13_composites", t.with_(t.FEAT) + """, z AS (SELECT unit_id, (quantity - avg(quantity) OVER ()) / stddev_samp(quantity) OVER () zq, (lines - avg(lines) OVER ()) / stddev_samp(lines) OVER () zl, -(tax - avg(tax) OVER ()) / stddev_samp(tax) OVER () zt FROM feat)
SELECT unit_id, round((zq + zl) / 2, 6) load, round((zq + 0.5 * zt) / 1.5, 6) deal FROM z""")
def _(spark, sf):
    d = md.composites(t.features(spark, sf), {"load": {"quantity": 1.0, "lines": 1.0}, "deal": {"quantity": 1.0, "tax": 0.5}}, ["tax"])
    return rnd(d.select("unit_id", "load", "deal"), "load", "deal")


@query("c13_composite_loadings", t.with_(t.FEAT) + ", z AS (SELECT quantity, lines, (quantity - avg(quantity) OVER ()) / stddev_samp(quantity) OVER () + (lines - avg(lines) OVER ()) / stddev_samp(lines) OVER () l FROM feat) SELECT unnest(['quantity', 'lines']) x, 'load' y, count(*) n, unnest([round(corr(quantity, l), 6), round(corr(lines, l), 6)]) loading FROM z")
def _(spark, sf):
    d = cut(md.composites(t.features(spark, sf), {"load": {"quantity": 1.0, "lines": 1.0}}))
    return rnd(md.composite_loadings(d, "load", ["quantity", "lines"]), "loading")


@query("p34_cluster_robust", t.with_(t.FEAT, REG) + """, e AS (SELECT family_key, quantity x, price - a - b * quantity e FROM feat, rg), s AS (SELECT family_key, sum(e) s0, sum(x * e) s1 FROM e GROUP BY ALL),
m AS (SELECT count(*)::DOUBLE g, sum(s0 * s0) m00, sum(s0 * s1) m01, sum(s1 * s1) m11 FROM s), x AS (SELECT count(*)::DOUBLE n, sum(quantity) sx, sum(quantity * quantity) sxx FROM feat)
SELECT 'quantity' term, round((SELECT b FROM rg), 3) beta, round(sqrt((sx * sx * m00 - 2 * n * sx * m01 + n * n * m11) / pow(n * sxx - sx * sx, 2) * g / (g - 1) * (n - 1) / (n - 2)), 3) se_cluster, g::BIGINT n_clusters FROM m, x""")
def _(spark, sf):
    return rnd(md.cluster_robust(t.features(spark, sf), "price", ["quantity"], "family_key").where("term = 'quantity'"), "beta", "se_cluster", d=3)


@query("p35_vif", t.with_(t.FEAT) + "SELECT unnest(['quantity', 'discount']) term, round(1 / (1 - pow(corr(quantity, discount), 2)), 6) vif FROM feat")
def _(spark, sf):
    return rnd(md.vif(t.features(spark, sf), ["quantity", "discount"]), "vif")


@query("p36_stepwise_aic")
def _(spark, sf):
    return md.forward_stepwise(t.features(spark, sf), "rebate", ["quantity", "price", "discount", "tax"])


@query("p36_stepwise_p")
def _(spark, sf):
    return md.forward_stepwise(t.features(spark, sf), "rebate", ["quantity", "price", "discount", "tax"], "p")


@query("p37_repeated_kfold")
def _(spark, sf):
    return md.repeated_kfold(t.features(spark, sf), "unit_id", "rebate", ["price", "discount"])


# Normal scores by halving; one regressor, so Breusch-Pagan has one degree of freedom.
DIAGNOSTICS = f"""re AS (SELECT unit_id, quantity x, price - (SELECT avg(price) - regr_slope(price, quantity) * avg(quantity) FROM feat) - (SELECT regr_slope(price, quantity) FROM feat) * quantity e FROM feat),
rr AS (SELECT *, (rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2.0::DOUBLE - 0.375) / (count(*) OVER () + 0.25) p FROM re),
nq AS (SELECT unit_id, p, -8.0::DOUBLE lo, 8.0::DOUBLE hi, 0 i FROM rr UNION ALL SELECT unit_id, p, CASE WHEN f < p THEN mid ELSE lo END, CASE WHEN f < p THEN hi ELSE mid END, i + 1 FROM (SELECT *, {dw.phi('mid')} f FROM (SELECT *, (lo + hi) / 2 mid FROM nq WHERE i < 50))),
bp AS (SELECT count(*) * regr_r2(e * e, x) lm FROM re)"""


@query("p38_diagnostics", t.with_(t.FEAT, DIAGNOSTICS).replace("WITH", "WITH RECURSIVE", 1) + f"SELECT (SELECT count(*) FROM re) n, round((SELECT corr(e, (lo + hi) / 2) FROM nq JOIN rr USING (unit_id) WHERE i = 50), 6) qq_r, round(lm, 6) bp_lm, round(2 * (1 - {dw.phi('sqrt(lm)')}), 6) bp_p FROM bp")
def _(spark, sf):
    return rnd(md.diagnostics(t.features(spark, sf), "price", ["quantity"]), "qq_r", "bp_lm", "bp_p")


@query("p39_welch_t", t.with_(t.FEAT) + """, g AS (SELECT count(*) FILTER (condition = 'VR') n_a, count(*) FILTER (condition = 'PC') n_b, avg(price) FILTER (condition = 'VR') ma, avg(price) FILTER (condition = 'PC') mb, var_samp(price) FILTER (condition = 'VR') va, var_samp(price) FILTER (condition = 'PC') vb FROM feat)
SELECT n_a, n_b, round((ma - mb) / sqrt(va / n_a + vb / n_b), 6) t, round(pow(va / n_a + vb / n_b, 2) / (pow(va / n_a, 2) / (n_a - 1) + pow(vb / n_b, 2) / (n_b - 1)), 4) df, round((ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 6) cohen_d FROM g""")
def _(spark, sf):
    o = ts.welch_t(t.features(spark, sf), [], "condition", "price", "VR", "PC")
    return rnd(rnd(o.select("n_a", "n_b", "t", "df", "cohen_d"), "t", "cohen_d"), "df", d=4)


RKC = """rc AS (SELECT *, rank() OVER (ORDER BY lines) + (count(*) OVER (PARTITION BY lines) - 1) / 2.0::DOUBLE r, count(*) OVER (PARTITION BY lines) k FROM feat)"""


@query("p39_mann_whitney", t.with_(t.FEAT, RKC) + """, s AS (SELECT count(*) FILTER (condition = 'VR')::DOUBLE a, count(*) FILTER (condition = 'PC')::DOUBLE b, sum(r) FILTER (condition = 'VR') ra, sum(k * k - 1)::DOUBLE tie FROM rc), u AS (SELECT *, ra - a * (a + 1) / 2 u FROM s)
SELECT a::BIGINT n_a, b::BIGINT n_b, u, round(greatest(abs(u - a * b / 2) - 0.5, 0) / sqrt(a * b / 12 * (a + b + 1 - tie / ((a + b) * (a + b - 1)))), 6) z, round(2 * u / (a * b) - 1, 6) rank_biserial FROM u""")
def _(spark, sf):
    return rnd(ts.mann_whitney(t.features(spark, sf), [], "condition", "lines", "VR", "PC").select("n_a", "n_b", "u", "z", "rank_biserial"), "z", "rank_biserial")


@query("p39_wilcoxon_signed", t.with_(t.FEAT) + """, d AS (SELECT quantity - 25.5 d FROM feat WHERE quantity <> 25.5), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE r, count(*) OVER (PARTITION BY abs(d)) k FROM d),
s AS (SELECT count(*) n, coalesce(sum(r) FILTER (d > 0), 0) wp, sum(k * k - 1)::DOUBLE tie FROM r)
SELECT n, wp w_plus, least(wp, n * (n + 1) / 2 - wp) w, round((least(wp, n * (n + 1) / 2 - wp) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48), 6) z FROM s""")
def _(spark, sf):
    f = t.features(spark, sf).withColumn("ref", F.lit(25.5))
    return rnd(ts.wilcoxon_signed(f, [], "quantity", "ref").select("n", "w_plus", "w", "z"), "z")


@query("p39_kruskal", t.with_(t.FEAT, RKC) + """, g AS (SELECT family_key, count(*) n, sum(r) s, sum(k * k - 1)::DOUBLE t FROM rc GROUP BY ALL), q AS (SELECT sum(n)::DOUBLE n, count(*) k, sum(s * s / n) q, sum(t) t FROM g)
SELECT n::BIGINT n, k, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 6) h FROM q""")
def _(spark, sf):
    return rnd(ts.kruskal(t.features(spark, sf), [], "family_key", "lines").select("n", "k", "h"), "h")


AOV = """g AS (SELECT family_key, count(*) n, avg({v}) m, var_pop({v}) s FROM {t} GROUP BY ALL), a AS (SELECT avg({v}) g FROM {t}), q AS (SELECT sum(n)::DOUBLE n, count(*)::DOUBLE k, sum(n * pow(m - g, 2)) b, sum(n * s) w FROM g, a)"""


@query("p39_anova_oneway", t.with_(t.FEAT, AOV.format(v="price", t="feat")) + "SELECT n::BIGINT n, k::BIGINT k, round(b / (k - 1) / (w / (n - k)), 6) f, round(b / (b + w), 6) eta2 FROM q")
def _(spark, sf):
    return rnd(ts.anova_oneway(t.features(spark, sf), [], "family_key", "price").select("n", "k", "f", "eta2"), "f", "eta2")


@query("p39_levene", t.with_(t.FEAT, "lv AS (SELECT family_key, abs(price - quantile_cont(price, 0.5) OVER (PARTITION BY family_key)) v FROM feat)", AOV.format(v="v", t="lv")) + "SELECT n::BIGINT n, k::BIGINT k, round(b / (k - 1) / (w / (n - k)), 6) w FROM q")
def _(spark, sf):
    return rnd(ts.levene(t.features(spark, sf), [], "family_key", "price").select("n", "k", "w"), "w")


@query("p39_p_values")
def _(spark, sf):
    f = t.features(spark, sf)
    parts = [
        ts.welch_t(f, [], "condition", "price", "VR", "PC").select(F.lit("welch_t").alias("test"), "p"),
        ts.mann_whitney(f, [], "condition", "lines", "VR", "PC").select(F.lit("mann_whitney").alias("test"), "p"),
        ts.kruskal(f, [], "family_key", "lines").select(F.lit("kruskal").alias("test"), "p"),
        ts.anova_oneway(f, [], "family_key", "price").select(F.lit("anova").alias("test"), "p"),
        ts.levene(f, [], "family_key", "price").select(F.lit("levene").alias("test"), "p"),
    ]
    return ag.union_all(parts)


@query("p40_t_distribution", t.with_(t.FEAT) + f", sp AS (SELECT unit_id, (lines::BIGINT % 60) + 3 n, least(greatest(price / 60000 - 0.4, -0.9), 0.9) rho FROM feat), {PV} SELECT unit_id, n, round(p, 6) p FROM pv")
def _(spark, sf):
    f = t.features(spark, sf).select("unit_id", (F.col("lines").cast("long") % 60 + 3).alias("n"), F.least(F.greatest(F.col("price") / 60000 - 0.4, F.lit(-0.9)), F.lit(0.9)).alias("rho"))
    return rnd(f.select("unit_id", "n", rs.correlation_p(F.col("rho"), F.col("n")).alias("p")), "p")


# Indicators of two factors and the product of the centred ones; F with one degree of freedom is t squared.
FACTORS = "fa AS (SELECT price, quantity, (condition = 'VR')::INT::DOUBLE a, (scenario = 'S2')::INT::DOUBLE b, ((condition = 'VR')::INT - 0.5) * ((scenario = 'S2')::INT - 0.5) ab FROM feat)"
ANOVA = f"SELECT term, round(ss, 1) ss, df, round(ss_resid, 1) ss_resid, df_resid, round(f, 6) f, round(partial_eta2, 6) partial_eta2, round({TP}, 6) p FROM (SELECT *, df_resid::BIGINT + 2 n, atan(sqrt(f) / sqrt(df_resid)) th FROM an)"


def anova_rounded(a):
    return rnd(rnd(a, "f", "partial_eta2", "p"), "ss", "ss_resid", d=1)


@query("p41_factorial_anova", t.with_(t.FEAT, FACTORS, f"an AS ({eigen.type_two('fa', 'price', {'condition': (['b'], 'a'), 'scenario': (['a'], 'b'), 'condition:scenario': (['a', 'b'], 'ab')}, ['a', 'b', 'ab'])})") + ANOVA)
def _(spark, sf):
    return anova_rounded(md.two_factor_anova(t.features(spark, sf), "price", "condition", "scenario", ["PC", "VR"], ["S1", "S2"]))


@query("p41_ancova", t.with_(t.FEAT, FACTORS, f"an AS ({eigen.type_two('fa', 'price', {'condition': (['quantity', 'b'], 'a'), 'scenario': (['quantity', 'a'], 'b')}, ['quantity', 'a', 'b'])})") + ANOVA)
def _(spark, sf):
    return anova_rounded(md.two_factor_anova(t.features(spark, sf), "price", "condition", "scenario", ["PC", "VR"], ["S1", "S2"], ["quantity"], interaction=False))


@query("p41_adjusted_means", t.with_(t.FEAT) + """, w AS (SELECT sum(sxy) / sum(sxx) b FROM (SELECT regr_sxy(price, quantity) sxy, regr_sxx(price, quantity) sxx FROM feat GROUP BY condition))
SELECT condition AS level, round(avg(price) - (SELECT b FROM w) * (avg(quantity) - (SELECT avg(quantity) FROM feat)), 3) adjusted_mean FROM feat GROUP BY ALL""")
def _(spark, sf):
    return rnd(md.adjusted_means(t.features(spark, sf), "price", "condition", ["PC", "VR"], ["quantity"]), "adjusted_mean", d=3)


@query("p42_stratified_spearman", t.with_(t.FEAT) + """, r AS (SELECT condition, rank() OVER (PARTITION BY condition ORDER BY price) + (count(*) OVER (PARTITION BY condition, price) - 1) / 2.0 rx, rank() OVER (PARTITION BY condition ORDER BY lines) + (count(*) OVER (PARTITION BY condition, lines) - 1) / 2.0 ry FROM feat),
c AS (SELECT corr(rx::DOUBLE, ry::DOUBLE) FILTER (condition = 'VR') a, corr(rx::DOUBLE, ry::DOUBLE) FILTER (condition = 'PC') b FROM r) SELECT round(a, 6) rho_a, round(b, 6) rho_b, round(a - b, 6) delta_rho FROM c""")
def _(spark, sf):
    return rnd(ts.stratified_spearman(t.features(spark, sf), [], "condition", "price", "lines", "VR", "PC"), "rho_a", "rho_b", "delta_rho")


DISPERSION = """g0 AS (SELECT group_id, avg(score) m, stddev_samp(score) sd, max(score)::DOUBLE y FROM resp GROUP BY ALL),
gz AS (SELECT (m - avg(m) OVER ()) / stddev_samp(m) OVER () m, (sd - avg(sd) OVER ()) / stddev_samp(sd) OVER () sd, (y - avg(y) OVER ()) / stddev_samp(y) OVER () y FROM g0)"""


@query("p43_dispersion_regression", t.with_(t.RESP, DISPERSION) + f"""SELECT f.n, round(e.r2, 6) r2_mean, round(f.r2, 6) r2_mean_sd, round(f.b1, 6) beta_sd, round((SELECT corr(m, sd) FROM gz), 6) r_mean_sd, round(f.r2 - e.r2, 6) delta_r2, abs((SELECT corr(m, sd) FROM gz)) > 0.7 confounded
FROM ({eigen.fitted('gz', 'y', ['m'])}) e, ({eigen.fitted('gz', 'y', ['m', 'sd'])}) f""")
def _(spark, sf):
    r = t.responses(spark, sf)
    out = r.groupBy("group_id").agg(F.max("score").alias("y"))
    return rnd(md.dispersion_regression(r, "group_id", "score", out, "y"), "r2_mean", "r2_mean_sd", "beta_sd", "r_mean_sd", "delta_r2")


RANDOM = """rs AS (SELECT family_key g, price y, quantity x, price - (SELECT avg(price) - regr_slope(price, quantity) * avg(quantity) FROM feat) - (SELECT regr_slope(price, quantity) FROM feat) * quantity e FROM feat),
vg AS (SELECT g, count(*)::DOUBLE n, avg(e) m, var_pop(e) v, avg(y) my, avg(x) mx FROM rs GROUP BY ALL), vt AS (SELECT sum(n) n, count(*) k, sum(n * n) n2, sum(n * pow(m - (SELECT avg(e) FROM rs), 2)) b, sum(n * v) w FROM vg),
vc AS (SELECT w / (n - k) vw, greatest((b / (k - 1) - w / (n - k)) / ((n - n2 / n) / (k - 1)), 0) vb FROM vt),
tr AS (SELECT 1 - th c, y - th * my y, x - th * mx x FROM (SELECT *, 1 - sqrt(vw / (vw + n * vb)) th FROM rs JOIN vg USING (g), vc)),
ts AS (SELECT sum(c * c) cc, sum(c * x) cx, sum(x * x) xx, sum(c * y) cy, sum(x * y) xy, count(*) n FROM tr)"""


@query("p44_random_intercept", t.with_(t.FEAT, RANDOM) + """SELECT n, round(vb, 3) var_between, round(vw, 3) var_within, round((xx * cy - cx * xy) / (cc * xx - cx * cx), 4) intercept, round((cc * xy - cx * cy) / (cc * xx - cx * cx), 4) slope, round(sqrt(vw * cc / (cc * xx - cx * cx)), 4) se_slope FROM ts, vc""")
def _(spark, sf):
    o = md.random_intercept(t.features(spark, sf), "family_key", "price", "quantity")
    return rnd(rnd(o, "var_between", "var_within", d=3), "intercept", "slope", "se_slope", d=4)


@query("p55_scenario_modality_scores", t.with_(t.FEAT) + "SELECT condition, scenario, count(*) n, round(avg(price), 4) mean, round(stddev_samp(price), 4) sd FROM feat GROUP BY ALL")
def _(spark, sf):
    o = ts.cell_means_ci(t.features(spark, sf), ["condition", "scenario"], "price")
    return rnd(o.select("condition", "scenario", "n", "mean", "sd"), "mean", "sd", d=4)


# The t quantile by halving the interval that holds it.
CELLS = f"""ce AS (SELECT condition, scenario, count(*) k, avg(price) m, stddev_samp(price) s FROM feat GROUP BY ALL),
tq AS (SELECT DISTINCT k, 0.0::DOUBLE lo, 100.0::DOUBLE hi, 0 i FROM ce UNION ALL SELECT k, CASE WHEN p > 0.05 THEN mid ELSE lo END, CASE WHEN p > 0.05 THEN hi ELSE mid END, i + 1
 FROM (SELECT *, {TP} p FROM (SELECT k, lo, hi, i, (lo + hi) / 2 mid, k + 1 n, atan((lo + hi) / 2 / sqrt(k - 1)) th FROM tq WHERE i < 50)))"""


@query("p55_scenario_modality_ci", t.with_(t.FEAT, CELLS).replace("WITH", "WITH RECURSIVE", 1) + "SELECT condition, scenario, k n, round(m, 4) mean, round(s, 4) sd, round(m - (lo + hi) / 2 * s / sqrt(k), 4) ci_low, round(m + (lo + hi) / 2 * s / sqrt(k), 4) ci_high FROM ce JOIN tq USING (k) WHERE i = 50")
def _(spark, sf):
    return rnd(ts.cell_means_ci(t.features(spark, sf), ["condition", "scenario"], "price"), "mean", "sd", "ci_low", "ci_high", d=4)


# ---- components and networks ---------------------------------------------------------
@query("p20_pca", t.with_(t.FEAT) + "SELECT unnest([1, 2]) component, unnest([round(1 + abs(corr(quantity, price)), 6), round(1 - abs(corr(quantity, price)), 6)]) eigenvalue FROM feat")
def _(spark, sf):
    # Two columns have a closed form; the full matrix is p20_pca_loadings.
    return rnd(cp.pca_fit(t.features(spark, sf), ["quantity", "price"], 2).select("component", "eigenvalue").distinct(), "eigenvalue").distinct()


def rec(*ctes):
    return t.with_(*ctes).replace("WITH", "WITH RECURSIVE", 1)


PC = "component, feature, round(weight, 6) + 0.0 weight, round(loading, 6) + 0.0 loading, round(eigenvalue, 6) eigenvalue, round(variance_share, 6) variance_share"
PC_COLS = ("weight", "loading", "eigenvalue", "variance_share")


@query("p20_pca_loadings", rec(t.FEAT, eigen.components("feat", FULL, 3)) + f"SELECT {PC} FROM pc")
def _(spark, sf):
    return plus_zero(rnd(cp.pca_fit(t.features(spark, sf), FULL, 3), *PC_COLS), "weight", "loading")


@query("p20_pca_by_condition", rec(t.FEAT, *[f"f{c} AS (SELECT * FROM feat WHERE condition = '{c}')" for c in ("VR", "PC")], *[eigen.components(f"f{c}", FULL, 2, c) for c in ("VR", "PC")]) + " UNION ALL ".join(f"SELECT '{c}' condition, {PC} FROM pc{c}" for c in ("VR", "PC")))
def _(spark, sf):
    return plus_zero(rnd(cp.pca_fit(t.features(spark, sf), FULL, 2, ["condition"]), *PC_COLS), "weight", "loading")


@query("p20_pca_scores", rec(t.FEAT, eigen.components("feat", FULL, 2), eigen.scores("feat", FULL, 2, "unit_id")) + "SELECT unit_id, round(PC1, 6) + 0.0 PC1, round(PC2, 6) + 0.0 PC2 FROM ps")
def _(spark, sf):
    f = t.features(spark, sf)
    return plus_zero(rnd(cp.pca_scores(f, cut(cp.pca_fit(f, FULL, 2)), FULL, 2).select("unit_id", "PC1", "PC2"), "PC1", "PC2"), "PC1", "PC2")


@query("p21_orient_components", rec(t.FEAT, eigen.components("feat", FULL, 1), eigen.scores("feat", FULL, 1, "unit_id")) + """, rk AS (SELECT rank() OVER (ORDER BY PC1) + (count(*) OVER (PARTITION BY PC1) - 1) / 2.0 a, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 b FROM ps JOIN feat USING (unit_id))
SELECT unit_id, round(PC1 * CASE WHEN (SELECT corr(a::DOUBLE, b::DOUBLE) FROM rk) < 0 THEN -1 ELSE 1 END, 6) + 0.0 PC1 FROM ps""")
def _(spark, sf):
    f = t.features(spark, sf)
    s = cut(cp.pca_scores(f, cut(cp.pca_fit(f, FULL, 1)), FULL, 1))
    return plus_zero(rnd(cp.orient(s, "PC1", "price").select("unit_id", "PC1"), "PC1"), "PC1")


@query("p22_parallel_analysis")
def _(spark, sf):
    return cp.parallel_analysis(t.features(spark, sf), FULL, 1000)


@query("p24_pca_loading_stability")
def _(spark, sf):
    return cp.bootstrap_stability(t.features(spark, sf), "unit_id", FULL, 2, 300)[0]


@query("p24_pca_component_stability")
def _(spark, sf):
    return cp.bootstrap_stability(t.features(spark, sf), "unit_id", FULL, 2, 300)[1]


@query("p60_top_loadings", rec(t.FEAT, eigen.components("feat", FULL, 2)) + """SELECT component, rank, feature, round(loading, 6) loading, CASE WHEN loading >= 0 THEN '+' ELSE '-' END sign
FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY abs(loading) DESC, feature DESC)::INT rank FROM pc) WHERE rank <= 3""")
def _(spark, sf):
    return cp.top_loadings(cp.pca_fit(t.features(spark, sf), FULL, 2), 3)


@query("p25_near_zero_variance", t.with_(t.FEAT) + " UNION ALL ".join(f"SELECT '{c}' feature, count({c}) n, round(abs(stddev_samp({c}) / avg({c})), 6) cv, abs(stddev_samp({c}) / avg({c})) < 0.05 near_zero_variance FROM feat" for c in NUM))
def _(spark, sf):
    return rnd(cp.near_zero_variance(t.features(spark, sf), NUM), "cv")


# Embedding dimensions as features: pairs of dimensions are the network.
DIMS = [f"e{i}" for i in range(64)]
EMB = "emb AS (SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE e{i}" for i in range(64)) + " FROM embeddings)"
LONG = "lg AS (UNPIVOT (SELECT * EXCLUDE (label) FROM emb) ON " + ", ".join(DIMS) + " INTO NAME f VALUE v)"
CORR = "cr AS (SELECT least(a.f, b.f) x, greatest(a.f, b.f) y, count(*) n, corr(a.v, b.v) r FROM lg a JOIN lg b ON a.vec_id = b.vec_id AND a.f < b.f GROUP BY ALL)"


def emb(spark, sf):
    e = t.table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


def corr_edges(spark, sf):
    c = mo.correlation_matrix(emb(spark, sf), DIMS)
    return cut(c.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "n", "r"))


def net(spark, sf):
    return cut(nw.network_edges(corr_edges(spark, sf).withColumnRenamed("r", "rho"), TH))


TH = 0.1
NET = f"ed AS (SELECT x, y, r rho FROM cr WHERE abs(r) >= {TH}), dbl AS (SELECT x a, y b, abs(rho) w FROM ed UNION ALL SELECT y, x, abs(rho) FROM ed)"


@query("j15_feature_pairs", t.with_(EMB, LONG, CORR) + "SELECT x, y, n, round(r, 6) r FROM cr")
def _(spark, sf):
    return rnd(corr_edges(spark, sf), "r")


@query("p27_redundancy_pairs", t.with_(EMB, LONG, CORR) + f"SELECT x, y, n, round(r, 6) r FROM cr WHERE abs(r) >= {TH}")
def _(spark, sf):
    c = cp.redundancy_pairs(emb(spark, sf), DIMS, TH)
    return rnd(c.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "n", "r"), "r")


def feats(spark):
    return spark.createDataFrame([(d, 0, i) for i, d in enumerate(DIMS)], "feature string, n_missing int, priority int")


# Pairs from the strongest down; the feature with the larger key goes unless one of the pair is gone already.
PRUNE = f"""ke AS (SELECT f, row((f NOT IN ('e0', 'e1'))::INT, substr(f, 2)::INT, length(f), f) k FROM (SELECT DISTINCT f FROM lg)),
pe AS (SELECT x, y, abs(r) a, CASE WHEN p.k < q.k THEN y ELSE x END gone, row_number() OVER (ORDER BY abs(r) DESC, x, y) i FROM cr JOIN ke p ON p.f = x JOIN ke q ON q.f = y WHERE abs(r) > {TH} AND NOT (x IN ('e0', 'e1') AND y IN ('e0', 'e1'))),
pr AS (SELECT 0::BIGINT i, []::VARCHAR[] gone, []::VARCHAR[] why, []::DOUBLE[] how UNION ALL
 SELECT j, CASE WHEN alive THEN list_append(gone, out) ELSE gone END, CASE WHEN alive THEN list_append(why, CASE WHEN out = x THEN y ELSE x END) ELSE why END, CASE WHEN alive THEN list_append(how, a) ELSE how END
 FROM (SELECT pr.gone, why, how, x, y, a, pe.gone out, pe.i j, NOT list_contains(pr.gone, x) AND NOT list_contains(pr.gone, y) alive FROM pr JOIN pe ON pe.i = pr.i + 1))"""


@query("p26_prune_correlated", rec(EMB, LONG, CORR, PRUNE) + """, dr AS (SELECT unnest(gone) f, unnest(why) kept_instead, unnest(how) abs_r FROM pr WHERE i = (SELECT max(i) FROM pr))
SELECT f feature, abs_r IS NULL kept, kept_instead, round(abs_r, 6) abs_r FROM (SELECT DISTINCT f FROM lg) LEFT JOIN dr USING (f)""")
def _(spark, sf):
    return rnd(cp.prune_correlated(corr_edges(spark, sf), feats(spark), TH, [("e0", "e1")]), "abs_r")


CLUSTERS = """ce AS (SELECT x a, y b FROM cr WHERE abs(r) >= 0.12 UNION ALL SELECT y, x FROM cr WHERE abs(r) >= 0.12), ca AS (SELECT DISTINCT f node, f reach FROM lg UNION SELECT ca.node, ce.b FROM ca JOIN ce ON ca.reach = ce.a),
cl AS (SELECT node feature, min(reach) "cluster" FROM ca GROUP BY ALL)"""


@query("p29_feature_clusters", rec(EMB, LONG, CORR, CLUSTERS) + 'SELECT feature, "cluster" FROM cl')
def _(spark, sf):
    return cp.feature_clusters(corr_edges(spark, sf), feats(spark), 0.12)


@query("p28_cluster_representatives", rec(EMB, LONG, CORR, CLUSTERS) + """, tc AS (SELECT f feature, abs(corr(v, label)) tc FROM lg JOIN emb USING (vec_id) GROUP BY ALL)
SELECT "cluster", feature, row_number() OVER (PARTITION BY "cluster" ORDER BY coalesce(tc, 0) DESC, substr(feature, 2)::INT, length(feature), feature) = 1 selected FROM cl JOIN tc USING (feature)""")
def _(spark, sf):
    cl = cp.feature_clusters(corr_edges(spark, sf), feats(spark), 0.12)
    tc = mo.pearson_by(mo.pair_rows(emb(spark, sf), [], [(d, "label") for d in DIMS]), ["x", "y"], "vx", "vy").select(F.col("x").alias("feature"), F.abs("r").alias("target_corr"))
    return cp.cluster_representatives(cl, feats(spark).join(tc, "feature"))


@query("p45_network_degrees", t.with_(EMB, LONG, CORR, NET) + "SELECT a node, count(*) degree, round(sum(w), 6) weighted_degree FROM dbl GROUP BY ALL")
def _(spark, sf):
    return rnd(nw.degrees(net(spark, sf)), "weighted_degree")


@query("p45_network_summary", t.with_(EMB, LONG, CORR, NET) + "SELECT (SELECT count(*) FROM ed) n_edges, round((SELECT avg((rho > 0)::INT::DOUBLE) FROM ed), 6) positive_share, count(DISTINCT a) n_nodes, round(2.0 * (SELECT count(*) FROM ed) / (count(DISTINCT a) * (count(DISTINCT a) - 1)), 6)::DOUBLE density FROM dbl")
def _(spark, sf):
    return rnd(nw.network_summary(net(spark, sf)), "positive_share", "density")


@query("p46_components", "WITH RECURSIVE " + ", ".join([EMB, LONG, CORR, NET]) + ", rc AS (SELECT DISTINCT a node, a reach FROM dbl UNION SELECT rc.node, dbl.b FROM rc JOIN dbl ON rc.reach = dbl.a) SELECT node, min(reach) component FROM rc GROUP BY ALL")
def _(spark, sf):
    return nw.connected_components(net(spark, sf))


@query("p46_hop_distance", "WITH RECURSIVE " + ", ".join([EMB, LONG, CORR, NET]) + ", rc AS (SELECT DISTINCT a node, 0 hops FROM dbl WHERE a = 'e1' UNION SELECT dbl.b, hops + 1 FROM rc JOIN dbl ON rc.node = dbl.a WHERE hops < 64) SELECT node, min(hops) hops FROM rc GROUP BY ALL")
def _(spark, sf):
    return nw.hop_distance(net(spark, sf), "e1")


@query("p47_clustering_coefficient", t.with_(EMB, LONG, CORR, NET) + """, tr AS (SELECT p.a node, sum(pow(p.w * q.w * r.w / pow((SELECT max(w) FROM dbl), 3), 1 / 3.0)) g, count(*) k FROM dbl p JOIN dbl q ON p.a = q.a AND p.b < q.b JOIN dbl r ON r.a = p.b AND r.b = q.b GROUP BY ALL)
SELECT node, degree, coalesce(k, 0) triangles, round(CASE WHEN degree > 1 THEN 2 * coalesce(g, 0) / (degree * (degree - 1)) ELSE 0 END, 6) clustering FROM (SELECT a node, count(*) degree FROM dbl GROUP BY ALL) LEFT JOIN tr USING (node)""")
def _(spark, sf):
    return rnd(nw.clustering_coefficient(net(spark, sf)), "clustering")


@query("p48_eigenvector_centrality")
def _(spark, sf):
    return nw.eigenvector_centrality(net(spark, sf), 30)


FAMS = "fm AS (SELECT DISTINCT a node, CASE WHEN substr(a, 2)::INT < 8 THEN 'low' ELSE 'high' END family FROM dbl)"


@query("p49_bridge_nodes", t.with_(EMB, LONG, CORR, NET, FAMS) + "SELECT a node, count(*) cross_edges, round(sum(w), 6) cross_weight, count(DISTINCT g.family) n_families FROM dbl JOIN fm f ON f.node = a JOIN fm g ON g.node = b WHERE f.family <> g.family GROUP BY ALL")
def _(spark, sf):
    e = net(spark, sf)
    fam = nw.degrees(e).select("node", F.when(F.substring("node", 2, 9).cast("int") < 8, "low").otherwise("high").alias("family"))
    return rnd(nw.bridge_nodes(e, fam), "cross_weight")


@query("p50_communities")
def _(spark, sf):
    return nw.communities(net(spark, sf))


@query("p61_network_tables", t.with_(EMB, LONG, CORR, NET) + "SELECT a node, count(*) degree FROM dbl GROUP BY ALL ORDER BY degree DESC, node LIMIT 5")
def _(spark, sf):
    return nw.ranked_nodes(nw.degrees(net(spark, sf)), "degree", 5)


@query("p51_pc_regression")
def _(spark, sf):
    f = t.features(spark, sf)
    s = cut(cp.pca_scores(f, cut(cp.pca_fit(f, ["quantity", "discount", "tax", "lines"], 3)), ["quantity", "discount", "tax", "lines"], 3))
    return md.forward_stepwise(s, "price", ["PC1", "PC2", "PC3"])


@query("p52_multilevel_synthesis", t.with_(t.RESP) + """, g AS (SELECT dimension, group_id, count(*) n, avg(score) m, stddev_samp(score) sd, var_pop(score) v FROM resp GROUP BY ALL)
, x AS (SELECT dimension, count(*) n_groups, avg(m) mm, stddev_samp(m) sm, avg(sd) ms, sum(n) n, sum(n * n) kk, (sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1) b, sum(n * v) / (sum(n) - count(*)) w FROM g GROUP BY ALL)
SELECT dimension, n_groups, round(mm, 6) mean_of_means, round(sm, 6) sd_of_means, round(ms, 6) mean_sd, round((b - w) / (b + ((n - kk / n) / (n_groups - 1) - 1) * w), 6) icc1 FROM x""")
def _(spark, sf):
    return rnd(sy.multilevel_synthesis(t.responses(spark, sf), "dimension", "group_id", "score"), "mean_of_means", "sd_of_means", "mean_sd", "icc1")


@query("p53_rank_delta", t.with_(t.FEAT) + "SELECT unit_id, rank() OVER (ORDER BY price DESC) rank_a, rank() OVER (ORDER BY quantity DESC) rank_b, rank() OVER (ORDER BY quantity DESC) - rank() OVER (ORDER BY price DESC) delta FROM feat")
def _(spark, sf):
    return sy.rank_delta(t.features(spark, sf), "unit_id", "price", "quantity")


@query("p54_significance_switches", t.with_(t.FEAT, PR, RK, PV, FDR) + "SELECT x, y, CASE WHEN p < 0.05 AND p_fdr >= 0.05 THEN 'lost' WHEN p >= 0.05 AND p_fdr < 0.05 THEN 'gained' ELSE 'same' END change FROM fd")
def _(spark, sf):
    return sy.significance_switches(rs.correlation_table(pairs(spark, sf))).select("x", "y", "change")


FAMILIARITY = {"alone": ["lines"], "with_discount": ["lines", "discount"], "with_tax": ["lines", "tax"], "with_all": ["lines", "discount", "tax"]}


@query("p56_familiarity_models", t.with_(t.FEAT) + "SELECT model, term, n, round(beta, 4) beta, round(se, 4) se, round(r2, 6) r2 FROM (" + " UNION ALL ".join(eigen.least_squares("feat", "price", xs, m) for m, xs in FAMILIARITY.items()) + ") WHERE term = 'lines'")
def _(spark, sf):
    f = sy.familiarity_models(t.features(spark, sf), "price", "lines", ["discount", "tax"])
    return rnd(rnd(f.select("model", "term", "n", "beta", "se", "r2"), "beta", "se", d=4), "r2")


VALIDITY = """z AS (SELECT unit_id unit, (quantity - avg(quantity) OVER ()) / stddev_pop(quantity) OVER () a, (discount - avg(discount) OVER ()) / stddev_pop(discount) OVER () b, (tax - avg(tax) OVER ()) / stddev_pop(tax) OVER () c, price, lines FROM feat),
d AS (SELECT 'price' k, unit, (a + b + c) / 3 x, price y FROM z UNION ALL SELECT 'lines', unit, (a + b + c) / 3, lines FROM z)"""


@query("p57_index_validity", metrics(1000, t.FEAT, VALIDITY) + f"SELECT k outcome, {METRICS}, round((SELECT 1.5 * (1 - (var_samp(a) + var_samp(b) + var_samp(c)) / var_samp(a + b + c)) FROM z), 6) alpha FROM mt")
def _(spark, sf):
    f = cut(t.features(spark, sf))
    z = cut(ag.zscore_within(f, ["quantity", "discount", "tax"], []))
    idx = (F.col("z_quantity") + F.col("z_discount") + F.col("z_tax")) / 3
    return rnd(sy.index_validity(z.withColumn("idx", idx), "unit_id", "idx", ["z_quantity", "z_discount", "z_tax"], ["price", "lines"], 1000), *METRIC_COLS, "alpha")


CORE = ["quantity", "price", "discount"]


@query("p58_collect_correlations", t.with_(t.FEAT, PR, RK, PV) + f""", bl AS (SELECT 'features' block, * FROM pv UNION ALL SELECT 'core', * FROM pv WHERE x IN {tuple(CORE)} AND y IN {tuple(CORE)})
SELECT block, x, y, n, round(rho, 6) rho, round(p, 6) p FROM bl QUALIFY row_number() OVER (PARTITION BY y, round(rho, 6), round(p, 6), n ORDER BY x, block) = 1""")
def _(spark, sf):
    return sy.collect_correlations({"features": pairs(spark, sf), "core": pairs(spark, sf, CORE)}).select("block", "x", "y", "n", "rho", "p")


@query("p59_score_agreement", t.with_(t.FEAT) + """, r AS (SELECT price x, quantity y, rank() OVER (ORDER BY price DESC) a, rank() OVER (ORDER BY quantity DESC) b, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 rx, rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2.0 ry FROM feat)
SELECT count(*) n, round(corr(x, y), 6) pearson, round(corr(rx::DOUBLE, ry::DOUBLE), 6) spearman, round(avg(abs(b - a)), 6) rank_delta_mean, max(abs(b - a)) rank_delta_max FROM r""")
def _(spark, sf):
    return rnd(sy.score_agreement(cut(t.features(spark, sf).select("unit_id", "price", "quantity")), "unit_id", "price", "quantity"), "pearson", "spearman", "rank_delta_mean")
