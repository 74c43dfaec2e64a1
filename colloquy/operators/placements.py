"""Object placements against a solution layout (K-01 to K-12, J-13, J-14).

Objects: ``layout_id, s_id | p_id, x, z`` (floor plane). A layout may be any size:
candidate pairs come from a grid whose cell grows with the search radius, never from all
solution x placed pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.scalars import clip, host_shape, within_tolerance
from colloquy.session import cut

from .scan import by_width, gap_islands, lag, quantiles, attach, scan, with_group_aggs

K = ["layout_id"]


def near_pairs(solution: DataFrame, placed: DataFrame, radius: float | Column) -> DataFrame:
    """J-13: solution / placed pairs of one layout within ``radius``, found by grid cell.

    ``radius`` may be a column of both tables that is constant in a layout. The solution is
    copied to the cells beside it along x, the placed objects along z, so that neighbours
    meet in one cell. The join is always sorted: a plan's size estimate does not see the
    copies, and a broadcast by that estimate would hold them all on the driver.
    """
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    cell = lambda c: F.floor(F.col(c) / F.col("_r")).cast("long")
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    s = solution.select(*K, "s_id", F.col("x").alias("sx"), F.col("z").alias("sz"), r.alias("_r"))
    p = placed.select(*K, "p_id", F.col("x").alias("px"), F.col("z").alias("pz"), r.alias("_r"))
    beside = lambda c: F.explode(F.transform(step, lambda d: d + cell(c)))
    s = s.withColumn("_i", beside("sx")).withColumn("_j", cell("sz"))
    p = p.withColumn("_i", cell("px")).withColumn("_j", beside("pz")).drop("_r")
    j = s.join(p.hint("merge"), [*K, "_i", "_j"])
    dx, dz = F.col("sx") - F.col("px"), F.col("sz") - F.col("pz")
    j = j.withColumn("dist", F.sqrt(dx * dx + dz * dz)).where(F.col("dist") <= F.col("_r"))
    return j.select(*K, "s_id", "p_id", "dist")


def match_greedy(solution: DataFrame, placed: DataFrame, radius: float = 0.5, growth: float = 2.0) -> DataFrame:
    """K-01: one-to-one pairs by ascending distance (ties by ids).

    Pairs within a radius come before all longer ones, so a layout's search radius grows
    only when nothing is left inside it. Within a radius, a pair that is the nearest one
    left for both of its objects is what the sequential rule takes next for them; each
    round takes all such pairs at once. Objects whose position is NULL, NaN or infinite
    cannot be matched. A layout ends when one of its sides is used up, which a radius over
    its extent brings about.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))
    at = lambda d: d.where(finite("x") & finite("z"))
    s = cut(at(solution).select(*K, "s_id", "x", "z").withColumn("_r", F.lit(float(radius))))
    p = cut(at(placed).select(*K, "p_id", "x", "z").withColumn("_r", F.lit(float(radius))))
    empty = s.join(p.select(*K, "p_id"), K).select(*K, "s_id", "p_id", F.lit(0.0).alias("dist")).limit(0)
    found = None
    while True:
        both = s.select(*K).distinct().join(p.select(*K).distinct(), K)
        s, p = cut(s.join(both, K, "left_semi")), cut(p.join(both, K, "left_semi"))
        if s.isEmpty():
            break
        e, news = cut(near_pairs(s, p, F.col("_r"))), None
        while not e.isEmpty():
            o = F.struct("dist", "s_id", "p_id")
            bs = e.groupBy(*K, "s_id").agg(F.min(o).alias("b")).select(*K, "b")
            bp = e.groupBy(*K, "p_id").agg(F.min(o).alias("b")).select(*K, "b")
            new = cut(bs.join(bp, [*K, "b"]).select(*K, "b.s_id", "b.p_id", "b.dist"))
            news = new if news is None else news.unionByName(new)
            e = cut(e.join(new.select(*K, "s_id"), [*K, "s_id"], "left_anti").join(new.select(*K, "p_id"), [*K, "p_id"], "left_anti"))
        if news is not None:
            found = news if found is None else found.unionByName(news)
            s = s.join(news.select(*K, "s_id"), [*K, "s_id"], "left_anti")
            p = p.join(news.select(*K, "p_id"), [*K, "p_id"], "left_anti")
        s, p = (d.withColumn("_r", F.col("_r") * growth) for d in (s, p))
    return empty if found is None else cut(found)


def _medians(df: DataFrame, x: str, z: str) -> DataFrame:
    return quantiles(df, K, x, {"mx": 0.5}).join(quantiles(df, K, z, {"mz": 0.5}), K)


def shift(df: DataFrame, offset: DataFrame) -> DataFrame:
    """Objects moved by their layout's (tx, tz)."""
    d = attach(df, offset.select(*K, F.col("tx").alias("_tx"), F.col("tz").alias("_tz")), K)
    return d.withColumn("x", F.col("x") + F.coalesce("_tx", F.lit(0.0))).withColumn("z", F.col("z") + F.coalesce("_tz", F.lit(0.0))).drop("_tx", "_tz")


def translation_median(solution: DataFrame, placed: DataFrame, n_iter: int = 2) -> tuple[DataFrame, DataFrame]:
    """K-02: median offset, match, median residual, repeated. Returns (offsets, matches)."""
    ms = _medians(solution, "x", "z").select(*K, F.col("mx").alias("a"), F.col("mz").alias("b"))
    mp = _medians(placed, "x", "z")
    off = cut(ms.join(mp, K).select(*K, (F.col("a") - F.col("mx")).alias("tx"), (F.col("b") - F.col("mz")).alias("tz")))
    cur = cut(shift(placed, off))
    for _ in range(max(1, n_iter)):
        m = match_greedy(solution, cur)
        j = m.join(solution.select(*K, "s_id", F.col("x").alias("sx"), F.col("z").alias("sz")), [*K, "s_id"]).join(cur.select(*K, "p_id", "x", "z"), [*K, "p_id"])
        j = j.select(*K, (F.col("sx") - F.col("x")).alias("rx"), (F.col("sz") - F.col("z")).alias("rz"))
        res = cut(_medians(j, "rx", "rz").select(*K, F.col("mx").alias("tx"), F.col("mz").alias("tz")))
        off = cut(off.join(res.select(*K, F.col("tx").alias("dx"), F.col("tz").alias("dz")), K, "left").select(
            *K, (F.col("tx") + F.coalesce("dx", F.lit(0.0))).alias("tx"), (F.col("tz") + F.coalesce("dz", F.lit(0.0))).alias("tz")))
        cur = cut(shift(cur, res))
    return off, match_greedy(solution, cur)


def translation_mean(solution: DataFrame, placed: DataFrame) -> DataFrame:
    """K-03: offset between the mean points."""
    m = lambda d, a: d.groupBy(*K).agg(F.avg("x").alias(f"{a}x"), F.avg("z").alias(f"{a}z"))
    return m(solution, "s").join(m(placed, "p"), K).select(*K, (F.col("sx") - F.col("px")).alias("tx"), (F.col("sz") - F.col("pz")).alias("tz"))


def axis_transform(pairs: DataFrame) -> DataFrame:
    """K-03: scale and offset per axis by least squares on matched pairs (px, pz, sx, sz)."""
    g = pairs.groupBy(*K).agg(
        F.count("*").alias("n"), F.regr_slope("sx", "px").alias("ax"), F.regr_intercept("sx", "px").alias("bx"),
        F.regr_slope("sz", "pz").alias("az"), F.regr_intercept("sz", "pz").alias("bz"),
    )
    ok = F.col("n") >= 2
    return g.select(*K, *[F.when(ok, F.col(c)).otherwise(d).alias(c) for c, d in (("ax", 1.0), ("bx", 0.0), ("az", 1.0), ("bz", 0.0))])


def cluster_levels(df: DataFrame, value: str, tol: float = 0.25, keys: Sequence[str] = tuple(K)) -> DataFrame:
    """K-04: one-dimensional clusters around a running mean, by centre.

    A step of more than ``tol`` always opens a cluster, so values are first cut at such
    steps; only the distinct positions inside one unbroken stretch are folded in order.
    """
    keys = list(keys)
    v = df.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("k")).withColumn("e", F.col("v"))
    isl = gap_islands(v, keys, ["v"], by_width("v", 64 * tol), "v", "e", gap=tol)
    g = isl.groupBy(*keys, "island").agg(F.array_sort(F.collect_list(F.struct("v", F.col("k").cast("double").alias("k")))).alias("_v"))
    # Fold: sum, count and start index of the open cluster; closed ones are appended.
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"), F.array().cast("array<struct<c:double,n:double>>").alias("out"))

    def step(a, x):
        joins = (a["n"] > 0) & (F.abs(x["v"] - a["s"] / a["n"]) <= tol)
        closed = F.when((a["n"] > 0) & ~joins, F.array_append(a["out"], F.struct((a["s"] / a["n"]).alias("c"), a["n"].alias("n")))).otherwise(a["out"])
        return F.struct(
            (F.when(joins, a["s"]).otherwise(0.0) + x["v"] * x["k"]).alias("s"),
            (F.when(joins, a["n"]).otherwise(0.0) + x["k"]).alias("n"), closed.alias("out"),
        )

    done = F.aggregate("_v", zero, step, lambda a: F.array_append(a["out"], F.struct((a["s"] / a["n"]).alias("c"), a["n"].alias("n"))))
    return g.select(*keys, F.explode(done).alias("_c")).select(*keys, F.col("_c.c").alias("center"), F.col("_c.n").cast("long").alias("n"))


def translation_edges(solution: DataFrame, placed: DataFrame, tol: float = 0.25) -> DataFrame:
    """K-03: align the smallest cluster centres of both axes."""
    m = lambda d, c: cluster_levels(d, c, tol).groupBy(*K).agg(F.min("center").alias(c))
    s = m(solution, "x").join(m(solution, "z"), K).select(*K, F.col("x").alias("sx"), F.col("z").alias("sz"))
    return s.join(m(placed, "x").join(m(placed, "z"), K), K).select(*K, (F.col("sx") - F.col("x")).alias("tx"), (F.col("sz") - F.col("z")).alias("tz"))


def infer_spacings(solution: DataFrame, tol: float = 0.25) -> DataFrame:
    """K-05: median gap of row (z) and column (x) centres."""
    def gaps(c, out):
        g = scan(cluster_levels(solution, c, tol), K, ["center"], by_width("center", 1000.0), {"_p": lag("center")})
        return quantiles(g.withColumn("_g", F.col("center") - F.col("_p")).where("_g is not null"), K, "_g", {out: 0.5})

    return solution.select(*K).distinct().join(gaps("z", "row_spacing"), K, "left").join(gaps("x", "intra_spacing"), K, "left")


PHASES = 61


def assign_rows(points: DataFrame, steps: DataFrame, tol: float = 0.25) -> DataFrame:
    """K-06: row number of each object for the phase with the smallest mean residual.

    ``steps``: layout_id, step. Every object meets the 61 candidate phases (a constant),
    reduced to one sum per layout and phase before the shuffle.
    """
    p = with_group_aggs(points, K, _lo=F.min("z"))
    p = attach(p, steps.where("step > 0"), K, "inner")
    ph = p.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(PHASES - 1))))
    phase = F.col("_lo") + F.col("_i") * F.col("step") / F.lit(PHASES - 1)
    res = F.abs(F.col("z") - phase - F.rint((F.col("z") - phase) / F.col("step")) * F.col("step"))
    best = ph.groupBy(*K, "_i").agg(F.round(F.avg(res), 12).alias("_r")).groupBy(*K).agg(F.min_by("_i", F.struct("_r", "_i")).alias("_i"))
    p = attach(p, best, K)
    k = F.rint((F.col("z") - phase) / F.col("step"))
    off = F.abs(F.col("z") - phase - k * F.col("step"))
    return p.withColumn("row", F.when(off <= tol, k.cast("long"))).drop("_lo", "_i", "step")


def alignment_rules(placed: DataFrame, solution: DataFrame, tol: float = 0.25, abs_tol: float = 0.15, rel_tol: float = 0.10) -> DataFrame:
    """K-07: seven alignment rules per layout.

    R1 at least two rows, R2 front row, R3 row spacing, R4 spacing inside rows, R5 right
    column, R6 equally filled rows, R7 left column not beyond the solution's.
    """
    sp = cut(infer_spacings(solution, tol))
    rows = cut(assign_rows(placed, sp.select(*K, F.col("row_spacing").alias("step")), tol).where("row is not null"))
    per = rows.groupBy(*K, "row").agg(F.avg("z").alias("c"), F.count("*").alias("n"))
    r16 = per.groupBy(*K).agg(F.count("*").alias("n_rows"), (F.min("n") == F.max("n")).alias("R6"))
    gz = scan(per, K, ["c"], by_width("c", 1000.0), {"_p": lag("c")}).withColumn("_g", F.col("c") - F.col("_p")).where("_g is not null")
    gx = scan(rows, [*K, "row"], ["x", "p_id"], by_width("x", 1000.0), {"_p": lag("x")}).withColumn("_g", F.col("x") - F.col("_p")).where("_g is not null")
    oz, ox = quantiles(gz, K, "_g", {"obs_row": 0.5}), quantiles(gx, K, "_g", {"obs_intra": 0.5})

    def ends(df, tag):
        a = cluster_levels(df, "x", tol).groupBy(*K).agg(F.min("center").alias(f"{tag}_x0"), F.max("center").alias(f"{tag}_x1"))
        b = cluster_levels(df, "z", tol).groupBy(*K).agg(F.max("center").alias(f"{tag}_z1"))
        return a.join(b, K)

    d = sp.join(r16, K, "left").join(oz, K, "left").join(ox, K, "left").join(ends(solution, "s"), K, "left").join(ends(placed, "p"), K, "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return d.select(
        *K,
        no(F.col("n_rows") >= 2).alias("R1"), no(F.abs(F.col("p_z1") - F.col("s_z1")) <= tol).alias("R2"),
        no((F.col("n_rows") >= 2) & within_tolerance(F.col("obs_row"), F.col("row_spacing"), abs_tol, rel_tol)).alias("R3"),
        no(within_tolerance(F.col("obs_intra"), F.col("intra_spacing"), abs_tol, rel_tol)).alias("R4"),
        no(F.abs(F.col("p_x1") - F.col("s_x1")) <= tol).alias("R5"), no(F.col("R6")).alias("R6"),
        no(F.col("p_x0") - F.col("s_x0") >= -tol).alias("R7"),
    )


def reservation_checks(solution: DataFrame, placed: DataFrame, matches: DataFrame, pos_tol: float, abs_tol: float, rel_tol: float) -> DataFrame:
    """K-08: per expected object: present, host, shape, plan size and thickness.

    Objects carry name, size_x, size_y, size_z. Plan sizes may be swapped; round objects
    compare sorted sizes (the same test, since both orders are tried).
    """
    s = solution.select(*K, "s_id", host_shape(F.col("name")).alias("eh"), *[F.col(f"size_{a}").alias(f"s_{a}") for a in "xyz"])
    p = placed.select(*K, "p_id", host_shape(F.col("name")).alias("gh"), *[F.col(f"size_{a}").alias(f"p_{a}") for a in "xyz"])
    d = s.join(matches, [*K, "s_id"], "left").join(p, [*K, "p_id"], "left")
    ok = F.coalesce(F.col("dist") <= pos_tol, F.lit(False))
    w = lambda a, b: within_tolerance(F.col(a), F.col(b), abs_tol, rel_tol)
    same = lambda f: F.coalesce(F.col(f"eh.{f}").isNull() | (F.col(f"eh.{f}") == F.col(f"gh.{f}")), F.lit(False))
    plan = (w("p_x", "s_x") & w("p_y", "s_y")) | (w("p_x", "s_y") & w("p_y", "s_x"))
    no = lambda c: F.coalesce(c, F.lit(False))
    return d.select(
        *K, "s_id", "p_id", ok.alias("present_ok"), (ok & same("host")).alias("host_ok"), (ok & same("shape")).alias("shape_ok"),
        no(ok & plan).alias("plan_ok"), no(ok & w("p_z", "s_z")).alias("thickness_ok"),
    )


def reservation_rules(checks: DataFrame, placed: DataFrame, allow_extra: int = 0) -> DataFrame:
    """K-08: six rules and the share of atomic constraints met."""
    i = lambda c: F.sum(F.col(c).cast("long"))
    g = checks.groupBy(*K).agg(
        F.count("*").alias("n_expected"), i("present_ok").alias("n_present"), i("host_ok").alias("_h"), i("shape_ok").alias("_s"), i("plan_ok").alias("_p"), i("thickness_ok").alias("_t")
    )
    g = g.join(placed.groupBy(*K).agg(F.count("*").alias("n_placed")), K, "left").na.fill(0, ["n_placed"])
    all_ = lambda c: (F.col("n_present") > 0) & (F.col(c) == F.col("n_present"))
    met = F.col("n_present") + F.col("_h") + F.col("_s") + F.col("_p") + F.col("_t")
    return g.select(
        *K, (F.col("n_present") == F.col("n_expected")).alias("R1"), (F.col("n_placed") - F.col("n_present") <= allow_extra).alias("R2"),
        all_("_h").alias("R3"), all_("_s").alias("R4"), all_("_p").alias("R5"), all_("_t").alias("R6"),
        (100.0 * met / (5 * F.col("n_expected"))).alias("constraint_score"),
    )


def placement_report(solution: DataFrame, placed: DataFrame, matches: DataFrame, tol_m: float) -> DataFrame:
    """K-09: expected, placed, matched, missing and extra objects, summed distance."""
    n = solution.groupBy(*K).agg(F.count("*").alias("n_expected")).join(placed.groupBy(*K).agg(F.count("*").alias("n_placed")), K, "outer")
    m = matches.groupBy(*K).agg(
        F.count("*").alias("n_matched"), F.sum((F.col("dist") <= tol_m).cast("long")).alias("n_within"), F.sum("dist").alias("sum_distance_m"), F.max("dist").alias("max_distance_m")
    )
    d = n.join(m, K, "left").na.fill(0, ["n_expected", "n_placed", "n_matched", "n_within", "sum_distance_m"])
    return d.withColumn("n_missing", F.col("n_expected") - F.col("n_matched")).withColumn("n_extra", F.col("n_placed") - F.col("n_matched"))


MAX_TASK_S = 1500.0


def duration_seconds(df: DataFrame, sources: Sequence[str], cap_s: float = MAX_TASK_S, out: str = "duration_s") -> DataFrame:
    """K-10: first available duration of the layout, capped; one that is not positive counts as the cap."""
    g = df.groupBy(*K).agg(*[F.max(c).alias(c) for c in sources]).withColumn("_d", F.coalesce(*sources))
    return g.select(*K, F.when(F.col("_d") <= 0, F.lit(float(cap_s))).when(F.col("_d").isNotNull(), F.least("_d", F.lit(float(cap_s)))).alias(out))


# Weights of rules, count, precision and time in the task score.
WEIGHTS = (0.5, 0.0, 0.5, 0.0)


def task_score(df: DataFrame, tol_m: float = 0.8, tref_s: float = MAX_TASK_S) -> DataFrame:
    """K-11: M1 rules, M2 count (F1), M3 precision, M4 time and their weighted score."""
    lim = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))
    tp = F.greatest(F.coalesce("n_matched", F.lit(0)), F.lit(0))
    fp, fn = F.greatest(F.coalesce("n_placed", F.lit(0)) - tp, F.lit(0)), F.greatest(F.coalesce("n_expected", F.lit(0)) - tp, F.lit(0))
    m1 = F.coalesce(100.0 * F.try_divide(F.col("n_rules_passed").cast("double"), F.when(F.col("n_rules_total") > 0, F.col("n_rules_total"))), F.lit(0.0))
    m2 = F.coalesce(100.0 * F.try_divide((2 * tp).cast("double"), 2 * tp + fp + fn), F.lit(0.0))
    m3 = F.coalesce(F.when(tp > 0, 100.0 * F.exp(-F.col("sum_distance_m") / tp / F.lit(tol_m))), F.lit(0.0))
    m4 = F.coalesce(100.0 * (1.0 - clip(F.col("duration_s"), 0.0, tref_s) / tref_s), F.lit(0.0))
    d = df.select("*", lim(m1).alias("M1"), lim(m2).alias("M2"), lim(m3).alias("M3"), lim(m4).alias("M4"))
    return d.withColumn("score", lim(sum((F.col(f"M{i + 1}") * F.lit(w) for i, w in enumerate(WEIGHTS)), F.lit(0.0))))


def score_layouts(solution: DataFrame, placed: DataFrame, durations: DataFrame, tol_m: float = 0.8) -> DataFrame:
    """K-12: one recap row per layout: rules, match, time, score; all layouts in one run."""
    m = match_greedy(solution, placed)
    rep = placement_report(solution, placed, m, tol_m)
    rules = alignment_rules(placed, solution)
    names = [f"R{i}" for i in range(1, 8)]
    passed = sum((F.col(r).cast("int") for r in names), F.lit(0))
    d = rep.join(rules.select(*K, passed.alias("n_rules_passed"), F.lit(len(names)).alias("n_rules_total")), K, "left").join(durations, K, "left")
    return task_score(d, tol_m)
