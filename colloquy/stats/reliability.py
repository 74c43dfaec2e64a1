"""Reliability and agreement of item answers (P-13 to P-19, P-62).

Input is long: one row per participant and item, ``participant, dimension, item, score``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from colloquy.operators.scan import attach, with_group_aggs
from .moments import pearson_by


def _cells(df: DataFrame, keys: Sequence[str], na: str) -> DataFrame:
    """Mean per participant and item; ``listwise`` keeps participants with every item."""
    c = df.where("score is not null").groupBy(*keys, "participant", "item").agg(F.avg("score").alias("score"))
    var = c.groupBy(*keys, "item").agg(F.var_samp("score").alias("_v")).where("_v > 0")
    c = attach(c, var, [*keys, "item"], "inner").drop("_v")
    if na == "listwise":
        k = var.groupBy(*keys).agg(F.count("*").alias("_k"))
        full = c.groupBy(*keys, "participant").agg(F.count("*").alias("_c"))
        full = attach(full, k, keys, "inner").where("_c = _k").select(*keys, "participant")
        c = c.join(full, [*keys, "participant"], "left_semi")
    return c


def cronbach_alpha(df: DataFrame, keys: Sequence[str] = ("dimension",), na: str = "pairwise0", min_n: int = 2) -> DataFrame:
    """P-13: alpha and standardised alpha per dimension; constant items are left out.

    ``pairwise0`` uses every answer for item variances and lets missing answers add
    nothing to a participant's total; ``listwise`` drops incomplete participants.
    """
    keys = list(keys)
    c = _cells(df, keys, na)
    items = c.groupBy(*keys, "item").agg(F.var_samp("score").alias("_v"), F.count("*").alias("_n"))
    iv = items.groupBy(*keys).agg(F.count("*").alias("n_items"), F.sum("_v").alias("_sv"))
    tot = c.groupBy(*keys, "participant").agg(F.sum("score").alias("_t"))
    tv = tot.groupBy(*keys).agg(F.var_samp("_t").alias("_tv"), F.count("*").alias("n"))
    k = F.col("n_items")
    alpha = F.when((k >= 2) & (F.col("n") >= min_n) & (F.col("_tv") > 0), k / (k - 1) * (1 - F.col("_sv") / F.col("_tv")))
    return iv.join(tv, keys).select(*keys, "n_items", "n", alpha.alias("alpha"))


def standardised_alpha(df: DataFrame, keys: Sequence[str] = ("dimension",)) -> DataFrame:
    """P-13: alpha from the mean inter-item correlation: that of z-scored items."""
    keys = list(keys)
    c = _cells(df, keys, "listwise")
    z = with_group_aggs(c, [*keys, "item"], _m=F.avg("score"), _s=F.stddev_samp("score"))
    z = z.withColumn("score", (F.col("score") - F.col("_m")) / F.col("_s")).drop("_m", "_s")
    return cronbach_alpha(z, keys).withColumnRenamed("alpha", "alpha_std")


def item_statistics(df: DataFrame, keys: Sequence[str] = ("dimension",), na: str = "pairwise0") -> DataFrame:
    """P-14: n, mean, sd, corrected item-total correlation, alpha without the item."""
    keys = list(keys)
    c = _cells(df, keys, na)
    s = c.groupBy(*keys, "item").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), F.var_samp("score").alias("_v")
    )
    t = c.groupBy(*keys, "participant").agg(F.sum("score").alias("_t"))
    j = c.join(t, [*keys, "participant"]).withColumn("_rest", F.col("_t") - F.col("score"))
    r = pearson_by(j, [*keys, "item"], "score", "_rest", 3, "r_drop").drop("n")
    # Total without the item over all participants: those who skipped it keep their total,
    # so its variance follows from sums over answers and sums over totals.
    d = with_group_aggs(t, keys, _mt=F.avg("_t")).withColumn("_t", F.col("_t") - F.col("_mt"))
    n = d.groupBy(*keys).agg(F.count("*").alias("_np"), F.sum(F.col("_t") ** 2).alias("_st2"))
    q = c.join(d, [*keys, "participant"]).groupBy(*keys, "item").agg(
        F.sum("score").alias("_sx"), F.sum(F.col("score") ** 2).alias("_sx2"), F.sum(F.col("score") * F.col("_t")).alias("_sxt")
    )
    allv = s.groupBy(*keys).agg(F.sum("_v").alias("_sv"), F.count("*").alias("_k"))
    o = s.join(r, [*keys, "item"]).join(q, [*keys, "item"])
    o = attach(attach(o, n, keys, "inner"), allv, keys, "inner")
    k = F.col("_k") - 1
    ss = F.col("_st2") - 2 * F.col("_sxt") + F.col("_sx2") - F.col("_sx") * F.col("_sx") / F.col("_np")
    rest_var = ss / (F.col("_np") - 1)
    a = F.when((k >= 2) & (rest_var > 0), k / (k - 1) * (1 - (F.col("_sv") - F.col("_v")) / rest_var))
    return o.select(*keys, "item", "n", "mean", "sd", "r_drop", a.alias("alpha_if_deleted"))


def prune_by_rdrop(df: DataFrame, rdrop: float = 0.3, alpha_ok: float = 0.7) -> DataFrame:
    """P-15: weak items with the decision to drop them and the reason when kept."""
    st = item_statistics(df)
    al = cronbach_alpha(df).select("dimension", "alpha")
    weak = F.col("r_drop").isNull() | (F.col("r_drop") < rdrop)
    s = attach(st, al, ["dimension"])
    s = with_group_aggs(s, ["dimension"], _k=F.count("*"), _b=F.sum(weak.cast("long"))).where(weak)
    reason = F.when(F.col("alpha") >= alpha_ok, "alpha acceptable").when(F.col("_k") - F.col("_b") < 2, "too few items left")
    return s.select("dimension", "item", "r_drop", "alpha", reason.isNull().alias("drop"), reason.alias("kept_because"))


def covariances(df: DataFrame) -> DataFrame:
    """Covariance of the zero-filled deviations and variance of each item, per dimension.

    A participant answers a questionnaire-sized list of items; the pairs formed here are
    pairs of items of one answer sheet.
    """
    keys = ["dimension"]
    c = _cells(df, keys, "pairwise0")
    n = c.select(*keys, "participant").distinct().groupBy(*keys).agg(F.count("*").alias("_np"))
    iv = c.groupBy(*keys, "item").agg(F.var_samp("score").alias("v"), F.sum("score").alias("s"))
    sheet = c.groupBy(*keys, "participant").agg(F.collect_list(F.struct("item", "score")).alias("_a"))
    p = sheet.select(*keys, F.explode("_a").alias("a"), "_a").select(*keys, "a", F.explode("_a").alias("b"))
    p = p.groupBy(*keys, F.col("a.item").alias("i"), F.col("b.item").alias("j")).agg(F.sum(F.col("a.score") * F.col("b.score")).alias("sp"))
    l = iv.select(*keys, F.col("item").alias("i"), F.col("v").alias("vi"), F.col("s").alias("si"))
    r = iv.select(*keys, F.col("item").alias("j"), F.col("s").alias("sj"))
    o = l.join(r, keys).join(p, [*keys, "i", "j"], "left").na.fill(0.0, ["sp"]).join(n, keys)
    cov = (F.col("sp") - F.col("si") * F.col("sj") / F.col("_np")) / (F.col("_np") - 1)
    return o.select(*keys, "i", "j", "vi", cov.alias("cov"))


def prune_greedy(df: DataFrame, min_items: int = 2) -> DataFrame:
    """P-16: remove the item that raises alpha most, until none does.

    Spark reduces all answers to one item-by-item matrix per dimension; the greedy steps
    then only touch that questionnaire-sized matrix.
    """

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="i", columns="j", values="cov").sort_index(axis=0).sort_index(axis=1)
        v = pdf.groupby("i")["vi"].first().sort_index().to_numpy()
        c, names = m.to_numpy(), list(m.index)
        left = list(range(len(names)))

        def alpha(ix):
            k, total = len(ix), c[np.ix_(ix, ix)].sum()
            return k / (k - 1) * (1 - v[ix].sum() / total) if k >= 2 and total > 0 else None

        rows, cur = [], alpha(left)
        while len(left) > min_items:
            trial = [(alpha([i for i in left if i != x]), names[x], x) for x in left]
            better = [z for z in trial if z[0] is not None and (cur is None or z[0] > cur)]
            if not better:
                break
            best = min(better, key=lambda z: (-z[0], z[1]))
            rows.append((pdf["dimension"].iloc[0], len(rows) + 1, best[1], cur, best[0]))
            left.remove(best[2])
            cur = best[0]
        return pd.DataFrame(rows, columns=["dimension", "step", "item", "alpha_before", "alpha_after"])

    return covariances(df).groupBy("dimension").applyInPandas(
        steps, "dimension string, step int, item string, alpha_before double, alpha_after double"
    )


def anova_table(df: DataFrame, keys: Sequence[str], target: str, rater: str, value: str) -> DataFrame:
    """Sums of squares of a complete targets x raters table, from means and squares."""
    keys = list(keys)
    c = df.groupBy(*keys, target, rater).agg(F.avg(value).alias("_x"))
    k = c.select(*keys, rater).distinct().groupBy(*keys).agg(F.count("*").alias("k"))
    n_t = c.where("_x is not null").groupBy(*keys, target).agg(F.count("*").alias("_c"))
    full = attach(n_t, k, keys, "inner").where("_c = k").select(*keys, target)
    c = c.join(full, [*keys, target], "left_semi")
    c = with_group_aggs(c, keys, _g=F.avg("_x")).withColumn("_x", F.col("_x") - F.col("_g")).drop("_g")
    tot = c.groupBy(*keys).agg(F.sum(F.col("_x") ** 2).alias("ss_total"))
    t = c.groupBy(*keys, target).agg(F.avg("_x").alias("_m")).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("_m") ** 2).alias("_tm"))
    r = c.groupBy(*keys, rater).agg(F.avg("_x").alias("_m")).groupBy(*keys).agg(F.sum(F.col("_m") ** 2).alias("_rm"))
    o = tot.join(t, keys).join(r, keys).join(k, keys) if keys else attach(attach(attach(tot, t, []), r, []), k, [])
    return o.select(
        *keys, "n", "k", "ss_total", (F.col("k") * F.col("_tm")).alias("ss_targets"), (F.col("n") * F.col("_rm")).alias("ss_raters")
    )


def icc(df: DataFrame, keys: Sequence[str], target: str, rater: str, value: str) -> DataFrame:
    """P-17: ICC(1), ICC(2,1) and ICC(2,k); NULL with fewer than two targets or raters."""
    a = anova_table(df, keys, target, rater, value)
    n, k = F.col("n"), F.col("k")
    mst = F.col("ss_targets") / (n - 1)
    msr = F.col("ss_raters") / (k - 1)
    mse = (F.col("ss_total") - F.col("ss_targets") - F.col("ss_raters")) / ((n - 1) * (k - 1))
    msw = (F.col("ss_total") - F.col("ss_targets")) / (n * (k - 1))

    def ratio(num, den):
        v = F.when((n >= 2) & (k >= 2) & (F.abs(den) >= 1e-12), num / den)
        return F.when(F.abs(v) < 1e-12, 0.0).when(F.abs(v) <= 1e6, v)

    return a.where("n >= 2 and k >= 2").select(
        *keys, "n", "k",
        ratio(mst - msw, mst + (k - 1) * msw).alias("icc1"),
        ratio(mst - mse, mst + (k - 1) * mse + k * (msr - mse) / n).alias("icc21"),
        ratio(mst - mse, mst + (msr - mse) / n).alias("icc2k"),
    )


def variance_components(df: DataFrame, group: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """P-17 / P-44: between and within variance of an unbalanced one-way layout (moments)."""
    keys = list(keys)
    d = with_group_aggs(df.where(F.col(value).isNotNull()), keys, _g=F.avg(value)).withColumn("_x", F.col(value) - F.col("_g"))
    g = d.groupBy(*keys, group).agg(F.count("*").alias("_n"), F.avg("_x").alias("_m"), F.var_pop("_x").alias("_v"))
    s = g.groupBy(*keys).agg(
        F.count("*").alias("n_groups"), F.sum("_n").alias("n"), F.sum(F.col("_n") ** 2).alias("_n2"),
        F.sum(F.col("_n") * F.col("_m") ** 2).alias("ssb"), F.sum(F.col("_n") * F.col("_v")).alias("ssw"),
    )
    msb = F.col("ssb") / (F.col("n_groups") - 1)
    msw = F.col("ssw") / (F.col("n") - F.col("n_groups"))
    n0 = (F.col("n") - F.col("_n2") / F.col("n")) / (F.col("n_groups") - 1)
    between = F.greatest((msb - msw) / n0, F.lit(0.0))
    return s.where((F.col("n_groups") > 1) & (F.col("n") > F.col("n_groups"))).select(
        *keys, "n", "n_groups", msb.alias("ms_between"), msw.alias("ms_within"), n0.alias("n0"),
        between.alias("var_between"), msw.alias("var_within"), F.try_divide(between, between + msw).alias("icc1"),
    )


def rwg_j(df: DataFrame, keys: Sequence[str], rater: str, item: str, value: str, categories: int = 9) -> DataFrame:
    """P-18: within-group agreement of a block of items, kept in [0, 1].

    Only items answered by every rater of the group count.
    """
    keys = list(keys)
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, item, rater).agg(F.avg(value).alias("_x"))
    nr = c.select(*keys, rater).distinct().groupBy(*keys).agg(F.count("*").alias("n_raters"))
    v = c.groupBy(*keys, item).agg(F.var_samp("_x").alias("_v"), F.count("*").alias("_c"))
    v = attach(v, nr, keys, "inner").where("_c = n_raters")
    g = v.groupBy(*keys).agg(F.avg("_v").alias("_ov"), F.count("*").alias("n_items"), F.max("n_raters").alias("n_raters"))
    q = F.col("_ov") / F.lit((categories**2 - 1) / 12.0)
    j = F.col("n_items")
    w = F.try_divide(j * (1 - q), j * (1 - q) + q)
    ok = (F.col("n_raters") >= 2) & (F.abs(j * (1 - q) + q) >= 1e-12)
    sc = c.join(v.select(*keys, item), [*keys, item], "left_semi").groupBy(*keys, rater).agg(F.avg("_x").alias("_s"))
    sc = sc.groupBy(*keys).agg((F.max("_s") - F.min("_s")).alias("score_range"), F.stddev_samp("_s").alias("score_sd"))
    return g.join(sc, keys).select(
        *keys, "n_raters", "n_items", F.when(ok, F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0))).alias("rwg_j"), "score_range", "score_sd"
    )


def agreement_summary(rwg: DataFrame, threshold: float = 0.7) -> DataFrame:
    """P-18: decision per unit and overall counts."""
    ok = F.col("rwg_j") >= threshold
    return rwg.agg(
        F.count("rwg_j").alias("n_units"), F.sum(ok.cast("long")).alias("n_agree"), F.avg("rwg_j").alias("rwg_mean"),
        F.avg(ok.cast("double")).alias("share_agree"),
    )


def filter_by_agreement(df: DataFrame, rwg: DataFrame, keys: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """P-19: keep units whose agreement reaches the threshold."""
    return df.join(rwg.where(F.col("rwg_j") >= threshold).select(*keys), list(keys), "left_semi")
