"""Group comparisons (P-39, P-42, P-55) from moments and tie-averaged ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from colloquy.operators.scan import average_rank, quantiles, attach, with_group_aggs
from .dist import chi2_p_value, f_p_value, normal_cdf, t_p_value, t_quantile
from .moments import spearman_by


def _two(df: DataFrame, keys: Sequence[str], group: str, value: str, a, b) -> DataFrame:
    agg = []
    for n, lvl in (("a", a), ("b", b)):
        v = F.when(F.col(group) == lvl, F.col(value))
        agg += [F.count(v).alias(f"n_{n}"), F.avg(v).alias(f"mean_{n}"), F.var_samp(v).alias(f"var_{n}")]
    return df.groupBy(*keys).agg(*agg)


def welch_t(df: DataFrame, keys: Sequence[str], group: str, value: str, a, b) -> DataFrame:
    """Welch t, degrees of freedom and p, with Cohen's d on the pooled sd."""
    g = _two(df, keys, group, value, a, b)
    sa, sb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(sa + sb))
    nu = F.try_divide((sa + sb) * (sa + sb), sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1))
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2)
    g = g.where("n_a >= 2 and n_b >= 2").withColumn("t", t).withColumn("df", nu)
    return g.withColumn("cohen_d", F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(pooled))).withColumn("p", t_p_value("t", "df"))


def mann_whitney(df: DataFrame, keys: Sequence[str], group: str, value: str, a, b) -> DataFrame:
    """U of the first group, tie-corrected normal p with continuity, r and rank-biserial."""
    keys = list(keys)
    d = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    r = average_rank(d, keys, value, "_r")
    first = F.col(group) == a
    g = r.groupBy(*keys).agg(
        F.sum(first.cast("long")).alias("n_a"), F.sum((~first).cast("long")).alias("n_b"), F.sum(F.when(first, F.col("_r"))).alias("_ra"),
        # A row of a tie of k adds k^2 - 1, which sums to k^3 - k per tie.
        F.sum(F.col("_r_ties") ** 2 - 1).alias("_tie"),
    )
    na, nb = F.col("n_a"), F.col("n_b")
    n = na + nb
    u = F.col("_ra") - na * (na + 1) / 2.0
    var = na * nb / 12.0 * ((n + 1) - F.col("_tie") / (n * (n - 1)))
    z = F.try_divide(F.greatest(F.abs(u - na * nb / 2.0) - 0.5, F.lit(0.0)), F.sqrt(var))
    g = g.withColumn("u", u).withColumn("z", z)
    return g.withColumn("p", F.least(2.0 * normal_cdf(-F.col("z")), F.lit(1.0))).select(
        *keys, "n_a", "n_b", "u", "z", (F.col("z") / F.sqrt(n)).alias("r"), (2.0 * F.col("u") / (na * nb) - 1.0).alias("rank_biserial"), "p"
    )


def wilcoxon_signed(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Signed ranks of paired differences (zeros dropped), tie-corrected normal p."""
    keys = list(keys)
    d = df.withColumn("_d", F.col(x) - F.col(y)).where("_d is not null and _d != 0").withColumn("_a", F.abs("_d"))
    r = average_rank(d, keys, "_a", "_r")
    g = r.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(F.col("_r_ties") ** 2 - 1).alias("_tie")
    )
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_tie") / 48.0
    w_minus = n * (n + 1) / 2.0 - F.col("w_plus")
    g = g.withColumn("w", F.least("w_plus", w_minus)).withColumn("z", F.try_divide(F.col("w") - n * (n + 1) / 4.0, F.sqrt(var)))
    return g.withColumn("p", F.least(2.0 * normal_cdf("z"), F.lit(1.0))).select(*keys, "n", "w_plus", "w", "z", "p")


def kruskal(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H corrected for ties."""
    keys = list(keys)
    r = average_rank(df.where(F.col(value).isNotNull() & F.col(group).isNotNull()), keys, value, "_r")
    g = r.groupBy(*keys, group).agg(F.count("*").alias("_n"), F.sum("_r").alias("_s"), F.sum(F.col("_r_ties") ** 2 - 1).alias("_t"))
    s = g.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count("*").alias("k"), F.sum(F.col("_s") ** 2 / F.col("_n")).alias("_q"), F.sum("_t").alias("_t"))
    n = F.col("n")
    h = (12.0 / (n * (n + 1)) * F.col("_q") - 3.0 * (n + 1)) / (1.0 - F.col("_t") / (n * n * n - n))
    s = s.where("k >= 2").withColumn("h", h)
    return s.withColumn("p", chi2_p_value("h", F.col("k") - 1)).select(*keys, "n", "k", "h", "p")


def anova_oneway(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """One-way F with eta squared."""
    keys = list(keys)
    d = with_group_aggs(df.where(F.col(value).isNotNull() & F.col(group).isNotNull()), keys, _g=F.avg(value)).withColumn("_x", F.col(value) - F.col("_g"))
    g = d.groupBy(*keys, group).agg(F.count("*").alias("_n"), F.avg("_x").alias("_m"), F.var_pop("_x").alias("_v"))
    s = g.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.count("*").alias("k"), F.sum(F.col("_n") * F.col("_m") ** 2).alias("_b"), F.sum(F.col("_n") * F.col("_v")).alias("_w")
    ).where("k >= 2 and n > k")
    f = F.try_divide(F.col("_b") / (F.col("k") - 1), F.col("_w") / (F.col("n") - F.col("k")))
    s = s.withColumn("f", f).withColumn("eta2", F.try_divide(F.col("_b"), F.col("_b") + F.col("_w")))
    return s.withColumn("p", f_p_value("f", F.col("k") - 1, F.col("n") - F.col("k"))).select(*keys, "n", "k", "f", "eta2", "p")


def levene(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Median-centred test of equal spread: one-way F of absolute deviations."""
    keys = list(keys)
    d = df.where(F.col(value).isNotNull())
    med = quantiles(d, [*keys, group], value, {"_med": 0.5})
    d = attach(d, med, [*keys, group]).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    return anova_oneway(d, keys, group, "_dev").drop("eta2").withColumnRenamed("f", "w")


def stratified_spearman(df: DataFrame, keys: Sequence[str], strata: str, x: str, y: str, a, b) -> DataFrame:
    """P-42: rank correlation per level and the difference between two levels."""
    r = spearman_by(df, [*keys, strata], x, y)
    p = lambda lvl, n: F.max(F.when(F.col(strata) == lvl, F.col("rho"))).alias(n)
    return r.groupBy(*keys).agg(p(a, "rho_a"), p(b, "rho_b")).withColumn("delta_rho", F.col("rho_a") - F.col("rho_b"))


def cell_means_ci(df: DataFrame, keys: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """P-55: mean with a t interval per cell."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    g = g.withColumn("_q", t_quantile(F.lit(1 - (1 - level) / 2), F.when(F.col("n") > 1, F.col("n") - 1)))
    half = F.col("_q") * F.col("sd") / F.sqrt("n")
    return g.select(*keys, "n", "mean", "sd", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))
