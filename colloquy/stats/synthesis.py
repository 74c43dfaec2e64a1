"""Result tables that combine several statistics (P-52 to P-59, E-15, A-27)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.operators import aggregates as ag, keys as ky
from colloquy.operators.scan import attach
from colloquy.session import cut

from . import models as md, moments as mo, resample as rs


def analysis_summary(df: DataFrame, ids: Sequence[str], max_missing: float) -> DataFrame:
    """A-27: number of features at each selection step: all candidates, then those with few missing values."""
    s = ky.select_features(df, ids, max_missing).agg(F.count("*").cast("int").alias("candidates"), F.sum(F.col("selected").cast("int")).cast("int").alias("few_missing"))
    return s.select(F.expr("stack(2, 'candidates', candidates, 'few_missing', few_missing) AS (step, n_features)"))


def indicator_correlations(df: DataFrame, columns: Sequence[str], against: Sequence[str] | None = None) -> DataFrame:
    """E-15: correlation of every pair of indicators, or of every indicator with each of ``against``."""
    pairs = [(a, b) for a in columns for b in against if a != b] if against else [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    return mo.pearson_by(mo.pair_rows(df, [], pairs), ["x", "y"], "vx", "vy")


def multilevel_synthesis(responses: DataFrame, dimension: str, group: str, value: str, context: DataFrame | None = None) -> DataFrame:
    """P-52: per dimension the number of groups, mean and spread of their means, mean spread inside, ICC(1).

    ICC(1) comes from the mean squares between and within groups with the average group size corrected for unequal
    groups. With ``context`` (group, numeric columns) the correlation of the group means with each column follows as
    ``r_<column>``.
    """
    g = responses.groupBy(dimension, group).agg(F.count(value).alias("_k"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_sd"), F.var_pop(value).alias("_v"))
    k, m = F.col("_k"), F.col("_m")
    extra: list[Column] = []
    if context is not None:
        names = [c for c in context.columns if c != group]
        g = g.join(context, group, "left")
        extra = [F.corr(m, F.col(c).cast("double")).alias(f"r_{c}") for c in names]
    s = g.groupBy(dimension).agg(
        F.count("*").alias("n_groups"), F.avg(m).alias("mean_of_means"), F.stddev_samp(m).alias("sd_of_means"), F.avg("_sd").alias("mean_sd"),
        F.sum(k).alias("_n"), F.sum(k * k).alias("_kk"), F.sum(k * m).alias("_s"), F.sum(k * m * m).alias("_ss"), F.sum(k * F.col("_v")).alias("_w"), *extra,
    )
    n, groups = F.col("_n"), F.col("n_groups")
    between = F.try_divide(F.col("_ss") - F.col("_s") * F.col("_s") / n, groups - 1)
    within = F.try_divide(F.col("_w"), n - groups)
    size = F.try_divide(n - F.col("_kk") / n, groups - 1)
    icc = F.try_divide(between - within, between + (size - 1) * within)
    return s.select(dimension, "n_groups", "mean_of_means", "sd_of_means", "mean_sd", icc.alias("icc1"), *[c for c in s.columns if c.startswith("r_")])


def rank_delta(df: DataFrame, unit: str, before: str, after: str) -> DataFrame:
    """P-53: rank of each unit by two scores (1 is the highest, ties share the best rank) and the change."""
    d = df.select(unit, before, after)
    r = ag.rank_min_desc(cut(ag.rank_min_desc(d, [], before, "rank_a")), [], after, "rank_b")
    return r.select(unit, "rank_a", "rank_b", (F.col("rank_b") - F.col("rank_a")).alias("delta"))


def significance_switches(correlations: DataFrame, raw: str = "p", corrected: str = "p_fdr", level: float = 0.05) -> DataFrame:
    """P-54: which results lose or gain significance between two p-values of one table."""
    a, b = F.col(raw) < level, F.col(corrected) < level
    return correlations.withColumn("change", F.when(a & ~b, "lost").when(~a & b, "gained").otherwise("same"))


def familiarity_models(df: DataFrame, outcome: str, familiarity: str, covariates: Sequence[str] = ()) -> DataFrame:
    """P-56: outcome on familiarity alone, and with each covariate, and with all of them; the familiarity row of each model."""
    sets = {"alone": [], **{f"with_{c}": [c] for c in covariates}, **({"with_all": list(covariates)} if len(covariates) > 1 else {})}
    out = None
    for name, more in sets.items():
        row = md.ols(df, outcome, [familiarity, *more]).where(F.col("term") == familiarity).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def index_validity(df: DataFrame, unit: str, index: str, items: Sequence[str], outcomes: Sequence[str], replicates: int = 1000) -> DataFrame:
    """P-57: consistency of an index's items, and its correlation metrics with each outcome.

    ``alpha`` is Cronbach's alpha over complete rows: k/(k-1) times one less the summed item variances over the
    variance of the sum.
    """
    k = len(items)
    total = sum((F.col(c) for c in items), F.lit(0.0))
    d = df.where(" and ".join(f"`{c}` is not null" for c in items))
    parts = sum((F.var_samp(c) for c in items), F.lit(0.0))
    alpha = d.agg((F.lit(k / (k - 1.0)) * (1.0 - F.try_divide(parts, F.var_samp(total)))).alias("alpha")) if k > 1 else d.agg(F.lit(None).cast("double").alias("alpha"))
    long = ag.melt(df.select(F.col(unit).alias("unit"), F.col(index).cast("double").alias("x"), *[F.col(c).cast("double").alias(c) for c in outcomes]), ["unit", "x"], list(outcomes), "outcome", "y")
    return attach(rs.correlation_metrics(long, ["outcome"], replicates), alpha, [])


def collect_correlations(blocks: Mapping[str, DataFrame], digits: int = 6) -> DataFrame:
    """P-58: rank correlations of several blocks of pairs in one table; of equal results for one outcome the first name stays.

    Each block has x, y (names) and vx, vy (values).
    """
    out = None
    for name, pairs in blocks.items():
        s = mo.spearman_by(pairs, ["x", "y"], "vx", "vy")
        s = s.select(F.lit(name).alias("block"), "x", "y", "n", F.round("rho", digits).alias("rho"), F.round(rs.correlation_p(F.col("rho"), F.col("n")), digits).alias("p"))
        out = s if out is None else out.unionByName(s)
    first = out.groupBy("y", "rho", "p", "n").agg(F.min(F.struct("x", "block")).alias("_f"))
    return first.select(F.col("_f.block").alias("block"), F.col("_f.x").alias("x"), "y", "n", "rho", "p")


def score_agreement(df: DataFrame, unit: str, a: str, b: str) -> DataFrame:
    """P-59: agreement of two scorings: Pearson, Spearman, mean and largest change of rank."""
    d = F.abs("delta")
    m = rank_delta(df, unit, a, b).agg(F.avg(d).alias("rank_delta_mean"), F.max(d).alias("rank_delta_max"))
    p = mo.pearson_by(df, [], a, b, out="pearson")
    s = mo.spearman_by(df, [], a, b, out="spearman").drop("n")
    return attach(attach(p, s, []), m, [])
