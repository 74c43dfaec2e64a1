"""Fusion of modality tables and composite indices (C-01 to C-19, J-01 to J-03)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.scalars import clip, ratio_eps, sqrt_clipped

from .aggregates import melt, zscore_within
from .face import row_mean
from .keys import coalesce_with_source, median_split
from .scan import attach, with_group_aggs

KEYS = ["group_id", "condition", "scenario", "timepoint"]


def fuse(tables: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """J-01: full outer join of the modality tables; the keys of either side survive."""
    return reduce(lambda a, b: a.join(b, list(keys), "outer"), tables)


def merge_on_unit(a: DataFrame, b: DataFrame, group: str = "group_id", time: str = "timepoint", how: str = "left") -> DataFrame:
    """J-02: join on (group, timepoint) when both sides know timepoints, else on the group.

    One small aggregate per side decides; the choice is a schema matter of the sources.
    """
    real = lambda d: time in d.columns and not d.where(F.upper(F.col(time)).isin("T1", "T2")).limit(1).isEmpty()
    keys = [group, time] if real(a) and real(b) else [group]
    right = b if time in keys or time not in b.columns else b.drop(time)
    return a.join(right, keys, how)


def pair_means(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """C-01: null-skipping mean over the pair columns of each measure."""
    have = set(df.columns)
    cols = {n: [F.col(c) for c in cs if c in have] for n, cs in groups.items()}
    return df.select("*", *[(row_mean(cs) if cs else F.lit(None).cast("double")).alias(n) for n, cs in cols.items()])


def contrasts(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """C-01: difference and ratio of two measures."""
    return df.withColumn(f"{name}_balance", F.col(a) - F.col(b)).withColumn(f"{name}_ratio", ratio_eps(F.col(a), F.col(b)))


def reference_rates(df: DataFrame, duration: str, fallback: str, counts: Sequence[str], totals: Sequence[str], tolerance_s: float = 5.0) -> DataFrame:
    """C-02: per-minute rates and duration ratios on one reference duration.

    Rows whose two durations differ by more than ``tolerance_s`` are flagged.
    """
    ref = F.coalesce(duration, fallback)
    d = df.withColumn("interaction_dur_s_ref", ref)
    gap = F.abs(F.col(duration) - F.col(fallback)) > tolerance_s
    d = d.withColumn("duration_mismatch", F.coalesce(gap, F.lit(False)))
    for c in counts:
        d = d.withColumn(f"{c}_rate_per_min_ref", ratio_eps(F.col(c), F.col("interaction_dur_s_ref") / 60.0))
    for c in totals:
        d = d.withColumn(f"{c}_ratio_ref", ratio_eps(F.col(c), F.col("interaction_dur_s_ref")))
    return d


def weighted_index(df: DataFrame, name: str, weights: Mapping[str, float], on_missing: str = "null") -> DataFrame:
    """C-04: weighted sum of columns; a missing term nulls the index, or is skipped.

    Every listed term must exist: a misspelt term is an error, not a silent omission.
    """
    absent = [c for c in weights if c not in df.columns]
    if absent:
        raise ValueError(f"{name}: missing columns {absent}")
    terms = [F.col(c) * F.lit(float(w)) for c, w in weights.items()]
    if on_missing == "skip":
        n = sum((t.isNotNull().cast("int") for t in terms), F.lit(0))
        v = F.when(n > 0, sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0)))
    else:
        v = reduce(lambda a, b: a + b, terms)
    return df.withColumn(name, v)


def weights_table(spark, specs: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """C-04: the weights used, for the audit output."""
    rows = [(i, t, float(w)) for i, ws in specs.items() for t, w in ws.items()]
    return spark.createDataFrame(rows, "index_name string, term string, weight double")


def mean_index(df: DataFrame, name: str, signs: Mapping[str, float]) -> DataFrame:
    """C-05: null-skipping mean of signed columns."""
    return df.withColumn(name, row_mean([F.col(c) * F.lit(float(s)) for c, s in signs.items()]))


def final_features(df: DataFrame, spec: Mapping[str, Sequence[str]], clip01: Sequence[str] = ()) -> DataFrame:
    """C-06: each final feature from its first available candidate, with provenance."""
    for out, cands in spec.items():
        df = coalesce_with_source(df, cands, out)
        if out in clip01:
            df = df.withColumn(out, clip(F.col(out), 0.0, 1.0))
    return df


def missing_counts(df: DataFrame, cores: Mapping[str, Sequence[str]]) -> DataFrame:
    """C-07: number of missing core features per modality and row."""
    return df.select("*", *[sum((F.col(c).isNull().cast("int") for c in cs), F.lit(0)).alias(f"n_missing_{m}") for m, cs in cores.items()])


def compact_output(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """C-08: keys first, then the listed features in order."""
    return df.select(*keys, *[f for f in features if f in df.columns])


def availability(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """C-09: rows, available values and percent per feature and key combination."""
    l = melt(df, keys, features)
    g = l.groupBy(*keys, "feature").agg(F.count("*").alias("n"), F.count("value").alias("n_available"))
    return g.withColumn("pct_available", F.round(100.0 * F.col("n_available") / F.col("n"), 3))


def resolve_features(df: DataFrame, spec: Mapping[str, Mapping[str, float]], known: Sequence[str], max_missing: float = 0.2) -> DataFrame:
    """C-10: why each candidate of each index is kept or not, from one pass over the data."""
    cands = sorted({f for s in spec.values() for f in s})
    have = [f for f in cands if f in df.columns]
    st = melt(df, [], have).groupBy("feature").agg(F.avg(F.col("value").isNull().cast("double")).alias("nan_rate"), F.stddev_pop("value").alias("_sd"))
    rows = [(i, f, float(s), f in known, f in have) for i, fs in spec.items() for f, s in fs.items()]
    c = df.sparkSession.createDataFrame(rows, "index_name string, feature string, sign double, in_registry boolean, present boolean")
    c = c.join(st, "feature", "left")
    status = (
        F.when(~F.col("in_registry"), "excluded_absent_from_registry").when(~F.col("present"), "excluded_absent_from_dataset")
        .when(F.col("nan_rate") > max_missing, "excluded_missing").when(F.col("_sd").isNull() | (F.col("_sd") <= 1e-12), "excluded_zero_variance")
        .otherwise("retained")
    )
    return c.select("index_name", "feature", "sign", "nan_rate", status.alias("status"))


def signed_z(df: DataFrame, unit: str, features: Sequence[str]) -> DataFrame:
    """Long z-scores (population sd), one row per unit and feature."""
    l = melt(df, [unit], features)
    z = with_group_aggs(l, ["feature"], _m=F.avg("value"), _s=F.stddev_pop("value"))
    return z.select(unit, "feature", F.try_divide(F.col("value") - F.col("_m"), F.when(F.col("_s") > 1e-12, F.col("_s"))).alias("z"))


def behavioural_indices(df: DataFrame, unit: str, resolved: DataFrame, features: Sequence[str], min_features: Mapping[str, int]) -> DataFrame:
    """C-10 / C-11: mean and median of the signed z-scores per unit and index.

    Indices, sign variants and leave-one-out variants are rows of ``resolved``
    (index_name, feature, sign), so all of them come from one grouping.
    """
    z = signed_z(df, unit, features)
    r = resolved.where("status = 'retained'").select("index_name", "feature", "sign")
    mins = df.sparkSession.createDataFrame(list(min_features.items()), "index_name string, _min int")
    # The sign table holds one row per index and feature: its size is fixed by the caller.
    j = z.join(r, "feature").withColumn("sz", F.col("z") * F.col("sign"))
    g = j.groupBy(unit, "index_name").agg(F.count("sz").alias("n_features"), F.avg("sz").alias("mean"), F.median("sz").alias("median"))
    g = g.join(mins, "index_name", "left")
    ok = F.col("n_features") >= F.coalesce("_min", F.lit(1))
    return g.select(unit, "index_name", "n_features", F.when(ok, F.col("mean")).alias("mean"), F.when(ok, F.col("median")).alias("median"))


def index_variants(spark, name: str, signs: Mapping[str, float]) -> DataFrame:
    """C-11: all sign combinations (2^k) and leave-one-feature-out variants of an index."""
    fs = list(signs)
    rows = [(name, f, float(s), "retained") for f, s in signs.items()]
    for m in range(2 ** len(fs)):
        tag = f"{name}_signs_{m}"
        rows += [(tag, f, -1.0 if m >> i & 1 else 1.0, "retained") for i, f in enumerate(fs)]
    for out in fs:
        rows += [(f"{name}_without_{out}", f, float(signs[f]), "retained") for f in fs if f != out]
    return spark.createDataFrame(rows, "index_name string, feature string, sign double, status string")


def longitudinal_pairs(df: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str], z_by: Sequence[str] = ()) -> DataFrame:
    """C-15: T1 and T2 side by side with the difference; optional z before."""
    d = df
    if z_by:
        z = zscore_within(df, cols, z_by, prefix="_z_", ddof=1)
        d = z.select(*[F.col(f"_z_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])
    at = lambda c, t: F.avg(F.when(F.upper(F.col(time)) == t, F.col(c)))
    g = d.groupBy(*keys).agg(*[x for c in cols for x in (at(c, "T1").alias(f"{c}_T1"), at(c, "T2").alias(f"{c}_T2"))])
    return g.select("*", *[(F.col(f"{c}_T2") - F.col(f"{c}_T1")).alias(f"delta_{c}") for c in cols])


def pair_availability(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """C-16: which units have T1, T2 or both, counted."""
    g = df.groupBy(*keys).agg(F.max((F.col(time) == "T1").cast("int")).alias("t1"), F.max((F.col(time) == "T2").cast("int")).alias("t2"))
    return g.agg(
        F.sum("t1").alias("n_t1"), F.sum("t2").alias("n_t2"), F.sum(F.col("t1") * F.col("t2")).alias("n_pairs"), F.count("*").alias("n_units")
    )


def construct_scores(scores: DataFrame, alpha: DataFrame, unit: Sequence[str], constructs: Mapping[str, Sequence[str]], min_alpha: float) -> DataFrame:
    """C-17: mean of a construct's dimensions, those below the alpha gate left out.

    ``scores``: unit, dimension, score. ``alpha``: dimension, alpha.
    """
    ok = alpha.where(F.col("alpha") >= min_alpha).select("dimension")
    s = scores.join(ok, "dimension", "left_semi")
    rows = [(c, d) for c, ds in constructs.items() for d in ds]
    m = scores.sparkSession.createDataFrame(rows, "construct string, dimension string")
    return s.join(m, "dimension").groupBy(*unit, "construct").agg(F.avg("score").alias("score"), F.count("*").alias("n_dimensions"))


def component_ratio(df: DataFrame, a: str, b: str, out: str = "component_ratio") -> DataFrame:
    """C-19: ratio of two components and their sum."""
    return df.withColumn(out, F.try_divide(F.col(a), F.col(b))).withColumn(f"{out}_sum", F.col(a) + F.col(b))


def silent_division_profile(df: DataFrame, a: str, b: str) -> DataFrame:
    """C-12: number of units in each quarter of a median split by two measures."""
    return median_split(df, [a, b]).groupBy("profile").agg(F.count("*").alias("n"))


def master_dataset(base: DataFrame, sources: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """C-14: ``base`` with the columns of each source, by left joins on ``keys``, and where each unit was found.

    A source has at most one row per unit: of several, numeric columns are averaged and others take their largest
    value. A column that the table already has is filled where it is NULL. ``in_<source>`` tells whether the unit was
    in the source.
    """
    keys, out = list(keys), base
    for name, source in sources.items():
        kinds = dict(source.dtypes)
        cols = [c for c in source.columns if c not in keys]
        number = lambda c: kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")
        s = source.groupBy(*keys).agg(*[(F.avg(c) if number(c) else F.max(c)).alias(f"_s_{c}") for c in cols], F.lit(True).alias("_in"))
        had = out.columns
        j = out.join(s, keys, "left")
        out = j.select(
            *[F.coalesce(F.col(c), F.col(f"_s_{c}")).alias(c) if c in cols else F.col(c) for c in had],
            *[F.col(f"_s_{c}").alias(c) for c in cols if c not in had], F.coalesce("_in", F.lit(False)).alias(f"in_{name}"),
        )
    return out


def analysis_dataset(df: DataFrame, unit: str, families: Mapping[str, Sequence[str]], outcomes: DataFrame, kept: Sequence[str] | None = None, supplement: DataFrame | None = None) -> DataFrame:
    """C-18: one predictor for each family, with its source, joined to the outcomes.

    Each family takes the first of its columns that is in ``kept`` (all, where none is given) and not NULL; columns
    that ``df`` lacks come from ``supplement``. Units without outcomes are left out.
    """
    d = df
    if supplement is not None:
        more = [c for c in supplement.columns if c != unit and c not in df.columns]
        d = d.join(supplement.select(unit, *more), unit, "left")
    cols = []
    for family, names in families.items():
        use = [c for c in names if c in d.columns and (kept is None or c in kept)]
        d = coalesce_with_source(d, use, family)
        cols += [family, f"{family}_source"]
    return d.select(unit, *cols).join(outcomes, unit)
