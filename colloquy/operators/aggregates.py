"""Group aggregates and set-shaped operators (A-01 to A-29, C-03)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.session import cut

from .scan import average_rank, cumulative_counts, quantiles, row_number, running_sum, attach, scan, with_group_aggs


def describe_by(df: DataFrame, value: str, keys: Sequence[str], digits: int = 3) -> DataFrame:
    """A-01: n, mean, sd, median, min, max per group."""
    stats = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.round(F.avg(value), digits).alias("mean"),
        F.round(F.stddev_samp(value), digits).alias("sd"),
        F.round(F.min(value), digits).alias("min"),
        F.round(F.max(value), digits).alias("max"),
    )
    med = quantiles(df, keys, value, {"median": 0.5})
    return stats.join(med, list(keys), "left").withColumn("median", F.round("median", digits))


def describe_levels(df: DataFrame, value: str, levels: Sequence[str]) -> DataFrame:
    """A-01 over every subset of ``levels`` in one pass (grouping sets)."""
    return df.cube(*levels).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 3).alias("mean"),
        F.round(F.stddev_samp(value), 3).alias("sd"),
    )


def coef_var(value: str, ddof: int = 0) -> Column:
    """A-02: sd / mean; NULL for a zero mean or fewer than two values (ddof 1)."""
    sd = F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)
    return F.try_divide(sd, F.avg(value))


FEW_GROUPS = 10_000


def share_of_total(df: DataFrame, value: str, keys: Sequence[str], out: str = "share") -> DataFrame:
    """A-03: value over the group's sum, NULL when the sum is not positive.

    Sums of few groups go to the rows, so that no task reads all rows of a large group.
    """
    small = cut(df.groupBy(*keys).agg(F.sum(value).alias("_total")))
    few = bool(keys) and small.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    d = attach(df, F.broadcast(small) if few else small, keys)
    return d.withColumn(out, F.when(F.col("_total") > 0, F.col(value) / F.col("_total"))).drop("_total")


def top_share(value: str) -> Column:
    return F.when(F.sum(value) > 0, F.max(value) / F.sum(value))


def share_variance(value: str) -> Column:
    return F.when(F.sum(value) > 0, F.var_pop(value) / F.pow(F.sum(value), F.lit(2)))


def entropy_of(
    df: DataFrame, keys: Sequence[str], weight: str, base: str = "nats", normalize: bool = False, out: str = "entropy"
) -> DataFrame:
    """A-04: Shannon entropy of positive weights, from sums only.

    -sum(p ln p) = ln(S) - sum(w ln w) / S, so one aggregate suffices. Normalised by the
    log of the number of positive categories; one category gives 0.
    """
    w = F.when(F.col(weight) > 0, F.col(weight))
    g = df.groupBy(*keys).agg(F.sum(w).alias("_s"), F.sum(w * F.ln(w)).alias("_wl"), F.count(w).alias("_k"))
    h = F.ln("_s") - F.col("_wl") / F.col("_s")
    if normalize:
        h = F.when(F.col("_k") > 1, h / F.ln("_k")).otherwise(0.0)
    elif base == "bits":
        h = h / F.ln(F.lit(2.0))
    return g.select(*keys, F.when(F.col("_s") > 0, h).alias(out))


def gini(df: DataFrame, keys: Sequence[str], value: str, out: str = "gini") -> DataFrame:
    """A-05: Gini index from the ranked distinct values of each group; NULL below two values."""
    c = cumulative_counts(df, keys, value)
    # Ranks below+1 .. below+k of one value add up in closed form.
    k, x = F.col("n_equal"), F.col(value)
    rank_sum = k * F.col("n_below") + k * (k + 1) / 2.0
    g = c.groupBy(*keys).agg(F.sum(k).alias("n"), F.sum(k * x).alias("s"), F.sum(rank_sum * x).alias("rs"))
    v = 2.0 * F.col("rs") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")
    return g.select(*keys, F.when((F.col("s") > 0) & (F.col("n") > 1), v).alias(out))


def rate_per_min(count: Column, duration_s: Column) -> Column:
    """A-06"""
    return F.try_divide(count, F.try_divide(duration_s, F.lit(60.0)))


def last_action(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """A-08: the values of the latest row per key; partial maxima before the shuffle."""
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *values)).alias("_m")).select(
        *keys, *[F.col(f"_m.{v}").alias(v) for v in values]
    )


def pivot_matrix(df: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """A-09: rows x columns matrix of means; rows and columns without any value drop."""
    m = df.groupBy(row).agg(
        *[F.avg(F.when(F.col(column) == c, F.col(value))).alias(str(c)) for c in columns]
    )
    return m.where(reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in columns]))


def impute(df: DataFrame, cols: Sequence[str], how: str = "mean") -> DataFrame:
    """A-10: fill NULLs with the column mean or median, or drop incomplete rows."""
    if how == "drop":
        return df.na.drop(subset=list(cols))
    if how == "mean":
        fill = df.agg(*[F.avg(c).alias(f"_f_{c}") for c in cols])
    else:
        long = melt(df, [], list(cols))
        q = quantiles(long, ["feature"], "value", {"m": 0.5})
        fill = q.agg(*[F.max(F.when(F.col("feature") == c, F.col("m"))).alias(f"_f_{c}") for c in cols])
    j = attach(df, fill, [])
    return j.select(*[F.coalesce(c, f"_f_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def rank_min_desc(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """A-11: rank 1 for the largest; ties share the smallest rank."""
    c = cumulative_counts(df, keys, value)
    c = with_group_aggs(c, keys, _n=F.sum("n_equal"))
    r = c.select(*keys, F.col(value).alias("_rv"), (F.col("_n") - F.col("n_below") - F.col("n_equal") + 1).alias(out))
    d = df.withColumn("_rv", F.col(value).cast("double"))
    return attach(d, r, [*keys, "_rv"], "left").drop("_rv")


def repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, out: str = "is_repeat") -> DataFrame:
    """A-12: whether an earlier row of the same key exists."""
    return scan(df, keys, order, chunk, {"_rn": row_number()}).withColumn(out, F.col("_rn") > 1).drop("_rn")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """A-13"""
    return df.orderBy(*order).limit(k)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """A-14"""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def membership(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A-15: which keys are on both sides, only left, only right."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    return a.join(b, key, "outer").select(
        key, F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right").alias("side")
    )


def theme_counts(comments: DataFrame, text: str, themes: Mapping[str, Sequence[str]], keys: Sequence[str] = ()) -> DataFrame:
    """A-16: comments touching each keyword theme (several themes may apply)."""
    low = F.lower(F.col(text))
    hit = lambda ws: reduce(lambda a, b: a | b, [low.contains(w) for w in ws])
    n = comments.groupBy(*keys).agg(
        F.count("*").alias("n_comments"), *[F.sum(hit(ws).cast("long")).alias(t) for t, ws in themes.items()]
    )
    return n.unpivot([*keys, "n_comments"], list(themes), "theme", "n").select(
        *keys, "theme", "n", F.round(100.0 * F.col("n") / F.col("n_comments"), 3).alias("pct")
    )


def column_inventory(df: DataFrame, block: Mapping[str, str] | None = None) -> DataFrame:
    """A-17: rows, missing values and type of every column, in one pass."""
    cols, types = df.columns, dict(df.dtypes)
    one = df.agg(
        F.count("*").alias("_n"),
        *[F.count(c).alias(f"_v{i}") for i, c in enumerate(cols)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.lit(types[c]).alias("type"),
                F.lit((block or {}).get(c, "other")).alias("block"), F.col("_n").alias("n_rows"),
                (F.col("_n") - F.col(f"_v{i}")).alias("n_missing"),
            )
            for i, c in enumerate(cols)
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def block_summary(inventory: DataFrame) -> DataFrame:
    """A-18"""
    return inventory.groupBy("block").agg(
        F.count("*").alias("n_columns"), F.sum("n_missing").alias("n_missing"),
        F.round(F.avg(F.col("n_missing") / F.col("n_rows")), 6).alias("missing_ratio"),
    )


def unit_counts(df: DataFrame, levels: Sequence[str], unit: str) -> DataFrame:
    """A-19: units per combination of levels with all subtotals."""
    per_unit = df.select(*levels, unit).distinct()
    return per_unit.cube(*levels).agg(F.countDistinct(unit).alias("n_units"))


def source_summary(sources: Mapping[str, DataFrame], unit: str) -> DataFrame:
    """A-20 / A-28: rows, columns, units and missing share per source table."""
    parts = []
    for name, df in sources.items():
        cells = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0))
        parts.append(
            df.agg(
                F.count("*").alias("n_rows"), F.countDistinct(unit).alias("n_units"),
                F.round(F.avg(cells / len(df.columns)), 6).alias("missing_ratio"),
            ).select(F.lit(name).alias("source"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), "n_units", "missing_ratio")
        )
    return union_all(parts)


def category_percentages(df: DataFrame, category: str, keys: Sequence[str] = ()) -> DataFrame:
    """A-21"""
    c = df.groupBy(*keys, category).agg(F.count("*").alias("n"))
    c = with_group_aggs(c, keys, _t=F.sum("n"))
    return c.withColumn("pct", F.round(100.0 * F.col("n") / F.col("_t"), 3)).drop("_t")


def crosstab_means(df: DataFrame, row: str, category: str, value: str) -> DataFrame:
    """A-22: "category = mean; ..." per row key (text of already averaged cells)."""
    m = df.groupBy(row, category).agg(F.avg(value).alias("m"))
    cell = F.concat(F.col(category), F.lit(" = "), F.format_number("m", 2))
    return m.groupBy(row).agg(F.concat_ws("; ", F.array_sort(F.collect_list(cell))).alias("means"))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """A-23: wide to long, values as double."""
    d = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    return d.unpivot(list(ids), list(values), name, value)


def aggregate_by_unit(df: DataFrame, unit: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """A-26: mean of every numeric column per unit."""
    return df.groupBy(*unit).agg(*[F.avg(c).alias(c) for c in cols])


def participant_profile(df: DataFrame, participant: str, codes: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """A-25: answers coded by their map, one row per participant, mean and level label."""
    coded = [
        reduce(lambda acc, kv: acc.when(F.col(c) == kv[0], F.lit(kv[1])), m.items(), F.when(F.lit(False), 0)).cast("double")
        for c, m in codes.items()
    ]
    n = sum((x.isNotNull().cast("int") for x in coded), F.lit(0))
    s = sum((F.coalesce(x, F.lit(0.0)) for x in coded), F.lit(0.0))
    d = df.withColumn("familiarity", F.try_divide(s, n))
    d = d.groupBy(participant).agg(F.max("familiarity").alias("familiarity"))
    level = F.when(F.col("familiarity") >= 3.5, "high").when(F.col("familiarity") >= 2.0, "medium").otherwise("low")
    return d.withColumn("level", F.when(F.col("familiarity").isNotNull(), level))


def dataset_patterns(files: DataFrame, path: str = "path") -> DataFrame:
    """A-29: files grouped by their path with numbers replaced."""
    pat = F.regexp_replace(F.col(path), r"[0-9]+", "#")
    return files.groupBy(pat.alias("pattern")).agg(F.count("*").alias("n_files"))


def zscore_within(
    df: DataFrame, cols: Sequence[str], by: Sequence[str], prefix: str = "z_", ddof: int = 0, on_constant: float | None = 0.0
) -> DataFrame:
    """C-03: z within groups; a constant column gives ``on_constant`` on non-null rows."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    aggs = {}
    for c in cols:
        aggs[f"_m_{c}"], aggs[f"_s_{c}"] = F.avg(c), sd(c)
    d = with_group_aggs(df, by, **aggs)
    z = []
    for c in cols:
        x, m, s = F.col(c), F.col(f"_m_{c}"), F.col(f"_s_{c}")
        flat = F.when(x.isNotNull(), F.lit(on_constant).cast("double"))
        tiny = s <= 1e-12 * F.greatest(F.abs(m), F.lit(1e-300))
        z.append(F.when(tiny | s.isNull(), flat).otherwise(F.try_divide(x - m, s)).alias(f"{prefix}{c}"))
    return d.select(*df.columns, *z)


def scope_comparison(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """A-24: the same statistic on two samples side by side."""
    ra = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in cols])
    rb = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in cols])
    return ra.join(rb, list(keys), "outer")
