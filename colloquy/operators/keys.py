"""Keys, cleaning and row selection (M-01 to M-26)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .scan import quantiles, attach, with_group_aggs

KEYS = ["group_id", "condition", "scenario", "timepoint"]


def _part(path: Column, pattern: str, default: str = "UNK") -> Column:
    v = F.upper(F.regexp_extract(path, pattern, 1))
    return F.when(v != "", v).otherwise(default)


def parse_condition(path: Column) -> Column:
    """M-01: VR or PC path component."""
    return _part(path, r"(?i)(?:^|/)(VR|PC)(?:/|$)")


def parse_scenario(path: Column) -> Column:
    """M-01"""
    return _part(path, r"(?i)(?:^|/)(S[12])(?:/|$)")


def parse_timepoint(path: Column) -> Column:
    """M-01"""
    return _part(path, r"(?i)(?:^|/)(T[12])(?:_[^/]*)?(?:/|$)")


def group_base_id(gid: Column) -> Column:
    """M-02"""
    return F.regexp_replace(gid, r"_\d+$", "")


def normalize_group_id(x: Column, prefix: str = "bim") -> Column:
    """M-03: prefix and the number, padded to at least three digits, with the suffix kept."""
    low = F.lower(F.trim(x.cast("string")))
    num = F.regexp_replace(F.regexp_extract(low, r"(\d+)", 1), r"^0+(?=\d)", "")
    padded = F.when(F.length(num) < 3, F.lpad(num, 3, "0")).otherwise(num)
    suf = F.regexp_extract(low, r"\d+(_\d+)$", 1)
    return F.when(num == "", low).otherwise(F.concat(F.lit(prefix), padded, suf))


def exclude_groups(df: DataFrame, excluded: DataFrame, key: str = "group_id", base: bool = False) -> DataFrame:
    """M-04: drop listed groups, by exact id or also by base id. ``excluded``: one column ``group_id``."""
    x = excluded.select(F.col("group_id").alias("_x")).distinct()
    d = df.join(x, F.col(key) == F.col("_x"), "left_anti")
    if base:
        d = d.join(x, group_base_id(F.col(key)) == F.col("_x"), "left_anti")
    return d


def upsert_keys(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """M-05: set the key columns and put them first."""
    rest = [c for c in df.columns if c not in values]
    return df.select(*[v.alias(k) for k, v in values.items()], *rest)


def conform(df: DataFrame, candidates: Mapping[str, Sequence[str]], types: Mapping[str, str] | None = None, keep_rest: bool = False) -> DataFrame:
    """M-06: the first existing candidate (case-insensitive) under its canonical name, typed NULL when none."""
    low = {c.lower(): c for c in df.columns}
    used, out = set(), []
    for name, cands in candidates.items():
        hit = next((low[c.lower()] for c in cands if c.lower() in low), None)
        t = (types or {}).get(name)
        col = F.col(f"`{hit}`") if hit else F.lit(None)
        used.add(hit)
        out.append((col.try_cast(t) if t and hit else col.cast(t or "string") if not hit else col).alias(name))
    rest = [F.col(f"`{c}`") for c in df.columns if keep_rest and c not in used and c not in candidates]
    return df.select(*out, *rest)


def numeric_text(x: Column) -> Column:
    """M-07: decimal comma and % to double; NaN and text that is no number to NULL."""
    v = F.regexp_replace(F.regexp_replace(F.trim(x.cast("string")), ",", "."), r"\s*%$", "").try_cast("double")
    return F.when(~F.isnan(v), v)


def to_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M-07"""
    return df.select(*[numeric_text(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def numeric_columns(df: DataFrame, min_share: float = 0.2, min_n: int = 3) -> DataFrame:
    """M-07: text columns of which enough values parse, in one aggregate over all columns."""
    cols = [c for c, t in df.dtypes if t == "string"]
    one = df.agg(*[x for i, c in enumerate(cols) for x in (F.count(c).alias(f"n{i}"), F.count(numeric_text(F.col(c))).alias(f"k{i}"))])
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_values"), F.col(f"k{i}").alias("n_numeric")) for i, c in enumerate(cols)])
    r = one.select(F.explode(arr).alias("r")).select("r.*")
    return r.withColumn("numeric", (F.col("n_numeric") >= min_n) & (F.col("n_numeric") >= min_share * F.col("n_values")))


def strip_column_names(df: DataFrame) -> DataFrame:
    """M-08"""
    return df.toDF(*[c.strip() for c in df.columns])


def drop_suffix_pairs(df: DataFrame) -> DataFrame:
    """M-08: c_x and c_y become c (first non-missing), or vanish where c exists."""
    pairs = [c[:-2] for c in df.columns if c.endswith("_x") and f"{c[:-2]}_y" in df.columns]
    gone = {f"{b}_{s}" for b in pairs for s in "xy"}
    new = [F.coalesce(f"{b}_x", f"{b}_y").alias(b) for b in pairs if b not in df.columns]
    return df.select(*[c for c in df.columns if c not in gone], *new)


def first_available_column(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """M-09: the first candidate with any value, for the whole table."""
    have = [c for c in cols if c in df.columns]
    cnt = df.agg(*[F.count(c).alias(f"_n_{c}") for c in have])
    d = attach(df, cnt, [])
    pick = reduce(lambda acc, c: acc.when(F.col(f"_n_{c}") > 0, F.col(c)), have, F.when(F.lit(False), F.lit(None)))
    return d.withColumn(out, pick).drop(*[f"_n_{c}" for c in have])


def coalesce_with_source(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """M-09: the first non-missing candidate per row and where it came from."""
    have = [c for c in cols if c in df.columns]
    src = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in have])
    return df.select("*", F.coalesce(*have).alias(out), src.alias(f"{out}_source"))


def dedup_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """M-10: the first row of each key; a minimum with map-side combine, not a sort."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    m = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_m"))
    return m.select(*[F.col(c) if c in keys else F.col(f"_m.{c}").alias(c) for c in df.columns])


def null_out_when(df: DataFrame, condition: Column, prefixes: Sequence[str]) -> DataFrame:
    """M-11"""
    hit = lambda c: any(c.startswith(p) for p in prefixes)
    return df.select(*[F.when(~condition, F.col(c)).alias(c) if hit(c) else F.col(c) for c in df.columns])


def drop_redundant_aliases(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """M-12: drop a raw column where its canonical one exists."""
    return df.drop(*[r for r, c in aliases.items() if r in df.columns and c in df.columns])


def select_features(df: DataFrame, ids: Sequence[str], max_missing: float, drop_suffixes: Sequence[str] = (), drop_prefixes: Sequence[str] = (), drop_parts: Sequence[str] = ()) -> DataFrame:
    """M-13: candidate features with their missing share and whether they are kept."""
    num = [
        c for c, t in df.dtypes
        if t in ("double", "float", "int", "bigint") and c not in ids and not c.endswith(tuple(drop_suffixes) or ("\0",))
        and not c.startswith(tuple(drop_prefixes) or ("\0",)) and not any(p in c for p in drop_parts)
    ]
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in num])
    l = one.unpivot([], num, "feature", "missing_ratio")
    return l.withColumn("selected", F.col("missing_ratio") <= max_missing)


def clean_levels(df: DataFrame, col: str, valid: Sequence[str]) -> DataFrame:
    """M-14: case-folded level, invalid ones to NULL."""
    v = F.upper(F.trim(F.col(col)))
    return df.withColumn(col, F.when(v.isin([x.upper() for x in valid]), v))


def valid_performance(df: DataFrame, score: str, keys: Sequence[str]) -> DataFrame:
    """M-15"""
    return df.where((F.col(score) > 0) & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def filter_modality(tables: Mapping[str, DataFrame], modality: str, unit: str, column: str = "condition") -> dict[str, DataFrame]:
    """M-16: tables that know the modality are filtered; the others follow their kept units."""
    kept = {n: d.where(F.upper(F.col(column)) == modality.upper()) for n, d in tables.items() if column in d.columns}
    ids = reduce(lambda a, b: a.unionByName(b), [d.select(unit) for d in kept.values()]).distinct()
    return {n: kept.get(n) if n in kept else d.join(ids, unit, "left_semi") for n, d in tables.items()}


def scope(df: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """M-17"""
    return df.join(allowed.select(key).distinct(), key, "left_semi")


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M-18"""
    return df.na.drop(subset=list(cols))


def median_split(df: DataFrame, cols: Sequence[str], out: str = "profile") -> DataFrame:
    """M-20: high or low against each column's exact median, joined to a label."""
    from .aggregates import melt

    q = quantiles(melt(df, [], cols), ["feature"], "value", {"m": 0.5})
    one = q.agg(*[F.max(F.when(F.col("feature") == c, F.col("m"))).alias(f"_m_{c}") for c in cols])
    d = attach(df, one, [])
    side = [F.when(F.col(c) >= F.col(f"_m_{c}"), "haut").when(F.col(c) < F.col(f"_m_{c}"), "bas") for c in cols]
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    return d.withColumn(out, F.when(ok, F.concat_ws("/", *side))).drop(*[f"_m_{c}" for c in cols])


def harmonize_timepoint(timepoint: Column, session: Column | None, gid: Column, session_is_time: bool = False, suffix_is_time: bool = False) -> Column:
    """M-21: T1/T2 from the column, else (if asked) the session or the id suffix."""
    t = F.upper(F.trim(timepoint))
    parts = [F.when(t.isin("T1", "T2"), t)]
    if session is not None and session_is_time:
        s = F.upper(F.trim(session))
        parts.append(F.when(s == "S1", "T1").when(s == "S2", "T2"))
    if suffix_is_time:
        parts.append(F.when(gid.rlike(r"_2$"), "T2").otherwise("T1"))
    return F.coalesce(*parts)


def detect_column(df: DataFrame, candidates: Sequence[str], min_valid: float = 0.5) -> DataFrame:
    """M-22: share of valid values of each present candidate; ``chosen`` marks the first good one."""
    have = [c for c in candidates if c in df.columns]
    one = df.agg(*[F.avg(numeric_text(F.col(c)).isNotNull().cast("double")).alias(c) for c in have])
    arr = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(c).alias("valid_ratio")) for i, c in enumerate(have)])
    r = one.select(F.explode(arr).alias("r")).select("r.*").withColumn("_ok", F.col("valid_ratio") >= min_valid)
    r = with_group_aggs(r, [], _first=F.min(F.when(F.col("_ok"), F.col("position"))))
    return r.select("position", "column", "valid_ratio", F.coalesce(F.col("position") == F.col("_first"), F.lit(False)).alias("chosen"))


def exclude_keys(df: DataFrame, exclusions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M-23: anti join on the normalised composite key; a NULL in the exclusion matches any value."""
    n = lambda c: F.upper(F.trim(F.col(c).cast("string")))
    x = exclusions.select(*[n(k).alias(f"_x_{k}") for k in keys]).distinct()
    first, rest = keys[0], keys[1:]
    on = n(first) == F.col(f"_x_{first}")
    for k in rest:
        on = on & (F.col(f"_x_{k}").isNull() | (n(k) == F.col(f"_x_{k}")))
    return df.join(x, on, "left_anti")


def registry_lookup(names: DataFrame, registry: DataFrame, aliases: DataFrame) -> DataFrame:
    """M-24: canonical name and registry entry. ``aliases``: alias, feature."""
    a = names.join(aliases.select(F.col("alias").alias("name"), F.col("feature").alias("_c")), "name", "left")
    a = a.withColumn("feature", F.coalesce("_c", "name")).drop("_c")
    return a.join(registry, "feature", "left").withColumn("known", F.col("family").isNotNull())


def prefer_corrected(df: DataFrame, keys: Sequence[str], corrected: Sequence[str], raw: Sequence[str], out: Sequence[str]) -> DataFrame:
    """M-25: corrected columns where the recording has any, raw ones otherwise, with the source."""
    have = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in corrected])
    d = with_group_aggs(df, keys, _c=F.max(have.cast("int")))
    use = F.col("_c") == 1
    d = d.select(*df.columns, *[F.when(use, F.col(c)).otherwise(F.col(r)).alias(o) for c, r, o in zip(corrected, raw, out)], F.when(use, "corr").otherwise("raw").alias("dir_source"))
    return d


def filter_elements(df: DataFrame, name: str, equals: Sequence[str] = (), contains: Sequence[str] = ()) -> DataFrame:
    """M-26"""
    low = F.lower(F.trim(F.col(name)))
    conds = [low.isin([e.lower() for e in equals])] if equals else []
    conds += [low.contains(c.lower()) for c in contains]
    return df.where(reduce(lambda a, b: a | b, conds))
