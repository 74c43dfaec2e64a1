"""Joins on time: as-of, interpolation, interval overlap (J-05 to J-12), grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.session import cut

from .scan import by_width, last_valid, next_valid, scan

GRID_ROWS = 1 << 17  # frames that a task makes
GRID_BLOCK = 1 << 10


def _levels(sides, width: float, factor: int = 16) -> int:
    """Bucket levels that the longest interval of both sides needs."""
    longest = max((df.agg(F.max(F.col(e) - F.col(s))).first()[0] or 0.0) for df, (s, e) in sides)
    n = 1
    while width * factor**n <= longest:
        n += 1
    return n


def _buckets(df: DataFrame, start: str, end: str, width: float, factor: int, levels: int, left: bool) -> DataFrame:
    """Bucket copies of each interval, tagged with the own levels of the pair they are for.

    At its own level a row meets rows of that and of finer levels; at a coarser level it
    visits rows whose own level that is. So two short rows meet on the finest level only.
    """
    span = F.floor(F.col(end) / width) - F.floor(F.col(start) / width)
    own = F.lit(0)
    for lv in range(levels - 1):
        own = F.when(span >= factor ** (lv + 1), lv + 1).otherwise(own)

    def tag(lv: int, b: Column, mine, other) -> Column:
        mine, other = (x if isinstance(x, Column) else F.lit(x) for x in (mine, other))
        la, lb = (mine, other) if left else (other, mine)
        return F.struct(F.lit(lv).alias("lv"), b.alias("b"), la.alias("la"), lb.alias("lb"))

    def at_level(lv: int) -> Column:
        w = width * factor**lv
        seq = F.sequence(F.floor(F.col(start) / w).cast("long"), F.floor(F.col(end) / w).cast("long"))
        host = F.flatten(F.transform(seq, lambda b: F.array(*[tag(lv, b, lv, o) for o in range(lv + 1)])))
        visit = F.transform(seq, lambda b: tag(lv, b, F.col("_own"), lv))
        return F.when(F.col("_own") == lv, host).when(F.col("_own") < lv, visit)

    return (
        df.where(F.col(end) >= F.col(start))
        .withColumn("_own", own)
        .withColumn("_copy", F.explode(F.flatten(F.array_compact(F.array(*[at_level(lv) for lv in range(levels)])))))
        .withColumns({f"_{c}": F.col(f"_copy.{c}") for c in ("lv", "b", "la", "lb")})
        .drop("_copy", "_own")
    )


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    width: float,
    l: tuple[str, str],
    r: tuple[str, str],
    where: Column | None = None,
    levels: int | None = None,
    factor: int = 16,
    how: str = "inner",
) -> DataFrame:
    """J-08: pairs of intervals of one key that share a moment (closed ends).

    Both sides are cut into time buckets and joined on (key, level, bucket, own level of
    the left row, own level of the right row), so the work per task follows local density,
    not the length of a session, and two short rows are compared in one bucket of the
    finest level only. A row spanning ``factor`` buckets or more is bucketed on a coarser
    level. ``levels`` is measured from the longest interval where it is not given, so a row
    never has more than about ``factor`` copies on a level.
    ``where`` narrows the match; columns of the two sides must have different names.
    """
    keys = list(keys)
    n = levels or _levels(((left, l), (right, r)), width, factor)
    tags = ["_lv", "_b", "_la", "_lb"]
    a = _buckets(left, *l, width, factor, n, True)
    b = _buckets(right, *r, width, factor, n, False)
    b = b.select(*[F.col(c).alias(f"_r_{c}") if c in (*keys, *tags) else F.col(c) for c in b.columns])
    on = F.lit(True)
    for k in (*keys, *tags):
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    on = on & (F.col(l[0]) <= F.col(r[1])) & (F.col(r[0]) <= F.col(l[1]))
    if where is not None:
        on = on & where
    if how == "left_semi":
        # A row and its bucket copies may match several times.
        return a.join(b, on, "left_semi").select(*left.columns).distinct()
    w = F.lit(width) * F.pow(F.lit(float(factor)), F.col("_lv"))
    first = F.floor(F.greatest(F.col(l[0]), F.col(r[0])) / w).cast("long") == F.col("_b")
    cols = [c for c in left.columns] + [c for c in right.columns if c not in keys]
    return a.join(b, on & first, "inner").select(*cols)


def asof(
    probes: DataFrame,
    states: DataFrame,
    keys: Sequence[str],
    t: str,
    values: Sequence[str],
    chunk_s: float | None,
    direction: str = "backward",
    tolerance: float | None = None,
) -> DataFrame:
    """J-05 / J-06: latest (or nearest) state for every probe.

    Union of both sides and a chunked carry; a state at the probe's own time counts.
    ``nearest`` keeps the closer neighbour, the earlier one on a tie.
    """
    keys, values = list(keys), list(values)
    state = F.struct(F.col(t).alias("t"), *values)
    s = states.select(*keys, t, F.lit(0).alias("_side"), state.alias("_s"))
    p = probes.withColumn("_side", F.lit(1)).withColumn("_s", F.lit(None).cast(s.schema["_s"].dataType))
    extra = [c for c in probes.columns if c not in (*keys, t)]
    for c in extra:
        s = s.withColumn(c, F.lit(None).cast(probes.schema[c].dataType))
    rows = p.unionByName(s)
    specs = {"_b": last_valid("_s")}
    if direction == "nearest":
        specs["_f"] = next_valid("_s")
    # States sort before probes of the same time, so an equal time is "backward".
    o = scan(rows, keys, [t, "_side"], by_width(t, chunk_s), specs).where(F.col("_side") == 1)
    pick = F.col("_b")
    if direction == "nearest":
        back, fwd = F.col(t) - F.col("_b.t"), F.col("_f.t") - F.col(t)
        pick = F.when(
            F.col("_b").isNull() | (F.col("_f").isNotNull() & (fwd < back)), F.col("_f")
        ).otherwise(F.col("_b"))
    o = o.withColumn("_p", pick)
    if tolerance is not None:
        o = o.withColumn("_p", F.when(F.abs(F.col("_p.t") - F.col(t)) <= tolerance, F.col("_p")))
    return o.select(
        *keys, t, *extra, F.col("_p.t").alias(f"{t}_match"),
        *[F.col(f"_p.{v}").alias(v) for v in values],
    )


def interpolate(
    probes: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    t: str,
    values: Sequence[str],
    chunk_s: float,
    max_gap: float | None = None,
) -> DataFrame:
    """J-07: linear interpolation of ``values`` at the probe times.

    NULL outside the range of the source and where the nearest source sample is more
    than ``max_gap`` away. Source rows with a NULL value are ignored.
    """
    keys, values = list(keys), list(values)
    for v in values:
        source = source.where(F.col(v).isNotNull())
    state = F.struct(F.col(t).alias("t"), *values)
    s = source.select(*keys, t, F.lit(0).alias("_side"), state.alias("_s"))
    extra = [c for c in probes.columns if c not in (*keys, t)]
    p = probes.withColumn("_side", F.lit(1)).withColumn("_s", F.lit(None).cast(s.schema["_s"].dataType))
    for c in extra:
        s = s.withColumn(c, F.lit(None).cast(probes.schema[c].dataType))
    o = scan(
        p.unionByName(s), keys, [t, "_side"], by_width(t, chunk_s),
        {"_b": last_valid("_s"), "_f": next_valid("_s")},
    ).where(F.col("_side") == 1)
    exact = F.col("_b.t") == F.col(t)
    frac = (F.col(t) - F.col("_b.t")) / (F.col("_f.t") - F.col("_b.t"))
    near = F.least(F.col(t) - F.col("_b.t"), F.col("_f.t") - F.col(t))
    ok = F.lit(True) if max_gap is None else exact | (near <= max_gap)
    cols = [
        F.when(exact, F.col(f"_b.{v}"))
        .when(
            F.col("_b").isNotNull() & F.col("_f").isNotNull() & ok,
            F.col(f"_b.{v}") + (F.col(f"_f.{v}") - F.col(f"_b.{v}")) * frac,
        )
        .alias(v)
        for v in values
    ]
    return o.select(*keys, t, *extra, *cols)


def grid(sessions: DataFrame, n_frames: Column, fs: float, out: str = "frame_idx") -> DataFrame:
    """G-06: integer frames of each session; time is ``frame / fs`` only at the end.

    The table of sessions is small and would be merged into few partitions, so it is cut into blocks of frames and these
    are dealt out by the number of frames: no task makes more than about ``GRID_ROWS``, however many or long the sessions.
    """
    s = cut(sessions.withColumn("_n", n_frames.cast("long")).where(F.col("_n") > 0))
    parts = -(-(s.agg(F.sum("_n")).first()[0] or 1) // GRID_ROWS)
    first = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(GRID_BLOCK).cast("long"))
    return (
        s.withColumn("_b", F.explode(first))
        .repartition(parts)
        .withColumn(out, F.explode(F.sequence(F.col("_b"), F.least(F.col("_b") + GRID_BLOCK, F.col("_n")) - 1)))
        .withColumn("t", F.col(out) / F.lit(fs))
        .drop("_n", "_b")
    )


def role_pairs(roles: DataFrame, key: str = "session_id", role: str = "role") -> DataFrame:
    """J-11: unordered role pairs of each session from its distinct roles."""
    d = roles.select(key, role).distinct()
    a = d.withColumnRenamed(role, "role_a")
    b = d.withColumnRenamed(role, "role_b")
    return a.join(b, key).where(F.col("role_a") < F.col("role_b"))
