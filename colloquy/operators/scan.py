"""Ordered computations that never put one whole group into one task.

A session (or any other key) may hold a large share of all rows, so a plain
``Window.partitionBy(key).orderBy(t)`` is a single-task sort of that share. Every
ordered operator of this package goes through the functions below instead. They
split each key by a *chunk* (a monotone function of the leading order column, such
as an hour of the recording), work inside the chunk, and hand the running state from
one chunk to the next through a table with one row per (key, chunk). Where every key was
counted and found small (``chunk_width``), the key is its own only chunk and nothing is
handed over; results are the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colloquy.session import cut

CHUNK = "_chunk"
WHOLE_ROWS = 1 << 16  # rows of a key that are sorted as one chunk


def chunk_width(df: DataFrame, keys: Sequence[str], width: float | None) -> float | None:
    """``width``, or None where no key has more than ``WHOLE_ROWS`` rows of ``df``: then each key is one chunk.

    Chunks much smaller than a task can hold cost a carry table nearly as long as the detail. One count by key decides.
    """
    if width is None or not keys:
        return width
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return None if largest <= WHOLE_ROWS else width


def by_width(col: str, width: float | None) -> Column | None:
    """Chunk number of a time or index column; None where a key is one chunk."""
    if width is None:
        return None
    return F.floor(F.col(col) / F.lit(width)).cast("long")


@dataclass(frozen=True)
class Spec:
    kind: str
    expr: Column


def lag(expr) -> Spec:
    return Spec("lag", _col(expr))


def lead(expr) -> Spec:
    return Spec("lead", _col(expr))


def running_sum(expr) -> Spec:
    return Spec("sum", _col(expr))


def row_number() -> Spec:
    return Spec("sum", F.lit(1).cast("long"))


def previous_max(expr) -> Spec:
    """Largest value on the rows before this one."""
    return Spec("pmax", _col(expr))


def last_valid(expr) -> Spec:
    """Latest non-null value up to and including this row."""
    return Spec("last", _col(expr))


def next_valid(expr) -> Spec:
    """Earliest non-null value from this row on."""
    return Spec("next", _col(expr))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | None,
    specs: dict[str, Spec],
) -> DataFrame:
    """Add running columns over ``keys`` in ``order`` (ascending, NULL-free, total).

    One shuffle of the detail on (keys, chunk); the carried state is a groupBy with
    map-side combine and a window over one row per chunk. Without a chunk there is no
    carried state.
    """
    keys, order = list(keys), list(order)
    exprs = [s.expr.alias(f"_e_{n}") for n, s in specs.items()]
    if chunk is None:
        none = [F.lit(None).cast("int" if s.kind == "sum" else df.select(s.expr).schema[0].dataType).alias(f"_c_{n}") for n, s in specs.items()]
        return _running(df.select("*", *exprs, *none), df.columns, keys, order, specs)
    body = df.select("*", chunk.alias(CHUNK), *exprs)
    pos = F.struct(*order)

    aggs = []
    for name, s in specs.items():
        e = F.col(f"_e_{name}")
        if s.kind == "lag":
            a = F.max_by(e, pos)
        elif s.kind == "lead":
            a = F.min_by(e, pos)
        elif s.kind == "sum":
            a = F.sum(e)
        elif s.kind == "pmax":
            a = F.max(e)
        elif s.kind == "last":
            a = F.max_by(e, F.when(e.isNotNull(), pos))
        else:
            a = F.min_by(e, F.when(e.isNotNull(), pos))
        aggs.append(a.alias(f"_a_{name}"))
    per_chunk = body.groupBy(*keys, CHUNK).agg(*aggs)

    up = W.partitionBy(*keys).orderBy(CHUNK)
    down = W.partitionBy(*keys).orderBy(F.desc(CHUNK))
    before = up.rowsBetween(W.unboundedPreceding, -1)
    after = down.rowsBetween(W.unboundedPreceding, -1)
    carry = []
    for name, s in specs.items():
        a = F.col(f"_a_{name}")
        c = {
            "lag": lambda a: F.lag(a).over(up),
            "lead": lambda a: F.lead(a).over(up),
            "sum": lambda a: F.sum(a).over(before),
            "pmax": lambda a: F.max(a).over(before),
            "last": lambda a: F.last(a, ignorenulls=True).over(before),
            "next": lambda a: F.last(a, ignorenulls=True).over(after),
        }[s.kind](a)
        carry.append(c.alias(f"_c_{name}"))
    carried = per_chunk.select(*keys, CHUNK, *carry)

    return _running(body.join(carried, [*keys, CHUNK], "left"), df.columns, [*keys, CHUNK], order, specs)


def _running(joined: DataFrame, columns: Sequence[str], part: Sequence[str], order: Sequence[str], specs: dict[str, Spec]) -> DataFrame:
    """Running columns inside ``part``, continued from the state ``_c_*`` on every row."""
    inside = W.partitionBy(*part).orderBy(*order)
    back = W.partitionBy(*part).orderBy(*[F.desc(o) for o in order])
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    upto_prev = inside.rowsBetween(W.unboundedPreceding, -1)
    out = []
    for name, s in specs.items():
        e, c = F.col(f"_e_{name}"), F.col(f"_c_{name}")
        if s.kind == "lag":
            v = F.when(F.row_number().over(inside) == 1, c).otherwise(F.lag(e).over(inside))
        elif s.kind == "lead":
            v = F.when(F.lead(F.lit(1)).over(inside).isNull(), c).otherwise(F.lead(e).over(inside))
        elif s.kind == "sum":
            v = F.coalesce(F.sum(e).over(upto), F.lit(0)) + F.coalesce(c, F.lit(0))
        elif s.kind == "pmax":
            v = F.greatest(F.max(e).over(upto_prev), c)
        elif s.kind == "last":
            v = F.coalesce(F.last(e, ignorenulls=True).over(upto), c)
        else:
            v = F.coalesce(
                F.last(e, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0)), c
            )
        out.append(v.alias(name))
    kept = [c for c in columns if c not in specs]
    return joined.select(*kept, *out)


def gap_islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | None,
    start: str,
    end: str,
    gap: float | None = 0.0,
    run: Sequence[str] = (),
    island: str = "island",
) -> DataFrame:
    """Number the islands of an interval relation.

    A row opens an island when a ``run`` column changes from the row before it, or
    when it starts more than ``gap`` after every earlier end of the same run
    (``gap=None`` keeps runs whole). ``order[0]`` must be ``start``. The island is
    identified by the order columns of its first row.

    One pass: inside a chunk everything is decided by local windows except for the
    rows that may continue the island handed over by earlier chunks, and for those
    the carried (run, latest end, island) is enough.
    """
    keys, order, run = list(keys), list(order), list(run)
    at = [] if chunk is None else [chunk.alias(CHUNK)]
    inside = W.partitionBy(*keys, *[CHUNK for _ in at]).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    pos = F.struct(*order)
    state = F.struct(*run) if run else F.lit(True)

    loc = df.select("*", *at, state.alias("_run"))
    changed = ~F.lag("_run").over(inside).eqNullSafe(F.col("_run"))
    loc = loc.select("*", ((F.row_number().over(inside) > 1) & changed).cast("long").alias("_chg"))
    loc = loc.select("*", F.sum("_chg").over(upto).alias("_nrun"))
    # The run number grows with the order, so the largest (run, end) pair seen so far
    # holds the latest end of the current run.
    latest = F.max(F.struct("_nrun", F.col(end).alias("e"))).over(inside.rowsBetween(W.unboundedPreceding, -1))
    loc = loc.select("*", latest.alias("_prev"))
    new_run = F.col("_prev").isNull() | (F.col("_prev._nrun") != F.col("_nrun"))
    late = F.lit(False) if gap is None else (F.col(start) - F.col("_prev.e")) > F.lit(gap)
    opens = new_run | late
    if chunk is None:
        first = F.last(F.when(F.col("_new"), F.col("_pos")), ignorenulls=True).over(upto)
        return loc.select(*df.columns, opens.alias("_new"), pos.alias("_pos")).select(*df.columns, first.alias(island))
    loc = loc.select(*df.columns, CHUNK, "_run", "_nrun", opens.alias("_new"), pos.alias("_pos"))

    summary = loc.groupBy(*keys, CHUNK).agg(
        F.min_by("_run", "_pos").alias("first_run"),
        F.max_by("_run", "_pos").alias("last_run"),
        F.max("_nrun").alias("changes"),
        F.max(F.struct("_nrun", F.col(end).alias("e"))).alias("tail"),
        F.max(F.when(F.col("_new"), F.col("_pos"))).alias("last_new"),
    )
    up = W.partitionBy(*keys).orderBy(CHUNK)
    until = up.rowsBetween(W.unboundedPreceding, 0)
    before = up.rowsBetween(W.unboundedPreceding, -1)
    joins = F.lag("last_run").over(up).eqNullSafe(F.col("first_run")) & F.lag(F.lit(1)).over(up).isNotNull()
    c = summary.select("*", F.coalesce(joins, F.lit(False)).alias("joins"))
    runs = F.sum(F.col("changes") + F.when(F.col("joins"), 0).otherwise(1)).over(until)
    c = c.select("*", runs.alias("g"))
    c = c.select("*", F.max(F.struct("g", F.col("tail.e").alias("e"))).over(before).alias("carry"))
    opened_after = (
        F.lit(False)
        if gap is None
        else (F.col(f"last_new.{order[0]}") - F.col("carry.e")) > F.lit(gap)
    )
    own = (F.col("changes") > 0) | ~F.col("joins") | opened_after
    carry_id = F.last(F.when(own, F.col("last_new")), ignorenulls=True).over(before)
    carried = c.select(*keys, CHUNK, "joins", F.col("carry.e").alias("carry_e"), carry_id.alias("carry_id"))

    row = loc.join(carried, [*keys, CHUNK], "left")
    continues = F.col("joins") & (F.col("_nrun") == 0)
    reopened = F.lit(False) if gap is None else (F.col(start) - F.col("carry_e")) > F.lit(gap)
    opens = F.col("_new") & (~continues | reopened)
    row = row.select("*", F.when(opens, F.col("_pos")).alias("_open"))
    seen = F.last("_open", ignorenulls=True).over(upto)
    return row.select(*df.columns, F.coalesce(seen, F.col("carry_id")).alias(island))


def collapse_islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | None,
    start: str = "start_s",
    end: str = "end_s",
    gap: float | None = 0.0,
    run: Sequence[str] = (),
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per island: bounds, row count and any further aggregates."""
    rows = gap_islands(df, keys, order, chunk, start, end, gap, run)
    return (
        rows.groupBy(*keys, *run, "island")
        .agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"), *extra)
        .drop("island")
    )


def attach(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a detail table to one row per key.

    A plain equi-join: at run time the small side is broadcast if its measured size
    allows, otherwise a hot key's partition is split and its one small row repeated (the
    adaptive skew join, forced in ``session.pin``). Without keys ``small`` is one row.
    """
    keys = list(keys)
    if keys:
        return big.join(small, keys, how)
    one = F.lit(1).alias("_one")
    return big.select("*", one).join(F.broadcast(small.select("*", one)), "_one", how).drop("_one")


def with_group_aggs(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Group aggregates on every row (an unordered window without its single-task groups)."""
    small = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return attach(df, small, keys)


AT_BITS = 33  # monotonically_increasing_id counts the rows of a partition in its lower bits


def ranges(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` sorted and dealt into ranges of the columns ``by``: ``_range`` in their order, ``_at`` the place inside it.

    Ranges are cut by sampled values of all columns together, so a large key or a frequent value is cut like any other.
    """
    cols = [F.col(c) for c in by]
    spread = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    return cut(spread.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND((1 << AT_BITS) - 1).alias("_at")))


def places(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Place (from 0) of each row of ``ranges`` among the rows of its key."""
    keys = list(keys)
    part = df.groupBy(*keys, "_range").agg(F.count("*").alias("_k"), F.min("_at").alias("_first"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    part = part.select(*keys, "_range", (F.coalesce(F.sum("_k").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return attach(df, part, [*keys, "_range"], "inner").withColumn(out, F.col("_at") + F.col("_shift")).drop("_shift")


def cumulative_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per key with their count and the number of rows strictly below.

    Distinct values are dealt into ranges, so the running count is a chunked scan rather than one sort per key.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias(value)).where(
        F.col(value).isNotNull() & ~F.isnan(value)
    )
    counts = ranges(rows.groupBy(*keys, value).agg(F.count("*").alias("n_equal")), [*keys, value])
    s = scan(counts, keys, [value], F.col("_range"), {"_c": running_sum("n_equal")})
    return s.select(*keys, value, "n_equal", (F.col("_c") - F.col("n_equal")).alias("n_below"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], whole: bool = False) -> DataFrame:
    """Exact linearly interpolated quantiles per key.

    The values at the two ranks around each quantile are read from the running counts, which are cut into ranges: one way
    for every size, and no task holds a whole key. ``whole`` sorts the values of a key in one row instead, for keys
    counted and found small.
    """
    keys = list(keys)
    if whole:
        v = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        g = v.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_a"))
        out = []
        for name, p in probs.items():
            rank = F.lit(float(p)) * (F.size("_a") - 1)
            lo, hi = (F.element_at("_a", (r + 1).cast("int")) for r in (F.floor(rank), F.ceil(rank)))
            out.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
        return g.select(*keys, *out)
    c = cumulative_counts(df.select(*keys, F.col(value).alias("_v")), keys, "_v")
    c = attach(c, c.groupBy(*keys).agg(F.sum("n_equal").alias("_n")), keys)
    out = []
    for name, p in probs.items():
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        at = lambda r: F.max(F.when((F.col("n_below") <= r) & (r < F.col("n_below") + F.col("n_equal")), F.col("_v")))
        lo, hi = at(F.floor(rank)), at(F.ceil(rank))
        out.append((lo + (hi - lo) * F.max(rank - F.floor(rank))).alias(name))
    g = c.groupBy(*keys).agg(*out)
    return g if keys else g.where(F.coalesce(*[F.col(n) for n in probs]).isNotNull())


def average_rank(
    df: DataFrame, keys: Sequence[str], value: str, out: str
) -> DataFrame:
    """Tie-averaged rank of ``value`` within ``keys`` on every row (NULL stays NULL)."""
    ranks = cumulative_counts(df, keys, value).select(
        *keys,
        F.col(value).alias("_rv"),
        (F.col("n_below") + (F.col("n_equal") + 1) / 2.0).alias(out),
        F.col("n_equal").alias(f"{out}_ties"),
    )
    left = df.withColumn("_rv", F.col(value).cast("double"))
    return attach(left, ranks, [*keys, "_rv"], "left").drop("_rv")


def join_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two aggregated tables; without keys both hold one row."""
    return a.join(b, list(keys), how) if keys else attach(a, b, [], how)
