"""Episodes and windows on grids and irregular samples (G-01 to G-08).

A boolean mask is kept as runs ``frame_start, frame_end`` (half-open) of its true part,
so that later steps cost by the number of runs rather than frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from colloquy.session import cut

from .intervals import activity_profile
from .scan import (
    by_width, chunk_width, collapse_islands, lag, last_valid, lead, next_valid, quantiles, row_number, attach, scan,
)

CHUNK_FRAMES = 65536


def sliding_windows(spans: DataFrame, win: float, step: float) -> DataFrame:
    """G-01: windows over ``[t0, t1)``; those at the end are cut at ``t1``."""
    n = F.ceil((F.col("t1") - F.col("t0")) / step).cast("long")
    w = spans.where("t1 > t0").withColumn("window_idx", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    start = F.col("t0") + F.col("window_idx") * F.lit(step)
    return w.withColumn("t_start", start).withColumn("t_end", F.least(start + F.lit(win), F.col("t1"))).drop("t0", "t1")


def mask_runs(frames: DataFrame, keys: Sequence[str], chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """Runs of consecutive frames present in ``frames``."""
    f = frames.select(*keys, F.col("frame_idx").alias("frame_start"), F.col("frame_idx").alias("frame_end")).distinct()
    r = collapse_islands(
        f, keys, ["frame_start"], by_width("frame_start", chunk_frames), "frame_start", "frame_end", gap=1
    )
    return r.select(*keys, "frame_start", (F.col("frame_end") + 1).alias("frame_end"))


def union_runs(runs: DataFrame, keys: Sequence[str], chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """Runs of the OR of several masks."""
    r = runs.select(*keys, "frame_start", "frame_end").where("frame_end > frame_start")
    return collapse_islands(
        r, keys, ["frame_start", "frame_end"], by_width("frame_start", chunk_frames), "frame_start", "frame_end", gap=0
    ).drop("n")


def runs_at_least(runs: DataFrame, keys: Sequence[str], k: int, chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """Runs of the frames covered by at least ``k`` of the given runs."""
    p = activity_profile(
        runs.where("frame_end > frame_start"), keys, chunk_frames, "frame_start", "frame_end"
    ).where(F.col("level") >= k)
    p = p.select(*keys, F.col("t").alias("frame_start"), F.col("next_t").alias("frame_end"))
    return union_runs(cut(p), keys, chunk_frames)


def drop_micro(runs: DataFrame, fs: float, min_s: float) -> DataFrame:
    """G-04"""
    return runs.where((F.col("frame_end") - F.col("frame_start")) / F.lit(fs) >= min_s)


def episode_stats(runs: DataFrame, keys: Sequence[str], fs: float, prefix: str = "") -> DataFrame:
    """G-02: number, total and mean duration of the runs."""
    d = (F.col("frame_end") - F.col("frame_start")) / F.lit(fs)
    return runs.groupBy(*keys).agg(
        F.count("*").alias(f"{prefix}n_episodes"), F.sum(d).alias(f"{prefix}dur_total_s"), F.avg(d).alias(f"{prefix}dur_mean_s")
    )


def median_step(samples: DataFrame, keys: Sequence[str], t: str, chunk_s: float | None, out: str = "dt_s") -> DataFrame:
    """G-05: median positive time step."""
    width = chunk_width(samples, keys, chunk_s)
    d = scan(samples.select(*keys, t), keys, [t], by_width(t, width), {"_p": lag(t)})
    d = d.withColumn("_d", F.col(t) - F.col("_p")).where("_d > 0")
    return quantiles(d, keys, "_d", {out: 0.5}, bool(keys) and width is None)


def irregular_episodes(
    samples: DataFrame,
    keys: Sequence[str],
    t: str,
    chunk_s: float | None,
    min_episode_s: float = 0.0,
    merge_gap_s: float = 0.0,
    end: str = "last",
) -> DataFrame:
    """G-03: runs of true ``state`` as intervals, close ones merged, short ones dropped.

    ``end="last"`` closes a run on its last true sample (one sample lasts 0 s);
    ``end="next"`` on the first false one, or a median step after the last sample.
    """
    keys = list(keys)
    chunk_s = chunk_width(samples, keys, chunk_s)
    again = (lambda d: d) if chunk_s is None else cut  # a scan over chunks reads its rows twice
    rows = samples.select(*keys, t, F.col("state").alias("state"), F.col(t).alias("_e"))
    runs = collapse_islands(rows, keys, [t], by_width(t, chunk_s), t, "_e", gap=None, run=["state"])
    if end == "next":
        runs = scan(again(runs), keys, [t], by_width(t, chunk_s), {"_n": lead(t)})
        dt = median_step(samples, keys, t, chunk_s)
        runs = attach(runs, dt, keys).withColumn(
            "_e", F.coalesce("_n", F.col("_e") + F.coalesce("dt_s", F.lit(0.05)))
        )
    ep = runs.where("state").select(*keys, F.col(t).alias("start_s"), F.col("_e").alias("end_s"))
    if merge_gap_s > 0:
        ep = collapse_islands(
            again(ep), keys, ["start_s", "end_s"], by_width("start_s", chunk_s), gap=merge_gap_s
        ).drop("n")
    return ep.where((F.col("end_s") - F.col("start_s")) >= min_episode_s)


def time_align(
    samples: DataFrame, keys: Sequence[str], t: str, values: Sequence[str], chunk_s: float, by: str = "row"
) -> DataFrame:
    """G-07: zero at the first marker (or first sample), markers removed, gaps filled.

    ``is_marker`` flags marker rows. Missing values are interpolated between their
    neighbours by row position (``by="row"``) or by time, and carried to both ends.
    """
    keys = list(keys)
    zero = samples.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("is_marker"), F.col(t))), F.min(t)).alias("_zero")
    )
    d = attach(samples.where("not is_marker"), zero, keys).withColumn(t, F.col(t) - F.col("_zero"))
    first = F.min(F.struct(*values))
    d = d.where(F.col(t).isNotNull()).groupBy(*keys, t).agg(first.alias("_v"))
    d = d.select(*keys, t, *[F.col(f"_v.{v}").alias(v) for v in values])
    chunk = by_width(t, chunk_s)
    if by == "row":
        d = cut(scan(d, keys, [t], chunk, {"_x": row_number()}))
    else:
        d = d.withColumn("_x", F.col(t))
    specs = {}
    for v in values:
        known = F.when(F.col(v).isNotNull(), F.struct(F.col("_x").alias("x"), F.col(v).alias("v")))
        specs[f"_b_{v}"], specs[f"_f_{v}"] = last_valid(known), next_valid(known)
    d = scan(d, keys, [t], chunk, specs)
    filled = []
    for v in values:
        b, f = f"_b_{v}", f"_f_{v}"
        mid = F.col(f"{b}.v") + (F.col(f"{f}.v") - F.col(f"{b}.v")) * (
            (F.col("_x") - F.col(f"{b}.x")) / (F.col(f"{f}.x") - F.col(f"{b}.x"))
        )
        filled.append(
            F.when(F.col(v).isNotNull(), F.col(v))
            .when(F.col(b).isNull(), F.col(f"{f}.v"))
            .when(F.col(f).isNull(), F.col(f"{b}.v"))
            .otherwise(mid)
            .alias(v)
        )
    return d.select(*keys, t, *filled)


def fixations(
    samples: DataFrame, keys: Sequence[str], t: str, chunk_s: float, min_fix_s: float = 0.2, max_gap_s: float | None = None
) -> DataFrame:
    """G-08: runs of samples on the same ``object``, from first to last sample."""
    keys = list(keys)
    rows = samples.select(*keys, "object", t, F.col(t).alias("_e"))
    r = collapse_islands(rows, keys, [t, "object"], by_width(t, chunk_s), t, "_e", gap=max_gap_s, run=["object"])
    return r.select(*keys, "object", F.col(t).alias("onset"), F.col("_e").alias("offset")).where(
        (F.col("offset") - F.col("onset")) >= min_fix_s
    )
