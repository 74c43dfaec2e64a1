"""Operators on interval relations (I-02 to I-15): ``session_id, role, start_s, end_s``.

Nothing here loops over a session: merges are chunked islands, simultaneous activity
is a running sum of +1/-1 edges, and matches go through the bucketed interval join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.session import cut

from .align import interval_join, role_pairs
from .scan import (
    by_width, chunk_width, collapse_islands, gap_islands, lag, lead, running_sum, attach, scan, with_group_aggs,
)

KEYS = ["session_id"]
TURN_MIN_S = 1.0
TURN_MAX_PAUSE_S = 3.0
FLOOR_MAX_GAP_S = 2.0
SWEEP_TRACKS = ["time", "frame", "role"]
FRAME_TRACK, ROLE_TRACK = 1, 2
TAKEOVER_MAX_GAP_S = 1.0
INTERRUPT_MIN_OVERLAP_S = 0.1
INTERRUPT_MIN_AFTER_S = 0.5


def duration() -> Column:
    return F.col("end_s") - F.col("start_s")


def mask_to_segments(
    frames: DataFrame, hop_s: float, merge_gap_s: float, chunk_frames: int
) -> DataFrame:
    """I-02: active frames to segments, then merge pauses up to ``merge_gap_s``.

    A segment ends on the first inactive frame, or on the last frame of the track.
    """
    keys = ["session_id", "role"]
    f = with_group_aggs(frames, keys, _last=F.max("frame_idx")).where("active")
    seg = collapse_islands(
        f.withColumn("_e", F.col("frame_idx")), keys, ["frame_idx"],
        by_width("frame_idx", chunk_frames), "frame_idx", "_e", gap=1,
        extra=[F.max("_last").alias("_last")],
    )
    seg = seg.select(
        *keys,
        (F.col("frame_idx") * hop_s).alias("start_s"),
        (F.least(F.col("_e") + 1, F.col("_last")) * hop_s).alias("end_s"),
    )
    return merge_gaps(cut(seg), merge_gap_s, chunk_frames * hop_s)


def merge_gaps(segs: DataFrame, merge_gap_s: float, chunk_s: float) -> DataFrame:
    keys = ["session_id", "role"]
    return collapse_islands(
        segs, keys, ["start_s", "end_s"], by_width("start_s", chunk_s), gap=merge_gap_s
    ).drop("n")


def total_duration(segs: DataFrame, keys: Sequence[str] = ("session_id", "role")) -> DataFrame:
    """I-03"""
    return segs.groupBy(*keys).agg(F.sum(duration()).alias("speech_s"), F.count("*").alias("n_segments"))


def edges(segs: DataFrame, keys: Sequence[str], start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Net change of the number of active intervals at each distinct moment."""
    e = segs.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col(start).alias("t"), F.lit(1).alias("d")),
                F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")),
            )
        ).alias("e"),
    )
    return e.groupBy(*keys, F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d"))


def activity_profile(
    segs: DataFrame, keys: Sequence[str], chunk: float, start: str = "start_s", end: str = "end_s"
) -> DataFrame:
    """Step function of simultaneous activity: ``t, next_t, level``."""
    s = scan(
        edges(segs, keys, start, end), keys, ["t"], by_width("t", chunk),
        {"level": running_sum("d"), "next_t": lead("t")},
    )
    return s.where(F.col("next_t").isNotNull()).select(*keys, "t", "next_t", "level")


def pairwise_overlap(segs: DataFrame, chunk_s: float) -> DataFrame:
    """I-04: shared speaking time of each role pair.

    The sum over segment pairs equals the integral of the product of the two activity
    levels, so no segment pair is ever built.
    """
    pairs = role_pairs(segs)
    sides = pairs.select(
        "session_id", "role_a", "role_b",
        F.explode(F.array(F.col("role_a"), F.col("role_b"))).alias("role"),
    )
    s = segs.join(sides, ["session_id", "role"])
    side = F.when(F.col("role") == F.col("role_a"), "a").otherwise("b")
    keys = ["session_id", "role_a", "role_b"]
    e = s.withColumn("side", side).select(
        *keys, "side",
        F.explode(
            F.array(
                F.struct(F.col("start_s").alias("t"), F.lit(1).alias("d")),
                F.struct(F.col("end_s").alias("t"), F.lit(-1).alias("d")),
            )
        ).alias("e"),
    )
    e = e.groupBy(*keys, F.col("e.t").alias("t")).agg(
        F.sum(F.when(F.col("side") == "a", F.col("e.d")).otherwise(0)).alias("da"),
        F.sum(F.when(F.col("side") == "b", F.col("e.d")).otherwise(0)).alias("db"),
    )
    p = scan(
        e, keys, ["t"], by_width("t", chunk_s),
        {"na": running_sum("da"), "nb": running_sum("db"), "next_t": lead("t")},
    )
    both = F.col("na") * F.col("nb") * (F.col("next_t") - F.col("t"))
    return p.groupBy(*keys).agg(F.sum(both).alias("overlap_s"))


def merge_union(segs: DataFrame, chunk_s: float) -> DataFrame:
    """I-05: maximal intervals during which anybody is active."""
    return collapse_islands(
        segs, KEYS, ["start_s", "end_s", "role"], by_width("start_s", chunk_s), gap=0.0
    ).drop("n")


def silence_intervals(segs: DataFrame, totals: DataFrame, chunk_s: float) -> DataFrame:
    """I-06: complement of the union inside ``[0, total_s]``, head and tail included."""
    u = cut(merge_union(segs, chunk_s))
    bounds = totals.select("session_id", F.col("total_s").alias("start_s"), F.col("total_s").alias("end_s"))
    w = scan(
        u.unionByName(bounds), KEYS, ["start_s", "end_s"],
        by_width("start_s", chunk_s), {"before": lag("end_s")},
    )
    w = w.select(
        "session_id", F.coalesce("before", F.lit(0.0)).alias("start_s"), F.col("start_s").alias("end_s")
    )
    w = attach(w, totals, KEYS)
    return w.select(
        "session_id", "start_s", F.least("end_s", "total_s").alias("end_s")
    ).where("end_s > start_s")


def multi_active_intervals(segs: DataFrame, k: int, chunk_s: float) -> DataFrame:
    """I-07: maximal intervals with at least ``k`` active at once."""
    p = cut(activity_profile(segs, KEYS, chunk_s).where(F.col("level") >= k))
    return collapse_islands(
        p, KEYS, ["t", "next_t"], by_width("t", chunk_s), "t", "next_t", gap=0.0
    ).select("session_id", F.col("t").alias("start_s"), F.col("next_t").alias("end_s"))


def occupancy_timeline(
    segs: DataFrame, totals: DataFrame, fs: float, chunk_s: float
) -> DataFrame:
    """I-09: number of simultaneous speakers as runs of integer frames.

    A segment covers frames ``floor(start*fs) .. ceil(end*fs)-1``, cut at the end of the
    session. Cost follows the number of segments, not of frames.
    """
    n = totals.select("session_id", F.ceil(F.col("total_s") * fs).cast("long").alias("n_frames"))
    s = attach(segs, n, KEYS, "inner")
    s = s.select(
        "session_id",
        F.least(F.floor(F.col("start_s") * fs).cast("long"), "n_frames").alias("start_s"),
        F.least(F.ceil(F.col("end_s") * fs).cast("long"), "n_frames").alias("end_s"),
    ).where("end_s > start_s")
    p = activity_profile(s, KEYS, chunk_s * fs)
    return p.select(
        "session_id", F.col("t").alias("frame_start"), F.col("next_t").alias("frame_end"), "level"
    )


def occupancy(
    segs: DataFrame, totals: DataFrame, chunk_s: float, fs: float = 100.0, max_level: int = 3
) -> DataFrame:
    """I-08: share of frames with 0, 1, .. ``max_level`` or more speakers."""
    runs = occupancy_timeline(segs, totals, fs, chunk_s)
    width = F.col("frame_end") - F.col("frame_start")
    busy = runs.groupBy("session_id").agg(
        *[
            F.sum(F.when(F.col("level") == lv if lv < max_level else F.col("level") >= lv, width).otherwise(0))
            .alias(f"f{lv}")
            for lv in range(1, max_level + 1)
        ]
    )
    n = totals.select("session_id", F.ceil(F.col("total_s") * fs).cast("long").alias("n_frames"))
    o = n.where("n_frames > 0").join(busy, "session_id", "left").na.fill(0)
    idle = F.col("n_frames") - sum((F.col(f"f{lv}") for lv in range(1, max_level + 1)), F.lit(0))
    shares = [F.round(idle / F.col("n_frames"), 6).alias("pct_0")]
    shares += [
        F.round(F.col(f"f{lv}") / F.col("n_frames"), 6).alias(f"pct_{lv}") for lv in range(1, max_level + 1)
    ]
    multi = sum((F.col(f"f{lv}") for lv in range(2, max_level + 1)), F.lit(0))
    return o.select("session_id", *shares, F.round(multi / F.col("n_frames"), 6).alias("overlap_ratio"))


def role_sweep(segs: DataFrame, totals: DataFrame, chunk_s: float | None, fs: float = 100.0) -> DataFrame:
    """Step functions of activity, all from one scan of the segments: ``session_id, track, role, t, next_t, level``.

    Tracks: ``time`` (how many segments of the session are active), ``role`` (how many of one role) and ``frame`` (as
    ``time``, on the integer frames of I-09). Silence, union, overlap and occupancy are sums over these rows; so is the
    overlap of all role pairs, half of the integral of level^2 of the session less that of its roles.
    """
    width = chunk_width(segs, KEYS, chunk_s)
    s = attach(segs, totals.select("session_id", F.ceil(F.col("total_s") * fs).cast("long").alias("_n")), KEYS)
    f0, f1 = F.least(F.floor(F.col("start_s") * fs).cast("long"), "_n"), F.least(F.ceil(F.col("end_s") * fs).cast("long"), "_n")
    edge = lambda kind, role, t, d: F.struct(kind.alias("_kind"), role.alias("_role"), t.cast("double").alias("t"), F.lit(d).alias("d"))
    # The role of a group is text without nulls; segments without a role are a kind of their own.
    none, real, no_role = F.lit(""), F.coalesce(F.col("role").cast("string"), F.lit("")), F.lit(len(SWEEP_TRACKS))
    own = F.when(F.col("role").isNull(), no_role).otherwise(ROLE_TRACK)
    rows = F.array(*[
        edge(kind, role, t, d)
        for kind, role, ends in ((F.lit(0), none, ("start_s", "end_s")), (own, real, ("start_s", "end_s")), (F.lit(FRAME_TRACK), none, (f0, f1)))
        for t, d in ((F.col(ends[0]) if isinstance(ends[0], str) else ends[0], 1), (F.col(ends[1]) if isinstance(ends[1], str) else ends[1], -1))
    ])
    rows = F.filter(rows, lambda e: (e["_kind"] != FRAME_TRACK) | (f1 > f0))
    e = s.select("session_id", F.explode(rows).alias("e")).select("session_id", "e.*")
    chunk = None if width is None else F.floor(F.col("t") / F.when(F.col("_kind") == FRAME_TRACK, width * fs).otherwise(width)).cast("long")
    p = scan(e, ["session_id", "_kind", "_role"], ["t"], chunk, {"level": running_sum("d"), "next_t": lead("t")})
    # Of edges at one moment the last has the level that holds until the next moment.
    p = p.where(F.col("next_t").isNull() | (F.col("next_t") > F.col("t")))
    track = F.element_at(F.array(*[F.lit(n) for n in (*SWEEP_TRACKS, SWEEP_TRACKS[ROLE_TRACK])]), F.col("_kind") + 1)
    return p.select("session_id", track.alias("track"), F.when(F.col("_kind") == ROLE_TRACK, F.col("_role")).alias("role"), "t", "next_t", "level")


def sweep_summary(sweep: DataFrame, totals: DataFrame, fs: float = 100.0, max_level: int = 3) -> DataFrame:
    """Pauses, overlap, overlap of role pairs and occupancy per session, from one pass over ``role_sweep``."""
    d = attach(sweep, totals, KEYS, "inner")
    is_track = lambda name: F.col("track") == name
    width, level = F.col("next_t") - F.col("t"), F.col("level")
    gap = F.when(is_track("time") & (level == 0) & F.col("next_t").isNotNull(), F.least("next_t", "total_s") - F.col("t"))
    gap = F.when(gap > 0, gap)
    frames = [F.sum(F.when(is_track("frame") & (level == lv if lv < max_level else level >= lv), width).otherwise(0)).alias(f"f{lv}") for lv in range(1, max_level + 1)]
    square = level * level * width
    g = d.groupBy("session_id").agg(
        F.sum(gap).alias("_gap_s"), F.count(gap).alias("_gaps"),
        F.min(F.when(is_track("time"), F.col("t"))).alias("_first"), F.max(F.when(is_track("time"), F.col("t"))).alias("_last"),
        F.sum(F.when(is_track("time") & (level >= 2), width)).alias("overlap_s"),
        ((F.sum(F.when(is_track("time"), square)) - F.sum(F.when(is_track("role"), square))) / 2.0).alias("pairwise_overlap_s"), *frames,
    )
    o = totals.join(g, "session_id", "left")
    # Silence before the first and after the last segment; all of it where there is none.
    head = F.least(F.coalesce("_first", "total_s"), "total_s")
    tail = F.when(F.col("_last").isNotNull(), F.col("total_s") - F.col("_last"))
    silence = F.coalesce("_gap_s", F.lit(0.0)) + F.greatest(head, F.lit(0.0)) + F.greatest(F.coalesce(tail, F.lit(0.0)), F.lit(0.0))
    pauses = F.coalesce("_gaps", F.lit(0)) + (head > 0).cast("int") + F.coalesce((tail > 0).cast("int"), F.lit(0))
    n = F.ceil(F.col("total_s") * fs)
    busy = [F.coalesce(f"f{lv}", F.lit(0)) for lv in range(1, max_level + 1)]
    share = lambda c: F.when(n > 0, F.round(c / n, 6))
    return o.select(
        "session_id", silence.alias("pause_time_s"), F.try_divide(silence, pauses).alias("mean_pause_s"), "overlap_s", "pairwise_overlap_s",
        share(n - sum(busy, F.lit(0))).alias("pct_0"), *[share(b).alias(f"pct_{lv + 1}") for lv, b in enumerate(busy)], share(sum(busy[1:], F.lit(0))).alias("overlap_ratio"),
    )


def activity_synchrony(frames: DataFrame) -> DataFrame:
    """I-10: Pearson correlation of the binary activity of each role pair.

    Tracks are cut to the shortest one; only active frames are joined, the rest follows
    from counts.
    """
    ends = frames.groupBy("session_id", "role").agg((F.max("frame_idx") + 1).alias("len"))
    n = ends.groupBy("session_id").agg(F.min("len").alias("n"))
    act = attach(frames.where("active").select("session_id", "role", "frame_idx"), n, KEYS, "inner")
    act = act.where("frame_idx < n").select("session_id", "role", "frame_idx")
    s = ends.select("session_id", "role").join(
        act.groupBy("session_id", "role").agg(F.count("*").alias("s")), ["session_id", "role"], "left"
    ).na.fill(0, ["s"])
    a = act.withColumnRenamed("role", "role_a")
    b = act.withColumnRenamed("role", "role_b")
    both = (
        a.join(b, ["session_id", "frame_idx"]).where("role_a < role_b")
        .groupBy("session_id", "role_a", "role_b").agg(F.count("*").alias("sab"))
    )
    p = role_pairs(ends).join(n, "session_id").join(both, ["session_id", "role_a", "role_b"], "left")
    p = p.na.fill(0, ["sab"])
    p = p.join(s.select("session_id", F.col("role").alias("role_a"), F.col("s").alias("sa")), ["session_id", "role_a"])
    p = p.join(s.select("session_id", F.col("role").alias("role_b"), F.col("s").alias("sb")), ["session_id", "role_b"])
    va = F.col("sa") * (F.col("n") - F.col("sa"))
    vb = F.col("sb") * (F.col("n") - F.col("sb"))
    num = F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")
    r = F.try_divide(num.cast("double"), F.sqrt(va.cast("double")) * F.sqrt(vb.cast("double")))
    return p.select("session_id", "role_a", "role_b", "n", r.alias("synchrony"))


def aggregate_turns(
    segs: DataFrame, chunk_s: float | None, turn_min_s: float = TURN_MIN_S, max_pause_s: float = TURN_MAX_PAUSE_S
) -> DataFrame:
    """I-11: segments to conversational turns.

    Same-role neighbours with a pause of at most ``max_pause_s`` form one turn, turns
    shorter than ``turn_min_s`` are dropped, and what became adjacent is merged again.
    """
    width = chunk_width(segs, KEYS, chunk_s)

    def merge(df, order):
        # A turn keeps the place of its first segment among turns that start together.
        rows = gap_islands(df, KEYS, order, by_width("start_s", width), "start_s", "end_s", max_pause_s, ["role"])
        return rows.groupBy(*KEYS, "role", "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))

    first = merge(segs.select(*KEYS, "role", "start_s", "end_s"), ["start_s", "end_s", "role"])
    first = first.where(duration() >= turn_min_s).select(*KEYS, "role", "start_s", "end_s", F.col("island.end_s").alias("_first_end"))
    return merge(first if width is None else cut(first), ["start_s", "_first_end", "role"]).select("session_id", "role", "start_s", "end_s")


def next_turns(turns: DataFrame, chunk_s: float | None) -> DataFrame:
    """Each turn with the role of the next one and the gap to it."""
    n = scan(
        turns.withColumn("_next", F.struct("role", "start_s")), KEYS, ["start_s", "end_s", "role"],
        by_width("start_s", chunk_s), {"nxt": lead("_next")},
    )
    return n.select("session_id", "role", "start_s", "end_s", F.col("nxt.role").alias("to_role"), (F.col("nxt.start_s") - F.col("end_s")).alias("gap_s"))


def is_exchange(max_gap_s: float = FLOOR_MAX_GAP_S, include_zero: bool = False) -> Column:
    """Whether a row of ``next_turns`` passes the floor to another role."""
    low = F.col("gap_s") >= 0 if include_zero else F.col("gap_s") > 0
    return (F.col("role") != F.col("to_role")) & low & (F.col("gap_s") <= max_gap_s)


def floor_exchanges(
    turns: DataFrame,
    chunk_s: float,
    max_gap_s: float = FLOOR_MAX_GAP_S,
    include_zero: bool = False,
    min_turn_s: float = 0.0,
) -> DataFrame:
    """I-12: pauses between consecutive turns of different roles."""
    n = next_turns(turns.where(duration() >= min_turn_s), chunk_width(turns, KEYS, chunk_s)).where(is_exchange(max_gap_s, include_zero))
    return n.select("session_id", F.col("role").alias("from_role"), "to_role", F.col("end_s").alias("at_s"), "gap_s")


def _sides(segs: DataFrame, min_turn_s: float) -> tuple[DataFrame, DataFrame]:
    s = segs.where(duration() >= min_turn_s)
    a = s.select("session_id", F.col("role").alias("source"), F.col("start_s").alias("a_s"), F.col("end_s").alias("a_e"))
    b = s.select("session_id", F.col("role").alias("target"), F.col("start_s").alias("b_s"), F.col("end_s").alias("b_e"))
    return a, b


def rapid_takeovers(
    segs: DataFrame, max_gap_s: float = TAKEOVER_MAX_GAP_S, min_turn_s: float = TURN_MIN_S
) -> DataFrame:
    """I-13: target starts within ``max_gap_s`` after an end of the source."""
    a, b = _sides(segs, min_turn_s)
    gap = F.col("b_s") - F.col("a_e")
    a = a.withColumn("a_until", F.col("a_e") + F.lit(max_gap_s * 1.001))
    hit = interval_join(
        a, b.withColumn("b_at", F.col("b_s")), KEYS, max(max_gap_s, 1.0) * 4, ("a_e", "a_until"), ("b_s", "b_at"),
        (F.col("source") != F.col("target")) & (gap > 0) & (gap <= max_gap_s), levels=1,
    )
    return hit.select("session_id", "source", "target", "a_e", "b_s")


def interruption_events(
    segs: DataFrame,
    width_s: float = 10.0,
    min_overlap_s: float = INTERRUPT_MIN_OVERLAP_S,
    min_after_s: float = INTERRUPT_MIN_AFTER_S,
    min_turn_s: float = TURN_MIN_S,
) -> DataFrame:
    """I-19: target starts while the source speaks; success when it outlasts the source."""
    a, b = _sides(segs, min_turn_s)
    overlap = F.least("a_e", "b_e") - F.col("b_s")
    hit = interval_join(
        a, b.withColumn("b_at", F.col("b_s")), KEYS, width_s, ("a_s", "a_e"), ("b_s", "b_at"),
        (F.col("source") != F.col("target")) & (F.col("a_s") < F.col("b_s")) & (F.col("b_s") < F.col("a_e"))
        & (overlap >= min_overlap_s),
    )
    return hit.select(
        "session_id", "source", "target", F.col("b_s").alias("at_s"),
        (F.least("a_e", "b_e") - F.col("b_s")).alias("overlap_s"),
        ((F.col("b_e") - F.col("a_e")) >= min_after_s).alias("success"),
    )


def interruptions(segs: DataFrame, **kw) -> DataFrame:
    """I-14: attempts and successes per directed role pair."""
    return interruption_events(segs, **kw).groupBy("session_id", "source", "target").agg(
        F.count("*").alias("attempts"), F.sum(F.col("success").cast("long")).alias("successes")
    )


def turn_taking(
    segs: DataFrame, width_s: float = 10.0, max_gap_s: float = TAKEOVER_MAX_GAP_S, min_overlap_s: float = INTERRUPT_MIN_OVERLAP_S,
    min_after_s: float = INTERRUPT_MIN_AFTER_S, min_turn_s: float = TURN_MIN_S,
) -> DataFrame:
    """I-13 and I-14 per session from one interval join: rapid takeovers, attempted and successful interruptions."""
    a, b = _sides(segs, min_turn_s)
    gap, overlap = F.col("b_s") - F.col("a_e"), F.least("a_e", "b_e") - F.col("b_s")
    takes = (gap > 0) & (gap <= max_gap_s)
    breaks = (F.col("a_s") < F.col("b_s")) & (gap < 0) & (overlap >= min_overlap_s)
    hit = interval_join(
        a.withColumn("a_until", F.col("a_e") + F.lit(max_gap_s * 1.001)), b.withColumn("b_at", F.col("b_s")), KEYS, width_s,
        ("a_s", "a_until"), ("b_s", "b_at"), (F.col("source") != F.col("target")) & (takes | breaks),
    )
    return hit.groupBy("session_id").agg(
        F.sum(takes.cast("long")).alias("rapid_floor_takeovers_total"), F.sum(breaks.cast("long")).alias("n_attempted_interruptions"),
        F.sum((breaks & (F.col("b_e") - F.col("a_e") >= min_after_s)).cast("long")).alias("n_successful_interruptions"),
    )


def backchannels(
    segs: DataFrame,
    turns: DataFrame,
    min_s: float = 0.10,
    max_s: float = 0.70,
    min_overlap_s: float = 0.10,
    continuation_s: float = 0.20,
    proximity_s: float = 0.50,
    turn_start_s: float = 0.50,
) -> DataFrame:
    """I-15: short segments given while another role holds or has just held the floor.

    Kept when near a segment of another role, not the continuation of an own segment,
    and not the opening of an own turn. All three come from one join on time buckets.
    """
    key = ["session_id", "role", "start_s", "end_s"]
    cand = segs.where(duration().between(min_s, max_s)).select(*key)
    pad = max(proximity_s, continuation_s, turn_start_s) * 1.001
    probe = cand.groupBy(*key).agg(F.count("*").alias("_n")).select(
        "*", (F.col("start_s") - pad).alias("lo"), (F.col("end_s") + pad).alias("hi")
    )
    other = segs.select(
        "session_id", F.col("role").alias("o_role"), F.col("start_s").alias("o_s"), F.col("end_s").alias("o_e")
    )
    after, ahead = F.col("start_s") - F.col("o_e"), F.col("o_s") - F.col("end_s")
    overlap = F.greatest(F.lit(0.0), F.least("end_s", "o_e") - F.greatest("start_s", "o_s"))
    near = (overlap >= min_overlap_s) | after.between(0, proximity_s) | ahead.between(0, proximity_s)
    is_turn, same = F.col("_turn"), F.col("role") == F.col("o_role")
    near = ~is_turn & ~same & near
    continued = ~is_turn & same & (after > 0) & (after <= continuation_s) & ~((F.col("o_s") == F.col("start_s")) & (F.col("o_e") == F.col("end_s")))
    opening = is_turn & same & (F.abs(F.col("o_s") - F.col("start_s")) < turn_start_s)
    starts = turns.select("session_id", F.col("role").alias("o_role"), F.col("start_s").alias("o_s"), F.col("start_s").alias("o_e"), F.lit(True).alias("_turn"))
    hit = interval_join(
        probe, other.withColumn("_turn", F.lit(False)).unionByName(starts), KEYS, 10.0, ("lo", "hi"), ("o_s", "o_e"), near | continued | opening,
    )
    # Equal candidates are one probe and come back as often as they were given.
    ok = hit.groupBy(*key).agg(F.max("_n").alias("_n"), F.bool_or(near).alias("_near"), F.bool_or(continued | opening).alias("_not"))
    return ok.where("_near and not _not").select(*key, F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_i")).drop("_i")


def common_window(samples: DataFrame, t: str = "t", keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """I-20: the span every role covers: latest first and earliest last sample."""
    per = samples.groupBy(*keys, "role").agg(F.min(t).alias("a"), F.max(t).alias("b"))
    return per.groupBy(*keys).agg(F.max("a").alias("t0"), F.min("b").alias("t1"))


def align_tracks(samples: DataFrame, markers: DataFrame, t: str = "t") -> DataFrame:
    """I-21: shift every track by its marker's delay against the earliest marker."""
    m = markers.groupBy("session_id", "role").agg(F.min(t).alias("_m"))
    ref = m.groupBy("session_id").agg(F.min("_m").alias("_ref"))
    shift = m.join(ref, "session_id").select("session_id", "role", (F.col("_m") - F.col("_ref")).alias("shift_s"))
    return attach(samples, shift, ["session_id", "role"]).withColumn(
        t, F.col(t) - F.coalesce("shift_s", F.lit(0.0))
    )
