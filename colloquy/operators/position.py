"""Positions and the per-window interaction graph (G-38 to G-43)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.scalars import compress_distance, distance
from colloquy.session import cut
from colloquy.stats.moments import pearson_by

from . import episodes as ep
from .align import _levels, asof, grid, interval_join, role_pairs
from .face import row_mean
from .scan import attach, chunk_width, with_group_aggs

POS = ["px", "py", "pz"]

# Names of surfaces that are not task objects.
FLOOR_WORDS = ["floor", "sol", "ground", "plancher"]


def is_floor(obj: Column) -> Column:
    low = F.lower(obj)
    out = F.lit(False)
    for w in FLOOR_WORDS:
        out = out | low.contains(w)
    return out


def _on_pairs(samples: DataFrame, spans: DataFrame, values, fs: float, tol: float, chunk_s: float) -> DataFrame:
    """Nearest sample of each role on a common grid, joined by role pair."""
    n = F.ceil((F.col("t1") - F.col("t0")) * fs).cast("long")
    g = grid(spans, n, fs).withColumn("t", F.col("t0") + F.col("frame_idx") / F.lit(fs))
    g = g.join(samples.select("session_id", "role").distinct(), "session_id").select("session_id", "role", "t", "frame_idx")
    a = asof(g, samples.select("session_id", "role", "t", *values), ["session_id", "role"], "t", values, chunk_s, "nearest", tol)
    a = cut(a.where(F.col("t_match").isNotNull()).select("session_id", "role", "frame_idx", "t", *values))
    l = a.select("session_id", "frame_idx", "t", F.col("role").alias("role_a"), *[F.col(v).alias(f"a_{v}") for v in values])
    r = a.select("session_id", "frame_idx", F.col("role").alias("role_b"), *[F.col(v).alias(f"b_{v}") for v in values])
    return l.join(r, ["session_id", "frame_idx"]).where("role_a < role_b")


def proximity(pos: DataFrame, spans: DataFrame, fs: float, chunk_s: float, win: float | None = None) -> DataFrame:
    """G-38: mean distance of each role pair on a common grid, per window if given."""
    p = _on_pairs(pos, spans, POS, fs, 1.0 / fs, chunk_s)
    d = distance([F.col(f"a_{c}") for c in POS], [F.col(f"b_{c}") for c in POS])
    k = ["session_id", "role_a", "role_b"]
    if win is not None:
        p = p.withColumn("window_idx", F.floor(F.col("frame_idx") / (win * fs)).cast("long"))
        k = [*k, "window_idx"]
    g = p.groupBy(*k).agg(F.avg(d).alias("distance_m_raw"))
    return g.withColumn("distance_m_display", compress_distance(F.col("distance_m_raw")))


def peer_gaze(eye: DataFrame, pos: DataFrame, chunk_s: float, radius_m: float = 0.45, tolerance_s: float = 0.10) -> DataFrame:
    """G-39: gaze samples of one role flagged where they land near another role.

    ``eye``: session_id, role, t, hx, hy, hz. Output samples carry a boolean ``state``.
    """
    rp = pos.select("session_id", F.col("role").alias("target")).distinct()
    e = eye.select("session_id", "role", "t", "hx", "hy", "hz").join(rp, "session_id").where("role != target")
    p = pos.select("session_id", F.col("role").alias("target"), "t", *POS)
    # A target meets at most all samples of its session.
    width = chunk_width(eye.select("session_id").unionByName(pos.select("session_id")), ["session_id"], chunk_s)
    j = asof(e, p, ["session_id", "target"], "t", POS, width, "nearest", tolerance_s)
    d = distance([F.col(c) for c in ("hx", "hy", "hz")], [F.col(c) for c in POS])
    return j.select("session_id", "role", "target", "t", F.coalesce(d <= radius_m, F.lit(False)).alias("state"))


def peer_gaze_episodes(flags: DataFrame, chunk_s: float, min_s: float = 0.15, merge_s: float = 0.10) -> DataFrame:
    """G-39: episodes of looking at a peer, per directed pair."""
    e = ep.irregular_episodes(flags, ["session_id", "role", "target"], "t", chunk_s, min_s, merge_s, end="next")
    return e.groupBy("session_id", "role", "target").agg(
        F.count("*").alias("n_episodes"), F.sum(F.col("end_s") - F.col("start_s")).alias("dur_total_s")
    )


def clip_to_windows(rows: DataFrame, windows: DataFrame, start: str, end: str) -> DataFrame:
    """Part of each interval inside each window it meets."""
    w = windows.select("session_id", "window_idx", "t_start", "t_end")
    return interval_join(
        rows, w, ["session_id"], 60.0, (start, end), ("t_start", "t_end"),
        (F.col(start) < F.col("t_end")) & (F.col(end) > F.col("t_start")),
    ).withColumn("_in", F.least(end, "t_end") - F.greatest(start, "t_start"))


def task_focus(fix: DataFrame, windows: DataFrame) -> DataFrame:
    """G-40: share of the window spent fixating objects other than the floor."""
    f = clip_to_windows(fix.where(~is_floor(F.col("object"))), windows, "onset", "offset")
    g = f.groupBy("session_id", "window_idx", "role").agg(
        F.sum("_in").alias("_d"), F.sum((F.col("_in") > 0).cast("long")).alias("task_fixation_count")
    )
    w = windows.join(fix.select("session_id", "role").distinct(), "session_id")
    o = w.join(g, ["session_id", "window_idx", "role"], "left").na.fill(0, ["_d", "task_fixation_count"])
    width = F.greatest(F.col("t_end") - F.col("t_start"), F.lit(1e-6))
    return o.select("session_id", "window_idx", "role", (F.col("_d") / width).alias("task_focus_ratio"), "task_fixation_count")


def window_speech(segs: DataFrame, windows: DataFrame) -> DataFrame:
    """Speaking time of each role per window."""
    s = clip_to_windows(segs, windows, "start_s", "end_s").groupBy("session_id", "window_idx", "role").agg(F.sum("_in").alias("speaking_time_s"))
    w = windows.join(segs.select("session_id", "role").distinct(), "session_id")
    o = w.join(s, ["session_id", "window_idx", "role"], "left").na.fill(0.0, ["speaking_time_s"])
    ratio = F.least(F.col("speaking_time_s") / F.greatest(F.col("t_end") - F.col("t_start"), F.lit(1e-6)), F.lit(1.0))
    return o.select("session_id", "window_idx", "t_start", "t_end", "role", "speaking_time_s", ratio.alias("speaking_ratio_window"))


def speech_equality(speech: DataFrame, min_total_s: float = 1.0, min_role_s: float = 0.2) -> DataFrame:
    """G-41: 1 - |a-b| / (a+b) where both spoke enough."""
    a = speech.select("session_id", "window_idx", F.col("role").alias("role_a"), F.col("speaking_time_s").alias("a"))
    b = speech.select("session_id", "window_idx", F.col("role").alias("role_b"), F.col("speaking_time_s").alias("b"))
    p = a.join(b, ["session_id", "window_idx"]).where("role_a < role_b")
    ok = (F.col("a") + F.col("b") >= min_total_s) & (F.least("a", "b") >= min_role_s)
    eq = 1.0 - F.abs(F.col("a") - F.col("b")) / F.greatest(F.col("a") + F.col("b"), F.lit(1e-6))
    return p.select("session_id", "window_idx", "role_a", "role_b", ok.alias("speech_valid"), F.when(ok, eq).alias("speech_equality"))


def face_sync(face: DataFrame, spans: DataFrame, fs: float, win: float, chunk_s: float, cols=("joy_intensity", "sad_intensity")) -> DataFrame:
    """G-42: mean over signals of (r + 1) / 2 per role pair and window."""
    p = _on_pairs(face, spans, list(cols), fs, 1.0 / fs, chunk_s)
    p = p.withColumn("window_idx", F.floor(F.col("frame_idx") / (win * fs)).cast("long"))
    k = ["session_id", "window_idx", "role_a", "role_b"]
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a_{c}").alias("x"), F.col(f"b_{c}").alias("y")) for c in cols])
    long = p.select(*k, F.explode(pairs).alias("e")).select(*k, "e.*")
    r = pearson_by(long, [*k, "feature"], "x", "y", min_n=3)
    return r.groupBy(*k).agg(F.avg((F.col("r") + 1) / 2).alias("face_sync_score"))


def graph_nodes(speech: DataFrame, focus: DataFrame) -> DataFrame:
    """G-43: one row per window and role."""
    return speech.join(focus, ["session_id", "window_idx", "role"], "left")


def window_gaze(flags: DataFrame, windows: DataFrame, chunk_s: float, min_s: float = 0.15, merge_s: float = 0.10) -> DataFrame:
    """G-39 per window: episodes of looking at a peer and their share of the window, per directed pair with samples in it."""
    k = ["session_id", "window_idx", "role", "target"]
    w = windows.select("session_id", "window_idx", "t_start", "t_end")
    # Samples have no length: only windows are measured, so the flags are made once.
    levels = _levels([(w, ("t_start", "t_end"))], 60.0)
    f = interval_join(
        flags.withColumn("_t1", F.col("t")), w, ["session_id"], 60.0, ("t", "_t1"), ("t_start", "t_end"), (F.col("t") >= F.col("t_start")) & (F.col("t") < F.col("t_end")), levels,
    )
    f = cut(f.select(*k, "t", "state", (F.col("t_end") - F.col("t_start")).alias("_w")))
    e = ep.irregular_episodes(f, k, "t", chunk_s, min_s, merge_s, end="next").groupBy(*k).agg(F.count("*").alias("n"), F.sum(F.col("end_s") - F.col("start_s")).alias("d"))
    g = f.groupBy(*k).agg(F.max("_w").alias("_w")).join(e, k, "left").na.fill(0, ["n", "d"])
    return g.select(*k, "n", (F.col("d") / F.greatest("_w", F.lit(1e-6))).alias("ratio"))


def gaze_edges(gaze: DataFrame) -> DataFrame:
    """Both directions of ``window_gaze`` on the row of the unordered pair."""
    k = ["session_id", "window_idx", F.least("role", "target").alias("role_a"), F.greatest("role", "target").alias("role_b")]
    ab = F.col("role") < F.col("target")
    one = gaze.select(*k, ab.alias("_ab"), "ratio", "n")
    pick = lambda c, way: F.coalesce(F.max(F.when(way, F.col(c))), F.lit(0))
    return one.groupBy("session_id", "window_idx", "role_a", "role_b").agg(
        pick("ratio", F.col("_ab")).cast("double").alias("gaze_a_to_b_ratio"), pick("ratio", ~F.col("_ab")).cast("double").alias("gaze_b_to_a_ratio"),
        pick("n", F.col("_ab")).cast("long").alias("gaze_a_to_b_episodes"), pick("n", ~F.col("_ab")).cast("long").alias("gaze_b_to_a_episodes"),
    )


def watched(edges: DataFrame) -> DataFrame:
    """Incoming gaze of each role per window: the sum of the shares of all peers that look at it."""
    sides = F.array(F.struct(F.col("role_b").alias("role"), F.col("gaze_a_to_b_ratio").alias("g")), F.struct(F.col("role_a").alias("role"), F.col("gaze_b_to_a_ratio").alias("g")))
    s = edges.select("session_id", "window_idx", F.explode(sides).alias("s"))
    return s.groupBy("session_id", "window_idx", "s.role").agg(F.coalesce(F.sum("s.g"), F.lit(0.0)).alias("watched"))


def graph_edges(windows: DataFrame, roles: DataFrame, *layers: DataFrame) -> DataFrame:
    """G-43: one row per window and role pair with the measures of every layer that has them.

    A layer holds session_id, window_idx, role_a, role_b and measures: speech equality, shared objects, gaze both ways,
    face synchrony, distance. All layers are stacked and reduced in one aggregation, so a pair that a layer lacks costs
    nothing and layers are never joined with each other.
    """
    k = ["session_id", "window_idx", "role_a", "role_b"]
    base = windows.select("session_id", "window_idx", "t_start", "t_end").join(role_pairs(roles), "session_id")
    names = list(dict.fromkeys(c for layer in layers for c in layer.columns if c not in (*k, "t_start", "t_end")))
    rows = base
    for layer in layers:
        rows = rows.unionByName(layer.select(*k, *[c for c in layer.columns if c in names]), allowMissingColumns=True)
    g = rows.groupBy(*k).agg(F.max("t_start").alias("t_start"), F.max("t_end").alias("t_end"), *[F.max(c).alias(c) for c in names])
    return g.where(F.col("t_start").isNotNull())


def graph_windows(nodes: DataFrame, equality: DataFrame, watched: DataFrame, distances: DataFrame) -> DataFrame:
    """G-43: one row per window: balance, leaders, engagement, proximity, proxy mean.

    ``watched``: session_id, window_idx, role, watched (incoming gaze ratio).
    Ties for a leader go to the first role name.
    """
    k = ["session_id", "window_idx"]
    n = nodes.join(watched, [*k, "role"], "left").na.fill(0.0, ["watched"])
    top = n.groupBy(*k).agg(
        F.min("t_start").alias("t_start"), F.min("t_end").alias("t_end"),
        F.min_by("role", F.struct(-F.col("speaking_time_s"), F.col("role"))).alias("talking_leader"),
        F.min_by("role", F.struct(-F.col("watched"), F.col("role"))).alias("_wl"), F.max("watched").alias("_wmax"),
        F.min_by("role", F.when(F.col("task_focus_ratio").isNotNull(), F.struct(-F.col("task_focus_ratio"), F.col("role")))).alias("task_focus_leader"),
        F.avg("task_focus_ratio").alias("task_focus_score"),
    )
    m = n.join(top.select(*k, "_wmax"), k)
    rel = F.when(F.col("_wmax") > 0, F.col("watched") / F.greatest("_wmax", F.lit(1e-6))).otherwise(0.0)
    eng = m.where("task_focus_ratio is not null").groupBy(*k).agg(F.avg((F.col("task_focus_ratio") + rel) / 2).alias("engagement_score"))
    bal = equality.groupBy(*k).agg(F.avg("speech_equality").alias("speech_balance_score"))
    dist = distances.groupBy(*k).agg(F.avg("distance_m_raw").alias("mean_pair_distance_m"))
    w = top.join(eng, k, "left").join(bal, k, "left").join(dist, k, "left")
    w = w.withColumn("watched_leader", F.when(F.col("_wmax") > 0, F.col("_wl"))).drop("_wl", "_wmax")
    d = F.col("mean_pair_distance_m")
    w = with_group_aggs(w, ["session_id"], _lo=F.min(d), _hi=F.max(d), _c=F.count(d))
    prox = F.when(F.col("_c") >= 2, F.when(F.col("_hi") > F.col("_lo"), 1.0 - (d - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0))
    w = w.withColumn("proximity_score", prox).drop("_lo", "_hi", "_c")
    parts = ["speech_balance_score", "task_focus_score", "proximity_score"]
    return w.withColumn("collaboration_proxy_score", row_mean([F.col(c) for c in parts]))
