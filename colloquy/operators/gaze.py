"""Gaze metrics on objects and directions (G-09 to G-29)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions import scalars as fn
from colloquy.session import cut

from . import episodes as ep
from .aggregates import entropy_of, union_all
from .align import asof, interpolate, interval_join, role_pairs
from .scan import by_width, lag, last_valid, next_valid, quantiles, row_number, running_sum, attach, scan

DIR = ("dx", "dy", "dz")
POS = ("px", "py", "pz")


def _frames(on: Column, off: Column, fs: float) -> tuple[Column, Column]:
    return F.ceil(on * fs).cast("long"), F.ceil(off * fs).cast("long")


def shared_object(
    fix: DataFrame, spans: DataFrame, keys: Sequence[str], fs: float, min_participants: int = 2, min_overlap_s: float = 0.1
) -> DataFrame:
    """G-09: episodes during which enough participants fixate the same object.

    ``spans`` has ``keys, t0, t1``. Fixations become frame runs on the grid of their
    span; coverage is counted per object, joined over objects, micro-episodes dropped.
    """
    keys = list(keys)
    f = attach(fix, spans, keys, "inner")
    a, b = _frames(F.greatest("onset", "t0") - F.col("t0"), F.least("offset", "t1") - F.col("t0"), fs)
    f = f.select(*keys, "object", a.alias("frame_start"), b.alias("frame_end"))
    by_object = ep.runs_at_least(f, [*keys, "object"], min_participants)
    runs = ep.drop_micro(ep.union_runs(cut(by_object), keys), fs, min_overlap_s)
    return _run_stats(cut(runs), spans, keys, fs)


def _run_stats(runs: DataFrame, spans: DataFrame, keys: Sequence[str], fs: float) -> DataFrame:
    d = runs.withColumn("_d", (F.col("frame_end") - F.col("frame_start")) / F.lit(fs))
    s = ep.episode_stats(runs, keys, fs)
    q = quantiles(d, keys, "_d", {"dur_median_s": 0.5, "dur_q25_s": 0.25, "dur_q75_s": 0.75})
    frames = F.ceil((F.col("t1") - F.col("t0")) * fs).cast("long")
    o = spans.select(*keys, frames.alias("_n")).join(s, list(keys), "left").join(q, list(keys), "left")
    o = o.na.fill(0, ["n_episodes", "dur_total_s"])
    return o.withColumn("shared_ratio", F.try_divide(F.round(F.col("dur_total_s") * fs), F.col("_n"))).withColumn(
        "dur_iqr_s", F.col("dur_q75_s") - F.col("dur_q25_s")
    ).drop("_n")


def shared_object_windows(
    fix: DataFrame, spans: DataFrame, win: float, step: float, fs: float, min_overlap_s: float = 0.1, pairs: bool = False
) -> DataFrame:
    """G-10: shared attention per window, for the whole group or per role pair."""
    w = ep.sliding_windows(spans, win, step)
    keys = ["session_id", "window_idx"]
    f = attach(fix, spans, ["session_id"], "inner")
    lo = F.greatest(F.floor((F.col("onset") - F.col("t0") - win) / step) + 1, F.lit(0)).cast("long")
    hi = F.floor((F.least("offset", "t1") - F.col("t0")) / step).cast("long")
    f = f.withColumn("_lo", lo).withColumn("_hi", hi).where("_hi >= _lo")
    f = f.withColumn("window_idx", F.explode(F.sequence("_lo", "_hi")))
    if pairs:
        rp = role_pairs(fix)
        keys = ["session_id", "role_a", "role_b", "window_idx"]
        side = rp.select("session_id", "role_a", "role_b", F.explode(F.array("role_a", "role_b")).alias("role"))
        f = f.join(side, ["session_id", "role"])
        w = w.join(rp, "session_id")
    f = f.select(*keys, "object", "onset", "offset")
    bounds = w.select(*keys, F.col("t_start").alias("t0"), F.col("t_end").alias("t1"))
    s = shared_object(f, bounds, keys, fs, 2, min_overlap_s)
    return w.select(*keys, "t_start", "t_end").join(s, keys, "left")


def object_entropy(fix: DataFrame, keys: Sequence[str] = ("session_id", "role")) -> DataFrame:
    """G-11: entropy of fixation time over objects, normalised, and number of objects."""
    g = fix.groupBy(*keys, "object").agg(F.sum(F.greatest(F.col("offset") - F.col("onset"), F.lit(0.0))).alias("_d"))
    return entropy_of(g, keys, "_d", normalize=True, out="gaze_entropy").join(
        g.groupBy(*keys).agg(F.count("*").alias("n_objects_fixated")), list(keys)
    )


def infer_target(fix: DataFrame, roles: DataFrame) -> DataFrame:
    """G-12: the one participant whose name occurs in the fixated object, else NULL."""
    objects = fix.select("session_id", "object").distinct()
    names = roles.select("session_id", F.col("role").alias("target")).distinct()
    hit = objects.join(names, "session_id").where(F.upper("object").contains(F.upper("target")))
    one = hit.groupBy("session_id", "object").agg(F.count("*").alias("_h"), F.min("target").alias("target"))
    one = one.where("_h = 1").drop("_h")
    return attach(fix, one, ["session_id", "object"])


def mutual_gaze_object(
    fix: DataFrame, spans: DataFrame, fs: float, sync_lag_s: float = 0.0, min_overlap_s: float = 0.1
) -> DataFrame:
    """G-13: frames where both of a pair look at each other; masks may be widened."""
    k = ["session_id", "role_a", "role_b"]
    f = fix.where(F.col("target").isNotNull() & (F.col("target") != F.col("role")))
    f = attach(f, spans, ["session_id"], "inner")
    a, b = _frames(F.greatest("onset", "t0") - F.col("t0"), F.least("offset", "t1") - F.col("t0"), fs)
    n = F.ceil((F.col("t1") - F.col("t0")) * fs).cast("long")
    f = f.select(
        "session_id", F.least("role", "target").alias("role_a"), F.greatest("role", "target").alias("role_b"),
        (F.col("role") < F.col("target")).alias("forward"), a.alias("frame_start"), b.alias("frame_end"), n.alias("_n"),
    ).where("frame_end > frame_start")
    pad = int(-(-sync_lag_s * fs // 1)) if sync_lag_s > 0 else 0
    f = f.withColumn("frame_start", F.greatest(F.col("frame_start") - pad, F.lit(0)))
    f = f.withColumn("frame_end", F.least(F.col("frame_end") + pad, F.col("_n")))
    side = ep.union_runs(f, [*k, "forward"])
    runs = cut(ep.drop_micro(ep.runs_at_least(side, k, 2), fs, min_overlap_s))
    st = ep.episode_stats(runs, k, fs)
    p = role_pairs(fix).join(spans, "session_id").join(st, k, "left").na.fill(0, ["n_episodes", "dur_total_s"])
    frames = F.ceil((F.col("t1") - F.col("t0")) * fs).cast("long")
    return p.select(*k, F.try_divide(F.round(F.col("dur_total_s") * fs), frames).alias("ratio"), "n_episodes", "dur_total_s", "dur_mean_s")


def mutual_gaze_group(pairs: DataFrame) -> DataFrame:
    """G-13: mean of pair ratios, sums of episodes and durations."""
    return pairs.groupBy("session_id").agg(
        F.avg("ratio").alias("mutual_gaze_ratio_mean_pairs"), F.sum("n_episodes").alias("mutual_gaze_n_episodes_sum_pairs"),
        F.sum("dur_total_s").alias("mutual_gaze_dur_total_s_sum_pairs"), F.avg("dur_mean_s").alias("mutual_gaze_dur_mean_s_mean_pairs"),
    )


def _on_grid(rows: DataFrame, spans: DataFrame, value: str, fs: float, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Value of the latest row covering each grid frame."""
    f = attach(rows, spans, ["session_id"], "inner")
    a, b = _frames(F.greatest(start, "t0") - F.col("t0"), F.least(end, "t1") - F.col("t0"), fs)
    f = f.withColumn("_a", a).withColumn("_b", b).where("_b > _a")
    f = f.withColumn("frame_idx", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)))
    return f.groupBy(*keys, "frame_idx").agg(F.max_by(value, F.struct(start, end, value)).alias(value))


def gaze_to_speaker(fix: DataFrame, turns: DataFrame, spans: DataFrame, fs: float, sync_lag_s: float = 0.0) -> DataFrame:
    """G-14: share of (listener, frame) cells where the listener looks at the speaker."""
    t = turns.select("session_id", F.col("role").alias("speaker"), "start_s", "end_s")
    speaker = _on_grid(t, spans, "speaker", fs, ["session_id"], "start_s", "end_s")
    looks = fix.where("target is not null")
    target = _on_grid(looks, spans, "target", fs, ["session_id", "role"], "onset", "offset")
    k = int(-(-sync_lag_s * fs // 1)) if sync_lag_s > 0 else 0
    if k:
        # A blank frame takes the nearest known target within k frames, earlier first.
        offs = F.array(*[F.lit(i) for i in range(-k, k + 1)])
        target = target.withColumn("_o", F.explode(offs)).withColumn("frame_idx", F.col("frame_idx") + F.col("_o"))
        target = target.groupBy("session_id", "role", "frame_idx").agg(
            F.min_by("target", F.struct(F.abs("_o"), -F.col("_o"))).alias("target")
        )
    hit = target.join(speaker, ["session_id", "frame_idx"]).where("speaker != role and target = speaker")
    hit = hit.groupBy("session_id").agg(F.count("*").alias("_h"))
    listeners = fix.groupBy("session_id").agg(F.countDistinct("role").alias("_l"))
    n = F.ceil((F.col("t1") - F.col("t0")) * fs).cast("long")
    o = spans.join(listeners, "session_id").join(hit, "session_id", "left").na.fill(0, ["_h"])
    return o.select("session_id", F.try_divide(F.col("_h"), F.col("_l") * n).alias("gaze_to_speaker_ratio"))


def gaze_before_speech(fix: DataFrame, turns: DataFrame, tau_s: float = 1.0) -> DataFrame:
    """G-15: probability that a speaker looked at somebody just before speaking."""
    on = turns.select("session_id", "role", (F.col("start_s") - tau_s).alias("w0"), F.col("start_s").alias("w1"))
    looks = fix.where("target is not null and target != role").select("session_id", "role", "onset", "offset")
    hit = interval_join(
        on, looks, ["session_id", "role"], max(tau_s, 1.0) * 8, ("w0", "w1"), ("onset", "offset"),
        (F.col("onset") < F.col("w1")) & (F.col("offset") > F.col("w0")), how="left_semi",
    )
    n = on.groupBy("session_id").agg(F.count("*").alias("n_onsets"))
    h = on.join(hit, on.columns, "left_semi").groupBy("session_id").agg(F.count("*").alias("_h"))
    return n.join(h, "session_id", "left").select(
        "session_id", "n_onsets", (F.coalesce("_h", F.lit(0)) / F.col("n_onsets")).alias("p_gaze_before_speech")
    )


def _dyads(dirs: DataFrame, cols: Sequence[str]) -> DataFrame:
    a = dirs.select("session_id", "frame_idx", F.col("role").alias("role_a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = dirs.select("session_id", "frame_idx", F.col("role").alias("role_b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    return a.join(b, ["session_id", "frame_idx"]).where("role_a < role_b")


def _side(p: str, cols: Sequence[str]) -> list[Column]:
    return [F.col(f"{p}_{c}") for c in cols]


def dyad_angles(dirs: DataFrame) -> DataFrame:
    """J-11 on grid frames: angle between the gaze directions of each role pair."""
    d = _dyads(dirs, DIR)
    return d.select("session_id", "frame_idx", "role_a", "role_b", fn.angle_between(_side("a", DIR), _side("b", DIR)).alias("angle_deg"))


def convergence(dirs: DataFrame, fs: float, threshold_deg: float = 20.0, min_overlap_s: float = 0.1, denominator: str = "first_role") -> DataFrame:
    """G-16: frames where at least two participants look in converging directions.

    ``denominator`` counts the valid frames of the first role, or of any pair.
    """
    k = ["session_id"]
    ang = dyad_angles(dirs)
    conv = ang.where(F.col("angle_deg") <= threshold_deg)
    runs = cut(ep.drop_micro(ep.mask_runs(conv.select(*k, "frame_idx"), k), fs, min_overlap_s))
    st = ep.episode_stats(runs, k, fs, "gaze_convergence_")
    mean = conv.groupBy(*k).agg(F.avg("angle_deg").alias("gaze_convergence_mean_angle_deg"))
    if denominator == "first_role":
        per = dirs.groupBy("session_id", "role").agg(F.count("*").alias("_n"))
        n = per.groupBy(*k).agg(F.min_by("_n", "role").alias("_n"))
    else:
        n = ang.groupBy(*k).agg(F.countDistinct("frame_idx").alias("_n"))
    o = n.join(st, k, "left").join(mean, k, "left").na.fill(0, ["gaze_convergence_n_episodes", "gaze_convergence_dur_total_s"])
    ratio = F.round(F.col("gaze_convergence_dur_total_s") * fs) / F.greatest("_n", F.lit(1))
    return o.withColumn("gaze_convergence_ratio", ratio).drop("_n")


def mutual_directional(dirs: DataFrame, fs: float, threshold_deg: float = 30.0, min_overlap_s: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """G-17: each looks towards the other's head. Returns (per pair, per session).

    The session ratio is the mean of pair ratios, its episodes those of the OR of pairs.
    """
    kp = ["session_id", "role_a", "role_b"]
    d = _dyads(dirs, [*DIR, *POS])
    ab = fn.angle_to_target(_side("a", DIR), _side("a", POS), _side("b", POS))
    ba = fn.angle_to_target(_side("b", DIR), _side("b", POS), _side("a", POS))
    d = d.select(*kp, "frame_idx", ab.alias("ab"), ba.alias("ba"))
    runs = cut(ep.drop_micro(ep.mask_runs(d.where((F.col("ab") <= threshold_deg) & (F.col("ba") <= threshold_deg)), kp), fs, min_overlap_s))
    valid = d.groupBy(*kp).agg(F.sum((F.col("ab").isNotNull() | F.col("ba").isNotNull()).cast("long")).alias("_n"))
    p = valid.join(ep.episode_stats(runs, kp, fs), kp, "left").na.fill(0, ["n_episodes", "dur_total_s"])
    p = p.withColumn("mutual_gaze_ratio", F.round(F.col("dur_total_s") * fs) / F.greatest("_n", F.lit(1))).drop("_n")
    g = p.groupBy("session_id").agg(F.avg("mutual_gaze_ratio").alias("mutual_gaze_ratio"))
    st = ep.episode_stats(ep.union_runs(runs, ["session_id"]), ["session_id"], fs, "mutual_gaze_")
    return p, g.join(st, "session_id", "left").na.fill(0, ["mutual_gaze_n_episodes", "mutual_gaze_dur_total_s"])


def direction_entropy(dirs: DataFrame, n_bins: int = 16, min_frames: int = 10) -> DataFrame:
    """G-18: normalised entropy of the azimuth histogram."""
    k = ["session_id", "role"]
    b = dirs.withColumn("_bin", fn.histogram_bin(fn.azimuth(F.col("dx"), F.col("dz")), 0.0, 360.0, n_bins))
    h = b.where("_bin is not null").groupBy(*k, "_bin").agg(F.count("*").cast("double").alias("_w"))
    n = h.groupBy(*k).agg(F.sum("_w").alias("_n"))
    e = entropy_of(h, k, "_w", normalize=True, out="direction_entropy").join(n, k)
    return e.select(*k, F.when(F.col("_n") >= min_frames, F.col("direction_entropy")).alias("direction_entropy"))


def stable_directions(dirs: DataFrame, fs: float, min_dur_s: float = 0.15, angle_deg: float = 10.0) -> DataFrame:
    """G-19: episodes during which the direction stays within ``angle_deg`` of its mean.

    Every frame is copied into the k windows that contain it (k is a parameter, a few
    frames), so windows are tiny groups; stable windows are then merged as runs.
    """
    k = max(1, int(min_dur_s * fs))
    keys = ["session_id", "role"]
    last = dirs.groupBy(*keys).agg(F.max("frame_idx").alias("_last"))
    w = attach(dirs, last, keys).withColumn(
        "frame_start", F.explode(F.sequence(F.greatest(F.col("frame_idx") - (k - 1), F.lit(0)), F.least("frame_idx", F.col("_last") - (k - 1)))
        if k > 1 else F.array("frame_idx")),
    )
    w = w.where(F.col("frame_start") <= F.col("_last") - (k - 1))
    g = w.groupBy(*keys, "frame_start").agg(
        F.count("*").alias("_n"), F.avg("dx").alias("mx"), F.avg("dy").alias("my"), F.avg("dz").alias("mz"),
        F.collect_list(F.struct(*DIR)).alias("_v"),
    )
    norm = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz"))
    g = g.withColumn("_norm", norm)
    worst = F.array_min(F.transform("_v", lambda v: (v["dx"] * F.col("mx") + v["dy"] * F.col("my") + v["dz"] * F.col("mz")) / F.col("_norm")))
    ok = (F.col("_n") >= max(2, k // 2)) & (F.col("_norm") >= 1e-9)
    g = g.where(ok).withColumn("_a", F.degrees(F.acos(fn.clip(worst, -1.0, 1.0)))).where(F.col("_a") <= angle_deg)
    runs = ep.union_runs(g.select(*keys, "frame_start", (F.col("frame_start") + k).alias("frame_end")), keys)
    return runs.select(
        *keys, (F.col("frame_start") / fs).alias("onset"), (F.col("frame_end") / fs).alias("offset"),
        ((F.col("frame_end") - F.col("frame_start")) / fs).alias("duration_s"),
    )


def gaze_tables(dirs: DataFrame, fs: float, convergence_deg: float = 20.0, mutual_deg: float = 30.0) -> dict[str, DataFrame]:
    """G-20: session, pair and participant tables."""
    pair, session = mutual_directional(dirs, fs, mutual_deg)
    conv = convergence(dirs, fs, convergence_deg)
    ent = direction_entropy(dirs)
    stable = stable_directions(dirs, fs).groupBy("session_id", "role").agg(
        F.count("*").alias("stable_n_episodes"), F.sum("duration_s").alias("stable_dur_total_s")
    )
    part = ent.join(stable, ["session_id", "role"], "left").na.fill(0, ["stable_n_episodes", "stable_dur_total_s"])
    s = conv.join(session, "session_id", "left").join(
        ent.groupBy("session_id").agg(F.avg("direction_entropy").alias("direction_entropy_mean")), "session_id", "left"
    )
    return {"session": s, "pair": pair, "participant": part}


def gaze_windows(dirs: DataFrame, win_frames: int, fs: float, convergence_deg: float = 20.0) -> DataFrame:
    """G-20: convergence per fixed window of frames."""
    w = dirs.withColumn("session_id", F.struct("session_id", F.floor(F.col("frame_idx") / win_frames).alias("window_idx")))
    c = convergence(w, fs, convergence_deg)
    return c.select(F.col("session_id.session_id").alias("session_id"), F.col("session_id.window_idx").alias("window_idx"), *[x for x in c.columns if x != "session_id"])


def valid_share(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Share of rows with a complete direction, per key (percent)."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    return df.groupBy(*keys).agg((100.0 * F.avg(ok.cast("double"))).alias("pct_dir_valid"))


def origin_frozen(df: DataFrame, keys: Sequence[str], origin: Sequence[str], hit: Sequence[str], threshold_m: float = 2.0) -> DataFrame:
    """G-21: does the gaze origin stay in place while the hit point moves?"""
    def diag(cols):
        e = [F.max(c) - F.min(c) for c in cols]
        return F.sqrt(fn.dot(e, e))

    g = df.groupBy(*keys).agg(
        F.count("*").alias("n"), diag(origin).alias("origin_diag_m"), diag(hit).alias("hit_diag_m"),
        *[F.stddev_samp(c).alias(f"std_{c}") for c in origin],
    )
    return g.withColumn("frozen", (F.col("origin_diag_m") < threshold_m) & (F.col("hit_diag_m") > threshold_m))


def origin_offset(
    eye: DataFrame, pos: DataFrame, keys: Sequence[str], t: str, origin: Sequence[str], head: Sequence[str], chunk_s: float,
    tolerance_s: float = 0.2, threshold_m: float = 0.5,
) -> DataFrame:
    """G-22: distance between gaze origin and tracked head, with a verdict."""
    j = asof(eye, pos, keys, t, head, chunk_s, "nearest", tolerance_s)
    j = j.where(F.col(f"{t}_match").isNotNull()).withColumn(
        "_o", fn.distance([F.col(c) for c in origin], [F.col(c) for c in head])
    ).withColumn("_r", F.abs(F.col(t) - F.col(f"{t}_match")) * 1000.0)
    j = cut(j.select(*keys, "_o", "_r"))
    q = quantiles(j, keys, "_o", {"offset_p25_m": 0.25, "offset_median_m": 0.5, "offset_p75_m": 0.75})
    r = quantiles(j, keys, "_r", {"residual_median_ms": 0.5, "residual_p95_ms": 0.95})
    n = j.groupBy(*keys).agg(F.count("*").alias("n_merged"), F.max("_o").alias("offset_max_m"))
    o = n.join(q, list(keys)).join(r, list(keys))
    return o.withColumn("verdict", F.when(F.col("offset_median_m") > threshold_m, "offset_bug").otherwise("origin_ok"))


def stream_inventory(df: DataFrame, keys: Sequence[str], t: str, cols: Sequence[str], chunk_s: float) -> DataFrame:
    """G-22: rows, range, median step and missing share of each column."""
    g = df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.min(t).alias("t_min"), F.max(t).alias("t_max"),
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"missing_{c}") for c in cols],
    )
    return g.join(ep.median_step(df, keys, t, chunk_s), list(keys), "left")


def circular_mean(theta: Column) -> Column:
    return F.degrees(F.atan2(F.avg(F.sin(F.radians(theta))), F.avg(F.cos(F.radians(theta)))))


def heading_check(
    pos: DataFrame, gaze: DataFrame, keys: Sequence[str], t: str, chunk_s: float, min_speed: float = 0.3,
    min_frames: int = 20, tolerance_s: float = 0.2, limit_deg: float = 45.0,
) -> DataFrame:
    """G-23: movement heading against gaze heading: circular mean and spread, drift, verdict."""
    keys = list(keys)
    m = scan(pos, keys, [t], by_width(t, chunk_s), {"_p": lag(F.struct(F.col(t).alias("t"), F.col("px").alias("x"), F.col("pz").alias("z")))})
    dx, dz, dt = F.col("px") - F.col("_p.x"), F.col("pz") - F.col("_p.z"), F.col(t) - F.col("_p.t")
    m = m.withColumn("_v", F.try_divide(F.sqrt(dx * dx + dz * dz), dt)).where(F.col("_v") > min_speed)
    m = m.select(*keys, t, F.degrees(F.atan2(dx, dz)).alias("theta_move"))
    g = gaze.select(*keys, t, F.degrees(F.atan2("dx", "dz")).alias("theta_gaze"))
    j = asof(cut(m), g, keys, t, ["theta_gaze"], chunk_s, "nearest", tolerance_s).where("theta_gaze is not null")
    j = j.withColumn("delta", fn.wrap180(F.col("theta_gaze") - F.col("theta_move")))
    rad = F.radians("delta")
    a = j.groupBy(*keys).agg(
        F.count("*").alias("n_motion_frames"), F.avg(F.sin(rad)).alias("_s"), F.avg(F.cos(rad)).alias("_c"),
        F.regr_slope("delta", t).alias("_slope"), (F.max(t) - F.min(t)).alias("_span"),
    )
    rr = F.least(F.greatest(F.sqrt(F.col("_s") ** 2 + F.col("_c") ** 2), F.lit(1e-10)), F.lit(1.0))
    enough = F.col("n_motion_frames") >= min_frames
    o = a.select(
        *keys, "n_motion_frames",
        F.when(enough, F.degrees(F.atan2("_s", "_c"))).alias("delta_theta_mean_deg"),
        F.when(enough, F.degrees(F.sqrt(-2.0 * F.ln(rr)))).alias("delta_theta_std_deg"),
        F.when(enough, F.abs(F.coalesce("_slope", F.lit(0.0)) * F.col("_span"))).alias("delta_theta_drift_deg"),
    )
    bad = (F.col("delta_theta_std_deg") > limit_deg) | (F.col("delta_theta_drift_deg") > limit_deg)
    return o.withColumn(
        "direction_assumption",
        F.when(~enough, "pure_translation_unverified").when(bad, "suspect_yaw").otherwise("validated_traj"),
    )


def reconstruct_rays(eye: DataFrame, pos: DataFrame, keys: Sequence[str], t: str, chunk_s: float) -> DataFrame:
    """G-24: head position at each gaze sample, unit direction, sync residual, offset.

    ``eye``: ox, oy, oz, hx, hy, hz. ``pos``: px, py, pz. No extrapolation.
    """
    keys = list(keys)
    o3, h3 = ("ox", "oy", "oz"), ("hx", "hy", "hz")
    state = F.struct(F.col(t).alias("t"), *POS)
    p = pos.select(*keys, t, F.lit(0).alias("_side"), state.alias("_s"))
    typ = p.schema["_s"].dataType
    e = eye.select(*keys, t, *o3, *h3).withColumn("_side", F.lit(1)).withColumn("_s", F.lit(None).cast(typ))
    rows = e.unionByName(p, allowMissingColumns=True)
    r = scan(rows, keys, [t, "_side"], by_width(t, chunk_s), {"_b": last_valid("_s"), "_f": next_valid("_s")}).where("_side = 1")
    exact = F.col("_b.t") == F.col(t)
    frac = (F.col(t) - F.col("_b.t")) / (F.col("_f.t") - F.col("_b.t"))
    true = [F.when(exact, F.col(f"_b.{c}")).otherwise(F.col(f"_b.{c}") + (F.col(f"_f.{c}") - F.col(f"_b.{c}")) * frac).alias(f"true_{c}") for c in POS]
    resid = F.least(F.abs(F.col(t) - F.col("_b.t")), F.abs(F.col("_f.t") - F.col(t)))
    d = fn.unit_vector([F.col(c) for c in h3], [F.col(c) for c in o3])
    r = r.select(*keys, t, *o3, *h3, *true, *[x.alias(n) for x, n in zip(d, DIR)], F.round(resid * 1000.0, 2).alias("sync_residual_ms"))
    off = fn.distance([F.col(c) for c in o3], [F.col(f"true_{c}") for c in POS])
    return r.withColumn("origin_offset_m", F.round(off, 4)).withColumn("hit_was_nan", F.col("dx").isNull().cast("int"))


def ray_summary(rays: DataFrame, keys: Sequence[str]) -> DataFrame:
    """G-24: one row per recording."""
    s = rays.groupBy(*keys).agg(
        F.count("*").alias("n_frames"), F.sum("hit_was_nan").alias("n_hit_nan"),
        F.sum(F.col("true_px").isNull().cast("long")).alias("n_extrap_frames"), F.max("origin_offset_m").alias("origin_offset_max_m"),
    )
    q = quantiles(rays, keys, "sync_residual_ms", {"sync_residual_median_ms": 0.5, "sync_residual_p95_ms": 0.95})
    o = quantiles(rays, keys, "origin_offset_m", {"origin_offset_median_m": 0.5})
    return s.join(q, list(keys), "left").join(o, list(keys), "left")


def plateaux(
    pos: DataFrame, keys: Sequence[str], t: str, chunk_s: float, jump_m: float = 0.5, guard_s: float = 1.0,
    min_dur_s: float = 3.0, min_points: int = 4,
) -> DataFrame:
    """G-25: stretches between jumps; the first ``guard_s`` after a jump does not count."""
    keys = list(keys)
    p = plateau_points(pos, keys, t, chunk_s, jump_m, guard_s)
    g = p.groupBy(*keys, "plateau").agg(
        F.count("*").alias("n_raw"), F.min(t).alias("t0"), F.max(t).alias("t1"),
        F.sum(F.col("kept").cast("long")).alias("n"),
        F.min(F.when(F.col("kept"), F.col(t))).alias("t_start"), F.max(F.when(F.col("kept"), F.col(t))).alias("t_end"),
        F.avg(F.when(F.col("kept"), F.col("px"))).alias("mean_x"), F.avg(F.when(F.col("kept"), F.col("pz"))).alias("mean_z"),
    )
    lead_in = F.col("t0") + F.when(F.col("plateau") > 0, F.lit(guard_s)).otherwise(0.0)
    ok = (F.col("n_raw") >= min_points) & (F.col("t1") - lead_in >= min_dur_s) & (F.col("n") >= min_points)
    return g.where(ok).select(*keys, "plateau", "t_start", "t_end", "mean_x", "mean_z", "n")


def plateau_points(pos, keys, t, chunk_s, jump_m=0.5, guard_s=1.0) -> DataFrame:
    """Positions with their plateau number and whether they lie past the guard time."""
    keys = list(keys)
    chunk = by_width(t, chunk_s)
    p = scan(pos, keys, [t], chunk, {"_p": lag(F.struct(F.col("px").alias("x"), F.col("pz").alias("z")))})
    d = fn.distance([F.col("px"), F.col("pz")], [F.col("_p.x"), F.col("_p.z")])
    p = cut(p.withColumn("_jump", F.coalesce((d > jump_m).cast("long"), F.lit(0))).drop("_p"))
    p = scan(
        p.withColumn("_at", F.when(F.col("_jump") == 1, F.col(t))), keys, [t], chunk,
        {"plateau": running_sum("_jump"), "_since": last_valid("_at")},
    )
    kept = F.col("_since").isNull() | (F.col(t) >= F.col("_since") + guard_s)
    return p.withColumn("kept", kept).drop("_jump", "_at", "_since")


def rigid_yaw(pairs: DataFrame, keys: Sequence[str], min_std_m: float = 0.008) -> DataFrame:
    """G-26: the rotation (degrees) taking centred points a onto centred points b.

    Closed form of the two-dimensional rigid fit from centred sums. The residual needs a
    second look at the rows, with the fitted rotation joined back.
    """
    keys = list(keys)
    n = F.count("*")
    m = pairs.groupBy(*keys).agg(
        n.alias("n"), F.avg("ax").alias("max_"), F.avg("az").alias("maz"), F.avg("bx").alias("mbx"), F.avg("bz").alias("mbz"),
        F.covar_pop("ax", "bx").alias("xx"), F.covar_pop("az", "bz").alias("zz"),
        F.covar_pop("ax", "bz").alias("xz"), F.covar_pop("az", "bx").alias("zx"),
        F.sqrt((F.var_pop("ax") + F.var_pop("az")) / 2).alias("_sa"), F.sqrt((F.var_pop("bx") + F.var_pop("bz")) / 2).alias("_sb"),
    ).where((F.col("_sa") >= min_std_m) & (F.col("_sb") >= min_std_m))
    th = F.atan2(F.col("xz") - F.col("zx"), F.col("xx") + F.col("zz"))
    m = m.withColumn("_th", th)
    j = attach(pairs, m, keys, "inner")
    ca, sa = F.cos("_th"), F.sin("_th")
    ax, az = F.col("ax") - F.col("max_"), F.col("az") - F.col("maz")
    rx = ca * ax - sa * az - (F.col("bx") - F.col("mbx"))
    rz = sa * ax + ca * az - (F.col("bz") - F.col("mbz"))
    return j.groupBy(*keys).agg(
        F.degrees(F.max("_th")).alias("theta_deg"), F.avg(F.sqrt(rx * rx + rz * rz)).alias("resid_m"), F.max("n").alias("n")
    )


def yaw_stability(
    windows: DataFrame, keys: Sequence[str], idx: str, chunk: int = 100000, min_windows: int = 2, max_std_deg: float = 15.0, max_resid_m: float = 0.04
) -> DataFrame:
    """G-27: yaw of consecutive sub-windows with the 180 degree ambiguity resolved.

    From the best-fitting window outwards every neighbour takes the closer of theta and
    theta + 180. A flip between neighbours is a step of more than 90 degrees; the number
    of flips since the anchor, modulo 2, is the choice the sequential rule makes.
    """
    keys = list(keys)
    s = scan(windows, keys, [idx], by_width(idx, chunk), {"_p": lag("theta_deg")})
    s = s.withColumn("_flip", F.coalesce((F.abs(fn.wrap180(F.col("theta_deg") - F.col("_p"))) > 90).cast("long"), F.lit(0)))
    s = cut(scan(s, keys, [idx], by_width(idx, chunk), {"_f": running_sum("_flip")}))
    anchor = s.groupBy(*keys).agg(F.min_by("_f", F.struct("resid_m", idx)).alias("_fa"))
    s = attach(s, anchor, keys)
    odd = F.pmod(F.col("_f") - F.col("_fa"), F.lit(2)) == 1
    s = s.withColumn("theta", F.when(odd, fn.wrap180(F.col("theta_deg") + 180.0)).otherwise(F.col("theta_deg")))
    g = s.groupBy(*keys).agg(
        F.count("*").alias("n_subwins"), circular_mean(F.col("theta")).alias("theta_deg"),
        F.stddev_pop("theta").alias("intra_std_deg"), F.avg("resid_m").alias("resid_m"),
    )
    status = (
        F.when(F.col("n_subwins") < min_windows, "too_few_subwindows")
        .when(F.col("intra_std_deg") > max_std_deg, "ambiguity_unresolved")
        .when(F.col("resid_m") > max_resid_m, "high_residual").otherwise("ok")
    )
    return g.withColumn("status", status)


def session_yaw(plateau_yaw: DataFrame, keys: Sequence[str], min_valid: float = 0.30, near_zero_deg: float = 5.0) -> DataFrame:
    """G-28: verdict over the plateaux of a recording."""
    ok = F.col("status") == "ok"
    th = F.when(ok, F.col("theta_deg"))
    g = plateau_yaw.groupBy(*keys).agg(
        F.count("*").alias("n_plateaux_total"), F.sum(ok.cast("long")).alias("n_plateaux_valid"),
        F.sum((F.col("status") == "high_residual").cast("long")).alias("n_high_residual"),
        F.sum((F.col("status") == "ambiguity_unresolved").cast("long")).alias("n_ambiguity_unresolved"),
        circular_mean(th).alias("theta_circ_mean_deg"), F.stddev_pop(th).alias("theta_std_deg"),
    )
    frac = F.col("n_plateaux_valid") / F.col("n_plateaux_total")
    flat = (F.abs("theta_circ_mean_deg") < near_zero_deg) & (F.col("theta_std_deg") < near_zero_deg)
    return g.withColumn(
        "direction_assumption",
        F.when((F.col("n_plateaux_valid") == 0) | (frac < min_valid), "undetermined")
        .when(flat, "pure_translation_confirmed").otherwise("yaw_recovered"),
    )


def apply_yaw(dirs: DataFrame, plateau_yaw: DataFrame, keys: Sequence[str], t: str, width_s: float) -> DataFrame:
    """G-29: directions rotated by the yaw of the plateau that contains them."""
    keys = list(keys)
    pts = dirs.withColumn("_t1", F.col(t))
    b = plateau_yaw.select(*keys, "t_start", "t_end", F.col("theta_deg").alias("_th"))
    hit = interval_join(pts, b, keys, width_s, (t, "_t1"), ("t_start", "t_end"))
    c = fn.rotate_yaw(F.col("dx"), F.col("dy"), F.col("dz"), F.col("_th"))
    return hit.select(*keys, t, *DIR, *[x.alias(f"corr_{n}") for x, n in zip(c, DIR)])
