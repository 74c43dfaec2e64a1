"""Facial activity: intensities, states, windows, synchrony (G-30 to G-37)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.scalars import clip
from colloquy.session import cut
from colloquy.stats.moments import pearson_by

from . import episodes as ep
from .aggregates import melt
from .align import asof, grid, role_pairs
from .scan import quantiles, attach

KEYS = ["session_id", "role"]

# Action unit -> base name of its column(s).
AU_BASE = {
    "AU1": "InnerBrowRaiser", "AU4": "BrowLowerer", "AU6": "CheekRaiser",
    "AU12": "LipCornerPuller", "AU15": "LipCornerDepressor", "AU17": "ChinRaiser",
}
JOY = ["AU6", "AU12"]
SAD = ["AU1", "AU4", "AU15"]
COACTIVE = {"au6_au12": ("AU6", "AU12"), "au4_au15": ("AU4", "AU15"), "au15_au17": ("AU15", "AU17")}


def row_mean(cols: Sequence[Column]) -> Column:
    """Mean of the non-missing values of a row."""
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    s = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.try_divide(s, n)


def intensities(df: DataFrame) -> DataFrame:
    """G-30: one value per action unit (mean of its left/right or top/bottom pair)."""
    have = set(df.columns)
    out = []
    for au, base in AU_BASE.items():
        pair = next(
            (p for p in ((f"{base}L", f"{base}R"), (f"{base}T", f"{base}B")) if have.issuperset(p)), None
        )
        if pair:
            v = row_mean([F.col(c).cast("double") for c in pair])
        elif base in have:
            v = F.col(base).cast("double")
        else:
            v = F.lit(None).cast("double")
        out.append(v.alias(au))
    d = df.select("*", *out)
    emotion = lambda aus: row_mean([clip(F.col(a), 0.0) for a in aus])
    return d.withColumn("joy_intensity", emotion(JOY)).withColumn("sad_intensity", emotion(SAD))


def thresholds(df: DataFrame, cols: Sequence[str], mode: str, absolute: float = 0.0, q: float = 0.75, z_k: float = 1.0) -> DataFrame:
    """G-31: threshold per track and signal, long form ``session_id, role, feature, thr``.

    ``zscore`` on a (nearly) constant signal has no threshold.
    """
    long = melt(df, KEYS, cols)
    k = [*KEYS, "feature"]
    if mode == "absolute":
        return long.where("value is not null").groupBy(*k).agg(F.lit(float(absolute)).alias("thr"))
    if mode == "quantile":
        return quantiles(long, k, "value", {"thr": q})
    sd = F.stddev_samp("value")
    return long.groupBy(*k).agg(F.when(sd >= 1e-12, F.avg("value") + z_k * sd).alias("thr"))


def binary_states(df: DataFrame, mode: str = "quantile", absolute: float = 0.0, q: float = 0.75, z_k: float = 1.0) -> DataFrame:
    """G-32: activity of each unit and emotion (NULL where the value is missing)."""
    cols = [*AU_BASE, "joy_intensity", "sad_intensity"]
    thr = thresholds(df, cols, mode, absolute, q, z_k)
    wide = thr.groupBy(*KEYS).agg(*[F.max(F.when(F.col("feature") == c, F.col("thr"))).alias(f"_t_{c}") for c in cols])
    d = attach(df, wide, KEYS)
    on = {c: (F.col(c) > F.col(f"_t_{c}")).cast("double") for c in cols}
    d = d.select(*df.columns, *[v.alias(_state(c)) for c, v in on.items()])
    # An emotion without threshold counts as never active, a unit without one as unknown.
    d = d.na.fill(0.0, ["joy_active", "sad_active"])
    for name, (a, b) in COACTIVE.items():
        d = d.withColumn(f"{name}_coactive", coactive(F.col(_state(a)), F.col(_state(b))))
    return d


def _state(c: str) -> str:
    return {"joy_intensity": "joy_active", "sad_intensity": "sad_active"}.get(c, f"{c.lower()}_active")


def coactive(a: Column, b: Column) -> Column:
    """G-32: both active; unknown when either is unknown."""
    return F.when(a.isNotNull() & b.isNotNull(), F.when((a == 1.0) & (b == 1.0), 1.0).otherwise(0.0))


def window_descriptors(
    df: DataFrame, spans: DataFrame, t: str, win: float, step: float, cols: Mapping[str, str], success: str | None = None, min_success: float = 0.5
) -> DataFrame:
    """G-33 / M-19: mean of each signal per window and role; empty windows stay as NULL.

    A sample is copied into the windows holding it (``win / step`` copies at most) and
    reduced before the shuffle. A window with too few valid samples is nulled.
    """
    w = ep.sliding_windows(spans, win, step)
    d = attach(df, spans, ["session_id"], "inner").where((F.col(t) >= F.col("t0")) & (F.col(t) <= F.col("t1")))
    lo = F.greatest(F.floor((F.col(t) - F.col("t0") - win) / step), F.lit(0)).cast("long")
    hi = F.floor((F.col(t) - F.col("t0")) / step).cast("long")
    d = d.withColumn("window_idx", F.explode(F.sequence(lo, hi)))
    ok = F.avg(success) if success else F.lit(1.0)
    s = F.col("t0") + F.col("window_idx") * F.lit(step)
    inside = (F.col(t) >= s) & (F.col(t) < F.least(s + F.lit(win), F.col("t1")))
    g = d.where(inside).groupBy(*KEYS, "window_idx").agg(ok.alias("success_ok"), *[F.avg(c).alias(n) for n, c in cols.items()])
    roles = df.select(*KEYS).distinct()
    o = w.join(roles, "session_id").join(g, [*KEYS, "window_idx"], "left").na.fill(0.0, ["success_ok"])
    enough = F.col("success_ok") >= min_success
    return o.select(*KEYS, "window_idx", "t_start", "t_end", *[F.when(enough, F.col(n)).alias(n) for n in cols], "success_ok")


def window_synchrony(windows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """G-34: correlation over common windows of each role pair and metric."""
    long = melt(windows, ["session_id", "role", "window_idx"], metrics)
    a = long.select("session_id", "window_idx", "feature", F.col("role").alias("role_a"), F.col("value").alias("x"))
    b = long.select("session_id", "window_idx", "feature", F.col("role").alias("role_b"), F.col("value").alias("y"))
    j = a.join(b, ["session_id", "window_idx", "feature"]).where("role_a < role_b")
    return pearson_by(j, ["session_id", "role_a", "role_b", "feature"], "x", "y", min_n=2)


def windowed_summary(windows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """G-35: mean, median and share of valid windows per signal."""
    long = melt(windows, KEYS, cols)
    k = [*KEYS, "feature"]
    s = long.groupBy(*k).agg(F.avg("value").alias("mean"), (F.count("value") / F.count("*")).alias("valid_ratio"))
    return s.join(quantiles(long, k, "value", {"median": 0.5}), k, "left")


def raster(states: DataFrame, spans: DataFrame, t: str, value: str, fs: float, chunk_s: float) -> DataFrame:
    """J-05: state of each role on the grid of its session (0 before the first sample)."""
    n = F.floor((F.col("t1") - F.col("t0")) * fs).cast("long") + 1
    g = grid(spans, n, fs).withColumn(t, F.col("t0") + F.col("frame_idx") / F.lit(fs)).select("session_id", "frame_idx", t)
    g = g.join(states.select(*KEYS).distinct(), "session_id").select(*KEYS, t, "frame_idx")
    s = states.withColumn("_st", F.coalesce(F.col(value), F.lit(0)).cast("int")).select(*KEYS, t, "_st")
    return asof(g, s, KEYS, t, ["_st"], chunk_s).select(*KEYS, "frame_idx", F.coalesce("_st", F.lit(0)).alias("state"))


def pair_overlap(rast: DataFrame, fs: float, min_overlap_s: float) -> DataFrame:
    """G-36: Jaccard index of active frames and number of common episodes per pair."""
    k = ["session_id", "role_a", "role_b"]
    on = rast.where("state = 1").select("session_id", "role", "frame_idx")
    per = on.groupBy("session_id", "role").agg(F.count("*").alias("_n"))
    a = on.withColumnRenamed("role", "role_a")
    b = on.withColumnRenamed("role", "role_b")
    both = cut(a.join(b, ["session_id", "frame_idx"]).where("role_a < role_b").select(*k, "frame_idx"))
    inter = both.groupBy(*k).agg(F.count("*").alias("_i"))
    eps = ep.drop_micro(ep.mask_runs(both, k), fs, min_overlap_s).groupBy(*k).agg(F.count("*").alias("n_sync_ep"))
    p = role_pairs(rast).join(inter, k, "left").join(eps, k, "left")
    p = p.join(per.select("session_id", F.col("role").alias("role_a"), F.col("_n").alias("_na")), ["session_id", "role_a"], "left")
    p = p.join(per.select("session_id", F.col("role").alias("role_b"), F.col("_n").alias("_nb")), ["session_id", "role_b"], "left")
    p = p.na.fill(0, ["_i", "n_sync_ep", "_na", "_nb"])
    return p.select(*k, F.try_divide(F.col("_i").cast("double"), F.col("_na") + F.col("_nb") - F.col("_i")).alias("jaccard"), "n_sync_ep")


def all_active(rast: DataFrame, fs: float, min_episode_s: float) -> DataFrame:
    """G-36: frames on which every role is active: episodes and total time."""
    m = rast.groupBy("session_id", "frame_idx").agg(F.min("state").alias("_m")).where("_m = 1")
    runs = ep.mask_runs(m, ["session_id"])
    d = (F.col("frame_end") - F.col("frame_start")) / F.lit(fs)
    return runs.groupBy("session_id").agg(
        F.sum((d >= min_episode_s).cast("long")).alias("tri_n_ep"), F.sum(d).alias("tri_tot_dur_s")
    )


def face_session_table(df: DataFrame, spans: DataFrame, t: str, fs: float, chunk_s: float, win: float, step: float) -> DataFrame:
    """G-37: states, group episodes, pair synchrony and window summaries per session."""
    st = cut(binary_states(cut(intensities(df))))
    rast = cut(raster(st, spans, t, "joy_active", fs, chunk_s))
    tri = all_active(rast, fs, 0.0)
    jac = pair_overlap(rast, fs, 0.0).groupBy("session_id").agg(F.avg("jaccard").alias("joy_jaccard_mean"), F.sum("n_sync_ep").alias("joy_n_sync_ep"))
    w = window_descriptors(st, spans, t, win, step, {"joy_mean": "joy_intensity", "sad_mean": "sad_intensity"})
    syn = window_synchrony(w, ["joy_mean", "sad_mean"]).groupBy("session_id").agg(F.avg("r").alias("au_sync_pearson_mean"))
    mean = st.groupBy("session_id").agg(F.avg("joy_active").alias("joy_active_pct"), F.avg("sad_active").alias("sad_active_pct"))
    o = spans.select("session_id", (F.col("t1") - F.col("t0")).alias("interaction_dur_s"))
    for part in (mean, tri, jac, syn):
        o = o.join(part, "session_id", "left")
    o = o.na.fill(0, ["tri_n_ep", "tri_tot_dur_s"])
    return o.withColumn("tri_occupancy", F.try_divide("tri_tot_dur_s", "interaction_dur_s")).withColumn(
        "tri_rate_per_min", F.try_divide(F.col("tri_n_ep").cast("double"), F.col("interaction_dur_s") / 60.0)
    )
