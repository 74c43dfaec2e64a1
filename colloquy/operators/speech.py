"""Speech activity and session-level conversation metrics (I-01, I-16 to I-18, I-22, I-23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colloquy.functions.scalars import round_scaled

from . import intervals as iv
from .aggregates import entropy_of, zscore_within
from .scan import by_width, chunk_width, quantiles, running_sum, attach, scan, with_group_aggs
from colloquy.session import cut

# Fixed values of the decibel scale used for energy frames.
AMIN = 1e-5
TOP_DB = 80.0


def decibel(rms: Column, ref: Column) -> Column:
    return 20.0 * (F.log10(F.greatest(F.lit(AMIN), rms)) - F.log10(F.greatest(F.lit(AMIN), ref)))


def energy(frames: DataFrame) -> DataFrame:
    """Energy in dB relative to the loudest frame of the track, at most 80 dB below it."""
    f = with_group_aggs(frames, ["session_id", "role"], _ref=F.max("rms"))
    return f.withColumn("db", F.greatest(decibel(F.col("rms"), F.col("_ref")), F.lit(-TOP_DB)))


def activity_mask(frames: DataFrame, thr_db: float, floor_db: float | None = None) -> DataFrame:
    """I-01: active where energy exceeds the track's median by ``thr_db`` and the floor."""
    keys = ["session_id", "role"]
    f = energy(frames)
    med = quantiles(f, keys, "db", {"_med": 0.5})
    f = attach(f, med, keys)
    active = F.col("db") > F.col("_med") + thr_db
    if floor_db is not None:
        active = active & (decibel(F.col("rms"), F.lit(1.0)) > floor_db)
    return f.select("session_id", "role", "frame_idx", "rms", active.alias("active"))


def dominant_activity(
    frames: DataFrame, thr_db: float, margin_db: float = 3.0
) -> DataFrame:
    """I-22: active on the own track and louder than every other role by ``margin_db``."""
    f = activity_mask(frames, thr_db)
    w = W.partitionBy("session_id", "frame_idx").orderBy(F.desc("rms"), "role")
    top = F.when(F.row_number().over(w) == 1, F.lead("rms").over(w)).otherwise(F.first("rms").over(w))
    f = f.withColumn("_other", top)
    louder = F.col("_other").isNull() | (F.col("rms") > F.lit(10 ** (margin_db / 20.0)) * F.col("_other"))
    return f.select("session_id", "role", "frame_idx", "rms", (F.col("active") & louder).alias("active"))


def role_metrics(segs: DataFrame, turns: DataFrame, totals: DataFrame) -> DataFrame:
    """Per role: speech, silence, turns, backchannels (one row per session and role)."""
    k = ["session_id", "role"]
    speech = segs.groupBy(*k).agg(F.sum(iv.duration()).alias("speech_s"))
    tk = turns.groupBy(*k).agg(
        F.count("*").alias("turns_n"), F.avg(iv.duration()).alias("mean_turn_s"),
        F.sum(iv.duration()).alias("speaking_turn_time_s"),
    )
    bc = iv.backchannels(segs, turns).groupBy(*k).agg(F.count("*").alias("backchannels_n"))
    r = speech.join(tk, k, "left").join(bc, k, "left").na.fill(
        0, ["turns_n", "backchannels_n", "mean_turn_s", "speaking_turn_time_s"]
    )
    r = r.join(totals, "session_id", "left")
    silence = F.greatest(F.lit(0.0), F.col("total_s") - F.col("speech_s"))
    return r.select(
        *k,
        F.round("speech_s", 3).alias("speech_s"),
        F.round(F.try_divide("speech_s", "total_s"), 3).alias("speech_ratio"),
        F.round(silence, 3).alias("silence_s"),
        F.round(F.try_divide(F.col("speech_s"), silence), 3).alias("speak_sil_ratio"),
        "turns_n",
        "backchannels_n",
        F.round(F.try_divide(F.col("turns_n").cast("double"), F.col("backchannels_n").cast("double")), 3).alias("turns_to_backchannels"),
        F.round("mean_turn_s", 3).alias("mean_turn_s"),
        F.round("speaking_turn_time_s", 3).alias("speaking_turn_time_s"),
    )


def speech_metrics(
    segs: DataFrame, totals: DataFrame, chunk_s: float | None, turns: DataFrame | None = None
) -> DataFrame:
    """I-16: one row per session with durations, pauses, exchanges, overlap, takeovers.

    Three passes: one sweep of the segments, one join of neighbouring segments, one scan of the turns.
    """
    chunk_s = chunk_width(segs, iv.KEYS, chunk_s)
    if turns is None:
        turns = iv.aggregate_turns(segs, chunk_s)
        turns = turns if chunk_s is None else cut(turns)
    k = "session_id"
    sweep = iv.sweep_summary(iv.role_sweep(segs, totals, chunk_s), totals)
    taking = iv.turn_taking(segs)
    exchange = iv.is_exchange()
    tk = iv.next_turns(turns, chunk_s).groupBy(k).agg(
        F.avg(iv.duration()).alias("mean_turn_s"), F.count("*").alias("total_turns"),
        F.avg(F.when(exchange, F.col("gap_s"))).alias("floor_exchange_pause_mean_s"), F.count(F.when(exchange, F.lit(1))).alias("n_floor_exchanges"),
    )
    m = totals
    for part in (sweep, tk, taking):
        m = m.join(part, k, "left")
    zero = [
        "pause_time_s", "mean_pause_s", "floor_exchange_pause_mean_s", "n_floor_exchanges", "overlap_s",
        "pairwise_overlap_s", "mean_turn_s", "total_turns", "rapid_floor_takeovers_total",
        "n_attempted_interruptions", "n_successful_interruptions",
    ]
    m = m.na.fill(0, zero)
    r3 = lambda c: F.round(c, 3)
    mean_pause = r3(F.col("mean_pause_s"))
    return m.select(
        k,
        r3(F.col("total_s")).alias("duration_s"),
        r3(F.col("overlap_s")).alias("overlap_s"),
        r3(F.col("pairwise_overlap_s")).alias("pairwise_overlap_s"),
        r3(F.col("pairwise_overlap_s") / F.col("total_s")).alias("pairwise_overlap_ratio"),
        r3(F.col("pause_time_s")).alias("pause_time_s"),
        r3(F.col("pause_time_s") / F.col("total_s")).alias("pause_ratio"),
        mean_pause.alias("mean_pause_s"),
        r3(F.col("floor_exchange_pause_mean_s")).alias("floor_exchange_pause_mean_s"),
        "n_floor_exchanges",
        "pct_0", "pct_1", "pct_2", "pct_3", "overlap_ratio",
        r3(F.col("mean_turn_s")).alias("mean_turn_s"),
        "total_turns",
        r3(F.when(mean_pause > 0, F.col("mean_turn_s") / mean_pause).otherwise(0.0)).alias("turn_to_pause_ratio"),
        "rapid_floor_takeovers_total",
        "n_attempted_interruptions",
        "n_successful_interruptions",
        r3(F.try_divide(F.col("n_successful_interruptions").cast("double"), F.col("n_attempted_interruptions").cast("double"))).alias("successful_interruption_ratio"),
    )


def speech_features(
    sessions: DataFrame, roles: DataFrame, by: tuple[str, ...] = ()
) -> DataFrame:
    """I-17: balance, entropy, dominance and rates from role rows; z within ``by``."""
    k = "session_id"
    bal = roles.groupBy(k).agg(
        F.sum("speech_s").alias("total_speech_s"),
        F.try_divide(F.stddev_pop("turns_n"), F.avg("turns_n")).alias("audio_turn_balance_cv"),
        F.try_divide(F.stddev_pop("speech_s"), F.avg("speech_s")).alias("speech_balance_cv"),
        F.max("speech_ratio").alias("max_speech_ratio"),
        # Shares sum to one, so the mean squared distance from an equal share is the
        # variance of the amounts over the squared total.
        F.try_divide(F.var_pop("speech_s"), F.pow(F.sum("speech_s"), F.lit(2))).alias("audio_distrib_speech"),
        F.sum("backchannels_n").alias("n_backchannels"),
    )
    ent = entropy_of(roles, [k], "speech_s", out="audio_participation_entropy")
    f = sessions.join(bal, k, "left").join(ent, k, "left")
    minutes = F.col("duration_s") / 60.0
    f = f.withColumn("backchannel_rate_per_min", F.try_divide(F.col("n_backchannels"), minutes))
    f = f.withColumn("interruptions_rate_per_min", F.try_divide(F.col("n_attempted_interruptions"), minutes))
    z = [
        "total_turns", "mean_turn_s", "overlap_ratio", "pause_ratio", "interruptions_rate_per_min",
        "audio_turn_balance_cv", "speech_balance_cv", "audio_participation_entropy", "max_speech_ratio",
    ]
    return zscore_within(f, z, list(by), prefix="z_", on_constant=None)


def live_turn_metrics(turns: DataFrame, chunk_s: float) -> DataFrame:
    """I-18: after each finished turn, the counts and means of all turns finished so far."""
    d = iv.duration()
    t = scan(
        turns, ["session_id"], ["end_s", "start_s", "role"], by_width("end_s", chunk_s),
        {"n_turns": running_sum(F.lit(1).cast("long")), "_sum": running_sum(d)},
    )
    return t.select(
        "session_id", "role", "end_s", "n_turns", (F.col("_sum") / F.col("n_turns")).alias("mean_turn_s")
    )


def live_shares(segs: DataFrame, probes: DataFrame, chunk_s: float) -> DataFrame:
    """I-18: speaking time of each role up to each probe time, running segments cut there."""
    k = ["session_id", "role"]
    e = iv.edges(segs, k)
    roles = segs.select(*k).distinct()
    p = probes.join(roles, "session_id").select(*k, "t", F.lit(0).cast("long").alias("d"), F.lit(1).alias("probe"))
    rows = e.withColumn("probe", F.lit(0)).select(*k, "t", "d", "probe").unionByName(p)
    # Speech before t is sum(d * (t - t_edge)) over earlier edges: two running sums.
    s = scan(
        rows, k, ["t", "probe"], by_width("t", chunk_s),
        {"_n": running_sum("d"), "_nt": running_sum(F.col("d") * F.col("t"))},
    ).where("probe = 1")
    return s.select(*k, "t", (F.col("_n") * F.col("t") - F.col("_nt")).alias("speech_s"))


def session_overview(segs: DataFrame, totals: DataFrame, chunk_s: float) -> DataFrame:
    """I-23: the metrics shown for a session, one row each: turns, exchanges, backchannels, occupancy, balance, takeovers."""
    k = "session_id"
    chunk_s = chunk_width(segs, iv.KEYS, chunk_s)
    turns = cut(iv.aggregate_turns(segs, chunk_s))
    m = speech_metrics(segs, totals, chunk_s, turns)
    median = quantiles(turns.withColumn("_d", iv.duration()), [k], "_d", {"_median": 0.5}, chunk_s is None)
    calls = iv.backchannels(segs, turns).groupBy(k).agg(F.count("*").alias("_bc"))
    speech = entropy_of(segs.groupBy(k, "role").agg(F.sum(iv.duration()).alias("_s")), [k], "_s", out="_h")
    o = m.join(median, k, "left").join(calls, k, "left").join(speech, k, "left").na.fill(0, ["_bc"])
    # Values that were rounded before lie on ties.
    percent = [round_scaled(F.col(f"pct_{n}") * 100, 1).alias(f"pct_{n}_spk") for n in range(4)]
    return o.select(
        k, F.col("total_turns").alias("n_turns"), round_scaled(F.col("mean_turn_s"), 2).alias("mean_turn_s"), round_scaled(F.col("_median"), 2).alias("median_turn_s"), "n_floor_exchanges",
        F.when(F.col("n_floor_exchanges") > 0, F.col("floor_exchange_pause_mean_s")).alias("floor_pause_mean_s"), F.col("_bc").alias("n_backchannels"),
        round_scaled(F.try_divide(F.col("_bc").cast("double"), F.col("duration_s") / 60.0), 2).alias("bc_per_min"), *percent, round_scaled(F.col("overlap_ratio"), 3).alias("overlap_ratio"),
        # The negated sum, so one role alone gives the zero that SQL gives.
        (-round_scaled(-F.col("_h") / F.ln(F.lit(2.0)), 3)).alias("participation_entropy"), "rapid_floor_takeovers_total", "n_attempted_interruptions", "n_successful_interruptions", "successful_interruption_ratio",
    )


def session_summary(segs: DataFrame, turns: DataFrame, session: str | int) -> DataFrame:
    """I-23: interruptions and turns of one session, by directed role pair."""
    only = F.col("session_id") == session
    return iv.interruptions(segs.where(only)).join(
        turns.where(only).groupBy(F.col("role").alias("target")).agg(F.count("*").alias("target_turns")),
        "target", "left",
    )
