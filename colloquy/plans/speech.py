"""Speech queries on event-derived segments and frames."""

from pyspark.sql import functions as F

from colloquy.operators import intervals as iv, speech as sp
from colloquy.operators.align import interval_join
from colloquy.plans import query
from colloquy.plans import tables as t
from colloquy.session import cut

C = t.SEG_CHUNK_S
TOT = f"tot AS (SELECT DISTINCT session_id, {t.TOTAL_S}::DOUBLE AS total_s FROM seg)"


def totals(segs):
    return segs.select("session_id", F.lit(t.TOTAL_S).alias("total_s")).distinct()


MRG = """mrg1 AS (SELECT *, max(end_s) OVER (PARTITION BY session_id ORDER BY start_s, end_s, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pm FROM seg),
mrg2 AS (SELECT *, sum(CASE WHEN pm IS NULL OR start_s > pm THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start_s, end_s, role ROWS UNBOUNDED PRECEDING) isl FROM mrg1),
uni AS (SELECT session_id, min(start_s) start_s, max(end_s) end_s FROM mrg2 GROUP BY session_id, isl)"""

SIL = """sil0 AS (SELECT session_id, coalesce(lag(end_s) OVER (PARTITION BY session_id ORDER BY start_s), 0) a, start_s b FROM uni
  UNION ALL SELECT session_id, max(end_s), max(total_s) FROM uni JOIN tot USING (session_id) GROUP BY session_id),
sil AS (SELECT session_id, a AS start_s, least(b, total_s) AS end_s FROM sil0 JOIN tot USING (session_id) WHERE least(b, total_s) > a)"""


def _merge_sql(src: str, out: str, pause: float) -> str:
    w = "PARTITION BY session_id ORDER BY start_s, end_s, role"
    return f"""{out}_a AS (SELECT *, CASE WHEN lag(role) OVER ({w}) = role THEN 0 ELSE 1 END chg FROM {src}),
{out}_b AS (SELECT *, sum(chg) OVER ({w} ROWS UNBOUNDED PRECEDING) run FROM {out}_a),
{out}_c AS (SELECT *, max(end_s) OVER (PARTITION BY session_id, run ORDER BY start_s, end_s, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pm FROM {out}_b),
{out}_d AS (SELECT *, sum(CASE WHEN pm IS NULL OR start_s - pm > {pause} THEN 1 ELSE 0 END) OVER ({w} ROWS UNBOUNDED PRECEDING) isl FROM {out}_c),
{out} AS (SELECT session_id, role, min(start_s) start_s, max(end_s) end_s FROM {out}_d GROUP BY session_id, role, isl)"""


TURN = ", ".join([
    _merge_sql("seg", "tp1", 3.0),
    "tp2 AS (SELECT * FROM tp1 WHERE end_s - start_s >= 1.0)",
    _merge_sql("tp2", "turn", 3.0),
])
FLOOR = """flr0 AS (SELECT session_id, role from_role, lead(role) OVER w to_role, end_s at_s, lead(start_s) OVER w - end_s gap_s
  FROM turn WINDOW w AS (PARTITION BY session_id ORDER BY start_s, end_s, role)),
flr AS (SELECT * FROM flr0 WHERE from_role <> to_role AND gap_s > 0 AND gap_s <= 2.0)"""


@query("i03_total_duration", t.with_(t.SEG) + "SELECT session_id, role, round(sum(end_s - start_s), 4) speech_s, count(*) n_segments FROM seg GROUP BY ALL")
def _(spark, sf):
    return iv.total_duration(t.segments(spark, sf)).withColumn("speech_s", F.round("speech_s", 4))


@query("i04_pairwise_overlap", t.with_(t.SEG) + """
SELECT session_id, role_a, role_b, round(sum(o), 4) overlap_s FROM (
  SELECT a.session_id, a.role role_a, b.role role_b, greatest(0, least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s)) o
  FROM seg a JOIN seg b ON a.session_id = b.session_id AND a.role < b.role) GROUP BY ALL""")
def _(spark, sf):
    return iv.pairwise_overlap(t.segments(spark, sf), C).withColumn("overlap_s", F.round("overlap_s", 4))


@query("i05_merge_union", t.with_(t.SEG, MRG) + "SELECT * FROM uni")
def _(spark, sf):
    return iv.merge_union(t.segments(spark, sf), C)


@query("i06_silence", t.with_(t.SEG, TOT, MRG, SIL) + "SELECT * FROM sil")
def _(spark, sf):
    s = t.segments(spark, sf)
    return iv.silence_intervals(s, totals(s), C)


@query("i07_multi_active", t.with_(t.SEG) + """, ed AS (SELECT session_id, t, sum(d) d FROM (
  SELECT session_id, start_s t, 1 d FROM seg UNION ALL SELECT session_id, end_s, -1 FROM seg) GROUP BY ALL),
cu AS (SELECT session_id, t, sum(d) OVER (PARTITION BY session_id ORDER BY t) c, d FROM ed),
cr AS (SELECT *, c - d AS p FROM cu WHERE (c - d < 2 AND c >= 2) OR (c - d >= 2 AND c < 2)),
ld AS (SELECT session_id, t AS start_s, lead(t) OVER (PARTITION BY session_id ORDER BY t) end_s, c FROM cr)
SELECT session_id, start_s, end_s FROM ld WHERE c >= 2""")
def _(spark, sf):
    return iv.multi_active_intervals(t.segments(spark, sf), 2, C)


OCC = f"""fr AS (SELECT session_id, floor(start_s * 100)::BIGINT i0, least(ceil(end_s * 100)::BIGINT, n) i1, n
  FROM seg JOIN (SELECT session_id, ceil(total_s * 100)::BIGINT n FROM tot) USING (session_id)),
fe AS (SELECT session_id, f, sum(d) d FROM (SELECT session_id, i0 f, 1 d FROM fr WHERE i1 > i0 UNION ALL SELECT session_id, i1, -1 FROM fr WHERE i1 > i0) GROUP BY ALL),
ft AS (SELECT session_id, f frame_start, lead(f) OVER w frame_end, sum(d) OVER (PARTITION BY session_id ORDER BY f)::BIGINT AS level
  FROM fe WINDOW w AS (PARTITION BY session_id ORDER BY f)),
occ AS (SELECT session_id, round((260000 - sum(CASE WHEN level >= 1 THEN frame_end - frame_start ELSE 0 END)) / 260000.0::DOUBLE, 6) pct_0,
  round(sum(CASE WHEN level = 1 THEN frame_end - frame_start ELSE 0 END) / 260000.0::DOUBLE, 6) pct_1,
  round(sum(CASE WHEN level = 2 THEN frame_end - frame_start ELSE 0 END) / 260000.0::DOUBLE, 6) pct_2,
  round(sum(CASE WHEN level >= 3 THEN frame_end - frame_start ELSE 0 END) / 260000.0::DOUBLE, 6) pct_3,
  round(sum(CASE WHEN level >= 2 THEN frame_end - frame_start ELSE 0 END) / 260000.0::DOUBLE, 6) overlap_ratio
  FROM ft WHERE frame_end IS NOT NULL GROUP BY session_id)"""


@query("i08_occupancy", t.with_(t.SEG, TOT, OCC) + "SELECT * FROM occ")
def _(spark, sf):
    s = t.segments(spark, sf)
    return iv.occupancy(s, totals(s), C)


@query("i09_occupancy_timeline", t.with_(t.SEG, TOT, OCC) + "SELECT * FROM ft WHERE frame_end IS NOT NULL")
def _(spark, sf):
    s = t.segments(spark, sf)
    return iv.occupancy_timeline(s, totals(s), 100.0, C)


# Energy frames: a decibel scale against the loudest frame, median per track.
ACT = t.FRM + """, en AS (SELECT *, greatest(-80.0, 20 * (log10(greatest(1e-5, rms)) - log10(max(rms) OVER (PARTITION BY session_id, role)))) db FROM frm),
act AS (SELECT session_id, role, frame_idx, rms, db > quantile_cont(db, 0.5) OVER (PARTITION BY session_id, role) + 3.0 AND 20 * log10(greatest(1e-5, rms)) > 10.0 AS active FROM en)"""


@query("i01_activity_mask", t.with_(ACT) + "SELECT * FROM act")
def _(spark, sf):
    return sp.activity_mask(t.frames(spark, sf), 3.0, 10.0)


@query("i02_mask_to_segments", t.with_(ACT) + """, g AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY session_id, role ORDER BY frame_idx) i FROM act WHERE active),
ls AS (SELECT session_id, role, max(frame_idx) l FROM act GROUP BY ALL),
sg AS (SELECT session_id, role, min(frame_idx) * 10.0::DOUBLE s, least(max(frame_idx) + 1, any_value(l)) * 10.0::DOUBLE e FROM g JOIN ls USING (session_id, role) GROUP BY session_id, role, i),
sh AS (SELECT *, sum(CASE WHEN s - pe <= 20.0 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, role ORDER BY s) i FROM (SELECT *, lag(e) OVER (PARTITION BY session_id, role ORDER BY s) pe FROM sg))
SELECT session_id, role, min(s) start_s, max(e) end_s FROM sh GROUP BY session_id, role, i""")
def _(spark, sf):
    m = cut(sp.activity_mask(t.frames(spark, sf), 3.0, 10.0))
    return iv.mask_to_segments(m, 10.0, 20.0, 32)


@query("i10_activity_synchrony", t.with_(ACT) + """, le AS (SELECT session_id, role, max(frame_idx) + 1 len FROM act GROUP BY ALL),
n AS (SELECT session_id, min(len) n FROM le GROUP BY ALL),
v AS (SELECT le.session_id, le.role, f.i, coalesce(a.active, false)::INT x FROM le JOIN n USING (session_id), LATERAL (SELECT unnest(range(n.n)) i) f
  LEFT JOIN act a ON a.session_id = le.session_id AND a.role = le.role AND a.frame_idx = f.i)
SELECT a.session_id, a.role role_a, b.role role_b, count(*) n, round(corr(a.x, b.x), 6) synchrony
FROM v a JOIN v b ON a.session_id = b.session_id AND a.i = b.i AND a.role < b.role GROUP BY ALL""")
def _(spark, sf):
    m = cut(sp.activity_mask(t.frames(spark, sf), 3.0, 10.0))
    return iv.activity_synchrony(m).withColumn("synchrony", F.round("synchrony", 6))


@query("i22_dominant_activity", t.with_(ACT) + """
SELECT session_id, role, frame_idx, rms, quiet AND (other IS NULL OR rms > pow(10, 3.0 / 20) * other) AS active FROM (
 SELECT a.session_id, a.role, a.frame_idx, a.rms, any_value(a.own) quiet, max(b.rms) other FROM (
  SELECT *, db > quantile_cont(db, 0.5) OVER (PARTITION BY session_id, role) + 3.0 own FROM en) a
  LEFT JOIN frm b ON a.session_id = b.session_id AND a.frame_idx = b.frame_idx AND a.role <> b.role GROUP BY ALL)""")
def _(spark, sf):
    return sp.dominant_activity(t.frames(spark, sf), 3.0, 3.0)


@query("i11_aggregate_turns", t.with_(t.SEG, TURN) + "SELECT * FROM turn")
def _(spark, sf):
    return iv.aggregate_turns(t.segments(spark, sf), C)


@query("i12_floor_exchanges", t.with_(t.SEG, TURN, FLOOR) + "SELECT * FROM flr")
def _(spark, sf):
    return iv.floor_exchanges(cut(iv.aggregate_turns(t.segments(spark, sf), C)), C)


TAKE = """tak AS (SELECT a.session_id, a.role source, b.role target, a.end_s a_e, b.start_s b_s FROM seg a JOIN seg b
  ON a.session_id = b.session_id AND a.role <> b.role AND b.start_s - a.end_s > 0 AND b.start_s - a.end_s <= 1.0
  AND a.end_s - a.start_s >= 1.0 AND b.end_s - b.start_s >= 1.0)"""
INTR = """itr AS (SELECT a.session_id, a.role source, b.role target, b.start_s at_s, least(a.end_s, b.end_s) - b.start_s overlap_s,
  b.end_s - a.end_s >= 0.5 success FROM seg a JOIN seg b ON a.session_id = b.session_id AND a.role <> b.role
  AND a.start_s < b.start_s AND b.start_s < a.end_s AND least(a.end_s, b.end_s) - b.start_s >= 0.1
  AND a.end_s - a.start_s >= 1.0 AND b.end_s - b.start_s >= 1.0)"""


@query("i13_rapid_takeovers", t.with_(t.SEG, TAKE) + "SELECT * FROM tak")
def _(spark, sf):
    return iv.rapid_takeovers(t.segments(spark, sf))


@query("i14_interruptions", t.with_(t.SEG, INTR) + "SELECT session_id, source, target, count(*) attempts, sum(success::INT)::BIGINT successes FROM itr GROUP BY ALL")
def _(spark, sf):
    return iv.interruptions(t.segments(spark, sf))


@query("i19_interruption_events", t.with_(t.SEG, INTR) + "SELECT * FROM itr")
def _(spark, sf):
    return iv.interruption_events(t.segments(spark, sf))


BC = """bc AS (SELECT * FROM seg c WHERE end_s - start_s BETWEEN 0.1 AND 0.7
 AND EXISTS (SELECT 1 FROM seg o WHERE o.session_id = c.session_id AND o.role <> c.role AND (
   greatest(0, least(c.end_s, o.end_s) - greatest(c.start_s, o.start_s)) >= 0.1
   OR c.start_s - o.end_s BETWEEN 0 AND 0.5 OR o.start_s - c.end_s BETWEEN 0 AND 0.5))
 AND NOT EXISTS (SELECT 1 FROM seg o WHERE o.session_id = c.session_id AND o.role = c.role AND NOT (o.start_s = c.start_s AND o.end_s = c.end_s)
   AND c.start_s - o.end_s > 0 AND c.start_s - o.end_s <= 0.2)
 AND NOT EXISTS (SELECT 1 FROM turn o WHERE o.session_id = c.session_id AND o.role = c.role AND abs(o.start_s - c.start_s) < 0.5))"""


@query("i15_backchannels", t.with_(t.SEG, TURN, BC) + "SELECT * FROM bc")
def _(spark, sf):
    s = t.segments(spark, sf)
    return iv.backchannels(s, cut(iv.aggregate_turns(s, C)))


MET = """met AS (SELECT session_id, round(total_s, 3) duration_s, round(coalesce(overlap_s, 0), 3) overlap_s,
 round(coalesce(po, 0), 3) pairwise_overlap_s, round(coalesce(po, 0) / total_s, 3) pairwise_overlap_ratio,
 round(coalesce(pt, 0), 3) pause_time_s, round(coalesce(pt, 0) / total_s, 3) pause_ratio, round(coalesce(mp, 0), 3) mean_pause_s,
 round(coalesce(fm, 0), 3) floor_exchange_pause_mean_s, coalesce(nf, 0) n_floor_exchanges, pct_0, pct_1, pct_2, pct_3, overlap_ratio,
 round(coalesce(mt, 0), 3) mean_turn_s, coalesce(nt, 0) total_turns,
 round(CASE WHEN round(coalesce(mp, 0), 3) > 0 THEN coalesce(mt, 0) / round(mp, 3) ELSE 0 END, 3) turn_to_pause_ratio,
 coalesce(rt, 0) rapid_floor_takeovers_total, coalesce(na, 0) n_attempted_interruptions, coalesce(ns, 0) n_successful_interruptions,
 round(CASE WHEN na > 0 THEN ns::DOUBLE / na END, 3) successful_interruption_ratio
 FROM tot LEFT JOIN (SELECT session_id, sum(end_s - start_s) pt, avg(end_s - start_s) mp FROM sil GROUP BY ALL) USING (session_id)
 LEFT JOIN (SELECT session_id, avg(gap_s) fm, count(*) nf FROM flr GROUP BY ALL) USING (session_id)
 LEFT JOIN (SELECT session_id, avg(end_s - start_s) mt, count(*) nt FROM turn GROUP BY ALL) USING (session_id)
 LEFT JOIN (SELECT session_id, sum(least(b.end_s, a.end_s) - greatest(a.start_s, b.start_s)) po FROM seg a JOIN seg b USING (session_id)
   WHERE a.role < b.role AND a.start_s < b.end_s AND b.start_s < a.end_s GROUP BY ALL) USING (session_id)
 LEFT JOIN (SELECT session_id, sum(e - t) overlap_s FROM (SELECT session_id, t, lead(t) OVER (PARTITION BY session_id ORDER BY t) e, sum(d) OVER (PARTITION BY session_id ORDER BY t) c FROM (
   SELECT session_id, t, sum(d) d FROM (SELECT session_id, start_s t, 1 d FROM seg UNION ALL SELECT session_id, end_s, -1 FROM seg) GROUP BY ALL)) WHERE c >= 2 GROUP BY session_id) USING (session_id)
 LEFT JOIN occ USING (session_id) LEFT JOIN (SELECT session_id, count(*) rt FROM tak GROUP BY ALL) USING (session_id)
 LEFT JOIN (SELECT session_id, count(*) na, sum(success::INT)::BIGINT ns FROM itr GROUP BY ALL) USING (session_id))"""
ALL_SPEECH = t.with_(t.SEG, TOT, MRG, SIL, TURN, FLOOR, OCC, TAKE, INTR, BC, MET)


@query("i16_speech_metrics", ALL_SPEECH + "SELECT * FROM met")
def _(spark, sf):
    s = t.segments(spark, sf)
    return sp.speech_metrics(s, totals(s), C)


ROLE = """rol AS (SELECT session_id, role, round(sp, 3) speech_s, round(sp / total_s, 3) speech_ratio, round(greatest(0, total_s - sp), 3) silence_s,
 round(sp / nullif(greatest(0, total_s - sp), 0), 3) speak_sil_ratio, coalesce(nt, 0) turns_n, coalesce(nb, 0) backchannels_n,
 round(coalesce(nt, 0)::DOUBLE / nullif(coalesce(nb, 0), 0), 3) turns_to_backchannels, round(coalesce(mt, 0), 3) mean_turn_s, round(coalesce(st, 0), 3) speaking_turn_time_s
 FROM (SELECT session_id, role, sum(end_s - start_s) sp FROM seg GROUP BY ALL) JOIN tot USING (session_id)
 LEFT JOIN (SELECT session_id, role, count(*) nt, avg(end_s - start_s) mt, sum(end_s - start_s) st FROM turn GROUP BY ALL) USING (session_id, role)
 LEFT JOIN (SELECT session_id, role, count(*) nb FROM bc GROUP BY ALL) USING (session_id, role))"""


@query("i16_role_metrics", t.with_(t.SEG, TOT, TURN, BC, ROLE) + "SELECT * FROM rol")
def _(spark, sf):
    s = t.segments(spark, sf)
    return sp.role_metrics(s, cut(iv.aggregate_turns(s, C)), totals(s))


@query("i17_speech_features", t.with_(t.SEG, TOT, MRG, SIL, TURN, FLOOR, OCC, TAKE, INTR, BC, MET, ROLE) + """
, ft2 AS (SELECT met.*, total_speech_s, audio_turn_balance_cv, speech_balance_cv, max_speech_ratio, audio_distrib_speech, n_backchannels, audio_participation_entropy,
  n_backchannels / (duration_s / 60) backchannel_rate_per_min, n_attempted_interruptions / (duration_s / 60) interruptions_rate_per_min
 FROM met JOIN (SELECT session_id, sum(speech_s) total_speech_s, stddev_pop(turns_n) / avg(turns_n) audio_turn_balance_cv, stddev_pop(speech_s) / avg(speech_s) speech_balance_cv,
  max(speech_ratio) max_speech_ratio, avg(pow(speech_s / tt - 1.0 / nn, 2)) audio_distrib_speech, sum(backchannels_n)::BIGINT n_backchannels,
  -sum(speech_s / tt * ln(speech_s / tt)) audio_participation_entropy
  FROM (SELECT *, sum(speech_s) OVER (PARTITION BY session_id) tt, count(*) OVER (PARTITION BY session_id) nn FROM rol) GROUP BY session_id) USING (session_id))
SELECT session_id, round(total_speech_s, 3) total_speech_s, round(audio_turn_balance_cv, 6) audio_turn_balance_cv, round(speech_balance_cv, 6) speech_balance_cv, max_speech_ratio,
 round(audio_distrib_speech, 6) audio_distrib_speech, n_backchannels, round(audio_participation_entropy, 6) audio_participation_entropy, round(backchannel_rate_per_min, 6) backchannel_rate_per_min,
 round(interruptions_rate_per_min, 6) interruptions_rate_per_min,
 round((total_turns - avg(total_turns) OVER ()) / stddev_pop(total_turns) OVER (), 6) z_total_turns,
 round((pause_ratio - avg(pause_ratio) OVER ()) / stddev_pop(pause_ratio) OVER (), 6) z_pause_ratio FROM ft2""")
def _(spark, sf):
    s = t.segments(spark, sf)
    turns = cut(iv.aggregate_turns(s, C))
    tot = totals(s)
    f = sp.speech_features(sp.speech_metrics(s, tot, C, turns), sp.role_metrics(s, turns, tot))
    r = lambda c: F.round(c, 6).alias(c)
    return f.select(
        "session_id", F.round("total_speech_s", 3).alias("total_speech_s"), r("audio_turn_balance_cv"), r("speech_balance_cv"),
        "max_speech_ratio", r("audio_distrib_speech"), "n_backchannels", r("audio_participation_entropy"),
        r("backchannel_rate_per_min"), r("interruptions_rate_per_min"), r("z_total_turns"), r("z_pause_ratio"),
    )


@query("i18_live_turn_metrics", t.with_(t.SEG, TURN) + """SELECT session_id, role, end_s, count(*) OVER w n_turns, round(avg(end_s - start_s) OVER w, 6) mean_turn_s FROM turn
WINDOW w AS (PARTITION BY session_id ORDER BY end_s, start_s, role ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    turns = cut(iv.aggregate_turns(t.segments(spark, sf), C))
    return sp.live_turn_metrics(turns, C).withColumn("mean_turn_s", F.round("mean_turn_s", 6))


@query("i18_live_shares", t.with_(t.SEG) + """, pr AS (SELECT DISTINCT session_id, role, i * 300.0::DOUBLE t FROM seg, range(1, 9) r(i))
SELECT pr.session_id, pr.role, pr.t, round(coalesce(sum(least(end_s, t) - start_s) FILTER (start_s < t), 0), 4) speech_s
FROM pr LEFT JOIN seg ON seg.session_id = pr.session_id AND seg.role = pr.role GROUP BY ALL""")
def _(spark, sf):
    s = t.segments(spark, sf)
    probes = totals(s).select("session_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("i")).select("session_id", (F.col("i") * 300.0).alias("t"))
    return sp.live_shares(s, probes, C).withColumn("speech_s", F.round("speech_s", 4))


@query("i20_common_window", t.with_(t.SAMP) + "SELECT session_id, max(a) t0, min(b) t1 FROM (SELECT session_id, role, min(t) a, max(t) b FROM samp GROUP BY ALL) GROUP BY ALL")
def _(spark, sf):
    return iv.common_window(t.samples(spark, sf))


@query("i21_align_tracks", t.with_(t.SAMP) + """, m AS (SELECT session_id, role, min(t) m FROM samp WHERE object = 'click' GROUP BY ALL),
s AS (SELECT session_id, role, m - min(m) OVER (PARTITION BY session_id) sh FROM m)
SELECT samp.session_id, samp.role, round(t - coalesce(sh, 0), 6) t, round(sh, 6) shift_s, value FROM samp LEFT JOIN s USING (session_id, role)""")
def _(spark, sf):
    s = t.samples(spark, sf).select("session_id", "role", "t", "value", "object")
    a = iv.align_tracks(s.select("session_id", "role", "t", "value"), s.where("object = 'click'"))
    return a.withColumn("t", F.round("t", 6)).withColumn("shift_s", F.round("shift_s", 6))


@query("i23_session_summary", t.with_(t.SEG, TURN, INTR) + """SELECT source, target, session_id, count(*) attempts, sum(success::INT)::BIGINT successes, any_value(nt) target_turns
FROM itr LEFT JOIN (SELECT role target, count(*) nt FROM turn WHERE session_id = 1 GROUP BY ALL) USING (target) WHERE session_id = 1 GROUP BY source, target, session_id""")
def _(spark, sf):
    s = t.segments(spark, sf)
    return sp.session_summary(s, iv.aggregate_turns(s, C), 1)


@query("j08_interval_overlap_join", t.with_(t.SEG) + """SELECT a.session_id, a.role, a.start_s, a.end_s, b.role o_role, b.start_s o_s, b.end_s o_e
FROM seg a JOIN seg b ON a.session_id = b.session_id AND a.role < b.role AND a.start_s < b.end_s AND b.start_s < a.end_s""")
def _(spark, sf):
    s = t.segments(spark, sf)
    o = s.select("session_id", F.col("role").alias("o_role"), F.col("start_s").alias("o_s"), F.col("end_s").alias("o_e"))
    return interval_join(
        s, o, ["session_id"], 10.0, ("start_s", "end_s"), ("o_s", "o_e"),
        (F.col("role") < F.col("o_role")) & (F.col("start_s") < F.col("o_e")) & (F.col("o_s") < F.col("end_s")),
    )


@query("i23_session_overview", ALL_SPEECH + """, md AS (SELECT session_id, quantile_cont(end_s - start_s, 0.5) md FROM turn GROUP BY ALL), nb AS (SELECT session_id, count(*) nb FROM bc GROUP BY ALL),
en AS (SELECT session_id, -sum(p * log2(p)) h FROM (SELECT session_id, sum(end_s - start_s) / sum(sum(end_s - start_s)) OVER (PARTITION BY session_id) p FROM seg GROUP BY session_id, role) WHERE p > 0 GROUP BY ALL)
SELECT session_id, total_turns n_turns, round(mean_turn_s, 2) mean_turn_s, round(md, 2) median_turn_s, n_floor_exchanges, CASE WHEN n_floor_exchanges > 0 THEN floor_exchange_pause_mean_s END floor_pause_mean_s, coalesce(nb, 0) n_backchannels,
 round(coalesce(nb, 0) / (duration_s / 60), 2) bc_per_min, round(pct_0 * 100, 1) pct_0_spk, round(pct_1 * 100, 1) pct_1_spk, round(pct_2 * 100, 1) pct_2_spk, round(pct_3 * 100, 1) pct_3_spk, round(overlap_ratio, 3) overlap_ratio, round(h, 3) participation_entropy,
 rapid_floor_takeovers_total, n_attempted_interruptions, n_successful_interruptions, successful_interruption_ratio FROM met LEFT JOIN md USING (session_id) LEFT JOIN nb USING (session_id) LEFT JOIN en USING (session_id)""")
def _(spark, sf):
    s = t.segments(spark, sf)
    return sp.session_overview(s, totals(s), C)
