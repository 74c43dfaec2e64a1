"""Gaze, face and position queries on sample- and embedding-derived recordings."""

from pyspark.sql import functions as F

from colloquy.operators import episodes as ep, face as fc, gaze as gz, position as po
from colloquy.operators.align import asof, grid, interpolate
from colloquy.plans import query
from colloquy.plans import tables as t
from colloquy.session import cut

C = 60.0
FS = 2.0
T1 = 2600.0

FIX = """f1 AS (SELECT *, row_number() OVER (PARTITION BY session_id, role ORDER BY t) - row_number() OVER (PARTITION BY session_id, role, object ORDER BY t) g FROM samp),
fix AS (SELECT session_id, role, object, min(t) onset, max(t) AS "offset" FROM f1 GROUP BY session_id, role, object, g HAVING max(t) - min(t) >= 0.2)"""


def rnd(df, *cols, d=6):
    return df.select(*[F.round(c, d).alias(c) if c in cols else F.col(c) for c in df.columns])


def fixes(spark, sf):
    return ep.fixations(t.samples(spark, sf), ["session_id", "role"], "t", C)


def plus_zero(df, *cols):
    """Rounded values with -0.0 as 0.0."""
    return df.withColumns({c: F.col(c) + F.lit(0.0) for c in cols})


def spans(df):
    return df.select("session_id").distinct().select("session_id", F.lit(0.0).alias("t0"), F.lit(T1).alias("t1"))


@query("g01_sliding_windows", t.with_(t.SAMP) + """, sp AS (SELECT session_id, min(t) t0, max(t) t1 FROM samp GROUP BY ALL)
SELECT session_id, i window_idx, t0 + i * 40.0 t_start, least(t0 + i * 40.0 + 90.0, t1) t_end FROM sp, range(0, 1000) r(i) WHERE i < ceil((t1 - t0) / 40.0)""")
def _(spark, sf):
    s = t.samples(spark, sf).groupBy("session_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return ep.sliding_windows(s, 90.0, 40.0)


@query("g02_episodes_grid", t.with_(t.FRM) + """, a AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY session_id, role ORDER BY frame_idx) g FROM frm WHERE rms > 40),
r AS (SELECT session_id, role, max(frame_idx) - min(frame_idx) + 1 n FROM a GROUP BY session_id, role, g)
SELECT session_id, role, count(*) n_episodes, round(sum(n / 0.1), 6) dur_total_s, round(avg(n / 0.1), 6) dur_mean_s FROM r GROUP BY ALL""")
def _(spark, sf):
    k = ["session_id", "role"]
    m = ep.mask_runs(t.frames(spark, sf).where("rms > 40"), k, 64)
    return rnd(ep.episode_stats(m, k, 0.1), "dur_total_s", "dur_mean_s")


@query("g03_episodes_irregular", t.with_(t.SAMP) + """, a AS (SELECT *, row_number() OVER (PARTITION BY session_id, role ORDER BY t) - row_number() OVER (PARTITION BY session_id, role, state ORDER BY t) g FROM samp),
r AS (SELECT session_id, role, min(t) s, max(t) e FROM a WHERE state GROUP BY session_id, role, g),
m AS (SELECT *, sum(CASE WHEN s - pe <= 20 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, role ORDER BY s) i FROM (SELECT *, lag(e) OVER (PARTITION BY session_id, role ORDER BY s) pe FROM r))
SELECT session_id, role, min(s) start_s, max(e) end_s FROM m GROUP BY session_id, role, i HAVING max(e) - min(s) >= 1""")
def _(spark, sf):
    return ep.irregular_episodes(t.samples(spark, sf), ["session_id", "role"], "t", C, 1.0, 20.0)


@query("g03_episodes_next_sample", t.with_(t.SAMP) + """, a AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY session_id, role, state ORDER BY t) g, lead(t) OVER w nx, t - lag(t) OVER w d FROM samp WINDOW w AS (PARTITION BY session_id, role ORDER BY t)),
dt AS (SELECT session_id, role, quantile_cont(d, 0.5) dt FROM a WHERE d > 0 GROUP BY ALL)
SELECT session_id, role, min(t) start_s, round(coalesce(max_by(nx, t), CASE WHEN max_by(nx, t) IS NULL THEN max(t) + any_value(dt) END), 6) end_s
FROM a JOIN dt USING (session_id, role) WHERE state GROUP BY session_id, role, g""".replace("coalesce(max_by(nx, t), CASE WHEN max_by(nx, t) IS NULL THEN max(t) + any_value(dt) END)", "CASE WHEN max(coalesce(nx, 1e18)) = 1e18 THEN max(t) + any_value(dt) ELSE max(nx) END"))
def _(spark, sf):
    return rnd(ep.irregular_episodes(t.samples(spark, sf), ["session_id", "role"], "t", C, end="next"), "end_s")


@query("g04_drop_micro", t.with_(t.FRM) + """, a AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY session_id, role ORDER BY frame_idx) g FROM frm WHERE rms > 40)
SELECT session_id, role, min(frame_idx) frame_start, max(frame_idx) + 1 frame_end FROM a GROUP BY session_id, role, g HAVING count(*) >= 2""")
def _(spark, sf):
    return ep.drop_micro(ep.mask_runs(t.frames(spark, sf).where("rms > 40"), ["session_id", "role"], 64), 0.1, 20.0)


@query("g05_infer_dt", t.with_(t.SAMP) + """SELECT session_id, role, round(quantile_cont(d, 0.5), 9) dt_s FROM (SELECT session_id, role, t - lag(t) OVER (PARTITION BY session_id, role ORDER BY t) d FROM samp) WHERE d > 0 GROUP BY ALL""")
def _(spark, sf):
    return rnd(ep.median_step(t.samples(spark, sf), ["session_id", "role"], "t", C), "dt_s", d=9)


@query("g06_resample_grid", t.with_(t.SAMP) + f"""{chr(44)} g AS (SELECT DISTINCT session_id, role, i frame_idx, i / 0.05 t FROM samp, range(0, 130) r(i)),
n AS (SELECT g.*, b.t bt, b.value bv, f.t ft, f.value fv FROM g ASOF LEFT JOIN samp b ON g.session_id = b.session_id AND g.role = b.role AND g.t >= b.t ASOF LEFT JOIN samp f ON g.session_id = f.session_id AND g.role = f.role AND g.t <= f.t)
SELECT session_id, role, frame_idx, t, round(CASE WHEN bt = t THEN bv WHEN bt IS NULL OR ft IS NULL OR least(t - bt, ft - t) > 10 THEN NULL ELSE bv + (fv - bv) * ((t - bt) / (ft - bt)) END, 6) AS value FROM n""")
def _(spark, sf):
    s = t.samples(spark, sf)
    g = grid(s.select("session_id", "role").distinct(), F.lit(130), 0.05).select("session_id", "role", "t", "frame_idx")
    return rnd(interpolate(g, s, ["session_id", "role"], "t", ["value"], C, 10.0), "value")


J05 = """pr AS (SELECT session_id, role, t, object FROM samp WHERE object = 'click'), st AS (SELECT session_id, role, t, value FROM samp WHERE object = 'view')"""


@query("j05_asof_backward", t.with_(t.SAMP, J05) + """SELECT pr.session_id, pr.role, pr.t, st.t t_match, st.value FROM pr ASOF LEFT JOIN st ON pr.session_id = st.session_id AND pr.role = st.role AND pr.t >= st.t""")
def _(spark, sf):
    s = t.samples(spark, sf)
    return asof(s.where("object = 'click'").select("session_id", "role", "t"), s.where("object = 'view'"), ["session_id", "role"], "t", ["value"], C)


@query("j06_asof_nearest", t.with_(t.SAMP, J05) + """, n AS (SELECT pr.*, b.t bt, b.value bv, f.t ft, f.value fv FROM pr ASOF LEFT JOIN st b ON pr.session_id = b.session_id AND pr.role = b.role AND pr.t >= b.t ASOF LEFT JOIN st f ON pr.session_id = f.session_id AND pr.role = f.role AND pr.t <= f.t),
m AS (SELECT session_id, role, t, bt IS NULL OR (ft IS NOT NULL AND ft - t < t - bt) fwd, bt, bv, ft, fv FROM n)
SELECT session_id, role, t, CASE WHEN abs((CASE WHEN fwd THEN ft ELSE bt END) - t) <= 15 THEN CASE WHEN fwd THEN ft ELSE bt END END t_match,
 CASE WHEN abs((CASE WHEN fwd THEN ft ELSE bt END) - t) <= 15 THEN CASE WHEN fwd THEN fv ELSE bv END END AS value FROM m""")
def _(spark, sf):
    s = t.samples(spark, sf)
    return asof(s.where("object = 'click'").select("session_id", "role", "t"), s.where("object = 'view'"), ["session_id", "role"], "t", ["value"], C, "nearest", 15.0)


@query("j07_interpolate", t.with_(t.SAMP, J05) + """, n AS (SELECT pr.*, b.t bt, b.value bv, f.t ft, f.value fv FROM pr ASOF LEFT JOIN st b ON pr.session_id = b.session_id AND pr.role = b.role AND pr.t >= b.t ASOF LEFT JOIN st f ON pr.session_id = f.session_id AND pr.role = f.role AND pr.t <= f.t)
SELECT session_id, role, t, round(CASE WHEN bt = t THEN bv WHEN bt IS NULL OR ft IS NULL OR least(t - bt, ft - t) > 20 THEN NULL ELSE bv + (fv - bv) * ((t - bt) / (ft - bt)) END, 6) AS value FROM n""")
def _(spark, sf):
    s = t.samples(spark, sf)
    return rnd(interpolate(s.where("object = 'click'").select("session_id", "role", "t"), s.where("object = 'view'"), ["session_id", "role"], "t", ["value"], C, 20.0), "value")


@query("j09_point_in_interval", t.with_(t.SEG) + """, g AS (SELECT session_id, role, unnest(range(ceil(start_s * 1.0)::BIGINT, ceil(end_s * 1.0)::BIGINT)) frame_idx FROM seg)
SELECT session_id, role, frame_idx, count(*) n FROM g GROUP BY ALL""")
def _(spark, sf):
    # An interval covers the frames ceil(start*fs) .. ceil(end*fs)-1, so no join is needed.
    s = t.segments(spark, sf).select("session_id", "role", F.ceil("start_s").alias("a"), F.ceil("end_s").alias("b")).where("b > a")
    return s.withColumn("frame_idx", F.explode(F.sequence(F.col("a"), F.col("b") - 1))).groupBy("session_id", "role", "frame_idx").agg(F.count("*").alias("n"))


@query("g07_time_align", t.with_(t.SAMP) + """, z AS (SELECT session_id, role, coalesce(min(t) FILTER (object = 'signup'), min(t)) z FROM samp GROUP BY ALL),
d AS (SELECT session_id, role, t - z t, CASE WHEN state THEN NULL ELSE value END v FROM samp JOIN z USING (session_id, role) WHERE object <> 'signup'),
x AS (SELECT *, row_number() OVER (PARTITION BY session_id, role ORDER BY t) x FROM d),
y AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER w bx, last_value(v IGNORE NULLS) OVER w bv, first_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER u fx, first_value(v IGNORE NULLS) OVER u fv FROM x
 WINDOW w AS (PARTITION BY session_id, role ORDER BY t ROWS UNBOUNDED PRECEDING), u AS (PARTITION BY session_id, role ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT session_id, role, round(t, 9) t, round(CASE WHEN v IS NOT NULL THEN v WHEN bv IS NULL THEN fv WHEN fv IS NULL THEN bv ELSE bv + (fv - bv) * ((x - bx)::DOUBLE / (fx - bx)) END, 6) v FROM y""")
def _(spark, sf):
    s = t.samples(spark, sf).select("session_id", "role", "t", (F.col("object") == "signup").alias("is_marker"), F.when(~F.col("state"), F.col("value")).alias("v"))
    return rnd(rnd(ep.time_align(s, ["session_id", "role"], "t", ["v"], C), "v"), "t", d=9)


@query("g08_fixations", t.with_(t.SAMP, FIX) + "SELECT * FROM fix")
def _(spark, sf):
    return fixes(spark, sf)


GRIDFIX = f"""gf AS (SELECT session_id, role, object, unnest(range(ceil(greatest(onset, 0) * {FS})::BIGINT, ceil(least("offset", {T1}) * {FS})::BIGINT)) f FROM fix),
sh AS (SELECT DISTINCT session_id, f FROM (SELECT session_id, object, f FROM gf GROUP BY ALL HAVING count(*) >= 2)),
si AS (SELECT *, f - row_number() OVER (PARTITION BY session_id ORDER BY f) g FROM sh),
sr AS (SELECT session_id, count(*) / {FS}::DOUBLE d FROM si GROUP BY session_id, g HAVING count(*) / {FS} >= 1.0)"""


@query("g09_shared_object", t.with_(t.SAMP, FIX, GRIDFIX) + f"""SELECT session_id, coalesce(n, 0) n_episodes, coalesce(round(td, 6), 0) dur_total_s, round(m, 6) dur_mean_s, round(q5, 6) dur_median_s, round(q2, 6) dur_q25_s, round(q7, 6) dur_q75_s,
 round(q7 - q2, 6) dur_iqr_s, round(coalesce(td, 0) * {FS} / ({T1} * {FS}), 6) shared_ratio
FROM (SELECT DISTINCT session_id FROM samp) LEFT JOIN (SELECT session_id, count(*) n, sum(d) td, avg(d) m, quantile_cont(d, 0.5) q5, quantile_cont(d, 0.25) q2, quantile_cont(d, 0.75) q7 FROM sr GROUP BY ALL) USING (session_id)""")
def _(spark, sf):
    s = t.samples(spark, sf)
    o = gz.shared_object(fixes(spark, sf), spans(s), ["session_id"], FS, 2, 1.0)
    return rnd(o, "dur_total_s", "dur_mean_s", "dur_median_s", "dur_q25_s", "dur_q75_s", "dur_iqr_s", "shared_ratio")


@query("g10_shared_object_windows", t.with_(t.SAMP, FIX) + f""", w AS (SELECT DISTINCT session_id, i window_idx, i * 200.0::DOUBLE s, least(i * 200.0 + 300.0, {T1})::DOUBLE e FROM samp, range(0, 13) r(i)),
gf AS (SELECT session_id, window_idx, role, object, unnest(range(ceil((greatest(onset, s) - s) * {FS})::BIGINT, ceil((least("offset", e) - s) * {FS})::BIGINT)) f FROM fix JOIN w USING (session_id) WHERE onset < e AND "offset" > s),
sh AS (SELECT DISTINCT session_id, window_idx, f FROM (SELECT session_id, window_idx, object, f FROM gf GROUP BY ALL HAVING count(*) >= 2)),
si AS (SELECT *, f - row_number() OVER (PARTITION BY session_id, window_idx ORDER BY f) g FROM sh),
sr AS (SELECT session_id, window_idx, count(*) / {FS}::DOUBLE d FROM si GROUP BY session_id, window_idx, g HAVING count(*) / {FS} >= 1.0)
SELECT session_id, window_idx, any_value(s) t_start, any_value(e) t_end, count(d) n_episodes, round(coalesce(sum(d), 0), 6) dur_total_s, round(coalesce(sum(d), 0) / any_value(e - s), 6) shared_ratio FROM w LEFT JOIN sr USING (session_id, window_idx) GROUP BY ALL""")
def _(spark, sf):
    s = t.samples(spark, sf)
    o = gz.shared_object_windows(fixes(spark, sf), spans(s), 300.0, 200.0, FS, 1.0)
    return rnd(o.select("session_id", "window_idx", "t_start", "t_end", "n_episodes", "dur_total_s", "shared_ratio"), "dur_total_s", "shared_ratio")


@query("g10_shared_object_pairs", t.with_(t.SAMP, FIX) + f""", rp AS (SELECT a.session_id, a.role role_a, b.role role_b FROM (SELECT DISTINCT session_id, role FROM fix) a JOIN (SELECT DISTINCT session_id, role FROM fix) b ON a.session_id = b.session_id AND a.role < b.role),
w AS (SELECT rp.*, i window_idx, i * 600.0::DOUBLE s, least(i * 600.0 + 600.0, {T1})::DOUBLE e FROM rp, range(0, 5) r(i)),
gf AS (SELECT session_id, role_a, role_b, window_idx, role, object, unnest(range(ceil((greatest(onset, s) - s) * {FS})::BIGINT, ceil((least("offset", e) - s) * {FS})::BIGINT)) f FROM fix JOIN w USING (session_id) WHERE role IN (role_a, role_b) AND onset < e AND "offset" > s),
sh AS (SELECT DISTINCT session_id, role_a, role_b, window_idx, f FROM (SELECT session_id, role_a, role_b, window_idx, object, f FROM gf GROUP BY ALL HAVING count(*) >= 2)),
si AS (SELECT *, f - row_number() OVER (PARTITION BY session_id, role_a, role_b, window_idx ORDER BY f) g FROM sh),
sr AS (SELECT session_id, role_a, role_b, window_idx, count(*) / {FS}::DOUBLE d FROM si GROUP BY session_id, role_a, role_b, window_idx, g HAVING count(*) / {FS} >= 1.0)
SELECT session_id, role_a, role_b, window_idx, any_value(s) t_start, any_value(e) t_end, count(d) n_episodes, round(coalesce(sum(d), 0), 6) dur_total_s, round(coalesce(sum(d), 0) / any_value(e - s), 6) shared_ratio FROM w LEFT JOIN sr USING (session_id, role_a, role_b, window_idx) GROUP BY ALL""")
def _(spark, sf):
    s = t.samples(spark, sf)
    o = gz.shared_object_windows(fixes(spark, sf), spans(s), 600.0, 600.0, FS, 1.0, pairs=True)
    return rnd(o.select("session_id", "role_a", "role_b", "window_idx", "t_start", "t_end", "n_episodes", "dur_total_s", "shared_ratio"), "dur_total_s", "shared_ratio")


@query("g11_object_entropy", t.with_(t.SAMP, FIX) + """, d AS (SELECT session_id, role, object, sum("offset" - onset) d FROM fix GROUP BY ALL), p AS (SELECT *, d / sum(d) OVER (PARTITION BY session_id, role) p, count(*) OVER (PARTITION BY session_id, role) k FROM d)
SELECT session_id, role, round(CASE WHEN any_value(k) > 1 THEN -sum(p * ln(p)) / ln(any_value(k)) ELSE 0 END, 6) gaze_entropy, any_value(k) n_objects_fixated FROM p GROUP BY ALL""")
def _(spark, sf):
    return rnd(gz.object_entropy(fixes(spark, sf)), "gaze_entropy")


# Objects named after participants: the next one for views, the one after for clicks.
NAMED = """nfix AS (SELECT session_id, role, CASE object WHEN 'view' THEN 'Avatar_R' || ((substr(role, 2)::INT + 1) % 3) WHEN 'click' THEN 'Avatar_R' || ((substr(role, 2)::INT + 2) % 3) ELSE object END AS object, onset, "offset" FROM fix),
tfix AS (SELECT n.*, (SELECT CASE WHEN count(*) = 1 THEN min(r) END FROM (SELECT unnest(['r0', 'r1', 'r2']) r) WHERE contains(upper(object), upper(r))) target FROM nfix n)"""


def named(spark, sf):
    f = fixes(spark, sf)
    i = F.substring("role", 2, 1).cast("int")
    av = lambda k: F.concat(F.lit("Avatar_R"), ((i + k) % 3).cast("string"))
    f = f.withColumn("object", F.when(F.col("object") == "view", av(1)).when(F.col("object") == "click", av(2)).otherwise(F.col("object")))
    return gz.infer_target(f, t.samples(spark, sf).select("session_id", "role"))


@query("g12_infer_target", t.with_(t.SAMP, FIX, NAMED) + "SELECT * FROM tfix")
def _(spark, sf):
    return named(spark, sf)


@query("g13_mutual_gaze_object", t.with_(t.SAMP, FIX, NAMED) + f""", g AS (SELECT DISTINCT session_id, least(role, target) role_a, greatest(role, target) role_b, role < target fw,
 unnest(range(greatest(ceil(onset * {FS})::BIGINT - 2, 0), least(ceil("offset" * {FS})::BIGINT + 2, {int(T1*FS)}))) f FROM tfix WHERE target IS NOT NULL AND target <> role AND ceil("offset" * {FS}) > ceil(onset * {FS})),
m AS (SELECT session_id, role_a, role_b, f FROM g GROUP BY ALL HAVING count(*) = 2), i AS (SELECT *, f - row_number() OVER (PARTITION BY session_id, role_a, role_b ORDER BY f) g FROM m),
r AS (SELECT session_id, role_a, role_b, count(*) / {FS}::DOUBLE d FROM i GROUP BY session_id, role_a, role_b, g HAVING count(*) / {FS} >= 1.0),
p AS (SELECT DISTINCT a.session_id, a.role role_a, b.role role_b FROM fix a JOIN fix b ON a.session_id = b.session_id AND a.role < b.role)
SELECT session_id, role_a, role_b, round(coalesce(sum(d), 0) / {T1}, 6) ratio, count(d) n_episodes, round(coalesce(sum(d), 0), 6) dur_total_s, round(avg(d), 6) dur_mean_s FROM p LEFT JOIN r USING (session_id, role_a, role_b) GROUP BY ALL""")
def _(spark, sf):
    s = t.samples(spark, sf)
    return rnd(gz.mutual_gaze_object(cut(named(spark, sf)), spans(s), FS, 1.0, 1.0), "ratio", "dur_total_s", "dur_mean_s")


TURNS = "tu AS (SELECT session_id, role, start_s, end_s FROM seg WHERE end_s - start_s >= 1)"


@query("g14_gaze_to_speaker", t.with_(t.SAMP, FIX, NAMED, t.SEG, TURNS) + f""", sp AS (SELECT session_id, f, max_by(role, (start_s, end_s, role)) speaker FROM (SELECT *, unnest(range(ceil(start_s * {FS})::BIGINT, ceil(least(end_s, {T1}) * {FS})::BIGINT)) f FROM tu) GROUP BY ALL),
tg AS (SELECT session_id, role, f, max_by(target, (onset, "offset", target)) target FROM (SELECT *, unnest(range(ceil(onset * {FS})::BIGINT, ceil(least("offset", {T1}) * {FS})::BIGINT)) f FROM tfix WHERE target IS NOT NULL) GROUP BY ALL)
SELECT session_id, round(count(*) FILTER (speaker IS NOT NULL) / (any_value(l) * {int(T1*FS)})::DOUBLE, 9) gaze_to_speaker_ratio FROM (SELECT session_id, count(DISTINCT role) l FROM fix GROUP BY ALL) LEFT JOIN (SELECT session_id, speaker FROM tg JOIN sp USING (session_id, f) WHERE speaker <> role AND target = speaker) USING (session_id) GROUP BY ALL""")
def _(spark, sf):
    s = t.samples(spark, sf)
    turns = t.segments(spark, sf).where("end_s - start_s >= 1")
    return rnd(gz.gaze_to_speaker(cut(named(spark, sf)), turns, spans(s), FS), "gaze_to_speaker_ratio", d=9)


@query("g15_gaze_before_speech", t.with_(t.SAMP, FIX, NAMED, t.SEG, TURNS) + """SELECT session_id, count(*) n_onsets, avg(CASE WHEN EXISTS (SELECT 1 FROM tfix WHERE tfix.session_id = tu.session_id AND tfix.role = tu.role AND target IS NOT NULL AND target <> tfix.role AND onset < start_s AND "offset" > start_s - 5.0) THEN 1.0 ELSE 0.0 END::DOUBLE) p_gaze_before_speech FROM tu GROUP BY ALL""")
def _(spark, sf):
    turns = t.segments(spark, sf).where("end_s - start_s >= 1")
    return gz.gaze_before_speech(cut(named(spark, sf)), turns, 5.0)


ANG = """dy AS (SELECT a.session_id, a.frame_idx, a.role role_a, b.role role_b, degrees(acos(greatest(-1, least(1, a.dx*b.dx + a.dy*b.dy + a.dz*b.dz)))) ang,
 a.dx adx, a.dy ady, a.dz adz, b.dx bdx, b.dy bdy, b.dz bdz, b.px - a.px vx, b.py - a.py vy, b.pz - a.pz vz,
 sqrt((b.px-a.px)*(b.px-a.px)+(b.py-a.py)*(b.py-a.py)+(b.pz-a.pz)*(b.pz-a.pz)) nv FROM dirs a JOIN dirs b ON a.session_id = b.session_id AND a.frame_idx = b.frame_idx AND a.role < b.role)"""


@query("j11_dyad_angles", t.with_(t.DIRS, ANG) + "SELECT session_id, frame_idx, role_a, role_b, round(ang, 6) angle_deg FROM dy")
def _(spark, sf):
    return rnd(gz.dyad_angles(t.directions(spark, sf)), "angle_deg")


RUNS = """i AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY session_id ORDER BY frame_idx) g FROM c), r AS (SELECT session_id, count(*) / 10.0::DOUBLE d FROM i GROUP BY session_id, g HAVING count(*) >= 2)"""


@query("g16_convergence", t.with_(t.DIRS, ANG) + ", c AS (SELECT DISTINCT session_id, frame_idx FROM dy WHERE ang <= 40), " + RUNS + """
SELECT session_id, coalesce(n, 0) gaze_convergence_n_episodes, round(coalesce(td, 0), 6) gaze_convergence_dur_total_s, round(m, 6) gaze_convergence_dur_mean_s, round(a, 6) gaze_convergence_mean_angle_deg, round(coalesce(td, 0) * 10 / v, 6) gaze_convergence_ratio
FROM (SELECT session_id, count(*) v FROM dirs WHERE role = 'r0' GROUP BY ALL) LEFT JOIN (SELECT session_id, count(*) n, sum(d) td, avg(d) m FROM r GROUP BY ALL) USING (session_id) LEFT JOIN (SELECT session_id, avg(ang) a FROM dy WHERE ang <= 40 GROUP BY ALL) USING (session_id)""")
def _(spark, sf):
    return rnd(gz.convergence(t.directions(spark, sf), 10.0, 40.0, 0.2), "gaze_convergence_dur_total_s", "gaze_convergence_dur_mean_s", "gaze_convergence_mean_angle_deg", "gaze_convergence_ratio")


@query("g17_mutual_gaze_pairs", t.with_(t.DIRS, ANG) + """, m AS (SELECT *, degrees(acos(greatest(-1, least(1, (adx*vx+ady*vy+adz*vz)/nv)))) ab, degrees(acos(greatest(-1, least(1, -(bdx*vx+bdy*vy+bdz*vz)/nv)))) ba FROM dy),
i AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY session_id, role_a, role_b ORDER BY frame_idx) g FROM m WHERE ab <= 80 AND ba <= 80),
r AS (SELECT session_id, role_a, role_b, count(*) / 10.0::DOUBLE d FROM i GROUP BY session_id, role_a, role_b, g HAVING count(*) >= 2)
SELECT session_id, role_a, role_b, coalesce(c, 0) n_episodes, round(coalesce(td, 0), 6) dur_total_s, round(md, 6) dur_mean_s, round(coalesce(td, 0) * 10 / n, 6) mutual_gaze_ratio FROM (SELECT session_id, role_a, role_b, count(*) n FROM m GROUP BY ALL)
LEFT JOIN (SELECT session_id, role_a, role_b, count(*) c, sum(d) td, avg(d) md FROM r GROUP BY ALL) USING (session_id, role_a, role_b)""")
def _(spark, sf):
    p, _s = gz.mutual_directional(t.directions(spark, sf), 10.0, 80.0, 0.2)
    return rnd(p, "dur_total_s", "dur_mean_s", "mutual_gaze_ratio")


@query("g17_mutual_gaze_session")
def _(spark, sf):
    return gz.mutual_directional(t.directions(spark, sf), 10.0, 80.0, 0.2)[1]


@query("g18_direction_entropy", t.with_(t.DIRS) + """, b AS (SELECT session_id, role, least(floor(((degrees(atan2(dx, dz)) + 360) % 360) / 22.5), 15) b, count(*) n FROM dirs GROUP BY ALL),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY session_id, role) p, count(*) OVER (PARTITION BY session_id, role) k, sum(n) OVER (PARTITION BY session_id, role) tn FROM b)
SELECT session_id, role, round(CASE WHEN any_value(tn) < 10 THEN NULL WHEN any_value(k) > 1 THEN -sum(p * ln(p)) / ln(any_value(k)) ELSE 0 END, 6) direction_entropy FROM p GROUP BY ALL""")
def _(spark, sf):
    return rnd(gz.direction_entropy(t.directions(spark, sf)), "direction_entropy")


@query("g19_stable_directions", t.with_(t.DIRS) + """, w AS (SELECT d.session_id, d.role, s.i, d.dx, d.dy, d.dz FROM dirs d, range(0, 50) s(i) WHERE d.frame_idx BETWEEN s.i AND s.i + 2),
l AS (SELECT session_id, role, max(frame_idx) l FROM dirs GROUP BY ALL),
m AS (SELECT session_id, role, i, avg(dx) mx, avg(dy) my, avg(dz) mz, count(*) n FROM w GROUP BY ALL),
a AS (SELECT w.session_id, w.role, w.i, max(degrees(acos(greatest(-1, least(1, (dx*mx+dy*my+dz*mz)/sqrt(mx*mx+my*my+mz*mz)))))) a, any_value(n) n FROM w JOIN m USING (session_id, role, i) GROUP BY ALL),
f AS (SELECT DISTINCT session_id, role, i + k f FROM a JOIN l USING (session_id, role), range(0, 3) r(k) WHERE i <= l - 2 AND n >= 2 AND a <= 60),
g AS (SELECT *, f - row_number() OVER (PARTITION BY session_id, role ORDER BY f) g FROM f)
SELECT session_id, role, min(f) / 10.0::DOUBLE onset, (max(f) + 1) / 10.0::DOUBLE AS "offset", count(*) / 10.0::DOUBLE duration_s FROM g GROUP BY session_id, role, g""")
def _(spark, sf):
    return gz.stable_directions(t.directions(spark, sf), 10.0, 0.3, 60.0)


@query("g20_gaze_session_table")
def _(spark, sf):
    return gz.gaze_tables(t.directions(spark, sf), 10.0, 40.0, 80.0)["session"]


@query("g20_gaze_participant_table")
def _(spark, sf):
    return gz.gaze_tables(t.directions(spark, sf), 10.0, 40.0, 80.0)["participant"]


@query("g20_gaze_windows", t.with_(t.DIRS, ANG) + """, c AS (SELECT DISTINCT session_id, frame_idx // 10 w, frame_idx FROM dy WHERE ang <= 40), i AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY session_id, w ORDER BY frame_idx) g FROM c),
r AS (SELECT session_id, w, count(*) / 10.0::DOUBLE d FROM i GROUP BY session_id, w, g)
SELECT session_id, w window_idx, n_valid, coalesce(n, 0) gaze_convergence_n_episodes, round(coalesce(td, 0) * 10 / n_valid, 6) gaze_convergence_ratio FROM (SELECT session_id, frame_idx // 10 w, count(*) n_valid FROM dirs WHERE role = 'r0' GROUP BY ALL) LEFT JOIN (SELECT session_id, w, count(*) n, sum(d) td FROM r GROUP BY ALL) USING (session_id, w)""".replace("n_valid, coalesce", "coalesce", 1))
def _(spark, sf):
    w = gz.gaze_windows(t.directions(spark, sf), 10, 10.0, 40.0)
    return rnd(w.select("session_id", "window_idx", "gaze_convergence_n_episodes", "gaze_convergence_ratio"), "gaze_convergence_ratio")


# Gaze rays and head positions: samples carry a slowly moving origin and a hit point.
def eye(spark, sf):
    s = t.samples(spark, sf)
    return s.select("session_id", "role", "t", (F.col("value") / 100).alias("ox"), F.lit(1.6).alias("oy"), F.lit(0.5).alias("oz"),
                    (F.col("value") / 20).alias("hx"), F.lit(1.0).alias("hy"), (F.col("value") / 50 + 1).alias("hz"))


def head(spark, sf):
    s = t.samples(spark, sf).where("state")
    return s.select("session_id", "role", "t", (F.col("value") / 90).alias("px"), F.lit(1.6).alias("py"), (F.col("value") / 400).alias("pz"))


EYE = "eye AS (SELECT session_id, role, t, value / 100 ox, 1.6::DOUBLE oy, 0.5::DOUBLE oz, value / 20 hx, 1.0::DOUBLE hy, value / 50 + 1 hz FROM samp), hd AS (SELECT session_id, role, t, value / 90 px, 1.6::DOUBLE py, value / 400 pz FROM samp WHERE state)"
RAY = """near AS (SELECT e.*, b.t bt, f.t ft, b.px bx, f.px fx, b.pz bz, f.pz fz FROM eye e ASOF LEFT JOIN hd b ON e.session_id = b.session_id AND e.role = b.role AND e.t >= b.t ASOF LEFT JOIN hd f ON e.session_id = f.session_id AND e.role = f.role AND e.t <= f.t),
ray AS (SELECT session_id, role, t, CASE WHEN bt = t THEN bx ELSE bx + (fx - bx) * ((t - bt) / (ft - bt)) END true_px, CASE WHEN bt = t THEN bz ELSE bz + (fz - bz) * ((t - bt) / (ft - bt)) END true_pz,
 round(least(abs(t - bt), abs(ft - t)) * 1000, 2) sync_residual_ms, (hx - ox) / sqrt((hx-ox)*(hx-ox)+(hy-oy)*(hy-oy)+(hz-oz)*(hz-oz)) dx, ox, oz, CASE WHEN bt IS NULL OR ft IS NULL THEN 1 ELSE 0 END ext FROM near)"""
KR = ["session_id", "role"]


@query("g21_origin_frozen", t.with_(t.SAMP, EYE) + """SELECT session_id, role, count(*) n, round(max(ox) - min(ox), 6) origin_diag_m, round(sqrt(pow(max(hx)-min(hx), 2) + pow(max(hz)-min(hz), 2)), 6) hit_diag_m, max(ox) - min(ox) < 2 AND sqrt(pow(max(hx)-min(hx), 2) + pow(max(hz)-min(hz), 2)) > 2 frozen FROM eye GROUP BY ALL""")
def _(spark, sf):
    o = gz.origin_frozen(eye(spark, sf), KR, ["ox", "oy", "oz"], ["hx", "hy", "hz"])
    return rnd(o.select("session_id", "role", "n", "origin_diag_m", "hit_diag_m", "frozen"), "origin_diag_m", "hit_diag_m")


@query("g22_origin_offset", t.with_(t.SAMP, EYE, RAY) + """, q AS (SELECT e.session_id, e.role, b.t IS NULL OR (f.t IS NOT NULL AND f.t - e.t < e.t - b.t) fw, e.t, e.ox, e.oz, b.t bt, b.px bx, b.pz bz, f.t ft, f.px fx, f.pz fz FROM eye e ASOF LEFT JOIN hd b ON e.session_id = b.session_id AND e.role = b.role AND e.t >= b.t ASOF LEFT JOIN hd f ON e.session_id = f.session_id AND e.role = f.role AND e.t <= f.t),
o AS (SELECT session_id, role, abs(t - CASE WHEN fw THEN ft ELSE bt END) r, sqrt(pow(ox - CASE WHEN fw THEN fx ELSE bx END, 2) + pow(oz - CASE WHEN fw THEN fz ELSE bz END, 2)) o FROM q)
SELECT session_id, role, count(*) n_merged, round(max(o), 6) offset_max_m, round(quantile_cont(o, 0.25), 6) offset_p25_m, round(quantile_cont(o, 0.5), 6) offset_median_m, round(quantile_cont(o, 0.75), 6) offset_p75_m, round(quantile_cont(r * 1000, 0.5), 3) residual_median_ms, round(quantile_cont(r * 1000, 0.95), 3) residual_p95_ms,
 CASE WHEN quantile_cont(o, 0.5) > 0.5 THEN 'offset_bug' ELSE 'origin_ok' END verdict FROM o WHERE r <= 20 GROUP BY ALL""")
def _(spark, sf):
    o = gz.origin_offset(eye(spark, sf), head(spark, sf), KR, "t", ["ox", "oy", "oz"], ["px", "py", "pz"], C, 20.0)
    return rnd(rnd(o, "offset_max_m", "offset_p25_m", "offset_median_m", "offset_p75_m"), "residual_median_ms", "residual_p95_ms", d=3)


@query("g22_stream_inventory", t.with_(t.SAMP) + """, d AS (SELECT *, t - lag(t) OVER (PARTITION BY session_id, role ORDER BY t) d FROM samp)
SELECT session_id, role, count(*) n_rows, min(t) t_min, max(t) t_max, avg(CASE WHEN state THEN 1.0 ELSE 0.0 END::DOUBLE) missing_v, round(quantile_cont(d, 0.5), 9) dt_s FROM d GROUP BY ALL""")
def _(spark, sf):
    s = t.samples(spark, sf).withColumn("v", F.when(~F.col("state"), F.col("value")))
    return rnd(gz.stream_inventory(s, KR, "t", ["v"], C), "dt_s", d=9)


@query("g23_heading_check")
def _(spark, sf):
    g = eye(spark, sf)
    gaze = g.select("session_id", "role", "t", (F.col("hx") - F.col("ox")).alias("dx"), (F.col("hz") - F.col("oz")).alias("dz"))
    return gz.heading_check(head(spark, sf), gaze, KR, "t", C, 0.001, 20, 20.0)


@query("g24_reconstruct_rays", t.with_(t.SAMP, EYE, RAY) + """SELECT session_id, role, t, round(true_px, 6) true_px, round(true_pz, 6) true_pz, sync_residual_ms, round(dx, 6) dx FROM ray""")
def _(spark, sf):
    r = gz.reconstruct_rays(eye(spark, sf), head(spark, sf), KR, "t", C)
    return rnd(r.select("session_id", "role", "t", "true_px", "true_pz", "sync_residual_ms", "dx"), "true_px", "true_pz", "dx")


@query("g24_ray_summary", t.with_(t.SAMP, EYE, RAY) + """SELECT session_id, role, count(*) n_frames, sum(ext)::BIGINT n_extrap_frames, round(quantile_cont(sync_residual_ms, 0.5), 3) sync_residual_median_ms FROM ray GROUP BY ALL""")
def _(spark, sf):
    r = cut(gz.reconstruct_rays(eye(spark, sf), head(spark, sf), KR, "t", C))
    return rnd(gz.ray_summary(r, KR).select("session_id", "role", "n_frames", "n_extrap_frames", "sync_residual_median_ms"), "sync_residual_median_ms", d=3)


PLA = """pj AS (SELECT *, CASE WHEN sqrt(pow(px - lag(px) OVER w, 2) + pow(pz - lag(pz) OVER w, 2)) > 0.5 THEN 1 ELSE 0 END j FROM hd WINDOW w AS (PARTITION BY session_id, role ORDER BY t)),
pk AS (SELECT *, sum(j) OVER w::BIGINT plateau, max(CASE WHEN j = 1 THEN t END) OVER w since FROM pj WINDOW w AS (PARTITION BY session_id, role ORDER BY t ROWS UNBOUNDED PRECEDING)),
pl AS (SELECT session_id, role, plateau, min(t) FILTER (since IS NULL OR t >= since + 1) t_start, max(t) FILTER (since IS NULL OR t >= since + 1) t_end, round(avg(px) FILTER (since IS NULL OR t >= since + 1), 6) mean_x, round(avg(pz) FILTER (since IS NULL OR t >= since + 1), 6) mean_z,
 count(*) FILTER (since IS NULL OR t >= since + 1) n FROM pk GROUP BY ALL HAVING count(*) >= 4 AND max(t) - (min(t) + CASE WHEN plateau > 0 THEN 1 ELSE 0 END) >= 3 AND count(*) FILTER (since IS NULL OR t >= since + 1) >= 4)"""


@query("g25_plateaux", t.with_(t.SAMP, EYE, PLA) + "SELECT * FROM pl")
def _(spark, sf):
    return rnd(gz.plateaux(head(spark, sf), KR, "t", C), "mean_x", "mean_z")


def yaw_pairs(spark, sf):
    d = t.directions(spark, sf)
    return d.select("session_id", "role", F.floor(F.col("frame_idx") / 10).cast("long").alias("w"), "frame_idx", F.col("px").alias("ax"), F.col("pz").alias("az"), F.col("dx").alias("bx"), F.col("dz").alias("bz"))


YAW = """yp AS (SELECT session_id, role, frame_idx // 10 w, px ax, pz az, dx bx, dz bz FROM dirs),
ym AS (SELECT session_id, role, w, count(*) n, avg(ax) max_, avg(az) maz, avg(bx) mbx, avg(bz) mbz, atan2(covar_pop(ax, bz) - covar_pop(az, bx), covar_pop(ax, bx) + covar_pop(az, bz)) th FROM yp GROUP BY ALL HAVING sqrt((var_pop(ax) + var_pop(az)) / 2) >= 0.008 AND sqrt((var_pop(bx) + var_pop(bz)) / 2) >= 0.008),
yw AS (SELECT session_id, role, w, degrees(any_value(th)) theta_deg, avg(sqrt(pow(cos(th)*(ax-max_) - sin(th)*(az-maz) - (bx-mbx), 2) + pow(sin(th)*(ax-max_) + cos(th)*(az-maz) - (bz-mbz), 2))) resid_m, any_value(n) n FROM yp JOIN ym USING (session_id, role, w) GROUP BY ALL)"""


@query("g26_rigid_yaw", t.with_(t.DIRS, YAW) + "SELECT session_id, role, w, round(theta_deg, 6) theta_deg, round(resid_m, 6) resid_m, n FROM yw")
def _(spark, sf):
    return rnd(gz.rigid_yaw(yaw_pairs(spark, sf), ["session_id", "role", "w"]), "theta_deg", "resid_m")


def stability(spark, sf):
    y = cut(gz.rigid_yaw(yaw_pairs(spark, sf), ["session_id", "role", "w"]))
    return gz.yaw_stability(y, ["session_id", "role"], "w", max_std_deg=90.0, max_resid_m=2.0)


STAB = """f0 AS (SELECT *, CASE WHEN abs(((theta_deg - lag(theta_deg) OVER (PARTITION BY session_id, role ORDER BY w) + 540) % 360) - 180) > 90 THEN 1 ELSE 0 END fl FROM yw),
f1 AS (SELECT *, sum(fl) OVER (PARTITION BY session_id, role ORDER BY w)::BIGINT f FROM f0), an AS (SELECT session_id, role, arg_min(f, (resid_m, w)) fa FROM f1 GROUP BY ALL),
f2 AS (SELECT *, CASE WHEN abs(f - fa) % 2 = 1 THEN ((theta_deg + 180 + 180 + 360) % 360) - 180 ELSE theta_deg END th FROM f1 JOIN an USING (session_id, role)),
ys AS (SELECT session_id, role, count(*) n_subwins, degrees(atan2(avg(sin(radians(th))), avg(cos(radians(th))))) theta_deg, stddev_pop(th) intra_std_deg, avg(resid_m) resid_m FROM f2 GROUP BY ALL),
yz AS (SELECT *, CASE WHEN n_subwins < 2 THEN 'too_few_subwindows' WHEN intra_std_deg > 90 THEN 'ambiguity_unresolved' WHEN resid_m > 2 THEN 'high_residual' ELSE 'ok' END status FROM ys)"""


@query("g27_yaw_stability", t.with_(t.DIRS, YAW, STAB) + "SELECT session_id, role, n_subwins, round(theta_deg, 5) theta_deg, round(intra_std_deg, 5) intra_std_deg, round(resid_m, 6) resid_m, status FROM yz")
def _(spark, sf):
    return rnd(rnd(stability(spark, sf), "theta_deg", "intra_std_deg", d=5), "resid_m")


@query("g28_session_yaw", t.with_(t.DIRS, YAW, STAB) + """, g AS (SELECT session_id, count(*) n_plateaux_total, count(*) FILTER (status = 'ok') n_plateaux_valid, count(*) FILTER (status = 'high_residual') n_high_residual, count(*) FILTER (status = 'ambiguity_unresolved') n_ambiguity_unresolved,
 degrees(atan2(avg(sin(radians(theta_deg))) FILTER (status = 'ok'), avg(cos(radians(theta_deg))) FILTER (status = 'ok'))) m, stddev_pop(theta_deg) FILTER (status = 'ok') s FROM yz GROUP BY ALL)
SELECT session_id, n_plateaux_total, n_plateaux_valid, n_high_residual, n_ambiguity_unresolved, round(m, 5) theta_circ_mean_deg, round(s, 5) theta_std_deg, CASE WHEN n_plateaux_valid = 0 OR n_plateaux_valid / n_plateaux_total < 0.3 THEN 'undetermined' WHEN abs(m) < 5 AND s < 5 THEN 'pure_translation_confirmed' ELSE 'yaw_recovered' END direction_assumption FROM g""")
def _(spark, sf):
    return rnd(gz.session_yaw(stability(spark, sf), ["session_id"]), "theta_circ_mean_deg", "theta_std_deg", d=5)


@query("g29_apply_yaw", t.with_(t.DIRS, YAW) + """, pl AS (SELECT session_id, role, w * 10.0::DOUBLE t_start, w * 10.0::DOUBLE + 7 t_end, theta_deg FROM yw),
r AS (SELECT d.session_id, d.role, d.frame_idx::DOUBLE t, dx, dy, dz, cos(radians(theta_deg)) * dx - sin(radians(theta_deg)) * dz x, sin(radians(theta_deg)) * dx + cos(radians(theta_deg)) * dz z FROM dirs d JOIN pl ON d.session_id = pl.session_id AND d.role = pl.role AND d.frame_idx BETWEEN t_start AND t_end)
SELECT session_id, role, t, round(dx, 6) dx, round(dy, 6) dy, round(dz, 6) dz, round(x / sqrt(x*x+dy*dy+z*z), 6) corr_dx, round(dy / sqrt(x*x+dy*dy+z*z), 6) corr_dy, round(z / sqrt(x*x+dy*dy+z*z), 6) corr_dz FROM r""")
def _(spark, sf):
    d = t.directions(spark, sf).withColumn("t", F.col("frame_idx").cast("double"))
    y = cut(gz.rigid_yaw(yaw_pairs(spark, sf), ["session_id", "role", "w"]))
    p = y.select("session_id", "role", (F.col("w") * 10.0).alias("t_start"), (F.col("w") * 10.0 + 7).alias("t_end"), "theta_deg")
    o = gz.apply_yaw(d, p, ["session_id", "role"], "t", 32.0)
    return rnd(o, "dx", "dy", "dz", "corr_dx", "corr_dy", "corr_dz")


@query("m25_prefer_corrected_share", t.with_(t.SAMP) + "SELECT session_id, role, round(100 * avg(CASE WHEN state THEN 0.0 ELSE 1.0 END::DOUBLE), 6) pct_dir_valid FROM samp GROUP BY ALL")
def _(spark, sf):
    s = t.samples(spark, sf).withColumn("v", F.when(~F.col("state"), F.col("value")))
    return rnd(gz.valid_share(s, ["v"], KR), "pct_dir_valid")


# Face frames: embedding dimensions stand for action-unit columns.
AUS = ["InnerBrowRaiserL", "InnerBrowRaiserR", "BrowLowererL", "BrowLowererR", "CheekRaiser", "LipCornerPullerL", "LipCornerPullerR", "LipCornerDepressorL", "LipCornerDepressorR", "ChinRaiserT", "ChinRaiserB"]


def face(spark, sf):
    e = t.table(spark, sf, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / 150).cast("long").alias("session_id"), F.concat(F.lit("r"), F.col("vec_id") % 3).alias("role"),
        (F.floor((F.col("vec_id") % 150) / 3) / 10.0).alias("t"),
        *[F.col("embedding")[i + 6].cast("double").alias(c) for i, c in enumerate(AUS)],
    )


_au = lambda i: f"embedding[{i + 7}]::DOUBLE"
FACE = f"""fa AS (SELECT vec_id // 150 session_id, 'r' || (vec_id % 3) AS role, ((vec_id % 150) // 3) / 10.0::DOUBLE t, ({_au(0)} + {_au(1)}) / 2 AU1, ({_au(2)} + {_au(3)}) / 2 AU4, {_au(4)} AU6, ({_au(5)} + {_au(6)}) / 2 AU12, ({_au(7)} + {_au(8)}) / 2 AU15, ({_au(9)} + {_au(10)}) / 2 AU17 FROM embeddings),
fb AS (SELECT *, (greatest(AU6, 0) + greatest(AU12, 0)) / 2 joy, (greatest(AU1, 0) + greatest(AU4, 0) + greatest(AU15, 0)) / 3 sad FROM fa),
fq AS (SELECT session_id, role, quantile_cont(joy, 0.75) tj, quantile_cont(sad, 0.75) ts, quantile_cont(AU6, 0.75) t6, quantile_cont(AU12, 0.75) t12 FROM fb GROUP BY ALL),
fs AS (SELECT fb.*, (joy > tj)::INT::DOUBLE ja, (sad > ts)::INT::DOUBLE sa, (AU6 > t6)::INT::DOUBLE a6, (AU12 > t12)::INT::DOUBLE a12 FROM fb JOIN fq USING (session_id, role))"""


def face_spans(df):
    return df.groupBy("session_id").agg(F.lit(0.0).alias("t0"), F.max("t").alias("t1"))


@query("g30_au_intensities", t.with_(FACE) + "SELECT session_id, role, t, round(AU1, 6) AS AU1, round(AU6, 6) AS AU6, round(AU17, 6) AS AU17, round(joy, 6) joy_intensity, round(sad, 6) sad_intensity FROM fb")
def _(spark, sf):
    c = ["AU1", "AU6", "AU17", "joy_intensity", "sad_intensity"]
    return rnd(fc.intensities(face(spark, sf)).select("session_id", "role", "t", *c), *c)


for _mode, _sql in {
    "absolute": "0.1::DOUBLE", "quantile": "round(quantile_cont(v, 0.75), 6)", "zscore": "round(avg(v) + 1.5 * stddev_samp(v), 6)",
}.items():
    @query(f"g31_threshold_{_mode}", t.with_(FACE) + f"SELECT session_id, role, feature, {_sql} thr FROM (SELECT session_id, role, 'joy_intensity' feature, joy v FROM fb UNION ALL SELECT session_id, role, 'AU6', AU6 FROM fb) GROUP BY ALL")
    def _(spark, sf, mode=_mode):
        return rnd(fc.thresholds(fc.intensities(face(spark, sf)), ["joy_intensity", "AU6"], mode, 0.1, 0.75, 1.5), "thr")


@query("g32_binary_states", t.with_(FACE) + "SELECT session_id, role, t, ja joy_active, sa sad_active, a6 au6_active, a12 au12_active, a6 * a12 au6_au12_coactive FROM fs")
def _(spark, sf):
    return fc.binary_states(cut(fc.intensities(face(spark, sf)))).select("session_id", "role", "t", "joy_active", "sad_active", "au6_active", "au12_active", "au6_au12_coactive")


WIN = """sp AS (SELECT session_id, max(t) t1 FROM fa GROUP BY ALL), wn AS (SELECT session_id, t1, i window_idx, i * 0.5 s, least(i * 0.5 + 1.0, t1) e FROM sp, range(0, 100) r(i) WHERE i < ceil(t1 / 0.5)),
wd AS (SELECT wn.session_id, r.role, window_idx, any_value(s)::DOUBLE t_start, any_value(e)::DOUBLE t_end, avg(joy) joy_mean, avg(sad) sad_mean, count(joy) k FROM wn JOIN (SELECT DISTINCT session_id, role FROM fa) r USING (session_id) LEFT JOIN fs ON fs.session_id = wn.session_id AND fs.role = r.role AND fs.t >= s AND fs.t < e GROUP BY ALL)"""


def windows(spark, sf):
    f = cut(fc.intensities(face(spark, sf)))
    return fc.window_descriptors(f, face_spans(f), "t", 1.0, 0.5, {"joy_mean": "joy_intensity", "sad_mean": "sad_intensity"})


@query("g33_window_descriptors", t.with_(FACE, WIN) + "SELECT session_id, role, window_idx, t_start, t_end, round(joy_mean, 6) joy_mean, round(sad_mean, 6) sad_mean, CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END::DOUBLE success_ok FROM wd")
def _(spark, sf):
    return rnd(windows(spark, sf), "joy_mean", "sad_mean")


@query("g34_window_synchrony", t.with_(FACE, WIN) + """, l AS (SELECT session_id, role, window_idx, 'joy_mean' feature, joy_mean v FROM wd UNION ALL SELECT session_id, role, window_idx, 'sad_mean', sad_mean FROM wd)
SELECT a.session_id, a.role role_a, b.role role_b, a.feature, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) n, round(corr(a.v, b.v), 6) r FROM l a JOIN l b ON a.session_id = b.session_id AND a.window_idx = b.window_idx AND a.feature = b.feature AND a.role < b.role GROUP BY ALL""")
def _(spark, sf):
    return rnd(fc.window_synchrony(cut(windows(spark, sf)), ["joy_mean", "sad_mean"]), "r")


@query("g35_windowed_summary", t.with_(FACE, WIN) + "SELECT session_id, role, 'joy_mean' feature, round(avg(joy_mean), 6) mean, round(quantile_cont(joy_mean, 0.5), 6) median, count(joy_mean) / count(*)::DOUBLE valid_ratio FROM wd GROUP BY ALL")
def _(spark, sf):
    return rnd(fc.windowed_summary(cut(windows(spark, sf)), ["joy_mean"]), "mean", "median")


RAS = """gr AS (SELECT sp.session_id, r.role, i f, i / 10.0::DOUBLE t FROM sp JOIN (SELECT DISTINCT session_id, role FROM fa) r USING (session_id), range(0, 60) q(i) WHERE i <= floor(t1 * 10.0)),
ra AS (SELECT gr.session_id, gr.role, gr.f, coalesce(fs.ja, 0) x FROM gr ASOF LEFT JOIN fs ON gr.session_id = fs.session_id AND gr.role = fs.role AND gr.t >= fs.t)"""


def rast(spark, sf):
    f = fc.binary_states(cut(fc.intensities(face(spark, sf))))
    return cut(fc.raster(f, face_spans(f), "t", "joy_active", 10.0, 2.0))


@query("g36_jaccard_overlap", t.with_(FACE, WIN, RAS) + """, p AS (SELECT a.session_id, a.role role_a, b.role role_b, a.f, a.x ax, b.x bx FROM ra a JOIN ra b ON a.session_id = b.session_id AND a.f = b.f AND a.role < b.role),
i AS (SELECT *, f - row_number() OVER (PARTITION BY session_id, role_a, role_b ORDER BY f) g FROM p WHERE ax = 1 AND bx = 1)
SELECT session_id, role_a, role_b, round(sum(CASE WHEN ax = 1 AND bx = 1 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN ax = 1 OR bx = 1 THEN 1 ELSE 0 END), 0)::DOUBLE, 6) jaccard, coalesce((SELECT count(DISTINCT g) FROM i WHERE i.session_id = p.session_id AND i.role_a = p.role_a AND i.role_b = p.role_b), 0) n_sync_ep FROM p GROUP BY ALL""")
def _(spark, sf):
    return rnd(fc.pair_overlap(rast(spark, sf), 10.0, 0.1), "jaccard")


@query("g36_all_active", t.with_(FACE, WIN, RAS) + """, m AS (SELECT session_id, f FROM ra GROUP BY ALL HAVING min(x) = 1), i AS (SELECT *, f - row_number() OVER (PARTITION BY session_id ORDER BY f) g FROM m), r AS (SELECT session_id, count(*) / 10.0::DOUBLE d FROM i GROUP BY session_id, g)
SELECT session_id, count(*) tri_n_ep, round(sum(d), 6) tri_tot_dur_s FROM r GROUP BY ALL""")
def _(spark, sf):
    return rnd(fc.all_active(rast(spark, sf), 10.0, 0.1), "tri_tot_dur_s")


@query("g37_face_session_table")
def _(spark, sf):
    f = face(spark, sf)
    return fc.face_session_table(f, face_spans(f), "t", 10.0, 2.0, 1.0, 0.5)


# Positions per participant and window of 300 s.
PW = f"""w AS (SELECT DISTINCT session_id, i window_idx, i * 300.0::DOUBLE t_start, least(i * 300.0 + 300, {T1})::DOUBLE t_end FROM samp, range(0, 9) r(i))"""


def wins(df):
    return ep.sliding_windows(spans(df), 300.0, 300.0)


@query("g38_proximity", t.with_(t.SAMP, EYE) + f""", g AS (SELECT DISTINCT session_id, role, i f, i / 0.05 t FROM hd, range(0, {int(T1*0.05)}) r(i)),
n AS (SELECT g.session_id, g.role, g.f, g.t, b.t bt, f.t ft, b.px bx, b.pz bz, f.px fx, f.pz fz, b.t IS NULL OR (f.t IS NOT NULL AND f.t - g.t < g.t - b.t) fw FROM g ASOF LEFT JOIN hd b ON g.session_id = b.session_id AND g.role = b.role AND g.t >= b.t ASOF LEFT JOIN hd f ON g.session_id = f.session_id AND g.role = f.role AND g.t <= f.t),
m AS (SELECT session_id, role, f, CASE WHEN fw THEN fx ELSE bx END x, CASE WHEN fw THEN fz ELSE bz END z FROM n WHERE abs(CASE WHEN fw THEN ft ELSE bt END - t) <= 20)
SELECT a.session_id, a.role role_a, b.role role_b, round(avg(sqrt(pow(a.x - b.x, 2) + pow(a.z - b.z, 2))), 6) distance_m_raw, round(CASE WHEN distance_m_raw0 <= 0.8 THEN distance_m_raw0 ELSE 0.8 + (distance_m_raw0 - 0.8) * 0.85 END, 6) distance_m_display FROM (SELECT a.session_id, a.role, b.role r2, avg(sqrt(pow(a.x - b.x, 2) + pow(a.z - b.z, 2))) distance_m_raw0 FROM m a JOIN m b ON a.session_id = b.session_id AND a.f = b.f AND a.role < b.role GROUP BY ALL)""".replace("SELECT a.session_id, a.role role_a, b.role role_b, round(avg(sqrt(pow(a.x - b.x, 2) + pow(a.z - b.z, 2))), 6)", "SELECT session_id, role role_a, r2 role_b, round(distance_m_raw0, 6)"))
def _(spark, sf):
    h = head(spark, sf)
    return rnd(po.proximity(h, spans(h), 0.05, C), "distance_m_raw", "distance_m_display")


@query("g39_peer_gaze_flags", t.with_(t.SAMP, EYE) + """, p AS (SELECT e.session_id, e.role, r.role target, e.t, e.hx, e.hy, e.hz FROM eye e JOIN (SELECT DISTINCT session_id, role FROM hd) r ON e.session_id = r.session_id AND e.role <> r.role),
n AS (SELECT p.*, b.t bt, f.t ft, b.px bx, b.py bpy, b.pz bz, f.px fx, f.py fy, f.pz fz, b.t IS NULL OR (f.t IS NOT NULL AND f.t - p.t < p.t - b.t) fw FROM p ASOF LEFT JOIN hd b ON p.session_id = b.session_id AND p.target = b.role AND p.t >= b.t ASOF LEFT JOIN hd f ON p.session_id = f.session_id AND p.target = f.role AND p.t <= f.t)
SELECT session_id, role, target, t, coalesce(abs(CASE WHEN fw THEN ft ELSE bt END - t) <= 20 AND sqrt(pow(hx - CASE WHEN fw THEN fx ELSE bx END, 2) + pow(hy - CASE WHEN fw THEN fy ELSE bpy END, 2) + pow(hz - CASE WHEN fw THEN fz ELSE bz END, 2)) <= 2.0, false) state FROM n""")
def _(spark, sf):
    return po.peer_gaze(eye(spark, sf), head(spark, sf), C, 2.0, 20.0)


@query("g40_task_focus", t.with_(t.SAMP, FIX, PW) + """, x AS (SELECT session_id, window_idx, role, sum(least("offset", t_end) - greatest(onset, t_start)) d, count(*) n FROM fix JOIN w USING (session_id) WHERE onset < t_end AND "offset" > t_start GROUP BY ALL)
SELECT session_id, window_idx, role, round(coalesce(d, 0) / (t_end - t_start), 6) task_focus_ratio, coalesce(n, 0) task_fixation_count FROM w JOIN (SELECT DISTINCT session_id, role FROM fix) USING (session_id) LEFT JOIN x USING (session_id, window_idx, role)""")
def _(spark, sf):
    f = cut(fixes(spark, sf))
    return rnd(po.task_focus(f, wins(f)), "task_focus_ratio")


EQ = """ws AS (SELECT w.session_id, window_idx, t_start, t_end, r.role, coalesce(d, 0) d FROM w JOIN (SELECT DISTINCT session_id, role FROM seg) r USING (session_id) LEFT JOIN (SELECT session_id, window_idx, role, sum(least(end_s, t_end) - greatest(start_s, t_start)) d FROM seg JOIN w USING (session_id) WHERE start_s < t_end AND end_s > t_start GROUP BY ALL) USING (session_id, window_idx, role))"""


@query("g41_speech_equality", t.with_(t.SAMP, t.SEG, PW, EQ) + """SELECT a.session_id, a.window_idx, a.role role_a, b.role role_b, a.d + b.d >= 20 AND least(a.d, b.d) >= 5 speech_valid, round(CASE WHEN a.d + b.d >= 20 AND least(a.d, b.d) >= 5 THEN 1 - abs(a.d - b.d) / (a.d + b.d) END, 6) speech_equality
FROM ws a JOIN ws b ON a.session_id = b.session_id AND a.window_idx = b.window_idx AND a.role < b.role""")
def _(spark, sf):
    s = t.segments(spark, sf)
    return rnd(po.speech_equality(po.window_speech(s, wins(s)), 20.0, 5.0), "speech_equality")


# Face samples lie on the grid of ten frames a second; a window has twenty.
SYNC = """sp AS (SELECT session_id, max(t) t1 FROM fa GROUP BY ALL), fq2 AS (SELECT session_id, role, round(t * 10)::BIGINT f, joy, sad FROM fb JOIN sp USING (session_id) WHERE round(t * 10) < ceil(t1 * 10.0)),
fp AS (SELECT a.session_id, a.f // 20 window_idx, a.role role_a, b.role role_b, unnest(['joy', 'sad']) k, unnest([a.joy, a.sad]) x, unnest([b.joy, b.sad]) y FROM fq2 a JOIN fq2 b ON a.session_id = b.session_id AND a.f = b.f AND a.role < b.role),
fr AS (SELECT session_id, window_idx, role_a, role_b, k, CASE WHEN count(*) >= 3 AND stddev_pop(x) > 1e-12 * avg(abs(x)) AND stddev_pop(y) > 1e-12 * avg(abs(y)) THEN corr(x, y) END r FROM fp GROUP BY ALL)"""


@query("g42_face_sync_window", t.with_(FACE, SYNC) + "SELECT session_id, window_idx, role_a, role_b, round(avg((r + 1) / 2), 6) face_sync_score FROM fr GROUP BY ALL")
def _(spark, sf):
    f = cut(fc.intensities(face(spark, sf)))
    return rnd(po.face_sync(f, face_spans(f), 10.0, 2.0, 2.0), "face_sync_score")


# Flags of looking at a peer by window, runs of them closed by the next sample or a median step.
FLAGS = """p AS (SELECT e.session_id, e.role, r.role target, e.t, e.hx, e.hy, e.hz FROM eye e JOIN (SELECT DISTINCT session_id, role FROM hd) r ON e.session_id = r.session_id AND e.role <> r.role),
nf AS (SELECT p.*, b.t bt, f.t ft, b.px bx, b.py bpy, b.pz bz, f.px fx, f.py fy, f.pz fz, b.t IS NULL OR (f.t IS NOT NULL AND f.t - p.t < p.t - b.t) fw FROM p ASOF LEFT JOIN hd b ON p.session_id = b.session_id AND p.target = b.role AND p.t >= b.t ASOF LEFT JOIN hd f ON p.session_id = f.session_id AND p.target = f.role AND p.t <= f.t),
fl AS (SELECT session_id, role, target, t, coalesce(abs(CASE WHEN fw THEN ft ELSE bt END - t) <= 20 AND sqrt(pow(hx - CASE WHEN fw THEN fx ELSE bx END, 2) + pow(hy - CASE WHEN fw THEN fy ELSE bpy END, 2) + pow(hz - CASE WHEN fw THEN fz ELSE bz END, 2)) <= 2.0, false) state FROM nf),
fw AS (SELECT fl.*, window_idx, t_end - t_start wd, row_number() OVER k - row_number() OVER (PARTITION BY session_id, window_idx, role, target, state ORDER BY t) g, t - lag(t) OVER k st FROM fl JOIN w USING (session_id) WHERE t >= t_start AND t < t_end WINDOW k AS (PARTITION BY session_id, window_idx, role, target ORDER BY t)),
dt AS (SELECT session_id, window_idx, role, target, any_value(wd) wd, coalesce(quantile_cont(st, 0.5) FILTER (st > 0), 0.05) dt FROM fw GROUP BY ALL),
rn AS (SELECT session_id, window_idx, role, target, state, min(t) a, max(t) b FROM fw GROUP BY session_id, window_idx, role, target, state, g),
rl AS (SELECT *, lead(a) OVER (PARTITION BY session_id, window_idx, role, target ORDER BY a) nx FROM rn),
wg AS (SELECT session_id, window_idx, role, target, count(*) FILTER (state) n, coalesce(sum(coalesce(nx, b + dt) - a) FILTER (state), 0) / any_value(wd) ratio FROM rl JOIN dt USING (session_id, window_idx, role, target) GROUP BY ALL)"""
DIST = f"""gd AS (SELECT DISTINCT session_id, role, i f, i / 0.05 t FROM hd, range(0, {int(T1*0.05)}) r(i)),
nd AS (SELECT gd.session_id, gd.role, gd.f, gd.t, b.t bt, f.t ft, b.px bx, b.pz bz, f.px fx, f.pz fz, b.t IS NULL OR (f.t IS NOT NULL AND f.t - gd.t < gd.t - b.t) fw FROM gd ASOF LEFT JOIN hd b ON gd.session_id = b.session_id AND gd.role = b.role AND gd.t >= b.t ASOF LEFT JOIN hd f ON gd.session_id = f.session_id AND gd.role = f.role AND gd.t <= f.t),
md AS (SELECT session_id, role, f, CASE WHEN fw THEN fx ELSE bx END x, CASE WHEN fw THEN fz ELSE bz END z FROM nd WHERE abs(CASE WHEN fw THEN ft ELSE bt END - t) <= 20),
pd AS (SELECT a.session_id, a.f // 15 window_idx, a.role role_a, b.role role_b, avg(sqrt(pow(a.x - b.x, 2) + pow(a.z - b.z, 2))) dist FROM md a JOIN md b ON a.session_id = b.session_id AND a.f = b.f AND a.role < b.role GROUP BY ALL)"""


# Runs of flags over the whole session; close ones are merged, short ones dropped.
RUNS = """fs AS (SELECT *, row_number() OVER k - row_number() OVER (PARTITION BY session_id, role, target, state ORDER BY t) g, t - lag(t) OVER k st FROM fl WINDOW k AS (PARTITION BY session_id, role, target ORDER BY t)),
ds AS (SELECT session_id, role, target, coalesce(quantile_cont(st, 0.5) FILTER (st > 0), 0.05) dt FROM fs GROUP BY ALL), rs AS (SELECT session_id, role, target, state, min(t) a, max(t) b FROM fs GROUP BY session_id, role, target, state, g),
ls AS (SELECT *, lead(a) OVER (PARTITION BY session_id, role, target ORDER BY a) nx FROM rs), es AS (SELECT session_id, role, target, a, coalesce(nx, b + dt) e FROM ls JOIN ds USING (session_id, role, target) WHERE state),
gs AS (SELECT *, sum(CASE WHEN a - pe <= 0.10 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, role, target ORDER BY a) i FROM (SELECT *, lag(e) OVER (PARTITION BY session_id, role, target ORDER BY a) pe FROM es)),
ms AS (SELECT session_id, role, target, min(a) a, max(e) e FROM gs GROUP BY session_id, role, target, i)"""


@query("g39_peer_gaze_episodes", t.with_(t.SAMP, EYE, PW, FLAGS, RUNS) + "SELECT session_id, role, target, count(*) n_episodes, round(sum(e - a), 6) dur_total_s FROM ms WHERE e - a >= 0.15 GROUP BY ALL")
def _(spark, sf):
    return rnd(po.peer_gaze_episodes(cut(po.peer_gaze(eye(spark, sf), head(spark, sf), C, 2.0, 20.0)), C), "dur_total_s")


@query("g43_interaction_edges", t.with_(t.SAMP, t.SEG, EYE, PW, EQ, FLAGS, DIST) + """SELECT a.session_id, a.window_idx, a.t_start, a.t_end, a.role role_a, b.role role_b, a.d + b.d >= 20 AND least(a.d, b.d) >= 5 speech_valid, round(CASE WHEN a.d + b.d >= 20 AND least(a.d, b.d) >= 5 THEN 1 - abs(a.d - b.d) / (a.d + b.d) END, 6) speech_equality,
 round(CASE WHEN x.n IS NOT NULL OR y.n IS NOT NULL THEN coalesce(x.ratio, 0) END, 6) gaze_a_to_b_ratio, round(CASE WHEN x.n IS NOT NULL OR y.n IS NOT NULL THEN coalesce(y.ratio, 0) END, 6) gaze_b_to_a_ratio,
 CASE WHEN x.n IS NOT NULL OR y.n IS NOT NULL THEN coalesce(x.n, 0) END gaze_a_to_b_episodes, CASE WHEN x.n IS NOT NULL OR y.n IS NOT NULL THEN coalesce(y.n, 0) END gaze_b_to_a_episodes, round(dist, 6) distance_m_raw
FROM ws a JOIN ws b ON a.session_id = b.session_id AND a.window_idx = b.window_idx AND a.role < b.role
LEFT JOIN wg x ON x.session_id = a.session_id AND x.window_idx = a.window_idx AND x.role = a.role AND x.target = b.role LEFT JOIN wg y ON y.session_id = a.session_id AND y.window_idx = a.window_idx AND y.role = b.role AND y.target = a.role
LEFT JOIN pd ON pd.session_id = a.session_id AND pd.window_idx = a.window_idx AND pd.role_a = a.role AND pd.role_b = b.role""")
def _(spark, sf):
    s, h = t.segments(spark, sf), head(spark, sf)
    w = cut(wins(s))
    equality = po.speech_equality(cut(po.window_speech(s, w)), 20.0, 5.0)
    gaze = po.gaze_edges(po.window_gaze(po.peer_gaze(eye(spark, sf), h, C, 2.0, 20.0), w, C, 0.0, 0.0))
    distance = po.proximity(h, spans(h), 0.05, C, 300.0).drop("distance_m_display")
    return rnd(po.graph_edges(w, s, equality, gaze, distance), "speech_equality", "gaze_a_to_b_ratio", "gaze_b_to_a_ratio", "distance_m_raw")


WINDOWS = """x AS (SELECT session_id, window_idx, role, sum(least("offset", t_end) - greatest(onset, t_start)) f FROM fix JOIN w USING (session_id) WHERE onset < t_end AND "offset" > t_start GROUP BY ALL),
wt AS (SELECT session_id, window_idx, target role, sum(ratio) wa FROM wg GROUP BY ALL),
nn AS (SELECT ws.session_id, window_idx, t_start, t_end, role, d, coalesce(f, 0) / (t_end - t_start) tf, coalesce(wa, 0) wa FROM ws LEFT JOIN x USING (session_id, window_idx, role) LEFT JOIN wt USING (session_id, window_idx, role)),
mx AS (SELECT *, max(wa) OVER (PARTITION BY session_id, window_idx) wm FROM nn),
tp AS (SELECT session_id, window_idx, any_value(t_start) t_start, any_value(t_end) t_end, arg_min(role, row(-d, role)) talking_leader, CASE WHEN max(wm) > 0 THEN arg_min(role, row(-wa, role)) END watched_leader, arg_min(role, row(-tf, role)) task_focus_leader,
 avg(tf) task_focus_score, avg((tf + CASE WHEN wm > 0 THEN wa / greatest(wm, 1e-6) ELSE 0 END) / 2) engagement_score FROM mx GROUP BY ALL),
ba AS (SELECT a.session_id, a.window_idx, avg(CASE WHEN a.d + b.d >= 20 AND least(a.d, b.d) >= 5 THEN 1 - abs(a.d - b.d) / (a.d + b.d) END) speech_balance_score FROM ws a JOIN ws b ON a.session_id = b.session_id AND a.window_idx = b.window_idx AND a.role < b.role GROUP BY ALL),
di AS (SELECT session_id, window_idx, avg(dist) mean_pair_distance_m FROM pd GROUP BY ALL),
aw AS (SELECT *, min(mean_pair_distance_m) OVER (PARTITION BY session_id) lo, max(mean_pair_distance_m) OVER (PARTITION BY session_id) hi, count(mean_pair_distance_m) OVER (PARTITION BY session_id) c FROM tp LEFT JOIN ba USING (session_id, window_idx) LEFT JOIN di USING (session_id, window_idx)),
pw AS (SELECT *, CASE WHEN c >= 2 THEN CASE WHEN hi > lo THEN 1 - (mean_pair_distance_m - lo) / (hi - lo) ELSE 1.0 END END proximity_score FROM aw)"""


@query("g43_interaction_windows", t.with_(t.SAMP, t.SEG, FIX, EYE, PW, EQ, FLAGS, DIST, WINDOWS) + """SELECT session_id, window_idx, t_start, t_end, talking_leader, watched_leader, task_focus_leader, round(task_focus_score, 6) task_focus_score, round(engagement_score, 6) engagement_score, round(speech_balance_score, 6) speech_balance_score,
 round(mean_pair_distance_m, 6) mean_pair_distance_m, round(proximity_score, 6) proximity_score, round(list_avg(list_filter([speech_balance_score, task_focus_score, proximity_score], lambda v: v IS NOT NULL)), 6) collaboration_proxy_score FROM pw""")
def _(spark, sf):
    s = t.segments(spark, sf)
    f = cut(fixes(spark, sf))
    w = cut(wins(s))
    speech = cut(po.window_speech(s, w))
    nodes = cut(po.graph_nodes(speech, po.task_focus(f, w)))
    h = head(spark, sf)
    dist = po.proximity(h, spans(h), 0.05, C, 300.0)
    gaze = po.gaze_edges(po.window_gaze(po.peer_gaze(eye(spark, sf), h, C, 2.0, 20.0), w, C, 0.0, 0.0))
    o = po.graph_windows(nodes, po.speech_equality(speech, 20.0, 5.0), po.watched(gaze), dist)
    return rnd(o, "task_focus_score", "engagement_score", "speech_balance_score", "mean_pair_distance_m", "proximity_score", "collaboration_proxy_score")


@query("g43_interaction_nodes", t.with_(t.SAMP, t.SEG, FIX, PW, EQ) + """, x AS (SELECT session_id, window_idx, role, sum(least("offset", t_end) - greatest(onset, t_start)) f, count(*) n FROM fix JOIN w USING (session_id) WHERE onset < t_end AND "offset" > t_start GROUP BY ALL)
SELECT ws.session_id, window_idx, t_start, t_end, role, round(d, 6) speaking_time_s, round(least(d / (t_end - t_start), 1), 6) speaking_ratio_window, round(coalesce(f, 0) / (t_end - t_start), 6) task_focus_ratio, coalesce(n, 0) task_fixation_count FROM ws LEFT JOIN x USING (session_id, window_idx, role)""")
def _(spark, sf):
    s = t.segments(spark, sf)
    f = cut(fixes(spark, sf))
    w = wins(s)
    return rnd(po.graph_nodes(po.window_speech(s, w), po.task_focus(f, w)), "speaking_time_s", "speaking_ratio_window", "task_focus_ratio")
