"""Worked cases of episodes, fixations and aggregates."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import aggregates as ag, episodes as ep, fusion as fu, gaze as gz


def test_grid_episodes(spark):
    d = spark.createDataFrame([(1, i) for i in (1, 2, 4)], "k int, frame_idx long")
    r = ep.episode_stats(ep.mask_runs(d, ["k"], 2), ["k"], 10.0).first()
    assert r.n_episodes == 2 and r.dur_total_s == pytest.approx(0.3) and r.dur_mean_s == pytest.approx(0.15)


def test_irregular_episodes_merge(spark):
    d = spark.createDataFrame([(1, t / 10, s) for t, s in enumerate([True, True, False, True, True])], "k int, t double, state boolean")
    r = ep.irregular_episodes(d, ["k"], "t", 0.15, 0.0, 0.2).collect()
    assert [(x.start_s, x.end_s) for x in r] == [(0.0, 0.4)]
    n = ep.irregular_episodes(d, ["k"], "t", 0.15, end="next").orderBy("start_s").collect()
    assert [(x.start_s, round(x.end_s, 6)) for x in n] == [(0.0, 0.2), (0.3, 0.5)]


def test_fixations(spark):
    d = spark.createDataFrame([(1, "a", t / 10, o) for t, o in enumerate("XXXYY")], "session_id int, role string, t double, object string")
    r = ep.fixations(d, ["session_id", "role"], "t", 0.15).collect()
    assert [(x.object, x.onset, x.offset) for x in r] == [("X", 0.0, 0.2)]


def test_windows_are_cut_at_the_end(spark):
    d = spark.createDataFrame([(1, 0.0, 5.0)], "session_id int, t0 double, t1 double")
    assert [(r.t_start, r.t_end) for r in ep.sliding_windows(d, 4.0, 2.0).orderBy("window_idx").collect()] == [(0, 4), (2, 5), (4, 5)]


def test_entropy_gini_shares(spark):
    d = spark.createDataFrame([(1, 60.0), (1, 30.0), (1, 10.0), (2, 5.0)], "k int, w double")
    e = {r.k: r.entropy for r in ag.entropy_of(d, ["k"], "w").collect()}
    assert e[1] == pytest.approx(0.897946, abs=1e-6) and e[2] == pytest.approx(0.0)
    assert ag.entropy_of(d, ["k"], "w", "bits").where("k = 1").first().entropy == pytest.approx(1.295462, abs=1e-6)
    n = {r.k: r.entropy for r in ag.entropy_of(d, ["k"], "w", normalize=True).collect()}
    assert n[1] == pytest.approx(0.817345, abs=1e-6) and n[2] == 0.0
    v = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 7.0)], "k int, w double")
    assert ag.gini(v, ["k"], "w").first().gini == pytest.approx(0.4)
    r = v.groupBy("k").agg(ag.coef_var("w").alias("a"), ag.coef_var("w", 1).alias("b"), ag.share_variance("w").alias("c"), ag.top_share("w").alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == pytest.approx((0.787401, 0.964365, 0.068889, 0.7), abs=1e-6)


def test_constant_column_z_is_zero_or_null(spark):
    d = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None)], "u int, v double")
    assert [r.z_v for r in ag.zscore_within(d, ["v"], []).orderBy("u").collect()] == [0.0, 0.0, None]
    assert [r.z_v for r in ag.zscore_within(d, ["v"], [], on_constant=None).orderBy("u").collect()] == [None, None, None]


def test_weighted_index_refuses_unknown_terms(spark):
    with pytest.raises(ValueError):
        fu.weighted_index(spark.createDataFrame([(1.0,)], "a double"), "i", {"b": 1.0})


def test_rigid_yaw_recovers_rotation(spark):
    import math

    th = math.radians(37)
    pts = [(0.3, 1.0), (1.2, -0.4), (-0.8, 0.5), (0.1, 0.2)]
    rows = [(1, x, z, math.cos(th) * x - math.sin(th) * z + 5, math.sin(th) * x + math.cos(th) * z - 2) for x, z in pts]
    r = gz.rigid_yaw(spark.createDataFrame(rows, "k int, ax double, az double, bx double, bz double"), ["k"]).first()
    assert r.theta_deg == pytest.approx(37.0) and r.resid_m == pytest.approx(0.0, abs=1e-9)


def test_yaw_flips_follow_the_sequential_choice(spark):
    rows = [(1, i, th, rs) for i, (th, rs) in enumerate([(10.0, 0.03), (-172.0, 0.01), (9.0, 0.02), (-170.0, 0.02)])]
    r = gz.yaw_stability(spark.createDataFrame(rows, "k int, w long, theta_deg double, resid_m double"), ["k"], "w").first()
    assert r.status == "ok" and abs(r.theta_deg) == pytest.approx(170.75, abs=0.1)
