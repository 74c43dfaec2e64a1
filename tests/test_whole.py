"""Keys that were counted and found small are one chunk; results are those of the chunks."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import episodes as ep, intervals as iv, position as po, scan as sc, speech as sp

SCHEMA = "session_id long, role string, start_s double, end_s double"


def segments(spark, n=400, roles=("a", "b", "c", None)):
    rnd = random.Random(5)
    rows = []
    for _ in range(n):
        # Multiples of an eighth: many equal starts and ends, and sums without rounding.
        start = rnd.randrange(0, 4000) / 8
        rows.append((rnd.randrange(3), rnd.choice(roles), start, start + rnd.choice([0, 1, 2, 4, 5, 8, 16, 40, 800]) / 8))
    return spark.createDataFrame(rows + rows[:7], SCHEMA)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def both(monkeypatch, make):
    whole = sorted(map(str, make().collect()))
    monkeypatch.setattr(sc, "WHOLE_ROWS", 0)
    chunked = sorted(map(str, make().collect()))
    monkeypatch.undo()
    return whole, chunked


def test_chunk_width_goes_by_the_largest_key(spark, monkeypatch):
    s = segments(spark)
    assert sc.chunk_width(s, ["session_id"], 60.0) is None
    monkeypatch.setattr(sc, "WHOLE_ROWS", 100)
    assert sc.chunk_width(s, ["session_id"], 60.0) == 60.0


def test_turns_of_small_sessions_shuffle_once(spark):
    s = segments(spark)
    assert exchanges(iv.aggregate_turns(s, 60.0)) == 1
    assert exchanges(iv.next_turns(iv.aggregate_turns(s, None), None).groupBy("session_id").count()) == 1


@pytest.mark.parametrize("width", [7.0, 60.0])
def test_whole_sessions_equal_chunks(spark, monkeypatch, width):
    s = segments(spark).cache()
    named = s.where("role is not null")
    tot = s.select("session_id", F.lit(700.0).alias("total_s")).distinct()
    for make in (
        lambda: iv.aggregate_turns(named, width), lambda: iv.floor_exchanges(iv.aggregate_turns(named, width).cache(), width, 30.0),
        lambda: iv.role_sweep(s, tot, width), lambda: sp.speech_metrics(named, tot, width),
    ):
        whole, chunked = both(monkeypatch, make)
        assert whole and whole == chunked


def test_sweep_has_one_row_a_moment(spark):
    s = spark.createDataFrame([(1, "a", 0.0, 4.0), (1, "a", 4.0, 6.0), (1, "b", 0.0, 6.0), (1, None, 1.0, 2.0), (1, "", 1.0, 3.0)], SCHEMA)
    tot = s.select("session_id", F.lit(10.0).alias("total_s")).distinct()
    rows = iv.role_sweep(s, tot, 60.0).where("track = 'role'").collect()
    got = sorted((r.role or "", r.role is None, r.t, r.next_t or -1.0, r.level) for r in rows)
    assert got == [
        ("", False, 1.0, 3.0, 1), ("", False, 3.0, -1.0, 0), ("", True, 1.0, 2.0, 1), ("", True, 2.0, -1.0, 0),
        ("a", False, 0.0, 4.0, 1), ("a", False, 4.0, 6.0, 1), ("a", False, 6.0, -1.0, 0), ("b", False, 0.0, 6.0, 1), ("b", False, 6.0, -1.0, 0),
    ]


def test_backchannels_keep_copies_and_need_one_join(spark):
    segs = spark.createDataFrame([(1, "a", 0.0, 10.0), (1, "b", 4.0, 4.5), (1, "b", 4.0, 4.5), (1, "b", 20.0, 20.5), (1, "c", 4.6, 5.0), (1, "c", 5.125, 5.5)], SCHEMA)
    turns = spark.createDataFrame([(1, "a", 0.0, 10.0)], SCHEMA)
    b = iv.backchannels(segs, turns)
    assert sorted((r.role, r.start_s) for r in b.collect()) == [("b", 4.0), ("b", 4.0), ("c", 4.6)]
    assert b._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


@pytest.mark.parametrize("width", [3.0, 60.0])
def test_whole_episodes_and_gaze_equal_chunks(spark, monkeypatch, width):
    rnd = random.Random(7)
    times = {(s, r): sorted(rnd.sample(range(800), 60)) for s in (1, 2) for r in "ab"}
    eye = spark.createDataFrame([(s, r, v / 8, float(rnd.randrange(6)), 0.0, 0.0) for (s, r), ts in times.items() for v in ts], "session_id long, role string, t double, hx double, hy double, hz double").cache()
    pos = eye.where("hx < 4").selectExpr("session_id", "role", "t", "hx AS px", "hy AS py", "hz AS pz")
    flags = po.peer_gaze(eye, pos, width, 1.5, 2.0).cache()
    for make in (
        lambda: po.peer_gaze(eye, pos, width, 1.5, 2.0), lambda: po.peer_gaze_episodes(flags, width, 0.25, 0.5), lambda: ep.median_step(flags, ["session_id", "role", "target"], "t", width),
        lambda: ep.irregular_episodes(flags, ["session_id", "role", "target"], "t", width, 0.0, 0.0),
    ):
        whole, chunked = both(monkeypatch, make)
        assert whole and whole == chunked
    given = spark.createDataFrame(flags.collect(), flags.schema)
    assert exchanges(po.peer_gaze_episodes(given, width)) == 2  # runs, and the median steps
