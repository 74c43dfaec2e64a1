"""Worked cases of the interval operators, and their independence from chunking."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import intervals as iv, speech as sp
from colloquy.operators.align import asof, grid, interpolate, interval_join
from colloquy.operators.scan import by_width, collapse_islands, lag, last_valid, lead, next_valid, previous_max, quantiles, running_sum, scan

SCHEMA = "session_id long, role string, start_s double, end_s double"


def segs(spark, spec, session=1):
    return spark.createDataFrame([(session, r, float(a), float(b)) for r, xs in spec.items() for a, b in xs], SCHEMA)


def total(spark, s, session=1):
    return spark.createDataFrame([(session, float(s))], "session_id long, total_s double")


def turns(df, chunk=2.0, **kw):
    return [(r.role, r.start_s, r.end_s) for r in iv.aggregate_turns(df, chunk, **kw).orderBy("start_s").collect()]


@pytest.mark.parametrize(
    "spec, expected",
    [
        ({"A": [(0, 2), (3, 4), (5.5, 7), (10, 11)], "B": [(8, 9)]}, [("A", 0, 7), ("B", 8, 9), ("A", 10, 11)]),
        ({"A": [(0, 2), (3, 3.5)], "B": [(5, 7)]}, [("A", 0, 3.5), ("B", 5, 7)]),
        ({"A": [(0, 2), (3, 5), (6, 8)]}, [("A", 0, 8)]),
        ({"A": [(0, 5), (5.5, 10)], "B": [(2, 2.4)]}, [("A", 0, 10)]),
        ({"A": [(0, 3), (6, 9)], "B": [(2, 2.3)], "C": [(3.5, 5.5)]}, [("A", 0, 3), ("C", 3.5, 5.5), ("A", 6, 9)]),
        ({"A": [(0, 2), (5.5, 8)]}, [("A", 0, 2), ("A", 5.5, 8)]),
    ],
)
def test_turns(spark, spec, expected):
    assert turns(segs(spark, spec)) == expected


def test_floor_exchanges(spark):
    t = segs(spark, {"A": [(0, 7), (10, 11)], "B": [(8, 9)]})
    assert [r.gap_s for r in iv.floor_exchanges(t, 2.0).collect()] == [1.0, 1.0]
    touching = segs(spark, {"A": [(0, 2)], "B": [(2, 4)]})
    assert iv.floor_exchanges(touching, 2.0).count() == 0
    assert iv.floor_exchanges(touching, 2.0, include_zero=True).count() == 1


def test_union_silence_overlap_occupancy(spark):
    s = segs(spark, {"A": [(0, 2), (5, 7)], "B": [(1, 3)]})
    t = total(spark, 10)
    assert [(r.start_s, r.end_s) for r in iv.merge_union(s, 1.5).orderBy("start_s").collect()] == [(0, 3), (5, 7)]
    assert [(r.start_s, r.end_s) for r in iv.silence_intervals(s, t, 1.5).orderBy("start_s").collect()] == [(3, 5), (7, 10)]
    assert [(r.start_s, r.end_s) for r in iv.multi_active_intervals(s, 2, 1.5).collect()] == [(1, 2)]
    o = iv.occupancy(s, t, 1.5).first()
    assert (o.pct_0, o.pct_1, o.pct_2, o.pct_3, o.overlap_ratio) == (0.5, 0.4, 0.1, 0.0, 0.1)
    assert iv.pairwise_overlap(s, 1.5).first().overlap_s == 1.0


@pytest.mark.parametrize("end_b, successes", [(6.0, 1), (5.2, 0)])
def test_interruptions(spark, end_b, successes):
    r = iv.interruptions(segs(spark, {"A": [(0, 5)], "B": [(4, end_b)]})).first()
    assert (r.source, r.target, r.attempts, r.successes) == ("A", "B", 1, successes)


def test_backchannels(spark):
    turn = segs(spark, {"A": [(0, 10)]})
    one = segs(spark, {"A": [(0, 10)], "B": [(4.0, 4.5)]})
    assert [(r.role, r.start_s) for r in iv.backchannels(one, turn).collect()] == [("B", 4.0)]
    two = segs(spark, {"A": [(0, 10)], "B": [(4.0, 4.5), (3.7, 3.9)]})
    assert [(r.role, r.start_s) for r in iv.backchannels(two, turn).collect()] == [("B", 3.7)]


def sequential_turns(rows, turn_min, pause):
    def merge(xs):
        out = []
        for r, s, e in xs:
            if out and out[-1][0] == r and s - out[-1][2] <= pause:
                out[-1][2] = max(out[-1][2], e)
            else:
                out.append([r, s, e])
        return out

    return [tuple(t) for t in merge([t for t in merge(rows) if t[2] - t[1] >= turn_min])]


@pytest.mark.parametrize("seed, chunk", [(1, 0.7), (2, 3.0), (3, 1e9)])
def test_turns_equal_sequential_rule_for_any_chunk(spark, seed, chunk):
    rnd = random.Random(seed)
    rows, expected = [], {}
    for session in range(12):
        xs = []
        for _ in range(40):
            s = rnd.randrange(0, 400) / 10
            xs.append((rnd.choice("AB"), s, s + rnd.randrange(1, 80) / 10))
        xs.sort(key=lambda x: (x[1], x[2], x[0]))
        expected[session] = sequential_turns(xs, 1.0, 0.5)
        rows += [(session, r, s, e) for r, s, e in xs]
    got = iv.aggregate_turns(spark.createDataFrame(rows, SCHEMA), chunk, 1.0, 0.5).collect()
    for session in expected:
        assert sorted((r.role, r.start_s, r.end_s) for r in got if r.session_id == session) == sorted(expected[session])


@pytest.mark.parametrize("width", [0.5, 4.0, 1e9])
def test_scan_matches_plain_order(spark, width):
    rnd = random.Random(7)
    rows = [(k, i * 0.37, rnd.choice([None, rnd.randrange(10)])) for k in "xy" for i in range(30)]
    d = spark.createDataFrame(rows, "k string, t double, v int")
    got = scan(
        d, ["k"], ["t"], by_width("t", width),
        {"lg": lag("v"), "ld": lead("v"), "rs": running_sum("v"), "pm": previous_max("v"), "lv": last_valid("v"), "nv": next_valid("v")},
    ).orderBy("k", "t").collect()
    for k in "xy":
        xs = [r for r in rows if r[0] == k]
        for i, r in enumerate([g for g in got if g.k == k]):
            seen = [x[2] for x in xs[: i + 1] if x[2] is not None]
            before = [x[2] for x in xs[:i] if x[2] is not None]
            after = [x[2] for x in xs[i:] if x[2] is not None]
            assert r.lg == (xs[i - 1][2] if i else None)
            assert r.ld == (xs[i + 1][2] if i + 1 < len(xs) else None)
            assert r.rs == sum(seen)
            assert r.pm == (max(before) if before else None)
            assert r.lv == (seen[-1] if seen else None)
            assert r.nv == (after[0] if after else None)


def test_interval_join_with_one_very_long_interval(spark):
    a = spark.createDataFrame([(1, i, float(i), i + 0.5) for i in range(50)] + [(1, 999, -1e6, 1e6)], "s long, a int, s0 double, s1 double")
    b = spark.createDataFrame([(1, i, i + 0.25, i + 2.0) for i in range(50)], "s long, b int, t0 double, t1 double")
    j = interval_join(a, b, ["s"], 1.0, ("s0", "s1"), ("t0", "t1"))
    expected = sum(1 for x in a.collect() for y in b.collect() if x.s0 <= y.t1 and y.t0 <= x.s1)
    assert j.count() == expected
    assert j.distinct().count() == expected


def test_interval_join_plan_has_no_nested_loop(spark):
    a = segs(spark, {"A": [(0, 5)]})
    b = a.select("session_id", F.col("start_s").alias("b_s"), F.col("end_s").alias("b_e"))
    plan = interval_join(a, b, ["session_id"], 1.0, ("start_s", "end_s"), ("b_s", "b_e"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_asof_and_interpolation(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 100.0)], "k int, t double, v double")
    p = spark.createDataFrame([(1, -1.0), (1, 0.0), (1, 4.0), (1, 5.0), (1, 6.0), (1, 11.0)], "k int, t double")
    back = [r.v for r in asof(p, s, ["k"], "t", ["v"], 3.0).orderBy("t").collect()]
    assert back == [None, 0.0, 0.0, 0.0, 0.0, 100.0]
    near = [r.v for r in asof(p, s, ["k"], "t", ["v"], 3.0, "nearest", 4.5).orderBy("t").collect()]
    assert near == [0.0, 0.0, 0.0, None, 100.0, 100.0]
    lin = [r.v for r in interpolate(p, s, ["k"], "t", ["v"], 3.0, 4.0).orderBy("t").collect()]
    assert lin == [None, 0.0, 40.0, None, 60.0, None]


def test_islands_keep_long_carried_end(spark):
    rows = [(1, 0.0, 100.0), (1, 10.0, 11.0), (1, 99.0, 101.0), (1, 105.0, 106.0)]
    d = spark.createDataFrame(rows, "k long, a double, b double")
    r = collapse_islands(d, ["k"], ["a", "b"], by_width("a", 5.0), "a", "b", gap=0.0).orderBy("a").collect()
    assert [(x.a, x.b, x.n) for x in r] == [(0.0, 101.0, 3), (105.0, 106.0, 1)]


def test_quantiles_small_and_large(spark):
    d = spark.range(30001).select((F.col("id") % 3).alias("k"), (F.pow(F.col("id"), 2) % 9973).cast("double").alias("v"))
    got = {r.k: (r.a, r.b) for r in quantiles(d, ["k"], "v", {"a": 0.5, "b": 0.95}).collect()}
    exp = {r.k: (r.p[0], r.p[1]) for r in d.groupBy("k").agg(F.percentile("v", [0.5, 0.95]).alias("p")).collect()}
    assert got.keys() == exp.keys()
    for k in got:
        assert got[k] == pytest.approx(exp[k])
    small = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 3.0, 10.0)], "k int, v double")
    assert quantiles(small, ["k"], "v", {"q": 0.25}).first().q == 1.75


def test_occupancy_and_silence_properties(spark, sf):
    from colloquy.plans import tables as t

    s = t.segments(spark, sf)
    tot = s.select("session_id", F.lit(t.TOTAL_S).alias("total_s")).distinct()
    o = iv.occupancy(s, tot, 60.0).withColumn("x", F.expr("pct_0 + pct_1 + pct_2 + pct_3"))
    assert o.where("abs(x - 1) > 1e-3").count() == 0
    inside = s.select("session_id", "role", F.least("start_s", F.lit(t.TOTAL_S)).alias("start_s"), F.least("end_s", F.lit(t.TOTAL_S)).alias("end_s"))
    u = iv.merge_union(inside, 60.0).groupBy("session_id").agg(F.sum(iv.duration()).alias("u"))
    q = iv.silence_intervals(s, tot, 60.0).groupBy("session_id").agg(F.sum(iv.duration()).alias("q"))
    assert u.join(q, "session_id").where(F.abs(F.col("u") + F.col("q") - t.TOTAL_S) > 1e-6).count() == 0


def test_short_pairs_are_compared_on_the_finest_level_only(spark):
    """Candidates stay near the number of results, with and without a very long interval."""
    from colloquy.operators.align import _buckets, _levels

    short = lambda n: spark.range(n).select(F.lit(1).alias("s"), (F.col("id") * 2.0).alias("a0"), (F.col("id") * 2.0 + 1.5).alias("a1"))
    a = short(3000).unionByName(spark.createDataFrame([(1, 0.0, 6000.0)], "s int, a0 double, a1 double"))
    b = short(3000).select("s", F.col("a0").alias("b0"), F.col("a1").alias("b1"))
    n = _levels(((a, ("a0", "a1")), (b, ("b0", "b1"))), 1.0, 16)
    x, y = _buckets(a, "a0", "a1", 1.0, 16, n, True), _buckets(b, "b0", "b1", 1.0, 16, n, False)
    tags = ["s", "_lv", "_b", "_la", "_lb"]
    candidates = x.join(y, tags).where("_la = 0 and _lb = 0").count()
    results = interval_join(a, b, ["s"], 1.0, ("a0", "a1"), ("b0", "b1"))
    assert results.where("a1 < 6000").count() == 3000 and results.count() == 6000
    assert candidates <= 3 * 3000
    assert x.where("a1 = 6000").count() <= 40


def test_backchannels_look_as_far_as_the_widest_filter(spark):
    from colloquy.operators import intervals as iv

    rows = [(1, "A", 0.0, 3.0), (1, "B", 0.0, 2.0), (1, "B", 3.5, 3.9), (1, "A", 3.6, 5.0)]
    d = spark.createDataFrame(rows, "session_id int, role string, start_s double, end_s double")
    turns = d.where("end_s - start_s > 1")
    assert iv.backchannels(d, turns, continuation_s=0.2).count() == 1
    assert iv.backchannels(d, turns, continuation_s=2.0).count() == 0


def test_overview_rounds_shares_and_one_role_as_sql(spark):
    o = sp.session_overview(segs(spark, {"A": [(0, 4.5)]}), total(spark, 1000), 60.0).first()
    assert (o.pct_1_spk, str(o.participation_entropy)) == (0.5, "-0.0")


def test_grid_frames_are_dealt_over_tasks(spark):
    s = spark.createDataFrame([(1, 400_000), (2, 1025), (3, 0), (4, 1)], "session_id long, n long").coalesce(1)
    g = grid(s, F.col("n"), 0.5)
    assert g.columns == ["session_id", "n", "frame_idx", "t"]
    per = g.groupBy("session_id").agg(F.count("*").alias("c"), F.countDistinct("frame_idx").alias("d"), F.max("frame_idx").alias("m"), F.max("t").alias("t"))
    assert sorted(tuple(r) for r in per.collect()) == [(1, 400_000, 400_000, 399_999, 799_998.0), (2, 1025, 1025, 1024, 2048.0), (4, 1, 1, 0, 0.0)]
    assert max(r["count"] for r in g.groupBy(F.spark_partition_id()).count().collect()) <= 140_000
