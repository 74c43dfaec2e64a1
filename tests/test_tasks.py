"""Placements, task logs, readers and streams."""

import os
import math
import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import placements as pl, taskevents as te
from colloquy.session import stage_path


def test_task_score(spark):
    d = spark.createDataFrame([(1, 5, 7, 6, 8, 7, 2.4, 900.0)], "layout_id long, n_rules_passed int, n_rules_total int, n_matched int, n_placed int, n_expected int, sum_distance_m double, duration_s double")
    r = pl.task_score(d).first()
    assert (r.M1, r.M2, r.M3, r.M4, r.score) == pytest.approx((71.428571, 80.0, 60.653066, 40.0, 66.040819), abs=1e-6)


def greedy(s, p):
    pairs = sorted((((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5, i, j) for i, a in s.items() for j, b in p.items())
    us, up, out = set(), set(), set()
    for d, i, j in pairs:
        if i not in us and j not in up:
            us.add(i), up.add(j), out.add((i, j))
    return out


def test_greedy_match_equals_sequential_rule(spark):
    rnd = random.Random(2)
    sr, pr, exp = [], [], {}
    for lay in range(15):
        pt = lambda: (rnd.randrange(20) / 2, rnd.randrange(20) / 2)
        s = {i: pt() for i in range(rnd.randrange(1, 9))}
        p = {i: pt() for i in range(rnd.randrange(0, 9))}
        if lay == 0:
            p[99] = (1e8, 0.0)
        exp[lay] = greedy(s, p)
        sr += [(lay, i, *map(float, v)) for i, v in s.items()]
        pr += [(lay, i, *map(float, v)) for i, v in p.items()]
    m = pl.match_greedy(spark.createDataFrame(sr, "layout_id long, s_id long, x double, z double"), spark.createDataFrame(pr, "layout_id long, p_id long, x double, z double"))
    got = {}
    for r in m.collect():
        got.setdefault(r.layout_id, set()).add((r.s_id, r.p_id))
    assert {k: v for k, v in exp.items() if v} == got


def running_clusters(v, tol):
    v = sorted(v)
    out, cur = [], [v[0]]
    for x in v[1:]:
        if abs(x - sum(cur) / len(cur)) <= tol:
            cur.append(x)
        else:
            out.append(cur)
            cur = [x]
    return [sum(c) / len(c) for c in [*out, cur]]


def test_cluster_levels_equal_running_mean(spark):
    rnd = random.Random(4)
    vals = {k: [rnd.randrange(60) / 10 for _ in range(25)] for k in range(6)}
    d = spark.createDataFrame([(k, x) for k, xs in vals.items() for x in xs], "layout_id long, x double")
    got = pl.cluster_levels(d, "x", 0.25).collect()
    for k, xs in vals.items():
        assert sorted(r.center for r in got if r.layout_id == k) == pytest.approx(running_clusters(xs, 0.25))


def test_congruence_special_cases(spark):
    rows = [(1, "a", 1.0, 1.0), (1, "a", 1.0, 1.0), (1, "b", 1.0, 1.0), (1, "b", 1.0, 2.0), (1, "c", 1.0, 1.0), (1, "c", 2.0, 3.0), (1, "typing", 5.0, 1.0)]
    d = spark.createDataFrame(rows, "group_id int, task string, skill_i double, effort_total double")
    got = {r.task: r.congruence for r in te.congruence(d, "skill_i", typed_tasks=["typing"]).collect()}
    assert got["a"] == 1.0 and got["b"] is None and got["c"] == pytest.approx(1.0) and got["typing"] == 1.0


def test_stream_turns_close_and_count(spark):
    from colloquy.streaming.live import live_turns

    src, out, chk = stage_path(spark, "in"), stage_path(spark, "out"), stage_path(spark, "chk")
    rows = [(1, "A", 0.0, 2.0), (1, "A", 3.0, 4.0), (1, "B", 5.0, 7.0), (1, "A", 20.0, 21.0), (1, "B", 500.0, 501.0), (1, "A", 900.0, 901.0)]
    d = spark.createDataFrame(rows, "session_id long, role string, start_s double, end_s double").withColumn("ts", F.timestamp_seconds("end_s"))
    d.coalesce(1).write.parquet(src)
    s = spark.readStream.schema(d.schema).parquet(src)
    q = live_turns(s, watermark="1 second").writeStream.format("parquet").option("checkpointLocation", chk).trigger(availableNow=True).start(out)
    q.awaitTermination()
    got = [(r.role, r.start_s, r.end_s, r.n_turns, r.n_exchanges) for r in spark.read.parquet(out).orderBy("start_s").collect()]
    assert got[:4] == [("A", 0.0, 4.0, 1, 0), ("B", 5.0, 7.0, 2, 1), ("A", 20.0, 21.0, 3, 1), ("B", 500.0, 501.0, 4, 1)]


def test_late_rows_are_dropped(spark):
    from colloquy.streaming.live import window_means

    src, out, chk = stage_path(spark, "in"), stage_path(spark, "out"), stage_path(spark, "chk")
    mk = lambda xs: spark.createDataFrame([(1, float(x)) for x in xs], "k int, v double").withColumn("ts", F.timestamp_seconds("v"))
    mk([1, 2, 100]).coalesce(1).write.mode("append").parquet(src)

    def run():
        s = spark.readStream.schema("k int, v double, ts timestamp").parquet(src)
        q = window_means(s, ["k"], ["v"], "10 seconds", "10 seconds", "5 seconds").writeStream.format("parquet").option("checkpointLocation", chk).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return q

    run()
    mk([3, 200]).coalesce(1).write.mode("append").parquet(src)
    q = run()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    assert dropped == 1
    first = spark.read.parquet(out).where(F.col("t_start") == F.timestamp_seconds(F.lit(0))).collect()
    assert [(r.n, r.v_mean) for r in first] == [(2, 1.5)]


def test_hot_session_survives(spark):
    """One session with most rows and one very long segment: same result as a plain window."""
    from pyspark.sql import Window as W

    from colloquy.operators import intervals as iv

    d = spark.range(20000).select(
        F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 50).cast("long").alias("session_id"), F.concat(F.lit("r"), F.col("id") % 3).alias("role"),
        (F.pmod(F.xxhash64("id"), F.lit(100000)) / 10.0).alias("start_s"),
    ).withColumn("end_s", F.col("start_s") + F.pmod(F.xxhash64("start_s"), F.lit(20)) / 10.0)
    w = W.partitionBy("session_id").orderBy("start_s", "end_s", "role")
    pm = F.max("end_s").over(w.rowsBetween(W.unboundedPreceding, -1))
    plain = d.withColumn("new", (pm.isNull() | (F.col("start_s") > pm)).cast("int")).groupBy("session_id").agg(F.sum("new").alias("n"))
    got = iv.merge_union(d, 30.0).groupBy("session_id").agg(F.count("*").alias("n"))
    assert {(r.session_id, r.n) for r in plain.collect()} == {(r.session_id, r.n) for r in got.collect()}


@pytest.mark.parametrize("files", [1, 2, 5])
def test_stream_turns_do_not_depend_on_batches(spark, files):
    """However the rows are cut into batches, the closed turns are those of the batch operator."""
    import random

    from colloquy.operators.intervals import aggregate_turns
    from colloquy.streaming.live import live_turns

    rng, rows = random.Random(files), []
    for session in (1, 2):
        at = 0.0
        for _ in range(120):
            at += rng.choice([0.2, 0.5, 1.0, 2.5, 4.0])
            rows.append((session, rng.choice("AB"), at, at + rng.choice([0.3, 0.8, 1.5, 3.0])))
    schema = "session_id long, role string, start_s double, end_s double"
    segments = spark.createDataFrame(rows, schema)
    want = {(r.session_id, r.role, r.start_s, r.end_s) for r in aggregate_turns(segments, 30.0).collect()}
    src, out, chk = stage_path(spark, "in"), stage_path(spark, "out"), stage_path(spark, "chk")
    rng.shuffle(rows)
    # Rows may come in any order inside the watermark; the last file only moves the watermark.
    parts = [rows[i::files] for i in range(files)] + [[(9, "A", 1e6, 1e6 + 1)]]
    for i, part in enumerate(parts):
        d = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("start_s"))
        d.coalesce(1).write.mode("append").parquet(f"{src}/{i}")
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = live_turns(s, watermark="1 hour").writeStream.format("parquet").option("checkpointLocation", chk).trigger(availableNow=True).start(out)
    q.awaitTermination()
    got = spark.read.parquet(out).collect()
    assert {(r.session_id, r.role, r.start_s, r.end_s) for r in got} == want and len(got) == len(want)


def test_matching_ends_without_positions(spark):
    nan, inf = float("nan"), float("inf")
    s = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, None, 1.0), (1, 3, nan, 0.0), (1, 4, 9000.0, 0.0), (2, 1, None, None), (3, 1, 0.0, 0.0)], "layout_id int, s_id int, x double, z double")
    p = spark.createDataFrame([(1, 1, 0.1, 0.0), (1, 2, 1.0, None), (1, 3, inf, 0.0), (1, 4, 0.0, 7.0), (2, 1, 0.0, 0.0), (3, 1, 0.2, 0.0), (3, 2, 0.1, 0.0)], "layout_id int, p_id int, x double, z double")
    got = [tuple(r) for r in pl.match_greedy(s, p).select("layout_id", "s_id", "p_id").orderBy("layout_id", "s_id").collect()]
    assert got == [(1, 1, 1), (1, 4, 4), (3, 1, 2)]


def test_durations_that_are_not_positive_count_as_the_cap(spark):
    d = spark.createDataFrame([(1, 0.0), (2, -5.0), (3, 20.0), (4, 9000.0), (5, None)], "layout_id int, a double")
    assert [r.duration_s for r in pl.duration_seconds(d, ["a"]).orderBy("layout_id").collect()] == [1500.0, 1500.0, 20.0, 1500.0, None]


def test_ids_and_words_are_not_cut(spark):
    from colloquy.functions.scalars import recode_likert, text_units
    from colloquy.operators.keys import normalize_group_id

    d = spark.createDataFrame([("BIM 1234",), ("7",), ("007_2",), ("g12345678901234567890",), ("none",)], "x string")
    assert [r[0] for r in d.select(normalize_group_id(F.col("x"))).collect()] == ["bim1234", "bim007", "bim007_2", "bim12345678901234567890", "none"]
    t = spark.createDataFrame([("Straße œuvre слово snake_case",)], "x string")
    assert t.select(text_units(F.col("x"))).first()[0] == ["straße", "œuvre", "слово", "snake_case"]
    k = spark.createDataFrame([("7.5",), (" 7 ",), ("0",), ("12",), ("Oui",)], "x string")
    assert [r[0] for r in k.select(recode_likert(F.col("x"), {"oui": 9}, F.lit("i"), [])).collect()] == [None, 7, None, None, 9]


def test_near_pairs_equal_all_pairs_and_are_never_broadcast(spark):
    """The copies of one side over the cells are more than a plan's estimate tells: no side may go to the driver."""
    rnd = random.Random(5)
    at = lambda: (rnd.randint(0, 2), round(rnd.uniform(-4, 4), 1), round(rnd.uniform(-4, 4), 1))
    sr, pr = [(l, i, x, z) for i in range(60) for l, x, z in [at()]], [(l, i, x, z) for i in range(60) for l, x, z in [at()]]
    s, p = spark.createDataFrame(sr, "layout_id long, s_id long, x double, z double"), spark.createDataFrame(pr, "layout_id long, p_id long, x double, z double")
    d = pl.near_pairs(s, p, 1.0)
    want = {(a[0], a[1], b[1]) for a in sr for b in pr if a[0] == b[0] and math.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) <= 1.0}
    got = [tuple(r)[:3] for r in d.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["e02_contribution", "e04_skill_cells", "e06_skill_items"])
def test_lines_that_tie_in_everything_but_answer_and_truth(spark, tmp_path, name):
    import datetime

    import duckdb

    from colloquy import plans

    day = datetime.datetime(2024, 1, 5)
    # Items 1 and 2 (part key modulo 50); the truth is the part key modulo 3.
    rows = [(8, 101, 3, 1, 1.0, "A", day), (8, 51, 3, 1, 1.0, "R", day), (8, 2, 3, 1, 1.0, "R", day), (8, 52, 3, 1, 1.0, "A", day), (9, 7, 4, 2, 2.0, "N", day)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    plans.load_all()
    got = plans.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({plans.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_one_pass_over_the_log_equals_the_separate_operators(spark):
    rnd = random.Random(7)
    pick = lambda *x: rnd.choice(x)
    rows = [(pick(1, 2), pick("T1", "T2"), pick(1, 2, 3, 4, None), pick(*range(8), None), i // 3, rnd.randrange(2), pick("A", "N", "R"), pick("A", "N", "R"), pick(te.TASK, te.COMM), "y" * rnd.randrange(3)) for i in range(160)]
    rows += [(3, "T1", 5, None, 0, 0, "A", "A", te.COMM, "y"), (4, "T1", 5, 10, 0, 0, "A", "A", te.TASK, None)]
    a = spark.createDataFrame(rows, "group_id long, task string, subject long, item long, t long, seq long, answer string, truth string, event_type string, summary string")
    order, scored = ["t", "seq"], F.col("item") % 5 != 0
    cells = te.resolved_cells(a, order, scored)
    members = te.cell_members(cells)

    latest = lambda c: F.max(F.struct(*order, "subject", c))
    sn = a.groupBy(*te.GT, "item").agg(latest("answer").alias("a"), latest("truth").alias("b"))
    sn = sn.select(*te.GT, "item", F.col("a.subject").alias("author"), F.col("a.answer").alias("answer"), F.col("b.truth").alias("truth"))
    ex = a.groupBy(*te.GT).agg((F.countDistinct("item") + 5).alias("expected_total"))
    la, ky = te.last_answers(a, order), sn.where(scored).select(*te.GT, "item", "truth")
    ind = te.individual_table(te.effort(a.withColumn("content", F.lit(""))), te.skill_items(la, ky, ex), te.contribution(sn), ["T2"])
    one = te.with_shares(te.member_table(members, 5, ["T2"]))
    show = lambda d, cols: sorted(map(repr, d.select(*cols).collect()))
    assert show(one, ind.columns) == show(ind, ind.columns)
    st = te.strategy(a, te.correct_items(la, ky), ex)
    assert show(te.member_strategy(cells, members, 5), st.columns) == show(st, st.columns)


def test_spread_of_large_groups_equals_that_of_small_ones(spark):
    rnd = random.Random(8)
    nan = float("nan")
    rows = [(g, "T1", rnd.choice([None, nan, *map(float, range(6))])) for g in (1, 2, None) for _ in range(30)] + [(4, "T1", 1.0), (5, "T1", None)]
    d = spark.createDataFrame(rows, "group_id long, task string, v double")
    table = lambda many: sorted(map(repr, te._ranked(d, ["v"], many).groupBy(*te.GT).agg(*te._distribution(["v"])).select(*te.GT, F.round("v_gini", 9)).collect()))
    assert table(5) == table(te.MANY)
    x = sorted(v for g, _, v in rows if g == 1 and v is not None and v == v)
    want = 2 * sum(r * v for r, v in enumerate(x, 1)) / (len(x) * sum(x)) - (len(x) + 1) / len(x)
    assert f"group_id=1, task='T1', round(v_gini, 9)={round(want, 9)}" in " ".join(table(5))


def test_rule_reports_are_written_in_few_folders(spark, tmp_path):
    from colloquy import plans
    from colloquy.session import checkpoint_dir

    plans.load_all()
    spark.range(250).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    root = checkpoint_dir(spark).replace("file:", "")
    old = set(os.listdir(root))
    got = sorted(tuple(r) for r in plans.QUERIES["s11_read_rule_reports"](spark, str(tmp_path)).collect())
    assert got == [(1, 3)] * 125 + [(2, 3)] * 125
    walked = [(d, files) for new in set(os.listdir(root)) - old for d, _, files in os.walk(f"{root}/{new}/rules")]
    assert sum(f.endswith(".json") for _, files in walked for f in files) == 250 and len(walked) <= 101
