"""Reader, writer and streaming queries: files are written from the given tables by Spark
into the shared stage folder and read back through the operators."""

from pyarrow import fs as pafs
from pyspark.sql import functions as F

from colloquy.plans import query
from colloquy.plans import tables as t
from colloquy.plans.gaze import rnd
from colloquy.session import stage_path
from colloquy.sources import readers as rd, sinks
from colloquy.streaming import live


def eu_number(c):
    return F.regexp_replace(F.col(c).cast("string"), "\\.", ",")


def put(df, name, **opt):
    path = stage_path(df.sparkSession, name)
    df.write.options(**opt).csv(path)
    return path


def lines(df, name, col="value"):
    path = stage_path(df.sparkSession, name)
    df.select(col).write.text(path)
    return path


def put_files(df, path):
    """One file for each row (``name`` below ``path``, text ``body``), as a scoring run writes its reports.

    Tasks write their own rows, so nothing is moved afterwards; a repeated task writes the same files again.
    """
    def write(batches):
        local = path.startswith("file:/") and not path.startswith("file://")
        fs, root = pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if local else path)
        made = set()
        for pdf in batches:
            for name, body in zip(pdf["name"], pdf["body"]):
                folder = f"{root}/{name}".rpartition("/")[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(f"{root}/{name}") as f:
                    f.write(body.encode())
            yield pdf[["name"]]

    df.mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()


@query("s01_read_eu_csv", "SELECT c_custkey::VARCHAR c_custkey, c_name, c_acctbal FROM customer")
def _(spark, sf):
    c = t.table(spark, sf, "customer").select("c_custkey", "c_name", eu_number("c_acctbal").alias("c_acctbal"))
    return rd.read_eu_csv(spark, put(c, "eu", sep=";", header=True), ["c_acctbal"])


@query("s02_read_csv_sniff", "SELECT c_custkey::VARCHAR id, c_acctbal balance, NULL::VARCHAR phone FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_suppkey::VARCHAR, s_acctbal, 'p' || s_suppkey FROM supplier")
def _(spark, sf):
    root = stage_path(spark, "mixed")
    c = t.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), eu_number("c_acctbal").alias("balance"))
    s = t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.concat(F.lit("p"), F.col("s_suppkey")).alias("phone"))
    c.write.options(sep=";", header=True).csv(f"{root}/a")
    s.write.options(sep=",", header=True).csv(f"{root}/b")
    d = rd.read_csv_sniff(spark, f"{root}/*/*.csv")
    return d.select("id", rd.numeric_text(F.col("balance")).alias("balance"), "phone")


@query("s03_read_csv_tolerant", "SELECT c_custkey::VARCHAR a, c_name b, c_mktsegment c FROM customer WHERE c_custkey % 10 <> 0")
def _(spark, sf):
    c = t.table(spark, sf, "customer")
    bad = F.when(F.col("c_custkey") % 10 == 0, ";extra").otherwise("")
    p = lines(c.select(F.concat("c_custkey", F.lit(";"), "c_name", F.lit(";"), "c_mktsegment", bad).alias("value")), "tol")
    return rd.read_csv_tolerant(spark, p, ["a", "b", "c"], header=False)[0].drop("source_file")


@query("s03_rejects", "SELECT count(*) n FROM customer WHERE c_custkey % 10 = 0")
def _(spark, sf):
    c = t.table(spark, sf, "customer")
    bad = F.when(F.col("c_custkey") % 10 == 0, ";extra").otherwise("")
    p = lines(c.select(F.concat("c_custkey", F.lit(";"), "c_name", F.lit(";"), "c_mktsegment", bad).alias("value")), "tol")
    return rd.read_csv_tolerant(spark, p, ["a", "b", "c"], header=False)[1].agg(F.count("*").alias("n"))


def stream_file(spark, sf):
    e = t.table(spark, sf, "events")
    row = F.when(F.col("event_type") == "signup", F.concat(F.col("event_id"), F.lit(";MARKER"))).when(F.col("event_id") % 97 == 0, F.lit("END")).otherwise(
        F.concat(F.col("event_id"), F.lit(",5;"), eu_number("value"), F.lit(";"), F.col("event_type")))
    return rd.read_sensor_stream(spark, lines(e.select(row.alias("value")), "sensor"), ["Time", "v", "obj"], "Time")


@query("s04_read_sensor_stream", "SELECT event_id + 0.5::DOUBLE AS \"Time\", value v, event_type obj FROM events WHERE event_type <> 'signup' AND event_id % 97 <> 0")
def _(spark, sf):
    r, _m = stream_file(spark, sf)
    return r.select("Time", rd.numeric_text(F.col("v")).alias("v"), "obj")


@query("s04_markers", "SELECT event_id::DOUBLE AS \"Time\" FROM events WHERE event_type = 'signup'")
def _(spark, sf):
    return stream_file(spark, sf)[1].select("Time")


@query("s05_read_event_log", "SELECT user_id::VARCHAR \"SessionId\", event_type \"TaskName\", 'e' || event_id \"EventType\" FROM events WHERE event_type <> 'error'")
def _(spark, sf):
    e = t.table(spark, sf, "events")
    f = ["S", "1", "2024", F.concat(F.lit("session "), F.col("user_id")), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")), "0", F.concat(F.lit("e"), F.col("event_id")), "c", "1", "a", "b", "x"]
    v = F.concat_ws(";", *[F.lit(x) if isinstance(x, str) else x for x in f])
    return rd.read_event_log(spark, lines(e.select(v.alias("value")), "log")).select("SessionId", "TaskName", "EventType")


@query("s06_read_task_snapshots", "SELECT 'sudoku' task, p_partkey::VARCHAR item, p_brand author, p_type answer, NULL::VARCHAR editable FROM part UNION ALL SELECT 'raven', s_suppkey::VARCHAR, s_name, NULL, NULL FROM supplier")
def _(spark, sf):
    a = put(t.table(spark, sf, "part").select(F.col("p_partkey").alias("Cell Index"), F.col("p_brand").alias("LastAuthor"), F.col("p_type").alias("answer")), "sudoku", header=True)
    b = put(t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("field index"), F.col("s_name").alias("last_subject_author")), "raven", header=True, sep=";")
    return rd.read_task_snapshots(spark, {"sudoku": f"{a}/*.csv", "raven": f"{b}/*.csv"}).select("task", "item", "author", "answer", "editable")


@query("s07_read_task_scores", "SELECT 'bim001' group_id, o_custkey::VARCHAR \"SessionId\", o_orderstatus \"TaskName\", o_totalprice \"TotalScore\" FROM orders")
def _(spark, sf):
    o = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("SessionId"), F.col("o_orderstatus").alias("TaskName"), F.col("o_totalprice").alias("TotalScore"))
    return rd.read_task_scores(spark, put(o, "BIM001", header=True)).select("group_id", "SessionId", "TaskName", "TotalScore")


def survey(spark, sf):
    c = t.table(spark, sf, "customer")
    d = c.select(F.col("c_custkey").alias("ID"), F.col("c_mktsegment").alias("Groupe"), (F.col("c_custkey") % 9 + 1).alias("G1Q00001[COR01]"), (F.col("c_nationkey") % 9 + 1).alias("G2Q00001[SOC02]"))
    return rd.read_survey_wide(spark, put(d, "survey", header=True, sep=";"))


@query("s08_read_survey_wide", "SELECT c_custkey::VARCHAR participant, 'COR01' item, 'COR' dimension, (c_custkey % 9 + 1)::DOUBLE score FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'SOC02', 'SOC', (c_nationkey % 9 + 1)::DOUBLE FROM customer")
def _(spark, sf):
    from colloquy.functions import scalars as fn
    d = survey(spark, sf)
    _meta, items = rd.survey_columns(d)
    l = d.unpivot(["ID"], [F.col(f"`{i}`") for i in items], "column", "value")
    return l.select(F.col("ID").alias("participant"), fn.item_of(F.col("column")).alias("item"), fn.dimension_of(F.col("column")).alias("dimension"), rd.numeric_text(F.col("value")).alias("score"))


@query("s09_read_placements", "WITH m AS (SELECT max(p_partkey // 100) m FROM part) SELECT p_name || '(Clone)' AS name, p_size + 0.25::DOUBLE x, 0.0::DOUBLE y, -p_size::DOUBLE z FROM part, m WHERE p_partkey // 100 = m")
def _(spark, sf):
    p = t.table(spark, sf, "part").select(F.concat(
        F.floor(F.col("p_partkey") / 100), F.lit(",0, "), "p_name", F.lit("(Clone), ("), F.col("p_size"), F.lit(".25, 0.00, -"), F.col("p_size"), F.lit(".0)")).alias("value"))
    return rd.read_placements(spark, lines(p.coalesce(1), "place")).select("name", "x", "y", "z")


@query("s10_read_cad_export", "SELECT 'W' || p_partkey \"ElementName\", p_size::DOUBLE \"PositionX\" FROM part")
def _(spark, sf):
    p = t.table(spark, sf, "part")
    body = p.select(F.concat(F.lit("x,"), F.col("p_size"), F.lit(",W"), F.col("p_partkey")).alias("value"), (F.col("p_partkey") + 10).alias("o"))
    head = p.limit(1).select(F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("o"), F.lit(v).alias("value")) for i, v in enumerate(["exported", "units m", "Kind,PositionX,ElementName"])])).alias("h")).select("h.value", "h.o")
    d = head.unionByName(body).coalesce(1).sortWithinPartitions("o")
    return rd.read_cad_export(spark, lines(d, "cad"), ["ElementName", "PositionX"], ["PositionX"]).drop("source_file")


@query("s11_read_rule_reports", "SELECT (s_suppkey % 2 + 1)::INT n_rules_passed, 3 n_rules_total FROM supplier")
def _(spark, sf):
    s = t.table(spark, sf, "supplier")
    m = F.create_map(F.lit("R1"), F.lit("true"), F.lit("R2"), F.when(F.col("s_suppkey") % 2 == 1, "vrai").otherwise("faux"), F.lit("R3"), F.lit("false"))
    p = stage_path(spark, "rules")
    d = s.select((F.col("s_suppkey") % 100).alias("folder"), "s_suppkey", F.to_json(F.struct(m.alias("rules"), F.lit(0).alias("n_rules_passed"))).alias("report"))
    put_files(d.repartition(100, "folder").select(F.concat(F.lit("folder="), "folder", F.lit("/"), "s_suppkey", F.lit(".json")).alias("name"), F.col("report").alias("body")), p)
    return rd.read_rule_reports(spark, p).select("n_rules_passed", "n_rules_total")


@query("s12_merge_performance", "SELECT s_suppkey layout_id, NULL::DOUBLE n_expected, NULL::DOUBLE n_placed, CASE WHEN s_suppkey % 2 = 0 THEN 5.0 ELSE 7.0 END::DOUBLE n_matched, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END duration_s, s_acctbal / 2 sum_distance_m FROM supplier")
def _(spark, sf):
    s = t.table(spark, sf, "supplier").withColumn("layout_id", F.col("s_suppkey"))
    a = s.where("s_suppkey % 2 = 0").select("layout_id", F.lit(5.0).alias("n_matched"), F.col("s_acctbal").alias("duration_s"))
    b = s.select("layout_id", F.lit(7.0).alias("n_matched"), (F.col("s_acctbal") / 2).alias("sum_distance_m"))
    return rd.merge_performance(s.select("layout_id"), [a, b])


@query("s12_read_performance_summary", "SELECT count(*) n, round(sum(s_acctbal), 2) total FROM supplier")
def _(spark, sf):
    s = t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("layout_id"), F.col("s_acctbal").alias("sum_distance_m"), F.lit(3).alias("n_matched"))
    d = rd.read_performance_summary(spark, None, put(s, "perf", header=True), None)
    return d.agg(F.count("*").alias("n"), F.round(F.sum("sum_distance_m"), 2).alias("total"))


@query("s13_discover_sessions", "SELECT DISTINCT 'bim' || lpad((s_suppkey % 10)::VARCHAR, 3, '0') group_id, CASE WHEN s_suppkey % 2 = 0 THEN 'VR' ELSE 'PC' END condition, 'S1' scenario, 'T1' timepoint FROM supplier")
def _(spark, sf):
    p = stage_path(spark, "root")
    s = t.table(spark, sf, "supplier").select(
        F.concat(F.lit("T1_x/"), F.when(F.col("s_suppkey") % 2 == 0, "VR").otherwise("PC"), F.lit("/S1/bim"), F.lpad((F.col("s_suppkey") % 10).cast("string"), 3, "0")).alias("d"), "s_name")
    for r in s.select("d").distinct().collect():  # a folder per recording; at most 10 here
        s.where(F.col("d") == r["d"]).select("s_name").coalesce(1).write.csv(f"{p}/{r['d']}")
    return rd.discover_sessions(spark, p, "*.csv").select("group_id", "condition", "scenario", "timepoint").distinct()


@query("s14_read_speaking_turns", t.with_(t.SEG) + "SELECT session_id::VARCHAR session_id, role, round(start_s, 3) start_s, round(end_s, 3) end_s FROM seg WHERE round(end_s, 3) > round(start_s, 3)")
def _(spark, sf):
    s = t.segments(spark, sf).select("session_id", F.col("role").alias("Speaker"), F.round("start_s", 3).alias("t_start"), F.round("end_s", 3).alias("t_end"))
    return rd.read_speaking_turns(spark, put(s, "turns", header=True))


@query("s15_read_reference_population", "SELECT c_acctbal \"TeamEffort\", c_nationkey::DOUBLE \"TeamCoverage\" FROM customer")
def _(spark, sf):
    c = t.table(spark, sf, "customer").select(F.col("c_acctbal").alias("TeamEffort"), F.col("c_nationkey").alias("TeamCoverage"), "c_name")
    return rd.read_reference_population(spark, put(c, "pop", header=True), ["TeamEffort", "TeamCoverage"])


@query("s16_write_tables", t.with_(t.FEAT) + "SELECT unit_id, price, condition, scenario FROM feat WHERE condition = 'VR'")
def _(spark, sf):
    p = stage_path(spark, "out")
    sinks.write_tables({"features": t.features(spark, sf).select("unit_id", "price", "condition", "scenario")}, p)
    return spark.read.parquet(f"{p}/features").where("condition = 'VR'").select("unit_id", "price", "condition", "scenario")


@query("s17_export_merged_bundle", t.with_(t.FEAT) + "SELECT 'cost' block, 2 n_columns, (SELECT count(*) - count(rebate) FROM feat) n_missing UNION ALL SELECT 'other', 3, 0")
def _(spark, sf):
    f = t.features(spark, sf).select("unit_id", "condition", "scenario", "price", "rebate")
    p = stage_path(spark, "bundle")
    sinks.export_merged_bundle(sinks.merged_bundle(f, {"price": "cost", "rebate": "cost"}, ["condition", "scenario"], "unit_id", {"features": f}), p)
    return spark.read.parquet(f"{p}/blocks").select("block", "n_columns", "n_missing")


STI = """pt AS (SELECT session_id, role, floor(t / 900)::BIGINT part, t - floor(t / 900) * 900 t, value FROM samp), df AS (SELECT *, t - lag(t) OVER (PARTITION BY session_id, role, part ORDER BY t) d FROM pt),
ag AS (SELECT session_id, role, part, min(t) a, max(t) b, coalesce(quantile_cont(d, 0.5) FILTER (d > 0), 0) dt FROM df GROUP BY ALL), sh AS (SELECT *, sum(b - a + dt) OVER w - (b - a + dt) + first_value(a) OVER w - a shift_s FROM ag WINDOW w AS (PARTITION BY session_id, role ORDER BY part))"""


@query("s18_stitch_chunks", t.with_(t.SAMP, STI) + "SELECT session_id, role, part, round(t + shift_s, 3) t, value FROM pt JOIN sh USING (session_id, role, part)")
def _(spark, sf):
    s = t.samples(spark, sf).withColumn("part", F.floor(F.col("t") / 900).cast("long"))
    s = s.withColumn("t", F.col("t") - F.col("part") * 900).withColumn("is_marker", F.lit(False))
    o = rd.stitch_chunks(s, ["session_id", "role"], "part", "t", 60.0)
    return rnd(o.select("session_id", "role", "part", "t", "value"), "t", d=3)


@query("s19_load_sources", "SELECT 'bim' || lpad(c_custkey::VARCHAR, greatest(3, length(c_custkey::VARCHAR))::INT, '0') group_id, c_acctbal score FROM customer")
def _(spark, sf):
    c = t.table(spark, sf, "customer").select(F.concat(F.lit("BIM "), F.col("c_custkey")).alias("Group"), eu_number("c_acctbal").alias("Score_total"))
    p = put(c, "src", header=True, sep=";")
    d = rd.load_sources(spark, {"perf": {"path": f"{p}/*.csv", "candidates": {"group_id": ["group_id", "group"], "score": ["score", "score_total"]}, "numeric": ["score"]}})
    return d["perf"].select("group_id", "score")


@query("s20_load_scores", "SELECT 'bim' || lpad(s_suppkey::VARCHAR, greatest(3, length(s_suppkey::VARCHAR))::INT, '0') group_id, s_acctbal score FROM supplier")
def _(spark, sf):
    return rd.load_scores(t.table(spark, sf, "supplier").withColumn("g", F.col("s_suppkey")), ["gid", "g"], ["s_acctbal"])


@query("s21_load_face", "SELECT vec_id::DOUBLE \"Timestamp\", round(embedding[1]::DOUBLE, 5) \"CheekRaiser\" FROM embeddings")
def _(spark, sf):
    e = t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("timestamp"), F.regexp_replace(F.round(F.col("embedding")[0].cast("double"), 5).cast("decimal(12,5)").cast("string"), "\\.", ",").alias("AU06_r"))
    return rd.load_face(spark, f"{put(e, 'face', header=True, sep=';')}/*.csv", {"Timestamp": ["Timestamp"], "CheekRaiser": ["CheekRaiser", "AU06_r"]}).drop("source_file")


@query("s22_availability_of_layers", t.with_(t.SEG, t.DIRS) + "SELECT DISTINCT session_id, true has_speech, session_id IN (SELECT session_id FROM dirs) has_gaze FROM seg")
def _(spark, sf):
    s = t.segments(spark, sf)
    _layers, av = rd.load_interaction_streams({"speech": s, "gaze": t.directions(spark, sf)}, s.select("session_id").distinct())
    return av


# ---- streaming -----------------------------------------------------------------------
def stream(spark, sf):
    """Events as a file stream with a timestamp column."""
    schema = t.table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf}/event*.parquet")
    return e.select(
        F.floor(F.col("user_id") / 3).cast("long").alias("session_id"), F.concat(F.lit("r"), F.col("user_id") % 3).alias("role"),
        F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_type").alias("object"), "event_id",
    )


def drain(df, name):
    """Run a stream over what is there, into a table in the stage folder."""
    spark = df.sparkSession
    out, chk = stage_path(spark, name), stage_path(spark, f"{name}-progress")
    q = df.writeStream.format("parquet").option("checkpointLocation", chk).outputMode("append").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


MX = "(SELECT max(ts) FROM events)"


@query("st02_window_descriptors", f"""WITH w AS (SELECT user_id // 3 session_id, 'r' || (user_id % 3) AS role, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2024-01-01') - k * INTERVAL 6 HOURS s, ts, value FROM events, range(0, 2) r(k)), g AS (SELECT session_id, role, epoch_us(s) t0, count(*) n, round(avg(value), 6) value_mean, s FROM w GROUP BY ALL)
SELECT session_id, role, t0, n, value_mean FROM g WHERE s + INTERVAL 12 HOURS <= {MX} - INTERVAL 1 HOUR""")
def _(spark, sf):
    w = live.window_means(stream(spark, sf), ["session_id", "role"], ["value"], "12 hours", "6 hours", "1 hour")
    d = drain(w, "windows")
    return rnd(d.select("session_id", "role", F.unix_micros("t_start").alias("t0"), "n", "value_mean"), "value_mean")


@query("st03_session_gaps", f"""WITH o AS (SELECT user_id // 3 session_id, ts, lag(ts) OVER (PARTITION BY user_id // 3 ORDER BY ts) p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 2 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts) i FROM o)
SELECT session_id, epoch_us(min(ts)) t0, count(*) n FROM s GROUP BY session_id, i HAVING max(ts) + INTERVAL 2 HOURS <= {MX} - INTERVAL 1 HOUR""")
def _(spark, sf):
    d = drain(live.activity_sessions(stream(spark, sf), ["session_id"], "2 hours", "1 hour"), "bursts")
    return d.select("session_id", F.unix_micros("t_start").alias("t0"), "n")


@query("st04_stream_interval_join", """WITH e AS (SELECT user_id // 3 session_id, 'r' || (user_id % 3) AS role, ts, event_type, event_id FROM events)
SELECT a.session_id, a.role, epoch_us(a.ts) onset_us, epoch_us(b.ts) look_us, b.event_type target FROM e a JOIN e b ON a.session_id = b.session_id AND a.role = b.role AND a.event_type = 'purchase' AND b.event_type = 'view' AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 4 HOURS""")
def _(spark, sf):
    s = stream(spark, sf)
    j = live.gaze_before_speech(s.where("object = 'purchase'"), s.where("object = 'view'").withColumnRenamed("object", "target"), "4 hours", "1 day")
    return drain(j, "looks").select("session_id", "role", F.unix_micros("onset_ts").alias("onset_us"), F.unix_micros("look_ts").alias("look_us"), "target")


@query("st05_stream_dedup", "SELECT user_id // 3 session_id, count(*) n FROM events GROUP BY ALL")
def _(spark, sf):
    s = stream(spark, sf)
    twice = s.unionByName(stream(spark, sf))
    d = drain(live.dedup(twice, ["event_id"], "1 hour"), "dedup")
    return d.groupBy("session_id").agg(F.count("*").alias("n"))


@query("st01_live_speech_metrics")
def _(spark, sf):
    s = stream(spark, sf)
    us = (F.unix_micros("ts") - F.lit(t.EPOCH_US)) / 1e9
    seg = s.select("session_id", "role", us.alias("start_s"), (us + F.col("value") / 10).alias("end_s"), "ts")
    return drain(live.live_turns(seg, scale=1000.0), "turns")
