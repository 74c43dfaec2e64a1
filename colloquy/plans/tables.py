"""The given tables seen as recordings, logs and questionnaires.

Every function has a SQL twin (a CTE body) so that a query and its oracle start from
the same rows. Times are integers in microseconds until the last division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.session import pin

EPOCH_US = 1704067200000000  # 2024-01-01T00:00:00Z


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return pin(spark).read.parquet(f"{sf}/{name}.parquet")


def us(col: str):
    return F.unix_micros(F.col(col).cast("timestamp")) - F.lit(EPOCH_US)


def with_(*ctes: str) -> str:
    """``WITH`` clause over CTE bodies defined in this module."""
    return "WITH " + ", ".join(ctes) + " "


# Speech segments: three users share a session; one second of the recording is 1000 s
# of event time, so a session lasts about 43 minutes.
SEG = f"""seg AS (
  SELECT user_id // 3 AS session_id, 'r' || (user_id % 3) AS role,
         (epoch_us(ts) - {EPOCH_US}) / 1e9 AS start_s,
         (epoch_us(ts) - {EPOCH_US} + CAST(round(value * 1e8) AS BIGINT)) / 1e9 AS end_s
  FROM events)"""


def segments(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    t = us("ts")
    return e.select(
        F.floor(F.col("user_id") / 3).cast("long").alias("session_id"),
        F.concat(F.lit("r"), F.col("user_id") % 3).alias("role"),
        (t / F.lit(1e9)).alias("start_s"),
        ((t + F.round(F.col("value") * 1e8).cast("long")) / F.lit(1e9)).alias("end_s"),
    )


SEG_CHUNK_S = 60.0
TOTAL_S = 2600.0

# Irregular samples of one signal per participant.
SAMP = f"""samp AS (
  SELECT user_id // 3 AS session_id, 'r' || (user_id % 3) AS role,
         (epoch_us(ts) - {EPOCH_US}) / 1e9 AS t, value,
         (event_type = 'view') AS state, event_type AS object
  FROM events)"""


def samples(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.floor(F.col("user_id") / 3).cast("long").alias("session_id"),
        F.concat(F.lit("r"), F.col("user_id") % 3).alias("role"),
        (us("ts") / F.lit(1e9)).alias("t"),
        "value",
        (F.col("event_type") == "view").alias("state"),
        F.col("event_type").alias("object"),
    )


# Regular frames: loudest value of each 10 s frame.
FRM = f"""frm AS (
  SELECT user_id // 3 AS session_id, 'r' || (user_id % 3) AS role,
         (epoch_us(ts) - {EPOCH_US}) // 10000000000 AS frame_idx, max(value) AS rms
  FROM events GROUP BY ALL)"""


def frames(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(
        F.floor(F.col("user_id") / 3).cast("long").alias("session_id"),
        F.concat(F.lit("r"), F.col("user_id") % 3).alias("role"),
        F.floor(us("ts") / F.lit(10000000000)).cast("long").alias("frame_idx"),
    ).agg(F.max("value").alias("rms"))


# Unit direction and head position per participant and grid frame.
DIRS = """raw3 AS (
  SELECT vec_id // 150 AS session_id, 'r' || (vec_id % 3) AS role,
         (vec_id % 150) // 3 AS frame_idx,
         embedding[1]::DOUBLE AS dx0, embedding[2]::DOUBLE AS dy0, embedding[3]::DOUBLE AS dz0,
         embedding[4]::DOUBLE * 10 AS px, embedding[5]::DOUBLE * 10 AS py, embedding[6]::DOUBLE * 10 AS pz
  FROM embeddings),
dirs AS (
  SELECT session_id, role, frame_idx, px, py, pz,
         dx0 / sqrt(dx0*dx0+dy0*dy0+dz0*dz0) AS dx,
         dy0 / sqrt(dx0*dx0+dy0*dy0+dz0*dz0) AS dy,
         dz0 / sqrt(dx0*dx0+dy0*dy0+dz0*dz0) AS dz
  FROM raw3)"""


def directions(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    v = lambda i: F.col("embedding")[i].cast("double")
    r = e.select(
        F.floor(F.col("vec_id") / 150).cast("long").alias("session_id"),
        F.concat(F.lit("r"), F.col("vec_id") % 3).alias("role"),
        F.floor((F.col("vec_id") % 150) / 3).cast("long").alias("frame_idx"),
        v(0).alias("dx0"), v(1).alias("dy0"), v(2).alias("dz0"),
        (v(3) * 10).alias("px"), (v(4) * 10).alias("py"), (v(5) * 10).alias("pz"),
    )
    n = F.sqrt(
        F.col("dx0") * F.col("dx0") + F.col("dy0") * F.col("dy0") + F.col("dz0") * F.col("dz0")
    )
    return r.select(
        "session_id", "role", "frame_idx", "px", "py", "pz",
        (F.col("dx0") / n).alias("dx"), (F.col("dy0") / n).alias("dy"), (F.col("dz0") / n).alias("dz"),
    )


# Numeric features, one row per supplier (unit) with two grouping labels.
FEAT = """feat AS (
  SELECT l_suppkey AS unit_id, 'n' || (l_suppkey % 5) AS family_key,
         CASE WHEN l_suppkey % 2 = 0 THEN 'VR' ELSE 'PC' END AS condition,
         CASE WHEN l_suppkey % 3 = 0 THEN 'S1' ELSE 'S2' END AS scenario,
         round(avg(l_quantity), 6) AS quantity, round(avg(l_extendedprice), 4) AS price,
         round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax,
         CASE WHEN l_suppkey % 7 = 3 THEN NULL ELSE round(avg(l_extendedprice * l_discount), 4) END AS rebate,
         count(*)::DOUBLE AS lines
  FROM lineitem GROUP BY l_suppkey)"""

FEATURES = ["quantity", "price", "discount", "tax", "rebate", "lines"]


def features(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    g = li.groupBy(F.col("l_suppkey").alias("unit_id")).agg(
        F.round(F.avg("l_quantity"), 6).alias("quantity"),
        F.round(F.avg("l_extendedprice"), 4).alias("price"),
        F.round(F.avg("l_discount"), 6).alias("discount"),
        F.round(F.avg("l_tax"), 6).alias("tax"),
        F.round(F.avg(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("rebate"),
        F.count("*").cast("double").alias("lines"),
    )
    return g.select(
        "unit_id",
        F.concat(F.lit("n"), F.col("unit_id") % 5).alias("family_key"),
        F.when(F.col("unit_id") % 2 == 0, "VR").otherwise("PC").alias("condition"),
        F.when(F.col("unit_id") % 3 == 0, "S1").otherwise("S2").alias("scenario"),
        "quantity", "price", "discount", "tax",
        F.when(F.col("unit_id") % 7 != 3, F.col("rebate")).alias("rebate"),
        "lines",
    )


# Questionnaire answers: item 1..7, Likert score 1..9.
RESP = """resp AS (
  SELECT l_orderkey % 200 AS participant, l_orderkey % 20 AS group_id,
         'Q' || l_linenumber AS item, 'D' || (l_linenumber % 2) AS dimension,
         round(avg(1 + CAST(l_quantity AS INTEGER) % 9), 6) AS score
  FROM lineitem GROUP BY ALL)"""


def responses(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy(
        (F.col("l_orderkey") % 200).alias("participant"),
        (F.col("l_orderkey") % 20).alias("group_id"),
        F.concat(F.lit("Q"), F.col("l_linenumber")).alias("item"),
        F.concat(F.lit("D"), F.col("l_linenumber") % 2).alias("dimension"),
    ).agg(F.round(F.avg(1 + F.col("l_quantity").cast("int") % 9), 6).alias("score"))


# Task log: supplier = subject, part = item, order key / 2 = group-task.
TASK = """task AS (
  SELECT l_orderkey // 8 AS group_id, 'T' || (l_orderkey % 3) AS task, l_suppkey % 7 AS subject,
         l_partkey % 50 AS item, l_linenumber AS line, l_orderkey AS seq, epoch_us(l_shipdate) AS t_us,
         l_quantity AS effort, l_returnflag AS answer,
         CASE l_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS truth
  FROM lineitem)"""


def task_log(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    k = F.col("l_partkey") % 3
    return li.select(
        F.floor(F.col("l_orderkey") / 8).cast("long").alias("group_id"),
        F.concat(F.lit("T"), F.col("l_orderkey") % 3).alias("task"),
        (F.col("l_suppkey") % 7).alias("subject"),
        (F.col("l_partkey") % 50).alias("item"),
        F.col("l_linenumber").alias("line"),
        F.col("l_orderkey").alias("seq"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("t_us"),
        F.col("l_quantity").alias("effort"),
        F.col("l_returnflag").alias("answer"),
        F.when(k == 0, "A").when(k == 1, "N").otherwise("R").alias("truth"),
    )
