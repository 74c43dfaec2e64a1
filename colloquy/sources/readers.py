"""Readers for recordings, logs, questionnaires and reports (S-01 to S-15, S-18 to S-22).

Files are read as text columns under a declared schema, then typed leniently: a field
that does not parse becomes NULL, never a failed job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from colloquy.functions.scalars import parse_boolean
from colloquy.operators import keys as ky
from colloquy.operators.episodes import median_step
from colloquy.operators.keys import conform, numeric_text
from colloquy.operators.scan import running_sum, attach, scan
from colloquy.session import cut


def text_schema(cols: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in cols])


def header_of(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Column names of the first line (one line is read)."""
    first = spark.read.text(path).limit(1).collect()
    return [c.strip().strip('"').lstrip("﻿") for c in first[0][0].split(sep)] if first else []


def read_eu_csv(spark: SparkSession, path: str, numeric: Sequence[str] = (), sep: str = ";") -> DataFrame:
    """S-01: semicolon file with decimal commas."""
    d = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    return ky.to_numeric(ky.strip_column_names(d), numeric)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file; ``i`` orders the lines of a file's first block."""
    m = F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("off")
    return spark.read.text(path).select(*m, F.monotonically_increasing_id().alias("i"), F.regexp_replace("value", "^\ufeff", "").alias("value"))


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """S-02: dialect of each file from its first lines: the separator giving most columns.

    A ``sep=x`` first line decides, and the header is then the second line. All files are
    scored in one job; each file contributes two lines.
    """
    t = _lines(spark, path).where("off = 0")
    first = t.groupBy("source_file").agg(F.min_by("value", "i").alias("first"), F.min("i").alias("_i"))
    second = attach(t, first.select("source_file", "_i"), ["source_file"], "inner").where("i > _i")
    second = second.groupBy("source_file").agg(F.min_by("value", "i").alias("second"))
    f = first.join(second, "source_file", "left")
    told = F.regexp_extract("first", r"^sep=(.)", 1)
    head = F.when(told != "", F.col("second")).otherwise(F.col("first"))
    n = lambda s: F.size(F.split(head, s))
    sep = F.when(told != "", told).when((n(";") >= n(",")) & (n(";") >= n("\t")), ";").when(n(",") >= n("\t"), ",").otherwise("\t")
    return f.select("source_file", sep.alias("sep"), head.alias("head"))


def read_csv_sniff(spark: SparkSession, path: str) -> DataFrame:
    """S-02: files of mixed dialects in one table; columns missing in a file are NULL.

    One parse per distinct header (a handful of schema versions), not per file.
    """
    f = cut(sniff(spark, path))
    lines = attach(_lines(spark, path).select("source_file", "value"), f, ["source_file"], "inner")
    body = lines.where((F.col("value") != F.col("head")) & ~F.col("value").rlike(r"^sep=.$") & (F.col("value") != ""))
    parts = []
    for r in f.select("sep", "head").distinct().collect():
        cols = [c.strip().strip('"') for c in r["head"].split(r["sep"])]
        row = F.from_csv("value", F.lit(", ".join(f"`{c}` string" for c in cols)), {"sep": r["sep"]})
        mine = body.where((F.col("sep") == r["sep"]) & (F.col("head") == r["head"]))
        parts.append(mine.select("source_file", row.alias("r")).select("r.*", "source_file"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def quoted(sep: str) -> str:
    """A separator as a pattern that matches it literally."""
    return "\\Q" + sep + "\\E"


def read_csv_tolerant(spark: SparkSession, path: str, cols: Sequence[str], sep: str = ";", header: bool = True) -> tuple[DataFrame, DataFrame]:
    """S-03: good rows and the rejected lines (those with another number of fields)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), "value")
    d = lines.withColumn("_f", F.from_csv("value", F.lit(", ".join(f"`{c}` string" for c in [*cols, "_more"])), {"sep": sep, "mode": "PERMISSIVE"}))
    n = F.size(F.split(F.regexp_replace("value", '"[^"]*"', "q"), quoted(sep)))
    head = (F.col(f"_f.{cols[0]}") == cols[0]) if header else F.lit(False)
    d = d.where(~F.coalesce(head, F.lit(False)) & (F.col("value") != ""))
    ok = n == len(cols)
    return d.where(ok).select(*[F.col(f"_f.`{c}`").alias(c) for c in cols], "source_file"), d.where(~ok).select("value", "source_file")


def read_sensor_stream(spark: SparkSession, path: str, cols: Sequence[str], time: str, sep: str = ";") -> tuple[DataFrame, DataFrame]:
    """S-04: data rows and MARKER rows of a stream; END and header lines are skipped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), F.split("value", quoted(sep)).alias("f"), "value")
    up = F.upper("value")
    marker, end = up.contains("MARKER"), F.trim(up).startswith("END")
    t0 = numeric_text(F.get("f", 0))
    markers = lines.where(marker & t0.isNotNull()).select("source_file", t0.alias(time))
    at = {c: i for i, c in enumerate(cols)}
    rows = lines.where(~marker & ~end & (F.size("f") >= len(cols))).select("source_file", *[F.trim(F.get("f", at[c])).alias(c) for c in cols])
    rows = rows.withColumn(time, numeric_text(F.col(time))).where(F.col(time).isNotNull())
    return rows, markers


# The columns of an event log file, in their order.
EVENT_COLUMNS = [
    "StudyPrefix", "SessionSuffix", "SessionStartDate", "SessionId", "TaskName", "SoloTask", "EventType", "EventContent", "Timestamp",
    "SenderSubjectExternalId", "ReceiverSubjectExternalId", "SummaryDescription",
]


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """S-05: twelve fixed columns after one header line; rows without session or task drop."""
    good, _bad = read_csv_tolerant(spark, path, EVENT_COLUMNS)
    d = good.withColumn("SessionId", F.regexp_extract("SessionId", r"(\d+)", 1))
    return d.where((F.col("SessionId") != "") & (F.trim("TaskName") != "") & F.col("EventType").isNotNull())


# Header names of snapshot files for each field.
SNAPSHOT = {
    "item": ["cell index", "cell_index", "field index", "item", "field", "index", "id"], "author": ["Last subject author", "last_subject_author", "LastAuthor"],
    "answer": ["Answer", "response"], "truth": ["Ground Truth", "ground_truth", "correct", "solution", "expected"], "editable": ["is_editable", "editable", "modifiable"],
}


def read_task_snapshots(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """S-06: final state per task, header names unified. ``paths``: task -> glob."""
    parts = [conform(read_csv_sniff(spark, p), {**SNAPSHOT, "source_file": ["source_file"]}).withColumn("task", F.lit(t)) for t, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def require(df: DataFrame, cols: Sequence[str], what: str) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
    return df


def read_task_scores(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """S-07: required columns checked before any job; the group comes from the path."""
    d = spark.read.csv(path, sep=sep, header=True).select("*", F.col("_metadata.file_path").alias("source_file"))
    require(d, ["SessionId", "TaskName", "TotalScore"], "task scores")
    gid = F.regexp_extract("source_file", r"(?i)(bim\d+(?:_\d+)?)", 1)
    return d.withColumn("TotalScore", numeric_text(F.col("TotalScore"))).withColumn("group_id", F.when(gid != "", F.lower(gid)))


def read_survey_wide(spark: SparkSession, path: str) -> DataFrame:
    """S-08"""
    return ky.strip_column_names(spark.read.csv(path, sep=";", header=True, multiLine=True))


def survey_columns(df: DataFrame, pattern: str = r"^G\d+Q\d+.*\[[A-Za-z]+\d+\]") -> tuple[list[str], list[str]]:
    """S-08: (meta columns, item columns) by name."""
    import re

    items = [c for c in df.columns if re.match(pattern, c)]
    return [c for c in df.columns if c not in items], items


NUMBER = r"([-+]?\d+(?:[.,]\d+)?)"


def read_placements(spark: SparkSession, path: str) -> DataFrame:
    """S-09: lines "t, name, (x, y, z)", decimal comma or point; the rows of the last moment."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("layout_id"), "value")
    pat = rf"^\s*{NUMBER}\s*[,;]\s*([^,;(]+(?:\([A-Za-z]+\))?)\s*[,;]\s*\(\s*{NUMBER}\s*,\s*{NUMBER}\s*,\s*{NUMBER}\s*\)"
    g = lambda i: F.regexp_extract("value", pat, i)
    d = lines.select("layout_id", numeric_text(g(1)).alias("t"), F.trim(g(2)).alias("name"), numeric_text(g(3)).alias("x"), numeric_text(g(4)).alias("y"), numeric_text(g(5)).alias("z"))
    d = d.where("t is not null and name != ''")
    last = d.groupBy("layout_id").agg(F.max("t").alias("_t"))
    return attach(d, last, ["layout_id"]).where("t = _t").drop("_t")


def read_cad_export(spark: SparkSession, path: str, cols: Sequence[str], numeric: Sequence[str], sep: str = ",") -> DataFrame:
    """S-10: table whose header row may come late; lines before it are ignored."""
    t = _lines(spark, path)
    head = reduce(lambda a, b: a & b, [F.lower("value").contains(c.lower()) for c in cols])
    at = t.where(head & (F.col("off") == 0)).groupBy("source_file").agg(F.min("i").alias("_h"), F.min_by("value", "i").alias("_head"))
    d = attach(t, at, ["source_file"], "inner").where("(off > 0 or i > _h) and value != ''")
    names = F.transform(F.split("_head", sep), lambda c: F.lower(F.trim(c)))
    f = F.split("value", sep)
    pick = lambda c: F.trim(F.get(f, F.array_position(names, c.lower()) - 1))
    return d.select("source_file", *[numeric_text(pick(c)).alias(c) if c in numeric else pick(c).alias(c) for c in cols])


def read_rule_reports(spark: SparkSession, path: str) -> DataFrame:
    """S-11: JSON reports with a map of rules; counts from the map, else as written."""
    schema = "rules map<string,string>, n_rules_passed int, n_rules_total int"
    d = spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("layout_id"))
    vals = F.map_values("rules")
    passed = F.size(F.filter(vals, lambda v: parse_boolean(v)))
    has = F.col("rules").isNotNull() & (F.size("rules") > 0)
    return d.select("layout_id", "rules", F.when(has, passed).otherwise(F.col("n_rules_passed")).alias("n_rules_passed"), F.when(has, F.size("rules")).otherwise(F.col("n_rules_total")).alias("n_rules_total"))


PERFORMANCE = ["n_expected", "n_placed", "n_matched", "duration_s", "sum_distance_m"]


def merge_performance(layouts: DataFrame, sources: Sequence[DataFrame]) -> DataFrame:
    """S-12: each measure from the first source that has it (sources in priority order)."""
    d = layouts
    for i, s in enumerate(sources):
        d = d.join(s.select("layout_id", *[F.col(c).cast("double").alias(f"_{i}_{c}") for c in PERFORMANCE if c in s.columns]), "layout_id", "left")
    pick = lambda c: F.coalesce(*[F.col(f"_{i}_{c}") for i, s in enumerate(sources) if c in s.columns], F.lit(None).cast("double"))
    return d.select(*layouts.columns, *[pick(c).alias(c) for c in PERFORMANCE])


def read_performance_summary(spark: SparkSession, json_path: str | None, csv_path: str | None, pairs: DataFrame | None) -> DataFrame:
    """S-12: JSON summary, else CSV aggregate, else counts from the matched pairs."""
    src = []
    if json_path:
        sch = ", ".join(f"{c} double" for c in PERFORMANCE)
        src.append(spark.read.schema(sch).option("multiLine", True).json(json_path).select("*", F.col("_metadata.file_path").alias("layout_id")))
    if csv_path:
        src.append(ky.to_numeric(spark.read.csv(csv_path, header=True), PERFORMANCE))
    if pairs is not None:
        src.append(pairs.groupBy("layout_id").agg(F.count("*").alias("n_matched"), F.sum("dist").alias("sum_distance_m")))
    ids = reduce(lambda a, b: a.unionByName(b), [s.select("layout_id") for s in src]).distinct()
    return merge_performance(ids, src)


def discover_sessions(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """S-13: recordings under a root with their keys; the newest file of each kind.

    Only names and times are listed; file contents are not read.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "modificationTime", "length")
    p = F.col("path")
    gid = F.regexp_extract(F.lower(p), r"(bim\d+(?:_\d+)?)", 1)
    kind = F.regexp_extract(F.lower(p), r"([a-z_]+)[^/]*\.(?:csv|txt|json|parquet)$", 1)
    d = f.select("path", "modificationTime", ky.parse_condition(p).alias("condition"), ky.parse_scenario(p).alias("scenario"), ky.parse_timepoint(p).alias("timepoint"), gid.alias("group_id"), kind.alias("kind"))
    k = ["group_id", "condition", "scenario", "timepoint", "kind"]
    return d.groupBy(*k).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"), F.count("*").alias("n_files"))


# Header names of speaking-turn files for each field.
TURN_COLUMNS = {
    "session_id": ["session_id", "source_file"], "role": ["speaker", "participant"], "start_s": ["onset", "start", "start_s", "t_start"],
    "end_s": ["offset", "end", "end_s", "t_end"],
}


def read_speaking_turns(spark: SparkSession, path: str) -> DataFrame:
    """S-14: speaker, onset, offset under any of their names; empty turns drop."""
    d = conform(
        spark.read.csv(path, header=True).select("*", F.col("_metadata.file_path").alias("source_file")),
        TURN_COLUMNS,
        {"start_s": "double", "end_s": "double"},
    )
    return d.where("role is not null and start_s is not null and end_s > start_s")


def read_reference_population(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """S-15"""
    return ky.to_numeric(spark.read.csv(path, header=True), cols).select(*cols)


def stitch_chunks(samples: DataFrame, keys: Sequence[str], order: str, t: str, chunk_s: float) -> DataFrame:
    """S-18: recordings of one stream made continuous.

    Part ``order`` starts one median step after the end of the part before it. Markers
    (``is_marker``) are kept from the first part only.
    """
    keys = list(keys)
    part = samples.where("not is_marker").groupBy(*keys, order).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    dt = median_step(samples.where("not is_marker"), [*keys, order], t, chunk_s)
    p = part.join(dt, [*keys, order], "left")
    length = F.col("_b") - F.col("_a") + F.coalesce("dt_s", F.lit(0.0))
    p = scan(p.withColumn("_len", length), keys, [order], F.floor(F.col(order) / 1000).cast("long"), {"_cum": running_sum("_len")})
    first = p.groupBy(*keys).agg(F.min(order).alias("_o0"), F.min_by("_a", order).alias("_a0"))
    p = p.join(first, keys)
    shift = F.col("_a0") + F.col("_cum") - F.col("_len") - F.col("_a")
    p = p.select(*keys, order, "_o0", shift.alias("shift_s"))
    d = attach(samples, p, [*keys, order])
    d = d.where(~F.col("is_marker") | (F.col(order) == F.col("_o0")))
    return d.withColumn(t, F.col(t) + F.col("shift_s")).drop("_o0")


def load_sources(spark: SparkSession, registry: Mapping[str, Mapping]) -> dict[str, DataFrame]:
    """S-19 / S-20: every result table with canonical keys and its source path.

    ``registry``: name -> {path, candidates, numeric}.
    """
    out = {}
    for name, spec in registry.items():
        d = read_csv_sniff(spark, spec["path"])
        d = conform(d, {**spec["candidates"], "source_file": ["source_file"]}, keep_rest=True)
        d = ky.to_numeric(d, [c for c in spec.get("numeric", ()) if c in d.columns])
        if "group_id" in d.columns:
            d = d.withColumn("group_id", ky.normalize_group_id(F.col("group_id")))
        out[name] = d
    return out


def load_scores(df: DataFrame, ids: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """S-20: id and score under any of their names, id normalised."""
    d = conform(df, {"group_id": ids, "score": scores})
    return d.select(ky.normalize_group_id(F.col("group_id")).alias("group_id"), numeric_text(F.col("score")).alias("score"))


def load_face(spark: SparkSession, path: str, cols: Mapping[str, Sequence[str]]) -> DataFrame:
    """S-21: face streams of any dialect, columns unified and numeric."""
    d = conform(read_csv_sniff(spark, path), {**cols, "source_file": ["source_file"]})
    return ky.to_numeric(d, list(cols))


def availability_of_layers(sessions: DataFrame, layers: Mapping[str, DataFrame], key: str = "session_id") -> DataFrame:
    """S-22: which layers each session has."""
    d = sessions.select(key).distinct()
    for n, l in layers.items():
        d = d.join(l.select(key).distinct().withColumn(f"has_{n}", F.lit(True)), key, "left")
    return d.na.fill(False)


def load_interaction_streams(layers: Mapping[str, DataFrame], sessions: DataFrame, key: str = "session_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """S-22: the layers of the wanted sessions, and which of them exist."""
    kept = {n: d.join(sessions.select(key).distinct(), key, "left_semi") for n, d in layers.items()}
    return kept, availability_of_layers(sessions, layers, key)
