"""Keys, scalar functions, aggregates and fusion on the given tables."""

from pyspark.sql import functions as F

from colloquy.functions import scalars as fn
from colloquy.operators import aggregates as ag, fusion as fu, gaze as gz, keys as ky
from colloquy.plans import query
from colloquy.plans import tables as t
from colloquy.plans.gaze import rnd
from colloquy.session import cut
from colloquy.stats import synthesis as sy

# Recording paths and raw identifiers made from customers.
PATHS = """pa AS (SELECT c_custkey, 'data/T' || (1 + c_custkey % 2) || '_x/' || CASE WHEN c_custkey % 3 = 0 THEN 'VR' WHEN c_custkey % 3 = 1 THEN 'PC' ELSE 'other' END || '/S' || (1 + c_custkey % 4) || '/bim' || c_custkey AS path,
 'Bim ' || c_custkey || CASE WHEN c_custkey % 5 = 0 THEN '_2' ELSE '' END raw_id FROM customer)"""


def paths(spark, sf):
    c = t.table(spark, sf, "customer")
    k = F.col("c_custkey")
    cond = F.when(k % 3 == 0, "VR").when(k % 3 == 1, "PC").otherwise("other")
    return c.select(
        "c_custkey", F.concat(F.lit("data/T"), 1 + k % 2, F.lit("_x/"), cond, F.lit("/S"), 1 + k % 4, F.lit("/bim"), k).alias("path"),
        F.concat(F.lit("Bim "), k, F.when(k % 5 == 0, "_2").otherwise("")).alias("raw_id"),
    )


@query("m01_parse_path", t.with_(PATHS) + "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'VR' WHEN c_custkey % 3 = 1 THEN 'PC' ELSE 'UNK' END condition, CASE WHEN c_custkey % 4 < 2 THEN 'S' || (1 + c_custkey % 4) ELSE 'UNK' END scenario, 'T' || (1 + c_custkey % 2) timepoint FROM pa")
def _(spark, sf):
    p = F.col("path")
    return paths(spark, sf).select("c_custkey", ky.parse_condition(p).alias("condition"), ky.parse_scenario(p).alias("scenario"), ky.parse_timepoint(p).alias("timepoint"))


NORM = "CASE WHEN true THEN 'bim' || lpad(c_custkey::VARCHAR, greatest(3, length(c_custkey::VARCHAR))::INT, '0') || CASE WHEN c_custkey % 5 = 0 THEN '_2' ELSE '' END END"


@query("m03_normalize_group_id", t.with_(PATHS) + f"SELECT c_custkey, {NORM} group_id, 'bim' || lpad(c_custkey::VARCHAR, greatest(3, length(c_custkey::VARCHAR))::INT, '0') group_base_id FROM pa")
def _(spark, sf):
    d = paths(spark, sf).withColumn("group_id", ky.normalize_group_id(F.col("raw_id")))
    return d.select("c_custkey", "group_id", ky.group_base_id(F.col("group_id")).alias("group_base_id"))


@query("m02_group_base_id", t.with_(PATHS) + "SELECT c_custkey, regexp_replace(raw_id, '_\\d+$', '') base FROM pa")
def _(spark, sf):
    return paths(spark, sf).select("c_custkey", ky.group_base_id(F.col("raw_id")).alias("base"))


@query("m04_exclude_groups", t.with_(PATHS) + f", g AS (SELECT c_custkey, {NORM} group_id FROM pa) SELECT * FROM g WHERE regexp_replace(group_id, '_\\d+$', '') NOT IN (SELECT 'bim' || lpad(n_nationkey::VARCHAR, 3, '0') FROM nation)")
def _(spark, sf):
    d = paths(spark, sf).select("c_custkey", ky.normalize_group_id(F.col("raw_id")).alias("group_id"))
    x = t.table(spark, sf, "nation").select(F.concat(F.lit("bim"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("group_id"))
    return ky.exclude_groups(d, x, base=True)


@query("m05_upsert_keys", t.with_(PATHS) + "SELECT 'g' || c_custkey group_id, 'VR' condition, c_custkey, path, raw_id FROM pa")
def _(spark, sf):
    return ky.upsert_keys(paths(spark, sf), {"group_id": F.concat(F.lit("g"), F.col("c_custkey")), "condition": F.lit("VR")})


@query("m06_conform", "SELECT c_custkey unit, c_acctbal balance, CAST(NULL AS VARCHAR) missing_one FROM customer")
def _(spark, sf):
    return ky.conform(t.table(spark, sf, "customer"), {"unit": ["id", "C_CUSTKEY"], "balance": ["score", "c_acctbal"], "missing_one": ["nope"]})


EU = "eu AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE replace(c_acctbal::VARCHAR, '.', ',') || CASE WHEN c_custkey % 2 = 0 THEN ' %' ELSE '' END END v, c_acctbal FROM customer)"


def eu(spark, sf):
    c = t.table(spark, sf, "customer")
    v = F.concat(F.regexp_replace(F.col("c_acctbal").cast("string"), "\\.", ","), F.when(F.col("c_custkey") % 2 == 0, " %").otherwise(""))
    return c.select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(v).alias("v"), "c_mktsegment")


@query("m07_to_numeric", t.with_(EU) + "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END v FROM eu")
def _(spark, sf):
    return ky.to_numeric(eu(spark, sf), ["v"]).select("c_custkey", "v")


@query("m07_numeric_columns", "SELECT unnest(['v', 'c_mktsegment']) AS \"column\", count(*) n_values, unnest([count(*) FILTER (c_custkey % 7 <> 0), 0]) n_numeric, unnest([true, false]) AS \"numeric\" FROM customer GROUP BY ALL".replace(" GROUP BY ALL", ""))
def _(spark, sf):
    return ky.numeric_columns(eu(spark, sf))


@query("m08_drop_suffix_pairs", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, c_custkey::DOUBLE) v FROM customer")
def _(spark, sf):
    c = t.table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("v_x"), F.col("c_custkey").cast("double").alias("v_y"))
    return ky.drop_suffix_pairs(c)


SRC = "sr AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END a, CASE WHEN c_custkey % 3 < 2 THEN c_acctbal + 1 END b FROM customer)"


def src(spark, sf):
    k = F.col("c_custkey")
    return t.table(spark, sf, "customer").select("c_custkey", F.when(k % 3 == 0, F.col("c_acctbal")).alias("a"), F.when(k % 3 < 2, F.col("c_acctbal") + 1).alias("b"))


@query("m09_coalesce_with_source", t.with_(SRC) + "SELECT c_custkey, coalesce(a, b) v, CASE WHEN a IS NOT NULL THEN 'a' WHEN b IS NOT NULL THEN 'b' END v_source FROM sr")
def _(spark, sf):
    return ky.coalesce_with_source(src(spark, sf), ["a", "b"], "v").select("c_custkey", "v", "v_source")


@query("m09_first_available_column", t.with_(SRC) + "SELECT c_custkey, a v FROM sr")
def _(spark, sf):
    return ky.first_available_column(src(spark, sf), ["a", "b"], "v").select("c_custkey", "v")


@query("m10_dedup_by_key", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) o_orderkey, min(o_orderdate) o_orderdate FROM orders GROUP BY ALL")
def _(spark, sf):
    return ky.dedup_by_key(t.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("m11_null_out_when", t.with_(t.FEAT) + "SELECT unit_id, CASE WHEN condition <> 'PC' THEN price END price, tax FROM feat")
def _(spark, sf):
    f = t.features(spark, sf).select("unit_id", "condition", "price", "tax")
    return ky.null_out_when(f, F.col("condition") == "PC", ["pri"]).drop("condition")


@query("m12_drop_redundant_aliases", t.with_(t.FEAT) + "SELECT unit_id, price, tax FROM feat")
def _(spark, sf):
    f = t.features(spark, sf).select("unit_id", "price", "tax", F.col("price").alias("raw_price"))
    return ky.drop_redundant_aliases(f, {"raw_price": "price", "nope": "tax"})


@query("m13_select_features", t.with_(t.FEAT) + "SELECT unnest(['quantity', 'price', 'discount', 'rebate']) feature, unnest([0, 0, 0, round(avg((rebate IS NULL)::INT::DOUBLE), 6)]) missing_ratio, unnest([true, true, true, avg((rebate IS NULL)::INT::DOUBLE) <= 0.1]) selected FROM feat")
def _(spark, sf):
    return rnd(ky.select_features(t.features(spark, sf), ["unit_id"], 0.1, drop_suffixes=["ines"], drop_prefixes=["ta"]), "missing_ratio")


@query("m14_clean_levels", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END seg FROM customer")
def _(spark, sf):
    c = t.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("seg"))
    return ky.clean_levels(c, "seg", ["building", "machinery"])


@query("m15_valid_performance", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 AND c_nationkey IS NOT NULL")
def _(spark, sf):
    return ky.valid_performance(t.table(spark, sf, "customer"), "c_acctbal", ["c_nationkey"]).select("c_custkey", "c_acctbal")


@query("m16_filter_modality", t.with_(t.FEAT) + "SELECT s_suppkey unit_id, s_acctbal FROM supplier WHERE s_suppkey IN (SELECT unit_id FROM feat WHERE condition = 'VR')")
def _(spark, sf):
    s = t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit_id"), "s_acctbal")
    return ky.filter_modality({"features": t.features(spark, sf), "scores": s}, "VR", "unit_id")["scores"]


@query("m17_scope", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, sf):
    return ky.scope(t.table(spark, sf, "documents").select("doc_id", "lang"), t.table(spark, sf, "labels").where("quality = 1"), "doc_id")


@query("m18_complete_cases", t.with_(t.FEAT) + "SELECT unit_id, rebate FROM feat WHERE rebate IS NOT NULL")
def _(spark, sf):
    return ky.complete_cases(t.features(spark, sf), ["rebate", "price"]).select("unit_id", "rebate")


@query("m19_quality_gate", t.with_(t.SAMP) + """, g AS (SELECT session_id, role, floor(t / 60)::BIGINT window_idx, avg((object <> 'error')::INT::DOUBLE) ok, avg(value) m FROM samp WHERE t < 2580 GROUP BY ALL), w AS (SELECT DISTINCT session_id, role, i window_idx FROM samp, range(0, 43) r(i))
SELECT session_id, role, window_idx, round(coalesce(ok, 0), 6) success_ok, round(CASE WHEN ok >= 0.7 THEN m END, 6) value_mean FROM w LEFT JOIN g USING (session_id, role, window_idx)""")
def _(spark, sf):
    from colloquy.operators.face import window_descriptors
    s = t.samples(spark, sf).withColumn("ok", (F.col("object") != "error").cast("double"))
    sp = s.select("session_id").distinct().select("session_id", F.lit(0.0).alias("t0"), F.lit(2580.0).alias("t1"))
    w = window_descriptors(s, sp, "t", 60.0, 60.0, {"value_mean": "value"}, "ok", 0.7)
    return rnd(w.select("session_id", "role", "window_idx", "success_ok", "value_mean"), "success_ok", "value_mean")


@query("m20_median_split", t.with_(t.FEAT) + "SELECT unit_id, CASE WHEN price IS NULL OR rebate IS NULL THEN NULL ELSE CASE WHEN price >= (SELECT quantile_cont(price, 0.5) FROM feat) THEN 'haut' ELSE 'bas' END || '/' || CASE WHEN rebate >= (SELECT quantile_cont(rebate, 0.5) FROM feat) THEN 'haut' ELSE 'bas' END END profile FROM feat")
def _(spark, sf):
    return ky.median_split(t.features(spark, sf), ["price", "rebate"]).select("unit_id", "profile")


@query("m21_harmonize_timepoint", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'T1' WHEN c_custkey % 2 = 0 THEN 'T1' ELSE 'T2' END timepoint FROM customer")
def _(spark, sf):
    k = F.col("c_custkey")
    c = t.table(spark, sf, "customer").select("c_custkey", F.when(k % 3 == 0, " t1").otherwise("x").alias("tp"), F.when(k % 2 == 0, "S1").otherwise("s2").alias("session"), F.lit("bim001").alias("g"))
    return c.select("c_custkey", ky.harmonize_timepoint(F.col("tp"), F.col("session"), F.col("g"), session_is_time=True).alias("timepoint"))


@query("m22_detect_column", "SELECT unnest([0, 1]) position, unnest(['c_mktsegment', 'c_acctbal']) AS \"column\", unnest([0.0, 1.0])::DOUBLE valid_ratio, unnest([false, true]) chosen")
def _(spark, sf):
    return ky.detect_column(t.table(spark, sf, "customer"), ["absent", "c_mktsegment", "c_acctbal"])


@query("m23_exclude_keys", t.with_(t.FEAT) + "SELECT unit_id, condition, scenario FROM feat WHERE NOT (unit_id IN (SELECT n_nationkey FROM nation) AND condition = 'VR')")
def _(spark, sf):
    x = t.table(spark, sf, "nation").select(F.col("n_nationkey").alias("unit_id"), F.lit("vr").alias("condition"), F.lit(None).cast("string").alias("scenario"))
    return ky.exclude_keys(t.features(spark, sf), x, ["unit_id", "condition", "scenario"]).select("unit_id", "condition", "scenario")


@query("m24_registry_lookup", "SELECT DISTINCT p_type name, CASE WHEN p_type = 'SMALL' THEN 'ECONOMY' ELSE p_type END feature, CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN 'speech' END family, p_type IN ('SMALL', 'ECONOMY') known FROM part")
def _(spark, sf):
    names = t.table(spark, sf, "part").select(F.col("p_type").alias("name")).distinct()
    reg = spark.createDataFrame([("ECONOMY", "speech")], "feature string, family string")
    return ky.registry_lookup(names, reg, spark.createDataFrame([("SMALL", "ECONOMY")], "alias string, feature string")).select("name", "feature", "family", "known")


@query("m25_prefer_corrected", t.with_(t.SAMP) + "SELECT session_id, role, t, CASE WHEN session_id % 2 = 0 AND max((state)::INT) OVER (PARTITION BY session_id) = 1 THEN CASE WHEN state THEN value * 2 END ELSE value END d, CASE WHEN session_id % 2 = 0 AND max((state)::INT) OVER (PARTITION BY session_id) = 1 THEN 'corr' ELSE 'raw' END dir_source FROM samp")
def _(spark, sf):
    s = t.samples(spark, sf).withColumn("c", F.when(F.col("state") & (F.col("session_id") % 2 == 0), F.col("value") * 2))
    return ky.prefer_corrected(s, ["session_id"], ["c"], ["value"], ["d"]).select("session_id", "role", "t", "d", "dir_source")


@query("m26_filter_elements", "SELECT p_partkey, p_name FROM part WHERE p_name = 'small ring' OR contains(lower(p_name), 'bolt')")
def _(spark, sf):
    return ky.filter_elements(t.table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", ["Small Ring"], ["BOLT"])


# ---- scalar functions ----------------------------------------------------------------
L = "FROM lineitem"


def li(spark, sf):
    return t.table(spark, sf, "lineitem")


ID = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
IDS = ", ".join(ID)


@query("f01_safe_div", f"SELECT {IDS}, round(l_extendedprice / nullif(l_discount, 0), 4) v {L}")
def _(spark, sf):
    return li(spark, sf).select(*ID, F.round(fn.safe_div(F.col("l_extendedprice"), F.col("l_discount")), 4).alias("v"))


@query("f02_ratio_eps", f"SELECT {IDS}, round(l_tax / (l_quantity + 1e-6), 9) v {L}")
def _(spark, sf):
    return li(spark, sf).select(*ID, F.round(fn.ratio_eps(F.col("l_tax"), F.col("l_quantity")), 9).alias("v"))


@query("f03_clip", f"SELECT {IDS}, greatest(10, least(40, l_quantity)) v {L}")
def _(spark, sf):
    return li(spark, sf).select(*ID, fn.clip(F.col("l_quantity"), 10.0, 40.0).alias("v"))


@query("f04_log_sqrt", f"SELECT {IDS}, round(ln(1 + greatest(l_quantity - 20, 0)), 9) a, round(sqrt(greatest(l_quantity - 20, 0)), 9) b {L}")
def _(spark, sf):
    x = F.col("l_quantity") - 20
    return li(spark, sf).select(*ID, F.round(fn.log1p_clipped(x), 9).alias("a"), F.round(fn.sqrt_clipped(x), 9).alias("b"))


@query("f05_vector_functions", t.with_(t.DIRS) + """SELECT session_id, role, frame_idx, round(degrees(acos(greatest(-1, least(1, dx)))), 6) angle_x, round(CASE WHEN sqrt(px*px+py*py+pz*pz) > 1e-6 THEN px / sqrt(px*px+py*py+pz*pz) END, 6) ux,
 round((degrees(atan2(dx, dz)) + 360) % 360, 6) az, least(floor(((degrees(atan2(dx, dz)) + 360) % 360) / 22.5), 15)::INT bin, round(((degrees(atan2(dx, dz)) * 3 + 180 + 3600) % 360) - 180, 6) wrapped, round(sqrt(px*px+pz*pz), 6) d2, round(degrees(acos(greatest(-1, least(1, -(dx*px+dy*py+dz*pz)/sqrt(px*px+py*py+pz*pz))))), 6) to_origin FROM dirs""")
def _(spark, sf):
    d = t.directions(spark, sf)
    D, P, O = [F.col(c) for c in ("dx", "dy", "dz")], [F.col(c) for c in ("px", "py", "pz")], [F.lit(0.0)] * 3
    az = fn.azimuth(D[0], D[2])
    o = d.select(
        "session_id", "role", "frame_idx", fn.angle_between(D, [F.lit(1.0), F.lit(0.0), F.lit(0.0)]).alias("angle_x"), fn.unit_vector(P, O)[0].alias("ux"), az.alias("az"),
        fn.histogram_bin(az, 0.0, 360.0, 16).alias("bin"), fn.wrap180(F.degrees(F.atan2(D[0], D[2])) * 3).alias("wrapped"), fn.distance([P[0], P[2]], O[:2]).alias("d2"),
        fn.angle_to_target(D, P, O).alias("to_origin"),
    )
    return rnd(o, "angle_x", "ux", "az", "wrapped", "d2", "to_origin")


def _vec(spark, sf, **cols):
    d = t.directions(spark, sf).select("session_id", "role", "frame_idx", *[c.alias(n) for n, c in cols.items()])
    return rnd(d, *[n for n in cols if n != "bin"])


VQ = "SELECT session_id, role, frame_idx, "


@query("f06_angle_to_target", t.with_(t.DIRS) + VQ + "round(degrees(acos(greatest(-1, least(1, -(dx*px+dy*py+dz*pz)/sqrt(px*px+py*py+pz*pz))))), 6) angle FROM dirs")
def _(spark, sf):
    c = lambda *n: [F.col(x) for x in n]
    return _vec(spark, sf, angle=fn.angle_to_target(c("dx", "dy", "dz"), c("px", "py", "pz"), [F.lit(0.0)] * 3))


@query("f07_unit_vector", t.with_(t.DIRS) + VQ + "round(px / sqrt(px*px+py*py+pz*pz), 6) ux, round(py / sqrt(px*px+py*py+pz*pz), 6) uy, round(pz / sqrt(px*px+py*py+pz*pz), 6) uz FROM dirs")
def _(spark, sf):
    u = fn.unit_vector([F.col(x) for x in ("px", "py", "pz")], [F.lit(0.0)] * 3)
    return _vec(spark, sf, ux=u[0], uy=u[1], uz=u[2])


@query("f08_wrap180", t.with_(t.DIRS) + VQ + "round(((dx * 720 + 180 + 7200) % 360) - 180, 6) wrapped FROM dirs")
def _(spark, sf):
    return _vec(spark, sf, wrapped=fn.wrap180(F.col("dx") * 720))


@query("f09_azimuth_bin", t.with_(t.DIRS) + VQ + "round((degrees(atan2(px, pz)) + 360) % 360, 6) az, least(floor(((degrees(atan2(px, pz)) + 360) % 360) / 22.5), 15)::INT bin FROM dirs")
def _(spark, sf):
    az = fn.azimuth(F.col("px"), F.col("pz"))
    return _vec(spark, sf, az=az, bin=fn.histogram_bin(az, 0.0, 360.0, 16))


@query("f11_distance", t.with_(t.DIRS) + VQ + "round(sqrt(px*px+pz*pz), 6) d2, round(sqrt(px*px+py*py+pz*pz), 6) d3 FROM dirs")
def _(spark, sf):
    p = [F.col(x) for x in ("px", "py", "pz")]
    return _vec(spark, sf, d2=fn.distance([p[0], p[2]], [F.lit(0.0)] * 2), d3=fn.distance(p, [F.lit(0.0)] * 3))


@query("f10_rotate_yaw", t.with_(t.DIRS) + ", r AS (SELECT *, cos(radians(30)) * dx - sin(radians(30)) * dz x, sin(radians(30)) * dx + cos(radians(30)) * dz z FROM dirs) SELECT session_id, role, frame_idx, round(x / sqrt(x*x+dy*dy+z*z), 6) rx, round(z / sqrt(x*x+dy*dy+z*z), 6) rz FROM r")
def _(spark, sf):
    x, y, z = fn.rotate_yaw(F.col("dx"), F.col("dy"), F.col("dz"), F.lit(30.0))
    return t.directions(spark, sf).select("session_id", "role", "frame_idx", F.round(x, 6).alias("rx"), F.round(z, 6).alias("rz"))


@query("f12_normalize_text", f"SELECT doc_id, md5(regexp_replace(lower(trim(regexp_replace(trim(text, ' '), '[^ -~]+', '', 'g'), ' ')), ' +', ' ', 'g')) h FROM documents")
def _(spark, sf):
    d = t.table(spark, sf, "documents")
    # Both sides keep printable ASCII only: engines differ in what counts as white space.
    return d.select("doc_id", F.md5(fn.normalize_text(F.regexp_replace(F.trim("text"), "[^ -~]+", ""))).alias("h"))


@query("f13_split_text_units", "SELECT doc_id, len(regexp_extract_all(translate(lower(text), 'àâäáãéèêëíìîïóòôöõúùûüçñÿ', 'aaaaaeeeeiiiiooooouuuucny'), '([\\p{L}\\p{N}_]+)', 1)) n_units FROM documents")
def _(spark, sf):
    d = t.table(spark, sf, "documents")
    return d.select("doc_id", F.size(fn.text_units(F.col("text"))).cast("long").alias("n_units"))


@query("f14_extractors", "SELECT p_partkey, p_partkey::INT field, substr('ABCDEFGH', 1 + (p_partkey % 8)::INT, 1) letter, (p_partkey % 9 + 1)::INT r, (p_partkey % 7 + 1)::INT c, p_size num FROM part")
def _(spark, sf):
    p = t.table(spark, sf, "part")
    k = F.col("p_partkey")
    f = F.concat(F.lit("Typed in field "), k)
    l = F.concat(F.lit("answer "), F.expr("substr('ABCDEFGH', 1 + cast(p_partkey % 8 as int), 1)"), F.lit("."))
    rc = F.concat(F.lit("cell r"), k % 9 + 1, F.lit(" c"), k % 7 + 1)
    n = F.concat(F.lit("7 then "), F.col("p_size"))
    return p.select("p_partkey", fn.field_index(f).alias("field"), fn.answer_letter(l).alias("letter"), fn.cell_rc(rc)["r"].alias("r"), fn.cell_rc(rc)["c"].alias("c"), fn.trailing_number(n).alias("num"))


@query("f14_trailing_token", "SELECT p_partkey, list_last(string_split(p_name, ' ')) token FROM part")
def _(spark, sf):
    return t.table(spark, sf, "part").select("p_partkey", fn.trailing_token(F.col("p_name")).alias("token"))


@query("f15_linear_to_rc", "SELECT p_partkey, ((p_partkey % 81) // 9 + 1)::INT r, ((p_partkey % 81) % 9 + 1)::INT c FROM part")
def _(spark, sf):
    rc = fn.linear_to_rc(F.col("p_partkey") % 81 + 1)
    return t.table(spark, sf, "part").select("p_partkey", rc["r"].alias("r"), rc["c"].alias("c"))


@query("f16_map_alias", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'memory' WHEN contains(p_name, 'small') THEN 'matrix' END task FROM part")
def _(spark, sf):
    return t.table(spark, sf, "part").select("p_partkey", fn.map_alias(F.col("p_name"), {"Ring": "memory", "SMALL": "matrix"}).alias("task"))


@query("f17_recode_likert", f"SELECT {IDS}, CASE WHEN l_linenumber = 3 THEN 10 - (1 + l_quantity::INT % 9) ELSE 1 + l_quantity::INT % 9 END score {L}")
def _(spark, sf):
    d = li(spark, sf).select(*ID, (1 + F.col("l_quantity").cast("int") % 9).alias("s"))
    x = F.when(F.col("s") == 9, "Tout à fait d'accord").otherwise(F.col("s").cast("string"))
    return d.select(*ID, fn.recode_likert(x, {"tout a fait d'accord": 9}, F.col("l_linenumber").cast("string"), ["3"]).alias("score"))


@query("f18_item_names", "SELECT s_suppkey, 'COR' || lpad((s_suppkey % 100)::VARCHAR, 2, '0') item, 'COR' dimension, 'G1Q' || lpad(s_suppkey::VARCHAR, 5, '0') question FROM supplier")
def _(spark, sf):
    k = F.col("s_suppkey").cast("string")
    c = F.concat(F.lit("G1Q"), F.lpad(k, 5, "0"), F.lit("[COR"), F.lpad((F.col("s_suppkey") % 100).cast("string"), 2, "0"), F.lit("]"))
    return t.table(spark, sf, "supplier").select("s_suppkey", fn.item_of(c).alias("item"), fn.dimension_of(c).alias("dimension"), fn.question_of(c).alias("question"))


@query("f19_hms_boolean", "SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE AS seconds, event_type = 'view' AS flag FROM events")
def _(spark, sf):
    e = t.table(spark, sf, "events")
    x = F.when(F.col("event_type") == "view", " OUI").otherwise("non")
    return e.select("event_id", fn.hms_to_seconds(F.date_format("ts", "HH:mm:ss")).alias("seconds"), fn.parse_boolean(x).alias("flag"))


@query("f20_compress_distance", f"SELECT {IDS}, round(CASE WHEN l_quantity / 10 <= 0.8 THEN l_quantity / 10 ELSE 0.8 + (l_quantity / 10 - 0.8) * 0.85 END, 9) d {L}")
def _(spark, sf):
    return li(spark, sf).select(*ID, F.round(fn.compress_distance(F.col("l_quantity") / 10), 9).alias("d"))


@query("f20_compress_missing", f"SELECT {IDS}, round(CASE WHEN l_linenumber = 3 THEN 1.9 WHEN l_quantity / 10 <= 0.8 THEN l_quantity / 10 ELSE 0.8 + (l_quantity / 10 - 0.8) * 0.5 END, 9) d {L}")
def _(spark, sf):
    known = F.when(F.col("l_linenumber") != 3, F.col("l_quantity") / 10)
    return li(spark, sf).select(*ID, F.round(fn.compress_distance(known, 0.8, 0.5, 3.0), 9).alias("d"))


@query("f21_host_shape", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'SOL' ELSE 'MUR' END host, CASE WHEN p_size % 3 = 0 THEN 'CIRCULAIRE' END shape FROM part")
def _(spark, sf):
    n = F.concat(F.lit("Reservation "), F.when(F.col("p_size") % 2 == 0, "sol ").otherwise("mur "), F.when(F.col("p_size") % 3 == 0, "circulaire").otherwise(""))
    h = fn.host_shape(n)
    return t.table(spark, sf, "part").select("p_partkey", h["host"].alias("host"), h["shape"].alias("shape"))


@query("f22_within_tolerance", f"SELECT {IDS}, abs(l_quantity - 25) <= greatest(3, 0.1 * 25) ok {L}")
def _(spark, sf):
    return li(spark, sf).select(*ID, fn.within_tolerance(F.col("l_quantity"), F.lit(25.0), 3.0, 0.1).alias("ok"))


@query("f23_qualitative_bands", f"SELECT {IDS}, CASE WHEN l_tax * 12 < 0.5 THEN 'poor' WHEN l_tax * 12 < 0.75 THEN 'moderate' WHEN l_tax * 12 < 0.9 THEN 'good' ELSE 'excellent' END icc, CASE WHEN l_discount * 6 >= 0.5 THEN 'strong' WHEN l_discount * 6 >= 0.3 THEN 'moderate' WHEN l_discount * 6 >= 0.1 THEN 'weak' ELSE 'negligible' END rho, CASE WHEN l_discount < 0.001 THEN '***' WHEN l_discount < 0.01 THEN '**' WHEN l_discount < 0.05 THEN '*' ELSE '' END stars, l_discount * 10 > 0.95 AND l_linenumber < 10 suspect {L}")
def _(spark, sf):
    return li(spark, sf).select(
        *ID, fn.icc_band(F.col("l_tax") * 12).alias("icc"), fn.strength_band(F.col("l_discount") * 6).alias("rho"), fn.stars(F.col("l_discount")).alias("stars"),
        fn.artefact_suspect(F.col("l_discount") * 10, F.col("l_linenumber")).alias("suspect"),
    )


@query("f24_classify_feature", "SELECT p_partkey, CASE WHEN p_name LIKE 'small%' THEN 'speech' WHEN p_name LIKE 'red%' THEN 'gaze' ELSE 'other' END family FROM part")
def _(spark, sf):
    return t.table(spark, sf, "part").select("p_partkey", fn.classify_feature(F.col("p_name"), {"small": "speech", "red": "gaze"}).alias("family"))


@query("f25_scale_coordinates", """WITH s AS (SELECT p_brand, p_partkey, p_retailprice x, p_size::DOUBLE y FROM part), m AS (SELECT p_brand, quantile_cont(abs(x), 0.5) m FROM s GROUP BY ALL)
SELECT p_brand, p_partkey, round(CASE WHEN m > 1000 THEN x / 25.7 ELSE x END, 6) x, round(CASE WHEN m > 1000 THEN y / 25.95 ELSE y END, 6) y FROM s JOIN m USING (p_brand)""")
def _(spark, sf):
    p = t.table(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    return rnd(fn.scale_coordinates(p, ["p_brand"], limit=1000.0), "x", "y")


@query("f26_postprocess_congruence", f"SELECT {IDS}, l_discount * 10 - 0.5 raw, greatest(l_discount * 10 - 0.5, 0) clipped, round((l_discount * 10 - 0.5 + 1) / 2, 9) rescaled {L}")
def _(spark, sf):
    x = F.col("l_discount") * 10 - 0.5
    return li(spark, sf).select(*ID, x.alias("raw"), fn.postprocess_congruence(x, "clip_zero").alias("clipped"), F.round(fn.postprocess_congruence(x, "rescale01"), 9).alias("rescaled"))


# ---- aggregates ----------------------------------------------------------------------
@query("a01_describe_by", "SELECT l_returnflag, l_linestatus, count(*) n, round(avg(l_quantity), 3) mean, round(stddev_samp(l_quantity), 3) sd, min(l_quantity) min, max(l_quantity) max, round(quantile_cont(l_quantity, 0.5), 3) median FROM lineitem GROUP BY ALL")
def _(spark, sf):
    return ag.describe_by(li(spark, sf), "l_quantity", ["l_returnflag", "l_linestatus"])


@query("a01_describe_levels", "SELECT l_returnflag, l_linestatus, count(*) n, round(avg(l_quantity), 3) mean, round(stddev_samp(l_quantity), 3) sd FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(spark, sf):
    return ag.describe_levels(li(spark, sf), "l_quantity", ["l_returnflag", "l_linestatus"])


@query("a02_coef_var", "SELECT l_suppkey, round(stddev_pop(l_quantity) / avg(l_quantity), 6) cv0, round(stddev_samp(l_quantity) / avg(l_quantity), 6) cv1 FROM lineitem GROUP BY ALL")
def _(spark, sf):
    return rnd(li(spark, sf).groupBy("l_suppkey").agg(ag.coef_var("l_quantity").alias("cv0"), ag.coef_var("l_quantity", 1).alias("cv1")), "cv0", "cv1")


@query("a03_share_of_total", f"SELECT {IDS}, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_returnflag), 12) share FROM lineitem")
def _(spark, sf):
    d = ag.share_of_total(li(spark, sf).select(*ID, "l_quantity", "l_returnflag"), "l_quantity", ["l_returnflag"])
    return rnd(d.select(*ID, "share"), "share", d=12)


@query("a03_top_share", "SELECT l_orderkey, round(max(l_quantity) / sum(l_quantity), 6) top_share, round(var_pop(l_quantity) / pow(sum(l_quantity), 2), 9) share_variance FROM lineitem GROUP BY ALL")
def _(spark, sf):
    d = li(spark, sf).groupBy("l_orderkey").agg(ag.top_share("l_quantity").alias("top_share"), ag.share_variance("l_quantity").alias("share_variance"))
    return rnd(rnd(d, "top_share"), "share_variance", d=9)


for _b, _e in {"nats": "-sum(p * ln(p))", "bits": "-sum(p * log2(p))", "normalized": "CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END"}.items():
    @query(f"a04_entropy_{_b}", f"WITH w AS (SELECT l_suppkey, l_returnflag, sum(l_quantity) w FROM lineitem GROUP BY ALL), p AS (SELECT l_suppkey, w / sum(w) OVER (PARTITION BY l_suppkey) p FROM w) SELECT l_suppkey, round({_e}, 6) entropy FROM p GROUP BY ALL")
    def _(spark, sf, b=_b):
        w = li(spark, sf).groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("w"))
        return rnd(ag.entropy_of(w, ["l_suppkey"], "w", base="bits" if b == "bits" else "nats", normalize=b == "normalized"), "entropy")


@query("a05_gini", "WITH r AS (SELECT l_suppkey, l_quantity v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) r FROM lineitem) SELECT l_suppkey, CASE WHEN count(*) > 1 THEN round(2 * sum(r * v) / (count(*) * sum(v)) - (count(*) + 1.0) / count(*), 6) END gini FROM r GROUP BY ALL")
def _(spark, sf):
    return rnd(ag.gini(li(spark, sf), ["l_suppkey"], "l_quantity"), "gini")


@query("a06_rate_per_min", "SELECT user_id, round(count(*) / (sum(value) / 60), 6) rate FROM events GROUP BY ALL")
def _(spark, sf):
    return rnd(t.table(spark, sf, "events").groupBy("user_id").agg(ag.rate_per_min(F.count("*").cast("double"), F.sum("value")).alias("rate")), "rate")


@query("a07_nunique", "SELECT l_suppkey, count(DISTINCT l_partkey) n_parts FROM lineitem GROUP BY ALL")
def _(spark, sf):
    return li(spark, sf).groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n_parts"))


for _h in ("mean", "median", "drop"):
    _v = {"mean": "coalesce(rebate, (SELECT avg(rebate) FROM feat))", "median": "coalesce(rebate, (SELECT quantile_cont(rebate, 0.5) FROM feat))", "drop": "rebate"}[_h]
    @query(f"a10_impute_{_h}", t.with_(t.FEAT) + f"SELECT unit_id, round({_v}, 4) rebate FROM feat" + (" WHERE rebate IS NOT NULL" if _h == "drop" else ""))
    def _(spark, sf, h=_h):
        return rnd(ag.impute(t.features(spark, sf).select("unit_id", "rebate"), ["rebate"], h), "rebate", d=4)


@query("a11_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) \"rank\" FROM orders")
def _(spark, sf):
    return ag.rank_min_desc(t.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice").select("o_orderkey", "rank")


@query("a12_repeats", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 is_repeat FROM events")
def _(spark, sf):
    e = t.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    from colloquy.operators.scan import by_width
    return ag.repeats(e, ["user_id", "event_type"], ["event_id"], by_width("event_id", 4096)).select("event_id", "is_repeat")


@query("a13_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(spark, sf):
    return ag.top_k(t.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 20, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("a14_union_all", "SELECT c_custkey id, c_acctbal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def _(spark, sf):
    return ag.union_all([t.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("c_acctbal"))])


@query("a15_membership", "SELECT coalesce(a.doc_id, b.doc_id) doc_id, CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'both' WHEN a.doc_id IS NOT NULL THEN 'left' ELSE 'right' END side FROM documents a FULL JOIN (SELECT doc_id + 100 doc_id FROM labels) b ON a.doc_id = b.doc_id")
def _(spark, sf):
    return ag.membership(t.table(spark, sf, "documents"), t.table(spark, sf, "labels").select((F.col("doc_id") + 100).alias("doc_id")), "doc_id")


THEMES = {"privacy": ["@", "phone"], "licence": ["license", "copyright"]}


@query("a16_theme_counts", "WITH n AS (SELECT lang, count(*) c, count(*) FILTER (contains(lower(text), '@') OR contains(lower(text), 'phone')) a, count(*) FILTER (contains(lower(text), 'license') OR contains(lower(text), 'copyright')) b FROM documents GROUP BY ALL) SELECT lang, 'privacy' theme, a n, round(100.0 * a / c, 3)::DOUBLE pct FROM n UNION ALL SELECT lang, 'licence', b, round(100.0 * b / c, 3) FROM n")
def _(spark, sf):
    return ag.theme_counts(t.table(spark, sf, "documents"), "text", THEMES, ["lang"])


INV = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{ty}' AS type, '{b}' block, count(*) n_rows, count(*) - count({c}) n_missing FROM feat" for c, ty, b in [("unit_id", "bigint", "other"), ("price", "double", "cost"), ("rebate", "double", "cost")])


@query("a17_column_inventory", t.with_(t.FEAT) + INV)
def _(spark, sf):
    return ag.column_inventory(t.features(spark, sf).select("unit_id", "price", "rebate"), {"price": "cost", "rebate": "cost"})


@query("a18_block_summary", t.with_(t.FEAT, f"inv AS ({INV})") + "SELECT block, count(*) n_columns, sum(n_missing)::BIGINT n_missing, round(avg(n_missing / n_rows), 6) missing_ratio FROM inv GROUP BY ALL")
def _(spark, sf):
    return ag.block_summary(ag.column_inventory(t.features(spark, sf).select("unit_id", "price", "rebate"), {"price": "cost", "rebate": "cost"}))


@query("a19_unit_counts", t.with_(t.FEAT) + "SELECT condition, scenario, count(DISTINCT unit_id) n_units FROM feat GROUP BY CUBE (condition, scenario)")
def _(spark, sf):
    return ag.unit_counts(t.features(spark, sf), ["condition", "scenario"], "unit_id")


@query("a20_source_summary", t.with_(t.FEAT) + "SELECT 'a' source, count(*) n_rows, 2 n_columns, count(DISTINCT unit_id) n_units, round(avg((rebate IS NULL)::INT / 2.0::DOUBLE), 6) missing_ratio FROM feat UNION ALL SELECT 'b', count(*), 2, count(DISTINCT unit_id), 0 FROM feat")
def _(spark, sf):
    f = t.features(spark, sf)
    return ag.source_summary({"a": f.select("unit_id", "rebate"), "b": f.select("unit_id", "price")}, "unit_id")


@query("a21_category_percentages", "SELECT lang, source, count(*) n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY lang), 3)::DOUBLE pct FROM documents GROUP BY lang, source")
def _(spark, sf):
    return ag.category_percentages(t.table(spark, sf, "documents"), "source", ["lang"])


@query("a22_crosstab_means", "WITH m AS (SELECT l_suppkey, l_returnflag, avg(l_quantity) m FROM lineitem GROUP BY ALL) SELECT l_suppkey, string_agg(l_returnflag || ' = ' || printf('%.2f', m), '; ' ORDER BY l_returnflag) means FROM m GROUP BY ALL")
def _(spark, sf):
    return ag.crosstab_means(li(spark, sf), "l_suppkey", "l_returnflag", "l_quantity")


@query("a23_melt", t.with_(t.FEAT) + "SELECT unit_id, 'price' feature, price AS value FROM feat UNION ALL SELECT unit_id, 'rebate', rebate FROM feat")
def _(spark, sf):
    return ag.melt(t.features(spark, sf), ["unit_id"], ["price", "rebate"])


@query("a24_scope_comparison", t.with_(t.FEAT) + "SELECT scenario, round(avg(price) FILTER (condition = 'VR'), 4) m_a, round(avg(price) FILTER (condition = 'PC'), 4) m_b FROM feat GROUP BY ALL")
def _(spark, sf):
    f = t.features(spark, sf)
    m = lambda c: f.where(F.col("condition") == c).groupBy("scenario").agg(F.round(F.avg("price"), 4).alias("m"))
    return ag.scope_comparison(m("VR"), m("PC"), ["scenario"], ["m"])


@query("a25_participant_profile", "WITH c AS (SELECT o_custkey participant, (CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 3 END + CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '5-LOW' THEN 1 END) s, coalesce(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 3 END, 0) + coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '5-LOW' THEN 1 END, 0) t, (o_orderstatus IN ('F', 'O'))::INT + (o_orderpriority IN ('1-URGENT', '5-LOW'))::INT n FROM orders), m AS (SELECT participant, max(t / nullif(n, 0)) familiarity FROM c GROUP BY ALL) SELECT participant, familiarity, CASE WHEN familiarity >= 3.5 THEN 'high' WHEN familiarity >= 2 THEN 'medium' WHEN familiarity IS NOT NULL THEN 'low' END AS level FROM m")
def _(spark, sf):
    return ag.participant_profile(t.table(spark, sf, "orders").withColumnRenamed("o_custkey", "participant"), "participant", {"o_orderstatus": {"F": 1, "O": 3}, "o_orderpriority": {"1-URGENT": 4, "5-LOW": 1}})


@query("a26_aggregate_by_unit", "SELECT l_suppkey, round(avg(l_quantity), 6) l_quantity, round(avg(l_tax), 6) l_tax FROM lineitem GROUP BY ALL")
def _(spark, sf):
    return rnd(ag.aggregate_by_unit(li(spark, sf), ["l_suppkey"], ["l_quantity", "l_tax"]), "l_quantity", "l_tax")


@query("a27_analysis_summary", t.with_(t.FEAT) + "SELECT 'candidates' step, 6 n_features FROM (SELECT 1) UNION ALL SELECT 'few_missing', 5 + (avg((rebate IS NULL)::INT::DOUBLE) <= 0.1)::INT FROM feat")
def _(spark, sf):
    return sy.analysis_summary(t.features(spark, sf), ["unit_id"], 0.1)


@query("a28_source_recap", t.with_(t.FEAT) + "SELECT 'features' source, count(*) n_rows, 2 n_columns, count(DISTINCT unit_id) n_units, round(avg((rebate IS NULL)::INT / 2.0::DOUBLE), 6) missing_ratio FROM feat WHERE condition = 'VR'")
def _(spark, sf):
    return ag.source_summary({"features": t.features(spark, sf).where("condition = 'VR'").select("unit_id", "rebate")}, "unit_id")


@query("a29_dataset_patterns", "SELECT regexp_replace(url, '[0-9]+', '#', 'g') pattern, count(*) n_files FROM pages GROUP BY ALL")
def _(spark, sf):
    return ag.dataset_patterns(t.table(spark, sf, "pages"), "url")


# ---- joins and fusion ----------------------------------------------------------------
@query("j01_full_outer_fusion", "SELECT coalesce(a.unit, b.unit) unit, x, y FROM (SELECT c_custkey unit, c_acctbal x FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT s_suppkey unit, s_acctbal y FROM supplier) b ON a.unit = b.unit")
def _(spark, sf):
    a = t.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("x"))
    return fu.fuse([a, t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_acctbal").alias("y"))], ["unit"])


@query("j02_merge_on_unit", "SELECT s_suppkey group_id, 'T1' timepoint, s_acctbal, n_name FROM supplier LEFT JOIN (SELECT n_nationkey, n_name FROM nation) ON s_suppkey = n_nationkey")
def _(spark, sf):
    a = t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("group_id"), F.lit("T1").alias("timepoint"), "s_acctbal")
    b = t.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("group_id"), F.lit("UNK").alias("timepoint"), "n_name")
    return fu.merge_on_unit(a, b)


@query("j03_left_join_parts", "SELECT s_suppkey, s_acctbal, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    s, n, r = (t.table(spark, sf, x) for x in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "s_acctbal", "n_name", "r_name")


@query("j04_window_join", t.with_(t.SAMP) + ", w AS (SELECT session_id, role, floor(t / 100)::BIGINT window_idx, avg(value) v FROM samp GROUP BY ALL) SELECT a.session_id, a.window_idx, round(a.v, 6) va, round(b.v, 6) vb FROM w a JOIN w b ON a.session_id = b.session_id AND a.window_idx = b.window_idx AND a.role = 'r0' AND b.role = 'r1'")
def _(spark, sf):
    w = t.samples(spark, sf).groupBy("session_id", "role", F.floor(F.col("t") / 100).alias("window_idx")).agg(F.avg("value").alias("v"))
    a = w.where("role = 'r0'").select("session_id", "window_idx", F.round("v", 6).alias("va"))
    return a.join(w.where("role = 'r1'").select("session_id", "window_idx", F.round("v", 6).alias("vb")), ["session_id", "window_idx"])


@query("j14_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def _(spark, sf):
    p = t.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return li(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey").join(p, "l_partkey", "left")


@query("j10_theta_self_join", t.with_(t.SEG) + "SELECT a.session_id, a.role source, b.role target, a.start_s a_s, a.end_s a_e, b.start_s b_s FROM seg a JOIN seg b ON a.session_id = b.session_id AND a.role <> b.role AND b.start_s > a.start_s AND b.start_s <= a.end_s + 0.5")
def _(spark, sf):
    from colloquy.operators.align import interval_join
    s = t.segments(spark, sf)
    a = s.select("session_id", F.col("role").alias("source"), F.col("start_s").alias("a_s"), F.col("end_s").alias("a_e"), (F.col("end_s") + 0.5).alias("_until"))
    b = s.select("session_id", F.col("role").alias("target"), F.col("start_s").alias("b_s"), F.col("start_s").alias("_at"))
    j = interval_join(a, b, ["session_id"], 10.0, ("a_s", "_until"), ("b_s", "_at"), (F.col("source") != F.col("target")) & (F.col("b_s") > F.col("a_s")) & (F.col("b_s") <= F.col("a_e") + 0.5))
    return j.drop("_until", "_at")


@query("j12_existence_joins", t.with_(t.SEG) + "SELECT session_id, role, start_s, end_s FROM seg a WHERE end_s - start_s < 2 AND EXISTS (SELECT 1 FROM seg b WHERE b.session_id = a.session_id AND b.role <> a.role AND b.start_s <= a.end_s AND b.end_s >= a.start_s)")
def _(spark, sf):
    from colloquy.operators.align import interval_join
    s = t.segments(spark, sf)
    o = s.select("session_id", F.col("role").alias("o_role"), F.col("start_s").alias("o_s"), F.col("end_s").alias("o_e"))
    return interval_join(s.where("end_s - start_s < 2"), o, ["session_id"], 10.0, ("start_s", "end_s"), ("o_s", "o_e"), F.col("role") != F.col("o_role"), how="left_semi")


@query("c01_canonical_modality", t.with_(t.FEAT) + "SELECT unit_id, round((quantity + coalesce(rebate, 0)) / (1 + (rebate IS NOT NULL)::INT), 6) pair_mean, round(quantity - price, 4) load_balance, round(quantity / (price + 1e-6), 9) load_ratio FROM feat")
def _(spark, sf):
    f = fu.contrasts(fu.pair_means(t.features(spark, sf), {"pair_mean": ["quantity", "rebate", "absent"]}), "quantity", "price", "load")
    return rnd(rnd(rnd(f.select("unit_id", "pair_mean", "load_balance", "load_ratio"), "pair_mean"), "load_balance", d=4), "load_ratio", d=9)


@query("c02_reference_rates", t.with_(t.FEAT) + "SELECT unit_id, coalesce(rebate, price) interaction_dur_s_ref, coalesce(abs(rebate - price) > 5, false) duration_mismatch, round(lines / (coalesce(rebate, price) / 60 + 1e-6), 6) lines_rate_per_min_ref, round(quantity / (coalesce(rebate, price) + 1e-6), 9) quantity_ratio_ref FROM feat")
def _(spark, sf):
    f = fu.reference_rates(t.features(spark, sf), "rebate", "price", ["lines"], ["quantity"])
    f = f.select("unit_id", "interaction_dur_s_ref", "duration_mismatch", "lines_rate_per_min_ref", "quantity_ratio_ref")
    return rnd(rnd(f, "lines_rate_per_min_ref"), "quantity_ratio_ref", d=9)


@query("c03_zscore_within", t.with_(t.FEAT) + "SELECT unit_id, round((price - avg(price) OVER w) / stddev_pop(price) OVER w, 6) z_price, round((rebate - avg(rebate) OVER w) / stddev_pop(rebate) OVER w, 6) z_rebate FROM feat WINDOW w AS (PARTITION BY condition, scenario)")
def _(spark, sf):
    z = ag.zscore_within(t.features(spark, sf), ["price", "rebate"], ["condition", "scenario"])
    return rnd(z.select("unit_id", "z_price", "z_rebate"), "z_price", "z_rebate")


@query("c04_weighted_index", t.with_(t.FEAT) + "SELECT unit_id, round(2 * quantity - rebate, 4) strict, round(2 * quantity - coalesce(rebate, 0), 4) skipping FROM feat")
def _(spark, sf):
    w = {"quantity": 2.0, "rebate": -1.0}
    f = fu.weighted_index(fu.weighted_index(t.features(spark, sf), "strict", w), "skipping", w, "skip")
    return rnd(f.select("unit_id", "strict", "skipping"), "strict", "skipping", d=4)


@query("c05_nanmean_index", t.with_(t.FEAT) + "SELECT unit_id, round((quantity - coalesce(rebate, 0)) / (1 + (rebate IS NOT NULL)::INT), 4) idx FROM feat")
def _(spark, sf):
    return rnd(fu.mean_index(t.features(spark, sf), "idx", {"quantity": 1.0, "rebate": -1.0}).select("unit_id", "idx"), "idx", d=4)


@query("c06_final_features", t.with_(t.FEAT) + "SELECT unit_id, least(1, greatest(0, coalesce(rebate, discount))) final, CASE WHEN rebate IS NOT NULL THEN 'rebate' ELSE 'discount' END final_source FROM feat")
def _(spark, sf):
    return fu.final_features(t.features(spark, sf), {"final": ["absent", "rebate", "discount"]}, ["final"]).select("unit_id", "final", "final_source")


@query("c07_missing_counts", t.with_(t.FEAT) + "SELECT unit_id, (rebate IS NULL)::INT n_missing_deal, 0 n_missing_load FROM feat")
def _(spark, sf):
    return fu.missing_counts(t.features(spark, sf), {"deal": ["rebate", "discount"], "load": ["quantity"]}).select("unit_id", "n_missing_deal", "n_missing_load")


@query("c08_compact_output", t.with_(t.FEAT) + "SELECT unit_id, price, tax FROM feat")
def _(spark, sf):
    return fu.compact_output(t.features(spark, sf), ["unit_id"], ["price", "absent", "tax"])


@query("c09_availability", t.with_(t.FEAT) + "SELECT condition, 'rebate' feature, count(*) n, count(rebate) n_available, round(100.0 * count(rebate) / count(*), 3)::DOUBLE pct_available FROM feat GROUP BY ALL")
def _(spark, sf):
    return fu.availability(t.features(spark, sf), ["condition"], ["rebate"])


SPEC = {"I_load": {"quantity": 1.0, "discount": -1.0, "absent": 1.0}, "I_deal": {"rebate": 1.0, "tax": 1.0}}
KNOWN = ["quantity", "discount", "rebate", "tax"]
ZS = "zz AS (SELECT unit_id, (quantity - avg(quantity) OVER ()) / stddev_pop(quantity) OVER () q, (discount - avg(discount) OVER ()) / stddev_pop(discount) OVER () d, (rebate - avg(rebate) OVER ()) / stddev_pop(rebate) OVER () r, (tax - avg(tax) OVER ()) / stddev_pop(tax) OVER () x FROM feat)"


@query("c10_resolve_features")
def _(spark, sf):
    return fu.resolve_features(t.features(spark, sf), SPEC, KNOWN)


@query("c10_behavioural_indices", t.with_(t.FEAT, ZS) + "SELECT unit_id, 'I_load' index_name, 2 n_features, round((q - d) / 2, 6) mean, round((q - d) / 2, 6) median FROM zz UNION ALL SELECT unit_id, 'I_deal', 1 + (r IS NOT NULL)::INT, CASE WHEN r IS NOT NULL THEN round((r + x) / 2, 6) END, CASE WHEN r IS NOT NULL THEN round((r + x) / 2, 6) END FROM zz")
def _(spark, sf):
    f = cut(t.features(spark, sf))
    r = cut(fu.resolve_features(f, SPEC, KNOWN))
    return rnd(fu.behavioural_indices(f, "unit_id", r, KNOWN, {"I_load": 1, "I_deal": 2}), "mean", "median")


@query("c11_index_variants", t.with_(t.FEAT, ZS) + ", s AS (SELECT unit_id, i, (CASE WHEN i % 2 = 1 THEN -q ELSE q END + CASE WHEN i // 2 = 1 THEN -d ELSE d END) / 2 m FROM zz, range(0, 4) r(i)) SELECT unit_id, 'v_signs_' || i index_name, round(m, 6) mean FROM s UNION ALL SELECT unit_id, 'v', round((q - d) / 2, 6) FROM zz UNION ALL SELECT unit_id, 'v_without_quantity', round(-d, 6) FROM zz UNION ALL SELECT unit_id, 'v_without_discount', round(q, 6) FROM zz")
def _(spark, sf):
    f = cut(t.features(spark, sf))
    v = fu.index_variants(spark, "v", {"quantity": 1.0, "discount": -1.0})
    o = fu.behavioural_indices(f, "unit_id", v, ["quantity", "discount"], {})
    return rnd(o.select("unit_id", "index_name", "mean"), "mean")


@query("c12_silent_division_profile", t.with_(t.FEAT) + "SELECT profile, count(*) n FROM (SELECT CASE WHEN quantity >= (SELECT quantile_cont(quantity, 0.5) FROM feat) THEN 'haut' ELSE 'bas' END || '/' || CASE WHEN tax >= (SELECT quantile_cont(tax, 0.5) FROM feat) THEN 'haut' ELSE 'bas' END profile FROM feat) GROUP BY ALL")
def _(spark, sf):
    return fu.silent_division_profile(t.features(spark, sf), "quantity", "tax")


@query("c14_master_dataset", t.with_(t.FEAT) + "SELECT unit_id, price, s_acctbal, s_suppkey IS NOT NULL in_questionnaire, round(mean_order, 3) mean_order, o_custkey IS NOT NULL in_performance FROM feat LEFT JOIN supplier ON unit_id = s_suppkey LEFT JOIN (SELECT o_custkey, avg(o_totalprice) mean_order FROM orders GROUP BY ALL) ON unit_id = o_custkey")
def _(spark, sf):
    s = t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit_id"), "s_acctbal")
    o = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("unit_id"), F.col("o_totalprice").alias("mean_order"))
    return rnd(fu.master_dataset(t.features(spark, sf).select("unit_id", "price"), {"questionnaire": s, "performance": o}, ["unit_id"]), "mean_order", d=3)


LG = "lg AS (SELECT o_custkey unit, CASE WHEN year(o_orderdate) < 1999 THEN 'T1' ELSE 'T2' END timepoint, o_totalprice v FROM orders)"


def longi(spark, sf):
    return t.table(spark, sf, "orders").select(F.col("o_custkey").alias("unit"), F.when(F.year("o_orderdate") < 1999, "T1").otherwise("T2").alias("timepoint"), F.col("o_totalprice").alias("v"))


@query("c15_longitudinal_pairs", t.with_(LG) + "SELECT unit, round(avg(v) FILTER (timepoint = 'T1'), 6) \"v_T1\", round(avg(v) FILTER (timepoint = 'T2'), 6) \"v_T2\", round(avg(v) FILTER (timepoint = 'T2') - avg(v) FILTER (timepoint = 'T1'), 6) delta_v FROM lg GROUP BY ALL")
def _(spark, sf):
    return rnd(fu.longitudinal_pairs(longi(spark, sf), ["unit"], "timepoint", ["v"]), "v_T1", "v_T2", "delta_v")


@query("c16_pair_availability", t.with_(LG) + ", u AS (SELECT unit, max((timepoint = 'T1')::INT) a, max((timepoint = 'T2')::INT) b FROM lg GROUP BY ALL) SELECT sum(a)::BIGINT n_t1, sum(b)::BIGINT n_t2, sum(a * b)::BIGINT n_pairs, count(*) n_units FROM u")
def _(spark, sf):
    return fu.pair_availability(longi(spark, sf), ["unit"], "timepoint")


@query("c17_construct_scores", t.with_(t.RESP) + "SELECT group_id, 'TMS' construct, round(avg(s), 6) score, count(*) n_dimensions FROM (SELECT group_id, dimension, avg(score) s FROM resp GROUP BY ALL) GROUP BY ALL")
def _(spark, sf):
    r = t.responses(spark, sf).groupBy("group_id", "dimension").agg(F.avg("score").alias("score"))
    al = spark.createDataFrame([("D0", 0.8), ("D1", 0.75)], "dimension string, alpha double")
    return rnd(fu.construct_scores(r, al, ["group_id"], {"TMS": ["D0", "D1"]}, 0.7), "score")


@query("c18_analysis_dataset", t.with_(t.FEAT) + "SELECT unit_id, coalesce(rebate, price) predictor, CASE WHEN rebate IS NOT NULL THEN 'rebate' ELSE 'price' END predictor_source, s_acctbal outcome FROM feat JOIN supplier ON unit_id = s_suppkey")
def _(spark, sf):
    s = t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit_id"), F.col("s_acctbal").alias("outcome"))
    f = t.features(spark, sf)
    return fu.analysis_dataset(f.drop("price"), "unit_id", {"predictor": ["tax", "rebate", "price"]}, s, kept=["rebate", "price"], supplement=f.select("unit_id", "price"))


@query("c19_component_ratio", t.with_(t.FEAT) + "SELECT unit_id, round(price / rebate, 6) component_ratio, round(price + rebate, 4) component_ratio_sum FROM feat")
def _(spark, sf):
    f = fu.component_ratio(t.features(spark, sf), "price", "rebate").select("unit_id", "component_ratio", "component_ratio_sum")
    return rnd(rnd(f, "component_ratio"), "component_ratio_sum", d=4)
