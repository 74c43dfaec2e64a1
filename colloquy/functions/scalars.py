"""Column functions (F-01 to F-26). All are built-in expressions; missing is NULL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def finite(x: Column) -> Column:
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def safe_div(a: Column, b: Column) -> Column:
    """F-01: NULL for a zero, missing or non-finite operand."""
    return F.try_divide(finite(a), finite(b))


def ratio_eps(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """F-02"""
    return a / (b + F.lit(eps))


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """F-03: bounds on a value; NULL stays NULL."""
    y = x
    if lo is not None:
        y = F.greatest(y, F.lit(lo))
    if hi is not None:
        y = F.least(y, F.lit(hi))
    return F.when(x.isNotNull(), y)


def round_scaled(x: Column, digits: int) -> Column:
    """The scaled value rounded half up, as SQL engines round doubles.

    ``F.round`` goes by the shortest decimal of a double instead: 0.0045 * 100 is 0.44999999999999996, on one digit 0.4
    there and 0.5 here.
    """
    scale = F.lit(float(10**digits))
    return F.round(x * scale) / scale


def log1p_clipped(x: Column) -> Column:
    """F-04"""
    return F.log1p(clip(x, 0.0))


def sqrt_clipped(x: Column) -> Column:
    """F-04"""
    return F.sqrt(clip(x, 0.0))


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x + y, [p * q for p, q in zip(a, b)])


def angle_between(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """F-05: degrees between two unit vectors."""
    return F.degrees(F.acos(clip(dot(a, b), -1.0, 1.0)))


def unit_vector(tip: Sequence[Column], origin: Sequence[Column]) -> list[Column]:
    """F-07: direction from origin to tip, NULL when they coincide (1e-6)."""
    d = [t - o for t, o in zip(tip, origin)]
    n = F.sqrt(dot(d, d))
    return [F.when(n > 1e-6, x / n) for x in d]


def angle_to_target(direction, pos_a, pos_b) -> Column:
    """F-06: degrees between a direction at ``pos_a`` and the way to ``pos_b``."""
    return angle_between(direction, unit_vector(pos_b, pos_a))


def wrap180(x: Column) -> Column:
    """F-08"""
    return F.pmod(x + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def azimuth(dx: Column, dz: Column) -> Column:
    """F-09: degrees in [0, 360) of the horizontal projection."""
    return F.pmod(F.degrees(F.atan2(dx, dz)), F.lit(360.0))


def histogram_bin(x: Column, lo: float, hi: float, n: int) -> Column:
    """F-09: bin 0 .. n-1, the last bin closed."""
    b = F.floor((x - F.lit(lo)) / F.lit((hi - lo) / n)).cast("int")
    return F.when((x >= lo) & (x <= hi), F.least(b, F.lit(n - 1)))


def rotate_yaw(dx: Column, dy: Column, dz: Column, theta_deg: Column) -> list[Column]:
    """F-10: rotation of the horizontal part, renormalised."""
    c, s = F.cos(F.radians(theta_deg)), F.sin(F.radians(theta_deg))
    x, z = c * dx - s * dz, s * dx + c * dz
    n = F.sqrt(x * x + dy * dy + z * z)
    return [F.when(n > 1e-9, v / n) for v in (x, dy, z)]


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """F-11: Euclidean distance in two or three dimensions."""
    d = [x - y for x, y in zip(a, b)]
    return F.sqrt(dot(d, d))


# Accented letters of the questionnaire and log language, and their base.
ACCENTED = "àâäáãéèêëíìîïóòôöõúùûüçñÿ"
UNACCENTED = "aaaaaeeeeiiiiooooouuuucny"


def normalize_text(x: Column) -> Column:
    """F-12: lower case without accents, trimmed, single spaces."""
    return F.regexp_replace(F.translate(F.lower(F.trim(x)), ACCENTED, UNACCENTED), r"\s+", " ")


def text_units(x: Column) -> Column:
    """F-13: word tokens (letters and digits of any script, underscore) of the normalised text."""
    return F.regexp_extract_all(normalize_text(x), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def _first_match(x: Column, pattern: str, group: int = 1) -> Column:
    v = F.regexp_extract(x, pattern, group)
    return F.when(v != "", v)


def answer_letter(x: Column) -> Column:
    """F-14: a stand-alone answer letter A to H."""
    return _first_match(F.upper(x), r"(?:^|[^A-Z0-9])([A-H])(?:$|[^A-Z0-9])")


def field_index(x: Column) -> Column:
    """F-14: number after "field"."""
    return _first_match(F.lower(x), r"field\D{0,10}?(\d+)").try_cast("int")


def cell_rc(x: Column) -> Column:
    """F-14: (row, column) written as r<i>c<j>."""
    r = _first_match(F.lower(x), r"r\D?(\d+)\D{1,3}c?\D?(\d+)", 1).try_cast("int")
    c = _first_match(F.lower(x), r"r\D?(\d+)\D{1,3}c?\D?(\d+)", 2).try_cast("int")
    return F.when(r.isNotNull() & c.isNotNull(), F.struct(r.alias("r"), c.alias("c")))


def trailing_number(x: Column) -> Column:
    """F-14: last number of the text."""
    return F.try_element_at(F.regexp_extract_all(x, F.lit(r"(\d+)"), 1), F.lit(-1)).try_cast("int")


def trailing_token(x: Column) -> Column:
    """F-14: last word of the text."""
    return F.try_element_at(text_units(x), F.lit(-1))


def linear_to_rc(k: Column, width: int = 9) -> Column:
    """F-15: row and column (from 1) of cell k (from 1)."""
    return F.struct(
        (F.floor((k - 1) / F.lit(width)) + 1).cast("int").alias("r"), (F.pmod(k - 1, F.lit(width)) + 1).cast("int").alias("c")
    )


def map_alias(name: Column, aliases: Mapping[str, str]) -> Column:
    """F-16: key of the first alias (in priority order) contained in the name."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.contains(k.lower()), F.lit(v)) for k, v in aliases.items()])


def recode_likert(x: Column, labels: Mapping[str, int], item: Column, reversed_items: Sequence[str]) -> Column:
    """F-17: label, or exactly one digit, to 1..9; listed items count from the other end."""
    text = normalize_text(x)
    by_label = F.coalesce(*[F.when(text == k, F.lit(v)) for k, v in labels.items()])
    score = F.coalesce(by_label, F.regexp_extract(text, r"^([1-9])$", 1).try_cast("int"))
    return F.when(item.isin(list(reversed_items)), 10 - score).otherwise(score)


def item_of(column: Column) -> Column:
    """F-18: code in square brackets, e.g. COR03."""
    return _first_match(column, r"\[([A-Za-z]+\d*)\]")


def dimension_of(column: Column) -> Column:
    """F-18: letters of the item code."""
    return _first_match(column, r"\[([A-Za-z]+)\d*\]")


def question_of(column: Column) -> Column:
    """F-18: question code before the bracket."""
    return _first_match(column, r"^(G\d+Q\d+)")


def hms_to_seconds(x: Column) -> Column:
    """F-19"""
    p = F.split(F.trim(x), ":")
    part = lambda i: F.get(p, i).try_cast("double")
    return F.when(F.size(p) == 3, part(0) * 3600 + part(1) * 60 + part(2))


# Words for true, in lower case.
TRUE_WORDS = ["1", "true", "vrai", "yes", "oui", "y", "t"]


def parse_boolean(x: Column) -> Column:
    """F-19"""
    return F.lower(F.trim(x.cast("string"))).isin(TRUE_WORDS)


def compress_distance(d: Column, floor_m: float = 0.80, gain: float = 0.85, missing: float | None = None) -> Column:
    """F-20: display distance, compressed above a floor; ``missing`` stands for a distance that is not known."""
    d = F.coalesce(d, F.lit(missing)) if missing is not None else d
    return F.when(d <= floor_m, d).otherwise(F.lit(floor_m) + (d - F.lit(floor_m)) * F.lit(gain))


def host_shape(name: Column) -> Column:
    """F-21: host surface and shape named in an element."""
    u = F.upper(name)
    host = F.when(u.contains("SOL"), "SOL").when(u.contains("MUR"), "MUR").when(u.contains("PLAFOND"), "PLAFOND")
    shape = F.when(u.contains("CIRCULAIRE"), "CIRCULAIRE").when(u.contains("RECTANGULAIRE"), "RECTANGULAIRE")
    return F.struct(host.alias("host"), shape.alias("shape"))


def within_tolerance(v: Column, ref: Column, abs_tol: float, rel_tol: float = 0.0) -> Column:
    """F-22"""
    return F.abs(v - ref) <= F.greatest(F.lit(abs_tol), F.lit(rel_tol) * F.abs(ref))


def icc_band(x: Column) -> Column:
    """F-23: Koo and Li reading of an intraclass correlation."""
    return F.when(x.isNull(), None).when(x < 0.5, "poor").when(x < 0.75, "moderate").when(x < 0.9, "good").otherwise("excellent")


def strength_band(r: Column) -> Column:
    """F-23"""
    a = F.abs(r)
    return F.when(a.isNull(), None).when(a >= 0.5, "strong").when(a >= 0.3, "moderate").when(a >= 0.1, "weak").otherwise("negligible")


def stars(p: Column) -> Column:
    """F-23"""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def artefact_suspect(rho: Column, n: Column) -> Column:
    """F-23: near-perfect correlation on few units."""
    return (F.abs(rho) > 0.95) & (n < 10)


def classify_feature(name: Column, prefixes: Mapping[str, str], default: str = "other") -> Column:
    """F-24: family of the first matching prefix."""
    return F.coalesce(*[F.when(name.startswith(k), F.lit(v)) for k, v in prefixes.items()], F.lit(default))


def postprocess_congruence(x: Column, mode: str = "raw") -> Column:
    """F-26"""
    if mode == "clip_zero":
        return clip(x, 0.0)
    if mode == "rescale01":
        return (x + 1.0) / 2.0
    return x


def scale_coordinates(df: DataFrame, by: Sequence[str], factor_x: float = 25.7, factor_y: float = 25.95, limit: float = 200.0) -> DataFrame:
    """F-25: CAD units to scene units where a layout's median |x| is above ``limit``."""
    from colloquy.operators.scan import quantiles, attach

    m = quantiles(df.withColumn("_ax", F.abs("x")), by, "_ax", {"_med": 0.5})
    d = attach(df, m, by)
    cad = F.col("_med") > limit
    return (
        d.withColumn("x", F.when(cad, F.col("x") / factor_x).otherwise(F.col("x")))
        .withColumn("y", F.when(cad, F.col("y") / factor_y).otherwise(F.col("y")))
        .drop("_med")
    )
