"""Registered queries of the operators, with SQL oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm import bpe, decontaminate, language_mixture, licenses, near_dup, periodic_runs, quality_density, quality_rules, resampling, token_files, toxicity, url_filter, warc_fixity
from colloquy.llm.common import read

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
DRILL = "page_id % 97 = 5"

# Host, path and verdict of the URL rules; the list is of the pages whose markup holds a run of asterisks.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def url_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages")
    return url_filter.url_filter(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"), pages.where(F.col("html").contains("***")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": lambda spark, sf: quality_rules.quality_rules(read(spark, sf, "documents"), read(spark, sf, "labels")),
    "op2_token_files": lambda spark, sf: token_files.read_token_files(token_files.write_token_files(read(spark, sf, "documents"), BYTE_BPE)),
    "op3_bpe": lambda spark, sf: bpe.token_digests(read(spark, sf, "documents"), BYTE_BPE),
    "op4_warc_fixity": lambda spark, sf: warc_fixity.audit(read(spark, sf, "pages"), DRILL).select("page_id", "payload_sha256", "replica_0_intact", "replica_1_intact"),
    "op5_decontaminate": lambda spark, sf: decontaminate.contamination(read(spark, sf, "documents"), read(spark, sf, "benchmark")),
    "op6_language_mixture": lambda spark, sf: language_mixture.language_mixture(read(spark, sf, "documents")),
    "op7_near_dup": lambda spark, sf: near_dup.near_duplicates(read(spark, sf, "documents")),
    "op8_licenses": lambda spark, sf: licenses.license_scan(read(spark, sf, "documents")),
    "op9_quality_density": lambda spark, sf: quality_density.quality_scores(read(spark, sf, "documents"), read(spark, sf, "labels")),
    "op10_toxicity": lambda spark, sf: toxicity.toxicity_scores(read(spark, sf, "documents"), read(spark, sf, "labels")),
    "op11_importance_resampling": lambda spark, sf: resampling.weights(read(spark, sf, "documents"), read(spark, sf, "benchmark")),
    "op12_url_filter": url_verdicts,
    "op13_periodic_runs": lambda spark, sf: periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.with_planted_tails(read(spark, sf, "documents")))),
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

# crc32 by its polynomial: one step for each bit of a byte, one entry of the table for each byte.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), CAST(n AS BIGINT))) AS t)"


def _crc(hexadecimal: str) -> str:
    """crc32 of the bytes written as hexadecimal digits."""
    byte = f"CAST('0x' || substr({hexadecimal}, 2 * CAST(i AS INTEGER) + 1, 2) AS BIGINT)"
    step = f"lambda c, i: xor(c >> 8, t[xor(c, {byte}) % 256 + 1])"
    return f"xor(list_reduce(range(length({hexadecimal}) // 2), {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


_FEATURES = lambda table: f"SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM {table}) GROUP BY w"

ORACLES: dict[str, str] = {
    "op11_importance_resampling": f"""
        WITH {_CRC_TABLE},
        doc AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        source AS ({_FEATURES("documents")}), target AS ({_FEATURES("benchmark")}),
        bucket AS (SELECT w, {_crc("hex(encode(w))")} % 10000 AS b FROM (SELECT w FROM source UNION SELECT w FROM target), crc),
        s AS (SELECT b, sum(n) AS s FROM source JOIN bucket USING (w) GROUP BY b),
        t AS (SELECT b, sum(n) AS t FROM target JOIN bucket USING (w) GROUP BY b),
        gain AS (SELECT b, floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) AS DOUBLE)
                   / CAST((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000) AS DOUBLE))) AS g FROM s FULL JOIN t USING (b)),
        weight AS (SELECT doc_id, sum(g) AS weight FROM (SELECT doc_id, unnest(ws) AS w FROM doc) JOIN bucket USING (w) JOIN gain USING (b) GROUP BY doc_id),
        scored AS (SELECT doc_id, len(ws) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                   CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM doc LEFT JOIN weight USING (doc_id)),
        score AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM scored),
        able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM score WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) FROM able) * 10 // 100 THEN r END AS rank
        FROM score LEFT JOIN able USING (doc_id)""",
    "op12_url_filter": r"""
        WITH cut AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        part AS (SELECT page_id, html, regexp_extract(rest, '^[^/?#]*') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
                 regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM cut),
        low AS (SELECT page_id, html, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path,
                list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND split_part(p, '=', 1) NOT IN ('ref', 'fbclid', 'gclid'))) AS ps FROM part),
        page AS (SELECT page_id, html, host, path, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.$', ''), '^(www|m)\.', ''), '')
                 || regexp_replace(path, '/+$', '') || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS canonical FROM low),
        rule(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        best AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
                 FROM page JOIN rule ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
        listed AS (SELECT DISTINCT canonical FROM page WHERE contains(html, '***'))
        SELECT page_id, host, path, rule, coalesce(v, CASE WHEN canonical IN (SELECT canonical FROM listed WHERE canonical IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict
        FROM page LEFT JOIN best USING (page_id)""",
    "op13_periodic_runs": rf"""
        WITH {_CRC_TABLE},
        word AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws, {_crc("hex(encode(CAST(doc_id AS VARCHAR)))")} AS h FROM documents, crc),
        cut AS (SELECT doc_id, ws, len(ws) AS n, h, h // 10 % len(ws) AS a, 1 + (len(ws) - h // 10 % len(ws)) // (3 + h // 10 % 8) AS p FROM word),
        doc AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0
                THEN list_concat(ws[:a], list_transform(range(a, n), lambda i: ws[a + (i - a) % p + 1])) ELSE ws END AS ws FROM cut),
        gram AS (SELECT doc_id, i, hash(array_to_string(ws[i + 1:i + 6], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 5)) AS i FROM doc WHERE len(ws) >= 12)),
        pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM gram x JOIN gram y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
        island AS (SELECT doc_id, q, min(i) AS s, max(i) + 6 + q AS e
                   FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair) GROUP BY doc_id, q, k),
        long AS (SELECT * FROM island WHERE e - s >= greatest(12, 2 * q)),
        run AS (SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.e >= x.e)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM run),
        kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM doc)
                 ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
        best AS (SELECT doc_id, count(*) AS n_runs, max(row(e - s, -s, -q)) AS b, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS rows FROM run GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(-b[2] AS BIGINT) AS start, CAST(b[1] AS BIGINT) AS length, CAST(-b[3] AS BIGINT) AS period,
               CAST(1000 * b[1] // -b[3] AS BIGINT) AS exponent_milli, sha256(coalesce(rows, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM doc LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op4_warc_fixity": """
        SELECT page_id, sha256(coalesce(html, '')) AS payload_sha256, TRUE AS replica_0_intact,
               NOT coalesce(page_id % 97 = 5, FALSE) AS replica_1_intact
        FROM pages""",
    "op5_decontaminate": f"""
        WITH item AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
        need AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS w
                 FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM item WHERE len(ws) > 0)),
        doc AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        win AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w
                FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM need) WHERE len(ws) >= n)),
        hit AS (SELECT win.doc_id, win.i, win.n, need.item_id FROM win JOIN need USING (n, w)),
        place AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN place USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_near_dup": f"""
        WITH RECURSIVE doc AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        sh AS (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
               FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM doc WHERE len(ws) > 0)),
        el AS (SELECT doc_id, hash(s, row_number() OVER (PARTITION BY doc_id, s)) AS e FROM sh),
        size AS (SELECT doc_id, count(*) AS n FROM el GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM el a JOIN el b ON a.e = b.e AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b, shared = p.n AND shared = q.n AS same
                 FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 9 * shared >= 4 * (p.n + q.n)),
        reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        lab AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
        own AS (SELECT a, min(b) AS b FROM link WHERE same GROUP BY a)
        SELECT doc_id, least(doc_id, coalesce(own.b, doc_id)) AS node, least(doc_id, coalesce(lab.b, doc_id)) AS class_id,
               doc_id = least(doc_id, coalesce(lab.b, doc_id)) AS kept
        FROM doc LEFT JOIN lab ON lab.a = doc_id LEFT JOIN own ON own.a = doc_id""",
}
