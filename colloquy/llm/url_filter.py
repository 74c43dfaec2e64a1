"""URL filter: rules for hosts with a path, and a list of canonical URLs, found through a blocked Bloom filter.

Every URL yields the keys it could be listed under: its canonical form, and for the rules each ending of its host at a dot
with each beginning of its path as long as a rule's. The filter has blocks of 512 bits; a key belongs to one block and
sets one of 64 bits in each of its eight words. Keys that the filter lets pass are possible hits; an exact join with the
listed keys removes the false ones. The longest matching rule decides; without one, a listed URL is blocked and any other
allowed.

The filter is a table of blocks, put together on the executors and broadcast: at most ``MAX_BLOCKS`` rows, whatever the
length of the list. A list too long for sixteen bits a key fills the blocks more and lets more false hits pass to the
exact join; results do not change. URLs are made distinct first. In the exact joins, keys that hold more than one in
``HOT`` of the rows, fewer than ``HOT`` keys in all, are joined by broadcast and the others by a shuffle, so no task takes
a frequent key's rows.

Canonical form: host without user, port, leading ``www.`` or ``m.`` and final dot; path without trailing slashes; query
parameters sorted, without empty ones and those that only track; no fragment; no scheme.

Defined results: a null URL or one without ``://`` has an empty host and path, meets no rule, is not listed and is
allowed; a rule without a path fits every path, and a path that a rule asks for does not fit a URL without it; repeated
pages each give a row; a rule listed twice with both verdicts blocks; null rules and list entries are left out; empty
tables give an empty result and empty lists allow all; other columns of the tables are not read. Very long URLs are
treated as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8
BITS = 16
MAX_BLOCKS = 1 << 18
HOT = 256

# Query parameters that do not tell pages apart (exact names, and beginnings).
TRACKING = ("ref", "fbclid", "gclid")
TRACKING_STARTS = "utm_"


def host_and_path(url: Column) -> tuple[Column, Column, Column]:
    """Lower-case host, path and query of a URL; all empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    authority = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substring(rest, F.length(authority) + 1, F.length(text))
    return F.translate(authority, UPPER, LOWER), F.regexp_extract(tail, "^[^?#]*", 0), F.regexp_extract(tail, "^[^?#]*\\?([^#]*)", 1)


def canonical(url: Column) -> Column:
    """Canonical form of a URL; null where it has no host."""
    host, path, query = host_and_path(url)
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "\\.$", ""), "^(www|m)\\.", "")
    tracks = lambda p: F.split(p, "=")[0].isin(*TRACKING) | p.startswith(TRACKING_STARTS)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~tracks(p)))
    return F.when(bare != "", F.concat(bare, F.regexp_replace(path, "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every ending of the host at a dot, followed by the beginnings of the path of the given lengths."""
    labels = F.split(host, "\\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(ends, lambda e: F.transform(starts, lambda n: F.concat(F.lit("rule "), e, F.substring(path, F.lit(1), n)))))
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


def masks(key: Column) -> list[Column]:
    """The bit that a key sets in each word of its block."""
    h = F.xxhash64(key, F.lit(2))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks))


def blocked_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """Blocks of the filter over the column ``key`` that hold a bit: _block and its words."""
    rows = keys.select(block(F.col("key"), blocks).alias("_block"), *[m.alias(f"_w{i}") for i, m in enumerate(masks(F.col("key")))])
    return rows.groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)])


def blocks_for(n: int) -> int:
    return max(1, min(MAX_BLOCKS, -(-n * BITS // (64 * WORDS))))


def possible_hits(rows: DataFrame, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """The rows whose ``key`` the filter lets pass."""
    met = rows.withColumn("_block", block(F.col("key"), blocks)).join(F.broadcast(filter_blocks), "_block")  # at most MAX_BLOCKS rows
    passes = F.lit(True)
    for i, mask in enumerate(masks(F.col("key"))):
        passes = passes & (F.col(f"_w{i}").bitwiseAND(mask) != 0)
    return met.where(passes).select(*rows.columns)


def join_spread(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Left join with ``facts``, one row for each ``key``; ``rows`` is a written table whose key is never null.

    Keys of more than one in ``HOT`` of the rows are fewer than ``HOT``: they and their facts are broadcast.
    """
    n = rows.count()
    hot = rows.groupBy(key).count().where(F.col("count") > n / HOT).select(key)
    hot = written(hot, "hot-keys")
    often = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(facts.join(F.broadcast(hot), key, "left_semi")), key, "left")
    rare = rows.join(F.broadcast(hot), key, "left_anti").join(facts.hint("merge"), key, "left")
    return often.unionByName(rare)


def url_verdicts(urls: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """host, path, rule and verdict of the distinct values of the column ``url``, none of them null.

    ``rules``: host, path, verdict (allow or block). ``listed``: url, blocked in all its spellings.
    """
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull() & (F.col("host") != ""))
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())  # one number for each length of path
    by_rule = rules.select(
        F.concat(F.lit("rule "), "host", "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict",
        F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"),
    )
    by_url = listed.select(canonical(F.col("url")).alias("key")).where("key IS NOT NULL").select(
        F.concat(F.lit("url "), "key").alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), F.lit(0).alias("size"), F.lit(0).alias("host_size"),
    )
    entries = by_rule.unionByName(by_url).groupBy("key").agg(F.max("verdict").alias("verdict"), *[F.first(c).alias(c) for c in ("rule", "size", "host_size")])
    entries = written(entries, "listed")
    blocks = blocks_for(entries.count())

    url = F.col("url")
    host, path, _ = host_and_path(url)
    parts = urls.select("url").distinct().select("url", host.alias("host"), path.alias("path"), canonical(url).alias("_c"))
    keys = F.concat(rule_keys(F.col("host"), F.col("path"), lengths), F.when(F.col("_c").isNotNull(), F.array(F.concat(F.lit("url "), "_c"))).otherwise(F.array().cast("array<string>")))
    parts = parts.select("url", "host", "path", F.array_distinct(keys).alias("_keys"))
    hits = written(possible_hits(parts.select("url", F.explode("_keys").alias("key")), blocked_filter(entries.select("key"), blocks), blocks), "hits")
    exact = join_spread(hits, entries, "key").where(F.col("verdict").isNotNull())
    best = exact.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), F.struct("size", "host_size")).alias("_best"))
    return written(best.select("url", "_best.rule", "_best.verdict"), "verdicts")


def url_filter(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url)."""
    host, path, _ = host_and_path(F.col("url"))
    rows = written(pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")), "urls")
    found = join_spread(rows, url_verdicts(rows, rules, listed), "url")
    return found.select("page_id", host.alias("host"), path.alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def allowed_pages(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """``pages`` with all its columns, without those whose URL is blocked.

    A blocked URL goes with all its rows; pages are read where they are and the blocked URLs are joined to them.
    """
    urls = pages.select(F.coalesce("url", F.lit("")).alias("url"))
    blocked = url_verdicts(urls, rules, listed).where("verdict = 'block'").select(F.col("url").alias("_listed_url"))
    return pages.join(blocked, F.col("url") == F.col("_listed_url"), "left_anti")
