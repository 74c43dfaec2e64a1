"""Importance resampling towards a target: exact document weights from bit planes, and a keyed draw without replacement.

Features are the runs of 1 to ``max_run`` consecutive words, hashed into buckets. With s of S features of the documents
and t of T features of the target in a bucket, its gain is floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))).

A document's bucket counts are written as bit planes: bit b of plane k is bit k of the count in bucket b. The gains are
planes too, in two's complement, the last with a negative sign. The weight, the sum of count times gain, is the sum over
all pairs of planes of the power of two times the number of bits set in both: whole numbers, exact in any order.

The score adds Gumbel noise from sha256 of the seed and doc_id, so the highest scores are a draw without replacement,
proportional to exp(weight / 1000), that any number of tasks repeats alike. Ranks come from ranges of the scores: rows are
numbered inside a range, and the ranges' sizes, one number for each shuffle partition, give the offsets.

Defined results: words are lower-cased (A-Z) runs of ASCII letters, digits and other non-ASCII characters; null and
empty texts have no features and weight 0; a null doc_id counts as the empty text in the hash and comes last among
ties; repeated rows each take part (equal rows share their ranks out among them in any order); empty tables give an
empty result, an empty target T = 0. ``weights`` reads only doc_id and text; ``resample`` keeps all columns. Very long
texts are read in pieces; what is held of one is a count for each bucket.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from colloquy.llm.common import map_stream, written
from colloquy.llm.words import FOLD, pieces

BUCKETS = 10000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
TOGETHER = 64
KNOWN = 300_000


class BucketOf(dict):
    """Bucket of a feature; forgets when it holds too many."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[feature] = b = zlib.crc32(feature) % self.buckets
        return b


def feature_buckets(text: bytes | None, max_run: int, bucket: BucketOf) -> Iterator[np.ndarray]:
    """Buckets of all features of the whole text, piece by piece."""
    carried: list[bytes] = []
    for piece in pieces((text or b"").translate(FOLD)):
        words = piece.split()
        yield np.fromiter(map(bucket.__getitem__, words), np.int64, len(words))
        joined = carried + words
        for size in range(2, max_run + 1):
            first = max(0, len(carried) - size + 1)  # runs that end in this piece
            spans = [b" ".join(joined[i:i + size]) for i in range(first, len(joined) - size + 1)]
            yield np.fromiter(map(bucket.__getitem__, spans), np.int64, len(spans))
        carried = joined[max(0, len(joined) - max_run + 1):] if max_run > 1 else []


def bucket_counts(text: bytes | None, max_run: int, bucket: BucketOf) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that a text meets, ascending, and how often."""
    parts = list(feature_buckets(text, max_run, bucket)) if len(text or b"") < 1 << 16 else None
    if parts is not None:
        return np.unique(np.concatenate(parts), return_counts=True)
    total = np.zeros(bucket.buckets, np.int64)
    for part in feature_buckets(text, max_run, bucket):
        total += np.bincount(part, minlength=bucket.buckets)
    met = np.flatnonzero(total)
    return met, total[met]


def count_planes(counts: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> np.ndarray:
    """(plane, document, word of 64 buckets): bit b of plane k is bit k of the document's count in bucket b."""
    wide = -(-buckets // 64)
    bucket, count = (np.concatenate([c[k] for c in counts]) for k in (0, 1))
    row = np.repeat(np.arange(len(counts)), [len(c[0]) for c in counts])
    word, bit = row * wide + (bucket >> 6), np.uint64(1) << (bucket & 63).astype(np.uint64)
    out = np.zeros((int(count.max(initial=0)).bit_length(), len(counts) * wide), np.uint64)
    for k in range(len(out)):
        has = (count >> k) & 1 == 1
        np.add.at(out[k], word[has], bit[has])  # each bit comes once, so the sum is their union
    return out.reshape(len(out), len(counts), wide)


def gain_planes(gains: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Planes of the gains in two's complement, and the power of two that each stands for (the last is negative)."""
    depth = 1 + max(int(gains.max(initial=0)).bit_length(), int(-1 - gains.min(initial=-1)).bit_length())
    bits = np.zeros((depth, -(-len(gains) // 64) * 64), np.uint8)
    bits[:, :len(gains)] = (gains[None, :] >> np.arange(depth)[:, None]) & 1
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64), [1 << j for j in range(depth - 1)] + [-(1 << (depth - 1))]


def plane_weights(counts: list[tuple[np.ndarray, np.ndarray]], planes: np.ndarray, powers: list[int], buckets: int) -> np.ndarray:
    """Sum of count times gain for each document."""
    out = np.zeros(len(counts), np.int64)
    for k, plane in enumerate(count_planes(counts, buckets)):
        rows = np.flatnonzero(plane.any(1))
        some = plane[rows]
        for gain, power in zip(planes, powers):
            out[rows] += np.bitwise_count(some & gain).sum(1, dtype=np.int64) * (power << k)
    return out


def totals(texts: DataFrame, max_run: int, buckets: int) -> np.ndarray:
    """Features of all rows in each bucket; tasks send one row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, total = BucketOf(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in feature_buckets(text, max_run, bucket):
                    np.add.at(total, part, 1)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in map_stream(texts.select(F.col("text").cast("binary")), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket."""
    more, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + more)) / float((s + 1) * (t_all + more)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 x Gumbel noise) from the first 32 bits of sha256(seed:doc_id)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def own_names(columns: list[str]) -> list[str]:
    """Names for words, features, weight and score that no column of ``columns`` has."""
    taken, mark = {c.lower() for c in columns}, "_"
    while any(mark + name in taken for name in ("n", "f", "w", "score")):
        mark += "_"
    return [mark + name for name in ("n", "f", "w", "score")]


def scored(docs: DataFrame, target: DataFrame, max_run: int, buckets: int, seed: int) -> DataFrame:
    """``docs`` as they are, with words, features, weight and score under ``own_names``."""
    spark, at, names = docs.sparkSession, docs.columns.index("text"), own_names(docs.columns)
    planes = spark.sparkContext.broadcast(gain_planes(gains_of(totals(docs, max_run, buckets), totals(target, max_run, buckets))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = BucketOf(buckets)
        gains, powers = planes.value
        for batch in batches:
            counts, features, weights = [], [], [np.zeros(0, np.int64)]
            for text in batch.column(at).to_pylist():
                counts.append(bucket_counts(None if text is None else text.encode(), max_run, bucket))
                features.append(int(counts[-1][1].sum()))
                if len(counts) == TOGETHER:
                    weights.append(plane_weights(counts, gains, powers, buckets))
                    counts = []
            if counts:
                weights.append(plane_weights(counts, gains, powers, buckets))
            words = pa.array([words_of(f, max_run) for f in features], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, words, pa.array(features, pa.int64()), pa.array(np.concatenate(weights))], [*batch.schema.names, *names[:3]])

    schema = StructType([*docs.schema.fields, *[StructField(name, LongType()) for name in names[:3]]])
    return map_stream(docs, run, schema).withColumn(names[3], F.col(names[2]) + noise(F.col("doc_id"), seed))


def words_of(features: int, max_run: int) -> int:
    """Number of words of a text with so many runs of 1 to ``max_run`` words: n + (n - 1) + ... for n words."""
    for n in range(max_run):
        if n * (n + 1) // 2 == features:
            return n
    return (features + max_run * (max_run - 1) // 2) // max_run


def ranked(rows: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """``rows`` (doc_id, score, ...) with ``rank`` by falling score, then doc_id; how many of them ``percent`` draws."""
    spark, order = rows.sparkSession, (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    # The last key only splits equal rows over ranges: which of them comes first makes no difference.
    spread = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order, "_tie")
    placed = written(spread.withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())  # one row for each shuffle partition
    before, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    starts = spark.createDataFrame(offsets, "_part int, _before long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order, "_tie"))
    return placed.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_before") + inside).drop("_part", "_before", "_tie"), percent * before // 100


def weights(docs: DataFrame, target: DataFrame, max_run: int = 1, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and, for the rows drawn, rank of every row.

    Of the rows with at least ``min_words`` words, ``percent`` of a hundred are drawn.
    """
    names = {"_f": "n_features", "_w": "weight", "_score": "score"}
    rows = written(scored(docs.select("doc_id", "text"), target, max_run, buckets, seed).drop("text").withColumnsRenamed(names), "weights")
    able = F.col("_n") >= min_words
    order, draw = ranked(rows.where(able), percent)
    drawn = order.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return drawn.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long"))).drop("_n")


def resample(docs: DataFrame, target: DataFrame, max_run: int = 1, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows drawn, with all their columns.

    Texts are not shuffled: rows above the last drawn (score, doc_id) are kept where they are; of rows equal to it, as
    many as the draw still has room for.
    """
    n, _, _, score = own_names(docs.columns)
    rows = scored(docs, target, max_run, buckets, seed).where(F.col(n) >= min_words)
    order, draw = ranked(written(rows.select("doc_id", F.col(score).alias("score")), "scores"), percent)
    last = order.where(F.col("rank") == draw).first()
    if last is None:
        return docs.limit(0)
    tied, same = F.col(score) == last["score"], F.col("doc_id").eqNullSafe(F.lit(last["doc_id"]))
    earlier = F.col("doc_id").isNotNull() if last["doc_id"] is None else F.coalesce(F.col("doc_id") < last["doc_id"], F.lit(False))
    room = draw + 1 - order.where((F.col("score") == last["score"]) & same).agg(F.min("rank")).first()[0]
    return rows.where((F.col(score) > last["score"]) | (tied & earlier)).unionByName(rows.where(tied & same).limit(room)).select(*docs.columns)
