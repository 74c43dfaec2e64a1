"""Helpers shared by the operators: batches of texts, bounded samples, shared folders, files."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from colloquy.session import checkpoint_dir

WHITE = b" \t\n\r\x0b\x0c"
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared(spark: SparkSession, name: str) -> str:
    """URI of a new folder below the cluster's shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the copy outlives lost executors and cuts lineage."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """pyarrow's file system for ``uri`` and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def map_stream(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over small batches: texts are long, and a batch is held several times over."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """One output batch for each input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return map_stream(df, run, schema)


def fold(doc_id: int | None, n: int) -> int:
    """crc32 of the id's text, modulo ``n``; ids that are null count as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def fold_column(doc_id, n: int):
    """The same as a Column."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


MAX_KEYS = 10_000


def bounded_sample(labels: DataFrame, keys: list[str], limit: int, seed: int = 0, ties: list[str] = [], by: str = "doc_id") -> DataFrame:
    """At most ``limit`` rows for each value of ``keys``, those with the smallest seeded hash of ``by``; ``_n`` counts them.

    ``_weight`` is the number of rows of the key that a sampled row stands for. ``ties`` orders rows of one ``by``.

    Rows are thinned by that hash to about twice the limit where they lie, before any of them moves: the counts of the
    keys, a row for each value, are broadcast up to ``MAX_KEYS`` values. So no task reads many rows of one key.
    """
    seen = written(labels.groupBy(*keys).agg(F.count("*").alias("_all")), "counts")
    h = F.xxhash64(F.col(by), F.lit(seed))
    near = (F.pmod(h, F.lit(1 << 30)) / float(1 << 30)) * F.col("_all") <= 2.0 * limit + 50
    thin = labels.join(F.broadcast(seen) if seen.count() <= MAX_KEYS else seen.hint("merge"), keys).where(near)
    order = Window.partitionBy(*keys).orderBy(F.pmod(h, F.lit(1 << 30)), F.col(by), *ties)
    return thin.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).withColumn("_weight", F.col("_all") / F.least("_all", F.lit(limit))).drop("_all")


def labelled(labels: DataFrame, target: str) -> DataFrame:
    """doc_id and ``y`` (0 or 1), one row per labelled document.

    Null ids and labels are left out. A document with several labels takes the larger one.
    """
    rows = labels.select("doc_id", F.col(target).cast("int").alias("y"))
    return rows.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))


def text_key(text=None):
    """Digest of a text, by default of the column ``text``; null counts as empty."""
    return F.sha2(F.coalesce(F.col("text") if text is None else text, F.lit("")).cast("binary"), 256)


def distinct_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each text and label ``y`` of ``rows`` (doc_id, y): digest, smallest doc_id, number of ``copies``."""
    return docs.select("doc_id", text_key().alias("_text")).join(rows, "doc_id").groupBy("y", "_text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, ...), a bounded sample, with the text of each; a repeated doc_id gives a row for each of its texts.

    The sample is broadcast: its size is bounded by the parameters of ``bounded_sample``.
    """
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
