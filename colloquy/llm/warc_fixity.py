"""WARC archives with Merkle fixity: write, hash, compare replicas and locate damage.

Each task writes the pages of its partition as one gzip member a record, the same bytes to every replica, and beside
the archive a manifest: for each record its place, length and SHA-256. Over the records of an archive stands a tree of
nodes that each cover ``FANOUT`` children and an ordered range of offsets; over the archives stands one more tree.
A replica is audited by hashing the byte ranges of the manifest again; its roots are compared with the reference, and
only the children of nodes that differ are compared further, down to the records.

A node's hash is the SHA-256 of the offset range and hash of each child in order. Missing or short files hash to what is there,
so they differ where bytes are missing.

Defined results: null urls and pages give empty fields; repeated page_ids give a record each; empty tables give no
archive; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import file_system, map_stream, shared, written

FANOUT = 16
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
ENTRY = np.dtype([("page_id", "<i8"), ("known", "?"), ("offset", "<i8"), ("length", "<i8"), ("sha256", "S64"), ("payload", "S64")])
NODES = "archive string, level int, idx long, start long, stop long, hash string"
ARCHIVES = "archive string, n_records long"


def record(page_id: int | None, url: str | None, html: bytes) -> bytes:
    """One response record."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + html
    head = (
        f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {url or ''}\r\n"
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(html).hexdigest()}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return gzip.compress(head.encode() + body + b"\r\n\r\n", LEVEL, mtime=0)


class Tree:
    """Merkle tree over records in order; holds at most ``FANOUT`` open children a level."""

    def __init__(self):
        self.open: list[list[tuple[int, int, str]]] = []
        self.done: list[tuple[int, int, int, int, str]] = []
        self.count: list[int] = []

    def add(self, start: int, stop: int, sha: str, level: int = 0) -> None:
        if level == len(self.open):
            self.open.append([])
            self.count.append(0)
        self.done.append((level, self.count[level], start, stop, sha))
        self.count[level] += 1
        self.open[level].append((start, stop, sha))
        if len(self.open[level]) == FANOUT:
            self._close(level)

    def _close(self, level: int) -> None:
        children = self.open[level]
        self.open[level] = []
        self.add(children[0][0], children[-1][1], join_hashes(children), level + 1)

    def finish(self) -> None:
        """Close partly filled nodes up to one root."""
        level = 0
        while level < len(self.open):
            if self.open[level] and not (level == len(self.open) - 1 and self.count[level] == 1):
                self._close(level)
            level += 1

    def take(self) -> list[tuple[int, int, int, int, str]]:
        out, self.done = self.done, []
        return out


def join_hashes(children: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256("".join(f"{a}-{b}:{h};" for a, b, h in children).encode()).hexdigest()


def damaged_bytes(data: bytes) -> bytes:
    """The record with its middle byte changed; for drills."""
    at = len(data) // 2
    return data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1:]


def write_archives(pages: DataFrame, replicas: int = 2, folder: str | None = None, damage: str | None = None) -> tuple[DataFrame, list[str]]:
    """Write each partition to every replica; the table of archives and the replicas' folders.

    ``damage``, an SQL condition on a page, spoils the record of such pages in the last replica: a drill for the audit.
    """
    folders = [f"{folder or shared(pages.sparkSession, 'warc')}/replica-{k}" for k in range(replicas)]
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"), F.coalesce(F.expr(damage or "false"), F.lit(False)).alias("bad"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outs, name, at, entries = [], f"{uuid.uuid4().hex}.warc.gz", 0, []
        for batch in batches:
            for page, url, html, bad in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if not outs:
                    for f in folders:
                        fs, base = file_system(f)
                        fs.create_dir(base, recursive=True)
                        outs.append(fs.open_output_stream(f"{base}/{name}", compression=None))
                data = record(page, url, html)
                for k, out in enumerate(outs):
                    out.write(damaged_bytes(data) if bad and k == len(outs) - 1 else data)
                entries.append((page or 0, page is not None, at, len(data), hashlib.sha256(data).hexdigest().encode(), hashlib.sha256(html).hexdigest().encode()))
                at += len(data)
        for out in outs:
            out.close()
        if outs:
            for f in folders:
                fs, base = file_system(f)
                with fs.open_output_stream(f"{base}/{name}.manifest", compression=None) as out:
                    out.write(np.array(entries, ENTRY).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(entries)], pa.int64())], ["archive", "n_records"])

    return written(map_stream(rows, write, ARCHIVES), "archives"), folders


def manifest(folder: str, archive: str) -> Iterator[np.ndarray]:
    """Entries of an archive's manifest, some thousand at a time."""
    fs, base = file_system(folder)
    with fs.open_input_stream(f"{base}/{archive}.manifest", compression=None) as source:
        while data := source.read(4096 * ENTRY.itemsize):
            yield np.frombuffer(data, ENTRY)


def _each(archives: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(archive)`` yields lists of rows; an archive a task."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[f.split()[1]] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                for rows in fn(archive):
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return map_stream(archives.select("archive").repartitionByRange(max(1, archives.count()), "archive"), run, schema)


def _nodes(archive: str, hashes) -> Iterator[list[tuple]]:
    tree = Tree()
    for start, stop, sha in hashes:
        tree.add(start, stop, sha)
        if len(tree.done) >= 8192:
            yield [(archive, *n) for n in tree.take()]
    tree.finish()
    yield [(archive, *n) for n in tree.take()]


def reference_tree(archives: DataFrame, folder: str) -> DataFrame:
    """Nodes over the hashes that were taken when the archives were written."""

    def hashes(archive: str):
        end = 0
        for part in manifest(folder, archive):
            for e in part:
                end = int(e["offset"] + e["length"])
                yield int(e["offset"]), end, e["sha256"].decode()
        yield end, end, hashlib.sha256().hexdigest()  # nothing follows the last record

    return _each(archives, lambda a: _nodes(a, hashes(a)), NODES)


def replica_tree(archives: DataFrame, reference: str, folder: str) -> DataFrame:
    """Nodes over a replica's bytes, read again at the offset ranges of the reference manifest and behind the last one."""

    def hashes(archive: str):
        fs, base = file_system(folder)
        try:
            source = fs.open_input_stream(f"{base}/{archive}", compression=None)
        except FileNotFoundError:
            source = None
        end = 0
        for part in manifest(reference, archive):
            for e in part:
                data, end = source.read(int(e["length"])) if source else b"", int(e["offset"] + e["length"])
                yield int(e["offset"]), end, hashlib.sha256(data).hexdigest()
        rest = hashlib.sha256()
        while source and (data := source.read(1 << 20)):
            rest.update(data)
        yield end, end, rest.hexdigest()
        if source:
            source.close()

    return _each(archives, lambda a: _nodes(a, hashes(a)), NODES)


def upper_tree(nodes: DataFrame) -> DataFrame:
    """Tree over the archives' roots, in order of their names: (level, idx, hash), level 0 the roots."""
    from pyspark.sql import Window

    tops = nodes.groupBy("archive").agg(F.max("level").alias("level"))
    roots = nodes.join(tops, ["archive", "level"])
    level = roots.select(F.lit(0).alias("level"), (F.row_number().over(Window.orderBy("archive")) - 1).cast("long").alias("idx"), "hash")  # a row an archive
    out, n, k = level, roots.count(), 0
    while n > 1:
        k, n = k + 1, -(-n // FANOUT)
        children = F.array_sort(F.collect_list(F.struct("idx", "hash")))
        level = level.groupBy(F.floor(F.col("idx") / FANOUT).alias("up")).agg(F.sha2(F.array_join(F.transform(children, lambda c: c["hash"]), ";"), 256).alias("hash")).select(F.lit(k).alias("level"), F.col("up").alias("idx"), "hash")
        out = out.unionByName(level)
    return out


def roots_equal(one: DataFrame, two: DataFrame) -> bool:
    """Whether two replicas have the same root."""
    top = lambda nodes: [(r["level"], r["hash"]) for r in upper_tree(nodes).orderBy(F.desc("level")).limit(1).collect()]
    return top(one) == top(two)


def differing_records(one: DataFrame, two: DataFrame) -> DataFrame:
    """(archive, idx, start, stop) of the records that differ: descends from the roots into differing nodes only.

    Bytes behind the last record of an archive are a leaf of their own: its idx is the number of records, stop = start.
    """
    if roots_equal(one, two):
        return one.where(F.lit(False)).select("archive", "idx", "start", "stop")
    tops = one.groupBy("archive").agg(F.max("level").alias("level"))
    deepest = one.agg(F.max("level")).first()[0]
    other = two.select("archive", "level", "idx", F.col("hash").alias("_hash"))

    def compare(some: DataFrame) -> DataFrame:
        return some.join(other, ["archive", "level", "idx"], "left").where(~F.col("hash").eqNullSafe(F.col("_hash"))).select("archive", "level", "idx", "start", "stop")

    differ = compare(one.join(tops, ["archive", "level"]))
    for level in range(deepest, 0, -1):
        parents = differ.where(F.col("level") == level).select("archive", F.col("idx").alias("_up"))
        children = one.where(F.col("level") == level - 1).withColumn("_up", F.floor(F.col("idx") / FANOUT)).join(parents, ["archive", "_up"], "left_semi").drop("_up")
        differ = differ.where(F.col("level") < level).unionByName(compare(children))
    return differ.select("archive", "idx", "start", "stop")


def audit(pages: DataFrame, damage: str | None = None) -> DataFrame:
    """Archive ``pages`` twice and audit both replicas: one row per record with its place and whether both are intact.

    page_id, payload_sha256, archive, offset, length, replica_0_intact, replica_1_intact.
    """
    archives, folders = write_archives(pages, 2, damage=damage)
    reference = written(reference_tree(archives, folders[0]), "tree")
    entries = _each(archives, lambda a: _entries(folders[0], a), "archive string, idx long, page_id long, offset long, length long, payload_sha256 string")
    for k, folder in enumerate(folders):
        bad = differing_records(reference, written(replica_tree(archives, folders[0], folder), "tree")).select("archive", "idx", F.lit(True).alias(f"bad_{k}"))
        entries = entries.join(bad, ["archive", "idx"], "left")
    intact = [F.col(f"bad_{k}").isNull().alias(f"replica_{k}_intact") for k in range(len(folders))]
    return entries.select("page_id", "payload_sha256", "archive", "offset", "length", *intact)


def _entries(folder: str, archive: str) -> Iterator[list[tuple]]:
    idx = 0
    for part in manifest(folder, archive):
        rows = [(archive, idx + i, int(e["page_id"]) if e["known"] else None, int(e["offset"]), int(e["length"]), e["payload"].decode()) for i, e in enumerate(part)]
        idx += len(rows)
        yield rows
