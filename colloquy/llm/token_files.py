"""Token files in bit planes: ids in fixed-size blocks, transposed into byte or bit planes, zstandard on each plane.

A file holds the documents of one range of doc_id, in ascending order, and at its end an index: for each block its
place, number of ids, checksum and the size of each plane; for each document its id and number of tokens. Blocks are
read one at a time. Files are written by the executors to a shared folder under names of their own; only the files
named in the written index table count, so a lost or repeated task leaves no trace in the result.

Defined results: a null text counts as empty and has the end id alone; rows without a doc_id come first; rows that
share a doc_id are ordered by a hash of the text and the text; empty tables give no file and no row; other columns are
not read.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from colloquy.llm.bpe import Units, byte_letters
from colloquy.llm.common import file_system, map_stream, shared, written

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
END_ID = 2
LEVEL = 3
KNOWN = 1_000_000  # units that a worker remembers, at about 200 bytes each
INDEX = "path string, part int, n_tokens long, n_docs long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """``byte``: 4 planes; ``bit``: 32 planes."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [np.ascontiguousarray(p).tobytes() for p in rows.T]
    return [np.packbits(p).tobytes() for p in np.unpackbits(rows, axis=1, bitorder="little").T]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], 1).copy().view("<u4").ravel()
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], 1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


class PlaneWriter:
    """Writes ids of documents to a binary stream."""

    def __init__(self, out, planes: str = "byte", block: int = BLOCK, level: int = LEVEL):
        self.out, self.planes, self.block, self.pack = out, planes, block, zstandard.ZstdCompressor(level=level)
        self.held, self.at = bytearray(), len(MAGIC)
        self.blocks: list[list[int]] = []
        self.docs: list[tuple[int | None, int]] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.held += ids
        while len(self.held) >= 4 * self.block:
            self._flush(4 * self.block)

    def _flush(self, size: int) -> None:
        data = bytes(self.held[:size])
        del self.held[:size]
        packed = [self.pack.compress(p) for p in to_planes(np.frombuffer(data, "<u4"), self.planes)]
        self.blocks.append([self.at, size // 4, zlib.crc32(data), *map(len, packed)])
        for p in packed:
            self.out.write(p)
            self.at += len(p)

    def finish(self) -> int:
        """Writes the rest and the index; the number of ids."""
        if self.held:
            self._flush(len(self.held))
        known = np.array([d is not None for d, _ in self.docs], np.uint8)
        parts = [np.array([d or 0 for d, _ in self.docs], "<i8"), known, np.array([n for _, n in self.docs], "<i8"), np.array(self.blocks, "<i8")]
        packed = [self.pack.compress(p.tobytes()) for p in parts]
        head = json.dumps({"docs": len(self.docs), "blocks": len(self.blocks), "sizes": list(map(len, packed))}).encode()
        for p in [*packed, head, len(head).to_bytes(8, "little"), MAGIC]:
            self.out.write(p)
        return sum(n for _, n in self.docs)


class PlaneReader:
    """Reads a file of ``PlaneWriter`` from a stream that can seek."""

    def __init__(self, source, size: int):
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a file of id planes")
        length = int.from_bytes(tail[:8], "little")
        source.seek(size - 16 - length)
        head = json.loads(source.read(length))
        source.seek(size - 16 - length - sum(head["sizes"]))
        ids, known, counts, blocks = [self.unpack.decompress(source.read(n)) for n in head["sizes"]]
        self.doc_ids = [i if k else None for i, k in zip(np.frombuffer(ids, "<i8").tolist(), known)]
        self.counts = np.frombuffer(counts, "<i8")
        self.blocks = np.frombuffer(blocks, "<i8").reshape(head["blocks"], -1) if head["blocks"] else np.zeros((0, 7), np.int64)

    def block(self, k: int) -> np.ndarray:
        """The ids of one block, checked."""
        at, n, crc, *sizes = self.blocks[k].tolist()
        self.source.seek(at)
        ids = from_planes([self.unpack.decompress(self.source.read(s)) for s in sizes], n)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        return ids

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """doc_id, number of ids, and the ids in pieces; one block is held at a time."""
        state = {"k": -1, "ids": np.zeros(0, "<u4"), "at": 0}

        def take(n: int):
            while n:
                if state["at"] == len(state["ids"]):
                    state["k"] += 1
                    state["ids"], state["at"] = self.block(state["k"]), 0
                piece = state["ids"][state["at"]:state["at"] + n]
                state["at"] += len(piece)
                n -= len(piece)
                yield piece

        for doc, n in zip(self.doc_ids, self.counts.tolist()):
            pieces = take(n)
            yield doc, n, pieces
            for _ in pieces:  # what the caller left
                pass


@functools.cache
def library_units(path: str) -> Units:
    """The tokenizers library, its results remembered by unit."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    letter = {b: c for c, b in byte_letters().items()}.__getitem__
    model = tokenizer.model

    def encode(text: str) -> bytes:
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):  # one pretoken: no need to split it
            return array("I", [t.id for t in model.tokenize("".join(map(letter, text.encode())))]).tobytes()
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    return Units(encode, encode, KNOWN)


def write_token_files(docs: DataFrame, path: str, end_id: int = END_ID, planes: str = "byte", folder: str | None = None) -> DataFrame:
    """Encode and write; a table of the files (path, part, n_tokens, n_docs), in the order of ``part``."""
    spark = docs.sparkSession
    folder = folder or shared(spark, "tokens")
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = out = None
        part = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs, base = file_system(folder)
                fs.create_dir(base, recursive=True)
                name = f"{part:07d}-{uuid.uuid4().hex}.idp"
                out = fs.open_output_stream(f"{base}/{name}")
                writer, units = PlaneWriter(out, planes), library_units(path)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                writer.add(doc, (units(text) if text else b"") + end)
        if writer is not None:
            n = writer.finish()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([len(writer.docs)], pa.int64())], ["path", "part", "n_tokens", "n_docs"])

    return written(map_stream(rows.select("doc_id", "text"), write, INDEX), "token-index")


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document, read from the files, a file at a time in each task."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.withColumn("start", before)  # a row a file
    n = files.count()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = file_system(path)
                rows = []
                with fs.open_input_file(name) as source:
                    for doc, size, pieces in PlaneReader(source, source.size()).documents():
                        crc = 0
                        for p in pieces:
                            crc = zlib.crc32(p.tobytes(), crc)
                        rows.append((doc, start, size, crc))
                        start += size
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return map_stream(placed.select("path", "start").repartitionByRange(max(1, n), "start"), scan, RESULT)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [x.split()[0] for x in RESULT.split(", ")])


def read_ids(spark: SparkSession, files: DataFrame) -> DataFrame:
    """doc_id and ids of each document, from the files."""

    def scan(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = file_system(path)
                with fs.open_input_file(name) as source:
                    for doc, _, pieces in PlaneReader(source, source.size()).documents():
                        yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([np.concatenate([np.zeros(0, "<u4"), *pieces]).tolist()], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return map_stream(files.select("path").repartition(max(1, files.count()), "path"), scan, "doc_id long, ids array<long>")
