"""Near-duplicate groups by BagMinHash: signatures of multisets of five-word shingles, banded, with verified overlap.

Every distinct shingle of a document starts Poisson processes over the dyadic intervals (0,1], (1,2], (2,4], ... of
its weight, the number of its occurrences, seeded by the shingle and the interval alone. A point has a time, a
component of the signature and a unit of weight; it counts where the unit is at most the weight. The earliest time
in each component agrees between two documents with a chance equal to their weighted Jaccard similarity.
Processes stop once their time is past all components of the signature, so long texts cost little more than one point
a shingle.

Documents with equal multisets are one node. Nodes that share a band of ``ROWS`` components meet; each band's group is
first compared with one of its members only (a star), and nodes that link are joined into components. Groups that
still hold several components are compared across them: groups of at most ``FEW`` nodes pair by pair, the nodes of
larger ones by an exact join on the rarest elements of their multisets (``across``). So no link between nodes that
share a band is lost, while a large group is never expanded into pairs. Every link is verified: with a and b the shingles of two
documents, counted with repeats, the overlap must be at least 0.8 of the union.

Defined results: words are lower-cased runs of ASCII letters, digits and other non-ASCII characters; a text of one to
four words is one shingle; a document without words (null or empty texts) is alone in its class; a null doc_id
gives a null class; rows that share a doc_id are one node; classes are named by their smallest doc_id. Empty tables give
an empty result; other columns are not read by ``near_duplicates`` and all kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from colloquy.llm.common import map_stream, written
from colloquy.llm.words import split_words

SHINGLE = 5
BANDS, ROWS = 32, 6
FEW = 8
SIZE = BANDS * ROWS
CHUNK = 1 << 18
TICKS = 1 << 34
KNOWN = 300_000
SKETCH = "doc_id long, digest binary, n long, bands array<long>"

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values, one for each different input."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_word_hash = WordHash()


def shingles(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles in ascending order, and how often each occurs."""
    words = split_words(text)
    h = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h, np.zeros(0, np.int64)
    size = min(SHINGLE, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        out = mixed((out ^ h[j:len(h) - size + 1 + j]) * _A)
    return np.unique(out, return_counts=True)


def bag(text: bytes | None) -> np.ndarray:
    """The multiset as a set: the k-th occurrence of a shingle is an element of its own."""
    d, w = shingles(text)
    first = np.repeat(np.cumsum(w) - w, w)
    k = (np.arange(len(first)) - first).astype(np.uint64)
    return np.sort(mixed(np.repeat(d, w) + k * _A).view(np.int64))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """Signature of each (hashes, counts): the earliest time in each component. All bags hold a shingle."""
    d, w = (np.concatenate([b[k] for b in bags]) for k in (0, 1))
    doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    seeds, docs, widths, lows, tops = [], [], [], [], []
    level, low, left = 0, 0, np.arange(len(d))
    while len(left):  # intervals (low, low + width] that begin below the weight
        width = max(1, low)
        seeds.append(mixed(d[left] + np.uint64((level + 1) * int(_C) % (1 << 64))))
        docs.append(doc[left])
        widths.append(np.full(len(left), width, np.float64))
        lows.append(np.full(len(left), low, np.int64))
        tops.append(w[left])
        low, level = low + width, level + 1
        left = left[w[left] > low]
    seed, doc, width, low, top = (np.concatenate(x) for x in (seeds, docs, widths, lows, tops))
    # Times are whole numbers, so that their sums do not depend on how the points are cut into blocks.
    time, step = np.zeros(len(seed), np.int64), np.zeros(len(seed), np.uint64)
    flat = np.full(len(bags) * size, np.iinfo(np.int64).max)
    while len(seed):
        points = int(np.clip(8192 // len(seed), 1, 256))
        u = mixed(seed[:, None] + (step[:, None] + np.arange(1, points + 1, dtype=np.uint64)) * _A)
        gap = -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0) / width[:, None]
        t = time[:, None] + np.cumsum(np.ceil(gap * TICKS).astype(np.int64), axis=1)
        v = mixed(u ^ _A)
        component = (v >> np.uint64(40)).astype(np.int64) % size
        unit = low[:, None] + np.floor(((v & np.uint64((1 << 40) - 1)).astype(np.float64) / (1 << 40)) * width[:, None]).astype(np.int64) + 1
        counts = unit <= top[:, None]
        np.minimum.at(flat, (doc[:, None] * size + component)[counts], t[counts])
        time, step = t[:, -1], step + np.uint64(points)
        alive = time < flat.reshape(len(bags), size).max(1)[doc]
        seed, doc, width, low, top, time, step = (x[alive] for x in (seed, doc, width, low, top, time, step))
    return flat.reshape(len(bags), size)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of each signature."""
    x = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _B, x.shape[:2]).copy()
    for j in range(rows):
        out = mixed((out ^ x[:, :, j]) * _A)
    return out.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the multiset, number of shingles, band keys; documents without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bags, held = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                b = shingles(text)
                if len(b[0]):
                    ids.append(doc)
                    bags.append(b)
                    held += len(b[0])
                if held > CHUNK:
                    yield sketch(ids, bags)
                    ids, bags, held = [], [], 0
            if bags:
                yield sketch(ids, bags)

    def sketch(ids, bags) -> pa.RecordBatch:
        keys = band_keys(signatures(bags))
        digests = [hashlib.blake2b(d.tobytes() + w.tobytes(), digest_size=16).digest() for d, w in bags]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array([int(w.sum()) for _, w in bags], pa.int64()), lists], ["doc_id", "digest", "n", "bands"])

    return map_stream(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("binary")), run, SKETCH)


def bags_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id and multiset of the documents named in ``nodes``."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bag(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["doc_id", "bag"])

    texts = docs.select("doc_id", F.col("text").cast("binary")).join(nodes.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return map_stream(texts, run, "node long, bag array<long>")


def verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multisets overlap by at least 0.8 of their union."""
    one, two = bags.select(F.col("node").alias("a"), F.col("bag").alias("_a")), bags.select(F.col("node").alias("b"), F.col("bag").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(one, "a").join(two, "b").where(9 * both >= 4 * (F.size("_a") + F.size("_b"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, for nodes with a link.

    Every node points to the smallest node it knows of; each round hooks and shortens, and the rounds stop when
    nothing changes.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        far = label.select(F.col("node").alias("b"), F.col("label").alias("_far"))
        near = edges.join(far, "b").groupBy("a").agg(F.min("_far").alias("_near")).withColumnRenamed("a", "node")
        hooked = label.join(near, "node").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("_new"))
        # a node's old label learns of the smaller label too
        told = hooked.groupBy(F.col("_old").alias("node")).agg(F.min("_new").alias("_told"))
        new = hooked.join(told, "node", "left").select("node", "_old", F.least("_new", "_told").alias("_new"))
        jump = new.select(F.col("node").alias("_new"), F.col("_new").alias("_jump"))
        after = written(new.join(jump, "_new").select("node", "_old", F.least("_new", "_jump").alias("label")), "labels")
        if not after.where(F.col("label") != F.col("_old")).limit(1).count():
            return after.select("node", "label")
        label = after.select("node", "label")


def centres(groups: DataFrame) -> DataFrame:
    """(key, a, _n): each group's node with the largest ``centre``."""
    top = groups.groupBy("key").agg(F.max("centre").alias("_top"))
    return groups.join(top, "key").where(F.col("centre") == F.col("_top")).select("key", F.col("node").alias("a"), F.col("n").alias("_n"))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


BIN = 1.03


def across(nodes: DataFrame, bags: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different parts that may overlap by 0.8, complete.

    Elements are ordered by the number of nodes that hold them. Two multisets of x >= y elements with an overlap of
    o >= 4 (x + y) / 9 share an element among the first x - o + 1 and y - o + 1. The smaller one needs its first
    y - 8y/9 + 1 elements only, whatever its partner; the larger one is looked up by classes of partner sizes that
    differ by 3 %. Elements all of whose holders are in one part are left out before the parts meet.
    """
    held = nodes.join(bags, "node").select("node", "n", "part", F.explode("bag").alias("e"))
    common = held.groupBy("e").agg(F.count("*").alias("f")).where("f > 1")
    shared = held.join(common, "e")
    w = Window.partitionBy("node")  # one document's elements
    rank = F.row_number().over(w.orderBy("f", "e"))
    at = (F.col("n") - F.count("*").over(w) + rank - 1).alias("at")  # elements that no other node holds come first
    up = lambda c: F.ceil(c).cast("long")
    size_class = lambda c: F.floor(F.log(c.cast("double")) / F.lit(math.log(BIN)) + 1e-9).cast("int")
    n = F.col("n")
    placed = written(shared.select("node", "n", "part", "e", at).where(F.col("at") <= n - up(n * 4 / 5)), "placed")
    small = placed.where(F.col("at") <= n - up(n * 8 / 9)).withColumn("c", size_class(n))
    large = placed.withColumn("c", F.explode(F.sequence(size_class(up(n * 4 / 5)), size_class(n))))
    least = F.greatest(F.pow(F.lit(BIN), F.col("c").cast("double")) - 1e-6, n * 4 / 5)
    large = large.where(F.col("at") <= n - up((n + least) * 4 / 9 - 1e-6))
    both = small.select("e", "c", "part").unionByName(large.select("e", "c", "part"))
    mixed_up = written(both.groupBy("e", "c").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("e", "c"), "elements")
    small, large = (x.join(mixed_up, ["e", "c"]).select("e", "c", "part", "node", "n") for x in (small, large))
    small, large = written(small, "small"), written(large, "large")
    parts = small.select("e", "c", F.col("part").alias("p")).distinct().join(large.select("e", "c", F.col("part").alias("q")).distinct(), ["e", "c"]).where("p != q")
    one = parts.join(small.select("e", "c", F.col("part").alias("p"), F.col("node").alias("a"), F.col("n").alias("_n")), ["e", "c", "p"])
    two = large.select("e", "c", F.col("part").alias("q"), F.col("node").alias("b"), "n")
    return one.join(two, ["e", "c", "q"]).where((5 * F.col("_n") >= 4 * n) & (F.col("_n") <= n)).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, node (the smallest doc_id with an equal multiset), class_id, and whether the document names its class.

    Tables that grow with the documents are joined by merge at every size; none is broadcast while it is still small.
    """
    sketch = written(sketches(docs), "sketches")
    nodes = sketch.groupBy("digest").agg(F.min("doc_id").alias("node"))
    named = written(sketch.select("doc_id", "digest").join(nodes, "digest").select("doc_id", "node").groupBy("doc_id").agg(F.min("node").alias("node")), "nodes")
    own = sketch.join(named.where("doc_id = node").select("doc_id").hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "n", F.explode("bands").alias("key"))
    groups = own.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    met = own.join(groups.hint("merge"), "key").distinct()
    # The node that meets most others is the likeliest centre of its group; equal ones are told apart by a hash.
    weight = met.groupBy("node").agg((F.sum("k") * (1 << 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20))).alias("centre"))
    met = written(met.join(weight, "node"), "met")
    bags = written(bags_of(docs, met.select("node").distinct()), "bags")

    fits = 5 * F.least("_n", "n") >= 4 * F.greatest("_n", "n")
    found = met.join(centres(met), "key").where((F.col("node") != F.col("a")) & fits).select("a", F.col("node").alias("b"))
    links = written(verified(ordered(found), bags), "links")
    label = components(links)

    split = met.join(label, "node", "left").select("key", "k", "node", "n", F.coalesce("label", "node").alias("part"))
    mixed_up = split.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    split = written(split.join(mixed_up, "key"), "split")
    few = split.where(F.col("k") <= FEW)
    other = few.select("key", F.col("node").alias("a"), F.col("n").alias("_n"), F.col("part").alias("_part"))
    pairs = few.join(other, "key").where((F.col("part") < F.col("_part")) & fits).select("a", F.col("node").alias("b"))
    pairs = pairs.unionByName(across(split.where(F.col("k") > FEW).select("node", "n", "part").distinct(), bags))
    links = written(links.unionByName(verified(ordered(pairs), bags)), "links")
    label = components(links)

    rows = docs.select("doc_id").join(named, "doc_id", "left").withColumn("node", F.coalesce("node", "doc_id"))
    out = rows.join(label, "node", "left").withColumn("class_id", F.coalesce("label", "node"))
    return out.select("doc_id", "node", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, one document of each class; rows without a doc_id stay."""
    ids = written(near_duplicates(docs).where("kept").groupBy("doc_id").agg(F.count("*").alias("_rows")), "kept")
    kept = docs.join(ids.withColumnsRenamed({"doc_id": "_kept_id", "_rows": "_kept_rows"}).hint("merge"), F.col("doc_id") == F.col("_kept_id"))  # both branches read one shuffle
    once, often = kept.where("_kept_rows = 1"), kept.where("_kept_rows > 1").dropDuplicates(["doc_id"])
    return once.unionByName(often).select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
