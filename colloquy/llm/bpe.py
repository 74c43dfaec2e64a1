"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding.

A merge list has a sufficient lookahead: a number of bytes such that what follows a place by more than that many bytes
can't change the tokens that end there (``sufficient_lookahead``). The encoder takes a text block by block. It closes a
pretoken as soon as no later character can extend it; inside a pretoken that never ends it emits those tokens that end
more than the lookahead before the known end, and keeps only the bytes behind them. What it holds is bounded by the
block, the lookahead and a cache of bounded size, however long the text or its words are.

The decoder maps ids to bytes and bytes to text with an incremental UTF-8 state machine; bytes that are no text become
U+FFFD, and it holds at most the three bytes of an unfinished character.

Defined results: a null text counts as empty, and an empty text has no tokens; special tokens in a text get their own
ids; repeated rows each give a row; other columns are not read.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from colloquy.llm.common import map_batches, map_stream

BLOCK = 1 << 16
LONG = 1 << 12
GUARD = 16
KNOWN = 400_000
UNIT = 64
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

# The byte-level pattern of the vocabulary, with white space spelled out.
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

_ODD = re.compile(r"\s(?:\s|\Z)")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable ones for themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes of lookahead after which a token's end is final, from the merges in order of rank.

    A later byte can change earlier tokens only through a chain of merges, each of a higher rank than the one before
    and each with the left part, or the result, of the one before as its right part. The longest chain, counted in
    bytes of left parts, bounds how far back a change can reach; one more token may hold the end itself.
    """
    reach: dict[bytes, int] = {}
    longest = widest = 1
    for left, right in merges:
        here = len(left) + reach.get(right, 0)
        for part in (left, left + right):
            if here > reach.get(part, 0):
                reach[part] = here
        longest, widest = max(longest, here), max(widest, len(left) + len(right))
    return longest + widest


class MergeTable:
    """Vocabulary and merges of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocabulary = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_id = [vocabulary[bytes([b])] for b in range(256)]
        self.merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocabulary.items():
            self.bytes_of[i] = token
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.lookahead = sufficient_lookahead(pairs)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, data: bytes) -> list[int]:
        """Tokens of one pretoken: the pair of lowest rank is merged first, the leftmost of equals."""
        ids = list(map(self.byte_id.__getitem__, data))
        if len(ids) > 48:
            return self._merge_long(ids)
        find, none = self.merges.get, (1 << 60, 0)
        found = [find(p, none) for p in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            ids[i:i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = find((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = find((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(hit[0], i, hit[1], ids[i], ids[i + 1]) for i in range(n - 1) if (hit := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (hit := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (hit[0], x, hit[1], ids[x], ids[y]))
        return [t for t in ids if t >= 0]


@functools.cache
def merge_table(path: str) -> MergeTable:
    """One table for each worker and file."""
    return MergeTable(path)


class Known(dict):
    """Remembers what ``make`` gives for short strings, up to ``limit`` of them."""

    def __init__(self, make: Callable[[str], bytes], limit: int = KNOWN):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= UNIT:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class Units:
    """Ids of a text from the ids of its space-separated units.

    Between a character that is no white space and a single space or line feed there is always a pretoken boundary, so
    units can be encoded one by one. Texts with runs of white space go to ``whole``. ``encode`` gives the ids of a
    string as little-endian unsigned 32-bit integers.
    """

    def __init__(self, encode: Callable[[str], bytes], whole: Callable[[str], bytes], limit: int = KNOWN):
        self.whole, self.plain, self.line_feed = whole, Known(encode, limit), encode("\n")
        self.spaced = Known(self._spaced, limit)

    def _spaced(self, unit: str) -> bytes:
        if unit and unit[-1] in ",.;:!?" and unit[:-1].isalpha():
            return self.spaced[unit[:-1]] + self.plain[unit[-1]]
        return self.plain.make(" " + unit)

    def __call__(self, text: str) -> bytes:
        if _ODD.search(text):
            return self.whole(text)
        out, spaced = [], self.spaced.__getitem__
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(self.line_feed)
            if line:
                units = line.split(" ")
                if units[0]:
                    out.append(self.plain[units[0]])
                del units[0]
                out += map(spaced, units)
        return b"".join(out)


@functools.cache
def _units(path: str) -> Units:
    table = merge_table(path)
    pretoken = Known(lambda t: array("I", table.merge(t.encode())).tobytes())

    def encode(text: str) -> bytes:
        parts = table.special_pattern.split(text) if table.special_pattern else [text]
        return b"".join(array("I", [table.special[p]]).tobytes() if i % 2 else b"".join(map(pretoken.__getitem__, PATTERN.findall(p))) for i, p in enumerate(parts))

    return Units(encode, encode)


class Encoder:
    """Streaming encoder: ``feed`` blocks of text, then ``finish``; each gives the ids that became final."""

    def __init__(self, path: str, lookahead: int | None = None):
        self.table, self.units, self.pending = merge_table(path), _units(path), ""
        self.lookahead = self.table.lookahead if lookahead is None else lookahead

    def feed(self, block: str) -> bytes:
        text = self.pending + block
        cut = max(text.rfind(" "), text.rfind("\n"))
        while cut > 0 and text[cut - 1].isspace():
            cut = max(text.rfind(" ", 0, cut), text.rfind("\n", 0, cut))
        out = b""
        if cut > 0:
            out, text = self.units(text[:cut]), text[cut:]
        while len(text) > LONG:
            done, rest = self._open(text)
            if rest == text:
                break
            out, text = out + done, rest
        self.pending = text
        return out

    def finish(self) -> bytes:
        out, self.pending = self.units(self.pending) if self.pending else b"", ""
        return out

    def _open(self, text: str) -> tuple[bytes, str]:
        """Final ids of a stretch that has no safe boundary, and what must wait.

        The last ``GUARD`` characters may yet become part of a special token or a contraction.
        """
        if self.table.special_pattern and (hit := self.table.special_pattern.search(text)):
            return self.units.whole(text[:hit.end()]), text[hit.end():]
        tokens = PATTERN.findall(text)
        at, closed = 0, 0
        for t in tokens[:-1]:
            if at + len(t) > len(text) - GUARD:
                break
            at, closed = at + len(t), closed + 1
        if closed:
            return self.units.whole(text[:at]), text[at:]
        data = text[:min(len(tokens[0]), len(text) - GUARD)].encode()
        ids, size, kept, safe, end = self.table.merge(data), 0, 0, 0, len(data) - self.lookahead
        for k, i in enumerate(ids):
            size += len(self.table.bytes_of[i])
            if size > end:
                break
            if size == len(data) or data[size] & 0xC0 != 0x80:
                kept, safe = k + 1, size
        return array("I", ids[:kept]).tobytes(), data[safe:].decode() + text[len(data.decode()):]


def encode_stream(blocks: Iterable[str], path: str) -> Iterator[bytes]:
    """Ids of a text given in blocks."""
    encoder = Encoder(path)
    for block in blocks:
        yield encoder.feed(block)
    yield encoder.finish()


def encode(text: str | None, path: str, block: int = BLOCK) -> bytes:
    text = text or ""
    return b"".join(encode_stream((text[i:i + block] for i in range(0, len(text), block)), path))


class Decoder:
    """Incremental decoder: ``feed`` ids, then ``finish``."""

    def __init__(self, path: str):
        self.of = merge_table(path).bytes_of.__getitem__
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        return self.state.decode(b"".join(map(self.of, np.frombuffer(ids, "<u4").tolist())))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def round_trip(text: str | None, path: str) -> tuple[int, str, str]:
    """Number of tokens, and the digests of the ids and of the decoded text, without holding either whole."""
    text, n, ids_hash, text_hash, decoder = text or "", 0, hashlib.sha256(), hashlib.sha256(), Decoder(path)
    for ids in encode_stream((text[i:i + BLOCK] for i in range(0, len(text), BLOCK)), path):
        n += len(ids) // 4
        ids_hash.update(ids)
        text_hash.update(decoder.feed(ids).encode())
    text_hash.update(decoder.finish().encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: tokens, digest of the ids, digest of the text decoded from them."""
    kinds = (pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [round_trip(t, path) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        _units.cache_clear()  # a worker that goes on with other work needs the memory

    return map_stream(docs.select("doc_id", "text"), run, RESULT)


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids as bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(t, path) for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids binary")


def texts_from_ids(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that the ids of ``token_ids`` stand for."""

    def one(ids: bytes | None) -> str:
        decoder = Decoder(path)
        return "".join([*(decoder.feed(ids[i:i + 4 * BLOCK]) for i in range(0, len(ids or b""), 4 * BLOCK)), decoder.finish()])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(t) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return map_batches(tokens.select("doc_id", "ids"), run, "doc_id long, text string")
