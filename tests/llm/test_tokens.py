"""Byte-pair transducer against the tokenizers library, and token files in planes."""

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from colloquy.llm import bpe, token_files as tf
from tests.llm.helpers import rows_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = [" ", "  ", "\n", "\n\n", "\t", "\r\n", " \n", "a", "the", "ing", "'s", "'", "'re", "<|endoftext|>", "<|endof", "é", "日本", " ", " ", "​", "\x1c", "\x00", "1", "²", "ⅷ", "!!", "$", "é", "😀", "un", "able", "x" * 70]


def library(text):
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), st.integers(1, 30))
def test_encoder_equals_library_for_any_blocks(text, block):
    assert bpe.encode(text, PATH) == bpe.encode(text, PATH, block) == tf.library_units(PATH)(text) == library(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    assert bpe.encode(text, PATH) == tf.library_units(PATH)(text) == library(text)


@pytest.mark.parametrize("letters", [["a", "the", "ing", "er", "on"], ["a"], ["!", "'", "$", "=", "-"], ["é", "日", "本", "語"], ["0", "1", "12"], [" "], ["'"], ["\t", "\n", " "], list("etaoinshrdlu")])
def test_endless_words_need_bounded_memory(letters, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 300)
    rng = random.Random(len(letters))
    lookahead = bpe.merge_table(PATH).lookahead
    for end in ("", " x", "'s", "s"):
        text = "".join(rng.choice(letters) for _ in range(6000)) + end
        encoder, out, held = bpe.Encoder(PATH), [], 0
        for i in range(0, len(text), 250):
            out.append(encoder.feed(text[i:i + 250]))
            held = max(held, len(encoder.pending))
        out.append(encoder.finish())
        assert b"".join(out) == library(text)
        assert held <= 300 + 250 + 2 * lookahead


def test_lookahead_is_enough_for_every_prefix():
    """Tokens that end more than the lookahead before the end of a prefix are those of the whole text."""
    table = bpe.merge_table(PATH)
    rng = random.Random(7)
    for _ in range(30):
        data = "".join(rng.choice(["er", "re", "in", "th", "e", "a", "n", "ation", "ing", "s", "aa"]) for _ in range(400)).encode()
        ends = lambda ids: np.cumsum([len(table.bytes_of[i]) for i in ids])
        whole = set(ends(table.merge(data)).tolist())
        for cut in range(len(data) - 120, len(data), 7):
            part = ends(table.merge(data[:cut]))
            assert set(part[part <= cut - table.lookahead].tolist()) <= whole


def test_small_merge_list_lookahead():
    assert bpe.sufficient_lookahead([]) == 2
    # ab, bc, cd: a later d may free c, which frees b, which frees a
    assert bpe.sufficient_lookahead([(b"c", b"d"), (b"b", b"c"), (b"a", b"b")]) == 3 + 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=60), st.integers(1, 7))
def test_decoder_is_incremental(ids, step):
    data, d = np.array(ids, "<u4").tobytes(), bpe.Decoder(PATH)
    text = "".join(d.feed(data[i:i + 4 * step]) for i in range(0, len(data), 4 * step)) + d.finish()
    assert text == LIBRARY.decode(ids, skip_special_tokens=False)


TEXTS = ["The cat's hat.\nA  b", None, "", "x" * 30000, "é" * 999, "a <|endoftext|> b", "same", "same", " lead", "trail \n"]


def test_digests_and_round_trip(make):
    docs = make(TEXTS)
    want = []
    for i, t in enumerate(TEXTS):
        ids = library(t or "")
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows_of(bpe.token_digests(docs, PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    back = rows_of(bpe.texts_from_ids(bpe.token_ids(docs, PATH), PATH), "doc_id", "text")
    assert back == [(i, t or "") for i, t in enumerate(TEXTS)]
    assert bpe.token_digests(make([]), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=50), max_size=12), st.sampled_from(["byte", "bit"]), st.integers(1, 40))
def test_plane_files_round_trip(docs, planes, block):
    out = io.BytesIO()
    w = tf.PlaneWriter(out, planes, block)
    for i, ids in enumerate(docs):
        w.add(None if i % 5 == 4 else i, np.array(ids, "<u4").tobytes())
    assert w.finish() == sum(map(len, docs))
    r = tf.PlaneReader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    got = [(d, n, [int(x) for p in pieces for x in p]) for d, n, pieces in r.documents()]
    assert got == [(None if i % 5 == 4 else i, len(ids), ids) for i, ids in enumerate(docs)]


def test_damaged_block_is_found():
    out = io.BytesIO()
    w = tf.PlaneWriter(out)
    w.add(1, np.arange(1000, dtype="<u4").tobytes())
    w.finish()
    data = bytearray(out.getvalue())
    r = tf.PlaneReader(io.BytesIO(bytes(data)), len(data))
    r.blocks = r.blocks.copy()
    r.blocks[0, 2] ^= 1
    with pytest.raises(ValueError):
        r.block(0)


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files(spark, make, planes):
    rows = [*((i * 7 % 10, t) for i, t in enumerate(TEXTS)), (None, "no id"), (3, "again")]
    files = tf.write_token_files(make(rows), PATH, planes=planes)
    got = rows_of(tf.read_token_files(files), "start", "doc_id", "n_tokens", "ids_crc32")
    assert len(got) == len(rows)
    assert [r[1] for r in got] == [None, *sorted(d for d, _ in rows if d is not None)]
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    want = sorted((library(t or "") + b"\x02\0\0\0" for _, t in rows), key=zlib.crc32)
    assert sorted(r[3] for r in got) == [zlib.crc32(w) for w in want]
    ids = {r["doc_id"]: r["ids"] for r in tf.read_ids(spark, files).collect()}
    assert np.array(ids[0], "<u4").tobytes() == library(TEXTS[0]) + b"\x02\0\0\0"
    assert tf.read_token_files(tf.write_token_files(make([]), PATH)).count() == 0
