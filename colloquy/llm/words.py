"""Words of a text as bytes: lower-case A-Z, cut at every ASCII character that is no letter or digit."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np

PIECE = 1 << 21

FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes, cut at spaces, so that a long text never becomes one list of words."""
    at = 0
    while len(data) - at > size:
        cut = data.find(b" ", at + size)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:] if at else data


def word_ids(text: bytes | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Id of each word of the whole text; 0 where the vocabulary lacks it."""
    if not text:
        return np.zeros(0, np.int32)
    get, parts = vocabulary.get, []
    for piece in pieces(text.translate(FOLD)):
        found = piece.split()
        parts.append(np.fromiter(map(get, found, repeat(0)), np.int32, len(found)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def split_words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []
