"""Seeded draws that any task, and SQL, can repeat: counts of a bootstrap replicate and random permutations.

A draw is a function of (seed, replicate, unit), made of 32-bit additions, multiplications and shifts. So a replicate
needs no table: every task draws for its own rows, in place, and the same rows get the same counts wherever they lie.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

MASK = (1 << 32) - 1
STRIDE = 0x9E3779B1
MULTIPLIERS = (0x7FEB352D, 0x846CA68B)
SHIFTS = (16, 15, 16)
ROUNDS = 8

# How often a unit occurs in a replicate is Poisson with mean 1: the count is the number of these bounds (on 32 bits) that a draw reaches.
POISSON = [t for t in (math.floor(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(14)) if t < 2**32]


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 32-bit values, one for each different input."""
    x = x ^ (x >> np.uint32(SHIFTS[0]))
    x *= np.uint32(MULTIPLIERS[0])
    x ^= x >> np.uint32(SHIFTS[1])
    x *= np.uint32(MULTIPLIERS[1])
    x ^= x >> np.uint32(SHIFTS[2])
    return x


def replicate_key(seed: int, replicate: np.ndarray) -> np.ndarray:
    return mixed((np.asarray(replicate, np.uint64) * np.uint64(STRIDE) + np.uint64(seed)).astype(np.uint32))


def counts(unit: np.ndarray, replicate: np.ndarray, seed: int) -> np.ndarray:
    """(unit, replicate): how often each unit (a 64-bit number) occurs in each replicate."""
    u, key = np.asarray(unit, np.int64).view(np.uint64), replicate_key(seed, replicate)
    low, high = (u & np.uint64(MASK)).astype(np.uint32), (u >> np.uint64(32)).astype(np.uint32)
    kinds, which = np.unique(high, return_inverse=True)  # mostly one
    upper = mixed(mixed(kinds[:, None] ^ key[None, :]))
    draw = mixed(mixed(low[:, None] + key[None, :]) ^ (upper[0] if len(kinds) == 1 else upper[which]))
    out = np.zeros(draw.shape, np.uint8)
    for t in POISSON:
        out += draw >= np.uint32(t)
    return out


def unit_number(df: DataFrame, unit: str) -> Column:
    """A unit as a 64-bit number: itself if it is a whole number, else a hash."""
    return F.col(unit).cast("long") if dict(df.dtypes)[unit] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(unit)


def half_bits(n: int) -> int:
    """Bits of half a number below the smallest power of four, 256 at least, that is not below ``n``."""
    return max(4, ((max(n, 2) - 1).bit_length() + 1) // 2)


def permuted(place: np.ndarray, n: int, replicate: np.ndarray, seed: int) -> np.ndarray:
    """(place, replicate): where each of the places 0..n-1 goes in a random permutation of them.

    A Feistel network permutes the numbers below a power of four; a number that is not below ``n`` is sent on until it
    is, which keeps the map one to one.
    """
    bits = half_bits(n)
    low = np.uint64((1 << bits) - 1)
    key = replicate_key(seed, replicate)
    keys = [mixed(key + np.uint32(r)) for r in range(ROUNDS)]

    def once(v: np.ndarray, which: np.ndarray) -> np.ndarray:
        a, b = v >> np.uint64(bits), v & low
        for k in keys:
            a, b = b, a ^ (mixed((b.astype(np.uint32) ^ k[which])).astype(np.uint64) & low)
        return (a << np.uint64(bits)) | b

    which = np.broadcast_to(np.arange(len(key)), (len(place), len(key)))
    out = once(np.broadcast_to(np.asarray(place, np.uint64)[:, None], which.shape), which)
    while (far := out >= n).any():
        out[far] = once(out[far], which[far])
    return out.astype(np.int64)
