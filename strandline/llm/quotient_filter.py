"""Counting quotient filters without loss: exact counts of whole numbers in little space, in numpy.

A key of ``bits`` bits is permuted by an invertible function, so that keys spread evenly and come back whole. The first bits of
the permuted key, its quotient, aren't stored: bit vectors say which quotients occur and where their runs of slots end. The
other bits, the full remainder, fill a slot. A count above one takes further slots of the same width, as the digits of
count - 1; a third bit vector marks them. Entries lie in order of the permuted key, so filters merge like sorted lists.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Odd multipliers of the permutation's rounds: fixed values without a meaning.
ROUNDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

#: Bits of a remainder at least, so that counts need few digits.
LEAST_REMAINDER = 4

_HEAD = np.dtype("<u8")


class Permutation:
    """A one-to-one map of the numbers under 2**bits onto themselves, and its inverse; ``bits`` is 1 to 64."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.uint64((bits + 1) // 2)  # twice the shift covers all bits, so a shift undoes itself
        self.steps = [(np.uint64(m & int(self.mask) | 1), np.uint64(pow(m | 1, -1, 1 << bits))) for m in ROUNDS]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64)
        for forth, _ in self.steps:
            x ^= x >> self.shift
            x *= forth
            x &= self.mask
        return x ^ (x >> self.shift)

    def inverse(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64)
        for _, back in reversed(self.steps):
            x ^= x >> self.shift
            x *= back
            x &= self.mask
        return x ^ (x >> self.shift)


def packed(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after another."""
    bits = np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].ravel(), bitorder="little").tobytes()


def unpacked(data: np.ndarray, n: int, width: int) -> np.ndarray:
    bits = np.zeros((n, 64), np.uint8)
    bits[:, :width] = np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def _vector(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def to_bytes(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """The filter of permuted keys under 2**bits, in order and distinct, with counts of at least 1."""
    m = len(keys)
    quotient_bits = max(0, min(max(m - 1, 0).bit_length(), bits - LEAST_REMAINDER))
    width = max(1, bits - quotient_bits)
    keys, rest = keys.astype(np.uint64), counts.astype(np.uint64) - np.uint64(1)
    quotient = (keys >> np.uint64(width)).astype(np.int64) if width < 64 else np.zeros(m, np.int64)
    digits, left = np.zeros(m, np.int64), rest.copy()
    while left.any():
        digits += left > 0
        left = left >> np.uint64(width) if width < 64 else np.zeros_like(left)
    place = np.concatenate([[0], np.cumsum(digits + 1)])
    slots = np.zeros(int(place[-1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    slots[place[:-1]] = keys & mask
    for k in range(int(digits.max(initial=0))):
        has = digits > k
        slots[place[:-1][has] + 1 + k] = (rest[has] >> np.uint64(width * k)) & mask
    extends, ends, occurs = np.ones(len(slots), bool), np.zeros(len(slots), bool), np.zeros(1 << quotient_bits, bool)
    extends[place[:-1]] = False
    occurs[quotient] = True
    ends[place[1:][np.r_[quotient[1:] != quotient[:-1], True]] - 1 if m else []] = True
    head = np.array([bits, quotient_bits, len(slots)], _HEAD).tobytes()
    return head + _vector(occurs) + _vector(ends) + _vector(extends) + packed(slots, width)


def items(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The permuted keys of a filter, in order, and their counts."""
    bits, quotient_bits, n = (int(x) for x in np.frombuffer(data, _HEAD, 3))
    width, raw = max(1, bits - quotient_bits), np.frombuffer(data, np.uint8)[24:]
    sizes = np.cumsum([0, (1 << quotient_bits) + 7 >> 3, n + 7 >> 3, n + 7 >> 3])
    occurs, ends, extends = (np.unpackbits(raw[a:b], count=c, bitorder="little").astype(bool) for a, b, c in zip(sizes, sizes[1:], (1 << quotient_bits, n, n), strict=False))
    slots = unpacked(raw[sizes[-1] :], n, width)
    run = np.cumsum(ends) - ends
    keys = slots[~extends]
    if width < 64:
        keys |= np.flatnonzero(occurs).astype(np.uint64)[run[~extends]] << np.uint64(width)
    counts = np.ones(len(keys), np.uint64)
    entry, place = np.cumsum(~extends) - 1, np.flatnonzero(~extends)
    more = np.flatnonzero(extends)
    np.add.at(counts, entry[more], slots[more] << ((more - place[entry[more]] - 1) * width).astype(np.uint64))
    return keys, counts


def merged(filters: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the counts of several filters' items, by key in order."""
    keys, counts = np.concatenate([k for k, _ in filters]), np.concatenate([c for _, c in filters])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts
