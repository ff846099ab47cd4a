"""Hashed character n-grams of many strings at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points hashed at once; bounds a worker's memory, also within a very long text.
CHUNK = 1 << 18

_LETTERS = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def is_letter(points: np.ndarray) -> np.ndarray:
    """Which code points are letters by their Unicode category."""
    return _LETTERS[points]


def code_points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings, one after another, and how many each string has."""
    lengths = pc.utf8_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = "".join(strings.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), lengths


def hashed(points: np.ndarray, lengths: np.ndarray, sizes: range, bits: int, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, bucket) of every n-gram that lies within one string, in chunks; owners never decrease within a chunk."""
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    u = np.uint64
    for a in range(0, len(points), chunk):
        b = min(len(points), a + chunk)
        h = np.zeros(b - a, u)
        for n in range(1, sizes.stop):
            end = min(b, len(points) - n + 1)
            if end <= a:
                break
            h = h[: end - a] * u(0x100000001B3) + points[a + n - 1 : end + n - 1].astype(u) + u(n)
            if n in sizes:
                own = owner[a:end]
                inside = own == owner[a + n - 1 : end + n - 1]
                mixed = (h ^ (h >> u(29))) * u(0x9E3779B97F4A7C15)
                bucket = (mixed >> u(64 - bits)).astype(np.int32)
                yield (own, bucket) if inside.all() else (own[inside], bucket[inside])


def summed(owner: np.ndarray, values: np.ndarray, into: np.ndarray) -> None:
    """Add each row of values to its owner's row; owners never decrease."""
    if len(owner):
        first = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1))
        into[owner[first]] += np.add.reduceat(values, first, axis=0)
