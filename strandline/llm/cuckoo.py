"""Cuckoo filters over 16-byte keys: membership without false negatives, with insertion and removal, in numpy."""

from __future__ import annotations

import numpy as np

SLOTS = 4


class CuckooFilter:
    """Buckets of SLOTS 16-bit fingerprints; a key lies in one of two buckets that its fingerprint links.

    Keys are given as an array of 16-byte values that are already uniform hashes. Inserting a key twice stores it twice.
    """

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.8)))))
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        halves = np.ascontiguousarray(keys).view(np.uint64).reshape(-1, 2)
        prints = (halves[:, 0] >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (halves[:, 1] & np.uint64(len(self.table) - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ ((prints.astype(np.int64) * 0x5BD1E995 >> 5) & (len(self.table) - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        prints, a, b = self._places(keys)
        return ((self.table[a] == prints[:, None]) | (self.table[b] == prints[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> None:
        """Add every key; ValueError if the filter is too full (then build a larger one from the exact table)."""
        if not len(keys):
            return
        prints, a, b = self._places(keys)
        waiting = np.arange(len(prints))
        for bucket in (a, b):  # whoever comes first at a bucket takes its next free slot; the rest ask again
            asking = waiting
            waiting_on = []
            while len(asking):
                free = (self.table[bucket[asking]] == 0).argmax(axis=1)
                has = self.table[bucket[asking], free] == 0
                waiting_on.append(asking[~has])
                asking, free = asking[has], free[has]
                _, one = np.unique(bucket[asking], return_index=True)
                self.table[bucket[asking[one]], free[one]] = prints[asking[one]]
                asking = np.delete(asking, one)
            waiting = np.concatenate(waiting_on) if waiting_on else asking
        rng = np.random.default_rng(len(keys))
        for k in waiting.tolist():
            value, bucket = prints[k], int(a[k])
            for _ in range(2000):
                slot = int(rng.integers(SLOTS))
                value, self.table[bucket, slot] = self.table[bucket, slot], value
                bucket = int(self._other(np.array([bucket]), np.array([value]))[0])
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = value
                    break
            else:
                raise ValueError("the cuckoo filter is full")

    def remove(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted, once each."""
        if not len(keys):
            return
        prints, a, b = self._places(keys)
        waiting = np.arange(len(prints))
        for bucket in (a, b):
            asking, missed = waiting, []
            while len(asking):
                slot = (self.table[bucket[asking]] == prints[asking][:, None]).argmax(axis=1)
                has = self.table[bucket[asking], slot] == prints[asking]
                missed.append(asking[~has])
                asking, slot = asking[has], slot[has]
                _, one = np.unique(bucket[asking], return_index=True)
                self.table[bucket[asking[one]], slot[one]] = 0
                asking = np.delete(asking, one)
            waiting = np.concatenate(missed) if missed else asking
