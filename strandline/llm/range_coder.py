"""Adaptive context-mixing range coder for token ids.

Blocks of ids are coded independently of one another, so many blocks advance together as the lanes of numpy arrays. For
each id, order-2 and order-1 contexts (hashes of the ids before it) predict one id each, with a confidence; the chances
that the first or the second prediction holds are mixed from adaptive counters of three orders with weights learned on the
way: the confidence of the order-2 and of the order-1 prediction, and the order-0 frequency of the predicted id among the
block's ids so far. An id that neither predicts is coded by its order-0 frequency among all of the block's earlier ids: its
three digits one after another, each by the counts of the digits that followed the ones before it. Encoder and decoder take
the same steps; all mixing uses only +, -, * and /, so both find the same numbers on every machine.

Blocks of over BLOCK ids are coded one by one, by many lanes that share the block's model (``wide_blocks``), which takes less
than a tenth of the time.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from strandline.llm import wide_blocks

#: Ids in a block that is coded beside others, at most.
BLOCK = 8192

#: What an occurrence adds to a digit's frequency, which starts at one; and the most ids that are counted one by one: of a
#: larger vocabulary, neighbours share a count.
GAIN, CELLS = 16, 1 << 16

#: magic, ids, vocabulary, crc32 of the ids as little-endian 32-bit numbers, crc32 of the coded bytes
HEADER = struct.Struct("<4sIIII")
MAGIC, WIDE_MAGIC = b"SLT3", b"SLW1"

#: Total of the first symbol's frequencies; a coder puts out the upper half of its state once that is settled.
ONE, HALF = 1 << 16, np.uint64(1 << 32)
SLOTS1, SLOTS2 = 1 << 12, 1 << 13
U64 = np.uint64

#: Of a count of up to BLOCK ids: its size in steps of doubling, up to 7.
LEVEL = np.minimum(np.ceil(np.log2(np.arange(BLOCK + 1) + 1)), 7).astype(np.int64)

#: A prediction is an id with its confidence in the lowest bits.
SURE_BITS, SUREST = 3, 7


class _Ranges:
    """The intervals of all lanes; codes symbols given by (start, size) of a total, in words of 32 bits."""

    def __init__(self, lanes: int, data: list[bytes] | None, capacity: int = 0):
        self.low = np.zeros(lanes, U64)
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, U64)
        self.at = np.zeros(lanes, np.int64)
        if data is None:
            self.code = None
            self.words = np.zeros((lanes, capacity), "<u4")
        else:
            self.words = np.zeros((lanes, max(map(len, data), default=0) // 4 + 4), "<u4")
            for k, x in enumerate(data):
                self.words[k, : len(x) // 4] = np.frombuffer(x, "<u4")
            self.code = (self.words[:, 0].astype(U64) << U64(32)) | self.words[:, 1].astype(U64)
            self.at += 2

    def slot(self, lanes, total) -> np.ndarray:
        """Where in [0, total) the coded number of each lane lies."""
        self.step = self.range[lanes] // total
        return np.minimum((self.code[lanes] - self.low[lanes]) // self.step, total - U64(1)).astype(np.int64)

    def take(self, lanes, start, size, total) -> None:
        step = self.range[lanes] // total if self.code is None else self.step
        low = self.low[lanes] + start.astype(U64) * step
        width = size.astype(U64) * step
        todo = np.flatnonzero((low ^ (low + width) < HALF) | (width < HALF))
        while len(todo):
            lo, wide = low[todo], width[todo]
            cut = (lo ^ (lo + wide)) >= HALF  # too narrow to go on, though its upper half isn't settled: give the rest up
            wide[cut] = (~lo[cut] + U64(1)) & (HALF - U64(1))
            own = todo if isinstance(lanes, slice) else lanes[todo]
            at = self.at[own]
            if self.code is None:
                self.words[own, at] = lo >> U64(32)
            else:
                self.code[own] = (self.code[own] << U64(32)) | self.words[own, np.minimum(at, self.words.shape[1] - 1)]
            self.at[own] = at + 1
            lo <<= U64(32)
            wide <<= U64(32)
            low[todo], width[todo] = lo, wide
            todo = todo[(lo ^ (lo + wide) < HALF) | (wide < HALF)]
        self.low[lanes], self.range[lanes] = low, width

    def finish(self) -> list[bytes]:
        every = np.arange(len(self.at))
        for shift in (32, 0):
            self.words[every, self.at] = (self.low >> U64(shift)) & (HALF - U64(1))
            self.at += 1
        return [self.words[k, :n].tobytes() for k, n in enumerate(self.at.tolist())]


class _Mixer:
    """Mixes the chances of a yes that counters of several orders give, for every lane."""

    def __init__(self, lanes: int, *sizes: int):
        self.sizes = sizes
        self.chance = [np.full(lanes * n, 0.25) for n in sizes]
        self.weight = [np.full(lanes, w) for w in (0.5, 0.3, 0.3)]

    def mix(self, lanes: np.ndarray, *contexts: np.ndarray) -> np.ndarray:
        self.where, self.old, self.lean = [lanes * n + c for n, c in zip(self.sizes, contexts, strict=True)], [], []
        mixed = 0.0
        for k in range(len(contexts)):
            old = np.take(self.chance[k], self.where[k])
            lean = (old - 0.5) / np.minimum(old, 1.0 - old)
            self.old.append(old)
            self.lean.append(lean)
            mixed = mixed + self.weight[k][: len(lanes)] * lean
        size = np.abs(mixed)
        self.chance_now = 0.5 + 0.5 * mixed / (1.0 + size)
        return self.chance_now

    def learn(self, yes: np.ndarray) -> None:
        n = len(yes)
        miss = (yes - self.chance_now) * 0.02
        for k in range(len(self.where)):
            old, lean, weight = self.old[k], self.lean[k], self.weight[k][:n]
            self.chance[k][self.where[k]] = np.minimum(np.maximum(old + (yes - old) * 0.04, 0.002), 0.998)
            np.minimum(np.maximum(weight + miss * lean / (1.0 + np.abs(lean)), 0.0), 2.0, out=weight)


class _Order0:
    """How often each lane has met each id so far, as a tree of digits; it counts every id as soon as it is known."""

    def __init__(self, lanes: int, vocabulary: int):
        self.width = -(-vocabulary // CELLS)
        cells = -(-vocabulary // self.width)
        self.radix = next(r for r in range(1, CELLS) if r**3 >= cells)
        self.counts = [np.zeros((lanes * self.radix**k, self.radix), np.uint16) for k in range(3)]
        self.flat = [x.reshape(-1) for x in self.counts]
        self.ranks = np.arange(1, self.radix + 1, dtype=np.int32)

    def count(self, lanes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.flat[2][lanes * self.radix**3 + ids // self.width]

    def learn(self, lanes: np.ndarray, ids: np.ndarray) -> None:
        cell = ids // self.width
        for k in range(3):
            self.flat[k][lanes * self.radix ** (k + 1) + cell // self.radix ** (2 - k)] += 1

    def code(self, coder: _Ranges, lanes: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
        """Code ``ids``, one for each lane, or decode them."""
        every, found = np.arange(len(lanes)), np.zeros(len(lanes), np.int64)
        for k in range(3):
            rows = np.take(self.counts[k], lanes * self.radix**k + found, axis=0)
            ends = np.cumsum(rows, axis=1, dtype=np.int32)
            ends *= GAIN
            ends += self.ranks
            total = ends[:, -1].astype(U64)
            if ids is None:
                digit = (ends <= coder.slot(lanes, total)[:, None]).sum(axis=1)
            else:
                digit = ids // self.width // self.radix ** (2 - k) - found * self.radix
            size = rows[every, digit].astype(np.int64) * GAIN + 1
            coder.take(lanes, ends[every, digit] - size, size, total)
            found = found * self.radix + digit
        if self.width == 1:
            return found
        total = U64(self.width)
        rest = coder.slot(lanes, total) if ids is None else ids % self.width
        coder.take(lanes, rest, np.ones(len(lanes), np.int64), total)
        return found * self.width + rest


def _code(lengths: np.ndarray, vocabulary: int, ids: np.ndarray | None, data: list[bytes] | None):
    """Code (``ids``: a row for each step) or decode (``data``) lanes whose lengths don't increase."""
    lanes = len(lengths)
    steps = int(lengths[0])
    decoding = ids is None
    if decoding:
        ids = np.zeros((steps, lanes), np.int64)
    coder = _Ranges(lanes, data, 16 + 4 * steps)
    kind_of = np.int32 if vocabulary <= 1 << (31 - SURE_BITS) else np.int64
    table2, table1 = np.zeros(lanes * SLOTS2, kind_of), np.zeros(lanes * SLOTS1, kind_of)
    seen = _Order0(lanes, vocabulary)
    first, second = _Mixer(lanes, 16, 8, 8), _Mixer(lanes, 8, 8, 8)
    every = np.arange(lanes)
    before, before2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # lanes longer than each step
    one = U64(ONE)
    for t in range(steps):
        n = int(active[t])
        lane, b, b2 = every[:n], before[:n], before2[:n]
        s2 = lane * SLOTS2 + (((b * 40503 + b2 * 65599 + 12345) >> 3) & (SLOTS2 - 1))
        s1 = lane * SLOTS1 + ((b * 40503 >> 4) & (SLOTS1 - 1))
        cell2, cell1 = table2[s2].astype(np.int64), table1[s1].astype(np.int64)
        guess2, guess1, c2, c1 = cell2 >> SURE_BITS, cell1 >> SURE_BITS, cell2 & SUREST, cell1 & SUREST
        p2 = first.mix(lane, c2 * 2 + (guess1 == guess2), c1, LEVEL[seen.count(lane, guess2)])
        size2 = 1 + (p2 * (ONE - 3)).astype(np.int64)
        p1 = second.mix(lane, c1, c2, LEVEL[seen.count(lane, guess1)])
        size1 = 1 + (p1 * (ONE - size2 - 2)).astype(np.int64)
        if decoding:
            slot = coder.slot(slice(0, n), one)
            kind = (slot >= size2).astype(np.int64) + (slot >= size2 + size1)
        else:
            own = ids[t, :n]
            kind = np.where(own == guess2, 0, np.where(own == guess1, 1, 2))
        start = np.where(kind == 0, 0, np.where(kind == 1, size2, size2 + size1))
        coder.take(slice(0, n), start, np.where(kind == 0, size2, np.where(kind == 1, size1, ONE - size2 - size1)), one)
        rest = np.flatnonzero(kind == 2)
        if decoding:
            ids[t, :n] = np.where(kind == 0, guess2, guess1)
        if len(rest):
            ids[t, rest] = seen.code(coder, rest, None if decoding else ids[t, rest])
        own = ids[t, :n]
        first.learn((kind == 0).astype(np.float64))
        second.learn((kind == 1).astype(np.float64))
        for cells, s, guess, c in ((table2, s2, guess2, c2), (table1, s1, guess1, c1)):
            right = guess == own
            stays = right | (c > 1)
            cells[s] = (np.where(stays, guess, own) << SURE_BITS) + np.where(right, np.minimum(c + 1, SUREST), np.where(stays, c >> 1, 1))
        seen.learn(lane, own)
        before2[:n], before[:n] = b, own
    return ids if decoding else coder.finish()


def block_length(coded: bytes) -> int:
    """The number of ids of a coded block."""
    return HEADER.unpack_from(coded)[1] if len(coded) >= HEADER.size else 0


def encode(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """One coded block for each array of up to ``wide_blocks.WIDE`` ids below ``vocabulary``."""
    if any(len(x) > wide_blocks.WIDE for x in blocks):
        raise ValueError(f"a block of over {wide_blocks.WIDE} ids")
    narrow = sorted((k for k, x in enumerate(blocks) if len(x) <= BLOCK), key=lambda k: -len(blocks[k]))
    coded = {k: wide_blocks.encode(x, vocabulary) for k, x in enumerate(blocks) if len(x) > BLOCK}
    lengths = np.array([len(blocks[k]) for k in narrow], np.int64)
    if lengths.any():
        ids = np.zeros((int(lengths[0]), len(narrow)), np.int64)
        for lane, k in enumerate(narrow):
            ids[: lengths[lane], lane] = blocks[k]
        coded |= dict(zip(narrow, _code(lengths, vocabulary, ids, None), strict=True))
    out = []
    for k, x in enumerate(blocks):
        own, magic = coded.get(k, b""), WIDE_MAGIC if len(x) > BLOCK else MAGIC
        out.append(HEADER.pack(magic, len(x), vocabulary, zlib.crc32(np.asarray(x).astype("<u4").tobytes()), zlib.crc32(own)) + own)
    return out


def decode(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each block, as little-endian 32-bit numbers; a block that doesn't match its checksums raises ValueError."""
    if not coded:
        return []
    heads = [HEADER.unpack_from(x) if len(x) >= HEADER.size else (b"",) * 5 for x in coded]
    for head, x in zip(heads, coded, strict=True):
        if head[0] not in (MAGIC, WIDE_MAGIC) or zlib.crc32(memoryview(x)[HEADER.size :]) != head[4]:
            raise ValueError("a block of token ids is damaged")
    out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(coded)
    for k, (head, x) in enumerate(zip(heads, coded, strict=True)):
        if head[0] == WIDE_MAGIC:
            out[k] = wide_blocks.decode(x[HEADER.size :], head[1], head[2]).astype("<u4")
    for vocabulary in {h[2] for h in heads}:
        own = [k for k, h in enumerate(heads) if h[0] == MAGIC and h[2] == vocabulary and h[1]]
        own.sort(key=lambda k: -heads[k][1])
        if not own:
            continue
        ids = _code(np.array([heads[k][1] for k in own]), vocabulary, None, [coded[k][HEADER.size :] for k in own])
        for lane, k in enumerate(own):
            out[k] = ids[: heads[k][1], lane].astype("<u4")
    for head, ids in zip(heads, out, strict=True):
        if head[1] and zlib.crc32(ids.tobytes()) != head[3]:
            raise ValueError("a block of token ids is damaged")
    return out
