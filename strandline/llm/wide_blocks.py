"""The range coder's large blocks: one adaptive model for a block, learned by thousands of lanes at once.

A block's ids are dealt over lanes of LANE ids or more, which advance side by side as numpy arrays. At each step every lane codes one
id with the model that the earlier steps of all lanes left, and then all of them teach it, so that a step costs a few array
operations however many lanes there are. As in small blocks, order-2 and order-1 contexts predict one id each, two mixers
weigh counters of three orders into the chances that the first or the second prediction holds, and other ids are coded by
their order-0 frequency among all ids of the earlier steps. A mixer's contexts are few, so it mixes for each of them rather
than for each lane. Encoder and decoder take the same steps, and sums over lanes are sums of whole numbers, so both find the
same numbers on every machine.

Coded form: for each lane the number of its words (16 bits), then the lanes' words of 32 bits, one lane after another.
"""

from __future__ import annotations

import numpy as np

#: Ids in a block, at most; ids of a lane, at least; lanes, at most (their arrays should fit a core's cache).
WIDE, LANE, LANES = 1 << 23, 512, 8192

#: What an occurrence adds to an id's frequency, which starts at one; the most ids that are counted one by one: of a larger
#: vocabulary, neighbours share a count. WIDE * GAIN + CELLS must stay below 1 << 26, the least interval that LEAST leaves.
GAIN, CELLS = 4, 1 << 16

#: Parts of a step's interval, in bits; what is left at least to ids that nothing predicts.
PARTS, LEAST = 16, 1 << 10

#: Cells of order 2 and order 1, an id with its confidence in the lowest bits each.
SLOTS2, SLOTS1 = 1 << 18, 1 << 16
SURE_BITS, SUREST = 3, 7

#: The mixers learn at each of the FIRST steps and later at every fourth; the sizes of counts are renewed at every sixteenth.
FIRST, EVERY, LEVELS_EVERY = 16, 4, 16

U64 = np.uint64
WORD, HALF = U64(32), U64(1 << 32)

#: Of an id's count: its size in steps of four times, up to 7.
LEVEL = np.minimum(np.ceil(np.log2(np.arange(1 << 14) + 1) / 2), 7).astype(np.int64)

#: What a cell's confidence changes by: halved after a miss (first eight), else one more.
CHANGE = np.array([(c >> 1) - c for c in range(SUREST + 1)] + [int(c < SUREST) for c in range(SUREST + 1)], np.int64)

#: Fractions are summed as whole numbers of this part.
FINE = float(1 << 20)


class _JointMixer:
    """Mixes the chances of a yes that counters of several orders give, for every combination of their contexts."""

    def __init__(self, *sizes: int):
        self.sizes = sizes
        self.chance = [np.full(n, 0.25) for n in sizes]
        self.weight = [0.5, 0.3, 0.3]
        self.shapes = [tuple(n if i == k else 1 for i in range(len(sizes))) for k, n in enumerate(sizes)]
        self.others = [tuple(i for i in range(len(sizes)) if i != k) for k in range(len(sizes))]

    def mix(self) -> np.ndarray:
        self.lean = [(p - 0.5) / np.minimum(p, 1.0 - p) for p in self.chance]
        mixed = 0.0
        for weight, lean, shape in zip(self.weight, self.lean, self.shapes, strict=True):
            mixed = mixed + (weight * lean).reshape(shape)
        self.mixed = 0.5 + 0.5 * mixed / (1.0 + np.abs(mixed))
        return self.mixed.reshape(-1)

    def learn(self, met: np.ndarray, yes: np.ndarray) -> None:
        """``met`` and ``yes`` count the lanes of each combination, and those where the answer was yes."""
        met, yes = met.reshape(self.sizes), yes.reshape(self.sizes)
        miss = ((yes - met * self.mixed) * FINE).astype(np.int64)
        rate = 0.02 / (1.0 + int(met.sum()) / 32.0) / FINE
        for k, lean in enumerate(self.lean):
            pull = int((miss.sum(self.others[k]) * (lean / (1.0 + np.abs(lean)))).astype(np.int64).sum())
            self.weight[k] = min(max(self.weight[k] + rate * pull, 0.0), 2.0)
            n, old = met.sum(self.others[k]), self.chance[k]
            self.chance[k] = np.minimum(np.maximum(old + (yes.sum(self.others[k]) - n * old) / (n + 24.0), 0.002), 0.998)


class _Lanes:
    """The intervals of all lanes; a step narrows them and puts out, or takes in, at most one word of each."""

    def __init__(self, lanes: int, data: bytes | None):
        self.low, self.range = np.zeros(lanes, U64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U64)
        self.code = None
        self.out: list[tuple[np.ndarray, np.ndarray]] = []
        if data is not None:
            counts = np.frombuffer(data, "<u2", lanes).astype(np.int64)
            given = np.frombuffer(data, "<u4", int(counts.sum()), 2 * lanes)
            every = np.arange(lanes)
            self.words = np.zeros(len(given) + lanes + 1, U64)  # a zero follows each lane's words
            self.words[np.arange(len(given)) + np.repeat(every, counts)] = given
            self.at = np.cumsum(counts + 1) - counts - 1
            self.code = (self.words[self.at] << WORD) | self.words[self.at + 1]
            self.at += 2

    def settle(self, low: np.ndarray, wide: np.ndarray) -> None:
        """Take the intervals that a step left for the first lanes."""
        todo = np.flatnonzero(wide < HALF)
        lo = low[todo]
        # where the upper half isn't settled, what lies beyond its end is given up
        wide[todo] = np.minimum(wide[todo], HALF - (lo & (HALF - U64(1)))) << WORD
        low[todo] = lo << WORD
        if self.code is None:
            self.out.append((todo, lo >> WORD))
        else:
            at = self.at[todo]
            self.code[todo] = (self.code[todo] << WORD) | self.words[np.minimum(at, len(self.words) - 1)]
            self.at[todo] = at + 1
        self.low[: len(low)], self.range[: len(low)] = low, wide

    def finish(self) -> bytes:
        self.out.append((np.arange(len(self.low)), (self.low + (HALF - U64(1))) >> WORD))
        lanes, words = (np.concatenate(x) for x in zip(*self.out, strict=True))
        counts = np.bincount(lanes, minlength=len(self.low))
        return counts.astype("<u2").tobytes() + words[np.argsort(lanes.astype(np.uint16), kind="stable")].astype("<u4").tobytes()


def _code(n: int, vocabulary: int, ids: np.ndarray | None, data: bytes | None):
    """Code (``ids``) or decode (``data``) a block of ``n`` ids."""
    decoding = ids is None
    steps = -(-n // min(-(-n // LANE), LANES))
    lanes = -(-n // steps)
    last = n - (lanes - 1) * steps
    kind_of = np.int32 if vocabulary <= 1 << (31 - SURE_BITS) else np.int64
    table = np.zeros(lanes * steps, kind_of)
    if not decoding:
        table[:n] = ids
    table = np.ascontiguousarray(table.reshape(lanes, steps).T)
    coder = _Lanes(lanes, data)
    shared = -(-vocabulary // CELLS)
    frequency = np.ones(-(-vocabulary // shared), np.int64)
    ends = np.cumsum(frequency)
    cells2, cells1 = np.zeros(SLOTS2, kind_of), np.zeros(SLOTS1, kind_of)
    first, second = _JointMixer(16, 8, 8), _JointMixer(8, 8, 16)
    before = before2 = np.zeros(lanes, np.int64)
    room, shift = (1 << PARTS) - LEAST - 2, U64(PARTS)
    for t in range(steps):
        active = lanes if t < last else lanes - 1
        before, before2 = before[:active], before2[:active]
        learning = t <= FIRST or t % EVERY == 0
        if t % LEVELS_EVERY == 0:
            level = LEVEL[np.minimum(frequency // GAIN, len(LEVEL) - 1)]
        if t <= FIRST + 1 or t % EVERY == 1:
            sizes_first = 1 + (first.mix() * room).astype(np.int64)
            chances_second = (second.mix() * 65536.0).astype(np.int64)
        at2, at1 = (before * 40503 + before2 * 2654435761 >> 9) & (SLOTS2 - 1), before & (SLOTS1 - 1)
        cell2, cell1 = cells2[at2].astype(np.int64), cells1[at1].astype(np.int64)
        guess2, guess1, sure2, sure1 = cell2 >> SURE_BITS, cell1 >> SURE_BITS, cell2 & SUREST, cell1 & SUREST
        same = guess2 == guess1
        level2, level1 = (level[x if shared == 1 else x // shared] for x in (guess2, guess1))
        context2 = (((sure2 << 1) + same << 3) + sure1 << 3) + level2
        context1 = (((sure1 << 3) + sure2 << 3) + level1 << 1) + same
        size2 = sizes_first[context2]
        end1 = size2 + 1 + (chances_second[context1] * (room + 1 - size2) >> 16)
        size2, end1 = size2.view(U64), end1.view(U64)
        low, wide = coder.low[:active], coder.range[:active]
        step = wide >> shift
        if decoding:
            slot = (coder.code[:active] - low) // step
            right2, rest = slot < size2, np.flatnonzero(slot >= end1)
        else:
            own = table[t, :active].astype(np.int64)
            right2, right1 = own == guess2, own == guess1
            rest = np.flatnonzero(~(right2 | right1))
        begin = np.where(right2, U64(0), size2)
        new_low, new_wide = low + begin * step, (np.where(right2, size2, end1) - begin) * step
        if len(rest):
            step, end = step[rest], end1[rest]
            lo = low[rest] + end * step
            total = U64(ends[-1])
            step = (U64(1 << PARTS) - end) * step // total
            if decoding:
                # in ascending order, in which the search is much faster; the lanes follow
                slot = np.sort((np.minimum((coder.code[rest] - lo) // step, total - U64(1)) << U64(16)) + np.arange(len(rest), dtype=U64))
                order = (slot & U64(0xFFFF)).view(np.int64)
                cell = np.searchsorted(ends, (slot >> U64(16)).view(np.int64), side="right")
                rest, lo, step = rest[order], lo[order], step[order]
            else:
                other = own[rest]
                cell = other if shared == 1 else other // shared
            size = frequency[cell]
            new_low[rest] = lo + (ends[cell] - size).view(U64) * step
            new_wide[rest] = size.view(U64) * step
        coder.settle(new_low, new_wide)
        if decoding:
            own = np.where(right2, guess2, guess1)
            if len(rest):
                own[rest] = cell
        if shared > 1 and len(rest):
            # which of the ids that share a count, all of them as likely
            low, wide = coder.low[:active].copy(), coder.range[:active].copy()
            step = wide[rest] // U64(shared)
            if decoding:
                within = np.minimum((coder.code[rest] - low[rest]) // step, U64(shared - 1)).view(np.int64)
                own[rest] = np.minimum(cell * shared + within, vocabulary - 1)
            else:
                within = other % shared
            low[rest] += within.view(U64) * step
            wide[rest] = step
            coder.settle(low, wide)
        if decoding:
            right1 = own == guess1
            table[t, :active] = own
        if learning:
            found = np.bincount(context2 * 2 + right2, minlength=2048).reshape(-1, 2)
            first.learn(found[:, 0] + found[:, 1], found[:, 1])
            found = np.bincount(context1 * 4 + right1 + 2 * right2, minlength=4096).reshape(-1, 4)
            second.learn(found[:, 0] + found[:, 1], found[:, 1])
        new = (own << SURE_BITS) + 1
        cells2[at2] = np.where(right2 | (sure2 > 1), cell2 + CHANGE[(right2 * 8) + sure2], new)
        cells1[at1] = np.where(right1 | (sure1 > 1), cell1 + CHANGE[(right1 * 8) + sure1], new)
        np.add.at(frequency, own if shared == 1 else own // shared, GAIN)
        np.cumsum(frequency, out=ends)
        before2, before = before, own
    return np.ascontiguousarray(table.T).reshape(-1)[:n] if decoding else coder.finish()


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """The coded bytes of a block of 1 to WIDE ids below ``vocabulary``."""
    return _code(len(ids), vocabulary, ids, None)


def decode(coded: bytes, n: int, vocabulary: int) -> np.ndarray:
    """The ``n`` ids of a coded block."""
    return _code(n, vocabulary, None, coded)
