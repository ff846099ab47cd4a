"""SimHash near-dedup by a binary trie self-join.

Fingerprints are made distinct first, so copies never multiply the work. The self-join walks a binary trie over the
fingerprints with pairs of nodes: it starts at (root, root), goes down both nodes together, counts a differing bit for
each pair of children on different sides, and drops a pair once it has more than BUDGET differing bits.

To run on many machines the trie is cut into subtrees. Two fingerprints within three bits agree on at least one of four
blocks of 16 bits, so four rotated copies of the trie, each with another block on top, are cut below that block: every pair
in reach meets in at least one subtree, with no differing bit so far, and a subtree is walked by one task. A subtree with
over HEAVY fingerprints is cut again in the same way: the bits below its path are rotated by quarters. Links leave a task
as links to the smallest fingerprint that its subtrees join them to, so a group of n near copies gives n links, not n
squared; no two fingerprints in reach end in different components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.components import components
from strandline.llm.shared import local_roots, lookup, release_memory, sized, small_batches, stored

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Differing bits of linked fingerprints, at most. The cutting into subtrees relies on 3.
BUDGET = 3

#: (path length, step of the rotation below the path, bits below the path that the four rotations put on the path)
CUTS = ((0, 16, 16), (16, 12, 12), (28, 9, 9), (37, 7, 6))

#: Fingerprints of a subtree that one task walks, at most; larger ones are cut again.
HEAVY = 1 << 17

#: Hashes of subtrees that are counted first.
BUCKETS = 1 << 12

#: Node pairs that a task holds at once, about.
PAIRS = 1 << 18


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles (A-Z lowered, repeats counted); without words: 0.

    A bit is 1 if it is set in over half of the shingles' XXH64 values.
    """
    raw = shingle_hashes(text, words, seed)
    counts = np.zeros(64, np.int64)
    for first in range(0, len(raw), 1 << 16):
        counts += np.unpackbits(raw[first : first + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(raw)).tobytes(), "big")


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle of the text (A-Z lowered; fewer words: the whole sequence; none: nothing), as raw bytes."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return np.zeros((0, 8), np.uint8)
    shingles = map(b" ".join, zip(*(parts[k:] for k in range(words)), strict=False)) if len(parts) >= words else [b" ".join(parts)]
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(seed))), np.uint8).reshape(-1, 8)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long. A null text counts as empty."""
    small_batches(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, words) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(make, "doc_id long, fp long")


def _cut(rows: DataFrame, path: int, step: int, bits: int) -> DataFrame:
    """Four rows for each: the bits below the path rotated by quarters, and the subtree they then belong to."""
    below = 64 - path
    mask = (1 << below) - 1
    low = F.col("turned").bitwiseAND(F.lit(mask if below < 64 else -1))
    high = F.col("turned").bitwiseXOR(low)
    turned = []
    for quarter in range(4):
        by = quarter * step
        left = F.shiftleft(low, by) if by else low
        right = F.shiftrightunsigned(low, below - by) if by else F.lit(0).cast("long")
        turned.append(F.struct(F.lit(quarter).alias("q"), high.bitwiseOR(left.bitwiseOR(right).bitwiseAND(F.lit(mask if below < 64 else -1))).alias("turned")))
    cut = rows.select("fp", "subtree", F.explode(F.array(*turned)).alias("x"))
    return cut.select("fp", F.xxhash64("subtree", "x.q", F.shiftrightunsigned("x.turned", 64 - path - bits)).alias("subtree"), F.col("x.turned").alias("turned"))


def subtrees(distinct: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(fp, subtree, turned): each fingerprint in every subtree where it may meet another within BUDGET bits.

    ``distinct`` has fp, the fingerprint's name in links, bits, the fingerprint, and tree, the trie it belongs to.
    """
    rows = distinct.select("fp", F.col("tree").cast("long").alias("subtree"), F.col("bits").alias("turned"))
    done = []
    for k, (path, step, bits) in enumerate(CUTS):
        rows = _cut(rows, path, step, bits)
        if k + 1 == len(CUTS):
            break
        # counts over hashes of subtrees tell at little cost which subtrees to count at all
        bucket = F.pmod(F.col("subtree"), F.lit(BUCKETS))
        full = stored(rows.groupBy(bucket.alias("bucket")).count().where(F.col("count") > heavy).select("bucket"), "full-buckets")  # at most BUCKETS rows
        if full.isEmpty():
            break
        counted = rows.join(F.broadcast(full), bucket == F.col("bucket"), "left_semi").groupBy("subtree").count()
        large = stored(counted.where(F.col("count") > heavy).select("subtree"), "heavy-subtrees")
        if large.isEmpty():
            break
        done.append(rows.join(large, "subtree", "left_anti").select("fp", "subtree", "turned"))
        rows = stored(rows.join(large, "subtree", "left_semi").select("fp", "subtree", "turned"), "subtrees")
    for other in done:
        rows = rows.unionByName(other)
    return rows


def trie_pairs(tree: np.ndarray, values: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``values`` (uint64) of the same tree that differ in 1 to ``budget`` bits.

    ``tree`` and ``values`` are sorted by (tree, value). A trie node is a range of positions; a pair of nodes goes down one
    bit at a time, and a pair of single leaves is compared at once.
    """
    n = len(values)
    if n < 2:
        return
    roots = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    ends = np.r_[roots[1:], n]
    stack = [(0, roots, ends, roots, ends, np.zeros(len(roots), np.int8))]
    while stack:
        bit, a, a_end, b, b_end, differ = stack.pop()
        if len(a) > PAIRS:
            half = len(a) // 2
            stack.append((bit, a[half:], a_end[half:], b[half:], b_end[half:], differ[half:]))
            stack.append((bit, a[:half], a_end[:half], b[:half], b_end[:half], differ[:half]))
            continue
        leaves = (a_end - a == 1) & (b_end - b == 1)
        if leaves.any():
            p, q = a[leaves], b[leaves]
            apart = np.bitwise_count(values[p] ^ values[q])
            near = (apart > 0) & (apart <= budget)
            if near.any():
                yield p[near], q[near]
            a, a_end, b, b_end, differ = (x[~leaves] for x in (a, a_end, b, b_end, differ))
        if not len(a) or bit == 64:
            continue
        ones = _ones(values, bit)
        a_mid = a_end - (ones[a_end] - ones[a])
        b_mid = b_end - (ones[b_end] - ones[b])
        same = (a == b) & (a_end == b_end)
        parts = [
            (a, a_mid, b, b_mid, differ, slice(None)),
            (a_mid, a_end, b_mid, b_end, differ, slice(None)),
            (a, a_mid, b_mid, b_end, differ + 1, slice(None)),
            (a_mid, a_end, b, b_mid, differ + 1, ~same),
        ]
        kept = []
        for x, x_end, y, y_end, d, wanted in parts:
            live = (x < x_end) & (y < y_end) & (d <= budget)
            if not isinstance(wanted, slice):
                live &= wanted
            live &= ~((x == y) & (x_end == y_end) & (x_end - x == 1))
            kept.append(tuple(v[live] for v in (x, x_end, y, y_end, d)))
        stack.append((bit + 1, *(np.concatenate([k[i] for k in kept]) for i in range(5))))


class _Ones:
    values: np.ndarray | None = None
    sums: dict[int, np.ndarray] = {}


def _ones(values: np.ndarray, bit: int) -> np.ndarray:
    """How many of the first k values have the bit (from the top) set, for every k."""
    if _Ones.values is not values:
        _Ones.values, _Ones.sums = values, {}
    if bit not in _Ones.sums:
        if len(_Ones.sums) > 8:
            _Ones.sums.pop(next(iter(_Ones.sums)))
        _Ones.sums[bit] = np.r_[0, np.cumsum((values >> np.uint64(63 - bit)) & np.uint64(1), dtype=np.int64)]
    return _Ones.sums[bit]


def links(distinct: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(u, v): links between fingerprints of a tree; their components are those of all pairs within BUDGET bits."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def joined(table: pa.Table) -> pa.RecordBatch:
            tree, turned, fp = (table.column(c).to_numpy() for c in ("subtree", "turned", "fp"))
            values = turned.view(np.uint64)
            order = np.lexsort((values, tree))
            tree, values, fp = tree[order], np.ascontiguousarray(values[order]), fp[order]
            parent = np.arange(len(fp), dtype=np.int64)
            for p, q in trie_pairs(tree, values):
                parent = local_roots(len(fp), p, q, parent)
            moved = np.flatnonzero(parent != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[parent[moved]])], ["u", "v"])

        last = None
        for batch in batches:  # rows come sorted by subtree: walk whole subtrees, many at once
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= heavy:
                table = pa.Table.from_batches(held).combine_chunks()
                tree = table.column("subtree").to_numpy()
                last = int(np.searchsorted(tree, tree[-1]))
                if last:
                    yield joined(table.slice(0, last))
                held, size = table.slice(last).to_batches(), table.num_rows - last
        if held:
            yield joined(pa.Table.from_batches(held))
        held = []
        release_memory()

    placed = subtrees(distinct, heavy).repartition("subtree").sortWithinPartitions("subtree")
    return placed.mapInArrow(walk, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, heavy: int = HEAVY) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id it reaches.

    Rows are linked when their fingerprints differ in at most three bits; texts without words (null and empty ones too)
    have fingerprint zero and are linked like any other. Rows with a null doc_id take part and never name a component
    unless all its ids are null. Repeated rows give repeated rows. A very long text is read whole, by one task. An empty table
    gives no rows.
    """
    rows = stored(fingerprints(docs, words), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    stars = components(stored(links(nodes.select("fp", F.col("fp").alias("bits"), F.lit(0).alias("tree")), heavy), "simhash-links"))
    placed = stored(nodes.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "rooted-fingerprints")
    sizes = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = lookup(placed, stored(sizes, "simhash-components"), "root", "members", placed.count()).select("fp", "n", "component_id")
    found = lookup(rows, stored(named, "named-fingerprints"), "fp", "n", rows.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Samples of each text that get a fingerprint, and shingles of a sample.
SAMPLES, SAMPLE = 16, 5

#: Members of a chunk: a larger group is compared in pairs of chunks. Members, about, that stand for a group in each chunk
#: while chunks are first compared alone, and the samples whose groups are.
CHUNK, LEADERS, FIRST = 256, 8, 4

_MIXERS = np.random.default_rng(11).integers(1, 2**63, (SAMPLES, 2), dtype=np.uint64) | np.uint64(1)


def sampled(text: str | None, words: int) -> tuple[bytes, list[int], bytes]:
    """Of the text's set of shingles: a hash of the whole set, the SimHash of SAMPLES min-wise samples, and the set itself.

    The set is given by the upper halves of all its hashes, ascending.
    """
    hashes = np.unique(shingle_hashes(text, words).view(">u8").ravel().astype(np.uint64))
    key = xxhash.xxh3_128_digest(hashes.tobytes())
    whole = np.unique((hashes >> np.uint64(32)).astype("<u4")).tobytes()
    if not len(hashes):
        return key, [0] * SAMPLES, whole
    k = min(SAMPLE, len(hashes))
    chosen = np.tile(np.arange(k), (SAMPLES, 1))
    at_once = max(1, (1 << 18) // len(hashes))  # samples of a very long text are taken one after another
    for first in range(0, SAMPLES if k < len(hashes) else 0, at_once):
        own = _MIXERS[first : first + at_once]
        mixed = (hashes[None, :] ^ own[:, :1]) * own[:, 1:]
        mixed ^= mixed >> np.uint64(32)
        chosen[first : first + at_once] = np.argpartition(mixed, k - 1, axis=1)[:, :k]
    bits = np.unpackbits(hashes[chosen].astype(">u8").view(np.uint8).reshape(SAMPLES, k, 8), axis=2)
    found = np.packbits(2 * bits.sum(axis=1, dtype=np.int64) > k, axis=1)
    return key, found.view(">i8").ravel().tolist(), whole


def set_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - common
    return common / either if either else 1.0


def similar_among(sets: list[np.ndarray], first: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of similar sets: of different sides, or of any two sets if all are ``first``."""
    left = np.flatnonzero(first)
    right = left if first.all() else np.flatnonzero(~first)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    members = np.concatenate([sets[k] for k in right]) if len(right) else np.zeros(0, "<u4")
    owners = np.repeat(np.arange(len(right)), sizes[right])
    _, codes = np.unique(members, return_inverse=True)
    values = np.unique(members)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    held = np.zeros(len(values) + 1, bool)
    for i in left:
        at = np.searchsorted(values, sets[i])
        at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == sets[i])] if len(values) else at[:0]
        held[at] = True
        common = np.bincount(owners[held[codes]], minlength=len(right))
        held[at] = False
        near = right[common >= similarity * (sizes[i] + sizes[right] - common)]
        near = near[near > i] if right is left else near
        out.append((np.full(len(near), i), near))
    return np.concatenate([x[0] for x in out]) if out else left[:0], np.concatenate([x[1] for x in out]) if out else left[:0]


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every different non-null doc_id; components of pairs whose shingle sets are that similar.

    One 64-bit SimHash moves by about ten bits at a similarity of 0.8, far beyond what a trie can search. So each text gets
    SAMPLES fingerprints, each of a min-wise sample of SAMPLE shingles, which a similar text shares with a chance of about
    similarity ** SAMPLE; each sample's fingerprints are joined in a trie of their own. Texts whose fingerprints a trie
    joins are a group, and the pairs of a group are compared by their whole sets, but for pairs that are joined already:
    first the groups of FIRST samples, large ones in chunks that each hold the group's leaders, which joins near copies at a
    cost in proportion to their number; then every group that still holds different components, in pairs of chunks. Texts
    with the same set of shingles (all without words among them) are one from the start. Rows that share a doc_id are one
    document with the first of their sets in order. A very long text is read whole, by one task. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sampled(x, words) for x in batch.column("text").to_pylist()]
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.binary(), pa.list_(pa.int64()), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "key", "prints", "whole"])
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    rows = stored(rows.mapInArrow(sample, "doc_id long, key binary, prints array<long>, whole binary"), "sampled")
    keys = stored(rows.groupBy("doc_id").agg(F.min("key").alias("key")), "shingle-sets")
    firsts = stored(keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-sets")
    owners = firsts.select("key", F.col("first").alias("doc_id"))
    prints = rows.select("doc_id", "key", "prints").join(owners, ["key", "doc_id"], "left_semi").dropDuplicates(["doc_id"])
    members = _grouped(stored(prints.select("doc_id", "prints"), "sample-prints"))
    found = stored(_compared(_different(members.where(F.col("tree") < FIRST)), rows, keys, similarity, False), "similar-links")
    stars = components(found)
    rest = members.where((F.col("tree") >= FIRST) | (F.col("members") > CHUNK))
    found = found.unionByName(stored(_compared(_different(_apart(rest, stars)), rows, keys, similarity, True), "similar-links"))
    stars = components(found)
    named = firsts.join(stars, F.col("first") == F.col("node"), "left").select("key", "n", F.coalesce("root", "first").alias("component_id"))
    return lookup(keys, stored(named, "similar-components"), "key", "n", keys.count()).select("doc_id", "component_id")


def _grouped(prints: DataFrame) -> DataFrame:
    """(doc_id, root, members, tree): the groups of two or more documents whose samples' fingerprints a trie joins."""
    each = prints.select("doc_id", F.posexplode("prints").alias("tree", "bits")).withColumn("fp", F.xxhash64("tree", "bits"))
    groups = stored(each.groupBy("fp").agg(F.first("bits").alias("bits"), F.first("tree").alias("tree"), F.count(F.lit(1)).alias("n")), "print-groups")
    joined = components(stored(links(groups), "print-links"))
    rooted = groups.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "tree", "n", F.coalesce("root", "fp").alias("root"))
    near = stored(rooted.where(F.col("fp") != F.col("root")).select("root").distinct(), "joined-roots")
    alone = rooted.join(near, "root", "left_anti").where("n > 1").select("fp", "tree", "n", "root", F.col("n").alias("members"))
    more = stored(rooted.join(near, "root", "left_semi"), "rooted-prints")
    sizes = stored(more.groupBy("root").agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("rows")), "print-sizes")
    more = lookup(more, sizes, "root", "rows", max(1, more.count())).select("fp", "tree", "n", "root", "members")
    placed = stored(alone.unionByName(more).select("fp", F.struct("root", "members", "tree").alias("group"), "n"), "print-places")
    met = lookup(each.select("doc_id", "fp"), placed, "fp", "n", SAMPLES * prints.count())
    return stored(met.where("group is not null").select("doc_id", "group.*"), "group-members")


def _different(members: DataFrame) -> DataFrame:
    """``members`` without groups that hold the same documents as another group."""
    same = members.groupBy("root").agg(F.first("members").alias("members"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "doc_id")).alias("y"))
    one = stored(same.groupBy("members", "x", "y").agg(F.min("root").alias("root")).select("root", F.col("members").alias("uses"), F.lit(True).alias("met")), "different-groups")
    return lookup(members, one, "root", "uses", max(1, members.count())).where("met").drop("met")


def _apart(members: DataFrame, stars: DataFrame) -> DataFrame:
    """``members`` of the groups that hold different components."""
    placed = members.join(stars.withColumnRenamed("root", "component"), F.col("doc_id") == F.col("node"), "left")
    spread = placed.groupBy("root").agg(F.min(F.coalesce("component", "doc_id")).alias("low"), F.max(F.coalesce("component", "doc_id")).alias("high"), F.first("members").alias("uses"))
    kept = stored(spread.where("low < high").select("root", "uses", F.lit(True).alias("met")), "open-groups")
    return stored(lookup(members, kept, "root", "uses", max(1, members.count())).where("met").drop("met"), "open-members")


def _compared(members: DataFrame, rows: DataFrame, keys: DataFrame, similarity: float, pairs: bool) -> DataFrame:
    """(u, v): links that join what the similar pairs of each group join; ``members`` has root, members and doc_id.

    A group is dealt over chunks. With ``pairs`` every pair of chunks is compared; without, each chunk with itself and with
    the group's leaders.
    """
    members = stored(members.select("root", "members", "doc_id"), "compared-members")
    chunks = F.ceil(F.col("members") / CHUNK)
    dealt = members.withColumn("_chunks", chunks).withColumn("b", F.pmod(F.xxhash64("doc_id"), F.col("_chunks")))
    every = F.expr("sequence(0L, _chunks - 1L)")
    if pairs:
        dealt = dealt.withColumn("other", F.explode(every))
        cell, left = F.xxhash64("root", F.least("b", "other"), F.greatest("b", "other")), F.col("b") <= F.col("other")
    else:
        leads = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.col("members")) < LEADERS
        dealt = dealt.withColumn("other", F.explode(F.when(leads, every).otherwise(F.array("b"))))
        cell, left = F.xxhash64("root", "other"), F.lit(True)
    dealt = dealt.select("doc_id", cell.alias("pair"), left.alias("left"))
    uses = stored(dealt.groupBy("doc_id").agg(F.count(F.lit(1)).alias("uses")).join(keys, "doc_id"), "compared-documents")
    held = rows.select("doc_id", "key", "whole").join(sized(uses, 1_000_000), ["doc_id", "key"]).dropDuplicates(["doc_id"])
    met = lookup(dealt, stored(held.select("doc_id", "whole", "uses"), "compared-sets"), "doc_id", "uses", max(1, dealt.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def links_of(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
            ids, sets = np.array([r[0] for r in rows]), [np.frombuffer(r[2], "<u4") for r in rows]
            if len(rows) == 2:
                u = np.zeros(int(set_similarity(*sets) >= similarity), np.int64)
                v = u + 1
            else:
                u, v = similar_among(sets, np.array([r[1] for r in rows]), similarity)
            root = local_roots(len(ids), u, v)
            moved = np.flatnonzero(root != np.arange(len(ids)))
            return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["u", "v"])

        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("pair", "doc_id", "left", "whole")), strict=True):
                if key != now and held:
                    yield links_of(held)
                    held = []
                now = key
                held.append(tuple(row))
        if held:
            yield links_of(held)
        release_memory()

    return met.repartition("pair").sortWithinPartitions("pair").mapInArrow(run, "u long, v long")
