"""Phrases of words that occur together more than their parts would, by counting quotient filters.

Texts are read once into shards: streams of word numbers, with zeros where a piece of text ends, and the words they stand for.
Shards' words meet in buckets, where frequent ones get numbers. Phrases are counted length by length. An n-word phrase is packed as the numbers of its first and its last n-1 words, which are frequent phrases themselves or
the phrase can't be; so a key holds all of the phrase in two numbers at every length, and rare phrases are never stored. Each
shard counts its keys in quotient filters, one for each range of permuted keys; filters of a range meet in one task, are
merged, and give numbers to the phrases that are frequent over all shards. Shards are told the numbers of their own frequent
phrases, and rewrite their streams in these for the next length; what has no frequent neighbour leaves the stream.

Nothing but counts and the largest number of a length reaches the driver, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import quotient_filter as qf
from strandline.llm.packing import gathered
from strandline.llm.shared import release_memory, small_batches, stored
from strandline.llm.words import cut_words, hashes, kinds, whole

#: Bytes that separate words, and bytes that end a piece of text.
BREAKS = b".,;:!?\n\x0b\x0c\r"
KINDS = kinds(bytes(b for b in range(256) if b not in b" \t" + BREAKS), BREAKS)

#: Bytes of text in a shard, about; shards' words that meet in a bucket, and entries of filters that meet in a range, about.
SHARD_BYTES, BUCKET, RANGE = 8 << 20, 1 << 20, 1 << 20

UNKNOWN = "und"

TOLD = "id long, lang string, phrase string, prefix long, suffix long, f long, shard long, data binary"


def squeezed(*arrays: np.ndarray) -> bytes:
    """Whole numbers from 0 on, byte by byte of their places, compressed."""
    parts, head = [], [len(arrays)]
    for values in arrays:
        width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
        parts.append(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
        head += [len(values), width]
    return np.array(head, "<i8").tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def opened(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    head = np.frombuffer(data, "<i8", 2 * n, 8).reshape(n, 2).tolist()
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8 + 16 * n :], max_output_size=1 + sum(a * b for a, b in head)), np.uint8), 0, []
    for size, width in head:
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :width] = raw[at : at + size * width].reshape(width, size).T
        out.append(wide.view("<u8").ravel())
        at += size * width
    return out


def _lines(words: pa.Array) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress("\n".join(words.to_pylist()).encode("utf-8", "surrogatepass"))


def _words(data: bytes) -> pa.Array:
    text = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return pc.split_pattern(pa.array([text], pa.large_binary()).cast(pa.large_string()), "\n").flatten()


def _streams(docs: DataFrame) -> DataFrame:
    """Per shard one row with its stream of local numbers (data), and one for each language with its words, their counts and
    the local number of the first (words, data, first); n counts its word occurrences, size its different words."""
    small_batches(docs.sparkSession)
    names = ["shard", "lang", "first", "size", "n", "words", "data"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, table in enumerate(gathered(batches, SHARD_BYTES)):
            shard, known, streams, rows = (TaskContext.get().partitionId() << 24) + k, 0, [], []
            codes = table.column("lang").combine_chunks().dictionary_encode()
            owner, texts = codes.indices.to_numpy(), table.column("text").combine_chunks()
            for k, lang in enumerate(codes.dictionary.to_pylist()):
                words, _, first = cut_words(whole(texts.take(pa.array(np.flatnonzero(owner == k)))), KINDS)
                if not len(words):
                    continue
                found = words.dictionary_encode()
                local, size = found.indices.to_numpy(), len(found.dictionary)
                rows.append((shard, lang, known, size, len(words), _lines(found.dictionary), squeezed(np.bincount(local, minlength=size))))
                streams.append(_spaced(local + known + 1, np.flatnonzero(first)))
                known += size
            if rows:
                rows.append((shard, None, None, None, None, None, squeezed(np.concatenate(streams))))
                kinds_ = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds_, strict=True)], names)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.where("text is not null").mapInArrow(read, "shard long, lang string, first long, size long, n long, words binary, data binary")


def _spaced(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The values with a zero before each of the places ``first`` and one at the end."""
    out, shift = np.zeros(len(values) + len(first) + 1, np.uint64), np.zeros(len(values), np.int64)
    shift[first] = 1
    out[np.arange(len(values)) + np.cumsum(shift)] = values
    return out


def _runs(stream: np.ndarray) -> np.ndarray:
    """The stream without what has no neighbour, and with one zero between runs."""
    full = stream > 0
    beside = np.r_[False, full[:-1]] | np.r_[full[1:], False]
    kept = np.flatnonzero(full & beside)
    return _spaced(stream[kept], np.flatnonzero(np.diff(kept, prepend=-2) > 1))


def _bucketed(read: DataFrame, buckets: int) -> DataFrame:
    """(bucket, shard, lang, words, data): each shard's words, dealt by a hash, with counts and local numbers (data)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, (counts,) = _words(row["words"]), opened(row["data"])
                part = (hashes(words) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edges = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0, True])
                out = []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    at = order[a:b]
                    out.append((int(part[at[0]]), row["shard"], row["lang"], _lines(words.take(pa.array(at))), squeezed(counts[at], at + row["first"] + 1)))
                types = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["bucket", "shard", "lang", "words", "data"])

    named = read.where("words is not null").select("shard", "lang", "first", "words", "data")
    return named.mapInArrow(deal, "bucket long, shard long, lang string, words binary, data binary")


def _told(found: list[pd.DataFrame]) -> pd.DataFrame:
    """Rows of TOLD."""
    names = dict(x.split() for x in TOLD.split(", "))
    rows = (pd.concat(found) if found else pd.DataFrame()).reindex(columns=list(names))
    return rows.astype({c: "Int64" if kind == "long" else object for c, kind in names.items()})


def _first_numbers(bucketed: DataFrame, buckets: int, least: int) -> DataFrame:
    """TOLD: frequent words (id, lang, phrase, f), and rows (shard, data) that tell a shard the numbers of its own ones.

    Numbers run within a bucket and interleave the buckets.
    """

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        found, back, known, bucket = [], [], 0, int(rows["bucket"].iloc[0])
        for lang, own in rows.groupby("lang"):
            words, numbers = [_words(x) for x in own["words"]], [opened(x) for x in own["data"]]
            codes = pa.concat_arrays(words).dictionary_encode()
            code, f = codes.indices.to_numpy(), np.zeros(len(codes.dictionary), np.int64)
            np.add.at(f, code, np.concatenate([c for c, _ in numbers]).astype(np.int64))
            often = np.flatnonzero(f >= least)
            ids = np.zeros(len(f), np.int64)
            ids[often] = (np.arange(len(often)) + known) * buckets + bucket + 1
            known += len(often)
            if not len(often):
                continue
            found.append(pd.DataFrame({"id": ids[often], "lang": lang, "phrase": codes.dictionary.take(pa.array(often)).to_pylist(), "f": f[often]}))
            edges = np.cumsum([0, *map(len, words)])
            for k, shard in enumerate(own["shard"]):
                mine = ids[code[edges[k] : edges[k + 1]]]
                if mine.any():
                    back.append((shard, squeezed(numbers[k][1][mine > 0], mine[mine > 0])))
        release_memory()
        return _told([*found, *([pd.DataFrame(back, columns=["shard", "data"])] if back else [])])

    return bucketed.groupBy("bucket").applyInPandas(merge, TOLD)


def _keys(now: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where a longer phrase may start, its permuted pair of numbers, and the bits of the pair that 64 don't hold."""
    at = np.flatnonzero((now[:-1] > 0) & (now[1:] > 0))
    first, second = now[at], now[at + 1]
    lane = first >> np.uint64(64 - bits) if 2 * bits > 64 else np.zeros(len(at), np.uint64)
    return at, qf.Permutation(min(64, 2 * bits))((first << np.uint64(bits)) | second), lane


def _renamed(now: np.ndarray, told: list[bytes], bits: int) -> np.ndarray:
    """The stream of the numbers of phrases one longer than those of ``now``."""
    at, keys, lanes = _keys(now, bits)
    out = np.zeros(len(now), np.uint64)
    lists = [opened(x) for x in told]
    for lane in np.unique(np.concatenate([x[0] for x in lists])) if lists else ():
        mine, own = np.flatnonzero(lanes == lane), [x for x in lists if x[0][0] == lane]
        key, number = np.concatenate([x[1] for x in own]), np.concatenate([x[2] for x in own])
        order = np.argsort(key)
        key, number = key[order], number[order]
        place = np.minimum(np.searchsorted(key, keys[mine]), len(key) - 1)
        hit = key[place] == keys[mine]
        out[at[mine[hit]]] = number[place[hit]]
    return out


def _counted(streams: DataFrame, told: DataFrame, before: int, bits: int, ranges: int) -> DataFrame:
    """Each shard's stream in the numbers it was told, and its counts of pairs of these: rows (lane, range, shard, data).

    Rows without a range are streams, the others filters. ``before`` has the bits of the numbers that streams hold so far (0:
    local numbers of words), ``bits`` those of the new numbers; ``ranges`` is a power of two.
    """
    top, size = (ranges - 1).bit_length(), min(64, 2 * bits)

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        (now,), told = opened(rows["data"][~rows["told"]].iloc[0]), list(rows["data"][rows["told"]])
        if before:
            now = _renamed(now, told, before)
        else:
            ids = np.zeros(int(now.max(initial=0)) + 1, np.uint64)
            for local, number in map(opened, told):
                ids[local] = number
            now = ids[now]
        now = _runs(now)
        shard = int(rows["shard"].iloc[0])
        out = [(None, None, shard, squeezed(now))]
        _, keys, lanes = _keys(now, bits)
        for lane in np.unique(lanes):
            key, n = np.unique(keys[lanes == lane], return_counts=True)
            part = (key >> np.uint64(size - top)).astype(np.int64) if top else np.zeros(len(key), np.int64)
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            rest = key & np.uint64((1 << (size - top)) - 1)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                out.append((int(lane), int(part[a]), shard, qf.to_bytes(rest[a:b], n[a:b], size - top)))
        release_memory()
        return pd.DataFrame(out, columns=["lane", "range", "shard", "data"]).astype({"lane": "Int64", "range": "Int64"})

    rows = streams.select("shard", F.lit(False).alias("told"), "data").unionByName(told.select("shard", F.lit(True).alias("told"), "data"))
    return rows.groupBy("shard").applyInPandas(count, "lane long, range long, shard long, data binary")


def _merged(filters: DataFrame, bits: int, ranges: int, least: int) -> DataFrame:
    """TOLD: frequent phrases (id, prefix, suffix, f), and rows (shard, data) that tell a shard the numbers of its own ones."""
    top, size = (ranges - 1).bit_length(), min(64, 2 * bits)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        lane, part = int(rows["lane"].iloc[0]), int(rows["range"].iloc[0])
        each = [qf.items(x) for x in rows["data"]]
        keys, counts = qf.merged(each)
        keys, counts = keys[counts >= least], counts[counts >= least].astype(np.int64)
        full = keys | np.uint64(part << (size - top) if top else 0)
        ids = (np.arange(len(keys)) << top) + part + 1  # numbers run within a range and interleave the ranges
        if 2 * bits > 64:
            ids = (ids << (2 * bits - 64)) + lane  # and the lanes
        pair = qf.Permutation(size).inverse(full)
        first = (pair >> np.uint64(bits)) | np.uint64(lane << (64 - bits) if lane else 0)
        found = pd.DataFrame({"id": ids, "prefix": first.astype(np.int64), "suffix": (pair & np.uint64((1 << bits) - 1)).astype(np.int64), "f": counts})
        back = []
        for shard, (own, _) in zip(rows["shard"], each, strict=True):
            _, at, _ = np.intersect1d(keys, own, assume_unique=True, return_indices=True)
            if len(at):
                back.append((shard, squeezed(np.full(len(at), lane), full[at], ids[at])))
        release_memory()
        return _told([x for x in (found, pd.DataFrame(back, columns=["shard", "data"])) if len(x)])

    return filters.groupBy("lane", "range").applyInPandas(merge, TOLD)


def frequent_phrases(docs: DataFrame, longest: int = 5, least: int = 100) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) with all words of each language, and for each length from 1 the table of its frequent phrases.

    Words' table is (id, lang, phrase, f), the others' (id, prefix, suffix, f): numbers of the first and of the last words in
    the table one length below.
    """
    read = stored(_streams(docs), "phrase-streams")
    totals = read.groupBy("lang").agg(F.sum("n").alias("n")).where("n is not null")
    buckets = max(1, -(-(read.agg(F.sum("size")).first()[0] or 0) // BUCKET))
    told = stored(_first_numbers(_bucketed(read, buckets), buckets, least), "phrases-1")
    levels, streams, before = [told.where("shard is null").select("id", "lang", "phrase", "f")], read.where("words is null"), 0
    for level in range(2, longest + 1):
        most, occurrences = levels[-1].agg(F.max("id"), F.sum("f")).first()
        if not most:
            break
        bits = int(most).bit_length()
        ranges = 1 << (min(-(-occurrences // RANGE) - 1, (1 << min(62, 2 * bits - 1)) - 1)).bit_length()
        counted = stored(_counted(streams, told.where("shard is not null"), before, bits, ranges), f"phrase-filters-{level}")
        told = stored(_merged(counted.where("range is not null"), bits, ranges, least), f"phrases-{level}")
        levels.append(told.where("shard is null").select("id", "prefix", "suffix", "f"))
        streams, before = counted.where("range is null"), bits
    return totals, levels


def collocations(docs: DataFrame, most: int = 2000, longest: int = 5, least: int = 100, share: int = 100) -> DataFrame:
    """Each language's ``most`` best phrases: lang, rank, phrase, a, l, r, n, score.

    A candidate is a phrase of 2 to ``longest`` words within a piece of text that occurs a >= ``least`` times in its language.
    Its score is the lowest floor(1000 a n / (l r)) over its cuts into a first part (l times) and a rest (r times), at the
    smallest cut if several are lowest. Candidates inside a longer one that occurs at least ``share`` % as often go: such a
    one has a phrase of just one word more on its way, which occurs as often at least, so those alone are looked at.

    Null texts hold nothing; a null language is "und". Each row counts, also rows that repeat. A very long text is a shard of
    its own. Other columns of ``docs`` aren't read. An empty table, or one without candidates, gives no rows.
    """
    totals, levels = frequent_phrases(docs, longest, least)
    known = levels[0].select("id", "lang", "phrase", "f", F.array("f").alias("firsts"), F.array("f").alias("lasts"))
    found = []
    for k, table in enumerate(levels[1:], 1):
        a = known.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("_head"), "firsts")
        b = known.select(F.col("id").alias("suffix"), F.substring_index("phrase", " ", -1).alias("_tail"), "lasts")
        spelled = table.join(a, "prefix").join(b, "suffix")
        known = stored(
            spelled.select(
                "id", "lang", F.concat_ws(" ", "_head", "_tail").alias("phrase"), "f",
                F.concat("firsts", F.array("f")).alias("firsts"), F.concat("lasts", F.array("f")).alias("lasts"),
            ),
            f"phrases-spelled-{k + 1}",
        )
        if k + 1 < len(levels):
            above = levels[k + 1]
            longer = above.select(F.col("prefix").alias("_in"), F.col("f").alias("_f")).unionByName(above.select(F.col("suffix").alias("_in"), F.col("f").alias("_f")))
            longer = longer.groupBy("_in").agg(F.max("_f").alias("_f"))
            kept = known.join(longer, F.col("id") == F.col("_in"), "left").where(F.col("_f").isNull() | (F.lit(100).cast("decimal(4,0)") * F.col("_f") < F.lit(share) * F.col("f").cast("decimal(20,0)")))
        else:
            kept = known
        found.append(kept.select("lang", "phrase", F.col("f").alias("a"), "firsts", "lasts"))
    if not found:
        found = [known.where("false").select("lang", "phrase", F.col("f").alias("a"), "firsts", "lasts")]
    every = found[0]
    for rows in found[1:]:
        every = every.unionByName(rows)
    score = "(1000 * (cast(a as decimal(19,0)) * cast(n as decimal(19,0)))) div (cast(firsts[k - 1] as decimal(19,0)) * cast(lasts[size(lasts) - k - 1] as decimal(19,0)))"
    cut = F.expr(f"array_min(transform(sequence(1, size(firsts) - 1), k -> struct({score} as score, k as k, firsts[k - 1] as l, lasts[size(lasts) - k - 1] as r)))")
    scored = every.join(totals, "lang").withColumn("_cut", cut).select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
