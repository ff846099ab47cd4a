"""Best-fit packing planned over the histogram of lengths.

The plan is made over counts of lengths, never over documents: at most one count for each length up to the limit reaches
the driver. A length's documents then take the planned slots by their rank within that length.

Planning is best-fit decreasing. Sequences with the same free room form runs; a run that takes documents of a length L
keeps less than half its room, so it is touched at most log2(limit) times, and the plan has at most about
3 * limit * log2(limit) rows whatever the corpus holds. That bound is what allows it to be broadcast.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.shared import release_memory, small_batches, stored
from strandline.llm.tokenise import encoder

PLAN = "length long, rank_from long, rank_to long, first_sequence long, each long, room_used long"


def pieces(docs: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Token pieces of at most ``limit`` ids: doc_id, piece, start, length, ids_crc32 (and ids as little-endian bytes).

    A null or empty text is one piece that holds the end id alone. A text of n ids with its end gives ceil(n / limit)
    pieces, all but the last full. Every row of ``docs`` gives its own pieces, also rows that repeat; a null doc_id stays
    null. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            ids, counts = encoder(tokenizer_path).encode(table.column("text").combine_chunks())
            doc, piece, start, length, crc, raw = [], [], [], [], [], []
            end = np.array([end_id], dtype="<u4")
            at = 0
            for key, n in zip(table.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                own = np.concatenate([ids[at : at + n].astype("<u4"), end])
                at += n
                for k, first in enumerate(range(0, n + 1, limit)):
                    data = own[first : first + limit].tobytes()
                    doc.append(key)
                    piece.append(k)
                    start.append(first)
                    length.append(len(data) // 4)
                    crc.append(zlib.crc32(data))
                    raw.append(data if keep_ids else None)
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(raw, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def gathered(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.Table]:
    """Tables of successive batches, each closed once it holds ``most_bytes``, so that words repeat within it.

    Freed memory goes back to the system after each table: a worker that lives on must not keep its peak.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= most_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
            release_memory()
    if held:
        yield pa.Table.from_batches(held)
    held = []
    release_memory()


def plan(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of PLAN for the counts of each length: ranks [from, to) of a length go to sequences first_sequence on,
    ``each`` to a sequence, after ``room_used`` places."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # free room: (first sequence, how many)
    rooms: list[int] = []
    made = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[k]
            else:
                room, first = limit, made
                n = -(-left // (limit // length))
                made += n
            each = room // length
            take = min(left, n * each)
            rows.append((length, rank, rank + take, first, each, limit - room))
            full, part = divmod(take, each)
            put(room - each * length, first, full)
            if part:
                put(room - part * length, first + full, 1)
            put(room, first + full + bool(part), n - full - bool(part))
            rank, left = rank + take, left - take
    return rows


def ranked(cut: DataFrame) -> DataFrame:
    """Each piece's rank (from 0) among the pieces of its length.

    A length that holds a third of the pieces is dealt over salts: ranks run within (length, salt), and a salt starts
    where the earlier salts of its length end.
    """
    salts = 2 * int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    return (
        salted.withColumn("_row", F.row_number().over(own))
        .join(offsets, ["length", "_salt"])
        .withColumn("_rank", F.col("_before") + F.col("_row") - 1)
        .drop("_salt", "_row", "_before")
    )


def placed(cut: DataFrame, limit: int = 4096) -> DataFrame:
    """The pieces of ``cut`` (with a ``length`` of 1 to ``limit``) with their sequence_id and offset there.

    ``cut`` is read three times and should be a stored table.
    """
    spark = cut.sparkSession
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``limit`` rows
    slots = F.broadcast(spark.createDataFrame(plan(histogram, limit), PLAN).withColumnRenamed("length", "_length"))
    within = F.col("_rank") - F.col("rank_from")
    return (
        ranked(cut)
        .join(slots, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to")))
        .withColumn("sequence_id", (F.col("first_sequence") + F.expr("(_rank - rank_from) div each")).cast("long"))
        .withColumn("offset", (F.col("room_used") + F.pmod(within, F.col("each")) * F.col("length")).cast("long"))
        .select(*cut.columns, "sequence_id", "offset")
    )


def pack(docs: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place; see ``pieces`` for nulls, empty texts and repeated rows.

    Pieces of one length that tie on doc_id and piece are alike, so either may take either slot.
    """
    return placed(stored(pieces(docs, tokenizer_path, limit, end_id, keep_ids), "pieces"), limit)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, of at most ``limit`` ids each: sequence_id, ids (little-endian bytes), n_pieces."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.expr("aggregate(parts, X'', (a, p) -> a || p.ids)").alias("ids"), F.size("parts").alias("n_pieces")
    )
