"""Token files: the ids of a corpus in ascending doc_id order, as coded blocks, and reading them back.

A token file is a Parquet table of coded blocks, so Spark's commit protocol, retries and any store it can write apply:

* ``part``, ``block``: the block's place; documents ascend by doc_id through (part, block);
* ``docs``: array of (row, doc_id, position, at, n): the spans of documents in the block, in order. ``row`` numbers the
  part's documents, ``position`` is the span's first id in the part, ``at`` its first id in the document;
* ``data``: one block of ``range_coder``: header with checksums, then coded bytes. Blocks need no other block to decode.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import range_coder, wide_blocks
from strandline.llm.packing import gathered
from strandline.llm.shared import small_batches, stored
from strandline.llm.tokenise import encoder

SPAN = "struct<row:bigint,doc_id:bigint,position:bigint,at:bigint,n:bigint>"
SPAN_ARROW = pa.list_(pa.struct([(x, pa.int64()) for x in ("row", "doc_id", "position", "at", "n")]))

#: Ids coded side by side, and bytes of texts tokenised at once, since each time costs a look through all words met before;
#: they bound a worker's memory.
AT_ONCE, TEXT_BYTES = wide_blocks.WIDE, 16 << 20


def coded_blocks(docs: DataFrame, tokenizer_path: str, end_id: int = 1, block: int = wide_blocks.WIDE) -> DataFrame:
    """The rows of a token file for ``docs`` (doc_id, text; other columns are not read).

    A null or empty text holds the end id alone. Rows with a null doc_id come first; rows that share a doc_id are all
    written, next to one another. Texts longer than a block go on in the next one. An empty table gives no blocks.
    """
    small_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        vocabulary = max(len(encoder(tokenizer_path).ends_word), end_id + 1)
        held: list[np.ndarray] = []  # ids that fill no block yet
        spans: list[list[dict]] = [[]]
        full: list[np.ndarray] = []
        room, row, position, done = block, 0, 0, 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal full, spans, held, done
            if last and held:
                full.append(np.concatenate(held))
                spans.append([])
                held = []
            if full and (last or len(full) * block >= AT_ONCE):
                n = len(full)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array(range(done, done + n), pa.int32()), pa.array(spans[:n], SPAN_ARROW), pa.array(range_coder.encode(full, vocabulary), pa.binary())],
                    ["part", "block", "docs", "data"],
                )
                done += n
                full, spans = [], spans[n:]

        for table in gathered(batches, TEXT_BYTES):
            ids, counts = encoder(tokenizer_path).encode(table.column("text").combine_chunks())
            first = 0
            for key, n in zip(table.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                own = np.append(ids[first : first + n], np.uint32(end_id))
                first += n
                at = 0
                while at < len(own):
                    take = own[at : at + room]
                    held.append(take)
                    spans[-1].append({"row": row, "doc_id": key, "position": position, "at": at, "n": len(take)})
                    at, room, position = at + len(take), room - len(take), position + len(take)
                    if not room:
                        full.append(np.concatenate(held))
                        spans.append([])
                        held, room = [], block
                        yield from flush(False)
                row += 1
        yield from flush(True)

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(write, f"part int, block int, docs array<{SPAN}>, data binary")


def spans(blocks: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Decoded spans of the blocks of a token file: part, row, doc_id, position, at, n, crc32 (and ids as bytes)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, bytes]] = []
        ids_held = 0

        def emit() -> pa.RecordBatch:
            rows = []
            for (part, docs), ids in zip([x[0] for x in held], range_coder.decode([x[1] for x in held]), strict=True):
                first = 0
                for x in docs:
                    raw = ids[first : first + x["n"]].tobytes()
                    first += x["n"]
                    rows.append({"part": part, **x, "crc32": zlib.crc32(raw)} | ({"ids": raw} if keep_ids else {}))
            held.clear()
            fields = [("part", pa.int32()), *[(k, pa.int64()) for k in ("row", "doc_id", "position", "at", "n", "crc32")], *[("ids", pa.binary())] * keep_ids]
            return pa.RecordBatch.from_pylist(rows, pa.schema(fields))

        for batch in batches:
            for part, docs, data in zip(*(batch.column(c).to_pylist() for c in ("part", "docs", "data")), strict=True):
                if held and ids_held + range_coder.block_length(data) > AT_ONCE:
                    yield emit()
                    ids_held = 0
                held.append(((part, docs), data))
                ids_held += range_coder.block_length(data)
        if held:
            yield emit()

    schema = "part int, row long, doc_id long, position long, at long, n long, crc32 long" + (", ids binary" if keep_ids else "")
    return blocks.select("part", "docs", "data").mapInArrow(read, schema)


def _times(matrix: list[int], vector: int) -> int:
    """A matrix over the two-element field (a list of columns) times a vector."""
    total, k = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[k]
        vector >>= 1
        k += 1
    return total


def joined_crc32(first: int, second: int, second_bytes: int) -> int:
    """crc32 of two byte strings put together, from the crc32 of each and the length of the second."""
    # appending one zero bit is linear in the register; square that map to append 2, 4, 8, ... bits
    matrix = [0xEDB88320, *[1 << k for k in range(31)]]
    bits = second_bytes * 8
    while bits:
        if bits & 1:
            first = _times(matrix, first)
        bits >>= 1
        matrix = [_times(matrix, x) for x in matrix]
    return first ^ second


def documents(blocks: DataFrame) -> DataFrame:
    """Per document of a stored token file: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Starts come from the parts' totals, one row for each part, so no row passes through a single task. Of a document that
    spans blocks only the spans' checksums meet, never its ids.
    """
    found = stored(spans(blocks), "token-spans")
    totals = found.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    starts = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    whole = found.groupBy("part", "row").agg(
        F.first("doc_id").alias("doc_id"), F.min("position").alias("position"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "n", "crc32"))).alias("spans")
    )

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for spans in batch.column("spans").to_pylist():
                crc = 0
                for x in spans:
                    crc = joined_crc32(crc, x["crc32"], 4 * x["n"])
                found.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.int64())], [*names, "ids_crc32"])

    names = ["part", "doc_id", "position", "n_tokens"]
    short = whole.where(F.size("spans") == 1).select(*names, F.col("spans")[0]["crc32"].alias("ids_crc32"))
    long = whole.where(F.size("spans") > 1).mapInArrow(combined, "part int, doc_id long, position long, n_tokens long, ids_crc32 long")
    return short.unionByName(long).join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("position")).alias("start"), "n_tokens", "ids_crc32")


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write a token file to the shared folder and return it as read back; see ``coded_blocks``."""
    return stored(coded_blocks(docs, tokenizer_path, end_id), "token-file")
