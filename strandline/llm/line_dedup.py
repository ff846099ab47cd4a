"""Line dedup over an index that documents can enter and leave.

The index has three stored tables:

* ``holders``: (key, doc_id) for every document that holds a long enough line; the exact record;
* ``refs``: (key, n_docs, max_doc): exact reference counts;
* ``filters``: one cuckoo filter for each shard of keys, over the common keys: those with at least ``min_docs`` documents.

A line whose key no filter knows stays without a look at the exact tables; the others are decided by ``refs``. Documents
that enter or leave change the counts of their own keys alone, and the filters take in or drop just the keys that became
or ceased to be common, so an insertion followed by its deletion gives the earlier state.

A key is a line without white space at its ends and with A-Z lowered; tables hold its 128-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.cuckoo import CuckooFilter
from strandline.llm.shared import added_to, lookup, small_batches, stored

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Keys of a filter shard, about; bytes of all filters up to which they are broadcast; and holders that meet one copy of a
#: filter beyond that, about.
SHARD_KEYS, BROADCAST_BYTES, HOLDERS = 250_000, 64 << 20, 1_000_000


def line_keys(text: str, min_chars: int) -> list[bytes | None]:
    """The hashed key of each line; None for a key that is too short to count."""
    found = []
    for line in text.split("\n"):
        key = line.strip(SPACE)
        found.append(xxhash.xxh3_128_digest(key.translate(LOWER).encode()) if len(key) >= min_chars else None)
    return found


@dataclass
class LineIndex:
    holders: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int


def _postings(docs: DataFrame, min_chars: int) -> DataFrame:
    """(key, doc_id) of every long enough line; rows that share a doc_id are one document, a null doc_id none."""
    small_batches(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = {k for k in line_keys(text, min_chars) if k}
                keys.extend(own)
                ids.extend([doc_id] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(read, "key binary, doc_id long").distinct()


def _counted(holders: DataFrame) -> DataFrame:
    return holders.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    return keys.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key")


def _as_keys(values) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in values), "S16") if len(values) else np.zeros(0, "S16")


def _filters(keys: DataFrame, shards: int) -> DataFrame:
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        own = CuckooFilter(len(rows))
        own.insert(_as_keys(rows["key"]))
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "n": [len(rows)], "data": [own.to_bytes()]})

    return _sharded(keys, shards).groupBy("shard").applyInPandas(build, "shard int, n long, data binary")


def _common(index_refs: DataFrame, min_docs: int) -> DataFrame:
    return index_refs.where(F.col("n_docs") >= min_docs)


def build(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> LineIndex:
    """An index of ``docs`` (doc_id, text; other columns are not read). An empty table gives an empty index."""
    holders = stored(_postings(docs, min_chars), "line-holders")
    refs = stored(_counted(holders), "line-refs")
    shards = max(1, -(-_common(refs, min_docs).count() // SHARD_KEYS))
    return LineIndex(holders, refs, stored(_filters(_common(refs, min_docs).select("key"), shards), "line-filters"), shards, min_docs, min_chars)


def _changed(index: LineIndex, holders: DataFrame, touched: DataFrame) -> LineIndex:
    """The index over new ``holders`` when only the keys of ``touched`` have other holders than before."""
    holders = stored(holders, "line-holders")
    rows = touched.groupBy("key").agg(F.count(F.lit(1)).alias("_new"))
    known = index.refs.select(F.col("key").alias("_known"), F.col("n_docs").alias("_old"))
    rows = rows.join(known, F.col("key") == F.col("_known"), "left").select("key", (F.col("_new") + F.coalesce("_old", F.lit(0))).alias("rows"))
    touched = stored(rows, "line-touched")
    met = lookup(holders, touched.withColumn("met", F.lit(True)), "key", "rows", max(1, holders.count()))
    counts = _counted(met.where("met"))
    touched = touched.select("key")
    refs = stored(index.refs.join(touched, "key", "left_anti").unionByName(counts), "line-refs")
    before = _common(index.refs, index.min_docs).join(touched, "key", "left_semi").select("key")
    after = _common(refs, index.min_docs).join(touched, "key", "left_semi").select("key")
    moves = _sharded(after.join(before, "key", "left_anti"), index.shards).withColumn("enters", F.lit(True)).unionByName(
        _sharded(before.join(after, "key", "left_anti"), index.shards).withColumn("enters", F.lit(False))
    )

    def update(old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        enters = rows["enters"].to_numpy(bool) if len(rows) else np.zeros(0, bool)
        keys = _as_keys(rows["key"])
        filled = int(old["n"].iloc[0]) if len(old) else 0
        own = CuckooFilter.of(bytes(old["data"].iloc[0])) if len(old) else CuckooFilter(2 * len(rows))
        own.remove(keys[~enters])
        own.insert(keys[enters])
        shard = (old if len(old) else rows)["shard"].iloc[0]
        return pd.DataFrame({"shard": [shard], "n": [filled + int(enters.sum()) - int((~enters).sum())], "data": [own.to_bytes()]})

    grown = index.filters.select("shard", "n").unionByName(_sharded(after, index.shards).groupBy("shard").agg(F.count(F.lit(1)).alias("n")))
    fullest = grown.groupBy("shard").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    capacity = index.filters.agg(F.min(F.length("data") / 2)).first()[0]
    if capacity is None or fullest > 0.8 * capacity:  # too full to add to: build the filters anew from the exact counts
        shards = max(1, -(-_common(refs, index.min_docs).count() // SHARD_KEYS))
        return LineIndex(holders, refs, stored(_filters(_common(refs, index.min_docs).select("key"), shards), "line-filters"), shards, index.min_docs, index.min_chars)
    filters = index.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(update, "shard int, n long, data binary")
    return LineIndex(holders, refs, stored(filters, "line-filters"), index.shards, index.min_docs, index.min_chars)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with ``docs`` added; lines that a document already holds count once."""
    new = stored(_postings(docs, index.min_chars).join(index.holders, ["key", "doc_id"], "left_anti"), "line-new")
    return _changed(index, index.holders.unionByName(new), new)


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents of ``doc_ids`` (column doc_id); ids it doesn't know change nothing."""
    gone = doc_ids.select(F.col("doc_id").cast("long")).distinct()
    touched = stored(index.holders.join(gone, "doc_id", "left_semi"), "line-gone")
    return _changed(index, index.holders.join(gone, "doc_id", "left_anti"), touched)


def _shard(index: LineIndex) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(index.shards)).cast("int").alias("shard")


def _candidates(index: LineIndex) -> DataFrame:
    """Holders whose key may be common: all that the filters don't rule out.

    Filters are broadcast while they are small. Beyond that each filter is dealt, in as many copies as its shard's holders
    ask for, to tasks that read it and then their holders one after another.
    """
    size = index.filters.agg(F.sum(F.length("data"))).first()[0] or 0
    if size > BROADCAST_BYTES:
        return _met_by_shard(index)
    shared = index.holders.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["data"]) for r in index.filters.collect()})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: CuckooFilter.of(x) for k, x in shared.value.items()}
        for batch in batches:
            keys, shard = _as_keys(batch.column("key").to_pylist()), batch.column("shard").to_numpy()
            may = np.zeros(len(keys), bool)
            for k in np.unique(shard):
                if k in own:
                    may[shard == k] = own[k].contains(keys[shard == k])
            yield batch.select(["key", "doc_id"]).filter(pa.array(may))

    return index.holders.select("key", "doc_id", _shard(index)).mapInArrow(probe, "key binary, doc_id long")


def _met_by_shard(index: LineIndex) -> DataFrame:
    copies = max(1, -(-index.holders.count() // (index.shards * HOLDERS)))
    copy = F.pmod(F.xxhash64("doc_id"), F.lit(copies)).cast("int")
    holders = index.holders.select(_shard(index), copy.alias("copy"), "key", "doc_id", F.lit(None).cast("binary").alias("data"))
    filters = index.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc_id"), "data")
    rows = holders.unionByName(filters).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("data").isNull())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None  # the shard at hand and its filter, which comes before its holders
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            edges = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]).tolist() if len(shards) else []
            for first, last in zip(edges, [*edges[1:], len(shards)], strict=True):
                part = batch.slice(first, last - first)
                given = part.column("data").drop_null().to_pylist()
                if given:
                    now, own = shards[first], CuckooFilter.of(given[0])
                part = part.filter(part.column("data").is_null())
                if part.num_rows and now == shards[first]:
                    yield part.select(["key", "doc_id"]).filter(pa.array(own.contains(_as_keys(part.column("key").to_pylist()))))

    return rows.mapInArrow(probe, "key binary, doc_id long")


def drops(index: LineIndex) -> DataFrame:
    """Per document of the index that loses lines: doc_id, keys (of the lines it loses)."""
    common = _common(index.refs, index.min_docs)
    found = lookup(_candidates(index), common, "key", "n_docs", index.holders.count())
    return found.where(F.col("doc_id") < F.col("max_doc")).groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def deduplicated(docs: DataFrame, index: LineIndex) -> DataFrame:
    """All columns of ``docs``, text without the lines it loses, and n_lines (before) and n_dropped.

    A line goes if its key is long enough, at least ``min_docs`` indexed documents hold it, and this is not the largest
    doc_id among them; every line of that key in the document goes. A null text is one empty line and stays an empty text.
    Documents with a null doc_id, or that the index doesn't hold, keep all lines. Columns n_lines and n_dropped are
    replaced. Rows that share a doc_id are one document in the index, and each loses its own lines. A very long text is cut
    in one piece by one task, whole. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    lost = drops(index).select(F.col("doc_id").alias("_doc"), F.col("keys").alias("_keys"))
    min_chars, names = index.min_chars, docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, dropped = batch.column("text").to_pylist(), [], []
            for k, keys in enumerate(batch.column("_keys").to_pylist()):
                total.append(texts[k].count("\n") + 1)
                if keys:
                    gone = set(keys)
                    kept = [line for line, key in zip(texts[k].split("\n"), line_keys(texts[k], min_chars), strict=True) if key not in gone]
                    texts[k] = "\n".join(kept)
                    dropped.append(total[-1] - len(kept))
                else:
                    dropped.append(0)
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    joined = docs.join(lost, F.col("doc_id").cast("long") == F.col("_doc"), "left").drop("_doc")
    return joined.mapInArrow(cut, added_to(docs.schema).add("n_lines", "long").add("n_dropped", "long"))
