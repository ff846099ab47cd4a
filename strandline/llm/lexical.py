"""Ranked lexical search with Block-Max MaxScore over an inverted index in shards.

Reading a corpus once gives its number of documents and of terms; reading it again gives the index. A task turns its documents
into shards that hold about SHARD_PAIRS postings: for each term the documents and occurrences, in blocks of BLOCK with gaps
and counts in one to four bytes, and beside each block its first document and the largest impact in it.

A shard answers a query term by term, from the list with the largest bound down. Lists are read whole as long as a document
that all earlier ones lack could still be among the best: those are the essential lists. From there on only documents met
already are candidates; a block's maximum drops those that can't get in before the block is decompressed. Shards' best
documents are merged by score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.packing import gathered
from strandline.llm.shared import release_memory, small_batches, stored
from strandline.llm.words import count_words, cut_words, kinds, whole

#: Terms are runs of ASCII letters and digits and of all characters beyond ASCII.
KINDS = kinds(bytes(b for b in range(256) if b >= 128 or chr(b).isalnum()))

#: Bytes of text read at once, postings of a shard, postings of a block.
TEXT_BYTES, SHARD_PAIRS, BLOCK = 8 << 20, 4_000_000, 128

#: Queries, and terms of queries, that are searched for at once.
QUERIES, QUERY_TERMS = 2_000, 200_000

POSTINGS = "shard long, term string, df long, top long, firsts binary, maxima binary, widths binary, data binary, ids binary, known binary"


@dataclass
class Index:
    """``table`` has a row for each term of a shard (POSTINGS), and one without a term with the shard's doc_ids, which of
    them are known, and length norms (data)."""

    table: DataFrame
    documents: int
    terms: int


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What tf occurrences in a document of length norm m are worth, in millionths."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def weight(documents: int, df: int) -> int:
    return int(np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))))


def _width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def _binary(data: np.ndarray, places: np.ndarray) -> pa.Array:
    """Slices of an array between successive places, as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer((places * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _put(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    for k in range(4):
        has = width > k
        out[at[has] + k] = values[has] >> 8 * k & 255


def shard_rows(shard: int, terms: pa.Array, code: np.ndarray, doc: np.ndarray, tf: np.ndarray, ids: pa.Array, m: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a shard from postings (code of a term, place of a document, tf) and documents (id, length norm)."""
    names = [x.split()[0] for x in POSTINGS.split(", ")]
    order = np.argsort(code.astype(np.int64) << 32 | doc, kind="stable")
    code, doc, tf = code[order], doc[order].astype(np.int64), tf[order].astype(np.int64)
    lists = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    size = np.diff(np.r_[lists, len(code)])
    within = np.arange(len(code)) - np.repeat(lists, size)
    begins = np.flatnonzero(within % BLOCK == 0)
    count = np.diff(np.r_[begins, len(code)])
    gap = np.diff(doc, prepend=0)
    gap[begins] = 0
    value = impact(tf, m[doc])
    if len(code):
        wide, deep = _width(np.maximum.reduceat(gap, begins)), _width(np.maximum.reduceat(tf, begins))
        place = np.concatenate([[0], np.cumsum(count * (wide + deep))])
        data = np.zeros(int(place[-1]), np.uint8)
        inner, block = within % BLOCK, np.repeat(np.arange(len(begins)), count)
        _put(data, place[block] + inner * wide[block], gap, wide[block])
        _put(data, place[block] + count[block] * wide[block] + inner * deep[block], tf, deep[block])
        blocks = np.concatenate([[0], np.cumsum(-(-size // BLOCK))])
        n = len(lists)
        columns = [
            pa.array(np.full(n, shard)), terms.take(pa.array(code[lists])).cast(pa.string()), pa.array(size), pa.array(np.maximum.reduceat(value, lists)),
            _binary(doc[begins].astype("<u4"), blocks), _binary(np.maximum.reduceat(value, begins).astype("<u4"), blocks),
            _binary((wide << 4 | deep).astype(np.uint8), blocks), _binary(data, place[blocks]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names)
    own = {"shard": pa.array([shard]), "ids": pa.array([ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()), "known": pa.array([np.asarray(ids.is_valid()).astype(np.uint8).tobytes()], pa.binary()), "data": pa.array([m.astype("<i8").tobytes()], pa.binary())}
    kind = {"term": pa.string(), "df": pa.int64(), "top": pa.int64()}
    yield pa.RecordBatch.from_arrays([own.get(c, pa.nulls(1, kind.get(c, pa.binary()))) for c in names], names)


class Postings:
    """One term's list in a shard; ``read`` gives (documents, tf) of some blocks, in order of the documents."""

    def __init__(self, row):
        self.df, self.top = int(row.df), int(row.top)
        self.firsts, self.maxima = np.frombuffer(row.firsts, "<u4").astype(np.int64), np.frombuffer(row.maxima, "<u4").astype(np.int64)
        widths = np.frombuffer(row.widths, np.uint8)
        self.wide, self.deep, self.data = (widths >> 4).astype(np.int64), (widths & 15).astype(np.int64), np.frombuffer(row.data, np.uint8)
        self.count = np.full(len(widths), BLOCK)
        self.count[-1] = self.df - BLOCK * (len(widths) - 1)
        self.place = np.cumsum(self.count * (self.wide + self.deep)) - self.count * (self.wide + self.deep)

    def read(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs, tfs = [], []
        shape = (self.count[blocks] * 8 + self.wide[blocks]) * 8 + self.deep[blocks]
        for kind in np.unique(shape):  # blocks of one shape are decompressed together
            some = blocks[shape == kind]
            n, wide, deep = int(self.count[some[0]]), int(self.wide[some[0]]), int(self.deep[some[0]])
            raw = self.data[self.place[some][:, None] + np.arange(n * (wide + deep))]
            gaps = np.ascontiguousarray(raw[:, : n * wide]).view(f"<u{wide}")
            docs.append((self.firsts[some][:, None] + np.cumsum(gaps, axis=1, dtype=np.int64)).ravel())
            tfs.append(np.ascontiguousarray(raw[:, n * wide :]).view(f"<u{deep}").astype(np.int64).ravel())
        docs, tfs = np.concatenate(docs), np.concatenate(tfs)
        order = np.argsort(docs)
        return docs[order], tfs[order]


def _kth(scores: np.ndarray, k: int) -> int:
    """The k-th largest score; 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


class Searcher:
    """Queries over one shard: ``lists`` by term, doc_ids and the norm that makes impacts of counts."""

    def __init__(self, lists: dict[str, Postings], m: np.ndarray):
        self.lists, self.m = lists, m
        self.whole: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.blocks_read = 0

    def _all(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        if term not in self.whole:
            own = self.lists[term]
            self.blocks_read += len(own.firsts)
            docs, tf = own.read(np.arange(len(own.firsts)))
            self.whole[term] = docs, impact(tf, self.m[docs])
        return self.whole[term]

    def best(self, weights: dict[str, int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that may be among the k best; ties with the k-th are all there."""
        terms = sorted((t for t in weights if t in self.lists and weights[t] > 0), key=lambda t: -weights[t] * self.lists[t].top)
        left = np.concatenate([np.cumsum([weights[t] * self.lists[t].top for t in terms][::-1], dtype=np.int64)[::-1], [0]]).astype(np.int64)
        total, least, j = np.zeros(len(self.m), np.int64), 1, 0
        while j < len(terms) and left[j] >= least:  # essential lists
            docs, value = self._all(terms[j])
            total[docs] += weights[terms[j]] * value
            least, j = max(least, _kth(total, k)), j + 1
        held = np.flatnonzero(total)
        for i in range(j, len(terms)):  # the others, for candidates alone
            own, w = self.lists[terms[i]], weights[terms[i]]
            held = held[total[held] + left[i] >= least]
            block = np.searchsorted(own.firsts, held, "right") - 1
            may = np.where(block >= 0, own.maxima[np.maximum(block, 0)], 0)
            stays = total[held] + w * may + left[i + 1] >= least
            held, block = held[stays], block[stays]
            if terms[i] in self.whole:
                docs, value = self.whole[terms[i]]
            else:
                some = np.unique(block[block >= 0])
                if not len(some):
                    continue
                self.blocks_read += len(some)
                docs, tf = own.read(some)
                value = impact(tf, self.m[docs])
            at = np.minimum(np.searchsorted(docs, held), len(docs) - 1)
            hit = docs[at] == held
            total[held[hit]] += w * value[at[hit]]
            least = max(least, _kth(total[held], k))
        held = held[total[held] >= least]
        return held, total[held]


def _norms(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    return np.array([75 + 25 * n * documents // terms for n in lengths.tolist()], np.int64)


def build(docs: DataFrame) -> Index:
    """The index of ``docs`` (doc_id, text; other columns aren't read). Every row is a document of its own.

    Null texts, and texts without a term, aren't documents. A very long text is read whole, by one task.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = count_words(whole(batch.column("text")), KINDS)
            yield pa.RecordBatch.from_arrays([pa.array([int((own > 0).sum())]), pa.array([int(own.sum())])], ["documents", "terms"])

    documents, total = (int(x or 0) for x in rows.select("text").mapInArrow(count, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, pairs = 0, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            shard = (TaskContext.get().partitionId() << 24) + made
            terms = pa.concat_arrays([h[0] for h in held]).dictionary_encode()
            code = terms.indices.to_numpy().astype(np.int64)
            first, base = np.cumsum([0, *(len(h[0]) for h in held)]), np.cumsum([0, *(len(h[4]) for h in held)])
            codes = np.concatenate([code[h[1] + a] for h, a in zip(held, first, strict=False)])
            places = np.concatenate([h[2] + b for h, b in zip(held, base, strict=False)])
            return shard_rows(shard, terms.dictionary, codes, places, np.concatenate([h[3] for h in held]), pa.concat_arrays([h[4] for h in held]), np.concatenate([h[5] for h in held]))

        for table in gathered(batches, TEXT_BYTES):
            words, owner, _ = cut_words(whole(table.column("text")), KINDS)
            lengths = np.bincount(owner, minlength=table.num_rows)
            found = words.dictionary_encode()
            pair, tf = np.unique(found.indices.to_numpy().astype(np.int64) * table.num_rows + owner, return_counts=True)
            held.append((found.dictionary, pair // table.num_rows, pair % table.num_rows, tf, table.column("doc_id").combine_chunks(), _norms(lengths, documents, max(1, total))))
            pairs += len(pair)
            if pairs >= SHARD_PAIRS:
                yield from close()
                made, held, pairs = made + 1, [], 0
                release_memory()
        if held:
            yield from close()

    return Index(stored(rows.mapInArrow(read, POSTINGS), "postings"), documents, total)


def _blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    """Lists of (item_id, terms with their occurrences), each list bounded."""
    held, size = [], 0
    for row in queries.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        words, _, _ = cut_words(whole(pa.array([row["text"]], pa.string())), KINDS)
        own = Counter(words.to_pylist())
        if held and (len(held) >= QUERIES or size + len(own) > QUERY_TERMS):
            yield held
            held, size = [], 0
        held.append((row["item_id"], own))
        size += len(own)
    if held:
        yield held


def _searched(index: Index, block: list[tuple], k: int, kind: str) -> DataFrame:
    spark = index.table.sparkSession
    asked = sorted(set().union(*(own for _, own in block)))
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in asked], "_asked string"))
    lists = index.table.where("term is not null").join(wanted, F.col("term") == F.col("_asked")).drop("_asked")
    weights = {r["term"]: weight(index.documents, r["df"]) for r in lists.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    shared = spark.sparkContext.broadcast([(q, {t: weights[t] * n for t, n in own.items() if weights.get(t, 0) > 0}) for q, (_, own) in enumerate(block)])

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        docs = rows[rows["term"].isna()].iloc[0]
        ids, known, m = np.frombuffer(docs["ids"], "<i8"), np.frombuffer(docs["known"], np.uint8).astype(bool), np.frombuffer(docs["data"], "<i8")
        own = Searcher({r.term: Postings(r) for r in rows[rows["term"].notna()].itertuples()}, m)
        found = {"query": [], "doc_id": [], "score": []}
        for q, terms in shared.value:
            at, score = own.best(terms, k)
            order = np.lexsort((ids[at], ~known[at], -score))[:k]
            found["query"] += [q] * len(order)
            found["doc_id"] += [int(ids[x]) if known[x] else None for x in at[order]]
            found["score"] += score[order].tolist()
        return pd.DataFrame({"query": pd.array(found["query"], "Int64"), "doc_id": pd.array(found["doc_id"], "Int64"), "score": pd.array(found["score"], "Int64")})

    best = lists.unionByName(index.table.where("term is null")).groupBy("shard").applyInPandas(search, "query long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    names = F.broadcast(spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], f"query long, item_id {kind}"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).join(names, "query").select("item_id", "rank", "doc_id", "score")


def search(index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 for each row of ``queries``.

    ``queries`` (item_id, text; other columns aren't read) are taken in blocks of bounded size. Equal scores rank by doc_id,
    null doc_ids last. Null and empty queries, and ones whose terms no document holds, give no rows; rows that share an
    item_id are queries of their own. An empty index or no queries give no rows.
    """
    kind = queries.schema["item_id"].dataType.simpleString()
    out = index.table.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in _blocks(queries) if index.documents else ():
        out = out.unionByName(stored(_searched(index, block, k, kind), "search-results"))
    return out
