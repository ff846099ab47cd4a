"""Quality rules: exact rule statistics of each text, judged by an isolation forest.

The forest is grown on all documents that pass the fixed rules: each goes to at least one tree, and random splits isolate odd
documents on short paths. A level of all trees is one aggregation, of which the driver gets a row for each node. All labelled
rows set the path length below which a document is dropped, counted by steps of the path length. Statistics and verdicts are
taken for every document from whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import words as W
from strandline.llm.packing import gathered
from strandline.llm.shared import added_to, small_batches, stored

#: Trees of a forest, documents that each takes at least where there are as many, and levels of splits.
TREES, TREE_SAMPLE, DEPTH, SEED = 128, 256, 8, 7

#: Path lengths are whole numbers of 1/STEPS, so that counts of each length are a bounded table.
STEPS = 1024

#: Share of labelled good documents that the threshold may drop.
FALSE_DROPS = 0.005

#: Bytes of text that a worker holds as arrays at once, about.
BATCH_BYTES = 2 << 20

SYMBOLS = b"#*$%&|<>"

FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "line_words", "digits", "marks", "distinct_words")

#: One forest, with a threshold of its own, for each group of related rules: oddities of one kind don't hide another's.
GROUPS = {"symbols": (0, 1, 7), "repetition": (2, 3), "layout": (4, 5, 6)}


def repeated_words(word: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per text: words that lie in a 3-word window which the text holds twice or more."""
    if len(word) < 3:
        return np.zeros(n, np.int64)
    a, b, c, own = word[:-2], word[1:-1], word[2:], owner[:-2]
    inside = own == owner[2:]
    u = np.uint64
    mixed = (a.astype(u) * u(0x9E3779B97F4A7C15)) ^ (b.astype(u) * u(0xC2B2AE3D27D4EB4F) + u(1)) ^ ((c.astype(u) + u(7)) * u(0x165667B19E3779F9)) ^ (own.astype(u) * u(0xD6E8FEB86659FD93))
    mixed ^= mixed >> u(31)
    at = np.flatnonzero(inside)
    order = at[np.argsort(mixed[at], kind="stable")]
    key = mixed[order]
    alike = np.flatnonzero(key[1:] == key[:-1])
    if not len(alike):
        return np.zeros(n, np.int64)
    p, q = order[alike], order[alike + 1]
    if (a[p] == a[q]).all() and (b[p] == b[q]).all() and (c[p] == c[q]).all() and (own[p] == own[q]).all():
        twice = np.union1d(p, q)
    else:  # different windows met in one number: compare the windows themselves
        rows = np.stack([own[at], a[at], b[at], c[at]], axis=1)
        _, group, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        twice = at[count[group.ravel()] > 1]
    covered = np.zeros(len(word), bool)
    for k in range(3):
        covered[twice + k] = True
    return W.per_text(owner[covered], n)


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Rule statistics of each text (null: no words)."""
    texts = W.whole(texts)
    n = len(texts)
    flat, owner = W.split_words(texts)
    word, _ = W.codes(flat)
    lines, line_owner = W.split_lines(texts)
    worded = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    line, n_lines = W.codes(lines)
    first_lines = np.unique(line_owner[worded].astype(np.int64) * max(n_lines, 1) + line[worded]) // max(n_lines, 1)
    lines_worded = W.per_text(line_owner[worded], n)
    kinds = np.unique(owner.astype(np.int64) * (int(word.max()) + 1) + word) // (int(word.max()) + 1) if len(word) else np.zeros(0, np.int64)
    return {
        "n_words": W.per_text(owner, n),
        "word_chars": W.per_text(owner, n, pc.utf8_length(flat).to_numpy(zero_copy_only=False)),
        "n_symbols": W.bytes_in(texts, SYMBOLS),
        "n_dup_lines": lines_worded - W.per_text(first_lines, n),
        "n_repeat_words": repeated_words(word, owner, n),
        "n_lines": lines_worded,
        "n_digits": W.bytes_in(texts, b"0123456789"),
        "n_marks": W.bytes_in(texts, b".,;:!?"),
        "n_distinct": W.per_text(kinds, n),
    }


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    n = np.maximum(s["n_words"], 1)
    columns = (
        s["word_chars"] / n, s["n_symbols"] / n, s["n_dup_lines"] / np.maximum(s["n_lines"], 1), s["n_repeat_words"] / n,
        np.log1p(n / np.maximum(s["n_lines"], 1)), s["n_digits"] / n, s["n_marks"] / n, np.log(s["n_distinct"] + 1.0) / np.log(n + 1.0),
    )
    return np.stack(columns, axis=1)


def path_constant(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary search tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2.0 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2.0 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Isolation trees as arrays (tree x node): a node's children are 2k+1 and 2k+2; feature -1 marks a leaf."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    #: Documents whose mean path is shorter are dropped.
    threshold: float = 0.0
    columns: tuple[int, ...] = tuple(range(len(FEATURES)))

    def reached(self, x: np.ndarray, tree: np.ndarray, levels: int = DEPTH) -> np.ndarray:
        """The node of ``tree`` that each row gets to in so many levels; ``x`` has the forest's columns alone."""
        rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(levels):
            f = self.feature[tree, node]
            node = np.where(f >= 0, 2 * node + 1 + (x[rows, np.maximum(f, 0)] >= self.split[tree, node]), node)
        return node

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row, in steps of 1/STEPS."""
        x = x[:, list(self.columns)]
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            total += self.path[t, self.reached(x, t)]
        return np.rint(total / len(self.feature) * STEPS) / STEPS


def bare(columns: tuple[int, ...] = tuple(range(len(FEATURES))), trees: int = TREES) -> Forest:
    """A forest without splits."""
    nodes = 2 ** (DEPTH + 1) - 1
    return Forest(np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes)), columns=columns)


def shares(n: int, trees: int = TREES) -> int:
    """In how many trees each of n rows is, so that none has much under TREE_SAMPLE rows while there are as many."""
    return max(1, min(trees, -(-trees * TREE_SAMPLE // max(n, 1))))


@dataclass
class Tally:
    """Rows of each node on one level of a forest (tree by tree), and the least and greatest value of each column there."""

    n: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of_none(cls, forest: Forest, level: int) -> Tally:
        cells = len(forest.feature) << level
        return cls(np.zeros(cells, np.int64), np.full((cells, len(forest.columns)), np.inf), np.full((cells, len(forest.columns)), -np.inf))

    def add(self, forest: Forest, level: int, x: np.ndarray, drawn: np.ndarray, share: int) -> None:
        """Count rows in the ``share`` trees that the numbers ``drawn`` choose for each."""
        x = x[:, list(forest.columns)]
        trees = len(forest.feature)
        step = (drawn // np.uint64(trees) % np.uint64(trees)).astype(np.int64) | 1  # odd, so no tree twice while trees are a power of two
        for k in range(share):
            tree = ((drawn % np.uint64(trees)).astype(np.int64) + k * step) % trees
            node = forest.reached(x, tree, level) - ((1 << level) - 1)
            own = np.flatnonzero(node >= 0)  # others ended in a leaf above
            cell = (tree[own] << level) + node[own]
            np.add.at(self.n, cell, 1)
            np.minimum.at(self.low, cell, x[own])
            np.maximum.at(self.high, cell, x[own])


def split_level(forest: Forest, level: int, tally: Tally, seed: int = SEED) -> None:
    """Path lengths of a level's nodes, and a random split of each that has different rows, among the columns that differ."""
    trees, width = len(forest.feature), 1 << level
    at = slice(width - 1, 2 * width - 1)
    forest.path[:, at] = (level + path_constant(tally.n)).reshape(trees, width)
    if level == DEPTH:
        return
    chosen, place = np.random.default_rng([seed, level, *forest.columns]).random((2, trees * width))
    differs = np.cumsum(tally.high > tally.low, axis=1)
    f = (differs <= (chosen * differs[:, -1]).astype(np.int64)[:, None]).sum(axis=1)
    splits = differs[:, -1] > 0
    cells, f = np.flatnonzero(splits), f[splits]
    low, high = tally.low[cells, f], tally.high[cells, f]
    feature, split = np.full(trees * width, -1), np.zeros(trees * width)
    feature[cells], split[cells] = f, low + place[cells] * (high - low)
    forest.feature[:, at], forest.split[:, at] = feature.reshape(trees, width), split.reshape(trees, width)


def grow(x: np.ndarray, columns: tuple[int, ...] = tuple(range(len(FEATURES))), trees: int = TREES, seed: int = SEED) -> Forest:
    """An isolation forest over random splits of the rows of ``x``, each of which is in at least one tree."""
    forest = bare(columns, trees)
    drawn = np.random.default_rng(seed).integers(0, 1 << 63, len(x)).astype(np.uint64)
    for level in range(DEPTH + 1):
        tally = Tally.of_none(forest, level)
        tally.add(forest, level, x, drawn, shares(len(x), trees))
        split_level(forest, level, tally, seed)
    return forest


def with_threshold(forest: Forest, paths: np.ndarray, good: np.ndarray, bad: np.ndarray) -> Forest:
    """``calibrated`` from the numbers of good and bad rows of each path length (ascending)."""
    n_good, n_bad = good.sum(), bad.sum()
    if not n_good or not n_bad:
        return forest
    rank = FALSE_DROPS * (n_good - 1)
    near, far = (paths[np.searchsorted(np.cumsum(good), r, "right")] for r in (np.floor(rank), np.ceil(rank)))
    allowed = near + (far - near) * (rank - np.floor(rank))
    cuts = np.unique(np.append(paths[paths <= allowed], allowed))
    under = np.searchsorted(paths, cuts)
    gain = np.append(0, np.cumsum(bad))[under] / n_bad - np.append(0, np.cumsum(good))[under] / n_good
    best = int(np.argmax(gain))
    forest.threshold = float(cuts[best]) if gain[best] > FALSE_DROPS else 0.0
    return forest


def calibrated(forest: Forest, x: np.ndarray, good: np.ndarray) -> Forest:
    """The threshold that best tells labelled bad rows from good ones while at most FALSE_DROPS of the good ones go.

    A forest whose short paths hold no larger share of the bad than of the good rows drops nothing.
    """
    paths, at = np.unique(forest.paths(x), return_inverse=True)
    return with_threshold(forest, paths, *(np.bincount(at[own], minlength=len(paths)) for own in (good, ~good)))


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _features_of(docs: DataFrame) -> DataFrame:
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, BATCH_BYTES):
            s = statistics(table.column("text"))
            x = features(s)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(base_failed(s)), lists], ["doc_id", "failed", "x"])

    return docs.mapInArrow(take, "doc_id long, failed boolean, x array<double>")


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))


def _tallied(rows: DataFrame, forests: list[Forest], level: int, share: int) -> list[Tally]:
    """What each forest's nodes of a level hold of all ``rows``. Nodes are bounded, so a task and the driver hold a table of them."""
    shared = rows.sparkSession.sparkContext.broadcast(forests)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = [Tally.of_none(f, level) for f in shared.value]
        for batch in batches:
            for forest, tally in zip(shared.value, tallies, strict=True):
                tally.add(forest, level, _rows(batch), batch.column("drawn").to_numpy().view(np.uint64), share)
        for k, tally in enumerate(tallies):
            cells = np.flatnonzero(tally.n)
            for c in range(tally.low.shape[1]):
                values = [np.full(len(cells), k), cells, np.full(len(cells), c), tally.n[cells], tally.low[cells, c], tally.high[cells, c]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["forest", "cell", "c", "n", "low", "high"])

    parts = rows.select("x", F.xxhash64("doc_id").alias("drawn")).mapInArrow(count, "forest long, cell long, c long, n long, low double, high double")
    found = parts.groupBy("forest", "cell", "c").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    own, cell, c, n, low, high = (found.column(k).to_numpy() for k in ("forest", "cell", "c", "n", "low", "high"))
    tallies = [Tally.of_none(f, level) for f in forests]
    for k, tally in enumerate(tallies):
        at = own == k
        tally.n[cell[at]], tally.low[cell[at], c[at]], tally.high[cell[at], c[at]] = n[at], low[at], high[at]
    shared.unpersist()
    return tallies


def _path_counts(rows: DataFrame, forests: list[Forest]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each forest the path lengths of labelled ``rows`` (x, good), ascending, and the numbers of good and bad rows of each."""
    shared = rows.sparkSession.sparkContext.broadcast(forests)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = _rows(batch), batch.column("good").to_numpy(zero_copy_only=False)
            for k, forest in enumerate(shared.value):
                paths, at = np.unique(forest.paths(x), return_inverse=True)
                columns = [np.full(len(paths), k), paths, *(np.bincount(at[own], minlength=len(paths)) for own in (good, ~good))]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["forest", "path", "good", "bad"])

    found = rows.select("x", "good").mapInArrow(count, "forest long, path double, good long, bad long").groupBy("forest", "path")
    found = found.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toPandas().sort_values("path")  # at most STEPS to a path's unit
    shared.unpersist()
    return [tuple(found.loc[found["forest"] == k, c].to_numpy() for c in ("path", "good", "bad")) for k in range(len(forests))]


def fit(docs: DataFrame, labels: DataFrame) -> list[Forest]:
    """Grow the forests on all documents that pass the fixed rules and calibrate them on all labelled ones among these.

    Null doc_ids and null labels are not learnt from; rows that share a doc_id count once, as do repeated labels of one
    value. Without labelled rows of both kinds the method drops nothing.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).where("doc_id is not null")
    rows = _features_of(docs).groupBy("doc_id").agg(F.min(F.struct("failed", "x")).alias("first")).where("not first.failed")
    rows = stored(rows.select("doc_id", "first.x"), "quality-features")
    n = rows.count()
    if not n:
        return []
    forests = [bare(columns) for columns in GROUPS.values()]
    for level in range(DEPTH + 1):
        for forest, tally in zip(forests, _tallied(rows, forests, level, shares(n)), strict=True):
            split_level(forest, level, tally)
    known = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality").cast("int") > 0).alias("good")).distinct()
    counts = _path_counts(rows.join(known, "doc_id"), forests)
    return [with_threshold(forest, *own) for forest, own in zip(forests, counts, strict=True)]


def margin(forests: list[Forest], x: np.ndarray) -> np.ndarray:
    """How much longer each row's path is than the threshold, in the forest that finds it oddest; below 0: dropped."""
    return np.min([f.paths(x) - f.threshold for f in forests], axis=0) if forests else np.zeros(len(x))


def judged(docs: DataFrame, forests: list[Forest]) -> DataFrame:
    """All columns of ``docs`` with the rule statistics, base_failed, path (the ``margin``) and kept.

    A null or empty text has no words and fails the base rules. Columns of ``docs`` of those names are replaced. Every row
    is judged by its own text, so repeated rows get the same verdict. A very long text is read whole, by one task. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    added = [*STATS, "base_failed", "path", "kept"]
    docs = docs.drop(*[c for c in docs.columns if c in added])
    shared = spark.sparkContext.broadcast(forests)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, BATCH_BYTES):
            s = statistics(table.column("text"))
            failed = base_failed(s)
            path = margin(shared.value, features(s))
            kept = ~failed & (path >= 0)
            new = [*(pa.array(s[c]) for c in STATS), pa.array(failed), pa.array(path), pa.array(kept)]
            for c, column in zip(added, new, strict=True):
                table = table.append_column(c, column)
            yield from table.combine_chunks().to_batches()

    schema = added_to(docs.schema)
    for c in added:
        schema = schema.add(c, "long" if c in STATS else "double" if c == "path" else "boolean")
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(judge, schema)
