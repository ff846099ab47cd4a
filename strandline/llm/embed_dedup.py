"""Embedding near-dedup by NN-descent.

Equal vectors of a label are made one representative first. A group is the vectors of one label and size. A first neighbour
graph comes from leaves of random hyperplanes (several codes for each vector, as many bits as the group needs; a group that
fits a leaf is one); leaves that grow too large are split by hyperplanes through their own middle, and what can't be split is
compared in pairs of chunks. The graph is refined by joins of neighbours with
neighbours' neighbours until the lists settle: around every vector its neighbours, in both directions, are compared with one
another. Lists keep the LIST nearest of those at least EXPLORE alike; no link is lost to that limit, because a list full of
links is enlarged to its whole component (and so need not settle): members of a component are compared with one another in
blocks, in double precision, and only counts leave the blocks. An audit compares a share of the vectors of each group that isn't one leaf with
the whole group, and a larger share while too few of them have links to tell; it scores every vector alike. While a group
falls short of TARGET, another round of hyperplanes and refinement is added to its graph. A group that still falls short
after ROUNDS is compared whole, the exact way after a failed audit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.components import components
from strandline.llm.shared import local_roots, lookup, sized, stored

#: Codes for each vector and round; vectors of a leaf about and at most; passes that may split a leaf.
CODES, LEAF, LARGEST, SPLITS = 8, 64, 384, 3

#: Refinements of a round at most, and the share of new entries, in lists that aren't full of links, at which they end.
REFINEMENTS, SETTLED = 8, 0.01

#: Neighbours kept for each vector and refinement, and how alike a stepping stone must be.
LIST, EXPLORE = 12, 0.75

#: Members of a block when a component's members are compared, at most and at least, and blocks that a component is dealt
#: over before its blocks grow.
BLOCK, SMALL, SPREAD = 1024, 128, 16

#: Audited vectors of a group: at least AUDIT, else one in the first of SHARES, and one in the next while fewer than LEAST of
#: them have links (at most LIST each).
AUDIT, SHARES, LEAST = 200, (50, 12, 3, 1), 20

#: Recall that an audit asks for, and the rounds before a group is compared whole.
TARGET, ROUNDS = 0.97, 4

#: MB of audited vectors that are broadcast at once.
SENT = 32

EDGES = "u long, v long, cosine double"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, key): key is the label with the vector as doubles, null for rows that can't link."""
    usable = F.expr(
        "label is not null and embedding is not null and vec_id is not null and size(embedding) > 0 and "
        "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"
    )
    return vectors.select("vec_id", F.when(usable, F.struct("label", F.expr("transform(embedding, x -> double(x))").alias("raw"))).alias("key"))


def representatives(vectors: DataFrame) -> DataFrame:
    """(key, rep, group, size, unit, copies): one row for each different usable vector of a label, scaled to length one."""
    rows = _keyed(vectors).where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumns({"label": F.col("key.label"), "raw": F.col("key.raw")})
    scaled = rows.withColumn("top", F.expr("array_max(transform(raw, x -> abs(x)))")).withColumn("raw", F.expr("transform(raw, x -> x / top)"))
    length = F.expr("sqrt(aggregate(raw, double(0), (s, x) -> s + x * x))")
    return scaled.withColumn("_l", length).select("key", "rep", F.concat_ws(":", "label", F.size("raw")).alias("group"), F.size("raw").alias("size"), F.expr("transform(raw, x -> x / _l)").alias("unit"), "copies")


def _grouped(rows: DataFrame, key: str, work: Callable[[pa.Table], list[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``work`` to the rows of each key and group; a key's rows must be few. Keys are hashes, so groups may share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            keys, own = table.column(key).to_numpy(), table.column("group").combine_chunks().dictionary_encode().indices.to_numpy()
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])]).tolist()
            stops = [*edges[1:], len(keys)] if last else edges[1:]
            out = [b for a, z in zip(edges, stops, strict=False) for b in work(table.slice(a, z - a))]
            return out, table.slice(stops[-1] if stops else 0)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= 4 * BLOCK:
                    out, rest = groups(pa.Table.from_batches(held).combine_chunks(), False)
                    yield from out
                    held = rest.to_batches()
        if held:
            yield from groups(pa.Table.from_batches(held).combine_chunks(), True)[0]

    return rows.repartition(key).sortWithinPartitions(key, "group").mapInArrow(run, schema)


def _nearest(ids: np.ndarray, units: np.ndarray, threshold: float) -> pa.RecordBatch:
    """Each vector's LIST nearest of the others from EXPLORE on, and one link for each vector joined by links to a lower row."""
    n = len(ids)
    cosine = units @ units.T
    np.fill_diagonal(cosine, -2.0)
    k = min(LIST, n - 1)
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(-cosine, axis=1)[:, :k]
    u, v = np.repeat(np.arange(n), k), near.ravel()
    c = cosine[u, v]
    good = c >= min(EXPLORE, threshold)
    a, b = np.nonzero(np.triu(cosine >= threshold, 1))
    root = local_roots(n, a, b)
    moved = np.flatnonzero(root != np.arange(n))
    u, v, c = np.concatenate([u[good], moved]), np.concatenate([v[good], root[moved]]), np.concatenate([c[good], np.full(len(moved), np.nan)])
    return pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v]), pa.array(c)], ["u", "v", "cosine"])


def _near(table: pa.Table, threshold: float) -> list[pa.RecordBatch]:
    return [_nearest(table.column("rep").to_numpy(), _matrix(table.column("unit").combine_chunks()), threshold)] if table.num_rows > 1 else []


def _bits(n: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.log2(n / LEAF))).cast("int")


def _projected(directions: Callable[[int, int], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``at``: each unit vector's product with the directions of its code and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, codes = pa.compute.list_value_length(batch.column("unit")).to_numpy(zero_copy_only=False), batch.column("k").to_numpy()
            for size, k in sorted(set(zip(sizes.tolist(), codes.tolist(), strict=True))):
                own = batch.filter(pa.array((sizes == size) & (codes == k)))
                at = _matrix(own.column("unit")) @ directions(k, size)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(list(at), pa.list_(pa.float64()))], [*own.schema.names, "at"])

    return run


def _taken_apart(rows: DataFrame, keys: DataFrame, seed: int) -> DataFrame:
    """(leaf, group, rep, unit): ``rows`` (leaf, k, group, rep, unit) with every leaf of over LARGEST rows in smaller ones.

    A large leaf is split by hyperplanes through the middle of its own vectors, other ones for each code k. What SPLITS
    passes leave too large is dealt over chunks, and every pair of chunks is a leaf. ``keys`` has the leaf of each row.
    """
    large = stored(keys.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGEST), "large-leaves")
    done = []
    for depth in range(SPLITS):
        most = large.agg(F.max("n")).first()[0]
        if not most:
            break
        held = sized(large, 200_000)
        done.append(rows.join(held, "leaf", "left_anti").select("leaf", "group", "rep", "unit"))
        rest, bits = rows.join(held, "leaf").select("leaf", "k", "group", "rep", "unit", "n"), max(1, int(np.ceil(np.log2(most / LEAF))))
        at = _projected(lambda k, size, depth=depth, bits=bits: np.random.default_rng([seed, 7, depth, k, size]).normal(size=(size, bits)))
        placed = stored(rest.mapInArrow(at, "leaf long, k int, group string, rep long, unit array<double>, n long, at array<double>"), "large-leaf-rows")
        middles = stored(placed.groupBy("leaf").agg(F.array(*[F.avg(F.col("at")[i]) for i in range(bits)]).alias("middle")), "leaf-middles")
        met = placed.join(sized(middles, 200_000), "leaf").withColumn("wanted", F.greatest(F.lit(1), _bits(F.col("n"))))
        sides = F.expr("transform(slice(at, 1, wanted), (x, i) -> x > middle[i])")
        rows = stored(met.select(F.xxhash64("leaf", sides).alias("leaf"), "k", "group", "rep", "unit"), "split-leaves")
        large = stored(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGEST), "large-leaves")
    rows = rows.join(sized(large, 200_000), "leaf", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    done.append(_paired(rows, "leaf", LARGEST // 2).select(F.col("pair").alias("leaf"), "group", "rep", "unit"))
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return out


def _paired(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``rows`` once for each pair of chunks they are in: a key's ``n`` rows are dealt over chunks of about ``most`` rows."""
    dealt = rows.withColumn("_chunks", F.when(F.col("n") > 2 * most, F.ceil(F.col("n") / most)).otherwise(F.lit(1)))
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("rep"), F.col("_chunks"))).withColumn("other", F.explode(F.expr("sequence(0L, _chunks - 1L)")))
    return dealt.withColumn("pair", F.xxhash64(key, F.least("b", "other"), F.greatest("b", "other")))


def _compared(rows: DataFrame, threshold: float) -> DataFrame:
    """Edges, as proven paths, that join what the links of whole groups join; ``rows`` has group, n, rep and unit."""
    pairs = _paired(rows, "group", BLOCK).select("group", "rep", "unit", "pair", (F.col("b") <= F.col("other")).alias("left"), (F.col("b") == F.col("other")).alias("own"))

    def compare(table: pa.Table) -> list[pa.RecordBatch]:
        ids, x = table.column("rep").to_numpy(), _matrix(table.column("unit").combine_chunks())
        if np.asarray(table.column("own")).all():
            a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        else:
            left = np.asarray(table.column("left"))
            at, to = np.flatnonzero(left), np.flatnonzero(~left)
            a, b = np.nonzero(x[at] @ x[to].T >= threshold)
            a, b = at[a], to[b]
        root = local_roots(len(ids), a, b)
        moved = np.flatnonzero(root != np.arange(len(ids)))
        return [pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]]), pa.array(np.full(len(moved), np.nan))], ["u", "v", "cosine"])]

    return _grouped(pairs, "pair", compare, EDGES)


def _leaves(rows: DataFrame, seed: int, threshold: float) -> DataFrame:
    """Edges within the leaves of CODES random codes; a vector's code has as many bits as its group needs, one code if none."""
    bits = max(1, rows.agg(F.max(_bits(F.col("n")))).first()[0] or 0)
    copies = rows.select("group", "n", "rep", "unit", F.explode(F.sequence(F.lit(0), F.when(_bits(F.col("n")) > 0, CODES - 1).otherwise(0))).alias("k"))
    at = _projected(lambda k, size: np.random.default_rng([seed, k, size]).normal(size=(size, bits)))
    coded = copies.mapInArrow(at, "group string, n long, rep long, unit array<double>, k int, at array<double>")
    sides = F.transform(F.slice("at", F.lit(1), _bits(F.col("n"))), lambda x: x > 0)
    coded = coded.select(F.xxhash64("group", "k", sides).alias("leaf"), "k", "group", "rep", "unit")
    return _grouped(_taken_apart(coded, coded, seed), "leaf", lambda table: _near(table, threshold), EDGES)


def _lists(edges: DataFrame, threshold: float) -> DataFrame:
    """(u, v, full): each vector's LIST nearest known neighbours; full where all of LIST are links."""
    steps = edges.where("not isnan(cosine)")
    steps = steps.unionByName(steps.select(F.col("v").alias("u"), F.col("u").alias("v"), "cosine")).groupBy("u", "v").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("u").orderBy(F.desc("cosine"), "v")
    near = steps.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= LIST)
    links = F.count(F.when(F.col("cosine") >= threshold, 1)).over(Window.partitionBy("u"))
    return stored(near.select("u", "v", (links == LIST).alias("full")), "neighbour-lists")


def _refined(reps: DataFrame, lists: DataFrame, seed: int, threshold: float) -> DataFrame:
    """Edges found by comparing each vector's neighbours, in both directions, with one another."""
    lists = lists.select("u", "v")
    around = lists.unionByName(lists.select(F.col("v").alias("u"), F.col("u").alias("v"))).unionByName(lists.select("u", F.col("u").alias("v"))).distinct()
    places = stored(around.select(F.xxhash64("u").alias("leaf"), F.lit(0).alias("k"), F.col("v").alias("rep")), "neighbourhoods")
    uses = places.groupBy("rep").agg(F.count(F.lit(1)).alias("uses"))
    units = stored(reps.select("group", "rep", "unit").join(uses, "rep"), "used-vectors")
    met = lookup(places, units, "rep", "uses", places.count())
    return _grouped(_taken_apart(met, places, seed), "leaf", lambda table: _near(table, threshold), EDGES)


def _searched(rows: DataFrame, edges: DataFrame, seed: int, threshold: float) -> DataFrame:
    """``edges`` with those of another round of codes, refined until the lists settle.

    A list full of links need not settle: its vector's whole component is compared later, whichever links the list holds.
    """
    edges, before = edges.unionByName(stored(_leaves(rows, 2 * seed + 1, threshold), "leaf-edges")), None
    for k in range(REFINEMENTS):
        lists = _lists(edges.join(rows.select(F.col("rep").alias("u")), "u", "left_semi"), threshold)  # of the groups at hand
        if before is not None and lists.where("not full").join(before, ["u", "v"], "left_anti").count() <= SETTLED * lists.where("not full").count():
            break
        edges, before = edges.unionByName(stored(_refined(rows, lists, 100 * seed + k, threshold), "refined-edges")), lists
    return stored(edges.groupBy("u", "v").agg(F.max("cosine").alias("cosine")), "edges")  # NaN, a proven path, is largest


def _counted(reps: DataFrame, rooted: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, others): copies of other representatives of its component that each one is linked to, and how many those are.

    A component's members are dealt over blocks; every pair of blocks is compared once, and gives counts.
    """
    sizes = stored(rooted.groupBy("root").agg(F.count(F.lit(1)).alias("members")), "component-sizes")
    members = lookup(rooted, sizes.withColumn("m", F.col("members")), "root", "members", max(1, rooted.count()))
    blocks = F.least(F.ceil(F.col("m") / SMALL), F.greatest(F.lit(SPREAD), F.ceil(F.col("m") / BLOCK)))
    members = members.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = reps.select("rep", "unit", "copies").join(members, F.col("rep") == F.col("node"))
    pairs = placed.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1L)")))
    pairs = pairs.select(F.col("root").alias("group"), "rep", "unit", "copies", F.xxhash64("root", F.least("b", "other"), F.greatest("b", "other")).alias("pair"), F.col("b").cast("long"), (F.col("b") <= F.col("other")).alias("left"), (F.col("b") == F.col("other")).alias("own"))

    def compare(table: pa.Table) -> list[pa.RecordBatch]:
        ids, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        x, left, own = _matrix(table.column("unit").combine_chunks()), np.asarray(table.column("left")), np.asarray(table.column("own"))
        out = []
        if own.all():
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            out.append((ids, linked @ copies, linked.sum(axis=1)))
        else:
            linked = x[left] @ x[~left].T >= threshold
            out += [(ids[left], linked @ copies[~left], linked.sum(axis=1)), (ids[~left], copies[left] @ linked, linked.sum(axis=0))]
        return [pa.RecordBatch.from_arrays([pa.array(i), pa.array(n.astype(np.int64)), pa.array(m.astype(np.int64))], ["rep", "links", "others"]) for i, n, m in out]

    return _grouped(pairs, "pair", compare, "rep long, links long, others long").groupBy("rep").agg(F.sum("links").alias("links"), F.sum("others").alias("others"))


def audited(rows: DataFrame, threshold: float) -> DataFrame:
    """(group, rep, real): a share of each group's vectors with the number of others they link to, if any.

    The share is compared with all ``rows`` (group, n, rep, unit) of its group, in slices that are small enough to send. Groups
    in which fewer than LEAST of these have links are audited further, by the next of SHARES, in the end whole.
    """
    out, low = None, F.lit(0)
    for share in SHARES:
        high = F.greatest(F.lit(AUDIT), F.ceil(F.col("n") / share))
        place = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("n"))
        sample = stored(rows.where((place >= low) & (place < high)).select("group", "rep", "unit"), "audited")
        found = stored(_links_of(sample, rows, threshold), "audit")
        out = found if out is None else out.unionByName(found)
        if share == SHARES[-1]:
            break
        told = out.where(F.col("real") <= LIST).groupBy("group").count().where(F.col("count") >= LEAST).select("group")
        rows, low = stored(rows.where(F.col("n") > high).join(sized(stored(told, "told-groups"), 200_000), "group", "left_anti"), "untold-groups"), high
        if rows.isEmpty():
            break
    return stored(out, "audit")


def _links_of(sample: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    total = sample.agg(F.sum(F.size("unit")) * 8 / 1e6).first()[0] or 0.0
    slices, context, out = max(1, int(np.ceil(total / SENT))), rows.sparkSession.sparkContext, None
    for k in range(slices):
        part = sample.where(F.pmod(F.xxhash64("rep", F.lit(6)), F.lit(slices)) == k).toPandas()
        groups = {g: (x["rep"].to_numpy(), np.array(x["unit"].tolist(), float)) for g, x in part.groupby("group")}
        shared = context.broadcast(groups)

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = batch.column("group").dictionary_encode()
                group = codes.indices.to_numpy()
                for g, name in enumerate(codes.dictionary.to_pylist()):
                    if name in shared.value:
                        ids, units = shared.value[name]
                        own = batch.filter(pa.array(group == g))
                        other, real = own.column("rep").to_numpy(), np.zeros(len(ids), np.int64)
                        x = _matrix(own.column("unit"))
                        for a in range(0, len(ids), BLOCK):
                            linked = (units[a : a + BLOCK] @ x.T >= threshold) & (ids[a : a + BLOCK, None] != other[None, :])
                            real[a : a + BLOCK] = linked.sum(axis=1)
                        at = np.flatnonzero(real)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(ids[at]), pa.array(real[at])], ["group", "rep", "real"])

        found = rows.select("group", "rep", "unit").mapInArrow(compare, "group string, rep long, real long").groupBy("group", "rep").agg(F.sum("real").alias("real"))
        out = found if out is None else out.unionByName(found)
    return out


def _short(real: DataFrame, counts: DataFrame, target: float) -> tuple[DataFrame, float]:
    """The groups of an audit whose vectors with few links, or with many, have less than ``target`` of them on average; and
    the average over all."""
    scores = real.join(counts, "rep", "left").withColumn("score", F.coalesce(F.col("others") / F.col("real"), F.lit(0.0))).withColumn("few", F.col("real") <= LIST)
    scores = stored(scores.select("group", "few", "score"), "audit-scores")
    short = scores.groupBy("group", "few").agg(F.avg("score").alias("score")).where(F.col("score") < target).select("group").distinct()
    recall = scores.agg(F.avg("score")).first()[0]
    return stored(short, "short-groups"), 1.0 if recall is None else recall


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, target: float = TARGET) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept and audit_recall.

    Rows link when their labels are equal and their vectors have a cosine of at least ``threshold``. Vectors that are null,
    empty or zero, that hold null or non-finite components, or that have no label or vec_id link with nothing: they are
    their own component and kept. Vectors of different sizes never link. Equal vectors link with one another like any
    others. Rows that share a vec_id count as separate vectors. An empty table gives no rows. audit_recall is the average over
    audited vectors of the share of their links that was found; 1.0 also where no audited vector has a link.
    """
    spark, vectors = vectors.sparkSession, vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long"))
    reps = stored(representatives(vectors), "embedding-reps")
    groups = stored(reps.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "embedding-groups")
    grouped = stored(lookup(reps.select("group", "rep", "unit"), groups.withColumn("rows", F.col("n")), "group", "rows", max(1, reps.count())), "grouped-vectors")
    edges, open_, recall = spark.createDataFrame([], EDGES), groups.select("group"), 1.0
    real = audited(grouped.where(F.col("n") > LEAF), threshold)
    for round_ in range(ROUNDS + 1):
        rows = grouped.join(sized(open_, 200_000), "group", "left_semi")
        edges = edges.unionByName(stored(_compared(rows, threshold), "whole-groups")) if round_ == ROUNDS else _searched(rows, edges, round_, threshold)
        stars = components(edges.where((F.col("cosine") >= threshold) | F.isnan("cosine")).select("u", "v"))
        rooted = stored(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()), "embedding-components")
        counts = stored(_counted(reps, rooted, threshold), "embedding-links")
        open_, recall = _short(real, counts, target)
        if open_.isEmpty():
            break
    classes = reps.select("key", "rep", "copies").join(counts, "rep", "left").join(rooted, F.col("rep") == F.col("node"), "left")
    classes = classes.select("key", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    rows = stored(_keyed(vectors), "keyed-vectors")
    out = lookup(rows, stored(classes, "embedding-classes"), "key", "copies", rows.count())
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(recall).alias("audit_recall"),
    )
