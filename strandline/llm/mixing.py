"""Mixing sources to target weights by systematic sampling.

Every source has a target of words to take. A document's expected copies are its source's target over its source's size; within
a source, in order of size, their prefix sum starts at one random offset and a document is emitted once for each integer that
its share crosses. In order of size the words taken differ from the target by no more than about the source's largest document.

Prefix sums run in two phases over ranges of (source, size, doc_id), so a source that holds most rows fills no task. Shares are
ratios of whole numbers, so no copy is lost or gained by rounding.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import stored, sums_before

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST = (5, 2, 1), 3


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, the number of words of its whole text (null: 0); a column of that name is replaced."""
    return docs.drop("size").withColumn("size", F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source of ``sizes`` (source, source_size): source_size, target (double) and the exact share num / den of a copy that
    each of its documents is due.

    Sources in code-point order, null last, have ``weights`` in turn and share all words by them; a target stops at ``most``
    times its source's size and the excess is shared anew. Sources are poured full in order of size over weight: a source is
    full if its limit is no more than its part of what fuller sources leave. Empty sources have target 0.
    """
    unit = lcm(*weights)
    ranked = sums_before(sizes.withColumn("_one", F.lit(1)), [], [F.col("source").asc_nulls_last()], {"_rank": "_one"})
    each = F.array(*[F.lit(w).cast("long") for w in weights])
    weighed = ranked.withColumn("_weight", F.get(each, F.pmod("_rank", F.lit(len(weights))).cast("int"))).withColumn("_limit", F.lit(most) * F.col("source_size"))
    weighed = weighed.withColumn("_fills", F.expr(f"source_size * ({unit} div _weight)"))
    poured = sums_before(weighed, [], [F.col("_fills"), F.col("_rank")], {"_limits": "_limit", "_weights": "_weight"})
    words, total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], weighed.agg(F.coalesce(F.sum("_weight"), F.lit(0))).first()[0]
    wide = "decimal(19,0)"
    is_full = F.col("_limit").cast(wide) * (F.lit(total) - F.col("_weights")).cast(wide) <= F.col("_weight").cast(wide) * (F.lit(words) - F.col("_limits")).cast(wide)
    poured = stored(poured.withColumn("_full", is_full), "mix-sources")
    rest = poured.where("not _full").agg(F.sum("_weight")).first()[0] or 0
    left = words - (poured.where("_full").agg(F.sum("_limit")).first()[0] or 0)
    full = F.col("_full")
    return poured.select(
        "source", "source_size",
        F.when(full, F.col("_limit").cast("double")).otherwise(F.lit(float(left)) * F.col("_weight") / F.lit(rest)).alias("target"),
        F.when(full, F.lit(most)).otherwise(F.lit(left) * F.col("_weight")).cast("decimal(20,0)").alias("num"),
        F.when(full, F.lit(1)).otherwise(F.lit(rest) * F.col("source_size")).cast("decimal(20,0)").alias("den"),
    )


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """Every row of ``docs`` (doc_id, source, size and any others) with source_size, target, copies and taken (words).

    ``size`` is what ``measured`` adds; a null size counts as 0. Copies are 0 to ``most``. A null source is a source of its own,
    the last. Documents without words may have copies and take none. Null doc_ids come first within a size; rows that share
    doc_id, source and size keep the order in which the table is read. The same table, weights and seed give the same
    copies. Columns that this adds are replaced if ``docs`` has them. An empty table gives no rows.
    """
    docs = docs.drop("source_size", "target", "copies", "taken").withColumn("size", F.coalesce(F.col("size").cast("long"), F.lit(0)))
    docs = stored(docs.withColumn("source", F.col("source").cast("string")).withColumn("_one", F.lit(1)).withColumn("_tie", F.monotonically_increasing_id()), "mix-docs")
    shares = stored(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-targets")
    ranked = sums_before(docs, ["source"], [F.col("size"), F.col("doc_id"), F.col("_tie")], {"_k": "_one"})
    # the offset of a source: its share of 2^32, drawn by a hash of seed and source
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))), 1, 8), 16, 10)
    shares = shares.select(F.col("source").alias("_source"), "source_size", "target", "num", "den", drawn.cast("decimal(10,0)").alias("_drawn"))
    shares = shares.withColumn("_offset", F.expr("cast((_drawn * den) div 4294967296 as decimal(20,0))"))
    met = ranked.join(shares, F.col("source").eqNullSafe(F.col("_source")))
    copies = F.expr("case when source_size > 0 then (num * cast(_k + 1 as decimal(18,0)) + _offset) div den - (num * cast(_k as decimal(18,0)) + _offset) div den else 0 end")
    found = met.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return found.select(*[c for c in docs.columns if c not in ("_one", "_tie")], "source_size", "target", "copies", "taken")


def emitted(mix: DataFrame) -> DataFrame:
    """The mixture itself: each row of ``mix`` once for each of its copies, numbered from 0 in ``copy``."""
    return mix.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
