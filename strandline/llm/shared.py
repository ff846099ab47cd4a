"""Helpers that several corpus operators use: stored tables, skew-safe lookups, numpy utilities."""

from __future__ import annotations

import ctypes
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.sources.sinks import stored

__all__ = ["added_to", "local_roots", "lookup", "release_memory", "sized", "small_batches", "spans", "stored", "sums_before"]

#: Documents a Python worker sees at once; bounds a worker's memory when texts are long.
ROWS_PER_BATCH = 500

#: A key is heavy when it holds over 1/HEAVY_SHARE of the rows, so there are at most HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1000


def added_to(schema: StructType) -> StructType:
    """A copy of a table's schema that fields may be added to."""
    return StructType(list(schema.fields))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small unless the session already asks for smaller ones.

    The setting is read when a plan runs, which may be long after it was made, so it stays set for the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


#: The C library's call that gives freed memory back, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker that lives on must not keep its peak."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def lookup(left: DataFrame, right: DataFrame, key: str, rows_of: str, total: int) -> DataFrame:
    """Left join on a key that is unique in ``right``; ``rows_of`` there counts the key's rows in ``left``.

    Heavy keys (over 1/HEAVY_SHARE of ``total`` rows, so at most HEAVY_SHARE of them) are broadcast; the others
    meet in a shuffle join, where none can fill a task. Null keys match nothing.
    """
    heavy_from = max(1, total // HEAVY_SHARE)
    values = [c for c in right.columns if c not in (key, rows_of)]
    heavy = right.where(F.col(rows_of) > heavy_from).select(F.col(key).alias("_hk"), F.struct(*values).alias("_hv"))
    light = right.where(F.col(rows_of) <= heavy_from).select(F.col(key).alias("_lk"), F.struct(*values).alias("_lv"))
    marked = left.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left")
    first = marked.where(F.col("_hk").isNotNull()).select(*left.columns, *[F.col(f"_hv.{c}").alias(c) for c in values])
    rest = marked.where(F.col("_hk").isNull()).select(*left.columns)
    second = rest.join(light, F.col(key) == F.col("_lk"), "left").select(
        *left.columns, *[F.col(f"_lv.{c}").alias(c) for c in values]
    )
    return first.unionByName(second)


def sized(frame: DataFrame, most_rows: int) -> DataFrame:
    """``frame``, broadcast if its rows, counted here, are few enough; else as it is, for a shuffle join."""
    return F.broadcast(frame) if frame.limit(most_rows + 1).count() <= most_rows else frame


def sums_before(frame: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """``frame`` with, for each new column of ``sums``, the sum of its source column over the rows of the same group that come
    before in ``order``.

    Rows are dealt over ranges of (group, order), so a large group fills no task; sums run within a range, and ranges start
    where the earlier ones of their group end. Rows that tie in ``order`` come in any order. Null groups are a group.
    """
    ranges = stored(frame.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by or [F.lit(0)]).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy(F.col("_range").alias("_r"), *by).agg(*[F.sum(c).alias(f"_sum_{k}") for k, c in enumerate(sums.values())])
    starts = totals.select("_r", *[F.col(c).alias(f"_by_{c}") for c in by], *[F.coalesce(F.sum(f"_sum_{k}").over(earlier), F.lit(0)).alias(f"_from_{k}") for k in range(len(sums))])
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    local = ranges.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"_own_{k}") for k, c in enumerate(sums.values())])
    met = local.join(sized(stored(starts, "range-starts"), 100_000), same)
    return met.select(*frame.columns, *[(F.col(f"_from_{k}") + F.col(f"_own_{k}")).alias(name) for k, name in enumerate(sums)])


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of every span, one after another."""
    lengths = np.asarray(lengths, dtype=np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    out += np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths)
    return out


def local_roots(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a-b (continuing from ``parent``)."""
    parent = np.arange(n, dtype=np.int64) if parent is None else parent
    while True:
        pa, pb = parent[a], parent[b]
        if not len(pa) or np.array_equal(pa, pb):
            return parent
        low, high = np.minimum(pa, pb), np.maximum(pa, pb)
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
