"""Connected components of a graph held in a stored table of links.

Large-star and small-star steps take turns until the links form stars around the smallest node of each component. Nothing
about the graph reaches the driver but two numbers for each round. Nodes with very many links (at most HEAVY_SHARE of them)
are looked up by broadcast, so no join meets a hot node in one task; smallest neighbours are taken with partial
aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import lookup, stored

#: Rounds after which a graph that doesn't settle is an error; the number needed grows with the logarithm of its size.
ROUNDS = 60


def _print(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
    return row[0], row[1] or 0


def _stars(links: DataFrame, total: int) -> DataFrame:
    """(u, v, low) for each link, where low is the smallest of u and its neighbours."""
    lows = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"), F.count(F.lit(1)).alias("n"))
    return lookup(links, stored(lows, "star-lows"), "u", "n", total)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link to another one; root is the smallest node it reaches.

    ``links`` has comparable columns u and v, in any direction, with repeats; links of a node to itself and null ends count
    for nothing. Without links the result is empty.
    """
    ordered = links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = stored(ordered.distinct(), "links")
    seen = _print(now)
    for _ in range(ROUNDS):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, 2 * seen[0]).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = stored(large.where("u <> v").distinct(), "links")
        met = _stars(large, max(1, large.count()))
        small = met.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(met.select("u", F.col("low").alias("v")))
        now = stored(small.where("u <> v").distinct(), "links")
        before, seen = seen, _print(now)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
