"""Profiles and audits of tables. Each is one aggregation; nothing but its result leaves the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.operators.history import median, running_before
from strandline.sources.sinks import stored


def assert_unique(frame: DataFrame, keys: list[str]) -> DataFrame:
    """``frame`` itself; ValueError if two rows share a key."""
    worst = duplicate_keys(frame, keys).limit(1).collect()
    if worst:
        raise ValueError(f"repeated key {worst[0].asDict()}")
    return frame


def assert_columns(frame: DataFrame, required: list[str]) -> DataFrame:
    if missing := sorted(set(required) - set(frame.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return frame


def assert_counts(frame: DataFrame, rows: int | None = None, entities: tuple[str, int] | None = None) -> DataFrame:
    """``frame`` itself; ValueError if it hasn't the rows or entities expected."""
    column = F.count_distinct(entities[0]) if entities else F.lit(None)
    found = frame.agg(F.count(F.lit(1)), column).first()
    if (rows is not None and found[0] != rows) or (entities and found[1] != entities[1]):
        raise ValueError(f"{found[0]} rows and {found[1]} entities, not {rows} and {entities}")
    return frame


def duplicate_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def profile(frame: DataFrame, value: str, entity: str, date: str, cut: float) -> DataFrame:
    v = F.col(value)
    return frame.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(entity).alias("n_entities"), F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.avg(v).alias("mean"), median(v).alias("median"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), F.count_if(F.abs(v) > cut).alias("n_beyond"),
    )


def missingness(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_missing, pct_missing) for each column."""
    counts = F.array(*[F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("n_missing")) for c in columns])
    one = frame.agg(counts.alias("x"), F.count(F.lit(1)).alias("n"))
    return one.select(F.explode("x").alias("x"), "n").select("x.*", (100.0 * F.col("x.n_missing") / F.nullif("n", F.lit(0))).alias("pct_missing"))


def token_audit(frame: DataFrame, columns: list[str], token: str = "NA") -> DataFrame:
    """(column_name, n_null, n_token, n_blank) of text columns."""
    parts = [
        F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_if(F.col(c) == token).alias("n_token"), F.count_if(F.trim(c) == "").alias("n_blank"))
        for c in columns
    ]
    return frame.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def frame_audit(frame: DataFrame) -> DataFrame:
    """n_rows, n_columns, n_missing cells and n_repeated rows."""
    missing = sum((F.col(c).isNull().cast("long") for c in frame.columns), F.lit(0))
    groups = frame.groupBy(*frame.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_missing", missing)
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.lit(len(frame.columns)).cast("long").alias("n_columns"),
        F.coalesce(F.sum(F.col("_missing") * F.col("_n")), F.lit(0)).cast("long").alias("n_missing"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("n_repeated"),
    )


def shares(frame: DataFrame, group: str) -> DataFrame:
    """Rows of each group and their percentage of all rows."""
    counts = frame.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / counts.agg(F.sum("n")).scalar())


def histogram(frame: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bucket, n): bucket 0 is below ``low``, bins + 1 from ``high`` on."""
    return frame.where(F.col(value).isNotNull()).groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def conditional_counts(frame: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    return frame.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def correlation_matrix(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r) for every pair of columns, from one aggregation."""
    cells = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), C.pearson(F.col(a), F.col(b)).alias("r")) for a in columns for b in columns]
    return frame.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def spearman(frame: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, n, rho), strongest first, over rows where both are present. Ties share their average rank.

    All features are ranked together, over their distinct values: pairs are counted first, and running sums of the counts
    give the ranks in two phases.
    """
    number = {f: F.col(f).cast("double").alias(f) for f in features}
    long = frame.select(F.col(target).cast("double").alias("y"), *number.values()).unpivot(["y"], features, "feature", "x").where("x is not null and y is not null")
    pairs = stored(long.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n")), "pairs")
    sides = pairs.select("feature", "n", F.explode(F.array(F.struct(F.lit("x").alias("side"), F.col("x").alias("v")), F.struct(F.lit("y").alias("side"), F.col("y").alias("v")))).alias("s"))
    values = sides.groupBy("feature", "s.side", "s.v").agg(F.sum("n").alias("n"))
    totals = pairs.groupBy("feature").agg(F.sum("n").alias("total"))
    ranks = running_before(values, ["feature", "side"], "v", ["n"]).join(totals, "feature")
    ranks = ranks.select("feature", "side", "v", (F.col("n_before") + (F.col("n") - F.col("total")) / 2).alias("rank"))  # from the middle rank
    met = pairs
    for side in ("x", "y"):
        met = met.join(ranks.where(F.col("side") == side).select("feature", F.col("v").alias(side), F.col("rank").alias(f"r{side}")), ["feature", side])
    spread = F.sqrt(F.sum(F.col("n") * F.col("rx") * F.col("rx"))) * F.sqrt(F.sum(F.col("n") * F.col("ry") * F.col("ry")))
    out = met.groupBy("feature").agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.col("rx") * F.col("ry")), spread).alias("rho"))
    none = frame.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    out = none.join(out, "feature", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.orderBy(F.abs("rho").desc_nulls_last(), "feature")
