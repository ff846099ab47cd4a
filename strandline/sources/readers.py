"""Reading panels and dimensions from files, with their contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import audit


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A Parquet scan whose columns and filter reach the files."""
    frame = spark.read.parquet(path)
    frame = frame.where(where) if where else frame
    return frame.select(*columns) if columns else frame


def slice_of(frame: DataFrame, columns: list[str], text: tuple[str, ...] = (), where: str | None = None) -> DataFrame:
    """A projection with awkward types as text and a filter, pushed down to any source."""
    frame = frame.where(where) if where else frame
    return frame.select(*[F.col(c).cast("string").alias(c) if c in text else F.col(c) for c in columns])


def model_table(spark: SparkSession, path: str, keys: tuple[str, str] = ("entity_id", "obs_date"), rows: int | None = None, entities: int | None = None, validate: bool = True) -> DataFrame:
    """A modelling table with its date typed; ValueError for repeated keys or other counts than expected."""
    frame = audit.assert_columns(spark.read.parquet(path), list(keys))
    frame = frame.withColumn(keys[1], F.to_date(keys[1]))
    if validate:
        audit.assert_unique(frame, list(keys))
        if rows is not None or entities is not None:
            audit.assert_counts(frame, rows, (keys[0], entities) if entities is not None else None)
    return frame


def daily_source(spark: SparkSession, path: str, time: str = "time", key: str = "key") -> DataFrame:
    """The daily source before any gate, with obs_date and an integer entity_id."""
    frame = audit.assert_columns(spark.read.parquet(path), [time, key])
    return frame.withColumns({"obs_date": F.to_date(F.expr(f"try_cast(`{time}` as timestamp_ntz)")), "entity_id": F.col(key).try_cast("int")})


def site_days(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    return audit.assert_columns(spark.read.parquet(path), ["latitude", "longitude", "obs_date", *variables])


def first_file(frame: DataFrame) -> DataFrame:
    """The rows of the first of the files that ``filename`` names: a sample of one file, chosen by a scalar subquery."""
    return frame.where(F.col("filename") == frame.agg(F.min("filename")).scalar())


def snapshots(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Snapshots of one table under each other, by name; a column that one lacks is NULL there."""
    out = spark.read.parquet(paths[0])
    for path in paths[1:]:
        out = out.unionByName(spark.read.parquet(path), allowMissingColumns=True)
    return out


def csv_text(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """CSV files as text columns joined by name, with ``filename``. Files may differ in their columns.

    Files are grouped by header first, since one scan reads columns by position; headers are one line for each file, and
    there are as many scans as different headers.
    """
    lines = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.csv").text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    first = lines.where("at = 0").withColumn("n", F.monotonically_increasing_id()).groupBy("path").agg(F.min_by("value", "n").alias("header"))
    groups = first.groupBy("header").agg(F.collect_list("path").alias("paths")).collect()
    out = None
    for group in groups:
        one = spark.read.csv(list(group["paths"]), header=True, inferSchema=False).withColumn("filename", F.col("_metadata.file_path"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "filename string")


def csv_typed(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """CSV with a schema, or inferred types where there is none."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(paths)


def partitioned(spark: SparkSession, base: str, where: str | None = None) -> DataFrame:
    """A table in key=value folders; filters on those keys choose folders."""
    frame = spark.read.option("basePath", base).parquet(base)
    return frame.where(where) if where else frame


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size) of the files under a path by name pattern; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select("path", F.col("length").alias("size"))


#: Path patterns of the daily, hourly and minute files of a year.
GRAIN_PATTERNS = {"d": r"/\d{4}_d/", "h": r"/\d{4}_h/", "m": r"/\d{4}_m/"}


def of_grain(frame: DataFrame, grain: str, path: str = "path", only: str = "/years/", never: str = "/events/") -> DataFrame:
    """Rows whose file path belongs to a grain, under one folder and not under another."""
    p = F.col(path)
    return frame.where(p.rlike(GRAIN_PATTERNS[grain]) & p.contains(only) & ~p.contains(never))


def spine(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every day from first to last."""
    return spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{last}', interval 1 day)")).alias("obs_date"))
