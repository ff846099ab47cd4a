"""Tables written in every form that the sources read, and read back whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.queries.base import held, query, table
from strandline.sources import readers, sinks

FORMS = ("csv_by_name", "csv_typed", "model_table", "of_grain", "parquet_slice", "partitioned", "table", "text_slice", "view")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity_id"), F.to_date("o_orderdate").alias("obs_date"), cents.alias("cents"), F.year("o_orderdate").alias("year"))


def _summed(form: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.lit(form).alias("form"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("entity_id").alias("n_entities"), F.sum(F.col("cents").cast("long")).alias("cents"))


@query(
    "WITH o AS (SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_entities, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents, "
    "count(*) FILTER (WHERE year(o_orderdate) = 1995) AS n5, count(DISTINCT o_orderkey) FILTER (WHERE year(o_orderdate) = 1995) AS e5, (sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (WHERE year(o_orderdate) = 1995))::BIGINT AS c5 FROM orders), "
    f"f AS (SELECT unnest({list(FORMS)}) AS form) "
    "SELECT form, CASE WHEN form = 'partitioned' THEN n5 ELSE n_rows END AS n_rows, CASE WHEN form = 'partitioned' THEN e5 ELSE n_entities END AS n_entities, CASE WHEN form = 'partitioned' THEN c5 ELSE cents END AS cents FROM f, o"
)
def stored_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` written and read again as Parquet, CSV with differing headers, folders of keys, a table and a view.

    The partitioned form reads one year's folder. Everything is written to the shared folder and goes with the application.
    """
    base = sinks.delete_on_exit(spark, f"{sinks.scratch_dir(spark)}/forms-{uuid.uuid4().hex}")
    rows = _orders(spark, sf_dir)
    sinks.parquet(rows, f"{base}/parquet", ["entity_id", "obs_date"])
    sinks.csv(rows.where("entity_id % 2 = 0"), f"{base}/years/1995_d/even")
    sinks.csv(rows.where("entity_id % 2 = 1").select(F.lit("x").alias("extra"), "cents", "year", "obs_date", "entity_id"), f"{base}/years/1995_d/odd")
    rows.write.partitionBy("year").parquet(f"{base}/folders")
    name = f"forms_{uuid.uuid4().hex}"
    sinks.table(rows.where("year = 1995"), name, path=f"{base}/table")
    sinks.table(rows, name, path=f"{base}/table")  # replaces
    sinks.view(rows, f"{name}_view")
    by_name = readers.csv_text(spark, f"{base}/years")
    typed = readers.csv_typed(spark, f"{base}/years/1995_d/even", "entity_id long, obs_date date, cents long, year int").unionByName(
        readers.csv_typed(spark, [f"{base}/years/1995_d/odd"]).select("entity_id", "obs_date", "cents", "year")
    )
    found = {
        "csv_by_name": by_name.select(C.number("entity_id").cast("long").alias("entity_id"), "cents"), "csv_typed": typed, "model_table": readers.model_table(spark, f"{base}/parquet"),
        "of_grain": readers.of_grain(by_name, "d", "filename"), "parquet_slice": readers.parquet(spark, f"{base}/parquet", ["entity_id", "cents"], "cents is not null"),
        "partitioned": readers.partitioned(spark, f"{base}/folders", "year = 1995"), "table": spark.table(name),
        "text_slice": readers.slice_of(spark.read.parquet(f"{base}/parquet"), ["entity_id", "cents"], ("cents",)), "view": spark.table(f"{name}_view"),
    }
    out = None
    for form in FORMS:
        one = _summed(form, found[form])
        out = one if out is None else out.unionByName(one)
    out = held(out)
    spark.sql(f"DROP TABLE {name}")
    spark.catalog.dropTempView(f"{name}_view")
    return out


@query("SELECT 'cents' AS name, 'bigint' AS kind, 2 AS place UNION ALL SELECT 'entity_id', 'bigint', 0 UNION ALL SELECT 'obs_date', 'date', 1 UNION ALL SELECT 'year', 'int', 3")
def stored_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a stored table, read back from its files, as its DDL names them."""
    path = sinks.delete_on_exit(spark, f"{sinks.scratch_dir(spark)}/schema-{uuid.uuid4().hex}")
    sinks.parquet(_orders(spark, sf_dir), path, ["entity_id"])
    lines = spark.createDataFrame([*enumerate(sinks.schema_text(spark.read.parquet(path)).split(",\n"))], "place int, line string")  # a row for each column
    return lines.select(F.split_part("line", F.lit(" "), F.lit(1)).alias("name"), F.split_part("line", F.lit(" "), F.lit(2)).alias("kind"), "place")
