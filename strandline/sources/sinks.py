"""Writing tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a folder of our own only in local mode, where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="strandline-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir() or root
    return root.rstrip("/")


def delete_on_exit(spark: SparkSession, path: str) -> str:
    """The path, which goes when the application ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(frame: DataFrame, label: str = "table") -> DataFrame:
    """``frame``, computed once and written to the shared folder: what reads it computes nothing again and survives lost
    executors. The table goes when the application ends."""
    spark = frame.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def parquet(frame: DataFrame, path: str, order: list[str], files: int | None = None) -> None:
    """Files in ranges of the key, each sorted by it, with Zstandard: later filters on the key skip files and row groups."""
    ranged = frame.repartitionByRange(files, *order) if files else frame.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(path)


def csv(frame: DataFrame, path: str, note: str = "") -> str:
    """CSV with a header; returns a line that reports the rows written, counted while they are."""
    seen = Observation()
    frame.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).csv(path)
    return f"{path}: {seen.get['n']} rows" + (f" ({note})" if note else "")


def table(frame: DataFrame, name: str, buckets: tuple[int, str] | None = None, path: str | None = None) -> None:
    """Create or replace a table; with ``buckets`` later joins and windows on that key need no shuffle."""
    writer = frame.write.mode("overwrite").format("parquet")
    writer = writer.option("path", path) if path else writer
    (writer.bucketBy(buckets[0], buckets[1]).sortBy(buckets[1]) if buckets else writer).saveAsTable(name)


def view(frame: DataFrame, name: str) -> DataFrame:
    frame.createOrReplaceTempView(name)
    return frame


def schema_text(frame: DataFrame) -> str:
    """The table's columns as DDL, one in a line."""
    return ",\n".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema)
