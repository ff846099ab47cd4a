"""Readings to days, as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_columns() -> list[Column]:
    """Last present level by time, sensor mean, largest value, number and time of the last reading."""
    return [
        F.max_by("level", F.when(F.col("level").isNotNull(), F.col("ts"))).alias("last_level"), F.avg("sensor").alias("sensor_mean"), F.max("value").alias("max_value"),
        F.count(F.lit(1)).alias("n_readings"), F.max("ts").alias("last_time"),
    ]


def stream_days(readings: DataFrame, late: str = "2 days") -> DataFrame:
    """The same days from a stream of (entity_id, ts, level, sensor, value); a day is emitted once no reading within
    ``late`` of the newest one can change it."""
    days = readings.withWatermark("ts", late).groupBy("entity_id", F.window("ts", "1 day"))
    return days.agg(*day_columns()).withColumn("obs_date", F.to_date("window.start")).drop("window")
