"""Counters whose unit differs between entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.operators.history import DEFAULT, Panel, median

#: A typical rise over one day beyond which a counter is taken for seconds.
SECONDS_FROM, DAY_SECONDS = 1000, 86_400


def normalised(panel: DataFrame, counters: list[str], p: Panel = DEFAULT) -> DataFrame:
    """Long form of the counters in days: entity, date, counter, days, in_seconds, undetermined.

    The unit of each entity and counter comes from the median size of its changes over single days; one without any counts
    as days and is marked undetermined.
    """
    long = panel.unpivot([p.entity, p.date], counters, "counter", "value")
    w = Window.partitionBy(p.entity, "counter").orderBy(p.date)
    step = F.abs(F.col("value") - F.lag("value").over(w))
    one_day = C.day_gap(F.lag(p.date).over(w), F.col(p.date)) == 1
    rows = long.withColumn("_step", F.when(one_day & (step > 0), step))
    rows = rows.withColumn("_typical", median(F.col("_step")).over(Window.partitionBy(p.entity, "counter")))
    seconds = F.coalesce(F.col("_typical") > SECONDS_FROM, F.lit(False))
    return rows.select(p.entity, p.date, "counter", F.when(seconds, F.col("value") / DAY_SECONDS).otherwise(F.col("value")).alias("days"), seconds.alias("in_seconds"), F.col("_typical").isNull().alias("undetermined"))


def report(long: DataFrame, p: Panel = DEFAULT) -> DataFrame:
    """(counter, n_days, n_seconds, n_undetermined) entities, from the long form."""
    units = long.groupBy("counter", p.entity).agg(F.first("in_seconds").alias("s"), F.first("undetermined").alias("u"))
    return units.groupBy("counter").agg(F.count_if(~F.col("s")).alias("n_days"), F.count_if("s").alias("n_seconds"), F.count_if("u").alias("n_undetermined"))
