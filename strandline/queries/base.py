"""What the registered queries share: stand-in panels over the given tables, each with the same CTE for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def held(frame: DataFrame) -> DataFrame:
    """``frame``, computed once for all that a query reads of it; the result may be collected whenever, and again."""
    return sinks.stored(frame, "held")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its DuckDB twin; double results are rounded to six places on both sides."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return C.rounded(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mean(condition: str, divisor: int = 1) -> Column:
    """Mean of ``value`` where the condition holds, cut to thousandths by integers, so every engine finds the same."""
    return F.expr(
        f"case when count_if({condition}) > 0 then sum(case when {condition} then cast(round(value * 100) as bigint) end) * 10 div ({divisor} * greatest(count_if({condition}), 1)) / 1000D end"
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel of ``events``: one entity for each user, the mean value as level, sensors that miss readings, a site, and
    counters since and until purchases and errors, which count seconds for every third user."""
    events = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    rows = events.groupBy(F.col("user_id").alias("entity_id"), day.alias("obs_date")).agg(
        _mean("true").alias("level"), F.count(F.lit(1)).alias("n_readings"), _mean("event_id % 4 <> 0", 4).alias("outside_temp"), _mean("event_id % 3 = 0").alias("humidity"),
        F.count_if(F.col("event_type") == "purchase").alias("n_purchase"), F.count_if(F.col("event_type") == "error").alias("n_error"),
    )
    w = Window.partitionBy("entity_id").orderBy("obs_date")
    unit = F.when(F.col("entity_id") % 3 == 0, 86400.0).otherwise(1.0)
    out = rows.withColumns({"latitude": 47 + (F.col("entity_id") % 34) / 10, "longitude": 8 + (F.col("entity_id") % 7) / 10})
    for kind in ("purchase", "error"):
        seen = F.when(F.col(f"n_{kind}") > 0, F.col("obs_date"))
        last = F.max(seen).over(w.rowsBetween(Window.unboundedPreceding, 0))
        ahead = F.min(seen).over(w.rowsBetween(0, Window.unboundedFollowing))
        out = out.withColumns({f"{kind}_last_dif": F.datediff("obs_date", last) * unit, f"{kind}_next_dif": -F.datediff(ahead, "obs_date") * unit})
    return out


DAILY = """
daily_base AS (
    SELECT user_id AS entity_id, CAST(ts AS DATE) AS obs_date, (sum(CAST(round(value * 100) AS BIGINT)) * 10 // count(*)) / 1000.0::DOUBLE AS level, count(*) AS n_readings,
           (sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_id % 4 <> 0) * 10 // (4 * count(*) FILTER (WHERE event_id % 4 <> 0))) / 1000.0::DOUBLE AS outside_temp,
           (sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_id % 3 = 0) * 10 // count(*) FILTER (WHERE event_id % 3 = 0)) / 1000.0::DOUBLE AS humidity,
           count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase, count(*) FILTER (WHERE event_type = 'error') AS n_error
    FROM events GROUP BY 1, 2),
daily_seen AS (
    SELECT *, 47 + (entity_id % 34) / 10 AS latitude, 8 + (entity_id % 7) / 10 AS longitude,
           CASE WHEN entity_id % 3 = 0 THEN 86400.0::DOUBLE ELSE 1.0::DOUBLE END AS unit,
           max(CASE WHEN n_purchase > 0 THEN obs_date END) OVER past AS purchase_last, min(CASE WHEN n_purchase > 0 THEN obs_date END) OVER ahead AS purchase_next,
           max(CASE WHEN n_error > 0 THEN obs_date END) OVER past AS error_last, min(CASE WHEN n_error > 0 THEN obs_date END) OVER ahead AS error_next
    FROM daily_base
    WINDOW past AS (PARTITION BY entity_id ORDER BY obs_date ROWS UNBOUNDED PRECEDING),
           ahead AS (PARTITION BY entity_id ORDER BY obs_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
daily AS (
    SELECT entity_id, obs_date, level, n_readings, outside_temp, humidity, n_purchase, n_error, latitude, longitude,
           date_diff('day', purchase_last, obs_date) * unit AS purchase_last_dif, -date_diff('day', obs_date, purchase_next) * unit AS purchase_next_dif,
           date_diff('day', error_last, obs_date) * unit AS error_last_dif, -date_diff('day', obs_date, error_next) * unit AS error_next_dif
    FROM daily_seen)
"""


def long_panel(spark: SparkSession, sf_dir: str, by: str = "n_regionkey") -> DataFrame:
    """Daily order value of each region (or nation) over several years, in thousands."""
    nations = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", F.col(by).cast("long").alias("entity_id")))  # 25 nations
    customers = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "entity_id")
    rows = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("entity_id", F.to_date("o_orderdate").alias("obs_date")).agg(F.expr("sum(cast(round(o_totalprice * 100) as bigint)) div 1000 / 100D").alias("level"))


def long_sql(by: str = "n_regionkey") -> str:
    return f"""
long_panel AS (
    SELECT {by}::BIGINT AS entity_id, CAST(o_orderdate AS DATE) AS obs_date, (sum(CAST(round(o_totalprice * 100) AS BIGINT)) // 1000) / 100.0::DOUBLE AS level
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
"""


LONG = long_sql()

#: History columns of ``daily``, for the gated and flagged table.
HISTORY = (
    DAILY
    + """,
lags AS (
    SELECT *, lag(obs_date) OVER w AS previous_date, lead(obs_date) OVER w AS next_date, lag(level) OVER w AS previous_level, lead(level) OVER w AS next_level,
           lag(level, 2) OVER w AS lag_2, lag(level, 7) OVER w AS lag_7,
           avg(level) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean_3, avg(level) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS mean_7,
           stddev_samp(level) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS sd_7,
           median(level) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS local_median, median(level) OVER (PARTITION BY entity_id) AS entity_median
    FROM daily WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date)),
middle AS (SELECT entity_id, median(level - previous_level) AS change_median FROM lags GROUP BY 1),
scales AS (
    SELECT l.entity_id, median(abs(level - entity_median)) AS entity_mad, median(abs(level - previous_level - change_median)) AS change_mad
    FROM lags l JOIN middle m ON l.entity_id = m.entity_id GROUP BY 1),
candidates AS (
    SELECT l.*, entity_mad, change_mad, date_diff('day', previous_date, obs_date) AS gap_before, date_diff('day', obs_date, next_date) AS gap_after,
           level - previous_level AS change, next_level - level AS target, level - mean_7 AS minus_mean_7, level - mean_3 AS minus_mean_3,
           (level - lag_2) / 2 AS slope_2, (level - lag_7) / 7 AS slope_7, level - entity_median AS minus_entity_median,
           year(obs_date) AS year, month(obs_date) AS month, dayofyear(obs_date) AS day_of_year,
           sin(2 * pi() * dayofyear(obs_date) / 365.25) AS sin_day_of_year, cos(2 * pi() * dayofyear(obs_date) / 365.25) AS cos_day_of_year
    FROM lags l JOIN scales s ON l.entity_id = s.entity_id),
gated AS (SELECT * FROM candidates WHERE gap_before = 1 AND gap_after = 1 AND level > 0 AND previous_level > 0 AND next_level > 0 AND target IS NOT NULL),
target_median AS (SELECT entity_id, median(target) AS m FROM gated GROUP BY 1),
target_scale AS (SELECT g.entity_id, median(abs(target - m)) AS target_mad FROM gated g JOIN target_median t ON g.entity_id = t.entity_id GROUP BY 1),
flagged AS (
    SELECT g.*, target_mad, abs(target) > 30 AS extreme_30, abs(target) > 60 AS extreme_60, abs(target) > 120 AS extreme_120,
           coalesce(target_mad <> 0 AND abs(target) > 2 * 1.4826 * target_mad, false) AS extreme_relative,
           (level < 5 OR previous_level < 5 OR next_level < 5) AS implausible,
           coalesce(change_mad <> 0 AND abs(level - local_median) > 2 * 1.4826 * change_mad, false) AS robust_outlier,
           (change < -5 AND target > 5) OR (change > 5 AND target < -5) AS dropout
    FROM gated g LEFT JOIN target_scale t ON g.entity_id = t.entity_id)
"""
)

#: Parameters of the flags for the stand-in panel, whose levels move more than a scale's.
FLAGS = {"floor": 5.0, "k": 2.0, "k_relative": 2.0, "cuts": (30, 60, 120)}


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.operators import history

    return history.model_table(daily(spark, sf_dir), **FLAGS)
