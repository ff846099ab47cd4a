"""Smaller inventory rows: percentiles, months without rows, inclusive cuts, fills by one number, sensors, guards, files and the
weather ladder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import enrich, extremes, history, periods
from strandline.plans import backtest as B
from strandline.plans import models as M
from strandline.queries.backtests import NAIVE, naive_predictions
from strandline.queries.base import DAILY, daily, held, long_panel, query, table
from strandline.queries.grains import LONG_TARGET, SITES, grained, long_targets, site_days, weather_days
from strandline.sources import readers, sinks

SEASONS = "CASE WHEN month(obs_date) IN (12, 1, 2) THEN 'Winter' WHEN month(obs_date) IN (3, 4, 5) THEN 'Spring' WHEN month(obs_date) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END"


@query(
    f"""WITH {LONG_TARGET}, s AS (SELECT {SEASONS} AS season, abs(target) AS x FROM targets)
        SELECT season, count(x) AS n, round(quantile_cont(x, 0.05), 6) AS p5, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.99), 6) AS p99 FROM s GROUP BY 1"""
)
def target_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of the size of the target by season, in ranges of the value."""
    from strandline.functions import columns as C

    rows = long_targets(spark, sf_dir).select(C.season(F.col("obs_date")).alias("season"), F.abs("target").alias("x"))
    return history.quantiles(rows, ["season"], "x", (0.05, 0.5, 0.99)).withColumnsRenamed({"q0": "p5", "q1": "p50", "q2": "p99"})


@query(
    f"""WITH {LONG_TARGET}, early AS (SELECT * FROM targets WHERE month(obs_date) <= 5), m AS (SELECT unnest(range(1, 13)) AS month)
        SELECT m.month, count(target) AS n, count(*) FILTER (WHERE abs(target) > 200) AS n_extreme, count(*) FILTER (WHERE abs(target) > 200 AND target < 0) AS n_loss, count(*) FILTER (WHERE abs(target) > 200 AND target >= 0) AS n_gain,
               round(100.0 * count(*) FILTER (WHERE abs(target) > 200) / nullif(count(target), 0), 6) AS pct_extreme FROM m LEFT JOIN early e ON month(e.obs_date) = m.month GROUP BY 1"""
)
def every_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes of every month of a panel that knows January to May alone: the others count 0."""
    return extremes.monthly_rate(long_targets(spark, sf_dir).where("month(obs_date) <= 5"), F.abs("target") > 200, every=True)


@query(
    f"""WITH {LONG_TARGET}, r AS (SELECT round(target, -1) AS t FROM targets)
        SELECT count(*) FILTER (WHERE abs(t) > 100) AS beyond, count(*) FILTER (WHERE abs(t) >= 100) AS from_on, count(*) FILTER (WHERE abs(t) = 100) AS at_the_cut FROM r"""
)
def inclusive_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes beyond a cut and from it on, of targets in whole tens."""
    rows = long_targets(spark, sf_dir).select(F.round("target", -1).alias("target"))
    own, on = history.extreme(F.col("target"), 100), history.extreme(F.col("target"), 100, inclusive=True)
    return rows.agg(F.count_if(own).alias("beyond"), F.count_if(on).alias("from_on"), F.count_if(on & ~own).alias("at_the_cut"))


@query(
    f"""WITH {DAILY}, o AS (SELECT avg(humidity) AS m, median(outside_temp) AS q FROM daily) SELECT entity_id, obs_date, round(coalesce(humidity, m), 6) AS humidity, round(coalesce(outside_temp, q), 6) AS outside_temp FROM daily, o"""
)
def filled_by_one_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps filled by the mean of all rows, or by their exact median."""
    rows = daily(spark, sf_dir).select("entity_id", "obs_date", "humidity", "outside_temp")
    return history.filled_by(history.filled_by(rows, ["humidity"], "mean"), ["outside_temp"], "median")


SENSORS = ("level", "n_readings", "outside_temp", "humidity", "n_purchase", "n_error", "latitude")


@query(
    f"""WITH {DAILY}, p AS (SELECT *, CAST(date_trunc('week', obs_date) AS DATE) AS week FROM daily)
        SELECT entity_id, min(obs_date) AS period_start, count(*) AS days_observed, {", ".join(f"round(avg({s}), 6) AS {s}_mean, round(stddev_samp({s}), 6) AS {s}_std, round(max({s})::DOUBLE, 6) AS {s}_max" for s in SENSORS)} FROM p GROUP BY entity_id, week"""
)
def sensor_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and maximum of seven columns by entity and week."""
    weeks = periods.aggregated(daily(spark, sf_dir), "week", least_days=1, sensors=SENSORS)
    return weeks.select("entity_id", "period_start", "days_observed", *[c for s in SENSORS for c in (f"{s}_mean", f"{s}_std", F.col(f"{s}_max").cast("double").alias(f"{s}_max"))])


@query(
    f"""WITH {DAILY}, {SITES}, met AS (SELECT d.entity_id, d.obs_date, s.tmax FROM daily d JOIN site_days s ON round(d.latitude * 10) = round(s.latitude * 10) AND round(d.longitude * 10) = round(s.longitude * 10) AND d.obs_date = s.obs_date)
        SELECT entity_id, obs_date, tmax FROM met"""
)
def guarded_site_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have a site-day, joined under the guard that nearly all of them find theirs."""
    sites, keys = site_days(spark, sf_dir), ("latitude", "longitude")
    known = sites.select(*[enrich.grid(c).alias(f"_{c}") for c in keys], F.col("obs_date").alias("_day"))
    rows = daily(spark, sf_dir).withColumns({f"_{c}": enrich.grid(c) for c in keys}).withColumn("_day", F.col("obs_date"))
    rows = held(rows.join(known, [*(f"_{c}" for c in keys), "_day"], "left_semi").select("entity_id", "obs_date", *keys))
    return enrich.with_site_days(rows, sites).select("entity_id", "obs_date", "tmax")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50) GROUP BY 1")
def kept_on_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users with a large purchase, by a semi-join on their ids."""
    events = table(spark, sf_dir, "events")
    met = enrich.kept_on(events, events.where("event_type = 'purchase' and value > 50"), "user_id")
    return met.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"))


@query(
    """WITH o AS (SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS year FROM orders), first AS (SELECT min(year) AS y FROM o)
       SELECT 'all' AS form, count(*) AS n, min(day) AS first_date, max(day) AS last_date FROM o UNION ALL SELECT 'first_file', count(*), min(day), max(day) FROM o, first WHERE year = y
       UNION ALL SELECT 'snapshots', count(*), min(day), max(day) FROM o WHERE year IN (1995, 1996) UNION ALL SELECT 'source', count(*), min(day), max(day) FROM o"""
)
def read_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as the daily source, as CSV files of years, of the first file alone, and as a union of two snapshots."""
    base = sinks.delete_on_exit(spark, f"{sinks.scratch_dir(spark)}/contracts-{uuid.uuid4().hex}")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("time"), F.year("o_orderdate").alias("year"))
    rows.write.parquet(f"{base}/source")
    sinks.parquet(rows.where("year = 1995"), f"{base}/1995", ["key"])
    sinks.parquet(rows.where("year = 1996").select("time", F.lit(1).alias("extra"), "key", "year"), f"{base}/1996", ["key"])
    years = spark.read.parquet(f"{base}/source")
    years.repartition("year").write.partitionBy("year").option("header", True).csv(f"{base}/years")
    csv = readers.csv_text(spark, f"{base}/years").select("key", "time", "filename")
    found = {
        "source": readers.daily_source(spark, f"{base}/source").select("obs_date"), "all": csv.select(F.to_date("time").alias("obs_date")),
        "first_file": readers.first_file(csv).select(F.to_date("time").alias("obs_date")),
        "snapshots": readers.snapshots(spark, [f"{base}/1995", f"{base}/1996"]).select(F.to_date("time").alias("obs_date")),
    }
    out = None
    for form, one in found.items():
        one = one.agg(F.lit(form).alias("form"), F.count(F.lit(1)).alias("n"), F.min("obs_date").alias("first_date"), F.max("obs_date").alias("last_date"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH {NAIVE}, e AS (SELECT fold, rule, avg(abs(y_pred - y_true)) AS mae FROM predictions GROUP BY 1, 2), r AS (SELECT rule, min(mae) AS low, max(mae) AS high FROM e GROUP BY 1)
        SELECT a.rule AS rule, b.rule AS other, round(a.low, 6) AS low, round(a.high, 6) AS high, round(b.low, 6) AS other_low, round(b.high, 6) AS other_high, a.high < b.low OR b.high < a.low AS apart FROM r a JOIN r b ON a.rule < b.rule"""
)
def ranges_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the ranges of two rules' errors over the folds don't overlap, for every pair of rules."""
    return M.ranges(B.board(naive_predictions(spark, sf_dir)), "rule")


def _feature_sql(c: str) -> str:
    return f"round(coalesce(f.{c}, e.{c}, o.{c}), 6) AS {c}, f.{c}_was_missing"


@query(
    f"""WITH {DAILY}, t AS (SELECT *, lead(level) OVER w - level AS target, abs(level) > 60 AS extreme_60 FROM daily WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date)),
        f AS (SELECT entity_id, obs_date, target, extreme_60, outside_temp IS NULL AS outside_temp_was_missing, humidity IS NULL AS humidity_was_missing, last_value(outside_temp IGNORE NULLS) OVER w AS outside_temp, last_value(humidity IGNORE NULLS) OVER w AS humidity
              FROM t WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date ROWS UNBOUNDED PRECEDING)),
        e AS (SELECT entity_id, median(outside_temp) AS outside_temp, median(humidity) AS humidity FROM f GROUP BY 1), o AS (SELECT median(outside_temp) AS outside_temp, median(humidity) AS humidity FROM f)
        SELECT f.entity_id, f.obs_date, round(f.target, 6) AS target, f.extreme_60, year(f.obs_date) AS year, month(f.obs_date) AS month, {SEASONS.replace("obs_date", "f.obs_date")} AS season, {_feature_sql("outside_temp")}, {_feature_sql("humidity")}
        FROM f JOIN e ON f.entity_id = e.entity_id, o"""
)
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sensors as features, filled forward, with the columns that segments need."""
    rows = history.neighbours(daily(spark, sf_dir)).withColumns({"target": F.col("next_level") - F.col("level"), "extreme_60": F.abs("level") > 60})
    return M.feature_table(rows, ["outside_temp", "humidity"])


HISTORY_RUNG = ("period_change", "previous_period_change", "rolling_change", "minus_rolling")

#: One feature for each mechanism, in place of all sixteen.
CORE_WEATHER = ("shortwave_radiation_sum_sum", "precipitation_sum_sum", "growing_degree_days_10c_sum", "is_foraging_day_sum", "wind_speed_10m_max_mean")


def weather_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = periods.with_features(grained(spark, sf_dir, "week")).where("target is not null").withColumn("change", F.col("period_change"))
    days = long_panel(spark, sf_dir).select("entity_id", "obs_date").join(weather_days(spark, sf_dir), "obs_date", "left")
    return held(enrich.period_weather(features, days, enrich.PERIOD_AGGREGATIONS, lookahead=True))


def weather_rungs() -> tuple[dict[str, list[str]], list[str]]:
    """Rungs of the weather ladder, and the columns of the last one that only hindsight knows."""
    names = enrich.period_names()
    ahead = [f"next_{c}" for c in names]
    own = list(HISTORY_RUNG)
    return {"history": own, "core_weather": [*own, *CORE_WEATHER], "weather": [*own, *names], "next_weather": [*own, *names, *ahead]}, ahead


@query()
def weather_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History, with five and with sixteen weather features, and with the weather of the forecast week itself, an upper bound:
    each by two models."""
    rungs, ahead = weather_rungs()
    return M.rung_board(weather_periods(spark, sf_dir), rungs, allow=ahead, names=("rf", "gb"))


@query()
def weather_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutation importance on the deployable weather rung of the last fold."""
    rows, columns = weather_periods(spark, sf_dir), weather_rungs()[0]["weather"]
    split = held(B.assigned(rows, B.rolling_folds(rows, "period_start")[-1:], "period_start", "target_period_end"))
    train = split.where("part = 'train'")
    model = M.regressor("rf").fit(M.matrix(train, columns, train=train))
    found = M.permutation_importance(model, split.where("part = 'test'"), columns, ["entity_id", "period_start"], train=train)
    return found.withColumn("is_weather", F.col("feature").isin(enrich.period_names()))
