"""Weeks and months, events, sites and weather, extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import enrich, events, extremes, history, periods
from strandline.queries.base import DAILY, FLAGS, HISTORY, LONG, daily, flagged, held, long_panel, query, table
from strandline.sources import payloads

WEEK_SQL = "CAST(floor((date_diff('day', DATE '1970-01-01', obs_date) + 3) / 7.0) AS BIGINT) + 1"
MONTH_SQL = "((year(obs_date) - 1970) * 12 + month(obs_date) - 1)::BIGINT"


def _periods_sql(index: str, full: float, least: int) -> str:
    return f"""{LONG},
    stepped AS (SELECT *, level - lag(level) OVER (PARTITION BY entity_id ORDER BY obs_date) AS change, {index} AS period_index FROM long_panel),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY entity_id, period_index ORDER BY obs_date) - 1 AS k FROM stepped),
    grained AS (
        SELECT entity_id, period_index, count(*) AS days_observed, min(obs_date) AS period_start, max(obs_date) AS period_end, max_by(level, obs_date) AS last_level, min_by(level, obs_date) AS first_level,
               avg(level) AS mean_level, max(level) AS max_level, min(level) AS min_level, stddev_samp(level) AS sd_level, regr_slope(level, k) AS slope,
               avg(change) AS change_mean, stddev_samp(change) AS change_sd, max(abs(change)) AS change_max_abs, count(*) / {full} AS coverage
        FROM numbered GROUP BY 1, 2 HAVING count(*) >= {least})"""


GRAIN_COLUMNS = ("entity_id", "period_index", "days_observed", "period_start", "period_end")
GRAIN_DOUBLES = ("last_level", "first_level", "mean_level", "max_level", "min_level", "sd_level", "slope", "change_mean", "change_sd", "change_max_abs", "coverage")
GRAIN_SELECT = ", ".join(GRAIN_COLUMNS) + ", " + ", ".join(f"round({c}, 6) AS {c}" for c in GRAIN_DOUBLES)
WEEKS, MONTHS = _periods_sql(WEEK_SQL, 7.0, 5), _periods_sql(MONTH_SQL, 30.4375, 20)


def grained(spark: SparkSession, sf_dir: str, period: str, by: str = "n_regionkey") -> DataFrame:
    rows = history.neighbours(long_panel(spark, sf_dir, by)).withColumn("change", F.col("level") - F.col("previous_level"))
    return periods.aggregated(rows.select("entity_id", "obs_date", "level", "change"), period).drop("period")


@query(f"WITH {WEEKS} SELECT {GRAIN_SELECT} FROM grained")
def week_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grained(spark, sf_dir, "week")


@query(f"WITH {MONTHS} SELECT {GRAIN_SELECT} FROM grained")
def month_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grained(spark, sf_dir, "month")


@query(f"WITH {WEEKS} SELECT entity_id, period_index, round(slope, 6) AS slope, days_observed FROM grained WHERE days_observed = 7")
def within_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grained(spark, sf_dir, "week").where("days_observed = 7").select("entity_id", "period_index", "slope", "days_observed")


def _features_sql(base: str) -> str:
    return f"""{base},
    shifted AS (
        SELECT *, mean_level AS period_level, CASE WHEN period_index - lag(period_index) OVER w = 1 THEN lag(mean_level) OVER w END AS previous_period_level,
               CASE WHEN lead(period_index) OVER w - period_index = 1 THEN lead(mean_level) OVER w - mean_level END AS target,
               CASE WHEN lead(period_index) OVER w - period_index = 1 THEN lead(period_end) OVER w END AS target_period_end,
               CASE WHEN period_index - lag(period_index) OVER w = 1 THEN lag(days_observed) OVER w END AS previous_days_observed,
               abs(mean_level - lag(mean_level) OVER w) AS step
        FROM grained WINDOW w AS (PARTITION BY entity_id ORDER BY period_index)),
    changed AS (SELECT *, period_level - previous_period_level AS period_change FROM shifted),
    features AS (
        SELECT *, CASE WHEN period_index - lag(period_index) OVER w = 1 THEN lag(period_change) OVER w END AS previous_period_change,
               CASE WHEN count(period_change) OVER r >= 2 THEN avg(period_change) OVER r END AS rolling_change, CASE WHEN count(period_change) OVER r >= 2 THEN stddev_samp(period_change) OVER r END AS rolling_change_sd,
               CASE WHEN count(period_level) OVER r >= 2 THEN avg(period_level) OVER r END AS rolling_level, median(step) OVER (PARTITION BY entity_id) AS entity_change_mad,
               year(period_end) AS year, month(period_end) AS month, weekofyear(period_end) AS week_of_year
        FROM changed WINDOW w AS (PARTITION BY entity_id ORDER BY period_index), r AS (PARTITION BY entity_id ORDER BY period_index ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""


FEATURES = _features_sql(WEEKS)
FEATURE_DOUBLES = ("period_level", "previous_period_level", "target", "period_change", "previous_period_change", "rolling_change", "rolling_change_sd", "rolling_level", "entity_change_mad")


@query(
    f"""WITH {FEATURES} SELECT entity_id, period_index, target_period_end, previous_days_observed, {", ".join(f"round({c}, 6) AS {c}" for c in FEATURE_DOUBLES)}, year, month, week_of_year,
        round(period_level - rolling_level, 6) AS minus_rolling, round(period_change - rolling_change, 6) AS change_minus_rolling, round(sin(2 * pi() * dayofyear(period_end) / 365.25), 6) AS sin_year,
        round(cos(2 * pi() * dayofyear(period_end) / 365.25), 6) AS cos_year FROM features"""
)
def period_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periods.with_features(grained(spark, sf_dir, "week"))
    return out.select("entity_id", "period_index", "target_period_end", "previous_days_observed", *FEATURE_DOUBLES, "year", "month", "week_of_year", "minus_rolling", "change_minus_rolling", "sin_year", "cos_year")


@query(f"WITH {FEATURES} SELECT entity_id, period_index, previous_period_level IS NOT NULL AS has_previous, target IS NOT NULL AS has_next, round(rolling_level, 6) AS rolling_level FROM features")
def contiguous_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which periods have adjacent neighbours, and the rolling mean that needs two rows."""
    out = periods.with_features(grained(spark, sf_dir, "week"))
    return out.select("entity_id", "period_index", F.col("previous_period_level").isNotNull().alias("has_previous"), F.col("target").isNotNull().alias("has_next"), "rolling_level")


@query(
    f"""WITH {LONG}, sizes AS (SELECT entity_id, {WEEK_SQL} AS i, count(*) AS n FROM long_panel GROUP BY 1, 2),
        gated AS (SELECT *, coalesce(lead(i) OVER w - i = 1, false) AS nx, coalesce(i - lag(i) OVER w = 1, false) AS pv FROM sizes WHERE n >= 5 WINDOW w AS (PARTITION BY entity_id ORDER BY i)),
        long AS (SELECT unnest(range(5)) AS step, unnest(['daily rows', 'entity-weeks', 'coverage', 'next period adjacent', 'previous period adjacent']) AS label,
            unnest([(SELECT sum(n)::BIGINT FROM sizes), (SELECT count(*) FROM sizes), (SELECT count(*) FROM gated), (SELECT count(*) FROM gated WHERE nx), (SELECT count(*) FROM gated WHERE nx AND pv)]) AS rows_remaining)
        SELECT step, label, rows_remaining, coalesce(lag(rows_remaining) OVER (ORDER BY step) - rows_remaining, 0) AS rows_dropped FROM long"""
)
def coverage_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.waterfall(long_panel(spark, sf_dir), "week")


def _anchor_sql(anchor: str, column: str) -> str:
    return f"""SELECT '{anchor}' AS anchor, count(*) AS n, round(stddev_samp(t), 6) AS target_sd, round(avg(abs(t)), 6) AS zero_mae FROM (
        SELECT CASE WHEN lead(period_index) OVER w - period_index = 1 THEN lead({column}) OVER w - {column} END AS t FROM grained WINDOW w AS (PARTITION BY entity_id ORDER BY period_index)) WHERE t IS NOT NULL"""


@query(f"WITH {WEEKS} {_anchor_sql('mean', 'mean_level')} UNION ALL {_anchor_sql('last', 'last_level')}")
def anchor_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.anchor_comparison(long_panel(spark, sf_dir))


def _resets_sql(kind: str) -> str:
    return f"""SELECT *, '{kind}' AS event_type FROM (
        SELECT entity_id, obs_date, v, lag(v) OVER w AS b, lag(obs_date) OVER w AS previous_date, count(*) OVER (PARTITION BY entity_id) AS n,
               (lead(v) OVER w - v) / nullif(date_diff('day', obs_date, lead(obs_date) OVER w), 0) AS rise
        FROM (SELECT entity_id, obs_date, {kind}_last_dif AS v FROM daily WHERE {kind}_last_dif IS NOT NULL) WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date))"""


RESETS = f"""{DAILY}, counters AS ({_resets_sql("purchase")} UNION ALL {_resets_sql("error")}),
    scaled AS (SELECT *, median(CASE WHEN rise > 0 THEN rise END) OVER (PARTITION BY event_type, entity_id ORDER BY obs_date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS scale_per_day FROM counters),
    resets AS (
        SELECT entity_id, event_type, obs_date AS observed_on, previous_date, date_diff('day', previous_date, obs_date) AS gap_days, v AS counter_value, scale_per_day, v / nullif(scale_per_day, 0) AS days_since,
               CAST(obs_date AS TIMESTAMP) - to_seconds(CAST(round(coalesce(least(v / nullif(scale_per_day, 0), 3650.0), 0) * 86400) AS BIGINT)) AS event_time,
               month(obs_date) = 1 AND day(obs_date) <= 2 AS year_boundary
        FROM scaled WHERE n >= 3 AND v < b * 0.95),
    accepted AS (SELECT *, coalesce(days_since <= gap_days + 1, false) AND NOT year_boundary AS accepted FROM resets)"""


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = daily(spark, sf_dir)
    return events.resets(panel, "purchase_last_dif", "purchase").unionByName(events.resets(panel, "error_last_dif", "error"))


@query(f"WITH {RESETS} SELECT entity_id, event_type, observed_on, previous_date, gap_days, counter_value, round(scale_per_day, 6) AS scale_per_day, round(days_since, 6) AS days_since, event_time, year_boundary, accepted FROM accepted")
def counter_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logged(spark, sf_dir)


MONTH_COUNTS = ", ".join(f"count(*) FILTER (WHERE accepted AND month(observed_on) = {m}) AS m{m:02d}" for m in range(1, 13))


@query(
    f"""WITH {RESETS}, c AS (SELECT event_type, count(*) AS resets, count(*) FILTER (WHERE accepted) AS n_accepted, count(DISTINCT entity_id) FILTER (WHERE accepted) AS entities, {MONTH_COUNTS} FROM accepted GROUP BY 1)
        SELECT *, CASE WHEN n_accepted > 0 THEN list_position([{", ".join(f"m{m:02d}" for m in range(1, 13))}], greatest({", ".join(f"m{m:02d}" for m in range(1, 13))}))::BIGINT END AS peak_month FROM c"""
)
def event_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.calendar(logged(spark, sf_dir))


#: Steps of the stand-in panel: drops of 10 that hold for 3 rows.
STEP = {"sustain_rows": 3, "sustain_share": 0.6}
STEPS = """steps AS (
    SELECT entity_id, obs_date, level, before - level AS removed, before, after, month(obs_date) AS month FROM (
        SELECT *, lag(level) OVER w AS before, lead(level, 3) OVER w AS after, date_diff('day', lag(obs_date) OVER w, obs_date) AS gap FROM {source} WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date))
    WHERE gap = 1 AND before - after >= 0.6 * (before - level) {flags})"""
LONG_STEPS = STEPS.format(source="long_panel", flags="")


@query(f"WITH {HISTORY}, {STEPS.format(source='flagged', flags='AND NOT dropout AND NOT implausible')} SELECT entity_id, obs_date, level, round(removed, 6) AS removed, before, after, month FROM steps WHERE removed >= 10")
def step_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.step_downs(flagged(spark, sf_dir), 10.0, **STEP)


@query(
    f"""WITH {LONG}, {LONG_STEPS.replace("level, 3)", "level, 7)")}, cuts AS (SELECT unnest([50.0, 100.0, 200.0, 400.0])::DOUBLE AS threshold)
        SELECT threshold, count(removed) AS n, count(DISTINCT entity_id) AS entities, round(median(removed), 6) AS median_removed, round(coalesce(sum(removed), 0), 6) AS total_removed,
               round(avg(CASE WHEN removed IS NOT NULL THEN (month BETWEEN 5 AND 8)::INT END), 6) AS share_may_to_aug FROM cuts LEFT JOIN steps ON removed >= threshold GROUP BY 1"""
)
def removal_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.threshold_sweep(long_panel(spark, sf_dir), (50, 100, 200, 400))


@query(
    f"""WITH {RESETS}, {STEPS.format(source="daily", flags="")}, logs AS (SELECT entity_id, observed_on AS day FROM accepted WHERE accepted AND event_type = 'purchase'), drops AS (SELECT entity_id, obs_date AS day FROM steps WHERE removed >= 10),
        cuts AS (SELECT unnest([1, 3, 7, 14])::BIGINT AS tolerance_days),
        pairs AS (
            SELECT 'logged' AS kind, l.entity_id, l.day, min(abs(date_diff('day', l.day, d.day))) AS distance FROM logs l LEFT JOIN drops d ON l.entity_id = d.entity_id GROUP BY 1, 2, 3
            UNION ALL SELECT 'drop', d.entity_id, d.day, min(abs(date_diff('day', l.day, d.day))) FROM drops d JOIN logs l ON l.entity_id = d.entity_id GROUP BY 1, 2, 3)
        SELECT tolerance_days, kind, count(*) AS n, count(*) FILTER (WHERE distance <= tolerance_days) AS matched, round(avg(coalesce(distance <= tolerance_days, false)::INT), 6) AS share FROM pairs, cuts GROUP BY 1, 2"""
)
def corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = daily(spark, sf_dir)
    return events.corroboration(events.resets(panel, "purchase_last_dif", "purchase"), events.step_downs(panel, 10.0, **STEP))


GROSS = f"""{FEATURES}, {LONG_STEPS.replace("level, 3)", "level, 7)")}, mass AS (SELECT entity_id, {WEEK_SQL} AS period_index, sum(removed) AS removed FROM steps WHERE removed >= 100 GROUP BY 1, 2),
    met AS (SELECT f.*, coalesce(m.removed, 0) AS removed_in_period FROM features f LEFT JOIN mass m ON f.entity_id = m.entity_id AND f.period_index = m.period_index),
    gross AS (SELECT *, CASE WHEN lead(period_index) OVER w - period_index = 1 THEN lead(removed_in_period) OVER w END AS removed_next FROM met WINDOW w AS (PARTITION BY entity_id ORDER BY period_index))"""


def gross(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = long_panel(spark, sf_dir)
    return events.gross_target(periods.with_features(grained(spark, sf_dir, "week")), events.step_downs(panel, 100.0))


@query(f"WITH {GROSS} SELECT entity_id, period_index, round(target, 6) AS target, round(removed_in_period, 6) AS removed_in_period, round(removed_next, 6) AS removed_next, round(target + removed_next, 6) AS gross_target FROM gross")
def gross_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gross(spark, sf_dir).select("entity_id", "period_index", "target", "removed_in_period", "removed_next", "gross_target")


@query(
    f"""WITH {GROSS}, g AS (SELECT *, target + removed_next AS gt FROM gross WHERE target IS NOT NULL AND removed_next IS NOT NULL), s AS (SELECT 'all' AS segment, * FROM g UNION ALL SELECT 'may_to_aug', * FROM g WHERE month BETWEEN 5 AND 8)
        SELECT segment, count(*) AS n, round(avg((removed_next > 0)::INT), 6) AS share_touched, round(avg(target), 6) AS net_mean, round(avg(gt), 6) AS gross_mean, round(stddev_samp(target), 6) AS net_sd, round(stddev_samp(gt), 6) AS gross_sd,
               round(avg(gt - target), 6) AS mean_shift, round(corr(target, gt), 6) AS correlation FROM s GROUP BY 1"""
)
def target_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.target_comparison(gross(spark, sf_dir))


SITES = """site_days AS (
    SELECT 47 + (user_id % 34) / 10 AS latitude, 8 + (user_id % 7) / 10 AS longitude, CAST(ts AS DATE) AS obs_date, max(value) AS tmax, count(*) AS readings FROM events WHERE event_type = 'view' GROUP BY 1, 2, 3)"""


def site_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "events").where("event_type = 'view'")
    return views.groupBy((47 + (F.col("user_id") % 34) / 10).alias("latitude"), (8 + (F.col("user_id") % 7) / 10).alias("longitude"), F.to_date("ts").alias("obs_date")).agg(F.max("value").alias("tmax"), F.count(F.lit(1)).alias("readings"))


ON_SITE = "round(d.latitude * 10) = round(s.latitude * 10) AND round(d.longitude * 10) = round(s.longitude * 10) AND d.obs_date = s.obs_date"


@query(f"WITH {DAILY}, {SITES} SELECT d.entity_id, d.obs_date, d.level, s.tmax, s.readings FROM daily d LEFT JOIN site_days s ON {ON_SITE}")
def site_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.with_site_days(daily(spark, sf_dir), site_days(spark, sf_dir), None).select("entity_id", "obs_date", "level", "tmax", "readings")


@query(
    f"""WITH {DAILY}, g AS (SELECT CAST(round(latitude * 10) AS BIGINT) AS lat_10, CAST(round(longitude * 10) AS BIGINT) AS lon_10, count(DISTINCT entity_id) AS entities, count(*) AS n FROM daily GROUP BY 1, 2)
        SELECT *, row_number() OVER (ORDER BY lat_10, lon_10) AS site_id FROM g"""
)
def site_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.sites(daily(spark, sf_dir))


STATION_LINES = "SELECT DISTINCT user_id, lpad(user_id::VARCHAR, 11, 'S') || ' ' || lpad(CAST(47000 + (user_id % 34) * 100 AS VARCHAR), 8, ' ') || ' ' || lpad(CAST(8000 + (user_id % 7) * 100 AS VARCHAR), 9, ' ') || ' ' || rpad('', 10, ' ') || ' ' || 'STATION ' || user_id AS line FROM events"


@query(f"SELECT trim(substr(line, 1, 11)) AS station, try_cast(trim(substr(line, 13, 8)) AS DOUBLE) AS latitude, try_cast(trim(substr(line, 22, 9)) AS DOUBLE) AS longitude, trim(substr(line, 43, 30)) AS name FROM ({STATION_LINES})")
def fixed_width_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width station lines to columns."""
    u = F.col("user_id")
    line = F.concat(
        F.lpad(u.cast("string"), 11, "S"), F.lit(" "), F.lpad((47000 + (u % 34) * 100).cast("string"), 8, " "), F.lit(" "), F.lpad((8000 + (u % 7) * 100).cast("string"), 9, " "), F.lit(" " * 12 + "STATION "), u.cast("string")
    )
    return payloads.fixed_width(table(spark, sf_dir, "events").select("user_id").distinct().select(line.alias("value")), payloads.STATION)


@query(
    """WITH stations AS (SELECT DISTINCT user_id, 47 + (user_id % 34) / 10 AS latitude, 8 + (user_id % 7) / 10 AS longitude FROM events)
       SELECT e.event_id, e.user_id, e.value FROM events e JOIN stations s ON e.user_id = s.user_id WHERE latitude BETWEEN 48 AND 49.05 AND longitude BETWEEN 8 AND 8.35"""
)
def station_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of the stations in a box."""
    rows = table(spark, sf_dir, "events")
    stations = rows.select("user_id").distinct().select("user_id", (47 + (F.col("user_id") % 34) / 10).alias("latitude"), (8 + (F.col("user_id") % 7) / 10).alias("longitude"))
    inside = enrich.in_box(stations, 48, 49.05, 8, 8.35).select("user_id")
    return enrich.station_days(rows.select("event_id", "user_id", "value"), inside, "user_id").select("event_id", "user_id", "value")


@query("SELECT CAST(ts AS DATE) AS obs_date, round(sum(CAST(round(value * 100) AS BIGINT)) / 100.0 / count(*), 2) AS mean_value, count(DISTINCT user_id) AS n_stations FROM events GROUP BY 1")
def regional_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "value", F.to_date("ts").alias("obs_date"))
    return enrich.regional_days(rows, "value", "user_id", "obs_date")


@query(
    f"""WITH {FEATURES}, weather AS (SELECT entity_id, {WEEK_SQL} AS period_index, avg(level) AS level_mean, max(level) AS level_max, sum(level) AS level_sum FROM long_panel GROUP BY 1, 2),
        met AS (SELECT f.entity_id, f.period_index, level_mean, level_max, level_sum FROM features f LEFT JOIN weather w ON f.entity_id = w.entity_id AND f.period_index = w.period_index)
        SELECT entity_id, period_index, round(level_mean, 6) AS level_mean, round(level_max, 6) AS level_max, round(level_sum, 6) AS level_sum,
               round(CASE WHEN lead(period_index) OVER p - period_index = 1 THEN lead(level_mean) OVER p END, 6) AS next_level_mean FROM met WINDOW p AS (PARTITION BY entity_id ORDER BY period_index)"""
)
def period_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = periods.with_features(grained(spark, sf_dir, "week")).select("entity_id", "period_index")
    out = enrich.period_weather(features, long_panel(spark, sf_dir), {"level": ("mean", "max", "sum")}, lookahead=True)
    return out.drop("next_level_max", "next_level_sum")


#: Stand-in weather of each day, from the lines shipped on it.
WEATHER = """weather_days AS (
    SELECT CAST(l_shipdate AS DATE) AS obs_date, max(CAST(l_quantity AS BIGINT)) / 2.0::DOUBLE AS temperature_2m_max, min(CAST(l_quantity AS BIGINT)) / 2.0::DOUBLE AS temperature_2m_min,
           (sum(CAST(l_quantity AS BIGINT))::BIGINT * 10 // count(*)) / 40.0::DOUBLE AS temperature_2m_mean, (count(*) % 7) / 2.0::DOUBLE AS precipitation_sum, (count(*) % 11)::DOUBLE AS precipitation_hours,
           (sum(l_linenumber)::BIGINT % 13) * 3600.0::DOUBLE AS sunshine_duration, (sum(l_linenumber)::BIGINT % 29)::DOUBLE AS shortwave_radiation_sum, max(l_linenumber)::DOUBLE AS wind_speed_10m_max,
           (count(*) % 5)::DOUBLE AS et0_fao_evapotranspiration FROM lineitem GROUP BY 1),
weather_full AS (
    SELECT *, greatest(temperature_2m_mean - 10, 0) AS growing_degree_days_10c, sunshine_duration / 3600 AS foraging_hours_proxy,
           coalesce(temperature_2m_max > 12 AND precipitation_sum < 1, false)::INT::DOUBLE AS is_foraging_day FROM weather_days)"""


def weather_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("obs_date")).agg(
        (F.expr("max(cast(l_quantity as bigint))") / 2.0).alias("temperature_2m_max"), (F.expr("min(cast(l_quantity as bigint))") / 2.0).alias("temperature_2m_min"),
        F.expr("(sum(cast(l_quantity as bigint)) * 10 div count(*)) / 40D").alias("temperature_2m_mean"), F.expr("(count(*) % 7) / 2D").alias("precipitation_sum"), F.expr("cast(count(*) % 11 as double)").alias("precipitation_hours"),
        F.expr("(sum(cast(l_linenumber as bigint)) % 13) * 3600D").alias("sunshine_duration"), F.expr("cast(sum(cast(l_linenumber as bigint)) % 29 as double)").alias("shortwave_radiation_sum"),
        F.expr("cast(max(l_linenumber) as double)").alias("wind_speed_10m_max"), F.expr("cast(count(*) % 5 as double)").alias("et0_fao_evapotranspiration"),
    )
    return enrich.derived(days)


SQL_STATISTICS = {"mean": "avg", "sum": "sum", "max": "max", "min": "min", "std": "stddev_samp"}
WEATHER_NAMES = enrich.period_names()
WEATHER_WEEKS = f"""{FEATURES}, {WEATHER},
weekly AS (SELECT p.entity_id, {WEEK_SQL.replace("obs_date", "p.obs_date")} AS period_index, {", ".join(f"{SQL_STATISTICS[how]}({c}) AS {c}_{how}" for c, hows in enrich.PERIOD_AGGREGATIONS.items() for how in hows)}
    FROM long_panel p LEFT JOIN weather_full x ON p.obs_date = x.obs_date GROUP BY 1, 2),
met AS (SELECT f.entity_id, f.period_index, f.target, {", ".join(WEATHER_NAMES)} FROM features f LEFT JOIN weekly w ON f.entity_id = w.entity_id AND f.period_index = w.period_index),
ahead AS (SELECT *, {", ".join(f"CASE WHEN lead(period_index) OVER p - period_index = 1 THEN lead({c}) OVER p END AS next_{c}" for c in WEATHER_NAMES)} FROM met WINDOW p AS (PARTITION BY entity_id ORDER BY period_index))"""


def weather_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = periods.with_features(grained(spark, sf_dir, "week")).select("entity_id", "period_index", "target")
    days = long_panel(spark, sf_dir).select("entity_id", "obs_date").join(weather_days(spark, sf_dir), "obs_date", "left")
    return enrich.period_weather(features, days, enrich.PERIOD_AGGREGATIONS, lookahead=True)


@query(f"WITH {WEATHER_WEEKS} SELECT entity_id, period_index, {', '.join(f'round({c}, 6) AS {c}' for c in WEATHER_NAMES)}, round(next_precipitation_sum_sum, 6) AS next_precipitation_sum_sum FROM ahead")
def weather_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen weather features of each week, and the next week's rain."""
    return weather_weeks(spark, sf_dir).select("entity_id", "period_index", *WEATHER_NAMES, "next_precipitation_sum_sum")


def _rank_sql(feature: str) -> str:
    return f"""(SELECT count(*) AS n, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) AS rho FROM (
        SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry
        FROM (SELECT round({feature}, 9) AS x, target AS y FROM ahead WHERE {feature} IS NOT NULL AND target IS NOT NULL)))"""


@query(f"WITH {WEATHER_WEEKS} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, a.rho AS rho_current, b.rho AS rho_next, b.n AS n_next FROM {_rank_sql(c)} a, {_rank_sql(f'next_{c}')} b" for c in WEATHER_NAMES))
def weather_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of the sixteen weather features, this week's and next week's, with the target."""
    rows = weather_weeks(spark, sf_dir)
    rounded = rows.select("target", *[F.round(c, 9).alias(c) for name in WEATHER_NAMES for c in (name, f"next_{name}")])
    return enrich.weather_correlation(rounded)


@query(
    f"""WITH {DAILY}, {SITES}, j AS (SELECT d.outside_temp, s.tmax FROM daily d LEFT JOIN site_days s ON {ON_SITE})
        SELECT 'outside_temp' AS column_name, round(100.0 * avg((outside_temp IS NOT NULL)::INT), 6) AS pct_present, round(avg(outside_temp), 6) AS mean, round(stddev_samp(outside_temp), 6) AS sd FROM j
        UNION ALL SELECT 'tmax', round(100.0 * avg((tmax IS NOT NULL)::INT), 6), round(avg(tmax), 6), round(stddev_samp(tmax), 6) FROM j"""
)
def weather_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.coverage(enrich.with_site_days(daily(spark, sf_dir), site_days(spark, sf_dir), None), ["outside_temp", "tmax"])


@query(
    f"""WITH {SITES} SELECT CAST(round(latitude * 10) AS BIGINT) AS lat_10, CAST(round(longitude * 10) AS BIGINT) AS lon_10, count(DISTINCT obs_date) AS n_days FROM site_days GROUP BY 1, 2 HAVING count(DISTINCT obs_date) <> 30"""
)
def incomplete_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.incomplete_sites(site_days(spark, sf_dir), 30)


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events")
def json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columnar JSON payloads of up to a thousand events, built and read back as rows."""
    rows = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    payload = rows.groupBy(F.expr("event_id div 1000").alias("g")).agg(F.sort_array(F.collect_list(F.struct("event_id", "k"))).alias("r"))
    text = payload.select(F.to_json(F.struct(F.struct(F.expr("transform(r, x -> x.event_id)").alias("event_id"), F.expr("transform(r, x -> x.k)").alias("k")).alias("daily"))).alias("value"))
    return payloads.columnar(text, "value", {"event_id": "bigint", "k": "bigint"})


EXTREME = "abs(target) > 60"


def _proximity_sql(kind: str) -> str:
    return f"SELECT CASE WHEN {EXTREME} THEN 'extreme' ELSE 'routine' END AS \"group\", '{kind}' AS event_type, least(abs({kind}_last_dif), abs({kind}_next_dif)) AS days FROM flagged"


@query(
    f"""WITH {HISTORY}, long AS ({_proximity_sql("purchase")} UNION ALL {_proximity_sql("error")})
        SELECT "group", event_type, count(*) AS n, count(days) AS n_logged, round(median(days), 6) AS median_days, round(100.0 * avg(CASE WHEN days IS NOT NULL THEN (days <= 1)::INT END), 6) AS pct_within_1,
               round(100.0 * avg(CASE WHEN days IS NOT NULL THEN (days <= 7)::INT END), 6) AS pct_within_7 FROM long GROUP BY 1, 2"""
)
def event_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.functions import columns as C

    rows = held(flagged(spark, sf_dir)).withColumns({k: C.nearest(F.col(f"{k}_last_dif"), F.col(f"{k}_next_dif")) for k in ("purchase", "error")})
    return extremes.proximity(rows, F.col("extreme_60"), {"purchase": "purchase", "error": "error"})


@query(
    f"""WITH {HISTORY} SELECT obs_date, count(*) FILTER (WHERE {EXTREME}) AS n_extreme, count(DISTINCT entity_id) FILTER (WHERE {EXTREME}) AS affected, count(DISTINCT entity_id) AS reporting,
        round(count(DISTINCT entity_id) FILTER (WHERE {EXTREME}) / count(DISTINCT entity_id), 6) AS share FROM flagged GROUP BY 1 HAVING count(*) FILTER (WHERE {EXTREME}) > 0"""
)
def date_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extremes.date_clusters(flagged(spark, sf_dir), F.col("extreme_60"))


LONG_TARGET = f"""{LONG}, shifted AS (SELECT *, lag(level) OVER w AS previous_level, lead(level) OVER w AS next_level, lag(obs_date) OVER w AS pd, lead(obs_date) OVER w AS nd FROM long_panel WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date)),
    targets AS (SELECT entity_id, obs_date, level, previous_level, next_level, level - previous_level AS change, next_level - level AS target FROM shifted WHERE date_diff('day', pd, obs_date) = 1 AND date_diff('day', obs_date, nd) = 1 AND previous_level > 0 AND level > 0 AND next_level > 0)"""


def long_targets(spark: SparkSession, sf_dir: str, by: str = "n_regionkey") -> DataFrame:
    """The gated long panel with change and target."""
    rows = history.neighbours(long_panel(spark, sf_dir, by)).withColumns({"change": F.col("level") - F.col("previous_level"), "target": F.col("next_level") - F.col("level")})
    return rows.where(history.gate()).select("entity_id", "obs_date", "level", "previous_level", "next_level", "change", "target")


@query(
    f"""WITH {LONG_TARGET} SELECT month(obs_date) AS month, count(*) AS n, count(*) FILTER (WHERE abs(target) > 200) AS n_extreme, count(*) FILTER (WHERE abs(target) > 200 AND target < 0) AS n_loss,
        count(*) FILTER (WHERE abs(target) > 200 AND target >= 0) AS n_gain, round(100.0 * count(*) FILTER (WHERE abs(target) > 200) / count(*), 6) AS pct_extreme FROM targets GROUP BY 1"""
)
def monthly_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extremes.monthly_rate(long_targets(spark, sf_dir), F.abs("target") > 200)


@query(
    f"""WITH {HISTORY}, e AS (SELECT * FROM flagged WHERE {EXTREME}) SELECT unnest(['implausible', 'robust_outlier', 'dropout', 'any']) AS flag,
        unnest([count(*) FILTER (WHERE implausible), count(*) FILTER (WHERE robust_outlier), count(*) FILTER (WHERE dropout), count(*) FILTER (WHERE implausible OR robust_outlier OR dropout)]) AS n,
        unnest([round(100.0 * count(*) FILTER (WHERE implausible) / count(*), 6), round(100.0 * count(*) FILTER (WHERE robust_outlier) / count(*), 6), round(100.0 * count(*) FILTER (WHERE dropout) / count(*), 6),
                round(100.0 * count(*) FILTER (WHERE implausible OR robust_outlier OR dropout) / count(*), 6)]) AS pct FROM e"""
)
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extremes.attribution(flagged(spark, sf_dir), F.col("extreme_60"), ["implausible", "robust_outlier", "dropout"])


@query(
    f"""WITH {DAILY}, s AS (SELECT lead(level) OVER w - level AS a, lead(c) OVER w - c AS b FROM (SELECT *, CASE WHEN level <= 150 THEN level END AS c FROM daily) WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date))
        SELECT count(a) AS n, count(*) FILTER (WHERE abs(a) > 60) AS n_raw, count(*) FILTER (WHERE abs(b) > 60) AS n_cleaned, count(*) FILTER (WHERE abs(a) > 60 AND NOT coalesce(abs(b) > 60, false)) AS n_removed, round(corr(a, b), 6) AS correlation FROM s"""
)
def series_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily(spark, sf_dir).withColumn("cleaned", F.when(F.col("level") <= 150, F.col("level")))
    return extremes.series_comparison(rows, "level", "cleaned", 60)


@query(
    f"""WITH {HISTORY}, cuts AS (SELECT unnest([30.0, 60.0, 90.0, 120.0])::DOUBLE AS cut) SELECT cut, count(target) AS n, count(*) FILTER (WHERE abs(target) > cut) AS positives,
        round(count(*) FILTER (WHERE abs(target) > cut) / count(target), 6) AS rate, round(cut / stddev_samp(target), 6) AS cut_in_sd FROM gated, cuts GROUP BY 1"""
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extremes.class_balance(flagged(spark, sf_dir), (30, 60, 90, 120))


RELATIVE = f"""{FEATURES}, r AS (SELECT entity_id, target, entity_change_mad AS scale, period_level AS level FROM features WHERE target IS NOT NULL)"""


def relative_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periods.with_features(grained(spark, sf_dir, "week")).where("target is not null")
    return rows.select("entity_id", "target", F.col("entity_change_mad").alias("scale"), F.col("period_level").alias("level"))


@query(
    f"""WITH {RELATIVE}, m AS (SELECT unnest([0.5, 1.0, 2.0, 3.0])::DOUBLE AS multiplier), e AS (SELECT multiplier, entity_id, any_value(scale) AS scale, count(*) AS n, count(*) FILTER (WHERE coalesce(abs(target) > multiplier * scale, false)) AS p FROM r, m GROUP BY 1, 2)
        SELECT m.multiplier, sum(p)::BIGINT AS positives, count(*) FILTER (WHERE p > 0) AS entities, round(m.multiplier * median(scale), 6) AS median_threshold, round(sum(p) / sum(n), 6) AS rate FROM m LEFT JOIN e ON m.multiplier = e.multiplier GROUP BY 1"""
)
def relative_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extremes.relative_sweep(relative_rows(spark, sf_dir), (0.5, 1, 2, 3))


@query(
    f"""WITH {RELATIVE}, f AS (SELECT entity_id, level, abs(target) > 100 AS a, coalesce(abs(target) > 2 * scale, false) AS b FROM r), long AS (SELECT 'absolute' AS rule, entity_id, level, a AS flag FROM f UNION ALL SELECT 'relative', entity_id, level, b FROM f),
        c AS (SELECT rule, entity_id, count(*) FILTER (WHERE flag) AS n FROM long GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY n DESC, entity_id) AS k FROM c)
        SELECT t.rule, sum(n)::BIGINT AS positives, count(*) FILTER (WHERE n > 0) AS entities_with, count(*) FILTER (WHERE n = 0) AS entities_without, max(n) AS most, round(sum(n) FILTER (WHERE k <= 5) / sum(n), 6) AS top5_share,
               any_value(m.median_level) AS median_level, (SELECT count(*) FROM f WHERE a AND b) AS agreement
        FROM t LEFT JOIN (SELECT rule, round(median(level), 6) AS median_level FROM long WHERE flag GROUP BY 1) m ON t.rule = m.rule GROUP BY 1"""
)
def label_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extremes.label_comparison(relative_rows(spark, sf_dir), 100.0, 2.0)


@query(f"WITH {RELATIVE} SELECT round(quantile_cont(coalesce(abs(target) / nullif(scale, 0), 0), 0.95), 6) AS multiplier FROM r")
def rate_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extremes.matched_multiplier(relative_rows(spark, sf_dir), 0.05)


@query(f"WITH {HISTORY} SELECT round(2.7 * stddev_samp(target), 6) AS threshold FROM gated")
def sd_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extremes.sd_threshold(history.model_table(daily(spark, sf_dir), **FLAGS))
