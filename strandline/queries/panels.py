"""Typing, windows, the modelling table, and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.operators import audit, history
from strandline.queries.base import DAILY, HISTORY, LONG, daily, flagged, long_panel, query, table


@query(
    f"""WITH {HISTORY}
    SELECT entity_id, obs_date, level, previous_level, next_level, previous_date, next_date, round(lag_2, 6) AS lag_2, round(lag_7, 6) AS lag_7,
           round(mean_3, 6) AS mean_3, round(mean_7, 6) AS mean_7, round(sd_7, 6) AS sd_7, round(local_median, 6) AS local_median,
           round(entity_median, 6) AS entity_median, round(entity_mad, 6) AS entity_mad, round(change_mad, 6) AS change_mad,
           round(change, 6) AS change, round(target, 6) AS target, round(minus_mean_7, 6) AS minus_mean_7, round(minus_mean_3, 6) AS minus_mean_3,
           round(slope_2, 6) AS slope_2, round(slope_7, 6) AS slope_7, round(minus_entity_median, 6) AS minus_entity_median, year, month, day_of_year,
           round(sin_day_of_year, 6) AS sin_day_of_year, round(cos_day_of_year, 6) AS cos_day_of_year, outside_temp, humidity,
           round(target_mad, 6) AS target_mad, extreme_30, extreme_60, extreme_120, extreme_relative, implausible, robust_outlier, dropout,
           least(abs(purchase_last_dif), abs(purchase_next_dif)) AS nearest_purchase, least(abs(error_last_dif), abs(error_next_dif)) AS nearest_error
    FROM flagged"""
)
def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: raw readings to the gated, flagged daily modelling table."""
    out = flagged(spark, sf_dir).withColumns({f"nearest_{k}": C.nearest(F.col(f"{k}_last_dif"), F.col(f"{k}_next_dif")) for k in ("purchase", "error")})
    return out.select(
        "entity_id", "obs_date", "level", "previous_level", "next_level", "previous_date", "next_date", "lag_2", "lag_7", "mean_3", "mean_7", "sd_7", "local_median", "entity_median",
        "entity_mad", "change_mad", "change", "target", "minus_mean_7", "minus_mean_3", "slope_2", "slope_7", "minus_entity_median", "year", "month", "day_of_year", "sin_day_of_year",
        "cos_day_of_year", "outside_temp", "humidity", "target_mad", "extreme_30", "extreme_60", "extreme_120", "extreme_relative", "implausible", "robust_outlier", "dropout",
        "nearest_purchase", "nearest_error",
    )


@query(
    """SELECT event_id, try_cast(nullif(CASE WHEN event_id % 7 = 0 THEN 'NA' WHEN event_id % 11 = 0 THEN 'x' || value ELSE value::VARCHAR END, 'NA') AS DOUBLE) AS value,
              try_cast(regexp_extract('/years/' || user_id || CASE WHEN event_id % 5 = 0 THEN '.txt' ELSE '.csv' END, '([^/\\\\]+)\\.csv$', 1) AS INTEGER) AS entity_id,
              regexp_extract('/years/' || user_id || CASE WHEN event_id % 5 = 0 THEN '.txt' ELSE '.csv' END, '[^\\\\/]+$') AS file_name, CAST(ts AS DATE) AS obs_date
       FROM events"""
)
def clean_null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with null tokens and bad numbers to typed columns; entity and file name from a path."""
    text = F.when(F.col("event_id") % 7 == 0, "NA").when(F.col("event_id") % 11 == 0, F.concat(F.lit("x"), F.col("value").cast("string"))).otherwise(F.col("value").cast("string"))
    path = F.concat(F.lit("/years/"), F.col("user_id"), F.when(F.col("event_id") % 5 == 0, ".txt").otherwise(".csv"))
    raw = table(spark, sf_dir, "events").select("event_id", text.alias("value"), path.alias("path"), "ts")
    return raw.select("event_id", C.number("value").alias("value"), C.entity_of_path("path").alias("entity_id"), C.basename("path").alias("file_name"), F.to_date("ts").alias("obs_date"))


@query(
    """SELECT event_id, try_cast(split_part(packed, ',', 1) AS DOUBLE) / 10.0 AS temperature, split_part(packed, ',', 2) AS quality
       FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '+9999,9' ELSE '+' || lpad((CAST(floor(value * 10) AS BIGINT) % 10000)::VARCHAR, 4, '0') || ',' || (event_id % 6) END AS packed FROM events)
       WHERE split_part(packed, ',', 1) <> '+9999'"""
)
def packed_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-packed value and quality code, without the missing code, in tenths."""
    code = F.concat(F.lit("+"), F.lpad((F.floor(F.col("value") * 10) % 10000).cast("string"), 4, "0"), F.lit(","), (F.col("event_id") % 6).cast("string"))
    raw = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, "+9999,9").otherwise(code).alias("packed"))
    out = raw.select("event_id", C.packed("packed", 1, "+9999", 10.0).alias("temperature"), F.split_part("packed", F.lit(","), F.lit(2)).alias("quality"))
    return out.where("temperature is not null")


@query(
    """SELECT event_id, CAST(strptime(day, '%Y%m%d') AS DATE) AS obs_date, tenths / 10.0::DOUBLE AS value
       FROM (SELECT event_id, strftime(ts, '%Y%m%d') AS day, CAST(floor(value * 10) AS INTEGER) AS tenths, event_type FROM events)
       WHERE event_type = 'view' AND day BETWEEN '20240105' AND '20240120'"""
)
def scaled_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact dates and tenths to dates and units, over a range of date text."""
    raw = table(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", F.date_format("ts", "yyyyMMdd").alias("day"), F.floor(F.col("value") * 10).cast("int").alias("tenths"))
    return raw.where(F.col("day").between("20240105", "20240120")).select("event_id", C.compact_date("day").alias("obs_date"), (F.col("tenths") / 10.0).cast("double").alias("value"))


LAGS = "entity_id, obs_date, level"


@query(
    f"""WITH {DAILY} SELECT {LAGS}, lag(obs_date) OVER w AS previous_date, lead(obs_date) OVER w AS next_date, lag(level) OVER w AS previous_level, lead(level) OVER w AS next_level,
        lag(level, 2) OVER w AS lag_2, lag(level, 7) OVER w AS lag_7, date_diff('day', lag(obs_date) OVER w, obs_date) AS gap_before, date_diff('day', obs_date, lead(obs_date) OVER w) AS gap_after
        FROM daily WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date)"""
)
def lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.neighbours(daily(spark, sf_dir).select("entity_id", "obs_date", "level"))


@query(
    f"""WITH {DAILY} SELECT {LAGS}, round(avg(level) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean_3, round(avg(level) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS mean_7,
        round(stddev_samp(level) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS sd_7, round(median(level) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS local_median
        FROM daily WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date)"""
)
def rolling_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.rolling(daily(spark, sf_dir).select("entity_id", "obs_date", "level"))


@query(
    f"""WITH {DAILY} SELECT entity_id, obs_date, humidity, round(avg(humidity) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS mean_before_7,
        round(avg(humidity) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS mean_before_3, count(humidity) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS count_3,
        count(humidity) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS count_7 FROM daily WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date)"""
)
def rolling_excluding_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.before_current(daily(spark, sf_dir).select("entity_id", "obs_date", "humidity"), history.Panel(level="humidity"))


@query(
    f"""WITH {DAILY} SELECT entity_id, obs_date, last_value(outside_temp IGNORE NULLS) OVER w AS outside_temp, last_value(humidity IGNORE NULLS) OVER w AS humidity,
        outside_temp IS NULL AS outside_temp_was_missing, humidity IS NULL AS humidity_was_missing
        FROM daily WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date ROWS UNBOUNDED PRECEDING)"""
)
def group_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.forward_filled(daily(spark, sf_dir).select("entity_id", "obs_date", "outside_temp", "humidity"), ["outside_temp", "humidity"])


@query(
    f"""WITH {DAILY}, ranked AS (SELECT entity_id, obs_date, level, row_number() OVER (ORDER BY level, entity_id, obs_date) AS r, count(*) OVER () AS n FROM daily)
        SELECT entity_id, obs_date, level, CASE WHEN n = 1 THEN 1 ELSE greatest(1, (10 * (r - 1) + n - 2) // (n - 1)) END AS decile FROM ranked"""
)
def deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-frequency deciles over all rows, ranked in two phases."""
    return history.equal_bins(daily(spark, sf_dir).select("entity_id", "obs_date", "level"), "level", ["entity_id", "obs_date"], 10, "decile")


@query(
    f"""WITH {HISTORY} SELECT DISTINCT c.entity_id, round(entity_median, 6) AS entity_median, round(entity_mad, 6) AS entity_mad, round(change_mad, 6) AS change_mad,
        round(target_mad, 6) AS target_mad FROM candidates c LEFT JOIN target_scale t ON c.entity_id = t.entity_id"""
)
def robust_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-pass robust scales of each entity, in the form that aggregates and joins."""
    rows = history.neighbours(daily(spark, sf_dir))
    change = F.col("level") - F.col("previous_level")
    middle = rows.groupBy("entity_id").agg(history.median(F.col("level")).alias("entity_median"), history.median(change).alias("_m"))
    spread = rows.join(middle, "entity_id").groupBy("entity_id").agg(
        F.first("entity_median").alias("entity_median"), history.median(F.abs(F.col("level") - F.col("entity_median"))).alias("entity_mad"), history.median(F.abs(change - F.col("_m"))).alias("change_mad")
    )
    gated = rows.withColumn("target", F.col("next_level") - F.col("level")).where(history.gate())
    aim = gated.groupBy("entity_id").agg(history.median(F.col("target")).alias("_t"))
    target = gated.join(aim, "entity_id").groupBy("entity_id").agg(history.median(F.abs(F.col("target") - F.col("_t"))).alias("target_mad"))
    return spread.join(target, "entity_id", "left")


@query(
    f"""WITH {DAILY}, lags AS (SELECT *, date_diff('day', lag(obs_date) OVER w, obs_date) AS gb, date_diff('day', obs_date, lead(obs_date) OVER w) AS ga, lag(level) OVER w AS pl, lead(level) OVER w AS nl
            FROM daily WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date)),
        counts AS (SELECT [count(*), count(*) FILTER (WHERE gb = 1), count(*) FILTER (WHERE gb = 1 AND ga = 1), count(*) FILTER (WHERE gb = 1 AND ga = 1 AND nl IS NOT NULL AND level IS NOT NULL AND pl IS NOT NULL),
            count(*) FILTER (WHERE gb = 1 AND ga = 1 AND level > 0 AND pl > 0 AND nl > 0)] AS c FROM lags),
        long AS (SELECT unnest(range(5)) AS step, unnest(['all rows', 'previous day', 'next day', 'levels present', 'levels positive']) AS label, unnest(c) AS rows_remaining FROM counts)
        SELECT step, label, rows_remaining, coalesce(lag(rows_remaining) OVER (ORDER BY step) - rows_remaining, 0) AS rows_dropped FROM long"""
)
def gate_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.waterfall(daily(spark, sf_dir))


@query(
    f"""WITH {HISTORY} SELECT count(*) AS n_rows, count(*) FILTER (WHERE implausible) AS n_implausible, count(*) FILTER (WHERE robust_outlier) AS n_robust, count(*) FILTER (WHERE dropout) AS n_dropout,
        count(*) FILTER (WHERE extreme_60) AS n_extreme, count(*) FILTER (WHERE extreme_60 AND implausible) AS n_extreme_implausible, count(*) FILTER (WHERE extreme_60 AND robust_outlier) AS n_extreme_robust,
        count(*) FILTER (WHERE extreme_60 AND dropout) AS n_extreme_dropout FROM flagged"""
)
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return audit.conditional_counts(
        flagged(spark, sf_dir),
        {
            "n_rows": F.lit(True), "n_implausible": c("implausible"), "n_robust": c("robust_outlier"), "n_dropout": c("dropout"), "n_extreme": c("extreme_60"),
            "n_extreme_implausible": c("extreme_60") & c("implausible"), "n_extreme_robust": c("extreme_60") & c("robust_outlier"), "n_extreme_dropout": c("extreme_60") & c("dropout"),
        },
    )


@query(
    f"""WITH {DAILY} SELECT entity_id, obs_date, least(abs(purchase_last_dif), abs(purchase_next_dif)) AS nearest_purchase, least(abs(error_last_dif), abs(error_next_dif)) AS nearest_error,
        CASE WHEN purchase_last_dif IS NOT NULL AND purchase_next_dif IS NOT NULL THEN least(abs(purchase_last_dif), abs(purchase_next_dif)) END AS nearest_purchase_strict FROM daily"""
)
def nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    def near(kind: str, strict: bool = False):
        return C.nearest(F.col(f"{kind}_last_dif"), F.col(f"{kind}_next_dif"), strict)

    return daily(spark, sf_dir).select("entity_id", "obs_date", near("purchase").alias("nearest_purchase"), near("error").alias("nearest_error"), near("purchase", True).alias("nearest_purchase_strict"))


@query(
    f"""WITH {DAILY}, long AS (SELECT entity_id, obs_date, 'purchase_last_dif' AS counter, purchase_last_dif AS v FROM daily UNION ALL SELECT entity_id, obs_date, 'error_last_dif', error_last_dif FROM daily),
        steps AS (SELECT *, CASE WHEN date_diff('day', lag(obs_date) OVER w, obs_date) = 1 THEN abs(v - lag(v) OVER w) END AS step FROM long WINDOW w AS (PARTITION BY entity_id, counter ORDER BY obs_date)),
        typical AS (SELECT entity_id, counter, median(step) FILTER (WHERE step > 0) AS rise FROM steps GROUP BY 1, 2)
        SELECT s.entity_id, s.obs_date, s.counter, CASE WHEN coalesce(rise, 0) > 1000 THEN v / 86400 ELSE v END AS days, coalesce(rise, 0) > 1000 AS in_seconds, rise IS NULL AS undetermined
        FROM steps s JOIN typical t ON s.entity_id = t.entity_id AND s.counter = t.counter"""
)
def unit_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters in seconds or days, told apart by their typical rise over one day, all in days."""
    from strandline.operators import units

    return units.normalised(daily(spark, sf_dir).select("entity_id", "obs_date", "purchase_last_dif", "error_last_dif"), ["purchase_last_dif", "error_last_dif"])


@query(
    f"""WITH {HISTORY} SELECT count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities, min(obs_date) AS first_date, max(obs_date) AS last_date, round(avg(target), 6) AS mean, round(median(target), 6) AS median, round(stddev_samp(target), 6) AS sd,
        round(min(target), 6) AS min, round(max(target), 6) AS max, count(*) FILTER (WHERE abs(target) > 60) AS n_beyond FROM gated"""
)
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.profile(history.candidates(daily(spark, sf_dir)).where(history.gate()), "target", "entity_id", "obs_date", 60)


@query("SELECT user_id, CAST(ts AS DATE) AS obs_date, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_keys(table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("obs_date")), ["user_id", "obs_date"])


@query(
    f"""WITH {DAILY} SELECT unnest(['outside_temp', 'humidity', 'purchase_last_dif']) AS column_name, unnest([count(*) FILTER (WHERE outside_temp IS NULL), count(*) FILTER (WHERE humidity IS NULL), count(*) FILTER (WHERE purchase_last_dif IS NULL)]) AS n_missing,
        unnest([round(100.0 * count(*) FILTER (WHERE outside_temp IS NULL) / count(*), 6), round(100.0 * count(*) FILTER (WHERE humidity IS NULL) / count(*), 6), round(100.0 * count(*) FILTER (WHERE purchase_last_dif IS NULL) / count(*), 6)]) AS pct_missing FROM daily"""
)
def missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missingness(daily(spark, sf_dir), ["outside_temp", "humidity", "purchase_last_dif"])


@query(
    """SELECT 'value' AS column_name, count(*) FILTER (WHERE v IS NULL) AS n_null, count(*) FILTER (WHERE v = 'NA') AS n_token, count(*) FILTER (WHERE trim(v) = '') AS n_blank
       FROM (SELECT CASE WHEN event_id % 7 = 0 THEN 'NA' WHEN event_id % 13 = 0 THEN ' ' WHEN event_id % 17 <> 0 THEN event_type END AS v FROM events)"""
)
def token_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    value = F.when(e % 7 == 0, "NA").when(e % 13 == 0, " ").when(e % 17 != 0, F.col("event_type"))
    return audit.token_audit(table(spark, sf_dir, "events").select(value.alias("value")), ["value"])


@query(
    """WITH g AS (SELECT o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1, 2, 3)
       SELECT sum(n)::BIGINT AS n_rows, 3::BIGINT AS n_columns, 0::BIGINT AS n_missing, sum(n - 1)::BIGINT AS n_repeated FROM g"""
)
def frame_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.frame_audit(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("d")))


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM events GROUP BY 1")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.shares(table(spark, sf_dir, "events"), "event_type")


@query(f"WITH {DAILY} SELECT CASE WHEN level < 0 THEN 0 WHEN level >= 200 THEN 41 ELSE CAST(floor(level / 5.0) AS BIGINT) + 1 END AS bucket, count(*) AS n FROM daily GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.histogram(daily(spark, sf_dir), "level", 0.0, 200.0, 40)


CORRELATED = ("level", "change", "target", "sd_7", "outside_temp")


@query(
    f"WITH {HISTORY} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) FILTER (WHERE {b} IS NOT NULL) * stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL), 0), 6) AS r FROM gated"
        for a in CORRELATED
        for b in CORRELATED
    )
)
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.correlation_matrix(history.candidates(daily(spark, sf_dir)).where(history.gate()), list(CORRELATED))


def _spearman_sql(feature: str) -> str:
    return f"""SELECT '{feature}' AS feature, count(*) AS n, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) AS rho FROM (
        SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry
        FROM (SELECT {feature} AS x, target AS y FROM gated WHERE {feature} IS NOT NULL AND target IS NOT NULL))"""


RANKED = ("change", "outside_temp", "humidity")


@query(f"WITH {HISTORY} " + " UNION ALL ".join(map(_spearman_sql, RANKED)))
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.spearman(history.candidates(daily(spark, sf_dir)).where(history.gate()), list(RANKED), "target")


@query(
    """SELECT user_id AS entity_id, CAST(ts AS DATE) AS obs_date, max_by(value, ts) FILTER (WHERE event_id % 4 <> 0) AS last_level, round(avg(value) FILTER (WHERE event_id % 3 = 0), 6) AS sensor_mean,
              max(value) AS max_value, count(*) AS n_readings, max(ts) AS last_time FROM events GROUP BY 1, 2"""
)
def subdaily_to_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings within a day to one row: last present level by time, sensor means, counts."""
    from strandline.streaming.daily import day_columns

    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity_id"), "ts", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("level"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("sensor"), "value"
    )
    return events.groupBy("entity_id", F.to_date("ts").alias("obs_date")).agg(*day_columns())


@query(
    """WITH per_day AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2)
       SELECT user_id AS entity_id, count(*) AS n_days, min(n) AS fewest, max(n) AS most, round(avg(n), 6) AS mean_readings FROM per_day GROUP BY 1"""
)
def readings_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return days.groupBy(F.col("user_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n_days"), F.min("n").alias("fewest"), F.max("n").alias("most"), F.avg("n").alias("mean_readings"))


@query(
    f"""WITH {DAILY}, spans AS (SELECT entity_id, min(obs_date) AS a, max(obs_date) AS b FROM daily GROUP BY 1),
        spine AS (SELECT entity_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS obs_date FROM spans)
        SELECT s.entity_id, s.obs_date, d.level, d.level IS NULL AS is_gap FROM spine s LEFT JOIN daily d ON s.entity_id = d.entity_id AND s.obs_date = d.obs_date"""
)
def date_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day between an entity's first and last, with gaps marked."""
    rows = daily(spark, sf_dir).select("entity_id", "obs_date", "level")
    spans = rows.groupBy("entity_id").agg(F.min("obs_date").alias("a"), F.max("obs_date").alias("b"))
    spine = spans.select("entity_id", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("obs_date"))
    return spine.join(rows, ["entity_id", "obs_date"], "left").withColumn("is_gap", F.col("level").isNull())


@query(
    f"""WITH {DAILY}, c AS (SELECT entity_id, level - lag(level) OVER (PARTITION BY entity_id ORDER BY obs_date) AS change FROM daily)
        SELECT entity_id, count(change) AS n, round(avg(change), 6) AS mean_change, round(max(abs(change)), 6) AS largest FROM c GROUP BY 1 ORDER BY largest DESC, entity_id LIMIT 20"""
)
def largest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 entities with the largest change from one row to the next."""
    rows = daily(spark, sf_dir).select("entity_id", (F.col("level") - F.lag("level").over(history.DEFAULT.window)).alias("change"))
    sums = rows.groupBy("entity_id").agg(F.count("change").alias("n"), F.avg("change").alias("mean_change"), F.max(F.abs("change")).alias("largest"))
    return sums.orderBy(F.desc("largest"), "entity_id").limit(20)


@query(
    f"""WITH {DAILY}, g AS (SELECT *, date_diff('day', lag(obs_date) OVER w, obs_date) AS gap FROM daily WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date))
        SELECT entity_id, obs_date, CASE WHEN gap > 1 THEN NULL ELSE level END AS level, CASE WHEN level < 25 THEN 'low' WHEN level <= 40 THEN 'mid' ELSE 'high' END AS tier,
               CASE WHEN month(obs_date) IN (12, 1, 2) THEN 'Winter' WHEN month(obs_date) IN (3, 4, 5) THEN 'Spring' WHEN month(obs_date) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END AS season,
               CASE WHEN month(obs_date) IN (4, 5, 6, 7, 8) THEN 'flow' ELSE 'rest' END AS regime, CASE WHEN outside_temp IS NULL THEN NULL ELSE (outside_temp > 12)::INT::DOUBLE END AS warm, CASE WHEN outside_temp IS NOT NULL THEN round(greatest(outside_temp - 10, 0), 6) END AS degree_days
        FROM g WHERE n_readings > 1 AND humidity IS NOT NULL"""
)
def row_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken series, tiers, seasons, regimes, warm days and degree days of rows with all sensors."""
    rows = history.neighbours(daily(spark, sf_dir)).where("n_readings > 1").na.drop(subset=["humidity"])
    temp = F.col("outside_temp")
    return rows.select(
        "entity_id", "obs_date", F.when(F.coalesce(F.col("gap_before") > 1, F.lit(False)), None).otherwise(F.col("level")).alias("level"), C.tier(F.col("level")).alias("tier"), C.season(F.col("obs_date")).alias("season"),
        C.labelled(F.month("obs_date"), "flow_vs_rest").alias("regime"), C.warm(temp).alias("warm"), C.degree_days(temp).alias("degree_days"),
    )


@query(
    f"""WITH {DAILY}, l AS (SELECT entity_id, obs_date, level, level - lag(level) OVER w AS change, median(level) OVER p AS m FROM daily WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date), p AS (PARTITION BY entity_id ORDER BY obs_date ROWS UNBOUNDED PRECEDING)),
        c AS (SELECT *, median(change) OVER (PARTITION BY entity_id ORDER BY obs_date ROWS UNBOUNDED PRECEDING) AS mc FROM l)
        SELECT t.entity_id, t.obs_date, t.level, round(any_value(t.m), 6) AS entity_median, round(median(abs(s.level - t.m)), 6) AS entity_mad, round(median(abs(s.change - t.mc)), 6) AS change_mad
        FROM c t JOIN c s ON s.entity_id = t.entity_id AND s.obs_date <= t.obs_date GROUP BY 1, 2, 3"""
)
def past_only_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity's median and the median deviations from it and of the change, as they are known on each day."""
    rows = history.neighbours(daily(spark, sf_dir).select("entity_id", "obs_date", "level"))
    return history.robust_scales(rows, past_only=True).select("entity_id", "obs_date", "level", "entity_median", "entity_mad", "change_mad")


RANGED = ("previous_level", "next_level", "lag_2", "lag_7", "gap_before", "gap_after", "mean_3", "mean_7", "sd_7", "local_median", "entity_median", "entity_mad", "change_mad", "target", "slope_7")


@query(f"WITH {HISTORY} SELECT entity_id, obs_date, level, {', '.join(f'round({c}, 6) AS {c}' if not c.startswith('gap') else c for c in RANGED)} FROM candidates")
def ranged_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History columns by ranges of dates with a halo, as for entities that no task can hold."""
    return history.long_candidates(daily(spark, sf_dir)).select("entity_id", "obs_date", "level", *RANGED)


@query(
    f"""WITH {DAILY} SELECT entity_id, obs_date, outside_temp IS NULL AS outside_temp_was_missing, humidity IS NULL AS humidity_was_missing,
        last_value(outside_temp IGNORE NULLS) OVER w AS outside_temp, last_value(humidity IGNORE NULLS) OVER w AS humidity FROM daily WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date ROWS UNBOUNDED PRECEDING)"""
)
def ranged_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward fill carried over ranges of dates."""
    return history.carried(daily(spark, sf_dir).select("entity_id", "obs_date", "outside_temp", "humidity"), ["outside_temp", "humidity"])


@query(
    f"""WITH {LONG} SELECT l.entity_id, l.obs_date, l.level FROM long_panel l, (SELECT entity_id, obs_date FROM long_panel ORDER BY level DESC, entity_id, obs_date LIMIT 1) top
        WHERE l.entity_id = top.entity_id AND l.obs_date BETWEEN top.obs_date - 7 AND top.obs_date + 7"""
)
def around_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven days around the largest level, of its entity."""
    rows = long_panel(spark, sf_dir)
    top = rows.orderBy(F.desc("level"), "entity_id", "obs_date").limit(1).select(F.col("entity_id").alias("_e"), F.col("obs_date").alias("_d"))
    return rows.join(F.broadcast(top), (F.col("entity_id") == F.col("_e")) & F.col("obs_date").between(F.date_sub("_d", 7), F.date_add("_d", 7))).drop("_e", "_d")
