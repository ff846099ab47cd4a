"""Splits, fills, tallies and boards that the other modules don't hold."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.operators import audit, history, periods, units
from strandline.plans import backtest as B
from strandline.queries.backtests import METRICS, NAIVE, ORIGINS, SHOWN, naive_predictions
from strandline.queries.base import DAILY, HISTORY, LONG, daily, flagged, query, table
from strandline.queries.grains import FEATURES, GROSS, LONG_TARGET, MONTHS, _features_sql, grained, gross, long_targets


@query(
    f"""WITH {DAILY}, m AS (SELECT entity_id, median(humidity) AS m FROM daily GROUP BY 1)
        SELECT d.entity_id, obs_date, round(coalesce(last_value(humidity IGNORE NULLS) OVER (PARTITION BY d.entity_id ORDER BY obs_date ROWS UNBOUNDED PRECEDING), m), 6) AS humidity, humidity IS NULL AS humidity_was_missing
        FROM daily d JOIN m ON d.entity_id = m.entity_id"""
)
def imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward fill, then the entity's median, then the median of all."""
    return history.imputed(daily(spark, sf_dir).select("entity_id", "obs_date", "humidity"), ["humidity"])


@query("SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_entities, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM events GROUP BY 1")
def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, entities and days of each dataset."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_entities"), F.count_distinct(F.to_date("ts")).alias("n_days"))


@query(f"WITH {HISTORY} SELECT dropout, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct, round(avg(extreme_60::INT), 6) AS extreme_rate FROM flagged GROUP BY 1")
def flag_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts of a flag with percent, and the rate of another within it."""
    rows = flagged(spark, sf_dir)
    rates = rows.groupBy("dropout").agg(F.avg(F.col("extreme_60").cast("double")).alias("extreme_rate"))
    return audit.shares(rows, "dropout").join(rates, "dropout")


@query(
    f"""WITH {DAILY}, long AS (SELECT entity_id, obs_date, 'purchase_last_dif' AS counter, purchase_last_dif AS v FROM daily UNION ALL SELECT entity_id, obs_date, 'error_last_dif', error_last_dif FROM daily),
        steps AS (SELECT *, CASE WHEN date_diff('day', lag(obs_date) OVER w, obs_date) = 1 THEN abs(v - lag(v) OVER w) END AS step FROM long WINDOW w AS (PARTITION BY entity_id, counter ORDER BY obs_date)),
        t AS (SELECT entity_id, counter, median(step) FILTER (WHERE step > 0) AS rise FROM steps GROUP BY 1, 2)
        SELECT counter, count(*) FILTER (WHERE NOT coalesce(rise > 1000, false)) AS n_days, count(*) FILTER (WHERE coalesce(rise > 1000, false)) AS n_seconds, count(*) FILTER (WHERE rise IS NULL) AS n_undetermined FROM t GROUP BY 1"""
)
def unit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.report(units.normalised(daily(spark, sf_dir).select("entity_id", "obs_date", "purchase_last_dif", "error_last_dif"), ["purchase_last_dif", "error_last_dif"]))


def _grain_sql(name: str, source: str) -> str:
    return f"SELECT '{name}' AS grain, count(*) AS n, round(stddev_samp(target), 6) AS sd, round(avg(abs(target)), 6) AS mean_size, round(avg((abs(target) > 100)::INT), 6) AS share_beyond, round(100 / stddev_samp(target), 6) AS cut_in_sd FROM {source} WHERE target IS NOT NULL"


MONTH_FEATURES = _features_sql(MONTHS).removeprefix(LONG + ",").replace("stepped", "stepped_m").replace("numbered", "numbered_m").replace("grained", "grained_m").replace("shifted", "shifted_m").replace("changed", "changed_m").replace("features", "features_m")


@query(
    f"""WITH {FEATURES}, {MONTH_FEATURES}, day_rows AS (SELECT level, lag(level) OVER w AS pl, lead(level) OVER w AS nl, lag(obs_date) OVER w AS pd, lead(obs_date) OVER w AS nd, obs_date FROM long_panel WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date)),
        days AS (SELECT nl - level AS target FROM day_rows WHERE date_diff('day', pd, obs_date) = 1 AND date_diff('day', obs_date, nd) = 1 AND pl > 0 AND level > 0 AND nl > 0)
        {_grain_sql("day", "days")} UNION ALL {_grain_sql("week", "features")} UNION ALL {_grain_sql("month", "features_m")}"""
)
def grain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target at the grain of days, weeks and months."""
    y = F.col("target")
    out = None
    frames = {"day": long_targets(spark, sf_dir), "week": periods.with_features(grained(spark, sf_dir, "week")), "month": periods.with_features(grained(spark, sf_dir, "month"))}
    for name, rows in frames.items():
        one = rows.where("target is not null").agg(
            F.lit(name).alias("grain"), F.count(F.lit(1)).alias("n"), F.stddev_samp(y).alias("sd"), F.avg(F.abs(y)).alias("mean_size"),
            F.avg((F.abs(y) > 100).cast("double")).alias("share_beyond"), F.try_divide(F.lit(100.0), F.stddev_samp(y)).alias("cut_in_sd"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH {NAIVE}, t AS (SELECT rule, y_true - y_pred AS e, CASE WHEN abs(y_true) < 50 THEN 'low' WHEN abs(y_true) <= 200 THEN 'mid' ELSE 'high' END AS tier FROM predictions)
        SELECT tier, rule, count(*) AS n, round(min(e), 6) AS q000, round(quantile_cont(e, 0.25), 6) AS q025, round(quantile_cont(e, 0.5), 6) AS q050, round(quantile_cont(e, 0.75), 6) AS q075, round(max(e), 6) AS q100 FROM t GROUP BY 1, 2"""
)
def residual_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.residual_tiers(naive_predictions(spark, sf_dir), C.tier(F.abs("y_true"), 50.0, 200.0))


@query(
    f"""WITH {LONG_TARGET}, d AS (SELECT obs_date, count(*) AS n FROM targets GROUP BY 1), p AS (SELECT *, coalesce(sum(n) OVER (ORDER BY obs_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM d),
        c AS (SELECT min(obs_date) AS cut FROM p WHERE b >= 0.8 * t) SELECT CASE WHEN cut IS NULL OR obs_date < cut THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(obs_date) AS first_date, max(obs_date) AS last_date FROM targets, c GROUP BY 1"""
)
def row_share_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.row_share_split(long_targets(spark, sf_dir), 0.8)
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("obs_date").alias("first_date"), F.max("obs_date").alias("last_date"))


@query(f"WITH {LONG_TARGET} SELECT CASE WHEN obs_date < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(avg(target), 6) AS mean_target FROM targets GROUP BY 1")
def date_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.date_split(long_targets(spark, sf_dir), date(1999, 1, 1)).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("mean_target"))


@query(
    f"""WITH {HISTORY}, x AS (SELECT count(*)::DOUBLE AS n_rows, stddev_samp(target) AS sd, avg(level) AS mean_level, (SELECT count(*)::DOUBLE FROM candidates WHERE gap_before = 1 AND gap_after = 1 AND level > 0 AND previous_level > 0 AND next_level > 0) AS quoted FROM gated)
        SELECT unnest(['n_rows', 'sd', 'mean_level']) AS name, unnest([round(n_rows, 6), round(sd, 6), round(mean_level, 6)]) AS found, unnest([quoted, 50.0, 50.0])::DOUBLE AS expected,
               unnest([n_rows = quoted, abs(sd - 50) <= 0.05 * 50, abs(mean_level - 50) <= 0.1 * 50]) AS ok FROM x"""
)
def headline_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed numbers against quoted ones: the rows that the waterfall leaves, and a level and spread of 50."""
    rows = history.candidates(daily(spark, sf_dir)).where(history.gate())
    found = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.stddev_samp("target").alias("sd"), F.avg("level").alias("mean_level"))
    quoted = history.waterfall(daily(spark, sf_dir)).orderBy(F.desc("step")).first().rows_remaining
    return B.expectations(found, {"n_rows": (quoted, 0.0), "sd": (50, 0.05), "mean_level": (50, 0.1)})


@query(
    f"""WITH {GROSS}, kinds AS (SELECT 'net' AS target_kind, entity_id, period_start, target_period_end, target FROM gross WHERE target IS NOT NULL
            UNION ALL SELECT 'gross', entity_id, period_start, target_period_end, target + removed_next FROM gross WHERE target IS NOT NULL AND removed_next IS NOT NULL),
        {ORIGINS.format(day="period_start", source="(SELECT period_start FROM gross WHERE target IS NOT NULL)").replace("folds AS (", "plain_folds AS (")},
        folds AS (SELECT f.*, (SELECT min(period_start) FROM gross t WHERE target IS NOT NULL AND t.period_start >= f.origin AND t.period_start < f.horizon_end) AS test_start FROM plain_folds f),
        assigned AS (SELECT b.*, fold, CASE WHEN period_start >= origin THEN 'test' ELSE 'train' END AS part FROM kinds b JOIN folds f ON (period_start >= origin AND period_start < horizon_end) OR (period_start < origin AND target_period_end < test_start)),
        means AS (SELECT target_kind, fold, avg(target) AS m FROM assigned WHERE part = 'train' GROUP BY 1, 2),
        predictions AS (SELECT a.target_kind, unnest(['zero', 'train_mean']) AS rule, unnest([0.0::DOUBLE, m]) AS y_pred, target AS y_true FROM assigned a JOIN means USING (target_kind, fold) WHERE part = 'test'),
        board AS (SELECT target_kind, rule, {METRICS} FROM predictions GROUP BY 1, 2) SELECT target_kind, rule, {SHOWN} FROM board"""
)
def net_gross_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive errors of the net and of the gross target, pooled over embargoed folds."""
    rows = gross(spark, sf_dir).where("target is not null").select("entity_id", "period_start", "target_period_end", "target", "gross_target", F.col("period_change").alias("change"))
    folds = B.rolling_folds(rows, "period_start")
    out = None
    for kind, column in (("net", "target"), ("gross", "gross_target")):
        own = rows.withColumn("target", F.col(column))
        predictions = B.naive(B.assigned(own, folds, "period_start", "target_period_end"), ("zero", "train_mean"), date_column="period_start")
        one = predictions.groupBy("rule").agg(*B.metrics()).withColumn("target_kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {MONTHS} SELECT entity_id, round(median(mean_level), 6) AS median_month, round(max(mean_level) - min(mean_level), 6) AS range_month, count(*) AS n_months FROM grained GROUP BY 1")
def month_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grained(spark, sf_dir, "month")
    return rows.groupBy("entity_id").agg(history.median(F.col("mean_level")).alias("median_month"), (F.max("mean_level") - F.min("mean_level")).alias("range_month"), F.count(F.lit(1)).alias("n_months"))
