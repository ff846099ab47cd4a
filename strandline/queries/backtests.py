"""Folds, naive boards, skill, segments, resampling and classifier metrics, over the long panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.operators import history, periods
from strandline.plans import backtest as B
from strandline.plans import linear as L
from strandline.plans import models as M
from strandline.queries.base import LONG, held, long_panel, query
from strandline.queries.grains import FEATURES, LONG_TARGET, MONTHS, _features_sql, grained, long_targets

#: Origins of the last four folds over the table that ``source`` names.
ORIGINS = """origin_dates AS (
    SELECT CAST(first + INTERVAL (12 + 6 * k) MONTH AS DATE) AS origin, last FROM (SELECT min({day}) AS first, max({day}) AS last FROM {source}), (SELECT unnest(range(0, 200)) AS k)),
folds AS (
    SELECT 'fold_' || row_number() OVER (ORDER BY origin) || '_' || origin AS fold, origin, CAST(origin + INTERVAL 6 MONTH AS DATE) AS horizon_end
    FROM (SELECT origin FROM origin_dates WHERE origin + INTERVAL 6 MONTH <= last + INTERVAL 1 DAY ORDER BY origin DESC LIMIT 4))"""

DAILY_FOLDS = f"""{LONG_TARGET}, {ORIGINS.format(day="obs_date", source="targets")},
assigned AS (SELECT t.*, fold, CASE WHEN obs_date < origin THEN 'train' ELSE 'test' END AS part FROM targets t JOIN folds f ON obs_date < horizon_end)"""

NAIVE = f"""{DAILY_FOLDS}, train AS (SELECT * FROM assigned WHERE part = 'train'),
overall AS (SELECT fold, avg(target) AS m FROM train GROUP BY 1), per_entity AS (SELECT fold, entity_id, avg(target) AS m FROM train GROUP BY 1, 2),
per_month AS (SELECT fold, entity_id, month(obs_date) AS month, avg(target) AS m FROM train GROUP BY 1, 2, 3),
wide AS (
    SELECT t.*, o.m AS m_all, coalesce(e.m, o.m) AS m_entity, coalesce(p.m, o.m) AS m_month FROM assigned t JOIN overall o ON t.fold = o.fold LEFT JOIN per_entity e ON t.fold = e.fold AND t.entity_id = e.entity_id
    LEFT JOIN per_month p ON t.fold = p.fold AND t.entity_id = p.entity_id AND month(t.obs_date) = p.month WHERE t.part = 'test'),
predictions AS (
    SELECT fold, entity_id, obs_date, target AS y_true, unnest(['zero', 'train_mean', 'persistence', 'entity_mean', 'entity_month']) AS rule, unnest(range(5)) AS rule_order,
           unnest([0.0::DOUBLE, m_all, coalesce(change, 0), m_entity, m_month]) AS y_pred FROM wide)"""

METRICS = "avg(abs(y_pred - y_true)) AS mae, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse, 1 - avg((y_pred - y_true) * (y_pred - y_true)) / nullif(var_pop(y_true), 0) AS r2, avg(y_pred - y_true) AS bias, count(*) AS n"
SHOWN = "round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, round(bias, 6) AS bias, n"
BOARD = f"{NAIVE}, board AS (SELECT fold, rule, {METRICS} FROM predictions GROUP BY 1, 2)"


def naive_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long_targets(spark, sf_dir)
    return B.naive(B.assigned(rows, B.rolling_folds(rows)), B.DAILY_RULES)


@query(
    f"""WITH {DAILY_FOLDS} SELECT fold, count(*) FILTER (WHERE part = 'train') AS n_train, count(*) FILTER (WHERE part = 'test') AS n_test, max(obs_date) FILTER (WHERE part = 'train') AS train_end,
        min(obs_date) FILTER (WHERE part = 'test') AS test_start, max(obs_date) FILTER (WHERE part = 'test') AS test_end, 0::BIGINT AS embargoed FROM assigned GROUP BY 1 HAVING count(*) FILTER (WHERE part = 'train') > 0 AND count(*) FILTER (WHERE part = 'test') > 0"""
)
def rolling_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long_targets(spark, sf_dir)
    folds = B.rolling_folds(rows)
    B.assert_order(rows, folds)
    return B.fold_table(rows, folds)


PERIOD_TARGETS = f"""{FEATURES}, period_targets AS (SELECT entity_id, period_index, period_start, target_period_end, target, period_change AS change FROM features WHERE target IS NOT NULL)"""
PERIOD_FOLDS = f"""{PERIOD_TARGETS}, {ORIGINS.format(day="period_start", source="period_targets").replace("folds AS (", "plain_folds AS (")},
folds AS (SELECT f.*, (SELECT min(period_start) FROM period_targets t WHERE t.period_start >= f.origin AND t.period_start < f.horizon_end) AS test_start FROM plain_folds f)"""


def period_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periods.with_features(grained(spark, sf_dir, "week")).where("target is not null")
    return rows.select("entity_id", "period_index", "period_start", "target_period_end", "target", F.col("period_change").alias("change"))


@query(
    f"""WITH {PERIOD_FOLDS} SELECT fold, count(*) FILTER (WHERE target_period_end < test_start) AS n_train, count(*) FILTER (WHERE period_start >= origin AND period_start < horizon_end) AS n_test,
        max(target_period_end) FILTER (WHERE target_period_end < test_start) AS train_end, min(period_start) FILTER (WHERE period_start >= origin AND period_start < horizon_end) AS test_start,
        max(period_start) FILTER (WHERE period_start >= origin AND period_start < horizon_end) AS test_end, count(*) FILTER (WHERE period_start < origin AND target_period_end >= test_start) AS embargoed FROM period_targets, folds GROUP BY 1
        HAVING count(*) FILTER (WHERE target_period_end < test_start) > 0 AND count(*) FILTER (WHERE period_start >= origin AND period_start < horizon_end) > 0"""
)
def embargo_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = period_targets(spark, sf_dir)
    folds = B.rolling_folds(rows, "period_start")
    B.assert_order(rows, folds, "period_start", "target_period_end")
    return B.fold_table(rows, folds, "period_start", "target_period_end")


@query(f"WITH {LONG.replace('n_regionkey', 'n_nationkey')} SELECT entity_id, ntile(5) OVER (ORDER BY md5('42|' || entity_id), entity_id) AS fold FROM (SELECT DISTINCT entity_id FROM long_panel)")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.group_folds(long_panel(spark, sf_dir, "n_nationkey"), 5)


@query(f"WITH {BOARD} SELECT fold, rule, {SHOWN} FROM board")
def naive_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.board(naive_predictions(spark, sf_dir))


@query(
    f"""WITH {BOARD}, best AS (SELECT fold, min(mae) AS bar, arg_min(rule, (mae, rule)) AS bar_rule FROM board GROUP BY 1)
        SELECT b.fold, rule, {SHOWN}, round(bar, 6) AS bar, bar_rule, round(1 - mae / nullif(bar, 0), 6) AS skill FROM board b JOIN best x ON b.fold = x.fold"""
)
def skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = B.board(naive_predictions(spark, sf_dir))
    return B.with_skill(boards, B.best(boards))


@query(
    f"""WITH {BOARD} SELECT rule, count(DISTINCT fold) AS folds, round(avg(mae), 6) AS mae_mean, round(stddev_samp(mae), 6) AS mae_sd, round(avg(rmse), 6) AS rmse_mean, round(stddev_samp(rmse), 6) AS rmse_sd,
        round(avg(r2), 6) AS r2_mean, round(stddev_samp(r2), 6) AS r2_sd, sum(n)::BIGINT AS n FROM board GROUP BY 1"""
)
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fold_summary(B.board(naive_predictions(spark, sf_dir)))


SEASON = "CASE WHEN month({d}) IN (12, 1, 2) THEN 'Winter' WHEN month({d}) IN (3, 4, 5) THEN 'Spring' WHEN month({d}) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END"


def _segmented_sql(segments: str, pooled: bool, model: str = "persistence", before: str = "") -> str:
    extra = f", round(1 - mae / (SELECT min(m) FROM (SELECT avg(abs(y_pred - y_true)) AS m FROM predictions WHERE rule <> '{model}' GROUP BY rule)), 6) AS skill_pooled" if pooled else ""
    return f"""WITH {NAIVE}{before}, long AS ({segments}), rows AS (SELECT segment, value, rule, rule_order, {METRICS} FROM long GROUP BY ALL),
        bars AS (SELECT segment, value, min(mae) AS bar, arg_min(rule, (mae, rule_order)) AS bar_rule FROM rows WHERE rule <> '{model}' GROUP BY 1, 2)
        SELECT r.segment, r.value, {SHOWN}, round(bar, 6) AS bar, bar_rule, round(1 - mae / nullif(bar, 0), 6) AS skill{extra} FROM rows r LEFT JOIN bars b ON r.segment = b.segment AND r.value = b.value WHERE rule = '{model}'"""


@query(
    _segmented_sql(
        f"SELECT 'season' AS segment, {SEASON.format(d='obs_date')} AS value, * FROM predictions UNION ALL SELECT 'month', month(obs_date)::VARCHAR, * FROM predictions UNION ALL SELECT 'entity', entity_id::VARCHAR, * FROM predictions", True
    )
)
def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = {"season": C.season(F.col("obs_date")), "month": F.month("obs_date"), "entity": F.col("entity_id")}
    return B.segmented(naive_predictions(spark, sf_dir), segments, "persistence")


@query(
    _segmented_sql(
        "SELECT 'flow_vs_rest' AS segment, CASE WHEN month(obs_date) IN (4, 5, 6, 7, 8) THEN 'flow' ELSE 'rest' END AS value, * FROM predictions UNION ALL SELECT 'pooled', 'all', * FROM predictions", False
    )
)
def regime_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.regime_report(naive_predictions(spark, sf_dir), F.month("obs_date"), "flow_vs_rest", "persistence")


@query(
    _segmented_sql(
        f"SELECT 'season' AS segment, {SEASON.format(d='obs_date')} AS value, * FROM pooled UNION ALL SELECT 'year', year(obs_date)::VARCHAR, * FROM pooled", True, "model",
        ", pooled AS (SELECT * FROM predictions UNION ALL SELECT fold, entity_id, obs_date, target, 'model', 99, coalesce(-change / 2, 0) FROM wide)",
    )
)
def pooled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predictor's pooled out-of-fold predictions by season and year, against the naive rules: half the last change is taken back."""
    rows = long_targets(spark, sf_dir)
    folds = B.rolling_folds(rows)

    def reversal(train: DataFrame, test: DataFrame) -> DataFrame:
        return test.withColumn("y_pred", F.coalesce(-F.col("change") / 2, F.lit(0.0)))

    predictions = B.naive(B.assigned(rows, folds), B.DAILY_RULES).unionByName(M.out_of_fold(rows, folds, reversal, "model"))
    return B.segmented(predictions, {"season": C.season(F.col("obs_date")), "year": F.year("obs_date")}, "model")


@query(
    f"""WITH {PERIOD_FOLDS}, assigned AS (SELECT t.*, fold, CASE WHEN period_start >= origin THEN 'test' ELSE 'train' END AS part, month(period_start) AS month FROM period_targets t JOIN folds f ON (period_start >= origin AND period_start < horizon_end) OR (period_start < origin AND target_period_end < test_start)),
    train AS (SELECT * FROM assigned WHERE part = 'train'), overall AS (SELECT fold, avg(target) AS m FROM train GROUP BY 1), e AS (SELECT fold, entity_id, avg(target) AS m FROM train GROUP BY 1, 2),
    mo AS (SELECT fold, month, avg(target) AS m FROM train GROUP BY 1, 2), em AS (SELECT fold, entity_id, month, avg(target) AS m FROM train GROUP BY 1, 2, 3),
    predictions AS (
        SELECT a.fold, target AS y_true, unnest(['zero', 'train_mean', 'persistence', 'entity_mean', 'month_mean', 'entity_month']) AS rule,
               unnest([0.0::DOUBLE, overall.m, coalesce(change, 0), coalesce(e.m, overall.m), coalesce(mo.m, overall.m), coalesce(em.m, mo.m, overall.m)]) AS y_pred
        FROM assigned a JOIN overall ON a.fold = overall.fold LEFT JOIN e ON a.fold = e.fold AND a.entity_id = e.entity_id LEFT JOIN mo ON a.fold = mo.fold AND a.month = mo.month
        LEFT JOIN em ON a.fold = em.fold AND a.entity_id = em.entity_id AND a.month = em.month WHERE part = 'test'),
    board AS (SELECT fold, rule, {METRICS} FROM predictions GROUP BY 1, 2) SELECT fold, rule, {SHOWN} FROM board"""
)
def period_naive_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = period_targets(spark, sf_dir)
    folds = B.rolling_folds(rows, "period_start")
    return B.board(B.naive(B.assigned(rows, folds, "period_start", "target_period_end"), B.PERIOD_RULES, date_column="period_start"))


#: Nation months, their samples, folds within each sample, and the skill of a line through the last change against the best naive rule.
RESAMPLED = f"""{_features_sql(MONTHS).replace("n_regionkey", "n_nationkey")},
targets AS (SELECT entity_id, period_start, target_period_end, target, period_change AS change, month(period_start) AS month FROM features WHERE target IS NOT NULL),
ids AS (SELECT DISTINCT entity_id FROM targets), ranked AS (
    SELECT entity_id, repeat, row_number() OVER (PARTITION BY repeat ORDER BY md5('42|' || repeat || '|' || entity_id), entity_id) AS r, count(*) OVER (PARTITION BY repeat) AS n FROM ids, (SELECT unnest(range(8)) AS repeat)),
drawn AS (
    SELECT entity_id, repeat, fraction FROM ranked, (SELECT unnest([0.25, 0.4, 0.55, 0.7, 0.85, 1.0])::DOUBLE AS fraction)
    WHERE r <= greatest(3, round(n * fraction)) AND (greatest(3, round(n * fraction)) < n OR repeat = 0)),
rows AS (SELECT t.*, repeat, fraction FROM targets t JOIN drawn d ON t.entity_id = d.entity_id),
bounds AS (SELECT fraction, repeat, min(period_start) AS first, max(period_start) AS last FROM rows GROUP BY 1, 2),
origin_dates AS (
    SELECT fraction, repeat, last, CAST(first + INTERVAL (12 + 6 * k) MONTH AS DATE) AS origin, CAST(first + INTERVAL (18 + 6 * k) MONTH AS DATE) AS horizon_end FROM bounds, (SELECT unnest(range(0, 200)) AS k)),
kept AS (SELECT *, row_number() OVER (PARTITION BY fraction, repeat ORDER BY origin DESC) AS back FROM origin_dates WHERE horizon_end <= last + INTERVAL 1 DAY),
folds AS (
    SELECT k.fraction, k.repeat, origin, horizon_end, min(period_start) AS test_start FROM kept k JOIN rows r ON k.fraction = r.fraction AND k.repeat = r.repeat
    WHERE back <= 4 AND period_start >= origin AND period_start < horizon_end GROUP BY 1, 2, 3, 4),
assigned AS (
    SELECT r.*, origin, CASE WHEN period_start >= origin THEN 'test' ELSE 'train' END AS part FROM rows r JOIN folds f ON r.fraction = f.fraction AND r.repeat = f.repeat
    AND ((period_start >= origin AND period_start < horizon_end) OR (period_start < origin AND target_period_end < test_start))),
train AS (SELECT * FROM assigned WHERE part = 'train'), o AS (SELECT fraction, repeat, origin, avg(target) AS m, regr_slope(target, coalesce(change, 0)) AS slope, regr_intercept(target, coalesce(change, 0)) AS intercept FROM train GROUP BY ALL), e AS (SELECT fraction, repeat, origin, entity_id, avg(target) AS m FROM train GROUP BY ALL),
mo AS (SELECT fraction, repeat, origin, month, avg(target) AS m FROM train GROUP BY ALL), em AS (SELECT fraction, repeat, origin, entity_id, month, avg(target) AS m FROM train GROUP BY ALL),
errors AS (
    SELECT fraction, repeat, origin, rule, avg(abs(y - p)) AS mae FROM (
        SELECT a.fraction, a.repeat, a.origin, a.target AS y, unnest(['zero', 'train_mean', 'persistence', 'entity_mean', 'month_mean', 'entity_month', 'rule']) AS rule,
               unnest([0.0::DOUBLE, o.m, coalesce(change, 0), coalesce(e.m, o.m), coalesce(mo.m, o.m), coalesce(em.m, mo.m, o.m), intercept + slope * coalesce(change, 0)]) AS p
        FROM assigned a JOIN o USING (fraction, repeat, origin) LEFT JOIN e USING (fraction, repeat, origin, entity_id) LEFT JOIN mo USING (fraction, repeat, origin, month) LEFT JOIN em USING (fraction, repeat, origin, entity_id, month)
        WHERE part = 'test') GROUP BY ALL),
sizes AS (SELECT fraction, repeat, origin FROM assigned GROUP BY ALL HAVING count(*) FILTER (WHERE part = 'train') >= 30 AND count(*) FILTER (WHERE part = 'test') >= 10),
skills AS (SELECT fraction, repeat, origin, 1 - max(mae) FILTER (WHERE rule = 'rule') / nullif(min(mae) FILTER (WHERE rule <> 'rule'), 0) AS skill FROM errors JOIN sizes USING (fraction, repeat, origin) GROUP BY ALL),
counted AS (SELECT fraction, repeat, count(*) AS n, count(DISTINCT entity_id) AS entities FROM rows GROUP BY ALL),
curve AS (SELECT s.fraction, s.repeat, any_value(n) AS n, avg(skill) AS skill FROM skills s JOIN counted c ON s.fraction = c.fraction AND s.repeat = c.repeat GROUP BY ALL),
summary AS (SELECT fraction, avg(skill) AS mean, stddev_samp(skill) AS sd, min(skill) AS min, max(skill) AS max, avg((skill <= 0)::INT) AS share_not_above_0, avg(n) AS mean_n FROM curve GROUP BY 1)"""


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill over samples of nations, at the grain of months, of least squares on the last change."""
    rows = periods.with_features(grained(spark, sf_dir, "month", "n_nationkey")).where("target is not null")
    rows = rows.select("entity_id", "period_start", "target_period_end", "target", F.col("period_change").alias("change"))
    return B.curve_summary(B.resampled_skill(rows, linear=["change"]))


@query(f"WITH {RESAMPLED} SELECT fraction, round(mean, 6) AS mean, round(sd, 6) AS sd, round(min, 6) AS min, round(max, 6) AS max, round(share_not_above_0, 6) AS share_not_above_0, round(mean_n, 6) AS mean_n FROM summary")
def resample_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve(spark, sf_dir)


@query(
    f"""WITH {RESAMPLED}, fit AS (SELECT regr_slope(ln(sd), ln(mean_n)) AS slope, exp(avg(ln(sd) + 0.5 * ln(mean_n))) AS c, max_by(mean, mean_n) AS effect FROM summary WHERE sd > 1e-12)
        SELECT round(slope, 6) AS slope, round(c, 6) AS c, round(effect, 6) AS effect, CASE WHEN effect > 0 THEN ceil(pow(1.96 * c / effect, 2))::BIGINT END AS required_n FROM fit"""
)
def required_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.required_size(curve(spark, sf_dir).where("sd > 1e-12"))


@query(
    f"""WITH {NAIVE}, fits AS (SELECT fold, regr_slope(target, coalesce(change, 0)) AS slope, regr_intercept(target, coalesce(change, 0)) AS intercept FROM train GROUP BY 1),
        model AS (SELECT w.fold, target AS y_true, intercept + slope * coalesce(change, 0) AS y_pred FROM wide w JOIN fits USING (fold)), board AS (SELECT fold, {METRICS} FROM model GROUP BY 1),
        bars AS (SELECT fold, min(mae) AS bar, arg_min(rule, (mae, rule)) AS bar_rule FROM (SELECT fold, rule, avg(abs(y_pred - y_true)) AS mae FROM predictions GROUP BY 1, 2) GROUP BY 1)
        SELECT fold, 'linear' AS rule, {SHOWN}, round(bar, 6) AS bar, bar_rule, round(1 - mae / nullif(bar, 0), 6) AS skill FROM board JOIN bars USING (fold)"""
)
def linear_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares on the last change, for all folds in one job, against each fold's best naive rule."""
    rows = held(long_targets(spark, sf_dir))
    split = B.assigned(rows, B.rolling_folds(rows))
    found = L.predicted(split.where("target is not null"), ["fold"], ["change"]).withColumns({"rule": F.lit("linear"), "y_true": F.col("target")})
    return B.with_skill(B.board(found), B.best(B.board(B.naive(split, B.DAILY_RULES))))


@query(
    f"""WITH {LONG_TARGET}, s AS (SELECT entity_id, (target > 100)::INT AS label, round(-change / 10, 0) AS score FROM targets), c AS (SELECT entity_id, score, sum(label) AS pos, count(*) AS n FROM s GROUP BY 1, 2),
        r AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY entity_id) AS p, sum(n) OVER (PARTITION BY entity_id) AS total FROM c WINDOW w AS (PARTITION BY entity_id ORDER BY score DESC)),
        m AS (SELECT entity_id, sum(pos / nullif(p, 0) * tp / seen) AS ap, sum((n - pos) * (tp - pos + pos / 2)) AS area, any_value(p) AS p, any_value(total) AS total FROM r GROUP BY 1)
        SELECT entity_id, round(ap, 6) AS average_precision, round(area / (p * (total - p)), 6) AS roc_auc, round(p / total, 6) AS positive_rate, round(ap / (p / total), 6) AS lift, total::BIGINT AS n FROM m WHERE p > 0 AND p < total"""
)
def classifier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision and ROC area of a rule's score for each entity, with ties."""
    rows = long_targets(spark, sf_dir).select("entity_id", (F.col("target") > 100).cast("int").alias("label"), F.round(-F.col("change") / 10, 0).alias("score"))
    return B.classifier_report(rows, by="entity_id")


@query(
    f"""WITH {LONG_TARGET}, d AS (SELECT obs_date, row_number() OVER (ORDER BY obs_date) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT obs_date FROM targets)), cut AS (SELECT obs_date AS c FROM d WHERE r = floor(n * 0.8) + 1)
        SELECT CASE WHEN obs_date < c THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(obs_date) AS first_date, max(obs_date) AS last_date FROM targets, cut GROUP BY 1"""
)
def date_share_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.date_share_split(long_targets(spark, sf_dir), 0.8)
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("obs_date").alias("first_date"), F.max("obs_date").alias("last_date"))
