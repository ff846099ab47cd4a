"""Boards over weeks and months: target anchors, labelling rules, net against gross, and rungs with an upper bound.

The first two have plain predictors, and so an SQL twin; the others fit models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import extremes, periods
from strandline.plans import backtest as B
from strandline.plans import models as M
from strandline.queries.backtests import ORIGINS
from strandline.queries.base import LONG, held, query
from strandline.queries.grains import FEATURES, MONTHS, WEEKS, grained, gross

GRAINS = ("week", "month")
MONTH_GRAIN = MONTHS.removeprefix(LONG + ",").replace("stepped", "stepped_m").replace("numbered", "numbered_m").replace("grained", "grained_m")
COLUMNS = ["period_change", "previous_period_change", "rolling_change", "minus_rolling", "period_level", "sin_year", "cos_year"]


def reversal(train: DataFrame, test: DataFrame) -> DataFrame:
    """A predictor that learns nothing: half of the last change is taken back."""
    return test.withColumn("y_pred", F.coalesce(-F.col("change") / 2, F.lit(0.0)))


def last_size(train: DataFrame, test: DataFrame) -> DataFrame:
    """A score that learns nothing: the size of the last change."""
    return test.withColumn("score", F.round(F.abs(F.coalesce("change", F.lit(0.0))), 0))


def prepared(panel: DataFrame, anchor: str) -> DataFrame:
    """Periods with a target, ready for the protocol, which reads them once for each fold: so they are kept."""
    return held(periods.with_features(panel, anchor).where("target is not null").withColumn("change", F.col("period_change")))


def _anchors(spark: SparkSession, sf_dir: str, predictor: M.FitPredict) -> DataFrame:
    out = None
    for grain in GRAINS:
        panel = held(grained(spark, sf_dir, grain))
        for anchor in ("last", "mean"):
            one = M.head_to_head(prepared(panel, anchor), predictor).select(F.lit(grain).alias("grain"), F.lit(anchor).alias("anchor"), "*")
            out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH {WEEKS}, {MONTH_GRAIN},
    kinds AS (
        SELECT 'week' AS grain, 'last' AS anchor, entity_id, period_index, period_start, period_end, last_level AS v FROM grained UNION ALL SELECT 'week', 'mean', entity_id, period_index, period_start, period_end, mean_level FROM grained
        UNION ALL SELECT 'month', 'last', entity_id, period_index, period_start, period_end, last_level FROM grained_m UNION ALL SELECT 'month', 'mean', entity_id, period_index, period_start, period_end, mean_level FROM grained_m),
    t AS (
        SELECT *, month(period_start) AS month FROM (
            SELECT grain, anchor, entity_id, period_start, CASE WHEN lead(period_index) OVER w - period_index = 1 THEN lead(v) OVER w - v END AS target, CASE WHEN lead(period_index) OVER w - period_index = 1 THEN lead(period_end) OVER w END AS target_period_end,
                   coalesce(CASE WHEN period_index - lag(period_index) OVER w = 1 THEN v - lag(v) OVER w END, 0) AS change
            FROM kinds WINDOW w AS (PARTITION BY grain, anchor, entity_id ORDER BY period_index)) WHERE target IS NOT NULL),
    bounds AS (SELECT grain, anchor, min(period_start) AS first, max(period_start) AS last FROM t GROUP BY ALL),
    origin_dates AS (SELECT grain, anchor, last, CAST(first + INTERVAL (12 + 6 * k) MONTH AS DATE) AS origin, CAST(first + INTERVAL (18 + 6 * k) MONTH AS DATE) AS horizon_end FROM bounds, (SELECT unnest(range(0, 200)) AS k)),
    kept AS (SELECT *, row_number() OVER (PARTITION BY grain, anchor ORDER BY origin DESC) AS back FROM origin_dates WHERE horizon_end <= last + INTERVAL 1 DAY),
    folds AS (SELECT grain, anchor, origin, horizon_end, min(period_start) AS test_start FROM kept JOIN t USING (grain, anchor) WHERE back <= 4 AND period_start >= origin AND period_start < horizon_end GROUP BY ALL),
    assigned AS (
        SELECT t.*, origin, CASE WHEN period_start >= origin THEN 'test' ELSE 'train' END AS part FROM t JOIN folds f ON t.grain = f.grain AND t.anchor = f.anchor
        AND ((period_start >= origin AND period_start < horizon_end) OR (period_start < origin AND target_period_end < test_start))),
    train AS (SELECT * FROM assigned WHERE part = 'train'), o AS (SELECT grain, anchor, origin, avg(target) AS m FROM train GROUP BY ALL), e AS (SELECT grain, anchor, origin, entity_id, avg(target) AS m FROM train GROUP BY ALL),
    mo AS (SELECT grain, anchor, origin, month, avg(target) AS m FROM train GROUP BY ALL), em AS (SELECT grain, anchor, origin, entity_id, month, avg(target) AS m FROM train GROUP BY ALL),
    errors AS (
        SELECT grain, anchor, origin, rule, avg(abs(y - p)) AS mae FROM (
            SELECT a.grain, a.anchor, a.origin, a.target AS y, unnest(['zero', 'train_mean', 'persistence', 'entity_mean', 'month_mean', 'entity_month', 'model']) AS rule,
                   unnest([0.0::DOUBLE, o.m, change, coalesce(e.m, o.m), coalesce(mo.m, o.m), coalesce(em.m, mo.m, o.m), -change / 2]) AS p
            FROM assigned a JOIN o USING (grain, anchor, origin) LEFT JOIN e USING (grain, anchor, origin, entity_id) LEFT JOIN mo USING (grain, anchor, origin, month) LEFT JOIN em USING (grain, anchor, origin, entity_id, month)
            WHERE part = 'test') GROUP BY ALL),
    rules AS (SELECT grain, anchor, rule, avg(mae) AS mae FROM errors WHERE rule <> 'model' GROUP BY ALL), winners AS (SELECT grain, anchor, arg_min(rule, (mae, rule)) AS best_naive FROM rules GROUP BY ALL),
    bars AS (SELECT grain, anchor, origin, min(mae) FILTER (WHERE rule <> 'model') AS bar, max(mae) FILTER (WHERE rule = 'model') AS mae FROM errors GROUP BY ALL),
    scored AS (SELECT grain, anchor, avg(bar) AS naive_mae, avg(mae) AS model_mae, avg(1 - mae / nullif(bar, 0)) AS skill FROM bars GROUP BY ALL),
    sizes AS (SELECT grain, anchor, count(*) AS n, stddev_samp(target) AS target_sd FROM t GROUP BY ALL)
    SELECT grain, anchor, n, round(target_sd, 6) AS target_sd, best_naive, round(naive_mae, 6) AS naive_mae, round(model_mae, 6) AS model_mae, round(skill, 6) AS skill FROM sizes LEFT JOIN winners USING (grain, anchor) LEFT JOIN scored USING (grain, anchor)"""
)
def anchor_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of the target head to head, by the whole protocol, with a predictor that learns nothing."""
    return _anchors(spark, sf_dir, reversal)


@query()
def anchor_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of the target head to head, with a forest."""
    return _anchors(spark, sf_dir, M.single(COLUMNS))


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, float, float]:
    """Weeks, an absolute cut of 1.5 standard deviations, and the multiple of an entity's scale that marks as many weeks."""
    rows = prepared(grained(spark, sf_dir, "week"), "mean")
    cut = extremes.sd_threshold(rows, sigma=1.5).first().threshold or 0.0
    rate = rows.agg(F.avg((F.abs("target") > cut).cast("double"))).first()[0] or 0.0
    multiplier = extremes.matched_multiplier(rows, rate, scale="entity_change_mad").first().multiplier or 0.0
    return rows, cut, multiplier


def _rules(cut: float, multiplier: float) -> dict:
    return {"absolute": F.abs("target") > cut, "relative": extremes.relative_flag(multiplier, scale="entity_change_mad")}


@query(
    f"""WITH {FEATURES}, t AS (SELECT entity_id, period_start, target_period_end, target, entity_change_mad AS scale, round(abs(coalesce(period_change, 0)), 0) AS score FROM features WHERE target IS NOT NULL),
    cut AS (SELECT 1.5 * stddev_samp(target) AS c FROM t), rate AS (SELECT avg((abs(target) > c)::INT) AS r FROM t, cut), multiple AS (
        SELECT x[floor(p)::BIGINT + 1] + (x[ceil(p)::BIGINT + 1] - x[floor(p)::BIGINT + 1]) * (p - floor(p)) AS m
        FROM (SELECT list_sort(list(coalesce(abs(target) / nullif(scale, 0), 0))) AS x, (1 - any_value(r)) * (count(*) - 1) AS p FROM t, rate)),
    labelled AS (SELECT t.*, 'absolute' AS rule, (abs(target) > c)::INT AS label FROM t, cut UNION ALL SELECT t.*, 'relative', coalesce(abs(target) > m * scale, false)::INT FROM t, multiple),
    {ORIGINS.format(day="period_start", source="t").replace("folds AS (", "plain_folds AS (")},
    folds AS (SELECT f.*, (SELECT min(period_start) FROM t WHERE t.period_start >= f.origin AND t.period_start < f.horizon_end) AS test_start FROM plain_folds f),
    assigned AS (SELECT l.*, fold, CASE WHEN period_start >= origin THEN 'test' ELSE 'train' END AS part FROM labelled l JOIN folds f ON (period_start >= origin AND period_start < horizon_end) OR (period_start < origin AND target_period_end < test_start)),
    sizes AS (SELECT rule, fold, count(*) FILTER (WHERE part = 'train' AND label = 1) AS train_positives, count(*) FILTER (WHERE part = 'test' AND label = 1) AS test_positives FROM assigned GROUP BY ALL),
    c AS (SELECT rule, fold, score, sum(label) AS pos, count(*) AS n FROM assigned WHERE part = 'test' GROUP BY ALL),
    r AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY rule, fold) AS p, sum(n) OVER (PARTITION BY rule, fold) AS total FROM c WINDOW w AS (PARTITION BY rule, fold ORDER BY score DESC)),
    m AS (SELECT rule, fold, sum(pos / nullif(p, 0) * tp / seen) AS ap, sum((n - pos) * (tp - pos + pos / 2)) / nullif(any_value(p) * (any_value(total) - any_value(p)), 0) AS roc, any_value(p) / any_value(total) AS share, any_value(total) AS n FROM r GROUP BY ALL)
    SELECT rule, fold, n::BIGINT AS n, train_positives, test_positives, round(CASE WHEN train_positives >= 5 AND test_positives >= 2 AND share < 1 THEN ap END, 6) AS average_precision,
        round(CASE WHEN train_positives >= 5 AND test_positives >= 2 AND share < 1 THEN roc END, 6) AS roc_auc, round(CASE WHEN train_positives >= 5 AND test_positives >= 2 AND share < 1 THEN ap / nullif(share, 0) END, 6) AS lift FROM m JOIN sizes USING (rule, fold)"""
)
def label_rule_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well extremes are told under an absolute and an equally frequent relative rule, by the size of the last change."""
    rows, cut, multiplier = _labels(spark, sf_dir)
    return M.label_board(rows, B.rolling_folds(rows, "period_start"), _rules(cut, multiplier), last_size)


@query()
def label_rule_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a balanced forest."""
    rows, cut, multiplier = _labels(spark, sf_dir)
    return M.label_board(rows, B.rolling_folds(rows, "period_start"), _rules(cut, multiplier), M.chance_of(COLUMNS))


@query()
def label_rule_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-stage models end to end under both labelling rules."""
    rows, cut, multiplier = _labels(spark, sf_dir)
    rows = held(M.on_scale(rows, "entity_change_mad"))
    return M.protocol(rows, {"absolute": M.two_stage(COLUMNS, F.abs("target") > cut, blend=True), "relative": M.normalised_two_stage(COLUMNS, multiplier, blend=True, unit="_unit")})


@query()
def target_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net and gross target, each with two models and its best naive rule."""
    rows = held(gross(spark, sf_dir).withColumn("change", F.col("period_change")))
    out = None
    for kind, column in (("net", "target"), ("gross", "gross_target")):
        own = rows.withColumn("target", F.col(column)).where("target is not null")
        one = M.protocol(own, {"rf": M.single(COLUMNS, "rf"), "gb": M.single(COLUMNS, "gb")}, best_naive=True).withColumn("target_kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def ladder_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rungs of features with their size and what they may be used for: the last one knows the next period's removals."""
    rows = held(gross(spark, sf_dir).where("target is not null and removed_next is not null").withColumn("change", F.col("period_change")))
    rungs = M.ladder({"calendar": ("sin_year", "cos_year"), "history": ("period_change", "rolling_change", "minus_rolling", "period_level"), "next_removals": ("removed_next",)})
    return M.rung_board(rows, rungs, allow=("removed_next",))
