"""Model boards over the long panel. Fits have no SQL twin: tests hold their parts against brute force."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import history
from strandline.plans import backtest as B
from strandline.plans import models as M
from strandline.queries.base import held, long_panel, query
from strandline.queries.grains import LONG_TARGET

COLUMNS = M.ladder()["history"]
CUT, BLOCKS = 200, 5


def rows_and_folds(spark: SparkSession, sf_dir: str, keep: int = 4) -> tuple[DataFrame, list[B.Fold]]:
    rows = held(history.candidates(long_panel(spark, sf_dir)).where(history.gate()))
    return rows, B.rolling_folds(rows, keep=keep)


def _board(spark: SparkSession, sf_dir: str, rules: dict[str, M.FitPredict], scale: str | None = None) -> DataFrame:
    """Boards of models with skill against each fold's best naive rule; ``scale`` gives rows the unit of a model that needs one."""
    rows, folds = rows_and_folds(spark, sf_dir)
    rows = held(M.on_scale(history.target_scale(rows), scale)) if scale else rows
    naive = B.board(B.naive(B.assigned(rows, folds)))
    return B.with_skill(B.board(M.out_of_folds(rows, folds, rules)), B.best(naive))


@query()
def rf_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir, {"rf": M.single(COLUMNS, "rf"), "linear": M.single(COLUMNS, "linear")})


@query()
def gbt_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir, {"gb": M.single(COLUMNS, "gb")})


@query()
def two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framings compared: hard gate, blend, the labelled upper bound, and scale-normalised."""
    extreme = F.abs("target") > CUT
    return _board(
        spark, sf_dir,
        {"framings": M.two_stages(COLUMNS, extreme), "scale_normalised": M.normalised_two_stage(COLUMNS, 2.0, unit="_unit")},
        "target_mad",
    )


@query()
def season_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir, {"pooled": M.single(COLUMNS), "flow_vs_rest": M.season_gated(COLUMNS, "flow_vs_rest")})


@query()
def feature_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds by rungs of the ladder: the error of each, as a pivot."""
    board = _board(spark, sf_dir, {f"{k}": M.single(c) for k, c in M.ladder().items()})
    return board.groupBy("fold").pivot("rule", list(M.LADDER)).agg(F.first("mae"))


@query()
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, folds = rows_and_folds(spark, sf_dir)
    split = held(B.assigned(rows, folds[-1:]))
    train = split.where("part = 'train'")
    model = M.regressor("rf").fit(M.matrix(train, COLUMNS, train=train))
    return M.permutation_importance(model, split.where("part = 'test'"), COLUMNS, ["entity_id", "obs_date"], train=train)


@query()
def impurity_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, folds = rows_and_folds(spark, sf_dir)
    train = B.assigned(rows, folds[-1:]).where("part = 'train'")
    model = M.regressor("rf").fit(M.matrix(train, COLUMNS, train=train))
    return M.impurity_importance(model, COLUMNS, spark)


@query()
def seed_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, folds = rows_and_folds(spark, sf_dir)
    return M.seed_boards(rows, folds, lambda seed: M.single(COLUMNS, "rf", seed))


def _definitions(relative: str = "relative_2_mad") -> dict[str, Column]:
    """Absolute cuts, and a cut relative to the entity's own scale."""
    return {f"absolute_{cut}": F.abs("target") > cut for cut in (50, 100, 200, 400)} | {relative: history.beyond(F.col("target"), F.col("target_mad"), 2.0)}


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.target_scale(history.candidates(long_panel(spark, sf_dir)).where(history.gate()))
    return B.date_split(rows, date(1997, 1, 1))


@query()
def classifier_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees of routine rows and a balanced classifier of extremes under five definitions, on one date split."""
    rows = held(_split(spark, sf_dir))
    return B.definition_sweep(rows, _definitions(), M.single(COLUMNS, "gb"), M.chance_of(COLUMNS))


def _sweep_sql(name: str, condition: str) -> str:
    return f"""SELECT '{name}' AS definition, sum(x)::BIGINT AS extremes, round(100.0 * avg(x), 6) AS extreme_pct, count(*) FILTER (WHERE x = 0) AS routine_rows,
        round(any_value(e.mae), 6) AS routine_mae, round(any_value(e.r2), 6) AS routine_r2,
        round(CASE WHEN count(*) FILTER (WHERE x = 1 AND part = 'train') >= 30 AND count(*) FILTER (WHERE x = 1 AND part = 'test') >= 5 THEN any_value(c.ap) END, 6) AS average_precision,
        round(CASE WHEN count(*) FILTER (WHERE x = 1 AND part = 'train') >= 30 AND count(*) FILTER (WHERE x = 1 AND part = 'test') >= 5 THEN any_value(c.roc) END, 6) AS roc_auc,
        round(CASE WHEN count(*) FILTER (WHERE x = 1 AND part = 'train') >= 30 AND count(*) FILTER (WHERE x = 1 AND part = 'test') >= 5 THEN any_value(c.lift) END, 6) AS lift
        FROM (SELECT *, coalesce({condition}, false)::INT AS x FROM scaled) r,
        (SELECT avg(abs(target - m)) AS mae, 1 - avg((target - m) * (target - m)) / nullif(var_pop(target), 0) AS r2 FROM (SELECT target, (SELECT avg(target) FROM scaled WHERE part = 'train' AND NOT coalesce({condition}, false)) AS m FROM scaled WHERE part = 'test' AND NOT coalesce({condition}, false))) e,
        (SELECT sum(pos / nullif(p, 0) * tp / seen) AS ap, sum((n - pos) * (tp - pos + pos / 2)) / nullif(any_value(p) * (any_value(total) - any_value(p)), 0) AS roc, sum(pos / nullif(p, 0) * tp / seen) / nullif(any_value(p) / any_value(total), 0) AS lift
         FROM (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER () AS p, sum(n) OVER () AS total
               FROM (SELECT round(abs(change), 0) AS score, sum(coalesce({condition}, false)::INT) AS pos, count(*) AS n FROM scaled WHERE part = 'test' GROUP BY 1) WINDOW w AS (ORDER BY score DESC))) c"""


@query(
    f"""WITH {LONG_TARGET}, middle AS (SELECT entity_id, median(target) AS m FROM targets GROUP BY 1), mads AS (SELECT t.entity_id, median(abs(target - m)) AS target_mad FROM targets t JOIN middle USING (entity_id) GROUP BY 1),
        scaled AS (SELECT t.*, target_mad, CASE WHEN obs_date < DATE '1997-01-01' THEN 'train' ELSE 'test' END AS part FROM targets t JOIN mads USING (entity_id))
        """
    + " UNION ALL ".join(_sweep_sql(f"absolute_{cut}", f"abs(target) > {cut}") for cut in (50, 100, 200, 400))
    + " UNION ALL "
    + _sweep_sql("relative_2_mad", "target_mad <> 0 AND abs(target) > 2 * 1.4826 * target_mad")
)
def definition_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep with plain predictors: the mean of routine training rows, and the size of the last change as score."""

    def mean(train: DataFrame, test: DataFrame) -> DataFrame:
        return test.withColumn("y_pred", train.agg(F.avg("target")).scalar())

    def last_change(train: DataFrame, test: DataFrame) -> DataFrame:
        return test.withColumn("score", F.round(F.abs("change"), 0))

    return B.definition_sweep(_split(spark, sf_dir), _definitions(), mean, last_change)


@query()
def group_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-entities-out error: each block of entities is scored by a model that never saw it."""
    rows, _ = rows_and_folds(spark, sf_dir, 1)
    blocks = B.group_folds(rows, BLOCKS).withColumnRenamed("fold", "block")
    met = held(rows.join(blocks, "entity_id"))
    parts = [M.single(COLUMNS) for _ in range(BLOCKS)]
    found = M.side_by_side(spark, [lambda k=k, p=p: p(met.where(F.col("block") != k), met.where(F.col("block") == k)) for k, p in enumerate(parts, 1)])
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out.withColumn("y_true", F.col("target")).groupBy("block").agg(*B.metrics())
