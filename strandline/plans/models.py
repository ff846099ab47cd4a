"""Spark ML models in the back-test: regressors, balanced classifiers, two-stage and season-gated models, importance.

Features of all folds are one stored table with fold marks. Fits of folds, seeds and rungs are Spark jobs that the driver starts
side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.operators.history import DEFAULT, Panel, forward_filled, quantiles, running_before, small
from strandline.plans import backtest as B
from strandline.plans.backtest import Fold
from strandline.sources.sinks import stored

T = TypeVar("T")

#: Columns that are only known after the day a prediction is made for: the target and what it is made of, flags and distances
#: that look ahead (to the next level, a centred window or the next event), and statistics of an entity's whole record.
FORBIDDEN = frozenset(
    {
        "target", "gross_target", "next_level", "next_date", "gap_after", "target_period_end", "removed_next",
        "local_median", "implausible", "robust_outlier", "dropout",
        "target_mad", "entity_median", "entity_mad", "change_mad", "minus_entity_median", "entity_change_mad",
    }
)
FEATURES = "features"
FORBIDDEN_PREFIXES, FORBIDDEN_SUFFIXES = ("next_", "extreme_", "nearest_"), ("_next_dif",)

#: Rungs of the ablation ladder: each adds to the one before.
LADDER = {
    "calendar": ("sin_day_of_year", "cos_day_of_year"),
    "history": ("change", "minus_mean_3", "minus_mean_7", "slope_2", "slope_7"),
    "level": ("level", "mean_3", "mean_7", "sd_7"),
}


def ladder(rungs: dict[str, tuple[str, ...]] = LADDER) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    columns: list[str] = []
    for name, own in rungs.items():
        columns = [*columns, *own]
        out[name] = columns
    return out


def assert_no_leakage(columns: Iterable[str], allow: Iterable[str] = ()) -> list[str]:
    """The columns; ValueError if one looks past its day and isn't allowed by name."""
    columns = list(columns)
    bad = [c for c in columns if (c in FORBIDDEN or c.startswith(FORBIDDEN_PREFIXES) or c.endswith(FORBIDDEN_SUFFIXES)) and c not in set(allow)]
    if bad:
        raise ValueError(f"columns from the future: {', '.join(bad)}")
    return columns


def _assembled(filled: DataFrame, columns: list[str]) -> DataFrame:
    filled = filled.withColumns({f"_{c}_was_missing": F.col(c).isNull().cast("double") for c in columns})
    inputs = [f"_{c}" for c in columns] + [f"_{c}_was_missing" for c in columns]
    return VectorAssembler(inputCols=inputs, outputCol=FEATURES).transform(filled).drop(*inputs)


def matrix(frame: DataFrame, columns: list[str], allow: Iterable[str] = (), train: DataFrame | None = None, entity: str = "entity_id") -> DataFrame:
    """``frame`` with ``features``: the columns, then for each whether it was missing.

    A missing value becomes the median of its entity's rows in ``train``, else the median of all of them, else 0. Give a
    fold's training rows as ``train``, so that nothing is learnt from its test rows; without it missing values become 0.
    A frame of ``fold_matrix`` has its features already.
    """
    assert_no_leakage(columns, allow)
    if FEATURES in frame.columns:
        return frame
    if train is None:
        return _assembled(frame.withColumns({f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}), columns)
    learnt = train.withColumns({"fold": F.lit("_"), "part": F.lit("train")})
    return _filled(frame.withColumn("_fold", F.lit("_")), learnt, "_fold", columns, entity).drop("_fold")


def _filled(frame: DataFrame, rows: DataFrame, fold: str, columns: list[str], entity: str) -> DataFrame:
    """``frame`` with features whose gaps are filled from the training rows of the fold that the column ``fold`` names."""
    train = rows.where("part = 'train'")
    own = train.groupBy(F.col("fold").alias("_f"), F.col(entity).alias("_entity")).agg(*[F.percentile(F.col(c).cast("double"), F.lit(0.5)).alias(f"_m_{c}") for c in columns])
    overall = train.groupBy(F.col("fold").alias("_f")).agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 10_000).alias(f"_a_{c}") for c in columns])
    met = frame.join(own, (F.col(fold) == F.col("_f")) & (F.col(entity) == F.col("_entity")), "left").drop("_f", "_entity")
    met = met.join(F.broadcast(overall), F.col(fold) == F.col("_f"), "left").drop("_f")  # one row for each fold
    met = met.withColumns({f"_{c}": F.coalesce(F.col(c).cast("double"), f"_m_{c}", f"_a_{c}", F.lit(0.0)) for c in columns})
    return _assembled(met, columns).drop(*[f"_{k}_{c}" for c in columns for k in "ma"])


def feature_table(frame: DataFrame, columns: list[str], fill: str = "forward", target: str = "target", p: Panel = DEFAULT) -> DataFrame:
    """Entity, date, target and ``columns``, with year, month, season and the table's extreme_* and *_flag columns for segments.

    ``fill`` is "forward" (the entity's last present value, with <column>_was_missing; what precedes the first one gets the
    median of the entity's filled values, else that of all) or "none" (gaps stay). These medians see all rows: for a back-test
    use ``matrix``, which learns them from training rows. ValueError for a column from the future or another fill.
    """
    assert_no_leakage(columns)
    if fill not in ("forward", "none"):
        raise ValueError(f"no fill is called {fill}")
    marks = [c for c in frame.columns if (c.startswith("extreme_") or c.endswith("_flag")) and c not in columns]
    date = F.col(p.date)
    rows = frame.select(p.entity, p.date, F.col(target).alias("target"), *columns, *marks).withColumns({"year": F.year(date), "month": F.month(date), "season": C.season(date)})
    if fill == "none":
        return rows
    filled = stored(forward_filled(rows, columns, p), "filled")
    own = filled.groupBy(F.col(p.entity).alias("_e")).agg(*[F.percentile(F.col(c).cast("double"), F.lit(0.5)).alias(f"_m_{c}") for c in columns])
    met = filled.join(small(own), F.col(p.entity).eqNullSafe(F.col("_e")), "left")
    overall = {c: quantiles(filled, [], c, (0.5,)).select("q0").scalar() for c in columns}
    return met.withColumns({c: F.coalesce(F.col(c).cast("double"), f"_m_{c}", overall[c]) for c in columns}).drop("_e", *[f"_m_{c}" for c in columns])


def fold_matrix(rows: DataFrame, columns: list[str], allow: Iterable[str] = (), entity: str = "entity_id") -> DataFrame:
    """The rows of all folds (fold, part) with ``features``, stored once: each fold's gaps are filled from its own training rows,
    by one aggregation for all folds."""
    assert_no_leakage(columns, allow)
    return stored(_filled(rows, rows, "fold", columns, entity), "fold-matrix")


def side_by_side(spark: SparkSession, tasks: list[Callable[[], T]], most: int = 4) -> list[T]:
    """The results of ``tasks``, each a chain of Spark jobs, with up to ``most`` of them running at a time in a fair pool.

    They share the executors' slots, so small fits don't wait for one another. Job groups and other local properties are
    those of the caller, and the first error is raised.
    """
    context = spark.sparkContext
    pool = context.getLocalProperty("spark.scheduler.pool")

    def run(task: Callable[[], T]) -> T:
        context.setLocalProperty("spark.scheduler.pool", pool or "fits")
        return task()

    with ThreadPoolExecutor(max(1, min(most, len(tasks)))) as threads:
        return [f.result() for f in [threads.submit(inheritable_thread_target(spark)(run), task) for task in tasks]]


def regressor(name: str = "gb", seed: int = 42, target: str = "target", **options):
    """rf, gb, hist_gb or lightgbm (all gradient-boosted trees of Spark), or linear."""
    common = {"labelCol": target, "featuresCol": "features", "predictionCol": "y_pred"}
    if name == "rf":
        return RandomForestRegressor(**common, seed=seed, **{"numTrees": 200, "maxDepth": 6, **options})
    if name in ("gb", "hist_gb", "lightgbm"):
        return GBTRegressor(**common, seed=seed, **{"maxIter": 10, "maxDepth": 3, **options})
    if name == "linear":
        return LinearRegression(**common, **{"regParam": 0.1, **options})
    raise ValueError(f"no regressor is called {name}")


def classifier(name: str = "rf", seed: int = 42, label: str = "label", balanced: bool = True, **options):
    common = {"labelCol": label, "featuresCol": "features"} | ({"weightCol": "weight"} if balanced else {})
    if name == "rf":
        return RandomForestClassifier(**common, seed=seed, **{"numTrees": 300, "maxDepth": 6, **options})
    if name == "gb":
        return GBTClassifier(**common, seed=seed, **{"maxIter": 10, "maxDepth": 3, **options})
    if name == "linear":
        return LogisticRegression(**common, **{"regParam": 0.1, **options})
    raise ValueError(f"no classifier is called {name}")


def balanced(frame: DataFrame, label: str = "label") -> DataFrame:
    """``weight`` such that both classes weigh the same: one aggregation."""
    row = frame.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    ones, zeros = max(1, row[0]), max(1, row[1])
    total = ones + zeros
    return frame.withColumn("weight", F.when(F.col(label) == 1, total / (2.0 * ones)).otherwise(total / (2.0 * zeros)))


def probability(model: Model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("chance", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


FitPredict = Callable[[DataFrame, DataFrame], DataFrame]


def using(columns: list[str], allow: Iterable[str] = ()) -> Callable[[FitPredict], FitPredict]:
    """Marks a predictor with the columns of its features, so that these are assembled once for all folds."""

    def mark(run: FitPredict) -> FitPredict:
        run.columns, run.allow = list(columns), tuple(allow)
        return run

    return mark


def single(columns: list[str], name: str = "rf", seed: int = 42, allow: Iterable[str] = ()) -> FitPredict:
    """Fit one regressor on the training rows and score the test rows; ``allow`` names columns from the future, for a bound."""

    @using(columns, allow)
    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        return regressor(name, seed).fit(matrix(train, columns, allow, train)).transform(matrix(test, columns, allow, train))

    return run


def two_stage(columns: list[str], extreme: Column, blend: bool = False, oracle: bool = False, least: int = 30, name: str = "rf", seed: int = 42) -> FitPredict:
    """A classifier sends rows to a regressor of routine or of extreme rows, by a hard gate or weighted by its chance.

    With fewer than ``least`` extreme training rows only the routine regressor is used, and without routine ones a regressor
    of all. ``oracle`` gates by the label itself: an upper bound, not a forecast.
    """
    one = two_stages(columns, extreme, ("labelled_bound" if oracle else "blend" if blend else "hard_gate",), least, name, seed)

    @using(columns)
    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        return one(train, test).withColumn("y_pred", F.col(*one.framings.values()))

    return run


def two_stages(columns: list[str], extreme: Column, framings: Iterable[str] = ("hard_gate", "blend", "labelled_bound"), least: int = 30, name: str = "rf", seed: int = 42) -> FitPredict:
    """``two_stage`` in several framings, each a rule of its own: they share a fold's regressors and classifier."""
    framings = {f: f"_y_{f}" for f in framings}

    @using(columns)
    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        rows = matrix(train, columns, train=train).withColumn("label", F.when(extreme, 1).otherwise(0)).persist()
        n, others = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
        routine = regressor(name, seed).setPredictionCol("_routine").fit(rows.where("label = 0") if others else rows)
        out = routine.transform(matrix(test, columns, train=train))
        if n < least or not others:
            rows.unpersist()
            return out.withColumns({column: F.col("_routine") for column in framings.values()})
        out = regressor(name, seed).setPredictionCol("_extreme").fit(rows.where("label = 1")).transform(out)
        if set(framings) - {"labelled_bound"}:
            out = probability(classifier("rf", seed).fit(balanced(rows)), out)
        rows.unpersist()
        gates = {"hard_gate": lambda: F.when(F.col("chance") >= 0.5, 1.0).otherwise(0.0), "blend": lambda: F.col("chance"), "labelled_bound": lambda: F.when(extreme, 1.0).otherwise(0.0)}
        return out.withColumns({column: gates[f]() * F.col("_extreme") + (1 - gates[f]()) * F.col("_routine") for f, column in framings.items()})

    run.framings = framings
    return run


def season_gated(columns: list[str], scheme: str, date: str = "obs_date", least: int = 150, name: str = "rf", seed: int = 42) -> FitPredict:
    """One regressor for each regime with at least ``least`` training rows; a pooled one for the others."""

    @using(columns)
    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        label = C.labelled(F.month(date), scheme)
        rows = matrix(train, columns, train=train).withColumn("_regime", label).persist()
        sizes = {r[0]: r[1] for r in rows.groupBy("_regime").count().collect()}  # at most 12 regimes
        out = regressor(name, seed).setPredictionCol("_pooled").fit(rows).transform(matrix(test, columns, train=train)).withColumn("_regime", label)
        choice = F.col("_pooled")
        for k, regime in enumerate(sorted(r for r, n in sizes.items() if r is not None and n >= least)):
            out = regressor(name, seed).setPredictionCol(f"_own_{k}").fit(rows.where(F.col("_regime") == regime)).transform(out)
            choice = F.when(F.col("_regime") == regime, F.col(f"_own_{k}")).otherwise(choice)
        rows.unpersist()
        return out.withColumn("y_pred", choice)

    return run


def by_fold(rows: DataFrame, folds: list[Fold], predictors: dict[str, FitPredict]) -> dict[tuple[str, str], DataFrame]:
    """What each predictor makes of each fold's training and test rows (part), keyed by predictor and fold.

    Predictors of the same columns share one matrix of all folds; fits of all folds and predictors run side by side.
    """
    made: dict[tuple, DataFrame] = {}

    def prepared(predictor: FitPredict) -> DataFrame:
        columns = getattr(predictor, "columns", None)
        if columns is None:
            return rows
        key = (tuple(columns), tuple(sorted(predictor.allow)))
        if key not in made:
            made[key] = fold_matrix(rows, *key)
        return made[key]

    keys, tasks = [], []
    for name, predictor in predictors.items():
        whole = prepared(predictor)
        for f in folds:
            own = whole.where(F.col("fold") == f.name)
            keys.append((name, f.name))
            tasks.append(lambda p=predictor, own=own: p(own.where("part = 'train'").drop("fold", "part"), own.where("part = 'test'")))
    return dict(zip(keys, side_by_side(rows.sparkSession, tasks), strict=True))


def out_of_folds(frame: DataFrame, folds: list[Fold], predictors: dict[str, FitPredict], column: str = "obs_date", label_end: str | None = None, target: str = "target") -> DataFrame:
    """Long predictions of all folds' test rows: the rows with fold, rule, rule_order, y_true and y_pred.

    A predictor with ``framings`` (rule to column) gives the predictions of these rules instead of one in y_pred.
    """
    rows = B.assigned(frame.where(F.col(target).isNotNull()), folds, column, label_end)
    out = None
    for (rule, _), found in by_fold(rows, folds, predictors).items():
        framings = getattr(predictors[rule], "framings", {rule: "y_pred"})
        told = F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(99).alias("rule_order"), F.col(target).alias("y_true"), F.col(y_pred).alias("y_pred")) for name, y_pred in framings.items()]))
        found = found.select(*rows.columns, told)
        out = found if out is None else out.unionByName(found)
    if out is None:  # no folds, so no rows
        return rows.withColumns({"rule": F.lit(""), "rule_order": F.lit(99), "y_true": F.col(target).cast("double"), "y_pred": F.lit(0.0)})
    return out


def out_of_fold(frame: DataFrame, folds: list[Fold], fit_predict: FitPredict, rule: str, column: str = "obs_date", label_end: str | None = None, target: str = "target") -> DataFrame:
    """``out_of_folds`` of one predictor."""
    return out_of_folds(frame, folds, {rule: fit_predict}, column, label_end, target)


def _boards(frame: DataFrame, predictors: dict[str, FitPredict], column: str, label_end: str, rules: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Boards of the predictors and of the naive rules over the same embargoed folds."""
    folds = B.rolling_folds(frame, column)
    naive = B.board(B.naive(B.assigned(frame, folds, column, label_end), rules, date_column=column))
    return B.board(out_of_folds(frame, folds, predictors, column, label_end)), naive


def protocol(
    frame: DataFrame, predictors: dict[str, FitPredict], column: str = "period_start", label_end: str = "target_period_end", rules: tuple[str, ...] = B.PERIOD_RULES, best_naive: bool = False,
) -> DataFrame:
    """Boards over embargoed rolling folds with skill against each fold's best naive rule.

    With ``best_naive`` also the board of the one naive rule whose mean error over the folds is least, as naive_<rule>.
    """
    boards, naive = _boards(frame, predictors, column, label_end, rules)
    if best_naive:
        least = naive.where(F.col("rule") == B.best(naive, per_fold=False).select("bar_rule").scalar())
        boards = boards.unionByName(least.withColumn("rule", F.concat(F.lit("naive_"), "rule")))
    return B.with_skill(boards, B.best(naive))


def head_to_head(frame: DataFrame, predictor: FitPredict, column: str = "period_start", label_end: str = "target_period_end", rules: tuple[str, ...] = B.PERIOD_RULES, target: str = "target") -> DataFrame:
    """One row for a prepared table: its size and spread, the best naive rule, and mean errors and skill over the folds. An
    empty table has none."""
    boards, naive = _boards(frame, {"model": predictor}, column, label_end, rules)
    scored = B.with_skill(boards, B.best(naive)).agg(F.avg("bar").alias("naive_mae"), F.avg("mae").alias("model_mae"), F.avg("skill").alias("skill"))
    out = frame.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(target).alias("target_sd"))
    return out.withColumn("best_naive", B.best(naive, per_fold=False).select("bar_rule").scalar()).where("n > 0").crossJoin(scored)  # one row each


def label_board(
    frame: DataFrame, folds: list[Fold], rules: dict[str, Column], chance: FitPredict, column: str = "period_start", label_end: str = "target_period_end", least_train: int = 5, least_test: int = 2,
) -> DataFrame:
    """(rule, fold, n, positives, classifier metrics): how well rows are told under each labelling rule.

    With under ``least_train`` or ``least_test`` positives in a fold its metrics are NULL; the row stays. No folds, no rows.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(label, F.lit(False)).cast("int").alias("label")) for name, label in rules.items()])
    rows = B.assigned(frame, folds, column, label_end).withColumn("_x", F.explode(cells)).select("*", "_x.*").drop("_x")
    sizes = rows.groupBy("rule", "fold").agg(*[F.count_if((F.col("part") == part) & (F.col("label") == 1)).alias(f"{part}_positives") for part in ("train", "test")])
    scores = rows.select("rule", "fold", "label", F.lit(0.0).alias("score")).where("false")
    columns = getattr(chance, "columns", None)
    whole = rows if columns is None or not folds else fold_matrix(rows, columns, chance.allow)
    tasks = []
    for name in rules:
        for f in folds:
            own = whole.where((F.col("rule") == name) & (F.col("fold") == f.name))
            tasks.append(lambda own=own: chance(own.where("part = 'train'"), own.where("part = 'test'")).select("rule", "fold", "label", "score"))
    for one in side_by_side(frame.sparkSession, tasks) if tasks else ():
        scores = scores.unionByName(one)
    told = B.classifier_report(scores, by=["rule", "fold"]).drop("positive_rate")
    enough = (F.col("train_positives") >= least_train) & (F.col("test_positives") >= least_test)
    return sizes.join(told, ["rule", "fold"]).withColumns({c: F.when(enough, F.col(c)) for c in ("average_precision", "roc_auc", "lift")})


def rung_board(frame: DataFrame, rungs: dict[str, list[str]], allow: Iterable[str] = (), names: tuple[str, ...] = ("rf",)) -> DataFrame:
    """``protocol`` for each rung and model, with the rung's number of features and whether it is deployable or, as it uses a
    column that ``allow`` takes from the future, an upper bound."""
    allow = set(allow)
    boards = protocol(frame, {f"{rung}|{name}": single(columns, name, allow=allow & set(columns)) for rung, columns in rungs.items() for name in names})
    boards = boards.withColumns({"model": F.split_part("rule", F.lit("|"), F.lit(2)), "rule": F.split_part("rule", F.lit("|"), F.lit(1))})
    about = F.create_map(*[x for r, c in rungs.items() for x in (F.lit(r), F.struct(F.lit(len(c)).cast("long").alias("n_features"), F.lit("upper_bound" if allow & set(c) else "deployable").alias("use")))])
    return boards.withColumn("_about", about[F.col("rule")]).select("*", "_about.*").drop("_about").withColumnRenamed("rule", "rung")


def seed_boards(frame: DataFrame, folds: list[Fold], make: Callable[[int], FitPredict], seeds: Iterable[int] = (0, 1, 2)) -> DataFrame:
    """(seed, mae) over all folds' test rows."""
    found = out_of_folds(frame, folds, {str(seed): make(seed) for seed in seeds}, "obs_date")
    return found.groupBy(F.col("rule").cast("long").alias("seed")).agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"), F.count(F.lit(1)).alias("n"))


def ranges(boards: DataFrame, by: str, metric: str = "mae") -> DataFrame:
    """(by, other, low, high, other_low, other_high, apart): whether the ranges of a metric don't overlap, for every pair."""
    one = boards.groupBy(by).agg(F.min(metric).alias("low"), F.max(metric).alias("high"))
    other = one.select(F.col(by).alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    met = one.join(F.broadcast(other), F.col(by) < F.col("other"))  # a row for each rule
    return met.withColumn("apart", (F.col("high") < F.col("other_low")) | (F.col("other_high") < F.col("low")))


def ranges_apart(a: DataFrame, b: DataFrame, metric: str = "mae") -> bool:
    """Whether the ranges of two seed tables don't overlap."""
    x, y = (f.agg(F.min(metric), F.max(metric)).first() for f in (a, b))
    return x[1] < y[0] or y[1] < x[0]


def permuted(rows: DataFrame, columns: list[str], key: list[str], repeats: int, seed: int = 42) -> DataFrame:
    """``rows`` once for each repeat with _s_<column>: the columns of another row, by a permutation of all rows.

    Two orders by hash are ranked, each in two phases over ranges, and joined on rank: whatever the number of rows, any row
    may get any row's values, and each row's are given once.
    """
    copies = stored(rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_one", F.lit(1)), "permuted-rows")

    def ranked(k: int) -> DataFrame:
        hashed = copies.withColumn("_h", F.xxhash64(*key, "repeat", F.lit(seed + k)))
        return running_before(hashed, ["repeat"], "_h", ["_one"], key).withColumnRenamed("_one_before", "_rank").drop("_h", "_one")

    given = ranked(1).select("repeat", "_rank", *[F.col(c).alias(f"_s_{c}") for c in columns])
    return ranked(0).join(given, ["repeat", "_rank"]).drop("_rank")


def permutation_importance(model: Model, test: DataFrame, columns: list[str], key: list[str], repeats: int = 5, target: str = "target", train: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """(feature, mean, sd): by how much the error grows when a feature's values are shuffled among all rows.

    ``train`` has the training rows that the model's gaps were filled from. All shuffled copies are scored in one pass.
    """
    which = permuted(test, columns, key, repeats, seed).withColumn("feature", F.explode(F.array(F.lit(""), *map(F.lit, columns))))
    which = which.withColumns({c: F.when(F.col("feature") == c, F.col(f"_s_{c}")).otherwise(F.col(c)) for c in columns})
    scored = model.transform(matrix(which, columns, train=train))
    errors = scored.groupBy("feature", "repeat").agg(F.avg(F.abs(F.col("y_pred") - F.col(target))).alias("mae"))
    base = errors.where("feature = ''").select("repeat", F.col("mae").alias("base"))
    grown = errors.where("feature <> ''").join(F.broadcast(base), "repeat").withColumn("growth", F.col("mae") - F.col("base"))
    return grown.groupBy("feature").agg(F.avg("growth").alias("mean"), F.stddev_samp("growth").alias("sd"))


def impurity_importance(model: Model, columns: list[str], spark) -> DataFrame:
    """(feature, importance) of a tree model: two rows for each column, its value and whether it was missing."""
    names = [*columns, *[f"{c}_was_missing" for c in columns]]
    return spark.createDataFrame([(c, float(v)) for c, v in zip(names, model.featureImportances.toArray(), strict=True)], "feature string, importance double")


def chance_of(columns: list[str], name: str = "rf", seed: int = 42) -> FitPredict:
    """A balanced classifier of ``label``: the test rows with score; 0 for all where training has one class alone."""

    @using(columns)
    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        counts = train.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
        if not all(counts):
            return test.withColumn("score", F.lit(0.0))
        model = classifier(name, seed).fit(balanced(matrix(train, columns, train=train)))
        return probability(model, matrix(test, columns, train=train)).withColumn("score", F.col("chance"))

    return run


def on_scale(rows: DataFrame, scale: str, learnt: DataFrame | None = None) -> DataFrame:
    """``rows`` with _unit: the scale of a row, at least its 5th percentile over the rows of ``learnt`` (else these), and its median
    where it is missing."""
    bounds = quantiles(rows if learnt is None else learnt, [], scale, (0.05, 0.5)).select(F.col("q0").alias("_low"), F.col("q1").alias("_mid"))
    met = rows.crossJoin(F.broadcast(bounds))  # one row
    return met.withColumn("_unit", F.greatest(F.when(F.col(scale).isNull(), F.col("_mid")).otherwise(F.greatest(F.col(scale), "_low")), F.lit(1e-9))).drop("_low", "_mid")


def normalised_two_stage(columns: list[str], multiplier: float, blend: bool = False, unit: str | None = None, entity: str = "entity_id", name: str = "rf", seed: int = 42) -> FitPredict:
    """Two-stage model of the target in units of ``unit`` (see ``on_scale``): the rule |target| > multiplier * unit is then one
    cut for all rows, the rule that ``multiplier`` was calibrated for. Without ``unit`` the scale is the median size of the
    target over the entity's training rows.
    """

    @using(columns)
    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        if unit is None:
            scale = train.groupBy(entity).agg(F.percentile(F.abs("target"), F.lit(0.5)).alias("_scale"))
            learnt = train.join(scale, entity)
            train, test = on_scale(learnt, "_scale"), on_scale(test.join(scale, entity, "left"), "_scale", learnt)

        def scaled(rows: DataFrame) -> DataFrame:
            return rows.withColumns({"_raw": F.col("target"), "target": F.col("target") / F.col(unit or "_unit")})

        out = two_stage(columns, F.abs("target") > multiplier, blend, name=name, seed=seed)(scaled(train), scaled(test))
        return out.withColumns({"y_pred": F.col("y_pred") * F.col(unit or "_unit"), "target": F.col("_raw")})

    return run
