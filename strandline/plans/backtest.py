"""Back-testing: folds by date, naive rules, metrics, skill, segments and resampling.

There are no row positions in Spark: a fold is a row of boundary dates, and rows are assigned to folds by expressions on
their dates. Predictions are long tables (fold, rule, y_true, y_pred), so every board is one aggregation.
"""

from __future__ import annotations

import calendar as _calendar
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.operators.history import DEFAULT, Panel, quantiles, running_before
from strandline.plans import linear as L
from strandline.sources.sinks import stored

DAILY_RULES = ("zero", "train_mean", "persistence", "entity_mean", "entity_month")
PERIOD_RULES = ("zero", "train_mean", "persistence", "entity_mean", "month_mean", "entity_month")


@dataclass(frozen=True)
class Fold:
    """Dates of a fold: test rows lie from ``origin`` to before ``end``; ``test_start`` is the first of them, if known."""

    name: str
    origin: date
    end: date
    test_start: date | None = None


def plus_months(day: date, months: int) -> date:
    """The same day so many months later, or the last day of a shorter month."""
    k = day.year * 12 + day.month - 1 + months
    year, month = k // 12, k % 12 + 1
    return date(year, month, min(day.day, _calendar.monthrange(year, month)[1]))


def origins(first: date, last: date, horizon: int = 6, least_train: int = 12, keep: int | None = 4) -> list[Fold]:
    """Rolling origins, each so many months after the last, while a whole horizon fits; numbered after the cut to ``keep``."""
    found, at = [], plus_months(first, least_train)
    while plus_months(at, horizon) <= last + timedelta(days=1):
        found.append(at)
        at = plus_months(at, horizon)
    if not found:
        raise ValueError(f"{first} to {last} is too short for {least_train} + {horizon} months")
    found = found[-keep:] if keep else found
    return [Fold(f"fold_{k}_{at}", at, plus_months(at, horizon)) for k, at in enumerate(found, 1)]


def rolling_folds(frame: DataFrame, column: str = "obs_date", horizon: int = 6, least_train: int = 12, keep: int | None = 4) -> list[Fold]:
    """``origins`` over a table's dates, with each fold's first test date: two aggregations. A table without dates has no folds."""
    row = frame.agg(F.min(column), F.max(column)).first()
    if row[0] is None:
        return []
    found = origins(row[0], row[1], horizon, least_train, keep)
    day = F.col(column)
    starts = frame.agg(*[F.min(F.when((day >= F.lit(f.origin)) & (day < F.lit(f.end)), day)) for f in found]).first()
    return [replace(f, test_start=s) for f, s in zip(found, starts, strict=True)]


def assigned(frame: DataFrame, folds: list[Fold], column: str = "obs_date", label_end: str | None = None) -> DataFrame:
    """Rows once for each fold they are in, with fold and part (train, test).

    With ``label_end``, the date up to which a row's label looks, a row trains only if that is before the first test date:
    the embargo. Rows between are in neither part.
    """
    day = F.col(column)
    parts = [
        F.when(day < F.lit(f.origin), F.when(_trains(f, column, label_end), F.struct(F.lit(f.name).alias("fold"), F.lit("train").alias("part")))).when(day < F.lit(f.end), F.struct(F.lit(f.name).alias("fold"), F.lit("test").alias("part")))
        for f in folds
    ] or [F.lit(None).cast("struct<fold:string,part:string>")]
    return frame.withColumn("_f", F.explode(F.array_compact(F.array(*parts)))).select("*", "_f.*").drop("_f")


def _trains(fold: Fold, column: str, label_end: str | None) -> Column:
    """Whether a row from before the origin trains: by its own date, or by the end of its label."""
    return F.coalesce(F.col(label_end) < F.lit(fold.test_start or fold.origin), F.lit(False)) if label_end else F.col(column) < F.lit(fold.origin)


def fold_table(frame: DataFrame, folds: list[Fold], column: str = "obs_date", label_end: str | None = None) -> DataFrame:
    """(fold, n_train, n_test, train_end, test_start, test_end, embargoed) of the folds with rows on both sides.

    ``train_end`` is the last date that training looks at: with ``label_end``, the latest end of a label.
    """
    day = F.col(column)
    rows = assigned(frame, folds, column, label_end)
    train, test = F.col("part") == "train", F.col("part") == "test"
    out = rows.groupBy("fold").agg(F.count_if(train).alias("n_train"), F.count_if(test).alias("n_test"), F.max(F.when(train, F.col(label_end or column))).alias("train_end"), F.min(F.when(test, day)).alias("test_start"), F.max(F.when(test, day)).alias("test_end"))
    out = out.where("n_train > 0 and n_test > 0")
    if not label_end or not folds:
        return out.withColumn("embargoed", F.lit(0).cast("long"))
    lost = F.array(*[F.struct(F.lit(f.name).alias("fold"), F.count_if((day < F.lit(f.origin)) & ~_trains(f, column, label_end)).alias("embargoed")) for f in folds])
    return out.join(F.broadcast(frame.agg(lost.alias("x")).select(F.inline("x"))), "fold")


def assert_order(frame: DataFrame, folds: list[Fold], column: str = "obs_date", label_end: str | None = None) -> None:
    """ValueError if a fold trains on a date (or a label that looks) from its first test date on."""
    rows = assigned(frame, folds, column, label_end)
    train_side = F.col(label_end or column)
    bad = rows.groupBy("fold").agg(F.max(F.when(F.col("part") == "train", train_side)).alias("a"), F.min(F.when(F.col("part") == "test", F.col(column))).alias("b")).where("a >= b").select("fold").collect()
    if bad:
        raise ValueError(f"training reaches into the test dates of {', '.join(sorted(r[0] for r in bad))}")


def date_split(frame: DataFrame, cutoff: date, column: str = "obs_date") -> DataFrame:
    """part: train before the cutoff, test from it on; ValueError if a side is empty."""
    out = frame.withColumn("part", F.when(F.col(column) < F.lit(cutoff), "train").otherwise("test"))
    sides = out.agg(F.count_if(F.col("part") == "train"), F.count_if(F.col("part") == "test")).first()
    if not all(sides):
        raise ValueError(f"no rows on one side of {cutoff}")
    return out


def date_share_split(frame: DataFrame, share: float = 0.8, column: str = "obs_date") -> DataFrame:
    """part by the given share of the distinct dates. Only dates are ranked."""
    dates = frame.select(column).distinct()
    ranked = dates.withColumns({"_r": F.row_number().over(Window.orderBy(column)), "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    cut = ranked.where(F.col("_r") == F.floor(F.col("_n") * share) + 1).agg(F.min(column)).scalar()
    return frame.withColumn("part", F.when(F.col(column) < cut, "train").otherwise("test"))


def group_folds(frame: DataFrame, folds: int = 5, seed: int = 42, entity: str = "entity_id") -> DataFrame:
    """(entity, fold): entities in an order shuffled by a hash of the seed, cut into equal blocks."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(entity).cast("string")))
    ids = frame.select(entity).distinct().select(entity, key.alias("_key"), F.lit(1).alias("_one"), F.lit(1).alias("_n"))
    placed = running_before(ids.withColumn("_v", leading(F.col("_key"))), ["_one"], "_v", ["_n"], ["_key", entity])
    total = ids.groupBy("_one").agg(F.count(F.lit(1)).alias("_all"))
    size, more, rank = F.expr(f"_all div {folds}"), F.col("_all") % folds, F.col("_n_before")
    cut = more * (size + 1)
    fold = F.when(rank < cut, F.expr(f"_n_before div (_all div {folds} + 1)")).otherwise(more + F.floor((rank - cut) / F.greatest(size, F.lit(1))))
    return placed.join(total, "_one").select(entity, (fold + 1).cast("long").alias("fold"))


def naive(rows: DataFrame, rules: tuple[str, ...] = DAILY_RULES, target: str = "target", persistence: str = "change", p: Panel = DEFAULT, date_column: str | None = None) -> DataFrame:
    """Predictions of naive rules for the test rows of every fold: all test columns with rule and y_pred.

    Means come from the fold's training rows: of everything, an entity, a month, an entity's month. A missing mean falls
    back to the one above it; a missing last change counts as no change.
    """
    month = F.month(date_column or p.date)
    rows = rows.where(F.col(target).isNotNull()).withColumn("_month", month)
    train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
    sums = train.groupBy("fold", p.entity, "_month").agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))

    def mean(name: str, *keys: str) -> DataFrame:
        """From the finest sums, so the training rows are read once."""
        return sums.groupBy("fold", *keys).agg((F.sum("_s") / F.sum("_n")).alias(name))

    overall, entity, months, both = mean("_all"), mean("_entity", p.entity), mean("_by_month", "_month"), sums.select("fold", p.entity, "_month", (F.col("_s") / F.col("_n")).alias("_both"))
    out = test.join(F.broadcast(overall), "fold").join(entity, ["fold", p.entity], "left").join(F.broadcast(months), ["fold", "_month"], "left").join(both, ["fold", p.entity, "_month"], "left")
    fallback = F.coalesce("_by_month", "_all") if "month_mean" in rules else F.col("_all")
    found = {
        "zero": F.lit(0.0), "train_mean": F.col("_all"), "persistence": F.coalesce(F.col(persistence), F.lit(0.0)), "entity_mean": F.coalesce("_entity", "_all"),
        "month_mean": F.coalesce("_by_month", "_all"), "entity_month": F.coalesce(F.col("_both"), fallback),
    }
    cells = F.array(*[F.struct(F.lit(k).alias("rule_order"), F.lit(r).alias("rule"), found[r].alias("y_pred")) for k, r in enumerate(rules)])
    return out.withColumn("_x", F.explode(cells)).select(*rows.drop("_month").columns, "_x.*").withColumn("y_true", F.col(target))


def metrics(y: str = "y_true", y_hat: str = "y_pred") -> list[Column]:
    """mae, rmse, r2, bias and n over pairs with both present; r2 is NULL for fewer than two pairs or a constant target."""
    both = F.col(y).isNotNull() & F.col(y_hat).isNotNull()
    t, e = F.when(both, F.col(y)), F.when(both, F.col(y_hat) - F.col(y))
    n = F.count(e)
    return [
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(n >= 2, 1 - F.try_divide(F.avg(e * e), F.nullif(F.var_pop(t), F.lit(0.0)))).alias("r2"),
        F.avg(e).alias("bias"), n.alias("n"),
    ]


def board(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("fold", "rule").agg(*metrics())


def best(boards: DataFrame, per_fold: bool = True) -> DataFrame:
    """The lowest error of each fold, or of the mean over folds; among equals the rule first in order."""
    if per_fold:
        return boards.groupBy("fold").agg(F.min(F.struct("mae", "rule")).alias("x")).select("fold", F.col("x.mae").alias("bar"), F.col("x.rule").alias("bar_rule"))
    means = boards.groupBy("rule").agg(F.avg("mae").alias("mae"))
    return means.agg(F.min(F.struct("mae", "rule")).alias("x")).select(F.col("x.mae").alias("bar"), F.col("x.rule").alias("bar_rule"))


def with_skill(boards: DataFrame, bars: DataFrame) -> DataFrame:
    """Boards with skill against each fold's best naive rule."""
    return boards.join(F.broadcast(bars), "fold").withColumn("skill", C.skill(F.col("mae"), F.col("bar")))


def fold_summary(boards: DataFrame, by: str = "rule") -> DataFrame:
    parts = [F.count_distinct("fold").alias("folds"), *[f(m).alias(f"{m}_{k}") for m in ("mae", "rmse", "r2") for k, f in (("mean", F.avg), ("sd", F.stddev_samp))], F.sum("n").alias("n")]
    if "skill" in boards.columns:
        parts += [F.avg("skill").alias("skill_mean"), F.stddev_samp("skill").alias("skill_sd")]
    return boards.groupBy(by).agg(*parts)


def segmented(predictions: DataFrame, segments: dict[str, Column], model: str, pooled_bar: bool = True) -> DataFrame:
    """Per segment value: the model rule's metrics, the best other rule within the segment, and both skills.

    ``predictions`` is long (rule, rule_order, y_true, y_pred); segments are keyed by name. Every row is counted once for
    each segment, all in one aggregation.
    """
    cells = F.array(*[F.struct(F.lit(k).alias("segment"), c.cast("string").alias("value")) for k, c in segments.items()])
    long = predictions.withColumn("_s", F.explode(cells)).select("rule", "rule_order", "y_true", "y_pred", "_s.*").where("value is not null")
    rows = long.groupBy("segment", "value", "rule", "rule_order").agg(*metrics())
    bars = rows.where(F.col("rule") != model).groupBy("segment", "value").agg(F.min(F.struct("mae", "rule_order", "rule")).alias("x"))
    bars = bars.select("segment", "value", F.col("x.mae").alias("bar"), F.col("x.rule").alias("bar_rule"))
    out = rows.where(F.col("rule") == model).drop("rule", "rule_order").join(bars, ["segment", "value"], "left").withColumn("skill", C.skill(F.col("mae"), F.col("bar")))
    if pooled_bar:
        pooled = predictions.where(F.col("rule") != model).groupBy("rule").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("m")).agg(F.min("m"))
        out = out.withColumn("skill_pooled", C.skill(F.col("mae"), pooled.scalar()))
    return out


def regime_report(predictions: DataFrame, month: Column, scheme: str, model: str) -> DataFrame:
    """Segments of one scheme of regimes, with a pooled row."""
    return segmented(predictions, {scheme: C.labelled(month, scheme), "pooled": F.lit("all")}, model, pooled_bar=False)


def classifier_report(scores: DataFrame, label: str = "label", score: str = "score", by: str | list[str] | None = None) -> DataFrame:
    """average_precision, roc_auc, positive_rate, lift and n, NULL where one class is missing.

    Rows are first counted for each distinct score, so ties share a threshold and the running sums go over distinct scores,
    in two phases over ranges of the score. Rows without a score count for nothing.
    """
    groups = [by] if isinstance(by, str) else by or ["_one"]
    rows = scores if by else scores.withColumn("_one", F.lit(1))
    counts = rows.groupBy(*groups, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("all"))
    run = running_before(counts.where(F.col(score).isNotNull()).withColumn("_down", -F.col(score)), groups, "_down", ["pos", "all"])
    run = run.withColumns({"tp": F.col("pos_before") + F.col("pos"), "seen": F.col("all_before") + F.col("all")})
    negatives = F.col("all") - F.col("pos")
    above = F.col("tp") - F.col("pos") + F.col("pos") / 2
    out = run.groupBy(*groups).agg(
        F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.sum("pos")).alias("ap"), F.sum(negatives * above).alias("area"), F.sum("pos").alias("P"), F.sum("all").alias("N")
    )
    mixed = (F.col("P") > 0) & (F.col("P") < F.col("N"))
    rate = F.col("P") / F.col("N")
    out = out.select(
        *groups, F.when(mixed, F.col("ap")).alias("average_precision"), F.when(mixed, F.try_divide("area", F.col("P") * (F.col("N") - F.col("P")))).alias("roc_auc"),
        rate.alias("positive_rate"), F.when(mixed, F.col("ap") / rate).alias("lift"), F.col("N").alias("n"),
    )
    return out if by else out.drop("_one")


def draws(ids: DataFrame, fractions: tuple[float, ...], repeats: int, seed: int = 42, entity: str = "entity_id", least: int = 3) -> DataFrame:
    """(entity, repeat, fraction): the entities of each sample, drawn by a hash.

    A sample has at least ``least`` entities; one that holds all of them is drawn once.
    """
    each = ids.select(entity).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("repeat").cast("string"), F.col(entity).cast("string")))
    each = each.withColumns({"_key": key, "_v": leading(key), "_one": F.lit(1)})
    placed = running_before(each, ["repeat"], "_v", ["_one"], ["_key", entity])
    placed = placed.join(F.broadcast(placed.groupBy("repeat").agg(F.count(F.lit(1)).alias("_n"))), "repeat")  # a row for each repeat
    most = [F.greatest(F.lit(least), F.round(F.col("_n") * f)) for f in fractions]
    # a sample of all entities is one sample, however often it is drawn
    taken = [F.when((F.col("_one_before") < m) & ((m < F.col("_n")) | (F.col("repeat") == 0)), F.lit(f)) for f, m in zip(fractions, most, strict=True)]
    return placed.select(entity, F.col("repeat").cast("long"), F.explode(F.array_compact(F.array(*taken))).alias("fraction"))


def subsamples(frame: DataFrame, fractions: tuple[float, ...], repeats: int, seed: int = 42, entity: str = "entity_id", least: int = 3) -> DataFrame:
    """Rows once for each (fraction, repeat) whose sample of entities holds theirs."""
    return frame.join(draws(frame, fractions, repeats, seed, entity, least), entity)


def leading(key: Column) -> Column:
    """The first 12 hexadecimal digits of a hash as a number, in the order of the hash."""
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("long")


def fold_dates(bounds: DataFrame, draw: list[str], horizon: int = 6, least_train: int = 12, keep: int = 4) -> DataFrame:
    """(draw, fold, origin, end): the last ``keep`` rolling origins of each draw, from its _first and _last date."""
    steps = F.floor((F.months_between("_last", "_first") - least_train) / horizon).cast("int")
    each = bounds.where(steps >= 1).select("*", F.explode(F.sequence(F.lit(0), steps)).alias("_k"))
    each = each.withColumns({"origin": F.add_months("_first", least_train + horizon * F.col("_k")), "end": F.add_months("_first", least_train + horizon * (F.col("_k") + 1))})
    each = each.where(F.col("end") <= F.date_add("_last", 1))
    last = Window.partitionBy(*draw).orderBy(F.desc("origin"))  # as many rows as a record has half-years
    return each.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= keep).select(*draw, F.col("origin").cast("string").alias("fold"), "origin", "end")


def drawn_folds(rows: DataFrame, members: DataFrame, draw: list[str], column: str, horizon: int = 6, least_train: int = 12, keep: int = 4, entity: str = "entity_id") -> DataFrame:
    """(draw, fold, origin, end, test_start): rolling folds of each draw's own dates, from dates of its entities alone.

    A draw has at most ``keep`` folds; draws that are too short, and folds without test rows, have none. ``rows`` is read
    twice and copied for no draw.
    """
    ends = rows.groupBy(entity).agg(F.min(column).alias("_first"), F.max(column).alias("_last"))
    bounds = members.join(ends, entity).groupBy(*draw).agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    each = stored(fold_dates(bounds, draw, horizon, least_train, keep), "fold-dates")
    spans = each.select("origin", "end").distinct()  # most draws share theirs
    day = F.col(column)
    starts = rows.join(F.broadcast(spans), (day >= F.col("origin")) & (day < F.col("end"))).groupBy(entity, "origin", "end").agg(F.min(column).alias("_start"))
    met = members.join(F.broadcast(each), draw).join(starts, [entity, "origin", "end"])
    return met.groupBy(*draw, "fold", "origin", "end").agg(F.min("_start").alias("test_start"))


def resampled_skill(
    rows: DataFrame, prediction: Column | None = None, fractions: tuple[float, ...] = (0.25, 0.4, 0.55, 0.7, 0.85, 1.0), repeats: int = 8, column: str = "period_start",
    label_end: str = "target_period_end", rules: tuple[str, ...] = PERIOD_RULES, least_train: int = 30, least_test: int = 10, entity: str = "entity_id", model: Callable[[DataFrame], DataFrame] | None = None,
    linear: list[str] | None = None,
) -> DataFrame:
    """(fraction, repeat, entities, n, folds, skill) of samples of entities: how skill and its spread grow with the sample.

    Folds, their embargo and the best naive rule of each fold are made anew within every sample; folds with under
    ``least_train`` or ``least_test`` rows don't count. Predictions are a column of ``rows``, or least squares on the columns
    of ``linear``, or ``model`` takes the rows of all samples (with fold and part, fold naming sample and fold) and returns the
    test rows with y_pred.

    Training sums are taken once for each entity, month and span of dates, and added up for the samples that hold the entity:
    only test rows are copied for each sample, unless there is a ``model``.
    """
    draw, day = ["fraction", "repeat"], F.col(column)
    rows = stored(rows.where(F.col("target").isNotNull()).withColumn("_month", F.month(column)), "sampled-rows")
    members = stored(draws(rows, fractions, repeats, entity=entity), "samples")
    folds = stored(drawn_folds(rows, members, draw, column, entity=entity), "sample-folds")
    sizes = members.join(rows.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")), entity).groupBy(*draw).agg(F.count(F.lit(1)).alias("entities"), F.sum("_n").alias("n"))
    spans = F.broadcast(folds.select("origin", "end", "test_start").distinct())
    trains, tests = (day < F.col("origin")) & (F.col(label_end) < F.col("test_start")), (day >= F.col("origin")) & (day < F.col("end"))
    span = ["origin", "end", "test_start"]
    columns, fold = linear or [], [*draw, "fold"]
    around = L.centres(rows, columns)
    sums = stored(rows.join(spans, trains).groupBy(entity, "_month", *span).agg(*L.moments(columns, around)), "training-sums")
    inside = stored(members.join(F.broadcast(folds), draw), "sample-entities")  # a row for each sample, fold and entity
    parts = inside.join(sums, [entity, *span]).groupBy(*fold, "_month").agg(*L.summed(columns))
    parts = stored(parts, "sample-sums")

    def mean(name: str) -> Column:
        return (F.col("_m_y") / F.col("_m_n")).alias(name)

    fits = parts.groupBy(*fold).agg(*L.summed(columns)).select(*fold, F.col("_m_n").alias("_train"), mean("_all"), L.coefficients(columns).alias("_coefficients"))
    months = parts.select(*fold, "_month", mean("_by_month"))
    both = sums.select(entity, "_month", *span, mean("_both"))
    entities = sums.groupBy(entity, *span).agg(*L.summed([])).select(entity, *span, mean("_entity"))
    found = rows.join(spans, tests).join(entities, [entity, *span], "left").join(both, [entity, "_month", *span], "left")
    found = found.join(inside, [entity, *span]).join(F.broadcast(fits), fold).join(F.broadcast(months), [*fold, "_month"], "left")
    y, fallback = F.col("target"), F.coalesce("_by_month", "_all") if "month_mean" in rules else F.col("_all")
    guesses = {
        "zero": F.lit(0.0), "train_mean": F.col("_all"), "persistence": F.coalesce(F.col("change"), F.lit(0.0)), "entity_mean": F.coalesce("_entity", "_all"),
        "month_mean": F.coalesce("_by_month", "_all"), "entity_month": F.coalesce(F.col("_both"), fallback),
    }
    own = L.prediction(columns, around) if linear else prediction if prediction is not None else F.lit(None).cast("double")
    errors = found.groupBy(*fold).agg(
        F.least(*[F.avg(F.abs(guesses[r] - y)) for r in rules], F.lit(float("inf"))).alias("bar"), F.avg(F.abs(own - y)).alias("mae"), F.max("_train").alias("_train"), F.count(F.lit(1)).alias("_test")
    )
    if model:
        met = inside.join(rows, entity).withColumn("part", F.when(trains, "train").when(tests, "test")).where("part is not null").drop(*span)
        met = met.withColumn("_draw", F.struct(*fold)).withColumn("fold", F.concat_ws("|", *fold))
        scored = model(met).groupBy(*[F.col(f"_draw.{c}").alias(c) for c in fold]).agg(F.avg(F.abs(F.col("y_pred") - F.col("target"))).alias("mae"))
        errors = errors.drop("mae").join(scored, fold)
    skills = errors.where((F.col("_train") >= least_train) & (F.col("_test") >= least_test)).withColumn("skill", C.skill(F.col("mae"), F.col("bar")))
    return sizes.join(skills.groupBy(*draw).agg(F.count("skill").alias("folds"), F.avg("skill").alias("skill")), draw)


def definition_sweep(
    frame: DataFrame, definitions: dict[str, Column], routine: Callable[[DataFrame, DataFrame], DataFrame], chance: Callable[[DataFrame, DataFrame], DataFrame], least_train: int = 30, least_test: int = 5,
) -> DataFrame:
    """One row for each definition of an extreme: how many there are, the error of a model of the routine rows on routine
    rows, and how well extremes are told.

    ``frame`` has part (train, test) and target. ``routine`` takes routine training and test rows and returns the latter
    with y_pred; ``chance`` takes training and test rows with label and returns the latter with score. With under
    ``least_train`` or ``least_test`` extremes the classifier's figures are NULL: the definition's row stays.
    """
    out = None
    for name, extreme in definitions.items():
        rows = frame.withColumn("label", F.coalesce(extreme, F.lit(False)).cast("int"))
        counts = rows.agg(
            F.lit(name).alias("definition"), F.sum("label").alias("extremes"), (100.0 * F.avg("label")).alias("extreme_pct"), F.count_if(F.col("label") == 0).alias("routine_rows"),
            F.count_if((F.col("label") == 1) & (F.col("part") == "train")).alias("_train"), F.count_if((F.col("label") == 1) & (F.col("part") == "test")).alias("_test"),
        )
        train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
        error = routine(train.where("label = 0"), test.where("label = 0")).withColumn("y_true", F.col("target")).agg(*metrics())
        told = classifier_report(chance(train, test)).select("average_precision", "roc_auc", "lift")
        parts = counts.unionByName(error.select(F.lit(name).alias("definition"), F.col("mae").alias("routine_mae"), F.col("r2").alias("routine_r2")), allowMissingColumns=True)
        parts = parts.unionByName(told.withColumn("definition", F.lit(name)), allowMissingColumns=True)
        one = parts.groupBy("definition").agg(*[F.max(c).alias(c) for c in parts.columns if c != "definition"])
        enough = (F.col("_train") >= least_train) & (F.col("_test") >= least_test)
        one = one.withColumns({c: F.when(enough, F.col(c)) for c in told.columns if c != "definition"}).drop("_train", "_test")
        out = one if out is None else out.unionByName(one)
    return out


def curve_summary(curve: DataFrame, value: str = "skill") -> DataFrame:
    return curve.groupBy("fraction").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg((F.col(value) <= 0).cast("double")).alias("share_not_above_0"), F.avg("n").alias("mean_n"))


def required_size(summary: DataFrame, confidence: float = 1.96) -> DataFrame:
    """Rows needed for a lower bound above 0: log-log slope of sd over n, and the projection with sd as n to the -1/2."""
    rows = summary.where("sd > 0 and mean_n > 0")
    fit = rows.agg(F.regr_slope(F.log("sd"), F.log("mean_n")).alias("slope"), F.exp(F.avg(F.log("sd") + 0.5 * F.log("mean_n"))).alias("c"), F.max_by("mean", "mean_n").alias("effect"))
    return fit.withColumn("required_n", F.when(F.col("effect") > 0, F.ceil(F.pow(confidence * F.col("c") / F.nullif("effect", F.lit(0.0)), 2)).cast("long")))


def row_share_split(frame: DataFrame, share: float = 0.8, column: str = "obs_date") -> DataFrame:
    """part by a share of the rows in date order, cut at a whole date: the first date by which so many rows have passed
    opens the test part. Rows are counted by date first, so only dates are summed in order."""
    days = frame.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    passed = days.withColumns({"_before": F.coalesce(F.sum("_n").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy())})
    cut = passed.where(F.col("_before") >= share * F.col("_all")).agg(F.min(column)).scalar()
    return frame.withColumn("part", F.when(F.coalesce(F.col(column) >= cut, F.lit(False)), "test").otherwise("train"))


def residual_tiers(predictions: DataFrame, tier: Column, shares: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Box-plot statistics of the residuals by tier and rule."""
    rows = predictions.withColumns({"tier": tier, "_e": F.col("y_true") - F.col("y_pred")}).where("tier is not null")
    found = quantiles(rows, ["tier", "rule"], "_e", shares)
    return found.select("tier", "rule", "n", *[F.col(f"q{k}").alias(f"q{int(100 * q):03d}") for k, q in enumerate(shares)])


def expectations(found: DataFrame, expected: dict[str, tuple[float, float]]) -> DataFrame:
    """(name, found, expected, ok): a row of computed numbers against quoted ones, each within its relative tolerance."""
    cells = [
        F.struct(
            F.lit(name).alias("name"), F.col(name).cast("double").alias("found"), F.lit(float(value)).alias("expected"),
            F.coalesce(F.abs(F.col(name) - value) <= tolerance * F.greatest(F.abs(F.lit(float(value))), F.lit(1e-12)), F.lit(False)).alias("ok"),
        )
        for name, (value, tolerance) in expected.items()
    ]
    return found.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
