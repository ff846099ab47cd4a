"""Re-graining a daily panel to weeks or months under coverage and contiguity rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.operators import history
from strandline.operators.history import DEFAULT, Panel

#: Observed days that a period needs, and days of a full period.
LEAST_DAYS = {"week": 5, "month": 20}
FULL_DAYS = {"week": 7.0, "month": 30.4375}

ANCHORS = {"mean": "mean_level", "last": "last_level"}


def first_present(value: str, order: str) -> Column:
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def last_present(value: str, order: str) -> Column:
    """The last value that isn't NULL."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def slope(level: str, ordinal: str) -> Column:
    """Least-squares slope over the row ordinal; rows without a level count in n and the sums of x; NULL for one row."""
    x, y = F.col(ordinal).cast("double"), F.col(level)
    n, sx, sxx = F.count(F.lit(1)), F.sum(x), F.sum(x * x)
    return F.try_divide(n * F.sum(x * y) - sx * F.sum(y), F.nullif(n * sxx - sx * sx, F.lit(0.0)))


def aggregated(
    daily: DataFrame, period: str = "week", least_days: int | None = None, sensors: tuple[str, ...] = (), counters: tuple[str, ...] = (),
    outside: str | None = None, warm_above: float = 12.0, static: tuple[str, ...] = (), p: Panel = DEFAULT,
) -> DataFrame:
    """One row for each entity and period with at least ``least_days`` observed days.

    ``daily`` has ``change`` (from the day before) if day-to-day statistics are wanted. First and last skip NULLs; the sum
    of warm days over no reading at all is 0; counters give the size of their last present value.
    """
    least = LEAST_DAYS[period] if least_days is None else least_days
    level, date = p.level, p.date
    ordinal = Window.partitionBy(p.entity, "period_index").orderBy(date)
    rows = daily.withColumn("period_index", C.period_index(F.col(date), period)).withColumn("_k", F.row_number().over(ordinal) - 1)
    parts = [
        F.count(F.lit(1)).alias("days_observed"), F.min(date).alias("period_start"), F.max(date).alias("period_end"),
        last_present(level, date).alias("last_level"), first_present(level, date).alias("first_level"), F.avg(level).alias("mean_level"),
        F.max(level).alias("max_level"), F.min(level).alias("min_level"), F.stddev_samp(level).alias("sd_level"), slope(level, "_k").alias("slope"),
    ]
    if "change" in daily.columns:
        parts += [F.avg("change").alias("change_mean"), F.stddev_samp("change").alias("change_sd"), F.max(F.abs("change")).alias("change_max_abs")]
    if outside:
        parts.append(F.coalesce(F.sum(C.warm(F.col(outside), warm_above)), F.lit(0.0)).alias("warm_days"))
    for s in sensors:
        parts += [F.avg(s).alias(f"{s}_mean"), F.stddev_samp(s).alias(f"{s}_std"), F.max(s).alias(f"{s}_max")]
    parts += [F.abs(last_present(c, date)).alias(f"{c}_at_end") for c in counters] + [first_present(c, date).alias(c) for c in static]
    out = rows.groupBy(p.entity, "period_index").agg(*parts).where(F.col("days_observed") >= least)
    return out.withColumns({"period": F.lit(period), "coverage": F.col("days_observed") / FULL_DAYS[period]})


def _window(p: Panel):
    return Window.partitionBy(p.entity).orderBy("period_index")


def contiguous(value: str, step: int, p: Panel = DEFAULT) -> Column:
    """The value of the next (1) or previous (-1) row if its period is the adjacent one."""
    w = _window(p)
    shifted, index = (F.lead, F.lag)[step < 0](value).over(w), (F.lead, F.lag)[step < 0]("period_index").over(w)
    return F.when(index - F.col("period_index") == step, shifted)


def with_features(periods: DataFrame, anchor: str = "mean", rolling: int = 4, p: Panel = DEFAULT) -> DataFrame:
    """History, calendar and target of a period panel. Rolling windows count rows and need two values."""
    w = _window(p)
    recent = w.rowsBetween(1 - rolling, 0)

    def over_recent(f, value: str) -> Column:
        return F.when(F.count(value).over(recent) >= 2, f(value).over(recent))

    out = periods.withColumn("period_level", F.col(ANCHORS[anchor])).withColumn("anchor", F.lit(anchor))
    out = out.withColumns(
        {
            "previous_period_level": contiguous("period_level", -1, p), "target": contiguous("period_level", 1, p) - F.col("period_level"),
            "target_period_end": contiguous("period_end", 1, p), "previous_days_observed": contiguous("days_observed", -1, p),
            "_step": F.abs(F.col("period_level") - F.lag("period_level").over(w)),
        }
    ).withColumn("period_change", F.col("period_level") - F.col("previous_period_level"))
    out = out.withColumns(
        {
            "previous_period_change": contiguous("period_change", -1, p), "rolling_change": over_recent(F.avg, "period_change"),
            "rolling_change_sd": over_recent(F.stddev_samp, "period_change"), "rolling_level": over_recent(F.avg, "period_level"),
            "entity_change_mad": history.median(F.col("_step")).over(Window.partitionBy(p.entity)),
        }
    ).drop("_step")
    end = F.col("period_end")
    turn = 2 * F.pi() * F.dayofyear(end) / 365.25
    return out.withColumns(
        {
            "minus_rolling": F.col("period_level") - F.col("rolling_level"), "change_minus_rolling": F.col("period_change") - F.col("rolling_change"),
            "year": F.year(end).cast("long"), "month": F.month(end).cast("long"), "week_of_year": F.weekofyear(end).cast("long"),
            "sin_year": F.sin(turn), "cos_year": F.cos(turn), "season": C.season(end),
        }
    )


def waterfall(daily: DataFrame, period: str = "week", p: Panel = DEFAULT) -> DataFrame:
    """Rows left by re-graining, by the coverage gate and by contiguity on each side."""
    index = C.period_index(F.col(p.date), period)
    sizes = daily.groupBy(p.entity, index.alias("period_index")).agg(F.count(F.lit(1)).alias("days_observed"))
    w = _window(p)
    gated = sizes.where(F.col("days_observed") >= LEAST_DAYS[period]).withColumns(
        {"next_ok": F.coalesce(F.lead("period_index").over(w) - F.col("period_index") == 1, F.lit(False)), "previous_ok": F.coalesce(F.col("period_index") - F.lag("period_index").over(w) == 1, F.lit(False))}
    )
    before = sizes.agg(F.coalesce(F.sum("days_observed"), F.lit(0)).alias("a"), F.count(F.lit(1)).alias("b"))
    after = gated.agg(F.count(F.lit(1)).alias("c"), F.count_if("next_ok").alias("d"), F.count_if(F.col("next_ok") & F.col("previous_ok")).alias("e"))
    one = before.withColumns({c: after.select(c).scalar() for c in ("c", "d", "e")}).select(F.array("a", "b", "c", "d", "e").alias("counts"))
    return history.stepped(one, ["daily rows", f"entity-{period}s", "coverage", "next period adjacent", "previous period adjacent"])


def anchor_comparison(daily: DataFrame, period: str = "week", p: Panel = DEFAULT) -> DataFrame:
    """Per anchor: rows with a target, its spread, and the error of predicting no change."""
    grained = aggregated(daily, period, p=p)
    parts = None
    for anchor in ANCHORS:
        one = with_features(grained, anchor, p=p).where("target is not null").agg(
            F.lit(anchor).alias("anchor"), F.count(F.lit(1)).alias("n"), F.stddev_samp("target").alias("target_sd"), F.avg(F.abs("target")).alias("zero_mae")
        )
        parts = one if parts is None else parts.unionByName(one)
    return parts
