"""Events from counters that reset and from levels that step down, and whether the two agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.operators import periods
from strandline.operators.history import DEFAULT, Panel, median, quantiles

#: A counter falls by more than this share at a reset.
RESET_BELOW = 0.95

#: Days that an event date reaches back, at most.
FURTHEST_DAYS = 3650


def resets(panel: DataFrame, counter: str, event: str, scale_rows: int = 5, p: Panel = DEFAULT) -> DataFrame:
    """One row for each reset of a time-since-event counter.

    The counter's unit is read off the increments that follow the reset (the median of the positive ones among the next
    ``scale_rows``). A reset is accepted if its value, in that unit, puts the event within the gap that the reset was seen
    across, and it isn't on the first two days of a year. Entities with fewer than three readings are skipped.
    """
    w = p.window
    date, value = F.col(p.date), F.col(counter)
    rows = panel.where(value.isNotNull()).select(p.entity, p.date, counter)
    gap = C.day_gap(date, F.lead(date).over(w))
    rows = rows.withColumns({"_before": F.lag(value).over(w), "previous_date": F.lag(date).over(w), "_rows": F.count(F.lit(1)).over(p.whole), "_rise": F.when(gap > 0, (F.lead(value).over(w) - value) / gap)})
    rows = rows.withColumn("scale_per_day", median(F.when(F.col("_rise") > 0, F.col("_rise"))).over(w.rowsBetween(0, scale_rows - 1)))
    found = rows.where((F.col("_rows") >= 3) & (value < F.col("_before") * RESET_BELOW))
    found = found.withColumns({"gap_days": C.day_gap(F.col("previous_date"), date), "days_since": F.try_divide(value, F.col("scale_per_day"))})
    back = F.coalesce(F.least(F.col("days_since"), F.lit(float(FURTHEST_DAYS))), F.lit(0.0))
    boundary = (F.month(date) == 1) & (F.dayofmonth(date) <= 2)
    return found.select(
        p.entity, F.lit(event).alias("event_type"), date.alias("observed_on"), "previous_date", "gap_days", value.cast("double").alias("counter_value"), "scale_per_day", "days_since",
        (date.cast("timestamp_ntz") - F.make_dt_interval(secs=F.round(back * 86400, 0))).alias("event_time"),
        boundary.alias("year_boundary"), (F.col("days_since").isNotNull() & (F.col("days_since") <= F.col("gap_days") + 1) & ~boundary).alias("accepted"),
    )


def calendar(found: DataFrame, p: Panel = DEFAULT) -> DataFrame:
    """Per event type: resets, accepted ones, their entities, their first busiest month, and accepted ones of each month."""
    month = F.month("observed_on")
    counts = {m: F.count_if(F.col("accepted") & (month == m)) for m in range(1, 13)}
    out = found.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("resets"), F.count_if("accepted").alias("n_accepted"), F.count_distinct(F.when(F.col("accepted"), F.col(p.entity))).alias("entities"), *[c.alias(f"m{m:02d}") for m, c in counts.items()]
    )
    months = F.array(*[F.col(f"m{m:02d}") for m in range(1, 13)])
    return out.withColumn("peak_month", F.when(F.col("n_accepted") > 0, F.array_position(months, F.array_max(months)).cast("long")))


def step_candidates(panel: DataFrame, sustain_rows: int = 7, sustain_share: float = 0.6, p: Panel = DEFAULT) -> DataFrame:
    """Drops over one day whose level ``sustain_rows`` rows later is still low, with no dropout or implausible flag set."""
    w, level = p.window, F.col(p.level)
    rows = panel.withColumns({"before": F.lag(level).over(w), "after": F.lead(level, sustain_rows).over(w), "_gap": C.day_gap(F.lag(p.date).over(w), F.col(p.date))})
    removed = F.col("before") - level
    sustained = (F.col("before") - F.col("after")) >= sustain_share * removed
    flagged = [~F.coalesce(F.col(c), F.lit(False)) for c in ("dropout", "implausible") if c in panel.columns]
    keep = (F.col("_gap") == 1) & sustained
    for condition in flagged:
        keep &= condition
    return rows.where(keep).select(p.entity, p.date, p.level, removed.alias("removed"), "before", "after", F.month(p.date).cast("long").alias("month"))


def step_downs(panel: DataFrame, threshold: float = 3.0, sustain_rows: int = 7, sustain_share: float = 0.6, p: Panel = DEFAULT) -> DataFrame:
    return step_candidates(panel, sustain_rows, sustain_share, p).where(F.col("removed") >= threshold)


def threshold_sweep(panel: DataFrame, thresholds: tuple[float, ...] = (2, 3, 4, 5, 7, 10), p: Panel = DEFAULT) -> DataFrame:
    """Per threshold: steps, entities, median and total mass, and the share from May to August."""
    rows = step_candidates(panel, p=p).where(F.col("removed") >= float(min(thresholds)))
    cells = []
    for t in thresholds:
        own = F.col("removed") >= float(t)
        mass = F.when(own, F.col("removed"))
        cells.append(
            F.struct(
                F.lit(float(t)).alias("threshold"), F.count(mass).alias("n"), F.count_distinct(F.when(own, F.col(p.entity))).alias("entities"),
                F.coalesce(F.sum(mass), F.lit(0.0)).alias("total_removed"), F.avg(F.when(own, F.col("month").between(5, 8).cast("double"))).alias("share_may_to_aug"),
            )
        )
    each = rows.select("removed", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")).where("removed >= threshold")
    middle = quantiles(each, ["threshold"], "removed", (0.5,)).select("threshold", F.col("q0").alias("median_removed"))
    return rows.agg(F.array(*cells).alias("x")).select(F.inline("x")).join(middle, "threshold", "left")


def corroboration(found: DataFrame, steps: DataFrame, tolerances: tuple[int, ...] = (1, 3, 7, 14), p: Panel = DEFAULT) -> DataFrame:
    """Per tolerance and direction: events, and those with a counterpart of the same entity within so many days.

    Only entities with an accepted event count. Nearest counterparts are found once, by a window over both kinds of event
    in date order, so the work doesn't grow with pairs.
    """
    logged = found.where("accepted").select(p.entity, F.col("observed_on").alias("day"), F.lit("logged").alias("kind"))
    drops = steps.select(p.entity, F.col(p.date).alias("day"), F.lit("drop").alias("kind"))
    both = logged.unionByName(drops)
    w = Window.partitionBy(p.entity).orderBy("day")
    upto, onward = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    other = {k: F.when(F.col("kind") != k, F.col("day")) for k in ("logged", "drop")}
    rows = both.withColumns(
        {
            **{f"_{k}_past": F.max(c).over(upto) for k, c in other.items()}, **{f"_{k}_next": F.min(c).over(onward) for k, c in other.items()},
            "_logs": F.count_if(F.col("kind") == "logged").over(Window.partitionBy(p.entity)),
        }
    ).where("_logs > 0")

    def distance(k: str):
        return F.least(F.datediff("day", f"_{k}_past"), F.datediff(f"_{k}_next", "day"))

    rows = rows.withColumn("_distance", F.when(F.col("kind") == "logged", distance("logged")).otherwise(distance("drop")))
    rows = rows.withColumn("tolerance_days", F.explode(F.array(*[F.lit(t).cast("long") for t in tolerances])))
    return rows.groupBy("tolerance_days", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_distance") <= F.col("tolerance_days")).alias("matched"), F.avg(F.coalesce(F.col("_distance") <= F.col("tolerance_days"), F.lit(False)).cast("double")).alias("share")
    )


def gross_target(features: DataFrame, steps: DataFrame, period: str = "week", p: Panel = DEFAULT) -> DataFrame:
    """Period features with removed mass in the period and the next adjacent one, and the target with the latter added."""
    mass = steps.groupBy(p.entity, C.period_index(F.col(p.date), period).alias("period_index")).agg(F.sum("removed").alias("removed_in_period"))
    out = features.join(mass, [p.entity, "period_index"], "left").withColumn("removed_in_period", F.coalesce("removed_in_period", F.lit(0.0)))
    out = out.withColumn("removed_next", periods.contiguous("removed_in_period", 1, p))
    return out.withColumn("gross_target", F.col("target") + F.col("removed_next"))


def target_comparison(gross: DataFrame) -> DataFrame:
    """Net against gross target over all rows and over May to August."""
    rows = gross.where("target is not null and gross_target is not null")
    segment = F.explode(F.when(F.col("month").between(5, 8), F.array(F.lit("all"), F.lit("may_to_aug"))).otherwise(F.array(F.lit("all"))))
    return rows.withColumn("segment", segment).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("removed_next") > 0).cast("double")).alias("share_touched"), F.avg("target").alias("net_mean"), F.avg("gross_target").alias("gross_mean"),
        F.stddev_samp("target").alias("net_sd"), F.stddev_samp("gross_target").alias("gross_sd"), F.avg(F.col("gross_target") - F.col("target")).alias("mean_shift"),
        C.pearson(F.col("target"), F.col("gross_target")).alias("correlation"),
    )
