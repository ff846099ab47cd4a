"""Analyses of extreme targets: what lies near them, when they come, and what their definition changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.operators.history import DEFAULT, Panel, quantiles


def proximity(frame: DataFrame, extreme: Column, distances: dict[str, str]) -> DataFrame:
    """Per group (extreme, routine) and event type: rows, rows with a distance, median distance, % within 1 and 7 days."""
    rows = frame.withColumn("group", F.when(extreme, "extreme").otherwise("routine")).select("group", *[F.col(c).alias(k) for k, c in distances.items()])
    long = rows.unpivot(["group"], list(distances), "event_type", "days")
    present = F.col("days").isNotNull()
    middle = quantiles(long, ["group", "event_type"], "days", (0.5,)).select("group", "event_type", F.col("q0").alias("median_days"))
    out = long.groupBy("group", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("days").alias("n_logged"),
        (100.0 * F.avg(F.when(present, (F.col("days") <= 1).cast("double")))).alias("pct_within_1"), (100.0 * F.avg(F.when(present, (F.col("days") <= 7).cast("double")))).alias("pct_within_7"),
    )
    return out.join(middle, ["group", "event_type"])


def date_clusters(frame: DataFrame, extreme: Column, p: Panel = DEFAULT) -> DataFrame:
    """Per date with an extreme: how many, entities affected and reporting, and their share."""
    out = frame.groupBy(p.date).agg(F.count_if(extreme).alias("n_extreme"), F.count_distinct(F.when(extreme, F.col(p.entity))).alias("affected"), F.count_distinct(p.entity).alias("reporting"))
    return out.where("n_extreme > 0").withColumn("share", F.col("affected") / F.col("reporting"))


def monthly_rate(frame: DataFrame, extreme: Column, p: Panel = DEFAULT, every: bool = False) -> DataFrame:
    """Per month: rows, extremes, losses and gains among them, and the rate in percent. With ``every`` all twelve months have a
    row; one without rows counts 0 and has no rate."""
    loss = C.direction(F.col("target")) == "loss"
    out = frame.groupBy(F.month(p.date).cast("long").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if(extreme).alias("n_extreme"), F.count_if(extreme & loss).alias("n_loss"), F.count_if(extreme & ~loss).alias("n_gain"))
    if every:
        months = frame.sparkSession.range(1, 13).select(F.col("id").alias("month"))
        out = months.join(F.broadcast(out), "month", "left").na.fill(0, ["n", "n_extreme", "n_loss", "n_gain"])  # twelve rows
    return out.withColumn("pct_extreme", F.try_divide(100.0 * F.col("n_extreme"), F.col("n")))


def attribution(frame: DataFrame, extreme: Column, flags: list[str]) -> DataFrame:
    """(flag, n, pct) of the extremes that carry each quality flag, and any of them."""
    any_flag = F.lit(False)
    for f in flags:
        any_flag = any_flag | F.col(f)
    cells = [F.struct(F.lit(name).alias("flag"), F.count_if(c).alias("n")) for name, c in [*((f, F.col(f)) for f in flags), ("any", any_flag)]]
    one = frame.where(extreme).agg(F.array(*cells).alias("x"), F.count(F.lit(1)).alias("total"))
    return one.select(F.inline("x"), "total").withColumn("pct", 100.0 * F.col("n") / F.nullif("total", F.lit(0))).drop("total")


def series_comparison(frame: DataFrame, raw: str, cleaned: str, cut: float, p: Panel = DEFAULT) -> DataFrame:
    """Extreme changes under two series, those that cleaning removes, and the correlation of the changes."""
    w = p.window
    rows = frame.select(*[(F.lead(c).over(w) - F.col(c)).alias(k) for k, c in (("a", raw), ("b", cleaned))])
    big_a, big_b = F.abs("a") > cut, F.abs("b") > cut
    return rows.agg(
        F.count_if(F.col("a").isNotNull()).alias("n"), F.count_if(big_a).alias("n_raw"), F.count_if(big_b).alias("n_cleaned"),
        F.count_if(big_a & ~F.coalesce(big_b, F.lit(False))).alias("n_removed"), C.pearson(F.col("a"), F.col("b")).alias("correlation"),
    )


def class_balance(frame: DataFrame, cuts: tuple[float, ...], target: str = "target") -> DataFrame:
    """Per cut: rows, positives, their rate, and the cut in standard deviations. One aggregation for all cuts."""
    y = F.col(target)
    cells = [F.struct(F.lit(float(c)).alias("cut"), F.count(y).alias("n"), F.count_if(F.abs(y) > c).alias("positives"), F.stddev_samp(y).alias("sd")) for c in cuts]
    out = frame.agg(F.array(*cells).alias("x")).select(F.inline("x"))
    return out.withColumns({"rate": F.try_divide(F.col("positives"), F.col("n")), "cut_in_sd": F.try_divide("cut", "sd")}).drop("sd")


def sd_threshold(frame: DataFrame, target: str = "target", sigma: float = 2.7) -> DataFrame:
    return frame.agg((sigma * F.stddev_samp(target)).alias("threshold"))


def relative_flag(multiplier: float, target: str = "target", scale: str = "scale") -> Column:
    """|target| beyond a multiple of the entity's scale; False where either is missing."""
    return F.coalesce(F.abs(target) > multiplier * F.col(scale), F.lit(False))


def relative_sweep(frame: DataFrame, multipliers: tuple[float, ...] = (2, 3, 4, 5, 6, 8), target: str = "target", scale: str = "scale", p: Panel = DEFAULT) -> DataFrame:
    """Per multiplier: positives, rate, entities with one, and the median threshold over entities."""
    per_entity = frame.where(F.col(target).isNotNull()).groupBy(p.entity).agg(F.first(scale, ignorenulls=True).alias("scale"), F.count(F.lit(1)).alias("n"), *[F.count_if(relative_flag(m, target, scale)).alias(f"p{k}") for k, m in enumerate(multipliers)])
    cells = [F.struct(F.lit(float(m)).alias("multiplier"), F.sum(f"p{k}").alias("positives"), F.sum("n").alias("n"), F.count_if(F.col(f"p{k}") > 0).alias("entities")) for k, m in enumerate(multipliers)]
    middle = quantiles(per_entity, [], "scale", (0.5,)).select("q0").scalar()
    out = per_entity.agg(F.array(*cells).alias("x")).select(F.inline("x"))
    return out.withColumns({"median_threshold": F.col("multiplier") * middle, "rate": F.try_divide("positives", "n")}).drop("n")


def matched_multiplier(frame: DataFrame, rate: float, target: str = "target", scale: str = "scale") -> DataFrame:
    """The multiplier whose flag marks about ``rate`` of the rows: a percentile of |target| / scale, 0 where it is missing."""
    ratio = F.coalesce(F.try_divide(F.abs(target), F.col(scale)), F.lit(0.0))
    ratios = frame.where(F.col(target).isNotNull()).select(ratio.alias("_ratio"))
    return quantiles(ratios, [], "_ratio", (1 - rate,)).select(F.col("q0").alias("multiplier"))


def label_comparison(frame: DataFrame, absolute: float, multiplier: float, target: str = "target", scale: str = "scale", level: str = "level", p: Panel = DEFAULT) -> DataFrame:
    """Per rule: positives, entities with and without, most in one entity, share of the top five, median level; agreement."""
    rows = frame.where(F.col(target).isNotNull()).withColumns({"absolute": F.abs(target) > absolute, "relative": relative_flag(multiplier, target, scale)})
    agreement = rows.agg(F.count_if(F.col("absolute") & F.col("relative")).alias("agreement"))
    long = rows.unpivot([p.entity, level], ["absolute", "relative"], "rule", "flag")
    levels = quantiles(long.where("flag"), ["rule"], level, (0.5,)).select("rule", F.col("q0").alias("median_level"))
    counts = long.groupBy("rule", p.entity).agg(F.count_if("flag").alias("n"))
    order = Window.partitionBy("rule").orderBy(F.desc("n"), p.entity)  # Spark keeps five rows of each task before the shuffle
    top = counts.withColumn("_r", F.row_number().over(order)).where("_r <= 5").groupBy("rule").agg(F.sum("n").alias("_top"), F.max("n").alias("most"))
    sums = counts.groupBy("rule").agg(F.sum("n").alias("positives"), F.count_if(F.col("n") > 0).alias("entities_with"), F.count_if(F.col("n") == 0).alias("entities_without"))
    out = sums.join(top, "rule").join(levels, "rule", "left").withColumn("agreement", agreement.scalar())
    return out.withColumn("top5_share", F.try_divide("_top", "positives")).drop("_top")
