"""Column expressions for panels: typing, names, calendars, labels and period numbers. All stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Consistency factor of the median absolute deviation for normal data.
MAD_SCALE = 1.4826

#: Month to label, for each scheme of regimes.
REGIMES = {
    "flow_vs_rest": {
        4: "flow", 5: "flow", 6: "flow", 7: "flow", 8: "flow",
        9: "rest", 10: "rest", 11: "rest", 12: "rest", 1: "rest", 2: "rest", 3: "rest",
    },
    "season": {
        3: "Spring", 4: "Spring", 5: "Spring", 6: "Summer", 7: "Summer", 8: "Summer",
        9: "Autumn", 10: "Autumn", 11: "Autumn", 12: "Winter", 1: "Winter", 2: "Winter",
    },
    "colony_cycle": {
        3: "buildup", 4: "buildup", 5: "buildup", 6: "flow", 7: "flow", 8: "flow",
        9: "dormancy", 10: "dormancy", 11: "dormancy", 12: "dormancy", 1: "dormancy", 2: "dormancy",
    },
}


def number(name: str, null_token: str = "NA") -> Column:
    """Text as double; the null token and anything that is no number become NULL."""
    return F.expr(f"try_cast(nullif(cast(`{name}` as string), '{null_token}') as double)")


def moment(name: str) -> Column:
    """Text as timestamp without zone, NULL if it is none."""
    return F.expr(f"try_cast(`{name}` as timestamp_ntz)")


def entity_of_path(path: Column | str) -> Column:
    """The integer that names a CSV file; NULL for other names."""
    return F.regexp_extract(path, r"([^/\\]+)\.csv$", 1).try_cast("int")


def basename(path: Column | str) -> Column:
    return F.regexp_extract(path, r"[^\\/]+$", 0)


def clean_names(frame: DataFrame) -> DataFrame:
    """Column names stripped, lowered, with blanks and hyphens as underscores."""
    return frame.toDF(*[c.strip().lower().replace(" ", "_").replace("-", "_") for c in frame.columns])


def packed(name: str, part: int, missing: str, scale: float) -> Column:
    """Part of a comma-packed field, scaled; NULL where it holds the missing code."""
    text = F.split_part(F.col(name), F.lit(","), F.lit(part))
    return F.when(text != missing, text.try_cast("double") / scale)


def compact_date(name: str) -> Column:
    """YYYYMMDD as a date, NULL if it is none."""
    return F.expr(f"cast(try_to_timestamp(`{name}`, 'yyyyMMdd') as date)")


def day_gap(earlier: Column, later: Column) -> Column:
    return F.datediff(later, earlier).cast("long")


def week_index(date: Column) -> Column:
    """Number of the week that ends on Sunday, counted so that 1970-01-01 lies in week 1."""
    return (F.floor((F.datediff(date, F.lit("1970-01-01").cast("date")) + 3) / 7) + 1).cast("long")


def month_index(date: Column) -> Column:
    """Months since January 1970."""
    return ((F.year(date) - 1970) * 12 + F.month(date) - 1).cast("long")


def period_index(date: Column, period: str) -> Column:
    return {"week": week_index, "month": month_index}[period](date)


def labelled(month: Column, scheme: str) -> Column:
    """The label of a month under one of REGIMES; NULL for a NULL month."""
    label = F.lit(None).cast("string")
    for m, name in reversed(REGIMES[scheme].items()):
        label = F.when(month == m, name).otherwise(label)
    return label


def season(date: Column) -> Column:
    return labelled(F.month(date), "season")


def tier(value: Column, low: float = 25.0, high: float = 40.0) -> Column:
    """low below ``low``, mid up to ``high``, else high; NULL stays NULL."""
    return F.when(value < low, "low").when(value <= high, "mid").when(value.isNotNull(), "high")


def direction(value: Column) -> Column:
    return F.when(value < 0, "loss").otherwise("gain")


def warm(value: Column, above: float = 12.0) -> Column:
    """1.0 or 0.0; NULL stays NULL."""
    return (value > above).cast("double")


def degree_days(mean: Column, base: float = 10.0) -> Column:
    return F.when(mean.isNotNull(), F.greatest(mean - base, F.lit(0.0)))


def sunshine_hours(seconds: Column) -> Column:
    return seconds / 3600.0


def flight_day(highest: Column, rain: Column) -> Column:
    """1.0 on a day over 12 degrees with less than 1 mm of rain, else 0.0, also where a reading is missing."""
    return F.coalesce((highest > 12.0) & (rain < 1.0), F.lit(False)).cast("double")


def calendar(date: Column) -> dict[str, Column]:
    """Year, month, day of year, and the day of year on a circle of 365.25 days."""
    turn = 2 * F.pi() * F.dayofyear(date) / 365.25
    return {
        "year": F.year(date).cast("long"), "month": F.month(date).cast("long"), "day_of_year": F.dayofyear(date).cast("long"),
        "sin_day_of_year": F.sin(turn), "cos_day_of_year": F.cos(turn),
    }


def nearest(before: Column, after: Column, propagate_null: bool = False) -> Column:
    """The smaller absolute distance; one NULL is skipped, or makes the result NULL with ``propagate_null``."""
    found = F.least(F.abs(before), F.abs(after))
    return F.when(before.isNotNull() & after.isNotNull(), found) if propagate_null else found


def skill(mae: Column, bar: Column) -> Column:
    """1 - mae / bar; NULL where the bar is 0 or missing."""
    return 1 - F.try_divide(mae, bar)


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation aggregate over pairs with both present; NULL where either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def rounded(frame: DataFrame, places: int = 6) -> DataFrame:
    """Every double column rounded, for results that are compared across engines."""
    return frame.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])
