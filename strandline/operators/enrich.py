"""Attaching site-day dimensions, stations in a box, and regional means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.operators import audit, periods
from strandline.operators.history import DEFAULT, Panel


#: How each daily weather variable collapses over a period.
PERIOD_AGGREGATIONS = {
    "temperature_2m_max": ("mean", "max"),
    "temperature_2m_min": ("mean", "min"),
    "temperature_2m_mean": ("mean", "std"),
    "precipitation_sum": ("sum", "max"),
    "precipitation_hours": ("sum",),
    "sunshine_duration": ("sum",),
    "shortwave_radiation_sum": ("sum",),
    "wind_speed_10m_max": ("mean", "max"),
    "et0_fao_evapotranspiration": ("sum",),
    "growing_degree_days_10c": ("sum",),
    "is_foraging_day": ("sum",),
}


def period_names(variables: dict[str, tuple[str, ...]] = PERIOD_AGGREGATIONS) -> list[str]:
    return [f"{c}_{how}" for c, hows in variables.items() for how in hows]


def derived(days: DataFrame) -> DataFrame:
    """Daily weather with degree days, hours of sunshine and whether bees fly."""
    return days.withColumns(
        {
            "growing_degree_days_10c": C.degree_days(F.col("temperature_2m_mean")), "foraging_hours_proxy": C.sunshine_hours(F.col("sunshine_duration")),
            "is_foraging_day": C.flight_day(F.col("temperature_2m_max"), F.col("precipitation_sum")),
        }
    )


def weather_correlation(periods_with_weather: DataFrame, target: str = "target", names: list[str] | None = None) -> DataFrame:
    """(feature, rho_current, rho_next, n_next): rank correlation of each feature, and of the next period's, with the target;
    strongest next first. All are ranked together."""
    names = names or period_names()
    found = audit.spearman(periods_with_weather, [*names, *(f"next_{c}" for c in names)], target)
    is_next = F.col("feature").isin([f"next_{c}" for c in names])
    feature = F.when(is_next, F.expr("substring(feature, 6)")).otherwise(F.col("feature"))
    met = found.groupBy(feature.alias("feature")).agg(
        F.max(F.when(~is_next, F.col("rho"))).alias("rho_current"), F.max(F.when(is_next, F.col("rho"))).alias("rho_next"), F.max(F.when(is_next, F.col("n"))).alias("n_next")
    )
    return met.orderBy(F.abs("rho_next").desc_nulls_last(), "feature")


def grid(degrees: str) -> Column:
    """A coordinate as whole tenths of a degree: an exact join key."""
    return F.round(F.col(degrees) * 10).cast("long")


def with_site_days(panel: DataFrame, sites: DataFrame, least_match: float | None = 0.99, p: Panel = DEFAULT) -> DataFrame:
    """``panel`` left-joined to one row for each site and day on rounded coordinates and date.

    ValueError if fewer rows than ``least_match`` find their site-day (one job; None skips it).
    """
    right = sites.select(grid("latitude").alias("_lat"), grid("longitude").alias("_lon"), F.col("obs_date").alias("_day"), *[c for c in sites.columns if c not in ("latitude", "longitude", "obs_date")], F.lit(True).alias("_met"))
    out = panel.join(right, (grid("latitude") == F.col("_lat")) & (grid("longitude") == F.col("_lon")) & (F.col(p.date) == F.col("_day")), "left")
    if least_match is not None:
        share = out.agg(F.avg(F.coalesce("_met", F.lit(False)).cast("double"))).first()[0]
        if share is not None and share < least_match:
            raise ValueError(f"only {share:.1%} of the rows have a site-day")
    return out.drop("_lat", "_lon", "_day", "_met")


def sites(panel: DataFrame, p: Panel = DEFAULT) -> DataFrame:
    """Distinct sites with their entities and rows, numbered from the south-west."""
    counts = panel.groupBy(grid("latitude").alias("lat_10"), grid("longitude").alias("lon_10")).agg(F.count_distinct(p.entity).alias("entities"), F.count(F.lit(1)).alias("n"))
    return counts.withColumn("site_id", F.row_number().over(Window.orderBy("lat_10", "lon_10")).cast("long"))  # one row for each site


def incomplete_sites(site_days: DataFrame, days: int) -> DataFrame:
    """Sites that haven't exactly ``days`` different days."""
    counts = site_days.groupBy(grid("latitude").alias("lat_10"), grid("longitude").alias("lon_10")).agg(F.count_distinct("obs_date").alias("n_days"))
    return counts.where(F.col("n_days") != days)


def in_box(stations: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    return stations.where(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))


def station_days(facts: DataFrame, stations: DataFrame, key: str, most: int = 200_000) -> DataFrame:
    """Facts of the given stations. Up to ``most`` stations are broadcast (one count); more meet in a shuffle join."""
    small = stations.limit(most + 1).count() <= most
    return facts.join(F.broadcast(stations) if small else stations, key)


def kept_on(facts: DataFrame, keys: DataFrame, key: str, most: int = 200_000) -> DataFrame:
    """``facts`` whose key is in ``keys``, which may repeat it; no row is doubled and no column is added."""
    wanted = keys.select(key)
    return facts.join(F.broadcast(wanted) if wanted.limit(most + 1).count() <= most else wanted, key, "left_semi")


def regional_days(facts: DataFrame, value: str, station: str, date: str) -> DataFrame:
    """Mean over stations of each day, rounded to two places, and how many stations it has."""
    return facts.groupBy(date).agg(F.round(F.avg(value), 2).alias("mean_value"), F.count_distinct(station).alias("n_stations"))


def period_weather(features: DataFrame, daily: DataFrame, variables: dict[str, tuple[str, ...]], period: str = "week", lookahead: bool = False, p: Panel = DEFAULT) -> DataFrame:
    """Period features with aggregates of daily variables ({column: (mean, sum, max, min, ...)}).

    With ``lookahead`` the next adjacent period's aggregates are added as next_<name>: for analysis only.
    """
    functions = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "std": F.stddev_samp}
    parts = [functions[how](c).alias(f"{c}_{how}") for c, hows in variables.items() for how in hows]
    names = [f"{c}_{how}" for c, hows in variables.items() for how in hows]
    weather = daily.groupBy(p.entity, C.period_index(F.col(p.date), period).alias("period_index")).agg(*parts)
    out = features.join(weather, [p.entity, "period_index"], "left")
    return out.withColumns({f"next_{c}": periods.contiguous(c, 1, p) for c in names}) if lookahead else out


def coverage(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, pct_present, mean, sd) of each column."""
    cells = [F.struct(F.lit(c).alias("column_name"), (100.0 * F.avg(F.col(c).isNotNull().cast("double"))).alias("pct_present"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")) for c in columns]
    return frame.agg(F.array(*cells).alias("x")).select(F.inline("x"))
