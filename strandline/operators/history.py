"""Per-entity history of a daily panel: lags, rolling and robust statistics, gates and quality flags.

Every statistic is a window over one partitioning (entity, ordered by date), so a whole table is built with one shuffle and
no join back. ``long_candidates`` and ``carried`` are the forms for entities that no task can hold. Statistics over an entity's whole record see its future; ``past_only`` gives the expanding forms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strandline.functions import columns as C
from strandline.sources.sinks import stored


@dataclass(frozen=True)
class Panel:
    """Names of a panel's key and level; windows stay within an entity, and within the columns of ``within`` if there are any."""

    entity: str = "entity_id"
    date: str = "obs_date"
    level: str = "level"
    within: tuple[str, ...] = ()

    @property
    def window(self) -> WindowSpec:
        return self.whole.orderBy(self.date)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.within, self.entity)


DEFAULT = Panel()


def median(value: Column) -> Column:
    return F.percentile(value, F.lit(0.5))


def neighbours(frame: DataFrame, p: Panel = DEFAULT) -> DataFrame:
    """Previous and next dates and levels, the 2nd and 7th earlier rows, and gaps in days. Lags count rows, not days."""
    w, level, date = p.window, F.col(p.level), F.col(p.date)
    out = frame.withColumns(
        {
            "previous_date": F.lag(date).over(w), "next_date": F.lead(date).over(w),
            "previous_level": F.lag(level).over(w), "next_level": F.lead(level).over(w),
            "lag_2": F.lag(level, 2).over(w), "lag_7": F.lag(level, 7).over(w),
        }
    )
    return out.withColumns({"gap_before": C.day_gap(F.col("previous_date"), date), "gap_after": C.day_gap(date, F.col("next_date"))})


def rolling(frame: DataFrame, p: Panel = DEFAULT) -> DataFrame:
    """Means over 3 and 7 rows and deviation over 7 rows up to the current one, and the centred median of 7 rows."""
    w, level = p.window, F.col(p.level)
    return frame.withColumns(
        {
            "mean_3": F.avg(level).over(w.rowsBetween(-2, 0)), "mean_7": F.avg(level).over(w.rowsBetween(-6, 0)),
            "sd_7": F.stddev_samp(level).over(w.rowsBetween(-6, 0)), "local_median": median(level).over(w.rowsBetween(-3, 3)),
        }
    )


def before_current(frame: DataFrame, p: Panel = DEFAULT) -> DataFrame:
    """Means over the 7 and 3 rows before the current one, and counts of present levels over 3 and 7 rows."""
    w, level = p.window, F.col(p.level)
    return frame.withColumns(
        {
            "mean_before_7": F.avg(level).over(w.rowsBetween(-7, -1)), "mean_before_3": F.avg(level).over(w.rowsBetween(-3, -1)),
            "count_3": F.count(level).over(w.rowsBetween(-2, 0)), "count_7": F.count(level).over(w.rowsBetween(-6, 0)),
        }
    )


def robust_scales(frame: DataFrame, p: Panel = DEFAULT, past_only: bool = False) -> DataFrame:
    """Entity median of the level, its MAD, and the MAD of the change; ``frame`` has previous_level.

    With ``past_only`` each row sees the rows up to its own: deviations from the median that is known on its day.
    """
    if past_only:
        return past_scales(frame, p)
    w = p.whole
    level, change = F.col(p.level), F.col(p.level) - F.col("previous_level")
    first = frame.withColumns({"entity_median": median(level).over(w), "_change_median": median(change).over(w)})
    return first.withColumns(
        {"entity_mad": median(F.abs(level - F.col("entity_median"))).over(w), "change_mad": median(F.abs(change - F.col("_change_median"))).over(w)}
    ).drop("_change_median")


#: Rows whose prefixes are looked at together, about; a longer record is taken whole.
TOGETHER = 1 << 15


def past_scales(frame: DataFrame, p: Panel = DEFAULT, together: int = TOGETHER) -> DataFrame:
    """entity_median, entity_mad and change_mad of each row from the rows up to its own.

    Records of entities follow one another through a task, as arrays: one shuffle, and no call for each entity. Medians of all
    prefixes of many records are found together, level by level of a wavelet matrix, in n log(longest record)^2 steps.
    """
    added = ("entity_median", "entity_mad", "change_mad")
    rows = frame.drop(*added)

    def measured(table: pa.Table) -> pa.Table:
        def numbers(name: str) -> np.ndarray:
            return table.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)

        starts = np.maximum.accumulate(np.where(table.column("_place").to_numpy() == 1, np.arange(len(table)), 0))
        level = numbers(p.level)
        middle, spread = prefix_mad(level, starts)
        _, change = prefix_mad(level - numbers("previous_level"), starts)
        table = table.drop_columns("_place")
        for name, values in zip(added, (middle, spread, change), strict=True):
            table = table.append_column(name, pa.array(values, pa.float64(), from_pandas=True))
        return table

    def scales(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, enough = [], 0, together
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < enough:
                continue
            table = pa.Table.from_batches(held)
            last = int(np.flatnonzero(table.column("_place").to_numpy() == 1)[-1])  # the last record may go on
            if last:
                yield from measured(table.slice(0, last)).to_batches()
                table = table.slice(last)
            held, n = table.to_batches(), len(table)
            enough = max(together, 2 * n)
        if n:
            yield from measured(pa.Table.from_batches(held)).to_batches()

    schema = rows.select("*", *[F.lit(0.0).cast("double").alias(c) for c in added]).schema
    placed = rows.withColumn("_place", F.row_number().over(p.window))  # leaves each record together, by date
    return placed.mapInArrow(scales, StructType([StructField(f.name, f.dataType, True) for f in schema]))


def prefix_mad(values: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The median of each prefix of ``values``, and the median distance of its values from that; missing values (NaN) don't
    count, and a prefix of nothing else has NaN. ``starts`` tells where each row's record starts, if there are several."""
    present = ~np.isnan(values)
    x, ends = values[present], np.cumsum(present)
    if not len(x):
        return np.full(len(values), np.nan), np.full(len(values), np.nan)
    before = np.zeros(len(values), np.int64) if starts is None else ends[starts] - present[starts]
    begin, end = before[present], np.arange(1, len(x) + 1)
    tree, t = Prefixes(x, begin), end - begin
    low, high = (t - 1) // 2, t // 2

    def kth(k: np.ndarray) -> np.ndarray:
        return tree.sorted[tree.kth(begin, end, k)]

    middle = (kth(low) + kth(high)) / 2
    below = tree.count(begin, end, np.where(middle < kth(high), tree.kth(begin, end, low), tree.kth(begin, end, high)))  # values up to the median

    def distance(k: np.ndarray) -> np.ndarray:
        """The k-th smallest distance: i values below and k - i above are nearer, for the i that a bisection finds."""
        lo, hi = np.maximum(0, k - (t - below)), np.minimum(k, below)
        while (lo < hi).any():
            i = (lo + hi) // 2  # take more from below while the next one there is nearer than the last one taken above
            left, right = middle - kth(np.maximum(below - 1 - i, 0)), kth(np.clip(below + k - i - 1, 0, t - 1)) - middle
            more = (left < right) & (lo < hi)
            lo, hi = np.where(more, i + 1, lo), np.where(more | (lo >= hi), hi, i)
        left = np.where(below - 1 - lo >= 0, middle - kth(np.maximum(below - 1 - lo, 0)), np.inf)
        right = np.where(below + k - lo < t, kth(np.clip(below + k - lo, 0, t - 1)) - middle, np.inf)
        return np.minimum(left, right)

    spread = (distance(low) + distance(high)) / 2
    at = np.maximum(ends - 1, 0)
    return np.where(ends > before, middle[at], np.nan), np.where(ends > before, spread[at], np.nan)


class Prefixes:
    """A wavelet matrix over the ranks of values within their records, which follow one another: order statistics of all
    prefixes of all records at once. ``begin`` tells where each value's record begins."""

    def __init__(self, values: np.ndarray, begin: np.ndarray):
        order = np.lexsort((values, begin))
        self.sorted = values[order]
        rank = np.empty(len(values), np.int64)
        rank[order] = np.arange(len(values)) - begin
        edges = np.append(np.flatnonzero((self.sorted[1:] != self.sorted[:-1]) | (begin[1:] != begin[:-1])) + 1, len(values))
        self.under = edges[np.searchsorted(edges, np.arange(len(values)), "right")] - begin  # values of the record up to this one
        self.levels = []
        for bit in range(max(1, int(rank.max()).bit_length()) - 1, -1, -1):
            one = (rank >> bit) & 1 == 1
            zeros = np.concatenate([[0], np.cumsum(~one)])
            self.levels.append((bit, zeros))
            rank = np.concatenate([rank[~one], rank[one]])

    def kth(self, begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Where in ``sorted`` the k-th smallest (from 0) of the values from ``begin`` to ``end``, all of one record, is."""
        start, found = begin, begin.copy()
        for bit, zeros in self.levels:
            a, b = zeros[start], zeros[end]
            up = k >= b - a
            k = np.where(up, k - (b - a), k)
            start, end = np.where(up, zeros[-1] + start - a, a), np.where(up, zeros[-1] + end - b, b)
            found += up.astype(np.int64) << bit
        return found

    def count(self, begin: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the values from ``begin`` to ``end`` are at most the one at ``at`` in ``sorted``."""
        limit = self.under[at]
        start, n, whole = begin, np.zeros_like(end), end - begin
        for bit, zeros in self.levels:
            a, b = zeros[start], zeros[end]
            up = (limit >> bit) & 1 == 1
            n += np.where(up, b - a, 0)
            start, end = np.where(up, zeros[-1] + start - a, a), np.where(up, zeros[-1] + end - b, b)
        return np.where(limit >= 1 << len(self.levels), whole, n)


def joined_scales(frame: DataFrame, p: Panel = DEFAULT) -> DataFrame:
    """``robust_scales`` by counts in ranges of the value and joins, for entities whose record no task can hold."""
    rows = stored(frame.withColumn("_change", F.col(p.level) - F.col("previous_level")), "scaled-rows")
    keys = rows.select(p.entity, p.level, "_change")
    middle = small(stored(_middles(keys, {p.level: "entity_median", "_change": "_change_median"}, p), "middles"))
    apart = keys.join(middle, p.entity).select(p.entity, F.abs(F.col(p.level) - F.col("entity_median")).alias("_l"), F.abs(F.col("_change") - F.col("_change_median")).alias("_c"))
    spread = _middles(apart, {"_l": "entity_mad", "_c": "change_mad"}, p)
    return rows.join(small(middle.drop("_change_median").join(spread, p.entity)), p.entity).drop("_change")


def _middles(rows: DataFrame, names: dict[str, str], p: Panel) -> DataFrame:
    """(entity, medians) of the columns, under new names."""
    out = None
    for column, name in names.items():
        one = quantiles(rows, [p.entity], column, (0.5,)).select(p.entity, F.col("q0").alias(name))
        out = one if out is None else out.join(one, p.entity)
    return out


def with_halo(frame: DataFrame, rows: int = 7, p: Panel = DEFAULT) -> DataFrame:
    """``frame`` in ranges of (entity, date), each with copies of its entities' last and next ``rows`` rows across its borders:
    _part numbers the ranges, and _core marks the rows that are no copies.

    Windows of up to ``rows`` rows to either side then need no more than a range: an entity that no task can hold lies in many.
    """
    placed = in_ranges(frame, [p.entity], [p.date])
    own = Window.partitionBy("_part", p.entity)
    ends = placed.withColumns({"_up": F.row_number().over(own.orderBy(p.date)), "_down": F.row_number().over(own.orderBy(F.desc(p.date)))})
    ends = ends.where((F.col("_up") <= rows) | (F.col("_down") <= rows))
    parts = placed.select(p.entity, "_part").distinct()
    every = Window.partitionBy(p.entity)  # a row for each range of the entity
    parts = stored(parts.withColumns({"_k": F.row_number().over(every.orderBy("_part")), "_all": F.collect_list("_part").over(every.orderBy("_part").rowsBetween(-rows, rows))}).where(F.size("_all") > 1), "halo-parts")
    met = ends.join(small(parts.withColumnsRenamed({p.entity: "_e", "_part": "_p"})), (F.col(p.entity) == F.col("_e")) & (F.col("_part") == F.col("_p")))
    # the last rows go to the ranges after, the first to those before; a range with fewer rows than the halo is passed over
    to = met.withColumn("_to", F.explode("_all")).where(((F.col("_to") > F.col("_part")) & (F.col("_down") <= rows)) | ((F.col("_to") < F.col("_part")) & (F.col("_up") <= rows)))
    copies = to.withColumn("_part", F.col("_to")).select(*placed.columns).withColumn("_core", F.lit(False))
    return placed.withColumn("_core", F.lit(True)).unionByName(copies)


def long_candidates(frame: DataFrame, p: Panel = DEFAULT) -> DataFrame:
    """``candidates`` for entities that no task can hold: windows in ranges of dates with a halo, scales by counts in ranges of
    the value."""
    ranged = replace(p, within=(*p.within, "_part"))
    near = rolling(neighbours(with_halo(frame, 7, p), ranged), ranged).where("_core").drop("_part", "_core")
    return changes(joined_scales(near, p), p).withColumns(C.calendar(F.col(p.date)))


def changes(frame: DataFrame, p: Panel = DEFAULT) -> DataFrame:
    """Change from the day before, target (change to the next day), and differences of the level to its own history."""
    level = F.col(p.level)
    return frame.withColumns(
        {
            "change": level - F.col("previous_level"), "target": F.col("next_level") - level,
            "minus_mean_7": level - F.col("mean_7"), "minus_mean_3": level - F.col("mean_3"),
            "slope_2": (level - F.col("lag_2")) / 2.0, "slope_7": (level - F.col("lag_7")) / 7.0,
            "minus_entity_median": level - F.col("entity_median"),
        }
    )


def candidates(frame: DataFrame, p: Panel = DEFAULT) -> DataFrame:
    """All history columns of a daily panel, before any gate."""
    return changes(robust_scales(rolling(neighbours(frame, p), p), p), p).withColumns(C.calendar(F.col(p.date)))


def gate(p: Panel = DEFAULT) -> Column:
    """True days on both sides and three levels above zero."""
    return (
        (F.col("gap_before") == 1) & (F.col("gap_after") == 1)
        & (F.col(p.level) > 0) & (F.col("previous_level") > 0) & (F.col("next_level") > 0) & F.col("target").isNotNull()
    )


def target_scale(frame: DataFrame, p: Panel = DEFAULT) -> DataFrame:
    """The MAD of each entity's target over the rows given."""
    first = frame.withColumn("_target_median", median(F.col("target")).over(p.whole))
    return first.withColumn("target_mad", median(F.abs(F.col("target") - F.col("_target_median"))).over(p.whole)).drop("_target_median")


def beyond(value: Column, scale: Column, k: float) -> Column:
    """|value| > k * 1.4826 * scale; False where the scale is 0 or missing."""
    return F.when(scale.isNull() | (scale == 0), F.lit(False)).otherwise(F.abs(value) > k * C.MAD_SCALE * scale)


def extreme(value: Column, cut: float, inclusive: bool = False) -> Column:
    """|value| beyond the cut, or from it on."""
    return F.abs(value) >= cut if inclusive else F.abs(value) > cut


def flags(frame: DataFrame, floor: float = 5.0, k: float = 6.0, k_relative: float = 5.0, cuts: tuple[float, ...] = (3, 5, 7, 10), p: Panel = DEFAULT) -> DataFrame:
    """Extreme, implausible, robust-outlier and dropout flags. They never drop a row."""
    target, change, level = F.col("target"), F.col("change"), F.col(p.level)
    return frame.withColumns(
        {
            **{f"extreme_{cut:g}": extreme(target, cut) for cut in cuts},
            "extreme_relative": beyond(target, F.col("target_mad"), k_relative),
            "implausible": (level < floor) | (F.col("previous_level") < floor) | (F.col("next_level") < floor),
            "robust_outlier": beyond(level - F.col("local_median"), F.col("change_mad"), k),
            "dropout": ((change < -floor) & (target > floor)) | ((change > floor) & (target < -floor)),
        }
    )


def model_table(panel: DataFrame, floor: float = 5.0, k: float = 6.0, k_relative: float = 5.0, cuts: tuple[float, ...] = (3, 5, 7, 10), p: Panel = DEFAULT) -> DataFrame:
    """The gated and flagged modelling table of a daily panel, one row for each entity and day."""
    gated = candidates(panel, p).where(gate(p))
    return flags(target_scale(gated, p), floor, k, k_relative, cuts, p)


def waterfall(panel: DataFrame, p: Panel = DEFAULT) -> DataFrame:
    """(step, label, rows_remaining, rows_dropped): how many rows each gate in turn leaves; one pass over the panel."""
    rows = changes_only(panel, p)
    positive = (F.col(p.level) > 0) & (F.col("previous_level") > 0) & (F.col("next_level") > 0)
    steps = [("all rows", F.lit(True)), ("previous day", F.col("gap_before") == 1), ("next day", F.col("gap_after") == 1), ("levels present", F.col("target").isNotNull() & F.col("previous_level").isNotNull()), ("levels positive", positive)]
    passed, counts = F.lit(True), []
    for _, condition in steps:
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed))
    return stepped(rows.agg(F.array(*counts).alias("counts")), [label for label, _ in steps])


def changes_only(panel: DataFrame, p: Panel = DEFAULT) -> DataFrame:
    return neighbours(panel, p).withColumn("target", F.col("next_level") - F.col(p.level))


def stepped(counts: DataFrame, labels: list[str]) -> DataFrame:
    """One row of counts as a table of steps with the rows that each drops."""
    long = counts.select(F.posexplode("counts").alias("step", "rows_remaining"))
    label = F.element_at(F.array(*map(F.lit, labels)), F.col("step") + 1)
    before = F.lag("rows_remaining").over(Window.orderBy("step"))  # one row for each step
    return long.select(F.col("step").cast("long"), label.alias("label"), "rows_remaining", F.coalesce(before - F.col("rows_remaining"), F.lit(0)).cast("long").alias("rows_dropped"))


def forward_filled(frame: DataFrame, columns: list[str], p: Panel = DEFAULT) -> DataFrame:
    """Last present value within the entity, with <column>_was_missing."""
    w = p.window.rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns} | {f"{c}_was_missing": F.col(c).isNull() for c in columns})


def carried(frame: DataFrame, columns: list[str], p: Panel = DEFAULT) -> DataFrame:
    """``forward_filled`` for entities that no task can hold: each range of dates is filled on its own, and begins with what the
    last range with a value of the entity carries into it."""
    placed = in_ranges(frame, [p.entity], [p.date])
    last = placed.groupBy(p.entity, "_part").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(p.date))).alias(f"_last_{c}") for c in columns])
    earlier = Window.partitionBy(p.entity).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    into = last.select(F.col(p.entity).alias("_e"), F.col("_part").alias("_p"), *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_into_{c}") for c in columns])
    met = placed.join(small(into), F.col(p.entity).eqNullSafe(F.col("_e")) & (F.col("_part") == F.col("_p")))
    w = Window.partitionBy("_part", p.entity).orderBy(p.date).rowsBetween(Window.unboundedPreceding, 0)
    filled = met.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_into_{c}")) for c in columns} | {f"{c}_was_missing": F.col(c).isNull() for c in columns})
    return filled.select(*frame.columns, *[f"{c}_was_missing" for c in columns])


def imputed(frame: DataFrame, columns: list[str], p: Panel = DEFAULT) -> DataFrame:
    """Forward fill within the entity, then the entity's median, then the median of all rows (a scalar subquery)."""
    overall = frame.agg(*[F.percentile_approx(c, 0.5, 100_000).alias(f"_{c}") for c in columns])
    filled = forward_filled(frame.withColumns({f"_{c}_m": median(F.col(c)).over(p.whole) for c in columns}), columns, p)
    return filled.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}_m"), overall.select(f"_{c}").scalar()) for c in columns}).drop(*[f"_{c}_m" for c in columns])


def filled_by(frame: DataFrame, columns: list[str], how: str = "median") -> DataFrame:
    """Gaps filled by one number for each column: the mean of all rows, or their exact median."""
    if how == "mean":
        one = frame.agg(*[F.avg(c).alias(f"_{c}") for c in columns])
        return frame.withColumns({c: F.coalesce(F.col(c), one.select(f"_{c}").scalar()) for c in columns})
    if how != "median":
        raise ValueError(f"no fill is called {how}")
    return frame.withColumns({c: F.coalesce(F.col(c), quantiles(frame, [], c, (0.5,)).select("q0").scalar()) for c in columns})


def equal_bins(frame: DataFrame, value: str, order: list[str], bins: int = 10, name: str = "bin", within: tuple[str, ...] = ()) -> DataFrame:
    """Equal-frequency bins 1..bins by first rank (ties by ``order``), within groups if given.

    The k-th of n values (from 0) falls in bin max(1, ceil(bins * k / (n - 1))), computed in integers. Without ``within``
    the ranks are taken in two phases, so no task holds all rows.
    """
    ranked, n = _ranked(frame, value, order, within), F.col("_n") - 1
    number = F.when(n <= 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.expr(f"({bins} * (_rank - 1) + _n - 2) div greatest(_n - 1, 1)")))
    return ranked.withColumn(name, F.when(F.col(value).isNotNull(), number.cast("long"))).drop("_rank", "_n")


def _ranked(frame: DataFrame, value: str, order: list[str], within: tuple[str, ...]) -> DataFrame:
    """_rank (from 1) and _n among the rows with a value."""
    if within:
        w = Window.partitionBy(*within)
        return frame.withColumns({"_rank": F.row_number().over(w.orderBy(F.col(value).asc_nulls_last(), *order)), "_n": F.count(value).over(w)})
    placed = in_ranges(frame, [], [F.col(value).asc_nulls_last(), *order])
    local = Window.partitionBy("_part").orderBy(F.col(value).asc_nulls_last(), *order)
    placed = placed.withColumn("_local", F.row_number().over(local))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"), F.count(value).alias("_with"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_with").over(Window.partitionBy()).alias("_n"))
    return placed.join(F.broadcast(offsets), "_part").withColumn("_rank", F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def running_before(frame: DataFrame, keys: list[str], value: str, amounts: list[str], order: list[str] | None = None) -> DataFrame:
    """``frame`` with <amount>_before: the sum over the rows of its ``keys`` with a smaller value (then by ``order``).

    Two phases: ranges of about equally many rows are summed on their own, and a range starts where the earlier ones of its
    key end, so no task holds all rows of a key. Rows with a missing key are left out; ``value`` is a number.
    """
    placed = in_ranges(frame, keys, [value, *(order or [])])
    local = Window.partitionBy("_part", *keys).orderBy(value, *(order or [])).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "_part").agg(*[F.sum(a).alias(f"_{a}_sum") for a in amounts])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = sums.select(*keys, "_part", *[F.coalesce(F.sum(f"_{a}_sum").over(earlier), F.lit(0)).alias(f"_{a}_off") for a in amounts])
    own = placed.withColumns({f"_{a}_own": F.coalesce(F.sum(a).over(local), F.lit(0)) for a in amounts})
    out = own.join(small(offsets), [*keys, "_part"])
    return out.withColumns({f"{a}_before": F.col(f"_{a}_own") + F.col(f"_{a}_off") for a in amounts}).drop("_part", *[f"_{a}_{k}" for a in amounts for k in ("own", "off")])


def quantiles(frame: DataFrame, keys: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """(keys, n, q0, q1, ..): exact percentiles of each group's values, linear between neighbours.

    Rows are counted by distinct value, and the counts summed in ranges of the value, so no task holds a group. Missing
    values count for nothing: a group without any has n = 0 and NULLs. Rows with a missing key are left out. Without keys
    there is one row.
    """
    group = keys or ["_all"]
    rows = frame if keys else frame.withColumn("_all", F.lit(1))
    number = F.col(value).cast("double")
    met = running_before(rows.groupBy(*group, number.alias("_x")).agg(F.count(number).alias("_c")), group, "_x", ["_c"])
    totals = met.groupBy(*group).agg(F.sum("_c").alias("n"))
    met = met.join(totals, group)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_c_before") <= place) & (place < F.col("_c_before") + F.col("_c")), F.col("_x")))

    places = [F.lit(float(q)) * (F.col("n") - 1) for q in shares]
    ends = [c.alias(f"_{side}{k}") for k, place in enumerate(places) for side, c in (("low", at(F.floor(place))), ("high", at(F.ceil(place))))]
    out = totals.join(met.groupBy(*group).agg(*ends), group, "left")
    found = [(F.col(f"_low{k}") + (F.col(f"_high{k}") - F.col(f"_low{k}")) * (place - F.floor(place))).alias(f"q{k}") for k, place in enumerate(places)]
    if keys:
        return out.select(*keys, "n", *found)
    return out.select("n", *found).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *[F.max(f"q{k}").alias(f"q{k}") for k in range(len(shares))])


def in_ranges(frame: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``frame`` with _part, which numbers ascending ranges of about equally many rows in the order of keys and ``order``.

    Ranges end between any two rows that differ in these, so a value that most rows hold is split by what follows it. The
    rows are stored: a row's range is the same however often it is read.
    """
    return stored(frame.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def small(frame: DataFrame, most: int = 200_000) -> DataFrame:
    """``frame``, broadcast if its rows, counted here, are few; else as it is, for a shuffle join."""
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame
