"""Ranges, halos, carries, order statistics, permutations and least squares against plain forms."""

import os
import subprocess
import sys
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import enrich, history
from strandline.plans import backtest as B
from strandline.plans import linear as L
from strandline.plans import models as M
from strandline.sources import readers, sinks

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def many_ranges(spark):
    """Eight ranges that aren't put together again."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def record(spark, lengths, seed=1, missing=0.1):
    rng = np.random.default_rng(seed)
    rows = []
    for entity, n in enumerate(lengths):
        day = date(2020, 1, 1)
        for _ in range(n):
            day += timedelta(days=int(rng.integers(1, 3)))
            rows.append((entity, day, None if rng.random() < missing else float(np.round(rng.normal(30, 5), 1))))
    order = rng.permutation(len(rows)).tolist()
    return spark.createDataFrame([rows[k] for k in order], "entity_id long, obs_date date, level double")


def listed(frame, columns):
    return sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.select(*columns).collect()), key=str)


@pytest.mark.parametrize("lengths", [(500,), (3, 1, 400, 2, 5, 90), (0,)])
def test_long_entities_equal_windows(spark, many_ranges, lengths):
    frame = record(spark, lengths)
    plain, ranged = history.candidates(frame), history.long_candidates(frame)
    assert sorted(plain.columns) == sorted(ranged.columns)
    assert listed(plain, sorted(plain.columns)) == listed(ranged, sorted(plain.columns))
    if lengths == (500,):
        assert history.in_ranges(frame, ["entity_id"], ["obs_date"]).select("_part").distinct().count() == 8
    filled = (history.forward_filled(frame, ["level"]), history.carried(frame, ["level"]))
    assert listed(filled[0], ["entity_id", "obs_date", "level", "level_was_missing"]) == listed(filled[1], ["entity_id", "obs_date", "level", "level_was_missing"])


def test_halo_passes_over_short_ranges(spark, many_ranges):
    """A range with fewer rows than the halo: what lies beyond it is copied too."""
    frame = record(spark, (12,), missing=0)
    columns = ["obs_date", "lag_7", "mean_7", "local_median"]
    assert listed(history.rolling(history.neighbours(frame)), columns) == listed(history.long_candidates(frame), columns)


def test_carry_over_ranges_without_a_value(spark, many_ranges):
    rows = [(1, date(2020, 1, 1) + timedelta(days=k), 5.0 if k == 3 else None) for k in range(200)]
    found = history.carried(spark.createDataFrame(rows, "entity_id long, obs_date date, level double"), ["level"]).orderBy("obs_date").collect()
    assert [r.level for r in found] == [None] * 3 + [5.0] * 197 and sum(r.level_was_missing for r in found) == 199


@pytest.mark.parametrize("seed", range(6))
def test_deviations_known_on_the_day(seed):
    rng = np.random.default_rng(seed)
    n = (1, 2, 7, 64, 65, 200)[seed]
    values = np.round(rng.normal(0, 3, n), 0 if seed % 2 else 6)
    values[rng.random(n) < 0.2] = np.nan
    middle, spread = history.prefix_mad(values)
    for t in range(n):
        seen = values[: t + 1][~np.isnan(values[: t + 1])]
        if not len(seen):
            assert np.isnan(middle[t]) and np.isnan(spread[t])
        else:
            assert middle[t] == np.median(seen) and spread[t] == pytest.approx(np.median(np.abs(seen - np.median(seen))), abs=1e-12)


def test_deviations_of_many_records_at_once(spark):
    """Records of one call, and records cut by batches, as each alone."""
    rng = np.random.default_rng(1)
    sizes = [1, 40, 3, 1, 200, 7, 64, 2]
    records = [np.where(rng.random(n) < 0.2, np.nan, np.round(rng.normal(0, 3, n), n % 2)) for n in sizes]
    records[3][:] = np.nan
    starts = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    alone = np.concatenate([np.stack(history.prefix_mad(r)) for r in records], axis=1)
    assert np.array_equal(np.stack(history.prefix_mad(np.concatenate(records), starts)), alone, equal_nan=True)
    frame = history.neighbours(record(spark, sizes))
    columns = ["entity_id", "obs_date", "entity_median", "entity_mad", "change_mad"]
    assert listed(history.past_scales(frame, together=5), columns) == listed(history.past_scales(frame), columns)


def test_past_scales_keep_other_columns(spark):
    frame = history.neighbours(record(spark, (9, 4))).withColumn("entity_mad", F.lit("old"))
    found = history.robust_scales(frame, past_only=True)
    assert found.count() == 13 and dict(found.dtypes)["entity_mad"] == "double" and history.robust_scales(frame.where("false"), past_only=True).count() == 0


def test_ranges_split_a_common_value(spark, many_ranges):
    rows = [(k, 1.0 if k % 100 else float(k)) for k in range(4000)]
    frame = spark.createDataFrame(rows, "k long, v double")
    sizes = [r[0] for r in history.in_ranges(frame, [], ["v", "k"]).groupBy("_part").count().select("count").collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * 4000 / 8
    found = history.equal_bins(frame, "v", ["k"], 10).groupBy("bin").count().collect()
    assert sorted(r["count"] for r in found) == pytest.approx([400] * 10, abs=2)


def test_permutation_of_all_rows(spark):
    rows = [(k % 7, k, float(k), float(-k)) for k in range(300)]
    found = M.permuted(spark.createDataFrame(rows, "e long, k long, a double, b double"), ["a", "b"], ["e", "k"], 3).collect()
    assert len(found) == 900
    for repeat in range(3):
        own = [r for r in found if r.repeat == repeat]
        assert sorted(r._s_a for r in own) == sorted(r.a for r in own) and all(r._s_a == -r._s_b for r in own)
        assert sum(r._s_a == r.a for r in own) < 10
    assert {(r.k, r._s_a) for r in found if r.repeat == 0} != {(r.k, r._s_a) for r in found if r.repeat == 1}


def test_least_squares_of_all_folds(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(400):
        a, b = rng.normal(1000, 1), rng.normal()
        rows.append((f"f{k % 3}", "train" if k % 5 else "test", float(a), float(b) if k % 11 else None, float(2 * a), 4.0, float(3 * a - 2 * b + rng.normal()) if k % 13 else None))
    rows.append(("empty", "test", 1.0, 1.0, 1.0, 1.0, 1.0))
    frame = spark.createDataFrame(rows, "fold string, part string, a double, b double, twice double, same double, target double")
    for columns in (["a"], ["a", "b"], ["a", "b", "twice", "same"], []):
        found = L.predicted(frame, ["fold"], columns).collect()
        place = {"a": 2, "b": 3, "twice": 4, "same": 5}
        for fold in ("f0", "f1", "f2"):
            train = [r for r in rows if r[0] == fold and r[1] == "train" and r[6] is not None]
            x = np.array([[1.0, *(r[place[c]] or 0.0 for c in columns)] for r in train])
            beta = np.linalg.lstsq(x, np.array([r[6] for r in train]), rcond=None)[0]
            for r in (r for r in found if r.fold == fold):
                assert r.y_pred == pytest.approx(float(np.r_[1.0, [r[c] or 0.0 for c in columns]] @ beta), rel=1e-6)
        assert [r.y_pred for r in found if r.fold == "empty"] == [None]


def test_samples_by_sums_equal_samples_by_rows(spark):
    """Least squares over added sums gives what a model gets that sees each sample's rows."""
    rng = np.random.default_rng(3)
    rows = []
    for entity in range(8):
        for k in range(40 + entity):
            start = B.plus_months(date(2018, 1, 1), k + entity % 3)
            change = float(rng.normal())
            rows.append((entity, start, B.plus_months(start, 2), float(0.5 * change + rng.normal(0, 0.5) + start.month / 6), change if k % 9 else None))
    frame = spark.createDataFrame(rows, "entity_id long, period_start date, target_period_end date, target double, change double")
    by_sums = {(r.fraction, r.repeat): r for r in B.resampled_skill(frame, linear=["change"], repeats=3).collect()}
    by_rows = {(r.fraction, r.repeat): r for r in B.resampled_skill(frame, model=lambda met: L.predicted(met, ["fold"], ["change"]), repeats=3).collect()}
    assert by_sums.keys() == by_rows.keys() and len(by_sums) == 16
    for key, a in by_sums.items():
        b = by_rows[key]
        assert (a.entities, a.n, a.folds) == (b.entities, b.n, b.folds) and a.skill == pytest.approx(b.skill, abs=1e-9)
    # the plain form for one sample: all entities
    whole = B.rolling_folds(frame, "period_start")
    split = B.assigned(frame, whole, "period_start", "target_period_end")
    board = B.with_skill(B.board(L.predicted(split, ["fold"], ["change"]).withColumns({"rule": F.lit("m"), "y_true": F.col("target")})), B.best(B.board(B.naive(split, B.PERIOD_RULES, date_column="period_start"))))
    assert by_sums[(1.0, 0)].skill == pytest.approx(board.agg(F.avg("skill")).first()[0], abs=1e-9)


def test_side_by_side(spark):
    context = spark.sparkContext
    context.setLocalProperty("callSite.short", "mine")
    tasks = [lambda k=k: (k, spark.range(k).count(), context.getLocalProperty("spark.scheduler.pool"), context.getLocalProperty("callSite.short")) for k in range(6)]
    assert M.side_by_side(spark, tasks) == [(k, k, "fits", "mine") for k in range(6)]
    context.setLocalProperty("callSite.short", None)

    def broken():
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        M.side_by_side(spark, [broken, tasks[0]])


def test_one_matrix_for_all_folds_equals_one_for_each(spark):
    rows = history.candidates(record(spark, (80, 60), missing=0.2)).where("target is not null")
    folds = [B.Fold("a", date(2020, 3, 1), date(2020, 4, 1)), B.Fold("b", date(2020, 4, 1), date(2020, 5, 1))]
    split, columns = B.assigned(rows, folds), ["change", "minus_mean_7", "slope_7"]
    whole = {(r.fold, r.part, r.entity_id, r.obs_date): r.features.toArray().tolist() for r in M.fold_matrix(split, columns).collect()}
    for f in folds:
        own = split.where(F.col("fold") == f.name)
        for r in M.matrix(own, columns, train=own.where("part = 'train'")).collect():
            assert whole[(r.fold, r.part, r.entity_id, r.obs_date)] == pytest.approx(r.features.toArray().tolist())


def test_unit_of_a_scale(spark):
    frame = spark.createDataFrame([(float(k) if k else None,) for k in range(101)], "s double")
    found = sorted((r.s or 0.0, r._unit) for r in M.on_scale(frame, "s").collect())
    assert found[0] == (0.0, 50.5) and found[1][1] == pytest.approx(5.95) and found[100][1] == 100.0


def test_buckets_are_used_again(spark):
    """History over a bucketed table shuffles nothing, and neither does a semi-join on the bucket key."""
    name = f"panel_{os.getpid()}"
    sinks.table(record(spark, (40, 30, 20)), name, buckets=(4, "entity_id"), path=f"{sinks.scratch_dir(spark)}/{name}")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        panel = spark.table(name)
        plan = history.model_table(panel)._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "Exchange" not in plan
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        met = enrich.kept_on(panel, spark.table(name).where("level > 0 and entity_id > 0"), "entity_id", most=0)
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString() and met.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE {name}")


def test_folders_pruned_by_a_dimension(spark):
    """Facts in folders of stations: a filtered dimension decides which folders are read."""
    path = f"{sinks.scratch_dir(spark)}/folders-{os.getpid()}"
    spark.range(4000).select("id", (F.col("id") % 40).alias("station")).write.mode("overwrite").partitionBy("station").parquet(path)
    dimension = f"{path}-stations"
    spark.range(40).select(F.col("id").cast("int").alias("station"), F.col("id").alias("distance")).write.mode("overwrite").parquet(dimension)
    met = enrich.station_days(readers.partitioned(spark, path), spark.read.parquet(dimension).where("distance < 3"), "station")
    assert met.count() == 300
    plan = met._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()


def test_queries_outlive_a_session():
    """A query after the session of an earlier one was stopped, and a result collected after the next query was built."""
    code = """
from pyspark.sql import SparkSession
import __spark_entry__ as e
def start():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
q, sf = e.queries(), "/root/testdata/sf0.001"
s = start(); q["event_proximity"](s, sf).collect(); s.stop()
s = start(); a = q["event_proximity"](s, sf); b = q["linear_board"](s, sf); print("rows", len(a.collect()), len(b.collect()))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert "rows 4" in out.stdout, out.stderr[-2000:]
