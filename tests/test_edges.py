"""Hand-made edge cases of the panel operators."""

from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.operators import audit, events, extremes, history, periods, units
from strandline.plans import backtest as B
from strandline.plans import models as M
from strandline.sources import payloads, readers, sinks
from strandline.streaming.daily import stream_days


def panel(spark, rows, columns="entity_id long, obs_date date, level double"):
    return spark.createDataFrame(rows, columns)


def days(levels, entity=1, first=1, skip=()):
    return [(entity, date(2024, 1, first + k), x) for k, x in enumerate(levels) if first + k not in skip]


def test_gate_needs_true_neighbours(spark):
    found = history.candidates(panel(spark, days([9.0, 9.5, 9.2, 0.0, 9.1, 9.3], skip=(4,)))).where(history.gate())
    assert [r.obs_date.day for r in found.collect()] == [2]


def test_lag_stays_in_entity(spark):
    rows = days([1.0, 2.0]) + days([5.0, 6.0], entity=2)
    found = history.neighbours(panel(spark, rows)).where("obs_date = date'2024-01-01'").collect()
    assert all(r.previous_level is None for r in found)


def test_forward_fill_stops_at_entity(spark):
    rows = [(1, date(2024, 1, 1), 3.0), (1, date(2024, 1, 2), None), (2, date(2024, 1, 1), None)]
    found = {(r.entity_id, r.obs_date.day): (r.level, r.level_was_missing) for r in history.forward_filled(panel(spark, rows), ["level"]).collect()}
    assert found == {(1, 1): (3.0, False), (1, 2): (3.0, True), (2, 1): (None, True)}


def test_zero_scale_flags_nothing(spark):
    found = history.model_table(panel(spark, days([7.0] * 9)), 5.0).agg(F.count_if("robust_outlier"), F.count_if("extreme_relative"), F.count(F.lit(1))).first()
    assert tuple(found) == (0, 0, 7)


def test_floor_and_dropout(spark):
    found = history.model_table(panel(spark, days([34.0, 0.0005, 34.0, 34.1])), 5.0).collect()
    assert found[0].implausible and found[0].dropout


def test_joined_scales_equal_windows(spark):
    base = history.neighbours(panel(spark, days([1.0, 4.0, 2.0, 8.0, 5.0]) + days([3.0, 3.5], entity=2)))
    columns = ["entity_id", "obs_date", "entity_median", "entity_mad", "change_mad"]
    a, b = (sorted(map(tuple, f(base).select(*columns).collect())) for f in (history.robust_scales, history.joined_scales))
    assert a == b


def test_bins_follow_first_rank_cuts(spark):
    frame = spark.createDataFrame([(k, float((k * 7) % 23)) for k in range(23)], "k int, v double")
    found = history.equal_bins(frame, "v", ["k"], 10).toPandas()
    assert found.groupby("bin").size().tolist() == pd.qcut(pd.Series(range(23)), 10, labels=False).value_counts(sort=False).sort_index().tolist()


def test_period_index_edges(spark):
    frame = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 7),), (date(2024, 1, 8),)], "d date")
    found = frame.select(C.week_index(F.col("d")).alias("w"), C.month_index(F.col("d")).alias("m")).collect()
    assert [r.w for r in found] == [2819, 2819, 2820] and found[0].m == 648


def test_empty_sensor_sums_to_zero(spark):
    rows = [(1, date(2024, 1, d), 5.0, None) for d in range(1, 8)]
    found = periods.aggregated(panel(spark, rows, "entity_id long, obs_date date, level double, t double"), "week", outside="t", sensors=("t",)).first()
    assert found.warm_days == 0.0 and found.t_mean is None and abs(found.slope) < 1e-12


def test_counter_reset_in_any_unit(spark):
    for unit in (1.0, 86400.0):
        counter = [10, 11, 12, 1, 2, 3]
        rows = [(1, date(2024, 3, 1 + k), v * unit) for k, v in enumerate(counter)]
        found = events.resets(panel(spark, rows, "entity_id long, obs_date date, c double"), "c", "x").collect()
        assert len(found) == 1 and found[0].accepted and found[0].days_since == 1.0
    rows = [(1, date(2023, 12, 29 + k) if k < 3 else date(2024, 1, k - 2), v) for k, v in enumerate([10.0, 11.0, 12.0, 1.0, 2.0, 3.0])]
    assert not events.resets(panel(spark, rows, "entity_id long, obs_date date, c double"), "c", "x").first().accepted


def test_steps_must_last(spark):
    held, back = days([20.0] * 3 + [14.0] * 9), days([20.0] * 3 + [14.0] + [20.0] * 8, entity=2)
    found = events.step_downs(panel(spark, held + back), 3.0).collect()
    assert [(r.entity_id, r.obs_date.day, r.removed) for r in found] == [(1, 4, 6.0)]


def test_units_told_apart(spark):
    rows = [(e, date(2024, 1, d), float(d) * u) for e, u in ((1, 1), (2, 86400)) for d in range(1, 6)] + [(3, date(2024, 1, 1), 4.0)]
    found = units.normalised(panel(spark, rows, "entity_id long, obs_date date, c double"), ["c"])
    assert found.agg(F.max("days")).first()[0] == 5.0
    assert tuple(units.report(found).first()) == ("c", 2, 1, 1)


def test_origins_step_from_month_ends():
    found = B.origins(date(2019, 8, 31), date(2022, 12, 31), keep=None)
    assert [f.origin for f in found][:3] == [date(2020, 8, 31), date(2021, 2, 28), date(2021, 8, 28)]
    with pytest.raises(ValueError, match="too short"):
        B.origins(date(2020, 1, 1), date(2020, 9, 1))


def test_embargo_excludes_what_plain_folds_admit(spark):
    rows = [(1, date(2020, 1, 1), date(2020, 1, 31)), (1, date(2020, 6, 20), date(2020, 7, 1)), (1, date(2020, 7, 1), date(2020, 7, 8))]
    frame = panel(spark, rows, "entity_id long, d date, ends date")
    fold = [B.Fold("f", date(2020, 7, 1), date(2020, 8, 1))]
    assert B.fold_table(frame, fold, "d").first().n_train == 2
    embargoed = B.fold_table(frame, fold, "d", "ends").first()
    assert (embargoed.n_train, embargoed.embargoed) == (1, 1)
    B.assert_order(frame, fold, "d", "ends")


def test_one_class_gives_nulls(spark):
    found = B.classifier_report(spark.createDataFrame([(0, 0.1), (0, 0.9)], "label int, score double")).first()
    assert found.average_precision is None and found.roc_auc is None and found.positive_rate == 0.0


def test_constant_pair_has_no_correlation(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert frame.agg(C.pearson(F.col("x"), F.col("y"))).first()[0] is None


@pytest.mark.parametrize("name", ["next_level", "dropout", "nearest_purchase", "implausible", "robust_outlier", "entity_median", "purchase_next_dif", "extreme_5", "target_mad"])
def test_leakage_guard(name):
    with pytest.raises(ValueError, match=name):
        M.assert_no_leakage(["level", name])


def test_leakage_guard_allows_by_name():
    assert M.assert_no_leakage(["next_rain"], allow=["next_rain"]) == ["next_rain"]


def test_regimes_are_those_of_the_survey():
    flow = {m for m in range(1, 13) if C.REGIMES["flow_vs_rest"][m] == "flow"}
    assert flow == {4, 5, 6, 7, 8}
    cycle = C.REGIMES["colony_cycle"]
    assert [cycle[m] for m in (2, 3, 5, 6, 8, 9)] == ["dormancy", "buildup", "buildup", "flow", "flow", "dormancy"]
    assert C.REGIMES["season"][12] == "Winter" and C.REGIMES["season"][9] == "Autumn" and all(len(x) == 12 for x in C.REGIMES.values())


def test_embargo_ends_at_the_first_test_date(spark):
    day = lambda y, m, d: date(y, m, d)
    rows = [(day(2020, 1, 1), day(2020, 1, 31)), (day(2020, 12, 20), day(2021, 1, 5)), (day(2020, 12, 28), day(2021, 1, 12)), (day(2021, 1, 10), day(2021, 1, 20)), (day(2021, 7, 1), day(2021, 7, 20))]
    frame = spark.createDataFrame([(1, a, b) for a, b in rows], "entity_id long, start date, until date")
    folds = B.rolling_folds(frame, "start")
    assert folds[0].origin == date(2021, 1, 1) and folds[0].test_start == date(2021, 1, 10)
    r = B.fold_table(frame, folds, "start", "until").first()
    assert (r.n_train, r.n_test, r.embargoed, r.train_end) == (2, 1, 1, date(2021, 1, 5))
    B.assert_order(frame, folds, "start", "until")


def test_running_sums_in_ranges(spark):
    rows = [(k % 3, float((k * 7) % 13), k) for k in range(200)]
    found = history.running_before(spark.createDataFrame(rows, "g long, v double, a long"), ["g"], "v", ["a"], ["a"]).collect()
    assert len(found) == 200
    for r in found:
        assert r.a_before == sum(a for g, v, a in rows if g == r.g and (v, a) < (r.v, r.a))


def test_label_board_keeps_rules_without_positives(spark):
    rows = [(1, date(2000 + k // 12, k % 12 + 1, 1), date(2000 + k // 12, k % 12 + 1, 28), float(k % 5), float(k % 3)) for k in range(30)]
    frame = spark.createDataFrame(rows, "entity_id long, period_start date, target_period_end date, target double, score double")
    board = M.label_board(frame, B.rolling_folds(frame, "period_start"), {"some": F.col("target") > 2, "none": F.col("target") > 99}, lambda train, test: test, least_train=1, least_test=1)
    found = {(r.rule, r.fold): r for r in board.collect()}
    assert {k[0] for k in found} == {"some", "none"} and len(found) == 2 * len(B.rolling_folds(frame, "period_start"))
    for (rule, _), r in found.items():
        assert (r.average_precision is None) == (rule == "none") and r.n == 6


def test_quantiles_in_ranges(spark):
    values = [("a", float(v)) for v in (5, 1, 1, 1, 9, 2, 7)] + [("b", 4.0), ("b", None), ("c", None)]
    frame = spark.createDataFrame(values, "k string, x double")
    found = {r.k: (r.n, r.q0, r.q1, r.q2) for r in history.quantiles(frame, ["k"], "x", (0.0, 0.5, 0.9)).collect()}
    assert found["a"] == (7, 1.0, 2.0, pytest.approx(7.8))
    assert found["b"] == (1, 4.0, 4.0, 4.0) and found["c"] == (0, None, None, None)
    assert history.quantiles(frame.where("x > 100"), [], "x", (0.5,)).collect() == [(0, None)]
    assert history.quantiles(frame, [], "x", (0.5,)).first().q0 == 3.0


def test_classifier_report_matches_plain_sums(spark):
    rows = [(int((k * 5) % 7 < 2), float((k * 3) % 11)) for k in range(120)] + [(1, None)]
    r = B.classifier_report(spark.createDataFrame(rows, "label int, score double")).first()
    pos, neg = [s for x, s in rows if x and s is not None], [s for x, s in rows if not x]
    assert r.roc_auc == pytest.approx(sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)) and r.n == 120


def test_matrix_learns_fills_from_training_rows(spark):
    train = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 9.0)], "entity_id long, level double")
    test = spark.createDataFrame([(1, None), (3, None), (2, 5.0)], "entity_id long, level double")
    found = {r.entity_id: r.features.toArray().tolist() for r in M.matrix(test, ["level"], train=train).collect()}
    assert found == {1: [3.0, 1.0], 3: [4.0, 1.0], 2: [5.0, 0.0]}


def test_flight_days(spark):
    found = spark.createDataFrame([(13.0, 0.5), (12.0, 0.0), (20.0, 1.0), (None, 0.0)], "t double, r double").select(C.flight_day(F.col("t"), F.col("r")).alias("x")).collect()
    assert [r.x for r in found] == [1.0, 0.0, 0.0, 0.0]


def test_empty_tables(spark):
    empty = panel(spark, [])
    assert history.model_table(empty).count() == 0 and periods.aggregated(empty).count() == 0
    assert audit.frame_audit(empty).first().n_rows == 0 and extremes.class_balance(empty.withColumn("target", F.col("level")), (1,)).first().positives == 0


def test_framings_share_their_fits(spark, monkeypatch):
    """Three framings from one classifier and two regressors a fold, equal to each alone; all rows extreme is no error."""
    day = date(2020, 1, 1)
    rows = spark.createDataFrame([(1, day + timedelta(days=k), float(k % 9), float((k % 9 - 4) * 8 + k % 5)) for k in range(240)], "entity_id long, obs_date date, level double, target double").coalesce(1)
    train, test = rows.where("obs_date < '2020-07-01'"), rows.where("obs_date >= '2020-07-01'")
    small = {"numTrees": 5, "maxDepth": 3}
    made, regressor, classifier = [], M.regressor, M.classifier
    monkeypatch.setattr(M, "regressor", lambda *a: made.append("r") or regressor(*a, **small))
    monkeypatch.setattr(M, "classifier", lambda *a: made.append("c") or classifier(*a, **small))
    together = M.two_stages(["level"], F.abs("target") > 15)
    found = together(train, test).orderBy("obs_date").select(*together.framings.values()).collect()
    assert sorted(made) == ["c", "r", "r"]
    alone = [M.two_stage(["level"], F.abs("target") > 15), M.two_stage(["level"], F.abs("target") > 15, blend=True), M.two_stage(["level"], F.abs("target") > 15, oracle=True)]
    for k, one in enumerate(alone):
        assert [r[k] for r in found] == [r.y_pred for r in one(train, test).orderBy("obs_date").collect()]
    folds = [B.Fold("f", date(2020, 7, 1), date(2020, 9, 1))]
    assert {r.rule: r.n for r in M.out_of_folds(rows, folds, {"x": together}).groupBy("rule").agg(F.count("y_pred").alias("n")).collect()} == dict.fromkeys(together.framings, test.count())
    assert M.two_stage(["level"], F.abs("target") >= 0)(train, test).where("y_pred is not null").count() == test.count()


def test_two_stage_and_gates_fit(spark):
    rows = [(e, date(2024, 1 + d // 28, 1 + d % 28), float((d * 7 + e) % 11), float((d * 5) % 9) * (10 if d % 6 == 0 else 1)) for e in range(4) for d in range(80)]
    frame = panel(spark, rows, "entity_id long, obs_date date, level double, target double")
    train, test = frame.where("obs_date < date'2024-03-01'"), frame.where("obs_date >= date'2024-03-01'")
    for make in (M.two_stage(["level"], F.abs("target") > 20), M.season_gated(["level"], "season", least=20), M.normalised_two_stage(["level"], 2.0)):
        assert make(train, test).where("y_pred is null").count() == 0


def test_fixed_width_and_json(spark):
    line = "ABC00000001  47.1000    8.20000" + " " * 11 + "NAME OF PLACE"
    found = payloads.fixed_width(spark.createDataFrame([(line,), ("short",)], "value string"), payloads.STATION).collect()
    assert found[0].station == "ABC00000001" and found[0].latitude == 47.1 and found[1].latitude is None
    text = '{"daily": {"time": ["2024-01-01", "2024-01-02"], "t": [1.5, null]}}'
    rows = payloads.columnar(spark.createDataFrame([(text,), ("{bad",)], "value string"), "value", {"time": "string", "t": "double"}).collect()
    assert [(r.time, r.t) for r in rows] == [("2024-01-01", 1.5), ("2024-01-02", None)]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "years/2019_d").mkdir(parents=True)
    (tmp_path / "years/2019_d/7.csv").write_text("time,weight\n2019-01-01,NA\n2019-01-02,3.5\n")
    (tmp_path / "years/2019_d/8.csv").write_text("time,weight,extra\n2019-01-01,2,x\n")
    raw = readers.csv_text(spark, str(tmp_path))
    found = readers.of_grain(raw, "d", "filename").select(C.entity_of_path("filename").alias("e"), C.number("weight").alias("w"), "extra")
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(7, None, None), (7, 3.5, None), (8, 2.0, "x")], key=str)
    frame = panel(spark, days([3.0, 1.0, 2.0]))
    sinks.parquet(frame, str(tmp_path / "out"), ["entity_id", "obs_date"])
    assert readers.model_table(spark, str(tmp_path / "out"), rows=3, entities=1).count() == 3
    assert sinks.csv(frame, str(tmp_path / "csv")).endswith("3 rows")
    assert readers.files(spark, str(tmp_path / "years"), "*.csv").count() == 2
    with pytest.raises(ValueError, match="repeated key"):
        audit.assert_unique(frame.unionByName(frame), ["entity_id", "obs_date"])


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "2024-01-01 01:00:00", 2.0, None, 2.0), (1, "2024-01-01 05:00:00", None, 1.0, 3.0), (1, "2024-01-09 00:00:00", 9.0, 1.0, 9.0)]
    readings = spark.createDataFrame(rows, "entity_id long, t string, level double, sensor double, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    readings.write.parquet(str(tmp_path / "in"))
    stream = stream_days(spark.readStream.schema(readings.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("stream_days").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = spark.sql("select obs_date, last_level, n_readings from stream_days").collect()
    assert [(r.obs_date, r.last_level, r.n_readings) for r in found] == [(date(2024, 1, 1), 2.0, 2)]
