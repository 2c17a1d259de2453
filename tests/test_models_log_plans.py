"""Ridge, importance, event log, checkpoints, sources and plans."""

import json
import os
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barlab.functions.clock import DAY, MINUTE
from barlab.operators import models as mod
from barlab.operators.boosting import Boosting
from barlab.operators import prospective as pro
from barlab.operators import quality as qual
from barlab.operators.profile import distribution_profile, tertiles
from barlab.plans import requests as plan
from barlab.sources import dataset, eventlog, manifest
from barlab.streaming.log_stream import follow_features
from tests.conftest import START

FEATURES = ("x", "z")
SF = "/root/testdata/sf0.001"


def ridge_rows(spark, n=60):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        x = None if i % 11 == 3 else float(rng.normal())
        z = float(rng.normal())
        rows.append(("NQ" if i % 2 else "ES", START + timedelta(minutes=i), x, z, (x or 0) - 2 * z + rng.normal() / 10))
    return rows, spark.createDataFrame(rows, "root string, ts timestamp, x double, z double, y double")


def closed_form(rows, alpha=1.0):
    x = np.array([np.nan if r[2] is None else r[2] for r in rows])
    z = np.array([r[3] for r in rows])
    y = np.array([r[4] for r in rows])
    x = np.where(np.isnan(x), np.nanmedian(x), x)
    cols = [(v - v.mean()) / v.std() for v in (x, z)]
    cols += [np.array([float(r[0] == root) for r in rows]) for root in ("ES", "NQ")]
    d = np.column_stack([np.ones(len(rows)), *cols])
    penalty = np.eye(d.shape[1]) * alpha
    penalty[0, 0] = 0
    return np.linalg.solve(d.T @ d + penalty, d.T @ y), d


def test_ridge_equals_the_closed_form(spark):
    rows, df = ridge_rows(spark)
    want, design = closed_form(rows)
    model = mod.fit_ridge(df.repartition(5), FEATURES, "y")
    got = [model.intercept, *model.weights().values()]
    assert got == pytest.approx(list(want), rel=1e-10)
    predicted = [r["prediction"] for r in model.transform(df).orderBy("ts").collect()]
    assert predicted == pytest.approx(list(design @ want), rel=1e-10)
    assert model.training_rows == len(rows)
    prep = mod.fit_preprocessor(df, FEATURES)
    ml = mod.ridge_by_ml(df, prep, "y").transform(mod.assemble(df, prep, True))
    assert [r["prediction"] for r in ml.orderBy("ts").collect()] == pytest.approx(predicted, rel=1e-8)


def test_medians_come_from_training_rows_only(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("A", None)], "root string, x double")
    prep = mod.fit_preprocessor(df, ["x"])
    assert prep.medians == {"x": 1.5}
    held = spark.createDataFrame([("B", None), ("B", 100.0)], "root string, x double")
    assert [r["v"] for r in held.select(prep.imputed("x").alias("v")).collect()] == [1.5, 100.0]
    assert [r["v"] for r in held.select(prep.is_root("A").alias("v")).collect()] == [0.0, 0.0]


def test_trees_and_score(spark):
    rows, df = ridge_rows(spark, 200)
    trees = mod.fit_trees(df, FEATURES, "y", rounds=3, leaves=4, leaf_rows=5)
    scored = mod.score(df, {"trees": trees.transform, "zero": lambda d: d.withColumn("prediction", F.lit(0.0))})
    assert scored.count() == 400 and set(scored.columns) == {*df.columns, "model", "prediction"}
    errors = {r["model"]: r["e"] for r in scored.groupBy("model").agg(F.avg((F.col("y") - F.col("prediction")) ** 2).alias("e")).collect()}
    assert errors["trees"] < errors["zero"]


SHORT_TREES = {"rounds": 2, "leaves": 3}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name, fits", [("tree_evaluation", 1), ("training_size_study", 3)])
def test_registered_tree_queries_ask_for_the_full_baseline(spark, monkeypatch, name, fits):
    asked, fit = [], mod.fit_trees

    def short(*args, **given):
        asked.append(replace(Boosting(), **{k: v for k, v in given.items() if k != "include_root"}))
        return fit(*args, **{**given, **SHORT_TREES})

    monkeypatch.setattr(mod, "fit_trees", short)
    entry.queries()[name](spark, SF)
    assert asked == [Boosting()] * fits
    assert (asked[0].rounds, asked[0].leaves, asked[0].leaf_rows, asked[0].l2, asked[0].rate) == (150, 31, 100, 0.1, 0.08)


def test_root_one_hot_has_no_column_for_unknown_roots(spark):
    df = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("B", 3.0)], "root string, x double")
    fitted = mod.root_pipeline(["x"]).fit(df)
    out = fitted.transform(spark.createDataFrame([("Z", 5.0), ("A", 1.0)], df.schema)).collect()
    assert list(out[0]["features"].toArray()) == [5.0, 0.0, 0.0]
    assert sum(out[1]["features"].toArray()[1:]) == 1.0


def test_permuting_the_strong_feature_hurts_most(spark):
    _, df = ridge_rows(spark, 120)
    model = mod.fit_ridge(df, FEATURES, "y")
    table = mod.permutation_importance(df, FEATURES, "y", model.transform, MINUTE, repeats=2, tile_units=32).collect()
    assert [r["feature"] for r in table] == ["z", "x"]
    assert table[0]["mean_r2_decrease"] > table[1]["mean_r2_decrease"] > 0


# --- event log ---------------------------------------------------------------------------------

TARGET = "future_return_1m"
CUTOFF = START
SCHEMA = "ts timestamp, root string, instrument_id bigint, contract_segment_id bigint, f double, " \
         f"{TARGET} double, rolling_vwap_240m double"


def source(spark, minutes):
    rows = [(START + timedelta(minutes=m), "ZN", 101, 7, 0.5, 0.9 if m % 2 else None, 1.0) for m in minutes]
    return spark.createDataFrame(rows, SCHEMA)


def moment(m):
    return F.lit((START + timedelta(minutes=m)).isoformat(sep=" ")).cast("timestamp_ntz").cast("timestamp")


def events_of(df):
    inputs = pro.prospective_inputs(df, MINUTE, moment(0), ["f"])
    assert TARGET not in inputs.columns
    return pro.prediction_events(inputs.withColumn("prediction", F.col("f")), F.lit("ZN-A"), TARGET, "v1", moment(99))


def test_cutoff_row_is_on_neither_side(spark):
    df = source(spark, [-1, 0, 1])
    assert df.where(qual.before_cutoff(MINUTE, TARGET, moment(0))).count() == 1
    assert [r["ts"] for r in df.where(qual.after_cutoff(moment(0))).collect()] == [START + timedelta(minutes=1)]


def test_predicting_with_the_label_in_sight_is_refused(spark):
    df = source(spark, [1]).withColumn("prediction", F.lit(0.0))
    with pytest.raises(ValueError):
        pro.prediction_events(df, F.lit("m"), TARGET, "v1", moment(1))


def test_log_is_append_only_and_idempotent(spark, tmp_path):
    path = str(tmp_path / "log")
    events = events_of(source(spark, range(-2, 6)))
    assert eventlog.append_unique_events(events, path) == 5
    before = {p.name for p in (tmp_path / "log").rglob("*.parquet")}
    assert eventlog.append_unique_events(events, path) == 0
    outcomes = pro.prospective_outcomes(source(spark, range(6)), MINUTE, moment(0), TARGET)
    attached = pro.attach_outcomes(eventlog.read_event_log(spark, path, events.schema), outcomes, TARGET, moment(100))
    assert eventlog.append_unique_events(attached, path) == 3
    assert before <= {p.name for p in (tmp_path / "log").rglob("*.parquet")}
    log = eventlog.read_event_log(spark, path, events.schema)
    assert log.count() == 8
    assert {r[TARGET] for r in log.where("event_type = 'outcome'").collect()} == {0.9}
    assert log.where(f"event_type = 'prediction' and {TARGET} is not null").isEmpty()


def test_drift_is_told_per_model_root_and_closed_window(spark):
    """Two roots drift against each other, and only after the first window."""
    days = [*range(-8, 0), *range(1, 9)]
    rows = [
        (START + timedelta(days=d), root, 1, 1, float(d % 4 + (sign * 10 if d > 4 else 0)), 0.1 * (d % 3), 1.0)
        for root, sign in (("A", 1), ("B", -1)) for d in days
    ]
    df = spark.createDataFrame(rows, "ts timestamp, root string, instrument_id bigint, contract_segment_id bigint, f double, "
                                     "future_return_1d double, rolling_vwap_240d double")
    past, target = df.where(F.col("ts") < moment(0)), "future_return_1d"
    inputs = pro.prospective_inputs(df, DAY, moment(0), ["f"])
    events = pro.prediction_events(inputs.withColumn("prediction", F.col("f")), F.concat("root", F.lit("-m")), target, "v", moment(0))
    done = pro.attach_outcomes(events, pro.prospective_outcomes(df, DAY, moment(0), target), target, moment(0))
    windows = pro.checkpoint_windows(inputs, START, (5, 99), ("A", "B"))
    out = pro.confirmation_report(
        done, inputs, distribution_profile(past, ["f"], ["root"]), tertiles(past, "f"), target, "f", ["f"], DAY, windows=windows
    ).collect()
    drift = {(r.days, r.model_id, r.metric): r.value for r in out if r.section == "drift"}
    shift = {k[:2]: v for k, v in drift.items() if k[2] == "median_shift_in_historical_iqr"}
    assert set(shift) == {(d, f"{r}-m") for d in (0, 5) for r in "AB"}
    assert shift[5, "A-m"] == shift[5, "B-m"] == 0 and shift[0, "A-m"] > 1 > -1 > shift[0, "B-m"]
    seen = {(r.days, r.model_id): r.value for r in out if (r.section, r.metric) == ("overall", "observations")}
    assert seen == {(0, "A-m"): 8, (0, "B-m"): 8, (5, "A-m"): 4, (5, "B-m"): 4}


def test_repeated_keys_in_a_batch_are_refused(spark, tmp_path):
    events = events_of(source(spark, [1]))
    with pytest.raises(RuntimeError):
        eventlog.append_unique_events(events.unionByName(events), str(tmp_path / "log"))
    outcomes = pro.prospective_outcomes(source(spark, [1, 1]), MINUTE, moment(0), TARGET)
    with pytest.raises(SparkRuntimeException, match="repeat a row identity"):
        pro.attach_outcomes(events, outcomes, TARGET, moment(9)).collect()


def test_stream_adds_each_file_once(spark, tmp_path):
    src, log, progress = (str(tmp_path / n) for n in ("src", "log", "progress"))
    schema = source(spark, [1]).schema

    def run():
        follow_features(spark, src, schema, log, progress, lambda batch, logged: [events_of(batch)])
        return eventlog.read_event_log(spark, log, events_of(source(spark, [1])).schema).count()

    source(spark, [1, 2, 3]).write.parquet(src)
    assert run() == 3
    source(spark, [3, 4]).write.mode("append").parquet(src)
    assert run() == 4
    assert run() == 4


def test_late_outcomes_meet_the_logged_predictions(spark, tmp_path):
    src, log, progress = (str(tmp_path / n) for n in ("src", "log", "progress"))
    schema = source(spark, [1]).schema
    fields = events_of(source(spark, [1])).schema

    def to_events(batch, logged):
        yield events_of(batch)
        outcomes = pro.prospective_outcomes(batch, MINUTE, moment(0), TARGET)
        yield pro.attach_outcomes(logged(outcomes, fields), outcomes, TARGET, moment(100))

    def run():
        follow_features(spark, src, schema, log, progress, to_events)
        return eventlog.read_event_log(spark, log, fields)

    source(spark, [1, 2, 3]).withColumn(TARGET, F.lit(None).cast("double")).write.parquet(src)
    assert run().where("event_type = 'outcome'").isEmpty()
    # the same rows come again with their outcome and a changed feature
    source(spark, [1, 2, 3]).withColumn("f", F.lit(8.0)).write.mode("append").parquet(src)
    rows = run().where("event_type = 'outcome'").collect()
    assert sorted((r["ts"], r["prediction"], r[TARGET]) for r in rows) == [
        (START + timedelta(minutes=m), 0.5, 0.9) for m in (1, 3)
    ]


def test_checkpoint_closes_only_when_all_roots_passed_it(spark):
    rows = [("A", START + timedelta(days=40)), ("B", START + timedelta(days=8))]
    df = spark.createDataFrame(rows, "root string, ts timestamp")
    closed = lambda d, roots: [r["closed"] for r in pro.checkpoint_windows(d, START, (7, 30), roots).orderBy("days").collect()]
    assert closed(df, "AB") == [True, False]
    assert closed(df, "A") == [True, True]
    assert closed(df, "ABC") == [False, False]
    windows = pro.checkpoint_windows(df, START, (7, 30), "AB")
    assert pro.run_status(windows, df, 7).first()["status"] == "primary_checkpoint_ready_for_review"
    empty = df.where("false")
    none = pro.checkpoint_windows(empty, START, (7,), "AB")
    assert pro.run_status(none, empty, 7).first()["status"] == "awaiting_prospective_data"


# --- sources -----------------------------------------------------------------------------------


def test_non_finite_values_are_stored_as_null(spark, bars, tmp_path):
    path = str(tmp_path / "bars")
    odd = bars(range(3)).withColumn(
        "volume", F.when(F.minute("ts") == 0, F.lit(float("nan"))).when(F.minute("ts") == 1, F.lit(float("inf"))).otherwise(2.0)
    )
    dataset.write_dataset(odd, path)
    assert [r["volume"] for r in dataset.read_root(spark, path, "NQ").collect()] == [None, None, 2.0]


def test_ridge_ignores_rows_without_a_target(spark):
    rows, df = ridge_rows(spark)
    more = df.unionByName(df.limit(5).withColumn("y", F.lit(None).cast("double")))
    assert mod.fit_ridge(more, FEATURES, "y").training_rows == len(rows)


def test_dataset_round_trip_and_pruning(spark, bars, tmp_path):
    path = str(tmp_path / "bars")
    df = bars(range(5)).unionByName(bars(range(3), root="ES"))
    dataset.write_dataset(df, path)
    dataset.write_dataset(bars(range(4), root="ES"), path)  # replaces only ES
    assert {r["root"]: r["stored_rows"] for r in dataset.stored_counts(spark, path).collect()} == {"NQ": 5, "ES": 4}
    assert [r["close"] for r in dataset.read_root(spark, path, "ES").collect()] == [100.0, 101.0, 102.0, 103.0]
    with pytest.raises(FileNotFoundError):
        dataset.read_root(spark, path, "ZZ")
    expected = spark.createDataFrame([("NQ", 5), ("ES", 3), ("ZN", 1)], "root string, expected_rows bigint")
    todo = {r["root"] for r in dataset.roots_to_rebuild(expected, dataset.stored_counts(spark, path)).collect()}
    assert todo == {"ES", "ZN"}


def test_manifest_reading(spark, tmp_path):
    payload = {"version": 1, "entries": [{"root": "NQ", "schema": "ohlcv-1m", "n": 2}, {"root": "NQ", "schema": "status", "n": 1}]}
    file = tmp_path / "m.json"
    file.write_text(json.dumps(payload, indent=2))
    assert [r["n"] for r in manifest.manifest_entries(spark, str(file), "ohlcv-1m").collect()] == [2]
    file.write_text(json.dumps({"version": 1}))
    with pytest.raises(ValueError):
        manifest.manifest_entries(spark, str(file))


def test_bar_quality_counts_across_tiles(spark):
    minute = timedelta(minutes=1)
    rows = [
        ("A", START, 1, 0, 5.0, 6.0, 4.0, 5.0, 1.0),
        ("A", START, 1, 1, 5.0, 6.0, 4.0, 5.0, 1.0),  # duplicate
        ("A", START + minute, 2, 2, 5.0, 4.0, 4.0, 5.0, -1.0),  # roll, high below open, negative volume
        ("A", START + timedelta(days=5), 2, 3, 5.0, 6.0, 4.0, 5.0, 1.0),  # long gap
    ]
    df = spark.createDataFrame(
        rows, "root string, ts timestamp, instrument_id bigint, record_no bigint, open double, high double, "
        "low double, close double, volume double")
    for tile in (1, 2, 3, 100):
        r = qual.bar_quality(df, tile=tile).first()
        assert (r["record_count"], r["duplicate_records"], r["roll_transitions"], r["suspicious_gaps"],
                r["invalid_ohlc_rows"], r["negative_volume_rows"]) == (4, 1, 1, 1, 1, 1)


def test_absent_partitions_fail(spark):
    rows = [("A", "bar", "validated", 5), ("A", "def", "validated", 1), ("B", "bar", "validated", 5)]
    df = spark.createDataFrame(rows, "root string, schema string, status string, record_count bigint").selectExpr(
        "*", "cast(null as timestamp) min_timestamp", "cast(null as timestamp) max_timestamp",
        "0L invalid_ohlc_rows", "0L negative_volume_rows", "0L duplicate_records")
    got = {r["scope"]: (r["status"], r["metadata_complete"]) for r in qual.partition_quality(df, "AB", ("bar", "def"), "bar").collect()}
    assert got == {"A": ("PASS", True), "B": ("FAIL", False), "ALL": ("FAIL", False)}


# --- plans -------------------------------------------------------------------------------------


def test_request_plan_size(spark):
    markets = spark.createDataFrame([(f"M{i}",) for i in range(26)], "root string")
    schemas = [plan.SchemaRequest(s, s, 5, s == "definition") for s in ("ohlcv-1s", "definition", "statistics", "status")]
    core = F.col("root").isin(*[f"M{i}" for i in range(6)])
    rows = plan.expand_requests(markets, schemas, datetime(2024, 2, 29).date(), plan.SchemaRequest("mbp-1", "MBP-1", 3), core)
    assert rows.count() == 26 * 4 + 6
    one = rows.where("root = 'M0' and schema = 'definition'").first()
    assert (one["request_symbol"], one["stype_in"], one["start"].isoformat()) == ("M0.FUT", "parent", "2019-02-28")


def test_latest_complete_end(spark):
    df = spark.createDataFrame([("a", datetime(2026, 9, 22, 5)), ("b", datetime(2026, 9, 21, 0))], "schema string, end timestamp")
    today = F.lit("2026-09-23").cast("date")
    assert plan.latest_complete_end(df, ["a", "b"], today).first()[0].isoformat() == "2026-09-21"
    with pytest.raises(Exception, match="availability"):
        plan.latest_complete_end(df, ["a", "b", "c"], today).collect()


def estimates(spark):
    rows = [("base", "B", 10, 1_000, 5.0), ("x", "X", 1, 100, 2.0), ("x", "X", 1, 100, 2.0), ("y", "Y", 1, 50, 7.0)]
    return spark.createDataFrame(
        rows, "part string, category string, estimated_records bigint, estimated_billable_bytes bigint, estimated_cost_usd double")


def test_gates_and_subsets(spark):
    subsets = plan.addon_subsets(estimates(spark), ["x", "y"], 12.0, F.lit(10_000).cast("bigint"))
    got = {r["addon_roots"]: r for r in subsets.collect()}
    assert {k: r["estimated_cost_usd"] for k, r in got.items()} == {"x": 9.0, "y": 12.0, "x+y": 16.0}
    assert {k: r["budget_pass"] for k, r in got.items()} == {"x": True, "y": True, "x+y": False}
    assert got["x"]["expected_working_bytes"] == 3_600 and got["x"]["required_free_bytes"] == 4_500
    assert {r["addon_roots"] for r in plan.largest_fitting(subsets).collect()} == {"x", "y"}


def test_totals_and_scenarios(spark):
    kinds = {r["row_type"]: r["estimated_cost_usd"] for r in plan.cost_totals(estimates(spark)).where("row_type <> 'detail' and category <> 'X' and category <> 'Y'").collect()}
    assert kinds == {"schema_total": 5.0, "grand_total": 16.0}
    grid = plan.scenario_grid(estimates(spark).withColumnRenamed("part", "plan"), ["base"], ["x", "y"])
    assert {r["scenario"]: r["estimated_cost_usd"] for r in grid.collect()} == {"base+x": 9.0, "base+y": 12.0}
