"""Commits and writers, rebuilt roots, frozen models, lineage, ordered identity, merged metrics and stable parts."""

import hashlib
import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.functions.clock import MINUTE
from barlab.operators import frozen as fro
from barlab.operators import lineage
from barlab.operators import linear as lin
from barlab.operators import metrics as met
from barlab.operators import profile as prof
from barlab.operators import prospective as pro
from barlab.operators import ranks
from barlab.operators import sampling as samp
from barlab.operators import segments as seg
from barlab.operators import splits as spl
from barlab.session import materialise
from barlab.sources import dataset, eventlog
from barlab.sources.commits import Commits

START = datetime(2024, 1, 30, 22)
LOG = (
    "ts timestamp, root string, instrument_id bigint, contract_segment_id bigint, model_id string, event_type string, "
    "prediction double, y double, data_version string, recorded_at_utc timestamp"
)


def events(spark, minutes, model="m"):
    rows = [(START + timedelta(minutes=m), "R", 1, 1, model, pro.PREDICTION, float(m), None, "v", START) for m in minutes]
    return spark.createDataFrame(rows, LOG)


def test_a_commit_number_is_taken_once(spark, tmp_path):
    commits = Commits(spark, str(tmp_path / "c"))
    assert commits.latest() == (0, {})
    assert commits.commit(1, {"a": 1}) and not commits.commit(1, {"a": 2})
    (tmp_path / "c" / "_commits" / "000000000002.json").write_text("")  # a writer that is not done
    assert commits.latest() == (1, {"a": 1}) and not commits.commit(2, {}) and commits.commit(3, {"a": 3})
    assert commits.latest() == (3, {"a": 3})


def test_two_writers_log_every_key_once(spark, tmp_path):
    path = str(tmp_path / "log")
    batches = [events(spark, range(0, 200, 2)), events(spark, range(0, 200, 5)), events(spark, range(150, 4000, 7))]
    with ThreadPoolExecutor(3) as pool:
        added = list(pool.map(lambda b: eventlog.append_unique_events(b, path), batches))
    keys = {*range(0, 200, 2), *range(0, 200, 5), *range(150, 4000, 7)}
    log = eventlog.read_event_log(spark, path, batches[0].schema)
    assert sorted(r.prediction for r in log.collect()) == sorted(map(float, keys)) and sum(added) == len(keys)
    assert all(eventlog.append_unique_events(b, path) == 0 for b in batches)
    number, record = Commits(spark, path).latest()
    assert number == 3 and record["events"] == len(keys) and len(record["folders"]) == 3


def test_a_writer_that_comes_second_looks_again(spark, tmp_path, monkeypatch):
    path, late = str(tmp_path / "log"), []
    commit = Commits.commit

    def overtaken(self, number, record):
        if not late:
            late.append(1)
            eventlog.append_unique_events(events(spark, [1, 2]), path)
        return commit(self, number, record)

    monkeypatch.setattr(Commits, "commit", overtaken)
    assert eventlog.append_unique_events(events(spark, [2, 3]), path) == 1
    log = eventlog.read_event_log(spark, path, events(spark, []).schema)
    assert sorted(r.prediction for r in log.collect()) == [1.0, 2.0, 3.0]
    assert len(list((tmp_path / "log" / "parts").iterdir())) == 2


def test_only_the_months_of_a_batch_are_read(spark, tmp_path):
    path = str(tmp_path / "log")
    eventlog.append_unique_events(events(spark, [0, 200, 60_000]), path)
    near = eventlog.events_in_range(events(spark, [0, 10]), path, events(spark, []).schema)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_month" in plan and near.count() == 1
    assert {p.name for p in (tmp_path / "log" / "parts").glob("*/event_month=*")} == {
        "event_month=2024-01-01", "event_month=2024-03-01"
    }


def segmented(spark, minutes, root="NQ", change=5):
    rows = [
        (START + timedelta(minutes=m), root, 1 + (m > change), 1.0 + m, 2.0 + m, 0.5 + m, 1.5 + m, 3.0) for m in minutes
    ]
    bars = spark.createDataFrame(
        rows, "ts timestamp, root string, instrument_id bigint, open double, high double, low double, close double, volume double"
    )
    return seg.add_contract_segments(bars, MINUTE, 8)


def expected_of(rows):
    return materialise(rows.groupBy("root").agg(
        F.count(F.lit(1)).alias("expected_rows"), F.count_if("roll_event").alias("expected_rolls")
    ))


def test_rebuilding_switches_only_complete_roots(spark, tmp_path):
    path = str(tmp_path / "data")
    good = materialise(segmented(spark, range(12)).unionByName(segmented(spark, range(20), "ES")))
    assert dataset.read_committed(spark, path) is None
    first = dataset.rebuild_roots(spark, path, good, expected_of(good))
    assert {r.root: (r.stored_rows, r.rebuilt) for r in first.collect()} == {"NQ": (12, True), "ES": (20, True)}
    dataset.commit_roots(spark, path, good.where("root = 'ES'").limit(5))
    before = Commits(spark, path).latest()
    # a source with another number of rolls stops before the switch
    wrong = materialise(segmented(spark, range(20), "ES", change=99).unionByName(good.where("root = 'NQ'")))
    with pytest.raises(RuntimeError, match="not committed"):
        dataset.rebuild_roots(spark, path, wrong, expected_of(good))
    assert Commits(spark, path).latest() == before
    assert dataset.read_committed(spark, path).where("root = 'ES'").count() == 5
    again = dataset.rebuild_roots(spark, path, good, expected_of(good))
    assert {r.root: (r.stored_rows, r.rebuilt) for r in again.collect()} == {"NQ": (12, False), "ES": (20, True)}
    nothing = dataset.rebuild_roots(spark, path, good, expected_of(good)).where("rebuilt").count()
    assert nothing == 0 and dataset.read_committed(spark, path).count() == 32


def test_years_of_time_bounds_prune_partitions(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = spark.createDataFrame([(datetime(y, 6, 1), "A", y) for y in range(2000, 2010)], "ts timestamp, root string, v int")
    dataset.write_dataset(rows, path)
    found = dataset.read_between(spark, path, datetime(2003, 1, 1), datetime(2005, 1, 1), ["A"])
    assert sorted(r.v for r in found.collect()) == [2003, 2004]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "year" in plan[plan.index("PartitionFilters"):].split("]")[0] and found.inputFiles()
    assert not any("year=2005" in f for f in found._jdf.queryExecution().executedPlan().toString().split())


def test_swapped_rows_are_found_by_position(spark):
    rows = [("A", i, START + timedelta(minutes=m)) for i, m in enumerate([1, 2, 2, 5])] + [("B", 0, START)]
    left = spark.createDataFrame(rows, "root string, position int, ts timestamp")
    swapped = [rows[0], ("A", 1, rows[3][2]), rows[2], ("A", 3, rows[1][2])]
    right = spark.createDataFrame(swapped, left.schema)
    assert samp.ordered_differences(left, left).isEmpty()
    assert sorted(map(tuple, samp.ordered_differences(left, right).collect())) == [("A", 1), ("A", 3), ("B", 0)]
    assert samp.identity_differences(left.where("root = 'A'"), right).isEmpty()


def test_row_digest_is_the_stream_of_identity_lines(spark):
    times = [START + timedelta(microseconds=x) for x in (0, 1000, 1, 60_000_000, 1_500_000)]
    rows = [(t, r, 7, 2) for t in times for r in ("A", "B")]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "ts timestamp, root string, instrument_id bigint, contract_segment_id bigint").repartition(3)
    got = {r.root: (r.rows, r.digest) for r in samp.selected_row_digest(df).collect()}
    for root in ("A", "B"):
        digest = hashlib.sha256()
        for t in sorted(times):
            digest.update("\x1f".join([t.isoformat(timespec="auto" if t.microsecond % 1000 else "milliseconds" if t.microsecond else "seconds") + "+00:00", root, "7", "2"]).encode() + b"\n")
        assert got[root] == (5, digest.hexdigest())


def test_frozen_models_are_written_once_and_scored_by_their_root(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(START + timedelta(minutes=i), str(rng.choice(["A", "B"])), 1, 1, float(rng.normal()), None if i % 9 == 0 else float(rng.normal())) for i in range(300)]
    rows = [(*r, r[4] * (1 if r[1] == "A" else -2) + (r[5] or 0.0)) for r in rows]
    df = materialise(spark.createDataFrame(rows, "ts timestamp, root string, instrument_id bigint, contract_segment_id bigint, x double, z double, y double"))
    stats = lin.fold_statistics(df, ("x", "z"), "y")
    digests = samp.selected_row_digest(df)
    features = {"A": ("x",), "B": ("z", "x")}
    tables = [fro.frozen_table(lin.fit_per_root(stats, f), f, e, START + timedelta(days=1), digests) for e, f in features.items()]
    path = str(tmp_path / "models")
    fro.freeze(tables[0].unionByName(tables[1]), path)
    with pytest.raises(Exception, match="exists"):
        fro.freeze(tables[0], path)
    frozen = fro.read_frozen(spark, path)
    assert frozen.columns == list(fro.FROZEN) and frozen.count() == 6
    assert {r.row_digest for r in frozen.collect()} == {r.digest for r in digests.collect()}
    scored = fro.score_frozen(df, frozen, features)
    direct = lin.score_linear(df.withColumn("fold", F.lit("all")), features["B"], lin.fit_per_root(stats, features["B"]), on=("fold", "root"))
    got = {r.ts: r.prediction for r in scored.where("model_id like '%-B-final'").collect()}
    assert got == pytest.approx({r.ts: r.prediction for r in direct.collect()})
    done = scored.withColumn("event_type", F.lit(pro.OUTCOME))
    windows = pro.checkpoint_windows(df, START, [0, 1])
    table = fro.window_deltas(done, windows, "y", metrics=("rmse",)).collect()
    assert {(r.days, r.root) for r in table} == {(0, "A"), (0, "B")}
    assert all(r.rmse_delta < 0 for r in table)


def test_lineage_follows_values_through_windows_unions_and_joins(spark):
    base = materialise(spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "k int, a double, b double, c double"))
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("c")
    one = base.withColumn("s", F.sum(F.col("a") * 2).over(w)).withColumn("t", F.col("s") - F.col("b"))
    both = one.select("k", "t").unionByName(one.select("k", F.col("c").alias("t")))
    joined = base.join(both, "k").withColumn("e", F.explode(F.array("t", "b"))).groupBy("k").agg(F.max("e").alias("m"), F.count("a").alias("n"))
    own = lineage.source_columns(joined, ["k", "m", "n"], ["a", "b", "c"])
    assert own == {"k": [], "m": ["a", "b", "c"], "n": ["a"]}
    assert lineage.source_columns(one, ["s", "t"], ["a", "b", "c"]) == {"s": ["a"], "t": ["a", "b"]}


def test_merged_moments_equal_those_of_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(str(rng.choice(list("abc"))), float(rng.normal() + 5), float(rng.normal() * 3)) for _ in range(400)]
    rows += [("d", None, 1.0), ("d", 2.0, float("nan")), ("e", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "root string, a double, p double").repartition(5)
    whole = met.regression_metrics(df, [], "a", "p").first()
    scoped = {r.scope: r for r in met.evaluate(df, [], "a", "p").collect()}
    assert set(scoped) == set("abcde") | {"ALL"}
    for name in ("observations", "mae", "rmse", "r2", "pearson", "direction_accuracy", "spearman"):
        assert scoped["ALL"][name] == pytest.approx(whole[name], rel=1e-9)
    own = np.array([r[1:] for r in rows if r[0] == "a"])
    assert scoped["a"].pearson == pytest.approx(np.corrcoef(own.T)[0, 1]) and scoped["d"].observations == 0
    assert scoped["d"].r2 is None and scoped["e"].r2 is None and scoped["e"].mae == 0


def test_few_rows_have_empty_deciles(spark):
    rows = [("a", START + timedelta(minutes=i), float(i), float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "root string, ts timestamp, y double, prediction double")
    table = met.prediction_deciles(df, ["root"], "y", "prediction", MINUTE)
    got = {r.decile: (r.observations, r.mean_actual) for r in table.collect()}
    assert got == {d: (1, float(d - 1)) if d <= 4 else (0, None) for d in range(1, 11)}
    summary = met.decile_summary(table, ["root"]).first()
    assert summary.decile_order_spearman == pytest.approx(1.0) and summary.top_decile_mean_actual is None


@pytest.mark.parametrize("bound", [200_000, 0])
def test_ranks_do_not_rest_on_the_order_of_rows(spark, monkeypatch, bound):
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", bound)
    rng = np.random.default_rng(6)
    rows = [("g", float(x)) for x in rng.choice([0.0, 0.0, 0.0, 1.0, 2.5, 7.0], 500)]
    df = spark.createDataFrame(rows, "k string, v double")
    answers = []
    for n in (1, 5):
        stored = materialise(ranks.with_part(df.repartition(n)))
        ranked = ranks.add_average_ranks(stored, ["k"], {"v": "r"}, splits=64)
        picked = ranks.quantiles(stored, ["k"], "v", nearest={"q": 0.3}, linear={"m": 0.5}, splits=64)
        answers.append((sorted((r.v, r.r) for r in ranked.collect()), picked.collect()))
    assert answers[0] == answers[1] and len(answers[0][0]) == 500
    plan = ranks.add_average_ranks(stored, ["k"], {"v": "r"}, splits=64)._jdf.queryExecution().executedPlan().toString()
    assert "monotonically_increasing_id" not in plan


def test_declared_folds_are_held_against_their_rules(spark):
    purge = timedelta(hours=1)
    folds = spl.walk_forward_folds(START, [START + timedelta(days=d) for d in (2, 4, 6)], purge)
    assert spl.fold_violations(spl.fold_table(spark, folds), purge).isEmpty()
    worse = [folds[0], spl.Fold("late", START, folds[0].train_end, folds[0].evaluation_start - purge, START)]
    found = {(r.fold, r.problem) for r in spl.fold_violations(spl.fold_table(spark, worse), purge).collect()}
    assert {("late", "purge"), ("late", "no evaluation rows")} <= found
    with pytest.raises(ValueError):
        spl.walk_forward_folds(START, [START + purge, START + timedelta(days=1)], purge)


def test_drift_meets_every_window_without_a_product(spark):
    history = spark.createDataFrame([("x", 1.0, 2.0, 0.0), ("y", 0.0, 0.0, 0.5)], "feature string, median double, iqr double, missing_rate double")
    recent = spark.createDataFrame([(7, "x", 2.0, 2.0, 0.0), (30, "x", 5.0, 2.0, 0.0)], "days int, feature string, median double, iqr double, missing_rate double")
    table = prof.drift_profile(history, recent, [], ["days"])
    got = {(r.days, r.feature): r.median_shift_in_historical_iqr for r in table.collect()}
    assert got == {(7, "x"): 0.5, (30, "x"): 2.0, (7, "y"): None, (30, "y"): None}
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert prof.drift_profile(history, recent.limit(0), [], ["days"]).count() == 0
