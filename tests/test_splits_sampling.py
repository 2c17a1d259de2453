"""Splits, folds, samples, cross-market views."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.functions.clock import MINUTE, months_before
from barlab.operators import cross
from barlab.operators import features as feat
from barlab.operators import sampling as samp
from barlab.operators import segments as seg
from barlab.operators import splits as spl
from tests.conftest import START

PURGE = timedelta(minutes=75)
MARKS = [datetime(y, m, 23) for y in range(2022, 2027) for m in (3, 9)][1:]


def test_clock_boundaries_and_purge(spark):
    b = spl.clock_boundaries(START, START + timedelta(days=10), PURGE)
    assert b.first == START + timedelta(days=7) and b.second == START + timedelta(days=8, hours=12)
    offsets = (-76, -74, -1, 1, 74, 76)
    rows = [(edge + timedelta(minutes=o),) for edge in (b.first, b.second) for o in offsets]
    got = [r["split"] for r in spl.assign_split(spark.createDataFrame(rows, "ts timestamp"), b).orderBy("ts").collect()]
    assert got == ["train", None, None, None, None, "validation", "validation", None, None, None, None, "test"]


def test_split_violations_are_found(spark):
    b = spl.clock_boundaries(START, START + timedelta(days=10), PURGE)
    ok = spl.assign_split(spark.createDataFrame([(START,), (b.second + PURGE,)], "ts timestamp"), b)
    assert spl.split_violations(ok, b).isEmpty()
    bad = ok.unionByName(ok.limit(1).withColumn("split", F.lit("test")))
    assert spl.split_violations(bad, b).count() == 1


def test_fractions_must_leave_a_test_period():
    with pytest.raises(ValueError):
        spl.clock_boundaries(START, START + timedelta(days=1), PURGE, 0.9, 0.1)


def test_folds_expand_without_overlap():
    folds = spl.walk_forward_folds(datetime(2021, 9, 23), MARKS, PURGE)
    assert len(folds) == 8
    for f in folds:
        assert f.evaluation_start - f.train_end == timedelta(minutes=150)
    for a, b in zip(folds, folds[1:]):
        assert a.evaluation_end <= b.evaluation_start and a.train_end < b.train_end


@pytest.mark.parametrize("marks", [MARKS[:1], MARKS[::-1], [MARKS[0], MARKS[0]], [datetime(2020, 1, 1), MARKS[0]]])
def test_bad_fold_boundaries_are_refused(marks):
    with pytest.raises(ValueError):
        spl.walk_forward_folds(datetime(2021, 9, 23), marks, PURGE)


def test_fold_declaration_counts(spark):
    folds = spl.walk_forward_folds(START, [START + timedelta(hours=h) for h in (10, 20, 30)], PURGE)
    rows = [(r, START + timedelta(minutes=m)) for r in "AB" for m in range(0, 1800, 3 if r == "A" else 7)]
    df = spark.createDataFrame(rows, "root string, ts timestamp")
    got = {(r["fold"], r["root"]): r for r in spl.fold_declaration(df, folds, 150).collect()}
    for f in folds:
        for root in "AB":
            train = sum(1 for r, t in rows if r == root and f.train_start <= t < f.train_end)
            held = sum(1 for r, t in rows if r == root and f.evaluation_start <= t < f.evaluation_end)
            assert got[(f.fold, root)]["eligible_training_rows"] == train
            assert got[(f.fold, root)]["selected_training_rows"] == min(150, train)
            assert got[(f.fold, root)]["eligible_evaluation_rows"] == held
        both = [got[(f.fold, r)]["selected_training_rows"] for r in "AB"]
        assert got[(f.fold, "ALL")]["selected_training_rows"] == sum(both)
    assert spl.with_evaluation_folds(df, folds).groupBy("root", "ts").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("rows,cap", [(10, 4), (100, 7), (999, 500), (50, 50), (50, 49), (5, 9), (30, 1), (2000, 1999)])
def test_even_sample_positions(spark, rows, cap):
    data = [("r", START + timedelta(minutes=m), m) for m in range(rows)]
    df = spark.createDataFrame(data, "root string, ts timestamp, v int")
    got = sorted(r["v"] for r in samp.even_sample(df, cap, MINUTE, tile_units=16).collect())
    want = list(range(rows)) if rows <= cap else np.linspace(0, rows - 1, cap, dtype=np.int64).tolist()
    assert got == want


def test_samples_of_several_caps_and_every_nth(spark):
    data = [(r, START + timedelta(minutes=m), m) for r in "AB" for m in range(40)]
    df = spark.createDataFrame(data, "root string, ts timestamp, v int")
    counts = {(r["cap"], r["root"]): r["count"] for r in samp.even_samples(df, (5, 100), MINUTE, tile_units=8).groupBy("cap", "root").count().collect()}
    assert counts == {(5, "A"): 5, (5, "B"): 5, (100, "A"): 40, (100, "B"): 40}
    nth = samp.every_nth(df, 15, MINUTE, tile_units=8).where("root = 'A'")
    assert sorted(r["v"] for r in nth.collect()) == [0, 15, 30]
    pooled = sorted(r["position"] for r in samp.pooled_even_sample(df, 9, MINUTE, tile_units=8).collect())
    assert pooled == np.linspace(0, 79, 9, dtype=np.int64).tolist()


def test_fingerprint_depends_on_rows_only(bars):
    df = seg.add_contract_segments(bars(range(50)), MINUTE, 8)
    one = samp.row_fingerprint(df, MINUTE, tile_units=8).first()
    again = samp.row_fingerprint(df.repartition(5), MINUTE, tile_units=8).first()
    other = samp.row_fingerprint(df.where("segment_row <> 20"), MINUTE, tile_units=8).first()
    assert one["rows"] == 50 and one == again and one["fingerprint"] != other["fingerprint"]


def test_identity_differences(bars):
    a, b = bars(range(5)), bars(range(1, 5))
    assert samp.identity_differences(a, a).isEmpty()
    assert samp.identity_differences(a, b).count() == 1


def test_anchor_join_is_exact_not_as_of(bars):
    anchors = ("ES", "NQ")
    two = bars([0, 1, 2], root="ES").unionByName(bars([0, 1, 2, 3], root="ZN"))
    returns = feat.add_exact_returns(seg.add_contract_segments(two, MINUTE), MINUTE, (1, 5, 15))
    wide = cross.add_cross_market(returns, cross.anchor_table(returns, MINUTE, anchors))
    rows = {r["ts"]: r for r in wide.where("root = 'ZN'").collect()}
    assert rows[START + timedelta(minutes=2)]["ES_return_1m"] is not None
    assert rows[START + timedelta(minutes=3)]["ES_return_1m"] is None
    assert rows[START + timedelta(minutes=2)]["NQ_return_1m"] is None
    relative = cross.add_relative_returns(wide, MINUTE, anchors).where("root = 'ES'")
    at = {r["ts"]: r["relative_to_ES_return_1m"] for r in relative.collect()}
    assert at[START + timedelta(minutes=1)] == 0.0 and at[START] is None


def test_experiment_widths_and_label_guard():
    anchors = ("NQ", "ES", "ZN", "CL", "GC", "6E")
    sizes = [len(cross.experiment_features(e, MINUTE, anchors)) for e in "ABC"]
    assert sizes == [35, 53, 53]
    with pytest.raises(ValueError):
        cross.experiment_features("D", MINUTE, anchors)
    with pytest.raises(ValueError):
        cross.check_feature_columns(["volume", "future_return_1m"], MINUTE)


def test_rows_around_a_roll(bars):
    df = seg.add_contract_segments(bars(range(10), [1] * 4 + [2] * 6), MINUTE, 3)
    got = sorted((r["roll_segment"], r["offset"]) for r in samp.around_rolls(df, 2).collect())
    assert got == [(2, -2), (2, -1), (2, 0), (2, 1), (2, 2)]


def test_rows_around_a_roll_cross_short_segments(bars):
    df = seg.add_contract_segments(bars(range(11), [1, 1, 1, 1, 2, 2, 3, 3, 3, 4, 4]), MINUTE, 3)
    rows = samp.around_rolls(df.unionByName(seg.add_contract_segments(bars(range(2), root="ES"), MINUTE, 3)), 3).collect()
    got = {}
    for r in rows:
        got.setdefault(r["roll_segment"], []).append((r["offset"], (r["ts"] - START).seconds // 60))
    starts = {2: 4, 3: 6, 4: 9}
    assert {k: sorted(v) for k, v in got.items()} == {
        k: [(d, s + d) for d in range(-3, 4) if 0 <= s + d < 11] for k, s in starts.items()
    }


def test_month_clamp():
    assert months_before(datetime(2024, 5, 31).date(), 3).isoformat() == "2024-02-29"
