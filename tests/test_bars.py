"""Bars from line items: what is exchanged and sorted, and that every way gives the same bars."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barlab.catalog import bars as cat
from barlab.catalog.bars import bars_li, bars_su, seg_su
from barlab.catalog.metric_queries import metrics_by_supplier
from barlab.catalog.registry import report
from barlab.functions.clock import DAY
from barlab.operators import features as feat
from barlab.operators import labels as lab
from barlab.operators import linear as lin
from barlab.operators import metrics as met
from barlab.operators import models as mod
from barlab.operators import sampling as samp
from barlab.operators import segments as seg
from barlab.session import materialise

LINES = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_returnflag string, l_shipdate timestamp"
)
DAYS = [datetime(1996, 12, 30), datetime(1996, 12, 31, 7), datetime(1997, 1, 1), datetime(1997, 1, 2)]


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Line items with ties of the order key, equal keys but for the price, and nulls."""
    rows = [
        (order, part, 1 + order % 2, line, 2.0 + line, 10.0 + 7 * order % 5 + part, "ANR"[order % 3], day)
        for day in DAYS for order in (9, 4, 5, 11, 4) for line in (2, 1) for part in (3, 8)
    ]
    rows += [
        (4, 3, 1, 1, 4.0, 99.0, "N", DAYS[0]), (None, 3, 1, 1, 4.0, 55.0, "N", DAYS[0]), (1, 1, 2, 1, 4.0, None, "A", DAYS[1]),
        (7, 1, 2, 1, None, 5.0, "R", DAYS[2]), (7, 1, 2, 1, 4.0, 5.0, None, DAYS[2]), (7, 1, None, 1, 4.0, 5.0, "A", DAYS[2]),
        (7, 1, 2, 1, 4.0, 5.0, "A", None), (None, 1, 2, 1, 4.0, 8.0, "A", datetime(2000, 1, 1)),
    ]
    folder = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame(rows, LINES).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sorted_rows(df):
    return sorted(map(repr, df.collect()))


def test_supplier_bars_and_segments_need_one_exchange_and_no_sort_in_between(spark, lines):
    found = seg.add_short_contract_segments(bars_su(spark, lines)).select("root", "ts", "close", "contract_segment_id")
    plan = plan_of(found)
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    combined = bars_su(spark, lines, most_rows=3)  # a root too long to be sorted as it is
    assert plan_of(combined).index("partial_") > plan_of(combined).index("Exchange")
    assert sorted_rows(combined) == sorted_rows(bars_su(spark, lines))


def test_windows_over_short_segments_equal_those_over_blocks(spark, lines):
    bars = materialise(seg.add_short_contract_segments(bars_su(spark, lines)))
    families = [feat.returns(DAY, (1, 5)), lab.labels(DAY, (1,))]
    short = feat.add_short_families(bars, families)
    assert plan_of(short).count("Sort [") == 1
    wide = feat.add_families(bars, families, 5, 1, size=2)
    assert short.columns == wide.columns and sorted_rows(short) == sorted_rows(wide)


@pytest.mark.parametrize("cap", [3, 4, 100])
def test_keys_within_the_cap_are_counted_but_not_ordered(spark, cap):
    rows = [(f"R{i % 2}", datetime(2024, 1, 1 + i), float(i)) for i in range(8)] + [(None, datetime(2024, 1, 1), 0.0)]
    df = materialise(spark.createDataFrame(rows, "root string, ts timestamp, v double"))
    got = mod.training_sample(df, ["root", "ts", "v"], cap, DAY)
    assert sorted_rows(got) == sorted_rows(samp.even_sample(df, cap, DAY).select("root", "ts", "v"))
    assert ("Window" in plan_of(got)) == (cap < 4)


def test_daily_bars_are_combined_without_sorting_the_lines(spark, lines):
    rows = cat._lineitem_rows(spark, lines, F.col("l_returnflag"))
    plain = cat._bars(rows, cat._line_price(), F.sum("l_quantity"), F.struct(*cat._LINE_KEY))
    assert "SortAggregate" in plan_of(plain) and "Sort" not in plan_of(cat._spans(rows))
    found = bars_li(spark, lines)
    assert found.columns == plain.columns and sorted_rows(found) == sorted_rows(plain)
    # the rows that are ordered are those of each bar's first and last order
    assert "lineitem" not in plan_of(found)


def test_a_ridge_looks_for_its_medians_once(spark, monkeypatch):
    looks = []
    for place in (mod, lin):
        look = place.pooled_medians
        monkeypatch.setattr(place, "pooled_medians", lambda *a, look=look: looks.append(1) or look(*a))
    rows = spark.createDataFrame([(f"R{i % 2}", float(i % 7), float(i)) for i in range(40)], "root string, x double, y double")
    assert mod.fit_ridge(rows, ["x"], "y").training_rows == 40
    assert len(looks) == 1


def test_supplier_metrics_exchange_the_lines_once_and_store_nothing(spark, tmp_path):
    rng = random.Random(6)
    start = datetime(1996, 12, 1)
    rows = [  # prices that repeat, so that returns tie; the year's end cuts the segments
        (rng.randrange(10**6), 1, supplier, 1, 1.0, float(rng.choice((8, 9, 10, 12))), "A", start + timedelta(days=day))
        for supplier in (1, 2, 3, None) for day in range(60) for _ in range(2) if rng.random() < 0.7
    ]
    rows += [(1, 1, 1, 1, 1.0, 9.0, "A", None), (1, 1, 7, 1, 1.0, 9.0, "A", start), (2, 1, 8, 1, None, 9.0, "A", None)]
    # the first bar has no outcome, a later one has
    rows += [(1, 1, 9, 1, 1.0, p, "A", start + timedelta(days=d)) for d, p in ((0, 5.0), (5, 6.0), (9, 4.0), (10, 5.0))]
    folder = str(tmp_path)
    spark.createDataFrame(rows, LINES).write.parquet(f"{folder}/lineitem.parquet")
    found = metrics_by_supplier(spark, folder)
    plan = plan_of(found)
    assert plan.count("Exchange") == 1 and "ExistingRDD" not in plan and "Join" not in plan

    bars = lab.add_future_labels(feat.add_exact_returns(seg_su(spark, folder), DAY, (1,)), DAY, (1,))
    scored = met.naive_predictions(bars, "log_return_1d")
    wanted = report(met.regression_metrics(scored, ["model", "root"], "future_return_1d", "prediction"))
    assert found.columns == wanted.columns and sorted_rows(found) == sorted_rows(wanted)
    pairs = {(r["model"], r["root"]): r["observations"] for r in found.collect()}
    assert len(pairs) == 3 * 7 and pairs["zero", "S7"] == pairs["zero", "S8"] == 0 and pairs["zero", "S9"] == 1
    assert pairs["persistence", "S1"] > 5
