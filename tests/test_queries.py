"""Registered queries against their SQL twins, and the shape of the main plans."""

import os

import pytest

import __spark_entry__ as entry
from barlab.catalog.bars import bars_li, seg_li
from barlab.functions.clock import DAY
from barlab.operators import labels as lab
from barlab.operators import segments as seg
from barlab.session import materialise
from tools.compare import differences, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

# The whole catalogue takes a while; BARLAB_ALL_QUERIES=1 runs every twin.
QUICK = (
    "contract_segments", "rollover_table", "exact_returns", "future_labels", "trend_features",
    "labelled_features", "bar_quality", "partition_quality", "even_sample", "sample_fingerprint",
    "metrics_by_supplier", "prediction_deciles", "nearest_quantiles", "cross_market", "event_log",
    "cost_totals", "addon_subsets", "request_expansion",
)
CHOSEN = sorted(ORACLES) if os.environ.get("BARLAB_ALL_QUERIES") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql_twin(spark, con, name):
    _, problem = differences(QUERIES[name](spark, SF), con, ORACLES[name])
    assert problem is None


def test_catalogue_is_consistent(spark):
    assert set(ORACLES) <= set(QUERIES)
    assert entry.entry(spark).columns[:2] == ["root", "ts"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_and_labels_need_one_exchange_and_one_sort(spark):
    stored = materialise(seg_li(spark, SF))
    plan = plan_of(lab.build_labelled_features(stored, DAY))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1
    assert "Python" not in plan and "Join" not in plan


def test_bars_are_combined_before_the_shuffle_and_read_few_columns(spark):
    plan = plan_of(bars_li(spark, SF))
    assert plan.count("Exchange") == 1 and "partial_" in plan
    assert "l_discount" not in plan and "l_tax" not in plan


def test_rollovers_read_only_time_and_instrument(spark):
    stored = materialise(bars_li(spark, SF))
    plan = plan_of(seg._tile_runs(stored, DAY, 512).groupBy("root", "_tile", "_run").count())
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["cost_totals", "scenario_grid", "fold_declaration", "checkpoint_windows", "partition_quality"])
def test_no_cross_joins(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
