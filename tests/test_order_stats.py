"""Quantiles of many columns at once against sorted values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.operators import order_stats as ost
from barlab.operators import profile as prof
from barlab.session import materialise


def sorted_answers(rows, key, column):
    values = sorted(r[column] for r in rows if r[0] == key and r[column] is not None and math.isfinite(r[column]))
    if not values:
        return None
    n = len(values)

    def nearest(q):
        return values[int((n - 1) * q + 0.5)]

    at = (n - 1) * 0.5
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return (n, nearest(0.25), nearest(0.75), low + (high - low) * (at - math.floor(at)), values[0], values[-1])


@pytest.fixture(scope="module")
def rows():
    random.seed(11)
    kinds = [
        lambda: random.gauss(0, 1), lambda: random.gauss(0, 1e-300), lambda: random.choice([0.0, -0.0, 5.0]),
        lambda: random.choice([None, math.nan, math.inf, -math.inf, 1.5]), lambda: 1 + random.random() * 1e-12,
        lambda: random.choice([1e308, -1e308, 5e-324, -5e-324]),
    ]
    return [(random.choice(["a", "b", None, "c"]), *[k() for k in kinds]) for _ in range(3000)] + [("d", *[None] * 6)]


@pytest.mark.parametrize("open_rows, held", [(1 << 20, 1 << 20), (1, 1 << 20), (40, 50)])
def test_wide_quantiles_equal_sorted_values(spark, monkeypatch, rows, open_rows, held):
    monkeypatch.setattr(ost, "HELD_CODES", held)
    names = [f"v{i}" for i in range(6)]
    table = materialise(
        spark.createDataFrame(rows, "k string, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    )
    found = ost.wide_quantiles(
        table, ["k"], names, nearest={"q1": 0.25, "q3": 0.75}, linear={"median": 0.5},
        ends={"least": 0, "most": -1}, open_rows=open_rows,
    ).select("k", "feature", "finite_rows", "q1", "q3", "median", "least", "most").collect()
    got = {(r["k"], r["feature"]): tuple(r)[2:] for r in found}
    want = {
        (k, n): sorted_answers(rows, k, i + 1) for k in ("a", "b", None, "c", "d") for i, n in enumerate(names)
    }
    assert got == {k: v for k, v in want.items() if v}


def test_codes_keep_the_order_of_doubles():
    values = np.sort(np.concatenate([np.random.default_rng(1).normal(size=500) * 10.0 ** np.arange(-250, 250), [0.0, 5e-324, -5e-324]]))
    codes = ost.ordered_codes(values)
    assert (np.diff(codes) > 0).all() and (ost.values_of(codes) == values).all()
    assert ost.ordered_codes(np.array([-0.0]))[0] == ost.ordered_codes(np.array([0.0]))[0]


def test_many_groups_give_the_same_by_another_way(spark, rows):
    table = materialise(
        spark.createDataFrame([r for r in rows if r[0]], "k string, x double, y double, z double, u double, v double, w double")
    )
    columns = ["x", "z", "u"]
    args = dict(nearest={"q1": 0.25}, linear={"median": 0.5}, ends={"least": 0, "most": -1})
    wide = ost.wide_quantiles(table, ["k"], columns, **args)
    tall = ost.wide_quantiles(table, ["k"], columns, max_cells=3, **args)
    assert sorted(wide.collect()) == sorted(tall.select(wide.columns).collect())


def test_empty_tables_and_missing_columns_have_defined_profiles(spark):
    empty = spark.createDataFrame([], "k string, x double")
    assert prof.distribution_profile(empty, ["x"], ["k"]).count() == 0
    assert prof.distribution_profile(empty, ["x"]).count() == 0
    blank = spark.createDataFrame([("a", None), ("a", math.nan)], "k string, x double")
    row = prof.distribution_profile(blank, ["x"], ["k"]).first()
    assert (row.observations, row.finite_observations, row.missing_rate, row.q1) == (2, 0, 1.0, None)


def test_profile_reads_wide_rows_without_an_unpivot(spark):
    rows = materialise(spark.range(50).select((F.col("id") % 2).cast("string").alias("k"), F.col("id").cast("double").alias("x")))
    plan = ost._leading(rows, ["k"], ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Generate" not in plan and "Sort " not in plan


def test_counts_of_intervals_serve_all_folds_that_contain_them(spark):
    random.seed(12)
    rows = [(random.choice("ab"), random.randrange(3), random.choice([None, 2.0, random.random()])) for _ in range(900)]
    table = materialise(spark.createDataFrame(rows, "root string, part int, x double").repartition(3))
    spread = {"scope": F.array(F.col("root"), F.lit("ALL")), "fold": F.sequence(F.col("part"), F.lit(2))}
    for open_rows in (1 << 20, 1):
        found = ost.wide_quantiles(
            table, ["root", "part"], ["x"], linear={"median": 0.5}, spread=spread, open_rows=open_rows
        ).collect()
        got = {(r["scope"], r["fold"]): (r["finite_rows"], r["median"]) for r in found}
        for scope in ("a", "b", "ALL"):
            for fold in range(3):
                own = [x for root, part, x in rows if scope in (root, "ALL") and part <= fold and x is not None]
                assert got[scope, fold] == (len(own), float(np.median(own)))
