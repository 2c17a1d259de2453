"""Distributed ranks, quantiles, metrics and deciles against plain Python and numpy."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.functions.clock import MINUTE
from barlab.operators import metrics as met
from barlab.operators import profile as prof
from barlab.operators import ranks
from barlab.operators import stability as stab

START = datetime(2024, 1, 1)


def average_ranks(values):
    order = sorted(values)
    return [(order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for v in values]


def sample(kind, n, rng):
    if kind == "constant":
        return [0.0] * n
    if kind == "heavy":  # a third of all rows share one value
        return [0.0 if rng.random() < 0.34 else rng.gauss(0, 1) for _ in range(n)]
    if kind == "coarse":
        return [float(rng.randrange(5)) for _ in range(n)]
    return [rng.gauss(0, 1) for _ in range(n)]


@pytest.mark.parametrize("kind", ["constant", "heavy", "coarse", "spread"])
def test_average_rank_with_repeated_values(spark, kind):
    rng = random.Random(3)
    groups = {"a": sample(kind, 500, rng), "b": sample(kind, 7, rng), "c": [1.5]}
    rows = [(g, i, v) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = {(r["g"], r["i"]): r["r"] for r in ranks.add_average_rank(df, ["g"], "v", "r", 16).collect()}
    assert len(got) == len(rows)
    for g, vs in groups.items():
        for i, want in enumerate(average_ranks(vs)):
            assert got[(g, i)] == want


@pytest.mark.parametrize("kind", ["constant", "heavy", "coarse", "spread"])
def test_quantiles_are_exact(spark, kind):
    rng = random.Random(4)
    groups = {"a": sample(kind, 501, rng), "b": sample(kind, 10, rng), "c": [2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("a", math.nan), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = ranks.quantiles(
        df, ["g"], "v", nearest={"n33": 1 / 3, "n25": 0.25, "n99": 0.99},
        linear={"m": 0.5, "l": 0.005}, splits=16,
    )
    got = {r["g"]: r for r in found.collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        ordered = sorted(vs)
        for name, q in (("n33", 1 / 3), ("n25", 0.25), ("n99", 0.99)):
            assert got[g][name] == ordered[math.floor(q * (len(vs) - 1) + 0.5)]
        assert got[g]["m"] == pytest.approx(np.quantile(vs, 0.5))
        assert got[g]["l"] == pytest.approx(np.quantile(vs, 0.005))
        assert got[g]["finite_rows"] == len(vs)


@pytest.mark.parametrize("kind", ["constant", "heavy", "coarse", "spread"])
def test_deciles_match_a_stable_sort(spark, kind):
    rng = random.Random(7)
    n = 237
    predicted, actual = sample(kind, n, rng), sample("spread", n, rng)
    identity = sorted((rng.choice("AB"), i) for i in range(n))
    rows = [
        ("m", root, START + timedelta(minutes=minute), a, p)
        for (root, minute), a, p in zip(identity, actual, predicted)
    ]
    df = spark.createDataFrame(rows, "model string, root string, ts timestamp, a double, p double")
    table = met.prediction_deciles(df, ["model"], "a", "p", MINUTE, tile_units=16)
    got = {r["decile"]: r for r in table.collect()}
    parts = np.array_split(np.argsort(np.array(predicted), kind="stable"), 10)
    for decile, part in enumerate(parts, start=1):
        assert got[decile]["observations"] == len(part)
        assert got[decile]["mean_prediction"] == pytest.approx(np.mean([predicted[i] for i in part]), abs=1e-12)
        assert got[decile]["mean_actual"] == pytest.approx(np.mean([actual[i] for i in part]))
        assert got[decile]["median_actual"] == pytest.approx(np.median([actual[i] for i in part]))


def test_metrics_match_numpy(spark):
    rng = random.Random(2)
    a, p = sample("heavy", 300, rng), sample("heavy", 300, rng)
    df = spark.createDataFrame([("x", u, v) for u, v in zip(a, p)] + [("x", math.nan, 1.0)], "g string, a double, p double")
    row = met.regression_metrics(df, ["g"], "a", "p").first()
    a, p = np.array(a), np.array(p)
    assert row["observations"] == 300
    assert row["mae"] == pytest.approx(np.abs(a - p).mean())
    assert row["rmse"] == pytest.approx(math.sqrt(((a - p) ** 2).mean()))
    assert row["r2"] == pytest.approx(1 - ((a - p) ** 2).sum() / ((a - a.mean()) ** 2).sum())
    assert row["pearson"] == pytest.approx(np.corrcoef(a, p)[0, 1])
    assert row["spearman"] == pytest.approx(np.corrcoef(average_ranks(list(a)), average_ranks(list(p)))[0, 1])
    assert row["direction_accuracy"] == pytest.approx((np.sign(a) == np.sign(p)).mean())


def test_metric_edge_cases(spark):
    rows = [("one", 1.0, 2.0), ("flat", 1.0, 1.0), ("flat", 1.0, 1.0), ("miss", 1.0, 2.0), ("miss", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, a double, p double")
    got = {r["g"]: r for r in met.regression_metrics(df, ["g"], "a", "p").collect()}
    assert got["one"]["r2"] is None and got["one"]["pearson"] is None
    assert got["flat"]["r2"] == 1.0 and got["miss"]["r2"] == 0.0
    assert got["flat"]["spearman"] is None


def test_regimes_and_histogram(spark):
    values = [float(v) for v in range(1, 101)]
    df = spark.createDataFrame([("r", v) for v in values] + [("r", None), ("s", 1.0)], "root string, v double")
    limits = prof.tertiles(df.where("root = 'r'"), "v")
    counts = {r["regime"]: r["count"] for r in prof.with_regime(df, limits, "v").groupBy("regime").count().collect()}
    assert counts == {"low": 34, "medium": 33, "high": 33, "unavailable": 2}
    bins = prof.trimmed_histogram(df.where("root = 'r'"), "v", bins=10).orderBy("bin").collect()
    lo, hi = np.quantile(values, [0.005, 0.995])
    want, edges = np.histogram([v for v in values if lo <= v <= hi], bins=10)
    assert [b["rows"] for b in bins] == list(want)
    assert [b["lower"] for b in bins] == pytest.approx(list(edges[:-1]))


def test_root_ranks_put_missing_last(spark):
    df = spark.createDataFrame(
        [("f", "A", 0.1), ("f", "B", math.nan), ("f", "C", 0.3), ("f", "D", 0.1), ("f", "E", None)],
        "fold string, root string, pearson double",
    )
    got = {r["root"]: r["rank"] for r in stab.root_ranks(df, ["fold"]).collect()}
    assert got == {"C": 1, "A": 2, "D": 3, "B": 4, "E": 5}


def test_fold_summary_skips_missing(spark):
    df = spark.createDataFrame([("m", "r2", 1.0), ("m", "r2", -3.0), ("m", "r2", math.nan)], "model string, metric string, value double")
    row = stab.metric_stability(df, ["model"]).first()
    assert (row["mean"], row["median"], row["standard_deviation"]) == (-1.0, -1.0, 2.0)
    assert (row["positive_folds"], row["finite_folds"]) == (1, 2)


def test_drift_needs_a_spread(spark):
    old = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, y double")
    new = spark.createDataFrame([(4.0, 6.0)], "x double, y double")
    table = prof.drift_profile(prof.distribution_profile(old, ["x", "y"]), prof.distribution_profile(new, ["x", "y"]))
    got = {r["feature"]: r["median_shift_in_historical_iqr"] for r in table.collect()}
    assert got["x"] == pytest.approx(2.0 / 1.0) and got["y"] is None


def test_mismatches_are_found(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "k string, n int")
    b = spark.createDataFrame([("x", 1), ("y", 5)], "k string, n int")
    bad = {r["k"] for r in stab.count_mismatches(a, b, ["k"], ["n"]).collect()}
    assert bad == {"y", "z"}
    with pytest.raises(RuntimeError):
        stab.require_empty(stab.count_mismatches(a, b, ["k"], ["n"]), "counts differ")
    stab.require_empty(stab.count_mismatches(a, a, ["k"], ["n"]), "counts differ")


def test_bucket_edges_are_ordered(spark):
    points = [1.0, 2.0, 5.0]
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 3.0, 5.0, 9.0)], "v double")
    b = ranks.bucket_of(F.col("v"), F.array(*[F.lit(x) for x in points]), 4)
    assert [r["b"] for r in df.select(b.alias("b")).collect()] == [0, 1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("kind", ["heavy", "coarse"])
def test_ranks_and_quantiles_without_broadcast(spark, kind, monkeypatch):
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = random.Random(5)
        groups = {f"g{i}": sample(kind, 60, rng) for i in range(5)}
        rows = [(g, i, v, -v) for g, vs in groups.items() for i, v in enumerate(vs)]
        df = spark.createDataFrame(rows, "g string, i int, v double, w double")
        ranked = ranks.add_average_ranks(df, ["g"], {"v": "rv", "w": "rw"}, 2)
        got = {(r["g"], r["i"]): (r["rv"], r["rw"]) for r in ranked.collect()}
        for g, vs in groups.items():
            n = len(vs)
            assert [got[(g, i)] for i in range(n)] == [(r, n + 1 - r) for r in average_ranks(vs)]
        plan = ranked._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Window") == 4
        physical = ranked._jdf.queryExecution().executedPlan().toString()
        # a window never stands on the join by group alone: its own key has the bucket and the piece
        assert physical.count("_bucket") and "hashpartitioning(g" in physical
        for line in physical.splitlines():
            if "hashpartitioning(g" in line:
                assert "_part" in line or "_piece" in line or "_bucket" in line
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_two_ranked_columns_cost_two_exchanges_and_four_windows(spark):
    df = spark.createDataFrame([("a", float(i % 9), float(i)) for i in range(99)], "g string, v double, w double")
    plan = ranks.add_average_ranks(df, ["g"], {"v": "rv", "w": "rw"}, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("Window [") == 4 and plan.count("Union") == 0


def test_groups_without_pairs_keep_a_metric_row(spark):
    rows = [("x", 1.0, 1.0), ("x", 2.0, 1.5), ("y", None, 1.0), ("y", 1.0, math.nan)]
    df = spark.createDataFrame(rows, "root string, a double, p double")
    for spearman in (True, False):
        got = {r["root"]: r.asDict() for r in met.regression_metrics(df, ["root"], "a", "p", spearman).collect()}
        assert got["x"]["observations"] == 2 and got["y"]["observations"] == 0
        assert all(got["y"][m] is None for m in got["y"] if m not in ("root", "observations"))
    scopes = {r["scope"]: r["observations"] for r in met.evaluate(df, [], "a", "p").collect()}
    assert scopes == {"x": 2, "y": 0, "ALL": 2}


def test_a_constant_has_no_correlation_however_its_moments_are_merged(spark):
    rng = random.Random(7)
    rows = [(f"g{g}", rng.gauss(0, 1), 0.1) for g in range(200) for _ in range(90 + g % 37)]
    df = spark.createDataFrame(rows, "root string, a double, p double").repartition(7)
    for table in (met.regression_metrics(df, ["root"], "a", "p"), met.evaluate(df, [], "a", "p")):
        assert {(r["pearson"], r["spearman"]) for r in table.collect()} == {(None, None)}
    swapped = met.regression_metrics(df, ["root"], "p", "a", spearman=False).collect()
    assert {(r["pearson"], r["r2"]) for r in swapped} == {(None, 0.0)}


@pytest.mark.parametrize("kind", ["constant", "heavy", "coarse", "spread"])
def test_metrics_of_short_groups_equal_the_general_ones(spark, kind):
    rng = random.Random(8)
    rows = [
        (m, g, a, p) for m in "xy" for g in ("a", "b", "c", None)
        for a, p in zip(sample("heavy", 90, rng), sample(kind, 90, rng))
    ]
    rows += [("x", "a", v, 1.0) for v in (None, math.nan, math.inf, -0.0)] + [("y", "b", 0.5, v) for v in (None, -math.inf, -0.0)]
    rows += [("x", "one", 1.0, 2.0), ("x", "none", None, 1.0), ("x", "none", 1.0, math.nan)]
    df = spark.createDataFrame(rows, "m string, g string, a double, p double")
    keys = ["m", "g"]
    dealt = df.repartition("g")
    short = met.regression_metrics(dealt, keys, "a", "p", short=True)
    wide = met.regression_metrics(df, keys, "a", "p")
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 2
    assert short.columns == wide.columns
    got, want = ({(r["m"], r["g"]): r.asDict() for r in t.collect()} for t in (short, wide))
    assert set(got) == set(want) and got["x", "none"]["observations"] == 0
    for group, row in want.items():
        assert got[group] == pytest.approx(row, abs=1e-12)
    if kind != "constant":
        pairs = [(a, p) for m, g, a, p in rows if (m, g) == ("x", "c")]
        ranked = [average_ranks([pair[i] for pair in pairs]) for i in (0, 1)]
        assert got["x", "c"]["spearman"] == pytest.approx(np.corrcoef(*ranked)[0, 1])
