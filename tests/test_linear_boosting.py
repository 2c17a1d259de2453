"""Ridge by sums of products and leaf-wise boosting against plain numpy."""

from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.operators import boosting as boost
from barlab.operators import linear as lin
from barlab.operators import models as mod
from barlab.session import materialise
from tests.conftest import START

NAMES = ("x", "z", "far", "empty")


def rows_of(n=600, roots=("a", "b", "c"), seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        root = str(rng.choice(roots))
        x = None if rng.random() < 0.2 else float(rng.normal())
        z = float(rng.normal() + 3) if root != "b" or rng.random() < 0.5 else None
        far = 1e6 + float(rng.normal())
        y = (x or 0.0) - 2 * (z or 0.0) + {"a": 1.0, "b": -3.0}.get(root, 0.5) + rng.normal() / 5
        out.append((root, START + timedelta(minutes=i), x, z, far, None, float(y)))
    out.append(("a", START, 1.0, 1.0, 1e6, None, None))  # no target: no training row
    return out


SHAPE = "root string, ts timestamp, x double, z double, far double, empty double, y double"
ENDS = {"one": START + timedelta(minutes=200), "two": START + timedelta(minutes=350), "three": START + timedelta(minutes=520)}


def dense(rows, names, roots, alpha=1.0):
    """(intercept, weights, effects, rows, predict) by the dense normal equations."""
    at = [("root", "ts", "x", "z", "far", "empty", "y").index(c) for c in names]
    raw = np.array([[np.nan if r[i] is None else r[i] for i in at] for r in rows])
    median = np.array([np.nanmedian(c) if np.isfinite(c).any() else np.nan for c in raw.T])
    filled = np.where(np.isnan(raw), np.where(np.isnan(median), 0.0, median), raw)
    mean, scale = filled.mean(0), filled.std(0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    d = np.column_stack([np.ones(len(rows)), (filled - mean) / scale, *[[float(r[0] == k) for r in rows] for k in roots]])
    y = np.array([r[6] for r in rows])
    penalty = np.eye(d.shape[1]) * alpha
    penalty[0, 0] = 0
    w = np.linalg.solve(d.T @ d + penalty, d.T @ y)

    def predict(row):
        v = np.array([np.nan if row[i] is None else row[i] for i in at])
        v = np.where(np.isnan(v), np.where(np.isnan(median), 0.0, median), v)
        return w[0] + ((v - mean) / scale) @ w[1 : 1 + len(at)] + sum(w[1 + len(at) + i] for i, k in enumerate(roots) if row[0] == k)

    return w[1 : 1 + len(at)], dict(zip(roots, w[1 + len(at) :])), len(rows), predict


@pytest.fixture(scope="module")
def stats(spark):
    df = spark.createDataFrame(rows_of(), SHAPE).repartition(4)
    return lin.fold_statistics(df, NAMES, "y", ENDS, START)


def training(fold, root=None):
    return [r for r in rows_of() if r[6] is not None and r[1] < ENDS[fold] and root in (None, r[0])]


@pytest.mark.parametrize("names", [NAMES, ("z", "x")])
def test_pooled_ridge_with_eliminated_roots_equals_the_dense_solve(spark, stats, names):
    models, effects = lin.fit_pooled(stats, names)
    found = {(r["fold"], r["root"]): r["effect"] for r in effects.collect()}
    for r in models.collect():
        weights, own, n, _ = dense(training(r["fold"]), names, ("a", "b", "c"))
        assert r["training_rows"] == n and r["coefficients"] == pytest.approx(list(weights), rel=1e-9, abs=1e-9)
        assert {k: found[r["fold"], k] for k in own} == pytest.approx(own, rel=1e-9, abs=1e-9)
    assert len(found) == 9


def test_one_ridge_per_root_and_fold_equals_its_dense_solve(spark, stats):
    found = {(r["fold"], r["root"]): r for r in lin.fit_per_root(stats).collect()}
    assert len(found) == 9
    for (fold, root), r in found.items():
        weights, _, n, _ = dense(training(fold, root), NAMES, ())
        assert r["training_rows"] == n and r["coefficients"] == pytest.approx(list(weights), rel=1e-8, abs=1e-9)


def test_roots_in_blocks_have_the_same_medians(stats):
    whole = sorted(map(tuple, lin.root_medians(stats, ["x", "z"]).collect()))
    assert sorted(map(tuple, lin.root_medians(stats, ["x", "z"], max_cells=12).collect())) == whole


def test_medians_of_many_roots_take_one_pass(stats, monkeypatch):
    def counted(*_, **__):
        raise AssertionError("small roots are counted by leading bits")

    monkeypatch.setattr(lin, "SORTED_ROWS", 50)
    large = sorted(map(tuple, lin.root_medians(stats, NAMES, most_values=0).collect()))
    some = sorted(map(tuple, lin.root_medians(stats, NAMES, max_cells=12, most_values=4 * 150).collect()))
    monkeypatch.setattr(lin, "wide_quantiles", counted)
    assert sorted(map(tuple, lin.root_medians(stats, NAMES, max_cells=12).collect())) == large == some
    wanted = {(k, i, f): [r[("root", "ts", "x", "z", "far").index(f)] for r in training(e, k)] for i, e in enumerate(ENDS) for k in "abc" for f in ("x", "z", "far")}
    assert {r[:3]: r[3] for r in large} == pytest.approx({k: np.median([x for x in v if x is not None]) for k, v in wanted.items()})


def test_scores_meet_their_fold_and_an_unknown_root_adds_nothing(spark, stats):
    held = [("a", START, 0.5, None, 1e6, None, 0.0), ("q", START, None, 2.0, 1e6 + 1, None, 0.0)]
    df = spark.createDataFrame([(*r, "two") for r in held] + [(*held[0], "none")], SHAPE + ", fold string")
    models, effects = lin.fit_pooled(stats)
    got = {(r["root"], r["fold"]): r["prediction"] for r in lin.score_linear(df, NAMES, models, effects).collect()}
    predict = dense(training("two"), NAMES, ("a", "b", "c"))[3]
    assert got["a", "two"] == pytest.approx(predict(held[0]), rel=1e-8)
    assert got["q", "two"] == pytest.approx(predict(held[1]), rel=1e-8) and got["a", "none"] is None
    own = lin.score_linear(df, NAMES, lin.fit_per_root(stats), on=("fold", "root")).collect()
    assert {r["root"]: r["prediction"] is None for r in own if r["fold"] == "two"} == {"a": False, "q": True}


def test_fit_ridge_gathers_no_roots_and_refuses_blank_features(spark):
    df = spark.createDataFrame(rows_of(300, [f"r{i}" for i in range(40)]), SHAPE)
    model = mod.fit_ridge(df, ("x", "z"), "y")
    rows = [r for r in rows_of(300, [f"r{i}" for i in range(40)]) if r[6] is not None]
    weights, effects, _, _ = dense(rows, ("x", "z"), sorted({r[0] for r in rows}))
    assert list(model.coefficients.values()) == pytest.approx(list(weights), rel=1e-9)
    assert model.weights() == pytest.approx(
        {**model.coefficients, **{f"root_{k}": v for k, v in effects.items()}}, rel=1e-9, abs=1e-9
    )
    assert model.prep.roots == ()
    with pytest.raises(ValueError):
        mod.fit_ridge(df, ("empty",), "y")
    with pytest.raises(ValueError):
        lin.fold_statistics(df.limit(0), ("x",), "y")


# ---- boosting


def plain_boosting(x, root, y, edges, given):
    """Best-first trees by full search; x has no missing values. -> predictions of the training rows."""
    codes = np.column_stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)])
    names = sorted(set(root))
    pred = np.full(len(y), y.mean())
    for _ in range(given.rounds):
        g = pred - y

        def best(rows):
            score = lambda r: g[r].sum() ** 2 / (len(r) + given.l2)
            found = (0.0, None)
            for f in range(codes.shape[1]):
                for b in range(given.bins - 1):
                    left, right = rows[codes[rows, f] <= b], rows[codes[rows, f] > b]
                    if min(len(left), len(right)) >= given.leaf_rows:
                        gain = score(left) + score(right) - score(rows)
                        if gain > found[0] + 1e-12:
                            found = (gain, (left, right))
            for name in names:
                right, left = rows[root[rows] == name], rows[root[rows] != name]
                if min(len(left), len(right)) >= given.leaf_rows:
                    gain = score(left) + score(right) - score(rows)
                    if gain > found[0] + 1e-12:
                        found = (gain, (left, right))
            return found

        leaves = [(best(np.arange(len(y))), np.arange(len(y)))]
        while len(leaves) < given.leaves:
            at = max(range(len(leaves)), key=lambda i: leaves[i][0][0])
            (gain, sides), _ = leaves[at]
            if sides is None:
                break
            leaves[at : at + 1] = [(best(s), s) for s in sides]
        for _, rows in leaves:
            pred[rows] -= given.rate * g[rows].sum() / (len(rows) + given.l2)
    return pred


def boosting_rows(n, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.choice([0.0, 1.0, 2.0], n), rng.normal(size=n)])
    root = rng.choice(["a", "b", "c"], n)
    y = np.sin(2 * x[:, 0]) + 0.7 * (x[:, 1] == 1) * x[:, 2] + (root == "b") + rng.normal(size=n) / 10
    return x, root, y


def boosting_table(spark, x, root, y):
    rows = [(str(r), *map(float, v), float(t)) for r, v, t in zip(root, x, y)]
    return spark.createDataFrame(rows, "root string, p double, q double, r double, y double")


@pytest.mark.parametrize("few_tasks, task_rows, stored", [(32, 1 << 17, 10), (0, 100, 2)])
def test_boosting_equals_a_plain_booster(spark, monkeypatch, few_tasks, task_rows, stored):
    monkeypatch.setattr(boost, "FEW_TASKS", few_tasks)
    monkeypatch.setattr(boost, "TASK_ROWS", task_rows)
    monkeypatch.setattr(boost, "STORED_TREES", stored)
    x, root, y = boosting_rows(320)
    given = boost.Boosting(rounds=3, leaves=6, leaf_rows=12, bins=16)
    df = materialise(boosting_table(spark, x, root, y))
    model = boost.fit_boosting(df, ("p", "q", "r"), "y", given)
    got = [r["prediction"] for r in model.transform(df).collect()]
    want = dict(zip(map(tuple, x.tolist()), plain_boosting(x, root, y, model.edges, given)))
    rows = [(r["p"], r["q"], r["r"]) for r in df.collect()]
    assert got == pytest.approx([want[r] for r in rows], rel=1e-9, abs=1e-9)
    assert model.training_rows == 320 and len(model.trees) == 3
    assert all(len(t.values) <= 6 and len(t.splits) == len(t.values) - 1 for t in model.trees)


def test_bins_leaf_rows_and_unknown_roots(spark):
    x, root, y = boosting_rows(500)
    df = boosting_table(spark, x, root, y)
    model = boost.fit_boosting(df, ("p", "q", "r"), "y", boost.Boosting(rounds=2, leaves=31, leaf_rows=100))
    assert [len(e) for e in model.edges][1] == 2 and all(len(e) <= 254 for e in model.edges)
    scored = model.transform(df).groupBy(F.round("prediction", 9)).count().collect()
    assert min(r["count"] for r in scored) >= 1 and all(len(t.values) <= 5 for t in model.trees)
    odd = spark.createDataFrame([("zz", None, float("nan"), 1e300), (None, 1.0, None, None)], "root string, p double, q double, r double")
    assert all(r["prediction"] is not None for r in model.transform(odd).collect())
    with pytest.raises(ValueError):
        boost.fit_boosting(df.limit(0), ("p",), "y")


def test_constant_target_and_early_end(spark):
    x, root, y = boosting_rows(400)
    flat = boost.fit_boosting(boosting_table(spark, x, root, y * 0 + 2.5), ("p",), "y", boost.Boosting(rounds=5, leaf_rows=5))
    assert flat.trees == () and flat.start == 2.5
    noise = boosting_table(spark, x, root, np.random.default_rng(1).normal(size=400))
    given = boost.Boosting(rounds=60, leaf_rows=5, early_rows=100, patience=2, held_share=0.3)
    model = boost.fit_boosting(noise, ("p", "q", "r"), "y", given)
    assert len(model.trees) < 60 and len(model.held_losses) == len(model.trees) + 1 and model.training_rows < 400
