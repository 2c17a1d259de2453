"""Fitted models: ridge, trees, sampling studies, importance and dedicated models."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from barlab.catalog import sql as q
from barlab.catalog.bars import LI_ANCHORS, LI_TILE, seg_su
from barlab.catalog.log_queries import DAYS_AFTER, NOW, moment
from barlab.catalog.market_queries import CUTOFF, market_li
from barlab.catalog.metric_queries import (
    ELIGIBLE_LI,
    FEAT_LI,
    FOLDS_SQL,
    PURGE,
    TARGET,
    eligible_li,
    folds_li,
)
from barlab.catalog.registry import register, report
from barlab.functions.clock import DAY
from barlab.operators import cross
from barlab.operators import features as feat
from barlab.operators import frozen as fro
from barlab.operators import labels as lab
from barlab.operators import linear as lin
from barlab.operators import metrics as met
from barlab.operators import models as mod
from barlab.operators import prospective as pro
from barlab.operators import quality as qual
from barlab.operators import sampling as samp
from barlab.operators import splits as spl
from barlab.operators import stability as stab
from barlab.session import broadcast_if_small, materialise, scratch_path
from barlab.sources import eventlog

PAIR = ("log_return_1d", "log_return_5d")


def splits_li(spark, sf_dir, *columns):
    """Eligible labelled rows of the daily bars with their chronological split, stored once."""
    rows = eligible_li(spark, sf_dir, "root", "ts", "instrument_id", "contract_segment_id", *columns)
    stored = materialise(rows)
    boundaries = spl.boundaries_of(stored, PURGE, DAY)
    return spl.assign_split(stored, boundaries)


_OWN = feat.own_feature_names(DAY)


@register(
    "training_medians",
    q.query(
        q.BARS_LI, q.SEGMENTS, q.feature_ctes(q.DAYS), ELIGIBLE_LI,
        "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM elig" for c in _OWN) + ")",
        select=f"SELECT feature, {q.rd('median(v)')} AS median FROM l GROUP BY feature",
    ),
)
def training_medians(spark, sf_dir):
    return report(mod.training_medians(eligible_li(spark, sf_dir, *_OWN), _OWN))


def _ridge2_sql() -> str:
    """Closed-form ridge on two standardised features (alpha 1, free intercept)."""
    x, z = PAIR
    return f"""src AS (SELECT {x} AS x, {z} AS z, {TARGET} AS y FROM lab WHERE {TARGET} IS NOT NULL),
med AS (SELECT median(x) AS mx, median(z) AS mz FROM src),
imp AS (SELECT coalesce(x, mx) AS x, coalesce(z, mz) AS z, y FROM src, med),
st AS (SELECT avg(x) AS ax, avg(z) AS az, stddev_pop(x) AS sx, stddev_pop(z) AS sz, avg(y) AS ay, count(*) AS n FROM imp),
g AS (SELECT sum(((x - ax) / sx) ** 2) + 1 AS a, sum(((x - ax) / sx) * ((z - az) / sz)) AS b, sum(((z - az) / sz) ** 2) + 1 AS d,
  sum(((x - ax) / sx) * (y - ay)) AS p, sum(((z - az) / sz) * (y - ay)) AS r, any_value(n) AS n FROM imp, st),
w AS (SELECT (d * p - b * r) / (a * d - b * b) AS wx, (a * r - b * p) / (a * d - b * b) AS wz, n FROM g)"""


@register(
    "ridge_all_suppliers",
    q.query(
        q.BARS_SU, q.SEGMENTS, q.returns(q.DAYS, (1, 5)), q.labels(q.DAYS, (1,)), _ridge2_sql(),
        select=f"SELECT '{PAIR[0]}' AS feature, {q.rd('wx')} AS coefficient, n AS training_rows FROM w "
        f"UNION ALL SELECT '{PAIR[1]}', {q.rd('wz')}, n FROM w",
    ),
)
def ridge_all_suppliers(spark, sf_dir):
    """Exact ridge over all supplier bars against its closed form."""
    families = [feat.returns(DAY, (1, 5)), lab.labels(DAY, (1,))]
    rows = feat.add_families(seg_su(spark, sf_dir), families, 5, 1).select("root", *PAIR, TARGET).where(F.col(TARGET).isNotNull())
    model = mod.fit_ridge(materialise(rows), PAIR, TARGET, include_root=False)
    table = mod.coefficient_table(rows, model)
    return report(
        table.select("feature", "coefficient", F.lit(model.training_rows).cast("bigint").alias("training_rows"))
    )


@register("ridge_coefficients")
def ridge_coefficients(spark, sf_dir):
    """Fifteen largest weights of the ridge on own features and anchors."""
    rows = materialise(market_li(spark, sf_dir).where(qual.eligible(DAY, TARGET)))
    features = cross.experiment_features("B", DAY, LI_ANCHORS)
    model = mod.fit_ridge(rows, features, TARGET)
    return report(mod.coefficient_table(rows, model, top=15))


@register("ridge_evaluation")
def ridge_evaluation(spark, sf_dir):
    """A, B and C ridges fitted on an even training sample, scored on validation, with naive models."""
    rows = materialise(market_li(spark, sf_dir).where(qual.eligible(DAY, TARGET)))
    wide = spl.assign_split(
        cross.add_relative_returns(rows, DAY, LI_ANCHORS), spl.boundaries_of(rows, PURGE, DAY)
    )
    train, held = wide.where("split = 'train'"), wide.where("split = 'validation'")
    models = {}
    for name in ("A", "B", "C"):
        features = cross.experiment_features(name, DAY, LI_ANCHORS)
        cross.check_feature_columns(features, DAY)
        sample = mod.training_sample(train, ["ts", "root", *features, TARGET], 400, DAY, tile_units=LI_TILE)
        models[f"ridge_{name}"] = mod.fit_ridge(materialise(sample), features, TARGET).transform
    models["zero"] = lambda df: df.withColumn("prediction", F.lit(0.0))
    models["persistence"] = lambda df: df.withColumn("prediction", F.col("log_return_1d"))
    models["reversal"] = lambda df: df.withColumn("prediction", -F.col("log_return_1d"))
    scored = mod.score(held, models).select("model", "root", TARGET, "prediction")
    return report(met.evaluate(scored, ["model"], TARGET, "prediction"))


@register("ridge_capped_vs_full")
def ridge_capped_vs_full(spark, sf_dir):
    """Ridge on an even cap per root against ridge on all training rows, on validation."""
    wide = splits_li(spark, sf_dir, *_OWN, TARGET)
    train = wide.where("split = 'train'")
    capped = materialise(mod.training_sample(train, ["ts", "root", *_OWN, TARGET], 200, DAY, tile_units=LI_TILE))
    full = mod.fit_ridge(train, _OWN, TARGET)
    small = mod.fit_ridge(capped, _OWN, TARGET, medians=full.prep.medians)
    scored = mod.score(
        wide.where("split = 'validation'"), {"full": full.transform, "capped": small.transform}
    )
    table = met.regression_metrics(scored, ["model"], TARGET, "prediction").withColumn("study", F.lit("ridge"))
    deltas = stab.paired_deltas(table, ["study"], "model", "full", "capped")
    return report(
        table.select("model", "observations", "r2", "pearson", "spearman")
        .join(deltas.drop("study"), F.col("model") == "full", "left")
    )


@register("ridge_ml_agreement")
def ridge_ml_agreement(spark, sf_dir):
    """Largest gap between the exact ridge and the pyspark.ml one on held-out rows."""
    wide = splits_li(spark, sf_dir, *_OWN, TARGET)
    train = wide.where("split = 'train'")
    exact = mod.fit_ridge(train, _OWN, TARGET)
    prep = mod.fit_preprocessor(train, _OWN, medians=exact.prep.medians)
    other = mod.ridge_by_ml(train, prep, TARGET)
    held = wide.where("split = 'test'")
    both = other.transform(mod.assemble(held, prep, True)).withColumnRenamed("prediction", "ml").drop("features")
    return report(
        exact.transform(both).withColumnRenamed("prediction", "exact").agg(
            F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("ml") - F.col("exact"))).alias("largest_gap")
        )
    )


@register("tree_evaluation")
def tree_evaluation(spark, sf_dir):
    """Boosted trees against the zero model, per root and pooled, on validation."""
    wide = splits_li(spark, sf_dir, *_OWN, TARGET)
    trees = mod.fit_trees(wide.where("split = 'train'"), _OWN, TARGET)
    scored = mod.score(
        wide.where("split = 'validation'"),
        {"trees": trees.transform, "zero": lambda df: df.withColumn("prediction", F.lit(0.0))},
    ).select("model", "root", TARGET, "prediction")
    return report(met.evaluate(scored, ["model"], TARGET, "prediction"))


@register("training_size_study")
def training_size_study(spark, sf_dir):
    """Trees on growing even samples; the best size by validation correlation."""
    wide = splits_li(spark, sf_dir, *_OWN, TARGET)
    train, held = wide.where("split = 'train'"), wide.where("split = 'validation'")
    # a fit is a long row of small jobs, so the fits run side by side
    def fitted(cap):
        sample = mod.training_sample(train, ["ts", "root", *_OWN, TARGET], cap, DAY, tile_units=LI_TILE)
        return mod.fit_trees(materialise(sample), _OWN, TARGET).transform

    caps = (100, 200, 400)
    with ThreadPoolExecutor(len(caps)) as pool:
        models = dict(zip([f"{cap:05d}" for cap in caps], pool.map(fitted, caps)))
    table = met.regression_metrics(
        mod.score(held, models).select("model", TARGET, "prediction"), ["model"], TARGET, "prediction", spearman=False
    )
    best = stab.best_by_metric(table.withColumn("study", F.lit("size")), ["study"], "model")
    return report(
        table.join(best.select(F.col("best_model").alias("model"), F.lit(True).alias("chosen")), "model", "left")
        .select("model", "observations", "rmse", "pearson", F.coalesce("chosen", F.lit(False)).alias("chosen"))
    )


def scored_models(held, features, pooled, effects, dedicated):
    """(fold, model, root, target, prediction): every held row by the pooled model and by its root's own."""
    keep = ("fold", "model", "root", TARGET, "prediction")
    by_all = lin.score_linear(held, features, pooled, effects).withColumn("model", F.lit("pooled"))
    by_own = lin.score_linear(held, features, dedicated, on=("fold", "root")).withColumn("model", F.lit("dedicated"))
    return by_all.select(*keep).unionByName(by_own.select(*keep))


def fitted_experiments(stats, experiments):
    """(name, features, pooled models, effects, models per root); the experiments share one look for medians."""
    listed = list(dict.fromkeys(f for features in experiments.values() for f in features))
    middle, own = lin.pooled_medians(stats, listed), materialise(lin.root_medians(stats, listed))
    for name, features in experiments.items():
        at = [listed.index(f) for f in features]
        pooled = lin.fit_pooled(stats, features, medians={fold: m[at] for fold, m in middle.items()})
        yield name, features, *pooled, lin.fit_per_root(stats, features, medians=own)


@register("dedicated_vs_pooled")
def dedicated_vs_pooled(spark, sf_dir):
    """One ridge per root against the pooled ridge, on each root's own test rows; one pass over the training rows."""
    wide = splits_li(spark, sf_dir, *_OWN, TARGET)
    stats = lin.fold_statistics(wide.where("split = 'train'"), _OWN, TARGET)
    held = wide.where("split = 'test'").withColumn("fold", F.lit("all"))
    scored = scored_models(held, _OWN, *lin.fit_pooled(stats), lin.fit_per_root(stats))
    table = met.regression_metrics(scored.drop("fold"), ["root", "model"], TARGET, "prediction")
    return report(stab.paired_deltas(table, ["root"], "model", "dedicated", "pooled"))


@register("permutation_importance")
def permutation_importance(spark, sf_dir):
    """R² lost on all validation rows when one feature is shuffled."""
    wide = splits_li(spark, sf_dir, *_OWN, TARGET)
    model = mod.fit_ridge(wide.where("split = 'train'"), _OWN, TARGET)
    held = wide.where("split = 'validation'").select("ts", "root", *_OWN, TARGET)
    return report(
        mod.permutation_importance(held, _OWN, TARGET, model.transform, DAY, tile_units=LI_TILE)
    )


def training_ends(folds):
    """Fold names and the ends of their training rows, and the common start."""
    return {f.fold: f.train_end for f in folds}, folds[0].train_start


@register("walk_forward_ridge")
def walk_forward_ridge(spark, sf_dir):
    """A and B ridges, pooled and per root, refitted on all rows of each expanding fold, scored on its evaluation.

    The sums of products of all folds come from one pass; A is part of B.
    """
    rows = materialise(market_li(spark, sf_dir).where(qual.eligible(DAY, TARGET)))
    ends, start = training_ends(folds_li())
    stats = lin.fold_statistics(rows, cross.experiment_features("B", DAY, LI_ANCHORS), TARGET, ends, start)
    held = materialise(spl.with_evaluation_folds(rows, folds_li()))
    scored = None
    experiments = {name: cross.experiment_features(name, DAY, LI_ANCHORS) for name in ("A", "B")}
    for name, features, *models in fitted_experiments(stats, experiments):
        part = scored_models(held, features, *models).withColumn("experiment", F.lit(name))
        scored = part if scored is None else scored.unionByName(part)
    keys = ["experiment", "model"]
    per_fold = met.regression_metrics(scored.drop("root"), ["fold", *keys], TARGET, "prediction")
    return report(stab.metric_stability(stab.long_metrics(per_fold, keys), keys))


# --- ridge per fold over supplier roots, with closed forms in SQL ---------------------------------

ANCHOR = "S1_return_1d"
SUPPLIER_FEATURES = {"A": PAIR, "B": (*PAIR, ANCHOR)}


def supplier_table(spark, sf_dir, wanted):
    """Wanted supplier bars with returns, the anchor return of the same day, and the label: one exchange of the lines.

    Only the wanted rows and the anchor's are stored.
    """
    families = [feat.returns(DAY, (1, 5)), lab.labels(DAY, (1,))]
    bars = feat.add_short_families(seg_su(spark, sf_dir), families).select(*samp.IDENTITY, *PAIR, TARGET)
    stored = materialise(bars.where(wanted | (F.col("root") == "S1")))
    anchor = stored.where(F.col("root") == "S1").select("ts", F.col("log_return_1d").alias(ANCHOR))
    # one row a day at most; a join by day would deal all rows out anew, over few keys
    return stored.where(wanted).join(broadcast_if_small(anchor), "ts", "left")


def supplier_rows(spark, sf_dir):
    """Rows that can train or be scored."""
    rows = supplier_table(spark, sf_dir, F.col(TARGET).isNotNull())
    return materialise(rows.select("root", "ts", *PAIR, TARGET, ANCHOR))


def _solve_sql(source: str, keys: str, unknowns: int, name: str) -> str:
    """Gaussian elimination, one step per CTE; column k of `source`'s g_i_j (i <= j) is the right side."""
    k, parts, last = unknowns, [], source
    for s in range(k - 1):
        columns = [f"g_{i}_{j}" for i in range(s + 1) for j in range(i, k + 1)]
        columns += [
            f"g_{i}_{j} - g_{s}_{i} * g_{s}_{j} / g_{s}_{s} AS g_{i}_{j}" for i in range(s + 1, k) for j in range(i, k + 1)
        ]
        parts.append(f"{name}_e{s} AS (SELECT {keys}, n, {', '.join(columns)} FROM {last})")
        last = f"{name}_e{s}"
    for s in reversed(range(k)):
        known = "".join(f" - g_{s}_{j} * b{j}" for j in range(s + 1, k))
        parts.append(f"{name}_b{s} AS (SELECT *, (g_{s}_{k}{known}) / g_{s}_{s} AS b{s} FROM {last})")
        last = f"{name}_b{s}"
    parts.append(f"{name} AS (SELECT * FROM {last})")
    return ",\n".join(parts)


def _fit_sql(name: str, features, keys: str, effects: bool) -> str:
    """CTE `name`: solution b0, b1.. per keys, with med_, mu_, sd_ of each feature; `tr` holds the training rows."""
    p, own = len(features), [f"x{i + 1}" for i in range(len(features))]
    listed = ", ".join(f"{f} AS {x}" for f, x in zip(features, own))
    d = ["1.0", *[f"(({x}i - mu_{x}) / sd_{x})" for x in own], "y"]
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 2)]
    penalty = {(i, i): " + 1" for i in range(1, p + 1)}
    products = ", ".join(f"sum({d[i]} * {d[j]}){penalty.get((i, j), '')} AS h_{i}_{j}" for i, j in pairs)
    gone = ", ".join(f"sum(z{i} * z{j} / (z0 + 1)) AS h_{i}_{j}" for i, j in pairs)
    parts = [
        f"{name}_t AS (SELECT {keys}, root AS rt, y, {listed} FROM tr)",
        f"{name}_m AS (SELECT {keys}, {', '.join(f'median({x}) AS med_{x}' for x in own)} FROM {name}_t GROUP BY ALL)",
        f"{name}_i AS (SELECT t.*, {', '.join(f'coalesce({x}, med_{x}, 0.0) AS {x}i' for x in own)} FROM {name}_t t JOIN {name}_m USING ({keys}))",
        f"{name}_s AS (SELECT {keys}, {', '.join(f'avg({x}i) AS mu_{x}, CASE WHEN var_pop({x}i) > 1e-12 * avg({x}i * {x}i) THEN stddev_pop({x}i) ELSE 1.0 END AS sd_{x}' for x in own)} FROM {name}_i GROUP BY ALL)",
        f"{name}_g0 AS (SELECT {keys}, count(*) AS n, {products} FROM {name}_i JOIN {name}_s USING ({keys}) GROUP BY {keys})",
    ]
    if effects:
        sums = ", ".join(f"sum({c}) AS z{i}" for i, c in enumerate(d))
        parts += [
            f"{name}_z AS (SELECT {keys}, rt, {sums} FROM {name}_i JOIN {name}_s USING ({keys}) GROUP BY {keys}, rt)",
            f"{name}_r AS (SELECT {keys}, {gone} FROM {name}_z GROUP BY {keys})",
            f"{name}_g AS (SELECT {keys}, n, {', '.join(f'a.h_{i}_{j} - r.h_{i}_{j} AS g_{i}_{j}' for i, j in pairs)} "
            f"FROM {name}_g0 a JOIN {name}_r r USING ({keys}))",
        ]
    else:
        parts.append(f"{name}_g AS (SELECT {keys}, n, {', '.join(f'h_{i}_{j} AS g_{i}_{j}' for i, j in pairs)} FROM {name}_g0)")
    parts.append(_solve_sql(f"{name}_g", keys, p + 1, f"{name}_w"))
    parts.append(f"{name} AS (SELECT * FROM {name}_w JOIN {name}_s USING ({keys}) JOIN {name}_m USING ({keys}))")
    return ",\n".join(parts)


_SUPPLIERS_SQL = (
    q.BARS_SU, q.SEGMENTS, q.returns(q.DAYS, (1, 5)), q.labels(q.DAYS, (1,)),
    f"sup AS (SELECT l.root, l.ts, {', '.join('l.' + c for c in PAIR)}, a.log_return_1d AS {ANCHOR}, l.{TARGET} AS y "
    f"FROM lab l LEFT JOIN (SELECT ts, log_return_1d FROM lab WHERE root = 'S1') a USING (ts) WHERE l.{TARGET} IS NOT NULL)",
    FOLDS_SQL,
    "tr AS (SELECT f.fold, s.* FROM sup s JOIN folds f ON s.ts >= f.ts0 AND s.ts < f.ts1)",
    "ev AS (SELECT f.fold, s.* FROM sup s JOIN folds f ON s.ts >= f.es AND s.ts < f.ee)",
)


def _coefficients_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS experiment, fold, '{f}' AS feature, {q.rd(f'b{i + 1}')} AS coefficient, n AS training_rows FROM fit{name}"
        for name, features in SUPPLIER_FEATURES.items() for i, f in enumerate(features)
    )


@register(
    "fold_ridge_coefficients",
    q.query(
        *_SUPPLIERS_SQL, *[_fit_sql(f"fit{n}", f, "fold", True) for n, f in SUPPLIER_FEATURES.items()],
        select=_coefficients_sql(),
    ),
)
def fold_ridge_coefficients(spark, sf_dir):
    """Standardised weights of the pooled A and B ridges, with an effect per supplier, for every expanding fold."""
    ends, start = training_ends(folds_li())
    stats = lin.fold_statistics(supplier_rows(spark, sf_dir), SUPPLIER_FEATURES["B"], TARGET, ends, start)
    out = None
    for name, features in SUPPLIER_FEATURES.items():
        models, _ = lin.fit_pooled(stats, features)
        part = models.select(
            F.lit(name).alias("experiment"), "fold",
            F.explode(F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("coefficients").alias("coefficient"))).alias("_w"),
            "training_rows",
        ).select("experiment", "fold", "_w.*", "training_rows")
        out = part if out is None else out.unionByName(part)
    return report(out)


def _scored_sql(name: str, features) -> str:
    def linear(w: str) -> str:
        return f"{w}.b0" + "".join(
            f" + {w}.b{i + 1} * (coalesce(e.{f}, {w}.med_x{i + 1}, 0.0) - {w}.mu_x{i + 1}) / {w}.sd_x{i + 1}"
            for i, f in enumerate(features)
        )

    # an effect per root: the rest of its sums that the weights leave, over its rows plus alpha
    rest = "z.z{y}".format(y=len(features) + 1) + "".join(f" - w.b{i} * z.z{i}" for i in range(len(features) + 1))
    return f"""eff{name} AS (SELECT z.fold, z.rt AS root, ({rest}) / (z.z0 + 1) AS effect FROM fit{name}_z z JOIN fit{name} w USING (fold)),
sc{name} AS (
  SELECT '{name}' AS experiment, 'pooled' AS model, e.fold, e.y AS a, {linear('w')} + coalesce(x.effect, 0) AS p
  FROM ev e JOIN fit{name} w USING (fold) LEFT JOIN eff{name} x ON x.fold = e.fold AND x.root = e.root UNION ALL
  SELECT '{name}', 'dedicated', e.fold, e.y, {linear('w')} FROM ev e LEFT JOIN own{name} w ON w.fold = e.fold AND w.root = e.root)"""


@register(
    "fold_ridge_errors",
    q.query(
        *_SUPPLIERS_SQL, *[_fit_sql(f"fit{n}", f, "fold", True) for n, f in SUPPLIER_FEATURES.items()],
        *[_fit_sql(f"own{n}", f, "fold, root", False) for n, f in SUPPLIER_FEATURES.items()],
        *[_scored_sql(n, f) for n, f in SUPPLIER_FEATURES.items()],
        "sc AS (" + " UNION ALL ".join(f"SELECT * FROM sc{n}" for n in SUPPLIER_FEATURES) + ")",
        select=f"SELECT experiment, model, fold, count(*) FILTER (WHERE p IS NOT NULL) AS observations, "
        f"{q.rd('avg(abs(a - p))')} AS mae, {q.rd('sqrt(avg((a - p) ** 2))')} AS rmse, "
        f"{q.rd('1 - sum((a - p) ** 2) / (var_pop(a) FILTER (WHERE p IS NOT NULL) * count(*) FILTER (WHERE p IS NOT NULL))', 6)} AS r2 "
        "FROM sc GROUP BY ALL",
    ),
)
def fold_ridge_errors(spark, sf_dir):
    """Pooled and dedicated A and B ridges over supplier roots, scored on every fold's evaluation rows."""
    rows, folds = supplier_rows(spark, sf_dir), folds_li()
    ends, start = training_ends(folds)
    stats = lin.fold_statistics(rows, SUPPLIER_FEATURES["B"], TARGET, ends, start)
    held = materialise(spl.with_evaluation_folds(rows, folds))
    out = None
    for name, features, *models in fitted_experiments(stats, SUPPLIER_FEATURES):
        part = scored_models(held, features, *models).withColumn("experiment", F.lit(name))
        out = part if out is None else out.unionByName(part)
    keys = ["experiment", "model", "fold"]
    table = met.regression_metrics(out.drop("root"), keys, TARGET, "prediction", spearman=False)
    return report(table.select(*keys, "observations", "mae", "rmse", "r2"), special={"r2": 6})


# --- models frozen at a cutoff and followed by the event log ---------------------------------------


def _frozen_sql(name: str, features) -> str:
    p = "w.b0" + "".join(
        f" + w.b{i + 1} * (coalesce(e.{f}, w.med_x{i + 1}, 0.0) - w.mu_x{i + 1}) / w.sd_x{i + 1}" for i, f in enumerate(features)
    )
    return f"fz{name} AS (SELECT '{name}' AS experiment, e.root, e.ts, e.y AS a, {p} AS p FROM ev e JOIN fr{name} w USING (root))"


_CUT = f"TIMESTAMP '{CUTOFF}'"


@register(
    "frozen_model_deltas",
    q.query(
        *_SUPPLIERS_SQL[:5],
        f"tr AS (SELECT * FROM sup WHERE ts < {_CUT})", f"ev AS (SELECT * FROM sup WHERE ts > {_CUT})",
        *[_fit_sql(f"fr{n}", f, "root", False) for n, f in SUPPLIER_FEATURES.items()],
        *[_frozen_sql(n, f) for n, f in SUPPLIER_FEATURES.items()],
        "fz AS (SELECT * FROM fzA UNION ALL SELECT * FROM fzB)",
        f"slow AS (SELECT min(m) AS m FROM (SELECT root, max(ts) AS m FROM lab WHERE ts > {_CUT} GROUP BY root))",
        f"win AS (SELECT CAST(d AS BIGINT) AS days, {_CUT} + d * INTERVAL 1 DAY AS e FROM (VALUES {', '.join(f'({d})' for d in DAYS_AFTER)}) v(d), slow "
        f"WHERE m >= {_CUT} + d * INTERVAL 1 DAY UNION ALL SELECT 0, TIMESTAMP '9999-01-01')",
        """per AS (SELECT days, root, experiment, count(*) AS n, avg(abs(a - p)) AS mae, sqrt(avg((a - p) ** 2)) AS rmse
  FROM fz JOIN win ON ts < e GROUP BY days, root, experiment)""",
        select=f"SELECT days, root, x.n AS observations, {q.rd('y.mae - x.mae')} AS mae_delta, {q.rd('y.rmse - x.rmse')} AS rmse_delta "
        "FROM per x JOIN per y USING (days, root) WHERE x.experiment = 'A' AND y.experiment = 'B'",
    ),
)
def frozen_model_deltas(spark, sf_dir):
    """Dedicated A and B ridges frozen at the cutoff, their logged predictions and outcomes, and B less A per closed window."""
    cutoff, known = moment(CUTOFF), F.col(TARGET).isNotNull()
    rows = supplier_table(spark, sf_dir, known | (F.col("ts") > cutoff))
    sample = materialise(mod.training_sample(
        rows.where((F.col("ts") < cutoff) & known), rows.columns, 100_000, DAY, tile_units=LI_TILE
    ))
    digests = materialise(samp.selected_row_digest(sample))
    stats = lin.fold_statistics(sample, SUPPLIER_FEATURES["B"], TARGET)
    medians = materialise(lin.root_medians(stats, SUPPLIER_FEATURES["B"]))
    tables = [
        fro.frozen_table(lin.fit_per_root(stats, f, medians=medians), f, name, CUTOFF, digests) for name, f in SUPPLIER_FEATURES.items()
    ]
    models, log = scratch_path(spark, "frozen"), scratch_path(spark, "frozen-log")
    fro.freeze(tables[0].unionByName(tables[1]), models)
    inputs = materialise(rows.where(F.col("ts") > cutoff).select(*samp.IDENTITY, *SUPPLIER_FEATURES["B"]))
    scored = fro.score_frozen(inputs, fro.read_frozen(spark, models), SUPPLIER_FEATURES)
    events = pro.prediction_events(scored, F.col("model_id"), TARGET, "v1", moment(NOW))
    eventlog.append_unique_events(events, log)
    outcomes = rows.where((F.col("ts") > cutoff) & known).select(*samp.IDENTITY, TARGET)
    logged = eventlog.read_event_log(spark, log, events.schema)
    eventlog.append_unique_events(pro.attach_outcomes(logged, outcomes, TARGET, moment(NOW)), log)
    done = eventlog.read_event_log(spark, log, events.schema).where(F.col("event_type") == pro.OUTCOME)
    windows = pro.checkpoint_windows(inputs, CUTOFF, DAYS_AFTER)
    table = fro.window_deltas(done, windows, TARGET, metrics=("mae", "rmse"))
    return report(table.select(F.col("days").cast("bigint").alias("days"), "root", "observations", "mae_delta", "rmse_delta"))
