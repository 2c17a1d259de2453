"""Train-fitted preprocessing, exact ridge, boosted trees, sampling studies and importance."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.functions.clock import Clock
from barlab.functions.numeric import finite
from barlab.operators.boosting import BoostedTrees, Boosting, fit_boosting
from barlab.operators.linear import fit_pooled, fold_statistics, pooled_medians
from barlab.operators.metrics import r_squared
from barlab.operators.order_stats import wide_quantiles
from barlab.operators.ranks import add_stable_position
from barlab.operators.sampling import even_sample, even_samples
from barlab.operators.tiles import TILE_UNITS, ordered_index
from barlab.session import broadcast_if_small, materialise

# Fixed value: the penalty of the ridge baseline.
RIDGE_ALPHA = 1.0
SEED = 42

Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Preprocessor:
    """Medians, means and scales learned from training rows only, and the known roots."""

    features: tuple[str, ...]
    medians: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    roots: tuple[str, ...]

    def imputed(self, feature: str) -> Column:
        c = F.col(feature).cast("double")
        return F.when(finite(c), c).otherwise(F.lit(self.medians[feature]))

    def scaled(self, feature: str) -> Column:
        return (self.imputed(feature) - self.means[feature]) / self.scales[feature]

    def is_root(self, root: str) -> Column:
        """1.0 on that root, else 0.0; an unknown root is 0.0 everywhere."""
        return F.coalesce((F.col("root") == root).cast("double"), F.lit(0.0))


def training_medians(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exact interpolated median of the finite training values of each feature."""
    stored = materialise(train.select(*features))
    return wide_quantiles(stored, [], features, linear={"median": 0.5}).select("feature", "median")


def fit_preprocessor(
    train: DataFrame, features: Sequence[str], roots: Sequence[str] | None = None,
    medians: dict[str, float] | None = None,
) -> Preprocessor:
    """Two aggregations: medians, then mean and population deviation of the imputed columns.

    Only one number per feature and the list of roots reach the driver.
    """
    features = tuple(features)
    if medians is None:
        medians = {r["feature"]: r["median"] for r in training_medians(train, features).collect()}
        missing = [f for f in features if f not in medians]
        if missing:
            raise ValueError(f"no finite training value in {missing}")
    if roots is None:
        roots = [r["root"] for r in train.select("root").distinct().orderBy("root").collect()]
    bare = Preprocessor(features, medians, {}, {}, tuple(roots))
    stats = train.select(*[bare.imputed(f).alias(f) for f in features]).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f).alias(f"m_{f}") for f in features],
        *[F.stddev_pop(f).alias(f"s_{f}") for f in features],
    ).first()
    if not stats["n"]:
        raise ValueError("no training rows")
    return Preprocessor(
        features, medians, {f: stats[f"m_{f}"] for f in features},
        {f: stats[f"s_{f}"] or 1.0 for f in features}, tuple(roots),
    )


@dataclass(frozen=True)
class RidgeModel:
    """A fitted ridge. Features are one column expression; root effects, if any, are a table (root, effect)."""

    prep: Preprocessor
    intercept: float
    coefficients: dict[str, float]
    training_rows: int
    effects: DataFrame | None = None

    def column(self) -> Column:
        """The prediction without root effects."""
        terms = [self.prep.scaled(f) * w for f, w in self.coefficients.items()]
        return reduce(lambda a, b: a + b, terms, F.lit(self.intercept))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add `prediction`; a root without training rows adds nothing."""
        if self.effects is None:
            return df.withColumn("prediction", self.column())
        joined = df.join(broadcast_if_small(self.effects.withColumnRenamed("effect", "_effect")), "root", "left")
        total = self.column() + F.coalesce("_effect", F.lit(0.0))
        return joined.withColumn("prediction", total).select(*df.columns, "prediction")

    def weights(self) -> dict[str, float]:
        """All weights by name, for reports: reads the table of root effects."""
        effects = [] if self.effects is None else self.effects.orderBy("root").collect()
        return {**self.coefficients, **{f"root_{r['root']}": r["effect"] for r in effects}}


def fit_ridge(
    train: DataFrame, features: Sequence[str], target: str, alpha: float = RIDGE_ALPHA,
    medians: dict[str, float] | None = None, include_root: bool = True,
) -> RidgeModel:
    """Exact ridge over every training row by sufficient statistics; the intercept is free.

    Rows without a finite target are no training rows. Root indicators are eliminated, see `linear`.
    """
    features = tuple(features)
    if "root" not in train.columns and include_root:
        raise ValueError("root effects need a root column")
    stats = fold_statistics(train, features, target)
    if medians is None:
        found = pooled_medians(stats, features)
        missing = [f for f, m in zip(features, found[0]) if not np.isfinite(m)]
        if missing:
            raise ValueError(f"no finite training value in {missing}")
    else:
        found = {0: np.array([medians[f] for f in features], np.float64)}
    models, effects = fit_pooled(stats, features, alpha, include_root, found)
    row = models.first()
    medians_, means, scales = (dict(zip(features, row[c])) for c in ("medians", "means", "scales"))
    shifted = sum(w * m for w, m in zip(row["weights"], row["means"]))
    return RidgeModel(
        Preprocessor(features, medians_, means, scales, ()), row["intercept"] + shifted,
        dict(zip(features, row["coefficients"])), row["training_rows"],
        materialise(effects.select("root", "effect")) if include_root else None,
    )


def coefficient_table(df: DataFrame, model: RidgeModel, top: int | None = None) -> DataFrame:
    """Weights by falling magnitude with their sign (one row per design column)."""
    rows = df.sparkSession.createDataFrame(list(model.coefficients.items()), "feature string, coefficient double")
    if model.effects is not None:
        rows = rows.unionByName(
            model.effects.select(F.concat(F.lit("root_"), "root").alias("feature"), F.col("effect").alias("coefficient"))
        )
    table = rows.withColumns(
        {
            "sign": F.when(F.col("coefficient") >= 0, "positive").otherwise("negative"),
            "magnitude": F.abs("coefficient"),
        }
    ).orderBy(F.desc("magnitude"), "feature")
    return table if top is None else table.limit(top)


def ridge_by_ml(
    train: DataFrame, prep: Preprocessor, target: str, alpha: float = RIDGE_ALPHA
) -> PipelineModel:
    """The same ridge through pyspark.ml; its penalty is per row and per target deviation."""
    n, deviation = train.agg(F.count(F.lit(1)), F.stddev_pop(target)).first()
    assembled = assemble(train, prep, scaled=True)
    model = LinearRegression(
        featuresCol="features", labelCol=target, solver="normal", standardization=False,
        regParam=alpha / n * deviation, elasticNetParam=0.0,
    ).fit(assembled)
    return PipelineModel(stages=[model])


def assemble(df: DataFrame, prep: Preprocessor, scaled: bool, include_root: bool = True) -> DataFrame:
    """Add the ``features`` vector: imputed (and scaled) columns, then the root indicators."""
    value = prep.scaled if scaled else prep.imputed
    names = [f"_x{i}" for i in range(len(prep.features))]
    hot = [f"_r{i}" for i in range(len(prep.roots))] if include_root else []
    wide = df.select(
        "*",
        *[value(f).alias(n) for f, n in zip(prep.features, names)],
        *[prep.is_root(r).alias(n) for r, n in zip(prep.roots, hot)],
    )
    return VectorAssembler(inputCols=names + hot, outputCol="features").transform(wide).drop(*names, *hot)


def fit_trees(
    train: DataFrame, features: Sequence[str], target: str, include_root: bool = True, **parameters
) -> BoostedTrees:
    """Leaf-wise boosted trees with the baseline's parameters; `parameters` replace fields of `Boosting`."""
    return fit_boosting(train, features, target, replace(Boosting(), **parameters), include_root)


def root_pipeline(numeric: Sequence[str]) -> Pipeline:
    """Root indexing, one-hot coding and assembly as pyspark.ml stages.

    Unknown roots get the last index, which one-hot coding drops, so they are all zero.
    """
    return Pipeline(
        stages=[
            StringIndexer(inputCol="root", outputCol="_root", handleInvalid="keep"),
            OneHotEncoder(inputCol="_root", outputCol="_hot", dropLast=True),
            VectorAssembler(inputCols=[*numeric, "_hot"], outputCol="features"),
        ]
    )


def score(df: DataFrame, models: dict[str, Scorer]) -> DataFrame:
    """Every model on the same rows in one pass: one output row per (row, ``model``)."""
    names, wide = list(df.columns), df
    for i, scorer in enumerate(models.values()):
        wide = scorer(wide).withColumnRenamed("prediction", f"_p{i}").select(
            *names, *[f"_p{j}" for j in range(i + 1)]
        )
    pairs = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(f"_p{i}").alias("prediction"))
          for i, m in enumerate(models)]
    )
    return wide.withColumn("_m", F.explode(pairs)).select(*names, "_m.*")


def training_sample(
    eligible: DataFrame, columns: Sequence[str], cap: int, clock: Clock,
    keys: Sequence[str] = ("root",), tile_units: int = TILE_UNITS,
) -> DataFrame:
    """Narrow eligible training rows, evenly capped per key; rows without a key or time are none.

    Where no key has more rows than the cap, rows are counted but not ordered.
    """
    narrow = eligible.select(*columns).dropna(subset=[*keys, "ts"])
    largest = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= cap:
        return narrow
    return even_sample(narrow, cap, clock, keys, tile_units).drop("group_rows")


def sample_counts(
    eligible: DataFrame, caps: Sequence[int], clock: Clock, tile_units: int = TILE_UNITS
) -> DataFrame:
    """Eligible and selected rows per root for several caps of one source."""
    narrow = eligible.select("root", "ts")
    return even_samples(narrow, caps, clock, tile_units=tile_units).groupBy("cap", "root").agg(
        F.first("group_rows").alias("eligible_rows"), F.count(F.lit(1)).alias("selected_rows")
    )


def permutation_importance(
    sample: DataFrame, features: Sequence[str], target: str, scorer: Scorer, clock: Clock,
    repeats: int = 3, seed: int = SEED, top: int = 15, tile_units: int = TILE_UNITS,
) -> DataFrame:
    """Mean and spread of the R² lost when one feature is shuffled over the sample.

    A repeat shuffles rows once: a join of two numberings of the same rows, by (root, time) and by a seeded hash.
    Every feature in turn takes its value from the row met, so only `repeats` joins of whole rows are shuffled; the
    copies for the single features exist inside a task, between the join and the score. Nothing is permuted on the
    driver.
    """
    features = list(features)
    rows = materialise(
        ordered_index(
            sample.select("ts", "root", *features, target).withColumn("_all", F.lit(0)),
            ["_all"], clock, order=["ts", "root"], tile_units=tile_units,
        ).withColumnRenamed("row_index", "_id").drop("_all", "group_rows")
    )
    baseline = scorer(rows).agg(r_squared(target, "prediction").alias("r2")).first()["r2"]
    tries = materialise(
        rows.select("_id", F.explode(F.array(*[F.lit(i) for i in range(repeats)])).alias("_try"))
        .withColumn("_hash", F.xxhash64(F.lit(seed), "_try", "_id").cast("double"))
    )
    placed = add_stable_position(tries, ["_try"], "_hash", ["_id"], F.col("_id"))
    donors = rows.select(F.col("_id").alias("_from"), *[F.col(f).alias(f"_d{i}") for i, f in enumerate(features)])
    met = (
        placed.select("_id", "_try", F.col("position").alias("_from"))
        .join(donors, "_from").join(rows, "_id")
        .withColumn("_f", F.explode(F.array(*[F.lit(i) for i in range(len(features))])))
    )
    shuffled = met.select(
        "_f", "_try", "root", target,
        *[F.when(F.col("_f") == i, F.col(f"_d{i}")).otherwise(F.col(f)).alias(f) for i, f in enumerate(features)],
    )
    drops = scorer(shuffled).groupBy("_f", "_try").agg(
        (F.lit(baseline) - r_squared(target, "prediction")).alias("drop")
    )
    named = F.get(F.array(*[F.lit(f) for f in features]), F.col("_f"))
    return (
        drops.groupBy(named.alias("feature"))
        .agg(F.avg("drop").alias("mean_r2_decrease"), F.stddev_pop("drop").alias("standard_deviation"))
        .orderBy(F.desc("mean_r2_decrease"), "feature")
        .limit(top)
    )
