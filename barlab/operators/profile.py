"""Distribution profiles, drift, regimes, sampled ranges and trimmed histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.functions.clock import Clock
from barlab.functions.numeric import finite, safe_ratio
from barlab.operators.order_stats import wide_quantiles
from barlab.operators.sampling import every_nth, pooled_even_sample
from barlab.operators.tiles import TILE_UNITS
from barlab.session import broadcast_if_small, materialise

REGIMES = ("low", "medium", "high", "unavailable")


def long_features(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, value) rows; only the named columns are read."""
    narrow = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features])
    return narrow.unpivot(list(keys), list(features), "feature", "value")


def distribution_profile(
    df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Rows, finite rows, missing rate, exact quartiles and spread of each feature.

    All features are counted side by side on the wide rows, which are stored once.
    """
    by = [*keys, "feature"]
    rows = materialise(df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]))
    pairs = [
        F.struct(F.lit(f).alias("feature"), F.count_if(finite(F.col(f))).alias("finite_observations"))
        for f in features
    ]
    counts = (
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), F.array(*pairs).alias("_f"))
        .where("observations > 0")
        .select(*keys, "observations", F.inline("_f"))
    )
    found = wide_quantiles(
        rows, keys, features, nearest={"q1": 0.25, "q3": 0.75}, linear={"median": 0.5}
    ).drop("finite_rows")
    return counts.join(found, by, "left").select(
        *by,
        "observations",
        "finite_observations",
        (1 - F.col("finite_observations") / F.col("observations")).alias("missing_rate"),
        "q1",
        "median",
        "q3",
        (F.col("q3") - F.col("q1")).alias("iqr"),
    )


def drift_profile(
    history: DataFrame, recent: DataFrame, keys: Sequence[str] = (), spans: Sequence[str] = ()
) -> DataFrame:
    """Two profiles side by side; the shift is in units of the historical spread.

    With ``spans`` (further keys of ``recent`` only, a handful of windows) each of their values meets the whole history.
    """
    by = [*keys, "feature"]
    picked = ("median", "iqr", "missing_rate")
    old = history.select(*by, *[F.col(c).alias(f"historical_{c}") for c in picked])
    new = recent.select(*spans, *by, *[F.col(c).alias(f"prospective_{c}") for c in picked])
    shift = F.when(
        F.col("historical_iqr") > 0,
        safe_ratio(F.col("prospective_median") - F.col("historical_median"), F.col("historical_iqr")),
    )
    if spans:
        seen = recent.select(*spans).distinct().collect()
        listed = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in spans]) for r in seen])
        old = old.withColumn("_span", F.explode(listed)) if seen else old.withColumn("_span", F.lit(None)).limit(0)
        old = old.select(*[(F.col(f"_span.{c}") if seen else F.lit(None).cast(recent.schema[c].dataType)).alias(c) for c in spans], *by,
                         *[f"historical_{c}" for c in picked])
        by = [*spans, *by]
    return old.join(new, by, "left").withColumn("median_shift_in_historical_iqr", shift)


def tertiles(df: DataFrame, column: str, keys: Sequence[str] = ("root",)) -> DataFrame:
    """Nearest-rank 1/3 and 2/3 points of the finite values of each key."""
    points = {"low_max": 1 / 3, "medium_max": 2 / 3}
    rows = materialise(df.select(*keys, column))
    return wide_quantiles(rows, keys, [column], nearest=points).drop("feature", "finite_rows")


def regime(value: Column, low_max: Column, medium_max: Column) -> Column:
    usable = finite(value) & low_max.isNotNull()
    return (
        F.when(usable & (value <= low_max), "low")
        .when(usable & (value <= medium_max), "medium")
        .when(usable, "high")
        .otherwise("unavailable")
    )


def with_regime(
    df: DataFrame, thresholds: DataFrame, column: str, keys: Sequence[str] = ("root",)
) -> DataFrame:
    """Add ``regime`` from per-key thresholds learned elsewhere."""
    return (
        df.join(broadcast_if_small(thresholds), list(keys), "left")
        .withColumn("regime", regime(F.col(column), F.col("low_max"), F.col("medium_max")))
        .drop("low_max", "medium_max")
    )


def sampled_ranges(
    df: DataFrame, features: Sequence[str], step: int, clock: Clock, tile_units: int = TILE_UNITS
) -> DataFrame:
    """Minimum, 1 %, median, 99 % and maximum of each feature over every ``step``-th row per root."""
    sample = every_nth(df.select("root", "ts", *features), step, clock, tile_units=tile_units)
    return wide_quantiles(
        materialise(sample.select(*features)), [], features, nearest={"p01": 0.01, "p99": 0.99},
        linear={"median": 0.5}, ends={"minimum": 0, "maximum": -1},
    )


def linear_quantiles(df: DataFrame, column: str, at: Sequence[float]) -> list[float]:
    """A few interpolated quantiles of one column, as driver numbers (pass stored rows)."""
    names = {f"q{i}": q for i, q in enumerate(at)}
    row = wide_quantiles(df, [], [column], linear=names).first()
    if row is None:
        raise ValueError(f"{column} has no finite value")
    return [row[n] for n in names]


def trimmed_histogram(
    df: DataFrame, column: str, bins: int = 100, low: float = 0.005, high: float = 0.995
) -> DataFrame:
    """Equal-width counts of the values between two quantiles; the last bin includes its edge."""
    values = materialise(df.where(finite(F.col(column))).select(column))
    lo, hi = linear_quantiles(values, column, [low, high])
    kept = values.where(F.col(column).between(lo, hi))
    least, most = kept.agg(F.min(column), F.max(column)).first()
    width = (most - least) / bins
    if width == 0:
        slot = F.lit(0).cast("bigint")
    else:
        slot = F.least(F.floor((F.col(column) - least) / width), F.lit(bins - 1)).cast("bigint")
    counts = kept.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    return (
        df.sparkSession.range(bins).withColumnRenamed("id", "bin")
        .join(counts, "bin", "left")
        .select(
            "bin",
            (F.lit(least) + F.col("bin") * width).alias("lower"),
            (F.lit(least) + (F.col("bin") + 1) * width).alias("upper"),
            F.coalesce("rows", F.lit(0)).alias("rows"),
        )
    )


def clipped_scatter(
    df: DataFrame, actual: str, predicted: str, cap: int, clock: Clock,
    low: float = 0.005, high: float = 0.995, tile_units: int = TILE_UNITS,
) -> DataFrame:
    """An even sample of (predicted, actual) points, both clipped to their central quantiles."""
    rows = materialise(
        df.where(finite(F.col(actual)) & finite(F.col(predicted))).select("root", "ts", actual, predicted)
    )
    sample = pooled_even_sample(rows, cap, clock, tile_units)
    for column in (actual, predicted):
        lo, hi = linear_quantiles(rows, column, [low, high])
        sample = sample.withColumn(column, F.least(F.greatest(F.col(column), F.lit(lo)), F.lit(hi)))
    return sample
