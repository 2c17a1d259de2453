"""Regression metrics, prediction deciles and naive baselines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.clock import Clock, floor_div, micros
from barlab.functions.numeric import finite, finite_or_null, safe_ratio
from barlab.operators.ranks import (
    add_average_ranks,
    add_short_average_ranks,
    add_stable_position,
    equal_bucket,
    quantiles,
    with_part,
)
from barlab.operators.tiles import TILE_UNITS
from barlab.session import materialise

METRIC_NAMES = ("mae", "rmse", "r2", "pearson", "spearman", "direction_accuracy")
POOLED = "ALL"


def naive_predictions(df: DataFrame, last_return: str) -> DataFrame:
    """One row per (row, naive model): zero, persistence and reversal of the last return."""
    r = F.col(last_return)
    models = F.array(
        F.struct(F.lit("zero").alias("model"), F.lit(0.0).alias("prediction")),
        F.struct(F.lit("persistence").alias("model"), r.alias("prediction")),
        F.struct(F.lit("reversal").alias("model"), (-r).alias("prediction")),
    )
    return df.withColumn("_m", F.explode(models)).select("*", "_m.*").drop("_m")


def finite_pairs(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.where(finite(F.col(actual)) & finite(F.col(predicted)))


def varies(x: str | Column) -> Column:
    """Whether a group holds two different values. Merged moments cannot tell: a constant's mean is rounded, which
    leaves a spread of some 1e-30."""
    return F.min(x) < F.max(x)


def correlation(x: str, y: str) -> Column:
    """Population correlation; null for fewer than two rows or zero spread."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(varies(x) & varies(y), safe_ratio(F.covar_pop(x, y), spread))


def r_squared(actual: str, predicted: str) -> Column:
    """1 - SSE/SST; for a constant actual 1 if the fit is perfect, else 0; null below two rows."""
    error = F.sum((F.col(actual) - F.col(predicted)) ** 2)
    total = F.var_pop(actual) * F.count(F.lit(1))
    flat = F.when(error == 0, 1.0).otherwise(0.0)
    return F.when(F.count(F.lit(1)) > 1, F.when(varies(actual) & (total > 0), 1 - error / total).otherwise(flat))


def moment_state(df: DataFrame, keys: Sequence[str], actual: str, predicted: str, *also: Column) -> DataFrame:
    """Sums of each group's finite pairs that can be merged: rows, errors, means, and sums of squares about them.

    Groups without a pair have 0 rows and null sums. ``also`` names further aggregates of the same pass.
    """
    pair = finite(F.col(actual)) & finite(F.col(predicted))
    a, p = F.when(pair, F.col(actual)), F.when(pair, F.col(predicted))
    n = F.count(a)
    return df.groupBy(*keys).agg(
        n.alias("observations"),
        F.sum(F.abs(a - p)).alias("absolute"),
        F.sum((a - p) ** 2).alias("squared"),
        F.sum((F.signum(a) == F.signum(p)).cast("double")).alias("same_sign"),
        F.avg(a).alias("mean_a"),
        F.avg(p).alias("mean_p"),
        (F.var_pop(a) * n).alias("spread_a"),
        (F.var_pop(p) * n).alias("spread_p"),
        (F.covar_pop(a, p) * n).alias("joint"),
        *[f(c).alias(f"{name}_{of}") for of, c in (("a", a), ("p", p)) for name, f in (("low", F.min), ("high", F.max))],
        *also,
    )


def merged_state(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of finer groups added up: sums of squares are moved to the common mean."""
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    n = F.col("observations")

    def shift(mean: str) -> Column:
        return F.col(mean) - safe_ratio(F.sum(n * F.col(mean)).over(whole), F.sum(n).over(whole).cast("double"))

    rows = state.withColumns({"_a": shift("mean_a"), "_p": shift("mean_p")})
    return rows.groupBy(*keys).agg(
        F.sum(n).alias("observations"),
        *[F.sum(c).alias(c) for c in ("absolute", "squared", "same_sign")],
        *[safe_ratio(F.sum(n * F.col(m)), F.sum(n).cast("double")).alias(m) for m in ("mean_a", "mean_p")],
        F.sum(F.col("spread_a") + n * F.col("_a") ** 2).alias("spread_a"),
        F.sum(F.col("spread_p") + n * F.col("_p") ** 2).alias("spread_p"),
        F.sum(F.col("joint") + n * F.col("_a") * F.col("_p")).alias("joint"),
        *[f(f"{name}_{of}").alias(f"{name}_{of}") for of in "ap" for name, f in (("low", F.min), ("high", F.max))],
    )


def state_metrics(state: DataFrame, keys: Sequence[str], *also: str) -> DataFrame:
    """The metric columns, but for Spearman, of merged or single states; ``also`` names columns to keep behind them."""
    n = F.col("observations")
    flat = F.when(F.col("squared") == 0, 1.0).otherwise(0.0)
    # zero for a constant, whatever rounding its merged moments have left
    spread_a, spread_p = (F.when(F.col(f"low_{of}") < F.col(f"high_{of}"), F.col(f"spread_{of}")).otherwise(0.0) for of in "ap")
    return state.select(
        *keys,
        n,
        safe_ratio(F.col("absolute"), n).alias("mae"),
        F.sqrt(safe_ratio(F.col("squared"), n)).alias("rmse"),
        F.when(n > 1, F.when(spread_a > 0, 1 - F.col("squared") / spread_a).otherwise(flat)).alias("r2"),
        F.when(n > 1, safe_ratio(F.col("joint"), F.sqrt(spread_a) * F.sqrt(spread_p))).alias("pearson"),
        safe_ratio(F.col("same_sign"), n).alias("direction_accuracy"),
        *also,
    )


def with_spearman(table: DataFrame, narrow: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Add the correlation of exact average ranks (see ``ranks``) of the stored pairs."""
    if not keys:
        # all rows are one group
        one = F.lit(0)
        return with_spearman(
            table.withColumn("_all", one), narrow.withColumn("_all", one), ["_all"], actual, predicted
        ).drop("_all")
    pairs = finite_pairs(narrow, actual, predicted)
    ranked = add_average_ranks(pairs, keys, {actual: "_rank_a", predicted: "_rank_p"})
    found = ranked.groupBy(*keys).agg(correlation("_rank_a", "_rank_p").alias("spearman"))
    left, right = table.alias("g"), found.alias("f")
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    return left.join(right, reduce(Column.__and__, same), "left").select("g.*", F.col("f.spearman").alias("spearman"))


def regression_metrics(
    df: DataFrame, keys: Sequence[str], actual: str, predicted: str, spearman: bool = True, short: bool = False
) -> DataFrame:
    """The metric row of each group, over finite pairs only.

    All moments come from one partially aggregated pass; for Spearman the narrow pairs are stored once and read from
    there. A group without finite pairs has 0 observations and null metrics. ``short`` says that a task may hold any
    group, whatever their number: ranks are then told inside it in the same pass, and nothing is stored.
    """
    keys = list(keys)
    narrow = df.select(*keys, actual, predicted)
    if spearman and short:
        ranked = add_short_average_ranks(narrow, keys, {actual: "_rank_a", predicted: "_rank_p"})
        found = correlation("_rank_a", "_rank_p").alias("spearman")
        return state_metrics(moment_state(ranked, keys, actual, predicted, found), keys, "spearman")
    if spearman:
        narrow = materialise(with_part(narrow))
    table = state_metrics(moment_state(narrow, keys, actual, predicted), keys)
    return with_spearman(table, narrow, keys, actual, predicted) if spearman else table


def evaluate(
    df: DataFrame, keys: Sequence[str], actual: str, predicted: str, by: str = "root"
) -> DataFrame:
    """Metrics per group value and pooled (``scope`` = group value or ALL).

    Rows are stored once; the pooled moments are merged from those of the groups.
    """
    keys, scoped = list(keys), [*keys, "scope"]
    narrow = materialise(with_part(df.select(*keys, F.col(by).alias("scope"), actual, predicted)))
    state = moment_state(narrow, scoped, actual, predicted)
    pooled = state_metrics(merged_state(state, keys), keys)
    each = with_spearman(state_metrics(state, scoped), narrow, scoped, actual, predicted)
    whole = with_spearman(pooled, narrow, keys, actual, predicted).withColumn("scope", F.lit(POOLED))
    return each.unionByName(whole.select(each.columns))


def macro_average(per_group: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unweighted mean over groups of each finite metric."""
    return per_group.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"),
        *[F.avg(finite_or_null(F.col(m))).alias(m) for m in METRIC_NAMES if m in per_group.columns],
    )


def with_decile(
    df: DataFrame,
    keys: Sequence[str],
    predicted: str,
    clock: Clock,
    tie_order: Sequence[str] = ("root", "ts"),
    buckets: int = 10,
    tile_units: int = TILE_UNITS,
) -> DataFrame:
    """Near-equal prediction buckets; equal predictions keep root-then-time order."""
    tile = F.struct(F.col(tie_order[0]), floor_div(micros(F.col(tie_order[-1])), clock.span(tile_units)))
    placed = add_stable_position(df, keys, predicted, tie_order, tile)
    return placed.withColumn(
        "decile", equal_bucket(F.col("position"), F.col("group_rows"), buckets)
    ).drop("position", "group_rows")


def prediction_deciles(
    df: DataFrame, keys: Sequence[str], actual: str, predicted: str, clock: Clock,
    tie_order: Sequence[str] = ("root", "ts"), tile_units: int = TILE_UNITS,
) -> DataFrame:
    """Rows, mean prediction, mean and exact median outcome of each prediction decile.

    A group of fewer than ten rows has deciles with 0 observations and null values.
    """
    keys = list(keys)
    pairs = finite_pairs(df, actual, predicted).select(*dict.fromkeys([*keys, *tie_order, actual, predicted]))
    rows = materialise(
        with_decile(materialise(with_part(pairs)), keys, predicted, clock, tie_order, tile_units=tile_units)
        .select(*keys, "decile", actual, predicted, "_part")
    )
    means = rows.groupBy(*keys, "decile").agg(
        F.count(F.lit(1)).alias("observations"),
        F.avg(predicted).alias("mean_prediction"),
        F.avg(actual).alias("mean_actual"),
    )
    medians = quantiles(rows, [*keys, "decile"], actual, linear={"median_actual": 0.5})
    found = means.join(medians.drop("finite_rows"), [*keys, "decile"])
    # all ten of a group stand on one row, so that missing ones need no second look at the groups
    values = ("observations", "mean_prediction", "mean_actual", "median_actual")
    listed = found.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("decile", F.struct(*values)))).alias("_found")
    )
    every = listed.withColumn("decile", F.explode(F.sequence(F.lit(1), F.lit(10)))).withColumn(
        "_own", F.try_element_at("_found", F.col("decile"))
    )
    return every.select(
        *keys, "decile", F.coalesce("_own.observations", F.lit(0).cast("bigint")).alias("observations"),
        *[F.col(f"_own.{v}").alias(v) for v in values[1:]],
    )


def decile_summary(deciles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Top, bottom, spread, order correlation and monotonicity over the ten decile means."""
    keys = list(keys)
    group = Window.partitionBy(*keys)
    by_mean = group.orderBy("mean_actual")
    ranked = deciles.where("observations > 0").withColumns(
        {
            "_rank": F.rank().over(by_mean)
            + (F.count(F.lit(1)).over(Window.partitionBy(*keys, "mean_actual")) - 1) / 2,
            "_step": F.col("mean_actual") - F.lag("mean_actual").over(group.orderBy("decile")),
            "_decile": F.col("decile").cast("double"),
        }
    )
    top = F.max(F.when(F.col("decile") == 10, F.col("mean_actual")))
    bottom = F.max(F.when(F.col("decile") == 1, F.col("mean_actual")))
    return ranked.groupBy(*keys).agg(
        top.alias("top_decile_mean_actual"),
        bottom.alias("bottom_decile_mean_actual"),
        (top - bottom).alias("top_minus_bottom"),
        correlation("_decile", "_rank").alias("decile_order_spearman"),
        F.bool_and(F.coalesce(F.col("_step") >= 0, F.lit(True))).alias("fully_non_decreasing"),
    )
