"""Stability of metrics across folds, comparisons of models, and count reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.numeric import finite, finite_or_null
from barlab.operators.metrics import METRIC_NAMES, decile_summary


def long_metrics(
    table: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRIC_NAMES
) -> DataFrame:
    """(keys, metric, value) rows from one column per metric."""
    return table.select(*keys, *metrics).unpivot(list(keys), list(metrics), "metric", "value")


def summary_columns(value: str, suffix: str = "") -> list[Column]:
    """Mean, median, population deviation, range and sign counts of the finite values.

    Meant for one value per fold: the exact median holds a fold list, not data rows.
    """
    v = finite_or_null(F.col(value))
    return [
        F.avg(v).alias(f"mean{suffix}"),
        F.median(v).alias(f"median{suffix}"),
        F.stddev_pop(v).alias(f"standard_deviation{suffix}"),
        F.min(v).alias(f"minimum{suffix}"),
        F.max(v).alias(f"maximum{suffix}"),
        F.count_if(v > 0).alias(f"positive_folds{suffix}"),
        F.count(v).alias(f"finite_folds{suffix}"),
    ]


def metric_stability(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One summary row per keys and metric over the folds."""
    return long.groupBy(*keys, "metric").agg(*summary_columns("value"))


def root_ranks(per_root: DataFrame, keys: Sequence[str], root: str = "root") -> DataFrame:
    """Rank roots by finite Pearson, best first, missing last, name as tie-break."""
    best = F.desc_nulls_last(finite_or_null(F.col("pearson")))
    order = Window.partitionBy(*keys).orderBy(best, root)
    return per_root.withColumn("rank", F.row_number().over(order))


def root_stability(
    per_root: DataFrame, keys: Sequence[str] = ("model",), fold: str = "fold", root: str = "root"
) -> DataFrame:
    """Pearson/Spearman summaries and rank behaviour of each root across folds."""
    ranked = root_ranks(per_root, [*keys, fold], root)
    return ranked.groupBy(*keys, root).agg(
        *summary_columns("pearson", "_pearson"),
        *summary_columns("spearman", "_spearman"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(fold, "rank"))), lambda x: x["rank"].cast("string")),
            ",",
        ).alias("ranks"),
        F.avg("rank").alias("average_rank"),
        F.stddev_pop("rank").alias("rank_standard_deviation"),
        F.min("rank").alias("best_rank"),
        F.max("rank").alias("worst_rank"),
    )


def paired_deltas(
    table: DataFrame, keys: Sequence[str], by: str, challenger: str, incumbent: str,
    metrics: Sequence[str] = ("pearson", "spearman", "r2"),
) -> DataFrame:
    """challenger - incumbent for each metric, one row per key (one conditional aggregation)."""
    def side(metric: str, name: str) -> Column:
        return F.max(F.when(F.col(by) == name, F.col(metric)))

    return table.where(F.col(by).isin(challenger, incumbent)).groupBy(*keys).agg(
        *[(side(m, challenger) - side(m, incumbent)).alias(f"{m}_delta") for m in metrics]
    )


def comparison_summary(
    deltas: DataFrame, keys: Sequence[str] = (),
    metrics: Sequence[str] = ("pearson", "spearman", "r2"),
) -> DataFrame:
    """Delta summaries per metric plus how often each side wins."""
    long = long_metrics(deltas, list(keys), [f"{m}_delta" for m in metrics])
    return long.groupBy(*keys, "metric").agg(
        *summary_columns("value"),
        F.count_if(F.col("value") > 0).alias("challenger_wins"),
        F.count_if(F.col("value") < 0).alias("incumbent_wins"),
    )


def decile_stability(deciles: DataFrame, keys: Sequence[str], fold: str = "fold") -> DataFrame:
    """Order correlation, spread and monotonicity of the deciles across folds."""
    per_fold = decile_summary(deciles, [*keys, fold])
    return per_fold.groupBy(*keys).agg(
        *summary_columns("decile_order_spearman", "_ordering"),
        *summary_columns("top_minus_bottom", "_spread"),
        F.count_if("fully_non_decreasing").alias("fully_non_decreasing_folds"),
        F.count_if(F.col("top_minus_bottom") > 0).alias("positive_spread_folds"),
    )


def count_mismatches(
    declared: DataFrame, observed: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Keys on which the two tables disagree or that only one of them has. Must be empty."""
    d = declared.select(*keys, *[F.col(c).alias(f"declared_{c}") for c in columns])
    o = observed.select(*keys, *[F.col(c).alias(f"observed_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"declared_{c}").eqNullSafe(F.col(f"observed_{c}"))
    return d.join(o, list(keys), "full").where(~same)


def require_empty(df: DataFrame, message: str) -> None:
    """Stop with up to five offending rows when a must-be-empty check is not empty."""
    offending = df.limit(5).collect()
    if offending:
        raise RuntimeError(f"{message}: {offending}")


def best_by_metric(table: DataFrame, keys: Sequence[str], candidate: str, metric: str = "pearson") -> DataFrame:
    """The candidate with the largest finite metric of each key."""
    usable = table.where(finite(F.col(metric)))
    return usable.groupBy(*keys).agg(
        F.max_by(candidate, F.struct(metric, candidate)).alias(f"best_{candidate}"),
        F.max(metric).alias(f"best_{metric}"),
    )
