"""Fitted models as a stored table that is written once, scored by a join, and compared per closed window."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.operators.linear import BROADCAST_BYTES, linear_prediction
from barlab.operators.metrics import regression_metrics
from barlab.operators.prospective import rows_by_window
from barlab.operators.stability import paired_deltas
from barlab.session import broadcast_if_small

FROZEN = (
    "model_id", "root", "experiment", "cutoff", "training_rows", "row_digest", "intercept", "position", "feature",
    "weight", "median", "mean", "scale",
)


def frozen_table(
    models: DataFrame, features: Sequence[str], experiment: str, cutoff: datetime, digests: DataFrame
) -> DataFrame:
    """One row per model and feature of the models of single roots (see ``linear.fit_per_root``).

    ``digests`` holds (root, digest) of the rows that were fitted, see ``sampling.selected_row_digest``.
    """
    cells = F.arrays_zip(
        F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("weights").alias("weight"),
        F.col("medians").alias("median"), F.col("means").alias("mean"), F.col("scales").alias("scale"),
    )
    at = F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz").cast("timestamp")
    return (
        models.join(digests.select("root", F.col("digest").alias("row_digest")), "root", "left")
        .select(
            F.concat_ws("-", "root", F.lit(experiment), F.lit("final")).alias("model_id"), "root",
            F.lit(experiment).alias("experiment"), at.alias("cutoff"), "training_rows", "row_digest", "intercept",
            F.posexplode(cells).alias("position", "_c"),
        )
        .select(*FROZEN[:8], "_c.*")
    )


def freeze(table: DataFrame, path: str) -> None:
    """Store the models; a second freeze at the same place is refused."""
    table.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def read_frozen(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def score_frozen(rows: DataFrame, frozen: DataFrame, features: dict[str, Sequence[str]]) -> DataFrame:
    """Every row once per model of its root: the row's columns, ``model_id`` and ``prediction``.

    ``features`` lists each experiment's columns in the order they were frozen in. Rows of roots without a model give
    no row.
    """
    ordered = F.array_sort(F.collect_list(F.struct("position", "weight", "median")))
    wide = frozen.groupBy("model_id", "root", "experiment").agg(
        F.first("intercept").alias("intercept"), ordered.alias("_cells")
    ).select(
        "model_id", "root", "experiment", "intercept", F.col("_cells.weight").alias("weights"),
        F.col("_cells.median").alias("medians"),
    )
    out = None
    for experiment, columns in features.items():
        own = wide.where(F.col("experiment") == experiment).drop("experiment")
        few = max(1, BROADCAST_BYTES // (32 * max(1, len(columns))))
        part = rows.join(broadcast_if_small(own, few), "root").withColumn("prediction", linear_prediction(columns))
        part = part.select(*rows.columns, "model_id", "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def window_deltas(
    completed: DataFrame, windows: DataFrame, target: str, keys: Sequence[str] = ("root",),
    challenger: str = "B", incumbent: str = "A",
    metrics: Sequence[str] = ("mae", "rmse", "r2", "pearson", "direction_accuracy"), spearman: bool = False,
) -> DataFrame:
    """(days, keys, observations, <metric>_delta): challenger less incumbent on the outcomes of each closed window.

    ``completed`` holds outcome events whose ``model_id`` is <root>-<experiment>-final. Days 0 are all outcomes so far.
    """
    rows = rows_by_window(completed, windows, whole=True).withColumn(
        "experiment", F.element_at(F.split("model_id", "-"), -2)
    )
    by = ["days", *keys]
    table = regression_metrics(rows, [*by, "experiment"], target, "prediction", spearman=spearman)
    if spearman:
        metrics = [*metrics, "spearman"]
    counts = table.where(F.col("experiment") == incumbent).select(*by, "observations")
    return counts.join(paired_deltas(table, by, "experiment", challenger, incumbent, metrics), by)
