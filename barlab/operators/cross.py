"""Cross-market context: exact-time anchor returns, relative returns and experiment views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.functions.clock import Clock
from barlab.operators.features import own_feature_names
from barlab.operators.labels import direction_name, label_names

ANCHOR_HORIZONS = (1, 5, 15)


def anchor_columns(clock: Clock, anchors: Sequence[str]) -> list[str]:
    return [clock.name(f"{a}_return", h) for a in anchors for h in ANCHOR_HORIZONS]


def relative_columns(clock: Clock, anchors: Sequence[str]) -> list[str]:
    return [f"relative_to_{c}" for c in anchor_columns(clock, anchors)]


def spread_name(clock: Clock, anchors: Sequence[str]) -> str:
    return clock.name(f"{anchors[0]}_{anchors[1]}_return_spread", 5)


def anchor_table(returns: DataFrame, clock: Clock, anchors: Sequence[str]) -> DataFrame:
    """One row per timestamp on which any anchor traded; the others stay null (no as-of fill)."""
    first, second = (F.col(clock.name(f"{a}_return", 5)) for a in anchors[:2])
    return (
        returns.where(F.col("root").isin(*anchors))
        .groupBy("ts")
        .agg(
            *[
                F.max(F.when(F.col("root") == a, F.col(clock.name("log_return", h)))).alias(
                    clock.name(f"{a}_return", h)
                )
                for a in anchors
                for h in ANCHOR_HORIZONS
            ]
        )
        .withColumn(spread_name(clock, anchors), first - second)
    )


def add_cross_market(df: DataFrame, anchors: DataFrame) -> DataFrame:
    """Attach the anchor row of exactly the same timestamp."""
    return df.join(anchors, "ts", "left")


def add_relative_returns(df: DataFrame, clock: Clock, anchors: Sequence[str]) -> DataFrame:
    """Own return minus anchor return; null if either is missing, 0 for an anchor itself."""
    return df.withColumns(
        {
            f"relative_to_{clock.name(f'{a}_return', h)}": F.col(clock.name("log_return", h))
            - F.col(clock.name(f"{a}_return", h))
            for a in anchors
            for h in ANCHOR_HORIZONS
        }
    )


def experiment_features(experiment: str, clock: Clock, anchors: Sequence[str]) -> list[str]:
    """Matrix columns: A own features, B plus raw anchors, C plus relative anchors."""
    own = own_feature_names(clock)
    extra = {
        "A": [],
        "B": anchor_columns(clock, anchors),
        "C": relative_columns(clock, anchors),
    }
    if experiment not in extra:
        raise ValueError(f"unknown experiment {experiment!r}")
    return own + extra[experiment]


def experiment_view(
    df: DataFrame,
    experiment: str,
    clock: Clock,
    anchors: Sequence[str],
    target: str,
    metadata: Sequence[str] = ("ts", "root"),
) -> DataFrame:
    """Project the common table onto one experiment's matrix."""
    columns = experiment_features(experiment, clock, anchors)
    viewed = add_relative_returns(df, clock, anchors) if experiment == "C" else df
    return viewed.select(*metadata, *columns, target)


def check_feature_columns(features: Sequence[str], clock: Clock) -> None:
    """Refuse labels and the diagnostic direction as model inputs."""
    banned = sorted(set(features) & {*label_names(clock), direction_name(clock)})
    if banned:
        raise ValueError(f"label columns cannot be features: {banned}")
