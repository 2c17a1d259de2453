"""Exact-clock future-return labels and the full own-market table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barlab.functions.clock import Clock
from barlab.functions.numeric import log_ratio
from barlab.operators.features import (
    Family,
    Steps,
    add_families,
    close_at,
    context_rows,
    own_families,
)
from barlab.operators.tiles import BLOCK_ROWS

LABEL_HORIZONS = (1, 5, 15)


def label_names(clock: Clock, horizons: Sequence[int] = LABEL_HORIZONS) -> list[str]:
    return [clock.name("future_return", h) for h in horizons]


def direction_name(clock: Clock) -> str:
    return clock.name("direction", 5)


def direction(c: Column) -> Column:
    """UP, DOWN, or null for an unchanged or missing return."""
    return F.when(c > 0, "UP").when(c < 0, "DOWN")


def labels(clock: Clock, horizons: Sequence[int] = LABEL_HORIZONS) -> Family:
    """Exact-clock future returns and, with the five-unit one, its direction."""
    def steps(w: WindowSpec) -> Steps:
        named = {h: clock.name("future_return", h) for h in horizons}
        five = {direction_name(clock): direction(F.col(named[5]))} if 5 in named else {}
        return [
            {f"_next_{h}": close_at(w, clock.span(h)) for h in horizons},
            {name: log_ratio(F.col(f"_next_{h}"), F.col("close")) for h, name in named.items()},
            five,
        ]

    return steps


def add_future_labels(
    bars: DataFrame, clock: Clock, horizons: Sequence[int] = LABEL_HORIZONS, size: int = BLOCK_ROWS
) -> DataFrame:
    """ln(close[t + h] / close[t]); the later bar must exist in the same segment."""
    return add_families(bars, [labels(clock, horizons)], 0, max(horizons), size)


def build_labelled_features(bars: DataFrame, clock: Clock, size: int = BLOCK_ROWS) -> DataFrame:
    """Own features and labels together: one exchange, one sort, look-back and look-ahead rows."""
    families = [*own_families(clock), labels(clock)]
    return add_families(bars, families, context_rows(), max(LABEL_HORIZONS), size)
