"""Raw fixed-point bar records to canonical bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICE_SCALE = 1_000_000_000


def canonical_bars(
    raw: DataFrame, root: Column, price_scale: int = PRICE_SCALE, event_nanos: str = "ts_event"
) -> DataFrame:
    """Nanosecond event times and scaled integer prices to (root, ts, instrument, OHLCV)."""
    return raw.select(
        F.timestamp_micros(F.call_function("div", F.col(event_nanos), F.lit(1000))).alias("ts"),
        root.cast("string").alias("root"),
        F.col("instrument_id").cast("long").alias("instrument_id"),
        *[(F.col(c).cast("double") / float(price_scale)).alias(c) for c in ("open", "high", "low", "close")],
        F.col("volume").cast("long").alias("volume"),
    )


def union_records(*parts: DataFrame) -> DataFrame:
    """Stack record chunks by column name."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first
