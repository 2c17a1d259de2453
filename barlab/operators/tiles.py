"""Ordered work in bounded pieces.

A root may hold a third of all rows, so no window here is ever partitioned by root (or by
contract segment) alone. Two cuts are used instead:

* **time tiles**: ``(keys, floor(t / tile))``. One bar per clock unit means a tile never holds
  more rows than it has units. Running values cross tiles through a summary with one row per
  tile (a prefix over the summary, joined back on the tile key).
* **row blocks with context**: ``(root, segment, floor(segment_row / size))`` plus a copy of the
  ``back`` preceding and ``ahead`` following rows. Every frame that reaches at most that far is
  exact inside the block; the copies are dropped afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barlab.functions.clock import Clock, floor_div, micros

SEGMENT_KEYS = ("root", "contract_segment_id")
TILE_UNITS = 65_536
BLOCK_ROWS = 65_536


def with_tile(df: DataFrame, clock: Clock, tile_units: int = TILE_UNITS, ts: str = "ts") -> DataFrame:
    return df.withColumn("_tile", floor_div(micros(F.col(ts)), clock.span(tile_units)))


def ordered_index(
    df: DataFrame,
    keys: Sequence[str],
    clock: Clock,
    order: Sequence[str] = ("ts",),
    tile_units: int = TILE_UNITS,
) -> DataFrame:
    """Add ``row_index`` (0-based, by time within the keys) and ``group_rows``.

    The first order column must be the timestamp. Only tile counts are ever gathered per key.
    """
    keys = list(keys)
    tiled = with_tile(df, clock, tile_units, order[0])
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tiled.groupBy(*keys, "_tile")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *keys,
            "_tile",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
            F.sum("_n").over(by_key).alias("group_rows"),
        )
    )
    within = Window.partitionBy(*keys, "_tile").orderBy(*order)
    return (
        tiled.withColumn("_pos", F.row_number().over(within))
        .join(offsets, [*keys, "_tile"])
        .withColumn("row_index", F.col("_offset") + F.col("_pos") - 1)
        .select(*df.columns, "row_index", "group_rows")
    )


def in_blocks(
    bars: DataFrame,
    step: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int,
    ahead: int = 0,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``step(rows, window)`` over row blocks that carry their context rows.

    ``window`` is ordered by the integer clock key ``_t``, so ROWS and RANGE frames share one
    exchange and one sort. ``bars`` needs ``segment_row`` (see ``add_contract_segments``).
    """
    row = F.col("segment_row")
    first = floor_div(F.greatest(row - ahead, F.lit(0)), size)
    last = floor_div(row + back, size)
    copies = bars.withColumn("_t", micros(F.col("ts"))).withColumn(
        "_block", F.explode(F.sequence(first, last))
    )
    window = Window.partitionBy(*SEGMENT_KEYS, "_block").orderBy("_t")
    done = step(copies, window)
    return done.where(floor_div(row, size) == F.col("_block")).drop("_t", "_block")
