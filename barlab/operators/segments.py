"""Contract segments, the rollover table and the per-root audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.clock import Clock
from barlab.operators.tiles import BLOCK_ROWS, TILE_UNITS, in_blocks, with_tile
from barlab.session import BROADCAST_ROWS, materialise


def _tile_runs(bars: DataFrame, clock: Clock, tile_units: int) -> DataFrame:
    """Rows with their position and the number of instrument changes so far in the tile."""
    within = Window.partitionBy("root", "_tile").orderBy("ts")
    changed = F.col("instrument_id") != F.lag("instrument_id").over(within)
    return (
        with_tile(bars, clock, tile_units)
        .withColumns(
            {
                "_pos": F.row_number().over(within),
                "_changed": F.coalesce(changed, F.lit(False)),
            }
        )
        .withColumn(
            "_run",
            F.sum(F.col("_changed").cast("int")).over(
                within.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
    )


def _runs(rows: DataFrame) -> DataFrame:
    """One row per instrument run inside a tile, numbered across the whole root.

    Only time and instrument are read for it, and the aggregation reuses the tile partitioning.
    The runs are stored, because several steps below read them; only the tile summary (one row
    per root and tile) is ordered per root.
    """
    runs = materialise(
        rows.groupBy("root", "_tile", "_run").agg(
            F.min("ts").alias("_start"),
            F.max("ts").alias("_end"),
            F.min("_pos").alias("_first_pos"),
            F.count(F.lit(1)).alias("_rows"),
            F.min_by("instrument_id", "_pos").alias("instrument_id"),
        )
    )
    tiles = runs.groupBy("root", "_tile").agg(
        F.max("_run").alias("_changes"),
        F.sum("_rows").alias("_tile_rows"),
        F.min_by("instrument_id", "_run").alias("_first"),
        F.max_by("instrument_id", "_run").alias("_last"),
    )
    by_root = Window.partitionBy("root").orderBy("_tile")
    before = by_root.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_root.rowsBetween(Window.unboundedPreceding, 0)
    enters = F.coalesce(F.col("_first") != F.lag("_last").over(by_root), F.lit(False))
    tiles = (
        tiles.withColumn("_enters", enters)
        .withColumns(
            {
                "_segment0": F.sum(F.col("_enters").cast("int") + F.col("_changes")).over(upto)
                - F.col("_changes")
                + 1,
                "_row0": F.coalesce(F.sum("_tile_rows").over(before), F.lit(0)),
            }
        )
        .select("root", "_tile", "_enters", "_segment0", "_row0")
    )
    return runs.join(tiles, ["root", "_tile"]).withColumns(
        {
            "contract_segment_id": F.col("_segment0") + F.col("_run"),
            "_first_row": F.col("_row0") + F.col("_first_pos") - 1,
        }
    )


def _segment_table(runs: DataFrame) -> DataFrame:
    return runs.groupBy("root", "contract_segment_id").agg(
        F.min_by("instrument_id", "_start").alias("instrument_id"),
        F.min("_start").alias("segment_start"),
        F.max("_end").alias("segment_end"),
        F.sum("_rows").alias("rows"),
        F.min("_first_row").alias("_segment_row0"),
    )


def rollover_table(bars: DataFrame, clock: Clock, tile_units: int = TILE_UNITS) -> DataFrame:
    """One row per contiguous contract segment, straight from the run summaries."""
    return _segment_table(_runs(_tile_runs(bars, clock, tile_units))).select(
        "root",
        "contract_segment_id",
        "instrument_id",
        "segment_start",
        "segment_end",
        "rows",
        (F.col("contract_segment_id") > 1).alias("roll_event"),
    )


def add_contract_segments(
    bars: DataFrame, clock: Clock, tile_units: int = TILE_UNITS
) -> DataFrame:
    """Add roll_event, contract_segment_id, segment_start/end, segment_row and segment_rows.

    A segment is a contiguous run of one instrument inside a root; an instrument that returns
    later opens a new segment. ``segment_row`` is the 0-based row number inside the segment,
    ``segment_rows`` the segment's row count. Bars must be unique on (root, ts).
    """
    rows = _tile_runs(bars, clock, tile_units)
    runs = _runs(rows)
    spans = _segment_table(runs).select(
        "root", "contract_segment_id", "segment_start", "segment_end", "_segment_row0",
        F.col("rows").alias("_segment_rows"),
    )
    # The runs of one tile travel as an array so that the join back is on (root, tile), the
    # partitioning the rows already have. A tile has at most tile_units runs.
    carried = (
        runs.select("root", "_tile", "_run", "_enters", "_segment0", "_row0", "contract_segment_id")
        .join(spans, ["root", "contract_segment_id"])
        .groupBy("root", "_tile")
        .agg(
            F.first("_enters").alias("_enters"),
            F.first("_segment0").alias("_segment0"),
            F.first("_row0").alias("_row0"),
            F.array_sort(
                F.collect_list(
                    F.struct("_run", "segment_start", "segment_end", "_segment_row0", "_segment_rows")
                )
            ).alias("_spans"),
        )
    )
    span = F.element_at("_spans", F.col("_run").cast("int") + 1)
    if runs.count() <= BROADCAST_ROWS:
        carried = F.broadcast(carried)
    return (
        rows.join(carried, ["root", "_tile"])
        .withColumn("_span", span)
        .select(
            *bars.columns,
            (F.col("_changed") | (F.col("_enters") & (F.col("_pos") == 1))).alias("roll_event"),
            (F.col("_segment0") + F.col("_run")).alias("contract_segment_id"),
            F.col("_span.segment_start").alias("segment_start"),
            F.col("_span.segment_end").alias("segment_end"),
            (F.col("_row0") + F.col("_pos") - 1 - F.col("_span._segment_row0")).alias("segment_row"),
            F.col("_span._segment_rows").alias("segment_rows"),
        )
    )


def add_short_contract_segments(bars: DataFrame) -> DataFrame:
    """The columns of ``add_contract_segments`` for roots that a task may hold, such as daily bars (36,525 a century).

    All is told by windows inside a root: one exchange by root, which later windows by segment share, and none if the
    bars are dealt by root already; the bars are read once and nothing is stored or joined.
    """
    by_time = Window.partitionBy("root").orderBy("ts")
    changed = F.col("instrument_id") != F.lag("instrument_id").over(by_time)
    segment = Window.partitionBy("root", "contract_segment_id").orderBy("ts")
    whole = segment.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    number = F.sum(F.col("roll_event").cast("int")).over(by_time.rowsBetween(Window.unboundedPreceding, 0)) + 1
    return (
        bars.withColumn("roll_event", F.coalesce(changed, F.lit(False)))
        .withColumn("contract_segment_id", number)
        .withColumns(
            {
                "segment_start": F.min("ts").over(whole),
                "segment_end": F.max("ts").over(whole),
                "segment_row": F.row_number().over(segment).cast("bigint") - 1,
                "segment_rows": F.count(F.lit(1)).over(whole),
            }
        )
    )


def with_bar_gap(bars: DataFrame, clock: Clock, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``units_since_previous``: clock units since the previous bar of the segment."""
    return in_blocks(
        bars,
        lambda rows, w: rows.withColumn(
            "units_since_previous",
            F.call_function("div", F.col("_t") - F.lag("_t").over(w), F.lit(clock.micros)),
        ),
        back=1,
        size=block_rows,
    )


def root_audit(bars: DataFrame, clock: Clock, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Coverage facts per root plus a grand-total row (``row_type``)."""
    gap = F.col("units_since_previous")
    per_root = (
        with_bar_gap(bars, clock, block_rows)
        .groupBy("root")
        .agg(
            F.count(F.lit(1)).alias("processed_rows"),
            F.min("ts").alias("min_timestamp"),
            F.max("ts").alias("max_timestamp"),
            F.max("contract_segment_id").alias("contract_segments"),
            F.count_if("roll_event").alias("rollovers"),
            F.count_if(gap != 1).alias("irregular_intervals"),
            F.coalesce(F.sum(F.when(gap > 1, gap - 1)), F.lit(0)).alias("missing_units"),
        )
    )
    return (
        per_root.groupingSets([["root"], []], "root")
        .agg(
            F.when(F.grouping("root") == 1, "total").otherwise("root").alias("row_type"),
            F.sum("processed_rows").alias("processed_rows"),
            F.min("min_timestamp").alias("min_timestamp"),
            F.max("max_timestamp").alias("max_timestamp"),
            F.sum("contract_segments").alias("contract_segments"),
            F.sum("rollovers").alias("rollovers"),
            F.sum("irregular_intervals").alias("irregular_intervals"),
            F.sum("missing_units").alias("missing_units"),
        )
    )
