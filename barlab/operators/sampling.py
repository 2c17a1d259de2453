"""Deterministic samples by position, and fingerprints of the sampled rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.clock import Clock, micros
from barlab.operators.tiles import TILE_UNITS, ordered_index, with_tile
from barlab.session import BROADCAST_ROWS, broadcast_if_small, map_arrow, materialise

IDENTITY = ("ts", "root", "instrument_id", "contract_segment_id")


def keeps_even(row: Column, rows: Column, cap: Column) -> Column:
    """True on the ``cap`` positions floor(i * (rows - 1) / (cap - 1)); on all rows if few.

    The candidate step i is the smallest one whose position reaches the row.
    """
    one = F.lit(1)
    gaps, last = cap - one, rows - one
    i = F.call_function("div", row * gaps + last - one, F.greatest(last, one))
    hit = F.call_function("div", i * last, F.greatest(gaps, one)) == row
    return (rows <= cap) | F.when(cap == 1, row == 0).otherwise(hit)


def even_sample(
    df: DataFrame, cap: int, clock: Clock, keys: Sequence[str] = ("root",),
    tile_units: int = TILE_UNITS,
) -> DataFrame:
    """At most ``cap`` chronologically even rows per key, plus ``group_rows``."""
    indexed = ordered_index(df, keys, clock, tile_units=tile_units)
    keep = keeps_even(F.col("row_index"), F.col("group_rows"), F.lit(cap).cast("bigint"))
    return indexed.where(keep).drop("row_index")


def even_samples(
    df: DataFrame, caps: Sequence[int], clock: Clock, keys: Sequence[str] = ("root",),
    tile_units: int = TILE_UNITS,
) -> DataFrame:
    """Several caps from one indexed source; ``cap`` tells them apart."""
    indexed = ordered_index(df, keys, clock, tile_units=tile_units)
    wide = indexed.withColumn("cap", F.explode(F.array(*[F.lit(c).cast("bigint") for c in caps])))
    return wide.where(keeps_even(F.col("row_index"), F.col("group_rows"), F.col("cap"))).drop(
        "row_index"
    )


def pooled_even_sample(
    df: DataFrame, cap: int, clock: Clock, tile_units: int = TILE_UNITS
) -> DataFrame:
    """Even sample over all roots laid end to end (root, then time), with its ``position``."""
    indexed = ordered_index(df, ["root"], clock, tile_units=tile_units)
    sizes = df.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
    # One row per root: the only ungrouped window runs over the list of roots.
    everything = Window.orderBy("root")
    starts = broadcast_if_small(
        sizes.select(
            "root",
            (F.sum("_n").over(everything.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start"),
            F.sum("_n").over(Window.partitionBy()).alias("_total"),
        )
    )
    position = F.col("_start") + F.col("row_index")
    return (
        indexed.join(starts, "root")
        .withColumn("position", position)
        .where(keeps_even(F.col("position"), F.col("_total"), F.lit(cap).cast("bigint")))
        .drop("row_index", "group_rows", "_start", "_total")
    )


def every_nth(
    df: DataFrame, step: int, clock: Clock, keys: Sequence[str] = ("root",),
    tile_units: int = TILE_UNITS,
) -> DataFrame:
    """Rows at positions 0, step, 2 * step, ... of each key."""
    indexed = ordered_index(df, keys, clock, tile_units=tile_units)
    return indexed.where(F.col("row_index") % step == 0).drop("row_index", "group_rows")


def around_rolls(bars: DataFrame, rows: int) -> DataFrame:
    """Bars within ``rows`` positions of a rollover, with ``offset`` 0 at the first new bar.

    Positions count over the whole root, also across segments shorter than ``rows``: a segment starts
    where the segments before it end, and only one row per segment is ordered for that. A roll meets
    the bars of the one or two stretches of positions that it can reach. A bar near several rolls is
    given once for each.
    """
    segments = bars.groupBy("root", "contract_segment_id").agg(F.max("segment_rows").alias("_rows"))
    earlier = Window.partitionBy("root").orderBy("contract_segment_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(
        segments.withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    )
    few = starts.count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)
    width = 2 * rows + 1
    rolls = starts.where("contract_segment_id > 1").select(
        "root",
        F.col("contract_segment_id").alias("roll_segment"),
        F.col("_start").alias("_roll"),
        F.explode(
            F.array_distinct(
                F.array(F.floor((F.col("_start") - rows) / width), F.floor((F.col("_start") + rows) / width))
            )
        ).alias("_stretch"),
    )
    placed = bars.join(small(starts), ["root", "contract_segment_id"]).withColumn(
        "_at", F.col("_start") + F.col("segment_row")
    )
    offset = F.col("_at") - F.col("_roll")
    return (
        placed.withColumn("_stretch", F.floor(F.col("_at") / width))
        .join(small(rolls), ["root", "_stretch"])
        .where(offset.between(-rows, rows))
        .select(*bars.columns, "roll_segment", offset.alias("offset"))
    )


def first_complete_row(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """The earliest row with every required column present."""
    return df.dropna(subset=list(required)).orderBy("ts", "root").limit(1)


def row_fingerprint(
    df: DataFrame, clock: Clock, keys: Sequence[str] = ("root",), tile_units: int = TILE_UNITS
) -> DataFrame:
    """Order-dependent SHA-256 of the row identities of each key.

    Rows are hashed, then the hashes of each time tile in order, then the tile hashes in order,
    so no single string ever covers more than one tile or one list of tiles.
    """
    line = F.concat_ws(
        "\u001f", micros(F.col("ts")).cast("string"), "root",
        F.col("instrument_id").cast("string"), F.col("contract_segment_id").cast("string"),
    )
    tiles = (
        with_tile(df, clock, tile_units)
        .groupBy(*keys, "_tile")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.array_sort(F.collect_list(F.struct("ts", F.sha2(line, 256).alias("h")))).alias("_h"),
        )
        .withColumn("_tile_hash", F.sha2(F.array_join("_h.h", "\n"), 256))
    )
    return tiles.groupBy(*keys).agg(
        F.sum("_n").alias("rows"),
        F.sha2(
            F.array_join(F.array_sort(F.collect_list(F.struct("_tile", "_tile_hash")))["_tile_hash"], "\n"),
            256,
        ).alias("fingerprint"),
    )


def identity_differences(
    left: DataFrame, right: DataFrame, identity: Sequence[str] = ("root", "ts")
) -> DataFrame:
    """Row identities that one side has more often, with the difference. Must be empty.

    Both sides are read once and summed with opposite signs.
    """
    signed = left.select(*identity, F.lit(1).alias("_s")).unionByName(
        right.select(*identity, F.lit(-1).alias("_s"))
    )
    return signed.groupBy(*identity).agg(F.sum("_s").alias("surplus")).where("surplus <> 0")


def ordered_differences(
    left: DataFrame, right: DataFrame, identity: Sequence[str] = ("ts",), keys: Sequence[str] = ("root",),
    position: str = "position",
) -> DataFrame:
    """(keys, position) at which the two sides hold different rows, or only one side holds any. Must be empty.

    Both sides carry the position of each row within its key, so rows that changed places are found, too.
    """
    at = [*keys, position]
    sides = {
        name: df.select(*at, F.struct(*identity).alias(f"_{name}"), F.lit(True).alias(f"_in_{name}"))
        for name, df in (("left", left), ("right", right))
    }
    same = F.col("_in_left").eqNullSafe(F.col("_in_right")) & F.col("_left").eqNullSafe(F.col("_right"))
    return sides["left"].join(sides["right"], at, "full").where(~same).select(*at)


def _runs_and_bytes(keys: Sequence[pa.Array], lines: pa.Array) -> tuple[list[int], list[memoryview]]:
    """Where runs of equal keys start, and the text of each run's lines end to end, as it lies in the column."""
    if not len(lines):
        return [], []
    changed = np.zeros(len(lines), bool)
    changed[0] = True
    for column in keys:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        changed[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(changed).tolist()
    lines = lines.cast(pa.large_string())
    places = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    text = memoryview(lines.buffers()[2])
    ends = [*starts[1:], len(lines)]
    return starts, [text[places[a] : places[b]] for a, b in zip(starts, ends)]


def selected_row_digest(sample: DataFrame, keys: Sequence[str] = ("root",)) -> DataFrame:
    """(keys, rows, digest): SHA-256 over the identity lines of each key's rows in time order.

    A line is the UTC time as 2024-01-01T00:00:00+00:00 (with 3, 6 or no digits of a second's fraction), root,
    instrument and segment, parted by unit separators. The digest is one stream, so one task reads a key's rows: meant
    for a capped sample, see ``row_fingerprint`` for whole tables.
    """
    fraction = F.date_format("ts", "SSSSSS")
    shown = F.when(fraction == "000000", "").when(fraction.endswith("000"), F.concat(F.lit("."), F.left(fraction, F.lit(3))))
    moment = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), shown.otherwise(F.concat(F.lit("."), fraction)), F.lit("+00:00"))
    line = F.concat(
        F.concat_ws("\u001f", moment, "root", F.col("instrument_id").cast("string"), F.col("contract_segment_id").cast("string")),
        F.lit("\n"),
    )
    keys = list(keys)
    ordered = sample.select(*keys, "ts", line.alias("line")).repartition(*keys).sortWithinPartitions(*keys, "ts", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest, rows, kinds = None, None, 0, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*[pa.array([k], t) for k, t in zip(own, kinds)], pa.array([rows], pa.int64()), pa.array([digest.hexdigest()])],
                names=[*keys, "rows", "digest"],
            )

        for batch in batches:
            kinds = [batch.column(i).type for i in range(len(keys))]
            lines = batch.column(len(keys) + 1)
            if lines.null_count:
                raise ValueError("a row without identity has no digest")
            starts, text = _runs_and_bytes([batch.column(i) for i in range(len(keys))], lines)
            for first, end, part in zip(starts, [*starts[1:], batch.num_rows], text):
                key = [batch.column(i)[first].as_py() for i in range(len(keys))]
                if key != own:
                    if own is not None:
                        yield done()
                    own, digest, rows = key, hashlib.sha256(), 0
                digest.update(part)
                rows += end - first
        if own is not None:
            yield done()

    kinds = ", ".join(f"`{k}` {dict(sample.dtypes)[k]}" for k in keys)
    return map_arrow(ordered, run, f"{kinds}, rows long, digest string")
