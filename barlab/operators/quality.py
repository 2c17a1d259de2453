"""Eligibility, feature audits, null rates and raw-bar quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.clock import Clock, floor_div, micros
from barlab.functions.numeric import finite
from barlab.operators.features import RETURN_HORIZONS, own_feature_names
from barlab.operators.labels import label_names

RECORDS_PER_TILE = 65_536


def warmed_up(clock: Clock) -> Column:
    """The longest row window is complete; needs no label."""
    return finite(F.col(clock.name("rolling_vwap", 240)))


def eligible(clock: Clock, target: str) -> Column:
    """A finite target and a completed warm-up."""
    return finite(F.col(target)) & warmed_up(clock)


def before_cutoff(clock: Clock, target: str, cutoff: Column) -> Column:
    """Training history: eligible and strictly before the cutoff."""
    return eligible(clock, target) & (F.col("ts") < cutoff)


def after_cutoff(cutoff: Column) -> Column:
    """Prospective rows: strictly after; the cutoff row itself is on neither side."""
    return F.col("ts") > cutoff


def feature_audit(df: DataFrame, clock: Clock, target: str) -> DataFrame:
    """Eligibility, exact-clock loss, warm-up loss and roll-guard counts per root."""
    exact = [*[clock.name("log_return", h) for h in RETURN_HORIZONS], *label_names(clock)]
    any_missing = F.lit(False)
    for c in exact:
        any_missing = any_missing | F.col(c).isNull()
    vwap = F.col(clock.name("rolling_vwap", 240))
    t = micros(F.col("ts"))
    guard = ((t - micros(F.col("segment_start"))) < clock.span(240)) | (
        (micros(F.col("segment_end")) - t) < clock.span(15)
    )
    return df.groupBy("root").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(eligible(clock, target)).alias("eligible_rows"),
        F.count_if(any_missing).alias("rows_missing_exact_timestamp"),
        F.count_if(vwap.isNull()).alias("rows_with_warmup_null"),
        F.count_if(vwap.isNotNull() & F.col(target).isNull()).alias("rows_lost_missing_target"),
        F.count_if(guard).alias("rows_in_roll_guard"),
    )


def null_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("root",)) -> DataFrame:
    """Rows, nulls and null rate per key and column; the data is aggregated before it is unpivoted."""
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns],
    )
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls")) for c in columns]
    )
    return (
        wide.select(*keys, "rows", F.explode(pairs).alias("_p"))
        .select(*keys, "rows", "_p.*")
        .withColumn("null_rate", F.col("nulls") / F.col("rows"))
    )


def global_null_rates(counts: DataFrame, top: int | None = None) -> DataFrame:
    """Row-weighted null rate per column over all roots, largest first when limited."""
    rates = counts.groupBy("column").agg(
        F.sum("nulls").alias("nulls"),
        F.sum("rows").alias("rows"),
        (F.sum("nulls") / F.sum("rows")).alias("null_rate"),
    )
    return rates if top is None else rates.orderBy(F.desc("null_rate"), "column").limit(top)


def availability(counts: DataFrame, audit: DataFrame) -> DataFrame:
    """Share of non-null feature cells and of eligible rows per root."""
    cells = counts.groupBy("root").agg(
        (1 - F.sum("nulls") / F.sum("rows")).alias("feature_availability")
    )
    return cells.join(
        audit.select("root", "rows", (F.col("eligible_rows") / F.col("rows")).alias("eligible_share")),
        "root",
    )


def audited_columns(clock: Clock) -> list[str]:
    return [*own_feature_names(clock), *label_names(clock)]


def bar_quality(
    records: DataFrame, position: str = "record_no", gap_days: int = 4,
    tile: int = RECORDS_PER_TILE,
) -> DataFrame:
    """Integrity counters per root over raw bars in file order (``position`` unique per root).

    Neighbours are compared inside tiles of consecutive positions; the comparison across a tile
    edge uses the first and last record of each tile, so no root is ever ordered as a whole.
    """
    gap = gap_days * 86_400_000_000
    inside = Window.partitionBy("root", "_tile").orderBy(position)
    t, i = F.col("_t"), F.col("instrument_id")
    rows = records.select(
        "*",
        micros(F.col("ts")).alias("_t"),
        floor_div(F.col(position), tile).alias("_tile"),
    ).withColumns(
        {"_pt": F.lag(micros(F.col("ts"))).over(inside), "_pi": F.lag("instrument_id").over(inside)}
    )
    o, h, lo, c = (F.col(n) for n in ("open", "high", "low", "close"))
    bad = (h < o) | (h < c) | (h < lo) | (lo > o) | (lo > c)
    pt, pi = F.col("_pt"), F.col("_pi")

    def neighbours(prefix: str) -> list[Column]:
        return [
            F.sum(((t == pt) & (i == pi)).cast("long")).alias(f"{prefix}duplicates"),
            F.sum((t - pt > gap).cast("long")).alias(f"{prefix}gaps"),
            F.sum((i != pi).cast("long")).alias(f"{prefix}transitions"),
        ]

    tiles = rows.groupBy("root", "_tile").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.min("ts").alias("min_timestamp"),
        F.max("ts").alias("max_timestamp"),
        F.count_if(bad).alias("invalid_ohlc_rows"),
        F.count_if(F.col("volume") < 0).alias("negative_volume_rows"),
        *neighbours("in_"),
        F.min_by("_t", position).alias("_first_t"),
        F.min_by("instrument_id", position).alias("_first_i"),
        F.max_by("_t", position).alias("_last_t"),
        F.max_by("instrument_id", position).alias("_last_i"),
    )
    edges = Window.partitionBy("root").orderBy("_tile")
    edged = tiles.withColumns(
        {
            "_t": F.col("_first_t"),
            "instrument_id": F.col("_first_i"),
            "_pt": F.lag("_last_t").over(edges),
            "_pi": F.lag("_last_i").over(edges),
        }
    )

    def total(name: str, edge: Column) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)) + F.coalesce(F.sum(edge.cast("long")), F.lit(0))

    return edged.groupBy("root").agg(
        F.sum("record_count").alias("record_count"),
        F.min("min_timestamp").alias("min_timestamp"),
        F.max("max_timestamp").alias("max_timestamp"),
        F.sum("invalid_ohlc_rows").alias("invalid_ohlc_rows"),
        F.sum("negative_volume_rows").alias("negative_volume_rows"),
        total("in_duplicates", (t == pt) & (i == pi)).alias("duplicate_records"),
        total("in_gaps", t - pt > gap).alias("suspicious_gaps"),
        total("in_transitions", i != pi).alias("roll_transitions"),
    )


def partition_quality(
    partitions: DataFrame, roots: Sequence[str], schemas: Sequence[str], bar_schema: str
) -> DataFrame:
    """PASS/FAIL per root and overall from one evidence row per (root, schema).

    Expected partitions without evidence appear with zero records, so an absent root fails
    instead of vanishing. ``scope`` is the root or ALL.
    """
    spark = partitions.sparkSession
    expected = (
        spark.range(1)
        .select(F.explode(F.array(*[F.lit(r) for r in roots])).alias("root"))
        .select("root", F.explode(F.array(*[F.lit(s) for s in schemas])).alias("schema"))
        .withColumn("_expected", F.lit(True))
    )
    counters = ("invalid_ohlc_rows", "negative_volume_rows", "duplicate_records")
    broken = F.lit(False)
    for c in counters:
        broken = broken | (F.coalesce(F.col(c), F.lit(0)) > 0)
    good = F.coalesce(F.col("status") == "validated", F.lit(False))
    is_bar = F.col("schema") == bar_schema
    rows = expected.join(partitions, ["root", "schema"], "full").withColumns(
        {
            "_good": good & F.coalesce(F.col("_expected"), F.lit(False)),
            "_broken": broken,
            "_covered": F.when(~is_bar, F.coalesce(F.col("record_count"), F.lit(0)) > 0),
        }
    )
    return (
        rows.groupingSets([["root"], []], "root")
        .agg(
            F.grouping("root").alias("_all"),
            F.count_if("_good").alias("validated_partitions"),
            F.count(F.lit(1)).alias("partitions"),
            F.coalesce(F.sum("record_count"), F.lit(0)).alias("record_count"),
            F.min(F.when(is_bar, F.col("min_timestamp"))).alias("min_timestamp"),
            F.max(F.when(is_bar, F.col("max_timestamp"))).alias("max_timestamp"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters],
            F.bool_and("_covered").alias("metadata_complete"),
            F.bool_and(F.col("_good") & ~F.col("_broken")).alias("_pass"),
        )
        .select(
            F.when(F.col("_all") == 1, "ALL").otherwise(F.col("root")).alias("scope"),
            "validated_partitions", "partitions", "record_count", "min_timestamp", "max_timestamp",
            *counters, "metadata_complete",
            F.when(F.col("_pass"), "PASS").otherwise("FAIL").alias("status"),
        )
    )
