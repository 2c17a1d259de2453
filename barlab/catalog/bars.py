"""Bar tables derived from the driver tables (whole-table aggregations)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.functions.clock import DAY, MINUTE
from barlab.operators.segments import add_contract_segments, add_short_contract_segments
from barlab.session import broadcast_if_small, materialise

LI_ROOTS = ("A", "N", "R")
LI_ANCHORS = ("A", "N")
EV_ROOTS = ("click", "error", "purchase", "signup", "view")
EV_ANCHORS = ("click", "view")

# Small enough that every root spans several tiles even on the test tables.
LI_TILE = 512
EV_TILE = 4_096
# Raw rows of one root that a task may sort.
ROOT_ROWS = 1 << 22

_BAR = ("root", "ts", "instrument_id")
_LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(rows: DataFrame, price: Column, volume: Column, order: Column) -> DataFrame:
    return rows.groupBy(*_BAR).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        volume.cast("double").alias("volume"),
    )


def _line_price(of: str = "") -> Column:
    return F.col(f"{of}l_extendedprice") / F.col(f"{of}l_quantity")


def _lineitem_rows(spark: SparkSession, sf_dir: str, root: Column) -> DataFrame:
    day = F.date_trunc("day", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        root.alias("root"),
        day.alias("ts"),
        (F.lit(1000) + F.floor((F.year(day) - 1995) / 2)).cast("long").alias("instrument_id"),
        *_LINE_KEY,
        "l_quantity",
    )


def _spans(rows: DataFrame) -> DataFrame:
    """What plain numbers tell of every bar: the combining needs no sort. Null order keys come first."""
    price, order = _line_price(), F.col("l_orderkey")
    return rows.groupBy(*_BAR).agg(
        F.when(F.count(order) == F.count(F.lit(1)), F.min(order)).alias("_lo"),
        F.max(order).alias("_hi"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.sum("l_quantity").alias("l_quantity"),
    )


def bars_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars, three dense roots, four two-year contracts each.

    A minimum by a struct sorts all rows ahead of the exchange. There are few bars of very many lines, so a first pass
    finds each bar's first and last order, and only the lines of these two orders are told apart by the whole key.
    """
    rows = _lineitem_rows(spark, sf_dir, F.col("l_returnflag"))
    spans = broadcast_if_small(_spans(rows)).alias("s")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in _BAR]
    at_end = F.col("r.l_orderkey").eqNullSafe(F.col("s._lo")) | F.col("r.l_orderkey").eqNullSafe(F.col("s._hi"))
    ends = materialise(
        rows.alias("r").join(spans, reduce(and_, same)).where(at_end)
        .select(*[f"r.{c}" for c in _BAR], F.struct(*[f"r.{c}" for c in _LINE_KEY]).alias("k"),
                _line_price("r.").alias("price"), "s.high", "s.low", F.col("s.l_quantity").alias("volume"))
    )
    return ends.groupBy(*_BAR).agg(
        F.min_by("price", "k").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("price", "k").alias("close"),
        F.max("volume").cast("double").alias("volume"),
    )


def dealt_by_root(rows: DataFrame, key: str, most_rows: int = ROOT_ROWS) -> DataFrame:
    """The rows dealt out by root, if no root, told by `key`, has more than a task may sort; else as they are.

    A supplier has few line items a day, so combining them ahead of the exchange sorts all rows for nothing: dealt by
    root, the rows are exchanged and sorted once for the bars and for the segments after them. A root of very many rows
    is combined first, which leaves its days.
    """
    largest = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return rows.repartition("root") if largest <= most_rows else rows


def bars_su(spark: SparkSession, sf_dir: str, most_rows: int = ROOT_ROWS) -> DataFrame:
    """Sparse daily bars per supplier; the number of roots grows with the data."""
    rows = _lineitem_rows(spark, sf_dir, F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
    # the root tells the supplier, so its key orders nothing
    order = F.struct(*[c for c in _LINE_KEY if c != "l_suppkey"])
    return _bars(dealt_by_root(rows, "l_suppkey", most_rows), _line_price(), F.sum("l_quantity"), order)


def bars_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse one-minute bars per event type, two contracts each."""
    ev = table(spark, sf_dir, "events")
    minute = F.date_trunc("minute", "ts")
    rows = ev.select(
        F.col("event_type").alias("root"),
        minute.alias("ts"),
        (F.lit(100) + F.floor((F.dayofmonth(minute) - 1) / 15)).cast("long").alias("instrument_id"),
        "value",
        "event_id",
    )
    return _bars(rows, F.col("value"), F.count(F.lit(1)), F.col("event_id"))


# Bars of long roots are stored before they are segmented, as a bar dataset would be: the raw
# rows are then aggregated once, though segmentation in tiles reads its input twice.


def seg_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_contract_segments(materialise(bars_li(spark, sf_dir)), DAY, LI_TILE)


def seg_su(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier has a bar a day at most, so its segments need no tiles. Store it to read it more than once."""
    return add_short_contract_segments(bars_su(spark, sf_dir))


def seg_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_contract_segments(materialise(bars_ev(spark, sf_dir)), MINUTE, EV_TILE)
