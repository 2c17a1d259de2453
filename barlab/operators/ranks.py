"""Exact ranks and order statistics without sorting a whole group in one task.

Each group gets split points (its approximate quantiles). A value equal to a split point falls
into that point's own bucket, so a heavily repeated value needs no sort at all: its rank follows
from bucket counts. The open buckets between split points are short and are sorted separately.
Every value of one bucket precedes every value of the next, hence bucket counts give exact
offsets whatever the quality of the split points.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.numeric import finite
from barlab.session import BROADCAST_ROWS, broadcast_if_small, materialise

# Split points per group: one for PIECE_ROWS counted rows. The upper bound keeps the array of split points
# of one group at half a megabyte; 10^12 rows then give open buckets of about 15 million rows.
PIECE_ROWS = 65_536
MIN_SPLITS, MAX_SPLITS = 64, 65_536
# A repeated value and a split-point join without broadcast are dealt out over so many parts.
PARTS = 64


def split_count(df: DataFrame) -> int:
    """Split points for the counted rows, as a power of two. ``df`` is stored by its callers."""
    wanted = max(MIN_SPLITS, min(MAX_SPLITS, df.count() // PIECE_ROWS))
    return 1 << (wanted.bit_length() - 1)


def with_part(df: DataFrame) -> DataFrame:
    """Number the rows' parts, right before they are stored: what is read again has the part it was stored with.

    A number made up later would differ if a lost task is run again on rows in another order, and a row could then be
    dealt out twice or not at all.
    """
    return df.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int"))


def part_of(df: DataFrame) -> Column:
    """The stored part of a row, or else a hash of the whole row; results never depend on it."""
    if "_part" in df.columns:
        return F.col("_part")
    return F.pmod(F.xxhash64(*df.columns), F.lit(PARTS)).cast("int")


def split_points(df: DataFrame, keys: Sequence[str], values: Sequence[str], splits: int) -> DataFrame:
    """One sorted array of distinct split points per group and value column, in one pass."""
    at = [i / (splits + 1) for i in range(1, splits + 1)]
    return df.groupBy(*keys).agg(
        *[
            F.array_distinct(F.percentile_approx(v, at, 4 * splits)).alias(f"_points_{i}")
            for i, v in enumerate(values)
        ]
    )


def bucket_of(value: Column, points: Column, splits: int) -> Column:
    """2i for a value between point i-1 and point i, 2i + 1 for a value equal to point i."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(splits.bit_length()))])
    below = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: at + F.when(F.get(points, at + step - 1) < value, step).otherwise(F.lit(0)),
    )
    return 2 * below + F.when(F.get(points, below) == value, 1).otherwise(0)


def bucketed(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], splits: int | None = None
) -> DataFrame:
    """Add ``_bucket_0``, ``_bucket_1``... for the value columns.

    Rows on which any of them is missing or non-finite are dropped. Many groups of split points are
    not broadcast; each is then repeated per part and met by the rows of its part, so that a large
    group is spread over tasks and later windows by bucket get an exchange of their own.
    """
    splits = splits or split_count(df)
    present = df
    for value in values:
        present = present.where(finite(F.col(value)))
    points = materialise(split_points(present, keys, values, splits))
    if points.count() <= max(1, BROADCAST_ROWS // splits):
        placed = present.join(F.broadcast(points), list(keys))
    else:
        every = points.withColumn("_dealt_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        placed = present.withColumn("_dealt_part", part_of(present)).join(every, [*keys, "_dealt_part"])
    return placed.select(
        *df.columns,
        *[
            bucket_of(F.col(v), F.col(f"_points_{i}"), splits).alias(f"_bucket_{i}")
            for i, v in enumerate(values)
        ],
    )


def one_bucket(
    df: DataFrame, keys: Sequence[str], value: str, splits: int | None = None
) -> DataFrame:
    return bucketed(df, keys, [value], splits).withColumnRenamed("_bucket_0", "_bucket")


def is_point() -> Column:
    return F.col("_bucket") % 2 == 1


def bucket_offsets(rows: DataFrame, keys: Sequence[str], *extra: str) -> DataFrame:
    """Rows per bucket, rows in earlier buckets and rows per group.

    ``extra`` columns order the pieces inside a bucket. Only counts are ordered per group.
    """
    group = Window.partitionBy(*keys)
    before = group.orderBy("_bucket", *extra).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.groupBy(*keys, "_bucket", *extra)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *keys,
            "_bucket",
            *extra,
            "_n",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
            F.sum("_n").over(group).alias("group_rows"),
        )
    )


def add_average_ranks(
    df: DataFrame, keys: Sequence[str], ranks: dict[str, str], splits: int | None = None
) -> DataFrame:
    """Average ranks (1-based, ties share their mean rank) inside the keys.

    ``ranks`` maps value columns to rank columns; rows with a non-finite value are dropped. Per ranked
    column there are one exchange, one sort and two windows. A repeated value reads its rank off the
    bucket counts and is dealt out over parts, so it gathers nowhere. ``df`` is read several times:
    pass stored rows.
    """
    keys, values = list(keys), list(ranks)
    rows = bucketed(df, keys, values, splits)
    counted = [
        bucket_offsets(rows.withColumnRenamed(f"_bucket_{i}", "_bucket"), keys)
        .drop("group_rows")
        .withColumn("_which", F.lit(i))
        for i in range(len(values))
    ]
    offsets = materialise(reduce(DataFrame.unionByName, counted))
    few = offsets.count() <= BROADCAST_ROWS
    for i, (value, name) in enumerate(ranks.items()):
        here = offsets.where(F.col("_which") == i).drop("_which")
        placed = rows.withColumnRenamed(f"_bucket_{i}", "_bucket").withColumn(
            "_piece", F.when(is_point(), part_of(df)).otherwise(F.lit(0))
        )
        if few:
            placed = placed.join(F.broadcast(here), [*keys, "_bucket"])
        else:
            last = F.when(is_point(), F.lit(PARTS - 1)).otherwise(F.lit(0))
            every = here.withColumn("_piece", F.explode(F.sequence(F.lit(0), last)))
            placed = placed.join(every, [*keys, "_bucket", "_piece"])
        piece = [*keys, "_bucket", "_piece"]
        within = Window.partitionBy(*piece).orderBy(value)
        same = Window.partitionBy(*piece, value)
        local = F.when(is_point(), (F.col("_n") + 1) / 2).otherwise(
            F.rank().over(within) + (F.count(F.lit(1)).over(same) - 1) / 2
        )
        rows = placed.withColumn(name, (F.col("_before") + local).cast("double")).drop(
            "_bucket", "_piece", "_n", "_before"
        )
    return rows.select(*df.columns, *ranks.values())


def add_average_rank(
    df: DataFrame, keys: Sequence[str], value: str, name: str, splits: int | None = None
) -> DataFrame:
    return add_average_ranks(df, keys, {value: name}, splits)


def add_short_average_ranks(df: DataFrame, keys: Sequence[str], ranks: dict[str, str]) -> DataFrame:
    """``add_average_ranks`` for groups that a task may hold: windows over whole groups, so nothing is stored, counted or
    joined, and no row is exchanged if the input is dealt by some of the keys already.

    All rows stay; those which ``add_average_ranks`` drops have null ranks.
    """
    keys = list(keys)
    known = [*[F.col(k).isNotNull() for k in keys], *[finite(F.col(v)) for v in ranks]]
    rows = df.withColumn("_ranked", reduce(Column.__and__, known))
    group = [*keys, "_ranked"]
    for value, name in ranks.items():
        within = Window.partitionBy(*group).orderBy(value)
        # a frame of equal values shares the sort of the rank, which a window by value would not
        same = within.rangeBetween(Window.currentRow, Window.currentRow)
        rank = F.rank().over(within) + (F.count(F.lit(1)).over(same) - 1) / 2
        rows = rows.withColumn(name, F.when(F.col("_ranked"), rank.cast("double")))
    return rows.drop("_ranked")


def add_stable_position(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ties: Sequence[str],
    tie_tile: Column,
    splits: int | None = None,
) -> DataFrame:
    """0-based position by (value, ties) inside the keys, plus ``group_rows``.

    ``df`` is read several times: pass stored rows.

    ``tie_tile`` must be non-decreasing in the tie order; it cuts the rows of a repeated value
    into pieces, so that not even one constant prediction gathers in one task.
    """
    rows = one_bucket(df, keys, value, splits).withColumn(
        "_piece", F.when(is_point(), tie_tile).otherwise(F.lit(None))
    )
    offsets = broadcast_if_small(
        bucket_offsets(rows, keys, "_piece").withColumnsRenamed({"_bucket": "_b", "_piece": "_p"})
    )
    within = Window.partitionBy(*keys, "_bucket", "_piece").orderBy(value, *ties)
    here = (F.col("_bucket") == F.col("_b")) & F.col("_piece").eqNullSafe(F.col("_p"))
    ranked = rows.withColumn("_pos", F.row_number().over(within)).alias("r")
    side = offsets.alias("o")
    for key in keys:
        here = here & (F.col(f"r.{key}") == F.col(f"o.{key}"))
    return ranked.join(side, here).select(
        *[F.col(f"r.{c}").alias(c) for c in df.columns],
        (F.col("_before") + F.col("_pos") - 1).alias("position"),
        F.col("group_rows"),
    )


def equal_bucket(position: Column, rows: Column, buckets: int) -> Column:
    """1-based bucket of a position when n rows are cut into near-equal buckets, larger first."""
    small = F.call_function("div", rows, F.lit(buckets))
    extra = rows % buckets
    edge = extra * (small + 1)
    return (
        F.when(position < edge, F.call_function("div", position, small + 1))
        .otherwise(extra + F.call_function("div", position - edge, F.greatest(small, F.lit(1))))
        .cast("int")
        + 1
    )


def nearest_rank(q: float) -> Column:
    """0-based rank of the nearest-rank quantile (halves round up)."""
    return F.round((F.col("group_rows") - 1) * F.lit(float(q))).cast("bigint")


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column],
    splits: int | None = None,
) -> DataFrame:
    """The values at given 0-based ranks of each group: one row per group, one column per rank.

    ``ranks`` maps a column name to a bigint expression over ``group_rows``. Only the buckets
    that hold a wanted rank are sorted. ``df`` is read three times (split points, bucket counts,
    final pick): pass stored rows.
    """
    keys = list(keys)
    dealt = ["_part"] if "_part" in df.columns else []
    narrow = df.select(*keys, value, *dealt)
    rows = one_bucket(narrow, keys, value, splits)
    offsets = bucket_offsets(rows, keys)
    wanted = offsets.select(
        "*",
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("stat"), r.alias("rank")) for n, r in ranks.items()])
        ).alias("_want"),
    ).where(
        (F.col("_want.rank") >= F.col("_before"))
        & (F.col("_want.rank") < F.col("_before") + F.col("_n"))
    )
    targets = materialise(
        wanted.groupBy(*keys, "_bucket").agg(
            F.first("_before").alias("_before"),
            F.first("group_rows").alias("group_rows"),
            F.collect_list("_want").alias("_wants"),
        )
    )
    # A point bucket holds one value: one row of each task stays, whatever the copies.
    if targets.count() <= BROADCAST_ROWS:
        hit = rows.join(F.broadcast(targets), [*keys, "_bucket"])
    else:
        last = F.when(is_point(), F.lit(PARTS - 1)).otherwise(F.lit(0))
        spread = targets.withColumn("_piece", F.explode(F.sequence(F.lit(0), last)))
        pieces = rows.withColumn("_piece", F.when(is_point(), part_of(narrow)).otherwise(F.lit(0)))
        hit = pieces.join(spread, [*keys, "_bucket", "_piece"])
    single = (
        hit.where(is_point())
        .groupBy(*keys, "_bucket")
        .agg(F.first(value).alias(value), F.first("_wants").alias("_wants"),
             F.first("group_rows").alias("group_rows"))
        .select(*keys, value, "group_rows", F.explode("_wants").alias("_want"))
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(value)
    sorted_rows = (
        hit.where(~is_point())
        .withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1)
        .select(*keys, value, "group_rows", "_rank", F.explode("_wants").alias("_want"))
        .where(F.col("_rank") == F.col("_want.rank"))
        .drop("_rank")
    )
    found = single.unionByName(sorted_rows)
    return found.groupBy(*keys).agg(
        F.max("group_rows").alias("finite_rows"),
        *[F.max(F.when(F.col("_want.stat") == n, F.col(value))).alias(n) for n in ranks],
    )


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    nearest: dict[str, float] | None = None,
    linear: dict[str, float] | None = None,
    splits: int | None = None,
) -> DataFrame:
    """Exact quantiles per group: nearest-rank and linearly interpolated ones.

    Output: keys, ``finite_rows`` and one column per requested quantile. Pass stored rows.
    """
    nearest, linear = nearest or {}, linear or {}
    last = F.col("group_rows") - 1
    ranks = {n: nearest_rank(q) for n, q in nearest.items()}
    for n, q in linear.items():
        ranks[f"_lo_{n}"] = F.floor(last * F.lit(float(q))).cast("bigint")
        ranks[f"_hi_{n}"] = F.ceil(last * F.lit(float(q))).cast("bigint")
    stats = order_statistics(df, keys, value, ranks, splits)
    at = F.col("finite_rows") - 1
    out = {n: F.col(n) for n in nearest}
    for n, q in linear.items():
        part = at * F.lit(float(q)) - F.floor(at * F.lit(float(q)))
        out[n] = F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * part
    return stats.select(*keys, "finite_rows", *[c.alias(n) for n, c in out.items()])
