"""Exact quantiles of many columns at once, by counting leading bits.

The bits of a double, read as an integer with the order of the doubles, are counted by their leading DIGIT_BITS per
group and column. Counts of tasks add up, so nothing is sorted and a value that fills half a column is one count. The
counts tell which leading bits hold a wanted rank; the next pass counts the following bits of those values only. As
soon as every wanted bucket holds at most `open_rows` values, the last pass counts whole values. All columns share
each pass over the wide rows: two passes on tables of up to about 10^8 rows, at most five on any.

Tasks keep one count per (group, column, code) met and hand them on when HELD_CODES are reached.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from barlab.functions.numeric import finite
from barlab.operators.ranks import quantiles
from barlab.session import BROADCAST_ROWS, map_arrow, materialise

DIGIT_BITS = 16
OPEN_ROWS = 1 << 20
HELD_CODES = 1 << 20
# Wanted (group, column, statistic) cells that the driver and every task may hold; beyond it groups are ranked one
# column at a time by `ranks.quantiles`.
MAX_CELLS = BROADCAST_ROWS

_FLIP = np.int64(0x7FFFFFFFFFFFFFFF)


def ordered_codes(values: np.ndarray) -> np.ndarray:
    """Integers with the order of the doubles; both zeros are one."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ _FLIP, bits)


def values_of(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < 0, codes ^ _FLIP, codes).view(np.float64)


class KeyNumbers:
    """Numbers for the key tuples that one task meets."""

    def __init__(self, known: dict[tuple, int] | None = None):
        self.numbers = dict(known or {})
        self.fixed = known is not None

    def of(self, columns: list[pa.Array], rows: int) -> np.ndarray:
        """The number of each row's key; -1 for a key that a fixed numbering lacks."""
        combined = np.zeros(rows, np.int64)
        for column in columns:
            coded = column.dictionary_encode(null_encoding="encode")
            combined = combined * (len(coded.dictionary) + 1) + coded.indices.to_numpy()
        _, first, inverse = np.unique(combined, return_index=True, return_inverse=True)
        taken = [c.take(pa.array(first)).to_pylist() for c in columns]
        keys = list(zip(*taken)) if columns else [()] * len(first)
        if self.fixed:
            here = [self.numbers.get(k, -1) for k in keys]
        else:
            here = [self.numbers.setdefault(k, len(self.numbers)) for k in keys]
        return np.array(here, np.int64)[inverse]


class Tally:
    """Counts per (group, column, code), added up over batches."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, group: np.ndarray, column: int, code: np.ndarray) -> None:
        if len(code):
            part = self._summed(group, np.full(len(code), column, np.int32), code, np.ones(len(code), np.int64))
            self.parts.append(part)
            self.size += len(part[0])

    @staticmethod
    def _summed(group, column, code, n) -> tuple[np.ndarray, ...]:
        order = np.lexsort((code, column, group))
        group, column, code, n = (x[order] for x in (group, column, code, n))
        first = np.ones(len(code), bool)
        first[1:] = (group[1:] != group[:-1]) | (column[1:] != column[:-1]) | (code[1:] != code[:-1])
        at = np.flatnonzero(first)
        return group[at], column[at], code[at], np.add.reduceat(n, at)

    def compress(self) -> None:
        if len(self.parts) > 1:
            self.parts = [self._summed(*(np.concatenate(x) for x in zip(*self.parts)))]
            self.size = len(self.parts[0][0])

    def drain(self) -> tuple[np.ndarray, ...] | None:
        self.compress()
        out = self.parts[0] if self.parts else None
        self.parts, self.size = [], 0
        return out


def _doubles(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)


def _leading(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column, code, n): counts of the leading bits of all finite values."""
    shift = 64 - DIGIT_BITS
    fields = [df.schema[k] for k in keys]
    schema = StructType(
        [*fields, StructField("column", IntegerType()), StructField("code", LongType()), StructField("n", LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, tally, kinds = KeyNumbers(), Tally(), []

        def drained() -> Iterator[pa.RecordBatch]:
            counts = tally.drain()
            if counts is not None:
                group, column, code, n = counts
                held = list(groups.numbers)
                own = [pa.array([k[i] for k in held], kinds[i]).take(pa.array(group)) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(column), pa.array(code), pa.array(n)], names=[*keys, "column", "code", "n"]
                )

        for batch in batches:
            kinds = [batch.column(i).type for i in range(len(keys))]
            group = groups.of([batch.column(i) for i in range(len(keys))], batch.num_rows)
            for c in range(len(columns)):
                values = _doubles(batch.column(len(keys) + c))
                there = np.isfinite(values)
                tally.add(group[there], c, ordered_codes(values[there]) >> shift)
            if tally.size > HELD_CODES:
                tally.compress()
                if tally.size > HELD_CODES:
                    yield from drained()
        yield from drained()

    counted = map_arrow(df.select(*keys, *columns), run, schema)
    return counted.groupBy(*keys, "column", "code").agg(F.sum("n").alias("n"))


def _following(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], known: dict[tuple, int],
    wanted: list[tuple[np.ndarray, np.ndarray]], above: int, shift: int,
) -> DataFrame:
    """(group, column, parent, code or value, n) of the values below wanted leading bits.

    `wanted[c]` holds (group, code >> above) pairs; `shift` 0 counts whole values.
    """
    unions = [np.unique(code) for _, code in wanted]
    pairs = [
        np.unique(group * len(union) + np.searchsorted(union, code))
        for union, (group, code) in zip(unions, wanted)
    ]
    whole = shift == 0
    last = StructField("value", DoubleType()) if whole else StructField("code", LongType())
    schema = StructType(
        [StructField("group", LongType()), StructField("column", IntegerType()), StructField("parent", LongType()),
         last, StructField("n", LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, tally = KeyNumbers(known), Tally()

        def drained() -> Iterator[pa.RecordBatch]:
            counts = tally.drain()
            if counts is not None:
                group, column, code, n = counts
                parent = code >> (above - shift)
                own = values_of(code) if whole else code
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group), pa.array(column), pa.array(parent), pa.array(own), pa.array(n)],
                    names=["group", "column", "parent", last.name, "n"],
                )

        for batch in batches:
            group = groups.of([batch.column(i) for i in range(len(keys))], batch.num_rows)
            for c, (union, pair) in enumerate(zip(unions, pairs)):
                if not len(union):
                    continue
                values = _doubles(batch.column(len(keys) + c))
                there = np.isfinite(values) & (group >= 0)
                codes, own = ordered_codes(values[there]), group[there]
                lead = codes >> above
                at = np.minimum(np.searchsorted(union, lead), len(union) - 1)
                combined = own * len(union) + at
                near = np.minimum(np.searchsorted(pair, combined), len(pair) - 1)
                some = (union[at] == lead) & (pair[near] == combined)
                tally.add(own[some], c, codes[some] >> shift)
            if tally.size > HELD_CODES:
                tally.compress()
                if tally.size > HELD_CODES:
                    yield from drained()
        yield from drained()

    counted = map_arrow(df.select(*keys, *columns), run, schema)
    return counted.groupBy("group", "column", "parent", last.name).agg(F.sum("n").alias("n"))


def _hits(counts: DataFrame, by: Sequence[str], code: str, extra: Sequence[Column] = ()) -> DataFrame:
    """Counts with the values before them inside `by`, and the total."""
    group = Window.partitionBy(*by)
    running = F.sum("n").over(group.orderBy(code).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(
        "*", (running - F.col("n")).alias("before"), F.sum("n").over(group).alias("group_rows"), *extra
    )


def _regrouped(counts: DataFrame, keys: Sequence[str], spread: dict[str, Column], by: Sequence[str]) -> DataFrame:
    """Counts added up per output group: every group of `keys` goes into each of its `spread` groups."""
    rows = counts.withColumns({f"_to_{n}": c for n, c in spread.items()})
    for n in spread:
        rows = rows.withColumn(f"_to_{n}", F.explode(f"_to_{n}"))
    kept = rows.drop(*keys).withColumnsRenamed({f"_to_{n}": n for n in spread})
    return kept.groupBy(*spread, *by).agg(F.sum("n").alias("n"))


def wide_order_statistics(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], names: Sequence[str], ranks: Column,
    spread: dict[str, Column] | None = None, open_rows: int = OPEN_ROWS, max_cells: int = MAX_CELLS,
) -> DataFrame | None:
    """(keys, feature, finite_rows, one column per name): the values at 0-based ranks of each group and column.

    `ranks` is an array of bigint, one per name, over `group_rows`, the finite values of the group. Pass stored rows.
    Columns without a finite value in a group have no row. None where the wanted cells pass `max_cells`.

    `spread` replaces `keys` by other groups: it maps an output key to an array over `keys`, and a row belongs to
    every combination. Counts are summed per group of `keys` first, so rows of one interval serve all folds that
    contain it and are read and counted once. Keys must be strings or integers.
    """
    spark, keys, columns = df.sparkSession, list(keys), list(columns)
    names, out_keys = list(names), list(spread) if spread else list(keys)
    counted = _leading(df, keys, columns)
    if spread:
        counted = materialise(counted)
        counts = _regrouped(counted, keys, spread, ["column", "code"])
    else:
        counts = counted
    first = _hits(counts, [*out_keys, "column"], "code")
    asked = F.transform(ranks, lambda r, i: F.struct(i.alias("stat"), r.alias("rank")))
    inside = F.filter(asked, lambda w: (w["rank"] >= F.col("before")) & (w["rank"] < F.col("before") + F.col("n")))
    found = materialise(first.withColumn("want", F.explode(inside)))
    if found.count() > max_cells:
        return None
    outs: dict[tuple, int] = {}
    rows, finite_rows = [], {}
    for r in found.collect():
        group = outs.setdefault(tuple(r[k] for k in out_keys), len(outs))
        finite_rows[group, r["column"]] = r["group_rows"]
        rows.append((group, r["column"], r["want"]["stat"], r["code"], r["want"]["rank"] - r["before"], r["n"]))
    known, members = outs, {g: [g] for g in outs.values()}
    if spread:
        known, members, links = {}, {}, []
        pairs = _regrouped(
            counted.select(*keys).distinct().withColumn("n", F.lit(1)).withColumns({f"_in_{k}": F.col(k) for k in keys}),
            keys, spread, [f"_in_{k}" for k in keys],
        )
        for r in pairs.collect():
            raw = known.setdefault(tuple(r[f"_in_{k}"] for k in keys), len(known))
            out = outs.get(tuple(r[k] for k in out_keys))
            if out is not None:
                members.setdefault(out, []).append(raw)
                links.append((raw, out))
        linked = spark.createDataFrame(links, "group long, out long")
    above = 64 - DIGIT_BITS
    result: dict[tuple[int, int], dict[int, float]] = {}
    while rows:
        shift = 0 if max(r[5] for r in rows) <= open_rows else max(0, above - DIGIT_BITS)
        wanted = []
        for c in range(len(columns)):
            own = sorted({(raw, r[3]) for r in rows if r[1] == c for raw in members[r[0]]})
            wanted.append(tuple(np.array([x[i] for x in own], np.int64) for i in (0, 1)))
        code = "value" if shift == 0 else "code"
        tallied = _following(df, keys, columns, known, wanted, above, shift)
        if spread:
            tallied = tallied.join(F.broadcast(linked), "group").groupBy(
                F.col("out").alias("group"), "column", "parent", code
            ).agg(F.sum("n").alias("n"))
        counts = _hits(tallied, ["group", "column", "parent"], code)
        wants = spark.createDataFrame(
            [r[:5] for r in rows], "group long, column int, stat int, parent long, rank long"
        )
        hit = counts.join(F.broadcast(wants), ["group", "column", "parent"]).where(
            (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
        )
        hits = hit.collect()
        if shift == 0:
            for r in hits:
                result.setdefault((r["group"], r["column"]), {})[r["stat"]] = r["value"]
            break
        rows = [(r["group"], r["column"], r["stat"], r["code"], r["rank"] - r["before"], r["n"]) for r in hits]
        above = shift
    held = list(outs)
    kinds = [f for f in found.schema.fields if f.name in out_keys]
    schema = StructType(
        [*sorted(kinds, key=lambda f: out_keys.index(f.name)), StructField("column", IntegerType()),
         StructField("finite_rows", LongType()), *[StructField(n, DoubleType()) for n in names]]
    )
    table = spark.createDataFrame(
        [(*held[g], c, finite_rows[g, c], *[own.get(i) for i in range(len(names))]) for (g, c), own in result.items()],
        schema,
    )
    feature = F.get(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    return table.select(*out_keys, feature.alias("feature"), "finite_rows", *names)


def wide_quantiles(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], nearest: dict[str, float] | None = None,
    linear: dict[str, float] | None = None, ends: dict[str, int] | None = None,
    spread: dict[str, Column] | None = None, open_rows: int = OPEN_ROWS, max_cells: int = MAX_CELLS,
) -> DataFrame:
    """(keys, feature, finite_rows, quantiles): nearest-rank and interpolated quantiles of every column per group.

    `ends` names further order statistics by their 0-based rank, from the end if negative. `spread` replaces the
    groups, see `wide_order_statistics`. Pass stored rows.
    """
    nearest, linear, ends = nearest or {}, linear or {}, ends or {}
    rows = F.col("group_rows")

    def at(shares: Sequence[float], rounded) -> Column:
        listed = F.array(*[F.lit(float(q)) for q in shares]).cast("array<double>")
        return F.transform(listed, lambda q: rounded((rows - 1) * q).cast("bigint"))

    edges = F.array(*[F.lit(e) for e in ends.values()]).cast("array<bigint>")
    ranks = F.concat(
        at(nearest.values(), F.round), at(linear.values(), F.floor), at(linear.values(), F.ceil),
        F.transform(edges, lambda e: F.when(e >= 0, e).otherwise(rows + e)),
    )
    names = [*nearest, *[f"_lo_{n}" for n in linear], *[f"_hi_{n}" for n in linear], *ends]
    stats = wide_order_statistics(df, keys, columns, names, ranks, spread, open_rows, max_cells)
    if stats is None and spread:
        raise ValueError("too many groups for a spread: cut them into blocks of groups")
    if stats is None:
        return _by_column(df, keys, columns, nearest, linear, ends)
    keys = list(spread) if spread else keys
    last = F.col("finite_rows") - 1
    out = {n: F.col(n) for n in [*nearest, *ends]}
    for n, q in linear.items():
        part = last * F.lit(float(q)) - F.floor(last * F.lit(float(q)))
        out[n] = F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * part
    return stats.select(*keys, "feature", "finite_rows", *[c.alias(n) for n, c in out.items()])


def _by_column(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], nearest: dict[str, float],
    linear: dict[str, float], ends: dict[str, int],
) -> DataFrame:
    """The same for very many groups: one column after the other, its groups' buckets dealt over tasks."""
    out = None
    for c in columns:
        value = df.select(*keys, F.col(c).cast("double").alias("value"))
        found = quantiles(value, keys, "value", nearest, linear)
        if ends:
            # only first and last values are asked for by any caller; other ranks need ranks.order_statistics
            if set(ends.values()) - {0, -1}:
                raise ValueError("beyond max_cells only the ranks 0 and -1 are at hand")
            edge = value.where(finite(F.col("value"))).groupBy(*keys).agg(
                *[(F.min if at == 0 else F.max)("value").alias(n) for n, at in ends.items()]
            )
            found = found.join(edge, list(keys))
        part = found.select(*keys, F.lit(c).alias("feature"), "finite_rows", *nearest, *ends, *linear)
        out = part if out is None else out.unionByName(part)
    return out
