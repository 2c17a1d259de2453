"""Exact ridge from sums of products: pooled with root effects and one per root, for all expanding folds at once.

Every row is read once. Tasks add up, per root and time interval between two fold ends, the products of the vector
(1, values, missing marks, target). These sums hold all that any fit needs:

* An expanding fold is the sum over its intervals.
* The median that stands in for a missing value comes in afterwards: the imputed column is value + median * mark.
* Mean and scale of the imputed columns are sums as well, so standardising is a linear map of the summed products.
* Root indicators make a diagonal block. Eliminating it leaves the sum of products of each root minus the outer
  product of its column sums over (rows + alpha); that is added up over roots like the rest. Only a system of the
  features' size is solved, and each root's effect follows from its own sums. No list of roots is ever gathered.

Values are shifted and scaled by their overall mean and deviation before they are multiplied, for precision only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.functions.numeric import finite
from barlab.operators.order_stats import MAX_CELLS, wide_quantiles
from barlab.session import broadcast_if_small, map_arrow, materialise

ALPHA = 1.0
# Sums of products that one task holds before it hands them on.
HELD_BYTES = 64 << 20
# First level at which one key's partial sums are added up.
SALT = 64
BROADCAST_BYTES = 64 << 20
# Values of one root that a task may sort, and rows that it sorts at a time.
ROOT_VALUES = 1 << 22
SORTED_ROWS = 1 << 16
SUMS = "sums array<double>"


@dataclass(frozen=True)
class Shifts:
    """The shift and unit by which each column was moved before it was multiplied."""

    centre: np.ndarray
    unit: np.ndarray

    def of(self, places: np.ndarray) -> Shifts:
        return Shifts(self.centre[places], self.unit[places])


@dataclass(frozen=True)
class Statistics:
    """Sums of products per root and fold, and what is needed to read them."""

    features: tuple[str, ...]
    folds: tuple[str, ...]
    shifts: Shifts
    sums: DataFrame  # root, fold (number), sums: upper triangle over (1, values, marks, target)
    rows: DataFrame  # root, interval, features: the training rows, stored

    @property
    def width(self) -> int:
        return 2 * len(self.features) + 2

    def pick(self, features: Sequence[str]) -> np.ndarray:
        """Places of (1, values, marks, target) of some of the features."""
        at = [self.features.index(f) for f in features]
        p = len(self.features)
        return np.array([0, *[1 + i for i in at], *[1 + p + i for i in at], self.width - 1])

    def own_shifts(self, features: Sequence[str]) -> Shifts:
        return self.shifts.of(np.array([self.features.index(f) for f in features], np.int64))


def _full(triangle: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((width, width))
    out[np.triu_indices(width)] = triangle
    return out + np.triu(out, 1).T


def _added(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vectors added up per key: rows of one key stand together, so a task holds one sum at a time."""
    keys = list(keys)
    ordered = rows.select(*keys, "sums").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = total = None
        kinds: list[pa.DataType] = []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*[pa.array([k], t) for k, t in zip(key, kinds)], pa.array([total], pa.list_(pa.float64()))],
                names=[*keys, "sums"],
            )

        for batch in batches:
            kinds = [batch.column(i).type for i in range(len(keys))]
            here = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys))]))
            vectors = batch.column(len(keys))
            for i, own in enumerate(here):
                vector = vectors[i].values.to_numpy(zero_copy_only=False)
                if own == key:
                    total = total + vector
                else:
                    if key is not None:
                        yield done()
                    key, total = own, vector
        if key is not None:
            yield done()

    fields = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys)
    return map_arrow(ordered, run, f"{fields}, {SUMS}")


def added_vectors(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, sums): in two levels, so that a key that every task holds is added up by several tasks."""
    salted = rows.withColumn("_salt", F.spark_partition_id() % SALT)
    return _added(_added(salted, [*keys, "_salt"]), keys)


def _products(rows: DataFrame, features: Sequence[str], centre: np.ndarray, unit: np.ndarray) -> DataFrame:
    """(root, interval, sums) of every task's own rows; the columns are root, interval, features, target."""
    p = len(features)
    triangle = np.triu_indices(2 * p + 2)
    most = max(1, HELD_BYTES // (8 * (2 * p + 2) ** 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in held], pa.string()),
                    pa.array([k[1] for k in held], pa.int32()),
                    pa.array([g[triangle] for g in held.values()], pa.list_(pa.float64())),
                ],
                names=["root", "interval", "sums"],
            )
            held.clear()
            return out

        for batch in batches:
            columns = [
                pc.fill_null(batch.column(2 + i).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
                for i in range(p)
            ]
            values = np.column_stack(columns) if p else np.zeros((batch.num_rows, 0))
            there = np.isfinite(values)
            values = np.where(there, (np.where(there, values, 0.0) - centre) / unit, 0.0)
            target = batch.column(2 + p).to_numpy(zero_copy_only=False)
            z = np.column_stack([np.ones(batch.num_rows), values, ~there, target])
            root = batch.column(0).dictionary_encode(null_encoding="encode")
            names, interval = root.dictionary.to_pylist(), batch.column(1).to_numpy()
            code = root.indices.to_numpy().astype(np.int64) * (interval.max(initial=0) + 1) + interval
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            for own in np.split(order, starts[1:]):
                if not len(own):
                    continue
                key = (names[root.indices[own[0]].as_py()], int(interval[own[0]]))
                part = z[own].T @ z[own]
                held[key] = held[key] + part if key in held else part
                if len(held) >= most:
                    yield handed()
        if held:
            yield handed()

    return map_arrow(rows, run, f"root string, interval int, {SUMS}")


def _moment(at: datetime) -> Column:
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz").cast("timestamp")


def fold_statistics(
    df: DataFrame, features: Sequence[str], target: str, ends: dict[str, datetime] | None = None,
    start: datetime | None = None,
) -> Statistics:
    """One pass over the rows with a finite target; `ends` maps rising folds to the end of their training rows.

    Fold f trains on [start, ends[f]); without `ends` one fold "all" trains on every row. Roots without a row have no
    sums; a null root counts as a root of its own.
    """
    features = tuple(features)
    rows = df.where(finite(F.col(target)))
    interval = F.lit(0)
    if ends:
        marks = list(ends.values())
        if any(a >= b for a, b in zip(marks, marks[1:])):
            raise ValueError("fold ends must rise")
        rows = rows.where(F.col("ts") < _moment(marks[-1]))
        for mark in marks[:-1]:
            interval = interval + (F.col("ts") >= _moment(mark)).cast("int")
    if start is not None:
        rows = rows.where(F.col("ts") >= _moment(start))
    root = F.col("root").cast("string") if "root" in df.columns else F.lit(None).cast("string")
    stored = materialise(
        rows.select(
            root.alias("root"), interval.cast("int").alias("interval"),
            *[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("_y"),
        )
    )
    known = [F.when(finite(F.col(f)), F.col(f)) for f in features]
    scales = stored.agg(
        F.count(F.lit(1)), *[F.avg(c) for c in known], *[F.stddev_pop(c) for c in known]
    ).first()
    if not scales[0]:
        raise ValueError("no training rows")
    p = len(features)
    centre = np.array([v or 0.0 for v in scales[1 : 1 + p]])
    unit = np.array([v or 1.0 for v in scales[1 + p :]])
    names = tuple(ends or ("all",))
    parts = added_vectors(_products(stored, features, centre, unit), ["root", "interval"])
    # an interval's sums go into every fold from its own on
    into = parts.withColumn("fold", F.explode(F.sequence(F.col("interval"), F.lit(len(names) - 1))))
    sums = materialise(_added(into, ["root", "fold"]))
    return Statistics(features, names, Shifts(centre, unit), sums, stored.drop("_y"))


def _imputation(shifts: Shifts, medians: np.ndarray, sums: np.ndarray) -> tuple:
    """The map from (1, values, marks, target) to (1, standardised imputed columns), and the columns' mean and scale.

    A column without median (no finite training value) maps to zeros.
    """
    p = len(medians)
    known = np.isfinite(medians)
    fill = np.where(known, (np.where(known, medians, 0.0) - shifts.centre) / shifts.unit, 0.0)
    n = sums[0, 0]
    value, mark = np.arange(1, 1 + p), np.arange(1 + p, 1 + 2 * p)
    mean = (sums[0, value] + fill * sums[0, mark]) / n
    square = (sums[value, value] + fill**2 * sums[mark, mark]) / n
    variance = square - mean**2
    scale = np.sqrt(np.where(variance > 1e-14 * np.maximum(square, 1e-300), variance, 1.0))
    out = np.zeros((len(sums), 1 + p))
    out[0, 0] = 1.0
    out[value, value] = known / scale
    out[mark, value] = np.where(known, fill / scale, 0.0)
    out[0, value] = np.where(known, -mean / scale, 0.0)
    return out, shifts.centre + shifts.unit * mean, shifts.unit * scale


def _solved(sums: np.ndarray, change: np.ndarray, alpha: float) -> np.ndarray:
    left = change.T @ sums @ change
    penalty = np.eye(len(left)) * alpha
    penalty[0, 0] = 0.0
    return np.linalg.solve(left + penalty, change.T @ sums[:, -1])


MODELS = (
    "fold string, root string, training_rows long, intercept double, weights array<double>, "
    "coefficients array<double>, medians array<double>, means array<double>, scales array<double>"
)


def _model_row(solution, medians, means, scales, training_rows) -> dict:
    """Weights for raw columns; a column without median weighs nothing."""
    known = np.isfinite(medians)
    coefficients = np.where(known, solution[1:], 0.0)
    weights = coefficients / scales
    return {
        "training_rows": int(round(training_rows)),
        "intercept": float(solution[0] - (weights * means).sum()),
        "weights": weights.tolist(),
        "coefficients": coefficients.tolist(),
        "medians": np.where(known, medians, 0.0).tolist(),
        "means": means.tolist(),
        "scales": scales.tolist(),
    }


def pooled_medians(stats: Statistics, features: Sequence[str]) -> dict[int, np.ndarray]:
    """By fold number: the training median of every feature, nan where none is finite."""
    spread = {"fold": F.sequence(F.col("interval"), F.lit(len(stats.folds) - 1))}
    found = wide_quantiles(stats.rows, ["interval"], list(features), linear={"median": 0.5}, spread=spread).collect()
    out = {f: np.full(len(features), np.nan) for f in range(len(stats.folds))}
    place = {f: i for i, f in enumerate(features)}
    for r in found:
        out[r["fold"]][place[r["feature"]]] = r["median"]
    return out


def fit_pooled(
    stats: Statistics, features: Sequence[str] | None = None, alpha: float = ALPHA, include_root: bool = True,
    medians: dict[int, np.ndarray] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(models, effects): one model per fold over all roots, and (fold, root, effect, training_rows) of every root.

    Only sums over roots, of the features' size, reach the driver. Without `include_root` there are no effects.
    """
    spark = stats.sums.sparkSession
    features = list(features or stats.features)
    at, width, folds, shifts = stats.pick(features), stats.width, stats.folds, stats.own_shifts(features)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for fold, triangle in zip(batch.column(1).to_pylist(), batch.column(2)):
                own = _full(triangle.values.to_numpy(zero_copy_only=False), width)[np.ix_(at, at)]
                gone = np.outer(own[0], own[0]) / (own[0, 0] + alpha) if include_root else np.zeros_like(own)
                if fold in held:
                    held[fold][0] += own
                    held[fold][1] += gone
                else:
                    held[fold] = [own, gone]
        if held:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(held), pa.int32()),
                    pa.array([np.concatenate([m.ravel() for m in v]) for v in held.values()], pa.list_(pa.float64())),
                ],
                names=["fold", "sums"],
            )

    summed = added_vectors(map_arrow(stats.sums, totals, f"fold int, {SUMS}"), ["fold"]).collect()
    medians = medians or pooled_medians(stats, features)
    rows, fitted = [], {}
    for r in sorted(summed, key=lambda r: r["fold"]):
        both = np.array(r["sums"]).reshape(2, len(at), len(at))
        change, means, scales = _imputation(shifts, medians[r["fold"]], both[0])
        solution = _solved(both[0] - both[1], change, alpha)
        fitted[r["fold"]] = (change, solution)
        row = _model_row(solution, medians[r["fold"]], means, scales, both[0][0, 0])
        rows.append({"fold": folds[r["fold"]], "root": None, **row})
    models = spark.createDataFrame(rows, MODELS)

    def own_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            effects, counts, named = [], [], []
            for fold, triangle in zip(batch.column(1).to_pylist(), batch.column(2)):
                first = _full(triangle.values.to_numpy(zero_copy_only=False), width)[0][at]
                change, solution = fitted[fold]
                effects.append((first[-1] - first @ change @ solution) / (first[0] + alpha))
                counts.append(int(round(first[0])))
                named.append(folds[fold])
            yield pa.RecordBatch.from_arrays(
                [pa.array(named), batch.column(0), pa.array(effects, pa.float64()), pa.array(counts, pa.int64())],
                names=["fold", "root", "effect", "training_rows"],
            )

    shape = "fold string, root string, effect double, training_rows long"
    if not include_root:
        return models, spark.createDataFrame([], shape)
    return models, map_arrow(stats.sums.where(F.col("root").isNotNull()), own_effects, shape)


def _sorted_medians(root: np.ndarray, interval: np.ndarray, values: list[np.ndarray], folds: int):
    """(root number, fold, feature number, median) arrays of whole roots; a column without a finite value has no row."""
    found = []
    for c, column in enumerate(values):
        order = np.lexsort((column, root))
        order = order[np.isfinite(column[order])]
        for fold in range(folds):
            own = order[interval[order] <= fold]
            if not len(own):
                continue
            first = np.flatnonzero(np.diff(root[own], prepend=-1))
            last = np.diff(first, append=len(own)) - 1
            low, high = column[own[first + last // 2]], column[own[first + (last + 1) // 2]]
            found.append((root[own[first]], np.full(len(first), fold), np.full(len(first), c), low + (high - low) * (last % 2 / 2)))
    return [np.concatenate(x) for x in zip(*found)] if found else None


def _small_root_medians(rows: DataFrame, features: Sequence[str], folds: int) -> DataFrame:
    """The medians of roots that a task may hold: one exchange by root, each root is sorted where it stands."""
    features = list(features)
    ordered = rows.select("root", "interval", *features).repartition("root").sortWithinPartitions("root")

    def medians(table: pa.Table) -> Iterator[pa.RecordBatch]:
        coded = table.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
        values = [pc.fill_null(table.column(2 + c), np.nan).to_numpy() for c in range(len(features))]
        found = _sorted_medians(coded.indices.to_numpy().astype(np.int64), table.column(1).to_numpy(), values, folds)
        if found is not None:
            root, fold, feature, median = found
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(root)), pa.array(fold, pa.int32()),
                 pa.array(features).take(pa.array(feature)), pa.array(median)],
                names=["root", "fold", "feature", "median"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, wanted = [], 0, SORTED_ROWS
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < wanted:
                continue
            table = pa.Table.from_batches(held)
            coded = table.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            # the last root may go on in the next batch
            cut = int(np.flatnonzero(coded != coded[-1])[-1]) + 1 if (coded != coded[-1]).any() else 0
            if cut:
                yield from medians(table.slice(0, cut))
            held, size = table.slice(cut).to_batches(), size - cut
            wanted = max(SORTED_ROWS, 2 * size)
        if size:
            yield from medians(pa.Table.from_batches(held))

    return map_arrow(ordered, run, "root string, fold int, feature string, median double")


def root_medians(
    stats: Statistics, features: Sequence[str], max_cells: int = MAX_CELLS, most_values: int = ROOT_VALUES
) -> DataFrame:
    """(root, fold, feature, median) of every root's own training rows, in one pass over the rows however many roots.

    Roots of up to `most_values` values are sorted by tasks. Larger ones, of which there are never more than values /
    `most_values`, are counted by leading bits, in blocks that the driver may hold.
    """
    last = len(stats.folds) - 1
    rows, same = stats.rows, F.col("r.root").eqNullSafe(F.col("l.root"))
    large = materialise(
        stats.sums.where((F.col("fold") == last) & (F.get("sums", F.lit(0)) * len(features) > most_values)).select("root")
    )
    many = large.count()
    if not many:
        return _small_root_medians(rows, features, len(stats.folds))
    listed = F.broadcast(large).alias("l")
    out = _small_root_medians(rows.alias("r").join(listed, same, "left_anti"), features, len(stats.folds))
    spread = {"root": F.array("root"), "fold": F.sequence(F.col("interval"), F.lit(last))}
    rest = materialise(rows.alias("r").join(listed, same, "left_semi"))
    cells = many * len(stats.folds) * len(features) * 2
    blocks = -(-2 * cells // max_cells) if cells > max_cells else 1
    for block in range(blocks):
        own = rest
        if blocks > 1:
            own = materialise(rest.where(F.pmod(F.xxhash64("root"), F.lit(blocks)) == block))
        part = wide_quantiles(
            own, ["root", "interval"], list(features), linear={"median": 0.5}, spread=spread, max_cells=4 * max_cells
        ).select("root", "fold", "feature", "median")
        out = out.unionByName(part)
    return out


def fit_per_root(
    stats: Statistics, features: Sequence[str] | None = None, alpha: float = ALPHA, medians: DataFrame | None = None
) -> DataFrame:
    """(fold, root, ...) models: one ridge per root and fold on the root's own rows, medians, means and scales.

    Every root is solved where its sums lie; nothing is gathered. `medians` are those of these features or more, see
    `root_medians`.
    """
    features = list(features or stats.features)
    at, width, folds, shifts = stats.pick(features), stats.width, stats.folds, stats.own_shifts(features)
    listed = (
        (root_medians(stats, features) if medians is None else medians).groupBy("root", "fold")
        .agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("_m"))
        .select("root", "fold", F.array(*[F.try_element_at("_m", F.lit(f)) for f in features]).alias("medians"))
    )
    left, right = stats.sums.alias("s"), listed.alias("m")
    same = F.col("s.root").eqNullSafe(F.col("m.root")) & (F.col("s.fold") == F.col("m.fold"))
    joined = left.join(right, same, "left").select("s.root", "s.fold", "s.sums", "m.medians")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for i, (root, fold) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                own = _full(batch.column(2)[i].values.to_numpy(zero_copy_only=False), width)[np.ix_(at, at)]
                given = batch.column(3)[i].as_py() or [None] * len(features)
                medians = np.array([np.nan if m is None else m for m in given])
                change, means, scales = _imputation(shifts, medians, own)
                rows.append(
                    {"fold": folds[fold], "root": root,
                     **_model_row(_solved(own, change, alpha), medians, means, scales, own[0, 0])}
                )
            kinds = {"fold": pa.string(), "root": pa.string(), "training_rows": pa.int64(), "intercept": pa.float64()}
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], kinds.get(c, pa.list_(pa.float64()))) for c in rows[0]], names=list(rows[0])
            )

    return map_arrow(joined, run, MODELS)


def linear_prediction(features: Sequence[str]) -> Column:
    """intercept + sum of weight * (value, or the median where it is missing), over model columns on the row."""
    total = F.col("intercept")
    for i, f in enumerate(features):
        value = F.col(f).cast("double")
        filled = F.when(finite(value), value).otherwise(F.get("medians", F.lit(i)))
        total = total + F.get("weights", F.lit(i)) * filled
    return total


def score_linear(
    df: DataFrame, features: Sequence[str], models: DataFrame, effects: DataFrame | None = None,
    on: Sequence[str] = ("fold",),
) -> DataFrame:
    """Add `prediction`: rows meet their model by `on` (fold, or root and fold), root effects by root and fold.

    A root without an effect adds 0; a row without a model gets null.
    """
    few = max(1, BROADCAST_BYTES // (24 * max(1, len(features))))
    on = list(on)
    wanted = models.select(*on, "intercept", "weights", "medians")
    out = df.join(broadcast_if_small(wanted, few), on, "left").withColumn("prediction", linear_prediction(features))
    out = out.drop("intercept", "weights", "medians")
    if effects is None:
        return out
    own = broadcast_if_small(effects.select("fold", "root", "effect"))
    joined = out.join(own, ["fold", "root"], "left")
    return joined.withColumn("prediction", F.col("prediction") + F.coalesce("effect", F.lit(0.0))).drop("effect").select(
        *df.columns, "prediction"
    )
