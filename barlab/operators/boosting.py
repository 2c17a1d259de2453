"""Gradient-boosted trees grown leaf by leaf from distributed histograms of quantile-binned features.

Features are cut once into at most `bins` bins by exact order statistics; rows are stored as one byte per feature. Per
tree, tasks add up gradients and rows per (leaf, feature, bin) and per (leaf, root); the driver holds only these sums,
whose size is leaves x features x bins whatever the data. The leaf with the greatest gain is split first, up to
`leaves` leaves. As a leaf's gain rests on its own histogram alone, one pass counts the children of every leaf that
may still be split, so a tree takes about as many passes as it is deep. Of two children the smaller one is counted;
the other is its parent's histogram less the sibling's.

Root indicators are not columns: a split "this root against all others" is found from the sums per (leaf, root), and
only the best root of each leaf comes to the driver. Where roots are many, those sums are made by a shuffle.

Squared error: gain = Gl^2/(nl + l2) + Gr^2/(nr + l2) - G^2/(n + l2), leaf value = -rate * G/(n + l2). Ties go to the
first feature, then the lowest bin, then root splits by name; equal gains to the older leaf. With more than
`early_rows` rows a seeded hash sets `held_share` of them aside, and boosting ends when their loss has not improved by
`tolerance` for `patience` rounds. Predictions so far are written every STORED_TREES trees, which bounds what a lost
executor costs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.functions.numeric import finite
from barlab.operators.linear import added_vectors
from barlab.operators.order_stats import wide_quantiles
from barlab.session import map_arrow, materialise

STORED_TREES = 10
# Rows of one task; up to FEW_TASKS tasks send their sums straight to the driver.
TASK_ROWS = 1 << 17
FEW_TASKS = 32
# Roots whose sums the driver adds up itself.
FEW_ROOTS = 1_000


@dataclass(frozen=True)
class Boosting:
    """Rate, rounds, leaves, rows per leaf and l2 of the boosted-tree baseline."""

    rate: float = 0.08
    rounds: int = 150
    leaves: int = 31
    leaf_rows: int = 100
    l2: float = 0.1
    bins: int = 255
    early_rows: int = 10_000
    held_share: float = 0.1
    patience: int = 10
    tolerance: float = 1e-7
    seed: int = 42


@dataclass(frozen=True)
class Split:
    """Rows of `node` go left if their code of `feature` is at most `bin`; feature -1: if their root is not `root`."""

    node: int
    left: int
    right: int
    feature: int
    bin: int
    root: str | None
    gain: float


@dataclass(frozen=True)
class Tree:
    splits: tuple[Split, ...]  # parents before children
    values: dict[int, float]  # by leaf

    def predict(self, codes: np.ndarray, roots: Roots) -> np.ndarray:
        table = np.zeros(max(self.values) + 1)
        for node, value in self.values.items():
            table[node] = value
        return table[place(self.splits, codes, roots)]


@dataclass(frozen=True)
class Roots:
    """The roots of some rows: numbers, and the number of each name."""

    number: np.ndarray
    names: dict[str, int]

    @staticmethod
    def of(column: pa.Array) -> Roots:
        coded = pc.fill_null(column, "").dictionary_encode()
        names = {name: i for i, name in enumerate(coded.dictionary.to_pylist())}
        return Roots(coded.indices.to_numpy(), names)

    def take(self, rows: np.ndarray) -> Roots:
        return Roots(self.number[rows], self.names)


def place(splits: Sequence[Split], codes: np.ndarray, roots: Roots) -> np.ndarray:
    """The node of every row after all splits."""
    node = np.zeros(len(codes), np.int32)
    for s in splits:
        at = np.flatnonzero(node == s.node)
        if len(at):
            left = roots.number[at] != roots.names.get(s.root, -1) if s.feature < 0 else codes[at, s.feature] <= s.bin
            node[at] = np.where(left, s.left, s.right)
    return node


@dataclass
class _Leaf:
    total: float
    rows: float
    sums: np.ndarray | None = None  # features x bins
    counts: np.ndarray | None = None
    root: tuple[str, float, float] | None = None  # best root, its gradient sum and rows
    split: Split | None = None
    sides: tuple = ()
    children: tuple[int, int] | None = None


def _gain(g, n, l2):
    return g * g / (n + l2)


class Growth:
    """One tree while it grows; `wanted` tells which children must be counted next."""

    def __init__(self, given: Boosting, root: _Leaf):
        self.given, self.nodes, self.splits = given, {0: root}, []
        self._find(0)

    def _find(self, node: int) -> None:
        """The best split of a counted leaf."""
        leaf, given = self.nodes[node], self.given
        if leaf.rows < 2 * given.leaf_rows:
            return
        parent = _gain(leaf.total, leaf.rows, given.l2)
        g, n = np.cumsum(leaf.sums, axis=1)[:, :-1], np.cumsum(leaf.counts, axis=1)[:, :-1]
        rest_g, rest_n = leaf.total - g, leaf.rows - n
        allowed = (n >= given.leaf_rows) & (rest_n >= given.leaf_rows)
        gains = np.where(allowed, _gain(g, n, given.l2) + _gain(rest_g, rest_n, given.l2) - parent, -np.inf)
        found, best = None, 0.0
        if gains.size:
            at = int(gains.argmax())
            f, b = divmod(at, gains.shape[1])
            if gains[f, b] > best:
                best, found = float(gains[f, b]), (f, b, None, (g[f, b], n[f, b]), (rest_g[f, b], rest_n[f, b]))
        if leaf.root is not None:
            name, own_g, own_n = leaf.root
            other = (leaf.total - own_g, leaf.rows - own_n)
            gain = _gain(own_g, own_n, given.l2) + _gain(*other, given.l2) - parent
            if min(own_n, other[1]) >= given.leaf_rows and gain > best:
                best, found = float(gain), (-1, 0, name, other, (own_g, own_n))
        if found:
            f, b, name, left, right = found
            leaf.split = Split(node, -1, -1, f, b, name, best)
            leaf.sides = (left, right)

    def chosen(self) -> tuple[list[Split], list[int]]:
        """Splits in best-first order as far as they are known, and the leaves whose children are wanted next.

        No wanted leaf means that the tree is complete.
        """
        heap = [(-self.nodes[0].split.gain, 0)] if self.nodes[0].split else []
        taken: list[Split] = []
        while heap and len(taken) < self.given.leaves - 1:
            _, node = heapq.heappop(heap)
            leaf = self.nodes[node]
            if leaf.children is None:
                if len(taken) == self.given.leaves - 2:
                    # the last split needs no children's histograms
                    taken.append(self._named(node))
                    return taken, []
                left = self.given.leaves - 1 - len(taken)
                others = [n for _, n in sorted(heap)[: left - 1] if self.nodes[n].children is None]
                return taken, [node, *others]
            taken.append(leaf.split)
            for child in leaf.children:
                if self.nodes[child].split:
                    heapq.heappush(heap, (-self.nodes[child].split.gain, child))
        return taken, []

    def _named(self, node: int) -> Split:
        """The split of a leaf with children of their own numbers."""
        leaf = self.nodes[node]
        if leaf.children is None:
            first = max(self.nodes) + 1
            leaf.children = (first, first + 1)
            s = leaf.split
            leaf.split = Split(node, first, first + 1, s.feature, s.bin, s.root, s.gain)
            for child, (g, n) in zip(leaf.children, leaf.sides):
                self.nodes[child] = _Leaf(float(g), float(n))
            self.splits.append(leaf.split)
        return leaf.split

    def open(self, leaves: Sequence[int]) -> list[int]:
        """Split leaves provisionally; the smaller child of each is to be counted, if either can be split again."""
        asked = []
        for node in leaves:
            s = self._named(node)
            sizes = {c: self.nodes[c].rows for c in (s.left, s.right)}
            if max(sizes.values()) >= 2 * self.given.leaf_rows:
                asked.append(min(sizes, key=lambda c: (sizes[c], c)))
        return asked

    def counted(self, node: int, sums: np.ndarray, counts: np.ndarray) -> None:
        """Take in the histogram of a smaller child; its sibling gets the parent's rest."""
        parent = next(s for s in reversed(self.splits) if node in (s.left, s.right))
        sibling = parent.right if node == parent.left else parent.left
        whole = self.nodes[parent.node]
        self.nodes[node].sums, self.nodes[node].counts = sums, counts
        self.nodes[sibling].sums, self.nodes[sibling].counts = whole.sums - sums, whole.counts - counts
        whole.sums = whole.counts = None

    def settle(self, leaves: Sequence[int]) -> None:
        for node in leaves:
            for child in self.nodes[node].children:
                self._find(child)

    def tree(self, taken: Sequence[Split]) -> Tree:
        given, values = self.given, {}
        inner = {s.node for s in taken}
        for node in [0, *[c for s in taken for c in (s.left, s.right)]]:
            if node not in inner:
                leaf = self.nodes[node]
                values[node] = -given.rate * leaf.total / (leaf.rows + given.l2)
        return Tree(tuple(taken), values)


@dataclass(frozen=True)
class BoostedTrees:
    """The fitted model. Predictions are made in batches beside the rows."""

    features: tuple[str, ...]
    medians: np.ndarray
    edges: tuple[np.ndarray, ...]
    start: float
    trees: tuple[Tree, ...]
    training_rows: int
    held_losses: tuple[float, ...] = field(default=())

    def transform(self, df: DataFrame) -> DataFrame:
        features, medians, edges, start, trees = self.features, self.medians, self.edges, self.start, self.trees

        @F.pandas_udf("double")
        def predicted(frame: pd.DataFrame) -> pd.Series:
            values = frame[[f"x{i}" for i in range(len(features))]].to_numpy(np.float64)
            codes, roots = binned(values, medians, edges), Roots.of(pa.array(frame["root"], pa.string()))
            out = np.full(len(frame), start)
            for tree in trees:
                out += tree.predict(codes, roots)
            return pd.Series(out)

        root = F.col("root").cast("string") if "root" in df.columns else F.lit(None).cast("string")
        row = F.struct(
            *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], root.alias("root")
        )
        return df.withColumn("prediction", predicted(row))


def binned(values: np.ndarray, medians: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """One byte per row and feature: how many edges lie below the value, or below the median if it is missing."""
    values = np.where(np.isfinite(values), values, medians)
    return np.column_stack(
        [np.searchsorted(e, values[:, i]).astype(np.uint8) for i, e in enumerate(edges)]
    ) if len(edges) else np.zeros((len(values), 0), np.uint8)


def bin_edges(stored: DataFrame, features: Sequence[str], bins: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Medians and rising edges of every feature: distinct order statistics at equal steps, the greatest left out."""
    steps = {f"e{i}": i / bins for i in range(1, bins + 1)}
    found = {
        r["feature"]: r
        for r in wide_quantiles(stored, [], features, nearest=steps, linear={"median": 0.5}).collect()
    }
    missing = [f for f in features if f not in found]
    if missing:
        raise ValueError(f"no finite training value in {missing}")
    medians = np.array([found[f]["median"] for f in features])
    edges = [np.unique([found[f][s] for s in steps])[:-1] for f in features]
    return medians, edges


class _Rows:
    """The coded training rows and the trees that their stored predictions lack."""

    def __init__(self, coded: DataFrame, features: int, bins: int, tasks: int, roots: int, use_root: bool):
        self.features, self.bins, self.tasks, self.use_root = features, bins, tasks, use_root
        self.few = tasks <= FEW_TASKS and roots <= FEW_ROOTS
        self.pending: list[Tree] = []
        self.coded = coded.persist()

    def add(self, tree: Tree) -> None:
        self.pending.append(tree)
        if len(self.pending) >= STORED_TREES:
            trees, width = self.pending, self.features

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    codes, roots, raw = _unpacked(batch, width)
                    for t in trees:
                        raw = raw + t.predict(codes, roots)
                    yield batch.set_column(4, "raw", pa.array(raw))

            before, self.pending = self.coded, []
            self.coded = materialise(map_arrow(before, run, before.schema)).persist()
            before.unpersist()

    def count(self, splits: Sequence[Split], asked: Sequence[int], both: Sequence[int]) -> tuple[dict, dict, tuple]:
        """Histograms of the nodes `asked`, the best root of each node of `both`, and the held-out loss."""
        trees, width, bins, use_root = list(self.pending), self.features, self.bins, self.use_root
        splits, asked, both = tuple(splits), tuple(asked), tuple(both)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = width * bins
            sums, counts = np.zeros((len(asked), size)), np.zeros((len(asked), size))
            by_root: dict[tuple[int, str], np.ndarray] = {}
            loss = np.zeros(2)
            for batch in batches:
                codes, roots, raw = _unpacked(batch, width)
                for t in trees:
                    raw = raw + t.predict(codes, roots)
                gradient = raw - batch.column(1).to_numpy()
                held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
                loss += (gradient[held] ** 2).sum(), held.sum()
                codes, roots, gradient = codes[~held], roots.take(~held), gradient[~held]
                node = place(splits, codes, roots)
                for i, wanted in enumerate(asked):
                    at = np.flatnonzero(node == wanted)
                    cell = (codes[at] + np.arange(width) * bins).ravel()
                    sums[i] += np.bincount(cell, np.repeat(gradient[at], width), size)
                    counts[i] += np.bincount(cell, minlength=size)
                if use_root:
                    for wanted in both:
                        at = np.flatnonzero(node == wanted)
                        own, known = roots.number[at], len(roots.names)
                        pairs = np.column_stack([np.bincount(own, gradient[at], known), np.bincount(own, minlength=known)])
                        for name, i in roots.names.items():
                            if pairs[i, 1]:
                                key = (wanted, name)
                                by_root[key] = by_root[key] + pairs[i] if key in by_root else pairs[i]
            rows = [(wanted, None, np.concatenate([sums[i], counts[i]])) for i, wanted in enumerate(asked)]
            rows += [(wanted, name, pair) for (wanted, name), pair in by_root.items()]
            rows.append((-1, None, loss))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.list_(pa.float64())),
                ],
                names=["node", "root", "sums"],
            )

        parts = map_arrow(self.coded, run, "node int, root string, sums array<double>")
        return self._gathered(parts, asked, both)

    def _gathered(self, parts: DataFrame, asked: Sequence[int], both: Sequence[int]) -> tuple[dict, dict, tuple]:
        if not self.few:
            # roots: the extreme gain per node is decided where the sums lie, see _best_roots
            parts = materialise(added_vectors(parts, ["node", "root"]))
        table = parts.where(F.col("root").isNull()).toArrow() if not self.few else parts.toArrow()
        whole: dict[tuple, np.ndarray] = {}
        vectors = table.column("sums").combine_chunks()
        for i, key in enumerate(zip(table.column("node").to_pylist(), table.column("root").to_pylist())):
            own = vectors[i].values.to_numpy(zero_copy_only=False)
            whole[key] = whole[key] + own if key in whole else own
        size = self.features * self.bins
        histograms = {
            n: (whole[n, None][:size].reshape(self.features, self.bins), whole[n, None][size:].reshape(self.features, self.bins))
            for n in asked if (n, None) in whole
        }
        loss = tuple(whole.get((-1, None), np.zeros(2)))
        by_root = {k: v for k, v in whole.items() if k[1] is not None}
        if not self.few:
            by_root = self._root_rows(parts)
        return histograms, by_root, loss

    def _root_rows(self, parts: DataFrame) -> dict:
        """With many roots: only those whose split could be best come to the driver.

        For given totals (G, n) of a node the gain is convex in a root's gradient sum, so per node and rows-of-a-root
        only the least and the greatest sum can win.
        """
        own = parts.where(F.col("root").isNotNull()).select(
            "node", "root", F.get("sums", F.lit(0)).alias("g"), F.get("sums", F.lit(1)).alias("n")
        )
        ends = own.groupBy("node", "n").agg(
            F.min_by(F.struct("root", "g"), F.struct("g", "root")).alias("low"),
            F.max_by(F.struct("root", "g"), F.struct("g", "root")).alias("high"),
        )
        out = {}
        for r in ends.collect():
            for end in (r["low"], r["high"]):
                out[r["node"], end["root"]] = np.array([end["g"], r["n"]])
        return out


def _unpacked(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, Roots, np.ndarray]:
    column = batch.column(3)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    codes = data[column.offset * width : (column.offset + len(column)) * width].reshape(len(column), width)
    return codes, Roots.of(batch.column(0)), batch.column(4).to_numpy()


def _best_root(by_root: dict, node: int, leaf: _Leaf, given: Boosting) -> tuple[str, float, float] | None:
    best, found = -np.inf, None
    for (at, name), (g, n) in sorted(((k, v) for k, v in by_root.items() if k[0] == node), key=lambda x: x[0][1]):
        if min(n, leaf.rows - n) >= given.leaf_rows:
            gain = _gain(g, n, given.l2) + _gain(leaf.total - g, leaf.rows - n, given.l2)
            if gain > best:
                best, found = gain, (name, float(g), float(n))
    return found


def fit_boosting(
    train: DataFrame, features: Sequence[str], target: str, given: Boosting = Boosting(), include_root: bool = True
) -> BoostedTrees:
    """Fit on every row with a finite target. Missing values count as the training median of their feature."""
    features = tuple(features)
    root = F.col("root").cast("string") if include_root else F.lit(None).cast("string")
    rows = materialise(
        train.where(finite(F.col(target))).select(
            F.coalesce(root, F.lit("")).alias("root"), F.col(target).cast("double").alias("y"),
            *[F.col(f).cast("double").alias(f) for f in features],
        )
    )
    total = rows.count()
    if not total:
        raise ValueError("no training rows")
    medians, edges = bin_edges(rows, features, given.bins)
    early = total > given.early_rows
    least = F.lit(int(given.held_share * 1_000_000))
    held = F.pmod(F.xxhash64(F.lit(given.seed), *rows.columns), F.lit(1_000_000)) < least if early else F.lit(False)
    tasks = max(1, -(-total // TASK_ROWS))
    dealt = rows.repartition(tasks) if tasks > rows.rdd.getNumPartitions() else rows.coalesce(tasks)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.column_stack(
                [pc.fill_null(batch.column(3 + i), np.nan).to_numpy(zero_copy_only=False) for i in range(len(features))]
            )
            codes = np.ascontiguousarray(binned(values, medians, edges))
            packed = pa.Array.from_buffers(
                pa.binary(), batch.num_rows,
                [None, pa.py_buffer((np.arange(batch.num_rows + 1) * len(features)).astype(np.int32)), pa.py_buffer(codes)],
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), packed, pa.array(np.zeros(batch.num_rows))],
                names=["root", "y", "held", "codes", "raw"],
            )

    wide = dealt.select("root", "y", held.alias("held"), *features)
    coded = materialise(map_arrow(wide, code, "root string, y double, held boolean, codes binary, raw double"))
    own = coded.where(~F.col("held")).agg(F.avg("y").alias("start"), F.count(F.lit(1)).alias("n")).first()
    start = own["start"] or 0.0
    coded = materialise(coded.withColumn("raw", F.lit(start)))
    roots = coded.agg(F.approx_count_distinct("root")).first()[0] if include_root else 0
    data = _Rows(coded, len(features), given.bins, tasks, roots, include_root)
    trees: list[Tree] = []
    losses: list[float] = []
    try:
        for _ in range(given.rounds):
            histograms, by_root, loss = data.count((), (0,), (0,))
            if early and loss[1]:
                losses.append(loss[0] / loss[1])
                if _stalled(losses, given):
                    break
            sums, counts = histograms[0]
            first = _Leaf(float(sums[0].sum()), float(counts[0].sum()), sums, counts)
            first.root = _best_root(by_root, 0, first, given)
            growth = Growth(given, first)
            taken, wanted = growth.chosen()
            while wanted:
                asked = growth.open(wanted)
                if asked:
                    children = [
                        c for n in wanted for c in growth.nodes[n].children if growth.nodes[c].rows >= 2 * given.leaf_rows
                    ]
                    histograms, by_root, _ = data.count(growth.splits, asked, children)
                    for node in asked:
                        growth.counted(node, *histograms[node])
                    for child in children:
                        growth.nodes[child].root = _best_root(by_root, child, growth.nodes[child], given)
                growth.settle(wanted)
                taken, wanted = growth.chosen()
            if not taken:
                break
            trees.append(growth.tree(taken))
            data.add(trees[-1])
    finally:
        data.coded.unpersist()
    return BoostedTrees(features, medians, tuple(edges), start, tuple(trees), int(own["n"]), tuple(losses))


def _stalled(losses: Sequence[float], given: Boosting) -> bool:
    """Whether none of the last `patience` losses is better by `tolerance` than the one before them."""
    if len(losses) <= given.patience:
        return False
    return min(losses[-given.patience :]) >= losses[-given.patience - 1] - given.tolerance
