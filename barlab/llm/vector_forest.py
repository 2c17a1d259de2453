"""Nearest vectors by inner product: a forest of random-projection trees with one shared queue, then exact scores.

1. Equal vectors are one point: of its ids only the `k + 1` smallest can be among the k nearest of any query (ties go
   to smaller ids and only the query's own id is left out), so the others need no search.
2. A sample of at most about FIT_ROWS points (by hash) fits the trees: a node splits at the median of the projection
   on the line between two random points. Vectors get one more component, sqrt(max norm^2 - norm^2), and queries a
   zero there, so that a larger inner product means a nearer point.
3. Every point is put into its leaf of every tree. A query goes through all trees by one priority queue, nearest
   margin first, until leaves with `share` of all points (and several times k per tree) are visited.
4. Leaves and queries meet in blocks of bounded size, and each block gives each query its `k + 1` best points; the
   best of all blocks are expanded to ids again.

On vectors without structure, as in the test tables, recall asks for a large share of the points; on clustered ones
a smaller `share` does. Recall is measured in the tests.

Defined results: vectors that are null, empty, zero, or hold null, NaN or infinite components take no part, nor do
rows without an id; vectors must have one length (the most frequent one, the longer of equally frequent ones, takes
part); repeated rows of an id count once per different vector; fewer candidates than k give fewer rows; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.common import map_batches, stored

K = 20
TREES = 16
LEAVES = 64  # per tree
SHARE = 1.2  # of all points, summed over the visited leaves of all trees (a point counts once per tree)
FIT_ROWS = 20_000
BLOCK = 1_024
QUERY_STEP = 20


class Tree(NamedTuple):
    """Inner nodes as planes; children below zero are leaves, -1 - child."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    sizes: np.ndarray  # of leaves, in points of the sample


class Forest(NamedTuple):
    trees: list[Tree]
    norm: float  # largest squared norm
    scale: float  # points per point of the sample


def augmented(vectors: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm - (vectors * vectors).sum(axis=1), 0.0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def grow(points: np.ndarray, leaves: int, seed: int) -> Tree:
    """One tree over the sample; equal projections stay on the lower side."""
    rng = np.random.default_rng(seed)
    normals, offsets, children, sizes = [], [], [], []

    def leaf(rows: np.ndarray) -> int:
        sizes.append(len(rows))
        return -len(sizes)

    def split(rows: np.ndarray, parts: int) -> int:
        if parts <= 1 or len(rows) < 2:
            return leaf(rows)
        for _ in range(3):
            a, b = points[rng.choice(rows, 2, replace=False)]
            line = a - b
            length = np.linalg.norm(line)
            if length == 0:
                continue
            line = line / length
            along = points[rows] @ line
            middle = np.median(along)
            upper = along > middle
            if upper.any() and not upper.all():
                me = len(normals)
                normals.append(line)
                offsets.append(middle)
                children.append([0, 0])
                children[me][0] = split(rows[~upper], parts // 2)
                children[me][1] = split(rows[upper], parts - parts // 2)
                return me
        return leaf(rows)

    split(np.arange(len(points)), leaves)
    d = points.shape[1]
    return Tree(
        np.array(normals, np.float64).reshape(-1, d),
        np.array(offsets, np.float64),
        np.array(children, np.int64).reshape(-1, 2),
        np.array(sizes, np.int64),
    )


def leaves_of(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    """The leaf of every vector."""
    if not len(tree.normals):
        return np.zeros(len(vectors), np.int64)
    margins = vectors @ tree.normals.T - tree.offsets
    at = np.zeros(len(vectors), np.int64)
    open_ = np.arange(len(vectors))
    while len(open_):
        node = at[open_]
        at[open_] = tree.children[node, (margins[open_, node] > 0).astype(np.int64)]
        open_ = open_[at[open_] >= 0]
    return -1 - at


def probes(forest: Forest, vectors: np.ndarray, wanted: float) -> Iterator[tuple[int, int, int]]:
    """(query, tree, leaf) of the leaves to visit, by one queue over all trees."""
    margins = [(vectors @ t.normals.T - t.offsets).tolist() for t in forest.trees]
    children = [t.children.tolist() for t in forest.trees]
    sizes = [t.sizes.tolist() for t in forest.trees]
    for q in range(len(vectors)):
        queue = [(-np.inf, t, 0 if len(tree.normals) else -1) for t, tree in enumerate(forest.trees)]
        heapq.heapify(queue)
        own = [m[q] for m in margins]
        seen = 0.0
        while queue and seen < wanted:
            worst, t, node = heapq.heappop(queue)
            if node < 0:
                seen += sizes[t][-1 - node] * forest.scale
                yield q, t, -1 - node
                continue
            m = own[t][node]
            low, high = children[t][node]
            heapq.heappush(queue, (max(worst, m), t, low))
            heapq.heappush(queue, (max(worst, -m), t, high))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows that take part, as double arrays of one length."""
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("v") == F.lit(lengths["n"] if lengths else 0))


def points_of(rows: DataFrame, k: int) -> DataFrame:
    """(point, v, ids): different vectors; point is the smallest id, ids are the k + 1 smallest."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            flat = np.ascontiguousarray(vectors.flatten().to_numpy()) + 0.0  # one zero
            matrix = flat.reshape(batch.num_rows, -1)
            ids = batch.column(0).to_numpy()
            raw = matrix.view(np.dtype((np.void, matrix.shape[1] * 8))).ravel()
            order = np.lexsort((ids, np.unique(raw, return_inverse=True)[1]))
            same = np.concatenate([[False], raw[order][1:] == raw[order][:-1]])
            starts = np.flatnonzero(~same)
            groups = [np.unique(g)[: k + 1] for g in np.split(ids[order], starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([matrix[order[s]].tobytes() for s in starts], pa.binary()),
                    pa.array([g.tolist() for g in groups], pa.list_(pa.int64())),
                ],
                names=["v", "ids"],
            )

    partial = map_batches(rows, combine, "v binary, ids array<long>")
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return partial.groupBy("v").agg(smallest.alias("ids")).select(F.col("ids")[0].alias("point"), "v", "ids")


def blocks(rows: DataFrame, name: str, salt: int, width: int) -> DataFrame:
    """(tree, leaf, names, matrix): up to BLOCK rows of a leaf together; a leaf is dealt out by `salt`."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def block() -> pa.RecordBatch:
            ids, parts = zip(*held)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([at[0]], pa.int32()),
                    pa.array([at[1]], pa.int32()),
                    pa.array([list(ids)], pa.list_(pa.int64())),
                    pa.array([b"".join(parts)], pa.binary()),
                ],
                names=["tree", "leaf", f"{name}_ids", f"{name}_matrix"],
            )

        for batch in batches:
            for tree, leaf, i, v in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (at != (tree, leaf) or len(held) == BLOCK):
                    yield block()
                    held = []
                at = (tree, leaf)
                held.append((i, v))
        if held:
            yield block()

    dealt = rows.repartition("tree", "leaf", F.pmod(F.xxhash64("id"), F.lit(salt))).sortWithinPartitions("tree", "leaf", "id")
    return map_batches(
        dealt.select("tree", "leaf", "id", "v"),
        gather,
        f"tree int, leaf int, {name}_ids array<long>, {name}_matrix binary",
    )


def nearest(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    step: int = QUERY_STEP,
    trees: int = TREES,
    leaves: int = LEAVES,
    share: float = SHARE,
    seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for every id divisible by `step`."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors, key, vector), "forest-rows")
    points = stored(points_of(rows, k), "forest-points")
    facts = points.agg(F.count("*").alias("n"), F.max(F.length("v")).alias("bytes")).first()
    n, width = facts["n"], (facts["bytes"] or 8) // 8
    # a query is a row; queries of one vector search once
    as_bytes = _binary(rows.filter(F.pmod("id", F.lit(step)) == 0))
    queries = stored(as_bytes.join(points.select("v", "point"), "v").select(F.col("id").alias("query_id"), "point").distinct(), "forest-queries")

    part = min(1.0, FIT_ROWS / max(1, n))
    sample = points.filter(F.pmod(F.xxhash64("point"), F.lit(1 << 20)) < F.lit(int(part * (1 << 20)))).orderBy("point")
    fit = [np.frombuffer(r["v"], "<f8") for r in sample.select("v").collect()]
    top = map_batches(points.select("v"), _largest_norm, "norm double").agg(F.max("norm")).first()[0] or 0.0
    sampled = augmented(np.array(fit).reshape(-1, width), top)
    forest = Forest([grow(sampled, leaves, seed + i) for i in range(trees)], top, n / max(1, len(fit)))
    held = spark.sparkContext.broadcast(forest)
    salt = max(1, -(-n // (leaves * 65_536)))
    wanted = max(share * n, float(4 * trees * (k + 1)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            inside = augmented(_matrix(batch.column(1), width), forest.norm)
            for t, tree in enumerate(forest.trees):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(inside), t, np.int32)),
                        pa.array(leaves_of(tree, inside).astype(np.int32)),
                        batch.column(0),
                        batch.column(1),
                    ],
                    names=["tree", "leaf", "id", "v"],
                )

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = held.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                own = _matrix(some.column(1), width)
                own = np.concatenate([own, np.zeros((len(own), 1))], axis=1)
                found = np.array(list(probes(forest, own, wanted)), np.int64).reshape(-1, 3)
                q = pa.array(found[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found[:, 1].astype(np.int32)),
                        pa.array(found[:, 2].astype(np.int32)),
                        some.column(0).take(q),
                        some.column(1).take(q),
                    ],
                    names=["tree", "leaf", "id", "v"],
                )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, p_ids = (np.array(batch.column(c)[i].as_py(), np.int64) for c in (0, 2))
                q, p = (np.frombuffer(batch.column(c)[i].as_py(), "<f8").reshape(-1, width) for c in (1, 3))
                scores = q @ p.T
                many = min(k + 1, len(p_ids))
                best = np.lexsort((np.broadcast_to(p_ids, scores.shape), -scores), axis=1)[:, :many]
                pair_q = np.repeat(np.arange(len(q_ids)), many)
                pair_p = best.ravel()
                exact = (q[pair_q] * p[pair_p]).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[pair_q]), pa.array(p_ids[pair_p]), pa.array(exact)], names=["q", "p", "score"]
                )

    schema = "tree int, leaf int, id long, v binary"
    placed = map_batches(points.select("point", "v"), place, schema)
    asked = queries.select("point").distinct().join(points.select("point", "v"), "point")
    visits = map_batches(asked.repartition("point"), visit, schema)
    met = blocks(visits, "q", salt, width).join(blocks(placed, "p", salt, width), ["tree", "leaf"])
    met = met.select("q_ids", "q_matrix", "p_ids", "p_matrix")
    found = map_batches(met, score, "q long, p long, score double")
    found = found.groupBy("q", "p").agg(F.max("score").alias("score"))

    first = Window.partitionBy("q").orderBy(F.desc("score"), "p")
    found = found.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).drop("n")
    found = found.join(points.select(F.col("point").alias("p"), "ids"), "p")
    found = found.select("q", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    # the best k + 1 of a vector serve all its queries: each drops its own id, or the last
    lists = found.groupBy(F.col("q").alias("point")).agg(
        F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found")
    )
    out = queries.join(lists, "point").select(
        "query_id",
        F.posexplode(F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("rank", "f"),
    )
    return out.select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score")
    )


def _binary(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) + 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in matrix], pa.binary())], names=["id", "v"]
            )

    return map_batches(rows, run, "id long, v binary")


def _largest_norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        norms = [float((x * x).sum()) for x in (np.frombuffer(v, "<f8") for v in batch.column(0).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([max(norms, default=0.0)])], names=["norm"])
