"""Pack tokenized documents into windows by non-negative least squares over the length histogram.

1. One pass tokenizes the texts (end id appended) and stores ids with each row's rank among the rows of equal
   tail length in the same input split. A document longer than the window fills whole windows first; the rest is
   its tail.
2. The tail histogram (at most `window` numbers) goes to the driver. Tail lengths are put into bins; all
   combinations of up to three bins that fill a window are the columns of a non-negative least squares problem,
   whose solution says how often each combination is used. Counts are rounded down and spent on exact lengths.
3. What is left is packed greedily, longest first, and cut where a window is full.
4. A row's window and offset follow from its length and its rank alone, so ids are never shuffled.

Defined results: null and empty texts hold only the end id; repeated rows and ids are packed one by one; an empty
table gives an empty result; other columns are ignored. Every window but the last starts at offset 0 and has no
gap; windows of combinations may end up to a few tokens early (the padding), as may the very last window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.chunks import ByteEncoder, per_worker
from barlab.llm.common import each_batch, map_batches, scratch_uri, stored, text_column, tokenizer_path

WINDOW = 2048
END_ID = 1
BINS = 256
BROADCAST_OFFSETS = 300_000  # rows of (split, tail length, rank offset), about 24 bytes each
SPLIT_GROUP = 64  # splits whose offsets stand in one file


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, window: int, text: str = "text") -> DataFrame:
    """doc_id, ids (binary), n, tail, part, nth (rank among equal tails in the part), before (full windows before)."""
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(ByteEncoder, path)
        end = np.array([end_id], encoder.dtype).tobytes()
        width = encoder.dtype.itemsize
        part = TaskContext.get().partitionId()
        seen = np.zeros(window, np.int64)
        full = 0
        for batch in each_batch(batches):
            ids = [x.tobytes() + end for x in encoder.ids(batch.column(1)).slices()]
            n = np.array([len(x) // width for x in ids], np.int64)
            tail, nth, before = n % window, np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for i, t in enumerate(tail.tolist()):
                nth[i], before[i] = seen[t], full
                seen[t] += 1
                full += n[i] // window
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(ids, pa.binary()),
                    pa.array(np.full(len(n), width, np.int32)),
                    pa.array(n),
                    pa.array(tail),
                    pa.array(np.full(len(n), part, np.int64)),
                    pa.array(nth),
                    pa.array(before),
                ],
                names=["doc_id", "ids", "width", "n", "tail", "part", "nth", "before"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        docs.select("doc_id", text_column(text).alias("text")),
        run,
        f"doc_id {kind}, ids binary, width int, n long, tail long, part long, nth long, before long",
    )


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2_000) -> np.ndarray:
    """Least squares with x >= 0 by the active-set method; only the free columns' normal equations are solved."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1e-3, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tolerance:
            break
        free[best] = True
        while True:
            index = np.flatnonzero(free)
            part = a[:, index]
            gram = part.T @ part + 1e-10 * np.eye(len(index))
            solved = np.linalg.solve(gram, part.T @ b)
            if (solved > 0).all():
                break
            low = solved <= 0
            step = min(1.0, float((x[index][low] / np.maximum(x[index][low] - solved[low], 1e-300)).min()))
            x[index] += step * (solved - x[index])
            dropped = index[x[index] <= 1e-12]
            if not len(dropped):
                dropped = index[[int(np.argmin(solved))]]
            x[dropped], free[dropped] = 0, False
        x[:] = 0
        x[index] = solved
    return x


def combinations(bins: int, present: np.ndarray) -> list[tuple[int, ...]]:
    """All ways to fill a window of `bins` units with one, two or three bins that hold something."""
    have = set(np.flatnonzero(present).tolist())
    out: list[tuple[int, ...]] = [(bins,)] if bins in have else []
    for a in range(bins - 1, 0, -1):
        if a not in have:
            continue
        if bins - a <= a and bins - a in have:
            out.append((a, bins - a))
        for b in range(min(a, bins - a - 1), 0, -1):
            c = bins - a - b
            if c > b:
                break
            if b in have and c in have:
                out.append((a, b, c))
    return out


@dataclass
class Plan:
    """Where the tails go: per run of equal lengths its first rank, last rank, base and kind.

    A run in a combination puts rank r into window base + (r - low) at a fixed offset; a run of the rest
    starts at token `base` of the greedy stream and goes on gapless.
    """

    length: np.ndarray
    low: np.ndarray
    high: np.ndarray
    base: np.ndarray
    offset: np.ndarray  # -1: part of the greedy stream
    windows: int  # by combinations
    stream: int  # tokens in the greedy stream


def plan_tails(histogram: dict[int, int], window: int = WINDOW, bins: int = BINS) -> Plan:
    """Spend the histogram {tail length: rows} on combinations, then on the greedy stream."""
    unit = -(-window // bins)
    units = window // unit
    exact: dict[int, list[list[int]]] = {}
    counts = np.zeros(units + 1)
    for length in sorted(histogram, reverse=True):
        b = -(-length // unit)
        if histogram[length] and b <= units:
            exact.setdefault(b, []).append([length, histogram[length]])
            counts[b] += histogram[length]
    ways = combinations(units, counts > 0)
    runs: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(histogram, 0)
    windows = 0
    if ways:
        a = np.zeros((units + 1, len(ways)))
        for j, way in enumerate(ways):
            for b in way:
                a[b, j] += 1
        scale = counts.sum()
        times = np.floor(nnls(a, counts / scale) * scale + 1e-6).astype(np.int64)
        for j in np.argsort(-times, kind="stable"):
            way, left = ways[j], int(times[j])
            while left > 0:
                heads, take = [], left
                for b in set(way):
                    need, room = way.count(b), 0
                    queue = exact.get(b, [])
                    while queue and queue[0][1] == 0:
                        queue.pop(0)
                    if queue:
                        room = queue[0][1] // need
                        if room == 0 and sum(c for _, c in queue) >= need:
                            # the slots of one window come from several lengths of the bin
                            room = -1
                    heads.append((b, need, room))
                    take = min(take, room) if room >= 0 else take
                if take == 0:
                    break
                if any(room < 0 for _, _, room in heads):
                    take = 1
                at = 0
                for b in way:
                    queue = exact[b]
                    while queue[0][1] == 0:
                        queue.pop(0)
                    length = queue[0][0]
                    queue[0][1] -= take
                    runs.append((length, used[length], used[length] + take, windows, at))
                    used[length] += take
                    at += length
                windows += take
                left -= take
    stream = 0
    for length in sorted(histogram, reverse=True):
        if histogram[length] > used[length]:
            runs.append((length, used[length], histogram[length], stream, -1))
            stream += (histogram[length] - used[length]) * length
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    return Plan(*(table[:, i].copy() for i in range(5)), windows=windows, stream=stream)


class SplitBases:
    """What earlier input splits hold: rows of each tail length (place 0: full windows), by split."""

    def __init__(self, held: dict[int, tuple[np.ndarray, np.ndarray]] | None, folder: str | None, group: int = SPLIT_GROUP):
        self.held, self.folder, self.group, self.last = held, folder, group, (None, None)

    def of(self, part: int, window: int) -> np.ndarray:
        if self.last[0] != part:
            tails, bases = self.held[part] if self.held is not None else self._read(part)
            table = np.zeros(window, np.int64)
            table[tails] = bases
            self.last = (part, table)
        return self.last[1]

    def _read(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        system, root = fs.FileSystem.from_uri(self.folder)
        rows = pq.read_table(
            f"{root}/group={part // self.group}", filesystem=system, filters=[("part", "==", part)], partitioning=None
        )
        return rows.column("tail").to_numpy(), rows.column("base").to_numpy()


def split_bases(offsets: DataFrame, rows: int) -> SplitBases:
    """Few offsets are sent to all tasks; many are written to the shared folder, where a task reads those of its split.

    Either way the ids stay where they are.
    """
    if rows <= BROADCAST_OFFSETS:
        held: dict[int, list] = {}
        for r in offsets.collect():
            held.setdefault(r["part"], []).append((r["tail"], r["base"]))
        return SplitBases({p: tuple(np.array(x, np.int64) for x in zip(*own)) for p, own in held.items()}, None)
    folder = scratch_uri(offsets.sparkSession, "packing-bases")
    grouped = offsets.withColumn("group", F.expr(f"part div {SPLIT_GROUP}"))
    grouped.repartition("group").sortWithinPartitions("group", "part").write.partitionBy("group").parquet(folder)
    return SplitBases(None, folder, SPLIT_GROUP)


def pack(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    window: int = WINDOW,
    end_id: int = END_ID,
    text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32-bit)."""
    spark = docs.sparkSession
    tokens = stored(tokenized(docs, tokenizer, end_id, window, text), "packing")
    per_split = tokens.filter("tail > 0").groupBy("part", "tail").agg(F.count("*").alias("rows"))
    per_split = stored(per_split, "packing-tails")
    histogram = {r["tail"]: r["rows"] for r in per_split.groupBy("tail").agg(F.sum("rows").alias("rows")).collect()}
    plan = plan_tails(histogram, window)
    fulls = tokens.groupBy("part").agg(F.sum(F.floor(F.col("n") / window)).cast("long").alias("full"))
    fulls = stored(fulls, "packing-windows")
    full = fulls.agg(F.sum("full")).first()[0] or 0

    so_far = Window.rowsBetween(Window.unboundedPreceding, -1)
    by_tail = so_far.partitionBy("tail").orderBy("part")
    offsets = per_split.select(
        "part", "tail", F.coalesce(F.sum("rows").over(by_tail), F.lit(0)).alias("base")
    )
    # one row per input split; tail 0 stands for its full windows
    by_part = so_far.orderBy("part")
    splits = fulls.select(
        "part", F.lit(0).cast("long").alias("tail"), F.coalesce(F.sum("full").over(by_part), F.lit(0)).alias("base")
    )
    bases = split_bases(offsets.unionByName(splits), per_split.count())
    placed = tokens.select("doc_id", "ids", "width", "n", "tail", "nth", "before", "part")
    shared = spark.sparkContext.broadcast((plan, full, window))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, full, window = shared.value
        keys = plan.length * (1 << 40) + plan.low
        for batch in each_batch(batches):
            rows: list[tuple] = []
            owner: list[int] = []
            tails, parts = batch.column(4).to_numpy(), batch.column(7).to_numpy()
            base = np.empty((2, len(tails)), np.int64)
            for part in np.unique(parts).tolist():
                own = parts == part
                table = bases.of(part, window)
                base[0, own], base[1, own] = table[tails[own]], table[0]
            ranks = batch.column(5).to_numpy() + np.where(tails > 0, base[0], 0)
            firsts = (batch.column(6).to_numpy() + base[1]).tolist()
            found = np.searchsorted(keys, tails * (1 << 40) + ranks, side="right") - 1
            listed = [*(batch.column(c).to_pylist() for c in range(1, 5)), ranks.tolist(), firsts]
            for i, (raw, width, n, tail, rank, first) in enumerate(zip(*listed)):
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                pieces = [(k * window, window, first + k, 0) for k in range(n // window)]
                at = n - tail
                if tail:
                    p = found[i]
                    run_base, past = int(plan.base[p]), rank - int(plan.low[p])
                    if plan.offset[p] >= 0:
                        pieces.append((at, tail, full + run_base + past, int(plan.offset[p])))
                    else:
                        place = run_base + past * tail
                        head = min(tail, window - place % window)
                        where = full + plan.windows + place // window
                        pieces.append((at, head, where, place % window))
                        if head < tail:
                            pieces.append((at + head, tail - head, where + 1, 0))
                for start, length, sequence, offset in pieces:
                    rows.append((start, length, n, sequence, offset, ids[start : start + length].tobytes()))
                    owner.append(i)
            columns = list(zip(*rows)) if rows else [[] for _ in range(6)]
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64()))]
                + [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return map_batches(placed, run, schema)


def pieces_digest(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pack(docs, tokenizer).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
