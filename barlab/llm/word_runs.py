"""Periodic runs of words: maximal stretches that repeat with a period, and texts with the repeats taken out.

A run is a stretch of consecutive words whose smallest period is q, whose length is at least max(MIN_LENGTH,
MIN_POWER * q) and which no neighbouring word extends with period q. Per text, for every period q, the places on a
grid of step (MIN_POWER - 1) * q are compared with the places q words on: every run of that period holds such a pair,
and as the steps grow with the periods all grids together have n log n places. A pair that agrees is extended to
both sides by longest common extensions; the extended stretch is the run, whatever pair found it.

Extensions use a difference cover: a few words are compared until both places stand on sampled positions, and from
there the range minimum over the common prefixes of the sorted sampled suffixes gives the rest in constant time.
Most pairs differ within the first words, so most texts need no suffixes at all.

Defined results: a null text has no words; words are maximal stretches other than blank, tab, line feed, vertical tab,
form feed and carriage return; other blanks belong to words. Rows with a null or repeated key stand for themselves;
extra columns are not read. A text is handled by one task, in memory proportional to its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import each_batch, map_batches, text_column

MIN_LENGTH = 6
MIN_POWER = 4

# Every difference modulo 7 is a difference of two members: any two places meet on sampled positions within 7 words.
MODULUS = 7
COVER = (1, 2, 4)
# So many words are compared before sampled suffixes are asked for; chance repeats are shorter.
FIRST_WORDS = 4
GRID_CHUNK = 1 << 20

RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>"


def _shifts() -> np.ndarray:
    """The least shift, FIRST_WORDS or more, after which residues (a, b) both stand in the cover."""
    out = np.zeros((MODULUS, MODULUS), np.int64)
    for a in range(MODULUS):
        for b in range(MODULUS):
            out[a, b] = next(
                s for s in range(FIRST_WORDS, FIRST_WORDS + MODULUS)
                if (a + s) % MODULUS in COVER and (b + s) % MODULUS in COVER
            )
    return out


SHIFTS = _shifts()


class CoverLce:
    """Longest common extensions to the right between places i < j of one sequence of word numbers (1 or more)."""

    def __init__(self, numbers: np.ndarray):
        self.n = len(numbers)
        # zeros past the end: they differ from every word
        self.words = np.concatenate([numbers, np.zeros(2 * MODULUS + FIRST_WORDS, numbers.dtype)])
        self.minima: np.ndarray | None = None

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i and j on."""
        shift = SHIFTS[i % MODULUS, j % MODULUS]
        same = np.zeros(len(i), np.int64)
        alive = np.arange(len(i))
        step = 0
        while len(alive):
            agree = self.words[i[alive] + step] == self.words[j[alive] + step]
            alive = alive[agree]
            same[alive] += 1
            step += 1
            alive = alive[shift[alive] > step]
        deep = np.flatnonzero((same == shift) & (j + shift < self.n))
        if len(deep):
            if self.minima is None:
                self._sort_samples()
            same[deep] += self._common(i[deep] + shift[deep], j[deep] + shift[deep])
        return same

    def _sort_samples(self) -> None:
        """Ranks of the sampled suffixes by prefix doubling over windows of MODULUS words, and their common prefixes."""
        members = [np.arange(c, self.n, MODULUS) for c in COVER]
        place = np.concatenate(members)
        ends = np.cumsum([len(m) for m in members])
        self.offset = np.zeros(MODULUS, np.int64)
        self.offset[list(COVER)] = ends - [len(m) for m in members]
        count = len(place)
        last = np.repeat(ends, [len(m) for m in members])  # one past the last sample of the same residue
        windows = [self.words[place + k] for k in range(MODULUS)]
        order = np.lexsort(windows[::-1])
        new = np.ones(count, bool)
        new[1:] = np.any([w[order[1:]] != w[order[:-1]] for w in windows], axis=0)
        levels = [self._ranks(order, new)]
        while levels[-1].max(initial=0) < count:
            rank, ahead = levels[-1], np.arange(count) + (1 << (len(levels) - 1))
            following = np.where(ahead < last, rank[np.minimum(ahead, count - 1)], 0)
            key = rank.astype(np.int64) * (count + 1) + following
            order = np.argsort(key, kind="stable")
            new[1:] = key[order[1:]] != key[order[:-1]]
            levels.append(self._ranks(order, new))
        self.rank = levels[-1] - 1
        common = self._neighbours(place, last, order, levels)
        height = max(1, len(common).bit_length())
        self.minima = np.zeros((height, max(1, len(common))), np.int32)
        self.minima[0, : len(common)] = common
        for k in range(1, height):
            half, width = 1 << (k - 1), len(common) - (1 << k) + 1
            if width > 0:
                np.minimum(
                    self.minima[k - 1, :width], self.minima[k - 1, half : half + width], out=self.minima[k, :width]
                )

    @staticmethod
    def _ranks(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Ranks from 1, equal for equal windows."""
        rank = np.empty(len(order), np.int32)
        rank[order] = np.cumsum(new)
        return rank

    def _neighbours(self, place: np.ndarray, last: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common words of each sorted suffix and the next: whole windows by the doubled ranks, then single words."""
        a, b = order[:-1].copy(), order[1:].copy()
        out = np.zeros(len(a), np.int64)
        open_ = np.ones(len(a), bool)
        end_a, end_b = last[a], last[b]
        for k in range(len(levels) - 1, -1, -1):
            rank = levels[k]
            safe_a, safe_b = np.minimum(a, len(place) - 1), np.minimum(b, len(place) - 1)
            agree = (a < end_a) & (b < end_b) & (rank[safe_a] == rank[safe_b])
            a, b = a + (agree << k), b + (agree << k)
            out += (agree << k) * MODULUS
        x, y = place[order[:-1]] + out, place[order[1:]] + out
        for k in range(MODULUS):
            inside = open_ & (np.maximum(x, y) + k < self.n)
            at = np.flatnonzero(inside)
            agree = self.words[x[at] + k] == self.words[y[at] + k]
            open_ = np.zeros(len(x), bool)
            open_[at[agree]] = True
            out += open_
        return out

    def _common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words of the sampled suffixes i and j: the least common prefix between their ranks."""
        a = self.rank[self.offset[i % MODULUS] + i // MODULUS]
        b = self.rank[self.offset[j % MODULUS] + j // MODULUS]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        return np.minimum(self.minima[level, low], self.minima[level, high - (1 << level)])


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of all grids of a sequence of n words, in pieces of about GRID_CHUNK."""
    period = 1
    while period <= n // MIN_POWER:
        step = (MIN_POWER - 1) * period
        until = min(n // MIN_POWER, period + max(1, GRID_CHUNK * step // n))
        periods = np.arange(period, until + 1)
        steps = (MIN_POWER - 1) * periods
        counts = -(-(n - periods) // steps)
        first = np.cumsum(counts) - counts
        place = (np.arange(counts.sum()) - np.repeat(first, counts)) * np.repeat(steps, counts)
        yield place, np.repeat(periods, counts)
        period = until + 1


def runs_of(numbers: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    n = len(numbers)
    ahead, back = CoverLce(numbers), CoverLce(numbers[::-1].copy())
    found = [np.zeros((0, 3), np.int64)]
    if n >= MIN_LENGTH:
        for i, q in _grid(n):
            near = numbers[i] == numbers[i + q]
            i, q = i[near], q[near]
            left = back.extend(n - 1 - i - q, n - 1 - i) - 1
            right = ahead.extend(i, i + q)
            length = left + q + right
            long = length >= np.maximum(MIN_LENGTH, MIN_POWER * q)
            found.append(np.column_stack([(i - left)[long], length[long], q[long]]))
    rows = np.concatenate(found)
    # the same stretch found with a multiple of its period, or from several places, is one run
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def number_words(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, from 1."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known) + 1) for w in words], np.int32)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: a run keeps its first period only."""
    dropped = np.zeros(n + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(dropped[:n]) == 0


Order = Callable[[object, int], np.ndarray | None]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", order: Order | None = None) -> DataFrame:
    """(key, n_words, runs, collapsed) of every document: its runs by start, and its kept words joined by one blank.

    `order(key, n)` may give the word numbers that the text is read by instead of 0 .. n - 1 (None: as it stands).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches, 256):
            counts, lists, texts = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = t.split()
                numbers = number_words(words)
                taken = order(k, len(words)) if order else None
                if taken is not None:
                    words, numbers = [words[i] for i in taken], numbers[taken]
                runs = runs_of(numbers)
                if len(runs):
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs))]
                counts.append(len(numbers))
                lists.append(runs)
                texts.append(b" ".join(words))
            flat = np.concatenate(lists)
            entries = pa.StructArray.from_arrays(
                [pa.array(flat[:, c]) for c in range(3)], names=["start", "length", "period"]
            )
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), entries),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                names=[key, "n_words", "runs", "collapsed"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text_column(text).alias("text"))
    return map_batches(rows, run, f"`{key}` {kind}, n_words long, {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties: smallest start, then period."""

    def better(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        earlier = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))
        return F.when((x > y) | ((x == y) & earlier), a).otherwise(b)

    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), better)


def run_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", order: Order | None = None) -> DataFrame:
    """One row per document: number of runs, the strongest run, and digests of all runs and of the kept words."""
    best = strongest(F.col("runs"))
    lines = F.transform(
        "runs",
        lambda r: F.concat(*[x for f in ("start", "length", "period") for x in (r[f].cast("string"), F.lit(","))][:-1], F.lit("\n")),
    )
    rows = periodic_runs(docs, key, text, order).withColumn("_best", best)
    return rows.select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(F.expr("(1000 * _best.length) div _best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
        "n_words",
    )
