"""Ranked lexical search: each item's best documents by summed term impacts, found best interval first.

Documents are read once per block of items: a task counts the terms of its texts that any item of the block asks for
(one row of term numbers and counts per document, stored). Two small aggregations give the corpus figures: documents
with a term, all terms, and the documents of each term asked for. Then every task cuts its documents into segments of
bounded size. A segment holds a posting list per term (documents by rising key, impacts) with a sparse table of range
maxima over the list. For an item, an interval of documents is bounded by the sum of its terms' range maxima. The
intervals wait in one queue, best bound first; the best ones are taken, their document of greatest single impact is
scored in full, and what lies left and right of it waits with its own bound. An interval that can't beat the worst
of the kept documents is never opened; tasks carry the kept documents from segment to segment. Last, the tasks'
best documents meet per item.

Score: a term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))) in doubles, the rest 64-bit integers with division
rounding down: m = 100 - B + (B n N) div L with B = 50, impact = w ((10^9 tf) div (1000 tf + 20 m)).

Defined results: null texts have no terms; documents with score 0 are no results; rows of one item id make one item,
a null item id included; repeated document keys are separate documents, a null key ranks before all others at equal
score; extra columns are not read. An empty table on either side gives no rows.
Items come in blocks that expect half of BLOCK_TERMS (item, term) pairs each, which bounds what the driver and every
task hold of them; one item is never split.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, ShortType, StructField, StructType

from barlab.llm.common import each_batch, map_batches, stored, text_column

TOP = 50
BLOCK_TERMS = 400_000
SEGMENT_DOCS = 8_192
SEGMENT_POSTINGS = 1 << 20
# So many of the best intervals are opened together, by array operations.
OPENED = 32

# On UTF-8 bytes: all bytes of characters beyond ASCII have the high bit, and lower() touches only A-Z.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_NULL_KEY = np.iinfo(np.int64).min


def terms_of(text: bytes) -> list[bytes]:
    """Maximal stretches of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased."""
    return _TERM.findall(text.lower())


def term_weight(documents: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


@dataclass(frozen=True)
class Corpus:
    documents: int
    terms: int
    weights: np.ndarray  # by term number

    def impacts(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 50 + (50 * n * self.documents) // self.terms
        return self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Segment:
    """Posting lists of some documents (numbered by rising key) with range maxima over each list."""

    def __init__(self, documents: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        order = np.lexsort((doc, term))
        self.documents = documents
        self.doc, self.impact = doc[order].astype(np.int32), impact[order]
        self.starts = np.searchsorted(term[order], np.arange(terms + 1))
        longest = int(np.diff(self.starts).max(initial=1))
        # best[k, i]: where the greatest impact of the list places i .. i + 2^k - 1 stands; ties: the first
        self.best = np.zeros((longest.bit_length(), len(doc)), np.int32)
        self.best[0] = np.arange(len(doc))
        for k in range(1, len(self.best)):
            half, width = 1 << (k - 1), len(doc) - (1 << k) + 1
            a, b = self.best[k - 1, :width], self.best[k - 1, half : half + width]
            self.best[k, :width] = np.where(self.impact[b] > self.impact[a], b, a)

    def item(self, terms: np.ndarray) -> ItemView:
        return ItemView(self, terms[self.starts[terms] < self.starts[terms + 1]])


class ItemView:
    """The posting lists of one item: bounds and best documents of document intervals."""

    def __init__(self, segment: Segment, terms: np.ndarray):
        self.segment = segment
        self.terms = len(terms)
        # places[t, d]: where in the lists the documents of term t from d on begin
        self.places = np.empty((len(terms), segment.documents + 1), np.int32)
        edges = np.arange(segment.documents + 1)
        for row, t in enumerate(terms):
            low, high = segment.starts[t], segment.starts[t + 1]
            self.places[row] = low + np.searchsorted(segment.doc[low:high], edges)

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed range maxima of the intervals [low, high), and the document of the greatest single impact."""
        s = self.segment
        start, end = self.places[:, low], self.places[:, high]
        length = end - start
        some = length > 0
        level = np.frexp(length.astype(np.float32))[1] - 1
        level = np.where(some, level, 0)
        start = np.where(some, start, 0)
        a = s.best[level, start]
        b = s.best[level, np.where(some, end - (1 << level), 0)]
        x, y = s.impact[a], s.impact[b]
        top = np.where(some, np.maximum(x, y), 0)
        which = top.argmax(axis=0)
        column = np.arange(len(low))
        place = np.where(y[which, column] > x[which, column], b[which, column], a[which, column])
        return top.sum(axis=0), s.doc[place]

    def scores(self, doc: np.ndarray) -> np.ndarray:
        """Full scores of single documents: intervals of length one."""
        s = self.segment
        start = self.places[:, doc]
        held = self.places[:, doc + 1] > start
        return np.where(held, s.impact[np.where(held, start, 0)], 0).sum(axis=0)


class Kept:
    """The best documents of an item so far: a heap whose head is the worst, (score, -key) rising."""

    def __init__(self, top: int):
        self.top, self.heap = top, []

    def offer(self, score: int, key: int) -> None:
        entry = (score, -key)
        if len(self.heap) < self.top:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)

    def hopeless(self, bound: int, key: int) -> bool:
        """Whether documents from `key` on, with scores up to `bound`, can't enter."""
        return bound <= 0 or (len(self.heap) == self.top and (bound, -key) <= self.heap[0])


def search(view: ItemView, keys: np.ndarray, kept: Kept) -> None:
    """Offer every document of the segment that may belong to the best; `keys` rises with the document numbers."""
    if not view.terms:
        return
    bound, split = view.bounds(np.array([0]), np.array([view.segment.documents]))
    waiting = [(-int(bound[0]), 0, view.segment.documents, int(split[0]))]
    while waiting:
        opened = []
        while waiting and len(opened) < OPENED:
            if kept.hopeless(-waiting[0][0], int(keys[waiting[0][1]])):
                # the head has the best bound; a tie on it is settled by its smallest key
                if len(kept.heap) == kept.top and -waiting[0][0] < kept.heap[0][0] or waiting[0][0] >= 0:
                    waiting = []
                    break
                heapq.heappop(waiting)
                continue
            opened.append(heapq.heappop(waiting))
        if not opened:
            return
        _, low, high, at = (np.array(x) for x in zip(*opened))
        for score, doc in zip(view.scores(at).tolist(), at.tolist()):
            kept.offer(score, int(keys[doc]))
        lows, highs = np.concatenate([low, at + 1]), np.concatenate([at, high])
        some = lows < highs
        lows, highs = lows[some], highs[some]
        if len(lows):
            bound, split = view.bounds(lows, highs)
            least = kept.heap[0][0] if len(kept.heap) == kept.top else 1
            for i in np.flatnonzero(bound >= least).tolist():
                heapq.heappush(waiting, (-int(bound[i]), int(lows[i]), int(highs[i]), int(split[i])))


def item_blocks(items: DataFrame, key: str, text: str, block_terms: int) -> tuple[DataFrame, int]:
    """Stored (item, term, block) pairs, and the number of blocks.

    Items are dealt to blocks by hash, so many that a block may expect half of `block_terms` pairs.
    """
    upper = "".join(map(chr, range(65, 91)))
    lowered = F.translate(text_column(text), upper, upper.lower())
    words = F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    pairs = items.select(F.col(key).alias("item"), F.explode(words).alias("term")).distinct()
    pairs = stored(pairs, "search-pairs")
    total = pairs.count()
    blocks = math.ceil(2 * total / block_terms)
    if not blocks:
        return pairs, 0
    return pairs.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), blocks


def _documents_of(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of bounded size: keys, lengths, and postings as (document, term, tf)."""
    held: list[pa.RecordBatch] = []
    docs = postings = 0
    for batch in rows:
        start = 0
        while start < batch.num_rows:
            sizes = np.diff(batch.column(2).offsets.to_numpy()[start:])
            room = np.searchsorted(np.cumsum(sizes), SEGMENT_POSTINGS - postings, side="right")
            take = max(min(int(room), SEGMENT_DOCS - docs, batch.num_rows - start), 0 if held else 1)
            if take:
                held.append(batch.slice(start, take))
                docs, postings, start = docs + take, postings + int(sizes[:take].sum()), start + take
            if start < batch.num_rows:
                yield _segment_rows(held)
                held, docs, postings = [], 0, 0
    if held:
        yield _segment_rows(held)


def _segment_rows(held: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    table = pa.Table.from_batches(held).combine_chunks()
    key = table.column(0).combine_chunks().fill_null(_NULL_KEY).to_numpy(zero_copy_only=False)
    n = table.column(1).to_numpy()
    term, tf = (table.column(c).combine_chunks() for c in (2, 3))
    sizes = np.diff(term.offsets.to_numpy())
    order = np.argsort(key, kind="stable")
    number = np.empty(len(key), np.int64)
    number[order] = np.arange(len(key))
    doc = np.repeat(number, sizes)
    return key[order], n[order], doc, term.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64)


def _counted(docs: DataFrame, terms: list[bytes], key: str) -> DataFrame:
    """Per document with a term: key, n, and the counts of the terms asked for (term numbers rise)."""
    number = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.keys()
        for batch in each_batch(batches, 512):
            rows, sizes, found, counts = [], [], [], []
            for row, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                own = terms_of(text)
                if own:
                    counted = Counter(own)
                    asked = sorted((number[t], counted[t]) for t in counted.keys() & known)
                    rows.append(row)
                    sizes.append(len(own))
                    found.append(np.array([t for t, _ in asked], np.int32))
                    counts.append(np.array([c for _, c in asked], np.int64))
            if rows:
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found))),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts))),
                    ],
                    names=["key", "n", "term", "tf"],
                )

    rows = docs.select(F.col(key).cast("long").alias("key"), text_column("_text").alias("text"))
    return map_batches(rows, run, "key long, n long, term array<int>, tf array<long>")


def _block(docs: DataFrame, asked: list[tuple[object, list[bytes]]], key: str, top: int) -> DataFrame:
    """(item number of the block, key, score): every task's best documents of each item."""
    terms = sorted({t for _, own in asked for t in own})
    rows = stored(_counted(docs, terms, key), "search-counts")
    figures = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    having = np.zeros(len(terms), np.int64)
    for r in rows.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
        having[r["t"]] = r["df"]
    weights = np.array([term_weight(figures[0], int(h)) for h in having], np.int64)
    corpus = Corpus(figures[0], figures[1] or 1, weights)
    number = {t: i for i, t in enumerate(terms)}
    # terms in every document weigh nothing
    items = [np.array(sorted(t for t in map(number.get, own) if weights[t] > 0), np.int64) for _, own in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [Kept(top) for _ in items]
        for keys, n, doc, term, tf in _documents_of(batches):
            impact = corpus.impacts(term, tf, n[doc])
            segment = Segment(len(keys), doc, term, impact, len(terms))
            for own, best in zip(items, kept):
                search(segment.item(own), keys, best)
        for i, best in enumerate(kept):
            if best.heap:
                scores = np.array([score for score, _ in best.heap], np.int64)
                found = np.array([-key for _, key in best.heap], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), i, np.int32)), pa.array(found, mask=found == _NULL_KEY), pa.array(scores)],
                    names=["number", "key", "score"],
                )

    return map_batches(rows, run, "number int, key long, score long")


def ranked_search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item, rank, key, score): each item's `top` best documents with a score above 0."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).alias(key), F.col(text).alias("_text"))
    pairs, blocks = item_blocks(items, item, item_text, block_terms)
    whole_key = isinstance(docs.schema[key].dataType, (LongType, IntegerType, ShortType))
    if not whole_key:
        raise TypeError("the document key must be an integer")
    kind = items.schema[item].dataType
    out = None
    for block in range(blocks):
        # bounded: the pairs of one block
        grouped = pairs.where(F.col("block") == block).groupBy("item").agg(F.collect_list("term").alias("terms")).collect()
        if not grouped:
            continue
        asked = [(r["item"], [t.encode() for t in r["terms"]]) for r in grouped]
        named = spark.createDataFrame(
            [(i, k) for i, (k, _) in enumerate(asked)],
            StructType([StructField("number", IntegerType()), StructField(item, kind)]),
        )
        found = _block(texts, asked, key, top)
        place = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_first("key"))
        ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
        part = ranked.join(F.broadcast(named), "number").select(item, "rank", F.col("key").alias(key), "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        key_kind = docs.schema[key].dataType.simpleString()
        empty = spark.createDataFrame([], StructType([StructField(item, kind)]))
        return empty.selectExpr(f"`{item}`", "1 AS rank", f"CAST(null AS {key_kind}) AS `{key}`", "0L AS score")
    return out
