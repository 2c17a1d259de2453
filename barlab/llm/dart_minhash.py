"""Near-duplicate documents by DartMinHash signatures, banded joining and an exact check.

A document is the weighted set of its five-word shingles (weight: how often the shingle occurs; fewer than five
words make one shingle). Over every element lie strips of weight [0,1), [1,2), [2,4), [4,8), ...; hashed darts hit
a strip in order of their rank like a Poisson process whose rate is the strip's width. A dart counts if its weight
lies below the element's weight. It falls into one of `k` coordinates; a coordinate keeps its earliest dart.
Two signatures agree in a coordinate with probability equal to the weighted Jaccard similarity, and only about
k ln k + 2k darts are thrown per document, whatever its size.

1. Texts of the same words form one class by their 128-bit hash; one document stands for them.
2. Signatures are cut into bands. In each band bucket all documents are linked with one of them, chosen by hash
   and so a different one in each band; a link holds if the exact similarity reaches the threshold.
3. Verified links join classes. Where buckets then still hold several classes, members too many of whose shingles
   are in no other such member's text can have no partner and are left out by an exact bound. The others are compared
   across classes in blocks; pairs are never made into rows.

Defined results: null and empty texts (no word) form no links and keep a class of their own; exact copies, also of
one word, share a class; the class id is the smallest document id of the class; rows that repeat an id count as one
document if their text is the same, and any of their texts may link the id otherwise; rows without an id are left
out of links (class null); extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import each_batch, free_name, map_batches, stored, text_column
from barlab.llm.components import components
from barlab.llm.token_files import mix

SHINGLE = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 16, 4
WORD_CACHE = 400_000
STAR_TURNS = 2
BROADCAST_IDS = 200_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class WordHashes(dict):
    """64-bit hashes of words with a bounded cache."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < WORD_CACHE:
            self[word] = value
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(words: list[str], hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """One 64-bit number per run of `size` words; fewer words make one shingle, none make none."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(len(words), size), np.uint64)
    for j in range(min(size, len(words))):
        out *= _ODD[0]
        out += h[j : j + n]
    return mix(out)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two multisets."""
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def dart_signatures(
    elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n_sets: int, k: int, seed: int = 1
) -> np.ndarray:
    """Signatures (n_sets x k) of weighted sets given as flat arrays; every set needs positive total weight."""
    total = np.bincount(owner, weights, n_sets)
    reach = k * (math.log(k) + 2) / total  # rank up to which darts are thrown
    signature = np.zeros((n_sets, k), np.uint64)
    todo = np.ones(n_sets, bool)
    while todo.any():
        earliest = np.full(n_sets * k, np.inf)
        places, ranks, names = _darts(elements, weights, owner, np.where(todo, reach, -1.0), k, seed)
        np.minimum.at(earliest, places, ranks)
        first = ranks == earliest[places]
        flat = signature.reshape(-1)
        flat[places[first]] = names[first]
        done = np.isfinite(earliest).reshape(n_sets, k).all(axis=1)
        todo &= ~done
        reach *= 2
    return signature


def _darts(elements, weights, owner, reach, k, seed):
    """All darts of rank below each set's reach: (set and coordinate, rank, name)."""
    places, ranks, names = [], [], []
    top = float(weights.max(initial=0.0))
    low, width, strip = 0.0, 1.0, 0
    while low < top:
        inside = np.flatnonzero((weights > low) & (reach[owner] > 0))
        own, limit, over = owner[inside], reach[owner[inside]], weights[inside] - low
        base = elements[inside] * _ODD[3] + mix(np.array([strip], np.uint64) ^ np.uint64(seed))
        rank, nth = np.zeros(len(inside)), 0
        while len(inside):
            name = mix(base + mix(np.array([nth], np.uint64)))
            rank = rank - np.log(((name >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / width
            on = np.flatnonzero(rank < limit)
            if len(on) < len(rank):
                base, rank, own, limit, over, name = (x[on] for x in (base, rank, own, limit, over, name))
            if not len(base):
                break
            spot = mix(name ^ _ODD[2])
            hit = ((spot >> np.uint64(32)).astype(np.float64) * 2.0**-32) * width < over
            places.append((own * k + ((spot & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64))[hit])
            ranks.append(rank[hit])
            names.append(name[hit])
            nth += 1
        low, width, strip = (1.0, 1.0, 1) if strip == 0 else (low + width, width * 2, strip + 1)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(ranks), np.concatenate(names)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; keys of different bands differ."""
    out = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        out = mix(out * _ODD[0] + signature[:, r::rows][:, :bands])
    return mix(out + mix(np.arange(bands, dtype=np.uint64)))


def sketches(docs: DataFrame, key: str, text: str, bands: int, rows: int, size: int) -> DataFrame:
    """(id, h1, h2, keys) for every document with a word: the text's 128-bit hash and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in each_batch(batches, 256):
            ids, ones, twos, parts, weights, owner = [], [], [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = t.split()
                if not words:
                    continue
                digest = xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))
                value, count = np.unique(shingles(words, hashes, size), return_counts=True)
                owner.append(np.full(len(value), len(ids), np.int64))
                parts.append(value)
                weights.append(count.astype(np.float64))
                ids.append(i)
                ones.append(int.from_bytes(digest[:8], "little", signed=True))
                twos.append(int.from_bytes(digest[8:], "little", signed=True))
            if not ids:
                continue
            signature = dart_signatures(
                np.concatenate(parts), np.concatenate(weights), np.concatenate(owner), len(ids), bands * rows
            )
            keys = band_keys(signature, bands, rows).view(np.int64)
            flat = pa.array(keys.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), lists],
                names=["id", "h1", "h2", "keys"],
            )

    rows_in = docs.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), text_column(text).alias("text")
    )
    return map_batches(rows_in, run, "id long, h1 long, h2 long, keys array<long>")


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches the threshold.

    Only texts of documents in pairs are moved.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = stored(wanted_texts(ids, docs, key, text).distinct(), "pair-texts")
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        known: dict[str, Counter] = {}
        for batch in each_batch(batches):
            keep = []
            for i, (ta, tb) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                sets = []
                for t in (ta, tb):
                    if t not in known:
                        if len(known) > 64:
                            known.clear()
                        known[t] = Counter(shingles(t.split(), hashes, size).tolist())
                    sets.append(known[t])
                if similarity(*sets) >= threshold:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["a", "b"])

    return map_batches(joined, run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = BAND_ROWS,
    size: int = SHINGLE,
) -> DataFrame:
    """(key, class_id) for every id of the table; equal class ids mean copies or near copies."""
    sketch = stored(sketches(docs, key, text, bands, rows, size), "dart-sketches")
    # documents of the same words: the smallest id stands for them
    texts = sketch.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    texts = stored(texts, "dart-texts")
    copies = (
        sketch.select("id", "h1", "h2")
        .join(texts.filter("n > 1").select("h1", "h2", F.col("id").alias("b")), ["h1", "h2"])
        .select(F.col("id").alias("a"), "b")
        .filter("a <> b")
        .distinct()
    )
    copies = stored(copies, "dart-copies")
    reps = sketch.join(texts.select("h1", "h2", "id"), ["h1", "h2", "id"], "left_semi").dropDuplicates(["h1", "h2", "id"])
    members = reps.select("id", F.explode("keys").alias("key")).distinct()
    members = stored(members, "dart-members")
    shared = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = stored(members.join(shared, "key"), "dart-buckets")

    label = components(copies)
    for turn in range(STAR_TURNS):
        pairs = stored(star_pairs(labelled(members, label), turn), "dart-pairs")
        if pairs.isEmpty():
            break
        label = joined_classes(label, verified(pairs, docs, key, text, size, threshold))
    mixed = stored(labelled(members, label), "dart-mixed")
    if not mixed.isEmpty():
        texts = stored(wanted_texts(mixed.select("id").distinct(), docs, key, text).distinct(), "dart-texts")
        label = joined_classes(label, remaining_links(mixed, texts, size, threshold))
    ids = docs.select(F.col(key)).distinct()
    own = F.col(key).cast("long")
    return ids.join(label, own == F.col("node"), "left").select(key, F.coalesce("label", own).alias("class_id"))


def joined_classes(label: DataFrame, links: DataFrame) -> DataFrame:
    """Classes joined by more links."""
    known = label.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    return stored(components(known.unionByName(links)), "dart-labels")


def labelled(members: DataFrame, label: DataFrame) -> DataFrame:
    """(key, id, label) of the buckets that hold more than one class."""
    named = members.join(label.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("key", "id", F.coalesce("label", "id").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    return named.join(mixed.select("key"), "key", "left_semi")


def star_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (a < b) of every member with one of its bucket, another one in each turn and bucket."""
    centre = members.groupBy("key").agg(
        F.min_by(F.struct("id", "label"), F.xxhash64("key", "id", F.lit(turn))).alias("c")
    )
    pairs = members.join(centre, "key").filter("label <> c.label")
    return pairs.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct()


def possible(texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Ids of texts (id, text) that may have a partner: enough of their shingle weight is in another text too.

    This bound is exact: a shingle of one text only is in no pair's intersection.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in each_batch(batches):
            ids, values, weights = [], [], []
            for i, t in zip(*(c.to_pylist() for c in batch.columns)):
                value, count = np.unique(shingles(t.split(), hashes, size), return_counts=True)
                ids.append(np.full(len(value), i, np.int64))
                values.append(value.view(np.int64))
                weights.append(count.astype(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in (ids, values, weights)], names=["id", "shingle", "weight"]
                )

    parts = stored(map_batches(texts, run, "id long, shingle long, weight long"), "dart-shingles")
    alone = (
        parts.groupBy("shingle")
        .agg(F.min("id").alias("id"), F.max("id").alias("last"), F.sum("weight").alias("alone"))
        .filter("id = last")
        .groupBy("id")
        .agg(F.sum("alone").alias("alone"))
    )
    totals = parts.groupBy("id").agg(F.sum("weight").alias("total")).join(alone, "id", "left")
    common = F.col("total") - F.coalesce("alone", F.lit(0))
    return totals.filter(common >= threshold * F.col("total") - 1e-9).select("id")


def remaining_links(members: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links (a, b) between the classes of `members` (key, id, label), found without making pairs.

    Members that may have a partner are grouped by shared buckets, and each group is cut into blocks of bounded
    size. Two blocks of a group meet in one task, which computes all similarities at once and gives one link for two
    classes at most.
    """
    live = members.join(possible(texts, size, threshold), "id", "left_semi")
    live = stored(live, "dart-live")
    centre = live.groupBy("key").agg(F.min("id").alias("b"))
    groups = components(live.join(centre, "key").select(F.col("id").alias("a"), "b"))
    rows = (
        live.select("id", "label").distinct()
        .join(groups.select(F.col("node").alias("id"), F.col("label").alias("group")), "id")
        .join(texts, "id")
    )
    salt = max(1, -(-live.count() // (256 * BLOCK_DOCS)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: list[tuple[int, int, np.ndarray]] = []
        group, count, total = None, 0, 0

        def block() -> pa.RecordBatch:
            ids, labels, sets = zip(*held)
            columns = [[group], [f"{held[0][0]}"], [list(ids)], [list(labels)]]
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays(
                [
                    *[pa.array(c, k) for c, k in zip(columns, kinds)],
                    pa.array([[len(x) for x in sets]], pa.list_(pa.int64())),
                    pa.array([np.concatenate(sets).tobytes()], pa.binary()),
                ],
                names=["group", "block", "ids", "labels", "sizes", "elements"],
            )

        for batch in batches:
            for g, i, label, t in zip(*(c.to_pylist() for c in batch.columns)):
                value, weight = np.unique(shingles(t.split(), hashes, size), return_counts=True)
                # the n-th time of a shingle is an element of its own
                nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                own = mix(np.repeat(value, weight) + mix(nth))
                if held and (g != group or len(held) == BLOCK_DOCS or total + len(own) > BLOCK_ELEMENTS):
                    yield block()
                    held, total = [], 0
                group = g
                held.append((i, label, own))
                total += len(own)
        if held:
            yield block()

    dealt = rows.repartition("group", F.pmod(F.xxhash64("id"), F.lit(salt))).sortWithinPartitions("group", "id")
    kind = "group long, block string, ids array<long>, labels array<long>, sizes array<long>, elements binary"
    blocks = stored(map_batches(dealt.select("group", "id", "label", "text"), gather, kind), "dart-blocks")
    met = block_pairs(blocks).select("ids", "labels", "sizes", "elements", "ids2", "labels2", "sizes2", "elements2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].as_py() for c in range(8)]
                links = block_links(*block_of(*row[:4]), *block_of(*row[4:]), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in links], names=["a", "b"])

    return map_batches(met, compare, "a long, b long")


BLOCK_DOCS, BLOCK_ELEMENTS = 256, 250_000
MAX_STRIPES = 64


def block_pairs(blocks: DataFrame) -> DataFrame:
    """Every two blocks of a group, and each with itself, once; the second one's columns end in 2.

    A group of B blocks is cut into about sqrt(B) stripes; its pairs are made in the cells of the grid of stripes, so
    that one large group spreads over tasks while a block is copied once per stripe only.
    """
    sizes = blocks.groupBy("group").agg(F.count("*").alias("_n"))
    stripes = F.least(F.ceil(F.sqrt("_n")).cast("int"), F.lit(MAX_STRIPES)).alias("_stripes")
    small = stored(sizes.select("group", stripes), "dart-stripes")
    small = F.broadcast(small) if small.count() <= BROADCAST_IDS else small
    own = blocks.join(small, "group").withColumn("_own", F.pmod(F.xxhash64("block"), F.col("_stripes")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_stripes") - 1))
    left = own.withColumn("_column", every).withColumnRenamed("_own", "_row").drop("_stripes")
    right = own.withColumn("_row", every).withColumnRenamed("_own", "_column").drop("_stripes")
    cell = ["group", "_row", "_column"]
    right = right.select(*cell, *[F.col(c).alias(f"{c}2") for c in blocks.columns if c != "group"])
    return left.join(right, cell).filter("block <= block2").drop("_row", "_column")


def block_of(ids: list, labels: list, sizes: list, elements: bytes) -> tuple:
    owner = np.repeat(np.arange(len(ids)), sizes)
    return np.array(ids), np.array(labels), np.array(sizes), owner, np.frombuffer(elements, np.uint64)


def block_links(ids, labels, sizes, owner, elements, ids2, labels2, sizes2, owner2, elements2, threshold):
    """One pair (a < b) for every two classes that hold a similar pair across the two blocks."""
    shared = np.intersect1d(elements, elements2)
    both = np.zeros((len(ids), len(ids2)), np.float32)
    for start in range(0, len(shared), 4096):
        part = shared[start : start + 4096]
        sides = []
        for own, values, n in ((owner, elements, len(ids)), (owner2, elements2, len(ids2))):
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            side = np.zeros((n, len(part)), np.float32)
            side[own[hit], at[hit]] = 1
            sides.append(side)
        both += sides[0] @ sides[1].T
    similar = both / (sizes[:, None] + sizes2[None, :] - both) >= threshold - 1e-6
    x, y = np.nonzero(similar & (labels[:, None] != labels2[None, :]))
    # float32 counts are exact below 2^24; the ratio is checked again in doubles
    exact = both[x, y].astype(np.float64)
    x, y = (c[exact >= threshold * (sizes[x] + sizes2[y] - exact) - 1e-9] for c in (x, y))
    low, high = np.minimum(labels[x], labels2[y]), np.maximum(labels[x], labels2[y])
    _, first = np.unique(np.stack([low, high]), axis=1, return_index=True) if len(x) else (None, np.zeros(0, int))
    a, b = ids[x[first]], ids2[y[first]]
    return np.minimum(a, b), np.maximum(a, b)


def wanted_texts(ids: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text) of the given documents; the ids are broadcast if they were counted few."""
    ids = stored(ids, "pair-ids")
    small = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col(key).cast("long").alias("id"), text_column(text).alias("text"))
    return texts.join(F.broadcast(ids) if small else ids, "id", "left_semi")


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of near duplicates (that of the smallest id); rows without an id all stay.

    Of rows that repeat the remaining id, one stays, chosen by a hash of the row.
    """
    classes = near_duplicates(docs, key, text)
    keep, tie = free_name(docs, "keep"), free_name(docs, "tie")
    gone = stored(classes.filter(F.col(key) != F.col("class_id")).select(F.col(key).alias(keep)), "dart-removed")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    named = docs.filter(F.col(key).isNotNull()).join(gone, F.col(key) == F.col(keep), "left_anti")
    ids = docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(tie))
    first = ids.filter(F.col(tie) > 1).select(F.col(key).alias(keep)).join(gone, keep, "left_anti")
    repeated = stored(first, "dart-repeated")
    if repeated.isEmpty():
        out = named
    else:
        many = named.join(repeated, F.col(key) == F.col(keep), "left_semi")
        row = F.struct(F.xxhash64(*docs.columns).alias("h"), F.struct(*docs.columns).alias("row"))
        one = many.groupBy(F.col(key).alias(keep)).agg(F.min_by(row, F.xxhash64(*docs.columns)).alias(tie))
        out = named.join(repeated, F.col(key) == F.col(keep), "left_anti").unionByName(
            one.select(*[F.col(tie)["row"][c].alias(c) for c in docs.columns])
        )
    return out.unionByName(docs.filter(F.col(key).isNull()))
