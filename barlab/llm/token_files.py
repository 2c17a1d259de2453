"""Raw token-id shards with a minimal perfect hash index.

Documents are range-partitioned by key; each partition becomes one shard of two files in a shared folder:
`shard-N.ids`, the ids of its documents one after another (little-endian, 16 or 32 bits), and `shard-N.index`,
the keys in order plus a minimal perfect hash from key to (fingerprint, offset, count). A table of shards
(`manifest`) holds key ranges and totals, so a key is routed by two comparisons and then found in constant time.

The hash is a cascade of bit arrays: a key whose bit no other key of its level wants is placed there, the others
go to the next level; a key's slot is the number of set bits before its own. Level positions and fingerprints come
from one 64-bit mix of (key, occurrence).

Defined results: null and empty texts hold only the end id; null keys come first, before all others; repeated keys are
told apart by their occurrence number, which counts over all shards (`prior` is what earlier shards hold of a shard's
first key); a key that holds very many rows is spread over several shards; an empty table writes no shard. Files are
written under a temporary name and renamed. The shared folder must be of a scheme that pyarrow's file systems know.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.llm.chunks import BareEncoder, per_worker
from barlab.llm.common import each_batch, free_name, map_batches, scratch_uri, text_column, tokenizer_path

END_ID = 2
MAGIC = b"MPHIDX01"
SPARSITY = 2.0  # bits per key of a level
LEVELS = 48
NULL_KEY = -(1 << 63)
_HEADER = struct.Struct("<8sQII")


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def key_hash(keys: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return mix(mix(keys.astype(np.int64).view(np.uint64)) ^ occurrence.astype(np.uint64))


class PerfectHash(NamedTuple):
    """Level sizes, all levels' bits, and the number of set bits before each 512-bit block."""

    sizes: np.ndarray
    bits: np.ndarray
    ranks: np.ndarray

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1 if no level has its bit."""
        out = np.full(len(hashes), -1, np.int64)
        open_, start = np.arange(len(hashes)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = start + level_position(hashes[open_], level, size)
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            out[open_[hit]] = at[hit]
            open_ = open_[~hit]
            start += size
        found = np.flatnonzero(out >= 0)
        if len(found):
            at = out[found]
            block = at >> 9
            inside = np.zeros(len(found), np.int64)
            for byte in range(64):
                place = (block << 6) + byte
                before = np.clip(at - (place << 3), 0, 8)
                value = self.bits[np.minimum(place, len(self.bits) - 1)] & ((1 << before) - 1).astype(np.uint8)
                inside += _POPCOUNT[value]
            out[found] = self.ranks[block] + inside
        return out


_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.int64)


def level_position(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(hashes + np.uint64(level)) % np.uint64(size)).astype(np.int64)


def build_hash(hashes: np.ndarray) -> PerfectHash:
    """A minimal perfect hash over different 64-bit numbers."""
    if len(np.unique(hashes)) != len(hashes):
        raise ValueError("two keys of a shard have one 64-bit hash")
    sizes, parts, left = [], [], hashes
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("too many levels")
        size = max(64, -(-int(len(left) * SPARSITY) // 64) * 64)
        at = level_position(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        parts.append(np.packbits(alone, bitorder="little"))
        left = left[~alone[at]]
    bits = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    blocks = np.add.reduceat(_POPCOUNT[bits], np.arange(0, len(bits), 64)) if len(bits) else np.zeros(0, np.int64)
    ranks = np.concatenate([[0], np.cumsum(blocks)[:-1]]) if len(bits) else blocks
    return PerfectHash(np.array(sizes, np.int64), bits, ranks.astype(np.int64))


class Index(NamedTuple):
    keys: np.ndarray
    occurrences: np.ndarray
    perfect: PerfectHash
    fingerprints: np.ndarray
    offsets: np.ndarray
    counts: np.ndarray

    def find(self, keys: np.ndarray, occurrences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and count of each key; the offset is -1 where the stored fingerprint differs."""
        hashes = key_hash(keys, occurrences)
        slots = self.perfect.slots(hashes)
        if not len(self.offsets):
            return np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        safe = np.maximum(slots, 0)
        hit = (slots >= 0) & (self.fingerprints[safe] == (hashes >> np.uint64(32)).astype(np.uint32))
        return np.where(hit, self.offsets[safe], -1), np.where(hit, self.counts[safe], 0)


def occurrences_of(keys: np.ndarray) -> np.ndarray:
    """For sorted keys: how often each was seen before."""
    at = np.arange(len(keys))
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    return at - np.maximum.accumulate(np.where(new, at, 0)) if len(keys) else at


def index_bytes(keys: np.ndarray, counts: np.ndarray) -> bytes:
    occurrences = occurrences_of(keys)
    hashes = key_hash(keys, occurrences)
    perfect = build_hash(hashes)
    slots = perfect.slots(hashes)
    offsets = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    fingerprints, places, sizes = (np.zeros(len(keys), t) for t in ("<u4", "<i8", "<i8"))
    fingerprints[slots] = (hashes >> np.uint64(32)).astype(np.uint32)
    places[slots], sizes[slots] = offsets, counts
    parts = [_HEADER.pack(MAGIC, len(keys), len(perfect.sizes), len(perfect.bits)), keys.astype("<i8").tobytes()]
    parts += [perfect.sizes.astype("<i8").tobytes(), perfect.ranks.astype("<i8").tobytes()]
    parts += [fingerprints.tobytes(), places.tobytes(), sizes.tobytes(), perfect.bits.tobytes()]
    return b"".join(parts)


def read_index(raw: bytes) -> Index:
    magic, n, levels, n_bits = _HEADER.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not an index file")
    at = _HEADER.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    keys = take("<i8", n)
    sizes, ranks = take("<i8", levels), take("<i8", -(-n_bits // 64))
    fingerprints, offsets, counts = take("<u4", n), take("<i8", n), take("<i8", n)
    perfect = PerfectHash(sizes, take("u1", n_bits), ranks)
    return Index(keys, occurrences_of(keys), perfect, fingerprints, offsets, counts)


_SHARD = ["shard", "width", "first_key", "last_key", "n_null", "n_docs", "n_tokens", "at_last"]


def write_shards(
    docs: DataFrame,
    folder: str,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = END_ID,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Write all documents below `folder` in ascending key order; the manifest is returned and stored there.

    Manifest: shard, width (bytes of an id), first_key, last_key (null keys as the least integer), n_null (null keys),
    n_docs, n_tokens, start (ids in earlier shards), prior (rows of first_key in earlier shards).
    """
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(BareEncoder, path)
        width = encoder.dtype.itemsize
        end = np.array([end_id], encoder.dtype)
        shard = TaskContext.get().partitionId()
        keys, counts, nulls = [], [], 0
        out = None
        for batch in each_batch(batches, 2048):
            if out is None:
                out = ShardFile(folder, f"shard-{shard}.ids")
            ids = encoder.ids(batch.column(1))
            nulls += batch.column(0).null_count
            keys.append(batch.column(0).fill_null(NULL_KEY).to_numpy())
            counts.append(np.diff(ids.ends, prepend=0) + 1)
            out.write(np.insert(ids.flat, ids.ends, end).tobytes())
        if out is None:
            return
        out.close()
        all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
        index = ShardFile(folder, f"shard-{shard}.index")
        index.write(index_bytes(all_keys, all_counts))
        index.close()
        at_last = (all_keys == all_keys[-1]).sum()
        row = [shard, width, all_keys[0], all_keys[-1], nulls, len(all_keys), all_counts.sum(), at_last]
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in row], names=_SHARD)

    tie = free_name(docs, "row")
    ordered = (
        docs.select(F.col(key).cast("long").alias("key"), text_column(text).alias("text"))
        .withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange("key", tie)
        .sortWithinPartitions("key", tie)
        .drop(tie)
    )
    made = map_batches(ordered, run, ", ".join(f"{c} long" for c in _SHARD))
    spark = docs.sparkSession
    made.write.parquet(f"{folder}/shards")
    # one row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = spark.read.parquet(f"{folder}/shards")
    # shards that end with a key: all but the first of them hold nothing else
    ending = shards.groupBy(F.col("last_key").alias("first_key")).agg(
        F.collect_list(F.struct("shard", "at_last")).alias("_by_shard")
    )
    held = F.filter("_by_shard", lambda x: x["shard"] < F.col("shard"))
    prior = F.aggregate(held, F.lit(0).cast("long"), lambda a, x: a + x["at_last"])
    manifest = (
        shards.join(ending, "first_key", "left")
        .withColumn("prior", F.coalesce(prior, F.lit(0)))
        .withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
        .select("shard", "width", "first_key", "last_key", "n_null", "n_docs", "n_tokens", "start", "prior")
    )
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


class ShardFile:
    """A file in the shared folder that appears under its name only when complete."""

    def __init__(self, folder: str, name: str):
        self.system, root = fs.FileSystem.from_uri(folder)
        self.system.create_dir(root, recursive=True)
        self.name, self.temporary = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.temporary)

    def write(self, raw: bytes) -> None:
        self.stream.write(raw)

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.temporary, self.name)


class ShardReader:
    """Keyed access to one shard: the index in memory, ids read from their place in the payload file."""

    def __init__(self, folder: str, shard: int, width: int):
        self.system, root = fs.FileSystem.from_uri(folder)
        with self.system.open_input_file(f"{root}/shard-{shard}.index") as f:
            self.index = read_index(f.readall())
        self.payload = self.system.open_input_file(f"{root}/shard-{shard}.ids")
        self.width = width

    def ids_at(self, offset: int, count: int) -> np.ndarray:
        self.payload.seek(int(offset) * self.width)
        return np.frombuffer(self.payload.read(int(count) * self.width), f"<u{self.width}")

    def ids(self, key: int | None, occurrence: int = 0) -> np.ndarray | None:
        """The ids of a key, or None if the shard doesn't hold it."""
        at = np.array([NULL_KEY if key is None else key], np.int64)
        offset, count = self.index.find(at, np.array([occurrence]))
        return None if offset[0] < 0 else self.ids_at(offset[0], count[0])

    def all_of(self, key: int | None, nulls: int, prior: int) -> Iterator[tuple[int, np.ndarray]]:
        """(occurrence over all shards, ids) of a key's documents here; `nulls` rows of the shard have no key."""
        start = nulls if key == NULL_KEY else 0
        before = prior if len(self.index.keys) and self.index.keys[0] == (NULL_KEY if key is None else key) else 0
        number = start
        while key is not None or number < nulls:
            ids = self.ids(key, number)
            if ids is None:
                return
            yield before + number - start, ids
            number += 1


def read_all(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """Every document of the shards by keyed access: key, start, n_tokens, ids (little-endian 32-bit)."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("shard", "width", "start", "n_null")
    schema = f"`{key}` long, start long, n_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, width, start, nulls in zip(*(c.to_pylist() for c in batch.columns)):
                reader = ShardReader(folder, shard, width)
                index = reader.index
                offsets, counts = index.find(index.keys, index.occurrences)
                for at in range(0, len(offsets), 256):
                    part = slice(at, at + 256)
                    ids = [
                        reader.ids_at(o, c).astype("<u4").tobytes()
                        for o, c in zip(offsets[part].tolist(), counts[part].tolist())
                    ]
                    keys = index.keys[part]
                    unnamed = np.arange(at, at + len(keys)) < nulls
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys, pa.int64(), mask=unnamed),
                            pa.array(offsets[part] + start),
                            pa.array(counts[part]),
                            pa.array(ids, pa.binary()),
                        ],
                        names=[key, "start", "n_tokens", "ids"],
                    )

    # one shard per task
    spread = manifest.repartitionByRange(max(1, manifest.count()), "shard")
    return map_batches(spread, run, schema)


def lookup(keys: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, occurrence, ids) of every document that has one of the keys; ids are little-endian 32-bit.

    The manifest routes: a key goes to the shards whose range holds it, and each shard met is opened by one task, which
    asks its index. Keys that no shard holds give no row; a null key asks for the documents without key; a key asked
    for several times is answered once. Only the manifest, one row per shard, is read by the driver.
    """
    spark = keys.sparkSession
    shards = sorted(spark.read.parquet(f"{folder}/manifest").collect(), key=lambda r: r["shard"])
    first, last = (np.array([r[c] for r in shards], np.int64) for c in ("first_key", "last_key"))
    asked = keys.select(F.col(key).cast("long").alias("key")).distinct()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).fill_null(NULL_KEY).to_numpy()
            low, high = np.searchsorted(last, own, "left"), np.searchsorted(first, own, "right")
            spread = np.maximum(high - low, 0)
            row = np.repeat(np.arange(len(own)), spread)
            shard = np.arange(len(row)) - np.repeat(np.cumsum(spread) - spread, spread) + low[row]
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0).take(pa.array(row))], names=["at", "key"])

    routed = map_batches(asked, route, "at long, key long").repartition("at").sortWithinPartitions("at")
    facts = [(r["shard"], r["width"], r["n_null"], r["prior"]) for r in shards]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reader = -1, None
        for batch in each_batch(batches):
            rows = []
            for place, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard, width, nulls, prior = facts[place]
                if place != at:
                    at, reader = place, ShardReader(folder, shard, width)
                rows += [(own, n, ids.astype("<u4").tobytes()) for n, ids in reader.all_of(own, nulls, prior)]
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))],
                names=[key, "occurrence", "ids"],
            )

    return map_batches(routed, find, f"`{key}` long, occurrence long, ids binary")


def shard_digest(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Write the documents' ids, read them back and give each document's place and checksum."""
    spark = docs.sparkSession
    folder = scratch_uri(spark, "token-files")
    write_shards(docs, folder, tokenizer)
    return read_all(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
