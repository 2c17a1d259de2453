"""Byte-level BPE by a queue of merge ranks over a doubly linked list of symbols, and its inverse.

The symbols of a pre-token stand in a linked list; all adjacent pairs that merge are queued by (rank, position). The
best pair is merged, its neighbours' new pairs are queued, and queue entries whose pair is gone are skipped. Work is
n log n in a pre-token's length. Decoding joins the byte strings of the vocabulary.

Ids equal those of the tokenizers library for a byte-level BPE file. Defined results: null and empty texts have no
ids and decode to the empty text; strings of special tokens get their ids; bytes that are no UTF-8 decode to the
replacement character; repeated rows give equal results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from barlab.llm.chunks import BYTE_PATTERN, Ids, SpacedEncoder, per_worker, token_bytes
from barlab.llm.common import each_batch, map_batches, text_column, tokenizer_path

PRETOKENS, PIECES = 150_000, 300_000  # entries of the two caches of a worker


class MergeQueue:
    """Merges symbol ids by rank. `merges` lists (left id, right id, merged id) in order of rank."""

    def __init__(self, merges: Sequence[tuple[int, int, int]], base: int):
        self.base = base
        self.rank = {a * base + b: r for r, (a, b, _) in enumerate(merges)}
        self.merged = [m for _, _, m in merges]

    def merge(self, symbols: list[int]) -> list[int]:
        n, base, rank_of = len(symbols), self.base, self.rank.get
        queue = []
        for i in range(n - 1):
            r = rank_of(symbols[i] * base + symbols[i + 1])
            if r is not None:
                queue.append(r * n + i)
        if not queue:
            return symbols
        heapq.heapify(queue)
        symbols = symbols[:]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            r, i = divmod(pop(queue), n)
            left, j = symbols[i], after[i]
            if left < 0 or j >= n or rank_of(left * base + symbols[j]) != r:
                continue
            new = self.merged[r]
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                s = rank_of(new * base + symbols[k])
                if s is not None:
                    push(queue, s * n + i)
            h = before[i]
            if h >= 0:
                s = rank_of(symbols[h] * base + new)
                if s is not None:
                    push(queue, s * n + h)
        return [s for s in symbols if s >= 0]


class QueueBpe:
    """The vocabulary file as merge queue, pre-tokenizer and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, before = data["model"], data["pre_tokenizer"]
        if model["type"] != "BPE" or data["normalizer"] is not None or before["type"] != "ByteLevel" or before["add_prefix_space"]:
            raise ValueError("not a byte-level BPE file")
        vocabulary = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocabulary.values(), *self.specials.values()]) + 1
        self.queue = MergeQueue([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs], size)
        self.bytes_of: list[bytes] = [b""] * size
        strings = token_bytes(vocabulary)
        for token, i in strings.items():
            self.bytes_of[i] = token
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.symbol = [strings[bytes([b])] for b in range(256)]
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.words = regex.compile(BYTE_PATTERN).findall
        marks = sorted(map(regex.escape, self.specials), key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(marks) + ")") if marks else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.texts = SpacedEncoder(self.encode, self.dtype, list(self.specials), PIECES)

    def word(self, word: str) -> tuple[int, ...]:
        ids = self.known.get(word)
        if ids is None:
            symbol = self.symbol
            ids = tuple(self.queue.merge([symbol[b] for b in word.encode()]))
            if len(word) <= 64:
                if len(self.known) >= PRETOKENS:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def encode(self, pieces: Sequence[str]) -> list[bytes]:
        out, dtype = [], self.dtype
        for piece in pieces:
            ids: list[int] = []
            parts = [piece] if self.cut is None else self.cut.split(piece)
            for i, part in enumerate(parts):
                if i % 2:
                    ids.append(self.specials[part])
                else:
                    for word in self.words(part):
                        ids.extend(self.word(word))
            out.append(np.array(ids, dtype).tobytes())
        return out

    def ids(self, texts: pa.Array) -> Ids:
        return self.texts.ids(texts)

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encode_texts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids): ids as little-endian unsigned 32-bit integers."""
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches, 2048):
            ids = per_worker(QueueBpe, path).ids(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(ids.ends, prepend=0).astype(np.int64)),
                    pa.array([x.astype("<u4").tobytes() for x in ids.slices()], pa.binary()),
                ],
                names=[key, "n_tokens", "ids"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text_column(text).alias("text")), run, f"`{key}` {kind}, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, tokenizer: str = "byte_bpe_50k.json", ids: str = "ids", name: str = "decoded") -> DataFrame:
    """The table with the text of each row's ids (null: empty)."""
    path = tokenizer_path(tokenizer)
    place = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches, 2048):
            decode = per_worker(QueueBpe, path).decode
            texts = [decode(np.frombuffer(raw or b"", "<u4").tolist()) for raw in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name]
            )

    return map_batches(encoded, run, StructType([*encoded.schema.fields, StructField(name, StringType())]))


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, decoded): encoded and decoded again in one pass, with one vocabulary per worker."""
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = per_worker(QueueBpe, path)
        for batch in each_batch(batches):
            own = bpe.ids(batch.column(1)).slices()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in own], pa.int64()),
                    pa.array([x.astype("<u4").tobytes() for x in own], pa.binary()),
                    pa.array([bpe.decode(x.tolist()) for x in own], pa.string()),
                ],
                names=[key, "n_tokens", "ids", "decoded"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids binary, decoded string"
    return map_batches(docs.select(key, text_column(text).alias("text")), run, schema)


def round_trip_digest(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Digests of each document's ids and of the text that they decode to."""
    return round_trip(docs, tokenizer).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
