"""Token operators against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from barlab.llm import chunks, merge_queue, packing, piece_counts, token_files
from barlab.llm.common import tokenizer_path

pytest.importorskip("public_tokenizers")
BYTE, WORD, PIECE = (tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))

ODD = ["", " ", "\n", "a  b", "a   b", "a \n b", "a\n\n\nb", " a", "a ", "\na", "a \tb", "a  ", "<|endoftext|>"]
ODD += ["x <|endoftext|> y", "f\n\n<|endoftext|>", "it's 's", "\x1c x", "\x01a \x01b", "x y　z", "ë ̈x"]
ODD += ["Σ Σς", "İ x", "▁x y▁ z", "<s> <0x0A> <unk>", "\U0001f600 é 中文字", "x\ny  \n"]


@pytest.fixture(scope="module")
def texts():
    random.seed(2)
    bits = [*"ab1 '\n\ts .é̈\x01▁中", "<|endoftext|>", " ", "\n", "the ", "Word"]
    return ODD + ["".join(random.choice(bits) for _ in range(random.randint(0, 14))) for _ in range(3000)]


def spaced(path):
    t = chunks.load_tokenizer(path)
    dtype = chunks.id_type(t)
    return chunks.SpacedEncoder(chunks.library_encoder(t, dtype), dtype, chunks.special_strings(t))


@pytest.mark.parametrize(
    "make, path",
    [(spaced, BYTE), (chunks.ByteEncoder, BYTE), (chunks.BareEncoder, WORD), (merge_queue.QueueBpe, BYTE)],
)
def test_cut_texts_have_the_ids_of_whole_texts(texts, make, path):
    want = chunks.load_tokenizer(path).encode_batch(texts, add_special_tokens=False)
    got = make(path).ids(pa.array(texts)).slices()
    assert [g.tolist() for g in got] == [w.ids for w in want]


@pytest.mark.parametrize("run", [" " * 2_000_000, "\t" * 2_000_000, "\n" * 2_000_000, "\u3000 " * 60_000])
def test_very_long_runs_of_blanks_have_the_ids_of_the_merge_queue(run):
    coder, queue = chunks.ByteEncoder(BYTE), merge_queue.QueueBpe(BYTE)
    texts = [run, "a" + run, run + "b c", "x 1" + run + "y" + run + "\nz ", run[:-1] + "<|endoftext|>" + run]
    for text in texts:
        want = np.frombuffer(queue.encode([text])[0], queue.dtype)
        assert np.array_equal(coder.ids(pa.array([text])).flat, want)


def test_long_blanks_at_the_limit_have_the_ids_of_the_library(monkeypatch):
    monkeypatch.setattr(chunks, "LONG_RUN", 5)
    monkeypatch.setattr(chunks, "_LONG_BLANKS", chunks.re.compile(f"[{chunks._BLANK}]{{5,}}"))
    coder, library = chunks.ByteEncoder(BYTE), chunks.load_tokenizer(BYTE)
    random.seed(3)
    for _ in range(800):
        text = "".join(random.choice(["a", "'s", "7", "!", " " * 6, "\n" * 5, "\t", " ", "\x1c" * 6, "\u2003" * 5, "<|endoftext|>"]) for _ in range(9))
        assert coder.ids(pa.array([text])).flat.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_pretokens_have_the_ids_of_the_library():
    assert chunks.PretokenEncoder.fits(WORD) and not chunks.PretokenEncoder.fits(BYTE)
    encoder, library = chunks.BareEncoder(WORD), chunks.load_tokenizer(WORD)
    random.seed(5)
    letters = [chr(c) for c in range(1, 0x180)] + ["'s", "'LL", "\u0301", "\u030c", "J", "\u0130", "\u212b", "<|STARTOFTEXT|>", "<|startoftext|>"]
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 12))) for _ in range(4000)]
    texts += [a + c + b for c in letters for a, b in (("a", "B"), ("1", "2"), (".", "!"))]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.ids(pa.array(texts)).slices()] == want
    small = chunks.PretokenEncoder(library, encoder.dtype, chunks.library_encoder(library, encoder.dtype), entries=3)
    assert small(["The", "cat,", "THE", "cat", "d'or"]) == encoder.cache.of(["The", "cat,", "THE", "cat", "d'or"])


def test_cache_stays_bounded():
    cache = chunks.PieceCache(lambda pieces: [p.encode() for p in pieces], entries=10)
    for i in range(50):
        assert cache.of([f"{i}", f"{i + 1}"]) == [f"{i}".encode(), f"{i + 1}".encode()]
        assert len(cache.known) <= 10


def test_merge_queue_handles_long_pretokens_and_decodes_like_the_library():
    bpe, library = merge_queue.QueueBpe(BYTE), chunks.load_tokenizer(BYTE)
    long = "ab" * 20000 + "é" * 5000
    assert np.frombuffer(bpe.encode([long])[0], bpe.dtype).tolist() == library.encode(long, add_special_tokens=False).ids
    random.seed(4)
    for _ in range(500):
        ids = [random.randrange(50257) for _ in range(random.randint(0, 8))]
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_round_trip_query(docs):
    rows = [(1, None), (2, "a <|endoftext|> é\n\n b"), (2, "a"), (None, "x")]
    got = sorted(map(tuple, merge_queue.round_trip_digest(docs(rows)).collect()), key=str)
    library = chunks.load_tokenizer(BYTE)
    want = []
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    apart = merge_queue.decode_ids(merge_queue.encode_texts(docs(rows))).collect()
    assert sorted((r.n_tokens, r.decoded) for r in apart) == sorted((w[1], t or "") for w, (_, t) in zip(want, rows))
    assert merge_queue.round_trip_digest(docs([])).count() == 0


def test_piece_counts_equal_the_unigram_library(docs, texts):
    import sentencepiece
    from tokenizers import Tokenizer, models

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    vocabulary = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    _, counts = piece_counts.PieceCounter(PIECE).counts(pa.array(texts))
    assert counts.tolist() == [len(library.encode("▁" + t.replace(" ", "▁")).ids) if t else 0 for t in texts]
    rows = {r.doc_id: (r.n_tokens, r.score) for r in piece_counts.token_counts(docs([None, "", "hello world"])).collect()}
    assert rows[0] == rows[1] == (0, 0.0) and rows[2][0] == counts_of(library, "hello world")
    assert piece_counts.token_counts(docs([])).count() == 0


def counts_of(library, text):
    return len(library.encode("▁" + text.replace(" ", "▁")).ids)


def test_viterbi_ties_and_unknowns_follow_the_library():
    from tokenizers import Tokenizer, models

    vocabulary = [("<unk>", 0.0), ("a", -2.0), ("b", -1.0), ("ab", -3.0), ("aba", -4.0), ("ba", -3.0), ("abab", -6.0)]
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    mine = piece_counts.CountingViterbi(vocabulary, 0)
    random.seed(8)
    for _ in range(2000):
        t = "".join(random.choice("abcx") for _ in range(random.randint(1, 12)))
        assert mine.best(t)[1] == len(library.encode(t).ids), t


def test_perfect_hash_is_minimal_and_fingerprints_refuse_strangers():
    for n in (0, 1, 2, 1000, 20000):
        keys = np.arange(n) * 7 - 3
        index = token_files.read_index(token_files.index_bytes(keys, np.full(n, 2)))
        assert sorted(index.perfect.slots(token_files.key_hash(keys, keys * 0)).tolist()) == list(range(n))
        offset, count = index.find(keys, keys * 0)
        assert offset.tolist() == list(range(0, 2 * n, 2)) and set(count.tolist()) <= {2}
        strange = np.arange(5000) + 10**9
        assert (index.find(strange, strange * 0)[0] >= 0).sum() <= 1


def test_token_files_round_trip(docs, tmp_path, spark):
    rows = [(5, "b"), (3, None), (5, "a b"), (None, "Null key"), (9, "<|endoftext|> x"), (-4, "word " * 3000)]
    d = docs(rows)
    got = sorted(map(tuple, token_files.shard_digest(d).collect()), key=lambda r: r[1])
    library = chunks.load_tokenizer(WORD)
    at = 0
    want_sizes = {}
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want_sizes.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r[0] for r in got] == [None, -4, 3, 5, 5, 9]
    for i, start, n, crc in got:
        assert start == at and (n, crc) in want_sizes[i]
        at += n
    folder = f"file://{tmp_path}/shards"
    manifest = token_files.write_shards(d, folder).collect()
    for m in manifest:
        reader = token_files.ShardReader(folder, m.shard, m.width)
        if m.first_key <= 9 <= m.last_key:
            assert reader.ids(9).tolist() == library.encode("<|endoftext|> x", add_special_tokens=False).ids + [2]
        assert reader.ids(12345) is None and reader.ids(5, 7) is None
    assert token_files.shard_digest(docs([])).count() == 0


def test_lookup_routes_keys_over_shards(docs, tmp_path, spark):
    random.seed(9)
    least = -(1 << 63)
    rows = [(random.randrange(-50, 50), f"w{i} " + "x " * random.randint(0, 9)) for i in range(400)]
    rows += [(7, f"hot {i}") for i in range(600)] + [(None, "no key"), (None, None), (least, "least"), (least, "least two")]
    library = chunks.load_tokenizer(WORD)
    want = {}
    for k, t in rows:
        want.setdefault(k, []).append(tuple(library.encode(t or "", add_special_tokens=False).ids + [2]))
    folder = f"file://{tmp_path}/routed"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    manifest = token_files.write_shards(docs(rows).repartition(5), folder).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(m.first_key <= 7 <= m.last_key for m in manifest) > 1 and sum(m.n_null for m in manifest) == 2
    asked = spark.createDataFrame([(k,) for k in [*want, 1000, -1000, 7, None]], "doc_id long")
    got = {}
    for r in token_files.lookup(asked, folder).collect():
        got.setdefault(r.doc_id, {})[r.occurrence] = tuple(np.frombuffer(r.ids, "<u4").tolist())
    assert set(got) == set(want)
    for k, own in got.items():
        assert sorted(own) == list(range(len(own))) and sorted(own.values()) == sorted(want[k])
    back = [r.doc_id for r in token_files.read_all(spark, folder).collect()]
    assert sorted(map(str, back)) == sorted(str(k) for k, _ in rows)
    token_files.write_shards(docs([]), f"file://{tmp_path}/none")
    assert token_files.lookup(asked, f"file://{tmp_path}/none").count() == 0


def check_packing(rows, pieces):
    library = chunks.load_tokenizer(BYTE)
    want = sorted(library.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows)
    assert sum(r.length for r in pieces) == sum(map(len, want))
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and 0 < r.length <= 2048
            at += r.length
        assert at <= 2048
        padding += 2048 - at if at & (at - 1) else 0
    return padding, len(by_sequence), want


def test_packing_places_every_id_once(docs):
    random.seed(6)
    texts = [None, "", "word " * 9000] + [f"{i} " + "some words " * random.randint(0, 900) for i in range(60)]
    rows = list(enumerate(texts))
    pieces = packing.pack(docs(texts)).collect()
    padding, n, want = check_packing(rows, pieces)
    assert n <= sum(map(len, want)) / 2048 * 1.02 + 1
    own = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(own.setdefault(r.doc_id, []))
        own[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
        assert r.doc_tokens >= len(own[r.doc_id])
    assert sorted(own.values()) == want
    assert packing.pieces_digest(docs([])).count() == 0


def test_packing_of_repeated_rows_and_without_broadcast(docs, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_OFFSETS", 0)
    monkeypatch.setattr(packing, "SPLIT_GROUP", 2)
    rows = [(7, "same text")] * 30 + [(None, "other")] * 3
    padding, n, _ = check_packing(rows, packing.pack(docs(rows)).collect())
    assert n == 1
    random.seed(2)
    rows = [(i, "some words " * random.randint(0, 1500)) for i in range(80)]
    packed = packing.pack(docs(rows).repartition(7))
    check_packing(rows, packed.collect())
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_plan_uses_every_row_once():
    random.seed(1)
    for histogram in ({}, {5: 1}, {1000: 3, 1048: 2, 2047: 1}, {n: random.randint(0, 40) for n in range(1, 2048)}):
        plan = packing.plan_tails(histogram)
        used = {}
        for length, low, high in zip(plan.length.tolist(), plan.low.tolist(), plan.high.tolist()):
            assert low == used.get(length, 0)
            used[length] = high
        assert used == {n: c for n, c in histogram.items() if c}


def test_nnls_solves_small_systems():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, x = rng.random((12, 6)), np.maximum(rng.normal(size=6), 0)
        assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-4)
