"""Token ids of whole texts.

Words repeat, so a text is cut where no pre-tokenizer rule and no merge can reach across, each different piece is
encoded once, and ids are put together with array operations. A cache per Python worker keeps pieces between
batches and tasks; it is emptied when full, so its memory is bounded. Texts with blanks that such cuts can't follow
are encoded as a whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_ENTRIES = 600_000
LONG_PIECE = 200  # longer pieces are encoded but not kept

# Fixed pattern of the byte-level pre-tokenizer.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Encode = Callable[[Sequence[str]], list[bytes]]
_WORKER: dict[tuple, object] = {}


def per_worker(make: Callable[..., object], *args):
    """The object that `make(*args)` gives, made once per Python worker."""
    key = (make.__module__, make.__qualname__, *args)
    if key not in _WORKER:
        _WORKER[key] = make(*args)
    return _WORKER[key]


class Ids(NamedTuple):
    """Ids of many texts: text i has flat[ends[i-1]:ends[i]]."""

    flat: np.ndarray
    ends: np.ndarray

    def slices(self) -> list[np.ndarray]:
        return np.split(self.flat, self.ends[:-1]) if len(self.ends) else []


class PieceCache:
    """Maps pieces to the bytes of their ids; `encode` gets many new pieces at once."""

    def __init__(self, encode: Encode, entries: int = CACHE_ENTRIES):
        self.encode, self.entries, self.known = encode, entries, {}

    def of(self, pieces: list[str]) -> list[bytes]:
        known = self.known
        out = list(map(known.get, pieces))
        missing = [i for i, v in enumerate(out) if v is None]
        if missing:
            new = [pieces[i] for i in missing]
            if len(known) + len(new) > self.entries:
                self.known = known = {}
            for i, p, v in zip(missing, new, self.encode(new)):
                out[i] = v
                if len(p) <= LONG_PIECE:
                    known[p] = v
        return out


def gathered(pieces: pa.ListArray, cache: PieceCache, dtype: np.dtype) -> Ids:
    """Ids of texts given as lists of pieces."""
    coded = pieces.flatten().dictionary_encode()
    unique = cache.of(coded.dictionary.to_pylist())
    ids = np.frombuffer(b"".join(unique), dtype)
    sizes = np.fromiter(map(len, unique), np.int64, len(unique)) // dtype.itemsize
    starts = np.cumsum(sizes) - sizes
    index = coded.indices.to_numpy()
    own = sizes[index]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    small = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
    places = np.arange(total, dtype=small) + np.repeat((starts[index] - (ends - own)).astype(small), own)
    per_text = np.concatenate([[0], ends])[pieces.offsets.to_numpy()[1:] - pieces.offsets.to_numpy()[0]]
    return Ids(ids[places], per_text)


def load_tokenizer(path: str):
    """The library's tokenizer without truncation and padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def id_type(tokenizer) -> np.dtype:
    return np.dtype("<u2") if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")


def special_strings(tokenizer) -> list[str]:
    return sorted(t.content for t in tokenizer.get_added_tokens_decoder().values() if t.special)


def library_encoder(tokenizer, dtype: np.dtype) -> Encode:
    """Encode pieces with the library, many in one call.

    The library cuts a text at its special strings before anything else, so pieces joined by one of them
    keep their own ids. Pieces that hold its first character are encoded alone.
    """
    marks = [m for m in special_strings(tokenizer) if m and m[0] not in m[1:]]
    size = dtype.itemsize

    def alone(pieces: Sequence[str]) -> list[bytes]:
        return [
            np.array(e.ids, dtype).tobytes()
            for e in tokenizer.encode_batch_fast(list(pieces), add_special_tokens=False)
        ]

    def together(pieces: list[str]) -> list[bytes]:
        joined = tokenizer.encode_batch_fast([marks[0].join(pieces)], add_special_tokens=False)[0].ids
        ids = np.array(joined, dtype)
        cuts = np.flatnonzero(ids == tokenizer.token_to_id(marks[0])) * size
        flat = ids.tobytes()
        starts, ends = [0, *(cuts + size).tolist()], [*cuts.tolist(), len(flat)]
        return [flat[i:j] for i, j in zip(starts, ends)]

    def encode(pieces: Sequence[str]) -> list[bytes]:
        if not marks:
            return alone(pieces)
        odd = [p for p in pieces if marks[0][0] in p]
        plain = [p for p in pieces if marks[0][0] not in p]
        made = dict(zip(odd, alone(odd))) if odd else {}
        for start in range(0, len(plain), 2048):
            part = plain[start : start + 2048]
            made.update(zip(part, together(part)))
        return [made[p] for p in pieces]

    return encode


# The pattern and normalizers of the word-level pre-tokenizer that `PretokenEncoder` knows.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_END = "</w>"
# Pieces of these characters only are their own normal form but for case, and cut like the pattern by _PRETOKEN.
_PLAIN = re.compile(r"[!-&(-;=-~\xa1-\xff]+")  # no blank, control character, apostrophe or <
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_SMALL = frozenset("abcdefghijklmnopqrstuvwxyz")
_PRETOKEN = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")


class PretokenEncoder:
    """Pieces by their pre-tokens, which repeat far more often than pieces with capitals and punctuation do.

    New pre-tokens are encoded many at once; the last id of each ends a word, which tells them apart. Words of a-z go
    to the tiktoken library, which is several times as fast: there a capital stands for a last letter with its word
    end, so that each symbol is one byte. The others are joined by blanks for the tokenizers library. Pieces with
    other characters go to `rest`.
    """

    def __init__(self, tokenizer, dtype: np.dtype, rest: Encode, entries: int = 400_000):
        self.tokenizer, self.dtype, self.rest, self.entries = tokenizer, dtype, rest, entries
        self.ends = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
        ranks = {}
        for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith(WORD_END)
            own = token.removesuffix(WORD_END)
            if own and set(own) <= _SMALL:
                ranks[(own[:-1] + own[-1].upper() if self.ends[i] else own).encode()] = i
        self.letters = self._coder(ranks) if self._in_merge_order() else None
        self.known: dict[str, bytes] = {}

    def _in_merge_order(self) -> bool:
        """Whether ids rise with the merges that make them, so that the least id is the first merge."""
        model = json.loads(self.tokenizer.to_str())["model"]
        made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        singles = [model["vocab"][c + e] for c in _SMALL for e in ("", WORD_END)]
        return all(a < b for a, b in zip(made, made[1:])) and max(singles) < made[0]

    @staticmethod
    def _coder(ranks: dict[bytes, int]):
        import tiktoken

        # the library wants a rank for every byte; none of the others is ever met
        spare = iter(range(max(ranks.values()) + 1, max(ranks.values()) + 257))
        whole = {**{bytes([b]): next(spare) for b in range(256) if bytes([b]) not in ranks}, **ranks}
        return tiktoken.Encoding("words", pat_str="[a-z]*[A-Z]", mergeable_ranks=whole, special_tokens={})

    @staticmethod
    def fits(path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        steps = (data["normalizer"] or {}).get("normalizers", [])
        cuts = (data["pre_tokenizer"] or {}).get("pretokenizers", [])
        return (
            data["model"]["type"] == "BPE" and data["model"]["end_of_word_suffix"] == WORD_END
            and [n["type"] for n in steps] == WORD_NORMALIZERS
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"] == {"Regex": WORD_PATTERN} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
            and all("<" in t["content"] for t in data["added_tokens"])
        )

    def __call__(self, pieces: Sequence[str]) -> list[bytes]:
        plain, cut = _PLAIN.fullmatch, _PRETOKEN.findall
        parts = [cut(p.lower()) if plain(p) else None for p in pieces]
        odd = [p for p, c in zip(pieces, parts) if c is None]
        others = iter(self.rest(odd)) if odd else iter(())
        known = self.known
        new = list(dict.fromkeys(w for c in parts if c for w in c if w not in known))
        if len(known) + len(new) > self.entries:
            self.known = known = {}
            new = list(dict.fromkeys(w for c in parts if c for w in c))
        ascii_, others_ = [], []
        for w in new:
            (ascii_ if self.letters and w.isascii() and w.isalpha() else others_).append(w)
        for words, encode in ((ascii_, self._small), (others_, self._joined)):
            for start in range(0, len(words), 4096):
                known.update(zip(words[start : start + 4096], self._by_word(words[start : start + 4096], encode)))
        return [next(others) if c is None else b"".join([known[w] for w in c]) for c in parts]

    def _small(self, words: list[str]) -> np.ndarray:
        return self.letters.encode_to_numpy("".join([w[:-1] + w[-1].upper() for w in words]))

    def _joined(self, words: list[str]) -> np.ndarray:
        return self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids

    def _by_word(self, words: list[str], encode: Callable) -> list[bytes]:
        ids = np.asarray(encode(words)).astype(self.dtype)
        stops = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
        if len(stops) != len(words):
            raise ValueError("pre-tokens and word ends differ")
        flat, stops = ids.tobytes(), stops.tolist()
        return [flat[i:j] for i, j in zip([0, *stops[:-1]], stops)]


class BareEncoder:
    """For pre-tokenizers that drop blanks: spaces and line breaks separate, the rest goes to the library."""

    def __init__(self, path: str):
        tokenizer = load_tokenizer(path)
        self.dtype = id_type(tokenizer)
        encode = library_encoder(tokenizer, self.dtype)
        if PretokenEncoder.fits(path):
            encode = PretokenEncoder(tokenizer, self.dtype, encode)
        self.cache = PieceCache(encode, CACHE_ENTRIES * 2 // 3)

    def ids(self, texts: pa.Array) -> Ids:
        return gathered(pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "), self.cache, self.dtype)


class SpacedEncoder:
    """For byte-level pre-tokenizers that keep a blank with the following word; `encode` does the pieces.

    A cut before a space or line break is safe unless a blank lies before it and a blank, the end or a special
    string behind it (it is then inside one run of blanks). The first piece of a text is marked, the others stand
    for themselves if they start with a line break and for a space and themselves if not.
    """

    MARK = "\x01"

    def __init__(
        self, encode: Encode, dtype: np.dtype, specials: Sequence[str] = (), entries: int = CACHE_ENTRIES
    ):
        ends = "|".join([r"\s", r"\Z", *map(re.escape, specials)])
        self.whole = re.compile(rf"\s[ \n](?:{ends})|{self.MARK}")
        self.encode, self.dtype = encode, dtype
        self.cache = PieceCache(lambda pieces: encode([self.meaning(p) for p in pieces]), entries)

    def meaning(self, piece: str) -> str:
        if piece[:1] == self.MARK:
            return piece[1:]
        return piece if piece[:1] == "\n" else f" {piece}"

    def ids(self, texts: pa.Array) -> Ids:
        own = texts.to_pylist()
        odd = [i for i, t in enumerate(own) if self.whole.search(t)]
        marked = [self.MARK + t.replace("\n", " \n") for t in own]
        for i in odd:
            marked[i] = self.MARK
        regular = gathered(pc.split_pattern(pa.array(marked, pa.string()), " "), self.cache, self.dtype)
        if not odd:
            return regular
        parts = regular.slices()
        for i, raw in zip(odd, self.encode([own[i] for i in odd])):
            parts[i] = np.frombuffer(raw, self.dtype)
        return Ids(np.concatenate(parts), np.cumsum([len(p) for p in parts]))


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves,
    the others in order from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(vocabulary: dict[str, int]) -> dict[bytes, int]:
    to_byte = byte_of_character()
    return {bytes(to_byte[c] for c in token): i for token, i in vocabulary.items()}


# The coder's pattern engine keeps a state per blank of a run and gives up at about a million.
LONG_RUN = 100_000
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # White_Space
_LONG_BLANKS = re.compile(f"[{_BLANK}]{{{LONG_RUN},}}")


def cut_long_blanks(text: str, specials: tuple[str, ...] = ()) -> list[tuple[str, bool]]:
    """The text in parts that share no pre-token; True marks a pre-token that is a long run of blanks.

    A run before other characters leaves its last blank to what follows, as the pre-tokenizer does; a special string
    ends a text for it.
    """
    out, at = [], 0
    for m in _LONG_BLANKS.finditer(text):
        end = m.end() if m.end() == len(text) or text.startswith(specials, m.end()) else m.end() - 1
        out += [(text[at : m.start()], False), (text[m.start() : end], True)]
        at = end
    out.append((text[at:], False))
    return [p for p in out if p[0]]


class ByteEncoder:
    """Byte-level BPE whose ids are its merge ranks, run by the tiktoken library on the same vocabulary file.

    Same ids as the tokenizers library in well under half the time; a file of another kind is refused. Runs of
    LONG_RUN blanks and more, which that library can't take, are merged by the queue of `merge_queue`.
    """

    def __init__(self, path: str):
        self.path = path
        import tiktoken

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, before = data["model"], data["pre_tokenizer"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocabulary = model["vocab"]
        by_rank = all(vocabulary[a + b] == 256 + i for i, (a, b) in enumerate(merges))
        plain = data["normalizer"] is None and before["type"] == "ByteLevel" and not before["add_prefix_space"]
        if model["type"] != "BPE" or not by_rank or not plain:
            raise ValueError("not a byte-level vocabulary in merge order")
        self.dtype = np.dtype("<u2") if len(vocabulary) + len(data["added_tokens"]) <= 1 << 16 else np.dtype("<u4")
        self.coder = tiktoken.Encoding(
            "bytes",
            pat_str=BYTE_PATTERN,
            mergeable_ranks=token_bytes(vocabulary),
            special_tokens={t["content"]: t["id"] for t in data["added_tokens"]},
        )

    def ids(self, texts: pa.Array) -> Ids:
        parts = [self.one(t) for t in texts.to_pylist()]
        flat = np.concatenate(parts) if parts else np.zeros(0, self.dtype)
        return Ids(flat, np.cumsum([len(p) for p in parts], dtype=np.int64))

    def one(self, text: str) -> np.ndarray:
        if len(text) < LONG_RUN or not _LONG_BLANKS.search(text):
            return self.coder.encode_to_numpy(text, allowed_special="all").astype(self.dtype)
        from barlab.llm.merge_queue import QueueBpe

        queue = per_worker(QueueBpe, self.path)
        parts = cut_long_blanks(text, tuple(self.coder.special_tokens_set))
        return np.concatenate([np.array(queue.word(part), self.dtype) if run else self.one(part) for part, run in parts])
