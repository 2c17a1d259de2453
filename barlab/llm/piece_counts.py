"""Token counts without tokens: the best path through a unigram vocabulary, carrying its score and piece count.

An Aho-Corasick automaton lists all vocabulary strings that end at a character, the longest first. The best path to
a position is the best score of a start plus that piece's score; a later (shorter) piece replaces it only if strictly
better. A character that is no piece itself may be unknown at the lowest vocabulary score less 10; unknown stretches
count one piece per byte if the vocabulary has all byte pieces, else one per stretch. These are the rules of the
tokenizers library's unigram model, to which counts are equal.

A blank becomes the word mark and one mark stands before the text. No vocabulary string holds a mark behind another
character or a line break, so a text is cut before marks and at line breaks, and each different part is counted once.
Where a vocabulary or its scores don't allow this (scores that aren't whole numbers), whole texts are counted.

Defined results: null and empty texts have no tokens and score 0; repeated rows give equal results; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from barlab.llm.chunks import CACHE_ENTRIES, LONG_PIECE, per_worker
from barlab.llm.common import each_batch, map_batches, text_column, tokenizer_path

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_PARTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class CountingViterbi:
    """Score and piece count of the best segmentation."""

    def __init__(self, vocabulary: Sequence[tuple[str, float]], unknown: int, bytes_too: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {p for p, _ in vocabulary}
        self.single = {p for p in names if len(p) == 1}
        self.unknown_score = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.by_byte = bytes_too and all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown_piece = vocabulary[unknown][0]
        whole = all(float(s).is_integer() for _, s in vocabulary)
        self.cuts = whole and not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in names)

    def best(self, text: str) -> tuple[float, int]:
        """(score, pieces) of a text whose blanks are marks already."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, found in self.automaton.iter(text):
            ends[end + 1].append(found)
        single, unknown_score = self.single, self.unknown_score
        score, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for e in range(1, n + 1):
            best, start, bad = None, e, False
            for length, own in ends[e]:
                value = score[e - length] + own
                if best is None or value > best:
                    best, start = value, e - length
            if text[e - 1] not in single:
                value = score[e - 1] + unknown_score
                if best is None or value > best:
                    best, start, bad = value, e - 1, True
            score[e], unknown[e] = best, bad
            if not bad:
                pieces[e] = pieces[start] + 1
            elif self.by_byte:
                pieces[e] = pieces[start] + len(text[e - 1].encode())
            else:
                pieces[e] = pieces[start] + (0 if unknown[start] else 1)
        return score[n], pieces[n]


class PieceCounter:
    """Counts of whole texts by a sentencepiece vocabulary file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        vocabulary = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
        self.viterbi = CountingViterbi(vocabulary, model.unk_id())
        self.known: dict[str, tuple[float, int]] = {}

    def of(self, part: str) -> tuple[float, int]:
        found = self.known.get(part)
        if found is None:
            found = self.viterbi.best(part)
            if len(part) <= LONG_PIECE:
                if len(self.known) >= CACHE_ENTRIES:
                    self.known.clear()
                self.known[part] = found
        return found

    def whole(self, text: str) -> tuple[float, int]:
        """A text of any kind of blanks."""
        if not text:
            return 0.0, 0
        marked = MARK + text.replace(" ", MARK)
        if not self.viterbi.cuts:
            return self.viterbi.best(marked)
        parts = [self.of(p) for line in re.split("(\n)", marked) for p in _PARTS.findall(line)]
        return sum(s for s, _ in parts), sum(c for _, c in parts)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores and piece counts of all texts."""
        own = texts.to_pylist()
        odd = [i for i, t in enumerate(own) if not t or not self.viterbi.cuts or t[0] == " " or "  " in t or MARK in t]
        regular = list(own)
        for i in odd:
            regular[i] = ""
        # parts that start with a line break stand for themselves, the others for a mark and themselves
        split = pc.split_pattern(pc.replace_substring(pa.array(regular, pa.string()), "\n", " \n"), " ")
        coded = split.flatten().dictionary_encode()
        unique = [self.part(p) for p in coded.dictionary.to_pylist()]
        score = np.array([s for s, _ in unique], np.float64)
        pieces = np.array([c for _, c in unique], np.int64)
        index = coded.indices.to_numpy()
        bounds = split.offsets.to_numpy()
        bounds = bounds - bounds[0]
        sums = [np.concatenate([[0], np.cumsum(x[index])]) for x in (score, pieces)]
        scores, counts = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
        for i in odd:
            scores[i], counts[i] = self.whole(own[i])
        return scores, counts

    def part(self, part: str) -> tuple[float, int]:
        if part[:1] != "\n":
            return self.of(MARK + part)
        (a, n), (b, m) = self.of("\n"), self.of(part[1:]) if len(part) > 1 else (0.0, 0)
        return a + b, n + m


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, score) of every document."""
    path = tokenizer_path(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches, 2048):
            scores, counts = per_worker(PieceCounter, path).counts(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts.astype(np.int64)), pa.array(scores.astype(np.float64))],
                names=[key, "n_tokens", "score"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text_column(text).alias("text")), run, f"`{key}` {kind}, n_tokens long, score double")
