"""Personal data and the terms that give it away.

Patterns find e-mail addresses, IP addresses, card and phone numbers; each different value is an entity to protect.
A term is a run of letters and digits of any length outside what the patterns find.
Corpus counts then say how strongly a term reveals an entity e. With counts n(e), n(t) and n(e,t) (t within CONTEXT
terms of e) over N different texts,

    disclosure(e, t) = PMI(e; t) / IC(e) = log(N n(e,t) / (n(e) n(t))) / log(N / n(e)),

which is 1 when every text with t has it beside e. Besides, e must be beside t in at least `min_share` of t's texts,
whatever N: the ratio of logarithms alone lets a rare term pass that stands in several texts without e. Terms at or above `remove_at` are removed, those at or above
`generalise_at` are replaced by a general word, wherever they stand. Personal data rarely repeat, so pairs of one text
count, too: the term's own n(t) is what weighs against chance. A larger `min_docs` would ask for pairs of more texts.

Defined results: null and empty texts have no span (a null text stays null); copies of a text count once (null and the
empty text are two texts) and get equal results; an entity of all texts has no information content and reveals nothing; extra columns pass
through; an empty table gives an empty table. Kinds may overlap; in the cleaned text the earliest, then longest span names what they cover together.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Collection, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string
from xxhash import xxh64_intdigest

from barlab.llm.common import each_batch, free_name, map_batches, stored, text_column

KINDS = ("email", "ip", "card", "phone")
ANY = "*"  # stands for any entity in the counts
CONTEXT = 20
MIN_DOCS = 1  # texts that a pair needs: every pair is scored
MIN_SHARE = 0.5  # of a term's texts that hold the entity beside it
GENERALISE_AT, REMOVE_AT = 0.85, 0.95
# Revealing terms are sent to all tasks up to so many bytes, each with what a table entry costs besides its letters.
BROADCAST_BYTES, TERM_BYTES = 64 << 20, 120
FILTER_BYTES, FILTER_TASKS, PROBES = 8 << 20, 8, 5
FILTER_CACHE = 400_000  # words whose answer a task remembers
HELD_PAIRS = 800_000  # (term, text) pairs that a task holds
SALT = 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits: the run's start would have matched before.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign with the run of local characters before it and the domain after it."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all patterns, by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def entity_of(kind: str, value: str) -> str:
    """One name for equal values written differently."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _digits(value)}"


def context_terms(text: str, spans: list[tuple[str, int, int]], context: int = CONTEXT) -> dict[str, set[str]]:
    """Entity to the lower-case terms within `context` words of one of its mentions."""
    out: dict[str, set[str]] = {}
    if not spans:
        return out
    terms = list(free_terms(text, spans))
    starts = [m.start() for m in terms]
    for kind, a, b in spans:
        own = out.setdefault(entity_of(kind, text[a:b]), set())
        i = bisect_left(starts, a)
        own.update(m[0].lower() for m in terms[max(0, i - context) : i + context])
    return out


def free_terms(text: str, spans: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """Runs of letters and digits that touch no span."""
    taken, i = merged([(a, b, k) for k, a, b in spans]), 0
    for m in _TERM.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i == len(taken) or taken[i][0] >= m.end():
            yield m


def terms_of(text: str) -> set[str]:
    """The lower-case terms outside the base spans."""
    spans = base_spans(text)
    return {m[0].lower() for m in free_terms(text, spans)} if spans else {w.lower() for w in set(_TERM.findall(text))}


def text_key(text: str) -> Column:
    """A 64-bit key of the text; null and the empty text differ."""
    return F.xxhash64(F.col(text).isNull(), F.col(text))


def merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans without overlap: by start, the longer first; one that reaches further extends the one before it."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, kind))
        elif b > out[-1][1]:
            out[-1] = (out[-1][0], b, out[-1][2])
    return out


def term_spans(text: str, base: list[tuple[str, int, int]], terms: dict[str, bool]) -> list[tuple[str, int, int]]:
    """Spans of revealing terms outside the base spans; kind `removed` or `term`."""
    if not terms:
        return []
    out = []
    for m in free_terms(text, base):
        word = m[0].lower()
        if word in terms:
            out.append(("removed" if terms[word] else "term", m.start(), m.end()))
    return out


def cleaned(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for a, b, kind in merged([(a, b, k) for k, a, b in spans]):
        out.append(text[at:a])
        if kind == "term":
            out.append("[Name]" if text[a].isupper() else "[word]")
        elif kind != "removed":
            out.append(f"[{kind}]")
        at = b
    out.append(text[at:])
    return "".join(out)


def revealing_terms(
    docs: DataFrame,
    text: str = "text",
    context: int = CONTEXT,
    min_docs: int = MIN_DOCS,
    generalise_at: float = GENERALISE_AT,
    remove_at: float = REMOVE_AT,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """(term, disclosure, remove): every term whose strongest disclosure of an entity reaches `generalise_at`."""
    texts = docs.select(text_key(text).alias("h"), text_column(text).alias("text"))

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches):
            rows: set[tuple] = set()
            for h, t in zip(*(c.to_pylist() for c in batch.columns)):
                for entity, own in context_terms(t, base_spans(t), context).items():
                    rows.add((h, entity, None))
                    rows.update((h, name, term) for term in own for name in (entity, ANY))
            keys, entities, terms = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(entities, pa.string()), pa.array(terms, pa.string())],
                names=["h", "entity", "term"],
            )

    total = texts.select("h").distinct().count()
    counted = map_batches(texts, mentions, "h long, entity string, term string").distinct()
    counted = stored(counted.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n")), "disclosure-pairs")
    entity = counted.filter("term is null").select("entity", F.col("n").alias("n_e"))
    pairs = counted.filter((F.col("entity") != ANY) & F.col("term").isNotNull() & (F.col("n") >= int(min_docs)))
    pairs = salted(pairs.select("entity", "term", F.col("n").alias("n_et")), entity, "entity", "term")
    # a term is in at least as many texts as it is near any entity, which bounds its disclosure
    near_any = counted.filter(F.col("entity") == ANY).select("term", F.col("n").alias("n_near"))
    most = F.log(F.lit(float(total)) * F.col("n_et") / (F.col("n_e").cast("double") * F.col("n_near")))
    most = most / F.log(F.lit(float(total)) / F.col("n_e"))
    pairs = salted(pairs, near_any, "term", "entity").filter(
        (F.col("n_e") < total) & (most >= generalise_at - 1e-9) & (F.col("n_et") >= min_share * F.col("n_near"))
    )
    pairs = stored(pairs.drop("n_near"), "disclosure-candidates")
    # the largest n(t) with which the term still reaches generalise_at
    enough = F.lit(float(total)) * F.col("n_et") / F.col("n_e")
    enough = enough * F.pow(F.col("n_e") / F.lit(float(total)), F.lit(float(generalise_at)))
    enough = F.least(enough, F.col("n_et") / F.lit(float(max(min_share, 1e-9))))
    candidates = pairs.groupBy("term").agg(F.max(F.floor(enough * (1 + 1e-9))).cast("long").alias("at_most"))
    frequency = document_counts(texts, stored(candidates, "disclosure-terms"))
    ic = F.log(F.lit(float(total)) / F.col("n_e"))
    pmi = F.log(F.lit(float(total)) * F.col("n_et") / (F.col("n_e").cast("double") * F.col("n_t")))
    scored = salted(pairs, frequency, "term", "entity").filter(F.col("n_et") >= min_share * F.col("n_t"))
    strongest = scored.groupBy("term").agg(F.max(pmi / ic).alias("disclosure"))
    return strongest.filter(F.col("disclosure") >= generalise_at).select(
        "term", "disclosure", (F.col("disclosure") >= remove_at).alias("remove")
    )


class BitFilter:
    """A Bloom filter of words: no member is refused, some others pass. At most FILTER_BYTES long, whatever it holds."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, np.uint64(len(bits) * 8)
        self.seen: dict[str, bool] = {}

    @staticmethod
    def places(words: list[str], size: int) -> np.ndarray:
        """PROBES places for every word, by double hashing."""
        h = np.array([xxh64_intdigest(w.encode()) for w in words], np.uint64)
        step = (h >> np.uint64(32)) | np.uint64(1)
        return np.stack([(h + step * np.uint64(i)) % np.uint64(size) for i in range(PROBES)])

    def among(self, lists: Sequence[Collection[str]]) -> list[list[str]]:
        """Of every list the words that pass; words not met before are looked up together."""
        seen = self.seen
        new = list({w for own in lists for w in own if w not in seen})
        if len(seen) + len(new) > FILTER_CACHE:
            self.seen = seen = {}
            new = list({w for own in lists for w in own})
        if new:
            at = self.places(new, int(self.size))
            bits = self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)
            seen.update(zip(new, (bits & 1).all(axis=0).tolist()))
        return [[w for w in own if seen[w]] for own in lists]


def bit_filter(words: DataFrame, count: int) -> np.ndarray:
    """The bits of a `BitFilter` of the column `term`: made by few tasks, joined here; about 10 bits a word."""
    size = 8 * min(FILTER_BYTES, max(64, count * 10 // 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = BitFilter.places(batch.column(0).to_pylist(), size).ravel()
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    made = map_batches(words.select("term").coalesce(FILTER_TASKS), run, "bits binary").toLocalIterator()
    out = np.zeros(size // 8, np.uint8)
    for r in made:
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def document_counts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, n_t): in how many different texts (by `h`) each wanted term occurs.

    Tasks know the wanted terms by a bit filter of bounded size and pass on (term, text) pairs of terms that pass, each
    pair once; a join with the wanted terms drops the others. The count is exact up to the largest `at_most`; of a
    more frequent term it is only known to be larger, as a task passes on no more than that many texts of it, and one.
    """
    most = wanted.agg(F.max("at_most")).first()[0] or 0
    held = texts.sparkSession.sparkContext.broadcast(bit_filter(wanted, wanted.count()))
    limit = HELD_PAIRS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = BitFilter(held.value)
        found: dict[str, set[int]] = {}
        told: set[str] = set()
        n = 0

        def pairs() -> pa.RecordBatch:
            rows = [(w, h) for w, own in found.items() for h in own]
            words, keys = zip(*rows) if rows else ((), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(keys, pa.int64())], names=["term", "h"]
            )

        for batch in each_batch(batches):
            lists = chosen.among([terms_of(t) for t in batch.column(1).to_pylist()])
            for h, own in zip(batch.column(0).to_pylist(), lists):
                for w in own:
                    if w in told:
                        continue
                    keys = found.setdefault(w, set())
                    n += h not in keys
                    keys.add(h)
                    if len(keys) > most:
                        told.add(w)
                if n > limit:
                    yield pairs()
                    found.clear()
                    n = 0
        yield pairs()

    pairs = map_batches(texts, count, "term string, h long").join(wanted.select("term"), "term", "left_semi")
    return pairs.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))


def salted(large: DataFrame, small: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join on `key` where the large side may hold one key very often: its rows are dealt by `by` to SALT copies."""
    spread = large.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALT)))
    copies = small.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {SALT - 1}L)")))
    return spread.join(copies, [key, "_salt"]).drop("_salt")


def with_spans(docs: DataFrame, text: str = "text", **limits: float) -> tuple[DataFrame, str, str]:
    """The table with two columns more and their names: spans (base kinds first) and the cleaned text."""
    terms = stored(revealing_terms(docs, text, **limits).select("term", "remove"), "disclosure-found")
    size = terms.agg(F.sum(F.octet_length("term") + TERM_BYTES)).first()[0] or 0
    few = size <= BROADCAST_BYTES
    held = docs.sparkSession.sparkContext.broadcast(
        {r["term"]: r["remove"] for r in terms.collect()} if few else None
    )
    given, spans_name, clean_name = (free_name(docs, n) for n in ("terms", "spans", "cleaned"))
    source = docs.withColumn(given, F.lit(None).cast("map<string,boolean>")) if few else _join_terms(docs, terms, text, given)
    place, own = docs.columns.index(text), len(docs.columns)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches):
            found, texts = [], []
            for t, row in zip(batch.column(place).to_pylist(), batch.column(own).to_pylist()):
                revealing = held.value if held.value is not None else dict(row or ())
                base = base_spans(t or "")
                spans = base + term_spans(t or "", base, revealing)
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                texts.append(cleaned(t, spans) if spans else t)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:own], pa.array(found, kind), pa.array(texts, pa.string())],
                names=[*batch.schema.names[:own], spans_name, clean_name],
            )

    schema = StructType(
        [
            *docs.schema.fields,
            StructField(spans_name, _parse_datatype_string("array<struct<kind:string,start:bigint,end:bigint>>")),
            StructField(clean_name, StringType()),
        ]
    )
    return map_batches(source, run, schema), spans_name, clean_name


def _join_terms(docs: DataFrame, terms: DataFrame, text: str, name: str) -> DataFrame:
    """Rows with a map of the revealing terms of their own text, found by a shuffle join on the term."""
    h = F.xxhash64(text_column(text))
    held = docs.sparkSession.sparkContext.broadcast(bit_filter(terms, terms.count()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = BitFilter(held.value)
        for batch in each_batch(batches):
            lists = chosen.among([terms_of(t) for t in batch.column(1).to_pylist()])
            rows = {(i, w) for i, own in zip(batch.column(0).to_pylist(), lists) for w in own}
            hashes, words = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.int64()), pa.array(words, pa.string())], names=["h", "term"]
            )

    words = map_batches(docs.select(h.alias("h"), text_column(text).alias("text")), split, "h long, term string")
    tie = free_name(docs, "hash")
    own = words.join(terms, "term").distinct().groupBy(F.col("h").alias(tie)).agg(
        F.map_from_entries(F.collect_list(F.struct("term", "remove"))).alias(name)
    )
    return docs.withColumn(tie, h).join(own, tie, "left").select(*docs.columns, name)


def sanitise(docs: DataFrame, text: str = "text", **limits: float) -> DataFrame:
    """The table with cleaned texts; n_chars, if there, follows the text."""
    found, _, clean = with_spans(docs, text, **limits)
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col(clean).alias(c))
        elif c == "n_chars":
            columns.append(F.length(clean).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(c))
    return found.select(*columns)


def span_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts per kind, the digest of the base spans, and all spans."""
    found, name, _ = with_spans(docs.select("doc_id", text), text)
    base = F.filter(name, lambda s: s["kind"].isin(*KINDS))

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        )

    def number(kind):
        return F.size(F.filter(name, lambda s: s["kind"] == kind)).cast("long")

    counts = [number(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(name)).alias("spans"))


def plain_digest(text: str | None) -> str:
    """The base digest of one text, for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text or "")).encode()).hexdigest()
