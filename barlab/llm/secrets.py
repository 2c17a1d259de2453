"""Secrets in texts, with DataFrame functions only.

Patterns find assignments to secret names, access keys and long hexadecimal runs. Beyond those, two character
Markov models (one of random strings, one of ordinary identifiers) judge every run of 20 or more key characters:
the summed log-likelihood ratio of its character pairs must reach `MIN_RATIO` and `MIN_PER_CHAR` per pair. The limits
were chosen on labelled strings of documents that the models had not seen (README: both error rates). Shorter runs are
not judged: their ratios can't tell enough.

Training is from labelled samples: about SAMPLE_DOCS documents (chosen by hash) give words, and words joined as
identifiers, as ordinary strings; digests of the same documents, written in several alphabets, and the values that
the patterns found there are the random strings. The models are two tables of at most 67 x 67 counts.

Positions count code points; a start is the summed length of everything before it, taken from the pieces between
matches and the matches themselves.

Defined results: null and empty texts have no span; runs without a letter are numbers, not secrets; a run that
touches a pattern's span is left to the pattern; repeated rows give equal repeated results; extra columns pass
through; an empty table gives an empty table, and without samples the models find nothing more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import free_name, let, text_column

KINDS = ("assign", "access", "hex", "markov")
SAMPLE_DOCS = 200
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SMOOTHING = 0.5
MIN_RATIO, MIN_PER_CHAR = 30.0, 1.2

# Fixed patterns. Where only runs of some length count, the length is part of the pattern; an assignment
# whose value is too short still uses up its match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
SHORT_VALUE = 6


BLOCK = 64


def running_sums(numbers: Column) -> Column:
    """Sums of each element and all before it: totals per block, sums over blocks, then inside each block."""

    def add(a: Column, b: Column) -> Column:
        return a + b

    def totals(n: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int"))
        return F.transform(blocks, lambda b: F.aggregate(F.slice(n, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), add))

    def over_blocks(t: Column) -> Column:
        return F.aggregate(t, F.array(F.lit(0)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))

    def inside(n: Column, before: Column) -> Column:
        def own(v: Column, i: Column) -> Column:
            first = F.floor(i / BLOCK).cast("int")
            return F.get(before, first) + F.aggregate(
                F.slice(n, first * BLOCK + 1, i - first * BLOCK + 1), F.lit(0), add
            )

        return F.transform(n, own)

    return let(numbers, lambda n: let(over_blocks(totals(n)), lambda before: inside(n, before)))


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Array of (start, kind, end, value) of all leftmost matches that don't overlap."""

    def placed(x: Column) -> Column:
        lengths = F.transform(
            x["found"], lambda m, i: F.length(F.get(x["between"], i)) + F.length(m)
        )
        return let(
            running_sums(lengths),
            lambda ends: F.transform(
                x["found"],
                lambda m, i: F.struct(
                    (F.get(ends, i) - F.length(m)).alias("start"),
                    F.lit(kind).alias("kind"),
                    F.get(ends, i).alias("end"),
                    m.alias("value"),
                ),
            ),
        )

    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.split(text, pattern, -1).alias("between"),
    )
    return F.when(text.rlike(pattern), let(found, placed)).otherwise(none)


def base_matches(text: Column) -> Column:
    """The pattern spans of a text by start, then kind."""
    value = lambda m: F.regexp_extract(m["value"], ASSIGN, 2)
    assign = F.filter(matches(text, ASSIGN, 0), lambda m: F.length(value(m)) >= SHORT_VALUE)
    return F.sort_array(F.concat(assign, matches(text, ACCESS, 1), matches(text, HEX, 2)))


def labelled_samples(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(random, value): strings labelled as random or ordinary, from about `sample_docs` documents."""
    share = max(1, docs.count() // sample_docs)
    whole = text_column(text)
    sample = docs.select(whole.alias("t"), F.xxhash64(*docs.columns[:1], whole).alias("h")).filter(
        F.pmod("h", F.lit(share)) == 0
    )
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("t"), ASSIGN, " "), ACCESS, " "), HEX, " ")
    # runs long enough to be judged later carry no label
    plain = F.regexp_replace(plain, RUN, " ")
    words = F.regexp_extract_all(plain, F.lit("[A-Za-z0-9+/_=-]{3,}"), F.lit(0))

    def joined(w: Column) -> Column:
        def pair(x: Column, i: Column) -> Column:
            after = F.coalesce(F.get(w, i + 1), F.lit("id"))
            return F.array(
                x,
                F.concat_ws("_", F.lower(x), F.lower(after)),
                F.concat(F.lower(x), F.initcap(after)),
                F.concat_ws("-", x, after),
                F.concat_ws("/", x, after),
                F.upper(F.concat_ws("_", x, after)),
            )

        return F.flatten(F.transform(w, pair))

    digest = F.sha2(F.concat_ws(":", F.col("h").cast("string"), F.col("t")), 256)
    coded = F.base64(F.unhex(digest))
    random = F.array(
        digest,
        F.upper(digest),
        coded,
        F.translate(coded, "+/", "-_"),
        F.upper(F.regexp_replace(coded, "[^A-Za-z0-9]", "")),
        F.regexp_replace(coded, "[^A-Za-z0-9]", ""),
    )
    known = F.transform(base_matches(F.col("t")), lambda m: F.regexp_extract(m["value"], r"([A-Za-z0-9+/_=-]+)$", 1))
    ordinary = sample.select(F.lit(False).alias("random"), F.explode(let(words, joined)).alias("value"))
    return ordinary.unionByName(
        sample.select(F.lit(True).alias("random"), F.explode(F.concat(random, known)).alias("value"))
    )


def pair_ratios(samples: DataFrame) -> list[float]:
    """log P(random) - log P(ordinary) for every pair of characters, as a table by position in ALPHABET.

    Position 0 stands for the start of a string. The counts that reach the driver are bounded by the alphabet.
    """
    value = F.concat(F.lit("^"), F.col("value"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda i: F.substring(value, i, F.lit(2)))
    counted = (
        samples.filter(F.length("value") > 0)
        .select("random", F.explode(pairs).alias("pair"))
        .groupBy("random", "pair")
        .count()
        .collect()
    )
    size = len(ALPHABET) + 1
    code = {c: i + 1 for i, c in enumerate(ALPHABET)} | {"^": 0}
    logs = []
    for label in (True, False):
        counts = [[SMOOTHING] * size for _ in range(size)]
        for r in counted:
            if r["random"] == label and all(c in code for c in r["pair"]):
                counts[code[r["pair"][0]]][code[r["pair"][1]]] += r["count"]
        logs.append([[math.log(x / sum(row)) for x in row] for row in counts])
    return [a - b for left, right in zip(*logs) for a, b in zip(left, right)]


def log_ratio(value: Column, ratios: list[float]) -> Column:
    """The summed log-likelihood ratio of a string's pairs."""
    size = len(ALPHABET) + 1
    table = F.lit(ratios)
    codes = F.transform(
        F.sequence(F.lit(1), F.length(value)), lambda i: F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1)))
    )
    return let(
        codes,
        lambda c: F.aggregate(
            F.transform(c, lambda x, i: F.get(table, F.coalesce(F.get(c, i - 1), F.lit(0)) * size + x)),
            F.lit(0.0),
            lambda a, b: a + b,
        ),
    )


def find_secrets(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> tuple[DataFrame, str]:
    """The table with an array of (start, kind, end, value), by start, then kind; the column's name follows."""
    ratios = pair_ratios(labelled_samples(docs, text, sample_docs))
    name = free_name(docs, "secrets")
    whole = text_column(text)

    def random_runs(base: Column) -> Column:
        def secret(m: Column) -> Column:
            free = ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
            ratio = log_ratio(m["value"], ratios)
            enough = let(ratio, lambda r: (r >= MIN_RATIO) & (r >= MIN_PER_CHAR * F.length(m["value"])))
            return free & m["value"].rlike("[A-Za-z]") & enough

        return F.filter(matches(whole, RUN, 3), secret)

    spans = let(base_matches(whole), lambda base: F.sort_array(F.concat(base, random_runs(base))))
    return docs.withColumn(name, spans), name


def secret_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts per pattern, the digest of the pattern spans, and all spans."""
    found, name = find_secrets(docs.select("doc_id", text), text)
    spans = F.col(name)

    def joined(some: Column) -> Column:
        part = lambda m: F.concat_ws(
            ":", F.get(F.array(*map(F.lit, KINDS)), m["kind"]), m["start"].cast("string"), m["end"].cast("string")
        )
        return F.array_join(F.transform(some, part), ",")

    def number(kind: int) -> Column:
        return F.size(F.filter(spans, lambda m: m["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[number(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(joined(F.filter(spans, lambda m: m["kind"] < 3)), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )
