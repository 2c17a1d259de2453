"""Line-first cleaning with DataFrame functions only.

Each line is tested by itself: punctuation (symbol noise, shouting, a word repeated over and over),
navigation (separator bars, menu entries) and boilerplate (legal and web-page phrases). Failing lines
are removed; a document that loses more than `max_lost` of its non-blank characters is rejected, as is
one that fails the document rules (too few words, too many repeated word triples).

Defined results: null and blank texts have no words and are rejected; lines without a word are neither
judged nor removed; rows are judged one by one, so repeated rows and ids give equal repeated results;
other columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import free_name, let, text_column

BLANKS = r" \t\n\x0B\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words inside repeated triples
MAX_LOST = 0.5
FEW = 12  # up to so many different repeated triples are looked up one by one; more are found by sorting

# Phrases of web-page and licence boilerplate; a short line that holds one carries no prose.
BOILERPLATE = (
    r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies"
    r"|we use cookies|enable javascript|javascript is (disabled|required)|click here|read more|sign (in|up)"
    r"|log ?in|subscribe (now|to)|share (this|on)|back to top|skip to (main )?content|licensed under|lorem ipsum)\b"
    r"|©|\(c\) (19|20)[0-9]{2}"
)
BOILERPLATE_WORDS = 30
BARS = "|»›·•"
MENU_CHARS = 40  # a menu entry is short; scripts without blanks put a whole sentence into one word
MARKS = SYMBOLS + "=~^_{}\\"
SENTENCE_END = r"[.!?…。！？:;,\"'”’»)\]]$"


def without(text: Column, chars: str) -> Column:
    """The text without the given characters; each is removed by a plain byte search."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    """Maximal runs of other characters than ASCII blanks, in order."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, f"[{BLANKS}]+")
    )


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that the same text holds at least twice.

    Windows are compared by 64-bit hash. Sorted hashes show which occur twice, their positions how many
    words they cover.
    """
    n = F.size(words)

    def covered(hashes: Column, twice: Column) -> Column:
        def few(h: Column, i: Column) -> Column:
            return F.when(F.array_contains(twice, h), i)

        some = F.filter(F.transform(hashes, few), lambda i: i.isNotNull())
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        many = let(ranked, lambda z: F.sort_array(again(z)))
        return let(F.when(F.size(twice) <= FEW, some).otherwise(many), spread)

    def again(z: Column) -> Column:
        last = F.size(z) - 1
        kept = F.filter(
            z,
            lambda x, k: ((k > 0) & (F.get(z, k - 1)["h"] == x["h"]))
            | ((k < last) & (F.get(z, k + 1)["h"] == x["h"])),
        )
        return F.transform(kept, lambda x: x["i"])

    def spread(starts: Column) -> Column:
        steps = F.transform(
            starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    hashes = F.transform(
        F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    def in_order(h: Column) -> Column:
        return let(
            F.sort_array(h),
            lambda z: let(
                F.array_distinct(F.filter(z, lambda x, k: (k > 0) & (F.get(z, k - 1) == x))),
                lambda twice: F.when(F.size(twice) == 0, F.lit(0)).otherwise(covered(h, twice)),
            ),
        )

    return let(hashes, in_order)


def has_word(line: Column) -> Column:
    return line.rlike(rf"[^{BLANKS}]")


def line_fails(line: Column) -> Column:
    """True for a line that is noise, navigation or boilerplate; false for lines without a word.

    Words are counted as inner blanks plus one. Every figure is computed once per line.
    """
    trimmed = F.btrim(line, F.lit(" \t\x0b\f\r"))

    def figures(t: Column) -> Column:
        solid = without(t, " \t\x0b\f\r")
        return let(
            F.struct(
                t.alias("t"),
                F.length(t).alias("all"),
                F.length(solid).alias("n"),
                F.length(without(solid, MARKS)).alias("plain"),
                F.length(without(solid, BARS)).alias("unbarred"),
                F.length(F.replace(t, F.lit("!!"), F.lit("!"))).alias("calm"),
            ),
            verdict,
        )

    def verdict(x: Column) -> Column:
        words = x["all"] - x["n"] + 1
        marks = x["n"] - x["plain"]
        bars = x["n"] - x["unbarred"]
        calls = x["all"] - x["calm"]
        noisy = (marks * 10 > x["n"]) & (marks >= 3)
        shouting = (calls >= 3) & (calls * 4 >= words)
        entry = (words <= 3) & (x["n"] <= MENU_CHARS) & ~x["t"].rlike(SENTENCE_END)
        menu = ((bars >= 2) & (bars * 5 >= words)) | entry
        phrase = (words <= BOILERPLATE_WORDS) & x["t"].rlike(BOILERPLATE)
        return (x["n"] > 0) & (noisy | shouting | menu | phrase)

    return let(trimmed, figures)


def clean_lines(lines: Column) -> Column:
    return F.filter(lines, lambda line: ~line_fails(line))


def judged(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST) -> tuple[DataFrame, str]:
    """All rows with a struct of their figures; the struct's name is returned too.

    Fields: cleaned (text), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed,
    lost (share of non-blank characters removed), base_failed, kept.
    """
    verdict = free_name(docs, "quality")
    whole = text_column(text)
    solid = without(whole, " \t\n\x0b\f\r")
    lines = F.split(whole, "\n", -1)
    figures = F.struct(
        let(words_of(whole), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("again"))).alias("w"),
        let(
            lines,
            lambda ls: let(
                F.filter(ls, has_word),
                lambda own: F.struct(
                    (F.size(own) - F.size(F.array_distinct(own))).alias("dup"),
                    F.size(ls).alias("n"),
                    clean_lines(ls).alias("clean"),
                ),
            ),
        ).alias("l"),
        F.length(without(whole, " \t\n\x0b\f\r")).alias("chars"),
        (F.length(whole) - F.length(without(whole, SYMBOLS))).alias("symbols"),
    )

    def with_text(p: Column) -> Column:
        return let(
            F.struct(p.alias("p"), F.array_join(p["l"]["clean"], "\n").alias("cleaned")),
            lambda x: let(
                F.struct(
                    x["p"].alias("p"),
                    x["cleaned"].alias("cleaned"),
                    F.when(
                        x["p"]["chars"] > 0,
                        1 - F.length(without(x["cleaned"], " \t\n\x0b\f\r")) / x["p"]["chars"],
                    ).otherwise(F.lit(0.0)).alias("lost"),
                    (
                        (x["p"]["w"]["n"] < MIN_WORDS)
                        | (x["p"]["w"]["again"] * 100 > x["p"]["w"]["n"] * MAX_REPEATED)
                    ).alias("failed"),
                ),
                fields,
            ),
        )

    def fields(x: Column) -> Column:
        p = x["p"]
        return F.struct(
            x["cleaned"].alias("cleaned"),
            p["w"]["n"].cast("long").alias("n_words"),
            p["chars"].cast("long").alias("word_chars"),
            p["symbols"].cast("long").alias("n_symbols"),
            p["l"]["dup"].cast("long").alias("n_dup_lines"),
            p["w"]["again"].cast("long").alias("n_repeat_words"),
            (p["l"]["n"] - F.size(p["l"]["clean"])).cast("long").alias("n_lines_removed"),
            x["lost"].alias("lost"),
            x["failed"].alias("base_failed"),
            (~x["failed"] & (x["lost"] <= max_lost)).alias("kept"),
        )

    return docs.withColumn(verdict, let(figures, with_text)), verdict


def clean_documents(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """Accepted documents with their failing lines removed; same columns (n_chars follows the text)."""
    out, verdict = judged(docs, text, max_lost)
    # a generator of one row: filter and columns read its result, so that no text is judged twice
    out = out.withColumn(verdict, F.explode(F.array(F.col(verdict))))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col(verdict)["cleaned"].alias(c))
        elif c == "n_chars":
            columns.append(F.length(F.col(verdict)["cleaned"]).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(c))
    return out.filter(F.col(verdict)["kept"]).select(*columns)


def quality_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document with its figures and the verdict."""
    out, verdict = judged(docs, text)
    v = F.col(verdict)
    fields = (
        "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_lines_removed lost"
    ).split()
    return out.select("doc_id", *[v[f].alias(f) for f in fields])
