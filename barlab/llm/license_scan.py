"""License scan by diagonal voting: word k-grams of texts meet those of templates, and offsets vote for spans.

Every k-gram of words of every text is hashed and joined with the template positions that hold the same words. A match
at word i of the text and word t of the template votes for the diagonal i - t. Votes are summed per (text, template,
diagonal) before they are shuffled. Neighbouring diagonals, at most MAX_SHIFT apart and with less than MAX_GAP words
between them, are merged: words put in or left out move the rest of a notice to the next diagonal. A merged span that
is longer than its template by more than MAX_SHIFT words holds repeats; there each diagonal stands for itself.

A span is accepted where at least 9 of 10 template words are covered by votes (so templates of less than ten words
must stand there whole). Votes hold equal words, not only equal hashes. Of accepted spans that overlap, directly or
through others, those with the most covered words stay, and of these the ones with the shortest template: a notice of
version 2 is not one of version 3 as well. Spans of base phrases are whole matches and always stay.

Defined results: a null text has no words; words are stretches of ASCII letters and digits and of all characters
beyond ASCII, only A-Z are lower-cased. Rows that repeat key and text get the same result each, rows of one key with
different texts are judged apart, null keys included. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.llm.common import stored, text_column

K = 3
MAX_SHIFT = 4
MAX_GAP = 8
# Templates are broadcast up to so many bytes of words; beyond that the planner chooses the join.
BROADCAST_BYTES = 8 << 20

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A text to look for. A base phrase counts places; the others only label."""

    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.translate({c: c + 32 for c in range(65, 91)}))


# The base phrases and their labels.
BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)

# Notices as the licenses' publishers word them.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
             "associated documentation files"),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial "
             "portions of the Software"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
             "is hereby granted"),
    Template("bsd-2", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
             "and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    Template("bsd-3", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
             "and the following disclaimer in the documentation and/or other materials provided with the distribution. "
             "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
             "products derived from this software without specific prior written permission"),
    Template("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the "
             "License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("gpl-2", "GNU General Public License, version 2"),
    Template("gpl-3", "GNU General Public License, version 3"),
    Template("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; "
             "either version 2 of the License, or (at your option) any later version"),
    Template("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, "
             "either version 3 of the License, or (at your option) any later version"),
    Template("lgpl-2.1", "GNU Lesser General Public License, version 2.1"),
    Template("lgpl-3", "GNU Lesser General Public License, version 3"),
    Template("lgpl-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software "
             "Foundation; either version 2.1 of the License, or (at your option) any later version"),
    Template("agpl-3", "GNU Affero General Public License, version 3"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("mpl-2", "Mozilla Public License, version 2"),
    Template("epl-2", "Eclipse Public License, version 2"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights"),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("cc-by-sa", "CC BY-SA 4.0"),
    Template("cc-by", "licensed under CC BY 4.0"),
)


def words_column(text: str = "text") -> Column:
    lowered = F.translate(text_column(text), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def template_grams(templates: Sequence[Template]) -> list[tuple]:
    """(template, label, base, words, place, w0, w1, w2) of every k-gram of every template."""
    rows = []
    for i, t in enumerate(templates):
        words = t.words
        if len(words) < K:
            raise ValueError(f"a template needs at least {K} words: {t.text!r}")
        rows += [(i, t.label, t.base, len(words), p, *words[p : p + K]) for p in range(len(words) - K + 1)]
    return rows


def _positions(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    rows = template_grams(templates)
    table = spark.createDataFrame(
        rows, "template int, label string, base boolean, length int, place int, w0 string, w1 string, w2 string"
    ).withColumn("hash", F.xxhash64("w0", "w1", "w2"))
    size = sum(32 + sum(len(w.encode()) for w in r[5:]) for r in rows)
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def diagonals(docs: DataFrame, templates: Sequence[Template], key: str, text: str) -> DataFrame:
    """(key, text_hash, n_words, template, .., diagonal, places, copies), and one row per text with a null template.

    `places` are the template's k-grams met on the diagonal; `copies` counts rows that repeat key and text.
    """
    words = docs.select(
        F.col(key).alias("key"), F.xxhash64(text_column(text)).alias("text_hash"), words_column(text).alias("words")
    )
    # one more, empty place per text, which meets no template, stands for the text itself
    grams = words.select(
        "key", "text_hash", "words", F.size("words").alias("n_words"),
        F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("at", "v0"),
    ).select(
        "key", "text_hash", "n_words", "at", "v0",
        F.get("words", F.col("at") + 1).alias("v1"), F.get("words", F.col("at") + 2).alias("v2"),
    ).withColumn("v_hash", F.xxhash64("v0", "v1", "v2"))
    same = [F.col("v_hash") == F.col("hash"), *[F.col(f"v{i}") == F.col(f"w{i}") for i in range(K)]]
    met = grams.join(_positions(docs.sparkSession, templates), same, "left").where(
        F.col("template").isNotNull() | (F.col("at") == F.col("n_words"))
    )
    return met.groupBy(
        "key", "text_hash", "n_words", "template", "label", "base", "length",
        F.when(F.col("template").isNotNull(), F.col("at") - F.col("place")).alias("diagonal"),
    ).agg(
        F.array_sort(F.collect_set("place")).alias("places"),
        F.count(F.when(F.col("template").isNull(), 1)).alias("copies"),
    )


def _covered(places: Column) -> Column:
    """Template words under the k-grams at `places`."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + (K - 1))))))


def accepted_spans(met: DataFrame) -> DataFrame:
    """(key, text_hash, template, label, base, start, end, covered, length): verified spans, `end` exclusive."""
    one = ["key", "text_hash", "template", "label", "base", "length"]
    rows = met.where(F.col("template").isNotNull()).withColumns(
        {
            "start": F.col("diagonal") + F.element_at("places", 1),
            "end": F.col("diagonal") + F.element_at("places", -1) + K,
        }
    )
    whole = rows.where(F.col("base") & (F.size("places") == F.col("length") - (K - 1))).select(
        *one, "start", "end", F.col("length").alias("covered")
    )
    # chains of neighbouring diagonals
    order = Window.partitionBy(*one).orderBy("start", "diagonal")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    apart = (F.col("start") - F.max("end").over(before) >= MAX_GAP) | (
        F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > MAX_SHIFT
    )
    chained = rows.where(~F.col("base")).withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
    chained = chained.withColumn("chain", F.sum("_new").over(order))
    member = Window.partitionBy(*one, "chain")
    chained = chained.withColumn(
        "_fits", F.max("end").over(member) - F.min("start").over(member) <= F.col("length") + MAX_SHIFT
    )
    # a chain too long for one notice falls apart into its diagonals
    chained = chained.withColumn("part", F.when(~F.col("_fits"), F.col("diagonal")))
    merged = chained.select(*one, "chain", "part", "start", "end", F.explode("places").alias("place")).groupBy(
        *one, "chain", "part"
    ).agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        _covered(F.array_sort(F.collect_set("place"))).alias("covered"),
    ).where(F.col("covered") * 10 >= F.col("length") * 9)
    # of spans that overlap, the ones that cover most words, and the largest share of their template
    row = Window.partitionBy("key", "text_hash").orderBy("start", "end", "template")
    reach = F.max("end").over(row.rowsBetween(Window.unboundedPreceding, -1))
    group = merged.withColumn("_new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")).withColumn(
        "_group", F.sum("_new").over(row)
    )
    by_cover = Window.partitionBy("key", "text_hash", "_group").orderBy(F.desc("covered"), "length")
    best = group.withColumn("_place", F.rank().over(by_cover)).where(F.col("_place") == 1)
    return whole.unionByName(best.select(*whole.columns))


def license_spans(docs: DataFrame, templates: Sequence[Template] = BASE + NOTICES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, label, base, start, end, score) of every verified span, in words; `end` is exclusive."""
    spans = accepted_spans(stored(diagonals(docs, templates, key, text), "license-votes"))
    return spans.select(
        F.col("key").alias(key), "text_hash", "label", "base", "start", "end", (F.col("covered") / F.col("length")).alias("score")
    )


def license_labels(docs: DataFrame, templates: Sequence[Template] = BASE + NOTICES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its words, the places of base phrases, all labels, and the best span's share of its template."""
    met = stored(diagonals(docs, templates, key, text), "license-votes")
    nothing = {"label": "string", "base": "boolean", "start": "int", "score": "double"}
    marks = met.where(F.col("template").isNull()).select(
        "key", "text_hash", "n_words", "copies", *[F.lit(None).cast(kind).alias(c) for c, kind in nothing.items()]
    )
    spans = accepted_spans(met).select(
        "key", "text_hash", F.lit(None).cast("int").alias("n_words"), F.lit(None).cast("long").alias("copies"),
        "label", "base", "start", (F.col("covered") / F.col("length")).alias("score"),
    )
    base = F.when(F.col("base"), F.col("start"))
    found = marks.unionByName(spans).groupBy("key", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.max("copies").alias("copies"),
        F.count(base).alias("n_base"),
        F.min(base).cast("long").alias("first_word"),
        F.max(base).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
    )
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )
