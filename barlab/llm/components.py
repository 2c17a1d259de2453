"""Connected components of a link table by alternating large and small stars.

Each round every node links its larger neighbours to the smallest node it sees, then its smaller ones; links stay
no more than they were and become stars after a logarithmic number of rounds. Only links are shuffled, smallest
neighbours are combined before the shuffle, and each round is stored in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import stored

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in `links` (a, b); the label is the smallest node of the component.

    Null ends, self links and repeated links change nothing; an empty table gives an empty table.
    """
    edges = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    last = _state(edges)
    for _ in range(MAX_ROUNDS):
        edges = stored(_small_star(_large_star(edges)), "links")
        state = _state(edges)
        if last == state:
            labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            return labels.unionByName(roots)
        last = state
    raise RuntimeError(f"components need more than {MAX_ROUNDS} rounds")


def _state(edges: DataFrame) -> tuple:
    """Count and sum of 64-bit hashes: tells whether a round changed a link."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    larger = both.filter("b > a")
    return larger.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # links run from the larger node a to the smaller node b
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
