"""Partitioned bar and feature datasets (root / UTC year)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.functions.numeric import nonfinite_to_null
from barlab.operators.stability import count_mismatches, require_empty
from barlab.session import materialise
from barlab.sources.commits import Commits

ATTEMPTS = 20


def write_dataset(df: DataFrame, path: str) -> None:
    """zstd Parquet under root=/year=; replaces only the partitions that ``df`` holds.

    REBALANCE groups rows by partition and lets the adaptive planner split a heavy root or year
    over several tasks and files, and join small ones. NaN and infinities are stored as null.
    """
    (
        nonfinite_to_null(df).withColumn("year", F.year("ts"))
        .hint("rebalance", F.col("root"), F.col("year"))
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("root", "year")
        .parquet(path)
    )


def read_dataset(
    spark: SparkSession, path: str, roots: Sequence[str] | None = None,
    years: tuple[int, int] | None = None,
) -> DataFrame:
    """Scan with partition pruning on root and, where known, on year."""
    df = spark.read.parquet(path)
    if roots is not None:
        df = df.where(F.col("root").isin(*roots))
    if years is not None:
        df = df.where(F.col("year").between(*years))
    return df


def read_between(
    spark: SparkSession, path: str, first: datetime, until: datetime, roots: Sequence[str] | None = None
) -> DataFrame:
    """Rows with first <= ts < until (UTC); the years of the bounds prune partitions."""
    last = until - timedelta(microseconds=1)
    rows = read_dataset(spark, path, roots, (first.year, last.year))
    bounds = [F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz").cast("timestamp") for t in (first, until)]
    return rows.where((F.col("ts") >= bounds[0]) & (F.col("ts") < bounds[1]))


def read_root(spark: SparkSession, path: str, root: str) -> DataFrame:
    """One root in time order; an absent root is an error."""
    df = read_dataset(spark, path, [root])
    if df.select(F.lit(1)).isEmpty():
        raise FileNotFoundError(f"no partitions of root {root!r} under {path}")
    return df.orderBy("ts")


def write_rollovers(segments: DataFrame, path: str) -> None:
    segments.write.mode("overwrite").option("compression", "zstd").partitionBy("root").parquet(path)


def stored_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("root").agg(F.count(F.lit(1)).alias("stored_rows"))


def roots_to_rebuild(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Roots whose stored row count is absent or differs from the expected one."""
    return expected.join(stored, "root", "left").where(
        ~F.col("expected_rows").eqNullSafe(F.col("stored_rows"))
    )


def read_committed(spark: SparkSession, path: str) -> DataFrame | None:
    """The committed rows of all roots of a rebuilt dataset; None before the first commit."""
    _, record = Commits(spark, path).latest()
    folders = [f"{folder}/root={root}" for root, folder in sorted(record.get("roots", {}).items())]
    if not folders:
        return None
    rows = spark.read.option("basePath", f"{path.rstrip('/')}/parts").parquet(*folders).drop("commit")
    return rows.withColumn("root", F.col("root").cast("string"))


def commit_roots(spark: SparkSession, path: str, rows: DataFrame, expected: DataFrame | None = None) -> list[str]:
    """Write the roots of ``rows`` to a folder of their own, check them, then switch readers to them.

    ``expected`` holds (root, expected_rows, expected_rolls); a root whose stored rows or roll events differ stops the
    run before the switch, and readers keep the old state. Roots not in ``rows`` keep their folder. A commit by
    another writer meanwhile is respected: only this writer's roots are replaced in it.
    """
    commits = Commits(spark, path)
    folder = commits.new_folder(commits.latest()[0] + 1)
    write_dataset(rows, folder)
    written = spark.read.parquet(folder).groupBy(F.col("root").cast("string").alias("root")).agg(
        F.count(F.lit(1)).alias("expected_rows"),
        F.count_if("roll_event").alias("expected_rolls"),
    )
    written = materialise(written)
    names = [r["root"] for r in written.select("root").collect()]
    if expected is not None:
        own = expected.join(written.select("root"), "root", "left_semi")
        bad = count_mismatches(own, written, ["root"], ["expected_rows", "expected_rolls"])
        require_empty(bad, f"stored roots differ from what was expected, {folder} is not committed")
    for _ in range(ATTEMPTS):
        number, record = commits.latest()
        if commits.commit(number + 1, {"roots": {**record.get("roots", {}), **dict.fromkeys(names, folder)}}):
            return names
    raise RuntimeError(f"other writers committed to {path} {ATTEMPTS} times meanwhile")


def rebuild_roots(spark: SparkSession, path: str, source: DataFrame, expected: DataFrame) -> DataFrame:
    """Bring every root whose committed row count is wrong or absent back from ``source``.

    Returns (root, expected_rows, stored_rows, rebuilt). Roots that are right are not read beyond their count, and
    a run that stops before its commit has changed nothing.
    """
    current = read_committed(spark, path)
    counts = (
        spark.createDataFrame([], "root string, stored_rows long") if current is None
        else current.groupBy("root").agg(F.count(F.lit(1)).alias("stored_rows"))
    )
    todo = materialise(roots_to_rebuild(expected, counts).select("root"))
    if not todo.isEmpty():
        commit_roots(spark, path, source.join(todo, "root", "left_semi"), expected)
    stored = read_committed(spark, path)
    after = stored.groupBy("root").agg(F.count(F.lit(1)).alias("stored_rows")) if stored is not None else counts
    return (
        expected.join(after, "root", "left")
        .join(todo.withColumn("_done", F.lit(True)), "root", "left")
        .select("root", "expected_rows", "stored_rows", F.coalesce("_done", F.lit(False)).alias("rebuilt"))
    )
