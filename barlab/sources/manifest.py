"""Nested JSON manifests and CSV cost reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest_entries(
    spark: SparkSession, path: str, schema: str | None = None, one_document: bool = True
) -> DataFrame:
    """The ``entries`` lists of JSON manifests as rows, optionally of one record schema.

    ``one_document``: each file is one (possibly indented) document; otherwise one per line.
    """
    payload = spark.read.option("multiLine", one_document).json(path)
    if "entries" not in payload.columns:
        raise ValueError(f"no entries list in {path}")
    entries = payload.select(F.explode("entries").alias("e")).select("e.*")
    return entries if schema is None else entries.where(F.col("schema") == schema)


def write_manifest(entries: DataFrame, path: str, by: str = "root") -> None:
    """One JSON line per ``by`` value (a root has one entry per record schema)."""
    documents = entries.groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct("schema", *[c for c in entries.columns if c != "schema"]))).alias("entries")
    )
    documents.select("entries").write.mode("overwrite").json(path)


def write_csv_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)


def read_csv_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)
