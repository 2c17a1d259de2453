"""Append-only Parquet log of prediction and outcome events, by month, for several writers at once."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from barlab.operators.prospective import LOG_KEY, duplicate_keys
from barlab.operators.stability import require_empty
from barlab.session import materialise
from barlab.sources.commits import Commits

MONTH = "event_month"
ATTEMPTS = 20


def _read(spark: SparkSession, folders: list[str], path: str, schema: StructType) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema).withColumn(MONTH, F.lit(None).cast("date"))
    dated = StructType([*schema.fields, StructField(MONTH, DateType())])
    return spark.read.schema(dated).option("basePath", f"{path.rstrip('/')}/parts").parquet(*folders)


def _between(log: DataFrame, first: datetime, last: datetime) -> DataFrame:
    """Only the months of the range are opened."""
    months = F.col(MONTH).between(F.trunc(F.lit(first), "month"), F.trunc(F.lit(last), "month"))
    return log.where(months & F.col("ts").between(F.lit(first), F.lit(last)))


def read_event_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All committed events; an empty table if nothing was ever logged."""
    _, record = Commits(spark, path).latest()
    return _read(spark, record.get("folders", []), path, schema).select(schema.names)


def sorted_event_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return read_event_log(spark, path, schema).orderBy(*LOG_KEY)


def events_in_range(rows: DataFrame, path: str, schema: StructType) -> DataFrame:
    """The logged events in the time range of ``rows``; none if nothing was logged or ``rows`` is empty."""
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    spark = rows.sparkSession
    _, record = Commits(spark, path).latest()
    log = _read(spark, record.get("folders", []), path, schema)
    return (log.limit(0) if first is None else _between(log, first, last)).select(schema.names)


def append_unique_events(events: DataFrame, path: str, attempts: int = ATTEMPTS) -> int:
    """Append the events whose key is not logged yet; existing parts are never touched.

    A batch that repeats a key is refused. Only the log's key columns in the months of the batch are read. The new events
    are written by month and then committed; if another writer has committed meanwhile, keys are looked up again in
    what it logged and the rest is tried anew, so every key is logged once. Running the same batch again appends nothing.
    """
    batch = materialise(events)
    require_empty(duplicate_keys(batch, LOG_KEY), "event batch repeats a key")
    first, last, rows = batch.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    if first is None:
        return 0
    spark, commits, known = events.sparkSession, Commits(spark=events.sparkSession, path=path), set()
    for _ in range(attempts):
        number, record = commits.latest()
        folders = record.get("folders", [])
        newer = [f for f in folders if f not in known]
        if newer:
            logged = _between(_read(spark, newer, path, events.schema), first, last)
            batch = materialise(batch.join(logged.select(*LOG_KEY), list(LOG_KEY), "left_anti"))
            known.update(newer)
            rows = batch.count()
        if not rows:
            return 0
        folder = commits.new_folder(number + 1)
        dated = batch.withColumn(MONTH, F.trunc("ts", "month"))
        dated.hint("rebalance", MONTH).write.option("compression", "zstd").partitionBy(MONTH).parquet(folder)
        if commits.commit(number + 1, {"folders": [*folders, folder], "events": record.get("events", 0) + rows}):
            return rows
        commits.discard(folder)
    raise RuntimeError(f"other writers committed to {path} {attempts} times meanwhile")


def log_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("model_id", "event_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.countDistinct("root").alias("roots"),
    )
