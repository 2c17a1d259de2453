"""The prediction/outcome log fed by new feature files (Structured Streaming, available-now)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from barlab.sources.eventlog import append_unique_events, events_in_range

# Reads the log's events in the time range of a table.
Logged = Callable[[DataFrame, StructType], DataFrame]


def follow_features(
    spark: SparkSession,
    source: str,
    schema: StructType,
    log: str,
    checkpoint: str,
    to_events: Callable[[DataFrame, Logged], Iterable[DataFrame]],
    max_files: int = 1_000,
) -> None:
    """Process every feature file not seen yet, then stop.

    ``to_events`` turns one micro-batch into event batches, one after the other; its second argument
    reads the log as it is at that moment, for the time range of a table. Outcomes can thus be joined with
    the predictions that were logged, also by earlier batches, rather than with new ones. A batch that
    is replayed after a failure appends nothing, because the log refuses known keys.
    """

    def process(batch: DataFrame, _: int) -> None:
        def logged(rows: DataFrame, fields: StructType) -> DataFrame:
            return events_in_range(rows, log, fields)

        for events in to_events(batch, logged):
            append_unique_events(events, log)

    (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .option("recursiveFileLookup", True)
        .parquet(source)
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
