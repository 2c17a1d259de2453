"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barlab.session import scratch_path

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it as often as `body` likes."""
    return F.transform(F.array(value), body)[0]


def text_column(name: str = "text") -> Column:
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write rows once as Parquet below spark.checkpoint.dir and read them back."""
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.parquet(path)


def scratch_uri(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below spark.checkpoint.dir as a URI, for files that tasks read and write by pyarrow.fs."""
    folder = scratch_path(spark, purpose)
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def tokenizer_path(name: str) -> str:
    """The place of a vocabulary file: a full path as it is, a bare name in the installed package."""
    if os.path.isabs(name):
        return name
    package = importlib.util.find_spec("public_tokenizers")
    if package is None or package.origin is None:
        raise FileNotFoundError(f"give the full path of {name}")
    return os.path.join(os.path.dirname(package.origin), name)


BATCH_BYTES = 16 << 20


def each_batch(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most `rows` rows and, beyond one row, about BATCH_BYTES, as texts may be long."""
    for batch in batches:
        step = max(1, min(rows, BATCH_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def map_batches(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """mapInArrow whose workers find this package where the driver has it (clusters: also pass it by --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = df.sparkSession.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
