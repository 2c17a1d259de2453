"""Session settings, shared scratch space and checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# A table is broadcast only after its row count has been measured at or below this.
BROADCAST_ROWS = 200_000


def local_session(cpus: str = "*", app: str = "barlab", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BARLAB_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can see, as named by the cluster in spark.checkpoint.dir.

    Only a local master may fall back to a folder of its own, because there the driver and
    the executors share one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barlab-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows to the reliable checkpoint folder and cut the lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise a per-group table and hint a broadcast only if it counted small.

    Above the bound the join is left to the adaptive planner (shuffle join, skew splitting).
    """
    stored = materialise(df)
    return F.broadcast(stored) if stored.count() <= max_rows else stored


def map_arrow(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """mapInArrow whose workers find this package where the driver has it (clusters: also pass it by --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = df.sparkSession.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return df.mapInArrow(run, schema)
