"""Session helpers: the shared folder that cuts lineage, and a session for tests and benches."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, named in spark.checkpoint.dir; only on one machine
    (a local master), where it is unset, a temporary folder is made."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="codelode-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared checkpoint folder and reads it from there, so that the loss
    of an executor costs no recomputation of earlier rounds."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows that may be broadcast.
MOST_BROADCAST = 1_000_000


def bounded(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Marks `df` for broadcast if it has at most so many rows; else joins shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def local_session(cores: str | int = "*", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codelode")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
