"""Streams: incremental indexing of arriving versions, and event-time windows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.operators.views import newest


def versions(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The arriving file versions as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


#: Parts of an indexed table, by the hash of the path; a batch rewrites those that it touches.
PARTS = 32


def _log(spark: SparkSession, table: str) -> dict[int, int]:
    """The newest version of each part (PARTS at most), by the table's own log."""
    try:
        log = spark.read.parquet(f"{table}/log")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}
    return {r.part: r.v for r in log.groupBy("part").agg(F.max("v").alias("v")).collect()}


def current(spark: SparkSession, table: str, parts: list[int] | None = None) -> DataFrame | None:
    """The rows of an indexed table as they stand (of some parts, if given), or None before the first batch."""
    paths = [f"{table}/data/v={v}/part={p}" for p, v in _log(spark, table).items() if parts is None or p in parts]
    return spark.read.option("basePath", f"{table}/data").parquet(*paths).drop("v") if paths else None


def index_incrementally(stream: DataFrame, table: str, checkpoint: str):
    """Keeps `table` at the newest row of each path.

    A batch is reduced to one row per path, merged with the parts of the table that it touches, written as a new
    version of those parts, and becomes visible by one entry in the table's log. The log, not the stream,
    counts the versions: a stream with a new checkpoint goes on where the table is, and a batch that is run
    again after a failure merges to the same rows."""
    spark = stream.sparkSession

    def upsert(batch: DataFrame, epoch: int) -> None:
        part = F.pmod(F.xxhash64("path"), F.lit(PARTS)).cast("int")
        fresh = newest(batch, ["path"], ["updated_at", "hash"]).withColumn("part", part)
        touched = [r.part for r in fresh.select("part").distinct().collect()]
        if not touched:
            return
        old = current(spark, table, touched)
        if old is not None:
            fresh = newest(old.unionByName(fresh), ["path"], ["updated_at", "hash"])
        version = max(_log(spark, table).values(), default=-1) + 1
        fresh.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{table}/data/v={version}")
        spark.createDataFrame([(p,) for p in touched], "part int").coalesce(1).write.mode("overwrite").parquet(f"{table}/log/v={version}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events, users and value per type and window of event time; works on a stream and on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users"), F.sum("value").alias("value")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "events", "users", F.round("value", 4).alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "events")
