"""Live tail of an operation log, and touch ingestion, as streams over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "seq bigint, op string, id string, fact string, superseded_by string, at double"


def watch(spark: SparkSession, log_path: str) -> DataFrame:
    """A stream of events: every new operation, as new, superseded, deleted or audit (an update that supersedes nothing)."""
    log = spark.readStream.schema(LOG_SCHEMA).parquet(log_path)
    kind = "case when op = 'delete' then 'deleted' when superseded_by is not null then 'superseded' when op = 'add' then 'new' else 'audit' end"
    return log.withColumn("event", F.expr(kind)).select("seq", "event", "id", "fact", "at")


def touch_counts(touches: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Touches (id, ts) per id and window; later ones than the watermark are dropped."""
    return touches.withWatermark("ts", late).groupBy(F.window("ts", window), "id").agg(F.count("*").alias("touches"), F.max("ts").alias("last"))


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, exactly once over repeated runs."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
