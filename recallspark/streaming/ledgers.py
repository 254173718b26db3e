"""Roll-ups of append-only ledgers, the same over batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and their value by kind and time window; late ones count up to the watermark."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = out.withWatermark("ts", late) if out.isStreaming else out
    return out.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Sessions of users, closed by a gap without events."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = out.withWatermark("ts", late) if out.isStreaming else out
    return out.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first")).select("user_id", "first", "n")


def append_once(batch: DataFrame, path: str, identity: list[str]) -> None:
    """Appends rows whose identity isn't stored yet; a replayed batch adds nothing."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(identity)
    try:
        stored = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = None
    if stored is not None:
        fresh = fresh.join(stored.select(*identity), identity, "left_anti")
    fresh.write.mode("append").parquet(path)


def first_within(events: DataFrame, keys: list[str], ttl: str) -> DataFrame:
    """The first event of each key within a time to live; keys are forgotten once the watermark passes it.

    Over a batch the state never expires, so each key's first event stays.
    """
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if out.isStreaming:
        return out.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)
    w = Window.partitionBy(*keys).orderBy("ts")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def drained(stream: DataFrame, apply, checkpoint: str, every: str | None = None):
    """Starts a query that hands micro-batches to ``apply(batch, number)``: every so often, or, without
    ``every``, all that there is and then stops. A batch may come again after a failure."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
