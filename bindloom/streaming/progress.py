"""Live progress from a stream of status events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("complex_id", T.LongType()),
        T.StructField("stage", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("event_id", T.LongType()),
    ]
)


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of status events appended as parquet files."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest(events: DataFrame) -> DataFrame:
    """Newest status per (complex, stage); one state row per pair."""
    newest = F.max_by(F.struct("status", "error"), F.struct("ts", "event_id")).alias("_s")
    return events.groupBy("complex_id", "stage").agg(newest, F.max(F.struct("ts", "event_id")).alias("_at")).select(
        "complex_id", "stage", "_s.status", "_s.error", F.col("_at.ts").alias("ts"), F.col("_at.event_id").alias("event_id")
    )


def start(events: DataFrame, target: str, checkpoint: str, trigger: dict | None = None):
    """Append the changed pairs of every batch to ``target``; the newest row per pair is the state."""

    def save(batch: DataFrame, batch_id: int) -> None:
        # a repeated batch overwrites its own folder, so a retry writes nothing twice
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = latest(events).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def progress_counts(spark: SparkSession, target: str) -> DataFrame:
    """Counts per stage × status from the written updates."""
    updates = spark.read.schema(EVENT_SCHEMA).parquet(target)
    now = updates.groupBy("complex_id", "stage").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    return now.groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n"))
