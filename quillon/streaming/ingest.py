"""Structured Streaming: facts and snapshots that arrive as files, and event counts with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.sources import schemas


def fact_stream(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """Fact packs appended as JSON lines."""
    return spark.readStream.schema(schemas.FACTS).option("maxFilesPerTrigger", files_a_batch).json(path)


def deduplicated_facts(facts: DataFrame, event_time: str = "_seen", delay: str = "1 hour") -> DataFrame:
    """Each fact of a unit once; state is bounded by the watermark."""
    seen = facts.withColumn(event_time, F.current_timestamp())
    return seen.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["tu_id", "kind", "qualified_name", "type_hash"])


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts of each key by window; late rows within the delay are counted."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def compare_against_baseline(stream: DataFrame, baseline: DataFrame, diff: Callable[[DataFrame, DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch of new rows against a saved baseline; results are appended to target, once a batch."""

    def one(batch: DataFrame, number: int) -> None:
        diff(baseline, batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
