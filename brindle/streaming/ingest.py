"""Streaming ingestion: files that land are normalized and upserted; windowed counts of events.

Each micro-batch is idempotent: an upsert by deterministic id writes the same rows again after a
replay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.sources.store import Store


def stream_upsert(spark: SparkSession, landing: str, schema: str, store: Store, table: str, keys: list[str], checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df, files_per_batch: int = 1000, fmt: str = "parquet") -> StreamingQuery:
    """Everything in the landing folder into the table, then stop; a later call goes on from there."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(landing)
    return rows.writeStream.foreachBatch(lambda df, _: store.upsert(table, shape(df), keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, every: str, late: str, *keys: str) -> DataFrame:
    """Counts by tumbling window; rows later than `late` are dropped by the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, every), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def deduplicated(events: DataFrame, at: str, late: str, *keys: str) -> DataFrame:
    """One row per key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def sessions(events: DataFrame, at: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Runs of events of a key without a pause of `gap`."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")
