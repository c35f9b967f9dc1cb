"""Stream pipes: routed file streams, deduplication, windows, batches and forks."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def routed(spark: SparkSession, folder: str, schema: str, routes: dict[str, str], kind: str = "json", files_per_batch: int = 100) -> dict[str, DataFrame]:
    """A stream per route: files below ``folder`` whose path matches the route's glob, a batch for each few files."""
    return {name: spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).format(kind).load(folder) for name, glob in routes.items()}


def once_within(stream: DataFrame, at: str, lateness: str, *keys: str) -> DataFrame:
    """Rows whose keys haven't been seen within the watermark; state older than it is dropped."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(list(keys))


def tumbling(stream: DataFrame, at: str, width: str, lateness: str, by: list[str], *aggs: Column) -> DataFrame:
    """Aggregates per window of event time; a window is final when the watermark has passed it."""
    return stream.withWatermark(at, lateness).groupBy(F.window(at, width).alias("w"), *by).agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "*").drop("w")


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> list[dict]:
    """Run what there is through ``each`` batch by batch; offsets in ``checkpoint`` make a later call go on after it.

    Returns the progress of the batches: ``batchId``, ``numInputRows``, ``processedRowsPerSecond`` and more.
    """
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    query.awaitTermination()
    return [json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else p for p in query.recentProgress]


def fork(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One batch to several sinks; it is kept while they run, so it is computed once. A failing sink fails the batch."""

    def run(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for s in sinks:
                s(kept, number)
        finally:
            kept.unpersist()

    return run


def latest_state(stream: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The newest value of each key so far, kept as state (update mode)."""
    return stream.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order), F.min(order).alias("first"))
