"""Streaming ingest: every micro-batch becomes one run, once; what it rejects is kept beside it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.validate import split
from ..operators.store import KVStore


def rejects_dir(store: KVStore, name: str) -> str:
    return os.path.join(store.root, "rejects", name)


def rejected(store: KVStore, name: str) -> DataFrame:
    """(key, value, deleted, reason, batch_id): the writes that a stream's batches have rejected so far."""
    schema = "key binary, value binary, deleted boolean, reason string, batch_id long"
    path = rejects_dir(store, name)
    return store.spark.read.schema(schema).parquet("file://" + path) if os.path.isdir(path) else store.spark.createDataFrame([], schema)


def ingest(writes: DataFrame, store: KVStore, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start writing a stream of (key, value, deleted[, seq]) into the store.

    The number of the last batch taken is in the same manifest that publishes its run, so a batch
    that is tried again after a failure is stored once. Writes that break a size rule go to a table of
    their own, see rejected(), before the batch is stored: a batch that is tried again replaces them.
    They are counted in the store's metrics.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        if store.manifests.load().batches.get(name, -1) >= batch_id:
            return
        seen = Observation()
        _, bad = split(batch.withColumn("key", F.col("key").cast("binary")).withColumn("value", F.col("value").cast("binary")))
        bad = bad.select("key", "value", "deleted", "reason").observe(seen, F.count("*").alias("n"))
        bad.write.mode("overwrite").parquet("file://" + os.path.join(rejects_dir(store, name), f"batch_id={batch_id}"))
        store.apply_many(batch, on_reject="route", query=name, batch_id=batch_id)
        store.metrics.rejected += seen.get["n"]

    return writes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).queryName(name).trigger(**trigger).start()
