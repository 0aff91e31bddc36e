"""Shared helpers for jobs of several passes: cut lineage, broadcast behind a size check."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.operators.graph import components, shared_folder, store

__all__ = ["anti", "attach", "components", "cut", "merged_ranges", "partitions", "semi", "shared_folder", "small_batches", "store", "with_doc_key"]

#: Ids that a broadcast may carry (8 bytes each); larger sides are joined by a shuffle.
BROADCAST_IDS = 1_000_000

#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python a thousand rows and a few MB at a time: they can be long, and a batch is held by the executor and by its worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept as a table in the shared folder, so that a lost executor loses nothing and sizes are real."""
    return store(df)


def semi(df: DataFrame, keys: DataFrame, on: str, size: int | None = None) -> DataFrame:
    """Left semi join that broadcasts ``keys`` only when their counted number is at most BROADCAST_IDS."""
    n = keys.count() if size is None else size
    return df.join(F.broadcast(keys) if n <= BROADCAST_IDS else keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of ``df`` without those whose ``on`` is in ``keys`` (computed once), which is broadcast only behind its count."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, on, "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))


def partitions(spark: SparkSession) -> int:
    with contextlib.suppress(ValueError, TypeError):
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return 200


def with_doc_key(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with ``copy``, a hash of the text: two texts under one doc_id stay apart, repeated rows are one document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")


def attach(docs: DataFrame, found: DataFrame, on: list[str], entries: int) -> DataFrame:
    """Left join of what was found for some documents: ``found`` is broadcast when its counted entries are few, and the texts stay where they are."""
    return docs.join(F.broadcast(found) if entries <= BROADCAST_IDS else found, on, "left")


def merged_ranges(ranges: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): the fewest ranges that cover the same as the rows (keys, start, stop), in order, as an array of (start, stop)."""
    order = Window.partitionBy(*keys).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = ranges.select(*keys, "start", "stop", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int").alias("_new"))
    numbered = new.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(name))
