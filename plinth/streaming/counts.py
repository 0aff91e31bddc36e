"""Counter streams: overlap re-reads dropped within a watermark, 15-minute grids, per-key freshness."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def deduplicated(stream: DataFrame, keys: Sequence[str], time: str, late: str = "30 minutes") -> DataFrame:
    """First of each key within the watermark; state older than it is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def grid(stream: DataFrame, keys: Sequence[str], time: str, value: str, slot: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """(keys, slot, n, total): tumbling slots; emitted once the watermark has passed them."""
    marked = stream if stream.isStreaming and time in _watermarked(stream) else stream.withWatermark(time, late)
    return marked.groupBy(*keys, F.window(time, slot)).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*keys, F.col("window.start").alias("slot"), "n", "total")


def _watermarked(stream: DataFrame) -> set[str]:
    return {f.name for f in stream.schema.fields if "spark.watermarkDelayMs" in (f.metadata or {})}


def run_available(out: DataFrame, folder: str) -> DataFrame:
    """All input that is there now, appended to a Parquet table under ``folder``: a window is written once, when the watermark has passed it, and its state is dropped.

    A later call with the same folder goes on where this one ended.
    """
    writer = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows")
    writer.trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{folder}/rows")


def upsert_latest(path: str, keys: Sequence[str], time: str):
    """A foreachBatch function: merges a batch into the newest row of each key. Two generations are kept under ``path``; a batch that is run again reads what it read before."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*batch.columns)
        if number > 0:
            new = new.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/{(number - 1) % 2}"))
        rest = [c for c in batch.columns if c not in keys]
        merged = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, *(c for c in sorted(rest) if c != time))).alias("_r")).select(*keys, "_r.*")
        merged.write.mode("overwrite").parquet(f"{path}/{number % 2}")
        spark.range(number, number + 1).write.mode("overwrite").parquet(f"{path}/last-{number % 2}")

    return run


def latest_of(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest rows after the last batch (an empty table before the first)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    told = [f"{path}/last-{k}" for k in (0, 1) if fs.exists(p.suffix(f"/last-{k}/_SUCCESS"))]
    last = spark.read.schema("id long").parquet(*told).agg(F.max("id")).first()[0] if told else None
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{path}/{last % 2}")


def fault_state(daily: DataFrame, key: str = "key", day: str = "day", total: str = "total") -> DataFrame:
    """(key, day, fault_days) after each batch of a stream of daily totals: how many of the newest days had readings and none that is not zero.

    A key's state is its last day and its run. A day with a total above zero, or without any reading (NULL), ends the run; days that come after a later one are late and ignored.
    """
    kind = daily.schema[key].dataType.simpleString()

    def step(name, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, run = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(day, kind="stable").drop_duplicates(day)
        rows = rows if last is None else rows[rows[day] > last]
        if len(rows):
            ends = np.flatnonzero((rows[total].isna() | (rows[total] != 0)).to_numpy())
            last, run = rows[day].iloc[-1], len(rows) - 1 - int(ends[-1]) if len(ends) else run + len(rows)
        state.update((last, run))
        yield pd.DataFrame({key: [name[0]], day: [last], "fault_days": [run]})

    return daily.select(key, day, total).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{day}` date, fault_days long", f"`{day}` date, run long", "update", GroupStateTimeout.NoTimeout)


def run_updates(out: DataFrame, folder: str, keys: Sequence[str], time: str) -> DataFrame:
    """All input that is there now, in update mode, into the newest row of each key under ``folder``; a later call goes on where this one ended."""
    query = out.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(upsert_latest(f"{folder}/latest", keys, time)).trigger(availableNow=True).start()
    query.awaitTermination()
    return latest_of(out.sparkSession, f"{folder}/latest", out.schema)
