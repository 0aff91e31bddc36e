"""A retained table of readings that batches are merged into: first wins, a bounded number of days, and a watermark that the next read resumes from.

The table is partitioned by batch and day. A batch writes only rows whose key its days do not hold yet, next to what is there, so nothing is rewritten and a batch
that runs again writes the same rows to the same place. Days before the newest reading less the retention are no longer read, and their folders are dropped.
What a batch saw is observed while it is written: rows, newest time and what became of them go to a sidecar, one line a batch, which names the watermark of the next read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.operators.graph import store
from plinth.sources.rows import TimeWindow, resolve_window

DAYS = 56
_SIDECAR = "batch long, read long, repeats long, late long, unreadable long, written long, watermark timestamp"


@dataclass(frozen=True)
class Retained:
    """A retained table under ``path``; ``keys`` and ``time`` name a reading, and ``order`` decides between readings of one key in a batch."""

    path: str
    keys: tuple[str, ...]
    time: str
    order: tuple[str, ...]
    days: int = DAYS

    def rows(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """The readings of the retained days."""
        newest = self._newest(self.sidecar(spark))
        if newest is None:
            return spark.createDataFrame([], schema)
        # whole folders first, then the day on the edge
        cut = self._cut(newest)
        return self._stored(spark, schema).where((F.col("day") >= F.to_date(cut)) & (F.col(self.time) >= cut)).select(*schema.names)

    def _stored(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        return _read(spark, f"{self.path}/rows", T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("day", T.DateType())]))

    def _newest(self, sidecar: DataFrame) -> int | None:
        """The newest time in microseconds: numbers keep clear of the driver's zone."""
        return sidecar.agg(F.unix_micros(F.max("watermark"))).first()[0]

    def _cut(self, newest: int) -> Column:
        return F.timestamp_micros(F.lit(newest)) - F.make_interval(days=F.lit(self.days))

    def sidecar(self, spark: SparkSession) -> DataFrame:
        """(batch, read, repeats, late, unreadable, written, watermark) of every batch."""
        told = _folders(spark, f"{self.path}/sidecar")
        schema = T.StructType.fromDDL(_SIDECAR)
        return spark.read.schema(schema).parquet(*(p.toString() for p in told)) if told else spark.createDataFrame([], schema)

    def watermark(self, spark: SparkSession) -> datetime | None:
        """The newest time that any batch saw."""
        return self.sidecar(spark).agg(F.max("watermark")).first()[0]

    def window(self, spark: SparkSession, now: datetime) -> TimeWindow:
        """What to read next: from the watermark less the overlap, or the whole baseline at the first time."""
        return resolve_window(now, watermark=self.watermark(spark), days=self.days)

    def merge(self, batch: DataFrame, number: int) -> None:
        """Merges a batch: the function of ``foreachBatch``. A batch of a number that is already there is written again from the batches before it."""
        spark, columns, time = batch.sparkSession, batch.columns, F.col(self.time)
        seen = Observation()
        taken = store(batch.observe(seen, F.count("*").alias("read"), F.max(F.unix_micros(time)).alias("newest"), F.count_if(time.isNull()).alias("unreadable")))
        before = self._newest(self.sidecar(spark).where(F.col("batch") < number))
        newest = max((t for t in (before, seen.get["newest"]) if t is not None), default=None)
        read, unreadable, late, written = seen.get["read"], seen.get["unreadable"], 0, 0
        if newest is not None:
            cut, fate, out = self._cut(newest), Observation(), Observation()
            inside = store(taken.where(time.isNotNull()).observe(fate, F.count_if(time < cut).alias("late")).where(time >= cut).withColumn("day", F.to_date(time)))
            one = inside.groupBy("day", *self.keys).agg(F.min_by(F.struct(*columns), F.struct(*self.order, *sorted(set(columns) - set(self.order)))).alias("r")).select("day", "r.*")
            # of the table only the folders of days that the batch has are read; there are no more of them than are retained
            days = [r.day for r in inside.select("day").distinct().limit(self.days + 2).collect()]
            held = self._stored(spark, batch.schema).where(F.col("day").isin(days) & (F.col("batch") < number)).select("day", *self.keys)
            new = one.join(held, ["day", *self.keys], "left_anti").observe(out, F.count("*").alias("written"))
            new.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/rows/batch={number}")
            late, written = fate.get["late"], out.get["written"]
        counts = [F.lit(n).cast("long").alias(c) for c, n in (("batch", number), ("read", read), ("repeats", read - unreadable - late - written), ("late", late), ("unreadable", unreadable), ("written", written))]
        line = spark.range(1).select(*counts, F.timestamp_micros(F.lit(newest).cast("long")).alias("watermark"))
        line.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sidecar/batch-{number}")
        if newest is not None:
            self.drop_old(spark, newest)

    def drop_old(self, spark: SparkSession, newest: int) -> int:
        """Drops the folders of days that no window reaches any more; their number."""
        oldest = spark.range(1).select(F.to_date(self._cut(newest)).cast("string")).first()[0]
        gone = [d for b in _folders(spark, f"{self.path}/rows") for d in _folders(spark, b.toString()) if d.getName().startswith("day=") and d.getName() < f"day={oldest}"]
        for d in gone:
            d.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(d, True)
        return len(gone)


def run_retained(stream: DataFrame, table: Retained, folder: str) -> DataFrame:
    """All input that is there now, merged into the table; a later call with the same folder goes on where this one ended."""
    stream.writeStream.option("checkpointLocation", folder).foreachBatch(_merger(table)).trigger(availableNow=True).start().awaitTermination()
    return table.rows(stream.sparkSession, stream.schema)


def _merger(table: Retained) -> Callable[[DataFrame, int], None]:
    return lambda batch, number: table.merge(batch, number)


def _folders(spark: SparkSession, path: str) -> Sequence:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _folders(spark, path) else spark.createDataFrame([], schema)
