"""Reading: all-string row arrays, bounded windows with pushed-down filters, budgets and integrity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a window goes back by.
LATEST_HOURS, OVERLAP_MINUTES, BASELINE_DAYS = 24, 30, 56


def string_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def json_rows(spark: SparkSession, path: str, names: Sequence[str], strict: bool = True) -> DataFrame:
    """A JSON array of objects, every scalar as text; an absent key is NULL, and an object of absent keys is a row.

    Strict: a file that is not an array, or an element that is not an object, fails the job; else such files and elements are dropped, and only they. A file is
    parsed by one task; land large ones as many files.
    """
    items = F.from_json("value", "array<string>")
    if strict:
        items = F.when(F.ltrim("value").startswith("[") & items.isNotNull(), items).otherwise(F.raise_error(F.lit("not a JSON array")))
    each = spark.read.text(path, wholetext=True).where(F.lit(True) if strict else F.ltrim("value").startswith("[")).select(F.explode(items).alias("item"))
    whole = F.ltrim("item").startswith("{")
    row = F.from_json("item", string_schema(names))
    if strict:
        row = F.when(whole, row).otherwise(F.raise_error(F.lit("not a JSON object")))
    return (each if strict else each.where(whole)).select(row.alias("r")).select("r.*")


def canonical_order(df: DataFrame, time: str, key: str) -> DataFrame:
    """Snapshot order: by time, then key, then everything else, so that equal snapshots are equal files."""
    rest = [c for c in sorted(df.columns) if c not in (time, key)]
    return df.orderBy(time, key, *rest)


def adopted(spark: SparkSession, path: str, names: Sequence[str], expected_sha256: str | None = None) -> DataFrame:
    """Rows of a snapshot that is there already; refused if its one file's digest is not the one announced."""
    if expected_sha256 is not None:
        found = [r.sha256 for r in file_digests(spark, path).select("sha256").limit(2).collect()]
        if found != [expected_sha256]:
            raise ValueError(f"{path} is not the announced snapshot")
    return json_rows(spark, path, names)


@dataclass(frozen=True)
class TimeWindow:
    start: datetime
    end: datetime
    why: str

    def __post_init__(self):
        if self.start is None or self.end is None or self.start >= self.end:
            raise ValueError("a window needs a start before its end")


def resolve_window(now: datetime, since: datetime | None = None, latest: bool = False, watermark: datetime | None = None, days: int = BASELINE_DAYS) -> TimeWindow:
    """Always bounded: the latest day, or since a time, or from the watermark less an overlap, or the first run's whole baseline."""
    if latest:
        return TimeWindow(now - timedelta(hours=LATEST_HOURS), now, "latest")
    if since is not None:
        return TimeWindow(since, now, "since")
    if watermark is not None:
        return TimeWindow(watermark - timedelta(minutes=OVERLAP_MINUTES), now, "incremental")
    if days <= 0:
        raise ValueError("the baseline window must be positive")
    return TimeWindow(now - timedelta(days=days), now, "first run")


def window_scan(df: DataFrame, time: str, window: TimeWindow, columns: Sequence[str], equals: dict[str, str]) -> DataFrame:
    """Only the columns and rows of a window: both reach the Parquet scan. Needs at least one equality, so that a scan is never open."""
    if not equals:
        raise ValueError("an open scan is refused")
    got = df.where((F.col(time) >= F.lit(window.start)) & (F.col(time) < F.lit(window.end)))
    for c, v in equals.items():
        got = got.where(F.col(c) == v)
    return got.select(*columns)


def within_budget(df: DataFrame, most: int) -> DataFrame:
    """``df``, refused if it has more than ``most`` rows (counting stops there)."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


def reconciled(df: DataFrame, expected: int) -> DataFrame:
    n = df.count()
    if n != expected:
        raise ValueError(f"{n} rows read, {expected} announced")
    return df


def extent_by_key(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """(key, rows, total, first, last): a whole history's extent as one partial aggregate."""
    return df.groupBy(key).agg(F.count("*").alias("rows"), F.sum(value).alias("total"), F.min(time).alias("first"), F.max(time).alias("last"))


def pruned(df: DataFrame, time: str, keep_from: datetime) -> DataFrame:
    return df.where(F.col(time) >= F.lit(keep_from))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file, read by tasks."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def cohort(spark: SparkSession, path: str, column: str, label: str) -> DataFrame:
    """One cohort of a partitioned table: the filter prunes its folder."""
    return spark.read.parquet(path).where(F.col(column) == label)
