"""Publishing: contract order, GeoJSON rows, partitioned cohorts, stage-validate-swap, no-op by content hash."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COHORT = re.compile(r"[0-9]{4}( and [0-9]{4})?")


def contract_json(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """(json): one object a row, keys in the contract's order, NULLs written."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in order)), {"ignoreNullFields": "false"}).alias("json"))


def features(df: DataFrame, key: str, lon: str, lat: str, properties: Sequence[str]) -> DataFrame:
    """(id, json): a GeoJSON Feature a row."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    return df.select(F.col(key).alias("id"), F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(key).alias("id"), point.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"}).alias("json"))


def write_features(rows: DataFrame, path: str) -> None:
    """Features as lines sorted by id, in ranges: read in file order they are sorted, and no task holds them all."""
    rows.repartitionByRange("id").sortWithinPartitions("id").select("json").write.mode("errorifexists").text(path)


def write_cohorts(df: DataFrame, path: str, column: str) -> None:
    """Partitioned by cohort; labels outside the pattern are refused."""
    bad = [r[0] for r in df.select(column).distinct().where(~F.col(column).rlike(f"^{COHORT.pattern}$") | F.col(column).isNull()).limit(5).collect()]
    if bad:
        raise ValueError(f"cohort labels: {bad}")
    df.write.mode("errorifexists").partitionBy(column).parquet(path)


def cohort_folder(label: str, default: str) -> str:
    """Where a cohort lies below the root: the default one at the root itself, others under ``periods`` by their label with hyphens."""
    if not COHORT.fullmatch(label):
        raise ValueError(f"cohort labels: {[label]}")
    return "" if label == default else f"periods/{label.replace(' ', '-')}/"


def write_periods(tables: dict[str, DataFrame], root: str, column: str, default: str) -> DataFrame:
    """Writes each table (by artifact name) as one folder for each cohort, and returns the manifest (cohort, artifact, path, rows) of what was written; the default cohort is at the root.

    Labels outside the pattern are refused before anything is written, as is a default that is no cohort of every table. All cohorts of a table are written in one pass; their folders are then moved to their places.
    """
    found = {name: df.groupBy(column).agg(F.count("*").alias("n")).limit(1001).collect() for name, df in tables.items()}
    for name, labels in found.items():
        bad = [r[0] for r in labels if r[0] is None or not COHORT.fullmatch(r[0])][:5]
        if bad or len(labels) > 1000 or default not in {r[0] for r in labels}:
            raise ValueError(f"{name}: cohort labels {bad}, {len(labels)} in all, default {default}")
    spark = next(iter(tables.values())).sparkSession
    conf, to_path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name, df in tables.items():
        stage = to_path(f"{root}/stage-{uuid.uuid4().hex}")
        fs = stage.getFileSystem(conf)
        df.withColumn("_cohort", F.regexp_replace(column, " ", "-")).write.partitionBy("_cohort").parquet(stage.toString())
        for r in found[name]:
            source, target = to_path(f"{stage.toString()}/_cohort={r[0].replace(' ', '-')}"), to_path(f"{root}/{cohort_folder(r[0], default)}{name}")
            fs.mkdirs(target.getParent())
            if fs.exists(target) or not fs.rename(source, target):
                raise OSError(f"can't write {target.toString()}")
        fs.delete(stage, True)
    rows = [(r[0], name, f"{cohort_folder(r[0], default)}{name}", r[1]) for name, labels in found.items() for r in labels]
    return spark.createDataFrame(rows, "cohort string, artifact string, path string, rows long")


def write_reported(df: DataFrame, path: str, counters: dict[str, Column], extremes: dict[str, Column] | None = None) -> DataFrame:
    """Writes ``df`` and counts it while it is written: (counter, n) with ``rows`` first and every counter, zeros too; ``extremes`` are greatest values, as text under their names.

    Nothing is read a second time. A NULL condition doesn't count.
    """
    seen = Observation()
    marks = [F.count("*").alias("rows"), *(F.count_if(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in counters.items())]
    df.observe(seen, *marks, *(F.max(v).cast("string").alias(name) for name, v in (extremes or {}).items())).write.mode("errorifexists").parquet(path)
    rows = [(name, int(seen.get.get(name) or 0), None) for name in ("rows", *counters)] + [(name, None, seen.get.get(name)) for name in extremes or {}]
    return df.sparkSession.createDataFrame(rows, "counter string, n long, value string")


def publish(spark: SparkSession, df: DataFrame, path: str, problems: Callable[[DataFrame], Sequence[str]], digest: str, previous_digest: str | None = None) -> str:
    """Stage, validate what was staged, then swap by rename with the old table as backup. Returns published or unchanged.

    Nothing is written if the digest is the previous one; a refused or failed run leaves the published table as it was.
    """
    if previous_digest == digest:
        return "unchanged"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to_path = jvm.org.apache.hadoop.fs.Path
    target, stage, backup = to_path(path), to_path(f"{path}.stage-{uuid.uuid4().hex}"), to_path(f"{path}.backup")
    fs = target.getFileSystem(conf)
    try:
        df.write.parquet(stage.toString())
        if found := list(problems(spark.read.parquet(stage.toString()))):
            raise ValueError("; ".join(found))
        had = fs.exists(target)
        if had:
            fs.delete(backup, True)
            if not fs.rename(target, backup):
                raise OSError(f"can't move {path}")
        if not fs.rename(stage, target):
            if had:
                fs.rename(backup, target)
            raise OSError(f"can't publish {path}")
        fs.delete(backup, True)
        return "published"
    finally:
        fs.delete(stage, True)


def size_of(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def within_size(spark: SparkSession, path: str, most: int) -> None:
    if (n := size_of(spark, path)) > most:
        raise ValueError(f"{path}: {n} bytes, {most} allowed")
