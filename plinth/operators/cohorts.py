"""Reports by cohort and area: sparse matrices, coverage, shares, drift, lossless partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def area_cells(df: DataFrame, area: Sequence[str], cell: Sequence[str], mappable: Column) -> DataFrame:
    """(area, cell, n, mappable): one row a cell that has reports; unknown values are cells of their own."""
    return df.groupBy(*area, *cell).agg(F.count("*").alias("n"), F.count_if(mappable).alias("mappable"))


def area_matrix(cells: DataFrame, area: Sequence[str], cell: Sequence[str]) -> DataFrame:
    """(area, total, mappable, counts): the cells of each area as a sorted array of structs."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in cell]
    return cells.groupBy(*area).agg(F.sum("n").alias("total"), F.sum("mappable").alias("mappable"), F.array_sort(F.collect_list(F.struct(*key, "n", F.col("mappable")))).alias("counts"))


def coverage(df: DataFrame, cohort: str, status: str, known_area: Column, mappable: Column, statuses: Sequence[str] = ("vacant", "nonVacant", "unknown"), negative: str = "nonVacant") -> DataFrame:
    """One row a cohort: reports by status, mappable ones, unknown areas, and whether a share can be given (someone reported the negative)."""
    got = df.groupBy(cohort).agg(F.count("*").alias("rows"), *(F.count_if(F.col(status) == s).alias(s) for s in statuses), F.count_if(mappable).alias("mappable"), F.count_if(~F.coalesce(known_area, F.lit(False))).alias("unknown_area"))
    return got.withColumn("share_supported", F.col(negative) > 0)


def share(cells: DataFrame, area: Sequence[str], status: str, cohorts: DataFrame, cohort: str, positive: str = "vacant", negative: str = "nonVacant") -> DataFrame:
    """(area, positive_n, negative_n, share): percent with one decimal, only for cohorts that support it."""
    got = cells.groupBy(*area).agg(F.sum(F.when(F.col(status) == positive, F.col("n")).otherwise(0)).alias("positive_n"), F.sum(F.when(F.col(status) == negative, F.col("n")).otherwise(0)).alias("negative_n"))
    both = F.col("positive_n") + F.col("negative_n")
    return got.join(cohorts.select(cohort, "share_supported"), cohort, "left").withColumn("share", F.when(F.col("share_supported") & (both > 0), F.round(100.0 * F.col("positive_n") / both, 1))).drop("share_supported")


def with_boundaries(areas: DataFrame, boundaries: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join: an area without a boundary (or with a NULL key) keeps its own row."""
    return areas.join(boundaries.withColumn("has_boundary", F.lit(True)), list(on), "left").na.fill(False, ["has_boundary"])


def exact_mean(c: str, places: int = 7) -> Column:
    """A mean that does not depend on the order of rows: summed as decimals."""
    return F.round(F.sum(F.col(c).cast(f"decimal(20,{places})")).cast("double") / F.count(c), places)


def drift(previous: DataFrame, current: DataFrame, cohort: str, fields: Sequence[str], share: float = 0.05) -> DataFrame:
    """(cohort, field, old, new, problem): fields that changed by more than ``share``, and cohorts that are gone. New cohorts are no problem."""
    old = previous.select(cohort, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("long").alias("old")) for f in fields))).alias("x")).select(cohort, "x.*")
    new = current.select(F.col(cohort), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("long").alias("new")) for f in fields))).alias("x")).select(cohort, "x.*")
    both = old.join(new, [cohort, "field"], "left")
    gone, moved = F.col("new").isNull(), (F.col("old") != 0) & (F.abs(F.col("new") - F.col("old")) > share * F.col("old"))
    return both.withColumn("problem", F.when(gone, "removed").when(moved, "changed")).where("problem is not null")


def lost_rows(whole: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    """Rows that a set of partitions loses or adds, as bags; empty for a lossless partition."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return whole.exceptAll(union).withColumn("where", F.lit("lost")).unionByName(union.exceptAll(whole).withColumn("where", F.lit("added")))


def siblings(areas: DataFrame, key: str, on: Sequence[str]) -> DataFrame:
    """(key, sibling): other areas with the same ``on``."""
    other = areas.select(F.col(key).alias("sibling"), *on)
    return areas.select(key, *on).join(other, list(on)).where(F.col(key) != F.col("sibling")).select(key, "sibling")
