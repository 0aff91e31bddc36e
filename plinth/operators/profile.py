"""What is in a table: column profiles, histograms, group sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(column, present, nulls, distinct): one pass over the table, then one row a column."""
    names = list(names or df.columns)
    one = df.agg(*(x for i, n in enumerate(names) for x in (F.count(n).alias(f"p{i}"), F.count_if(F.col(n).isNull()).alias(f"n{i}"), F.count_distinct(n).alias(f"d{i}"))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("column"), F.col(f"p{i}").alias("present"), F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("distinct")) for i, n in enumerate(names)))))


def histogram(df: DataFrame, c: str) -> DataFrame:
    """(value, n), NULL as a bucket of its own, most frequent first."""
    return df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("<null>")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def lengths(df: DataFrame, c: str) -> DataFrame:
    """(length, n, leading_zero, not_digits) of an identifier's text."""
    t = F.col(c).cast("string")
    return df.where(t.isNotNull()).groupBy(F.length(t).alias("length")).agg(F.count("*").alias("n"), F.count_if(t.startswith("0")).alias("leading_zero"), F.count_if(~t.rlike("^[0-9]+$")).alias("not_digits"))


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(size, groups): how many keys have how many rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def rows_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys, mean, median, p90 and most rows a key, keys with more than one."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("keys"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.percentile("n", F.lit(0.9)).alias("p90"), F.max("n").alias("most"), F.count_if(F.col("n") > 1).alias("repeated"))


def numeric(df: DataFrame, c: str, low: float, high: float) -> DataFrame:
    """One row: least, greatest, outside of bounds, missing."""
    return df.agg(F.min(c).alias("least"), F.max(c).alias("greatest"), F.count_if(~F.col(c).between(low, high)).alias("outside"), F.count_if(F.col(c).isNull()).alias("missing"))


def imbalance(df: DataFrame, keys: Sequence[str], direction: str, value: str, legs: tuple[str, str] = ("in", "out")) -> DataFrame:
    """(median_imbalance, one_sided): |a-b|/(a+b) over keys, and the share over one half."""
    a, b = (F.sum(F.when(F.col(direction) == leg, F.col(value))) for leg in legs)
    each = df.groupBy(*keys).agg(a.alias("a"), b.alias("b")).where("a + b > 0").select((F.abs(F.col("a") - F.col("b")) / (F.col("a") + F.col("b"))).alias("x"))
    return each.agg(F.percentile("x", F.lit(0.5)).alias("median_imbalance"), F.avg((F.col("x") > 0.5).cast("double")).alias("one_sided"))


def seasonal_ratio(df: DataFrame, keys: Sequence[str], month: Column, value: str, high: int, low: int) -> DataFrame:
    """(keys, ratio): median reading in one month over the median in another."""
    got = df.groupBy(*keys).agg(F.percentile(F.when(month == high, F.col(value)), F.lit(0.5)).alias("h"), F.percentile(F.when(month == low, F.col(value)), F.lit(0.5)).alias("l"))
    return got.where("l > 0 and h is not null").select(*keys, (F.col("h") / F.col("l")).alias("ratio"))


def disagreements(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(field, pairs, larger): groups of two rows, and of more, in which a field has different values; NULL is no value."""
    each = df.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.coalesce(F.min(f) != F.max(f), F.lit(False)).alias(f"_d{i}") for i, f in enumerate(fields)))
    one = each.agg(*(x for i in range(len(fields)) for x in (F.count_if(F.col(f"_d{i}") & (F.col("_n") == 2)).alias(f"p{i}"), F.count_if(F.col(f"_d{i}") & (F.col("_n") > 2)).alias(f"l{i}"))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"p{i}").alias("pairs"), F.col(f"l{i}").alias("larger")) for i, f in enumerate(fields)))))


def odd_coordinates(df: DataFrame, key: str, lat: str, lon: str, box: tuple[float, float, float, float]) -> DataFrame:
    """(key, problem, lat, lon): rows whose coordinates are not both there (``missing``), no numbers (``unparseable``) or out of the box (``outside``), as they were read."""
    a, b = F.expr(f"try_cast(trim(`{lat}`) AS double)"), F.expr(f"try_cast(trim(`{lon}`) AS double)")
    inside = a.between(box[0], box[1]) & b.between(box[2], box[3])
    problem = F.when(F.col(lat).isNull() | F.col(lon).isNull(), "missing").when(a.isNull() | b.isNull(), "unparseable").when(~inside, "outside")
    return df.select(key, problem.alias("problem"), lat, lon).where("problem is not null")
