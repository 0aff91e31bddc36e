"""Contracts: schema, rules in one pass, key sets, arithmetic between tables. Problems come back as rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

ERROR, WARNING = "error", "warning"


@dataclass(frozen=True)
class Check:
    """``broken`` marks rows against the rule; a warning is drift, an error refuses publication."""

    name: str
    broken: Column
    severity: str = ERROR


def schema_problems(df: DataFrame, expected: T.StructType) -> list[str]:
    """Missing, unexpected, misplaced and mistyped columns."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in expected}
    out = [f"missing column {n}" for n in want if n not in have] + [f"unexpected column {n}" for n in have if n not in want]
    out += [f"{n} is {have[n].simpleString()}, not {want[n].simpleString()}" for n in want if n in have and have[n] != want[n]]
    return out or ([] if list(have) == list(want) else ["columns are not in the order of the contract"])


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """(check, severity, broken): all rules counted in one pass."""
    one = df.agg(*(F.count_if(F.coalesce(c.broken, F.lit(False))).alias(f"c{i}") for i, c in enumerate(checks)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"), F.col(f"c{i}").alias("broken")) for i, c in enumerate(checks)))))


def refuses(report: DataFrame, strict: bool = False) -> bool:
    """Whether a report holds an error (or, if strict, anything)."""
    bad = report.where("broken > 0") if strict else report.where(f"broken > 0 and severity = '{ERROR}'")
    return bool(bad.limit(1).count())


def key_difference(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """(key, only_in): keys that one side lacks; empty for equal sets. NULL is equal to nothing, so each side lacks the other's.

    One aggregation over both sides: a task holds its keys once, in one map that can spill, and sorts nothing.
    """
    both = a.select(key, F.lit(1).alias("_side")).unionByName(b.select(key, F.lit(2).alias("_side")))
    sides = both.groupBy(key).agg(F.bit_or("_side").alias("_side"))
    left, right = (F.lit(n) for n in names)
    only = F.when(F.col("_side") == 1, F.array(left)).when(F.col("_side") == 2, F.array(right)).when(F.col(key).isNull(), F.array(left, right))
    return sides.select(key, F.explode(only).alias("only_in"))


def untraceable(published: DataFrame, source: DataFrame, key: str) -> DataFrame:
    return published.join(source.select(key).distinct(), key, "left_anti")


def recomputed(published: DataFrame, raw: DataFrame, key: str, value: str, total: Column) -> DataFrame:
    """(key, published, recomputed): values that an independent aggregate of the raw rows contradicts."""
    again = raw.groupBy(key).agg(total.alias("recomputed"))
    both = published.select(key, F.col(value).alias("published")).join(again, key, "full")
    return both.where(~F.col("published").eqNullSafe(F.col("recomputed")))


def balance(source: int, rejected: int, duplicates: int, published: int) -> list[str]:
    return [] if source - rejected - duplicates == published else [f"{source} - {rejected} - {duplicates} is not {published}"]
