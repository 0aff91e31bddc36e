"""Row rules with precedence: every code a row breaks, its primary code, and the split into kept and rejected."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``broken`` holds for a row that breaks the rule; a NULL condition is not broken."""

    code: str
    broken: Column
    detail: Column | None = None


def with_codes(df: DataFrame, rules: Sequence[Rule], codes: str = "codes") -> DataFrame:
    """``codes``: what the row breaks, in order of precedence. One projection, whatever the number of rules."""
    return df.withColumn(codes, F.array_compact(F.array(*(F.when(r.broken, r.code) for r in rules)))) if rules else df.withColumn(codes, F.array().cast("array<string>"))


def split(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected); the rejected have ``code`` (primary), ``codes`` and ``detail`` of the primary rule."""
    marked = with_codes(df, rules)
    detail = F.lit(None).cast("string")
    for r in reversed(rules):
        if r.detail is not None:
            detail = F.when(F.col("code") == r.code, F.concat(F.lit(f"{r.code}: "), F.coalesce(r.detail.cast("string"), F.lit("<null>")))).otherwise(detail)
    kept = marked.where(F.size("codes") == 0).drop("codes")
    return kept, marked.where(F.size("codes") > 0).withColumn("code", F.col("codes")[0]).withColumn("detail", F.coalesce(detail, F.col("code")))


def report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(code, primary, also): rows of which a code is the primary one, and of which it is a further one; every code has a row."""
    marked = with_codes(df, rules).where(F.size("codes") > 0).select(F.posexplode("codes").alias("k", "code"))
    got = marked.groupBy("code").agg(F.count_if(F.col("k") == 0).alias("primary"), F.count_if(F.col("k") > 0).alias("also"))
    vocabulary = df.sparkSession.createDataFrame([(r.code,) for r in rules], "code string")
    return vocabulary.join(got, "code", "left").na.fill(0, ["primary", "also"])


def tally(df: DataFrame, conditions: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """How many rows there are and each condition holds for: one row, or one for each value of ``by``."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()))
