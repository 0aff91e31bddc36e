"""Stable ids and content hashes: equal content gives an equal value whatever the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _glued(parts: tuple[Column, ...]) -> Column:
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def short_id(prefix: str, *parts: Column) -> Column:
    """Prefix and the first 12 hex digits of the sha1 of the parts (NULL as empty)."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(_glued(parts)), 1, 12))


def long_id(prefix: str, *parts: Column) -> Column:
    """Prefix and the first 24 hex digits of the sha256 of the parts (NULL as empty)."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(_glued(parts), 256), 1, 24))


def canonical_json(df: DataFrame) -> Column:
    """All columns as one JSON text with sorted keys; NULLs are written."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"})


def row_digest(*cs: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("<null>")) for c in cs)), 256)


def content_hash(df: DataFrame, digest: Column) -> DataFrame:
    """One row (rows, content_hash): sha256 over the number of rows and the sums of their digests' four quarters.

    Sums don't depend on order and add up inside tasks, so nothing is gathered or sorted; a repeated row counts as often as it is there.
    """
    quarters = [F.conv(F.substring("d", 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = df.select(digest.alias("d")).agg(F.count("*").alias("rows"), *(F.coalesce(F.sum(q), F.lit(0)).cast("string").alias(f"q{i}") for i, q in enumerate(quarters)))
    return sums.select("rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *(f"q{i}" for i in range(4))), 256).alias("content_hash"))
