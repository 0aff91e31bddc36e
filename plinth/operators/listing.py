"""What a map view asks: filtered, bounded, sorted rows with counts, facets and extent."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.geo import box_filter, haversine_miles, in_box

ALL = "all"


@dataclass(frozen=True)
class Query:
    """A view's question. ``filters`` by column (``all`` is no filter), ``box`` (lat from, lat to, lon from, lon to), ``origin`` (lat, lon)."""

    filters: dict[str, str] = field(default_factory=dict)
    box: tuple[float, float, float, float] | None = None
    origin: tuple[float, float] | None = None
    sort: str = "name"
    limit: int = 50


def matches(filters: dict[str, str], vocabulary: dict[str, Sequence[str]] | None = None, any_case: Sequence[str] = ("borough",)) -> Column | None:
    """The condition of the filters; a value outside its vocabulary counts as ``all``; None if nothing is filtered, so that no predicate reaches the plan.

    Equality is bare, so it reaches the scan; only the columns ``any_case`` are compared without case.
    """
    out = None
    for c, v in filters.items():
        if v == ALL or (vocabulary and v not in vocabulary.get(c, (v,))):
            continue
        cond = F.lower(F.col(c)) == v.lower() if c in any_case else F.col(c) == v
        out = cond if out is None else out & cond
    return out


def rows(df: DataFrame, query: Query, key: str, orders: dict[str, Sequence[Column]], vocabulary: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """The first ``limit`` rows in view. ``orders`` gives each sort's columns; ``key`` always comes last, so the order is total."""
    got = df
    if (cond := matches(query.filters, vocabulary)) is not None:
        got = got.where(cond)
    if query.box is not None:
        got = got.where(box_filter(F.col("lat"), F.col("lon"), query.box))
    if query.origin is not None:
        got = got.withColumn("miles", haversine_miles(F.lit(query.origin[0]), F.lit(query.origin[1]), F.col("lat"), F.col("lon")))
    elif query.sort == "nearby":
        return got.limit(0)
    return got.orderBy(*orders[query.sort], F.col(key)).limit(query.limit)


def counts(df: DataFrame, query: Query, vocabulary: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """One row: matches in view, matches anywhere, and all rows, in one pass."""
    cond = matches(query.filters, vocabulary)
    cond = F.lit(True) if cond is None else F.coalesce(cond, F.lit(False))
    view = cond & in_box(F.col("lat"), F.col("lon"), query.box)
    return df.agg(F.count_if(view).alias("in_view"), F.count_if(cond).alias("matching"), F.count("*").alias("all_rows"))


def facets(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) for every pair, each value with the other left open, and all: one shuffle of grouping sets."""
    label = lambda c: F.when(F.grouping(c) == 1, ALL).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("<null>"))).alias(c)
    return df.cube(a, b).agg(F.count("*").alias("n"), label(a).alias("_a"), label(b).alias("_b")).select(F.col("_a").alias(a), F.col("_b").alias(b), "n")


def zero_filled(got: DataFrame, column: str, vocabulary: Sequence[str], n: str = "n") -> DataFrame:
    """Every value of a vocabulary with its count, zero if there is none."""
    known = got.sparkSession.createDataFrame([(v,) for v in vocabulary], f"{column} string")
    return known.join(got, column, "left").na.fill(0, [n])


def one_index(**kinds: DataFrame) -> DataFrame:
    """Rows of several kinds as one table with ``kind`` and ``kind_order``; columns that a kind lacks are NULL."""
    out = None
    for i, (kind, df) in enumerate(kinds.items()):
        part = df.withColumn("kind", F.lit(kind)).withColumn("kind_order", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def by_zoom(points: DataFrame, areas: DataFrame, zoom: float, status: str, detail_zoom: float = 15, wanted: str = "vacant") -> DataFrame:
    """Single reports when zoomed in on the wanted status, else areas that have any."""
    return points if zoom >= detail_zoom and status == wanted else areas.where("n > 0")


def most_surveyed(total: str = "total", years: str = "years_measured") -> list[Column]:
    """The order of counts: largest total first, sites without one last, then the more years; the key comes after."""
    return [F.desc_nulls_last(total), F.desc_nulls_last(years)]


def detail(df: DataFrame, key: str, value: str, query: Query | None = None, pattern: str | None = None, longest: int = 64) -> DataFrame:
    """The row of an id, none if it is unknown or filtered out. An id that is too long or not of the ``pattern`` is not looked for."""
    if pattern is not None and (len(value) > longest or not re.fullmatch(pattern, value)):
        return df.limit(0)
    cond = matches(query.filters) if query else None
    got = df.where(F.col(key) == value)
    return got if cond is None else got.where(cond)
