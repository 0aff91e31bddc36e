"""What is published of a counter: fault override, suppression, the latest view and its check; tallies of surveys; filters of reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.parse import half_up
from plinth.operators import counters

#: Whether construction was reported, by the filter's name; "any" and unknown names filter nothing.
CONSTRUCTION = {"reported": True, "notReported": False, "unknown": None}


def with_faults(state: Column, zero_days: Column) -> Column:
    """A fresh counter that has reported nothing but zeros for FAULT_DAYS days is faulted; any other state stays."""
    return F.when((state == "fresh") & (zero_days >= counters.FAULT_DAYS), "faulted").otherwise(state)


def published(df: DataFrame) -> DataFrame:
    """Published numbers of counters. ``df`` has id, hours (age of the newest reading known), zero_days, reading, observed_at, samples, median and rank.

    Adds staleness, active, count, observedAt, expected, percentile, ratio and activity. Offline and unavailable counters, and those without a reading,
    publish no number at all; a faulted one keeps its numbers but is not active. Below LEAST_SAMPLES there is no baseline.
    """
    state = with_faults(counters.staleness(F.col("hours")), F.col("zero_days"))
    got = df.withColumn("staleness", state).withColumn("active", state == "fresh")
    live = ~F.col("staleness").isin("offline", "unavailable") & F.col("reading").isNotNull()
    based = live & (F.col("samples") >= counters.LEAST_SAMPLES)
    expected, rank = F.when(based, F.col("median")), F.when(based, F.col("rank"))
    return got.select(
        *df.columns, "staleness", "active", F.when(live, F.col("reading")).alias("count"), F.when(live, F.col("observed_at")).alias("observedAt"), expected.alias("expected"),
        half_up(rank).alias("percentile"), F.when(live, counters.ratio(F.col("reading"), expected)).alias("ratio"),
        F.when(live, counters.activity(rank, expected, F.col("reading"), F.col("samples"))).otherwise("unavailable").alias("activity"),
    )


def latest_view(df: DataFrame, columns: Sequence[str], newest: str) -> tuple[DataFrame, DataFrame]:
    """(rows, summary): the columns of the view, and one row with its size and the newest time of all."""
    return df.select(*columns), df.agg(F.count("*").alias("sensors"), F.max(newest).alias("latestObservation"))


def latest_problems(latest: DataFrame, sensors: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, problem): rows of the view whose id is not published, published ids without a row, and fields that differ; empty for a true view."""
    a, b = latest.select(F.col(key), F.struct(*fields).alias("seen")), sensors.select(F.col(key), F.struct(*fields).alias("known"))
    both = a.join(b, key, "full")
    differs = [F.when(~F.col(f"seen.{f}").eqNullSafe(F.col(f"known.{f}")), F.lit(f"{f} differs")) for f in fields]
    found = F.when(F.col("known").isNull(), F.array(F.lit("unknown id"))).when(F.col("seen").isNull(), F.array(F.lit("missing row"))).otherwise(F.array_compact(F.array(*differs)))
    return both.select(key, F.explode(found).alias("problem"))


def tallies(df: DataFrame, values: dict[str, Sequence[str]], measured: Sequence[str] = ()) -> DataFrame:
    """(kind, value, n): how many rows hold each value of each vocabulary, and a measurement in each of ``measured``; zero counts are there too. One pass."""
    want = [(c, v, F.col(c) == v) for c, vs in values.items() for v in vs] + [("measured", m, F.col(m).isNotNull()) for m in measured]
    one = df.agg(*(F.count_if(F.coalesce(cond, F.lit(False))).alias(f"n{i}") for i, (_, _, cond) in enumerate(want)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value"), F.col(f"n{i}").alias("n")) for i, (k, v, _) in enumerate(want)))))


def site_years(surveys: DataFrame, site: str, year: str = "year") -> DataFrame:
    """(site, first_year, last_year, years_measured)."""
    return surveys.groupBy(site).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count_distinct(year).alias("years_measured"))


def cell_tallies(df: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """(null_cells, bad_cells, zero_cells) over raw columns; ``cells`` gives each one's parsed count. A blank is no measurement, a bad one is a fact about the source."""
    blank = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "" for c in cells]
    parsed = list(cells.values())
    total = lambda conds: F.coalesce(F.sum(reduce(lambda a, b: a + b, (F.when(c, 1).otherwise(0) for c in conds))), F.lit(0)).cast("long")
    return df.agg(total(blank).alias("null_cells"), total([~b & p.isNull() for b, p in zip(blank, parsed, strict=True)]).alias("bad_cells"), total([~b & (p == 0) for b, p in zip(blank, parsed, strict=True)]).alias("zero_cells"))


def reports(df: DataFrame, year: str, status: str = "vacant", construction: str = "any", borough: str = "all", points: bool = True) -> DataFrame:
    """Reports of a cohort that a filter lets through. As ``points``, only vacant places are published, so asking for the others gives none."""
    got = df.where(F.col("cohort") == year)
    if points and status == "nonVacant":
        return got.limit(0)
    if points or status != "both":
        got = got.where(F.col("status") == ("vacant" if points else status))
    if construction in CONSTRUCTION:
        got = got.where(F.col("construction").eqNullSafe(F.lit(CONSTRUCTION[construction]).cast("boolean")))
    return got if borough == "all" else got.where(F.lower("borough") == borough.lower())


def located(df: DataFrame, geometry: DataFrame, key: str) -> DataFrame:
    """Rows with their geometry; those without one are not on the map."""
    return df.join(geometry, key)


def bounds_union(extents: DataFrame) -> DataFrame:
    """One box (west, south, east, north) around boxes; empty ones (NULL edges) add nothing."""
    return extents.agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))
