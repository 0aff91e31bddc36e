"""Wide surveys: columns to rows and back, comparable pairs, trends, series."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.geo import in_box
from plinth.functions.parse import number
from plinth.functions.text import normalise_text
from plinth.operators.quality import Rule

# Months of survey columns, their periods, the flat band of a trend and its least span in years.
MONTHS = {"may": 5, "june": 6, "sept": 9, "oct": 10}
PERIODS = {"am": "am", "md": "md", "pm": "pm", "p_m": "pm"}
FLAT_BAND = 0.15
LEAST_SPAN = 5
COLUMN = re.compile(r"^(may|june|sept|oct)_?(\d\d)_(am|md|pm|p_m)$")


def survey_columns(names: Sequence[str]) -> dict[str, tuple[int, int, str]]:
    """(year, month, period) of each column that holds counts."""
    return {n: (2000 + int(m[2]), MONTHS[m[1]], PERIODS[m[3]]) for n in names if (m := COLUMN.match(n))}


def column_drift(present: Sequence[str], expected: Sequence[str]) -> tuple[list[str], list[str]]:
    """(new, missing) column names."""
    return sorted(set(present) - set(expected)), sorted(set(expected) - set(present))


def to_rows(df: DataFrame, ids: Sequence[str], columns: dict[str, tuple[int, int, str]], value: str = "value") -> DataFrame:
    """(ids, year, month, period, value): one row a cell; NULL cells stay, as no measurement."""
    cells = F.array(*(F.struct(F.lit(y).alias("year"), F.lit(m).alias("month"), F.lit(p).alias("period"), F.col(f"`{c}`").alias(value)) for c, (y, m, p) in columns.items()))
    return df.select(*ids, F.explode(cells).alias("_c")).select(*ids, "_c.*")


def surveys(rows: DataFrame, ids: Sequence[str], value: str = "value", periods: Sequence[str] = ("am", "md", "pm")) -> DataFrame:
    """One row a survey with a measurement: each period, the total of those measured, and whether all are."""
    wide = rows.groupBy(*ids, "year", "month").agg(*(F.max(F.when(F.col("period") == p, F.col(value))).alias(p) for p in periods))
    parts = [F.col(p) for p in periods]
    total = sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0)))
    whole = parts[0].isNotNull()
    for p in parts[1:]:
        whole &= p.isNotNull()
    return wide.where(F.coalesce(*parts).isNotNull()).withColumn("total", total).withColumn("complete", whole)


def comparable(survey: DataFrame, site: str, span: int = LEAST_SPAN) -> DataFrame:
    """(site, first_year, last_year, first_total, last_total, change, trend): the first and last complete survey in the month of the first complete one."""
    complete = survey.where("complete")
    month = F.first("month").over(Window.partitionBy(site).orderBy("year", "month"))
    same = complete.withColumn("_m", month).where("month = _m").groupBy(site).agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("total", "year").alias("_first"), F.max_by("total", "year").alias("_last")
    )
    ok = (F.col("last_year") - F.col("first_year") >= span) & (F.col("_first") > 0)
    pair = survey.select(site).distinct().join(same, site, "left").select(site, *(F.when(ok, F.col(c)).alias(a) for c, a in (("first_year", "first_year"), ("last_year", "last_year"), ("_first", "first_total"), ("_last", "last_total"))))
    change = F.col("last_total") - F.col("first_total")
    return pair.withColumn("change", change).withColumn("trend", trend(change, F.col("first_total")))


def trend(change: Column, base: Column, band: float = FLAT_BAND) -> Column:
    return F.when(change.isNull() | base.isNull() | (base <= 0), "insufficient").when(change > band * base, "rising").when(change < -band * base, "falling").otherwise("flat")


def latest(survey: DataFrame, site: str) -> DataFrame:
    """All fields of each site's last survey."""
    rest = [c for c in survey.columns if c != site]
    return survey.groupBy(site).agg(F.max_by(F.struct(*rest), F.col("year") * 12 + F.col("month")).alias("_s")).select(site, "_s.*")


def series(survey: DataFrame, site: str) -> DataFrame:
    """(site, series): surveys in order as an array; an incomplete one has no total."""
    item = F.struct("year", "month", F.when(F.col("complete"), F.col("total")).alias("total"))
    return survey.groupBy(site).agg(F.array_sort(F.collect_list(item)).alias("series"))


def not_rising(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Rows whose value is not above the one before in order: empty for a strictly rising series."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("before", F.lag(value).over(w)).where(F.col("before") >= F.col(value))


def year_on_year(survey: DataFrame, site: str) -> DataFrame:
    """(site, month, year, change): relative change from the complete survey before in the same month."""
    w = Window.partitionBy(site, "month").orderBy("year")
    before = survey.where("complete").withColumn("_b", F.lag("total").over(w))
    return before.where("_b > 0").select(site, "month", "year", ((F.col("total") - F.col("_b")) / F.col("_b")).alias("change"))


def change_profile(changes: DataFrame, change: str = "change") -> DataFrame:
    """One row (intervals, median, p75) of the sizes of changes, whatever their sign."""
    size = F.abs(change)
    return changes.agg(F.count(change).alias("intervals"), F.percentile(size, F.lit(0.5)).alias("median"), F.percentile(size, F.lit(0.75)).alias("p75"))


def newest_label(sites: DataFrame, label: str, year: str = "last_year", measured: str = "years_measured") -> DataFrame:
    """One row (label, year): the newest survey of any site; of sites with the same last year the one measured most often speaks, then the last label. NULL years don't speak."""
    got = sites.where(F.col(year).isNotNull()).agg(F.max(F.struct(F.col(year).alias("y"), F.coalesce(F.col(measured), F.lit(0)).alias("m"), F.col(label).alias("l"))).alias("x"))
    return got.select(F.col("x.l").alias("label"), F.col("x.y").alias("year"))


def site_rules(loc: str = "loc", street: str = "street", geometry: str = "geometry") -> list[Rule]:
    """Rules of a survey site, in order of precedence: no identity, no geometry, another shape than a point, coordinates that are no numbers, a point out of the city."""
    shape, none = F.from_json(geometry, "type string, coordinates array<string>"), F.col(geometry).isNull()
    lon, lat = number(F.get(shape["coordinates"], F.lit(0))), number(F.get(shape["coordinates"], F.lit(1)))
    point = F.coalesce(shape["type"], F.lit("")) == "Point"
    numbers = F.coalesce((F.size(shape["coordinates"]) == 2) & lat.isNotNull() & lon.isNotNull(), F.lit(False))
    return [
        Rule("missing_identity", normalise_text(F.col(loc)).isNull() | normalise_text(F.col(street)).isNull()), Rule("missing_geometry", none), Rule("unsupported_geometry", ~none & ~point, shape["type"]),
        Rule("unparseable_coordinates", point & ~numbers), Rule("out_of_bounds", point & numbers & ~in_box(lat, lon), F.concat_ws(",", lat, lon)),
    ]


def bars(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each value's share of its key's peak, and whether it is the first or last."""
    w = Window.partitionBy(key)
    n = F.row_number().over(w.orderBy(order))
    return df.withColumn("share", F.col(value) / F.max(value).over(w)).withColumn("is_first", n == 1).withColumn("is_last", n == F.count("*").over(w))
