"""Rule tables of published rows that hold arrays of structs: series, area cells, shapes. Higher-order functions look into a row, so ``validate.run_checks`` still counts all rules in one pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth.functions.parse import survey_label
from plinth.operators.validate import Check

PERIODS = ("am", "md", "pm")
STATUSES = ("vacant", "nonVacant", "unknown")
VINTAGES = ("2010", "2020")


def some(items: Column, broken: Callable[[Column], Column]) -> Column:
    """Whether any element breaks the rule; an element for which it is NULL does not."""
    return F.exists(items, lambda x: F.coalesce(broken(x), F.lit(False)))


def rising(items: Column, key: Callable[[Column], Column]) -> Column:
    """Whether each element's key is above that of the element before it."""
    after = F.slice(items, 2, F.greatest(F.lit(0), F.size(items) - 1))
    return F.forall(F.arrays_zip(F.slice(items, 1, F.size(after)).alias("a"), after.alias("b")), lambda p: F.coalesce(key(p["a"]) < key(p["b"]), F.lit(False)))


def distinct(items: Column, key: Callable[[Column], Column]) -> Column:
    keys = F.transform(items, key)
    return F.size(F.array_distinct(keys)) == F.size(keys)


def total_of(items: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(value(x), F.lit(0)).cast("long"))


def series(periods: Sequence[str] = PERIODS) -> list[Check]:
    """Rows (discrete, surveyCount, surveys: array of (year, month, label, periods..., total, complete)) of a site's surveys."""
    c, s = F.col, F.col("surveys")
    parts = lambda x: F.array_compact(F.array(*(x[p].cast("long") for p in periods)))
    whole = lambda x: F.aggregate(parts(x), F.lit(0).cast("long"), lambda a, v: a + v)
    return [
        Check("there is a series", s.isNull()), Check("a series says that it is discrete", ~c("discrete").eqNullSafe(F.lit(True))), Check("surveys are as many as said", s.isNotNull() & ~c("surveyCount").eqNullSafe(F.size(s))),
        Check("every survey has a year and a month", some(s, lambda x: x["year"].isNull() | x["month"].isNull())),
        Check("surveys are in order", s.isNotNull() & ~rising(s, lambda x: x["year"] * 100 + x["month"])), Check("labels say year and month", some(s, lambda x: ~x["label"].eqNullSafe(survey_label(x["year"], x["month"])))),
        Check("every survey has a count", some(s, lambda x: F.size(parts(x)) == 0)), Check("no count is negative", some(s, lambda x: F.exists(parts(x), lambda v: v < 0))),
        Check("totals are the sums of their periods", some(s, lambda x: (F.size(parts(x)) > 0) & ~x["total"].cast("long").eqNullSafe(whole(x)))),
        Check("complete surveys have every period", some(s, lambda x: (F.size(parts(x)) > 0) & ~x["complete"].eqNullSafe(F.size(parts(x)) == len(periods)))),
    ]


def area_cells(id_pattern: str) -> list[Check]:
    """Rows (id, nta, vintage, boundaryId, lat, lon, totalRecords, mappableRecords, counts: array of (status, flag, n, mappable)) of areas."""
    c, k = F.col, F.col("counts")
    number = lambda x, f: F.coalesce(x[f], F.lit(-1))
    return [
        Check("id has its pattern", ~F.coalesce(c("id").rlike(id_pattern), F.lit(False))), Check("vintage is known", c("vintage").isNotNull() & ~c("vintage").isin(*VINTAGES)), Check("no vintage without an area", c("nta").isNull() & c("vintage").isNotNull()),
        Check("the boundary is that of the area", c("boundaryId").isNotNull() & ~c("boundaryId").eqNullSafe(F.concat("vintage", F.lit(":"), "nta"))),
        Check("no place is made up for an unknown area", c("vintage").isNull() & (c("lat").isNotNull() | c("lon").isNotNull() | c("boundaryId").isNotNull())),
        Check("there are cells", k.isNull()), Check("every cell is there once", k.isNotNull() & ~distinct(k, lambda x: F.struct(x["status"], x["flag"]))), Check("statuses are known", some(k, lambda x: ~F.coalesce(x["status"].isin(*STATUSES), F.lit(False)))),
        Check("counts are whole and not negative", some(k, lambda x: (number(x, "n") < 0) | (number(x, "mappable") < 0))), Check("no more are mappable than there are", some(k, lambda x: x["mappable"] > x["n"])),
        Check("the total is that of the cells", ~c("totalRecords").eqNullSafe(total_of(k, lambda x: x["n"]))), Check("mappable is that of the cells", ~c("mappableRecords").eqNullSafe(total_of(k, lambda x: x["mappable"]))),
    ]


def shapes(most_positions: int = 100_000) -> list[Check]:
    """Rows (id, nta, vintage, name, polygons: MultiPolygon arrays of [lon, lat]) of boundaries."""
    c, p = F.col, F.col("polygons")
    rings = F.flatten(p)
    flat = F.flatten(rings)
    inside = lambda xy: (F.size(xy) == 2) & xy[0].between(-180, 180) & xy[1].between(-90, 90)
    return [
        Check("id is vintage and area", ~c("id").eqNullSafe(F.concat("vintage", F.lit(":"), "nta"))), Check("vintage is known", ~F.coalesce(c("vintage").isin(*VINTAGES), F.lit(False))), Check("name is there", F.coalesce(F.trim("name"), F.lit("")) == ""),
        Check("there is a polygon", F.coalesce(F.size(p), F.lit(0)) < 1), Check("every polygon has a ring", some(p, lambda x: F.size(x) < 1)), Check("rings have four positions or more", some(rings, lambda r: F.size(r) < 4)),
        Check("rings end where they start", some(rings, lambda r: (F.size(r) > 0) & ~F.get(r, F.lit(0)).eqNullSafe(F.get(r, F.size(r) - 1)))), Check("positions are on the globe", some(flat, lambda xy: ~F.coalesce(inside(xy), F.lit(False)))),
        Check("shapes are not too long", F.size(flat) > most_positions),
    ]


def coverage() -> list[Check]:
    """Rows (cohort, rows, vacant, nonVacant, unknown, mappable, points, unknown_area, share_supported) of what a cohort covers."""
    c = F.col
    below = lambda a, *tops: F.coalesce(c(a) > F.least(*(c(t) for t in tops)) if len(tops) > 1 else c(a) > c(tops[0]), F.lit(True))
    numbers = ("rows", "vacant", "nonVacant", "unknown", "mappable", "points", "unknown_area")
    negative = F.lit(False)
    for n in numbers:
        negative = negative | c(n).isNull() | (c(n) < 0)
    return [
        Check("cohort has its pattern", ~F.coalesce(c("cohort").rlike("^[0-9]{4}( and [0-9]{4})?$"), F.lit(False))), Check("numbers are there and not negative", negative), Check("statuses add up", ~c("rows").eqNullSafe(c("vacant") + c("nonVacant") + c("unknown"))),
        Check("no more are mappable than there are", below("mappable", "rows")), Check("no more are of unknown area than there are", below("unknown_area", "rows")), Check("points are vacant and mappable", below("points", "vacant", "mappable")),
        Check("a share needs places that are not vacant", c("share_supported").isNull() | F.coalesce(c("share_supported") & (c("nonVacant") == 0), F.lit(False))),
    ]
