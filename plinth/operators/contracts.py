"""Rule tables of the published artifacts. Each is counted in one pass by ``validate.run_checks``; relations between tables come back as problem rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.geo import in_box
from plinth.functions.parse import count
from plinth.functions.text import normalise_text
from plinth.operators.counters import ACTIVITY, LEAST_SAMPLES
from plinth.operators.surveys import column_drift
from plinth.operators.validate import ERROR, WARNING, Check

# What a level of foot traffic asserts, how far a ratio may be from its parts, the least records of a full run, and of a survey file.
LEVELS_WITH_VOLUME = ("typical", "busy", "veryBusy")
RATIO_TOLERANCE = 0.005
LEAST_RECORDS, COLLAPSED = 1500, 100


def licences(kinds: Sequence[str], boroughs: Sequence[str], id_pattern: str, longest: int = 200) -> list[Check]:
    """Rows (id, name, kind, borough, zip, lat, lon) of establishments: identity, vocabulary, place, lengths; unknown boroughs and odd postcodes are drift."""
    c = F.col
    return [
        Check("id has its pattern", ~F.coalesce(c("id").rlike(id_pattern), F.lit(False))), Check("name is there", F.coalesce(F.trim("name"), F.lit("")) == ""), Check("name is not too long", F.length("name") > longest),
        Check("kind is known", ~F.coalesce(c("kind").isin(*kinds), F.lit(False))), Check("point is in the city", ~in_box(c("lat"), c("lon"))),
        Check("borough is known", ~F.coalesce(c("borough").isin(*boroughs), F.lit(False)), WARNING), Check("postcode has five digits", c("zip").isNotNull() & (c("zip") != "") & ~c("zip").rlike("^[0-9]{5}$"), WARNING),
    ]


def _apart(a: Column, b: Column) -> Column:
    return a.isNull() != b.isNull()


def sensors() -> list[Check]:
    """Rows (staleness, active, activity, count, expected, percentile, ratio, samples, observedAt) of published counters."""
    c, dead = F.col, F.col("staleness").isin("offline", "unavailable")
    numbers = [c(n).isNotNull() for n in ("count", "expected", "percentile", "ratio")]
    quiet = F.when(c("count") == 0, "quiet").otherwise("unavailable")
    near = F.abs(c("ratio") - c("count") / c("expected")) <= RATIO_TOLERANCE
    return [
        Check("counts are not negative", (c("count") < 0) | (c("expected") < 0) | (c("samples") < 0)), Check("percentile is from 0 to 100", ~c("percentile").between(0, 100)),
        Check("no baseline from too few samples", (c("samples") < LEAST_SAMPLES) & (c("expected").isNotNull() | c("percentile").isNotNull() | (c("activity") != "unavailable"))),
        Check("enough samples have a baseline", (c("samples") >= LEAST_SAMPLES) & c("expected").isNull() & c("count").isNotNull()),
        Check("nothing expected is quiet or unavailable", (c("expected") == 0) & c("count").isNotNull() & (c("activity") != quiet)),
        Check("no level of traffic where none is expected", (c("expected") == 0) & c("activity").isin(*LEVELS_WITH_VOLUME)), Check("no ratio to nothing", (c("expected") == 0) & c("ratio").isNotNull()),
        Check("a dead counter has no number", dead & (numbers[0] | numbers[1] | numbers[2] | numbers[3])), Check("a fresh counter has a reading", (c("staleness") == "fresh") & (c("count").isNull() | c("observedAt").isNull())),
        Check("a reading and its time go together", _apart(c("count"), c("observedAt"))), Check("active is fresh", ~c("active").eqNullSafe(c("staleness") == "fresh")),
        Check("ratio is count over expected", (c("expected") > 0) & c("count").isNotNull() & ~F.coalesce(near, F.lit(False))), Check("a ratio has both its parts", c("ratio").isNotNull() & (c("count").isNull() | c("expected").isNull())),
    ]


def history(periods: Sequence[str] = ("am", "md", "pm"), trends: Sequence[str] = ("rising", "falling", "flat", "insufficient")) -> list[Check]:
    """Rows (periods, total, change, changeYears, trend, firstYear, lastYear, yearsMeasured, latestSurvey) of survey sites."""
    c = F.col
    some = F.coalesce(*(c(p) for p in periods)).isNotNull()
    total = sum((F.coalesce(c(p), F.lit(0)) for p in periods[1:]), F.coalesce(c(periods[0]), F.lit(0)))
    negative = F.lit(False)
    for p in periods:
        negative = negative | (c(p) < 0)
    return [
        Check("periods are not negative", negative), Check("total is the sum of its periods", some & ~c("total").eqNullSafe(total)), Check("no total without a period", ~some & c("total").isNotNull()),
        Check("trend is known", ~F.coalesce(c("trend").isin(*trends), F.lit(False))), Check("change and its years go together", _apart(c("change"), c("changeYears"))),
        Check("change years are a range", c("changeYears").isNotNull() & ~c("changeYears").contains("–")), Check("no change is insufficient", (c("trend") == "insufficient") != c("change").isNull()),
        Check("years are in order", c("firstYear") > c("lastYear")), Check("a first year was measured", c("firstYear").isNotNull() & (c("yearsMeasured") < 1)), Check("counts and the latest survey go together", some != c("latestSurvey").isNotNull()),
    ]


def collapsed(n: int, least: int = COLLAPSED) -> list[str]:
    """A file with far fewer rows than any run had is a broken source, not news."""
    return [f"{n} rows, at least {least} are expected"] if n < least else []


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, n): ids that more than one row has, NULL among them."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull())


def cross_check(source: DataFrame, rejected: DataFrame, duplicates: DataFrame, published: DataFrame, least: int = LEAST_RECORDS) -> DataFrame:
    """One row (source, rejected, duplicates, published, balanced, enough): whether every source row is accounted for, and the run is a full one."""
    tagged = [df.select(F.lit(n).alias("part")) for n, df in (("source", source), ("rejected", rejected), ("duplicates", duplicates), ("published", published))]
    every = tagged[0].unionAll(tagged[1]).unionAll(tagged[2]).unionAll(tagged[3])
    got = every.agg(*(F.count_if(F.col("part") == n).alias(n) for n in ("source", "rejected", "duplicates", "published")))
    return got.withColumn("balanced", F.col("source") - F.col("rejected") - F.col("duplicates") == F.col("published")).withColumn("enough", F.col("published") >= least)


def code_tallies(rejections: DataFrame, tallied: DataFrame, code: str = "code") -> DataFrame:
    """(code, listed, tallied): reasons whose listed rejections are not as many as their tally says."""
    listed = rejections.groupBy(code).agg(F.count("*").alias("listed"))
    both = listed.join(tallied.select(code, F.col("n").alias("tallied")), code, "full").na.fill(0, ["listed", "tallied"])
    return both.where("listed <> tallied")


def reconciled_cohorts(areas: DataFrame, points: DataFrame, coverage: DataFrame, cohort: str = "cohort") -> DataFrame:
    """(cohort, problem): where the area cells (cohort, area, status, n, mappable), the published points (cohort) and the coverage rows of a cohort contradict each other."""
    status = ("vacant", "nonVacant", "unknown")
    sums = areas.groupBy(cohort).agg(
        F.sum("n").alias("s_rows"), F.sum("mappable").alias("s_mappable"), *(F.sum(F.when(F.col("status") == s, F.col("n")).otherwise(0)).alias(f"s_{s}") for s in status), F.sum(F.when(F.col("area").isNull(), F.col("n")).otherwise(0)).alias("s_unknown_area"),
        F.count_if(F.col("mappable") > F.col("n")).alias("over"),
    )
    drawn = points.groupBy(cohort).agg(F.count("*").alias("s_points"))
    c = F.col
    rules = [
        ("no coverage", c("rows").isNull()), ("no areas", c("s_rows").isNull()), ("rows are not those of the areas", c("rows") != c("s_rows")), ("statuses don't add up", c("rows") != c("vacant") + c("nonVacant") + c("unknown")),
        *((f"{s} is not that of the areas", c(s) != c(f"s_{s}")) for s in status), ("mappable is not that of the areas", c("mappable") != c("s_mappable")), ("more mappable than rows", c("over") > 0),
        ("points are not those published", c("points") != F.coalesce(c("s_points"), F.lit(0))), ("unknown areas differ", c("unknown_area") != c("s_unknown_area")), ("share is not supported as said", c("share_supported") != (c("nonVacant") > 0)),
    ]
    both = coverage.join(sums, cohort, "full").join(drawn, cohort, "left")
    return both.select(cohort, F.explode(F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in rules)))).alias("problem"))


def rings_closed(polygons: Column) -> Column:
    """Whether every ring of a MultiPolygon's nested arrays has four positions or more and ends where it starts."""
    return F.forall(F.flatten(polygons), lambda ring: (F.size(ring) >= 4) & (F.element_at(ring, 1) == F.element_at(ring, -1)))


def latest(id_pattern: str, longest: int = 200) -> list[Check]:
    """Rows (id, name, activity, staleness, active, count, expected, percentile, ratio, observationCount, observedAt) of the latest readings, as a loader takes them."""
    c, seen = F.col, F.col("observedAt").isNotNull() & F.col("count").isNotNull()
    among = lambda x, known: F.coalesce(c(x).isin(*known), F.lit(False))
    wild = lambda x: c(x).isNotNull() & (F.isnan(c(x).cast("double")) | (F.abs(c(x).cast("double")) == float("inf")))
    return [
        Check("id has its pattern", ~F.coalesce(c("id").rlike(id_pattern), F.lit(False))), Check("name is there and not too long", ~F.coalesce(F.length(F.trim("name")).between(1, longest), F.lit(False))),
        Check("activity is known", ~among("activity", ["unavailable", *(a for a, _ in ACTIVITY)])), Check("staleness is known", ~among("staleness", ["fresh", "stale", "offline", "unavailable"])), Check("active is said", c("active").isNull()),
        Check("counts are not negative", (c("count") < 0) | (c("expected") < 0) | (c("observationCount") < 0)), Check("the number of observations is there", c("observationCount").isNull()),
        Check("an activity has an observation", (c("activity") != "unavailable") & ~seen), Check("an observation has an activity", (c("activity") == "unavailable") & seen),
        Check("percentile is from 0 to 100", ~c("percentile").between(0, 100)), Check("numbers are finite", wild("percentile") | wild("ratio")), Check("no ratio to nothing", c("ratio").isNotNull() & (c("expected") == 0)),
    ]


def too_many(df: DataFrame, most: int) -> DataFrame:
    """One row (rows, most) if there are more than ``most`` rows, a limit of sanity for what a client loads; none otherwise."""
    return df.limit(most + 1).agg(F.count("*").alias("rows")).withColumn("most", F.lit(most).cast("long")).where("rows > most")


def tallies_differ(claimed: DataFrame, observed: DataFrame, value: str) -> DataFrame:
    """(value, claimed, observed): what a report says of a vocabulary (value, n) against the rows themselves; absent is zero."""
    seen = observed.groupBy(value).agg(F.count("*").alias("observed"))
    both = claimed.select(value, F.col("n").alias("claimed")).join(seen, value, "full").na.fill(0, ["claimed", "observed"])
    return both.where("claimed <> observed")


def source_drift(df: DataFrame, consumed: Sequence[str], shape: str, boroughs: Sequence[str], groups: Sequence[str], index_values: Sequence[str], geometry: str = "the_geom", borough: str = "borough", index: str = "iex") -> DataFrame:
    """(problem, severity, name, n): where a wide source is not what its reader took it for.

    Columns of the ``shape`` (a regular expression) that were not consumed, and consumed ones that are gone; rows without geometry; cells, by column, that hold something that is no count; values of the borough
    column that are neither boroughs nor known groups (drift), and groups (drift too, as published); values of the index column that are not known. Cells are looked at in one pass; a value without any row is no problem.
    """
    spark = df.sparkSession
    present = [c for c in df.columns if re.fullmatch(shape, c)]
    unhandled, vanished = column_drift(present, consumed)
    known = "problem string, severity string, name string, n long"
    out = spark.createDataFrame([("column not consumed", ERROR, c, 1) for c in unhandled] + [("column is gone", ERROR, c, 1) for c in vanished], known)
    bad = lambda c: normalise_text(F.col(f"`{c}`")).isNotNull() & count(F.col(f"`{c}`")).isNull()
    one = df.agg(F.count_if(F.col(geometry).isNull()).alias("g"), *(F.count_if(bad(c)).alias(f"b{i}") for i, c in enumerate(present)))
    cell = lambda problem, name, n: F.struct(F.lit(problem).alias("problem"), F.lit(ERROR).alias("severity"), F.lit(name).alias("name"), F.col(n).alias("n"))
    cells = one.select(F.inline(F.array(cell("no geometry", geometry, "g"), *(cell("not a count", c, f"b{i}") for i, c in enumerate(present))))).where("n > 0")
    values = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(normalise_text(F.col(c)), F.lit("<empty>")).alias("v")) for k, c in (("b", borough), ("i", index))))).alias("x")).groupBy("x.k", "x.v").agg(F.count("*").alias("n"))
    k, v = F.col("k"), F.col("v")
    problem = F.when((k == "b") & v.isin(*groups), "a group, not a borough").when((k == "b") & ~v.isin(*boroughs), "not a borough").when((k == "i") & ~v.isin(*index_values), "unknown index value")
    said = values.select(problem.alias("problem"), F.when(k == "b", WARNING).otherwise(ERROR).alias("severity"), v.alias("name"), "n").where("problem is not null")
    return out.unionByName(cells).unionByName(said)
