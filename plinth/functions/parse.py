"""Typed values from source text as Columns: a value that does not parse is NULL, never zero and never repaired."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth.functions.text import normalise_text

#: Plain decimal notation; rules out spellings that only one engine would read (``1_000``, ``1.0f``).
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
ZONE = "America/New_York"


def number(c: Column) -> Column:
    t = F.trim(c.cast("string"))
    d = F.when(t.rlike(NUMBER), t.try_cast("double"))
    return F.when(F.abs(d) < float("inf"), d)


def digits_id(c: Column, least: int = 5) -> tuple[Column, Column]:
    """(id, degenerate): digits only, ``least`` of them or more; degenerate if something else was there."""
    t = normalise_text(c)
    good = t.rlike(f"^[0-9]{{{least},}}$")
    return F.when(good, t), t.isNotNull() & ~good


def calendar_date(c: Column) -> Column:
    """The calendar day that the text starts with; NULL if there is none."""
    t = normalise_text(c)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))


def iso_date_strict(c: Column) -> Column:
    """The text as it is if it is an ISO date or time; the job fails otherwise."""
    return F.when(c.isNull() | F.try_to_timestamp(c).isNotNull(), c).otherwise(F.raise_error(F.concat(F.lit("not a date: "), c)).cast("string"))


def coordinate(c: Column) -> tuple[Column, Column, Column]:
    """(value, missing, unparseable)."""
    t = normalise_text(c)
    d = number(t)
    return d, t.isNull(), t.isNotNull() & d.isNull()


def world_point(lat: Column, lon: Column) -> Column:
    """Why a point can't be published (NULL if it can): missing, invalid or zero coordinates."""
    a, b = number(lat), number(lon)
    given = normalise_text(lat).isNotNull() & normalise_text(lon).isNotNull()
    inside = a.between(-90, 90) & b.between(-180, 180)
    return F.when(~given, "missing_coordinates").when(~F.coalesce(inside, F.lit(False)), "invalid_coordinates").when((a == 0) & (b == 0), "zero_coordinates")


def world_position(lat: Column, lon: Column, places: int = 7) -> tuple[Column, Column, Column]:
    """(lat, lon, failure code): a point that can be published, to ``places`` decimals; NULL coordinates with a code."""
    code = world_point(lat, lon)
    return F.when(code.isNull(), F.round(number(lat), places)), F.when(code.isNull(), F.round(number(lon), places)), code


def geojson_point(c: Column) -> tuple[Column, Column, Column]:
    """(lat, lon, failure code) of a GeoJSON Point as text."""
    g = F.from_json(c, "type string, coordinates array<double>", {"mode": "PERMISSIVE"})
    xy = g["coordinates"]
    lon, lat = F.get(xy, F.lit(0)), F.get(xy, F.lit(1))
    code = (
        F.when(c.isNull(), "missing_geometry").when(F.coalesce(g["type"], F.lit("")) != "Point", "not_a_point")
        .when(F.coalesce(F.size(xy), F.lit(0)) < 2, "short_coordinates").when(~F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False)), "bad_coordinates")
    )
    return F.when(code.isNull(), lat), F.when(code.isNull(), lon), code


def count(c: Column) -> Column:
    """A count of zero or more; NULL for anything else. Zero is a measurement, NULL is not."""
    d = number(c)
    n = d.try_cast("int")
    return F.when((d >= 0) & (n >= 0), n)


def vacancy(c: Column) -> Column:
    t = F.nullif(c, F.lit(""))
    return F.when(t.isNull(), "unknown").when(t.isin("YES", "Y"), "vacant").when(t.isin("NO", "N"), "nonVacant").otherwise(F.raise_error(F.concat(F.lit("unknown status: "), c)).cast("string"))


def tri_state(c: Column) -> Column:
    t = F.nullif(c, F.lit(""))
    return F.when(t.isin("YES", "Y"), True).when(t.isin("NO", "N"), False).when(t.isNull(), F.lit(None).cast("boolean")).otherwise(F.raise_error(F.concat(F.lit("unknown flag: "), c)).cast("boolean"))


def area_vintage(c: Column) -> Column:
    return F.when(c.rlike("^[A-Z]{2}[0-9]{2}$"), "2010").when(c.rlike("^[A-Z]{2}[0-9]{4}$"), "2020")


def civil_time(c: Column) -> Column:
    """Wall-clock time to the second, without a zone."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), F.substring(c, 1, 19).try_cast("timestamp_ntz"))


def civil_to_utc(local: Column, zone: str = ZONE) -> Column:
    """The instant of a wall-clock time: the first of two, and the offset before a gap (session zone UTC)."""
    return F.to_utc_timestamp(local.cast("timestamp"), zone)


def utc_text(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def bucket_key(local: Column, minutes: int = 15) -> Column:
    """``HH:MM`` of the interval that a wall-clock time lies in."""
    return F.format_string("%02d:%02d", F.hour(local), (F.floor(F.minute(local) / minutes) * minutes).cast("int"))


def day_key(local: Column) -> Column:
    """mon ... sun."""
    return F.element_at(F.array(*(F.lit(d) for d in ("mon", "tue", "wed", "thu", "fri", "sat", "sun"))), F.weekday(local) + 1)


def survey_label(year: Column, month: Column) -> Column:
    name = F.when(month == 5, "May").when(month == 6, "June").when(month == 9, "September").when(month == 10, "October")
    return F.concat(name, F.lit(" "), year.cast("string"))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")
