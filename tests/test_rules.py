"""Each nested rule against a planted fault; readings compared by moment; reports counted while rows are written."""

import copy
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plinth.operators import contracts, nested, sensors, validate
from plinth.sources import publish

SURVEY = {"year": 2010, "month": 5, "label": "May 2010", "am": 1, "md": None, "pm": 3, "total": 4, "complete": False}
SITE = {"discrete": True, "surveyCount": 2, "surveys": [SURVEY, {"year": 2010, "month": 9, "label": "September 2010", "am": 1, "md": 2, "pm": 3, "total": 6, "complete": True}]}
SITE_SCHEMA = "discrete boolean, surveyCount int, surveys array<struct<year:int,month:int,label:string,am:int,md:int,pm:int,total:int,complete:boolean>>"


def with_survey(**changed):
    out = copy.deepcopy(SITE)
    out["surveys"][0] |= changed
    return out


def broken(spark, rows, schema, checks):
    return {r.check: r.broken for r in validate.run_checks(spark.createDataFrame(rows, schema), checks).collect() if r.broken}


@pytest.mark.parametrize(("site", "rules"), [
    (SITE, set()), (SITE | {"surveyCount": 0, "surveys": []}, set()), (SITE | {"surveys": None}, {"there is a series"}), (SITE | {"discrete": None}, {"a series says that it is discrete"}), (SITE | {"surveyCount": 3}, {"surveys are as many as said"}),
    (SITE | {"surveys": SITE["surveys"][::-1]}, {"surveys are in order"}), (SITE | {"surveys": [SURVEY, SURVEY]}, {"surveys are in order"}), (with_survey(label="May 2011"), {"labels say year and month"}), (with_survey(am=-1, total=2), {"no count is negative"}),
    (with_survey(total=5), {"totals are the sums of their periods"}), (with_survey(total=None), {"totals are the sums of their periods"}), (with_survey(complete=True), {"complete surveys have every period"}), (with_survey(am=None, pm=None), {"every survey has a count"}),
    (with_survey(month=None, label=None), {"every survey has a year and a month", "surveys are in order"}),
])
def test_series_rules(spark, site, rules):
    assert broken(spark, [site, SITE], SITE_SCHEMA, nested.series()) == dict.fromkeys(rules, 1)


AREA = {"id": "area-01", "nta": "MN17", "vintage": "2010", "boundaryId": "2010:MN17", "lat": 40.7, "lon": -74.0, "totalRecords": 5, "mappableRecords": 3, "counts": [("vacant", True, 2, 1), ("vacant", None, 3, 2)]}
AREA_SCHEMA = "id string, nta string, vintage string, boundaryId string, lat double, lon double, totalRecords long, mappableRecords long, counts array<struct<status:string,flag:boolean,n:long,mappable:long>>"
UNKNOWN = AREA | {"nta": None, "vintage": None, "boundaryId": None, "lat": None, "lon": None}


@pytest.mark.parametrize(("area", "rules"), [
    (AREA, set()), (UNKNOWN, set()), (AREA | {"id": "x"}, {"id has its pattern"}), (AREA | {"vintage": "2030", "boundaryId": "2030:MN17"}, {"vintage is known"}), (UNKNOWN | {"vintage": "2010"}, {"no vintage without an area"}),
    (AREA | {"boundaryId": "2020:MN17"}, {"the boundary is that of the area"}), (UNKNOWN | {"lat": 40.7}, {"no place is made up for an unknown area"}), (AREA | {"counts": None}, {"there are cells", "the total is that of the cells", "mappable is that of the cells"}),
    (AREA | {"counts": [("vacant", None, 2, 1), ("vacant", None, 3, 2)]}, {"every cell is there once"}), (AREA | {"counts": [("empty", True, 2, 1), ("vacant", None, 3, 2)]}, {"statuses are known"}),
    (AREA | {"counts": [("vacant", True, -2, -2), ("vacant", None, 7, 5)]}, {"counts are whole and not negative"}), (AREA | {"counts": [("vacant", True, 1, 2), ("vacant", None, 4, 1)]}, {"no more are mappable than there are"}),
    (AREA | {"totalRecords": 6}, {"the total is that of the cells"}), (AREA | {"mappableRecords": None}, {"mappable is that of the cells"}),
])
def test_area_rules(spark, area, rules):
    assert broken(spark, [area, AREA], AREA_SCHEMA, nested.area_cells("^area-[0-9]+$")) == dict.fromkeys(rules, 1)


RING = [[-74.0, 40.0], [-73.0, 40.0], [-73.0, 41.0], [-74.0, 40.0]]
SHAPE = {"id": "2020:MN0101", "nta": "MN0101", "vintage": "2020", "name": "Battery", "polygons": [[RING], [RING, RING]]}


@pytest.mark.parametrize(("shape", "rules"), [
    (SHAPE, set()), (SHAPE | {"id": "MN0101"}, {"id is vintage and area"}), (SHAPE | {"vintage": "1990", "id": "1990:MN0101"}, {"vintage is known"}), (SHAPE | {"name": " "}, {"name is there"}), (SHAPE | {"polygons": []}, {"there is a polygon"}),
    (SHAPE | {"polygons": [[RING], []]}, {"every polygon has a ring"}), (SHAPE | {"polygons": [[RING[:2] + RING[:1]]]}, {"rings have four positions or more"}), (SHAPE | {"polygons": [[RING, RING[1:] + RING[1:3]]]}, {"rings end where they start"}),
    (SHAPE | {"polygons": [[[[-74.0, 95.0], *RING[1:], [-74.0, 95.0]]]]}, {"positions are on the globe"}), (SHAPE | {"polygons": [[RING] * 6]}, {"shapes are not too long"}),
])
def test_shape_rules(spark, shape, rules):
    schema = "id string, nta string, vintage string, name string, polygons array<array<array<array<double>>>>"
    assert broken(spark, [shape, SHAPE], schema, nested.shapes(most_positions=20)) == dict.fromkeys(rules, 1)


COVER = {"cohort": "2023", "rows": 10, "vacant": 4, "nonVacant": 5, "unknown": 1, "mappable": 8, "points": 3, "unknown_area": 2, "share_supported": True}


@pytest.mark.parametrize(("changed", "rules"), [
    ({}, set()), ({"cohort": "2023 and 24"}, {"cohort has its pattern"}), ({"unknown_area": -1}, {"numbers are there and not negative"}), ({"rows": 11}, {"statuses add up"}), ({"mappable": 11}, {"no more are mappable than there are"}),
    ({"unknown_area": 11}, {"no more are of unknown area than there are"}), ({"points": 5}, {"points are vacant and mappable"}), ({"nonVacant": 0, "vacant": 9}, {"a share needs places that are not vacant"}), ({"share_supported": None}, {"a share needs places that are not vacant"}),
])
def test_coverage_rules(spark, changed, rules):
    schema = "cohort string, rows long, vacant long, nonVacant long, unknown long, mappable long, points long, unknown_area long, share_supported boolean"
    assert broken(spark, [COVER | changed, COVER], schema, nested.coverage()) == dict.fromkeys(rules, 1)


INDEX = [(1, "s", True), (2, "s", False), (3, "t", True)]


def counts_of(spark, rows):
    return spark.createDataFrame([(i, datetime.fromisoformat(t), d, v) for i, t, d, v in rows], "sensor_id long, ts timestamp_ntz, direction string, v long")


def test_twins_are_compared_by_moment(spark):
    index = spark.createDataFrame(INDEX, "id long, serial string, is_representative boolean")
    same = [(i, f"2026-07-01T{h:02d}:00", d, h) for i in (1, 2) for h in (1, 2, 3, 4) for d in ("in", "out")]
    assert sensors.twin_moments(counts_of(spark, same), index).count() == 0
    # two faults that leave the total as it was, a missing row, one too many, one twice
    rows = [(i, t, d, v + (t.endswith("01:00") and i == 2 and d == "in") - (t.endswith("02:00") and i == 2 and d == "in")) for i, t, d, v in same if (i, t[-5:], d) != (2, "03:00", "out")]
    rows += [(2, "2026-07-01T09:00", "in", 1), (2, "2026-07-01T04:00", "out", 0), (3, "2026-07-01T04:00", "out", 7)]
    got = {(r.serial, r.id, r.ts.hour, r.direction, r.problem) for r in sensors.twin_moments(counts_of(spark, rows), index).collect()}
    assert got == {("s", 2, 1, "in", "differs"), ("s", 2, 2, "in", "differs"), ("s", 2, 3, "out", "missing"), ("s", 2, 9, "in", "extra"), ("s", 2, 4, "out", "repeated")}


def test_published_counts_are_recomputed_at_their_moment(spark):
    index = spark.createDataFrame(INDEX, "id long, serial string, is_representative boolean")
    rows = [(i, "2026-07-01T12:00", d, v) for i in (1, 2) for d, v in (("in", 3), ("out", 4))] + [(3, "2026-01-01T12:00", "in", 9), (1, "2026-07-02T12:00", "in", 5), (2, "2026-07-02T12:00", "in", 6)]
    raw = counts_of(spark, rows)

    def problems(*claims):
        published = spark.createDataFrame(claims, "serial string, at string, count long").select("serial", F.to_timestamp("at").alias("observed_at"), "count")
        return {(r.serial, r.problem, r.found) for r in sensors.recomputed_moments(published, raw, index).collect()}

    assert problems(("s", "2026-07-01 16:00:00", 7), ("t", "2026-01-01 17:00:00", 9), ("t", None, 1)) == set()
    assert problems(("s", "2026-07-01 16:00:00", 14)) == {("s", "count is not the representative's", 7)}
    assert problems(("s", "2026-07-02 16:00:00", 5)) == {("s", "twins do not repeat it", 11)}
    assert problems(("s", "2026-07-01 12:00:00", 7), ("u", "2026-07-01 16:00:00", 7)) == {("s", "no rows", None), ("u", "no rows", None)}


def test_reports_are_counted_while_rows_are_written(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i) for i in range(100)], "k long, v long").repartition(4)
    counters = {"missing": F.col("v").isNull(), "large": F.col("v") > 50, "negative": F.col("v") < 0}
    got = {r.counter: r.n if r.value is None else r.value for r in publish.write_reported(df, str(tmp_path / "out"), counters, {"newest": F.col("k")}).collect()}
    again = spark.read.parquet(str(tmp_path / "out"))
    assert got == {"rows": again.count(), "missing": again.where("v is null").count(), "large": again.where("v > 50").count(), "negative": 0, "newest": "99"}
    empty = {r.counter: r.n for r in publish.write_reported(df.limit(0), str(tmp_path / "none"), counters).collect()}
    assert empty == {"rows": 0, "missing": 0, "large": 0, "negative": 0}


def test_periods_have_folders_and_the_default_none(spark, tmp_path):
    root = str(tmp_path / "root")
    areas = spark.createDataFrame([("2024", 1), ("2024", 2), ("2021 and 2022", 3)], "cohort string, n long")
    points = areas.where("n <> 2")
    got = {(r.cohort, r.artifact): (r.path, r.rows) for r in publish.write_periods({"areas": areas, "vacant": points}, root, "cohort", "2024").collect()}
    assert got == {("2024", "areas"): ("areas", 2), ("2024", "vacant"): ("vacant", 1), ("2021 and 2022", "areas"): ("periods/2021-and-2022/areas", 1), ("2021 and 2022", "vacant"): ("periods/2021-and-2022/vacant", 1)}
    for (cohort, _), (path, n) in got.items():
        read = spark.read.parquet(f"{root}/{path}")
        assert read.count() == n and {r.cohort for r in read.collect()} == {cohort} and read.columns == ["cohort", "n"]
    for bad, default in ((areas, "2023"), (areas.union(spark.createDataFrame([("../2024", 9)], areas.schema)), "2024")):
        with pytest.raises(ValueError):
            publish.write_periods({"areas": bad}, str(tmp_path / "other"), "cohort", default)
    assert not (tmp_path / "other").exists()


LATEST = {"id": "ctr-1", "name": "Bridge", "activity": "typical", "staleness": "fresh", "active": True, "count": 4, "expected": 4, "percentile": 50.0, "ratio": 1.0, "observationCount": 9, "observedAt": datetime(2026, 9, 1)}


@pytest.mark.parametrize(("changed", "rules"), [
    ({}, set()), ({"activity": "unavailable", "observedAt": None, "count": None, "percentile": None, "ratio": None}, set()), ({"id": None}, {"id has its pattern"}), ({"name": " "}, {"name is there and not too long"}), ({"activity": "crowded"}, {"activity is known"}),
    ({"staleness": None}, {"staleness is known"}), ({"active": None}, {"active is said"}), ({"expected": -1}, {"counts are not negative"}), ({"observationCount": None}, {"the number of observations is there"}), ({"observedAt": None}, {"an activity has an observation"}),
    ({"activity": "unavailable"}, {"an observation has an activity"}), ({"percentile": -0.1}, {"percentile is from 0 to 100"}), ({"ratio": float("nan")}, {"numbers are finite"}), ({"expected": 0}, {"no ratio to nothing"}),
])
def test_latest_rules(spark, changed, rules):
    schema = "id string, name string, activity string, staleness string, active boolean, count long, expected long, percentile double, ratio double, observationCount long, observedAt timestamp"
    assert broken(spark, [LATEST | changed, LATEST], schema, contracts.latest("^ctr-[0-9]+$")) == dict.fromkeys(rules, 1)


def test_limits_and_tallies(spark):
    df = spark.createDataFrame([("rising",), ("rising",), ("flat",)], "trend string")
    assert contracts.too_many(df, 3).count() == 0 and tuple(contracts.too_many(df, 2).first()) == (3, 2)
    claimed = spark.createDataFrame([("rising", 2), ("flat", 2), ("falling", 0)], "trend string, n long")
    assert [tuple(r) for r in contracts.tallies_differ(claimed, df, "trend").collect()] == [("flat", 2, 1)]


def test_drift_of_a_clean_source_is_none(spark):
    df = spark.createDataFrame([("{}", "3", None, "Bronx", "Y"), ("{}", "N/A", "0", "Bronx", "Y")], "the_geom string, may_07_am string, may_07_pm string, borough string, iex string")
    drift = lambda d: {(r.problem, r.name, r.n) for r in contracts.source_drift(d, ["may_07_am", "may_07_pm"], r"may_\d\d_(am|pm)", ["Bronx"], ["Bridges"], ["Y"]).collect()}
    assert drift(df) == set()
    assert drift(df.union(spark.createDataFrame([(None, "-1", "2", "Bridges", None)], df.schema))) == {("no geometry", "the_geom", 1), ("not a count", "may_07_am", 1), ("a group, not a borough", "Bridges", 1), ("unknown index value", "<empty>", 1)}
    assert drift(df.withColumnRenamed("may_07_pm", "may_08_pm")) == {("column not consumed", "may_08_pm", 1), ("column is gone", "may_07_pm", 1)}
