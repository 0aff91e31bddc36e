"""Refusals, rejections and single records."""

import random

import pytest
from pyspark.sql import functions as F

from plinth.functions import parse
from plinth.operators import identity, listing, profile, quality, sensors, surveys
from plinth.sources import rows


def test_repeated_keys_are_fatal(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    assert identity.unique(df, ["k", "v"]).count() == 3
    with pytest.raises(ValueError, match="k not unique: 1"):
        identity.unique(df, ["k"])


def test_a_sensor_of_two_counters_is_fatal(spark):
    good = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t")], "id long, serial string")
    assert sensors.unambiguous(good).count() == 3
    with pytest.raises(ValueError, match=r"\[3\]"):
        sensors.unambiguous(good.union(spark.createDataFrame([(3, "u")], good.schema)))


def test_collisions_are_fatal_and_repeats_are_counted(spark):
    df = spark.createDataFrame([("d1", "x"), ("d1", "x"), ("d1", "x"), ("d2", "y")], "digest string, r string")
    assert tuple(identity.occurrence_report(df, F.col("r")).first()) == (2, 2, 0)
    with pytest.raises(ValueError, match="1 digests"):
        identity.without_collisions(df.union(spark.createDataFrame([("d2", "z")], df.schema)), F.col("r"))
    assert tuple(identity.occurrence_report(df.limit(0), F.col("r")).first()) == (0, 0, 0)


def test_union_report(spark):
    a, b = (spark.createDataFrame([(k,) for k in ks], "k long") for ks in ([1, 2, 2], [2, 3, 3, 3]))
    assert tuple(identity.union_report(a, b, ["k"]).first()) == (3, 4, 3, 4) and tuple(identity.union_report(a.limit(0), b.limit(0), ["k"]).first()) == (0, 0, 0, 0)


@pytest.mark.parametrize(("loc", "street", "geometry", "codes"), [
    ("1", "A St", '{"type":"Point","coordinates":[-74.0,40.7]}', []), (" ", "A St", '{"type":"Point","coordinates":["-74.0","40.7"]}', ["missing_identity"]), ("1", "N/A", None, ["missing_identity", "missing_geometry"]),
    ("1", "A", '{"type":"Polygon","coordinates":[]}', ["unsupported_geometry"]), ("1", "A", "not json", ["unsupported_geometry"]), ("1", "A", '{"type":"Point","coordinates":[-74.0]}', ["unparseable_coordinates"]),
    ("1", "A", '{"type":"Point","coordinates":[-74.0,"x"]}', ["unparseable_coordinates"]), ("1", None, '{"type":"Point","coordinates":[-74.0,10]}', ["missing_identity", "out_of_bounds"]), ("1", "A", '{"type":"Point"}', ["unparseable_coordinates"]),
])
def test_site_rules(spark, loc, street, geometry, codes):
    df = spark.createDataFrame([(loc, street, geometry)], "loc string, street string, geometry string")
    assert quality.with_codes(df, surveys.site_rules()).first().codes == codes


def test_positions_are_rounded_or_have_a_code(spark):
    df = spark.createDataFrame([("40.123456789", "-73.98765432"), ("91", "0"), ("0", "0"), (None, "1"), ("x", "1")], "a string, b string")
    a, b, code = parse.world_position(F.col("a"), F.col("b"))
    assert [tuple(r) for r in df.select(a, b, code).collect()] == [(40.1234568, -73.9876543, None), (None, None, "invalid_coordinates"), (None, None, "zero_coordinates"), (None, None, "missing_coordinates"), (None, None, "invalid_coordinates")]


def test_only_ids_of_the_pattern_are_looked_for(spark):
    df = spark.createDataFrame([("ab-12", 1), ("zz", 2)], "id string, v long")
    found = lambda i: [r.v for r in listing.detail(df, "id", i, pattern="ab-[0-9]+").collect()]
    assert found("ab-12") == [1] and found("zz") == [] and found("ab-12\n") == [] and found("ab-" + "1" * 70) == [] and listing.detail(df, "id", "zz").first().v == 2


def test_most_surveyed_and_newest(spark):
    df = spark.createDataFrame([(1, 5, 2, 2020, "a"), (2, None, 9, 2021, "b"), (3, 9, 1, 2021, "c"), (4, 5, 3, None, "d"), (5, 5, 2, 2019, "e")], "id long, total long, years_measured long, last_year int, label string")
    assert [r.id for r in listing.rows(df, listing.Query(sort="m"), "id", {"m": listing.most_surveyed()}).collect()] == [3, 4, 1, 5, 2]
    assert tuple(surveys.newest_label(df, "label").first()) == ("b", 2021) and tuple(surveys.newest_label(df.limit(0), "label").first()) == (None, None)


def test_change_profile(spark):
    df = spark.createDataFrame([(0.1,), (-0.3,), (0.2,), (None,)], "change double")
    assert tuple(surveys.change_profile(df).first()) == (3, 0.2, pytest.approx(0.25))


def test_disagreements_and_odd_coordinates(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", "x"), (2, "a", "x"), (2, "a", "y"), (2, "a", "y"), (3, "z", "z")], "k long, p string, q string")
    assert {tuple(r) for r in profile.disagreements(df, ["k"], ["p", "q"]).collect()} == {("p", 1, 0), ("q", 0, 1)}
    at = spark.createDataFrame([(1, " 40.7 ", "-74"), (2, "x", "-74"), (3, None, "1"), (4, "50", "-74"), (5, "", "-74")], "k long, lat string, lon string")
    assert {(r.k, r.problem) for r in profile.odd_coordinates(at, "k", "lat", "lon", (40, 41, -75, -73)).collect()} == {(2, "unparseable"), (3, "missing"), (4, "outside"), (5, "unparseable")}


def test_budgets_and_counts_refuse(spark):
    df = spark.range(5)
    assert rows.within_budget(df, 5) is df and rows.reconciled(df, 5) is df
    with pytest.raises(ValueError):
        rows.within_budget(df, 4)
    with pytest.raises(ValueError):
        rows.reconciled(df, 6)


@pytest.mark.parametrize(("dims", "spread", "one_task"), [(1, 30.0, 200_000), (2, 6.0, 200_000), (2, 2.0, 200_000), (2, 6.0, 0), (2, 0.3, 200_000)])
def test_few_links_have_the_components_of_all_pairs(spark, monkeypatch, dims, spread, one_task):
    rng = random.Random(dims * 7 + int(spread))
    monkeypatch.setattr(identity.graph, "ONE_TASK", one_task)
    rows = [(i, rng.uniform(-spread, spread), rng.uniform(-spread, spread)) for i in range(130)] + [(200, 1.0, None), (201, 0.5, 0.5), (202, 0.5, 0.5), (203, -0.5, 1.5)]
    df = spark.createDataFrame(rows, "n long, x double, y double").repartition(3)
    links = identity.band_links(df, "n", ["x", "y"][:dims], 0.5)
    got = {r.node: r.component for r in identity.components(df, links, "n").collect()}
    near = lambda p, q: all(a is not None and b is not None and abs(a - b) <= 0.5 for a, b in zip(p[1 : dims + 1], q[1 : dims + 1], strict=True))
    want = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for p in rows:
            for q in rows:
                if near(p, q) and want[q[0]] < want[p[0]]:
                    want[p[0]], changed = want[q[0]], True
    assert got == want and links.count() <= 4 * len(rows)
    # every link is a pair of the band
    by = {r[0]: r for r in rows}
    assert all(near(by[r.a], by[r.b]) for r in links.collect())


def test_components_of_texts(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("é", "z"), ("x", "x"), (None, "a")], "a string, b string")
    nodes = spark.createDataFrame([(n,) for n in ("a", "b", "c", "x", "z", "é", "lone")], "node string")
    assert {r.node: r.component for r in identity.components(nodes, edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "z": "z", "é": "z", "lone": "lone"}
    assert {r.node: r.component for r in identity.components(nodes, edges.limit(0)).collect()} == {n: n for n in ("a", "b", "c", "x", "z", "é", "lone")}
