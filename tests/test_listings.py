"""Order of names, labels at ties, folding of syllables, nearest neighbours against brute force."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from plinth.functions import geo, text
from plinth.operators import nearest, publication, search


def test_names_are_in_the_order_of_names(spark):
    want = ["a", "A", "ab", "b", "cafe", "café", "Cafe", "e", "É", "zoo", "Zoo a"]
    names = random.Random(1).sample(want, len(want))
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(3)
    got = [r.name for r in df.orderBy(text.in_name_order(F.col("name"))).collect()]
    assert [n.lower().replace("é", "e") for n in got] == [n.lower().replace("é", "e") for n in want]
    assert got.index("a") < got.index("A") < got.index("b") < got.index("e") < got.index("É") and got.index("cafe") < got.index("Cafe") < got.index("café")
    assert [r.name for r in df.orderBy(text.in_name_order(F.col("name"))).limit(4).collect()] == ["a", "A", "ab", "b"]


@pytest.mark.parametrize(("n", "label"), [(0, "0"), (999, "999"), (1000, "1k"), (1049, "1k"), (1050, "1.1k"), (1150, "1.2k"), (1234, "1.2k"), (9949, "9.9k"), (9950, "10k"), (9999, "10k"), (10499, "10k"), (15_500, "16k"), (15_600, "16k"), (1_000_000, "1000k")])
def test_abbreviated_counts(spark, n, label):
    assert spark.range(1).select(geo.abbreviated(F.lit(n))).first()[0] == label


def test_distances_round_the_exact_value(spark):
    rng = random.Random(4)
    miles = [0.1, 0.25, 0.35, 0.75, 1.05, 1.25, 1.45, 1.75, 2.5, 8.95, 9.95, 99.95, 0.15, 0.3, 0.29999999999999993] + [rng.randrange(1, 4000) / 20 for _ in range(300)]
    df = spark.createDataFrame([(m,) for m in miles], "m double")
    for m, got in df.select("m", geo.distance_text(F.col("m")).alias("t")).collect():
        assert got == (f"{Decimal(m).quantize(Decimal('0.1'), ROUND_HALF_UP)} mi" if m >= 0.1 else got), m
    got = {r.m: r.t for r in spark.createDataFrame([(1.45,), (0.05,), (-1.0,), (None,)], "m double").select("m", geo.distance_text(F.col("m")).alias("t")).collect()}
    assert got == {1.45: "1.4 mi", 0.05: "260 ft", -1.0: None, None: None}


def test_search_finds_syllables_by_their_letters(spark):
    df = spark.createDataFrame([(1, "한국 식당"), (2, "하나"), (3, "Bar 한"), (4, "Café"), (5, None)], "id long, name string")
    found = lambda q: [r.id for r in search.search(df, q, ["name"], "name", "id").collect()]
    assert found("한국") == [1] and found("한") == [1, 3] and set(found("하")) == {1, 2, 3} and found("CAFE") == found("café") == [4]


def test_points_hold_vacant_places_only(spark):
    df = spark.createDataFrame([("2023", s, None, "Bronx") for s in ("vacant", "nonVacant", "unknown")], "cohort string, status string, construction boolean, borough string")
    assert [r.status for r in publication.reports(df, "2023", "both").collect()] == ["vacant"]
    assert publication.reports(df, "2023", "both", points=False).count() == 3 and publication.reports(df, "2023", "nonVacant").count() == 0


@pytest.mark.parametrize(("most", "spread"), [(32, 1.0), (1, 1.0), (1, 0.0), (2, 1e-9)])
def test_nearest_agrees_with_brute_force(spark, monkeypatch, most, spread):
    monkeypatch.setattr(nearest, "MOST", most)
    rng = random.Random(11)
    near = lambda: (rng.gauss(3, 1) * (spread if rng.random() < 0.5 else 1), rng.gauss(-2, 5) * (spread if rng.random() < 0.5 else 1))
    right = [(i, *near()) for i in range(150)]
    right += [(500 + i, *right[i][1:]) for i in range(20)] + [(900, None, 1.0)]
    left = [(i, *near()) for i in range(120)] + [(1000, 900.0, -900.0), (1001, *right[7][1:]), (1002, 0.0, None)]
    r = spark.createDataFrame(right, "b long, x double, y double")
    got = {x.a: (x.b, x.distance) for x in nearest.nearest(spark.createDataFrame(left, "a long, x double, y double"), r, "a", "b").collect()}
    assert set(got) == {k for k, x, y in left if y is not None}
    for k, x, y in left:
        if y is not None:
            d, b = min(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in right if u is not None)
            assert got[k][0] == b and math.isclose(got[k][1], math.sqrt(d), abs_tol=1e-12)
    assert nearest.nearest(spark.createDataFrame(left, "a long, x double, y double"), r.limit(0), "a", "b").count() == 0
