from datetime import date, datetime

from pyspark.sql import functions as F

from plinth.functions import geo, ids, parse, text
from plinth.operators import search


def one(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'bigint'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(*columns).first()


def test_text_is_squeezed_and_spellings_of_nothing_are_null(spark):
    df = spark.createDataFrame([(" A \t B\n",), ("N/A",), ("null",), ("-",), ("na",), (" x y ",), (None,)], "t string")
    assert [r[0] for r in df.select(text.normalise_text(F.col("t"))).collect()] == ["A B", None, None, None, "na", "x y", None]
    assert [r[0] for r in df.select(text.nullish(F.col("t"))).collect()] == [False, True, True, True, False, False, False]


def test_dates_are_days_or_null(spark):
    df = spark.createDataFrame([("2026-06-12T14:19:32.000",), ("2026-02-30",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(parse.calendar_date(F.col("t"))).collect()] == [date(2026, 6, 12), None, None, None]


def test_counts_keep_zero_apart_from_nothing(spark):
    df = spark.createDataFrame([("0",), ("12.9",), ("-1",), ("",), ("inf",), ("1_000",), ("1.0f",), (None,)], "t string")
    assert [r[0] for r in df.select(parse.count(F.col("t"))).collect()] == [0, 12, None, None, None, None, None, None]


def test_points_say_why_they_are_refused(spark):
    df = spark.createDataFrame([("40.7", "-74"), ("0", "0.0"), ("abc", "1"), ("95", "1"), (None, "1")], "a string, b string")
    assert [r[0] for r in df.select(parse.world_point(F.col("a"), F.col("b"))).collect()] == [None, "zero_coordinates", "invalid_coordinates", "invalid_coordinates", "missing_coordinates"]


def test_geojson_points(spark):
    df = spark.createDataFrame([('{"type":"Point","coordinates":[-74.0,40.7]}',), ('{"type":"Line","coordinates":[1.0,2.0]}',), ('{"type":"Point","coordinates":[1.0]}',), (None,)], "g string")
    lat, lon, code = parse.geojson_point(F.col("g"))
    assert [tuple(r) for r in df.select(lat, lon, code).collect()] == [(40.7, -74.0, None), (None, None, "not_a_point"), (None, None, "short_coordinates"), (None, None, "missing_geometry")]


def test_civil_time_takes_the_first_of_two_instants(spark):
    df = spark.createDataFrame([("2026-07-01T12:00:00.000",), ("2026-01-15T12:00:00",), ("2026-11-01T01:30:00",), ("bad",)], "t string")
    got = [r[0] for r in df.select(parse.utc_text(parse.civil_to_utc(parse.civil_time(F.col("t"))))).collect()]
    assert got == ["2026-07-01T16:00:00Z", "2026-01-15T17:00:00Z", "2026-11-01T05:30:00Z", None]


def test_time_keys(spark):
    df = spark.createDataFrame([(datetime(2026, 9, 28, 1, 44),)], "t timestamp_ntz")
    assert tuple(df.select(parse.bucket_key(F.col("t")), parse.day_key(F.col("t"))).first()) == ("01:30", "mon")


def test_distance_and_its_text(spark):
    r = one(spark, geo.haversine_miles(F.lit(40.7), F.lit(-74.0), F.lit(40.8), F.lit(-74.0)))
    assert abs(r[0] - 6.909) < 0.01
    df = spark.createDataFrame([(0.05,), (0.34,), (-1.0,), (None,)], "m double")
    assert [x[0] for x in df.select(geo.distance_text(F.col("m"))).collect()] == ["260 ft", "0.3 mi", None, None]


def test_boxes_take_the_first_match(spark):
    df = spark.createDataFrame([(40.80, -73.92), (40.75, -73.95), (10.0, 10.0)], "lat double, lon double")
    assert [r[0] for r in df.select(geo.first_box(F.col("lat"), F.col("lon"))).collect()] == ["Bronx", "Manhattan", None]
    assert df.where(geo.in_box(F.col("lat"), F.col("lon"), None)).count() == 3


def test_extent_of_a_point_is_nothing(spark):
    df = spark.createDataFrame([(40.7, -74.0)], "lat double, lon double")
    assert geo.extent(df).first().west is None
    assert geo.extent(df, degenerate=True).first().west == -74.0


def test_hash_does_not_depend_on_order(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    digest = ids.row_digest(F.col("id"), F.col("v"))
    hashes = {ids.content_hash(df.repartition(n), digest).first().content_hash for n in (1, 3, 17)}
    assert len(hashes) == 1
    assert ids.content_hash(df.where("id < 999"), digest).first().content_hash not in hashes


def test_licence_period_and_counts(spark):
    df = spark.createDataFrame([(date(2026, 6, 12), None), (None, None)], "a date, b date")
    assert [r[0] for r in df.select(text.licence_period(F.col("a"), F.col("b"))).collect()] == ["Issued Jun 12, 2026", "Licence dates not published"]
    df = spark.createDataFrame([(1,), (1234,)], "n long")
    assert [r[0] for r in df.select(text.counted(F.col("n"), "place")).collect()] == ["1 place", "1,234 places"]


def test_folding_and_text_of_other_types(spark):
    df = spark.createDataFrame([("Šariš bar", True, 3.0, 2.5), ("Sˇ c\u030cafe\u0301", False, None, -1.0)], "t string, b boolean, d double, e double")
    assert [r[0] for r in df.select(text.search_fold(F.col("t"))).collect()][0] == "saris bar"
    assert search.search(df.limit(1), "Šariš", ["t"], "t", "d").count() == search.search(df.limit(1), "saris", ["t"], "t", "d").count() == 1
    got = df.select(*(text.normalise_text(F.col(c)) for c in "bde")).collect()
    assert [tuple(r) for r in got] == [(None, "3", "2.5"), (None, None, "-1")]
