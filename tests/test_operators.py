import hashlib
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.operators import cohorts, counters, graph, identity, listing, quality, search, surveys, validate
from plinth.sources import publish, rows
from plinth.streaming import counts


def test_first_broken_rule_is_primary(spark):
    df = spark.createDataFrame([(1, None), (2, 50), (3, -1), (4, None)], "id long, v long")
    rules = [quality.Rule("missing", F.col("v").isNull()), quality.Rule("negative", F.col("v") < 0, F.col("v")), quality.Rule("odd_id", F.col("id") % 2 == 1)]
    kept, rejected = quality.split(df, rules)
    assert [r.id for r in kept.collect()] == [2]
    assert {(r.id, r.code, tuple(r.codes), r.detail) for r in rejected.collect()} == {(1, "missing", ("missing", "odd_id"), "missing"), (3, "negative", ("negative", "odd_id"), "negative: -1"), (4, "missing", ("missing",), "missing")}
    assert {tuple(r) for r in quality.report(df, rules).collect()} == {("missing", 2, 0), ("negative", 1, 0), ("odd_id", 0, 2)}


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_merge_does_not_depend_on_order(spark, parts):
    data = [("a", "s", "Sidewalk", "r2", None), ("a", "s", "Roadway", "r1", "x"), ("b", "s", "Sidewalk", "r3", ""), ("b", "s", "Sidewalk", "r4", "z"), ("c", "s", "Kiosk", "r5", "q")]
    df = spark.createDataFrame(data, "name string, street string, kind string, sid string, zip string").repartition(parts)
    got = {r.name: r for r in identity.merge_groups(df, ["name", "street"], "kind", {"Sidewalk": "sidewalk", "Roadway": "roadway"}, "both", F.col("sid"), ["zip"], "sid").collect()}
    assert got["a"].label == "both" and got["a"].source_ids == ["r1", "r2"] and got["a"].zip == "x"
    assert got["b"].label == "sidewalk" and got["b"].anomalies == ["repeated_kind", "zip_disagreement"] and got["b"].zip == "z"
    assert got["c"].label is None


def test_union_prefers_the_previous(spark):
    a, b = spark.createDataFrame([(1, "old")], "k long, v string"), spark.createDataFrame([(1, "new"), (2, "new")], "k long, v string")
    assert {tuple(r) for r in identity.union_dedup(a, b, ["k"], F.col("v")).collect()} == {(1, "old"), (2, "new")}


def test_identical_reports_are_numbered(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",)], "v string")
    assert sorted(r.occurrence for r in identity.numbered(df, F.sha2("v", 256), F.col("v")).collect()) == [1, 1, 2]


def test_components_of_a_chain(spark):
    nodes = spark.range(1, 41).withColumnRenamed("id", "node")
    edges = spark.range(1, 30).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.node: r.component for r in identity.components(nodes, edges).collect()}
    assert {got[i] for i in range(1, 31)} == {1} and all(got[i] == i for i in range(31, 41))


def test_band_join_finds_neighbours_only(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.9), (3, 1.95), (4, -0.5)], "n long, v double")
    assert {tuple(r) for r in identity.band_edges(df, "n", ["v"], 1.0).collect()} == {(1, 2), (1, 4)}


def reading(spark, values, now):
    start = datetime(2026, 9, 28, 1)
    data = [("c", "mon", start - timedelta(weeks=len(values) - i), v) for i, v in enumerate(values)] + [("c", "mon", start, now)]
    return spark.createDataFrame(data, "serial string, slot string, ts timestamp_ntz, v long")


@pytest.mark.parametrize(("now", "rank", "label"), [(99, 0, "quiet"), (115, 29, "typical"), (130, 50, "typical"), (135, 57, "typical"), (155, 86, "busy"), (160, 93, "veryBusy"), (161, 100, "veryBusy")])
def test_ladder(spark, now, rank, label):
    got = counters.leave_one_out(reading(spark, [100, 110, 120, 130, 140, 150, 160], now), "serial", ["slot"], "ts", "v").withColumn("a", counters.activity(F.col("percentile"), F.col("expected"), F.col("reading"), F.col("n"))).first()
    assert (got.n, got.expected, int(got.percentile + 0.5)) == (7, 130, rank)
    assert got.a == (label if now != 115 else "typical")


def test_baseline_numbers(spark):
    h = spark.createDataFrame([("c", v) for v in (100, 110, 120, 130, 140, 150, 160)], "k string, v long")
    b = counters.baseline(h, ["k"], "v").first()
    assert (b.n, b.expected, b.p25, b.p75, round(b.p90, 6)) == (7, 130, 115, 145, 154)
    assert h.limit(1).select(counters.ratio(F.lit(135), F.lit(130))).first()[0] == 1.038


def test_few_samples_and_no_baseline(spark):
    f = lambda *a: spark.range(1).select(counters.activity(*(F.lit(x) if x is not None else F.lit(None).cast("double") for x in a))).first()[0]
    assert f(50.0, 10, 5, 6) == "unavailable" and f(50.0, 0, 0, 9) == "quiet" and f(50.0, 0, 3, 9) == "unavailable" and f(None, 1, 1, 9) == "unavailable"


def test_fold_needs_every_leg(spark):
    data = [("a", "in", 1), ("a", "out", 2), ("b", "in", 5), ("c", "in", 1), ("c", "out", None)]
    got = {r.k: r.total for r in counters.fold_directions(spark.createDataFrame(data, "k string, d string, v long"), ["k"], "d", "v").collect()}
    assert got == {"a": 3, "b": None, "c": None}


def test_fault_run(spark):
    days = [("a", f"2026-09-{d:02d}", n) for d, n in ((1, 4), (2, 0), (3, 0), (5, 0))] + [("b", "2026-09-05", 3)]
    df = spark.createDataFrame(days, "k string, day string, n long").withColumn("day", F.to_date("day"))
    run = lambda **x: {r.k: r.fault_days for r in counters.fault_runs(df, "k", "day", F.col("n") > 0, F.col("n").isNull(), **x).collect()}
    assert run() == {"a": 3, "b": 0} and run(gap_ends=True) == {"a": 1, "b": 0}


def test_staleness(spark):
    df = spark.createDataFrame([(1.0,), (30.0,), (31.0,), (169.0,), (None,)], "h double")
    assert [r[0] for r in df.select(counters.staleness(F.col("h"))).collect()] == ["fresh", "fresh", "stale", "offline", "unavailable"]


@pytest.mark.parametrize(("last", "want"), [(200, "rising"), (110, "flat"), (115, "flat"), (116, "rising"), (84, "falling"), (85, "flat")])
def test_trend(spark, last, want):
    assert spark.range(1).select(surveys.trend(F.lit(last - 100), F.lit(100))).first()[0] == want


def test_surveys_from_wide_columns(spark):
    df = spark.createDataFrame([(1, "10", "", "0", "30", None, "40")], "site long, may_07_am string, may_07_md string, may_07_pm string, may25_am string, may_25_md string, may_25_p_m string")
    cols = surveys.survey_columns(df.columns)
    assert len(cols) == 6
    long = surveys.to_rows(df, ["site"], cols).withColumn("value", F.col("value").try_cast("int"))
    got = {(r.year, r.am, r.md, r.pm, r.total, r.complete) for r in surveys.surveys(long, ["site"]).collect()}
    assert got == {(2007, 10, None, 0, 10, False), (2025, 30, None, 40, 70, False)}


def test_search_tiers(spark):
    df = spark.createDataFrame([(1, "Café"), (2, "Cafe Luna"), (3, "The Cafe"), (4, "Decafe"), (5, "Bar")], "id long, name string")
    got = [(r.id, r.score) for r in search.search(df, "CAFÉ", ["name"], "name", "id").collect()]
    assert got == [(1, 400), (2, 311), (3, 200), (4, 100)]
    assert search.search(df, "cafe luna", ["name"], "name", "id").first().score == 200


def test_listing_without_origin_is_empty(spark):
    df = spark.createDataFrame([(1, 40.7, -74.0)], "id long, lat double, lon double")
    assert listing.rows(df, listing.Query(sort="nearby"), "id", {"nearby": [F.col("miles")]}).count() == 0
    assert listing.matches({"a": "all"}) is None


def test_share_needs_support(spark):
    df = spark.createDataFrame([("2023", 1, "vacant", True), ("2023", 1, "nonVacant", False), ("2024", 1, "vacant", True)], "cohort string, area long, status string, m boolean")
    cells = cohorts.area_cells(df, ["cohort", "area"], ["status"], F.col("m"))
    got = {r.cohort: r.share for r in cohorts.share(cells, ["cohort", "area"], "status", cohorts.coverage(df, "cohort", "status", F.lit(True), F.col("m")), "cohort").collect()}
    assert got == {"2023": 50.0, "2024": None}


def test_mutations_are_refused(spark):
    want = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    good = spark.createDataFrame([(1, "x")], want)
    assert validate.schema_problems(good, want) == []
    assert validate.schema_problems(good.select("b", "a"), want) and validate.schema_problems(good.drop("b"), want) and validate.schema_problems(good.withColumn("a", F.col("a").cast("int")), want)
    report = validate.run_checks(good, [validate.Check("a", F.col("a") < 0), validate.Check("b", F.col("b") == "x", validate.WARNING)])
    assert not validate.refuses(report) and validate.refuses(report, strict=True)


def test_window_is_always_bounded(spark):
    now = datetime(2026, 9, 28)
    assert rows.resolve_window(now).start == now - timedelta(days=56)
    assert rows.resolve_window(now, watermark=now).start == now - timedelta(minutes=30)
    with pytest.raises(ValueError):
        rows.resolve_window(now, since=now)
    with pytest.raises(ValueError):
        rows.window_scan(spark.range(1), "id", rows.resolve_window(now), ["id"], {})


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = rows.window_scan(df, "ts", rows.resolve_window(datetime(2024, 1, 12), since=datetime(2024, 1, 5)), ["user_id", "value"], {"event_type": "click"})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(" in plan and "props" not in plan.split("ReadSchema")[1]


def test_publish_swaps_or_leaves(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(3)
    ok = lambda d: []
    assert publish.publish(spark, df, path, ok, "h1") == "published"
    assert publish.publish(spark, df, path, ok, "h1", "h1") == "unchanged"
    with pytest.raises(ValueError):
        publish.publish(spark, spark.range(9), path, lambda d: ["bad"], "h2", "h1")
    assert spark.read.parquet(path).count() == 3
    assert publish.publish(spark, spark.range(5), path, ok, "h3", "h1") == "published"
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(ValueError):
        publish.write_cohorts(spark.createDataFrame([("x",)], "y string"), str(tmp_path / "c"), "y")


def test_features_keep_nulls(spark):
    df = spark.createDataFrame([("b", -74.0, 40.7, None)], "id string, lon double, lat double, zip string")
    assert publish.features(df, "id", "lon", "lat", ["zip"]).first().json == '{"type":"Feature","id":"b","geometry":{"type":"Point","coordinates":[-74.0,40.7]},"properties":{"zip":null}}'


def test_json_rows(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"a": "1", "b": null}, {"a": "2", "c": 4}]')
    assert [tuple(r) for r in rows.json_rows(spark, str(tmp_path / "r.json"), ["a", "b"]).collect()] == [("1", None), ("2", None)]
    (tmp_path / "s.json").write_text('[{"x":null},{"x":1},{"y":2},3]')
    assert [tuple(r) for r in rows.json_rows(spark, str(tmp_path / "s.json"), ["x"], strict=False).collect()] == [(None,), ("1",), (None,)]
    (tmp_path / "o.json").write_text('{"x": 1}')
    for name in ("s.json", "o.json"):
        with pytest.raises(Exception, match="not a JSON"):
            rows.json_rows(spark, str(tmp_path / name), ["x"]).collect()
    assert rows.json_rows(spark, str(tmp_path / "o.json"), ["x"], strict=False).count() == 0
    assert rows.adopted(spark, str(tmp_path / "r.json"), ["a"], hashlib.sha256((tmp_path / "r.json").read_bytes()).hexdigest()).count() == 2
    with pytest.raises(ValueError):
        rows.adopted(spark, str(tmp_path / "r.json"), ["a"], "0" * 64)


def test_leave_one_out_keeps_keys_without_history(spark):
    day = lambda d: datetime(2026, 1, 1) + timedelta(days=d)
    data = [("a", 0, day(0), 5), ("a", 0, day(100), None), ("b", 0, day(99), 4), ("b", 0, day(100), 6), ("c", 0, day(3), 1)]
    got = {r.k: (r.reading, r.n, r.percentile) for r in counters.leave_one_out(spark.createDataFrame(data, "k string, slot int, ts timestamp, v long"), "k", ["slot"], "ts", "v").collect()}
    assert got == {"a": (None, 0, None), "b": (6, 1, 100.0), "c": (1, 0, None)}


def test_components_of_a_shuffled_chain(spark):
    ids = list(range(20_000))
    random.Random(5).shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)) + [(50_000, 50_000)], "a long, b long")
    assert sorted((r.component, r["count"]) for r in graph.components(df).groupBy("component").count().collect()) == [(0, 20_000), (50_000, 1)]


def test_ambiguous_groups_are_rejected(spark):
    df = spark.createDataFrame([(1, "x", "s"), (2, "x", "s"), (3, "y", "s"), (4, "y", "r"), (5, "z", None)], "sid long, name string, kind string")
    clear, rejected = identity.ambiguous_groups(df, ["name"], "kind", ["s", "r"])
    assert sorted(r.sid for r in clear.collect()) == [1, 2, 3, 4]
    assert [(r.code, r.name) for r in rejected.collect()] == [("ambiguous_group", "z")]
    points = spark.createDataFrame([("a", 1, 1.0, None), ("a", 2, 2.0, 20.0), ("a", 3, 3.0, 30.0)], "k string, i long, lat double, lon double")
    assert [tuple(r) for r in identity.point_of_first(points, ["k"], F.col("i")).collect()] == [("a", 2.0, 20.0)]


def test_stream_drops_overlap(spark, tmp_path):
    data = [("s", "in", datetime(2026, 9, 28, 1, 0), 5), ("s", "in", datetime(2026, 9, 28, 1, 0), 5), ("s", "in", datetime(2026, 9, 28, 1, 20), 7)]
    schema = "k string, d string, ts timestamp, v long"
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "in"))
    stream = counts.deduplicated(counts.source(spark, str(tmp_path / "in"), T._parse_datatype_string(schema)), ["k", "d", "ts"], "ts")
    out = counts.run_available(stream, str(tmp_path / "left"))
    assert out.count() == 2
    got = counts.run_available(counts.grid(stream, ["k"], "ts", "v"), str(tmp_path / "grid"))
    assert got.count() == 0  # the watermark has not passed a window yet
    spark.createDataFrame([("s", "in", datetime(2026, 9, 28, 3, 0), 1), ("s", "out", datetime(2026, 9, 28, 0, 10), 9)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    got = counts.run_available(counts.grid(stream, ["k"], "ts", "v"), str(tmp_path / "grid"))
    assert sorted((r.slot.minute, r.n, r.total) for r in got.collect()) == [(0, 1, 5), (15, 1, 7)]  # and the late row is dropped


def test_fault_state_goes_on_over_runs(spark, tmp_path):
    schema, day = "key string, day date, total long", lambda d: date(2026, 9, d)
    batches = [[("a", day(1), 5), ("a", day(2), 0), ("b", day(1), 0)], [("a", day(3), 0), ("a", day(1), 9), ("b", day(2), None), ("c", day(9), 0)], [("b", day(3), 0), ("b", day(4), 0)]]
    want = [{"a": 1, "b": 1}, {"a": 2, "b": 0, "c": 1}, {"a": 2, "b": 2, "c": 1}]
    for rows_, expected in zip(batches, want, strict=True):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = counts.source(spark, str(tmp_path / "in"), T._parse_datatype_string(schema))
        got = counts.run_updates(counts.fault_state(stream), str(tmp_path / "out"), ["key"], "day")
        assert {r.key: r.fault_days for r in got.collect()} == expected


def test_key_difference_joins_nothing(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,), (5,)], "k int")
    b = spark.createDataFrame([(2,), (3,), (3,), (None,), (None,), (2**40,)], "k long")
    got = validate.key_difference(a, b, "k", ("a", "b"))
    assert sorted(((r.k or -1, r.only_in) for r in got.collect())) == [(-1, "a"), (-1, "b"), (1, "a"), (3, "b"), (5, "a"), (2**40, "b")]
    assert dict(got.dtypes) == {"k": "bigint", "only_in": "string"}
    # one map of the keys a task: the joins of distinct keys held them four times, in two maps and two sorts
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan
