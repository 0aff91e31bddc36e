"""Retention with late rows, restarts and repeated batches; the watermark sidecar; freshness by timers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plinth.streaming import counts, freshness, retention

SCHEMA = "key string, ts timestamp, v long"
START = datetime(2026, 9, 1)


def at(days, hours=0):
    return START + timedelta(days=days, hours=hours)


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def table(folder, days=56):
    return retention.Retained(f"{folder}/table", ("key", "ts"), "ts", ("v",), days)


def run(spark, folder, days=56):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    return {(r.key, r.ts): r.v for r in retention.run_retained(stream, table(folder, days), f"{folder}/state").collect()}


def test_first_wins_and_old_days_leave(spark, tmp_path):
    f = str(tmp_path)
    land(spark, f"{f}/in", [("a", at(0), 1), ("a", at(0), 9), ("a", at(10), 2), ("b", None, 3)])
    assert run(spark, f) == {("a", at(0)): 1, ("a", at(10)): 2}
    # a repeat, a late row inside of the retention, a new one
    land(spark, f"{f}/in", [("a", at(10), 7), ("b", at(1), 4), ("a", at(55), 5)])
    assert run(spark, f) == {("a", at(0)): 1, ("a", at(10)): 2, ("b", at(1)): 4, ("a", at(55)): 5}
    # the newest moves on: two days leave, and what comes for them is refused
    land(spark, f"{f}/in", [("a", at(58), 6)])
    assert set(run(spark, f)) == {("a", at(10)), ("a", at(55)), ("a", at(58))}
    land(spark, f"{f}/in", [("b", at(1), 8), ("b", at(2), 8), ("b", at(3), 8)])
    assert run(spark, f) == {("a", at(10)): 2, ("a", at(55)): 5, ("a", at(58)): 6, ("b", at(2)): 8, ("b", at(3)): 8}
    told = {r.batch: tuple(r)[1:6] for r in table(f).sidecar(spark).collect()}
    assert told == {0: (4, 1, 0, 1, 2), 1: (3, 1, 0, 0, 2), 2: (1, 0, 0, 0, 1), 3: (3, 0, 1, 0, 2)}
    days = {d.getName() for b in retention._folders(spark, f"{f}/table/rows") for d in retention._folders(spark, b.toString())}
    assert "day=2026-09-01" not in days and "day=2026-09-02" not in days and "day=2026-09-03" in days


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    kept = table(str(tmp_path))
    first, second = (spark.createDataFrame(rows, SCHEMA) for rows in ([("a", at(0), 1), ("b", at(1), 2)], [("a", at(0), 5), ("c", at(2), 3)]))
    kept.merge(first, 0)
    for _ in range(2):
        kept.merge(second, 1)
        assert {tuple(r) for r in kept.rows(spark, first.schema).collect()} == {("a", at(0), 1), ("b", at(1), 2), ("c", at(2), 3)}
        assert {r.batch: r.written for r in kept.sidecar(spark).collect()} == {0: 2, 1: 1}


def test_the_next_read_starts_at_the_watermark_less_the_overlap(spark, tmp_path):
    f, source = str(tmp_path), [(k, at(0, h), h) for h in range(200) for k in ("a", "b")]
    assert table(f).window(spark, at(0, 100)).start == at(0, 100) - timedelta(days=56)
    df, got = spark.createDataFrame(source, SCHEMA), {}
    for n, now in enumerate((at(0, 100), at(0, 150), at(0, 150), at(0, 201))):
        w = table(f).window(spark, now)
        table(f).merge(df.where((F.col("ts") >= F.lit(w.start)) & (F.col("ts") < F.lit(w.end))), n)
        got = {(r.key, r.ts): r.v for r in table(f).rows(spark, df.schema).collect()}
    # no gap and nothing twice
    assert got == {(k, t): v for k, t, v in source}
    assert [r.repeats for r in table(f).sidecar(spark).orderBy("batch").collect()] == [0, 2, 2, 2]
    assert table(f).window(spark, at(30)).start == at(0, 199) - timedelta(minutes=30)


def test_an_empty_batch(spark, tmp_path):
    kept = table(str(tmp_path))
    kept.merge(spark.createDataFrame([], SCHEMA), 0)
    assert kept.watermark(spark) is None and kept.rows(spark, spark.createDataFrame([], SCHEMA).schema).count() == 0
    kept.merge(spark.createDataFrame([("a", at(1), 1)], SCHEMA), 1)
    kept.merge(spark.createDataFrame([], SCHEMA), 2)
    assert kept.rows(spark, spark.createDataFrame([], SCHEMA).schema).count() == 1


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", freshness.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_silent_counters_turn_stale_and_offline_over_restarts(spark, tmp_path, rocks):
    f = str(tmp_path)

    def states(rows):
        land(spark, f"{f}/in", rows)
        stream = spark.readStream.schema(SCHEMA).parquet(f"{f}/in")
        got = counts.run_updates(freshness.freshness(stream, "key", "ts"), f"{f}/out", ["key"], "at").collect()
        return {r.key: (r.state, r.seen) for r in got}

    assert states([("a", at(0), 1), ("b", at(0), 1), ("b", at(0, -5), 1), (None, at(0), 1)]) == {"a": ("fresh", at(0)), "b": ("fresh", at(0))}
    # b goes on and drives the watermark; a says nothing
    assert states([("b", at(0, 30), 1)]) == {"a": ("fresh", at(0)), "b": ("fresh", at(0, 30))}
    assert states([("b", at(0, 31), 1)]) == {"a": ("stale", at(0)), "b": ("fresh", at(0, 31))}
    assert states([("b", at(8), 1)]) == {"a": ("offline", at(0)), "b": ("fresh", at(8))}
    assert states([("a", at(9), 1)])["a"] == ("fresh", at(9))
    assert states([("c", at(30), 1)]) == {"a": ("offline", at(9)), "b": ("offline", at(8)), "c": ("fresh", at(30))}
