"""Sliding percentiles against exact ones of every window; civil days around both changes of the clock."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.operators import counters, sliding
from plinth.plans import queries as plans
from tests.oracle import assert_same, duck


def test_kth_of_every_range():
    rng = np.random.default_rng(3)
    for size, kinds in ((1, 1), (7, 2), (200, 9), (500, 100_000)):
        v = rng.integers(-kinds, kinds, size)
        a = rng.integers(0, size, 300)
        b = np.minimum(size, a + rng.integers(1, size + 1, 300))
        k = rng.integers(0, b - a)
        got = sliding.kth_in_ranges(v, a, b, [k, np.zeros_like(k)])
        assert got[0].tolist() == [int(np.sort(v[x:y])[z]) for x, y, z in zip(a, b, k, strict=True)]
        assert got[1].tolist() == [int(v[x:y].min()) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize(("days", "groups"), [(1, 1), (56, 1), (56, 256)])
def test_trailing_is_the_exact_percentile(spark, monkeypatch, days, groups):
    monkeypatch.setattr(sliding, "GROUPS", groups)
    rng = random.Random(5)
    rows = [("a", rng.randrange(0, 200 * 86400) if rng.random() < 0.9 else 86400, rng.choice([0, 1, 5, 5, 40, 1118])) for _ in range(400)]
    rows += [("b", rng.randrange(-(10**7), 10**7), rng.randrange(50)) for _ in range(100)] + [("a", 5_000_000, None), ("c", None, 3), ("d", 7, 1)]
    got = sliding.trailing(spark.createDataFrame(rows, "k string, s long, v long"), ["k"], F.col("s"), "v", days).collect()
    assert sorted((r.k, r.s if r.s is not None else -1, r.v or 0) for r in got) == sorted((k, s if s is not None else -1, v or 0) for k, s, v in rows)
    for r in got:
        window = [v for k, s, v in rows if r.s is not None and s is not None and k == r.k and v is not None and r.s - days * 86400 <= s < r.s]
        assert r.samples == len(window)
        if window:
            assert (r.median, r.p90) == pytest.approx(tuple(np.percentile(window, [50, 90])))
        else:
            assert r.median is None and r.p90 is None


@pytest.mark.parametrize("name", ["trailing_median", "trailing_bands"])
def test_readings_of_the_same_second(spark, tmp_path, name):
    rng = random.Random(8)
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=s, microseconds=u), rng.randrange(3), "view", float(rng.randrange(9))) for i, (s, u) in enumerate((s, u) for s in (0, 1, 2, 3, 4838400, 4838401) for u in (0, 200_000, 499_999, 500_000, 500_001, 900_000))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert_same(plans.QUERIES[name](spark, str(tmp_path)), duck(str(tmp_path)), plans.SQL[name])


@pytest.mark.parametrize("name", ["trailing_median", "trailing_bands"])
def test_windows_of_labels_around_a_change_of_the_clock_and_without_a_time(spark, tmp_path, name):
    rng = random.Random(9)
    # whole weeks before and after the change of 2024-03-10 in New York; 02:30 of that day is no time there
    times = [datetime(2024, 3, 10) + timedelta(days=7 * w, hours=2, minutes=30 * m, microseconds=500_000 * (m % 2)) for w in (-8, -7, 0, 1, 7, 8) for m in range(-3, 4)] + [None]
    rows = [(i, t, u, "view", None if t is None and u == 2 else float(rng.randrange(9))) for i, (u, t) in enumerate((u, t) for u in (0, 1, 2, None) for t in times)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert_same(plans.QUERIES[name](spark, str(tmp_path)), duck(str(tmp_path)), plans.SQL[name])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(("v", "m", "band"), [(4, 10, "quiet"), (5, 10, "typical"), (15, 10, "busy"), (25, 10, "veryBusy"), (0, 0, "quiet"), (3, 0, "unavailable"), (None, 4, "unavailable"), (4, None, "unavailable")])
def test_bands(spark, v, m, band):
    assert spark.createDataFrame([(v, m)], "v long, m double" if m is None else "v long, m long").select(sliding.band(F.col("v"), F.col("m"))).first()[0] == band


def test_hours_of_the_days_of_change(spark):
    rows = []
    for day, hours in ((datetime(2025, 3, 8), range(24)), (datetime(2025, 3, 9), [h for h in range(24) if h != 2]), (datetime(2025, 3, 10), range(23)), (datetime(2025, 11, 2), range(24))):
        rows += [("a", day + timedelta(hours=h, minutes=15 * q)) for h in hours for q in range(4)]
    rows += [("b", datetime(2025, 3, 9, 2, 30)), ("b", None)]
    got = {(r.k, r.day.isoformat()): tuple(r)[2:] for r in counters.hour_audit(spark.createDataFrame(rows, "k string, t timestamp_ntz"), "k", "t").collect()}
    assert got == {
        ("a", "2025-03-08"): (96, 24, 24, 0, 0, None, 92), ("a", "2025-03-09"): (92, 23, 23, 0, 0, 96, 92), ("a", "2025-03-10"): (92, 23, 24, 1, 0, 92, None),
        ("a", "2025-11-02"): (96, 24, 25, 0, 0, None, None), ("b", "2025-03-09"): (1, 1, 23, 22, 1, None, None),
    }


def test_value_profile(spark):
    df = spark.createDataFrame([("a", v) for v in (0, 0, 4, None, 8)] + [("b", None)], "k string, v long")
    assert [tuple(r) for r in counters.value_profile(df, "k", "v").orderBy("k").collect()] == [("a", 4, 0.5, 2.0, pytest.approx(6.8), pytest.approx(7.88), 8), ("b", 0, None, None, None, None, None)]
