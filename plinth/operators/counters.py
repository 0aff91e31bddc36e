"""Counter time series: folding directions, leave-one-out baselines, activity, freshness and faults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.parse import ZONE, civil_to_utc

# Lower bounds of activity levels by percentile rank, samples and days that the rules need, ages in hours.
ACTIVITY = (("veryBusy", 90), ("busy", 75), ("typical", 25), ("quiet", 0))
LEAST_SAMPLES = 7
FAULT_DAYS = 7
FRESH_HOURS, STALE_HOURS = 30, 7 * 24


def fold_directions(df: DataFrame, keys: Sequence[str], direction: str, value: str, legs: Sequence[str] = ("in", "out"), directional: Column | None = None) -> DataFrame:
    """(keys, total): the sum over directions; NULL if a reading is NULL, or if a directional counter lacks a leg."""
    whole = F.count(value) == F.count("*")
    both = F.count_distinct(F.when(F.col(direction).isin(*legs), F.col(direction))) == len(legs)
    need = F.lit(True) if directional is None else ~F.bool_or(directional) | both
    if directional is None:
        need = both
    return df.groupBy(*keys).agg(F.when(whole & need, F.sum(value)).alias("total"))


def newest(df: DataFrame, key: str, time: str, *ties: str) -> DataFrame:
    """The row with the greatest time of each key, even if its reading is NULL; equal times are decided by ``ties``, else by all other columns in order of name."""
    rest = ties or tuple(c for c in sorted(df.columns) if c not in (key, time))
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time), *(F.asc_nulls_last(c) for c in rest)))).where("_n = 1").drop("_n")


def percentile_rank(below: Column, equal: Column, n: Column) -> Column:
    """100 * (below + equal / 2) / n."""
    return F.when(n > 0, 100.0 * (below + equal / 2.0) / n)


def baseline(history: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, median (half up), quartiles, p90, zeros and distinct values of each key's readings."""
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    got = history.groupBy(*keys).agg(F.count(value).alias("n"), p.alias("_p"), F.count_if(F.col(value) == 0).alias("zeros"), F.count_distinct(value).alias("distinct_values"))
    return got.select(*keys, "n", F.floor(F.col("_p")[1] + 0.5).cast("long").alias("expected"), *(F.col("_p")[i].alias(a) for i, a in ((0, "p25"), (2, "p75"), (3, "p90"))), "zeros", "distinct_values")


def leave_one_out(readings: DataFrame, key: str, slot: Sequence[str], time: str, value: str, days: int = 56) -> DataFrame:
    """The newest reading of each key against the others of its slot within ``days``: n, expected, below, equal, percentile.

    The newest rows are one a key; the join on (key, slot) prunes history to their slots before anything is sorted. The window is part of the join's
    condition, so a key without any other reading in it stays, with n = 0.
    """
    now = newest(readings, key, time).select(key, *slot, F.col(time).alias("now"), F.col(value).alias("reading"))
    past = readings.where(F.col(value).isNotNull()).select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in slot), F.col(time).alias("at"), F.col(value).alias("v"))
    same = F.col(key) == F.col("_key")
    for c in slot:
        same &= F.col(c) == F.col(f"_{c}")
    pairs = now.join(past, same & (F.col("at") < F.col("now")) & (F.col("at") >= F.col("now") - F.expr(f"INTERVAL {days} DAYS")), "left")
    other = F.col("at").isNotNull()
    got = pairs.groupBy(key, *slot, "now", "reading").agg(
        F.count_if(other).alias("n"), F.percentile(F.when(other, F.col("v")), F.lit(0.5)).alias("median"),
        F.count_if(other & (F.col("v") < F.col("reading"))).alias("below"), F.count_if(other & (F.col("v") == F.col("reading"))).alias("equal"),
    )
    return got.withColumn("expected", F.floor(F.col("median") + 0.5).cast("long")).withColumn("percentile", percentile_rank(F.col("below"), F.col("equal"), F.col("n")))


def activity(rank: Column, expected: Column, reading: Column, n: Column | None = None) -> Column:
    """The level of an unrounded rank; with nothing expected only zero is a level (quiet)."""
    out = F.lit("quiet")
    for name, bound in reversed(ACTIVITY):
        out = F.when(rank >= bound, name).otherwise(out)
    few = F.lit(False) if n is None else n < LEAST_SAMPLES
    return F.when(rank.isNull() | reading.isNull() | few, "unavailable").when(expected == 0, F.when(reading == 0, "quiet").otherwise("unavailable")).otherwise(out)


def staleness(hours: Column) -> Column:
    return F.when(hours.isNull(), "unavailable").when(hours <= FRESH_HOURS, "fresh").when(hours <= STALE_HOURS, "stale").otherwise("offline")


def suppressed(value: Column, state: Column, reading: Column) -> Column:
    """NULL where a counter is offline or unavailable or has no reading."""
    return F.when(~state.isin("offline", "unavailable") & reading.isNotNull(), value)


def ratio(reading: Column, expected: Column) -> Column:
    return F.when(expected > 0, F.round(reading / expected, 3))


def fault_runs(daily: DataFrame, key: str, day: str, any_nonzero: Column, all_null: Column, gap_ends: bool = False) -> DataFrame:
    """(key, fault_days): how many of the newest days present have readings and none that is not zero. With ``gap_ends`` a missing day ends the run."""
    back = Window.partitionBy(key).orderBy(F.desc(day))
    ends = (any_nonzero | all_null).cast("int")
    if gap_ends:
        ends = F.greatest(ends, F.coalesce((F.datediff(F.lag(day).over(back), F.col(day)) > 1).cast("int"), F.lit(0)))
    run = daily.withColumn("_stop", ends).withColumn("_stops", F.sum("_stop").over(back.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(key).agg(F.count_if(F.col("_stops") == 0).alias("fault_days"))


def longest_run(daily: DataFrame, key: str, day: str, holds: Column) -> DataFrame:
    """(key, longest): the longest run of days present, one after another in order, for which the condition holds."""
    w = Window.partitionBy(key).orderBy(day)
    marked = daily.select(key, day, holds.alias("_h")).withColumn("_n", F.row_number().over(w))
    islands = marked.where("_h").withColumn("_i", F.col("_n") - F.row_number().over(w))
    runs = islands.groupBy(key, "_i").agg(F.count("*").alias("_len")).groupBy(key).agg(F.max("_len").alias("longest"))
    return daily.select(key).distinct().join(runs, key, "left").select(key, F.coalesce("longest", F.lit(0).cast("long")).alias("longest"))


def hour_audit(readings: DataFrame, key: str, time: str, zone: str = ZONE) -> DataFrame:
    """(key, day, rows, hours, expected_hours, missing_hours, impossible_rows, rows_before, rows_after) of each key and civil day with readings; ``time`` is wall-clock time.

    A day has as many hours as there are between its midnight and the next one, 23, 24 or 25 by the zone's transitions. An hour that a transition skips has no label, and one that it
    repeats has one label for both, so a day shows at most 24 labels. Rows under a label that the zone skipped are impossible: wall-clock times don't go there, other clocks do.
    The rows of the days before and after are NULL where these have none.
    """
    day = F.to_date(time)
    midnight = lambda d: civil_to_utc(d.cast("timestamp_ntz"), zone)
    instant = civil_to_utc(F.col(time), zone)
    skipped = F.from_utc_timestamp(instant, zone) != F.col(time).cast("timestamp")
    got = readings.where(F.col(time).isNotNull()).groupBy(key, day.alias("day")).agg(
        F.count("*").alias("rows"), F.size(F.collect_set(F.hour(time))).cast("long").alias("hours"), F.count_if(skipped).alias("impossible_rows"),
    )
    length = ((F.unix_seconds(midnight(F.date_add("day", 1))) - F.unix_seconds(midnight(F.col("day")))) / 3600).cast("int")
    around = Window.partitionBy(key).orderBy("day")
    beside = lambda f, days: F.when(F.datediff(f("day").over(around), F.col("day")) == days, f("rows").over(around))
    got = got.withColumn("expected_hours", length).withColumn("missing_hours", F.least(F.lit(24), "expected_hours") - F.col("hours"))
    return got.select(key, "day", "rows", "hours", "expected_hours", "missing_hours", "impossible_rows", beside(F.lag, -1).alias("rows_before"), beside(F.lead, 1).alias("rows_after"))


def coverage_of_grid(readings: DataFrame, key: str, time: str, minutes: int = 15) -> DataFrame:
    """(key, present, expected, share): slots with a reading against the grid from first to last."""
    slot = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / (minutes * 60))
    got = readings.groupBy(key).agg(F.count_distinct(slot).alias("present"), (F.max(slot) - F.min(slot) + 1).cast("long").alias("expected"))
    return got.withColumn("share", F.col("present") / F.col("expected"))


def value_profile(readings: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, zero_share, median, p90, p99, most) of each counter's readings; NULL readings are none, and a counter without any has n = 0 and no figures."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    got = readings.groupBy(key).agg(F.count(value).alias("n"), F.count_if(F.col(value) == 0).alias("_z"), p.alias("_p"), F.max(value).alias("most"))
    share = F.when(F.col("n") > 0, F.col("_z") / F.col("n"))
    return got.select(key, "n", share.alias("zero_share"), *(F.get("_p", F.lit(i)).alias(name) for i, name in enumerate(("median", "p90", "p99"))), "most")
