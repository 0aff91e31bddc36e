"""From sensor metadata to physical counters: grouping, aliases, names, representatives, edges of their data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.parse import ZONE
from plinth.functions.text import name_set
from plinth.operators.identity import band_links, components, shared_edges

ALIAS_DEGREES = 1e-4


def group_key(serial: str = "serial", lat: str = "lat", lon: str = "lon", sensor: str = "id"):
    """The serial; without one the place to five decimals; without that the sensor itself."""
    place = F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.format_string("geo:%.5f,%.5f", F.col(lat), F.col(lon)))
    return F.coalesce(F.nullif(F.trim(serial), F.lit("")), place, F.concat(F.lit("id:"), F.col(sensor).cast("string")))


def grouped(rows: DataFrame) -> DataFrame:
    """(serial, sensor_ids, names, modes, directional, lat, lon): one row a group key. The value of the greatest sensor id wins, whatever the order of rows."""
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    return rows.groupBy(group_key().alias("key")).agg(
        F.array_sort(F.collect_set("id")).alias("sensor_ids"), F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(name_set(F.col("modes")))))).alias("modes"),
        F.bool_or(F.coalesce(F.col("directional"), F.lit(False))).alias("directional"), last("lat"), last("lon"),
    ).withColumnRenamed("key", "serial")


def physical(groups: DataFrame, degrees: float = ALIAS_DEGREES) -> DataFrame:
    """(serial, aliases, sensor_ids, name, representative, modes, directional, lat, lon): groups that share a sensor or lie together are one counter.

    The canonical serial is the greatest; the name the shortest, then the first in order; the representative the smallest sensor id.
    """
    edges = shared_edges(groups, "serial", "sensor_ids").union(band_links(groups.where("lat is not null and lon is not null"), "serial", ["lat", "lon"], degrees))
    same = components(groups.withColumnRenamed("serial", "node"), edges)
    joined = groups.join(same.withColumnRenamed("node", "serial"), "serial")
    one = joined.groupBy("component").agg(
        F.max("serial").alias("serial"), F.array_sort(F.collect_set("serial")).alias("_all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sensor_ids")))).alias("sensor_ids"),
        F.flatten(F.collect_list("names")).alias("_names"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("modes")))).alias("modes"), F.bool_or("directional").alias("directional"),
        F.max_by("lat", "serial").alias("lat"), F.max_by("lon", "serial").alias("lon"),
    )
    name = F.array_min(F.transform("_names", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    return one.select("serial", F.array_remove("_all", F.col("serial")).alias("aliases"), "sensor_ids", name.alias("name"), F.array_min("sensor_ids").alias("representative"), "modes", "directional", "lat", "lon")


def counter_index(counters: DataFrame) -> DataFrame:
    """(id, serial, is_representative): each source sensor's counter."""
    return counters.select(F.explode("sensor_ids").alias("id"), "serial", "representative").select("id", "serial", (F.col("id") == F.col("representative")).alias("is_representative"))


def ambiguous_sensors(index: DataFrame) -> DataFrame:
    """(id, serials): source sensors that more than one counter claims."""
    return index.groupBy("id").agg(F.count_distinct("serial").alias("serials")).where("serials > 1")


def unambiguous(index: DataFrame) -> DataFrame:
    """``index``, refused if a sensor belongs to more than one counter: its readings would be counted for each."""
    if found := ambiguous_sensors(index).limit(5).collect():
        raise ValueError(f"sensors of several counters: {[r.id for r in found]}")
    return index


def routed(counts: DataFrame, index: DataFrame, mode: str = "pedestrian") -> DataFrame:
    """Count rows with their serial and ``reason`` (NULL for a row that counts): unknown sensor, wrong mode, bad time, missing count."""
    reason = F.when(F.col("serial").isNull(), "unknown_sensor").when(F.col("mode") != mode, "wrong_mode").when(F.col("ts").isNull(), "bad_timestamp").when(F.col("v").isNull(), "missing_count")
    return counts.join(index, counts["sensor_id"] == index["id"], "left").drop("id").withColumn("reason", reason)


def edges_of_data(index: DataFrame, extents: DataFrame) -> DataFrame:
    """(serial, first, first_from, last, last_from): the furthest edges over a counter's sensors and sources, and where each comes from."""
    rows = index.join(extents, index["id"] == extents["sensor_id"])
    return rows.groupBy("serial").agg(F.min("first").alias("first"), F.min_by("source", F.struct("first", "source")).alias("first_from"), F.max("last").alias("last"), F.max_by("source", F.struct("last", "source")).alias("last_from"))


def twin_problems(counts: DataFrame, index: DataFrame, measures: tuple[str, ...] = ("rows", "total")) -> DataFrame:
    """(serial, id, ...): sensors whose extent differs from their representative's; empty if twins only repeat each other."""
    rows = counts.join(index, counts["sensor_id"] == index["id"])
    rep = rows.where("is_representative").select("serial", *(F.col(m).alias(f"rep_{m}") for m in measures))
    differs = F.lit(False)
    for m in measures:
        differs = differs | ~F.col(m).eqNullSafe(F.col(f"rep_{m}"))
    return rows.where("not is_representative").join(rep, "serial").where(differs).select("serial", "id", *measures, *(f"rep_{m}" for m in measures))


def twin_moments(counts: DataFrame, index: DataFrame, time: str = "ts", direction: str = "direction", value: str = "v") -> DataFrame:
    """(serial, id, ts, direction, rep_value, twin_value, problem): where a twin's readings are not those of its representative, moment by moment.

    ``problem`` is ``missing`` (the representative has a reading there, the twin none), ``extra`` (the other way round), ``repeated`` (one side has several) or ``differs``. Totals that agree by chance don't hide it.
    """
    c = F.col
    legs = counts.join(index, counts["sensor_id"] == index["id"]).groupBy("serial", "id", "is_representative", time, direction).agg(F.sum(value).alias("v"), F.count("*").alias("n"))
    twins = index.where("not is_representative").select("serial", "id")
    rep = legs.where("is_representative").select("serial", time, direction, c("v").alias("rep_value"), c("n").alias("rep_n")).join(twins, "serial")
    twin = legs.where("not is_representative").select("serial", "id", time, direction, c("v").alias("twin_value"), c("n").alias("twin_n"))
    both = rep.join(twin, ["serial", "id", time, direction], "full")
    problem = F.when(c("twin_n").isNull(), "missing").when(c("rep_n").isNull(), "extra").when((c("rep_n") > 1) | (c("twin_n") > 1), "repeated").when(~c("rep_value").eqNullSafe(c("twin_value")), "differs")
    return both.select("serial", "id", time, direction, "rep_value", "twin_value", problem.alias("problem")).where("problem is not null")


def recomputed_moments(published: DataFrame, counts: DataFrame, index: DataFrame, zone: str = ZONE, time: str = "ts", value: str = "v") -> DataFrame:
    """(serial, observed_at, problem, count, found): published counters (serial, observed_at, count) that the raw rows contradict.

    ``observed_at`` is an instant and raw times are wall-clock, so the instant is brought to the zone before rows are looked up. At that moment the representative's readings over all directions must
    sum to the count, and the readings of all of a counter's sensors to as many times that sum as it has sensors. Without rows of the representative the moment is ``no rows``; counters without an instant make no claim.
    """
    c = F.col
    sensors = index.groupBy("serial").agg(F.count("*").alias("sensors"))
    claims = published.where(c("observed_at").isNotNull()).select("serial", "observed_at", "count", F.from_utc_timestamp("observed_at", zone).alias("_at")).join(sensors, "serial", "left")
    # the instants of the claims bound what is read of the rows
    rows = counts.join(index, counts["sensor_id"] == index["id"]).select("serial", "is_representative", c(time).cast("timestamp").alias("_at"), c(value).alias("v"))
    at = claims.select("serial", "_at").distinct()
    sums = rows.join(at, ["serial", "_at"], "left_semi").groupBy("serial", "_at").agg(F.sum(F.when(c("is_representative"), c("v"))).alias("rep"), F.coalesce(F.sum("v"), F.lit(0)).alias("every"))
    got = claims.join(sums, ["serial", "_at"], "left")
    found = [
        (c("rep").isNull(), "no rows", F.lit(None).cast("long")), (c("rep").isNotNull() & ~c("count").eqNullSafe(c("rep")), "count is not the representative's", c("rep")),
        (c("rep").isNotNull() & (c("every") != c("rep") * c("sensors")), "twins do not repeat it", c("every")),
    ]
    each = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(name).alias("problem"), value.alias("found"))) for cond, name, value in found)))
    return got.select("serial", "observed_at", "count", F.explode(each).alias("p")).select("serial", "observed_at", "p.problem", "count", "p.found")
