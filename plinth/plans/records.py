"""Queries of single records and of what is counted about them: identity, drift, rejections, order, look-ups."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import ids, parse, text
from plinth.operators import cohorts, graph, identity, listing, profile, quality, sensors, surveys
from plinth.plans.registry import query, table
from plinth.sources import publish
from plinth.sources import rows as sources

# ------------------------------------------------------------------ identity

_SIDES = "WITH p AS (SELECT user_id, event_type, date_trunc('hour', ts) AS h FROM events WHERE ts < TIMESTAMP '2024-01-20'), n AS (SELECT user_id, event_type, date_trunc('hour', ts) AS h FROM events WHERE ts >= TIMESTAMP '2024-01-10')"


@query(f"""{_SIDES} SELECT (SELECT count(*) FROM p) AS previous, (SELECT count(*) FROM n) AS fetched, (SELECT count(*) FROM (SELECT * FROM p UNION SELECT * FROM n)) AS merged,
(SELECT count(*) FROM p) + (SELECT count(*) FROM n) - (SELECT count(*) FROM (SELECT * FROM p UNION SELECT * FROM n)) AS duplicates""")
def union_report(spark, sf_dir):
    """Two reads that overlap by ten days; together they hold all events."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", F.date_trunc("hour", "ts").alias("hour"))
    return identity.union_report(e.where("ts < timestamp_ntz'2024-01-20'"), e.where("ts >= timestamp_ntz'2024-01-10'"), ["user_id", "event_type", "hour"])


@query("""WITH d AS (SELECT sha256(role || '|' || text) AS d, count(*) AS n, count(DISTINCT role || '|' || text) AS r FROM conversations GROUP BY 1) SELECT count(*) AS digests, CAST(sum(n - 1) AS BIGINT) AS repeats, count(*) FILTER (WHERE r > 1) AS collisions FROM d""")
def occurrence_report(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    record = F.concat_ws("|", "role", "text")
    return identity.occurrence_report(identity.without_collisions(c.withColumn("digest", ids.row_digest(F.col("role"), F.col("text"))), record), record)


@query("SELECT l_partkey AS id, count(DISTINCT l_suppkey) AS serials FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def ambiguous_sensors(spark, sf_dir):
    return sensors.ambiguous_sensors(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("serial")))


@query("""WITH c AS (SELECT o_custkey AS serial, list_sort(list(o_orderkey)) AS ids FROM orders GROUP BY 1) SELECT unnest(ids) AS id, serial, unnest(ids) = ids[1] AS is_representative FROM c""")
def counter_index(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("serial")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("sensor_ids"))
    return sensors.unambiguous(sensors.counter_index(c.withColumn("representative", F.col("sensor_ids")[0])))


# ------------------------------------------------------------------ records


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN ' ' ELSE s_name END AS kept, s_suppkey % 4 = 1 AS says_nothing,
'{"s_acctbal":' || CAST(CAST(round(s_acctbal) AS BIGINT) AS VARCHAR) || ',"s_name":"' || s_name || '","s_suppkey":' || s_suppkey || ',"x":null}' AS json FROM supplier""")
def record_scalars(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    blank = F.when(k % 3 == 0, "").when(k % 3 == 1, " ").otherwise(F.col("s_name"))
    said = F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, "N/A").otherwise(F.col("s_name"))
    out = s.select(F.round("s_acctbal").cast("long").alias("s_acctbal"), "s_name", "s_suppkey", F.lit(None).cast("string").alias("x"), blank.alias("b"), said.alias("t"))
    json = ids.canonical_json(out.drop("b", "t"))
    return out.select("s_suppkey", text.blank_to_null(F.col("b")).alias("kept"), text.nullish(F.col("t")).alias("says_nothing"), json.alias("json"))


@query("""WITH t AS (SELECT c_custkey, c_custkey * 7919 % 1800000 / 10000.0::DOUBLE - 92.00013 AS lat, c_custkey % 11 AS k FROM customer)
SELECT c_custkey, CASE WHEN k = 0 THEN 'missing_coordinates' WHEN lat NOT BETWEEN -90 AND 90 THEN 'invalid_coordinates' END AS code, CASE WHEN k <> 0 AND lat BETWEEN -90 AND 90 THEN round(lat, 3) END AS lat, CASE WHEN k <> 0 AND lat BETWEEN -90 AND 90 THEN round(lat / 2, 3) END AS lon FROM t""")
def world_positions(spark, sf_dir):
    k = F.col("c_custkey")
    lat = k * 7919 % 1800000 / 10000.0 - 92.00013
    given = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 11 != 0, lat.cast("string")).alias("lat"), (lat / 2).cast("string").alias("lon"))
    a, b, code = parse.world_position(F.col("lat"), F.col("lon"), 3)
    return given.select("c_custkey", code.alias("code"), a.alias("lat"), b.alias("lon"))


_SITE = "CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 'LineString' WHEN 2 THEN 'x' ELSE 'Point' END"


@query(f"""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 5 = 0 AS nameless, s_suppkey % 6 AS g FROM supplier),
c AS (SELECT k, list_filter([CASE WHEN nameless THEN 'missing_identity' END, CASE WHEN g = 0 THEN 'missing_geometry' END, CASE WHEN g = 1 THEN 'unsupported_geometry' END, CASE WHEN g = 2 THEN 'unparseable_coordinates' END, CASE WHEN g = 3 THEN 'out_of_bounds' END], lambda x: x IS NOT NULL) AS codes FROM s)
SELECT CAST(row_number() OVER (ORDER BY codes[1], k) AS INTEGER) AS place, k AS loc, codes[1] AS code, array_to_string(codes, ',') AS codes FROM c WHERE len(codes) > 0 QUALIFY place <= 100""")
def site_rejections(spark, sf_dir):
    """Rejected sites in the order in which they are listed, the first hundred."""
    k = F.col("s_suppkey")
    shape = F.when(k % 6 == 1, '{"type":"LineString","coordinates":[]}').when(k % 6 == 2, '{"type":"Point","coordinates":["x",40.7]}').when(k % 6 == 3, '{"type":"Point","coordinates":[-74.0,10]}').when(k % 6 > 3, '{"type":"Point","coordinates":[-74.0,40.7]}')
    sites = table(spark, sf_dir, "supplier").select(k.alias("loc"), F.when(k % 5 != 0, F.col("s_name")).alias("street"), shape.alias("geometry"))
    _, rejected = quality.split(sites, surveys.site_rules())
    first = rejected.orderBy("code", "loc").limit(100)
    return first.select(F.row_number().over(Window.orderBy("code", "loc")).alias("place"), "loc", "code", F.concat_ws(",", "codes").alias("codes"))


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, min(o_orderstatus) <> max(o_orderstatus) AS a, min(o_orderpriority) <> max(o_orderpriority) AS b FROM orders GROUP BY 1)
SELECT unnest(['o_orderstatus', 'o_orderpriority']) AS field, unnest([count(*) FILTER (WHERE a AND n = 2), count(*) FILTER (WHERE b AND n = 2)]) AS pairs, unnest([count(*) FILTER (WHERE a AND n > 2), count(*) FILTER (WHERE b AND n > 2)]) AS larger FROM g""")
def group_disagreements(spark, sf_dir):
    return profile.disagreements(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@query("""WITH c AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x' WHEN 2 THEN '10.5' ELSE '40.7' END AS lat, '-74.0' AS lon FROM supplier)
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'unparseable' ELSE 'outside' END AS problem, lat, lon FROM c WHERE s_suppkey % 4 < 3""")
def odd_coordinates(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k == 1, "x").when(k == 2, "10.5").when(k == 3, "40.7").alias("lat"), F.lit("-74.0").alias("lon"))
    return profile.odd_coordinates(s, "s_suppkey", "lat", "lon", (40.4, 41.0, -74.3, -73.6))


# ------------------------------------------------------------------ counts


@query("SELECT CAST(year(o_orderdate) AS VARCHAR) AS cohort, count(*) AS rows, count(*) FILTER (WHERE o_orderstatus = 'F') AS vacant, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders GROUP BY 1")
def cohort_tally(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("cohort", F.year("o_orderdate").cast("string"))
    return quality.tally(o, {"vacant": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 200000}, ["cohort"])


@query("SELECT v AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) t(v) LEFT JOIN orders ON o_orderstatus = v GROUP BY 1")
def vocabulary_counts(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return listing.zero_filled(n, "o_orderstatus", ["F", "O", "P", "X"])


_YEARS = "y AS (SELECT o_custkey AS site, year(o_orderdate) AS y, CAST(round(sum(o_totalprice)) AS BIGINT) AS total FROM orders GROUP BY 1, 2)"


@query(f"""WITH {_YEARS}, c AS (SELECT y, abs((total - lag(total) OVER (PARTITION BY site ORDER BY y)) / lag(total) OVER (PARTITION BY site ORDER BY y)) AS c FROM y)
SELECT count(c) AS intervals, round(quantile_cont(c, 0.5), 6) AS median, round(quantile_cont(c, 0.75), 6) AS p75 FROM c""")
def change_profile(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("site"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice")).cast("long").alias("total"))
    got = surveys.change_profile(surveys.year_on_year(o.withColumn("month", F.lit(5)).withColumn("complete", F.lit(True)), "site"))
    return got.select("intervals", F.round("median", 6).alias("median"), F.round("p75", 6).alias("p75"))


@query(f"""WITH {_YEARS}, s AS (SELECT site, CASE WHEN site % 10 = 0 THEN NULL ELSE arg_max(total, y) END AS total, count(*) AS years_measured FROM y GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY total DESC NULLS LAST, years_measured DESC, site) AS INTEGER) AS place, site, total, years_measured FROM s QUALIFY place <= 50""")
def most_surveyed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("site"), F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice")).cast("long").alias("total"))
    sites = o.groupBy("site").agg(F.max_by("total", "y").alias("total"), F.count("*").alias("years_measured")).withColumn("total", F.when(F.col("site") % 10 != 0, F.col("total")))
    order = listing.most_surveyed()
    first = listing.rows(sites, listing.Query(sort="mostSurveyed"), "site", {"mostSurveyed": order})
    return first.select(F.row_number().over(Window.orderBy(*order, "site")).alias("place"), "site", "total", "years_measured")


@query("SELECT 'May ' || max(year(o_orderdate)) AS label, CAST(max(year(o_orderdate)) AS INTEGER) AS year FROM orders")
def newest_label(spark, sf_dir):
    y = F.year("o_orderdate")
    sites = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(y).alias("last_year"), F.count_distinct(y).alias("years_measured"))
    return surveys.newest_label(sites.withColumn("label", F.concat(F.lit("May "), F.col("last_year").cast("string"))), "label")


# ------------------------------------------------------------------ reading and order


@query("SELECT 'new' AS side, 'sept_' || substr(CAST(y AS VARCHAR), 3) || '_am' AS name FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders) WHERE y > 1996 UNION ALL SELECT 'missing', 'sept_' || substr(CAST(m AS VARCHAR), 3) || '_am' FROM (SELECT max(year(o_orderdate)) + 1 AS m FROM orders)")
def column_drift(spark, sf_dir):
    """Columns of a pivoted table against those known before."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), F.year("o_orderdate").alias("y"))
    years = sorted(r.y for r in o.select("y").distinct().collect())
    names = [f"sept_{y % 100:02d}_am" for y in years]
    wide = o.withColumn("k", F.concat(F.lit("sept_"), F.lpad((F.col("y") % 100).cast("string"), 2, "0"), F.lit("_am"))).groupBy("site").pivot("k", names).count()
    known = [f"sept_{y % 100:02d}_am" for y in [*(x for x in years if x <= 1996), years[-1] + 1]]
    new, missing = surveys.column_drift([c for c in wide.columns if c != "site"], known)
    return spark.createDataFrame([("new", n) for n in new] + [("missing", n) for n in missing], "side string, name string")


@query("""SELECT CAST(row_number() OVER (ORDER BY ts, event_id, event_type, props, user_id, value) AS INTEGER) AS place, event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY QUALIFY place <= 100""")
def canonical_snapshot(spark, sf_dir):
    """The retained rows in the order of a snapshot, the first hundred."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    newest = e.agg(F.max("ts")).first()[0]
    kept = sources.pruned(e, "ts", newest - timedelta(days=20)) if newest else e
    first = sources.canonical_order(kept, "ts", "event_id").limit(100)
    return first.select(F.row_number().over(Window.orderBy("ts", "event_id")).alias("place"), "event_id")


@query("SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1")
def pruned_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return sources.pruned(e, "ts", datetime(2024, 1, 15)).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE year(o_orderdate) = 1995")
def one_cohort(spark, sf_dir):
    """Written by cohort, read back as one folder, counted against what was announced and within its budget."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").cast("string").alias("cohort"))
    path = f"{_folder(spark)}/cohorts"
    publish.write_cohorts(o, path, "cohort")
    publish.within_size(spark, path, 1 << 50)
    got = sources.cohort(spark, path, "cohort", "1995").select("o_orderkey", "o_orderstatus")
    return sources.reconciled(sources.within_budget(got, (1 << 31) - 2), o.where("cohort = '1995'").count())


@query("""SELECT s_suppkey AS id, '{"type":"Feature","id":' || s_suppkey || ',"geometry":{"type":"Point","coordinates":[-74.5,40.5]},"properties":{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}}' AS json FROM supplier""")
def geojson_features(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.lit(-74.5).alias("lon"), F.lit(40.5).alias("lat"))
    return publish.features(s, "s_suppkey", "lon", "lat", ["s_suppkey", "s_name"])


@query("SELECT c_custkey AS id, n_nationkey, n_name, n_name IS NOT NULL AS has_boundary FROM customer LEFT JOIN (SELECT n_nationkey + 3 AS n_nationkey, n_name FROM nation) b ON c_nationkey = n_nationkey")
def area_fan_out(spark, sf_dir):
    """One boundary, several areas; an area without one keeps its row."""
    areas = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"))
    boundaries = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 3).alias("k"), (F.col("n_nationkey") + 3).alias("n_nationkey"), "n_name")
    return cohorts.with_boundaries(areas, boundaries, ["k"]).drop("k")


@query("SELECT o_orderkey AS id, 'area' AS kind FROM orders WHERE o_custkey % 3 > 0 UNION ALL SELECT o_orderkey, 'report' FROM orders")
def granularity(spark, sf_dir):
    """Areas that have any when zoomed out, single reports when zoomed in on vacant ones."""
    o = table(spark, sf_dir, "orders")
    points = o.select(F.col("o_orderkey").alias("id"), F.lit("report").alias("kind"))
    areas = o.select(F.col("o_orderkey").alias("id"), F.lit("area").alias("kind"), (F.col("o_custkey") % 3).alias("n"))
    return listing.by_zoom(points, areas, 14.9, "vacant").drop("n").unionByName(listing.by_zoom(points, areas, 15, "vacant"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7 AND c_mktsegment = (SELECT c_mktsegment FROM customer WHERE c_custkey = 7)")
def detail_row(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("id", F.concat(F.lit("cus-"), F.col("c_custkey").cast("string")))
    pattern = "cus-[0-9]+"
    segment = listing.detail(c, "id", "cus-7", pattern=pattern).first()
    filters = listing.Query(filters={"c_mktsegment": segment.c_mktsegment})
    other = listing.Query(filters={"c_mktsegment": "none of them"})
    found = listing.detail(c, "id", "cus-7", filters, pattern)
    # filtered out, of another pattern, unknown: none of these is a row
    for none in (listing.detail(c, "id", "cus-7", other, pattern), listing.detail(c, "id", "cus-7' or '1", filters, pattern), listing.detail(c, "id", "cus-0", filters, pattern)):
        found = found.unionByName(none)
    return found.select("c_custkey", "c_name")


def _folder(spark) -> str:
    return f"{graph.shared_folder(spark)}/records-{uuid.uuid4().hex}"
