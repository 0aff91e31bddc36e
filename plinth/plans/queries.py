"""Every operator as a query over the driver's tables, next to DuckDB SQL that says the same."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions import geo, ids, parse, text
from plinth.operators import cohorts, contracts, counters, graph, identity, listing, profile, publication, quality, search, sensors, surveys, validate
from plinth.plans import listings, records, rules, series, streams  # noqa: F401  (their queries register themselves)
from plinth.plans.registry import QUERIES, SQL, query, table  # noqa: F401
from plinth.sources import publish
from plinth.sources import rows as sources

def _points(df: DataFrame, key: str) -> DataFrame:
    """Made-up coordinates from a key, inside the city box."""
    k = F.col(key)
    return df.withColumn("lat", 40.5 + (k * 7919 % 4000) / 10000.0).withColumn("lon", -74.25 + (k * 104729 % 5500) / 10000.0)


_SQL_POINTS = "40.5 + ({k} * 7919 % 4000) / 10000.0::DOUBLE AS lat, -74.25 + ({k} * 104729 % 5500) / 10000.0::DOUBLE AS lon"
_SPACE = r"[\x09-\x0D\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NULLISH = ", ".join(f"'{t}'" for t in text.NULLISH)


def _sql_text(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_SPACE}', ' ', 'g'))"


# ------------------------------------------------------------------ scalars


@query(f"SELECT doc_id, CASE WHEN {_sql_text('text')} NOT IN ({_NULLISH}) THEN {_sql_text('text')} END AS clean, CAST({_sql_text('text')} <> text AS BOOLEAN) AS changed FROM documents")
def normalise_text(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.normalise_text(t).alias("clean"), text.whitespace_changed(t).alias("changed"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS id_text,
CASE WHEN length(CAST(o_orderkey AS VARCHAR)) >= 5 THEN CAST(o_orderkey AS VARCHAR) END AS bbl, length(CAST(o_orderkey AS VARCHAR)) < 5 AS degenerate,
CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey AS INTEGER) AS n, CASE WHEN o_orderkey % 2 = 0 THEN 'vacant' ELSE 'nonVacant' END AS status, o_orderkey % 2 = 0 AS flag,
CASE WHEN o_orderkey % 2 = 0 THEN '2010' ELSE '2020' END AS vintage FROM orders""")
def parse_scalars(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    bbl, degenerate = parse.digits_id(k)
    yes = F.when(F.col("o_orderkey") % 2 == 0, "YES").otherwise("N")
    area = F.when(F.col("o_orderkey") % 2 == 0, "MN17").otherwise("MN0502")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).otherwise(k).alias("id_text"), bbl.alias("bbl"), degenerate.alias("degenerate"),
        parse.calendar_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS")).alias("day"), parse.count(k).alias("n"), parse.vacancy(yes).alias("status"), parse.tri_state(yes).alias("flag"), parse.area_vintage(area).alias("vintage"),
    )


@query("SELECT o_orderkey, 'ord-' || substr(sha1(CAST(o_custkey AS VARCHAR) || '|' || o_orderpriority), 1, 12) AS short_id, 'rep-' || substr(sha256(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus), 1, 24) AS long_id FROM orders")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", ids.short_id("ord-", F.col("o_custkey"), F.col("o_orderpriority")).alias("short_id"), ids.long_id("rep-", F.col("o_orderkey"), F.col("o_orderstatus")).alias("long_id"))


@query("""SELECT event_id, strftime(ts, '%H') || ':' || printf('%02d', (minute(ts) // 15) * 15) AS bucket, lower(strftime(ts, '%a')) AS day,
strftime(CAST(ts AS TIMESTAMP) + INTERVAL 5 HOURS, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM events""")
def time_keys(spark, sf_dir):
    ts = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", parse.bucket_key(ts).alias("bucket"), parse.day_key(ts).alias("day"), parse.utc_text(parse.civil_to_utc(ts)).alias("utc"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(replace(strip_accents(p_name), '''', ''), '[\p{P}\p{S}]+', ' ', 'g')), '\s+', ' ', 'g')) AS folded, printf('%d', p_size) || CASE WHEN p_size % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END AS place,
CASE WHEN p_size * 60 < 60 THEN 'just now' WHEN p_size < 60 THEN p_size || CASE WHEN p_size = 1 THEN ' minute ago' ELSE ' minutes ago' END ELSE 'other' END AS age FROM part""")
def display_text(spark, sf_dir):
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", text.search_fold(F.col("p_name")).alias("folded"), text.ordinal(n).alias("place"), text.relative_age(n * 60).alias("age"))


# ------------------------------------------------------------------ rules, identity


def _order_rules() -> list[quality.Rule]:
    return [
        quality.Rule("quantity_out_of_range", ~F.col("l_quantity").between(1, 45), F.col("l_quantity")), quality.Rule("late_ship_date", F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")),
        quality.Rule("unknown_flag", ~F.col("l_returnflag").isin("A", "N")), quality.Rule("no_discount", F.col("l_discount") == 0),
    ]


_RULES = """r AS (SELECT *, list_filter([CASE WHEN NOT l_quantity BETWEEN 1 AND 45 THEN 'quantity_out_of_range' END, CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' THEN 'late_ship_date' END,
CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'unknown_flag' END, CASE WHEN l_discount = 0 THEN 'no_discount' END], lambda x: x IS NOT NULL) AS codes FROM lineitem)"""


@query(f"WITH {_RULES} SELECT l_orderkey, l_linenumber, codes[1] AS code, array_to_string(codes, ',') AS codes FROM r WHERE len(codes) > 0")
def reject_split(spark, sf_dir):
    _, rejected = quality.split(table(spark, sf_dir, "lineitem"), _order_rules())
    return rejected.select("l_orderkey", "l_linenumber", "code", F.concat_ws(",", "codes").alias("codes"))


@query(f"""WITH {_RULES}, u AS (SELECT codes[1] AS first, unnest(codes) AS code FROM r), v(code) AS (VALUES ('quantity_out_of_range'), ('late_ship_date'), ('unknown_flag'), ('no_discount'))
SELECT v.code, count(*) FILTER (WHERE u.first = v.code) AS "primary", count(*) FILTER (WHERE u.first <> v.code) AS also FROM v LEFT JOIN u USING (code) GROUP BY 1""")
def reject_report(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "lineitem"), _order_rules())


@query("""SELECT o_custkey, count(*) AS members, CASE WHEN list_sort(list(DISTINCT o_orderstatus)) = ['F', 'O'] THEN 'both' WHEN list(DISTINCT o_orderstatus) = ['F'] THEN 'closed' WHEN list(DISTINCT o_orderstatus) = ['O'] THEN 'open' END AS label,
arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, array_to_string(list_filter([CASE WHEN count(*) > 2 THEN 'group_of_3_plus' END, CASE WHEN count(*) > count(DISTINCT o_orderstatus) THEN 'repeated_kind' END, CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 'o_orderpriority_disagreement' END], lambda x: x IS NOT NULL), ',') AS anomalies,
array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS source_ids FROM orders GROUP BY 1""")
def merge_licences(spark, sf_dir):
    got = identity.merge_groups(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", {"F": "closed", "O": "open"}, "both", F.col("o_orderkey"), ["o_orderpriority"], "o_orderkey")
    return got.select("o_custkey", "members", "label", "o_orderpriority", F.concat_ws(",", "anomalies").alias("anomalies"), F.concat_ws(",", F.col("source_ids").cast("array<string>")).alias("source_ids"))


@query("""WITH u AS (SELECT user_id, event_type, date_trunc('hour', ts) AS hour, event_id, 0 AS f FROM events WHERE ts < TIMESTAMP '2024-01-20' UNION ALL SELECT user_id, event_type, date_trunc('hour', ts), event_id, 1 FROM events WHERE ts >= TIMESTAMP '2024-01-10')
SELECT user_id, event_type, hour, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, hour ORDER BY f, event_id) AS n FROM u) WHERE n = 1""")
def dedup_natural_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    old, new = e.where("ts < timestamp_ntz'2024-01-20'").drop("ts"), e.where("ts >= timestamp_ntz'2024-01-10'").drop("ts")
    return identity.union_dedup(old, new, ["user_id", "event_type", "hour"], F.col("event_id"))


@query("SELECT conv_id, turn, sha256(role || '|' || text) AS digest, row_number() OVER (PARTITION BY sha256(role || '|' || text) ORDER BY conv_id, turn) AS occurrence FROM conversations")
def occurrence_ids(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return identity.numbered(c, ids.row_digest(F.col("role"), F.col("text")), F.col("conv_id"), F.col("turn")).select("conv_id", "turn", "digest", F.col("occurrence").cast("long").alias("occurrence"))


@query("""WITH RECURSIVE e AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) <= 40),
r(node, other) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a) SELECT node, min(other) AS component FROM r GROUP BY 1""")
def alias_clusters(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return identity.components(s, identity.band_links(s, "s_suppkey", ["s_acctbal"], 40.0), "s_suppkey")


@query("WITH u AS (SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey % 4) AS BIGINT) AS s FROM orders GROUP BY 1) SELECT n, s, min(o_custkey) AS first, unnest(list(o_custkey)) AS member FROM u GROUP BY 1, 2 HAVING count(*) > 1")
def twin_groups(spark, sf_dir):
    u = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_orderkey") % 4).alias("s"))
    return identity.twin_groups(u, "o_custkey", ["n", "s"])


# ------------------------------------------------------------------ listing, search, geo


@query("SELECT coalesce(CASE WHEN grouping(c_mktsegment) = 0 THEN c_mktsegment END, 'all') AS c_mktsegment, coalesce(CASE WHEN grouping(c_nationkey) = 0 THEN CAST(c_nationkey AS VARCHAR) END, 'all') AS c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def facet_counts(spark, sf_dir):
    return listing.facets(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE lower(p_brand) = 'brand#11' ORDER BY p_name, p_partkey LIMIT 40")
def list_by_name(spark, sf_dir):
    p = _points(table(spark, sf_dir, "part"), "p_partkey")
    q = listing.Query({"p_brand": "Brand#11", "p_type": "all"}, sort="name", limit=40)
    return listing.rows(p, q, "p_partkey", {"name": [F.col("p_name")]}).select("p_partkey", "p_name", "p_brand")


@query("SELECT * FROM (SELECT 'site' AS kind, s_suppkey AS id, s_acctbal AS total, NULL::INTEGER AS n_regionkey, 0 AS kind_order FROM supplier UNION ALL SELECT 'counter', n_nationkey, NULL, n_regionkey, 1 FROM nation) ORDER BY kind_order, total DESC NULLS LAST, id LIMIT 110")
def mixed_index(spark, sf_dir):
    sites = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("total"))
    others = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_regionkey")
    both = listing.one_index(site=sites, counter=others)
    return listing.rows(both, listing.Query(sort="most", limit=110), "id", {"most": [F.col("kind_order"), F.col("total").desc_nulls_last()]})


@query("SELECT c_custkey, round(abs(c_acctbal), 2) AS size FROM customer ORDER BY abs(c_acctbal) DESC NULLS LAST, c_custkey LIMIT 25")
def top_changed(spark, sf_dir):
    c = _points(table(spark, sf_dir, "customer"), "c_custkey")
    got = listing.rows(c, listing.Query(sort="changed", limit=25), "c_custkey", {"changed": [F.abs("c_acctbal").desc_nulls_last()]})
    return got.select("c_custkey", F.round(F.abs("c_acctbal"), 2).alias("size"))


_MILES = "2 * 3958.7613 * asin(least(1.0, sqrt(power(sin(radians(lat - 40.7) / 2), 2) + cos(radians(40.7)) * cos(radians(lat)) * power(sin(radians(lon + 74.0) / 2), 2))))"


@query(f"WITH p AS (SELECT c_custkey, {_SQL_POINTS.format(k='c_custkey')} FROM customer) SELECT c_custkey, round({_MILES}, 6) AS miles FROM p WHERE lat BETWEEN 40.6 AND 40.8 AND lon BETWEEN -74.1 AND -73.9 ORDER BY {_MILES}, c_custkey LIMIT 30")
def nearby(spark, sf_dir):
    c = _points(table(spark, sf_dir, "customer"), "c_custkey")
    q = listing.Query(box=(40.6, 40.8, -74.1, -73.9), origin=(40.7, -74.0), sort="nearby", limit=30)
    return listing.rows(c, q, "c_custkey", {"nearby": [F.col("miles")]}).select("c_custkey", F.round("miles", 6).alias("miles"))


@query(f"WITH p AS (SELECT *, {_SQL_POINTS.format(k='c_custkey')} FROM customer) SELECT count(*) FILTER (WHERE c_mktsegment = 'BUILDING' AND lat BETWEEN 40.6 AND 40.8 AND lon BETWEEN -74.1 AND -73.9) AS in_view, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS matching, count(*) AS all_rows FROM p")
def view_counts(spark, sf_dir):
    return listing.counts(_points(table(spark, sf_dir, "customer"), "c_custkey"), listing.Query({"c_mktsegment": "BUILDING"}, (40.6, 40.8, -74.1, -73.9)))


@query(f"WITH p AS (SELECT {_SQL_POINTS.format(k='c_custkey')} FROM customer) SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, count(*) AS n FROM p")
def extent(spark, sf_dir):
    return geo.extent(_points(table(spark, sf_dir, "customer"), "c_custkey"))


_BOX_CASE = " ".join(f"WHEN lat BETWEEN {a} AND {b} AND lon BETWEEN {c} AND {d} THEN '{n}'" for n, a, b, c, d in geo.BOROUGH_BOXES)
_EDGE_CASE = " ".join(f"WHEN lat BETWEEN {a} AND {b} AND lon BETWEEN {c} AND {d} THEN least(lat - {a}, {b} - lat, lon - {c}, {d} - lon)" for n, a, b, c, d in geo.BOROUGH_BOXES)


@query(f"WITH p AS (SELECT c_custkey, {_SQL_POINTS.format(k='c_custkey')} FROM customer) SELECT c_custkey, CASE {_BOX_CASE} END AS borough, CAST(coalesce(CASE {_EDGE_CASE} END < 0.005, false) AS BOOLEAN) AS near_border, CASE WHEN c_custkey IS NULL THEN 4 WHEN c_custkey <= 500 THEN 4 WHEN c_custkey <= 2000 THEN 6 ELSE 8 END AS radius FROM p")
def boroughs(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    return _points(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", geo.first_box(lat, lon).alias("borough"), F.coalesce(geo.edge_degrees(lat, lon) < 0.005, F.lit(False)).alias("near_border"), geo.stepped(F.col("c_custkey"), [(500, 4), (2000, 6), (None, 8)]).alias("radius"))


@query(f"""WITH p AS (SELECT {_SQL_POINTS.format(k='c_custkey')} FROM customer)
SELECT CAST(floor((lon + 180) / 360 * (512 * 1024 / 50.0)) AS BIGINT) AS cell_x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * (512 * 1024 / 50.0)) AS BIGINT) AS cell_y, count(*) AS point_count FROM p GROUP BY 1, 2""")
def cluster_grid(spark, sf_dir):
    return geo.clusters(_points(table(spark, sf_dir, "customer"), "c_custkey"), 10).select("cell_x", "cell_y", "point_count")


@query(r"""WITH f AS (SELECT p_partkey, p_name, trim(regexp_replace(lower(regexp_replace(replace(strip_accents(p_name), '''', ''), '[\p{P}\p{S}]+', ' ', 'g')), '\s+', ' ', 'g')) AS t FROM part),
s AS (SELECT *, CASE WHEN t = 'rin' THEN 400 WHEN starts_with(t, 'rin') THEN 300 + greatest(0, 20 - length(t)) WHEN contains(t, ' rin') THEN 200 WHEN contains(t, 'rin') THEN 100 ELSE 0 END AS a,
CASE WHEN t = 's' THEN 400 WHEN starts_with(t, 's') THEN 300 + greatest(0, 20 - length(t)) WHEN contains(t, ' s') THEN 200 WHEN contains(t, 's') THEN 100 ELSE 0 END AS b FROM f)
SELECT p_partkey, p_name, CAST(least(a, b) AS INTEGER) AS score FROM s WHERE a > 0 AND b > 0 ORDER BY least(a, b) DESC, p_name, p_partkey LIMIT 50""")
def search_rank(spark, sf_dir):
    return search.search(table(spark, sf_dir, "part"), "Rîn', s", ["p_name"], "p_name", "p_partkey").select("p_partkey", "p_name", F.col("score").cast("int").alias("score"))


# ------------------------------------------------------------------ counters


def _readings(spark, sf_dir) -> DataFrame:
    """Counts a user and quarter hour, as a counter's readings."""
    ts = F.col("ts").cast("timestamp_ntz")
    e = table(spark, sf_dir, "events").select("user_id", ts.alias("ts"), F.floor("value").cast("long").alias("v"), "event_type", "event_id")
    return e.groupBy("user_id", "ts").agg(F.sum("v").alias("v"), F.weekday("ts").alias("dow"), F.floor(F.hour("ts") / 6).cast("int").alias("slot"))


_READINGS = "rd AS (SELECT user_id, ts, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS v, CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(hour(ts) // 6 AS INTEGER) AS slot FROM events GROUP BY user_id, ts)"


@query("""WITH e AS (SELECT user_id, date_trunc('day', ts) AS day, event_type, CAST(floor(value) AS BIGINT) AS v FROM events WHERE event_type IN ('click', 'view')), k AS (SELECT user_id, day, count(DISTINCT event_type) AS legs, sum(v) AS s FROM e GROUP BY 1, 2)
SELECT user_id, day, CAST(CASE WHEN legs = 2 THEN s END AS BIGINT) AS total FROM k""")
def direction_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'view')").select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type", F.floor("value").cast("long").alias("v"))
    return counters.fold_directions(e, ["user_id", "day"], "event_type", "v", ("click", "view"))


@query(f"""WITH {_READINGS} SELECT user_id, dow, slot, count(v) AS n, CAST(floor(quantile_cont(v, 0.5) + 0.5) AS BIGINT) AS expected, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.9), 6) AS p90,
count(*) FILTER (WHERE v = 0) AS zeros, count(DISTINCT v) AS distinct_values FROM rd GROUP BY 1, 2, 3""")
def baseline_profile(spark, sf_dir):
    got = counters.baseline(_readings(spark, sf_dir), ["user_id", "dow", "slot"], "v")
    return got.select("user_id", "dow", "slot", "n", "expected", *(F.round(c, 6).alias(c) for c in ("p25", "p75", "p90")), "zeros", "distinct_values")


_LOO = f"""{_READINGS}, nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM rd) WHERE k = 1),
lo AS (SELECT nw.user_id, nw.dow, nw.slot, nw.v AS reading, count(h.v) AS n, quantile_cont(h.v, 0.5) AS med, count(*) FILTER (WHERE h.v < nw.v) AS below, count(*) FILTER (WHERE h.v = nw.v) AS equal
FROM nw LEFT JOIN rd h ON h.user_id = nw.user_id AND h.dow = nw.dow AND h.slot = nw.slot AND h.ts < nw.ts AND h.ts >= nw.ts - INTERVAL 56 DAY GROUP BY ALL)"""


@query(f"WITH {_LOO} SELECT user_id, reading, n, CAST(floor(med + 0.5) AS BIGINT) AS expected, round(CASE WHEN n > 0 THEN 100.0 * (below + equal / 2) / n END, 6) AS percentile FROM lo")
def percentile_rank(spark, sf_dir):
    got = counters.leave_one_out(_readings(spark, sf_dir), "user_id", ["dow", "slot"], "ts", "v")
    return got.select("user_id", "reading", "n", "expected", F.round("percentile", 6).alias("percentile"))


@query(f"""WITH {_LOO}, p AS (SELECT *, CASE WHEN n > 0 THEN 100.0 * (below + equal / 2) / n END AS r, CAST(floor(med + 0.5) AS BIGINT) AS expected FROM lo)
SELECT user_id, CASE WHEN r IS NULL OR reading IS NULL OR n < 7 THEN 'unavailable' WHEN expected = 0 THEN CASE WHEN reading = 0 THEN 'quiet' ELSE 'unavailable' END WHEN r >= 90 THEN 'veryBusy' WHEN r >= 75 THEN 'busy' WHEN r >= 25 THEN 'typical' ELSE 'quiet' END AS activity,
round(CASE WHEN expected > 0 THEN reading / expected END, 3) AS ratio FROM p""")
def activity_label(spark, sf_dir):
    got = counters.leave_one_out(_readings(spark, sf_dir), "user_id", ["dow", "slot"], "ts", "v")
    return got.select("user_id", counters.activity(F.col("percentile"), F.col("expected"), F.col("reading"), F.col("n")).alias("activity"), counters.ratio(F.col("reading"), F.col("expected")).alias("ratio"))


_DAILY = "dl AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'purchase') AS n FROM events GROUP BY 1, 2)"


def _daily(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("n"))


@query(f"WITH {_DAILY}, s AS (SELECT *, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day DESC) AS stops FROM dl) SELECT user_id, count(*) FILTER (WHERE stops = 0) AS fault_days, count(*) FILTER (WHERE stops = 0) >= 7 AS faulted FROM s GROUP BY 1")
def fault_runs(spark, sf_dir):
    got = counters.fault_runs(_daily(spark, sf_dir), "user_id", "day", F.col("n") > 0, F.col("n").isNull())
    return got.withColumn("faulted", F.col("fault_days") >= counters.FAULT_DAYS)


@query(f"WITH {_DAILY}, m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM dl), i AS (SELECT user_id, k - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM m WHERE n = 0), r AS (SELECT user_id, g, count(*) AS len FROM i GROUP BY 1, 2), u AS (SELECT DISTINCT user_id FROM dl) SELECT u.user_id, coalesce(max(len), 0) AS longest FROM u LEFT JOIN r USING (user_id) GROUP BY 1")
def longest_zero_run(spark, sf_dir):
    return counters.longest_run(_daily(spark, sf_dir), "user_id", "day", F.col("n") == 0)


@query("WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), h AS (SELECT user_id, date_diff('second', last, TIMESTAMP '2024-01-31') / 3600 AS hours FROM l) SELECT user_id, CASE WHEN hours <= 30 THEN 'fresh' WHEN hours <= 168 THEN 'stale' ELSE 'offline' END AS state FROM h")
def staleness(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.date_trunc("second", "ts")).alias("last"))
    hours = F.timestamp_diff("SECOND", F.col("last").cast("timestamp_ntz"), F.lit(datetime(2024, 1, 31)).cast("timestamp_ntz")) / 3600
    return last.select("user_id", counters.staleness(hours).alias("state"))


@query("SELECT user_id, count(DISTINCT epoch(ts)::BIGINT // 900) AS present, CAST(max(epoch(ts)::BIGINT // 900) - min(epoch(ts)::BIGINT // 900) + 1 AS BIGINT) AS expected FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY 1")
def grid_coverage(spark, sf_dir):
    return counters.coverage_of_grid(table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", "ts")), "user_id", "ts").drop("share")


@query("SELECT user_id AS user_id, count(*) AS rows, round(sum(value), 4) AS total, min(ts) AS first, max(ts) AS last FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND event_type = 'click' GROUP BY 1")
def window_extent(spark, sf_dir):
    window = sources.resolve_window(datetime(2024, 1, 12), since=datetime(2024, 1, 5))
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = sources.extent_by_key(sources.window_scan(e, "ts", window, ["user_id", "ts", "value"], {"event_type": "click"}), "user_id", "ts", "value")
    return got.withColumn("total", F.round("total", 4))


def _sensors(spark, sf_dir) -> DataFrame:
    """Suppliers as sensors: every fifth has no serial, serials repeat, places by nation."""
    k, nation = F.col("s_suppkey"), F.col("s_nationkey")
    serial = F.when(k % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("Y"), (k % 40).cast("string")))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), serial.alias("serial"), F.when(k % 7 != 0, 40.5 + nation / 100.0).alias("lat"), F.when(k % 7 != 0, -74.0 + nation / 100.0 + k % 40 / 1000.0).alias("lon"), F.lit(" Bike, pedestrian").alias("modes"), (k % 2 == 0).alias("directional"))


_SENSORS = """sn AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 5 <> 0 THEN 'Y' || (s_suppkey % 40) END AS serial, CASE WHEN s_suppkey % 7 <> 0 THEN 40.5::DOUBLE + s_nationkey / 100.0::DOUBLE END AS lat,
CASE WHEN s_suppkey % 7 <> 0 THEN -74.0::DOUBLE + s_nationkey / 100.0::DOUBLE + s_suppkey % 40 / 1000.0::DOUBLE END AS lon FROM supplier),
gr AS (SELECT coalesce(serial, 'geo:' || printf('%.5f', lat) || ',' || printf('%.5f', lon), 'id:' || id) AS serial, list(DISTINCT id ORDER BY id) AS ids, arg_max(lat, id) FILTER (WHERE lat IS NOT NULL) AS lat, arg_max(lon, id) FILTER (WHERE lon IS NOT NULL) AS lon, list(name) AS names FROM sn GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_SENSORS}, ed AS (SELECT a.serial AS a, b.serial AS b FROM gr a JOIN gr b ON a.serial <> b.serial AND (list_has_any(a.ids, b.ids) OR (abs(a.lat - b.lat) <= 0.0001 AND abs(a.lon - b.lon) <= 0.0001))),
rc(node, other) AS (SELECT serial, serial FROM gr UNION SELECT rc.node, ed.b FROM rc JOIN ed ON rc.other = ed.a), co AS (SELECT node, min(other) AS c FROM rc GROUP BY 1), ex AS (SELECT c, serial, unnest(ids) AS id FROM co JOIN gr ON node = serial), ns AS (SELECT c, unnest(names) AS name FROM co JOIN gr ON node = serial)
SELECT max(serial) AS serial, count(DISTINCT serial) - 1 AS aliases, string_agg(DISTINCT CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) AS sensor_ids, min(id) AS representative, (SELECT arg_min(name, (length(name), name)) FROM ns WHERE ns.c = ex.c) AS name FROM ex GROUP BY c""")
def physical_counters(spark, sf_dir):
    got = sensors.physical(sensors.grouped(_sensors(spark, sf_dir)))
    return got.select("serial", F.size("aliases").cast("long").alias("aliases"), F.concat_ws(",", F.array_sort(F.col("sensor_ids").cast("array<string>"))).alias("sensor_ids"), "representative", "name")


@query("""WITH x AS (SELECT l_suppkey, l_quantity, CASE WHEN s_suppkey IS NULL THEN 'unknown_sensor' WHEN l_linestatus <> 'F' THEN 'wrong_mode' WHEN l_quantity > 45 THEN 'missing_count' END AS reason FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey + 7) SELECT coalesce(reason, 'counted') AS reason, count(*) AS n FROM x GROUP BY 1""")
def route_counts(spark, sf_dir):
    index = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 7).alias("id"), F.col("s_name").alias("serial"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sensor_id"), F.col("l_linestatus").alias("mode"), F.col("l_shipdate").alias("ts"), F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("v"))
    return sensors.routed(rows, index, "F").groupBy(F.coalesce("reason", F.lit("counted")).alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT l_suppkey AS k, min(l_shipdate) AS first, max(l_shipdate) AS last, 'all' AS source FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, min(l_shipdate), max(l_shipdate), 'returned' FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT 'S' || (k % 10) AS serial, min(first) AS first, arg_min(source, (first, source)) AS first_from, max(last) AS last, arg_max(source, (last, source)) AS last_from FROM e GROUP BY 1""")
def data_edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sensor_id"), "l_shipdate", "l_returnflag")
    extent_of = lambda df, name: df.groupBy("sensor_id").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last")).withColumn("source", F.lit(name))
    index = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("S"), F.col("s_suppkey") % 10).alias("serial"))
    return sensors.edges_of_data(index, extent_of(li, "all").union(extent_of(li.where("l_returnflag = 'R'"), "returned")))


# ------------------------------------------------------------------ surveys


_PERIOD = {"1-URGENT": "am", "2-HIGH": "am", "3-MEDIUM": "md", "4-NOT SPECIFIED": "pm", "5-LOW": "pm"}
_CELLS = "c AS (SELECT o_custkey % 50 AS site, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN month(o_orderdate) <= 6 THEN 5 ELSE 9 END AS month, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'am' WHEN '2' THEN 'am' WHEN '3' THEN 'md' ELSE 'pm' END AS period, count(*) AS value FROM orders GROUP BY ALL)"


def _wide(spark, sf_dir) -> DataFrame:
    """Orders as a wide survey table: one column a (year, month, period)."""
    o = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("site"), F.year("o_orderdate").alias("y"), F.when(F.month("o_orderdate") <= 6, "may").otherwise("sept").alias("m"), text.recode(F.col("o_orderpriority"), _PERIOD).alias("p"))
    names = [f"{m}_{y:02d}_{p}" for y in [*range(92, 100), *range(8)] for m in ("may", "sept") for p in ("am", "md", "pm")]
    name = F.concat("m", F.lit("_"), F.lpad((F.col("y") % 100).cast("string"), 2, "0"), F.lit("_"), "p")
    return o.withColumn("k", name).groupBy("site").pivot("k", names).count()


def _survey(spark, sf_dir) -> DataFrame:
    wide = _wide(spark, sf_dir)
    columns = {c: (y - 100 if y > 2090 else y, m, p) for c, (y, m, p) in surveys.survey_columns(wide.columns).items()}  # 19xx
    return surveys.surveys(surveys.to_rows(wide, ["site"], columns), ["site"])


_SURVEY = f"{_CELLS}, s AS (SELECT site, year, month, max(value) FILTER (WHERE period = 'am') AS am, max(value) FILTER (WHERE period = 'md') AS md, max(value) FILTER (WHERE period = 'pm') AS pm FROM c GROUP BY ALL), sv AS (SELECT *, coalesce(am, 0) + coalesce(md, 0) + coalesce(pm, 0) AS total, am IS NOT NULL AND md IS NOT NULL AND pm IS NOT NULL AS complete FROM s)"


@query(f"WITH {_SURVEY} SELECT site, year, month, am, md, pm, total, complete FROM sv")
def unpivot_surveys(spark, sf_dir):
    return _survey(spark, sf_dir)


@query(f"""WITH {_SURVEY}, v AS (SELECT * FROM sv WHERE complete), m AS (SELECT site, arg_min(month, year * 12 + month) AS month FROM v GROUP BY 1),
p AS (SELECT v.site, min(year) AS fy, max(year) AS ly, arg_min(total, year) AS f, arg_max(total, year) AS l FROM v JOIN m USING (site, month) GROUP BY 1), q AS (SELECT d.site, p.* EXCLUDE (site), coalesce(ly - fy >= 5 AND f > 0, false) AS ok FROM (SELECT DISTINCT site FROM sv) d LEFT JOIN p USING (site))
SELECT site, CASE WHEN ok THEN fy END AS first_year, CASE WHEN ok THEN ly END AS last_year, CASE WHEN ok THEN f END AS first_total, CASE WHEN ok THEN l END AS last_total, CASE WHEN ok THEN l - f END AS change,
CASE WHEN NOT ok THEN 'insufficient' WHEN l - f > 0.15 * f THEN 'rising' WHEN l - f < -0.15 * f THEN 'falling' ELSE 'flat' END AS trend FROM q""")
def survey_trend(spark, sf_dir):
    return surveys.comparable(_survey(spark, sf_dir), "site")


@query(f"WITH {_SURVEY} SELECT site, year, month, total, complete FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY year DESC, month DESC) AS k FROM sv) WHERE k = 1")
def latest_survey(spark, sf_dir):
    return surveys.latest(_survey(spark, sf_dir), "site").select("site", "year", "month", "total", "complete")


@query(f"WITH {_SURVEY}, b AS (SELECT *, lag(total) OVER (PARTITION BY site, month ORDER BY year) AS b FROM sv WHERE complete) SELECT site, month, year, round((total - b) / b, 6) AS change FROM b WHERE b > 0")
def year_on_year(spark, sf_dir):
    return surveys.year_on_year(_survey(spark, sf_dir), "site").withColumn("change", F.round("change", 6))


@query("WITH l AS (SELECT user_id, event_id, ts, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b, value FROM events) SELECT user_id, event_id FROM l WHERE b >= value")
def series_monotone(spark, sf_dir):
    return surveys.not_rising(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "value", "event_id").select("user_id", "event_id")


@query(f"WITH {_SURVEY} SELECT site, string_agg(year || '-' || month || ':' || coalesce(CAST(CASE WHEN complete THEN total END AS VARCHAR), 'x'), ',' ORDER BY year, month) AS series FROM sv GROUP BY 1")
def survey_series(spark, sf_dir):
    item = F.transform("series", lambda x: F.concat(x["year"].cast("string"), F.lit("-"), x["month"].cast("string"), F.lit(":"), F.coalesce(x["total"].cast("string"), F.lit("x"))))
    return surveys.series(_survey(spark, sf_dir), "site").select("site", F.concat_ws(",", item).alias("series"))


@query(f"WITH {_SURVEY} SELECT site, year, month, round(total / max(total) OVER (PARTITION BY site), 6) AS share, row_number() OVER (PARTITION BY site ORDER BY year * 12 + month) = 1 AS is_first, row_number() OVER (PARTITION BY site ORDER BY year * 12 + month DESC) = 1 AS is_last FROM sv")
def survey_bars(spark, sf_dir):
    got = surveys.bars(_survey(spark, sf_dir).withColumn("k", F.col("year") * 12 + F.col("month")), "site", "k", "total")
    return got.select("site", "year", "month", F.round("share", 6).alias("share"), "is_first", "is_last")


# ------------------------------------------------------------------ cohorts


_AREAS = "a AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS cohort, c_nationkey AS area, CASE o_orderstatus WHEN 'F' THEN 'vacant' WHEN 'O' THEN 'nonVacant' ELSE 'unknown' END AS status, o_orderpriority = '1-URGENT' AS flag, o_totalprice > 100000 AS mappable FROM orders JOIN customer ON o_custkey = c_custkey)"


def _areas(spark, sf_dir) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    status = F.coalesce(text.recode(F.col("o_orderstatus"), {"F": "vacant", "O": "nonVacant"}), F.lit("unknown"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.year("o_orderdate").cast("string").alias("cohort"), F.col("c_nationkey").alias("area"), status.alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("flag"), (F.col("o_totalprice") > 100000).alias("mappable"))


@query(f"""WITH {_AREAS}, c AS (SELECT cohort, area, status, flag, count(*) AS n, count(*) FILTER (WHERE mappable) AS m FROM a GROUP BY ALL)
SELECT cohort, area, CAST(sum(n) AS BIGINT) AS total, CAST(sum(m) AS BIGINT) AS mappable, string_agg(status || ':' || flag || ':' || n || ':' || m, ',' ORDER BY status, CAST(flag AS VARCHAR)) AS counts FROM c GROUP BY 1, 2""")
def area_matrix(spark, sf_dir):
    cells = cohorts.area_cells(_areas(spark, sf_dir), ["cohort", "area"], ["status", "flag"], F.col("mappable"))
    got = cohorts.area_matrix(cells, ["cohort", "area"], ["status", "flag"])
    cell = F.transform("counts", lambda x: F.concat_ws(":", x["status"], x["flag"], x["n"].cast("string"), x["mappable"].cast("string")))
    return got.withColumn("counts", F.concat_ws(",", cell))


@query(f"WITH {_AREAS} SELECT cohort, count(*) AS rows, count(*) FILTER (WHERE status = 'vacant') AS vacant, count(*) FILTER (WHERE status = 'nonVacant') AS \"nonVacant\", count(*) FILTER (WHERE status = 'unknown') AS unknown, count(*) FILTER (WHERE mappable) AS mappable, count(*) FILTER (WHERE area >= 20) AS unknown_area, count(*) FILTER (WHERE status = 'nonVacant') > 0 AS share_supported FROM a GROUP BY 1")
def coverage(spark, sf_dir):
    return cohorts.coverage(_areas(spark, sf_dir), "cohort", "status", F.col("area") < 20, F.col("mappable"))


@query(f"WITH {_AREAS}, s AS (SELECT cohort, count(*) FILTER (WHERE status = 'nonVacant') > 0 AS ok FROM a GROUP BY 1), k AS (SELECT cohort, area, count(*) FILTER (WHERE status = 'vacant') AS positive_n, count(*) FILTER (WHERE status = 'nonVacant') AS negative_n FROM a GROUP BY 1, 2) SELECT cohort, area, positive_n, negative_n, CASE WHEN ok AND positive_n + negative_n > 0 THEN round(100.0::DOUBLE * positive_n / (positive_n + negative_n), 1) END AS share FROM k JOIN s USING (cohort)")
def vacancy_share(spark, sf_dir):
    a = _areas(spark, sf_dir)
    cells = cohorts.area_cells(a, ["cohort", "area"], ["status"], F.col("mappable"))
    return cohorts.share(cells, ["cohort", "area"], "status", cohorts.coverage(a, "cohort", "status", F.lit(True), F.col("mappable")), "cohort")


@query(f"WITH {_AREAS}, x AS (SELECT cohort, count(*) AS old, count(*) - CASE WHEN CAST(cohort AS INTEGER) % 2 = 0 THEN count(*) // 10 ELSE 0 END AS new FROM a GROUP BY 1) SELECT cohort, 'rows' AS field, old, CASE WHEN cohort <> '1995' THEN new END AS new, CASE WHEN cohort = '1995' THEN 'removed' ELSE 'changed' END AS problem FROM x WHERE cohort = '1995' OR (old <> 0 AND abs(new - old) > 0.05 * old)")
def cohort_drift(spark, sf_dir):
    old = _areas(spark, sf_dir).groupBy("cohort").agg(F.count("*").alias("rows"))
    less = F.when(F.col("cohort").cast("int") % 2 == 0, F.floor(F.col("rows") / 10)).otherwise(0)
    return cohorts.drift(old, old.where("cohort <> '1995'").select("cohort", (F.col("rows") - less).alias("rows")), "cohort", ["rows"])


@query("SELECT n_nationkey, n_regionkey, n_name, r_name, r_name IS NOT NULL AS has_boundary FROM nation LEFT JOIN region ON n_regionkey = r_regionkey + 2")
def boundary_join(spark, sf_dir):
    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 2).alias("n_regionkey"), "r_name")
    return cohorts.with_boundaries(table(spark, sf_dir, "nation"), r, ["n_regionkey"])


@query("SELECT a.n_nationkey AS n_nationkey, b.n_nationkey AS sibling FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def area_siblings(spark, sf_dir):
    return cohorts.siblings(table(spark, sf_dir, "nation"), "n_nationkey", ["n_regionkey"])


@query("SELECT a.y AS year, count(*) AS kept FROM (SELECT DISTINCT year(o_orderdate) AS y, o_custkey FROM orders) a WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = a.o_custkey AND year(o.o_orderdate) = a.y - 1) GROUP BY 1")
def adjacent_overlap(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("year"), "o_custkey").distinct()
    return a.join(a.select((F.col("year") + 1).alias("year"), "o_custkey"), ["year", "o_custkey"], "left_semi").groupBy("year").agg(F.count("*").alias("kept"))


@query("SELECT 'lost' AS \"where\", o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'added', o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def lossless_partition(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    # a faulty partition: one status has no part, and one part is there again
    parts = [o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")]
    return cohorts.lost_rows(o, parts).select("where", "o_orderkey")


# ------------------------------------------------------------------ profiles, contracts


@query("SELECT 'l_returnflag' AS \"column\", count(l_returnflag) AS present, count(*) - count(l_returnflag) AS nulls, count(DISTINCT l_returnflag) AS \"distinct\" FROM lineitem UNION ALL SELECT 'l_partkey', count(l_partkey), count(*) - count(l_partkey), count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'l_shipdate', count(l_shipdate), count(*) - count(l_shipdate), count(DISTINCT l_shipdate) FROM lineitem")
def column_profile(spark, sf_dir):
    return profile.columns(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_partkey", "l_shipdate"])


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def category_histogram(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("SELECT length(CAST(o_orderkey AS VARCHAR)) AS length, count(*) AS n, count(*) FILTER (WHERE starts_with(CAST(o_orderkey AS VARCHAR), '0')) AS leading_zero, 0::BIGINT AS not_digits FROM orders GROUP BY 1")
def length_hist(spark, sf_dir):
    return profile.lengths(table(spark, sf_dir, "orders"), "o_orderkey").withColumn("length", F.col("length").cast("long"))


@query("SELECT size, count(*) AS groups FROM (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1) GROUP BY 1")
def group_hist(spark, sf_dir):
    return profile.group_sizes(table(spark, sf_dir, "orders"), ["o_custkey"])


@query("SELECT count(*) AS keys, round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS median, round(quantile_cont(n, 0.9), 6) AS p90, max(n) AS most, count(*) FILTER (WHERE n > 1) AS repeated FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def rows_per_key_dist(spark, sf_dir):
    return profile.rows_per_key(table(spark, sf_dir, "orders"), ["o_custkey"]).withColumn("mean", F.round("mean", 6)).withColumn("p90", F.round("p90", 6))


@query("SELECT round(quantile_cont(x, 0.5), 6) AS median_imbalance, round(avg(CASE WHEN x > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS one_sided FROM (SELECT abs(a - b) / (a + b) AS x FROM (SELECT user_id, coalesce(sum(value) FILTER (WHERE event_type = 'click'), NULL) AS a, sum(value) FILTER (WHERE event_type = 'view') AS b FROM events GROUP BY 1) WHERE a + b > 0)")
def direction_imbalance(spark, sf_dir):
    return profile.imbalance(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value", ("click", "view")).select(F.round("median_imbalance", 6).alias("median_imbalance"), F.round("one_sided", 6).alias("one_sided"))


@query("SELECT o_custkey % 100 AS k, round(quantile_cont(o_totalprice, 0.5) FILTER (WHERE month(o_orderdate) = 9) / quantile_cont(o_totalprice, 0.5) FILTER (WHERE month(o_orderdate) = 1), 6) AS ratio FROM orders GROUP BY 1 HAVING quantile_cont(o_totalprice, 0.5) FILTER (WHERE month(o_orderdate) = 1) > 0 AND quantile_cont(o_totalprice, 0.5) FILTER (WHERE month(o_orderdate) = 9) IS NOT NULL")
def seasonal_ratio(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") % 100)
    return profile.seasonal_ratio(o, ["k"], F.month("o_orderdate"), "o_totalprice", 9, 1).withColumn("ratio", F.round("ratio", 6))


@query("SELECT DISTINCT o_orderkey + 3 AS key, 'orders' AS only_in FROM orders WHERE o_orderkey + 3 NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'lineitem' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey + 3 FROM orders)")
def key_set_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 3).alias("key"))  # shifted keys, so that both sides have some of their own
    return validate.key_difference(o, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), "key", ("orders", "lineitem"))


@query("SELECT 'price is positive' AS \"check\", 'error' AS severity, count(*) FILTER (WHERE o_totalprice <= 0) AS broken FROM orders UNION ALL SELECT 'status is known', 'warning', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) FROM orders")
def contract_checks(spark, sf_dir):
    return validate.run_checks(table(spark, sf_dir, "orders"), [validate.Check("price is positive", F.col("o_totalprice") <= 0), validate.Check("status is known", ~F.col("o_orderstatus").isin("F", "O"), validate.WARNING)])


@query("SELECT o.o_custkey AS key, CAST(n + CASE WHEN o.o_custkey % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS published, n AS recomputed FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o WHERE o.o_custkey % 10 = 0")
def recomputed_from_raw(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "key")
    published = raw.groupBy("key").agg((F.count("*") + F.when(F.col("key") % 10 == 0, 1).otherwise(0)).alias("n"))
    return validate.recomputed(published, raw, "key", "n", F.count("*"))


@query("""WITH d AS (SELECT sha256(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus) AS d FROM orders)
SELECT count(*) AS rows, sha256(count(*) || '|' || sum(CAST('0x' || substr(d, 1, 15) AS BIGINT)) || '|' || sum(CAST('0x' || substr(d, 17, 15) AS BIGINT)) || '|' || sum(CAST('0x' || substr(d, 33, 15) AS BIGINT)) || '|' || sum(CAST('0x' || substr(d, 49, 15) AS BIGINT))) AS content_hash FROM d""")
def content_hash(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return ids.content_hash(o, ids.row_digest(F.col("o_orderkey"), F.col("o_orderstatus")))


# ------------------------------------------------------------------ publication and contracts


_STATE = """st AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey * 7 % 300 END AS hours, c_custkey % 10 AS zero_days, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 50 END AS reading, c_custkey * 3 % 17 AS samples, c_custkey * 3 % 20 AS median, (c_custkey * 37 % 1001) / 10.0::DOUBLE AS rank FROM customer),
s1 AS (SELECT *, CASE WHEN hours IS NULL THEN 'unavailable' WHEN hours <= 30 THEN CASE WHEN zero_days >= 7 THEN 'faulted' ELSE 'fresh' END WHEN hours <= 168 THEN 'stale' ELSE 'offline' END AS staleness FROM st),
s2 AS (SELECT *, staleness = 'fresh' AS active, staleness NOT IN ('offline', 'unavailable') AND reading IS NOT NULL AS live FROM s1),
s3 AS (SELECT *, CASE WHEN live THEN reading END AS count, CASE WHEN live THEN 'T' || id END AS "observedAt", CASE WHEN live AND samples >= 7 THEN median END AS expected, CASE WHEN live AND samples >= 7 THEN rank END AS r FROM s2),
pb AS (SELECT id, staleness, active, count, "observedAt", samples, expected, CAST(floor(r + 0.5) AS BIGINT) AS percentile, CASE WHEN live AND expected > 0 THEN round(reading / expected, 3) END AS ratio,
CASE WHEN r IS NULL THEN 'unavailable' WHEN expected = 0 THEN CASE WHEN reading = 0 THEN 'quiet' ELSE 'unavailable' END WHEN r >= 90 THEN 'veryBusy' WHEN r >= 75 THEN 'busy' WHEN r >= 25 THEN 'typical' ELSE 'quiet' END AS activity FROM s3)"""
_PUBLISHED = ("id", "staleness", "active", "count", "observedAt", "samples", "expected", "percentile", "ratio", "activity")


def _published(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 11 != 0, k * 7 % 300).alias("hours"), (k % 10).alias("zero_days"), F.when(k % 6 != 0, k % 50).alias("reading"), F.concat(F.lit("T"), k.cast("string")).alias("observed_at"),
        (k * 3 % 17).alias("samples"), (k * 3 % 20).alias("median"), (k * 37 % 1001 / 10.0).alias("rank"))
    return publication.published(df).select(*_PUBLISHED)


@query(f"WITH {_STATE} SELECT * FROM pb")
def published_state(spark, sf_dir):
    return _published(spark, sf_dir)


@query(f"""WITH {_STATE}, x AS (SELECT * REPLACE (CASE WHEN id % 13 = 0 THEN ratio + 0.01 ELSE ratio END AS ratio, active <> (id % 17 = 0) AS active, CASE WHEN id % 19 = 0 THEN 'busy' ELSE activity END AS activity, CASE WHEN id % 23 = 0 THEN NULL ELSE "observedAt" END AS "observedAt", CASE WHEN id % 29 = 0 THEN 3 ELSE samples END AS samples) FROM pb)
SELECT unnest(['counts are not negative', 'percentile is from 0 to 100', 'no baseline from too few samples', 'enough samples have a baseline', 'nothing expected is quiet or unavailable', 'no level of traffic where none is expected', 'no ratio to nothing', 'a dead counter has no number', 'a fresh counter has a reading', 'a reading and its time go together', 'active is fresh', 'ratio is count over expected', 'a ratio has both its parts']) AS "check", 'error' AS severity,
unnest([count(*) FILTER (WHERE count < 0 OR expected < 0), count(*) FILTER (WHERE percentile NOT BETWEEN 0 AND 100), count(*) FILTER (WHERE samples < 7 AND (expected IS NOT NULL OR percentile IS NOT NULL OR activity <> 'unavailable')), count(*) FILTER (WHERE samples >= 7 AND expected IS NULL AND count IS NOT NULL),
count(*) FILTER (WHERE expected = 0 AND count IS NOT NULL AND activity <> CASE WHEN count = 0 THEN 'quiet' ELSE 'unavailable' END), count(*) FILTER (WHERE expected = 0 AND activity IN ('typical', 'busy', 'veryBusy')), count(*) FILTER (WHERE expected = 0 AND ratio IS NOT NULL), count(*) FILTER (WHERE staleness IN ('offline', 'unavailable') AND coalesce(count, expected, percentile, ratio) IS NOT NULL),
count(*) FILTER (WHERE staleness = 'fresh' AND (count IS NULL OR "observedAt" IS NULL)), count(*) FILTER (WHERE (count IS NULL) <> ("observedAt" IS NULL)), count(*) FILTER (WHERE active <> (staleness = 'fresh')), count(*) FILTER (WHERE expected > 0 AND count IS NOT NULL AND NOT coalesce(abs(ratio - count / expected) <= 0.005, false)), count(*) FILTER (WHERE ratio IS NOT NULL AND (count IS NULL OR expected IS NULL))]) AS broken FROM x""")
def sensors_contract(spark, sf_dir):
    k, planted = F.col("id"), _published(spark, sf_dir)
    planted = (
        planted.withColumn("ratio", F.when(k % 13 == 0, F.col("ratio") + 0.01).otherwise(F.col("ratio"))).withColumn("active", F.col("active") != (k % 17 == 0)).withColumn("activity", F.when(k % 19 == 0, "busy").otherwise(F.col("activity")))
        .withColumn("observedAt", F.when(k % 23 != 0, F.col("observedAt"))).withColumn("samples", F.when(k % 29 == 0, 3).otherwise(F.col("samples"))))
    return validate.run_checks(planted, contracts.sensors())


@query(f"""WITH {_STATE}, l AS (SELECT id + 5 AS id, CASE WHEN (id + 5) % 7 = 0 THEN NULL ELSE q.count END AS count, q.activity FROM (SELECT id FROM pb) JOIN (SELECT id AS k, count, activity FROM pb) q ON k = id + 5 UNION ALL SELECT id + 5, NULL, 'x' FROM pb WHERE id + 5 NOT IN (SELECT id FROM pb))
SELECT id, unnest(CASE WHEN p.known IS NULL THEN ['unknown id'] WHEN l.seen IS NULL THEN ['missing row'] ELSE list_filter([CASE WHEN l.count IS DISTINCT FROM p.count THEN 'count differs' END, CASE WHEN l.activity IS DISTINCT FROM p.activity THEN 'activity differs' END], lambda x: x IS NOT NULL) END) AS problem FROM (SELECT *, true AS seen FROM l) l FULL JOIN (SELECT *, true AS known FROM pb) p USING (id)""")
def latest_check(spark, sf_dir):
    sensors_now = _published(spark, sf_dir).select("id", "count", "activity")
    view, _ = publication.latest_view(sensors_now, ["id"], "id")
    view = view.select((F.col("id") + 5).alias("id")).join(sensors_now, "id", "left").withColumn("activity", F.coalesce("activity", F.lit("x"))).withColumn("count", F.when(F.col("id") % 7 != 0, F.col("count")))
    return publication.latest_problems(view, sensors_now, "id", ["count", "activity"])


@query("SELECT count(*) AS sensors, max(o_orderdate) AS \"latestObservation\" FROM orders")
def latest_summary(spark, sf_dir):
    return publication.latest_view(table(spark, sf_dir, "orders"), ["o_orderkey"], "o_orderdate")[1]


@query(f"""WITH {_SURVEY}, v AS (SELECT * FROM sv) SELECT site, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS years_measured FROM v GROUP BY 1""")
def site_years(spark, sf_dir):
    return publication.site_years(_survey(spark, sf_dir), "site")


@query(f"""WITH {_SURVEY}, v AS (SELECT *, CASE month WHEN 5 THEN 'may' ELSE 'sept' END AS season FROM sv)
SELECT 'season' AS kind, 'may' AS value, count(*) FILTER (WHERE season = 'may') AS n FROM v UNION ALL SELECT 'season', 'sept', count(*) FILTER (WHERE season = 'sept') FROM v UNION ALL SELECT 'season', 'oct', 0 FROM (SELECT 1) UNION ALL SELECT 'measured', 'am', count(am) FROM v UNION ALL SELECT 'measured', 'md', count(md) FROM v UNION ALL SELECT 'measured', 'pm', count(pm) FROM v""")
def survey_tallies(spark, sf_dir):
    v = _survey(spark, sf_dir).withColumn("season", F.when(F.col("month") == 5, "may").otherwise("sept"))
    return publication.tallies(v, {"season": ("may", "sept", "oct")}, ("am", "md", "pm"))


_RAW_CELL = "CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN '-' || CAST(l_quantity AS BIGINT) WHEN 2 THEN CAST(CAST(l_quantity AS BIGINT) % 3 AS VARCHAR) END"


@query(f"WITH x AS (SELECT {_RAW_CELL} AS a FROM lineitem) SELECT count(*) FILTER (WHERE coalesce(a, '') = '') AS null_cells, count(*) FILTER (WHERE a LIKE '-%') AS bad_cells, count(*) FILTER (WHERE a = '0') AS zero_cells FROM x")
def cell_tallies(spark, sf_dir):
    n, q = F.col("l_linenumber") % 4, F.col("l_quantity").cast("long")
    a = F.when(n == 0, "").when(n == 1, F.concat(F.lit("-"), q.cast("string"))).when(n == 2, (q % 3).cast("string"))
    return publication.cell_tallies(table(spark, sf_dir, "lineitem").select(a.alias("a")), {"a": parse.count(F.col("a"))})


_HISTORY = """hs AS (SELECT c_custkey AS id, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS am, CASE WHEN c_custkey % 5 <> 0 THEN count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') END AS md, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS pm, year(min(o_orderdate)) AS "firstYear", year(max(o_orderdate)) AS "lastYear", count(DISTINCT year(o_orderdate)) AS "yearsMeasured" FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1),
hx AS (SELECT *, am + coalesce(md, 0) + pm + CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END AS total, CASE WHEN id % 4 <> 0 THEN am - pm END AS change, CASE WHEN id % 4 <> 0 AND id % 14 <> 0 THEN "firstYear" || CASE WHEN id % 6 = 0 THEN '-' ELSE '–' END || "lastYear" END AS "changeYears", CASE WHEN id % 4 = 0 AND id % 12 <> 0 THEN 'insufficient' WHEN id % 10 = 3 THEN 'odd' ELSE 'flat' END AS trend, CASE WHEN id % 8 <> 0 THEN 'May 1998' END AS "latestSurvey" FROM hs)"""


@query(f"""WITH {_HISTORY} SELECT unnest(['periods are not negative', 'total is the sum of its periods', 'no total without a period', 'trend is known', 'change and its years go together', 'change years are a range', 'no change is insufficient', 'years are in order', 'a first year was measured', 'counts and the latest survey go together']) AS "check", 'error' AS severity,
unnest([0, count(*) FILTER (WHERE id % 9 = 0), 0, count(*) FILTER (WHERE trend = 'odd'), count(*) FILTER (WHERE (change IS NULL) <> ("changeYears" IS NULL)), count(*) FILTER (WHERE "changeYears" NOT LIKE '%–%'), count(*) FILTER (WHERE (trend = 'insufficient') <> (change IS NULL)), count(*) FILTER (WHERE "firstYear" > "lastYear"), 0, count(*) FILTER (WHERE "latestSurvey" IS NULL)]) AS broken FROM hx""")
def history_contract(spark, sf_dir):
    o, c, k = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), F.col("id")
    period = lambda p: F.count_if(F.col("o_orderpriority") == p)
    sites = c.join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_custkey").alias("id")).agg(
        period("1-URGENT").alias("am"), F.when(k % 5 != 0, period("3-MEDIUM")).alias("md"), period("5-LOW").alias("pm"), F.year(F.min("o_orderdate")).alias("firstYear"), F.year(F.max("o_orderdate")).alias("lastYear"), F.count_distinct(F.year("o_orderdate")).alias("yearsMeasured"))
    years = F.concat(F.col("firstYear").cast("string"), F.when(k % 6 == 0, "-").otherwise("–"), F.col("lastYear").cast("string"))
    planted = sites.select(
        "*", (F.col("am") + F.coalesce("md", F.lit(0)) + F.col("pm") + F.when(k % 9 == 0, 1).otherwise(0)).alias("total"), F.when(k % 4 != 0, F.col("am") - F.col("pm")).alias("change"), F.when((k % 4 != 0) & (k % 14 != 0), years).alias("changeYears"),
        F.when((k % 4 == 0) & (k % 12 != 0), "insufficient").when(k % 10 == 3, "odd").otherwise("flat").alias("trend"), F.when(k % 8 != 0, "May 1998").alias("latestSurvey"))
    return validate.run_checks(planted, contracts.history())


@query(f"""WITH {_AREAS}, c AS (SELECT cohort, count(*) AS n, count(*) FILTER (WHERE status = 'nonVacant') AS nv, count(*) FILTER (WHERE mappable) AS m FROM a GROUP BY 1)
SELECT cohort, 'mappable is not that of the areas' AS problem FROM c WHERE cohort = '1994' UNION ALL SELECT cohort, 'rows are not those of the areas' FROM c WHERE cohort = '1995' UNION ALL SELECT cohort, 'statuses don''t add up' FROM c WHERE cohort = '1995' UNION ALL SELECT cohort, 'no coverage' FROM c WHERE cohort = '1996' UNION ALL SELECT cohort, 'points are not those published' FROM c WHERE cohort = '1997' UNION ALL SELECT cohort, 'share is not supported as said' FROM c WHERE cohort = '1993'""")
def cohort_reconciliation(spark, sf_dir):
    a = _areas(spark, sf_dir)
    cells = cohorts.area_cells(a, ["cohort", "area"], ["status"], F.col("mappable"))
    points, y = a.where("status = 'vacant' and mappable"), F.col("cohort")
    coverage = cohorts.coverage(a, "cohort", "status", F.col("area").isNotNull(), F.col("mappable")).join(points.groupBy("cohort").agg(F.count("*").alias("points")), "cohort")
    wrong = lambda c, year: (F.col(c) + F.when(y == year, 1).otherwise(0)).alias(c)
    planted = coverage.where("cohort <> '1996'").select("cohort", wrong("rows", "1995"), "vacant", "nonVacant", "unknown", wrong("mappable", "1994"), "unknown_area", wrong("points", "1997"), (F.col("share_supported") != (y == "1993")).alias("share_supported"))
    return contracts.reconciled_cohorts(cells, points, planted)


@query("""SELECT unnest(['id has its pattern', 'name is there', 'name is not too long', 'kind is known', 'point is in the city', 'borough is known', 'postcode has five digits']) AS "check", unnest(['error', 'error', 'error', 'error', 'error', 'warning', 'warning']) AS severity,
unnest([count(*) FILTER (WHERE c_custkey < 10), count(*) FILTER (WHERE c_custkey % 31 = 0), 0, count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')), count(*) FILTER (WHERE c_custkey % 41 = 0), count(*) FILTER (WHERE c_nationkey > 20), count(*) FILTER (WHERE length(CAST(c_custkey AS VARCHAR)) <> 5 AND c_custkey % 3 <> 0)]) AS broken FROM customer""")
def licence_contract(spark, sf_dir):
    c, k = _points(table(spark, sf_dir, "customer"), "c_custkey"), F.col("c_custkey")
    rows = c.select(
        F.concat(F.lit("c"), k.cast("string")).alias("id"), F.when(k % 31 != 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("kind"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("borough"), F.when(k % 3 != 0, k.cast("string")).otherwise("").alias("zip"),
        F.when(k % 41 != 0, F.col("lat")).otherwise(F.lit(12.0)).alias("lat"), "lon")
    return validate.run_checks(rows, contracts.licences(("BUILDING", "MACHINERY"), [f"N{i}" for i in range(21)], "^c[0-9]{2,}$"))


@query(f"WITH {_RULES}, k AS (SELECT count(*) AS s, count(*) FILTER (WHERE len(codes) > 0) AS r, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS d FROM r) SELECT s AS source, r AS rejected, d AS duplicates, s - r AS published, d = 0 AS balanced, s - r >= 1500 AS enough FROM k")
def cross_check(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kept, rejected = quality.split(li, _order_rules())
    repeats = li.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").select(F.explode(F.sequence(F.lit(2), F.col("count"))))
    return contracts.cross_check(li, rejected, repeats, kept)


@query(f"WITH {_RULES}, u AS (SELECT codes[1] AS code, count(*) AS n FROM r WHERE len(codes) > 0 GROUP BY 1) SELECT code, n AS listed, n + 1 AS tallied FROM u WHERE code <> 'no_discount' UNION ALL SELECT 'unseen', 0, 1")
def code_tallies(spark, sf_dir):
    _, rejected = quality.split(table(spark, sf_dir, "lineitem"), _order_rules())
    tally = rejected.groupBy("code").agg((F.count("*") + F.when(F.col("code") != "no_discount", 1).otherwise(0)).alias("n"))
    return contracts.code_tallies(rejected, tally.union(spark.createDataFrame([("unseen", 1)], "code string, n long")))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(spark, sf_dir):
    return contracts.repeated_ids(table(spark, sf_dir, "orders"), "o_custkey")


@query(f"WITH {_AREAS}, b AS (SELECT *, CASE WHEN area % 3 = 0 THEN NULL ELSE flag END AS construction, 'N' || area AS borough FROM a) SELECT area, count(*) AS n FROM b WHERE cohort = '1995' AND status = 'vacant' AND construction IS NULL GROUP BY 1")
def report_filter(spark, sf_dir):
    a = _areas(spark, sf_dir).withColumn("construction", F.when(F.col("area") % 3 != 0, F.col("flag"))).withColumn("borough", F.concat(F.lit("N"), F.col("area").cast("string")))
    return publication.reports(a, "1995", construction="unknown").groupBy("area").agg(F.count("*").alias("n"))


@query(f"WITH p AS (SELECT s_suppkey + 4 AS c_custkey, s_name FROM supplier), g AS (SELECT c_custkey, {_SQL_POINTS.format(k='c_custkey')} FROM customer) SELECT p.c_custkey, s_name, round(lat, 6) AS lat, round(lon, 6) AS lon FROM p JOIN g USING (c_custkey)")
def geometry_lookup(spark, sf_dir):
    g = _points(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "lat", "lon")
    return publication.located(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 4).alias("c_custkey"), "s_name"), g, "c_custkey").withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


@query(f"WITH p AS (SELECT {_SQL_POINTS.format(k='c_custkey')} FROM customer) SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM p")
def bounds_union(spark, sf_dir):
    c = _points(table(spark, sf_dir, "customer"), "c_custkey")
    boxes = c.groupBy("c_nationkey").agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))
    return publication.bounds_union(boxes)


@query("""WITH g AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS kinds, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, o_orderkey, 'ambiguous_group' AS code, 'group of ' || n AS detail FROM orders JOIN g USING (o_custkey) WHERE kinds NOT IN (['F', 'O'], ['F'], ['O'])""")
def ambiguous_groups(spark, sf_dir):
    _, rejected = identity.ambiguous_groups(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O"])
    return rejected.select("o_custkey", "o_orderkey", "code", "detail")


@query(f"WITH p AS (SELECT c_nationkey, c_custkey, {_SQL_POINTS.format(k='c_custkey')} FROM customer) SELECT c_nationkey, round(arg_min(lat, c_custkey), 6) AS lat, round(arg_min(lon, c_custkey), 6) AS lon FROM p GROUP BY 1")
def first_points(spark, sf_dir):
    got = identity.point_of_first(_points(table(spark, sf_dir, "customer"), "c_custkey"), ["c_nationkey"], F.col("c_custkey"))
    return got.select("c_nationkey", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


# ------------------------------------------------------------------ scalars of points, dates, lists and JSON


_POINT_TEXT = "CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN 'x' WHEN 3 THEN '95' ELSE '0' END"


@query(f"""WITH x AS (SELECT s_suppkey, {_POINT_TEXT} AS t, CASE WHEN s_suppkey % 2 = 0 THEN '0' ELSE '-74.5' END AS lon FROM supplier)
SELECT s_suppkey, TRY_CAST(t AS DOUBLE) AS value, t IS NULL OR t = 'n/a' AS missing, coalesce(t = 'x', false) AS unparseable, CASE WHEN t IS NULL OR t = 'n/a' THEN 'missing_coordinates' WHEN t IN ('x', '95') THEN 'invalid_coordinates' WHEN lon = '0' THEN 'zero_coordinates' END AS problem FROM x""")
def coordinate_scalars(spark, sf_dir):
    k = F.col("s_suppkey")
    t = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "n/a").when(k % 5 == 2, "x").when(k % 5 == 3, "95").otherwise("0")
    df = table(spark, sf_dir, "supplier").select("s_suppkey", t.alias("t"), F.when(k % 2 == 0, "0").otherwise("-74.5").alias("lon"))
    value, missing, unparseable = parse.coordinate(F.col("t"))
    return df.select("s_suppkey", value.alias("value"), missing.alias("missing"), unparseable.alias("unparseable"), parse.world_point(F.col("t"), F.col("lon")).alias("problem"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_nationkey + 0.25 END AS lat, CASE WHEN s_suppkey % 4 = 0 THEN -74.5::DOUBLE END AS lon, CASE s_suppkey % 4 WHEN 1 THEN 'missing_geometry' WHEN 2 THEN 'not_a_point' WHEN 3 THEN 'bad_coordinates' END AS code FROM supplier""")
def geojson_points(spark, sf_dir):
    k, lat = F.col("s_suppkey") % 4, F.col("s_nationkey").cast("string")
    shape = lambda kind, y: F.concat(F.lit('{"type":"' + kind + '","coordinates":[-74.5,'), y, F.lit("]}"))
    g = F.when(k == 0, shape("Point", F.concat(lat, F.lit(".25")))).when(k == 2, shape("Line", lat)).when(k == 3, shape("Point", F.lit("95")))
    a, b, code = parse.geojson_point(g)
    return table(spark, sf_dir, "supplier").select("s_suppkey", a.alias("lat"), b.alias("lon"), code.alias("code"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS strict, strftime(o_orderdate, '%b ') || day(o_orderdate) || strftime(o_orderdate, ', %Y') AS shown, CASE month(o_orderdate) WHEN 5 THEN 'May ' WHEN 6 THEN 'June ' WHEN 9 THEN 'September ' WHEN 10 THEN 'October ' END || year(o_orderdate) AS survey, ['bike', lower(o_orderpriority)] AS names,
o_orderstatus || ' at ' || o_orderpriority AS joined FROM orders""")
def dates_and_names(spark, sf_dir):
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    names = text.name_set(F.concat(F.lit(" Bike,, "), F.col("o_orderpriority"), F.lit(", bike")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", parse.iso_date_strict(d).alias("strict"), text.day_text(F.col("o_orderdate")).alias("shown"), parse.survey_label(F.year("o_orderdate"), F.month("o_orderdate")).alias("survey"),
        F.reverse(names).alias("names"), text.joined(text.first_text(F.lit("n/a"), F.col("o_orderstatus")), "at", F.col("o_orderpriority")).alias("joined"))


@query("""SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","none":null}' AS json FROM customer""")
def contract_json(spark, sf_dir):
    return publish.contract_json(table(spark, sf_dir, "customer").withColumn("none", F.lit(None).cast("string")), ["c_custkey", "c_name", "none"])


@query("SELECT n_nationkey, 5 AS positions, n_nationkey + 0.5 AS lat, round(n_nationkey - 73.123457, 6) AS lon, n_nationkey % 2 = 0 AS closed FROM nation")
def boundary_shapes(spark, sf_dir):
    k = F.col("n_nationkey")
    corner = lambda dx, dy: F.array(k + F.lit(-74.1234567 + dx), (k + F.lit(float(dy))))
    ring = F.array(corner(0, 0), corner(2, 0), corner(2, 1), corner(0, 1), F.when(k % 2 == 0, corner(0, 0)).otherwise(corner(1, 0)))
    shape = geo.rounded_positions(F.array(F.array(ring)))
    lat, lon = geo.centre_of(geo.polygon_positions(shape))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.size(geo.polygon_positions(shape)).alias("positions"), lat.alias("lat"), lon.alias("lon"), contracts.rings_closed(shape).alias("closed"))


@query("SELECT min(c_acctbal) AS least, max(c_acctbal) AS greatest, count(*) FILTER (WHERE c_acctbal NOT BETWEEN 0 AND 5000) AS outside, count(*) FILTER (WHERE c_acctbal IS NULL) AS missing FROM customer")
def number_profile(spark, sf_dir):
    return profile.numeric(table(spark, sf_dir, "customer"), "c_acctbal", 0, 5000)


@query("SELECT l_orderkey, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return identity.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey + 9 FROM customer)")
def untraceable_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 9).alias("o_custkey"))
    return validate.untraceable(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey")


@query("""WITH e AS (SELECT l_suppkey AS id, count(*) AS rows, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1), i AS (SELECT s_suppkey AS id, s_suppkey % 7 AS serial, s_suppkey < 7 AS rep FROM supplier)
SELECT i.serial, i.id, e.rows, e.total, r.rows AS rep_rows, r.total AS rep_total FROM e JOIN i USING (id) JOIN (SELECT serial, rows, total FROM e JOIN i USING (id) WHERE rep) r USING (serial) WHERE NOT rep AND (e.rows <> r.rows OR e.total <> r.total)""")
def twin_problems(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sensor_id")).agg(F.count("*").alias("rows"), F.sum("l_linenumber").alias("total"))
    k = F.col("s_suppkey")
    return sensors.twin_problems(counts, table(spark, sf_dir, "supplier").select(k.alias("id"), (k % 7).alias("serial"), (k < 7).alias("is_representative")))


@query(f"WITH p AS (SELECT c_custkey, {_SQL_POINTS.format(k='c_custkey')} FROM customer) SELECT c_custkey, round((lon + 180) / 360, 9) AS x, round((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2, 9) AS y, round(lat, 5) AS view_lat, least(22.0, c_custkey / 4.0)::DOUBLE AS zoom, CASE WHEN c_custkey < 1000 THEN CAST(c_custkey AS VARCHAR) WHEN c_custkey < 10000 THEN ((c_custkey + 50) // 1000) || CASE WHEN (c_custkey + 50) // 100 % 10 = 0 THEN '' ELSE '.' || ((c_custkey + 50) // 100 % 10) END || 'k' ELSE ((c_custkey + 500) // 1000) || 'k' END AS short FROM p")
def map_scalars(spark, sf_dir):
    c = _points(table(spark, sf_dir, "customer"), "c_custkey")
    x, y = geo.mercator(F.col("lat"), F.col("lon"))
    lat, _, zoom = geo.clamped_view(F.col("lat"), F.col("lon"), F.col("c_custkey") / 4.0)
    return c.select("c_custkey", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"), lat.alias("view_lat"), zoom.alias("zoom"), geo.abbreviated(F.col("c_custkey")).alias("short"))
