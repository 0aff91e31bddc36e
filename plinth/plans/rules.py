"""Queries of nested rules, comparisons by moment and run reports. Faults are planted by keys; SQL counts them in unnested rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions import parse
from plinth.operators import contracts, graph, nested, sensors, validate
from plinth.plans.registry import query, table
from plinth.sources import publish

_SURVEYS = """b AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INTEGER) AS y, CASE WHEN o_custkey % 31 = 0 THEN -1 ELSE nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) END AS am,
nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS md, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS pm FROM orders GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY y) = 1 AND k % 19 = 0 AS more, (k % 37 = 0) <> (am IS NOT NULL AND md IS NOT NULL AND pm IS NOT NULL) AS complete FROM b)"""


@query(f"""WITH {_SURVEYS}, g AS (SELECT k, count(*) AS n, bool_or(am < 0) AS negative, bool_or(more) AS more, bool_or(complete <> (am IS NOT NULL AND md IS NOT NULL AND pm IS NOT NULL)) AS partial FROM s GROUP BY 1)
SELECT unnest(['there is a series', 'a series says that it is discrete', 'surveys are as many as said', 'every survey has a year and a month', 'surveys are in order', 'labels say year and month', 'every survey has a count', 'no count is negative',
'totals are the sums of their periods', 'complete surveys have every period']) AS "check", 'error' AS severity, unnest([0, count(*) FILTER (WHERE k % 41 = 0), count(*) FILTER (WHERE k % 23 = 0), 0, count(*) FILTER (WHERE k % 17 = 0 AND n > 1), count(*) FILTER (WHERE k % 29 = 0), 0,
count(*) FILTER (WHERE negative), count(*) FILTER (WHERE more), count(*) FILTER (WHERE partial)]) AS broken FROM g""")
def series_contract(spark, sf_dir):
    k, some = F.col("k"), lambda s: F.nullif(F.count_if(F.col("o_orderstatus") == s), F.lit(0))
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("year")).agg(some("F").alias("am"), some("O").alias("md"), some("P").alias("pm"))
    b = b.withColumn("am", F.when(k % 31 == 0, F.lit(-1)).otherwise(F.col("am")))
    whole = F.col("am").isNotNull() & F.col("md").isNotNull() & F.col("pm").isNotNull()
    survey = F.struct(
        "year", F.lit(5).alias("month"), F.when(k % 29 == 0, "x").otherwise(F.concat(F.lit("May "), F.col("year").cast("string"))).alias("label"), "am", "md", "pm",
        (F.coalesce("am", F.lit(0)) + F.coalesce("md", F.lit(0)) + F.coalesce("pm", F.lit(0))).alias("total"), (whole != (k % 37 == 0)).alias("complete"),
    )
    sites = b.groupBy("k").agg(F.array_sort(F.collect_list(survey)).alias("s"))
    first = F.transform("s", lambda x, i: x.withField("total", F.when((i == 0) & (k % 19 == 0), x["total"] + 1).otherwise(x["total"])))
    sites = sites.select("k", F.when(k % 41 != 0, F.lit(True)).alias("discrete"), (F.size("s") + F.when(k % 23 == 0, 1).otherwise(0)).alias("surveyCount"), F.when(k % 17 == 0, F.reverse(first)).otherwise(first).alias("surveys"))
    return validate.run_checks(sites, nested.series())


_CELLS = """o AS (SELECT o_custkey % 400 AS a, CASE o_orderstatus WHEN 'F' THEN 'vacant' WHEN 'O' THEN 'nonVacant' ELSE 'unknown' END AS status, o_orderkey % 3 AS flag, o_orderkey % 5 <> 0 AS m FROM orders),
c AS (SELECT a, CASE WHEN a % 10 = 5 AND status = 'vacant' THEN 'empty' ELSE status END AS status, flag, count(*) AS n, count(*) FILTER (WHERE m) + CASE WHEN a % 12 = 7 THEN count(*) ELSE 0 END AS mappable FROM o GROUP BY 1, 2, 3)"""


@query(f"""WITH {_CELLS}, g AS (SELECT a, bool_or(status = 'empty') AS strange, bool_or(mappable > n) AS over FROM c GROUP BY 1)
SELECT unnest(['id has its pattern', 'vintage is known', 'no vintage without an area', 'the boundary is that of the area', 'no place is made up for an unknown area', 'there are cells', 'every cell is there once', 'statuses are known', 'counts are whole and not negative',
'no more are mappable than there are', 'the total is that of the cells', 'mappable is that of the cells']) AS "check", 'error' AS severity, unnest([count(*) FILTER (WHERE a % 9 = 8), 0, count(*) FILTER (WHERE a % 14 = 0), count(*) FILTER (WHERE a % 7 <> 0 AND a % 8 = 1), 0, 0,
count(*) FILTER (WHERE a % 13 = 4), count(*) FILTER (WHERE strange), 0, count(*) FILTER (WHERE over), count(*) FILTER (WHERE a % 11 = 3 OR a % 13 = 4), count(*) FILTER (WHERE a % 13 = 4)]) AS broken FROM g""")
def area_contract(spark, sf_dir):
    a, one = F.col("a"), F.get("cells", F.lit(0))
    status = F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_custkey") % 400 % 10 == 5, "empty").otherwise("vacant")).when(F.col("o_orderstatus") == "O", "nonVacant").otherwise("unknown")
    flag = F.when(F.col("o_orderkey") % 3 == 0, True).when(F.col("o_orderkey") % 3 == 1, False)
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 400).alias("a"), status.alias("status"), flag.alias("flag"), (F.col("o_orderkey") % 5 != 0).alias("m"))
    c = o.groupBy("a", "status", "flag").agg(F.count("*").alias("n"), (F.count_if("m") + F.when(a % 12 == 7, F.count("*")).otherwise(0)).alias("mappable"))
    g = c.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("status", "flag", "n", "mappable"))).alias("cells"), F.sum("n").alias("n"), F.sum("mappable").alias("m"))
    known, vintage = a % 7 != 0, F.when(a % 2 == 0, "2010").otherwise("2020")
    areas = g.select(
        F.when(a % 9 == 8, "area").otherwise(F.concat(F.lit("area-"), a.cast("string"))).alias("id"), F.when(known, F.concat(F.lit("N"), a.cast("string"))).alias("nta"), F.when(known | (a % 14 == 0), vintage).alias("vintage"),
        F.when(known, F.concat(F.when(a % 8 == 1, "1990").otherwise(vintage), F.lit(":N"), a.cast("string"))).alias("boundaryId"), F.when(known, 40.7).alias("lat"), F.when(known, -74.0).alias("lon"),
        # a repeated cell counts in the array only
        (F.col("n") + F.when(a % 11 == 3, 1).otherwise(0)).alias("totalRecords"), F.col("m").alias("mappableRecords"), F.when(a % 13 == 4, F.array_append("cells", one.withField("n", one["mappable"] + 2).withField("mappable", one["mappable"] + 1))).otherwise(F.col("cells")).alias("counts"),
    )
    return validate.run_checks(areas, nested.area_cells("^area-[0-9]+$"))


def _counts(spark, sf_dir) -> DataFrame:
    """Readings of sensors and of their twins, which miss and change some."""
    k = F.col("l_orderkey")
    rep = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sensor_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), F.col("l_returnflag").alias("direction"), F.col("l_quantity").cast("long").alias("v"), k.alias("k"))
    twin = rep.where("k % 89 <> 0").select((F.col("sensor_id") + 1_000_000).alias("sensor_id"), "ts", "direction", (F.col("v") + F.when(F.col("k") % 97 == 0, 1).otherwise(0)).alias("v"))
    return rep.drop("k").unionByName(twin)


def _index(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("serial")).distinct()
    return s.select("serial", F.explode(F.array(F.struct(F.col("serial").alias("id"), F.lit(True).alias("r")), F.struct((F.col("serial") + 1_000_000).alias("id"), F.lit(False).alias("r")))).alias("x")).select("x.id", "serial", F.col("x.r").alias("is_representative"))


_LEGS = """r AS (SELECT l_suppkey AS serial, l_shipdate AS ts, l_returnflag AS direction, CAST(l_quantity AS BIGINT) AS v, l_orderkey AS k FROM lineitem),
rp AS (SELECT serial, ts, direction, CAST(sum(v) AS BIGINT) AS v, count(*) AS n FROM r GROUP BY ALL), tw AS (SELECT serial, ts, direction, CAST(sum(v + CASE WHEN k % 97 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS v, count(*) AS n FROM r WHERE k % 89 <> 0 GROUP BY ALL)"""


@query(f"""WITH {_LEGS}, j AS (SELECT serial, serial + 1000000 AS id, ts, direction, rp.v AS rep_value, tw.v AS twin_value, CASE WHEN tw.n IS NULL THEN 'missing' WHEN rp.n IS NULL THEN 'extra' WHEN rp.n > 1 OR tw.n > 1 THEN 'repeated' WHEN rp.v IS DISTINCT FROM tw.v THEN 'differs' END AS problem
FROM rp FULL JOIN tw USING (serial, ts, direction)) SELECT * FROM j WHERE problem IS NOT NULL""")
def twin_moments(spark, sf_dir):
    return sensors.twin_moments(_counts(spark, sf_dir), _index(spark, sf_dir))


@query(f"""WITH {_LEGS}, a AS (SELECT serial, ts, sum(rv) AS rep, sum(rv) + sum(tv) AS every FROM (SELECT serial, ts, v AS rv, 0 AS tv FROM rp UNION ALL SELECT serial, ts, 0, v FROM tw) GROUP BY 1, 2),
p AS (SELECT serial, max(ts) AS ts FROM r WHERE month(ts) <> 11 GROUP BY 1), c AS (SELECT serial, ts + CASE WHEN serial % 7 = 0 THEN INTERVAL 1 SECOND ELSE INTERVAL 0 SECOND END AS ts, CAST(rep + CASE WHEN serial % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS "count" FROM p JOIN a USING (serial, ts)),
f AS (SELECT c.*, CAST(rep AS BIGINT) AS rep, CAST(every AS BIGINT) AS every, timezone('UTC', timezone('America/New_York', c.ts)) AS observed_at FROM c LEFT JOIN a ON a.serial = c.serial AND a.ts = c.ts)
SELECT serial, observed_at, 'no rows' AS problem, "count", NULL::BIGINT AS found FROM f WHERE rep IS NULL UNION ALL SELECT serial, observed_at, 'count is not the representative''s', "count", rep FROM f WHERE rep <> "count" UNION ALL SELECT serial, observed_at, 'twins do not repeat it', "count", every FROM f WHERE every <> 2 * rep""")
def recomputed_moments(spark, sf_dir):
    """Claims at the newest moment outside of the month with a doubled hour; some are off by one, some by a second."""
    counts = _counts(spark, sf_dir)
    sums = counts.where("sensor_id < 1000000 and month(ts) <> 11").groupBy(F.col("sensor_id").alias("serial"), "ts").agg(F.sum("v").alias("v"))
    newest = sums.groupBy("serial").agg(F.max(F.struct("ts", "v")).alias("x"))
    s = F.col("serial")
    at = F.col("x.ts") + F.make_dt_interval(secs=F.when(s % 7 == 0, 1).otherwise(0).cast("decimal(18,6)"))
    published = newest.select("serial", parse.civil_to_utc(at).alias("observed_at"), (F.col("x.v") + F.when(s % 10 == 0, 1).otherwise(0)).alias("count"))
    got = sensors.recomputed_moments(published, counts, _index(spark, sf_dir))
    return got.withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))


_REPORT = ("low_quantity", "returned", "no_discount", "negative_price")


@query("""WITH c AS (SELECT count(*) AS r, count(*) FILTER (WHERE l_quantity < 3) AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS b, count(*) FILTER (WHERE l_discount = 0) AS d, count(*) FILTER (WHERE l_extendedprice < 0) AS e, max(l_orderkey) AS m FROM lineitem)
SELECT unnest(['rows', 'low_quantity', 'returned', 'no_discount', 'negative_price', 'last_order']) AS counter, unnest([r, a, b, d, e, NULL]) AS n, unnest([NULL, NULL, NULL, NULL, NULL, CAST(m AS VARCHAR)]) AS value FROM c""")
def run_report(spark, sf_dir):
    conditions = dict(zip(_REPORT, (F.col("l_quantity") < 3, F.col("l_returnflag") == "R", F.col("l_discount") == 0, F.col("l_extendedprice") < 0), strict=True))
    return publish.write_reported(table(spark, sf_dir, "lineitem"), f"{_folder(spark)}/rows", conditions, {"last_order": F.col("l_orderkey")})


@query("""WITH o AS (SELECT CAST(year(o_orderdate) AS VARCHAR) || CASE WHEN year(o_orderdate) % 3 = 0 THEN ' and ' || (year(o_orderdate) + 1) ELSE '' END AS cohort, o_orderstatus FROM orders),
p AS (SELECT cohort, 'areas' AS artifact, count(*) AS rows FROM o GROUP BY 1 UNION ALL SELECT cohort, 'vacant', count(*) FROM o WHERE o_orderstatus <> 'X' GROUP BY 1)
SELECT cohort, artifact, CASE WHEN cohort = '1996' THEN '' ELSE 'periods/' || replace(cohort, ' ', '-') || '/' END || artifact AS path, rows FROM p""")
def period_manifest(spark, sf_dir):
    y = F.year("o_orderdate")
    label = F.concat(y.cast("string"), F.when(y % 3 == 0, F.concat(F.lit(" and "), (y + 1).cast("string"))).otherwise(""))
    o = table(spark, sf_dir, "orders").select(label.alias("cohort"), "o_orderkey", "o_orderstatus")
    return publish.write_periods({"areas": o, "vacant": o}, _folder(spark), "cohort", "1996")


_LATEST = """l AS (SELECT o_custkey AS k, count(*) AS c, max(o_orderdate) AS at FROM orders GROUP BY 1)"""


@query(f"""WITH {_LATEST} SELECT unnest(['id has its pattern', 'name is there and not too long', 'activity is known', 'staleness is known', 'active is said', 'counts are not negative', 'the number of observations is there', 'an activity has an observation',
'an observation has an activity', 'percentile is from 0 to 100', 'numbers are finite', 'no ratio to nothing']) AS "check", 'error' AS severity, unnest([count(*) FILTER (WHERE k % 101 = 0), count(*) FILTER (WHERE k % 103 = 0), count(*) FILTER (WHERE k % 107 = 0), count(*) FILTER (WHERE k % 109 = 0),
count(*) FILTER (WHERE k % 113 = 0), count(*) FILTER (WHERE k % 127 = 0), count(*) FILTER (WHERE k % 131 = 0), count(*) FILTER (WHERE k % 137 = 0 AND (k % 139 <> 0 OR k % 107 = 0)), count(*) FILTER (WHERE k % 139 = 0 AND k % 137 <> 0 AND k % 107 <> 0), count(*) FILTER (WHERE k % 149 = 0), count(*) FILTER (WHERE k % 151 = 0),
count(*) FILTER (WHERE k % 157 = 0)]) AS broken FROM l""")
def latest_contract(spark, sf_dir):
    """One row a counter, as a loader takes it, each rule broken by the multiples of a prime."""
    k = F.col("o_custkey")
    broken = lambda p: k % p == 0
    got = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("c"), F.max("o_orderdate").alias("at"))
    rows = got.select(
        F.when(~broken(101), F.concat(F.lit("ctr-"), k.cast("string"))).alias("id"), F.when(broken(103), " ").otherwise("Bridge").alias("name"),
        F.when(broken(107), "crowded").when(broken(139), "unavailable").otherwise("typical").alias("activity"), F.when(broken(109), "old").otherwise("fresh").alias("staleness"), F.when(~broken(113), F.lit(True)).alias("active"),
        F.when(broken(127), -F.col("c")).otherwise(F.col("c")).alias("count"), F.when(broken(157), 0).otherwise(F.col("c")).alias("expected"), F.when(broken(149), 100.5).otherwise(50.0).alias("percentile"),
        F.when(broken(151), float("inf")).otherwise(1.0).alias("ratio"), F.when(~broken(131), F.col("c")).alias("observationCount"), F.when(~broken(137), F.col("at")).alias("observedAt"),
    )
    return validate.run_checks(rows, contracts.latest("^ctr-[0-9]+$"))


_SITES = """s AS (SELECT o_custkey AS k, CAST(count(*) FILTER (WHERE year(o_orderdate) = 1996) AS VARCHAR) AS a, CAST(count(*) FILTER (WHERE year(o_orderdate) = 1997) AS VARCHAR) AS b FROM orders GROUP BY 1)"""


@query(f"""WITH {_SITES}, x AS (SELECT 'column not consumed' AS problem, 'error' AS severity, 'may97am' AS name, 1 AS n UNION ALL SELECT 'column is gone', 'error', 'may_95_am', 1
UNION ALL SELECT 'no geometry', 'error', 'the_geom', count(*) FILTER (WHERE k % 40 = 0) FROM s UNION ALL SELECT 'not a count', 'error', 'may_96_am', count(*) FILTER (WHERE k % 50 = 3) FROM s UNION ALL SELECT 'not a count', 'error', 'may97am', count(*) FILTER (WHERE k % 60 = 7) FROM s
UNION ALL SELECT 'a group, not a borough', 'warning', 'River Bridges', count(*) FILTER (WHERE k % 6 = 2) FROM s UNION ALL SELECT 'not a borough', 'warning', CASE k % 6 WHEN 3 THEN 'Nowhere' ELSE '<empty>' END, count(*) FROM s WHERE k % 6 > 2 GROUP BY 3
UNION ALL SELECT 'unknown index value', 'error', 'Q', count(*) FILTER (WHERE k % 90 = 0) FROM s) SELECT * FROM x WHERE n > 0""")
def source_drift(spark, sf_dir):
    k, year = F.col("o_custkey"), lambda y: F.count_if(F.year("o_orderdate") == y).cast("string")
    wide = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(year(1996).alias("a"), year(1997).alias("b"))
    wide = wide.select(
        F.when(k % 40 != 0, F.lit("{}")).alias("the_geom"), F.when(k % 50 == 3, "x").when(k % 50 == 4, "N/A").otherwise(F.col("a")).alias("may_96_am"), F.when(k % 60 == 7, "-1").otherwise(F.col("b")).alias("may97am"),
        F.when(k % 6 == 0, "Bronx").when(k % 6 == 1, "Queens").when(k % 6 == 2, "River Bridges").when(k % 6 == 3, "Nowhere").when(k % 6 == 4, "").alias("borough"), F.when(k % 90 == 0, "Q").when(k % 2 == 0, "Y").otherwise("N").alias("iex"),
    )
    return contracts.source_drift(wide, ["may_96_am", "may_95_am"], r"may_?\d\d_?(am|md|pm)", ["Bronx", "Queens"], ["River Bridges"], ["Y", "N"])


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'falling' WHEN 'O' THEN 'rising' ELSE 'flat' END AS trend, count(*) + CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS claimed, count(*) AS observed FROM orders WHERE o_orderstatus <> 'O' GROUP BY o_orderstatus UNION ALL SELECT 'sideways', 4, 0")
def tallies_differ(spark, sf_dir):
    """A report's tallies, two of them off and one of a trend that no row has."""
    t = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(F.when(t == "F", "falling").when(t == "O", "rising").otherwise("flat").alias("trend"))
    off = F.when(F.col("trend") == "falling", 2).when(F.col("trend") == "flat", 1).otherwise(0)
    claimed = rows.groupBy("trend").agg(F.count("*").alias("n")).withColumn("n", F.col("n") + off)
    return contracts.tallies_differ(claimed.unionByName(spark.createDataFrame([("sideways", 4)], "trend string, n long")), rows, "trend")


def _folder(spark) -> str:
    return f"{graph.shared_folder(spark)}/published-{uuid.uuid4().hex}"
