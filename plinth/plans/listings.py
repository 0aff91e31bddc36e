"""Queries of ordered lists, labels, folding and nearest pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plinth.functions import geo, text
from plinth.operators import clusters, listing, nearest, publication, search
from plinth.plans.registry import query, table

_NAME = r"trim(regexp_replace(regexp_extract(text, '^\s*(\S+\s+\S+\s+\S+)', 1), '[^\p{L} ]', '', 'g'))"


@query(f"""WITH n AS (SELECT doc_id, {_NAME} AS name FROM documents), f AS (SELECT * FROM n WHERE name <> '')
SELECT CAST(row_number() OVER (ORDER BY name COLLATE en, doc_id) AS INTEGER) AS place, doc_id, name FROM f QUALIFY place <= 50""")
def names_in_order(spark, sf_dir):
    """The first 50 names in the order of names; their places are part of the result, so the order is compared."""
    name = F.trim(F.regexp_replace(F.regexp_extract("text", r"^\s*(\S+\s+\S+\s+\S+)", 1), r"[^\p{L} ]", ""))
    docs = table(spark, sf_dir, "documents").select("doc_id", name.alias("name")).where("name <> ''")
    first = listing.rows(docs, listing.Query(sort="name"), "doc_id", {"name": [text.in_name_order(F.col("name"))]})
    # fifty rows, numbered in one window
    return first.select(F.row_number().over(Window.orderBy(text.in_name_order(F.col("name")), "doc_id")).alias("place"), "doc_id", "name")


# sixteenths are exact, so that the tenths can be told in whole numbers
@query("""WITH m AS (SELECT c_custkey, c_custkey / 16.0::DOUBLE AS miles FROM customer), t AS (SELECT c_custkey, miles, (10 * c_custkey + 8) // 16 AS tenths FROM m)
SELECT c_custkey, CASE WHEN miles < 0.1 THEN CAST(CAST(floor(miles * 5280 / 10 + 0.5) * 10 AS BIGINT) AS VARCHAR) || ' ft' ELSE (tenths // 10) || '.' || (tenths % 10) || ' mi' END AS distance FROM t""")
def distance_labels(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", geo.distance_text(F.col("c_custkey") / 16.0).alias("distance"))


_SYLLABLE = "chr(CAST(44032 + c_custkey * 3 % 90 AS INTEGER))"


@query(f"""SELECT c_custkey, {_SYLLABLE} || ' ' || c_name AS name, 300 AS score FROM customer WHERE c_custkey * 3 % 90 BETWEEN 56 AND 83 ORDER BY name, c_custkey LIMIT 50""")
def search_syllables(spark, sf_dir):
    """A syllable without a final letter finds those that end in any, up to the 50 of a search."""
    syllable = F.decode(F.unhex(F.lpad(F.hex(F.col("c_custkey") * 3 % 90 + 0xAC00), 4, "0")), "UTF-16BE")
    named = table(spark, sf_dir, "customer").select("c_custkey", F.concat(syllable, F.lit(" "), "c_name").alias("name"))
    return search.search(named, "갸", ["name"], "name", "c_custkey").select("c_custkey", "name", "score")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995 AND o_orderstatus = 'F'")
def vacant_points(spark, sf_dir):
    """Points of both states: only vacant ones are published."""
    status = F.when(F.col("o_orderstatus") == "F", "vacant").when(F.col("o_orderstatus") == "O", "nonVacant").otherwise("unknown")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("cohort"), status.alias("status"), F.lit(None).cast("boolean").alias("construction"), F.lit("Queens").alias("borough"))
    return publication.reports(rows, "1995", "both").select("o_orderkey")


_XY = "({k} * 7919 % 40009) / 100.0::DOUBLE AS x, ({k} * 104729 % 55001) / 100.0::DOUBLE AS y"


@query(f"""WITH l AS (SELECT o_orderkey, {_XY.format(k='o_orderkey')} FROM orders), r AS (SELECT s_suppkey, {_XY.format(k='(s_suppkey * 31)')} FROM supplier)
SELECT o_orderkey, arg_min(s_suppkey, struct_pack(d := (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y), k := s_suppkey)) AS s_suppkey, round(sqrt(min((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y))), 6) AS distance FROM l, r GROUP BY 1""")
def nearest_pairs(spark, sf_dir):
    at = lambda k: ((k * 7919 % 40009 / 100.0).alias("x"), (k * 104729 % 55001 / 100.0).alias("y"))
    left = table(spark, sf_dir, "orders").select("o_orderkey", *at(F.col("o_orderkey")))
    right = table(spark, sf_dir, "supplier").select("s_suppkey", *at(F.col("s_suppkey") * 31))
    return nearest.nearest(left, right, "o_orderkey", "s_suppkey").select("o_orderkey", "s_suppkey", F.round("distance", 6).alias("distance"))


@query()
def cluster_tree(spark, sf_dir):
    """Every cluster at every zoom with the label of its count; SQL has no greedy order, a version one after the other is the test."""
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select("c_custkey", (40.5 + k * 7919 % 4000 / 10000.0).alias("lat"), (-74.25 + k * 104729 % 5500 / 10000.0).alias("lon"))
    return clusters.cluster_tree(points, "c_custkey").select("zoom", "cluster", "parent", "point_count", geo.abbreviated(F.col("point_count")).alias("label"), "lat", "lon")
