"""Who is who: merging, de-duplicating and numbering records, independent of row order."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.operators import graph


def filled(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c).cast("string") != "")


def pick(value: str, order: Column) -> Column:
    """Aggregate: the first value in order that is neither NULL nor empty."""
    return F.min_by(F.when(filled(value), F.col(value)), F.when(filled(value), order))


def merge_groups(df: DataFrame, keys: Sequence[str], kind: str, singles: dict[str, str], pair_label: str, order: Column, picks: Sequence[str] = (), source_id: str | None = None) -> DataFrame:
    """One row a key: the set of ``kind`` gives the label (both, a single one, or NULL for an ambiguous group), each pick its first filled value.

    ``anomalies`` lists group_of_3_plus, repeated_kind and ``<pick>_disagreement`` (a member without the value disagrees with one that has it); all of it is one hash aggregate with map-side partial sums.
    """
    aggs = [F.count("*").alias("members"), F.sort_array(F.collect_set(F.coalesce(F.col(kind), F.lit("<null>")))).alias("kinds")]
    aggs += [pick(p, order).alias(p) for p in picks] + [F.count_distinct(F.when(filled(p), F.col(p).cast("string")).otherwise("")).alias(f"_{p}") for p in picks]
    if source_id:
        aggs.append(F.array_sort(F.collect_list(source_id)).alias("source_ids"))
    got = df.groupBy(*keys).agg(*aggs)
    label = F.when(F.col("kinds") == F.array(*(F.lit(k) for k in sorted(singles))), pair_label)
    for k, v in singles.items():
        label = label.when(F.col("kinds") == F.array(F.lit(k)), v)
    flags = [F.when(F.col("members") > 2, "group_of_3_plus"), F.when(F.col("members") > F.size("kinds"), "repeated_kind"), *(F.when(F.col(f"_{p}") > 1, f"{p}_disagreement") for p in picks)]
    return got.withColumn("label", label).withColumn("anomalies", F.array_compact(F.array(*flags))).drop(*(f"_{p}" for p in picks))


def ambiguous_groups(df: DataFrame, keys: Sequence[str], kind: str, known: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(clear, rejected): a group whose kinds are neither all the known ones nor a single known one has no label, so its rows are rejected, in the order of the report (code, then keys)."""
    seen = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_distinct(F.coalesce(kind, F.lit("<null>"))).alias("_kinds"), F.count_if(F.coalesce(F.col(kind).isin(*known), F.lit(False))).alias("_known"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"x.{k}").eqNullSafe(F.col(f"g.{k}"))
    both = df.alias("x").join(seen.alias("g"), same).select("x.*", "_n", "_kinds", "_known")
    clear = (F.col("_known") == F.col("_n")) & F.col("_kinds").isin(1, len(known))
    rejected = both.where(~clear).withColumn("code", F.lit("ambiguous_group")).withColumn("detail", F.concat(F.lit("group of "), F.col("_n").cast("string")))
    return both.where(clear).select(*df.columns), rejected.select(*df.columns, "code", "detail").orderBy("code", *keys)


def point_of_first(df: DataFrame, keys: Sequence[str], order: Column, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(keys, lat, lon): both coordinates of the one row that comes first among those that have both."""
    whole = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    return df.groupBy(*keys).agg(F.min_by(F.when(whole, F.struct(lat, lon)), F.when(whole, order)).alias("_p")).select(*keys, f"_p.{lat}", f"_p.{lon}")


def first_by_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def union_dedup(previous: DataFrame, new: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Rows of both, one for each key; ``previous`` wins, then ``order``."""
    both = previous.withColumn("_from", F.lit(0)).unionByName(new.withColumn("_from", F.lit(1)))
    return first_by_key(both, keys, F.col("_from"), *order).drop("_from")


def numbered(df: DataFrame, digest: Column, *order: Column) -> DataFrame:
    """``digest`` and ``occurrence`` (from 1) of each row among equal ones: identical reports stay separate.

    Rows are sorted by ranges of ``order`` and numbered inside (digest, range); a range starts where the ones before it end, so a digest that very many rows
    share is as many tasks as ranges. The sorted rows are written once, as ranges are drawn from a sample.
    """
    spark = df.sparkSession
    ranged = df.withColumn("digest", digest).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    rows = graph.store(ranged.withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("digest").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("digest", "_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = rows.withColumn("_k", F.row_number().over(Window.partitionBy("digest", "_part").orderBy(*order)))
    return inside.join(starts, ["digest", "_part"]).withColumn("occurrence", (F.col("_start") + F.col("_k")).cast("long")).select(*df.columns, "digest", "occurrence")


def union_report(previous: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row (previous, fetched, merged, duplicates) of a union on keys: rows of either side beyond the first of their key are duplicates."""
    both = previous.select(*keys, F.lit(0).alias("_new")).unionByName(new.select(*keys, F.lit(1).alias("_new")))
    each = both.groupBy(*keys).agg(F.count_if(F.col("_new") == 0).alias("p"), F.count_if(F.col("_new") == 1).alias("n"))
    got = each.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("previous"), F.coalesce(F.sum("n"), F.lit(0)).alias("fetched"), F.count("*").alias("merged"))
    return got.withColumn("duplicates", F.col("previous") + F.col("fetched") - F.col("merged"))


def occurrence_report(rows: DataFrame, record: Column) -> DataFrame:
    """One row (digests, repeats, collisions) of numbered rows: repeats are rows kept beyond the first of their digest, a collision is a digest that stands for different records."""
    each = rows.groupBy("digest").agg(F.count("*").alias("n"), (F.min(record) != F.max(record)).alias("differs"))
    return each.agg(F.count("*").alias("digests"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats"), F.count_if("differs").alias("collisions"))


def without_collisions(rows: DataFrame, record: Column) -> DataFrame:
    """``rows``, refused if a digest stands for different records: their ids would be the same."""
    if n := occurrence_report(rows, record).first().collisions:
        raise ValueError(f"{n} digests stand for different records")
    return rows


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, refused with some of the keys if any occurs more than once."""
    if found := duplicate_keys(df, keys).limit(5).collect():
        raise ValueError(f"{', '.join(keys)} not unique: " + "; ".join(", ".join(str(r[k]) for k in keys) for r in found))
    return df


def twin_groups(df: DataFrame, member: str, measures: Sequence[str]) -> DataFrame:
    """(measures, first, member): members whose measures are all equal, a row each, under the smallest; nothing is gathered, so a group may be of any size."""
    groups = df.groupBy(*measures).agg(F.min(member).alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    same = F.lit(True)
    for m in measures:
        same &= F.col(f"x.{m}").eqNullSafe(F.col(f"g.{m}"))
    return df.alias("x").join(groups.alias("g"), same).select(*(F.col(f"x.{m}") for m in measures), F.col("g.first"), F.col(f"x.{member}").alias("member"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; must be empty for a unique key."""
    return df.groupBy(*keys).count().where("count > 1")


def band_edges(df: DataFrame, node: str, values: Sequence[str], width: float) -> DataFrame:
    """(a, b): nodes with every value within ``width``; an equi-join on grid cells of that width, not a nested loop."""
    rows = df.select(F.col(node).alias("n"), *(F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)))
    cells = [F.floor(F.col(f"v{i}") / width).cast("long") for i in range(len(values))]
    left = rows
    for i, c in enumerate(cells):
        left = left.withColumn(f"c{i}", F.explode(F.array(c - 1, c, c + 1)))
    left = left.select(F.col("n").alias("a"), *(F.col(f"v{i}").alias(f"a{i}") for i in range(len(values))), *(f"c{i}" for i in range(len(values))))
    right = rows.select(F.col("n").alias("b"), *(F.col(f"v{i}").alias(f"b{i}") for i in range(len(values))), *(c.alias(f"c{i}") for i, c in enumerate(cells)))
    near = [F.abs(F.col(f"a{i}") - F.col(f"b{i}")) <= width for i in range(len(values))]
    cond = F.col("a") < F.col("b")
    for n in near:
        cond &= n
    return left.join(right, [f"c{i}" for i in range(len(values))]).where(cond).select("a", "b").distinct()


def shared_edges(df: DataFrame, node: str, items: str) -> DataFrame:
    """(a, b): each node with the smallest node that shares an item; enough for components, and as many rows as items."""
    x = df.select(F.col(node).alias("b"), F.explode(items).alias("item"))
    first = x.groupBy("item").agg(F.min("b").alias("a"))
    return x.join(first, "item").where("a <> b").select("a", "b").distinct()


def band_links(df: DataFrame, node: str, values: Sequence[str], width: float) -> DataFrame:
    """(a, b): few of the edges of ``band_edges``, with the same components: about one a node, however dense a place is. For one or two values.

    Nodes of one cell of that width are all within it, so they hang on the smallest of them. Two cells side by side are linked if the nodes of each that lie nearest to the other are: they agree within the width in the other
    value. Two cells that meet at a corner need a node of each that is near enough in both values: along the first one, a node looks at the least second value of the nodes that it reaches there.
    """
    cols = ["x", "y"][: len(values)]
    if len(cols) != len(values):
        raise ValueError("one or two values")
    rows = df.where(F.col(node).isNotNull()).select(F.col(node).alias("n"), *(F.col(v).cast("double").alias(c) for v, c in zip(values, cols, strict=True))).na.drop()
    if len(cols) == 1:
        rows = rows.withColumn("y", F.lit(0.0))
    rows = graph.store(rows.select("n", "x", "y", F.floor(F.col("x") / width).cast("long").alias("cx"), F.floor(F.col("y") / width).cast("long").alias("cy")))
    # of equal values the smallest node stands for all
    ends = [f(F.struct(v, "n")).alias(f"{name}{v}") for v in ("x", "y") for f, name in ((F.min, "least_"), (F.max, "most_"))]
    cells = graph.store(rows.groupBy("cx", "cy").agg(F.min("n").alias("first"), *ends))
    out = rows.join(cells.select("cx", "cy", "first"), ["cx", "cy"]).where("n <> first").select(F.col("first").alias("a"), F.col("n").alias("b"))
    for dx, dy, v in ((1, 0, "x"), (0, 1, "y")):
        after = cells.select((F.col("cx") - dx).alias("cx"), (F.col("cy") - dy).alias("cy"), F.col(f"least_{v}").alias("q"))
        met = cells.select("cx", "cy", F.col(f"most_{v}").alias("p")).join(after, ["cx", "cy"]).where(F.col(f"q.{v}") - F.col(f"p.{v}") <= width)
        out = out.unionByName(met.select(F.least("p.n", "q.n").alias("a"), F.greatest("p.n", "q.n").alias("b")))
    for up in (1, -1):
        corner = cells.select("cx", "cy").join(cells.select((F.col("cx") - 1).alias("cx"), (F.col("cy") - up).alias("cy")), ["cx", "cy"])
        low = rows.join(corner, ["cx", "cy"]).select("cx", "cy", (F.col("x") + width).alias("at"), (F.col("y") * up).alias("y"), "n", F.lit(1).alias("side"))
        high = rows.select((F.col("cx") - 1).alias("cx"), (F.col("cy") - up).alias("cy"), F.col("x").alias("at"), (F.col("y") * up).alias("y"), "n", F.lit(0).alias("side")).join(corner, ["cx", "cy"])
        reached = Window.partitionBy("cx", "cy").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
        seen = low.unionByName(high.select(*low.columns)).withColumn("q", F.min(F.when(F.col("side") == 0, F.struct("y", "n"))).over(reached))
        met = seen.where((F.col("side") == 1) & (F.col("q.y") - F.col("y") <= width)).groupBy("cx", "cy").agg(F.min(F.struct(F.least("n", "q.n").alias("a"), F.greatest("n", "q.n").alias("b"))).alias("e"))
        out = out.unionByName(met.select("e.a", "e.b"))
    return out


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, component) of every node: the smallest node reachable over ``edges(a, b)``, itself where it has none. A counted small graph is joined up in one task."""
    ids, kept = nodes.select(F.col(node).alias("node")).distinct(), graph.store(edges.select("a", "b").where("a is not null and b is not null"))
    if kept.count() <= graph.ONE_TASK:
        kind = kept.schema["a"].dataType.simpleString()
        found = kept.groupBy(F.lit(0).alias("_all")).applyInArrow(_joined_up, f"node {kind}, component {kind}")
    else:
        found = graph.components(kept)
    return ids.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _joined_up(edges: pa.Table) -> pa.Table:
    """(node, component) of a bounded number of edges: each set of nodes hangs on its smallest."""
    up: dict = {}

    def root(n):
        while up.setdefault(n, n) != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in zip(edges.column("a").to_pylist(), edges.column("b").to_pylist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    kind = edges.schema.field("a").type
    return pa.table({"node": pa.array(list(up), kind), "component": pa.array([root(n) for n in list(up)], kind)})
