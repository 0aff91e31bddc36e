"""Connected components, and the written tables that jobs of several passes are cut with."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Edges up to which a round of ``components`` runs in one task.
ONE_TASK = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Only a session on one machine (``local[..]``) may do without: it gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set; on a cluster it must name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def store(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once, written to the shared folder as Parquet and read again: plans stay short, sizes are real, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``; component is the smallest node reachable.

    Alternates two steps that rewrite the edges until nothing changes: every node links its larger neighbours to the smallest
    node around it, then its smaller ones. Paths shrink geometrically, so a chain of n nodes takes about log(n) rounds, and no step makes more edges than
    there are. Minima are taken with partial sums, so a hub with very many edges is one row a task. NULL ends and loops add nothing but their node.
    """
    both = store(edges.select("a", "b").where("a is not null and b is not null"))
    nodes = both.select(F.col("a").alias("node")).union(both.select("b")).distinct()
    now, mark = _marked(both.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    last = None
    while mark != last:
        if mark[0] <= ONE_TASK:  # counted: without shuffles, a round is one short task
            now = now.coalesce(1)
        around = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        small = large.join(low.hint("merge"), "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v")
        last = mark
        now, mark = _marked(small)
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("low")), "node", "left").select("node", F.coalesce("low", "node").alias("component"))


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct edges (u, v), and what tells two sets of them apart: their number, and sums of two hashes."""
    h, seen = F.xxhash64("u", "v"), Observation()
    kept = store(edges.distinct().observe(seen, F.count("*").alias("n"), F.sum(F.shiftright(h, 32)).alias("x"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("y")))
    return kept, tuple(seen.get[c] for c in "nxy")
