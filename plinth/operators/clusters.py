"""Point clusters of a map, zoom by zoom: greedy circles on the Mercator plane, each zoom made of the clusters of the zoom below it.

In the order of a hash of their keys, every node that is still free becomes a centre and takes the free nodes within the radius; a cluster lies at the mean of its points.
That order of one after the other has the same outcome as rounds: a free node is a centre as soon as no free node within the radius comes before it, and a node belongs to the first centre within the radius.
Cells are so small that two nodes of a cell are always within the radius, so a cell has one candidate a round, and a node meets at most the candidates of the
5 x 5 cells around it: rows grow with the nodes, never with pairs, however dense a place is. As few nodes as ``ONE_TASK`` (counted) go through their remaining zooms in one task.

Places are whole numbers (2^32 across the world) and so are means, rounded down: results don't depend on the order of rows or of sums.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.geo import TILE, mercator
from plinth.operators.graph import store

#: Units across the world, nodes that are clustered in one task, and the most points whose sums of places are whole.
WORLD, ONE_TASK = 1 << 32, 20_000
_NODE = "zoom int, cluster long, parent long, point_count long, x long, y long"


def radius_at(zoom: int, pixels: int) -> int:
    return WORLD * pixels // (TILE << zoom)


def cluster_tree(points: DataFrame, key: str, max_zoom: int = 14, pixels: int = 50, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(zoom, cluster, parent, point_count, x, y, lat, lon) of every cluster at every zoom from ``max_zoom`` to 0, single points among them.

    A cluster goes by the smallest key in it; ``parent`` is its cluster at the zoom before (NULL at 0). Points in one place are one node. Rows with a NULL key or coordinate take no part.
    """
    mx, my = mercator(F.col(lat), F.col(lon))
    whole = lambda c: F.least(F.greatest(F.floor(c * WORLD), F.lit(0)), F.lit(WORLD - 1)).cast("long")
    placed = points.where(F.col(key).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull())
    nodes = store(placed.select(F.col(key).cast("long").alias("key"), whole(mx).alias("x"), whole(my).alias("y")).groupBy("x", "y").agg(F.min("key").alias("key"), F.count("*").alias("n")))
    nodes, out = nodes.select("key", "n", "x", "y"), None
    zoom, known = max_zoom, None
    while zoom >= 0 and nodes.count() > ONE_TASK:
        parents = _parents(nodes, radius_at(zoom, pixels))
        if known is not None:
            out = _with(out, known.join(parents, "key"), zoom + 1)
        nodes = store(_merged(nodes.join(parents, "key")))
        known, zoom = nodes, zoom - 1
    if zoom >= 0:
        first, cols = zoom, [F.lit(0).alias("g"), "key", "n", "x", "y", F.xxhash64("key").alias("rank")]
        rest = nodes.select(*cols).groupBy("g").applyInArrow(lambda t: _all_zooms(t, first, pixels), _NODE)
        if known is not None:
            # what the first zoom of the task made of the nodes that came to it
            rest = store(rest)
            up = rest.where(F.col("zoom") == first + 1).select(F.col("cluster").alias("key"), "parent")
            out = _with(out, known.join(up, "key"), first + 1)
        rest = rest.where(F.col("zoom") <= first)
        out = rest if out is None else out.unionByName(rest)
    elif known is not None:
        out = _with(out, known.withColumn("parent", F.lit(None).cast("long")), 0)
    back = F.degrees(2 * F.atan(F.exp((1 - 2 * (F.col("y") + 0.5) / WORLD) * math.pi)) - math.pi / 2)
    return out.select("zoom", "cluster", "parent", "point_count", "x", "y", F.round(back, 6).alias("lat"), F.round((F.col("x") + 0.5) / WORLD * 360 - 180, 6).alias("lon"))


def _with(out: DataFrame | None, level: DataFrame, zoom: int) -> DataFrame:
    rows = level.select(F.lit(zoom).alias("zoom"), F.col("key").alias("cluster"), "parent", F.col("n").alias("point_count"), "x", "y")
    return rows if out is None else out.unionByName(rows)


def _merged(members: DataFrame) -> DataFrame:
    """The clusters (key, n, x, y) of nodes with their ``parent``."""
    mean = lambda c: F.expr(f"sum(n * {c}) div sum(n)").alias(c)
    return members.groupBy("parent").agg(F.min("key").alias("low"), F.sum("n").alias("n"), mean("x"), mean("y")).select(F.col("low").alias("key"), "n", "x", "y")


def _parents(nodes: DataFrame, radius: int) -> DataFrame:
    """(key, parent) of every node: the smallest key of the cluster that takes it."""
    side = max(1, math.isqrt(radius * radius // 2))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3))))
    at = [F.floor(F.col(c) / side).cast("long").alias(f"c{c}") for c in "xy"]
    free = nodes.select("key", F.struct(F.xxhash64("key").alias("rank"), F.col("key")).alias("turn"), "x", "y", *at)
    every = free
    near = (F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2 <= float(radius) ** 2
    reach = lambda df: df.select("key", "turn", "x", "y", "cx", "cy", around.alias("d")).select("key", "turn", "x", "y", (F.col("cx") + F.col("d.i")).alias("gx"), (F.col("cy") + F.col("d.j")).alias("gy"))
    centres = None
    while True:
        lead = store(free.groupBy("cx", "cy").agg(F.min(F.struct("turn", "x", "y")).alias("c")).select(F.col("cx").alias("gx"), F.col("cy").alias("gy"), F.col("c.turn").alias("other"), F.col("c.x").alias("ox"), F.col("c.y").alias("oy")))
        met = reach(free).join(lead, ["gx", "gy"]).where(near)
        beaten = met.where(F.col("turn") < F.col("other")).select("other").distinct()
        new = store(lead.join(beaten, "other", "left_anti"))
        taken = reach(free).join(new, ["gx", "gy"]).where(near).select("key").distinct()
        centres = new if centres is None else centres.unionByName(new)
        free = store(free.join(taken, "key", "left_anti"))
        if not free.limit(1).count():
            break
    first = reach(every).join(store(centres), ["gx", "gy"]).where(near).groupBy("key").agg(F.min("other").alias("centre"))
    members = store(first.select("key", F.col("centre.key").alias("centre")))
    return members.join(members.groupBy("centre").agg(F.min("key").alias("parent")), "centre").select("key", "parent")


def _all_zooms(t: pa.Table, zoom: int, pixels: int) -> pa.Table:
    """The clusters of a bounded number of nodes at all zooms from ``zoom`` down, and at ``zoom + 1`` the nodes themselves with their parents."""
    key, n, x, y, rank = (t.column(c).to_numpy() for c in ("key", "n", "x", "y", "rank"))
    ranks = dict(zip(key.tolist(), rank.tolist(), strict=True))
    rows = []
    for z in range(zoom, -1, -1):
        r = radius_at(z, pixels)
        turn = [(ranks[k], k) for k in key.tolist()]
        order = sorted(range(len(key)), key=turn.__getitem__)
        side = max(1, r)
        cells: dict[tuple[int, int], list[int]] = {}
        for i in order:
            cells.setdefault((int(x[i]) // side, int(y[i]) // side), []).append(i)
        owner = np.full(len(key), -1)
        for i in order:
            if owner[i] >= 0:
                continue
            cx, cy = int(x[i]) // side, int(y[i]) // side
            for p in range(cx - 1, cx + 2):
                for q in range(cy - 1, cy + 2):
                    if (p, q) in cells:
                        some = np.array(cells[p, q])
                        close = some[(x[some] - x[i]).astype(float) ** 2 + (y[some] - y[i]).astype(float) ** 2 <= float(r) ** 2]
                        owner[close[owner[close] < 0]] = i
                        # those that are taken leave the cell
                        left = some[owner[some] < 0]
                        if len(left):
                            cells[p, q] = left.tolist()
                        else:
                            del cells[p, q]
        _, group = np.unique(owner, return_inverse=True)
        low = np.full(group.max(initial=-1) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, group, key)
        rows.append((z + 1, key, low[group], n, x, y))
        total, sx, sy = (np.zeros(len(low), object) for _ in range(3))
        for g, m, a, b in zip(group.tolist(), n.tolist(), x.tolist(), y.tolist(), strict=True):
            total[g] += m
            sx[g] += m * a
            sy[g] += m * b
        key, n, x, y = low, total.astype(np.int64), (sx // total).astype(np.int64) if len(low) else x, (sy // total).astype(np.int64) if len(low) else y
    rows.append((0, key, None, n, x, y))
    parts = []
    for z, k, parent, m, a, b in rows:
        up = pa.nulls(len(k), pa.int64()) if parent is None else pa.array(parent, pa.int64())
        parts.append(pa.table({"zoom": pa.array(np.full(len(k), z), pa.int32()), "cluster": pa.array(k, pa.int64()), "parent": up, "point_count": pa.array(m, pa.int64()), "x": pa.array(a, pa.int64()), "y": pa.array(b, pa.int64())}))
    return pa.concat_tables(parts)
