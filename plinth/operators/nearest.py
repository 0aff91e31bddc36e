"""Nearest-neighbour join on a plane: each left point with its nearest right point, without comparing all pairs.

Right places are put into a grid whose cells are halved until none holds more than ``MOST``; cells of one level make the larger cells of the level above. The search goes down
these levels for all left points at once. A left point starts with the one cell of everything; in each round its cells are replaced by their parts, and a part stays if the
box around its places is no further from the point than the furthest corner of the nearest box, since that corner bounds the distance to the nearest place. A few cells are left
to each point on every level, wherever it lies and however the places are spread, and only their places are measured in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.operators.graph import store

#: Different places of a cell, the most halvings made for it, and cells that may be broadcast.
MOST, HALVINGS, BROADCAST_CELLS = 8, 40, 100_000


def nearest(left: DataFrame, right: DataFrame, a: str, b: str, x: str = "x", y: str = "y") -> DataFrame:
    """(a, b, distance): for each key ``a`` of ``left`` the key ``b`` of the nearest row of ``right``, of equally near ones the smallest.

    Squares of distances are compared. Rows with a NULL coordinate take no part; right rows in one place are one, the smallest key; without any right row there is no row.
    """
    placed = F.col(x).isNotNull() & F.col(y).isNotNull()
    points = left.where(placed).select(a, F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
    places = store(right.where(placed).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.min(b).alias(b)))
    box = places.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
    whole = max((box.x1 or 0.0) - (box.x or 0.0), (box.y1 or 0.0) - (box.y or 0.0)) or 1.0

    def cell(c: str, low: float | None, level: int) -> Column:
        return F.least(F.floor((F.col(c) - (low or 0.0)) / whole * 2.0**level), F.lit(2**level - 1)).cast("long")

    depth = 0
    while depth < HALVINGS and (places.groupBy(cell("x", box.x, depth), cell("y", box.y, depth)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > MOST:
        depth += 1
    gridded = places.select(cell("x", box.x, depth).alias("cx"), cell("y", box.y, depth).alias("cy"), "x", "y", b)
    boxes = store(gridded.groupBy("cx", "cy").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))
    beyond = lambda p, low, high: F.greatest(low - p, F.lit(0.0), p - high)
    corner = lambda p, low, high: F.greatest(F.abs(p - low), F.abs(high - p))
    c = F.col
    least = beyond(c("px"), c("x0"), c("x1")) ** 2 + beyond(c("py"), c("y0"), c("y1")) ** 2
    most = corner(c("px"), c("x0"), c("x1")) ** 2 + corner(c("py"), c("y0"), c("y1")) ** 2
    mine = Window.partitionBy(a)
    # points stay where their key puts them, so levels whose cells are broadcast follow each other without an exchange
    held = points.repartition(a).select("*", F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"))
    for level in range(1, depth + 1):
        up = depth - level
        parts = boxes.groupBy(F.shiftright("cx", up).alias("nx"), F.shiftright("cy", up).alias("ny")).agg(*(f(k).alias(k) for f, k in ((F.min, "x0"), (F.max, "x1"), (F.min, "y0"), (F.max, "y1"))))
        parts = parts.select("*", F.shiftright("nx", 1).alias("cx"), F.shiftright("ny", 1).alias("cy"))
        small = 4**level <= BROADCAST_CELLS
        parts = F.broadcast(parts) if small else parts
        seen = held.join(parts, ["cx", "cy"]).select(a, "px", "py", "nx", "ny", least.alias("least"), most.alias("most"))
        seen = seen.withColumn("bound", F.min("most").over(mine)).where("least <= bound")
        held = seen.select(a, "px", "py", c("nx").alias("cx"), c("ny").alias("cy"))
        held = held if small else store(held)
    distance = (c("px") - c("x")) ** 2 + (c("py") - c("y")) ** 2
    best = held.join(gridded, ["cx", "cy"]).groupBy(a).agg(F.min(F.struct(distance.alias("d"), c(b))).alias("best"))
    return best.select(a, c(f"best.{b}").alias(b), F.sqrt("best.d").alias("distance"))
