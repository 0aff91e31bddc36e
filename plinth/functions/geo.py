"""Points, boxes, distances and map grids as Columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_MILES = 3958.7613
TILE = 512

# Bounding box of published points (lat from, lat to, lon from, lon to).
CITY_BOX = (40.40, 41.00, -74.30, -73.65)

# Coarse rectangles by name, first match wins (lat from, lat to, lon from, lon to).
BOROUGH_BOXES = (
    ("Bronx", 40.795, 40.930, -73.925, -73.700),
    ("Manhattan", 40.700, 40.895, -74.020, -73.905),
    ("Staten Island", 40.490, 40.660, -74.300, -74.035),
    ("Brooklyn", 40.545, 40.795, -74.045, -73.855),
    ("Queens", 40.540, 40.800, -73.960, -73.700),
)


def in_box(lat: Column, lon: Column, box: Sequence[float] | None = CITY_BOX) -> Column:
    """Inside or on the edge; no box lets everything through, a point that is not finite is never inside."""
    if box is None:
        return F.lit(True)
    return F.coalesce(lat.between(box[0], box[1]) & lon.between(box[2], box[3]), F.lit(False))


def box_filter(lat: Column, lon: Column, box: Sequence[float]) -> Column:
    """The same as a filter: bare ranges, which reach the scan (a filter drops NULL as it drops false)."""
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def first_box(lat: Column, lon: Column, boxes: Sequence[tuple] = BOROUGH_BOXES) -> Column:
    out = F.lit(None).cast("string")
    for name, *box in reversed(boxes):
        out = F.when(in_box(lat, lon, box), name).otherwise(out)
    return out


def edge_degrees(lat: Column, lon: Column, boxes: Sequence[tuple] = BOROUGH_BOXES) -> Column:
    """Degrees to the nearest edge of the first box that holds the point."""
    out = F.lit(None).cast("double")
    for _, a, b, c, d in reversed(boxes):
        out = F.when(in_box(lat, lon, (a, b, c, d)), F.least(lat - a, F.lit(b) - lat, lon - c, F.lit(d) - lon)).otherwise(out)
    return out


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def distance_text(miles: Column) -> Column:
    """Feet in tens under a tenth of a mile, else miles; NULL for NULL or negative."""
    feet = (F.floor(miles * 5280 / 10 + 0.5) * 10).cast("long")
    return F.when(miles.isNull() | (miles < 0), None).when(miles < 0.1, F.concat(feet.cast("string"), F.lit(" ft"))).otherwise(F.concat(_one_place(miles), F.lit(" mi")))


def _one_place(v: Column) -> Column:
    """The tenth that is nearest to the exact binary value (1.45 is a little less, so ``1.4``), an exact half goes up; for 0 <= v < 2^30."""
    tenths = F.floor(v * 10).cast("long")
    # 20 v against the half 2 tenths + 1, without an error: both parts of v have few bits
    high = F.floor(v * 1048576) / 1048576
    tenths = F.when((20 * high - (2 * tenths + 1)) + 20 * (v - high) >= 0, tenths + 1).otherwise(tenths)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Normalised Web-Mercator x and y in [0, 1]."""
    rad = F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat)))
    return (lon + 180) / 360, (1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2


def fit_zoom(west: float, south: float, east: float, north: float, width: float, height: float, padding: float = 0) -> float:
    """The zoom at which a box fits a viewport."""

    def y(lat: float) -> float:
        rad = math.radians(max(-85.05112878, min(85.05112878, lat)))
        return (1 - math.log(math.tan(rad) + 1 / math.cos(rad)) / math.pi) / 2

    w, h = max(1, width - 2 * padding), max(1, height - 2 * padding)
    return min(math.log2(360 * w / (TILE * max(1e-9, east - west))), math.log2(h / (TILE * max(1e-12, abs(y(south) - y(north))))))


def clusters(points: DataFrame, zoom: int, radius: int = 50, max_zoom: int = 14, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(cell_x, cell_y, point_count, lat, lon): points by Mercator grid cells of ``radius`` pixels; beyond ``max_zoom`` cells are as at it."""
    cells = TILE * 2 ** min(zoom, max_zoom) / radius
    x, y = mercator(F.col(lat), F.col(lon))
    return points.groupBy(F.floor(x * cells).cast("long").alias("cell_x"), F.floor(y * cells).cast("long").alias("cell_y")).agg(F.count("*").alias("point_count"), F.avg(lat).alias("lat"), F.avg(lon).alias("lon"))


def abbreviated(n: Column) -> Column:
    """1234 as ``1.2k``: to the nearest tenth of a thousand below 10,000 (no ``.0``), to the nearest thousand above; halves go up."""
    tenths = F.floor((n + 50) / 100).cast("long")
    part = F.when(tenths % 10 != 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise("")
    return F.when(n < 1000, n.cast("string")).when(n < 10000, F.concat(F.floor(tenths / 10).cast("string"), part, F.lit("k"))).otherwise(F.concat(F.floor((n + 500) / 1000).cast("string"), F.lit("k")))


def stepped(value: Column, steps: Sequence[tuple[float | None, int]]) -> Column:
    """The size of the first step whose inclusive upper bound holds the value; the first for NULL, the last for the rest."""
    out = F.lit(steps[-1][1])
    for bound, size in reversed(steps[:-1]):
        out = F.when(value <= bound, size).otherwise(out)
    return F.when(value.isNull(), steps[0][1]).otherwise(out)


def extent(df: DataFrame, lat: str = "lat", lon: str = "lon", degenerate: bool = False) -> DataFrame:
    """One row (west, south, east, north, n); NULL edges when the box has no area, unless ``degenerate`` boxes are wanted."""
    box = df.agg(F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north"), F.count("*").alias("n"))
    if degenerate:
        return box
    ok = (F.col("east") > F.col("west")) & (F.col("north") > F.col("south"))
    return box.select(*(F.when(ok, F.col(c)).alias(c) for c in ("west", "south", "east", "north")), "n")


def polygon_positions(coords: Column) -> Column:
    """All positions of a MultiPolygon's nested arrays, as one array."""
    return F.flatten(F.flatten(coords))


def rounded_positions(coords: Column, places: int = 6) -> Column:
    return F.transform(coords, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, lambda xy: F.transform(xy, lambda v: F.round(v, places)))))


def clamped_view(lat: Column, lon: Column, zoom: Column, lowest: float = 0, highest: float = 22) -> tuple[Column, Column, Column]:
    """A view inside the world, to five decimals and a hundredth of a zoom."""
    clip = lambda c, a, b: F.greatest(F.lit(a), F.least(F.lit(b), c))
    return F.round(clip(lat, -90.0, 90.0), 5), F.round(clip(lon, -180.0, 180.0), 5), F.round(clip(zoom, float(lowest), float(highest)), 2)


def centre_of(positions: Column) -> tuple[Column, Column]:
    """(lat, lon) of the middle of the box around an array of [lon, lat] positions, to six decimals."""
    lon, lat = F.transform(positions, lambda p: F.get(p, F.lit(0))), F.transform(positions, lambda p: F.get(p, F.lit(1)))
    return F.round((F.array_min(lat) + F.array_max(lat)) / 2, 6), F.round((F.array_min(lon) + F.array_max(lon)) / 2, 6)
