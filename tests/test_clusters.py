"""Clusters in rounds against one after the other."""

import math
import random

import pytest
import xxhash

from plinth.operators import clusters


def turn(key):
    h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
    return h - ((h >> 63) << 64), key


def one_by_one(points, max_zoom, pixels):
    places = {}
    for k, lat, lon in points:
        if k is not None and lat is not None and lon is not None:
            rad = math.radians(max(-85.05112878, min(85.05112878, lat)))
            x, y = (lon + 180) / 360, (1 - math.log(math.tan(rad) + 1 / math.cos(rad)) / math.pi) / 2
            at = tuple(min(clusters.WORLD - 1, max(0, math.floor(c * clusters.WORLD))) for c in (x, y))
            places.setdefault(at, []).append(k)
    nodes = [(min(ks), len(ks), x, y) for (x, y), ks in places.items()]
    out = {}
    for zoom in range(max_zoom, -1, -1):
        r, free, made, parents = clusters.radius_at(zoom, pixels), sorted(nodes, key=lambda n: turn(n[0])), [], {}
        while free:
            c = free[0]
            mine = [n for n in free if (n[2] - c[2]) ** 2 + (n[3] - c[3]) ** 2 <= r * r]
            free = [n for n in free if n not in mine]
            total = sum(n[1] for n in mine)
            made.append((min(n[0] for n in mine), total, sum(n[1] * n[2] for n in mine) // total, sum(n[1] * n[3] for n in mine) // total))
            parents |= {n[0]: made[-1][0] for n in mine}
        out |= {(zoom + 1, k): (*v[:1], parents[k]) for (z, k), v in out.items() if z == zoom + 1}
        out |= {(zoom, n[0]): (n[1:], None) for n in made}
        nodes = made
    return {(z, k): (p, *v) for (z, k), (v, p) in out.items()}


@pytest.mark.parametrize("one_task", [20_000, 60, 0])
def test_rounds_are_as_one_after_the_other(spark, monkeypatch, one_task):
    monkeypatch.setattr(clusters, "ONE_TASK", one_task)
    rng = random.Random(6)
    points = [(i, 40.7 + rng.gauss(0, 0.02), -74 + rng.gauss(0, 0.02)) for i in range(70)]
    points += [(100 + i, 40.7 + i * 1e-6, -74.0) for i in range(40)] + [(200 + i, 40.7, -74.0) for i in range(5)]
    points += [(300, None, 1.0), (None, 40.7, -74.0), (301, 89.9, 180.0), (302, -89.9, -180.0)]
    df = spark.createDataFrame(points, "id long, lat double, lon double").repartition(3)
    got = {(r.zoom, r.cluster): (r.parent, r.point_count, r.x, r.y) for r in clusters.cluster_tree(df, "id", max_zoom=13 if one_task else 11).collect()}
    assert got == one_by_one(points, 13 if one_task else 11, 50)


def test_every_zoom_holds_all_points(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.uniform(40.5, 40.9), rng.uniform(-74.2, -73.7)) for i in range(300)], "id long, lat double, lon double")
    rows = clusters.cluster_tree(df, "id").collect()
    for z in range(15):
        assert sum(r.point_count for r in rows if r.zoom == z) == 300
        below = {}
        for r in rows:
            if r.zoom == z + 1:
                below[r.parent] = below.get(r.parent, 0) + r.point_count
        assert not below or below == {r.cluster: r.point_count for r in rows if r.zoom == z}
    assert all(40.4 < r.lat < 41 and -74.3 < r.lon < -73.6 for r in rows)
    assert clusters.cluster_tree(df.limit(0), "id").count() == 0
