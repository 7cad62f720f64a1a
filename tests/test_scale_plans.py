"""Operators that replace windows and lists of all pairs, against brute force."""

import datetime
import math
import random

import numpy as np
from pyspark.sql import functions as F

from emberline.operators import clusters, ranks, reports, spatial

DAY = datetime.date(2024, 1, 1)


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


def test_ranks_and_quantiles(spark):
    rng = random.Random(3)
    xs = [rng.choice((None, 1.0, 2.5, 2.5, 7.0, -3.0, rng.uniform(0, 9))) for _ in range(300)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "ord long, x double").repartition(5)
    known = [x for x in xs if x is not None]
    got = {r.ord: r.p for r in ranks.average_rank(df, "x", "p").collect()}
    for i, x in enumerate(xs):
        want = None if x is None else (sum(y < x for y in known) + (sum(y == x for y in known) + 1) / 2) / len(known)
        assert got[i] is None if want is None else abs(got[i] - want) < 1e-12
    q = ranks.quantiles(df, "x", {"a": 0.25, "b": 0.5, "c": 1.0, "d": 0.0}).first()
    assert np.allclose(list(q), np.quantile(known, [0.25, 0.5, 1.0, 0.0]))
    assert list(ranks.quantiles(df.limit(0), "x", {"a": 0.5}).first()) == [None]
    by = {r.g: r for r in ranks.group_quantiles(df.withColumn("g", F.col("ord") % 3), "g", "x", {"m": 0.5}).collect()}
    for g in range(3):
        own = [x for i, x in enumerate(xs) if i % 3 == g and x is not None]
        assert abs(by[g].m - np.median(own)) < 1e-12 and by[g]["rows"] == len(own) and by[g].distinct == len(set(own))


def test_positions(spark):
    rows = [(i * 37 % 101, i) for i in range(101)]
    got = {r.k: r.n for r in ranks.before(spark.createDataFrame(rows, "k int, i int").repartition(6), [F.col("k").desc()], "n").collect()}
    assert got == {k: 100 - k for k, _ in rows}


def test_within_is_brute_force_at_poles_and_the_date_line(spark):
    rng = random.Random(8)
    places = [(rng.uniform(-89.9, 89.9), rng.choice((rng.uniform(-180, 180), 179.99 + rng.uniform(0, 0.01), -180 + rng.uniform(0, 0.02)))) for _ in range(150)]
    places += [(89.95 + rng.uniform(0, 0.04), rng.uniform(-180, 180)) for _ in range(40)] + [(a + rng.uniform(-0.03, 0.03), b) for a, b in places[:60]]
    places = [(max(-90, min(90, a)), b) for a, b in places]
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "a int, llat double, llon double")
    right = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "b int, rlat double, rlon double")
    got = sorted((r.a, r.b) for r in spatial.within(left, right, 3.0).collect())
    want = sorted((i, j) for i, p in enumerate(places) for j, q in enumerate(places) if km(*p, *q) <= 3.0)
    assert got == want and len(got) == len(set(got))


def test_clusters_are_components_of_all_pairs(spark):
    rng = random.Random(12)
    rows = []
    for i in range(160):  # dense packs, chains and loners
        base = rng.choice(((20.0, 75.0), (20.02, 75.02), (20.1, 75.0), (20.13, 75.0), (-33.0, 179.999)))
        lon = base[1] + rng.uniform(-0.015, 0.015)
        rows.append((i, base[0] + rng.uniform(-0.015, 0.015), lon - 360 if lon > 180 else lon, DAY + datetime.timedelta(days=rng.choice((0, 1, 2, 9, 15, 16, 30)))))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(rows):
        for j in range(i):
            q = rows[j]
            if km(p[1], p[2], q[1], q[2]) <= 3.0 and abs((p[3] - q[3]).days) <= 5:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    roots = [find(i) for i in range(len(rows))]
    want = {i: r for i, r in enumerate(roots) if roots.count(r) > 1}
    df = spark.createDataFrame(rows, "ord long, latitude double, longitude double, acq_date date")
    assert {r.ord: r.cluster_root for r in clusters.cluster(df).collect()} == want
    assert clusters.cluster(df.limit(0)).count() == 0


def test_polygons(spark):
    square = [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]], [[(10.0, 10.0), (11.0, 10.0), (10.0, 11.0)]]]
    edges = spark.createDataFrame(spatial.polygon_edges(square), "x1 double, y1 double, x2 double, y2 double")
    points = {(0.5, 0.5): True, (1.5, 1.5): False, (0.0, 2.0): False, (4.0, 4.0): False, (3.9, 3.9): True, (1.0, 1.5): False, (10.2, 10.2): True, (10.9, 10.9): False, (5.0, 2.0): False, (0.5, 1.0): True}
    df = spark.createDataFrame([(a, b) for a, b in points], "longitude double, latitude double")
    assert {tuple(r) for r in spatial.inside_polygon(df, edges).collect()} == {p for p, inside in points.items() if inside}


def test_simplify_and_dissolve():
    ring = [(0.0, 0.0), (1.0, 0.001), (2.0, 0.0), (2.0, 2.0), (1.0, 2.2), (0.0, 2.0)]
    assert spatial.simplify(ring, 0.01) == [p for p in ring if p != (1.0, 0.001)]
    assert len(spatial.simplify(ring, 100)) == 3
    a, b = [(0, 0), (1, 0), (1, 1), (0, 1)], [(2, 0), (2, 1), (1, 1), (1, 0)]
    (joined,) = spatial.dissolve([a, b])
    assert set(joined) == {*a, *b} and len(joined) == 6
    assert len(spatial.dissolve([a, [(5, 5), (6, 5), (6, 6)]])) == 2


def test_blur_keeps_the_mass(spark):
    grid = spark.createDataFrame([(0, 0, 5), (30, 399, 2)], "gx long, gy long, n long")
    got = reports.blurred(grid, cells=400).collect()
    assert abs(sum(r.v for r in got) - 7) < 1e-9 and all(0 <= r.gx < 400 and 0 <= r.gy < 400 for r in got)
