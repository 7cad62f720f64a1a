"""The nearest-site search against brute force where cells are full."""

import math
import random

from pyspark.sql import functions as F

from emberline.operators import spatial


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


def crowded():
    rng = random.Random(3)
    sites = [("a" if i % 3 else "b", f"{i:04d}", 20 + rng.random() / 64, 75 + rng.random() / 64) for i in range(1500)]
    sites += [("b", "x1", 20.004, 75.001), ("b", "x0", 20.004, 75.003), ("c", "far", -70.0, 179.99), ("c", "pole", 89.99, -30.0)]
    points = [(20.004, 75.002), (20.0, 75.0), (-70.0, -179.99), (89.995, 150.0), (0.0, 0.0)] + [(20.004 + rng.random() / 2000, 75.002 + rng.random() / 2000) for _ in range(60)]
    return points, sites


def frames(spark, points, sites):
    return spark.createDataFrame(points, "plat double, plon double"), spark.createDataFrame(sites, "grp string, ord string, slat double, slon double").withColumn("site", F.struct("ord"))


def test_nearest_in_crowded_cells_is_exact(spark):
    points, sites = crowded()
    got = {(r.plat, r.plon, r.grp): (r.km, r.site.ord) for r in spatial.nearest(*frames(spark, points, sites)).collect()}
    assert len(got) == 3 * len(points)
    for (plat, plon, grp), (far, name) in got.items():
        least = min(km(plat, plon, s[2], s[3]) for s in sites if s[0] == grp)
        assert abs(far - least) < 1e-9
        assert name in {s[1] for s in sites if s[0] == grp and km(plat, plon, s[2], s[3]) <= least + 1e-9}


def test_sites_that_are_no_places_nearest_are_left_out_by_cells(spark):
    rng = random.Random(4)
    places = spatial.cells_of(spark.createDataFrame([(20.004 + rng.random() / 5000, 75.002 + rng.random() / 5000) for _ in range(300)], "plat double, plon double"), "plat", "plon", "p")
    sites = [("a", f"{i:04d}", i, 20 + rng.random() / 64, 75 + rng.random() / 64) for i in range(1500)]
    targets = spatial.cells_of(spark.createDataFrame(sites, "grp string, ord string, n long, slat double, slon double"), "slat", "slon", "s")
    left = places.select("p0").distinct().crossJoin(targets.select("grp", "s0").distinct())
    kept = {r.n for r in spatial.reached(places, left, targets.select("grp", "s0", "n", "ord", "slat", "slon")).collect()}
    wanted = {min(sites, key=lambda s: (km(p.plat, p.plon, s[3], s[4]), s[1]))[2] for p in places.collect()}
    assert wanted <= kept and len(kept) < 100  # of 1500; 300 places met all of them before
