"""Cells of sites are left out by the discs that hold what lies in them."""

import random

from pyspark.sql import functions as F

from emberline.operators import spatial
from tests.test_nearest_scale import frames, km


def test_nearest_over_the_whole_earth_is_exact(spark):
    rng = random.Random(9)
    any_place = lambda: (rng.uniform(-89.9, 89.9), rng.choice((rng.uniform(-180, 180), 179.9 + rng.uniform(0, 0.1), rng.uniform(75, 76))))
    sites = [(rng.choice("ab"), f"{i:04d}", *any_place()) for i in range(300)]
    points = list({any_place() for _ in range(200)})
    for r in spatial.nearest(*frames(spark, points, sites)).collect():
        assert abs(r.km - min(km(r.plat, r.plon, s[2], s[3]) for s in sites if s[0] == r.grp)) < 1e-6


def test_cells_are_left_out_by_what_they_hold(spark):
    # ten neighbouring cells of 1/64 degree with a site each, and a place in the first
    sites = spatial.cells_of(spark.createDataFrame([("a", 20.001, 75.001 + i / 64) for i in range(10)], "grp string, slat double, slon double"), "slat", "slon", "s")
    places = spatial.cells_of(spark.createDataFrame([(20.002, 75.001), (20.002, 75.002)], "plat double, plon double"), "plat", "plon", "p")
    p = spatial.discs(spatial.boxes(places, ["p0"], "plat", "plon"), ["p0"], "p")
    s = spatial.discs(spatial.boxes(sites, ["grp", "s0"], "slat", "slon"), ["grp", "s0"], "s")
    assert 0 < p.first().pfar < 0.1 and s.agg(F.max("sfar")).first()[0] == 0  # a whole cell reaches 1.2 km
    assert spatial.narrowed(p.crossJoin(s), ["grp", "p0"]).count() == 1  # four were kept by cells
