"""Sites of facility records without lists of all pairs."""

import math
import random
import threading
from difflib import SequenceMatcher

from emberline.operators import clusters, scoring, spatial

GENERIC = ("industrial_area", "works", "other")


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


def test_sites_are_components_of_all_pairs(spark):
    rng = random.Random(5)
    names = ("", "alpha one", "alpha onee", "alpha oen", "beta", "betta", "gamma delta epsilon", "gamma delta epsilom")
    rows = []
    for i in range(260):  # dense places, chains, like names in both orders, the date line, no class, no place
        base = rng.choice(((20.0, 75.0), (20.03, 75.03), (20.2, 75.0), (20.24, 75.0), (20.28, 75.0), (-33.0, 179.995), (60.0, 10.0)))
        lat, lon = base[0] + rng.choice((0.0, 0.0, rng.uniform(-0.03, 0.03))), base[1] + rng.choice((0.0, 0.0, rng.uniform(-0.03, 0.03)))
        ftype = rng.choice(("steel", "power_plant", "flare", "steel", "power_plant", "flare", "refinery", "works" if i % 9 == 0 else "cement", None))
        rows.append((f"{i:03d}", lat if i % 40 else None, lon - 360 if lon > 180 else lon, ftype, rng.choice(names)))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(rows):
        for j in range(i):
            q = rows[j]
            if p[1] is None or q[1] is None or not (p[3] == q[3] and p[3] or p[3] in GENERIC or q[3] in GENERIC):
                continue
            far = km(*p[1:3], *q[1:3])
            if far <= 1.5 or far <= 5.0 and p[4] and q[4] and SequenceMatcher(None, q[4], p[4]).ratio() >= 0.82:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    roots = sorted({find(i) for i in range(len(rows))})
    want = {r[0]: f"F{roots.index(find(i)):05d}" for i, r in enumerate(rows)}
    df = spark.createDataFrame(rows, "ord string, lat double, lon double, ftype string, name string").repartition(5)
    assert {r.ord: r.facility_uid for r in clusters.assign_sites(df).collect()} == want
    assert clusters.assign_sites(df.limit(0)).count() == 0


def within_seconds(spark, seconds, act):
    """What ``act`` gives; its jobs are cancelled, and it fails, after so many seconds."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return act()
    finally:
        timer.cancel()


def test_work_does_not_grow_with_the_square_of_a_place(spark):
    records = spark.range(60000).selectExpr("lpad(id, 6, '0') AS ord", "20.0D + id % 2 * 0.5 AS lat", "75.0D AS lon", "'works' AS ftype", "concat('n', id) AS name")
    got = within_seconds(spark, 90, lambda: clusters.assign_sites(records).groupBy("facility_uid").count().collect())
    assert sorted(tuple(r) for r in got) == [("F00000", 30000), ("F00001", 30000)]


def test_records_of_one_place_are_counted_and_the_least_is_nearest(spark):
    records = spark.createDataFrame([("osm" if i % 3 else "wri", f"{i}", f"{i:03d}", 20.0 + i % 2 * 0.01, 75.0) for i in range(40)], "source string, source_id string, ord string, lat double, lon double")
    rows = spark.createDataFrame([(1, 20.0, 75.0), (2, 21.0, 75.0), (3, None, 75.0)], "ord long, latitude double, longitude double")
    got = {r.ord: (r.count_osm_3km, r.count_wri_3km, r._d_osm) for r in scoring.registry_distances(rows, records).collect()}
    assert got[1] == (26, 14, 0.0) and got[2][:2] == (0, 0) and abs(got[2][2] - km(21.0, 75.0, 20.01, 75.0)) < 1e-9 and got[3] == (0, 0, None)
    sites = records.selectExpr("source AS grp", "ord", "lat AS slat", "lon AS slon", "struct(ord AS o) AS site")
    near = spatial.nearest(rows.selectExpr("latitude AS plat", "longitude AS plon"), sites).where("plat = 20.0").collect()
    assert {r.grp: r.site.o for r in near} == {"osm": "002", "wri": "000"}
