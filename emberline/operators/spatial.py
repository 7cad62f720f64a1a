"""Spatial joins over grid buckets, and the polygon clip."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.exprs import haversine_km
from .graph import cut, dealt

KM_PER_DEGREE = 111.195
#: Cells that nearest neighbours are narrowed down by: shifts from the finest (1/64 degree) to 8, 1, 1/4, 1/16 and 1/64 degrees.
LEVELS = (9, 6, 4, 2, 0)
FINEST = 64


def columns_of(row: Column, km: float) -> Column:
    """How many cells go round the earth in a row of cells, each at least ``km`` wide as far as the next row goes."""
    height = km / KM_PER_DEGREE
    edge = F.least(F.lit(89.999), F.greatest(F.abs(row * height), F.abs((row + 1) * height)) + height)
    width = F.degrees(2 * F.asin(F.least(F.lit(1.0), math.sin(km / 2 / C.EARTH_KM) / F.cos(F.radians(edge)))))
    return F.greatest(F.lit(1), F.floor(360 / width * (1 - 1e-9))).cast("long")


def row_of(lat: str | Column, km: float) -> Column:
    return F.floor((F.col(lat) if isinstance(lat, str) else lat) * (KM_PER_DEGREE / km)).cast("long")


def column_of(lon: str, row: Column, km: float) -> Column:
    many = columns_of(row, km)
    return F.pmod(F.floor((F.col(lon) + 180) / 360 * many).cast("long"), many)


def in_cell(df: DataFrame, km: float, lat: str, lon: str) -> DataFrame:
    """Each row with its cell (columns cy, cx). Cells of a row of them go round the earth; their number follows the latitude."""
    return df.withColumn("cy", row_of(lat, km)).withColumn("cx", column_of(lon, F.col("cy"), km))


def around(df: DataFrame, km: float, lat: str, lon: str) -> DataFrame:
    """Each row once for every cell that may hold something within ``km`` of it: its own and the neighbours in three rows."""
    rows = df.withColumn("cy", F.explode(F.array(*[row_of(lat, km) + d for d in (-1, 0, 1)])))
    own, many = column_of(lon, F.col("cy"), km), columns_of(F.col("cy"), km)
    return rows.withColumn("cx", F.explode(F.array_distinct(F.array(*[F.pmod(own + d, many) for d in (-1, 0, 1)]))))


def within(left: DataFrame, right: DataFrame, km: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs at most ``km`` apart that agree in ``keys``, with km. ``left``: (llat, llon, ...), ``right``: (rlat, rlon, ...).

    The right side is copied to the cells around and met by an equi-join; the exact test
    follows. Pairs across the date line and near the poles are found.
    """
    met = in_cell(left, km, "llat", "llon").join(dealt(around(right, km, "rlat", "rlon")), ["cy", "cx", *keys])
    return met.withColumn("km", haversine_km("llat", "llon", "rlat", "rlon")).where(F.col("km") <= km).drop("cy", "cx")


def cells_of(df: DataFrame, lat: str, lon: str, prefix: str) -> DataFrame:
    """``df`` with its cell of each level, as one number (prefix and shift); parents are shifts of their children."""
    y, x = (F.floor(F.col(c) * FINEST).cast("int") for c in (lat, lon))
    return df.withColumns({f"{prefix}{k}": F.shiftleft(F.shiftright(y, k).cast("long"), 32) + F.shiftright(x, k) for k in LEVELS})


def boxes(df: DataFrame, keys: list[str], lat: str, lon: str) -> DataFrame:
    """``keys`` and the box of the places of each group: _s, _n, _w and _e, its least and greatest latitude and longitude."""
    return df.groupBy(*keys).agg(F.min(lat).alias("_s"), F.max(lat).alias("_n"), F.min(lon).alias("_w"), F.max(lon).alias("_e"))


def discs(cells: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """``keys`` and the middle (lat, lon) and radius, in km, of what holds the boxes of each group: a box's corners are farthest from its middle."""
    box = cells.groupBy(*keys).agg(F.min("_s").alias("_s"), F.max("_n").alias("_n"), F.min("_w").alias("_w"), F.max("_e").alias("_e"))
    box = box.select(*keys, "_s", "_n", "_e", ((F.col("_s") + F.col("_n")) / 2).alias(f"{prefix}lat"), ((F.col("_w") + F.col("_e")) / 2).alias(f"{prefix}lon"))
    corner = lambda lat: haversine_km(f"{prefix}lat", f"{prefix}lon", lat, "_e")
    return box.select(*keys, f"{prefix}lat", f"{prefix}lon", F.greatest(corner("_s"), corner("_n")).alias(f"{prefix}far"))


def narrowed(met: DataFrame, keys: list[str]) -> DataFrame:
    """Of pairs of discs (plat, plon, pfar and slat, slon, sfar) those that may hold a nearest site, of each group of ``keys``: the least distance that is possible is not over the greatest one of another."""
    met = met.withColumn("_km", haversine_km("plat", "plon", "slat", "slon"))
    met = met.withColumn("_most", F.min(F.col("_km") + F.col("sfar")).over(Window.partitionBy(*keys)))
    return met.where(F.col("_km") - F.col("sfar") <= F.col("_most") + 2 * F.col("pfar") + 1e-6)


def reached(places: DataFrame, left: DataFrame, sites: DataFrame) -> DataFrame:
    """p0, grp, n, ord, slat and slon of the sites that may be the nearest to a place of a cell.

    ``left``: pairs of cells grp, p0, s0. All places of a cell lie in their box, whose corners are farthest from its middle; a site
    that is farther from there than the nearest one by twice that radius is no place's nearest.
    """
    ends = [f(c).alias(f"_{n}{c}") for c in ("plat", "plon") for n, f in (("low", F.min), ("high", F.max))]
    mid = [((F.col(f"_low{c}") + F.col(f"_high{c}")) / 2).alias(f"_{c}") for c in ("plat", "plon")]
    boxes = places.groupBy("p0").agg(*ends).select("p0", *mid, "_lowplat", "_highplat", "_highplon")
    corner = lambda lat: haversine_km("_plat", "_plon", lat, "_highplon")
    boxes = boxes.select("p0", "_plat", "_plon", F.greatest(corner("_lowplat"), corner("_highplat")).alias("_radius"))
    cells, km = dealt(left).join(boxes, "p0"), haversine_km("_plat", "_plon", "slat", "slon")
    least = cells.join(sites, ["grp", "s0"]).groupBy("p0", "grp").agg(F.min(km).alias("_least"))
    kept = cells.join(least, ["p0", "grp"]).join(sites, ["grp", "s0"]).where(km <= F.col("_least") + 2 * F.col("_radius") + 1e-6)
    return kept.select("p0", "grp", "n", "ord", "slat", "slon")


def nearest_places(points: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """plat, plon, grp, km and n of the nearest site of each group to each distinct point; and the sites, with n, that can be told.

    ``points``: plat, plon; ``sites``: grp, ord, slat, slon and site. Ties go to the
    smaller ord. Branch and bound over cells: what lies in a cell is held by a disc, mostly
    much smaller than the cell, and a cell of sites that is farther than another's farthest
    place can be does not hold the nearest site. What is left at one level is
    narrowed at the next; the coarsest has at most some thousand cells, whatever the data, and
    its pairs, one join on a constant, are few. Points, sites and their cells are written once.
    Of the pairs that are left the least distance is found first, by hashing and without what sites
    tell of themselves; only pairs at that distance are ordered.
    """
    places = cut(cells_of(points.select("plat", "plon").distinct().where("plat IS NOT NULL AND plon IS NOT NULL"), "plat", "plon", "p"))
    # of the sites of a group that share a place only the one of least ord can be told
    first = sites.groupBy("grp", "slat", "slon").agg(F.min(F.struct("ord", "site")).alias("f")).select("grp", "slat", "slon", "f.ord", "f.site")
    targets = cut(cells_of(first, "slat", "slon", "s").withColumn("n", F.monotonically_increasing_id()))
    ours = cut(boxes(places, [f"p{k}" for k in LEVELS], "plat", "plon"))
    theirs = cut(boxes(targets, ["grp", *[f"s{k}" for k in LEVELS]], "slat", "slon"))
    left = None
    for i, k in enumerate(LEVELS):
        p = discs(ours, [f"p{j}" for j in LEVELS[max(0, i - 1) : i + 1]], "p")
        s = discs(theirs, ["grp", *[f"s{j}" for j in LEVELS[max(0, i - 1) : i + 1]]], "s")
        if left is None:
            met = p.withColumn("_all", F.lit(0)).join(s.withColumn("_all", F.lit(0)), "_all")
        else:
            met = left.join(p, f"p{LEVELS[i - 1]}").join(s, ["grp", f"s{LEVELS[i - 1]}"])
        left = narrowed(met, ["grp", f"p{k}"]).select("grp", f"p{k}", f"s{k}")
    left, lean = cut(left), targets.select("grp", "s0", "n", "ord", "slat", "slon")
    left = cut(reached(places, left, lean))
    km = haversine_km("plat", "plon", "slat", "slon")
    met = places.select("plat", "plon", "p0").join(dealt(left), "p0")
    best = met.groupBy("plat", "plon", "p0", "grp").agg(F.min(km).alias("least"))
    # the distance is computed again, so a last digit may be off; the order of what is left is exact
    tied = best.join(dealt(left), ["p0", "grp"]).withColumn("km", km).where(F.col("km") <= F.col("least") * (1 + 1e-12))
    found = tied.groupBy("plat", "plon", "grp").agg(F.min(F.struct("km", "ord", "n")).alias("b")).select("plat", "plon", "grp", "b.km", "b.n")
    return found, targets.select("n", "site")


def nearest(points: DataFrame, sites: DataFrame) -> DataFrame:
    """plat, plon, grp, km and site (struct) of the nearest site of each group to each distinct point: see :func:`nearest_places`."""
    found, told = nearest_places(points, sites)
    return found.join(told, "n").select("plat", "plon", "grp", "km", "site")


def polygon_edges(rings: list[list[list[tuple[float, float]]]]) -> list[tuple[float, float, float, float]]:
    """Edges (x1, y1, x2, y2) of a multipolygon given as polygons of rings of (lon, lat)."""
    return [(*a, *b) for polygon in rings for ring in polygon for a, b in zip(ring, ring[1:] + ring[:1]) if a != b]


def inside_polygon(df: DataFrame, edges: DataFrame, lat: str = "latitude", lon: str = "longitude", strip: float = 0.1) -> DataFrame:
    """Rows of ``df`` strictly inside. ``edges``: x1, y1, x2, y2 of one boundary.

    Distinct places are tested by ray casting: odd crossings, and on no edge. Edges are filed under
    the strips of latitude that they cross, so a place meets those of its own strip only.
    """
    x, y = F.col("px"), F.col("py")
    at = lambda c: F.floor(c / strip).cast("long")
    places = df.select(F.col(lon).alias("px"), F.col(lat).alias("py")).where("px IS NOT NULL AND py IS NOT NULL").distinct().withColumn("strip", at(y))
    filed = edges.withColumn("strip", F.explode(F.sequence(at(F.least("y1", "y2")), at(F.greatest("y1", "y2")))))
    crosses = ((F.col("y1") > y) != (F.col("y2") > y)) & (x < (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1"))
    turn = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) - (F.col("y2") - F.col("y1")) * (x - F.col("x1"))
    on = (turn == 0) & x.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & y.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    count = places.join(filed, "strip").groupBy("px", "py").agg(F.sum(F.coalesce(crosses, F.lit(False)).cast("int")).alias("c"), F.max(on.cast("int")).alias("on"))
    good = count.where((F.col("c") % 2 == 1) & (F.col("on") == 0)).select(F.col("px").alias(lon), F.col("py").alias(lat))
    return df.join(good, [lon, lat], "left_semi")


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """A ring without the points that lie within ``tolerance`` of what is kept (Douglas and Peucker); at least a triangle stays."""
    ring = points[:-1] if len(points) > 1 and points[0] == points[-1] else list(points)
    if len(ring) < 4:
        return ring

    def off(p, a, b):
        (px, py), (ax, ay), (bx, by) = p, a, b
        dx, dy = bx - ax, by - ay
        t = 0.0 if not (dx or dy) else max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)))
        return math.hypot(px - ax - t * dx, py - ay - t * dy)

    far = max(range(len(ring)), key=lambda i: (math.dist(ring[0], ring[i]), -i))
    kept, todo = {0, far}, [(0, far), (far, len(ring))]
    closed = [*ring, ring[0]]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        worst = max(range(a + 1, b), key=lambda i: (off(closed[i], closed[a], closed[b]), -i))
        if off(closed[worst], closed[a], closed[b]) > tolerance:
            kept.add(worst)
            todo += [(a, worst), (worst, b)]
    if len(kept) < 3:
        kept.add(max((i for i in range(len(ring)) if i not in kept), key=lambda i: (off(ring[i], ring[0], ring[far]), -i)))
    return [ring[i] for i in sorted(kept)]


def dissolve(polygons: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Rings of the union of polygons that share whole edges (as states of a country do): edges passed both ways cancel."""
    edges = {}
    for ring in polygons:
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))
        turned = ring if area > 0 else ring[::-1]
        for a, b in zip(turned, turned[1:] + turned[:1]):
            if a != b:
                if edges.get((b, a), 0):
                    edges[(b, a)] -= 1
                else:
                    edges[(a, b)] = edges.get((a, b), 0) + 1
    after: dict = {}
    for (a, b), n in sorted(edges.items()):
        after.setdefault(a, []).extend([b] * n)
    rings = []
    for start in sorted(after):
        while after.get(start):
            ring, here = [], start
            while after.get(here):
                ring.append(here)
                here = after[here].pop()
            rings.append(ring)
    return rings
