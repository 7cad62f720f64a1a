"""Boundaries in GeoJSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import dissolve, simplify

RING = "array<array<double>>"


def polygons(geometry: str) -> Column:
    """Polygons (arrays of rings of points) of a geometry in JSON; null for other kinds."""
    kind = F.get_json_object(geometry, "$.type")
    rings = F.get_json_object(geometry, "$.coordinates")
    return F.when(kind == "Polygon", F.array(F.from_json(rings, f"array<{RING}>"))).when(kind == "MultiPolygon", F.from_json(rings, f"array<array<{RING}>>"))


def edges_of(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Edges (x1, y1, x2, y2) of the boundaries in a column of GeoJSON geometries; rings are closed, edges of no length left out."""
    rings = df.select(F.explode(polygons(geometry)).alias("p")).select(F.explode("p").alias("r"))
    point = F.posexplode("r").alias("i", "a")
    steps = rings.select("r", point).select("a", F.coalesce(F.get("r", F.col("i") + 1), F.get("r", F.lit(0))).alias("b"))
    return steps.select(F.col("a")[0].alias("x1"), F.col("a")[1].alias("y1"), F.col("b")[0].alias("x2"), F.col("b")[1].alias("y2")).where("x1 <> x2 OR y1 <> y2")


def read_boundary(spark: SparkSession, path: str) -> DataFrame | None:
    """Edges of a file of one feature, a collection, or a geometry; None if there is no such file, so that nothing is clipped."""
    from .registry import exists

    if not exists(spark, path):
        return None
    text = spark.read.text(path, wholetext=True)
    each = F.when(F.get_json_object("value", "$.type") == "FeatureCollection", F.transform(F.from_json(F.get_json_object("value", "$.features"), "array<struct<geometry:string>>"), lambda f: f["geometry"]))
    one = F.array(F.coalesce(F.get_json_object("value", "$.geometry"), F.col("value")))
    return edges_of(text.select(F.explode(F.coalesce(each, one)).alias("geometry")))


def build_boundary(collection: dict, tolerance: float = 0.01, name: str = "India") -> dict:
    """One feature from a collection of regions that share their borders: dissolved, then simplified."""
    rings = []
    for f in collection["features"]:
        g = f["geometry"]
        for p in [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"]:
            rings += [[tuple(c[:2]) for c in ring] for ring in p[:1]]
    outer = [simplify(r, tolerance) for r in dissolve([r[:-1] if r[0] == r[-1] else r for r in rings])]
    return {"type": "Feature", "properties": {"name": name}, "geometry": {"type": "MultiPolygon", "coordinates": [[[list(p) for p in [*r, r[0]]]] for r in outer]}}


def write_boundary(feature: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(feature, f)
