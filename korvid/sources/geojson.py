"""GeoJSON polygons: rings with holes, grouped by name."""

from __future__ import annotations

import json

Rings = tuple[tuple[tuple[float, float], ...], ...]


def _ring(coordinates: list) -> tuple[tuple[float, float], ...]:
    """[lon, lat] pairs as (lat, lon), without the closing repeat."""
    ring = tuple((float(p[1]), float(p[0])) for p in coordinates)
    ring = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
    if len(set(ring)) < 3:
        raise ValueError("a ring needs three different vertices")
    return ring


def polygons(node: dict) -> list[Rings]:
    """All polygons of a geometry, feature or collection, holes kept."""
    kind = node.get("type")
    if kind == "FeatureCollection":
        return [p for f in node["features"] for p in polygons(f)]
    if kind == "Feature":
        return polygons(node["geometry"])
    if kind == "GeometryCollection":
        return [p for g in node["geometries"] for p in polygons(g)]
    if kind == "Polygon":
        return [tuple(map(_ring, node["coordinates"]))]
    if kind == "MultiPolygon":
        return [tuple(map(_ring, p)) for p in node["coordinates"]]
    raise ValueError(f"{kind} has no polygon")


def districts(path: str, name_field: str) -> dict[str, list[Rings]]:
    """The polygons of each name in a feature collection."""
    with open(path, encoding="utf-8") as f:
        features = json.load(f)["features"]
    out: dict[str, list[Rings]] = {}
    for feature in features:
        out.setdefault(str(feature["properties"][name_field]), []).extend(polygons(feature))
    return out


def read_features(spark, path: str, name_field: str):
    """(name, kind, coordinates as JSON) with Spark's reader, for collections too large for the driver."""
    from pyspark.sql import functions as F

    schema = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return rows.select(F.try_element_at("f.properties", F.lit(name_field)).alias("name"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))
