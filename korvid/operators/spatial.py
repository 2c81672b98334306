"""Spatial operators as column expressions; nothing here needs a UDF.

Points are struct(lat, lon) in degrees, distances are metres. Bounding boxes go into the filter
first, so that they reach the scan; the exact test follows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean earth radius in metres, and metres in a degree of the planar metric.
EARTH = 6_371_008.8
DEGREE = EARTH * math.pi / 180
MARGIN = 1e-9
TOLERANCE = 1e-12

Ring = tuple[tuple[float, float], ...]


def point(lat, lon) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.struct(as_col(lat).cast("double").alias("lat"), as_col(lon).cast("double").alias("lon"))


def distance(a: Column, b: Column, metric: str = "HAVERSINE") -> Column:
    if metric.upper() == "EUCLIDEAN":
        return F.hypot(b["lat"] - a["lat"], b["lon"] - a["lon"]) * F.lit(DEGREE)
    p, q = F.radians(a["lat"]), F.radians(b["lat"])
    half = lambda x: F.pow(F.sin(x / 2), F.lit(2.0))
    h = half(q - p) + F.cos(p) * F.cos(q) * half(F.radians(b["lon"]) - F.radians(a["lon"]))
    return F.lit(2 * EARTH) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bounding_box(lat: float, lon: float, radius: float, metric: str = "HAVERSINE") -> tuple[float, float, float, float]:
    """(least lat, least lon, greatest lat, greatest lon) of a circle, never too small."""
    if metric.upper() == "EUCLIDEAN":
        dlat = dlon = radius / DEGREE
    else:
        angle = radius / EARTH
        if angle >= math.pi:
            return -90.0, -180.0, 90.0, 180.0
        dlat = math.degrees(angle)
        dlon = 180.0 if abs(lat) + dlat >= 90 else math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat)))))
    dlat, dlon = dlat + MARGIN, dlon + MARGIN
    west, east = lon - dlon, lon + dlon
    if metric.upper() != "EUCLIDEAN" and (west < -180 or east > 180):
        west, east = -180.0, 180.0
    return max(-90.0, lat - dlat), max(-180.0, west), min(90.0, lat + dlat), min(180.0, east)


def in_box(p: Column, box: tuple[float, float, float, float]) -> Column:
    return p["lat"].between(box[0], box[2]) & p["lon"].between(box[1], box[3])


def near(p: Column, lat: float, lon: float, radius: float, metric: str = "HAVERSINE", strict: bool = False) -> Column:
    """Within the radius, the border included unless strict."""
    d = distance(p, point(lat, lon), metric)
    return in_box(p, bounding_box(lat, lon, radius, metric)) & (d < radius if strict else d <= radius)


def radius_query(df: DataFrame, p: Column, lat: float, lon: float, radius: float, metric: str = "HAVERSINE") -> DataFrame:
    return df.where(near(p, lat, lon, radius, metric)).withColumn("distance", distance(p, point(lat, lon), metric))


def nearest(df: DataFrame, p: Column, lat: float, lon: float, k: int, tie: str, metric: str = "HAVERSINE") -> DataFrame:
    """The k nearest rows; filters on df count before. Planned as a top-k, without a full sort."""
    return df.withColumn("distance", distance(p, point(lat, lon), metric)).orderBy("distance", tie).limit(k)


def _edges(ring: Ring) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    return list(zip(ring, ring[1:] + ring[:1]))


def _ring_tests(p: Column, ring: Ring) -> tuple[Column, Column]:
    """(on the border, inside by the crossing rule) for one ring."""
    x, y = p["lon"], p["lat"]
    border, crossings = F.lit(False), F.lit(0)
    for (alat, alon), (blat, blon) in _edges(ring):
        dx, dy = blon - alon, blat - alat
        cross = (x - alon) * dy - (y - alat) * dx
        on = (F.abs(cross) <= TOLERANCE * max(abs(dx), abs(dy))) & x.between(min(alon, blon), max(alon, blon)) & y.between(min(alat, blat), max(alat, blat))
        border = border | on
        if dy:
            hit = ((F.lit(alat) > y) != (F.lit(blat) > y)) & (x < alon + (y - alat) * dx / dy)
            crossings = crossings + F.when(hit, 1).otherwise(0)
    return border, crossings % 2 == 1


def within_crossings(p: Column, rings: tuple[Ring, ...]) -> Column:
    """Inside the polygon by the crossing rule alone: of two polygons with a common edge, one has the points on it."""
    found = _ring_tests(p, rings[0])[1]
    for hole in rings[1:]:
        found = found & ~_ring_tests(p, hole)[1]
    return found


def within(p: Column, rings: tuple[Ring, ...]) -> Column:
    """Inside the polygon: its border and those of its holes included, the holes' insides not."""
    lats, lons = [v[0] for v in rings[0]], [v[1] for v in rings[0]]
    border, inside = _ring_tests(p, rings[0])
    found = border | inside
    for hole in rings[1:]:
        edge, hollow = _ring_tests(p, hole)
        found = found & (edge | ~hollow)
    return in_box(p, (min(lats), min(lons), max(lats), max(lons))) & found


def within_any(p: Column, polygons: list[tuple[Ring, ...]]) -> Column:
    out = F.lit(False)
    for rings in polygons:
        out = out | within(p, rings)
    return out


def ring_contains(lat: float, lon: float, rings: tuple[Ring, ...]) -> bool:
    """The same test on the driver, for single points."""

    def tests(ring: Ring) -> tuple[bool, bool]:
        border, crossings = False, 0
        for (alat, alon), (blat, blon) in _edges(ring):
            dx, dy = blon - alon, blat - alat
            cross = (lon - alon) * dy - (lat - alat) * dx
            border |= abs(cross) <= TOLERANCE * max(abs(dx), abs(dy)) and min(alon, blon) <= lon <= max(alon, blon) and min(alat, blat) <= lat <= max(alat, blat)
            crossings += (alat > lat) != (blat > lat) and lon < alon + (lat - alat) * dx / dy
        return border, crossings % 2 == 1

    border, inside = tests(rings[0])
    return (border or inside) and all(edge or not hollow for edge, hollow in map(tests, rings[1:]))


# -- Boxes --------------------------------------------------------------------------------------


def box_of(points: Column) -> Column:
    """The bounding box of an array of points."""
    lat, lon = F.transform(points, lambda p: p["lat"]), F.transform(points, lambda p: p["lon"])
    return F.struct(F.array_min(lat).alias("lat0"), F.array_min(lon).alias("lon0"), F.array_max(lat).alias("lat1"), F.array_max(lon).alias("lon1"))


def box_agg(p: Column) -> Column:
    """The bounding box of a group's points, as an aggregate that combines before the shuffle."""
    return F.struct(F.min(p["lat"]).alias("lat0"), F.min(p["lon"]).alias("lon0"), F.max(p["lat"]).alias("lat1"), F.max(p["lon"]).alias("lon1"))


def box_area(b: Column) -> Column:
    return (b["lat1"] - b["lat0"]) * (b["lon1"] - b["lon0"])


def box_margin(b: Column) -> Column:
    return (b["lat1"] - b["lat0"]) + (b["lon1"] - b["lon0"])


def box_union(a: Column, b: Column) -> Column:
    return F.struct(
        F.least(a["lat0"], b["lat0"]).alias("lat0"), F.least(a["lon0"], b["lon0"]).alias("lon0"), F.greatest(a["lat1"], b["lat1"]).alias("lat1"), F.greatest(a["lon1"], b["lon1"]).alias("lon1")
    )


def box_enlargement(a: Column, b: Column) -> Column:
    return box_area(box_union(a, b)) - box_area(a)


def box_intersects(a: Column, b: Column) -> Column:
    return (a["lat0"] <= b["lat1"]) & (b["lat0"] <= a["lat1"]) & (a["lon0"] <= b["lon1"]) & (b["lon0"] <= a["lon1"])


def box_contains(a: Column, b: Column) -> Column:
    return (a["lat0"] <= b["lat0"]) & (a["lon0"] <= b["lon0"]) & (a["lat1"] >= b["lat1"]) & (a["lon1"] >= b["lon1"])


def box_overlap(a: Column, b: Column) -> Column:
    """The area that two boxes share."""
    dlat = F.least(a["lat1"], b["lat1"]) - F.greatest(a["lat0"], b["lat0"])
    dlon = F.least(a["lon1"], b["lon1"]) - F.greatest(a["lon0"], b["lon0"])
    return F.greatest(dlat, F.lit(0.0)) * F.greatest(dlon, F.lit(0.0))


def box_distance(p: Column, b: Column, metric: str = "HAVERSINE") -> Column:
    """A lower bound of the distance from p to anything in the box, 0 inside."""
    lat = F.least(F.greatest(p["lat"], b["lat0"]), b["lat1"])
    lon = F.least(F.greatest(p["lon"], b["lon0"]), b["lon1"])
    if metric.upper() == "EUCLIDEAN":
        return F.hypot(lat - p["lat"], lon - p["lon"]) * F.lit(DEGREE)
    # The nearest meridian of the box, also across the date line; on a great circle to a meridian
    # at dlon the nearest latitude is atan(tan(lat) / cos(dlon)).
    gap = lambda to: F.abs(F.pmod(to - p["lon"] + 180, F.lit(360.0)) - 180)
    dlon = F.when(p["lon"].between(b["lon0"], b["lon1"]), F.lit(0.0)).otherwise(F.least(gap(b["lon0"]), gap(b["lon1"])))
    away = F.radians(dlon)
    best = F.degrees(F.atan2(F.sin(F.radians(p["lat"])), F.cos(F.radians(p["lat"])) * F.cos(away)))
    best = F.least(F.greatest(best, b["lat0"]), b["lat1"])
    ends = [distance(point(p["lat"], F.lit(0.0)), point(x, dlon), metric) for x in (best, b["lat0"], b["lat1"], lat)]
    return F.least(*ends)


def cell(p: Column, degrees: float = 1.0) -> Column:
    """A grid cell number, to partition or bucket points by."""
    return (F.floor((p["lat"] + 90) / degrees) * math.ceil(360 / degrees + 1) + F.floor((p["lon"] + 180) / degrees)).cast("long")


def join_cells(p: Column, radius: float, metric: str = "HAVERSINE") -> list[Column] | None:
    """A cell of a grid, number by number: points within the radius differ by 1 at most in each. None if few cells cover all.

    Haversine distances are chords between points of the unit sphere, so its grid is one of cubes and has neither poles
    nor a date line; the planar metric's is one of degrees.
    """
    if metric.upper() == "EUCLIDEAN":
        side, axes, most = radius / DEGREE, [p["lat"], p["lon"]], 60.0
    else:
        lat, lon = F.radians(p["lat"]), F.radians(p["lon"])
        side = 2 * math.sin(min(radius / EARTH, math.pi) / 2)
        axes, most = [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)], 0.7
    if not side < most:
        return None
    # Cells much smaller than a metre would be of no use; far places share the last one.
    side, far = max(side * (1 + MARGIN) + MARGIN, most * 1e-6), F.lit(1e15)
    return [F.floor(F.least(F.greatest(x / side, -far), far)) for x in axes]


def within_distance(left: DataFrame, right: DataFrame, a: Column, b: Column, radius: float, metric: str, on: Column) -> DataFrame:
    """The inner join on a condition that holds only where a of left and b of right are within the radius.

    The rows of the smaller side go to all cells around their own, and the pairs of a cell are put to the condition: each
    pair meets in one cell. Nothing is broadcast, so the cells are shared out whatever the tables' sizes.
    """
    cells, others = join_cells(a, radius, metric), join_cells(b, radius, metric)
    if cells is None or others is None:
        return left.join(right, on, "inner")
    names = [f"_near{i}" for i in range(len(cells))]
    sides = [left.withColumns({f"{n}l": c for n, c in zip(names, cells)}), right.withColumns({f"{n}r": c for n, c in zip(names, others)})]
    size = [int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in (left, right)]
    small, end = (1, "r") if size[1] <= size[0] else (0, "l")
    for n in names:
        around = F.explode(F.array(*[F.lit(x).cast("long") for x in (-1, 0, 1)]))
        sides[small] = sides[small].withColumn("_step", around).withColumn(f"{n}{end}", F.col(f"{n}{end}") + F.col("_step")).drop("_step")
    for n in names:
        on = on & (F.col(f"{n}l") == F.col(f"{n}r"))
    return sides[0].join(sides[1].hint("merge"), on, "inner").drop(*[f"{n}{e}" for n in names for e in "lr"])


def viewport(df: DataFrame, p: Column) -> DataFrame:
    """One row: the box of all points and their number, for a map."""
    return df.agg(F.min(p["lat"]).alias("lat0"), F.min(p["lon"]).alias("lon0"), F.max(p["lat"]).alias("lat1"), F.max(p["lon"]).alias("lon1"), F.count(p).alias("n"))
