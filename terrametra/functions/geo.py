"""Distances, kernels and polygon tests as Column expressions.

Rings are ``array<struct<lng,lat>>``; a geometry is ``array<ring>`` (outer rings and holes alike, so the
even-odd rule decides what is inside).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
RING_TYPE = "array<struct<lng:double,lat:double>>"
GEOMETRY_TYPE = f"array<{RING_TYPE}>"


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    h = F.pow(F.sin(dlat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlng), F.lit(2.0)
    )
    h = F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(h))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return haversine_km(lat1, lng1, lat2, lng2) * 1000.0


def planar_sq(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return dx * dx + dy * dy


def planar_deg(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(planar_sq(x1, y1, x2, y2))


def planar_km(lng: Column, lat: Column, lng0: Column, lat0: Column, km_per_degree: float = 111.0) -> Column:
    """Equirectangular distance with the longitude shrunk at the reference latitude ``lat0``."""
    dx = (lng - lng0) * km_per_degree * F.cos(F.radians(lat0))
    dy = (lat - lat0) * km_per_degree
    return F.sqrt(dx * dx + dy * dy)


def gaussian(dist_sq: Column, sigma: float) -> Column:
    return F.exp(-dist_sq / F.lit(2.0 * sigma * sigma))


def mean_point(path: Column) -> Column:
    """Mean of the vertices of a polyline, as struct<lng,lat>."""
    n = F.size(path).cast("double")
    total = F.aggregate(
        path,
        F.struct(F.lit(0.0).alias("lng"), F.lit(0.0).alias("lat")),
        lambda acc, p: F.struct((acc["lng"] + p["lng"]).alias("lng"), (acc["lat"] + p["lat"]).alias("lat")),
    )
    return F.struct((total["lng"] / n).alias("lng"), (total["lat"] / n).alias("lat"))


def drop_repeats(path: Column, digits: int | None = None) -> Column:
    """Round the vertices (optional) and drop those equal to their predecessor."""
    pts = path
    if digits is not None:
        pts = F.transform(
            pts, lambda p: F.struct(F.bround(p["lng"], digits).alias("lng"), F.bround(p["lat"], digits).alias("lat"))
        )

    def kept(a: Column) -> Column:
        pairs = F.zip_with(a, F.concat(F.slice(a, 1, 1), a), lambda p, q: F.struct(p.alias("p"), q.alias("q")))  # each with the one before
        pairs = F.slice(pairs, 1, F.size(a))
        return F.transform(F.filter(pairs, lambda s, i: (i == 0) | (s["p"] != s["q"])), lambda s: s["p"])

    return once(pts, kept)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out one time, however often ``use`` refers to it, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def edges(ring: Column) -> Column:
    """Consecutive vertex pairs of a ring as array<struct<x1,y1,x2,y2>>."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(
        F.slice(ring, 1, n),
        F.slice(ring, 2, n),
        lambda p, q: F.struct(p["lng"].alias("x1"), p["lat"].alias("y1"), q["lng"].alias("x2"), q["lat"].alias("y2")),
    )


def bbox(rings: Column) -> Column:
    """struct<x0,y0,x1,y1> over all vertices of a geometry."""
    xs = F.transform(F.flatten(rings), lambda p: p["lng"])
    ys = F.transform(F.flatten(rings), lambda p: p["lat"])
    return F.struct(
        F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")
    )


def ray_edges(rings: Column) -> Column:
    """All edges of a geometry prepared for ray casts: array<struct<x,y1,y2,k>> with k = dx / dy."""
    return F.transform(
        F.flatten(F.transform(rings, edges)),
        lambda e: F.struct(
            e["x1"].alias("x"), e["y1"].alias("y1"), e["y2"].alias("y2"), F.try_divide(e["x2"] - e["x1"], e["y2"] - e["y1"]).alias("k")
        ),
    )


def inside_edges(prepared: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: an odd number of prepared edges crosses the ray to the right of the point."""
    crossing = F.filter(prepared, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x"] + (y - e["y1"]) * e["k"]))
    return F.size(crossing) % 2 == 1


def inside(rings: Column, x: Column, y: Column) -> Column:
    return inside_edges(ray_edges(rings), x, y)


def ring_centroid(ring: Column) -> Column:
    """Area centroid of a closed ring (vertex mean when the area vanishes)."""
    acc = F.aggregate(
        edges(ring),
        F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        lambda s, e: F.struct(
            (s["a"] + (e["x1"] * e["y2"] - e["x2"] * e["y1"])).alias("a"),
            (s["x"] + (e["x1"] + e["x2"]) * (e["x1"] * e["y2"] - e["x2"] * e["y1"])).alias("x"),
            (s["y"] + (e["y1"] + e["y2"]) * (e["x1"] * e["y2"] - e["x2"] * e["y1"])).alias("y"),
        ),
    )
    mean = mean_point(ring)
    flat = F.abs(acc["a"]) < 1e-15
    return F.struct(
        F.when(flat, mean["lng"]).otherwise(F.try_divide(acc["x"], acc["a"] * 3.0)).alias("lng"),
        F.when(flat, mean["lat"]).otherwise(F.try_divide(acc["y"], acc["a"] * 3.0)).alias("lat"),
    )


def interior_point(rings: Column) -> Column:
    """A point inside the geometry: the middle of the widest span on the scanline at half height."""
    box = bbox(rings)
    y = (box["y0"] + box["y1"]) / 2 + (box["y1"] - box["y0"]) * 1e-7

    def widest(c: Column) -> Column:
        pairs = F.zip_with(c, F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda u, v: F.struct((v - u).alias("w"), ((v + u) / 2).alias("mid")))
        return F.array_max(F.filter(pairs, lambda s, i: i % 2 == 0))["mid"]

    def middle(s: Column) -> Column:
        crossed = F.filter(F.flatten(F.transform(s["rings"], edges)), lambda e: (e["y1"] > s["y"]) != (e["y2"] > s["y"]))
        cuts = F.array_sort(F.transform(crossed, lambda e: e["x1"] + (s["y"] - e["y1"]) * F.try_divide(e["x2"] - e["x1"], e["y2"] - e["y1"])))
        return F.struct(once(cuts, widest).alias("lng"), s["y"].alias("lat"))

    return once(F.struct(rings.alias("rings"), y.alias("y")), middle)


def segment_meets_box(s: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Whether a segment (struct<x1,y1,x2,y2>) has a point in the box, or nearly so."""
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    over = (F.least(s["x1"], s["x2"]) <= x1) & (F.greatest(s["x1"], s["x2"]) >= x0) & (F.least(s["y1"], s["y2"]) <= y1) & (F.greatest(s["y1"], s["y2"]) >= y0)
    side = F.abs(dx * ((y0 + y1) / 2 - s["y1"]) - dy * ((x0 + x1) / 2 - s["x1"]))
    return over & (side <= (F.abs(dx) * (y1 - y0) + F.abs(dy) * (x1 - x0)) / 2 * (1 + 1e-9))


def segment_gap_sq(a: Column, b: Column) -> Column:
    """Squared distance between two segments (struct<x1,y1,x2,y2>); 0 when they cross."""

    def to_segment(px: Column, py: Column, s: Column) -> Column:
        dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
        t = F.coalesce(F.try_divide((px - s["x1"]) * dx + (py - s["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return planar_sq(px, py, s["x1"] + t * dx, s["y1"] + t * dy)

    def side(s: Column, px: Column, py: Column) -> Column:
        return (s["x2"] - s["x1"]) * (py - s["y1"]) - (s["y2"] - s["y1"]) * (px - s["x1"])

    cross = (side(a, b["x1"], b["y1"]) * side(a, b["x2"], b["y2"]) < 0) & (
        side(b, a["x1"], a["y1"]) * side(b, a["x2"], a["y2"]) < 0
    )
    nearest = F.least(
        to_segment(a["x1"], a["y1"], b),
        to_segment(a["x2"], a["y2"], b),
        to_segment(b["x1"], b["y1"], a),
        to_segment(b["x2"], b["y2"], a),
    )
    return F.when(cross, F.lit(0.0)).otherwise(nearest)
