"""Geometry as Column builders: distances, boxes, segments, rings and polygons.

Points are structs (lat, lon) or pairs of double columns; rings are arrays of such structs,
open or closed. Everything stays inside generated JVM code.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in metres and metres of a degree of latitude. Fixed values.
EARTH_RADIUS_M = 6371008.8
METERS_PER_DEGREE = 111320.0


def num(x) -> Column:
    """A double literal, or the column itself."""
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = map(num, (lat1, lon1, lat2, lon2))
    a, b = F.sin(F.radians(lat2 - lat1) / 2.0), F.sin(F.radians(lon2 - lon1) / 2.0)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return F.lit(2.0 * EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - h)))


def box_around(lat, lon, radius) -> Column:
    """The struct (min_lat, min_lon, max_lat, max_lon) around a point at a radius in metres."""
    lat, lon, radius = num(lat), num(lon), num(radius)
    d_lat = radius / METERS_PER_DEGREE
    c = F.cos(F.radians(lat))
    d_lon = F.when(c <= 1e-9, d_lat).otherwise(radius / (F.lit(METERS_PER_DEGREE) * F.when(c <= 1e-9, 1.0).otherwise(c)))
    return F.struct((lat - d_lat).alias("min_lat"), (lon - d_lon).alias("min_lon"), (lat + d_lat).alias("max_lat"), (lon + d_lon).alias("max_lon"))


def point_to_segment(lat, lon, a_lat, a_lon, b_lat, b_lon) -> Column:
    """The struct (dist_m, lat, lon, t) of the nearest point of a segment, on a plane scaled at the segment's middle.

    Degrees are subtracted before they are scaled: a point due north of a vertex is then equally far from all the segments
    that end there, to the last bit, and a tie remains one.
    """
    lat, lon, a_lat, a_lon, b_lat, b_lon = map(num, (lat, lon, a_lat, a_lon, b_lat, b_lon))
    ky = math.radians(1.0) * EARTH_RADIUS_M
    kx = F.lit(ky) * F.cos(F.radians((a_lat + b_lat) / 2.0))
    bx, by = (b_lon - a_lon) * kx, (b_lat - a_lat) * ky
    px, py = (lon - a_lon) * kx, (lat - a_lat) * ky
    square = bx * bx + by * by
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(px * bx + py * by, square), F.lit(0.0))))
    dx, dy = ((lon - a_lon) - t * (b_lon - a_lon)) * kx, ((lat - a_lat) - t * (b_lat - a_lat)) * ky
    dist = F.when(square <= 0, haversine(lat, lon, a_lat, a_lon)).otherwise(F.sqrt(dx * dx + dy * dy))
    return F.struct(dist.alias("dist_m"), (a_lat + t * (b_lat - a_lat)).alias("lat"), (a_lon + t * (b_lon - a_lon)).alias("lon"), t.alias("t"))


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two box structs meet; touching counts."""
    return (a["min_lat"] <= b["max_lat"]) & (a["max_lat"] >= b["min_lat"]) & (a["min_lon"] <= b["max_lon"]) & (a["max_lon"] >= b["min_lon"])


def in_box(lat, lon, box: Column) -> Column:
    """Whether a point is in a box, its edge included."""
    return num(lat).between(box["min_lat"], box["max_lat"]) & num(lon).between(box["min_lon"], box["max_lon"])


def _clip(box: Column, a_lat, a_lon, b_lat, b_lon) -> tuple[Column, Column]:
    """The parameters at which a segment enters and leaves a box; it meets the box if enter <= leave."""
    enter, leave = F.lit(0.0), F.lit(1.0)
    for a, b, low, high in ((a_lat, b_lat, box["min_lat"], box["max_lat"]), (a_lon, b_lon, box["min_lon"], box["max_lon"])):
        a, b = num(a), num(b)
        d = b - a
        flat = d == 0
        s, t = F.try_divide(low - a, d), F.try_divide(high - a, d)
        inside = (a >= low) & (a <= high)
        enter = F.greatest(enter, F.when(flat, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(s, t)))
        leave = F.least(leave, F.when(flat, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(s, t)))
    return enter, leave


def segment_meets_box(box: Column, a_lat, a_lon, b_lat, b_lon) -> Column:
    """Whether a segment meets a box; touching counts."""
    enter, leave = _clip(box, a_lat, a_lon, b_lat, b_lon)
    return enter <= leave


def exit_of_box(box: Column, a_lat, a_lon, b_lat, b_lon) -> Column:
    """The parameter at which a segment that starts in a box leaves it."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _clip(box, a_lat, a_lon, b_lat, b_lon)[1]))


def lerp(a, b, t) -> Column:
    """a + t (b - a)."""
    return num(a) + num(t) * (num(b) - num(a))


def box_distance2(lat, lon, box: Column) -> Column:
    """Squared distance in degrees of a point from a box; zero inside."""
    lat, lon = num(lat), num(lon)
    dy = F.greatest(box["min_lat"] - lat, F.lit(0.0), lat - box["max_lat"])
    dx = F.greatest(box["min_lon"] - lon, F.lit(0.0), lon - box["max_lon"])
    return dx * dx + dy * dy


def box_union(a: Column, b: Column) -> Column:
    """The least box that holds both."""
    return F.struct(*[f(a[c], b[c]).alias(c) for f, c in (
        (F.least, "min_lat"), (F.least, "min_lon"), (F.greatest, "max_lat"), (F.greatest, "max_lon"),
    )])


def box_of(points: Column) -> Column:
    """The box of an array of points, null if it is empty."""
    lats, lons = F.transform(points, lambda p: p["lat"]), F.transform(points, lambda p: p["lon"])
    box = F.struct(
        F.array_min(lats).alias("min_lat"), F.array_min(lons).alias("min_lon"), F.array_max(lats).alias("max_lat"),
        F.array_max(lons).alias("max_lon"),
    )
    return F.when(F.size(points) > 0, box)


def normal_bounds(lat1, lon1, lat2, lon2) -> Column:
    """A box struct from two opposite corners in any order."""
    lat1, lon1, lat2, lon2 = map(num, (lat1, lon1, lat2, lon2))
    return F.struct(
        F.least(lat1, lat2).alias("min_lat"), F.least(lon1, lon2).alias("min_lon"), F.greatest(lat1, lat2).alias("max_lat"),
        F.greatest(lon1, lon2).alias("max_lon"),
    )


def valid_bounds(box: Column) -> Column:
    """Whether a box is finite, not empty, and within the globe."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    ok = finite(box["min_lat"]) & finite(box["min_lon"]) & finite(box["max_lat"]) & finite(box["max_lon"])
    ok &= (box["min_lat"] < box["max_lat"]) & (box["min_lon"] < box["max_lon"])
    return ok & (box["min_lat"] >= -90) & (box["max_lat"] <= 90) & (box["min_lon"] >= -180) & (box["max_lon"] <= 180)


def pairs(points: Column) -> Column:
    """Neighbouring points of an array as structs (a, b)."""
    n = F.size(points)
    both = F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(n > 1, both).otherwise(F.slice(both, 1, 0))


def closed(ring: Column) -> Column:
    """A ring with its first point at its end."""
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    return F.when((first["lat"] == last["lat"]) & (first["lon"] == last["lon"]), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def polyline_length(points: Column) -> Column:
    """Metres along an array of points."""
    return F.aggregate(pairs(points), F.lit(0.0), lambda s, p: s + haversine(p["a"]["lat"], p["a"]["lon"], p["b"]["lat"], p["b"]["lon"]))


def _side(a: Column, b: Column, lat, lon) -> Column:
    """Positive, zero or negative as a point is left of, on or right of the line ab."""
    return (b["lon"] - a["lon"]) * (num(lat) - a["lat"]) - (b["lat"] - a["lat"]) * (num(lon) - a["lon"])


def _between(a: Column, b: Column, lat, lon) -> Column:
    lat, lon = num(lat), num(lon)
    return lat.between(
        F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]),
    ) & lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"]))


def ring_contains(ring: Column, lat, lon) -> Column:
    """Whether a ring holds a point by the even-odd rule, its boundary included; under three points: no."""
    lat, lon = num(lat), num(lon)
    sides = pairs(closed(ring))
    on = F.exists(sides, lambda s: (_side(s["a"], s["b"], lat, lon) == 0) & _between(s["a"], s["b"], lat, lon))

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        at = F.try_divide((b["lon"] - a["lon"]) * (lat - a["lat"]), b["lat"] - a["lat"]) + a["lon"]
        return ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < at)

    odd = F.size(F.filter(sides, lambda s: F.coalesce(crosses(s), F.lit(False)))) % 2 == 1
    return F.coalesce((F.size(ring) >= 3) & (on | odd), F.lit(False))


def polygon_contains(outer: Column, holes: Column, lat, lon) -> Column:
    """Whether a polygon holds a point; a hole and its boundary don't count."""
    return ring_contains(outer, lat, lon) & ~F.coalesce(F.exists(holes, lambda h: ring_contains(h, lat, lon)), F.lit(False))


def segments_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether segments ab and cd share a point."""
    sign = lambda x: F.signum(x)
    s1, s2 = sign(_side(a, b, c["lat"], c["lon"])), sign(_side(a, b, d["lat"], d["lon"]))
    s3, s4 = sign(_side(c, d, a["lat"], a["lon"])), sign(_side(c, d, b["lat"], b["lon"]))
    touch = (
        ((s1 == 0) & _between(a, b, c["lat"], c["lon"])) | ((s2 == 0) & _between(a, b, d["lat"], d["lon"]))
        | ((s3 == 0) & _between(c, d, a["lat"], a["lon"])) | ((s4 == 0) & _between(c, d, b["lat"], b["lon"]))
    )
    return ((s1 != s2) & (s3 != s4)) | touch


def segment_meets_ring(ring: Column, a: Column, b: Column) -> Column:
    """Whether a segment crosses or touches a ring's line."""
    return F.coalesce(F.exists(pairs(closed(ring)), lambda s: segments_meet(a, b, s["a"], s["b"])), F.lit(False))


def segment_meets_polygon(outer: Column, holes: Column, a: Column, b: Column) -> Column:
    """Whether a segment has an end in a polygon, or meets its outer or a hole's line."""
    inside: Callable = lambda p: polygon_contains(outer, holes, p["lat"], p["lon"])
    return inside(a) | inside(b) | segment_meets_ring(outer, a, b) | F.coalesce(F.exists(holes, lambda h: segment_meets_ring(h, a, b)), F.lit(False))
