"""Where a route leaves a bounding box, and what is left of it outside, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions import geo

#: Kinds of result, numbered from 0.
KINDS = ("both_inside", "both_outside", "a_outside", "b_outside", "route_error", "invalid")


def crossing(df: DataFrame, box: str = "bounds") -> DataFrame:
    """``df`` with kind, lat, lon, outside_m, outside_s.

    ``df`` has the requested ends from_lat, from_lon, to_lat, to_lon, the box, and the route's shape
    and cum_s. Ends are judged as requested, not as snapped. With both ends inside, a point outside
    is an error; with both outside, any crossing is. Otherwise the first exit from the inside end counts.
    """
    b, shape, cum = F.col(box), F.col("shape"), F.col("cum_s")
    n = F.coalesce(F.size(shape), F.lit(0))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    ends = [F.col(c) for c in ("from_lat", "from_lon", "to_lat", "to_lon")]
    valid = F.coalesce(geo.valid_bounds(b), F.lit(False))
    for c in ends:
        valid &= finite(c)
    a_in, b_in = geo.in_box(ends[0], ends[1], b), geo.in_box(ends[2], ends[3], b)
    inside = lambda p: geo.in_box(p["lat"], p["lon"], b)
    any_out = F.exists(shape, lambda p: ~inside(p))
    crosses = F.exists(geo.pairs(shape), lambda s: geo.segment_meets_box(
        b, s["a"]["lat"], s["a"]["lon"], s["b"]["lat"], s["b"]["lon"],
    )) | ((n == 1) & inside(F.get(shape, F.lit(0))))
    line = F.when(a_in, shape).otherwise(F.reverse(shape))
    times = F.when(a_in, cum).otherwise(F.reverse(cum))
    out_at = F.array_position(F.transform(line, lambda p: ~inside(p)), True)  # from 1; 0: none; 1: the inside end is outside
    work = df.select("*", F.struct(line.alias("line"), times.alias("times"), out_at.cast("int").alias("k")).alias("__w"))
    w, k = F.col("__w"), F.col("__w.k")
    p, q = F.get(w["line"], k - 2), F.get(w["line"], k - 1)
    t = geo.exit_of_box(b, p["lat"], p["lon"], q["lat"], q["lon"])
    lat, lon = geo.lerp(p["lat"], q["lat"], t), geo.lerp(p["lon"], q["lon"], t)
    rest = geo.haversine(lat, lon, q["lat"], q["lon"]) + geo.polyline_length(F.slice(w["line"], F.greatest(k, F.lit(1)), F.size(w["line"])))
    at = F.get(w["times"], k - 2) + t * (F.get(w["times"], k - 1) - F.get(w["times"], k - 2))
    last = F.get(w["times"], F.size(w["times"]) - 1)
    left = F.when(F.coalesce(F.size(w["times"]) == F.size(w["line"]), F.lit(False)), F.greatest(F.lit(0.0), F.abs(last - at))).otherwise(0.0)
    kind = (
        F.when(~valid, "invalid").when(n == 0, "route_error")
        .when(a_in & b_in, F.when(any_out, "route_error").otherwise("both_inside"))
        .when(~a_in & ~b_in, F.when(crosses, "route_error").otherwise("both_outside"))
        .when(k <= 1, "route_error").when(a_in, "b_outside").otherwise("a_outside")
    )
    crossed: Column = F.col("kind").isin("a_outside", "b_outside")
    done = work.withColumn("kind", kind).withColumns({
        "lat": F.when(crossed, lat), "lon": F.when(crossed, lon), "outside_m": F.when(crossed, rest), "outside_s": F.when(crossed, left),
    })
    return done.drop("__w")
