"""Spatial joins on a grid of cells: box queries, nearest edges, snapping points to roads.

A plain range join compares all pairs. Here both sides explode to the cells that they cover,
join on the cell, and are then tested exactly; a pair that meets in several cells is kept only
in the least of them, so no distinct is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import geo
from roadloom.functions.geo import EARTH_RADIUS_M, METERS_PER_DEGREE
from roadloom.operators.lineage import cut, landed

#: Degrees of a cell, the most cells that one box covers at its level, and how much wider a level's cells are.
CELL, MOST_CELLS, SCALE = 0.005, 1024, 8


def _cell(x, size: float) -> Column:
    return F.floor(geo.num(x) / float(size))


def with_cells(df: DataFrame, box: str, size: float = CELL) -> DataFrame:
    """``df`` with a row for each cell (cy, cx) of its box."""
    b = F.col(box)
    span = lambda low, high: F.sequence(_cell(b[low], size), _cell(b[high], size))
    return df.withColumn("cy", F.explode(span("min_lat", "max_lat"))).withColumn("cx", F.explode(span("min_lon", "max_lon")))


def n_cells(box: Column, size: float = CELL) -> Column:
    """How many cells a box covers."""
    span = lambda low, high: _cell(box[high], size) - _cell(box[low], size) + 1
    return span("min_lat", "max_lat") * span("min_lon", "max_lon")


def _level(box: Column, size: float) -> Column:
    """The least level from 0 at whose cells (``SCALE`` times wider each) a box covers at most ``MOST_CELLS``."""
    wide = F.greatest(box["max_lat"] - box["min_lat"], box["max_lon"] - box["min_lon"], F.lit(0.0))
    room = size * (MOST_CELLS**0.5 - 2)
    return F.greatest(F.lit(0), F.ceil(F.log(F.greatest(wide / room, F.lit(1.0))) / F.log(F.lit(float(SCALE))))).cast("int")


def box_join(left: DataFrame, right: DataFrame, left_box: str, right_box: str, size: float = CELL, land: bool = True) -> DataFrame:
    """Pairs of rows whose boxes meet; column names of the two sides must differ; boxes with a null or NaN meet nothing.

    Both sides land first, since their levels are asked for before they are joined; ``land`` is false where they are tables already.

    Each box has a level by its extent, of either side: cells grow ``SCALE``-fold a level, so that none covers
    more than ``MOST_CELLS``. Boxes of levels i and j meet on the cells of the higher level, so a
    country-wide area or a ferry's box neither explodes to millions of rows nor meets others there.
    """
    whole = lambda b: F.col(b).isNotNull() & ~F.isnan(sum(F.col(b)[c] for c in ("min_lat", "min_lon", "max_lat", "max_lon")))
    left = left.where(whole(left_box)).withColumn("__i", _level(F.col(left_box), size))
    right = right.where(whole(right_box)).withColumn("__j", _level(F.col(right_box), size))
    if land:
        left, right = landed(left, "boxes"), landed(right, "boxes")
    # a few levels a side: the globe has 6 at this width and scale
    i_levels = sorted(r[0] for r in left.select("__i").distinct().collect())
    j_levels = sorted(r[0] for r in right.select("__j").distinct().collect())
    out = None
    for top in sorted({*i_levels, *j_levels}):
        wide = size * float(SCALE) ** top
        first = lambda c, wide=wide: F.greatest(_cell(F.col(left_box)[c], wide), _cell(F.col(right_box)[c], wide))
        for some, others in (
            (left.where(F.col("__i") == top), right.where(F.col("__j") <= top)),
            (left.where(F.col("__i") < top), right.where(F.col("__j") == top)),
        ):
            cells = with_cells(some, left_box, wide).join(with_cells(others, right_box, wide), ["cy", "cx"])
            met = cells.where((F.col("cy") == first("min_lat")) & (F.col("cx") == first("min_lon")) & geo.boxes_meet(F.col(left_box), F.col(right_box)))
            out = met if out is None else out.unionByName(met)
            if len({*i_levels, *j_levels}) == 1:
                break  # one level: every pair is in the first join
    if out is None:
        out = left.join(right, F.lit(False))
    return out.drop("cy", "cx", "__i", "__j")


def nearest_edges(points: DataFrame, edges: DataFrame, k: int, size: float = CELL, point_id: str = "point_id") -> DataFrame:
    """(point, edge_id, d2): the k edges of the least squared distance in degrees from point to box, ties to the smaller id.

    The searched square doubles for those points whose k-th candidate lies outside it, until none is left. It ends, for
    a square that holds every edge finds them all. A point that is null or NaN has no nearest edge and is an error;
    without edges or points there are no rows.
    """
    edges = cut(edges.select("edge_id", "box"))
    total = edges.count()
    k = min(k, total)
    point = points.select(point_id, "lat", "lon")
    sure = F.when(
        F.isnan("lat") | F.isnan("lon") | F.col("lat").isNull() | F.col("lon").isNull(),
        F.raise_error(F.lit("a point without a place")).cast("double"),
    ).otherwise(F.col("lat"))
    left = cut(point.withColumn("lat", sure))
    found = left.select(point_id).limit(0).withColumns({"edge_id": F.lit(0).cast("long"), "d2": F.lit(0.0)})
    if not k:
        return found
    reach, slim = size, edges.select("edge_id", F.col("box").alias("edge_box"))
    while not left.isEmpty():
        square = F.struct(
            (F.col("lat") - reach).alias("min_lat"), (F.col("lon") - reach).alias("min_lon"), (F.col("lat") + reach).alias("max_lat"),
            (F.col("lon") + reach).alias("max_lon"),
        )
        near = box_join(
            left.withColumn("square", square), slim, "square", "edge_box", max(size, reach), False,
        ).withColumn("d2", geo.box_distance2(F.col("lat"), F.col("lon"), F.col("edge_box")))
        rank = F.row_number().over(Window.partitionBy(point_id).orderBy("d2", "edge_id"))  # keeps k rows a point before the shuffle
        best = near.where(F.col("d2") <= reach * reach).select(point_id, "edge_id", "d2").withColumn("r", rank).where(F.col("r") <= k)
        best = cut(best)
        done = best.where(F.col("r") == k).select(point_id)
        found = found.unionByName(best.join(done, point_id, "left_semi").drop("r"))
        left = cut(left.join(done, point_id, "left_anti"))
        reach *= 2
    return found


def segments(edges: DataFrame, line: str = "line") -> DataFrame:
    """``edges`` with a row for each segment: seg, a, b."""
    return edges.select(
        "*", F.posexplode(geo.pairs(F.col(line))).alias("seg", "ab"),
    ).select("*", F.col("ab.a").alias("a"), F.col("ab.b").alias("b")).drop("ab")


def _nearest_within(points: DataFrame, roads: DataFrame, radius_m: float, point_id: str, size: float) -> DataFrame:
    """(point, edge_id, s): of each point (p_lat, p_lon) the nearest place on the segments ``roads`` within a radius; equal ones by edge, then segment."""
    around = points.withColumn("around", geo.box_around(F.col("p_lat"), F.col("p_lon"), radius_m))
    near = box_join(around, roads, "around", "seg_box", size)
    at = geo.point_to_segment(F.col("p_lat"), F.col("p_lon"), F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    near = near.select(point_id, "edge_id", "seg", at.alias("at")).where(F.col("at.dist_m") <= radius_m)
    order = F.struct(F.col("at.dist_m").alias("dist_m"), "edge_id", "seg", F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"), F.col("at.t").alias("t"))
    return near.groupBy(point_id).agg(F.min(order).alias("s")).select(point_id, "s.edge_id", "s")


def snap(
    points: DataFrame, edges: DataFrame, baked: DataFrame, profile: str, radius_m: float = 500.0, point_id: str = "point_id",
    size: float = CELL,
) -> DataFrame:
    """(point, edge_id, dist_m, lat, lon, offset): the nearest passable road within a radius of each point.

    Points without one give no row, nor does a blank or unknown profile or a radius of zero. Ties go to the
    smaller edge, then segment. ``offset`` is the place along the edge from 0 to 65535, half to even.
    ``edges`` needs line (all points), box and dist_m.
    """
    if not (profile or "").strip() or radius_m <= 0:
        return points.select(point_id).limit(0).withColumns({
            "edge_id": F.lit(0).cast("long"), "dist_m": F.lit(0.0), "lat": F.lit(0.0), "lon": F.lit(0.0), "offset": F.lit(0),
        })
    open_ = baked.where((F.col("profile") == profile) & F.col("can_pass")).select("edge_id")
    roads = segments(edges.join(open_, "edge_id", "left_semi").select("edge_id", "line"))  # a row a segment keeps distances in generated code
    side = lambda f, c: f(F.col("a")[c], F.col("b")[c])
    box = F.struct(
        side(F.least, "lat").alias("min_lat"), side(F.least, "lon").alias("min_lon"),
        side(F.greatest, "lat").alias("max_lat"), side(F.greatest, "lon").alias("max_lon"),
    )
    roads = landed(roads.select("edge_id", "seg", "a", "b", box.alias("seg_box")), "segments")
    asked = landed(points.select(point_id, F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), "points")
    # what is found within an eighth of the radius is the nearest; only the other points look further
    first = landed(_nearest_within(asked, roads, radius_m / 8, point_id, max(size / 4, radius_m / METERS_PER_DEGREE / 4)), "near")
    rest = asked.join(first.select(point_id), point_id, "left_anti")
    pick = first.unionByName(_nearest_within(rest, roads, radius_m, point_id, size))
    placed = pick.join(edges.select("edge_id", "line"), "edge_id")
    line, s = F.col("line"), F.col("s")
    before = geo.polyline_length(F.slice(line, 1, s["seg"] + 1))
    a, b = F.get(line, s["seg"]), F.get(line, s["seg"] + 1)
    along = before + s["t"] * geo.haversine(a["lat"], a["lon"], b["lat"], b["lon"])
    ratio = F.coalesce(F.try_divide(along, geo.polyline_length(line)), F.lit(0.0))
    offset = F.greatest(F.lit(0.0), F.least(F.lit(65535.0), F.rint(ratio * 65535.0))).cast("int")
    return placed.select(point_id, "edge_id", s["dist_m"].alias("dist_m"), s["lat"].alias("lat"), s["lon"].alias("lon"), offset.alias("offset"))


def snap_anywhere(
    points: DataFrame, edges: DataFrame, baked: DataFrame, profile: str, radius_m: float = 500.0, point_id: str = "point_id",
    size: float = CELL,
) -> DataFrame:
    """:func:`snap` without a radius: it grows for those points that have found nothing, until it holds the globe."""
    edges, left = cut(edges.select("edge_id", "line", "box")), cut(points.select(point_id, "lat", "lon"))
    found = None
    while found is None or not left.isEmpty():
        near = cut(snap(left, edges, baked, profile, radius_m, point_id, max(size, radius_m / METERS_PER_DEGREE)))
        found = near if found is None else found.unionByName(near)
        if radius_m > math.pi * EARTH_RADIUS_M:
            break  # no road is open
        left = cut(left.join(near.select(point_id), point_id, "left_anti"))
        radius_m *= 8
    return found
