"""Dynamic restrictions: areas that block roads or slow them down, kept as immutable tables.

areas: (area_id, kind block|difficulty, difficulty_type, tag); shapes: (area_id, shape_no, box,
outer, holes), outer null for a mesh cell. An area counts once for an edge, however many of its
shapes the edge meets; several areas multiply; a blocking area wins. Edges are affected whole.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import geo, mesh
from roadloom.functions.profiles import Profile
from roadloom.operators.lineage import cut
from roadloom.operators.spatial import box_join

POINTS = "array<struct<lat:double,lon:double>>"
AREAS = "area_id string, kind string, difficulty_type string, tag string"
SHAPES = f"area_id string, shape_no int, box struct<min_lat:double,min_lon:double,max_lat:double,max_lon:double>, outer {POINTS}, holes array<{POINTS}>"


def shape_meets_segment(box: Column, outer: Column, holes: Column, a: Column, b: Column) -> Column:
    """Whether a segment meets a shape: its box, and its polygon if it has one."""
    in_box = geo.segment_meets_box(box, a["lat"], a["lon"], b["lat"], b["lon"])
    return in_box & (outer.isNull() | geo.segment_meets_polygon(outer, F.coalesce(holes, F.array().cast(f"array<{POINTS}>")), a, b))


def hits(edges: DataFrame, shapes: DataFrame) -> DataFrame:
    """Distinct (area_id, edge_id) of edges (edge_id, line, box) that meet a shape."""
    left = shapes.select("area_id", F.col("box").alias("shape_box"), "outer", "holes")
    right = edges.select("edge_id", "line", F.col("box").alias("edge_box"))
    near = box_join(left, right, "shape_box", "edge_box")
    meets = F.exists(geo.pairs(F.col("line")), lambda s: shape_meets_segment(F.col("shape_box"), F.col("outer"), F.col("holes"), s["a"], s["b"]))
    return near.where(meets).select("area_id", "edge_id").distinct()


def areas_in_box(shapes: DataFrame, box: Column) -> DataFrame:
    """Distinct area_id of shapes whose box meets a box."""
    return shapes.where(geo.boxes_meet(F.col("box"), box)).select("area_id").distinct()


def areas_on_segment(shapes: DataFrame, a: Column, b: Column) -> DataFrame:
    """Distinct area_id of shapes that a segment meets."""
    return shapes.where(shape_meets_segment(F.col("box"), F.col("outer"), F.col("holes"), a, b)).select("area_id").distinct()


def edge_factors(found: DataFrame, areas: DataFrame, profile: Profile) -> DataFrame:
    """(edge_id, blocked, factor): the product of the speed factors of all areas on an edge."""
    d = profile.difficulty(F.col("difficulty_type"))
    each = found.join(areas, "area_id").select(
        "edge_id", (F.col("kind") == "block").alias("closed"),
        F.when(F.col("kind") == "block", F.struct(F.lit(1.0).alias("speed_factor"), F.lit(True).alias("can_pass"))).otherwise(d).alias("d"),
    )
    stops = F.col("closed") | ~F.col("d.can_pass") | (F.col("d.speed_factor") <= 0)
    sums = each.groupBy("edge_id").agg(F.bool_or(stops).alias("blocked"), F.product("d.speed_factor").alias("factor"))
    return sums.select("edge_id", "blocked", F.when(F.col("blocked"), 0.0).otherwise(F.col("factor")).alias("factor"))


def weighted_seconds(dist_m: Column, speed_kmh: Column, factor: Column | None = None, blocked: Column | None = None) -> Column:
    """Seconds over an edge; null where it can't be passed."""
    speed = speed_kmh.cast("double") * 1000.0 / 3600.0
    base = F.when(speed > 0, F.try_divide(dist_m.cast("double"), speed))
    if factor is None:
        return base
    f = F.coalesce(factor, F.lit(1.0))
    stop = F.coalesce(blocked, F.lit(False)) if blocked is not None else F.lit(False)
    return F.when(~stop & (f > 0), F.try_divide(base, f))


@dataclass
class Restrictions:
    """The live set of areas, its shapes, and the edges they meet once a graph is attached.

    Every change replaces tables; after ``every`` changes they are checkpointed, so that plans stay short.
    """

    spark: SparkSession
    areas: DataFrame = None
    shapes: DataFrame = None
    found: DataFrame | None = None
    edges: DataFrame | None = None
    graph_key: str | None = None
    every: int = 16
    changes: int = 0
    _ids: set = field(default_factory=set)

    def __post_init__(self) -> None:
        self.areas = self.areas if self.areas is not None else self.spark.createDataFrame([], AREAS)
        self.shapes = self.shapes if self.shapes is not None else self.spark.createDataFrame([], SHAPES)

    def attach(self, edges: DataFrame, key: str = "graph") -> Restrictions:
        """Binds a graph's edges (edge_id, line, box) and finds the edges of all areas; again the same graph: nothing to do; another: an error."""
        if self.graph_key == key:
            return self
        if self.graph_key is not None:
            raise ValueError("another graph is attached")
        self.edges, self.graph_key = edges, key
        self.found = hits(edges, self.shapes)
        return self

    def add_tables(self, areas: DataFrame, shapes: DataFrame) -> None:
        """Adds many areas at once; only their edges are computed."""
        self.areas, self.shapes = self.areas.unionByName(areas.select(*self.areas.columns)), self.shapes.unionByName(shapes.select(*self.shapes.columns))
        if self.edges is not None:
            self.found = self.found.unionByName(hits(self.edges, shapes))
        self._changed()

    def _add(self, kind: str, type_: str | None, tag: str | None, rows: DataFrame) -> str:
        key = uuid.uuid4().hex
        areas = self.spark.createDataFrame([(key, kind, type_, tag)], AREAS)
        self.add_tables(areas, rows.withColumn("area_id", F.lit(key)))
        return key

    def add_block(self, polygon=None, meshes=None, tag: str | None = None, holes=()) -> str:
        """A blocking area of one polygon of (lat, lon) points, or of mesh codes; returns its id."""
        return self._add("block", None, tag, self._rows(polygon, meshes, holes))

    def add_difficulty(self, type_: str, polygon=None, meshes=None, tag: str | None = None, holes=()) -> str:
        """An area that slows down by the profile's factor of a type."""
        if not (type_ or "").strip():
            raise ValueError("a difficulty type is needed")
        return self._add("difficulty", type_, tag, self._rows(polygon, meshes, holes))

    def _rows(self, polygon, meshes, holes) -> DataFrame:
        if (polygon is None) == (meshes is None):
            raise ValueError("either a polygon or mesh codes")
        if polygon is not None:
            if len(polygon) < 3:
                raise ValueError("a polygon needs three points")
            one = self.spark.createDataFrame(
                [(0, [tuple(map(float, p)) for p in polygon], [[tuple(map(float, p)) for p in h] for h in holes])],
                f"shape_no int, outer {POINTS}, holes array<{POINTS}>",
            )
            return one.withColumn("box", geo.box_of(F.col("outer")))
        codes = list(meshes)
        if not codes:
            raise ValueError("no mesh codes")
        rows = self.spark.createDataFrame(list(enumerate(map(int, codes))), "shape_no int, mesh long")
        bad = [c for c, ok in zip(
            codes, [r[0] for r in rows.orderBy("shape_no").select(mesh.valid(F.col("mesh"))).collect()], strict=True,
        ) if not ok]  # the caller's codes
        if bad:
            raise ValueError(f"not mesh codes: {bad}")
        return rows.select(
            "shape_no", mesh.box(F.col("mesh")).alias("box"), F.lit(None).cast(POINTS).alias("outer"),
            F.lit(None).cast(f"array<{POINTS}>").alias("holes"),
        )

    def remove(self, area_id: str) -> None:
        """Removes an area; an unknown id is no error."""
        self._keep(self.areas.where(F.col("area_id") != area_id))

    def remove_by_tag(self, tag: str) -> None:
        """Removes all areas of exactly this tag."""
        self._keep(self.areas.where(~F.coalesce(F.col("tag") == tag, F.lit(False))))

    def remove_where(self, condition: Column) -> None:
        """Removes all areas for which a condition on their columns is true."""
        self._keep(self.areas.where(~F.coalesce(condition, F.lit(False))))

    def clear(self) -> None:
        """Removes all areas."""
        self._keep(self.areas.where(F.lit(False)))

    def _keep(self, areas: DataFrame) -> None:
        gone = self.areas.select("area_id").join(areas.select("area_id"), "area_id", "left_anti")
        self.shapes = self.shapes.join(gone, "area_id", "left_anti")
        if self.found is not None:
            self.found = self.found.join(gone, "area_id", "left_anti")
        self.areas = areas
        self._changed()

    def _changed(self) -> None:
        self.changes += 1
        if self.changes % self.every == 0:
            self.areas, self.shapes = cut(self.areas), cut(self.shapes)
            self.found = cut(self.found) if self.found is not None else None

    def list_all(self) -> DataFrame:
        """All areas."""
        return self.areas

    def blocked(self) -> DataFrame:
        """Distinct edge_id that some blocking area holds."""
        return self.found.join(self.areas.where("kind = 'block'"), "area_id", "left_semi").select("edge_id").distinct()

    def difficulties(self) -> DataFrame:
        """(edge_id, area_id, difficulty_type) of difficulty areas on edges."""
        return self.found.join(self.areas.where("kind = 'difficulty'"), "area_id").select("edge_id", "area_id", "difficulty_type")

    def factors(self, profile: Profile, edges: DataFrame | None = None) -> DataFrame:
        """Edge factors for a profile, of the attached graph or, with none attached, of ``edges`` (edge_id, line, box)."""
        if self.found is None and edges is None:
            raise ValueError("a graph must be attached, or its edges given")
        return edge_factors(self.found if edges is None else hits(edges, self.shapes), self.areas, profile)
