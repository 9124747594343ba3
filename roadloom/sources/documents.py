"""JSON documents: restriction sets, map boxes, and GeoJSON of roads, routes, areas and meshes."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import geo, mesh
from roadloom.operators import restrict
from roadloom.operators.lineage import landed
from roadloom.operators.restrict import Restrictions

#: Version 1 has outer rings only; version 2, ours, keeps holes.
FORMAT = "roadloom-restrictions"
MOST_MESHES = 10_000


class DocumentError(ValueError):
    """A document that breaks a rule."""


def parse_restrictions(text: str) -> list[dict]:
    """Validated items of a restriction document: all or none."""
    try:
        doc = json.loads(text)
    except json.JSONDecodeError as e:
        raise DocumentError(f"not JSON: {e}") from e
    if not isinstance(doc, dict) or not str(doc.get("format") or "").endswith("-restrictions"):
        raise DocumentError("not a restriction document")
    if doc.get("version") not in (1, 2):
        raise DocumentError(f"version {doc.get('version')}")
    out = []
    for k, item in enumerate(doc.get("items") or []):
        word = lambda key, item=item: str(item.get(key) or "").strip().lower()
        kind, shape = word("kind"), word("shapeType")
        if kind not in ("block", "difficulty"):
            raise DocumentError(f"item {k}: kind {kind!r}")
        if kind == "difficulty" and not str(item.get("difficultyType") or "").strip():
            raise DocumentError(f"item {k}: a difficulty needs a type")
        ring = lambda r: [(float(p["latitude"]), float(p["longitude"])) for p in r]
        row = {
            "kind": kind, "type": item.get("difficultyType") if kind == "difficulty" else None, "tag": item.get("tag"), "meshes": None,
            "levels": None, "outer": None, "holes": [],
        }
        if shape == "mesh":
            row["meshes"] = [int(c) for c in item.get("meshCodes") or []]
            if not row["meshes"]:
                raise DocumentError(f"item {k}: no mesh codes")
            if item.get("meshLevels") is not None:
                row["levels"] = [int(n) for n in item["meshLevels"]]
                if len(row["levels"]) != len(row["meshes"]):
                    raise DocumentError(f"item {k}: as many mesh levels as codes are needed")
        elif shape == "polygon":
            row["outer"], row["holes"] = ring(item.get("outerBoundary") or []), [ring(h) for h in item.get("holes") or []]
            if len(row["outer"]) < 3:
                raise DocumentError(f"item {k}: a polygon needs three points")
        else:
            raise DocumentError(f"item {k}: shape {shape!r}")
        out.append(row)
    return out


def load_restrictions(live: Restrictions, text: str) -> int:
    """Adds a document's areas at once; nothing is added if any item is wrong. Returns how many."""
    items = parse_restrictions(text)
    if not items:
        return 0
    spark, areas, polygons, cells = live.spark, [], [], []
    for item in items:
        key = uuid.uuid4().hex
        areas.append((key, item["kind"], item["type"], item["tag"]))
        if item["meshes"]:
            cells += [(key, k, c, n) for k, (c, n) in enumerate(zip(item["meshes"], item["levels"] or [None] * len(item["meshes"]), strict=True))]
        else:
            polygons.append((key, 0, item["outer"], item["holes"]))
    p = restrict.POINTS
    one = spark.createDataFrame(polygons, f"area_id string, shape_no int, outer {p}, holes array<{p}>").withColumn("box", geo.box_of(F.col("outer")))
    two = spark.createDataFrame(cells, "area_id string, shape_no int, mesh long, level int").select(
        "area_id", "shape_no", _sure_box().alias("box"), F.lit(None).cast(p).alias("outer"), F.lit(None).cast(f"array<{p}>").alias("holes"),
    )
    names = ["area_id", "shape_no", "box", "outer", "holes"]
    live.add_tables(spark.createDataFrame(areas, restrict.AREAS), one.select(*names).unionByName(two.select(*names)))
    return len(items)


def read_restrictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(areas, shapes) of one or many restriction documents, a document a row, read on executors; a wrong item is an error."""
    kinds = f"area_id string, kind string, difficulty_type string, tag string, meshes array<long>, levels array<int>, outer {restrict.POINTS}, holes array<{restrict.POINTS}>"
    ring = lambda r: [{"lat": a, "lon": o} for a, o in r]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                items = parse_restrictions(content.decode("utf-8"))
                rows = [
                    {
                        "area_id": hashlib.sha256(f"{name}/{k}".encode()).hexdigest(), "kind": i["kind"], "difficulty_type": i["type"], "tag": i["tag"],
                        "meshes": i["meshes"], "levels": i["levels"], "outer": ring(i["outer"]) if i["outer"] else None, "holes": [ring(h) for h in i["holes"]],
                    }
                    for k, i in enumerate(items)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=_ITEMS)

    found = landed(spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, kinds), "restrictions")
    areas = found.select("area_id", "kind", "difficulty_type", "tag")
    polygons = found.where("outer is not null").select(
        "area_id", F.lit(0).alias("shape_no"), geo.box_of(F.col("outer")).alias("box"), "outer", "holes",
    )
    cells = found.where("meshes is not null").select("area_id", "levels", F.posexplode("meshes").alias("shape_no", "mesh"))
    cells = cells.withColumn("level", F.get("levels", F.col("shape_no")))
    none = F.lit(None)
    meshes = cells.select(
        "area_id", "shape_no", _sure_box().alias("box"), none.cast(restrict.POINTS).alias("outer"),
        none.cast(f"array<{restrict.POINTS}>").alias("holes"),
    )
    return areas, polygons.unionByName(meshes)


_RING = pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))
_ITEMS = pa.schema([
    ("area_id", pa.string()), ("kind", pa.string()), ("difficulty_type", pa.string()), ("tag", pa.string()),
    ("meshes", pa.list_(pa.int64())), ("levels", pa.list_(pa.int32())), ("outer", _RING), ("holes", pa.list_(_RING)),
])


def box_type() -> str:
    """The type of a box."""
    return "struct<min_lat:double,min_lon:double,max_lat:double,max_lon:double>"


def _sure_box() -> Column:
    """The box of the columns mesh and level (null: the code's own); a wrong code is an error."""
    box = F.when(F.col("level").isNull(), mesh.box(F.col("mesh"))).otherwise(mesh.box(F.col("mesh"), F.col("level")))
    return F.when(box.isNotNull(), box).otherwise(F.raise_error("not a mesh code").cast(box_type()))


def restriction_items(areas: DataFrame, shapes: DataFrame, version: int = 2) -> DataFrame:
    """(area_id, item): each area as a JSON item; version 1 drops holes. Mesh areas need the code's centre only.

    An area with a cell whose code alone doesn't name it, as beyond 66°40' north, states the levels of its codes (meshLevels).
    """
    mid = lambda low, high: (F.col("box")[low] + F.col("box")[high]) / 2
    height = F.col("box.max_lat") - F.col("box.min_lat")
    at = lambda k: mesh.code_of_point(mid("min_lat", "max_lat"), mid("min_lon", "max_lon"), k)
    level = F.when(height > 0.75 / 120, 3).when(height > 0.375 / 120, 4).when(height > 0.1875 / 120, 5).otherwise(6)
    code = F.when(level == 3, at(3)).when(level == 4, at(4)).when(level == 5, at(5)).otherwise(at(6))
    ring = lambda r: F.transform(r, lambda p: F.struct(p["lat"].alias("latitude"), p["lon"].alias("longitude")))
    polygon = F.when(F.col("outer").isNotNull(), F.struct(ring(F.col("outer")).alias("outer"), F.transform("holes", ring).alias("holes")))
    s = shapes.select("area_id", "shape_no", F.when(F.col("outer").isNull(), code).alias("code"), level.alias("level"), polygon.alias("polygon")).groupBy("area_id").agg(
        F.array_sort(F.collect_list(F.when(
            F.col("code").isNotNull(), F.struct("shape_no", "code", "level"),
        ))).alias("cells"), F.max("polygon").alias("polygon")
    )
    joined = areas.join(s, "area_id")
    holes = [F.when(F.size("polygon.holes") > 0, F.col("polygon.holes")).alias("holes")] if version > 1 else []
    item = F.struct(
        "kind", F.col("difficulty_type").alias("difficultyType"), F.when(F.col("polygon").isNull(), "mesh").otherwise("polygon").alias("shapeType"),
        F.when(
            F.col("polygon").isNull(), F.transform("cells", lambda c: c["code"]),
        ).alias("meshCodes"), F.when(
            F.exists("cells", lambda c: ~mesh.standard(c["code"], c["level"])), F.transform("cells", lambda c: c["level"]),
        ).alias("meshLevels"), F.col("polygon.outer").alias("outerBoundary"), *holes, "tag",
    )
    return joined.select("area_id", F.to_json(item).alias("item"))


def save_restrictions(live: Restrictions, version: int = 2, name: str = FORMAT) -> str:
    """The live set as one document, for sets that one document can hold."""
    items = [json.loads(r["item"]) for r in restriction_items(live.areas, live.shapes, version).orderBy("area_id").toLocalIterator()]
    return json.dumps({"format": name, "version": version, "items": items}, ensure_ascii=False)


def add_gml(
    live: Restrictions, features: DataFrame, kind: str, difficulty_type: str | None = None, tag: str | None = None,
    bounds: Column | None = None,
) -> None:
    """Adds an area for each feature of :func:`roadloom.sources.gml.read`; with bounds, those with an outer vertex in them."""
    if kind not in ("block", "difficulty") or (kind == "difficulty" and not (difficulty_type or "").strip()):
        raise ValueError("a block, or a difficulty with a type")
    if bounds is not None:
        features = features.where(F.exists("outer", lambda p: geo.in_box(p["lat"], p["lon"], bounds)))
    rows = features.withColumn(
        "area_id", F.sha2(F.concat_ws("/", "path", "feature_no", F.lit(kind), F.lit(difficulty_type or ""), F.lit(tag or "")), 256),
    )
    areas = rows.select(
        "area_id", F.lit(kind).alias("kind"), F.lit(difficulty_type).cast("string").alias("difficulty_type"),
        F.lit(tag).cast("string").alias("tag"),
    )
    live.add_tables(areas, rows.select("area_id", F.lit(0).alias("shape_no"), geo.box_of(F.col("outer")).alias("box"), "outer", "holes"))


def map_box(path: str) -> tuple[float, float, float, float] | None:
    """(min lat, min lon, max lat, max lon) of a map file with NW and SE corners; None if it isn't one."""
    try:
        doc = json.loads(Path(path).read_text(encoding="utf-8"))
        corner = lambda key: next(v for k, v in doc.items() if k.lower() == key)
        place = lambda c: [float(next(v for k, v in c.items() if k.lower().startswith(n))) for n in ("lat", "lon")] if isinstance(c, dict) else [float(x) for x in c]
        (n, w), (s, e) = place(corner("nw")), place(corner("se"))
    except (OSError, ValueError, KeyError, StopIteration, AttributeError, TypeError):
        return None
    return (s, w, n, e) if s < n and w < e else None


def _line(points: Column) -> Column:
    return F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))


def _feature(geometry: Column, *properties) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def road_features(edges: DataFrame, bounds: Column | None = None) -> DataFrame:
    """(edge_id, feature) of edges (edge_id, line), in storage order; with bounds, those with any vertex in them."""
    if bounds is not None:
        edges = edges.where(F.exists("line", lambda p: geo.in_box(p["lat"], p["lon"], bounds)))
    return edges.select("edge_id", _feature(_line(F.col("line")), F.col("edge_id").alias("id")).alias("feature"))


def graph_features(verts: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, feature) of a whole graph's edges (edge_id, from_id, to_id, shape); an edge with an end that is no vertex is left out."""
    end = lambda p: verts.select(F.col("vertex_id").alias(f"{p}_id"), F.struct("lat", "lon").alias(p))
    whole = edges.join(end("from"), "from_id").join(end("to"), "to_id")
    line = F.concat(F.array("from"), F.coalesce("shape", F.array().cast(restrict.POINTS)), F.array("to"))
    return whole.select("edge_id", _feature(_line(line), F.col("edge_id").alias("id")).alias("feature"))


def route_features(routes: DataFrame) -> DataFrame:
    """(req_id, feature) of routes."""
    return routes.select("req_id", _feature(_line(F.col("shape")), "req_id", "dist_m", "dur_s").alias("feature"))


def area_features(areas: DataFrame, shapes: DataFrame) -> DataFrame:
    """(area_id, shape_no, feature) of restriction shapes."""
    b = F.col("box")
    corner = lambda a, o: F.struct(b[a].alias("lat"), b[o].alias("lon"))
    square = F.array(corner("min_lat", "min_lon"), corner("min_lat", "max_lon"), corner("max_lat", "max_lon"), corner("max_lat", "min_lon"))
    ring = lambda r: F.transform(geo.closed(r), lambda p: F.array(p["lon"], p["lat"]))
    rings = F.concat(
        F.array(ring(F.coalesce("outer", square))), F.coalesce(F.transform("holes", ring), F.array().cast("array<array<array<double>>>")),
    )
    g = F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"))
    return shapes.join(areas, "area_id").select("area_id", "shape_no", _feature(g, "area_id", "kind", "difficulty_type", "tag").alias("feature"))


def mesh_features(spark: SparkSession, box: tuple[float, float, float, float], level: int) -> DataFrame:
    """(mesh, feature) of the cells in a box; more than ``MOST_MESHES`` is an error."""
    cells = mesh.cells(spark.range(1).select(geo.normal_bounds(*box).alias("b")), "b", level).select("mesh")
    if cells.limit(MOST_MESHES + 1).count() > MOST_MESHES:
        raise ValueError(f"more than {MOST_MESHES} cells")
    b = mesh.box(F.col("mesh"), level)
    corner = lambda a, o: F.array(b[o], b[a])
    ring = F.array(
        corner("min_lat", "min_lon"), corner("min_lat", "max_lon"), corner("max_lat", "max_lon"), corner("max_lat", "min_lon"),
        corner("min_lat", "min_lon"),
    )
    g = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return cells.select("mesh", _feature(g, "mesh").alias("feature"))


def write_collection(features: DataFrame, path: str, column: str = "feature") -> None:
    """Writes features as text parts, one a line: newline-delimited GeoJSON, which needs no single writer."""
    features.select(column).write.mode("overwrite").text(path)


def collection(features: DataFrame, column: str = "feature") -> str:
    """A FeatureCollection in one string, for what a client can hold."""
    return '{"type":"FeatureCollection","features":[' + ",".join(r[0] for r in features.select(column).toLocalIterator()) + "]}"
