"""The single-file graph format, read as tables and written for small graphs.

Layout, little-endian: a header of 256 bytes, nine section entries of 24, then vertices (lon, lat),
edges (from, to, shape offset, shape count, profile index), shape points, edge boxes, edge flags, a
packed tree of boxes, baked profiles by profile, an empty section, and metadata as JSON.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.sources import store

# Fixed values of the format.
MAGIC, MAJOR, MINOR, HEADER, ENTRY, LEAF = b"ODRG\0\0\0\0", 1, 1, 256, 24, 16
SECTIONS = ("vertex", "edge", "shape", "aabb", "flag", "tree", "baked", "turn", "metadata")
VERTEX = np.dtype([("lon", "<f8"), ("lat", "<f8")])
EDGE = np.dtype([("from_id", "<u4"), ("to_id", "<u4"), ("shape_at", "<u8"), ("shape_n", "<u4"), ("baked", "<u4")])
BOX = np.dtype([("min_lon", "<f8"), ("min_lat", "<f8"), ("max_lon", "<f8"), ("max_lat", "<f8")])
NODE = np.dtype([("box", BOX), ("first", "<u4"), ("count", "<u4"), ("flags", "<u4"), ("spare", "<u4", 3)])
BAKED = np.dtype([("speed", "<f4"), ("flags", "u1"), ("spare", "u1", 3)])


class OdrgError(ValueError):
    """A file that breaks the format."""


@dataclass
class OdrgFile:
    """A parsed file; arrays are views of its bytes."""

    minor: int
    bbox: tuple
    requested: tuple | None
    vertices: np.ndarray
    edges: np.ndarray
    shapes: np.ndarray
    boxes: np.ndarray
    flags: np.ndarray
    tree: np.ndarray
    tree_head: tuple  # nodes, root, branching, height
    baked: dict[str, np.ndarray]
    metadata: str


@dataclass
class Directory:
    """What a file's head says: counts, boxes, and where its sections are (offset, bytes)."""

    minor: int
    n_vertices: int
    n_edges: int
    n_profiles: int
    bbox: tuple
    requested: tuple | None
    sections: dict[str, tuple[int, int]]

    def place(self, name: str, kind, count: int | None = None, skip: int = 0) -> tuple[int, int]:
        """(offset, entries) of a section of fixed-size entries; all that fit where ``count`` is None."""
        if name not in self.sections:
            raise OdrgError(f"no section {name}")
        at, size = self.sections[name]
        each, size = np.dtype(kind).itemsize, size - skip
        n = size // each if count is None else count
        if size < 0 or n * each > size:
            raise OdrgError(f"section {name} is short")
        return at + skip, n


def directory(head: bytes, size: int) -> Directory:
    """Reads and validates the head (header and section table, or more) of a file of ``size`` bytes."""
    if len(head) < HEADER:
        raise OdrgError(f"{len(head)} bytes are no header")
    if head[:8] != MAGIC:
        raise OdrgError("not such a file")
    major, minor = struct.unpack_from("<HH", head, 8)
    if major != MAJOR:
        raise OdrgError(f"version {major}")
    n_vertices, n_edges = struct.unpack_from("<QQ", head, 16)
    n_profiles, flag_bytes, table_at, n_sections = struct.unpack_from("<IIQI", head, 64)
    if flag_bytes != 2:
        raise OdrgError(f"flags of {flag_bytes} bytes")
    if n_sections != len(SECTIONS):
        raise OdrgError(f"{n_sections} sections")
    if table_at + n_sections * ENTRY > min(size, len(head)):
        raise OdrgError("the section table is cut")
    found = {}
    for k in range(n_sections):
        kind, _, _, at, length = struct.unpack_from("<HHIQQ", head, table_at + k * ENTRY)
        if at + length > size:
            raise OdrgError(f"section {kind} is cut")
        if 1 <= kind <= len(SECTIONS):
            found[SECTIONS[kind - 1]] = (at, length)
    bbox, requested = struct.unpack_from("<4d", head, 32), struct.unpack_from("<4d", head, 88) if minor >= 1 else None
    return Directory(minor, n_vertices, n_edges, n_profiles, bbox, requested, found)


def baked_places(d: Directory, start: bytes) -> dict[str, int]:
    """Where each profile's entries begin, from the first bytes of the baked section."""
    at, size = d.sections["baked"]
    count, entry = struct.unpack_from("<II", start) if size >= 8 <= len(start) else (0, 0)
    if entry != BAKED.itemsize or count != d.n_profiles or 8 + 8 * count > min(size, len(start)):
        raise OdrgError("baked profiles are inconsistent")
    names = [struct.unpack_from("<II", start, 8 + 8 * k) for k in range(count)]
    letters = sum(n for _, n in names)
    first = 8 + 8 * count + letters
    if first + count * d.n_edges * BAKED.itemsize > size or first > len(start):
        raise OdrgError("section baked is short")
    text = start[8 + 8 * count : first]
    return {text[a : a + n].decode(): at + first + k * d.n_edges * BAKED.itemsize for k, (a, n) in enumerate(names)}


def parse(data: bytes) -> OdrgFile:
    """Reads and validates a whole file."""
    d = directory(data, len(data))

    def view(name: str, kind, count: int | None = None, skip: int = 0) -> np.ndarray:
        at, n = d.place(name, kind, count, skip)
        return np.frombuffer(data, kind, n, at)

    head = tuple(int(x) for x in view("tree", "<u4", 4))
    if d.sections["tree"][1] != 16 + head[0] * NODE.itemsize:
        raise OdrgError("the tree's length is wrong")
    if head[0] and head[1] >= head[0]:
        raise OdrgError("the tree's root is out of range")
    at, size = d.place("baked", "u1")
    baked = {name: np.frombuffer(data, BAKED, d.n_edges, place) for name, place in baked_places(d, data[at : at + size]).items()}
    at, size = d.place("metadata", "u1")
    return OdrgFile(
        d.minor, d.bbox, d.requested, view("vertex", VERTEX, d.n_vertices), view("edge", EDGE, d.n_edges), view("shape", VERTEX), view("aabb", BOX, d.n_edges),
        view("flag", "<u2", d.n_edges), view("tree", NODE, head[0], 16), head, baked, data[at : at + size].decode(),
    )


def vertex_rows(first: int, vertices: np.ndarray) -> pa.Table:
    """A run of vertices from number ``first``."""
    return pa.table({"vertex_id": np.arange(first, first + len(vertices)), "lat": vertices["lat"].copy(), "lon": vertices["lon"].copy()})


def edge_rows(first: int, edges: np.ndarray, boxes: np.ndarray, flags: np.ndarray, shapes: np.ndarray, shape_first: int) -> pa.Table:
    """A run of edges from number ``first``, with their points out of the run of shape points that begins at ``shape_first``."""
    points = pa.StructArray.from_arrays([pa.array(shapes["lat"].copy()), pa.array(shapes["lon"].copy())], ["lat", "lon"])
    begin, n = (edges["shape_at"] // VERTEX.itemsize).astype(np.int64) - shape_first, edges["shape_n"].astype(np.int64)
    take = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    if len(take) and (take.max() >= len(shapes) or take.min() < 0):
        raise OdrgError("an edge's shape is out of range")
    shape = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), points.take(pa.array(take)))
    corners = ["min_lat", "min_lon", "max_lat", "max_lon"]
    box = pa.StructArray.from_arrays([pa.array(boxes[c].copy()) for c in corners], corners)
    return pa.table({
        "edge_id": np.arange(first, first + len(edges)), "from_id": edges["from_id"].astype(np.int64),
        "to_id": edges["to_id"].astype(np.int64), "shape": shape, "box": box, "flags": flags.astype(np.int32),
    })


def baked_rows(name: str, first: int, entries: np.ndarray) -> pa.Table:
    """A run of a profile's entries: (profile, edge_id, can_pass, speed_kmh, fwd, bwd)."""
    bit = lambda k: (entries["flags"] >> k & 1).astype(bool)
    n = len(entries)
    return pa.table({
        "profile": [name] * n, "edge_id": np.arange(first, first + n), "can_pass": bit(0), "speed_kmh": entries["speed"].copy(),
        "fwd": bit(1), "bwd": bit(2),
    })


_SCHEMAS = {
    "vertex": "vertex_id long, lat double, lon double",
    "edge": "edge_id long, from_id long, to_id long, shape array<struct<lat:double,lon:double>>, box struct<min_lat:double,min_lon:double,max_lat:double,max_lon:double>, flags int",
    "baked": "profile string, edge_id long, can_pass boolean, speed_kmh float, fwd boolean, bwd boolean",
}
#: Entries that one task reads.
RUN = 1_000_000


def _bytes_at(f, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def _open_directory(path: str) -> Directory:
    """The directory of a file in any store: only its head is read."""
    with store.opened(path) as f:
        f.seek(0, 2)
        size = f.tell()
        head = _bytes_at(f, 0, HEADER + ENTRY * len(SECTIONS))
        if len(head) >= HEADER:
            table_at = struct.unpack_from("<Q", head, 72)[0]
            if HEADER < table_at < size:  # a table elsewhere
                head = _bytes_at(f, 0, table_at + ENTRY * len(SECTIONS))
        return directory(head, size)


def _run(section: str, path: str, name: str, place: int, first: int, n: int) -> pa.Table:
    """A run of entries of a section, read by itself."""
    d = _open_directory(path)
    with store.opened(path) as f:
        some = lambda part, kind, total: np.frombuffer(
            _bytes_at(f, d.place(part, kind, total)[0] + first * np.dtype(kind).itemsize, n * np.dtype(kind).itemsize), kind,
        )
        if section == "vertex":
            return vertex_rows(first, some("vertex", VERTEX, d.n_vertices))
        if section == "baked":
            return baked_rows(name, first, np.frombuffer(_bytes_at(f, place + first * BAKED.itemsize, n * BAKED.itemsize), BAKED))
        edges = some("edge", EDGE, d.n_edges)
        at, points = d.place("shape", VERTEX)
        used = edges[edges["shape_n"] > 0]
        low = int(used["shape_at"].min()) // VERTEX.itemsize if len(used) else 0
        high = int((used["shape_at"] // VERTEX.itemsize + used["shape_n"]).max()) if len(used) else 0
        if high > points:
            raise OdrgError("an edge's shape is out of range")
        shapes = np.frombuffer(_bytes_at(f, at + low * VERTEX.itemsize, (high - low) * VERTEX.itemsize), VERTEX)
        return edge_rows(first, edges, some("aabb", BOX, d.n_edges), some("flag", "<u2", d.n_edges), shapes, low)


def read(spark: SparkSession, path: str, section: str) -> DataFrame:
    """A section (vertex, edge or baked) of a file, or of all ``.odrg`` files below a folder, as a table with their ``path``.

    The driver reads the files' heads; each task reads runs of entries, and of nothing else.
    """
    schema, runs = _SCHEMAS[section], []
    for file in store.listed(path, ".odrg"):
        d = _open_directory(file)
        places = {"": 0}
        if section == "baked":
            at, size = d.place("baked", "u1")
            with store.opened(file) as f:
                places = baked_places(d, _bytes_at(f, at, min(size, 1 << 20)))
        total = d.n_vertices if section == "vertex" else d.n_edges
        runs += [(file, name, place, first, min(RUN, total - first)) for name, place in places.items() for first in range(0, total, RUN)]
    asked = spark.createDataFrame(
        runs, "path string, name string, place long, first long, n long",
    ).repartition(max(1, min(len(runs), 1000)), "path", "name", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                t = _run(section, r["path"], r["name"], r["place"], r["first"], r["n"])
                t = t.append_column("path", pa.array([r["path"]] * t.num_rows, pa.string()))
                yield from t.combine_chunks().to_batches(65_536)

    return asked.mapInArrow(run, f"{schema}, path string")


def packed_tree(boxes: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, int]:
    """(nodes from the root down, order of edges by leaf, height) of a sort-tile-recursive tree."""
    if not len(boxes):
        return np.zeros(0, NODE), np.zeros(0, np.int64), 0
    plain = np.stack([boxes[c] for c in ("min_lon", "min_lat", "max_lon", "max_lat")], 1)

    def tiles(b: np.ndarray) -> list[np.ndarray]:
        n = len(b)
        strips = max(1, math.ceil(math.sqrt(math.ceil(n / leaf))))
        size = max(leaf, math.ceil(n / strips))
        by_x = np.argsort((b[:, 0] + b[:, 2]) / 2, kind="stable")
        out = []
        for s in range(0, n, size):
            run = by_x[s : s + size]
            run = run[np.argsort((b[run, 1] + b[run, 3]) / 2, kind="stable")]
            out += [run[k : k + leaf] for k in range(0, len(run), leaf)]
        return out

    hull = lambda b: np.concatenate([b[:, :2].min(0), b[:, 2:].max(0)])
    levels, below = [], plain
    while not levels or len(levels[-1]) > 1:
        levels.append(tiles(below))
        below = np.stack([hull(below[g]) for g in levels[-1]])
    rows, order, wanted = [], [], np.array([0])
    sizes = [len(x) for x in levels[::-1]]
    hulls = [plain]
    for groups in levels:
        hulls.append(np.stack([hull(hulls[-1][g]) for g in groups]))
    start = 0
    for depth, k in enumerate(range(len(levels) - 1, -1, -1)):
        child_start, at, next_ = start + sizes[depth], 0, []
        for node in wanted.tolist():
            group = levels[k][node]
            rows.append((tuple(hulls[k + 1][node]), (child_start + at) if k else len(order), len(group), 0 if k else 1, (0, 0, 0)))
            at += len(group)
            (next_ if k else order).extend(group.tolist())
        start, wanted = child_start, np.array(next_, np.int64)
    return np.array(rows, NODE), np.array(order, np.int64), len(levels)


def pack(verts: DataFrame, edges: DataFrame, baked: DataFrame, source: str = "", requested: tuple | None = None, created: str = "") -> bytes:
    """The file of a graph small enough for one: vertices by id, edges in the tree's order."""
    v = verts.orderBy("vertex_id").select("lat", "lon").toArrow()
    e = edges.orderBy("edge_id").select("edge_id", "from_id", "to_id", "shape", "box", "flags").toArrow()
    b = baked.orderBy("profile", "edge_id").select("profile", "edge_id", "can_pass", "speed_kmh", "fwd", "bwd").toArrow()
    lat, lon = v.column("lat").to_numpy(), v.column("lon").to_numpy()
    n = e.num_rows
    boxes = np.zeros(n, BOX)
    for k, x in enumerate(e.column("box").to_pylist()):
        boxes[k] = (x["min_lon"], x["min_lat"], x["max_lon"], x["max_lat"])
    tree, order, height = packed_tree(boxes)
    shapes = e.column("shape").to_pylist()
    sizes = np.array([len(s or []) for s in shapes], np.int64)[order] if n else np.zeros(0, np.int64)
    flat = np.array([(p["lon"], p["lat"]) for k in order.tolist() for p in shapes[k] or []], VERTEX)
    rows = np.zeros(n, EDGE)
    if n:
        rows["from_id"], rows["to_id"] = e.column("from_id").to_numpy()[order], e.column("to_id").to_numpy()[order]
        rows["shape_at"], rows["shape_n"], rows["baked"] = (np.cumsum(sizes) - sizes) * VERTEX.itemsize, sizes, np.arange(n)
    place = np.zeros(len(lat), VERTEX)
    place["lon"], place["lat"] = lon, lat
    names = sorted(set(b.column("profile").to_pylist()))
    entries = np.zeros((len(names), n), BAKED)
    ids = e.column("edge_id").to_numpy() if n else np.zeros(0, np.int64)
    for k, name in enumerate(names):
        part = b.filter(pc.equal(b.column("profile"), name))
        at = np.searchsorted(part.column("edge_id").to_numpy(), ids[order])
        bits = part.column("can_pass").to_numpy() * 1 + part.column("fwd").to_numpy() * 2 + part.column("bwd").to_numpy() * 4
        entries[k]["speed"], entries[k]["flags"] = part.column("speed_kmh").to_numpy()[at], bits[at]
    bbox = (lon.min(), lat.min(), lon.max(), lat.max()) if len(lat) else (requested or (0.0,) * 4)
    raw = [x.encode() for x in names]
    table = np.array([(sum(map(len, raw[:k])), len(x)) for k, x in enumerate(raw)], "<u4").tobytes()
    meta = json.dumps({
        "createdAt": created, "source": source, "profiles": names, "bbox": list(map(float, bbox)), "vertexCount": len(lat), "edgeCount": n,
        "branchingFactor": LEAF,
    }).encode()
    bodies = [
        place.tobytes(), rows.tobytes(), flat.tobytes(), boxes[order].tobytes(), (e.column("flags").to_numpy()[order] if n else np.zeros(0)).astype("<u2").tobytes(),
        struct.pack("<4I", len(tree), 0, LEAF, height) + tree.tobytes(), struct.pack("<II", len(names), BAKED.itemsize) + table + b"".join(raw) + entries.tobytes(), b"", meta,
    ]
    at, index = HEADER + ENTRY * len(bodies), b""
    for k, body in enumerate(bodies):
        index += struct.pack("<HHIQQ", k + 1, 0, 0, at, len(body))
        at += len(body)
    head = MAGIC + struct.pack(
        "<HHIQQ4dIIQII", MAJOR, MINOR, 0, len(lat), n, *map(float, bbox), len(names), 2, HEADER, len(bodies), 0,
    ) + struct.pack("<4d", *map(float, requested or bbox))
    return head.ljust(HEADER, b"\0") + index + b"".join(bodies)


def with_requested_box(data: bytes, box: tuple[float, float, float, float]) -> bytes:
    """The file with another requested box (min lon, min lat, max lon, max lat), minor version 1."""
    parse(data)
    out = bytearray(data)
    struct.pack_into("<H", out, 10, 1)
    struct.pack_into("<4d", out, 88, *box)
    return bytes(out)


def metadata_row(verts: DataFrame, edges: DataFrame, names: list[str], source: str, created: str = "") -> DataFrame:
    """One row with the metadata as JSON, for graphs kept as tables."""
    v = verts.agg(
        F.count("*").alias("vertexCount"), F.min("lon").alias("a"), F.min("lat").alias("b"), F.max("lon").alias("c"),
        F.max("lat").alias("d"),
    )
    both = v.join(edges.agg(F.count("*").alias("edgeCount")), how="cross")  # one row each
    profiles, box = F.array(*map(F.lit, names)).alias("profiles"), F.array("a", "b", "c", "d").alias("bbox")
    return both.select(F.to_json(F.struct(
        F.lit(created).alias("createdAt"), F.lit(source).alias("source"), profiles, box, "vertexCount", "edgeCount",
        F.lit(LEAF).alias("branchingFactor"),
    )).alias("metadata"))
