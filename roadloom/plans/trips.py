"""The driver's tables written as files of the formats that the engine reads, a file a task, below the shared folder."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators.lineage import scratch
from roadloom.sources import odrg, pbf, store

#: Rows of a block, and of a document.
BLOCK, DOCUMENT = 2000, 500


# Map extracts


def _number(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _signed(n: int) -> bytes:
    return _number((n << 1) ^ (n >> 63))


def _varint(field: int, n: int) -> bytes:
    return _number(field << 3) + _number(n)


def _bytes(field: int, body: bytes) -> bytes:
    return _number(field << 3 | 2) + _number(len(body)) + body


def _steps(values: Iterable[int]) -> bytes:
    last, out = 0, []
    for v in values:
        out.append(_signed(v - last))
        last = v
    return b"".join(out)


def _blob(kind: str, body: bytes) -> bytes:
    content = _varint(2, len(body)) + _bytes(3, zlib.compress(body))
    head = _bytes(1, kind.encode()) + _varint(3, len(content))
    return struct.pack(">I", len(head)) + head + content


class _Strings(dict):
    """Places of strings in a block's table; the first is empty."""

    def __init__(self) -> None:
        super().__init__({"": 0})

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n

    def table(self) -> bytes:
        return _bytes(1, b"".join(_bytes(1, s.encode()) for s in self))


def _tagged(strings: _Strings, tags: dict) -> bytes:
    return _bytes(2, b"".join(_number(strings[k]) for k in tags)) + _bytes(3, b"".join(_number(strings[v]) for v in tags.values())) if tags else b""


def _node_block(rows: list[tuple], dense: bool) -> bytes:
    """Nodes (id, lat, lon) in units of 100 nanodegrees, as a dense group or one by one."""
    near = lambda x: int(round(x * 1e7))
    if dense:
        group = _bytes(
            2,
            _bytes(1, _steps(r[0] for r in rows)) + _bytes(8, _steps(near(r[1]) for r in rows)) + _bytes(9, _steps(near(r[2]) for r in rows)),
        )
    else:
        group = b"".join(_bytes(
            1, _number(1 << 3) + _signed(i) + _number(8 << 3) + _signed(near(a)) + _number(9 << 3) + _signed(near(o)),
        ) for i, a, o in rows)
    return _Strings().table() + _bytes(2, group)


def _way_block(rows: list[tuple]) -> bytes:
    """Ways (id, refs, tags), and a relation of each way's nodes."""
    strings, ways, relations = _Strings(), [], []
    for i, refs, tags in rows:
        ways.append(_bytes(3, _varint(1, i) + _tagged(strings, dict(tags)) + _bytes(8, _steps(refs))))
        relations.append(_bytes(
            4,
            _varint(1, i) + _bytes(8, b"".join(_number(strings["part"]) for _ in refs)) + _bytes(9, _steps(refs)) + _bytes(10, bytes(len(refs))),
        ))
    return strings.table() + _bytes(2, b"".join(ways)) + _bytes(2, b"".join(relations))


def _extract(blocks: Iterable[bytes]) -> bytes:
    header = _bytes(4, b"OsmSchema-V0.6") + _bytes(4, b"DenseNodes")
    return b"".join([_blob("OSMHeader", header), *(_blob("OSMData", b) for b in blocks)])


def _files(df: DataFrame, folder: str, suffix: str, make) -> None:
    """One file of ``make(rows)`` from each partition that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
        if rows:
            store.written(folder, f"part-{TaskContext.get().partitionId():05d}{suffix}", make(rows))
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)])], ["n"])

    df.mapInArrow(run, "n long").agg(F.sum("n")).collect()  # one row: the files are written


def _parts(n: int) -> int:
    """Partitions of files that hold about 50,000 rows."""
    return max(1, -(-n // 50_000))


def extract_files(nodes: DataFrame, ways: DataFrame) -> str:
    """A folder of map extracts: nodes in some files, ways and relations in others."""
    folder = scratch(nodes.sparkSession, "extract")
    cut = lambda rows: [rows[k : k + BLOCK] for k in range(0, len(rows), BLOCK)]
    n, w = nodes.select("node_id", "lat", "lon"), ways.select("way_id", "refs", F.map_entries("tags").alias("tags"))
    plain = lambda rows: [(i, refs, [(t["key"], t["value"]) for t in tags]) for i, refs, tags in rows]
    _files(n.repartition(_parts(n.count()), "node_id"), f"{folder}/nodes", ".pbf", lambda rows: _extract(_node_block(b, k % 2 == 0) for k, b in enumerate(cut(rows))))
    _files(w.repartition(_parts(w.count()), "way_id"), f"{folder}/ways", ".pbf", lambda rows: _extract(_way_block(b) for b in cut(plain(rows))))
    return folder


def load(spark: SparkSession, folder: str, entity: str) -> DataFrame:
    """An entity of all map extracts below a folder."""
    pbf.register(spark)
    return spark.read.format("roadloom_pbf").option("entity", entity).load(folder)


# Graph files


def graph_file(verts: DataFrame, edges: DataFrame, baked: DataFrame) -> str:
    """The path of a graph file."""
    folder = scratch(verts.sparkSession, "graph")
    return store.written(folder, "graph.odrg", odrg.pack(verts, edges, baked))


# Hazard maps


def _gml(rows: list[tuple]) -> bytes:
    """A document of areas (id, south, west, north, east, ring); those of even id have a hole, and an attribute with blanks at its ends."""
    out = ['<r xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:xlink="http://www.w3.org/1999/xlink">']
    curve = lambda name, ring: f"<gml:Curve gml:id={quoteattr(name)}><gml:posList>{' '.join(f'{a!r} {o!r}' for a, o in ring)}</gml:posList></gml:Curve>"
    side = lambda kind, name: f"<gml:{kind}><gml:Ring><gml:curveMember xlink:href={quoteattr('#' + name)}/></gml:Ring></gml:{kind}>"
    for i, south, west, north, east, ring in rows:
        outer = [(p["lat"], p["lon"]) for p in ring] if ring else [(south, west), (south, east), (north, east), (north, west)]
        inner = [(south + (north - south) * a, west + (east - west) * o) for a, o in ((0.1, 0.4), (0.1, 0.5), (0.2, 0.5))]
        hole = i % 2 == 0
        out.append(curve(f"o{i}", outer))
        if hole:
            out.append(curve(f"i{i}", inner))
        out.append(f"<gml:Surface gml:id='s{i}'>{side('exterior', f'o{i}')}{side('interior', f'i{i}') if hole else ''}</gml:Surface>")
        out.append(f"<Zone><bounds xlink:href='#s{i}'/><area>{i}</area><slope>{escape(' steep ' if hole else 'flat')}</slope></Zone>")
    return "".join([*out, "</r>"]).encode()


def gml_files(shapes: DataFrame) -> str:
    """A folder of documents of shapes (area_id, box, outer)."""
    folder = scratch(shapes.sparkSession, "gml")
    rows = shapes.select("area_id", "box.min_lat", "box.min_lon", "box.max_lat", "box.max_lon", "outer")
    _files(rows.repartition(max(1, -(-rows.count() // DOCUMENT)), "area_id"), folder, ".xml", _gml)
    return folder


# Restriction documents


def restriction_files(items: DataFrame) -> str:
    """A folder of restriction documents of items (area_id, item), each a JSON text."""
    folder = scratch(items.sparkSession, "restrictions")
    head = b'{"format":"roadloom-restrictions","version":2,"items":['
    _files(items.repartition(
        max(1, -(-items.count() // DOCUMENT)), "area_id",
    ), folder, ".json", lambda rows: head + ",".join(r[1] for r in rows).encode() + b"]}")
    return folder


__all__ = ["extract_files", "gml_files", "graph_file", "load", "restriction_files"]
