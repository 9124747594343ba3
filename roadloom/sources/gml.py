"""Hazard-map GML: polygons of features, by links from features to surfaces to curves.

A document is parsed as a stream on an executor: only children of the root count, so order and
depth matter, and many documents are read side by side. Document types are refused.
"""

from __future__ import annotations

import xml.parsers.expat as expat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed names.
GML, XLINK = "http://www.opengis.net/gml/3.2", "http://www.w3.org/1999/xlink"
POINTS = "array<struct<lat:double,lon:double>>"
SCHEMA = f"path string, feature_no int, outer {POINTS}, holes array<{POINTS}>, attrs map<string,string>"


class GmlError(ValueError):
    """A document that breaks a rule."""


def positions(text: str) -> list[tuple[float, float]]:
    """(lat, lon) pairs of a position list; at least three."""
    parts = text.split()
    if len(parts) % 2:
        raise GmlError("a position list of odd length")
    try:
        numbers = [float(p) for p in parts]
    except ValueError as e:
        raise GmlError(f"a position list holds no number: {e}") from e
    if len(numbers) < 6:
        raise GmlError("a curve of fewer than three points")
    return list(zip(numbers[::2], numbers[1::2], strict=True))


class _Parser:
    """Collects curves, surfaces and features while the document streams by."""

    def __init__(self) -> None:
        self.depth, self.kind, self.id, self.text = 0, None, None, None
        self.curves: dict[str, list] = {}
        self.surfaces: dict[str, tuple] = {}
        self.features: list[tuple[str, dict]] = []

    def start(self, name: str, attrs: dict) -> None:
        space, _, local = name.rpartition(" ")
        href = attrs.get(f"{XLINK} href", "")
        link = href[1:] if href.startswith("#") else None
        if self.depth == 1:
            self.kind = local if space == GML and local in ("Curve", "Surface") else "feature" if space != GML else "other"
            if space == GML and local == "MultiSurface":
                raise NotImplementedError("multiple surfaces are not read")
            self.id = attrs.get(f"{GML} id")
            if self.kind in ("Curve", "Surface") and not self.id:
                raise GmlError(f"a {local} without id")
            self.points, self.side, self.outer, self.inner = None, None, None, []
            self.link, self.attrs, self.name = link if self.kind == "feature" else None, {}, None
        elif self.depth > 1:
            if self.kind == "Curve" and space == GML and local == "posList":
                self.text = []
            elif self.kind == "Surface" and space == GML:
                if local in ("exterior", "interior"):
                    self.side = local
                elif local == "curveMember" and link:
                    if self.side == "exterior" and self.outer is None:
                        self.outer = link
                    elif self.side == "interior":
                        self.inner.append(link)
            elif self.kind == "feature":
                if link and self.link is None:
                    self.link = link
                if self.depth == 2:
                    self.name, self.text = (None, None) if link else (local, [])
                elif self.name:
                    self.name = self.text = None  # a child with children is no attribute
        self.depth += 1

    def data(self, text: str) -> None:
        if self.text is not None and (self.kind == "Curve" or self.depth == 3):
            self.text.append(text)

    def end(self, name: str) -> None:
        self.depth -= 1
        space, _, local = name.rpartition(" ")
        if self.depth == 1:
            if self.kind == "Curve":
                if self.points is None:
                    raise GmlError(f"curve {self.id} has no position list")
                self.curves[self.id] = self.points
            elif self.kind == "Surface":
                if self.outer is None:
                    raise GmlError(f"surface {self.id} has no exterior")
                self.surfaces[self.id] = (self.outer, self.inner)
            elif self.kind == "feature" and self.link:
                self.features.append((self.link, self.attrs))
        elif self.kind == "Curve" and local == "posList" and self.text is not None:
            self.points, self.text = positions("".join(self.text)), None
        elif self.kind == "Surface" and space == GML and local in ("exterior", "interior"):
            self.side = None
        elif self.kind == "feature" and self.depth == 2 and self.name:
            value = "".join(self.text)
            if value and not value.isspace():
                self.attrs[self.name] = value
            self.name = self.text = None


def parse(text: str | bytes) -> list[tuple[list, list, dict]]:
    """(outer, holes, attributes) of each feature that refers to a surface, in order."""
    own, reader = _Parser(), expat.ParserCreate(namespace_separator=" ")

    def refuse(*_) -> None:
        raise GmlError("a document type is not allowed")

    reader.StartDoctypeDeclHandler, reader.StartElementHandler, reader.EndElementHandler, reader.CharacterDataHandler = refuse, own.start, own.end, own.data
    try:
        reader.Parse(text, True)
    except expat.ExpatError as e:
        raise GmlError(f"not XML: {e}") from e
    out = []
    for link, attrs in own.features:
        if link not in own.surfaces:
            raise GmlError(f"no surface {link}")
        outer, inner = own.surfaces[link]
        for c in (outer, *inner):
            if c not in own.curves:
                raise GmlError(f"no curve {c}")
        out.append((own.curves[outer], [own.curves[c] for c in inner], attrs))
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Features of one or more documents."""
    point = pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = lambda r: [{"lat": a, "lon": o} for a, o in r]
        for b in batches:
            for k in range(b.num_rows):
                rows = parse(b.column(1)[k].as_py())
                n = len(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array([b.column(0)[k].as_py()] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array([ring(r[0]) for r in rows], point),
                    pa.array([[ring(h) for h in r[1]] for r in rows], pa.list_(point)), pa.array(
                        [list(r[2].items()) for r in rows], pa.map_(pa.string(), pa.string()),
                    ),
                ], ["path", "feature_no", "outer", "holes", "attrs"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)
