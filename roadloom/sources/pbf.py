"""Map extracts in the blocked protobuf format, as a Spark data source.

``spark.read.format("roadloom_pbf").option("entity", "node" | "way" | "relation").load(path)``.
A path is a file or a folder of ``.pbf`` files, in any store that Arrow knows.
The driver walks the block headers only; every input partition is a run of a file's blocks, read and
decoded on an executor. Kinds that aren't asked for are skipped undecoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from roadloom.sources import store
from roadloom.sources.wire import WireError, fields, packed, packed_signed, signed, varint, zigzag

#: Fixed limits and features of the format.
MAX_HEADER, MAX_BLOB = 64 * 1024, 32 * 1024 * 1024
FEATURES = {"OsmSchema-V0.6", "DenseNodes"}
SCHEMAS = {
    "node": "id long, lat double, lon double, tags map<string,string>",
    "way": "id long, refs array<long>, tags map<string,string>",
    "relation": "id long, members array<struct<member_id:long,type:string,role:string>>, tags map<string,string>",
}
_MEMBER = ("node", "way", "relation")


class PbfError(ValueError):
    """A file that breaks the format."""


def frames(f) -> Iterator[tuple[str, int, int]]:
    """(type, offset, length) of each block's body, reading headers only."""
    f.seek(0, 2)
    whole, at = f.tell(), 0
    f.seek(0)
    while True:
        raw = f.read(4)
        if not raw:
            return
        if len(raw) < 4:
            raise PbfError("the file ends in a block's size")
        size = int.from_bytes(raw, "big")
        if size > MAX_HEADER:
            raise PbfError(f"a block header of {size} bytes")
        header = f.read(size)
        if len(header) < size:
            raise PbfError("the file ends in a block header")
        kind, body = None, None
        for k, v in fields(header):
            if k == 1:
                kind = v.decode()
            elif k == 3:
                body = v
        if kind is None or body is None:
            raise PbfError("a block header without type or size")
        if not 0 <= body <= MAX_BLOB:
            raise PbfError(f"a block of {body} bytes")
        at += 4 + size
        if at + body > whole:
            raise PbfError("the file ends in a block")
        yield kind, at, body
        at += body
        f.seek(at)


def inflate(blob: bytes) -> bytes:
    """The content of a block: stored or zlib."""
    raw = size = packed_ = None
    for k, v in fields(blob):
        if k == 1:
            raw = v
        elif k == 2:
            size = v
        elif k == 3:
            packed_ = v
        elif k in (4, 5, 6, 7):
            raise NotImplementedError("only stored and zlib blocks are read")
    if packed_ is not None:
        try:
            out = zlib.decompress(packed_)
        except zlib.error as e:
            raise PbfError(f"a zlib block is damaged: {e}") from e
        if size is None or len(out) != size:
            raise PbfError("a block's size isn't what it says")
        return out
    if raw is None:
        raise PbfError("an empty block")
    if size is not None and size != len(raw):
        raise PbfError("a block's size isn't what it says")
    return raw


@dataclass
class Header:
    """A file's header block."""

    bbox: tuple[float, float, float, float] | None  # left, right, top, bottom in degrees
    required: list[str]
    program: str | None

    @classmethod
    def of(cls, data: bytes) -> Header:
        out = cls(None, [], None)
        for k, v in fields(data):
            if k == 1:
                box = {n: zigzag(x) * 1e-9 for n, x in fields(v)}
                out.bbox = tuple(box.get(n, 0.0) for n in (1, 2, 3, 4))
            elif k == 4:
                out.required.append(v.decode())
            elif k == 16:
                out.program = v.decode()
        if unknown := [f for f in out.required if f not in FEATURES]:
            raise PbfError(f"required features not known: {unknown}")
        return out


def _index(path: str) -> tuple[Header, list[tuple[int, int]]]:
    blocks, header = [], None
    with store.opened(path) as f:
        for k, (kind, at, size) in enumerate(frames(f)):
            if kind == "OSMHeader":
                if k:
                    raise PbfError("a second header")
                f.seek(at)
                header = Header.of(inflate(f.read(size)))
                f.seek(at)
            elif not k:
                raise PbfError("the first block is no header")
            elif kind == "OSMData":
                blocks.append((at, size))
    if header is None:
        raise PbfError("no header")
    return header, blocks


def _tags(keys, values, strings: list[str]) -> dict:
    if len(keys) != len(values):
        raise PbfError("keys and values differ in number")
    return {strings[int(k)]: strings[int(v)] for k, v in zip(keys, values, strict=True)}  # of equal keys the last wins


def _numbers(v) -> np.ndarray:
    return packed(v) if isinstance(v, bytes) else np.array([v], np.uint64)


def block(data: bytes, entity: str) -> Iterator[tuple]:
    """Rows of one kind in a data block."""
    table, groups, step, off_lat, off_lon = None, [], 100, 0, 0
    for k, v in fields(data):
        if k == 1:
            table = [s.decode("utf-8", "replace") for n, s in fields(v) if n == 1]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            step = signed(v & 0xFFFFFFFF, 32)
        elif k == 19:
            off_lat = signed(v)
        elif k == 20:
            off_lon = signed(v)
    if table is None:
        raise PbfError("a block without string table")
    if step <= 0:
        raise PbfError(f"granularity {step}")
    degrees = lambda x, off: 1e-9 * (off + step * x)
    for g in groups:
        for k, v in fields(g):
            if k == 1 and entity == "node":
                yield _node(v, table, lambda x: degrees(x, off_lat), lambda x: degrees(x, off_lon))
            elif k == 2 and entity == "node":
                yield from _dense(v, table, lambda x: degrees(x, off_lat), lambda x: degrees(x, off_lon))
            elif k == 3 and entity == "way":
                yield _way(v, table)
            elif k == 4 and entity == "relation":
                yield _relation(v, table)


def _node(data: bytes, strings, lat_of, lon_of) -> tuple:
    key = lat = lon = None
    keys, values = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for k, v in fields(data):
        if k == 1:
            key = zigzag(v)
        elif k == 2:
            keys = np.append(keys, _numbers(v))
        elif k == 3:
            values = np.append(values, _numbers(v))
        elif k == 8:
            lat = zigzag(v)
        elif k == 9:
            lon = zigzag(v)
    if key is None or lat is None or lon is None:
        raise PbfError("a node without id or place")
    return key, lat_of(lat), lon_of(lon), _tags(keys, values, strings)


def _dense(data: bytes, strings, lat_of, lon_of) -> Iterator[tuple]:
    part = {k: v for k, v in fields(data)}
    ids, lats, lons = (np.cumsum(packed_signed(part.get(k, b""))) for k in (1, 8, 9))
    if not len(ids) == len(lats) == len(lons):
        raise PbfError("dense nodes of unequal columns")
    marks = packed(part.get(10, b"")).astype(np.int64)
    tags: list[dict] = []
    if len(marks):
        if (marks == 0).sum() < len(ids):
            raise PbfError("dense tags are cut")
        at = 0
        for end in np.flatnonzero(marks == 0)[: len(ids)].tolist():
            # keys and values take turns; a zero where a key is due ends a node
            run = marks[at:end].tolist()
            tags.append(_tags(run[::2], run[1::2], strings))
            at = end + 1
    for k, (i, a, o) in enumerate(zip(ids.tolist(), lats.tolist(), lons.tolist(), strict=True)):
        yield i, lat_of(a), lon_of(o), tags[k] if tags else {}


def _way(data: bytes, strings) -> tuple:
    key, keys, values, refs = None, np.zeros(0, np.uint64), np.zeros(0, np.uint64), b""
    for k, v in fields(data):
        if k == 1:
            key = signed(v)
        elif k == 2:
            keys = np.append(keys, _numbers(v))
        elif k == 3:
            values = np.append(values, _numbers(v))
        elif k == 8:
            refs = v
    if key is None:
        raise PbfError("a way without id")
    return key, np.cumsum(packed_signed(refs)).tolist(), _tags(keys, values, strings)


def _relation(data: bytes, strings) -> tuple:
    key, keys, values = None, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    roles, members, kinds = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for k, v in fields(data):
        if k == 1:
            key = signed(v)
        elif k == 2:
            keys = np.append(keys, _numbers(v))
        elif k == 3:
            values = np.append(values, _numbers(v))
        elif k == 8:
            roles = _numbers(v)
        elif k == 9:
            members = np.cumsum(packed_signed(v))
        elif k == 10:
            kinds = _numbers(v)
    if key is None:
        raise PbfError("a relation without id")
    if not len(roles) == len(members) == len(kinds):
        raise PbfError("members of unequal columns")
    if len(kinds) and kinds.max() > 2:
        raise PbfError("a member of unknown type")
    return key, [(int(m), _MEMBER[int(t)], strings[int(r)]) for m, t, r in zip(members, kinds, roles, strict=True)], _tags(keys, values, strings)


@dataclass
class _Run(InputPartition):
    path: str
    blocks: list


class _Reader(DataSourceReader):
    def __init__(self, path: str, entity: str, run_bytes: int) -> None:
        self.path, self.entity, self.run_bytes = path, entity, run_bytes

    def partitions(self):
        runs = []
        for path in store.listed(self.path, ".pbf"):
            size = self.run_bytes + 1
            for b in _index(path)[1]:
                if size > self.run_bytes:
                    runs.append(_Run(path, []))
                    size = 0
                runs[-1].blocks.append(b)
                size += b[1]
        return runs or [_Run("", [])]

    def read(self, partition):
        if not partition.blocks:
            return
        with store.opened(partition.path) as f:
            for at, size in partition.blocks:
                f.seek(at)
                yield from block(inflate(f.read(size)), self.entity)


class PbfSource(DataSource):
    """The data source ``roadloom_pbf``. Options: entity (node), run_bytes of a partition (32 MiB)."""

    @classmethod
    def name(cls) -> str:
        return "roadloom_pbf"

    def schema(self) -> str:
        entity = self.options.get("entity", "node")
        if entity not in SCHEMAS:
            raise ValueError(f"no such entity: {entity}")
        return SCHEMAS[entity]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("entity", "node"), int(self.options.get("run_bytes", 32 << 20)))


def read_header(path: str) -> Header:
    """The header of a file."""
    return _index(path)[0]


def register(spark: SparkSession) -> None:
    """Makes the source known to a session."""
    spark.dataSource.register(PbfSource)


__all__ = ["Header", "PbfError", "PbfSource", "WireError", "block", "frames", "inflate", "read_header", "register", "varint"]
