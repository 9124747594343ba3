"""File formats from hand-built bytes."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from roadloom.functions import geo
from roadloom.operators import extract
from roadloom.operators.restrict import Restrictions
from roadloom.plans import fixtures as fx
from roadloom.sources import documents, gml, odrg, pbf
from roadloom.sources.wire import WireError, fields, packed, packed_signed, varint


def num(n):
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def zz(n):
    return num((n << 1) ^ (n >> 63))


def val(k, n):
    return num(k << 3) + num(n)


def raw(k, b):
    return num(k << 3 | 2) + num(len(b)) + b


def blob(kind, body, how="zlib"):
    content = raw(1, body) if how == "raw" else val(2, len(body)) + raw(3, zlib.compress(body)) if how == "zlib" else raw(4, body)
    head = raw(1, kind.encode()) + val(3, len(content))
    return struct.pack(">I", len(head)) + head + content


def deltas(values):
    return b"".join(zz(b - a) for a, b in zip([0, *values], values))


STRINGS = raw(1, b"".join(raw(1, s.encode()) for s in ("", "highway", "primary", "residential", "oneway", "yes", "stop")))
IDS, LATS, LONS = [1, 2, 3, 4, 9], [350000000, 350010000, 350020000, 350010000, 380000000], [
    1366000000, 1366010000, 1366020000, 1366030000, 1300000000,
]
DENSE = raw(2, raw(1, deltas(IDS)) + raw(8, deltas(LATS)) + raw(9, deltas(LONS)) + raw(10, bytes([6, 5, 0, 0, 0, 0, 0])))
WAYS = b"".join(raw(3, val(1, i) + raw(2, bytes(k)) + raw(3, bytes(v)) + raw(8, deltas(r))) for i, k, v, r in (
    (10, [1, 4], [2, 5], [1, 2, 3]), (11, [1], [3], [4, 2]), (12, [], [], [1, 4]), (13, [1], [3], [9, 9]),
))
REL = raw(4, val(1, 20) + raw(8, bytes([5, 5])) + raw(9, zz(10) + zz(-8)) + raw(10, bytes([1, 0])))
HEAD = raw(1, val(1, 0) + b"") + raw(4, b"OsmSchema-V0.6") + raw(4, b"DenseNodes")
FILE = blob("OSMHeader", HEAD, "raw") + blob("OSMData", STRINGS + raw(2, DENSE)) + blob("Other", b"x", "raw") + blob(
    "OSMData", STRINGS + raw(2, WAYS) + raw(2, REL),
)


@pytest.fixture()
def extract_file(tmp_path):
    f = tmp_path / "x.pbf"
    f.write_bytes(FILE)
    return str(f)


def test_wire():
    assert varint(num(300), 0) == (300, 2)
    assert packed(num(1) + num(300) + num(2**64 - 1)).tolist() == [1, 300, 2**64 - 1]
    assert packed_signed(zz(-3) + zz(5)).tolist() == [-3, 5]
    for bad in (b"\x80", b"\xff" * 11, num(1 << 3 | 3), raw(1, b"abc")[:-1]):
        with pytest.raises(WireError):
            list(fields(bad) if bad[0] != 0xFF else [varint(bad, 0)])


def test_pbf_source(spark, extract_file):
    pbf.register(spark)
    load = lambda e, **o: spark.read.format("roadloom_pbf").options(entity=e, **o).load(extract_file)
    nodes = {r.id: r for r in load("node", run_bytes=1).collect()}
    assert sorted(nodes) == IDS and nodes[2].lat == pytest.approx(35.001) and nodes[1].tags == {"stop": "yes"} and nodes[2].tags == {}
    ways = {r.id: r for r in load("way").collect()}
    assert ways[10].refs == [1, 2, 3] and ways[10].tags == {"highway": "primary", "oneway": "yes"}
    rel = load("relation").collect()[0]
    assert [tuple(m) for m in rel.members] == [(10, "way", "yes"), (2, "node", "yes")]
    assert pbf.read_header(extract_file).required == ["OsmSchema-V0.6", "DenseNodes"]


@pytest.mark.parametrize("data", [b"\0\0", FILE[:-3], blob("OSMData", STRINGS), FILE + blob("OSMHeader", HEAD), blob("OSMHeader", raw(4, b"Other"))])
def test_pbf_errors(tmp_path, data):
    f = tmp_path / "bad.pbf"
    f.write_bytes(data)
    with pytest.raises(pbf.PbfError):
        pbf.read_header(str(f))


def test_pbf_block_errors():
    with pytest.raises(NotImplementedError):
        pbf.inflate(raw(4, b"z"))
    with pytest.raises(pbf.PbfError):
        pbf.inflate(val(2, 9) + raw(3, zlib.compress(b"x")))
    with pytest.raises(pbf.PbfError):
        list(pbf.block(STRINGS + val(17, 0), "node"))


def test_extract_to_file_and_back(spark, extract_file, tmp_path):
    from roadloom import cli

    out = str(tmp_path / "g.odrg")
    assert cli.main(["extract", "--input", extract_file, "--output", out, "--bbox", "136,34.5,137,36", "--profiles", "car,pedestrian"]) == 0
    f = odrg.parse((tmp_path / "g.odrg").read_bytes())
    assert len(f.vertices) == 4 and len(f.edges) == 3 and set(f.baked) == {"car", "pedestrian"}  # way 12 is no road, 13 is outside
    assert f.requested == (136, 34.5, 137, 36) and json.loads(f.metadata)["edgeCount"] == 3
    edges = odrg.read(spark, out, "edge").collect()
    assert sorted(r.flags for r in edges) == [0, 4096, 4096]
    assert odrg.read(spark, out, "baked").where("profile = 'car' and bwd").count() == 1
    assert cli.main(["patch-bbox", "--target", out, "--bbox", "1,2,3,4"]) == 0
    assert odrg.parse((tmp_path / "g.odrg").read_bytes()).requested == (1, 2, 3, 4)
    assert cli.main(["extract", "--input", "x", "--output", "y", "--bbox", "3,2,1,4"]) == 2
    assert cli.main(["patch-bbox", "--target", str(tmp_path / "none")]) in (0, 3)


def test_graph_file_round_trip(spark):
    sf = "/root/testdata/sf0.001"
    edges = fx.edges(spark, sf).withColumn("flags", extract.edge_flags(F.col("tags")))
    verts = fx.vertices(spark, sf)
    data = odrg.pack(verts, edges, fx.baked(spark, sf, "car", "truck"))
    f = odrg.parse(data)
    boxes = {tuple(b) for b in f.boxes.tolist()}
    want = {(r.box.min_lon, r.box.min_lat, r.box.max_lon, r.box.max_lat) for r in edges.select("box").collect()}
    assert boxes == want and len(f.edges) == edges.count()
    seen, todo = [], [int(f.tree_head[1])]
    while todo:  # every edge is in one leaf; every box covers its children
        node = f.tree[todo.pop()]
        for k in range(int(node["first"]), int(node["first"] + node["count"])):
            child = f.boxes[k] if node["flags"] & 1 else f.tree[k]["box"]
            assert node["box"]["min_lon"] <= child["min_lon"] and node["box"]["max_lat"] >= child["max_lat"]
            (seen if node["flags"] & 1 else todo).append(k)
    assert sorted(seen) == list(range(len(f.edges)))
    for at, value in ((0, b"X"), (8, b"\x09"), (68, b"\x03"), (80, b"\x08")):
        with pytest.raises(odrg.OdrgError):
            odrg.parse(data[:at] + value + data[at + 1 :])
    with pytest.raises(odrg.OdrgError):
        odrg.parse(data[:300])


GML = """<r xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:xlink="http://www.w3.org/1999/xlink">
<gml:Curve gml:id="c1"><gml:segments><gml:posList>35.0 136.0 35.0 136.2 35.2 136.2 35.0 136.0</gml:posList></gml:segments></gml:Curve>
<gml:Curve gml:id="c2"><gml:posList>35.01 136.1 35.02 136.1 35.02 136.12</gml:posList></gml:Curve>
<gml:Surface gml:id="s1"><gml:exterior><gml:Ring><gml:curveMember xlink:href="#c1"/></gml:Ring></gml:exterior>
<gml:interior><gml:Ring><gml:curveMember xlink:href="#c2"/></gml:Ring></gml:interior></gml:Surface>
<Zone><bounds xlink:href="#s1"/><rank>3</rank><rank>4</rank><deep><x>1</x></deep><none/></Zone><Other><a>1</a></Other></r>"""


def test_gml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(GML)
    r = gml.read(spark, str(tmp_path / "a.xml")).collect()
    assert len(r) == 1 and len(r[0].outer) == 4 and len(r[0].holes) == 1 and r[0].attrs == {"rank": "4"}
    assert gml.parse(GML.replace("<rank>4<", "<rank> 4 <"))[0][2] == {"rank": " 4 "}  # values are kept as they are
    for bad in (GML.replace("#c2", "#c9"), GML.replace("#s1", "#s9"), GML.replace("35.01 ", ""), "<r>", "<!DOCTYPE r><r/>"):
        with pytest.raises(gml.GmlError):
            gml.parse(bad)
    with pytest.raises(NotImplementedError):
        gml.parse(GML.replace("<Other>", "<gml:MultiSurface/><Other>"))
    live = Restrictions(spark)
    documents.add_gml(live, gml.read(spark, str(tmp_path / "a.xml")), "difficulty", "flooding", "t", geo.normal_bounds(34, 135, 35.05, 136.3))
    assert live.list_all().count() == 1
    documents.add_gml(live, gml.read(spark, str(tmp_path / "a.xml")), "block", bounds=geo.normal_bounds(1, 1, 2, 2))
    assert live.list_all().count() == 1


def test_restriction_documents(spark):
    live = Restrictions(spark)
    live.add_block(polygon=[(35, 136), (35, 137), (36, 137)], tag="a", holes=[[(35.1, 136.5), (35.2, 136.5), (35.2, 136.6)]])
    live.add_difficulty("snow", meshes=[53394611, 533946113])
    text = documents.save_restrictions(live)
    doc = json.loads(text)
    assert {i["kind"] for i in doc["items"]} == {"block", "difficulty"} and [i["meshCodes"] for i in doc["items"] if "meshCodes" in i] == [[53394611, 533946113]]
    again = Restrictions(spark)
    assert documents.load_restrictions(again, text) == 2 and again.shapes.count() == 3
    assert again.shapes.where("size(holes) = 1").count() == 1
    assert "holes" not in documents.save_restrictions(live, version=1)
    for bad in (
        "{", "{}", '{"format":"a-restrictions","version":3}',
        '{"format":"a-restrictions","version":1,"items":[{"kind":"block","shapeType":"polygon"}]}',
        '{"format":"a-restrictions","version":1,"items":[{"kind":"difficulty","shapeType":"mesh","meshCodes":[1]}]}',
    ):
        with pytest.raises(documents.DocumentError):
            documents.load_restrictions(again, bad)
    assert again.list_all().count() == 2
    assert json.loads(documents.collection(documents.area_features(live.areas, live.shapes)))["type"] == "FeatureCollection"
    with pytest.raises(ValueError):
        documents.mesh_features(spark, (30, 130, 40, 140), 3)
    assert documents.mesh_features(spark, (35.675, 139.7625, 35.6833, 139.775), 3).collect()[0].mesh == 53394611


def test_map_box(tmp_path):
    f = tmp_path / "m.map.json"
    f.write_text('{"NW": {"Latitude": 36, "Longitude": 136}, "SE": {"Latitude": 35, "Longitude": 137}}')
    assert documents.map_box(str(f)) == (35, 136, 36, 137)
    f.write_text("{}")
    assert documents.map_box(str(f)) is None
