"""Routing, restrictions, boundaries, profiles: against brute force and by proportion."""

import math
import random

import pytest
from pyspark.sql import functions as F

from roadloom.functions import geo, mesh
from roadloom.functions.profiles import InvalidProfile, Profile, definition, duplicate_names
from roadloom.operators import boundary, extract, restrict, routing, spatial
from roadloom.operators.restrict import Restrictions
from roadloom.plans import fixtures as fx
from roadloom.plans import registry
from roadloom.streaming import restrictions as stream

CAR = Profile.of(definition("car"))


def line(spark, n=6, highway="primary", oneway=None):
    """A straight road of n vertices, 0.01 degrees apart."""
    verts = spark.createDataFrame([(i, 35.0, 136.0 + 0.01 * i) for i in range(n)], "vertex_id long, lat double, lon double")
    tags = {"highway": highway} | ({"oneway": oneway} if oneway else {})
    rows = [(i, i, i + 1, [], tags) for i in range(n - 1)]
    edges = spark.createDataFrame(rows, f"edge_id long, from_id long, to_id long, shape {restrict.POINTS}, tags map<string,string>")
    end = lambda p: verts.select(F.col("vertex_id").alias(f"{p}_id"), F.struct("lat", "lon").alias(p))
    edges = edges.join(end("from"), "from_id").join(end("to"), "to_id").withColumn("line", F.array("from", "to")).withColumn("box", geo.box_of(F.col("line")))
    return verts, edges.withColumn("dist_m", geo.polyline_length(F.col("line")).cast("float")).persist()


def ask(spark, a, b):
    return spark.createDataFrame([(1, 35.0, a, 35.0, b)], "req_id long, from_lat double, from_lon double, to_lat double, to_lon double")


def route(spark, graph, a, b, profile="car", live=None):
    verts, edges = graph
    p = Profile.of(definition(profile))
    f = live.factors(p) if live else None
    got = routing.calculate(ask(spark, a, b), verts, edges, extract.bake(edges, [p]), profile, f).collect()
    return got[0] if got else None


def test_route_on_a_line(spark):
    g = line(spark)
    r = route(spark, g, 136.002, 136.033)
    assert r.dist_m == pytest.approx(0.031 / 0.01 * 910.8, rel=1e-3)
    assert r.dur_s == pytest.approx(r.dist_m / (90 * 0.75 / 3.6), rel=1e-6)
    assert len(r.shape) == 5 and len(r.cum_s) == 5 and r.cum_s[-1] == pytest.approx(r.dur_s) and r.cum_s == sorted(r.cum_s)
    same = route(spark, g, 136.002, 136.004)
    assert len(same.shape) == 2 and same.dist_m < 200
    zero = route(spark, g, 136.002, 136.002)
    assert zero.dist_m == 0 and zero.dur_s == 0
    assert route(spark, g, 136.002, 137.5) is None
    only = line(spark, oneway="yes")
    assert route(spark, only, 136.033, 136.002) is None and route(spark, only, 136.002, 136.033) is not None
    assert route(spark, only, 136.033, 136.002, "pedestrian") is not None


def test_restrictions_scale_durations(spark):
    g = line(spark)
    free = route(spark, g, 136.005, 136.045).dur_s
    live = Restrictions(spark).attach(g[1])
    whole = [(34.9, 135.9), (34.9, 136.2), (35.1, 136.2), (35.1, 135.9)]
    one = live.add_difficulty("Flooding", polygon=whole, tag="w")
    assert route(spark, g, 136.005, 136.045, live=live).dur_s == pytest.approx(free / 0.3, rel=1e-9)
    live.add_difficulty("construction", polygon=whole)
    assert route(spark, g, 136.005, 136.045, live=live).dur_s == pytest.approx(free / 0.06, rel=1e-9)
    live.remove("no such id")
    live.remove_by_tag("w")
    assert route(spark, g, 136.005, 136.045, live=live).dur_s == pytest.approx(free / 0.2, rel=1e-9)
    stop = live.add_block(polygon=[(34.999, 136.024), (34.999, 136.026), (35.001, 136.026), (35.001, 136.024)])
    assert live.blocked().count() == 1 and route(spark, g, 136.005, 136.045, live=live) is None
    live.add_block(polygon=[(34.999, 136.024), (34.999, 136.026), (35.001, 136.026)])
    live.remove(stop)
    assert live.blocked().count() == 1 and one  # the other area still holds it
    live.clear()
    assert live.list_all().count() == 0 and live.found.count() == 0
    with pytest.raises(ValueError):
        live.attach(g[1], "another")
    with pytest.raises(ValueError):
        live.add_difficulty(" ", polygon=whole)
    with pytest.raises(ValueError):
        live.add_block(meshes=[])
    with pytest.raises(ValueError):
        live.add_block(meshes=[53394847])


def test_search_against_brute_force(spark):
    r = random.Random(4)
    n, rows = 12, []
    verts = spark.createDataFrame([(i, 35 + r.random() * 0.1, 136 + r.random() * 0.1) for i in range(n)], "vertex_id long, lat double, lon double")
    for k in range(40):
        a, b = r.randrange(n), r.randrange(n)
        rows.append((k, a, b, [], float(r.randint(50, 900)), r.random() < 0.9, r.random() < 0.7))
    edges = spark.createDataFrame(
        rows, f"edge_id long, from_id long, to_id long, shape {restrict.POINTS}, d double, f boolean, b boolean",
    ).withColumn("dist_m", F.col("d").cast("float"))
    baked = edges.select(
        F.lit("car").alias("profile"), "edge_id", (F.col("f") | F.col("b")).alias("can_pass"), F.lit(36.0).cast("float").alias("speed_kmh"),
        F.col("f").alias("fwd"), F.col("b").alias("bwd"),
    )
    g = routing.collect_network(verts, edges, baked, "car")
    arcs = [(a, b, d / 10) for _, a, b, _, d, f, w in rows for a, b, ok in ((a, b, f), (b, a, w)) if ok]
    for _ in range(60):
        s, t, x, y = r.randrange(40), r.randrange(40), r.random(), r.random()
        ks, kt = rows[s], rows[t]
        if not (ks[5] or ks[6]) or not (kt[5] or kt[6]):
            assert routing.search(g, s, x, t, y) is None
            continue
        cost = [math.inf] * n
        for v, c, ok in ((ks[2], (1 - x) * ks[4] / 10, ks[5]), (ks[1], x * ks[4] / 10, ks[6])):
            if ok:
                cost[v] = min(cost[v], c)
        for _ in range(n):
            for a, b, c in arcs:
                cost[b] = min(cost[b], cost[a] + c)
        ends = [cost[v] + c for v, c, ok in ((kt[1], y * kt[4] / 10, kt[5]), (kt[2], (1 - y) * kt[4] / 10, kt[6])) if ok]
        if s == t and (ks[5] if y > x else ks[6]):
            ends.append(abs(y - x) * ks[4] / 10)
        want = min(ends)
        got = routing.search(g, s, x, t, y)
        assert (got is None) == (want == math.inf) and (got is None or got[0] == pytest.approx(want))
        assert got is None or got[1] == pytest.approx(10 * got[0])
    one = spark.createDataFrame([(3,)], "vertex_id long")
    folder = routing.stored(verts, edges, baked, "car")
    fast = {r.vertex_id: round(r.seconds, 9) for r in routing.reach(folder, one).collect()}
    slow = {r.vertex_id: round(r.seconds, 9) for r in routing.relax(routing.weighted_arcs(edges, baked, "car"), one).collect()}
    assert fast == slow
    ends = [(k, r.randrange(40), r.randrange(65536), 35.0, 136.0, r.randrange(40), r.randrange(65536), 35.1, 136.1) for k in range(80)]
    ends += [(80 + k, k, 100, 35.0, 136.0, k, 100 + 99 * (k % 3), 35.1, 136.1) for k in range(20)]
    snapped = spark.createDataFrame(
        ends, "req_id long, s_edge long, s_offset int, s_lat double, s_lon double, t_edge long, t_offset int, t_lat double, t_lon double",
    )
    shaped = edges.withColumn(
        "shape",
        F.when(
            F.col("edge_id") % 2 == 0,
            F.array(*[F.struct(F.lit(35.02 + k / 50).alias("lat"), F.lit(136.03).alias("lon")) for k in range(2)]),
        ).otherwise(F.col("shape")),
    )
    folder = routing.stored(verts, shaped, baked, "car")
    a = {x.req_id: x for x in routing.routes(snapped, folder).collect()}
    b = {x.req_id: x for x in routing.routes_by_joins(snapped, verts, shaped, baked, "car").collect()}
    assert set(a) == set(b) and len(a) > 50
    for k, x in a.items():
        y = b[k]
        assert x.dur_s == pytest.approx(y.dur_s) and x.dist_m == pytest.approx(y.dist_m) and x.edges == y.edges
        assert x.shape == y.shape and x.cum_s == pytest.approx(y.cum_s)


def test_dense_numbers_over_many_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        n = 1_500_000
        wide = spark.range(n).select(((F.col("id") * 7_919) % n).alias("k"), F.repeat(F.col("id").cast("string"), 6).alias("payload"))
        out = extract.numbered(wide, ["k"], "n")
        assert out.where("n = k").count() == n  # dense from 0, in order
        again = out.select("k", F.col("n").alias("m")).join(out.select("k", "n"), "k")
        assert again.where("n <> m").isEmpty() and again.count() == n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_extracted_graph_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    ways, nodes = extract.road_ways(fx.ways(spark, sf)), fx.nodes(spark, sf)
    verts, edges = extract.graph(ways, nodes)
    place = {r.node_id: (r.lat, r.lon) for r in nodes.collect()}
    uses, lines = {}, [r.refs for r in ways.collect() if len(r.refs) >= 2]
    for refs in lines:
        for k, x in enumerate(refs):
            n, end = uses.get(x, (0, False))
            uses[x] = (n + 1, end or k in (0, len(refs) - 1))
    number = {x: k for k, x in enumerate(sorted(x for x, (n, end) in uses.items() if end or n > 1))}
    want = []
    for refs in lines:
        at = [k for k, x in enumerate(refs) if x in number]
        want += [(number[refs[a]], number[refs[b]], tuple(place[x] for x in refs[a + 1 : b])) for a, b in zip(at, at[1:])]
    got = edges.collect()
    assert sorted((r.from_id, r.to_id, tuple((p.lat, p.lon) for p in r.shape)) for r in got) == sorted(want)
    assert sorted(r.edge_id for r in got) == list(range(len(want)))
    assert {(r.vertex_id, r.osm_id) for r in verts.collect()} == {(k, x) for x, k in number.items()}


def test_boxes_of_all_sizes_meet(spark):
    r = random.Random(6)

    def boxes(n, name):
        rows = []
        for k in range(n):
            size = r.choice([0.0, 0.001, 0.05, 0.4, 3.0, 40.0])
            y, x = r.uniform(-60, 60), r.uniform(-120, 120)
            if r.random() < 0.7:
                y, x = 35 + r.random(), 136 + r.random()
            rows.append((k, (y, x, y + size * r.random(), x + size * r.random())))
        return spark.createDataFrame(rows, f"{name} long, {name}_box struct<min_lat:double,min_lon:double,max_lat:double,max_lon:double>")

    a, b = boxes(150, "a"), boxes(150, "b")
    found = sorted((x.a, x.b) for x in spatial.box_join(a, b, "a_box", "b_box").collect())
    assert found == sorted((x.a, x.b) for x in a.crossJoin(b).where(geo.boxes_meet(F.col("a_box"), F.col("b_box"))).collect()) and len(found) > 100
    assert spatial.box_join(a.limit(0), b, "a_box", "b_box").count() == 0


def test_boundary(spark):
    shape = [(35.05, 135.05 + 0.01 * k) for k in range(10)]

    def one(a, b, points=shape, box=(34.9, 134.95, 35.2, 135.1)):
        df = spark.createDataFrame(
            [(*a, *b, points, [90.0 * k for k in range(len(points))])],
            f"from_lat double, from_lon double, to_lat double, to_lon double, shape {restrict.POINTS}, cum_s array<double>",
        )
        return boundary.crossing(df.withColumn(
            "bounds", F.struct(*[F.lit(v).alias(n) for v, n in zip(box, ("min_lat", "min_lon", "max_lat", "max_lon"))]),
        )).collect()[0]
    r = one(shape[0], shape[-1])
    assert r.kind == "b_outside" and r.lon == pytest.approx(135.1) and r.outside_s == pytest.approx(360.0) and r.outside_m == pytest.approx(4 * 910.2, rel=1e-3)
    r = one(shape[-1], shape[0], shape[::-1])
    assert r.kind == "a_outside" and r.outside_s == pytest.approx(360.0)
    assert one(shape[0], shape[2], shape[:3]).kind == "both_inside" and one(shape[0], shape[2]).kind == "route_error"
    assert one((36.0, 136.0), (37.0, 137.0), [(36.0, 136.0), (37.0, 137.0)]).kind == "both_outside" and one(
        (35.05, 134.0), (35.05, 136.0), [(35.05, 134.0), (35.05, 136.0)],
    ).kind == "route_error"
    assert one(shape[0], shape[-1], []).kind == "route_error" and one(shape[0], shape[-1], box=(35.1, 135, 35, 135.1)).kind == "invalid" and one((float("nan"), 1.0), shape[0]).kind == "invalid"


def evaluate(spark, profile, **tags):
    r = spark.createDataFrame([(tags,)], "tags map<string,string>").select(profile.evaluate(F.col("tags")).alias("e")).collect()[0].e
    return r.can_pass, r.speed_kmh, r.oneway


def test_profiles(spark):
    truck, foot = Profile.resolve("TRUCK"), Profile.resolve("pedestrian")
    assert evaluate(spark, CAR, highway="residential") == (True, 37.5, 0)
    assert evaluate(spark, CAR, highway="footway", motor_vehicle="yes")[0] is False  # the rule's no is final
    assert evaluate(spark, CAR, highway="odd")[0] is False and evaluate(spark, CAR, highway="odd", access="yes")[0] is True
    assert evaluate(spark, CAR, highway="primary", access="no", motor_vehicle="destination")[0] is True  # the last key decides
    assert evaluate(spark, CAR, highway="living_street")[1] == 30 and evaluate(spark, CAR, highway="primary", oneway="-1")[2] == -1
    assert evaluate(spark, foot, highway="primary", oneway="yes")[2] == 0
    assert evaluate(spark, truck, highway="primary", maxheight="3.5 m")[0] is False and evaluate(spark, truck, highway="primary", maxheight="3.8")[0] is True and evaluate(spark, truck, highway="primary", maxweight="7500 kg")[0] is True
    assert CAR.has_difficulty("FLOODING") and not CAR.has_difficulty("") and "ice" in CAR.known_difficulties()
    text = '{"name": "x", // note\n "highway": {"primary": {"speedKmh": 30,},}, "accessValueMap": {}, "fallback": {"speedKmh": 5, "access": "no"}, "speedBounds": {"minKmh": 0, "maxKmh": 99}, "difficultyDefault": {"speedFactor": 1}, }'
    assert evaluate(spark, Profile.parse(text), highway="primary") == (True, 30.0, 0)
    for key, value in (
        ("name", " "), ("highway", {}), ("speedBounds", {"minKmh": 5, "maxKmh": 5}), ("difficultyDefault", {"speedFactor": 2}),
        ("difficulty", {"a": {"speedFactor": 1}, "A": {"speedFactor": 1}}), ("vehicleLimits", {"maxWeightTon": -1}),
    ):
        with pytest.raises(InvalidProfile):
            Profile.of(definition("car") | {key: value})
    with pytest.raises(InvalidProfile):
        Profile.resolve("no such")
    assert duplicate_names(spark.createDataFrame([("a",), ("b",), ("a",)], "name string")).collect()[0].n == 2


def test_mesh_golden(spark):
    df = spark.createDataFrame([(53394611,), (53394547,), (53394847,), (533946113,)], "m long").withColumn("b", mesh.box(F.col("m")))
    a, b, c, d = [r.b for r in df.collect()]
    assert (a.min_lat, a.min_lon) == (
        pytest.approx(35.675), pytest.approx(139.7625),
    ) and (b.min_lat, b.min_lon) == (pytest.approx(35.7), pytest.approx(139.7125)) and c is None
    assert d.min_lat == pytest.approx(35.675 + 1 / 240) and d.min_lon == pytest.approx(139.7625)


def test_tags_and_missing_vertices(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["1", "2", "3"])], "k array<string>, v array<string>")
    assert df.select(extract.tag_map(F.col("k"), F.col("v")).alias("m")).collect()[0].m == {"a": "3", "b": "2"}
    ways = spark.createDataFrame([(1, [5, 6])], "way_id long, refs array<long>")
    nodes = spark.createDataFrame([(5, 1.0, 1.0)], "node_id long, lat double, lon double")
    with pytest.raises(Exception, match="vertex without coordinates"):
        extract.vertices(ways, nodes).collect()


def test_snap_edges(spark):
    _, edges = line(spark)
    p = spark.createDataFrame([(1, 35.001, 136.005), (2, 36.0, 136.0)], "point_id long, lat double, lon double")
    baked = extract.bake(edges, [CAR])
    s = spatial.snap(p, edges, baked, "car").collect()
    assert len(s) == 1 and s[0].edge_id == 0 and abs(s[0].offset - 32768) <= 1 and s[0].dist_m == pytest.approx(111.195, rel=1e-3)
    assert spatial.snap(p, edges, baked, "").count() == 0 and spatial.snap(p, edges, baked, "none").count() == 0 and spatial.snap(p, edges, baked, "car", 0).count() == 0
    assert spatial.nearest_edges(p, edges, 2).groupBy("point_id").count().collect()[0]["count"] == 2
    for some, roads in ((p.limit(0), edges), (p, edges.limit(0))):
        none = spatial.nearest_edges(some, roads, 2)
        assert none.columns == ["point_id", "edge_id", "d2"] and none.count() == 0
    with pytest.raises(Exception, match="without a place"):
        spatial.nearest_edges(spark.createDataFrame([(1, float("nan"), 1.0)], "point_id long, lat double, lon double"), edges, 1).count()
    far = {r.point_id: r.edge_id for r in spatial.snap_anywhere(p, edges, baked, "car").collect()}
    assert far == {1: 0, 2: 0} and spatial.snap_anywhere(p, edges, baked, "none").count() == 0


def test_stream_of_commands(spark):
    schema = "seq long, op string, area_id string, kind string, difficulty_type string, tag string, box struct<min_lat:double,min_lon:double,max_lat:double,max_lon:double>"
    box = (1.0, 1.0, 2.0, 2.0)
    rows = [
        (1, "add", "a", "block", None, "x", box), (2, "add", "b", "block", None, "y", box), (3, "remove", "a", None, None, None, None),
        (4, "add", "c", "block", None, "x", box), (5, "add", "a", "block", None, "z", box), (6, "remove_tag", None, None, None, "x", None),
    ]
    out = stream.apply(spark.createDataFrame([], stream.STATE), spark.createDataFrame(rows, schema))
    assert sorted(r.area_id for r in out.collect()) == ["a", "b"]
    after = stream.apply(out, spark.createDataFrame([(7, "clear", None, None, None, None, None), (8, "add", "d", "block", None, None, box)], schema))
    assert [r.area_id for r in after.collect()] == ["d"]


def test_stream_query(spark, tmp_path):
    schema = "seq long, op string, area_id string, kind string, difficulty_type string, tag string, box struct<min_lat:double,min_lon:double,max_lat:double,max_lon:double>"
    spark.createDataFrame([(1, "add", "a", "block", None, "x", (1.0, 1.0, 2.0, 2.0))], schema).write.parquet(str(tmp_path / "in"))
    seen = []
    q = stream.maintain(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "ck"), lambda df, n: seen.append((n, df.count())))
    q.processAllAvailable()
    q.stop()
    assert seen == [(0, 1)]


def test_every_event_is_an_area(spark):
    sf = "/root/testdata/sf0.001"
    areas, shapes = fx.areas(spark, sf)
    events = [r[0] for r in fx.table(spark, sf, "events").select("event_id").collect()]
    assert sorted(r.area_id for r in areas.collect()) == sorted(r.area_id for r in shapes.collect()) == sorted(events)
    edges = fx.edges(spark, sf).select("edge_id", F.col("line")[0].alias("a"), F.col("line")[1].alias("b"))
    kinds = {r.kind: r.n for r in areas.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == {"block", "difficulty"} and shapes.where("outer is null and box.max_lat - box.min_lat > 0.001").count() > 0  # mesh cells
    pairs = shapes.crossJoin(edges).where(restrict.shape_meets_segment(F.col("box"), F.col("outer"), F.col("holes"), F.col("a"), F.col("b")))
    found = registry.QUERIES["j4_area_edges"](spark, sf)
    rows = lambda df: sorted((r.area_id, r.edge_id) for r in df.select("area_id", "edge_id").collect())
    assert rows(found) == rows(pairs)


def test_a_point_due_north_of_a_vertex_is_equally_far_from_its_edges(spark):
    place = lambda v: (35.05 + v // 40 * 0.002 + v * 37 % 97 * 0.000005, 136.6 + v % 40 * 0.002 + v * 53 % 89 * 0.000005)
    for k, one, other in ((26_997, 1215, 1292), (110_318, 413, 490), (168_042, 1954, 1956)):
        point = (35.05 + k * 7919 % 7400 * 0.00001, 136.6 + k * 104_729 % 7800 * 0.00001)
        ends = [(e // 2, e // 2 + (40 if e % 2 else 1)) for e in (one, other)]
        df = spark.createDataFrame([(*point, *place(a), *place(b)) for a, b in ends], "y double, x double, ay double, ax double, by double, bx double")
        d = [r.d for r in df.select(geo.point_to_segment(*[F.col(c) for c in df.columns])["dist_m"].alias("d")).collect()]
        assert d[0] == d[1]  # so the smaller edge is the nearest, as in the SQL
