"""From map nodes and ways to a routable graph, as one DataFrame plan.

nodes: (node_id, lat, lon); ways: (way_id, refs array<long>, tags map). The graph has vertices
(vertex_id, osm_id, lat, lon) and edges (edge_id, way_id, from_id, to_id, shape array of
points, tags, box, flags, dist_m float).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import geo
from roadloom.functions.profiles import Profile, StagedReader
from roadloom.operators.lineage import landed

#: Edges of a leaf of the packed order.
LEAF = 16


def tag_map(keys: Column, values: Column) -> Column:
    """A map of parallel arrays in which the last of equal keys wins."""
    both = F.arrays_zip(keys.alias("k"), values.alias("v"))
    names = F.transform(both, lambda x: x["k"])
    last = F.filter(both, lambda x, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), x["k"]))
    return F.map_from_entries(last)


def nodes_in(nodes: DataFrame, box: Column) -> DataFrame:
    """Nodes in a box, its edge included."""
    return nodes.where(geo.in_box(F.col("lat"), F.col("lon"), box))


def is_road(tags: Column) -> Column:
    """Whether a way is a road: tagged highway, not access=no, not area=yes."""
    get = lambda k: F.element_at(tags, F.lit(k))
    return get("highway").isNotNull() & (F.coalesce(get("access"), F.lit("")) != "no") & (F.coalesce(get("area"), F.lit("")) != "yes")


def road_ways(ways: DataFrame) -> DataFrame:
    """Ways that are roads."""
    return ways.where(is_road(F.col("tags")))


def ways_touching(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways any of whose refs is among ``nodes``."""
    hit = ways.select("way_id", F.explode("refs").alias("node_id")).join(nodes.select("node_id"), "node_id", "left_semi").select("way_id").distinct()
    return ways.join(hit, "way_id", "left_semi")


def needed_nodes(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Nodes that some way refers to."""
    return nodes.join(ways.select(F.explode("refs").alias("node_id")), "node_id", "left_semi")


def node_usage(ways: DataFrame) -> DataFrame:
    """(node_id, uses, is_end) over ways of two refs at least; repeats in a way count."""
    some = ways.where(F.size("refs") >= 2).select(F.size("refs").alias("n"), F.posexplode("refs").alias("pos", "node_id"))
    return some.groupBy("node_id").agg(F.count("*").alias("uses"), F.max((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1)).alias("is_end"))


def vertex_nodes(ways: DataFrame) -> DataFrame:
    """Nodes that become vertices: ends of ways, and nodes used twice."""
    return node_usage(ways).where("is_end or uses >= 2").select("node_id")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with dense numbers from 0 by unique ``order`` columns.

    Rows are dealt by range and sorted, and land once with their partition and place; counts and
    numbers are both read from that table, so that every use agrees. A partition's offset is
    the running count of those before it: no task holds all rows.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = landed(dealt, "numbered")
    part = F.shiftrightunsigned("__at", 33).alias("__p")  # the number's upper bits are the partition
    counts = rows.groupBy(part).agg(F.count("*").alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = counts.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn(name, F.col("__o") + place).drop("__p", "__at", "__o")


def _sure(lat: Column) -> Column:
    """A vertex's latitude, or an error where it has none."""
    missing = F.raise_error(F.concat(F.lit("vertex without coordinates: "), F.col("node_id").cast("string")))
    return F.when(lat.isNotNull(), lat).otherwise(missing.cast("double"))


def vertices(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(vertex_id, osm_id, lat, lon): vertices numbered by node id; a vertex without a node is an error."""
    wanted = vertex_nodes(ways).join(nodes.select("node_id", "lat", "lon"), "node_id", "left")
    known = wanted.withColumn("lat", _sure(F.col("lat")))
    return numbered(known, ["node_id"], "vertex_id").select("vertex_id", F.col("node_id").alias("osm_id"), "lat", "lon")


def split_ways(ways: DataFrame, verts: DataFrame) -> DataFrame:
    """(way_id, part, from_osm, to_osm, shape_refs): ways cut at vertices.

    Refs before a way's first vertex and after its last are dropped.
    """
    refs = ways.where(F.size("refs") >= 2).select("way_id", F.posexplode("refs").alias("pos", "node_id"))
    marked = refs.join(verts.select(F.col("osm_id").alias("node_id"), F.lit(True).alias("v")), "node_id", "left")
    along = Window.partitionBy("way_id").orderBy("pos")
    part = F.sum(F.when(F.col("v"), 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, 0))
    upto = marked.withColumn("part", part).where("part > 0")
    grouped = upto.groupBy("way_id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("run"))
    after = F.lead(F.get("run", F.lit(0))["node_id"]).over(Window.partitionBy("way_id").orderBy("part"))
    edges = grouped.withColumn("to_osm", after).where("to_osm is not null")
    shape = F.transform(F.slice("run", 2, F.greatest(F.size("run") - 1, F.lit(0))), lambda x: x["node_id"])
    return edges.select("way_id", "part", F.get("run", F.lit(0))["node_id"].alias("from_osm"), "to_osm", shape.alias("shape_refs"))


def with_shapes(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``parts`` with the array ``shape`` of interior points."""
    at = parts.select("way_id", "part", F.posexplode("shape_refs").alias("pos", "node_id")).join(nodes.select("node_id", "lat", "lon"), "node_id")
    shapes = at.groupBy("way_id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("s"))
    points = F.transform("s", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))
    none = F.array().cast("array<struct<lat:double,lon:double>>")
    return parts.join(shapes, ["way_id", "part"], "left").withColumn("shape", F.coalesce(points, none)).drop("s")


def edge_flags(tags: Column) -> Column:
    """The flag bits of a tag map: bridge 1, tunnel 2, elevated 4, roundabout 8, toll 16, private 32, service 64, track 128,
    living street 256, sidewalk 512, closed in winter 1024, oneway forward 4096, backward 8192."""
    get = lambda k: F.element_at(tags, F.lit(k))
    some = lambda c: F.coalesce(c, F.lit(False))
    layer = F.when(get("layer").rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(get("layer")).try_cast("int"))
    round_ = some(get("junction") == "roundabout")
    bits = (
        (1, some(get("bridge") != "no")), (2, some(get("tunnel") != "no")), (
            4, some(get("bridge") == "viaduct") | some(layer >= 1),
        ), (8, round_), (16, some(get("toll") == "yes")),
        (32, some(get("access") == "private")), (64, some(get("highway") == "service")), (128, some(get("highway") == "track")), (
            256, some(get("highway") == "living_street"),
        ),
        (512, some(get("sidewalk").isin("yes", "both"))), (1024, some(get("seasonal") == "winter") | some(get("winter_road") == "no")),
        (4096, some(get("oneway") == "yes") | (round_ & get("oneway").isNull())), (8192, some(get("oneway") == "-1")),
    )
    out = F.lit(0)
    for bit, on in bits:
        out = out + F.when(on, bit).otherwise(0)
    return out.cast("int")


def packed_order(edges: DataFrame, key: str = "edge_key", leaf: int = LEAF) -> DataFrame:
    """``edges`` with strip and rank in it: sorted by box centre, first by longitude into strips, then by latitude.

    Ranks across all edges come from :func:`numbered`; a strip holds about the square root of all leaves.
    """
    n = edges.count()
    leaves = max(1, -(-n // leaf))
    strips = max(1, int(-(-(leaves**0.5) // 1)))
    size = max(leaf, -(-n // strips))
    centred = edges.withColumn(
        "__x", (F.col("box.min_lon") + F.col("box.max_lon")) * 0.5,
    ).withColumn("__y", (F.col("box.min_lat") + F.col("box.max_lat")) * 0.5)
    ranked = numbered(centred, ["__x", key], "__rx").withColumn("strip", F.floor(F.col("__rx") / F.lit(float(size))))
    rank = F.row_number().over(Window.partitionBy("strip").orderBy("__y", key))
    return ranked.withColumn("rank", rank - 1).withColumn("leaf", F.floor(F.col("rank") / float(leaf))).drop("__x", "__y", "__rx")


def renumbered(edges: DataFrame, key: str = "edge_key", leaf: int = LEAF) -> DataFrame:
    """``edges`` with ``edge_id`` in packed order, so that neighbours in space lie together in files."""
    return numbered(packed_order(edges, key, leaf), ["strip", "rank"], "edge_id").drop("strip", "rank", "leaf", key)


def full_line(from_: Column, shape: Column, to: Column) -> Column:
    """All points of an edge."""
    return F.concat(F.array(from_), shape, F.array(to))


def graph(ways: DataFrame, nodes: DataFrame, renumber: bool = True) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of road ways and their nodes.

    Ways land once. Their refs then meet vertices and nodes in one shuffle by node, and are cut and
    gathered in one more by way; an edge's ends and interior points come out of its run of refs.
    Interior refs without a node are left out.
    """
    ways = landed(ways.where(F.size("refs") >= 2).select("way_id", "refs", "tags"), "road-ways")
    verts = vertices(ways, nodes)
    places = nodes.select("node_id", F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon"))
    ends = verts.select(F.col("osm_id").alias("node_id"), "vertex_id")
    refs = ways.select("way_id", F.posexplode("refs").alias("pos", "node_id")).join(places, "node_id", "left").join(ends, "node_id", "left")
    along = Window.partitionBy("way_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    cut_at = refs.withColumn("part", F.count("vertex_id").over(along)).where("part > 0")
    point = F.struct("pos", "vertex_id", F.col("n_lat").alias("lat"), F.col("n_lon").alias("lon"))
    runs = cut_at.groupBy("way_id", "part").agg(F.array_sort(F.collect_list(point)).alias("run"))
    last = F.lead(F.get("run", F.lit(0))).over(Window.partitionBy("way_id").orderBy("part"))
    runs = runs.withColumn("last", last).where("last is not null").join(ways.select("way_id", "tags"), "way_id")
    place = lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))
    interior = F.filter(F.slice("run", 2, F.size("run")), lambda p: p["lat"].isNotNull())
    first = F.get("run", F.lit(0))
    edges = runs.select(
        F.struct("way_id", "part").alias("edge_key"), "way_id", first["vertex_id"].alias("from_id"), F.col("last.vertex_id").alias("to_id"),
        F.transform(interior, place).alias("shape"), "tags", place(first).alias("from_point"), place(F.col("last")).alias("to_point"),
    )
    edges = edges.withColumn("line", full_line(F.col("from_point"), F.col("shape"), F.col("to_point")))
    edges = edges.select(
        "edge_key", "way_id", "from_id", "to_id", "shape", "tags",
        geo.box_of(F.col("line")).alias("box"), edge_flags(F.col("tags")).alias("flags"), geo.polyline_length(F.col("line")).cast("float").alias("dist_m"),
    )
    edges = landed(edges, "edges")
    return verts, renumbered(edges) if renumber else edges


def bake(edges: DataFrame, profiles: list[Profile], key: str = "edge_id") -> DataFrame:
    """(profile, edge, can_pass, speed_kmh, fwd, bwd) of every profile and edge.

    The profiles are a fixed, short list: each edge gives an array of their entries. Tags are looked up and parsed
    in a projection of their own, and access in a second, so that no nested condition repeats them.
    """
    read = StagedReader(F.col("tags"))
    can = {f"can {k}": p.can_pass(read) for k, p in enumerate(profiles)}
    rest = [(p.name, p.speed_kmh(read), p.direction(read)) for p in profiles]
    staged = edges.select(
        key, *[made.alias(name) for name, made in read.stage.items()],
    ).select("*", *[made.alias(name) for name, made in can.items()])

    def entry(k: int) -> Column:
        name, speed, way = rest[k]
        open_ = F.col(f"`can {k}`")
        speed = F.when(open_, speed).otherwise(0.0).cast("float")
        return F.struct(
            F.lit(name).alias("profile"), open_.alias("can_pass"), speed.alias("speed_kmh"), (open_ & (way >= 0)).alias("fwd"),
            (open_ & (way <= 0)).alias("bwd"),
        )

    every = staged.select(key, F.explode(F.array(*map(entry, range(len(profiles))))).alias("x"))
    return every.select("x.profile", key, "x.can_pass", "x.speed_kmh", "x.fwd", "x.bwd")


def graph_bounds(verts: DataFrame, requested: tuple[float, float, float, float] | None = None) -> DataFrame:
    """One row: the vertices' box, or the requested one if there are none."""
    spare = requested or (None,) * 4
    names = ("min_lat", "min_lon", "max_lat", "max_lon")
    aggs = [f(c) for f, c in ((F.min, "lat"), (F.min, "lon"), (F.max, "lat"), (F.max, "lon"))]
    return verts.agg(*[F.coalesce(a, F.lit(s).cast("double")).alias(n) for a, s, n in zip(aggs, spare, names, strict=True)])


def statistics(verts: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts of vertices and edges, and the box."""
    n = edges.agg(F.count("*").alias("edge_count"))
    return graph_bounds(verts).join(verts.agg(F.count("*").alias("vertex_count")), how="cross").join(n, how="cross")  # one row each


def arcs(edges: DataFrame) -> DataFrame:
    """(src, dst, edge_id, reversed): each edge forward, and backward unless it is a loop."""
    forward = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "edge_id", F.lit(False).alias("reversed"))
    back = edges.where("from_id <> to_id").select(
        F.col("to_id").alias("src"), F.col("from_id").alias("dst"), "edge_id", F.lit(True).alias("reversed"),
    )
    return forward.unionByName(back)


def out_degrees(edges: DataFrame, verts: DataFrame) -> DataFrame:
    """(vertex_id, degree, first_out): arcs that leave each vertex, and how many leave all before it."""
    counts = verts.select("vertex_id").join(
        arcs(edges).groupBy(F.col("src").alias("vertex_id")).count(), "vertex_id", "left",
    ).select("vertex_id", F.coalesce("count", F.lit(0)).alias("degree"))
    part = counts.withColumn("lot", F.floor(F.col("vertex_id") / 65_536.0))
    lots = part.groupBy("lot").agg(F.sum("degree").alias("s"))
    before = Window.orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 65,536 vertices
    base = lots.select("lot", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("degree").over(Window.partitionBy("lot").orderBy("vertex_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return part.join(base, "lot").select("vertex_id", "degree", (F.col("base") + within).alias("first_out"))


def passable_counts(baked: DataFrame) -> DataFrame:
    """(profile, edges, passable)."""
    return baked.groupBy("profile").agg(F.count("*").alias("edges"), F.count_if("can_pass").alias("passable"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """One row: least, upper median, mean and most of a column; the median by ranks, not in one list."""
    some = df.where(F.col(column).isNotNull()).select(F.col(column).alias("x"))
    ranked = numbered(some.groupBy("x").count(), ["x"], "r")
    upto = Window.orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 65,536 distinct values
    lots = ranked.withColumn("lot", F.floor(F.col("r") / 65_536.0))
    base = lots.groupBy("lot").agg(F.sum("count").alias("s")).select("lot", F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("base"))
    upper = F.col("base") + F.sum("count").over(Window.partitionBy("lot").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    total = some.agg(F.count("*").alias("n"), F.min("x").alias("least"), F.avg("x").alias("mean"), F.max("x").alias("most"))
    middle = lots.join(base, "lot").withColumn("upper", upper).join(F.broadcast(total), how="cross").where("upper > n div 2").agg(F.min("x").alias("median"))  # total: one row
    return total.join(middle, how="cross").select("least", "median", "mean", "most", "n")
