"""The driver's tables seen as a road network.

Customers are vertices of a jittered grid 40 wide, joined to their right and lower neighbours;
orders with their lines are ways, and by themselves requests for routes; suppliers are points; events are restriction commands.
``SQL`` holds the derivations, the same text for Spark and DuckDB; table names stand in braces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import geo, mesh
from roadloom.functions.profiles import BUILT_IN, Profile, definition
from roadloom.operators import extract
from roadloom.operators.lineage import landed

VERTICES = """
select v as vertex_id, r as row_no, c as col_no, 35.05e0 + r * 0.002e0 + ((v * 37) % 97) * 0.000005e0 as lat, 136.6e0 + c * 0.002e0 + ((v * 53) % 89) * 0.000005e0 as lon
from (select c_custkey as v, cast(floor(c_custkey / 40e0) as bigint) as r, c_custkey % 40 as c, c_mktsegment as seg from {customer}) x"""

EDGES = """
select e.edge_id, e.from_id, e.to_id,
    case e.seg when 'BUILDING' then 'residential' when 'AUTOMOBILE' then 'primary' when 'MACHINERY' then 'tertiary' when 'HOUSEHOLD' then 'living_street' else 'footway' end as highway,
    case e.edge_id % 7 when 0 then 'yes' when 1 then '-1' end as oneway, case e.edge_id % 5 when 0 then '40' when 1 then '30 mph' when 2 then 'walk' when 3 then '60' end as maxspeed,
    case e.edge_id % 11 when 0 then '2.4' when 1 then '3.0 m' when 2 then '9 ft' end as maxheight, case e.edge_id % 13 when 0 then 'private' when 1 then 'destination' end as access
from (select c_custkey * 2 as edge_id, c_custkey as from_id, c_custkey + 1 as to_id, c_mktsegment as seg from {customer} where c_custkey % 40 < 39
    union all select c_custkey * 2 + 1, c_custkey, c_custkey + 40, c_mktsegment from {customer}) e
join {customer} t on t.c_custkey = e.to_id"""

POINTS = """
select s_suppkey as point_id, 35.05e0 + ((s_suppkey * 7919) % 7400) * 0.00001e0 as lat, 136.6e0 + ((s_suppkey * 104729) % 7800) * 0.00001e0 as lon from {supplier}"""

#: Every line of an order with its place in the way and the node it stands for.
REFS = """
select way_id, pos, case when k % 3 = 0 then k else 1000000 + way_id * 100 + pos end as node_id from (
    select l_orderkey as way_id, l_partkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as pos from {lineitem}) x"""

#: Nodes of those ways, placed by their number.
NODES = """
select distinct node_id, 35.0e0 + ((node_id * 7919) % 30011) * 0.00001e0 as lat, 136.5e0 + ((node_id * 104729) % 30013) * 0.00001e0 as lon from ({refs}) r"""

#: Routes asked for: from beside an order's customer to beside one near it by number.
REQUESTS = """
select o_orderkey as req_id, a.lat + ((o_orderkey * 31) % 100) * 0.000004e0 as from_lat, a.lon + ((o_orderkey * 17) % 100) * 0.000004e0 as from_lon,
    b.lat + ((o_orderkey * 13) % 100) * 0.000004e0 as to_lat, b.lon + ((o_orderkey * 29) % 100) * 0.000004e0 as to_lon
from (select o_orderkey, o_custkey, n from {orders} join (select count(*) as n from {customer}) c on true) o
join ({vertices}) a on a.vertex_id = o_custkey join ({vertices}) b on b.vertex_id = (o_custkey + 1 + o_orderkey % 97) % n"""

#: Restriction commands: every event makes one area beside a vertex. Most are boxes; some are triangles in them, some mesh cells.
AREAS = """
select area_id, kind, difficulty_type, tag, form, case form when 'mesh' then floor(lat * 960e0) / 960e0 else lat end as min_lat, case form when 'mesh' then floor(lon * 640e0) / 640e0 else lon end as min_lon,
    case form when 'mesh' then (floor(lat * 960e0) + 1e0) / 960e0 else lat + 0.0002e0 end as max_lat, case form when 'mesh' then (floor(lon * 640e0) + 1e0) / 640e0 else lon + 0.0002e0 end as max_lon, lat, lon
from (select event_id as area_id, case event_type when 'error' then 'block' else 'difficulty' end as kind,
    case event_type when 'click' then 'flooding' when 'view' then 'construction' when 'purchase' then 'snow' when 'signup' then 'landslide' else null end as difficulty_type,
    cast(user_id as varchar(20)) as tag, case when event_id % 5 = 3 then 'triangle' when event_id % 20 = 7 then 'mesh' else 'box' end as form,
    v.lat + ((event_id * 419) % 200) * 0.00001e0 as lat, v.lon + ((event_id * 263) % 200) * 0.00001e0 as lon
    from {events} join (select count(*) as n from {customer}) c on true join ({vertices}) v on v.vertex_id = (event_id * 613) % n) x"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derivation over the driver's tables that its text names."""
    sql = sql.replace("{vertices}", VERTICES)
    names = [t for t in ("customer", "supplier", "lineitem", "orders", "events", "part") if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in names})


def duck(sql: str) -> str:
    """The same text for DuckDB."""
    out = sql.replace("{refs}", REFS).replace("{vertices}", VERTICES)
    for t in ("customer", "supplier", "lineitem", "orders", "events", "part"):
        out = out.replace("{" + t + "}", t)
    return out


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, VERTICES)


def tags(*names: str) -> Column:
    """A tag map of the named columns that aren't null."""
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in names])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with tags, line, empty shape, box and float length."""
    v = vertices(spark, sf_dir)
    end = lambda p: v.select(F.col("vertex_id").alias(f"{p}_id"), F.struct("lat", "lon").alias(f"{p}_point"))
    e = derived(spark, sf_dir, EDGES).join(end("from"), "from_id").join(end("to"), "to_id")
    line = F.array("from_point", "to_point")
    none = F.array().cast("array<struct<lat:double,lon:double>>")
    e = e.withColumns({"tags": tags("highway", "oneway", "maxspeed", "maxheight", "access"), "line": line, "shape": none})
    return e.withColumns({"box": geo.box_of(F.col("line")), "dist_m": geo.polyline_length(F.col("line")).cast("float")})


def profiles() -> list[Profile]:
    """All built-in profiles."""
    return [Profile.of(definition(n)) for n in BUILT_IN]


def baked(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Baked entries of the edges for the named profiles (default: all)."""
    return extract.bake(edges(spark, sf_dir), [p for p in profiles() if not names or p.name in names])


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, POINTS)


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, REFS)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, NODES.replace("{refs}", REFS))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways with their refs in order, tagged by their order's priority."""
    r = refs(spark, sf_dir).groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("r"))
    kinds = F.when(F.col("way_id") % 9 == 0, F.lit(None)).when(F.col("way_id") % 4 == 0, "primary").otherwise("residential")
    w = r.select(
        "way_id", F.transform("r", lambda x: x["node_id"]).alias("refs"), kinds.alias("highway"),
        F.when(F.col("way_id") % 10 == 1, "no").alias("access"), F.when(F.col("way_id") % 14 == 2, "yes").alias("area"),
    )
    return w.select("way_id", "refs", tags("highway", "access", "area").alias("tags"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(req_id, from_lat, from_lon, to_lat, to_lon), a row an order."""
    return derived(spark, sf_dir, REQUESTS)


def areas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(areas, shapes): squares of 0.0002 degrees, triangles in such squares, and mesh cells of level 6."""
    code = mesh.code_of_point(F.col("lat"), F.col("lon"), 6)
    a = landed(derived(spark, sf_dir, AREAS).withColumn("code", code), "areas")  # else each use of a box would repeat its making
    point = lambda y, x: F.struct(y.alias("lat"), x.alias("lon"))
    south, west, north, east = (F.col(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon"))
    triangle = F.array(point(south, west), point(south, east), point(north, west + (east - west) * 0.525))
    square = F.array(point(south, west), point(south, east), point(north, east), point(north, west))
    own = F.struct("min_lat", "min_lon", "max_lat", "max_lon")
    cell = mesh.box(F.col("code"), 6)  # rows north of 66°40' have codes that need their level
    none = F.lit(None).cast("array<array<struct<lat:double,lon:double>>>")
    shapes = a.select(
        "area_id", F.lit(0).alias("shape_no"), F.when(F.col("form") == "mesh", cell).otherwise(own).alias("box"),
        F.when(F.col("form") == "triangle", triangle).when(F.col("form") == "box", square).alias("outer"), none.alias("holes"),
    )
    shapes = landed(shapes, "shapes")
    return a.select("area_id", "kind", "difficulty_type", "tag"), shapes
