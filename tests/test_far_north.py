"""Queries against their SQL on vertices north of 66°40', where mesh codes have a first part of three digits."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from roadloom.functions import mesh
from roadloom.plans import registry

FIRST, N = 632_000, 633_600
CUSTOMERS = f"""select case when i >= {FIRST} then i end as c_custkey, ['BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD'][1 + i % 4] as c_mktsegment
    from range({N}) r(i)"""  # rows without a key count, but are no vertices
EVENTS = f"""select i as event_id, i // 7 % 30 as user_id, ['error', 'click', 'view', 'purchase', 'signup'][1 + i // 20 % 5] as event_type
    from range(400000) r(i) where (i * 613) % {N} >= {FIRST}"""


@pytest.fixture(scope="module")
def north(tmp_path_factory):
    folder, c = tmp_path_factory.mktemp("north"), duckdb.connect()
    for name, sql in (("customer", CUSTOMERS), ("events", EVENTS)):
        c.execute(f"copy ({sql}) to '{folder}/{name}.parquet' (format parquet)")
        c.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", [
    "k7_restriction_documents",
    "s21_gml_features",
    "a6_edge_factors",
    "j5_detached_factors",
    "k8_area_geojson",
    "m2_mesh_codes",
    "j4_area_edges",
    "m5_meshes_in_bounds",
    "r3_after_removals",
    "r9_difficulties_by_edge",
    "j9_areas_on_segment",
])
def test_query_equals_sql_in_the_far_north(spark, north, name):
    folder, c = north
    df = registry.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    rows = Counter(repr(tuple(r)) for r in df.select(*columns).collect())
    found = c.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    want = Counter(repr(tuple(r[names.index(k)] for k in columns)) for r in found.fetchall())
    assert rows == want and (rows or name == "j9_areas_on_segment")  # its segment lies south of all these areas


def test_codes_with_their_level_name_cells_of_all_latitudes(spark):
    places = [(0.001, 100.001), (3.3, 136.6), (35.68, 139.77), (66.66, 136.61), (66.67, 136.61), (70.0004, 136.6789), (89.99, 199.99)]
    df = spark.createDataFrame(places, "lat double, lon double")
    for k in (3, 4, 5, 6):
        code = mesh.code_of_point(F.col("lat"), F.col("lon"), k)
        for r in df.select("lat", "lon", mesh.box(code, k).alias("b"), mesh.box(code).alias("own"), mesh.standard(code, k).alias("plain")).collect():
            assert r.b.min_lat <= r.lat < r.b.max_lat and r.b.min_lon <= r.lon < r.b.max_lon
            assert r.b.max_lat - r.b.min_lat == pytest.approx(0.5 ** (k - 3) / 120)
            assert r.plain == (20 / 3 <= r.lat < 200 / 3) and (not r.plain or r.own == r.b)
    bad = spark.createDataFrame([(100366815, 3), (533946115, 4), (53394611, 7), (None, 3)], "m long, k int")
    assert [r.b for r in bad.select(mesh.box(F.col("m"), F.col("k")).alias("b")).collect()] == [None] * 4
