"""Time-shortest routes for batches of requests.

Path search is the one operator that relational operators don't express well. Up to ``MOST_BYTES`` a graph
is a sorted table in the shared folder, which each Python worker loads once as arrays; neither the driver nor a
broadcast holds it. Requests are dealt by source edge, so that those which start alike follow each other in one
task and share the search trees of their first vertices; a tree grows only as far as its
targets. A source that many requests share spans several tasks.

Beyond that size, :func:`routes_by_joins` gives the same costs, edges and shapes by rounds of joins.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.functions import geo
from roadloom.functions.geo import EARTH_RADIUS_M
from roadloom.operators import spatial
from roadloom.operators.lineage import cut, landed, scratch
from roadloom.operators.restrict import weighted_seconds

#: Bytes of a graph's arrays that one Python worker may hold.
MOST_BYTES = 1 << 30


@dataclass
class Network:
    """A graph for one profile in arrays: edges by number, and arcs sorted by their start."""

    edge_id: np.ndarray
    from_: np.ndarray
    to: np.ndarray
    dist: np.ndarray
    seconds: np.ndarray  # infinite where restricted
    passable: np.ndarray
    fwd: np.ndarray
    bwd: np.ndarray
    lat: np.ndarray
    lon: np.ndarray
    shape_at: np.ndarray
    shape_lat: np.ndarray
    shape_lon: np.ndarray
    first: np.ndarray = None
    arc_to: np.ndarray = None
    arc_edge: np.ndarray = None
    arc_seconds: np.ndarray = None

    def __post_init__(self) -> None:
        loop = self.from_ == self.to
        f, b = np.flatnonzero(self.fwd), np.flatnonzero(self.bwd & ~loop)
        src = np.concatenate([self.from_[f], self.to[b]])
        order = np.argsort(src, kind="stable")
        self.arc_to = np.concatenate([self.to[f], self.from_[b]])[order]
        self.arc_edge = np.concatenate([f, b])[order]
        self.arc_seconds = self.seconds[self.arc_edge]
        self.first = np.searchsorted(src[order], np.arange(len(self.lat) + 1))

    @classmethod
    def load(cls, folder: str) -> Network:
        """From the tables that :func:`stored` wrote, in any store that Arrow knows."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)

        def table(name: str) -> pa.Table:
            found = files.get_file_info(fs.FileSelector(f"{root}/{name}", recursive=True))
            parts = sorted(f.path for f in found if f.path.endswith(".parquet"))  # Spark numbers sorted parts in order
            return pa.concat_tables([pq.read_table(files.open_input_file(x)) for x in parts])

        e, v = table("edges"), table("vertices")
        col = lambda c: e.column(c).to_numpy()
        shape = e.column("shape").combine_chunks()
        flat, sizes = shape.flatten(), np.diff(np.asarray(shape.offsets))
        seconds = np.nan_to_num(e.column("s").fill_null(math.inf).to_numpy(), nan=math.inf, posinf=math.inf)
        return cls(
            col("edge_id"), col("from_id"), col("to_id"), col("dist_m"), seconds, col("can_pass").astype(bool), col("fwd").astype(bool), col("bwd").astype(bool),
            v.column("lat").to_numpy(), v.column("lon").to_numpy(), np.concatenate([[0], np.cumsum(sizes)]), np.asarray(flat.field("lat")), np.asarray(flat.field("lon")),
        )


def timed_edges(edges: DataFrame, baked: DataFrame, profile: str, factors: DataFrame | None = None) -> DataFrame:
    """(edge_id, from_id, to_id, shape, dist_m double, s, can_pass, fwd, bwd): s null where the edge can't be passed."""
    rows = edges.select(
        "edge_id", "from_id", "to_id", "shape", F.col("dist_m").cast("double").alias("dist_m"),
    ).join(baked.where(F.col("profile") == profile), "edge_id")
    if factors is None:
        seconds = weighted_seconds(F.col("dist_m"), F.col("speed_kmh"))
    else:
        rows = rows.join(factors, "edge_id", "left")
        seconds = weighted_seconds(F.col("dist_m"), F.col("speed_kmh"), F.col("factor"), F.col("blocked"))
    none = F.array().cast("array<struct<lat:double,lon:double>>")
    return rows.select(
        "edge_id", "from_id", "to_id", F.coalesce("shape", none).alias("shape"), "dist_m", seconds.alias("s"), "can_pass", "fwd", "bwd",
    )


def stored(verts: DataFrame, edges: DataFrame, baked: DataFrame, profile: str, factors: DataFrame | None = None) -> str:
    """Writes a profile's graph, sorted, below the shared folder, and returns its place; vertex ids are dense from 0.

    An unknown profile is an error, and so is a graph whose arrays exceed ``MOST_BYTES``.
    """
    spark = edges.sparkSession
    if baked.where(F.col("profile") == profile).isEmpty() and not edges.isEmpty():
        raise ValueError(f"no such profile: {profile}")
    folder = scratch(spark, "network")
    timed_edges(edges, baked, profile, factors).orderBy("edge_id").write.parquet(f"{folder}/edges")
    verts.select("vertex_id", "lat", "lon").orderBy("vertex_id").write.parquet(f"{folder}/vertices")
    n, points = spark.read.parquet(f"{folder}/edges").agg(F.count("*"), F.coalesce(F.sum(F.size("shape")), F.lit(0))).first()
    size = n * 110 + points * 16 + spark.read.parquet(f"{folder}/vertices").count() * 24
    if size > MOST_BYTES:
        raise ValueError(f"a graph of {size} bytes is too large for a worker; use routes_by_joins()")
    return folder


@lru_cache(1)
def _network(folder: str) -> Network:
    """The graph of a folder, loaded once a process."""
    return Network.load(folder)


def collect_network(verts: DataFrame, edges: DataFrame, baked: DataFrame, profile: str, factors: DataFrame | None = None) -> Network:
    """The arrays of a graph, in this process."""
    return Network.load(stored(verts, edges, baked, profile, factors))


class Tree:
    """Least costs from one vertex, grown on demand."""

    def __init__(self, g: Network, source: int) -> None:
        self.g, self.cost, self.back, self.done = g, {source: 0.0}, {}, set()
        self.heap = [(0.0, source)]

    def reach(self, target: int, limit: float = math.inf) -> float:
        """The cost to a vertex, or infinity if it isn't below ``limit``."""
        if target in self.done:
            return self.cost[target] if self.cost[target] < limit else math.inf
        g, cost, back, done, heap = self.g, self.cost, self.back, self.done, self.heap
        while heap and heap[0][0] < limit:
            c, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            a, b = int(g.first[v]), int(g.first[v + 1])
            for w, s, e in zip(g.arc_to[a:b].tolist(), g.arc_seconds[a:b].tolist(), g.arc_edge[a:b].tolist(), strict=True):
                n = c + s
                if n < cost.get(w, math.inf):
                    cost[w], back[w] = n, (v, e)
                    heapq.heappush(heap, (n, w))
            if v == target:
                return c
        return math.inf

    def path(self, target: int) -> tuple[list[int], list[int]]:
        """Vertices and edges from the source to a vertex that was reached."""
        vertices, edges = [target], []
        while target in self.back:
            target, e = self.back[target]
            vertices.append(target)
            edges.append(e)
        return vertices[::-1], edges[::-1]


@dataclass
class Trees:
    """The search trees of the last few source vertices."""

    g: Network
    most: int = 4
    held: dict = field(default_factory=dict)

    def of(self, vertex: int) -> Tree:
        if vertex not in self.held:
            while len(self.held) >= self.most:
                self.held.pop(next(iter(self.held)))
            self.held[vertex] = Tree(self.g, vertex)
        return self.held[vertex]


def _haversine(a_lat: float, a_lon: float, b_lat: float, b_lon: float) -> float:
    a, b = math.sin(math.radians(b_lat - a_lat) / 2), math.sin(math.radians(b_lon - a_lon) / 2)
    h = a * a + math.cos(math.radians(a_lat)) * math.cos(math.radians(b_lat)) * b * b
    return 2 * EARTH_RADIUS_M * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


def _ends(g: Network, edge: int, part: float, leaving: bool) -> list[tuple[int, float, float]]:
    """(vertex, seconds, share of the edge) of both ways to leave an edge at a place, or to arrive there; impassable ways are left out."""
    to, back = (g.to, g.from_) if leaving else (g.from_, g.to)
    whole = float(g.seconds[edge])
    ways = ((g.fwd[edge], to, 1 - part if leaving else part), (g.bwd[edge], back, part if leaving else 1 - part))
    return [(int(v[edge]), share * whole if share else 0.0, share) for open_, v, share in ways if open_ and whole < math.inf]


def search(g: Network, source: int, f: float, target: int, t: float, trees: Trees | None = None) -> tuple | None:
    """(seconds, metres, vertices, edges, cumulative seconds at vertices) from part f of edge ``source`` to part t of edge ``target``, or None.

    Of equally fast routes, the direct one on a shared edge wins, then the one that leaves forward, then the one that arrives forward.
    """
    if not g.passable[source] or not g.passable[target]:
        return None
    best, found = math.inf, None
    if source == target:
        if f == t:
            return 0.0, 0.0, [], [], []
        if (g.fwd[source] if t > f else g.bwd[source]) and g.seconds[source] < math.inf:
            best = abs(t - f) * float(g.seconds[source])
            found = (best, abs(t - f) * float(g.dist[source]), [], [], [])
    trees, choice = trees or Trees(g), None
    for u, lead, lead_share in _ends(g, source, f, True):
        for v, tail, tail_share in _ends(g, target, t, False):
            c = lead + trees.of(u).reach(v, best - lead - tail) + tail
            if c < best:
                best, choice = c, (u, lead, lead_share, v, tail_share)
    if choice is None:
        return found
    u, lead, lead_share, v, tail_share = choice
    tree = trees.of(u)
    vertices, edges = tree.path(v)
    metres = lead_share * float(g.dist[source]) + sum(float(g.dist[e]) for e in edges) + tail_share * float(g.dist[target])
    return best, metres, vertices, edges, [lead + tree.cost[x] for x in vertices]


def geometry(g: Network, found: tuple, start: tuple[float, float], end: tuple[float, float]) -> tuple[list, list]:
    """(points, seconds at points): the snapped ends, vertices, and whole edges' interior points, timed by distance."""
    total, _, vertices, edges, at = found
    points, cum = [start], [0.0]
    for i, v in enumerate(vertices):
        here = (float(g.lat[v]), float(g.lon[v]))
        if i:
            e, before = edges[i - 1], vertices[i - 1]
            inner = [(float(g.shape_lat[k]), float(g.shape_lon[k])) for k in range(int(g.shape_at[e]), int(g.shape_at[e + 1]))]
            if not (int(g.from_[e]) == before and int(g.to[e]) == v):
                inner.reverse()
            run, steps = (float(g.lat[before]), float(g.lon[before])), []
            for p in [*inner, here]:
                steps.append(_haversine(*run, *p))
                run = p
            length, so_far = sum(steps), 0.0
            for p, d in zip(inner, steps, strict=False):
                so_far += d
                points.append(p)
                cum.append(at[i - 1] + (so_far / length if length > 0 else 0.0) * (at[i] - at[i - 1]))
        points.append(here)
        cum.append(at[i])
    points.append(end)
    cum.append(total)
    return points, cum


ROUTE = T.StructType([
    T.StructField("req_id", T.LongType()), T.StructField("dist_m", T.DoubleType()), T.StructField("dur_s", T.DoubleType()),
    T.StructField(
        "shape", T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])),
    ), T.StructField("cum_s", T.ArrayType(T.DoubleType())), T.StructField("edges", T.ArrayType(T.LongType())),
])


def routes(snapped: DataFrame, folder: str) -> DataFrame:
    """(req_id, dist_m, dur_s, shape, cum_s, edges) of each snapped request that has a route in the graph of :func:`stored`.

    ``snapped`` has req_id and, for s and t, {p}_edge, {p}_offset, {p}_lat, {p}_lon.
    """
    place = pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _network(folder)
        trees = Trees(g)
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                s, t = (int(np.searchsorted(g.edge_id, r[f"{p}_edge"])) for p in "st")
                found = search(g, s, r["s_offset"] / 65535.0, t, r["t_offset"] / 65535.0, trees)
                if found:
                    points, cum = geometry(g, found, (r["s_lat"], r["s_lon"]), (r["t_lat"], r["t_lon"]))
                    out.append((
                        r["req_id"], found[1], found[0], [{"lat": a, "lon": o} for a, o in points], cum,
                        [int(g.edge_id[e]) for e in found[3]],
                    ))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.float64(), pa.float64(), place, pa.list_(pa.float64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ROUTE.names)

    wanted = ["req_id", *(f"{p}_{c}" for p in "st" for c in ("edge", "offset", "lat", "lon"))]
    # dealt by range, so that requests of one source edge are neighbours and yet may span tasks
    # and by number, since small rows that take long to search aren't to be put together
    spark = snapped.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    dealt = snapped.select(*wanted).repartitionByRange(parts, "s_edge", "t_edge", "req_id").sortWithinPartitions("s_edge", "t_edge", "req_id")
    return dealt.mapInArrow(run, ROUTE)


def snapped_requests(requests: DataFrame, edges: DataFrame, baked: DataFrame, profile: str, radius_m: float = 500.0) -> DataFrame:
    """Requests (req_id, from_lat, from_lon, to_lat, to_lon) with both ends snapped; those with an end too far drop out."""
    out = requests.select("req_id")
    for p, side in (("s", "from"), ("t", "to")):
        points = requests.select(F.col("req_id").alias("point_id"), F.col(f"{side}_lat").alias("lat"), F.col(f"{side}_lon").alias("lon"))
        at = spatial.snap(points, edges, baked, profile, radius_m)
        out = out.join(
            at.select(
                F.col("point_id").alias("req_id"), F.col("edge_id").alias(f"{p}_edge"), F.col("offset").alias(f"{p}_offset"),
                F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"),
            ),
            "req_id",
        )
    return out


def calculate(
    requests: DataFrame, verts: DataFrame, edges: DataFrame, baked: DataFrame, profile: str, factors: DataFrame | None = None,
    radius_m: float = 500.0,
) -> DataFrame:
    """Routes of requests for a profile: snap, search, build. Requests without a route give no row."""
    return routes(snapped_requests(requests, edges, baked, profile, radius_m), stored(verts, edges, baked, profile, factors))


def linear_cumulative(shape, total):
    """Seconds at each point of a route that has only its total, evenly, the last exactly the total."""
    n = F.size(shape)
    return F.transform(shape, lambda p, i: F.when(i == n - 1, total).otherwise(total * i / F.greatest(n - 1, F.lit(1))))


def weighted_arcs(edges: DataFrame, baked: DataFrame, profile: str, factors: DataFrame | None = None) -> DataFrame:
    """(src, dst, edge_id, seconds, reversed) of the arcs that a profile may take."""
    timed = timed_edges(edges, baked, profile, factors).where("s is not null")
    forward = timed.where("fwd").select(
        F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "edge_id", F.col("s").alias("seconds"), F.lit(False).alias("reversed"),
    )
    back = timed.where("bwd and from_id <> to_id").select(
        F.col("to_id").alias("src"), F.col("from_id").alias("dst"), "edge_id", F.col("s").alias("seconds"), F.lit(True).alias("reversed"),
    )
    return forward.unionByName(back)


def relax(arcs: DataFrame, sources: DataFrame, rounds: int = 100_000) -> DataFrame:
    """(source, vertex_id, seconds): least costs from every source to all it reaches, by rounds of joins.

    For graphs too large to broadcast: only vertices whose cost fell go on to the next round; each round is checkpointed.
    """
    spark = arcs.sparkSession
    arcs = cut(arcs)
    best = cut(sources.select(F.col("vertex_id").alias("source"), "vertex_id", F.lit(0.0).alias("seconds")).distinct())
    front = best
    for _ in range(rounds):
        step = front.join(arcs, front["vertex_id"] == arcs["src"]).groupBy("source", F.col("dst").alias("vertex_id")).agg(F.min(front["seconds"] + arcs["seconds"]).alias("new"))
        front = cut(step.join(best, ["source", "vertex_id"], "left").where("seconds is null or new < seconds").select(
            "source", "vertex_id", F.col("new").alias("seconds"),
        ))
        if front.isEmpty():
            return best
        best = cut(best.join(front.select("source", "vertex_id"), ["source", "vertex_id"], "left_anti").unionByName(front))
    raise RuntimeError(f"no end after {rounds} rounds on {spark.sparkContext.applicationId}")


def _leaving(part: Column) -> Column:
    """(forward, share of the edge) of both ways to leave an edge at a part of it."""
    return F.array(F.struct(F.lit(True).alias("forward"), (1 - part).alias("share")), F.struct(F.lit(False).alias("forward"), part.alias("share")))


def routes_by_joins(
    snapped: DataFrame, verts: DataFrame, edges: DataFrame, baked: DataFrame, profile: str, factors: DataFrame | None = None,
    rounds: int = 100_000,
) -> DataFrame:
    """The rows of :func:`routes` without a graph in any one place, for graphs that no worker can hold.

    A label is a request, a vertex and the least cost found so far, with the arc that it came by. In each round the
    labels that fell meet the arcs; those that can't beat the request's best arrival are dropped. Then each
    route is followed back from its arrival, an arc of every route in a round. Labels and routes are checkpointed tables.
    """
    timed = landed(timed_edges(edges, baked, profile, factors), "timed")
    arcs = landed(weighted_arcs(edges, baked, profile, factors), "arcs")
    asked = landed(snapped.withColumns({f"{p}_part": F.col(f"{p}_offset") / 65535.0 for p in "st"}), "asked")
    side = lambda p: timed.select(
        F.col("edge_id").alias(f"{p}_edge"), *[F.col(c).alias(f"{p}_{c}") for c in ("from_id", "to_id", "s", "dist_m", "fwd", "bwd")],
    )
    both = asked.join(
        side("s").where("s_s is not null and (s_fwd or s_bwd)"), "s_edge",
    ).join(side("t").where("t_s is not null and (t_fwd or t_bwd)"), "t_edge")
    both = landed(both, "ends")
    direct = both.where("s_edge = t_edge and (s_part = t_part or (t_part > s_part and s_fwd) or (t_part < s_part and s_bwd))")
    direct = direct.select(
        "req_id", (F.abs(F.col("t_part") - F.col("s_part")) * F.col("s_s")).alias("direct_s"),
        (F.abs(F.col("t_part") - F.col("s_part")) * F.col("s_dist_m")).alias("direct_m"),
    )
    x = F.col("x")
    start = both.select(
        "req_id", "s_from_id", "s_to_id", "s_s", "s_dist_m", "s_fwd", "s_bwd", F.explode(_leaving(F.col("s_part"))).alias("x"),
    ).where(F.when(x["forward"], F.col("s_fwd")).otherwise(F.col("s_bwd")))
    start = start.select(
        "req_id", F.when(x["forward"], F.col("s_to_id")).otherwise(F.col("s_from_id")).alias("vertex_id"),
        F.struct((x["share"] * F.col("s_s")).alias("c"), (x["share"] * F.col("s_dist_m")).alias("m")).alias("l"),
    )
    none = F.struct(F.lit(None).cast("long").alias("prev"), F.lit(None).cast("long").alias("edge"), F.lit(None).cast("boolean").alias("reversed"))
    start = start.groupBy("req_id", "vertex_id").agg(F.min("l").alias("l")).select(
        "req_id", "vertex_id", F.col("l.c").alias("c"), F.col("l.m").alias("m"), none.alias("by"),
    )
    goal = both.select(
        "req_id", "t_from_id", "t_to_id", "t_s", "t_dist_m", "t_fwd", "t_bwd", F.explode(_leaving(1 - F.col("t_part"))).alias("x"),
    ).where(F.when(x["forward"], F.col("t_fwd")).otherwise(F.col("t_bwd")))
    goal = goal.select(
        "req_id", F.when(x["forward"], F.col("t_from_id")).otherwise(F.col("t_to_id")).alias("vertex_id"),
        (x["share"] * F.col("t_s")).alias("tail"), (x["share"] * F.col("t_dist_m")).alias("tail_m"),
    )
    goal = landed(goal, "goals")
    labels = front = cut(start)
    for _ in range(rounds):
        arrived = labels.join(goal, ["req_id", "vertex_id"]).groupBy("req_id").agg(F.min(F.col("c") + F.col("tail")).alias("limit"))
        bound = arrived.join(direct, "req_id", "full").select("req_id", F.least("limit", "direct_s").alias("limit"))
        step = front.join(arcs, front["vertex_id"] == arcs["src"]).join(bound, "req_id", "left")
        step = step.where(F.col("limit").isNull() | (F.col("c") + F.col("seconds") < F.col("limit")))
        step = step.select(
            "req_id", F.col("dst").alias("vertex_id"),
            F.struct(
                (F.col("c") + F.col("seconds")).alias("c"), F.col("m"),
                F.struct(F.col("src").alias("prev"), F.col("edge_id").alias("edge"), "reversed").alias("by"),
            ).alias("l"),
        )
        step = step.groupBy("req_id", "vertex_id").agg(F.min("l").alias("l"))
        old = labels.select("req_id", "vertex_id", F.col("c").alias("old"))
        front = step.join(old, ["req_id", "vertex_id"], "left").where("old is null or l.c < old")
        front = cut(front.select("req_id", "vertex_id", F.col("l.c").alias("c"), F.col("l.m").alias("m"), F.col("l.by").alias("by")))
        if front.isEmpty():
            break
        labels = cut(labels.join(front.select("req_id", "vertex_id"), ["req_id", "vertex_id"], "left_anti").unionByName(front))
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    ends = labels.join(goal, ["req_id", "vertex_id"]).groupBy("req_id").agg(F.min(F.struct(
        (F.col("c") + F.col("tail")).alias("dur"), "vertex_id", "tail_m",
    )).alias("a"))
    chosen = asked.select(
        "req_id", "s_lat", "s_lon", "t_lat", "t_lon",
    ).join(ends, "req_id", "left").join(direct, "req_id", "left").where("a is not null or direct_s is not null")
    straight = F.col("direct_s").isNotNull() & (F.col("a").isNull() | (F.col("direct_s") <= F.col("a.dur")))
    chosen = cut(chosen.withColumn("straight", straight))
    # back from the arrivals: one arc of every route in a round
    at = cut(chosen.where("not straight").select("req_id", F.col("a.vertex_id").alias("vertex_id"), F.lit(0).alias("step")))
    steps = None
    while not at.isEmpty():
        here = cut(at.join(labels, ["req_id", "vertex_id"]).select("req_id", "vertex_id", "step", "c", "m", "by"))
        steps = here if steps is None else cut(steps.unionByName(here))
        at = here.where("by.prev is not null").select("req_id", F.col("by.prev").alias("vertex_id"), (F.col("step") + 1).alias("step"))
    point = F.struct("lat", "lon")
    if steps is None:
        steps = labels.limit(0).select("req_id", "vertex_id", F.lit(0).alias("step"), "c", "m", "by")
    nodes = steps.join(verts.select("vertex_id", point.alias("here")), "vertex_id").join(
        timed.select(F.col("edge_id").alias("e"), "shape", "dist_m"), F.col("by.edge") == F.col("e"), "left",
    )
    before = Window.partitionBy("req_id").orderBy(F.col("step").desc())
    nodes = nodes.withColumn("from_c", F.lag("c").over(before)).withColumn("from_p", F.lag("here").over(before))
    inner = F.when(F.col("by.reversed"), F.reverse("shape")).otherwise(F.coalesce("shape", F.array().cast("array<struct<lat:double,lon:double>>")))
    line = F.when(F.col("from_p").isNull(), F.array("here")).otherwise(F.concat(F.array("from_p"), inner, F.array("here")))
    nodes = nodes.withColumn("line", line).withColumn("length", geo.polyline_length(F.col("line")))
    so_far = lambda i: geo.polyline_length(F.slice("line", 1, i + 1))
    share = lambda i: F.coalesce(F.try_divide(so_far(i), F.col("length")), F.lit(0.0))
    timed_points = F.when(
        F.col("from_p").isNull(), F.array(F.struct(F.col("here.lat").alias("lat"), F.col("here.lon").alias("lon"), F.col("c").alias("t"))),
    ).otherwise(
        F.slice(
            F.transform("line", lambda p, i: F.struct(
                p["lat"].alias("lat"), p["lon"].alias("lon"),
                F.when(i == F.size("line") - 1, F.col("c")).otherwise(F.col("from_c") + share(i) * (F.col("c") - F.col("from_c"))).alias("t"),
            )),
            2, F.size("line"),
        )
    )
    part = nodes.select(
        "req_id",
        F.struct(
            (-F.col("step")).alias("step"), timed_points.alias("p"), F.col("by.edge").alias("edge"),
            F.coalesce("dist_m", F.lit(0.0)).alias("d"), "m",
        ).alias("n"),
    )
    whole = part.groupBy("req_id").agg(F.array_sort(F.collect_list("n")).alias("n"))  # one route
    out = chosen.join(whole, "req_id", "left")
    ends_of = lambda p: F.struct(F.col(f"{p}_lat").alias("lat"), F.col(f"{p}_lon").alias("lon"))
    mid = F.coalesce(F.flatten(F.transform("n", lambda k: k["p"])), F.array().cast("array<struct<lat:double,lon:double,t:double>>"))
    dur = F.when(F.col("straight"), F.col("direct_s")).otherwise(F.col("a.dur"))
    along = F.get("n", F.lit(0))["m"] + F.aggregate("n", F.lit(0.0), lambda acc, k: acc + k["d"]) + F.col("a.tail_m")
    return out.select(
        "req_id", F.when(F.col("straight"), F.col("direct_m")).otherwise(along).alias("dist_m"), dur.alias("dur_s"),
        F.concat(
            F.array(ends_of("s")), F.transform(mid, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))),
            F.array(ends_of("t")),
        ).alias("shape"),
        F.concat(F.array(F.lit(0.0)), F.transform(mid, lambda p: p["t"]), F.array(dur)).alias("cum_s"),
        F.coalesce(F.filter(F.transform("n", lambda k: k["edge"]), lambda e: e.isNotNull()), F.array().cast("array<bigint>")).alias("edges"),
    )


def reach(folder: str, sources: DataFrame) -> DataFrame:
    """(source, vertex_id, seconds): least costs from each source vertex in the graph of :func:`stored`, a source a search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _network(folder)
        for b in batches:
            for source in b.column(0).to_pylist():
                tree = Tree(g, source)
                tree.reach(-1)  # no such vertex: the tree grows to its end
                ends = sorted(tree.done)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([source] * len(ends), pa.int64()), pa.array(ends, pa.int64()), pa.array([tree.cost[v] for v in ends], pa.float64())],
                    ["source", "vertex_id", "seconds"],
                )

    return sources.select(F.col("vertex_id").cast("long")).mapInArrow(run, "source long, vertex_id long, seconds double")
