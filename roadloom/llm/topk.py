"""Exact top-k by inner product over an impact-ordered index, score at a time.

Rows are dealt into blocks of bounded size, and each block's index is built once. Its posting segments are
the rows of one dimension with one quantised value, kept by value. For a query, a segment's impact
is the least that its rows gain in that dimension beyond the dimension's worst segment, so in each dimension
the segments of high impact lie at one end of the postings. Segments are processed in rounds by descending impact. A row's
accumulator is then a lower bound of its score beyond the query's worst case; with the largest open impact of
each dimension that hasn't reached the row, and the quantisation's slack, it is an upper bound. Work stops once few rows' upper bounds reach the
k-th best lower bound or the query's floor: all others are proved out. The rest are scored exactly. Without
such proof all segments are processed. Nothing is approximate.

A query's floor is its k-th best score among one block's worth of rows, which every task of queries holds (a
bounded number); no row below it can be among the k best of all. Queries are a stated set: they lie in
the shared folder, and each block of rows reads them in turn, so no row is copied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import landed, scratch
from roadloom.sources import store

#: Components of a block, and its most rows; queries read at once; values of a segment; the falling cuts of impact, as parts of the largest;
#: the part of a block's rows, one in so many, that it is cheaper to score than to process further segments for.
COMPONENTS, ROWS, QUERIES, STEP, CUTS, FEW = 1 << 22, 4096, 1024, 2, (0.08, 0.02, 0.0), 2
_LONG = (-(1 << 63), (1 << 63) - 1)


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: longs where all sums of their products fit, else Python integers."""
    most = np.finfo(float).max
    whole = np.floor(np.clip(np.asarray(vectors, float) * scale, -most, most))
    if not whole.size or np.abs(whole).max() ** 2 * max(1, whole.shape[1]) < 2.0**52:
        return whole.astype(np.int64)
    return np.array([[int(v) for v in row] for row in whole.tolist()], object).reshape(whole.shape)


class ImpactIndex:
    """The impact-ordered segments of a block of integer vectors."""

    def __init__(self, x: np.ndarray, step: int = STEP) -> None:
        self.x, self.step = x, step
        self.n, self.d = x.shape
        self.small = x.dtype != object and self.n > 0 and self.d > 0
        self.processed = self.postings = 0  # of all queries so far
        if not self.small:
            return
        self.most = float(np.abs(x).max())
        self.exact = x.astype(np.float32 if self.most**2 * self.d < 1 << 24 else float)  # sums of products are exact
        level = np.floor_divide(x, step)
        self.low, self.high = level.min(0), level.max(0)
        level -= self.low
        order = np.argsort(level, axis=0, kind="stable")
        self.span = (self.high - self.low).astype(float)
        self.rows = list(np.ascontiguousarray(order.T))  # postings of each dimension, by value
        self.level = list(np.ascontiguousarray(np.take_along_axis(level, order, 0).T).astype(float))
        self.fall = [top - x for top, x in zip(self.span.tolist(), self.level, strict=True)]
        width = int(self.span.max()) + 2
        counts = np.stack([np.bincount(level[:, k] + 1, minlength=width + 1) for k in range(self.d)])
        self.first = np.cumsum(counts, 1)  # where a segment's postings begin
        self.bits = float(1 << int(self.d).bit_length())  # room for a count of dimensions beside an impact

    def members(self, q: np.ndarray, k: int, floor: float = -np.inf) -> np.ndarray:
        """Rows that may be among the k best for ``q`` and reach ``floor``: all that are and do, and few others."""
        if self.n <= 4 * k:
            return np.arange(self.n)
        w = np.abs(q).astype(float) * self.step
        up = q >= 0
        worst = np.where(up, q * (self.low * self.step), q * (self.high * self.step + self.step - 1)).sum()
        slack = float(np.abs(q).sum()) * (self.step - 1)
        top = w * self.span
        total, few = np.zeros(self.n), max(4 * k, self.n // FEW)
        scaled = (w * self.bits).tolist()
        done = np.zeros(self.d, np.int64)  # levels of each dimension already processed, from its best
        self.postings += self.n * self.d
        dims = np.arange(self.d)
        alive = None
        for cut in CUTS:
            t = cut * top.max()
            above = np.where(w > 0, self.span - np.floor(t / np.maximum(w, 1e-9)), 0).clip(0, None).astype(np.int64)  # levels whose impact is over t
            a = np.where(up, self.first[dims, (self.span - above).astype(np.int64) + 1], self.first[dims, done])
            b = np.where(up, self.first[dims, (self.span - done).astype(np.int64) + 1], self.first[dims, above])
            for d, i, j, rising, weight in zip(range(self.d), a.tolist(), b.tolist(), up.tolist(), scaled, strict=True):
                if j > i:  # the postings of this dimension's new segments
                    gain = self.level[d][i:j] * weight if rising else self.fall[d][i:j] * weight
                    gain += 1.0
                    total += np.bincount(self.rows[d][i:j], gain, self.n)
                    self.processed += j - i
            done = above
            reached = np.floor_divide(total, self.bits)
            seen = total - reached * self.bits  # dimensions that have reached a row
            limit = max(np.partition(reached, self.n - k)[self.n - k], floor - worst)
            most = reached + np.minimum(top, t).sum() - t * seen + slack
            alive = np.flatnonzero(most >= limit)
            if len(alive) <= few:
                break
        return alive

    def top(
        self, q: np.ndarray, k: int, own: np.ndarray | None = None, tie: np.ndarray | None = None, floor: float = -np.inf,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of the k best for ``q`` that reach ``floor``, but for the rows marked ``own``; ties by ``tie``."""
        spare = int(own.sum()) if own is not None else 0
        plain = self.small and q.dtype != object and float(np.abs(q).max(initial=0)) * self.most * self.d < 2.0**52
        if plain and self.most * self.bits * self.d * float(np.abs(q).max(initial=0)) * 4 < 2.0**52:
            rows = self.members(q, k + spare, floor)
        else:  # impacts of this size aren't exact in a double: every row is scored
            rows = np.arange(self.n)
        if spare:
            rows = rows[~own[rows]]
        thin = plain and self.exact.dtype == np.float32 and float(np.abs(q).max(initial=0)) * self.most * self.d < 1 << 24
        if thin:
            exact = (self.exact[rows] @ q.astype(np.float32)).astype(np.int64)
        elif plain:
            exact = (self.x[rows].astype(float) @ q.astype(float)).astype(np.int64)
        else:
            exact = self.x[rows].astype(object) @ q.astype(object)
        if len(rows) and floor > -np.inf:
            keep = np.asarray(exact >= floor, bool)
            rows, exact = rows[keep], exact[keep]
        tie = rows if tie is None else tie[rows]
        order = np.lexsort((tie, -exact)) if exact.dtype != object else np.array(
            sorted(range(len(rows)), key=lambda r: (-exact[r], tie[r])), np.int64,
        )
        return rows[order[:k]], exact[order[:k]]


def _whole(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return vector.isNotNull() & finite


def _dense(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows of integers; a shorter vector is followed by zeros."""
    sizes = np.diff(np.asarray(vectors.offsets))
    out = np.zeros((len(vectors), width))
    out[np.repeat(np.arange(len(vectors)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = vectors.flatten().to_numpy()
    return integers(out, scale)


def _ties(ids: list) -> np.ndarray:
    """The order at ties: smaller ids first, null ids last."""
    out = np.empty(len(ids), np.int64)
    out[sorted(range(len(ids)), key=lambda r: (ids[r] is None, ids[r] or 0, r))] = np.arange(len(ids))
    return out


_HITS = ["quid", "query_id", "vec_id", "none", "uid", "score"]


def _answers(index: ImpactIndex, ids: list, uids: np.ndarray, tie: np.ndarray, batch: pa.RecordBatch, width: int, scale: int, k: int) -> pa.Table:
    """The hits of a block of rows for a batch of queries (id, uid, v, floor)."""
    out: dict[str, list] = {c: [] for c in _HITS}
    if len(ids):
        floors = batch.column("floor").to_pylist()
        queries = _dense(batch.column("v"), width, scale)
        for i, u, q, floor in zip(batch.column("id").to_pylist(), batch.column("uid").to_pylist(), queries, floors, strict=True):
            at, score = index.top(q, k, uids == u, tie, -np.inf if floor is None else floor)
            out["quid"] += [u] * len(at)
            out["query_id"] += [i] * len(at)
            out["vec_id"] += [ids[a] for a in at.tolist()]
            out["none"] += [ids[a] is None for a in at.tolist()]
            out["uid"] += uids[at].tolist()
            out["score"] += [min(max(int(s), _LONG[0]), _LONG[1]) for s in score]
    return pa.table({c: pa.array(v, pa.bool_() if c == "none" else pa.int64()) for c, v in out.items()})


def search(
    vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector: str = "embedding", rows: int = ROWS,
    queries: int = QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every row whose id is divisible by ``every``.

    Components become floor(``scale`` * x), x as double. A row is no candidate of its own query;
    other rows of the same id are. Ties go to the smaller id, then to either of repeated
    rows. Vectors that are null or hold null or non-finite components take no part; a shorter vector
    counts as followed by zeros; empty vectors score zero; a score is exact, and one beyond 64 bits is given as the
    nearest long; null ids are candidates, after all others at ties, and never
    queries; other columns are ignored, whatever their names; fewer than k candidates give fewer rows; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    body = F.transform(F.col(vector), lambda v: v.cast("double"))
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), body.alias("v")).where(_whole(F.col("v")))
    all_rows = landed(usable.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    n, width = all_rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    size = max(1, min(rows, COMPONENTS // max(1, width)))
    blocks = max(1, -(-n // size))
    mix = F.xxhash64("uid")
    asked = all_rows.where(F.col("id") % every == 0)

    # the floors, from one block's worth of rows: no more than ``size`` come to the driver
    some = all_rows.select("id", "v", "uid").orderBy(mix, "uid").limit(size).toArrow().combine_chunks() if blocks > 1 else None
    held = spark.sparkContext.broadcast(some)

    def sink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, index = held.value, None
        for batch in batches:
            floors = [None] * batch.num_rows
            if sample is not None:
                if index is None:
                    x = _dense(
                        sample.column("v").combine_chunks() if isinstance(sample.column("v"), pa.ChunkedArray) else sample.column("v"),
                        width, scale,
                    )
                    index, uids = ImpactIndex(x), sample.column("uid").to_numpy()
                qs = _dense(batch.column("v"), width, scale)
                for j, (u, q) in enumerate(zip(batch.column("uid").to_pylist(), qs, strict=True)):
                    _, score = index.top(q, k, uids == u)
                    floors[j] = float(score[-1]) if len(score) == k and abs(int(score[-1])) < 2**52 else None
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.float64())], ["id", "uid", "v", "floor"])

    folder = scratch(spark, "queries")
    asked.select("id", "uid", "v").mapInArrow(sink, "id long, uid long, v array<double>, floor double").write.parquet(folder)

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by("uid").combine_chunks()
        ids, uids = t.column("id").to_pylist(), t.column("uid").to_numpy()
        index, tie = ImpactIndex(_dense(t.column("v").combine_chunks(), width, scale)), _ties(ids)
        found = []
        for part in store.listed(folder, ".parquet"):
            for batch in pq.ParquetFile(store.opened(part)).iter_batches(queries):
                found.append(_answers(index, ids, uids, tie, batch, width, scale, k))
        return pa.concat_tables(found) if found else pa.table({c: pa.array([], pa.bool_() if c == "none" else pa.int64()) for c in _HITS})

    block = F.pmod(mix, F.lit(blocks)).alias("block")
    best = all_rows.select("id", "uid", "v", block).groupBy("block").applyInArrow(
        meet, "quid long, query_id long, vec_id long, none boolean, uid long, score long",
    )
    rank = F.row_number().over(Window.partitionBy("quid").orderBy(F.col("score").desc(), "none", "vec_id", "uid"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same by brute force in DuckDB.
ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as x, row_number() over () as uid from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, q.uid as quid, c.vec_id, list_dot_product(q.x, c.x)::bigint as score from v q join v c on q.uid <> c.uid where q.vec_id % 20 = 0)
select query_id, row_number() over (partition by quid order by score desc, vec_id)::int as rank, vec_id, score from s
qualify rank <= 20"""
