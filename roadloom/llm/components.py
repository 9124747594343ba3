"""Connected components of a distributed graph by large-star and small-star rounds.

Every round's edges are a written table in the shared folder, so that no round depends on
an executor. Nothing of the graph comes to the driver but its size and checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import landed


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def stars(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """Rows (u, v) with v the smallest node of u's component, for every u but the smallest.

    ``edges`` has two columns of longs; self-loops and repeats are ignored, null ends too.
    ``rounds`` is far above what any graph needs (a logarithm of its longest path); beyond
    it an error is raised, never a partial result returned.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = landed(now, "edges")
    state = _state(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = landed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-min")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = landed(large, "large-star")
        lowest = landed(large.groupBy("u").agg(F.min("v").alias("m")), "small-min")
        moved = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = landed(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        before, state = state, _state(now)
        if state == before:
            return now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
