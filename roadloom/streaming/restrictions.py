"""Restriction commands as a stream: the live set after every micro-batch.

Commands: (seq, op add|remove|remove_tag|clear, area_id, kind, difficulty_type, tag, and a shape box).
Within a batch they apply in order of seq; the set is a versioned table, so that a batch repeated after a failure
writes the same version again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATE = "area_id string, kind string, difficulty_type string, tag string, box struct<min_lat:double,min_lon:double,max_lat:double,max_lon:double>, seq long"


def apply(state: DataFrame, commands: DataFrame) -> DataFrame:
    """The set after commands: an area lives if no later command removes it; of several adds of an id the last counts."""
    adds = commands.where("op = 'add'").select("area_id", "kind", "difficulty_type", "tag", "box", "seq")
    both = state.unionByName(adds)
    latest = both.withColumn("__r", F.row_number().over(Window.partitionBy("area_id").orderBy(F.col("seq").desc()))).where("__r = 1").drop("__r")
    gone = commands.where("op = 'remove'").groupBy("area_id").agg(F.max("seq").alias("gone"))
    tags = commands.where("op = 'remove_tag'").groupBy("tag").agg(F.max("seq").alias("tag_gone"))
    clear = commands.where("op = 'clear'").agg(F.max("seq").alias("clear"))
    out = latest.join(gone, "area_id", "left").join(tags, "tag", "left").join(F.broadcast(clear), how="cross")  # clear: one row
    return out.where("seq > coalesce(gone, -1) and seq > coalesce(tag_gone, -1) and seq > coalesce(clear, -1)").select(
        "area_id", "kind", "difficulty_type", "tag", "box", "seq",
    )


def maintain(commands: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None):
    """Starts a query that keeps the live set below ``path``, a folder a batch; ``then`` gets each new set."""
    spark = commands.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        state = spark.read.schema(STATE).parquet(f"{path}/{number - 1}") if number else spark.createDataFrame([], STATE)
        apply(state, batch).write.mode("overwrite").parquet(f"{path}/{number}")
        if then:
            then(spark.read.schema(STATE).parquet(f"{path}/{number}"), number)

    return commands.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
