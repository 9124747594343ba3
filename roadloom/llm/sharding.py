"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

DataFrame functions only. Every record hashes to one of thousands of slots for good: the hash
takes its id, size and text checksum, and its number among equal records, so that a record that
repeats is spread like any other. Only the slots' bytes are aggregated.

The map from slots to shards is a table of versions in the shared folder. Version 1 deals the slots
in turn, before any bytes are known; each later version edits the newest one by the slots' present
bytes. A shard above the mean gives away just enough of its smallest slots, which go, largest
first, to the lightest shard; all other slots stay. The fold that places them runs over at most
``slots`` elements, a fixed bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.llm.common import landed, scratch

#: Virtual slots. Fixed for the life of a corpus.
SLOTS = 4096
SHARDS = 8
#: Equal records that one task numbers at once.
RUN = 65_536

_MAP = "version int, virtual_slot long, shard int"


def sized(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and one; null text: 1), text_crc32 (null: as empty), virtual_slot, a row a record.

    Equal records are counted, not gathered: each group gives runs of at most ``RUN`` numbers, which
    are dealt out again before they become rows.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    size = (F.octet_length(raw).cast("long") + 1).alias("size")
    groups = docs.select(
        F.col(id_col).alias("id"), size, F.crc32(raw).alias("text_crc32"),
    ).groupBy("id", "size", "text_crc32").agg(F.count("*").alias("times"))
    runs = groups.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / float(RUN)))))
    dealt = runs.repartition("id", "size", "text_crc32", "run")
    last = F.least(F.col("times"), (F.col("run") + 1) * RUN) - 1
    rows = dealt.withColumn("nth", F.explode(F.sequence(F.col("run") * RUN, last)))
    key = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("size"), F.col("text_crc32"), F.col("nth"))
    slot = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % F.lit(slots)
    return rows.select(F.col("id").alias(id_col), "size", "text_crc32", slot.alias("virtual_slot"))


def weigh(rows: DataFrame) -> DataFrame:
    """Rows and bytes of each slot that has any."""
    return rows.groupBy("virtual_slot").agg(F.count("*").alias("slot_rows"), F.sum("size").alias("slot_bytes"))


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the map (version, virtual_slot, shard): the slots dealt in turn."""
    every = spark.range(slots).withColumnRenamed("id", "virtual_slot")
    return every.select(F.lit(1).alias("version"), "virtual_slot", (F.col("virtual_slot") % shards).cast("int").alias("shard"))


def _fold(items: Column, loads: Column) -> Column:
    """Places (bytes, slot) structs, in order, each onto the lightest shard (ties: the lowest)."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<slot:bigint,shard:int>>").alias("done"))

    def place(acc: Column, x: Column) -> Column:
        to = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        grown = F.transform(acc["loads"], lambda v, i: F.when(i == to, v + x["slot_bytes"]).otherwise(v))
        chosen = F.struct(x["virtual_slot"].alias("slot"), to.alias("shard"))
        return F.struct(grown.alias("loads"), F.concat(acc["done"], F.array(chosen)).alias("done"))

    return F.aggregate(items, start, place)["done"]


def newest(versions: DataFrame) -> DataFrame:
    """The rows of the newest version; each version has at most as many rows as there are slots."""
    last = versions.agg(F.max("version").alias("version"))
    return versions.join(F.broadcast(last), "version", "left_semi")  # one row


def rebalance(old: DataFrame, weights: DataFrame, shards: int) -> DataFrame:
    """The version after the newest of ``old``, for ``shards`` shards, no fewer than before, and the slots' present bytes.

    A slot without bytes weighs nothing and stays. A shard above the new mean gives away its
    smallest slots up to its surplus (equal ones: the lowest first).
    """
    latest = newest(old)
    held = latest.join(
        weights.select("virtual_slot", "slot_bytes"), "virtual_slot", "left",
    ).withColumn("slot_bytes", F.coalesce("slot_bytes", F.lit(0)))
    mean = weights.agg((F.coalesce(F.sum("slot_bytes"), F.lit(0)) / F.lit(float(shards))).alias("mean"))
    by_shard = Window.partitionBy("shard")
    given = F.sum("slot_bytes").over(by_shard.orderBy("slot_bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0))
    surplus = F.sum("slot_bytes").over(by_shard) - F.col("mean")
    marked = held.join(F.broadcast(mean), how="cross").withColumn("leaves", (F.col("slot_bytes") > 0) & (given <= surplus))  # one row
    kept = marked.where("not leaves")
    load = kept.groupBy("shard").agg(F.sum("slot_bytes").alias("load"))
    loads = load.agg(F.map_from_entries(F.collect_list(F.struct("shard", "load"))).alias("m"))  # a row a shard
    base = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long")))
    item = F.struct((-F.col("slot_bytes")).alias("order"), "virtual_slot", "slot_bytes")
    pool = marked.where("leaves").agg(F.array_sort(F.collect_list(item)).alias("items"))  # at most ``slots`` structs
    moved = pool.join(loads, how="cross").select(F.explode(_fold(F.col("items"), base)).alias("x"))  # one row each
    moved = moved.select(F.col("x.slot").alias("virtual_slot"), F.col("x.shard").alias("shard"))
    version = latest.agg((F.max("version") + 1).cast("int").alias("version"))
    return kept.select("virtual_slot", "shard").unionByName(moved).join(F.broadcast(version), how="cross").select("version", "virtual_slot", "shard")


class SlotMap:
    """The versions of a slot map, a Parquet folder each, written once and never changed."""

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS) -> None:
        self.spark, self.path, self.slots = spark, path.rstrip("/"), slots

    def versions(self) -> DataFrame | None:
        """Every version written so far, or none."""
        try:
            return self.spark.read.schema(_MAP).option("recursiveFileLookup", True).parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def put(self, rows: DataFrame) -> int:
        """Writes one version; returns its number. A version already there is an error, so that two editors can't both win."""
        rows = landed(rows, "slot-map")
        number = rows.agg(F.max("version")).first()[0]
        rows.coalesce(1).write.mode("error").parquet(f"{self.path}/v{number:08d}")
        return number

    def edited(self, weights: DataFrame, shards: int) -> DataFrame:
        """The newest version after an edit by the slots' present bytes; version 1 is made first where there is none.

        An edit that would move no slot is not written.
        """
        old = self.versions()
        if old is None:
            self.put(first_map(self.spark, shards, self.slots))
            old = self.versions()
        new = landed(rebalance(old, weights, shards), "slot-map")
        if not new.select("virtual_slot", "shard").exceptAll(newest(old).select("virtual_slot", "shard")).isEmpty():
            self.put(new)
        return newest(self.versions())


def assign(
    docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text: str = "text", map_path: str | None = None,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version of every row.

    The law is ``bytes``: the shards' sizes are near equal. ``map_path`` names the folder of the map's
    versions, which the call edits (default: a new one). ``slot`` numbers a shard's rows
    from 0 without gaps, by virtual slot, then id (nulls first), crc and size; repeated rows get a
    number each and are spread over the slots. Null and empty texts have size 1; a very long text weighs
    as its bytes and can't be cut; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = landed(sized(docs, slots, id_col, text), "sized")  # ids and sizes only
    weights = landed(weigh(rows), "slots")  # at most ``slots`` rows
    slot_map = SlotMap(spark, map_path or scratch(spark, "slot-versions"), slots).edited(weights, shards).join(weights, "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("offset")
    placed = landed(slot_map.select("virtual_slot", "shard", offset, F.col("version").alias("map_version")), "placed")
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(F.col(id_col).asc_nulls_first(), "text_crc32", "size"))
    out = rows.withColumn("within", within).join(F.broadcast(placed), "virtual_slot")  # at most ``slots`` rows
    number = (F.col("offset") + F.col("within") - 1).cast("long")
    return out.select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", number.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


#: The query's rows in DuckDB: the checksum by its polynomial, the first map, one edit of it, and the numbering.
ORACLE = f"""
with recursive poly as (select range as k, list_reduce(range(8), lambda a, x: case when (a & 1) = 1 then xor(a >> 1, 3988292384) else a >> 1 end, range) as v from range(256)),
tab as (select list(v order by k) as t from poly),
r as (select doc_id, octet_length(encode(coalesce(text, '')))::bigint + 1 as size,
    xor(list_reduce(list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda h: ('0x' || h)::bigint),
        lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295::bigint), 4294967295) as text_crc32 from documents, tab),
n as (select *, row_number() over (partition by doc_id, size, text_crc32) - 1 as nth from r),
s as (select doc_id, size, text_crc32, ('0x' || md5(concat_ws(':', coalesce(doc_id::varchar, ''), size, text_crc32, nth))[:8])::bigint % {SLOTS} as vs from n),
w as (select range as vs, (range % {SHARDS})::int as shard, coalesce(sum(size), 0)::bigint as b, count(size) as c from range({SLOTS}) left join s on s.vs = range group by range),
m as (select *, sum(b) over (partition by shard order by b, vs rows unbounded preceding) <= sum(b) over (partition by shard) - sum(b) over () / {SHARDS}e0 and b > 0 as leaves from w),
pool as (select row_number() over (order by b desc, vs) as i, vs, b from m where leaves),
loads as (select list(load order by shard) as l from (select shard, sum(case when leaves then 0 else b end)::bigint as load from m group by shard)),
fold as (select 0::bigint as i, l, null::bigint as vs, null::int as shard from loads
    union all select p.i, list_transform(f.l, lambda v, k: case when k = list_position(f.l, list_min(f.l)) then v + p.b else v end), p.vs, list_position(f.l, list_min(f.l))::int - 1
    from fold f join pool p on p.i = f.i + 1),
placed as (select vs, c, shard from m where not leaves union all select f.vs, m.c, f.shard from fold f join m on m.vs = f.vs),
o as (select vs, shard, sum(c) over (partition by shard order by vs rows unbounded preceding) - c as first from placed)
select doc_id, size, text_crc32, 'bytes' as law, shard, (first + row_number() over (partition by s.vs order by doc_id nulls first, text_crc32, size) - 1)::bigint as slot,
    null::int as grown_shard, s.vs as virtual_slot, case when exists (select 1 from pool) then 2 else 1 end as map_version
from s join o on o.vs = s.vs"""
