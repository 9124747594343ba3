"""Helpers shared by the text operators: tables in the shared folder, ids, words, Arrow mapping."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.operators.lineage import landed, scratch, shared_dir, swept

__all__ = [
    "SPACES", "WORD", "id_remainder", "landed", "map_text", "portions", "scratch", "shared_dir", "split_words", "swept", "table", "unused",
    "without_gc",
]

#: White space of the contracts: space and the controls from tab to carriage return.
SPACES = " \t\n\v\f\r"
#: A word of the contracts.
WORD = r"[^\x20\x09-\x0D]+"


def unused(name: str, *taken: str) -> str:
    """``name``, with underscores added until it equals none of ``taken``, whatever their case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def without_gc(fn: Callable) -> Callable:
    """``fn`` with the search for cycles paused: making many small lists would start it again and again."""

    @wraps(fn)
    def run(*args, **kwargs):
        was = gc.isenabled()
        gc.disable()
        try:
            return fn(*args, **kwargs)
        finally:
            if was:
                gc.enable()

    return run


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and where each text's words begin and end among them.

    Words are runs without ASCII white space; ``lower`` lower-cases A-Z.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    offsets -= offsets[0]
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty word
    if not some.all():
        words = words.filter(pa.array(some))
        offsets = np.concatenate([[0], np.cumsum(some)])[offsets]
    return words, offsets


def portions(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch cut into rows that together have about ``size`` bytes in a column of texts; a longer text is alone."""
    total = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        spent = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, spent + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def map_text(
    df: DataFrame,
    text: str,
    fn: Callable[[list[str]], list[pa.Array]],
    fields: list[T.StructField],
    carry: list[str] | None = None,
    rows: int = 512,
) -> DataFrame:
    """Adds to ``df`` the columns that ``fn`` makes of lists of texts (null: empty).

    ``carry`` names the columns to keep (default: all). They travel as one struct, so
    that their names may equal those of the new columns; new columns win. ``fn`` gets
    at most ``rows`` texts at once, which bounds its memory.
    """
    kept = [c for c in (df.columns if carry is None else carry) if c not in {f.name for f in fields}]
    packed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.struct(F.lit(0).alias("none")).alias("row"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    schema = T.StructType([packed.schema["row"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *out], ["row", *(f.name for f in fields)])

    mapped = packed.mapInArrow(run, schema)
    return mapped.select(*[F.col("row").getField(c).alias(c) for c in kept], *[F.col(f.name) for f in fields])
