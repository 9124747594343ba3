"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment on words.

Words are runs of letters, digits and marks, lower-cased. Every n-gram of a test item is
counted over all documents; an item's seeds are its n-grams found in few documents, its rarest
half whatever their counts, and all n-grams with no rare one beside them, so that every part
of an item copied everywhere has seeds. A document
holding a seed is aligned with the item around it; copies with words replaced, inserted or
dropped still align. The score is the alignment's part of the item's self-alignment.

A part of a short item identifies nothing, so an item of fewer than ``least`` words matches exactly: a
document that holds all its words in a row, or, where it is shorter than an n-gram, a document
that has no other words.

Test items are read in blocks of bounded size (``block_mb``); each block is an index that
every task holds, and every document meets every block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.common import landed

_WORDS = re.compile(r"\w+").findall


@dataclass(frozen=True)
class Options:
    """n: words of a seed; rare: largest share of documents of a seed; least: words of an item that is
    aligned, shorter ones match exactly; threshold: least share of the item's self-alignment;
    match, mismatch, gap: alignment scores; block_mb: test text held by a task at once."""

    n: int = 3
    rare: float = 0.001
    least: int = 8
    threshold: float = 0.4
    match: int = 2
    mismatch: int = -1
    gap: int = 1
    block_mb: int = 32


def words(text: str) -> list[str]:
    """The words of a text."""
    return _WORDS(text.lower())


@dataclass
class Items:
    """A block of test items: vocabulary, word ids, and n-grams with (item, place) of each use."""

    options: Options
    ids: list = field(default_factory=list)
    vocabulary: dict = field(default_factory=dict)
    seqs: list = field(default_factory=list)
    grams: np.ndarray = None  # sorted distinct n-gram keys
    gram_of: np.ndarray = None  # of each use
    item_of: np.ndarray = None
    place_of: np.ndarray = None
    whole: dict = field(default_factory=dict)  # items shorter than an n-gram by their word ids
    exact: list = field(default_factory=list)  # whether an item matches exactly only

    @classmethod
    def of(cls, rows: list[tuple], options: Options) -> Items:
        out = cls(options)
        for item_id, text in rows:
            seq = words(text or "")
            if not seq:
                continue
            out.seqs.append(np.array([out.vocabulary.setdefault(w, len(out.vocabulary)) for w in seq], np.int64))
            out.exact.append(len(seq) < max(options.least, options.n))
            if len(seq) < options.n:
                out.whole.setdefault(tuple(out.seqs[-1].tolist()), []).append(len(out.ids))
            out.ids.append(item_id)
        keys = [out.keys(s)[: 1 if short else None] for s, short in zip(out.seqs, out.exact, strict=True)]
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        item = np.repeat(np.arange(len(keys)), [len(k) for k in keys]) if keys else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.zeros(0, np.int64)
        out.grams, gram = np.unique(flat, return_inverse=True)
        order = np.argsort(gram, kind="stable")
        out.gram_of, out.item_of, out.place_of = gram[order], item[order], place[order]
        return out

    def keys(self, seq: np.ndarray) -> np.ndarray:
        """Keys of the n-grams at each place; only meaningful where all their words are known."""
        n = len(seq) - self.options.n + 1
        key = np.zeros(max(0, n), np.int64)
        for k in range(self.options.n):
            key = key * np.int64(0x9E3779B97F4A7C1 | 1) + seq[k : k + max(0, n)] + 1
        return key

    def found(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gram, place) of every known n-gram in a document's word ids (-1: unknown word)."""
        n = len(seq) - self.options.n + 1
        if n <= 0 or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = seq >= 0
        whole = known[:n].copy()
        for k in range(1, self.options.n):
            whole &= known[k : k + n]
        at = np.flatnonzero(whole)
        key = self.keys(seq)[at]
        g = np.minimum(np.searchsorted(self.grams, key), len(self.grams) - 1)
        hit = self.grams[g] == key
        return g[hit], at[hit]

    def encode(self, text: str) -> np.ndarray:
        """Word ids of a document, -1 for words of no item."""
        get = self.vocabulary.get
        found = [get(w, -1) for w in words(text)]
        return np.array(found, np.int64)

    def seeds(self, df: np.ndarray, docs: int) -> np.ndarray:
        """Which uses of n-grams are seeds, given how many documents hold each n-gram."""
        use = df[self.gram_of]
        order = np.lexsort((self.place_of, use, self.item_of))
        rank = np.empty(len(use), np.int64)
        start = np.searchsorted(self.item_of[order], np.arange(len(self.ids)))
        rank[order] = np.arange(len(use)) - start[self.item_of[order]]
        total = np.bincount(self.item_of, minlength=len(self.ids))
        rare = use <= max(3, self.options.rare * docs)
        order = np.lexsort((self.place_of, self.item_of))
        near, item, few = np.zeros(len(use), bool), self.item_of[order], rare[order]
        for k in range(1, self.options.n):
            same = item[k:] == item[:-k]
            near[order[k:][same & few[:-k]]] = True
            near[order[:-k][same & few[k:]]] = True
        return rare | (2 * rank < total[self.item_of]) | ~near


def align(windows: np.ndarray, items: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each row pair: its score and the window place after its end.

    Rows are padded with -1 (windows) and -2 (items), which match nothing.
    """
    p, m = items.shape
    h = np.zeros((p, m + 1), np.int32)
    best, end = np.zeros(p, np.int32), np.zeros(p, np.int64)
    ramp = o.gap * np.arange(m + 1, dtype=np.int32)
    for i in range(windows.shape[1]):
        t = np.zeros((p, m + 1), np.int32)
        t[:, 1:] = np.maximum(h[:, :-1] + np.where(windows[:, i, None] == items, o.match, o.mismatch), h[:, 1:] - o.gap)
        np.maximum(t, 0, out=t)
        h = np.maximum.accumulate(t + ramp, axis=1) - ramp
        row = h.max(1)
        better = row > best
        best[better], end[better] = row[better], i + 1
    return best, end


def _padded(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), fill, np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def matches(items: Items, seed: np.ndarray, seqs: list[np.ndarray], pairs: int = 2048) -> Iterator[tuple[int, int, float, int, int]]:
    """(document's place in ``seqs``, item, score, first word, word after the last) of the best
    alignment of each pair that reaches the threshold; of equal ones, the first in the document."""
    o, tasks = items.options, []
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    seeds = np.flatnonzero(seed)
    first_use = np.searchsorted(items.gram_of[seeds], np.arange(len(items.grams) + 1))  # of gram g: first_use[g] to first_use[g + 1]
    short = np.array(items.exact, bool)
    for d, seq in enumerate(seqs):
        if 0 < len(seq) < o.n:
            best |= {(d, i): (1.0, 0, len(seq)) for i in items.whole.get(tuple(seq.tolist()), ())}
        g, at = items.found(seq)
        if not len(g):
            continue
        count = first_use[g + 1] - first_use[g]
        use = seeds[np.repeat(first_use[g], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        place = np.repeat(at, count)
        item = items.item_of[use]
        exact = short[item]
        for i, a in zip(item[exact].tolist(), place[exact].tolist(), strict=True):
            own = items.seqs[i]
            if (d, i) not in best and np.array_equal(seq[a : a + len(own)], own):
                best[d, i] = (1.0, a, a + len(own))
        use, place, item = use[~exact], place[~exact], item[~exact]
        slack = 4 + np.array([len(items.seqs[i]) // 4 for i in item], np.int64)
        cell = (place - items.place_of[use]) // slack
        for i, c in {(int(i), int(c)) for i, c in zip(item, cell, strict=True)}:
            s = 4 + len(items.seqs[i]) // 4
            first = max(0, (c - 1) * s)
            tasks.append((d, i, first, seq[first : (c + 2) * s + len(items.seqs[i])]))
    tasks.sort(key=lambda t: (len(t[3]), t[0], t[1], t[2]))
    for k in range(0, len(tasks), pairs):
        some = tasks[k : k + pairs]
        score, end = align(_padded([t[3] for t in some], -1), _padded([items.seqs[t[1]] for t in some], -2), o)
        share = score / (o.match * np.array([len(items.seqs[t[1]]) for t in some]))
        good = np.flatnonzero(share >= o.threshold)
        if not len(good):
            continue
        back = [some[q][3][: end[q]][::-1] for q in good]
        _, length = align(_padded(back, -1), _padded([items.seqs[some[q][1]][::-1] for q in good], -2), o)
        for q, n in zip(good.tolist(), length.tolist(), strict=True):
            d, i, first, _ = some[q]
            last = first + int(end[q])
            found = (float(share[q]), last - n, last)
            if (d, i) not in best or (found[0], -found[1]) > (best[d, i][0], -best[d, i][1]):
                best[d, i] = found
    for (d, i), (share, a, b) in sorted(best.items()):
        yield d, i, share, a, b


def blocks(benchmark: DataFrame, options: Options, id_col: str, text: str) -> Iterator[Items]:
    """The test items, a block of bounded size at a time."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-total // (options.block_mb << 20)))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield Items.of(sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r)), options)


def frequencies(docs: DataFrame, items: Items, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each n-gram of the block is found, and how many documents there are."""
    held = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        df, n = np.zeros(len(own.grams) + 1, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                df[np.unique(own.found(own.encode(t))[0])] += 1
            n += batch.num_rows
        df[-1] = n
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["gram", "df"])

    source = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    out = np.zeros(len(items.grams) + 1, np.int64)
    for g, n in source.mapInArrow(count, "gram long, df long").groupBy("gram").agg(F.sum("df")).collect():  # no more rows than the block has n-grams
        out[g] = n
    return out[:-1], int(out[-1])


_FIELDS = [T.StructField("hits", T.ArrayType(T.StructType([
    T.StructField("item", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("first_word", T.IntegerType()), T.StructField("end_word", T.IntegerType()),
])))]


def _aligned(docs: DataFrame, items: Items, seed: np.ndarray, text: str, carry: list[str]) -> DataFrame:
    """``docs``' columns ``carry`` in the struct ``row``, and the array ``hits`` of the block's matches."""
    held = docs.sparkSession.sparkContext.broadcast((items, seed))
    packed = docs.select(
        F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in carry]).alias("row"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    kind = pa.struct([("item", pa.int32()), ("score", pa.float64()), ("first_word", pa.int32()), ("end_word", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_seed = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                hits: list[list] = [[] for _ in range(part.num_rows)]
                for d, i, share, a, b in matches(own, own_seed, [own.encode(t) for t in part.column(1).to_pylist()]):
                    hits[d].append({"item": i, "score": share, "first_word": a, "end_word": b})
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hits, pa.list_(kind))], ["row", "hits"])

    return packed.mapInArrow(run, T.StructType([packed.schema["row"], *_FIELDS]))


def leaks(docs: DataFrame, benchmark: DataFrame, options: Options = Options(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, score, first_word, end_word of every document and item that align.

    Null and empty texts match nothing; repeated rows each match; items of fewer than
    ``least`` words match exactly (see above); items without words never match, nor do items of an empty
    table; equal rows of the benchmark count once; of equally good places in a text the first is given; whole
    texts are read, however long; null ids stay; other columns are ignored, whatever their names.
    """
    spark, out = docs.sparkSession, None
    for items in blocks(benchmark, options, "item_id", "text"):
        seed = items.seeds(*frequencies(docs, items, text))
        names = spark.createDataFrame(
            [(k, v) for k, v in enumerate(items.ids)], T.StructType([T.StructField("item", T.IntegerType()), benchmark.schema["item_id"]]),
        )
        found = _aligned(docs, items, seed, text, [id_col]).select(F.col(f"row.{id_col}").alias(id_col), F.explode("hits").alias("hit"))
        part = found.select(id_col, "hit.*").join(F.broadcast(names), "item")  # a block's items
        part = part.select(id_col, "item_id", F.round("score", 6).alias("score"), "first_word", "end_word")
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, options: Options = Options(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that align with no item, all columns kept, whatever their names.

    Null and empty texts stay; repeated rows stay or go together; an empty table gives an empty
    result; an empty benchmark keeps every row; whole texts are read, however long.
    """
    out = docs
    for items in blocks(benchmark, options, "item_id", "text"):
        seed = items.seeds(*frequencies(docs, items, text))
        if out is not docs:
            out = landed(out, "decontaminated")
        out = _aligned(out, items, seed, text, docs.columns).where(F.size("hits") == 0).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return out
