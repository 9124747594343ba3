"""Language-model scores of whole documents: corpus counts and a gated recurrent model.

Counts of all training tokens are aggregated over the whole corpus. The most frequent
words, at most ``LISTED``, go to every task; counts of all others stay distributed and meet
the documents' remaining words in an equality join. Documents are turned into numbers once.

The recurrent model learns from every training token: each task trains a copy on documents of
about ``SHARD`` tokens, and the copies are averaged in blocks of parameters, weighted by the tokens they saw; a
further round, if ``rounds`` asks for one, starts from the average. Scoring carries each document's state through
all its windows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm import gru
from roadloom.llm.common import id_remainder, landed, portions, split_words, without_gc

#: Words whose counts every task holds, and words of the model.
LISTED, MODEL = 65_536, gru.WIDTH * gru.CLASSES
#: Tokens of a copy; rounds over all training tokens; step size.
SHARD, ROUNDS, RATE = 2_000_000, 1, 0.2
#: Distinct words of a task's counter, bytes of text and tokens handled together, parameters of an averaging block.
COUNTER, BYTES, TOGETHER, CHUNK = 400_000, 4 << 20, 1_000_000, 4096
#: The token after each document; no word is empty.
END = b""


@dataclass
class Vocabulary:
    """The listed words by falling count, and the totals of the corpus."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int

    def __post_init__(self) -> None:
        self.place = {w: k for k, w in enumerate(self.words)}
        n = len(self.words)
        self.listed_mass = int(self.counts[MODEL:].sum())
        self.rare_mass = self.total - int(self.counts.sum())
        self.rare_distinct = self.distinct - n
        self.log_base = np.append(np.log10(self.counts + 0.5), 0.0)
        k = np.arange(n + 1)
        model, listed = k < MODEL, (k >= MODEL) & (k < n)
        if n < MODEL:
            model[n] = False
        self.klass = np.where(model, k // gru.WIDTH, np.where(listed, gru.CLASSES, gru.CLASSES + 1))
        self.target = np.where(model, k, 0)
        bucket = [MODEL + zlib.crc32(w) % gru.BUCKETS for w in self.words[MODEL:]]
        self.input = np.append(np.concatenate([np.arange(min(n, MODEL)), np.array(bucket, np.int64)]), 0).astype(np.int64)
        share = np.zeros(n + 1)
        if self.listed_mass:
            share[:n][listed[:n]] = np.log10(self.counts[listed[:n]] / self.listed_mass)
        self.log_listed = share

    def start(self) -> gru.Gru:
        return gru.Gru.start(self.counts[:MODEL].astype(float), self.listed_mass, self.rare_mass + 0.5 * (self.rare_distinct + 1))

    @property
    def log_total(self) -> float:
        return math.log10(self.total + 0.5 * (self.distinct + 1))

    @property
    def log_rare(self) -> float:
        return math.log10(self.rare_mass + 0.5 * (self.rare_distinct + 1))

    @without_gc
    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
        """All texts' codes, one after another, their lengths, and lists of each text's unlisted words and of their counts.

        A listed word's code is its place; any other's is the number of listed words and a bucket.
        """
        words, offsets = split_words(texts, lower=True)
        n, none, get = len(texts), len(self.words), self.place.get
        words = pa.concat_arrays([words.cast(pa.binary()), pa.array([END], pa.binary())])
        coded = words.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        code = np.array([get(w, -1) for w in names], np.int64)
        rare = np.flatnonzero(code < 0)
        code[rare] = [none + zlib.crc32(names[r]) % gru.BUCKETS for r in rare.tolist()]
        which = coded.indices.to_numpy().astype(np.int64)
        ends = offsets[1:] + np.arange(n)
        entry = np.full(len(which) - 1 + n, which[-1])
        is_word = np.ones(len(entry), bool)
        is_word[ends] = False
        entry[is_word] = which[:-1]
        codes, lengths = code[entry], np.diff(offsets) + 1
        at = np.flatnonzero(codes >= none)
        pairs, times = np.unique(np.repeat(np.arange(n), lengths)[at] * len(names) + entry[at], return_counts=True)
        cuts = pa.array(np.searchsorted(pairs, np.arange(n + 1) * len(names)).astype(np.int32))
        unlisted = coded.dictionary.take(pa.array(pairs % len(names)))
        return codes, lengths, pa.ListArray.from_arrays(cuts, unlisted), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int64)))

    def places(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code; that of an unlisted word is the number of listed words."""
        return np.minimum(codes, len(self.words))

    def inputs(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What the model reads before each token: the token before it, or the start."""
        none = len(self.words)
        own = np.where(codes < none, self.input[np.minimum(codes, none)], MODEL + codes - none)
        out = np.empty_like(own)
        out[1:] = own[:-1]
        out[np.cumsum(lengths) - lengths] = MODEL + gru.BUCKETS
        return out


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c): how often each token occurs in ``docs``; the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[bytes, int] = {}

        def give() -> Iterator[pa.RecordBatch]:
            words, counts = list(tally), list(tally.values())
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[at : at + 50_000], pa.binary()), pa.array(counts[at : at + 50_000], pa.int64())], ["word", "c"],
                )
            tally.clear()

        for batch in batches:
            for part in portions(batch, 0, BYTES):
                found = split_words(part.column(0), lower=True)[0].value_counts()
                names = found.field("values").cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
                get = tally.get
                tally.update({w: c + get(w, 0) for w, c in zip(names, found.field("counts").to_numpy().tolist(), strict=True)})
                tally[END] = get(END, 0) + part.num_rows
                if len(tally) > COUNTER:
                    yield from give()
        yield from give()

    return _texts(docs, text).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, listed: int = LISTED) -> Vocabulary:
    """The most frequent words of a (word, c) table, at most ``listed``, and its totals.

    A histogram of counts in bins of a sixteenth of an octave gives the least count whose words, with all
    more frequent ones, still fit; only those words come to the driver.
    """
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    bins = counts.groupBy(F.floor(F.log2("c") * 16).alias("bin")).agg(
        F.count("*").alias("n"), F.min("c").alias("least"),
    ).orderBy(F.col("bin").desc()).collect()  # at most 16 x 63 rows
    limit, room = None, listed
    for r in bins:
        room -= r["n"]
        if room < 0:
            break
        limit = r["least"]
    top = counts.where(F.col("c") >= limit).collect() if limit is not None else []
    top = sorted(((bytes(r["word"]), r["c"]) for r in top), key=lambda r: (-r[1], r[0]))
    return Vocabulary([w for w, _ in top], np.array([c for _, c in top], np.int64), total, distinct)


def _shard(vocab: Vocabulary, flat: np.ndarray, codes: np.ndarray, lengths: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    places = vocab.places(codes)
    model, seen = gru.train(vocab.start().filled(flat), vocab.inputs(codes, lengths), vocab.target[places], vocab.klass[places], lengths, RATE, seed)
    return model.flat(), seen


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list array's values and lengths."""
    return lists.flatten().to_numpy().astype(np.int64), np.diff(np.asarray(lists.offsets)).astype(np.int64)


#: A block of a copy's parameters times the tokens it saw; lots keep the first sums small.
_PARTS = "part int, lot int, weight long, sums binary"


def _learner(held, k: int):
    """Trains one shard's copy from the broadcast model, in round ``k``."""

    def learn(t: pa.Table) -> pa.Table:
        words, flat = held.value
        t = t.sort_by("uid")
        shard = t.column("shard")[0].as_py()
        new, seen = _shard(words, flat, *_flat(t.column("codes").combine_chunks()), 97 * k + shard)
        rows = [(new[at : at + CHUNK].astype("<f8") * seen).tobytes() for at in range(0, len(new), CHUNK)]
        n = len(rows)
        return pa.table({
            "part": pa.array(range(n), pa.int32()), "lot": pa.array([shard % 64] * n, pa.int32()),
            "weight": pa.array([seen] * n, pa.int64()), "sums": pa.array(rows, pa.binary()),
        })

    return learn


def _added(t: pa.Table) -> pa.Table:
    total = sum((np.frombuffer(s, "<f8") for s in t.column("sums").to_pylist()), np.zeros(1))
    weight = sum(t.column("weight").to_pylist())
    return pa.table({
        "part": pa.array(t.column("part").to_pylist()[:1], pa.int32()), "lot": pa.array([0], pa.int32()),
        "weight": pa.array([weight], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary()),
    })


def fit(coded: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> gru.Gru:
    """Trains the model on all rows of a landed (uid, codes) table, averaging the copies of all shards after each round.

    A row's shard is a hash of its number, so that equal rows are spread like any others.
    """
    model = vocab.start()
    if not vocab.total:
        return model
    shards = max(1, round(vocab.total / SHARD))
    every = coded.select("uid", "codes", F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"))
    for k in range(rounds):
        held = coded.sparkSession.sparkContext.broadcast((vocab, model.flat()))  # bounded by the model's and the list's sizes
        copies = every.groupBy("shard").applyInArrow(_learner(held, k), _PARTS)
        means = copies.groupBy("part", "lot").applyInArrow(_added, _PARTS).groupBy("part").applyInArrow(_added, _PARTS).orderBy("part").collect()  # one model
        if not means:
            break
        model = model.filled(np.concatenate([np.frombuffer(r["sums"], "<f8") / max(1, r["weight"]) for r in means]))
    return model


_CODED = [
    T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("rare", T.ArrayType(T.BinaryType())),
    T.StructField("times", T.ArrayType(T.LongType())),
]


def encoded(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document, its id in the struct ``row``, its codes, and its unlisted words with their counts."""
    held = docs.sparkSession.sparkContext.broadcast(vocab)
    packed = docs.select(F.struct(F.col(id_col)).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1, BYTES):
                codes, lengths, rare, times = held.value.encode(part.column(1))
                ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                columns = [part.column(0), pa.ListArray.from_arrays(ends, pa.array(codes.astype(np.int32))), rare, times]
                yield pa.RecordBatch.from_arrays(columns, ["row", *(f.name for f in _CODED)])

    return packed.mapInArrow(run, T.StructType([packed.schema["row"], *_CODED]))


_SCORES = "uid long, n_tokens long, known long, base double, log10p double"


def _scored(coded: DataFrame, vocab: Vocabulary, model: gru.Gru) -> DataFrame:
    """Per row of a landed (uid, codes) table, what the listed words and the model give."""
    held = coded.sparkSession.sparkContext.broadcast((vocab, model.flat()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat = held.value
        own = words.start().filled(flat)
        none = len(words.words)

        def give(wait: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(wait).combine_chunks()
            codes, lengths = _flat(rows.column(1).chunk(0))
            places = words.places(codes)
            logp = gru.score(own, words.inputs(codes, lengths), words.target[places], words.klass[places], lengths) / math.log(10)
            who = np.repeat(np.arange(len(lengths)), lengths)
            total = lambda x: np.bincount(who, x, len(lengths))
            logp += total(words.log_listed[places])
            columns = [
                rows.column(0).chunk(0), pa.array(lengths), pa.array(total(places < none).astype(np.int64)),
                pa.array(total(words.log_base[places])), pa.array(logp),
            ]
            return pa.RecordBatch.from_arrays(columns, ["uid", "n_tokens", "known", "base", "log10p"])

        wait: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                wait.append(part)
                offsets = part.column(1).offsets
                size += offsets[len(part)].as_py() - offsets[0].as_py()
                if size > TOGETHER:
                    yield give(wait)
                    wait, size = [], 0
        if wait:
            yield give(wait)

    return coded.select("uid", "codes").mapInArrow(run, _SCORES)


def score_documents(docs: DataFrame, modulus: int = 5, held: int = 1, id_col: str = "doc_id", text: str = "text", listed: int = LISTED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    Learns only from rows whose crc32(doc_id as text) mod ``modulus`` isn't ``held``. Null and empty
    texts are one end token; whole texts are scored, however long; repeated rows each count and get a row, and equal
    texts get equal scores; null ids count as the
    empty id; other columns are ignored, whatever their names; without training rows every
    score and base_score is that of a corpus of no tokens; an empty table gives an empty result.
    """
    train = docs.where(id_remainder(F.col(id_col), modulus) != held)
    counts = landed(count_tokens(train, text), "token-counts")
    vocab = vocabulary(counts, listed)
    coded = encoded(docs, vocab, id_col, text).withColumn("uid", F.monotonically_increasing_id())
    coded = landed(coded.withColumn("out", id_remainder(F.col("row").getField(id_col), modulus) == held), "lm-codes")
    model = fit(coded.where(~F.col("out")), vocab)
    head = landed(_scored(coded, vocab, model), "lm-scores")
    words = coded.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "uid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"),
    )
    c = F.coalesce(F.col("c"), F.lit(0))
    sums = (
        words.join(counts, "word", "left").groupBy("uid")
        .agg(
            F.sum(F.col("times") * F.log10(c + 0.5)).alias("rare_log"), F.sum("times").alias("n_rare"),
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    whole = coded.select(
        "uid", F.col("row").getField(id_col).alias(id_col), "out",
    ).join(head, "uid").join(sums, "uid", "left").fillna(0, ["rare_log", "n_rare", "rare_known"])
    base = F.col("base") + F.col("rare_log") - F.col("n_tokens") * F.lit(vocab.log_total)
    score = F.col("log10p") + F.col("rare_log") - F.col("n_rare") * F.lit(vocab.log_rare)
    return whole.select(
        id_col, F.col("out").alias("held_out"), "n_tokens", (F.col("known") + F.col("rare_known")).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"),
    )
