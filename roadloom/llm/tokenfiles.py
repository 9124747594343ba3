"""Token-id files: documents tokenised, written by the range coder in id order, and read back.

Rows are range-partitioned by id, so that files follow each other in ascending id order; each
task cuts its rows into files of bounded size, written to the shared folder under a name of
their own and then moved, so that a repeated task leaves the same files. Where a file starts
among all ids follows from the files' counts, one row a file.

The tokenizers library encodes. Where the tokenizer file's own settings show that no piece
spans white space, each distinct word of a batch is encoded once, its new pieces in batches, and a task remembers pieces
up to a bound; any other tokenizer encodes whole texts, batch by batch.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm import idcoder
from roadloom.llm.common import landed, portions, scratch, split_words, without_gc
from roadloom.sources import store

#: The id put after each document; ids of a file; pieces whose ids a task remembers, at about 200 bytes each.
END, FILE_IDS, CACHE = 2, 4_000_000, 900_000

#: Bytes of text encoded together, and words whose ids are gathered at once.
TOGETHER, GATHER = 6 << 20, 1 << 16
#: The settings under which words are encoded alone: what the normaliser may do, and how it splits. Fixed values.
_NORMALISERS = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "})
_SPLITTERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Letters, apart from ASCII, whose case and pieces are known here: Latin ones that are letters in both cases.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_PLAIN = re.compile(f"[!-~{_LATIN}]+")
_ALL_PLAIN = re.compile(f"[!-~\n{_LATIN}]*")
#: The splitter's pieces of lower-case words of those letters, and the end of each line. Fixed pattern.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^\\sa-z0-9{_LATIN}]+|\n")


def _byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 as itself, others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def splits_at_spaces(settings: dict) -> bool:
    """Whether a tokenizer file's settings are those under which words can be encoded alone, by the rules above."""
    listed = lambda part, key: [] if part is None else part[key] if part["type"] == "Sequence" else [part]
    model = settings["model"]
    return (
        bool(model.get("end_of_word_suffix"))
        and all(n in _NORMALISERS for n in listed(settings.get("normalizer"), "normalizers"))
        and {"type": "Lowercase"} in listed(settings.get("normalizer"), "normalizers")
        and listed(settings.get("pre_tokenizer"), "pretokenizers") == _SPLITTERS
        and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and settings.get("truncation") is None
        and all(t["special"] and t["content"].startswith("<|") and not re.search(r"\s", t["content"]) for t in settings.get("added_tokens", ()))
    )


#: What stands for no ids: nothing, and the end of a word among pieces.
_NOTHING = {"": b"", "\n": b""}


class _Pieces(dict):
    """Ids of pieces as bytes, by the library's model; emptied when full, so that its size is bounded."""

    def __init__(self, tokenizer) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(_NOTHING)
        self.spelling = {b: c for b, c in enumerate(_byte_letters()) if b != 32}  # a space parts pieces
        self.suffix = tokenizer.model.end_of_word_suffix
        self.model = Tokenizer(tokenizer.model)  # the same merges on pieces that are split and spelt already
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        names = [tokenizer.id_to_token(k) or "" for k in range(tokenizer.get_vocab_size())]
        self.last = np.array([bool(self.suffix) and n.endswith(self.suffix) for n in names])  # ids that end a piece

    def learn(self, *pieces: list[str]) -> None:
        """Remembers the ids of all of ``pieces``."""
        known = self.__contains__
        new = list(set(chain.from_iterable(filterfalse(known, some) for some in pieces)))
        if len(self) + len(new) > CACHE:
            self.clear()
            self.update(_NOTHING)
            new = list(set(chain.from_iterable(filterfalse(known, some) for some in pieces)))
        plain, other = list(filter(str.isascii, new)), list(filterfalse(str.isascii, new))
        new = plain + other
        lists = [" ".join(plain[at : at + 2000]) for at in range(0, len(plain), 2000)]
        spelt = (" ".join(other[at : at + 2000]) for at in range(0, len(other), 2000))
        lists += [t.encode().decode("latin-1").translate(self.spelling) for t in spelt]
        found = [np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(lists, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.zeros(0, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(new) or (len(ids) and ends[-1] != len(ids)):
            raise ValueError("a piece's last id doesn't tell its end")
        raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        self.update(zip(new, map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=True))


class Encoder:
    """Encodes whole texts, a batch at a time."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = splits_at_spaces(json.load(f))
        self.pieces = _Pieces(self.tokenizer) if self.by_word else None

    def whole(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit, as the library gives them."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each of many distinct words begin, and how many each has."""
        joined, odd, every = "\n".join(words), [], words
        if not _ALL_PLAIN.fullmatch(joined) or "<|" in joined:  # other letters, or what may be an added token
            odd = [k for k, w in enumerate(words) if not _PLAIN.fullmatch(w) or "<|" in w]
            every = list(words)
            for k in odd:
                every[k] = ""
            joined = "\n".join(every)
        low = joined.lower().split("\n")
        mixed = np.flatnonzero(~np.fromiter(map(str.isalpha, low), bool, len(low)))
        of_mixed = [low[k] for k in mixed.tolist()]
        for k in mixed.tolist():
            low[k] = ""
        parts = _PIECES.findall("".join([w + "\n" for w in of_mixed]))
        pieces = self.pieces
        pieces.learn(low, parts)
        get, whole = pieces.__getitem__, self.whole([words[k] for k in odd])
        raw = [*map(get, low), *map(get, parts), *whole]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) >> 2
        first = np.cumsum(sizes) - sizes
        n = len(low)
        at, size = first[:n], sizes[:n]
        if len(mixed):  # a word's pieces follow each other, up to one without ids
            ends = n + np.flatnonzero(sizes[n : n + len(parts)] == 0)
            begins = np.append(n, ends[:-1] + 1)
            at[mixed], size[mixed] = first[begins], first[ends] - first[begins]
        at[odd], size[odd] = first[n + len(parts) :], sizes[n + len(parts) :]
        return np.frombuffer(b"".join(raw), "<u4"), at, size

    @without_gc
    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, ``end`` after each, one after another, and how many each text has."""
        mark = end.to_bytes(4, "little")
        if not self.by_word:
            raw = [r + mark for r in self.whole(texts.to_pylist())]
            return np.frombuffer(b"".join(raw), "<u4"), np.array([len(r) // 4 for r in raw], np.int64)
        marked = pc.any(pc.match_substring(texts, "<|")).as_py()  # added tokens are told by their case
        flat, offsets = split_words(texts, lower=not marked)
        coded = flat.dictionary_encode()
        pool, first, sizes = self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist() if len(flat) else [])
        pool, first, sizes = np.append(pool, np.uint32(end)), np.append(first, len(pool)), np.append(sizes, 1)
        n = len(texts)
        ends = offsets[1:] + np.arange(n)
        entry = np.full(len(flat) + n, len(sizes) - 1, np.int32)  # of each word, and of each text's end, its place in ``sizes``
        is_word = np.ones(len(entry), bool)
        is_word[ends] = False
        entry[is_word] = coded.indices.to_numpy()
        size, codes = np.empty(len(entry), np.int64), []
        for at in range(0, len(entry), GATHER):  # in steps that stay in the processor's cache
            some = entry[at : at + GATHER]
            mine = size[at : at + GATHER] = sizes.take(some)
            total = np.cumsum(mine)
            take = np.repeat(first.take(some) - (total - mine), mine)
            take += np.arange(len(take))
            codes.append(pool.take(take))
        lengths = np.add.reduceat(size, np.append(0, ends[:-1] + 1)) if n else np.zeros(0, np.int64)
        return (np.concatenate(codes) if codes else np.zeros(0, "<u4")), lengths


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, one a process; a task is one core, so the library makes no threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def default_tokenizer() -> str:
    """The public lower-case word-end tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write(
    docs: DataFrame, folder: str, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS,
) -> DataFrame:
    """Writes ``docs`` as token files below ``folder``; returns (part, seq, path, n_docs, n_ids, bytes), a row a file.

    Documents go in ascending id order, null ids first, equal ids by their text's crc. Null texts count as empty.
    """
    tokenizer = tokenizer or default_tokenizer()
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), body).withColumn("crc", F.crc32(F.col("text").cast("binary")))
    order = (F.col("id").asc_nulls_first(), F.col("crc").asc())
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def put(part: int, seq: int, ids: list, lengths: list[np.ndarray], codes: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.concatenate(lengths)
        data = idcoder.pack(ids, sizes, np.concatenate(codes))
        name = f"part-{part:06d}-{seq:04d}.tokens"
        store.written(folder, name, data)
        row = (part, seq, name, len(ids), int(sizes.sum()), len(data))
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "seq", "path", "n_docs", "n_ids", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, lengths, codes, held = [], [], [], 0
        for batch in batches:
            for some in portions(batch, 1, TOGETHER):
                code, sizes = enc.encode(some.column(1), END)
                ids += some.column(0).to_pylist()
                lengths.append(sizes)
                codes.append(code)
                held += len(code)
                if held >= file_ids:
                    yield put(part, seq, ids, lengths, codes)
                    ids, lengths, codes, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield put(part, seq, ids, lengths, codes)

    return dealt.select("id", "text").mapInArrow(run, "part long, seq long, path string, n_docs long, n_ids long, bytes long")


def read(spark, folder: str) -> DataFrame:
    """(path, place, id, at, n_tokens, ids_crc32) of every document of the token files below ``folder``; ``at`` counts a file's ids before it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                f = idcoder.unpack(batch.column(1)[k].as_py())
                at = np.concatenate([[0], np.cumsum(f.lengths)])
                raw = memoryview(f.ids.tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                name = batch.column(0)[k].as_py().rsplit("/", 1)[1]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * n, pa.string()), pa.array(np.arange(n)), pa.array(f.doc_ids, pa.int64()), pa.array(at[:-1]),
                        pa.array(f.lengths), pa.array(crcs, pa.int64()),
                    ],
                    ["path", "place", "id", "at", "n_tokens", "ids_crc32"],
                )

    return files.mapInArrow(run, "path string, place long, id long, at long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of ``docs``, as read back from its token files.

    Null and empty texts have only the end id; a very long text is one document in one file; repeated rows and null
    ids each give a row (null ids first, equal ids by their text's checksum); other
    columns are ignored, whatever their names; an empty table writes no file and gives no row.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    written = landed(write(docs, folder, tokenizer, id_col, text), "token-files")
    if written.isEmpty():
        return spark.createDataFrame([], f"{id_col} long, start long, n_tokens long, ids_crc32 long")
    before = F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    starts = written.select("path", F.coalesce(before, F.lit(0)).alias("first"))
    out = read(spark, folder).join(starts, "path")
    return out.select(F.col("id").alias(id_col), (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
