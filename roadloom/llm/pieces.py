"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model file, each a table of arcs:

* the normaliser: a first arc that reads nothing and writes the meta symbol, then an arc from a space to the meta
  symbol, and from any other character to itself;
* the pieces: a trie whose final arcs write a piece and return to the start;
* byte fallback: an arc from each byte to its piece; a character that is no piece is read as its UTF-8 bytes.

A text is a linear acceptor. Composed with the normaliser, which is deterministic, it is again linear; the
composition with pieces and fallback is made on demand, and the output is that of its shortest path in the tropical semiring
(min, +), found by relaxing arcs until the final state's distance is known.

In a unigram model a piece's arc weighs its negative score. A byte-pair model isn't additive in its
scores: there a state also holds the last piece, and an arc weighs one for a piece that may follow it, and infinity for one that
may not, where b may follow a if merging the string ab by the model's priorities gives a, b. A
sequence whose neighbours may all follow each other is the model's encoding, and there is only
one, so a text has one path of finite weight.

A piece never spans two neighbouring characters that no piece holds side by side, so a text is cut between such, and
each distinct cut of a batch is composed once, in a cache of bounded size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.common import portions, without_gc

META = "▁"
#: Cached cuts and pair weights of a task; bytes of text encoded together. (A cut and its ids take about 200 bytes, a pair 270.)
CUTS, PAIRS, TOGETHER = 250_000, 120_000, 1 << 20


#: A label that reads nothing.
EPSILON = ""


class Normaliser:
    """The normaliser's machine: arcs out of its first state and of the state that loops; other characters copy."""

    def __init__(self, prefix: str, spaces: str) -> None:
        self.first = {EPSILON: prefix}
        self.loop = {" ": spaces}

    def compose(self, text: str) -> str:
        """The output for a text: the arcs are deterministic, so there is one. The empty text is accepted in the first state."""
        if not text:
            return ""
        for label, output in self.loop.items():
            text = text.replace(label, output)
        return self.first[EPSILON] + text


class Fallback:
    """The byte machine: an arc of ``weight`` from each byte to its piece, or, in a model without byte pieces, to the unknown piece."""

    def __init__(self, pieces: list[int] | None, unknown: int, weight: float) -> None:
        self.arcs, self.unknown, self.weight = pieces, unknown, weight

    def compose(self, character: str) -> list[int]:
        """The output for a character."""
        return [self.unknown] if self.arcs is None else [self.arcs[b] for b in character.encode("utf-8", "surrogatepass")]


class Transducer:
    """The compiled machines of one model file."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only the identity normaliser with escaped spaces is compiled")
        self.prefix = META if spec.add_dummy_prefix else ""
        self.normaliser = Normaliser(self.prefix, META)
        self.additive = proto.trainer_spec.model_type == 1
        kinds = [p.type for p in proto.pieces]
        self.text = [p.piece for p in proto.pieces]
        self.score = [p.score for p in proto.pieces]
        self.unk = kinds.index(2)
        self.id_of = {p: k for k, p in enumerate(self.text) if kinds[k] in (1, 4)}
        self.bytes = [self.text.index(f"<0x{b:02X}>") for b in range(256)] if 6 in kinds else None
        self.trie: dict = {}
        for p, k in self.id_of.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = k
        self.fallback = Fallback(self.bytes, self.unk, 10 - min(self.score))
        #: What each id decodes to; control pieces to nothing, the unknown piece to its surface.
        surface = {2: (proto.trainer_spec.unk_surface or " ⁇ ").encode(), 3: b""}
        self.output = [bytes([int(p[3:5], 16)]) if t == 6 else surface.get(t, p.replace(META, " ").encode()) for p, t in zip(self.text, kinds, strict=True)]
        self.cuts = _Cache(self._cut, CUTS)
        self.follows = _Cache(self._follows, PAIRS)
        self._compile_cuts()

    def _compile_cuts(self) -> None:
        """Which characters may be neighbours in a piece: classes of characters, and a table of pairs of classes."""
        letters = sorted({c for p in self.id_of for c in p if len(p) > 1})
        self.classes = np.zeros(0x110000, np.uint16)  # 0: a character of no longer piece
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        number = {c: k for k, c in enumerate(letters, 1)}
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in self.id_of:
            for a, b in zip(p, p[1:], strict=False):
                self.joined[number[a], number[b]] = True
        if not self.bytes:  # neighbouring unknown characters become one piece
            self.joined[0, 0] = True

    def arcs(self, s: str, at: int) -> list[tuple[int, int]]:
        """(end, piece) of the pieces at a place of the input, longest first; without any, the fallback arc (piece -1)."""
        node, out, end = self.trie, [], at
        for c in s[at:]:
            node = node.get(c)
            if node is None:
                break
            end += 1
            if "" in node:
                out.append((end, node[""]))
        if not out or out[0][0] != at + 1:
            if s[at] not in self.id_of:
                out.insert(0, (at + 1, -1))
        out.reverse()
        return out

    def _follows(self, pair: tuple[str, str]) -> bool:
        """Whether merging a + b by priority ends in a, b."""
        a, b = pair
        parts, get, score = list(a + b), self.id_of.get, self.score
        while True:
            best, where = -inf, -1
            for k in range(len(parts) - 1):
                found = get(parts[k] + parts[k + 1])
                if found is not None and score[found] > best:
                    best, where = score[found], k
            if where < 0:
                return parts == [a, b]
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def shortest(self, s: str) -> list[tuple[int, str]]:
        """The shortest path's (piece, string read) over a normalised string; piece -1: fallback.

        The generic shortest-distance algorithm: an arc is relaxed when its state leaves the queue. The queue's order
        doesn't change the result. In a unigram model it goes by position, so that no state is queued twice. In a byte-pair model the last
        state comes first, and the search ends at the final state, as no second finite path exists.
        """
        return self._by_position(s) if self.additive else self._by_depth(s)

    def _by_position(self, s: str) -> list[tuple[int, str]]:
        distance, back = [0.0] + [inf] * len(s), [(0, 0)] * (len(s) + 1)
        for at in range(len(s)):
            if distance[at] < inf:
                for end, k in self.arcs(s, at):
                    d = distance[at] + (self.fallback.weight if k < 0 else -self.score[k])
                    if d < distance[end]:
                        distance[end], back[end] = d, (at, k)
        path, at = [], len(s)
        while at:
            before, k = back[at]
            path.append((k, s[before:at]))
            at = before
        return path[::-1]

    def _by_depth(self, s: str) -> list[tuple[int, str]]:
        n, follows = len(s), self.follows
        start = (0, -2)
        distance, back, arcs_at = {start: 0.0}, {}, {}
        queue = [(start, "", iter(self.arcs(s, 0)))]  # states, with the arcs that aren't relaxed yet
        while queue:
            state, last, arcs = queue[-1]
            at, piece = state
            d = distance[state] + 1.0
            for end, k in arcs:
                target = (end, k)
                if d >= distance.get(target, inf):
                    continue
                read = s[at:end]
                if piece >= 0 and k >= 0 and not follows[last, read]:
                    continue  # the arc's weight is infinite
                distance[target], back[target] = d, state
                if end not in arcs_at:
                    arcs_at[end] = self.arcs(s, end) if end < n else ()
                queue.append((target, read, iter(arcs_at[end])))
                break
            else:
                queue.pop()
                continue
            if end == n:
                break
        path, state = [], target
        while state != start:
            before = back[state]
            path.append((state[1], s[before[0] : state[0]]))
            state = before
        return path[::-1]

    def _cut(self, s: str) -> bytes:
        out: list[int] = []
        for k, read in self.shortest(s) if s else ():
            some = [k] if k >= 0 else self.fallback.compose(read)
            if some != [self.unk] or not out or out[-1] != self.unk:  # neighbouring unknown characters are one piece
                out += some
        return np.array(out, "<u4").tobytes()

    def cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The cuts of the normaliser's outputs, one after another, and how many each text has."""
        linear = [self.normaliser.compose(t) for t in texts]
        whole = "".join(linear)
        if not whole:
            return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = self.classes[points]
        begins = np.ones(len(points), bool)
        begins[1:] = ~self.joined[kinds[:-1], kinds[1:]]
        starts = np.cumsum([0, *map(len, linear)])
        begins[starts[:-1][starts[:-1] < len(points)]] = True
        at = np.flatnonzero(begins)
        width = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
        place = np.append(0, np.cumsum(width))[np.append(at, len(points))]
        small = place[-1] < 1 << 31
        data = pa.py_buffer(whole.encode("utf-8", "surrogatepass"))
        kind, offsets = (pa.string(), place.astype(np.int32)) if small else (pa.large_string(), place.astype(np.int64))
        counts = np.diff(np.searchsorted(at, starts))
        return pa.Array.from_buffers(kind, len(at), [None, pa.py_buffer(offsets), data]), counts

    @without_gc
    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each text has."""
        cuts, counts = self.cut(texts)
        coded = cuts.dictionary_encode()
        found = list(map(self.cuts.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        pool, which = np.frombuffer(b"".join(found), "<u4"), coded.indices.to_numpy()
        first, size = (np.cumsum(sizes) - sizes).take(which), sizes.take(which)
        total = np.append(0, np.cumsum(size))
        take = np.repeat(first - total[:-1], size)
        take += np.arange(len(take))
        return pool.take(take), np.diff(total[np.append(0, np.cumsum(counts))])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return self.encode_batch([text])[0].astype("<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """The text of ids; what isn't UTF-8 becomes replacement characters."""
        raw = b"".join(map(self.output.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if self.prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


class _Cache(dict):
    """Values of a function; emptied when full, so that its size is bounded."""

    def __init__(self, fn, limit: int) -> None:
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fn(key)
        return value


@lru_cache(2)
def transducer(model_file: str) -> Transducer:
    """The machines of a model file, compiled once a process."""
    return Transducer(model_file)


def default_model() -> str:
    """The public byte-pair model with byte fallback."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(
    docs: DataFrame, model_file: str | None = None, text: str = "text", carry: list[str] | None = None, decoded: str | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ids (array of int), n_tokens, n_bytes (byte pieces),
    ids_crc32 (of little-endian unsigned 32-bit ids) and round_trip (whether decoding gives the text).

    ``decoded`` names a further column for the decoded text. Null and empty texts have no ids and decode
    to the empty text; whole texts are read, however long; at a tie of weights the arc relaxed first wins, longer pieces first (byte-pair models
    have no ties); the meta symbol in a text decodes to a space, so that its row's round_trip is false;
    repeated rows and null ids each give a row; an empty table gives an empty result; columns of ``docs`` with the names above are replaced.
    """
    model_file = model_file or default_model()
    new = [
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType()),
    ]
    new += [T.StructField(decoded, T.StringType())] if decoded else []
    kept = [c for c in (docs.columns if carry is None else carry) if c not in {f.name for f in new}]
    packed = docs.select(
        F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_file)
        low, high = (min(machine.bytes), max(machine.bytes)) if machine.bytes else (1, 0)
        for batch in batches:
            for part in portions(batch, 1, TOGETHER):
                texts = part.column(1).to_pylist()
                flat, sizes = machine.encode_batch(texts)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                whole = flat.tobytes()
                raw = [whole[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                back = [machine.decode(r) for r in raw]
                bytes_before = np.concatenate([[0], np.cumsum((flat >= low) & (flat <= high))])
                columns = [
                    part.column(0), pa.ListArray.from_arrays(
                        pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int32)),
                    ), pa.array(np.diff(ends)), pa.array(np.diff(bytes_before[ends])),
                    pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array([a == b for a, b in zip(texts, back, strict=True)]), *([pa.array(back, pa.string())] if decoded else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", *(f.name for f in new)])

    out = packed.mapInArrow(run, T.StructType([packed.schema["row"], *new]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], *[f.name for f in new])
