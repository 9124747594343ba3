"""SimHash near-duplicates found by deletion-variant signatures.

A fingerprint has 64 bits; two are linked at up to 4 differing bits. Of three segments, one
then differs by at most one bit. So each fingerprint is indexed under 64 signatures: for every
bit position, its segment with that bit as a wildcard. Linked fingerprints share a signature;
rows of equal signature meet in sorted partitions and are verified on all 64 bits.

Only distinct fingerprints are indexed, so exact copies cost nothing. A group of equal
signatures yields a spanning forest of its verified links, not its pairs; a group larger than
``GROUP`` is cut into blocks, and each pair of blocks is verified in a task of its own. A signature
tells 20 or 21 bits, so of evenly spread fingerprints it holds about N / 2,000,000: some 5,000 at ten billion distinct
ones, where blocks begin. Beyond, the work of verifying grows with the square; more segments would then be needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.common import landed, map_text, unused
from roadloom.llm.components import stars

#: Words of a shingle, differing bits of a link, seed of XXH64.
SHINGLE, RADIUS, SEED = 4, 4, 42
#: First bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Most rows of one signature that a task verifies together.
GROUP = 8192
#: Groups up to this size are verified side by side.
SMALL = 48


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text; without words, zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: only A-Z, and only white space of the contract
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        first = starts[at : min(n, at + 65_536)]
        last = ends[min(at + shingle, len(words)) - 1 :][: len(first)]
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", carry: list[str] | None = None, name: str = "fp") -> DataFrame:
    """``docs`` (or its columns ``carry``) with the column ``name``, the fingerprint as a signed long."""

    def rows(texts: list[str]) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))]

    return map_text(docs, text, rows, [T.StructField(name, T.LongType())], carry)


def signatures(fps: DataFrame) -> DataFrame:
    """(sig, fp): 64 one-wildcard segment variants of each ``fp``; the sig holds the wildcard's position."""
    variants = [
        F.lit(p << 32) + F.shiftrightunsigned("fp", first).bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << (p - first))))
        for first, width in SEGMENTS
        for p in range(first, first + width)
    ]
    return fps.select(F.explode(F.array(*variants)).alias("sig"), "fp")


def forest(f: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) of the links among the distinct fingerprints ``f``: one row a member but the root."""
    left, roots, members = np.arange(1, len(f)), [], []
    root, front = 0, [np.array([0])]
    while len(left):
        if not front:
            root, left = left[0], left[1:]
            front = [np.array([root])]
            continue
        nodes = front.pop()
        if len(nodes) > 32:
            front.append(nodes[32:])
            nodes = nodes[:32]
        near = (np.bitwise_count(f[nodes][:, None] ^ f[left][None, :]) <= radius).any(0)
        if near.any():
            roots.append(np.full(near.sum(), root))
            members.append(left[near])
            front.append(left[near])
            left = left[~near]
    none = np.zeros(0, np.int64)
    return (f[np.concatenate(roots)], f[np.concatenate(members)]) if roots else (f[none], f[none])


def _settle(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, member) with the same components as the edges (a, b)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[label[keep]], nodes[keep]


def _links(sig: np.ndarray, f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) rows of the links within whole groups of equal ``sig`` (sorted)."""
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    sizes = np.diff(np.append(starts, len(sig)))
    a, b = [], []
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        x, y = forest(np.unique(f[s : s + n]), radius)
        a.append(x)
        b.append(y)
    few = np.repeat(sizes <= SMALL, sizes)
    sig, f = sig[few], f[few]
    for d in range(1, SMALL):
        same = np.flatnonzero(sig[d:] == sig[:-d])
        if not len(same):
            break
        same = same[(np.bitwise_count(f[same] ^ f[same + d]) <= radius) & (f[same] != f[same + d])]
        a.append(f[same])
        b.append(f[same + d])
    if not sum(map(len, a)):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _settle(np.concatenate(a), np.concatenate(b))


_LINKS = "a long, b long, sig long, fp long, block int"


def _rows(a=(), b=(), sig=None, f=(), block=0) -> pa.RecordBatch:
    n, m = len(a), len(f)
    none = lambda k: pa.nulls(k, pa.int64())
    whole = lambda x: pa.array(np.asarray(x).view(np.int64))
    columns = [whole(a), whole(b), none(n), none(n), pa.nulls(n, pa.int32())] if n or not m else [
        none(m), none(m), pa.array(np.full(m, sig)), whole(f), pa.array(np.full(m, block, np.int32)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "sig", "fp", "block"])


def _verify(batches: Iterator[pa.RecordBatch], radius: int = RADIUS, group: int = GROUP, chunk: int = 131_072) -> Iterator[pa.RecordBatch]:
    """Links of sorted rows (sig, fp); rows of a sig with over ``group`` rows come back in blocks instead."""
    sig, f, held, block = np.zeros(0, np.int64), np.zeros(0, np.uint64), None, 0

    def settle(end: bool):
        nonlocal sig, f, held, block
        while len(sig) and (end or len(sig) > chunk):
            if held is not None:  # an open group of blocks goes on
                n = int(np.searchsorted(sig, held, "right"))
                if n >= group or end or n < len(sig):
                    take = min(n, group)
                    if take:
                        yield _rows(sig=held, f=f[:take], block=block)
                        block += 1
                    sig, f = sig[take:], f[take:]
                    if take < group:
                        held = None
                    continue
                return
            if int(np.searchsorted(sig, sig[0], "right")) > group:
                held, block = int(sig[0]), 0
                continue
            starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            big = np.flatnonzero(np.diff(np.append(starts, len(sig))) > group)
            cut = starts[big[0]] if len(big) else len(sig) if end else starts[-1]
            if not cut:
                return
            a, b = _links(sig[:cut], f[:cut], radius)
            if len(a):
                yield _rows(a, b)
            sig, f = sig[cut:], f[cut:]

    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
        if sum(len(p[0]) for p in parts) + len(sig) > chunk:
            sig, f = np.concatenate([sig, *(p[0] for p in parts)]), np.concatenate([f, *(p[1] for p in parts)])
            parts = []
            yield from settle(False)
    if parts:
        sig, f = np.concatenate([sig, *(p[0] for p in parts)]), np.concatenate([f, *(p[1] for p in parts)])
    yield from settle(True)


def links(fps: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, with the same components as all their links."""
    dealt = signatures(fps.select("fp").distinct()).repartition("sig").sortWithinPartitions("sig", "fp")
    found = landed(dealt.mapInArrow(lambda it: _verify(it, radius, group), _LINKS), "links")
    edges = found.where("a is not null").select("a", "b")
    blocks = found.where("sig is not null").select("sig", "fp", "block")
    if not blocks.isEmpty():
        last = blocks.groupBy("sig").agg(F.max("block").alias("last"))
        other = F.explode(F.sequence(F.lit(0), F.col("last")))
        pairs = blocks.join(last, "sig").withColumn("other", other)
        pairs = pairs.select("sig", "fp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

        def meet(t: pa.Table) -> pa.Table:
            a, b = forest(np.unique(t.column("fp").to_numpy().view(np.uint64)), radius)
            return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

        edges = edges.unionByName(pairs.groupBy("sig", "i", "j").applyInArrow(meet, "a long, b long"))
    return edges


def classes(fps: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """(fp, root, component_id) of every distinct ``fp`` of a landed (id, fp) table.

    root is the component's smallest fingerprint as a long, component_id its smallest id
    (null where all its ids are null).
    """
    heads = landed(fps.groupBy("fp").agg(F.min(id_col).alias("head")), "heads")
    star = stars(links(heads, radius, group))
    rooted = landed(
        heads.join(star.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp")),
        "roots",
    )
    smallest = landed(rooted.groupBy("root").agg(F.min("head").alias("component_id")), "smallest")
    return landed(rooted.join(smallest, "root").select("fp", "root", "component_id"), "classes")


def group_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other; repeated rows each get
    a row; rows with a null id are in a component but never name it; an empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    fps = landed(fingerprints(docs, text, [id_col]), "fingerprints")
    found = fps.join(classes(fps, id_col, radius, group), "fp")
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each component of ``docs``, all columns kept, whatever their names: the one with the smallest id (null ids last).

    Rows of equal id and fingerprint are told apart by their text, then by a hash of the other
    columns, the least first, so that a rerun keeps the same row. Null and empty texts are one
    component with whatever is near fingerprint zero; an empty table gives an empty result; whole
    texts are read, however long.
    """
    fps = landed(fingerprints(docs, text, [id_col]), "fingerprints")
    rows = fps.join(classes(fps, id_col, radius), "fp")
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "fp"))
    kept = landed(rows.groupBy("root").agg(first.alias("x")).select("x.id", F.col("x.fp").alias("kept_fp")), "kept")
    if fps.groupBy(id_col).count().where("count > 1").isEmpty():
        return docs.join(kept, docs[id_col].eqNullSafe(kept["id"]), "left_semi")
    name = unused("fp", *docs.columns)
    again = fingerprints(docs, text, name=name)  # ids repeat: a row is told by id and fingerprint
    again = again.join(kept, again[id_col].eqNullSafe(kept["id"]) & (again[name] == kept["kept_fp"]), "left_semi")
    plain = [f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    order = F.struct(F.col(f"`{text}`"), F.xxhash64(*plain))
    best = again.groupBy(F.col(f"`{id_col}`"), F.col(name)).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("row"))
    return best.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
