"""Adaptive context-mixing range coder for token ids, in independently reset blocks.

The probability of the next id is a mixture of three predictions. Order 2 and order 1 each predict one id,
the last that followed the same two ids or the same id in this block. Order 0 predicts
every id: the header lists the file's ids in bands of equal mass, from the most to the least frequent, and each block
learns how its own ids fall on the bands. The mixture's weights adapt, in each block from the same start,
for every joint state of confidence of the two single predictions. One range-coder step codes
an id: its interval is that of the predictor that hits, or its place in order 0.

Blocks share nothing but the header, so all blocks of a file are coded in lockstep, one id of
each at a time, with arrays over blocks (lanes). Each block has the CRC-32 of its ids.

File format, little-endian: ``RLTC``, version (u16), bytes of the header (u32), CRC-32 of the
header (u32), header (zlib), payload. Header: block size, documents, ids, blocks, distinct ids
(5 u64); a null flag (u8), id (i64) and length in ids (u32) per document; id, band and frequency in its band (u32
each) per distinct id; ids, payload bytes and CRC-32 (u32 each) per block.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC, VERSION = b"RLTC", 2
#: Ids of a block.
BLOCK = 1024
#: The coder's range has between LOW_BITS and LOW_BITS + WORD bits, gives WORD at a time, and is shared out in 2**TOTAL parts.
WORD, LOW_BITS, TOTAL = 24, 32, 24
BOTTOM, START, PARTS = 1 << LOW_BITS, (1 << (LOW_BITS + WORD)) - 1, 1 << TOTAL
#: Order 0: bands, bits of a band's frequencies, and of the shares that a block deals to the bands.
BANDS, BAND_BITS, SHARE_BITS = 8, 14, 6
ZERO_BITS = BAND_BITS + 12
#: Slots of the tables of single predictions, per lane; largest and least weight of one; ids are below LIMIT.
SLOT_BITS, HIT, MISS, LIMIT = 7, PARTS * 15 // 16 - (1 << 13), 1 << 12, 1 << 29
#: Steps after which a block deals its shares anew.
REFRESH = 64

#: What weights of order 2 (upper half) and order 1 move to: if neither, order 1 or order 2 is the one that is right.
_GOALS = np.array([(MISS << 32) + MISS, (MISS << 32) + HIT, (HIT << 32) + MISS], np.int64)
_M1, _M2, _M3 = np.uint32(2_654_435_761), np.uint32(2_246_822_519), np.uint32(3_266_489_917)
_SHIFT = np.uint32(32 - SLOT_BITS)


@dataclass
class TokenFile:
    """A decoded file: documents and their ids, one after another."""

    doc_ids: list
    lengths: np.ndarray
    ids: np.ndarray


@dataclass
class Bands:
    """The distinct ids of a file by band: a band's frequencies add up to 2**BAND_BITS, none is zero."""

    ids: np.ndarray
    band: np.ndarray
    freq: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray) -> Bands:
        """Ids by falling frequency, cut where the running share of all ids passes a multiple of 1 / BANDS."""
        if len(ids) and int(np.max(ids)) < 1 << 22:
            every = np.bincount(ids)
            distinct = np.flatnonzero(every)
            counts = every[distinct]
        else:
            distinct, counts = np.unique(ids, return_counts=True)
        if len(distinct) and int(distinct[-1]) >= LIMIT:
            raise ValueError(f"ids must be below {LIMIT}")
        if len(distinct) > BANDS << BAND_BITS:
            raise ValueError("too many distinct ids for a file")
        order = np.lexsort((distinct, -counts))
        distinct, counts = distinct[order], counts[order]
        before = np.cumsum(counts) - counts
        band = before * BANDS // max(1, counts.sum())
        most = 1 << BAND_BITS  # ids that a band can hold
        for b in range(BANDS - 1, 0, -1):  # too many rare ids spill into the band before
            mine = np.flatnonzero(band == b)
            if len(mine) > most:
                band[mine[: len(mine) - most]] = b - 1
        freq = np.zeros(len(distinct), np.int64)
        for b in np.unique(band):
            mine = np.flatnonzero(band == b)
            room = (1 << BAND_BITS) - len(mine)
            freq[mine] = 1 + counts[mine] * room // counts[mine].sum()
            freq[mine[0]] += (1 << BAND_BITS) - freq[mine].sum()
        return cls(distinct.astype(np.int64), band, freq)

    def __post_init__(self) -> None:
        self.ids, self.band, self.freq = (np.asarray(x).astype(np.int64) for x in (self.ids, self.band, self.freq))
        total = np.cumsum(self.freq) - self.freq
        at = np.zeros(BANDS, np.int64)
        for b in np.unique(self.band):
            at[b] = total[np.flatnonzero(self.band == b)[0]]
        self.offset = total - at[self.band]

    def place_at(self) -> np.ndarray:
        """Of each part of each band: the place in ``ids`` of the id that has it."""
        out = np.zeros(BANDS << BAND_BITS, np.int32)
        for b in np.unique(self.band):
            mine = np.flatnonzero(self.band == b)
            out[b << BAND_BITS : (b + 1) << BAND_BITS] = np.repeat(mine, self.freq[mine])[: 1 << BAND_BITS]
        return out


class _Model:
    """The predictions of all blocks in lockstep; coder and decoder make the same calls."""

    def __init__(self, lanes: int) -> None:
        self.base = np.arange(lanes, dtype=np.int64)
        self.table1, self.table2 = np.zeros(lanes << SLOT_BITS, np.int32), np.zeros(lanes << SLOT_BITS, np.int32)  # id * 4 + confidence
        start = np.zeros(32, np.int64)  # weights of order 2 (upper half) and order 1 by state: conf2, conf1, agreement
        for c2 in range(4):
            for c1 in range(4):
                start[c2 * 8 + c1 * 2] = (PARTS // 16 * (1 + 2 * c2) << 32) + PARTS // 16 * (1 + c1)
                start[c2 * 8 + c1 * 2 + 1] = (PARTS // 16 * (2 + 3 * max(c1, c2)) << 32) + MISS
        self.weights = np.tile(start, lanes)
        self.counts = np.full(lanes * BANDS, 8, np.int64)
        self.narrow(lanes)
        self.deal()

    def narrow(self, n: int) -> None:
        """Keeps the first ``n`` blocks; the tables stay."""
        self.base = self.base[:n]
        self.slots, self.states, self.bands, self.tables = self.base << SLOT_BITS, self.base << 5, self.base * BANDS, self.base << SHARE_BITS

    def deal(self, table: bool = False) -> None:
        """Shares the bands out by their counts, which then fade; ``table`` also makes the decoder's table of shares."""
        c = self.counts.reshape(-1, BANDS)
        shares = 1 + c * ((1 << SHARE_BITS) - BANDS) // c.sum(1, keepdims=True)
        rows = np.arange(len(c))
        shares[rows, c.argmax(1)] += (1 << SHARE_BITS) - shares.sum(1)
        first = np.cumsum(shares, 1) - shares
        unit = 12 - SHARE_BITS
        self.dealt = ((first << (BAND_BITS + unit) << 16) + (shares << unit)).reshape(-1)  # where a band begins, and its width
        if table:
            marks = np.zeros((len(c), 1 << SHARE_BITS), np.int64)
            marks[rows[:, None], first[:, 1:]] = 1
            self.band_at = np.cumsum(marks, 1).reshape(-1)
        c -= c >> 2

    def slots_of(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table slots, within a lane, of order 1 and order 2 after two ids (u32)."""
        mixed = last * _M1
        return mixed >> _SHIFT, (mixed * _M3 + before * _M2) >> _SHIFT

    def predict(self, s1: np.ndarray, s2: np.ndarray) -> None:
        """Looks up the single predictions and their weights."""
        self.s1, self.s2 = s1, s2
        self.t1, self.t2 = self.table1.take(s1), self.table2.take(s2)
        self.c1, self.c2 = self.t1 & 3, self.t2 & 3
        self.state = self.states + ((self.c2 << 3) + (self.c1 << 1) + ((self.t1 ^ self.t2) < 4))
        w = self.w = self.weights.take(self.state)
        self.a, self.b = w >> 32, w & 0xFFFFFFFF
        self.zero = PARTS - self.a - self.b  # order 0's part

    def update(self, tagged: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, same1: np.ndarray, miss: np.ndarray, banded: np.ndarray) -> None:
        """Learns the ids (``tagged``: times 4) and their places among all lanes' bands; ``hit1`` only where order 2 missed, ``same1`` wherever order 1 was right."""
        goal = _GOALS.take((hit2.view(np.uint8) << 1) + hit1.view(np.uint8))
        step, old = goal.view(np.int32), self.w.view(np.int32)  # both weights side by side
        step -= old
        step >>= 5
        step += old
        self.weights[self.state] = goal
        self.table2[self.s2] = tagged + np.minimum(self.c2 + 1, 3) * hit2
        self.table1[self.s1] = tagged + np.minimum(self.c1 + 1, 3) * same1
        seen = self.counts.take(banded)
        seen += miss
        self.counts[banded] = seen


def _lanes(n: int, block: int) -> np.ndarray:
    """Lengths of the blocks of ``n`` ids; only the last may be shorter."""
    return np.full(-(-n // block), block, np.int64) if n % block == 0 else np.append(np.full(n // block, block, np.int64), n % block)


def _payloads(words: np.ndarray, counts: np.ndarray, low: np.ndarray) -> list[bytes]:
    """The bytes of each lane: its words with their carries, then what is left in ``low``."""
    lanes = len(counts)
    wide = int(counts.max()) + 3
    out = np.zeros((lanes, wide), np.int64)
    out[:, : wide - 3] = words[: wide - 3].T
    out[np.arange(wide)[None, :] >= counts[:, None]] = 0
    rows = np.arange(lanes)
    out[rows, counts], out[rows, counts + 1], out[rows, counts + 2] = low >> 32, (low >> 8) & 0xFFFFFF, (low & 0xFF) << 16
    carry = out >> WORD
    while carry.any():
        out &= (1 << WORD) - 1
        out[:, :-1] += carry[:, 1:]
        carry = out >> WORD
    raw = np.stack([out >> 16, (out >> 8) & 0xFF, out & 0xFF], 2).astype(np.uint8).reshape(lanes, -1)
    return [raw[k, : 3 * n + 7].tobytes() for k, n in enumerate(counts.tolist())]


def code(ids: np.ndarray, bands: Bands, block: int = BLOCK) -> list[bytes]:
    """The payload of each block."""
    sizes = _lanes(len(ids), block)
    lanes = len(sizes)
    if not lanes:
        return []
    grid = np.zeros(lanes * block, np.uint32)
    grid[: len(ids)] = ids
    steps = np.zeros((block + 2, lanes), np.uint32)  # two zeros stand before each block
    steps[2:] = grid.reshape(lanes, block).T
    packed = (bands.band << 40) + (bands.offset << 20) + bands.freq
    dense = int(bands.ids.max()) < 1 << 22
    if dense:
        of_id = np.zeros(int(bands.ids.max()) + 1, np.int64)
        of_id[bands.ids] = packed
    else:  # ids far apart are looked up by search
        order = np.argsort(bands.ids)
        sorted_ids, of_id = bands.ids[order], packed[order]
    model, live = _Model(lanes), lanes
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, START, np.int64)
    words, counts = np.zeros((block + 1, lanes), np.int32), np.zeros(lanes, np.int64)  # lanes give words at about the same pace
    flat = words.reshape(-1)
    for t in range(int(sizes.max())):
        if live == lanes and sizes[-1] <= t:
            live -= 1
            model.narrow(live)
            low_last, low, rng = low[live:], low[:live], rng[:live]
        if t % REFRESH == 0:
            model.deal()
        x = steps[t + 2, :live]
        s1, s2 = model.slots_of(steps[t + 1, :live], steps[t, :live])
        model.predict(model.slots + s1, model.slots + s2)
        tagged = (x << np.uint32(2)).view(np.int32)
        hit2, same1 = (model.t2 ^ tagged) < 4, (model.t1 ^ tagged) < 4
        hit1 = same1 & ~hit2
        miss = ~(hit2 | same1)
        of = of_id.take(x if dense else np.searchsorted(sorted_ids, x))
        banded = model.bands + (of >> 40)
        dealt = model.dealt.take(banded)
        width = dealt & 0xFFFF
        begin = (dealt >> 16) + width * ((of >> 20) & 0xFFFFF)
        zero = model.zero
        first = (begin * zero) >> ZERO_BITS
        size = ((begin + width * (of & 0xFFFFF)) * zero >> ZERO_BITS) - first
        first += model.a + model.b
        start = np.where(miss, first, hit1 * model.a)
        size = np.where(miss, size, np.where(hit2, model.a, model.b))
        r = rng >> TOTAL
        low += start * r
        rng = size * r
        k = np.flatnonzero(rng < BOTTOM)
        if len(k):
            some = low[k]
            n = counts[k]
            flat[n * lanes + k] = some >> LOW_BITS
            counts[k] = n + 1
            low[k] = (some & (BOTTOM - 1)) << WORD
            rng[k] <<= WORD
        model.update(tagged, hit2, hit1, same1, miss, banded)
    if live < lanes:
        low = np.concatenate([low, low_last])
    return _payloads(words, counts, low)


def decode_blocks(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bands: Bands, block: int) -> np.ndarray:
    """The ids of all blocks, one after another; ``raw`` are bytes, ``starts`` the blocks' places in them."""
    lanes = len(sizes)
    if not lanes:
        return np.zeros(0, np.int64)
    b = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.int32)
    triples = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    at, last_at = starts.astype(np.int64), len(triples) - 1
    word = lambda k: triples.take(np.minimum(at[k] if k is not None else at, last_at)).astype(np.int64)
    code_ = word(None) << 32
    at = at + 3
    code_ |= word(None) << 8
    at = at + 3
    code_ |= word(None) >> 16
    at = at + 1
    place_at = bands.place_at()
    packed = (bands.offset << 20) + bands.freq
    ids_of = bands.ids.astype(np.int32)
    model, live = _Model(lanes), lanes
    rng = np.full(lanes, START, np.int64)
    out = np.zeros((int(sizes.max()) + 2, lanes), np.uint32)
    for t in range(int(sizes.max())):
        if live == lanes and sizes[-1] <= t:
            live -= 1
            model.narrow(live)
            code_, rng, at = code_[:live], rng[:live], at[:live]
        if t % REFRESH == 0:
            model.deal(True)
        s1, s2 = model.slots_of(out[t + 1, :live], out[t, :live])
        model.predict(model.slots + s1, model.slots + s2)
        a, both, zero = model.a, model.a + model.b, model.zero
        r = rng >> TOTAL
        v = np.minimum(_divided(code_, r), PARTS - 1)
        hit2, miss = v < a, v >= both
        hit1 = ~(hit2 | miss)
        u = (((np.maximum(v - both, 0) + 1 << ZERO_BITS) - 1) / zero).astype(np.int64)  # below 2**50, by less than 2**24: floats are exact enough
        band = model.band_at.take(model.tables + (u >> (ZERO_BITS - SHARE_BITS)))
        banded = model.bands + band
        dealt = model.dealt.take(banded)
        width, begin = dealt & 0xFFFF, dealt >> 16
        place = place_at.take((band << BAND_BITS) + ((u - begin) / width).astype(np.int64))
        of = packed.take(place)
        begin += width * (of >> 20)
        first = (begin * zero) >> ZERO_BITS
        size = ((begin + width * (of & 0xFFFFF)) * zero >> ZERO_BITS) - first
        start = np.where(miss, first + both, hit1 * a)
        size = np.where(miss, size, np.where(hit2, a, model.b))
        tagged = np.where(miss, ids_of.take(place) << 2, np.where(hit2, model.t2, model.t1) & -4)
        code_ = code_ - start * r
        rng = size * r
        k = np.flatnonzero(rng < BOTTOM)
        if len(k):
            code_[k] = (code_[k] << WORD) | word(k)
            at[k] += 3
            rng[k] <<= WORD
        same1 = (model.t1 ^ tagged) < 4
        model.update(tagged, hit2, hit1, same1, miss, banded)
        out[t + 2, :live] = (tagged >> 2).view(np.uint32)
    flat = out[2:].T.reshape(-1).astype(np.int64)
    return flat if (sizes == sizes[0]).all() else np.concatenate([flat[: (lanes - 1) * block], out[2 : 2 + sizes[-1], -1].astype(np.int64)])


def _divided(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x // y of numbers that aren't negative; a damaged file's zeros divide as ones."""
    return (x.view(np.uint64) // np.maximum(y, 1).view(np.uint64)).view(np.int64)


def pack(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A file of documents, whose ids are ``ids`` cut by ``lengths``; a document's id is an integer or None."""
    bands = Bands.of(ids)
    payload = code(ids, bands, block)
    sizes = _lanes(len(ids), block)
    raw = memoryview(np.asarray(ids).astype("<u4").tobytes())
    crcs = [zlib.crc32(raw[4 * k * block : 4 * (k + 1) * block]) for k in range(len(sizes))]
    header = zlib.compress(b"".join([
        struct.pack("<5Q", block, len(doc_ids), len(ids), len(sizes), len(bands.ids)),
        bytes(d is None for d in doc_ids), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.asarray(lengths, "<u4").tobytes(),
        bands.ids.astype("<u4").tobytes(), bands.band.astype("<u4").tobytes(), bands.freq.astype("<u4").tobytes(),
        sizes.astype("<u4").tobytes(), np.array([len(p) for p in payload], "<u4").tobytes(), np.array(crcs, "<u4").tobytes(),
    ]))
    return b"".join([MAGIC, struct.pack("<HII", VERSION, len(header), zlib.crc32(header)), header, *payload])


def unpack(data: bytes) -> TokenFile:
    """Reads a file; any damage that a checksum shows raises ValueError."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    version, n, crc = struct.unpack_from("<HII", data, 4)
    if version != VERSION:
        raise ValueError(f"unknown version {version}")
    packed = data[14 : 14 + n]
    if zlib.crc32(packed) != crc:
        raise ValueError("the header is damaged")
    header, at = zlib.decompress(packed), 40
    block, docs, total, blocks, kinds = struct.unpack_from("<5Q", header)

    def column(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(header, dtype, count, at)
        at += out.nbytes
        return out

    null, doc_ids, lengths = column("u1", docs), column("<i8", docs), column("<u4", docs)
    bands = Bands(column("<u4", kinds), column("<u4", kinds), column("<u4", kinds))
    sizes, room, crcs = column("<u4", blocks), column("<u4", blocks).astype(np.int64), column("<u4", blocks)
    if room.sum() + 14 + n != len(data) or sizes.sum() != total or lengths.sum() != total:
        raise ValueError("the file is cut")
    body = np.frombuffer(data, np.uint8, offset=14 + n)
    ids = decode_blocks(body, np.cumsum(room) - room, sizes.astype(np.int64), bands, block).astype("<u4")
    for k, want in enumerate(crcs.tolist()):
        if zlib.crc32(ids[k * block : (k + 1) * block].tobytes()) != want:
            raise ValueError(f"block {k} is damaged")
    return TokenFile([None if z else d for z, d in zip(null.tolist(), doc_ids.tolist(), strict=True)], lengths.astype(np.int64), ids)
