"""Protobuf wire format: enough to read map extracts. Numbers in bulk go through numpy."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np


class WireError(ValueError):
    """Bytes that are no message."""


def varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, place after it); at most ten bytes."""
    value, shift = 0, 0
    while True:
        if at >= len(data):
            raise WireError("a number is cut")
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7
        if shift >= 70:
            raise WireError("a number is longer than ten bytes")


def zigzag(value: int) -> int:
    """The signed number that an unsigned one stands for."""
    return (value >> 1) ^ -(value & 1)


def signed(value: int, bits: int = 64) -> int:
    """Two's complement."""
    return value - (1 << bits) if value >> (bits - 1) & 1 else value


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) in order: ints for varints and fixed numbers, bytes for what has a length."""
    at, n = 0, len(data)
    while at < n:
        key, at = varint(data, at)
        number, kind = key >> 3, key & 7
        if not number:
            raise WireError("field number zero")
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            if at + size > n:
                raise WireError("a fixed number is cut")
            value = struct.unpack_from("<Q" if kind == 1 else "<I", data, at)[0]
            at += size
        elif kind == 2:
            size, at = varint(data, at)
            if at + size > n:
                raise WireError("a field is cut")
            value = data[at : at + size]
            at += size
        else:
            raise WireError(f"wire type {kind}")
        yield number, value


def packed(data: bytes) -> np.ndarray:
    """Packed varints as unsigned 64-bit numbers."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    last = raw < 0x80
    if not last[-1]:
        raise WireError("packed numbers are cut")
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    if (ends - starts).max() >= 10:
        raise WireError("a number is longer than ten bytes")
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    parts = (raw & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.bitwise_or.reduceat(parts, starts)


def packed_signed(data: bytes) -> np.ndarray:
    """Packed zigzag numbers."""
    u = packed(data)
    return (u >> np.uint64(1)).astype(np.int64) ^ -(u & np.uint64(1)).astype(np.int64)
