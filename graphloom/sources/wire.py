"""The public protobuf wire format, as far as a symbol index needs it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def varint(data: bytes | memoryview, at: int, bits: int = 64) -> tuple[int, int]:
    """The number at this place and the place behind it."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("truncated number")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7
        if shift >= bits + 6:
            raise ValueError("number is too long")


def fields(data: bytes | memoryview) -> Iterator[tuple[int, int, int | memoryview]]:
    """(number, wire type, value) of each field of a message; a length-delimited value is a view."""
    view, at = memoryview(data), 0
    while at < len(view):
        tag, at = varint(view, at, 32)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, at = varint(view, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            if at + size > len(view):
                raise ValueError("truncated field")
            value, at = int.from_bytes(view[at : at + size], "little"), at + size
        elif kind == 2:
            size, at = varint(view, at, 32)
            if at + size > len(view):
                raise ValueError("truncated field")
            value, at = view[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} is not known")
        yield number, kind, value


def signed(value: int) -> int:
    """A 32-bit integer as it was before it was written as a number of 64 bits."""
    value &= 0xFFFFFFFF
    return value - (1 << 32) if value >> 31 else value


def integers(kind: int, value: int | memoryview) -> list[int]:
    """The numbers of a repeated field, packed or not."""
    if kind == 0:
        return [signed(value)]
    out, at = [], 0
    while at < len(value):
        n, at = varint(value, at)
        out.append(signed(n))
    return out


def text(value: memoryview) -> str:
    return bytes(value).decode("utf-8", "replace")


def _number(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


_SMALL = [_number(n) for n in range(1 << 14)]


def number(n: int) -> bytes:
    return _SMALL[n] if 0 <= n < len(_SMALL) else _number(n)


def head(field: int, size: int) -> bytes:
    """What stands before the body of a field of so many bytes."""
    return number(field << 3 | 2) + number(size)


def put(field: int, value: int | str | bytes | list[int]) -> bytes:
    """A field: numbers as numbers, lists packed, the rest behind its length."""
    if isinstance(value, int):
        return number(field << 3) + number(value)
    body = b"".join(map(number, value)) if isinstance(value, list) else value.encode() if isinstance(value, str) else value
    return head(field, len(body)) + body


# Many at once


def varints_at(data: np.ndarray, at: np.ndarray, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The number at each of these places (only where, if given; else 0) and the places behind; data must go on for ten bytes behind the last place."""
    value, behind = np.zeros(len(at), np.int64), at.copy()
    rows = np.arange(len(at)) if where is None else np.flatnonzero(where)
    for shift in range(0, 70, 7):
        byte = data[behind[rows]].astype(np.int64)
        value[rows] |= (byte & 0x7F) << shift
        behind[rows] += 1
        rows = rows[byte >= 0x80]
        if not len(rows):
            return value, behind
    raise ValueError("number is too long")


def _bytes(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans, one after another, and where each begins among them, with the end."""
    bounds = np.concatenate([[0], np.cumsum(size)])
    return data[np.arange(bounds[-1]) + np.repeat(at - bounds[:-1], size)], bounds


def cut(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """Spans as an array of bytes."""
    body, bounds = _bytes(data, at, size)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(body)])


def lists_at(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that fill spans, one after another, and how many each span has."""
    body, bounds = _bytes(data, at, size)
    last = body < 0x80
    if len(body) and not last[bounds[1:][size > 0] - 1].all():
        raise ValueError("truncated number")
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    if len(ends) and (ends - starts).max() > 9:
        raise ValueError("number is too long")
    place = np.arange(len(body)) - np.repeat(starts, ends - starts + 1)
    parts = (body & 0x7F).astype(np.int64) << (7 * place)
    total = np.concatenate([[0], np.cumsum(last)])
    return (np.bitwise_or.reduceat(parts, starts) if len(ends) else parts), np.diff(total[bounds])


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Numbers written one after another, so many for each row."""
    x = values.astype(np.int64).view(np.uint64)
    size = np.ones(len(x), np.int64)
    for k in range(1, 10):
        size += x >= np.uint64(1 << 7 * k)
    bounds = np.concatenate([[0], np.cumsum(size)])
    out, at = np.empty(bounds[-1], np.uint8), bounds[:-1].copy()
    while len(x):
        more = x >= np.uint64(0x80)
        out[at] = (x & np.uint64(0x7F)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        at, x = at[more] + 1, x[more] >> np.uint64(7)
    offsets = bounds[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def varints(values: np.ndarray) -> pa.Array:
    """Each number as it is written."""
    return packed(values, np.ones(len(values), np.int64))


def joined(rows: pa.Array) -> bytes:
    """An array of bytes, one after another."""
    offsets = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1]
    return rows.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if len(rows) else b""
