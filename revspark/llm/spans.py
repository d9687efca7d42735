"""Word spans of whole texts, as numpy arrays over the bytes of an Arrow column.

Every byte of a character beyond ASCII is at least 0x80, so a class made of ASCII
characters and all others can be told byte by byte. Hashes only find equals
quickly; whoever uses them compares the bytes or texts themselves afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_BYTES = np.arange(256)
#: A-Z to a-z, every other byte as it is.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Digits, letters and every character beyond ASCII.
WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: Everything but ASCII white space.
CHUNK = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: Bytes of spans hashed or compared at once.
STEP = 1 << 22


class Spans(NamedTuple):
    data: np.ndarray   # the bytes
    start: np.ndarray  # first byte of each span
    end: np.ndarray    # one past its last
    row: np.ndarray    # the row it lies in


def one_array(column) -> pa.Array:
    """A column as a single array."""
    if not isinstance(column, pa.ChunkedArray):
        return column
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null reads as empty."""
    column = pc.fill_null(one_array(column).cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def find_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Spans:
    """Maximal runs of the bytes ``table`` marks; no run crosses a row."""
    if len(data) == 0:
        none = np.empty(0, np.int64)
        return Spans(data, none, none, none)
    inside = table[data]
    first = np.zeros(len(data) + 1, bool)  # a row starts here
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (first[:-1] | ~before))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (first[1:] | ~after)) + 1
    return Spans(data, start, end, np.searchsorted(offsets, start, side="right") - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


#: Weight of a byte by its place in the span; places beyond the last share it.
_WEIGHTS = mix(np.arange(1, (1 << 14) + 1)) | np.uint64(1)


def _steps(length: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of spans of at most ``STEP`` bytes together (a longer span alone)."""
    total = np.cumsum(length)
    at = 0
    while at < len(length):
        base = total[at - 1] if at else 0
        upto = max(int(np.searchsorted(total, base + STEP, side="right")), at + 1)
        yield at, upto
        at = upto


def span_hash(s: Spans) -> np.ndarray:
    """64-bit hash of each span's bytes."""
    length = s.end - s.start
    out = np.empty(len(length), np.uint64)
    for lo, hi in _steps(length):
        n = length[lo:hi]
        begin = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(begin, n)
        byte = s.data[np.repeat(s.start[lo:hi], n) + place].astype(np.uint64) + np.uint64(1)
        byte *= _WEIGHTS[np.minimum(place, len(_WEIGHTS) - 1)]
        out[lo:hi] = np.add.reduceat(byte, begin)
    return mix(out + mix(length))


def _same_bytes(s: Spans, other: np.ndarray) -> bool:
    """Does every span hold the bytes of the span whose index ``other`` names?"""
    length = s.end - s.start
    if not np.array_equal(length, length[other]):
        return False
    for lo, hi in _steps(length):
        n = length[lo:hi]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(s.data[np.repeat(s.start[lo:hi], n) + place],
                              s.data[np.repeat(s.start[other[lo:hi]], n) + place]):
            return False
    return True


def distinct_spans(s: Spans) -> tuple[np.ndarray, np.ndarray]:
    """Number of each span's text (0, 1, ... by first occurrence) and those first spans."""
    codes, _ = pd.factorize(span_hash(s))
    first = np.empty(int(codes.max(initial=-1)) + 1, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    if not _same_bytes(s, first[codes]):  # two texts of one hash
        raw = s.data.tobytes()
        numbers: dict[bytes, int] = {}
        codes = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(s.start, s.end)], np.int64)
        first = np.empty(len(numbers), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes.astype(np.int64), first


def span_texts(s: Spans, which: np.ndarray) -> pa.Array:
    """The texts of some spans as a string array."""
    n = s.end[which] - s.start[which]
    offsets = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=offsets[1:])
    place = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], n)
    data = np.ascontiguousarray(s.data[np.repeat(s.start[which], n) + place])
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def packs(batches, text: str, limit: int) -> Iterator[pa.Table]:
    """The rows in order, in tables of about ``limit`` bytes of text (one longer text alone)."""
    held, size = [], 0
    for b in batches:
        cost = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        total = np.cumsum(cost)
        at = 0
        while at < b.num_rows:
            base = total[at - 1] if at else 0
            upto = int(np.searchsorted(total, base + limit - size, side="right"))
            if upto <= at and not held:
                upto = at + 1
            if upto > at:
                held.append(b.slice(at, upto - at))
                size += int(total[upto - 1] - base)
                at = upto
            if at < b.num_rows or size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
