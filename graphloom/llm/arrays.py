"""Texts of an Arrow batch as NumPy arrays: bytes, words and word hashes, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into arrays at a time; a longer text is taken alone.
SLICE_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

IS_WHITE = np.zeros(256, bool)
IS_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about `limit` bytes; null counts as empty.

    The bytes are views of the column's own buffer."""
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    hidden = np.zeros(n, bool)
    if column.null_count:
        # A null may own bytes; such a batch is made plain.
        hidden = column.is_null().to_numpy(zero_copy_only=False) & (np.diff(at) > 0)
    if hidden.any():
        yield from text_slices(pc.fill_null(column, ""), limit)
        return
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        end = min(end, n)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of maximal runs of member bytes; a run never crosses a row."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(member)
    before[0] = False
    before[1:] = member[:-1]
    inner = offsets[:-1][offsets[:-1] < len(member)]
    before[inner] = False
    starts = np.flatnonzero(member & ~before)
    after = np.empty_like(member)
    after[-1] = False
    after[:-1] = member[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(member & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RunHasher:
    """64-bit hashes of values[start:end] for any runs, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        power = np.full(n + 1, _P, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.total[1:])
        power[:] = _P_INVERSE
        power[0] = 1
        np.cumprod(power, out=power)
        self.inverse = power

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return RunHasher(values)(starts, ends)
