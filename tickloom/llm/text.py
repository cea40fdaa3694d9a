"""Vectorised text primitives for Arrow batches: words, hashes, rolling hashes and minimizer anchors.

Texts are handled as UTF-8 bytes in chunks of about ``CHUNK`` bytes, so the memory of a task does not follow the length
of a batch; a single longer text makes a chunk of its own. Null texts are empty.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.functions.session import stored  # noqa: F401  (for the operators)

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C13  # odd, 3 mod 8: its powers have the longest period modulo 2**64
_U = np.uint64


class Chunk(NamedTuple):
    first: int  # row of the batch
    rows: int
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, rows + 1, from 0


def binary(column: pa.Array) -> pa.Array:
    """A string column as binary with int32 offsets; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.binary():
        column = column.cast(pa.binary())
    return column.fill_null(b"") if column.null_count else column


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    column = binary(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Chunk(at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> _U(31))
    h = h * _U(0x7FB5D329728EA185)
    h ^= h >> _U(27)
    h *= _U(0x81DADEF4BC2DD44D)
    h ^= h >> _U(33)
    return h


@functools.lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.concatenate([np.ones(1, _U), np.cumprod(np.full(size, x, _U))]) for x in (_BASE, inverse))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(18, int(n).bit_length())
    return _powers(size)


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))


def prefix(values: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`spans` reads the hash of any stretch of ``values``."""
    power, _ = powers(len(values))
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * power[: len(values)], out=out[1:])
    return out


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def spans(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches ``[start, end)``; equal content gives equal hashes at any place."""
    _, inverse = powers(len(running))
    return mix((running[end] - running[start]) * inverse[start] + (end - start).astype(_U))


def blanks(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, for each row, the number of words before it."""
    n = len(chunk.data)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~blanks(chunk.data)
    begin = solid[1:] & ~solid[:-1]
    stop = solid[:-1] & ~solid[1:]
    inner = chunk.offsets[1:-1]  # a text's end is a word's end
    inner = inner[(inner > 0) & (inner < n)]
    both = inner[solid[inner] & solid[inner + 1]]
    begin[both] = True
    stop[both] = True
    starts, ends = np.flatnonzero(begin[:-1]), np.flatnonzero(stop)
    return starts, ends, np.searchsorted(starts, chunk.offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans(prefix(byte_values(data)), starts, ends)


class Anchors(NamedTuple):
    """Runs of windows that share a minimizer: windows ``first..last`` of a text all hold the gram at ``at``."""

    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    key: np.ndarray  # hash of the gram


def anchors(running: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> Anchors:
    """Minimizers of all windows of ``window`` symbols that lie within the texts ``bounds``; indices are symbols.

    The gram with the smallest hash in a window (the leftmost of equals) depends on the window's content only, so equal
    windows have equal grams at the same offset.
    """
    none = np.zeros(0, np.int64)
    n = len(running) - 1
    if n < window:
        return Anchors(none, none, none, none.astype(_U))
    places = np.arange(n - gram + 1, dtype=np.int64)
    key = spans(running, places, places + gram)
    low = (key & _U(0xFFFFFFFF00000000)) | places.astype(_U)
    reach, width = 1, window - gram + 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    at = (low & _U(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(len(at) + 1, np.int32)
    lengths = np.diff(bounds)
    long = lengths >= window
    np.add.at(valid, bounds[:-1][long], 1)
    np.add.at(valid, (bounds[1:] - window + 1)[long], -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(starts):
        return Anchors(none, none, none, none.astype(_U))
    of = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (of[1:] != of[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) - 1
    return Anchors(of[head], starts[head], starts[tail], key[of[head]])


def covered(first: np.ndarray, last: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of ``n`` symbols lie in a window that starts in one of the runs ``first..last``."""
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, first, 1)
    np.add.at(marks, last + window, -1)
    return np.cumsum(marks[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true."""
    step = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def fields(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; other columns never reach an operator, so their names cannot clash."""
    return df.select(*[df[name].cast(kind).alias(name) for name, kind in types.items()])
