"""Packing of token sequences into windows by multiway differencing.

A document longer than a window is cut into full windows and a rest; every second rest gives a small end that evens
loads out. The rests of a group of documents start as partial
partitions with one load; the two partitions of largest imbalance are merged with opposing imbalances (largest load on
smallest) until one is left, whose loads are nearly equal. If a load exceeds the capacity, the group is packed again into
one window more.

Groups are formed by hash and hold about ``GROUP_WINDOWS`` windows at any corpus size, so no task packs more than that
(a single longer document adds rows for its full windows only). Null texts are empty and have the closing id alone;
repeated rows are packed each; other columns are passed over; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import itertools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.bpe import BATCH, encoder
from tickloom.llm.text import chunks, fields, stored

CAPACITY = 4096
END_ID = 2
#: Copies of equal pieces that are numbered at once.
COPIES = 1024
GROUP_WINDOWS = 512


def difference(loads: np.ndarray, windows: int) -> np.ndarray:
    """Window of each load, by the largest differencing method over ``windows`` windows."""
    made: list[tuple[int, int]] = []  # what two window contents were joined to
    n = len(loads)
    heap = [(-int(x), i, np.array([x], np.int64), np.array([i])) for i, x in enumerate(loads)]
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a, own = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        both = len(a) + len(b) - windows  # windows that get a part of either
        if both > 0:
            tail = slice(len(a) - both, len(a))
            mate = slice(len(b) - 1, len(b) - 1 - both if len(b) > both else None, -1)
            joined = np.arange(n + len(made), n + len(made) + both)
            made += zip(own[tail].tolist(), other[mate].tolist(), strict=True)
            a = np.concatenate([a[: len(a) - both], a[tail] + b[mate], b[: len(b) - both]])
            own = np.concatenate([own[: len(own) - both], joined, other[: len(other) - both]])
        else:
            a, own = np.concatenate([a, b]), np.concatenate([own, other])
        order = np.argsort(-a, kind="stable")
        a, own = a[order], own[order]
        spread = int(a[0]) - (int(a[-1]) if len(a) == windows else 0)
        heapq.heappush(heap, (-spread, serial, a, own))
        serial += 1
    out = np.full(n + len(made), -1)
    if heap:
        out[heap[0][3]] = np.arange(len(heap[0][3]))
    for k in range(len(made) - 1, -1, -1):
        for part in made[k]:
            out[part] = out[n + k]
    return out[:n]


def pack_group(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each piece; full pieces have windows of their own, after the others."""
    full = lengths == capacity
    rests = lengths[~full]
    windows = -(-int(rests.sum()) // capacity)
    out = np.empty(len(lengths), np.int64)
    while len(rests):
        found = difference(rests, windows)
        if np.bincount(found, rests).max() <= capacity:
            out[~full] = found
            break
        windows += 1
    out[full] = (windows if len(rests) else 0) + np.arange(int(full.sum()))
    return out


def _tails(ids: np.ndarray, begin: np.ndarray, length: np.ndarray, capacity: int) -> np.ndarray:
    """Length of the small end to cut from a rest, 0 for none.

    Differencing needs small loads to even out large ones: every second rest gives one, of a size spread evenly over the
    powers of two from 4 to ``capacity / 16``, both told by the rest's ids.
    """
    most = int(capacity / 16)
    draw = ids[begin + length // 2].astype(np.uint64) * np.uint64(0x9E3779B1) + length.astype(np.uint64) * np.uint64(0x85EBCA6B)
    draw = (draw ^ (draw >> np.uint64(15))) * np.uint64(0x2C1B3C6D) % np.uint64(1 << 32) >> np.uint64(8)
    size = (4 * (most / 4) ** ((draw >> np.uint64(1)).astype(float) / (1 << 23))).astype(np.int64) if most > 4 else np.zeros(len(length), np.int64)
    return np.where((length < capacity) & (length > most) & (draw % np.uint64(2) == 0), size, 0)


def cut_documents(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document's ids (with ``end_id``): full windows, then the rest."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column(1), BATCH):
                ids, bounds = encoder(path).encode(chunk)
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4")  # a text's closing id comes before the next text
                bounds = bounds + np.arange(len(bounds))
                body = memoryview(ids).cast("B")
                sizes = np.diff(bounds)
                numbers = -(-sizes // capacity)
                row = np.repeat(np.arange(chunk.rows), numbers)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(numbers) - numbers, numbers)) * capacity
                length = np.minimum(sizes[row] - start, capacity)
                begin = bounds[:-1][row] + start
                tail = _tails(ids, begin, length, capacity)
                cut = np.flatnonzero(tail)
                row, start, begin = (np.insert(x, cut + 1, x[cut] + y) for x, y in ((row, 0), (start, (length - tail)[cut]), (begin, (length - tail)[cut])))
                length = np.insert(length - tail, cut + 1, tail[cut])
                crc = [zlib.crc32(body[4 * a : 4 * (a + m)]) for a, m in zip(begin.tolist(), length.tolist(), strict=True)]
                keys = batch.column(0).slice(chunk.first, chunk.rows).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(x, pa.int64()) for x in (start, length, crc, sizes[row]))], names)

    schema = ", ".join(f"{n} bigint" for n in names)
    return fields(df, doc_id="bigint", text="string").mapInArrow(run, schema)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``doc_id, start, length``; ``pieces`` is read twice."""
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (capacity * group_windows)))
    names = [*pieces.columns, "_none", "sequence_id", "offset"]
    schema = pieces.schema.simpleString()[7:-1].replace(":", " ") + ", _none boolean, sequence_id bigint, offset bigint"

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_none", "doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        group["_window"] = pack_group(group["length"].to_numpy(), capacity)
        group = group.sort_values("_window", kind="stable", ignore_index=True)
        before = group["length"].cumsum() - group["length"]
        group["offset"] = before - before.groupby(group["_window"]).transform("first")
        group["sequence_id"] = (int(key[0]) << 32) + group["_window"]
        return group[names]

    # dealt by piece, equal ones by their number: neither a null id nor a shared one fills a group
    copies = pieces.groupBy(*pieces.columns).agg(F.count("*").alias("_copies"))
    some = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    copies = copies.withColumn("_block", some(F.ceil(F.col("_copies") / COPIES)))
    copies = copies.withColumn("_copy", some(F.least(F.lit(COPIES), F.col("_copies") - F.col("_block") * COPIES)))
    place = F.xxhash64("doc_id", "start", "ids_crc32", "_block", "_copy")
    keyed = copies.select(*pieces.columns, F.col("doc_id").isNull().alias("_none"), F.pmod(place, F.lit(groups)).alias("_group"))
    # pandas would make floats of ids that stand beside nulls
    packed = keyed.withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("bigint"))).groupBy("_group").applyInPandas(pack, schema)
    return packed.withColumn("doc_id", F.when(~F.col("_none"), F.col("doc_id"))).drop("_none")


def pack_documents(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize, cut and pack whole documents: one row for each piece with its window and its place there."""
    return pack_pieces(stored(cut_documents(df, path, capacity, end_id), "pieces"), capacity)
