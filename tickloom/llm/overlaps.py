"""Shared steps of the substring operators: which minimizer anchors of a corpus occur more than once.

A document's windows are cut into segments, the runs of windows with the same minimizer (:func:`tickloom.llm.text.anchors`).
Equal windows have equal grams at the same offset, so only segments whose gram occurs elsewhere can hold repeated windows.
Tasks send packed columns instead of a row for each segment, and tell copies within a task at once: a hot passage reaches
its reducer once for each task, not once for each document.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import CHUNK, Anchors, Chunk, binary, chunks, mix

#: Records that a task holds before it sends them.
HELD = 1 << 18
#: Contents of a gram among them from which on they are dealt by content.
SPREAD = 16
UNIQUE, REPEATED, OPEN, SHOWN = range(4)
#: Copies of a record: none that are not told yet, one, more, a mark that a gram has this content; with KNOWN the gram has other content.
_TOLD, _MARK, _KNOWN = 0, 3, 4
_U = np.uint64


def keyed(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key, doc_id, text``, and columns to carry along; the key tells rows apart, equal rows share it."""
    doc_id, text = df[id_column].cast("bigint"), F.coalesce(df[text_column].cast("string"), F.lit(""))
    return df.select(F.xxhash64(doc_id, text).alias("key"), doc_id.alias("doc_id"), text.alias("text"), *[df[c].alias(f"_carry_{c}") for c in carry])


def ranges_of(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def squeeze(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length as one compressed blob."""
    parts = [np.array([len(columns[0]) if columns else 0], np.int64).tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unsqueeze(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(body, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(body, kind, n, at))
        at += out[-1].nbytes
    return out


def parcels(part: np.ndarray, columns: list[np.ndarray], name: str = "part") -> Iterator[pa.RecordBatch]:
    """Rows ``(part, kind 0, blob)``, one for each part."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    columns = [c[order] for c in columns]
    edge = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
    blobs = [squeeze([c[a:b] for c in columns]) for a, b in itertools.pairwise(edge.tolist())]
    yield pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], [name, "blob"])


def key_array(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def mark(docs: DataFrame, segments: Callable[[Chunk], tuple[Anchors, np.ndarray, np.ndarray]], piece: int = CHUNK) -> DataFrame:
    """``key, codes``: for each text with a shared gram, ``4 * segment + status`` of the segments concerned.

    ``segments`` gives a chunk's anchors, each one's row and a hash of its whole content. ``REPEATED`` segments occur whole
    elsewhere; ``OPEN`` ones share their gram with other content; ``SHOWN`` ones are repeated, and the ones through which
    open segments of the same gram see them. Segments are numbered within their text.

    A gram with more than ``SPREAD`` contents in a task has its records dealt by content, and leaves two marks where other tasks
    send the gram, so that it is known there to have other content. Copies that so miss each other are ``OPEN``.
    """
    parts = ranges_of(docs.sparkSession)

    def send(batches):
        held: list[tuple] = []

        def flush():
            gram, content, key, place = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((content, gram))
            gram, content, key, place = gram[order], content[order], key[order], place[order]
            head = np.concatenate([[True], (gram[1:] != gram[:-1]) | (content[1:] != content[:-1])])
            first = np.flatnonzero(head)
            number = np.diff(np.append(first, len(gram)))
            again = np.repeat(number > 1, number)  # told here: every copy within the task
            begin = np.flatnonzero(np.concatenate([[True], gram[first][1:] != gram[first][:-1]]))
            kinds = np.diff(np.append(begin, len(first)))
            hot = np.repeat(kinds > SPREAD, kinds)
            copies = (np.minimum(number, 2) + np.where(hot, _KNOWN, 0)).astype(np.uint8)
            marks = begin[kinds > SPREAD]
            marks = np.concatenate([marks, marks + 1])
            sent = np.concatenate([first, first[marks]])
            part = np.concatenate([np.where(hot, mix(content[first]), gram[first]), gram[first[marks]]]) % _U(parts)
            copies = np.concatenate([copies, np.full(len(marks), _MARK, np.uint8)])
            yield from parcels(part.astype(np.int64), [gram[sent], content[sent], key[sent], place[sent], copies])
            told = np.flatnonzero(again)
            yield from parcels((key[told] % parts), [np.zeros(len(told), _U), np.zeros(len(told), _U), key[told], place[told], np.zeros(len(told), np.uint8)])

        for batch in batches:
            keys = key_array(batch.column(0))
            for chunk in chunks(batch.column(1), piece):
                found, row, content = segments(chunk)
                if len(row):
                    place = np.arange(len(row)) - np.searchsorted(row, np.arange(chunk.rows))[row]
                    held.append((found.key, content, keys[chunk.first + row], place.astype(np.uint32)))
                if sum(len(x[0]) for x in held) > HELD:
                    yield from flush()
        if held:
            yield from flush()

    def resolve(batches):
        blobs = [unsqueeze(b, ["u8", "u8", "i8", "u4", "u1"]) for batch in batches for b in batch.column(1).to_pylist()]
        if not blobs:
            return
        gram, content, key, place, number = (np.concatenate(x) for x in zip(*blobs, strict=True))
        blobs.clear()
        told = number == _TOLD
        yield _codes(key[told], place[told], np.full(int(told.sum()), REPEATED))
        gram, content, key, place, number = (x[~told] for x in (gram, content, key, place, number))
        if not len(gram):
            return
        mark_ = number == _MARK
        order = np.lexsort((place, key, mark_, content, gram))  # marks last
        gram, content, key, place, number, mark_ = (x[order] for x in (gram, content, key, place, number, mark_))
        known, number = number >= _KNOWN, np.where(mark_, 0, number % _KNOWN)
        head = np.concatenate([[True], (gram[1:] != gram[:-1]) | (content[1:] != content[:-1])])
        first = np.flatnonzero(head)
        segment = np.cumsum(head) - 1
        total = np.add.reduceat(number.astype(np.int64), first)
        start = np.concatenate([[True], gram[first][1:] != gram[first][:-1]])
        kinds = np.diff(np.append(np.flatnonzero(start), len(first)))
        shared = np.repeat(kinds > 1, kinds) | np.logical_or.reduceat(known, first)  # the gram has other content as well
        status = np.where(total > 1, REPEATED, np.where(shared, OPEN, UNIQUE))[segment]
        status[first[shared & (total > 1)]] = SHOWN
        yield _codes(*(x[(status != UNIQUE) & ~mark_] for x in (key, place, status)))

    rows = docs.select("key", "text").mapInArrow(send, "part int, blob binary").repartition(parts, "part")
    return rows.mapInArrow(resolve, "key bigint, code bigint").groupBy("key").agg(F.collect_list("code").alias("codes"))


def _codes(key: np.ndarray, place: np.ndarray, status: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(place.astype(np.int64) * 4 + status)], ["key", "code"])


def marked_chunks(batch: pa.RecordBatch, segments, piece: int = CHUNK, text: str = "text", codes: str = "codes"):
    """For the texts of a batch that have codes: chunk, batch rows, anchors, each one's chunk row, and each one's status."""
    lists = batch.column(batch.schema.get_field_index(codes))
    rows = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
    if not len(rows):
        return
    texts = binary(batch.column(batch.schema.get_field_index(text))).take(pa.array(rows))
    lists = lists.take(pa.array(rows))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    for chunk in chunks(texts, piece):
        found, row, _ = segments(chunk)
        start = np.searchsorted(row, np.arange(chunk.rows + 1))
        own = flat[ends[chunk.first] : ends[chunk.first + chunk.rows]]
        owner = np.repeat(np.arange(chunk.rows), np.diff(ends[chunk.first : chunk.first + chunk.rows + 1]))
        status = np.zeros(len(row), np.int64)
        np.maximum.at(status, start[owner] + (own >> 2), own & 3)
        yield chunk, rows[chunk.first : chunk.first + chunk.rows], found, row, status


def removals(key: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Runs of window starts within texts."""
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(np.int64)) for x in (key, first, last)], ["key", "first", "last"])


def gathered(runs: DataFrame) -> DataFrame:
    """All runs of a text together: ``key, firsts, lasts``; as many as the text has segments and open windows at most."""
    pairs = runs.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    return pairs.select("key", F.col("runs.first").alias("firsts"), F.col("runs.last").alias("lasts"))
