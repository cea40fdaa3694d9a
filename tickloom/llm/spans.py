"""Substring deduplication over words by compacting a de Bruijn graph.

The edges of the graph are the windows of ``window`` words; runs of windows with a common minimizer are its nonbranching
paths, compacted where they are cut: they are numbered within their document and known by a hash of their whole content.
A first exchange brings the paths of each gram together. A path that occurs twice is repeated as a whole; a gram with
several paths is a branching, and the paths that meet there are sent, joined back to their source texts, as single edges
with their coordinates, which a second exchange compares, dealt by their content. Joining the repeated runs to the texts gives the words to remove.

Every window is judged on the input. Null and empty texts have no words; equal rows are copies of each other; other
columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from tickloom.llm.overlaps import HELD, OPEN, REPEATED, SHOWN, gathered, key_array, keyed, mark, marked_chunks, parcels, ranges_of, removals, unsqueeze
from tickloom.llm.text import Anchors, Chunk, anchors, chunks, covered, mix, prefix, runs, spans, word_hashes, words

WINDOW = 35
GRAM = 11
_U = np.uint64


def word_paths(window: int, gram: int):
    """Paths of a chunk's texts; places are words of the chunk."""
    def paths(chunk: Chunk) -> tuple[Anchors, np.ndarray, np.ndarray]:
        starts, ends, bounds = words(chunk)
        running = prefix(word_hashes(chunk.data, starts, ends))
        found = anchors(running, bounds, window, gram)
        row = np.searchsorted(bounds, found.first, "right") - 1
        content = mix(spans(running, found.first, found.last + window) ^ mix((found.at - found.first).astype(_U)))
        return found, row, content

    return paths


def repeated_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``key, firsts, lasts``: runs of word windows that also start elsewhere; ``docs`` has ``key, doc_id, text``."""
    parts = ranges_of(docs.sparkSession)
    paths = word_paths(window, gram)

    def edges(batches):
        held: list[tuple] = []

        def tell(key: np.ndarray, first: np.ndarray, last: np.ndarray):
            none = np.zeros(len(key), _U)
            return parcels(key % parts, [none, none, key, first, last, none.astype(np.uint8)])

        def flush():
            gram_, edge, key, place, count = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if not len(edge):
                return
            order = np.lexsort((gram_, edge))
            gram_, edge, key, place, count = (x[order] for x in (gram_, edge, key, place, count))
            first = np.flatnonzero(np.concatenate([[True], (edge[1:] != edge[:-1]) | (gram_[1:] != gram_[:-1])]))
            number = np.add.reduceat(count.astype(np.int64), first)
            again = np.repeat(number > 1, np.diff(np.append(first, len(edge))))  # told here: every copy within the task
            out = np.flatnonzero(again & (count == 1))
            yield from tell(key[out], place[out], place[out])
            # equal edges have equal grams, so a gram may be spread over tasks
            part = (mix(edge[first]) % _U(parts)).astype(np.int64)
            yield from parcels(part, [gram_[first], edge[first], key[first], place[first], place[first], np.minimum(number, 2).astype(np.uint8)])

        for batch in batches:
            keys = key_array(batch.column(0))
            for chunk, rows, found, row, status in marked_chunks(batch, paths):
                starts, ends, bounds = words(chunk)
                key, base = keys[rows][row], bounds[row]
                whole = np.flatnonzero((status == REPEATED) | (status == SHOWN))
                yield from tell(key[whole], (found.first - base)[whole], (found.last - base)[whole])
                shown = np.flatnonzero((status == OPEN) | (status == SHOWN))
                number = (found.last - found.first + 1)[shown]
                path = np.repeat(shown, number)
                at = np.arange(len(path)) - np.repeat(np.cumsum(number) - number, number) + found.first[path]
                edge = spans(prefix(word_hashes(chunk.data, starts, ends)), at, at + window)
                count = np.where(status[path] == SHOWN, 2, 1).astype(np.uint8)
                held.append((found.key[path], edge, key[path], at - base[path], count))
                if sum(len(x[0]) for x in held) > HELD:
                    yield from flush()
        if held:
            yield from flush()

    def compare(batches):
        blobs = [unsqueeze(b, ["u8", "u8", "i8", "i8", "i8", "u1"]) for batch in batches for b in batch.column(1).to_pylist()]
        if not blobs:
            return
        gram_, edge, key, first, last, count = (np.concatenate(x) for x in zip(*blobs, strict=True))
        blobs.clear()
        told = count == 0
        yield removals(key[told], first[told], last[told])
        gram_, edge, key, first, count = (x[~told] for x in (gram_, edge, key, first, count))
        if not len(edge):
            return
        order = np.lexsort((edge, gram_))
        gram_, edge, key, first, count = (x[order] for x in (gram_, edge, key, first, count))
        head = np.flatnonzero(np.concatenate([[True], (edge[1:] != edge[:-1]) | (gram_[1:] != gram_[:-1])]))
        total = np.repeat(np.add.reduceat(count.astype(np.int64), head), np.diff(np.append(head, len(edge))))
        out = np.flatnonzero((total > 1) & (count == 1))
        yield removals(key[out], first[out], first[out])

    marked = docs.join(mark(docs, paths), "key", "left")
    sent = marked.mapInArrow(edges, "part int, blob binary").repartition(parts, "part")
    return gathered(sent.mapInArrow(compare, "key bigint, first bigint, last bigint"))


def _removed(batch: pa.RecordBatch, window: int):
    """For each chunk: batch rows, word starts and ends, the words' bounds, and which words go."""
    place = batch.schema.get_field_index
    firsts, lasts = batch.column(place("firsts")), batch.column(place("lasts"))
    first, last = (x.flatten().to_numpy(zero_copy_only=False) for x in (firsts, lasts))
    ends = np.concatenate([[0], np.cumsum(firsts.fill_null([]).value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    for chunk in chunks(batch.column(place("text"))):
        starts, stops, bounds = words(chunk)
        own = slice(ends[chunk.first], ends[chunk.first + chunk.rows])
        base = np.repeat(bounds[:-1], np.diff(ends[chunk.first : chunk.first + chunk.rows + 1]))
        yield chunk, starts, stops, bounds, covered(first[own] + base, last[own] + base, window, len(starts))


def _joined(df: DataFrame, window: int, gram: int, id_column: str, text_column: str, carry: tuple[str, ...] = ()) -> DataFrame:
    docs = keyed(df, id_column, text_column, carry)  # both joins take the same columns, so they share one exchange
    return docs.join(repeated_runs(docs, window, gram), "key", "left").select("doc_id", "text", "firsts", "lasts", *[f"_carry_{c}" for c in carry])


def span_report(df: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each document after removing all repeated windows."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]

    def report(batches):
        for batch in batches:
            for chunk, starts, stops, bounds, gone in _removed(batch, window):
                body, digest = chunk.data.tobytes(), []
                removed = np.add.reduceat(np.append(gone, False), bounds[:-1]) * (np.diff(bounds) > 0) if chunk.rows else []
                a, b = starts[~gone].tolist(), stops[~gone].tolist()
                kept = np.concatenate([[0], np.cumsum(~gone)])[bounds].tolist()
                for i in range(chunk.rows):
                    digest.append(hashlib.sha256(b" ".join([body[x:y] for x, y in zip(a[kept[i] : kept[i + 1]], b[kept[i] : kept[i + 1]], strict=True)])).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.rows), pa.array(np.diff(bounds)), pa.array(np.asarray(removed, np.int64)), pa.array(digest, pa.string())], names)

    return _joined(df, window, gram, "doc_id", "text").mapInArrow(report, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(df: DataFrame, window: int = WINDOW, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_column, text_column, changed`` and the columns to ``carry``, with repeated windows cut out of the texts.

    White space between kept words stays; a text without repeats is unchanged; a null text becomes empty.
    """
    def cut(batches):
        for batch in batches:
            for chunk, starts, stops, bounds, gone in _removed(batch, window):
                column = batch.column(1).slice(chunk.first, chunk.rows)
                texts = [x.as_py() for x in column.cast(pa.binary())]
                changed = np.diff(np.concatenate([[0], np.cumsum(gone)])[bounds]) > 0
                for i in np.flatnonzero(changed):
                    own = slice(bounds[i], bounds[i + 1])
                    a, b = runs(gone[own])
                    begin = np.append(starts[own], chunk.offsets[i + 1]) - chunk.offsets[i]  # a run goes with the white space after it
                    edge = np.concatenate([[0], np.stack([begin[a], begin[b]], 1).ravel(), [len(texts[i])]]).tolist()
                    texts[i] = b"".join(texts[i][x:y] for x, y in zip(edge[::2], edge[1::2], strict=True))
                rest = [batch.column(i).slice(chunk.first, chunk.rows) for i in range(4, batch.num_columns)]
                head = [batch.column(0).slice(chunk.first, chunk.rows), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(changed)]
                yield pa.RecordBatch.from_arrays([*head, *rest], ["doc_id", "text", "changed", *batch.schema.names[4:]])

    joined = _joined(df, window, gram, id_column, text_column, carry)
    kept = [joined.schema[f"_carry_{c}"] for c in carry]
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("changed", BooleanType()), *kept])
    return joined.mapInArrow(cut, schema).withColumnsRenamed({"doc_id": id_column, "text": text_column, **{f"_carry_{c}": c for c in carry}})
