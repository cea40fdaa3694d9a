"""Substring deduplication over bytes by a distributed merge sort of suffixes that knows common prefixes.

A first exchange finds the grams that start more than one segment of windows (:mod:`tickloom.llm.overlaps`); only suffixes
at their anchors can hold a repeated window. Each task sorts those of its texts into a run, tells copies within the run at
once, front-codes the run (length shared with the suffix before, then the rest) and cuts it at splitters: grams from a
sample of the suffixes that are sent. Each range merges its runs with a loser tree whose nodes hold the length
that a loser shares with the last winner: shared prefixes decide by their length and are never compared again.

Suffixes with one gram must meet in one range, as they may share any window around it. A gram with so many different
contexts in the sample that it would crowd a range is wide: each of its windows is sent as a suffix of its own, cut to the window and
without left context. Equal windows still meet, of a run's copies only the earliest is sent, and splitters may part all others.

In the merged order neighbouring shared lengths give, for any length, the classes of suffixes with equal beginnings;
sorted left contexts give the same for what stands before the anchor. Windows with equal classes on both sides are equal,
and all but the earliest go. Null and empty texts have no bytes; rows equal in id and text are one
document; null ids
come first; other columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.overlaps import UNIQUE, gathered, key_array, keyed, mark, marked_chunks, ranges_of, removals, squeeze, unsqueeze
from tickloom.llm.text import Anchors, Chunk, anchors, byte_values, chunks, covered, prefix, runs, stored

WINDOW = 100
GRAM = 36
#: Suffixes that a task sorts into one run.
RUN = 1 << 15
#: Bytes hashed together; every byte starts a gram, so this is smaller than for words.
PIECE = 1 << 18
#: Ranges for each shuffle partition, at least; a range is merged in memory.
RANGES = 4
#: Suffixes of a range, about; there are more ranges and partitions where the corpus needs them.
RANGE = 1 << 16
#: Suffixes sampled for splitters and wide grams, about; this bounds what is broadcast and what the driver holds.
SAMPLE = 1 << 17
#: Sampled contexts that a gram has at least before it counts as wide.
_LEAST = 8


def byte_segments(window: int, gram: int):
    def segments(chunk: Chunk) -> tuple[Anchors, np.ndarray, np.ndarray]:
        found = anchors(prefix(byte_values(chunk.data)), chunk.offsets, window, gram)
        row = np.searchsorted(chunk.offsets, found.first, "right") - 1
        return found, row, found.key  # the gram alone: whatever shares it is sorted

    return segments


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Lengths shared with the suffix before, and the rests one after another."""
    shared = [0]
    for a, b in itertools.pairwise(suffixes):
        shared.append(shared_length(a, b, 0))
    return np.array(shared, np.int32), b"".join([s[n:] for s, n in zip(suffixes, shared, strict=True)])


def shared_length(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


def merge_runs(heads: list) -> tuple[list[bytes], list[int], list[int]]:
    """Merge sorted runs, each an iterator of ``(suffix, length shared with the one before, tag)``.

    Gives the suffixes, the length each shares with the one before it in the merged order, and the tags.
    """
    k = 1
    while k < len(heads):
        k *= 2
    out, lengths, tags = [], [], []
    end = None
    current = [next(h, end) for h in heads] + [end] * (k - len(heads))
    heads = [h.__next__ for h in heads]
    common = [0] * k  # of each run's head with the last winner
    loser = [0] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        winner, lost = match(a, b)
        loser[node] = lost
        return winner

    def match(a: int, b: int) -> tuple[int, int]:
        x, y = current[a], current[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        m, n = common[a], common[b]
        if m != n:
            return (a, b) if m > n else (b, a)
        s, t = x[0], y[0]
        both = shared_length(s, t, m)
        if s[both:] <= t[both:]:
            common[b] = both
            return a, b
        common[a] = both
        return b, a

    best = play(1)
    while (item := current[best]) is not None:
        out.append(item[0])
        lengths.append(common[best])
        tags.append(item[2])
        try:
            current[best] = item = heads[best]()
            common[best] = item[1]
        except StopIteration:
            current[best] = None
        node = (best + k) >> 1
        while node:
            other = loser[node]
            y = current[other]
            if y is not None:
                x = current[best]
                if x is None:
                    loser[node], best = best, other
                else:
                    m, n = common[best], common[other]
                    if m < n:
                        loser[node], best = best, other
                    elif m == n:
                        s, t = x[0], y[0]
                        both = shared_length(s, t, m)
                        if s[both:] <= t[both:]:
                            common[other] = both
                        else:
                            common[best] = both
                            loser[node], best = best, other
            node >>= 1
    return out, lengths, tags


def _decode(shared: np.ndarray, sizes: np.ndarray, body: bytes, tag: int):
    before, at = b"", 0
    for n, size in zip(shared.tolist(), sizes.tolist(), strict=True):
        to = at + size - n
        before = before[:n] + body[at:to]
        at = to
        yield before, n, tag
        tag += 1


def _left_classes(lefts: list[bytes], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the left contexts (read from the anchor outwards) and the lengths that neighbours share."""
    n = len(lefts)
    sizes = np.fromiter(map(len, lefts), np.int64, n)
    width = -(-max(reach, 1) // 8) * 8
    table = np.zeros((n, width), np.uint8)
    fill = np.arange(width)[None, :] < sizes[:, None]
    table[fill] = np.frombuffer(b"".join([x[::-1] for x in lefts]), np.uint8)
    columns = table.view(">u8")
    order = np.lexsort((sizes, *(columns[:, j] for j in range(columns.shape[1] - 1, -1, -1))))
    differ = table[order][1:] != table[order][:-1]
    same = np.where(differ.any(1), differ.argmax(1), width)
    return order, np.concatenate([[0], np.minimum(same, np.minimum(sizes[order][1:], sizes[order][:-1]))])


def later_windows(lefts: list[bytes], sizes: np.ndarray, shared: np.ndarray, rank: np.ndarray, window: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, smallest and largest offset of the runs of windows that start earlier as well.

    Rows are suffixes in merged order; a window of offset o has o bytes before the anchor and ``window - o`` from it on.
    ``rank`` orders rows by where they stand in the corpus.
    """
    n = len(lefts)
    most = np.fromiter(map(len, lefts), np.int64, n)
    least = window - sizes
    order, left_shared = _left_classes(lefts, reach)
    gone = np.zeros((n, reach + 2), bool)
    left = np.empty(n, np.int64)
    for o in range(int(least.min()), int(most.max()) + 1):
        rows = np.flatnonzero((least <= o) & (o <= most))
        left[order] = np.cumsum(left_shared < o) if o else 0
        right = np.cumsum(shared < window - o)
        key = right[rows] * (n + 1) + left[rows]
        inner = np.lexsort((rank[rows], key))
        key, order_of = key[inner], rank[rows[inner]]
        head = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        earliest = order_of[np.flatnonzero(head)][np.cumsum(head) - 1]
        gone[rows[inner[order_of > earliest]], o + 1] = True
    step = np.diff(gone.view(np.int8), axis=1, append=0)
    row, begin = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    return row, begin, end - 1


class Ranges(NamedTuple):
    """How sent suffixes are dealt: which range a suffix belongs to, and whose windows are sent one by one."""

    edges: list[bytes]  # grams
    windows: list[bytes]  # windows of wide grams
    wide: np.ndarray  # hashes of wide grams

    def cut(self, strings: list[bytes], wide: bool) -> np.ndarray:
        """Ranges of sorted suffixes; those of wide windows come behind all others."""
        edges, base = (self.windows, len(self.edges) + 1) if wide else (self.edges, 0)
        size = len(edges[0]) if edges else 0
        return np.array([base + bisect.bisect_right(edges, x[:size]) for x in strings], np.int32)

    @property
    def number(self) -> int:
        return len(self.edges) + len(self.windows) + 2


def _quantiles(strings: list[bytes], weights: np.ndarray, parts: int) -> list[bytes]:
    """At most ``parts - 1`` of the sorted strings, which cut them into ranges of about equal weight."""
    if parts < 2 or not strings:
        return []
    total = np.cumsum(weights)
    at = np.searchsorted(total, total[-1] * np.arange(1, parts) / parts)
    return [strings[i] for i in np.unique(at).tolist()]


def ranges(docs: DataFrame, marks: DataFrame, window: int, gram: int) -> Ranges:
    """Ranges of about ``RANGE`` suffixes, from a sample of about ``SAMPLE`` of those that ``marks`` (stored) names.

    The sample decides only how work is dealt, never what is found.
    """
    segments = byte_segments(window, gram)
    total = marks.agg(F.sum(F.size("codes"))).first()[0] or 0
    rate = -(-total // SAMPLE) or 1
    places = marks.select("key", F.explode("codes").alias("code")).where(F.pmod(F.xxhash64("key", "code"), F.lit(rate)) == 0)
    picked = places.groupBy("key").agg(F.collect_set("code").alias("codes"))

    def pick(batches):
        for batch in batches:
            for chunk, _, found, _, status in marked_chunks(batch, segments, PIECE):
                own = np.flatnonzero(status != UNIQUE)
                if len(own):
                    body = chunk.data.tobytes()
                    around = [body[a : b + window] for a, b in zip(found.first[own].tolist(), found.last[own].tolist(), strict=True)]
                    columns = [around, found.at[own] - found.first[own], found.key[own].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["around", "before", "hash"])

    # SAMPLE places at most, about, as the rate comes from their count
    chosen = docs.join(F.broadcast(picked), "key").select("key", "text", "codes")
    rows = chosen.mapInArrow(pick, "around binary, before bigint, hash bigint")
    contexts = stored(rows.distinct(), "sample")
    counts = contexts.groupBy("hash", F.expr(f"substring(around, int(before) + 1, {gram})").alias("gram")).agg(F.count("*").alias("contexts"))
    crowds = F.col("contexts") * rate > max(RANGE // 2, (_LEAST - 1) * rate)
    least = RANGES * ranges_of(docs.sparkSession)
    near = counts.where(~crowds).select("gram", "contexts").toArrow().sort_by("gram")
    edges = _quantiles(near["gram"].to_pylist(), near["contexts"].to_numpy(), max(least, -(-total // RANGE)))
    wide = counts.where(crowds).select("hash").distinct().toArrow()["hash"].to_numpy()  # SAMPLE / _LEAST at most
    if not len(wide):
        return Ranges(edges, [], wide.astype(np.uint64))
    crowded = contexts.join(F.broadcast(counts.where(crowds).select("hash").distinct()), "hash")
    starts = F.expr(f"sequence(1, length(around) - {window - 1})")
    every = crowded.select("around", F.explode(starts).alias("start")).select(F.expr(f"substring(around, start, {window})").alias("window"))
    thin = -(-(every.count()) // SAMPLE)
    windows = every.where(F.pmod(F.xxhash64("window"), F.lit(thin)) == 0).distinct().toArrow().sort_by("window")["window"].to_pylist()
    return Ranges(edges, _quantiles(windows, np.ones(len(windows)), max(least, -(-len(windows) * thin * rate // RANGE))), wide.astype(np.int64).view(np.uint64))


def earlier_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``key, firsts, lasts``: runs of byte windows that also start earlier; ``docs`` has ``key, doc_id, text``."""
    segments = byte_segments(window, gram)
    marks = stored(mark(docs, segments, PIECE), "marks")
    dealt = ranges(docs, marks, window, gram)
    parts = max(ranges_of(docs.sparkSession), -(-dealt.number // RANGES))

    def sort(batches):
        near: list[tuple] = []  # suffix, left context, id, key, place
        wide: list[tuple] = []  # the same of single windows

        def flush(held, of_windows):
            if not held:
                return
            held.sort()
            first, told = [], []
            for item in held:  # of equal contexts the earliest stands for the run
                if first and item[:2] == first[-1][:2]:
                    if item[2:] != first[-1][2:]:
                        told.append(item)
                else:
                    first.append(item)
            held.clear()
            part = dealt.cut([x[0] for x in first], of_windows)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).tolist()
            blobs = [_pack(first[a:b]) for a, b in itertools.pairwise(cut)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]]), pa.array(blobs, pa.binary())], ["part", "blob"])
            if told:
                key, place, left, size = (np.array(x, np.int64) for x in zip(*((k, p, len(b), len(a)) for a, b, _, k, p in told), strict=True))
                order = np.argsort(key % parts, kind="stable")
                part = (key % parts)[order]
                cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).tolist()
                table = [key[order], (place - left)[order], (place + size - window)[order]]
                blobs = [b"\1" + squeeze([c[a:b] for c in table]) for a, b in itertools.pairwise(cut)]
                yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "blob"])

        for batch in batches:
            keys = key_array(batch.column(0))
            ids = batch.column(1).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            for chunk, rows, found, row, status in marked_chunks(batch, segments, PIECE):
                body, base = chunk.data.tobytes(), chunk.offsets[row]
                single = np.isin(found.key, dealt.wide)
                for i in np.flatnonzero(status != UNIQUE).tolist():
                    at, first, last = int(found.at[i]), int(found.first[i]), int(found.last[i])
                    where, start = (int(ids[rows[row[i]]]), int(keys[rows[row[i]]])), int(base[i])
                    if single[i]:
                        wide += [(body[s : s + window], b"", *where, s - start) for s in range(first, last + 1)]
                    else:
                        near.append((body[at : last + window], body[first:at], *where, at - start))
                    if len(wide) > RUN:
                        yield from flush(wide, True)
                if len(near) > RUN:
                    yield from flush(near, False)
        yield from flush(near, False)
        yield from flush(wide, True)

    def merge(batches):
        waiting: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if blob[:1] == b"\1":
                    yield removals(*unsqueeze(blob[1:], ["i8", "i8", "i8"]))
                else:
                    waiting.setdefault(part, []).append(blob)
        while waiting:  # one range at a time: a task may have been given several
            yield merged(waiting.popitem()[1])

    def merged(blobs: list[bytes]) -> pa.RecordBatch:
        heads, lefts, where, begin = [], [], [], 0
        for blob in blobs:
            shared, sizes, body, left, place = _unpack(blob[1:])
            heads.append(_decode(shared, sizes, body, begin))
            begin += len(sizes)
            lefts += left
            where.append(place)
        suffixes, shared, tags = merge_runs(heads)
        tags = np.array(tags)
        where = np.concatenate(where)[tags]
        rank = np.unique(where, axis=0, return_inverse=True)[1].ravel()  # equal rows are one document
        sizes = np.fromiter(map(len, suffixes), np.int64, len(suffixes))
        suffixes.clear()
        row, least, most = later_windows([lefts[t] for t in tags.tolist()], sizes, np.array(shared), rank, window, max(map(len, lefts)))
        return removals(where[row, 1], where[row, 2] - most, where[row, 2] - least)

    marked = docs.join(marks, "key", "left")
    sent = marked.mapInArrow(sort, "part int, blob binary").repartition(parts, "part")
    return gathered(sent.mapInArrow(merge, "key bigint, first bigint, last bigint"))


def _pack(items: list[tuple]) -> bytes:
    shared, rests = front_code([x[0] for x in items])
    left_shared, lefts = front_code([x[1] for x in items])
    table = [shared, np.array([len(x[0]) for x in items], np.int32), left_shared, np.array([len(x[1]) for x in items], np.int32)]
    where = [np.array([x[j] for x in items], np.int64) for j in (2, 3, 4)]
    return b"\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (squeeze([*table, *where]), squeeze([np.frombuffer(rests, np.uint8)]), squeeze([np.frombuffer(lefts, np.uint8)])))


def _unpack(blob: bytes):
    parts, at = [], 0
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 4], "big")
        parts.append(blob[at + 4 : at + 4 + size])
        at += 4 + size
    shared, sizes, left_shared, left_sizes, *where = unsqueeze(parts[0], ["i4"] * 4 + ["i8"] * 3)
    rests, lefts = (unsqueeze(x, ["u1"])[0].tobytes() for x in parts[1:])
    return shared, sizes, rests, [x for x, _, _ in _decode(left_shared, left_sizes, lefts, 0)], np.stack(where, 1)


def _gone(batch: pa.RecordBatch, window: int):
    place = batch.schema.get_field_index
    firsts, lasts = batch.column(place("firsts")), batch.column(place("lasts"))
    first, last = (x.flatten().to_numpy(zero_copy_only=False) for x in (firsts, lasts))
    ends = np.concatenate([[0], np.cumsum(firsts.fill_null([]).value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    for chunk in chunks(batch.column(place("text"))):
        own = slice(ends[chunk.first], ends[chunk.first + chunk.rows])
        base = np.repeat(chunk.offsets[:-1], np.diff(ends[chunk.first : chunk.first + chunk.rows + 1]))
        yield chunk, covered(first[own] + base, last[own] + base, window, len(chunk.data))


def byte_report(df: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each document without bytes of windows seen earlier."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def report(batches):
        for batch in batches:
            for chunk, gone in _gone(batch, window):
                table = []
                for a, b in itertools.pairwise(chunk.offsets.tolist()):
                    own = gone[a:b]
                    kept = chunk.data[a:b][~own].tobytes()
                    table.append((b - a, b - a - len(kept), len(runs(own)[0]), hashlib.sha256(kept).hexdigest()))
                columns = [list(x) for x in zip(*table, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.rows), *(pa.array(c) for c in columns)], names)

    return _joined(df, window, gram).mapInArrow(report, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def _joined(df: DataFrame, window: int, gram: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    docs = keyed(df, id_column, text_column)
    return docs.join(earlier_runs(docs, window, gram), "key", "left").select("doc_id", "text", "firsts", "lasts")


def without_later(df: DataFrame, window: int = WINDOW, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and ``kept``, the remaining bytes (which may cut a character)."""
    def cut(batches):
        for batch in batches:
            for chunk, gone in _gone(batch, window):
                kept = [chunk.data[a:b][~gone[a:b]].tobytes() for a, b in itertools.pairwise(chunk.offsets.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.rows), pa.array(kept, pa.binary())], ["doc_id", "kept"])

    return _joined(df, window, gram, id_column, text_column).mapInArrow(cut, "doc_id bigint, kept binary").withColumnRenamed("doc_id", id_column)
