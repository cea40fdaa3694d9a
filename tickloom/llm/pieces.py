"""SentencePiece encoding and decoding over a table of distinct chunks.

Where no piece of a model has a white-space marker behind another character, no merge crosses the place before a run of
markers. A text is cut there into marked words, ``▁▁the`` for two spaces and a word; each distinct one of a batch is
segmented once, and its ids are joined back to all its positions. The table of a Python worker is kept from batch to batch
up to a bound.

Segmentation merges the neighbours whose piece scores best, the leftmost of equals, as BPE models of the library do:
in rounds over the flat symbols of many chunks, chunks of more than ``LONG`` symbols by a heap. Characters
without a piece become their UTF-8 bytes' pieces.

Null and empty texts have only the begin and end ids. Nothing is cut: a text of any length, and a chunk of any length, is encoded whole.
Repeated rows give repeated results, null ids stay null, other columns are passed over, an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.text import Chunk, chunks, fields, word_hashes

MARK = "▁"
#: Symbols beyond which a chunk is merged by a heap, as rounds over a single chunk would be many.
LONG = 64
#: Most distinct chunks kept from one batch to the next; a bound on memory only.
CACHE_CHUNKS = 1_000_000
#: Bytes of text encoded together.
BATCH = 1 << 22
#: Symbols from here on stand for characters that have no piece.
LOOSE = 1 << 24
# kinds of pieces in a model file (fixed values of the file format)
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)


def _one_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("tickloom-one-byte", _one_byte)


class PieceModel:
    """Tables of a SentencePiece model file of kind BPE with byte pieces and no normalisation but the markers."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as source:
            model.ParseFromString(source.read())
        rules, kinds = model.normalizer_spec, [p.type for p in model.pieces]
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte pieces and markers before words")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
            raise ValueError("only models without normalisation, with a marker before the text")
        if USER_DEFINED in kinds or UNUSED in kinds:
            raise ValueError("models with user-defined or unused pieces cut texts differently")
        self.begin, self.end, self.unknown = (self._single(model, kinds, name) for name in ("<s>", "</s>", "<unk>"))
        self.unknown_text = model.trainer_spec.unk_surface.encode()
        pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses a white-space marker")
        self.surface = np.empty(len(kinds), object)
        self.surface[:] = [b"" if p.type == CONTROL else self.unknown_text if p.type == UNKNOWN else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        self.control = np.array([k == CONTROL for k in kinds])
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.byte_ids = np.zeros(256, np.int64)
        for i in np.flatnonzero(self.is_byte).tolist():
            value = int(model.pieces[i].piece[1:-1], 16)
            self.byte_ids[value] = i
            self.surface[i] = bytes([value])
        # the symbol of each single character, and every pair of symbols that makes a piece
        self.single = np.arange(LOOSE, LOOSE + 0x110000, dtype=np.int64)
        for piece, i in pieces.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i
        scores = sorted({model.pieces[i].score for i in pieces.values()}, reverse=True)
        ranks = {score: rank for rank, score in enumerate(scores)}
        symbol = lambda s: pieces.get(s, LOOSE + ord(s) if len(s) == 1 else None)
        table = []
        for piece, i in pieces.items():
            for at in range(1, len(piece)):
                left, right = symbol(piece[:at]), symbol(piece[at:])
                if left is not None and right is not None:
                    table.append((left << 32 | right, ranks[model.pieces[i].score], i))
        table.sort()
        self.keys, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*table, strict=True))
        self.none = len(scores)
        self.pairs = {key: (rank, made) for key, rank, made in table}
        # equal merges may be done at all their places at once if what they make is in no merge of an equal or better rank
        first_use = np.full(len(kinds), self.none)
        for side in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            known = side < LOOSE
            np.minimum.at(first_use, side[known], self.ranks[known])
        self.at_once = np.append(first_use[self.made] > self.ranks, False)
        numbers = np.bincount(self.ranks[np.unique(self.made, return_index=True)[1]], minlength=self.none)
        self.at_once[:-1] &= numbers[self.ranks] == 1  # a rank that several pieces share goes place by place

    @staticmethod
    def _single(model, kinds: list[int], name: str) -> int:
        return next(i for i, p in enumerate(model.pieces) if p.piece == name and kinds[i] in (CONTROL, UNKNOWN))

    def _pairs_at(self, symbol: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Index of the pair that starts at each place; the number of pairs where there is none."""
        after = np.minimum(at + 1, len(symbol) - 1)
        key = symbol[at] << 32 | symbol[after]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[place] == key) & (owner[at] == owner[after]) & (after != at)
        return np.where(found, place, len(self.keys))

    def _rounds(self, symbol: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge in rounds: each takes the best pair of every chunk that still has one."""
        ranks = np.append(self.ranks, self.none)
        done = []
        pair = self._pairs_at(symbol, owner, np.arange(len(symbol)))
        while len(symbol):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            rank = ranks[pair]
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(owner))))
            over = best == self.none
            if over.any():
                done.append((symbol[over], owner[over]))
                symbol, owner, pair, rank, best = (x[~over] for x in (symbol, owner, pair, rank, best))
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == best)
            start = np.append(True, hit[1:] != hit[:-1] + 1)  # of overlapping pairs every second from the left
            head = np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - head) % 2 == 0]
            hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]]) | self.at_once[pair[hit]]]
            symbol[hit] = self.made[pair[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            changed = np.zeros(len(symbol), bool)
            changed[hit] = True
            changed[hit[hit > 0] - 1] = True
            changed[hit[hit > 1] - 2] = True  # the left neighbour may itself be a merged pair
            symbol, owner, pair, changed = (x[keep] for x in (symbol, owner, pair, changed))
            at = np.flatnonzero(changed)
            pair[at] = self._pairs_at(symbol, owner, at)
        if not done:
            return symbol, owner
        symbols, owners = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owners, kind="stable")
        return symbols[order], owners[order]

    def _by_heap(self, symbols: list[int]) -> list[int]:
        """One long chunk: the best pair from a heap, neighbours in linked lists."""
        n = len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []

        def offer(left: int, right: int) -> None:
            found = self.pairs.get(symbols[left] << 32 | symbols[right]) if left >= 0 and right >= 0 else None
            if found:
                heapq.heappush(heap, (found[0], left, right, symbols[left], symbols[right], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, a, b, made = heapq.heappop(heap)
            if symbols[left] != a or symbols[right] != b or after[left] != right:
                continue  # one side is part of another piece by now
            symbols[left], symbols[right] = made, -1
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbols if s >= 0]

    def segment(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of marked words, given with spaces for markers, and the number of ids of each."""
        texts = [p.decode("utf-8", "replace") for p in parts]
        points = np.frombuffer("".join(texts).replace(" ", MARK).encode("utf-32-le", "replace"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        symbol, owner = self.single[points], np.repeat(np.arange(len(parts)), lengths)
        short = (lengths <= LONG)[owner]
        symbols, owners = self._rounds(symbol[short], owner[short])
        long = np.flatnonzero(lengths > LONG)
        if len(long):
            starts = np.cumsum(lengths) - lengths
            merged = [self._by_heap(symbol[starts[i] : starts[i] + lengths[i]].tolist()) for i in long.tolist()]
            symbols = np.concatenate([symbols, *[np.array(m, np.int64) for m in merged]])
            owners = np.concatenate([owners, np.repeat(long, [len(m) for m in merged])])
            order = np.argsort(owners, kind="stable")
            symbols, owners = symbols[order], owners[order]
        return self._with_bytes(symbols, owners, len(parts))

    def _with_bytes(self, symbols: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        point = np.maximum(symbols - LOOSE, 0)
        width = np.where(symbols < LOOSE, 1, 1 + (point > 0x7F).astype(np.int64) + (point > 0x7FF) + (point > 0xFFFF))
        ids, end = np.repeat(symbols, width), np.cumsum(width)
        for i in np.flatnonzero(symbols >= LOOSE).tolist():
            ids[end[i] - width[i] : end[i]] = self.byte_ids[list(chr(int(point[i])).encode("utf-8", "surrogatepass"))]
        return ids, np.bincount(owners, width, n).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte pieces joined where they make characters, U+FFFD for each byte that does not, no control pieces."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.surface)):
            raise ValueError("an id is outside the model")
        runs = np.flatnonzero(self.control[ids])
        parts = [p for p in np.split(ids, runs)] if len(runs) else [ids]  # a control piece ends a run of bytes
        text = "".join(b"".join(self.surface[p].tolist()).decode("utf-8", "tickloom-one-byte") for p in parts)
        shown = ids[~self.control[ids]]
        leads = len(shown) and not self.is_byte[shown[0]] and shown[0] != self.unknown and text.startswith(" ")
        return text[1:] if leads else text


class ChunkTable:
    """The distinct marked words met so far, by a 64-bit hash of their bytes, with the ids of each."""

    def __init__(self, segment, most: int = CACHE_CHUNKS):
        self.segment, self.most = segment, most
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _add(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        ids, counts = self.segment(parts)
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes, kind="stable")
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])[order]
        self.counts = np.concatenate([self.counts, counts])[order]
        self.hashes, self.ids = hashes[order], np.concatenate([self.ids, ids.astype(np.int32)])

    def lookup(self, body: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each marked word begin in ``self.ids``, and how many they are."""
        distinct, place, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self.hashes, assume_unique=True)
        if len(self.hashes) + new.sum() > self.most:
            self._forget()
            new[:] = True
        if new.any():
            at = place[new]
            self._add(distinct[new], [body[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        known = np.searchsorted(self.hashes, distinct)[inverse]
        return self.starts[known], self.counts[known]


def marked(chunk: Chunk) -> Chunk:
    """The texts as the model reads them, a space for each marker: one before each text that is not empty."""
    data, offsets = chunk.data, chunk.offsets
    if MARK.encode() in data.tobytes():  # a marker in the text is a space
        texts = [data[a:b].tobytes().replace(MARK.encode(), b" ") for a, b in itertools.pairwise(offsets.tolist())]
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    filled = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][filled], 32)
    return Chunk(chunk.first, chunk.rows, data, offsets + np.concatenate([[0], np.cumsum(filled)]))


def encode(chunk: Chunk, model: PieceModel, table: ChunkTable) -> tuple[np.ndarray, np.ndarray]:
    """int32 ids of all texts of a chunk with begin and end ids, and where each text's ids begin (with the end)."""
    chunk = marked(chunk)
    data, offsets = chunk.data, chunk.offsets
    space = data == 32
    head = space.copy()
    head[1:] &= ~space[:-1]
    filled = np.flatnonzero(np.diff(offsets))
    head[offsets[filled]] = True  # a text's start is a cut, whatever the text before ends in
    starts = np.flatnonzero(head)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    begins, counts = table.lookup(data.tobytes(), word_hashes(data, starts, ends), starts, ends) if len(starts) else (starts, starts)
    after = np.concatenate([[0], np.cumsum(counts)])
    bounds = after[np.searchsorted(starts, offsets)]  # in ids without begin and end
    flat = table.ids[np.arange(after[-1]) + np.repeat(begins - after[:-1], counts)]
    row = np.arange(chunk.rows + 1)
    out = np.empty(len(flat) + 2 * chunk.rows, np.int32)
    body = np.ones(len(out), bool)
    first, last = bounds[:-1] + 2 * row[:-1], bounds[1:] + 2 * row[:-1] + 1
    body[first] = body[last] = False
    out[first], out[last], out[body] = model.begin, model.end, flat
    return out, bounds + 2 * row


_TOOLS: dict = {}


def tools(path: str) -> tuple[PieceModel, ChunkTable]:
    """One model and one table for each model file and Python worker."""
    if path not in _TOOLS:
        model = PieceModel(path)
        _TOOLS[path] = model, ChunkTable(model.segment)
    return _TOOLS[path]


def encode_documents(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and ``ids``, the ids of the whole text with begin and end ids."""
    data = df.select(df[id_column].cast("bigint").alias("doc_id"), df[text_column].cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column(1), BATCH):
                ids, bounds = encode(chunk, *tools(path))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.rows), lists], ["doc_id", "ids"])

    return data.mapInArrow(run, "doc_id bigint, ids array<int>").withColumnRenamed("doc_id", id_column)


def decode_documents(df: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``id_column`` and ``text``, the decoded ids; null ids give an empty text."""
    data = df.select(df[id_column].cast("bigint").alias("doc_id"), df[ids_column].cast("array<int>").alias("ids"))

    def run(batches):
        model, _ = tools(path)
        for batch in batches:
            texts = [model.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return data.mapInArrow(run, "doc_id bigint, text string").withColumnRenamed("doc_id", id_column)


def token_digests(df: DataFrame, path: str) -> DataFrame:
    """Encode and decode each document; return counts and digests instead of the ids and the text."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        model, table = tools(path)
        for batch in batches:
            for chunk in chunks(batch.column(1), BATCH):
                ids, bounds = encode(chunk, model, table)
                hashes, texts = [], []
                for start, end in itertools.pairwise(bounds.tolist()):
                    own = ids[start:end]
                    hashes.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    texts.append(hashlib.sha256(model.decode(own).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.rows), pa.array(np.diff(bounds), pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], names)

    return fields(df, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
