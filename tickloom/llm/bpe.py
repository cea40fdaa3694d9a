"""BPE encoding and decoding in batched merge rounds.

A text is cut at ASCII white space, which no token of these vocabularies crosses, so a batch is encoded over its distinct
words only. The symbols of many words lie in one flat array; a round looks up all neighbouring pairs by binary search in
the sorted pair keys, takes each word's pair of lowest rank, and merges it everywhere in that word.

Null and empty texts have no tokens. Nothing is cut: a text of any length is encoded whole. Repeated rows give repeated
results, other columns are passed over.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tickloom.llm.text import Chunk, chunks, fields, word_hashes, words

#: Most words kept from one batch to the next; a bound on memory only.
CACHE_WORDS = 1_000_000
#: Bytes of text encoded together.
BATCH = 1 << 22
SPACE, LETTER, DIGIT, OTHER = range(4)
# Where the tokenizers library's Unicode tables differ from Python's and the regex module's. Tests ask the
# library for every code point. First and last capital of a range, and the small letter of the first.
CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
#: Ranges that are neither letters nor numbers to the library.
UNKNOWN = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
_SMALL = {capital: small + capital - first for first, last, small in CAPITALS for capital in range(first, last + 1)}
_CAPITAL = regex.compile("[" + "".join(map(chr, _SMALL)) + "]")


@functools.lru_cache(maxsize=1)
def character_kinds() -> np.ndarray:
    """Of each code point: white space, letter, number or anything else."""
    everything = "".join(map(chr, [*range(0xD800), *[0xFFFD] * 0x800, *range(0xE000, 0x110000)]))
    kinds = np.full(len(everything), OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, everything):
            kinds[run.start() : run.end()] = kind
    for first, last in UNKNOWN:
        kinds[first : last + 1] = OTHER
    return kinds


def lowered(text: str) -> str:
    """Each code point in lower case by itself: no final sigma by context."""
    text = "".join([c.lower() for c in text]) if "\u03a3" in text else text.lower()
    return text.translate(_SMALL) if _CAPITAL.search(text) else text


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(free)) for b in range(256)]


class Vocabulary:
    """Tables of a tokenizers file of kind BPE with word ends (lower case, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model = spec["model"]
        ids = model["vocab"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = np.empty(max([*ids.values(), *self.specials.values()]) + 1, object)
        self.tokens[:] = ""
        for token, i in [*ids.items(), *self.specials.items()]:
            self.tokens[i] = token
        end = model["end_of_word_suffix"] or ""
        alphabet = byte_alphabet()
        self.inner = np.array([ids[c] for c in alphabet], np.int64)
        self.final = np.array([ids[c + end] for c in alphabet], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        rank = np.arange(len(merges))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], rank[order], made
        # a merge may be done at all its places at once if what it makes is never part of an earlier merge
        uses = np.full(len(self.tokens), len(merges))
        np.minimum.at(uses, left, rank)
        np.minimum.at(uses, right, rank)
        self.at_once = uses[made] > rank
        special = "|".join(map(regex.escape, self.specials))
        self.cut = regex.compile(f"({special})") if special else None
        self.contraction = regex.compile("'s|'t|'re|'ve|'m|'ll|'d")

    def split(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of white-space words as flat bytes, the length of each, and the number of each word's pieces."""
        text = b" ".join(words).decode("utf-8", "replace")
        if not text.isascii():
            text = lowered(unicodedata.normalize("NFC", text))
        else:
            text = text.lower()
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        kind = character_kinds()[points]
        begin = np.ones(len(points), bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        begin &= kind != SPACE
        if "'" in text:  # a contraction is a piece of its own, wherever it stands
            quoted = np.flatnonzero(points == 39)
            for at in quoted[begin[quoted] | (quoted == 0)].tolist():
                found = self.contraction.match(text, at)
                if found:
                    begin[at + 1 : found.end()] = False
                    if found.end() < len(points):
                        begin[found.end()] = kind[found.end()] != SPACE
        head = np.flatnonzero(begin)
        solid = kind != SPACE
        width = np.where(solid, 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF), 0)
        lengths = np.add.reduceat(width, head) if len(head) else np.zeros(0, np.int64)
        gaps = np.concatenate([[-1], np.flatnonzero(points == 32), [len(points)]])
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        whole = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        return data[np.repeat(solid, whole)], lengths, np.diff(np.searchsorted(head, gaps))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of white-space words, and the number of ids of each."""
        if self.cut and any(b"<|" in w for w in words):
            parts = [[p for p in self.cut.split(w.decode("utf-8", "replace")) if p] for w in words]
            plain = [p.encode() for ps in parts for p in ps if p not in self.specials]
            ids, sizes = self._encode(plain)
            cuts = iter(np.split(ids, np.cumsum(sizes)[:-1])) if plain else iter(())
            lists = [[np.array([self.specials[p]]) if p in self.specials else next(cuts) for p in ps] for ps in parts]
            return np.concatenate([y for x in lists for y in x]), np.array([sum(map(len, x)) for x in lists], np.int64)
        return self._encode(words)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        data, lengths, numbers = self.split(words)
        ids, sizes = self.encode_pieces(data, lengths)
        return ids, np.bincount(np.repeat(np.arange(len(words)), numbers), sizes, len(words)).astype(np.int64)

    def encode_pieces(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the pieces of these lengths in ``data``, and each piece's number of ids."""
        owner = np.repeat(np.arange(len(lengths)), lengths)
        symbol = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbol[ends] = self.final[data[ends]]
        done_symbols, done_owners = [], []
        none = len(self.made)
        rank = self._pair_ranks(symbol, owner)
        while len(symbol):
            low = np.minimum.reduceat(rank, first := self._firsts(owner))
            sizes = np.diff(np.append(first, len(owner)))
            best = np.repeat(low, sizes)
            ready = best == none
            if ready.any():
                done_symbols.append(symbol[ready])
                done_owners.append(owner[ready])
                symbol, owner, rank, best = (x[~ready] for x in (symbol, owner, rank, best))
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == best)
            hit = self._apart(hit, owner, rank)
            symbol[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            changed = np.zeros(len(symbol), bool)
            changed[hit] = True
            changed[hit[hit > 0] - 1] = True
            before = hit[hit > 1] - 2  # the left neighbour may itself be a merged pair
            changed[before] = True
            symbol, owner, rank, changed = (x[keep] for x in (symbol, owner, rank, changed))
            at = np.flatnonzero(changed)
            rank[at] = self._ranks_at(symbol, owner, at)
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        symbols, owners = np.concatenate(done_symbols), np.concatenate(done_owners)
        order = np.argsort(owners, kind="stable")
        return symbols[order], np.bincount(owners, minlength=len(lengths))

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by one space, as a tokenizer without a decoder does."""
        return " ".join(self.tokens[ids].tolist())

    @staticmethod
    def _firsts(owner: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.ranks[place], len(self.made))

    def _pair_ranks(self, symbol: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return self._ranks_at(symbol, owner, np.arange(len(symbol)))

    def _ranks_at(self, symbol: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each place; none across words."""
        after = np.minimum(at + 1, len(symbol) - 1)
        rank = self._lookup(symbol[at], symbol[after])
        rank[(owner[at] != owner[after]) | (after == at)] = len(self.made)
        return rank

    def _apart(self, hit: np.ndarray, owner: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Of overlapping pairs every second from the left; of a merge that must go singly, each word's leftmost."""
        start = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
        head = np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - head) % 2 == 0]
        leftmost = np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])
        return hit[leftmost | self.at_once[rank[hit]]]


def library_words(path: str):
    """``encode_words`` by the tokenizers library, for operators that take its ids as given."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    tool.no_truncation()
    tool.no_padding()

    def encode_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in tool.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.int64, int(sizes.sum())), sizes

    return encode_words


class Encoder:
    """Encodes chunks of texts over their distinct words; remembers the ids of words up to a bound.

    Words are told apart by a 64-bit hash of their bytes.
    """

    def __init__(self, encode_words, cache_words: int = CACHE_WORDS):
        self.encode_words = encode_words
        self.cache_words = cache_words
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """int32 ids of all texts of a chunk, and where each text's ids begin (with the end)."""
        starts, ends, bounds = words(chunk)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(chunk.rows + 1, np.int64)
        distinct, place, inverse = np.unique(word_hashes(chunk.data, starts, ends), return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self.hashes, assume_unique=True)
        if len(self.hashes) + new.sum() > self.cache_words:
            self._forget()
            new[:] = True
        if new.any():
            body, at = chunk.data.tobytes(), place[new]
            ids, counts = self.encode_words([body[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            hashes = np.concatenate([self.hashes, distinct[new]])
            order = np.argsort(hashes, kind="stable")
            begins = len(self.ids) + np.cumsum(counts) - counts
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.hashes = hashes[order]
            self.starts = np.concatenate([self.starts, begins])[order]
            self.counts = np.concatenate([self.counts, counts])[order]
        known = np.searchsorted(self.hashes, distinct)[inverse]
        counts = self.counts[known]
        after = np.cumsum(counts)
        ids = self.ids[np.arange(after[-1]) + np.repeat(self.starts[known] - after + counts, counts)]
        return ids, np.concatenate([[0], after])[bounds]


_TOOLS: dict = {}


def vocabulary(path: str) -> Vocabulary:
    """One set of tables for each vocabulary and Python worker."""
    if path not in _TOOLS:
        _TOOLS[path] = Vocabulary(path)
    return _TOOLS[path]


def encoder(path: str, library: bool = False) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if (path, library) not in _TOOLS:
        _TOOLS[path, library] = Encoder(library_words(path) if library else vocabulary(path).encode_words)
    return _TOOLS[path, library]


def encode_documents(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and ``ids``, the token ids of the whole text."""
    data = fields(df.withColumnsRenamed({id_column: "doc_id", text_column: "text"}), doc_id="bigint", text="string")

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column(1), BATCH):
                ids, bounds = encoder(path).encode(chunk)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.rows), lists], ["doc_id", "ids"])

    return data.mapInArrow(run, "doc_id bigint, ids array<int>").withColumnRenamed("doc_id", id_column)


def decode_documents(df: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``id_column`` and ``text``, the decoded ids; null ids give an empty text."""
    data = df.select(df[id_column].cast("bigint").alias("doc_id"), df[ids_column].cast("array<int>").alias("ids"))

    def run(batches):
        for batch in batches:
            texts = [vocabulary(path).decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return data.mapInArrow(run, "doc_id bigint, text string").withColumnRenamed("doc_id", id_column)


def token_digests(df: DataFrame, path: str) -> DataFrame:
    """Encode and decode each document; return counts and digests instead of the ids and the text."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        tables = vocabulary(path)
        decimal = np.array([str(i) for i in range(len(tables.tokens))], object)
        for batch in batches:
            for chunk in chunks(batch.column(1), BATCH):
                ids, bounds = encoder(path).encode(chunk)
                numbers, hashes, texts = np.diff(bounds), [], []
                for start, end in itertools.pairwise(bounds.tolist()):
                    own = ids[start:end]
                    hashes.append(hashlib.sha256(" ".join(decimal[own].tolist()).encode()).hexdigest())
                    texts.append(hashlib.sha256(tables.decode(own).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.rows), pa.array(numbers, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], names)

    return fields(df, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
