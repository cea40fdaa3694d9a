"""BPE and packing against the tokenizers library."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickloom.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Σας ΟΔΟΣ, İstanbul", "a\x1cb \x85c\xa0d", "x<|endoftext|>y <|startoftext|>", "<|endoftext", "a" * 3000, "don't I'LL we'Re '' 's it'S", "日本語 😀👍🏽", "", "   ", "é ﬁ ½ ² १२ 12345", None, "one " * 5000, "\x00\x7f"]


@pytest.fixture(scope="module")
def library():
    tool = Tokenizer.from_file(PATH)
    tool.no_truncation()
    tool.no_padding()
    return tool


@pytest.fixture(scope="module")
def texts(spark, folder):
    return [*ODD, *(r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect())]


def test_ids_and_decoding(spark, library, texts):
    df = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: tuple(r)[1:] for r in bpe.token_digests(df, PATH).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        assert got[i] == (len(ids), *digests), repr(text)[:80]


def test_every_code_point(library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    tables = bpe.vocabulary(PATH)
    for at in range(0, len(points), 4096):
        text = " ".join(f"a{chr(c)}b 1{chr(c)}A" for c in points[at : at + 4096])
        ids = tables.encode_words(text.encode().split(b" "))[0]
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, hex(points[at])


def test_encode_then_decode_tables(spark, library):
    df = spark.createDataFrame([(1, "Hello there"), (2, None)], "doc_id long, text string")
    ids = bpe.encode_documents(df, PATH)
    assert {r.doc_id: r.ids for r in ids.collect()} == {1: library.encode("Hello there", add_special_tokens=False).ids, 2: []}
    assert {r.doc_id: r.text for r in bpe.decode_documents(ids, PATH).collect()} == {1: "hello</w> there</w>", 2: ""}


def test_cache_bound_changes_nothing():
    import pyarrow as pa

    from tickloom.llm.text import chunks

    column = pa.array(["some words here", "other words there", "words"])
    tools = [bpe.Encoder(bpe.vocabulary(PATH).encode_words, size) for size in (0, 3, 10**6)]
    found = [[tool.encode(c)[0].tolist() for c in chunks(column, 16)] for tool in tools]
    assert found[0] == found[1] == found[2]


def test_pieces_cover_documents_once(spark, library, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = packing.pack_documents(df, PATH).toPandas()
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        own = pieces[pieces.doc_id == i].sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() == len(ids) and set(own.doc_tokens) == {len(ids)}
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)]
    placed = pieces.sort_values(["sequence_id", "offset"])
    loads = placed.groupby("sequence_id").length
    assert ((loads.cumsum() - placed.length) == placed.offset).all() and loads.sum().max() <= packing.CAPACITY


def test_groups_are_bounded_whatever_the_ids(spark):
    big = (1 << 60) + 1  # no float holds it
    rows = [(None, 0, 10 + i % 50, i, 99) for i in range(400)] + [(big, 0, 10 + i % 50, i, 99) for i in range(400)] + [(None, 0, 30, 5, 30)] * 1500
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long").repartition(3)
    got = packing.pack_pieces(pieces, capacity=100, group_windows=20).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == collections.Counter(rows)
    windows = collections.Counter()
    for r in got:
        windows[r.sequence_id] += r.length
    groups = collections.Counter(k >> 32 for k in windows)
    assert max(windows.values()) <= 100 and max(groups.values()) <= 40


def test_differencing_is_even_and_rises():
    draw = random.Random(4)
    loads = np.array([draw.randint(1, 900) for _ in range(400)])
    found = packing.difference(loads, 20)
    sums = np.bincount(found, loads)
    assert len(sums) == 20 and sums.max() - sums.min() <= 20
    assert np.bincount(packing.pack_group(np.array([60, 60, 60]), 100), [60, 60, 60]).tolist() == [60, 60, 60]
    assert sorted(packing.pack_group(np.array([100, 40, 100, 60]), 100).tolist()) == [0, 0, 1, 2]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.token_digests(empty, PATH).collect() == [] and packing.pack_documents(empty, PATH).collect() == []
