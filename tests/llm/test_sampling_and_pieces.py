"""Centroid clustering, importance resampling and SentencePiece against plain versions and the library."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tickloom.llm import centroids, importance, pieces
from tickloom.llm.text import chunks

PATH = public_tokenizers.path("piece_bpe_32k.model")


def lloyd(rows, k, rounds, scale, seed):
    """Plain clustering of ``(id, components)`` in Python's integers."""
    points = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    order = sorted(points, key=lambda p: (p[0] is None, hashlib.sha256(f"{seed}:{p[0]}".encode()).hexdigest(), p[1]))
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in points]
        for n in range(len(centres)):
            members = [v for (_, v), o in zip(points, own, strict=True) if o == n]
            if members:
                centres[n] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, *reversed(nearest(v))) for i, v in points]
    total = {n: sum(d for _, c, d in found if c == n) for n in range(len(centres))}
    long = lambda x: x if x < 2**63 else None
    return sorted(((i, c, long(d), long(total[c]), long(sum(total.values())), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in found), key=repr)


@pytest.mark.parametrize("size", [1.0, 2e5, 3e6])
def test_clusters_are_those_of_a_plain_version(spark, size):
    draw = np.random.default_rng(5)
    vectors = np.round(draw.normal(size=(400, 6)) * size, 1).tolist()
    vectors[50:90] = [vectors[50]] * 40  # a group of copies
    rows = [(i // 2 if i < 100 else i, v) for i, v in enumerate(vectors)] + [(None, vectors[3])]
    bad = [(900, None), (901, [1.0] * 5), (902, [1.0, None] * 3), (903, [math.nan] * 6), (904, [math.inf] * 6), (905, []), (906, [1e300] * 6)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, cluster int, vector string")
    got = centroids.cluster_report(df.repartition(5), k=7, rounds=4, dims=6, scale=1024, seed=3).collect()
    assert sorted((tuple(r) for r in got), key=repr) == lloyd(rows, 7, 4, 1024, 3)


def test_few_vectors_empty_tables_and_ties(spark):
    df = spark.createDataFrame([(5, [0.0, 0.0]), (6, [2.0, 0.0])], "vec_id long, embedding array<float>")
    rows = centroids.cluster_report(df, k=8, rounds=2, dims=2, scale=1).collect()
    assert {r.distance for r in rows} == {0} and {r.cluster for r in rows} == {0, 1}
    empty = centroids.cluster_report(df.limit(0), dims=2)
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    label, distance = centroids.SortedLists([[4, 0], [-4, 0], [4, 0], [0, 9]]).nearest(np.array([[0, 0], [5, 0], [0, 8]]))
    assert label.tolist() == [0, 0, 3] and distance.tolist() == [16, 1, 1]  # equal distances go to the smaller number


def test_the_walk_stops_early_and_stays_exact():
    draw = np.random.default_rng(8)
    lists = centroids.SortedLists(draw.integers(-50, 50, (60, 3)).tolist())
    x = draw.integers(-60, 60, (500, 3))
    label, distance = lists.nearest(x)
    every = ((x[:, None] - lists.centroids[None]) ** 2).sum(2)
    assert (label == every.argmin(1)).all() and (distance == every.min(1)).all()
    wide = centroids.SortedLists((lists.centroids * 10**12).tolist(), wide=True).nearest((x * 10**12).astype(object))
    assert wide[0].tolist() == label.tolist() and wide[1].tolist() == [int(d) * 10**24 for d in distance]


def plain_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes([b + 32 if 65 <= b <= 90 else b for b in range(256)])))


def plain_resample(documents, target, percent, least, seed, buckets, longest):
    def grams(text):
        w = plain_words(text)
        return [b" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    def counts(texts):
        out = [0] * buckets
        for text in texts:
            for g in grams(text):
                out[zlib.crc32(g) % buckets] += 1
        return out

    s, t = counts(x for _, x in documents), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in documents:
        own = [gain[zlib.crc32(g) % buckets] for g in grams(text)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(plain_words(text)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = able[: percent * len(able) // 100]
    return sorted([(*r, drawn.index(r) + 1 if r in drawn else None) for r in rows], key=repr)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_resampling_is_that_of_a_plain_version(spark, folder, longest):
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").limit(120).collect()]
    odd = [None, "", "  ", "A-B_c\x00D é É日本 " * 8, "x" * 5000 + " " + "Y" * 100, "one", "\x7f" * 9, ("w" * 63 + " ") * 30, ("w" * 64 + " ") * 30, "a b " * 40000]
    rows = [*enumerate([*texts, *odd]), (None, "null id " * 30)]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()] + [None, ""]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, rank int, n_words int")
    got = importance.resample(df.repartition(4), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=500)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resample(rows, target, 25, 20, 7, 500, longest)


def test_copies_and_shared_ids_are_ranked_each(spark):
    row = (7, "word " * 30)
    df = spark.createDataFrame([row] * 3000 + [(8, "other " * 30)] * 1000, "doc_id long, text string").repartition(6)
    got = importance.resample(df, df.limit(0), percent=50).collect()
    assert len(got) == 4000 and sorted(r.rank for r in got if r.rank) == list(range(1, 2001))
    assert {r.doc_id for r in got if r.rank and r.rank <= 1000} == {max(got, key=lambda r: r.score).doc_id}
    assert importance.resample(df.limit(0), df).collect() == []


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts():
    draw = random.Random(1)
    mixed = " ▁  \t\n\x00abcdeftheing.é😀͸日本語1203'́�﻿"
    some = ["".join(draw.choices(mixed, k=draw.randint(0, 60))) for _ in range(3000)]
    points = [*range(0x250), *range(0x900, 0x1200), *range(0x4E00, 0x5000), *range(0x1F300, 0x1F700), 0xD7FF, 0xE000, 0x10FFFF]
    some += ["".join(map(chr, draw.choices(points, k=draw.randint(0, 30)))) for _ in range(3000)]
    return some + [" " * n for n in range(70)] + ["a" * n for n in range(55, 80)] + [" " * 3001 + "the" * 900 + " " * 5000, "ab" * 20000, "", " the" * 300]


def test_piece_ids_and_decoding(spark, library, folder):
    texts = [*odd_texts(), *(r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()), None, "a b", "a b"]
    df = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: tuple(r)[1:] for r in pieces.token_digests(df, PATH).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()), repr(text)[:80]


def test_any_ids_decode_as_in_the_library(library):
    model, _ = pieces.tools(PATH)
    draw = random.Random(3)
    for _ in range(5000):
        ids = [draw.choice([draw.randint(0, 2), draw.randint(3, 258), draw.randint(259, 31999), 28705]) for _ in range(draw.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids), ids
    with pytest.raises(ValueError):
        model.decode([32000])


def test_each_distinct_chunk_is_segmented_once():
    model, _ = pieces.tools(PATH)
    seen = []
    table = pieces.ChunkTable(lambda parts: seen.extend(parts) or model.segment(parts))
    column = pa.array(["the cat the", "  the cat", "cat"])
    first = [pieces.encode(c, model, table)[0].tolist() for c in chunks(column)]
    assert sorted(seen) == sorted([b" the", b" cat", b"   the"])
    bounded = [pieces.encode(c, model, pieces.ChunkTable(model.segment, 1))[0].tolist() for c in chunks(column)]
    assert first == bounded and [pieces.encode(c, model, table)[0].tolist() for c in chunks(column)] == first and len(seen) == 3


def test_piece_tables(spark, library):
    df = spark.createDataFrame([(1, "Hello  there ▁x", 0), (2, None, 0), (None, "", 0)], "key long, body string, ids int")
    ids = pieces.encode_documents(df, PATH, "key", "body")
    assert {r.key: r.ids for r in ids.collect()} == {1: library.encode("Hello  there ▁x", add_bos=True, add_eos=True), 2: [1, 2], None: [1, 2]}
    assert {r.key: r.text for r in pieces.decode_documents(ids, PATH, "key").collect()} == {1: "Hello  there  x", 2: "", None: ""}
    assert pieces.token_digests(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    assert [r.doc_id for r in pieces.token_digests(df.select(F.col("key").alias("doc_id"), F.col("body").alias("text")), PATH).collect() if r.doc_id is None] == [None]
