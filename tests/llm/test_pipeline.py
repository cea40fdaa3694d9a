"""The pipeline's stages on planted documents, and its whole run."""

import random

import corpus_pipeline


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns)
    assert 0 < got.select("doc_id").distinct().count() < spark.read.parquet(f"{folder}/documents.parquet").count()


def test_stages_keep_columns_and_clean_documents(spark):
    draw = random.Random(1)
    make = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    copy, passage = make(200), make(55)
    rows = [(1, copy), (2, copy), (3, copy + " end"), (4, make(80) + " " + passage), (5, passage + " " + make(80)), (6, make(100)), (7, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7]
    cut = {r.doc_id: r for r in corpus_pipeline.substring_stage(spark, kept, "").collect()}
    assert set(cut) == {1, 4, 5, 6, 7} and cut[6].text == rows[5][1] and passage[:40] not in cut[4].text + cut[5].text
    assert all(r.n_chars == len(r.text) for r in cut.values())


def test_one_row_of_each_group_whatever_its_ids(spark):
    draw = random.Random(4)
    make = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    twice, shared, nulls, mixed, other = (make(100) for _ in range(5))
    rows = [(1, twice, "a"), (1, twice, "b"), (2, shared, "a"), (2, shared + " end", "a"), (2, other, "a"), (None, nulls, "a"), (None, nulls, "a"), (None, nulls + " end", "a")]
    rows += [(None, mixed, "a"), (3, mixed + " end", "a"), (4, "", "a"), (4, "", "a"), (None, " ", "a")]
    docs = spark.createDataFrame([(k, t, "en", s, len(t)) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    texts = sorted(r.text.removesuffix(" end") for r in kept.collect())
    assert kept.columns == docs.columns and texts == sorted([twice, shared, other, nulls, mixed, "", "", " "])
    cut = sorted(r.text.removesuffix(" end") for r in corpus_pipeline.substring_stage(spark, kept, "").collect())
    assert cut == texts  # nothing repeats, so nothing is lost


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "substring dedup", "packing"]
