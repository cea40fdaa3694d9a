"""Published tables: replayed batches, two writers, whole runs."""

import os

import pytest

from tickloom.sources import published as pb

SCHEMA = "id int, day string, v double"


def rows(spark, path):
    return sorted((r.id, r.day, r.v) for r in pb.read_published(spark, path).collect())


def test_upsert_and_replayed_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    assert pb.read_published(spark, path) is None
    frame = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert pb.upsert_published(frame((1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0), (5, None, 5.0)), path, ["id"], "day", ("s", 0)) == 1
    assert pb.upsert_published(frame((2, "a", 9.0), (4, "a", 4.0)), path, ["id"], "day", ("s", 1)) == 2
    want = [(1, "a", 1.0), (2, "a", 9.0), (3, "b", 3.0), (4, "a", 4.0), (5, None, 5.0)]
    assert rows(spark, path) == want
    assert pb.upsert_published(frame((2, "a", -1.0)), path, ["id"], "day", ("s", 1)) == 2 and rows(spark, path) == want  # replayed
    assert pb.upsert_published(frame((3, "b", 7.0)), path, ["id"], "day", ("other", 0)) == 3
    assert (3, "b", 7.0) in rows(spark, path)


def test_readers_of_a_version_are_not_disturbed(spark, tmp_path):
    path = str(tmp_path / "t")
    pb.upsert_published(spark.createDataFrame([(1, "a", 1.0)], SCHEMA), path, ["id"], "day")
    before = pb.read_published(spark, path)
    pb.upsert_published(spark.createDataFrame([(1, "a", 2.0)], SCHEMA), path, ["id"], "day")
    assert [r.v for r in before.collect()] == [1.0] and rows(spark, path) == [(1, "a", 2.0)]


@pytest.mark.parametrize("other", ["a", "b"])
def test_two_writers_keep_each_others_rows(spark, tmp_path, other):
    """A second writer publishes between the first one's merge and its publication, in the same partition or another."""
    path = str(tmp_path / "t")
    pb.upsert_published(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], SCHEMA), path, ["id"], "day")
    once = []

    def meanwhile():
        if not once:
            once.append(1)
            pb.upsert_published(spark.createDataFrame([(9, other, 9.0)], SCHEMA), path, ["id"], "day")

    assert pb.upsert_published(spark.createDataFrame([(1, "a", 5.0)], SCHEMA), path, ["id"], "day", before_publish=meanwhile) == 3
    assert rows(spark, path) == [(1, "a", 5.0), (2, "b", 2.0), (9, other, 9.0)]
    data = os.listdir(f"{path}/data")
    assert len(data) == (4 if other == "a" else 3)  # merged again only where the partition changed
    assert not [n for n in os.listdir(f"{path}/manifest") if n.startswith("draft")]


def test_stream_is_merged_once(spark, tmp_path):
    source, path, cp = (str(tmp_path / n) for n in ("in", "t", "cp"))
    for i in range(3):
        spark.createDataFrame([(1, "a", float(i)), (10 + i, "b", float(i))], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        pb.start_upsert(stream, path, ["id"], "day", cp, "feed", every=None).awaitTermination(120)
    assert rows(spark, path) == [(1, "a", 2.0), (10, "b", 0.0), (11, "b", 1.0), (12, "b", 2.0)]
    version = pb.Manifests(spark, path).newest()["version"]
    # the last batch again, as after a failure between publication and the checkpoint's commit
    last = max(int(n) for n in os.listdir(f"{cp}/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.remove(f"{cp}/commits/{name}")
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    pb.start_upsert(stream, path, ["id"], "day", cp, "feed", every=None).awaitTermination(120)
    assert pb.Manifests(spark, path).newest()["version"] == version and len(rows(spark, path)) == 4


def test_runs_are_seen_whole(spark, tmp_path):
    base = str(tmp_path / "runs")
    assert pb.published_run(spark, base) is None
    pb.publish_run(spark.range(2), base, "20240101_000000")
    pb.publish_run(spark.range(5).selectExpr("id", "id * 2 AS twice"), base, "20240102_000000")
    spark.range(9).write.parquet(f"{base}/data/20240103_000000-half")  # written, never published
    assert pb.published_run(spark, base).count() == 5 and pb.published_run(spark, base).columns == ["id", "twice"]
    assert pb.published_run(spark, base, "20240101_000000").count() == 2
