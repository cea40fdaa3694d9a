"""Stateful streams against their batch forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.streaming import audits as au
from tickloom.streaming import stateful as st
from tickloom.streaming import ticks as tk

TICKS = "instrument string, event_id long, ts timestamp, price double, last_qty long, day_volume long"


@pytest.fixture
def rocks(spark):
    before = {k: spark.conf.get(k) for k in (st.PROVIDER, "spark.sql.shuffle.partitions")}
    spark.conf.set(st.PROVIDER, st.ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def at(minute, second=0):
    return dt.datetime(2024, 1, 2, 10, 0) + dt.timedelta(minutes=minute, seconds=second)


def drain(spark, frames, schema, build, tmp_path):
    """One micro-batch a frame, in order; rows of all batches and the state rows left at the end."""
    source, cp, out = (str(tmp_path / n) for n in ("in", "cp", "out"))
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    return spark.read.parquet(out), left


def test_bars_close_once_and_late_ticks_are_reported(rocks, tmp_path):
    frames = [
        [("A", 1, at(0, 5), 10.0, 1, 100), ("A", 2, at(0, 50), 12.0, None, 103), ("B", 3, at(0, 30), 5.0, 4, 50), ("A", 4, at(1, 10), None, 1, None)],
        [("A", 5, at(0, 2), 9.0, 2, 99), ("A", 6, at(6), 20.0, 1, 120), ("A", 7, at(6), 21.0, 1, 121)],  # minutes 0 and 1 close after this batch
        [("A", 8, at(0, 59), 99.0, 7, 1), ("B", 9, at(1, 1), 6.0, 1, 51), ("B", 10, at(5), 7.0, 2, 52)],  # 8 and 9 are late
        [("A", 11, at(20), 30.0, 1, 130)],
        [("C", 12, at(20), 1.0, 1, 1)],
    ]
    got, left = drain(rocks, frames, TICKS, st.bars_and_late_ticks, tmp_path)
    late = got.filter("kind = 'late'")
    assert sorted((r.instrument, r.event_id, r.price, r.minute) for r in late.collect()) == [("A", 8, 99.0, at(0)), ("B", 9, 6.0, at(1))]
    on_time = rocks.createDataFrame([t for f in frames for t in f if t[1] not in (8, 9)], TICKS)
    batch = tk.minute_bars(on_time)
    bars = got.filter("kind = 'bar'").select(*batch.columns)
    closed = batch.filter(F.col("minute") < F.lit(at(18)))
    assert bars.exceptAll(closed).collect() == [] and closed.exceptAll(bars).collect() == [] and bars.count() == 5
    assert left <= 4  # the open minutes of A and C and their timers


def test_gaps_of_a_stream_are_those_of_the_batch(rocks, tmp_path):
    schema = "event_utc timestamp, event_type string, event_id long"
    frames = [
        [(at(0), "connect", 1), (at(11), "close", 3), (at(10), "error", 2)],
        [(at(15), "connect", 4), (at(14, 30), "reconnect_attempt", 5), (at(20), "note", 6)],
        [(at(30), "close", 7), (at(33), "connect", 8), (at(50), "error", 9)],
        [(at(24 * 60 + 30), "connect", 10), (at(24 * 60 + 31), "error", 11), (at(24 * 60 + 32), "connect", 12)],
        [(at(24 * 60 + 90), "connect", 13)],
        [(at(48 * 60 + 90), "connect", 14)],
    ]
    got, left = drain(rocks, frames, schema, lambda s: st.reconnect_gap_stream(s, au.OPENERS), tmp_path)
    assert sorted((r.opened, r.closed, r.gap_minutes) for r in got.collect()) == [(at(10), at(15), 5.0), (at(30), at(33), 3.0), (at(1471), at(1472), 1.0)]
    batch = au.reconnect_gaps(rocks.createDataFrame([e for f in frames for e in f], schema)).select("trade_date", "event_reconnect_gap_minutes")
    summed = got.groupBy("trade_date").agg(F.sum("gap_minutes").alias("m"))
    assert {(r.trade_date, r.event_reconnect_gap_minutes) for r in batch.collect() if r.event_reconnect_gap_minutes} == {(r.trade_date, r.m) for r in summed.collect()}
    assert left <= 2  # the last event and its timer: the gap open at the end of the first day is gone


def test_other_state_stores_are_refused(spark):
    stream = spark.readStream.format("rate").load().select(F.lit("A").alias("instrument"), F.col("value").alias("event_id"), F.col("timestamp").alias("ts"), F.lit(1.0).alias("price"), F.lit(1).alias("last_qty"), F.lit(1).alias("day_volume"))
    with pytest.raises(ValueError, match="RocksDB"):
        st.bars_and_late_ticks(stream)
