"""Readers, sinks and streams on small files."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from catalog import fixtures as fx
from tickloom.operators.cleaning import assert_symbol_cap, regime_filter
from tickloom.sources import dayfiles as df
from tickloom.sources import readers as rd
from tickloom.sources import sinks as sk
from tickloom.streaming import audits as au
from tickloom.streaming import ticks as tk


def test_delivery_files(spark, tmp_path):
    (tmp_path / "sec_bhavdata_full_02012024.csv").write_text("SYMBOL, SERIES, TTL_TRD_QNTY, DELIV_QTY, DELIV_PER\nabc , EQ, 100, 40, 40.0\n , EQ, 1, 1, 1\nXYZ, EQ, 10, -, -\n")
    rows = rd.read_delivery(spark, str(tmp_path)).orderBy("symbol").collect()
    assert [(r.date, r.symbol, r.deliv_pct) for r in rows] == [(dt.date(2024, 1, 2), "ABC", 40.0), (dt.date(2024, 1, 2), "XYZ", None)]


def test_missing_columns_are_named(spark, tmp_path):
    (tmp_path / "sec_bhavdata_full_02012024.csv").write_text("SYMBOL,DELIV_QTY\nA,1\n")
    with pytest.raises(ValueError, match="deliv_pct"):
        rd.read_delivery(spark, str(tmp_path))


def _zip(path, name, text, encoding="utf-8"):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(name, text.encode(encoding))


CHAIN = "INSTRUMENT,SYMBOL,EXPIRY_DT,STRIKE_PR,OPTION_TYP,CLOSE,SETTLE_PR,CONTRACTS,OPEN_INT,CHG_IN_OI,TIMESTAMP\n"


def test_zipped_chain_and_bad_archive(spark, tmp_path):
    body = CHAIN + "OPTIDX,NIFTY,25-JAN-2024,21500,CE,120.5,120,10,1000,5,02-JAN-2024\nOPTIDX,NIFTY,bad,21500,PE,1,1,1,1,1,02-JAN-2024\nFUTSTK,CAF\xc9,25-JAN-2024,0,XX,1,1,1,500,7,02-JAN-2024\n"
    _zip(tmp_path / "fo02JAN2024bhav.csv.zip", "fo02JAN2024bhav.csv", body, "latin-1")
    (tmp_path / "fo03JAN2024bhav.csv.zip").write_bytes(b"not a zip")
    chain = rd.read_chain(spark, str(tmp_path)).collect()
    assert [(r.trade_date, r.expiry, r.strike, r.option_typ) for r in chain] == [(dt.date(2024, 1, 2), dt.date(2024, 1, 25), 21500.0, "CE")]
    oi = rd.read_futures_oi(spark, str(tmp_path)).filter("instrument = 'FUTSTK'").first()
    assert (oi.symbol, oi.oi, oi.chg_in_oi) == ("CAFÉ", 500.0, 7.0)
    assert [r._file for r in rd.bad_files(spark, str(tmp_path)).collect()] == ["fo03JAN2024bhav.csv.zip"]


def test_each_file_has_its_own_headers(spark, tmp_path):
    (tmp_path / "sec_bhavdata_full_02012024.csv").write_text("SYMBOL, SERIES, TTL_TRD_QNTY, DELIV_QTY, DELIV_PER\nabc , EQ, 100, 40, 40.0\n")
    (tmp_path / "sec_bhavdata_full_03012024.csv").write_text("\ufeffDELIV_PERCENT,TICKER,DELIVERABLE_QTY,TOTTRDQTY,EXTRA\n50.0,abc,5,10,x\nshort,row\n", encoding="utf-8")
    (tmp_path / "sec_bhavdata_full_04012024.csv").write_text("SYMBOL,DELIV_QTY\nA,1\n")
    (tmp_path / "sec_bhavdata_full_05012024.csv").write_text("")
    (tmp_path / "sec_bhavdata_full_06012024.csv").write_text("SYMBOL,TTL_TRD_QNTY,DELIV_QTY,DELIV_PER\n")
    rows = rd.read_delivery(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r.date.day, r.symbol, r.total_qty, r.deliv_qty, r.deliv_pct) for r in rows] == [(2, "ABC", 100.0, 40.0, 40.0), (3, "ABC", 10.0, 5.0, 50.0)]
    bad = {r._file[18:20]: r.error for r in rd.bad_files(spark, str(tmp_path), "delivery").collect()}
    assert set(bad) == {"03", "04", "05"} and bad["03"].startswith("1 rows") and "deliv_pct" in bad["04"]
    assert [r.date.day for r in rd.read_delivery(spark, str(tmp_path), since="2024-01-03", until="2024-01-05").collect()] == [3]


def test_only_asked_columns_and_rows_leave_the_reader(spark, tmp_path):
    row = "OPTIDX,NIFTY,25-JAN-2024,21500,CE,120.5,120,10,1000,5,02-JAN-2024\n"
    with zipfile.ZipFile(tmp_path / "fo02JAN2024bhav.csv.zip", "w") as z:
        z.writestr("a.csv", CHAIN + row * 3 + row.replace("NIFTY", "BANKNIFTY"))
        z.writestr("b.csv", "SYMBOL,CLOSE,OTHER\nnifty,7,x\n")
        z.writestr("notes.txt", "x")
    found = df.members(str(tmp_path))
    assert [m.inner for m in found] == ["a.csv", "b.csv"]
    reader = df.DayFileReader(["close", "_file"], {"path": str(tmp_path), "kind": "chain", "equal": '{"symbol": "nifty"}'})
    batches = [b for m in found for b in reader.read(m)]
    assert {tuple(b.schema.names) for b in batches} == {("close", "_file")} and sum(b.num_rows for b in batches) == 4
    days = df.read_days(spark, str(tmp_path), "chain", ["close"], {"symbol": "nifty"})
    assert days.rdd.getNumPartitions() == 2 and sorted(r.close for r in days.collect()) == ["120.5", "120.5", "120.5", "7"]
    every = rd.read_chain(spark, str(tmp_path), None).collect()
    assert sorted(r.symbol for r in every) == ["BANKNIFTY", "NIFTY", "NIFTY", "NIFTY"]
    assert "trade_date" in rd.bad_files(spark, str(tmp_path), "chain").first().error


def test_white_space_in_bars_is_dropped(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Symbol, Date , Open,High,Low,Close,Volume\n abc , 2024-01-02 10:00:00 , 1 ,2,3,4,5\n")
    assert [(r.ticker, r.open, r.ts.hour) for r in rd.read_bars(spark, str(tmp_path)).collect()] == [("ABC", 1.0, 10)]


def test_series_status(spark, tmp_path):
    good = tmp_path / "vix.csv"
    good.write_text("Date,Close\n2024-01-01 09:00:00,10\n2024-01-01 15:00:00,11\n2024-01-02,bad\n")
    bad = tmp_path / "other.csv"
    bad.write_text("a,b\n1,2\n")
    series, status = rd.read_series(spark, [str(tmp_path / "none.csv"), str(good)], "vix")
    assert status == "ok" and [(r.dt, r.vix) for r in series.collect()] == [(dt.date(2024, 1, 1), 11.0)]
    assert rd.read_series(spark, [str(bad)], "vix")[1] == "invalid_schema"
    assert rd.read_series(spark, [str(tmp_path / "none.csv")], "vix")[1] == "missing"


def test_upsert_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "table")
    old = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0)], "id int, day string, v double")
    sk.upsert(old, path, ["id"], "day")
    sk.upsert(spark.createDataFrame([(2, "a", 9.0), (4, "a", 4.0)], "id int, day string, v double"), path, ["id"], "day")
    assert sorted((r.id, r.day, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a", 1.0), (2, "a", 9.0), (3, "b", 3.0), (4, "a", 4.0)]


def test_runs(spark, tmp_path):
    base = str(tmp_path / "runs")
    sk.write_run(spark.range(2), base, "20240101_000000")
    sk.write_run(spark.range(5), base, "20240102_000000")
    assert sk.latest_run(spark, base).count() == 5


def test_stream_equals_batch_on_closed_bars(spark, tables, tmp_path):
    ticks = fx.ticks(tables).select("instrument", "event_id", "ts", "price", "last_qty", "day_volume")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    ticks.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 10).parquet(source)
    query = tk.start_bar_sink(tk.minute_bars(stream, "1 hour", "2 hours"), out, str(tmp_path / "cp"), every=None)
    query.awaitTermination(120)
    got = spark.read.parquet(out)
    batch = tk.minute_bars(ticks, "1 hour")
    last = got.agg(F.max("minute")).first()[0]
    closed = batch.filter(F.col("minute") <= F.lit(last)).select(*got.columns)
    assert got.count() > 100
    assert got.exceptAll(closed).count() == 0 and closed.exceptAll(got).count() == 0


def test_depth_stream_to_partitions(spark, tables, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    depth = fx.depth_ticks(tables)
    depth.write.parquet(source)
    stream = spark.readStream.schema(depth.schema).parquet(source)
    flat = tk.flatten_depth(stream).select(
        "*", F.to_date("exchange_timestamp").alias("trade_date"), F.lit("NSE").alias("exchange"), F.col("instrument").alias("symbol")
    )
    tk.start_partitioned_sink(flat, out, str(tmp_path / "cp"), every=None).awaitTermination(120)
    written = spark.read.parquet(out)
    assert written.count() == depth.count() and {"buy_1_price", "sell_5_orders", "symbol"} <= set(written.columns)
    checked = au.file_check(spark, out, ["buy_1_price", "nothing"]).collect()
    assert all(r.readable and r.missing_columns == "nothing" for r in checked)


def test_sink_closes_files_by_row_count_and_by_time(spark, tables, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    ticks = fx.ticks(tables).withColumn("trade_date", F.lit("2024-01-01")).coalesce(1)
    ticks.write.parquet(source)
    everything = ticks.count()
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    tk.start_partitioned_sink(stream, out, str(tmp_path / "cp"), ["trade_date"], every=None, rows=100).awaitTermination(120)
    sizes = [r["count"] for r in spark.read.parquet(out).groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) == 100 and sum(sizes) == everything and len(sizes) == -(-everything // 100)
    # a later batch with few rows is written when its time comes
    ticks.limit(7).write.mode("append").parquet(source)
    query = tk.start_partitioned_sink(stream, out, str(tmp_path / "cp"), ["trade_date"], every="1 second", rows=100)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.read.parquet(out).count() == everything + 7


def test_files_of_a_failed_task_are_not_read(spark, tmp_path):
    from pyspark.errors import StreamingQueryException
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(1000).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("id long").parquet(source).withColumn("day", F.lit(1))
    broken = stream.withColumn("id", F.when(F.col("id") < 900, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(StreamingQueryException):
        tk.start_partitioned_sink(broken, out, str(tmp_path / "cp"), ["day"], every=None, rows=50).awaitTermination(120)
    tk.start_partitioned_sink(stream, out, str(tmp_path / "cp"), ["day"], every=None, rows=50).awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 1000 and got.select("id").distinct().count() == 1000


def test_reconnect_log_ending_while_disconnected(spark):
    at = [("2024-01-01 00:00:00", "connect"), ("2024-01-01 00:10:00", "error"), ("2024-01-01 00:11:00", "close"), ("2024-01-01 00:15:00", "connect"), ("2024-01-01 00:20:00", "close")]
    log = spark.createDataFrame([(t, e, i) for i, (t, e) in enumerate(at)], "t string, event_type string, event_id int").withColumn("event_utc", F.col("t").cast("timestamp"))
    row = au.reconnect_gaps(log).first()
    assert (row.event_reconnect_gap_minutes, row.disconnect_events) == (5.0, 2)


def test_symbol_cap_refuses_and_overrides(spark):
    df = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    with pytest.raises(RuntimeError):
        assert_symbol_cap(df, 2)
    assert assert_symbol_cap(df, 2, override=True).count() == 3


def test_strict_regime_filter(spark):
    with pytest.raises(ValueError, match="nope"):
        regime_filter(spark.range(3), "nope > 1", strict=True)
