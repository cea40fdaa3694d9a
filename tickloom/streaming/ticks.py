"""Tick streams: event time, minute bars, order-book flattening, sinks. Every function takes batch or stream frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import schemas


def event_time(received: str = "received_utc", names: Sequence[str] = ("exchange_timestamp", "timestamp", "last_trade_time")) -> Column:
    """First event time present, else the receive time."""
    return F.coalesce(*[F.col(n) for n in names], F.col(received))


def parse_ticks(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON tick lines to columns; unreadable lines give nulls and are dropped."""
    parsed = lines.select(F.from_json(column, schemas.TICK).alias("_t")).select("_t.*")
    return parsed.filter(F.col("instrument").isNotNull() & F.col("ts").isNotNull())


def with_instruments(ticks: DataFrame, master: DataFrame, key: str = "instrument_token") -> DataFrame:
    """Attach instrument columns; ticks of unknown instruments are dropped (stream-static inner join)."""
    return ticks.join(master, key)


def minute_bars(ticks: DataFrame, window: str = "1 minute", watermark: str | None = "2 minutes") -> DataFrame:
    """Tumbling bars: first/last price by (ts, seq), extremes, quantity, last day volume, tick count.

    All aggregates are mergeable, so a busy instrument is combined before the shuffle. On a stream the watermark
    closes a bar once; later ticks of a closed bar are dropped instead of overwriting it.
    """
    if ticks.isStreaming and watermark:
        ticks = ticks.withWatermark("ts", watermark)
    at = F.struct("ts", "event_id")
    grouped = ticks.groupBy(F.window("ts", window).alias("_w"), "instrument").agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("last_qty").alias("last_quantity_sum"),
        F.max_by("day_volume", at).alias("last_seen_day_volume"),
        F.count(F.lit(1)).alias("tick_count"),
        F.min("ts").alias("first_tick_time"),
        F.max("ts").alias("last_tick_time"),
    )
    return grouped.select(F.col("_w.start").alias("minute"), *[c for c in grouped.columns if c != "_w"])


def late_ticks(ticks: DataFrame, bars: DataFrame, counted: DataFrame, key: list[str], window: str = "1 minute") -> DataFrame:
    """Ticks of bars that were closed without them: the side table of a finished batch of bars.

    ``counted`` are the ticks the bars were made of, known by ``key``: each tick of a closed bar is there or here, also one
    that stands before the bar's last tick.
    """
    tagged = ticks.withColumn("minute", F.window("ts", window).start)
    late = tagged.join(bars.select("instrument", "minute"), ["instrument", "minute"])
    return late.join(counted.select(*key), key, "left_anti")


def flatten_depth(ticks: DataFrame, levels: int = 5) -> DataFrame:
    """Nested order book to price, quantity and orders columns per side and level; missing levels are null."""
    columns = []
    for side in ("buy", "sell"):
        for i in range(levels):
            level = F.get(F.col(f"depth.{side}"), F.lit(i))
            columns += [level[f].alias(f"{side}_{i + 1}_{f}") for f in ("price", "quantity", "orders")]
    return ticks.select(*[c for c in ticks.columns if c != "depth"], *columns)


def start_partitioned_sink(stream: DataFrame, path: str, checkpoint: str, by: Sequence[str] = ("trade_date", "exchange", "symbol"),
                           every: str | None = "10 seconds", rows: int = 25_000):
    """Append a stream to a zstd Parquet tree; exactly-once through the checkpoint. ``every=None`` drains and stops.

    A file is closed by time or by row count, whichever is first: a batch ends at each trigger, and within it a file of a
    partition ends at ``rows`` rows. Files count when the batch's entry is in the sink's log, so what a lost task or a
    repeated batch left behind is never read.
    """
    writer = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .option("compression", "zstd")
        .option("maxRecordsPerFile", rows)
        .partitionBy(*by)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


def start_bar_sink(bars: DataFrame, path: str, checkpoint: str, every: str | None = "5 seconds"):
    """Append closed bars to Parquet."""
    writer = bars.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


def raw_lines(ticks: DataFrame, by: Sequence[str] = ("trade_date", "instrument")) -> DataFrame:
    """Ticks as JSON lines with their partition columns, for an archive sink."""
    return ticks.select(*by, F.to_json(F.struct(*[c for c in ticks.columns if c not in by])).alias("value"))
