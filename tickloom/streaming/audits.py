"""Quality audits of a tick archive: counts, suspect days, heartbeat and reconnect gaps, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.functions.layout import UNKNOWN, running

OPENERS = ("close", "error", "reconnect_attempt", "reconnect_exhausted")


def tick_counts(raw: DataFrame, keys: Sequence[str] = ("trade_date", "exchange", "symbol"), file: str | None = None) -> DataFrame:
    """Ticks (and files) per day and instrument."""
    files = F.count_distinct(file) if file else F.lit(None).cast("long")
    return raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("tick_count"), files.alias("parquet_files"))


def suspect_days(counts: DataFrame, days: int = 7, ratio: float = 0.60) -> DataFrame:
    """Day count against the median of the previous days of the instrument (one row per instrument and day)."""
    w = Window.partitionBy("exchange", "symbol").orderBy("trade_date")
    median = F.percentile("tick_count", F.lit(0.5)).over(w.rowsBetween(-days, -1))
    out = counts.withColumn("rolling_median", median)
    share = F.col("tick_count") / F.nullif("rolling_median", F.lit(0.0))
    return out.withColumn("tick_count_ratio", share).withColumn("suspect", R.holds(F.col("tick_count_ratio") < ratio))


def heartbeat_gaps(beats: DataFrame, expected: float = 60.0, tolerated: float = 90.0) -> DataFrame:
    """Minutes missing per day: the excess over the expected spacing of every spacing above the tolerated one.

    Spacings inside one minute can never count, so each minute is reduced to its first and last beat before the day
    is ordered: at most 1,440 rows per day, whatever the beat rate.
    """
    minute = beats.groupBy(F.date_trunc("minute", "heartbeat_utc").alias("_m")).agg(
        F.min("heartbeat_utc").alias("_first"), F.max("heartbeat_utc").alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    day = F.to_date("_m")
    w = Window.partitionBy(day).orderBy("_m")
    micros = F.unix_micros("_first") - F.unix_micros(F.lag("_last").over(w))
    spaced = minute.select(day.alias("trade_date"), "_n", (micros / 1e6).alias("_s"))
    return spaced.groupBy("trade_date").agg(
        F.sum("_n").alias("heartbeat_rows"),
        (F.coalesce(F.sum(F.when(F.col("_s") > tolerated, F.col("_s") - expected)), F.lit(0.0)) / 60.0).alias("heartbeat_gap_minutes"),
    )


def reconnect_gaps(events: DataFrame) -> DataFrame:
    """Minutes between the first failure after a connect and the next connect, per day; an open gap is ignored.

    Connects are numbered by a running count over minute buckets. A failure belongs to the connect that follows it,
    so a plain aggregate per (day, connect number) finds the first failure and its closing time.
    """
    kept = events.filter(F.col("event_type").isin(*OPENERS, "connect")).withColumn("trade_date", F.to_date("event_utc"))
    connect = F.col("event_type") == "connect"
    numbered = running(
        kept,
        ["trade_date"],
        ["event_utc", "event_id"],
        {"_c": ("sum", F.when(connect, 1).otherwise(0))},
        UNKNOWN,
        F.date_trunc("minute", "event_utc"),
    )
    pair = F.when(connect, F.col("_c")).otherwise(F.col("_c") + 1)
    gaps = numbered.groupBy("trade_date", pair.alias("_pair")).agg(
        F.min(F.when(~connect, F.col("event_utc"))).alias("_open"), F.max(F.when(connect, F.col("event_utc"))).alias("_closed")
    )
    seconds = (F.unix_micros("_closed") - F.unix_micros("_open")) / 1e6
    return gaps.groupBy("trade_date").agg(
        (F.coalesce(F.sum(F.greatest(seconds, F.lit(0.0))), F.lit(0.0)) / 60.0).alias("event_reconnect_gap_minutes"),
        F.count("_open").alias("disconnect_events"),
    )


def daily_audit(counts: DataFrame, beats: DataFrame, events: DataFrame, days: int = 7, ratio: float = 0.60) -> DataFrame:
    """Counts with suspect flags, joined with both kinds of gaps (one row per day, broadcast)."""
    return (
        suspect_days(counts, days, ratio)
        .join(heartbeat_gaps(beats), "trade_date", "left")
        .join(reconnect_gaps(events), "trade_date", "left")
    )


def quality_gate(audit: DataFrame, min_days: int = 15, max_gap: float = 5.0, readable: bool = True) -> DataFrame:
    """Enough fully stable days, no suspect day, small mean gap and readable files."""
    stable = ~F.col("suspect")
    by_day = audit.groupBy("trade_date").agg(
        F.count_distinct("symbol").alias("_all"), F.count_distinct(F.when(stable, F.col("symbol"))).alias("_stable")
    )
    expected = by_day.agg(F.max("_all").alias("_expected"))
    dates = by_day.join(F.broadcast(expected)).agg(
        F.sum(F.when(F.col("_stable") > 0, 1).otherwise(0)).alias("stable_trade_dates"),
        F.sum(F.when(F.col("_stable") >= F.col("_expected"), 1).otherwise(0)).alias("full_stable_trade_dates"),
    )
    gap = F.greatest(F.coalesce("heartbeat_gap_minutes", F.lit(0.0)), F.coalesce("event_reconnect_gap_minutes", F.lit(0.0)))
    totals = audit.agg(
        F.sum(stable.cast("int")).alias("stable_symbol_days"),
        F.sum(F.col("suspect").cast("int")).alias("suspect_symbol_days"),
        F.avg(gap).alias("avg_gap_minutes"),
    )
    passed = (
        (F.col("full_stable_trade_dates") >= min_days) & (F.col("suspect_symbol_days") == 0)
        & (F.col("avg_gap_minutes") <= max_gap) & F.lit(readable)
    )
    # two one-row tables
    return totals.join(F.broadcast(dates)).withColumn("status", F.when(passed, "gate_passed").otherwise("gate_blocked"))


def file_check(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """Per Parquet file: can its footer be read, and which required columns are missing.

    The listing reads no content; tasks open each file and read its footer only.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    wanted = list(required)

    def inspect(batches):
        import pandas as pd
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        for pdf in batches:
            out = []
            for name in pdf["path"]:
                try:
                    store, local = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file:///") else name)
                    with store.open_input_file(local) as handle:
                        found = pq.ParquetFile(handle)
                        missing = sorted(set(wanted) - set(found.schema_arrow.names))
                        out.append((name, True, found.metadata.num_rows, ",".join(missing)))
                except Exception:  # noqa: BLE001
                    out.append((name, False, 0, ""))
            yield pd.DataFrame(out, columns=["path", "readable", "rows", "missing_columns"])

    return files.select("path").mapInPandas(inspect, "path string, readable boolean, rows long, missing_columns string")


def plan_status(audit: DataFrame, gate: DataFrame, calendar_days: int = 28) -> DataFrame:
    """Days observed, whether the window expired and whether the kill switch fired."""
    seen = audit.agg(F.min("trade_date").alias("first_trade_date"), F.max("trade_date").alias("latest_trade_date"))
    days = F.datediff("latest_trade_date", "first_trade_date") + 1
    # two one-row tables
    out = seen.join(F.broadcast(gate.select("status", "full_stable_trade_dates"))).withColumn("calendar_days_observed", days)
    expired = F.col("calendar_days_observed") >= calendar_days
    ok = F.col("status") == "gate_passed"
    return out.select(
        "first_trade_date",
        "latest_trade_date",
        "calendar_days_observed",
        expired.alias("window_expired"),
        (expired & ~ok).alias("kill_switch"),
        F.when(expired & ~ok, "rebuild_or_delay").when(ok, "collection_allowed").otherwise("shakedown_active").alias("plan_status"),
    )


def latest_status(beats: DataFrame, events: DataFrame) -> DataFrame:
    """Latest heartbeat and latest event."""
    last = events.agg(F.max("event_utc").alias("latest_event_utc"), F.max_by("event_type", F.struct("event_utc", "event_id")).alias("latest_event_type"))
    return beats.agg(F.max("heartbeat_utc").alias("latest_heartbeat_utc")).join(F.broadcast(last))
