"""Readers of bars, exchange end-of-day files, option chains and series."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.cleaning import keep_last
from tickloom.schemas import resolve_columns
from tickloom.sources.dayfiles import first_header, read_days


def exchange_date(text: Column) -> Column:
    """Dates such as 24-JUN-2020 or 24-Jun-2020; null where unreadable."""
    return F.try_to_timestamp(F.initcap(F.lower(F.trim(text))), F.lit("dd-MMM-yyyy")).cast("date")


def file_date(name: Column, pattern: str, fmt: str) -> Column:
    """Trade date in a file name: ``pattern`` has one group around the date text."""
    return F.try_to_timestamp(F.initcap(F.lower(F.regexp_extract(name, "(?i)" + pattern, 1))), F.lit(fmt)).cast("date")


DELIVERY_NAME = (r"sec_bhavdata_full_(\d{8})\.csv$", "ddMMyyyy")
FUTURES_NAME = (r"fo(\d{2}[a-z]{3}\d{4})bhav\.csv(?:\.zip)?$", "ddMMMyyyy")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """Text columns only: values are cast afterwards, so a bad value becomes null instead of failing a job."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    raw = raw.option("enforceSchema", False)  # a file with other columns fails, it is not misread
    return raw.option("recursiveFileLookup", True).csv(path).select("*", F.col("_metadata.file_name").alias("_file"))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    rows = resolve_columns(_csv(spark, path), "bars")
    numbers = [F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]
    return rows.select(F.upper(F.trim("ticker")).alias("ticker"), F.col("ts").try_cast("timestamp").alias("ts"), *numbers).dropna(subset=["ticker", "ts"])


def read_series(spark: SparkSession, paths: list[str], label: str) -> tuple[DataFrame | None, str]:
    """First path that can be read, as (dt, label) with the last row of each date, and a status."""
    for path in paths:
        try:
            raw = _csv(spark, path)
        except AnalysisException:
            continue
        try:
            rows = resolve_columns(raw, "series")
        except ValueError:
            return None, "invalid_schema"
        stamped = rows.select(F.col("dt").try_cast("timestamp").alias("_at"), F.col("value").try_cast("double").alias(label))
        dated = stamped.dropna().withColumn("dt", F.to_date("_at"))
        series = keep_last(dated, ["dt"], [F.col("_at"), F.col(label)]).select("dt", label)
        return series, "empty" if series.isEmpty() else "ok"
    return None, "missing"


def read_delivery(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Delivery files of many days, each with its own column order; the date comes from each file's name.

    A folder whose first file lacks a column is refused; later such files are left out and listed by :func:`bad_files`.
    """
    first_header(path, "delivery")
    rows = read_days(spark, path, "delivery", since=since, until=until, name=(DELIVERY_NAME[0], "%d%m%Y"))
    out = rows.filter("error IS NULL").select(
        file_date(F.col("_file"), *DELIVERY_NAME).alias("date"),
        F.upper("symbol").alias("symbol"),
        *[F.col(c).try_cast("double").alias(c) for c in ("total_qty", "deliv_qty", "deliv_pct")],
    )
    return out.filter((F.col("symbol") != "") & F.col("date").isNotNull())


def read_futures_oi(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    rows = read_days(spark, path, "oi", since=since, until=until, name=(FUTURES_NAME[0], "%d%b%Y")).filter("error IS NULL")
    out = rows.select(
        file_date(F.col("_file"), *FUTURES_NAME).alias("date"),
        F.upper("instrument").alias("instrument"),
        F.upper("symbol").alias("symbol"),
        exchange_date(F.col("expiry")).alias("expiry"),
        F.col("oi").try_cast("double").alias("oi"),
        F.col("chg_in_oi").try_cast("double").alias("chg_in_oi"),
    )
    return out.filter((F.col("symbol") != "") & F.col("date").isNotNull())


def read_chain(spark: SparkSession, path: str, underlying: str | None = "NIFTY", kind: str = "OPTIDX") -> DataFrame:
    """Options of one underlying (all with None, then with ``symbol``) from daily files; incomplete rows are dropped."""
    equal = {"instrument": kind} | ({"symbol": underlying} if underlying else {})
    columns = ["trade_date", "expiry", "strike", "option_typ", "close", "contracts", "open_int", *(() if underlying else ("symbol",))]
    rows = read_days(spark, path, "chain", columns, equal).filter("error IS NULL")
    return rows.select(
        *(() if underlying else (F.upper("symbol").alias("symbol"),)),
        exchange_date(F.col("trade_date")).alias("trade_date"),
        exchange_date(F.col("expiry")).alias("expiry"),
        F.col("strike").try_cast("double").alias("strike"),
        F.upper("option_typ").alias("option_typ"),
        F.col("close").try_cast("double").alias("close"),
        F.col("contracts").try_cast("double").cast("long").alias("contracts"),
        F.col("open_int").try_cast("double").cast("long").alias("open_int"),
    ).dropna(subset=["trade_date", "expiry", "strike", "close"])


def bad_files(spark: SparkSession, path: str, kind: str = "oi") -> DataFrame:
    """Files and archives that could not be read as ``kind``, with the reason."""
    return read_days(spark, path, kind).filter("error IS NOT NULL").select("_file", "error")


def master_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("symbol").alias("symbols"))


def read_panel(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Reader by input kind: bars, delivery, oi, chain, earnings."""
    if kind == "earnings":
        rows = resolve_columns(_csv(spark, path), "earnings")
        return rows.select(F.upper(F.trim("symbol")).alias("symbol"), F.to_date(F.col("event_date").try_cast("timestamp")).alias("event_date")).dropna()
    readers = {"bars": read_bars, "delivery": read_delivery, "oi": read_futures_oi, "chain": read_chain}
    return readers[kind](spark, path)


def normalise_candles(candles: DataFrame, instruments: DataFrame) -> DataFrame:
    """Candles (instrument_token, timestamp, OHLCV) with instrument columns, one row per token and timestamp."""
    once = keep_last(
        candles.withColumn("timestamp", F.col("timestamp").cast("timestamp")), ["instrument_token", "timestamp"],
        [F.col(c) for c in ("close", "volume", "open", "high", "low")],
    )
    return once.join(instruments.select("instrument_token", "exchange", "tradingsymbol"), "instrument_token")
