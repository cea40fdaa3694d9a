"""Features of exchange end-of-day files, lagged one observation so a day only sees finished days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.functions.layout import DAILY, Shape, over_series


def _lagged(df: DataFrame, w, columns: dict):
    """Compute rolling columns first, then shift every one by a row."""
    named = df.select("*", *[c.alias(f"_raw_{n}") for n, c in columns.items()])
    shifted = named.select(*df.columns, *[F.lag(f"_raw_{n}").over(w).alias(f"_lag_{n}") for n in columns])
    keep = [c for c in df.columns if c not in columns]
    return shifted.select(*keep, *[F.col(f"_lag_{n}").alias(n) for n in columns])


def delivery_features(delivery: DataFrame, min_5d_ma: float = 0.0, shape: Shape = DAILY) -> DataFrame:
    """Delivery-share averages, z-score and rising flags per symbol and date."""
    clean = delivery.select(
        F.upper(F.trim("symbol")).alias("ticker"),
        F.to_date("date").alias("trade_date"),
        F.col("deliv_pct").try_cast("double").alias("deliv_pct"),
    ).dropna()

    def build(df, w):
        pct = F.col("deliv_pct")
        return _lagged(
            df,
            w,
            {
                "deliv_pct": pct,
                "deliv_pct_5d_ma": R.mean(pct, w, 5, 3),
                "deliv_pct_20d_ma": R.mean(pct, w, 20, 10),
                "deliv_pct_zscore_20d": R.zscore(pct, w, 20, 10),
            },
        )

    rising = R.holds(F.col("deliv_pct_5d_ma") > F.col("deliv_pct_20d_ma"))
    return over_series(clean, build, order=["trade_date"], before=20, shape=shape).select(
        "*",
        rising.alias("deliv_rising"),
        (rising & R.holds(F.col("deliv_pct_5d_ma") >= min_5d_ma)).alias("deliv_rising_above_floor"),
        (rising & R.holds(F.col("deliv_pct_zscore_20d") > 0)).alias("deliv_rising_and_zpos"),
    )


def nearest_expiry(oi: DataFrame) -> DataFrame:
    """One record per symbol and date: smallest non-negative days to expiry; all rows count if none is valid."""
    days = F.datediff("expiry", "date")
    best = F.struct(F.when(days >= 0, 0).otherwise(1).alias("expired"), days.alias("dte"), F.col("expiry"))
    any_valid = oi.agg(F.coalesce(F.bool_or(days >= 0), F.lit(False)).alias("_any_valid"))
    picked = oi.groupBy("symbol", "date").agg(
        F.min(F.struct(best.alias("k"), "oi", "chg_in_oi")).alias("r")
    )
    # a one-row table
    return (
        picked.join(F.broadcast(any_valid))
        .filter(~F.col("_any_valid") | (F.col("r.k.expired") == 0))
        .select("symbol", "date", F.col("r.k.expiry").alias("expiry"), F.col("r.k.dte").alias("days_to_expiry"), "r.oi", "r.chg_in_oi")
    )


def oi_features(oi: DataFrame, tickers: DataFrame | Sequence[str] | None = None, shape: Shape = DAILY) -> DataFrame:
    """Sums of the change in open interest of the nearest future, per symbol and date."""
    clean = oi.select(
        F.to_date("date").alias("date"),
        F.upper(F.trim("instrument")).alias("instrument"),
        F.upper(F.trim("symbol")).alias("symbol"),
        F.to_date("expiry").alias("expiry"),
        F.col("oi").try_cast("double").alias("oi"),
        F.col("chg_in_oi").try_cast("double").alias("chg_in_oi"),
    )
    clean = clean.filter(F.col("instrument").isin("FUTSTK", "FUTIDX")).dropna()
    if isinstance(tickers, DataFrame):
        wanted = tickers.select(F.upper(F.trim(F.col(tickers.columns[0]))).alias("symbol")).distinct()
        clean = clean.join(wanted, "symbol", "left_semi")
    elif tickers is not None:
        clean = clean.filter(F.col("symbol").isin([t.strip().upper() for t in tickers]))
    daily = nearest_expiry(clean).select(
        F.col("symbol").alias("ticker"), F.col("date").alias("trade_date"), "oi", "chg_in_oi"
    )

    def build(df, w):
        chg = F.col("chg_in_oi")
        return _lagged(
            df,
            w,
            {
                "oi": F.col("oi"),
                "chg_in_oi": chg,
                "oi_change_5d_sum": R.total(chg, w, 5, 3),
                "oi_change_20d_sum": R.total(chg, w, 20, 10),
            },
        )

    rising = R.holds(F.col("oi_change_5d_sum") > 0)
    return over_series(daily, build, order=["trade_date"], before=20, shape=shape).select(
        "*", rising.alias("oi_rising"), (rising & R.holds(F.col("chg_in_oi") > 0)).alias("oi_rising_and_pos")
    )


def advance_fraction(closes: DataFrame, shape: Shape = DAILY) -> DataFrame:
    """Share of symbols with a positive one-row return per date; a missing return counts as not advancing."""
    returns = over_series(
        closes,
        lambda df, w: df.withColumn("ret_1d", R.change(F.col("close"), w, 1)),
        before=1,
        shape=shape,
    )
    return returns.groupBy(F.col("ts").alias("trade_date")).agg(
        F.avg(F.when(F.col("ret_1d") > 0, 1.0).otherwise(0.0)).alias("breadth_adv_frac"),
        F.count_distinct("ticker").alias("breadth_universe_count"),
    )


def breadth_features(closes: DataFrame, shape: Shape = DAILY) -> DataFrame:
    """Market breadth by date. The daily aggregate has one row per calendar day: one window task is enough."""
    daily = advance_fraction(closes, shape)
    w = Window.orderBy("trade_date")
    frac = F.col("breadth_adv_frac")
    lagged = _lagged(
        daily,
        w,
        {
            "breadth_adv_frac": frac,
            "breadth_5d_ma": R.mean(frac, w, 5, 3),
            "breadth_20d_ma": R.mean(frac, w, 20, 10),
            "breadth_zscore_20d": R.zscore(frac, w, 20, 10),
            "breadth_universe_count": F.col("breadth_universe_count").cast("double"),
        },
    )
    up = R.holds(F.col("breadth_5d_ma") > F.col("breadth_20d_ma"))
    return lagged.select(
        "*",
        up.alias("breadth_trend_up"),
        (up & R.holds(F.col("breadth_5d_ma") >= 0.55)).alias("breadth_strong"),
        (up & R.holds(F.col("breadth_zscore_20d") > 0)).alias("breadth_expanding"),
    )


def any_of(flags: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """True where any row of the key is true."""
    return flags.groupBy(*keys).agg(*[F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in names])


def event_window(events: DataFrame, pre: int = 5, narrow: int = 2, post: int = 1) -> DataFrame:
    """Expand each event to calendar days around it and flag how near they are."""
    offsets = F.explode(F.sequence(F.lit(-abs(pre)), F.lit(abs(post))))
    days = (
        events.select(F.upper(F.trim("symbol")).alias("ticker"), F.to_date("event_date").alias("event_date"))
        .dropna()
        .distinct()
        .select("ticker", "event_date", offsets.alias("offset"))
        .select(
            "ticker",
            F.date_add("event_date", F.col("offset")).alias("trade_date"),
            (F.col("offset") == 0).alias("earnings_event_day"),
            (F.abs("offset") <= abs(narrow)).alias("earnings_near_2d"),
            (F.abs("offset") <= abs(pre)).alias("earnings_near_5d"),
        )
    )
    flags = any_of(days, ["ticker", "trade_date"], ["earnings_event_day", "earnings_near_2d", "earnings_near_5d"])
    return flags.select(
        "*", (~F.col("earnings_near_2d")).alias("earnings_clear_2d"), (~F.col("earnings_near_5d")).alias("earnings_clear_5d")
    )


def vol_context(vix: DataFrame) -> DataFrame:
    """Rolling context of a volatility index (columns dt, vix); one row per calendar day."""
    w = Window.orderBy("dt")
    v = F.col("vix")
    return vix.select(
        "dt",
        "vix",
        R.quantile(v, 0.5, w, 20, 10).alias("vix_median_20"),
        R.quantile(v, 0.6, w, 60, 20).alias("vix_p60_60"),
        R.change(v, w, 1).alias("vix_change_1d"),
    )


def spot_context(spot: DataFrame) -> DataFrame:
    """Five-row return and distance to the 20-row average of an index (columns dt, spot)."""
    w = Window.orderBy("dt")
    s = F.col("spot")
    sma = R.mean(s, w, 20, 10)
    return spot.select(
        "dt", "spot", R.change(s, w, 5).alias("spot_ret_5d"), sma.alias("spot_sma20"), (R.ratio(s, sma) - 1.0).alias("spot_vs_sma20")
    )


def momentum(bars: DataFrame, *rows: int, shape: Shape = DAILY) -> DataFrame:
    """Trailing return over each number of rows: ret3, ret60, ..."""
    return over_series(
        bars,
        lambda df, w: df.select("*", *[R.change(F.col("close"), w, n).alias(f"ret{n}") for n in rows]),
        before=max(rows),
        shape=shape,
    )


def aligned_market_return(bars: DataFrame, rows: int = 3, name: str = "mkt_ret", shape: Shape = DAILY) -> DataFrame:
    """Mean over tickers of the change against ``rows`` calendar rows earlier on the date-aligned price table.

    Prices are carried forward over missing dates, as the padded change of a pivoted table does. The ticker-by-date
    grid is not built: a carried price only changes for ``rows`` days after an observation and the change is zero on
    all other days, so each observation yields at most ``rows`` rows and the zeros enter through the ticker count.
    """
    # one row per calendar day
    calendar = bars.select("ts").distinct().withColumn("_d", F.row_number().over(Window.orderBy("ts")).cast("long"))
    placed = bars.select("ticker", "ts", "close").join(F.broadcast(calendar) if shape.series_fits() else calendar, "ts")

    def build(df, w):
        earlier = [F.struct(F.lag("_d", k).over(w).alias("d"), F.lag("close", k).over(w).alias("p")) for k in range(1, rows + 1)]
        return df.select("ticker", "_d", "close", F.lead("_d").over(w).alias("_next"), F.array(*earlier).alias("_earlier"))

    observed = over_series(placed, build, order=["_d"], before=rows, after=1, shape=shape, bucket=F.floor(F.col("_d") / 64))
    last_moved = F.least(F.col("_d") + rows - 1, F.col("_next") - 1)
    moved = observed.select("close", "_earlier", F.explode(F.sequence(F.col("_d"), last_moved)).alias("_x"))
    base = F.get(F.filter("_earlier", lambda e: e.d <= F.col("_x") - rows), F.lit(0)).p
    sums = moved.groupBy(F.col("_x").alias("_d")).agg(F.sum(F.col("close") / base - 1.0).alias("_sum"))
    starts = placed.groupBy("ticker").agg((F.min("_d") + rows).alias("_d")).groupBy("_d").agg(F.count(F.lit(1)).alias("_new"))
    upto = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    by_day = (
        calendar.join(sums, "_d", "left")
        .join(starts, "_d", "left")
        .withColumn("_known", F.sum(F.coalesce("_new", F.lit(0))).over(upto))
    )
    mean = F.when(F.col("_known") > 0, F.coalesce("_sum", F.lit(0.0)) / F.col("_known"))
    return by_day.select("ts", mean.alias(name))


def relative_breadth(bars: DataFrame, rows: int = 3, shape: Shape = DAILY) -> DataFrame:
    """Share of tickers per date whose return beats the aligned market return; missing counts as not beating."""
    own = momentum(bars, rows, shape=shape).select("ticker", "ts", F.col(f"ret{rows}").alias("_own"))
    market = aligned_market_return(bars, rows, "mkt_ret", shape)
    joined = own.join(F.broadcast(market) if shape.series_fits() else market, "ts", "left")
    return joined.groupBy("ts").agg(
        F.avg(F.when(F.col("_own") - F.col("mkt_ret") > 0, 1.0).otherwise(0.0)).alias("breadth_rel_adv_frac"),
        F.max("mkt_ret").alias("mkt_ret"),
        F.count(F.lit(1)).alias("available_symbol_count"),
    )
