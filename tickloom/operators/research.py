"""The feature columns labels and portfolio rules rely on, as one pass per ticker and one aggregate per timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.functions.layout import DAILY, Shape, over_series

#: rows the deepest frame of :func:`ticker_columns` looks back
LOOKBACK = 30


def true_range(w: WindowSpec):
    previous = F.lag("close").over(w)
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous)
    )


def _own(df: DataFrame, w: WindowSpec) -> DataFrame:
    close = F.col("close")
    step = df.select(
        "*",
        R.change(close, w, 1).alias("lag_ret_1"),
        R.change(close, w, 3).alias("ret_3"),
        R.change(close, w, 6).alias("ret_6"),
        true_range(w).alias("_tr"),
    )
    before3 = w.rowsBetween(-3, -1)
    up = F.max("high").over(before3)
    down = F.min("low").over(before3)
    ready = F.count("high").over(before3) == 3
    atr = R.mean(F.col("_tr"), w, 20)
    return step.select(
        "*",
        F.ln(R.ratio(atr, close)).alias("atr20_log"),
        (R.ratio(close, R.mean(close, w, 30)) - 1.0).alias("trend_30"),
        (R.ratio(R.mean(close, w, 2), R.mean(close, w, 8)) - 1.0).alias("trend_2h"),
        F.when(ready & (close > up), 1.0).when(ready & (close < down), -1.0).when(ready, 0.0).alias("breakout_3bar"),
        (R.total(F.signum("lag_ret_1"), w, 5) / 5.0).alias("sign_persistence_5"),
    ).drop("_tr")


def market_returns(panel: DataFrame, names: dict[str, str]) -> DataFrame:
    """Equal-weight mean by timestamp of each column; partial aggregates keep the shuffle at one row per timestamp."""
    return panel.groupBy("ts").agg(*[F.avg(c).alias(n) for n, c in names.items()])


def relative_to_market(own: DataFrame, shape: Shape = DAILY) -> DataFrame:
    """Returns of the equal-weight market beside each row and the row's returns against them."""
    market = market_returns(own, {"mkt_ret_1": "lag_ret_1", "mkt_ret_3": "ret_3", "mkt_ret_6": "ret_6"})
    # a table of a bounded calendar goes to all tasks, so the panel is not exchanged again by timestamp
    market = F.broadcast(market) if shape.series_fits() else market
    return own.join(market, "ts", "left").select(
        "*",
        (F.col("lag_ret_1") - F.col("mkt_ret_1")).alias("stock_minus_mkt_1"),
        (F.col("ret_3") - F.col("mkt_ret_3")).alias("stock_minus_mkt_3"),
        (F.col("ret_6") - F.col("mkt_ret_6")).alias("stock_minus_mkt_6"),
    )


def ticker_columns(bars: DataFrame, shape: Shape = DAILY) -> DataFrame:
    """Bars with the research columns that need no other ticker."""
    return over_series(bars, _own, before=LOOKBACK, shape=shape)


def research_columns(bars: DataFrame, shape: Shape = DAILY) -> DataFrame:
    """Bars with the columns labels need: returns, market-relative returns, ATR, trend, breakout, persistence."""
    return relative_to_market(ticker_columns(bars, shape), shape)


def calendar_windows(bars: DataFrame, n: int = 10) -> DataFrame:
    """``n`` consecutive windows over the distinct timestamps of a daily calendar (one row per day)."""
    days = bars.select("ts").distinct()
    return days.withColumn("window_id", F.ntile(n).over(Window.orderBy("ts")))
