"""Daily technical indicators: expressions on one window, recursions as a grouped map over Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.functions.layout import DAILY, Shape, apply_series, over_series, running

#: rows after which the slowest recursion (Wilder 14 on Wilder 14) has forgotten its start to double precision
WARMUP = 900


def technical_indicators(bars: DataFrame, shape: Shape = DAILY) -> DataFrame:
    """Log and simple return, averages, Bollinger bands, VWAP, money flow, stochastic, Keltner, range; one exchange."""
    close, high, low, volume = (F.col(c) for c in ("close", "high", "low", "volume"))
    typical = (high + low + close) / 3.0

    def build(df, w):
        mid = R.mean(close, w, 20)
        f20 = R.frame(w, 20)
        sigma = F.when(F.count(close).over(f20) >= 20, F.stddev_pop(close).over(f20))
        flow = F.coalesce(R.ratio((close - low) - (high - close), high - low), F.lit(0.0)) * volume
        floor, top = R.lowest(low, w, 14), R.highest(high, w, 14)
        first = df.select(
            "*",
            F.ln(close).alias("log_close"),
            F.coalesce(F.ln(close) - F.lag(F.ln(close)).over(w), F.lit(0.0)).alias("log_return"),
            F.coalesce(R.change(close, w, 1), F.lit(0.0)).alias("lagged_return"),
            R.mean(close, w, 10).alias("sma10"),
            R.mean(close, w, 50).alias("sma50"),
            (mid + 2.0 * sigma).alias("bb_upper"),
            (mid - 2.0 * sigma).alias("bb_lower"),
            (4.0 * sigma / mid * 100.0).alias("bollinger_width"),
            R.ratio(R.total(typical * volume, w, 14), R.total(volume, w, 14)).alias("vwap"),
            R.ratio(R.total(flow, w, 20), R.total(volume, w, 20)).alias("chaikin_mf"),
            (100.0 * R.ratio(close - floor, top - floor)).alias("stoch_k"),
            R.mean((4.0 * high - 2.0 * low + close) / 3.0, w, 20).alias("kc_high"),
            R.mean(typical, w, 20).alias("kc_mid"),
            R.mean((-2.0 * high + 4.0 * low + close) / 3.0, w, 20).alias("kc_low"),
            R.ratio(high - low, F.col("open")).alias("intraday_pct_range"),
            F.when(close < F.lag(close).over(w), -volume).otherwise(volume).alias("_signed"),
        )
        return first.withColumn("stoch_d", R.mean(F.col("stoch_k"), w, 3))

    built = over_series(bars, build, before=50, shape=shape)
    return running(built, ["ticker"], ["ts"], {"obv": ("sum", F.col("_signed"))}, shape).drop("_signed")


def _ema(x: np.ndarray, alpha: float, least: int) -> np.ndarray:
    out = pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=least).mean()
    return out.to_numpy()


def _wilder_mean(x: np.ndarray, n: int) -> np.ndarray:
    """Mean of the first n values, then (previous * (n - 1) + x) / n."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        seeded = x[n - 1 :].astype(float).copy()
        seeded[0] = x[:n].mean()
        out[n - 1 :] = pd.Series(seeded).ewm(alpha=1.0 / n, adjust=False).mean()
    return out


def _directional(high, low, tr, n: int) -> np.ndarray:
    up, down = np.diff(high, prepend=high[:1]), -np.diff(low, prepend=low[:1])
    plus = np.where((up > down) & (up > 0), up, 0.0)
    minus = np.where((down > up) & (down > 0), down, 0.0)
    rng = _wilder_mean(tr, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        pdi, mdi = _wilder_mean(plus, n) / rng, _wilder_mean(minus, n) / rng
        dx = np.where(pdi + mdi > 0, 100.0 * np.abs(pdi - mdi) / (pdi + mdi), 0.0)
    adx = np.full(len(high), np.nan)
    if len(high) >= n:
        adx[n - 1 :] = _wilder_mean(dx[n - 1 :], n)
    return adx


def _recursions(pdf: pd.DataFrame) -> pd.DataFrame:
    close, high, low, volume = (pdf[c].to_numpy(float) for c in ("close", "high", "low", "volume"))
    move = np.diff(close, prepend=close[:1])
    gain = _ema(np.where(move > 0, move, 0.0), 1 / 14, 14)
    loss = _ema(np.where(move < 0, -move, 0.0), 1 / 14, 14)
    before = np.concatenate([[np.nan], close[:-1]])
    tr = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
    with np.errstate(divide="ignore", invalid="ignore"):
        rsi = np.where(loss == 0, 100.0, 100.0 - 100.0 / (1.0 + gain / loss))
    rsi[np.isnan(gain)] = np.nan
    return pd.DataFrame(
        {
            "ticker": pdf["ticker"].to_numpy(),
            "ts": pdf["ts"].to_numpy(),
            "rsi": rsi,
            "macd": _ema(close, 2 / 13, 12) - _ema(close, 2 / 27, 26),
            "adx": _directional(high, low, tr, 14),
            "ema20": _ema(close, 2 / 21, 20),
            "atr": _wilder_mean(tr, 14),
            "force_index": _ema(np.where(np.arange(len(close)) > 0, move * volume, np.nan), 2 / 3, 2),
        }
    )


def recursive_indicators(bars: DataFrame, shape: Shape = DAILY) -> DataFrame:
    """RSI 14, MACD 12/26, ADX 14, EMA 20, ATR 14 and force index 2 per ticker."""
    ts_type = dict(bars.dtypes)["ts"]
    schema = f"ticker string, ts {ts_type}, rsi double, macd double, adx double, ema20 double, atr double, force_index double"
    slim = bars.select("ticker", "ts", "high", "low", "close", "volume")
    return apply_series(slim, _recursions, schema, before=WARMUP, shape=shape)


def market_phase(adx, sma10, sma50):
    """Bull or Bear in a trend (ADX above 25) by the two averages, else Sideways."""
    return F.when(R.holds(adx > 25), F.when(R.holds(sma10 > sma50), "Bull").otherwise("Bear")).otherwise("Sideways")
