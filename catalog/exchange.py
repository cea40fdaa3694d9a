"""Exchange-data features (delivery, open interest, breadth, events, volatility and index context)."""

from catalog import fixtures as fx
from catalog.registry import query
from tickloom.operators import exchange as ex

ROLL5 = "(PARTITION BY {p} ORDER BY {o} ROWS 4 PRECEDING)"
ROLL20 = "(PARTITION BY {p} ORDER BY {o} ROWS 19 PRECEDING)"


@query(
    "w1_delivery_features",
    "ticker:s trade_date:d deliv_pct:f deliv_pct_5d_ma:f deliv_pct_20d_ma:f deliv_pct_zscore_20d:f "
    "deliv_rising:b deliv_rising_above_floor:b deliv_rising_and_zpos:b",
    f"""WITH {fx.DELIVERY}, raw AS (
      SELECT symbol, date, deliv_pct,
        CASE WHEN count(*) OVER w5 >= 3 THEN avg(deliv_pct) OVER w5 END AS m5,
        CASE WHEN count(*) OVER w20 >= 10 THEN avg(deliv_pct) OVER w20 END AS m20,
        CASE WHEN count(*) OVER w20 >= 10 AND max(deliv_pct) OVER w20 > min(deliv_pct) OVER w20
             THEN (deliv_pct - avg(deliv_pct) OVER w20) / stddev_samp(deliv_pct) OVER w20 END AS z
      FROM delivery WINDOW w5 AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING),
                           w20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
    lagged AS (
      SELECT symbol AS ticker, date AS trade_date, lag(deliv_pct) OVER w AS deliv_pct, lag(m5) OVER w AS deliv_pct_5d_ma,
             lag(m20) OVER w AS deliv_pct_20d_ma, lag(z) OVER w AS deliv_pct_zscore_20d
      FROM raw WINDOW w AS (PARTITION BY symbol ORDER BY date))
    SELECT *, coalesce(deliv_pct_5d_ma > deliv_pct_20d_ma, false) AS deliv_rising,
           coalesce(deliv_pct_5d_ma > deliv_pct_20d_ma AND deliv_pct_5d_ma >= 30, false) AS deliv_rising_above_floor,
           coalesce(deliv_pct_5d_ma > deliv_pct_20d_ma AND deliv_pct_zscore_20d > 0, false) AS deliv_rising_and_zpos
    FROM lagged""",
)
def _(t):
    return ex.delivery_features(fx.delivery(t), min_5d_ma=30.0)


OI_NEAREST = f"""{fx.OPEN_INTEREST}, nearest AS (
      SELECT symbol, date, arg_min(oi, row(expiry - date, expiry, oi, chg_in_oi)) AS oi,
             arg_min(chg_in_oi, row(expiry - date, expiry, oi, chg_in_oi)) AS chg_in_oi, min(expiry - date) AS days_to_expiry,
             min(expiry) AS expiry
      FROM oi WHERE expiry >= date GROUP BY 1, 2)"""


@query(
    "w2_open_interest_features",
    "ticker:s trade_date:d oi:f chg_in_oi:f oi_change_5d_sum:f oi_change_20d_sum:f oi_rising:b oi_rising_and_pos:b",
    f"""WITH {OI_NEAREST}, raw AS (
      SELECT *, CASE WHEN count(*) OVER w5 >= 3 THEN sum(chg_in_oi) OVER w5 END AS s5,
             CASE WHEN count(*) OVER w20 >= 10 THEN sum(chg_in_oi) OVER w20 END AS s20
      FROM nearest WINDOW w5 AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING),
                          w20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
    lagged AS (
      SELECT symbol AS ticker, date AS trade_date, lag(oi) OVER w AS oi, lag(chg_in_oi) OVER w AS chg_in_oi,
             lag(s5) OVER w AS oi_change_5d_sum, lag(s20) OVER w AS oi_change_20d_sum
      FROM raw WINDOW w AS (PARTITION BY symbol ORDER BY date))
    SELECT *, coalesce(oi_change_5d_sum > 0, false) AS oi_rising,
           coalesce(oi_change_5d_sum > 0 AND chg_in_oi > 0, false) AS oi_rising_and_pos FROM lagged""",
)
def _(t):
    return ex.oi_features(fx.open_interest(t), fx.sectors(t).select("ticker"))


@query(
    "a3_nearest_expiry",
    "symbol:s date:d expiry:d days_to_expiry:i oi:f chg_in_oi:f",
    f"WITH {OI_NEAREST} SELECT * FROM nearest",
)
def _(t):
    return ex.nearest_expiry(fx.open_interest(t))


ADVANCE = f"""{fx.BARS}, advance AS (
      SELECT ts AS trade_date, avg(CASE WHEN close > prev THEN 1.0::DOUBLE ELSE 0 END) AS breadth_adv_frac,
             count(DISTINCT ticker) AS breadth_universe_count
      FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY ts) AS prev FROM bars) GROUP BY 1)"""


@query(
    "a4_advance_fraction",
    "trade_date:d breadth_adv_frac:f breadth_universe_count:i",
    f"WITH {ADVANCE} SELECT * FROM advance",
)
def _(t):
    return ex.advance_fraction(fx.bars(t))


BREADTH = f"""{ADVANCE}, breadth_raw AS (
      SELECT *, CASE WHEN count(*) OVER w5 >= 3 THEN avg(breadth_adv_frac) OVER w5 END AS m5,
             CASE WHEN count(*) OVER w20 >= 10 THEN avg(breadth_adv_frac) OVER w20 END AS m20,
             CASE WHEN count(*) OVER w20 >= 10 AND max(breadth_adv_frac) OVER w20 > min(breadth_adv_frac) OVER w20
                  THEN (breadth_adv_frac - avg(breadth_adv_frac) OVER w20) / stddev_samp(breadth_adv_frac) OVER w20 END AS z
      FROM advance WINDOW w5 AS (ORDER BY trade_date ROWS 4 PRECEDING), w20 AS (ORDER BY trade_date ROWS 19 PRECEDING)),
    breadth AS (
      SELECT *, coalesce(breadth_5d_ma > breadth_20d_ma, false) AS breadth_trend_up,
             coalesce(breadth_5d_ma > breadth_20d_ma AND breadth_5d_ma >= 0.55, false) AS breadth_strong,
             coalesce(breadth_5d_ma > breadth_20d_ma AND breadth_zscore_20d > 0, false) AS breadth_expanding
      FROM (SELECT trade_date, lag(breadth_adv_frac) OVER w AS breadth_adv_frac, lag(m5) OVER w AS breadth_5d_ma,
                   lag(m20) OVER w AS breadth_20d_ma, lag(z) OVER w AS breadth_zscore_20d,
                   CAST(lag(breadth_universe_count) OVER w AS DOUBLE) AS breadth_universe_count
            FROM breadth_raw WINDOW w AS (ORDER BY trade_date)))"""


@query(
    "w3_breadth_features",
    "trade_date:d breadth_adv_frac:f breadth_5d_ma:f breadth_20d_ma:f breadth_zscore_20d:f breadth_universe_count:f "
    "breadth_trend_up:b breadth_strong:b breadth_expanding:b",
    f"WITH {BREADTH} SELECT * FROM breadth",
)
def _(t):
    return ex.breadth_features(fx.bars(t))


EVENT_WINDOW = f"""{fx.EARNINGS}, event_days AS (
      SELECT symbol AS ticker, event_date + CAST(o AS INTEGER) AS trade_date, bool_or(o = 0) AS earnings_event_day,
             bool_or(abs(o) <= 2) AS earnings_near_2d, bool_or(abs(o) <= 5) AS earnings_near_5d
      FROM earnings, (SELECT unnest(range(-5, 2)) AS o) GROUP BY 1, 2)"""


@query(
    "w4_event_window",
    "ticker:s trade_date:d earnings_event_day:b earnings_near_2d:b earnings_near_5d:b earnings_clear_2d:b earnings_clear_5d:b",
    f"""WITH {EVENT_WINDOW} SELECT *, NOT earnings_near_2d AS earnings_clear_2d, NOT earnings_near_5d AS earnings_clear_5d
    FROM event_days""",
)
def _(t):
    return ex.event_window(fx.earnings(t))


@query(
    "a15_any_of_flags",
    "ticker:s month:s any_event:b any_up:b",
    f"""WITH {fx.BARS} SELECT ticker, strftime(ts, '%Y-%m') AS month, bool_or(volume >= 45) AS any_event,
        bool_or(close > open) AS any_up FROM bars GROUP BY 1, 2""",
)
def _(t):
    from pyspark.sql import functions as F

    flags = fx.bars(t).select(
        "ticker",
        F.date_format("ts", "yyyy-MM").alias("month"),
        (F.col("volume") >= 45).alias("any_event"),
        (F.col("close") > F.col("open")).alias("any_up"),
    )
    return ex.any_of(flags, ["ticker", "month"], ["any_event", "any_up"])


VIX_CONTEXT = f"""{fx.VIX}, vix_context AS (
      SELECT dt, vix, CASE WHEN count(*) OVER w20 >= 10 THEN quantile_cont(vix, 0.5) OVER w20 END AS vix_median_20,
             CASE WHEN count(*) OVER w60 >= 20 THEN quantile_cont(vix, 0.6) OVER w60 END AS vix_p60_60,
             vix / lag(vix) OVER (ORDER BY dt) - 1 AS vix_change_1d
      FROM vix WINDOW w20 AS (ORDER BY dt ROWS 19 PRECEDING), w60 AS (ORDER BY dt ROWS 59 PRECEDING))"""


@query(
    "w5_volatility_index_context",
    "dt:d vix:f vix_median_20:f vix_p60_60:f vix_change_1d:f",
    f"WITH {VIX_CONTEXT} SELECT * FROM vix_context",
)
def _(t):
    return ex.vol_context(fx.vix(t))


SPOT_CONTEXT = f"""{fx.SPOT}, spot_context AS (
      SELECT dt, spot, spot / lag(spot, 5) OVER (ORDER BY dt) - 1 AS spot_ret_5d,
             CASE WHEN count(*) OVER w20 >= 10 THEN avg(spot) OVER w20 END AS spot_sma20,
             spot / CASE WHEN count(*) OVER w20 >= 10 THEN avg(spot) OVER w20 END - 1 AS spot_vs_sma20
      FROM spot WINDOW w20 AS (ORDER BY dt ROWS 19 PRECEDING))"""


@query(
    "w6_index_context",
    "dt:d spot:f8 spot_ret_5d:f spot_sma20:f3 spot_vs_sma20:f",
    f"WITH {SPOT_CONTEXT} SELECT * FROM spot_context",
)
def _(t):
    return ex.spot_context(fx.spot(t))


@query(
    "w7_trailing_momentum",
    "ticker:s ts:d close:f ret3:f ret60:f",
    f"""WITH {fx.BARS} SELECT ticker, ts, close, close / lag(close, 3) OVER w - 1 AS ret3,
        close / lag(close, 60) OVER w - 1 AS ret60 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts)""",
)
def _(t):
    return ex.momentum(fx.bars(t), 3, 60)


MARKET_RET = """calendar AS (SELECT ts, row_number() OVER (ORDER BY ts) AS d FROM (SELECT DISTINCT ts FROM bars)),
    grid AS (SELECT k.ticker, c.ts, c.d FROM calendar c, (SELECT DISTINCT ticker FROM bars) k),
    padded AS (SELECT g.ticker, g.ts, b.close FROM grid g ASOF LEFT JOIN bars b ON g.ticker = b.ticker AND g.ts >= b.ts),
    market_ret AS (
      SELECT ts, avg(r) AS mkt_ret FROM (
        SELECT ts, close / lag(close, 3) OVER (PARTITION BY ticker ORDER BY ts) - 1 AS r FROM padded) GROUP BY ts)"""


@query(
    "a6_aligned_market_return",
    "ts:d mkt_ret:f",
    f"WITH {fx.BARS}, {MARKET_RET} SELECT * FROM market_ret",
)
def _(t):
    return ex.aligned_market_return(fx.bars(t), 3)


REL_BREADTH = """own_ret AS (SELECT *, close / lag(close, 3) OVER (PARTITION BY ticker ORDER BY ts) - 1 AS ret3 FROM bars),
    rel_breadth AS (
      SELECT ts, avg(CASE WHEN ret3 - mkt_ret > 0 THEN 1.0::DOUBLE ELSE 0 END) AS breadth_rel_adv_frac,
             max(mkt_ret) AS mkt_ret, count(*) AS available_symbol_count
      FROM own_ret LEFT JOIN market_ret USING (ts) GROUP BY ts)"""


@query(
    "w8_relative_breadth",
    "ts:d breadth_rel_adv_frac:f mkt_ret:f available_symbol_count:i",
    f"WITH {fx.BARS}, {MARKET_RET}, {REL_BREADTH} SELECT * FROM rel_breadth",
)
def _(t):
    return ex.relative_breadth(fx.bars(t), 3)
