"""Feature families on daily bars and on the quarter-hour bars of the tick stream."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.labels import RESEARCH
from catalog.registry import query
from tickloom.functions.layout import UNKNOWN
from tickloom.operators import intraday as it

W = "(PARTITION BY ticker ORDER BY ts ROWS {n} PRECEDING)"


def _w(n: int) -> str:
    return W.format(n=n - 1)


def _full(agg: str, col: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({col}) OVER {_w(n)} >= {least or n} THEN {agg}({col}) OVER {_w(n)} END"


def _std(col: str, n: int) -> str:
    return f"CASE WHEN count({col}) OVER {_w(n)} >= {n} AND max({col}) OVER {_w(n)} > min({col}) OVER {_w(n)} THEN stddev_samp({col}) OVER {_w(n)} END"


LAG = "(PARTITION BY ticker ORDER BY ts)"
OWN = f"""{RESEARCH}, o1 AS (
      SELECT *, close - lag(close) OVER {LAG} AS mv, close / lag(close, 5) OVER {LAG} - 1 AS lag_ret_5, close / lag(close, 20) OVER {LAG} - 1 AS lag_ret_20,
             close / lag(close, 12) OVER {LAG} - 1 AS ret_12, coalesce((close - open) / nullif(high - low, 0), 0) AS body_to_range,
             coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0) AS upper_wick_ratio,
             coalesce((least(open, close) - low) / nullif(high - low, 0), 0) AS lower_wick_ratio,
             (close - {_full('min', 'low', 3)}) / nullif({_full('max', 'high', 3)} - {_full('min', 'low', 3)}, 0) AS close_location_3,
             {_full('avg', 'close', 12)} - {_full('avg', 'close', 26)} AS macd, volume / {_full('avg', 'volume', 20)} AS relative_volume_time,
             (high - low) / close AS rg, row_number() OVER {LAG}::DOUBLE AS i, {_std('lag_ret_1', 20)} AS realvol20, {_std('lag_ret_1', 3)} AS vol3
      FROM research),
    own_f AS (
      SELECT *, CASE WHEN count(*) OVER {_w(20)} = 20 THEN regr_slope(close, i) OVER {_w(20)} END / close AS trend_slope,
             CASE WHEN count(mv) OVER {_w(14)} = 14 THEN 100 * sum(greatest(mv, 0)) OVER {_w(14)} / nullif(sum(abs(mv)) OVER {_w(14)}, 0) END AS rsi14,
             (macd - {_full('avg', 'macd', 20)}) / {_std('macd', 20)} AS macd_z, ln(realvol20) AS realvol20_log,
             realvol20 / {_full('avg', 'realvol20', 60, 20)} - 1 AS vol_regime,
             CASE WHEN count(lag_ret_1) OVER {_w(5)} = 5 THEN (avg(pow(lag_ret_1, 3)) OVER {_w(5)} - 3 * avg(lag_ret_1) OVER {_w(5)} * avg(pow(lag_ret_1, 2)) OVER {_w(5)}
               + 2 * pow(avg(lag_ret_1) OVER {_w(5)}, 3)) / pow(var_pop(lag_ret_1) OVER {_w(5)}, 1.5) END AS ret_skew_5,
             coalesce(trend_30 > 0 AND sign_persistence_5 > 0, false)::INT AS regime_bull, coalesce(trend_30 < 0 AND sign_persistence_5 < 0, false)::INT AS regime_bear,
             ret_3 AS multi_scale_ret_3h, ret_6 AS multi_scale_ret_6h, ret_12 AS multi_scale_ret_12h, ret_3 - ret_12 AS multi_scale_trend_gap, (sign(ret_3) + sign(ret_6) + sign(ret_12)) / 3 AS multi_scale_momentum_alignment, vol3 / realvol20 AS multi_scale_vol_ratio_3v20,
             {_full('avg', 'rg', 3)} / {_full('avg', 'rg', 12)} AS multi_scale_range_compression_3v12, {_full('avg', 'body_to_range', 3)} AS multi_scale_body_pressure_3,
             {_full('avg', 'breakout_3bar', 3)} AS multi_scale_breakout_pressure_3
      FROM o1)"""


def _query(name: str, columns: str, frame):
    spec = "ticker:s ts:d " + " ".join(f"{c}:f" for c in columns.split())

    @query(name, spec, f"WITH {OWN} SELECT * FROM own_f")
    def _(t):
        return frame(t)


def _own(t):
    return it.own_features(fx.bars(t))


_query("n1_trend_momentum", "lag_ret_1 lag_ret_5 lag_ret_20 trend_30 trend_2h trend_slope rsi14 macd_z", _own)
_query("n2_volatility_risk", "atr20_log realvol20_log vol_regime", _own)
_query("n5_candle_shape", "body_to_range upper_wick_ratio lower_wick_ratio close_location_3 ret_skew_5", _own)
_query("n6_persistence_breakout", "breakout_3bar sign_persistence_5 regime_bull regime_bear", _own)
_query(
    "n10_multi_scale",
    "multi_scale_ret_3h multi_scale_ret_6h multi_scale_ret_12h multi_scale_trend_gap multi_scale_momentum_alignment multi_scale_vol_ratio_3v20 multi_scale_range_compression_3v12 multi_scale_body_pressure_3 multi_scale_breakout_pressure_3",
    _own,
)

STATE = f"""{OWN}, m1 AS (SELECT ts, avg(lag_ret_1) AS m FROM own_f GROUP BY 1),
    m2 AS (SELECT *, CASE WHEN count(m) OVER w = 20 THEN sum(m) OVER w END AS market_state_trend_score, CASE WHEN count(m) OVER w = 20 THEN stddev_samp(m) OVER w END AS vol
           FROM m1 WINDOW w AS (ORDER BY ts ROWS 19 PRECEDING)),
    m3 AS (SELECT *, list(vol) FILTER (vol IS NOT NULL) OVER (ORDER BY ts ROWS 59 PRECEDING) AS past FROM m2),
    state AS (SELECT ts, market_state_trend_score, vol / nullif(CASE WHEN count(vol) OVER w60 >= 20 THEN avg(vol) OVER w60 END, 0) - 1 AS market_state_vol_pressure, CASE WHEN vol IS NOT NULL THEN len(list_filter(past, lambda x: x <= vol)) / len(past) END AS mkt_vol_rank FROM m3
              WINDOW w60 AS (ORDER BY ts ROWS 59 PRECEDING))"""


@query(
    "n9_market_state",
    "ts:d market_state_trend_score:f market_state_vol_pressure:f mkt_vol_rank:f market_state_bull_calm:f market_state_bull_stress:f market_state_bear_calm:f market_state_bear_stress:f market_state_transition:f",
    f"""WITH {STATE} SELECT *, coalesce(market_state_trend_score > 0 AND mkt_vol_rank < 0.5, false)::INT AS market_state_bull_calm,
        coalesce(market_state_trend_score > 0 AND mkt_vol_rank >= 0.5, false)::INT AS market_state_bull_stress, coalesce(market_state_trend_score <= 0 AND mkt_vol_rank < 0.5, false)::INT AS market_state_bear_calm,
        coalesce(market_state_trend_score <= 0 AND mkt_vol_rank >= 0.5, false)::INT AS market_state_bear_stress, coalesce(abs(market_state_trend_score) < 0.01, false)::INT AS market_state_transition FROM state""",
)
def _(t):
    return it.market_state(_own(t))


RELATED = f"""{OWN}, {fx.SECTORS}, tagged AS (SELECT own_f.*, sector FROM own_f LEFT JOIN sectors USING (ticker)),
    sec AS (SELECT ts, sector, avg(ret_3) AS s3 FROM tagged GROUP BY 1, 2),
    related AS (
      SELECT t.*, s3 - mkt_ret_3 AS sector_minus_mkt_3, ret_3 - s3 AS sector_residual_3, (ret_3 - s3) / realvol20 AS voladj_sector_residual_3,
             stock_minus_mkt_3 - (s3 - mkt_ret_3) AS xs_commonality_residual_3, stock_minus_mkt_1 / realvol20 AS voladj_stock_minus_mkt_1,
             stock_minus_mkt_3 / realvol20 AS voladj_stock_minus_mkt_3
      FROM tagged t LEFT JOIN sec USING (ts, sector))"""


def _related(t):
    return it.sector_relative(_own(t), fx.sectors(t))


@query(
    "n3_relative_returns",
    "ticker:s ts:d mkt_ret_1:f mkt_ret_3:f mkt_ret_6:f stock_minus_mkt_1:f stock_minus_mkt_3:f sector_minus_mkt_3:f",
    f"WITH {RELATED} SELECT * FROM related",
)
def _(t):
    return _related(t)


@query(
    "n15_sector_residuals",
    "ticker:s ts:d sector_residual_3:f voladj_sector_residual_3:f xs_commonality_residual_3:f voladj_stock_minus_mkt_1:f voladj_stock_minus_mkt_3:f",
    f"WITH {RELATED} SELECT * FROM related",
)
def _(t):
    return _related(t)


RANK_ON = list(it.RANKED)


def _rank_sql(c: str) -> str:
    # values are rounded first: two engines may differ in the last bit of a residual
    return (
        f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY ts, {c} IS NULL ORDER BY round({c}, 9)) + (count(*) OVER (PARTITION BY ts, round({c}, 9)) - 1) / 2) "
        f"/ count({c}) OVER (PARTITION BY ts) END AS xs_rank_{c}"
    )


RANKS = f"{RELATED}, ranks AS (SELECT *, {', '.join(_rank_sql(c) for c in RANK_ON)} FROM related)"


def _ranked(t):
    own = it.own_features(fx.bars(t), keep=["relative_volume_time", "realvol20"])
    frame = it.sector_relative(own, fx.sectors(t)).select("ticker", "ts", *[F.round(c, 9).alias(c) for c in RANK_ON])
    # tickers per date cannot exceed the supplier table
    return it.cross_ranks(frame, RANK_ON, shape=UNKNOWN)


@query(
    "n7_cross_sectional_ranks",
    "ticker:s ts:d " + " ".join(f"xs_rank_{c}:f" for c in RANK_ON),
    f"WITH {RANKS} SELECT * FROM ranks",
)
def _(t):
    return _ranked(t)


R3 = "xs_rank_stock_minus_mkt_3"


@query(
    "n8_leadership_persistence",
    "ticker:s ts:d xs_leader_top20:f xs_laggard_bottom20:f xs_leader_persist_3:f xs_leader_persist_6:f xs_laggard_persist_3:f xs_laggard_persist_6:f "
    "xs_rank_change_3:f xs_leader_spread_3:f xs_volume_leader_spread:f",
    f"""WITH {RANKS}, l AS (SELECT *, coalesce({R3} >= 0.8, false)::INT AS xs_leader_top20, coalesce({R3} <= 0.2, false)::INT AS xs_laggard_bottom20 FROM ranks)
        SELECT *, {_full('avg', 'xs_leader_top20', 3)} AS xs_leader_persist_3, {_full('avg', 'xs_leader_top20', 6)} AS xs_leader_persist_6,
        {_full('avg', 'xs_laggard_bottom20', 3)} AS xs_laggard_persist_3, {_full('avg', 'xs_laggard_bottom20', 6)} AS xs_laggard_persist_6,
        xs_rank_relative_volume_time - 0.5 AS xs_volume_leader_spread, {R3} - lag({R3}, 3) OVER {LAG} AS xs_rank_change_3, {R3} - 0.5 AS xs_leader_spread_3 FROM l""",
)
def _(t):
    return it.leadership(_ranked(t), R3).select("*", it.volume_leader_spread())


@query(
    "n15_residual_leadership",
    "ticker:s ts:d xs_rank_sector_residual_3:f xs_idiosyncratic_leader_3:f xs_idiosyncratic_laggard_3:f residual_leader_persist_3:f residual_laggard_persist_3:f",
    f"""WITH {RANKS}, l AS (SELECT *, coalesce(xs_rank_sector_residual_3 >= 0.8, false)::INT AS xs_idiosyncratic_leader_3,
          coalesce(xs_rank_sector_residual_3 <= 0.2, false)::INT AS xs_idiosyncratic_laggard_3 FROM ranks)
        SELECT *, {_full('avg', 'xs_idiosyncratic_leader_3', 3)} AS residual_leader_persist_3, {_full('avg', 'xs_idiosyncratic_laggard_3', 3)} AS residual_laggard_persist_3 FROM l""",
)
def _(t):
    return it.residual_leadership(_ranked(t))


@query(
    "n12_breadth_context",
    "ts:d breadth_adv_frac_1:f breadth_rel_adv_frac_3:f breadth_leader_frac:f breadth_laggard_frac:f breadth_trend_pressure:f breadth_dispersion_3:f "
    "breadth_volume_pressure:f breadth_participation:f breadth_leader_spread:f breadth_expansion_3:f",
    f"""WITH {OWN}, b AS (SELECT ts, avg(CASE WHEN lag_ret_1 > 0 THEN 1.0::DOUBLE ELSE 0 END) AS breadth_adv_frac_1, avg(CASE WHEN stock_minus_mkt_3 > 0 THEN 1.0::DOUBLE ELSE 0 END) AS breadth_rel_adv_frac_3,
          avg(CASE WHEN ret_3 > 0.05 THEN 1.0::DOUBLE ELSE 0 END) AS breadth_leader_frac, avg(CASE WHEN ret_3 < -0.05 THEN 1.0::DOUBLE ELSE 0 END) AS breadth_laggard_frac,
          avg(sign(trend_30)) AS breadth_trend_pressure, stddev_samp(ret_3) AS breadth_dispersion_3, sum(volume * sign(coalesce(lag_ret_1, 0))) / sum(volume) AS breadth_volume_pressure,
          avg(CASE WHEN relative_volume_time > 1 THEN 1.0::DOUBLE ELSE 0 END) AS breadth_participation FROM own_f GROUP BY 1)
        SELECT *, breadth_leader_frac - breadth_laggard_frac AS breadth_leader_spread, breadth_adv_frac_1 - lag(breadth_adv_frac_1, 3) OVER (ORDER BY ts) AS breadth_expansion_3 FROM b""",
)
def _(t):
    return it.breadth_context(_own(t))


@query(
    "n4_session_context",
    "ticker:s ts:t vwap_dist:f session_open_dist_atr:f opening_range_breakout:f time_since_new_high:f time_since_new_low:f intraday_vol_percentile:f minute_norm:f",
    f"""WITH {fx.QUARTER_BARS}, s AS (SELECT *, CAST(ts AS DATE) AS d FROM quarter_bars),
        p AS (SELECT *, row_number() OVER w AS i, list(high - low) OVER r AS rs, sum((high + low + close) / 3 * volume) OVER r / nullif(sum(volume) OVER r, 0) AS vw,
              first_value(open) OVER r AS o, avg(high - low) OVER r AS atr, arg_max(ts, row(high, ts)) OVER r AS ha, arg_max(ts, row(-low, ts)) OVER r AS la
              FROM s WINDOW w AS (PARTITION BY ticker, d ORDER BY ts), r AS (PARTITION BY ticker, d ORDER BY ts ROWS UNBOUNDED PRECEDING)),
        q AS (SELECT *, max(CASE WHEN i <= 2 THEN high END) OVER r AS oh, min(CASE WHEN i <= 2 THEN low END) OVER r AS ol FROM p
              WINDOW r AS (PARTITION BY ticker, d ORDER BY ts ROWS UNBOUNDED PRECEDING))
        SELECT ticker, ts, close / vw - 1 AS vwap_dist, (close - o) / nullif(atr, 0) AS session_open_dist_atr,
          CASE WHEN i > 2 AND close > oh THEN 1 WHEN i > 2 AND close < ol THEN -1 ELSE 0 END AS opening_range_breakout,
          date_diff('microsecond', ha, ts) / 6e7 AS time_since_new_high, date_diff('microsecond', la, ts) / 6e7 AS time_since_new_low, len(list_filter(rs, lambda x: x <= high - low)) / len(rs) AS intraday_vol_percentile,
          least(i / 96, 1) AS minute_norm FROM q""",
)
def _(t):
    # a session of the tick stream lasts the whole day
    return it.session_context(fx.quarter_bars(t), session_bars=96)


@query(
    "n14_previous_session",
    "ticker:s ts:t prev_session_gap_atr:f prev_session_ret:f prev_session_range_atr:f prev_session_close_location:f prev_session_body_to_range:f prev_session_volume_rel:f",
    f"""WITH {fx.QUARTER_BARS}, d AS (SELECT ticker, CAST(ts AS DATE) AS d, arg_min(open, ts) AS o, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c, sum(volume) AS v FROM quarter_bars GROUP BY 1, 2),
        e AS (SELECT *, c / lag(c) OVER w - 1 AS ret, avg(h - l) OVER w5 AS atr, v / avg(v) OVER w5 AS vr, (c - l) / nullif(h - l, 0) AS loc, (c - o) / nullif(h - l, 0) AS body
              FROM d WINDOW w AS (PARTITION BY ticker ORDER BY d), w5 AS (PARTITION BY ticker ORDER BY d ROWS 4 PRECEDING)),
        f AS (SELECT ticker, d, (o - lag(c) OVER w) / nullif(lag(atr) OVER w, 0) AS prev_session_gap_atr, lag(ret) OVER w AS prev_session_ret, lag(h - l) OVER w / nullif(lag(atr) OVER w, 0) AS prev_session_range_atr,
              lag(loc) OVER w AS prev_session_close_location, lag(body) OVER w AS prev_session_body_to_range, lag(vr) OVER w AS prev_session_volume_rel FROM e WINDOW w AS (PARTITION BY ticker ORDER BY d))
        SELECT q.ticker, q.ts, f.* EXCLUDE (ticker, d) FROM quarter_bars q JOIN f ON f.ticker = q.ticker AND f.d = CAST(q.ts AS DATE)""",
)
def _(t):
    return it.previous_session(fx.quarter_bars(t))


@query(
    "n13_quarter_path",
    "ticker:s ts:t m15_ret_4:f m15_path_efficiency_4:f m15_positive_share_4:f m15_sign_flip_rate_4:f m15_time_imbalance_4:f m15_early_exhaustion_4:f "
    "m15_rejection_score_4:f m15_close_location_4:f m15_breakout_pressure_4:f m15_body_pressure_4:f m15_vol_ratio_2v8:f",
    f"""WITH {fx.QUARTER_BARS}, a AS (SELECT *, close / lag(close) OVER {LAG} - 1 AS r, close / lag(close, 4) OVER {LAG} - 1 AS m15_ret_4, close / lag(close, 2) OVER {LAG} - 1 AS late,
          coalesce((close - open) / nullif(high - low, 0), 0) AS body FROM quarter_bars),
        b AS (SELECT *, coalesce((sign(r) <> sign(lag(r) OVER {LAG}))::INT, 0) AS flip, count(r) OVER {_w(4)} = 4 AS ok, max(high) OVER {_w(4)} AS hi, min(low) OVER {_w(4)} AS lo,
              CASE WHEN count(high) OVER p = 4 THEN max(high) OVER p END AS ph, 2 * late - m15_ret_4 AS m15_time_imbalance_4 FROM a
              WINDOW p AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
        SELECT *, CASE WHEN ok THEN abs(m15_ret_4) / nullif(sum(abs(r)) OVER {_w(4)}, 0) END AS m15_path_efficiency_4,
          CASE WHEN ok THEN avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER {_w(4)} END AS m15_positive_share_4, {_full('avg', 'flip', 3)} AS m15_sign_flip_rate_4,
          coalesce(greatest(-m15_time_imbalance_4, 0), 0) AS m15_early_exhaustion_4, CASE WHEN ok THEN (hi - close) / nullif(hi - lo, 0) END AS m15_rejection_score_4,
          CASE WHEN ok THEN (close - lo) / nullif(hi - lo, 0) END AS m15_close_location_4, (close - ph) / close AS m15_breakout_pressure_4, {_full('avg', 'body', 4)} AS m15_body_pressure_4,
          {_full('avg', 'volume', 2)} / nullif({_full('avg', 'volume', 8)}, 0) AS m15_vol_ratio_2v8 FROM b""",
)
def _(t):
    return it.quarter_path(fx.quarter_bars(t))


@query(
    "n11_hour_path",
    "ticker:s hour:t bars:i stf15_intrahour_ret:f stf15_path_efficiency:f stf15_positive_share:f stf15_negative_share:f stf15_first_half_ret:f stf15_second_half_ret:f "
    "stf15_time_imbalance:f stf15_range_to_open:f stf15_close_location:f stf15_max_adverse_excursion:f stf15_body_pressure:f stf15_vol_burst_ratio:f stf15_last_quarter_ret:f "
    "stf15_sign_flip_rate:f stf15_high_before_low:f stf15_low_before_high:f stf15_first_half_share:f stf15_late_strength_share:f stf15_vol_burst:f stf15_wick_pressure:f "
    "stf15_breakout_pressure:f stf15_failed_breakout_score:f stf15_rejection_score:f stf15_early_vol:f stf15_late_vol:f stf15_late_vol_ratio:f stf15_last_quarter_share:f "
    "stf15_early_exhaustion_score:f stf15_close_quarter_dominance:f stf15_rel_volume_mean:f5",
    f"""WITH {fx.QUARTER_BARS}, h AS (SELECT *, date_trunc('hour', ts) AS hour, row_number() OVER w AS i, count(*) OVER (PARTITION BY ticker, date_trunc('hour', ts)) AS n,
          lag(high) OVER w AS ph, lag(low) OVER w AS pl, close / coalesce(lag(close) OVER w, open) - 1 AS mv FROM quarter_bars WINDOW w AS (PARTITION BY ticker, date_trunc('hour', ts) ORDER BY ts)),
        f AS (SELECT *, lag(mv) OVER (PARTITION BY ticker, hour ORDER BY ts) AS pmv FROM h),
        g AS (SELECT ticker, hour, count(*) AS n, count(*) FILTER (sign(mv) <> sign(pmv)) AS flips, sum(CASE WHEN i <= greatest(n // 2, 1) THEN abs(mv) ELSE 0 END) AS p1,
              arg_min(i, row(-high, ts)) AS hx, arg_min(i, row(low, ts)) AS lx, avg(coalesce((least(open, close) - low - high + greatest(open, close)) / nullif(high - low, 0), 0)) AS stf15_wick_pressure,
              count(*) FILTER (close > ph) - count(*) FILTER (close < pl) AS broken, count(*) FILTER (high > ph AND close <= ph) + count(*) FILTER (low < pl AND close >= pl) AS failed,
              max(abs(close / open - 1)) AS big, max(volume) / nullif(sum(volume), 0) AS stf15_vol_burst, avg(volume) AS vm, arg_min(open, ts) AS o, arg_max(close, ts) AS c, max(close) FILTER (i = greatest(n // 2, 1)) AS m, max(high) AS hi, min(low) AS lo,
              sum(abs(mv)) AS path, count(*) FILTER (mv > 0) AS up, count(*) FILTER (mv < 0) AS dn, avg(coalesce((close - open) / nullif(high - low, 0), 0)) AS stf15_body_pressure,
              max(volume) * count(*) / nullif(sum(volume), 0) AS stf15_vol_burst_ratio, arg_max(close / open - 1, ts) AS stf15_last_quarter_ret FROM f GROUP BY 1, 2)
        SELECT *, n AS bars, c / o - 1 AS stf15_intrahour_ret, coalesce(abs(c / o - 1) / nullif(path, 0), 0) AS stf15_path_efficiency, up / n AS stf15_positive_share, dn / n AS stf15_negative_share,
          m / o - 1 AS stf15_first_half_ret, c / m - 1 AS stf15_second_half_ret, c / m - m / o AS stf15_time_imbalance, (hi - lo) / o AS stf15_range_to_open,
          coalesce((c - lo) / nullif(hi - lo, 0), 0.5) AS stf15_close_location, lo / o - 1 AS stf15_max_adverse_excursion,
          flips / greatest(n - 1, 1) AS stf15_sign_flip_rate, (hx < lx)::INT AS stf15_high_before_low, (lx < hx)::INT AS stf15_low_before_high,
          coalesce(abs(m / o - 1) / nullif(abs(m / o - 1) + abs(c / m - 1), 0), 0.5) AS stf15_first_half_share,
          coalesce(greatest(c / m - 1, 0) / nullif(abs(m / o - 1) + abs(c / m - 1), 0), 0) AS stf15_late_strength_share,
          broken / n AS stf15_breakout_pressure, failed / n AS stf15_failed_breakout_score, coalesce((hi - c) / nullif(hi - lo, 0), 0.5) AS stf15_rejection_score,
          p1 AS stf15_early_vol, path - p1 AS stf15_late_vol, (path - p1) / nullif(p1, 0) AS stf15_late_vol_ratio,
          coalesce(stf15_last_quarter_ret / nullif(path, 0), 0) AS stf15_last_quarter_share, greatest(-sign(m / o - 1) * (c / m - 1), 0) AS stf15_early_exhaustion_score,
          coalesce(abs(stf15_last_quarter_ret) / nullif(big, 0), 0) AS stf15_close_quarter_dominance,
          vm / avg(vm) OVER (PARTITION BY ticker ORDER BY hour ROWS 7 PRECEDING) AS stf15_rel_volume_mean FROM g""",
)
def _(t):
    return it.hour_path(fx.quarter_bars(t))


@query(
    "n16_family_projection",
    "ticker:s ts:d atr20_log:f lag_ret_1:f lag_ret_20:f lag_ret_5:f macd_z:f realvol20_log:f rsi14:f trend_2h:f trend_30:f trend_slope:f vol_regime:f",
    f"WITH {OWN} SELECT * FROM own_f",
)
def _(t):
    from tickloom.operators.cleaning import select_families

    return select_families(_own(t), it.FAMILIES, ["F1_TrendMomentum", "F2_VolRisk"], ["ticker", "ts"])


COMPOSITE = sorted(it.FAMILIES["F11_PortfolioRankContext"])


@query(
    "n16_composite_family",
    "ticker:s ts:d " + " ".join(f"{c}:f" for c in COMPOSITE),
    f"""WITH {RANKS}, l AS (SELECT *, coalesce({R3} >= 0.8, false)::INT AS led, coalesce({R3} <= 0.2, false)::INT AS lagged FROM ranks)
        SELECT *, {_full('avg', 'led', 3)} AS xs_leader_persist_3, {_full('avg', 'led', 6)} AS xs_leader_persist_6, {_full('avg', 'lagged', 3)} AS xs_laggard_persist_3,
        {_full('avg', 'lagged', 6)} AS xs_laggard_persist_6, xs_rank_relative_volume_time - 0.5 AS xs_volume_leader_spread, {R3} - lag({R3}, 3) OVER {LAG} AS xs_rank_change_3,
        {R3} - 0.5 AS xs_leader_spread_3 FROM l""",
)
def _(t):
    from tickloom.operators.cleaning import select_families

    led = it.leadership(_ranked(t), R3).select("*", it.volume_leader_spread())
    return select_families(led, it.FAMILIES, ["F11_PortfolioRankContext"], ["ticker", "ts"])
