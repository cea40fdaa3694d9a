"""Intraday and cross-sectional feature families. Names follow the families; the formulas are this library's own."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tickloom.functions import rolling as R
from tickloom.functions.layout import DAILY, TASK_ROWS, UNKNOWN, Shape, avg_rank, over_series
from tickloom.functions.session import stored
from tickloom.operators.research import relative_to_market, ticker_columns

#: 96 quarter-hour bars a day for a generation
INTRADAY = Shape(series_rows=1_200_000)

# fixed values: families of feature names
_CANDLE = ["body_to_range", "upper_wick_ratio", "lower_wick_ratio"]
_PERSISTENCE = ["breakout_3bar", "sign_persistence_5"]
_SESSION = ["vwap_dist", "session_open_dist_atr", "opening_range_breakout", "time_since_new_high", "time_since_new_low",
            "intraday_vol_percentile", "relative_volume_time", "minute_norm"]
_PHASE = ["minute_norm", "relative_volume_time", "intraday_vol_percentile", "vwap_dist", "session_open_dist_atr"]
_RANKS = [f"xs_rank_{c}" for c in ("stock_minus_mkt_1", "stock_minus_mkt_3", "stock_minus_mkt_6", "sector_minus_mkt_3", "relative_volume_time",
                                   "voladj_stock_minus_mkt_1", "voladj_stock_minus_mkt_3")] + ["xs_leader_spread_3"]
_PERSIST = ["xs_leader_persist_3", "xs_laggard_persist_3", "xs_leader_persist_6", "xs_laggard_persist_6", "xs_rank_change_3"]
_FAILED = [f"m15_{c}" for c in ("rejection_score_4", "close_location_4", "breakout_pressure_4", "body_pressure_4", "sign_flip_rate_4",
                                "time_imbalance_4", "early_exhaustion_4", "vol_ratio_2v8")]
_PATH = ["m15_ret_4", "m15_path_efficiency_4", "m15_positive_share_4", *_FAILED]
_PORTFOLIO = [*_RANKS, "xs_volume_leader_spread", *_PERSIST]


def _hour(*names: str) -> list[str]:
    return [f"stf15_{n}" for n in names]


FAMILIES = {
    "F1_TrendMomentum": ["lag_ret_1", "lag_ret_5", "lag_ret_20", "trend_30", "trend_2h", "trend_slope", "rsi14", "macd_z"],
    "F2_VolRisk": ["atr20_log", "realvol20_log", "vol_regime", "mkt_vol_rank"],
    "F3_Relative": ["mkt_ret_1", "mkt_ret_3", "mkt_ret_6", "stock_minus_mkt_1", "stock_minus_mkt_3", "sector_minus_mkt_3"],
    "F4_SessionContext": _SESSION,
    "F5_CandleShape": [*_CANDLE, "close_location_3", "ret_skew_5"],
    "F6_PersistenceBreakout": [*_PERSISTENCE, "regime_bull", "regime_bear"],
    "F7_CrossSectionalRanks": _RANKS,
    "F8_LeadershipPersistence": ["xs_leader_top20", "xs_laggard_bottom20", *_PERSIST, "xs_volume_leader_spread"],
    "F9_MarketStateLabels": [f"market_state_{c}" for c in ("bull_calm", "bull_stress", "bear_calm", "bear_stress", "transition", "trend_score", "vol_pressure")],
    "F10_MultiScaleContext": [f"multi_scale_{c}" for c in ("ret_3h", "ret_6h", "ret_12h", "trend_gap", "momentum_alignment", "vol_ratio_3v20",
                                                           "range_compression_3v12", "body_pressure_3", "breakout_pressure_3")],
    "F11_PortfolioRankContext": _PORTFOLIO,
    "F12_SecondTimeframeContext": _hour("intrahour_ret", "path_efficiency", "first_half_ret", "second_half_ret", "first_half_share", "vol_burst", "vol_burst_ratio",
                                        "range_to_open", "failed_breakout_score", "close_location", "rel_volume_mean", "wick_pressure", "body_pressure",
                                        "breakout_pressure"),
    "F13_IntrahourPathV1": _hour("path_efficiency", "positive_share", "negative_share", "sign_flip_rate", "first_half_ret", "second_half_ret",
                                 "late_strength_share", "max_adverse_excursion", "high_before_low", "low_before_high", "rejection_score",
                                 "failed_breakout_score"),
    "F14_BreadthContext": [f"breadth_{c}" for c in ("adv_frac_1", "rel_adv_frac_3", "leader_frac", "laggard_frac", "trend_pressure", "leader_spread",
                                                    "dispersion_3", "volume_pressure", "expansion_3", "participation")],
    "F15_TimeDistributionV2": _hour("first_half_ret", "second_half_ret", "first_half_share", "late_strength_share", "time_imbalance", "early_vol", "late_vol",
                                    "late_vol_ratio", "last_quarter_ret", "last_quarter_share", "early_exhaustion_score", "close_quarter_dominance"),
    "F16_Native15mPath": _PATH,
    "F17_Native15mFailedBreakout": _FAILED,
    "F18_Native15mOpenDrive": [*_SESSION, *_CANDLE, *_PERSISTENCE],
    "F19_Native15mSessionPhase": [*_PHASE, *_CANDLE, "m15_time_imbalance_4", "m15_early_exhaustion_4", "m15_rejection_score_4", "m15_close_location_4",
                                  *_PERSISTENCE],
    "F20_Native15mHoldingHorizon": [*_PATH, *_PHASE],
    "F21_Native15mTopKEventRank": [*_PORTFOLIO, *_PHASE, "body_to_range", "close_location_3", "breakout_3bar"],
    "F22_Native15mMeanReversionExhaustion": [*_PHASE, *_CANDLE, "close_location_3", *[c for c in _PATH if c != "m15_positive_share_4"]],
    "F23_DailyContext": [f"prev_session_{c}" for c in ("gap_atr", "ret", "range_atr", "close_location", "body_to_range", "volume_rel")],
    "F24_CrossSectionalCommonalityResidual": [
        "sector_residual_3", "voladj_sector_residual_3", "xs_rank_sector_residual_3", "xs_commonality_residual_3", "xs_idiosyncratic_leader_3",
        "xs_idiosyncratic_laggard_3", "residual_leader_persist_3", "residual_laggard_persist_3", "xs_rank_stock_minus_mkt_1", "xs_rank_stock_minus_mkt_3",
        "xs_rank_sector_minus_mkt_3", "xs_rank_voladj_stock_minus_mkt_3", "xs_rank_relative_volume_time", "breadth_trend_pressure", "breadth_leader_spread",
        "breadth_volume_pressure", "mkt_vol_rank",
    ],
    "F25_IntradayVolumeLiquidityForecast": [
        "intraday_vol_percentile", "relative_volume_time", "mkt_vol_rank", "minute_norm", "breadth_participation", "breadth_volume_pressure",
        "breadth_leader_spread", *_hour("rel_volume_mean", "vol_burst", "vol_burst_ratio", "path_efficiency", "breakout_pressure"),
    ],
}


def rolling_rsi(move: Column, w, rows: int = 14) -> Column:
    """Relative strength on plain sums of gains and losses of a one-row ``move``; null for a flat window."""
    gain = R.total(F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))), w, rows)
    swing = R.total(F.abs(move), w, rows)
    return 100.0 * R.ratio(gain, swing)


def _moment_skew(x: Column, w, rows: int) -> Column:
    f = R.frame(w, rows)
    flat = F.max(x).over(f) == F.min(x).over(f)
    return F.when((F.count(x).over(f) == rows) & ~flat, F.skewness(x).over(f))


def own_features(bars: DataFrame, shape: Shape = DAILY, keep: Sequence[str] | None = None) -> DataFrame:
    """Trend, volatility, candle shape, persistence and multi-scale columns of each ticker: one exchange.

    Who reads the panel more than once names the ticker columns to ``keep``: they are written once, besides the returns, and bars
    are not built again for the market's returns.
    """
    c, o, h, l, v = (F.col(x) for x in ("close", "open", "high", "low", "volume"))

    def first(df, w):
        span = h - l
        return df.select(
            "*",
            (c - F.lag(c).over(w)).alias("_move"),
            *[R.change(c, w, n).alias(f"lag_ret_{n}") for n in (5, 20)],
            R.change(c, w, 12).alias("ret_12"),
            F.coalesce(R.ratio(c - o, span), F.lit(0.0)).alias("body_to_range"),
            F.coalesce(R.ratio(h - F.greatest(o, c), span), F.lit(0.0)).alias("upper_wick_ratio"),
            F.coalesce(R.ratio(F.least(o, c) - l, span), F.lit(0.0)).alias("lower_wick_ratio"),
            R.ratio(c - R.lowest(l, w, 3), R.highest(h, w, 3) - R.lowest(l, w, 3)).alias("close_location_3"),
            (R.mean(c, w, 12) - R.mean(c, w, 26)).alias("_macd"),
            R.ratio(v, R.mean(v, w, 20)).alias("relative_volume_time"),
            R.ratio(span, c).alias("_range"),
            F.row_number().over(w).cast("double").alias("_i"),
            R.spread(F.col("lag_ret_1"), w, 20).alias("realvol20"),
            R.spread(F.col("lag_ret_1"), w, 3).alias("_vol3"),
        )

    def second(df, w):
        f20 = R.frame(w, 20)
        slope = F.when(F.count(c).over(f20) == 20, F.regr_slope(c, F.col("_i")).over(f20))
        return df.select(
            "*",
            (slope / c).alias("trend_slope"),
            rolling_rsi(F.col("_move"), w).alias("rsi14"),
            R.zscore(F.col("_macd"), w, 20).alias("macd_z"),
            F.ln("realvol20").alias("realvol20_log"),
            (R.ratio(F.col("realvol20"), R.mean(F.col("realvol20"), w, 60, 20)) - 1.0).alias("vol_regime"),
            _moment_skew(F.col("lag_ret_1"), w, 5).alias("ret_skew_5"),
            R.holds((F.col("trend_30") > 0) & (F.col("sign_persistence_5") > 0)).cast("double").alias("regime_bull"),
            R.holds((F.col("trend_30") < 0) & (F.col("sign_persistence_5") < 0)).cast("double").alias("regime_bear"),
            *[F.col(f"ret_{n}").alias(f"multi_scale_ret_{n}h") for n in (3, 6, 12)],
            (F.col("ret_3") - F.col("ret_12")).alias("multi_scale_trend_gap"),
            ((F.signum("ret_3") + F.signum("ret_6") + F.signum("ret_12")) / 3.0).alias("multi_scale_momentum_alignment"),
            R.ratio(F.col("_vol3"), F.col("realvol20")).alias("multi_scale_vol_ratio_3v20"),
            R.ratio(R.mean(F.col("_range"), w, 3), R.mean(F.col("_range"), w, 12)).alias("multi_scale_range_compression_3v12"),
            R.mean(F.col("body_to_range"), w, 3).alias("multi_scale_body_pressure_3"),
            R.mean(F.col("breakout_3bar"), w, 3).alias("multi_scale_breakout_pressure_3"),
        ).drop("_move", "_macd", "_i", "_range", "_vol3")

    own = over_series(over_series(ticker_columns(bars, shape), first, before=46, shape=shape), second, before=60, shape=shape)
    if keep is not None:
        own = stored(own.select("ticker", "ts", *sorted({"lag_ret_1", "ret_3", "ret_6", *keep})), "own")
    return relative_to_market(own, shape)


def market_state(panel: DataFrame, time: str = "ts") -> DataFrame:
    """Trend and volatility of the equal-weight market and the state they imply; one row per timestamp."""
    by_time = panel.groupBy(time).agg(F.avg("lag_ret_1").alias("_m"))
    w = Window.orderBy(time)
    vol = by_time.withColumn("_vol", R.spread(F.col("_m"), w, 20))
    past = F.collect_list("_vol").over(w.rowsBetween(-59, 0))
    ranked = vol.select(
        time, R.total(F.col("_m"), w, 20).alias("market_state_trend_score"), "_vol", past.alias("_past"),
        (R.ratio(F.col("_vol"), R.mean(F.col("_vol"), w, 60, 20)) - 1.0).alias("market_state_vol_pressure"),
    ).withColumn(
        "mkt_vol_rank",
        F.when(F.col("_vol").isNotNull(), F.size(F.filter("_past", lambda x: x <= F.col("_vol"))) / F.size("_past").cast("double")),
    )
    up, calm = F.col("market_state_trend_score") > 0, F.col("mkt_vol_rank") < 0.5
    turning = F.abs("market_state_trend_score") < 0.01

    def flag(condition):
        return R.holds(condition).cast("double")

    return ranked.select(
        time, "market_state_trend_score", "market_state_vol_pressure", "mkt_vol_rank",
        flag(up & calm).alias("market_state_bull_calm"), flag(up & ~calm).alias("market_state_bull_stress"),
        flag(~up & calm).alias("market_state_bear_calm"), flag(~up & ~calm).alias("market_state_bear_stress"), flag(turning).alias("market_state_transition"),
    )


def sector_relative(panel: DataFrame, sectors: DataFrame, time: str = "ts", shape: Shape = DAILY) -> DataFrame:
    """Sector mean against the market and stock against its sector; aggregates are combined map-side."""
    tagged = panel.join(sectors, "ticker", "left")
    means = tagged.groupBy(time, "sector").agg(F.avg("ret_3").alias("_sector_ret_3"))
    if shape.series_fits() and shape.series_rows <= DAILY.series_rows:
        means = F.broadcast(means)  # one row per calendar day and sector
    joined = tagged.join(means, [time, "sector"], "left")
    residual = F.col("ret_3") - F.col("_sector_ret_3")
    return joined.select(
        *tagged.columns,
        (F.col("_sector_ret_3") - F.col("mkt_ret_3")).alias("sector_minus_mkt_3"),
        residual.alias("sector_residual_3"),
        R.ratio(residual, F.col("realvol20")).alias("voladj_sector_residual_3"),
        (F.col("stock_minus_mkt_3") - (F.col("_sector_ret_3") - F.col("mkt_ret_3"))).alias("xs_commonality_residual_3"),
        R.ratio(F.col("stock_minus_mkt_1"), F.col("realvol20")).alias("voladj_stock_minus_mkt_1"),
        R.ratio(F.col("stock_minus_mkt_3"), F.col("realvol20")).alias("voladj_stock_minus_mkt_3"),
    )


def _percent_ranks(value: pa.ChunkedArray) -> pa.Array:
    """Average-tie rank over the number of known values; NaN is the largest value, unknown ones have no rank."""
    known = value.is_valid().to_numpy().astype(bool)
    x = value.to_numpy()[known].astype(float)
    order = np.argsort(x, kind="stable")
    x = x[order]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))
    starts = np.flatnonzero(first)
    same = np.diff(np.append(starts, len(x)))
    ranks, placed = np.zeros(len(known)), np.empty(len(x))
    placed[order] = np.repeat(starts + (same + 1) / 2.0, same) / max(len(x), 1)
    ranks[known] = placed
    return pa.array(ranks, mask=~known)


def _ranks_by_stamp(panel: DataFrame, features: Sequence[str], time: str, single: bool) -> DataFrame:
    """Percent ranks of timestamps that fit into a task: one exchange of the panel for all features.

    With ``single`` copies of a ticker and timestamp become one row, else rows without one of both have no ranks.
    """
    names = [f"xs_rank_{f}" for f in features]
    typed = panel.withColumns({f: F.col(f).cast("double") for f in features})
    shape = StructType([*typed.schema, *[StructType().add(n, DoubleType())[0] for n in names]])

    def rank(table: pa.Table) -> pa.Table:
        ranks = [_percent_ranks(table[f]) for f in features]
        if not single:
            placed = pc.and_(table["ticker"].is_valid(), table[time].is_valid())
            ranks = [pc.if_else(placed, r, pa.scalar(None, pa.float64())) for r in ranks]
        for n, r in zip(names, ranks, strict=True):
            table = table.append_column(n, r)
        if single and len(table["ticker"].unique()) < len(table):
            wide = table.group_by(["ticker", time]).aggregate([(c, "max") for c in [*features, *names]])
            table = wide.rename_columns([c.removesuffix("_max") for c in wide.column_names]).select(table.column_names)
        return table

    return typed.groupBy(time).applyInArrow(rank, shape)


def cross_ranks(panel: DataFrame, features: Sequence[str], time: str = "ts", shape: Shape = UNKNOWN) -> DataFrame:
    """Percent ranks by timestamp of several features in one pass: ``xs_rank_<feature>``.

    Where the largest timestamp, by proof or by count, fits into a task, all ranks share one exchange. Otherwise the features
    are stacked and ranked in place, by ranges of (timestamp, feature, value), so no task sorts a whole timestamp. A panel
    has one row for each ticker and timestamp.
    """
    others = [c for c in panel.columns if c not in ("ticker", time, *features)]
    if shape.stamp_fits() or (panel.groupBy(time).count().agg(F.max("count")).first()[0] or 0) <= TASK_ROWS:
        return _ranks_by_stamp(panel, features, time, single=not others)
    return _stacked_ranks(panel, features, time, shape, others)


def _stacked_ranks(panel: DataFrame, features: Sequence[str], time: str, shape: Shape, others: Sequence[str]) -> DataFrame:
    # every feature of a row is stacked, nulls too, so that the pivot has each row again
    items = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features)])
    if others:
        panel = stored(panel, "panel")
    long = panel.select("ticker", time, F.explode(items).alias("_x")).select("ticker", time, "_x.feature", "_x.value")
    ranks = avg_rank(long, "value", [time, "feature"], "_rank", pct=True, shape=shape)
    own = lambda i, c: F.max(F.when(F.col("feature") == i, F.col(c)))
    wide = ranks.groupBy("ticker", time).agg(
        *[own(i, "_rank").alias(f"xs_rank_{f}") for i, f in enumerate(features)], *[own(i, "value").alias(f) for i, f in enumerate(features) if not others]
    )
    return panel.join(wide, ["ticker", time], "left") if others else wide.select(*panel.columns, *[f"xs_rank_{f}" for f in features])


def leadership(ranked: DataFrame, rank: str, prefix: str = "xs", shape: Shape = DAILY) -> DataFrame:
    """Top and bottom 20 % flags, their persistence over 3 and 6 rows, and the change of rank."""

    def build(df, w):
        top = R.holds(F.col(rank) >= 0.8).cast("double")
        low = R.holds(F.col(rank) <= 0.2).cast("double")
        flagged = df.select("*", top.alias(f"{prefix}_leader_top20"), low.alias(f"{prefix}_laggard_bottom20"))
        return flagged.select(
            "*",
            *[R.mean(F.col(f"{prefix}_leader_top20"), w, n).alias(f"{prefix}_leader_persist_{n}") for n in (3, 6)],
            *[R.mean(F.col(f"{prefix}_laggard_bottom20"), w, n).alias(f"{prefix}_laggard_persist_{n}") for n in (3, 6)],
            (F.col(rank) - F.lag(rank, 3).over(w)).alias(f"{prefix}_rank_change_3"),
            (F.col(rank) - 0.5).alias(f"{prefix}_leader_spread_3"),
        )

    return over_series(ranked, build, before=6, shape=shape)


def residual_leadership(ranked: DataFrame, rank: str = "xs_rank_sector_residual_3", shape: Shape = DAILY) -> DataFrame:
    """Leaders and laggards by what their sector does not explain, and how long they stay so."""
    led = leadership(ranked, rank, "residual", shape)
    return led.select(
        *ranked.columns, F.col("residual_leader_top20").alias("xs_idiosyncratic_leader_3"), F.col("residual_laggard_bottom20").alias("xs_idiosyncratic_laggard_3"),
        "residual_leader_persist_3", "residual_laggard_persist_3",
    )


def volume_leader_spread(rank: str = "xs_rank_relative_volume_time") -> Column:
    return (F.col(rank) - 0.5).alias("xs_volume_leader_spread")


def breadth_context(panel: DataFrame, time: str = "ts") -> DataFrame:
    """Breadth of the cross-section by timestamp; one row each."""

    def share(condition):
        return F.avg(F.when(condition, 1.0).otherwise(0.0))

    signed = F.col("volume") * F.signum(F.coalesce("lag_ret_1", F.lit(0.0)))
    daily = panel.groupBy(time).agg(
        share(F.col("lag_ret_1") > 0).alias("breadth_adv_frac_1"),
        share(F.col("stock_minus_mkt_3") > 0).alias("breadth_rel_adv_frac_3"),
        share(F.col("ret_3") > 0.05).alias("breadth_leader_frac"),
        share(F.col("ret_3") < -0.05).alias("breadth_laggard_frac"),
        F.avg(F.signum("trend_30")).alias("breadth_trend_pressure"),
        F.stddev_samp("ret_3").alias("breadth_dispersion_3"),
        (F.sum(signed) / F.nullif(F.sum("volume"), F.lit(0.0))).alias("breadth_volume_pressure"),
        share(F.col("relative_volume_time") > 1).alias("breadth_participation"),
    )
    w = Window.orderBy(time)
    return daily.select(
        "*",
        (F.col("breadth_leader_frac") - F.col("breadth_laggard_frac")).alias("breadth_leader_spread"),
        (F.col("breadth_adv_frac_1") - F.lag("breadth_adv_frac_1", 3).over(w)).alias("breadth_expansion_3"),
    )


def session_context(bars: DataFrame, opening: int = 2, session_bars: int = 25) -> DataFrame:
    """Running context inside each (ticker, session): at most a day's bars per window.

    ``session_bars`` is the planned length of a session; the bars a session ends up with are not known while it runs.
    """
    day = F.to_date("ts").alias("session")
    w = Window.partitionBy("ticker", "session").orderBy("ts")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    c, v = F.col("close"), F.col("volume")
    typical = (F.col("high") + F.col("low") + c) / 3.0
    placed = bars.select("*", day).select(
        "*",
        F.row_number().over(w).alias("_i"),
        F.collect_list(F.col("high") - F.col("low")).over(sofar).alias("_ranges"),
        R.ratio(F.sum(typical * v).over(sofar), F.sum(v).over(sofar)).alias("_vwap"),
        F.first("open").over(sofar).alias("_open"),
        F.max("high").over(sofar).alias("_hi"),
        F.min("low").over(sofar).alias("_lo"),
        F.avg(F.col("high") - F.col("low")).over(sofar).alias("_atr"),
        F.max_by("ts", F.struct("high", F.unix_micros("ts"))).over(sofar).alias("_hi_at"),
        F.max_by("ts", F.struct(-F.col("low"), F.unix_micros("ts"))).over(sofar).alias("_lo_at"),
    )
    early = F.col("_i") <= opening
    ranged = placed.select(
        "*",
        F.max(F.when(early, F.col("high"))).over(sofar).alias("_or_hi"),
        F.min(F.when(early, F.col("low"))).over(sofar).alias("_or_lo"),
    )
    past = F.col("_i") > opening
    return ranged.select(
        "ticker", "ts", "session",
        (R.ratio(c, F.col("_vwap")) - 1.0).alias("vwap_dist"),
        R.ratio(c - F.col("_open"), F.col("_atr")).alias("session_open_dist_atr"),
        F.when(past & (c > F.col("_or_hi")), 1.0).when(past & (c < F.col("_or_lo")), -1.0).otherwise(0.0).alias("opening_range_breakout"),
        ((F.unix_micros("ts") - F.unix_micros("_hi_at")) / 6e7).alias("time_since_new_high"),
        ((F.unix_micros("ts") - F.unix_micros("_lo_at")) / 6e7).alias("time_since_new_low"),
        (F.size(F.filter("_ranges", lambda x: x <= F.col("high") - F.col("low"))) / F.size("_ranges")).alias("intraday_vol_percentile"),
        F.least(F.col("_i") / F.lit(session_bars), F.lit(1.0)).alias("minute_norm"),
    )


def previous_session(bars: DataFrame, shape: Shape = INTRADAY) -> DataFrame:
    """The last finished session of each ticker, joined to every bar of the next one."""
    day = bars.withColumn("session", F.to_date("ts"))
    daily = day.groupBy("ticker", "session").agg(
        F.min_by("open", "ts").alias("_o"), F.max("high").alias("_h"), F.min("low").alias("_l"), F.max_by("close", "ts").alias("_c"),
        F.sum("volume").alias("_v"),
    )
    w = Window.partitionBy("ticker").orderBy("session")  # one row per day
    span = F.col("_h") - F.col("_l")
    shaped = daily.select(
        "*", R.change(F.col("_c"), w, 1).alias("_ret"), R.mean(span, w, 5, 1).alias("_atr"), R.ratio(F.col("_v"), R.mean(F.col("_v"), w, 5, 1)).alias("_vr"),
        R.ratio(F.col("_c") - F.col("_l"), span).alias("_loc"), R.ratio(F.col("_c") - F.col("_o"), span).alias("_body"), span.alias("_span"),
    )
    prev = {n: F.lag(n).over(w) for n in ("_c", "_ret", "_atr", "_vr", "_loc", "_body", "_span")}
    context = shaped.select(
        "ticker", "session",
        R.ratio(F.col("_o") - prev["_c"], prev["_atr"]).alias("prev_session_gap_atr"),
        prev["_ret"].alias("prev_session_ret"),
        R.ratio(prev["_span"], prev["_atr"]).alias("prev_session_range_atr"),
        prev["_loc"].alias("prev_session_close_location"),
        prev["_body"].alias("prev_session_body_to_range"),
        prev["_vr"].alias("prev_session_volume_rel"),
    )
    return day.select("ticker", "ts", "session").join(context, ["ticker", "session"])


def quarter_path(bars: DataFrame, shape: Shape = INTRADAY) -> DataFrame:
    """Path of the last four bars: efficiency, sign changes, timing, rejection, breakout and body pressure."""
    c = F.col("close")

    def first(df, w):
        return df.select("*", R.change(c, w, 1).alias("_r"), R.change(c, w, 4).alias("m15_ret_4"), R.change(c, w, 2).alias("_late"))

    def second(df, w):
        r, f = F.col("_r"), R.frame(w, 4)
        full = F.count(r).over(f) == 4
        flips = F.when(F.signum(r) != F.signum(F.lag(r).over(w)), 1.0).otherwise(0.0)
        hi, lo = F.max("high").over(f), F.min("low").over(f)
        body = F.coalesce(R.ratio(c - F.col("open"), F.col("high") - F.col("low")), F.lit(0.0))
        prior = w.rowsBetween(-4, -1)
        return df.select(
            "*",
            F.when(full, R.ratio(F.abs("m15_ret_4"), F.sum(F.abs(r)).over(f))).alias("m15_path_efficiency_4"),
            F.when(full, F.avg(F.when(r > 0, 1.0).otherwise(0.0)).over(f)).alias("m15_positive_share_4"),
            (F.col("_late") - (F.col("m15_ret_4") - F.col("_late"))).alias("m15_time_imbalance_4"),
            flips.alias("_flip"),
            F.when(full, R.ratio(hi - c, hi - lo)).alias("m15_rejection_score_4"),
            F.when(full, R.ratio(c - lo, hi - lo)).alias("m15_close_location_4"),
            F.when(F.count("high").over(prior) == 4, R.ratio(c - F.max("high").over(prior), c)).alias("m15_breakout_pressure_4"),
            R.mean(body, w, 4).alias("m15_body_pressure_4"),
            R.ratio(R.mean(F.col("volume"), w, 2), R.mean(F.col("volume"), w, 8)).alias("m15_vol_ratio_2v8"),
        ).withColumn("m15_early_exhaustion_4", F.greatest(-F.col("m15_time_imbalance_4"), F.lit(0.0)))

    def third(df, w):
        return df.withColumn("m15_sign_flip_rate_4", R.mean(F.col("_flip"), w, 3)).drop("_r", "_late", "_flip")

    out = over_series(bars, first, before=5, shape=shape)
    return over_series(over_series(out, second, before=8, shape=shape), third, before=3, shape=shape)


def hour_path(bars: DataFrame, shape: Shape = INTRADAY) -> DataFrame:
    """What happened inside each hour, from its quarter-hour bars (one hour's bars in one row)."""
    bar = F.struct("ts", "open", "high", "low", "close", "volume")
    hours = bars.groupBy("ticker", F.date_trunc("hour", "ts").alias("hour")).agg(F.array_sort(F.collect_list(bar)).alias("_b"))
    b = F.col("_b")
    n = F.size(b)
    first, last = F.get(b, F.lit(0)), F.get(b, n - 1)
    mid = F.get(b, F.greatest(F.floor(n / 2).cast("int") - 1, F.lit(0)))
    steps = F.zip_with(
        F.concat(F.array(first.open), F.transform(b, lambda x: x.close)), F.transform(b, lambda x: x.close),
        lambda p, q: F.when(q.isNotNull(), q / p - 1.0),
    )
    moves = F.filter(steps, lambda x: x.isNotNull())

    def total(array):
        return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)

    hi, lo = F.array_max(F.transform(b, lambda x: x.high)), F.array_min(F.transform(b, lambda x: x.low))
    hi_at = F.array_position(F.transform(b, lambda x: x.high), hi)
    lo_at = F.array_position(F.transform(b, lambda x: x.low), lo)
    ret = last.close / first.open - 1.0
    early, late = mid.close / first.open - 1.0, last.close / mid.close - 1.0
    body = F.transform(b, lambda x: F.coalesce(R.ratio(x.close - x.open, x.high - x.low), F.lit(0.0)))
    flips = F.zip_with(moves, F.slice(moves, F.lit(2), F.size(moves)), lambda p, q: F.when(q.isNotNull(), F.when(F.signum(p) != F.signum(q), 1.0).otherwise(0.0)))
    volumes = F.transform(b, lambda x: x.volume)
    half = F.greatest(F.floor(n / 2).cast("int"), F.lit(1))
    sizes = F.transform(moves, lambda x: F.abs(x))
    early_path, path = total(F.slice(sizes, F.lit(1), half)), total(sizes)
    quarter = last.close / last.open - 1.0
    swing = F.abs(early) + F.abs(late)
    wick = F.transform(b, lambda x: F.coalesce(R.ratio((F.least(x.open, x.close) - x.low) - (x.high - F.greatest(x.open, x.close)), x.high - x.low), F.lit(0.0)))
    # each bar beside the one before it
    steps_of = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.get(b, i - 2).alias("p"), F.get(b, i - 1).alias("q")))
    pairs = F.filter(steps_of, lambda s: s.p.isNotNull())

    def count(condition):
        return F.size(F.filter(pairs, condition))

    broken = count(lambda s: s.q.close > s.p.high) - count(lambda s: s.q.close < s.p.low)
    failed = count(lambda s: (s.q.high > s.p.high) & (s.q.close <= s.p.high)) + count(lambda s: (s.q.low < s.p.low) & (s.q.close >= s.p.low))
    made = hours.select(
        "ticker", "hour", n.alias("bars"),
        ret.alias("stf15_intrahour_ret"),
        F.coalesce(R.ratio(F.abs(ret), total(F.transform(moves, lambda x: F.abs(x)))), F.lit(0.0)).alias("stf15_path_efficiency"),
        (F.size(F.filter(moves, lambda x: x > 0)) / n).alias("stf15_positive_share"),
        (F.size(F.filter(moves, lambda x: x < 0)) / n).alias("stf15_negative_share"),
        (total(F.filter(flips, lambda x: x.isNotNull())) / F.greatest(n - 1, F.lit(1))).alias("stf15_sign_flip_rate"),
        early.alias("stf15_first_half_ret"),
        late.alias("stf15_second_half_ret"),
        (late - early).alias("stf15_time_imbalance"),
        ((hi - lo) / first.open).alias("stf15_range_to_open"),
        F.coalesce(R.ratio(last.close - lo, hi - lo), F.lit(0.5)).alias("stf15_close_location"),
        (lo / first.open - 1.0).alias("stf15_max_adverse_excursion"),
        (hi_at < lo_at).cast("double").alias("stf15_high_before_low"),
        (lo_at < hi_at).cast("double").alias("stf15_low_before_high"),
        (total(body) / n).alias("stf15_body_pressure"),
        R.ratio(F.array_max(volumes) * n, total(volumes)).alias("stf15_vol_burst_ratio"),
        quarter.alias("stf15_last_quarter_ret"),
        F.coalesce(R.ratio(F.abs(early), swing), F.lit(0.5)).alias("stf15_first_half_share"),
        F.coalesce(R.ratio(F.greatest(late, F.lit(0.0)), swing), F.lit(0.0)).alias("stf15_late_strength_share"),
        R.ratio(F.array_max(volumes), total(volumes)).alias("stf15_vol_burst"),
        (total(wick) / n).alias("stf15_wick_pressure"),
        (broken / n).alias("stf15_breakout_pressure"),
        (failed / n).alias("stf15_failed_breakout_score"),
        F.coalesce(R.ratio(hi - last.close, hi - lo), F.lit(0.5)).alias("stf15_rejection_score"),
        early_path.alias("stf15_early_vol"),
        (path - early_path).alias("stf15_late_vol"),
        R.ratio(path - early_path, early_path).alias("stf15_late_vol_ratio"),
        F.coalesce(R.ratio(quarter, path), F.lit(0.0)).alias("stf15_last_quarter_share"),
        F.greatest(-F.signum(early) * late, F.lit(0.0)).alias("stf15_early_exhaustion_score"),
        F.coalesce(R.ratio(F.abs(quarter), F.array_max(F.transform(b, lambda x: F.abs(x.close / x.open - 1.0)))), F.lit(0.0)).alias("stf15_close_quarter_dominance"),
        (total(volumes) / n).alias("_volume"),
    )

    def against_before(df, w):
        return df.withColumn("stf15_rel_volume_mean", R.ratio(F.col("_volume"), R.mean(F.col("_volume"), w, 8, 1)))

    return over_series(made, against_before, ["ticker"], ["hour"], before=8, shape=shape).drop("_volume")


RANKED = ("stock_minus_mkt_1", "stock_minus_mkt_3", "stock_minus_mkt_6", "sector_minus_mkt_3", "relative_volume_time", "voladj_stock_minus_mkt_1",
          "voladj_stock_minus_mkt_3", "sector_residual_3")


def research_panel(bars: DataFrame, sectors: DataFrame, shape: Shape = DAILY) -> DataFrame:
    """Bars with every family that needs no bars inside a day, for models."""
    own = own_features(bars, shape)
    related = cross_ranks(sector_relative(own, sectors), RANKED)
    led = residual_leadership(leadership(related, "xs_rank_stock_minus_mkt_3", shape=shape), shape=shape)
    led = led.select("*", volume_leader_spread())
    # market tables have one row per timestamp; adaptive execution decides how they are joined
    return led.join(market_state(own), "ts", "left").join(breadth_context(own), "ts", "left")
