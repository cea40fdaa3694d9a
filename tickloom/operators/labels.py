"""Forward-looking labels. All shifts stay inside one ticker."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.functions.draws import draw
from tickloom.functions.layout import DAILY, Shape, over_series, positions, running
from tickloom.operators.rollups import exact_quantiles


def _feature(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """Numeric column with a default for bad values, or the default where the column is absent."""
    if name in df.columns:
        value = F.col(name).try_cast("double")
        return F.coalesce(F.when(~F.isnan(value), value), F.lit(default))
    return F.lit(default)


def direction_proxy(df: DataFrame) -> Column:
    # fixed values: feature weights and the dead band
    weights = {
        "trend_30": 1.5,
        "trend_2h": 1.0,
        "stock_minus_mkt_3": 2.0,
        "stock_minus_mkt_1": 1.0,
        "breakout_3bar": 0.75,
        "sign_persistence_5": 0.50,
    }
    score = sum((_feature(df, n) * F.lit(k) for n, k in weights.items()), F.lit(0.0))
    return F.when(score > 0.001, 1.0).when(score < -0.001, -1.0).otherwise(0.0)


def roundtrip_cost(df: DataFrame, base_bps: float = 8.0, atr_multiplier: float = 0.25) -> Column:
    return F.lit(base_bps / 10000.0) + F.lit(atr_multiplier) * F.exp(R.clip(_feature(df, "atr20_log", -20.0), -20.0, 5.0))


def _atr_fraction() -> Column:
    return F.coalesce(F.exp(R.clip(F.col("atr20_log"), -20.0, 5.0)), F.lit(0.0))


def forward_returns(df: DataFrame, horizon: int, market_close: str | None = None, shape: Shape = DAILY) -> DataFrame:
    """Raw, market and excess forward return. The market leg sums rows t .. t+h-1 of ``mkt_ret_1``."""
    h = horizon

    def build(d, w):
        raw = F.lead("close", h).over(w) / F.col("close") - 1.0
        if market_close and market_close in d.columns:
            market = F.lead(market_close, h).over(w) / F.col(market_close) - 1.0
        else:
            ahead = w.rowsBetween(0, h - 1)
            market = F.when(F.count("mkt_ret_1").over(ahead) == h, F.sum("mkt_ret_1").over(ahead))
        return d.select("*", raw.alias(f"raw_fwd_ret_{h}"), market.alias(f"mkt_fwd_ret_{h}")).withColumn(
            f"alpha_fwd_{h}", F.col(f"raw_fwd_ret_{h}") - F.col(f"mkt_fwd_ret_{h}")
        )

    return over_series(df, build, after=h, shape=shape)


def _side(value: Column, band_bps: float) -> Column:
    band = band_bps / 10000.0
    return F.when(value > band, 1).when(value < -band, -1).otherwise(0)


def cost_aware_direction(df: DataFrame, horizon: int, deadzone_bps: float = 0.0) -> DataFrame:
    """T1: sign of the cost-adjusted forward return outside a dead zone. Needs :func:`forward_returns`."""
    h = horizon
    return df.withColumn(f"est_cost_{h}", roundtrip_cost(df)).select(
        "*", (F.col(f"raw_fwd_ret_{h}") - F.col(f"est_cost_{h}")).alias(f"net_fwd_ret_{h}")
    ).withColumn(f"y_t1_dir_{h}", _side(F.col(f"net_fwd_ret_{h}"), deadzone_bps))


def alpha_direction(df: DataFrame, horizon: int, deadzone_bps: float = 0.0) -> DataFrame:
    """T2: the same on the excess return."""
    h = horizon
    cost = roundtrip_cost(df)
    return df.withColumn(f"net_alpha_fwd_{h}", F.col(f"alpha_fwd_{h}") - cost).withColumn(
        f"y_t2_dir_{h}", _side(F.col(f"net_alpha_fwd_{h}"), deadzone_bps)
    )


def opportunity(df: DataFrame, horizon: int, threshold_bps: float = 0.0) -> DataFrame:
    """T3: does the absolute move exceed the cost by more than a threshold."""
    h = horizon
    cost = roundtrip_cost(df)
    return df.withColumn(f"opp_score_{h}", F.abs(f"raw_fwd_ret_{h}") - cost).withColumn(
        f"y_t3_opp_{h}", F.when(F.col(f"opp_score_{h}") > threshold_bps / 10000.0, 1).otherwise(0)
    )


def triple_barrier(df: DataFrame, horizon: int, up: float = 1.0, down: float = 1.0, shape: Shape = DAILY) -> DataFrame:
    """T4: first barrier touched in the next ``horizon`` bars; the upper one wins inside a bar; last bars stay 0.

    The horizon is a small constant, so the scan is a ``coalesce`` over lead columns and stays in generated code.
    """
    h = horizon

    def build(d, w):
        entry = F.col("close")
        top = entry * (1.0 + F.lit(up) * _atr_fraction())
        floor = entry * (1.0 - F.lit(down) * _atr_fraction())
        touched = [
            F.when(F.lead("high", k).over(w) >= top, 1).when(F.lead("low", k).over(w) <= floor, -1)
            for k in range(1, h + 1)
        ]
        complete = F.lead(F.lit(1), h).over(w).isNotNull()
        return d.withColumn(f"y_t4_tb_{h}", F.when(complete, F.coalesce(*touched, F.lit(0))).otherwise(0))

    return over_series(df, build, after=h, shape=shape)


def up_first(df: DataFrame, horizon: int) -> DataFrame:
    """Binary view of the triple barrier."""
    return df.withColumn(f"y_t4_upfirst_{horizon}", F.when(F.col(f"y_t4_tb_{horizon}") > 0, 1).otherwise(0))


def relative_forward_return(df: DataFrame, horizon: int, shape: Shape = DAILY) -> DataFrame:
    """T6: a ticker's forward return minus the mean over tickers at the same timestamp."""
    h = horizon
    own = over_series(
        df,
        lambda d, w: d.withColumn(f"raw_fwd_ret_xs_{h}", F.lead("close", h).over(w) / F.col("close") - 1.0),
        after=h,
        shape=shape,
    )
    mean = own.groupBy("ts").agg(F.avg(f"raw_fwd_ret_xs_{h}").alias("_xs_mean"))
    # a table of a bounded calendar goes to all tasks, so rows are not exchanged by timestamp
    mean = F.broadcast(mean) if shape.series_fits() else mean
    return own.join(mean, "ts", "left").withColumn(
        f"xs_rel_fwd_ret_{h}", F.col(f"raw_fwd_ret_xs_{h}") - F.col("_xs_mean")
    ).drop("_xs_mean")


def event_outcomes(df: DataFrame, horizon: int, target: float = 1.0, stop: float = 1.0, shape: Shape = DAILY) -> DataFrame:
    """T7/T8: direction-aware target and stop scan; both in one bar count as a stop."""
    h = horizon
    priced = df.select("*", _atr_fraction().alias("_atr"), direction_proxy(df).alias("_dir"), roundtrip_cost(df).alias("_cost"))

    def build(d, w):
        ahead = w.rowsBetween(1, h)
        return d.withColumn("_path", F.collect_list(F.struct("high", "low", "close")).over(ahead))

    pathed = over_series(priced, build, after=h, shape=shape)
    entry, side = F.col("close"), F.col("_dir")
    goal, limit = F.lit(target) * F.col("_atr"), F.lit(stop) * F.col("_atr")
    usable = (F.size("_path") == h) & (entry > 0) & (side != 0)

    start = F.struct(
        F.lit(0).alias("step"),
        F.lit(None).cast("int").alias("hit_target"),
        F.lit(None).cast("int").alias("hit_stop"),
        F.lit(0.0).alias("mae"),
        F.lit(0.0).alias("mfe"),
    )

    def advance(state, bar):
        step = state.step + 1
        high, low = bar.high / entry - 1.0, bar.low / entry - 1.0
        good = F.when(side > 0, high).otherwise(-low)
        bad = F.when(side > 0, low).otherwise(-high)
        done = state.hit_target.isNotNull() | state.hit_stop.isNotNull()
        moved = F.struct(
            step.alias("step"),
            F.when(good >= goal, step).alias("hit_target"),
            F.when(bad <= -limit, step).alias("hit_stop"),
            F.least(state.mae, bad).alias("mae"),
            F.greatest(state.mfe, good).alias("mfe"),
        )
        return F.when(done, state).otherwise(moved)

    scanned = pathed.withColumn("_s", F.when(usable, F.aggregate("_path", start, advance)))
    won = F.col("_s.hit_target").isNotNull() & F.col("_s.hit_stop").isNull()
    lost = F.col("_s.hit_stop").isNotNull()
    timeout = side * (F.get("_path", F.lit(h - 1)).close / entry - 1.0)
    payoff = F.when(won, goal).when(lost, -limit).otherwise(timeout) - F.col("_cost")
    clean = won & (F.col("_s.mae") >= -(0.5 * limit)) & (F.col("_s.hit_target") <= max(1, math.ceil(h / 2)))
    known = F.col("_s").isNotNull()
    resolved = scanned.select(
        "*",
        side.alias(f"event_direction_{h}"),
        F.when(known, won.cast("double")).alias(f"y_t7_target_before_stop_{h}"),
        F.when(known, clean.cast("double")).alias(f"y_t8_clean_target_before_stop_{h}"),
        F.when(known, payoff).alias(f"event_path_payoff_{h}"),
        F.when(known, F.when(won, 1.0).when(lost, -1.0).otherwise(0.0)).alias(f"event_barrier_outcome_{h}"),
        F.col("_s.hit_target").cast("double").alias(f"time_to_target_{h}"),
        F.col("_s.hit_stop").cast("double").alias(f"time_to_stop_{h}"),
        F.col("_s.mae").alias(f"mae_before_resolution_{h}"),
        F.col("_s.mfe").alias(f"mfe_before_resolution_{h}"),
    )
    return resolved.withColumn(
        f"clean_event_path_payoff_{h}",
        F.col(f"event_path_payoff_{h}") - 0.25 * F.abs(f"mae_before_resolution_{h}"),
    ).drop("_atr", "_dir", "_cost", "_path", "_s")


def all_targets(df: DataFrame, horizon: int, shape: Shape = DAILY) -> DataFrame:
    """Every label of one horizon, T1 to T8."""
    out = forward_returns(df, horizon, shape=shape)
    out = opportunity(alpha_direction(cost_aware_direction(out, horizon), horizon), horizon)
    out = up_first(triple_barrier(out, horizon, shape=shape), horizon)
    out = relative_forward_return(out, horizon, shape)
    return event_outcomes(out, horizon, shape=shape)


def future_direction(
    df: DataFrame, horizon: int, min_move: float = 0.0, shape: Shape = DAILY
) -> DataFrame:
    """Binary up label on the forward return; rows that move less than ``min_move`` are dropped."""
    out = over_series(
        df,
        lambda d, w: d.withColumn("future_return", F.lead("close", horizon).over(w) / F.col("close") - 1.0),
        after=horizon,
        shape=shape,
    )
    if min_move > 0:
        out = out.filter(F.abs("future_return") >= min_move)
    return out.withColumn("label_up", F.when(F.col("future_return") > 0, 1).otherwise(0))


def next_row_return(df: DataFrame, shape: Shape = DAILY) -> DataFrame:
    return over_series(
        df, lambda d, w: d.withColumn("target", F.lead("close").over(w) / F.col("close") - 1.0), after=1, shape=shape
    )


def shuffle_within(df: DataFrame, column: str, key: str = "ticker", order: str = "ts", seed: int = 42, shape: Shape = DAILY, unnamed: bool = False) -> DataFrame:
    """Permute ``column`` inside each ticker by hashed order: the same on any partitioning, no random state.

    Rows without a key go, or with ``unnamed`` stay, without a value.

    Two numberings of the series, by time and by hash, are joined on (key, number). Where a series fits into a task they meet in
    a window instead: each row and each value is a row at its number, and a row takes the value that follows it.
    """
    hashed = draw(seed, key, order)
    if shape.series_fits():
        rest = [c for c in df.columns if c not in (key, column)]
        series = Window.partitionBy(key)
        numbered = (df if unnamed else df.filter(F.col(key).isNotNull())).withColumns({
            "_i": F.row_number().over(series.orderBy(order)), "_j": F.row_number().over(series.orderBy(hashed, order)),
        })
        row = F.struct(F.col("_i").alias("at"), F.lit(0).alias("side"), F.struct(*rest).alias("row"), F.lit(None).cast(df.schema[column].dataType).alias("value"))
        value = F.struct(F.col("_j").alias("at"), F.lit(1).alias("side"), F.lit(None).alias("row"), F.col(column).alias("value"))
        zipped = numbered.select(key, F.explode(F.array(row, value)).alias("_p")).select(key, "_p.*")
        taken = zipped.withColumn("value", F.lead("value").over(series.orderBy("at", "side"))).filter("side = 0")
        return taken.select(key, *[F.col("row")[c].alias(c) for c in rest], F.when(F.col(key).isNotNull(), F.col("value")).alias(column))
    by_time = positions(df, [key], [order], "_i", shape)
    coded = df.select(key, order, F.col(column).alias("_v"), hashed.alias("_h"))
    by_hash = positions(coded, [key], ["_h", order], "_i", shape, bucket=F.shiftright("_h", 48)).select(key, "_v", "_i")
    out = by_time.join(by_hash, [key, "_i"]).drop("_i", column).withColumnRenamed("_v", column)
    return out.unionByName(df.filter(F.col(key).isNull()).withColumn(column, F.lit(None).cast(df.schema[column].dataType))) if unnamed else out


def shuffle_path(bars: DataFrame, seed: int = 42, shape: Shape = DAILY) -> DataFrame:
    """Null price paths: permute each ticker's returns, rebuild close by compounding, and the bar around it.

    Spreads stay in place; a zero spread becomes the ticker's median. The floor of 1e-9 can only bind at total loss.
    """
    returns = over_series(
        bars.select("ticker", "ts", "close", "high", "low"),
        lambda d, w: d.select(
            "*",
            R.change(F.col("close"), w, 1).alias("_r"),
            F.lag("close").over(w).isNull().alias("_first"),
        ),
        before=1,
        shape=shape,
    )
    starts = returns.filter("_first").select("ticker", F.col("close").alias("_start"))
    width = F.abs(F.col("high") - F.col("low"))
    if shape.series_fits():
        spreads = returns.groupBy("ticker").agg(F.percentile(width, F.lit(0.5)).alias("_mid"))
    else:
        spreads = exact_quantiles(returns.select("ticker", width.alias("_w")), "_w", [0.5], ["ticker"]).withColumnRenamed("q0", "_mid")
    moved = shuffle_within(returns.filter(~F.col("_first")), "_r", seed=seed, shape=shape)
    first = returns.filter("_first").withColumn("_r", F.lit(0.0))
    stacked = moved.select("ticker", "ts", "high", "low", "_r").unionByName(first.select("ticker", "ts", "high", "low", "_r"))
    grown = running(stacked, ["ticker"], ["ts"], {"_g": ("product", 1.0 + F.col("_r"))}, shape)
    priced = grown.join(starts, "ticker").join(spreads, "ticker").withColumn(
        "close", F.greatest(F.lit(1e-9), F.col("_start") * F.col("_g"))
    )
    opened = over_series(
        priced, lambda d, w: d.withColumn("open", F.coalesce(F.lag("close").over(w), F.col("close"))), before=1, shape=shape
    )
    half = F.coalesce(F.nullif(F.abs(F.col("high") - F.col("low")), F.lit(0.0)), F.col("_mid")) / 2.0
    return opened.select(
        "ticker",
        "ts",
        "open",
        (F.greatest("open", "close") + half).alias("high"),
        (F.least("open", "close") - half).alias("low"),
        "close",
    )


@dataclass(frozen=True)
class Experiment:
    """One research experiment: target, horizon, label type, feature families, model and optional regime."""

    experiment_id: str
    target_id: str
    horizon: int
    label_type: str
    feature_families: tuple[str, ...]
    model_class: str
    regime_filter: str | None = None
    selection_rule: str | None = None
    notes: str = ""


def target_columns(experiment: Experiment) -> tuple[str, str]:
    """(label column, realised-return column) of an experiment."""
    h, kind = experiment.horizon, experiment.label_type
    regression = kind == "regression"
    # fixed values: which column each target is trained on and scored with
    table = {
        "T1": ("net_fwd_ret" if regression else "y_t1_dir", "net_fwd_ret"),
        "T2": ("net_alpha_fwd" if regression else "y_t2_dir", "net_alpha_fwd"),
        "T3": ("y_t3_opp", "opp_score"),
        "T4": ("y_t4_upfirst" if kind == "binary" else "y_t4_tb", "net_fwd_ret"),
        "T6": ("xs_rel_fwd_ret", "xs_rel_fwd_ret"),
        "T7": ("y_t7_target_before_stop", "event_path_payoff"),
        "T8": ("y_t8_clean_target_before_stop", "clean_event_path_payoff"),
    }
    if experiment.target_id not in table:
        raise ValueError(f"unknown target {experiment.target_id}")
    label, realised = table[experiment.target_id]
    return f"{label}_{h}", f"{realised}_{h}"
