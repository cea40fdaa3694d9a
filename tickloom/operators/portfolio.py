"""Rebalancing portfolios: schedules, sleeves, overlays, fold scores and the audits on them.

The panel is read through a broadcast of the rebalance dates (one row per ``every`` sessions, so its size is fixed by
the calendar); everything after that works on one row per rebalance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.functions.draws import draw
from tickloom.functions.layout import CALENDAR, DAILY, Shape, over_series, running
from tickloom.operators.joins import expand_grid, next_snapshot
from tickloom.operators.labels import roundtrip_cost
from tickloom.operators.rollups import annualise, compound

#: fixed values: the frozen breadth threshold and overlay weights of the hedge rule
FROZEN_THRESHOLD = 0.3703703703703703
NORMAL_WEIGHT = 0.10
HEDGE_WEIGHT = -0.20


def fold_calendar(panel: DataFrame, folds: int = 10) -> DataFrame:
    """One row per session: its opening timestamp, fold and position in the fold."""
    opens = panel.groupBy(F.to_date("ts").alias("_day")).agg(F.min("ts").alias("ts"))
    dated = opens.withColumn("fold_id", F.ntile(folds).over(Window.orderBy("_day")))
    inside = Window.partitionBy("fold_id")
    return dated.select(
        "fold_id",
        "ts",
        (F.row_number().over(inside.orderBy("ts")) - 1).alias("idx"),
        F.count(F.lit(1)).over(inside).alias("n"),
    )


def rebalance_schedule(calendar: DataFrame, every: int = 30) -> DataFrame:
    """Every ``every``-th session of a fold with the session it is held to (the fold's last one at the latest)."""
    w = Window.partitionBy("fold_id").orderBy("ts")
    last = F.max("ts").over(Window.partitionBy("fold_id"))
    held = calendar.withColumn("next_ts", F.coalesce(F.lead("ts", every).over(w), last))
    return held.filter((F.col("idx") % every == 0) & (F.col("idx") < F.col("n") - 1)).select(
        "fold_id", (F.col("idx") / every).cast("int").alias("k"), "ts", "next_ts"
    )


def score_weights(score: Column, group) -> Column:
    """Weights proportional to score minus the group's minimum; equal where that is degenerate."""
    centred = score - F.min(score).over(group) + 1e-6
    total = F.sum(centred).over(group)
    return F.when(total > 0, centred / total).otherwise(1.0 / F.count(F.lit(1)).over(group))


def interval_returns(panel: DataFrame, schedule: DataFrame, score: str, context: Sequence[str] = ()) -> DataFrame:
    """Return, cost and score of every ticker over each holding interval."""
    extra = [c for c in (score, "atr20_log", *context) if c in panel.columns]
    joined = next_snapshot(panel.filter(F.col("close").isNotNull()), schedule, extra=extra).filter(F.col(score).isNotNull())
    return joined.select(
        "*",
        (F.col("next_close") / F.col("close") - 1.0).alias("ret"),
        roundtrip_cost(joined).alias("cost"),
    )


def rebalance_events(
    panel: DataFrame,
    score: str,
    k: int = 10,
    every: int = 30,
    folds: int = 10,
    context: Sequence[str] = (),
    least: int | None = None,
    eligible: str | None = None,
) -> DataFrame:
    """One row per rebalance: equal-weight core, score-weighted top-k sleeve, both before and after cost.

    The top k are cut by row_number, which Spark applies inside each map task before the shuffle.
    """
    schedule = rebalance_schedule(fold_calendar(panel, folds), every)
    wanted = [*context, *([eligible] if eligible else [])]
    rows = interval_returns(panel, schedule, score, wanted)
    keys = ["fold_id", "k"]
    core = rows.groupBy(*keys).agg(
        F.min("ts").alias("rebalance_ts"),
        F.min("next_ts").alias("next_rebalance_ts"),
        F.count(F.lit(1)).alias("eligible_count"),
        F.avg("ret").alias("core_return"),
        F.avg(F.col("ret") - F.col("cost")).alias("core_return_net"),
        *[F.avg(c).alias(c) for c in context],
    )
    pool = rows.filter(F.col(eligible)) if eligible else rows
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), "ticker")
    top = pool.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    weighted = top.withColumn("w", score_weights(F.col(score), Window.partitionBy(*keys)))
    active = weighted.groupBy(*keys).agg(
        F.sum(F.col("w") * F.col("ret")).alias("active_return"),
        F.sum(F.col("w") * (F.col("ret") - F.col("cost"))).alias("active_return_net"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "ticker"))), lambda s: s.ticker).alias("top_names"),
    )
    enough = k if least is None else least
    how = "left" if eligible else "inner"
    return core.filter(F.col("eligible_count") >= enough).join(active, keys, how)


def fold_table(panel: DataFrame, events: DataFrame, folds: int = 10) -> DataFrame:
    """Per fold: sessions, buy-and-hold return over tickers priced at both ends, and the rebalanced core benchmark."""
    calendar = fold_calendar(panel, folds)
    ends = calendar.groupBy("fold_id").agg(
        F.min("ts").alias("ts"), F.max("ts").alias("next_ts"), F.max("n").alias("fold_trade_dates")
    )
    held = next_snapshot(panel, ends.withColumn("k", F.lit(0)).filter("ts < next_ts"))
    hold = held.groupBy("fold_id").agg(F.avg(F.col("next_close") / F.col("close") - 1.0).alias("buyhold_total_return"))
    bench = events.groupBy("fold_id").agg(
        compound(F.col("core_return_net")).alias("rebalanced_total_return"), F.count(F.lit(1)).alias("rebalance_count")
    )
    days = F.col("fold_trade_dates")
    return (
        ends.filter("ts < next_ts")
        .select("fold_id", "fold_trade_dates")
        .join(hold, "fold_id", "left")
        .join(bench, "fold_id", "left")
        .select(
            "*",
            annualise(F.col("buyhold_total_return"), days).alias("buyhold_annualized_return"),
            annualise(F.col("rebalanced_total_return"), days).alias("rebalanced_annualized_return"),
        )
    )


def _inputs() -> tuple[Column, Column, Column]:
    core = F.coalesce("core_return_net", F.lit(0.0))
    active = F.coalesce("active_return_net", F.lit(0.0))
    breadth = F.coalesce("breadth_rel_adv_frac", F.lit(1.0))
    return core, active, breadth


def dynamic_hedge(threshold: Column, normal: Column, hedge: Column, core: Column | None = None, active: Column | None = None) -> Column:
    """Core plus an active sleeve whose weight turns negative when breadth is weak."""
    c, a, breadth = _inputs()
    core, active = (c if core is None else core), (a if active is None else active)
    weight = F.when(breadth <= threshold, hedge).otherwise(normal)
    return (1.0 - weight) * core + weight * active


def short_cost(threshold: Column, hedge: Column, borrow: Column, bps: Column) -> Column:
    """Borrow and slippage of a short sleeve on hedged intervals; 30 days where the holding time is unknown."""
    days = F.coalesce(
        (F.unix_timestamp(F.col("next_rebalance_ts").cast("timestamp")) - F.unix_timestamp(F.col("rebalance_ts").cast("timestamp")))
        / 86400.0,
        F.lit(30.0),
    )
    hedged = (_inputs()[2] <= threshold) & (hedge < 0)
    return F.when(hedged, F.abs(hedge) * (borrow * days / 365.0 + bps / 10000.0)).otherwise(0.0)


def breadth_tilt(adv: str = "breadth_adv_frac") -> Column:
    """Half core, half active if breadth is at least one half, else core."""
    core, active, _ = _inputs()
    return 0.5 * core + 0.5 * F.when(F.coalesce(adv, F.lit(0.0)) >= 0.5, active).otherwise(core)


def score_folds(events: DataFrame, folds: DataFrame, keys: Sequence[str] = (), benchmark: str = "rebalanced_annualized_return") -> DataFrame:
    """Compound ``strategy_return`` per fold (and variant keys), annualise, compare with a benchmark."""
    totals = events.groupBy(*keys, "fold_id").agg(
        compound(F.coalesce("strategy_return", F.lit(0.0))).alias("strategy_total_return"),
        F.count(F.lit(1)).alias("events"),
    )
    joined = totals.join(folds.select("fold_id", "fold_trade_dates", F.col(benchmark).alias("benchmark_annualized")), "fold_id")
    rated = joined.withColumn(
        "strategy_annualized", annualise(F.col("strategy_total_return"), F.col("fold_trade_dates"))
    )
    return rated.select(
        *keys,
        "fold_id",
        "events",
        "strategy_total_return",
        "strategy_annualized",
        "benchmark_annualized",
        (F.col("strategy_annualized") - F.col("benchmark_annualized")).alias("excess"),
        R.holds(F.col("strategy_annualized") > F.col("benchmark_annualized")).alias("beats"),
    )


def fold_rollup(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.count_distinct("fold_id").alias("fold_count"),
        F.sum("events").alias("event_count"),
        F.avg("strategy_annualized").alias("mean_strategy_annualized"),
        F.avg("benchmark_annualized").alias("mean_benchmark_annualized"),
        F.avg("excess").alias("mean_excess"),
        F.min("excess").alias("min_excess"),
        F.min("strategy_annualized").alias("min_strategy_annualized"),
        F.sum(F.col("beats").cast("int")).alias("folds_beating"),
    )


def variants(events: DataFrame, returns: dict[str, Column]) -> DataFrame:
    """Stack named return formulas: one row per event and variant."""
    items = [F.struct(F.lit(n).alias("variant_id"), c.alias("strategy_return")) for n, c in returns.items()]
    return events.withColumn("_v", F.explode(F.array(*items))).select(*events.columns, "_v.variant_id", "_v.strategy_return")


def decision(count: Column, minimum: int, passed: str, failed: str) -> Column:
    return F.when(count >= minimum, passed).otherwise(failed)


def guardrail(stream: DataFrame, ret: str = "strategy_return", keys: Sequence[str] = ("fold_id",), order: str = "rebalance_ts") -> DataFrame:
    """Step exposure down by the drawdown of the unguarded stream as of the previous interval, four profiles."""
    keys = list(keys)
    grown = running(stream, keys, [order], {"_nw": ("product", 1.0 + F.coalesce(ret, F.lit(0.0)))}, CALENDAR)
    peaked = running(grown, keys, [order], {"_peak": ("max", F.greatest(F.col("_nw"), F.lit(1.0)))}, CALENDAR)
    fallen = over_series(
        peaked,
        lambda d, w: d.withColumn("_fall", F.coalesce(F.lag(1.0 - F.col("_nw") / F.col("_peak")).over(w), F.lit(0.0))),
        keys,
        [order],
        before=1,
        shape=CALENDAR,
    )
    f = F.col("_fall")
    # fixed values: drawdown steps and exposures of each profile
    profiles = {
        "hard_5_75_10_cash": F.when(f >= 0.10, 0.0).when(f >= 0.075, 0.5).when(f >= 0.05, 0.75).otherwise(1.0),
        "soft_5_10_floor50": F.when(f >= 0.10, 0.5).when(f >= 0.05, 0.75).otherwise(1.0),
        "medium_8_12_floor25": F.when(f >= 0.12, 0.25).when(f >= 0.08, 0.6).otherwise(1.0),
        "late_10_15_floor50": F.when(f >= 0.15, 0.5).when(f >= 0.10, 0.75).otherwise(1.0),
    }
    items = [F.struct(F.lit(n).alias("profile"), e.alias("exposure")) for n, e in profiles.items()]
    return fallen.withColumn("_p", F.explode(F.array(*items))).select(
        *stream.columns,
        f.alias("drawdown"),
        "_p.profile",
        "_p.exposure",
        (F.col("_p.exposure") * F.coalesce(ret, F.lit(0.0))).alias("guarded_return"),
    )


def ranked_names(panel: DataFrame, score: str, depth: int, every: int = 30, folds: int = 10, bottom: bool = False) -> DataFrame:
    """Best (or worst) ``depth`` names of every rebalance with their interval return."""
    schedule = rebalance_schedule(fold_calendar(panel, folds), every)
    rows = interval_returns(panel, schedule, score)
    by = F.col(score).asc() if bottom else F.col(score).desc()
    order = Window.partitionBy("fold_id", "k").orderBy(by, "ticker")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)


def winner_retention(panel: DataFrame, score: str, k: int = 3, keep_rank: int = 7, every: int = 30, folds: int = 10) -> DataFrame:
    """Keep a holding while it ranks within ``keep_rank``; fill free places from the top of the ranking.

    Holdings depend on the previous rebalance, so each fold's few rebalances are folded in order; only the best
    ``keep_rank`` names of a rebalance can matter, so a fold is at most ``keep_rank`` names times its rebalances.
    """
    top = ranked_names(panel, score, keep_rank, every, folds)
    lists = top.groupBy("fold_id", "k").agg(
        F.min("ts").alias("rebalance_ts"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "ticker"))), lambda s: s.ticker).alias("names"),
    )
    steps = lists.groupBy("fold_id").agg(F.array_sort(F.collect_list(F.struct("k", "rebalance_ts", "names"))).alias("_steps"))
    empty = F.array().cast("array<struct<k:int,rebalance_ts:date,held:array<string>>>")

    def advance(done, step):
        before = F.coalesce(F.get(done, F.size(done) - 1).held, F.array().cast("array<string>"))
        kept = F.filter(before, lambda n: F.array_contains(step.names, n))
        held = F.slice(F.array_union(kept, step.names), 1, k)
        return F.concat(done, F.array(F.struct(step.k.alias("k"), step.rebalance_ts.alias("rebalance_ts"), held.alias("held"))))

    walked = steps.select("fold_id", F.explode(F.aggregate("_steps", empty, advance)).alias("_h"))
    held = walked.select("fold_id", "_h.k", "_h.rebalance_ts", F.explode("_h.held").alias("ticker"))
    returns = held.join(top.select("fold_id", "k", "ticker", "ret"), ["fold_id", "k", "ticker"])
    return returns.groupBy("fold_id", "k").agg(
        F.min("rebalance_ts").alias("rebalance_ts"),
        F.avg("ret").alias("strategy_return"),
        F.array_sort(F.collect_list("ticker")).alias("held"),
    )


def loser_avoidance(panel: DataFrame, score: str, drop: int = 3, every: int = 30, folds: int = 10) -> DataFrame:
    """Equal weight of all names but the ``drop`` worst: totals minus the few worst rows, no full ranking."""
    schedule = rebalance_schedule(fold_calendar(panel, folds), every)
    rows = interval_returns(panel, schedule, score)
    whole = rows.groupBy("fold_id", "k").agg(
        F.min("ts").alias("rebalance_ts"), F.sum("ret").alias("_all"), F.count(F.lit(1)).alias("_n")
    )
    worst = ranked_names(panel, score, drop, every, folds, bottom=True).groupBy("fold_id", "k").agg(
        F.sum("ret").alias("_bad"), F.count(F.lit(1)).alias("_m")
    )
    kept = F.col("_n") - F.col("_m")
    return whole.join(worst, ["fold_id", "k"]).filter(kept > 0).select(
        "fold_id", "k", "rebalance_ts", kept.alias("names"), ((F.col("_all") - F.col("_bad")) / kept).alias("strategy_return")
    )


def defensive_tilt(assets: DataFrame) -> DataFrame:
    """Equity/gold/liquid 90/5/5, shifted to 50/15/15 plus cash after a 60-row equity drawdown beyond 12 %.

    ``assets``: dt, equity, gold, liquid (prices), one row per day. The drawdown of the previous day decides.
    """
    w = Window.orderBy("dt")
    peak = F.max("equity").over(w.rowsBetween(-59, 0))
    fallen = assets.select(
        "*",
        (1.0 - F.col("equity") / peak).alias("_fall"),
        *[F.coalesce(R.change(F.col(a), w, 1), F.lit(0.0)).alias(f"_{a}") for a in ("equity", "gold", "liquid")],
    )
    off = fallen.withColumn("risk_off", R.holds(F.lag("_fall").over(w) > 0.12))
    static = 0.90 * F.col("_equity") + 0.05 * F.col("_gold") + 0.05 * F.col("_liquid")
    tilted = 0.50 * F.col("_equity") + 0.15 * F.col("_gold") + 0.15 * F.col("_liquid")
    return off.select(
        "dt",
        "risk_off",
        F.col("_equity").alias("benchmark_return"),
        static.alias("static_return"),
        F.when(F.col("risk_off"), tilted).otherwise(static).alias("tilt_return"),
    )


def policy_positions(df: DataFrame, seed: int = 42) -> DataFrame:
    """Baseline policies as target positions: flat, random by hash, trend sign, RSI reversal (one row per policy)."""
    pick = draw(seed, "ticker", "ts") % 4
    policies = {
        "flat": F.lit(0.0),
        "random": F.when(pick == 1, 1.0).when(pick == 2, -1.0).otherwise(0.0),
        "sma": F.signum(F.coalesce("trend_30", F.lit(0.0))),
        "rsi": F.when(F.col("rsi14") < 30, 1.0).when(F.col("rsi14") > 70, -1.0).otherwise(0.0),
    }
    items = [F.struct(F.lit(n).alias("policy"), c.cast("double").alias("position")) for n, c in policies.items()]
    return df.withColumn("_p", F.explode(F.array(*items))).select(*df.columns, "_p.policy", "_p.position")


def policy_returns(positions: DataFrame, ret: str = "lag_ret_1", shape: Shape = DAILY) -> DataFrame:
    """Yesterday's position times today's return."""
    return over_series(
        positions,
        lambda d, w: d.withColumn("policy_return", F.coalesce(F.lag("position").over(w) * F.col(ret), F.lit(0.0))),
        ["policy", "ticker"],
        ["ts"],
        before=1,
        shape=shape,
    )


def pair_scan(
    bars: DataFrame, pairs: DataFrame, windows: Sequence[int] = (20, 60), entries: Sequence[float] = (1.5, 2.0), hold: int = 5, shape: Shape = DAILY
) -> DataFrame:
    """Mean return of fading z-score extremes of listed pairs (columns first, second), per window and entry level."""
    a = bars.select(F.col("ticker").alias("first"), "ts", F.ln("close").alias("_a"))
    b = bars.select(F.col("ticker").alias("second"), "ts", F.ln("close").alias("_b"))
    spread = a.join(pairs, "first").join(b, ["second", "ts"]).withColumn("spread", F.col("_a") - F.col("_b"))

    def z(d, w):
        cells = [
            F.struct(F.lit(n).alias("lookback"), R.zscore(F.col("spread"), w, n).alias("z")) for n in windows
        ]
        return d.select(
            "first", "second", "ts", F.array(*cells).alias("_z"), (F.lead("spread", hold).over(w) - F.col("spread")).alias("_move")
        )

    scored = over_series(spread, z, ["first", "second"], ["ts"], before=max(windows), after=hold, shape=shape)

    def previous(d, w):
        return d.withColumn("_before", F.lag("_z").over(w))

    lagged = over_series(scored, previous, ["first", "second"], ["ts"], before=1, shape=shape)
    cells = lagged.select("first", "second", "ts", "_move", F.explode(F.arrays_zip("_z", "_before")).alias("_c")).select(
        "first", "second", "ts", "_move", F.col("_c._z.lookback").alias("lookback"), F.col("_c._z.z").alias("z"), F.col("_c._before.z").alias("z0")
    )
    grid = expand_grid(cells, entry=list(entries))
    hits = grid.filter((F.abs("z") >= F.col("entry")) & (F.abs("z0") < F.col("entry")) & F.col("_move").isNotNull())
    ret = -F.signum("z") * F.col("_move")
    return hits.groupBy("lookback", "entry").agg(
        F.count(F.lit(1)).alias("events"), F.avg(ret).alias("mean_event_return"), F.avg(F.when(ret > 0, 1.0).otherwise(0.0)).alias("win_rate")
    )
