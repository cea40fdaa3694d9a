"""Option strategies: cycles, synthetic premium scan, listed-chain scans, sizing and stress rules.

Index and volatility series have one row per calendar day. A chain is read once per leg through an equi-join on
(date, expiry); the joined targets have one row per day and variant.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.functions.layout import CALENDAR, over_series, running
from tickloom.functions.pricing import leg_prices, round_strike
from tickloom.operators import exchange as ex
from tickloom.operators.joins import asof_join, expand_grid, expand_variants, pick_leg
from tickloom.operators.metrics import drawdown_points


@dataclass(frozen=True)
class ScanConfig:
    risk_free: float = 0.06
    haircut: float = 0.15
    cost_per_leg: float = 1.0
    strike_step: float = 50.0
    entry_rows_before: int = 5
    min_days: int = 3
    strangle_margin: float = 0.18
    condor_min_margin: float = 0.02


def weekly_cycles(spot: DataFrame, rows_before: int = 5, min_days: int = 3) -> DataFrame:
    """Per ISO week: expiry on the last row up to Thursday (else the last row), entry some rows earlier."""
    numbered = spot.dropna().withColumn("_i", F.row_number().over(Window.orderBy("dt")) - 1)
    row = F.struct("dt", "_i", "spot")
    week = [F.extract(F.lit("YEAROFWEEK"), F.col("dt")).alias("_y"), F.extract(F.lit("WEEK"), F.col("dt")).alias("_w")]
    expiry = numbered.groupBy(*week).agg(
        F.coalesce(F.max(F.when(F.weekday("dt") <= 3, row)), F.max(row)).alias("_e")
    )
    target = F.greatest(F.lit(0), F.col("_e._i") - rows_before)
    entry = numbered.select(F.col("_i").alias("_entry"), F.col("dt").alias("entry_date"), F.col("spot").alias("spot_entry"))
    joined = expiry.withColumn("_entry", target).filter(F.col("_entry") < F.col("_e._i")).join(entry, "_entry")
    out = joined.select(
        "entry_date",
        F.col("_e.dt").alias("expiry_date"),
        "spot_entry",
        F.col("_e.spot").alias("spot_expiry"),
        F.datediff(F.col("_e.dt"), "entry_date").alias("days_to_expiry"),
    )
    return out.filter(F.col("days_to_expiry") >= min_days).distinct()


def _sigma(vix: Column) -> Column:
    return F.when(vix > 1.0, vix / 100.0).otherwise(vix)


def _payoff(call: Column, put: Column) -> Column:
    s = F.col("spot_expiry")
    return F.greatest(s - call, F.lit(0.0)) + F.greatest(put - s, F.lit(0.0))


def strangle_pnl(df: DataFrame, config: ScanConfig) -> DataFrame:
    """Short strangle with haircut credit. Needs spot_entry, spot_expiry, vix_entry, days_to_expiry, call/put_offset."""
    priced = df.select(
        "*",
        round_strike(F.col("spot_entry") * (1.0 + F.col("call_offset")), config.strike_step, "up").alias("call_strike"),
        round_strike(F.col("spot_entry") * (1.0 - F.col("put_offset")), config.strike_step, "down").alias("put_strike"),
        F.greatest(F.col("days_to_expiry") / 365.0, F.lit(1.0 / 365.0)).alias("_t"),
        _sigma(F.col("vix_entry")).alias("_s"),
    )
    r, S = F.lit(config.risk_free), F.col("spot_entry")
    legs = [(F.col("call_strike"), "CE"), (F.col("put_strike"), "PE")]
    premium = priced.withColumn("_l", leg_prices(S, legs, F.col("_t"), r, F.col("_s"))).select(
        "*", F.get("_l", F.lit(0)).alias("_c"), F.get("_l", F.lit(1)).alias("_p")
    )
    out = premium.select(
        *df.columns,
        "call_strike",
        "put_strike",
        F.lit(None).cast("double").alias("call_wing"),
        F.lit(None).cast("double").alias("put_wing"),
        (F.col("_c") + F.col("_p")).alias("gross_credit"),
        ((F.col("_c") + F.col("_p")) * (1.0 - config.haircut)).alias("net_credit"),
        _payoff(F.col("call_strike"), F.col("put_strike")).alias("expiry_payoff"),
        F.lit(2.0 * config.cost_per_leg).alias("total_cost_points"),
        F.greatest(F.abs(S) * config.strangle_margin, F.lit(1.0)).alias("margin_points"),
    )
    return _net(out)


def condor_pnl(df: DataFrame, config: ScanConfig) -> DataFrame:
    """Short strangle with bought wings; margin is the wider wing less the credit, with a floor. Needs wing_width too."""
    S, step = F.col("spot_entry"), config.strike_step
    strikes = df.select(
        "*",
        round_strike(S * (1.0 + F.col("call_offset")), step, "up").alias("call_strike"),
        round_strike(S * (1.0 - F.col("put_offset")), step, "down").alias("put_strike"),
        F.greatest(F.col("days_to_expiry") / 365.0, F.lit(1.0 / 365.0)).alias("_t"),
        _sigma(F.col("vix_entry")).alias("_s"),
    ).select(
        "*",
        round_strike(F.col("call_strike") + S * F.col("wing_width"), step, "up").alias("call_wing"),
        round_strike(F.col("put_strike") - S * F.col("wing_width"), step, "down").alias("put_wing"),
    )
    r = F.lit(config.risk_free)
    names = [("call_strike", "CE"), ("put_strike", "PE"), ("call_wing", "CE"), ("put_wing", "PE")]
    prices = leg_prices(S, [(F.col(n), kind) for n, kind in names], F.col("_t"), r, F.col("_s"))
    leg = [F.get("_l", F.lit(i)) for i in range(4)]
    legs = strikes.withColumn("_l", prices).select("*", (leg[0] + leg[1]).alias("_short"), (leg[2] + leg[3]).alias("_long"))
    credit = F.col("_short") * (1.0 - config.haircut) - F.col("_long") * (1.0 + config.haircut)
    width = F.greatest(F.col("call_wing") - F.col("call_strike"), F.col("put_strike") - F.col("put_wing"))
    out = legs.select(
        *df.columns,
        "call_strike",
        "put_strike",
        "call_wing",
        "put_wing",
        (F.col("_short") - F.col("_long")).alias("gross_credit"),
        credit.alias("net_credit"),
        (_payoff(F.col("call_strike"), F.col("put_strike")) - _payoff(F.col("call_wing"), F.col("put_wing"))).alias("expiry_payoff"),
        F.lit(4.0 * config.cost_per_leg).alias("total_cost_points"),
        F.greatest(width - credit, F.abs(S) * config.condor_min_margin, F.lit(1.0)).alias("margin_points"),
    )
    return _net(out)


def _net(df: DataFrame) -> DataFrame:
    net = F.col("net_credit") - F.col("expiry_payoff") - F.col("total_cost_points")
    return df.withColumn("net_pnl_points", net).withColumn("return_on_margin", F.col("net_pnl_points") / F.col("margin_points"))


# fixed values: the five synthetic variants
SYNTHETIC_VARIANTS = [
    {"strategy": "strangle_2pct", "kind": "strangle", "call_offset": 0.02, "put_offset": 0.02},
    {"strategy": "strangle_3pct", "kind": "strangle", "call_offset": 0.03, "put_offset": 0.03},
    {"strategy": "iron_condor_2pct_5pct_wing", "kind": "condor", "call_offset": 0.02, "put_offset": 0.02, "wing_width": 0.05},
    {"strategy": "vix_gated_strangle_2pct", "kind": "strangle", "call_offset": 0.02, "put_offset": 0.02, "above_median": True},
    {"strategy": "vix_shock_guard_strangle_2pct", "kind": "strangle", "call_offset": 0.02, "put_offset": 0.02, "skip_shock": True},
]
_SYNTHETIC_TYPES = {
    "strategy": "string", "kind": "string", "call_offset": "double", "put_offset": "double", "wing_width": "double",
    "above_median": "boolean", "skip_shock": "boolean",
}


def premium_scan(spot: DataFrame, vix: DataFrame, config: ScanConfig = ScanConfig(), variants: Sequence[dict] = SYNTHETIC_VARIANTS) -> DataFrame:
    """Modelled P&L of selling weekly premium, one row per cycle and variant that passes its gates."""
    cycles = weekly_cycles(spot, config.entry_rows_before, config.min_days)
    context = ex.vol_context(vix).select("dt", F.col("vix").alias("vix_entry"), "vix_median_20", "vix_change_1d")
    known = asof_join(cycles, context, "entry_date", "dt", shape=CALENDAR).filter("vix_entry IS NOT NULL").drop("matched_dt")
    rows = expand_variants(known, variants, list(_SYNTHETIC_TYPES), _SYNTHETIC_TYPES)
    gated = rows.filter(
        (~F.coalesce("above_median", F.lit(False)) | R.holds(F.col("vix_entry") > F.col("vix_median_20")))
        & ~(F.coalesce("skip_shock", F.lit(False)) & R.holds(F.col("vix_change_1d") > 0.25))
    )
    both = strangle_pnl(gated.filter("kind = 'strangle'"), config).unionByName(condor_pnl(gated.filter("kind = 'condor'"), config))
    return both.drop("kind", "call_offset", "put_offset", "wing_width", "above_median", "skip_shock")


def summarize_trades(trades: DataFrame, by: Sequence[str] = ("strategy",), extra: Sequence[str] = ()) -> DataFrame:
    """Totals, median, worst trade, win rate, drawdown and annualised return on margin per strategy."""
    keys = list(by)
    pnl, ret = F.col("net_pnl_points"), F.col("return_on_margin")
    stats = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.min("entry_date").alias("first_entry"),
        F.max("expiry_date").alias("last_expiry"),
        F.sum(pnl).alias("total_pnl_points"),
        F.avg(pnl).alias("mean_pnl_points"),
        F.percentile(pnl, F.lit(0.5)).alias("median_pnl_points"),
        F.min(pnl).alias("worst_trade_points"),
        F.avg(F.when(pnl > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg(ret).alias("mean_return_on_margin"),
        F.sum(ret).alias("total_return_on_margin"),
        *[F.avg(c).alias(f"mean_{c}") for c in extra],
    )
    falls = drawdown_points(trades, "net_pnl_points", keys, ["entry_date", "expiry_date"], CALENDAR)
    years = F.greatest(
        F.datediff("last_expiry", "first_entry") / 365.25, F.col("trade_count") / 52.0, F.lit(1.0 / 52.0)
    )
    total = F.col("total_return_on_margin")
    annual = F.when(total > -0.999999, F.pow(1.0 + total, 1.0 / years) - 1.0)
    return stats.join(falls, keys).withColumn("annualized_return_on_margin", annual)


_CHAIN_TYPES = {
    "strategy": "string", "call_offset": "double", "put_offset": "double", "wing_width": "double", "haircut": "double",
    "cost_per_leg": "double", "min_days": "int", "max_days": "int", "spot_ret_5d_min": "double", "spot_vs_sma20_min": "double",
    "vix_max": "double", "require_vix_below_p60": "boolean", "vix_change_max": "double", "max_margin": "double", "min_contracts": "double",
}
CHAIN_DEFAULTS = {"call_offset": 0.02, "put_offset": 0.02, "wing_width": 0.05, "haircut": 0.15, "cost_per_leg": 1.0}


def names_in(chain: DataFrame, by: Sequence[str] | None) -> list[str]:
    """The columns that tell underlyings apart: ``symbol`` where the chain has it, none for a chain of one index."""
    return list(by) if by is not None else [c for c in ("symbol",) if c in chain.columns]


def entry_days(chain: DataFrame, spot: DataFrame, min_days: int = 3, max_days: int = 10, by: Sequence[str] | None = None) -> DataFrame:
    """Per underlying and trade date with a spot: the first listed expiry inside the day window, and the spot at that expiry."""
    names = names_in(chain, by)
    dte = F.datediff("expiry", "trade_date")
    first = chain.groupBy(*names, "trade_date").agg(F.min(F.when(dte.between(min_days, max_days), F.col("expiry"))).alias("expiry"))
    entry = spot.select(*names, F.col("dt").alias("trade_date"), F.col("spot").alias("spot_entry"))
    at_expiry = spot.select(*names, F.col("dt").alias("expiry"), F.col("spot").alias("spot_expiry"))
    joined = first.join(entry, [*names, "trade_date"]).join(at_expiry, [*names, "expiry"], "left")
    return joined.withColumn("days_to_expiry", F.datediff("expiry", "trade_date"))


def chain_scan(
    spot: DataFrame,
    chain: DataFrame,
    vix: DataFrame,
    variants: Sequence[dict],
    min_days: int = 3,
    max_days: int = 10,
    require_traded: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Iron condors on listed prices: (trades, skips with a reason). Context filters drop a variant silently."""
    days = entry_days(chain, spot, min_days, max_days)
    early = days.filter("spot_expiry IS NULL").select(
        "trade_date", "expiry", F.lit(None).cast("string").alias("strategy"),
        F.when(F.col("expiry").isNull(), "no_weekly_expiry_in_window").otherwise("missing_spot_expiry").alias("reason"),
    )
    spot_ctx = ex.spot_context(spot).select(F.col("dt").alias("trade_date"), "spot_ret_5d", "spot_vs_sma20")
    vix_ctx = ex.vol_context(vix).select(F.col("dt").alias("trade_date"), F.col("vix").alias("vix_entry"), "vix_p60_60", "vix_change_1d")
    known = days.filter("spot_expiry IS NOT NULL").join(spot_ctx, "trade_date", "left").join(vix_ctx, "trade_date", "left")
    rows = expand_variants(known, [{**CHAIN_DEFAULTS, **v} for v in variants], list(_CHAIN_TYPES), _CHAIN_TYPES)
    c = F.col
    passes = (
        (c("min_days").isNull() | (c("days_to_expiry") >= c("min_days")))
        & (c("max_days").isNull() | (c("days_to_expiry") <= c("max_days")))
        & (c("spot_ret_5d_min").isNull() | R.holds(c("spot_ret_5d") >= c("spot_ret_5d_min")))
        & (c("spot_vs_sma20_min").isNull() | R.holds(c("spot_vs_sma20") >= c("spot_vs_sma20_min")))
        & (c("vix_max").isNull() | R.holds(c("vix_entry") <= c("vix_max")))
        & (~F.coalesce("require_vix_below_p60", F.lit(False)) | R.holds(c("vix_entry") <= c("vix_p60_60")))
        & (c("vix_change_max").isNull() | ~R.holds(c("vix_change_1d") > c("vix_change_max")))
    )
    S = c("spot_entry")
    targets = rows.filter(passes).select("*", (S * (1.0 + c("call_offset"))).alias("_ct"), (S * (1.0 - c("put_offset"))).alias("_pt"))
    keys = ["strategy"]
    legs = pick_leg(targets, chain, "CE", "_ct", "up", "short_call", keys=keys, require_traded=require_traded)
    legs = pick_leg(legs, chain, "PE", "_pt", "down", "short_put", keys=keys, require_traded=require_traded)
    legs = legs.select(
        "*",
        (c("short_call_strike") + S * c("wing_width")).alias("_cw"),
        (c("short_put_strike") - S * c("wing_width")).alias("_pw"),
    )
    legs = pick_leg(legs, chain, "CE", "_cw", "up", "call_wing", keys=keys, require_traded=require_traded)
    legs = pick_leg(legs, chain, "PE", "_pw", "down", "put_wing", keys=keys, require_traded=require_traded)
    names = ["short_call", "short_put", "call_wing", "put_wing"]
    short = c("short_call_close") + c("short_put_close")
    long = c("call_wing_close") + c("put_wing_close")
    payoff = _payoff(c("short_call_strike"), c("short_put_strike")) - _payoff(c("call_wing_strike"), c("put_wing_strike"))
    width = F.greatest(c("call_wing_strike") - c("short_call_strike"), c("short_put_strike") - c("put_wing_strike"))
    priced = legs.select(
        "*",
        short.alias("short_credit_raw"),
        long.alias("long_debit_raw"),
        (short * (1.0 - c("haircut")) - long * (1.0 + c("haircut"))).alias("net_credit"),
        payoff.alias("expiry_payoff"),
        (4.0 * c("cost_per_leg")).alias("total_cost_points"),
        sum((F.coalesce(f"{n}_contracts", F.lit(0)) for n in names), F.lit(0)).alias("total_entry_contracts"),
        sum((F.coalesce(f"{n}_open_int", F.lit(0)) for n in names), F.lit(0)).alias("total_entry_open_int"),
    ).withColumn("margin_points", F.greatest(width - c("net_credit"), S * 0.02, F.lit(1.0)))
    reason = (
        F.when(c("short_call_strike").isNull() | c("short_put_strike").isNull(), "missing_short_leg")
        .when(c("call_wing_strike").isNull() | c("put_wing_strike").isNull(), "missing_wing_leg")
        .when(R.holds(c("margin_points") > c("max_margin")), "margin_above_variant_cap")
        .when(R.holds(c("total_entry_contracts") < c("min_contracts")), "contracts_below_variant_floor")
    )
    judged = _net(priced).withColumn("reason", reason)
    trades = judged.filter("reason IS NULL").select(
        "strategy",
        c("trade_date").alias("entry_date"),
        c("expiry").alias("expiry_date"),
        "days_to_expiry",
        "spot_entry",
        "spot_expiry",
        "vix_entry",
        *[f"{n}_{f}" for n in names for f in ("strike", "close")],
        "short_credit_raw",
        "long_debit_raw",
        "net_credit",
        "expiry_payoff",
        "total_cost_points",
        "net_pnl_points",
        "margin_points",
        "return_on_margin",
        "total_entry_contracts",
        "total_entry_open_int",
    )
    late = judged.filter("reason IS NOT NULL").select("trade_date", "expiry", "strategy", "reason")
    return trades, early.unionByName(late)


def single_leg_trades(chain: DataFrame, spot: DataFrame, kind: str, otm: float, min_days: int = 7, max_days: int = 35, haircut: float = 0.0,
                      by: Sequence[str] | None = None) -> DataFrame:
    """Sell one listed option per underlying and entry day: cash-secured puts (``PE``) or covered calls (``CE``)."""
    names = names_in(chain, by)
    days = entry_days(chain, spot, min_days, max_days, names).filter("spot_expiry IS NOT NULL")
    sign = -1.0 if kind == "PE" else 1.0
    targets = days.withColumn("_t", F.col("spot_entry") * (1.0 + sign * otm))
    on = [*names, "trade_date", "expiry"]
    legs = pick_leg(targets, chain, kind, "_t", "down" if kind == "PE" else "up", "leg", on, dealt=on[:-1] if names else ()).filter("leg_strike IS NOT NULL")
    owed = F.greatest((F.col("leg_strike") - F.col("spot_expiry")) * (1.0 if kind == "PE" else -1.0), F.lit(0.0))
    return legs.select(
        *names,
        F.col("trade_date").alias("entry_date"),
        F.col("expiry").alias("expiry_date"),
        "days_to_expiry",
        "spot_entry",
        "spot_expiry",
        F.col("leg_strike").alias("strike"),
        (F.col("leg_close") * (1.0 - haircut)).alias("premium"),
        F.col("leg_contracts").alias("contracts"),
        owed.alias("intrinsic_paid"),
        (owed > 0).alias("assigned"),
    )


def cash_secured_puts(chain: DataFrame, spot: DataFrame, otm: float = 0.05, min_days: int = 7, max_days: int = 35, by: Sequence[str] | None = None) -> DataFrame:
    trades = single_leg_trades(chain, spot, "PE", otm, min_days, max_days, by=by)
    pnl = F.col("premium") - F.col("intrinsic_paid")
    return trades.select("*", pnl.alias("net_pnl_points"), (pnl / F.col("strike")).alias("return_on_cash"))


def covered_calls(chain: DataFrame, spot: DataFrame, otm: float = 0.02, min_days: int = 7, max_days: int = 35, by: Sequence[str] | None = None) -> DataFrame:
    trades = single_leg_trades(chain, spot, "CE", otm, min_days, max_days, by=by)
    hold = F.col("spot_expiry") / F.col("spot_entry") - 1.0
    return trades.select(
        "*",
        (F.col("premium") / F.col("spot_entry")).alias("premium_yield"),
        (F.col("intrinsic_paid") / F.col("spot_entry")).alias("upside_given_up"),
        hold.alias("buyhold_return"),
        (hold + (F.col("premium") - F.col("intrinsic_paid")) / F.col("spot_entry")).alias("covered_return"),
    )


def bull_put_spreads(chain: DataFrame, spot: DataFrame, otm: float = 0.05, max_loss: float = 0.04, min_days: int = 7, max_days: int = 35,
                     by: Sequence[str] | None = None) -> DataFrame:
    """Short put with a bought put so far below that the loss stays near ``max_loss`` of spot."""
    names = names_in(chain, by)
    on = [*names, "trade_date", "expiry"]
    days = entry_days(chain, spot, min_days, max_days, names).filter("spot_expiry IS NOT NULL")
    S = F.col("spot_entry")
    legs = pick_leg(days.withColumn("_t", S * (1.0 - otm)), chain, "PE", "_t", "down", "short", on, dealt=on[:-1] if names else ())
    legs = pick_leg(legs.withColumn("_l", F.col("short_strike") - S * max_loss), chain, "PE", "_l", "nearest", "long", on, dealt=on[:-1] if names else ())
    both = legs.filter("short_strike > long_strike")
    credit = F.col("short_close") - F.col("long_close")
    width = F.col("short_strike") - F.col("long_strike")
    owed = F.least(F.greatest(F.col("short_strike") - F.col("spot_expiry"), F.lit(0.0)), width)
    return both.select(
        *names, F.col("trade_date").alias("entry_date"), F.col("expiry").alias("expiry_date"), "days_to_expiry", "spot_entry", "spot_expiry",
        "short_strike", "long_strike", credit.alias("net_credit"), (width - credit).alias("max_loss_points"),
        (credit - owed).alias("net_pnl_points"), ((credit - owed) / F.greatest(width - credit, F.lit(1.0))).alias("return_on_margin"),
    )


def kelly(trades: DataFrame, ret: str, by: Sequence[str], worst_budget: float = 0.05, cap: float = 0.25) -> DataFrame:
    """Half of mean over variance, capped by a budget for the worst trade and a maximum fraction; 0 if the variance is unknown."""
    stats = trades.groupBy(*by).agg(
        F.count(ret).alias("trades"), F.avg(ret).alias("mean_return"), F.var_samp(ret).alias("variance"), F.min(ret).alias("worst_return")
    )
    raw = F.col("mean_return") / F.nullif("variance", F.lit(0.0))
    budget = F.when(F.col("worst_return") < 0, worst_budget / -F.col("worst_return")).otherwise(F.lit(cap))
    return stats.select(
        "*", raw.alias("raw_kelly"), F.greatest(F.lit(0.0), F.least(F.coalesce(raw, F.lit(0.0)) / 2.0, budget, F.lit(cap))).alias("fraction")
    )


def stress_gate(trades: DataFrame, spot: DataFrame, vix: DataFrame, ret: str, ret5_floor: float = -0.05, tail: float = -0.05) -> DataFrame:
    """Skip entries under index or volatility stress; count tail losses with and without each gate."""
    context = ex.spot_context(spot).select("dt", "spot_ret_5d").join(ex.vol_context(vix).select("dt", "vix", "vix_p60_60"), "dt", "left")
    known = asof_join(trades, context, "entry_date", "dt", shape=CALENDAR)
    index_ok = ~R.holds(F.col("spot_ret_5d") < ret5_floor)
    vol_ok = ~R.holds(F.col("vix") > F.col("vix_p60_60"))
    gates = {"ungated": F.lit(True), "skip_index_stress": index_ok, "skip_vol_stress": vol_ok, "skip_composite_stress": index_ok & vol_ok}
    items = [F.struct(F.lit(n).alias("gate"), c.alias("keep")) for n, c in gates.items()]
    stacked = known.withColumn("_g", F.explode(F.array(*items))).select(F.col(ret).alias("_r"), "_g.gate", "_g.keep")
    kept = F.col("keep")
    return stacked.groupBy("gate").agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum(kept.cast("int")).alias("kept"),
        F.avg(F.when(kept, F.col("_r"))).alias("mean_return"),
        F.min(F.when(kept, F.col("_r"))).alias("worst_return"),
        F.sum(F.when(kept & (F.col("_r") <= tail), 1).otherwise(0)).alias("tail_losses"),
    )


def overlay_frontier(defensive: DataFrame, growth: DataFrame, residual: Sequence[float], overlap: Sequence[float]) -> DataFrame:
    """Defensive trades at full size plus growth trades at a weight on residual and on overlap dates."""
    d = defensive.select("entry_date", F.col("expiry_date").alias("_de"), F.col("net_pnl_points").alias("_dp"), F.col("margin_points").alias("_dm"))
    g = growth.select("entry_date", F.col("expiry_date").alias("_ge"), F.col("net_pnl_points").alias("_gp"), F.col("margin_points").alias("_gm"))
    both = expand_grid(d.join(g, "entry_date", "full"), residual_weight=list(residual), overlap_weight=list(overlap))
    weight = F.when(F.col("_dp").isNotNull(), F.col("overlap_weight")).otherwise(F.col("residual_weight"))
    zero = F.lit(0.0)
    blended = both.select(
        "residual_weight",
        "overlap_weight",
        "entry_date",
        F.coalesce("_de", "_ge").alias("expiry_date"),
        (F.coalesce("_dp", zero) + weight * F.coalesce("_gp", zero)).alias("net_pnl_points"),
        (F.coalesce("_dm", zero) + weight * F.coalesce("_gm", zero)).alias("margin_points"),
    ).filter("margin_points > 0")
    return summarize_trades(
        blended.withColumn("return_on_margin", F.col("net_pnl_points") / F.col("margin_points")), ["residual_weight", "overlap_weight"]
    )


def lot_calibration(summary: DataFrame, lots: Sequence[int], capital: Sequence[float], worst: Sequence[float], drawdown: Sequence[float]) -> DataFrame:
    """Lots a strategy may trade: the least of capital, worst-trade and drawdown budgets."""
    grid = expand_grid(summary, lot_size=list(lots), capital=list(capital), worst_budget=list(worst), drawdown_budget=list(drawdown))
    per = F.col("lot_size")
    by_capital = F.col("capital") / F.nullif(F.col("margin_points") * per, F.lit(0.0))
    by_worst = F.col("worst_budget") / F.nullif(F.abs(F.least("worst_trade_points", F.lit(0.0))) * per, F.lit(0.0))
    by_fall = F.col("drawdown_budget") / F.nullif(F.abs("max_drawdown_points") * per, F.lit(0.0))
    lots_allowed = F.floor(F.least(by_capital, by_worst, by_fall))
    return grid.select("*", lots_allowed.alias("lots")).withColumn("annual_pnl", F.col("lots") * per * F.col("mean_pnl_points") * 52.0)


def policy_selection(calibrated: DataFrame, profile: Sequence[str], scenario: str) -> DataFrame:
    """Profiles that trade at least one lot and earn something in every scenario; the best by their weakest scenario."""
    ok = (F.col("lots") >= 1) & (F.col("annual_pnl") > 0)
    judged = calibrated.groupBy(*profile).agg(
        F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(False)).alias("passes_all"),
        F.min("annual_pnl").alias("weakest_pnl"),
        F.count_distinct(scenario).alias("scenarios"),
    )
    best = judged.filter("passes_all").agg(F.max("weakest_pnl").alias("_best"))
    # a one-row table
    return judged.join(F.broadcast(best), how="left").select(
        *judged.columns, R.holds(F.col("passes_all") & (F.col("weakest_pnl") == F.col("_best"))).alias("selected")
    )


def maturity_gate(trades: DataFrame, warmups: Sequence[int], start_years: Sequence[int]) -> DataFrame:
    """Summaries after skipping the first trades and the years before a start year (0 = none)."""
    w = Window.partitionBy("strategy").orderBy("entry_date")
    grid = expand_grid(trades.withColumn("_rn", F.row_number().over(w)), warmup=list(warmups), start_year=list(start_years))
    return summarize_trades(
        grid.filter((F.col("_rn") > F.col("warmup")) & (F.year("entry_date") >= F.col("start_year"))), ["strategy", "warmup", "start_year"]
    )


def pnl_by_year(trades: DataFrame) -> DataFrame:
    """P&L per strategy and year, and each year's share of the total."""
    years = trades.groupBy("strategy", F.year("entry_date").alias("year")).agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum("net_pnl_points").alias("pnl"), F.min("net_pnl_points").alias("worst")
    )
    total = F.sum("pnl").over(Window.partitionBy("strategy"))
    return years.withColumn("share", F.col("pnl") / F.nullif(total, F.lit(0.0)))


def without_worst(trades: DataFrame) -> DataFrame:
    """Summary with every strategy's worst trade left out."""
    w = Window.partitionBy("strategy").orderBy("net_pnl_points", "entry_date")
    return summarize_trades(trades.withColumn("_rn", F.row_number().over(w)).filter("_rn > 1"))


def loss_clusters(trades: DataFrame) -> DataFrame:
    """Runs of consecutive losing trades per strategy (trades of one strategy follow the calendar)."""
    w = Window.partitionBy("strategy").orderBy("entry_date")
    lost = F.col("net_pnl_points") < 0
    marked = trades.select(
        "strategy", "entry_date", "net_pnl_points", lost.alias("_l"),
        (F.row_number().over(w) - F.sum(lost.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("_run"),
    )
    return marked.filter("_l").groupBy("strategy", "_run").agg(
        F.min("entry_date").alias("first_entry"), F.max("entry_date").alias("last_entry"),
        F.count(F.lit(1)).alias("losses"), F.sum("net_pnl_points").alias("pnl"),
    ).drop("_run")


# fixed values: exchange and broker charges
CHARGES = {
    "brokerage_per_leg": 20.0, "stt_sell": 0.0005, "exchange": 0.0003553, "gst": 0.18, "sebi_per_rupee": 10.0 / 1e7, "stamp_buy": 0.00003,
    "itm_tax": 0.00125,
}


def itemised_cost(legs: DataFrame, lot_size: float, rates: dict = CHARGES) -> DataFrame:
    """Charges per leg (columns premium, side) in rupees."""
    turnover = F.col("premium") * lot_size
    sell = F.col("side") == "sell"
    parts = legs.select(
        "*",
        F.lit(rates["brokerage_per_leg"]).alias("brokerage"),
        F.when(sell, turnover * rates["stt_sell"]).otherwise(0.0).alias("stt"),
        (turnover * rates["exchange"]).alias("exchange_charge"),
        (turnover * rates["sebi_per_rupee"]).alias("sebi"),
        F.when(~sell, turnover * rates["stamp_buy"]).otherwise(0.0).alias("stamp"),
    )
    gst = rates["gst"] * (F.col("brokerage") + F.col("sebi") + F.col("exchange_charge"))
    return parts.withColumn("gst", gst).withColumn(
        "total_cost", F.col("brokerage") + F.col("stt") + F.col("exchange_charge") + F.col("sebi") + F.col("stamp") + F.col("gst")
    )


def itm_tax(strike: Column, spot_expiry: Column, kind: str, rate: float = CHARGES["itm_tax"]) -> Column:
    """Tax on the intrinsic value of a short leg that expires in the money."""
    owed = spot_expiry - strike if kind == "CE" else strike - spot_expiry
    return rate * F.greatest(owed, F.lit(0.0))


def chain_band(chain: DataFrame, spot: DataFrame, required: DataFrame, band: float = 0.05, max_days: int = 8) -> DataFrame:
    """Contracts within a band around spot and near expiry, plus the legs a profile requires."""
    keys = ["trade_date", "expiry", "strike", "option_typ"]
    priced = chain.join(spot.withColumnRenamed("dt", "trade_date"), "trade_date")
    near = priced.filter(
        F.col("strike").between(F.col("spot") * (1 - band), F.col("spot") * (1 + band))
        & (F.datediff("expiry", "trade_date") <= max_days)
    )
    return near.select(*keys).unionByName(required.select(*keys)).distinct()


def validate_quotes(quotes: DataFrame, by: Sequence[str], legs: int, max_age: float = 300.0, max_spread: float = 0.5, near: float = 0.10, far: float = 0.15) -> DataFrame:
    """Pass, review or fail per observation, with the first reason (columns bid, ask, age, sign, modelled)."""
    mid = (F.col("bid") + F.col("ask")) / 2.0
    out = quotes.groupBy(*by).agg(
        F.sum(F.when((F.col("bid") > 0) & (F.col("ask") > 0), 1).otherwise(0)).alias("legs_present"),
        F.max("age").alias("max_age"),
        F.max((F.col("ask") - F.col("bid")) / F.nullif(mid, F.lit(0.0))).alias("max_spread"),
        F.sum(F.col("sign") * F.when(F.col("sign") > 0, F.col("bid")).otherwise(F.col("ask"))).alias("observed_credit"),
        F.sum(F.col("sign") * F.col("modelled")).alias("modelled_credit"),
    )
    short = (F.col("modelled_credit") - F.col("observed_credit")) / F.nullif(F.abs("modelled_credit"), F.lit(0.0))
    fail = (
        F.when(F.col("legs_present") < legs, "missing_leg")
        .when(F.col("max_age") > max_age, "stale_quote")
        .when(R.holds(F.col("max_spread") > max_spread), "wide_spread")
        .when(R.holds(short > far), "outside_far_tolerance")
    )
    return out.select("*", short.alias("adverse"), fail.alias("reason")).withColumn(
        "verdict", F.when(F.col("reason").isNotNull(), "fail").when(R.holds(F.col("adverse") > near), "review").otherwise("pass")
    )


def reconcile_prices(quotes: DataFrame, by: Sequence[str], near: float = 0.10, far: float = 0.15) -> DataFrame:
    """Credit at mid prices against the modelled one, and whether it falls short by at most ``near`` or ``far`` of it.

    Only observations whose legs all have a bid and an ask are compared (columns bid, ask, sign, modelled).
    """
    credit = F.sum(F.col("sign") * (F.col("bid") + F.col("ask")) / 2)
    complete = F.bool_and(F.coalesce((F.col("bid") > 0) & F.col("ask").isNotNull(), F.lit(False)))
    out = quotes.groupBy(*by).agg(
        credit.alias("mid_credit"), F.sum(F.col("sign") * F.col("modelled")).alias("modelled_credit"), complete.alias("_complete")
    ).filter("_complete").drop("_complete")
    mid, model, size = F.col("mid_credit"), F.col("modelled_credit"), F.abs("modelled_credit")
    return out.select(
        "*", (mid - model).alias("diff"), *[(mid >= model - share * size).alias(f"within_{round(100 * share)}pct") for share in (near, far)]
    )


def freshness_gate(quotes: DataFrame, by: Sequence[str], max_age: float = 300.0) -> DataFrame:
    """Fresh rows, both option types present, nothing unresolved (columns age, option_typ, resolved)."""
    out = quotes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(F.col("age") <= max_age, 1).otherwise(0)).alias("fresh_rows"),
        F.sum(F.when(F.col("option_typ") == "CE", 1).otherwise(0)).alias("call_rows"),
        F.sum(F.when(F.col("option_typ") == "PE", 1).otherwise(0)).alias("put_rows"),
        F.sum(F.when(F.col("resolved"), 0).otherwise(1)).alias("unresolved_rows"),
        F.max("age").alias("max_age"),
        F.percentile("age", F.lit(0.5)).alias("median_age"),
    )
    passed = (F.col("fresh_rows") > 0) & (F.col("call_rows") > 0) & (F.col("put_rows") > 0) & (F.col("unresolved_rows") == 0)
    return out.withColumn("gate_passed", passed)


def ledger_summary(observations: DataFrame, required: int = 10, target: int = 15) -> DataFrame:
    """Clean observations and distinct dates against the required and the target number (columns obs_date, verdict)."""
    out = observations.agg(
        F.count(F.lit(1)).alias("ledger_rows"),
        F.sum(F.when(F.col("verdict") == "pass", 1).otherwise(0)).alias("clean_observations"),
        F.count_distinct("obs_date").alias("observation_dates"),
    )
    return out.select(
        "*",
        (F.col("clean_observations") >= required).alias("gate_passed"),
        F.greatest(F.lit(0), required - F.col("clean_observations")).alias("remaining"),
        F.when(F.col("clean_observations") >= target, "target_reached")
        .when(F.col("clean_observations") >= required, "minimum_reached")
        .otherwise("collecting")
        .alias("status"),
    )


def iv_rank(daily_iv: DataFrame, window: int = 60, least: int = 20) -> DataFrame:
    """Share of the last ``window`` days with a lower volatility, and a size tier (columns dt, iv)."""
    w = Window.orderBy("dt").rowsBetween(-(window - 1), 0)
    past = F.collect_list("iv").over(w)
    share = F.size(F.filter("_past", lambda x: x < F.col("iv"))) / F.size("_past").cast("double")
    ranked = daily_iv.withColumn("_past", past).withColumn("iv_rank", F.when(F.size("_past") >= least, share)).drop("_past")
    tier = F.when(F.col("iv_rank").isNull(), "unknown").when(F.col("iv_rank") < 0.3, "reduced").when(F.col("iv_rank") < 0.7, "base").otherwise("full")
    return ranked.withColumn("tier", tier)


def put_call_ratio(chain: DataFrame, high: float = 1.0) -> DataFrame:
    """Open interest of puts over calls per date; contracts only traded that day count through their open interest."""
    put = F.sum(F.when(F.col("option_typ") == "PE", F.col("open_int")).otherwise(0))
    call = F.sum(F.when(F.col("option_typ") == "CE", F.col("open_int")).otherwise(0))
    out = chain.groupBy("trade_date").agg(put.alias("put_oi"), call.alias("call_oi"))
    ratio = F.col("put_oi") / F.nullif("call_oi", F.lit(0)).cast("double")
    return out.withColumn("pcr", ratio).withColumn("pcr_high", R.holds(F.col("pcr") >= high))


def event_veto(trades: DataFrame, events: DataFrame, pad: int = 0) -> DataFrame:
    """Flag trades (ticker, entry_date, exit_date) whose holding window touches an event of the ticker.

    The latest event up to the exit decides, so this is an as-of lookup rather than a range join.
    """
    known = events.select(F.col("symbol").alias("ticker"), "event_date").distinct()
    looked = asof_join(
        trades.withColumn("_until", F.date_add("exit_date", pad)), known, "_until", "event_date", ["ticker"], [],
        bucket=F.trunc("_t", "month"),
    )
    return looked.withColumn(
        "vetoed", R.holds(F.col("matched_event_date") >= F.date_sub("entry_date", pad))
    ).drop("_until")


def staggered_expiries(contracts: DataFrame, keys: Sequence[str], value: str, weights: Sequence[float] = (0.25, 0.75)) -> DataFrame:
    """Weighted blend of the nearest expiries of each key."""
    w = Window.partitionBy(*keys).orderBy("expiry")
    near = contracts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= len(weights))
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), F.col("_rn"))
    return near.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("expiries"), F.sum(weight * F.col(value)).alias("blended"), F.min("expiry").alias("near_expiry")
    ).filter(F.col("expiries") == len(weights))
