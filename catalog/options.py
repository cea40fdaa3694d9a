"""Option pricing, scans, sizing, stress and quote checks."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.exchange import SPOT_CONTEXT, VIX_CONTEXT
from catalog.registry import query
from tickloom.functions import pricing as pr
from tickloom.functions.layout import CALENDAR
from tickloom.functions.session import stored
from tickloom.operators import exchange as ex
from tickloom.operators import options as op


def _poly(x: str, coefficients, lead: str) -> str:
    out = lead
    for c in coefficients:
        out = f"({out} * {x} + {c!r})"
    return out


def cdf_sql(x: str) -> str:
    """Normal distribution of a column, spelled out (DuckDB has no erf)."""
    z = f"({x} / 1.4142135623730951::DOUBLE)"
    y, s = f"abs({z})", f"({z} * {z})"
    small = f"{z} * {_poly(s, pr.ERF_SMALL_NUM[:4], repr(pr.ERF_SMALL_NUM[4]) + '::DOUBLE')} / {_poly(s, pr.ERF_SMALL_DEN, '1.0::DOUBLE')}"
    mid = f"exp(-{s}) * {_poly(y, pr.ERFC_MID_NUM[:8], repr(pr.ERFC_MID_NUM[8]) + '::DOUBLE')} / {_poly(y, pr.ERFC_MID_DEN, '1.0::DOUBLE')}"
    i = f"(1.0::DOUBLE / {s})"
    tail = f"{i} * {_poly(i, pr.ERFC_FAR_NUM[:5], repr(pr.ERFC_FAR_NUM[5]) + '::DOUBLE')} / {_poly(i, pr.ERFC_FAR_DEN, '1.0::DOUBLE')}"
    far = f"exp(-{s}) * ({pr.INV_SQRT_PI!r}::DOUBLE - {tail}) / {y}"
    erf = f"CASE WHEN {y} <= 0.46875 THEN {small} ELSE sign({z}) * (1.0 - CASE WHEN {y} <= 4.0 THEN {mid} WHEN {y} < 26.0 THEN {far} ELSE 0.0 END) END"
    return f"(0.5 * (1.0 + {erf}))"


GRID = f"""{fx.SPOT}, {fx.VIX}, grid0 AS (
      SELECT s.dt, spot AS s, spot * (1 + m) AS k, 7 / 365.0::DOUBLE AS t, vix / 100 AS v, m
      FROM spot s JOIN vix USING (dt), (SELECT unnest([-0.05, -0.01, 0.0, 0.02]::DOUBLE[]) AS m)),
    grid1 AS (SELECT *, (ln(s / k) + (0.06 + 0.5 * v * v) * t) / (v * sqrt(t)) AS d1 FROM grid0),
    grid2 AS (SELECT *, d1 - v * sqrt(t) AS d2, -d1 AS n1, -(d1 - v * sqrt(t)) AS n2 FROM grid1),
    priced AS (SELECT *, greatest(0, s * {cdf_sql('d1')} - k * exp(-0.06 * t) * {cdf_sql('d2')}) AS call,
             greatest(0, k * exp(-0.06 * t) * {cdf_sql('n2')} - s * {cdf_sql('n1')}) AS put FROM grid2)"""


def _grid(t) -> DataFrame:
    base = fx.spot(t).join(fx.vix(t), "dt")
    return base.withColumn("m", F.explode(F.array(*[F.lit(x) for x in (-0.05, -0.01, 0.0, 0.02)]))).select(
        "dt", F.col("spot").alias("s"), (F.col("spot") * (1 + F.col("m"))).alias("k"), F.lit(7 / 365.0).alias("t"), (F.col("vix") / 100).alias("v"), "m"
    )


@query("o1_black_scholes", "dt:d m:f call:f5 put:f5", f"WITH {GRID} SELECT dt, m, call, put FROM priced")
def _(t):
    c = F.col
    r = F.lit(0.06)
    return _grid(t).select(
        "dt", "m",
        pr.bs_price(c("s"), c("k"), c("t"), r, c("v"), "CE").alias("call"),
        pr.bs_price(c("s"), c("k"), c("t"), r, c("v"), "PE").alias("put"),
    )


@query(
    "o2_strike_rounding",
    "dt:d up:f down:f near:f",
    f"WITH {fx.SPOT} SELECT dt, ceil(spot / 50) * 50 AS up, floor(spot / 50) * 50 AS down, round_even(spot / 50, 0) * 50 AS near FROM spot",
)
def _(t):
    s = F.col("spot")
    return fx.spot(t).select(
        "dt", pr.round_strike(s, 50.0, "up").alias("up"), pr.round_strike(s, 50.0, "down").alias("down"), pr.round_strike(s, 50.0, "near").alias("near")
    )


CYCLES = f"""{fx.SPOT}, days AS (SELECT *, row_number() OVER (ORDER BY dt) - 1 AS i FROM spot),
    weeks AS (
      SELECT coalesce(max(i) FILTER (isodow(dt) <= 4), max(i)) AS e FROM days GROUP BY isoyear(dt), week(dt)),
    cycles AS (
      SELECT DISTINCT a.dt AS entry_date, b.dt AS expiry_date, a.spot AS spot_entry, b.spot AS spot_expiry, b.dt - a.dt AS days_to_expiry
      FROM weeks JOIN days b ON b.i = e JOIN days a ON a.i = greatest(0, e - 5) WHERE a.i < b.i AND b.dt - a.dt >= 3)"""


@query(
    "o3_weekly_cycles",
    "entry_date:d expiry_date:d spot_entry:f8 spot_expiry:f8 days_to_expiry:i",
    f"WITH {CYCLES} SELECT * FROM cycles",
)
def _(t):
    return op.weekly_cycles(fx.spot(t))


def _d1_sql(strike: str) -> str:
    return f"(ln(spot_entry / {strike}) + (0.06 + 0.5 * sg * sg) * tt) / (sg * sqrt(tt))"


SCAN = f"""{CYCLES}, {VIX_CONTEXT}, known AS (
      SELECT c.*, vix AS vix_entry, vix_median_20, vix_change_1d FROM cycles c ASOF JOIN vix_context v ON c.entry_date >= v.dt),
    variants(strategy, kind, off, gate) AS (VALUES ('strangle_2pct', 's', 0.02::DOUBLE, ''), ('strangle_3pct', 's', 0.03, ''),
      ('iron_condor_2pct_5pct_wing', 'c', 0.02, ''), ('vix_gated_strangle_2pct', 's', 0.02, 'm'), ('vix_shock_guard_strangle_2pct', 's', 0.02, 'k')),
    base0 AS (
      SELECT *, ceil(spot_entry * (1.0 + off) / 50) * 50 AS k1, floor(spot_entry * (1.0 - off) / 50) * 50 AS k2,
             greatest(days_to_expiry / 365.0::DOUBLE, 1 / 365.0::DOUBLE) AS tt, CASE WHEN vix_entry > 1 THEN vix_entry / 100 ELSE vix_entry END AS sg
      FROM known, variants WHERE (gate <> 'm' OR coalesce(vix_entry > vix_median_20, false)) AND NOT (gate = 'k' AND coalesce(vix_change_1d > 0.25, false))),
    base1 AS (SELECT *, ceil((k1 + spot_entry * 0.05::DOUBLE) / 50) * 50 AS k3, floor((k2 - spot_entry * 0.05::DOUBLE) / 50) * 50 AS k4 FROM base0),
    base2 AS (SELECT *, {_d1_sql('k1')} AS a1, -({_d1_sql('k2')}) AS a2, {_d1_sql('k3')} AS a3, -({_d1_sql('k4')}) AS a4 FROM base1),
    base3 AS (SELECT *, a1 - sg * sqrt(tt) AS b1, a2 + sg * sqrt(tt) AS b2, a3 - sg * sqrt(tt) AS b3, a4 + sg * sqrt(tt) AS b4, exp(-0.06 * tt) AS df FROM base2),
    base4 AS (SELECT *, greatest(0, spot_entry * {cdf_sql('a1')} - k1 * df * {cdf_sql('b1')}) AS p1,
             greatest(0, k2 * df * {cdf_sql('b2')} - spot_entry * {cdf_sql('a2')}) AS p2,
             greatest(0, spot_entry * {cdf_sql('a3')} - k3 * df * {cdf_sql('b3')}) AS p3,
             greatest(0, k4 * df * {cdf_sql('b4')} - spot_entry * {cdf_sql('a4')}) AS p4 FROM base3),
    scan0 AS (
      SELECT *, CASE kind WHEN 's' THEN p1 + p2 ELSE p1 + p2 - p3 - p4 END AS gross_credit,
             CASE kind WHEN 's' THEN (p1 + p2) * 0.85 ELSE (p1 + p2) * 0.85 - (p3 + p4) * 1.15 END AS net_credit,
             greatest(spot_expiry - k1, 0) + greatest(k2 - spot_expiry, 0)
               - CASE kind WHEN 's' THEN 0 ELSE greatest(spot_expiry - k3, 0) + greatest(k4 - spot_expiry, 0) END AS expiry_payoff,
             CASE kind WHEN 's' THEN 2.0::DOUBLE ELSE 4.0 END AS total_cost_points FROM base4),
    scan AS (
      SELECT *, net_credit - expiry_payoff - total_cost_points AS net_pnl_points,
             (net_credit - expiry_payoff - total_cost_points) / margin_points AS return_on_margin
      FROM (SELECT *, CASE kind WHEN 's' THEN greatest(spot_entry * 0.18, 1) ELSE greatest(greatest(k3 - k1, k2 - k4) - net_credit, spot_entry * 0.02, 1) END AS margin_points FROM scan0))"""


@query(
    "o4_o6_premium_scan",
    "strategy:s entry_date:d expiry_date:d vix_entry:f call_strike:f put_strike:f gross_credit:f4 net_credit:f4 expiry_payoff:f4 "
    "margin_points:f4 net_pnl_points:f4 return_on_margin:f",
    f"WITH {SCAN} SELECT *, k1 AS call_strike, k2 AS put_strike FROM scan",
)
def _(t):
    return op.premium_scan(fx.spot(t), fx.vix(t))


def summary_sql(source: str, keys: str, extra: str = "") -> str:
    return f"""SELECT *, CASE WHEN total_return_on_margin > -0.999999 THEN pow(1 + total_return_on_margin,
          1 / greatest((last_expiry - first_entry) / 365.25, trade_count / 52.0, 1 / 52.0)) - 1 END AS annualized_return_on_margin
        FROM (SELECT {keys}, count(*) AS trade_count, min(entry_date) AS first_entry, max(expiry_date) AS last_expiry,
                sum(net_pnl_points) AS total_pnl_points, avg(net_pnl_points) AS mean_pnl_points, median(net_pnl_points) AS median_pnl_points,
                min(net_pnl_points) AS worst_trade_points, avg(CASE WHEN net_pnl_points > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate,
                avg(return_on_margin) AS mean_return_on_margin, sum(return_on_margin) AS total_return_on_margin, min(eq - peak) AS max_drawdown_points{extra}
              FROM (SELECT *, max(eq) OVER (PARTITION BY {keys} ORDER BY entry_date, expiry_date ROWS UNBOUNDED PRECEDING) AS peak
                    FROM (SELECT *, sum(net_pnl_points) OVER (PARTITION BY {keys} ORDER BY entry_date, expiry_date ROWS UNBOUNDED PRECEDING) AS eq FROM {source}))
              GROUP BY {keys})"""


SUMMARY = (
    "trade_count:i first_entry:d last_expiry:d total_pnl_points:f2 mean_pnl_points:f4 median_pnl_points:f4 worst_trade_points:f4 win_rate:f "
    "mean_return_on_margin:f total_return_on_margin:f4 max_drawdown_points:f2 annualized_return_on_margin:f4"
)


@query("o7_strategy_summary", f"strategy:s {SUMMARY}", f"WITH {SCAN} {summary_sql('scan', 'strategy')}")
def _(t):
    return op.summarize_trades(op.premium_scan(fx.spot(t), fx.vix(t)))


CONDORS = [
    {"strategy": "plain"},
    {"strategy": "filtered", "spot_ret_5d_min": -0.05, "spot_vs_sma20_min": -0.05, "require_vix_below_p60": True},
    {"strategy": "floored", "min_contracts": 900.0},
    {"strategy": "capped", "max_margin": 1200.0, "vix_change_max": 0.2, "vix_max": 30.0},
]

CHAIN_SCAN = f"""{SPOT_CONTEXT}, {fx.CHAIN}, {VIX_CONTEXT},
    firsts AS (SELECT trade_date, min(expiry) FILTER (expiry - trade_date BETWEEN 3 AND 10) AS expiry FROM chain GROUP BY 1),
    entry AS (
      SELECT f.trade_date, f.expiry, a.spot AS s, b.spot AS x, f.expiry - f.trade_date AS dte, a.spot_ret_5d, a.spot_vs_sma20, v.vix, v.vix_p60_60, v.vix_change_1d
      FROM firsts f JOIN spot_context a ON a.dt = f.trade_date LEFT JOIN spot b ON b.dt = f.expiry LEFT JOIN vix_context v ON v.dt = f.trade_date),
    want AS (
      SELECT e.*, strategy FROM entry e, (SELECT unnest(['plain', 'filtered', 'floored', 'capped']) AS strategy) WHERE x IS NOT NULL AND CASE strategy
        WHEN 'filtered' THEN coalesce(spot_ret_5d >= -0.05 AND spot_vs_sma20 >= -0.05 AND vix <= vix_p60_60, false)
        WHEN 'capped' THEN coalesce(vix <= 30, false) AND NOT coalesce(vix_change_1d > 0.2, false) ELSE true END),
    live AS (SELECT * FROM chain WHERE close > 0 AND contracts > 0),
    short_legs AS (
      SELECT w.trade_date, w.strategy, min(strike) FILTER (option_typ = 'CE' AND strike >= s * 1.02) AS sc,
             arg_min(row(close, contracts, open_int), strike) FILTER (option_typ = 'CE' AND strike >= s * 1.02) AS scr,
             max(strike) FILTER (option_typ = 'PE' AND strike <= s * 0.98) AS sp,
             arg_max(row(close, contracts, open_int), strike) FILTER (option_typ = 'PE' AND strike <= s * 0.98) AS spr
      FROM want w LEFT JOIN live l ON l.trade_date = w.trade_date AND l.expiry = w.expiry GROUP BY 1, 2),
    wing_legs AS (
      SELECT w.trade_date, w.strategy, min(strike) FILTER (option_typ = 'CE' AND strike >= sc + s * 0.05) AS cw,
             arg_min(row(close, contracts, open_int), strike) FILTER (option_typ = 'CE' AND strike >= sc + s * 0.05) AS cwr,
             max(strike) FILTER (option_typ = 'PE' AND strike <= sp - s * 0.05) AS pw,
             arg_max(row(close, contracts, open_int), strike) FILTER (option_typ = 'PE' AND strike <= sp - s * 0.05) AS pwr
      FROM want w JOIN short_legs USING (trade_date, strategy) LEFT JOIN live l ON l.trade_date = w.trade_date AND l.expiry = w.expiry GROUP BY 1, 2),
    legged AS (
      SELECT *, scr[1] + spr[1] AS short_credit_raw, cwr[1] + pwr[1] AS long_debit_raw,
             (scr[1] + spr[1]) * 0.85 - (cwr[1] + pwr[1]) * 1.15 AS net_credit,
             greatest(x - sc, 0) + greatest(sp - x, 0) - greatest(x - cw, 0) - greatest(pw - x, 0) AS expiry_payoff,
             coalesce(scr[2], 0) + coalesce(spr[2], 0) + coalesce(cwr[2], 0) + coalesce(pwr[2], 0) AS total_entry_contracts
      FROM want JOIN short_legs USING (trade_date, strategy) JOIN wing_legs USING (trade_date, strategy)),
    judged AS (
      SELECT *, CASE WHEN sc IS NULL OR sp IS NULL THEN 'missing_short_leg' WHEN cw IS NULL OR pw IS NULL THEN 'missing_wing_leg'
               WHEN strategy = 'capped' AND margin_points > 1200 THEN 'margin_above_variant_cap'
               WHEN strategy = 'floored' AND total_entry_contracts < 900 THEN 'contracts_below_variant_floor' END AS reason,
             net_credit - expiry_payoff - 4 AS net_pnl_points, (net_credit - expiry_payoff - 4) / margin_points AS return_on_margin
      FROM (SELECT *, greatest(greatest(cw - sc, sp - pw) - net_credit, s * 0.02, 1) AS margin_points FROM legged)),
    trades AS (SELECT *, trade_date AS entry_date, expiry AS expiry_date FROM judged WHERE reason IS NULL)"""


def _scan(t):
    return op.chain_scan(fx.spot(t), fx.chain(t), fx.vix(t), CONDORS)


@query(
    "o8_chain_condor_trades",
    "strategy:s entry_date:d expiry_date:d short_call_strike:f short_put_strike:f call_wing_strike:f put_wing_strike:f net_credit:f4 "
    "expiry_payoff:f4 margin_points:f4 net_pnl_points:f4 return_on_margin:f total_entry_contracts:i",
    f"""WITH {CHAIN_SCAN} SELECT *, sc AS short_call_strike, sp AS short_put_strike, cw AS call_wing_strike, pw AS put_wing_strike FROM trades""",
)
def _(t):
    return _scan(t)[0]


@query(
    "o8_chain_condor_skips",
    "trade_date:d expiry:d strategy:s reason:s",
    f"""WITH {CHAIN_SCAN} SELECT trade_date, expiry, strategy, reason FROM judged WHERE reason IS NOT NULL
        UNION ALL SELECT trade_date, expiry, NULL, CASE WHEN expiry IS NULL THEN 'no_weekly_expiry_in_window' ELSE 'missing_spot_expiry' END FROM entry WHERE x IS NULL""",
)
def _(t):
    return _scan(t)[1]


@query("o8_chain_condor_summary", f"strategy:s {SUMMARY} mean_days_to_expiry:f mean_total_entry_contracts:f",
       f"WITH {CHAIN_SCAN} {summary_sql('trades', 'strategy', ', avg(dte) AS mean_days_to_expiry, avg(total_entry_contracts) AS mean_total_entry_contracts')}")
def _(t):
    return op.summarize_trades(_scan(t)[0], extra=["days_to_expiry", "total_entry_contracts"])


SINGLE = f"""{fx.SPOT}, {fx.CHAIN}, firsts AS (SELECT trade_date, min(expiry) FILTER (expiry - trade_date BETWEEN 3 AND 10) AS expiry FROM chain GROUP BY 1),
    entry AS (SELECT f.*, a.spot AS s, b.spot AS x FROM firsts f JOIN spot a ON a.dt = f.trade_date JOIN spot b ON b.dt = f.expiry),
    live AS (SELECT * FROM chain WHERE close > 0 AND contracts > 0),
    puts AS (
      SELECT e.trade_date AS entry_date, e.expiry AS expiry_date, s, x, max(strike) AS strike, arg_max(close, strike) AS premium
      FROM entry e JOIN live l ON l.trade_date = e.trade_date AND l.expiry = e.expiry WHERE option_typ = 'PE' AND strike <= s * 0.95 GROUP BY ALL),
    calls AS (
      SELECT e.trade_date AS entry_date, e.expiry AS expiry_date, s, x, min(strike) AS strike, arg_min(close, strike) AS premium
      FROM entry e JOIN live l ON l.trade_date = e.trade_date AND l.expiry = e.expiry WHERE option_typ = 'CE' AND strike >= s * 1.02 GROUP BY ALL),
    csp AS (SELECT *, premium - greatest(strike - x, 0) AS net_pnl_points, (premium - greatest(strike - x, 0)) / strike AS return_on_cash, strike > x AS assigned FROM puts)"""


def _puts(t):
    return op.cash_secured_puts(fx.chain(t), fx.spot(t), 0.05, 3, 10)


@query(
    "o9_cash_secured_puts",
    "entry_date:d expiry_date:d strike:f premium:f6 net_pnl_points:f4 return_on_cash:f assigned:b",
    f"WITH {SINGLE} SELECT * FROM csp",
)
def _(t):
    return _puts(t)


@query(
    "o10_bull_put_spread",
    "entry_date:d short_strike:f long_strike:f net_credit:f4 max_loss_points:f4 net_pnl_points:f4 return_on_margin:f",
    f"""WITH {SINGLE}, l AS (
          SELECT p.entry_date, p.expiry_date, p.s, p.x, p.strike AS short_strike, p.premium AS sc,
                 arg_min(l.strike, row(abs(l.strike - (p.strike - p.s * 0.04)), l.strike)) AS long_strike,
                 arg_min(l.close, row(abs(l.strike - (p.strike - p.s * 0.04)), l.strike)) AS lc
          FROM puts p JOIN live l ON l.trade_date = p.entry_date AND l.expiry = p.expiry_date AND option_typ = 'PE' GROUP BY ALL),
        d AS (SELECT *, sc - lc AS net_credit, short_strike - long_strike AS w FROM l WHERE short_strike > long_strike)
        SELECT *, w - net_credit AS max_loss_points, net_credit - least(greatest(short_strike - x, 0), w) AS net_pnl_points,
               (net_credit - least(greatest(short_strike - x, 0), w)) / greatest(w - net_credit, 1) AS return_on_margin FROM d""",
)
def _(t):
    return op.bull_put_spreads(fx.chain(t), fx.spot(t), 0.05, 0.04, 3, 10)


@query(
    "o11_covered_calls",
    "entry_date:d strike:f premium_yield:f upside_given_up:f buyhold_return:f covered_return:f",
    f"""WITH {SINGLE} SELECT *, premium / s AS premium_yield, greatest(x - strike, 0) / s AS upside_given_up, x / s - 1 AS buyhold_return,
        x / s - 1 + (premium - greatest(x - strike, 0)) / s AS covered_return FROM calls""",
)
def _(t):
    return op.covered_calls(fx.chain(t), fx.spot(t), 0.02, 3, 10)


# 7 to 35 days ahead, 5 % out of the money, one contract traded at least: one trade for each name and day
STOCKS = f"""{fx.BARS}, {fx.STOCK_CHAIN},
    firsts AS (SELECT symbol, trade_date, min(expiry) FILTER (expiry - trade_date BETWEEN 7 AND 35) AS expiry FROM stock_chain GROUP BY ALL),
    entry AS (
      SELECT f.*, a.spot AS s, b.spot AS x FROM firsts f JOIN stock_spot a ON a.symbol = f.symbol AND a.dt = f.trade_date
      JOIN stock_spot b ON b.symbol = f.symbol AND b.dt = f.expiry),
    live AS (SELECT * FROM stock_chain WHERE close > 0 AND contracts > 0),
    listed AS (SELECT e.*, option_typ, strike, close, contracts FROM entry e JOIN live USING (symbol, trade_date, expiry)),
    puts AS (
      SELECT symbol, trade_date, expiry, s, x, max(strike) AS strike, arg_max(close, strike) AS premium, arg_max(contracts, strike) AS contracts
      FROM listed WHERE option_typ = 'PE' AND strike <= s * 0.95 GROUP BY ALL),
    calls AS (
      SELECT symbol, trade_date, expiry, s, x, min(strike) AS strike, arg_min(close, strike) AS premium
      FROM listed WHERE option_typ = 'CE' AND strike >= s * 1.02 GROUP BY ALL),
    csp AS (
      SELECT *, trade_date AS entry_date, expiry AS expiry_date, expiry - trade_date AS days_to_expiry,
             premium - greatest(strike - x, 0) AS net_pnl_points, (premium - greatest(strike - x, 0)) / strike AS return_on_cash, strike > x AS assigned FROM puts)"""


def _stocks(t):
    """Chain and spots of the stocks; chain, entry and expiry read the spots, which are written once."""
    spots = stored(fx.stock_spot(t), "spots")
    return fx.stock_chain(t, spots), spots


def _stock_puts(t):
    return op.cash_secured_puts(*_stocks(t))


@query(
    "j8_stock_entry_days",
    "symbol:s trade_date:d expiry:d days_to_expiry:i spot_entry:f spot_expiry:f",
    f"""WITH {STOCKS} SELECT symbol, trade_date, expiry, expiry - trade_date AS days_to_expiry, s AS spot_entry, x AS spot_expiry FROM entry""",
)
def _(t):
    return op.entry_days(*_stocks(t), 7, 35).filter("spot_expiry IS NOT NULL")


@query(
    "o9_stock_puts",
    "symbol:s entry_date:d expiry_date:d days_to_expiry:i strike:f premium:f6 contracts:i net_pnl_points:f4 return_on_cash:f assigned:b",
    f"WITH {STOCKS} SELECT * FROM csp",
)
def _(t):
    return _stock_puts(t)


@query(
    "o10_stock_put_spreads",
    "symbol:s entry_date:d days_to_expiry:i short_strike:f long_strike:f net_credit:f4 max_loss_points:f4 net_pnl_points:f4 return_on_margin:f",
    f"""WITH {STOCKS}, l AS (
          SELECT p.symbol, p.trade_date, p.expiry, p.s, p.x, p.strike AS short_strike, p.premium AS sc,
                 arg_min(l.strike, row(abs(l.strike - (p.strike - p.s * 0.04)), l.strike)) AS long_strike,
                 arg_min(l.close, row(abs(l.strike - (p.strike - p.s * 0.04)), l.strike)) AS lc
          FROM puts p JOIN listed l ON l.symbol = p.symbol AND l.trade_date = p.trade_date AND l.option_typ = 'PE' GROUP BY ALL),
        d AS (SELECT *, sc - lc AS net_credit, short_strike - long_strike AS w FROM l WHERE short_strike > long_strike)
        SELECT *, trade_date AS entry_date, expiry - trade_date AS days_to_expiry, w - net_credit AS max_loss_points,
               net_credit - least(greatest(short_strike - x, 0), w) AS net_pnl_points,
               (net_credit - least(greatest(short_strike - x, 0), w)) / greatest(w - net_credit, 1) AS return_on_margin FROM d""",
)
def _(t):
    return op.bull_put_spreads(*_stocks(t))


@query(
    "o11_stock_covered_calls",
    "symbol:s entry_date:d expiry_date:d strike:f premium_yield:f upside_given_up:f buyhold_return:f covered_return:f",
    f"""WITH {STOCKS} SELECT *, trade_date AS entry_date, expiry AS expiry_date, premium / s AS premium_yield, greatest(x - strike, 0) / s AS upside_given_up,
        x / s - 1 AS buyhold_return, x / s - 1 + (premium - greatest(x - strike, 0)) / s AS covered_return FROM calls""",
)
def _(t):
    return op.covered_calls(*_stocks(t))


@query(
    "o12_stock_kelly_sizing",
    "symbol:s trades:i mean_return:f variance:f6 worst_return:f raw_kelly:f2 fraction:f",
    f"""WITH {STOCKS}, k AS (SELECT symbol, count(*) AS trades, avg(return_on_cash) AS mean_return,
          var_samp(return_on_cash) AS variance, min(return_on_cash) AS worst_return FROM csp GROUP BY 1)
        SELECT *, mean_return / variance AS raw_kelly, greatest(0, least(coalesce(mean_return / variance, 0) / 2,
          CASE WHEN worst_return < 0 THEN 0.05 / -worst_return ELSE 0.25 END, 0.25)) AS fraction FROM k""",
)
def _(t):
    return op.kelly(_stock_puts(t), "return_on_cash", ["symbol"])


@query(
    "o12_kelly_sizing",
    "year:i trades:i mean_return:f variance:f6 worst_return:f raw_kelly:f2 fraction:f",
    f"""WITH {SINGLE}, k AS (SELECT year(entry_date) AS year, count(*) AS trades, avg(return_on_cash) AS mean_return,
          var_samp(return_on_cash) AS variance, min(return_on_cash) AS worst_return FROM csp GROUP BY 1)
        SELECT *, mean_return / variance AS raw_kelly, greatest(0, least(coalesce(mean_return / variance, 0) / 2,
          CASE WHEN worst_return < 0 THEN 0.05 / -worst_return ELSE 0.25 END, 0.25)) AS fraction FROM k""",
)
def _(t):
    return op.kelly(_puts(t).withColumn("year", F.year("entry_date")), "return_on_cash", ["year"])


@query(
    "o13_stress_gate",
    "gate:s trades:i kept:i mean_return:f worst_return:f tail_losses:i",
    f"""WITH {SINGLE.replace(fx.SPOT, SPOT_CONTEXT)}, {VIX_CONTEXT}, ctx AS (SELECT s.dt, spot_ret_5d, v.vix, vix_p60_60 FROM spot_context s LEFT JOIN vix_context v USING (dt)),
        k AS (SELECT return_on_cash AS r, NOT coalesce(spot_ret_5d < -0.05, false) AS i, NOT coalesce(vix > vix_p60_60, false) AS v
              FROM csp ASOF LEFT JOIN ctx ON entry_date >= dt),
        g AS (SELECT 'ungated' AS gate, true AS keep, r FROM k UNION ALL SELECT 'skip_index_stress', i, r FROM k
              UNION ALL SELECT 'skip_vol_stress', v, r FROM k UNION ALL SELECT 'skip_composite_stress', i AND v, r FROM k)
        SELECT gate, count(*) AS trades, count(*) FILTER (keep) AS kept, avg(r) FILTER (keep) AS mean_return, min(r) FILTER (keep) AS worst_return,
               count(*) FILTER (keep AND r <= -0.05) AS tail_losses FROM g GROUP BY 1""",
)
def _(t):
    return op.stress_gate(_puts(t), fx.spot(t), fx.vix(t), "return_on_cash")


OVERLAY = f"""{CHAIN_SCAN}, d AS (SELECT * FROM trades WHERE strategy = 'filtered'), g AS (SELECT * FROM trades WHERE strategy = 'floored'),
    both_t AS (
      SELECT entry_date, coalesce(d.expiry_date, g.expiry_date) AS expiry_date, d.net_pnl_points AS dp, d.margin_points AS dm, g.net_pnl_points AS gp, g.margin_points AS gm
      FROM d FULL JOIN g USING (entry_date)),
    blend AS (
      SELECT rw AS residual_weight, ow AS overlap_weight, entry_date, expiry_date, coalesce(dp, 0) + w * coalesce(gp, 0) AS net_pnl_points,
             coalesce(dm, 0) + w * coalesce(gm, 0) AS margin_points
      FROM (SELECT *, CASE WHEN dp IS NOT NULL THEN ow ELSE rw END AS w FROM both_t, (SELECT unnest([0, 0.5]::DOUBLE[]) AS rw), (SELECT unnest([0.5, 1.0]::DOUBLE[]) AS ow))),
    blended AS (SELECT *, net_pnl_points / margin_points AS return_on_margin FROM blend WHERE margin_points > 0)"""


@query(
    "o14_overlay_frontier",
    f"residual_weight:f overlap_weight:f {SUMMARY}",
    f"WITH {OVERLAY} {summary_sql('blended', 'residual_weight, overlap_weight')}",
)
def _(t):
    trades = _scan(t)[0]
    return op.overlay_frontier(trades.filter("strategy = 'filtered'"), trades.filter("strategy = 'floored'"), [0.0, 0.5], [0.5, 1.0])


CALIBRATED = f"""{CHAIN_SCAN}, base_s AS ({summary_sql('trades', 'strategy', ', max(margin_points) AS margin_points')}),
    cal AS (
      SELECT *, lots * lot_size * mean_pnl_points * 52 AS annual_pnl FROM (
        SELECT *, floor(least(capital / (margin_points * lot_size), worst_budget / nullif(abs(least(worst_trade_points, 0)) * lot_size, 0),
               drawdown_budget / nullif(abs(max_drawdown_points) * lot_size, 0))) AS lots
        FROM base_s, (SELECT unnest([50, 65, 75]) AS lot_size), (SELECT unnest([500000, 2000000]::DOUBLE[]) AS capital),
             (SELECT unnest([100000]::DOUBLE[]) AS worst_budget), (SELECT unnest([20000000]::DOUBLE[]) AS drawdown_budget)))"""


def _calibrated(t):
    trades = _scan(t)[0]
    margins = trades.groupBy("strategy").agg(F.max("margin_points").alias("margin_points"))
    summary = op.summarize_trades(trades).join(margins, "strategy")
    return op.lot_calibration(summary, [50, 65, 75], [500000.0, 2000000.0], [100000.0], [20000000.0])


@query(
    "o15_lot_calibration",
    "strategy:s lot_size:i capital:f lots:f annual_pnl:f0",
    f"WITH {CALIBRATED} SELECT * FROM cal",
)
def _(t):
    return _calibrated(t)


@query(
    "o16_policy_selection",
    "strategy:s capital:f passes_all:b weakest_pnl:f0 scenarios:i selected:b",
    f"""WITH {CALIBRATED}, j AS (SELECT strategy, capital, coalesce(bool_and(coalesce(lots >= 1 AND annual_pnl > 0, false)), false) AS passes_all,
          min(annual_pnl) AS weakest_pnl, count(DISTINCT lot_size) AS scenarios FROM cal GROUP BY 1, 2)
        SELECT *, coalesce(passes_all AND weakest_pnl = (SELECT max(weakest_pnl) FROM j WHERE passes_all), false) AS selected FROM j""",
)
def _(t):
    return op.policy_selection(_calibrated(t), ["strategy", "capital"], "lot_size")


@query(
    "o17_maturity_gate",
    f"strategy:s warmup:i start_year:i {SUMMARY}",
    f"""WITH {CHAIN_SCAN}, m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY entry_date) AS rn FROM trades),
          (SELECT unnest([0, 2]) AS warmup), (SELECT unnest([0, 1998]) AS start_year) WHERE rn > warmup AND year(entry_date) >= start_year)
        {summary_sql('m', 'strategy, warmup, start_year')}""",
)
def _(t):
    return op.maturity_gate(_scan(t)[0], [0, 2], [0, 1998])


@query(
    "o18_pnl_by_year",
    "strategy:s year:i trade_count:i pnl:f2 worst:f4 share:f4",
    f"""WITH {CHAIN_SCAN}, y AS (SELECT strategy, year(entry_date) AS year, count(*) AS trade_count, sum(net_pnl_points) AS pnl, min(net_pnl_points) AS worst
          FROM trades GROUP BY 1, 2) SELECT *, pnl / sum(pnl) OVER (PARTITION BY strategy) AS share FROM y""",
)
def _(t):
    return op.pnl_by_year(_scan(t)[0])


@query(
    "o18_without_worst_trade",
    f"strategy:s {SUMMARY}",
    f"""WITH {CHAIN_SCAN}, m AS (SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY net_pnl_points, entry_date) > 1)
        {summary_sql('m', 'strategy')}""",
)
def _(t):
    return op.without_worst(_scan(t)[0])


@query(
    "o18_loss_clusters",
    "strategy:s first_entry:d last_entry:d losses:i pnl:f4",
    f"""WITH {CHAIN_SCAN}, r AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY entry_date)
          - sum(CASE WHEN net_pnl_points < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY strategy ORDER BY entry_date ROWS UNBOUNDED PRECEDING) AS g FROM trades)
        SELECT strategy, min(entry_date) AS first_entry, max(entry_date) AS last_entry, count(*) AS losses, sum(net_pnl_points) AS pnl
        FROM r WHERE net_pnl_points < 0 GROUP BY strategy, g""",
)
def _(t):
    return op.loss_clusters(_scan(t)[0])


@query(
    "o19_itemised_cost",
    "strategy:s entry_date:d leg:s stt:f exchange_charge:f sebi:f stamp:f gst:f total_cost:f",
    f"""WITH {CHAIN_SCAN}, l AS (SELECT strategy, entry_date, 'short_call' AS leg, 'sell' AS side, scr[1] AS p FROM trades
          UNION ALL SELECT strategy, entry_date, 'short_put', 'sell', spr[1] FROM trades
          UNION ALL SELECT strategy, entry_date, 'call_wing', 'buy', cwr[1] FROM trades
          UNION ALL SELECT strategy, entry_date, 'put_wing', 'buy', pwr[1] FROM trades),
        c AS (SELECT *, CASE side WHEN 'sell' THEN p * 65 * 0.0005 ELSE 0 END AS stt, p * 65 * 0.0003553 AS exchange_charge, p * 65 * 10 / 1e7 AS sebi,
              CASE side WHEN 'buy' THEN p * 65 * 0.00003 ELSE 0 END AS stamp FROM l)
        SELECT *, 0.18 * (20 + sebi + exchange_charge) AS gst, 20 + stt + exchange_charge + sebi + stamp + 0.18 * (20 + sebi + exchange_charge) AS total_cost FROM c""",
)
def _(t):
    sides = {"short_call": "sell", "short_put": "sell", "call_wing": "buy", "put_wing": "buy"}
    legs = [F.struct(F.lit(n).alias("leg"), F.lit(s).alias("side"), F.col(f"{n}_close").alias("premium")) for n, s in sides.items()]
    legs = _scan(t)[0].select("strategy", "entry_date", F.explode(F.array(*legs)).alias("_l")).select("strategy", "entry_date", "_l.*")
    return op.itemised_cost(legs, 65.0)


@query(
    "o20_itm_expiry_tax",
    "strategy:s entry_date:d tax:f",
    f"WITH {CHAIN_SCAN} SELECT strategy, entry_date, 0.00125 * greatest(x - sc, 0) + 0.00125 * greatest(sp - x, 0) AS tax FROM trades",
)
def _(t):
    tax = op.itm_tax(F.col("short_call_strike"), F.col("spot_expiry"), "CE") + op.itm_tax(F.col("short_put_strike"), F.col("spot_expiry"), "PE")
    return _scan(t)[0].select("strategy", "entry_date", tax.alias("tax"))


@query(
    "o21_leg_resolver",
    "trade_date:d expiry:d short_call:f short_put:f",
    f"""WITH {SINGLE} SELECT e.trade_date, e.expiry, min(strike) FILTER (option_typ = 'CE' AND strike >= s * 1.03) AS short_call,
        max(strike) FILTER (option_typ = 'PE' AND strike <= s * 0.97) AS short_put
        FROM entry e LEFT JOIN chain c ON c.trade_date = e.trade_date AND c.expiry = e.expiry AND close > 0 GROUP BY 1, 2, s""",
)
def _(t):
    from tickloom.operators.joins import pick_leg

    chain = fx.chain(t)
    days = op.entry_days(chain, fx.spot(t)).filter("spot_expiry IS NOT NULL")
    targets = days.select("*", (F.col("spot_entry") * 1.03).alias("a"), (F.col("spot_entry") * 0.97).alias("b"))
    legs = pick_leg(targets, chain, "CE", "a", "up", "call", require_traded=False)
    legs = pick_leg(legs, chain, "PE", "b", "down", "put", require_traded=False)
    return legs.select("trade_date", "expiry", F.col("call_strike").alias("short_call"), F.col("put_strike").alias("short_put"))


@query(
    "o22_chain_band",
    "trade_date:d expiry:d strike:f option_typ:s",
    f"""WITH {fx.SPOT}, {fx.CHAIN} SELECT trade_date, expiry, strike, option_typ FROM chain c JOIN spot s ON s.dt = c.trade_date
        WHERE strike BETWEEN spot * 0.95 AND spot * 1.05 AND expiry - trade_date <= 8
        UNION SELECT trade_date, expiry, strike, option_typ FROM chain WHERE contracts >= 480""",
)
def _(t):
    chain = fx.chain(t)
    return op.chain_band(chain, fx.spot(t), chain.filter("contracts >= 480"))


QUOTES = f"""{fx.SPOT}, {fx.CHAIN}, quotes AS (
      SELECT trade_date, strike, option_typ, CASE WHEN contracts % 11 = 0 THEN 0 ELSE close * (1 - (contracts % 7) / 50.0) END AS bid,
             close * (1 + (contracts % 5) / 50.0) AS ask, contracts::DOUBLE AS age, CASE option_typ WHEN 'CE' THEN 1.0 ELSE -0.5 END AS sign,
             close AS modelled, contracts % 13 <> 0 AS resolved
      FROM chain c JOIN spot s ON s.dt = c.trade_date WHERE strike BETWEEN spot * 0.99 AND spot * 1.01)"""


def _quotes(t):
    near = fx.chain(t).join(F.broadcast(fx.spot(t).withColumnRenamed("dt", "trade_date")), "trade_date").filter(
        F.col("strike").between(F.col("spot") * 0.99, F.col("spot") * 1.01)
    )
    n = F.col("contracts")
    return near.select(
        "trade_date", "strike", "option_typ",
        F.when(n % 11 == 0, 0.0).otherwise(F.col("close") * (1 - (n % 7) / 50.0)).alias("bid"),
        (F.col("close") * (1 + (n % 5) / 50.0)).alias("ask"),
        n.cast("double").alias("age"),
        F.when(F.col("option_typ") == "CE", 1.0).otherwise(-0.5).alias("sign"),
        F.col("close").alias("modelled"),
        (n % 13 != 0).alias("resolved"),
    )


VALIDATED = f"""{QUOTES}, v AS (
      SELECT trade_date, count(*) FILTER (bid > 0 AND ask > 0) AS legs_present, max(age) AS max_age, max((ask - bid) / nullif((bid + ask) / 2, 0)) AS max_spread,
             sum(sign * CASE WHEN sign > 0 THEN bid ELSE ask END) AS observed_credit, sum(sign * modelled) AS modelled_credit FROM quotes GROUP BY 1),
    w AS (SELECT *, (modelled_credit - observed_credit) / nullif(abs(modelled_credit), 0) AS adverse FROM v),
    u AS (SELECT *, CASE WHEN legs_present < 4 THEN 'missing_leg' WHEN max_age > 400 THEN 'stale_quote' WHEN max_spread > 0.5 THEN 'wide_spread'
             WHEN adverse > 0.15 THEN 'outside_far_tolerance' END AS reason FROM w),
    validated AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'fail' WHEN adverse > 0.1 THEN 'review' ELSE 'pass' END AS verdict FROM u)"""


@query(
    "o23_quote_validation",
    "trade_date:d legs_present:i max_spread:f observed_credit:f6 modelled_credit:f6 adverse:f reason:s verdict:s",
    f"WITH {VALIDATED} SELECT * FROM validated",
)
def _(t):
    return op.validate_quotes(_quotes(t), ["trade_date"], 4, max_age=400.0)


@query(
    "o24_freshness_gate",
    "trade_date:d rows:i fresh_rows:i call_rows:i put_rows:i unresolved_rows:i median_age:f gate_passed:b",
    f"""WITH {QUOTES}, g AS (SELECT trade_date, count(*) AS rows, count(*) FILTER (age <= 300) AS fresh_rows, count(*) FILTER (option_typ = 'CE') AS call_rows,
          count(*) FILTER (option_typ = 'PE') AS put_rows, count(*) FILTER (NOT resolved) AS unresolved_rows, median(age) AS median_age FROM quotes GROUP BY 1)
        SELECT *, fresh_rows > 0 AND call_rows > 0 AND put_rows > 0 AND unresolved_rows = 0 AS gate_passed FROM g""",
)
def _(t):
    return op.freshness_gate(_quotes(t), ["trade_date"])


@query(
    "o25_observation_ledger",
    "ledger_rows:i clean_observations:i observation_dates:i gate_passed:b remaining:i status:s",
    f"""WITH {VALIDATED} SELECT count(*) AS ledger_rows, count(*) FILTER (verdict = 'pass') AS clean_observations, count(DISTINCT trade_date) AS observation_dates,
        count(*) FILTER (verdict = 'pass') >= 10 AS gate_passed, greatest(0, 10 - count(*) FILTER (verdict = 'pass')) AS remaining,
        CASE WHEN count(*) FILTER (verdict = 'pass') >= 15 THEN 'target_reached' WHEN count(*) FILTER (verdict = 'pass') >= 10 THEN 'minimum_reached' ELSE 'collecting' END AS status
        FROM validated""",
)
def _(t):
    checked = op.validate_quotes(_quotes(t), ["trade_date"], 4, max_age=400.0)
    return op.ledger_summary(checked.withColumnRenamed("trade_date", "obs_date"))


@query(
    "o26_paper_price_reconciliation",
    "trade_date:d mid_credit:f3 modelled_credit:f3 diff:f3 within_10pct:b within_15pct:b",
    f"""WITH {QUOTES}, r AS (SELECT trade_date, sum(sign * (bid + ask) / 2) AS mid_credit, sum(sign * modelled) AS modelled_credit FROM quotes
          GROUP BY 1 HAVING min(bid) > 0)
        SELECT *, mid_credit - modelled_credit AS diff, mid_credit >= modelled_credit - 0.1 * abs(modelled_credit) AS within_10pct,
               mid_credit >= modelled_credit - 0.15 * abs(modelled_credit) AS within_15pct FROM r""",
)
def _(t):
    return op.reconcile_prices(_quotes(t), ["trade_date"])


@query(
    "o27_implied_vol_rank",
    "dt:d iv:f7 iv_rank:f5 tier:s",
    f"""WITH {fx.SPOT}, {fx.VIX}, p AS (SELECT dt, round(vix / 100, 7) AS iv FROM vix JOIN spot USING (dt)),
        r AS (SELECT *, list(iv) OVER (ORDER BY dt ROWS 59 PRECEDING) AS past FROM p),
        s AS (SELECT dt, iv, CASE WHEN len(past) >= 20 THEN len(list_filter(past, lambda x: x < iv)) / len(past) END AS iv_rank FROM r)
        SELECT *, CASE WHEN iv_rank IS NULL THEN 'unknown' WHEN iv_rank < 0.3 THEN 'reduced' WHEN iv_rank < 0.7 THEN 'base' ELSE 'full' END AS tier FROM s""",
)
def _(t):
    """Price an at-the-money call at the index volatility, then recover that volatility from the price."""
    c, r = F.col, F.lit(0.06)
    priced = _grid(t).filter("m = 0").withColumn("price", pr.bs_price(c("s"), c("k"), c("t"), r, c("v"), "CE"))
    found = priced.select("dt", F.round(pr.implied_vol(c("price"), c("s"), c("k"), c("t"), r, "CE"), 7).alias("iv"))
    return op.iv_rank(found)


@query(
    "o28_put_call_ratio",
    "trade_date:d put_oi:i call_oi:i pcr:f pcr_high:b",
    f"""WITH {fx.SPOT}, {fx.CHAIN}, p AS (SELECT trade_date, sum(CASE WHEN option_typ = 'PE' THEN open_int ELSE 0 END) AS put_oi,
          sum(CASE WHEN option_typ = 'CE' THEN open_int ELSE 0 END) AS call_oi FROM chain GROUP BY 1)
        SELECT *, put_oi / call_oi AS pcr, coalesce(put_oi / call_oi >= 0.5, false) AS pcr_high FROM p""",
)
def _(t):
    return op.put_call_ratio(fx.chain(t), high=0.5)


@query(
    "o29_event_veto",
    "ticker:s entry_date:d exit_date:d vetoed:b",
    f"""WITH {fx.BARS}, {fx.EARNINGS}, tr AS (SELECT ticker, ts AS entry_date, lead(ts, 3) OVER (PARTITION BY ticker ORDER BY ts) AS exit_date FROM bars)
        SELECT *, EXISTS (SELECT 1 FROM earnings e WHERE e.symbol = ticker AND event_date BETWEEN entry_date AND exit_date) AS vetoed
        FROM tr WHERE exit_date IS NOT NULL""",
)
def _(t):
    from tickloom.functions.layout import DAILY, over_series

    held = over_series(
        fx.bars(t).select("ticker", "ts"), lambda d, w: d.withColumn("exit_date", F.lead("ts", 3).over(w)), after=3, shape=DAILY
    ).filter("exit_date IS NOT NULL").withColumnRenamed("ts", "entry_date")
    return op.event_veto(held, fx.earnings(t))


@query(
    "o30_staggered_expiries",
    "symbol:s date:d expiries:i blended:f near_expiry:d",
    f"""WITH {fx.OPEN_INTEREST}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY expiry) AS rn FROM oi QUALIFY rn <= 2)
        SELECT symbol, date, count(*) AS expiries, sum(CASE rn WHEN 1 THEN 0.25 ELSE 0.75 END * oi) AS blended, min(expiry) AS near_expiry
        FROM n GROUP BY 1, 2 HAVING count(*) = 2""",
)
def _(t):
    return op.staggered_expiries(fx.open_interest(t), ["symbol", "date"], "oi")
