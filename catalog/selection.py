"""Experiment selection presets, branch comparison and technical indicators."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query
from tickloom.operators import selection as se
from tickloom.operators import technical as te

PLAIN = "gap_auc + gap_balanced_accuracy + real_spread_top_bottom"
BY_IC = "gap_ic_spearman + gap_spread_top_bottom + real_spread_top_bottom"
STANDARD_ORDER = "selection_score DESC, real_spread_top_bottom DESC, real_trade_count DESC, experiment_id"


def preset_sql(preset: str) -> str:
    trades, spread, per_family, promote = se.PRESETS[preset]
    ok = f"gap_auc > 0 AND gap_balanced_accuracy > 0 AND gap_spread_top_bottom >= {spread}"
    score, order, again = PLAIN, STANDARD_ORDER, STANDARD_ORDER
    if preset == "e302":
        order = again = "real_auc DESC, real_balanced_accuracy DESC, gap_spread_top_bottom DESC, real_spread_top_bottom DESC, experiment_id"
    if preset == "generalization_next":
        order = "gap_auc DESC, gap_balanced_accuracy DESC, real_auc DESC, real_spread_top_bottom DESC, experiment_id"
        again = "gap_auc DESC, gap_balanced_accuracy DESC, real_spread_top_bottom DESC, experiment_id"
    if preset == "generalization_wave2":
        ok = f"(({ok}) OR (gap_ic_spearman > 0 AND gap_spread_top_bottom >= {spread}))"
        score = f"CASE label_type WHEN 'binary' THEN {PLAIN} ELSE {BY_IC} END"
    if preset == "ablation_grid":
        ok = "CASE label_type WHEN 'binary' THEN gap_auc > 0 AND gap_balanced_accuracy > 0 ELSE gap_ic_spearman > 0 END"
        score = f"CASE label_type WHEN 'binary' THEN {PLAIN} ELSE {BY_IC} END"
    if preset == "intraday_volume_liquidity_forecast":
        ok = f"gap_auc > 0 AND gap_balanced_accuracy >= 0 AND gap_spread_top_bottom >= {spread}"
        score = f"{PLAIN} + gap_spread_top_bottom"
    if preset == "event_outcome_accounting":
        ok = ("gap_auc > 0 AND gap_balanced_accuracy >= 0 AND real_top_decile_net_ret > 0 AND gap_top_decile_net_ret > 0 "
              "AND real_spread_top_bottom >= 0")
        score = "gap_auc + gap_balanced_accuracy + 100 * real_top_decile_net_ret + 100 * gap_top_decile_net_ret + 50 * real_spread_top_bottom"
        order = again = "selection_score DESC, real_top_decile_net_ret DESC, real_trade_count DESC, experiment_id"
    if preset == "portfolio_rank_60m":
        ok = f"gap_ic_spearman > 0 AND gap_spread_top_bottom > {spread}"
        score = "gap_ic_spearman + gap_spread_top_bottom + 0.25 * real_spread_top_bottom"
    part = "PARTITION BY family, eligible" if per_family else "PARTITION BY eligible"
    inner = f"""SELECT *, CASE WHEN eligible THEN row_number() OVER ({part} ORDER BY {order}) END AS first_rank
        FROM (SELECT *, ({ok}) AND real_trade_count >= {trades} AS eligible, {score} AS selection_score FROM compare)"""
    if per_family:
        return f"""SELECT '{preset}' AS preset, *, rank AS shortlist_rank, coalesce(rank <= {promote}, false) AS promoted FROM (
            SELECT *, first_rank AS family_rank, CASE WHEN first_rank = 1 THEN row_number() OVER (PARTITION BY first_rank = 1 ORDER BY {again}) END AS rank FROM ({inner}))"""
    return f"""SELECT '{preset}' AS preset, *, first_rank AS shortlist_rank, coalesce(first_rank <= {promote}, false) AS promoted, NULL AS family_rank FROM ({inner})"""


SPEC = "preset:s experiment_id:s eligible:b selection_score:f family_rank:f shortlist_rank:f promoted:b"


def _register(preset: str) -> None:
    @query(f"x1_shortlist_{preset}", SPEC, f"WITH {fx.COMPARE} {preset_sql(preset)}")
    def _(t, preset=preset):
        return se.shortlist(fx.compare(t), preset)


for _preset in se.PRESETS:
    _register(_preset)


@query(
    "x1_ablation_best_by_target",
    "target_id:s experiment_id:s eligible:b selection_score:f",
    f"""WITH {fx.COMPARE}, g AS ({preset_sql('ablation_grid')}) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY target_id
        ORDER BY eligible DESC, selection_score DESC, real_spread_top_bottom DESC, experiment_id) = 1""",
)
def _(t):
    return se.ablation_best(fx.compare(t), "target_id")


@query(
    "x1_ablation_best_by_family",
    "family:s experiment_id:s eligible:b selection_score:f",
    f"""WITH {fx.COMPARE}, g AS ({preset_sql('ablation_grid')}) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY family
        ORDER BY eligible DESC, selection_score DESC, real_spread_top_bottom DESC, experiment_id) = 1""",
)
def _(t):
    return se.ablation_best(fx.compare(t), "family")


@query(
    "x2_branch_comparison",
    "branch:s experiment_id:s gap_auc:f real_trade_count:f promoted:b",
    f"""WITH {fx.COMPARE}, s AS ({preset_sql('cross_sectional_60m')}),
        b AS (SELECT *, round({PLAIN}, 12) AS sort_score FROM compare)
        SELECT target_id AS branch, experiment_id, gap_auc, real_trade_count, false AS promoted FROM b
        QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY sort_score DESC, experiment_id DESC) = 1
        UNION ALL SELECT 'CrossSectional60m_' || family, experiment_id, gap_auc, real_trade_count, true FROM s WHERE promoted""",
)
def _(t):
    frame = fx.compare(t)
    sources = {name: frame.filter(F.col("target_id") == name) for name in ("T1", "T2", "T3", "T4")}
    return se.branch_compare(sources, se.shortlist(frame, "cross_sectional_60m"), "CrossSectional60m")


def branch_sql(preset: str, prefix: str, order: str) -> str:
    columns = "real_auc, real_spread_top_bottom, gap_auc, gap_ic_spearman, gap_spread_top_bottom, real_trade_count, label_type"
    return f"""WITH {fx.COMPARE}, s AS ({preset_sql(preset)})
        SELECT target_id AS branch, experiment_id, {columns}, false AS promoted FROM compare
        QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY {order}, experiment_id DESC) = 1
        UNION ALL SELECT '{prefix}_' || family, experiment_id, {columns}, true FROM s WHERE promoted"""


# fixed values: preset, prefix and order of the branch comparisons
COMPARISONS = {
    "x2_branches_deepdive": ("e102_deepdive", "E102DeepDive", "plain", f"round({PLAIN}, 12) DESC"),
    "x2_branches_next": ("generalization_next", "GeneralizationNext", "generalization_next",
                         "round(real_auc, 12) DESC, round(real_balanced_accuracy, 12) DESC, round(real_spread_top_bottom, 12) DESC"),
    "x2_branches_wave2": ("generalization_wave2", "GeneralizationWave2", "wave2", f"round({PLAIN} + gap_ic_spearman, 12) DESC"),
}


def comparison(name: str):
    preset, prefix, score, order = COMPARISONS[name]

    @query(name, "branch:s experiment_id:s real_auc:f real_spread_top_bottom:f gap_auc:f gap_ic_spearman:f gap_spread_top_bottom:f "
           "real_trade_count:f label_type:s promoted:b", branch_sql(preset, prefix, order))
    def _(t):
        frame = fx.compare(t)
        sources = {target: frame.filter(F.col("target_id") == target) for target in ("T1", "T2", "T3", "T4")}
        return se.branch_compare(sources, se.shortlist(frame, preset), prefix, score)


for name in COMPARISONS:
    comparison(name)


@query(
    "x4_top_experiment",
    "experiment_id:s selection_score:f",
    f"""WITH {fx.COMPARE}, g AS ({preset_sql('setup_regime')}) SELECT experiment_id, selection_score FROM g
        ORDER BY round(selection_score, 12) DESC, experiment_id DESC LIMIT 1""",
)
def _(t):
    return se.top_experiment(se.shortlist(fx.compare(t), "setup_regime"))


TECH = f"""{fx.BARS}, f AS (
      SELECT *, (high + low + close) / 3 AS tp, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume AS mf,
             CASE WHEN close < lag(close) OVER (PARTITION BY ticker ORDER BY ts) THEN -volume ELSE volume END AS sv FROM bars),
    g AS (
      SELECT *, ln(close) AS log_close, coalesce(ln(close) - ln(lag(close) OVER w), 0) AS log_return, coalesce(close / lag(close) OVER w - 1, 0) AS lagged_return,
             CASE WHEN count(*) OVER w10 = 10 THEN avg(close) OVER w10 END AS sma10, CASE WHEN count(*) OVER w50 = 50 THEN avg(close) OVER w50 END AS sma50,
             CASE WHEN count(*) OVER w20 = 20 THEN avg(close) OVER w20 + 2 * stddev_pop(close) OVER w20 END AS bb_upper,
             CASE WHEN count(*) OVER w20 = 20 THEN avg(close) OVER w20 - 2 * stddev_pop(close) OVER w20 END AS bb_lower,
             CASE WHEN count(*) OVER w20 = 20 THEN 400 * stddev_pop(close) OVER w20 / avg(close) OVER w20 END AS bollinger_width,
             CASE WHEN count(*) OVER w14 = 14 THEN sum(tp * volume) OVER w14 / sum(volume) OVER w14 END AS vwap,
             CASE WHEN count(*) OVER w20 = 20 THEN sum(mf) OVER w20 / sum(volume) OVER w20 END AS chaikin_mf,
             CASE WHEN count(*) OVER w14 = 14 THEN 100 * (close - min(low) OVER w14) / (max(high) OVER w14 - min(low) OVER w14) END AS stoch_k,
             CASE WHEN count(*) OVER w20 = 20 THEN avg((4 * high - 2 * low + close) / 3) OVER w20 END AS kc_high,
             CASE WHEN count(*) OVER w20 = 20 THEN avg(tp) OVER w20 END AS kc_mid,
             CASE WHEN count(*) OVER w20 = 20 THEN avg((-2 * high + 4 * low + close) / 3) OVER w20 END AS kc_low,
             (high - low) / open AS intraday_pct_range, sum(sv) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING) AS obv
      FROM f WINDOW w AS (PARTITION BY ticker ORDER BY ts), w10 AS (PARTITION BY ticker ORDER BY ts ROWS 9 PRECEDING),
        w14 AS (PARTITION BY ticker ORDER BY ts ROWS 13 PRECEDING), w20 AS (PARTITION BY ticker ORDER BY ts ROWS 19 PRECEDING),
        w50 AS (PARTITION BY ticker ORDER BY ts ROWS 49 PRECEDING)),
    tech AS (SELECT *, CASE WHEN count(stoch_k) OVER w3 = 3 THEN avg(stoch_k) OVER w3 END AS stoch_d FROM g
             WINDOW w3 AS (PARTITION BY ticker ORDER BY ts ROWS 2 PRECEDING))"""


@query(
    "t_expression_indicators",
    "ticker:s ts:d log_close:f log_return:f lagged_return:f sma10:f8 sma50:f8 bb_upper:f bb_lower:f bollinger_width:f vwap:f chaikin_mf:f "
    "stoch_k:f stoch_d:f kc_high:f8 kc_mid:f8 kc_low:f8 intraday_pct_range:f obv:f",
    f"WITH {TECH} SELECT * FROM tech",
)
def _(t):
    return te.technical_indicators(fx.bars(t))


RECURSIVE = f"""{fx.BARS}, n AS (
      SELECT *, row_number() OVER w AS i, coalesce(close - lag(close) OVER w, 0) AS mv,
             coalesce(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), high - low) AS tr
      FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
    seed AS (SELECT ticker, avg(tr) AS tr14 FROM n WHERE i <= 14 GROUP BY 1),
    walk AS (
      SELECT ticker, ts, i, close AS e12, close AS e26, close AS e20, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, NULL::DOUBLE AS atr, NULL::DOUBLE AS fi FROM n WHERE i = 1
      UNION ALL
      SELECT n.ticker, n.ts, n.i, e12 + (n.close - e12) * 2 / 13, e26 + (n.close - e26) * 2 / 27, e20 + (n.close - e20) * 2 / 21,
             up + (greatest(mv, 0) - up) / 14, dn + (greatest(-mv, 0) - dn) / 14,
             CASE WHEN n.i < 14 THEN NULL WHEN n.i = 14 THEN tr14 ELSE (atr * 13 + tr) / 14 END,
             CASE WHEN n.i = 2 THEN mv * volume ELSE fi + (mv * volume - fi) * 2 / 3 END
      FROM walk JOIN n ON n.ticker = walk.ticker AND n.i = walk.i + 1 JOIN seed ON seed.ticker = n.ticker)"""


@query(
    "t_recursive_indicators",
    "ticker:s ts:d rsi:f macd:f ema20:f atr:f force_index:f4",
    f"""WITH RECURSIVE {RECURSIVE} SELECT ticker, ts, CASE WHEN i >= 14 THEN CASE WHEN dn = 0 THEN 100 ELSE 100 - 100 / (1 + up / dn) END END AS rsi,
        CASE WHEN i >= 26 THEN e12 - e26 END AS macd, CASE WHEN i >= 20 THEN e20 END AS ema20, atr, CASE WHEN i >= 3 THEN fi END AS force_index FROM walk""",
)
def _(t):
    return te.recursive_indicators(fx.bars(t))


ADX = f"""{fx.BARS}, a AS (
      SELECT ticker, ts, row_number() OVER w AS i, coalesce(high - lag(high) OVER w, 0) AS up, coalesce(lag(low) OVER w - low, 0) AS dn,
             coalesce(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), high - low) AS tr,
             CASE WHEN count(*) OVER w10 = 10 THEN avg(close) OVER w10 END AS sma10, CASE WHEN count(*) OVER w50 = 50 THEN avg(close) OVER w50 END AS sma50
      FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts), w10 AS (PARTITION BY ticker ORDER BY ts ROWS 9 PRECEDING),
        w50 AS (PARTITION BY ticker ORDER BY ts ROWS 49 PRECEDING)),
    d AS (SELECT ticker, i, tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS plus, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS minus FROM a),
    smooth AS (
      SELECT ticker, 14::BIGINT AS i, avg(tr) AS r, avg(plus) AS p, avg(minus) AS m FROM d WHERE i <= 14 GROUP BY ticker HAVING count(*) = 14
      UNION ALL
      SELECT d.ticker, d.i, (r * 13 + tr) / 14, (p * 13 + plus) / 14, (m * 13 + minus) / 14 FROM smooth JOIN d ON d.ticker = smooth.ticker AND d.i = smooth.i + 1),
    x AS (SELECT ticker, i, CASE WHEN r > 0 AND p + m > 0 THEN 100 * abs(p - m) / (p + m) ELSE 0 END AS dx FROM smooth),
    mean AS (
      SELECT ticker, 27::BIGINT AS i, avg(dx) AS adx FROM x WHERE i <= 27 GROUP BY ticker HAVING count(*) = 14
      UNION ALL
      SELECT x.ticker, x.i, (adx * 13 + dx) / 14 FROM mean JOIN x ON x.ticker = mean.ticker AND x.i = mean.i + 1)"""


@query(
    "t5_t17_adx_and_phase",
    "ticker:s ts:d adx:f phase:s",
    f"""WITH RECURSIVE {ADX} SELECT a.ticker, ts, adx, CASE WHEN adx > 25 THEN CASE WHEN sma10 > sma50 THEN 'Bull' ELSE 'Bear' END ELSE 'Sideways' END AS phase
        FROM a LEFT JOIN mean ON mean.ticker = a.ticker AND mean.i = a.i""",
)
def _(t):
    bars = fx.bars(t)
    averages = te.technical_indicators(bars).select("ticker", "ts", "sma10", "sma50")
    joined = te.recursive_indicators(bars).join(averages, ["ticker", "ts"])
    return joined.withColumn("phase", te.market_phase(F.col("adx"), F.col("sma10"), F.col("sma50")))
