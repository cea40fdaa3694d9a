"""Labels and the flagship rank question."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query
from tickloom.functions.layout import DAILY, UNKNOWN, avg_rank
from tickloom.operators import exchange as ex
from tickloom.operators import labels as lb
from tickloom.operators.research import research_columns

RESEARCH = f"""{fx.BARS}, own AS (
      SELECT *, close / lag(close) OVER w - 1 AS lag_ret_1, close / lag(close, 3) OVER w - 1 AS ret_3,
             close / lag(close, 6) OVER w - 1 AS ret_6,
             greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
      FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
    own2 AS (
      SELECT * EXCLUDE (tr), CASE WHEN count(*) OVER w20 = 20 THEN ln(avg(tr) OVER w20 / close) END AS atr20_log,
             CASE WHEN count(*) OVER w30 = 30 THEN close / avg(close) OVER w30 - 1 END AS trend_30,
             CASE WHEN count(*) OVER w8 = 8 THEN avg(close) OVER w2 / avg(close) OVER w8 - 1 END AS trend_2h,
             CASE WHEN count(*) OVER b3 < 3 THEN NULL WHEN close > max(high) OVER b3 THEN 1.0
                  WHEN close < min(low) OVER b3 THEN -1.0 ELSE 0.0 END AS breakout_3bar,
             CASE WHEN count(lag_ret_1) OVER w5 = 5 THEN sum(sign(lag_ret_1)) OVER w5 / 5.0 END AS sign_persistence_5
      FROM own WINDOW w20 AS (PARTITION BY ticker ORDER BY ts ROWS 19 PRECEDING),
        w30 AS (PARTITION BY ticker ORDER BY ts ROWS 29 PRECEDING), w8 AS (PARTITION BY ticker ORDER BY ts ROWS 7 PRECEDING),
        w2 AS (PARTITION BY ticker ORDER BY ts ROWS 1 PRECEDING), w5 AS (PARTITION BY ticker ORDER BY ts ROWS 4 PRECEDING),
        b3 AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
    market AS (SELECT ts, avg(lag_ret_1) AS mkt_ret_1, avg(ret_3) AS mkt_ret_3, avg(ret_6) AS mkt_ret_6 FROM own2 GROUP BY ts),
    research AS (
      SELECT own2.*, mkt_ret_1, mkt_ret_3, mkt_ret_6, lag_ret_1 - mkt_ret_1 AS stock_minus_mkt_1,
             ret_3 - mkt_ret_3 AS stock_minus_mkt_3, ret_6 - mkt_ret_6 AS stock_minus_mkt_6,
             0.0008 + 0.25 * exp(greatest(least(coalesce(atr20_log, -20), 5), -20)) AS cost,
             CASE WHEN atr20_log IS NULL THEN 0 ELSE exp(greatest(least(atr20_log, 5), -20)) END AS atr
      FROM own2 LEFT JOIN market USING (ts))"""


@query(
    "research_columns",
    "ticker:s ts:d lag_ret_1:f ret_3:f ret_6:f atr20_log:f trend_30:f trend_2h:f breakout_3bar:f sign_persistence_5:f "
    "mkt_ret_1:f stock_minus_mkt_1:f stock_minus_mkt_3:f stock_minus_mkt_6:f",
    f"WITH {RESEARCH} SELECT * FROM research",
)
def _(t):
    return research_columns(fx.bars(t))


FORWARD = f"""{RESEARCH}, fwd AS (
      SELECT *, lead(close, 3) OVER w / close - 1 AS raw_fwd_ret_3,
             CASE WHEN count(mkt_ret_1) OVER a = 3 THEN sum(mkt_ret_1) OVER a END AS mkt_fwd_ret_3
      FROM research WINDOW w AS (PARTITION BY ticker ORDER BY ts),
        a AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))"""


@query(
    "l1_forward_returns",
    "ticker:s ts:d raw_fwd_ret_3:f mkt_fwd_ret_3:f alpha_fwd_3:f",
    f"WITH {FORWARD} SELECT *, raw_fwd_ret_3 - mkt_fwd_ret_3 AS alpha_fwd_3 FROM fwd",
)
def _(t):
    return lb.forward_returns(research_columns(fx.bars(t)), 3)


@query("l2_roundtrip_cost", "ticker:s ts:d cost:f", f"WITH {RESEARCH} SELECT ticker, ts, cost FROM research")
def _(t):
    panel = research_columns(fx.bars(t))
    return panel.select("ticker", "ts", lb.roundtrip_cost(panel).alias("cost"))


@query(
    "l3_cost_aware_direction",
    "ticker:s ts:d est_cost_3:f net_fwd_ret_3:f y_t1_dir_3:i",
    f"""WITH {FORWARD} SELECT *, cost AS est_cost_3, raw_fwd_ret_3 - cost AS net_fwd_ret_3,
        CASE WHEN raw_fwd_ret_3 - cost > 0.001 THEN 1 WHEN raw_fwd_ret_3 - cost < -0.001 THEN -1 ELSE 0 END AS y_t1_dir_3
        FROM fwd""",
)
def _(t):
    return lb.cost_aware_direction(lb.forward_returns(research_columns(fx.bars(t)), 3), 3, deadzone_bps=10)


@query(
    "l4_alpha_direction",
    "ticker:s ts:d net_alpha_fwd_3:f y_t2_dir_3:i",
    f"""WITH {FORWARD}, a AS (SELECT *, raw_fwd_ret_3 - mkt_fwd_ret_3 - cost AS net_alpha_fwd_3 FROM fwd)
        SELECT *, CASE WHEN net_alpha_fwd_3 > 0 THEN 1 WHEN net_alpha_fwd_3 < 0 THEN -1 ELSE 0 END AS y_t2_dir_3 FROM a""",
)
def _(t):
    return lb.alpha_direction(lb.forward_returns(research_columns(fx.bars(t)), 3), 3)


@query(
    "l5_opportunity",
    "ticker:s ts:d opp_score_3:f y_t3_opp_3:i",
    f"""WITH {FORWARD} SELECT *, abs(raw_fwd_ret_3) - cost AS opp_score_3,
        CASE WHEN abs(raw_fwd_ret_3) - cost > 0.002 THEN 1 ELSE 0 END AS y_t3_opp_3 FROM fwd""",
)
def _(t):
    return lb.opportunity(lb.forward_returns(research_columns(fx.bars(t)), 3), 3, threshold_bps=20)


BARRIER = f"""{RESEARCH}, barrier AS (
      SELECT *, CASE WHEN lead(1, 4) OVER w IS NULL THEN 0 ELSE coalesce(
        CASE WHEN lead(high, 1) OVER w >= close * (1 + atr) THEN 1 WHEN lead(low, 1) OVER w <= close * (1 - atr) THEN -1 END,
        CASE WHEN lead(high, 2) OVER w >= close * (1 + atr) THEN 1 WHEN lead(low, 2) OVER w <= close * (1 - atr) THEN -1 END,
        CASE WHEN lead(high, 3) OVER w >= close * (1 + atr) THEN 1 WHEN lead(low, 3) OVER w <= close * (1 - atr) THEN -1 END,
        CASE WHEN lead(high, 4) OVER w >= close * (1 + atr) THEN 1 WHEN lead(low, 4) OVER w <= close * (1 - atr) THEN -1 END,
        0) END AS y_t4_tb_4
      FROM research WINDOW w AS (PARTITION BY ticker ORDER BY ts))"""


@query("l6_triple_barrier", "ticker:s ts:d y_t4_tb_4:i", f"WITH {BARRIER} SELECT * FROM barrier")
def _(t):
    return lb.triple_barrier(research_columns(fx.bars(t)), 4)


@query(
    "l7_barrier_up_first",
    "ticker:s ts:d y_t4_upfirst_4:i",
    f"WITH {BARRIER} SELECT *, CASE WHEN y_t4_tb_4 > 0 THEN 1 ELSE 0 END AS y_t4_upfirst_4 FROM barrier",
)
def _(t):
    return lb.up_first(lb.triple_barrier(research_columns(fx.bars(t)), 4), 4)


RELATIVE = f"""{fx.BARS}, fwd_own AS (
      SELECT *, lead(close, 3) OVER (PARTITION BY ticker ORDER BY ts) / close - 1 AS raw_fwd_ret_xs_3 FROM bars),
    relative AS (
      SELECT *, raw_fwd_ret_xs_3 - avg(raw_fwd_ret_xs_3) OVER (PARTITION BY ts) AS xs_rel_fwd_ret_3 FROM fwd_own)"""


@query(
    "l8_relative_forward_return",
    "ticker:s ts:d raw_fwd_ret_xs_3:f xs_rel_fwd_ret_3:f",
    f"WITH {RELATIVE} SELECT * FROM relative",
)
def _(t):
    return lb.relative_forward_return(fx.bars(t), 3)


PROXY = f"""{RESEARCH}, scored AS (
      SELECT *, 1.5 * coalesce(trend_30, 0) + 1.0 * coalesce(trend_2h, 0) + 2.0 * coalesce(stock_minus_mkt_3, 0)
             + coalesce(stock_minus_mkt_1, 0) + 0.75 * coalesce(breakout_3bar, 0) + 0.5 * coalesce(sign_persistence_5, 0) AS score
      FROM research),
    proxied AS (SELECT *, CASE WHEN score > 0.001 THEN 1.0 WHEN score < -0.001 THEN -1.0 ELSE 0.0 END AS direction FROM scored)"""


@query("l9_direction_proxy", "ticker:s ts:d direction:f", f"WITH {PROXY} SELECT * FROM proxied")
def _(t):
    panel = research_columns(fx.bars(t))
    return panel.select("ticker", "ts", lb.direction_proxy(panel).alias("direction"))


# One row per (entry, step); the first step that touches a barrier decides.
OUTCOME = f"""{PROXY}, numbered AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS i,
             count(*) OVER (PARTITION BY ticker) AS n FROM proxied),
    steps AS (
      SELECT e.ticker, e.ts, e.i, e.close AS entry, e.atr, e.direction AS dir, e.cost, f.i - e.i AS step, f.close AS fclose,
             CASE WHEN e.direction > 0 THEN f.high / e.close - 1 ELSE -(f.low / e.close - 1) END AS good,
             CASE WHEN e.direction > 0 THEN f.low / e.close - 1 ELSE -(f.high / e.close - 1) END AS bad
      FROM numbered e JOIN numbered f ON e.ticker = f.ticker AND f.i BETWEEN e.i + 1 AND e.i + 5
      WHERE e.i + 5 <= e.n AND e.direction <> 0),
    ends AS (
      SELECT ticker, ts, min(step) FILTER (good >= atr OR bad <= -atr) AS hit FROM steps GROUP BY 1, 2),
    outcome AS (
      SELECT s.ticker, s.ts, any_value(entry) AS entry, any_value(atr) AS atr, any_value(dir) AS dir, any_value(cost) AS cost,
             any_value(hit) AS hit, max(CASE WHEN step = hit AND good >= atr THEN step END) AS tt,
             max(CASE WHEN step = hit AND bad <= -atr THEN step END) AS st,
             least(min(CASE WHEN hit IS NULL OR step <= hit THEN bad END), 0) AS mae,
             greatest(max(CASE WHEN hit IS NULL OR step <= hit THEN good END), 0) AS mfe,
             max(CASE WHEN step = 5 THEN dir * (fclose / entry - 1) END) AS timeout
      FROM steps s JOIN ends USING (ticker, ts) GROUP BY 1, 2),
    settled AS (
      SELECT *, tt IS NOT NULL AND st IS NULL AS won, st IS NOT NULL AS lost,
             CASE WHEN tt IS NOT NULL AND st IS NULL THEN atr WHEN st IS NOT NULL THEN -atr ELSE timeout END - cost AS payoff
      FROM outcome)"""


@query(
    "l10_event_outcomes",
    "ticker:s ts:d event_direction_5:f y_t7_target_before_stop_5:f y_t8_clean_target_before_stop_5:f event_path_payoff_5:f "
    "event_barrier_outcome_5:f time_to_target_5:f time_to_stop_5:f mae_before_resolution_5:f mfe_before_resolution_5:f "
    "clean_event_path_payoff_5:f",
    f"""WITH {OUTCOME} SELECT p.ticker, p.ts, p.direction AS event_direction_5, CAST(won AS INT) AS y_t7_target_before_stop_5,
        CAST(won AND mae >= -0.5 * s.atr AND tt <= 3 AS INT) AS y_t8_clean_target_before_stop_5, payoff AS event_path_payoff_5,
        CASE WHEN won THEN 1 WHEN lost THEN -1 WHEN s.ticker IS NOT NULL THEN 0 END AS event_barrier_outcome_5,
        tt AS time_to_target_5, st AS time_to_stop_5, mae AS mae_before_resolution_5, mfe AS mfe_before_resolution_5,
        payoff - 0.25 * abs(mae) AS clean_event_path_payoff_5
        FROM proxied p LEFT JOIN settled s USING (ticker, ts)""",
)
def _(t):
    return lb.event_outcomes(research_columns(fx.bars(t)), 5)


@query(
    "l11_future_direction",
    "ticker:s ts:d future_return:f label_up:i",
    f"""WITH {fx.BARS} SELECT ticker, ts, lead(close, 5) OVER w / close - 1 AS future_return,
        CASE WHEN lead(close, 5) OVER w / close - 1 > 0 THEN 1 ELSE 0 END AS label_up
        FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts)""",
)
def _(t):
    return lb.future_direction(fx.bars(t), 5)


@query(
    "f5_move_size_filter",
    "ticker:s ts:d future_return:f label_up:i",
    f"""WITH {fx.BARS}, f AS (SELECT ticker, ts, lead(close, 5) OVER (PARTITION BY ticker ORDER BY ts) / close - 1 AS future_return FROM bars)
        SELECT *, CASE WHEN future_return > 0 THEN 1 ELSE 0 END AS label_up FROM f WHERE abs(future_return) >= 0.02""",
)
def _(t):
    return lb.future_direction(fx.bars(t), 5, min_move=0.02)


@query(
    "l12_next_row_return",
    "ticker:s ts:d target:f",
    f"WITH {fx.BARS} SELECT ticker, ts, lead(close) OVER (PARTITION BY ticker ORDER BY ts) / close - 1 AS target FROM bars",
)
def _(t):
    return lb.next_row_return(fx.bars(t))


@query(
    "l13_label_shuffle_multiset",
    "ticker:s n:i total:f low:f high:f",
    f"""WITH {fx.BARS} SELECT ticker, count(*) AS n, sum(close) AS total, min(close) AS low, max(close) AS high FROM bars GROUP BY 1""",
)
def _(t):
    """Permuted labels keep every ticker's multiset of values."""
    moved = lb.shuffle_within(fx.bars(t).select("ticker", "ts", "close"), "close", shape=DAILY)
    return moved.groupBy("ticker").agg(
        F.count("close").alias("n"), F.sum("close").alias("total"), F.min("close").alias("low"), F.max("close").alias("high")
    )


@query(
    "l13_label_shuffle",
    "ticker:s ts:d close:f",
    f"""WITH {fx.BARS}, n AS MATERIALIZED (SELECT ticker, ts, close, {fx.draw_sql('42', 'ticker', 'ts')} AS d FROM bars)
        SELECT ticker, unnest(list(ts ORDER BY ts)) AS ts, unnest(list(close ORDER BY d, ts)) AS close FROM n GROUP BY ticker""",
)
def _(t):
    return lb.shuffle_within(fx.bars(t).select("ticker", "ts", "close"), "close", shape=DAILY)


@query(
    "l14_path_shuffle_ends",
    "ticker:s n:i first_close:f last_close:f3",
    f"""WITH {fx.BARS} SELECT ticker, count(*) AS n, arg_min(close, ts) AS first_close, arg_max(close, ts) AS last_close
        FROM bars GROUP BY 1""",
)
def _(t):
    """A permuted path starts and ends where the real one does."""
    path = lb.shuffle_path(fx.bars(t), shape=DAILY)
    return path.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("close", "ts").alias("first_close"), F.max_by("close", "ts").alias("last_close")
    )


@query(
    "l14_path_shuffle",
    "ticker:s ts:d open:f3 high:f3 low:f3 close:f3",
    f"""WITH {fx.BARS}, r AS (SELECT *, close / lag(close) OVER w - 1 AS ret, row_number() OVER w - 1 AS i FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
        n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY {fx.draw_sql('42', 'ticker', 'ts')}, ts) AS j FROM r WHERE i > 0),
        starts AS (SELECT ticker, arg_min(close, ts) AS start, quantile_cont(abs(high - low), 0.5) AS mid FROM bars GROUP BY 1),
        moved AS (SELECT a.ticker, a.ts, abs(a.high - a.low) AS width, b.ret FROM n a JOIN n b ON a.ticker = b.ticker AND a.i = b.j
                  UNION ALL SELECT ticker, ts, abs(high - low), 0.0::DOUBLE FROM r WHERE i = 0),
        grown AS (SELECT *, product(1 + ret) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM moved),
        priced AS (SELECT ticker, ts, coalesce(nullif(width, 0), mid) / 2 AS half, greatest(1e-9, start * g) AS close FROM grown JOIN starts USING (ticker)),
        opened AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY ticker ORDER BY ts), close) AS open FROM priced)
        SELECT ticker, ts, open, greatest(open, close) + half AS high, least(open, close) - half AS low, close FROM opened""",
)
def _(t):
    return lb.shuffle_path(fx.bars(t), shape=DAILY)


@query(
    "l15_target_router",
    "ticker:s ts:d label:f realised:f",
    f"""WITH {BARRIER} SELECT ticker, ts, CASE WHEN y_t4_tb_4 > 0 THEN 1 ELSE 0 END AS label,
        lead(close, 4) OVER (PARTITION BY ticker ORDER BY ts) / close - 1 - cost AS realised FROM barrier""",
)
def _(t):
    experiment = lb.Experiment("E0", "T4", 4, "binary", ("F1_TrendMomentum",), "logistic")
    label, realised = lb.target_columns(experiment)
    panel = lb.all_targets(research_columns(fx.bars(t)), 4)
    return panel.select("ticker", "ts", F.col(label).alias("label"), F.col(realised).alias("realised"))


SPREAD = f"""{RELATIVE}, mom AS (
      SELECT *, close / lag(close, 60) OVER (PARTITION BY ticker ORDER BY ts) - 1 AS mom60 FROM relative),
    by_date AS (
      SELECT *, (rank() OVER (PARTITION BY ts ORDER BY mom60) + (count(*) OVER (PARTITION BY ts, mom60) - 1) / 2)
             / count(*) OVER (PARTITION BY ts) AS score
      FROM mom WHERE mom60 IS NOT NULL AND xs_rel_fwd_ret_3 IS NOT NULL),
    pooled AS (
      SELECT *, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2) / count(*) OVER () AS pct FROM by_date)"""


@query(
    "momentum_rank_spread",
    "rows:i top_decile:f bottom_decile:f spread:f",
    f"""WITH {SPREAD} SELECT count(*) AS rows, avg(xs_rel_fwd_ret_3) FILTER (pct >= 0.9) AS top_decile,
        avg(xs_rel_fwd_ret_3) FILTER (pct <= 0.1) AS bottom_decile,
        avg(xs_rel_fwd_ret_3) FILTER (pct >= 0.9) - avg(xs_rel_fwd_ret_3) FILTER (pct <= 0.1) AS spread FROM pooled""",
)
def _(t):
    """60-bar momentum, ranked by date, against the three-bar relative return."""
    from tickloom.operators.metrics import decile_spread

    panel = lb.relative_forward_return(ex.momentum(fx.bars(t), 60), 3).filter(
        F.col("ret60").isNotNull() & F.col("xs_rel_fwd_ret_3").isNotNull()
    )
    # tickers per date cannot exceed the supplier table, whose size is checked here
    shape = UNKNOWN
    ranked = avg_rank(panel.select("ts", "ret60", "xs_rel_fwd_ret_3"), "ret60", ["ts"], "score", pct=True, shape=shape)
    return decile_spread(ranked, "score", "xs_rel_fwd_ret_3").select(
        F.col("trade_count").alias("rows"), "top_decile", "bottom_decile", "spread"
    )
