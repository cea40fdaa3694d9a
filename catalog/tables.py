"""Cleaning, joins, roll-ups and splits."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.exchange import VIX_CONTEXT
from catalog.labels import FORWARD, OUTCOME, RESEARCH
from catalog.registry import query
from tickloom.functions.layout import CALENDAR, DAILY
from tickloom.operators import cleaning as cl
from tickloom.operators import exchange as ex
from tickloom.operators import joins as jn
from tickloom.operators import labels as lb
from tickloom.operators import rollups as ru
from tickloom.operators import splits as sp
from tickloom.operators.research import research_columns


@query(
    "f1_regime_filter",
    "ticker:s ts:d trend_30:f lag_ret_1:f",
    f"WITH {RESEARCH} SELECT * FROM research WHERE coalesce(trend_30 > 0.01 AND abs(lag_ret_1) < 0.05, false)",
)
def _(t):
    return cl.regime_filter(research_columns(fx.bars(t)), "trend_30 > 0.01 and abs(lag_ret_1) < 0.05")


@query(
    "f1_regime_filter_unknown_column",
    "ticker:s ts:d close:f8",
    f"WITH {fx.BARS} SELECT * FROM bars",
)
def _(t):
    return cl.regime_filter(fx.bars(t), "no_such_column > 0 and close > 1000")


@query(
    "f2_family_projection",
    "ticker:s ts:d atr20_log:f lag_ret_1:f trend_30:f",
    f"WITH {RESEARCH} SELECT * FROM research",
)
def _(t):
    families = {"trend": ["lag_ret_1", "trend_30", "absent"], "risk": ["atr20_log"]}
    return cl.select_families(research_columns(fx.bars(t)), families, ["trend", "risk"], ["ticker", "ts"])


@query(
    "f3_clean_xy",
    "ticker:s ts:d atr20_log:f trend_30:f",
    f"WITH {RESEARCH} SELECT * FROM research WHERE atr20_log IS NOT NULL AND trend_30 IS NOT NULL",
)
def _(t):
    return cl.clean_xy(research_columns(fx.bars(t)), ["atr20_log", "trend_30"])


@query(
    "f4_numeric_coercion",
    "o_orderkey:i value:f absent:f",
    "SELECT o_orderkey, coalesce(try_cast(split_part(o_orderpriority, '-', 2) AS DOUBLE), try_cast(split_part(o_orderpriority, '-', 1) AS DOUBLE)) AS value, 7.5 AS absent FROM orders",
)
def _(t):
    frame = t.orders.select("o_orderkey", F.split("o_orderpriority", "-")[1].alias("word"), F.split("o_orderpriority", "-")[0].alias("digit"))
    return frame.select(
        "o_orderkey",
        F.coalesce(F.col("word").try_cast("double"), cl.numeric(frame, "digit")).alias("value"),
        cl.numeric(frame, "nowhere", 7.5).alias("absent"),
    )


@query(
    "f6_last_rows_per_ticker",
    "ticker:s ts:d close:f8",
    f"WITH {fx.BARS} SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) <= 50",
)
def _(t):
    return cl.tail_rows(fx.bars(t), 50)


@query(
    "f7_warmup_drop",
    "ticker:s ts:d close:f8",
    f"""WITH {fx.BARS} SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts) > 60
        AND count(*) OVER (PARTITION BY ticker) >= 260""",
)
def _(t):
    return cl.drop_warmup(fx.bars(t))


SPARSE = f"{fx.BARS}, sparse AS (SELECT ticker, ts, CASE WHEN volume >= 25 THEN close END AS v FROM bars)"


def _sparse(t):
    return fx.bars(t).select("ticker", "ts", F.when(F.col("volume") >= 25, F.col("close")).alias("v"))


@query(
    "f8_forward_fill_zero",
    "ticker:s ts:d v:f8",
    f"""WITH {SPARSE} SELECT ticker, ts, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts
        ROWS UNBOUNDED PRECEDING), 0) AS v FROM sparse""",
)
def _(t):
    return cl.fill(_sparse(t), ["v"], "ffill_zero")


@query(
    "f9_forward_back_fill",
    "ticker:s ts:d v:f8",
    f"""WITH {SPARSE} SELECT ticker, ts, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts
        ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM sparse""",
)
def _(t):
    return cl.fill(_sparse(t), ["v"], "ffill_bfill")


@query(
    "f10_symbol_normalise",
    "symbol:s lookup_symbol:s",
    f"WITH {fx.SYMBOLS} SELECT DISTINCT symbol, symbol AS lookup_symbol FROM symbols",
)
def _(t):
    return cl.normalise_symbols(fx.symbols(t))


@query(
    "f11_weekday_calendar",
    "trade_date:d",
    """SELECT d AS trade_date FROM (SELECT CAST(unnest(generate_series(min(l_shipdate), max(l_shipdate), INTERVAL 1 DAY)) AS DATE) AS d
       FROM lineitem) WHERE isodow(d) <= 5""",
)
def _(t):
    bounds = t.lineitem.agg(F.to_date(F.min("l_shipdate")).alias("start"), F.to_date(F.max("l_shipdate")).alias("end"))
    return cl.weekdays(bounds)


@query(
    "f12_session_status",
    "event_id:i trade_date:d is_weekday:b is_holiday:b is_in_time:b is_open:b reason:s",
    """WITH l AS (SELECT event_id, ts + INTERVAL 330 MINUTE AS lt FROM events),
       c AS (SELECT event_id, CAST(lt AS DATE) AS trade_date, isodow(lt) <= 5 AS is_weekday,
             CAST(lt AS DATE) IN (SELECT CAST(ts AS DATE) FROM events WHERE event_id % 4000 = 0) AS is_holiday,
             CAST(lt AS TIME) BETWEEN TIME '09:10:00' AND TIME '15:35:00' AS is_in_time FROM l)
       SELECT *, is_weekday AND NOT is_holiday AND is_in_time AS is_open,
              CASE WHEN is_holiday THEN 'configured_holiday' WHEN NOT is_weekday THEN 'non_trading_weekday'
                   WHEN NOT is_in_time THEN 'outside_session_time' ELSE 'market_session_open' END AS reason FROM c""",
)
def _(t):
    stamped = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    holidays = t.events.filter("event_id % 4000 = 0").select(F.to_date("ts").alias("date"))
    return cl.session_status(stamped, "ts", holidays)


@query(
    "f13_symbol_cap",
    "configured_symbols:i cap:i status:s",
    f"""WITH {fx.SYMBOLS} SELECT count(DISTINCT symbol) AS configured_symbols, 33 AS cap,
        CASE WHEN count(DISTINCT symbol) <= 33 THEN 'within_cap' ELSE 'cap_exceeded' END AS status FROM symbols""",
)
def _(t):
    return cl.symbol_cap(cl.normalise_symbols(fx.symbols(t)), 33)


@query(
    "j1_asof_backward",
    "event_id:i matched_ts:t value:f",
    """SELECT l.event_id, r.ts AS matched_ts, r.value FROM (SELECT * FROM events WHERE event_type = 'purchase') l
       ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) r
       ON l.user_id = r.user_id AND l.ts >= r.ts""",
)
def _(t):
    stamped = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    bought = stamped.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = stamped.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return jn.asof_join(bought, seen, "ts", "ts", ["user_id"], ["value"])


@query(
    "j1_asof_index_context",
    "dt:d matched_dt:d vix:f",
    f"""WITH {fx.SPOT}, {fx.VIX} SELECT s.dt, v.dt AS matched_dt, v.vix FROM spot s ASOF LEFT JOIN vix v ON s.dt >= v.dt""",
)
def _(t):
    return jn.asof_join(fx.spot(t).select("dt"), fx.vix(t), "dt", "dt", shape=CALENDAR)


@query(
    "j3_left_enrichment",
    "ticker:s ts:d close:f8 mkt_ret_1:f",
    f"WITH {RESEARCH} SELECT * FROM research",
)
def _(t):
    return research_columns(fx.bars(t))


@query(
    "j5_shortlist_merge_back",
    "experiment_id:s eligible:b rank:f",
    f"""WITH {fx.COMPARE}, e AS (SELECT *, gap_auc > 0 AND gap_balanced_accuracy > 0 AS eligible FROM compare)
        SELECT experiment_id, eligible, CASE WHEN eligible THEN row_number() OVER (PARTITION BY eligible
        ORDER BY gap_auc DESC, real_trade_count DESC, experiment_id) END AS rank FROM e""",
)
def _(t):
    from tickloom.operators.selection import rank_eligible

    flagged = fx.compare(t).withColumn("eligible", (F.col("gap_auc") > 0) & (F.col("gap_balanced_accuracy") > 0))
    return rank_eligible(flagged, ["gap_auc", "real_trade_count"], "rank")


@query(
    "j6_semi_join",
    "ticker:s ts:d close:f8",
    f"""WITH {fx.BARS} SELECT * FROM bars WHERE ts IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def _(t):
    days = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("ts"))
    return jn.keep_keys(fx.bars(t), days, ["ts"])


@query(
    "j7_coverage",
    "symbol:s events:i covered:b",
    f"""WITH {fx.EARNINGS}, {fx.OPEN_INTEREST}, n AS (SELECT symbol, count(*) AS events FROM earnings GROUP BY 1)
        SELECT *, symbol IN (SELECT symbol FROM oi) AS covered FROM n""",
)
def _(t):
    counted = fx.earnings(t).groupBy("symbol").agg(F.count(F.lit(1)).alias("events"))
    return jn.covered(counted, fx.open_interest(t), "symbol")


@query(
    "j7_missing_keys",
    "dt:d",
    f"WITH {fx.VIX}, {fx.SPOT} SELECT dt FROM vix WHERE dt NOT IN (SELECT dt FROM spot)",
)
def _(t):
    return jn.missing_keys(fx.vix(t), fx.spot(t), "dt")


@query(
    "j8_date_intersection",
    "trade_date:d expiry:d spot:f spot_expiry:f",
    f"""WITH {fx.SPOT}, {fx.CHAIN}, days AS (SELECT DISTINCT trade_date, expiry FROM chain)
        SELECT trade_date, expiry, s.spot, e.spot AS spot_expiry FROM days JOIN spot s ON s.dt = trade_date JOIN spot e ON e.dt = expiry""",
)
def _(t):
    days = fx.chain(t).select("trade_date", "expiry").distinct()
    index = fx.spot(t)
    return days.join(index.withColumnRenamed("dt", "trade_date"), "trade_date").join(
        index.select(F.col("dt").alias("expiry"), F.col("spot").alias("spot_expiry")), "expiry"
    )


RESOLVED = f"""{fx.SYMBOLS}, {fx.INSTRUMENTS}, cash AS (
      SELECT * FROM instruments WHERE instrument_type = 'EQ' OR segment = exchange OR segment = exchange || '-EQ'),
    asked AS (SELECT symbol, unnest(['NSE', 'BSE']) AS exchange FROM symbols),
    resolved AS (
      SELECT a.symbol AS requested_symbol, a.exchange,
             coalesce(CASE WHEN a.exchange = 'BSE' THEN i.tradingsymbol END, m.tradingsymbol) AS tradingsymbol,
             coalesce(CASE WHEN a.exchange = 'BSE' THEN i.instrument_token END, m.instrument_token) AS instrument_token,
             CASE WHEN coalesce(CASE WHEN a.exchange = 'BSE' THEN i.tradingsymbol END, m.tradingsymbol) IS NULL
                  THEN 'cash_equity_not_found' END AS reason, coalesce(n.isin, '') AS source_isin
      FROM asked a LEFT JOIN cash n ON n.exchange = 'NSE' AND n.tradingsymbol = a.symbol
      LEFT JOIN cash m ON m.exchange = a.exchange AND m.tradingsymbol = a.symbol
      LEFT JOIN cash i ON i.exchange = a.exchange AND i.isin = n.isin AND n.isin <> '')"""


@query(
    "j9_instrument_resolution",
    "requested_symbol:s exchange:s tradingsymbol:s instrument_token:f reason:s source_isin:s",
    f"WITH {RESOLVED} SELECT * FROM resolved",
)
def _(t):
    return jn.resolve_instruments(cl.normalise_symbols(fx.symbols(t)), fx.instruments(t))


@query(
    "j10_leg_pick",
    "trade_date:d call_strike:f call_close:f6 put_strike:f near_strike:f",
    f"""WITH {fx.SPOT}, {fx.CHAIN}, t AS (SELECT DISTINCT trade_date, expiry, s.spot FROM chain JOIN spot s ON s.dt = trade_date)
        SELECT t.trade_date, min(strike) FILTER (option_typ = 'CE' AND contracts > 0 AND strike >= spot * 1.02) AS call_strike,
          arg_min(close, strike) FILTER (option_typ = 'CE' AND contracts > 0 AND strike >= spot * 1.02) AS call_close,
          max(strike) FILTER (option_typ = 'PE' AND contracts > 0 AND strike <= spot * 0.98) AS put_strike,
          arg_min(strike, row(abs(strike - spot), strike)) FILTER (option_typ = 'CE') AS near_strike
        FROM t LEFT JOIN chain c ON c.trade_date = t.trade_date AND c.expiry = t.expiry AND close > 0 GROUP BY 1, t.spot""",
)
def _(t):
    chain = fx.chain(t)
    targets = (
        chain.select("trade_date", "expiry").distinct().join(fx.spot(t).withColumnRenamed("dt", "trade_date"), "trade_date")
        .select("*", (F.col("spot") * 1.02).alias("above"), (F.col("spot") * 0.98).alias("below"))
    )
    out = jn.pick_leg(targets, chain, "CE", "above", "up", "call")
    out = jn.pick_leg(out, chain, "PE", "below", "down", "put")
    return jn.pick_leg(out, chain, "CE", "spot", "nearest", "near", require_traded=False)


@query(
    "j11_variant_grid",
    "dt:d borrow:f slippage:f cost:f",
    f"""WITH {fx.VIX} SELECT dt, borrow, slippage, vix * borrow / 365 + slippage / 10000 AS cost
        FROM vix, (SELECT unnest([0.02, 0.05, 0.1]::DOUBLE[]) AS borrow), (SELECT unnest([10, 25, 50]::DOUBLE[]) AS slippage)""",
)
def _(t):
    grid = jn.expand_grid(fx.vix(t), borrow=[0.02, 0.05, 0.10], slippage=[10.0, 25.0, 50.0])
    return grid.withColumn("cost", F.col("vix") * F.col("borrow") / 365 + F.col("slippage") / 10000)


@query(
    "a1_group_count",
    "ticker:s window_id:i rows:i",
    f"WITH {fx.BARS}, {fx.DAY_WINDOWS} SELECT ticker, window_id, count(*) AS rows FROM bars JOIN day_windows USING (ts) GROUP BY 1, 2",
)
def _(t):
    return ru.group_count(fx.bars(t).join(F.broadcast(fx.windows_of_days(t)), "ts"))


@query(
    "a2_label_sanity",
    "label:s horizon:i mean:f median:f",
    f"""WITH {FORWARD}, v AS (
          SELECT 'raw_fwd_ret_3' AS label, raw_fwd_ret_3 AS x FROM fwd UNION ALL SELECT 'net_fwd_ret_3', raw_fwd_ret_3 - cost FROM fwd
          UNION ALL SELECT 'alpha_fwd_3', raw_fwd_ret_3 - mkt_fwd_ret_3 FROM fwd
          UNION ALL SELECT 'net_alpha_fwd_3', raw_fwd_ret_3 - mkt_fwd_ret_3 - cost FROM fwd
          UNION ALL SELECT 'opp_score_3', abs(raw_fwd_ret_3) - cost FROM fwd UNION ALL SELECT 'est_cost_3', cost FROM fwd)
        SELECT label, 3 AS horizon, avg(x) AS mean, median(x) AS median FROM v GROUP BY 1""",
)
def _(t):
    out = lb.forward_returns(research_columns(fx.bars(t)), 3)
    out = lb.opportunity(lb.alpha_direction(lb.cost_aware_direction(out, 3), 3), 3)
    return ru.label_sanity(out, 3)


@query(
    "a2_outcome_sanity",
    "label:s horizon:i mean:f median:f",
    f"""WITH {OUTCOME}, v AS (
          SELECT 'event_path_payoff_5' AS label, true AS paid, payoff AS x FROM settled
          UNION ALL SELECT 'clean_event_path_payoff_5', true, payoff - 0.25 * abs(mae) FROM settled
          UNION ALL SELECT 'y_t7_target_before_stop_5', false, CAST(won AS INT) FROM settled
          UNION ALL SELECT 'y_t8_clean_target_before_stop_5', false, CAST(won AND mae >= -0.5 * atr AND tt <= 3 AS INT) FROM settled
          UNION ALL SELECT 'time_to_target_5', false, tt FROM settled UNION ALL SELECT 'time_to_stop_5', false, st FROM settled
          UNION ALL SELECT 'mae_before_resolution_5', false, mae FROM settled)
        SELECT label, 5 AS horizon, avg(x) AS mean, CASE WHEN any_value(paid) THEN median(x) END AS median FROM v GROUP BY 1""",
)
def _(t):
    return ru.label_sanity(lb.event_outcomes(research_columns(fx.bars(t)), 5), 5)


@query(
    "a5_daily_last",
    "ticker:s trade_date:d close:f6",
    f"WITH {fx.QUARTER_BARS} SELECT ticker, CAST(ts AS DATE) AS trade_date, arg_max(close, ts) AS close FROM quarter_bars GROUP BY 1, 2",
)
def _(t):
    return ru.daily_last(fx.quarter_bars(t))


@query(
    "a12_exact_quantile",
    "sector:i q0:f q1:f q2:f",
    f"""WITH {fx.BARS}, {fx.SECTORS} SELECT sector, quantile_cont(volume, 0.33) AS q0, quantile_cont(volume, 0.5) AS q1,
        quantile_cont(volume, 0.9) AS q2 FROM bars JOIN sectors USING (ticker) GROUP BY 1""",
)
def _(t):
    return ru.exact_quantiles(fx.bars(t).join(fx.sectors(t), "ticker"), "volume", [0.33, 0.5, 0.9], ["sector"])


@query(
    "a13_empirical_percentile",
    "ticker:s share_below:f",
    f"""WITH {fx.BARS}, l AS (SELECT *, arg_max(close, ts) OVER (PARTITION BY ticker) AS actual FROM bars)
        SELECT ticker, avg(CASE WHEN close < actual THEN 1.0::DOUBLE ELSE 0 END) AS share_below FROM l GROUP BY 1""",
)
def _(t):
    bars = fx.bars(t).select("ticker", "ts", "close")
    actual = bars.groupBy("ticker").agg(F.max_by("close", "ts").alias("actual"))
    return bars.join(actual, "ticker").groupBy("ticker").agg(
        ru.empirical_percentile(bars, "close", F.col("actual")).alias("share_below")
    )


@query(
    "a16_union_of_runs",
    "source:s rows:i with_iv:i",
    f"""WITH {fx.SPOT}, {fx.VIX} SELECT 'spot' AS source, count(*) AS rows, 0 AS with_iv FROM spot
        UNION ALL SELECT 'vix', count(*), count(vix) FROM vix""",
)
def _(t):
    both = ru.union_runs(
        fx.spot(t).withColumn("source", F.lit("spot")), fx.vix(t).withColumn("source", F.lit("vix"))
    )
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count("vix").alias("with_iv"))


@query(
    "a17_distinct_keep_last",
    "l_suppkey:i l_partkey:i l_quantity:f",
    """SELECT l_suppkey, arg_max(l_partkey, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity)) AS l_partkey,
       arg_max(l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity)) AS l_quantity FROM lineitem GROUP BY 1""",
)
def _(t):
    slim = t.lineitem.select("l_suppkey", "l_partkey", "l_quantity", "l_shipdate", "l_orderkey", "l_linenumber")
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")]
    return cl.keep_last(slim, ["l_suppkey"], order)


@query(
    "s13_archive_by_day",
    "trade_date:d rows:i traded_rows:i strikes:i contracts:i open_int:i max_close:f",
    f"""WITH {fx.SPOT}, {fx.CHAIN} SELECT trade_date, count(*) AS rows, count(*) FILTER (contracts > 0) AS traded_rows,
        count(DISTINCT strike) AS strikes, sum(contracts) AS contracts, sum(open_int) AS open_int, max(close) AS max_close
        FROM chain GROUP BY 1""",
)
def _(t):
    return ru.archive_summary(fx.chain(t))


@query(
    "s13_archive_by_expiry",
    "expiry:d rows:i traded_rows:i strikes:i contracts:i open_int:i max_close:f",
    f"""WITH {fx.SPOT}, {fx.CHAIN} SELECT expiry, count(*) AS rows, count(*) FILTER (contracts > 0) AS traded_rows,
        count(DISTINCT strike) AS strikes, sum(contracts) AS contracts, sum(open_int) AS open_int, max(close) AS max_close
        FROM chain GROUP BY 1""",
)
def _(t):
    return ru.archive_summary(fx.chain(t), ["expiry"])


@query(
    "p1_adjacent_pairs",
    "train_window_id:i test_window_id:i",
    f"""WITH {fx.DAY_WINDOWS} SELECT * FROM (SELECT window_id AS train_window_id, lead(window_id) OVER (ORDER BY window_id) AS test_window_id
        FROM (SELECT DISTINCT window_id FROM day_windows)) WHERE test_window_id IS NOT NULL""",
)
def _(t):
    return sp.adjacent_pairs(fx.windows_of_days(t))


@query(
    "p2_rolling_windows",
    "ticker:s ts:d window_id:i start_idx:i segment:s",
    f"""WITH {fx.BARS}, n AS (SELECT ticker, ts, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS i,
          count(*) OVER (PARTITION BY ticker) AS n FROM bars)
        SELECT ticker, ts, k + 1 AS window_id, k * 80 AS start_idx,
          CASE WHEN i - k * 80 < 200 THEN 'train' WHEN i - k * 80 < 280 THEN 'val' ELSE 'test' END AS segment
        FROM n, (SELECT unnest(range(0, 200)) AS k) WHERE k * 80 + 360 <= n AND i >= k * 80 AND i < k * 80 + 360""",
)
def _(t):
    return sp.rolling_windows(fx.bars(t).select("ticker", "ts"), train=200, val=80, test=80, step=80)


@query(
    "p3_chronological_split",
    "ticker:s ts:d segment:s",
    f"""WITH {fx.BARS} SELECT ticker, ts, CASE WHEN row_number() OVER (ORDER BY ts, ticker) <= floor(count(*) OVER () * 0.7)
        THEN 'train' ELSE 'test' END AS segment FROM bars""",
)
def _(t):
    return sp.chrono_split(fx.bars(t).select("ticker", "ts"), 0.7)


@query(
    "p4_date_folds",
    "ts:d fold_id:i",
    f"WITH {fx.DAY_WINDOWS} SELECT ts, window_id AS fold_id FROM day_windows",
)
def _(t):
    return sp.date_folds(fx.bars(t), 10)


@query(
    "p5_leave_one_out",
    "fold:s test_rows:i train_rows:i",
    f"""WITH {fx.BARS} SELECT ticker AS fold, count(*) AS test_rows, (SELECT count(*) FROM bars) - count(*) AS train_rows
        FROM bars GROUP BY 1""",
)
def _(t):
    return sp.leave_one_out(fx.bars(t))


@query(
    "p6_fold_cases",
    "case_id:i fold_id:i role:s",
    """SELECT case_id, fold_id, CASE WHEN fold_id <= 4 + case_id THEN 'fit' ELSE 'oos' END AS role
       FROM (SELECT unnest(range(1, 5)) AS case_id), (SELECT DISTINCT ntile(10) OVER (ORDER BY ts) AS fold_id
             FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS ts FROM lineitem))""",
)
def _(t):
    folds = sp.date_folds(fx.bars(t), 10).select("fold_id").distinct()
    cases = [(list(range(1, cut + 1)), list(range(cut + 1, 11))) for cut in (5, 6, 7, 8)]
    return sp.fold_cases(folds, cases)
