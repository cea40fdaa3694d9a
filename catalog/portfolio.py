"""Rebalancing portfolios, overlays and audits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.exchange import BREADTH, EVENT_WINDOW, MARKET_RET, OI_NEAREST, REL_BREADTH, SPOT_CONTEXT
from catalog.labels import RESEARCH
from catalog.registry import query
from tickloom.functions import rolling as R
from tickloom.functions.layout import DAILY, over_series
from tickloom.functions.session import cut_lineage, stored
from tickloom.operators import exchange as ex
from tickloom.operators import portfolio as pf
from tickloom.operators.joins import asof_join
from tickloom.operators.research import research_columns
from tickloom.plans import audits as au


def groups(t) -> DataFrame:
    return fx.bars(t, fx.by_group(t))


def panel(t) -> DataFrame:
    """Daily bars of the groups with a 60-row momentum score, ATR and breadth by date: the columns the portfolios read.

    Bars are read by the score and by both breadth tables, the panel several times by every audit, so each is written once, as
    narrow as its readers allow; later readings take no exchange.
    """
    bars = stored(groups(t).select("ticker", "ts", "high", "low", "close"), "bars")
    own = research_columns(ex.momentum(bars, 60)).select("ticker", "ts", "close", "ret60", "atr20_log")
    # both breadth tables have one row per calendar day
    rel = ex.relative_breadth(bars, 3).select("ts", "breadth_rel_adv_frac")
    adv = ex.advance_fraction(bars).select(F.col("trade_date").alias("ts"), "breadth_adv_frac")
    return stored(own.join(F.broadcast(rel), "ts", "left").join(F.broadcast(adv), "ts", "left"), "panel")


CONTEXT = ["breadth_rel_adv_frac", "breadth_adv_frac"]


def events_and_folds(t) -> tuple[DataFrame, DataFrame]:
    """The audits' two inputs: one row per rebalance, one per fold. A few rows each, written once to the checkpoint
    folder, so the searches on top neither re-plan nor re-run the panel."""
    frame = panel(t)
    events = cut_lineage(pf.rebalance_events(frame, "ret60", 10, 30, 10, CONTEXT))
    return events, cut_lineage(pf.fold_table(frame, events))


SCHEDULE = """fold_days AS (SELECT ts, ntile(10) OVER (ORDER BY ts) AS fold_id FROM (SELECT DISTINCT ts FROM bars)),
    fold_calendar AS (
      SELECT fold_id, ts, row_number() OVER (PARTITION BY fold_id ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY fold_id) AS n
      FROM fold_days),
    schedule AS (
      SELECT a.fold_id, a.idx // 30 AS k, a.ts, b.ts AS next_ts FROM fold_calendar a
      JOIN fold_calendar b ON a.fold_id = b.fold_id AND b.idx = least(a.idx + 30, a.n - 1) WHERE a.idx % 30 = 0 AND a.idx < a.n - 1)"""

DAILY_GROUPS = RESEARCH.replace(fx.BARS, fx.GROUP_BARS)

EVENTS = f"""{DAILY_GROUPS}, {MARKET_RET}, {REL_BREADTH}, {SCHEDULE}, adv AS (
      SELECT ts, avg(CASE WHEN lag_ret_1 > 0 THEN 1.0::DOUBLE ELSE 0 END) AS breadth_adv_frac FROM research GROUP BY 1),
    panel AS (
      SELECT r.*, close / lag(close, 60) OVER (PARTITION BY ticker ORDER BY r.ts) - 1 AS ret60, breadth_rel_adv_frac, breadth_adv_frac
      FROM research r LEFT JOIN rel_breadth USING (ts) LEFT JOIN adv USING (ts)),
    spans AS (
      SELECT s.fold_id, s.k, s.ts, s.next_ts, p.ticker, ret60, q.close / p.close - 1 AS ret, p.cost, p.breadth_rel_adv_frac, p.breadth_adv_frac
      FROM schedule s JOIN panel p ON p.ts = s.ts JOIN bars q ON q.ticker = p.ticker AND q.ts = s.next_ts WHERE ret60 IS NOT NULL),
    top AS (
      SELECT *, ret60 - min(ret60) OVER g + 1e-6 AS c FROM (
        SELECT *, row_number() OVER (PARTITION BY fold_id, k ORDER BY ret60 DESC, ticker) AS rank FROM spans) WHERE rank <= 10
      WINDOW g AS (PARTITION BY fold_id, k)),
    sleeves AS (
      SELECT fold_id, k, sum(c * ret) / sum(c) AS active_return, sum(c * (ret - cost)) / sum(c) AS active_return_net,
             string_agg(ticker, '|' ORDER BY rank) AS top_names FROM top GROUP BY 1, 2),
    events_t AS (
      SELECT fold_id, k, any_value(ts) AS rebalance_ts, any_value(next_ts) AS next_rebalance_ts, count(*) AS eligible_count,
             avg(ret) AS core_return, avg(ret - cost) AS core_return_net, any_value(active_return) AS active_return,
             any_value(active_return_net) AS active_return_net, avg(breadth_rel_adv_frac) AS breadth_rel_adv_frac,
             avg(breadth_adv_frac) AS breadth_adv_frac, any_value(top_names) AS top_names
      FROM spans JOIN sleeves USING (fold_id, k) GROUP BY 1, 2 HAVING count(*) >= 10)"""

ANN = "CASE WHEN {x} > -0.999999 THEN pow(1 + {x}, 250.0 / fold_trade_dates) - 1 END"

FOLDS = f"""{EVENTS}, ends AS (SELECT fold_id, min(ts) AS a, max(ts) AS b, max(n) AS fold_trade_dates FROM fold_calendar GROUP BY 1),
    hold AS (
      SELECT fold_id, avg(q.close / p.close - 1) AS buyhold_total_return FROM ends JOIN bars p ON p.ts = a
      JOIN bars q ON q.ts = b AND q.ticker = p.ticker GROUP BY 1),
    bench AS (SELECT fold_id, product(1 + core_return_net) - 1 AS rebalanced_total_return, count(*) AS rebalance_count FROM events_t GROUP BY 1),
    folds AS (
      SELECT fold_id, fold_trade_dates, buyhold_total_return, rebalanced_total_return, rebalance_count,
             {ANN.format(x='buyhold_total_return')} AS buyhold_annualized_return,
             {ANN.format(x='rebalanced_total_return')} AS rebalanced_annualized_return
      FROM ends LEFT JOIN hold USING (fold_id) LEFT JOIN bench USING (fold_id))"""

HEDGE = """CASE WHEN coalesce(breadth_rel_adv_frac, 1) <= {t} THEN (1 - {h}) * {c} + {h} * {a} ELSE (1 - {n}) * {c} + {n} * {a} END"""
FROZEN = HEDGE.format(t=0.3703703703703703, h="(-0.2)", n="0.1", c="core_return_net", a="active_return_net")


def scored_sql(source: str, keys: str, benchmark: str = "rebalanced_annualized_return") -> str:
    """Fold scores of a relation with (keys, fold_id, strategy_return)."""
    return f"""SELECT *, strategy_annualized - benchmark_annualized AS excess,
        coalesce(strategy_annualized > benchmark_annualized, false) AS beats FROM (
          SELECT {keys} fold_id, events, strategy_total_return, {benchmark} AS benchmark_annualized,
                 {ANN.format(x='strategy_total_return')} AS strategy_annualized
          FROM (SELECT {keys} fold_id, count(*) AS events, product(1 + coalesce(strategy_return, 0)) - 1 AS strategy_total_return
                FROM {source} GROUP BY ALL) JOIN folds USING (fold_id))"""


def rollup_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys} count(DISTINCT fold_id) AS fold_count, sum(events) AS event_count,
        avg(strategy_annualized) AS mean_strategy_annualized, avg(benchmark_annualized) AS mean_benchmark_annualized,
        avg(excess) AS mean_excess, min(excess) AS min_excess, min(strategy_annualized) AS min_strategy_annualized,
        sum(CAST(beats AS INT)) AS folds_beating FROM {source} GROUP BY ALL"""


ROLL = "fold_count:i event_count:i mean_strategy_annualized:f5 mean_benchmark_annualized:f5 mean_excess:f5 min_excess:f5 min_strategy_annualized:f5 folds_beating:i"
SCORED = "fold_id:i events:i strategy_total_return:f strategy_annualized:f5 benchmark_annualized:f5 excess:f5 beats:b"


@query(
    "b1_rebalance_schedule",
    "fold_id:i k:i ts:d next_ts:d",
    f"WITH {fx.GROUP_BARS}, {SCHEDULE} SELECT * FROM schedule",
)
def _(t):
    return pf.rebalance_schedule(pf.fold_calendar(groups(t)))


@query(
    "j2_current_next_snapshot",
    "fold_id:i k:i ticker:s close:f8 next_close:f8",
    f"""WITH {fx.GROUP_BARS}, {SCHEDULE} SELECT fold_id, k, p.ticker, p.close, q.close AS next_close FROM schedule s
        JOIN bars p ON p.ts = s.ts JOIN bars q ON q.ts = s.next_ts AND q.ticker = p.ticker""",
)
def _(t):
    from tickloom.operators.joins import next_snapshot

    bars = groups(t)
    return next_snapshot(bars, pf.rebalance_schedule(pf.fold_calendar(bars)))


@query(
    "b2_score_weights",
    "fold_id:i k:i ticker:s weight:f",
    f"WITH {EVENTS} SELECT fold_id, k, ticker, c / sum(c) OVER (PARTITION BY fold_id, k) AS weight FROM top",
)
def _(t):
    from pyspark.sql import Window

    ranked = pf.ranked_names(panel(t), "ret60", 10)
    return ranked.withColumn("weight", pf.score_weights(F.col("ret60"), Window.partitionBy("fold_id", "k")))


@query(
    "b3_b4_rebalance_events",
    "fold_id:i k:i rebalance_ts:d next_rebalance_ts:d eligible_count:i core_return:f core_return_net:f active_return:f "
    "active_return_net:f breadth_rel_adv_frac:f breadth_adv_frac:f top_names:s",
    f"WITH {EVENTS} SELECT * FROM events_t",
)
def _(t):
    events = pf.rebalance_events(panel(t), "ret60", 10, 30, 10, CONTEXT)
    return events.withColumn("top_names", F.array_join("top_names", "|"))


@query(
    "b5_buy_and_hold_folds",
    "fold_id:i fold_trade_dates:i buyhold_total_return:f rebalanced_total_return:f rebalance_count:f buyhold_annualized_return:f "
    "rebalanced_annualized_return:f",
    f"WITH {FOLDS} SELECT * FROM folds",
)
def _(t):
    return events_and_folds(t)[1]


@query(
    "b6_dynamic_hedge",
    "fold_id:i k:i strategy_return:f",
    f"WITH {EVENTS} SELECT fold_id, k, {FROZEN} AS strategy_return FROM events_t",
)
def _(t):
    events = pf.rebalance_events(panel(t), "ret60", 10, 30, 10, CONTEXT)
    rule = pf.dynamic_hedge(F.lit(pf.FROZEN_THRESHOLD), F.lit(pf.NORMAL_WEIGHT), F.lit(pf.HEDGE_WEIGHT))
    return events.withColumn("strategy_return", rule)


TILT = "0.5 * core_return_net + 0.5 * CASE WHEN coalesce(breadth_adv_frac, 0) >= 0.5 THEN active_return_net ELSE core_return_net END"


@query(
    "b7_breadth_tilt",
    "fold_id:i k:i strategy_return:f",
    f"WITH {EVENTS} SELECT fold_id, k, {TILT} AS strategy_return FROM events_t",
)
def _(t):
    return pf.rebalance_events(panel(t), "ret60", 10, 30, 10, CONTEXT).withColumn("strategy_return", pf.breadth_tilt())


SHORT = "CASE WHEN coalesce(breadth_rel_adv_frac, 1) <= {t} AND {h} < 0 THEN abs({h}) * ({b} * date_diff('day', rebalance_ts, next_rebalance_ts) / 365.0 + {s} / 10000.0) ELSE 0 END"


@query(
    "b8_short_cost",
    "fold_id:i k:i short_cost:f8",
    f"WITH {EVENTS} SELECT fold_id, k, {SHORT.format(t=0.5, h='(-0.2)', b=0.05, s=25.0)} AS short_cost FROM events_t",
)
def _(t):
    events = pf.rebalance_events(panel(t), "ret60", 10, 30, 10, CONTEXT)
    return events.withColumn("short_cost", pf.short_cost(F.lit(0.5), F.lit(-0.2), F.lit(0.05), F.lit(25.0)))


STACKED2 = f"""stacked AS (
      SELECT *, 'breadth_tilt' AS variant_id, {TILT} AS strategy_return FROM events_t
      UNION ALL SELECT *, 'dynamic_hedge', {FROZEN} FROM events_t)"""


@query(
    "b9_fold_scores",
    f"variant_id:s {SCORED}",
    f"WITH {FOLDS}, {STACKED2} {scored_sql('stacked', 'variant_id,')}",
)
def _(t):
    return au.rebalanced_benchmark(*events_and_folds(t))


@query(
    "a11_fold_rollup",
    f"variant_id:s {ROLL}",
    f"WITH {FOLDS}, {STACKED2}, scored AS ({scored_sql('stacked', 'variant_id,')}) {rollup_sql('scored', 'variant_id,')}",
)
def _(t):
    return pf.fold_rollup(au.rebalanced_benchmark(*events_and_folds(t)), ["variant_id"])


RAW_HEDGE = HEDGE.format(t=0.3703703703703703, h="(-0.2)", n="0.1", c="core_return", a="active_return_net")
DECOMPOSED = f"""{FOLDS}, stacked AS (
      SELECT *, 'core_only' AS variant_id, core_return AS strategy_return FROM events_t
      UNION ALL SELECT *, 'active_only', active_return_net FROM events_t UNION ALL SELECT *, 'dynamic_hedge', {RAW_HEDGE} FROM events_t),
    scored AS ({scored_sql('stacked', 'variant_id,', 'buyhold_annualized_return')}),
    decomposed AS ({rollup_sql('scored', 'variant_id,')})"""


@query("b10_alpha_decomposition", f"variant_id:s {ROLL}", f"WITH {DECOMPOSED} SELECT * FROM decomposed")
def _(t):
    return au.alpha_decomposition(*events_and_folds(t))


@query(
    "b10_decomposition_decision",
    "full_mean_excess:f5 core_only_mean_excess:f5 active_only_mean_excess:f5 bonus_share:f4 decision:s",
    f"""WITH {DECOMPOSED}, d AS (SELECT max(mean_excess) FILTER (variant_id = 'dynamic_hedge') AS full_mean_excess,
        max(mean_excess) FILTER (variant_id = 'core_only') AS core_only_mean_excess,
        max(mean_excess) FILTER (variant_id = 'active_only') AS active_only_mean_excess FROM decomposed)
        SELECT *, core_only_mean_excess / full_mean_excess AS bonus_share,
               CASE WHEN core_only_mean_excess / full_mean_excess >= 0.6 THEN 'demote' ELSE 'survives' END AS decision FROM d""",
)
def _(t):
    return au.decomposition_decision(au.alpha_decomposition(*events_and_folds(t)))


def search_sql(cases: list[tuple[list[int], list[int]]], normal: list[float], hedge: list[float], short: bool) -> str:
    """Threshold search in SQL: CTEs ``fit_summary`` and ``oos_summary``."""
    rows = ", ".join(
        f"({i}, {f}, '{role}')" for i, (fit, oos) in enumerate(cases, 1) for role, fs in (("fit", fit), ("oos", oos)) for f in fs
    )
    ret = HEDGE.format(t="threshold", h="hedge_weight", n="normal_weight", c="core_return_net", a="active_return_net")
    if short:
        ret = f"{ret} - {SHORT.format(t='threshold', h='hedge_weight', b=0.05, s=25.0)}"
    spec = "case_id, quantile, threshold, normal_weight, hedge_weight, role,"
    quantiles = ", ".join(f"({q}::DOUBLE)" for q in au.QUANTILES)
    thresholds = " UNION ALL ".join(
        f"SELECT case_id, {q}::DOUBLE AS quantile, quantile_cont(coalesce(breadth_rel_adv_frac, 1), {q}) AS threshold FROM tagged WHERE role = 'fit' GROUP BY 1"
        for q in au.QUANTILES
    )
    return f"""{FOLDS}, roles(case_id, fold_id, role) AS (VALUES {rows}),
    tagged AS (SELECT e.*, case_id, role FROM events_t e JOIN roles USING (fold_id)),
    candidate_grid AS (SELECT * FROM ({thresholds}), (SELECT unnest({normal}::DOUBLE[]) AS normal_weight), (SELECT unnest({hedge}::DOUBLE[]) AS hedge_weight)),
    candidates AS (SELECT tagged.*, quantile, threshold, normal_weight, hedge_weight, {ret} AS strategy_return FROM tagged JOIN candidate_grid USING (case_id)),
    scored AS ({scored_sql('candidates', spec)}),
    summary AS ({rollup_sql('scored', spec)}),
    fit_summary AS (SELECT * EXCLUDE (role) FROM summary WHERE role = 'fit'),
    winner AS (
      SELECT * FROM fit_summary QUALIFY row_number() OVER (PARTITION BY case_id
        ORDER BY folds_beating DESC, round(mean_excess, 12) DESC, quantile, normal_weight, hedge_weight DESC) = 1),
    oos_summary AS (
      SELECT s.* EXCLUDE (role) FROM summary s JOIN (SELECT case_id, quantile, normal_weight, hedge_weight FROM winner) w
      USING (case_id, quantile, normal_weight, hedge_weight) WHERE role = 'oos')"""


SPEC = "case_id:i quantile:f threshold:f normal_weight:f hedge_weight:f"
SPLIT_5_5 = [([1, 2, 3, 4, 5], [6, 7, 8, 9, 10])]
SPLIT_8_2 = [([1, 2, 3, 4, 5, 6, 7, 8], [9, 10])]
SPLITS = [(list(range(1, c + 1)), list(range(c + 1, 11))) for c in (5, 6, 7, 8)]


@query(
    "b11_threshold_walkforward_fit",
    f"{SPEC} {ROLL}",
    f"WITH {search_sql(SPLIT_5_5, [0.1], [-0.2], False)} SELECT * FROM fit_summary",
)
def _(t):
    return au.threshold_search(*events_and_folds(t), SPLIT_5_5)[0]


@query(
    "b11_threshold_walkforward_holdout",
    f"{SPEC} {ROLL} decision:s",
    f"""WITH {search_sql(SPLIT_5_5, [0.1], [-0.2], False)} SELECT *, CASE WHEN folds_beating >= 4 THEN 'survives' ELSE 'no_evidence' END AS decision
        FROM oos_summary""",
)
def _(t):
    oos = au.threshold_search(*events_and_folds(t), SPLIT_5_5)[1]
    return oos.withColumn("decision", pf.decision(F.col("folds_beating"), 4, "survives", "no_evidence"))


@query(
    "b12_strict_oos_grid",
    f"{SPEC} {ROLL} decision:s",
    f"""WITH {search_sql(SPLIT_8_2, au.NORMAL_WEIGHTS, au.HEDGE_WEIGHTS, True)} SELECT *,
        CASE WHEN folds_beating >= 2 THEN 'survives' ELSE 'replay_failed' END AS decision FROM oos_summary""",
)
def _(t):
    oos = au.threshold_search(*events_and_folds(t), SPLIT_8_2, au.NORMAL_WEIGHTS, au.HEDGE_WEIGHTS, True)[1]
    return oos.withColumn("decision", pf.decision(F.col("folds_beating"), 2, "survives", "replay_failed"))


@query(
    "b13_oos_window_sensitivity",
    f"{SPEC} {ROLL}",
    f"WITH {search_sql(SPLITS, au.NORMAL_WEIGHTS, au.HEDGE_WEIGHTS, True)} SELECT * FROM oos_summary",
)
def _(t):
    return au.threshold_search(*events_and_folds(t), SPLITS, au.NORMAL_WEIGHTS, au.HEDGE_WEIGHTS, True)[1]


NULL_SQL = f"""{FOLDS}, m AS (SELECT *, coalesce(breadth_rel_adv_frac, 1) <= 0.3703703703703703 AS hedged,
          count(*) FILTER (coalesce(breadth_rel_adv_frac, 1) <= 0.3703703703703703) OVER () AS number FROM events_t),
        d AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY {fx.draw_sql('seed', 'fold_id', 'k')}, fold_id, k) AS rn
              FROM m, (SELECT unnest(range(-1, 1000)) AS seed)),
        w AS (SELECT *, CASE WHEN CASE WHEN seed < 0 THEN hedged ELSE rn <= number END THEN -0.2::DOUBLE ELSE 0.1 END AS w FROM d),
        s AS (SELECT seed, fold_id, (1 - w) * core_return_net + w * active_return_net AS strategy_return FROM w),
        scored AS ({scored_sql('s', 'seed,')}), nulls AS ({rollup_sql('scored', 'seed,')})"""


@query("b14_random_hedge_null", "seed:i mean_excess:f5 folds_beating:i", f"WITH {NULL_SQL} SELECT seed, mean_excess, folds_beating FROM nulls")
def _(t):
    return au.random_null(*events_and_folds(t))


@query(
    "b14_null_actual_row",
    f"seed:i {ROLL}",
    f"""WITH {FOLDS}, s AS (SELECT -1 AS seed, fold_id, {FROZEN} AS strategy_return FROM events_t),
        scored AS ({scored_sql('s', 'seed,')}) {rollup_sql('scored', 'seed,')}""",
)
def _(t):
    return au.random_null(*events_and_folds(t), seeds=0).filter("seed < 0")


@query(
    "b14_null_decision",
    "seed_count:i actual_mean_excess:f5 actual_folds_beating:i null_p75:f5 null_p90:f5 percentile:f5 decision:s",
    f"""WITH {NULL_SQL}, real AS (SELECT mean_excess AS x, folds_beating AS y FROM nulls WHERE seed < 0),
        o AS (SELECT count(*) AS seed_count, any_value(x) AS actual_mean_excess, any_value(y) AS actual_folds_beating,
              quantile_cont(mean_excess, 0.75) AS null_p75, quantile_cont(mean_excess, 0.9) AS null_p90,
              avg(CASE WHEN mean_excess < x THEN 1.0::DOUBLE ELSE 0 END) AS percentile FROM nulls, real WHERE seed >= 0)
        SELECT *, CASE WHEN actual_mean_excess <= null_p75 THEN 'not_informative' ELSE 'survives' END AS decision FROM o""",
)
def _(t):
    return au.null_decision(au.random_null(*events_and_folds(t)))


@query(
    "b15_short_cost_stress",
    f"borrow:f slippage_bps:f {ROLL}",
    f"""WITH {FOLDS}, g AS (SELECT *, {FROZEN} - {SHORT.format(t=0.3703703703703703, h='(-0.2)', b='borrow', s='slippage_bps')} AS strategy_return
          FROM events_t, (SELECT unnest([0.02, 0.05, 0.1]::DOUBLE[]) AS borrow), (SELECT unnest([10, 25, 50]::DOUBLE[]) AS slippage_bps)),
        scored AS ({scored_sql('g', 'borrow, slippage_bps,')}) {rollup_sql('scored', 'borrow, slippage_bps,')}""",
)
def _(t):
    return au.short_stress(*events_and_folds(t))


@query(
    "b15_short_names",
    "fold_id:i rebalance_ts:d symbol:s short_weight:f has_future:b",
    f"""WITH {EVENTS}, {fx.grouped(fx.OPEN_INTEREST, futures=True)} SELECT fold_id, rebalance_ts, symbol, 0.02 AS short_weight,
        symbol IN (SELECT symbol FROM oi) AS has_future FROM (
          SELECT fold_id, rebalance_ts, unnest(string_split(top_names, '|')) AS symbol FROM events_t
          WHERE coalesce(breadth_rel_adv_frac, 1) <= 0.3703703703703703)""",
)
def _(t):
    events = pf.rebalance_events(panel(t), "ret60", 10, 30, 10, CONTEXT)
    return au.short_names(events, fx.open_interest(t, fx.with_futures(fx.by_group(t))))


TRANSFER = f"""{FOLDS}, s AS (SELECT fold_id, {HEDGE.format(t=0.3703703703703703, h='(-0.2)', n='0.1', c='core_return', a='active_return')} AS strategy_return
      FROM events_t), scored AS ({scored_sql('s', '', 'buyhold_annualized_return')})"""


@query("b16_universe_transfer_folds", SCORED, f"WITH {TRANSFER} SELECT * FROM scored")
def _(t):
    return au.universe_transfer(panel(t), "ret60")[0]


@query(
    "b16_universe_transfer_summary",
    "fold_count:i mean_strategy_annualized:f5 mean_buyhold_annualized:f5 min_strategy_annualized:f5 min_buyhold_annualized:f5 "
    "folds_beating:i all_folds_beat:b",
    f"""WITH {TRANSFER} SELECT count(DISTINCT fold_id) AS fold_count, avg(strategy_annualized) AS mean_strategy_annualized,
        avg(benchmark_annualized) AS mean_buyhold_annualized, min(strategy_annualized) AS min_strategy_annualized,
        min(benchmark_annualized) AS min_buyhold_annualized, sum(CAST(beats AS INT)) AS folds_beating, bool_and(beats) AS all_folds_beat FROM scored""",
)
def _(t):
    return au.universe_transfer(panel(t), "ret60")[1]


@query(
    "b17_decision_row",
    "variant_id:s folds_beating:i decision:s",
    f"""WITH {FOLDS}, {STACKED2}, scored AS ({scored_sql('stacked', 'variant_id,')})
        SELECT variant_id, sum(CAST(beats AS INT)) AS folds_beating, CASE WHEN sum(CAST(beats AS INT)) >= 7 THEN 'survives' ELSE 'retract' END AS decision
        FROM scored GROUP BY 1""",
)
def _(t):
    summary = pf.fold_rollup(au.rebalanced_benchmark(*events_and_folds(t)), ["variant_id"])
    return summary.withColumn("decision", pf.decision(F.col("folds_beating"), 7, "survives", "retract"))


def _policy_panel(t) -> DataFrame:
    from tickloom.operators.intraday import rolling_rsi

    frame = research_columns(fx.bars(t))


    def strength(d, w):
        moved = d.withColumn("_m", F.col("close") - F.lag("close").over(w))
        return moved.withColumn("rsi14", rolling_rsi(F.col("_m"), w, 14)).drop("_m")

    return over_series(frame, strength, before=15, shape=DAILY)


@query(
    "b18_baseline_policies",
    "policy:s ticker:s trades:i total:f",
    f"""WITH {RESEARCH}, g AS (SELECT *, CASE WHEN count(lag_ret_1) OVER w = 14 THEN
            CASE WHEN sum(abs(d)) OVER w = 0 THEN NULL ELSE 100 * sum(greatest(d, 0)) OVER w / sum(abs(d)) OVER w END END AS rsi14
          FROM (SELECT *, close - lag(close) OVER (PARTITION BY ticker ORDER BY ts) AS d FROM research)
          WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS 13 PRECEDING)),
        p AS (SELECT 'flat' AS policy, ticker, ts, lag_ret_1, 0.0 AS pos FROM g
          UNION ALL SELECT 'sma', ticker, ts, lag_ret_1, sign(coalesce(trend_30, 0)) FROM g
          UNION ALL SELECT 'rsi', ticker, ts, lag_ret_1, CASE WHEN rsi14 < 30 THEN 1 WHEN rsi14 > 70 THEN -1 ELSE 0 END FROM g),
        r AS (SELECT policy, ticker, pos, coalesce(lag(pos) OVER (PARTITION BY policy, ticker ORDER BY ts) * lag_ret_1, 0) AS x FROM p)
        SELECT policy, ticker, count(*) FILTER (pos <> 0) AS trades, sum(x) AS total FROM r GROUP BY 1, 2""",
)
def _(t):
    out = pf.policy_returns(pf.policy_positions(_policy_panel(t)).filter("policy <> 'random'"))
    return out.groupBy("policy", "ticker").agg(
        F.sum(F.when(F.col("position") != 0, 1).otherwise(0)).alias("trades"), F.sum("policy_return").alias("total")
    )


@query(
    "b18_random_policy",
    "ticker:s trades:i total:f",
    f"""WITH {RESEARCH}, p AS (SELECT ticker, ts, lag_ret_1, CASE CAST('0x' || {fx.draw_sql('42', 'ticker', 'ts')} AS BIGINT) % 4
            WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS pos FROM research),
        r AS (SELECT ticker, pos, coalesce(lag(pos) OVER (PARTITION BY ticker ORDER BY ts) * lag_ret_1, 0) AS x FROM p)
        SELECT ticker, count(*) FILTER (pos <> 0) AS trades, sum(x) AS total FROM r GROUP BY 1""",
)
def _(t):
    out = pf.policy_returns(pf.policy_positions(_policy_panel(t)).filter("policy = 'random'"))
    return out.groupBy("ticker").agg(
        F.sum(F.when(F.col("position") != 0, 1).otherwise(0)).alias("trades"), F.sum("policy_return").alias("total")
    )


@query(
    "b19_guardrail_exposure",
    "fold_id:i rebalance_ts:d profile:s drawdown:f exposure:f guarded_return:f",
    f"""WITH {EVENTS}, s AS (SELECT fold_id, rebalance_ts, {FROZEN} AS r FROM events_t),
        n AS (SELECT *, product(1 + r) OVER w AS nw FROM s WINDOW w AS (PARTITION BY fold_id ORDER BY rebalance_ts ROWS UNBOUNDED PRECEDING)),
        p AS (SELECT *, max(greatest(nw, 1)) OVER (PARTITION BY fold_id ORDER BY rebalance_ts ROWS UNBOUNDED PRECEDING) AS peak FROM n),
        f AS (SELECT *, coalesce(lag(1 - nw / peak) OVER (PARTITION BY fold_id ORDER BY rebalance_ts), 0) AS drawdown FROM p),
        e AS (SELECT *, 'hard_5_75_10_cash' AS profile, CASE WHEN drawdown >= 0.1 THEN 0 WHEN drawdown >= 0.075 THEN 0.5 WHEN drawdown >= 0.05 THEN 0.75 ELSE 1 END AS exposure FROM f
          UNION ALL SELECT *, 'soft_5_10_floor50', CASE WHEN drawdown >= 0.1 THEN 0.5 WHEN drawdown >= 0.05 THEN 0.75 ELSE 1 END FROM f
          UNION ALL SELECT *, 'medium_8_12_floor25', CASE WHEN drawdown >= 0.12 THEN 0.25 WHEN drawdown >= 0.08 THEN 0.6 ELSE 1 END FROM f
          UNION ALL SELECT *, 'late_10_15_floor50', CASE WHEN drawdown >= 0.15 THEN 0.5 WHEN drawdown >= 0.1 THEN 0.75 ELSE 1 END FROM f)
        SELECT *, exposure * r AS guarded_return FROM e""",
)
def _(t):
    events = pf.rebalance_events(panel(t), "ret60", 10, 30, 10, CONTEXT)
    rule = pf.dynamic_hedge(F.lit(pf.FROZEN_THRESHOLD), F.lit(pf.NORMAL_WEIGHT), F.lit(pf.HEDGE_WEIGHT))
    return pf.guardrail(events.withColumn("strategy_return", rule))


def sleeves(t) -> DataFrame:
    """Sector sleeves priced at the mean close of their members."""
    members = fx.bars(t).join(fx.sectors(t), "ticker")
    priced = members.groupBy("sector", "ts").agg(F.avg("close").alias("close"))
    return priced.select(F.concat(F.lit("SEC"), F.col("sector").cast("string")).alias("ticker"), "ts", "close")


ROTATION = f"""{fx.BARS}, {fx.SECTORS}, sleeves AS (
      SELECT 'SEC' || sector AS ticker, ts, avg(close) AS close FROM bars JOIN sectors USING (ticker) GROUP BY 1, 2),
    step AS (SELECT *, close / lag(close) OVER w - 1 AS r1, close / lag(close, 60) OVER w - 1 AS ret60 FROM sleeves
             WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
    scores AS (SELECT *, CASE WHEN count(r1) OVER w = 60 THEN -stddev_samp(r1) OVER w END AS lowvol FROM step
             WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS 59 PRECEDING)),
    fold_days AS (SELECT ts, ntile(10) OVER (ORDER BY ts) AS fold_id FROM (SELECT DISTINCT ts FROM sleeves)),
    fold_calendar AS (SELECT fold_id, ts, row_number() OVER (PARTITION BY fold_id ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY fold_id) AS n FROM fold_days),
    schedule AS (SELECT a.fold_id, a.idx // 10 AS k, a.ts, b.ts AS next_ts FROM fold_calendar a JOIN fold_calendar b
      ON a.fold_id = b.fold_id AND b.idx = least(a.idx + 10, a.n - 1) WHERE a.idx % 10 = 0 AND a.idx < a.n - 1)"""


def _rotation_sql(score: str) -> str:
    return f"""WITH {ROTATION}, spans AS (SELECT fold_id, k, s.ts, p.ticker, {score} AS score, q.close / p.close - 1 AS ret
          FROM schedule s JOIN scores p ON p.ts = s.ts JOIN sleeves q ON q.ticker = p.ticker AND q.ts = s.next_ts WHERE {score} IS NOT NULL),
        c AS (SELECT fold_id, k, avg(ret) AS core_return, count(*) AS n FROM spans GROUP BY 1, 2),
        top AS (SELECT *, score - min(score) OVER (PARTITION BY fold_id, k) + 1e-6 AS w FROM (
          SELECT *, row_number() OVER (PARTITION BY fold_id, k ORDER BY score DESC, ticker) AS rank FROM spans) WHERE rank <= 2)
        SELECT fold_id, k, any_value(core_return) AS core_return, sum(w * ret) / sum(w) AS active_return,
               string_agg(ticker, '|' ORDER BY rank) AS top_names FROM top JOIN c USING (fold_id, k) WHERE n >= 2 GROUP BY 1, 2"""


def _rotation(frame: DataFrame, score: str) -> DataFrame:
    events = pf.rebalance_events(frame, score, 2, 10, 10)
    return events.withColumn("top_names", F.array_join("top_names", "|"))


@query("b20_momentum_rotation", "fold_id:i k:i core_return:f active_return:f top_names:s", _rotation_sql("ret60"))
def _(t):
    return _rotation(ex.momentum(sleeves(t), 60), "ret60")


@query("b20_low_volatility_rotation", "fold_id:i k:i core_return:f active_return:f top_names:s", _rotation_sql("round(lowvol, 9)"))
def _(t):
    def quiet(d, w):
        stepped = d.withColumn("_r", R.change(F.col("close"), w, 1))
        return stepped.withColumn("score", F.round(-R.spread(F.col("_r"), w, 60), 9)).drop("_r")

    return _rotation(over_series(sleeves(t), quiet, before=61, shape=DAILY), "score")


@query(
    "b20_index_relative_momentum",
    "ticker:s ts:d excess:f",
    f"""WITH {fx.BARS}, {fx.SPOT}, s AS (SELECT dt, spot / lag(spot, 60) OVER (ORDER BY dt) - 1 AS r FROM spot),
        m AS (SELECT *, close / lag(close, 60) OVER (PARTITION BY ticker ORDER BY ts) - 1 AS ret60 FROM bars)
        SELECT ticker, ts, ret60 - r AS excess FROM m JOIN s ON s.dt = m.ts""",
)
def _(t):
    from pyspark.sql import Window

    index = fx.spot(t).select(F.col("dt").alias("ts"), R.change(F.col("spot"), Window.orderBy("dt"), 60).alias("_r"))
    # one row per calendar day
    return ex.momentum(fx.bars(t), 60).join(F.broadcast(index), "ts").withColumn("excess", F.col("ret60") - F.col("_r"))


@query(
    "b21_winner_retention",
    "fold_id:i k:i strategy_return:f held:s",
    f"""WITH RECURSIVE {EVENTS}, top7 AS (SELECT *, row_number() OVER (PARTITION BY fold_id, k ORDER BY ret60 DESC, ticker) AS rank FROM spans QUALIFY rank <= 7),
        lists AS (SELECT fold_id, k, list(ticker ORDER BY rank) AS names, row_number() OVER (PARTITION BY fold_id ORDER BY k) AS i FROM top7 GROUP BY 1, 2),
        walk AS (
          SELECT fold_id, k, i, names[1:3] AS held FROM lists WHERE i = 1
          UNION ALL
          SELECT l.fold_id, l.k, l.i, (list_filter(w.held, lambda x: list_contains(l.names, x))
                 || list_filter(l.names, lambda x: NOT list_contains(w.held, x)))[1:3]
          FROM walk w JOIN lists l ON l.fold_id = w.fold_id AND l.i = w.i + 1),
        h AS (SELECT fold_id, k, unnest(held) AS ticker FROM walk)
        SELECT fold_id, k, avg(ret) AS strategy_return, string_agg(ticker, '|' ORDER BY ticker) AS held
        FROM h JOIN top7 USING (fold_id, k, ticker) GROUP BY 1, 2""",
)
def _(t):
    return pf.winner_retention(panel(t), "ret60").withColumn("held", F.array_join("held", "|"))


@query(
    "b21_loser_avoidance",
    "fold_id:i k:i names:i strategy_return:f",
    f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY fold_id, k ORDER BY ret60, ticker) AS worst FROM spans)
        SELECT fold_id, k, count(*) AS names, avg(ret) AS strategy_return FROM r WHERE worst > 3 GROUP BY 1, 2""",
)
def _(t):
    return pf.loser_avoidance(panel(t), "ret60")


BREADTH_ONLY = BREADTH.split("advance AS", 1)[1]  # over the groups' bars


@query(
    "b22_regime_gated_topk",
    "gate:s fold_id:i k:i strategy_return:f",
    f"""WITH {EVENTS}, advance AS {BREADTH_ONLY}, {SPOT_CONTEXT},
        g AS (SELECT e.*, coalesce(b.breadth_trend_up, false) AS bup, coalesce(s.spot_vs_sma20 > 0, false) AS sup
              FROM events_t e LEFT JOIN breadth b ON b.trade_date = rebalance_ts ASOF LEFT JOIN spot_context s ON rebalance_ts >= s.dt)
        SELECT 'ungated' AS gate, fold_id, k, active_return_net AS strategy_return FROM g
        UNION ALL SELECT 'trend_up', fold_id, k, CASE WHEN sup THEN active_return_net ELSE 0 END FROM g
        UNION ALL SELECT 'breadth_supportive', fold_id, k, CASE WHEN bup THEN active_return_net ELSE 0 END FROM g
        UNION ALL SELECT 'composite', fold_id, k, CASE WHEN sup AND bup THEN active_return_net ELSE 0 END FROM g""",
)
def _(t):
    from tickloom.functions.layout import CALENDAR
    from tickloom.operators.joins import asof_join

    events = pf.rebalance_events(panel(t), "ret60", 10, 30, 10, CONTEXT)
    breadth = ex.breadth_features(groups(t)).select(F.col("trade_date").alias("rebalance_ts"), "breadth_trend_up")
    gated = asof_join(
        events.join(breadth, "rebalance_ts", "left"),
        ex.spot_context(fx.spot(t)).select("dt", "spot_vs_sma20"),
        "rebalance_ts",
        "dt",
        shape=CALENDAR,
    )
    up = R.holds(F.col("spot_vs_sma20") > 0)
    wide = F.coalesce("breadth_trend_up", F.lit(False))
    active = F.col("active_return_net")
    return pf.variants(
        gated,
        {
            "ungated": active,
            "trend_up": F.when(up, active).otherwise(0.0),
            "breadth_supportive": F.when(wide, active).otherwise(0.0),
            "composite": F.when(up & wide, active).otherwise(0.0),
        },
    ).withColumnRenamed("variant_id", "gate")


def _flagged(t) -> DataFrame:
    """Panel rows with each ticker's latest flags at or before their day."""
    deliv = ex.delivery_features(fx.delivery(t, fx.by_group(t))).select(
        "ticker", "trade_date", "deliv_rising", "deliv_rising_and_zpos", "deliv_pct_5d_ma"
    )
    oi = ex.oi_features(fx.open_interest(t, fx.by_group(t))).select("ticker", "trade_date", "oi_rising", "oi_rising_and_pos")
    flagged = asof_join(panel(t), deliv, "ts", "trade_date", ["ticker"], shape=DAILY).drop("matched_trade_date")
    return asof_join(flagged, oi, "ts", "trade_date", ["ticker"], shape=DAILY)


FLAGS = f"""{EVENTS}, {fx.grouped(fx.DELIVERY)}, {fx.grouped(OI_NEAREST)},
    d1 AS (SELECT symbol, date, CASE WHEN count(*) OVER w5 >= 3 THEN avg(deliv_pct) OVER w5 END AS m5,
             CASE WHEN count(*) OVER w20 >= 10 THEN avg(deliv_pct) OVER w20 END AS m20,
             CASE WHEN count(*) OVER w20 >= 10 AND max(deliv_pct) OVER w20 > min(deliv_pct) OVER w20
                  THEN (deliv_pct - avg(deliv_pct) OVER w20) / stddev_samp(deliv_pct) OVER w20 END AS z FROM delivery
           WINDOW w5 AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
    d2 AS (SELECT symbol AS ticker, date AS ts, lag(m5) OVER w AS m5, lag(m20) OVER w AS m20, lag(z) OVER w AS z FROM d1 WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    o1 AS (SELECT symbol, date, chg_in_oi, CASE WHEN count(*) OVER w5 >= 3 THEN sum(chg_in_oi) OVER w5 END AS s5 FROM nearest
           WINDOW w5 AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING)),
    o2 AS (SELECT symbol AS ticker, date AS ts, lag(s5) OVER w AS s5, lag(chg_in_oi) OVER w AS chg FROM o1 WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    flagged AS (SELECT s.*, coalesce(m5 > m20, false) AS deliv_rising, coalesce(m5 > m20 AND z > 0, false) AS deliv_strong, coalesce(m5, 0) AS m5,
             coalesce(s5 > 0, false) AS oi_rising, coalesce(s5 > 0 AND chg > 0, false) AS oi_pos
           FROM spans s ASOF LEFT JOIN d2 ON s.ticker = d2.ticker AND s.ts >= d2.ts ASOF LEFT JOIN o2 ON s.ticker = o2.ticker AND s.ts >= o2.ts)"""


@query(
    "b23_eligibility_gates",
    "variant:s rows:i passed:i pass_rate:f mean_return:f",
    f"""WITH {FLAGS}, v AS (
          SELECT 'ungated' AS variant, true AS ok, ret FROM flagged UNION ALL SELECT 'deliv_rising', deliv_rising, ret FROM flagged
          UNION ALL SELECT 'oi_rising', oi_rising, ret FROM flagged UNION ALL SELECT 'oi_rising_and_pos', oi_pos, ret FROM flagged)
        SELECT variant, count(*) AS rows, count(*) FILTER (ok) AS passed, count(*) FILTER (ok) / count(*) AS pass_rate,
               avg(ret) FILTER (ok) AS mean_return FROM v GROUP BY 1""",
)
def _(t):
    frame = _flagged(t)
    schedule = pf.rebalance_schedule(pf.fold_calendar(frame))
    names = ["deliv_rising", "oi_rising", "oi_rising_and_pos"]
    rows = pf.interval_returns(frame, schedule, "ret60", names)
    gates = [F.struct(F.lit("ungated").alias("variant"), F.lit(True).alias("ok"))]
    gates += [F.struct(F.lit(n).alias("variant"), F.coalesce(n, F.lit(False)).alias("ok")) for n in names]
    stacked = rows.withColumn("_g", F.explode(F.array(*gates))).select("ret", "_g.variant", "_g.ok")
    return stacked.groupBy("variant").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("ok").cast("int")).alias("passed"),
        F.avg(F.col("ok").cast("double")).alias("pass_rate"),
        F.avg(F.when(F.col("ok"), F.col("ret"))).alias("mean_return"),
    )


@query(
    "b24_delivery_overlay",
    "overlay:s rows:i mean_multiplier:f mean_sized_return:f",
    f"""WITH {FLAGS}, v AS (
          SELECT 'veto_low' AS overlay, CASE WHEN m5 >= 30 THEN 1.0 ELSE 0.0 END AS m, ret FROM flagged
          UNION ALL SELECT 'veto_non_rising', CASE WHEN deliv_rising THEN 1.0 ELSE 0.0 END, ret FROM flagged
          UNION ALL SELECT 'size_down_low', CASE WHEN m5 >= 30 THEN 1.0 ELSE 0.5 END, ret FROM flagged
          UNION ALL SELECT 'size_up_strong', CASE WHEN deliv_strong THEN 1.25 ELSE 1.0 END, ret FROM flagged)
        SELECT overlay, count(*) AS rows, avg(m) AS mean_multiplier, avg(m * ret) AS mean_sized_return FROM v GROUP BY 1""",
)
def _(t):
    frame = _flagged(t)
    rows = pf.interval_returns(
        frame, pf.rebalance_schedule(pf.fold_calendar(frame)), "ret60", ["deliv_rising", "deliv_rising_and_zpos", "deliv_pct_5d_ma"]
    )
    low = R.holds(F.col("deliv_pct_5d_ma") >= 30)
    overlays = {
        "veto_low": F.when(low, 1.0).otherwise(0.0),
        "veto_non_rising": F.when(F.coalesce("deliv_rising", F.lit(False)), 1.0).otherwise(0.0),
        "size_down_low": F.when(low, 1.0).otherwise(0.5),
        "size_up_strong": F.when(F.coalesce("deliv_rising_and_zpos", F.lit(False)), 1.25).otherwise(1.0),
    }
    items = [F.struct(F.lit(n).alias("overlay"), c.alias("m")) for n, c in overlays.items()]
    stacked = rows.withColumn("_o", F.explode(F.array(*items))).select("ret", "_o.overlay", "_o.m")
    return stacked.groupBy("overlay").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("m").alias("mean_multiplier"), F.avg(F.col("m") * F.col("ret")).alias("mean_sized_return")
    )


@query(
    "b25_defensive_tilt",
    "dt:d risk_off:b benchmark_return:f static_return:f tilt_return:f",
    f"""WITH {fx.SPOT}, {fx.VIX}, a AS (SELECT s.dt, spot AS equity, vix AS gold FROM spot s JOIN vix v USING (dt)),
        f AS (SELECT *, 1 - equity / max(equity) OVER (ORDER BY dt ROWS 59 PRECEDING) AS fall,
              coalesce(equity / lag(equity) OVER w - 1, 0) AS e, coalesce(gold / lag(gold) OVER w - 1, 0) AS g FROM a WINDOW w AS (ORDER BY dt)),
        o AS (SELECT *, coalesce(lag(fall) OVER (ORDER BY dt) > 0.12, false) AS risk_off FROM f)
        SELECT dt, risk_off, e AS benchmark_return, 0.9 * e + 0.05 * g AS static_return,
               CASE WHEN risk_off THEN 0.5 * e + 0.15 * g ELSE 0.9 * e + 0.05 * g END AS tilt_return FROM o""",
)
def _(t):
    assets = fx.spot(t).withColumnRenamed("spot", "equity").join(fx.vix(t).withColumnRenamed("vix", "gold"), "dt")
    return pf.defensive_tilt(assets.withColumn("liquid", F.lit(100.0)))


@query(
    "b26_pair_scan",
    "lookback:i entry:f events:i mean_event_return:f win_rate:f",
    f"""WITH {fx.BARS}, pairs AS (
          SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS a, 'S' || lpad(CAST(s_suppkey + 1 AS VARCHAR), 12, '0') AS b
          FROM supplier),
        s AS (SELECT a, b, x.ts, ln(x.close) - ln(y.close) AS spread FROM pairs JOIN bars x ON x.ticker = a JOIN bars y ON y.ticker = b AND y.ts = x.ts),
        z AS (SELECT a, b, ts, lead(spread, 5) OVER w - spread AS move,
                CASE WHEN count(*) OVER w20 = 20 THEN (spread - avg(spread) OVER w20) / stddev_samp(spread) OVER w20 END AS z20,
                CASE WHEN count(*) OVER w60 = 60 THEN (spread - avg(spread) OVER w60) / stddev_samp(spread) OVER w60 END AS z60
              FROM s WINDOW w AS (PARTITION BY a, b ORDER BY ts), w20 AS (PARTITION BY a, b ORDER BY ts ROWS 19 PRECEDING),
                w60 AS (PARTITION BY a, b ORDER BY ts ROWS 59 PRECEDING)),
        c AS (SELECT 20 AS lookback, z20 AS z, lag(z20) OVER w AS z0, move FROM z WINDOW w AS (PARTITION BY a, b ORDER BY ts)
              UNION ALL SELECT 60, z60, lag(z60) OVER w, move FROM z WINDOW w AS (PARTITION BY a, b ORDER BY ts))
        SELECT lookback, entry, count(*) AS events, avg(-sign(z) * move) AS mean_event_return,
               avg(CASE WHEN -sign(z) * move > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate
        FROM c, (SELECT unnest([1.5, 2.0]::DOUBLE[]) AS entry) WHERE abs(z) >= entry AND abs(z0) < entry AND move IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    pairs = t.supplier.select(
        fx.ticker_of("s_suppkey").alias("first"),
        F.concat(F.lit("S"), F.lpad((F.col("s_suppkey") + 1).cast("string"), 12, "0")).alias("second"),
    )
    return pf.pair_scan(fx.bars(t), pairs)
