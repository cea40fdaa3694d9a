"""Hand-worked cases of rules that are easy to get wrong."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import pricing as pr
from tickloom.operators import labels as lb
from tickloom.operators import metrics as mt
from tickloom.operators import options as op
from tickloom.operators import technical as te


def bars(spark, rows):
    start = dt.date(2024, 1, 1)
    return spark.createDataFrame(
        [("A", start + dt.timedelta(days=i), *map(float, r)) for i, r in enumerate(rows)],
        "ticker string, ts date, open double, high double, low double, close double, atr20_log double, trend_30 double",
    )


def test_upper_barrier_wins_inside_a_bar(spark):
    a = math.log(0.05)
    df = bars(spark, [(100, 100, 100, 100, a, 1), (100, 106, 94, 100, a, 1), (100, 100, 100, 100, a, 1)])
    first = lb.triple_barrier(df, 1).orderBy("ts").first()
    assert first.y_t4_tb_1 == 1


def test_both_barriers_count_as_a_stop(spark):
    a = math.log(0.05)
    df = bars(spark, [(100, 100, 100, 100, a, 1), (100, 106, 94, 100, a, 1), (100, 100, 100, 100, a, 1)]).withColumn("mkt_ret_1", F.lit(0.0))
    first = lb.event_outcomes(df, 1).orderBy("ts").first()
    assert first.event_barrier_outcome_1 == -1 and first.time_to_target_1 == 1 and first.time_to_stop_1 == 1
    assert first.event_path_payoff_1 == pytest.approx(-0.05 - (0.0008 + 0.25 * 0.05))


def test_last_rows_have_no_barrier_label(spark):
    df = bars(spark, [(100, 200, 50, 100, math.log(0.05), 1)] * 3)
    assert [r.y_t4_tb_2 for r in lb.triple_barrier(df, 2).orderBy("ts").collect()] == [1, 0, 0]


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, i / 10) for i in range(20)], "label int, s double")
    assert mt.roc_auc(df, "label", "s").first().auc is None


def test_short_or_constant_series_has_no_correlation(spark):
    short = spark.createDataFrame([(float(i), float(i)) for i in range(4)], "a double, b double")
    flat = spark.createDataFrame([(1.0, float(i)) for i in range(9)], "a double, b double")
    assert mt.spearman(short, "a", "b").first().ic_spearman is None
    assert mt.spearman(flat, "a", "b").first().ic_spearman is None


def test_iso_week_53_and_short_weeks(spark):
    days = [dt.date(2020, 12, 21) + dt.timedelta(days=i) for i in range(20)]
    days = [d for d in days if d.weekday() < 5 and d not in {dt.date(2020, 12, 28), dt.date(2020, 12, 29), dt.date(2020, 12, 30), dt.date(2020, 12, 31)}]
    df = spark.createDataFrame([(d, 100.0 + i) for i, d in enumerate(days)], "dt date, spot double")
    expiries = {r.expiry_date for r in op.weekly_cycles(df, 2, 1).collect()}
    # the week of 28 December only has its Friday, 1 January 2021 (ISO week 53 of 2020)
    assert dt.date(2021, 1, 1) in expiries and dt.date(2021, 1, 7) in expiries


def test_erf_matches_the_library(spark):
    xs = [float(v) for v in np.concatenate([np.linspace(-7, 7, 281), [0.46875, 4.0, -4.0, 30.0, 0.0]])]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", pr.erf(F.col("x")).alias("y")).collect()
    assert max(abs(r.y - math.erf(r.x)) for r in got) < 1e-14


def test_put_call_parity(spark):
    df = spark.createDataFrame([(100.0, k, 0.5, v) for k in (80.0, 100.0, 130.0) for v in (0.1, 0.4)], "s double, k double, t double, v double")
    c, r = F.col, F.lit(0.06)
    gap = pr.bs_price(c("s"), c("k"), c("t"), r, c("v"), "CE") - pr.bs_price(c("s"), c("k"), c("t"), r, c("v"), "PE") - (c("s") - c("k") * F.exp(-r * c("t")))
    assert df.select(F.max(F.abs(gap)).alias("g")).first().g < 1e-9


def test_expired_option_is_intrinsic(spark):
    row = spark.range(1).select(
        pr.bs_price(F.lit(110.0), F.lit(100.0), F.lit(0.0), F.lit(0.06), F.lit(0.2), "CE").alias("c"),
        pr.bs_price(F.lit(110.0), F.lit(100.0), F.lit(0.1), F.lit(0.06), F.lit(0.0), "PE").alias("p"),
    ).first()
    assert (row.c, row.p) == (10.0, 0.0)


def test_condor_skip_reasons(spark):
    day, exp = dt.date(2024, 1, 1), dt.date(2024, 1, 8)
    spot = spark.createDataFrame([(day, 20000.0), (exp, 20100.0)], "dt date, spot double")
    vix = spark.createDataFrame([(day, 15.0)], "dt date, vix double")
    strikes = [(day, exp, float(k), t, 50.0, 10, 100) for k in (18400, 19600, 20400, 21500) for t in ("CE", "PE")]
    chain = spark.createDataFrame(strikes, "trade_date date, expiry date, strike double, option_typ string, close double, contracts long, open_int long")
    variants = [{"strategy": "ok"}, {"strategy": "tight", "max_margin": 1.0}, {"strategy": "busy", "min_contracts": 1e6}, {"strategy": "far", "call_offset": 0.2}]
    trades, skips = op.chain_scan(spot, chain, vix, variants)
    assert [r.strategy for r in trades.collect()] == ["ok"]
    reasons = {r.strategy: r.reason for r in skips.collect()}
    assert reasons == {"tight": "margin_above_variant_cap", "busy": "contracts_below_variant_floor", "far": "missing_short_leg"}


def test_adx_and_wilder_by_hand():
    n = 60
    rng = np.random.default_rng(1)
    close = 100 + rng.normal(size=n).cumsum()
    high, low = close + 1, close - 1
    pdf = pd.DataFrame({"ticker": "A", "ts": range(n), "high": high, "low": low, "close": close, "volume": 1.0})
    out = te._recursions(pdf)
    tr = [high[0] - low[0]] + [max(high[i] - low[i], abs(high[i] - close[i - 1]), abs(low[i] - close[i - 1])) for i in range(1, n)]
    atr = sum(tr[:14]) / 14
    for i in range(14, n):
        atr = (atr * 13 + tr[i]) / 14
    assert out["atr"].iloc[-1] == pytest.approx(atr)
    assert out["adx"].isna().sum() == 26 and out["adx"].dropna().between(0, 100).all()


def test_shuffle_keeps_values_and_moves_them(spark, tables):
    from catalog import fixtures as fx
    from tickloom.functions.layout import DAILY, UNKNOWN

    base = fx.bars(tables).select("ticker", "ts", "close").persist()
    a = lb.shuffle_within(base, "close", shape=DAILY)
    b = lb.shuffle_within(base, "close", shape=UNKNOWN)
    assert sorted(map(tuple, a.select("ticker", "ts", "close").collect())) == sorted(map(tuple, b.select("ticker", "ts", "close").collect()))
    moved = a.join(base.withColumnRenamed("close", "was"), ["ticker", "ts"]).filter("close <> was").count()
    assert moved > 0.9 * base.count()


def test_weights_sum_to_one(spark, folder):
    import __spark_entry__ as entry

    sums = entry.queries()["b2_score_weights"](spark, folder).groupBy("fold_id", "k").agg(F.sum("weight").alias("w"))
    assert sums.filter(F.abs(F.col("w") - 1) > 1e-4).count() == 0


def test_unknown_values_stay_unknown(spark):
    from tickloom.functions import rolling
    from tickloom.operators import cleaning, metrics, options

    rows = spark.createDataFrame([(None,), (9.0,), (-9.0,)], "x double")
    assert [r[0] for r in rows.select(rolling.clip(F.col("x"), -5.0, 5.0)).collect()] == [None, 5.0, -5.0]
    one = spark.createDataFrame([(1, 0.1)], "k int, r double")
    assert options.kelly(one, "r", ["k"]).first().fraction == 0.0
    frame = spark.createDataFrame([(1.0, "a"), (-1.0, "b")], "trend_30 double, style string")
    for predicate, left in (("Trend_30 > 0", 1), ("style == 'a'", 1), ("trend_30 > 1e-3", 1), ("absent > 0", 2)):
        assert cleaning.regime_filter(frame, predicate).count() == left
    scored = spark.createDataFrame([(1, float(i), float(i), None if i >= 90 else float(i), i % 2) for i in range(100)], "f int, s double, y double, r double, l int")
    got = metrics.fold_metrics(scored, ["f"], label="l", score="s", target="y", ret="r").first()
    assert (got["rows"], got.trade_count, got.top_decile) == (100, 90, 84.5)


def test_every_move_of_an_hour_counts(spark):
    from tickloom.operators import intraday

    bars = spark.sql("SELECT 'a' AS ticker, timestamp'2024-01-01 10:00:00' + make_interval(0,0,0,0,0,id) AS ts, 10D + id % 2 AS open, 12D AS high, 9D AS low, 10D + (id + 1) % 2 AS close, 1D AS volume FROM range(60)")
    assert intraday.hour_path(bars).first().stf15_sign_flip_rate > 0.9


def test_every_family_can_be_selected(tables):
    from catalog import fixtures as fx
    from tickloom.operators import intraday as it

    quarters = fx.quarter_bars(tables)
    known = set(it.research_panel(fx.bars(tables), fx.sectors(tables)).columns)
    for frame in (it.own_features(quarters), it.session_context(quarters), it.previous_session(quarters), it.quarter_path(quarters), it.hour_path(quarters)):
        known |= set(frame.columns)
    assert len(it.FAMILIES) == 25
    assert {c for names in it.FAMILIES.values() for c in names} <= known


def test_minute_norm_does_not_know_the_sessions_end(spark):
    from tickloom.operators import intraday as it

    bars = spark.range(8).selectExpr("'A' AS ticker", "timestamp'2024-01-02 09:15:00' + make_interval(0, 0, 0, 0, 0, 15 * CAST(id AS INT), 0) AS ts",
                                     "1D AS open", "2D AS high", "1D AS low", "1.5D AS close", "1D AS volume")
    whole = {r.ts: r.minute_norm for r in it.session_context(bars).collect()}
    part = {r.ts: r.minute_norm for r in it.session_context(bars.filter("ts < timestamp'2024-01-02 10:00:00'")).collect()}
    assert part == {ts: v for ts, v in whole.items() if ts in part} and max(whole.values()) == 8 / 25


def test_regime_names_without_case_or_underscores(spark):
    from tickloom.operators.cleaning import filter_applies, regime_filter

    frame = spark.createDataFrame([(0.2, "a"), (0.0005, "b"), (-1.0, "a")], "stock_minus_mkt_3 double, style string")
    assert regime_filter(frame, "StockMinusMkt_3 > 1e-3").count() == 1
    assert regime_filter(frame, "(Style == 'a') & (StockMinusMkt_3 < 0)").count() == 1
    assert filter_applies(frame.columns, "style == 'b'") and not filter_applies(frame.columns, "other > 1")
    assert regime_filter(frame, "other > 1").count() == 3


def test_a_pool_of_experiments_is_limited_to_ids():
    from tickloom.operators.labels import Experiment
    from tickloom.operators.selection import select_experiments

    one, two, three = (Experiment(i, "T1", 3, "binary", (), "logistic") for i in ("E1", "E2", "E3"))
    pools = {"base": [one, two], "next": [three, one]}
    assert select_experiments(pools, "base") == [one, two]
    assert select_experiments(pools, "base", [" E2 ", ""]) == [two]
    assert select_experiments(pools, "base", ["E3"]) == [three]  # absent from the pool, found in another
    assert select_experiments(pools, "next", ["E9"]) == []
    with pytest.raises(ValueError, match="unknown"):
        select_experiments(pools, "none")


def test_branches_keep_their_candidates_and_missing_values_come_last(spark):
    from tickloom.operators.selection import branch_compare

    schema = "experiment_id string, family string, real_auc double, real_balanced_accuracy double, real_spread_top_bottom double, gap_auc double, gap_balanced_accuracy double"
    rows = [("E1", "F", 0.6, 0.5, 0.1, 0.0, 0.0), ("E2", "F", float("nan"), 0.9, 0.9, None, 0.5), ("E3", "F", None, 0.9, 0.9, 0.9, 0.9), ("E4", None, 0.6, 0.7, None, 0.1, 0.1)]
    frame = spark.createDataFrame(rows, schema)
    current = frame.withColumn("promoted", F.col("experiment_id") == "E4")

    def got(score, candidates=None):
        found = branch_compare({"A": frame, "B": frame.filter("experiment_id = 'E9'")}, current, "P", score, candidates).collect()
        return {(r.branch, r.experiment_id, r.promoted) for r in found}

    assert got("generalization_next") == {("A", "E4", False), ("P_Candidate", "E4", True)}
    assert got("plain") == {("A", "E3", False), ("P_Candidate", "E4", True)}
    assert got("plain", {"A": ["E1", "E2"]}) == {("A", "E2", False), ("P_Candidate", "E4", True)}


def test_prices_are_reconciled_where_every_leg_is_quoted(spark):
    rows = [
        ("near", 1, 9.0, 11.0, 10.5), ("near", -1, 1.0, 3.0, 2.0),  # 8.0 against 8.5
        ("far", 1, 8.0, 9.0, 10.0),  # 8.5 against 10: short by exactly 15 %
        ("short", 1, 5.0, 6.0, 10.0), ("debit", -1, 5.0, 6.0, 5.0),  # a debit of 5.5 against one of 5
        ("no bid", 1, None, 2.0, 1.0), ("no bid", 1, 3.0, 4.0, 1.0), ("zero", 1, 0.0, 2.0, 1.0),
    ]
    got = {r.k: tuple(r)[3:] for r in op.reconcile_prices(spark.createDataFrame(rows, "k string, sign int, bid double, ask double, modelled double"), ["k"]).collect()}
    assert got == {"near": (-0.5, True, True), "far": (-1.5, False, True), "short": (-4.5, False, False), "debit": (-0.5, True, True)}
