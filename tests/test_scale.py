"""Plans that must not exchange more than the answer needs."""

from pyspark.sql import functions as F

from catalog import portfolio


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_portfolio_panel_is_narrow_and_read_without_an_exchange(tables):
    panel = portfolio.panel(tables)
    assert sorted(panel.columns) == sorted(["ticker", "ts", "close", "ret60", "atr20_log", "breadth_rel_adv_frac", "breadth_adv_frac"])
    assert "Exchange" not in _plan(panel) and "InMemoryTableScan" not in _plan(panel)


def test_snapshot_prices_are_not_exchanged_by_date(spark):
    from tickloom.operators.joins import next_snapshot

    prices = spark.range(0, 400, 1, 4).select(F.concat(F.lit("S"), F.col("id") % 4).alias("ticker"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 4).cast("int")).alias("ts"), F.col("id").cast("double").alias("close"))
    days = prices.groupBy("ts").agg(F.count(F.lit(1)).alias("n")).filter("day(ts) = 1")
    schedule = days.select(F.lit(1).alias("fold_id"), F.month("ts").alias("k"), "ts", F.date_add("ts", 7).alias("next_ts"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = next_snapshot(prices, schedule)
        assert _plan(out).count("BroadcastHashJoin") == 2 and out.count() == 16
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_legs_of_a_dealt_chain_are_not_exchanged(spark, tables):
    from catalog import fixtures as fx
    from catalog.options import _stocks
    from tickloom.operators import options as op

    chain, spots = _stocks(tables)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(op.bull_put_spreads(chain, spots))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # an exchange of legs stands on their explosion into strikes
    lines = plan.split("\n")
    above = [lines[i - 1 : i + 4] for i, x in enumerate(lines) if "Exchange hashpartitioning" in x and "expiry" in x]
    assert "ShuffledHashJoin" in plan
    assert not any("Generate" in x for group in above for x in group)
    assert chain.columns == fx.stock_chain(tables).columns


def test_folds_read_cleaned_and_shuffled_rows_that_are_written_once(spark):
    from tickloom.operators.labels import Experiment
    from tickloom.plans.experiments import predict_oos

    rows = [(f"T{i % 4}", f"2020-01-{1 + i // 4 % 28:02d}", 1 + i // 112, (i * 37 % 101) / 100, (i * 53 % 97) / 97 - 0.5, i * 29 % 2) for i in range(336)]
    frame = spark.createDataFrame(rows, "ticker string, ts string, window_id int, lag_ret_1 double, net double, up int")
    frame = frame.select("ticker", F.col("ts").cast("date").alias("ts"), "window_id", "lag_ret_1", F.col("up").alias("y_t3_cost_up_3"), F.col("up").alias("y_t4_upfirst_3"), F.col("net").alias("net_fwd_ret_3"), F.col("net").alias("raw_fwd_ret_3"))
    out = predict_oos(frame, Experiment("X", "T4", 3, "binary", (), "logistic"), ["lag_ret_1"], [(1, 2), (2, 3)], shuffled=True)
    assert "Window" not in _plan(out) and out.count() == 224


def test_cross_ranks_of_timestamps_that_fit_are_not_stacked(spark, monkeypatch):
    from tickloom.operators import intraday as it

    rows = [(f"T{i % 20:02d}", f"2020-01-{1 + i // 20:02d}", None if i % 9 == 0 else float(i * 7 % 5), float("nan") if i % 11 == 0 else i * 13 % 17 / 16, "s") for i in range(120)]
    panel = spark.createDataFrame(rows + [(None, "2020-01-01", 2.0, 3.0, "s")] + rows[:3], "ticker string, ts string, a double, b double, other string")
    wanted = {}
    for columns in (["ticker", "ts", "a", "b"], panel.columns):
        out = it.cross_ranks(panel.select(*columns), ["a", "b"])
        assert _plan(out).count("Exchange hashpartitioning") == 1 and "Generate" not in _plan(out)
        assert out.columns == [*columns, "xs_rank_a", "xs_rank_b"]
        wanted[len(columns)] = sorted(map(str, out.collect()))
    monkeypatch.setattr(it, "TASK_ROWS", 0)
    for columns in (["ticker", "ts", "a", "b"], panel.columns):
        assert sorted(map(str, it.cross_ranks(panel.select(*columns), ["a", "b"]).collect())) == wanted[len(columns)]


def test_sector_means_are_sent_to_the_panel(tables):
    from catalog import fixtures as fx
    from tickloom.operators import intraday as it

    own = it.own_features(fx.bars(tables), keep=["relative_volume_time", "realvol20"])
    assert "Exchange hashpartitioning(ticker" not in _plan(own) and "min_by" not in _plan(own)
    assert "Exchange hashpartitioning(ts" not in _plan(it.sector_relative(own, fx.sectors(tables))).split("_sector_ret_3")[0]


def test_folds_that_are_left_out_are_fitted_together(spark):
    from tickloom.plans import experiments as ep

    rows = [(f"T{i % 12:02d}", (i * 37 % 101) / 100, (i * 53 % 97) / 97, int((i * 37 % 101) / 100 + (i * 29 % 13) / 13 > 1)) for i in range(600)]
    frame = spark.createDataFrame(rows, "ticker string, a double, b double, label_up int")
    jobs = {}
    for folds in (3, 12):
        spark.sparkContext.setJobGroup(f"left-out-{folds}", "")
        assert ep.leave_one_out(frame, ["a", "b"], folds=folds).agg(F.sum("samples")).first()[0] == 600
        jobs[folds] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"left-out-{folds}"))
    assert jobs[12] <= jobs[3] + 5


def test_medians_order_only_what_is_near_the_middle(spark, monkeypatch):
    from tickloom.operators import rollups as ru

    df = spark.range(30_001).select(((F.col("id") * 7919 % 30_001) / 3.0).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id") * 1.0).alias("b"), F.lit(None).cast("double").alias("c"), (F.col("id") % 3).cast("double").alias("d"))
    seen, ranks = [], ru.value_ranks
    monkeypatch.setattr(ru, "value_ranks", lambda counts, *x: seen.append(counts.count()) or ranks(counts, *x))
    found = {r.label: r.median for r in ru.exact_medians(df, ["a", "b", "c", "d"]).collect()}
    assert found == {"a": 5000.0, "b": 15000.0, "d": 1.0} and seen[0] < 100
    assert ru.exact_medians(df.limit(0), ["a"]).collect() == []
    two = spark.createDataFrame([(1.0,), (4.0,)], "a double")
    assert ru.exact_medians(two, ["a"]).first().median == 2.5


def test_forest_is_fitted_in_parts(spark, monkeypatch):
    from tickloom.plans import experiments as ep

    fitted, make = [], ep.make_model
    monkeypatch.setattr(ep, "make_model", lambda kind, features, rows, label, trees=200, seed=42: fitted.append((kind, trees, seed)) or make(kind, features, rows, label, trees, seed))
    monkeypatch.setattr(ep, "TREES", 3)
    rows = [(f"T{i % 5}", f"2020-{1 + i // 140:02d}-{1 + i // 5 % 28:02d}", (i * 37 % 101) / 100, (i * 53 % 97) / 97 - 0.5) for i in range(560)]
    frame = spark.createDataFrame(rows, "ticker string, ts string, a double, target double").withColumn("ts", F.col("ts").cast("date"))
    out = ep.next_day_baseline(frame, ["a"], trees=7)
    assert fitted == [("linear", 7, 42), ("random_forest", 3, 42), ("random_forest", 3, 43), ("random_forest", 1, 44)]
    assert out.count() == 10 and out.filter("rows_test <> 33 AND rows_test <> 34").count() == 0


def test_sides_of_folds_share_one_order_of_the_scores(spark, monkeypatch):
    from tickloom.functions import layout
    from tickloom.operators import metrics as mt

    nan = float("nan")
    rows = [
        (["a", "b"][i % 2] if i % 40 else None, None if i % 31 == 0 else nan if i % 37 == 0 else 0.5 if i % 3 else (i * 37 % 101) / 100, None if i % 23 == 0 else float(i * 53 % 97) - 48, None if i % 29 == 0 else float(i * 29 % 7) - 3)
        for i in range(900)
    ]
    frame = spark.createDataFrame(rows, "f string, s double, y double, c double").withColumns({"ly": F.when(F.col("y").isNotNull(), (F.col("y") > 0).cast("int")), "lc": F.when(F.col("c") > 0, 1).otherwise(0)}).persist()
    sides = {"real_": ("ly", "y", "c"), "shuf_": ("lc", "c", "c")}
    monkeypatch.setattr(layout, "RANGE_ROWS", 50)
    written, write = [], mt.stored
    monkeypatch.setattr(mt, "stored", lambda df, name: written.append(name) or write(df, name))
    monkeypatch.setattr(layout, "in_ranges", lambda *x: 1 / 0)
    for kind in (None, "binary", "regression"):
        got = mt.fold_metrics_of(frame, ["f"], sides, "s", kind).collect()
        for side, (label, target, ret) in sides.items():
            wanted = {r.f: r for r in mt.fold_metrics(frame, ["f"], label, "s", target, ret, layout.Shape(stamp_rows=1000), kind).collect()}
            assert len(wanted) == len(got) == 3
            for r in got:
                for c in ("rows", "auc", "trade_count", "top_decile", "bottom_decile", "ic_spearman", "spread", "balanced_accuracy"):
                    a, b = r[side + c], wanted[r.f][c]
                    assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9), (kind, side, r.f, c, a, b)
    assert written == ["scored"] * 3
    assert mt.fold_metrics_of(frame.limit(0), ["f"], sides, "s").collect() == []


def test_a_value_of_many_rows_does_not_meet_in_one_task(spark, monkeypatch):
    from tickloom.functions import layout

    monkeypatch.setattr(layout, "RANGE_ROWS", 100)
    df = spark.range(4000).select(F.lit("x").alias("k"), F.when(F.col("id") % 10 < 9, 1.0).otherwise(F.col("id") * 1.0).alias("v"), F.lit(1).alias("w"))
    ends = layout.range_ends(df, ["k"], ["v"]).persist()
    rows = df.join(ends.select("k", "_g"), "k")
    seen = layout.placed(rows, rows, ends, "v", ["w"])
    plan = _plan(seen)
    # as many tasks as ranges, whatever the packed rows weigh, and no second exchange for the windows
    assert "REPARTITION_BY_NUM" in plan and ", 40)" in plan and plan.count("Exchange hashpartitioning(_g") <= 3 and "_spread" in plan
    found = {(r.v, r.low_w, r.same_w, r.n_w) for r in seen.select("v", "low_w", "same_w", "n_w").collect()}
    tail = sorted(i * 1.0 for i in range(4000) if i % 10 == 9)
    assert found == {(1.0, 0, 3600, 4000)} | {(v, 3600 + i, 1, 4000) for i, v in enumerate(tail)}


def test_forward_returns_are_not_exchanged_by_day(tables):
    from catalog import fixtures as fx
    from tickloom.operators import labels as lb

    plan = _plan(lb.relative_forward_return(fx.bars(tables), 3))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
