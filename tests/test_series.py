"""Plans over whole series: bars that meet by ticker once, left-out models without a pass over all rows, and nothing cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog import fixtures as fx
from catalog.registry import Tables
from tickloom.operators.research import research_columns
from tickloom.plans import per_ticker as pt
from test_per_ticker import newton


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Lines of five suppliers, one of them unknown, on 420 days; some days have two, some lines come twice."""
    folder = tmp_path_factory.mktemp("lines")
    draw = np.random.default_rng(3)
    rows = []
    for supplier in range(5):
        for day in range(420):
            for k in range(1 + (day % 7 == 0)):
                row = (len(rows), day, None if supplier == 4 else supplier, k, float(draw.integers(1, 50)), float(draw.integers(1000, 90000)), 0.01 * (day % 9), 0.02 * (day % 4), day)
                rows += [row] * (1 + (day % 50 == 0))
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, day int"
    frame = spark.createDataFrame(rows, names).withColumn("l_shipdate", F.date_add(F.lit("2020-01-01").cast("date"), F.col("day")).cast("timestamp")).drop("day")
    frame.repartition(3).write.parquet(f"{folder}/lineitem.parquet")
    return Tables(spark, str(folder))


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line and "Reused" not in line for line in plan.splitlines())


@pytest.mark.parametrize("most", [10, 2_000_000])
def test_bars_of_series_are_the_bars(lines, monkeypatch, most):
    monkeypatch.setattr(fx, "TASK_ROWS", most)
    one, two = fx.series_bars(lines), fx.bars(lines)
    assert one.select(*two.columns).exceptAll(two).isEmpty() and one.count() == two.count() == 5 * 420


def test_lines_of_a_series_meet_once(lines):
    columns = research_columns(fx.series_bars(lines)).select("ticker", "ts", "lag_ret_1", "atr20_log")
    assert exchanges(columns) == 1 < exchanges(research_columns(fx.bars(lines)).select(*columns.columns))


def test_left_out_report_sees_all_labelled_rows(lines, spark):
    report = {r.ticker: r for r in entry.queries()["m11_leave_one_ticker_out"](spark, lines.folder).collect()}
    bars = fx.bars(lines).filter("ticker IS NOT NULL").toPandas().sort_values(["ticker", "ts"])
    for ticker, own in bars.groupby("ticker"):
        close = own["close"].to_numpy()
        moved = abs(close[5:] / close[:-5] - 1)[30:] >= 0.005
        assert report[ticker].samples >= moved.sum() > 300


@pytest.fixture(scope="module")
def crowd(spark):
    """300 tickers of a few rows and one with half of all rows; the last column follows the others."""
    draw = np.random.default_rng(5)
    rows = []
    for k in range(301):
        for i in range(int(draw.integers(5, 12)) if k else 2500):
            a, b = draw.normal(size=2)
            rows.append((f"T{k}", i, float(a), float(b * b * 50), int(0.8 * a + 0.01 * b + 0.4 * (k == 0) + draw.normal() > 0.2)))
    return spark.createDataFrame(rows, "ticker string, i int, a double, b double, label_up int").repartition(5).persist()


def test_models_from_the_expansion_are_single_fits(crowd, monkeypatch):
    """All but the largest ticker take the expansion: only the largest is fitted over all rows."""
    over_all = []
    whole = pt._newton
    monkeypatch.setattr(pt, "_newton", lambda rows, keys, *a: over_all.append(keys) or whole(rows, keys, *a))
    found = {r.ticker: [*r.weights, r.intercept] for r in pt.leave_one_out_logistic(crowd, ["a", "b"], direct=0).collect()}
    assert over_all[0] == [None] and "T0" in over_all[1] and len(over_all[1]) < 100
    data = crowd.toPandas()
    assert len(found) == 301
    for ticker in ["T0", "T1", "T57", "T300"]:
        rest = data[data["ticker"] != ticker]
        np.testing.assert_allclose(found[ticker], newton(rest[["a", "b"]].to_numpy(), rest["label_up"].to_numpy()), atol=1e-8)
    monkeypatch.undo()
    every = {r.ticker: [*r.weights, r.intercept] for r in pt.leave_one_out_logistic(crowd, ["a", "b"], direct=1000).collect()}
    np.testing.assert_allclose([found[k] for k in sorted(found)], [every[k] for k in sorted(found)], atol=1e-8)


def test_shuffles_meet_in_a_window(lines):
    """Daily series take one exchange where two numberings were joined, with the same rows; rows without a ticker still go."""
    from tickloom.functions.layout import UNKNOWN
    from tickloom.operators.labels import shuffle_within

    bars = fx.bars(lines).select("ticker", "ts", "high", "close").withColumn("close", F.when(F.dayofmonth("ts") > 2, F.col("close"))).repartition(3, "ts").persist()
    one, two = shuffle_within(bars, "close"), shuffle_within(bars, "close", shape=UNKNOWN)
    assert one.columns == two.columns and exchanges(one) == exchanges(bars) + 1
    assert one.exceptAll(two).isEmpty() and one.count() == two.count() == 4 * 420
    moved = one.join(bars.select("ticker", "ts", F.col("close").alias("old")), ["ticker", "ts"])
    assert moved.filter(~F.col("close").eqNullSafe(F.col("old"))).count() > 1000 and one.filter("close IS NULL").count() == bars.filter("close IS NULL AND ticker IS NOT NULL").count()


REGIME = "Trend_2h > -1 and StockMinusMkt_3 > -1e-1"
EXPERIMENTS = [
    ("T1", "regression", "gbt_reg", ["lag_ret_1"], None), ("T1", "regression", "elasticnet", None, REGIME), ("T1", "multiclass", "logistic", ["lag_ret_1"], REGIME),
    ("T6", "regression", "elasticnet", ["lag_ret_1", "trend_30"], "Nothing > 0"),
]


@pytest.fixture(scope="module")
def whole(lines):
    from catalog import models

    return models.panel(lines)


@pytest.mark.parametrize(("target", "kind", "model", "features", "regime"), EXPERIMENTS)
def test_narrow_panels_give_the_same_predictions(lines, whole, target, kind, model, features, regime):
    from catalog import models
    from tickloom.operators.labels import Experiment
    from tickloom.plans import experiments as ep

    experiment = Experiment("X", target, 3, kind, ("F1_TrendMomentum",), model, regime)
    narrow = models.panel(lines, [experiment], features)
    assert len(narrow.columns) < 12 < len(whole.columns)
    got, want = (ep.predict_oos(f, experiment, features, [(1, 2)], trees=2, kept=k).toPandas().sort_values(["ticker", "ts"], ignore_index=True) for f, k in ((narrow, True), (whole, False)))
    assert len(got) > 100 and (got["filter_applied"] == (regime == REGIME)).all()
    np.testing.assert_allclose(got["prediction"], want["prediction"], rtol=1e-6, atol=1e-9)
    assert got.drop(columns="prediction").equals(want.drop(columns="prediction"))


@pytest.mark.parametrize("shuffled", [True, False])
def test_labels_shuffled_in_the_panel_are_those_shuffled_later(lines, whole, shuffled):
    """The panel keeps rows without a ticker, which only real labels have."""
    from catalog import models
    from tickloom.operators.labels import Experiment
    from tickloom.plans import experiments as ep

    experiment = Experiment("X", "T3", 3, "binary", (), "elasticnet")
    before = models.panel(lines, [experiment], ["lag_ret_1"], shuffled=True)
    got, want = (ep.predict_oos(f, experiment, ["lag_ret_1"], [(1, 2)], shuffled=shuffled).select("ticker", "ts", "target_value", "realized_return") for f in (before, whole))
    assert got.count() > 100 and got.exceptAll(want).isEmpty() and got.count() == want.count()
    assert got.filter("ticker IS NULL").isEmpty() == shuffled


def test_gates_split_without_an_exchange_of_rows(lines):
    """A calendar of cuts is sent to the rows."""
    from catalog import models
    from tickloom.functions.layout import DAILY
    from tickloom.operators.splits import chrono_split

    frame = models.gate_frame(research_columns(fx.series_bars(lines)))
    model, metrics = models.ep.fit_gate(frame, models.FEATURES)
    row, total = metrics.first(), frame.count()
    assert row.samples_train == int(total * 0.8) and row.samples == total - row.samples_train
    assert frame.groupBy("ticker").count().agg(F.max("count")).first()[0] <= 300
    assert "SortMergeJoin" not in chrono_split(frame, 0.8, shape=DAILY)._jdf.queryExecution().executedPlan().toString()
