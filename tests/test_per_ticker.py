"""Models of each ticker's own against single fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.plans import experiments as ep
from tickloom.plans import per_ticker as pt


@pytest.fixture(scope="module")
def panel(spark):
    """Ten tickers of unequal length, one of them too short; the third feature is the sum of the first two."""
    draw = np.random.default_rng(4)
    rows = []
    for k in range(10):
        for i in range(150 if k == 9 else 200 + 30 * k):
            a, b = draw.normal(size=2)
            rows.append((f"T{k}", i, float(a), float(b) * 100, float(a + b * 100), float(0.5 * a - 0.002 * b + draw.normal() * 0.3 + 0.1 * k)))
    frame = spark.createDataFrame(rows, "ticker string, i int, a double, b double, c double, target double")
    frame = frame.withColumn("ts", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i"))).withColumn("label_up", (F.col("target") > 0.3).cast("int"))
    return frame.repartition(6).persist()


def test_lines_are_those_of_single_fits(panel):
    got = pt.next_day_lines(panel.withColumn("a", F.when(F.col("i") != 5, F.col("a"))), ["a", "b", "c"]).toPandas()
    data = panel.toPandas().sort_values("i")
    assert set(got["ticker"]) == {f"T{k}" for k in range(1, 9)}  # T0 has 199 complete rows, T9 is short
    for ticker, own in data.groupby("ticker"):
        own = own[own["i"] != 5]
        cut = int(len(own) * 0.7)
        x = np.column_stack([np.ones(len(own)), own[["a", "b", "c"]]])
        line = np.linalg.lstsq(x[:cut], own["target"][:cut], rcond=None)[0]
        rows = got[got["ticker"] == ticker].sort_values("ts")
        if len(rows):
            assert (rows["rows_train"] == cut).all() and (rows["rows_total"] == len(own)).all()
            np.testing.assert_allclose(rows["prediction"], x[cut:] @ line, atol=1e-8)


def test_strategies_roll_up(panel):
    stats = pt.sign_strategy(pt.next_day_lines(panel, ["a", "b"]))
    rows = stats.toPandas()
    assert len(rows) == 9 and (rows["rows_test"] + rows["rows_train"] == rows["rows_total"]).all() and rows["hit_rate"].between(0, 1).all()
    up = pt.strategy_roll_up(stats.withColumn("model", F.lit("linear"))).first()
    assert up.tickers == 9 and up.median_sharpe == pytest.approx(rows["sharpe"].median()) and up.mean_sharpe == pytest.approx(rows["sharpe"].mean())


def newton(x, y):
    mean, scale = x.mean(0), x.std(0, ddof=1)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    ridge, at = np.diag([1.0] * x.shape[1] + [0.0]), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ at))
        at -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (p - y)) + ridge @ at)
    weights = at[:-1] / scale
    return np.append(weights, at[-1] - weights @ mean)


def test_each_left_out_model_is_a_single_fit(spark, panel):
    found = {r.ticker: [*r.weights, r.intercept] for r in pt.leave_one_out_logistic(panel, ["a", "b"]).collect()}
    data = panel.toPandas()
    assert len(found) == 10
    for ticker, model in found.items():
        rest = data[data["ticker"] != ticker]
        np.testing.assert_allclose(model, newton(rest[["a", "b"]].to_numpy(), rest["label_up"].to_numpy()), atol=1e-8)
    rest = panel.filter("ticker <> 'T3'")
    spark_model = ep.fit(rest, ["a", "b"], "label_up", "logistic", rest.count())
    theirs = ep.score(spark_model, panel.filter("ticker = 'T3'"), "logistic", "p").select("ts", "p")
    w = found["T3"]
    ours = 1 / (1 + F.exp(-(F.lit(w[2]) + F.lit(w[0]) * F.col("a") + F.lit(w[1]) * F.col("b"))))
    apart = theirs.join(panel.filter("ticker = 'T3'").select("ts", ours.alias("q")), "ts").agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0]
    assert apart < 1e-3


def test_report_and_one_class(spark, panel):
    report = pt.leave_one_out_report(panel, ["a", "b"]).toPandas()
    assert len(report) == 10 and report["samples"].sum() == panel.count() and report["auc"].min() > 0.7
    ones = panel.withColumn("label_up", F.lit(1))
    assert pt.leave_one_out_logistic(ones, ["a", "b"]).collect() == []
