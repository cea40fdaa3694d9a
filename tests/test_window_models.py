"""Elastic nets from moments against Spark ML's own fit and the conditions of the optimum on the rows themselves."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tickloom.plans.window_models import descend, elastic_nets, scored_by_windows

FEATURES = ["a", "b", "c", "price", "flat"]


@pytest.fixture(scope="module")
def rows(spark):
    """Three windows of different relations; two features nearly agree, one is far from zero, one never varies."""
    rng = np.random.default_rng(5)
    out = []
    for window in (1, 2, 3):
        x = rng.normal(size=(300, 3))
        x[:, 1] = x[:, 0] + 0.05 * x[:, 1]
        price = 5000 + rng.normal(size=300)
        y = 0.02 * window * x[:, 0] - 0.01 * x[:, 2] + 0.005 * (price - 5000) + 0.01 * rng.normal(size=300)
        out += [(f"T{i % 7}", i, window, *map(float, x[i]), float(price[i]), 2.0, float(y[i])) for i in range(300)]
    schema = "ticker string, ts long, window_id int, a double, b double, c double, price double, flat double, y double"
    return spark.createDataFrame(out, schema).repartition(5).persist()


def test_conditions_of_the_optimum(rows):
    l1, l2 = 0.003, 0.002
    pdf = rows.toPandas()
    fits = {r.window_id: r for r in elastic_nets(rows, FEATURES, "y", l1=l1, l2=l2).collect()}
    assert sorted(fits) == [1, 2, 3]
    for window, fit in fits.items():
        own = pdf[pdf.window_id == window]
        x, y = own[FEATURES].to_numpy(), own.y.to_numpy()
        scale = np.where(x.std(0) > 0, x.std(0), 1.0)
        z, weights = (x - x.mean(0)) / scale, np.array(fit.weights) * scale
        assert fit.rows_train == 300 and weights[-1] == 0
        residual = y - fit.intercept - x @ np.array(fit.weights)
        assert abs(residual.mean()) < 1e-9
        slope = z.T @ residual / 300 - l2 * weights
        assert np.allclose(slope[weights != 0], l1 * np.sign(weights[weights != 0]), atol=1e-7)
        assert (np.abs(slope) <= l1 + 1e-7).all()


def test_equals_the_stock_fit(rows):
    """The stock estimator divides the second penalty by the label's deviation."""
    names = FEATURES[:4]
    for window in (1, 3):
        own = rows.filter(F.col("window_id") == window)
        sigma = own.agg(F.stddev_pop("y")).first()[0]
        net = LinearRegression(featuresCol="_x", labelCol="y", regParam=0.004, elasticNetParam=0.5, standardization=False, maxIter=1000, tol=1e-10)
        stages = [VectorAssembler(inputCols=names, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), net]
        model = Pipeline(stages=stages).fit(own)
        stock = {(r.ticker, r.ts): r.prediction for r in model.transform(own).collect()}
        fits = elastic_nets(own, names, "y", l1=0.002, l2=0.002 / sigma)
        ours = {(r.ticker, r.ts): r.prediction for r in scored_by_windows(own, fits, names, [(window, window)]).collect()}
        assert ours.keys() == stock.keys() and max(abs(ours[k] - stock[k]) for k in stock) < 1e-4


def test_partitions_change_nothing(rows):
    one, many = ({r.window_id: r for r in elastic_nets(d, FEATURES, "y").collect()} for d in (rows.coalesce(1), rows.repartition(11)))
    for window, fit in one.items():
        assert np.allclose(fit.weights, many[window].weights, atol=1e-9) and fit.rows_train == many[window].rows_train


def test_incomplete_rows_belong_to_no_sum(spark, rows):
    columns = [F.lit(None).cast("double").alias(c) if c == "a" else F.lit(float("nan")).alias(c) if c == "b" else F.col(c) for c in rows.columns]
    fits = elastic_nets(rows.unionByName(rows.select(*columns)), FEATURES, "y").collect()
    assert [r.rows_train for r in fits] == [300] * 3
    assert elastic_nets(rows.filter("false"), FEATURES, "y").count() == 0


def test_each_pair_of_windows_scores_once(rows):
    fits = elastic_nets(rows, FEATURES, "y")
    scored = scored_by_windows(rows, fits, FEATURES, [(1, 2), (1, 3), (2, 3)])
    counts = {(r.train_window_id, r.window_id): r["count"] for r in scored.groupBy("train_window_id", "window_id").count().collect()}
    assert counts == {(1, 2): 300, (1, 3): 300, (2, 3): 300}


def test_descent_on_nothing_and_on_a_lone_feature():
    assert descend(np.zeros((0, 0)), np.zeros(0), 0.1, 0.1).tolist() == []
    assert descend(np.eye(1), np.array([0.5]), 0.1, 1.0).tolist() == pytest.approx([0.2])
    assert descend(np.eye(1), np.array([-0.05]), 0.1, 1.0).tolist() == [0.0]
