"""Boosted trees from histograms against Spark ML's own, and what a fit costs."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tickloom.plans import boosting as bo
from tickloom.plans import experiments as ep

FEATURES = ["a", "b", "few"]


@pytest.fixture(scope="module")
def rows(spark):
    """Labels that bend and jump along two features; one feature has four values, a class has a row in four."""
    rng = np.random.default_rng(3)
    a, b, few = rng.normal(size=900), rng.uniform(-1, 1, 900), rng.integers(0, 4, 900)
    y = a * b + (few == 2) + 0.3 * rng.normal(size=900)
    out = [(f"T{i % 9}", i, float(a[i]), float(b[i]), float(few[i]), float(y[i]), int(y[i] > 0.8)) for i in range(900)]
    return spark.createDataFrame(out, "ticker string, ts long, a double, b double, few double, y double, up int").repartition(3).persist()


def spark_scores(rows, classes, trees):
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="x")
    settings = {"featuresCol": "x", "maxIter": trees, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
    model = GBTClassifier(labelCol="up", weightCol="_weight", **settings) if classes else GBTRegressor(labelCol="y", **settings)
    train = ep.balanced_weights(rows, "up") if classes else rows
    out = Pipeline(stages=[assembled, model]).fit(train).transform(rows)
    return out.select("ts", (vector_to_array("probability")[1] if classes else F.col("prediction")).alias("p"))


@pytest.mark.parametrize("classes", [False, True])
def test_all_rows_and_features_give_sparks_own_trees(rows, classes):
    model = bo.BoostedTrees(FEATURES, "up" if classes else "y", classes, trees=12, rows=1.0, columns=1.0).fit(rows)
    ours = ep.score(model, rows, "gbt_clf" if classes else "gbt_reg").select("ts", "prediction")
    pairs = ours.join(spark_scores(rows, classes, 12), "ts").toPandas()
    assert len(pairs) == 900 and pairs.prediction.nunique() > 50
    assert np.allclose(pairs.prediction, pairs.p, atol=1e-9)


def test_a_level_is_one_pass_whose_sums_do_not_grow_with_rows(rows, monkeypatch):
    """Blocks of 100 rows in several tasks give the trees of one block, and a task returns sums by node, feature and bin."""
    whole = bo.BoostedTrees(FEATURES, "y", trees=3, rows=1.0, columns=1.0).fit(rows).getOrDefault("fitted")
    seen = []
    sums = bo.BoostedTrees._sums
    monkeypatch.setattr(bo, "BLOCK", 100)
    monkeypatch.setattr(bo, "LINEAGE", 2)
    monkeypatch.setattr(bo.BoostedTrees, "_sums", lambda self, *args: seen.append(sums(self, *args)) or seen[-1])
    cut = bo.BoostedTrees(FEATURES, "y", trees=3, rows=1.0, columns=1.0).fit(rows).getOrDefault("fitted")
    assert cut["cuts"] == whole["cuts"] and [t[:2] for t in cut["trees"]] == [t[:2] for t in whole["trees"]]
    assert np.allclose([t[2] for t in cut["trees"]], [t[2] for t in whole["trees"]])
    assert [s.shape for s in seen[:4]] == [(2, 1 << level, len(FEATURES), bo.BINS) for level in range(4)] and len(seen) == 12
    assert all(s[0, :, 0].sum() == pytest.approx(900) for s in seen)


def test_quantiles_of_all_rows_cut_like_all_values(rows, monkeypatch):
    exact = bo.BoostedTrees(FEATURES, "up", True, trees=1).fit(rows).getOrDefault("fitted")["cuts"]
    monkeypatch.setattr(bo, "EXACT", 100)
    near = bo.BoostedTrees(FEATURES, "up", True, trees=1).fit(rows).getOrDefault("fitted")["cuts"]
    assert near[2] == exact[2] == [0.5, 1.5, 2.5] and [len(c) for c in near] == [len(c) for c in exact]
    for f, a, b in zip(FEATURES, near, exact, strict=True):
        values = np.sort(rows.select(f).toPandas()[f].to_numpy())
        assert np.abs(np.searchsorted(values, a) - np.searchsorted(values, b)).max() <= 9


def test_draws_leave_rows_and_features_out(rows):
    model = bo.BoostedTrees(FEATURES, "y", trees=40)
    again, other = model.fit(rows).getOrDefault("fitted"), bo.BoostedTrees(FEATURES, "y", trees=40, seed=1).fit(rows).getOrDefault("fitted")
    assert again == model.fit(rows).getOrDefault("fitted") and again["trees"] != other["trees"]
    scores = ep.score(model.fit(rows), rows, "gbt_reg").toPandas()
    assert np.corrcoef(scores.prediction, scores.y)[0, 1] > 0.8


def test_boosted_models_are_kept_on_disk_and_refuse_nulls(rows, tmp_path):
    model = ep.fit(rows, FEATURES, "up", "gbt_clf", 900, trees=3)
    model.write().overwrite().save(str(tmp_path / "boosted"))
    read = PipelineModel.load(str(tmp_path / "boosted"))
    a, b = (ep.score(m, rows, "gbt_clf").select("ts", "prediction") for m in (model, read))
    assert a.exceptAll(b).count() == 0 and a.filter("prediction between 0 and 1").count() == 900
    with pytest.raises(Exception, match="null or not a number"):
        ep.score(model, rows.withColumn("a", F.lit(None).cast("double")), "gbt_clf").collect()


def test_equal_rows_are_not_split(spark):
    rows = spark.createDataFrame([(float(i % 2), 1.0, 2.0) for i in range(60)], "a double, b double, y double")
    model = ep.fit(rows, ["a", "b"], "y", "gbt_reg", 60, trees=2)
    assert {r.prediction for r in ep.score(model, rows, "gbt_reg").collect()} == {2.0}


def test_boosted_queries_keep_no_row_objects(spark):
    """The fit of a boosted model is the one whose rows are a byte a feature."""
    assert [type(s) for kind in ep.BOOSTED for s in ep.make_model(kind, FEATURES, 1).getStages()] == [bo.BoostedTrees] * 2
