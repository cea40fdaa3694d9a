"""Model fits on the smallest panel."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from catalog.models import FEATURES
from tickloom.plans import experiments as ep


@pytest.fixture(scope="module")
def toy(spark):
    """A label that one feature predicts well."""
    return spark.range(600).select(
        F.concat(F.lit("T"), (F.col("id") % 3).cast("string")).alias("ticker"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 3).cast("int")).alias("ts"),
        ((F.col("id") * 37) % 100 / 100.0).alias("a"),
        ((F.col("id") * 53) % 71 / 71.0).alias("b"),
    ).withColumn("label_up", F.when(F.col("a") + 0.1 * F.col("b") > 0.5, 1).otherwise(0)).persist()


def test_logistic_separates_and_reloads(toy, tmp_path):
    model, metrics = ep.fit_gate(toy, ["a", "b"], 0.7)
    row = metrics.first()
    assert row.samples_train == 420 and row.samples == 180 and row.auc > 0.95
    model.write().overwrite().save(str(tmp_path / "gate"))
    again = PipelineModel.load(str(tmp_path / "gate"))
    a = ep.attach_gate(toy, model, ["a", "b"]).select("ticker", "ts", "a", F.round("gate_prob_up", 9).alias("p"))
    b = ep.attach_gate(toy, again, ["a", "b"]).select("ticker", "ts", "a", F.round("gate_prob_up", 9).alias("p"))
    assert a.exceptAll(b).count() == 0


def test_balanced_weights_sum_to_rows(toy):
    weighted = ep.balanced_weights(toy, "label_up")
    sums = {r.label_up: r.w for r in weighted.groupBy("label_up").agg(F.sum("_weight").alias("w")).collect()}
    assert sums[0] == pytest.approx(300) and sums[1] == pytest.approx(300)


def test_coefficients_point_the_right_way(spark, toy):
    model = ep.fit(toy, ["a", "b"], "label_up", "logistic", 600)
    top = ep.coefficients(model, ["a", "b"], spark).orderBy("rank").first()
    assert top.feature == "a" and top.coefficient > 0


def test_boosted_classifier_scores(toy):
    model = ep.fit(toy, ["a", "b"], "label_up", "gbt_clf", 600, trees=3)
    assert ep.score(model, toy, "gbt_clf").filter("prediction between 0 and 1").count() == 600


@pytest.mark.parametrize("name", ["m1_m10_elastic_net_predictions", "m4_boosted_classifier", "m11_leave_one_out"])
def test_registered_models_run(spark, folder, name):
    import __spark_entry__ as entry

    assert entry.queries()[name](spark, folder).count() > 0


def test_small_folds_are_skipped(spark, tables):
    from catalog.models import PAIRS
    from tickloom.operators.labels import Experiment

    from catalog.models import panel

    tiny = panel(tables).filter("window_id = 9 OR (window_id = 8 AND ts < date'1990-01-01')")
    assert ep.predict_oos(tiny, Experiment("X", "T6", 3, "regression", (), "elasticnet"), FEATURES, PAIRS) is None


@pytest.fixture(scope="module")
def folds(spark):
    """Two windows whose labels follow one feature; the last rows have no return."""
    x = ((F.col("id") * 37) % 101 / 101.0).alias("lag_ret_1")
    frame = spark.range(400).select(
        F.concat(F.lit("T"), (F.col("id") % 4).cast("string")).alias("ticker"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 4).cast("int")).alias("ts"),
        F.when(F.col("id") < 200, 1).otherwise(2).alias("window_id"), x, (F.col("id") % 7).cast("double").alias("trend_30"),
    )
    sign = F.when(F.col("lag_ret_1") > 0.66, 1.0).when(F.col("lag_ret_1") < 0.33, -1.0).otherwise(0.0)
    return frame.select("*", sign.alias("y_t1_dir_3"), (F.col("lag_ret_1") - 0.5).alias("net_fwd_ret_3"), (sign > 0).cast("int").alias("y_t4_upfirst_3")).persist()


@pytest.mark.parametrize(("kind", "target", "model"), [("regression", "T1", "elasticnet"), ("binary", "T4", "logistic"), ("multiclass", "T1", "logistic")])
def test_metrics_follow_the_label_type(folds, kind, target, model):
    from tickloom.operators.labels import Experiment

    row = ep.run_experiment(folds, Experiment("X", target, 3, kind, ("F1_TrendMomentum",), model, "Trend_30 > 3"), None, [(1, 2)]).first()
    assert row.rows == folds.filter("window_id = 2 AND trend_30 > 3").count() and row.filter_applied and row.train_window_id == 1
    assert (row.ic_spearman is not None) == (kind == "regression")
    assert (row.auc is not None) == (kind == "binary")
    assert (row.balanced_accuracy is None) == (kind == "regression")
    if kind == "multiclass":
        assert row.balanced_accuracy > 0.9 and row.top_decile is None and 0 < row.trade_count < row.rows


def test_a_regime_on_an_unknown_column_is_reported(folds):
    from tickloom.operators.labels import Experiment

    row = ep.run_experiment(folds, Experiment("X", "T1", 3, "regression", ("F1_TrendMomentum",), "elasticnet", "Nothing > 3"), None, [(1, 2)]).first()
    assert row.rows == 200 and not row.filter_applied
