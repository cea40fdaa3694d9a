"""Walk-forward experiments on Spark ML. The driver loops over model fits only; rows stay in Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.draws import draw
from tickloom.functions.layout import DAILY, UNKNOWN, Shape
from tickloom.functions.session import stored
from tickloom.operators.cleaning import clean_xy, filter_applies, regime_filter, resolve_predicate, tail_rows
from tickloom.operators.intraday import FAMILIES
from tickloom.operators.labels import Experiment, future_direction, shuffle_within, target_columns
from tickloom.operators.metrics import accuracy, class_metrics, fold_metrics, roc_auc
from tickloom.operators.splits import chrono_split
from tickloom.plans.boosting import BoostedTrees
from tickloom.plans.per_ticker import leave_one_out_scores
from tickloom.plans.window_models import elastic_nets, scored_by_windows

CLASSIFIERS = ("logistic", "gbt_clf")
BOOSTED = ("gbt_reg", "gbt_clf")


def make_model(kind: str, features: Sequence[str], rows: int, label: str = "label", trees: int = 200, seed: int = 42) -> Pipeline:
    """Pipeline of a model class. ``rows`` turns the penalty per data set into Spark's penalty per row."""
    assembled = VectorAssembler(inputCols=list(features), outputCol="_raw")
    scaled = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)
    common = {"labelCol": label, "predictionCol": "_prediction"}
    # fixed values: penalties and tree settings of each model class
    if kind == "elasticnet":
        model = LinearRegression(featuresCol="_x", regParam=0.001, elasticNetParam=0.5, standardization=False, maxIter=1000, **common)
    elif kind == "linear":
        model = LinearRegression(featuresCol="_x", regParam=0.0, **common)
    elif kind == "logistic":
        model = LogisticRegression(
            featuresCol="_x", regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False, maxIter=5000, weightCol="_weight",
            probabilityCol="_probability", rawPredictionCol="_margin", **common,
        )
    elif kind in BOOSTED:
        # bins keep the order of values, so nothing is scaled
        return Pipeline(stages=[BoostedTrees(features, label, kind == "gbt_clf", trees)])
    elif kind == "random_forest":
        model = RandomForestRegressor(featuresCol="_x", numTrees=trees, seed=seed, **common)
    else:
        raise ValueError(f"unknown model class {kind}")
    return Pipeline(stages=[assembled, scaled, model])


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Rows weighted so that every class counts the same."""
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    totals = classes.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    # one row per class, and a one-row table
    weights = classes.join(F.broadcast(totals)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("_weight"))
    return df.join(F.broadcast(weights), label)


def class_number(label: str, classes: Sequence[float]) -> Column:
    """Position of a label among the classes, from 0: Spark fits no other labels."""
    return (F.array_position(F.array(*[F.lit(float(c)) for c in classes]), F.col(label).cast("double")) - 1).cast("double")


def fit(df: DataFrame, features: Sequence[str], label: str, kind: str, rows: int, trees: int = 200, classes: Sequence[float] | None = None) -> PipelineModel:
    train = balanced_weights(df, label) if kind == "logistic" else df
    if classes is not None:
        train = train.withColumn(label, class_number(label, classes))
    return make_model(kind, features, rows, label, trees).fit(train)


def score(model: PipelineModel, df: DataFrame, kind: str, name: str = "prediction", classes: Sequence[float] | None = None) -> DataFrame:
    """Probability of the second class for classifiers, or the predicted one of ``classes``; else the predicted value."""
    out = model.transform(df)
    value = F.col("_prediction")
    if classes is not None:
        value = F.get(F.array(*[F.lit(float(c)) for c in classes]), value.cast("int"))
    elif kind in CLASSIFIERS:
        value = vector_to_array("_probability")[1]
    return out.select(*df.columns, value.alias(name))


# fixed values: columns an experiment sees besides its families' and its labels
BASE_COLUMNS = (
    "ticker", "ts", "window_id", "open", "high", "low", "close", "atr20_log", "mkt_ret_1", "trend_30", "trend_2h", "stock_minus_mkt_1",
    "stock_minus_mkt_3", "breakout_3bar", "sign_persistence_5", "xs_rank_stock_minus_mkt_3", "breadth_trend_pressure",
)
#: what a shuffled label's name begins with
SHUFFLED = "shuffled_"


def experiment_features(panel: DataFrame, experiment: Experiment) -> list[str]:
    """Columns of the experiment's feature families, as far as the panel has them."""
    wanted = {c for family in experiment.feature_families for c in FAMILIES[family]}
    return sorted(wanted & set(panel.columns))


def columns_seen(columns: Sequence[str], experiment: Experiment, features: Sequence[str]) -> list[str]:
    ours, labels = {*BASE_COLUMNS, *features}, f"_{experiment.horizon}"
    return [c for c in columns if c in ours or c.endswith(labels)]


def columns_read(panel: DataFrame, experiments: Sequence[Experiment], features: Sequence[str] | None = None) -> list[str]:
    """Columns of a panel that experiments use: keys, features, both labels and those their regimes name. Without the others results stay."""
    used = {"ticker", "ts", "window_id"}
    for experiment in experiments:
        ours = experiment_features(panel, experiment) if features is None else list(features)
        used |= {*ours, *target_columns(experiment)}
        if experiment.regime_filter:
            seen = columns_seen(panel.columns, experiment, ours)
            sql = resolve_predicate(experiment.regime_filter, seen)[0]
            used |= {c for c in seen if f"`{c}`" in sql}
    return [c for c in panel.columns if c in used]


def with_shuffled(panel: DataFrame, experiment: Experiment, shape: Shape = DAILY) -> DataFrame:
    """The panel with the experiment's label shuffled within each ticker, as :func:`predict_oos` does, under a name of its own.

    Shuffled before a panel is written, labels need no exchange where the panel's tickers are together.
    """
    label, _ = target_columns(experiment)
    return shuffle_within(panel.withColumn(SHUFFLED + label, F.col(label).cast("double")), SHUFFLED + label, shape=shape, unnamed=True)


def experiment_frame(panel: DataFrame, experiment: Experiment, features: Sequence[str]) -> tuple[DataFrame, bool]:
    """The columns an experiment sees, filtered to its regime, and whether the filter applied.

    A regime that names a column outside this frame filters nothing.
    """
    seen = panel.select(*columns_seen(panel.columns, experiment, features))
    return regime_filter(seen, experiment.regime_filter), filter_applies(seen.columns, experiment.regime_filter)


def predict_oos(
    panel: DataFrame, experiment: Experiment, features: Sequence[str] | None, pairs: Sequence[tuple[int, int]],
    shuffled: bool = False, trees: int = 200, shape: Shape = DAILY, kept: bool = False,
) -> DataFrame | None:
    """Out-of-sample predictions over all (train window, test window) pairs; folds too small, or of one class, are skipped.

    Without ``features`` the experiment's families give them. The regime filters rows first. Labels are shuffled over all
    windows at once, realised returns never; a panel without regime may hold them shuffled (:func:`with_shuffled`). One
    aggregate tells which folds qualify and which classes their labels have. A panel that is ``kept`` in files, a window's rows
    together, is read by each fit as it is.
    Elastic nets of all windows are fitted in one pass, other models fold by fold.
    """
    features = experiment_features(panel, experiment) if features is None else list(features)
    label, realised = target_columns(experiment)
    data, applied = experiment_frame(panel, experiment, features)
    if not features or not {label, realised} <= set(data.columns):
        return None
    ready = SHUFFLED + label in panel.columns and not applied
    data = data.withColumn("_y", F.col(SHUFFLED + label if shuffled and ready else label).cast("double"))
    if shuffled and not ready:
        data = shuffle_within(data, "_y", shape=shape)
    used = data.select("ticker", "ts", "window_id", *features, "_y", F.col(realised).alias("realized_return"))
    clean = clean_xy(used, [*features, "_y"])
    kind = "gbt_clf" if experiment.label_type == "binary" and experiment.model_class == "gbt_reg" else experiment.model_class
    if (kind == "logistic" or kind in BOOSTED) and not (kept and (ready or not shuffled)):
        # every fold fits and scores its own windows: shuffled and cleaned once, and a window's rows lie together in the files
        clean = stored(clean.sortWithinPartitions("window_id"), "clean")
    # a label of classes has a few distinct values
    values = F.sort_array(F.collect_set("_y")) if kind in CLASSIFIERS else F.lit(None)
    folds = {r.window_id: r for r in clean.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), values.alias("classes")).collect()}
    pairs = [(a, b) for a, b in pairs if a in folds and b in folds and folds[a].n >= 50 and folds[b].n >= 20]

    def shaped(scored: DataFrame) -> DataFrame:
        return scored.select(
            "ticker", "ts", "window_id", F.lit(experiment.experiment_id).alias("experiment_id"), "train_window_id", "prediction",
            F.col("_y").alias("target_value"), "realized_return", F.lit(shuffled).alias("shuffled"), F.lit(applied).alias("filter_applied"),
        )

    if kind == "elasticnet":
        fits = elastic_nets(clean.filter(F.col("window_id").isin([a for a, _ in pairs])), features, "_y")
        return shaped(scored_by_windows(clean, fits, features, pairs)) if pairs else None
    out = None
    for train_id, test_id in pairs:
        classes = folds[train_id].classes
        if classes is not None and len(classes) < 2:
            continue
        model = fit(clean.filter(F.col("window_id") == train_id), features, "_y", kind, folds[train_id].n, trees, classes)
        named = classes if experiment.label_type == "multiclass" else None
        scored = shaped(score(model, clean.filter(F.col("window_id") == test_id).withColumn("train_window_id", F.lit(train_id)), kind, classes=named))
        out = scored if out is None else out.unionByName(scored)
    return out


def run_experiment(panel: DataFrame, experiment: Experiment, features: Sequence[str] | None, pairs: Sequence[tuple[int, int]],
                   shuffled: bool = False, trees: int = 200, kept: bool = False) -> DataFrame | None:
    """Fold metrics of an experiment, by its label type; ``rows`` counts the regime's rows of the test window before cleaning."""
    features = experiment_features(panel, experiment) if features is None else list(features)
    predicted = predict_oos(panel, experiment, features, pairs, shuffled, trees, kept=kept)
    if predicted is None:
        return None
    keys = ["experiment_id", "train_window_id", "window_id", "filter_applied"]
    if experiment.label_type == "multiclass":
        metrics = class_metrics(predicted, keys)
    else:
        labelled = predicted.withColumn("label", F.when(F.col("target_value") > 0, 1).otherwise(0))
        metrics = fold_metrics(labelled, keys, target="target_value", ret="realized_return", label_type=experiment.label_type).drop("rows")
    counts = experiment_frame(panel, experiment, features)[0].groupBy("window_id").agg(F.count(F.lit(1)).alias("rows"))
    # one row per window
    return metrics.join(F.broadcast(counts), "window_id").select(
        "*", F.lit(experiment.target_id).alias("target_id"), F.lit(experiment.model_class).alias("model_class"),
        F.lit(experiment.label_type).alias("label_type"), F.lit("|".join(experiment.feature_families)).alias("feature_families"),
        F.lit(shuffled).alias("shuffled"),
    )


def training_frame(panel: DataFrame, features: Sequence[str], horizon: int = 5, min_move: float = 0.0, cap: int | None = None, shape: Shape = DAILY) -> DataFrame:
    """Labelled rows of all tickers, the last ``cap`` of each, complete in every feature."""
    labelled = future_direction(panel, horizon, min_move, shape)
    if cap is not None:
        labelled = tail_rows(labelled, cap)
    return clean_xy(labelled.select("ticker", "ts", "close", *features, "future_return", "label_up"), [*features, "future_return"])


def fit_gate(frame: DataFrame, features: Sequence[str], ratio: float = 0.8, shape: Shape = DAILY) -> tuple[PipelineModel, DataFrame]:
    """Signal gate: balanced logistic on the first part of time, metrics on the rest."""
    split = chrono_split(frame, ratio, shape=shape).persist()
    train, test = split.filter("segment = 'train'"), split.filter("segment = 'test'")
    sizes = split.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg("label_up").alias("p"))
    rows = train.count()
    model = fit(train, features, "label_up", "logistic", rows)
    scored = score(model, test, "logistic", "prob")
    metrics = accuracy(scored, "label_up", "prob").join(F.broadcast(roc_auc(scored, "label_up", "prob").select("auc")))
    train_rate = sizes.filter("segment = 'train'").select(F.col("n").alias("samples_train"), F.col("p").alias("positive_rate_train"))
    return model, metrics.join(F.broadcast(train_rate))


def gate_decision(prob: Column, long_at: float = 0.55, short_at: float = 0.55) -> Column:
    return F.when(prob >= long_at, "allow_long").when(1.0 - prob >= short_at, "allow_short").otherwise("gate_hold")


def attach_gate(df: DataFrame, model: PipelineModel, features: Sequence[str], long_at: float = 0.55, short_at: float = 0.55) -> DataFrame:
    """Probabilities and decision of a fitted gate; missing features count as zero."""
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in features else F.col(c) for c in df.columns])
    scored = score(model, filled, "logistic", "gate_prob_up")
    p = F.col("gate_prob_up")
    return scored.select(
        "*", (1.0 - p).alias("gate_prob_down"), (p >= long_at).cast("int").alias("gate_allow_long"),
        (1.0 - p >= short_at).cast("int").alias("gate_allow_short"), gate_decision(p, long_at, short_at).alias("gate_decision"),
    )


def gated_action(action: Column, prob: Column, long_at: float = 0.55, short_at: float = 0.55) -> Column:
    """Buy (1) or sell (2) becomes hold (0) where its probability is below the threshold."""
    return F.when((action == 1) & (prob < long_at), 0).when((action == 2) & (1.0 - prob < short_at), 0).otherwise(action)


def coefficients(model: PipelineModel, features: Sequence[str], spark, n: int = 8) -> DataFrame:
    """The ``n`` largest and ``n`` smallest coefficients (as many rows as features at most)."""
    values = sorted(zip(features, [float(v) for v in model.stages[-1].coefficients]), key=lambda p: -p[1])
    ends = values if len(values) <= 2 * n else values[:n] + values[-n:]
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(ends)], "feature string, coefficient double, rank int")


def leave_one_out(frame: DataFrame, features: Sequence[str], key: str = "ticker", folds: int | None = None) -> DataFrame:
    """Logistic diagnostic of each value of ``key`` by a model that has not seen it.

    One fit per value leaves out that value alone. With ``folds``, values are dealt into that many groups by hash and a fit
    leaves out a whole group, so the number of fits does not grow with the values. All fits read the rows together.
    """
    dealt = frame.withColumn("_fold", F.col(key) if folds is None else draw(0, key) % folds)
    scored = stored(leave_one_out_scores(dealt, features, "_fold", carry=[key]), "scores")
    return accuracy(scored, "label_up", "prob", [key]).join(roc_auc(scored, "label_up", "prob", [key]).select(key, "auc"), key, "left")


#: trees a forest fits at once: Spark keeps a count for each of them beside every row
TREES = 20


def forest_scores(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, trees: int) -> DataFrame:
    """Mean prediction of ``trees`` trees. They are fitted in parts, whose bagged rows are dropped before the next, and differ by seed."""
    parts = [min(TREES, trees - first) for first in range(0, trees, TREES)]
    scored, total = test, F.lit(0.0)
    for i, n in enumerate(parts):
        model = make_model("random_forest", features, 1, label, n, 42 + i).fit(train)
        scored = score(model, scored, "random_forest", f"_part{i}")
        total = total + n * F.col(f"_part{i}")
    return scored.withColumn("prediction", total / trees).drop(*[f"_part{i}" for i in range(len(parts))])


def next_day_baseline(frame: DataFrame, features: Sequence[str], ratio: float = 0.7, trees: int = 200, kinds: Sequence[str] = ("linear", "random_forest"),
                      shape: Shape = DAILY) -> DataFrame:
    """Sign strategy of a linear model and a forest on next-row returns (column target), pooled over tickers."""
    from tickloom.operators.metrics import alpha_class

    narrow = clean_xy(frame.select("ticker", "ts", *features, "target"), [*features, "target"])
    split = stored(chrono_split(narrow, ratio, shape=shape), "split")
    train, test = split.filter("segment = 'train'"), split.filter("segment = 'test'")
    out = None
    for kind in kinds:
        if kind == "random_forest":
            scored = forest_scores(train, test, features, "target", trees)
        else:
            scored = score(fit(train, features, "target", kind, 1, trees), test, kind)
        scored = scored.select("ticker", F.lit(kind).alias("model"), "prediction", "target")
        out = scored if out is None else out.unionByName(scored)
    signal = F.signum("prediction")
    ret = signal * F.col("target")
    stats = out.groupBy("model", "ticker").agg(
        F.count(F.lit(1)).alias("rows_test"), F.avg(ret).alias("mean_daily_return"), F.stddev_pop(ret).alias("std_daily_return"),
        F.avg(F.when(F.signum("target") == signal, 1.0).otherwise(0.0)).alias("hit_rate"),
    )
    sharpe = F.col("mean_daily_return") / F.nullif("std_daily_return", F.lit(0.0)) * F.sqrt(F.lit(252.0))
    return stats.withColumn("sharpe", sharpe).withColumn("alpha_class", alpha_class(F.col("sharpe")))
