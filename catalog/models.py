"""Models and gates. Fits have no SQL twin; frames, gates and linear fits on one feature do."""

import functools

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.labels import RESEARCH
from catalog.registry import query
from tickloom.functions.session import cut_lineage, stored
from tickloom.operators import labels as lb
from tickloom.operators.research import research_columns
from tickloom.plans import experiments as ep
from tickloom.plans import per_ticker as pt

FEATURES = ["lag_ret_1", "trend_30", "trend_2h", "stock_minus_mkt_3", "atr20_log", "sign_persistence_5"]


def panel(t, experiments=None, features=None, shuffled: bool = False, joined: int = 1, horizon: int = 3):
    """Labelled research panel with windows, written once: every fit reads it again. Only columns that ``experiments`` read, if given.

    ``joined`` of the ten windows make one. A window's rows lie together in the files. Labels are shuffled here, where a ticker's rows are in one task already.
    """
    labelled = lb.all_targets(research_columns(fx.series_bars(t)), horizon)
    # one row per calendar day
    whole = labelled.join(F.broadcast(fx.windows_of_days(t)), "ts")
    if experiments is not None:
        whole = whole.select(*ep.columns_read(whole, experiments, features))
    if joined > 1:
        whole = whole.withColumn("window_id", F.ceil(F.col("window_id") / joined))
    for experiment in experiments or () if shuffled else ():
        whole = ep.with_shuffled(whole, experiment)
    return stored(whole.sortWithinPartitions("window_id"), "panel")


def halves(t, experiments, features=None):
    """The panel with two windows instead of ten: the first half of time is fitted, the second scored."""
    return panel(t, experiments, features, joined=5)


def predicted(t, frame, experiment, features, pairs):
    return ep.predict_oos(frame(t, [experiment], features), experiment, features, pairs, kept=True)


PREDICTION = "ticker:s ts:d window_id:i experiment_id:s train_window_id:i prediction:f target_value:f realized_return:f shuffled:b"
PAIRS = [(k, k + 1) for k in range(1, 10)]


@query("m1_m10_elastic_net_predictions", PREDICTION)
def _(t):
    return predicted(t, panel, lb.Experiment("EN", "T6", 3, "regression", (), "elasticnet"), FEATURES, PAIRS)


# complete rows of windows 2 to 10, each scored by the window before: at least 50 rows train and 20 are scored
def fold_rows(features):
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [*features, "y"])
    return f"""{RESEARCH}, {fx.DAY_WINDOWS}, ahead AS (SELECT *, lead(close, 3) OVER (PARTITION BY ticker ORDER BY ts) / close - 1 AS fwd FROM research),
        labelled AS (SELECT *, fwd - avg(fwd) OVER (PARTITION BY ts) AS y FROM ahead),
        complete AS (SELECT * FROM labelled JOIN day_windows USING (ts) WHERE {complete}),
        sizes AS (SELECT window_id, count(*) AS n FROM complete GROUP BY 1),
        fold AS (SELECT c.*, a.window_id AS train_window_id FROM complete c JOIN sizes a ON a.window_id = c.window_id - 1 AND a.n >= 50
                 JOIN sizes b ON b.window_id = c.window_id AND b.n >= 20)"""


@query(
    "m10_prediction_rows",
    "ticker:s ts:d window_id:i train_window_id:i target_value:f realized_return:f",
    f"WITH {fold_rows(FEATURES)} SELECT ticker, ts, window_id, train_window_id, y AS target_value, y AS realized_return FROM fold",
)
def _(t):
    """Whatever the fits are: every complete row of a fold that is large enough is scored once."""
    return predicted(t, panel, lb.Experiment("EN", "T6", 3, "regression", (), "elasticnet"), FEATURES, PAIRS)


@query(
    "m1_elastic_net_one_feature",
    "ticker:s ts:d window_id:i train_window_id:i prediction:f5",
    f"""WITH {fold_rows(["lag_ret_1"])}, m AS (
          SELECT window_id, avg(y) AS my, avg(lag_ret_1) AS mx, stddev_pop(lag_ret_1) AS sx, covar_pop(lag_ret_1, y) / stddev_pop(lag_ret_1) AS c FROM complete GROUP BY 1)
        SELECT ticker, ts, fold.window_id, train_window_id,
               my + sign(c) * greatest(abs(c) - 0.0005, 0) / 1.0005 * (lag_ret_1 - mx) / sx AS prediction FROM fold JOIN m ON m.window_id = train_window_id""",
)
def _(t):
    """With one feature the net is a line whose slope is moved towards zero."""
    return predicted(t, panel, lb.Experiment("EN", "T6", 3, "regression", (), "elasticnet"), ["lag_ret_1"], PAIRS)


@query("m2_m9_logistic_experiment", "experiment_id:s window_id:i rows:i auc:f balanced_accuracy:f spread:f shuffled:b")
def _(t):
    experiment = lb.Experiment("LG", "T3", 3, "binary", (), "logistic")
    frame = panel(t, [experiment], FEATURES, shuffled=True)
    real = ep.run_experiment(frame, experiment, FEATURES, PAIRS, kept=True)
    return real.unionByName(ep.run_experiment(frame, experiment, FEATURES, PAIRS, shuffled=True, kept=True))


@query("m9_regime_experiment", "experiment_id:s train_window_id:i window_id:i rows:i filter_applied:b target_id:s model_class:s label_type:s "
       "feature_families:s ic_spearman:f spread:f auc:f balanced_accuracy:f trade_count:i")
def _(t):
    """One regression, binary and multiclass experiment, each with its families and a regime: the first half of time against the rest."""
    regime = "Trend_30 > 0 and StockMinusMkt_3 > -1e-1"
    families = ("F1_TrendMomentum", "F2_VolRisk", "F3_Relative")
    kinds = [("RG", "T1", "regression", "elasticnet"), ("BN", "T4", "binary", "logistic"), ("MC", "T1", "multiclass", "logistic")]
    experiments = [lb.Experiment(n, target, 3, kind, families, model, regime) for n, target, kind, model in kinds]
    frame = halves(t, experiments)
    runs = [ep.run_experiment(frame, experiment, None, [(1, 2)], kept=True) for experiment in experiments]
    return functools.reduce(lambda a, b: a.unionByName(b), [r for r in runs if r is not None])


@query("m3_boosted_regressor", PREDICTION)
def _(t):
    return predicted(t, halves, lb.Experiment("GR", "T1", 3, "regression", (), "gbt_reg"), FEATURES, [(1, 2)])


@query("m4_boosted_classifier", PREDICTION)
def _(t):
    """A binary label that asks for the regressor gets the classifier."""
    return predicted(t, halves, lb.Experiment("GC", "T4", 3, "binary", (), "gbt_reg"), FEATURES, [(1, 2)])


@query("m5_next_day_baseline", "model:s ticker:s rows_test:i mean_daily_return:f hit_rate:f sharpe:f alpha_class:s")
def _(t):
    frame = stored(lb.next_row_return(research_columns(fx.bars(t))).select("ticker", "ts", *FEATURES, "target"), "frame")
    return ep.next_day_baseline(frame, FEATURES)


@query(
    "m5_linear_one_feature",
    "ticker:s ts:d prediction:f5",
    f"""WITH {RESEARCH}, n AS (SELECT ticker, ts, lag_ret_1, lead(close) OVER (PARTITION BY ticker ORDER BY ts) / close - 1 AS target FROM research),
        c AS (SELECT *, row_number() OVER (ORDER BY ts, ticker) AS i, count(*) OVER () AS n FROM n WHERE lag_ret_1 IS NOT NULL AND target IS NOT NULL),
        f AS (SELECT regr_slope(target, lag_ret_1) AS b, regr_intercept(target, lag_ret_1) AS a FROM c WHERE i <= floor(n * 0.7))
        SELECT ticker, ts, a + b * lag_ret_1 AS prediction FROM c, f WHERE i > floor(n * 0.7)""",
)
def _(t):
    from tickloom.operators.cleaning import clean_xy
    from tickloom.operators.splits import chrono_split

    frame = cut_lineage(lb.next_row_return(research_columns(fx.bars(t)).select("ticker", "ts", "close", "lag_ret_1")))
    split = chrono_split(clean_xy(frame, ["lag_ret_1", "target"]), 0.7)
    model = ep.fit(split.filter("segment = 'train'"), ["lag_ret_1"], "target", "linear", 1)
    return ep.score(model, split.filter("segment = 'test'"), "linear")


# the first 70 % of each ticker's own rows are fitted, the rest scored; tickers with fewer than 200 rows are left out
TICKER_LINES = f"""{RESEARCH}, n AS (SELECT ticker, ts, lag_ret_1, lead(close) OVER (PARTITION BY ticker ORDER BY ts) / close - 1 AS target FROM research),
    c AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS i, count(*) OVER (PARTITION BY ticker) AS n FROM n WHERE lag_ret_1 IS NOT NULL AND target IS NOT NULL),
    f AS (SELECT ticker, regr_slope(target, lag_ret_1) AS b, regr_intercept(target, lag_ret_1) AS a, count(*) AS rows_train FROM c WHERE n >= 200 AND i <= floor(n * 0.7) GROUP BY 1),
    p AS (SELECT ticker, ts, n AS rows_total, rows_train, a + b * lag_ret_1 AS prediction, target FROM c JOIN f USING (ticker) WHERE i > floor(n * 0.7))"""


def ticker_lines(t, features):
    frame = lb.next_row_return(research_columns(fx.bars(t)).select("ticker", "ts", "close", *features))
    return pt.next_day_lines(frame, features)


@query("m5_ticker_lines", "ticker:s ts:d rows_total:i rows_train:i prediction:f", f"WITH {TICKER_LINES} SELECT * FROM p")
def _(t):
    return ticker_lines(t, ["lag_ret_1"])


@query(
    "m5_ticker_roll_up",
    "model:s tickers:i mean_sharpe:f mean_hit_rate:f median_sharpe:f",
    f"""WITH {TICKER_LINES}, s AS (
          SELECT ticker, avg(sign(prediction) * target) / nullif(stddev_pop(sign(prediction) * target), 0) * sqrt(252) AS sharpe,
                 avg(CASE WHEN sign(target) = sign(prediction) THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate FROM p GROUP BY 1)
        SELECT 'linear' AS model, count(*) AS tickers, avg(sharpe) AS mean_sharpe, avg(hit_rate) AS mean_hit_rate, quantile_cont(sharpe, 0.5) AS median_sharpe FROM s""",
)
def _(t):
    return pt.strategy_roll_up(pt.sign_strategy(ticker_lines(t, ["lag_ret_1"])).withColumn("model", F.lit("linear")))


@query("m5_ticker_strategies", "ticker:s rows_total:i rows_train:i rows_test:i mean_daily_return:f hit_rate:f sharpe:f alpha_class:s")
def _(t):
    return pt.sign_strategy(ticker_lines(t, FEATURES))


FRAME = f"""{RESEARCH}, lab AS (SELECT *, lead(close, 5) OVER (PARTITION BY ticker ORDER BY ts) / close - 1 AS future_return FROM research),
    big AS (SELECT *, CASE WHEN future_return > 0 THEN 1 ELSE 0 END AS label_up FROM lab WHERE abs(future_return) >= 0.005),
    frame AS (SELECT * FROM (SELECT * FROM big QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) <= 300)
              WHERE lag_ret_1 IS NOT NULL AND trend_30 IS NOT NULL AND trend_2h IS NOT NULL AND stock_minus_mkt_3 IS NOT NULL AND atr20_log IS NOT NULL AND sign_persistence_5 IS NOT NULL)"""


@query(
    "m12_training_frame",
    "ticker:s ts:d trend_30:f future_return:f label_up:i",
    f"WITH {FRAME} SELECT * FROM frame",
)
def _(t):
    return ep.training_frame(research_columns(fx.bars(t)), FEATURES, 5, 0.005, 300)


def gate_frame(base):
    """The gate's labelled rows, written once: the bars behind them are not, as writing those is more than making them again."""
    return stored(ep.training_frame(base, FEATURES, 5, 0.005, 300), "frame")


@query("m6_m7_signal_gate", "ticker:s ts:d gate_prob_up:f gate_allow_long:i gate_allow_short:i gate_decision:s")
def _(t):
    base = research_columns(fx.series_bars(t))
    model, _ = ep.fit_gate(gate_frame(base), FEATURES)
    return ep.attach_gate(base, model, FEATURES, 0.52, 0.52)


@query("m6_signal_gate_metrics", "samples_train:i samples:i positive_rate_train:f positive_rate:f accuracy:f auc:f")
def _(t):
    return ep.fit_gate(gate_frame(research_columns(fx.series_bars(t))), FEATURES)[1]


@query(
    "m7_m8_gate_rules",
    "event_id:i decision:s gated:i",
    """WITH p AS (SELECT event_id, event_id % 4 AS a, 1 / (1 + exp(-(value - 50) / 100)) AS p FROM events)
       SELECT event_id, CASE WHEN p >= 0.55 THEN 'allow_long' WHEN 1 - p >= 0.55 THEN 'allow_short' ELSE 'gate_hold' END AS decision,
              CASE WHEN a = 1 AND p < 0.55 THEN 0 WHEN a = 2 AND 1 - p < 0.55 THEN 0 ELSE a END AS gated FROM p""",
)
def _(t):
    prob = 1.0 / (1.0 + F.exp(-(F.col("value") - 50) / 100))
    frame = t.events.select("event_id", (F.col("event_id") % 4).alias("a"), prob.alias("p"))
    return frame.select("event_id", ep.gate_decision(F.col("p")).alias("decision"), ep.gated_action(F.col("a"), F.col("p")).alias("gated"))


@query("m11_logistic_coefficients", "feature:s coefficient:f rank:i")
def _(t):
    frame = cut_lineage(ep.training_frame(research_columns(fx.bars(t)), FEATURES, 5, 0.005, 300))
    model = ep.fit(frame, FEATURES, "label_up", "logistic", frame.count())
    return ep.coefficients(model, FEATURES, t.spark)


@query("m11_leave_one_out", "ticker:s samples:i accuracy:f positive_rate:f auc:f")
def _(t):
    """Every ticker is scored by a model that has not seen it: ten fits leave out a tenth of the tickers each."""
    frame = cut_lineage(ep.training_frame(research_columns(fx.bars(t)), FEATURES, 5, 0.005, 300))
    return ep.leave_one_out(frame, FEATURES, folds=10)


@query(
    "m11_held_out_rows",
    "ticker:s samples:i positive_rate:f",
    f"WITH {FRAME} SELECT ticker, count(*) AS samples, avg(CAST(label_up AS DOUBLE)) AS positive_rate FROM frame GROUP BY 1",
)
def _(t):
    """Whatever the fits are: each labelled row of each ticker is scored once."""
    frame = cut_lineage(ep.training_frame(research_columns(fx.bars(t)), FEATURES, 5, 0.005, 300))
    return ep.leave_one_out(frame, FEATURES, folds=2).select("ticker", "samples", "positive_rate")


@query("m11_leave_one_ticker_out", "ticker:s samples:i accuracy:f positive_rate:f auc:f")
def _(t):
    """Every ticker is scored by a model fitted on all the others, with all their labelled rows."""
    return pt.leave_one_out_report(ep.training_frame(research_columns(fx.series_bars(t)), FEATURES, 5, 0.005), FEATURES)
