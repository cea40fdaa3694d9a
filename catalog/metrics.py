"""Evaluation metrics, fold summaries and back-test history metrics."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.labels import RELATIVE
from catalog.registry import query
from tickloom.functions.layout import DAILY, UNKNOWN, avg_rank, over_series, running
from tickloom.functions import rolling as R
from tickloom.functions.session import cut_lineage
from tickloom.operators import exchange as ex
from tickloom.operators import labels as lb
from tickloom.operators import metrics as mt
from tickloom.operators import rollups as ru


def predictions(t) -> DataFrame:
    """Two experiments' scores with target, a misaligned control target and the ten date windows."""
    panel = lb.relative_forward_return(ex.momentum(fx.bars(t), 3, 60), 3)
    panel = over_series(
        panel,
        lambda d, w: d.withColumn("control", F.lag("xs_rel_fwd_ret_3", 7).over(w)),
        before=7,
        shape=DAILY,
    ).filter("ret60 IS NOT NULL AND xs_rel_fwd_ret_3 IS NOT NULL AND control IS NOT NULL")
    # one row per calendar day
    panel = panel.join(F.broadcast(fx.windows_of_days(t)), "ts")
    experiments = F.array(
        F.struct(F.lit("E1").alias("id"), F.col("ret60").alias("score")),
        F.struct(F.lit("E2").alias("id"), F.col("ret3").alias("score")),
    )
    return panel.withColumn("_e", F.explode(experiments)).select(
        "ticker",
        "ts",
        "window_id",
        F.col("_e.id").alias("experiment_id"),
        (0.5 + F.col("_e.score")).alias("prediction"),
        F.col("xs_rel_fwd_ret_3").alias("target_value"),
        "control",
    )


PREDICTIONS = f"""{RELATIVE}, {fx.DAY_WINDOWS}, panel AS (
      SELECT *, close / lag(close, 60) OVER w - 1 AS ret60, close / lag(close, 3) OVER w - 1 AS ret3,
             lag(xs_rel_fwd_ret_3, 7) OVER w AS control
      FROM relative WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
    predictions AS (
      SELECT ticker, p.ts, window_id, e AS experiment_id, 0.5 + CASE WHEN e = 'E1' THEN ret60 ELSE ret3 END AS prediction,
             xs_rel_fwd_ret_3 AS target_value, control
      FROM panel p JOIN day_windows d ON p.ts = d.ts, (SELECT unnest(['E1', 'E2']) AS e)
      WHERE ret60 IS NOT NULL AND xs_rel_fwd_ret_3 IS NOT NULL AND control IS NOT NULL)"""


@query(
    "predictions_oos_frame",
    "ticker:s ts:d window_id:i experiment_id:s prediction:f target_value:f control:f",
    f"WITH {PREDICTIONS} SELECT * FROM predictions",
)
def _(t):
    return predictions(t)


@query(
    "e1_average_tie_rank",
    "ticker:s ts:d volume:f rank:f rank_pct:f",
    f"""WITH {fx.BARS} SELECT ticker, ts, volume,
        rank() OVER (PARTITION BY ts ORDER BY volume) + (count(*) OVER (PARTITION BY ts, volume) - 1) / 2 AS rank,
        (rank() OVER (PARTITION BY ts ORDER BY volume) + (count(*) OVER (PARTITION BY ts, volume) - 1) / 2)
          / count(*) OVER (PARTITION BY ts) AS rank_pct FROM bars""",
)
def _(t):
    bars = fx.bars(t).select("ticker", "ts", "volume")
    return avg_rank(avg_rank(bars, "volume", ["ts"], "rank"), "volume", ["ts"], "rank_pct", pct=True)


RANKED = f"""{PREDICTIONS}, ranked AS (
      SELECT *, rank() OVER (PARTITION BY experiment_id, window_id ORDER BY prediction)
             + (count(*) OVER (PARTITION BY experiment_id, window_id, prediction) - 1) / 2 AS rx,
             rank() OVER (PARTITION BY experiment_id, window_id ORDER BY target_value)
             + (count(*) OVER (PARTITION BY experiment_id, window_id, target_value) - 1) / 2 AS ry,
             count(*) OVER (PARTITION BY experiment_id, window_id) AS n FROM predictions)"""


@query(
    "e2_rank_correlation",
    "experiment_id:s window_id:i pairs:i ic_spearman:f",
    f"""WITH {RANKED} SELECT experiment_id, window_id, count(*) AS pairs, corr(rx, ry) AS ic_spearman FROM ranked GROUP BY 1, 2""",
)
def _(t):
    return mt.spearman(predictions(t), "prediction", "target_value", ["experiment_id", "window_id"])


@query(
    "e3_decile_spread",
    "experiment_id:s window_id:i trade_count:i top_decile:f bottom_decile:f spread:f",
    f"""WITH {RANKED} SELECT experiment_id, window_id, count(*) AS trade_count,
        avg(target_value) FILTER (n >= 20 AND rx / n >= 0.9) AS top_decile, avg(target_value) FILTER (n >= 20 AND rx / n <= 0.1) AS bottom_decile,
        avg(target_value) FILTER (n >= 20 AND rx / n >= 0.9) - avg(target_value) FILTER (n >= 20 AND rx / n <= 0.1) AS spread
        FROM ranked GROUP BY 1, 2""",
)
def _(t):
    return mt.decile_spread(predictions(t), "prediction", "target_value", ["experiment_id", "window_id"])


@query(
    "e4_roc_auc",
    "experiment_id:s window_id:i rows:i auc:f",
    f"""WITH {RANKED} SELECT experiment_id, window_id, count(*) AS rows,
        (sum(rx) FILTER (target_value > 0) - count(*) FILTER (target_value > 0) * (count(*) FILTER (target_value > 0) + 1) / 2)
        / CASE WHEN count(*) >= 10 THEN nullif(count(*) FILTER (target_value > 0) * count(*) FILTER (target_value <= 0), 0) END AS auc FROM ranked GROUP BY 1, 2""",
)
def _(t):
    return mt.roc_auc(predictions(t).withColumn("label", F.when(F.col("target_value") > 0, 1).otherwise(0)), "label", "prediction",
                      ["experiment_id", "window_id"])


@query(
    "e5_balanced_accuracy",
    "experiment_id:s window_id:i rows:i balanced_accuracy:f",
    f"""WITH {PREDICTIONS}, r AS (
        SELECT experiment_id, window_id, target_value > 0 AS label, count(*) AS n,
               avg(CASE WHEN (prediction >= 0.5) = (target_value > 0) THEN 1.0::DOUBLE ELSE 0 END) AS recall
        FROM predictions GROUP BY 1, 2, 3)
        SELECT experiment_id, window_id, sum(n) AS rows, CASE WHEN sum(n) >= 10 THEN avg(recall) END AS balanced_accuracy FROM r GROUP BY 1, 2""",
)
def _(t):
    labelled = predictions(t).withColumn("label", F.when(F.col("target_value") > 0, 1).otherwise(0))
    return mt.balanced_accuracy(labelled, "label", "prediction", ["experiment_id", "window_id"])


@query(
    "e6_accuracy",
    "experiment_id:s samples:i accuracy:f positive_rate:f",
    f"""WITH {PREDICTIONS} SELECT experiment_id, count(*) AS samples,
        avg(CASE WHEN (prediction >= 0.5) = (target_value > 0) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy,
        avg(CASE WHEN target_value > 0 THEN 1.0::DOUBLE ELSE 0 END) AS positive_rate FROM predictions GROUP BY 1""",
)
def _(t):
    labelled = predictions(t).withColumn("label", F.when(F.col("target_value") > 0, 1).otherwise(0))
    return mt.accuracy(labelled, "label", "prediction", ["experiment_id"])


def _fold_sql(name: str, target: str) -> str:
    return f"""{name}_ranked AS (
      SELECT *, {target} AS y, rank() OVER (PARTITION BY experiment_id, window_id ORDER BY prediction)
             + (count(*) OVER (PARTITION BY experiment_id, window_id, prediction) - 1) / 2 AS rx,
             rank() OVER (PARTITION BY experiment_id, window_id ORDER BY {target})
             + (count(*) OVER (PARTITION BY experiment_id, window_id, {target}) - 1) / 2 AS ry,
             count(*) OVER (PARTITION BY experiment_id, window_id) AS n FROM predictions),
    {name} AS (
      SELECT experiment_id, window_id, count(*) AS rows, corr(rx, ry) AS ic_spearman,
             (sum(rx) FILTER (y > 0) - count(*) FILTER (y > 0) * (count(*) FILTER (y > 0) + 1) / 2)
               / CASE WHEN count(*) >= 10 THEN nullif(count(*) FILTER (y > 0) * count(*) FILTER (y <= 0), 0) END AS auc,
             avg(y) FILTER (n >= 20 AND rx / n >= 0.9) AS top_decile, avg(y) FILTER (n >= 20 AND rx / n <= 0.1) AS bottom_decile,
             avg(y) FILTER (n >= 20 AND rx / n >= 0.9) - avg(y) FILTER (n >= 20 AND rx / n <= 0.1) AS spread,
             CASE WHEN count(*) >= 10 THEN (avg(CASE WHEN prediction >= 0.5 THEN 1.0::DOUBLE ELSE 0 END) FILTER (y > 0)
              + avg(CASE WHEN prediction < 0.5 THEN 1.0::DOUBLE ELSE 0 END) FILTER (y <= 0)) / 2 END AS balanced_accuracy
      FROM {name}_ranked GROUP BY 1, 2)"""


FOLDS = f"{PREDICTIONS}, {_fold_sql('real_folds', 'target_value')}, {_fold_sql('shuf_folds', 'control')}"


def folds(t, target: str) -> DataFrame:
    frame = predictions(t).withColumn("_y", F.col(target)).withColumn("label", F.when(F.col("_y") > 0, 1).otherwise(0))
    return mt.fold_metrics(frame, ["experiment_id", "window_id"], target="_y", ret="_y")


@query(
    "m9_fold_metrics",
    "experiment_id:s window_id:i rows:i ic_spearman:f auc:f top_decile:f bottom_decile:f spread:f balanced_accuracy:f",
    f"WITH {FOLDS} SELECT * FROM real_folds",
)
def _(t):
    return folds(t, "target_value")


def _summary_sql(name: str, source: str, prefix: str) -> str:
    metrics = ["ic_spearman", "auc", "top_decile", "bottom_decile", "spread", "balanced_accuracy"]
    means = ", ".join(
        f"sum({m} * greatest(rows, 1)) / sum(greatest(rows, 1)) FILTER ({m} IS NOT NULL) AS {prefix}_{m}" for m in metrics
    )
    return f"""{name} AS (
      SELECT experiment_id, count(*)::DOUBLE AS {prefix}_valid_fold_count, {means}
      FROM (SELECT *, median(rows) OVER (PARTITION BY experiment_id) AS mid FROM {source})
      WHERE rows >= greatest(50.0, 0.5 * mid) GROUP BY 1)"""


SUMMARIES = f"{FOLDS}, {_summary_sql('real_summary', 'real_folds', 'real')}, {_summary_sql('shuf_summary', 'shuf_folds', 'shuf')}"
FOLD_METRICS = ["ic_spearman", "auc", "top_decile", "bottom_decile", "spread", "balanced_accuracy"]


@query(
    "a7_weighted_fold_summary",
    "experiment_id:s real_valid_fold_count:f real_ic_spearman:f real_auc:f real_top_decile:f real_bottom_decile:f "
    "real_spread:f real_balanced_accuracy:f",
    f"WITH {SUMMARIES} SELECT * FROM real_summary",
)
def _(t):
    return ru.weighted_fold_summary(folds(t, "target_value"), FOLD_METRICS, "real")


GAPS = f"""{SUMMARIES}, gaps AS (
      SELECT *, real_ic_spearman - shuf_ic_spearman AS gap_ic_spearman, real_top_decile - shuf_top_decile AS gap_top_decile,
             real_spread - shuf_spread AS gap_spread, real_auc - shuf_auc AS gap_auc,
             real_balanced_accuracy - shuf_balanced_accuracy AS gap_balanced_accuracy
      FROM real_summary FULL JOIN shuf_summary USING (experiment_id))"""


def gaps(t) -> DataFrame:
    """Real and shuffled folds hold the same scores, which are ordered once for both."""
    keys, sides = ["experiment_id", "window_id"], {"real_": "target_value", "shuf_": "control"}
    frame = predictions(t).withColumns({f"{side}label": F.when(F.col(y) > 0, 1).otherwise(0) for side, y in sides.items()})
    # one row per fold, read by both summaries
    both = cut_lineage(mt.fold_metrics_of(frame, keys, {side: (f"{side}label", y, y) for side, y in sides.items()}))
    real, shuf = (both.select(*keys, *[F.col(f"{side}{c}").alias(c) for c in ("rows", *FOLD_METRICS)]) for side in sides)
    return mt.real_vs_shuffled(ru.weighted_fold_summary(real, FOLD_METRICS, "real"), ru.weighted_fold_summary(shuf, FOLD_METRICS, "shuf"))


@query(
    "e7_real_vs_shuffled",
    "experiment_id:s gap_ic_spearman:f gap_top_decile:f gap_spread:f gap_auc:f gap_balanced_accuracy:f shuf_auc:f",
    f"WITH {GAPS} SELECT * FROM gaps",
)
def _(t):
    return gaps(t)


@query(
    "e8_promotion_rule",
    "experiment_id:s promoted:b",
    f"""WITH {GAPS} SELECT experiment_id, coalesce(real_top_decile > 0, true) AND coalesce(gap_top_decile > 0, true)
        AND coalesce(real_spread > 0, true) AND coalesce(gap_ic_spearman > 0, true) AND coalesce(real_auc > 0.5, true)
        AND coalesce(gap_auc > 0, true) AND coalesce(real_balanced_accuracy > 0.5, true)
        AND coalesce(gap_balanced_accuracy > 0, true) AS promoted FROM gaps""",
)
def _(t):
    return mt.promoted(gaps(t))


BUCKETS = f"""{PREDICTIONS}, decile AS (
      SELECT experiment_id, target_value, least(ceil((rank() OVER (PARTITION BY experiment_id ORDER BY prediction)
             + (count(*) OVER (PARTITION BY experiment_id, prediction) - 1) / 2) * 10
             / count(*) OVER (PARTITION BY experiment_id)), 10) AS bucket FROM predictions),
    buckets AS (SELECT experiment_id, bucket, count(*) AS rows, avg(target_value) AS mean_return FROM decile GROUP BY 1, 2)"""


@query("e9_score_buckets", "experiment_id:s bucket:i rows:i mean_return:f", f"WITH {BUCKETS} SELECT * FROM buckets")
def _(t):
    return mt.score_buckets(predictions(t), "prediction", "target_value", ["experiment_id"])


@query(
    "e9_bucket_quality",
    "experiment_id:s row_count:i top_return:f bottom_return:f spread:f ic_spearman:f",
    f"""WITH {BUCKETS}, r AS (SELECT *, rank() OVER (PARTITION BY experiment_id ORDER BY mean_return) AS rr FROM buckets)
        SELECT experiment_id, sum(rows) AS row_count, arg_max(mean_return, bucket) AS top_return,
               arg_min(mean_return, bucket) AS bottom_return,
               arg_max(mean_return, bucket) - arg_min(mean_return, bucket) AS spread, corr(bucket, rr) AS ic_spearman
        FROM r GROUP BY 1""",
)
def _(t):
    return mt.bucket_quality(mt.score_buckets(predictions(t), "prediction", "target_value", ["experiment_id"]), ["experiment_id"])


@query(
    "e10_rank_history",
    "experiment_id:s ts:d ticker:s rank_pct:f rank_order:i",
    f"""WITH {PREDICTIONS} SELECT experiment_id, ts, ticker,
        (rank() OVER (PARTITION BY experiment_id, ts ORDER BY prediction)
         + (count(*) OVER (PARTITION BY experiment_id, ts, prediction) - 1) / 2) / count(*) OVER (PARTITION BY experiment_id, ts) AS rank_pct,
        row_number() OVER (PARTITION BY experiment_id, ts ORDER BY prediction DESC, ticker) AS rank_order FROM predictions""",
)
def _(t):
    # tickers per date cannot exceed the supplier table, whose size is checked here
    return mt.rank_history(predictions(t), shape=UNKNOWN)


def history(t) -> DataFrame:
    """A back-test history: follow yesterday's move, net worth compounding from one."""

    def step(d, w):
        ret = F.coalesce(R.change(F.col("close"), w, 1), F.lit(0.0))
        return d.select("*", F.signum(ret).alias("action"), ret.alias("ret"))

    def reward(d, w):
        return d.withColumn("reward", F.coalesce(F.lag("action").over(w), F.lit(0.0)) * F.col("ret"))

    moved = over_series(fx.bars(t).select("ticker", "ts", "close"), step, before=1, shape=DAILY)
    earned = over_series(moved, reward, before=1, shape=DAILY)
    grown = running(earned, ["ticker"], ["ts"], {"net_worth": ("product", 1.0 + F.col("reward"))}, DAILY)
    # one row per calendar day
    windowed = grown.join(F.broadcast(fx.windows_of_days(t)), "ts")
    style = F.when(F.col("window_id") % 3 == 0, "swing").when(F.col("window_id") % 3 == 1, "scalp")
    return windowed.withColumn("style", style)


HISTORY = f"""{fx.BARS}, {fx.DAY_WINDOWS}, h1 AS (
      SELECT ticker, ts, close, coalesce(close / lag(close) OVER w - 1, 0) AS ret FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
    h2 AS (SELECT *, sign(ret)::DOUBLE AS action, coalesce(lag(sign(ret)) OVER (PARTITION BY ticker ORDER BY ts), 0) * ret AS reward FROM h1),
    history AS (
      SELECT h2.*, product(1 + reward) OVER (PARTITION BY ticker ORDER BY h2.ts ROWS UNBOUNDED PRECEDING) AS net_worth, window_id,
             CASE window_id % 3 WHEN 0 THEN 'swing' WHEN 1 THEN 'scalp' END AS style
      FROM h2 JOIN day_windows d ON h2.ts = d.ts)"""

PEAK = "max(net_worth) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING)"


@query(
    "e11_max_drawdown",
    "ticker:s max_drawdown:f",
    f"WITH {HISTORY} SELECT ticker, min(d) AS max_drawdown FROM (SELECT ticker, net_worth / {PEAK} - 1 AS d FROM history) GROUP BY 1",
)
def _(t):
    return mt.drawdown_relative(history(t), "net_worth", ["ticker"], ["ts"])


EQUITY13 = f"""{HISTORY}, equity AS (
      SELECT *, max(eq) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak
      FROM (SELECT *, sum(0.01 + reward) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING) AS eq FROM history))"""
EQUITY = f"""{HISTORY}, equity AS (
      SELECT *, max(eq) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak
      FROM (SELECT *, sum(reward) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING) AS eq FROM history))"""


@query(
    "e12_drawdown_points",
    "ticker:s max_drawdown_points:f",
    f"WITH {EQUITY} SELECT ticker, min(eq - peak) AS max_drawdown_points FROM equity GROUP BY 1",
)
def _(t):
    return mt.drawdown_points(history(t), "reward", ["ticker"], ["ts"])


@query(
    "e13_reward_drawdown",
    "ticker:s reward_drawdown:f3",
    f"WITH {EQUITY13} SELECT ticker, -min((eq - peak) / greatest(peak, 1e-9)) AS reward_drawdown FROM equity GROUP BY 1",
)
def _(t):
    # a constant carry keeps the first peak above the floor of 1e-9
    return mt.drawdown_reward(history(t).withColumn("r", 0.01 + F.col("reward")), "r", ["ticker"], ["ts"])


@query(
    "e14_e18_return_statistics",
    "ticker:s sharpe:f sortino:f sharpe_penalised:f sortino_penalised:f expectancy:f",
    f"""WITH {HISTORY} SELECT ticker,
        CASE WHEN stddev_samp(reward) >= 1e-12 THEN avg(reward) / stddev_samp(reward) * sqrt(252) ELSE 0 END AS sharpe,
        CASE WHEN stddev_samp(reward) FILTER (reward < 0) >= 1e-12 THEN avg(reward) / stddev_samp(reward) FILTER (reward < 0) * sqrt(252) ELSE 0 END AS sortino,
        CASE WHEN stddev_pop(reward) < 1e-6 THEN -10 ELSE least(avg(reward) / (stddev_pop(reward) + 1e-8), 10) END AS sharpe_penalised,
        CASE WHEN coalesce(stddev_pop(reward) FILTER (reward < 0), 0) < 1e-6 THEN -10
             ELSE least(avg(reward) / (stddev_pop(reward) FILTER (reward < 0) + 1e-8), 10) END AS sortino_penalised,
        count(*) FILTER (reward > 0) / count(*) * coalesce(avg(reward) FILTER (reward > 0), 0)
        - count(*) FILTER (reward < 0) / count(*) * coalesce(avg(abs(reward)) FILTER (reward < 0), 0) AS expectancy
        FROM history GROUP BY 1""",
)
def _(t):
    r = F.col("reward")
    return history(t).groupBy("ticker").agg(
        mt.sharpe(r, 252.0).alias("sharpe"),
        mt.sortino(r, 252.0).alias("sortino"),
        mt.penalised_sharpe(r).alias("sharpe_penalised"),
        mt.penalised_sortino(r).alias("sortino_penalised"),
        mt.expectancy(r).alias("expectancy"),
    )


@query(
    "e17_annualised_return",
    "ticker:s sessions:i total:f annual:f",
    f"""WITH {HISTORY} SELECT ticker, count(*) AS sessions, product(1 + reward) - 1 AS total,
        CASE WHEN product(1 + reward) - 1 > -0.999999 THEN pow(product(1 + reward), 250.0 / count(*)) - 1 END AS annual
        FROM history GROUP BY 1""",
)
def _(t):
    out = history(t).groupBy("ticker").agg(F.count(F.lit(1)).alias("sessions"), ru.compound(F.col("reward")).alias("total"))
    return out.withColumn("annual", ru.annualise(F.col("total"), F.col("sessions")))


@query(
    "a14_compounded_return",
    "ticker:s window_id:i total:f",
    f"WITH {HISTORY} SELECT ticker, window_id, product(1 + reward) - 1 AS total FROM history GROUP BY 1, 2",
)
def _(t):
    return history(t).groupBy("ticker", "window_id").agg(ru.compound(F.col("reward")).alias("total"))


METRICS_SQL = f"""{HISTORY}, stepped AS (
      SELECT *, coalesce(net_worth / lag(net_worth) OVER w - 1, 0) AS r,
             net_worth / max(net_worth) OVER (PARTITION BY ticker, window_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd
      FROM history WINDOW w AS (PARTITION BY ticker, window_id ORDER BY ts)),
    runs AS (
      SELECT *, CASE WHEN bars >= 2 THEN final_net_worth / first_nw - 1 ELSE 0 END AS total_return,
             CASE WHEN bars <= 1 THEN 0 WHEN final_net_worth / first_nw >= 0 THEN pow(final_net_worth / first_nw, 252.0 / bars) - 1 END AS annualized_return
      FROM (SELECT ticker, window_id, arg_min(net_worth, ts) AS first_nw, arg_max(net_worth, ts) AS final_net_worth, count(*) AS bars,
          CASE WHEN stddev_samp(r) >= 1e-12 THEN avg(r) / stddev_samp(r) * sqrt(252) ELSE 0 END AS sharpe,
          CASE WHEN stddev_samp(r) FILTER (r < 0) >= 1e-12 THEN avg(r) / stddev_samp(r) FILTER (r < 0) * sqrt(252) ELSE 0 END AS sortino,
          min(dd) AS max_drawdown, count(*) FILTER (action <> 0) AS trade_count,
          avg(CASE WHEN action = 0 THEN 1.0::DOUBLE ELSE 0 END) AS hold_ratio, avg(abs(action)) AS avg_abs_action
          FROM stepped GROUP BY 1, 2))"""


@query(
    "e19_history_metrics",
    "ticker:s window_id:i total_return:f annualized_return:f5 sharpe:f sortino:f max_drawdown:f trade_count:i hold_ratio:f "
    "avg_abs_action:f final_net_worth:f bars:i",
    f"WITH {METRICS_SQL} SELECT * FROM runs",
)
def _(t):
    return mt.history_metrics(history(t), "day", ["ticker", "window_id"])


@query(
    "a8_variant_rollup",
    "model_name:s data_variant:s friction_variant:s mean_total_return:f median_total_return:f mean_annualized_return:f3 "
    "mean_sharpe:f mean_sortino:f mean_max_drawdown:f mean_trade_count:f mean_hold_ratio:f mean_final_net_worth:f windows:i rows:i",
    f"""WITH {METRICS_SQL} SELECT CASE WHEN window_id % 2 = 0 THEN 'RL' ELSE 'SMA' END AS model_name, 'real' AS data_variant,
        'cost_on' AS friction_variant, avg(total_return) AS mean_total_return, median(total_return) AS median_total_return,
        avg(annualized_return) AS mean_annualized_return, avg(sharpe) AS mean_sharpe, avg(sortino) AS mean_sortino,
        avg(max_drawdown) AS mean_max_drawdown, avg(trade_count) AS mean_trade_count, avg(hold_ratio) AS mean_hold_ratio,
        avg(final_net_worth) AS mean_final_net_worth, count(DISTINCT window_id) AS windows, count(ticker) AS rows
        FROM runs GROUP BY 1, 2, 3""",
)
def _(t):
    runs = mt.history_metrics(history(t), "day", ["ticker", "window_id"]).select(
        "*",
        F.when(F.col("window_id") % 2 == 0, "RL").otherwise("SMA").alias("model_name"),
        F.lit("real").alias("data_variant"),
        F.lit("cost_on").alias("friction_variant"),
    )
    return ru.variant_rollup(runs)


STYLES = f"""{HISTORY}, styles AS (
      SELECT ticker, coalesce(style, 'unknown') AS style, count(*) AS bars, count(*) FILTER (action <> 0) AS trade_rows,
             count(*) FILTER (action <> 0) / count(*) AS trade_ratio, avg(reward) AS mean_reward,
             arg_min(net_worth, ts) AS start_net_worth, arg_max(net_worth, ts) AS end_net_worth,
             arg_max(net_worth, ts) - arg_min(net_worth, ts) AS net_change
      FROM history GROUP BY 1, 2)"""


@query(
    "e20_style_mix",
    "ticker:s style:s bars:i trade_rows:i trade_ratio:f mean_reward:f start_net_worth:f end_net_worth:f net_change:f",
    f"WITH {STYLES} SELECT * FROM styles",
)
def _(t):
    return mt.style_mix(history(t))


@query(
    "a9_style_rollup",
    "style:s windows:i rows:i total_bars:i total_trade_rows:i mean_trade_ratio:f mean_reward:f mean_net_change:f",
    f"""WITH {STYLES} SELECT style, 1 AS windows, count(*) AS rows, sum(bars) AS total_bars, sum(trade_rows) AS total_trade_rows,
        avg(trade_ratio) AS mean_trade_ratio, avg(mean_reward) AS mean_reward, avg(net_change) AS mean_net_change
        FROM styles GROUP BY 1""",
)
def _(t):
    return ru.style_rollup(mt.style_mix(history(t)).withColumn("window_id", F.lit(1)), ["style"])


DIRECTIONAL = f"""{HISTORY}, trades AS (
      SELECT ticker, action AS dir, lead(close, 1) OVER w / close - 1 AS r1, lead(close, 3) OVER w / close - 1 AS r3
      FROM history WHERE action <> 0 WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
    stacked AS (SELECT ticker, dir, 1 AS horizon, r1 AS r FROM trades UNION ALL SELECT ticker, dir, 3, r3 FROM trades),
    directional AS (
      SELECT ticker, horizon, count(*) AS sample_count, avg(CASE WHEN dir = sign(r) THEN 1.0::DOUBLE ELSE 0 END) AS directional_accuracy,
             avg(r) AS avg_future_return, coalesce(avg(r) FILTER (dir > 0), 0) AS avg_long_future_return,
             coalesce(avg(r) FILTER (dir < 0), 0) AS avg_short_future_return,
             coalesce(avg(r) FILTER (dir = sign(r)), 0) AS avg_future_return_correct,
             coalesce(avg(r) FILTER (dir <> sign(r)), 0) AS avg_future_return_wrong, avg(dir * r) AS net_expectancy
      FROM stacked WHERE r IS NOT NULL GROUP BY 1, 2)"""


@query(
    "e21_directional_diagnostic",
    "ticker:s horizon:i sample_count:i directional_accuracy:f avg_future_return:f avg_long_future_return:f "
    "avg_short_future_return:f avg_future_return_correct:f avg_future_return_wrong:f net_expectancy:f",
    f"WITH {DIRECTIONAL} SELECT * FROM directional",
)
def _(t):
    return mt.directional(history(t))


@query(
    "a10_directional_rollup",
    "horizon:i windows:i rows:i total_samples:i mean_directional_accuracy:f mean_avg_future_return:f mean_net_expectancy:f",
    f"""WITH {DIRECTIONAL} SELECT horizon, 1 AS windows, count(*) AS rows, sum(sample_count) AS total_samples,
        avg(directional_accuracy) AS mean_directional_accuracy, avg(avg_future_return) AS mean_avg_future_return,
        avg(net_expectancy) AS mean_net_expectancy FROM directional GROUP BY 1""",
)
def _(t):
    return ru.directional_rollup(mt.directional(history(t)).withColumn("window_id", F.lit(1)), ["horizon"])


@query(
    "e22_alpha_class",
    "ticker:s sharpe:f hit_rate:f alpha_class:s",
    f"""WITH {HISTORY}, s AS (SELECT ticker, avg(reward) / nullif(stddev_pop(reward), 0) * sqrt(252) AS sharpe,
        avg(CASE WHEN sign(reward) = sign(ret) THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate FROM history GROUP BY 1)
        SELECT *, CASE WHEN sharpe IS NULL THEN 'invalid' WHEN sharpe < 0.2 THEN 'no_alpha_likely' WHEN sharpe < 0.6 THEN 'weak_alpha'
        WHEN sharpe < 1.0 THEN 'moderate_alpha' ELSE 'strong_alpha' END AS alpha_class FROM s""",
)
def _(t):
    r = F.col("reward")
    out = history(t).groupBy("ticker").agg(
        (F.avg(r) / F.nullif(F.stddev_pop(r), F.lit(0.0)) * F.sqrt(F.lit(252.0))).alias("sharpe"),
        F.avg(F.when(F.signum(r) == F.signum("ret"), 1.0).otherwise(0.0)).alias("hit_rate"),
    )
    return out.withColumn("alpha_class", mt.alpha_class(F.col("sharpe")))
