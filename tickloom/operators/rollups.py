"""Aggregations over folds, variants, styles and archives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.layout import UNKNOWN, Shape, value_ranks
from tickloom.functions.session import stored


def group_count(df: DataFrame, keys: Sequence[str] = ("ticker", "window_id")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def compound(ret: Column) -> Column:
    """Product of (1 + r) minus one; null for no rows."""
    return F.product(1.0 + ret) - 1.0


def annualise(total: Column, sessions: Column, per_year: float = 250.0) -> Column:
    """Annual rate of a total return; null at total loss."""
    return F.when(
        total > -0.999999, F.pow(1.0 + total, F.lit(per_year) / F.greatest(F.lit(1.0), sessions.cast("double"))) - 1.0
    )


def exact_quantiles(
    df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = (), shape: Shape = UNKNOWN
) -> DataFrame:
    """Exact linearly interpolated quantiles from cumulative counts of distinct values: ``q0``, ``q1``, ...

    The built-in exact percentile keeps all distinct values of a group in one task; this form does not.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("cnt"))
    keys = list(by)
    if not keys:
        counts, keys = counts.withColumn("_q", F.lit(0)), ["_q"]
    ranked = value_ranks(counts, value, keys, "cnt", shape)

    def at(index: Column) -> Column:
        here = (F.col("below") <= index) & (index < F.col("below") + F.col("cnt"))
        return F.max(F.when(here, F.col(value)))

    picks, outs = [], []
    for i, q in enumerate(qs):
        place = F.lit(float(q)) * (F.col("n") - 1)
        picks += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}"), F.max(place - F.floor(place)).alias(f"_w{i}")]
        outs.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(f"q{i}"))
    return ranked.groupBy(*keys).agg(*picks).select(*[k for k in keys if k != "_q"], *outs)


def label_sanity(df: DataFrame, horizon: int) -> DataFrame:
    """Mean and median of the return labels, mean of the outcome labels, one row per column."""
    h = horizon
    # fixed values: which label columns are checked
    both = ["raw_fwd_ret", "net_fwd_ret", "alpha_fwd", "net_alpha_fwd", "opp_score", "event_path_payoff", "clean_event_path_payoff"]
    both = [f"{c}_{h}" for c in both] + [f"est_cost_{h}"]
    means = ["y_t7_target_before_stop", "y_t8_clean_target_before_stop", "time_to_target", "time_to_stop", "mae_before_resolution"]
    means = [f"{c}_{h}" for c in means]
    names = [c for c in both + means if c in df.columns]
    # read twice more: means and brackets first, the rows of the brackets then
    values = stored(df.select(*[F.col(c).cast("double").alias(c) for c in names]), "labels")
    means = values.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in names])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("mean")) for c in names]))
    averages = means.filter("_n > 0").select(stack.alias("s")).select("s.*")
    medians = exact_medians(values, [c for c in names if c in both])
    # one row per label
    return averages.join(F.broadcast(medians), "label", "left").withColumn("horizon", F.lit(h))


def exact_medians(df: DataFrame, names: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """Exact interpolated median of each column, ``label, median``, without ordering all its values.

    A mergeable sketch brackets the middle, rows below the bracket are counted, and only the few inside are put in order. ``df``
    is run three times. The driver sees five numbers a column.
    """
    at = [0.5 - 2.0 / accuracy, 0.5 + 2.0 / accuracy]  # a sketch errs by 1 / accuracy of the rows
    sketches = df.agg(*[F.percentile_approx(c, at, accuracy).alias(c) for c in names]).first()
    ends = {c: sketches[c] for c in names if sketches[c] is not None}
    if not ends:
        return df.sparkSession.createDataFrame([], "label string, median double")
    inside = {c: F.col(c).between(F.lit(lo), F.lit(hi)) for c, (lo, hi) in ends.items()}
    sizes = df.agg(*[x for c, (lo, _) in ends.items() for x in (
        F.count(c).alias(f"n_{c}"), F.count(F.when(F.col(c) < F.lit(lo), 1)).alias(f"b_{c}"), F.count(F.when(inside[c], 1)).alias(f"i_{c}"))]).first()
    middle = {c: ((sizes[f"n_{c}"] - 1) // 2, sizes[f"n_{c}"] // 2) for c in ends}  # places from 0
    missed = [c for c, (a, b) in middle.items() if not sizes[f"b_{c}"] <= a <= b < sizes[f"b_{c}"] + sizes[f"i_{c}"]]
    kept = {c: F.col(c).isNotNull() if c in missed else inside[c] for c in ends}
    picked = F.array(*[F.when(kept[c], F.struct(F.lit(c).alias("label"), F.col(c).alias("value"))) for c in ends])
    rows = df.select(F.explode(F.filter(picked, lambda x: x.isNotNull())).alias("s")).select("s.*")
    ranked = value_ranks(rows.groupBy("label", "value").agg(F.count(F.lit(1)).alias("cnt")), "value", ["label"])

    def value_at(side: int) -> Column:
        place = F.coalesce(*[F.when(F.col("label") == c, F.lit(m[side] - (0 if c in missed else sizes[f"b_{c}"]))) for c, m in middle.items()])
        return F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("cnt")), F.col("value")))

    both = ranked.groupBy("label").agg(value_at(0).alias("lo"), value_at(1).alias("hi"))
    return both.select("label", (F.col("lo") + (F.col("hi") - F.col("lo")) * 0.5).alias("median"))


def empirical_percentile(df: DataFrame, value: str, actual: Column) -> Column:
    return F.avg(F.when(F.col(value) < actual, 1.0).otherwise(0.0))


def weighted_fold_summary(folds: DataFrame, metrics: Sequence[str], prefix: str, key: str = "experiment_id") -> DataFrame:
    """Row-weighted mean of every metric over folds with at least max(50, half the median) rows."""
    limits = folds.groupBy(key).agg(F.greatest(F.lit(50.0), 0.5 * F.percentile("rows", F.lit(0.5))).alias("_least"))
    kept = folds.join(limits, key).filter(F.col("rows") >= F.col("_least"))
    weight = F.greatest(F.coalesce(F.col("rows").cast("double"), F.lit(1.0)), F.lit(1.0))

    def mean(c: str) -> Column:
        return F.sum(F.col(c) * weight) / F.sum(F.when(F.col(c).isNotNull(), weight))

    return kept.groupBy(key).agg(
        F.count(F.lit(1)).cast("double").alias(f"{prefix}_valid_fold_count"),
        *[mean(c).alias(f"{prefix}_{c}") for c in metrics],
    )


def variant_rollup(runs: DataFrame, keys: Sequence[str] = ("model_name", "data_variant", "friction_variant")) -> DataFrame:
    """Mean and median results by model, data and friction variant; a variant may hold most runs."""
    medians = exact_quantiles(runs, "total_return", [0.5], keys).withColumnRenamed("q0", "median_total_return")
    means = runs.groupBy(*keys).agg(
        F.avg("total_return").alias("mean_total_return"),
        F.avg("annualized_return").alias("mean_annualized_return"),
        F.avg("sharpe").alias("mean_sharpe"),
        F.avg("sortino").alias("mean_sortino"),
        F.avg("max_drawdown").alias("mean_max_drawdown"),
        F.avg("trade_count").alias("mean_trade_count"),
        F.avg("hold_ratio").alias("mean_hold_ratio"),
        F.avg("final_net_worth").alias("mean_final_net_worth"),
        F.count_distinct("window_id").alias("windows"),
        F.count("ticker").alias("rows"),
    )
    return means.join(medians, list(keys), "left")


def style_rollup(styles: DataFrame, keys: Sequence[str] = ("model_name", "data_variant", "friction_variant", "style")) -> DataFrame:
    return styles.groupBy(*keys).agg(
        F.count_distinct("window_id").alias("windows"),
        F.count("ticker").alias("rows"),
        F.sum("bars").alias("total_bars"),
        F.sum("trade_rows").alias("total_trade_rows"),
        F.avg("trade_ratio").alias("mean_trade_ratio"),
        F.avg("mean_reward").alias("mean_reward"),
        F.avg("net_change").alias("mean_net_change"),
    )


def directional_rollup(rows: DataFrame, keys: Sequence[str] = ("model_name", "data_variant", "friction_variant", "horizon")) -> DataFrame:
    means = (
        "directional_accuracy avg_future_return avg_long_future_return avg_short_future_return "
        "avg_future_return_correct avg_future_return_wrong net_expectancy"
    ).split()
    return rows.groupBy(*keys).agg(
        F.count_distinct("window_id").alias("windows"),
        F.count("ticker").alias("rows"),
        F.sum("sample_count").alias("total_samples"),
        *[F.avg(c).alias(f"mean_{c}") for c in means],
    )


def daily_last(bars: DataFrame, key: str = "ticker", time: str = "ts", value: str = "close") -> DataFrame:
    """Last intraday value per ticker and day."""
    return bars.groupBy(key, F.to_date(time).alias("trade_date")).agg(F.max_by(value, time).alias(value))


def union_runs(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def archive_summary(chain: DataFrame, by: Sequence[str] = ("trade_date",)) -> DataFrame:
    """Row, traded-row, contract and open-interest totals of an option-chain archive."""
    return chain.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(F.col("contracts") > 0, 1).otherwise(0)).alias("traded_rows"),
        F.count_distinct("strike").alias("strikes"),
        F.sum("contracts").alias("contracts"),
        F.sum("open_int").alias("open_int"),
        F.max("close").alias("max_close"),
    )
