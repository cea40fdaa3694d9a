"""Evaluation metrics. Ranks are taken over counts per distinct value, so no task sorts a whole pooled fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.functions.layout import DAILY, UNKNOWN, Shape, _join_null_safe, avg_rank, cumulated, over_series, placed, range_ends, running, value_ranks
from tickloom.functions.session import cut_lineage, stored


def _keys(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn("_g", F.lit(0)), ["_g"])


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), shape: Shape = UNKNOWN) -> DataFrame:
    """Pearson correlation of average-tie ranks; null below five pairs or for a constant side."""
    pairs, keys = _keys(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y")), by)
    ranked = avg_rank(avg_rank(pairs, "_x", keys, "_rx", shape=shape), "_y", keys, "_ry", shape=shape)
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), _correlated().alias("ic_spearman")).drop("_g")


def _correlated(x: str | Column = "_rx", y: str | Column = "_ry") -> Column:
    """Correlation of the ranks ``x`` and ``y`` over the rows that have both."""
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)) & (F.count(y) >= 5)
    # written out: the built-in correlation fails on a constant side under ANSI arithmetic
    return F.when(varied, F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def decile_spread(df: DataFrame, score: str, ret: str, by: Sequence[str] = (), shape: Shape = UNKNOWN) -> DataFrame:
    """Mean return of scores ranked in the top and the bottom decile of the pool; null below 20 rows."""
    pairs, keys = _keys(df.filter(F.col(score).isNotNull() & F.col(ret).isNotNull()), by)
    per_score = pairs.groupBy(*keys, F.col(score).alias("_score")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(ret).alias("_ret")
    )
    ranked = value_ranks(per_score, "_score", keys, "cnt", shape).withColumn("_pct", F.col("avg_rank") / F.col("n"))
    top, bottom = F.col("_pct") >= 0.9, F.col("_pct") <= 0.1

    def mean(where):
        return F.sum(F.when(where, F.col("_ret"))) / F.sum(F.when(where, F.col("cnt")))

    enough = F.sum("cnt") >= 20
    return (
        ranked.groupBy(*keys)
        .agg(
            F.sum("cnt").alias("trade_count"),
            F.when(enough, mean(top)).alias("top_decile"),
            F.when(enough, mean(bottom)).alias("bottom_decile"),
        )
        .withColumn("spread", F.col("top_decile") - F.col("bottom_decile"))
        .drop("_g")
    )


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = (), shape: Shape = UNKNOWN) -> DataFrame:
    """Rank-sum AUC with ties; null for fewer than ten rows or a single class."""
    pairs, keys = _keys(df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()), by)
    positive = F.when(F.col(label) > 0, 1).otherwise(0)
    per_score = pairs.groupBy(*keys, F.col(score).alias("_score")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(positive).alias("_pos")
    )
    ranked = value_ranks(per_score, "_score", keys, "cnt", shape)
    n1 = F.sum("_pos")
    n0 = F.sum(F.col("cnt") - F.col("_pos"))
    area = (F.sum(F.col("avg_rank") * F.col("_pos")) - n1 * (n1 + 1) / 2.0) / F.nullif(n1 * n0, F.lit(0)).cast("double")
    return ranked.groupBy(*keys).agg(
        F.sum("cnt").alias("rows"), F.when(F.sum("cnt") >= 10, area).alias("auc")
    ).drop("_g")


def balanced_accuracy(
    df: DataFrame, label: str, prediction: str, by: Sequence[str] = (), threshold: float | None = 0.5
) -> DataFrame:
    """Mean recall over the classes present; null below ten rows. ``threshold=None`` compares class predictions."""
    pairs, keys = _keys(df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull()), by)
    predicted = F.col(prediction) if threshold is None else F.when(F.col(prediction) >= threshold, 1).otherwise(0)
    hit = F.when(predicted.cast("double") == F.col(label).cast("double"), 1.0).otherwise(0.0)
    recall = pairs.groupBy(*keys, label).agg(F.avg(hit).alias("_recall"), F.count(F.lit(1)).alias("_n"))
    return recall.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.when(F.sum("_n") >= 10, F.avg("_recall")).alias("balanced_accuracy")
    ).drop("_g")


def accuracy(df: DataFrame, label: str, score: str, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    pairs, keys = _keys(df, by)
    predicted = F.when(F.col(score) >= threshold, 1).otherwise(0)
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(F.when(predicted == F.col(label), 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg(F.col(label).cast("double")).alias("positive_rate"),
    ).drop("_g")


GAP_METRICS = ("ic_spearman", "top_decile", "spread", "auc", "balanced_accuracy")


def fold_metrics(predictions: DataFrame, by: Sequence[str], label: str = "label", score: str = "prediction",
                 target: str = "target_value", ret: str = "realized_return", shape: Shape = UNKNOWN, label_type: str | None = None) -> DataFrame:
    """Rows, rank correlation, decile returns, AUC and balanced accuracy per fold key.

    With a ``label_type``, metrics that it does not have are null: a regression has no AUC or balanced accuracy, a binary
    label no rank correlation.

    One ranking of the scores serves AUC, deciles and the scores' side of the rank correlation: with other weights it ranks
    among the rows that have a return, and among those that have a target.
    """
    if not shape.stamp_fits():
        return fold_metrics_of(predictions, by, {"": (label, target, ret)}, score, label_type)
    keys = list(by)
    rows = predictions.select(
        *keys, F.col(score).alias("_s"), F.col(target).alias("_y"), F.col(ret).alias("_r"), F.col(label).alias("_l")
    ).filter("_s IS NOT NULL AND _l IS NOT NULL")
    rows = rows.withColumns({"_one": F.lit(1), "_m": F.col("_r").isNotNull().cast("int"), "_k": F.col("_y").isNotNull().cast("int")})
    weights = ["_one", "_m", "_k"]
    group = Window.partitionBy(*keys)
    peers = group.orderBy("_s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    equal = Window.partitionBy(*keys, "_s")
    ranked = rows.withColumns({f"same_{w}": F.sum(w).over(equal) for w in weights} | {f"n_{w}": F.sum(w).over(group) for w in weights})
    ranked = ranked.withColumns({f"low_{w}": F.sum(w).over(peers) - F.col(f"same_{w}") for w in weights})
    place = {w: F.col(f"low_{w}") + (F.col(f"same_{w}") + 1) / 2.0 for w in weights}
    traded = F.col("_m") == 1
    ranked = ranked.select(*keys, "_s", "_y", "_r", "_l", place["_one"].alias("_rank"), F.when(traded, place["_m"] / F.col("n__m")).alias("_pct"), F.when(F.col("_k") == 1, place["_k"]).alias("_rx"))
    if label_type != "binary":
        ranked = avg_rank(ranked, "_y", keys, "_ry", shape=shape)
    n, n1, m = F.count("_s"), F.sum(F.when(F.col("_l") > 0, 1).otherwise(0)), F.count("_pct")
    area = (F.sum(F.when(F.col("_l") > 0, F.col("_rank"))) - n1 * (n1 + 1) / 2.0) / F.nullif(n1 * (n - n1), F.lit(0)).cast("double")

    def mean(where):
        return F.when(m >= 20, F.avg(F.when(where, F.col("_r"))))

    unknown = F.lit(None).cast("double")
    pooled = ranked.groupBy(*keys).agg(
        n.alias("rows"),
        (unknown if label_type == "regression" else F.when(n >= 10, area)).alias("auc"),
        m.alias("trade_count"), mean(F.col("_pct") >= 0.9).alias("top_decile"), mean(F.col("_pct") <= 0.1).alias("bottom_decile"),
        (unknown if label_type == "binary" else _correlated()).alias("ic_spearman"),
    ).withColumn("spread", F.col("top_decile") - F.col("bottom_decile"))
    if label_type == "regression":
        return pooled.withColumn("balanced_accuracy", unknown)
    return pooled.join(balanced_accuracy(ranked, "_l", "_s", keys).drop("rows"), keys, "left")


def fold_metrics_of(predictions: DataFrame, by: Sequence[str], sides: dict[str, tuple[str, str, str]], score: str = "prediction", label_type: str | None = None) -> DataFrame:
    """:func:`fold_metrics` of the same scores against several sides (label, target, return): columns begin with the side's name.

    The narrow rows are written once. Scores are ordered once for all sides and each target once, in ranges fixed beforehand:
    an order is one exchange, after which the score has given way to its rank. Folds are few, and so are their ranges.
    """
    keys, used = list(by), {}
    for column in (c for side in sides.values() for c in side):
        used.setdefault(column, f"_c{len(used)}")
    sides = {name: tuple(used[c] for c in side) for name, side in sides.items()}
    rows = predictions.select(*keys, F.col(score).alias("_s"), *[F.col(c).alias(n) for c, n in used.items()])
    labelled = F.array_size(F.filter(F.array(*[F.col(side[0]).isNotNull() for side in sides.values()]), lambda x: x)) > 0
    rows = stored(rows.filter(F.col("_s").isNotNull() & labelled), "scored")
    holes = rows.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in used.values()]).first()
    weights = {"_one": F.lit(1)}

    def known(*columns: str) -> str:
        """The weight of rows that have all these columns."""
        missing = [c for c in dict.fromkeys(columns) if holes[c]]
        name = "".join(["_known", *missing]) if missing else "_one"
        for c in missing:
            weights[name] = weights.get(name, F.lit(1)) * F.col(c).isNotNull().cast("int")
        return name

    counted = {name: (known(label), known(label, ret), known(label, target)) for name, (label, target, ret) in sides.items()}
    targets = {} if label_type == "binary" else {t: list(dict.fromkeys(counted[n][2] for n, side in sides.items() if side[1] == t)) for _, t, _ in sides.values()}
    # one row per fold
    ends = cut_lineage(range_ends(rows, keys, ["_s", *targets]))
    source = _join_null_safe(rows, F.broadcast(ends.select(*keys, "_g")), keys).drop(*keys).withColumns(weights)

    def place(w: str) -> Column:
        return F.when(F.col(w) == 1, F.col(f"low_{w}") + (F.col(f"same_{w}") + 1) / 2.0)

    def part(w: str) -> Column:
        share = place(w) / F.col(f"n_{w}")
        return F.when(share >= 0.9, 1).when(share <= 0.1, -1).when(share.isNotNull(), 0)

    ranked = placed(source, source, ends, "_s", list(weights)).select(
        "_g", *used.values(), *[place(w).alias(f"_x{w}") for w in dict.fromkeys(w for c in counted.values() for w in (c[0], c[2]))],
        *[part(w).alias(f"_part{w}") for w in dict.fromkeys(c[1] for c in counted.values())],
    )
    for target, ws in targets.items():
        kept = ranked.columns
        ranked = placed(ranked.withColumns(weights), source, ends, target, ws).select(*kept, *[place(w).alias(f"_y{target}{w}") for w in ws])
    unknown, out = F.lit(None).cast("double"), []
    for name, (label, target, ret) in sides.items():
        one, m, k = counted[name]
        up = F.col(label) > 0
        n, n1, trades = F.count(label), F.sum(F.when(up, 1).otherwise(0)), F.count(f"_part{m}")
        area = (F.sum(F.when(up, F.col(f"_x{one}"))) - n1 * (n1 + 1) / 2.0) / F.nullif(n1 * (n - n1), F.lit(0)).cast("double")

        def mean(side: int, m=m, ret=ret, trades=trades) -> Column:
            return F.when(trades >= 20, F.avg(F.when(F.col(f"_part{m}") == side, F.col(ret))))

        out += [
            n.alias(f"{name}rows"), (unknown if label_type == "regression" else F.when(n >= 10, area)).alias(f"{name}auc"),
            trades.alias(f"{name}trade_count"), mean(1).alias(f"{name}top_decile"), mean(-1).alias(f"{name}bottom_decile"),
            (unknown if label_type == "binary" else _correlated(f"_x{k}", f"_y{target}{k}")).alias(f"{name}ic_spearman"),
        ]
    pooled = ranked.groupBy("_g").agg(*out).join(F.broadcast(ends.select(*keys, "_g")), "_g")
    for name, (label, _, _) in sides.items():
        pooled = pooled.withColumn(f"{name}spread", F.col(f"{name}top_decile") - F.col(f"{name}bottom_decile"))
        if label_type == "regression":
            pooled = pooled.withColumn(f"{name}balanced_accuracy", unknown)
        else:
            recall = balanced_accuracy(rows, label, "_s", keys).drop("rows")
            pooled = pooled.join(recall.withColumnRenamed("balanced_accuracy", f"{name}balanced_accuracy"), keys, "left")
    names = ("rows", "auc", "trade_count", "top_decile", "bottom_decile", "ic_spearman", "spread", "balanced_accuracy")
    return pooled.select(*keys, *[f"{name}{c}" for name in sides for c in names])


def class_metrics(predictions: DataFrame, by: Sequence[str], score: str = "prediction", target: str = "target_value") -> DataFrame:
    """Fold metrics of class predictions: balanced accuracy and the number of predictions other than 0."""
    balanced = balanced_accuracy(predictions, target, score, by, threshold=None).drop("rows")
    trades = predictions.groupBy(*by).agg(F.sum(F.when(F.col(score) != 0, 1).otherwise(0)).alias("trade_count"))
    blank = [F.lit(None).cast("double").alias(m) for m in ("auc", "top_decile", "bottom_decile", "spread", "ic_spearman")]
    return trades.join(balanced, list(by), "left").select("*", *blank)


def real_vs_shuffled(real: DataFrame, shuffled: DataFrame, key: str = "experiment_id") -> DataFrame:
    """Full outer join of the two summaries with the gap of every shared metric."""
    out = real.join(shuffled, key, "full")
    gaps = [
        (F.col(f"real_{m}") - F.col(f"shuf_{m}")).alias(f"gap_{m}")
        for m in GAP_METRICS
        if f"real_{m}" in out.columns and f"shuf_{m}" in out.columns
    ]
    return out.select("*", *gaps)


def promoted(compare: DataFrame, name: str = "promoted") -> DataFrame:
    """True when every available check holds; false when none is available."""
    # fixed values: floor of each check
    floors = {
        "real_top_decile": 0.0,
        "gap_top_decile": 0.0,
        "real_spread": 0.0,
        "gap_ic_spearman": 0.0,
        "real_auc": 0.5,
        "gap_auc": 0.0,
        "real_balanced_accuracy": 0.5,
        "gap_balanced_accuracy": 0.0,
    }
    checks = F.array(*[F.col(c) > v for c, v in floors.items() if c in compare.columns])
    known = F.filter(checks, lambda x: x.isNotNull())
    return compare.withColumn(name, (F.size(known) > 0) & F.forall(known, lambda x: x))


def score_buckets(df: DataFrame, score: str, ret: str, by: Sequence[str] = (), buckets: int = 10, shape: Shape = UNKNOWN) -> DataFrame:
    """Mean return per score decile (decile = ceil of ten times the percent rank)."""
    pairs, keys = _keys(df.filter(F.col(score).isNotNull() & F.col(ret).isNotNull()), by)
    per_score = pairs.groupBy(*keys, F.col(score).alias("_score")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(ret).alias("_ret")
    )
    ranked = value_ranks(per_score, "_score", keys, "cnt", shape)
    bucket = F.least(F.ceil(F.col("avg_rank") * buckets / F.col("n")), F.lit(buckets))
    return ranked.groupBy(*keys, bucket.alias("bucket")).agg(
        F.sum("cnt").alias("rows"), (F.sum("_ret") / F.sum("cnt")).alias("mean_return")
    ).drop("_g")


def bucket_quality(buckets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Top minus bottom bucket and the rank correlation of bucket and return (ten rows per key)."""
    ranks = spearman(buckets, "bucket", "mean_return", by)
    ends = buckets.groupBy(*by).agg(
        F.sum("rows").alias("row_count"),
        F.max_by("mean_return", "bucket").alias("top_return"),
        F.min_by("mean_return", "bucket").alias("bottom_return"),
    )
    return ends.join(ranks, list(by)).withColumn("spread", F.col("top_return") - F.col("bottom_return"))


def rank_history(
    predictions: DataFrame, by: Sequence[str] = ("experiment_id", "ts"), score: str = "prediction", shape: Shape = UNKNOWN
) -> DataFrame:
    """Percent rank and descending order of each prediction inside its experiment and date.

    Both come from one order of the rows.
    """
    keys, known = list(by), F.col(score).isNotNull()
    rows = predictions.withColumns({"_neg": -F.col(score), "_one": F.lit(1), "_known": known.cast("int")})
    if shape.stamp_fits():
        w, equal = Window.partitionBy(*keys), Window.partitionBy(*keys, "_neg")
        placed = rows.withColumns({"below__one": F.row_number().over(w.orderBy("_neg", "ticker")) - 1, "n__known": F.sum("_known").over(w), "same__known": F.sum("_known").over(equal)})
        upto = w.orderBy("_neg").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        placed = placed.withColumn("low__known", F.sum("_known").over(upto) - F.col("same__known"))
    else:
        placed = cumulated(rows, keys, ["_neg", "ticker"], ["_one", "_known"], ["_neg"])
    rank = F.col("n__known") - F.col("low__known") - (F.col("same__known") - 1) / 2.0
    return placed.select(*predictions.columns, F.when(known, rank / F.col("n__known")).alias("rank_pct"), (F.col("below__one") + 1).cast("int").alias("rank_order"))


def drawdown_relative(df: DataFrame, value: str, key: Sequence[str], order: Sequence[str], shape: Shape = DAILY) -> DataFrame:
    """Deepest fall from the running peak, as a fraction of the peak."""
    peaked = running(df, key, order, {"_peak": ("max", F.col(value))}, shape)
    return peaked.groupBy(*key).agg(F.min((F.col(value) - F.col("_peak")) / F.nullif("_peak", F.lit(0.0))).alias("max_drawdown"))


def drawdown_points(df: DataFrame, pnl: str, key: Sequence[str], order: Sequence[str], shape: Shape = DAILY) -> DataFrame:
    """Deepest fall of the cumulated points from their running peak."""
    summed = running(df, key, order, {"_equity": ("sum", F.coalesce(F.col(pnl), F.lit(0.0)))}, shape)
    peaked = running(summed, key, order, {"_peak": ("max", F.col("_equity"))}, shape)
    return peaked.groupBy(*key).agg(F.min(F.col("_equity") - F.col("_peak")).alias("max_drawdown_points"))


def drawdown_reward(df: DataFrame, reward: str, key: Sequence[str], order: Sequence[str], shape: Shape = DAILY) -> DataFrame:
    """Positive drawdown of cumulated rewards; the peak is floored at 1e-9."""
    summed = running(df, key, order, {"_equity": ("sum", F.col(reward))}, shape)
    peaked = running(summed, key, order, {"_peak": ("max", F.col("_equity"))}, shape)
    fall = (F.col("_equity") - F.col("_peak")) / F.greatest(F.col("_peak"), F.lit(1e-9))
    return peaked.groupBy(*key).agg((-F.min(fall)).alias("reward_drawdown"))


# fixed values: bars per year of each interval
BARS_PER_YEAR = {"day": 252.0, "60minute": 1575.0, "30minute": 3150.0, "15minute": 6300.0, "5minute": 18900.0}


def sharpe(ret, per_year: float):
    std = F.stddev_samp(ret)
    return F.when(std >= 1e-12, F.avg(ret) / std * F.sqrt(F.lit(per_year))).otherwise(0.0)


def sortino(ret, per_year: float):
    down = F.stddev_samp(F.when(ret < 0, ret))
    return F.when(down >= 1e-12, F.avg(ret) / down * F.sqrt(F.lit(per_year))).otherwise(0.0)


def penalised_sharpe(reward, risk_free: float = 0.0, cap: float = 10.0, least: float = 1e-6, penalty: float = -10.0):
    """Population Sharpe with a penalty for inactivity and a cap."""
    std = F.stddev_pop(reward)
    return F.when(std < least, penalty).otherwise(F.least((F.avg(reward) - risk_free) / (std + 1e-8), F.lit(cap)))


def penalised_sortino(reward, risk_free: float = 0.0, cap: float = 10.0, least: float = 1e-6, penalty: float = -10.0):
    down = F.stddev_pop(F.when(reward < risk_free, reward))
    return F.when(down.isNull() | (down < least), penalty).otherwise(
        F.least((F.avg(reward) - risk_free) / (down + 1e-8), F.lit(cap))
    )


def expectancy(ret):
    """P(win) * average win - P(loss) * average loss; 0 for no rows."""
    n = F.nullif(F.count(ret), F.lit(0)).cast("double")
    win = F.coalesce(F.sum(F.when(ret > 0, ret)), F.lit(0.0))
    loss = F.coalesce(F.sum(F.when(ret < 0, -ret)), F.lit(0.0))
    return F.coalesce((win - loss) / n, F.lit(0.0))


def history_metrics(history: DataFrame, interval: str = "day", by: Sequence[str] = ("ticker",), order: Sequence[str] = ("ts",), shape: Shape = DAILY) -> DataFrame:
    """Return, risk and activity of a back-test history (columns net_worth, action) per key."""
    from tickloom.operators.cleaning import fill

    k = BARS_PER_YEAR.get(interval, 252.0)
    keys = list(by)
    filled = fill(history, ["net_worth"], "ffill_bfill", keys, list(order), shape)
    stepped = over_series(
        filled,
        lambda d, w: d.withColumn("_ret", F.coalesce(R.change(F.col("net_worth"), w, 1), F.lit(0.0))),
        keys,
        list(order),
        before=1,
        shape=shape,
    )
    peaked = running(stepped, keys, list(order), {"_peak": ("max", F.col("net_worth"))}, shape)
    at = F.struct(*order)
    action = F.coalesce(F.col("action").cast("double"), F.lit(0.0))
    out = peaked.groupBy(*keys).agg(
        F.min_by("net_worth", at).alias("_first"),
        F.max_by("net_worth", at).alias("final_net_worth"),
        F.count(F.lit(1)).alias("bars"),
        sharpe(F.col("_ret"), k).alias("sharpe"),
        sortino(F.col("_ret"), k).alias("sortino"),
        F.min((F.col("net_worth") - F.col("_peak")) / F.nullif("_peak", F.lit(0.0))).alias("max_drawdown"),
        F.sum(F.when(action != 0, 1).otherwise(0)).alias("trade_count"),
        F.avg(F.when(action == 0, 1.0).otherwise(0.0)).alias("hold_ratio"),
        F.avg(F.abs(action)).alias("avg_abs_action"),
    )
    total = F.when((F.col("bars") >= 2) & (F.col("_first") != 0), F.col("final_net_worth") / F.nullif("_first", F.lit(0.0)) - 1.0).otherwise(0.0)
    # a loss beyond the whole stake has no annual rate
    annual = F.when(F.col("bars") <= 1, 0.0).when(
        F.col("total_return") >= -1.0, F.pow(1.0 + F.col("total_return"), F.lit(k) / F.col("bars")) - 1.0
    )
    return out.withColumn("total_return", total).withColumn("annualized_return", annual).drop("_first")


def style_mix(history: DataFrame, by: Sequence[str] = ("ticker",), order: Sequence[str] = ("ts",), shape: Shape = DAILY) -> DataFrame:
    """Bars, trades, reward and net-worth change per strategy style."""
    from tickloom.operators.cleaning import fill

    filled = fill(history, ["net_worth"], "ffill_bfill", by, order, shape)
    at = F.struct(*order)
    out = filled.groupBy(*by, F.coalesce("style", F.lit("unknown")).alias("style")).agg(
        F.count(F.lit(1)).alias("bars"),
        F.sum(F.when(F.coalesce("action", F.lit(0.0)) != 0, 1).otherwise(0)).alias("trade_rows"),
        F.avg(F.coalesce("reward", F.lit(0.0))).alias("mean_reward"),
        F.min_by("net_worth", at).alias("start_net_worth"),
        F.max_by("net_worth", at).alias("end_net_worth"),
    )
    return out.select(
        "*",
        (F.col("trade_rows") / F.col("bars")).alias("trade_ratio"),
        (F.col("end_net_worth") - F.col("start_net_worth")).alias("net_change"),
    )


def directional(history: DataFrame, horizons: Sequence[int] = (1, 3), by: Sequence[str] = ("ticker",), order: Sequence[str] = ("ts",), shape: Shape = DAILY) -> DataFrame:
    """How well actions point at the return over the next trades: leads run over trade rows only."""
    trades = history.withColumn("_dir", F.signum(F.coalesce(F.col("action").cast("double"), F.lit(0.0)))).filter("_dir <> 0")

    def build(d, w):
        ahead = [
            F.struct(F.lit(h).alias("horizon"), (F.lead("close", h).over(w) / F.col("close") - 1.0).alias("ret")) for h in horizons
        ]
        return d.withColumn("_f", F.array(*ahead))

    stacked = over_series(trades, build, by, order, after=max(horizons), shape=shape)
    rows = stacked.select(*by, "_dir", F.explode("_f").alias("_x")).select(*by, "_dir", "_x.horizon", "_x.ret").filter("ret IS NOT NULL")
    right = F.col("_dir") == F.signum("ret")

    def mean_where(condition):
        return F.coalesce(F.avg(F.when(condition, F.col("ret"))), F.lit(0.0))

    return rows.groupBy(*by, "horizon").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(F.when(right, 1.0).otherwise(0.0)).alias("directional_accuracy"),
        F.avg("ret").alias("avg_future_return"),
        mean_where(F.col("_dir") > 0).alias("avg_long_future_return"),
        mean_where(F.col("_dir") < 0).alias("avg_short_future_return"),
        mean_where(right).alias("avg_future_return_correct"),
        mean_where(~right).alias("avg_future_return_wrong"),
        F.avg(F.col("_dir") * F.col("ret")).alias("net_expectancy"),
    )


def alpha_class(sharpe_value):
    # fixed values: class limits
    return (
        F.when(sharpe_value.isNull() | F.isnan(sharpe_value), "invalid")
        .when(sharpe_value < 0.2, "no_alpha_likely")
        .when(sharpe_value < 0.6, "weak_alpha")
        .when(sharpe_value < 1.0, "moderate_alpha")
        .otherwise("strong_alpha")
    )
