"""Models of each ticker's own, from mergeable aggregates: next-day lines, and diagnostics that leave one ticker out.

No fit collects a ticker's rows or loops over tickers on the driver: a fit sees sums, one row for each ticker (or left-out
ticker), and rows only meet parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.layout import DAILY, Shape, positions
from tickloom.functions.session import stored
from tickloom.operators.cleaning import clean_xy
from tickloom.operators.metrics import accuracy, alpha_class, roc_auc
from tickloom.operators.rollups import exact_quantiles


def ticker_split(frame: DataFrame, features: Sequence[str], target: str = "target", ratio: float = 0.7, least: int = 200, shape: Shape = DAILY) -> DataFrame:
    """Complete rows of tickers that have ``least`` of them, with ``segment``: the first ``ratio`` of each ticker trains."""
    rows = clean_xy(frame.select("ticker", "ts", *features, target), [*features, target])
    sizes = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows_total")).filter(F.col("rows_total") >= least)
    placed = positions(rows.join(sizes, "ticker"), ["ticker"], ["ts"], "_i", shape)
    train = F.col("_i") <= F.floor(F.col("rows_total") * ratio)
    return placed.withColumn("segment", F.when(train, "train").otherwise("test")).drop("_i")


def linear_fits(train: DataFrame, features: Sequence[str], target: str = "target", by: str = "ticker") -> DataFrame:
    """Least squares of each ticker: ``by, intercept, weights, rows_train``.

    The covariances of a ticker are mergeable and stable; the normal equations on them are solved where its one row is, with
    the shortest solution where features depend on each other.
    """
    names = list(features)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    means = F.array(*[F.avg(c) for c in names], F.avg(target))
    square = F.array(*[F.covar_pop(names[i], names[j]) for i, j in pairs])
    cross = F.array(*[F.covar_pop(c, target) for c in names])
    sums = train.groupBy(by).agg(F.count(F.lit(1)).alias("rows_train"), means.alias("means"), square.alias("square"), cross.alias("cross"))

    def solve(batches):
        for pdf in batches:
            out = []
            for means, square, cross in zip(pdf["means"], pdf["square"], pdf["cross"], strict=True):
                matrix = np.zeros((len(names), len(names)))
                for (i, j), value in zip(pairs, square, strict=True):
                    matrix[i, j] = matrix[j, i] = value
                scale = np.sqrt(np.maximum(np.diag(matrix), 0.0))
                scale[scale == 0] = 1.0
                weights = np.linalg.lstsq(matrix / np.outer(scale, scale), np.asarray(cross, float) / scale, rcond=1e-12)[0] / scale
                out.append((float(means[-1] - weights @ np.asarray(means[:-1], float)), weights.tolist()))
            yield pd.DataFrame({by: pdf[by], "intercept": [a for a, _ in out], "weights": [w for _, w in out], "rows_train": pdf["rows_train"]})

    return sums.mapInPandas(solve, f"{by} string, intercept double, weights array<double>, rows_train bigint")


def next_day_lines(frame: DataFrame, features: Sequence[str], target: str = "target", ratio: float = 0.7, least: int = 200, shape: Shape = DAILY) -> DataFrame:
    """Predictions of the test rows by each ticker's own line."""
    split = stored(ticker_split(frame, features, target, ratio, least, shape), "split")
    fits = linear_fits(split.filter("segment = 'train'"), features, target)
    line = F.col("intercept")
    for i, c in enumerate(features):
        line = line + F.col("weights")[i] * F.col(c)
    # one row a ticker against its rows
    return split.filter("segment = 'test'").join(fits, "ticker").select("ticker", "ts", "rows_total", "rows_train", line.alias("prediction"), F.col(target).alias("target"))


def sign_strategy(predictions: DataFrame) -> DataFrame:
    """Each ticker's return of trading the prediction's sign: mean, deviation, hit rate, Sharpe ratio and class."""
    signal = F.signum("prediction")
    ret = signal * F.col("target")
    keys = [c for c in ("ticker", "rows_total", "rows_train") if c in predictions.columns]
    stats = predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_test"), F.avg(ret).alias("mean_daily_return"), F.stddev_pop(ret).alias("std_daily_return"),
        F.avg(F.when(F.signum("target") == signal, 1.0).otherwise(0.0)).alias("hit_rate"),
    )
    sharpe = F.when(F.col("std_daily_return") > 0, F.col("mean_daily_return") / F.col("std_daily_return") * F.sqrt(F.lit(252.0)))
    return stats.withColumn("sharpe", sharpe).withColumn("alpha_class", alpha_class(F.col("sharpe")))


def strategy_roll_up(stats: DataFrame, by: str = "model") -> DataFrame:
    """Mean and median Sharpe ratio and mean hit rate over the tickers of each model."""
    means = stats.groupBy(by).agg(F.count(F.lit(1)).alias("tickers"), F.avg("sharpe").alias("mean_sharpe"), F.avg("hit_rate").alias("mean_hit_rate"))
    return means.join(exact_quantiles(stats, "sharpe", [0.5], [by]).withColumnRenamed("q0", "median_sharpe"), by, "left")


#: rows and left-out models that a task multiplies at once: few enough for a core's cache
ROWS, MODELS = 1024, 256
#: largest fourth derivative of the logistic function, rounded up
FIFTH = 0.13


def leave_one_out_logistic(
    frame: DataFrame, features: Sequence[str], key: str = "ticker", label: str = "label_up", tolerance: float = 1e-9, most: int = 50, direct: int = MODELS,
) -> DataFrame:
    """``key, intercept, weights`` of a balanced, ridge-penalised logistic model fitted on all rows but those of the key.

    Features are centred and scaled over the rows a model sees; the penalty is one per data set. All models start where the
    one model of all rows ends. Up to ``direct`` keys each step multiplies all rows with all models. With more keys the sums
    over all rows are a polynomial around that start, taken once, and a step reads a row only for the model of its own key, so
    the work is rows, not rows times keys. A model whose polynomial is not proven exact to ``tolerance`` (its key holds a
    large part of the rows) is fitted the first way. The driver holds one set of sums a key, never rows: 36 numbers for six
    features, 29 MB for 100,000 keys.
    """
    return _left_out_models(_numbered(frame, features, key, label), features, tolerance, most, direct).withColumnRenamed("key", key)


def _numbered(frame: DataFrame, features: Sequence[str], key: str, label: str, carry: Sequence[str] = ()) -> DataFrame:
    """Rows as the fits read them, stored: ``key``, label ``y``, features ``x`` and columns the scores need besides."""
    x = F.array(*[F.col(c).cast("double") for c in features]).alias("x")
    return stored(frame.select(F.col(key).cast("string").alias("key"), F.col(label).cast("double").alias("y"), x, *[F.col(c).alias(f"_{c}") for c in carry]), "rows")


def _left_out_models(rows: DataFrame, features: Sequence[str], tolerance: float = 1e-9, most: int = 50, direct: int = MODELS) -> DataFrame:
    rows, width = rows.select("key", "y", "x"), len(features) + 1
    tops = [F.max(F.abs(F.col("x")[i])).alias(f"m{i}") for i in range(width - 1)]
    sums = rows.groupBy("key").agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(width - 1)],
                                   *[F.sum(F.col("x")[i] * F.col("x")[i]).alias(f"q{i}") for i in range(width - 1)], *tops).toPandas()
    sums = sums.sort_values("key", na_position="first").reset_index(drop=True)  # one row a key: the models themselves
    largest = sums[[f"m{i}" for i in range(width - 1)]].max().to_numpy(float)
    sums = sums.drop(columns=[f"m{i}" for i in range(width - 1)])
    whole = sums.drop(columns="key").sum()
    rest = whole - sums.drop(columns="key")
    usable = ((rest["ones"] > 0) & (rest["ones"] < rest["n"])).to_numpy()
    keys, rest = sums["key"][usable].tolist(), rest[usable].reset_index(drop=True)
    raw, intercept = np.zeros((len(keys), width - 1)), np.zeros(len(keys))
    if keys:
        every, mean, scale = _newton(rows, [None], whole.to_frame().T, np.zeros((1, width)), False, tolerance, most)
        left = np.arange(len(keys))
        if len(keys) > direct:
            raw, intercept, left = _near(rows, keys, rest, every[0], mean[0], scale[0], largest, tolerance, most)
        if len(left):
            own_mean, own_scale = _moments(rest.iloc[left], width - 1)
            start = every[0, :-1] / scale[0]
            begin = np.concatenate([start * own_scale, (every[0, -1] - start @ mean[0] + (start * own_mean).sum(1))[:, None]], 1)
            models, own_mean, own_scale = _newton(rows, [keys[i] for i in left], rest.iloc[left], begin, True, tolerance, most)
            raw[left] = models[:, :-1] / own_scale
            intercept[left] = models[:, -1] - (raw[left] * own_mean).sum(1)
    weights = pa.FixedSizeListArray.from_arrays(pa.array(raw.ravel()), width - 1).cast(pa.list_(pa.float64()))
    table = pa.table({"key": pa.array(keys, pa.string()), "intercept": pa.array(intercept, pa.float64()), "weights": weights})
    return rows.sparkSession.createDataFrame(table, "key string, intercept double, weights array<double>")


def _near(
    rows: DataFrame, keys: list, rest: pd.DataFrame, start: np.ndarray, mean: np.ndarray, scale: np.ndarray, largest: np.ndarray, tolerance: float, most: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Raw weights and intercepts of the models of all keys, and the numbers of those not proven exact to ``tolerance``.

    A model's sums are those over all rows, a polynomial of its distance from ``start``, less those over its key's rows.
    """
    width = len(start)
    upper, inner = np.triu_indices(width), np.arange(width - 1)
    sums = _expansion(rows, start, mean, scale)
    n, ones = rest["n"].to_numpy(float), rest["ones"].to_numpy(float)
    class_weight = np.stack([n / (2 * (n - ones)), n / (2 * ones)], 1)
    ridge = np.concatenate([(_moments(rest, width - 1)[1] / scale) ** 2, np.zeros((len(keys), 1))], 1)
    reach = np.append((largest + abs(mean)) / scale, 1.0)  # no feature of a row is larger
    moved, open_, far = np.zeros((len(keys), width)), np.ones(len(keys), bool), np.zeros(len(keys), bool)
    for _ in range(most):
        models = start + moved
        own = _own_derivatives(rows, keys, models, mean, scale, class_weight)
        for first in range(0, len(keys), 8192):
            at = np.arange(first, min(first + 8192, len(keys)))
            at = at[open_[at]]
            if not len(at):
                continue
            gradient, hessian, error = _polynomial(moved[at], sums, class_weight[at])
            gradient += ridge[at] * models[at] - own[at, :width]
            hessian = hessian - own[at, width:]
            matrix = np.zeros((len(at), width, width))
            matrix[:, upper[0], upper[1]] = matrix[:, upper[1], upper[0]] = hessian
            matrix[:, inner, inner] += ridge[at][:, :-1]
            inverse = np.linalg.inv(matrix)
            step = (inverse @ gradient[:, :, None])[:, :, 0]
            beyond = ~((error[:, None] * (abs(inverse) @ reach)).max(1) <= tolerance)
            far[at] |= beyond
            moved[at] -= np.where(beyond[:, None], 0.0, step)
            open_[at] = ~beyond & (abs(step).max(1) >= tolerance)
        if not open_.any():
            break
    raw = (start + moved)[:, :-1] / scale
    return raw, (start + moved)[:, -1] - raw @ mean, np.flatnonzero(far | open_)


def _polynomial(moved: np.ndarray, sums: Sequence[Sequence[np.ndarray]], class_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient, Hessian (upper half) and largest error of a gradient's part for a feature of 1, of models ``moved`` from the start."""
    width = moved.shape[1]
    upper = np.triu_indices(width)
    pairs = moved[:, upper[0]] * moved[:, upper[1]]
    twice = pairs * np.where(upper[0] == upper[1], 1.0, 2.0)
    gradient, hessian, error = np.zeros_like(moved), np.zeros_like(pairs), np.zeros(len(moved))

    def times(half):
        matrix = np.zeros((len(moved), width, width))
        matrix[:, upper[0], upper[1]] = matrix[:, upper[1], upper[0]] = half
        return (matrix @ moved[:, :, None])[:, :, 0]

    for side, (one, two, three, four, size) in enumerate(sums):
        weight = class_weight[:, side, None]
        bent = twice @ four
        gradient += weight * (one + times(np.broadcast_to(two, pairs.shape)) + twice @ three / 2 + times(bent) / 6)
        hessian += weight * (two + moved @ three.T + bent / 2)
        error += class_weight[:, side] * ((twice @ size) * twice).sum(1) * FIFTH / 24
    return gradient, hessian, error


def _features(batch: pa.RecordBatch, width: int, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centred and scaled features with a 1 behind them, and whether the label is the upper class."""
    x = (batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width - 1) - mean) / scale
    return np.concatenate([x, np.ones((len(x), 1))], 1), batch.column(1).to_numpy(zero_copy_only=False) > 0


def _expansion(rows: DataFrame, start: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> list[list[np.ndarray]]:
    """Sums over the rows of either class: products of one to four features times the loss's derivatives at ``start``, and bare products of four."""
    width = len(start)
    upper = np.triu_indices(width)
    half = len(upper[0])
    shapes = [(width,), (half,), (half, width), (half, half), (half, half)]
    sizes = [int(np.prod(s)) for s in shapes]

    def run(batches):
        total = np.zeros((2, sum(sizes)))
        for batch in batches:
            every, high = _features(batch, width, mean, scale)
            for side in (0, 1):
                of = every[high == side]
                for at in range(0, len(of), 4 * ROWS):
                    x = of[at : at + 4 * ROWS]
                    p = 1 / (1 + np.exp(np.minimum(-(x @ start), 500)))
                    v, products = p * (1 - p), x[:, upper[0]] * x[:, upper[1]]
                    parts = [(p - side) @ x, v @ products, (products * (v * (1 - 2 * p))[:, None]).T @ x, (products * (v * (1 - 6 * v))[:, None]).T @ products, products.T @ products]
                    total[side] += np.concatenate([s.ravel() for s in parts])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(total.tolist(), pa.list_(pa.float64()))], ["side", "sums"])

    parts = rows.mapInArrow(run, "side bigint, sums array<double>").select("side", F.posexplode("sums").alias("place", "part"))
    added = parts.groupBy("side", "place").agg(F.sum("part").alias("s")).toPandas()  # a fixed number of sums
    total = np.zeros((2, sum(sizes)))
    total[added["side"], added["place"]] = added["s"]
    return [[s.reshape(shape) for s, shape in zip(np.split(t, np.cumsum(sizes)[:-1]), shapes, strict=True)] for t in total]


def _own_derivatives(rows: DataFrame, keys: list, models: np.ndarray, mean: np.ndarray, scale: np.ndarray, class_weight: np.ndarray) -> np.ndarray:
    """Gradient and upper half of the Hessian of each model over the rows of its key alone."""
    count, width = models.shape
    upper = np.triu_indices(width)
    shared = rows.sparkSession.sparkContext.broadcast((models, class_weight, {k: i for i, k in enumerate(keys)}))  # one row of parameters a key
    names = [f"s{i}" for i in range(width + len(upper[0]))]

    def run(batches):
        models, weight, number = shared.value
        for batch in batches:
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            own = np.array([number.get(k, -1) for k in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
            x, high = _features(batch, width, mean, scale)
            order = np.argsort(own, kind="stable")
            order = order[np.searchsorted(own[order], 0) :]
            if not len(order):
                continue
            own, x, high = own[order], x[order], high[order]
            p = 1 / (1 + np.exp(np.minimum(-(x * models[own]).sum(1), 500)))
            w = weight[own, high.astype(int)]
            sums = np.concatenate([x * (w * (p - high))[:, None], x[:, upper[0]] * x[:, upper[1]] * (w * p * (1 - p))[:, None]], 1)
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            sums = np.add.reduceat(sums, first, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(own[first]), *[pa.array(np.ascontiguousarray(s)) for s in sums.T]], ["model", *names])

    parts = rows.mapInArrow(run, "model bigint, " + ", ".join(f"{c} double" for c in names))
    added = parts.groupBy("model").agg(*[F.sum(c).alias(c) for c in names]).toPandas()  # a fixed number of sums a key
    shared.destroy()
    out = np.zeros((count, len(names)))
    out[added["model"]] = added[names]
    return out


def _moments(sums: pd.DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the features from sums, a row a model."""
    n = sums["n"].to_numpy(float)
    mean = sums[[f"s{i}" for i in range(count)]].to_numpy(float) / n[:, None]
    scale = np.sqrt(np.maximum(sums[[f"q{i}" for i in range(count)]].to_numpy(float) / n[:, None] - mean**2, 0) * (n / np.maximum(n - 1, 1))[:, None])
    scale[scale == 0] = 1.0
    return mean, scale


def _newton(rows: DataFrame, keys: list, sums: pd.DataFrame, models: np.ndarray, apart: bool, tolerance: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Models of scaled features (weights, then the intercept) with their means and scales; ``apart`` from the rows of their key."""
    inner = np.arange(models.shape[1] - 1)
    mean, scale = _moments(sums, len(inner))
    n, ones = sums["n"].to_numpy(float), sums["ones"].to_numpy(float)
    class_weight = np.stack([n / (2 * (n - ones)), n / (2 * ones)], 1)
    for _ in range(most):
        gradient, hessian = _derivatives(rows, keys, models, mean, scale, class_weight, apart)
        gradient[:, :-1] += models[:, :-1]
        hessian[:, inner, inner] += 1.0
        step = np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0]
        models = models - step
        if abs(step).max() < tolerance:
            break
    return models, mean, scale


def _derivatives(rows: DataFrame, keys: list, models: np.ndarray, mean: np.ndarray, scale: np.ndarray, class_weight: np.ndarray, apart: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of each model over all rows, ``apart`` from those of its key."""
    count, width = models.shape
    raw = np.concatenate([models[:, :-1] / scale, (models[:, -1] - (models[:, :-1] / scale * mean).sum(1))[:, None]], 1)
    number = {k: i for i, k in enumerate(keys)} if apart else {}
    shared = rows.sparkSession.sparkContext.broadcast((raw, class_weight, number))  # one row of parameters a key
    upper = np.triu_indices(width)

    def run(batches):
        raw, weight, number = shared.value
        total = np.zeros((count, width + len(upper[0])))
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width - 1)
            x = np.concatenate([x, np.ones((len(x), 1))], 1)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            own = np.array([number.get(k, -1) for k in batch.column(0).to_pylist()]) if number else np.full(len(x), -1)
            for side in (0, 1):  # a model's weight of a class goes before its sums
                of = (y > 0) == side
                rows_of, own_of = x[of], own[of]
                for at in range(0, len(rows_of), ROWS):
                    a, o = rows_of[at : at + ROWS], own_of[at : at + ROWS]
                    products = a[:, upper[0]] * a[:, upper[1]]
                    for first in range(0, count, MODELS):
                        block = slice(first, first + MODELS)
                        p = 1 / (1 + np.exp(np.minimum(-(a @ raw[block].T), 500)))
                        w = p * (1 - p)
                        p -= side
                        held = np.flatnonzero((o >= first) & (o < first + MODELS))
                        p[held, o[held] - first] = w[held, o[held] - first] = 0.0  # a model does not see its own key
                        total[block, :width] += weight[block, side, None] * (p.T @ a)
                        total[block, width:] += weight[block, side, None] * (w.T @ products)
        lists = pa.array(total.tolist(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count)), lists], ["model", "sums"])

    parts = rows.mapInArrow(run, "model bigint, sums array<double>").select("model", F.posexplode("sums").alias("place", "part"))
    sums = np.zeros((count, width + len(upper[0])))
    added = parts.groupBy("model", "place").agg(F.sum("part").alias("s")).toPandas()  # a fixed number of sums a key
    sums[added["model"], added["place"]] = added["s"]
    # from raw features to centred and scaled ones: z = T x
    change = np.zeros((count, width, width))
    inner = np.arange(width - 1)
    change[:, inner, inner] = 1 / scale
    change[:, inner, -1] = -mean / scale
    change[:, -1, -1] = 1.0
    matrix = np.zeros((count, width, width))
    matrix[:, upper[0], upper[1]] = sums[:, width:]
    matrix[:, upper[1], upper[0]] = sums[:, width:]
    return (change @ sums[:, :width, None])[:, :, 0], change @ matrix @ change.transpose(0, 2, 1)


def leave_one_out_scores(frame: DataFrame, features: Sequence[str], key: str = "ticker", label: str = "label_up", carry: Sequence[str] = ()) -> DataFrame:
    """Each row of a key scored by the model that has not seen the key. The frame is run once."""
    rows = _numbered(frame, features, key, label, [*carry, label])
    margin = F.col("intercept")
    for i in range(len(features)):
        margin = margin + F.col("weights")[i] * F.col("x")[i]
    scored = rows.join(_left_out_models(rows, features), "key")
    return scored.select(F.col("key").alias(key), *[F.col(f"_{c}").alias(c) for c in [*carry, label]], (1 / (1 + F.exp(-margin))).alias("prob"))


def leave_one_out_report(frame: DataFrame, features: Sequence[str], key: str = "ticker", label: str = "label_up", shape: Shape = DAILY) -> DataFrame:
    scored = stored(leave_one_out_scores(frame, features, key, label), "scores")
    # a key's rows are one series
    ranks = Shape(stamp_rows=shape.series_rows)
    return accuracy(scored, label, "prob", [key]).join(roc_auc(scored, label, "prob", [key], ranks).select(key, "auc"), key, "left")
