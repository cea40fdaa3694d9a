"""Elastic nets of all windows in one pass: moments per window are summed in Spark, coordinate descent sees only those."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: penalties of the elastic net, on features of unit deviation
L1, L2 = 0.0005, 0.0005


def moments(rows: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """``by, gram``: sums of products of all pairs of (1, columns), row by row, of each value of ``by``.

    A task adds up its rows of a window before the exchange, so what is shuffled is tasks times windows times pairs, whatever
    the rows are. Rows with a null or non-finite column belong to no sum. Sums of raw products lose the digits by which a
    column's mean exceeds its deviation, twice.
    """
    width = len(columns) + 1
    named = rows.select(F.col(by).cast("bigint").alias("by"), F.array(F.lit(1.0), *[F.col(c).cast("double") for c in columns]).alias("x"))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            known = np.isfinite(x).all(1)
            for key in np.unique(keys[known]).tolist():
                own = x[known & (keys == key)]
                sums[key] = sums.get(key, 0.0) + own.T @ own
        for key, gram in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * gram.size, pa.int64()), pa.array(range(gram.size), pa.int32()), pa.array(gram.ravel())], ["by", "place", "value"])

    parts = named.filter(F.col("by").isNotNull()).mapInArrow(add, "by bigint, place int, value double")
    sums = parts.groupBy("by", "place").agg(F.sum("value").alias("value"))
    # a group is one matrix
    whole = sums.groupBy("by").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("gram"))
    return whole.select(F.col("by").alias(by), F.col("gram.value").alias("gram"))


def descend(square: np.ndarray, cross: np.ndarray, l1: float, l2: float, tolerance: float = 1e-12, most: int = 10_000) -> np.ndarray:
    """Weights that minimise ``w'Sw/2 - c'w + l1 |w| + l2 |w|^2 / 2`` by coordinate descent."""
    weights, steps = np.zeros(len(cross)), np.diag(square) + l2
    pull = cross.copy()  # cross less square times weights
    for _ in range(most):
        moved = 0.0
        for j in np.flatnonzero(steps > 0):
            own = pull[j] + square[j, j] * weights[j]
            to = np.sign(own) * max(abs(own) - l1, 0.0) / steps[j]
            if to != weights[j]:
                moved = max(moved, abs(to - weights[j]))
                pull -= square[:, j] * (to - weights[j])
                weights[j] = to
        if moved <= tolerance * max(1.0, np.abs(weights).max(initial=0.0)):
            break
    return weights


def elastic_nets(train: DataFrame, features: Sequence[str], label: str, by: str = "window_id", l1: float = L1, l2: float = L2) -> DataFrame:
    """``by, rows_train, intercept, weights`` of the elastic net of each window; one row a window.

    Features are centred and scaled by their deviation within the window; the weights returned are for unscaled features. A
    feature that does not vary has weight 0. The loss is half the mean squared error.
    """

    def solve(batches):
        for pdf in batches:
            out = []
            for gram in pdf["gram"]:
                gram = np.asarray(gram, float).reshape(len(features) + 2, -1)
                n = gram[0, 0]
                mean = gram[0, 1:] / n
                cov = gram[1:, 1:] / n - np.outer(mean, mean)
                own = np.diag(gram)[1:] / n
                var = np.diag(cov)[:-1]
                varies = var > 1e-14 * own[:-1]  # below is rounding
                scale = np.sqrt(np.where(varies, var, 1.0))
                square = cov[:-1, :-1] / np.outer(scale, scale) * np.outer(varies, varies)
                weights = descend(square, cov[:-1, -1] / scale * varies, l1, l2) / scale
                out.append((int(n), float(mean[-1] - weights @ mean[:-1]), weights.tolist()))
            yield pd.DataFrame({by: pdf[by], "rows_train": [x[0] for x in out], "intercept": [x[1] for x in out], "weights": [x[2] for x in out]})

    return moments(train, [*features, label], by).mapInPandas(solve, f"{by} bigint, rows_train bigint, intercept double, weights array<double>")


def scored_by_windows(rows: DataFrame, fits: DataFrame, features: Sequence[str], pairs: Sequence[tuple[int, int]], by: str = "window_id") -> DataFrame:
    """Rows of test windows with ``train_window_id`` and ``prediction``, once for each train window paired with theirs."""
    trains: dict[int, list[int]] = {}
    for train, test in pairs:
        trains.setdefault(test, []).append(train)
    # pairs of windows are an argument, so the map is as long as the caller's list
    tests = F.create_map(*[x for test, ids in trains.items() for x in (F.lit(test), F.array(*map(F.lit, ids)))])
    named = rows.filter(F.col(by).isin(*trains)).withColumn("train_window_id", F.explode(F.element_at(tests, F.col(by).cast("int"))))
    lines = fits.select(F.col(by).cast("int").alias("train_window_id"), "intercept", "weights")
    line = F.col("intercept")
    for i, c in enumerate(features):
        line = line + F.get("weights", F.lit(i)) * F.col(c)
    # one row a window
    return named.join(F.broadcast(lines), "train_window_id").withColumn("prediction", line).drop("intercept", "weights")
