"""Clustering of vectors around centroids, the nearest one found by the threshold algorithm.

For each dimension the centroids are listed in order of their value there. A vector enters each list at its own value and
walks outward, always to the nearer side. A centroid met in any list is compared exactly. One that no list has shown yet is
in each dimension at least as far away as the list's frontier, so the sum of the squared frontiers bounds its distance from
below: the walk stops when that sum strictly exceeds the best exact distance (an equal one could belong to a smaller number),
or when every centroid was met.

Vectors are integers, ``floor(scale * x)``; distances, sums and means are exact at any size: in 64 bits where those cannot
overflow, in Python's integers beyond. A round is one pass over the table: each task adds up its vectors by centroid, and
the driver receives the sums of ``k`` centroids, whatever the number of rows.

Vectors that are null, of another length, or hold a null or non-finite component (or one beyond 2**62 after scaling, as no
distance from it is a long) take no part. Repeated rows and shared ids count each. A null id is a row like any other, but
comes last where starting centroids are chosen by id. With fewer vectors than ``k``, each is a starting centroid; an empty
table gives an empty result. A distance or sum beyond a long is null. Other columns are passed over.
"""

from __future__ import annotations

import decimal
import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import stored

#: Rows that are compared together in a task; a bound on memory only.
BLOCK = 4096
#: Components up to this size keep sums of squares of up to 64 differences within 62 bits.
EXACT = 1 << 27
LONG = 1 << 63


class Clusters(NamedTuple):
    centroids: list[list[int]]
    sizes: list[int]
    inertias: list[int]  # of each centroid's vectors
    vectors: DataFrame  # vec_id, vector


def scaled(df: DataFrame, dims: int, scale: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vector``, the usable vectors as integers."""
    data = df.select(df[id_column].cast("bigint").alias("vec_id"), df[vector_column].cast("array<double>").alias("v"))
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float(1 << 62)))
    return data.where((F.size("v") == dims) & fits).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("vector"))


def starting_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest hashes of ``<seed>:<vec_id>``."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "vec_id", "vector").limit(k).collect()
    return [list(r.vector) for r in rows]


class SortedLists:
    """The centroids of each dimension in order of their value."""

    def __init__(self, centroids: list[list[int]], wide: bool = False):
        self.centroids = np.array(centroids, object if wide else np.int64)
        self.order = np.argsort(self.centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(self.centroids, self.order, 0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row of ``x`` and the squared distance, equal ones to the smaller number."""
        k, dims = self.centroids.shape
        label, distance = np.full(len(x), k, np.int64), np.zeros(len(x), x.dtype)
        met = np.zeros((len(x), k), bool)
        column = np.arange(dims)
        right = np.stack([np.searchsorted(self.values[:, j], x[:, j]) for j in column], 1)
        left = right - 1
        rows = np.arange(len(x))
        while len(rows):
            at, low, high = x[rows], left[rows], right[rows]
            under = at - self.values[np.maximum(low, 0), column]
            over = self.values[np.minimum(high, k - 1), column] - at
            down = (high >= k) | ((low >= 0) & (under <= over))
            frontier = np.where(down, under, over)
            # lists are left by all rows at the same step, so each still has a frontier while a centroid is unmet
            open_ = (label[rows] == k) | ((frontier * frontier).sum(1) <= distance[rows])
            rows, at, low, high, down = (a[open_] for a in (rows, at, low, high, down))
            if not len(rows):
                break
            shown = np.zeros((len(rows), k), bool)
            shown[np.arange(len(rows))[:, None], self.order[np.where(down, low, high), column]] = True
            shown &= ~met[rows]
            met[rows] |= shown
            left[rows], right[rows] = low - down, high + ~down
            row, number = np.nonzero(shown)  # numbers ascend within a row
            exact = at[row] - self.centroids[number]
            exact = (exact * exact).sum(1)
            order = np.lexsort((number, exact, row)) if exact.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], exact[i], number[i])), np.int64)
            row, number, exact = row[order], number[order], exact[order]
            first = np.append(True, row[1:] != row[:-1])[: len(row)]
            to, number, exact = rows[row[first]], number[first], exact[first]
            better = (label[to] == k) | (exact < distance[to]) | ((exact == distance[to]) & (number < label[to]))
            label[to[better]], distance[to[better]] = number[better], exact[better]
            rows = rows[~met[rows].all(1)]
        return label, distance


def _blocks(batch: pa.RecordBatch, dims: int, bound: int):
    """Id columns and integer matrices of a batch; of Python's integers where ``bound`` or a component is large."""
    for at in range(0, batch.num_rows, BLOCK):
        part = batch.slice(at, BLOCK)
        x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        wide = bound > EXACT or dims > 64 or bool(len(x)) and max(int(x.max()), -int(x.min())) > EXACT
        yield part.column(0), x.astype(object) if wide else x, wide


def _finder(centroids: list[list[int]]):
    lists = {}

    def nearest(x: np.ndarray, wide: bool):
        if wide not in lists:
            lists[wide] = SortedLists(centroids, wide)
        return lists[wide].nearest(x)

    return nearest


def _largest(centroids: list[list[int]]) -> int:
    return max(abs(x) for c in centroids for x in c)


def totals(vectors: DataFrame, centroids: list[list[int]]) -> list[tuple[int, int, list[int]]]:
    """Of each centroid: the number of its vectors, the sum of their squared distances, and their componentwise sums."""
    k, dims, bound = len(centroids), len(centroids[0]), _largest(centroids)
    number = decimal.Context(prec=38).create_decimal

    def run(batches):
        nearest = _finder(centroids)
        counts, spread, sums = [0] * k, [0] * k, [np.zeros(dims, object) for _ in range(k)]
        for batch in batches:
            for _, x, wide in _blocks(batch, dims, bound):
                label, distance = nearest(x, wide)
                for c in np.unique(label).tolist():
                    own = label == c
                    counts[c] += int(own.sum())
                    spread[c] += sum(map(int, distance[own].tolist()))
                    sums[c] += x[own].sum(0)
        used = [c for c in range(k) if counts[c]]
        rows = [[number(int(x)) for x in (counts[c], spread[c], *sums[c])] for c in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(rows, pa.list_(pa.decimal128(38, 0)))], ["cluster", "sums"])

    parts = vectors.mapInArrow(run, "cluster int, sums array<decimal(38,0)>").select("cluster", F.posexplode("sums").alias("place", "part"))
    out = [(0, 0, [0] * dims)] * k
    added = {(r.cluster, r.place): int(r.total) for r in parts.groupBy("cluster", "place").agg(F.sum("part").alias("total")).collect()}  # k * (dims + 2) rows
    for c in {c for c, _ in added}:
        out[c] = (added[c, 0], added[c, 1], [added[c, 2 + j] for j in range(dims)])
    return out


def cluster(df: DataFrame, k: int, rounds: int, dims: int, scale: int, seed: int, id_column: str = "vec_id", vector_column: str = "embedding") -> Clusters:
    """Assign and average ``rounds`` times from the starting centroids; empty centroids stay where they are."""
    vectors = stored(scaled(df, dims, scale, id_column, vector_column), "vectors")
    centroids = starting_centroids(vectors, k, seed)
    if not centroids:
        return Clusters([], [], [], vectors)
    for _ in range(rounds):
        found = totals(vectors, centroids)
        centroids = [[s // n for s in sums] if n else old for (n, _, sums), old in zip(found, centroids, strict=True)]
    found = totals(vectors, centroids)
    return Clusters(centroids, [n for n, _, _ in found], [spread for _, spread, _ in found], vectors)


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``vec_id, cluster, distance`` of each vector; the distance is null where it is beyond a long."""
    schema = "vec_id bigint, cluster int, distance bigint"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema)
    dims, bound = len(centroids[0]), _largest(centroids)

    def run(batches):
        nearest = _finder(centroids)
        for batch in batches:
            for ids, x, wide in _blocks(batch, dims, bound):
                label, distance = nearest(x, wide)
                distance = pa.array([d if d < LONG else None for d in distance.tolist()] if wide else distance, pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(label.astype(np.int32)), distance], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, schema)


def cluster_report(df: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """Each vector's cluster and distance, with the inertia of its cluster and of all, and its centroid's digest."""
    found = cluster(df, k, rounds, dims, scale, seed)
    rows = assigned(found.vectors, found.centroids)
    long = lambda x: F.lit(x if x < LONG else None).cast("bigint")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    own = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    if not found.centroids:
        return rows.select("*", *[F.lit(0).cast("bigint").alias(n) for n in ("cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    return rows.select("*", own([long(x) for x in found.inertias]).alias("cluster_inertia"), long(sum(found.inertias)).alias("inertia"),
                       own([F.lit(d) for d in digests]).alias("centroid_sha256"))
