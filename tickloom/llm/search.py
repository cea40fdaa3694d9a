"""Nearest neighbours by inner product with vantage-point trees, one for each shard.

Every row is indexed: rows are dealt to shards of about ``SHARD_ROWS`` by hash, and a shard's vectors are lifted by one
coordinate to a common norm, so the largest inner product is the smallest distance. A tree node holds a vantage point and
the radius that halves its points; a subtree is left out for a query whose best distances rule it out by the triangle
inequality. ``relax`` multiplies the bound: 1 is exact, more visits less.

Queries are a stated set, dealt in blocks to every shard: a task holds one shard and one block of at most about ``QUERY_ROWS``
queries, so its work does not grow with the table. Each gives its best for each query, and a window over those
few rows picks the best of all. Scores are inner products of the original vectors in double precision; ties go to the
smaller id. Null vectors, zero vectors, and vectors with null or non-finite components take no part, nor do rows with a
null id or of another dimension than the most frequent one. Ids are taken to be unique; of rows with equal ids each is a candidate, scored by the first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 1 << 15
#: Queries that a task answers; beyond, a shard goes to several tasks, each with a tree of its own.
QUERY_ROWS = 1 << 16
#: Fewest rows of a shard where the table is small, so that its shards are as many as cores.
LEAST_ROWS = 1 << 12
LEAF = 256
BLOCK = 1024
#: Distances are compared with this margin, as rounding may not rule a neighbour out.
SLACK = 1e-9


class Tree:
    """A vantage-point tree over the rows of one shard, kept as arrays."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 1):
        self.points, self.leaf = points, leaf
        self.order = np.arange(len(points))
        draw = np.random.default_rng(seed)
        self.root = self._build(0, len(points), draw)

    def _build(self, low: int, high: int, draw) -> tuple | None:
        """(vantage row, low, high, near, far) with each child's (subtree, least, largest distance)."""
        if high - low <= self.leaf:
            return (None, low, high, None, None)
        rows = self.order[low:high]
        vantage = int(rows[draw.integers(len(rows))])
        away = np.sqrt(np.maximum(((self.points[rows] - self.points[vantage]) ** 2).sum(1), 0))
        half = len(rows) // 2
        split = np.argpartition(away, half)
        self.order[low:high], away = rows[split], away[split]
        if away.max() == away.min():  # copies only: no distance tells them apart
            return (None, low, high, None, None)
        near = (self._build(low, low + half, draw), away[:half].min(), away[:half].max())
        far = (self._build(low + half, high, draw), away[half:].min(), away[half:].max())
        return (vantage, low, high, near, far)

    def leaves(self, queries: np.ndarray, visit, worst, relax: float) -> None:
        """Call ``visit(query rows, point rows)`` for each leaf that may hold a neighbour within ``worst()``."""
        def go(node, active):
            vantage, low, high, near, far = node
            if vantage is None:
                visit(active, self.order[low:high])
                return
            away = np.sqrt(np.maximum(((queries[active] - self.points[vantage]) ** 2).sum(1), 0))
            inside = away <= (near[2] + far[1]) / 2
            for first in (True, False):  # the nearer side first, so that the other's bound is tight
                for side, wanted in ((near, inside), (far, ~inside)) if first else ((far, inside), (near, ~inside)):
                    at = np.flatnonzero(wanted)
                    if not len(at):
                        continue
                    gap = np.maximum(side[1] - away[at], away[at] - side[2])
                    at = at[gap * relax <= worst(active[at]) + SLACK]
                    if len(at):
                        go(side[0], active[at])

        go(self.root, np.arange(len(queries)))


def nearest(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, relax: float, tree: Tree, norm: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, id and inner product of the k best of a shard for each query."""
    lifted = np.concatenate([queries, np.zeros((len(queries), 1))], 1)
    length = np.sqrt((queries**2).sum(1))
    best = np.full((len(queries), k), -np.inf)
    own = np.full((len(queries), k), np.iinfo(np.int64).max)

    def worst(at):
        # |q|^2 + R^2 - 2 q.x is the squared distance
        return np.sqrt(np.maximum(length[at] ** 2 + norm**2 - 2 * best[at, -1], 0))

    def visit(at, rows):
        for piece in range(0, len(rows), 4096):
            part = rows[piece : piece + 4096]
            scores = queries[at] @ vectors[part].T
            scores[query_ids[at][:, None] == ids[part][None, :]] = -np.inf
            found = np.concatenate([best[at], scores], 1)
            names = np.concatenate([own[at], np.broadcast_to(ids[part], scores.shape)], 1)
            order = np.lexsort((names, -found), axis=1)[:, :k]
            best[at], own[at] = np.take_along_axis(found, order, 1), np.take_along_axis(names, order, 1)

    tree.leaves(lifted, visit, worst, relax)
    row, place = np.nonzero(best > -np.inf)
    found = own[row, place]
    order = np.argsort(ids, kind="stable")
    at = order[np.searchsorted(ids[order], found)]
    score = np.zeros(len(row))
    for j in range(vectors.shape[1]):  # component by component: the same sum at any block size
        score += queries[row, j] * vectors[at, j]
    return row, found, score


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(df: DataFrame, is_query: Column, k: int = 20, relax: float = 1.0, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of each row that ``is_query`` selects among all other rows."""
    data = df.select(df[id_column].cast("bigint").alias("vec_id"), df[vector_column].cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    data = data.where(F.col("vec_id").isNotNull()).where(usable(F.col("v")))
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = data.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(squared).alias("s"), F.sum(F.col("q").cast("int")).alias("asked")).orderBy(F.desc("n"), "d").first()
    schema = "query_id bigint, vec_id bigint, score double"
    if facts is None:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    d, norm = facts.d, float(np.sqrt(facts.s))
    data = data.where(F.size("v") == d)
    # a task answers one block of the queries on one shard, and every core has one
    shards = max(-(-facts.n // shard_rows), min(df.sparkSession.sparkContext.defaultParallelism, -(-facts.n // LEAST_ROWS)))
    blocks = max(1, -(-facts.asked // query_rows))
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    own = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    points = data.select(every(blocks).alias("b"), home.alias("s"), F.lit(False).alias("asks"), "vec_id", "v")
    asked = data.where("q").select(own.alias("b"), every(shards).alias("s"), F.lit(True).alias("asks"), "vec_id", "v")
    dealt = points.union(asked).select((F.col("b") * shards + F.col("s")).cast("int").alias("shard"), "asks", "vec_id", "v")
    dealt = dealt.repartitionById(shards * blocks, F.col("shard")).sortWithinPartitions("shard", "asks", "vec_id")

    def run(batches):
        shard, ids, vectors, held, tree = None, [], [], None, None
        asking: list[tuple[np.ndarray, np.ndarray]] = []

        def answer():
            nonlocal held, tree
            if held is None:
                if not ids:
                    return None
                held = (np.concatenate(ids), np.concatenate(vectors))
                lift = np.sqrt(np.maximum(norm**2 - (held[1] ** 2).sum(1), 0))
                tree = Tree(np.concatenate([held[1], lift[:, None]], 1))
            names, queries = (np.concatenate(x) for x in zip(*asking, strict=True))
            asking.clear()
            row, found, score = nearest(*held, names, queries, k, relax, tree, norm)
            return pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

        for batch in batches:
            home, asks, name = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            matrix = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            at = 0
            while at < len(home):
                if home[at] != shard:
                    if asking and (out := answer()) is not None:
                        yield out
                    shard, ids, vectors, held, tree = home[at], [], [], None, None
                    asking.clear()
                to = at + int(np.argmax(np.append((home[at:] != shard) | (asks[at:] != asks[at]), True)))
                if not asks[at]:
                    ids.append(name[at:to])
                    vectors.append(matrix[at:to])
                    at = to
                    continue
                to = min(to, at + BLOCK)
                asking.append((name[at:to], matrix[at:to]))
                if sum(len(x) for x, _ in asking) >= BLOCK and (out := answer()) is not None:
                    yield out
                at = to
        if asking and (out := answer()) is not None:
            yield out

    best = dealt.mapInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
