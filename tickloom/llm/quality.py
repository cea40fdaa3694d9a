"""Quality scores by a support vector machine on n-grams scaled with naive Bayes log-count ratios.

A text is the set of its byte trigrams, words and word pairs (all pairs of equal words are one), hashed into ``BUCKETS`` buckets. Each present bucket has the
value of its smoothed log-count ratio between good and bad texts; a linear model with hinge loss is fitted on these by dual
coordinate descent, and a logistic curve on rows left out of the fit turns margins into scores from 0 to 1.

The model is fitted in one task, texts are read and cut in all, on at most ``SAMPLE`` labelled rows, those with the smallest hashes of their ids, a bound
whatever the size of the corpus; scoring reads every text whole. Null and empty texts get the score of a text without
n-grams. Labels other than 0 and 1 are left out, rows labelled twice count twice. Without labelled rows every score is
0.5; with one class only, every score is that class.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tickloom.llm.text import Chunk, chunks, fields, mix, word_hashes, words

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: Most labelled rows that a model is fitted on.
SAMPLE = 8000
FOLDS = 5
THRESHOLD = 0.3
_U = np.uint64


class Model(NamedTuple):
    weights: np.ndarray  # float32, ratio times coefficient for each bucket
    bias: float
    slope: float
    shift: float

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -40, 40)))


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> _U(64 - BUCKET_BITS)).astype(np.int64)


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each distinct n-gram of the texts of a chunk, in order of rows."""
    data, offsets = chunk.data.astype(_U), chunk.offsets
    found = []
    if len(data) > 2:
        grams = data[:-2] | data[1:-1] << _U(8) | data[2:] << _U(16)
        row = np.repeat(np.arange(chunk.rows), np.diff(offsets))
        within = row[:-2] == row[2:]
        found.append(row[:-2][within] << BUCKET_BITS | _buckets(grams[within]))
    starts, ends, bounds = words(chunk)
    if len(starts):
        hashes = word_hashes(chunk.data, starts, ends)
        row = np.repeat(np.arange(chunk.rows), np.diff(bounds))
        found.append(row << BUCKET_BITS | _buckets(hashes))
        within = row[:-1] == row[1:]
        pairs = hashes[:-1] * _U(0x9E3779B97F4A7C15) + hashes[1:]
        same = hashes[:-1] == hashes[1:]  # a word said twice is one pair, whatever the word; said three times another
        pairs[same] = _U(1)
        pairs[1:][same[1:] & same[:-1]] = _U(2)
        found.append(row[:-1][within] << BUCKET_BITS | _buckets(pairs[within]))
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys >> BUCKET_BITS, keys & (BUCKETS - 1)


def _unit(rows: list[np.ndarray], ratio: np.ndarray) -> list[np.ndarray]:
    values = [ratio[x] for x in rows]
    return [v / max(np.sqrt((v * v).sum()), 1e-9) for v in values]


def descend(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; ``cost`` bounds each row's multiplier."""
    weights, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([(v * v).sum() + 1 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = signs[i] * (weights[x] @ v + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                weights[x] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights, bias


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve of labels over margins, by Newton steps on smoothed targets."""
    good, bad = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    at = np.array([1.0, 0.0])
    design = np.stack([margins, np.ones(len(margins))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, design.T @ (target - p) - 1e-3 * (at - [1, 0]))
        at += np.clip(step, -5, 5)
        if abs(step).max() < 1e-6:
            break
    return float(max(at[0], 1e-3)), float(at[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 20) -> Model:
    """Fit on bucket lists with labels 0 and 1."""
    nothing = np.zeros(BUCKETS, np.float32)
    if len(set(labels.tolist())) < 2:
        return Model(nothing, 0.0, 1.0, 0.0 if not len(labels) else 40.0 * (2 * float(labels[0]) - 1))
    counts = np.ones((2, BUCKETS))
    for x, label in zip(rows, labels, strict=True):
        counts[label, x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = _unit(rows, ratio)
    signs = 2.0 * labels - 1
    share = np.where(labels == 1, labels.mean(), 1 - labels.mean())
    limit = cost * np.minimum(0.5 / share, 10)  # both classes weigh the same
    left_out = np.arange(len(rows)) % 4 == 3
    if len(set(labels[left_out].tolist())) < 2 or len(set(labels[~left_out].tolist())) < 2:
        left_out[:] = True  # too few rows to keep some apart
        inner = np.arange(len(rows))
    else:
        inner = np.flatnonzero(~left_out)
    weights, bias = descend([rows[i] for i in inner], [values[i] for i in inner], signs[inner], limit[inner], epochs)
    margins = np.array([weights[rows[i]] @ values[i] + bias for i in np.flatnonzero(left_out)])
    slope, shift = _logistic(margins, labels[left_out])
    return Model(np.stack([weights, ratio], 1).astype(np.float32), float(bias), slope, shift)


def margins(chunk: Chunk, model: Model) -> np.ndarray:
    if model.weights.ndim == 1:
        return np.zeros(chunk.rows)
    row, bucket = features(chunk)
    picked = model.weights[bucket].astype(np.float64)
    dot = np.bincount(row, picked[:, 0] * picked[:, 1], chunk.rows)
    norm = np.sqrt(np.bincount(row, picked[:, 1] ** 2, chunk.rows))
    return dot / np.maximum(norm, 1e-9) + model.bias


def held_out(id_column: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == 0


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` of the labelled documents that are not held out."""
    known = fields(labels, doc_id="bigint", quality="int").where(F.col("quality").isin(0, 1) & ~held_out())
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)  # bounded, so it may be broadcast
    chosen = fields(documents, doc_id="bigint", text="string").join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality")

    def extract(batches):
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                row, bucket = features(chunk)
                offsets = np.searchsorted(row, np.arange(chunk.rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(chunk.first, chunk.rows) for i in (0, 2)), lists], ["doc_id", "quality", "buckets"])

    def learn(batches):
        held = [(i, q, b) for batch in batches for i, q, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lists(batch.column(2)), strict=True)]
        held.sort(key=lambda x: (x[0], x[1], len(x[2]), x[2].tobytes()))
        held = [held[i] for i in np.random.default_rng(3).permutation(len(held))]
        model = fit([b for _, _, b in held], np.array([q for _, q, _ in held], np.int64))
        row = [model.weights.tobytes(), model.weights.ndim, model.bias, model.slope, model.shift]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["weights", "kinds", "bias", "slope", "shift"])

    # an exchange, so that texts are read and cut by as many tasks as the table has; only the bounded sample's lists go to one
    rows = chosen.mapInArrow(extract, "doc_id bigint, quality int, buckets array<int>").repartition(1)
    found = rows.mapInArrow(learn, "weights binary, kinds bigint, bias double, slope double, shift double").first()
    if found is None:
        return fit([], np.zeros(0, np.int64))
    weights = np.frombuffer(found.weights, np.float32)
    return Model(weights if found.kinds == 1 else weights.reshape(-1, 2), found.bias, found.slope, found.shift)


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(column) else []


def with_scores(df: DataFrame, model: Model, name: str = "score", text_column: str = "text") -> DataFrame:
    """``df`` with a score from 0 to 1; every other column is kept as it is."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2 MB, fixed by the number of buckets
    if name in df.columns:
        raise ValueError(f"the table already has a column {name}")
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])
    place = df.columns.index(text_column)

    def run(batches):
        for batch in batches:
            column = batch.column(place).cast(pa.string())
            score = [shared.value.scores(margins(chunk, shared.value)) for chunk in chunks(column)]
            score = pa.array(np.concatenate(score) if score else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    model = train(documents, labels)
    scored = with_scores(fields(documents, doc_id="bigint", text="string"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
