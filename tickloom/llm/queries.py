"""The dealt operators as queries over the given tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, centroids, chat, extraction, imatch, importance, neardup, packing, pieces, quality, search, spans, suffixes

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def register(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


@register
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))


@register
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.token_digests(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))


@register
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register
def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one that quotes the template's own marks."""
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    quoting = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.format_turns(chat.canonical_turns(rows.unionByName(quoting))))


@register
def op10_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLES["op4_chat"] = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
written AS (
    SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS body,
           CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
                ELSE '@' || replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c') END AS head
    FROM said)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(head) + 2 + length(body) + 8) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id"""

ORACLES["op10_search"] = """
WITH usable AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
    FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 20"""


@register
def op8_spans(spark: SparkSession, folder: str) -> DataFrame:
    return spans.span_report(table(spark, folder, "documents"))


@register
def op1_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.byte_report(table(spark, folder, "documents"))


@register
def op3_neardup(spark: SparkSession, folder: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, folder, "documents"), size=4, over=80, under=100)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@register
def op6_html(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(table(spark, folder, "pages"))


@register
def op7_imatch(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.edit_report(table(spark, folder, "documents"))


@register
def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster_report(table(spark, folder, "embeddings"))


@register
def op12_importance(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@register
def op13_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.token_digests(table(spark, folder, "documents"), public_tokenizers.path(PIECE_BPE))


def _kmeans_sql(k: int = 8, rounds: int = 10) -> str:
    """Each round as two tables: the nearest centroid of every vector, and the floored means."""
    steps = [f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS n, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(1024 * x) AS HUGEINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), vec_id, v) - 1 AS c, v FROM kept ORDER BY c LIMIT {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
    SELECT n, vec_id, min({{'d': d, 'c': c}}) AS best FROM (
        SELECT n, vec_id, c, list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{i})
    GROUP BY n, vec_id)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (
    SELECT best.c AS c, j, CAST(sum(v[j]) AS HUGEINT) AS total, count(*) AS m FROM a{i} JOIN kept USING (n), range(1, 65) AS r(j) GROUP BY 1, 2),
m{i} AS (
    SELECT c, list((total - ((total % m) + m) % m) // m ORDER BY j) AS v FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (
    SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))""")
    return ",".join(steps) + f"""
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = best.c"""


ORACLES["op11_centroids"] = _kmeans_sql()

ORACLES["op12_importance"] = r"""
WITH steps AS (
    SELECT list(CAST(list_reduce(list_prepend(b, range(0, 8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END) AS BIGINT) ORDER BY b) AS step
    FROM range(0, 256) AS bytes(b)),
texts AS (
    SELECT doc_id, 0 AS target, text FROM documents UNION ALL SELECT NULL, 1, text FROM benchmark),
split AS (
    SELECT row_number() OVER () AS n, doc_id, target,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
sized AS (SELECT *, len(w) AS n_words FROM split),
said AS (
    SELECT n, target, unnest(list_concat(w, list_transform(range(1, n_words), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM sized),
grams AS MATERIALIZED (SELECT n, target, f, count(*) AS m FROM said GROUP BY ALL),
hashed AS MATERIALIZED (
    SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT))),
                  lambda v, b: xor(v // 256, step[xor(v % 256, b) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM grams)), steps),
placed AS MATERIALIZED (SELECT n, target, bucket, CAST(sum(m) AS BIGINT) AS m FROM grams JOIN hashed USING (f) GROUP BY ALL),
counts AS (
    SELECT bucket, coalesce(sum(m) FILTER (target = 0), 0) AS s, coalesce(sum(m) FILTER (target = 1), 0) AS t FROM placed GROUP BY bucket),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE) / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM counts),
weighed AS (
    SELECT n, CAST(sum(m) AS BIGINT) AS n_features, CAST(sum(m * gain) AS BIGINT) AS total FROM placed JOIN gains USING (bucket) WHERE target = 0 GROUP BY n),
scored AS (
    SELECT n, doc_id, n_words, coalesce(n_features, 0) AS n_features,
           CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
           CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS noise
    FROM sized LEFT JOIN weighed USING (n) WHERE target = 0),
ranked AS (
    SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) AS place, sum(CASE WHEN n_words >= 20 THEN 1 ELSE 0 END) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END AS rank FROM ranked"""
