"""Importance resampling of documents towards a target corpus, with hashed n-grams from prefix CRCs.

A document is scanned once: its words, joined by one space, feed one CRC-32, whose value is stored behind each word. With
``P`` the CRC of everything before a stretch and ``Q`` that of everything up to its end, the stretch's own CRC is ``Q`` less
``P`` moved over as many zero bytes as the stretch is long; moving is linear over GF(2), so it is a few table lookups. Any
n-gram's CRC thus comes from two stored values, without reading its bytes again.

An n-gram's bucket is its CRC modulo ``buckets``. A bucket's gain is the floored, scaled log ratio of its smoothed shares in
the target and in the documents; a document's weight the floored mean of its n-grams' gains. Weights plus Gumbel noise, drawn
by a hash of the id, are ranked, and the highest are a sample without replacement in proportion to the exponential weights.

Words are runs of ASCII letters and digits and of all bytes beyond ASCII, A-Z lower-cased. Counts are over all documents and whole texts. The driver
receives ``buckets`` counts, whatever the number of rows. Null and empty texts have no n-grams and weight 0. A null id hashes
as an empty one and comes last among equal scores; repeated rows count, and are ranked, each. Empty tables give counts of 0, and an empty
documents table an empty result. Other columns are passed over.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import Chunk, chunks, fields, stored, words

BUCKETS, LONGEST = 10_000, 2
#: Bytes of the generator polynomial of CRC-32, reflected (fixed value).
POLYNOMIAL = 0xEDB88320
#: Lengths in bytes that have a table of their own; longer ones are moved by powers of two.
DIRECT = 64
BATCH = 1 << 20
_MASK = np.uint32(0xFFFFFFFF)


@functools.lru_cache(maxsize=1)
def _separators() -> np.ndarray:
    """Each byte as the scan reads it: lower-cased, a space for all that is not part of a word."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    apart = np.ones(256, bool)
    apart[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
    return np.where(apart[table], np.uint8(32), table).astype(np.uint8)


@functools.lru_cache(maxsize=1)
def _one_byte() -> np.ndarray:
    """What each low byte of a register adds when the register moves over one byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), table >> np.uint32(1)).astype(np.uint32)
    return table


def _over_one_byte(register: np.ndarray) -> np.ndarray:
    return _one_byte()[register & np.uint32(255)] ^ (register >> np.uint32(8))


def _apply(table: np.ndarray, register: np.ndarray) -> np.ndarray:
    """A linear map of registers, given by what each of their four bytes adds."""
    out = table[0, register & np.uint32(255)]
    for i in range(1, 4):
        out = out ^ table[i, (register >> np.uint32(8 * i)) & np.uint32(255)]
    return out


@functools.lru_cache(maxsize=1)
def _direct() -> np.ndarray:
    """For each length below ``DIRECT`` the map that moves a register over as many zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    maps = [np.stack([byte << np.uint32(8 * i) for i in range(4)])]
    for _ in range(DIRECT - 1):
        maps.append(_over_one_byte(maps[-1]))
    return np.stack(maps)


@functools.lru_cache(maxsize=64)
def _power(exponent: int) -> np.ndarray:
    """The map over ``2 ** exponent`` zero bytes."""
    if exponent == 0:
        return _direct()[1]
    half = _power(exponent - 1)
    return np.stack([_apply(half, half[i]) for i in range(4)])


def moved(register: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Registers moved over ``lengths`` zero bytes each."""
    out = register.astype(np.uint32)
    near = lengths < DIRECT
    tables = _direct()
    own, n = out[near], lengths[near]
    total = tables[n, 0, own & np.uint32(255)]
    for i in range(1, 4):
        total ^= tables[n, i, (own >> np.uint32(8 * i)) & np.uint32(255)]
    out[near] = total
    far = np.flatnonzero(~near)
    exponent, rest = 0, lengths[far]
    while len(far):
        odd = (rest & 1) == 1
        out[far[odd]] = _apply(_power(exponent), out[far[odd]])
        exponent, rest = exponent + 1, rest >> 1
        far, rest = far[rest > 0], rest[rest > 0]
    return out


def ngram_crcs(chunk: Chunk, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of every run of 1 to ``longest`` words, the row each is in, and the number of words of each row."""
    data = _separators()[chunk.data]
    starts, ends, bounds = words(Chunk(chunk.first, chunk.rows, data, chunk.offsets))
    numbers = np.diff(bounds)
    row = np.repeat(np.arange(chunk.rows), numbers)
    leads = np.zeros(len(starts), bool)
    leads[bounds[:-1][numbers > 0]] = True
    body, after, value = data.tobytes(), [], 0
    for start, end, lead in zip(starts.tolist(), ends.tolist(), leads.tolist(), strict=True):
        # what stands before a word that is not the text's first is a space by now
        value = zlib.crc32(body[start:end]) if lead else zlib.crc32(body[start - 1 : end], value)
        after.append(value)
    after = np.array(after, np.uint32)
    before = np.zeros(len(after), np.uint32)  # the CRC of all before the word, the joining space included
    if len(after):
        inner = np.flatnonzero(~leads)
        register = after[inner - 1] ^ _MASK
        before[inner] = _one_byte()[(register ^ np.uint32(32)) & np.uint32(255)] ^ (register >> np.uint32(8)) ^ _MASK
    reach = np.cumsum(ends - starts + 1)  # bytes of joined words and a space each
    length = ends - starts
    found, rows = [], []
    for n in range(1, longest + 1):
        count = len(starts) - n + 1
        if count <= 0:
            break
        same = np.flatnonzero(row[:count] == row[n - 1 :])
        stretch = reach[same + n - 1] - reach[same] + length[same]
        found.append(after[same + n - 1] ^ moved(before[same], stretch))
        rows.append(row[same])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found) if found else none.astype(np.uint32)), (np.concatenate(rows) if rows else none), numbers


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, text_column: str = "text") -> DataFrame:
    """``bucket, n``: how many n-grams of all texts fall into each bucket; a task adds up its own first."""
    data = texts.select(texts[text_column].cast("string").alias("text"))

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(0), BATCH):
                total += np.bincount(ngram_crcs(chunk, longest)[0] % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return data.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """The gain of each bucket: 1,000 times the log of its share in the target over its share in the documents, one added to each count."""
    found = []
    for texts in (target, documents):
        own = np.zeros(buckets, np.int64)
        for r in bucket_counts(texts, buckets, longest).collect():  # as many rows as buckets
            own[r.bucket] = r.n
        found.append(own.tolist())
    (t, s), (T, S) = found, map(sum, found)
    return np.array([math.floor(1000 * math.log(float((a + 1) * (S + buckets)) / float((b + 1) * (T + buckets)))) for a, b in zip(t, s, strict=True)], np.int64)


def weights(documents: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each document."""
    schema = "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    names = ["doc_id", "n_words", "n_features", "weight"]

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column(1), BATCH):
                crcs, row, numbers = ngram_crcs(chunk, longest)
                n = np.bincount(row, minlength=chunk.rows)
                total = np.zeros(chunk.rows, np.int64)
                np.add.at(total, row, gain[crcs % np.uint32(len(gain))])  # exact, unlike weighted counts
                weight = total // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.rows), *(pa.array(x.astype(np.int64)) for x in (numbers, n, weight))], names)

    return fields(documents, doc_id="bigint", text="string").mapInArrow(run, schema)


def gumbel(id_column: str, seed: int) -> Column:
    """1,000 times a Gumbel draw, floored, from the first 32 bits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share)))


def resample(documents: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7,
             buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """Each document's ``doc_id, n_words, n_features, weight, score, rank``; the rank is null for those that are not drawn.

    Positions come from one range exchange on the score and the id: each range is sorted by its own task, and the sizes of
    the ranges before it are added. Only ids, counts and scores are exchanged, never texts.
    """
    scored = weights(documents, gains(documents, target, buckets, longest), longest)
    scored = scored.withColumn("score", F.col("weight") + gumbel("doc_id", seed)).withColumn("able", F.col("n_words") >= least_words)
    scored = stored(scored, "scores")  # the range exchange reads its input twice, and texts are long
    # the last two only part equal scores and ids, so that copies of one row need not meet in one range
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("spread")]
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scored.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # written, so that both readings below see the same ranges
    ranged = stored(ranged.drop("spread").withColumn("at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("at", 33)
    sizes = {r.part: (r.n, r.able) for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(F.col("able").cast("int")).alias("able")).collect()}
    before, at = {}, 0
    for number in sorted(sizes):  # as many as partitions
        before[number], at = at, at + sizes[number][0]
    drawn = percent * sum(able for _, able in sizes.values()) // 100
    offsets = F.array(*[F.lit(before.get(i, 0)).cast("bigint") for i in range(parts)])
    position = F.element_at(offsets, (part + 1).cast("int")) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.select("doc_id", "n_words", "n_features", "weight", "score", F.when(position <= drawn, position).alias("rank"))
