"""Near-duplicates by a chosen-path set similarity join over word shingles.

Documents with equal shingle sets are one class. Each of ``TREES`` independent trees sends a class to the node of its
minwise token; nodes with more than ``NODE`` classes branch again by the next token, up to ``LEVELS`` times. Classes of a
node are compared exhaustively by minwise sketches, and what may be similar is connected. Candidate clusters (connected
components, by star contractions in Spark) get their whole shingle sets, on which every link is confirmed or refused; a
cluster is searched breadth first, so sets already connected are not compared again. Clusters of more than ``BLOCK`` bytes
are cut into blocks, each confirmed in its own task; then one set of each component found, then the sets outside a
cluster's largest component against all its others, a pair of blocks in a task. Full nodes are cut into pairs of blocks too.

A pair of similarity s shares a node of one level with probability ``1 - (1 - s) ** TREES``: a miss in 10**14 at 0.8; at
the deepest level 1 in 10**6, and the sketch passes all but 1 in 10**5. Texts are lower-cased from A to Z; words are
``[^\\x20\\x09-\\x0D]+``. Texts with fewer words than a shingle have one shingle of all words; null, empty and blank texts
have none and are linked with nothing. Null ids come first; rows equal in id and text share their result; other columns
are passed over; an empty table gives an empty result. Nothing is capped: a node of the deepest level is compared whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.overlaps import key_array, keyed
from tickloom.llm.text import Chunk, chunks, lower_ascii, mix, stored, word_hashes, words

TREES = 20
LEVELS = 3
NODE = 512
SKETCH = 128
#: Largest table of bits that a cluster's search holds; beyond it posting lists are counted.
BITS = 1 << 27
#: Bytes of sets in a block of a cluster, and classes in a block of a node; a task holds two blocks of a group at once.
BLOCK = 1 << 26
CLASSES = 1 << 15
_U = np.uint64
_DRAW = np.random.default_rng(20240229).integers(0, 1 << 63, (2, SKETCH), np.int64).astype(_U)
_XOR, _TIMES = mix(_DRAW[0]), mix(_DRAW[1]) | _U(1)


def shingles(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts of a chunk, sorted within a text, and where each text's begin (with the end)."""
    chunk = chunk._replace(data=lower_ascii(chunk.data))
    starts, ends, bounds = words(chunk)
    hashes = word_hashes(chunk.data, starts, ends)
    grams = np.full(max(len(hashes) - size + 1, 0), size, _U)
    for j in range(size):
        grams = mix(grams * _U(0x9E3779B97F4A7C15) ^ hashes[j : j + len(grams)])
    sets = []
    for a, b in itertools.pairwise(bounds.tolist()):
        if b - a >= size:
            sets.append(np.unique(grams[a : b - size + 1]))
        else:
            whole = np.full(1 if b > a else 0, b - a, _U)
            for x in hashes[a:b]:
                whole = mix(whole * _U(0x9E3779B97F4A7C15) ^ x)
            sets.append(whole)
    flat = np.concatenate(sets) if sets else np.zeros(0, _U)
    return flat, np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """For each row: ``key, doc_id, n``, two hashes of the shingle set, the trees' tokens and the sketch."""
    names = ["key", "doc_id", "n", "s1", "s2", "tokens", "sketch"]

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                flat, bounds = shingles(chunk, size)
                numbers = np.diff(bounds)
                full = np.flatnonzero(numbers)
                lows = np.zeros((chunk.rows, SKETCH), _U)
                sums = np.zeros((chunk.rows, 2), _U)
                if len(full):
                    begin = bounds[:-1][full]
                    for k in range(SKETCH):
                        lows[full, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _TIMES[k], begin)
                    for k in range(2):
                        sums[full, k] = np.add.reduceat(mix(flat ^ _TIMES[k]), begin)
                tokens = lows[:, : TREES * LEVELS].copy().view(np.int64).ravel()
                tokens = pa.ListArray.from_arrays(pa.array(np.arange(chunk.rows + 1, dtype=np.int32) * TREES * LEVELS), pa.array(tokens))
                bytes_ = mix(lows).astype(np.uint8)
                own = [pa.array(x.copy().view(np.int64)) for x in (sums[:, 0], sums[:, 1])]
                sketch = pa.array([x.tobytes() for x in bytes_], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(chunk.first, chunk.rows) for i in (0, 1)), pa.array(numbers), *own, tokens, sketch], names)

    return docs.select("key", "doc_id", "text").mapInArrow(run, "key bigint, doc_id bigint, n bigint, s1 bigint, s2 bigint, tokens array<bigint>, sketch binary")


def nodes(classes: DataFrame, node: int = NODE) -> DataFrame:
    """``path, key, size``: the leaves of all trees with two classes or more."""
    levels = [F.element_at("tokens", F.col("tree") * LEVELS + level + 1).alias(f"t{level}") for level in range(LEVELS)]
    rows = classes.select("key", "tokens", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select("key", F.xxhash64("tree", levels[0]).alias("path"), *levels[1:])
    for level in range(1, LEVELS + 1):
        sizes = rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        rows = rows.join(sizes, "path")
        if level < LEVELS:
            branched = F.when(F.col("size") > node, F.xxhash64("path", f"t{level}")).otherwise(F.col("path"))
            rows = stored(rows.select("key", branched.alias("path"), *[f"t{k}" for k in range(level + 1, LEVELS)], "size"), "nodes")
            if (rows.agg(F.max("size")).first()[0] or 0) <= node:
                break  # nothing branched, so the sizes hold
            rows = rows.drop("size")
    return rows.select("path", "key", "size")


def components(n: int, similar: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[tuple[int, int]]]:
    """Component of each of n items and the links found; ``similar(item, others)`` tells which others are linked to it."""
    label, links = [-1] * n, []
    waiting = np.arange(n)
    while len(waiting):
        root = int(waiting[0])
        label[root] = root
        waiting, frontier = waiting[1:], [root]
        while frontier and len(waiting):
            item = frontier.pop()
            hit = similar(item, waiting)
            for other in waiting[hit].tolist():
                label[other] = root
                links.append((item, other))
                frontier.append(other)
            waiting = waiting[~hit]
    return label, links


def _grouped(batches, column: int):
    """For a partition sorted by ``column``: tables of whole groups and the bounds of their groups, one batch and group at a time."""
    held: list[pa.RecordBatch] = []

    def flush(last: list[pa.RecordBatch]):
        table = pa.Table.from_batches([*held, *last]).combine_chunks()
        names = table.column(column).to_numpy()
        edge = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]]).tolist()
        return table, list(itertools.pairwise(edge))

    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(column).to_numpy()
        cut = int(np.searchsorted(names, names[-1]))
        if cut or (held and held[-1].column(column)[0].as_py() != names[0]):
            if held or cut:
                yield flush([batch.slice(0, cut)] if cut else [])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield flush([])


def _by(rows: DataFrame, unit: str) -> DataFrame:
    return rows.repartition(unit).sortWithinPartitions(unit)


def candidate_links(leaves: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links that connect the classes of each node whose sketches leave the similarity possible."""
    least = int(np.floor(SKETCH * (similarity - 4.5 * np.sqrt(similarity * (1 - similarity) / SKETCH))))

    def compare(batches):
        for table, groups in _grouped(batches, 0):
            keys = table.column(1).to_numpy()
            sketch = np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint8).reshape(-1, SKETCH)
            left, right = [], []
            for a, b in groups:
                if b - a == 2:
                    if np.count_nonzero(sketch[a] == sketch[a + 1]) >= least:
                        left.append(keys[a])
                        right.append(keys[a + 1])
                    continue
                own = sketch[a:b]
                for x, y in components(b - a, lambda i, others, own=own: np.count_nonzero(own[others] == own[i], axis=1) >= least)[1]:
                    left.append(keys[a + x])
                    right.append(keys[a + y])
            pair = np.sort(np.array([left, right], np.int64), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    # a class of a full node meets each other block of it; its own block is in each of those pairs
    cut = leaves.withColumn("blocks", F.ceil(F.col("size") / CLASSES)).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    pair = lambda other: F.xxhash64("path", F.least("block", other), F.greatest("block", other))
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda other: other != F.col("block"))
    units = cut.select(F.explode(F.when(F.col("blocks") > 1, F.transform(others, pair)).otherwise(F.array("path"))).alias("path"), "key")
    rows = units.join(classes.select("key", "sketch"), "key").select("path", "key", "sketch")
    found = _by(rows, "path").mapInArrow(compare, "a bigint, b bigint")
    return found.where("a < b").distinct()


def connected(links: DataFrame) -> DataFrame:
    """``key, root`` of all ends of links ``a, b``, by alternating large and small stars until nothing changes."""
    links = stored(links.select("a", "b"), "links")
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every link now points from the larger end to the smaller
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = stored(small.where("a <> b").distinct().select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links")
        facts = [x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for x in (links, after)]
        links = after
        if facts[0] == facts[1]:
            break
    pairs = links.groupBy(F.col("b").alias("key")).agg(F.min("a").alias("root"))
    return pairs.union(pairs.select(F.col("root").alias("key"), "root").distinct())


def _bits(tokens: np.ndarray, owner: np.ndarray, n: int, kinds: int) -> np.ndarray:
    width = -(-kinds // 64) * 64
    table = np.zeros((n, width // 8), np.uint8)
    np.bitwise_or.at(table, (owner, tokens >> 3), (1 << (tokens & 7)).astype(np.uint8))
    return table.view(_U)


def confirm(sets: list[np.ndarray], over: int, under: int, known: np.ndarray | None = None) -> list[int]:
    """Component of each set by links with ``under * intersection >= over * union``; sets with equal ``known`` are linked already."""
    n = len(sets)
    known = np.arange(n) if known is None else known
    sizes = np.array([len(x) for x in sets], np.int64)
    linked = lambda common, a, b: under * common >= over * (a + b - common)
    if n == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        return [0, 0] if known[0] == known[1] or linked(common, *sizes) else [0, 1]
    owner = np.repeat(np.arange(n), sizes)
    kinds, token, number = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = number > 1  # what one set alone has is in no intersection
    rename = np.cumsum(shared) - 1
    inside = shared[token]
    token, owner = rename[token[inside]], owner[inside]
    if n * (int(shared.sum()) // 8 + 8) <= BITS:
        bits = _bits(token, owner, n, max(int(shared.sum()), 1))
        common_with = lambda i, others: np.bitwise_count(bits[others] & bits[i]).sum(1, dtype=np.int64)
    else:
        order = np.argsort(token, kind="stable")
        post, begin = owner[order], np.searchsorted(token[order], np.arange(int(shared.sum()) + 1))
        first = np.searchsorted(owner, np.arange(n + 1))

        def common_with(i, others):
            total = np.zeros(n, np.int64)
            for t in token[first[i] : first[i + 1]]:
                total[post[begin[t] : begin[t + 1]]] += 1
            return total[others]

    return components(n, lambda i, others: (known[others] == known[i]) | linked(common_with(i, others), sizes[i], sizes[others]))[0]


def in_blocks(sets: DataFrame, over: int, under: int) -> DataFrame:
    """``key, component, head`` of clusters ``root, blocks, key, doc_id, grams`` that are too large for one task."""
    def compare(batches):
        for table, groups in _grouped(batches, 0):
            keys, known, grams = table.column(1).to_numpy(), table.column(2).to_numpy(), table.column(3)
            left, right = [], []
            for a, b in groups:
                if (known[a:b] == known[a]).all():
                    continue
                for i, first in enumerate(confirm([np.frombuffer(grams[i].as_py(), _U) for i in range(a, b)], over, under, known[a:b])):
                    left.append(keys[a + first])
                    right.append(keys[a + i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    def links(rows: DataFrame) -> DataFrame:
        """Links found among rows ``unit, key, known, grams``."""
        return stored(_by(rows, "unit").mapInArrow(compare, "a bigint, b bigint").where("a <> b").distinct(), "found")

    def labelled(found: DataFrame) -> DataFrame:
        joined = stored(connected(found), "joined").withColumnRenamed("root", "label")
        return sets.join(joined, "key", "left").withColumn("label", F.coalesce("label", "key"))

    sized = F.ceil(F.sum(F.length("grams")) / BLOCK)
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    found = links(sets.select(F.xxhash64("root", block).alias("unit"), "key", F.col("key").alias("known"), "grams"))
    before, salt = sets.count(), 0
    while True:  # one set of each component, dealt anew, as long as that halves them
        first = labelled(found).where("key = label").select("root", "key", "grams")
        parts = first.groupBy("root").agg(sized.alias("parts"), F.count("*").alias("size")).where("size > 1")
        left = stored(first.join(parts, "root"), "first")
        most, number = left.agg(F.max("parts"), F.count("*")).first()
        if not number or 2 * number > before:
            break
        before, salt = number, salt + 1
        unit = F.xxhash64("root", F.pmod(F.xxhash64("key", F.lit(salt)), F.col("parts")))
        found = found.union(links(left.select(unit.alias("unit"), "key", F.col("key").alias("known"), "grams")))
        if most == 1:
            break
    # of sets in different components one at least is outside the largest
    now = stored(labelled(found), "labelled")
    largest = now.groupBy("root", "label").agg(F.count("*").alias("size")).groupBy("root").agg(F.max_by("label", F.struct("size", "label")).alias("largest"))
    outside = now.join(largest, "root").where("label <> largest")
    parts = outside.groupBy("root").agg(sized.alias("parts"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    every = now.join(parts, "root").withColumn("part", numbers(F.col("parts"))).withColumn("block", block)
    some = outside.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("key", F.lit(-1)), F.col("parts"))).withColumn("block", numbers(F.col("blocks")))
    pairs = [x.select(F.xxhash64("root", "part", "block").alias("unit"), "key", F.col("label").alias("known"), "grams") for x in (every, some)]
    done = stored(labelled(found.union(links(pairs[0].union(pairs[1])))).select("key", "doc_id", "label"), "labelled")
    heads = done.groupBy("label").agg(F.min(F.struct("doc_id", "key")).alias("head"))
    return done.join(heads, "label").select("key", F.col("head.doc_id").alias("component"), F.col("head.key").alias("head"))


def confirmed(docs: DataFrame, clusters: DataFrame, numbers: DataFrame, size: int, over: int, under: int) -> DataFrame:
    """``key, component, head``: of classes in a candidate cluster, the smallest id of their true component and the key it comes with.

    ``numbers`` has the number of shingles ``n`` of each ``key``.
    """
    names = ["root", "blocks", "key", "doc_id", "grams"]

    def whole(batches):
        last = None
        for batch in batches:
            keys = key_array(batch.column(2))
            if not len(keys):
                continue
            head = np.concatenate([[last is None or keys[0] != last], keys[1:] != keys[:-1]])  # equal rows stand together: one is enough
            last, batch = keys[-1], batch.filter(pa.array(head))
            for chunk in chunks(batch.column(4)):
                flat, bounds = shingles(chunk, size)
                blobs = pa.array([flat[a:b].tobytes() for a, b in itertools.pairwise(bounds.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(chunk.first, chunk.rows) for i in range(4)), blobs], names)

    def check(batches):
        for table, groups in _grouped(batches, 0):
            keys, ids, grams = table.column(2).to_numpy(), table.column(3).to_pylist(), table.column(4)
            found, names, heads = [], [], []
            for a, b in groups:
                order = sorted(range(a, b), key=lambda i: (ids[i] is not None, ids[i] or 0, keys[i]))
                label = confirm([np.frombuffer(grams[i].as_py(), _U) for i in order], over, under)
                for i, root in zip(order, label, strict=True):
                    found.append(keys[i])
                    names.append(ids[order[root]])
                    heads.append(keys[order[root]])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (found, names, heads)], ["key", "component", "head"])

    placed = clusters.join(numbers.select("key", "n"), "key")
    blocks = placed.groupBy("root").agg(F.ceil(F.sum("n") * 8 / BLOCK).alias("blocks"))
    placed = stored(placed.join(blocks, "root").select("key", "root", "blocks"), "placed")
    most = placed.agg(F.max("blocks")).first()[0] or 0

    def sets(part: DataFrame) -> DataFrame:
        # merged at any size: which texts are in clusters grows with the corpus
        rows = docs.join(part.hint("merge"), "key").select("root", "blocks", "key", "doc_id", "text")
        return rows.mapInArrow(whole, "root bigint, blocks bigint, key bigint, doc_id bigint, grams binary")

    small = _by(sets(placed.where("blocks = 1")), "root").mapInArrow(check, "key bigint, component bigint, head bigint").distinct()
    if most <= 1:
        return small
    return small.union(in_blocks(stored(sets(placed.where("blocks > 1")).dropDuplicates(["key"]), "sets"), over, under))


def _components(docs: DataFrame, size: int, over: int, under: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows; and for each class of equal sets ``s1, s2, component_id`` and ``head``, the key of its component's first row."""
    drawn = stored(sketches(docs, size), "sketches")
    place = F.struct("doc_id", "key")
    classes = drawn.where("n > 0").groupBy("s1", "s2").agg(F.min(place).alias("head"), F.min_by(F.struct("n", "tokens", "sketch"), place).alias("own"))
    classes = stored(classes.select("s1", "s2", F.col("head.key").alias("key"), F.col("head.doc_id").alias("first_id"), "own.n", "own.tokens", "own.sketch"), "classes")
    links = candidate_links(nodes(classes), classes, over / under)
    truth = confirmed(docs, connected(links), classes, size, over, under)
    heads = classes.select("s1", "s2", "key", "first_id").join(truth, "key", "left")
    # classes without a link are components of their own; a component's id may be null, its head is not
    alone = F.col("head").isNull()
    return drawn, heads.select("s1", "s2", F.when(alone, F.col("first_id")).otherwise(F.col("component")).alias("component_id"), F.coalesce("head", "key").alias("head"))


def near_duplicates(df: DataFrame, size: int = 5, over: int = 80, under: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``key, doc_id, n_shingles, component_id, kept`` of each row; linked are sets of similarity ``over / under`` or more."""
    drawn, heads = _components(keyed(df, id_column, text_column), size, over, under)
    heads = heads.drop("head")
    rows = drawn.select("key", "doc_id", "n", "s1", "s2").join(heads, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("key", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def without_near_duplicates(df: DataFrame, size: int = 5, over: int = 80, under: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: one row of each group of near-duplicates, with all columns.

    A group is known by the key of its first row, as ids may be shared or null; of rows with that key, which are equal in id
    and text, one stays. Texts without words are linked with nothing, so all of them stay.
    """
    keep = _components(keyed(df, id_column, text_column), size, over, under)[1].select(F.col("head").alias("_key")).distinct()
    worded = F.coalesce(df[text_column].cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    key = F.xxhash64(df[id_column].cast("bigint"), F.coalesce(df[text_column].cast("string"), F.lit("")))
    order = F.xxhash64(*[df[name] for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind])
    # copies are told within each task first, so many copies of a row do not meet in one
    row = df.where(worded).select(key.alias("_key"), order.alias("_order"), F.struct(*[df[c] for c in df.columns]).alias("_row"))
    once = row.groupBy("_key").agg(F.min_by("_row", "_order").alias("_row")).join(keep, "_key", "left_semi").select("_row.*")
    return once.union(df.where(~worded))
