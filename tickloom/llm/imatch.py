"""I-Match fingerprints with several randomised lexicons.

Terms are lower-cased words of letters and digits. The lexicon keeps terms whose document frequency, as a share of all
documents, lies in a band; frequencies are counted for each term over the whole corpus. The low end bounds the lexicon at any
corpus size: it has at most the mean number of distinct terms of a document divided by ``LOW`` terms. A text's distinct terms in the lexicon are sorted by their hash and hashed for each of
50 random subsets of the lexicon: both halves, and 16 subsets each with one term in 64, in 256 and in 1,024. A subset is an
interval of term hashes, so it is a run of the sorted terms. Sparse subsets survive edits, dense ones tell texts apart. Two
fingerprints are alike by the share of equal subsets among those where either has terms.

Only column functions are used. Terms are exploded where their text is, meet the lexicon in a hash join, and are gathered by
text again without an exchange. Null texts are empty. A text without terms in the band uses all its terms; a text without
terms has an empty fingerprint, fully alike to another such one. Rows equal in id and text count as one when the next
document is looked for, and each has its result; null ids come last; other columns are passed over; an empty table gives
an empty result. A document's terms are held in one row, the corpus's never.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.session import in_ranges
from tickloom.llm.overlaps import keyed
from tickloom.llm.text import stored

#: Least number of documents of a term, and its least and largest share of all documents.
LEAST, LOW, HIGH = 2, 2e-5, 0.1
#: Hexadecimal digits that the term hashes of a subset begin at: 16 subsets of a 64th of all hashes, 16 of a 256th, 16 of a
#: 1,024th, the rest of the lower half, and the upper half.
BOUNDS = [*(f"{4 * i:02X}" for i in range(16)), *(f"{64 + i:02X}" for i in range(16)), *(f"{5 * 256 + 4 * i:03X}" for i in range(16)), "54", "80"]
#: Terms up to which the lexicon is sent to all executors, about 100 MB there; beyond it is merged.
SENT = 3_000_000


def terms(text: Column) -> Column:
    """Distinct words of a text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """``term``, the hashes of the terms within the band."""
    # a null stands for the document itself, so that one exchange counts both
    seen = docs.select(F.explode(F.array_append(terms(F.col("text")), F.lit(None))).alias("word"))
    counts = seen.groupBy(F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("term")).agg(F.count("*").alias("df"))
    counts = stored(counts.where((F.col("df") >= LEAST) | F.col("term").isNull()), "frequencies")
    total = (counts.where("term is null").first() or (None, 0))[1]
    return counts.where(F.col("term").isNotNull() & (F.col("df") >= max(LEAST, low * total)) & (F.col("df") <= high * total)).select("term")


def _runs(band: Column) -> Column:
    """A hash of the run of the sorted ``band`` from each bound to the next, null for an empty run; terms are 16 digits long.

    A bound's mark sorts right before the terms that begin like it, so that splitting the joined terms at the marks cuts the
    runs; the next bound's digits end each.
    """
    marked = F.array_join(F.sort_array(F.concat(band, F.array(*[F.lit(f"{x}!") for x in BOUNDS]))), " ")
    runs = F.slice(F.split(marked, "!", -1), 2, len(BOUNDS))
    return F.transform(runs, lambda run: F.when(F.length(run) > 16, F.hash(run)))


def _subsets(runs: Column) -> Column:
    """The runs as subsets; the lower half is made of all runs but the last."""
    sparse, low = F.slice(runs, 1, len(BOUNDS) - 2), F.slice(runs, 1, len(BOUNDS) - 1)
    return F.concat(sparse, F.array(F.when(F.size(F.array_compact(low)) > 0, F.hash(low))), F.slice(runs, len(BOUNDS), 1))


def with_fingerprints(rows: DataFrame, lexicon: DataFrame, key: str, note: str | None = None, **texts: str) -> DataFrame:
    """``key`` and the fingerprint of each text column ``texts[name]`` as ``name``; one row for each distinct key.

    A column ``note`` that depends on the key is carried along on one of a row's terms only. A lexicon of up to ``SENT`` terms,
    which are counted, is sent to all executors.
    """
    known = lexicon.select("term", F.lit(True).alias("known"))
    known = F.broadcast(known) if lexicon.count() <= SENT else known
    sides = rows.select(key, F.col(note or key).alias("_note"), F.posexplode(F.array(*[F.col(x) for x in texts.values()])).alias("side", "text"))
    said = sides.select(key, "_note", "side", F.posexplode_outer(terms(F.col("text"))).alias("at", "word"))
    first = (F.col("side") == 0) & (F.coalesce("at", F.lit(0)) == 0)
    said = said.select(key, F.when(first, F.col("_note")).alias("_note"), "side", F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("term"))
    said = said.join(known, "term", "left").withColumn("digits", F.lpad(F.hex("term"), 16, "0"))
    # the terms outside the band are kept for texts that have no others
    side = lambda i, where: F.collect_list(F.when((F.col("side") == i) & where, F.col("digits")))
    inside = F.col("known").isNotNull()
    gathered = [side(i, w).alias(f"_{n}{i}") for i in range(len(texts)) for n, w in (("in", inside), ("out", ~inside))]
    found = said.groupBy(key).agg(F.max("_note").alias("_note"), *gathered)
    own = {name: _runs(F.when(F.size(f"_in{i}") > 0, F.col(f"_in{i}")).otherwise(F.col(f"_out{i}"))) for i, name in enumerate(texts)}
    rest = [key, F.col("_note").alias(note)] if note else [key]
    return found.select(key, "_note", *[x.alias(name) for name, x in own.items()]).select(*rest, *[_subsets(F.col(name)).alias(name) for name in own])


def written(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda x: F.coalesce(F.lpad(F.lower(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"), F.lit("-" * 8))), "")


def alike(a: Column, b: Column) -> Column:
    """Share of equal subsets among those where either side has terms; 1 where neither has any."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    either = F.size(F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    equal = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return F.when(either > 0, equal / either).otherwise(F.lit(1.0))


def next_rows(ids: DataFrame) -> DataFrame:
    """``key, n, next_key`` over distinct rows ``key, doc_id, n``: the next row by descending id, after the last the first.

    Rows are put in order by ranges of sampled ids; the first row of each range follows the last one of the range before.
    """
    rows = in_ranges(ids, [F.desc_nulls_last("doc_id"), F.desc("key")], "ids").withColumn("part", F.shiftright("_at", 33))
    heads = rows.groupBy("part").agg(F.min_by("key", "_at").alias("head"))  # as many rows as ranges
    whole = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(whole), F.first("head").over(whole.rowsBetween(Window.unboundedPreceding, 0))).alias("after"))
    rows = rows.withColumn("next", F.lead("key").over(Window.partitionBy("part").orderBy("_at")))
    return rows.join(F.broadcast(heads), "part").select("key", "n", F.coalesce("next", "after").alias("next_key"))


def edit_report(df: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its text with the second half replaced by the next document's beginning."""
    docs = keyed(df)
    band = lexicon(docs)
    ids = docs.select("key", "doc_id", F.length("text").cast("long").alias("n"))
    order = stored(next_rows(ids.distinct()), "order")
    half = F.floor(F.col("n") / 2).cast("int")
    asked = order.select(F.col("next_key").alias("key"), F.col("key").alias("own_key"), "n", half.alias("half"))
    # equal rows are one from here on, as fingerprints are those of distinct keys; both joins read the same columns, so they share one
    # exchange of texts; the own id is carried for that alone
    whole = docs.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    heads = whole.join(asked, "key").select("own_key", F.col("key").alias("next_key"), F.substr("text", F.lit(1), F.col("half")).alias("head"), F.col("doc_id").alias("next_doc_id"))
    n = F.length("text")
    edited = whole.join(heads, F.col("key") == F.col("own_key")).select(
        "key", "next_key", "next_doc_id", "doc_id", "text", F.concat(F.substr("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.col("head")).alias("changed"))
    edited = edited.withColumn("note", F.struct("next_key", "next_doc_id", F.col("doc_id").alias("own_id"), F.sha2("changed", 256).alias("edited_sha256")))
    prints = with_fingerprints(edited, band, "key", "note", own="text", other="changed")
    prints = stored(prints.select("key", "note.*", "own", "other"), "fingerprints")
    following = prints.select(F.col("key").alias("next_key"), F.col("own").alias("next_own"))
    rows = ids.join(prints, "key").join(following, "next_key")
    return rows.select("doc_id", F.col("n").alias("n_chars"), "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("other")).alias("edited_fingerprint"),
                       alike(F.col("own"), F.col("other")).alias("near_edited"), alike(F.col("own"), F.col("next_own")).alias("near_next"), "next_doc_id")
