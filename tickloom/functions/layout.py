"""Window layouts.

A row window sorts one whole group inside one task. That is right while a group is known to be small (a daily
series has one row per calendar day) and wrong when one instrument, one timestamp or one score value may hold a
large part of all rows. Every operator therefore states a :class:`Shape`; groups with a proven bound take a plain
window (one shuffle), all others a two-level plan:

* :func:`over_series` cuts a series into blocks of consecutive rows and copies the few rows a frame looks back (or
  ahead) at into the neighbouring block, so bounded frames stay exact;
* :func:`running` aggregates per time bucket first, carries the prefix over the buckets (a small table) and adds
  the within-bucket window, so unbounded frames stay exact;
* :func:`cumulated` cuts the whole table into ranges of group and value with one exchange on sampled splitters and
  carries the sums of groups that several ranges share; :func:`value_ranks` uses it on counts per distinct value;
* :func:`placed` ranks the same rows by one column after another: where ranges end is fixed beforehand, so a column costs
  one exchange and nothing is written.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.session import in_ranges

#: rows a single window task may have to sort
TASK_ROWS = 2_000_000
#: rows a range of :func:`placed` is meant to have
RANGE_ROWS = 250_000


@dataclass(frozen=True)
class Shape:
    """Proven upper bounds on group sizes; ``None`` means unknown and selects the two-level plan."""

    series_rows: int | None = None
    stamp_rows: int | None = None

    def series_fits(self) -> bool:
        return self.series_rows is not None and self.series_rows <= TASK_ROWS

    def stamp_fits(self) -> bool:
        return self.stamp_rows is not None and self.stamp_rows <= TASK_ROWS


#: one row per series and calendar day: a century is 36,525 rows
DAILY = Shape(series_rows=40_000)
#: a table of one row per calendar day; safe as a single window partition
CALENDAR = Shape(series_rows=40_000, stamp_rows=1)
UNKNOWN = Shape()


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def _bucket(order: Sequence[str], bucket: Column | None) -> Column:
    return F.to_date(F.col(order[0])) if bucket is None else bucket


def positions(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    name: str = "pos",
    shape: Shape = UNKNOWN,
    bucket: Column | None = None,
) -> DataFrame:
    """Exact 1-based row number inside each series."""
    if shape.series_fits():
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    tagged = df.withColumn("_tb", _bucket(order, bucket))
    counts = tagged.groupBy(*key, "_tb").agg(F.count(F.lit(1)).alias("_n"))
    prior = Window.partitionBy(*key).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*key, "_tb", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*key, "_tb").orderBy(*order)
    return (
        _join_null_safe(tagged, offsets, [*key, "_tb"])
        .withColumn(name, F.col("_off") + F.row_number().over(inner))
        .drop("_off", "_tb")
    )


def blocks(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    before: int,
    after: int,
    rows: int = 500_000,
    bucket: Column | None = None,
) -> DataFrame:
    """Cut each series into blocks of ``rows`` rows; rows a neighbour's frame needs are copied with ``_core`` false."""
    size = max(rows, before, after, 1)
    placed = positions(df, key, order, "_pos", UNKNOWN, bucket)
    block = F.floor((F.col("_pos") - 1) / F.lit(size)).cast("long")
    offset = (F.col("_pos") - 1) % F.lit(size)
    targets = [F.struct(block.alias("_block"), F.lit(True).alias("_core"))]
    if before > 0:
        targets.append(
            F.when(offset >= size - before, F.struct((block + 1).alias("_block"), F.lit(False).alias("_core")))
        )
    if after > 0:
        targets.append(
            F.when((offset < after) & (block > 0), F.struct((block - 1).alias("_block"), F.lit(False).alias("_core")))
        )
    spread = F.explode(F.filter(F.array(*targets), lambda t: t.isNotNull()))
    return placed.withColumn("_t", spread).select("*", "_t._block", "_t._core").drop("_t", "_pos")


def over_series(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    key: Sequence[str] = ("ticker",),
    order: Sequence[str] = ("ts",),
    before: int = 0,
    after: int = 0,
    shape: Shape = UNKNOWN,
    rows: int = 500_000,
    bucket: Column | None = None,
) -> DataFrame:
    """Apply ``build(df, window)``; all its frames must stay within ``before`` rows back and ``after`` ahead."""
    if shape.series_fits():
        return build(df, Window.partitionBy(*key).orderBy(*order))
    cut = blocks(df, key, order, before, after, rows, bucket)
    built = build(cut, Window.partitionBy(*key, "_block").orderBy(*order))
    return built.filter("_core").drop("_block", "_core")


def apply_series(
    df: DataFrame,
    function: Callable,
    schema: str,
    key: Sequence[str] = ("ticker",),
    order: Sequence[str] = ("ts",),
    before: int = 0,
    shape: Shape = UNKNOWN,
    rows: int = 500_000,
    bucket: Column | None = None,
) -> DataFrame:
    """Grouped-map form of :func:`over_series` for recursions; ``before`` rows warm a block up."""
    if shape.series_fits():
        return df.groupBy(*key).applyInPandas(lambda pdf: function(pdf.sort_values(list(order))), schema)
    cut = blocks(df, key, order, before, 0, rows, bucket)

    def one_block(pdf):
        ordered = pdf.sort_values(list(order)).reset_index(drop=True)
        core = ordered["_core"].to_numpy()
        result = function(ordered.drop(columns=["_block", "_core"])).reset_index(drop=True)
        return result[core]

    return cut.groupBy(*key, "_block").applyInPandas(one_block, schema)


_PARTIAL = {
    "sum": lambda c, o: F.sum(c),
    "count": lambda c, o: F.count(c),
    "max": lambda c, o: F.max(c),
    "min": lambda c, o: F.min(c),
    "product": lambda c, o: F.product(c),
    "last": lambda c, o: F.max_by(c, F.when(c.isNotNull(), F.struct(*o))),
}
_INNER = {
    "sum": F.sum,
    "count": F.count,
    "max": F.max,
    "min": F.min,
    "product": F.product,
    "last": lambda c: F.last(c, ignorenulls=True),
}
_CARRY = {**_INNER, "count": F.sum}


def _combine(op: str, carried: Column, inner: Column) -> Column:
    if op in ("sum", "count"):
        return F.when(carried.isNull(), inner).when(inner.isNull(), carried).otherwise(carried + inner)
    if op == "product":
        return F.when(carried.isNull(), inner).when(inner.isNull(), carried).otherwise(carried * inner)
    if op == "max":
        return F.greatest(carried, inner)
    if op == "min":
        return F.least(carried, inner)
    return F.coalesce(inner, carried)


def running(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    aggs: dict[str, tuple[str, Column]],
    shape: Shape = UNKNOWN,
    bucket: Column | None = None,
) -> DataFrame:
    """Add aggregates from the start of the series to the current row: sum, count, max, min, product, last."""
    whole = (Window.unboundedPreceding, Window.currentRow)
    if shape.series_fits():
        frame = Window.partitionBy(*key).orderBy(*order).rowsBetween(*whole)
        return df.select("*", *[_INNER[op](c).over(frame).alias(n) for n, (op, c) in aggs.items()])
    tagged = df.withColumn("_tb", _bucket(order, bucket))
    columns = [F.col(o) for o in order]
    partial = tagged.groupBy(*key, "_tb").agg(*[_PARTIAL[op](c, columns).alias(f"_p_{n}") for n, (op, c) in aggs.items()])
    prior = Window.partitionBy(*key).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    carried = partial.select(
        *key, "_tb", *[_CARRY[op](F.col(f"_p_{n}")).over(prior).alias(f"_c_{n}") for n, (op, _) in aggs.items()]
    )
    inner = Window.partitionBy(*key, "_tb").orderBy(*order).rowsBetween(*whole)
    joined = _join_null_safe(tagged, carried, [*key, "_tb"])
    out = joined.select(
        "*", *[_combine(op, F.col(f"_c_{n}"), _INNER[op](c).over(inner)).alias(n) for n, (op, c) in aggs.items()]
    )
    return out.drop("_tb", *[f"_c_{n}" for n in aggs])


def cumulated(df: DataFrame, by: Sequence[str], order: Sequence[str], weights: Sequence[str], peers: Sequence[str] = ()) -> DataFrame:
    """For each weight column ``w`` its sum over the rows of the group before this one, ``below_w``, and over all, ``n_w``.

    Rows equal in ``peers``, the first columns of ``order``, also get the sum before the first of them, ``low_w``, and their
    own sum, ``same_w``.

    One range exchange on group and order puts neighbours together, in ranges of equal size whatever the values are; sums
    are taken within ranges, and what several ranges share is carried from range to range. The driver receives the first
    and last group of each range. The input is run once, here.
    """
    keys, ties = list(by), [*by, *peers]
    ranged = in_ranges(df, [*keys, *order]).withColumn("_part", F.shiftright("_at", 33))
    ends = F.struct(*ties)
    edges = ranged.groupBy("_part").agg(F.min(ends).alias("lo"), F.max(ends).alias("hi")).collect()  # a row for each range
    edges.sort(key=lambda r: r["_part"])
    whole, equal = Window.partitionBy("_part", *keys), Window.partitionBy("_part", *ties)
    upto = whole.orderBy(*peers, "_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumns({f"below_{w}": F.sum(w).over(upto) - F.col(w) for w in weights})
    out = out.withColumns({f"n_{w}": F.sum(w).over(whole) for w in weights})
    if peers:
        out = out.withColumns({f"low_{w}": F.min(f"below_{w}").over(equal) for w in weights} | {f"same_{w}": F.sum(w).over(equal) for w in weights})
    out = _carry(out, ranged, keys, edges, weights, (("below_", 1), ("low_", 1)) if peers else (("below_", 1),), "n_")
    if peers:
        out = _carry(out, ranged, ties, edges, weights, (("low_", -1),), "same_")
    return out.drop("_at", "_part")


def _carry(out: DataFrame, ranged: DataFrame, keys: list[str], edges: list, weights: Sequence[str], moved: Sequence[tuple[str, int]], total: str) -> DataFrame:
    """Correct sums within ranges for the groups that several ranges share: add (or take off) what earlier ranges hold."""
    first, last = ([tuple(r[side])[: len(keys)] for r in edges] for side in ("lo", "hi"))
    shared = {a for a, b in zip(last, first[1:], strict=False) if a == b}
    if not shared:
        return out
    groups = out.sparkSession.createDataFrame(list(shared), ranged.select(*keys).schema)
    sums = _join_null_safe(ranged, F.broadcast(groups), keys).groupBy("_part", *keys).agg(*[F.sum(w).alias(w) for w in weights])
    every = Window.partitionBy(*keys)
    prior = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("_part", *keys, *[F.sum(w).over(prior).alias(f"_b_{w}") for w in weights], *[F.sum(w).over(every).alias(f"_n_{w}") for w in weights])
    # a range shares its first and its last group at most, so there are no more rows than twice the ranges
    out = _join_null_safe(out, F.broadcast(carried), ["_part", *keys], "left")
    fixed = {f"{name}{w}": F.col(f"{name}{w}") + sign * F.coalesce(f"_b_{w}", F.lit(0)) for name, sign in moved for w in weights}
    return out.withColumns(fixed | {f"{total}{w}": F.coalesce(f"_n_{w}", f"{total}{w}") for w in weights}).drop(*[f"_{x}_{w}" for x in "bn" for w in weights])


def range_ends(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per group: its number ``_g``, its rows ``_rows`` and for each value column where its ranges end, ``_ends_<value>``.

    The ends come from mergeable sketches. They decide how even ranges are, never what ranks are.
    """
    largest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 1
    parts = -(-largest // RANGE_ROWS)
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else None
    cuts = {v: F.lit(None).cast("array<double>") if shares is None else F.array_distinct(F.percentile_approx(F.col(v).cast("double"), shares)) for v in values}
    groups = df.groupBy(*by).agg(*[F.coalesce(c, F.array().cast("array<double>")).alias(f"_ends_{v}") for v, c in cuts.items()], F.count(F.lit(1)).alias("_rows"))
    return groups.withColumn("_g", (F.row_number().over(Window.orderBy(*by)) - 1).cast("int"))


def placed(df: DataFrame, source: DataFrame, ends: DataFrame, value: str, weights: Sequence[str]) -> DataFrame:
    """For each weight column ``w`` its sum over the group's rows of smaller ``value``, ``low_w``, of an equal one, ``same_w``, and of all, ``n_w``.

    ``df`` names groups by the number ``_g`` of :func:`range_ends`; ``source`` has the same rows (group, value, weights) and is
    read for the sums of ranges, without an exchange of rows. Rows meet by range; those that equal the end of a range, and
    those without a value, make ranges of their own in which nothing is left to be ordered, so they are spread.
    """
    cuts = F.broadcast(ends.select("_g", F.col(f"_ends_{value}").alias("_ends")))
    longest, total = ends.agg(F.max(F.size(f"_ends_{value}")), F.sum("_rows")).first()
    longest, tasks = longest or 0, max(-(-(total or 0) // RANGE_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    # other types have values that are equal as doubles only
    exact = dict(source.dtypes)[value] in ("double", "float", "int", "smallint", "tinyint")

    def ranged(rows: DataFrame) -> DataFrame:
        rows, at = rows.join(cuts, "_g").withColumn("_less", F.lit(0)), F.col(value).cast("double")
        for step in (2**i for i in reversed(range(longest.bit_length()))):
            # how many ends are smaller, by halving
            rows = rows.withColumn("_less", F.col("_less") + F.when(F.get("_ends", F.col("_less") + (step - 1)) < at, step).otherwise(0))
        on_end = F.coalesce(F.get("_ends", F.col("_less")) == at, F.lit(False)).cast("int") if exact else F.lit(0)
        return rows.withColumn("_cell", F.when(at.isNull(), -1).otherwise(F.col("_less") * 2 + on_end)).drop("_ends", "_less")

    sums = ranged(source).groupBy("_g", "_cell").agg(*[F.sum(w).alias(f"_in_{w}") for w in weights])
    every = Window.partitionBy("_g")
    before = every.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("*", *[F.coalesce(F.sum(f"_in_{w}").over(before), F.lit(0)).alias(f"_off_{w}") for w in weights], *[F.sum(f"_in_{w}").over(every).alias(f"n_{w}") for w in weights])
    alike = F.col("_cell") % 2 != 0
    spread = F.when(alike, F.monotonically_increasing_id() % 64).otherwise(0)
    # as many tasks as ranges: sorted rows pack well, so by their bytes far too many would be put into a task
    rows = ranged(df).withColumn("_spread", spread.cast("int")).repartition(tasks, "_g", "_cell", "_spread")
    cell = Window.partitionBy("_g", "_cell", "_spread")
    equal, upto = Window.partitionBy("_g", "_cell", "_spread", value), cell.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"low_{w}": F.sum(w).over(upto) for w in weights} | {f"same_{w}": F.sum(w).over(equal) for w in weights})
    # a row for each range
    out = rows.join(F.broadcast(sums), ["_g", "_cell"])
    low = {f"low_{w}": F.col(f"_off_{w}") + F.when(alike, 0).otherwise(F.col(f"low_{w}") - F.col(f"same_{w}")) for w in weights}
    same = {f"same_{w}": F.when(alike, F.col(f"_in_{w}")).otherwise(F.col(f"same_{w}")) for w in weights}
    return out.withColumns(low | same).drop("_cell", "_spread", *[f"_{x}_{w}" for x in ("in", "off") for w in weights])


def value_ranks(
    counts: DataFrame, value: str, by: Sequence[str] = (), count: str = "cnt", shape: Shape = UNKNOWN, also: Sequence[str] = ()
) -> DataFrame:
    """Average-tie ranks of distinct values weighted by ``count``: adds ``below``, ``avg_rank``, ``n``.

    ``counts`` has one row per (by, value), so a value shared by a third of all rows is a single row here. Further counts
    named in ``also`` are ranked by in the same pass, with their name behind the added columns.
    """
    keys, weights = list(by), [count, *also]
    if not keys:
        counts, keys = counts.withColumn("_all", F.lit(0)), ["_all"]
    if shape.stamp_fits():
        peers = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        every = Window.partitionBy(*keys)
        ranked = counts.select(
            "*", *[(F.sum(w).over(peers) - F.col(w)).alias(f"below_{w}") for w in weights], *[F.sum(w).over(every).alias(f"n_{w}") for w in weights]
        )
    else:
        ranked = cumulated(counts, keys, [value], weights)
    ranked = ranked.withColumns({f"avg_rank_{w}": F.col(f"below_{w}") + (F.col(w) + 1) / 2.0 for w in weights})
    return ranked.withColumnsRenamed({f"{x}_{count}": x for x in ("below", "n", "avg_rank")}).drop("_all")


def avg_rank(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    name: str = "rank",
    pct: bool = False,
    shape: Shape = UNKNOWN,
) -> DataFrame:
    """Rank with average ties inside ``by``; nulls get no rank and do not count.

    Without a bound rows are ranked in place, by ranges; copies of a value may part, so a value that many rows have does not meet in one task.
    """
    scale = (lambda r, n: r / n) if pct else (lambda r, n: r)
    if shape.stamp_fits() and by:
        group = Window.partitionBy(*by, F.col(value).isNull())
        low = F.rank().over(group.orderBy(value))
        peers = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
        total = F.count(F.lit(1)).over(group)
        return df.withColumn(
            name, F.when(F.col(value).isNotNull(), scale(low + (peers - 1) / 2.0, total)).cast("double")
        )
    rows = df.withColumns({"_known": F.col(value).isNotNull().cast("int"), "_tie": F.monotonically_increasing_id(), "_all": F.lit(0)})
    ranked = cumulated(rows, by or ["_all"], [value, "_tie"], ["_known"], [value])
    rank = scale(F.col("low__known") + (F.col("same__known") + 1) / 2.0, F.col("n__known"))
    return ranked.select(*df.columns, F.when(F.col(value).isNotNull(), rank).cast("double").alias(name))


def rank_table(
    df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank", pct: bool = False, shape: Shape = UNKNOWN
) -> DataFrame:
    """Average-tie rank of every distinct non-null value: (by, value, name)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("cnt"))
    rank = F.col("avg_rank") / F.col("n") if pct else F.col("avg_rank")
    return value_ranks(counts, value, by, "cnt", shape).select(*by, value, rank.cast("double").alias(name))
