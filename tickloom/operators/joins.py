"""Joins of the research pipeline: as-of, coverage, intersection, instrument resolution, option-leg picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.layout import UNKNOWN, Shape, running


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    by: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    shape: Shape = UNKNOWN,
    bucket: Column | None = None,
) -> DataFrame:
    """Each left row with the latest right row at or before it (exact matches count).

    One union sorted by time, right rows first on equal times, carrying the last right row forward. Without a proven
    bound the carry runs over time buckets, so a key holding much of the data is split. Right rows must be unique on
    (by, right_on).
    """
    wanted = [c for c in right.columns if c not in (*by, right_on)] if columns is None else list(columns)
    keys = list(by)
    left = left.withColumn("_side", F.lit(1)).withColumn("_t", F.col(left_on))
    taken = right.select(
        *keys,
        F.col(right_on).alias("_t"),
        F.lit(0).alias("_side"),
        F.struct(F.col(right_on).alias("_at"), *wanted).alias("_r"),
    )
    both = left.unionByName(taken, allowMissingColumns=True)
    if not keys:
        both, keys = both.withColumn("_g", F.lit(0)), ["_g"]
    carried = running(
        both,
        keys,
        ["_t", "_side"],
        {"_m": ("last", F.col("_r"))},
        shape,
        F.to_date("_t") if bucket is None else bucket,
    )
    return carried.filter("_side = 1").select(
        *[c for c in left.columns if c not in ("_side", "_t")],
        F.col("_m._at").alias(f"matched_{right_on}"),
        *[F.col(f"_m.{c}").alias(c) for c in wanted],
    )


def covered(df: DataFrame, reference: DataFrame, key: str, name: str = "covered") -> DataFrame:
    """Flag which keys the reference table contains."""
    known = reference.select(F.col(key)).distinct().withColumn("_known", F.lit(True))
    return df.join(known, key, "left").withColumn(name, F.coalesce("_known", F.lit(False))).drop("_known")


def missing_keys(df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct().join(reference.select(key), key, "left_anti")


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def next_snapshot(
    prices: DataFrame, schedule: DataFrame, keys: Sequence[str] = ("fold_id", "k"), extra: Sequence[str] = ()
) -> DataFrame:
    """Price (and ``extra`` columns) of each ticker at a rebalance and its price at the next one.

    ``schedule`` has keys, ts, next_ts, one row per rebalance, at most one for each session of the calendar: it is sent to all
    tasks, and only prices of its dates are exchanged, to meet on (keys, ticker).
    """
    # one row per rebalance
    now = prices.select("ticker", "ts", "close", *extra).join(F.broadcast(schedule.select(*keys, "ts", "next_ts")), "ts")
    then = prices.select("ticker", F.col("ts").alias("next_ts"), F.col("close").alias("next_close"))
    then = then.join(F.broadcast(schedule.select(*keys, "next_ts")), "next_ts").drop("next_ts")
    return now.join(then, [*keys, "ticker"])


def resolve_instruments(
    symbols: DataFrame, master: DataFrame, exchanges: Sequence[str] = ("NSE", "BSE"), prefer_isin_on: str = "BSE", isin_source: str = "NSE"
) -> DataFrame:
    """Each (symbol, exchange) with its cash-equity row; the second exchange prefers an ISIN match.

    Unresolved rows keep a reason instead of a token.
    """
    up = master.select(
        *[F.upper(c).alias(c) for c in ("exchange", "tradingsymbol", "segment", "instrument_type")],
        F.trim(F.coalesce("isin", F.lit(""))).alias("isin"),
        "name",
        "instrument_token",
    )
    cash = up.filter(
        (F.col("instrument_type") == "EQ")
        | (F.col("segment") == F.col("exchange"))
        | (F.col("segment") == F.concat("exchange", F.lit("-EQ")))
    )
    row = F.struct("tradingsymbol", "instrument_token", "isin", "name")
    by_symbol = cash.groupBy("exchange", F.col("tradingsymbol").alias("lookup_symbol")).agg(F.min(row).alias("_symbol_row"))
    by_isin = cash.filter(F.col("isin") != "").groupBy("exchange", "isin").agg(F.min(row).alias("_isin_row"))
    first = by_symbol.filter(F.col("exchange") == isin_source).select("lookup_symbol", F.col("_symbol_row.isin").alias("source_isin"))
    asked = symbols.select(
        F.col("symbol").alias("requested_symbol"),
        F.col("lookup_symbol" if "lookup_symbol" in symbols.columns else "symbol").alias("lookup_symbol"),
        F.explode(F.array(*[F.lit(e) for e in exchanges])).alias("exchange"),
    )
    joined = (
        asked.join(first, "lookup_symbol", "left")
        .join(by_symbol, ["exchange", "lookup_symbol"], "left")
        .join(by_isin.withColumnRenamed("isin", "source_isin"), ["exchange", "source_isin"], "left")
    )
    found = F.coalesce(
        F.when(F.col("exchange") == prefer_isin_on, F.col("_isin_row")), F.col("_symbol_row")
    )
    return joined.select(
        "requested_symbol",
        "lookup_symbol",
        "exchange",
        found["tradingsymbol"].alias("tradingsymbol"),
        found["instrument_token"].alias("instrument_token"),
        found["isin"].alias("isin"),
        found["name"].alias("name"),
        F.when(found.isNull(), "cash_equity_not_found").alias("reason"),
        F.coalesce("source_isin", F.lit("")).alias("source_isin"),
    )


def pick_leg(
    targets: DataFrame,
    chain: DataFrame,
    option_type: str,
    target: str,
    direction: str,
    name: str,
    on: Sequence[str] = ("trade_date", "expiry"),
    keys: Sequence[str] = (),
    require_traded: bool = True,
    dealt: Sequence[str] = (),
) -> DataFrame:
    """Nearest listed strike at or above (``up``), at or below (``down``) or closest to a target price.

    ``targets`` has one row per ``on + keys``. Adds ``{name}_strike``, ``_close``, ``_contracts``, ``_open_int``; null
    where no leg qualifies. The pick is a mergeable ``min_by`` after an equi-join, so a crowded date is combined
    map-side and never sorted in one task. Where the chain is dealt out by a few of ``on`` already (``dealt``, all but the
    expiry), targets go to their legs: they are fewer, so no leg is exchanged or sorted for the join.
    """
    legs = chain.filter((F.col("option_typ") == option_type) & (F.col("close") > 0))
    if require_traded:
        legs = legs.filter(F.coalesce("contracts", F.lit(0)) > 0)
    legs = legs.select(*on, "strike", F.struct("strike", "close", "contracts", "open_int").alias("_leg"))
    wanted = targets.select(*on, *keys, F.col(target).alias("_target"))
    gap = F.col("strike") - F.col("_target")
    if dealt:
        # the expiry is compared beside the keys, as a key it would deal all legs anew
        asked = wanted.withColumnRenamed("expiry", "_expiry").hint("shuffle_hash")
        met = legs.join(asked, list(dealt)).filter(F.datediff("expiry", "_expiry") == 0).drop("_expiry")
    else:
        met = wanted.join(legs, list(on))
    if direction == "up":
        candidates, distance = met.filter(gap >= 0), gap
    elif direction == "down":
        candidates, distance = met.filter(gap <= 0), -gap
    else:
        candidates, distance = met, F.abs(gap)
    picked = candidates.groupBy(*on, *keys).agg(F.min(F.struct(distance.alias("d"), "_leg")).alias("_p"))
    out = targets.join(picked, [*on, *keys], "left")
    return out.select(
        *targets.columns,
        *[F.col(f"_p._leg.{c}").alias(f"{name}_{c}") for c in ("strike", "close", "contracts", "open_int")],
    )


def expand_grid(df: DataFrame, **params: Sequence) -> DataFrame:
    """Every row with every combination of small literal parameter lists (a generator, not a join)."""
    out = df
    for column, values in params.items():
        out = out.withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def expand_variants(df: DataFrame, variants: Sequence[dict], names: Sequence[str], types: dict[str, str]) -> DataFrame:
    """Every row with every variant record; fields a variant does not set are null."""
    rows = [F.struct(*[F.lit(v.get(n)).cast(types[n]).alias(n) for n in names]) for v in variants]
    return df.withColumn("_v", F.explode(F.array(*rows))).select(*df.columns, *[F.col(f"_v.{n}").alias(n) for n in names])
