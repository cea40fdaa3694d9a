"""Projection, filters and cleaning."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.layout import DAILY, UNKNOWN, Shape, over_series, positions, running

_WORDS = {"and", "or", "not", "abs", "in", "is", "null", "true", "false", "between"}


# a text literal, a number such as 1e-3, a name, or an operator that SQL spells differently
_TOKEN = re.compile(r"(?P<text>'[^']*'|\"[^\"]*\")|(?P<number>\b\d[\w.]*(?:(?<=[eE])[+-]\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|&|\|)")
_SIGNS = {"==": "=", "&": " AND ", "|": " OR "}


def resolve_predicate(predicate: str, columns: Sequence[str]) -> tuple[str, set[str]]:
    """A text predicate as SQL over ``columns``, and the names it has that no column bears.

    Names match without regard to case and underscores, so ``StockMinusMkt_3`` finds ``stock_minus_mkt_3``.
    """
    known = {c.replace("_", "").lower(): c for c in reversed(columns)}
    unknown = set()

    def replace(match: re.Match) -> str:
        word = match.group()
        if match["sign"]:
            return _SIGNS[word]
        if not match["name"] or word.lower() in _WORDS:
            return word
        column = known.get(word.replace("_", "").lower())
        if column is None:
            unknown.add(word)
            return word
        return f"`{column}`"

    return _TOKEN.sub(replace, predicate), unknown


def filter_applies(columns: Sequence[str], predicate: str | None) -> bool:
    """Whether a regime predicate filters a frame of these columns: there is one and all its names are known."""
    return bool(predicate) and not resolve_predicate(predicate, columns)[1]


def regime_filter(df: DataFrame, predicate: str | None, strict: bool = False) -> DataFrame:
    """Filter by a text predicate. A predicate naming an unknown column filters nothing, unless ``strict``."""
    if not predicate:
        return df
    sql, unknown = resolve_predicate(predicate, df.columns)
    if unknown:
        if strict:
            raise ValueError(f"unknown columns {sorted(unknown)}")
        return df
    return df.filter(F.coalesce(F.expr(sql), F.lit(False)))


def select_families(df: DataFrame, families: dict[str, Sequence[str]], wanted: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Key columns plus the sorted union of the wanted families, as far as the frame has them."""
    columns = sorted({c for f in wanted for c in families[f]})
    return df.select(*keep, *[c for c in columns if c in df.columns and c not in keep])


def clean_xy(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinite to null, then drop rows with a null in any of the columns."""
    bad = {c: F.isnan(c) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in columns}
    out = df.select(*[F.when(~bad[c], F.col(c)).alias(c) if c in bad else F.col(c) for c in df.columns])
    return out.dropna(subset=list(columns))


def numeric(df: DataFrame, column: str, default: float = 0.0) -> Column:
    """Value as double; the default where the text is not a number or the column is absent."""
    if column not in df.columns:
        return F.lit(default)
    return F.coalesce(F.col(column).try_cast("double"), F.lit(default))


def tail_rows(df: DataFrame, n: int, key: str = "ticker", order: str = "ts") -> DataFrame:
    """Last ``n`` rows per series: the filter on row_number lets Spark cut groups before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def drop_warmup(
    df: DataFrame, rows: int = 60, min_rows: int = 200, key: str = "ticker", order: str = "ts", shape: Shape = DAILY
) -> DataFrame:
    """Drop the first rows of each series; keep only series that still have ``min_rows`` left."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") - rows >= min_rows).select(key)
    numbered = positions(df, [key], [order], "_rn", shape)
    return numbered.filter(F.col("_rn") > rows).drop("_rn").join(sizes, key, "left_semi")


def fill(
    df: DataFrame,
    columns: Sequence[str],
    how: str = "ffill",
    key: Sequence[str] = ("ticker",),
    order: Sequence[str] = ("ts",),
    shape: Shape = DAILY,
) -> DataFrame:
    """Carry values forward; then ``ffill_zero`` puts 0, ``ffill_bfill`` the series' first value, in front."""
    carried = running(df, key, order, {f"_f_{c}": ("last", F.col(c)) for c in columns}, shape)
    if how == "ffill_bfill":
        at = F.struct(*order)
        first = df.groupBy(*key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_b_{c}") for c in columns])
        carried = carried.join(first, list(key))
        value = {c: F.coalesce(f"_f_{c}", f"_b_{c}") for c in columns}
    elif how == "ffill_zero":
        value = {c: F.coalesce(F.col(f"_f_{c}"), F.lit(0.0)) for c in columns}
    else:
        value = {c: F.col(f"_f_{c}") for c in columns}
    return carried.select(*[value[c].alias(c) if c in value else F.col(c) for c in df.columns])


def normalise_symbols(df: DataFrame, alias: str | None = None) -> DataFrame:
    """Trim and upper-case symbols, drop blanks, default the alias, keep one row per symbol (smallest alias)."""
    symbol = F.upper(F.trim(F.col("symbol").cast("string")))
    other = F.upper(F.trim(F.col(alias).cast("string"))) if alias and alias in df.columns else symbol
    other = F.when(other.isNull() | other.isin("", "NAN", "NONE"), symbol).otherwise(other)
    return (
        df.select(symbol.alias("symbol"), other.alias("lookup_symbol"))
        .filter(F.col("symbol") != "")
        .groupBy("symbol")
        .agg(F.min("lookup_symbol").alias("lookup_symbol"))
    )


def weekdays(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Monday to Friday between two dates, for each row of a (start, end) table."""
    days = bounds.select(F.explode(F.sequence(F.col(start), F.col(end))).alias("trade_date"))
    return days.filter(F.weekday("trade_date") < 5)


def session_status(
    df: DataFrame,
    ts: str,
    holidays: DataFrame | None = None,
    timezone: str = "Asia/Kolkata",
    start: str = "09:10",
    end: str = "15:35",
    weekdays_open: Sequence[int] = (0, 1, 2, 3, 4),
    enabled: bool = True,
) -> DataFrame:
    """Is the market open at ``ts`` (UTC), and why not: holiday before weekday before time."""
    local = df.withColumn("local_ts", F.from_utc_timestamp(ts, timezone)).withColumn("trade_date", F.to_date("local_ts"))
    if holidays is not None:
        # a holiday calendar has at most one row per day
        days = F.broadcast(holidays.select(F.col("date").alias("trade_date"), F.lit(True).alias("_h")).distinct())
        local = local.join(days, "trade_date", "left")
    else:
        local = local.withColumn("_h", F.lit(None).cast("boolean"))
    clock = F.date_format("local_ts", "HH:mm:ss.SSSSSS")
    weekday = F.weekday("trade_date").isin(list(weekdays_open))
    holiday = F.coalesce("_h", F.lit(False))
    in_time = (clock >= start) & (clock <= end + ":00.000000")
    if not enabled:
        is_open, reason = F.lit(True), F.lit("market_session_open")
    else:
        is_open = weekday & ~holiday & in_time
        reason = (
            F.when(holiday, "configured_holiday")
            .when(~weekday, "non_trading_weekday")
            .when(~in_time, "outside_session_time")
            .otherwise("market_session_open")
        )
    return local.select(
        "*",
        weekday.alias("is_weekday"),
        holiday.alias("is_holiday"),
        in_time.alias("is_in_time"),
        is_open.alias("is_open"),
        reason.alias("reason"),
    ).drop("_h")


def symbol_cap(df: DataFrame, cap: int, override: bool = False) -> DataFrame:
    """Symbol count against a cap, as a one-row status table."""
    return df.agg(F.count_distinct("symbol").alias("configured_symbols")).select(
        "configured_symbols",
        F.lit(cap).alias("cap"),
        F.when(F.col("configured_symbols") <= cap, "within_cap")
        .when(F.lit(override), "cap_overridden")
        .otherwise("cap_exceeded")
        .alias("status"),
    )


def assert_symbol_cap(df: DataFrame, cap: int | None, override: bool = False) -> DataFrame:
    """Raise when the universe has more distinct symbols than the plan allows."""
    if cap is None:
        return df
    row = symbol_cap(df, cap, override).first()
    if row.status == "cap_exceeded":
        raise RuntimeError(f"configured_symbols={row.configured_symbols} exceeds cap={cap}")
    return df


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the last by ``order``: a mergeable max over structs, not a sort of the group."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)
