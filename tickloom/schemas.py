"""Schemas of the inputs and the header-synonym resolver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BARS = "ticker STRING, ts TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
TICK = (
    "instrument STRING, event_id BIGINT, ts TIMESTAMP, price DOUBLE, last_qty BIGINT, day_volume BIGINT, "
    "depth STRUCT<buy: ARRAY<STRUCT<price: DOUBLE, quantity: BIGINT, orders: INT>>, sell: ARRAY<STRUCT<price: DOUBLE, quantity: BIGINT, orders: INT>>>"
)
COLLECTOR_EVENT = "event_utc TIMESTAMP, event_type STRING"

# fixed values: header synonyms of each input kind, target column to accepted headers
SYNONYMS: dict[str, dict[str, Sequence[str]]] = {
    "bars": {
        "ticker": ("ticker", "symbol"), "ts": ("date", "datetime", "timestamp", "ts"), "open": ("open",), "high": ("high",),
        "low": ("low",), "close": ("close",), "volume": ("volume",),
    },
    "delivery": {
        "symbol": ("symbol", "ticker"), "total_qty": ("ttl_trd_qnty", "tottrdqty", "tottrd_qty", "tottrdval", "turnover_lacs"),
        "deliv_qty": ("deliv_qty", "deliverable_qty"), "deliv_pct": ("deliv_per", "deliv_percent", "deliv_per(% )"),
    },
    "oi": {
        "instrument": ("instrument",), "symbol": ("symbol",), "expiry": ("expiry_dt", "expiry"), "oi": ("open_int", "openinterest"),
        "chg_in_oi": ("chg_in_oi", "changeinoi", "change_in_oi"),
    },
    "chain": {
        "instrument": ("instrument",), "symbol": ("symbol",), "expiry": ("expiry_dt",), "strike": ("strike_pr",), "option_typ": ("option_typ",),
        "close": ("close",), "settle": ("settle_pr",), "contracts": ("contracts",), "open_int": ("open_int",), "trade_date": ("timestamp",),
    },
    "series": {"dt": ("date", "datetime", "timestamp"), "value": ("close", "last", "last_price")},
    "earnings": {"symbol": ("symbol", "ticker"), "event_date": ("eventdate", "event_date", "announcement_date")},
}


def resolve_columns(df: DataFrame, kind: str, optional: Sequence[str] = ("settle",)) -> DataFrame:
    """Rename the first header matching each target, case- and space-insensitively; name what is missing."""
    headers = {c.strip().lower(): c for c in df.columns}
    picked, missing = [], []
    for target, accepted in SYNONYMS[kind].items():
        found = next((headers[a] for a in accepted if a in headers), None)
        if found is not None:
            picked.append(F.col(f"`{found}`").alias(target))
        elif target not in optional:
            missing.append(target)
    if missing:
        raise ValueError(f"{kind} input misses columns {missing}; it has {df.columns}")
    extra = [F.col(c) for c in df.columns if c.startswith("_")]
    return df.select(*picked, *extra)
