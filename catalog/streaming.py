"""Tick bars, order-book flattening and audits."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query
from tickloom.streaming import audits as au
from tickloom.streaming import ticks as tk


@query(
    "r1_event_time",
    "event_id:i event_ts:t",
    """SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN ts END, CASE WHEN event_id % 3 = 1 THEN ts - INTERVAL 1 SECOND END, ts + INTERVAL 1 SECOND) AS event_ts
       FROM events""",
)
def _(t):
    ts = F.col("ts").cast("timestamp")
    raw = t.events.select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, ts).alias("exchange_timestamp"),
        F.when(F.col("event_id") % 3 == 1, ts - F.expr("INTERVAL 1 SECOND")).alias("timestamp"),
        F.lit(None).cast("timestamp").alias("last_trade_time"),
        (ts + F.expr("INTERVAL 1 SECOND")).alias("received_utc"),
    )
    return raw.select("event_id", tk.event_time().alias("event_ts"))


BARS = f"""{fx.TICKS}, tick_bars AS (
      SELECT time_bucket(INTERVAL '1 hour', ts) AS minute, instrument, arg_min(price, row(ts, event_id)) AS open, max(price) AS high, min(price) AS low,
             arg_max(price, row(ts, event_id)) AS close, sum(last_qty) AS last_quantity_sum, arg_max(day_volume, row(ts, event_id)) AS last_seen_day_volume,
             count(*) AS tick_count, min(ts) AS first_tick_time, max(ts) AS last_tick_time FROM ticks GROUP BY 1, 2)"""
BAR_SPEC = (
    "minute:t instrument:s open:f8 high:f8 low:f8 close:f8 last_quantity_sum:i last_seen_day_volume:i tick_count:i first_tick_time:t last_tick_time:t"
)


@query("r2_tumbling_bars", BAR_SPEC, f"WITH {BARS} SELECT * FROM tick_bars")
def _(t):
    return tk.minute_bars(fx.ticks(t), "1 hour")


@query(
    "r3_late_ticks",
    "event_id:i instrument:s minute:t",
    f"""WITH {fx.TICKS}, b AS (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS minute FROM ticks),
        c AS (SELECT DISTINCT instrument, minute FROM b WHERE event_id % 5 <> 0)
        SELECT event_id, instrument, minute FROM b JOIN c USING (instrument, minute) WHERE event_id % 5 = 0""",
)
def _(t):
    ticks = fx.ticks(t)
    counted = ticks.filter("event_id % 5 <> 0")
    return tk.late_ticks(ticks, tk.minute_bars(counted, "1 hour"), counted, ["event_id"], "1 hour")


@query(
    "r4_depth_flattening",
    "event_id:i instrument:s buy_1_price:f8 buy_5_price:f8 buy_5_quantity:i buy_5_orders:i sell_1_price:f8 sell_3_quantity:i sell_5_orders:i",
    """SELECT event_id, event_type AS instrument, 1000 + value / 10 - 0.05::DOUBLE * 1 AS buy_1_price, 1000 + value / 10 - 0.05::DOUBLE * 5 AS buy_5_price,
       104 AS buy_5_quantity, 6 AS buy_5_orders, 1000 + value / 10 + 0.05::DOUBLE * 1 AS sell_1_price, 112 AS sell_3_quantity, 7 AS sell_5_orders FROM events""",
)
def _(t):
    return tk.flatten_depth(fx.depth_ticks(t))


@query(
    "r5_known_instruments",
    "event_id:i sector:i price:f8",
    "SELECT event_id, s_nationkey AS sector, 1000 + value / 10 AS price FROM events JOIN supplier ON s_suppkey = user_id",
)
def _(t):
    master = t.supplier.select(F.col("s_suppkey").alias("instrument_token"), F.col("s_nationkey").alias("sector"))
    ticks = t.events.select("event_id", F.col("user_id").alias("instrument_token"), (1000 + F.col("value") / 10).alias("price"))
    return tk.with_instruments(ticks, master)


def raw(t):
    return t.events.select(
        F.to_date("ts").alias("trade_date"), F.lit("NSE").alias("exchange"), F.concat_ws("_", "event_type", (F.col("user_id") % 5).cast("string")).alias("symbol")
    )


COUNTS = """counts AS (SELECT CAST(ts AS DATE) AS trade_date, 'NSE' AS exchange, event_type || '_' || (user_id % 5) AS symbol, count(*) AS tick_count FROM events GROUP BY 1, 2, 3)"""


@query("r7_tick_counts", "trade_date:d exchange:s symbol:s tick_count:i", f"WITH {COUNTS} SELECT * FROM counts")
def _(t):
    return au.tick_counts(raw(t))


SUSPECT = f"""{COUNTS}, suspect_days AS (
      SELECT *, tick_count / rolling_median AS tick_count_ratio, coalesce(tick_count / rolling_median < 0.6, false) AS suspect
      FROM (SELECT *, median(tick_count) OVER (PARTITION BY exchange, symbol ORDER BY trade_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_median FROM counts))"""


@query(
    "r8_suspect_days",
    "trade_date:d symbol:s tick_count:i rolling_median:f tick_count_ratio:f suspect:b",
    f"WITH {SUSPECT} SELECT * FROM suspect_days",
)
def _(t):
    return au.suspect_days(au.tick_counts(raw(t)))


BEATS = f"""{fx.HEARTBEATS}, beat_gaps AS (
      SELECT trade_date, count(*) AS heartbeat_rows, coalesce(sum(CASE WHEN s > 90 THEN s - 60 END), 0) / 60 AS heartbeat_gap_minutes
      FROM (SELECT CAST(heartbeat_utc AS DATE) AS trade_date, date_diff('microsecond', lag(heartbeat_utc) OVER (
              PARTITION BY CAST(heartbeat_utc AS DATE) ORDER BY heartbeat_utc), heartbeat_utc) / 1e6 AS s FROM heartbeats) GROUP BY 1)"""


@query("r9_heartbeat_gaps", "trade_date:d heartbeat_rows:i heartbeat_gap_minutes:f", f"WITH {BEATS} SELECT * FROM beat_gaps")
def _(t):
    return au.heartbeat_gaps(fx.heartbeats(t))


RECONNECT = f"""{fx.COLLECTOR_EVENTS}, relevant AS (
      SELECT *, CAST(event_utc AS DATE) AS trade_date, sum(CASE WHEN event_type = 'connect' THEN 1 ELSE 0 END) OVER (
        PARTITION BY CAST(event_utc AS DATE) ORDER BY event_utc, event_id ROWS UNBOUNDED PRECEDING) AS c FROM collector_events WHERE event_type <> 'note'),
    opened AS (SELECT trade_date, c, min(event_utc) AS o FROM relevant WHERE event_type <> 'connect' GROUP BY 1, 2),
    closed AS (SELECT trade_date, c - 1 AS c, event_utc AS e FROM relevant WHERE event_type = 'connect'),
    reconnect AS (
      SELECT trade_date, coalesce(sum(date_diff('microsecond', o, e) / 1e6), 0) / 60 AS event_reconnect_gap_minutes, count(o) AS disconnect_events
      FROM (SELECT * FROM opened LEFT JOIN closed USING (trade_date, c)) GROUP BY 1)"""


@query(
    "r10_reconnect_gaps",
    "trade_date:d event_reconnect_gap_minutes:f disconnect_events:i",
    f"WITH {RECONNECT} SELECT * FROM reconnect",
)
def _(t):
    return au.reconnect_gaps(fx.collector_events(t))


AUDIT = f"""{SUSPECT}, {BEATS}, {RECONNECT}, audit AS (
      SELECT * FROM suspect_days LEFT JOIN beat_gaps USING (trade_date) LEFT JOIN reconnect USING (trade_date))"""


def _audit(t):
    return au.daily_audit(au.tick_counts(raw(t)), fx.heartbeats(t), fx.collector_events(t))


@query(
    "r11_daily_audit",
    "trade_date:d symbol:s tick_count:i suspect:b heartbeat_rows:f heartbeat_gap_minutes:f event_reconnect_gap_minutes:f disconnect_events:f",
    f"WITH {AUDIT} SELECT * FROM audit",
)
def _(t):
    return _audit(t)


GATE = f"""{AUDIT}, by_day AS (SELECT trade_date, count(DISTINCT symbol) AS a, count(DISTINCT symbol) FILTER (NOT suspect) AS s FROM audit GROUP BY 1),
    gate AS (
      SELECT *, CASE WHEN full_stable_trade_dates >= 15 AND suspect_symbol_days = 0 AND avg_gap_minutes <= 5 THEN 'gate_passed' ELSE 'gate_blocked' END AS status
      FROM (SELECT count(*) FILTER (NOT suspect) AS stable_symbol_days, count(*) FILTER (suspect) AS suspect_symbol_days,
              avg(greatest(coalesce(heartbeat_gap_minutes, 0), coalesce(event_reconnect_gap_minutes, 0))) AS avg_gap_minutes FROM audit),
           (SELECT count(*) FILTER (s > 0) AS stable_trade_dates, count(*) FILTER (s >= (SELECT max(a) FROM by_day)) AS full_stable_trade_dates FROM by_day))"""


@query(
    "r12_quality_gate",
    "stable_symbol_days:i suspect_symbol_days:i avg_gap_minutes:f stable_trade_dates:i full_stable_trade_dates:i status:s",
    f"WITH {GATE} SELECT * FROM gate",
)
def _(t):
    return au.quality_gate(_audit(t))


@query("r13_file_check", "readable:b missing_columns:s files:i rows:i", "SELECT true AS readable, 'bid' AS missing_columns, 1 AS files, count(*) AS rows FROM events")
def _(t):
    checked = au.file_check(t.spark, f"{t.folder}/events.parquet", ["event_id", "ts", "bid"])
    return checked.groupBy("readable", "missing_columns").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"))


@query(
    "r14_plan_status",
    "first_trade_date:d latest_trade_date:d calendar_days_observed:i window_expired:b kill_switch:b plan_status:s",
    f"""WITH {GATE}, s AS (SELECT min(trade_date) AS first_trade_date, max(trade_date) AS latest_trade_date, max(trade_date) - min(trade_date) + 1 AS calendar_days_observed FROM audit)
        SELECT s.*, calendar_days_observed >= 28 AS window_expired, calendar_days_observed >= 28 AND status <> 'gate_passed' AS kill_switch,
        CASE WHEN calendar_days_observed >= 28 AND status <> 'gate_passed' THEN 'rebuild_or_delay' WHEN status = 'gate_passed' THEN 'collection_allowed' ELSE 'shakedown_active' END AS plan_status
        FROM s, gate""",
)
def _(t):
    audit = _audit(t)
    return au.plan_status(audit, au.quality_gate(audit))


@query(
    "r14_latest_status",
    "latest_heartbeat_utc:t latest_event_utc:t latest_event_type:s",
    f"""WITH {fx.HEARTBEATS}, {fx.COLLECTOR_EVENTS} SELECT (SELECT max(heartbeat_utc) FROM heartbeats) AS latest_heartbeat_utc, max(event_utc) AS latest_event_utc,
        arg_max(event_type, row(event_utc, event_id)) AS latest_event_type FROM collector_events""",
)
def _(t):
    return au.latest_status(fx.heartbeats(t), fx.collector_events(t))


@query(
    "s8_upsert_merge",
    "ticker:s ts:d close:f8",
    f"""WITH {fx.BARS} SELECT ticker, ts, CASE WHEN volume >= 25 THEN open ELSE close END AS close FROM bars""",
)
def _(t):
    from tickloom.sources.sinks import merge_latest

    bars = fx.bars(t)
    fixes = bars.filter("volume >= 25").select("ticker", "ts", F.col("open").alias("close"))
    return merge_latest(bars.select("ticker", "ts", "close"), fixes, ["ticker", "ts"])


@query(
    "s10_raw_tick_lines",
    "trade_date:d instrument:s lines:i price_sum:f4",
    f"WITH {fx.TICKS} SELECT trade_date, instrument, count(*) AS lines, sum(price) AS price_sum FROM ticks GROUP BY 1, 2",
)
def _(t):
    lines = tk.raw_lines(fx.ticks(t))
    return lines.groupBy("trade_date", "instrument").agg(
        F.count("value").alias("lines"), F.sum(F.get_json_object("value", "$.price").cast("double")).alias("price_sum")
    )


@query(
    "s11_candle_normaliser",
    "exchange:s tradingsymbol:s timestamp:t close:f8",
    f"""WITH {fx.INSTRUMENTS}, c AS (SELECT user_id * 10 + 1 AS instrument_token, date_trunc('hour', ts) AS "timestamp", max(value) AS close FROM events GROUP BY 1, 2)
        SELECT exchange, tradingsymbol, "timestamp", close FROM c JOIN instruments USING (instrument_token)""",
)
def _(t):
    from tickloom.sources.readers import normalise_candles

    value = F.col("value")
    candles = t.events.select(
        (F.col("user_id") * 10 + 1).alias("instrument_token"), F.date_trunc("hour", "ts").alias("timestamp"),
        *[value.alias(c) for c in ("open", "high", "low", "close", "volume")],
    )
    return normalise_candles(candles, fx.instruments(t))
