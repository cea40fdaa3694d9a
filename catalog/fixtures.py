"""Research inputs derived from the given tables (bars, delivery, open interest, chain, ticks, ...).

Everything here is a lazy transformation of whole tables. Bars collapse to one row per instrument and day with
map-side aggregation, so a supplier holding a third of all lines becomes an ordinary daily series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import Tables
from tickloom.functions.layout import TASK_ROWS, running


def line_price():
    return F.lit(1000) + F.col("l_extendedprice") / F.col("l_quantity") / F.lit(100)


def line_key():
    return F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def ticker_of(column: str, kind: str = "S"):
    return F.concat(F.lit(kind), F.lpad(F.col(column).cast("string"), 12, "0"))


def draw_sql(*parts: str) -> str:
    """Hexadecimal digits of a draw from a seed and a key, in the order of the draws."""
    return "substr(md5(" + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 15)"


def by_supplier(t: Tables) -> DataFrame:
    """Lines, named by their supplier: many instruments, each traded on some days."""
    return t.lineitem.withColumn("name", F.col("l_suppkey"))


def by_group(t: Tables) -> DataFrame:
    """Lines, named by groups of four suppliers: as many instruments as a rebalanced universe needs to be traded on most days, at any size."""
    return t.lineitem.withColumns({"name": F.floor(F.col("l_suppkey") / 4), "grouped": F.lit(True)})


def with_futures(lines: DataFrame) -> DataFrame:
    """The lines of groups that have futures: two in three."""
    return lines.where(F.floor(F.col("l_suppkey") / 4) % 3 != 0)


def grouped(sql: str, futures: bool = False) -> str:
    """SQL over suppliers' lines as SQL over groups of suppliers, all or those that have futures."""
    sql = sql.replace("'S' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0')", "'G' || lpad(CAST(l_suppkey // 4 AS VARCHAR), 12, '0')")
    return sql.replace("FROM lineitem", "FROM (SELECT * FROM lineitem WHERE (l_suppkey // 4) % 3 <> 0)") if futures else sql


def name_of(lines: DataFrame):
    """Written names come after the aggregates: numbers sort much faster than names that begin alike."""
    return ticker_of("name", "G" if "grouped" in lines.columns else "S")


def bars(t: Tables, lines: DataFrame | None = None) -> DataFrame:
    """Daily bars of every instrument: suppliers unless ``lines`` are named otherwise."""
    lines = by_supplier(t) if lines is None else lines
    return lines.groupBy("name", F.to_date("l_shipdate").alias("ts")).agg(*bar_columns()).withColumn("ticker", name_of(lines)).drop("name")


def bar_columns():
    price, key = line_price(), line_key()
    return (
        F.min_by(price, key).alias("open"),
        F.max(price * (1 + F.col("l_discount") / 10)).alias("high"),
        F.min(price * (1 - F.col("l_tax") / 10)).alias("low"),
        F.max_by(price * (1 + (F.col("l_discount") - F.col("l_tax")) / 20), key).alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


def series_bars(t: Tables) -> DataFrame:
    """:func:`bars` of suppliers for plans over whole series: lines meet by ticker, once, and neither days nor windows move them again.

    All columns of a bar come from the same columns of a line, so branches that read different ones share that exchange. It takes
    all lines of a ticker into one task, so where a ticker has more than fit the bars are those combined before the exchange.
    """
    largest = t.lineitem.groupBy("l_suppkey").count().agg(F.max("count")).first()[0] or 0
    if largest > TASK_ROWS:
        return bars(t)
    read = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    lines = t.lineitem.select(ticker_of("l_suppkey").alias("ticker"), *read).repartition("ticker")
    return lines.groupBy("ticker", F.to_date("l_shipdate").alias("ts")).agg(*bar_columns())


BARS = """bars AS (
  SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS ticker, CAST(l_shipdate AS DATE) AS ts,
         arg_min(p, k) AS open, max(p * (1 + l_discount / 10)) AS high, min(p * (1 - l_tax / 10)) AS low,
         arg_max(p * (1 + (l_discount - l_tax) / 20), k) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, 1000 + l_extendedprice / l_quantity / 100 AS p,
               row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem)
  GROUP BY 1, 2)"""

GROUP_BARS = grouped(BARS)


def sectors(t: Tables) -> DataFrame:
    return t.supplier.select(ticker_of("s_suppkey").alias("ticker"), F.col("s_nationkey").alias("sector"))


SECTORS = """sectors AS (
  SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS ticker, s_nationkey AS sector FROM supplier)"""


def windows_of_days(t: Tables) -> DataFrame:
    """Ten consecutive windows of trade dates; one row per calendar day, so a single window task is enough."""
    from pyspark.sql import Window

    days = t.lineitem.select(F.to_date("l_shipdate").alias("ts")).distinct()
    return days.withColumn("window_id", F.ntile(10).over(Window.orderBy("ts")))


DAY_WINDOWS = """day_windows AS (
  SELECT ts, ntile(10) OVER (ORDER BY ts) AS window_id
  FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS ts FROM lineitem))"""


def delivery(t: Tables, lines: DataFrame | None = None) -> DataFrame:
    lines = by_supplier(t) if lines is None else lines
    settled = F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0)
    return (
        lines.groupBy("name", F.to_date("l_shipdate").alias("date"))
        .agg(F.sum("l_quantity").alias("total_qty"), F.sum(settled).alias("deliv_qty"))
        .select(
            name_of(lines).alias("symbol"),
            "date",
            "total_qty",
            "deliv_qty",
            (100 * F.col("deliv_qty") / F.col("total_qty")).alias("deliv_pct"),
        )
    )


DELIVERY = """delivery AS (
  SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS symbol, CAST(l_shipdate AS DATE) AS date,
         sum(l_quantity) AS total_qty, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS deliv_qty,
         100 * sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS deliv_pct
  FROM lineitem GROUP BY 1, 2)"""


def open_interest(t: Tables, lines: DataFrame | None = None) -> DataFrame:
    lines = by_supplier(t) if lines is None else lines
    day = F.to_date("l_shipdate")
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return (
        lines.groupBy("name", day.alias("date"), F.date_add(day, F.col("l_linenumber") * 7).alias("expiry"))
        .agg((100 * F.sum("l_quantity")).alias("oi"), F.sum(signed).alias("chg_in_oi"))
        .select(
            "date", F.lit("FUTSTK").alias("instrument"), name_of(lines).alias("symbol"), "expiry", "oi", "chg_in_oi"
        )
    )


OPEN_INTEREST = """oi AS (
  SELECT CAST(l_shipdate AS DATE) AS date, 'FUTSTK' AS instrument,
         'S' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS symbol,
         CAST(l_shipdate AS DATE) + CAST(7 * l_linenumber AS INTEGER) AS expiry, 100 * sum(l_quantity) AS oi,
         sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS chg_in_oi
  FROM lineitem GROUP BY ALL)"""


def spot(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.to_date("o_orderdate").alias("dt")).agg(
        (20000 + F.avg("o_totalprice") / 100).alias("spot")
    )


SPOT = """spot AS (
  SELECT CAST(o_orderdate AS DATE) AS dt, 20000 + avg(o_totalprice) / 100 AS spot FROM orders GROUP BY 1)"""


def vix(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.to_date("l_shipdate").alias("dt")).agg(F.avg("l_quantity").alias("vix"))


VIX = "vix AS (SELECT CAST(l_shipdate AS DATE) AS dt, avg(l_quantity) AS vix FROM lineitem GROUP BY 1)"


def chain(t: Tables) -> DataFrame:
    """Listed options around each day's spot: 25 strikes, calls and puts, one weekly expiry."""
    at_money = F.floor(F.col("spot") / 50 + 0.5) * 50
    thursday = F.date_add(F.col("dt"), 3)
    expiry = F.date_add(thursday, (10 - F.weekday(thursday)) % 7)
    return (
        spot(t)
        .select(
            F.col("dt").alias("trade_date"),
            "spot",
            expiry.alias("expiry"),
            F.explode(F.sequence(F.lit(-12), F.lit(12))).alias("i"),
        )
        .select("*", F.explode(F.array(F.lit("CE"), F.lit("PE"))).alias("option_typ"))
        .withColumn("strike", (at_money + 200 * F.col("i")).cast("double"))
        .withColumn(
            "intrinsic",
            F.when(
                F.col("option_typ") == "CE", F.greatest(F.col("spot") - F.col("strike"), F.lit(0.0))
            ).otherwise(F.greatest(F.col("strike") - F.col("spot"), F.lit(0.0))),
        )
        .withColumn("contracts", ((F.dayofyear("trade_date") * 31 + 17 * F.col("i") + 250) % 500).cast("long"))
        .select(
            "trade_date",
            "expiry",
            "strike",
            "option_typ",
            (F.col("intrinsic") + 120 - 9 * F.abs(F.col("i"))).alias("close"),
            "contracts",
            (10 * F.col("contracts")).alias("open_int"),
        )
    )


CHAIN = """chain AS (
  SELECT dt AS trade_date,
         dt + 3 + CAST((10 - (isodow(dt + 3) - 1)) % 7 AS INTEGER) AS expiry,
         CAST(floor(spot / 50 + 0.5) * 50 + 200 * i AS DOUBLE) AS strike, option_typ,
         (CASE WHEN option_typ = 'CE' THEN greatest(spot - (floor(spot / 50 + 0.5) * 50 + 200 * i), 0.0)
               ELSE greatest(floor(spot / 50 + 0.5) * 50 + 200 * i - spot, 0.0) END) + 120 - 9 * abs(i) AS close,
         CAST((dayofyear(dt) * 31 + 17 * i + 250) % 500 AS BIGINT) AS contracts,
         CAST(10 * ((dayofyear(dt) * 31 + 17 * i + 250) % 500) AS BIGINT) AS open_int
  FROM spot, (SELECT unnest(range(-12, 13)) AS i), (SELECT unnest(['CE', 'PE']) AS option_typ))"""


def stock_spot(t: Tables) -> DataFrame:
    """Close of every supplier on the days it trades."""
    return bars(t).select(F.col("ticker").alias("symbol"), F.col("ts").alias("dt"), F.col("close").alias("spot"))


def stock_chain(t: Tables, spots: DataFrame | None = None) -> DataFrame:
    """Listed options of every supplier: nine strikes, calls and puts, a ladder of three expiries.

    Spots are dealt by name and day before they are listed, so what looks at one day's listing needs no exchange of legs.
    """
    spots = stock_spot(t) if spots is None else spots
    thursday = F.date_add(F.col("dt"), 3)
    weekly = F.date_add(thursday, (10 - F.weekday(thursday)) % 7)
    ladder = F.explode(F.array(weekly, F.date_add(weekly, 7), F.date_add(weekly, 28)))
    dealt = spots.select("symbol", F.col("dt").alias("trade_date"), "spot").repartition("symbol", "trade_date")
    listed = dealt.withColumn("dt", F.col("trade_date")).select("symbol", "trade_date", "spot", ladder.alias("expiry"))
    listed = listed.select("*", F.explode(F.sequence(F.lit(-4), F.lit(4))).alias("i")).select("*", F.explode(F.array(F.lit("CE"), F.lit("PE"))).alias("option_typ"))
    strike, days = (F.floor(F.col("spot") / 10 + 0.5) * 10 + 20 * F.col("i")).cast("double"), F.datediff("expiry", "trade_date")
    gap = F.when(F.col("option_typ") == "CE", F.col("spot") - strike).otherwise(strike - F.col("spot"))
    contracts = ((F.dayofyear("trade_date") * 31 + 17 * F.col("i") + 7 * days + 250) % 50).cast("long")
    return listed.select(
        "symbol", "trade_date", "expiry", strike.alias("strike"), "option_typ",
        (F.greatest(gap, F.lit(0.0)) + 24 - 4 * F.abs(F.col("i")) + days / 4.0).alias("close"), contracts.alias("contracts"), (10 * contracts).alias("open_int"),
    )


STOCK_CHAIN = """stock_spot AS (SELECT ticker AS symbol, ts AS dt, close AS spot FROM bars),
    stock_chain AS (
      SELECT symbol, trade_date, expiry, CAST(k AS DOUBLE) AS strike, option_typ,
             greatest(CASE WHEN option_typ = 'CE' THEN spot - k ELSE k - spot END, 0.0) + 24 - 4 * abs(i) + (expiry - trade_date) / 4.0 AS close,
             CAST((dayofyear(trade_date) * 31 + 17 * i + 7 * (expiry - trade_date) + 250) % 50 AS BIGINT) AS contracts
      FROM (
        SELECT symbol, dt AS trade_date, spot, i, option_typ, floor(spot / 10 + 0.5) * 10 + 20 * i AS k,
               dt + 3 + CAST((10 - (isodow(dt + 3) - 1)) % 7 AS INTEGER) + step AS expiry
        FROM stock_spot, (SELECT unnest([0, 7, 28]) AS step), (SELECT unnest(range(-4, 5)) AS i), (SELECT unnest(['CE', 'PE']) AS option_typ)))"""


def earnings(t: Tables) -> DataFrame:
    suppliers = t.supplier.agg(F.count(F.lit(1)).alias("n"))
    # one-row table: the supplier count
    return t.orders.join(F.broadcast(suppliers)).select(
        F.concat(F.lit("S"), F.lpad((F.col("o_custkey") % F.col("n")).cast("string"), 12, "0")).alias("symbol"),
        F.to_date("o_orderdate").alias("event_date"),
    )


EARNINGS = """earnings AS (
  SELECT 'S' || lpad(CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR), 12, '0') AS symbol,
         CAST(o_orderdate AS DATE) AS event_date
  FROM orders)"""


def ticks(t: Tables) -> DataFrame:
    """Quote ticks: one instrument per event type, running day volume."""
    raw = t.events.select(
        "event_id",
        F.col("event_type").alias("instrument"),
        F.col("ts").cast("timestamp").alias("ts"),
        (1000 + F.col("value") / 10).alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("last_qty"),
    ).withColumn("trade_date", F.to_date("ts"))
    return running(
        raw,
        ["instrument", "trade_date"],
        ["ts", "event_id"],
        {"day_volume": ("sum", F.col("last_qty"))},
        bucket=F.date_trunc("minute", "ts"),
    )


TICKS = """ticks AS (
  SELECT event_id, event_type AS instrument, ts, 1000 + value / 10 AS price,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS last_qty, CAST(ts AS DATE) AS trade_date,
         CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER (
           PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS day_volume
  FROM events)"""


def quarter_bars(t: Tables) -> DataFrame:
    """15-minute bars of the tick stream; first and last price by (ts, event_id)."""
    at = F.struct("ts", "event_id")
    raw = t.events.select(
        F.col("event_type").alias("ticker"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        (1000 + F.col("value") / 10).alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("qty"),
    )
    return (
        raw.groupBy("ticker", F.window("ts", "15 minutes").start.alias("bar_ts"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("qty").alias("volume"),
        )
        .withColumnRenamed("bar_ts", "ts")
    )


QUARTER_BARS = """quarter_bars AS (
  SELECT event_type AS ticker, time_bucket(INTERVAL '15 minutes', ts) AS ts,
         arg_min(1000 + value / 10, row(ts, event_id)) AS open, max(1000 + value / 10) AS high,
         min(1000 + value / 10) AS low, arg_max(1000 + value / 10, row(ts, event_id)) AS close,
         sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS volume
  FROM events GROUP BY 1, 2)"""


def heartbeats(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'view'").select(F.col("ts").cast("timestamp").alias("heartbeat_utc"))


HEARTBEATS = "heartbeats AS (SELECT ts AS heartbeat_utc FROM events WHERE event_type = 'view')"


def collector_events(t: Tables) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "purchase", "close")
        .when(F.col("event_type") == "signup", "connect")
        .otherwise("note")
    )
    return t.events.select(F.col("ts").cast("timestamp").alias("event_utc"), kind.alias("event_type"), "event_id")


COLLECTOR_EVENTS = """collector_events AS (
  SELECT ts AS event_utc, event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'close'
         WHEN 'signup' THEN 'connect' ELSE 'note' END AS event_type FROM events)"""


def depth_ticks(t: Tables) -> DataFrame:
    """Nested five-level order book per tick."""

    def side(sign: int, quantity: int, orders: int):
        return F.transform(
            F.sequence(F.lit(0), F.lit(4)),
            lambda i: F.struct(
                (F.col("price") + sign * 0.05 * (i + 1)).alias("price"),
                (i + quantity).cast("long").alias("quantity"),
                (i + orders).cast("int").alias("orders"),
            ),
        )

    return t.events.select(
        F.col("event_type").alias("instrument"),
        F.col("ts").cast("timestamp").alias("exchange_timestamp"),
        "event_id",
        (1000 + F.col("value") / 10).alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("last_traded_quantity"),
    ).select(
        "*",
        F.struct(side(-1, 100, 2).alias("buy"), side(1, 110, 3).alias("sell")).alias("depth"),
    )


def instruments(t: Tables) -> DataFrame:
    symbol = F.concat(F.lit("SUP"), F.col("s_suppkey").cast("string"))
    rows = t.supplier.select(
        F.explode(F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("NSE"), F.lit("BSE"))).otherwise(F.array(F.lit("BSE")))).alias(
            "exchange"
        ),
        symbol.alias("tradingsymbol"),
        "s_suppkey",
        F.col("s_name").alias("name"),
    )
    other = F.col("exchange") == "BSE"
    return rows.select(
        "exchange",
        F.when(other & (F.col("s_suppkey") % 5 == 0), F.concat(F.col("tradingsymbol"), F.lit("-B")))
        .otherwise(F.col("tradingsymbol"))
        .alias("tradingsymbol"),
        F.col("exchange").alias("segment"),
        F.when(F.col("s_suppkey") % 7 == 0, "FUT").otherwise("EQ").alias("instrument_type"),
        F.concat(F.lit("I"), F.col("s_suppkey").cast("string")).alias("isin"),
        "name",
        (F.col("s_suppkey") * 10 + F.when(other, 1).otherwise(0)).alias("instrument_token"),
    )


INSTRUMENTS = """instruments AS (
  SELECT exchange,
         CASE WHEN exchange = 'BSE' AND s_suppkey % 5 = 0 THEN 'SUP' || s_suppkey || '-B' ELSE 'SUP' || s_suppkey END AS tradingsymbol,
         exchange AS segment, CASE WHEN s_suppkey % 7 = 0 THEN 'FUT' ELSE 'EQ' END AS instrument_type,
         'I' || s_suppkey AS isin, s_name AS name,
         s_suppkey * 10 + CASE WHEN exchange = 'BSE' THEN 1 ELSE 0 END AS instrument_token
  FROM supplier, (SELECT unnest(['NSE', 'BSE']) AS exchange)
  WHERE exchange = 'BSE' OR s_suppkey % 2 = 0)"""


def symbols(t: Tables) -> DataFrame:
    """Requested symbols: every supplier plus, for each fifth one, a name no exchange lists."""
    listed = t.supplier.select(F.concat(F.lit(" sup"), F.col("s_suppkey").cast("string"), F.lit(" ")).alias("symbol"))
    missing = t.supplier.filter("s_suppkey % 5 = 1").select(
        F.concat(F.lit("GONE"), F.col("s_suppkey").cast("string")).alias("symbol")
    )
    return listed.unionByName(missing)


SYMBOLS = """symbols AS (
  SELECT 'SUP' || s_suppkey AS symbol FROM supplier
  UNION ALL SELECT 'GONE' || s_suppkey FROM supplier WHERE s_suppkey % 5 = 1)"""


def compare(t: Tables) -> DataFrame:
    """Real-against-shuffled comparison rows, one per part."""
    size = F.col("p_size")
    auc = (size - 25) / 1000
    balanced = (size - 20) / 1000
    return t.part.select(
        F.concat(F.lit("E"), F.col("p_partkey").cast("string")).alias("experiment_id"),
        F.col("p_brand").alias("family"),
        auc.alias("gap_auc"),
        balanced.alias("gap_balanced_accuracy"),
        (auc / 10).alias("gap_spread_top_bottom"),
        ((size - 10) / 1000).alias("gap_ic_spearman"),
        ((size - 22) / 2000).alias("gap_top_decile_net_ret"),
        (0.5 + auc).alias("real_auc"),
        (0.5 + balanced).alias("real_balanced_accuracy"),
        ((size - 15) / 3000).alias("real_spread_top_bottom"),
        ((size - 12) / 4000).alias("real_top_decile_net_ret"),
        ((size - 5) / 2000).alias("real_ic_spearman"),
        F.col("p_retailprice").alias("real_trade_count"),
        F.when(F.col("p_partkey") % 3 == 0, "regression").otherwise("binary").alias("label_type"),
        F.concat(F.lit("T"), (F.col("p_partkey") % 4 + 1).cast("string")).alias("target_id"),
    )


COMPARE = """compare AS (
  SELECT 'E' || p_partkey AS experiment_id, p_brand AS family, (p_size - 25) / 1000 AS gap_auc,
         (p_size - 20) / 1000 AS gap_balanced_accuracy, (p_size - 25) / 1000 / 10 AS gap_spread_top_bottom,
         (p_size - 10) / 1000 AS gap_ic_spearman, (p_size - 22) / 2000 AS gap_top_decile_net_ret,
         0.5::DOUBLE + (p_size - 25) / 1000 AS real_auc, 0.5::DOUBLE + (p_size - 20) / 1000 AS real_balanced_accuracy,
         (p_size - 15) / 3000 AS real_spread_top_bottom, (p_size - 12) / 4000 AS real_top_decile_net_ret,
         (p_size - 5) / 2000 AS real_ic_spearman, p_retailprice AS real_trade_count,
         CASE WHEN p_partkey % 3 = 0 THEN 'regression' ELSE 'binary' END AS label_type,
         'T' || (p_partkey % 4 + 1) AS target_id
  FROM part)"""
