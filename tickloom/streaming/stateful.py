"""Stateful forms of live feeds: minute bars whose late ticks go to a side output, and open reconnect gaps.

Both keep their state per key in the RocksDB store, set timers on event time, and drop the state when a timer fires, so it
holds open minutes and unfinished gaps only. The watermark reaches ``keep`` back; a bar closes earlier, ``delay`` after its
end, so ticks between the two are late and are reported, and only ticks older than ``keep`` are not seen at all.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

BAR = (
    "kind string, instrument string, minute timestamp, open double, high double, low double, close double, last_quantity_sum bigint, "
    "last_seen_day_volume bigint, tick_count bigint, first_tick_time timestamp, last_tick_time timestamp, event_id bigint, ts timestamp, price double, last_qty bigint, day_volume bigint"
)
_SLOT = "open double, open_ts bigint, open_id bigint, high double, low double, close double, close_ts bigint, close_id bigint, quantity bigint, volume bigint, n bigint"
GAP = "trade_date date, opened timestamp, closed timestamp, gap_minutes double"


def names_of(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]


def micros(column: str):
    return F.unix_micros(F.col(column))


def stamp(us: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(us / 1_000_000, dt.timezone.utc).replace(tzinfo=None)


class Bars(StatefulProcessor):
    """Open minutes of one instrument by their start; a timer for each closes it."""

    def __init__(self, width: int, delay: int, keep: int):
        self.width, self.lead = width, (delay - keep) // 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "minute bigint", _SLOT)

    def _closes(self, minute: int) -> int:
        """The watermark, in milliseconds, at which a minute is closed."""
        return (minute + self.width) // 1000 + self.lead

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed_to = timerValues.getCurrentWatermarkInMs()
        late, slots = [], {}
        for frame in rows:
            for t in frame.sort_values(["us", "event_id"]).itertuples(index=False):
                minute = t.us - t.us % self.width
                if closed_to >= 0 and self._closes(minute) <= closed_to:
                    late.append(t)
                    continue
                if minute not in slots:
                    found = self.slots.getValue((minute,)) if self.slots.containsKey((minute,)) else None
                    if found is None:
                        self.handle.registerTimer(max(self._closes(minute), 1))
                    slots[minute] = list(found) if found is not None else None
                self._take(slots, minute, t)
        for minute, slot in slots.items():
            self.slots.updateValue((minute,), tuple(slot))
        if late:
            own = pd.DataFrame(late)
            minute = own["us"] - own["us"] % self.width
            yield self._shaped(key[0], "late", minute, own.assign(ts=[stamp(u) for u in own["us"]])[["event_id", "ts", "price", "last_qty", "day_volume"]])

    @staticmethod
    def _take(slots: dict, minute: int, t) -> None:
        at, none = (int(t.us), int(t.event_id)), lambda x: None if pd.isna(x) else x
        price, quantity, volume = none(t.price), none(t.last_qty), none(t.day_volume)
        slot = slots[minute]
        if slot is None:
            slots[minute] = [price, *at, price, price, price, *at, None if quantity is None else int(quantity), None if volume is None else int(volume), 1]
            return
        if at < (slot[1], slot[2]):
            slot[0:3] = [price, *at]
        if at >= (slot[6], slot[7]):
            slot[5:8] = [price, *at]
            slot[9] = None if volume is None else int(volume)
        if price is not None:
            slot[3] = price if slot[3] is None else max(slot[3], price)
            slot[4] = price if slot[4] is None else min(slot[4], price)
        if quantity is not None:
            slot[8] = int(quantity) + (slot[8] or 0)
        slot[10] += 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired = expiredTimerInfo.getExpiryTimeInMs()
        for (minute,), s in [(k, v) for k, v in self.slots.iterator()]:
            if max(self._closes(minute), 1) <= fired:
                self.slots.removeKey((minute,))
                yield self._shaped(key[0], "bar", pd.Series([minute]), pd.DataFrame([{
                    "open": s[0], "high": s[3], "low": s[4], "close": s[5], "last_quantity_sum": s[8], "last_seen_day_volume": s[9],
                    "tick_count": s[10], "first_tick_time": stamp(s[1]), "last_tick_time": stamp(s[6])}]))

    @staticmethod
    def _shaped(instrument: str, kind: str, minute: pd.Series, values: pd.DataFrame) -> pd.DataFrame:
        out = values.assign(kind=kind, instrument=instrument, minute=[stamp(int(m)) for m in minute])
        return out.reindex(columns=names_of(BAR)).astype(object).where(lambda d: d.notna(), None)

    def close(self) -> None:
        pass


def bars_and_late_ticks(ticks: DataFrame, window_seconds: int = 60, delay_seconds: int = 120, keep: str = "1 day", keep_seconds: int = 86_400) -> DataFrame:
    """Rows of ``kind`` bar, one when a minute closes, and of ``kind`` late, one for each tick of a closed minute."""
    needs_rocksdb(ticks.sparkSession)
    slim = ticks.select("instrument", "event_id", micros("ts").alias("us"), "price", "last_qty", "day_volume", "ts").withWatermark("ts", keep)
    processor = Bars(window_seconds * 1_000_000, delay_seconds * 1_000_000, keep_seconds * 1_000_000)
    return slim.groupBy("instrument").transformWithStateInPandas(processor, BAR, "Append", "EventTime")


class Gaps(StatefulProcessor):
    """Events of one day wait until the watermark has passed them, so they are taken in order whatever their arrival."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us bigint, event_id bigint", "failure boolean")
        self.opened = handle.getValueState("opened", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for e in frame.itertuples(index=False):
                self.waiting.updateValue((int(e.us), int(e.event_id)), (bool(e.failure),))
                self.handle.registerTimer(int(e.us) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((tuple(k), v[0]) for k, v in self.waiting.iterator() if k[0] // 1000 + 1 <= until)
        gaps = []
        for (us, event), failure in due:
            self.waiting.removeKey((us, event))
            if failure:
                if not self.opened.exists():
                    self.opened.update((us,))
                    self.handle.registerTimer(_day_end(us))
            elif self.opened.exists():
                start = self.opened.get()[0]
                self.opened.clear()
                gaps.append((key[0], stamp(start), stamp(us), (us - start) / 60e6))
        if self.opened.exists() and until >= _day_end(self.opened.get()[0]):
            self.opened.clear()  # a gap still open at the end of its day never closes
        if gaps:
            yield pd.DataFrame(gaps, columns=names_of(GAP))

    def close(self) -> None:
        pass


def _day_end(us: int) -> int:
    day = 86_400_000
    return (us // 1000 // day + 1) * day


def reconnect_gap_stream(events: DataFrame, openers: tuple[str, ...], delay: str = "10 minutes") -> DataFrame:
    """One row for each closed reconnect gap, when the watermark has passed the connect that closes it."""
    needs_rocksdb(events.sparkSession)
    kept = events.filter(F.col("event_type").isin(*openers, "connect"))
    slim = kept.select(F.to_date("event_utc").alias("trade_date"), micros("event_utc").alias("us"), "event_id", (F.col("event_type") != "connect").alias("failure"), "event_utc")
    return slim.withWatermark("event_utc", delay).groupBy("trade_date").transformWithStateInPandas(Gaps(), GAP, "Append", "EventTime")


def needs_rocksdb(spark: SparkSession) -> None:
    if spark.conf.get(PROVIDER) != ROCKS:
        raise ValueError(f"set {PROVIDER} to {ROCKS}: timers and map state are kept in RocksDB")
