"""Session memory with a time to live, as a stateful stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import ship

OUT = "session_id string, turn long, ts timestamp, scheme_used string"


def remembered_schemes(turns: DataFrame, ttl_s: int = 1800, lateness: str = "10 minutes") -> DataFrame:
    """A stream of turns (session_id string, turn long, ts timestamp, scheme string, remembered boolean) -> each with the scheme that holds.

    State is one scheme and the time of its last refresh for each session; it expires by event time once the watermark has passed ttl_s after it, so
    the state store holds live sessions only. Within a trigger a session's turns are taken in the order of ts, then turn.
    """

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        scheme, at = state.get if state.exists else (None, None)
        rows = []
        for r in pd.concat(list(parts)).sort_values(["ts", "turn"]).itertuples(index=False):
            now = r.ts.timestamp()
            if at is not None and now - at > ttl_s:
                scheme, at = None, None
            own = r.scheme if isinstance(r.scheme, str) and r.scheme else None
            rows.append((key[0], r.turn, r.ts, own or scheme))
            if r.remembered:
                scheme, at = own or scheme, now
        if at is not None:
            state.update((scheme, at))
            state.setTimeoutTimestamp(max(int((at + ttl_s) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["session_id", "turn", "ts", "scheme_used"])

    return turns.withWatermark("ts", lateness).groupBy("session_id").applyInPandasWithState(step, OUT, "scheme string, at double", "append", GroupStateTimeout.EventTimeTimeout)


def request_counts(requests: DataFrame, client: str = "client", lateness: str = "10 minutes") -> DataFrame:
    """Requests of each client and minute, final once the watermark has passed the minute."""
    return requests.withWatermark("ts", lateness).groupBy(F.window("ts", "1 minute").alias("w"), client).count().select(F.col("w.start").alias("minute"), client, "count")


# ---- in the order of events, however they arrive

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _by_state(rows: DataFrame, processor: StatefulProcessor, out: str, *keys: str) -> DataFrame:
    spark = rows.sparkSession
    ship(spark)
    # the process at the driver that prepares such a stream reads no shipped package: what it needs of this module goes along with the processor
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # timers and lists need a store with column families
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")


class _Pending(StatefulProcessor):
    """Holds rows (order, ts in microseconds, and more) until the watermark has passed them, then hands them to settled() in the order of time and order."""

    fields: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.fields)

    def due(self, ts: int) -> int:
        """Milliseconds of the timer of a row: rows up to it are complete when it fires."""
        return ts // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            values = [self.row(r) for r in part.itertuples(index=False)]
            self.pending.appendList(values)
            first = min([self.due(v[1]) for v in values] + ([] if first is None else [first]))
        if first is not None:
            self.handle.registerTimer(first)
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All that the watermark has passed comes out at once; the next timer is that of the first row that is left."""
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.pending.get()]
        ready = sorted((r for r in rows if self.due(r[1]) <= now), key=lambda r: (r[1], r[0]))
        if not ready:
            return
        rest = [r for r in rows if self.due(r[1]) > now]
        if rest:
            self.pending.put(rest)
            self.handle.registerTimer(min(self.due(r[1]) for r in rest))
        else:
            self.pending.clear()
        yield pd.DataFrame(self.settled(key, ready), columns=self.columns)


def _micros(ts: pd.Timestamp) -> int:
    return ts.value // 1000


class _Memory(_Pending):
    fields, columns = "turn long, us long, scheme string, remembered boolean", ["session_id", "turn", "ts", "scheme_used"]

    def __init__(self, ttl_s: int):
        self.ttl = ttl_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.memory = handle.getValueState("memory", "scheme string, us long")

    def row(self, r) -> tuple:
        return r.turn, _micros(r.ts), r.scheme if isinstance(r.scheme, str) and r.scheme else None, bool(r.remembered)

    def settled(self, key, rows: list[tuple]) -> list[tuple]:
        scheme, at = self.memory.get() if self.memory.exists() else (None, None)
        out = []
        for turn, us, own, remembered in rows:
            if at is not None and round(us / 1e6) - round(at / 1e6) > self.ttl // 1_000_000:
                scheme, at = None, None
            out.append((key[0], turn, pd.Timestamp(us, unit="us"), own or scheme))
            if remembered:
                scheme, at = own or scheme, us
        if at is None:
            self.memory.clear()
        else:
            self.memory.update((scheme, at))
            self.handle.registerTimer((at + self.ttl) // 1000 + 1001)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        if self.memory.exists() and not self.pending.exists():
            at = self.memory.get()[1]
            if timerValues.getCurrentWatermarkInMs() > (at + self.ttl) // 1000 + 1000:
                self.memory.clear()


def remembered_in_order(turns: DataFrame, ttl_s: int = 1800, lateness: str = "10 minutes") -> DataFrame:
    """As converse.carried with a time, of a stream: turns (session_id string, turn long, ts timestamp, scheme string, remembered boolean) -> each with the scheme that holds.

    A turn is held until the watermark has passed it, and a session's turns are then taken in the order of ts and turn, so what comes out doesn't depend on
    the order of arrival; turns that come behind the watermark are dropped. Times count to the nearest second. State is a session's open turns, its scheme and the time of its last
    refresh; timers by event time let go of both.
    """
    rows = turns.withWatermark("ts", lateness).select("session_id", "turn", "ts", "scheme", "remembered")
    return _by_state(rows, _Memory(ttl_s), "session_id string, turn long, ts timestamp, scheme_used string", "session_id")


def admitted_stream(requests: DataFrame, limit: int = 30, lateness: str = "10 minutes") -> DataFrame:
    """As converse.admitted, of a stream: requests (client string, request long, ts timestamp) -> each with its minute and whether it is one of the first `limit` of its client and minute.

    A minute's requests come out once the watermark has passed the minute, by ts and request; those that come later are dropped. State is the requests of
    each client's open minutes, in a group of its own for each minute: an aggregate of built-in functions, no Python.
    """
    minutes = requests.withWatermark("ts", lateness).groupBy(F.window("ts", "1 minute").alias("w"), "client").agg(F.array_sort(F.collect_list(F.struct("ts", "request"))).alias("all"))
    each = minutes.select("client", F.col("w.start").alias("minute"), F.posexplode("all").alias("k", "x"))
    return each.select("client", "minute", "x.ts", "x.request", (F.col("k") < limit).alias("admitted"))
