"""States with a clock: cooldowns that run out and alerts that may be repeated after a while.

Both take rows in order of event time: rows of a micro-batch wait in the state until the watermark has passed them, so batches may come shuffled within the allowed lateness; later rows are dropped. A key's rows are read
piece by piece, and its state holds what waits and a few numbers. The state store must be RocksDB (STORE). Rows that wait when a stream ends stay in its state; a row whose time is far ahead lets the watermark pass them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _InOrder(StatefulProcessor):
    """Rows wait in a map by (time, number) until a timer at their time fires; settle() then takes them in order."""

    waiting_schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "micros long, number long", self.waiting_schema)
        self.own(handle)

    def own(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def settle(self, key: tuple, micros: int, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def expired(self, key: tuple, millis: int) -> list[tuple]:
        """Rows for a timer that no waiting row asked for."""
        return []

    def output(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for piece in rows:
            for row in piece.itertuples(index=False):
                micros = row.at.value // 1000
                if micros // 1000 < passed:
                    continue  # later than allowed
                number = row.number
                while self.waiting.containsKey((micros, number)):
                    number += 1 << 40  # rows that share time and number
                self.waiting.updateValue((micros, number), self.held(row))
                self.handle.registerTimer(micros // 1000 + 1)
        yield self.output([])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((k for k in self.waiting.keys() if k[0] // 1000 < until))
        out = []
        for micros, number in due:
            out += self.settle(key, micros, self.waiting.getValue((micros, number)))
            self.waiting.removeKey((micros, number))
        if not due:
            out = self.expired(key, until)
        yield self.output(out)

    def close(self) -> None:
        pass


class _Cooldowns(_InOrder):
    waiting_schema = "ok boolean"
    columns = ["source_id", "at", "event", "strikes", "rate_factor", "cooldown_minutes"]

    def __init__(self, base: float, multiplier: float, cap: float, recovery: float, least: float):
        self.base, self.multiplier, self.cap, self.recovery, self.least = base, multiplier, cap, recovery, least

    def own(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ladder", "strikes int, factor double, until long")

    def held(self, row: Any) -> tuple:
        return (bool(row.ok),)

    def settle(self, key: tuple, micros: int, row: tuple) -> list[tuple]:
        strikes, factor, until = self.state.get() if self.state.exists() else (0, 1.0, 0)
        ran_out = [(key[0], pd.Timestamp(until, unit="ms"), "active", strikes, factor, 0.0)] if until and until * 1000 <= micros else []  # its timer would only fire after this row's
        if row[0]:
            strikes, factor, minutes = 0, min(1.0, factor * self.recovery), 0.0
            new = 0
        else:
            strikes, factor = strikes + 1, max(self.least, factor / 2)
            minutes = min(self.cap, self.base * self.multiplier ** min(strikes - 1, 60))
            new = micros // 1000 + int(minutes * 60_000)
        if until and until != new:
            self.handle.deleteTimer(until)
        if new:
            self.handle.registerTimer(new)
        self.state.update((strikes, factor, new))
        return [*ran_out, (key[0], pd.Timestamp(micros, unit="us"), "success" if row[0] else "failure", strikes, factor, minutes)]

    def expired(self, key: tuple, millis: int) -> list[tuple]:
        strikes, factor, until = self.state.get() if self.state.exists() else (0, 1.0, 0)
        if until != millis:
            return []
        self.state.update((strikes, factor, 0))
        return [(key[0], pd.Timestamp(millis, unit="ms"), "active", strikes, factor, 0.0)]


def cooldowns(outcomes: DataFrame, late: str = "1 hour", base_minutes: float = 60, multiplier: float = 2, cap_minutes: float = 72 * 60, recovery: float = 1.5, least_factor: float = 0.25) -> DataFrame:
    """source_id, at, event, strikes, rate_factor, cooldown_minutes of a stream (source_id, at, ok): a row per outcome (success or failure), as scheduling.cooldown_ladder has them, and one (active) when a cooldown runs out.

    Outcomes of one source and time are taken failures first. The time of an active row is that at which the cooldown ends, in whole milliseconds.
    """
    rows = outcomes.select(F.col("source_id").cast("string").alias("source_id"), "at", F.col("ok").cast("int").cast("long").alias("number"), "ok").withWatermark("at", late)
    return rows.groupBy("source_id").transformWithStateInPandas(
        _Cooldowns(base_minutes, multiplier, cap_minutes, recovery, least_factor), "source_id string, at timestamp, event string, strikes int, rate_factor double, cooldown_minutes double", "Append", "EventTime")


class _Alerts(_InOrder):
    waiting_schema = "id long"
    columns = ["key", "at", "id"]

    def __init__(self, seconds: float):
        self.micros = int(seconds * 1_000_000)

    def own(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "micros long")

    def held(self, row: Any) -> tuple:
        return (int(row.number),)

    def settle(self, key: tuple, micros: int, row: tuple) -> list[tuple]:
        if self.last.exists() and micros - self.last.get()[0] < self.micros:
            return []
        if self.last.exists():
            self.handle.deleteTimer(self.frees(self.last.get()[0]))
        self.last.update((micros,))
        self.handle.registerTimer(self.frees(micros))
        return [(key[0], pd.Timestamp(micros, unit="us"), row[0])]

    def frees(self, micros: int) -> int:
        return (micros + self.micros) // 1000 + 2

    def expired(self, key: tuple, millis: int) -> list[tuple]:
        if self.last.exists() and self.frees(self.last.get()[0]) == millis:
            self.last.clear()  # a quiet key needs no state
        return []


def alerts_apart(alerts: DataFrame, key: str, time: str, tie: str, seconds: float, late: str = "1 hour") -> DataFrame:
    """key, at, id of a stream of alerts: those at least `seconds` after the last one of their key that was let through, as queues.without_repeats has them. tie (a long) orders alerts of one time."""
    rows = alerts.select(F.col(key).cast("string").alias("key"), F.col(time).alias("at"), F.col(tie).cast("long").alias("number")).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(_Alerts(seconds), "key string, at timestamp, id long", "Append", "EventTime")
