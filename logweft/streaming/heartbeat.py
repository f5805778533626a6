"""Heartbeats as a stream: announcements keep an agent in keyed state for 60 seconds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "agent_addr string, last_announce bigint, active boolean"


class Heartbeats(StatefulProcessor):
    """Emits an agent when it announces itself, and once more, inactive, when its time has run out."""

    def __init__(self, ttl_seconds: int = 60) -> None:
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        newest = max(int(r["ts"].max()) for r in rows)
        if self.last.exists():
            newest = max(newest, self.last.get()[0])
        self.last.update((newest,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl * 1000)
        yield pd.DataFrame({"agent_addr": [key[0]], "last_announce": [newest], "active": [True]})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        newest = self.last.get()[0] if self.last.exists() else 0
        self.last.clear()
        yield pd.DataFrame({"agent_addr": [key[0]], "last_announce": [newest], "active": [False]})

    def close(self) -> None:
        pass


def heartbeat_stream(announcements: DataFrame, ttl_seconds: int = 60) -> DataFrame:
    """(agent_addr, last_announce, active) changes from a stream (agent_addr, ts). Needs the RocksDB state
    store (spark.sql.streaming.stateStore.providerClass)."""
    return announcements.groupBy("agent_addr").transformWithStateInPandas(statefulProcessor=Heartbeats(ttl_seconds), outputStructType=OUTPUT, outputMode="Update", timeMode="ProcessingTime")


def sessions(announcements: DataFrame, gap: str = "60 seconds") -> DataFrame:
    """Unbroken stretches of an agent's heartbeats, from (agent_addr, ts); batch or stream."""
    at = F.timestamp_seconds("ts").alias("at")
    timed = announcements.select("agent_addr", at).withWatermark("at", gap) if announcements.isStreaming else announcements.select("agent_addr", at)
    return timed.groupBy("agent_addr", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("beats"))
