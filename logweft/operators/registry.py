"""The registry of agents: an announcement keeps an agent active for 60 seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import agent_id

TTL_SECONDS = 60


def registry(announcements: DataFrame) -> DataFrame:
    """(agent_id, address, last_announce) from (agent_addr, ts)."""
    last = announcements.groupBy("agent_addr").agg(F.max("ts").alias("last_announce"))
    return last.select(agent_id(F.col("agent_addr")).alias("agent_id"), F.col("agent_addr").alias("address"), "last_announce")


def active(agents: DataFrame, now: int, ttl: int = TTL_SECONDS) -> DataFrame:
    return agents.where(F.lit(now) - F.col("last_announce") <= ttl)


class AgentRegistry:
    """Announcements held as a table; every call gives a new DataFrame."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.rows: dict[str, int] = {}

    def announce(self, address: str, ts: int) -> None:
        if not address:
            raise ValueError("no agent address")
        self.rows[address] = ts

    def agents(self) -> DataFrame:
        return registry(self.spark.createDataFrame(list(self.rows.items()), "agent_addr string, ts bigint"))

    def active(self, now: int) -> DataFrame:
        return active(self.agents(), now)

    def expire(self, now: int, ttl: int = TTL_SECONDS) -> None:
        self.rows = {a: t for a, t in self.rows.items() if now - t <= ttl}
