from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from logweft.operators import catalog
from logweft.streaming.heartbeat import heartbeat_stream, sessions
from logweft.streaming.tail import follow, maintain, refresh_catalog, tail


def test_tail_appends_partial_lines_and_rotation(spark: SparkSession, tmp_path: Path) -> None:
    log, out, mark = tmp_path / "logs" / "a.log", str(tmp_path / "out"), str(tmp_path / "mark")
    log.parent.mkdir()

    def turn() -> list[tuple[int, str]]:
        follow(tail(spark, str(log.parent), "h"), out, mark).awaitTermination(120)
        return sorted((r.offset, r.line) for r in spark.read.parquet(out).collect())

    log.write_bytes(b"2024-01-01 00:00:00 one\ntwo\nhalf")
    first = [(0, "2024-01-01 00:00:00 one"), (24, "two")]
    assert turn() == first
    with log.open("ab") as f:
        f.write(b" done\nthree\n")
    second = [*first, (28, "half done"), (38, "three")]
    assert turn() == second
    log.rename(tmp_path / "a.old")
    log.write_bytes(b"new\n")
    assert turn() == sorted([*second, (0, "new")])


def test_heartbeats(spark: SparkSession, tmp_path: Path) -> None:
    source, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([("a", 5), ("a", 9), ("b", 7)], "agent_addr string, ts bigint").write.json(str(source))
    stream = heartbeat_stream(spark.readStream.schema("agent_addr string, ts bigint").json(str(source)), ttl_seconds=2)
    kept: list = []
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: kept.extend(df.collect())).option("checkpointLocation", out).trigger(processingTime="1 second").start()
    try:
        end = time.monotonic() + 90
        while sum(not r.active for r in kept) < 2 and time.monotonic() < end:
            time.sleep(0.5)
    finally:
        query.stop()
    got = [(r.agent_addr, r.last_announce, r.active) for r in kept]
    assert sorted(got) == [("a", 9, False), ("a", 9, True), ("b", 7, False), ("b", 7, True)]
    assert all(got.index((a, t, True)) < got.index((a, t, False)) for a, t in (("a", 9), ("b", 7)))


def test_sessions(spark: SparkSession) -> None:
    beats = spark.createDataFrame([("a", t) for t in (0, 10, 50, 200, 210)] + [("b", 5)], "agent_addr string, ts bigint")
    assert sorted((r.agent_addr, r.beats) for r in sessions(beats).collect()) == [("a", 2), ("a", 3), ("b", 1)]


def test_refresh(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "x.log").write_text("a")
    root = catalog.Root(str(tmp_path))
    asked: list[int] = []

    def reindex(rows):  # noqa: ANN001, ANN202
        asked.append(rows.count())
        entry = F.array(F.struct(F.lit(1).cast("bigint").alias("timestamp"), F.lit(0).cast("bigint").alias("offset")))
        return rows.select("fullpath", F.struct(F.col("etag").alias("index_etag"), F.lit(1).cast("bigint").alias("last_index_time"), entry.alias("time_indexes")).cast(catalog.INDEX).alias("file_index"))

    first = refresh_catalog(spark, [root], None, reindex)
    first.write.parquet(str(tmp_path.parent / f"{tmp_path.name}-cat"))
    old = spark.read.parquet(str(tmp_path.parent / f"{tmp_path.name}-cat"))
    refresh_catalog(spark, [root], old, reindex).collect()
    assert asked == [1, 0]
    cache = str(tmp_path.parent / f"{tmp_path.name}-cache")
    assert maintain(spark, [root], cache, reindex, every_seconds=0, turns=3) == 1  # nothing new after the first turn
    (tmp_path / "y.log").write_text("b")
    assert maintain(spark, [root], cache, reindex, every_seconds=0, turns=1) == 1
    assert {r.name for r in catalog.load_cache(spark, cache).collect()} == {"x.log", "y.log"}
    assert maintain(spark, [catalog.Root(str(tmp_path / "other"))], cache, reindex, every_seconds=0, turns=1) == 1
    assert catalog.load_cache(spark, cache).count() == 0  # a root that is no longer configured
