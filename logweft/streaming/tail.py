"""Following growing logs, and keeping their catalog up to date."""

from __future__ import annotations

from collections.abc import Callable
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import catalog
from ..sources.rawlog import RawLog

SCAN_SECONDS = 60


def tail(spark: SparkSession, path: str, agent: str = "", tz_offset_seconds: int = 0) -> DataFrame:
    """A stream of whole lines of the files at ``path`` as they grow."""
    spark.dataSource.register(RawLog)
    return spark.readStream.format("rawlog").option("agent", agent).option("tz_offset_seconds", str(tz_offset_seconds)).load(path)


def follow(stream: DataFrame, out: str, checkpoint: str, every_seconds: int | None = None) -> StreamingQuery:
    """Writes the stream's lines as Parquet; without an interval it takes what is there and ends."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{every_seconds} seconds") if every_seconds else writer.trigger(availableNow=True)).start()


def refresh_catalog(spark: SparkSession, roots: list[catalog.Root], old: DataFrame | None, reindex: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One turn of the maintenance loop: scan, upsert, vacuum, and new indexes for what changed.
    ``reindex`` maps rows of the catalog to (fullpath, file_index)."""
    scan = catalog.scan_roots(spark, roots)
    empty = spark.createDataFrame([], f"{scan.schema.simpleString()[7:-1].replace(':', ' ')}, file_index {catalog.INDEX}")
    merged = catalog.vacuum(catalog.upsert(old if old is not None else empty, scan), scan)
    fresh = reindex(catalog.to_reindex(merged)).withColumnRenamed("file_index", "__new")
    joined = merged.join(fresh, "fullpath", "left")
    return joined.withColumn("file_index", F.coalesce("__new", "file_index")).drop("__new")


def maintain(spark: SparkSession, roots: list[catalog.Root], cache: str, reindex: Callable[[DataFrame], DataFrame], every_seconds: float = SCAN_SECONDS, turns: int | None = None, stop: Event | None = None) -> int:
    """The maintenance loop: loads the cached catalog, if there is one, with what is still configured and
    there; then, every ``every_seconds``, a turn of refresh_catalog() whose result becomes the cache. Ends
    after ``turns``, or when ``stop`` is set; gives the number of turns that wrote."""
    known = spark.createDataFrame([(r.path,) for r in roots], "path string")
    stop, wrote, done = stop or Event(), 0, 0
    while not stop.is_set():
        old = catalog.load_cache(spark, cache)
        if old is not None and not done:
            old = catalog.reload_cache(old, catalog.scan_roots(spark, roots), known)
        wrote += catalog.write_cache(refresh_catalog(spark, roots, old, reindex), cache)
        done += 1
        if done == turns:
            break
        stop.wait(every_seconds)
    return wrote
