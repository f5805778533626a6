"""The sparse time index of a file: (timestamp, offset) entries that prune what a search reads.

An entry is emitted at the first timestamped line, and then whenever a line's 300-second bucket lies
at least 300 seconds after the last entry's; a terminal entry holds the last line's own time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timestamps import BUCKET_SECONDS, bucket, extract_timestamp
from .records import FILE, byte_offsets

FORCE_EVERY = 50_000


def stamped_offsets(lines: DataFrame) -> DataFrame:
    return byte_offsets(lines).withColumn("time", extract_timestamp(F.col("line"))).where("time is not null")


def build_index(stamped: DataFrame, interval: int = BUCKET_SECONDS) -> DataFrame:
    """(agent, path, timestamp, offset) from (agent, path, pos, time, offset) by one running maximum:
    exact as long as no 50,000 timestamped lines pass between entries."""
    ordered = Window.partitionBy(*FILE).orderBy("pos")
    marked = stamped.withColumn("timestamp", bucket(F.col("time"), interval))
    before = F.max("timestamp").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    return marked.withColumn("__seen", before).where(F.col("__seen").isNull() | (F.col("timestamp") >= F.col("__seen") + interval)).select(*FILE, "timestamp", "offset")


def terminal_entries(stamped: DataFrame) -> DataFrame:
    """Each file's last timestamped line, with its own time."""
    return stamped.groupBy(*FILE).agg(F.max_by("time", "pos").alias("timestamp"), F.max_by("offset", "pos").alias("offset"))


def build_index_exact(stamped: DataFrame, interval: int = BUCKET_SECONDS, force_every: int = FORCE_EVERY) -> DataFrame:
    """The sequential form, with the forced entry after ``force_every`` lines and the terminal entry;
    (agent, path, seq, timestamp, offset)."""

    def fold(lines: pd.DataFrame) -> pd.DataFrame:
        lines = lines.sort_values("pos")
        times, offsets = lines["time"].to_numpy(), lines["offset"].to_numpy()
        marks = times - times % interval
        out, last, since = [], None, 0
        for mark, offset in zip(marks.tolist(), offsets.tolist(), strict=True):
            if last is None or mark >= last + interval or since >= force_every:
                out.append((mark, offset))
                last, since = mark, 0
            since += 1
        out.append((int(times[-1]), int(offsets[-1])))
        return pd.DataFrame({"agent": lines["agent"].iloc[0], "path": lines["path"].iloc[0], "seq": range(len(out)), "timestamp": [t for t, _ in out], "offset": [o for _, o in out]})

    return stamped.select(*FILE, "pos", "time", "offset").groupBy(*FILE).applyInPandas(fold, "agent string, path string, seq int, timestamp bigint, offset bigint")


def extend_index(entries: DataFrame, stamped: DataFrame, interval: int = BUCKET_SECONDS, force_every: int = FORCE_EVERY) -> DataFrame:
    """What build_index_exact() gives for files that have grown, from their ``entries`` of before.

    A file's entries but the last two stay; the fold starts anew at the last one before the terminal entry,
    where its state is that of a first line, so the result equals a new index. Of such files ``stamped`` needs
    the lines from that offset on (resume_offsets()); earlier ones are passed over. Files without entries are
    indexed whole, files without lines keep theirs. Lines indexed before must not have changed: a rotated or
    rewritten file, and any gzip file, goes in without its entries."""
    restart = resume_offsets(entries).withColumnsRenamed({"offset": "__from", "seq": "__seq"})
    grown = stamped.join(restart, FILE, "left").where(F.col("__from").isNull() | (F.col("offset") >= F.col("__from")))
    fresh = build_index_exact(grown, interval, force_every).join(restart, FILE, "left")
    fresh = fresh.withColumn("seq", F.col("seq") + F.coalesce("__seq", F.lit(0))).select(*FILE, "seq", "timestamp", "offset")
    cut = restart.join(grown.select(*FILE).distinct(), FILE).select(*FILE, "__seq")
    kept = entries.join(cut, FILE, "left").where(F.col("__seq").isNull() | (F.col("seq") < F.col("__seq")))
    return kept.select(*FILE, "seq", "timestamp", "offset").unionByName(fresh)


def resume_offsets(entries: DataFrame) -> DataFrame:
    """(agent, path, seq, offset) of each file's last entry before the terminal one, from build_index_exact()."""
    last = entries.groupBy(*FILE).agg((F.max("seq") - 1).alias("seq"))
    return entries.join(last, [*FILE, "seq"]).select(*FILE, "seq", "offset")


def with_times(entries: DataFrame, stamped: DataFrame) -> DataFrame:
    """Adds least and most, the least and greatest time of the lines from an entry to the next one: lines
    may come late, so an entry's own timestamp bounds neither."""
    marks = entries.select(*FILE, "offset", F.col("offset").alias("__at")).distinct()
    before = Window.partitionBy(*FILE).orderBy("offset")
    placed = stamped.join(marks, [*FILE, "offset"], "left").select(*FILE, "time", F.last("__at", ignorenulls=True).over(before).alias("offset"))
    times = placed.groupBy(*FILE, "offset").agg(F.min("time").alias("least"), F.max("time").alias("most"))
    return entries.join(times, [*FILE, "offset"], "left")


def time_bounds(entries: DataFrame) -> DataFrame:
    """(agent, path, start_time, end_time): a file's least and greatest time, from with_times() entries."""
    return entries.groupBy(*FILE).agg(F.min("least").alias("start_time"), F.max("most").alias("end_time"))


def with_sequence(entries: DataFrame) -> DataFrame:
    return entries.withColumn("seq", F.row_number().over(Window.partitionBy(*FILE).orderBy("offset", "timestamp")) - 1)


def probe_index(entries: DataFrame, start: int, end: int) -> DataFrame:
    """(agent, path, start_offset, end_offset) of files with a segment that overlaps [start, end]: from the
    first such segment's start to the last one's end. Entries carry seq."""
    ordered = Window.partitionBy(*FILE).orderBy("seq")
    segments = entries.withColumn("__until", F.lead("timestamp").over(ordered)).withColumn("__to", F.lead("offset").over(ordered))
    hit = segments.where(F.col("__until").isNotNull() & (F.col("timestamp") <= end) & (F.col("__until") >= start))
    return hit.groupBy(*FILE).agg(F.min("offset").alias("start_offset"), F.max("__to").alias("end_offset"))


def probe_many(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """The same for many requests (request_id, start_time, end_time), a small table, at once."""
    ordered = Window.partitionBy(*FILE).orderBy("seq")
    segments = entries.withColumn("__until", F.lead("timestamp").over(ordered)).withColumn("__to", F.lead("offset").over(ordered)).where("__until is not null")
    hit = segments.join(requests, (F.col("timestamp") <= F.col("end_time")) & (F.col("__until") >= F.col("start_time")))
    return hit.groupBy("request_id", *FILE).agg(F.min("offset").alias("start_offset"), F.max("__to").alias("end_offset"))


def file_bounds(entries: DataFrame, order: str = "seq") -> DataFrame:
    """(agent, path, start_time, end_time): a file's first and last entry."""
    return entries.groupBy(*FILE).agg(F.min_by("timestamp", order).alias("start_time"), F.max_by("timestamp", order).alias("end_time"))


def overlapping_files(bounds: DataFrame, start: int, end: int) -> DataFrame:
    """Files whose bounds meet [start, end]; files without bounds are left out."""
    return bounds.where((F.col("end_time") >= start) & (F.col("start_time") <= end))
