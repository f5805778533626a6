"""Assembly of multi-line records from lines (agent, path, pos, line).

A line with a timestamp opens a record; a line without one continues the open record, or is dropped
where none is open. Gaps and islands over one ordering of each file: the window, the grouping and a
later limit share one exchange by (agent, path).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timestamps import extract_timestamp

FILE = ["agent", "path"]


def assemble(lines: DataFrame, tz_offset_seconds: int = 0, default_year: int | None = None, window: tuple[int, int] | None = None) -> DataFrame:
    """(agent, path, rid, time, line), rid counting a file's records from 1.

    With ``window`` = (start, end) records are cut as a one-pass reader of that request would: a line
    earlier than start is dropped without closing the open record, so its continuations join that one.
    The two agree where timestamps never decrease. Without it the result does not depend on a request.
    """
    stamped = lines.withColumn("time", extract_timestamp(F.col("line"), tz_offset_seconds, default_year))
    opens = F.col("time").isNotNull()
    if window is not None:
        stamped = stamped.where(F.col("time").isNull() | (F.col("time") >= window[0]))
    order = Window.partitionBy(*FILE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = stamped.withColumn("rid", F.sum(F.when(opens, 1).otherwise(0)).over(order).cast("bigint")).where("rid > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    records = numbered.groupBy(*FILE, "rid").agg(F.max("time").alias("time"), text.alias("line"))
    return records if window is None else records.where(F.col("time") <= window[1])


def explode_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """(agent, path, pos, line) of whole files; \\n alone ends a line, \\r stays, an ended last line adds none."""
    parts = F.split(content, "\n", -1)
    parts = F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return files.select(*FILE, F.posexplode(parts).alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint"))


def byte_offsets(lines: DataFrame) -> DataFrame:
    """Adds each line's byte offset in its file."""
    order = Window.partitionBy(*FILE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    n = F.octet_length("line") + 1
    return lines.withColumn("offset", (F.sum(n).over(order) - n).cast("bigint"))
