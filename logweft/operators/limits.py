"""Per-file limits, grouping of hits by file, and the order of a response."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILE = ["agent", "path"]


def limit_per_file(records: DataFrame, most: int) -> DataFrame:
    """The first ``most`` records of each file, in file order."""
    place = F.row_number().over(Window.partitionBy(*FILE).orderBy("rid"))
    return records.withColumn("__n", place).where(F.col("__n") <= most).drop("__n")


def group_by_file(records: DataFrame) -> DataFrame:
    """One row a file: its lines in file order; start and end are the first and last hit in that order,
    not the least and greatest time."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rid", "line", "time"))), lambda x: F.struct(x["line"].alias("line"), x["time"].alias("time")))
    return records.groupBy(*FILE).agg(F.lit(0).alias("status"), F.lit("").alias("error_msg"), F.min_by("time", "rid").alias("start_time"), F.max_by("time", "rid").alias("end_time"), F.count(F.lit(1)).alias("n_lines"), lines.alias("lines"))


def response_order(grouped: DataFrame) -> DataFrame:
    return grouped.orderBy(F.col("start_time").asc_nulls_first(), *FILE)


def files_by_agent(files: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent_id, address, paths, n_files): the files that each known agent is asked for."""
    joined = files.join(agents, "agent_id")
    return joined.groupBy("agent_id", "address").agg(F.array_sort(F.collect_list("fullpath")).alias("paths"), F.count(F.lit(1)).alias("n_files")).orderBy("agent_id")
