"""Whole-file readers: plain and gzip logs as lines, through Spark's own text source and codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import explode_lines


def read_lines(spark: SparkSession, path: str, agent: str = "") -> DataFrame:
    """(agent, path, pos, line) of all files at ``path``. A file is one row before it is cut into lines,
    which gives exact positions; for files beyond memory use the rawlog source."""
    files = spark.read.text(path, wholetext=True).select(F.lit(agent).alias("agent"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return explode_lines(files.withColumn("path", F.regexp_replace(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/+", "/")))


def union_agents(per_agent: dict[str, DataFrame]) -> DataFrame:
    """Rows of all agents, each tagged with its agent."""
    out = None
    for agent, rows in per_agent.items():
        tagged = rows.withColumn("agent", F.lit(agent))
        out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise ValueError("no agents")
    return out
