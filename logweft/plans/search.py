"""The search plan: records in a time range that satisfy all queries, capped for each file."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import compile_query, conjunction
from ..operators import catalog, limits, registry, timeindex
from ..operators.records import FILE, assemble
from ..sources.rawlog import RawLog

MAX_RESULTS = 500


@dataclass(frozen=True)
class SearchRequest:
    """``queries``: (query, type) pairs. ``paths`` None: every path below the prefix."""

    queries: tuple[tuple[str, str], ...]
    start_time: int
    end_time: int
    prefix: str = ""
    paths: tuple[str, ...] | None = None
    max_results: int = MAX_RESULTS

    @classmethod
    def from_json(cls, body: dict, prefix: str) -> SearchRequest:
        """From a request body; ValueError where a field is missing or of the wrong kind."""
        try:
            queries = tuple((q["query"], q.get("type", "simple")) for q in body["querys"])
            start, end = int(body["start_time"]), int(body["end_time"])
        except (KeyError, TypeError) as e:
            raise ValueError("a request needs querys[], start_time and end_time") from e
        if not prefix:
            raise ValueError("a request needs a prefix")
        paths = tuple(body["paths"]) if "paths" in body else None
        return cls(queries, start, end, prefix, paths, int(body.get("max_results", MAX_RESULTS)))

    def check(self) -> None:
        """Before anything is planned: queries compile, paths lie below the prefix."""
        if not self.queries:
            raise ValueError("no queries")
        if self.paths is not None:
            if not self.paths:
                raise ValueError("no paths")
            catalog.guard_paths(list(self.paths), self.prefix)
        for query, kind in self.queries:
            compile_query(kind, query)


def matching_records(records: DataFrame, request: SearchRequest) -> DataFrame:
    """Rows of ``records`` (agent, path, rid, time, line) that the request asks for, capped for each file."""
    request.check()
    hit = records.where(F.col("time").between(request.start_time, request.end_time))
    if request.prefix:
        hit = hit.where(F.startswith("path", F.lit(request.prefix)))
    if request.paths is not None:
        hit = hit.where(F.col("path").isin(list(request.paths)))
    return limits.limit_per_file(hit.where(conjunction(request.queries, F.col("line"))), request.max_results)


def raw_records(spark: SparkSession, path: str, request: SearchRequest, agent: str = "", index: str | None = None, **options: str) -> DataFrame:
    """(agent, path, rid, time, line) of raw files, assembled where they are read: no line is shuffled, the
    time range and the words of simple queries are tested in the reader, and an ``index`` file (see rawlog)
    leaves the byte ranges unread that hold no time of the range. rid is the record's offset."""
    spark.dataSource.register(RawLog)
    reader = spark.read.format("rawlog").options(agent=agent, **options)
    found = (reader.option("index", index) if index else reader).load(path)
    found = found.where((F.col("time") >= request.start_time) & (F.col("time") <= request.end_time))
    for query, kind in request.queries:
        if kind == "simple":
            found = found.where(F.col("line").contains(query))
    return found.withColumnRenamed("offset", "rid")


def logged(found: DataFrame) -> DataFrame:
    """The same rows; the executors' logger ``logweft.hits`` gets each at debug level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logger = logging.getLogger("logweft.hits")
        for b in batches:
            if logger.isEnabledFor(logging.DEBUG):
                for r in b.to_pylist():
                    logger.debug("%s %s %s: %s", r["agent"], r["path"], r["time"], r["line"])
            yield b

    return found.mapInArrow(run, found.schema)


class LogSearch:
    """Federated search over lines of many agents; ``entries`` (a time index) only prunes files, by
    the least and greatest time that timeindex.with_times() adds; without these it prunes nothing.

    ``raw`` maps agents to (path, index or None) of raw files that raw_records() reads beside the lines.
    ``observation`` gets the number of records that matched (matched_records) and of files they are in
    (matched_files) once the result has been used; with ``log`` every hit is logged at debug level."""

    def __init__(self, lines: DataFrame | None, files: DataFrame | None = None, agents: DataFrame | None = None, entries: DataFrame | None = None, raw: dict[str, tuple[str, str | None]] | None = None, spark: SparkSession | None = None) -> None:
        self.lines, self.files, self.agents, self.entries, self.raw = lines, files, agents, entries, raw or {}
        self.spark = spark or (lines.sparkSession if lines is not None else SparkSession.getActiveSession())

    def records(self, request: SearchRequest) -> DataFrame:
        """All records that the request may concern, from lines and raw files."""
        parts = [raw_records(self.spark, path, request, agent, index) for agent, (path, index) in self.raw.items()]
        if self.lines is not None:
            lines = self.lines
            if request.prefix:
                lines = lines.where(F.startswith("path", F.lit(request.prefix)))
            if request.paths is not None:
                lines = lines.where(F.col("path").isin(list(request.paths)))
            if self.entries is not None and {"least", "most"} <= set(self.entries.columns):
                kept = timeindex.overlapping_files(timeindex.time_bounds(self.entries), request.start_time, request.end_time)
                lines = lines.join(kept.select(*FILE), FILE, "left_semi")
            parts.append(assemble(lines).select(*FILE, "rid", "time", "line"))
        return reduce(DataFrame.unionByName, [p.select(*FILE, "rid", "time", "line") for p in parts])

    def search(self, request: SearchRequest, now: int | None = None, observation: Observation | None = None, log: bool = False) -> DataFrame:
        """(agent, path, status, error_msg, start_time, end_time, n_lines, lines), in response order; files
        without hits have no row."""
        request.check()
        records = self.records(request)
        if self.agents is not None and now is not None:
            records = records.join(registry.active(self.agents, now).select(F.col("agent_id").alias("agent")), "agent", "left_semi")
        found = matching_records(records, request)
        if log:
            found = logged(found)
        out = limits.response_order(limits.group_by_file(found))
        if observation is not None:  # above the sort, which may run what is below it twice
            out = out.observe(observation, F.coalesce(F.sum("n_lines"), F.lit(0)).alias("matched_records"), F.count(F.lit(1)).alias("matched_files"))
        return out

    def list(self, prefix: str, roots: list[catalog.Root]) -> DataFrame:
        """(path, size, mtime, etag, start_time, end_time) below a prefix; no times without an index."""
        if self.files is None:
            raise ValueError("no catalog")
        seen = catalog.list_prefix(self.files, prefix, roots)
        t = F.col("file_index.time_indexes")
        has = F.size(t) > 0
        return seen.select(F.col("fullpath").alias("path"), "size", "mtime", "etag", F.when(has, F.get(t, F.lit(0))["timestamp"]).alias("start_time"), F.when(has, F.element_at(t, -1)["timestamp"]).alias("end_time"))
