"""The registered queries of the search engine, each with equivalent SQL.

The tables hold no log files, so ``events`` is rendered as log lines: one file for each agent and event
type, positions by event_id. Multi-line text comes from ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates, text
from ..functions.hashing import agent_id, etag
from ..functions.timestamps import bucket, extract_timestamp, format_timestamp, wall_seconds
from ..operators import catalog, limits, records, registry, timeindex
from ..sources.text import union_agents
from .search import LogSearch, SearchRequest, matching_records

START, END = 1704200000, 1705200000
NOW = 1706500000
Query = Callable[[SparkSession, str], DataFrame]

L = r"""L AS (SELECT event_id AS pos, 'agent' || (user_id % 4) AS agent, '/logs/' || event_type || '.log' AS path, cast(floor(epoch(ts)) AS BIGINT) AS time,
    strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || event_type || '] user=' || user_id || ' props=' || props AS line FROM events)"""
D = r"""D AS (SELECT 'agent' || (doc_id % 4) AS agent, '/docs/' || doc_id || '.txt' AS path, text AS content FROM documents),
    P AS (SELECT agent, path, CASE WHEN content = '' THEN [] WHEN string_split(content, chr(10))[-1] = '' THEN string_split(content, chr(10))[:-2] ELSE string_split(content, chr(10)) END AS parts FROM D),
    X AS (SELECT agent, path, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM P)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, agent, path, time, line)."""
    e = table(spark, sf_dir, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), "event_type", F.lit("] user="), "user_id", F.lit(" props="), "props")
    return e.select(F.col("event_id").alias("pos"), F.concat(F.lit("agent"), F.col("user_id") % 4).alias("agent"), F.concat(F.lit("/logs/"), "event_type", F.lit(".log")).alias("path"), wall_seconds(F.col("ts")).alias("time"), line.alias("line"))


def single_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered lines as records: every line has a timestamp, so each is a record of its own."""
    return rendered(spark, sf_dir).select("agent", "path", F.col("pos").alias("rid"), extract_timestamp(F.col("line")).alias("time"), "line")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return records.explode_lines(d.select(F.concat(F.lit("agent"), F.col("doc_id") % 4).alias("agent"), F.concat(F.lit("/docs/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content")))


def search_with(*queries: tuple[str, str], start: int = START, end: int = END, most: int = 1 << 40) -> Query:
    return lambda spark, sf_dir: matching_records(single_records(spark, sf_dir), SearchRequest(queries, start, end, max_results=most)).select("agent", "path", F.col("rid").alias("pos"), "time", "line")


def search_sql(where: str, start: int = START, end: int = END) -> str:
    return f"WITH {L} SELECT agent, path, pos, time, line FROM L WHERE time BETWEEN {start} AND {end} AND {where}"


def render_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark, sf_dir)


def ts_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark, sf_dir).select("pos", extract_timestamp(F.col("line")).alias("time"))


def ts_extract_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss", "MMM dd HH:mm:ss"]
    stamp = F.get(F.array(*[F.date_format("ts", f) for f in forms]), (F.col("event_id") % 5).cast("int"))
    return e.select("event_id", extract_timestamp(F.concat(F.lit("<"), stamp, F.lit("> "), "event_type")).alias("time"))


def ts_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bucket(F.col("time"))
    return rendered(spark, sf_dir).groupBy(b.alias("bucket"), format_timestamp(b).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


def search_regex_multiline_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = predicates.compile_query("regex", r"^The .*\bof\b")(F.col("text"))
    return table(spark, sf_dir, "documents").where(hit).select("doc_id")


def search_simple_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A substring that reaches over a line end."""
    return table(spark, sf_dir, "documents").where(predicates.compile_query("simple", ".\nThe ")(F.col("text"))).select("doc_id")


def continued_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each agent, in which only error events begin with a timestamp."""
    r = rendered(spark, sf_dir)
    line = F.when(F.col("path") == "/logs/error.log", F.col("line")).otherwise(F.concat(F.lit("  at "), F.substring("line", 21, 100000)))
    return r.select("agent", F.lit("/logs/app.log").alias("path"), "pos", line.alias("line"))


def record_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.assemble(continued_lines(spark, sf_dir))


def record_assembly_faithful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines out of order, cut as a reader of one request cuts them."""
    shuffled = continued_lines(spark, sf_dir).withColumn("pos", F.col("pos") * 7919 % 10007 * 1000000 + F.col("pos"))
    return records.assemble(shuffled, window=(START, END))


def limit_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.limit_per_file(single_records(spark, sf_dir), 7).select("agent", "path", F.col("rid").alias("pos"), "time")


def records_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last hits in file order; positions run against time, so these are not least and greatest."""
    back = single_records(spark, sf_dir).withColumn("rid", -F.col("rid"))
    return limits.response_order(limits.group_by_file(back)).select("agent", "path", "start_time", "end_time", "n_lines")


FLAGSHIP = SearchRequest((("([error] OR [click]) NOT user=1", "boolean"),), START, END, prefix="/logs/", max_results=5)


def federated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = rendered(spark, sf_dir).select("agent", "path", "pos", "line")
    return LogSearch(lines).search(FLAGSHIP).select("agent", "path", "status", "error_msg", "start_time", "end_time", "n_lines")


def federated_search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = rendered(spark, sf_dir).select("agent", "path", "pos", "line")
    hits = LogSearch(lines).search(FLAGSHIP)
    return hits.select("agent", "path", F.posexplode("lines").alias("place", "hit")).select("agent", "path", F.col("place").cast("bigint").alias("place"), "hit.time", "hit.line")


def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir)


def byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.byte_offsets(document_lines(spark, sf_dir)).select("agent", "path", "pos", "offset")


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeindex.stamped_offsets(rendered(spark, sf_dir).select("agent", "path", "pos", "line"))


def time_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeindex.build_index(stamped(spark, sf_dir))


def time_index_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeindex.terminal_entries(stamped(spark, sf_dir))


def time_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeindex.build_index_exact(stamped(spark, sf_dir)).withColumn("seq", F.col("seq").cast("bigint"))


def time_index_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of each file's first half, extended when the whole file is there."""
    s = stamped(spark, sf_dir)
    half = s.groupBy("agent", "path").agg((F.max("pos") / 2).alias("half"))
    old = timeindex.build_index_exact(s.join(half, ["agent", "path"]).where("pos <= half"))
    return timeindex.extend_index(old, s).withColumn("seq", F.col("seq").cast("bigint"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stamped(spark, sf_dir)
    return timeindex.with_sequence(timeindex.build_index(s).unionByName(timeindex.terminal_entries(s)))


def index_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeindex.probe_index(entries(spark, sf_dir), 1704700000, 1704800000)


def index_probe_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(i, 1704100000 + i * 200000, 1704150000 + i * 200000) for i in range(8)], "request_id bigint, start_time bigint, end_time bigint")
    return timeindex.probe_many(entries(spark, sf_dir), asked)


def file_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeindex.file_bounds(rendered(spark, sf_dir).withColumnRenamed("time", "timestamp"), "pos")


def file_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one hour each, so that a range prunes most of them."""
    hourly = rendered(spark, sf_dir).withColumn("path", F.concat("path", F.lit("."), F.col("time") - F.col("time") % 3600)).withColumnRenamed("time", "timestamp")
    return timeindex.overlapping_files(timeindex.file_bounds(hourly, "pos"), 1704700000, 1704710000)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/data/"), "source", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".GZ").otherwise(".log"))
    return d.select(path.alias("fullpath"), F.concat("doc_id", F.lit(".log")).alias("name"), F.lit("/data").alias("dir"), F.col("n_chars").alias("size"), (F.lit(1700000000) + F.col("doc_id")).alias("mtime"), F.col("doc_id").alias("inode"), F.concat(F.lit("/data/"), "source").alias("root_path"))


def list_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No folder boundary: /data/src1 also shows files of src10 to src19, whose root it does not reach."""
    roots = [catalog.Root("/data", "/data/.+")]
    files = document_files(spark, sf_dir).withColumn("root_path", F.lit("/data"))
    return catalog.list_prefix(files, "/data/src1", roots).select("fullpath", "size")


def file_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(spark, sf_dir)
    keep = catalog.whole_match(F.col("fullpath"), r"(?!.*\/src1).*") & catalog.whole_match(F.element_at(F.split("fullpath", "/"), -1), r".*\.log|.*7\.GZ")
    return files.where(keep).select("fullpath")


def indexed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older catalog: a fifth of the files unknown, others of another size, inode or without index."""
    files = document_files(spark, sf_dir).where("inode % 5 <> 0")
    changed = files.withColumn("size", F.when(F.col("inode") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    changed = changed.withColumn("inode", F.when(F.col("inode") % 11 == 0, F.col("inode") + 1000000).otherwise(F.col("inode")))
    tag = F.concat_ws("-", "size", "mtime")
    entry = F.array(F.struct(F.col("mtime").alias("timestamp"), F.lit(0).cast("bigint").alias("offset")))
    index = F.struct(tag.alias("index_etag"), F.lit(0).cast("bigint").alias("last_index_time"), entry.alias("time_indexes"))
    return changed.withColumn("etag", tag).withColumn("file_index", F.when(F.col("size") % 2 == 0, index.cast(catalog.INDEX)))


def catalog_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = document_files(spark, sf_dir).withColumn("etag", F.concat_ws("-", "size", "mtime"))
    return catalog.to_reindex(catalog.upsert(indexed_catalog(spark, sf_dir), scan)).select("fullpath", "size", "inode")


def catalog_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = document_files(spark, sf_dir).where("inode % 3 <> 1")
    return catalog.vacuum(indexed_catalog(spark, sf_dir), there).select("fullpath")


def cache_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = document_files(spark, sf_dir).where("inode % 3 <> 1")
    roots = document_files(spark, sf_dir).where("root_path < '/data/src3'").select(F.col("root_path").alias("path")).distinct()
    return catalog.reload_cache(indexed_catalog(spark, sf_dir), there, roots).select("fullpath")


def path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select(F.concat(F.lit("/data/"), "source", F.lit("/"), "doc_id", F.lit(".log")).alias("fullpath"))
    return catalog.lookup(asked, document_files(spark, sf_dir)).select("fullpath", "status", "error_msg")


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark, sf_dir).select(F.col("agent").alias("agent_addr"), F.col("time").alias("ts"))


def active_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = announcements(spark, sf_dir).groupBy(F.col("agent_addr").alias("address")).agg(F.max("ts").alias("last_announce"))
    newest = last.agg(F.max("last_announce").alias("now"))
    return last.join(F.broadcast(newest)).where(F.col("now") - F.col("last_announce") <= 600).select("address", "last_announce")


def agent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents active at a fixed time, from all announcements up to it."""
    before = announcements(spark, sf_dir).where(F.col("ts") <= NOW)
    last = before.groupBy(F.col("agent_addr").alias("address")).agg(F.max("ts").alias("last_announce"))
    return registry.active(last, NOW, 1200)


def agent_file_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rendered(spark, sf_dir)
    files = r.select(F.col("agent").alias("agent_id"), F.col("path").alias("fullpath")).distinct()
    agents = r.groupBy(F.col("agent").alias("agent_id")).agg(F.concat(F.lit("10.0.0."), F.max(F.col("pos") % 4), F.lit(":8113")).alias("address"))
    out = limits.files_by_agent(files, agents)
    return out.select("agent_id", "address", "n_files", F.array_join("paths", ",").alias("paths"))


def union_of_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rendered(spark, sf_dir)
    parts = {f"agent{i}": r.where(F.col("agent") == f"agent{i}").drop("agent") for i in range(4)}
    return union_agents(parts).groupBy("agent", "path").agg(F.count(F.lit(1)).alias("n"), F.max("time").alias("last"))


def file_type_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.split("url", "/"), -1)
    odd = F.when(F.col("page_id") % 3 == 0, F.concat(name, F.lit(".Gz"))).otherwise(name)
    return table(spark, sf_dir, "pages").select("page_id", text.file_type(odd).alias("file_type"))


def url_decode_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.url_decode(F.col("url")).alias("decoded"))


def url_parts_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.url_parts(F.col("url")).alias("u")).select("page_id", "u.host", "u.port", "u.target")


def match_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.explode(predicates.match_positions("boolean", "user=1 AND (click OR error)", F.col("line")))
    return rendered(spark, sf_dir).select("pos", hit.alias("h")).select("pos", "h.word", F.col("h.pos").cast("bigint").alias("at"))


def etags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).select("fullpath", etag(F.col("size"), F.col("mtime")).alias("etag"))


def agent_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return announcements(spark, sf_dir).select("agent_addr").distinct().select("agent_addr", agent_id(F.col("agent_addr")).alias("agent_id"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = indexed_catalog(spark, sf_dir).withColumn("root_path", F.lit("/data"))
    return LogSearch(rendered(spark, sf_dir), files).list("/data/src2", [catalog.Root("/data", "/data/.+")])


S = rf"""{L}, S AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY agent, path ORDER BY pos) - strlen(line) - 1 AS "offset", time - time % 300 AS bucket FROM L),
    M AS (SELECT *, max(bucket) OVER (PARTITION BY agent, path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM S),
    I AS (SELECT agent, path, bucket AS timestamp, "offset"::BIGINT AS "offset" FROM M WHERE seen IS NULL OR bucket >= seen + 300),
    T AS (SELECT agent, path, arg_max(time, pos) AS timestamp, arg_max("offset", pos)::BIGINT AS "offset" FROM S GROUP BY agent, path)"""
E = rf"""{S}, E AS (SELECT *, row_number() OVER (PARTITION BY agent, path ORDER BY "offset", timestamp) - 1 AS seq FROM (SELECT * FROM I UNION ALL SELECT * FROM T)),
    G AS (SELECT *, lead(timestamp) OVER w AS until, lead("offset") OVER w AS upto FROM E WINDOW w AS (PARTITION BY agent, path ORDER BY seq))"""
C = r"""C AS (SELECT agent, '/logs/app.log' AS path, pos, CASE WHEN path = '/logs/error.log' THEN time END AS time,
    CASE WHEN path = '/logs/error.log' THEN line ELSE '  at ' || substring(line, 21) END AS line FROM L)"""
FILES = r"""F AS (SELECT '/data/' || source || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.GZ' ELSE '.log' END AS fullpath, n_chars AS size, 1700000000 + doc_id AS mtime, doc_id AS inode, '/data/' || source AS root_path FROM documents),
    O AS (SELECT fullpath, CASE WHEN inode % 7 = 0 THEN size + 1 ELSE size END AS size, mtime, CASE WHEN inode % 11 = 0 THEN inode + 1000000 ELSE inode END AS inode, inode AS id, root_path FROM F WHERE inode % 5 <> 0),
    K AS (SELECT *, size || '-' || mtime AS etag, size % 2 = 0 AS indexed FROM O)"""
BOOLEAN = "(contains(line, '[error]') OR contains(line, '[click]')) AND NOT contains(line, 'user=1')"
HITS = f"{L}, H AS (SELECT *, row_number() OVER (PARTITION BY agent, path ORDER BY pos) AS n FROM L WHERE time BETWEEN {START} AND {END} AND {BOOLEAN})"

QUERIES: dict[str, tuple[Query, str | None]] = {
    "render_log_lines": (render_log_lines, f"WITH {L} SELECT * FROM L"),
    "ts_extract": (ts_extract, rf"WITH {L} SELECT pos, cast(epoch(try_strptime(regexp_extract(substring(line, 1, 50), '\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}}'), '%Y-%m-%d %H:%M:%S')) AS BIGINT) AS time FROM L"),
    "ts_extract_formats": (ts_extract_formats, "SELECT event_id, CASE WHEN event_id % 5 < 4 THEN cast(floor(epoch(ts)) AS BIGINT) END AS time FROM events"),
    "ts_bucket": (ts_bucket, f"WITH {L} SELECT time - time % 300 AS bucket, strftime(make_timestamp((time - time % 300) * 1000000), '%Y-%m-%d %H:%M:%S') AS shown, count(*) AS n FROM L GROUP BY 1, 2"),
    "search_simple": (search_with(("[purchase]", "simple")), search_sql("contains(line, '[purchase]')")),
    "search_boolean": (search_with(("(error OR signup) AND user=2", "boolean")), search_sql("(contains(line, 'error') OR contains(line, 'signup')) AND contains(line, 'user=2')")),
    "search_boolean_implicit_and": (search_with(("error NOT user=1", "boolean")), search_sql("contains(line, 'error') AND NOT contains(line, 'user=1')")),
    "search_boolean_or_flat": (search_with(("error OR view (purchase)", "boolean")), search_sql("(contains(line, 'error') OR contains(line, 'view') OR contains(line, 'purchase'))")),
    "search_boolean_nothing": (search_with(("()", "boolean")), search_sql("false")),
    "search_regex": (search_with((r"user=\d*[05] .*\d", "regex")), search_sql(r"regexp_matches(line, '(?s)user=\d*[05] .*\d')")),
    "search_regex_multiline_docs": (search_regex_multiline_docs, r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?sm)^The .*\bof\b')"),
    "search_simple_docs": (search_simple_docs, "SELECT doc_id FROM documents WHERE contains(text, '.' || chr(10) || 'The ')"),
    "search_conjunction": (search_with((r"user=\d+3 ", "regex"), ("props", "simple"), ("view OR click", "boolean")), search_sql(r"regexp_matches(line, 'user=\d+3 ') AND contains(line, 'props') AND (contains(line, 'view') OR contains(line, 'click'))")),
    "time_range": (search_with(("user", "simple"), start=1704067200, end=1704153600), search_sql("contains(line, 'user')", 1704067200, 1704153600)),
    "record_assembly": (record_assembly, f"WITH {L}, {C}, R AS (SELECT *, sum(CASE WHEN time IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY agent, path ORDER BY pos)::BIGINT AS rid FROM C) SELECT agent, path, rid, max(time) AS time, string_agg(line, chr(10) ORDER BY pos) AS line FROM R WHERE rid > 0 GROUP BY agent, path, rid"),
    "record_assembly_faithful": (record_assembly_faithful, f"WITH {L}, {C}, Q AS (SELECT * REPLACE (pos * 7919 % 10007 * 1000000 + pos AS pos) FROM C), R AS (SELECT *, sum(CASE WHEN time IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY agent, path ORDER BY pos)::BIGINT AS rid FROM Q WHERE time IS NULL OR time >= {START}) SELECT agent, path, rid, max(time) AS time, string_agg(line, chr(10) ORDER BY pos) AS line FROM R WHERE rid > 0 GROUP BY agent, path, rid HAVING max(time) <= {END}"),
    "limit_per_file": (limit_per_file, f"WITH {L} SELECT agent, path, pos, time FROM L QUALIFY row_number() OVER (PARTITION BY agent, path ORDER BY pos) <= 7"),
    "records_per_file": (records_per_file, f"WITH {L} SELECT agent, path, arg_max(time, pos) AS start_time, arg_min(time, pos) AS end_time, count(*) AS n_lines FROM L GROUP BY agent, path"),
    "federated_search": (federated_search, f"WITH {HITS} SELECT agent, path, 0 AS status, '' AS error_msg, arg_min(time, pos) AS start_time, arg_max(time, pos) AS end_time, count(*) AS n_lines FROM H WHERE n <= 5 GROUP BY agent, path"),
    "federated_search_lines": (federated_search_lines, f"WITH {HITS} SELECT agent, path, n - 1 AS place, time, line FROM H WHERE n <= 5"),
    "line_explode": (line_explode, f"WITH {D} SELECT agent, path, pos, line FROM X"),
    "byte_offsets": (byte_offsets, f"WITH {D} SELECT agent, path, pos, (sum(strlen(line) + 1) OVER (PARTITION BY agent, path ORDER BY pos) - strlen(line) - 1)::BIGINT AS \"offset\" FROM X"),
    "time_index": (time_index, f"WITH {S} SELECT * FROM I"),
    "time_index_terminal": (time_index_terminal, f"WITH {S} SELECT * FROM T"),
    "time_index_exact": (time_index_exact, f"WITH {S}, E AS (SELECT *, 0 AS k FROM I UNION ALL SELECT *, 1 FROM T) SELECT agent, path, timestamp, \"offset\", row_number() OVER (PARTITION BY agent, path ORDER BY k, \"offset\") - 1 AS seq FROM E"),
    "time_index_extended": (time_index_extended, f"WITH {S}, E AS (SELECT *, 0 AS k FROM I UNION ALL SELECT *, 1 FROM T) SELECT agent, path, timestamp, \"offset\", row_number() OVER (PARTITION BY agent, path ORDER BY k, \"offset\") - 1 AS seq FROM E"),
    "index_probe": (index_probe, f"WITH {E} SELECT agent, path, min(\"offset\") AS start_offset, max(upto) AS end_offset FROM G WHERE until IS NOT NULL AND timestamp <= 1704800000 AND until >= 1704700000 GROUP BY agent, path"),
    "index_probe_many": (index_probe_many, f"WITH {E}, Q AS (SELECT i::BIGINT AS request_id, 1704100000 + i * 200000 AS a, 1704150000 + i * 200000 AS b FROM range(8) r(i)) SELECT request_id, agent, path, min(\"offset\") AS start_offset, max(upto) AS end_offset FROM G JOIN Q ON timestamp <= b AND until >= a WHERE until IS NOT NULL GROUP BY request_id, agent, path"),
    "file_bounds": (file_bounds, f"WITH {L} SELECT agent, path, arg_min(time, pos) AS start_time, arg_max(time, pos) AS end_time FROM L GROUP BY agent, path"),
    "file_pruning": (file_pruning, f"WITH {L}, B AS (SELECT agent, path || '.' || (time - time % 3600) AS path, arg_min(time, pos) AS start_time, arg_max(time, pos) AS end_time FROM L GROUP BY 1, 2) SELECT * FROM B WHERE end_time >= 1704700000 AND start_time <= 1704710000"),
    "list_prefix": (list_prefix, f"WITH {FILES} SELECT fullpath, size FROM F WHERE starts_with(fullpath, '/data/src1')"),
    "file_filters": (file_filters, f"WITH {FILES} SELECT fullpath FROM F WHERE NOT contains(fullpath, '/src1') AND (fullpath LIKE '%.log' OR fullpath LIKE '%7.GZ')"),
    "catalog_changed": (catalog_changed, f"WITH {FILES} SELECT F.fullpath, F.size, F.inode FROM F LEFT JOIN K USING (fullpath) WHERE K.fullpath IS NULL OR K.inode <> F.inode OR NOT K.indexed OR K.etag <> F.size || '-' || F.mtime"),
    "catalog_vacuum": (catalog_vacuum, f"WITH {FILES} SELECT fullpath FROM K WHERE NOT indexed OR id % 3 <> 1"),
    "cache_reload": (cache_reload, f"WITH {FILES} SELECT fullpath FROM K WHERE id % 3 <> 1 AND root_path < '/data/src3'"),
    "path_lookup": (path_lookup, "SELECT '/data/' || source || '/' || doc_id || '.log' AS fullpath, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS status, CASE WHEN doc_id % 3 = 0 THEN 'File not found in index list' ELSE '' END AS error_msg FROM documents"),
    "active_agents": (active_agents, f"WITH {L}, A AS (SELECT agent AS address, max(time) AS last_announce FROM L GROUP BY agent) SELECT * FROM A WHERE (SELECT max(last_announce) FROM A) - last_announce <= 600"),
    "agent_activity": (agent_activity, f"WITH {L} SELECT agent AS address, max(time) AS last_announce FROM L WHERE time <= {NOW} GROUP BY agent HAVING {NOW} - max(time) <= 1200"),
    "agent_file_join": (agent_file_join, f"WITH {L} SELECT agent AS agent_id, '10.0.0.' || max(pos % 4) || ':8113' AS address, count(DISTINCT path) AS n_files, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM L GROUP BY agent"),
    "union_agents": (union_of_agents, f"WITH {L} SELECT agent, path, count(*) AS n, max(time) AS last FROM L GROUP BY agent, path"),
    "file_type_detect": (file_type_detect, "SELECT page_id, CASE WHEN page_id % 3 = 0 OR lower(url) LIKE '%.gz' THEN 'gzip' ELSE 'text' END AS file_type FROM pages"),
    "url_decode_pages": (url_decode_pages, "SELECT page_id, url_decode(url) AS decoded FROM pages"),
    "url_parts_pages": (url_parts_pages, r"SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host, CASE WHEN regexp_matches(url, '^https?://[^/:]+:[0-9]') THEN regexp_extract(url, '^https?://[^/:]+:([0-9]+)', 1) WHEN starts_with(url, 'https') THEN '443' ELSE '80' END AS port, CASE WHEN regexp_extract(url, '^https?://[^/]+(/.*)$', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/]+(/.*)$', 1) END AS target FROM pages"),
    "match_positions": (match_positions, f"WITH {L}, M AS (SELECT *, CASE WHEN contains(line, 'click') THEN 'click' ELSE 'error' END AS other FROM L WHERE contains(line, 'user=1') AND (contains(line, 'click') OR contains(line, 'error'))) SELECT pos, 'user=1' AS word, strpos(line, 'user=1') - 1 AS at FROM M UNION ALL SELECT pos, other, strpos(line, other) - 1 FROM M"),
    "listing": (listing, f"WITH {FILES} SELECT fullpath AS path, size, mtime, etag, CASE WHEN indexed THEN mtime END AS start_time, CASE WHEN indexed THEN mtime END AS end_time FROM K WHERE starts_with(fullpath, '/data/src2')"),
    "etag": (etags, None),
    "agent_id": (agent_ids, None),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql is not None}
