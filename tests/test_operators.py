from __future__ import annotations

import gzip
import json
import os
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from logweft.operators import catalog, limits, records, registry, timeindex
from logweft.plans import respond
from logweft.plans.search import LogSearch, SearchRequest
from logweft.sources.rawlog import RawLog
from logweft.sources.text import read_lines

from . import model

RAW = "agent string, path string, pos bigint, line string"


def random_log(rng: random.Random, n: int, rising: bool) -> list[str]:
    out, now = [], 1704067200
    for i in range(n):
        now = now + rng.choice([0, 1, 100, 400]) if rising else 1704067200 + rng.randrange(3000)
        stamp = time.strftime(rng.choice(["%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S"]), time.gmtime(now))
        out.append(rng.choice([f"{stamp} msg {i}", f"[x] {stamp} error {i}", f"  at line {i}", "", f"cr {i}\r"]))
    return out


def as_rows(logs: dict[str, list[str]]) -> list[tuple]:
    return [("a", path, i, line) for path, lines in logs.items() for i, line in enumerate(lines)]


def test_assembly_against_one_pass(spark: SparkSession) -> None:
    rng = random.Random(5)
    logs = {f"/f{i}": random_log(rng, rng.randrange(40), i % 2 == 0) for i in range(60)}
    df = spark.createDataFrame(as_rows(logs), RAW).repartition(7)
    got: dict[str, list] = {}
    for r in records.assemble(df).orderBy("path", "rid").collect():
        got.setdefault(r.path, []).append((r.time, r.line))
    assert got == {p: x for p, lines in logs.items() if (x := model.assemble(lines))}
    start, end = 1704067700, 1704069000
    got = {}
    for r in records.assemble(df, window=(start, end)).orderBy("path", "rid").collect():
        got.setdefault(r.path, []).append((r.time, r.line))
    assert got == {p: x for p, lines in logs.items() if (x := model.one_pass(lines, start, end))}


def test_index_never_changes_answers(spark: SparkSession) -> None:
    rng = random.Random(6)
    logs = {f"/f{i}": random_log(rng, 60, True) for i in range(20)}
    df = spark.createDataFrame(as_rows(logs), RAW)
    stamped = timeindex.stamped_offsets(df)
    exact = timeindex.build_index_exact(stamped)
    got: dict[str, list] = {}
    for r in exact.orderBy("path", "seq").collect():
        got.setdefault(r.path, []).append((r.timestamp, r.offset))
    assert got == {p: x for p, lines in logs.items() if (x := model.index(lines))}
    forced = timeindex.build_index_exact(stamped, force_every=3)
    assert {(r.path, r.timestamp, r.offset) for r in forced.collect()} == {(p, t, o) for p, lines in logs.items() for t, o in model.index(lines, force=3)}
    request = SearchRequest((("error", "simple"),), 1704067500, 1704069500, max_results=3)
    plain, pruned = (sorted(map(tuple, LogSearch(df, entries=e).search(request).select("path", "start_time", "end_time", "n_lines").collect())) for e in (None, exact))
    assert plain == pruned and plain


def test_extended_index_equals_a_new_one(spark: SparkSession) -> None:
    """Files that grew, did not, are new, or had no timestamp before; logs out of order and forced entries."""
    rng = random.Random(26)
    logs = {f"/f{i}": random_log(rng, 60, i % 2 == 0) for i in range(16)}
    before = {p: lines[: rng.choice((1, 2, 20, 59, 60))] for p, lines in list(logs.items())[:12]} | {"/idle": random_log(rng, 20, True)}
    old, now = (timeindex.stamped_offsets(spark.createDataFrame(as_rows(x), RAW)) for x in (before, logs))
    for force in (3, 50_000):
        entries = timeindex.build_index_exact(old, force_every=force)
        starts = timeindex.resume_offsets(entries).withColumnRenamed("offset", "at").drop("seq")
        tails = now.join(starts, ["agent", "path"], "left").where("at is null or offset >= at").drop("at")
        wanted = {p: x for p, lines in (logs | {"/idle": before["/idle"]}).items() if (x := model.index(lines, force=force))}
        for lines in (now, tails):
            got: dict[str, list] = {}
            for r in timeindex.extend_index(entries, lines, force_every=force).orderBy("path", "seq").collect():
                assert r.seq == len(got.setdefault(r.path, []))
                got[r.path].append((r.timestamp, r.offset))
            assert got == wanted


def test_index_keeps_late_lines(spark: SparkSession, tmp_path: Path) -> None:
    rng = random.Random(16)
    at = 1704067200
    stamp = lambda t: time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(at + t))
    logs = {str(tmp_path / f"f{i}.log"): random_log(rng, 60, False) for i in range(10)}
    logs[str(tmp_path / "late.log")] = [f"{stamp(t)} error {t}" for t in (1000, 3000, 1200, 9000, 9100)]
    logs[str(tmp_path / "back.log")] = [f"{stamp(t)} error {t}" for t in (1000, 3000, 1200)]
    for path, lines in logs.items():
        Path(path).write_bytes("\n".join(lines).encode())
    df = spark.createDataFrame(as_rows(logs), RAW)
    stamped = timeindex.stamped_offsets(df)
    spark.dataSource.register(RawLog)
    for k, built in enumerate((timeindex.build_index(stamped), timeindex.build_index_exact(stamped, force_every=7))):
        timed = timeindex.with_times(built, stamped)
        for entries in (built, timed):
            found = []
            for e in (None, entries):
                request = SearchRequest((("error", "simple"),), at + 2900, at + 3100)
                found.append(sorted(map(tuple, LogSearch(df, entries=e).search(request).select("path", "start_time", "end_time", "n_lines").collect())))
            assert found[0] == found[1] and any(r[0].endswith("back.log") for r in found[0])
            index = tmp_path.parent / f"index{k}.jsonl"
            index.write_text("\n".join(json.dumps(r.asDict()) for r in entries.collect()))
            for low, high in ((1100, 1300), (2900, 3100), (0, 500)):
                in_range = F.col("time").between(at + low, at + high)
                source = spark.read.format("rawlog").load(str(tmp_path)).where(in_range)
                pruned = spark.read.format("rawlog").option("index", str(index)).load(str(tmp_path)).where(in_range)
                assert sorted(map(tuple, pruned.collect())) == sorted(map(tuple, source.collect()))
    late = [(r.offset, r.least, r.most) for r in timed.where(F.col("path").endswith("late.log")).collect()]
    reader = RawLog({"path": str(tmp_path)}).reader(None)
    reader.wanted.low, reader.wanted.high = at + 1100, at + 1300
    ranges = reader.covered("late.log", sorted(late), 200)
    assert ranges[0][0] > 0 and len(ranges) == 2  # whole segments are still skipped


def test_search_limits_and_bounds(spark: SparkSession) -> None:
    lines = [f"2024-01-01 00:00:0{i} hit" for i in range(6)]
    search = LogSearch(spark.createDataFrame(as_rows({"/x/a": lines, "/x/b": lines[:2], "/xy": lines[:1]}), RAW))
    at = 1704067200
    for most in (0, 1, 5, 6, 7):
        got = {r.path: r.n_lines for r in search.search(SearchRequest((("hit", "simple"),), at, at + 9, max_results=most)).collect()}
        assert got == {p: min(n, most) for p, n in (("/x/a", 6), ("/x/b", 2), ("/xy", 1)) if most}
    one = search.search(SearchRequest((("hit", "simple"),), at + 3, at + 3)).collect()
    assert [(r.path, r.start_time, r.end_time, r.lines[0].line) for r in one] == [("/x/a", at + 3, at + 3, lines[3])]
    assert search.search(SearchRequest((("hit", "simple"),), at + 100, at + 200)).count() == 0
    assert {r.path for r in search.search(SearchRequest((("hit", "simple"),), at, at + 9, prefix="/x")).collect()} == {"/x/a", "/x/b", "/xy"}
    assert [r.path for r in search.search(SearchRequest((("hit", "simple"),), at, at + 9, prefix="/x/", paths=("/x/b",))).collect()] == ["/x/b"]
    agents = registry.registry(spark.createDataFrame([("h", at)], "agent_addr string, ts bigint")).withColumn("agent_id", F.lit("a"))
    active = LogSearch(search.lines, agents=agents)
    assert active.search(SearchRequest((("hit", "simple"),), at, at + 9), now=at + 60).count() == 3
    assert active.search(SearchRequest((("hit", "simple"),), at, at + 9), now=at + 61).count() == 0


def test_request_validation() -> None:
    body = {"querys": [{"query": "a", "type": "simple"}], "start_time": 1, "end_time": 2}
    request = SearchRequest.from_json(body, "/x")
    assert request.queries == (("a", "simple"),) and request.max_results == 500
    for bad, prefix in ((body, ""), ({"querys": []}, "/x"), ({"start_time": 1, "end_time": 2}, "/x")):
        with pytest.raises(ValueError):
            SearchRequest.from_json(bad, prefix)
    for bad in (SearchRequest((), 1, 2), SearchRequest((("a", "simple"),), 1, 2, paths=()), SearchRequest((("a", "simple"),), 1, 2, prefix="/x", paths=("/y",)), SearchRequest((("a b", "boolean"),), 1, 2)):
        with pytest.raises(ValueError):
            bad.check()


def test_search_plan(spark: SparkSession, sf: str) -> None:
    """One exchange by file serves assembly, limit and grouping; no Python in the plan."""
    from logweft.plans.queries import FLAGSHIP, rendered

    lines = rendered(spark, sf).select("agent", "path", "pos", "line")
    plan = LogSearch(lines).search(FLAGSHIP)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Contains" in plan or "contains" in plan.lower()


def test_responses(spark: SparkSession) -> None:
    lines = ["2024-01-01 00:00:00 hit é", "  more"]
    found = LogSearch(spark.createDataFrame(as_rows({"/a": lines}), RAW)).search(SearchRequest((("hit", "simple"),), 0, 1 << 40))
    body, how = respond.search_body(found)
    got = json.loads(body)
    assert how == "" and got["records"][0]["lines"] == [{"line": "\n".join(lines), "time": 1704067200}]
    assert "agent" not in json.loads(respond.search_json(found, with_agent=False).first().value)


def write_logs(root: Path) -> dict[str, list[str]]:
    rng = random.Random(9)
    logs = {}
    for i in range(3):
        lines = random_log(rng, 200, True)
        (root / f"app{i}.log").write_bytes(("\n".join(lines) + ("\n" if i else "")).encode())
        logs[str(root / f"app{i}.log")] = lines
    lines = random_log(rng, 50, True)
    packed = gzip.compress(("\n".join(lines[:20]) + "\n").encode()) + gzip.compress("\n".join(lines[20:]).encode())  # two members
    (root / "old.log.gz").write_bytes(packed)
    logs[str(root / "old.log.gz")] = lines
    (root / "empty.log").write_bytes(b"")
    (root / "tail.log").write_bytes(b"  only\n  continuations\n")
    os.symlink(root / "app0.log", root / "link.log")
    return logs


def test_readers(spark: SparkSession, tmp_path: Path) -> None:
    logs = write_logs(tmp_path)
    want = {p: x for p, lines in logs.items() if (x := model.assemble(lines))}
    rows = read_lines(spark, f"{tmp_path}/*[0-9g].*", "h").where(~F.col("path").endswith("link.log"))
    got: dict[str, list] = {}
    for r in records.assemble(rows).orderBy("path", "rid").collect():
        got.setdefault(r.path, []).append((r.time, r.line))
    assert got == want
    spark.dataSource.register(RawLog)
    for split in (97, 1 << 20):
        source = spark.read.format("rawlog").option("agent", "h").option("split_bytes", str(split)).load(str(tmp_path))
        got = {}
        for r in source.orderBy("path", "offset").collect():
            got.setdefault(r.path, []).append((r.time, r.line))
        assert got == want
    low = want[str(tmp_path / "app1.log")][20][0]
    cut = source.where((F.col("time") >= low) & F.col("line").contains("error"))
    assert {(r.path, r.time, r.line) for r in cut.collect()} == {(p, t, x) for p, rs in want.items() for t, x in rs if t >= low and "error" in x}
    index = tmp_path.parent / "index.jsonl"
    lines_df = spark.createDataFrame(as_rows(logs), RAW)
    entries = timeindex.build_index(timeindex.stamped_offsets(lines_df)).where("path not like '%.gz'").collect()
    index.write_text("\n".join(json.dumps({"path": r.path, "timestamp": r.timestamp, "offset": r.offset}) for r in entries))
    pruned = spark.read.format("rawlog").option("index", str(index)).load(str(tmp_path)).where((F.col("time") >= low) & (F.col("time") <= low + 900))
    assert {(r.path, r.time, r.line) for r in pruned.collect()} == {(p, t, x) for p, rs in want.items() for t, x in rs if low <= t <= low + 900}


def test_catalog_life(spark: SparkSession, tmp_path: Path) -> None:
    logs = tmp_path / "logs"
    (logs / "nightly").mkdir(parents=True)
    for name in ("a.log", "b.log", "c.txt", "nightly/d.log"):
        (logs / name).write_text("x")
    root = catalog.Root(str(logs), f"{logs}.*", r"^(?!.*\/nightly\/).*", r".*\.log$|.*\.gz$")
    scan = catalog.scan_roots(spark, [root])
    assert {r.name for r in scan.collect()} == {"a.log", "b.log"}
    store = catalog.scan_store(spark, root)
    assert {(r.fullpath, r.size, r.etag) for r in store.collect()} == {(r.fullpath, r.size, r.etag) for r in scan.collect()}
    index = F.struct(F.col("etag").alias("index_etag"), F.lit(1).cast("bigint").alias("last_index_time"), F.array(F.struct(F.lit(1).cast("bigint").alias("timestamp"), F.lit(0).cast("bigint").alias("offset"))).alias("time_indexes")).cast(catalog.INDEX)
    old = spark.createDataFrame(scan.withColumn("file_index", index).collect(), scan.withColumn("file_index", index).schema)
    assert catalog.to_reindex(catalog.upsert(old, scan)).count() == 0
    (logs / "a.log").write_text("xx")
    (logs / "b.log").unlink()
    (logs / "e.log").write_text("y")
    scan = catalog.scan_roots(spark, [root])
    merged = catalog.vacuum(catalog.upsert(old, scan), scan)
    state = {r.name: (r.size, r.file_index is not None) for r in merged.collect()}
    assert state == {"a.log": (2, True), "e.log": (1, False)}
    assert {r.name for r in catalog.to_reindex(merged).collect()} == {"a.log", "e.log"}
    cache = str(tmp_path / "cache")
    assert catalog.load_cache(spark, cache) is None and catalog.write_cache(old, cache) and not catalog.write_cache(old, cache)
    reader = catalog.load_cache(spark, cache)  # begun before the next write, and whole after it
    assert catalog.write_cache(merged, cache) and reader.count() == 2
    back = catalog.load_cache(spark, cache)
    assert catalog.same_rows(back, merged) and catalog.write_cache(merged.limit(1), cache)
    assert len([f for f in (tmp_path / "cache").iterdir() if f.is_dir()]) == 2
    roots = spark.createDataFrame([(str(logs),)], "path string")
    assert {r.name for r in catalog.reload_cache(back, scan.where("name = 'a.log'"), roots).collect()} == {"a.log"}
    assert {r.name for r in catalog.list_prefix(merged, f"{logs}/a", [root]).collect()} == {"a.log"}
    assert catalog.list_prefix(merged, "/elsewhere", [root]).count() == 0
    (tmp_path / "cache.json").write_text("[" + ",".join(r.value for r in merged.select(F.to_json(F.struct("*")).alias("value")).collect()) + "]")
    assert catalog.read_cache(spark, str(tmp_path / "cache.json")).count() == 2


def test_registry(spark: SparkSession) -> None:
    agents = registry.AgentRegistry(spark)
    agents.announce("127.0.0.1:8113", 100)
    agents.announce("10.0.0.1:8113", 130)
    agents.announce("127.0.0.1:8113", 120)
    assert {(r.address, r.agent_id, r.last_announce) for r in agents.agents().collect()} == {("127.0.0.1:8113", "2844607971204861183", 120), ("10.0.0.1:8113", "74110691827657299", 130)}
    assert {r.address for r in agents.active(181).collect()} == {"10.0.0.1:8113"}
    agents.expire(181)
    assert list(agents.rows) == ["10.0.0.1:8113"]
    files = spark.createDataFrame([("1", "/b"), ("1", "/a"), ("2", "/c"), ("3", "/d")], "agent_id string, fullpath string")
    known = spark.createDataFrame([("1", "h1"), ("2", "h2")], "agent_id string, address string")
    assert [(r.agent_id, r.address, r.paths) for r in limits.files_by_agent(files, known).collect()] == [("1", "h1", ["/a", "/b"]), ("2", "h2", ["/c"])]


def test_config(tmp_path: Path) -> None:
    (tmp_path / "c.json").write_text(json.dumps({"paths": [{"path": "/p", "prefixpattern": "/p/.+", "maxdays": 30}]}))
    assert catalog.roots_of(catalog.load_config(str(tmp_path / "c.json"))) == [catalog.Root("/p", "/p/.+", "", ".*", 30)]
    assert catalog.load_config(str(tmp_path / "none.json")) == {}


def test_search_reads_raw_files(spark: SparkSession, tmp_path: Path) -> None:
    """Raw files give the records that their lines give, unordered ones too, and an index spares bytes."""
    rng = random.Random(21)
    logs = {str(tmp_path / f"f{i}.log"): random_log(rng, 80, i % 2 == 0) for i in range(8)}
    for path, lines in logs.items():
        Path(path).write_bytes("\n".join(lines).encode())
    df = spark.createDataFrame(as_rows(logs), RAW).withColumn("agent", F.lit("h"))
    stamped = timeindex.stamped_offsets(df)
    index = tmp_path.parent / "raw-index.jsonl"
    index.write_text("\n".join(json.dumps(r.asDict()) for r in timeindex.with_times(timeindex.build_index(stamped), stamped).collect()))
    times = sorted(r.time for r in stamped.select("time").collect())
    told = lambda found: [(r.agent, r.path, r.start_time, r.end_time, [tuple(x) for x in r.lines]) for r in found.collect()]
    for low, high in ((times[0], times[-1]), (times[len(times) // 3], times[len(times) // 2]), (times[5], times[5])):
        for queries in ((("e", "simple"),), (("error OR warning OR info", "boolean"), ("[a-z]", "regex"))):
            request = SearchRequest(queries, low, high, prefix=str(tmp_path), max_results=7)
            want = told(LogSearch(df).search(request))
            for name in (None, str(index)):
                observed = Observation()
                got = told(LogSearch(None, raw={"h": (str(tmp_path), name)}, spark=spark).search(request, observation=observed, log=True))
                assert got == want
                if got:
                    assert observed.get == {"matched_records": sum(len(r[4]) for r in got), "matched_files": len(got)}
    reader = RawLog({"path": str(tmp_path), "index": str(index)}).reader(None)
    reader.wanted.low = reader.wanted.high = times[len(times) // 2]
    assert sum(p.end - p.start for p in reader.partitions()) < sum(Path(p).stat().st_size for p in logs)
