"""The file catalog: listing of roots, filters, change detection, upsert, vacuum and reload."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import etag
from ..functions.text import file_type

FILES = "name string, dir string, fullpath string, size bigint, mtime bigint, inode bigint, root_path string"
INDEX = "struct<index_etag: string, last_index_time: bigint, time_indexes: array<struct<timestamp: bigint, offset: bigint>>>"


@dataclass(frozen=True)
class Root:
    """A configured root; the three patterns must match whole texts, an empty one matches all."""

    path: str
    prefix_pattern: str = ""
    path_pattern: str = ""
    filename_pattern: str = ".*"
    max_days: int = 0


def load_config(path: str) -> dict:
    """A JSON object, empty where the file cannot be read."""
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return {}


def roots_of(config: dict) -> list[Root]:
    return [Root(r["path"], r.get("prefixpattern", ""), r.get("pathpattern", ""), r.get("namepattern", ".*"), int(r.get("maxdays", 0))) for r in config.get("paths", [])]


def whole_match(c: Column, pattern: str) -> Column:
    return c.rlike(rf"\A(?:{pattern})\z") if pattern else F.lit(True)


def listed(root: Root) -> Iterator[tuple]:
    """Regular files below the root; links, unreadable folders and files that vanish are skipped."""
    for folder, _, names in os.walk(root.path, onerror=None, followlinks=False):
        for name in names:
            full = os.path.join(folder, name)
            try:
                st = os.lstat(full)
            except OSError:
                continue
            if os.path.isfile(full) and not os.path.islink(full):
                yield name, folder, full, st.st_size, int(st.st_mtime), st.st_ino, root.path


def scan_roots(spark: SparkSession, roots: list[Root]) -> DataFrame:
    """The present catalog of local or mounted roots."""
    out = None
    for root in roots:
        found = spark.createDataFrame(list(listed(root)), FILES)
        found = found.where(whole_match(F.col("fullpath"), root.path_pattern) & whole_match(F.col("name"), root.filename_pattern))
        out = found if out is None else out.unionByName(found)
    out = spark.createDataFrame([], FILES) if out is None else out
    return out.withColumn("file_type", file_type(F.col("name"))).withColumn("etag", etag(F.col("size"), F.col("mtime")))


def scan_store(spark: SparkSession, root: Root) -> DataFrame:
    """The same listing through Spark's reader, for roots in any store; there is no inode there, so the
    path stands for it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root.path)
    full = F.regexp_replace("path", "^file:/+", "/")
    found = found.select(full.alias("fullpath"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))
    found = found.withColumn("name", F.element_at(F.split("fullpath", "/"), -1)).withColumn("dir", F.regexp_replace("fullpath", "/[^/]*$", ""))
    found = found.where(whole_match(F.col("fullpath"), root.path_pattern) & whole_match(F.col("name"), root.filename_pattern))
    return found.select("name", "dir", "fullpath", "size", "mtime", F.xxhash64("fullpath").alias("inode"), F.lit(root.path).alias("root_path"), file_type(F.col("name")).alias("file_type"), etag(F.col("size"), F.col("mtime")).alias("etag"))


def upsert(catalog: DataFrame, scan: DataFrame) -> DataFrame:
    """The catalog after a scan: a new path, or one with another inode, loses its index; a changed size or
    time keeps it; rows that the scan does not list stay (vacuum removes them)."""
    info = [c for c in scan.columns if c != "fullpath"]
    old = catalog.select("fullpath", F.struct(*[F.col(c) for c in info]).alias("o"), F.col("file_index").alias("oi"))
    new = scan.select("fullpath", F.struct(*[F.col(c) for c in info]).alias("n"))
    both = old.join(new, "fullpath", "full_outer")
    row = F.coalesce("n", "o")
    same = F.col("n").isNull() | (F.col("n.inode") == F.col("o.inode"))
    return both.select("fullpath", *[row.getField(c).alias(c) for c in info], F.when(same, F.col("oi")).alias("file_index"))


def to_reindex(catalog: DataFrame) -> DataFrame:
    """Files without an index, or whose index is of another size or time."""
    kept = F.col("file_index.index_etag")
    return catalog.where(kept.isNull() | (kept != F.col("etag")))


def vacuum(catalog: DataFrame, scan: DataFrame) -> DataFrame:
    """Drops indexed rows whose file has gone; rows without index entries stay."""
    gone = catalog.join(scan.select("fullpath"), "fullpath", "left_anti").where(F.coalesce(F.size("file_index.time_indexes"), F.lit(0)) > 0)
    return catalog.join(gone.select("fullpath"), "fullpath", "left_anti")


def reload_cache(cache: DataFrame, scan: DataFrame, roots: DataFrame) -> DataFrame:
    """Cached rows whose root is configured and whose path was just listed."""
    known = cache.join(roots.select(F.col("path").alias("root_path")), "root_path", "left_semi")
    return known.join(scan.select("fullpath"), "fullpath", "left_semi")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    schema = f"{FILES}, ftype string, etag string, file_index {INDEX}"
    return spark.read.schema(schema).option("multiLine", True).json(path)


CURRENT = "_CURRENT"


def load_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The catalog that write_cache() wrote last; None where there is none."""
    fs, home = file_system(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(home)] if fs.exists(home) else []
    done = sorted(n for n in names if n.startswith(CURRENT))
    return spark.read.parquet(f"{path}/{done[-1].removeprefix(CURRENT + '-')}") if done else None


def write_cache(catalog: DataFrame, path: str, keep: int = 2) -> bool:
    """Writes the catalog into a folder of its own below ``path`` and then names it by a marker file, which
    the store makes as a whole: readers see the old table or the new one. Older tables but ``keep`` go, so a
    reader that began before can finish. A catalog like the last one is not written; false then."""
    spark = catalog.sparkSession
    old = load_cache(spark, path)
    if old is not None and same_rows(old, catalog):
        return False
    name = f"{time.time_ns():020d}"
    catalog.write.parquet(f"{path}/{name}")
    fs, home = file_system(spark, path)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.create(path_of(f"{path}/{CURRENT}-{name}")).close()
    tables = sorted(f.getPath().getName() for f in fs.listStatus(home) if f.isDirectory())
    for gone in tables[:-keep]:
        fs.delete(path_of(f"{path}/{CURRENT}-{gone}"), False)
        fs.delete(path_of(f"{path}/{gone}"), True)
    return True


def file_system(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    def told(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first())

    return sorted(a.columns) == sorted(b.columns) and told(a) == told(b)


def list_prefix(files: DataFrame, prefix: str, roots: list[Root]) -> DataFrame:
    """Files that a request for ``prefix`` may see: the prefix must wholly match its root's pattern and
    begin with the root's path, and the file's path must begin with the prefix (no folder boundary)."""
    allowed = [r.path for r in roots if re.fullmatch(r.prefix_pattern, prefix) and prefix.startswith(r.path)]
    return files.where(F.col("root_path").isin(allowed) & F.startswith("fullpath", F.lit(prefix)))


def lookup(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Requested paths with their catalog rows; an unknown path gets an error row."""
    found = paths.join(files, "fullpath", "left")
    missing = F.col("name").isNull()
    return found.withColumn("status", F.when(missing, 1).otherwise(0)).withColumn("error_msg", F.when(missing, "File not found in index list").otherwise(""))


def guard_paths(paths: list[str], prefix: str) -> None:
    if not all(p.startswith(prefix) for p in paths):
        raise ValueError("a path lies outside the prefix")
