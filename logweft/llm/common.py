"""What the training-data operators share: words, shared scratch tables, ranks and components.

Words are the runs of characters other than space and U+0009..U+000D. ``bytes.split()`` without an
argument splits at exactly these six bytes, and ``bytes.lower()`` lowers exactly A-Z, so the Python
operators work on UTF-8 bytes.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that leaves it unset (tests, a laptop) gets a local folder; on a cluster others
    could not read that, so there the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="logweft-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; deleted when the driver ends."""
    path = f"{shared_dir(spark)}/logweft-{uuid.uuid4().hex}-{name}"
    _made.append((spark, path))
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _made:
        try:
            drop_scratch(spark, path)
        except Exception:  # the JVM has gone; the folder's owner cleans up
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes Parquet into the shared folder and reads it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def done_with(*tables: DataFrame) -> None:
    """Deletes tables of written() once everything computed from them is itself written."""
    for t in tables:
        drop_scratch(t.sparkSession, t.scratch_path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def held_out(doc_id: Column, mod: int) -> Column:
    """Whether crc32 of the id's text leaves no remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == 0


def nullable_key(c: Column) -> Column:
    """A string key without nulls that keeps code point order and puts null last."""
    return F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c.cast("string")))


def salts(rows: int, each: int = 200_000, least: int = 16) -> int:
    """How many salts keep a salt's share of ``rows`` near ``each``."""
    return max(least, -(-rows // each))


def rank_within(df: DataFrame, keys: Sequence[str], salt: Column, order: Sequence[Column], out: str) -> DataFrame:
    """Adds the 0-based rank within ``keys`` (none may be null) without bringing a key into one task.

    Rows of a key are dealt over salts. Counts by (key, salt) give each salt its first rank, and a
    row_number within (key, salt) the rest, so the largest task is a salt's share of a key. Ranks
    follow (salt, order); they are gapless, and repeatable where salt and order are.
    """
    salted = df.withColumn("__salt", salt)
    cell = [*keys, "__salt"]
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.select(*cell, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    starts = written(starts, "starts")  # else the join would deal the ranked rows anew, by the keys alone
    place = F.row_number().over(Window.partitionBy(*cell).orderBy(*order)) - F.lit(1)
    ranked = salted.withColumn("__place", place).join(starts.hint("merge"), cell)
    return ranked.withColumn(out, F.col("__from") + F.col("__place")).drop("__salt", "__place", "__from")


def split_by_bitmap(df: DataFrame, key: Column, marked: DataFrame, bits: int = 1 << 24) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` that surely have no ``key`` (a hash) among those of ``marked(key)``, and the others.

    The others are those that have one and a few more, so that a join after it moves few of the wide rows. A
    bitmap of ``bits`` bits decides, whatever the data's size; it comes to the rows as chunks by broadcast."""
    chunk = 32768
    place = lambda c: F.pmod(c, F.lit(bits))
    at = place(F.col("key"))
    chunks = marked.groupBy((at / chunk).cast("int").alias("__chunk")).agg(F.bitmap_construct_agg((at % chunk).cast("bigint")).alias("__bits"))
    within = (place(key) % chunk).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(within, 3) + 1, F.lit(1))), 16, 10).cast("int")
    held = df.withColumn("__chunk", (place(key) / chunk).cast("int")).join(F.broadcast(chunks), "__chunk", "left")
    held = held.withColumn("__may", F.coalesce(F.getbit(byte, within % 8) == 1, F.lit(False)))
    return held.where(~F.col("__may")).select(df.columns), held.where("__may").select(df.columns)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (node, root), root the least node reachable.

    Large-star and small-star turns (Kiveris et al., 2014) as joins on each node's least neighbour;
    no neighbour list is ever built. Each turn is a table in the shared folder, and only its size and
    a checksum reach the driver. Nodes without an edge are not listed.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = written(both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m")), "least")
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        large = written(large.where("hi <> lo").distinct(), "large")
        done_with(now, least)
        least = written(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = written(small.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "star")
        done_with(large, least)
        row = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if mark == row:
            break
        mark = row
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
