"""Mixing sources to target weights by systematic sampling (operator 10).

Within a source every document expects the same number of copies, target / size of the source. The
expected copies are summed along an order of the source's documents, one random offset is added, and
a document is emitted once for each integer that the running sum crosses. Documents are taken in
order of size, so the words taken stay near the target though sizes have a long tail.

The running sum is rank times expected copies in 26-bit fixed point, exact in 64 bits, so it needs
ranks only: counts by (source, size class, salt), and a row number within these cells.

Edges: a null text has size 0; a null source is a source of its own, last in order; an empty table
gives no rows; repeated rows are documents of their own; null ids are ranked together; columns of the
caller with a name of the result give way to it. Ranks times copies stay below 2^63 up to 4.5e10 documents
of a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, documents, nullable_key, rank_within, written

FIXED_BITS = 26


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """From (source_key, source_size) the targets: shares of all sizes by weight, none above ``most``
    times its source. The excess is shared again by weight, which is water filling: in order of
    cap / weight the capped sources are a prefix, and the rest share what is left at one level."""
    cycle = F.array(*[F.lit(w) for w in weights])
    every = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "source_key")
    w = sizes.withColumn("i", F.row_number().over(Window.orderBy("source_key")) - 1)
    w = w.withColumn("w", F.get(cycle, F.col("i") % len(weights)).cast("double")).withColumn("cap", most * F.col("source_size"))
    w = w.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = w.withColumn("level", F.col("left") / F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("capped", F.col("cap") < F.col("level") * F.col("w"))
    free = F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("source_key"), F.col("level")))
    w = w.withColumn("rest", F.min(free).over(every).getField("level"))
    return w.select("source_key", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("rest") * F.col("w")).alias("target"))


def size_class(size: Column) -> Column:
    """Number of binary digits, then the first four of them: classes 1/8 wide at most."""
    return F.length(F.bin(size)) * 10000 + F.substring(F.bin(size), 1, 4).cast("int")


def systematic_mix(docs: DataFrame, size: str, source: str, doc_id: str, seed: int = 7, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Adds source_size, target, copies to ``docs``; a document's copies are 0 to ``most``.

    ``docs`` is read three times; pass a narrow written table."""
    docs = docs.drop(*[c for c in ("source_size", "target", "copies") if c not in (size, source, doc_id)])
    src = docs.withColumn("__key", nullable_key(F.col(source))).withColumn("__class", size_class(F.col(size)))
    per_class = src.groupBy("__key", "__class").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("s"))
    totals = per_class.groupBy(F.col("__key").alias("source_key")).agg(F.sum("s").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("source_key")).cast("binary")), 1, 6), 16, 10).cast("bigint")
    plan = source_targets(totals, weights, most).select(F.col("source_key").alias("__key"), "source_size", "target", F.floor(rate * 2**FIXED_BITS).alias("__rate"), (start * 4).alias("__start"))
    before = Window.partitionBy("__key").orderBy(F.desc("__class")).rowsBetween(Window.unboundedPreceding, -1)
    first = per_class.select("__key", "__class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    first = written(first.join(plan, "__key"), "plan")  # a row for each source and class: joined without moving texts
    # the order within a class is the id's hash; its first digits, as many as the largest class needs, are the salt
    most_rows = per_class.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    digits = max(2, math.ceil(math.log(max(most_rows, 1) / 200_000 + 1, 16)))
    name = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    ranked = rank_within(src, ["__key", "__class"], F.substring(name, 1, digits), [name, F.col(doc_id)], "__rank").join(first, ["__key", "__class"])
    at = (F.col("__first") + F.col("__rank")) * F.col("__rate") + F.col("__start")
    copies = F.shiftright(at + F.col("__rate"), FIXED_BITS) - F.shiftright(at, FIXED_BITS)
    return ranked.withColumn("copies", copies).drop("__key", "__class", "__rank", "__first", "__rate", "__start")


def mix_documents(docs: DataFrame, **options: object) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of a documents table, size in words."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint")
    narrow = written(docs.select("doc_id", "source", size.alias("size")), "sizes")
    return systematic_mix(narrow, "size", "source", "doc_id", **options)


def op10_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, [5, 2, 1][1 + ((row_number() OVER (ORDER BY k) - 1) % 3)::INT]::DOUBLE AS w, 3 * source_size AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
        / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM w WINDOW o AS (ORDER BY cap / w, k)),
t AS (SELECT *, cap < level * w AS capped FROM l),
r AS (SELECT arg_min(level, (cap / w, k)) AS rest FROM t WHERE NOT capped),
p AS (SELECT k, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE rest * w END AS target,
             ('0x' || substr(md5('7:' || k), 1, 6))::BIGINT * 4 AS start FROM t, r),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 67108864)::BIGINT ELSE 0 END AS rate FROM p),
o AS (SELECT d.*, q.source_size, q.target, q.rate, (row_number() OVER (PARTITION BY d.k ORDER BY length(bin(size)) * 10000 + substr(bin(size), 1, 4)::INT DESC,
             md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1) * q.rate + q.start AS pos FROM d JOIN q USING (k))
SELECT doc_id, size, source_size, target, size * (((pos + rate) >> 26) - (pos >> 26)) AS taken FROM o
"""
