"""Document fingerprints by SimHash, in DataFrame functions only (operator 9).

Terms are the words of a text, weighted by their length and by how often they occur: each occurrence
votes with its length on all 64 bits of the term's hash, and a bit is set when more than half of the
weight set it. Votes of bits k and k + 32 share one long: (hash >> k) & 0x0000000100000001 times the
weight adds to both. The weight of a text is below 2^31, so the halves never meet.

Near fingerprints are found by permuted block tables: 64 bits are cut into radius + 2 blocks, so two
fingerprints within the radius agree on two blocks at least; there is a table for each pair of
blocks, keyed by their bits, and a candidate is held against the radius exactly.

A document's edited text needs its successor in descending id. The ids are cut at their quantiles
into ranges; a window within each range finds successors, and the last of a range takes the first of
the next. So texts move once, and no task holds more than a range.

Edges: a null text is empty; an empty text has fingerprint zero; null ids come last, and are no
queries; rows equal in id follow each other by text; a lone document succeeds itself; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, written

LANES = 0x0000000100000001
GAPS = r"[\x20\x09-\x0D]+"


def votes(h: str, w: str) -> list[Column]:
    """Aggregates over the terms' hashes and weights: the votes of bits k and k + 32, and all weight."""
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANES)) * F.col(w)).alias(f"__v{k}") for k in range(32)] + [F.sum(w).alias("__w")]


def decided() -> Column:
    """The 64-bit fingerprint from the aggregates of votes(): weight - 2 * votes is negative, so its
    sign bit 1, exactly where over half of the weight has the bit."""
    bits = []
    for k in range(32):
        v = F.col(f"__v{k}")
        for bit, n in ((k, v.bitwiseAND(F.lit(0xFFFFFFFF))), (k + 32, F.shiftrightunsigned(v, 32))):
            bits.append(F.shiftleft(F.shiftrightunsigned(F.col("__w") - 2 * n, 63), bit))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """The share of agreeing bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def near_fingerprints(index: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """(query, fp) for each fp of ``index(fp)`` within ``radius`` of a query of ``queries(query)``; both distinct."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    pairs = [x | y for x, y in combinations(masks, 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in pairs]
    keys = lambda c: F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(c).bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(signed)]))
    left = queries.select("query", keys("query").alias("b")).select("query", "b.t", "b.k")
    right = index.select("fp", keys("fp").alias("b")).select("fp", "b.t", "b.k")
    close = F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))) <= radius
    return left.join(right, ["t", "k"]).where(close).select("query", "fp").distinct()


ROWS, WIDTH = 1000, 1024


def above(cuts: Column, value: Column) -> Column:
    """How many of an array's numbers a value reaches."""
    return F.size(F.filter(cuts, lambda x: x <= value))


def with_ranges(docs: DataFrame, doc_id: str) -> DataFrame:
    """Adds __range, the number of a row's range of ids: about ROWS rows each. The cuts are quantiles, WIDTH
    of the whole table and, where these ranges are larger, up to WIDTH of each; two levels of a search keep
    it short. Null ids are in range -1."""
    n = docs.select(doc_id).count()
    width = max(1, min(round(WIDTH**0.5), round((n / ROWS) ** 0.5)))
    points = [i / width**2 for i in range(1, width**2)]
    cuts = docs.select(F.percentile_approx(doc_id, points, 10000)).first()[0] if points and n else None
    null = F.col(doc_id).isNull()
    if not cuts:
        return docs.withColumn("__range", F.when(null, F.lit(-1)).otherwise(F.lit(0)).cast("bigint"))
    upper = F.array(*[F.lit(x) for x in cuts[width - 1 :: width]])
    lower = F.array(*[F.array(*[F.lit(x) for x in cuts[i * width : i * width + width - 1]]) for i in range(width)])
    high = above(upper, F.col(doc_id))
    ranged = docs.withColumn("__range", F.when(null, F.lit(-1)).otherwise(high * width + above(F.get(lower, high), F.col(doc_id))).cast("bigint"))
    more = min(round(WIDTH**0.5), math.ceil((n / ROWS / width**2) ** 0.5))
    if more < 2:
        return ranged
    points = [i / more**2 for i in range(1, more**2)]
    inner = ranged.where("__range >= 0").groupBy("__range").agg(F.percentile_approx(doc_id, points, 10000).alias("__cuts"))
    ranged = ranged.join(F.broadcast(written(inner, "cuts")), "__range", "left")  # at most WIDTH rows of WIDTH numbers
    at = above(F.transform(F.sequence(F.lit(1), F.lit(more - 1)), lambda i: F.get("__cuts", i * more - 1)), F.col(doc_id))
    part = at * more + above(F.slice("__cuts", at * more + 1, F.lit(more - 1)), F.col(doc_id))
    return ranged.withColumn("__range", F.when(null, F.lit(-1)).otherwise(F.col("__range") * more**2 + part)).drop("__cuts")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """(__range, __place, doc_id, text, edited) of documents with ``text`` not null. Each range also gets
    the text that follows its last row, the first of the next range, so one window finds all successors."""
    ranged = with_ranges(docs, "doc_id")
    down = Window.orderBy(F.desc("__range"))
    every = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = ranged.groupBy("__range").agg(F.max("doc_id").alias("top"))
    tops = written(tops.withColumn("before", F.coalesce(F.lag("__range").over(down), F.min("__range").over(every))), "tops")
    firsts = ranged.join(F.broadcast(tops), "__range").where(F.col("doc_id").eqNullSafe(F.col("top")))  # one row a range, WIDTH^2 at most
    firsts = firsts.groupBy(F.col("before").alias("__range")).agg(F.min("text").alias("text")).withColumns({"doc_id": F.lit(None).cast(ranged.schema["doc_id"].dataType), "__beyond": F.lit(True)})
    rows = ranged.withColumn("__beyond", F.lit(False)).unionByName(firsts)
    within = Window.partitionBy("__range").orderBy("__beyond", F.col("doc_id").desc_nulls_last(), F.col("text"))
    led = rows.withColumn("__next", F.lead("text").over(within)).withColumn("__place", F.row_number().over(within)).where("not __beyond")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("__next", F.lit(1), half))
    return led.select("__range", "__place", "doc_id", "text", edited.alias("edited"))


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(__range, __place, doc_id, n_chars, edited_sha256, fp, edited_fp) for each row of ``docs(doc_id, text)``."""
    keys = ["__range", "__place", "doc_id", "n_chars", "edited_sha256"]
    pairs = edited_pairs(docs)
    texts = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text"))))
    told = pairs.select("__range", "__place", "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), texts.alias("x"))
    terms = told.select(*keys, "x.which", F.explode(F.split("x.text", GAPS)).alias("term"))
    terms = terms.select(*keys, "which", F.xxhash64("term").alias("h"), F.char_length("term").cast("bigint").alias("w"))
    both = terms.groupBy(*keys, "which").agg(*votes("h", "w")).select(*keys, "which", decided().alias("fp"))
    return both.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))


def op9_simhash_fingerprints(spark: SparkSession, sf_dir: str, radius: int = 3) -> DataFrame:
    """near_docs (a further column): for ids divisible by 100, the documents whose fingerprint is within
    ``radius`` bits, itself included; null for other rows."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # dealt anew before writing: the votes' tasks are many, their rows narrow, so fewer tasks write files
    table = written(fingerprint_table(docs).repartition("__range", "__place"), "fingerprints")
    within = Window.partitionBy("__range").orderBy("__place")
    down = Window.orderBy(F.desc("__range"))
    every = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = table.where("__place = 1").select("__range", F.coalesce(F.lead("fp").over(down), F.first("fp").over(every)).alias("__beyond"))
    led = table.withColumn("__next", F.lead("fp").over(within)).join(firsts, "__range")
    index = table.groupBy("fp").agg(F.count(F.lit(1)).alias("docs"))
    asked = table.where("doc_id % 100 = 0").select(F.col("fp").alias("query")).distinct()
    found = near_fingerprints(index.select("fp"), asked, radius).join(index, "fp")
    found = found.groupBy(F.col("query").alias("fp")).agg(F.sum("docs").alias("near_docs")).withColumn("__asked", F.lit(True))
    led = led.withColumn("__asked", F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))).join(found, ["fp", "__asked"], "left")
    return led.select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.coalesce("__next", "__beyond")).alias("near_next"), "near_docs")
