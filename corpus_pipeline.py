"""A training-data pipeline over ``documents``: STAGES in order, each a table for the next.

toxicity   drops what the nearest labelled examples call toxic (score 0.5 or more)
near_dedup keeps one document, that with the least id, of each group of near copies: SimHash finds
           candidates, linked where their sets of five-word shingles are alike by 0.8 or more
pii        replaces each span of personal data in the text by its kind, and counts characters anew
mixing     repeats or drops documents so that sources meet their target weights
packing    packs the documents' tokens into sequences of 1024

Repeated rows are documents of their own until near_dedup; from there each is there once until mixing
repeats it. Rows are told apart by id and text: of rows equal in both, the least by language, source and
count of characters stays. SQL cannot express the stages (nearest
neighbours, Hamming components, tokenizer), so ORACLE_SQL is None; tests hold them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweft.llm import mixing, neardup, packing, pii, toxicity
from logweft.llm.common import WORD, documents, split_by_bitmap, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), COLUMNS)
    return scored.where("score < 0.5").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = neardup.near_copies(docs.select("doc_id", "text"))
    marks = groups.groupBy("doc_id", "text_hash").agg(F.bool_or("kept").alias("__kept"), F.count(F.lit(1)).alias("__rows"))
    # only rows that go or repeat are marked; texts that stay need not be dealt anew to find them
    marks = written(marks.where(~F.col("__kept") | (F.col("__rows") > 1)).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}), "marks")
    # nor do they move to be told from the marked ones
    stay, asked = split_by_bitmap(docs.select(COLUMNS), F.xxhash64("doc_id", F.xxhash64("text")), marks.select(F.xxhash64("__id", "__hash").alias("key")))
    same = asked["doc_id"].eqNullSafe(marks["__id"]) & (F.xxhash64("text") == marks["__hash"])
    alone = asked.join(marks, same, "left_anti").select(COLUMNS)
    repeated = asked.join(marks.where("__kept"), same).groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("r"))
    return stay.union(alone).union(repeated.select("doc_id", "text", "r.lang", "r.source", "r.n_chars"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.masked(pii.personal_data(docs, COLUMNS), "text", "spans")
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), F.col("n_chars"))).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = written(docs.select(*COLUMNS, size.alias("__size")), "sized")
    mixed = mixing.systematic_mix(sized, "__size", "source", "doc_id")
    return mixed.where("copies > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).select(COLUMNS)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
