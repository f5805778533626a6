"""The pipeline: each stage on awkward rows, and what it may drop or change."""

from __future__ import annotations

import collections
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from logweft.llm import common, neardup, pii


def shingles(text: str | None) -> set[bytes]:
    return set(neardup.shingle_bytes((text or "").encode(), 5))


def test_stages(spark: SparkSession, edge: str, empty: str, sf: str) -> None:
    for folder in (edge, empty, sf):
        docs = common.documents(spark, folder)
        for name, stage in pipeline.STAGES:
            out = common.written(stage(spark, docs, folder), name)
            before, after = docs.collect(), out.collect()
            if name != "packing":
                assert out.columns == pipeline.COLUMNS
            if name == "toxicity":
                assert not collections.Counter(map(tuple, after)) - collections.Counter(tuple(r[c] for c in pipeline.COLUMNS) for r in before)
            if name == "near_dedup":
                kept = [shingles(r.text) for r in after]
                texts = {r.text for r in after}
                for r in before:  # what went has a near copy among its group, and exact copies leave one
                    if r.text not in texts and r.text is not None:
                        mine = shingles(r.text)
                        assert any(len(mine & k) >= 0.5 * len(mine | k) for k in kept) or not mine
                assert len({r.text for r in after}) == len(after)
            if name == "pii":
                assert sorted(str(r.doc_id) for r in after) == sorted(str(r.doc_id) for r in before)
                assert not any(pii.base_spans(r.text or "") for r in after)
                assert all(r.text is None or r.n_chars == len(r.text) for r in after)
            if name == "mixing":
                assert {r.text for r in after} <= {r.text for r in before}
                assert all(n <= 3 for n in collections.Counter((r.doc_id, r.text) for r in after).values())
            docs = out


def test_near_copies_are_linked(spark: SparkSession) -> None:
    import random

    rng = random.Random(11)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(100000)}" for _ in range(300)]
        for edits in (0, 0, 1, 3):
            copy = list(words)
            for i in rng.sample(range(300), edits):
                copy[i] = f"e{rng.randrange(100000)}"
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_copies(df).collect()}
    assert got == {i: i // 4 * 4 for i in range(len(texts))}


def test_bitmap_splits_rows(spark: SparkSession) -> None:
    df = spark.range(5000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.lit("x").alias("text"))
    marked = df.where("id % 50 = 0 or id is null").select(F.xxhash64("id").alias("key"))
    for bits in (1 << 15, 1 << 24):
        stay, asked = (sorted(-1 if r.id is None else r.id for r in part.collect()) for part in common.split_by_bitmap(df, F.xxhash64("id"), marked, bits))
        assert sorted(stay + asked) == [-1, *range(1, 5000)] and {-1, *range(50, 5000, 50)} <= set(asked) and len(asked) < 200
    stay, asked = common.split_by_bitmap(df, F.xxhash64("id"), marked.limit(0))
    assert stay.count() == 5000 and asked.count() == 0


def test_near_dedup_moves_few_texts(spark: SparkSession, tmp_path: Path) -> None:
    """With more marks than a broadcast holds, rows that stay are not dealt anew; what is kept is right."""
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(300)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(1000 + i, t, "en", "s", len(t)) for i, t in enumerate(texts[:30])]
    rows += [(5, texts[5], "de", "r", 1), (None, texts[7] + " more", "en", "s", 3), (400, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/d")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = pipeline.drop_near_copies(spark, spark.read.parquet(f"{tmp_path}/d"), "")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        got = sorted(map(tuple, out.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted([(i, t, *(("de", "r", 1) if i == 5 else ("en", "s", len(t)))) for i, t in enumerate(texts)] + [(400, None, "en", "s", 0)], key=str)
    assert plan.startswith("Union")
    first = out._jdf.queryExecution().sparkPlan().children().apply(0).toString()
    assert "BroadcastHashJoin" in first and "SortMergeJoin" not in first and "ShuffledHashJoin" not in first


def test_run_repeats(spark: SparkSession, sf: str) -> None:
    one, two = (sorted(map(tuple, pipeline.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect())) for _ in range(2))
    assert one == two and len(one) > 0
    assert pipeline.ORACLE_SQL is None and [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
