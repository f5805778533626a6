from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = ", score double, size int, fp string, copies int, spans string, shard int, word string, `n` int, root string"


def long_text(i: int, n: int) -> str:
    return " ".join(f"w{(i * 7919 + j * 104729) % 3000}x" for j in range(n))


def edge_rows() -> list[tuple]:
    base = "The quick brown fox jumps over the lazy dog near the old river bank today again and again"
    rows = [(i, long_text(i, 30 + i), "en" if i % 3 else "de", f"s{i % 4}", 0) for i in range(40)]
    rows += [(100 + i, base + " end" * (i % 2), "en", "s0", 0) for i in range(30)]  # two groups of copies
    rows += [(200, None, "en", "s1", 0), (201, "", "en", "s1", 0), (202, " \n\t ", None, None, 0), (203, "word", "en", None, 0)]
    rows += [(204, long_text(5, 20000), "en", "s2", 0), (205, "x" * 200_000, "en", "s2", 0), (206, "é\x1c\x85  ü\U0001f600 <|endoftext|> ŐŐ日本", "xx", "é", 0)]
    rows += [(207, base, None, None, None), (207, base, None, None, None), (None, base + " null id", "en", "s0", 1), (None, "another null id", None, "s1", 1)]
    rows += [(208, "mail a.b@c.de or 10.0.0.300 and 10.0.0.3, card 4111 1111 1111 1111, call +1 (555) 123-4567", "en", "s0", 0)]
    return rows


def write_tables(spark: SparkSession, folder: Path, docs: list[tuple], labels: list[tuple], turns: list[tuple]) -> str:
    extra = (0.5, 1, "f", 2, "s", 3, "w", 4, "r")
    spark.createDataFrame([r + extra for r in docs], DOCUMENTS + EXTRA).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([r + ("x",) for r in labels], "doc_id bigint, quality int, toxic int, text string").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([r + (1,) for r in turns], "conv_id bigint, turn bigint, role string, text string, example int").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def tables(spark: SparkSession, tmp_path_factory: pytest.TempPathFactory) -> Callable[..., str]:
    return lambda docs=(), labels=(), turns=(): write_tables(spark, tmp_path_factory.mktemp("tables"), list(docs), list(labels), list(turns))


@pytest.fixture(scope="session")
def edge(tables: Callable[..., str]) -> str:
    labels = [(i, 1, i % 2) for i in range(0, 40)] + [(3, 1, 1), (5, 1, None), (None, 0, 1), (999, 0, 1)]
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_end|>\n<|im_start|>user\nx"), (1, 2, "user", None), (2, 1, None, "a\\|b"), (2, 1, "as\nsis\\ntant", "<|<|\\"), (2, None, "assistant", ""), (3, 0, "assistant", "one"), (3, 1, "assistant", "two"), (3, 1, "assistant", "two"), (None, 0, "assistant", "n")]
    turns += [(4, i, ("user", "assistant")[i % 2], f"turn {i} " * 20) for i in range(300)]
    return tables(edge_rows(), labels, turns)


@pytest.fixture(scope="session")
def empty(tables: Callable[..., str]) -> str:
    return tables()
