"""Sharding by histogram sort (operator 4).

Rows are ordered by a 64-bit hash of the text, so equal texts are neighbours. Candidate boundaries
(probes) are refined: each turn counts the exact bytes below every probe over all partitions, and
each wanted boundary keeps the tightest interval that still holds it. A boundary is settled when its
bytes are within the tolerance, or when its interval holds a single hash value. A group of equal
texts stays whole unless it alone breaks the tolerance; then a second search, over a hash of the row's
id and place within that value, splits it. After that the rows are exchanged once, by shard.

What reaches the driver in a turn is one row per probe, whatever the input's size.

Edges: a null text counts as empty; rows equal in text and id are told apart by their place in the table,
so repeated rows, null ids among them, split as others do; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, rank_within, salts, written

LOW, HIGH = -(2**63), 2**63
Splitter = tuple[int, int]


def histogram(df: DataFrame, key: str, size: str, probes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(bucket, bytes, rows, least key, greatest key) of the buckets that ``probes`` cut; bucket i
    holds keys from probe i-1 up to but not including probe i. One row per bucket and task moves."""
    edges = np.array(probes, dtype=np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(edges) + 1
        total, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        for b in batches:
            k, s = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            at = np.searchsorted(edges, k, side="right")
            np.add.at(total, at, s)
            np.add.at(rows, at, 1)
            np.minimum.at(least, at, k)
            np.maximum.at(most, at, k)
        has = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (has.astype(np.int64), total[has], rows[has], least[has], most[has])], names=["i", "b", "n", "lo", "hi"])

    parts = df.select(key, size).mapInArrow(count, "i long, b long, n long, lo long, hi long")
    found = parts.groupBy("i").agg(F.sum("b"), F.sum("n"), F.min("lo"), F.max("hi")).collect()
    return sorted(tuple(r) for r in found)


def refine(df: DataFrame, key: str, size: str, wanted: list[float], tolerance: float, fanout: int = 16) -> list[tuple[int, int, int, int]]:
    """For each wanted number of bytes (lo, bytes below lo, hi, bytes below hi): the boundary lies at
    lo if settled (hi == lo), else inside the rows of the single key lo (hi == lo + 1)."""
    first = histogram(df, key, size, []) if wanted else []
    if not first:
        return [(LOW, 0, LOW, 0)] * len(wanted)
    total, least, most = first[0][1], first[0][3], first[0][4]
    open_ = {j: (least, 0, most + 1, total) for j in range(len(wanted))}
    done: dict[int, tuple[int, int, int, int]] = {}
    while True:
        for j, (lo, below, hi, upto) in list(open_.items()):
            for at, b in ((hi, upto), (lo, below)):
                if abs(b - wanted[j]) <= tolerance:
                    done[j] = (at, b, at, b)
            if j not in done and hi - lo <= 1:
                done[j] = (lo, below, hi, upto)
            if j in done:
                del open_[j]
        if not open_:
            return [done[j] for j in range(len(wanted))]
        spans = {(lo, hi) for lo, _, hi, _ in open_.values()}
        probes = sorted({lo + (hi - lo) * i // (fanout + 1) for lo, hi in spans for i in range(fanout + 2)})
        buckets = histogram(df, key, size, [p for p in probes if LOW < p < HIGH])
        for j in open_:
            run = 0
            for _, b, _, k_lo, k_hi in buckets:  # the bucket that holds the wanted byte, cut to its keys
                if run + b > wanted[j] or (k_lo, k_hi) == buckets[-1][3:]:
                    open_[j] = (k_lo, run, k_hi + 1, run + b)
                    break
                run += b


def nearest(place: tuple[int, int, int, int], wanted: float) -> int:
    lo, below, hi, upto = place
    return min(lo if wanted - below <= upto - wanted else hi, HIGH - 1)


def splitters(df: DataFrame, size: str, n_shards: int, tolerance: float) -> list[Splitter]:
    """n_shards - 1 boundaries (hash of text, hash of id); rows at or above a boundary lie beyond it.

    A group of equal texts no larger than the largest single row goes whole to the nearer side, so a
    boundary is off by half the largest row at most; only larger groups are split."""
    total, largest = df.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    ideal = total / n_shards
    wanted = [ideal * j for j in range(1, n_shards)]
    found = refine(df, "__k1", size, wanted, tolerance * ideal)
    out: list[Splitter] = [(nearest(x, w), LOW) for x, w in zip(found, wanted, strict=True)]
    inside: dict[int, list[int]] = {}
    for j, (lo, below, hi, upto) in enumerate(found):
        if hi > lo and upto - below > largest:
            inside.setdefault(lo, []).append(j)
    for k, js in inside.items():
        rest = [wanted[j] - found[j][1] for j in js]
        group = refine(df.where(F.col("__k1") == k), "__k2", size, rest, tolerance * ideal)
        for j, x, w in zip(js, group, rest, strict=True):
            out[j] = (k, nearest(x, w))
    return sorted(out)


def shard_of(df: DataFrame, bounds: list[Splitter], out: str) -> DataFrame:
    """The number of boundaries at or below a row; ``bounds`` has one entry a shard."""
    one = np.array([a for a, _ in bounds], dtype=np.int64)
    two = [(i, np.int64(a), np.int64(b)) for i, (a, b) in enumerate(bounds) if b > LOW]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = b.column("__k1").to_numpy(zero_copy_only=False), b.column("__k2").to_numpy(zero_copy_only=False)
            s = np.searchsorted(one, k1, side="right").astype(np.int32)
            for _, a, c in two:
                s -= (k1 == a) & (k2 < c)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(place, f"{kinds}, `{out}` int")


RESULT = ("size", "text_crc32", "shard", "slot")


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``docs`` with size, text_crc32 and the sort keys; rows equal in text and id differ by their place."""
    t = F.coalesce(F.col(text), F.lit(""))
    plain = docs.drop(*[c for c in RESULT if c not in (text, doc_id)])
    return plain.withColumns({"__size": (F.octet_length(t) + 16).cast("bigint"), "__crc": F.crc32(t.cast("binary")), "__k1": F.xxhash64(t), "__k2": F.xxhash64(doc_id, F.monotonically_increasing_id())})


def histogram_shards(docs: DataFrame, text: str, doc_id: str, n_shards: int, tolerance: float = 0.002) -> DataFrame:
    """Adds size (UTF-8 bytes + 16), text_crc32, shard and slot to ``docs`` and drops the text; shards
    have near equal bytes. The searches read a written table of keys and sizes; its rows move once.
    Columns of the caller with a name of the result give way to it."""
    narrow = written(keyed(docs, text, doc_id).drop(text), "keys")
    placed = shard_of(narrow, splitters(narrow, "__size", n_shards, tolerance), "__shard")
    cells = salts(narrow.count() // max(1, n_shards))
    ranked = rank_within(placed, ["__shard"], F.pmod("__k2", F.lit(cells)), [F.col("__k1"), F.col("__k2")], "__slot")
    return ranked.withColumnsRenamed({"__size": "size", "__crc": "text_crc32", "__shard": "shard", "__slot": "slot"}).drop("__k1", "__k2")


def write_shards(docs: DataFrame, path: str, text: str, doc_id: str, n_shards: int, tolerance: float = 0.002, files: int = 1) -> None:
    """Writes all columns of ``docs`` as Parquet, a folder shard=i for each shard, each of ``files`` files
    that are ranges of the key and sorted by it. Texts move once; keys alone are searched."""
    whole = keyed(docs, text, doc_id)
    narrow = written(whole.select("__k1", "__k2", "__size"), "keys")
    placed = shard_of(whole, splitters(narrow, "__size", n_shards, tolerance), "shard").drop("__size", "__crc")
    dealt = placed.repartitionByRange(n_shards * files, "shard", "__k1", "__k2").sortWithinPartitions("shard", "__k1", "__k2")
    dealt.drop("__k1", "__k2").write.partitionBy("shard").parquet(path)


def op4_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histogram_shards(documents(spark, sf_dir).select("doc_id", "text"), "text", "doc_id", 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
