"""Best-fit packing by length-histogram planning (operator 6).

Documents become pieces of at most ``capacity`` tokens. Best-fit decreasing runs over the counts of
the lengths, at most ``capacity`` numbers, not over documents: sequences alike are one entry with a
count, and an entry takes as many pieces of a length at once as fit. The plan lists, for each length,
which ranks go to which run of sequences at which offset. Every piece then looks up the slot of its
rank within its length. Only the histogram reaches the driver; the plan's size depends on the
capacity, not on the data.

Tokens come from a tokenizer file of the ``tokenizers`` library. Where a text has only characters
below U+0250, no special token and no huge run of blanks, the same vocabulary runs in ``tiktoken``,
whose ids are the same there and which is five times as fast; all other texts go to ``tokenizers``.

Edges: a null or empty text is the end token alone; rows equal in id are packed one by one; an empty
table gives no rows; a text is never cut before it is tokenized.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, rank_within, salts, written

OTHER_SCRIPT = re.compile("[^\x00-ɏ]")
BLANKS = re.compile(r"\s{2000}")
Segment = tuple[int, int, int, int, int]

_encoders: dict[str, Callable[[str], np.ndarray]] = {}


def byte_symbols() -> dict[str, int]:
    """The printable symbol that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the other bytes for U+0100 onwards, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to token ids; one for each process and file."""
    if path in _encoders:
        return _encoders[path]
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec["added_tokens"]]
    back = byte_symbols()
    ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    split = spec.get("pre_tokenizer") or {}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    known = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer") and spec["model"].get("type") == "BPE"
    fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    exact: list[Tokenizer] = []

    def encode(text: str) -> np.ndarray:
        plain = (text.isascii() or not OTHER_SCRIPT.search(text)) and not any(s in text for s in special)
        if known and plain and not (len(text) > 2000 and BLANKS.search(text)):
            return np.asarray(fast.encode_ordinary(text), dtype="<u4")
        if not exact:
            exact.append(Tokenizer.from_file(path))
        return np.array(exact[0].encode(text, add_special_tokens=False).ids, dtype="<u4")

    _encoders[path] = encode
    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of n tokens' pieces; the first takes what does not fill a piece."""
    first = n - capacity * ((n - 1) // capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, end: int, capacity: int, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of ``docs(doc_id, text)``."""
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            rows: list[tuple] = []
            at: list[int] = []
            for i, t in enumerate(b.column("text")):
                all_ids = np.append(encode(t.as_py() or ""), np.array([end], "<u4")).astype("<u4")
                for k, (start, n) in enumerate(cut(len(all_ids), capacity)):
                    part = all_ids[start : start + n]
                    rows.append((k, start, n, zlib.crc32(part.tobytes()), part.astype(np.int32)) if ids else (k, start, n, zlib.crc32(part.tobytes())))
                    at.append(i)
            columns = [pa.array([r[j] for r in rows], kind) for j, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int32())), *columns], names=["doc_id", *(n for n, _ in fields)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if ids else ""))


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Segment], int]:
    """Best-fit decreasing over {length: count}: segments (length, first rank, ranks, first sequence,
    offset), in order of length and rank, and the number of sequences."""
    open_: dict[int, list[tuple[int, int]]] = {}  # room left: runs (first sequence, sequences)
    out: list[Segment] = []
    made = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = min((r for r in open_ if r >= length), default=0)
            if not room:
                room, fresh = capacity, -(-left // (capacity // length))
                open_[room] = [(made, fresh)]
                made += fresh
            first, n = open_[room].pop()
            each = min(room // length, left)
            full = min(n, left // each)
            for i in range(each):
                out.append((length, rank, full, first, capacity - room + i * length))
                rank += full
            left -= full * each
            if n > full:
                open_[room].append((first + full, n - full))
            if not open_[room]:
                del open_[room]
            if rest := room - each * length:
                open_.setdefault(rest, []).append((first, full))
    return sorted(out), made


def pack(parts: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = np.array(plan(counts, capacity)[0], dtype=np.int64).reshape(-1, 5)
    stride = max(counts.values(), default=0) + 1
    starts = found[:, 0] * stride + found[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("__rank").to_numpy()
            seg = found[np.searchsorted(starts, length * stride + rank, side="right") - 1]
            kept = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seg[:, 3] + rank - seg[:, 1]), pa.array(seg[:, 4])], names=[*names, "sequence_id", "offset"])

    names = parts.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    cells = salts(max(counts.values(), default=0), least=64)
    ranked = rank_within(parts, ["length"], F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(cells)), [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "__rank")
    return ranked.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) of packed pieces with ids; a sequence is bounded by the capacity."""
    part = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    whole = packed.groupBy("sequence_id").agg(part.alias("p"))
    return whole.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, capacity: int = 1024, end: int = 2, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of ``docs(doc_id, text)``."""
    parts = written(pieces(docs, path or tokenizer_path(), end, capacity), "pieces")
    return pack(parts, capacity)


def op6_histogram_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
