"""MurmurHash64A and the identifiers made from it, vectorised; used on catalog rows, not on lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the hash and of the etag's seed.
MULTIPLIER = 0xC6A4A7935BD1E995
ETAG_SEED = 3339675888
MASK = (1 << 64) - 1


def murmur64a(data: bytes, seed: int = 0) -> int:
    """Appleby's MurmurHash64A of one byte string."""
    h = seed ^ (len(data) * MULTIPLIER & MASK)
    whole = len(data) // 8 * 8
    for k in np.frombuffer(data[:whole], "<u8").tolist():
        k = k * MULTIPLIER & MASK
        h = (h ^ ((k ^ k >> 47) * MULTIPLIER & MASK)) * MULTIPLIER & MASK
    if tail := data[whole:]:
        h = (h ^ int.from_bytes(tail, "little")) * MULTIPLIER & MASK
    h = (h ^ h >> 47) * MULTIPLIER & MASK
    return h ^ h >> 47


def murmur64a_pairs(first: np.ndarray, second: np.ndarray, seed: int) -> np.ndarray:
    """Of 16-byte inputs, two little-endian words each, all at once."""
    m = np.uint64(MULTIPLIER)
    with np.errstate(over="ignore"):
        h = np.full(len(first), seed ^ (16 * MULTIPLIER & MASK), np.uint64)
        for k in (first.astype(np.uint64) * m, second.astype(np.uint64) * m):
            h = (h ^ (k ^ k >> np.uint64(47)) * m) * m
        h = (h ^ h >> np.uint64(47)) * m
    return h ^ h >> np.uint64(47)


@F.pandas_udf(StringType())
def _etag(size: pd.Series, mtime: pd.Series) -> pd.Series:
    known = (size.notna() & mtime.notna()).to_numpy()
    h = murmur64a_pairs(size[known].to_numpy("int64"), mtime[known].to_numpy("int64"), ETAG_SEED)
    out = np.full(len(size), None, object)
    out[known] = [f"{x:016x}" for x in h.tolist()]
    return pd.Series(out)


@F.pandas_udf(StringType())
def _agent_id(address: pd.Series) -> pd.Series:
    return address.map(lambda a: None if a is None else str(murmur64a(a.encode())))


def etag(size: Column, mtime: Column) -> Column:
    """16 lower-case hex digits; changes with size or modification time; null where either is."""
    return _etag(size, mtime)


def agent_id(address: Column) -> Column:
    """The decimal text of the address's hash."""
    return _agent_id(address)
