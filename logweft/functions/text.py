"""Text helpers of the service surface: UTF-8 repair, URLs, splitting, gzip, prefixes."""

from __future__ import annotations

import gzip
import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

GZIP_FROM_BYTES = 1024

#: A structurally whole sequence (overlong forms and surrogates pass), or any one other byte.
SEQUENCE = re.compile(rb"[\x00-\x7f]|[\xc0-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf7][\x80-\xbf]{3}|([\x80-\xff])", re.S)


def repair_bytes(raw: bytes) -> bytes:
    return SEQUENCE.sub(lambda m: b"?" if m[1] else m[0], raw)


@F.pandas_udf(BinaryType())
def _repair(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else repair_bytes(bytes(b)))


def ensure_utf8(raw: Column) -> Column:
    """Each byte that starts no structurally whole UTF-8 sequence becomes '?'. BINARY to BINARY."""
    return _repair(raw)


def url_decode(c: Column) -> Column:
    """%HH only; a plus stays."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def url_encode(c: Column) -> Column:
    """Letters, digits and - _ . ~ stay, all else becomes %HH."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def quote_url(text: str) -> str:
    return quote(text, safe="-_.~")


def split_tokens(c: Column, delimiter: str) -> Column:
    """Tokens between single characters; no empty token at the end, none at all of an empty text."""
    parts = F.split(c, re.escape(delimiter), -1)
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def query_parameter(uri: Column, name: str) -> Column:
    """The first value of a parameter, not decoded; null where it is absent."""
    query = F.regexp_extract(uri, r"^[^?]*\?(.*)$", 1)
    found = F.regexp_extract(query, rf"(?:^|&){re.escape(name)}=([^&]*)", 1)
    return F.when(query.rlike(rf"(?:^|&){re.escape(name)}="), found)


def url_parts(url: Column) -> Column:
    """struct<host, port, target> of http(s)://host[:port][/target]; null where it is no such URL."""
    pattern = r"^(https?)://([^/:]+)(?::([0-9]+))?(/.*)?$"
    part = lambda i: F.regexp_extract(url, pattern, i)
    port = F.when(part(3) != "", part(3)).when(part(1) == "https", "443").otherwise("80")
    target = F.when(part(4) == "", "/").otherwise(part(4))
    return F.when(url.rlike(pattern), F.struct(part(2).alias("host"), port.alias("port"), target.alias("target")))


def ip_matches_prefix(ip: Column, prefixes: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(ip, p)) if prefixes else F.lit(False)


def file_type(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".gz"), "gzip").otherwise("text")


def compress_body(body: bytes, accepts: str) -> tuple[bytes, str]:
    """(body, content encoding): gzip for clients that take it, from 1024 bytes on."""
    if len(body) >= GZIP_FROM_BYTES and "gzip" in accepts:
        return gzip.compress(body), "gzip"
    return body, ""


def decompress_body(body: bytes, encoding: str) -> bytes:
    return gzip.decompress(body) if encoding == "gzip" else body
