"""Responses as JSON: one document a row in Spark, or one body for a client."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import compress_body


def search_json(result: DataFrame, with_agent: bool = True) -> DataFrame:
    """A row ``value`` for each file of a search result."""
    names = [*(["agent"] if with_agent else []), "path", "status", "error_msg", "start_time", "end_time", "lines"]
    return result.select(F.to_json(F.struct(*names)).alias("value"))


def list_json(files: DataFrame) -> DataFrame:
    """A row ``value`` for each listed file; absent fields are left out."""
    return files.select(F.to_json(F.struct("path", "size", "mtime", "etag", "start_time", "end_time")).alias("value"))


def write_json(result: DataFrame, path: str, compress: bool = True) -> None:
    result.write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def search_body(result: DataFrame, accepts: str = "") -> tuple[bytes, str]:
    """One response body for a client, and its encoding. The result is bounded by files times the cap."""
    rows = [json.loads(r["value"]) for r in search_json(result).toLocalIterator()]
    body = json.dumps({"status": 0, "error_msg": "", "records": rows}, ensure_ascii=False).encode()
    return compress_body(body, accepts)
