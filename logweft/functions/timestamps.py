"""Timestamps in log lines.

Only the first 50 bytes of a line count. The formats are tried in order; of each, only its first
match, and a match that is no valid date and time lets the next format try. Wall clock times are read
at a fixed offset from UTC; fractions and zone suffixes are ignored.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX_BYTES = 50
BUCKET_SECONDS = 300

# The recognised formats, in order.
FORMATS = (
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    (r"\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}", "yyyy/MM/dd HH:mm:ss", "%Y/%m/%d %H:%M:%S"),
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    (r"\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}", "dd/MMM/yyyy:HH:mm:ss", "%d/%b/%Y:%H:%M:%S"),
)
YEARLESS = r"[A-Za-z]{3} \d{2} \d{2}:\d{2}:\d{2}"


def wall_seconds(ts: Column) -> Column:
    """Epoch seconds of a timestamp's wall clock, whatever the session's zone."""
    return F.unix_date(F.to_date(ts)).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def line_prefix(line: Column) -> Column:
    return F.substring(line.cast("binary"), 1, PREFIX_BYTES).cast("string")


def extract_timestamp(line: Column, tz_offset_seconds: int = 0, default_year: int | None = None) -> Column:
    """Epoch seconds of a line, or null. Lines without a year have none unless ``default_year`` is given."""
    prefix = line_prefix(line)
    found = []
    for pattern, fmt, _ in FORMATS:
        text = F.nullif(F.regexp_extract(prefix, pattern, 0), F.lit(""))
        found.append(F.unix_seconds(F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit(fmt + "X"))))
    if default_year is not None:
        text = F.nullif(F.regexp_extract(prefix, YEARLESS, 0), F.lit(""))
        found.append(F.unix_seconds(F.try_to_timestamp(F.concat(F.lit(f"{default_year} "), text, F.lit("Z")), F.lit("yyyy MMM dd HH:mm:ssX"))))
    return F.coalesce(*found) - F.lit(tz_offset_seconds).cast("bigint")


_COMPILED = [(re.compile(p.encode()), f) for p, _, f in FORMATS]


def timestamp_of(line: bytes, tz_offset_seconds: int = 0) -> int | None:
    """The same for one line outside a plan: readers of raw files use it."""
    prefix = line[:PREFIX_BYTES]
    for pattern, fmt in _COMPILED:
        if m := pattern.search(prefix):
            try:
                parsed = datetime.strptime(m[0].decode("ascii"), fmt)
            except ValueError:
                continue
            return int((parsed - datetime(1970, 1, 1)).total_seconds()) - tz_offset_seconds
    return None


def bucket(ts: Column, seconds: int = BUCKET_SECONDS) -> Column:
    return ts - ts % seconds


def format_timestamp(ts: Column, fmt: str = "yyyy-MM-dd HH:mm:ss", tz_offset_seconds: int = 0) -> Column:
    """Local wall clock text of epoch seconds."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor((ts + tz_offset_seconds) / 86400).cast("int"))
    second = F.pmod(ts + tz_offset_seconds, F.lit(86400))
    clock = F.format_string("%02d:%02d:%02d", F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)
    return F.date_format(F.to_timestamp_ntz(F.concat_ws(" ", day.cast("string"), clock)), fmt)
