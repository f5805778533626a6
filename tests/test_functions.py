from __future__ import annotations

import gzip

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from logweft.functions import hashing, predicates, text
from logweft.functions.timestamps import bucket, extract_timestamp, format_timestamp, timestamp_of

LINES = [
    ("junk before", None),
    ("2024-01-01 00:00:01 INFO start\r", 1704067201),
    ("  at x.y(Z.java:1)", None),
    ("2024/01/01 00:05:03 WARN slow", 1704067503),
    ("[x] 2024-01-01T00:10:00Z INFO done", 1704067800),
    ("Jan 02 03:04:05 host app: hi", None),
    ('127.0.0.1 - - [02/Jan/2024:03:04:06 +0000] "GET /"', 1704164646),
    ("2024-02-30 00:00:00 bad date", None),
    ("2024-02-30 00:00:00 2024/03/01 00:00:00", 1709251200),
    ("2024-01-01 24:00:00 hour", None),
    ("2024-01-01 23:59:60 second", None),
    ("x" * 31 + "2024-01-01 00:00:01", 1704067201),
    ("x" * 32 + "2024-01-01 00:00:01", None),
    ("é" * 16 + "2024-01-01 00:00:01", None),
    ("", None),
]


def test_timestamps(spark: SparkSession) -> None:
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(LINES)], "i int, line string")
    got = [r.t for r in df.select("i", extract_timestamp(F.col("line")).alias("t")).orderBy("i").collect()]
    assert got == [t for _, t in LINES]
    assert [timestamp_of(x.encode()) for x, _ in LINES] == got


def test_timestamp_options(spark: SparkSession) -> None:
    df = spark.createDataFrame([("Jan 02 03:04:05 host",), ("2024-01-01 00:00:00",)], "line string")
    got = [r.t for r in df.select(extract_timestamp(F.col("line"), 3600, 2023).alias("t")).collect()]
    assert got == [1672628645 - 3600, 1704067200 - 3600]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        other = [r.t for r in df.select(extract_timestamp(F.col("line"), 3600, 2023).alias("t")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert other == got


def test_bucket_and_format(spark: SparkSession) -> None:
    row = spark.range(1).select(bucket(F.lit(1704067499)).alias("b"), format_timestamp(F.lit(1704067499)).alias("f"), format_timestamp(F.lit(1704067499), tz_offset_seconds=-3600).alias("g")).first()
    assert tuple(row) == (1704067200, "2024-01-01 00:04:59", "2023-12-31 23:04:59")


TEXTS = ["error database timeout", "error database", "warning database", "warning", "a b", "ANDROID", ""]
VALID = {
    "error AND database": lambda s: "error" in s and "database" in s,
    "error NOT timeout": lambda s: "error" in s and "timeout" not in s,
    "(error OR warning) AND database": lambda s: ("error" in s or "warning" in s) and "database" in s,
    "error (database)": lambda s: "error" in s and "database" in s,
    "(error) database": lambda s: "error" in s and "database" in s,
    "error OR warning (ANDROID)": lambda s: "error" in s or "warning" in s or "ANDROID" in s,
    "error AND": lambda s: "error" in s,
    "AND error": lambda s: "error" in s,
    "AND": lambda s: False,
    "   ": lambda s: False,
    "()": lambda s: False,
    "NOT ()": lambda s: True,
    "\"a b\" AND 'b'": lambda s: "a b" in s,
    "ANDROID OR and": lambda s: "ANDROID" in s or "and" in s,
    r"a\ b": lambda s: "a b" in s,
    "NOT(error)": lambda s: "error" not in s,
    '"" error': lambda s: "error" in s,
}


def test_boolean_queries(spark: SparkSession) -> None:
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, line string")
    made = [predicates.compile_query("boolean", q)(F.col("line")).alias(f"q{i}") for i, q in enumerate(VALID)]
    rows = df.select("line", *made).collect()
    for r in rows:
        assert [r[f"q{i}"] for i in range(len(VALID))] == [f(r.line) for f in VALID.values()], r.line


@pytest.mark.parametrize("query", ["a AND b OR c", "a b", "NOT a b", '"a" "b"', "NOT NOT a", "NOT", "a AND NOT", "(a", "a)", '"abc', "(NOT)"])
def test_boolean_errors(query: str) -> None:
    with pytest.raises(ValueError):
        predicates.parse_boolean(query)


def test_bad_requests() -> None:
    for kind, query in (("simple", ""), ("fuzzy", "x"), ("regex", "(")):
        with pytest.raises(ValueError):
            predicates.compile_query(kind, query)


def test_regex_reaches_over_lines(spark: SparkSession) -> None:
    df = spark.createDataFrame([("a\nb c",)], "line string")
    hit = [predicates.compile_query("regex", p)(F.col("line")) for p in ("a.b", "^b", "a$", "^c", r"b\s")]
    assert list(df.select(*hit).first()) == [True, True, True, False, True]


def test_match_positions(spark: SparkSession) -> None:
    df = spark.createDataFrame([("x error a=12 click",)], "line string")
    get = lambda kind, q: [tuple(h) for h in df.select(predicates.match_positions(kind, q, F.col("line")).alias("m")).first().m]
    assert get("simple", "error") == [("error", 2)]
    assert get("boolean", "error AND (nope OR click) NOT zzz") == [("error", 2), ("click", 13)]
    assert get("boolean", "error AND nope") == []
    assert get("regex", r"a=(\d)(\d)") == [("a=12", 8), ("1", 10), ("2", 11)]
    df = spark.createDataFrame([("x a=11 y",)], "line string")
    assert get("regex", r"a=(\d)(\d)") == [("a=11", 2), ("1", 4), ("1", 5)] and get("regex", r"a=(z)?1") == [("a=1", 2), ("", -1)]
    assert get("regex", "a=.") == [("a=1", 2)] and get("regex", "(b)") == []


def test_registering_a_searcher(spark: SparkSession) -> None:
    predicates.register_searcher("prefix", lambda q: lambda line: F.startswith(line, F.lit(q)))
    try:
        df = spark.createDataFrame([("abc",), ("xabc",)], "line string")
        assert df.where(predicates.conjunction([("ab", "prefix"), ("c", "simple")], F.col("line"))).count() == 1
    finally:
        del predicates.SEARCHERS["prefix"]


def test_hash_vectors(spark: SparkSession) -> None:
    cases = [(0, 0, "98da369c7313a826"), (1, 1, "9b5346cd3b6e5259"), (1048576, 1700000000, "a07d11abfbce07e9"), (104857600, 1761490100, "ba233c3bcb2dd63b")]
    df = spark.createDataFrame(cases, "size bigint, mtime bigint, want string")
    assert df.where(hashing.etag(F.col("size"), F.col("mtime")) != F.col("want")).count() == 0
    df = spark.createDataFrame([(1, 1), (None, 1), (1, None)], "size bigint, mtime bigint")
    assert [r.e for r in df.select(hashing.etag(F.col("size"), F.col("mtime")).alias("e")).collect()] == ["9b5346cd3b6e5259", None, None]
    ids = {"127.0.0.1:8113": "2844607971204861183", "10.0.0.1:8113": "74110691827657299", "": "0"}
    df = spark.createDataFrame(list(ids.items()), "address string, want string")
    assert df.where(hashing.agent_id(F.col("address")) != F.col("want")).count() == 0


def test_utf8_repair(spark: SparkSession) -> None:
    cases = {b"ok \xc3\xa9": b"ok \xc3\xa9", b"\xc3": b"?", b"\xc3(": b"?(", b"\xe2\x82": b"??", b"\xf0\x9f\x98\x80": b"\xf0\x9f\x98\x80", b"\xff\x80a": b"??a", b"\xc0\x80": b"\xc0\x80", b"\xed\xa0\x80": b"\xed\xa0\x80"}
    df = spark.createDataFrame([(bytearray(k),) for k in cases], "b binary")
    assert [bytes(r[0]) for r in df.select(text.ensure_utf8(F.col("b"))).collect()] == list(cases.values())


def test_urls(spark: SparkSession) -> None:
    df = spark.createDataFrame([("a+b%20c%2Fé",)], "u string")
    assert df.select(text.url_decode(F.col("u"))).first()[0] == "a+b c/é"
    enc = "a b*~-_.é/"
    assert spark.range(1).select(text.url_encode(F.lit(enc))).first()[0] == text.quote_url(enc) == "a%20b%2A~-_.%C3%A9%2F"
    row = spark.range(1).select(text.query_parameter(F.lit("/x?a=1&b=&a=2"), "a").alias("a"), text.query_parameter(F.lit("/x?a=1&b="), "b").alias("b"), text.query_parameter(F.lit("/x?a=1"), "c").alias("c")).first()
    assert tuple(row) == ("1", "", None)
    df = spark.createDataFrame([("http://h",), ("https://h/x?y",), ("http://h:81/z",), ("ftp://h",)], "u string")
    got = [r.p and tuple(r.p) for r in df.select(text.url_parts(F.col("u")).alias("p")).collect()]
    assert got == [("h", "80", "/"), ("h", "443", "/x?y"), ("h", "81", "/z"), None]


def test_small_helpers(spark: SparkSession) -> None:
    df = spark.createDataFrame([("",), ("a",), ("a,",), (",a,,b",)], "s string")
    assert [r[0] for r in df.select(text.split_tokens(F.col("s"), ",")).collect()] == [[], ["a"], ["a"], ["", "a", "", "b"]]
    df = spark.createDataFrame([("10.1.2.3",), ("192.168.0.1",)], "ip string")
    assert [r[0] for r in df.select(text.ip_matches_prefix(F.col("ip"), ["10.", "172."])).collect()] == [True, False]
    assert [r[0] for r in spark.createDataFrame([("a.GZ",), ("gz",)], "n string").select(text.file_type(F.col("n"))).collect()] == ["gzip", "text"]
    body, how = text.compress_body(b"x" * 2000, "gzip, br")
    assert how == "gzip" and gzip.decompress(body) == text.decompress_body(body, how) == b"x" * 2000
    assert text.compress_body(b"x", "gzip") == (b"x", "") and text.compress_body(b"x" * 2000, "") == (b"x" * 2000, "")
