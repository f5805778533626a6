r"""Personal data by bootstrapped contextual extraction (operator 8).

Base patterns find emails, IP addresses, card and phone numbers; these spans always stay. They are
the seeds. Each seed, and each other stretch of text that could be an identifier, is an instance with
lexical patterns: the two words before it, and the word before with the word after. What could be one:
a word of six characters or more with three digits or more; two to six words in a row that all have a
digit and together six digits or more; an address with its at and dot spelt out; an @name.

Patterns and instances form a bipartite graph, one edge for each pair however often it occurs. Seeds have
score 1. A pattern's confidence for a kind is the sum of the scores of its accepted instances and seeds
of the kind, over the number of all its instances and one more; it counts where ``support`` of these
instances or more are accepted or seeds. An unknown instance's score is the noisy-or of its patterns, and
at ``accept`` or above it is accepted, for good, with its best kind. Accepted instances stand beside the
seeds in the next turn, so patterns that only they share can find others; the turns end when one accepts
nothing new. Accepted values become spans wherever they occur; of two that lie in one another the longer.

All scores live in tables in the shared folder; nothing of the graph reaches the driver.

Edges: a null text is empty and has no spans; spans are in code points, end exclusive; overlapping
spans of different kinds all count; rows equal in id and text have equal spans; an empty table gives
no rows. The base patterns are matched without the quadratic scans that long runs would cost.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, done_with, written

KINDS = ("email", "ip", "card", "phone")
WORD = re.compile("[^\x20\x09-\x0d]+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")
WRAP = "\"'`()[]{}<>,.;:!?"
DIGIT = re.compile("[0-9]")
SPELT = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20|@)[A-Za-z0-9-]++"
    r"(?:(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    re.IGNORECASE,
)
MAY = re.compile(r"[0-9@]|dot", re.IGNORECASE)
NAME = re.compile(r"(?<![A-Za-z0-9._%+-])@[A-Za-z0-9_]{3,}+(?![A-Za-z0-9.@-]*@)")
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, kind, end), sorted. An email is found at its @ and grown to the left: no other @ can
    stand in its local part, so this is the leftmost match."""
    out: list[Span] = []
    done = 0
    for m in DOMAIN.finditer(text):
        at = m.start()
        while at > done and text[at - 1] in LOCAL:
            at -= 1
        if at < m.start():
            out.append((at, 0, m.end()))
            done = m.end()
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """Without the marks around; an opening parenthesis that closes inside stays."""
    while b > a and text[b - 1] in WRAP:
        b -= 1
    while a < b and text[a] in WRAP and not (text[a] == "(" and text.find(")", a, b) > 0):
        a += 1
    return a, b


def candidates(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of what could be an identifier. What stands before = or : in a word is no part of it."""
    out = [m.span() for m in SPELT.finditer(text)] + [m.span() for m in NAME.finditer(text)]
    run: list[tuple[int, int, int]] = []  # words in a row with a digit: start, end, digits

    def close() -> None:
        if 2 <= len(run) <= 6 and sum(n for _, _, n in run) >= 6:
            out.append(trimmed(text, run[0][0], run[-1][1]))
        run.clear()

    for s, e in words:
        digits = len(DIGIT.findall(text, s, e))
        if digits == 0 or run and s != run[-1][1] + 1:
            close()
        if digits:
            cut = max(text.rfind("=", s, e), text.rfind(":", s, e)) + 1 or s
            if cut > s:
                close()
            a, b = trimmed(text, cut, e)
            if b - a >= 6 and len(DIGIT.findall(text, a, b)) >= 3:
                out.append((a, b))
            if b > a:
                run.append((cut, e, digits))
            if text[e - 1] in ",.;:!?":
                close()
    close()
    return out


def instances(text: str, spans: list[Span]) -> list[tuple[int, int, int, list[str], str]]:
    """(kind or -1, start, end, patterns, value) of the seeds and of the candidates that touch no base span.
    A part of a word that stands before an instance is the word before it where it has a letter."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    covered = sorted((s, e) for s, _, e in spans)
    ends = list(accumulate((e for _, e in covered), max))
    out = []
    todo = [(k, s, e) for s, k, e in spans]
    for a, b in sorted(set(candidates(text, words))):
        i = bisect_right(ends, a)  # the first base span that does not end before it
        if i == len(covered) or covered[i][0] >= b:
            todo.append((-1, a, b))
    starts = [s for s, _ in words]
    for kind, a, b in todo:
        i = bisect_right(starts, a) - 1
        inside = text[starts[i] : a].lower() if starts[i] < a <= starts[i] + 64 else ""
        inside = inside if any(c.isalpha() for c in inside) else ""
        before = ([text[s:e].lower() for s, e in words[max(0, i - 2) : i]] + [inside] * bool(inside))[-2:]
        j = bisect_right(starts, b - 1)
        after = text[words[j][0] : words[j][1]].lower() if j < len(words) else ""
        made = ["L " + " ".join(before)] if len(before) == 2 else []
        if before and after:
            made.append(f"B {before[-1]} _ {after}")
        out.append((kind, a, b, [p for p in made if len(p) <= 200 and not DIGIT.search(p)], text[a:b].lower()))
    return out


def found_spans(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, __uid, base (kind, start, stop) and seen (kind, start, stop, patterns, value)."""
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())])
    seen = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("patterns", pa.list_(pa.string())), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, rest = [], []
            for x in b.column("__text"):
                text = x.as_py() or ""
                spans = base_spans(text) if MAY.search(text) else []
                base.append([{"start": s, "kind": k, "stop": e} for s, k, e in spans])
                some = instances(text, spans) if MAY.search(text) else []
                rest.append([{"kind": k, "start": s, "stop": e, "patterns": p, "value": v} for k, s, e, p, v in some])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*columns, "__uid"]), pa.array(base, pa.list_(span)), pa.array(rest, pa.list_(seen))], names=[*columns, "__uid", "base", "seen"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    kinds += ", __uid bigint, base array<struct<start: bigint, kind: int, stop: bigint>>, seen array<struct<kind: int, start: bigint, stop: bigint, patterns: array<string>, value: string>>"
    return docs.select(*columns, F.xxhash64("doc_id", "text").alias("__uid"), F.col("text").alias("__text")).mapInArrow(run, kinds)


def discovered(seen: DataFrame, support: int = 3, accept: float = 0.8) -> DataFrame:
    """(value, kind) of the unknown instances that the graph of ``seen(kind, patterns, value)`` accepts."""
    edges = seen.select("kind", "value", F.explode("patterns").alias("pattern"))
    edges = written(edges.select(F.xxhash64("pattern").alias("p"), "kind", "value").distinct(), "edges")
    seeds = edges.where("kind >= 0").groupBy("p", "kind").agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).cast("double").alias("sure"))
    seeds, degree = written(seeds, "seeds"), written(edges.groupBy("p").agg(F.count(F.lit(1)).alias("all")), "degree")
    unknown = edges.where("kind < 0").select("p", "value")
    accepted: DataFrame | None = None
    total = 0
    while True:
        known = seeds
        if accepted is not None:
            more = unknown.join(accepted, "value").groupBy("p", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("sure"))
            known = seeds.unionByName(more).groupBy("p", "kind").agg(F.sum("n").alias("n"), F.sum("sure").alias("sure"))
        sure = known.where(F.col("n") >= support).join(degree, "p").select("p", "kind", (F.col("sure") / (F.col("all") + 1)).alias("confidence"))
        sure = written(sure, "confidence")
        missed = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        scores = unknown.join(sure, "p").groupBy("value", "kind").agg((1 - F.exp(missed)).alias("score"))
        best = scores.groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("kind"))).alias("b")).where(F.col("b.score") >= accept)
        best = best.select("value", (-F.col("b.kind")).alias("kind"), "b.score")
        if accepted is not None:  # what is accepted keeps its kind and score
            best = accepted.union(best.join(accepted, "value", "left_anti"))
        old, accepted = accepted, written(best, "accepted")
        n = accepted.count()
        if n == total:
            return accepted.select("value", "kind")
        total = n
        if old is not None:
            done_with(old)


def personal_data(docs: DataFrame, columns: list[str], **options: float) -> DataFrame:
    """``columns``, base and spans: arrays of (start, kind, stop), sorted; spans holds base."""
    table = written(found_spans(docs, columns), "found")
    accepted = written(discovered(table.select(F.explode("seen").alias("s")).select("s.kind", "s.patterns", "s.value"), **options), "accepted")
    places = table.select("__uid", F.explode(F.filter("seen", lambda s: s["kind"] < 0)).alias("s")).select("__uid", "s.start", "s.stop", "s.value")
    new = places.join(accepted, "value").groupBy("__uid").agg(F.collect_set(F.struct("start", "kind", "stop")).alias("__new"))

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(longest, b.column(1).to_pylist()), b.column(1).type)], names=b.schema.names)

    new = written(new.mapInArrow(outer, new.schema), "new")  # few rows of known size: joined without moving the documents
    none = F.array().cast("array<struct<start: bigint, kind: int, stop: bigint>>")
    return table.join(new, "__uid", "left").select(*columns, "base", F.array_sort(F.concat("base", F.coalesce("__new", none))).alias("spans"))


def longest(found: list[dict]) -> list[dict]:
    """Spans without those that lie in another one."""
    kept, end = [], -1
    for s in sorted(found, key=lambda s: (s["start"], -s["stop"], s["kind"])):
        if s["stop"] > end:
            kept.append(s)
            end = s["stop"]
    return kept


def joined(spans: str) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"], s["stop"])), ",")


def mask(text: str, spans: list[dict]) -> str:
    """The text with each span replaced by <kind>; where sorted spans overlap, the first one's kind stands."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{KINDS[s['kind']]}>"]
        at = max(at, s["stop"])
    return "".join([*out, text[at:]])


def masked(df: DataFrame, text: str, spans: str) -> DataFrame:
    """``df`` with the spans of its text masked; texts without spans pass as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old, found = b.column(text), b.column(spans)
            has = pc.and_kleene(pc.greater(pc.list_value_length(found), 0), old.is_valid()).fill_null(False)
            new = [mask(t, s) for t, s in zip(old.filter(has).to_pylist(), found.filter(has).to_pylist(), strict=True)]
            columns = [pc.replace_with_mask(old, has, pa.array(new, old.type)) if n == text else b.column(n) for n in b.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def op8_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(documents(spark, sf_dir), ["doc_id"])
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, i)).cast("bigint") for i in range(len(KINDS))]
    counts = [(F.size("base") - n).alias(f"n_{k}") for k, n in zip(KINDS, counts, strict=True)]
    return out.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
