"""Search predicates: query text compiled to Columns.

simple   a case-sensitive substring of the whole record
boolean  substrings under AND, OR, NOT and parentheses; there is no precedence, so the operators of one
         parenthesis level must agree, and operands without any operator are joined by AND
regex    an unanchored search in which . matches line ends and ^ $ match at them
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cache, reduce

import pandas as pd
import regex as regex_module
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

BLANKS = " \t\r\n"
SPACE = " \t\r\n\v\f"


@dataclass(frozen=True)
class Word:
    text: str


@dataclass(frozen=True)
class Not:
    child: Node | None


@dataclass(frozen=True)
class All:
    children: tuple[Node | None, ...]


@dataclass(frozen=True)
class Any:
    children: tuple[Node | None, ...]


Node = Word | Not | All | Any


@dataclass
class Token:
    kind: str  # WORD AND OR NOT ( )
    text: str = ""


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def tokenize(query: str) -> list[Token]:
    out: list[Token] = []

    def word(text: str) -> None:
        if out and out[-1].kind == "WORD":
            raise ValueError(f"two words side by side near {text!r}: join them by an operator or quote them")
        out.append(Token("WORD", text))

    at, n = 0, len(query)
    while at < n:
        c = query[at]
        if c in SPACE:
            at += 1
        elif c in "()":
            out.append(Token(c))
            at += 1
        elif c in "'\"":
            m = re.compile(rf"{c}((?:\\.|[^{c}\\])*){c}", re.S).match(query, at)
            if m:
                text, at = m[1], m.end()
            elif len(query) > at + 1 and query.endswith(c):  # an escaped quote at the very end closes too
                text, at = query[at + 1 :], n
            else:
                raise ValueError("a quoted word does not end")
            if text := unescape(text):
                word(text)
        elif m := re.compile(rf"(AND|OR|NOT)(?=$|[{SPACE}()])").match(query, at):
            out.append(Token(m[1]))
            at = m.end()
        else:
            m = re.compile(rf"(?:\\.|[^{SPACE}()'\"\\]|\\$)+", re.S).match(query, at)
            word(unescape(m[0]))
            at = m.end()
    return out


@dataclass
class Level:
    """One parenthesis level being read: its operands, its operators, and a pending NOT."""

    nodes: list[Node | None] = field(default_factory=list)
    ops: set[str] = field(default_factory=set)
    negate: bool = False

    def add(self, node: Node | None) -> None:
        self.nodes.append(Not(node) if self.negate else node)
        self.negate = False

    def close(self) -> Node | None:
        if self.negate:
            raise ValueError("NOT needs a word or parenthesis after it")
        if len(self.ops) > 1:
            raise ValueError("AND and OR on one level: use parentheses")
        if len(self.nodes) < 2:
            return self.nodes[0] if self.nodes else None
        return Any(tuple(self.nodes)) if self.ops == {"OR"} else All(tuple(self.nodes))


def parse_boolean(query: str) -> Node | None:
    """The query's tree; None matches nothing. ValueError where the grammar does not hold."""
    levels = [Level()]
    for token in tokenize(query.strip(BLANKS)):
        top = levels[-1]
        if top.negate and token.kind not in ("WORD", "("):
            raise ValueError("NOT needs a word or parenthesis after it")
        if token.kind == "WORD":
            top.add(Word(token.text))
        elif token.kind == "NOT":
            top.negate = True
        elif token.kind == "(":
            levels.append(Level())
        elif token.kind == ")":
            if len(levels) == 1:
                raise ValueError("a closing parenthesis too many")
            levels.pop()
            levels[-1].add(top.close())
        else:
            top.ops.add(token.kind)
    if len(levels) > 1:
        raise ValueError("a parenthesis does not close")
    return levels[0].close()


def node_column(node: Node | None, line: Column) -> Column:
    match node:
        case None:
            return F.lit(False)
        case Word(text):
            return line.contains(F.lit(text))
        case Not(child):
            return ~node_column(child, line)
        case All(children):
            return reduce(lambda a, b: a & b, [node_column(c, line) for c in children])
        case Any(children):
            return reduce(lambda a, b: a | b, [node_column(c, line) for c in children])


def java_regex(query: str) -> str:
    """The pattern with its flags, checked now rather than when tasks run."""
    pattern = "(?smd)" + query
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        else:
            re.compile(query)
    except Exception as e:
        raise ValueError(f"bad regular expression {query!r}") from e
    return pattern


def simple(query: str) -> Callable[[Column], Column]:
    return lambda line: line.contains(F.lit(query))


def boolean(query: str) -> Callable[[Column], Column]:
    tree = parse_boolean(query)
    return lambda line: node_column(tree, line)


def regex(query: str) -> Callable[[Column], Column]:
    pattern = java_regex(query)
    return lambda line: line.rlike(pattern)


SEARCHERS: dict[str, Callable[[str], Callable[[Column], Column]]] = {"simple": simple, "boolean": boolean, "regex": regex}
COST = {"simple": 0, "boolean": 1, "regex": 2}


def register_searcher(kind: str, compile_query: Callable[[str], Callable[[Column], Column]]) -> None:
    """The extension point: a new query type."""
    SEARCHERS[kind] = compile_query


def compile_query(kind: str, query: str) -> Callable[[Column], Column]:
    if not query:
        raise ValueError("a query is empty")
    if kind not in SEARCHERS:
        raise ValueError(f"unknown query type {kind!r}")
    return SEARCHERS[kind](query)


def conjunction(queries: Iterable[tuple[str, str]], line: Column) -> Column:
    """All (query, type) must hold; cheap kinds stand first, for short-circuiting."""
    made = [(COST.get(kind, 3), compile_query(kind, query)(line)) for query, kind in queries]
    if not made:
        raise ValueError("no queries")
    return reduce(lambda a, b: a & b, [c for _, c in sorted(made, key=lambda x: x[0])])


def _hit(text: str, line: Column) -> Column:
    return F.struct(F.lit(text).alias("word"), (F.instr(line, text) - 1).alias("pos"))


NONE = "array<struct<word: string, pos: int>>"


def node_matches(node: Node | None, line: Column) -> Column:
    """Words that made a boolean query match: AND lists all its sides', OR its first side's, NOT none."""
    empty = F.array().cast(NONE)
    match node:
        case Word(text):
            return F.when(line.contains(F.lit(text)), F.array(_hit(text, line)).cast(NONE)).otherwise(empty)
        case All(children):
            return F.when(node_column(node, line), F.concat(*[node_matches(c, line) for c in children])).otherwise(empty)
        case Any(children):
            return F.coalesce(*[F.when(node_column(c, line), node_matches(c, line)) for c in children], empty)
    return empty


HITS = ArrayType(StructType([StructField("word", StringType()), StructField("pos", IntegerType())]))


@F.pandas_udf(HITS)
def _group_hits(line: pd.Series, pattern: pd.Series) -> pd.Series:
    compiled = compiled_groups(pattern.iloc[0]) if len(pattern) else None

    def one(text: str | None) -> list[dict] | None:
        m = None if text is None else compiled.search(text)
        return None if m is None else [{"word": m[g] or "", "pos": m.start(g)} for g in range(compiled.groups + 1)]

    return line.map(one)


@cache
def compiled_groups(pattern: str) -> regex_module.Pattern:
    return regex_module.compile(pattern, regex_module.DOTALL | regex_module.MULTILINE)


def match_positions(kind: str, query: str, line: Column) -> Column:
    """array<struct<word, pos>> of what matched, positions in characters from 0; for a regular expression
    the whole match and then each group where it matched, one that took no part as empty at -1. SQL has no
    function for the place of a group, so where there are groups, the lines that match go to Python."""
    if kind == "simple":
        return node_matches(Word(query), line)
    if kind == "boolean":
        return node_matches(parse_boolean(query), line)
    pattern = java_regex(query)
    hit = line.rlike(pattern)
    whole = F.array(F.struct(F.regexp_extract(line, pattern, 0).alias("word"), (F.regexp_instr(line, F.lit(pattern)) - 1).alias("pos"))).cast(NONE)
    if compiled_groups(query).groups:
        whole = F.coalesce(_group_hits(F.when(hit, line), F.lit(query)), whole)
    return F.when(hit, whole).otherwise(F.array().cast(NONE))
