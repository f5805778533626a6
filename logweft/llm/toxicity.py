"""Toxicity by the nearest labelled examples (operator 2).

Texts are unit TF-IDF vectors over all their terms that any example has; terms are the runs of letters,
digits and characters beyond ASCII, with A-Z lowered. A term's weight is (1 + ln count) * idf * mark: idf
is ln((1 + examples) / (1 + examples with the term)), and mark, between 0 and 1, grows with the
log-likelihood ratio of term and label among the examples. No term is left out, but one that both labels
share alike counts little, else common words decide who is near.

Examples of both labels lie in an inverted index cut into blocks of examples; each term knows its largest
weight in each block, so a query's sum of such maxima bounds every cosine in a block. Blocks are visited
from the highest bound down until no bound reaches the k-th best cosine found: the k nearest are exact.
They vote with their cosines, and ``prior`` further votes have the share of toxic examples. The votes
become a probability by a logistic curve, fitted to the examples' own votes, where none votes on itself.

At most about ``examples`` labelled rows are fitted (those whose id hashes lowest), and of these no more
than hold ``postings`` terms together (bounds are parameters), so the index has a bounded size. Its files
lie in the shared folder and are memory-mapped. Every document is scored, by its text alone; an example
that is scored again meets itself.

Edges: a null or empty text, or one that shares no term with an example, has no neighbours and the score
of votes at the share of toxic examples; a null id counts as the empty string for the hold-out; rows with
a null label are no examples; a document labelled twice takes the larger label, and one that is there
twice is two examples; repeated rows are scored alike; ties in cosine go to the lower example number;
where all examples have one label every score is near it; with no examples every score is 0; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, done_with, held_out, scratch, written
from .shared_files import load, qualified, save
from .words import IN_TERM, U64, grouped, text_words

MARK = 20.0  # the log-likelihood ratio at which a term counts half


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size`` numbers from each first on, one range after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, hash, count) of the distinct terms of an array of texts, in that order."""
    hashes, n = text_words(texts, IN_TERM)
    of = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(of) != 0) | (hashes[1:] != hashes[:-1])))) if len(of) else np.zeros(0, np.int64)
    return of[first], hashes[first], np.diff(np.append(first, len(of)))


def log_likelihood(n: np.ndarray, bad: np.ndarray, p: float) -> np.ndarray:
    """How much better the texts with a term (n, of which bad) are told by their own share than by p."""
    q = bad / n
    part = lambda x, y: np.where(x > 0, x * np.log(np.where(x > 0, x, 1.0) / y), 0.0)
    return n * (part(q, p) + part(1 - q, 1 - p))


def term_weights(n: np.ndarray, bad: np.ndarray, examples: int, toxic: int) -> np.ndarray:
    """idf * mark of terms that ``n`` examples have, ``bad`` of them toxic; with one label mark is 1."""
    idf = np.log((1 + examples) / (1 + n))
    if not 0 < toxic < examples:
        return idf
    g = log_likelihood(n, bad, toxic / examples)
    return idf * (g + 0.5) / (g + MARK)


class Index:
    """A block-max inverted index of the examples' unit vectors.

    A term that more than one example in ``RARE`` has would have a cell nearly everywhere: its postings are
    a dense row, and a batch of queries meets all such rows in one matrix product. Every other term has
    a cell for each block that holds it, with its largest weight there, and cells have postings. The dense
    part and the cells' maxima bound a block for a query; the blocks with the highest bounds are opened
    first, and of the others those whose bound reaches the k-th best cosine found there. Cosines are in
    single precision; SLACK is more than that loses."""

    RARE = 24
    SLACK = 2e-5
    FEW = 8

    def __init__(self, arrays: dict[str, np.ndarray], block: int) -> None:
        self.block = block
        arrays = {name: np.asarray(a) for name, a in arrays.items()}  # plain views of the maps
        self.terms, self.weight, self.labels, self.names = arrays["terms"], arrays["weight"], arrays["labels"], arrays["names"]
        self.n_blocks = -(-len(self.labels) // block)
        self.dense_row = arrays["dense_row"]
        self.dense = arrays["dense"].reshape(-1, self.n_blocks * block)
        self.cells, self.cell_block, self.cell_max = arrays["cells"], arrays["cell_block"], arrays["cell_max"]
        self.posts, self.example, self.value = arrays["posts"], arrays["example"], arrays["value"]
        self.row_starts, self.row_terms, self.row_values = arrays["row_starts"], arrays["row_terms"], arrays["row_values"]

    @classmethod
    def arrays(cls, of: np.ndarray, hashes: np.ndarray, counts: np.ndarray, labels: np.ndarray, names: np.ndarray, block: int) -> dict[str, np.ndarray]:
        """The index's arrays from the examples' terms (as term_counts() gives them). Examples are put in
        an order in which a block's are alike: by label and the signs of leading components."""
        terms, t = np.unique(hashes, return_inverse=True)
        t = t.astype(np.int32)
        n, examples = np.bincount(t, minlength=len(terms)), len(labels)
        weight = term_weights(n, np.bincount(t, labels[of], len(terms)), examples, int(labels.sum()))
        v = (1 + np.log(counts)) * weight[t]
        norm = np.sqrt(np.bincount(of, v * v, examples))
        v /= np.maximum(norm, 1e-300)[of]
        often = n * cls.RARE > examples
        dense_row = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        wide = -(-examples // block) * block
        dense = np.zeros((int(often.sum()), wide), np.float32)
        mine = often[t]
        dense[dense_row[t[mine]], of[mine]] = v[mine]
        keys = [names, labels]
        if len(dense):
            parts = (np.linalg.eigh(dense @ dense.T)[1][:, ::-1][:, :6].T @ dense)[:, :examples]
            keys = [names, *parts[-1:], *(parts[::-1] > np.median(parts[::-1], axis=1, keepdims=True)), labels]
        order = np.lexsort(keys)
        rank = np.empty(examples, np.int64)
        rank[order] = np.arange(examples)
        dense[:, :examples] = dense[:, :examples][:, order]
        of = rank[of].astype(np.int32)
        by_row = np.lexsort((t, of))
        rows = {"row_starts": np.searchsorted(of[by_row], np.arange(examples + 1)), "row_terms": t[by_row], "row_values": v[by_row]}
        t, of, v = t[~mine], of[~mine], v[~mine].astype(np.float32)
        by_term = np.lexsort((of, t))
        t, of, v = t[by_term], of[by_term], v[by_term]
        b = of // block
        cell = np.flatnonzero(np.concatenate(([True], (np.diff(t) != 0) | (np.diff(b) != 0)))) if len(t) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(v, cell) if len(cell) else np.zeros(0, np.float32)
        return rows | {
            "terms": terms.astype(U64), "weight": weight, "labels": labels[order].astype(np.int8), "names": names[order],
            "dense_row": dense_row, "dense": dense.ravel(),
            "cells": np.searchsorted(t[cell], np.arange(len(terms) + 1)), "cell_block": b[cell], "cell_max": most,
            "posts": np.append(cell, len(t)), "example": of.astype(np.int32), "value": v,
        }

    def vectors(self, of: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term number, weight) of n texts' unit vectors over the index's terms."""
        at = np.minimum(np.searchsorted(self.terms, hashes), max(len(self.terms) - 1, 0))
        known = self.terms[at] == hashes if len(self.terms) else np.zeros(len(hashes), bool)
        of, at = of[known], at[known]
        w = (1 + np.log(counts[known])) * self.weight[at]
        return of, at, w / np.maximum(np.sqrt(np.bincount(of, w * w, n)), 1e-300)[of]

    def own(self, examples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of examples' own vectors."""
        size = self.row_starts[examples + 1] - self.row_starts[examples]
        at = ranges(self.row_starts[examples], size)
        return np.repeat(np.arange(len(examples)), size), self.row_terms[at], self.row_values[at]

    def nearest(self, of: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, k: int, but: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of n queries the numbers and cosines of the k nearest examples with a positive cosine,
        best first, ties by number, without the example ``but`` names for it."""
        row = self.dense_row[terms]
        often = row >= 0
        q = np.zeros((n, len(self.dense)), np.float32)
        q[of[often], row[often]] = weights[often]
        score = (q @ self.dense).reshape(n, self.n_blocks, self.block)
        if but is not None:
            score.reshape(n, -1)[np.arange(n), but] = -9.0
        rare = np.flatnonzero(~often)
        cuts = np.searchsorted(of[rare], np.arange(0, n + self.FEW, self.FEW))
        for i in range(0, n, self.FEW):  # arrays of a few queries stay in the processor's cache
            mine = rare[cuts[i // self.FEW] : cuts[i // self.FEW + 1]]
            some = slice(i, min(n, i + self.FEW))
            yield from self.best(score[some], of[mine] - i, terms[mine], weights[mine].astype(np.float32), k)

    def best(self, score: np.ndarray, of: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The k nearest of queries with ``score`` (query, block, place) from the dense part and further terms."""
        n, blocks, tops = len(score), self.n_blocks, score.max(2)
        size = self.cells[terms + 1] - self.cells[terms]
        cell = ranges(self.cells[terms], size)
        query, weight = np.repeat(of, size), np.repeat(weights, size)
        at = query * blocks + self.cell_block[cell]
        bound = tops + np.bincount(at, weight * self.cell_max[cell], n * blocks).reshape(n, blocks)
        # the blocks with the highest bounds first; then those whose bound reaches what was found there
        few = min(blocks, 4 + k // self.block)
        first = np.argpartition(bound, blocks - few, axis=1)[:, blocks - few :]
        opened = np.zeros((n, blocks), bool)
        np.put_along_axis(opened, first, True, axis=1)
        self.open(score, opened, at, cell, query, weight)
        least = kth(np.take_along_axis(score, first[:, :, None], axis=1).reshape(n, -1), k)
        later = (bound >= least[:, None] - self.SLACK) & (bound > 0) & ~opened
        self.open(score, later, at, cell, query, weight)
        score[~(later | opened)] = -9.0
        who, place = np.nonzero(score.reshape(n, -1) >= np.maximum(least - self.SLACK, 1e-6)[:, None])
        cos = score.reshape(n, -1)[who, place].astype(np.float64)
        order = np.lexsort((place, -cos, who))
        cuts = np.searchsorted(who[order], np.arange(n + 1)).tolist()
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield place[order[i : min(j, i + k)]], cos[order[i : min(j, i + k)]]

    def open(self, score: np.ndarray, blocks: np.ndarray, at: np.ndarray, cell: np.ndarray, query: np.ndarray, weight: np.ndarray) -> None:
        """Adds the postings of the cells that lie in some (query, block) pairs to their scores."""
        mine = np.flatnonzero(blocks.ravel()[at])
        cell = cell[mine]
        size = self.posts[cell + 1] - self.posts[cell]
        post = ranges(self.posts[cell], size)
        to = np.repeat(query[mine] * self.dense.shape[1], size) + self.example[post]
        np.add.at(score.reshape(-1), to, np.repeat(weight[mine], size) * self.value[post])


def kth(a: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; 0 where there are fewer or it is lower."""
    n = a.shape[1]
    return np.maximum(np.partition(a, n - k, axis=1)[:, n - k], 0) if n >= k else np.zeros(len(a))


def logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b), b not negative, of the probability 1 / (1 + exp(-a - b x)) of y by Newton's steps, with
    targets drawn in from 0 and 1 as if each label had been seen once more (Platt, 1999)."""
    good, n = float(y.sum()), len(y)
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (n - good + 2))
    flat = float(logit(np.array(target.mean())))
    theta = np.array([flat, 0.0])
    rows = np.stack((np.ones(n), x))
    for _ in range(50):
        p = 1 / (1 + np.exp(-theta @ rows))
        step = np.linalg.solve((rows * (p * (1 - p))) @ rows.T + np.eye(2) * 1e-6, rows @ (target - p))
        theta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(theta[0]), float(theta[1])) if theta[1] > 0 else (flat, 0.0)


class Judge:
    """The index in its file, the examples' ids, and the curve from votes to scores."""

    BATCH = 128  # queries that are held against the index at once

    def __init__(self, path: str, block: int, k: int, prior: float, share: float, curve: tuple[float, float] = (0.0, 1.0)) -> None:
        self.path, self.block, self.k, self.prior, self.share, self.curve = path, block, k, prior, share, curve
        self.index: Index | None = None

    def __reduce__(self) -> tuple:
        return Judge, (self.path, self.block, self.k, self.prior, self.share, self.curve)

    def near(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Examples and cosines that vote on each of an array of texts."""
        for at in range(0, len(texts), self.BATCH):
            part = texts.slice(at, self.BATCH)
            yield from self.open().nearest(*self.index.vectors(*term_counts(part), len(part)), len(part), self.k)

    def own_votes(self, examples: np.ndarray) -> Iterator[float]:
        """The examples' votes on examples, none on itself."""
        for at in range(0, len(examples), self.BATCH):
            part = examples[at : at + self.BATCH]
            for ids, cos in self.open().nearest(*self.index.own(part), len(part), self.k, part):
                yield self.votes(ids, cos)

    def open(self) -> Index:
        if self.index is None:
            self.index = Index(load(self.path), self.block)
        return self.index

    def votes(self, ids: np.ndarray, cos: np.ndarray) -> float:
        """The log odds of the cosine-weighted votes."""
        toxic = self.prior * self.share + cos[self.index.labels[ids] > 0].sum()
        return float(logit(np.clip(toxic / (self.prior + cos.sum()), 1e-9, 1 - 1e-9)))

    def score(self, votes: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-a - b * votes))


def example_terms(docs: DataFrame, labels: DataFrame, examples: int, postings: int, mod: int) -> DataFrame:
    """(key, doc_id, toxic, hashes, counts, n) of the examples to learn from, a written table: hashes and
    counts are the packed arrays of n terms."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), mod))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, examples / max(1, known.count()))
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    known = known.withColumn("key", key).where(F.col("key") < int(share * (1 << 30)))
    found = docs.join(F.broadcast(known), "doc_id")  # about ``examples`` rows of 20 bytes

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in grouped(batches, "text", 400_000):
            of, hashes, counts = term_counts(b.column("text"))
            cuts = np.searchsorted(of, np.arange(len(b) + 1))
            parts = list(zip(cuts, cuts[1:], strict=False))
            packed = [pa.array([a[i:j].tobytes() for i, j in parts], pa.binary()) for a in (hashes, counts.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "doc_id", "toxic")), *packed, pa.array(np.diff(cuts), pa.int64())], names=["key", "doc_id", "toxic", "hashes", "counts", "n"])

    found = found.select("key", F.col("doc_id").cast("bigint").alias("doc_id"), "toxic", F.col("text").cast("binary").alias("text"))
    table = written(found.mapInArrow(pack, "key bigint, doc_id bigint, toxic int, hashes binary, counts binary, n bigint"), "examples")
    sizes = sorted(map(tuple, table.select("key", "n").collect()))  # bounded by ``examples``
    fit = int(np.searchsorted(np.cumsum([n for _, n in sizes]), postings, side="right"))
    if fit == len(sizes):
        return table
    part = table.where(F.col("key") < sizes[fit][0])
    part.scratch_path = table.scratch_path
    return part


def fit(docs: DataFrame, labels: DataFrame, k: int = 32, prior: float = 0.5, block: int = 512, examples: int = 20_000, postings: int = 6_000_000, mod: int = 5) -> Judge | None:
    """The judge of ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; None without examples."""
    spark = docs.sparkSession
    table = example_terms(docs, labels, examples, postings, mod)
    n, toxic = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n:
        return None
    path = qualified(spark, scratch(spark, "toxic-index"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))  # bounded by ``examples`` and ``postings``
        hashes, counts = (np.frombuffer(b"".join(whole.column(c).to_pylist()), kind) for c, kind in (("hashes", U64), ("counts", np.int32)))
        names, labels = whole.column("doc_id").to_numpy(), whole.column("toxic").to_numpy().astype(np.int8)
        of = np.repeat(np.arange(len(names), dtype=np.int32), whole.column("n").to_numpy())
        del whole
        save(path, Index.arrays(of, hashes, counts, labels, names, block))
        yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], names=["n"])

    table.repartition(1).sortWithinPartitions("doc_id", "toxic", "hashes", "counts").mapInArrow(build, "n bigint").collect()
    done_with(table)
    judge = Judge(path, block, k, prior, toxic / n)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(judge.open().labels[ids]), pa.array(judge.own_votes(ids), pa.float64())], names=["toxic", "votes"])

    tasks = max(1, min(n // 200, 4 * spark.sparkContext.defaultParallelism))
    found = sorted(map(tuple, spark.range(0, n, 1, tasks).mapInArrow(vote, "toxic byte, votes double").collect()))
    curve = platt(np.array([v for _, v in found]), np.array([y for y, _ in found]))
    return Judge(path, block, k, prior, judge.share, curve)


NEIGHBOUR = pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())])


def toxicity(docs: DataFrame, labels: DataFrame, columns: list[str], evidence: int = 5, **fitting: float) -> DataFrame:
    """``columns`` of the documents, score, and neighbours: the ``evidence`` nearest of the examples that
    voted, with their labels and cosines. ``columns`` must not hold these names."""
    judge = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), **fitting)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in grouped(batches, "__text", 400_000):
            scores, voters = [0.0] * len(b), [[] for _ in range(len(b))]
            if judge is not None:
                for i, (ids, cos) in enumerate(judge.near(b.column("__text"))):
                    scores[i] = judge.score(judge.votes(ids, cos))
                    top = ids[:evidence]
                    told = zip(judge.index.names[top].tolist(), judge.index.labels[top].tolist(), cos[:evidence].tolist(), strict=True)
                    voters[i] = [{"doc_id": d, "toxic": t, "cosine": c} for d, t, c in told]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(scores, pa.float64()), pa.array(voters, pa.list_(NEIGHBOUR))], names=[*columns, "score", "neighbours"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns]
    return docs.select(*columns, F.col("text").cast("binary").alias("__text")).mapInArrow(run, ", ".join([*kinds, "score double, neighbours array<struct<doc_id: bigint, toxic: int, cosine: double>>"]))


def op2_nearest_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours")
