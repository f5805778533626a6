"""Quality rules and robust multivariate outliers (operator 7).

Each document gives a vector of transformed statistics. Every language and source, every language, and the
whole table have a minimum covariance determinant estimate of centre and scatter. It starts from the best
of many random starts over a hashed sample of the group (fast_mcd; a group within ``sample`` rows is its
own sample), then concentrates over all the group's documents: distances to the present estimate, then the
estimate from exactly the closest three quarters. At last it is made consistent by the median distance and
taken once more from all documents within the 0.975 ellipse, whose cut the scatter is corrected for.

A step is one aggregation: moments by (group, class of distance), which partial sums shrink to a few
hundred rows a group; of the class at the edge of the three quarters the missing fraction counts, so ties,
even of a whole group, neither add nor drop weight. No group meets in a task, and every document counts.

Small groups say little about themselves, so an estimate of n documents is mixed with the next wider one,
and counts n^2 / (n^2 + ``doubt``^2) of it: every document is judged, by its language and source as far as they are known.
A document is rejected when its squared Mahalanobis distance is beyond ``cutoff``, by default what one in
100,000 normal vectors exceeds.

Edges: null and empty texts have no words and fail the base rules; a null language or source is a
language or source of its own; a scatter without spread is kept invertible by FLOOR; repeated rows count
again; columns of the caller with a name of the result give way to it; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, done_with, nullable_key, written

SYMBOLS = b"#*$%&|<>"
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
STATS = ("log_words", "word_length", "variety", "symbols", "duplicates", "repeats", "capitals", "marks")
#: The least spread of each statistic that the scatter admits: smaller ones are noise of short texts.
FLOOR = (0.6, 0.3, 0.15, 0.08, 0.2, 0.15, 0.08, 0.08)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    key = ids[:-2] * len(seen) + ids[1:-1]
    if len(seen) >= 1 << 21:
        key = np.unique(key, return_inverse=True)[1]
    key = key * len(seen) + ids[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[:-1][same]] = True
    again[order[1:][same]] = True
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= again
    return int(covered.sum())


def describe(text: bytes | None) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the vector STATS."""
    raw = text or b""
    words = raw.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    again = repeated_words(words)
    if not n:
        return n, chars, symbols, dup, again, [0.0] * len(STATS)
    letters = len(joined) - len(joined.translate(None, LETTERS))
    capitals = letters - (len(joined) - len(joined.translate(None, LETTERS[26:])))
    ascii_rest = len(joined.translate(None, LETTERS + bytes(range(128, 256))))
    vector = [np.log(n), chars / n, np.log(len(set(words)) / n) / (1 + np.log(n)), np.sqrt(symbols / n), np.sqrt(dup / len(lines)), np.sqrt(again / n), np.sqrt(capitals / max(1, len(joined))), np.sqrt(ascii_rest / max(1, len(joined)))]
    return n, chars, symbols, dup, again, [float(x) for x in vector]


def with_statistics(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the documents, the base counts and one column s0.. for each statistic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [describe(x.as_py()) for x in b.column("__text")]
            base = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            vec = np.array([r[5] for r in rows]).reshape(len(rows), len(STATS))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + base + [pa.array(vec[:, i]) for i in range(len(STATS))], names=names)

    kept = docs.select(*columns, F.col("text").cast("binary").alias("__text"))
    names = [*columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"s{i}" for i in range(len(STATS)))]
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns] + [f"{c} bigint" for c in names[len(columns) : len(columns) + 5]] + [f"s{i} double" for i in range(len(STATS))]
    return kept.mapInArrow(run, ", ".join(kinds))


def chi2_quantile(p: float, d: int) -> float:
    """Wilson and Hilferty's approximation."""
    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * (2 / (9 * d)) ** 0.5) ** 3


def distance(columns: list[str]) -> Column:
    """Squared Mahalanobis distance to the row's ``center``, by its row-wise ``precision``."""
    d = len(columns)
    diff = [F.col(c) - F.get("center", F.lit(i)) for i, c in enumerate(columns)]
    terms = [F.get("precision", F.lit(i * d + j)) * diff[i] * diff[j] * (1 if i == j else 2) for i in range(d) for j in range(i, d)]
    return F.greatest(reduce(lambda a, b: a + b, terms), F.lit(0.0))


def widened(cov: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """The scatter with each variance at least the floor's."""
    return cov + np.diag(np.maximum(floor**2 - np.diag(cov), 0) + 1e-9)


def fast_mcd(x: np.ndarray, floor: np.ndarray, inside: float, starts: int = 50, best: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of the ``inside`` share of rows whose covariance has the least determinant: from
    random subsets of d + 1 rows two concentration steps each, then the best few to convergence (Rousseeuw
    and Van Driessen, 1999). Fewer than 2 (d + 1) rows: medians and the spreads about them."""
    n, d = x.shape
    if n < 2 * (d + 1):
        center = np.median(x, axis=0)
        return center, widened(np.diag((1.4826 * np.median(np.abs(x - center), axis=0)) ** 2), floor)
    h = max(math.ceil(inside * n), d + 1)
    rng = np.random.default_rng(7)

    def moments(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rows.mean(axis=0), widened(np.cov(rows.T, bias=True).reshape(d, d), floor)

    def step(center: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        diff = x - center
        away = np.einsum("ij,ij->i", diff @ np.linalg.inv(cov), diff)
        return moments(x[np.argpartition(away, h - 1)[:h]])

    tried = [moments(x)] + [moments(x[rng.choice(n, d + 1, replace=False)]) for _ in range(starts)]
    tried = [step(*step(*e)) for e in tried]
    found = []
    for e in sorted(tried, key=lambda e: np.linalg.slogdet(e[1])[1])[:best]:
        last = np.inf
        for _ in range(100):
            e = step(*e)
            now = np.linalg.slogdet(e[1])[1]
            if now >= last - 1e-12:
                break
            last = now
        found.append((now, e))
    return min(found, key=lambda f: f[0])[1]


STEP = 16  # classes of distance to an octave


def robust_estimates(vectors: DataFrame, group: str, columns: list[str], floor: tuple[float, ...], inside: float = 0.75, sample: int = 1000, steps: int = 2) -> DataFrame:
    """(group, n, center, scatter) of each group of ``vectors(group, n, row, columns)``, a written table;
    n is the group's size and row a number of the row's own. The scatter is consistent for normal data."""
    d = len(columns)
    least = np.array(floor)
    schema = f"`{group}` {vectors.schema[group].dataType.simpleString()}, n bigint, center array<double>, scatter array<double>, precision array<double>"

    def row(g: pd.DataFrame, center: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({group: [g[group].iloc[0]], "n": [g["n"].iloc[0]], "center": [center], "scatter": [cov.ravel()], "precision": [np.linalg.inv(cov).ravel()]})

    def start(g: pd.DataFrame) -> pd.DataFrame:
        return row(g, *fast_mcd(g[columns].to_numpy("float64"), least, inside))

    # about ``sample`` rows of a group start its estimate, by a hash of their numbers
    part = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < F.lit(float(sample << 30)) / F.col("n")
    now = written(vectors.where(part).select(group, "n", *columns).groupBy(group).applyInPandas(start, schema), "start")

    def update(final: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("class")
            counts = g["rows"].to_numpy("float64")
            upto = np.cumsum(counts)
            edge = 2.0 ** ((g["class"].to_numpy() + 1) / STEP)
            half = edge[np.searchsorted(upto, 0.5 * upto[-1])]
            if final:  # all rows near by the scale that the median gives
                scale = half / chi2_quantile(0.5, d)
                weight = (edge <= chi2_quantile(0.975, d) * scale).astype("float64")
                weight[0] = 1.0
            else:  # exactly the share inside; of the class at its edge the fraction that is missing
                weight = np.clip((inside * upto[-1] - (upto - counts)) / counts, 0, 1)
            sums = weight @ g[[f"a{i}" for i in range(d)] + [f"b{i}_{j}" for i in range(d) for j in range(i, d)]].to_numpy("float64")
            n = weight @ counts
            mean, cov = sums[:d] / n, np.zeros((d, d))
            cov[np.triu_indices(d)] = sums[d:] / n
            cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)
            return row(g, mean, widened(cov * reweighted(d) if final else cov, least))

        return run

    for i in range(steps + 1):
        here = vectors.join(now.select(group, "center", "precision"), group)
        level = F.floor(STEP * F.log2(distance(columns) + F.lit(1e-6))).cast("int").alias("class")
        sums = [F.sum(columns[i]).alias(f"a{i}") for i in range(d)] + [F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"b{i}_{j}") for i in range(d) for j in range(i, d)]
        classes = here.groupBy(group, level).agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"), *sums)
        old, now = now, written(classes.groupBy(group).applyInPandas(update(i == steps), schema), "estimate")
        done_with(old)
    return now.select(group, "n", "center", "scatter")


def reweighted(d: int) -> float:
    """The factor that makes the covariance within the 0.975 ellipse that of all, for normal data."""
    q = chi2_quantile(0.975, d)
    return 0.975 / chi2_below(q, d + 2)


def chi2_below(q: float, d: int) -> float:
    """P(chi-squared of d degrees <= q), by the series of the incomplete gamma function."""
    a, x = d / 2, q / 2
    term = total = 1 / a
    for k in range(1, 500):
        term *= x / (a + k)
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def shrunk(parts: DataFrame, floor: tuple[float, ...], doubt: float) -> DataFrame:
    """(own, center, precision) from rows (own, and n, center, scatter of its own estimate, its language's
    and the whole table's): each is mixed with the next wider one, half and half at ``doubt`` rows. The scatter
    is the mixture's, so it also holds how far the centres lie apart."""
    d = len(floor)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[tuple] = []
            for r in f.itertuples(index=False):
                center, cov = np.asarray(r.center2), np.asarray(r.scatter2).reshape(d, d)
                for n, c, s in ((r.n1, r.center1, r.scatter1), (r.n0, r.center0, r.scatter0)):
                    w, c = n**2 / (n**2 + doubt**2), np.asarray(c)
                    gap = c - center
                    cov = w * np.asarray(s).reshape(d, d) + (1 - w) * cov + w * (1 - w) * np.outer(gap, gap)
                    center = w * c + (1 - w) * center
                out.append((r.own, center, np.linalg.inv(cov).ravel()))
            yield pd.DataFrame(out, columns=["own", "center", "precision"])

    return parts.mapInPandas(run, "own string, center array<double>, precision array<double>")


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def quality_verdicts(docs: DataFrame, columns: list[str], doubt: float = 50.0, cutoff: float | None = None) -> DataFrame:
    """``columns``, the base counts, base_failed, distance (null where the base rules fail) and kept."""
    cutoff = chi2_quantile(1 - 1e-5, len(STATS)) if cutoff is None else cutoff
    columns = [c for c in columns if c not in RESULT]
    renamed = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)], F.col("text"), nullable_key(F.col("lang")).alias("__lang"), nullable_key(F.col("source")).alias("__source"))
    own = [f"__c{i}" for i in range(len(columns))]
    stats = with_statistics(renamed, [*own, "__lang", "__source"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    keys = {"__0": F.concat_ws("\x1f", "__lang", "__source"), "__1": F.concat(F.lit("\x1f\x1f"), F.col("__lang")), "__2": F.lit("\x1f\x1f\x1f")}
    table = written(stats.withColumn("base_failed", failed).withColumns(keys).withColumn("__row", F.monotonically_increasing_id()), "statistics")
    s = [f"s{i}" for i in range(len(STATS))]
    judged = table.where(~F.col("base_failed")).select(*s, F.col("__row").alias("row"), F.explode(F.array("__0", "__1", "__2")).alias("group"))
    sizes = written(judged.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "sizes")  # a row for each source at most three times
    vectors = written(judged.join(sizes, "group"), "vectors")
    found = written(robust_estimates(vectors, "group", s, FLOOR), "found")
    part = lambda i: found.select(F.col("group").alias(f"__{i}"), F.col("n").alias(f"n{i}"), F.col("center").alias(f"center{i}"), F.col("scatter").alias(f"scatter{i}"))
    chain = table.where(~F.col("base_failed")).select("__0", "__1", "__2").distinct().join(part(0), "__0").join(part(1), "__1").join(part(2), "__2")
    known = written(shrunk(chain.withColumnRenamed("__0", "own"), FLOOR, doubt).withColumnRenamed("own", "__0"), "known")
    out = table.join(known, "__0", "left").withColumn("distance", F.when(~F.col("base_failed"), distance(s)))
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(False)))
    return out.select(*[F.col(o).alias(c) for o, c in zip(own, columns, strict=True)], *RESULT)


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_verdicts(documents(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
