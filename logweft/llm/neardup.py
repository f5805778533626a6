"""SimHash near-dedup with BK-trees (operator 5).

A fingerprint bit is 1 where over half of the text's shingle hashes have it. Fingerprints at most
``radius`` bits apart are linked; a document's component is everything that links reach.

Equal fingerprints are one node, with a number of its own. Nodes meet in shards: by default one shard for
each pair of the radius + 2 blocks of the fingerprint and each value of their bits, and two fingerprints
within the radius agree on two blocks at least, so no link is lost. A shard of more than ``tree`` nodes is
cut finer: by each of radius + 1 interleaved pieces of the fingerprint, of which two within the radius
share one at least. Each shard has BK-trees of about ``tree`` nodes, whose children are keyed by their
integer Hamming distance to the parent; a search follows only edges within the radius of the distance to
the node. First the nodes of a tree are held against each other. Where a shard has several trees, a second
turn sends its nodes to its other trees, but for those of the shard's largest component so far: these are
connected already, and only what is outside has to find links to them or to its like. So a large group of
near copies costs its size times the tree's, not its square, and no link between components is lost.
Searches emit a spanning forest of what they find, not all pairs; components() joins the forests.

near_copies is for looser likeness, by the shingle sets' Jaccard similarity. Texts with equal sets are one
node, fingerprints have 512 bits, shards are bands of min-hashes, and every candidate is compared exactly,
shingle set with shingle set, before it links anything. A first turn checks each node's nearest candidate,
which joins most of what belongs together. A second finds the rows with candidates in components that are
still apart; their sets move to their shards, where all such pairs are compared, as long as they are apart,
and only links come out. So no link among candidates is lost, and no list of pairs is written. At that
radius the edges of a BK-tree prune little; what bounds the work is the shard.

Edges: a null text is empty, an empty text has fingerprint zero and is linked like any other (near_copies:
all texts without words are copies of each other and of nothing else); rows equal in id or text fall into
one component; a null id links like any other, but is never a component's id unless the component has no
other; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, documents, done_with, split_by_bitmap, written
from .words import U64, grouped, mixed, text_words

WIDE = 512
NEAR = 1
ROW = ["shard", "key", "tree", "node", "fp", "size", "root", "keys", "stored", "compared"]
#: Shingles of a tree's sets, on average, at most: sets go into memory in the second turn.
WEIGHT = 1 << 22
BITS = 1 << 23
#: What tells the places in a shingle, the lanes of a fingerprint and the min-hashes apart.
ODD = mixed(np.arange(1, 129, dtype=U64)) | U64(1)


def shingle_bytes(raw: bytes, width: int) -> list[bytes]:
    """Lower-cased word shingles, repeats included; fewer words: the whole sequence; none: none."""
    words = raw.lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    return [text[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: np.ndarray, width: int) -> bytes:
    """``hashes``: uint8 rows of width / 8 little-endian bytes. Big-endian bytes of the voted bits."""
    n = len(hashes)
    if not n:
        return bytes(width // 8)
    votes = np.zeros(width, np.int64)
    for i in range(0, n, 32768):
        votes += np.unpackbits(hashes[i : i + 32768], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > n, bitorder="little").tobytes()[::-1]


def fingerprint64(shingles: list[bytes]) -> bytes:
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles))
    return majority(h.view(np.uint8).reshape(-1, 8), 64)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of the distinct word shingles of an array of texts, in that order."""
    words, n = text_words(texts)
    many = np.where(n > width, n - width + 1, np.minimum(n, 1))
    of = np.repeat(np.arange(len(n)), many)
    start = np.cumsum(n) - n
    at = np.arange(len(of)) + (start - (np.cumsum(many) - many))[of]
    h = np.zeros(len(of), U64)
    for j in range(width):
        inside = j < n[of]  # a shorter text is one shingle
        h[inside] += words[at[inside] + j] * ODD[j]
    h = mixed(h)
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.concatenate(([True], (np.diff(of) != 0) | (h[1:] != h[:-1]))) if len(of) else np.zeros(0, bool)
    return of[new], h[new]


def set_digests(of: np.ndarray, h: np.ndarray, n: int) -> list[bytes]:
    """128 bits for each of n sets, by sums of two different mixtures of their elements."""
    out = np.zeros((n, 2), U64)
    first = np.flatnonzero(np.concatenate(([True], np.diff(of) != 0))) if len(of) else np.zeros(0, np.int64)
    for i in range(2 * bool(len(first))):
        out[of[first], i] = np.add.reduceat(mixed(h ^ ODD[32 + i]), first)
    return [d.tobytes() for d in out]


def wide_fingerprints(texts: pa.Array, width: int, bands: int = 10, chunk: int = 16384) -> list[tuple[bytes, bytes, list[int], int]]:
    """For each text a digest of its shingle set, WIDE bits that the set votes on, ``bands`` keys of two
    min-hashes each, and the size of the set."""
    of, h = shingle_sets(texts, width)
    n = np.bincount(of, minlength=len(texts))
    votes = np.zeros((len(texts), WIDE), np.int32)
    for at in range(0, len(h), chunk):
        part, mine = h[at : at + chunk], of[at : at + chunk]
        lanes = np.stack([mixed(part ^ ODD[16 + i]) for i in range(WIDE // 64)], axis=1)
        bits = np.unpackbits(lanes.view(np.uint8), axis=1)
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(mine) != 0)))
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(mine)], strict=True):
            votes[mine[i]] += bits[i:j].sum(axis=0, dtype=np.int32)
    fps = np.packbits(2 * votes > n[:, None], axis=1)
    has = np.flatnonzero(n)
    first = (np.cumsum(n) - n)[has]
    over = lambda f, x: f.reduceat(x, first) if len(first) else np.zeros(0, U64)
    least = np.zeros((len(texts), 2 * bands), U64)
    for i in range(2 * bands):
        least[has, i] = over(np.minimum, h * ODD[64 + i])
    keys = (mixed(least[:, ::2] * ODD[48] + least[:, 1::2] * ODD[49] + ODD[100 : 100 + bands]) >> U64(1)).astype(np.int64)
    return [(d, f.tobytes(), k.tolist() if m else [], m) for d, f, k, m in zip(set_digests(of, h, len(texts)), fps, keys, n.tolist(), strict=True)]


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp) of ``docs(doc_id, text)``, 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [fingerprint64(shingle_bytes(x.as_py() or b"", width)) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.binary())], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, fp binary")


class BKTree:
    """Children are keyed by their Hamming distance to the parent."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: tuple[int, int, dict] | None = None

    def add(self, value: int, name: int) -> None:
        node = (value, name, {})
        at = self.root
        if at is None:
            self.root = node
            return
        while True:
            d = (at[0] ^ value).bit_count()
            below = at[2].get(d)
            if below is None:
                at[2][d] = node
                return
            at = below

    def within(self, value: int, radius: int) -> Iterator[tuple[int, int]]:
        """(distance, name) within the radius: only edges from d - radius to d + radius can lead there."""
        stack = [self.root] if self.root is not None else []
        while stack:
            at = stack.pop()
            d = (at[0] ^ value).bit_count()
            if d <= radius:
                yield d, at[1]
            below = at[2]
            if len(below) > 2 * radius + 1:
                stack.extend(below[k] for k in range(d - radius, d + radius + 1) if k in below)
            else:
                stack.extend(n for k, n in below.items() if -radius <= k - d <= radius)


class Searcher:
    """The searches of a task, shard by shard: rows of a shard come together, those to be stored first.

    ``root`` is a node's component so far; rows of one component are not held against each other. Where rows
    bring all their keys, a pair that shares an earlier one belongs to that key's shard."""

    def __init__(self, radius: int, near: int, alike: float) -> None:
        self.radius, self.near, self.alike = radius, near, alike
        self.shard: int | None = None

    def enter(self, shard: int) -> None:
        if shard != self.shard:
            self.shard, self.tree, self.known, self.parent = shard, BKTree(), {}, {}

    def store(self, node: int, value: int, size: int, root: int, before: list[int], more: object = None) -> None:
        self.known[node] = size, root, before, more
        self.tree.add(value, node)

    def top(self, x: int) -> int:
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    def around(self, value: int, size: int, root: int) -> list[int]:
        """Stored nodes of other components within the radius, nearest first."""
        known, alike = self.known, self.alike
        found = sorted((d, other) for d, other in self.tree.within(value, self.radius) if known[other][1] != root)
        # sets whose sizes differ by more cannot be alike enough
        return [o for _, o in found if not alike or min(size, known[o][0]) >= alike * max(size, known[o][0])]

    def elsewhere(self, before: list[int], other: int) -> bool:
        return bool(before) and any(map(eq, before, self.known[other][2]))

    def links(self, shard: int, key: int, node: int, value: int, size: int, root: int, keys: list[int] | None, stored: bool, compared: bool) -> Iterator[tuple[int, int]]:
        """A row that is compared is linked to its ``near`` nearest neighbours, and to the nearest in each
        component that no link of this shard has joined to its own yet."""
        self.enter(shard)
        before = keys[: keys.index(key)] if keys else []
        if compared:
            own = []
            for other in self.around(value, size, root):
                if self.elsewhere(before, other):
                    self.parent[self.top(root)] = self.top(self.known[other][1])
                else:
                    own.append(other)
            for i, other in enumerate(own):
                a, b = self.top(root), self.top(self.known[other][1])
                if a != b or i < self.near:
                    self.parent[a] = b
                    yield node, other
        if stored:
            self.store(node, value, size, root, before)

    def apart(self, row: tuple) -> Iterator[tuple]:
        """``row`` as it came if it is compared and has neighbours in other components, and these, each once."""
        shard, key, _, node, fp, size, root, keys, stored, _ = row
        self.enter(shard)
        value, before = int.from_bytes(fp), keys[: keys.index(key)]
        if stored:
            self.store(node, value, size, root, before, row)
            return
        own = [o for o in self.around(value, size, root) if not self.elsewhere(before, o)]
        if own:
            yield row
        for o in own:
            if (seen := self.known[o])[3]:
                self.known[o] = *seen[:3], None
                yield seen[3]

    def alike_links(self, row: tuple, shingles: np.ndarray, chunk: int = 32) -> Iterator[tuple[int, int]]:
        """Links of a compared row: all its neighbours in components that are still apart are compared by
        their sets, nearest first."""
        shard, key, _, node, fp, size, root, keys, stored, _ = row
        self.enter(shard)
        value, before = int.from_bytes(fp), keys[: keys.index(key)]
        if stored:
            self.store(node, value, size, root, before, shingles)
            return
        own = [o for o in self.around(value, size, root) if not self.elsewhere(before, o)]
        for i in range(0, len(own), chunk):
            part = [o for o in own[i : i + chunk] if self.top(self.known[o][1]) != self.top(root)]
            if part:
                for o, good in zip(part, alike_sets(shingles, [self.known[o][3] for o in part], self.alike), strict=True):
                    a, b = self.top(root), self.top(self.known[o][1])
                    if good and a != b:
                        self.parent[a] = b
                        yield node, o


def alike_sets(one: np.ndarray, others: list[np.ndarray], similarity: float) -> list[bool]:
    """Whether the Jaccard similarity of ``one`` and each of the others reaches ``similarity``: sorted arrays
    without repeats, none empty."""
    n = np.fromiter(map(len, others), np.int64, len(others))
    joined = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, joined), len(one) - 1)
    both = np.add.reduceat(one[at] == joined, np.cumsum(n) - n, dtype=np.int64)
    return (both >= similarity * (len(one) + n - both)).tolist()


def block_keys(bits: int, radius: int) -> Column:
    """Shard keys of ``fp``: for each pair of radius + 2 blocks their bits and the pair's number."""
    n = radius + 2
    cuts = [bits * i // n for i in range(n + 1)]
    text = F.lpad(F.conv(F.hex("fp"), 16, 2), bits, "0")
    block = [F.substring(text, a + 1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return F.array(*[F.xxhash64(F.lit(i), x, y) for i, (x, y) in enumerate(combinations(block, 2))])


def piece_keys(bits: int, radius: int) -> Column:
    """Keys of radius + 1 pieces of ``fp``: piece i has the bits i, i + radius + 1, and so on."""
    text = F.lpad(F.conv(F.hex("fp"), 16, 2), bits, "0")
    n = radius + 1
    take = lambda i: F.concat(*[F.substring(text, p + 1, 1) for p in range(i, bits, n)])
    return F.array(*[F.xxhash64(F.lit(i), take(i)) for i in range(n)])


def placed(nodes: DataFrame, keys: Column, finer: Column | None, tree: int) -> DataFrame:
    """(key, node, fp, size, keys, n, trees, home) of nodes that share a shard: a written table. ``home`` is the
    node's own tree of the shard's ``trees``. ``finer``: keys, of which two nodes to be linked share one at
    least, that cut shards above ``tree``; None where there are no such keys: then rows bring all their keys."""
    every = F.lit(None).cast("array<bigint>") if finer is not None else keys
    spread = nodes.select("node", "fp", "size", every.alias("keys"), *([] if finer is None else [finer.alias("finer")]), F.explode(keys).alias("key"))
    count = F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight")
    shared = written(spread.groupBy("key").agg(*count).where("n > 1"), "shared")
    trees = F.greatest(F.ceil(F.col("n") / tree), F.ceil(F.col("weight") / WEIGHT)).cast("int").alias("trees")
    spread = split_by_bitmap(spread, F.col("key"), shared)[1]  # few keys are shared, and only their rows move
    at = ["key", "node", "fp", "size", "keys", "n", trees]
    once = spread.join(shared if finer is None else shared.where(F.col("n") <= tree), "key").select(*at)
    large = shared.where(F.col("n") > tree)
    if finer is not None and large.limit(1).count():
        cut = spread.join(large, "key").select("node", "fp", "size", "keys", "key", F.explode("finer").alias("f"))
        cut = cut.where("f <> key").select("node", "fp", "size", "keys", F.xxhash64("key", "f").alias("key"))
        sizes = written(cut.groupBy("key").agg(*count).where("n > 1"), "finer")
        once = once.union(cut.join(sizes, "key").select(*at))
    table = written(once.withColumn("home", F.pmod(F.xxhash64("key", "node"), F.col("trees")).cast("int")), "placed")
    done_with(shared)
    return table


def dealt(stored: DataFrame, asked: DataFrame | None) -> DataFrame:
    """The rows (key, tree, node, fp, size, root, keys) of each tree together, those to be stored first;
    ``asked`` are compared with what their tree stores, or without them each stored row with the others."""
    sent = stored.withColumn("stored", F.lit(True)).withColumn("compared", F.lit(asked is None))
    if asked is not None:
        sent = sent.unionByName(asked.withColumn("stored", F.lit(False)).withColumn("compared", F.lit(True)))
    return by_shard(sent.withColumn("shard", F.xxhash64("key", "tree")))


def by_shard(rows: DataFrame) -> DataFrame:
    rows = rows.select(*ROW, *[c for c in rows.columns if c not in ROW])
    return rows.repartition("shard").sortWithinPartitions("shard", F.desc("stored"))


def pairs_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([max(x) for x in found], pa.int64()), pa.array([min(x) for x in found], pa.int64())], names=["a", "b"])


def columns_of(b: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    return zip(*(b.column(c).to_pylist() for c in names), strict=True)


def searched(rows: DataFrame, radius: int, near: int, alike: float) -> DataFrame:
    """Distinct links (a, b), a above b, of dealt rows."""
    names = [c for c in ROW if c != "tree"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Searcher(radius, near, alike)
        for b in batches:
            yield pairs_batch([x for s, k, n, f, *rest in columns_of(b, names) for x in at.links(s, k, n, int.from_bytes(f), *rest)])

    return rows.mapInArrow(search, "a bigint, b bigint").distinct()


def still_apart(rows: DataFrame, radius: int, alike: float) -> DataFrame:
    """Those of the dealt rows that have candidates in other components, or are such."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Searcher(radius, 0, alike)
        for b in batches:
            found = [x for row in columns_of(b, ROW) for x in at.apart(row)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)], names=ROW)

    form = "shard bigint, key bigint, tree int, node bigint, fp binary, size int, root bigint, keys array<bigint>, stored boolean, compared boolean"
    return rows.mapInArrow(search, form)


def joined_by_sets(rows: DataFrame, sets: DataFrame, radius: int, alike: float) -> DataFrame:
    """Distinct links (a, b), a above b, of rows of still_apart, by their ``sets(node, shingles)``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Searcher(radius, 0, alike)
        for b in batches:
            shingles = b.column("shingles").to_pylist()
            yield pairs_batch([x for row, s in zip(columns_of(b, ROW), shingles, strict=True) for x in at.alike_links(row, np.frombuffer(s, np.uint32))])

    return by_shard(rows.join(sets, "node")).mapInArrow(search, "a bigint, b bigint").distinct()


def linked(nodes: DataFrame, keys: Column, radius: int, finer: Column | None, tree: int = 2048, alike: float = 0.0, sets: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root) of ``nodes(node, fp, size, ..)`` with a link, root the least node reachable. Links join
    what shares a key and is within the radius.

    With ``sets``, which makes a written table (node, shingles) of a table of nodes, only those are links
    whose sets have the similarity ``alike``. The first turn checks NEAR candidates of each node, the second
    every candidate that is in another component by then."""
    table = placed(nodes, keys, finer, tree)
    row = [c for c in ROW if c not in ("shard", "tree", "stored", "compared")]
    own = table.withColumn("root", F.col("node")).select(*row, F.col("home").alias("tree"))
    near = NEAR if sets else 0
    tried = written(searched(dealt(own, None), radius, near, alike), "candidates")
    held = sets(tried.select(F.explode(F.array("a", "b")).alias("node")).distinct()) if sets else None
    edges = written(alike_pairs(tried, held, alike), "alike") if sets else tried
    found = components(edges)
    several = table.where((F.col("trees") > 1) | (F.col("n") > near + 1) if sets else F.col("trees") > 1)
    if several.limit(1).count():
        rooted = written(several.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        parts = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
        major = written(parts.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("major")), "major")
        outside = rooted.join(major, "key").where("root <> major")
        asked = outside.select(*row, "home", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"))
        asked = (asked if sets else asked.where("tree <> home")).drop("home")
        if sets:  # shards of one component have nothing to ask
            rooted_apart = rooted.join(outside.select("key").distinct(), "key", "left_semi")
            rows = written(still_apart(dealt(rooted_apart.select(*row, F.col("home").alias("tree")), asked), radius, alike), "apart")
            lacking = written(rows.select("node").distinct().join(held, "node", "left_anti"), "lacking")
            others = sets(lacking)
            more = written(joined_by_sets(rows, held.union(others), radius, alike), "more")
            done_with(rows, lacking, others)
        else:
            more = written(searched(dealt(rooted.select(*row, F.col("home").alias("tree")), asked), radius, 0, alike), "more")
        found = components(edges.union(more))
        done_with(rooted, major, more)
    done_with(table, tried, *([edges, held] if sets else []))
    return found


def near_components(prints: DataFrame, keys: Column, radius: int, finer: Column | None) -> DataFrame:
    """(doc_id, fp, component_id) of a written table ``prints(doc_id, fp)``."""
    numbered = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = written(numbered.withColumns({"node": F.monotonically_increasing_id(), "size": F.lit(1)}), "nodes")
    found = written(linked(nodes, keys, radius, finer), "roots")
    rooted = nodes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("root"), "least")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.select("doc_id", "fp").join(written(rooted.join(ids, "root").select("fp", "component_id"), "components"), "fp")


def node_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """A written table (node, shingles) of the ``wanted(node)``: 32 bits of each hash, sorted;
    ``nodes(node, digest, row)`` names a document of ``docs(row, text)`` for each node."""
    spark = docs.sparkSession
    asked = written(nodes.join(wanted, "node", "left_semi").select("node", "digest", "row"), "asked")

    # texts that no pair asks for stay where they are: a bitmap of BITS bits, whatever the data's size, lets
    # few others pass, and the join after it decides
    at = F.pmod("row", F.lit(BITS))
    found = asked.groupBy((at / 32768).cast("int").alias("i")).agg(F.bitmap_construct_agg((at % 32768).cast("bigint")).alias("bits")).collect()
    bitmap = np.zeros(BITS // 8, np.uint8)
    for r in found:
        bitmap[r["i"] * 4096 : (r["i"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            place = whole.column("row").to_numpy() % BITS
            part = whole.filter(pa.array(shared.value[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0))
            for b in grouped([part], "text", 200_000):
                of, h = shingle_sets(b.column("text"), width)
                cuts = np.searchsorted(of, np.arange(len(b) + 1))
                sets = [np.unique(h[i:j].astype(np.uint32)).tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(set_digests(of, h, len(b)), pa.binary()), pa.array(sets, pa.binary())], names=["row", "digest", "shingles"])

    texts = docs.select("row", F.col("text").cast("binary").alias("text"))
    sets = texts.mapInArrow(make, "row bigint, digest binary, shingles binary").join(asked, ["row", "digest"])
    sets = written(sets.groupBy("node").agg(F.max("shingles").alias("shingles")), "sets")
    done_with(asked)
    return sets


def alike_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose ``sets(node, shingles)`` have the Jaccard similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)
            good = [alike_sets(np.frombuffer(x, np.uint32), [np.frombuffer(y, np.uint32)], similarity)[0] for x, y in both]
            yield b.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    named = lambda n, c: sets.select(F.col("node").alias(n), F.col("shingles").alias(c))
    return pairs.join(named("a", "x"), "a").join(named("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5, tree: int = 2048) -> DataFrame:
    """(doc_id, text_hash, component_id, kept) for each row of ``docs(doc_id, text)``: documents whose sets of
    word shingles have a Jaccard similarity of ``similarity`` or more are linked; kept is the row with the
    least id of its component, ids before null, ties by hash of text.

    Equal-size sets with similarity s have cosine 2s / (1 + s), and a bit differs with probability angle / pi.
    The radius is four standard deviations beyond that, so a pair just at ``similarity`` is a candidate all
    but 3 times in 100,000; ten bands of two min-hashes meet with 0.99996 at 0.8. Every candidate whose
    component is not its own already is compared exactly."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.xxhash64("doc_id", "text").alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in grouped(batches, "text", 200_000):
            made = wide_fingerprints(b.column("text"), width)
            columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), b.column("row"), *columns], names=["doc_id", "text_hash", "row", "digest", "fp", "bands", "size"])

    told = keyed.select("doc_id", "text_hash", "row", F.col("text").cast("binary").alias("text"))
    prints = written(told.mapInArrow(run, "doc_id bigint, text_hash bigint, row bigint, digest binary, fp binary, bands array<bigint>, size int"), "prints")
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = round(WIDE * p + 4 * (WIDE * p * (1 - p)) ** 0.5)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    nodes = prints.groupBy("digest").agg(F.min("row").alias("row"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"), F.any_value("size").alias("size"), first)
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = written(linked(nodes, F.col("bands"), radius, None, tree, similarity, lambda wanted: node_sets(wanted, nodes, keyed, width)), "roots")
    rooted = written(nodes.join(found, "node", "left").select("digest", F.coalesce("root", "node").alias("root"), "first"), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    chosen = written(rooted.select("digest", "root").join(least, "root").select("digest", "first"), "chosen")
    done_with(nodes, found, rooted)
    out = prints.select("doc_id", "text_hash", "digest").join(chosen, "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return out.select("doc_id", "text_hash", F.col("first.doc_id").alias("component_id"), kept.alias("kept"))


def op5_bktree_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = written(fingerprints(documents(spark, sf_dir), 3), "prints")
    out = near_components(prints, block_keys(64, 2), 2, piece_keys(64, 2))
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
