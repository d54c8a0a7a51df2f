"""SimHash near-duplicates through a hierarchical index in Gray order.

A document's fingerprint has a bit for each of the 64 places at which more than half of its
shingles' hashes have it. Two fingerprints link if at most RADIUS bits differ; documents form the
components of these links.

Finding the links. The 64 bits fall into BLOCKS blocks, and two linked fingerprints agree outside
some RADIUS of them; so each fingerprint goes once to every choice of RADIUS blocks, keyed by its
other bits, and a key's fingerprints can differ in RADIUS blocks only. Within a key they are sorted
by Gray rank, which puts similar bit patterns together. Every FAN neighbours get a node above them
that holds the bits they share, every FAN nodes one above those, up to the key's root. A search goes
down from the root, adds up the differences on the bits that each level newly fixes, and drops a
node, with all below it, once they exceed RADIUS. A node whose free bits are within what is left is
accepted whole. Only a spanning set of links leaves a task, at most one for each row.

A text of fewer words than a shingle has its whole sequence as its one shingle; null, empty and blank
texts have the fingerprint zero, which links like any other. Repeated rows get equal results. A null
doc_id is never a component's id unless all of its doc_ids are null. An empty table gives an empty one.
A very long text is shingled whole, in memory in proportion to it. Columns other than id and text
aren't looked at. A fingerprint that many rows have meets them by broadcast, never in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut, drop, made, slices, spread_join

SHINGLE, SEED, RADIUS, BLOCKS, FAN = 3, 42, 2, 6, 8
#: Rows that one task of the link search is meant to hold, and pairs that it looks at together.
BUCKET, FRONTIER = 200_000, 1 << 22
#: Shingles that are summed in 16-bit lanes together.
LANE = 60_000


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n <= width:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if n else [], np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.fromiter((xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())), np.uint64, n - width + 1)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each document's hashes; zero for none."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat, sizes = np.concatenate([hashes[i] for i in full]), sizes[full]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    cuts = [np.arange(a, a + n, LANE) for a, n in zip(first, sizes)]
    begin = np.concatenate(cuts)
    of = np.concatenate([[0], np.cumsum([len(c) for c in cuts])[:-1]])
    for j in range(16):
        lanes = np.add.reduceat((flat >> np.uint64(j)) & np.uint64(0x0001000100010001), begin)
        for k in range(4):
            count = np.add.reduceat(((lanes >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64), of)
            out[full] |= np.where(2 * count > sizes, np.uint64(1 << (j + 16 * k)), np.uint64(0))
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed 64-bit number."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = majority([shingle_hashes(t, width) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return src.mapInArrow(run, "doc_id long, fp long")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each code in the order of reflected Gray codes."""
    rank = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class Forest:
    """Gray-order indexes of many groups side by side. Rows come sorted by group, then Gray rank."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        self.fps = fps
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        n = len(fps)
        #: For each level from the leaves up: first row, last row, first child, children, shared bits, their values.
        at = np.arange(n)
        self.levels = [(at, at, at, np.zeros(n, np.int64), np.full(n, full), fps)]
        ones = zeros = fps
        while len(group) > len(np.unique(group)):
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            inside = np.arange(len(group)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(group)]])))
            child = np.flatnonzero(inside % FAN == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, child), np.bitwise_or.reduceat(zeros, child)
            shared = ~(ones ^ zeros)
            low = self.levels[-1]
            ends = np.concatenate([child[1:], [len(group)]])
            group = group[child]
            self.levels.append((low[0][child], low[1][ends - 1], child, ends - child, shared, ones & shared))
        self.root = np.repeat(np.arange(len(group)), self.levels[-1][1] - self.levels[-1][0] + 1)

    def tight(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the first rows of their nodes, for nodes whose rows are all within the radius."""
        a, b = [], []
        for first, last, _, _, shared, _ in self.levels[1:]:
            for i in np.flatnonzero(np.bitwise_count(~shared) <= radius):
                a.append(np.arange(first[i] + 1, last[i] + 1))
                b.append(np.full(last[i] - first[i], first[i]))
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2

    def search(self, rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Links from the rows to later rows of their groups; for a node accepted whole, to its first row."""
        query, node, used = rows, self.root[rows], np.zeros(len(rows), np.int64)
        a, b = [], []
        for level in range(len(self.levels) - 1, 0, -1):
            _, _, child, children, shared, _ = self.levels[level]
            first, last, _, _, own, value = self.levels[level - 1]
            n = children[node]
            to = np.repeat(child[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            query, used, above = np.repeat(query, n), np.repeat(used, n), np.repeat(shared[node], n)
            used = used + np.bitwise_count((self.fps[query] ^ value[to]) & own[to] & ~above)
            keep = (used <= radius) & (last[to] > query)
            query, node, used = query[keep], to[keep], used[keep]
            whole = (used + np.bitwise_count(~own[node]) <= radius) & (first[node] > query)
            a.append(query[whole])
            b.append(first[node[whole]])
            query, node, used = query[~whole], node[~whole], used[~whole]
        return np.concatenate(a), np.concatenate(b)


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least row of its set) after joining the sets of a[i] and b[i]."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def joined(choice: np.ndarray, key: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Rows that the links among fingerprints of equal choice and key join to another, and for each the one row of its set."""
    order = np.lexsort((gray_rank(fps), key, choice))
    choice, key, fps = choice[order], key[order], fps[order]
    new = np.concatenate([[True], (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])]) if len(fps) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    many = np.bincount(group, minlength=1)[group] > 1
    order, fps, group = order[many], fps[many], group[many]
    n = len(fps)
    if not n:
        return order, order
    index = Forest(fps, group)
    size = np.bincount(group)[group]
    label = unite(np.arange(n), *index.tight(radius))
    work = np.cumsum(np.minimum(size, FRONTIER)) // FRONTIER
    for some in np.split(np.arange(n), np.flatnonzero(np.diff(work)) + 1):
        if len(index.levels) > 1:
            label = unite(label, *index.search(some, radius))
    moved = np.flatnonzero(label != np.arange(n))
    return order[moved], order[label[moved]]


def spanning(choice: np.ndarray, key: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links among fingerprints of equal choice and key."""
    a, b = joined(choice, key, fps, radius)
    return fps[a], fps[b]


def masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """For each choice of ``radius`` blocks the mask of all other bits, as signed numbers."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for some in combinations(range(blocks), radius):
        mask = (1 << 64) - 1
        for i in some:
            mask &= ~(((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1))
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b): a spanning set of the links among the distinct fingerprints of column ``fp``."""
    keys = masks(radius, blocks)
    buckets = max(1, fps.count() * len(keys) // BUCKET)
    choice = F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(keys))))
    dealt = fps.select("fp", choice.alias("k")).select("fp", "k.choice", "k.key").withColumn("bucket", F.pmod(F.xxhash64("choice", "key"), F.lit(buckets)))

    def run(group: pa.Table) -> pa.Table:
        col = lambda c: group.column(c).to_numpy()
        a, b = spanning(col("choice"), col("key"), col("fp").astype(np.int64).view(np.uint64), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("bucket").applyInArrow(run, "a long, b long").distinct()


def nearest(edges: DataFrame) -> DataFrame:
    """(u, m, _n): the least neighbour of each node of the edges (u, v), and its edges."""
    return cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")), "nearest")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the edges (a, b), root being the least node of the component.

    Alternates large and small stars until nothing changes, which takes about the logarithm of the
    nodes in rounds; each round is cut off in a table, which the next one's replaces. A star of any
    size meets its centre's least neighbour by broadcast, or, beyond what is broadcast, spread over tasks.
    """
    spark, before = edges.sparkSession, None
    with made() as paths:
        state = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
        while True:
            both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = spread_join(both.where("v > u"), nearest(both), ["u"]).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            large = cut(large.distinct(), "large")
            stars = spread_join(large, nearest(large), ["u"]).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
            state = cut(stars, "stars")
            now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            drop(spark, paths[:-1])
            del paths[:-1]
            if now == before:
                return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
            before = now


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable) for every row."""
    rows = cut(fingerprints(docs, doc_id, text, width), "fingerprints")
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_n")), "distinct")
    roots = components(links(distinct.select("fp"), radius)).withColumnsRenamed({"node": "fp", "root": "_root"})
    rooted = distinct.join(roots, "fp", "left").withColumn("_root", F.coalesce("_root", "fp"))
    linked = cut(rooted.join(rooted.groupBy("_root").agg(F.min("_least").alias("component_id")), "_root").select("fp", "component_id", "_n"), "components")
    return spread_join(rows, linked, ["fp"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
