"""Near copies by word shingles: SimHash fingerprints for candidates, each decided by its exact Jaccard similarity.

The near-duplicate stage's search. At a Jaccard similarity of 0.8 two 64-bit fingerprints differ in about
10 bits, and within the 2 bits of ``simhash.group`` lie few near copies; so each set gets many fingerprints,
and links of up to RADIUS bits are looked for. Hashes, fingerprints, the index in Gray order and components
are that module's.

Two rows link if the sets of their five-word shingles have a Jaccard similarity of THRESHOLD or more;
rows form the components of these links. Words are split at ASCII white space, ASCII letters without
case; a text of fewer words, but one at least, has its whole sequence as its shingle. Texts without
words, null ones too, are copies of one another.

Finding the links. Rows of equal sets are one class. Each class has PRINTS fingerprints, of its hashes
mixed anew for each. A fingerprint goes once to each of its BLOCKS blocks of bits, keyed by it, and within
a key the hierarchical index in Gray order finds those within RADIUS bits; they and what they link to are a
bucket. A pair at 0.8 meets in no bucket with probability 5e-8 where a bit differs as often as the angle
between large sets says (0.15), a closer pair more rarely. Fingerprints of few shingles differ more often, at
4 of 5 in 0.19 of the bits, so sets of up to FEW have MORE fingerprints, which leaves 5e-7 there. Buckets of
equal members count once. Keys that no task should hold are buckets without a search.

1. Each member is compared with the middle one, that in the most and largest buckets, of one of its buckets,
   by joins on the sets: a bucket of any size is spread over tasks. Rounds follow for middle ones that aren't
   in the member's component yet, while one comparison in JOINS finds a link.
2. Where members of a bucket are still in different components, those that aren't in the middle one's
   are compared with all, in blocks of about BLOCK by BLOCK members and HASHES by HASHES hashes of their sets:
   no task holds more. Only a spanning set of links leaves a task, so that no table of pairs is made.

A Python worker that Spark reuses gives up what other operators left in it, and after each step what it no longer needs.

Rows are told apart by 128 hash bits of id and text: ids may be null or repeated. An empty table gives
empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release, row_key, slices, small, spread_join, sweep
from .simhash import components, joined, majority, masks, shingle_hashes

KEY = ["_k1", "_k2"]
SHINGLE, THRESHOLD, PRINTS, RADIUS, BLOCKS = 5, 0.8, 58, 12, 4
#: Fingerprints of a set of up to FEW shingles.
MORE, FEW = 112, 80
#: Two odd factors for each fingerprint, and for each block the mask of its bits.
MIX = np.random.default_rng(42).integers(0, 1 << 63, (MORE, 2), np.uint64) << np.uint64(1) | np.uint64(1)
MASKS = np.array(masks(BLOCKS - 1, BLOCKS), np.int64).view(np.uint64)
#: Fingerprints that one task of the search is meant to hold, and those from which it isn't made.
DEALT, FULL = 100_000, 1 << 21
#: Members of a bucket that are compared with as many others in one group, and those that a task is meant to hold.
BLOCK, TASK = 1000, 4000
#: Hashes of their sets that these are meant to have at the most, and those that a task is meant to hold.
HASHES = 500_000
#: Comparisons with middle members, for a link each, beyond which no further round is made.
JOINS = 10


def prints(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The fingerprints of each set of hashes; none of an empty one."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), MORE), np.uint64)
    for begin, end, some in ((0, PRINTS, np.flatnonzero(sizes)), (PRINTS, MORE, np.flatnonzero((sizes > 0) & (sizes <= FEW)))):
        if len(some):
            flat, ends = np.concatenate([sets[i] for i in some]), np.cumsum(sizes[some])[:-1]
            for t in range(begin, end):
                mixed = flat * MIX[t, 0]
                mixed ^= mixed >> np.uint64(32)
                mixed *= MIX[t, 1]
                mixed ^= mixed >> np.uint64(32)
                out[some, t] = majority(np.split(mixed, ends))
    return [row[: 0 if not n else MORE if n <= FEW else PRINTS] for row, n in zip(out, sizes)]


def sketches(rows: DataFrame) -> DataFrame:
    """(_k1, _k2, doc_id, set, z, prints): a digest of each row's shingle set, its size, its fingerprints (64 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t, SHINGLE)) for t in batch.column("text").to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            cols = [*(batch.column(c) for c in (*KEY, "doc_id")), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([p.tobytes() for p in prints(sets)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*KEY, "doc_id", "set", "z", "prints"])
        release()

    return rows.mapInArrow(run, "_k1 long, _k2 long, doc_id long, set binary, z int, prints binary")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(c, one, s): the shingle hashes of each class, from its rows (c, one, text); a task gives each class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        done: set[bytes] = set()
        for batch in slices(batches):
            c, one, s = [], [], []
            for of, alone, text in zip(*(batch.column(x).to_pylist() for x in ("c", "one", "text"))):
                if alone or of not in done:
                    if not alone:
                        done.add(of)
                    c.append(of)
                    one.append(alone)
                    s.append(np.unique(shingle_hashes(text, SHINGLE)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), pa.array(one, pa.bool_()), pa.array(s, pa.list_(pa.int64()))], names=["c", "one", "s"])
        release()

    return rows.select("c", "one", "text").mapInArrow(run, "c binary, one boolean, s array<long>")


def spanning(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links among the sets of one bucket, which lie in ``flat`` one after another."""
    n = len(sizes)
    ids = np.unique(flat, return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    label, has = np.arange(n), np.zeros(int(ids.max()) + 1, bool)
    a, b = [], []

    def compare(x: int) -> int:
        own = ids[starts[x] : starts[x] + sizes[x]]
        has[own] = True
        shared = np.add.reduceat(has[ids], starts, dtype=np.int64)
        has[own] = False
        near = np.flatnonzero(shared >= (sizes + sizes[x] - shared) * THRESHOLD - 1e-9)
        for y in near[label[near] != label[x]].tolist():
            if label[y] != label[x]:
                a.append(x)
                b.append(y)
                label[label == label[y]] = label[x]
        return len(near)

    # Those that are joined to the best of a few need no comparison: all others are compared with all.
    few = range(0, n, max(1, n // 4))
    middle = max((compare(x), x) for x in few)[1]
    for x in range(n):
        if x not in few and label[x] != label[middle]:
            compare(x)
    return np.array(a, np.int64), np.array(b, np.int64)


def gathered(classes: DataFrame) -> DataFrame:
    """(key, h): the classes, by a hash of their sets, that linked fingerprints bring together under each key."""
    n = classes.count()
    parts = max(1, -(-n // DEALT))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = pc.binary_length(batch.column("prints")).to_numpy().astype(np.int64) // 8
            fps = np.frombuffer(b"".join(batch.column("prints").to_pylist()), np.uint64)
            table = np.arange(len(fps)) - np.repeat(np.cumsum(many) - many, many)
            h = np.repeat(batch.column("h").to_numpy(), many)
            for i, mask in enumerate(MASKS):
                part = ((fps & mask) * MIX[i, 0] >> np.uint64(32)) % np.uint64(parts)
                bucket = (table * BLOCKS + i) * parts + part.astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                cuts = list(zip(at.tolist(), [*at[1:].tolist(), len(order)]))
                cols = [pa.array(bucket[order][at], pa.int64()), *(pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (fps[order], h[order]))]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "fps", "hs"])
        release()

    dealt = classes.select(F.xxhash64("set").alias("h"), "prints").mapInArrow(deal, "bucket long, fps binary, hs binary")
    full: set[int] = set()
    if n >= FULL:
        sizes = dealt.groupBy("bucket").agg(F.sum(F.length("hs") / 8).alias("n"))
        full = {r["bucket"] for r in sizes.where(F.col("n") >= FULL).collect()}

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        fps, h = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("fps", np.uint64), ("hs", np.int64)))
        of = bucket // parts
        key = fps & MASKS[of % BLOCKS]
        if bucket in full:
            first = key
        else:
            rows, roots = joined(np.zeros(len(fps), np.int8), key, fps, RADIUS)
            own = np.unique(roots)
            first, h = fps[np.concatenate([roots, own])], h[np.concatenate([rows, own])]
            release()
        return pa.table({"of": pa.array(np.full(len(h), of), pa.int64()), "first": first.view(np.int64), "h": h})

    salt = F.when(F.col("bucket").isin(full), F.xxhash64("hs")).otherwise(F.lit(0)) if full else F.lit(0).cast("long")
    found = dealt.withColumn("salt", salt).groupBy("bucket", "salt").applyInArrow(run, "of long, first long, h long")
    return found.select(F.xxhash64("of", "first").alias("key"), "h")


def buckets_of(classes: DataFrame) -> DataFrame:
    """(key, c, z, least, zl, wl): the members of the buckets, each beside its bucket's middle one, that in the most and largest buckets."""
    known = small(classes.select(F.xxhash64("set").alias("h"), F.col("set").alias("c"), "z"))
    met = cut(gathered(classes).join(known, "h").select("key", "c", "z"), "met")
    counts = cut(met.groupBy("key").agg(F.count(F.lit(1)).alias("_n")), "counts")
    weights = cut(spread_join(met, counts.withColumn("w", -F.col("_n")), ["key"]).groupBy("c").agg(F.sum("w").alias("w")), "weights")
    members = cut(met.join(small(weights), "c"), "members")
    sweep(classes.sparkSession)  # of the fingerprints' shuffle, by far the largest, which Spark's listeners have let go by now
    same = members.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("w", "c", "z")).alias("l"), F.max("c").alias("most"), F.bit_xor(F.xxhash64("c")).alias("all"))
    once = same.where("_n > 1").groupBy("_n", "l", "most", "all").agg(F.min("key").alias("key"))
    once = cut(once.select("key", F.col("l.c").alias("least"), F.col("l.z").alias("zl"), F.col("l.w").alias("wl"), "_n"), "once")
    return cut(spread_join(members.drop("w"), once, ["key"]), "beside")


def pairs_of(beside: DataFrame) -> DataFrame:
    """(c, least, wl): each member beside the middle one of each of its buckets, if their sizes allow a link."""
    near = (F.col("c") != F.col("least")) & (F.least("z", "zl") >= THRESHOLD * F.greatest("z", "zl") - 1e-9)
    return cut(beside.where(near).select("c", "least", "wl").distinct(), "pairs")


def apart(pairs: DataFrame, first: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that aren't among the first ones, of members that the roots don't join yet."""
    others = pairs.join(small(first.withColumnRenamed("least", "one")), "c").where("least <> one").drop("one")
    others = others.join(small(roots.withColumnsRenamed({"node": "c", "root": "rc"})), "c", "left").withColumn("rc", F.coalesce("rc", "c"))
    middles = pairs.groupBy("least").agg(F.count(F.lit(1)).alias("_n")).join(small(roots.withColumnsRenamed({"node": "least", "root": "rl"})), "least", "left")
    middles = cut(middles.withColumn("rl", F.coalesce("rl", "least")), "rooted")
    return cut(spread_join(others, middles, ["least"]).where("rc <> rl").select("c", "least", "wl"), "apart")


def stars(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the pairs that link."""
    # Sets grow with the texts: they meet by shuffle, and only the ids of the pairs are broadcast.
    held = small(cut(pairs.groupBy("least").agg(F.count(F.lit(1)).alias("_n")), "held"))
    middle = cut(sets.withColumnsRenamed({"c": "least", "s": "s2"}).join(held, "least"), "middles")
    both = spread_join(sets.join(small(pairs), "c"), middle, ["least"], whole=False)
    shared = F.size(F.array_intersect("s", "s2")).alias("shared")
    counted = both.select("c", "least", (F.size("s") + F.size("s2")).alias("all"), shared)
    return cut(counted.select(F.col("c").alias("a"), F.col("least").alias("b"), (F.col("shared") >= (F.col("all") - F.col("shared")) * THRESHOLD - 1e-9).alias("near")), "compared").where("near").select("a", "b")


def leftovers(beside: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, u, m, c, z): the groups in which members of buckets that aren't one component yet are compared."""
    rooted = beside.select("key", "c", "least", "z").join(small(roots.withColumnRenamed("node", "c")), "c", "left").withColumn("root", F.coalesce("root", "c"))
    apart = rooted.groupBy("key").agg(F.min(F.struct((F.col("c") != F.col("least")).alias("other"), "root")).alias("l"), F.min("root").alias("low"), F.max("root").alias("high"), F.min("z").alias("zl"), F.max("z").alias("zh"), F.count(F.lit(1)).alias("_n"))
    # Two members of sizes too different for a link need no comparison.
    apart = cut(apart.where("low <> high").where((F.col("_n") > 2) | (F.col("zl") >= THRESHOLD * F.col("zh") - 1e-9)).select("key", F.col("l.root").alias("own"), "_n"), "apart")
    rows = cut(spread_join(rooted, apart, ["key"]).select("key", "c", "z", (F.col("root") != F.col("own")).alias("out")), "leftovers")
    split = lambda some: F.greatest(F.ceil(F.count(some) / BLOCK), F.ceil(F.sum(F.when(some, F.col("z").cast("long"))) / HASHES)).cast("int")
    out = F.when(F.col("out"), True)
    sizes = rows.groupBy("key").agg(split(out).alias("us"), split(F.lit(True)).alias("ms"), F.count(F.lit(1)).alias("_n"))
    rows = spread_join(rows, cut(sizes, "sizes"), ["key"])
    part = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = rows.where("out").select("key", part("us").alias("u"), every("ms").alias("m"), "c", "z")
    return cut(outer.unionByName(rows.select("key", every("us").alias("u"), part("ms").alias("m"), "c", "z")).distinct(), "blocks")


def compared(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): a spanning set of the links within each group."""
    many = blocks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("z").cast("long")), F.lit(0)).alias("z")).first()
    tasks = max(1, -(-many["n"] // TASK), -(-many["z"] // HASHES))

    def run(group: pa.Table) -> pa.Table:
        keys = [group.column(k).to_numpy() for k in ("m", "u", "key")]
        order = np.lexsort(keys)
        new = np.any([np.diff(k[order]) != 0 for k in keys], 0)
        group = group.take(pa.array(order))
        c, s = group.column("c"), group.column("s")
        sizes = pc.list_value_length(s).to_numpy().astype(np.int64)
        flat = pc.list_flatten(s).to_numpy()
        ends, a, b = np.cumsum(sizes), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(order)]
        for i, j in zip(cuts, cuts[1:]):
            if j - i > 1:
                x, y = spanning(flat[ends[i] - sizes[i] : ends[j - 1]], sizes[i:j])
                a.append(x + i)
                b.append(y + i)
        found = pa.table({"a": c.take(pa.array(np.concatenate(a))), "b": c.take(pa.array(np.concatenate(b)))})
        del group, c, s, flat
        release()
        return found

    held = sets.join(small(blocks.drop("z")), "c").withColumn("task", F.pmod(F.xxhash64("key", "u", "m"), F.lit(tasks)))
    return held.groupBy("task").applyInArrow(run, "a binary, b binary")


def links(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root) for the linked ones among the classes (set, z, prints, best); rows: _k1, _k2, text."""
    beside = buckets_of(classes)
    some = beside.select(F.col("c").alias("set")).distinct().join(classes, "set").select(F.col("set").alias("c"), *(F.col(f"best.{k}").alias(k) for k in KEY), F.col("size").alias("_n"), (F.col("size") == 1).alias("one"))
    met = cut(shingle_sets(spread_join(rows, cut(some, "candidates"), KEY)), "sets")
    # Tasks that met rows of one id and text may each have given their class's set.
    sets = met.where("one").select("c", "s").unionByName(met.where("NOT one").groupBy("c").agg(F.first("s").alias("s")))
    # Each round compares a member once. What the rounds leave, or join little of, is compared within the buckets.
    pairs, roots = pairs_of(beside), None
    while True:
        first = cut(pairs.groupBy("c").agg(F.min(F.struct("wl", "least")).alias("l")).select("c", F.col("l.least").alias("least")), "first")
        new = cut(stars(first, sets), "near")
        edges = new if roots is None else new.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = cut(components(edges), "joined")
        if new.count() * JOINS <= first.count():
            break
        pairs = apart(pairs, first, roots)
    sweep(rows.sparkSession)
    more = compared(leftovers(beside, roots), sets)
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def decided(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_k1, _k2, stays, _n): what becomes of the rows of each id and text, if not that all of them stay.

    Of a component the rows with the least doc_id stay, ones without an id only if all of it have none;
    of several texts with that id, one. Keys that stay are there only if they have several rows.
    """
    rows = docs.select(*row_key(F.col(doc_id), F.col(text)), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = cut(sketches(rows), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", *KEY)).alias("best")
    classes = cut(known.groupBy("set").agg(F.first("z").alias("z"), F.first("prints").alias("prints"), F.count(F.lit(1)).alias("size"), first), "classes")
    roots = links(classes, rows.select(*KEY, "text"))
    roots = cut(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "set"), "roots")
    touched = cut(classes.join(small(roots), "set", "left").where("size > 1 OR root IS NOT NULL").select("set", F.coalesce("root", "set").alias("root"), "best", F.col("size").alias("_n")), "touched")
    stay = cut(touched.groupBy("root").agg(F.min("best").alias("b")).select(*(F.col(f"b.{k}").alias(k) for k in KEY), F.lit(True).alias("stays")), "stay")
    keys = spread_join(known.select("set", *KEY), touched.select("set", "_n"), ["set"], "left_semi").groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    marked = keys.join(small(stay), KEY, "left").withColumn("stays", F.coalesce("stays", F.lit(False)))
    return cut(marked.where("NOT stays OR _n > 1").select(*KEY, "stays", "_n"), "decided")


def order_of(docs: DataFrame, row: str) -> Column:
    """A hash of a row's columns, to choose by; maps have none."""
    return F.xxhash64(*(F.col(row)[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, all columns unchanged; see decided()."""
    marks = decided(docs, doc_id, text)
    row = "_row"
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias(row), *row_key(docs[doc_id], docs[text]))
    kept = spread_join(keyed, marks.select(*KEY, "_n"), KEY, "left_anti")
    twice = marks.where("stays").select(*KEY, "_n")
    if not twice.isEmpty():
        one = spread_join(keyed, twice, KEY, "left_semi").groupBy(*KEY).agg(F.min_by(row, order_of(docs, row)).alias(row))
        kept = kept.unionByName(one.select(row, *KEY))
    return kept.select(*(F.col(row)[c].alias(c) for c in docs.columns))
