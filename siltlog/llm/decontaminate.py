"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Short test items are sought inside documents of any length. An item of n distinct shingles counts
as contained at ``threshold`` t if a document holds at least ceil(t n) of them. Items are
partitioned by size. A partition keeps of each item its k least shingle hashes, where k comes from
the partition's largest size so that no document that holds t of the shingles can miss all k: the
search loses nothing, however long a document is. (A Jaccard estimate between a short item and a
long document would.) That holds for any k shingles: those that more than COMMON items have come
last, so that a phrase of many items doesn't make each of them a candidate. A candidate is a document
with one item; the shingles that the two share are counted exactly.

Words are split at ASCII white space, without case; a shingle is five words, and a text of fewer
words, but one at least, has its whole sequence as its shingle: an item of one to four words is found
only where it is the whole document. Null and blank texts match nothing. Repeated items and rows are
matched alike and come out once for each id; null ids are kept as such. Documents are read whole, of
any length; other columns than id and text aren't looked at. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, small, spread_join, words

SHINGLE, THRESHOLD = 5, 0.8
#: Items that may share a shingle before it is taken last.
COMMON = 8


def with_shingles(df: DataFrame, text: str, hashes: str | None, strings: str | None) -> DataFrame:
    df = df.withColumn("__w", words(F.lower(F.coalesce(F.col(text), F.lit("")))))
    w, n = F.col("__w"), F.size("__w")
    at = F.when(n >= SHINGLE, F.sequence(F.lit(0), n - SHINGLE)).otherwise(F.array().cast("array<int>"))
    whole = F.array_join(w, " ")
    short = (n > 0) & (n < SHINGLE)
    out = {}
    if hashes:
        many = F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))
        out[hashes] = F.when(short, F.array(F.xxhash64(whole))).otherwise(many)
    if strings:
        many = F.transform(at, lambda i: F.concat_ws(" ", F.slice(w, i + 1, F.lit(SHINGLE))))
        out[strings] = F.when(short, F.array(whole)).otherwise(many)
    return df.withColumns(out).drop("__w")


def minima(items: DataFrame, threshold: float) -> DataFrame:
    """(_i, hash): for each item (_i, _h) its k least shingle hashes, k by size partition, common ones last."""
    each = items.select("_i", F.size("_h").alias("n"), F.explode("_h").alias("hash"))
    common = small(cut(each.groupBy("hash").count().where(F.col("count") > COMMON).select("hash", F.lit(True).alias("many")), "common"))
    top = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1  # the largest size in the item's partition
    k = F.least((top - F.ceil(top * threshold) + 1).cast("int"), F.col("n"))
    ranked = each.join(common, "hash", "left").groupBy("_i", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("many", F.lit(False)).alias("many"), "hash"))).alias("_r"))
    return ranked.select("_i", F.explode(F.slice("_r", F.lit(1), k)).alias("_m")).select("_i", "_m.hash")


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) for all contained items.

    docs: doc_id (of any type), text; items: item_id, text.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    known = with_shingles(items.select("item_id", "text").distinct(), "text", "_h", "_s").withColumns({"_h": F.array_distinct("_h"), "_s": F.array_distinct("_s")})
    known = cut(known.select(F.monotonically_increasing_id().alias("_i"), "item_id", "_h", "_s", F.size("_s").cast("long").alias("n")).where("n > 0"), "items")
    least = small(cut(minima(known.select("_i", "_h"), threshold), "minima"))
    rows = docs.select(F.col("doc_id").alias("_d"), *row_key(F.col("doc_id"), F.col("text")), "text")
    # explode_outer: explode would put a filter on the array below, which computes it anew.
    hashed = with_shingles(rows, "text", "_h", None).select("_k1", "_k2", F.explode_outer("_h").alias("hash"))
    near = cut(hashed.join(least, "hash").groupBy("_k1", "_k2", "_i").agg(F.count(F.lit(1)).alias("_n")), "candidates")
    pairs = spread_join(rows, near, ["_k1", "_k2"]).join(small(known.select("_i", "item_id", F.col("_s").alias("_wanted"), "n")), "_i")
    shared = F.size(F.array_intersect("_wanted", "_s")).cast("long")
    found = with_shingles(pairs, "text", None, "_s").select("_d", "item_id", "n", shared.alias("shared"))
    best = found.groupBy("_d", "item_id").agg(F.max(F.struct((F.col("shared") / F.col("n")).alias("c"), "n", "shared")).alias("b"))
    held = best.where(F.col("b.shared") >= F.ceil(F.col("b.n") * threshold - 1e-9))
    return held.select(F.col("_d").alias("doc_id"), "item_id", F.col("b.n").alias("item_shingles"), F.col("b.shared").alias("shared"), F.col("b.c").alias("containment"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns unchanged: each is judged by its own text."""
    own = row_key(F.lit(None).cast("long"), docs[text])
    found = search(docs.select(F.struct(*own).alias("doc_id"), docs[text].alias("text")), items, threshold)
    bad = cut(found.select("doc_id._k1", "doc_id._k2").groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_n")), "contaminated")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), *own)
    return spread_join(rows, bad, ["_k1", "_k2"], "left_anti").select(*(F.col("_row")[c].alias(c) for c in docs.columns))


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for search() over ``documents`` and ``benchmark``."""
    grams = rf"""SELECT id, rid, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM (
      SELECT id, rid, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, least(len(w), 1) + 1))) AS i FROM (
        SELECT {{id}} AS id, row_number() OVER () AS rid, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM {{t}}))"""
    return f"""
WITH d AS (SELECT DISTINCT * FROM ({grams.format(id="doc_id", t="documents")})),
b AS (SELECT DISTINCT * FROM ({grams.format(id="item_id", t="benchmark")})),
n AS (SELECT rid, count(*) AS n FROM b GROUP BY rid),
p AS (SELECT d.id AS doc_id, b.id AS item_id, d.rid AS r, b.rid AS q, count(*) AS shared FROM d JOIN b ON d.s = b.s GROUP BY ALL),
k AS (SELECT doc_id, item_id, n, shared, shared / n AS c, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / n DESC, n DESC) AS o
      FROM p JOIN n ON p.q = n.rid WHERE shared >= ceil(n * {threshold}::DOUBLE - 1e-9))
SELECT doc_id, item_id, n::BIGINT AS item_shingles, shared::BIGINT AS shared, c::DOUBLE AS containment FROM k WHERE o = 1"""
