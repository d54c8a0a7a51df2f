"""Exact histogram of encoded lengths, and what its suffix sums answer for every context limit.

Documents are counted by their number of tokens, so that one row stands for all documents of a
length. With ``docs_from`` and ``tokens_from`` (documents and tokens at this length or more) the
total kept under the limit L is ``tokens below L + L * docs_from``, for any L. The sums run in two
levels, over spans of lengths and then within each span: no task sees the whole histogram.

Null texts count as empty, with no tokens. An empty table gives an empty histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encode
from .common import cut

#: Lengths that share one span of the two-level sums.
SPAN = 1024


def lengths(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and n_tokens of every document, from the encoder's own output."""
    return encode(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), vocabulary, "text", keep=["doc_id"]).select("doc_id", "n_tokens")


def histogram(rows: DataFrame, n: str = "n_tokens") -> DataFrame:
    """One row for each length: docs, docs_from, tokens_from, docs_below, truncated_total, rank_from.

    truncated_total: tokens kept if every document is cut to this length. A null length is no row.
    """
    # Written, as the sums read it twice: the documents are encoded once.
    by = cut(rows.where(F.col(n).isNotNull()).groupBy(F.col(n).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("docs")), "lengths")
    by = by.withColumns({"_span": F.floor(F.col("n_tokens") / SPAN), "_tokens": F.col("n_tokens") * F.col("docs")})
    # Few rows: one for each span that holds a length.
    spans = by.groupBy("_span").agg(F.sum("docs").alias("_d"), F.sum("_tokens").alias("_t"))
    later = Window.orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    spans = spans.select("_span", F.coalesce(F.sum("_d").over(later), zero).alias("_d_after"), F.coalesce(F.sum("_t").over(later), zero).alias("_t_after"), F.sum("_d").over(total).alias("_docs"), F.sum("_t").over(total).alias("_all"))
    within = Window.partitionBy("_span").orderBy(F.desc("n_tokens"))
    out = by.join(spans, "_span").withColumns({"docs_from": F.sum("docs").over(within) + F.col("_d_after"), "tokens_from": F.sum("_tokens").over(within) + F.col("_t_after")})
    return out.select(
        "n_tokens", "docs", "docs_from", "tokens_from", (F.col("_docs") - F.col("docs_from")).alias("docs_below"),
        (F.col("_all") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
    )


def limits(hist: DataFrame, wanted: list[int]) -> DataFrame:
    """For each context limit: documents that fit, documents that are longer, tokens kept, tokens in all."""
    docs, size = F.col("docs"), F.col("n_tokens")
    sums = [F.struct(F.lit(k).cast("long").alias("context"), F.sum(F.when(size <= k, docs).otherwise(0)).alias("docs_within"), F.sum(F.when(size > k, docs).otherwise(0)).alias("docs_longer"), F.sum(docs * F.least(size, F.lit(k))).alias("tokens_kept"), F.sum(docs * size).alias("tokens")) for k in wanted]
    return hist.agg(F.array(*sums).alias("_a")).select(F.inline("_a"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """The least length that at least the share ``q`` of documents don't exceed; null for no documents."""
    through = F.col("docs_below") + F.col("docs")
    return hist.withColumn("_n", F.max(through).over(Window.partitionBy(F.lit(1)))).where(through >= F.ceil(F.lit(q) * F.col("_n"))).agg(F.min("n_tokens").alias("n_tokens"))
