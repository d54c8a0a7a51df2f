"""A training corpus from ``documents``: rules, near duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver of a run writes it as
Parquet and hands the reread rows to the next stage. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm import bpe, decontaminate, near_copies, quality, secrets
from siltlog.llm.common import cut, drop, fresh, made, table
from siltlog.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the method's rules; a null text fails."""
    return quality.passing(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: that with the least id, a null id being the last.

    Rows of null and of repeated ids are told apart by their texts; of rows alike in both one stays.
    Near copies have a Jaccard similarity of 0.8 or more on five-word shingles; candidates come from
    many SimHash fingerprints a text and their index in Gray order, each decided on the sets (README).
    """
    return near_copies.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item: each by its own text, whatever others share its id."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and n_chars set anew where one was found."""
    spans = fresh("spans", docs.columns)
    found = secrets.scan(docs, redact="[secret]", spans=spans)
    n = F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit), their count, and whether they decode to the text."""
    coded = bpe.encode(docs, vocabulary(), keep=["doc_id", "lang", "source", "text"], with_decoded="decoded")
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("secret scans", redact_secrets),
    ("bpe", encode_texts),
]

#: SQL can express neither the trained vocabulary's merges nor the component search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. Once a stage is written, its predecessor's rows and its own scratch tables go."""
    docs, old = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with made() as paths:
            docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(spark, [*old, *paths[:-1]])
        old = paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
