"""The operators' queries: thin calls over whole tables that derive the digest columns of their contracts."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, quality, secrets, shards, simhash, substrings, token_counts, toxicity, url_filters
from .common import table


def vocabulary() -> str:
    """The byte-level vocabulary file; SILTLOG_VOCABULARY overrides the installed one."""
    if path := os.environ.get("SILTLOG_VOCABULARY"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.deduplicate(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = bpe.encode(docs, vocabulary(), keep=["doc_id"], with_decoded="decoded")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(token_counts.lengths(table(spark, sf_dir, "documents"), vocabulary()))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 2, F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = [r.kind for r in secrets.RULES if r.base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, base), F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each url and the rule that fits, without the method's verdict."""
    return url_filters.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_substrings": op2_substrings,
    "op3_bpe": op3_bpe,
    "op4_quality": op4_quality,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_shards": op7_shards,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_secrets": op10_secrets,
    "url_rules": url_rules,
    "secret_counts": secret_counts,
}

ORACLES: dict[str, str] = {
    "op4_quality": quality.oracle(),
    "op6_decontamination": decontaminate.oracle(),
    "url_rules": r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule) AS (VALUES ('com/'), ('example.com/en/'), ('www.example.com/en/'), ('net/es/'), ('net/fr/')),
f AS (SELECT page_id, host, path, rule FROM p, r WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))),
b AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule FROM f GROUP BY ALL)
SELECT p.page_id, p.host, p.path, b.rule FROM p LEFT JOIN b ON p.page_id = b.page_id AND p.host = b.host AND p.path = b.path""",
    "secret_counts": r"""
SELECT doc_id,
       len(list_filter(regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6))::BIGINT AS n_assign,
       len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::BIGINT AS n_access,
       len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24))::BIGINT AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
}
