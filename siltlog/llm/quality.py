"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

All measures are columns of whole texts; a rule is a measure, a divisor, and bounds. The one costly
measure, words in repeated five-word windows, is decided by 64-bit window hashes where all of them
differ (then no window repeats) and by the windows' words themselves otherwise.

A null text has no words and fails the base rule, as an empty one does; repeated rows get equal
results; an empty table gives an empty one. A text is measured whole, within its row: a very long one
costs memory in proportion to it. Columns of the input are carried as one struct, so that no name of
theirs meets one of the measures.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = {
    "en": "the of and to in is that for it as was with be by on not he this are or his from at which but have an had they you were a we".split(),
    "fr": "le la les de des du et à un une en que qui dans pour pas au sur par est il ne se ce plus son avec sont aux ou".split(),
    "de": "der die das und in zu den von mit ist des auf für nicht im dem ein eine sich als auch es an er so sie bei war".split(),
    "es": "el la los las de del y que en un una por con se no para su al es lo como más o pero sus le ya este".split(),
}
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Holds if ``low <= measure / per <= high``; ``per`` of None stands for 1. Compared without division.

    ``slack`` is added to the measure for the lower bound, which lets short texts off.
    """

    name: str
    measure: str
    per: str | None
    low: float | None = None
    high: float | None = None
    slack: float = 0.0

    def holds(self) -> Column:
        measure, per = F.col(self.measure), F.col(self.per) if self.per else F.lit(1)
        bounds = [measure + F.lit(self.slack) >= F.lit(self.low) * per] if self.low is not None else []
        bounds += [measure <= F.lit(self.high) * per] if self.high is not None else []
        return reduce(Column.__and__, bounds)


#: The base of the contract.
BASE = [Rule("enough words", "n_words", None, low=10), Rule("few repeated windows", "n_repeat_words", "n_words", high=0.2)]
#: The method's own thresholds, for what passes the base.
RULES = [
    Rule("word length", "word_chars", "n_words", low=2.0, high=14.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop words", "n_stop_words", "n_words", low=0.03, slack=0.75),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=0.4),
]


MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words"]


def measured(docs: DataFrame, text: str, rules: list[Rule] | None) -> DataFrame:
    """(row, the measures, base_failed, kept): each row of ``docs`` as one struct beside what is found of it."""
    stop = sorted({w for some in STOP_WORDS.values() for w in some})
    df = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs[text], F.lit("")).alias("__t"))
    t = F.col("__t")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"__w": words(t), "__l": lines, "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long")})
    w, n, one = F.col("__w"), F.size("__w"), F.col("__l")
    at = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    df = df.withColumns({
        "n_words": n.cast("long"), "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
        "n_lines": F.size(one).cast("long"), "n_dup_lines": (F.size(one) - F.size(F.array_distinct(one))).cast("long"),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(stop))).cast("long"),
        "__h": F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))),
    })
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    grams = F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.slice(w, i + 1, F.lit(WINDOW))).alias("g"), i.alias("i")))
    none = F.array().cast("array<struct<g:string,i:int>>")
    df = df.withColumn("__g", F.when(repeats, F.sort_array(grams)).otherwise(none))
    g = F.col("__g")
    same = lambda x, k: F.coalesce(F.get(g, k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(g, k + 1)["g"] == x["g"], F.lit(False))
    df = df.withColumn("__s", F.sort_array(F.transform(F.filter(g, same), lambda x: x["i"])))
    s = F.col("__s")
    steps = F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1), x + WINDOW) - x))
    df = df.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x))
    base = reduce(Column.__and__, [r.holds() for r in BASE])
    own = reduce(Column.__and__, [r.holds() for r in (RULES if rules is None else rules)], F.lit(True))
    return df.select("row", *MEASURES, (~base).alias("base_failed"), (base & own).alias("kept"))


def judge(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with the measures, base_failed, and kept: false if a base rule or one of ``rules`` fails.

    Columns of ``docs`` that have the name of a result give way to it; all others stay as they are.
    """
    results = [*MEASURES, "base_failed", "kept"]
    taken = {c.lower() for c in results}
    return measured(docs, text, rules).select(*(F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in taken), *results)


def passing(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, with all of its columns and no others.

    The verdict is joined with something that Spark takes for nondeterministic. A plain filter would be
    pushed below the projections, and would split the text anew for every element of its arrays.
    """
    opaque = F.col("kept") & (F.spark_partition_id() >= 0)
    df = measured(docs, text, rules).select("row", opaque.alias("kept")).where("kept")
    return df.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def oracle(rules: list[Rule] | None = None) -> str:
    """DuckDB SQL for doc_id, the base measures and verdicts of the table ``documents``."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for some in STOP_WORDS.values() for w in some}))

    def sql(r: Rule) -> str:
        per = r.per or "1"
        return " AND ".join([f"{r.measure} + {r.slack}::DOUBLE >= {r.low}::DOUBLE * {per}"] * (r.low is not None) + [f"{r.measure} <= {r.high}::DOUBLE * {per}"] * (r.high is not None))

    base, own = (" AND ".join(sql(r) for r in some) for some in (BASE, RULES if rules is None else rules))
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
      FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
f AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt, i + {WINDOW}) - i))::BIGINT AS n
      FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM f) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             len(list_filter(w, lambda x: list_contains([{stop}], x)))::BIGINT AS n_stop_words,
             coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r ON w.rid = r.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, NOT ({base}) AS base_failed, ({base}) AND ({own}) AS kept FROM m"""
