"""Secret scans through a trigram inverted index.

Each rule is a regular expression, a kind and a condition on its matches. From the parsed
expression a Boolean query over trigrams is derived, with AND and OR, which every text that
matches must satisfy; letters count without case. A block of texts is indexed by postings (which
texts hold a trigram) for the trigrams that some rule asks for, the queries are answered by
intersecting and uniting postings, and only the candidates are searched. A rule without mandatory
trigrams searches every text.

Null texts count as empty and hold no secrets. Offsets are code points, the end exclusive. Every rule
takes time in proportion to the text, so that very long texts are searched whole. Rows are
independent: repeated rows give repeated results, an empty table an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices


@dataclass(frozen=True)
class Rule:
    """A kind of secret; a match counts if its ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# The contract's three kinds, then token formats that their issuers publish.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    # Through the END line; without one, through the headers and the base64 body with its short last line.
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----|(?:\s+[A-Za-z-]+:[^\r\n]*)*(?:\s+[A-Za-z0-9+/=]{40,})+(?:\s+[A-Za-z0-9+/=]+)?)?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    # Only where a run of such characters begins, and schemes of bounded length: else a long run costs its square.
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i:bearer)\x20+([A-Za-z0-9+/_.=~-]{20,})", 1, 20),
    Rule("url_login", r"[a-z][a-z0-9+]{0,31}://[^\s:/@]+:[^\s:/@]+@"),
)

#: A query is True (all texts), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple
#: Alternatives that are followed literally before they are given up.
SPELLED = 32


def both(a: Query, b: Query) -> Query:
    return b if a is True else a if b is True or a == b else ("and", frozenset([a, b]))


def either(a: Query, b: Query) -> Query:
    return True if a is True or b is True else a if a == b else ("or", frozenset([a, b]))


def spelled(words: set[str]) -> Query:
    """What holds for a text with one of the words: all trigrams of that word."""
    out: Query | None = None
    for w in sorted(words):
        q: Query = True
        for i in range(len(w) - 2):
            q = both(q, w[i : i + 3])
        out = q if out is None else either(out, q)
    return True if out is None else out


def study(nodes) -> tuple[set[str] | None, Query]:
    """The exact lower-case words that a sequence can match (None: open or too many), and its trigram query."""
    run: set[str] = {""}
    query: Query = True
    whole = True
    for op, arg in nodes:
        own, q = study_one(op, arg)
        query = both(query, q)
        if own is not None and len(run) * len(own) <= SPELLED:
            run = {a + b for a in run for b in own}
        else:
            query, whole = both(query, spelled(run)), False
            run = {""} if own is None else own
    return (run if whole else None), both(query, spelled(run))


def study_one(op, arg) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL and arg < 128:
        return {chr(arg).lower()}, True
    if op is C.IN and all(k is C.LITERAL and v < 128 for k, v in arg):
        return {chr(v).lower() for _, v in arg}, True
    if op is C.SUBPATTERN:
        return study(arg[3])
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {""}, True
    if op is C.BRANCH:
        parts = [study(x) for x in arg[1]]
        query = parts[0][1]
        for _, q in parts[1:]:
            query = either(query, q)
        return (set().union(*(own for own, _ in parts)) if all(own is not None for own, _ in parts) else None), query
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = arg
        own, query = study(inner)
        if low == 0:
            return ({""} | own if own is not None and high == 1 else None), True
        if own is not None and low == high and len(own) ** low <= SPELLED:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in own}
            return out, query
        return None, query
    return None, True


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regular expression; True if no trigram is mandatory."""
    return study(parser.parse(pattern, re.A))[1]


def trigrams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


class Index:
    """Postings of a block of texts for the given trigrams."""

    def __init__(self, wanted: list[str]):
        self.row = {t: i + 1 for i, t in enumerate(wanted)}
        self.lookup = np.zeros(1 << 24, np.uint8 if len(wanted) < 255 else np.uint16)
        for t, i in self.row.items():
            a, b, c = t.encode()
            self.lookup[a << 16 | b << 8 | c] = i
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def load(self, texts: list[bytes]) -> None:
        flat = self.lower[np.frombuffer(b"\0\0\0".join([*texts, b""]) + b"\0\0\0", np.uint8)].astype(np.uint32)
        found = self.lookup[flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]]
        at = np.flatnonzero(found)
        starts = np.cumsum([0, *(len(t) + 3 for t in texts)])
        self.postings = np.zeros((len(self.row) + 1, len(texts)), bool)
        self.postings[found[at], np.searchsorted(starts, at, "right") - 1] = True
        self.everything = np.ones(len(texts), bool)

    def answer(self, query: Query) -> np.ndarray:
        """Which texts satisfy the query."""
        if query is True:
            return self.everything
        if isinstance(query, str):
            return self.postings[self.row[query]]
        parts = [self.answer(q) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> tuple[list[tuple[Rule, re.Pattern, Query]], Index]:
    ready = [(r, re.compile(r.pattern, re.A), trigram_query(r.pattern)) for r in rules]
    return ready, Index(sorted(set().union(*(trigrams(q) for _, _, q in ready))))


def find(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[str, int, int]]]:
    """The spans (kind, start, end) of each text, by start, then in the order of the rules."""
    ready, index = scanner(rules)
    texts = [t or "" for t in texts]
    index.load([t.encode("utf-8", "surrogatepass") for t in texts])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, pattern, query) in enumerate(ready):
        for i in np.flatnonzero(index.answer(query)).tolist():
            for m in pattern.finditer(texts[i]):
                a, b = m.span(rule.group)
                if b - a >= rule.least:
                    out[i].append((m.start(), k, m.end()))
    return [[(rules[k].kind, a, b) for a, k, b in sorted(spans)] for spans in out]


def redacted(text: str | None, spans: list[tuple[str, int, int]], mark: str) -> str | None:
    """The text with each run of overlapping spans replaced by the mark."""
    if not spans:
        return text
    out, end = [], 0
    for _, a, b in spans:
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join([*out, text[end:]])


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, redact: str | None = None, spans: str = "spans") -> DataFrame:
    """``docs`` with the secrets found in ``text`` as an array of (kind, start, end).

    With ``redact``, the text is returned with that mark in their place; a null text stays null. A
    column of ``docs`` that is called as ``spans`` says gives way; all others stay as they are.
    """
    kept = [c for c in docs.columns if c != spans]
    src = docs.select(*kept)
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*src.schema.fields, T.StructField(spans, T.ArrayType(item))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = batch.column(text).to_pylist()
            found = find(texts, rules)
            cols = dict(zip(kept, (batch.column(c) for c in kept)))
            if redact is not None:
                cols[text] = pa.array([redacted(t, s, redact) for t, s in zip(texts, found)], pa.string())
            cols[spans] = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], arrow)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return src.mapInArrow(run, schema)
