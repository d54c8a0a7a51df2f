"""Substring deduplication over word windows, with a count-min prefilter.

A window is WINDOW consecutive words of one document. Every word covered by a window whose word
sequence also starts earlier (in a smaller doc_id, or earlier in the document) is removed; windows
are judged on the input.

1. A window is counted by its anchor, the run of GRAM words in it whose hash is least, the leftmost of
   equals: equal windows have equal anchors at the same place, and about six neighbours share one. Each
   task counts the anchors of a chunk of texts in a sketch, as sorted cells by block of the sketch.
   Blocks are merged by cell, saturating at two, and answer each chunk which of its anchors lie in
   cells that were hit twice; anchors that repeat within a chunk are known there. Cells overestimate
   only, so a window that starts twice has its anchor marked.
2. A second pass over the documents with marks keeps the windows of marked anchors, and of equal windows
   of a task only the first (the later ones are decided), and deals them out by hash. There equal windows,
   by 96 of 128 hash bits, are grouped exactly and all but the earliest are reported to their documents.
3. Each document drops the words that its reported windows cover.

The sketch has one row of cells, 36 to 72 for each anchor: that lets 1 to 3 % of single windows through,
and a second row would cost more bytes than those do. It grows with the texts, is merged where
its blocks lie, and is never sent whole anywhere. All tables between the passes have at most a row for
each window, and grow as the input does. A key that is everywhere costs one entry for each chunk.
Marks and spans meet their texts by broadcast while they are small, else by one shuffle of the texts each.

A null text has no words; texts of under WINDOW words keep them all. A null doc_id comes before all
others. Rows of one doc_id but different texts are judged as documents in the order of a hash of
their texts; fully repeated rows count as one and give equal results. A very long text is read whole, in
memory in proportion to it. Empty tables give empty ones. Columns other than id and text aren't looked at.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from .common import cut, slices, spread_join

WINDOW, GRAM = 20, 10
#: Binary logarithm of the cells in a block.
BLOCK = 22
#: Anchors of a chunk, windows that a task holds before it gives them out, windows for each bucket of the exact pass.
CHUNK, HELD, BUCKET = 300_000, 1 << 20, 1 << 20
NULL_ID = -(1 << 63)
#: Entries at which the word cache is emptied.
WORDS = 200_000
MASK = (1 << 64) - 1
#: Factors of the two polynomials.
FIRST, SECOND = 0x2545F4914F6CDD1D, 0xD1342543DE82EF95


class Words(dict):
    """Words to numbers from 0; ``first`` and ``second`` hold two 64-bit hashes of each."""

    def __init__(self):
        self.first, self.second = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        h = xxh3_128_intdigest(word)
        self.first.append(h & MASK)
        self.second.append(h >> 64)
        n = self[word] = len(self)
        return n


def rolled(h: np.ndarray, factor: int, width: int) -> np.ndarray:
    """The hash of each run of ``width`` numbers: a polynomial modulo 2**64, then mixed."""
    power = lambda k: np.uint64(pow(factor, k, 1 << 64))
    runs = {1: h}
    size = 1
    while 2 * size <= width:
        low = runs[size]
        runs[2 * size] = low[:-size] * power(size) + low[size:]
        size *= 2
    out, done = runs[size], size
    while done < width:
        size = max(k for k in runs if k <= width - done)
        n = len(h) - done - size + 1
        out, done = out[:n] * power(size) + runs[size][done : done + n], done + size
    out = out ^ (out >> np.uint64(31))
    out = out * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of the least, the leftmost of equals."""
    value, at, size = h, np.arange(len(h)), 1
    while size < width:
        step = min(size, width - size)
        n = len(value) - step
        later = value[step:] < value[:n]
        value, at, size = np.where(later, value[step:], value[:n]), np.where(later, at[step:], at[:n]), size + step
    return at


class Hasher:
    def __init__(self):
        self.words = Words()

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Of the texts' words end to end: two hashes of each, its text, its place there, and the window starts."""
        if len(self.words) > WORDS:
            self.words = Words()
        known = self.words
        split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        split = [w if len(w) >= WINDOW else [] for w in split]
        sizes = np.array([len(w) for w in split], np.int64)
        total = int(sizes.sum())
        if not total:
            none = np.zeros(0, np.uint64)
            return none, none, none.astype(np.uint32), none.astype(np.uint32), none.astype(np.int64)
        ids = np.concatenate([np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in split if w])
        first, second = (np.array(x, np.uint64)[ids] for x in (known.first, known.second))
        text = np.repeat(np.arange(len(texts), dtype=np.uint32), sizes)
        start = (np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint32)
        return first, second, text, start, np.flatnonzero(start + WINDOW <= np.repeat(sizes, sizes))

    def anchors(self, read: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The anchors' hashes and texts, and the anchor of each window."""
        first, _, text, _, ok = read
        if not len(ok):
            return first[:0], text[:0], ok
        gram = rolled(first, FIRST, GRAM)
        at = least_of(gram, WINDOW - GRAM + 1)[ok]
        new = np.concatenate([[True], at[1:] != at[:-1]])
        # Least hashes crowd at the low end: they are mixed anew to fall evenly on the cells.
        mixed = (gram[at[new]] ^ gram[at[new]] >> np.uint64(32)) * np.uint64(SECOND)
        return mixed ^ mixed >> np.uint64(29), text[at[new]], np.cumsum(new) - 1

    def windows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes, text number and start of every window of the texts."""
        read = self.read(texts)
        return self.hashes(read, read[4])

    def hashes(self, read: tuple[np.ndarray, ...], some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        first, second, text, start, _ = read
        if not len(some):
            return first[:0], second[:0], text[:0], start[:0]
        return rolled(first, FIRST, WINDOW)[some], rolled(second, SECOND, WINDOW)[some], text[some], start[some]


def packed(cells: np.ndarray) -> bytes:
    """Ascending cells of a block as gaps: all low bytes, then all high bytes; four bytes each if some gap is wider."""
    gaps = np.diff(cells, prepend=np.uint32(0))
    if len(gaps) and gaps.max() > 0xFFFF:
        return b"\1" + gaps.astype("<u4").tobytes()
    return b"\0" + (gaps & np.uint32(255)).astype(np.uint8).tobytes() + (gaps >> np.uint32(8)).astype(np.uint8).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if data[0]:
        return np.cumsum(np.frombuffer(data, "<u4", offset=1), dtype=np.int64)
    planes = np.frombuffer(data, np.uint8, offset=1).astype(np.int64)
    n = len(planes) // 2
    return np.cumsum(planes[:n] | planes[n:] << 8)


def places(numbers: np.ndarray) -> bytes:
    """Places in a chunk, in three bytes each after a zero; in four after a one if some doesn't fit."""
    flat = numbers.astype("<u4")
    if len(flat) and flat.max() >> 24:
        return b"\1" + flat.tobytes()
    return b"\0" + np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def placed(data: bytes) -> np.ndarray:
    if data[0]:
        return np.frombuffer(data, "<u4", offset=1)
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, 3)
    return out.view("<u4").reshape(-1)


PARTS = "chunk long, block int, cells binary, twice binary, at binary, ids binary, texts binary, counts binary"


def partition_sketch(chunk: int, hashes: np.ndarray, ids: np.ndarray, texts: np.ndarray, counts: np.ndarray, bits: int) -> list[dict]:
    """A chunk's cells by block, and, as block -1, its documents with the anchors that are known to repeat.

    For each distinct cell: whether it was hit twice in the chunk, and the first anchor that hit it.
    """
    cells = hashes >> np.uint64(64 - bits)
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    new = np.concatenate([[True], cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    twice = np.diff(np.concatenate([at, [len(cells)]])) > 1
    known = np.zeros(len(cells), bool)
    known[order] = twice[np.cumsum(new) - 1] if len(cells) else False
    none = {"cells": None, "twice": None, "at": None, "ids": None, "texts": None, "counts": None}
    out = [none | {"chunk": chunk, "block": -1, "twice": np.packbits(known).tobytes(), "ids": ids.tobytes(), "texts": texts.tobytes(), "counts": counts.astype("<u4").tobytes()}]
    cells, first = cells[at], order[at]
    block = cells >> np.uint64(BLOCK)
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(cells)]
    low = (cells & np.uint64((1 << BLOCK) - 1)).astype(np.uint32)
    for a, b in zip(edges, edges[1:]):
        if b > a:
            out.append(none | {"chunk": chunk, "block": int(block[a]), "cells": packed(low[a:b]), "twice": np.packbits(twice[a:b]).tobytes(), "at": places(first[a:b])})
    return out


def sketches(rows: DataFrame, bits: int) -> DataFrame:
    """The partition sketches of all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("block", pa.int32()), *((c, pa.binary()) for c in ("cells", "twice", "at", "ids", "texts", "counts"))])
        hasher, chunk = Hasher(), TaskContext.get().partitionId() << 32
        held, n = [], 0

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(partition_sketch(chunk, *map(np.concatenate, zip(*held)), bits), schema=schema)

        for batch in slices(batches):
            hashes, text, _ = hasher.anchors(hasher.read(batch.column("text").to_pylist()))
            if n and n + len(hashes) > CHUNK:
                yield give()
                held, n, chunk = [], 0, chunk + 1
            if len(hashes):
                held.append((hashes, *(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_d", "_t")), np.bincount(text, minlength=batch.num_rows)))
                n += len(hashes)
        if n:
            yield give()

    return rows.select("_d", "_t", "text").mapInArrow(run, PARTS)


def merged(group: pa.Table, bits: int) -> pa.Table:
    """(chunk, at): the anchors of each chunk whose cell in this block was hit by another chunk too."""
    count = np.zeros(1 << min(bits, BLOCK), np.uint8)
    parts = [(chunk, unpacked(cells), np.unpackbits(np.frombuffer(twice, np.uint8)).astype(np.uint8)) for chunk, cells, twice in zip(*(group.column(c).to_pylist() for c in ("chunk", "cells", "twice")))]
    for _, cells, twice in parts:
        count[cells] = np.minimum(count[cells] + 1 + twice[: len(cells)], 2)
    found = {"chunk": [], "at": []}
    for (chunk, cells, twice), at in zip(parts, group.column("at").to_pylist()):
        hit = (count[cells] > 1) & (twice[: len(cells)] == 0)
        if hit.any():
            found["chunk"].append(chunk)
            found["at"].append(places(placed(at)[hit]))
    return pa.table(found, schema=pa.schema([("chunk", pa.int64()), ("at", pa.binary())]))


def marked(group: pa.Table) -> pa.Table:
    """(_d, _t, marks, n): for each document of a chunk a bit for each of its anchors, and the anchors marked."""
    out = {"_d": [], "_t": [], "marks": [], "n": []}
    for known, ids, texts, counts in zip(*(group.column(c).to_pylist() for c in ("twice", "ids", "texts", "counts"))):
        if ids is None:
            continue
        counts = np.frombuffer(counts, "<u4").astype(np.int64)
        flags = np.unpackbits(np.frombuffer(known, np.uint8))[: counts.sum()]
        for at in group.column("at").to_pylist():
            if at:
                flags[placed(at)] = 1
        ends = np.cumsum(counts)
        many = np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[np.concatenate([[0], ends])])
        for i in np.flatnonzero(many).tolist():
            out["marks"].append(np.packbits(flags[ends[i] - counts[i] : ends[i]]).tobytes())
        out["n"].append(many[many > 0])
        for name, value in (("_d", ids), ("_t", texts)):
            out[name].append(np.frombuffer(value, np.int64)[many > 0])
    none = [np.zeros(0, np.int64)]
    return pa.table({"_d": np.concatenate(none + out["_d"]), "_t": np.concatenate(none + out["_t"]), "marks": pa.array(out["marks"], pa.binary()), "n": np.concatenate(none + out["n"])})


def estimated(rows: DataFrame, bits: int) -> DataFrame:
    """(_d, _t, marks, n, _n): the documents whose anchors the merged sketch estimates repeated, and their rows."""
    parts = cut(sketches(rows, bits), "sketches")
    replies = parts.where("block >= 0").groupBy("block").applyInArrow(lambda g: merged(g, bits), "chunk long, at binary")
    none = F.lit(None).cast("binary")
    docs = parts.where("block < 0").select("chunk", none.alias("at"), "twice", "ids", "texts", "counts")
    both = docs.unionByName(replies.select("chunk", "at", *(none.alias(c) for c in ("twice", "ids", "texts", "counts"))))
    found = both.groupBy("chunk").applyInArrow(marked, "_d long, _t long, marks binary, n long")
    # Rows of equal id and text have equal marks: all of them.
    return cut(found.groupBy("_d", "_t").agg(F.max("marks").alias("marks"), F.max("n").alias("n"), F.count(F.lit(1)).alias("_n")), "marks")


SCHEMA = "bucket int, a binary, b binary, doc binary, start binary, ids binary, texts binary"


def ordered_windows(a, b, d, t, s) -> tuple[np.ndarray, np.ndarray]:
    """The order by hash, then document and start; and, in it, whether an earlier equal window exists."""
    order = np.lexsort((s, t, d, b, a))
    a, b, d, t, s = a[order], b[order], d[order], t[order], s[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    head = np.repeat(first, np.diff(np.concatenate([first, [len(a)]])))
    return order, (d != d[head]) | (t != t[head]) | (s != s[head])


def dealt(a, b, doc, start, ids, texts, buckets: int) -> Iterator[dict]:
    """Windows of one task by bucket: those to be grouped, and those already decided (with no hashes)."""
    order, later = ordered_windows(a, b, ids[doc], texts[doc], start)
    for keep, known in ((order[~later], False), (order[later], True)):
        to = ((ids[doc[keep]].view(np.uint64) if known else a[keep]) % np.uint64(buckets)).astype(np.int64)
        keep = keep[np.lexsort((start[keep], doc[keep], to))]
        ends = np.cumsum(np.bincount(to, minlength=buckets))
        for k in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
            some = keep[(ends[k - 1] if k else 0) : ends[k]]
            used, at = np.unique(doc[some], return_inverse=True)
            yield {"bucket": k, "a": None if known else a[some].tobytes(), "b": None if known else b[some].tobytes(), "doc": at.astype(np.uint32).tobytes(), "start": np.diff(start[some], prepend=np.uint32(0)).tobytes(), "ids": ids[used].tobytes(), "texts": texts[used].tobytes()}


def candidates(rows: DataFrame, marks: DataFrame, buckets: int) -> DataFrame:
    """The windows of marked anchors, by bucket of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("a", "b", "doc", "start", "ids", "texts"))])
        held, ids, texts, n, docs = [], [], [], 0, 0

        def give() -> pa.RecordBatch:
            a, b, doc, start = map(np.concatenate, zip(*held))
            return pa.RecordBatch.from_pylist(list(dealt(a, b, doc, start, np.concatenate(ids), np.concatenate(texts), buckets)), schema=schema)

        for batch in slices(batches):
            read = hasher.read(batch.column("text").to_pylist())
            hashes, text, of = hasher.anchors(read)
            counts = np.bincount(text, minlength=batch.num_rows)
            bit = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(m, np.uint8))[:k] for m, k in zip(batch.column("marks").to_pylist(), counts.tolist()))])
            a, b, doc, start = hasher.hashes(read, read[4][bit[of] > 0] if len(of) else read[4])
            held.append((a, (b & np.uint64(0xFFFFFFFF)).astype(np.uint32), doc + np.uint32(docs), start))
            ids.append(batch.column("_d").to_numpy(zero_copy_only=False).astype(np.int64))
            texts.append(batch.column("_t").to_numpy(zero_copy_only=False).astype(np.int64))
            n, docs = n + len(a), docs + batch.num_rows
            if n >= HELD:
                yield give()
                held, ids, texts, n, docs = [], [], [], 0, 0
        if n:
            yield give()

    return spread_join(rows.select("_d", "_t", "text"), marks.select("_d", "_t", "marks", "_n"), ["_d", "_t"]).select("_d", "_t", "text", "marks").mapInArrow(run, SCHEMA)


def decided(group: pa.Table, buckets: int) -> pa.Table:
    """The windows of a bucket that start earlier elsewhere, packed by the bucket of their document."""
    parts = {True: [], False: []}
    for a, b, doc, start, ids, texts in zip(*(group.column(c).to_pylist() for c in ("a", "b", "doc", "start", "ids", "texts"))):
        at = np.frombuffer(doc, np.uint32)
        d, t, s = np.frombuffer(ids, np.int64)[at], np.frombuffer(texts, np.int64)[at], np.cumsum(np.frombuffer(start, np.uint32), dtype=np.uint32)
        parts[a is None].append((d, t, s) if a is None else (np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32), d, t, s))
    found = list(parts[True])
    if parts[False]:
        a, b, d, t, s = map(np.concatenate, zip(*parts[False]))
        order, later = ordered_windows(a, b, d, t, s)
        some = order[later]
        found.append((d[some], t[some], s[some]))
    d, t, s, first, sizes = by_document(*map(np.concatenate, zip(*found)))
    # By id and text: rows without an id, or with one id, are spread like others.
    to = (((d[first].view(np.uint64) ^ t[first].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)
    rows = {"to": [], "ids": [], "texts": [], "sizes": [], "starts": []}
    for k in np.unique(to).tolist():
        some = np.flatnonzero(to == k)
        values = (k, d[first[some]].tobytes(), t[first[some]].tobytes(), sizes[some].astype(np.uint32).tobytes(), np.diff(s[np.repeat(to == k, sizes)], prepend=np.uint32(0)).astype("<u4").tobytes())
        for name, value in zip(rows, values):
            rows[name].append(value)
    return pa.table(rows, schema=pa.schema([("to", pa.int32()), *((c, pa.binary()) for c in ("ids", "texts", "sizes", "starts"))]))


def by_document(d: np.ndarray, t: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """The windows by document and start, with each document's first row and rows."""
    order = np.lexsort((s, t, d))
    d, t, s = d[order], t[order], s[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])) if len(d) else np.zeros(0, np.int64)
    return d, t, s, first, np.diff(np.concatenate([first, [len(d)]]))


def gathered(group: pa.Table) -> pa.Table:
    """(_d, _t, spans): for each document of a bucket that has windows to remove, their runs as first start and length."""
    found = []
    for ids, texts, sizes, starts in zip(*(group.column(c).to_pylist() for c in ("ids", "texts", "sizes", "starts"))):
        n = np.frombuffer(sizes, np.uint32)
        found.append((np.repeat(np.frombuffer(ids, np.int64), n), np.repeat(np.frombuffer(texts, np.int64), n), np.cumsum(np.frombuffer(starts, "<u4"), dtype=np.uint32)))
    d, t, s, first, sizes = by_document(*map(np.concatenate, zip(*found)))
    spans = []
    for x, n in zip(first.tolist(), sizes.tolist()):
        own = s[x : x + n]
        at = np.flatnonzero(np.concatenate([[True], own[1:] > own[:-1] + 1]))
        last = own[np.concatenate([at[1:], [n]]) - 1]
        spans.append(np.stack([own[at], last - own[at] + 1], 1).astype("<u4").tobytes())
    return pa.table({"_d": pa.array(d[first], pa.int64()), "_t": pa.array(t[first], pa.int64()), "spans": pa.array(spans, pa.binary())})


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts, gone, kept = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            counts.append(len(words))
            if spans:
                stay = np.ones(len(words), bool)
                for a, n in np.frombuffer(spans, "<u4").reshape(-1, 2).tolist():
                    stay[a : a + n + WINDOW - 1] = False
                words = list(compress(words, stay.tolist()))
            gone.append(counts[-1] - len(words))
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def keyed(doc_id: Column, text: Column) -> dict[str, Column]:
    """_d and _t order the documents and tell them apart: a text's hash without its sign, negative where the id is null."""
    hashed = F.shiftrightunsigned(F.xxhash64(text), 1)
    return {"_d": F.coalesce(doc_id, F.lit(NULL_ID)), "_t": F.when(doc_id.isNull(), -1 - hashed).otherwise(hashed)}


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cells: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by spaces) for every row.

    ``cells``: binary logarithm of the cells of the sketch; by default from the size of the texts.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumns(keyed(F.col("doc_id"), F.col("text")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    marks = estimated(rows, cells or max(16, int(size).bit_length()))
    buckets = max(1, (marks.agg(F.sum(F.col("n") * (WINDOW - GRAM + 2) / 2)).first()[0] or 0) // BUCKET)
    buckets = int(buckets)
    found = candidates(rows, marks, buckets)
    later = found.groupBy("bucket").applyInArrow(lambda group: decided(group, buckets), "to int, ids binary, texts binary, sizes binary, starts binary")
    spans = later.groupBy("to").applyInArrow(gathered, "_d long, _t long, spans binary")
    spans = cut(spans.join(marks.select("_d", "_t", "_n"), ["_d", "_t"]), "spans")
    return spread_join(rows, spans, ["_d", "_t"], "left").select("doc_id", "text", "spans").mapInArrow(removed, "doc_id long, n_words long, n_removed long, kept string")
