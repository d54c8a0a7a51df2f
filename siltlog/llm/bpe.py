"""Byte-level BPE with a segment tree over the ranks of adjacent pairs.

Every leaf holds ``rank * width + position`` of the pair that starts there, every node the least
value below it. The root is the leftmost pair of the lowest rank. A merge changes three leaves, so
it costs three walks to the root. Short pieces go through the tree many at a time, as rows of
NumPy arrays; long ones through a list-backed tree.

Null texts count as empty; an empty text has no ids and decodes to the empty text. A very long piece
costs the logarithm of its length for each merge. Rows are independent: repeated rows give repeated
results, an empty table an empty one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import KEPT, fresh, slices

# Fixed value: the split pattern of the byte-level vocabulary.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
NONE = np.int64(1) << 62
#: Pieces of at most this many bytes are merged in bulk.
BULK = 64
#: Two white-space characters in a row, one of them a space.
GAPS = re.compile(r" \s|\s ")
#: The cache of ids is emptied beyond this many entries.
CACHED = 200_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder for the content of one vocabulary file."""

    def __init__(self, content: str):
        held = json.loads(content)
        vocab, merges = held["model"]["vocab"], held["model"]["merges"]
        letters = byte_letters()
        raw = {c: b for b, c in letters.items()}
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.base = np.int64(1 << 20)
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pair_rank = dict(zip(keys.tolist(), range(len(pairs))))
        self.specials = {t["content"]: t["id"] for t in held.get("added_tokens", [])}
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.out: dict[int, bytes] = {i: bytes(raw[c] for c in t) if all(c in raw for c in t) else t.encode() for t, i in vocab.items()}
        self.out |= {i: s.encode() for s, i in self.specials.items()}
        self.known: dict[str | tuple, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
        """Leaf values of the pairs (a, b) at the positions; NONE where no merge is known."""
        key = a * self.base + b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (a >= 0) & (b >= 0), self.ranks[i] * width + at, NONE)

    def bulk(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most ``width`` bytes each, merged side by side."""
        n = len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        at = np.arange(width)
        ids = np.full((n, width + 1), -1, np.int64)  # the last column stands for "no neighbour"
        ids[:, :width] = np.where(at < lens[:, None], self.byte_id[raw], -1)
        after = np.broadcast_to(np.minimum(at + 1, width), (n, width)).copy()
        after = np.concatenate([after, np.full((n, 1), width)], 1)
        before = np.concatenate([np.broadcast_to(np.where(at > 0, at - 1, width), (n, width)), np.full((n, 1), width)], 1).copy()
        tree = np.full((n, 2 * width), NONE)
        tree[:, width:] = self.rank(ids[:, :width], ids[:, 1:], width, np.broadcast_to(at, (n, width)))
        size = width
        while size > 1:
            half = size // 2
            tree[:, half:size] = np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2])
            size = half
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            pos, new = root % width, self.made[root // width]
            gone = after[live, pos]
            nxt, prv = after[live, gone], before[live, pos]
            ids[live, pos], ids[live, gone] = new, -1
            after[live, pos], before[live, nxt] = nxt, pos
            tree[live, width + gone] = NONE
            tree[live, width + pos] = self.rank(new, ids[live, nxt], width, pos)
            has = prv < width
            tree[live[has], width + prv[has]] = self.rank(ids[live[has], prv[has]], new[has], width, prv[has])
            for rows, leaf in ((live, gone), (live, pos), (live[has], prv[has])):
                node = (width + leaf) >> 1
                while len(node) and node[0]:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
            live = live[tree[live, 1] < NONE]
        kept = ids[:, :width] >= 0
        flat = ids[:, :width][kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(1) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def single(self, piece: bytes) -> bytes:
        """Ids of one piece of any length, through a list-backed tree."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist() + [-1]
        base, pair, made, none = int(self.base), self.pair_rank, self.made.tolist(), int(NONE)
        leaf = lambda i, j: pair[k] * width + i if j < n and (k := ids[i] * base + ids[j]) in pair else none
        after, before = [*range(1, n + 1), n], [n, *range(n)]
        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = leaf(i, i + 1)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while tree[1] < none:
            rank, pos = divmod(tree[1], width)
            gone = after[pos]
            nxt, prv = after[gone], before[pos]
            ids[pos], ids[gone] = made[rank], -1
            after[pos] = nxt
            if nxt < n:
                before[nxt] = pos
            for at, value in ((gone, none), (pos, leaf(pos, nxt)), (prv, leaf(prv, pos) if prv < n else none)):
                if at < n:
                    node = width + at
                    tree[node] = value
                    while node > 1:
                        node >>= 1
                        tree[node] = min(tree[2 * node], tree[2 * node + 1])
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def learn(self, keys: list) -> None:
        """Put the ids of unseen pieces, given by their keys, into the cache."""
        by: dict[int, list] = {}
        raws = [(" " + k if isinstance(k, str) else k[0]).encode() for k in keys]
        for k, raw in zip(keys, raws):
            n = len(raw)
            by.setdefault(1 << max(1, (n - 1).bit_length()) if n <= BULK else 0, []).append((k, raw))
        for width, some in by.items():
            if not width:
                self.known.update((k, self.single(raw)) for k, raw in some)
            else:
                step = max(1, (1 << 19) // width)
                for i in range(0, len(some), step):
                    part = some[i : i + step]
                    self.known.update(zip([k for k, _ in part], self.bulk([raw for _, raw in part], width)))

    @staticmethod
    def pieces_of(key) -> tuple:
        """The keys of the pieces of a chunk; a chunk that is one piece gives itself."""
        if not isinstance(key, str) or key.isalpha():
            return (key,)
        if key[-1] in ".,;:!?" and key[:-1].isalpha():
            return (key[:-1], (key[-1],))
        return tuple(p[1:] if p[0] == " " and len(p) > 1 and not p[1].isspace() else (p,) for p in PIECES.findall(" " + key))

    def chunks(self, text: str) -> list:
        """Keys of the chunk cache whose ids, joined, are those of the text.

        A string stands for a space and itself: between two characters that aren't white space, a
        space always begins a piece. All else is a tuple of one piece, or of a special token's id.
        """
        if self.special and self.special.search(text):
            out: list = []
            end = 0
            for m in self.special.finditer(text):
                out += [*self.chunks(text[end : m.start()]), (self.specials[m.group()],)]
                end = m.end()
            return out + self.chunks(text[end:])
        if not text:
            return []
        if text[0] == " " or text[-1] == " " or GAPS.search(text):
            return [(p,) for p in PIECES.findall(text)]
        out = text.split(" ")
        out[:1] = [(p,) for p in PIECES.findall(out[0])]
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; special tokens in a text get their own ids."""
        if len(self.known) > CACHED:
            self.known = {}
        known = self.known
        known.update(((i,), np.array([i], "<u4").tobytes()) for i in self.specials.values())
        cut_up = [self.chunks(text or "") for text in texts]
        unseen = {c: self.pieces_of(c) for c in set().union(*cut_up) if c not in known}
        self.learn([k for k in set().union(*unseen.values()) if k not in known])
        known.update((c, b"".join([known[k] for k in keys])) for c, keys in unseen.items() if len(keys) > 1 or keys[0] != c)
        return [b"".join(map(known.__getitem__, c)) for c in cut_up]

    def decode(self, ids: bytes) -> str:
        """The text of the ids; bytes that are not UTF-8 become replacement characters.

        Ids outside the vocabulary are skipped, and so are bytes after the last whole id.
        """
        whole = np.frombuffer(ids, "<u4", len(ids) // 4).tolist()
        return b"".join([self.out.get(i, b"") for i in whole]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def loaded(content: str) -> Bpe:
    return Bpe(content)


KEPT.append(loaded.cache_clear)


def content_of(path: str) -> str:
    """The vocabulary file, read on the driver: executors get its content and need no path."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def model(path: str) -> Bpe:
    return loaded(content_of(path))


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", n: str = "n_tokens", keep: list[str] | None = None, with_decoded: str | None = None) -> DataFrame:
    """``keep`` columns of ``df`` (all by default) with the token ids and their count.

    ids: binary, little-endian unsigned 32-bit. ``with_decoded`` names a further column that holds
    the text decoded from the ids. A kept column of the same name as a result gives way to it.
    """
    results = [ids, n, *([with_decoded] if with_decoded else [])]
    kept = [c for c in (df.columns if keep is None else keep) if c not in results]
    held = fresh("text", kept)
    src = df.select(*kept, df[text].alias(held))
    schema = T.StructType([*src.select(*kept).schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(n, T.LongType()), *([T.StructField(with_decoded, T.StringType())] if with_decoded else [])])

    shared = df.sparkSession.sparkContext.broadcast(content_of(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        for batch in slices(batches, held):
            found = bpe.encode_batch(batch.column(held).to_pylist())
            cols = [batch.column(c) for c in kept] + [pa.array(found, pa.binary()), pa.array([len(x) // 4 for x in found], pa.int64())]
            if with_decoded:
                cols.append(pa.array([bpe.decode(x) for x in found], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *results])

    return src.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids stand for; null ids give null."""
    kept = [c for c in df.columns if c != text]
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(text, T.StringType())])

    shared = df.sparkSession.sparkContext.broadcast(content_of(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        for batch in batches:
            out = [None if x is None else bpe.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.string())], names=[*kept, text])

    return df.mapInArrow(run, schema)
