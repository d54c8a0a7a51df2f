"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained here in NumPy.

Inputs of a word are a vector that is learned with the network, the sum of one for the word and the
mean of those for its character four-grams; what a word table says of it; and the mean and the greatest
of what a table of its four-grams says. Those tables are smoothed log-odds, fitted on the training rows;
the network is trained on windows of each part of those rows with tables fitted on the other parts, so
that it meets words as it will meet those of new texts. A text is scored in windows of WIDTH words, each half over the last; its
score is the greatest of them, calibrated by a logistic fit.

The training sample is bounded: SAMPLE rows of each label, the first by a hash of their ids, so that
training costs the same at any size. Texts of more than LONGEST characters don't train, and of several
texts with one id the least does. Scoring reads whole texts of any length, in memory in proportion to them.
Null and empty texts are scored as a window without words. Labels that are null, and rows whose id is
null, don't train; an id with both labels trains with either. Without both labels in the training rows
all scores are the share of label 1 there, 0 if there are none. Other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import slices

#: Training rows of each label, and characters of a text that trains, at the most.
SAMPLE, LONGEST = 2500, 100_000
WIDTH, STRIDE, HIDDEN, ATTEND = 32, 16, 8, 8
#: Inputs of a word from the log-odds, the length of its learned vector, and both.
SAID, LEARNED = 3, 4
INPUTS = SAID + LEARNED
#: Parts of the training rows; each meets the tables of the others.
FOLDS = 5
#: Texts with an entry at which its log-odds count by half.
RARE = 20
#: Binary logarithms of the entries of each table of log-odds, and of learned vectors.
TABLE, VECTORS = 18, 12
STEPS, BATCH, RATE, SEED = 160, 512, 0.02, 11
#: The rate of learned vectors, and the share of words that train without theirs; chosen across parts of training rows.
SLOW, DROP = 0.0005, 0.5
#: Entries at which the word cache is emptied, and windows that are scored together.
WORDS, TOGETHER = 400_000, 1 << 14
EDGES = b".,!?;:\"'()[]#*$%&|<>"


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(64 - TABLE)


def gram_ids(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Table entries of the four-grams of all words, end to end, and where each word's begin."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 3
    flat = np.frombuffer(b"".join(b"^^" + w + b"$" for w in words) + b"\0\0\0", np.uint8).astype(np.uint64)
    code = flat[:-3] | flat[1:-2] << np.uint64(8) | flat[2:-1] << np.uint64(16) | flat[3:] << np.uint64(24)
    ends = np.cumsum(sizes)
    counts = np.maximum(sizes - 3, 1)
    begin = np.cumsum(counts) - counts
    at = np.repeat(ends - sizes, counts) + np.arange(counts.sum()) - np.repeat(begin, counts)
    return (code[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE), begin


def split(text: str | None) -> list[bytes]:
    return [w.strip(EDGES) or w for w in (text or "").lower().encode("utf-8", "surrogatepass").split()]


class Lexicon:
    """Entries of distinct words, and of the four-grams of each, in the tables."""

    def __init__(self, words: list[bytes]):
        self.word = word_ids(words)
        self.gram, self.begin = gram_ids(words)
        self.sizes = np.diff(np.concatenate([self.begin, [len(self.gram)]]))

    def grams(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The four-grams of some words, end to end, where each word's begin, and how many each has."""
        sizes = self.sizes[some]
        begin = np.cumsum(sizes) - sizes
        return self.gram[np.repeat(self.begin[some] - begin, sizes) + np.arange(sizes.sum())], begin, sizes


def vectors(word: np.ndarray, gram: np.ndarray, lexicon: Lexicon, some: np.ndarray) -> np.ndarray:
    """The learned vectors of some words, from those of words and four-grams."""
    if not len(some):
        return np.zeros((0, LEARNED), word.dtype)
    ids, begin, sizes = lexicon.grams(some)
    cut = np.uint64(TABLE - VECTORS)
    return word[lexicon.word[some] >> cut] + np.add.reduceat(gram[ids >> cut], begin) / sizes[:, None].astype(word.dtype)


class Inputs:
    """Inputs of words, kept for words seen before; without learned vectors only what the log-odds say."""

    def __init__(self, tables: tuple[np.ndarray, np.ndarray], learned: tuple[np.ndarray, np.ndarray] | None = None):
        self.word, self.gram = tables
        self.learned = learned
        self.known: dict[bytes, int] = {}
        self.rows = np.zeros((0, INPUTS if learned else SAID), np.float32)

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        if len(self.known) > WORDS:
            self.known, self.rows = {}, self.rows[:0]
        known = self.known
        new = [w for w in set(chain.from_iterable(texts)) if w not in known]
        if new:
            lexicon = Lexicon(new)
            said = self.gram[lexicon.gram]
            rows = np.stack([self.word[lexicon.word], np.add.reduceat(said, lexicon.begin) / lexicon.sizes, np.maximum.reduceat(said, lexicon.begin)], 1)
            if self.learned:
                rows = np.concatenate([rows, vectors(*self.learned, lexicon, np.arange(len(new)))], 1)
            known.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, rows.astype(np.float32)])
        n = sum(map(len, texts))
        return self.rows[np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64, n)]


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie end to end: each window's first word and words, and each text's first window."""
    many = np.maximum(1, 1 + -(-(sizes - WIDTH) // STRIDE))
    first = np.cumsum(many) - many
    inside = (np.arange(many.sum()) - np.repeat(first, many)) * STRIDE
    return np.repeat(np.cumsum(sizes) - sizes, many) + inside, np.minimum(WIDTH, np.repeat(sizes, many) - inside), first


def batch(x: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(WIDTH, inputs, windows) and the mask (WIDTH, windows); a window without words is one empty word."""
    at = start[None, :] + np.arange(WIDTH)[:, None]
    mask = (np.arange(WIDTH)[:, None] < length[None, :]).astype(np.float32)
    rows = x[np.minimum(at, len(x) - 1)] if len(x) else np.zeros((*at.shape, x.shape[1]), np.float32)
    out = np.ascontiguousarray((rows * mask[:, :, None]).transpose(0, 2, 1))
    mask[0] = 1
    return out, mask


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Windows:
    """The windows of training texts: what the log-odds say of their words, and which words they are."""

    def __init__(self, texts: list[list[bytes]], said: np.ndarray):
        known = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
        start, length, self.first = windows(np.array([len(t) for t in texts], np.int64))
        self.lexicon = Lexicon(list(known))
        self.said, self.mask = batch(said, start, length)
        word = np.array([*map(known.__getitem__, chain.from_iterable(texts)), -1], np.int64)
        inside = np.arange(WIDTH)[:, None] < length[None, :]
        #: The word at each place of each window, -1 for none.
        self.word = word[np.where(inside, start[None, :] + np.arange(WIDTH)[:, None], len(word) - 1)]

    def inputs(self, some: np.ndarray, net: Net) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All inputs of some windows, their distinct words, and which of those, the last for none, is where."""
        words, at = np.unique(self.word[:, some], return_inverse=True)
        none = int(len(words) > 0 and words[0] == -1)
        words, at = words[none:], at.reshape(WIDTH, len(some)) - none
        rows = np.concatenate([vectors(net.p["word"], net.p["gram"], self.lexicon, words), np.zeros((1, LEARNED), np.float32)])
        return np.concatenate([self.said[:, :, some], rows[at].transpose(0, 2, 1)], 1), words, at


class Net:
    """The network; parameters by name, all float32."""

    def __init__(self, rng: np.random.Generator):
        h = HIDDEN
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-1])).astype(np.float32)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("W", draw(3 * h, INPUTS)), ("U", draw(3 * h, h)), ("c", np.zeros((3 * h, 1), np.float32)))}
        self.p |= {k: 0.1 * draw(1 << VECTORS, LEARNED) for k in ("word", "gram")}
        self.p |= {"A": draw(ATTEND, 2 * h), "a": np.zeros((ATTEND, 1), np.float32), "v": draw(1, ATTEND), "w": draw(1, 2 * h), "o": np.zeros((1, 1), np.float32)}

    def run(self, x: np.ndarray, mask: np.ndarray, back: str, keep: list | None) -> np.ndarray:
        """Hidden states (WIDTH, HIDDEN, n) of one direction."""
        h, n = HIDDEN, x.shape[2]
        W, U, c = (self.p[k + back] for k in "WUc")
        out = np.empty((WIDTH, h, n), np.float32)
        state = np.zeros((h, n), np.float32)
        for t in range(WIDTH) if back == "f" else range(WIDTH - 1, -1, -1):
            given, held = W @ x[t] + c, U @ state
            gates = sigmoid(given[: 2 * h] + held[: 2 * h])
            z, r = gates[:h], gates[h:]
            new = np.tanh(given[2 * h :] + r * held[2 * h :])
            after = new + z * (state - new)
            if keep is not None:
                keep.append((t, state, z, r, new, held[2 * h :]))
            state = state + mask[t] * (after - state)
            out[t] = state
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of the windows."""
        kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        hs = np.concatenate([self.run(x, mask, d, kept[d]) for d in "fb"], 1)
        u = np.tanh(np.matmul(self.p["A"], hs) + self.p["a"])
        e = np.matmul(self.p["v"], u)[:, 0] - 1e9 * (1 - mask)
        e = np.exp(e - e.max(0))
        weight = e / e.sum(0)
        pooled = (hs * weight[:, None]).sum(0)
        if keep is not None:
            keep.update(kept, hs=hs, u=u, weight=weight, pooled=pooled)
        return (self.p["w"] @ pooled + self.p["o"])[0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        keep: dict = {}
        logit = self.forward(x, mask, keep)
        p, h, n = self.p, HIDDEN, x.shape[2]
        d = ((sigmoid(logit) - y) / n)[None]
        g = {"w": d @ keep["pooled"].T, "o": d.sum(1, keepdims=True)}
        dp = p["w"].T @ d
        hs, weight, u = keep["hs"], keep["weight"], keep["u"]
        dweight = (hs * dp).sum(1)
        de = weight * (dweight - (weight * dweight).sum(0))
        du = (p["v"].T * de[:, None]) * (1 - u * u)
        g["v"], g["A"], g["a"] = np.einsum("tn,tkn->k", de, u)[None], np.einsum("tkn,thn->kh", du, hs), du.sum((0, 2))[:, None]
        dhs = hs * 0 + dp * weight[:, None] + np.matmul(p["A"].T, du)
        g["x"] = np.zeros_like(x)
        for k, back in enumerate("fb"):
            gW, gU, gc = (np.zeros_like(p[q + back]) for q in "WUc")
            later = np.zeros((h, n), np.float32)
            for t, state, z, r, new, held in reversed(keep[back]):
                total = later + dhs[t, k * h : (k + 1) * h]
                dafter = total * mask[t]
                dnew = dafter * (1 - z) * (1 - new * new)
                dz = dafter * (state - new) * z * (1 - z)
                dr = dnew * held * r * (1 - r)
                dgates = np.concatenate([dz, dr, dnew])
                dheld = np.concatenate([dz, dr, dnew * r])
                gW += dgates @ x[t].T
                g["x"][t] += p["W" + back].T @ dgates
                gc += dgates.sum(1, keepdims=True)
                gU += dheld @ state.T
                later = total * (1 - mask[t]) + dafter * z + p["U" + back].T @ dheld
            g |= {"W" + back: gW, "U" + back: gU, "c" + back: gc}
        return g, float(np.mean(np.logaddexp(0, logit) - y * logit))

    def learn(self, dx: np.ndarray, lexicon: Lexicon, some: np.ndarray) -> dict:
        """Gradients of the learned vectors, from those of the vectors of some words."""
        ids, _, sizes = lexicon.grams(some)
        cut = np.uint64(TABLE - VECTORS)
        g = {k: np.zeros_like(self.p[k]) for k in ("word", "gram")}
        np.add.at(g["word"], lexicon.word[some] >> cut, dx)
        np.add.at(g["gram"], ids >> cut, np.repeat(dx / sizes[:, None], sizes, 0))
        return g

    def train(self, windows: Windows, y: np.ndarray, use: np.ndarray, rng: np.random.Generator, steps: int = STEPS) -> None:
        """Adam over random batches with as many of the windows ``use`` of either label."""
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        sides = [use[y[use] == k] for k in (0, 1)]
        for i in range(1, steps + 1):
            some = np.concatenate([rng.choice(s, BATCH // 2) for s in sides])
            x, words, at = windows.inputs(some, self)
            used = rng.random(at.shape) >= DROP
            x[:, SAID:] *= used[:, None]
            g, _ = self.gradients(x, windows.mask[:, some], y[some])
            dx = np.zeros((len(words) + 1, LEARNED), np.float32)
            np.add.at(dx, at, (g.pop("x")[:, SAID:] * used[:, None]).transpose(0, 2, 1))
            g |= self.learn(dx[:-1], windows.lexicon, words)
            for k, d in g.items():
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.01 * (d * d - v[k])
                rate = SLOW if k in ("word", "gram") else RATE
                self.p[k] -= (rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)


def log_odds(ids: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """For each table entry the log-odds of label 1 from its presence in texts, drawn to 0 where it is rare.

    ids: the distinct entries of each text.
    """
    none = np.zeros(0, np.int64)
    counts = [np.bincount(np.concatenate([none, *(i for i, k in zip(ids, y) if k == side)]), minlength=1 << TABLE) for side in (0, 1)]
    n = [int((y == side).sum()) for side in (0, 1)]
    odds = np.log((counts[1] + 1) / (n[1] + 2)) - np.log((counts[0] + 1) / (n[0] + 2))
    seen = counts[0] + counts[1]
    return np.clip(odds * seen / (seen + RARE), -4, 4).astype(np.float32)


class Model:
    """Tables, network and calibration, or a constant."""

    def __init__(self, texts: list[str | None], labels: list[int]):
        y = np.array(labels, np.int64)
        self.constant = float(y.mean()) if len(y) else 0.0
        if not len(y) or y.min() == y.max():
            self.net = None
            return
        rng = np.random.default_rng(SEED)
        words = [split(t) for t in texts]
        distinct = [sorted(set(w)) for w in words]
        word = [np.unique(word_ids(d)).astype(np.int64) for d in distinct]
        gram = [np.unique(gram_ids(d)[0]).astype(np.int64) if d else np.zeros(0, np.int64) for d in distinct]
        tables = lambda some: tuple(log_odds([ids[i] for i in some], y[some]) for ids in (word, gram))
        self.tables = tables(np.arange(len(y)))
        part = np.empty(len(y), np.int64)
        for side in (0, 1):
            part[y == side] = rng.permutation(np.arange((y == side).sum()) % FOLDS)
        rest = np.argsort(part, kind="stable")
        said = np.concatenate([Inputs(tables(np.flatnonzero(part != k))).of([words[i] for i in np.flatnonzero(part == k)]) for k in range(FOLDS)])
        met = Windows([words[i] for i in rest], said)
        first, n = met.first, met.mask.shape[1]
        of = np.repeat(np.arange(len(rest)), np.diff(np.concatenate([first, [n]])))
        # Of a text with label 1 the window with the strongest words stands for it, of others all do.
        strong = met.said.max(0).sum(0)
        top = np.zeros(n, bool)
        top[[a + int(np.argmax(strong[a:b])) for a, b in zip(first, [*first[1:], n])]] = True
        self.net = Net(rng)
        self.net.train(met, y[rest][of].astype(np.float32), np.flatnonzero(top | (y[rest][of] == 0)), rng)
        logits = [self.net.forward(met.inputs(some, self.net)[0], met.mask[:, some]) for some in np.split(np.arange(n), range(TOGETHER, n, TOGETHER))]
        most = np.maximum.reduceat(np.concatenate(logits), first)
        self.scale, self.shift = 1.0, 0.0
        for _ in range(300):  # logistic calibration of the greatest logit
            d = sigmoid(self.scale * most + self.shift) - y[rest]
            self.scale, self.shift = max(0.05, self.scale - 0.2 * float((d * most).mean())), self.shift - 0.2 * float(d.mean())

    def inputs(self) -> Inputs | None:
        return Inputs(self.tables, (self.net.p["word"], self.net.p["gram"])) if self.net is not None else None

    def scores(self, texts: list[str | None], inputs: Inputs | None) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.constant)
        words = [split(t) for t in texts]
        start, length, first = windows(np.array([len(w) for w in words], np.int64))
        x = inputs.of(words)
        out = [self.net.forward(*batch(x, start[i : i + TOGETHER], length[i : i + TOGETHER])) for i in range(0, len(start), TOGETHER)]
        return 1 / (1 + np.exp(-np.clip(self.scale * np.maximum.reduceat(np.concatenate(out).astype(np.float64), first) + self.shift, -30, 30)))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, train_on: Column, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` rows of each label that satisfy ``train_on``. labels: doc_id, label."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("_y")).where(F.col("doc_id").isNotNull() & F.col("_y").isin(0, 1) & train_on).distinct()
    picked = [rows.where(F.col("_y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    texts = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST)
    one = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text"))
    found = one.orderBy("doc_id", "_y").collect()
    return Model([r["text"] for r in found], [r["_y"] for r in found])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        inputs = model.inputs()
        for b in slices(batches, most=4 << 20):
            found = model.scores(b.column("text").to_pylist(), inputs)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
