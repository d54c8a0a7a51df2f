"""The pipeline's stages, each on what its predecessor kept."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from siltlog.llm import bpe, common, near_copies, quality, secrets, simhash
from siltlog.llm.queries import vocabulary

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], DIR).write.parquet(f"{tmp_path}/{i}")
        kept.append(spark.read.parquet(f"{tmp_path}/{i}"))
        assert i == len(corpus_pipeline.STAGES) - 1 or kept[-1].columns == columns
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert ids[1] == {r["doc_id"] for r in quality.judge(docs).collect() if r["kept"]}
    assert ids[2] == firsts_of_near_copies([(r["doc_id"], r["text"]) for r in kept[1].collect()])
    assert ids[3] <= ids[2] and len(ids[3]) >= 0.8 * len(ids[2])
    texts = [r["text"] for r in kept[4].collect()]
    assert ids[4] == ids[3] and not any(secrets.find(texts))
    last = kept[5].collect()
    assert ids[5] == ids[4] and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) // 4 for r in last)


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    rows = lambda df: sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, DIR)) == rows(docs)


def test_nulls_and_repeats(spark):
    long = " ".join(f"the w{i}" for i in range(40))
    rows = [(1, long, None, None, None), (1, long, None, None, None), (None, long, "en", "s", 5), (2, None, "en", "s", None), (3, long + " x", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, DIR)
    assert [r["doc_id"] for r in docs.collect()].count(1) == 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars"), DIR).count() == 0


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert np.all([n in names for n in __spark_entry__.oracle_sql()])


def test_rejected_documents_are_gone(spark):
    docs = spark.createDataFrame([(1, "too short", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.STAGES[0][1](spark, docs, DIR).where(F.col("doc_id") == 1).count() == 0


def near_copies_table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def firsts_of_near_copies(rows):
    """The least id of each component of all pairs whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    rows = sorted(rows)
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                label = [label[j] if x == label[i] else x for x in label]
    return {rows[min(i for i, x in enumerate(label) if x == y)][0] for y in label}


@pytest.mark.parametrize("block", [1000, 3])
def test_near_copies_are_those_of_five_words_at_four_fifths(spark, monkeypatch, block):
    """Against all pairs: copies at 0.8 or more that SimHash tells apart, chains of them, others below."""
    rng = np.random.default_rng(3)
    texts = []
    for k in range(6):
        w = [f"k{k}w{rng.integers(10**6)}" for _ in range(120)]
        for changes in (0, 1, 2, 2, 3, 5, 8):
            v = list(w)
            for at in rng.choice(120, changes, replace=False):
                v[at] = f"new{rng.integers(10**6)}"
            texts.append(" ".join(v))
    # Chains: each text is near the next only, and the least in a bucket isn't near all of it.
    w = [f"c{i}" for i in range(150)]
    for k in range(12):
        w = [f"v{k}" if i % 150 == 12 * k + 3 else x for i, x in enumerate(w)]
        texts.append(" ".join(w))
    monkeypatch.setattr(near_copies, "BLOCK", block)
    want = firsts_of_near_copies(list(enumerate(texts)))
    got = sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, near_copies_table(spark, list(enumerate(texts))), DIR).collect())
    assert got == sorted(want) and 6 < len(want) < 30


@pytest.mark.parametrize("broadcast", [64 << 20, 0])
def test_joins_by_shuffle_change_nothing(spark, monkeypatch, broadcast):
    """A key that half of the rows have, exact copies under one id, and no table small enough for broadcast."""
    monkeypatch.setattr(common, "BROADCAST", broadcast)
    monkeypatch.setattr(common, "HOT", 20)
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").first()["text"]
    clean = [" ".join(f"r{k}w{i}" for i in range(30)) for k in range(20)]
    rows = [*((None, clean[0]) for _ in range(60)), *((k, clean[1]) for k in range(30)), *((9, clean[k]) for k in range(2, 6)), *((8, clean[6]) for _ in range(3)), *((k, t) for k, t in enumerate(clean[7:], 100)), (1, item), (None, item)]
    docs = near_copies_table(spark, rows)
    left = corpus_pipeline.decontaminated(spark, docs, DIR)
    assert sorted(r["text"] for r in left.collect()) == sorted(t for _, t in rows if t != item)
    once = corpus_pipeline.one_of_each(spark, left, DIR).collect()
    assert sorted(r["text"] for r in once) == sorted(clean)
    assert {r["doc_id"] for r in once if r["text"] == clean[1]} == {0}


def test_other_columns_pass_untouched(spark):
    """Columns called as the operators call their own, of any type, come out as they went in."""
    names = ["n_words", "kept", "row", "_row", "__w", "_d", "_bad", "_spans", "spans", "_k1", "_n", "set", "c"]
    texts = [" ".join(["the of and to"] * 2 + [f"w{k}{i}" for i in range(30)] + ["password=abcdef12"]) for k in range(3)]
    rows = [(i, t, "en", "s", len(t), *(f"{n}{i}" for n in names), {"k": i}) for i, t in enumerate([*texts, texts[0]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names) + ", extra map<string, int>")
    want = {i: tuple(f"{n}{i}" for n in names) for i in range(3)}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
    got = docs.collect()
    assert docs.schema.names == ["doc_id", "text", "lang", "source", "n_chars", *names, "extra"]
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in got} == want and all(r["extra"] == {"k": r["doc_id"]} and "[secret]" in r["text"] for r in got)


def test_null_and_repeated_ids_lose_no_clean_rows(spark):
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").first()["text"]
    clean = [" ".join(f"r{k}w{i}" for i in range(30)) for k in range(5)]
    rows = [(None, clean[0]), (None, clean[0]), (None, clean[1]), (7, clean[2]), (7, clean[3]), (8, clean[4]), (8, clean[4]), (None, item), (7, item + " end")]
    once = corpus_pipeline.one_of_each(spark, near_copies_table(spark, rows), DIR)
    texts = sorted(r["text"] for r in once.collect())
    assert [t for t in texts if t in clean] == sorted(clean)
    left = corpus_pipeline.decontaminated(spark, near_copies_table(spark, rows), DIR)
    assert sorted(r["text"] for r in left.collect()) == sorted(t for _, t in rows if t in clean)


def test_near_copies_have_simhash_fingerprints(spark):
    """Against a loop over bits: the majority of the five-word shingles' mixed hashes."""
    texts = [" ".join(f"t{k}w{i}" for i in range(n)) for k, n in enumerate((1, 4, 5, 8, 84, 85, 300))] + ["", None, "A b  c d e a B c d e"]
    got = {r["doc_id"]: r["prints"] for r in near_copies.sketches(near_copies_table_of(spark, texts)).collect()}
    for k, text in enumerate(texts):
        hashes = {int(h) for h in simhash.shingle_hashes(text, 5)}
        n = 0 if not hashes else near_copies.MORE if len(hashes) <= near_copies.FEW else near_copies.PRINTS
        want = []
        for a, b in near_copies.MIX[:n].tolist():
            mixed = []
            for h in hashes:
                x = h * a % 2**64
                x = (x ^ x >> 32) * b % 2**64
                mixed.append(x ^ x >> 32)
            want.append(sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in mixed) > len(mixed)))
        assert np.frombuffer(got[k], np.uint64).tolist() == want


def near_copies_table_of(spark, texts):
    rows = [(k, k, k, t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "_k1 long, _k2 long, doc_id long, text string")


@pytest.mark.parametrize("full", [1 << 21, 1])
def test_buckets_are_links_of_fingerprints(spark, monkeypatch, full):
    """Against all pairs of each key; a key that no task should hold is a bucket of all that have it."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (8, near_copies.PRINTS), np.uint64)
    prints = np.repeat(base, 30, 0)
    for row in prints:
        for _ in range(rng.integers(0, 9)):
            row ^= np.uint64(1) << rng.integers(0, 64, len(row)).astype(np.uint64)
    # One block that half of the rows have, while their other bits differ.
    prints[::2, 0] = prints[::2, 0] & ~near_copies.MASKS[0]
    monkeypatch.setattr(near_copies, "FULL", full)
    monkeypatch.setattr(near_copies, "DEALT", 120)
    classes = spark.createDataFrame([(bytes([k]), row.tobytes()) for k, row in enumerate(prints)], "set binary, prints binary").withColumn("h", F.xxhash64("set"))
    number = {r["h"]: r["set"][0] for r in classes.collect()}
    buckets = {}
    for r in near_copies.gathered(classes.drop("h")).collect():
        buckets.setdefault(r["key"], []).append(number[r["h"]])
    got = sorted(tuple(sorted(b)) for b in buckets.values() if len(b) > 1)
    want, whole = [], []
    for table in range(near_copies.PRINTS):
        for mask in near_copies.MASKS:
            fps = prints[:, table]
            for key in np.unique(fps & mask):
                rows = np.flatnonzero(fps & mask == key)
                label = rows.copy()
                for i in rows:
                    near = rows[np.bitwise_count(fps[rows] ^ fps[i]) <= near_copies.RADIUS]
                    label[np.isin(label, label[np.isin(rows, near)])] = label[np.isin(rows, near)].min()
                want += [tuple(rows[label == x].tolist()) for x in np.unique(label) if (label == x).sum() > 1]
                whole.append(tuple(rows.tolist()))
    assert got == sorted(want if full > 1 else [b for b in whole if len(b) > 1]) and tuple(range(0, len(prints), 2)) in whole


def test_no_pair_at_four_fifths_is_missed(spark):
    """Texts and the same ones cut short, at 0.8 exactly: SimHash's worst case, few shingles and many."""
    texts = []
    for k in range(240):
        n = (5, 10, 15, 25, 80, 200)[k % 6]
        w = [f"p{k}w{i}" for i in range(n + 4)]
        texts += [" ".join(w), " ".join(w[: n * 4 // 5 + 4])]
    kept = corpus_pipeline.one_of_each(spark, near_copies_table(spark, list(enumerate(texts))), DIR)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == list(range(0, len(texts), 2))


def test_groups_of_long_sets_are_small(spark, monkeypatch):
    """Members of a bucket are dealt by the hashes of their sets, and all pairs still meet."""
    monkeypatch.setattr(near_copies, "HASHES", 500, raising=False)
    members = [bytes([k]) for k in range(40)]
    beside = spark.createDataFrame([(1, c, 100, members[0], 100, 0) for c in members], "key long, c binary, z int, least binary, zl int, wl long")
    blocks = near_copies.leftovers(beside, spark.createDataFrame([], "node binary, root binary"))
    groups = {}
    for r in blocks.collect():
        groups.setdefault((r["u"], r["m"]), set()).add(bytes(r["c"]))
    assert max(100 * len(g) for g in groups.values()) <= 5 * 500
    assert {(a, b) for g in groups.values() for a in g for b in g} == {(a, b) for a in members for b in members}


def test_near_dedup_gives_up_what_bpe_left_in_a_worker():
    """Spark reuses Python workers: the encoder's tables and cache add to the memory of the next stage."""

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    bpe.model(vocabulary()).encode_batch(["a b c"])
    assert bpe.loaded.cache_info().currsize
    batch = pa.RecordBatch.from_pydict({"_k1": [1], "_k2": [2], "doc_id": [3], "text": ["a b c d e f"]})
    assert [b.num_rows for b in near_copies.sketches(Rows())(iter([batch]))] == [1]
    assert not bpe.loaded.cache_info().currsize
