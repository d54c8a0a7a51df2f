"""The document operators against brute force, and on nulls, empties, ties, repeats and clashing names."""

import hashlib
import random
import re
import time
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltlog.llm import bpe, common, decontaminate, quality, queries, secrets, shards, simhash, substrings, token_counts, toxicity, url_filters

DIR = "/root/testdata/sf0.001"
ODD = ["", None, " \t\n", "a", "one two", "é" * 50, "word " * 300, "x" * 5000, "\x0b\x0c a\x1cb  c d", "don't I'll 3½ 中文 😀\r\n\r\n  end ", "same text here", "same text here"]


def docs_of(spark, texts, ids=None):
    """Documents with columns that clash with the operators' own names."""
    rows = [(None if ids and ids[i] is None else (ids[i] if ids else i), t, "en", "s", 0 if t is None else len(t), "mine", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, _d int")


def empty(spark):
    return docs_of(spark, []).limit(0)


# 3 and 5: BPE and token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def real_texts(spark, n=80):
    return [r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").limit(n).collect()]


def test_bpe_is_the_librarys(spark, library):
    texts = [*ODD, "a<|endoftext|> b", "<|endoftext|>", " " * 300 + "q", "zzz" * 100 + "!?" * 50, *real_texts(spark)]
    got = {r["doc_id"]: r for r in bpe.encode(docs_of(spark, texts), queries.vocabulary(), with_decoded="decoded").collect()}
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i]["ids"]), "<u4").tolist() == want and got[i]["n_tokens"] == len(want)
        assert got[i]["decoded"] == library.decode(want, skip_special_tokens=False) == (text or "")


def test_bpe_decodes_any_ids(spark, library):
    ids = [[0, 50256, 128, 200], [], [187], [999999, 64, 4294967295, 65]]
    df = spark.createDataFrame([(i, bytearray(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)] + [(9, None), (8, bytearray(b"\x40\0\0\0\x41\0"))], "n int, ids binary")
    got = {r["n"]: r["decoded"] for r in bpe.decode(df, queries.vocabulary()).collect()}
    assert got == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)} | {9: None, 8: library.decode([64])}
    assert bpe.encode(empty(spark), queries.vocabulary()).count() == 0


def test_trees_agree(library):
    one = bpe.model(queries.vocabulary())
    rng = random.Random(3)
    words = [bytes(rng.choice(b"aethinos \xc3\xa9") for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    assert one.bulk(words, 64) == [one.single(w) for w in words]


def test_token_histogram_answers_every_limit(spark):
    rows = spark.createDataFrame([(n,) for n in [0, 0, 3, 5, 5, 900, 2000, 5000, None]], "n_tokens long")
    real = [0, 0, 3, 5, 5, 900, 2000, 5000]
    hist = token_counts.histogram(rows)
    for r in hist.collect():
        n = r["n_tokens"]
        assert r["docs"] == real.count(n) and r["docs_from"] == sum(x >= n for x in real) and r["docs_below"] == sum(x < n for x in real)
        assert r["tokens_from"] == sum(x for x in real if x >= n) and r["truncated_total"] == sum(min(x, n) for x in real)
    for r in token_counts.limits(hist, [1, 5, 1000, 10**6]).collect():
        k = r["context"]
        assert r["tokens_kept"] == sum(min(x, k) for x in real) and r["docs_longer"] == sum(x > k for x in real) and r["docs_within"] + r["docs_longer"] == len(real)
    for q in (0.1, 0.5, 1.0):
        assert token_counts.quantile(hist, q).first()[0] == sorted(real)[int(np.ceil(q * len(real))) - 1]
    assert token_counts.histogram(rows.limit(0)).count() == 0 and token_counts.quantile(token_counts.histogram(rows.limit(0)), 0.5).first()[0] is None


def test_token_counts_query(spark, library):
    sizes = [len(library.encode(r["text"]).ids) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    got = {r["n_tokens"]: r["docs"] for r in queries.op5_token_counts(spark, DIR).collect()}
    assert got == {n: sizes.count(n) for n in set(sizes)}


# 4: quality rules


def test_quality_equals_sql(spark):
    con = duckdb.connect()
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    texts = [*ODD, "a b c d e a b c d e", "w " * 5, "l1 a\nl1 a\n\n \nl2", "#*$%&|<> x " * 4, *real_texts(spark)]
    docs = docs_of(spark, texts)
    con.register("documents", docs.select("doc_id", "text").toPandas())
    rows = lambda df: sorted(map(repr, df[cols].itertuples(index=False, name=None)))
    assert rows(quality.judge(docs).select(*cols).toPandas()) == rows(con.execute(quality.oracle()).df())
    assert quality.judge(empty(spark)).count() == 0


def test_quality_repeats_by_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(60)]
    for r in quality.judge(docs_of(spark, texts)).collect():
        w = texts[r["doc_id"]].split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        assert r["n_repeat_words"] == len(hit)


# 10: secrets


def test_secrets_base_by_brute_force(spark):
    texts = [*ODD, "paSSword = 'abcdef' paſsword=abcdefg toKen:x aPi_KEY=\"12345\" secret:====== tokentoken=abcdefgh", "é AKIA" + "Q" * 16 + " AKIAshort", "f" * 23 + " " + "a0" * 12, "apikey : zzzzzz api-key=aaaaaaa", *real_texts(spark)]
    kinds = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(kinds) for m in p.finditer(t or "") if len(m.group(g)) >= n)
        assert [(s["kind"], s["start"], s["end"]) for s in got[i] if s["kind"] in ("assign", "access", "hex")] == [(kinds[k][0], a, b) for a, k, b in want]
    assert secrets.scan(empty(spark)).count() == 0


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_index_loses_no_match(rule):
    hits = {
        "private_key": "-----BEGIN RSA PRIVATE KEY-----", "github": "ghp_" + "A1" * 18, "slack": "xoxb-1234567890ab", "google": "AIza" + "x" * 35, "stripe": "sk_live_" + "a" * 20,
        "jwt": "eyJabcdefghij.eyJabcdefghij.abcdefghij", "bearer": "BEARER " + "t" * 24, "url_login": "http://me:pw@host", "assign": "API_KEY='abcdef1'", "access": "AKIA" + "Z" * 16, "hex": "0f" * 12,
    }
    text = "é before " + hits[rule.kind] + " after"
    assert rule.kind in {k for k, _, _ in secrets.find(["nothing", text, None])[1]}
    assert (secrets.trigram_query(rule.pattern) is True) == (rule.kind == "hex")


PLANTED = [
    "-----BEGIN RSA PRIVATE KEY-----\n" + "QUJD" * 12 + "\n-----END RSA PRIVATE KEY-----", "gho_" + "a1B2" * 10, "xoxp-12345-abcde-99", "AIza" + "Sy-_" * 9, "rk_test_" + "z9" * 10, "sk_live_" + "q" * 16,
    "eyJhbGciOiJI.eyJzdWIiOiIx.sig_na-ture9", "x eyJhbGciOiJI.eyJzdWIiOiIx.short", "Bearer  " + "tok.en~/+" * 3, "ftp://user:pa55@host", "git+ssh://a:b@c https://plain/x:y@z", "token: abcdefg", "AKIA" + "7" * 16, "deadbeef" * 4,
]


def test_every_kind_by_plain_search(spark):
    """The index against a search of every text with every rule, over whole texts."""
    rng = random.Random(12)
    real = [r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    texts = [*ODD, *real, *(" ".join(x) for x in PLANTED), *(t + rng.choice(["", " ", "\n", "é", "x"]) + rng.choice(PLANTED) + rng.choice(["", " ", "/"]) + t for t in real), "\n".join(PLANTED)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.scan(docs_of(spark, texts)).collect()}
    kinds = set()
    for i, t in enumerate(texts):
        plain = [(m.start(), k, m.end()) for k, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, t or "", re.A) if len(m.group(r.group)) >= r.least]
        assert got[i] == [(secrets.RULES[k].kind, a, b) for a, k, b in sorted(plain)]
        kinds |= {k for k, _, _ in got[i]}
    assert kinds == {r.kind for r in secrets.RULES}


@pytest.mark.parametrize("part", ["x", " ", "eyJ", "a://b:", "eyJaaaaaaaa.", "http://", "-----BEGIN PRIVATE KEY-----", "\nA:", "AKIA", "token "])
def test_long_texts_take_linear_time(part):
    took = []
    for n in (250_000, 1_000_000):
        began = time.perf_counter()
        secrets.find([part * (n // len(part)) + " a://b"])
        took.append(time.perf_counter() - began)
    assert took[1] < 2 + 8 * took[0]


def test_redaction_keeps_the_rest(spark):
    got = secrets.scan(docs_of(spark, ["a token=abcdef1 b", None, "clean"]), redact="[x]").orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["a [x] b", None, "clean"]


def test_private_keys_go_with_their_bodies():
    body = "\n".join(["QUJD" * 16] * 3 + ["Zm9vYmFy"])
    head, tail = "-----BEGIN RSA PRIVATE KEY-----\n", "\n-----END RSA PRIVATE KEY-----"
    for text in (f"a {head}{body}{tail} b", f"a {head}Proc-Type: 4,ENCRYPTED\n\n{body}\n b", f"a {head}{body}\n{head}{body}{tail} b"):
        left = secrets.redacted(text, secrets.find([text])[0], "[x]")
        assert "QUJD" not in left and "Zm9v" not in left and left.startswith("a [x]") and left.endswith(" b")
    text = "the -----BEGIN PRIVATE KEY----- line alone"
    assert secrets.redacted(text, secrets.find([text])[0], "[x]") == "the [x] line alone"


# 1: URLs


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_url_rules(spark):
    urls = ["https://WWW.Example.com/en/x?q#f", "http://a.example.com/en/", "http://example.com/en", "http://x.com", "http://x.com/", "http://b.net/es/1", "http://net/fr/", "no scheme", None, "", "http://", "http://h.org?x=/en/", "http://notexample.com/en/"]
    got = {r["page_id"]: r for r in url_filters.judge(pages_of(spark, [(i, u, None) for i, u in enumerate(urls)])).collect()}
    want = [("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("a.example.com", "/en/", "example.com/en/", "block"), ("example.com", "/en", "com/", "allow"), ("x.com", "", None, None), ("x.com", "/", "com/", "allow"), ("b.net", "/es/1", "net/es/", "block"), ("net", "/fr/", "net/fr/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h.org", "", None, "allow"), ("notexample.com", "/en/", "com/", "allow")]
    for i, (host, path, rule, verdict) in enumerate(want):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule) and (verdict is None or got[i]["verdict"] == verdict)
    assert url_filters.judge(pages_of(spark, [])).count() == 0


def test_distrust_runs_against_the_links(spark):
    """A farm whose only links go to a blocked host is blocked; a host that links to trusted ones isn't."""
    link = lambda h: f'<a href="http://{h}/x">'
    rows = [(1, "http://bad.net/es/", None), (2, "http://farm.org/p", link("bad.net") * 3), (3, "http://good.com/", link("fine.org")), (4, "http://fine.org/p", ""), (5, "http://far.org/", "<a href='/local'>")]
    got = {r["page_id"]: r for r in url_filters.judge(pages_of(spark, rows)).collect()}
    assert [got[i]["verdict"] for i in (1, 2, 3, 4, 5)] == ["block", "block", "allow", "allow", "allow"]
    assert got[2]["distrust"] > got[2]["trust"] == 0 and got[4]["trust"] > 0 == got[4]["distrust"]


@pytest.mark.parametrize("d", [3, 1000])
def test_a_farm_of_any_size_is_blocked(spark, d):
    """The verdict of a farm host doesn't change as others join; one bad link of many doesn't block."""
    link = lambda h: f'<a href="http://{h}/x">'
    rows = [(0, "http://bad.net/es/", None), (-1, "http://list.org/p", "".join(map(link, ["bad.net", *(f"n{i}.org" for i in range(9))])))]
    rows += [(i, f"http://farm{i}.org/p", link("bad.net")) for i in range(1, d + 1)]
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(pages_of(spark, rows)).collect()}
    assert got[-1] == "allow" and all(got[i] == "block" for i in range(d + 1))


def test_propagation_by_brute_force(spark):
    rng = np.random.default_rng(2)
    a = (rng.random((6, 6)) < 0.4) & ~np.eye(6, dtype=bool)
    seeds = spark.createDataFrame([("k", "h0", 1.0), ("k", "h3", 3.0)], "kind string, host string, weight double")
    edges = spark.createDataFrame([("k", f"h{i}", f"h{j}", float(1 / a[i].sum())) for i in range(6) for j in range(6) if a[i, j]], "kind string, src string, dst string, share double")
    s = np.array([0.25, 0, 0, 0.75, 0, 0])
    v, m = s, a / np.maximum(a.sum(1, keepdims=True), 1)
    for _ in range(5):
        v = 0.15 * s + 0.85 * v @ m
    got = {r["host"]: r["score"] for r in url_filters.propagate(seeds, edges, 5, rest=0).collect()}
    assert all(abs(got.get(f"h{i}", 0) - v[i]) < 1e-12 for i in range(6))


def test_dangling_mass_goes_back_and_the_rest_is_small(spark):
    rng = np.random.default_rng(4)
    a = (rng.random((7, 7)) < 0.3) & ~np.eye(7, dtype=bool)
    a[2] = False
    seeds = spark.createDataFrame([("k", "h0", 1.0), ("k", "h3", 3.0)], "kind string, host string, weight double")
    edges = spark.createDataFrame([("k", f"h{i}", f"h{j}", float(1 / a[i].sum())) for i in range(7) for j in range(7) if a[i, j]], "kind string, src string, dst string, share double")
    s = np.array([0.25, 0, 0, 0.75, 0, 0, 0])
    v, m, ends = s, a / np.maximum(a.sum(1, keepdims=True), 1), a.sum(1) == 0
    for _ in range(300):
        v = (0.15 + 0.85 * v[ends].sum()) * s + 0.85 * v @ m
    got = {r["host"]: r["score"] for r in url_filters.propagate(seeds, edges, back=("k",), rest=1e-2).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and all(abs(got.get(f"h{i}", 0) - v[i]) < 0.06 for i in range(7))


def test_many_rules_by_join(spark, monkeypatch):
    """The join of host suffixes against the compiled rules, ties and equal texts among them."""
    rng = random.Random(3)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "x.net", "y.x.net", "com", ""]
    rules = (*url_filters.RULES, *(url_filters.Rule(rng.choice(hosts[:6]) + rng.choice(["/", "/p", "/p/q", "/en/"]), rng.choice(["allow", "block"])) for _ in range(30)))
    pages = pages_of(spark, [(i, rng.choice(["http://", "x"]) + rng.choice(hosts) + rng.choice(["", "/", "/p/q/r", "/en/1?x"]), None) for i in range(200)] + [(900, None, None)])
    rows = lambda: sorted((r["page_id"], r["rule"] or "", r["_ruled"] or "") for r in url_filters.judged_by_rules(pages, rules).collect())
    want = rows()
    monkeypatch.setattr(url_filters, "COMPILED", 3)
    assert rows() == want and sum(r[1] != "" for r in want) > 50


# 6: decontamination


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def test_decontamination_by_brute_force(spark):
    rng = random.Random(4)
    make = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(n)]
    items = [make(rng.choice([3, 5, 6, 9, 20, 45])) for _ in range(25)]
    texts = []
    for it in items:
        bent = list(it)
        for _ in range(rng.randrange(4)):
            bent[rng.randrange(len(bent))] = "zz"
        texts += [" ".join(make(rng.randrange(60)) + it + make(200)), " ".join(make(30) + bent), " ".join(it).upper(), " ".join(bent + bent)]
    texts += ODD
    ids = [None if i == 3 else i for i in range(len(texts))]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, ""), (0, " ".join(items[0]))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["shared"], r["item_shingles"]) for r in decontaminate.search(docs_of(spark, texts, ids), bench).collect()}
    want = {}
    for i, t in zip(ids, texts):
        for j, it in enumerate(items):
            n = shingles(" ".join(it))
            if (c := len(n & shingles(t))) >= np.ceil(0.8 * len(n) - 1e-9):
                want[i, j] = (c, len(n))
    assert got == want and len(want) > 30
    assert decontaminate.search(empty(spark), bench).count() == 0 and decontaminate.search(docs_of(spark, texts), bench.limit(0)).count() == 0


def test_a_common_shingle_makes_no_pairs(spark):
    """300 items share one phrase with 600 documents, each of which holds two items: those are the candidates."""
    phrase = "this phrase is in all"
    items = [phrase + " " + " ".join(f"i{k}w{j}" for j in range(20)) for k in range(300)]
    texts = [items[k // 2] + " and " + items[(k // 2 + 1) % 300] for k in range(600)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    sizes = []
    original = decontaminate.cut

    def counted(df, name):
        out = original(df, name)
        if name == "candidates":
            sizes.append(out.count())
        return out

    decontaminate.cut = counted
    try:
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.search(docs_of(spark, texts), bench).collect()}
    finally:
        decontaminate.cut = original
    assert got == {(k, j) for k in range(600) for j in (k // 2, (k // 2 + 1) % 300)} and sizes == [1200]


def test_the_least_id_is_not_null(spark):
    low = -(1 << 63)
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = [r["doc_id"] for r in decontaminate.search(docs_of(spark, [item, item], [None, low]), bench).collect()]
    assert sorted(got, key=str) == [low, None]
    left = substrings.deduplicate(docs_of(spark, [item, item], [None, low])).collect()
    assert {r["doc_id"]: r["n_removed"] for r in left} == {None: 0, low: 20}


# 7: shards


def check_shards(got, texts, n=16):
    assert len(got) == len(texts)
    sizes = [sum(r["shard"] == s for r in got) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(n):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))


def test_shards_are_even_and_keep_groups_together(spark):
    rng = random.Random(6)
    texts = [f"single {i}" for i in range(200)] + [f"pair {i // 3}" for i in range(90)] + ["hot"] * 150 + [None, "", None]
    rng.shuffle(texts)
    out = shards.assign(docs_of(spark, texts)).cache()
    got = out.collect()
    check_shards(got, texts)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, crc32(raw), "rows", None)
    linked, apart = shards.cut_edges(out).first()
    # The hot group fills more than five of the shards of 27 rows.
    assert linked == 243 and apart <= 150 - 27 + 0.1 * linked
    spread = {r["shard"] for r in got if texts[r["doc_id"]] == "hot"}
    assert len(spread) < 12


@pytest.mark.parametrize("n, size", [(300, 2), (150, 4)])
def test_full_shards_swap_rows(spark, n, size):
    """All rows are linked, so that no shard has room: groups come together by exchange alone."""
    texts = [f"group {i % n}" for i in range(n * size)]
    out = shards.assign(docs_of(spark, texts)).cache()
    check_shards(out.collect(), texts)
    linked, apart = shards.cut_edges(out).first()
    assert linked == n * size and apart <= 0.12 * linked


def test_granted_moves_fit():
    rng = np.random.default_rng(1)
    asked, room = rng.integers(0, 50, (16, 16)) * (1 - np.eye(16)), np.zeros(16)
    granted = shards.flows(asked, room)
    assert (granted <= asked).all() and (granted.sum(0) <= granted.sum(1) + 1e-3).all() and granted.sum() > 0.5 * asked.sum()
    assert shards.flows(np.array([[0, 9.0], [0, 0]]), np.zeros(2)).sum() < 1e-3


def test_shards_of_odd_tables(spark):
    for texts, ids in ((["a"] * 5, None), ([], None), (["x", "x", None], [None, None, 1]), (["r"] * 40, [3] * 40)):
        check_shards(shards.assign(docs_of(spark, texts, ids)).collect(), texts)


# 8: SimHash


def test_fingerprints_by_the_rule(spark):
    texts = [*ODD, "A b C d", "a B c D", *real_texts(spark, 20)]
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(docs_of(spark, texts)).collect()}
    words = [(t or "").encode().lower().split() for t in texts]
    grams = [[b" ".join(w[i : i + 3]).decode() for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w).decode()] if w else [] for w in words]
    rows = spark.createDataFrame([(i, g) for i, some in enumerate(grams) for g in some], "i int, g string")
    hashes = {}
    for r in rows.select("i", F.xxhash64("g").alias("h")).collect():  # Spark's own XXH64 has seed 42
        hashes.setdefault(r["i"], []).append(r["h"] & (2**64 - 1))
    for i in range(len(texts)):
        h = hashes.get(i, [])
        assert got[i] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_labels(f):
    label = np.arange(len(f))
    for i in range(len(f)):
        near = np.flatnonzero(np.bitwise_count(f ^ f[i]) <= simhash.RADIUS)
        label = simhash.unite(label, np.full(len(near), i), near)
    return label


@pytest.mark.parametrize("seed", range(3))
def test_spanning_links_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    f = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False))) for b in base for _ in range(15)]
    f = np.unique(np.array([*f, *(base[0] ^ np.uint64(x) for x in range(150))], np.uint64))
    masks = simhash.masks()
    choice = np.repeat(np.arange(len(masks)), len(f))
    key = np.concatenate([f.view(np.int64) & np.int64(m) for m in masks])
    a, b = simhash.spanning(choice, key, np.tile(f, len(masks)))
    at = {int(x): i for i, x in enumerate(f)}
    label = simhash.unite(np.arange(len(f)), np.array([at[int(x)] for x in a]), np.array([at[int(x)] for x in b]))
    assert (label == brute_labels(f)).all()


def test_gray_order():
    codes = np.arange(64, dtype=np.uint64)
    ranked = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(ranked[1:] ^ ranked[:-1]) == 1).all()


@pytest.mark.parametrize("broadcast", [common.BROADCAST, 0])
def test_components_of_chains_and_stars(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST", broadcast)
    monkeypatch.setattr(common, "HOT", 25)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {201: 200} or all(got.get(i, i) == (0 if i <= 40 else 100 if i < 160 else 200) for i in [*range(41), *range(100, 160), 200, 201])
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_fingerprints_meet_by_broadcast(spark, monkeypatch):
    """Half of the rows blank, and no table small enough to be broadcast whole."""
    texts = [*[None, "", " "] * 20, *real_texts(spark, 30), *["the same words here"] * 30]
    want = {r["doc_id"]: r["component_id"] for r in simhash.group(docs_of(spark, texts)).collect()}
    monkeypatch.setattr(common, "BROADCAST", 0)
    monkeypatch.setattr(common, "HOT", 25)
    assert {r["doc_id"]: r["component_id"] for r in simhash.group(docs_of(spark, texts)).collect()} == want
    assert all(want[i] == 0 for i in range(60)) and len(want) == len(texts)


def test_groups_of_documents(spark):
    texts = [*ODD, *real_texts(spark, 60), *real_texts(spark, 10)]
    ids = [None if i == 4 else i for i in range(len(texts))]
    got = simhash.group(docs_of(spark, texts, ids)).collect()
    assert len(got) == len(texts)
    f = np.array([int(r["fingerprint"], 16) for r in got], np.uint64)
    label = brute_labels(f)
    for k in set(label):
        some = [got[i] for i in np.flatnonzero(label == k)]
        assert {r["component_id"] for r in some} == {min((r["doc_id"] for r in some if r["doc_id"] is not None), default=None)}
    assert simhash.group(empty(spark)).count() == 0


# 2: substrings


def brute_substrings(docs):
    seen, out = {}, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in seen:
                gone[i : i + 20] = [True] * 20
            seen[tuple(w[i : i + 20])] = True
        out[d] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("cells, small", [(None, False), (8, False), (None, True), (30, True)])
def test_substrings_by_brute_force(spark, monkeypatch, cells, small):
    """With sketches that let nearly all and nearly nothing through, in small chunks and buckets, and joined by shuffle."""
    if small:
        for name, value in (("CHUNK", 50), ("HELD", 100), ("BUCKET", 200)):
            monkeypatch.setattr(substrings, name, value)
        monkeypatch.setattr(common, "BROADCAST", 0)
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [*ODD, "a " * 100, "a " * 25 + "b " * 30, passage, *(" ".join(f"w{rng.randrange(9)}" for _ in range(40)) + " " + passage + f" t{i}" for i in range(20)), *real_texts(spark), *real_texts(spark, 5)]
    docs = docs_of(spark, texts).repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.deduplicate(docs, cells=cells).collect()}
    assert got == brute_substrings(list(enumerate(texts)))


def test_substrings_of_odd_tables(spark):
    text = " ".join(f"x{i}" for i in range(30))
    got = [(r["doc_id"], r["n_removed"]) for r in substrings.deduplicate(docs_of(spark, [text, text, text], [5, None, 5])).collect()]
    assert sorted(got, key=str) == [(5, 30), (5, 30), (None, 0)]
    assert substrings.deduplicate(empty(spark)).count() == 0


def test_codes_of_the_sketch():
    for cells in (np.arange(0, 5), np.array([0, 70000, 1 << 19]), np.zeros(0, np.int64)):
        assert (substrings.unpacked(substrings.packed(cells.astype(np.uint32))) == cells).all()
    for at in (np.arange(300), np.array([0, 1 << 24, 5]), np.zeros(0, np.int64)):
        assert (substrings.placed(substrings.places(at)) == at).all()


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(5)
    for words in (rng.integers(0, 1 << 62, 400, np.uint64), rng.integers(0, 2, 400).astype(np.uint64)):
        at = substrings.least_of(substrings.rolled(words, substrings.FIRST, 10), 11)
        gram = substrings.rolled(words, substrings.FIRST, 10)
        assert all(at[i] == i + int(np.argmin(gram[i : i + 11])) for i in range(len(at))) and (np.diff(at) >= 0).all()


def test_the_sketch_grows_with_the_texts(spark):
    """Four times the texts make about four times the rows and bytes, and few single windows pass."""
    rng = random.Random(9)
    sizes = []
    for n in (100, 400):
        docs = docs_of(spark, [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(n)]).repartition(2)
        rows = docs.withColumns(substrings.keyed(F.col("doc_id"), F.col("text")))
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
        parts = substrings.sketches(rows, size.bit_length()).cache()
        marks = substrings.estimated(rows, size.bit_length())
        sizes.append((parts.count(), common.bytes_of(parts), (marks.agg(F.sum("n")).first()[0] or 0) / (n * 50)))
    assert sizes[1][0] <= 6 * sizes[0][0] and 3 < sizes[1][1] / sizes[0][1] < 5 and max(s[2] for s in sizes) < 0.06


# 9: toxicity


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Net(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((toxicity.WIDTH, toxicity.INPUTS, 4))
    mask = (np.arange(toxicity.WIDTH)[:, None] < np.array([32, 5, 1, 20])).astype(float)
    y = np.array([0, 1, 1, 0.0])
    g, _ = net.gradients(x, mask, y)
    g.pop("x")
    for k in g:
        v = net.p[k]
        at = tuple(rng.integers(0, s) for s in v.shape)
        side = []
        for e in (1e-3, -1e-3):
            v[at] += e
            side.append(net.gradients(x, mask, y)[1])
            v[at] -= e
        assert abs(g[k][at] - (side[0] - side[1]) / 2e-3) < 1e-4


def test_gradients_of_learned_vectors():
    rng = np.random.default_rng(1)
    net = toxicity.Net(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = [[b"you", b"are", b"you"], [], [b"fine", b"a"] * 30]
    met = toxicity.Windows(texts, rng.standard_normal((63, toxicity.SAID)))
    some, y = np.arange(met.mask.shape[1]), rng.integers(0, 2, met.mask.shape[1])
    x, words, at = met.inputs(some, net)
    g, _ = net.gradients(x, met.mask, y)
    dx = np.zeros((len(words) + 1, toxicity.LEARNED))
    np.add.at(dx, at, g["x"][:, toxicity.SAID :].transpose(0, 2, 1))
    for k, d in net.learn(dx[:-1], met.lexicon, words).items():
        for i in zip(*(a[:8] for a in np.nonzero(d))):
            side = []
            for e in (1e-3, -1e-3):
                net.p[k][i] += e
                side.append(net.gradients(met.inputs(some, net)[0], met.mask, y)[1])
                net.p[k][i] -= e
            assert abs(d[i] - (side[0] - side[1]) / 2e-3) < 1e-4


def test_scoring_meets_words_as_training_does():
    texts = ["you are a moron", "", "a fine day " * 20, "no"]
    model = toxicity.Model(texts * 3, [1, 0, 0, 1] * 3)
    words = [toxicity.split(t) for t in texts]
    inputs = model.inputs()
    met = toxicity.Windows(words, toxicity.Inputs(model.tables).of(words))
    x, mask = toxicity.batch(inputs.of(words), *toxicity.windows(np.array([len(w) for w in words]))[:2])
    assert np.allclose(x, met.inputs(np.arange(x.shape[2]), model.net)[0], atol=1e-5) and (mask == met.mask).all()


def test_windows_cover_every_word():
    sizes = np.array([0, 1, 16, 31, 32, 33, 48, 49, 200])
    start, length, first = toxicity.windows(sizes)
    ends = [*first[1:], len(start)]
    for k, (a, b) in enumerate(zip(first, ends)):
        base = sizes[:k].sum()
        assert set().union(*(range(s, s + n) for s, n in zip(start[a:b], length[a:b]))) == set(range(base, base + sizes[k]))
        assert (np.diff(start[a:b]) == toxicity.STRIDE).all() and b > a


def test_toxicity_on_held_out_rows(spark):
    """Half of the toxic rows there hold none of the words that mark the others."""
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    held = toxicity.fold(F.col("doc_id")) == 2
    model = toxicity.train(docs, labels, ~held)
    rows = toxicity.score(docs.join(F.broadcast(labels.select("doc_id")), "doc_id").where(held), model).join(labels, "doc_id").collect()
    bad, good = [r["score"] for r in rows if r["toxic"] == 1], [r["score"] for r in rows if r["toxic"] == 0]
    assert np.mean([s >= 0.3 for s in bad]) > 0.9 and np.mean([s >= 0.3 for s in good]) < 0.08
    odd = toxicity.score(docs_of(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert odd[0]["score"] == odd[1]["score"] and toxicity.score(empty(spark), model).count() == 0


def test_forward_pass_by_a_plain_loop():
    """One window at a time, one word at a time, by the equations of the network."""
    rng = np.random.default_rng(7)
    net = toxicity.Net(rng)
    lengths = np.array([32, 3, 1])
    x = rng.standard_normal((toxicity.WIDTH, toxicity.INPUTS, 3)).astype(np.float32)
    mask = (np.arange(toxicity.WIDTH)[:, None] < lengths).astype(np.float32)
    got, h, p = net.forward(x, mask), toxicity.HIDDEN, net.p
    sig = lambda v: 1 / (1 + np.exp(-v))
    for k, n in enumerate(lengths):
        sides = []
        for d, order in (("f", range(n)), ("b", reversed(range(n)))):
            state, out = np.zeros(h), {}
            for t in order:
                a, b = p["W" + d] @ x[t, :, k] + p["c" + d][:, 0], p["U" + d] @ state
                z, r = sig(a[:h] + b[:h]), sig(a[h : 2 * h] + b[h : 2 * h])
                state = (1 - z) * np.tanh(a[2 * h :] + r * b[2 * h :]) + z * state
                out[t] = state
            sides.append(out)
        hs = [np.concatenate([sides[0][t], sides[1][t]]) for t in range(n)]
        e = np.exp([float(p["v"][0] @ np.tanh(p["A"] @ v + p["a"][:, 0])) for v in hs])
        assert abs(got[k] - float(p["w"][0] @ sum(w * v for w, v in zip(e / e.sum(), hs)) + p["o"][0, 0])) < 1e-4


def test_two_rows_train(spark):
    docs = docs_of(spark, ["you are a moron", "a fine day", None])
    model = toxicity.train(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"), F.lit(True))
    assert model.net is not None and all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect())


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(docs_of(spark, ["a", "b", "c"]), labels, F.lit(True))
    assert {r["score"] for r in toxicity.score(docs_of(spark, ODD), model).collect()} == {1.0}
    assert toxicity.train(empty(spark), labels, F.lit(True)).constant == 0.0


def test_fold_is_the_contracts(spark):
    got = spark.range(50).select("id", toxicity.fold(F.col("id")).alias("f")).collect()
    assert all(r["f"] == crc32(str(r["id"]).encode()) % 4 for r in got)


@pytest.mark.parametrize("name", ["url_rules", "secret_counts"])
def test_parts_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DIR).toPandas(), con.execute(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    rows = lambda df: sorted(map(repr, df[cols].itertuples(index=False, name=None)))
    assert cols == sorted(want.columns) and rows(got) == rows(want)


# Digests


def test_digest_columns(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for r in queries.op10_secrets(spark, DIR).collect():
        spans = secrets.find([text[r["doc_id"]]])[0]
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    for r in queries.op3_bpe(spark, DIR).limit(20).collect():
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
