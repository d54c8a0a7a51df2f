"""The store against a dictionary, before and after flush, compaction and reopening."""

import random

import pytest
from pyspark.sql import functions as F

from siltlog import plans
from siltlog.schema import UNBOUNDED, Bound, Compaction, Options, Run
from siltlog.store import Store


@pytest.fixture
def root(tmp_path):
    return "file://" + str(tmp_path / "store")


def pairs(store, *ends):
    return [(bytes(r["key"]), bytes(r["value"])) for r in store.pairs(*ends).collect()]


def small(**k):
    return Options(target_run_bytes=1 << 12, auto=False, compaction=Compaction(multiplier=2, l0_trigger=2, max_levels=3, base_bytes=1 << 11), **k)


def test_overwrites_and_deletes_survive_reopening(spark, root):
    store = Store(spark, root, small())
    for i in range(6):
        one = ("1", f"v{i}") if i % 2 == 0 else ("1", "")
        two = ("2", f"v{i}") if i % 2 else ("2", "")
        store.fill([("0", f"v{i}"), one, two])
        if i % 2:
            store.flush()
    store.compact_all()
    again = Store(spark, root, small())
    assert again.get("0") == b"v5" and again.get("1") is None and again.get("2") == b"v5"
    assert pairs(again) == [(b"0", b"v5"), (b"2", b"v5")]


def test_put_delete_get_and_rules(spark, root):
    store = Store(spark, root)
    store.put("k", b"\xff\x00")
    assert store.get("k") == b"\xff\x00"
    store.delete("k")
    store.delete("never there")
    assert store.get("k") is None and pairs(store) == []
    for bad in (lambda: store.put("", "x"), lambda: store.delete(""), lambda: store.fill([("a", "1"), ("", "2")])):
        with pytest.raises(ValueError):
            bad()
    before = store.state.number
    assert store.fill([]) == before
    store.fill([("a", "1"), ("a", "2"), ("b", "1"), ("b", "")])
    assert pairs(store) == [(b"a", b"2")]


def test_ranges_over_every_kind_of_bound(spark, root):
    store = Store(spark, root)
    held = {k: k + b"!" for k in (b"a", b"ab", b"b", b"z", b"\x7f", b"\x80", b"\xff")}
    store.fill(list(held.items()))
    store.flush()
    edges = [UNBOUNDED, *(f(k) for k in (b"ab", b"c", b"\x80") for f in (Bound.at, Bound.past))]
    for low in edges:
        for high in edges:
            over = lambda k: low.key is None or k > low.key or low.inclusive and k == low.key  # noqa: B023, E731
            under = lambda k: high.key is None or k < high.key or high.inclusive and k == high.key  # noqa: B023, E731
            want = sorted((k, v) for k, v in held.items() if over(k) and under(k))
            if (low, high) in [(edges[0], edges[1]), (edges[2], edges[5])] or len(want) in (0, 1):
                assert pairs(store, low, high) == want
                assert sorted(bytes(r["key"]) for r in store.keys(low, high).collect()) == [k for k, _ in want]


def test_a_range_between_two_keys_is_empty(spark, root):
    store = Store(spark, root)
    store.fill([("a", "1"), ("z", "1")])
    store.flush()
    assert pairs(store, Bound.at("b"), Bound.at("c")) == []
    assert pairs(store, Bound.at("c"), Bound.at("b")) == []


def test_only_tombstones_compact_to_nothing(spark, root):
    store = Store(spark, root, small())
    store.put("a", "1")
    store.flush()
    store.delete("a")
    store.flush()
    store.compact_all()
    assert pairs(store) == [] and all(r.tombstones == 0 for r in store.state.runs if r.level == 3)


def test_a_deletion_outlives_compaction_past_an_older_run(spark, root):
    """A run that isn't merged still holds an older version: the deletion must stay."""
    store = Store(spark, root, small())
    store.put("k", "old")
    store.flush()
    kept = store.state.runs[0]
    store.delete("k")
    store.flush()
    newer = [r for r in store.state.runs if r.run_id != kept.run_id]
    store._rewrite(newer, 3, True, "compaction")
    assert store.get("k") is None


def test_dictionary_model_and_versions(spark, root):
    rng, model, store = random.Random(5), {}, Store(spark, root, small())
    for step in range(4):
        rows = [(f"{rng.randrange(300):04d}", "" if rng.random() < 0.3 else f"{step}-{i}") for i in range(400)]
        df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "key string, value string, n long")
        store.fill_from(df, "n", files=2)
        for k, v in rows:
            model.pop(k, None) if not v else model.update({k: v})
        if step == 1:
            middle, number = dict(model), store.state.number
        if step % 2:
            store.flush()
    want = sorted((k.encode(), v.encode()) for k, v in model.items())
    assert pairs(store) == want
    store.flush()
    store.compact_all()
    assert pairs(store) == want and pairs(Store(spark, root)) == want
    assert pairs(store.at(number)) == sorted((k.encode(), v.encode()) for k, v in middle.items())
    with pytest.raises(ValueError):
        store.at(number).put("x", "y")
    wanted = spark.createDataFrame([("0007",), ("0008",), ("nope",), ("0007",)], "key string")
    assert sorted(bytes(r["key"]).decode() for r in store.multi_get(wanted).collect()) == [k for k in ("0007", "0008") if k in model]
    assert store.vacuum() == [] and store.vacuum(age=0) and pairs(Store(spark, root)) == want


def test_large_records(spark, root):
    store = Store(spark, root)
    rows = spark.range(60).select(F.concat(F.lit(b"\0" * 20476), F.unhex(F.lpad(F.hex("id"), 8, "0"))).alias("key"), F.concat(F.lit(b"\0" * 20476), F.unhex(F.lpad(F.hex("id"), 8, "0"))).alias("value"), "id")
    store.fill_from(rows, "id")
    store.flush()
    assert store.scan().count() == 60 and store.get(b"\0" * 20476 + (7).to_bytes(4, "big")) is not None


def test_bad_rows_fail_the_whole_batch(spark, root):
    store = Store(spark, root)
    for rows in ([("", "x", 0)], [(None, "x", 0)], [("a", "x", -1)], [("a", "x", None)]):
        with pytest.raises(Exception, match="key is empty|out of range"):
            store.fill_from(spark.createDataFrame(rows, "key string, value string, n long"), "n", files=1)
    assert store.state.number == 0 and pairs(store) == []
    store.fill_from(spark.createDataFrame([], "key string, value string, n long"), "n", files=2)
    assert pairs(store) == []


def test_the_slower_of_two_writers_is_refused(spark, root):
    a, b = Store(spark, root), Store(spark, root)
    a.put("k", "a")
    with pytest.raises(FileExistsError):
        b.put("k", "b")
    assert Store(spark, root).get("k") == b"a"


def run(i, level, a, b, size, unique=True):
    return Run(i, level, "", a.encode(), b.encode(), 1, size, 0, unique)


def test_level_targets_and_base_level():
    p = Compaction(multiplier=4, max_levels=4, base_bytes=100)
    assert plans.level_targets([0, 0, 0, 50], p) == [0, 0, 0, 100]
    assert plans.level_targets([0, 0, 0, 1000], p) == [0, 62, 250, 1000]
    assert plans.base_level([0, 62, 250, 1000]) == 2


def test_choice_of_tasks():
    p = Compaction(multiplier=4, l0_trigger=2, max_levels=2, base_bytes=100)
    assert plans.next_task([run(1, 0, "a", "c", 10)], p) is None
    task = plans.next_task([run(1, 0, "a", "c", 10), run(2, 0, "b", "d", 10), run(3, 2, "a", "b", 10), run(4, 2, "x", "z", 10)], p)
    assert task == plans.Task((1, 2), (3,), 2, True)
    task = plans.next_task([run(7, 1, "a", "c", 90), run(5, 1, "k", "m", 90), run(3, 2, "l", "p", 400)], p)
    assert task == plans.Task((5,), (3,), 2, True)


def test_pruning_and_disjointness():
    r = run(1, 1, "b", "d", 1)
    assert plans.reaches(r, Bound.at("d"), UNBOUNDED) and not plans.reaches(r, Bound.past("d"), UNBOUNDED)
    assert plans.reaches(r, UNBOUNDED, Bound.at("b")) and not plans.reaches(r, UNBOUNDED, Bound.past("b"))
    assert plans.settled([r, run(2, 1, "e", "f", 1)]) and not plans.settled([r, run(2, 1, "d", "f", 1)])


def test_many_puts_leave_staging_by_themselves(spark, root):
    store = Store(spark, root, Options(staging_files=4))
    for i in range(9):
        store.put(f"k{i % 5}", f"v{i}")
    assert sum(r.level == -1 for r in store.state.runs) < 4 and any(r.level >= 0 for r in store.state.runs)
    assert pairs(store) == [(f"k{k}".encode(), f"v{max(i for i in range(9) if i % 5 == k)}".encode()) for k in range(5)]


def test_bytes_trigger_a_flush_and_compaction_to_rest(spark, root):
    """The shape bounds of the leveled policy: each level against the last, and the runs that a read opens."""
    policy = Compaction(multiplier=2, l0_trigger=2, max_levels=4, base_bytes=1 << 13)
    store = Store(spark, root, Options(target_run_bytes=1 << 13, staging_limit=1, compaction=policy))
    for i in range(6):
        rows = spark.range(400).select(F.lpad((F.col("id") + 100 * i).cast("string"), 8, "0").alias("key"), F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"x{i}")), 256).alias("value"), "id")
        store.fill_from(rows, "id", files=1)
    sizes = [sum(r.bytes for r in store.state.runs if r.level == k) for k in range(5)]
    assert not plans.pending_flush(list(store.state.runs), store.options) and plans.next_task(list(store.state.runs), policy) is None
    assert sizes[4] > 0 and all(sizes[k] / sizes[4] <= 0.5 ** (4 - k) + 0.5 for k in range(1, 4))
    level0 = sum(r.level == 0 for r in store.state.runs)
    assert level0 < policy.l0_trigger and store.scan().count() == 900


def test_a_writer_that_comes_between_doesnt_fail_the_batch(spark, root, monkeypatch):
    store = Store(spark, root, Options(staging_files=2))
    store.put("a", "1")
    flush = Store.flush
    monkeypatch.setattr(Store, "flush", lambda self: (Store(spark, root, Options(auto=False)).put("b", "2"), flush(self))[1])
    store.put("c", "3")
    assert pairs(store) == [(b"a", b"1"), (b"b", b"2"), (b"c", b"3")]


def test_blocks_filters_and_checksums(spark, root):
    import glob

    import pyarrow.parquet as pq

    store = Store(spark, root, Options(block_bytes=4096, auto=False))
    rows = spark.range(5000).select(F.lpad(F.col("id").cast("string"), 8, "0").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("value"), "id")
    store.fill_from(rows, "id", files=1)
    store.flush()
    (path,) = [r.path for r in store.state.runs]
    file = path.removeprefix("file:")
    raw = open(file, "rb").read()
    meta = pq.ParquetFile(file).metadata.row_group(0).column(3)
    assert meta.total_compressed_size > 20 * 4096  # so that there are many pages
    wide = Store(spark, root + "-wide", Options(block_bytes=1 << 20, bloom_fpp=0, auto=False))
    wide.fill_from(rows, "id", files=1)
    wide.flush()
    assert len(raw) > len(open(wide.state.runs[0].path.removeprefix("file:"), "rb").read()) + 5000  # page headers and the filter
    at = meta.data_page_offset + meta.total_compressed_size // 2
    with open(file, "r+b") as f:
        f.seek(at)
        f.write(bytes(255 - x for x in raw[at : at + 8]))
    for crc in glob.glob(f"{file.rsplit('/', 1)[0]}/.*.crc"):
        __import__("os").remove(crc)
    with pytest.raises(Exception, match="(?i)crc|checksum|corrupt"):
        store.scan().collect()


def test_a_damaged_manifest_is_refused(spark, root):
    store = Store(spark, root)
    store.put("a", "1")
    file = store.manifest.root.removeprefix("file://") + f"/{1:020d}.json"
    text = open(file).read()
    open(file, "w").write(text.replace('"next_run": 2', '"next_run": 9'))
    __import__("os").path.exists(c := file.rsplit("/", 1)[0] + f"/.{1:020d}.json.crc") and __import__("os").remove(c)
    with pytest.raises(ValueError, match="checksum"):
        Store(spark, root)


def test_no_task_sorts_more_of_a_batch_as_it_grows(spark, root, monkeypatch):
    """Files grow in number with the batch, also where one key holds half of it; so do those of a merge."""
    monkeypatch.setattr(plans, "SORT_BYTES", 1 << 14, raising=False)
    key = F.when(F.col("id") % 2 == 0, F.lit("000500")).otherwise(F.lpad(F.col("id").cast("string"), 6, "0"))
    rows = spark.range(6000).select(key.alias("key"), F.col("id").cast("string").alias("value"), "id")
    store = Store(spark, root, Options(auto=False))
    store.fill_from(rows, "id", files=2)
    want = sorted([(b"000500", b"5998"), *((f"{i:06d}".encode(), str(i).encode()) for i in range(1, 6000, 2))])
    assert sum(r.n_rows for r in store.state.runs) == 6000 and max(r.n_rows for r in store.state.runs) < 600
    assert pairs(store) == want
    store.flush()
    assert sum(r.n_rows for r in store.state.runs) == 3001 and max(r.n_rows for r in store.state.runs) < 2500
    assert plans.settled(list(store.state.runs)) and pairs(store) == want and store.get("000500") == b"5998"
    before = len(store.state.runs)
    store.fill([(f"{i:06d}", "x" * 100) for i in range(500)])
    assert len(store.state.runs) > before + 2 and store.get("000499") == b"x" * 100


def test_bounds_of_runs_without_a_sort(spark, root, monkeypatch):
    plans_of, kind = [], type(spark.range(1))
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: (plans_of.append(df._jdf.queryExecution().executedPlan().toString()), collect(df))[1])
    store = Store(spark, root, small())
    store.fill_from(spark.range(900).select(F.expr("if(id = 0, X'FF', unhex(lpad(hex(id % 300), 4, '0')))").alias("key"), F.expr("if(id % 3 = 0, null, 'v')").alias("value"), "id"), "id", files=3)
    store.put("one", "row")
    monkeypatch.undo()
    assert plans_of and not any("SortAggregate" in p or "Sort " in p for p in plans_of)
    assert [r.run_id for r in store.state.runs] == list(range(1, len(store.state.runs) + 1))
    for r in store.state.runs:
        held = spark.read.parquet(r.path).collect()
        keys = [bytes(x["key"]) for x in held]
        assert (r.first_key, r.last_key, r.n_rows, r.tombstones) == (min(keys), max(keys), len(held), sum(x["op"] == "D" for x in held))
