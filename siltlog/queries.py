"""The engine's queries over the driver's tables, and the same in DuckDB SQL.

``events`` is read as a mutation log: the user is the key, ``error`` deletes, ``event_id`` orders.
``orders`` gives runs with staggered key ranges, ``conversations`` a channel log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import functions as fn
from . import introspect
from . import operators as ops
from . import plans
from .schema import UNBOUNDED, Bound, Compaction, Options
from .sources import scratch
from .store import Store
from .streaming import Channels, backlog, first_seen, publish_ids

# Keys that the point queries ask for; one that isn't there among them.
HIT, ABSENT = "0000000007", "0000999999"
WANTED = ["0000000003", "0000000007", "0000000011", "0000000042", "0000000099", ABSENT]
LOW, HIGH = "0000000010", "0000000040"
POLICY = Compaction(multiplier=4, max_levels=4, base_bytes=20_000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(c: str):
    return F.lpad(F.col(c).cast("string"), 10, "0")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(padded("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "D").otherwise("P").alias("op"), F.col("props").alias("value"))


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).withColumn("run", F.expr("seq div 1000"))


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in 12 runs of overlapping key ranges; an order lies in up to four of them."""
    o = table(spark, sf_dir, "orders")
    last = F.expr("least(11, o_orderkey div 1000)")
    first = F.greatest(F.lit(0).cast("long"), F.expr("o_orderkey div 1000") - 3)
    runs = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return o.select(padded("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"), F.explode_outer(runs).alias("run")).where("run IS NOT NULL")


def order_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.run_meta(order_runs(spark, sf_dir)).select("run", "first_key", "last_key", "n_rows", "bytes")


def bounds(low: str | None, low_in: bool, high: str | None, high_in: bool) -> tuple[Bound, Bound]:
    return (Bound(low.encode(), low_in) if low else UNBOUNDED), (Bound(high.encode(), high_in) if high else UNBOUNDED)


def scan_between(low: str | None, low_in: bool, high: str | None, high_in: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: ops.scan(event_log(s, d), *bounds(low, low_in, high, high_in))


def deleted_keys(log: DataFrame) -> DataFrame:
    return ops.tombstones(log).agg(F.min("key").alias("key"))


def get_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least deleted key, asked for: no rows."""
    log = event_log(spark, sf_dir)
    return ops.multi_get(log, deleted_keys(log))


def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.multi_get(event_log(spark, sf_dir), spark.createDataFrame([(k,) for k in WANTED], "key string"), broadcast=True)


def merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row within each run, then over all runs."""
    by = event_runs(spark, sf_dir).groupBy("key", "run").agg(F.max("seq").alias("seq"), F.max_by(F.struct("op", "value"), "seq").alias("v"))
    return ops.latest(by.select("key", "seq", "v.op", "v.value"))


def two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even runs' newest rows where a key has any, else odd runs'."""
    log = event_runs(spark, sf_dir)
    return ops.prefer(ops.latest(log.where("run % 2 = 0")), ops.latest(log.where("run % 2 = 1")))


def concat_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of disjoint key ranges, end to end, without a merge."""
    o = table(spark, sf_dir, "orders").select(padded("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"))
    cut = Bound.past("0000005000")
    return ops.concat(ops.within(o, UNBOUNDED, Bound.at("0000005000")), ops.within(o, cut))


def run_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.run_meta(event_runs(spark, sf_dir)).select("run", "first_key", "last_key", "n_rows", "bytes")


def prune_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = Bound.at("0000007000")
    return ops.overlapping(order_meta(spark, sf_dir), end, end).select("run")


def level_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real and target sizes of four levels, to which the runs are dealt by run modulo four."""
    sizes = run_meta(spark, sf_dir).groupBy((F.col("run") % 4 + 1).cast("int").alias("level")).agg(F.sum("bytes").alias("real"))
    # Four sums: the policy is arithmetic over the levels, done where the policy lives.
    real = {r["level"]: r["real"] for r in sizes.collect()}
    real = [real.get(i, 0) for i in range(1, 5)]
    targets = plans.level_targets(real, POLICY)
    base = plans.base_level(targets)
    return spark.createDataFrame([(i + 1, r, t, i + 1 == base) for i, (r, t) in enumerate(zip(real, targets))], "level int, real long, target long, is_base boolean")


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish_ids(table(spark, sf_dir, "conversations"), "role", "conv_id", "turn").select(F.col("role").alias("channel"), "msg_id", F.col("text").alias("payload"))


def prefix_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that each key shares with the first of its block, blocks being keys' first eight digits."""
    keys = event_log(spark, sf_dir).select("key").distinct().withColumn("block", F.substring("key", 1, 8))
    first = F.min("key").over(Window.partitionBy("block"))
    return keys.withColumn("first_key", first).select("key", "first_key", fn.common_prefix(F.col("key"), F.col("first_key")).cast("int").alias("overlap"))


def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.scan(event_log(spark, sf_dir)).select("key", fn.display(F.col("value").cast("binary")).alias("shown"))


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log read as a stream to its end, with the newest row of each key as its state."""
    src = scratch(spark, "stream")
    log = event_log(spark, sf_dir)
    log.repartition(3, "key").write.parquet(f"{src}/log")
    live = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/log")
    newest = live.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("v"))
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{src}/out/{n % 2}")
    query = newest.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{src}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{src}/out/{query.lastProgress['batchId'] % 2}").where("v.op = 'P'").select("key", "v.value")


def wal_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return log.select("seq", fn.record_crc(F.col("key"), F.when(F.col("op") == "P", F.col("value"))).alias("crc"))


def filled_store(spark: SparkSession, sf_dir: str, batches: int = 3) -> Store:
    """A store under a scratch folder, filled with ``events`` in ``batches`` commits."""
    store = Store(spark, scratch(spark, "store"), Options(target_run_bytes=64 << 10, auto=False, compaction=Compaction(base_bytes=64 << 10)))
    log = event_log(spark, sf_dir)
    last = (log.agg(F.max("seq")).first()[0] or 0) + 1
    edges = [last * i // batches for i in range(batches + 1)]
    for a, b in zip(edges, edges[1:]):
        part = log.where((F.col("seq") >= a) & (F.col("seq") < b))
        store.fill_from(part.select("key", F.when(F.col("op") == "P", F.col("value")).alias("value"), F.col("seq").alias("n")), "n", files=2)
    return store


def text_pairs(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_pairs(filled_store(spark, sf_dir).scan())


def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after flush, compaction to rest, and reopening."""
    store = filled_store(spark, sf_dir)
    store.flush()
    store.compact_all()
    return text_pairs(Store(spark, store.root, store.options).scan())


def store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = filled_store(spark, sf_dir)
    store.flush()
    return text_pairs(store.scan(Bound.at(LOW), Bound.past(HIGH)))


def store_put_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key deleted, one put anew, and one put for the first time, on top of the filled store."""
    store = filled_store(spark, sf_dir)
    store.delete(WANTED[0])
    store.put(HIT, "anew")
    store.put(ABSENT, "first")
    return text_pairs(store.scan())


def store_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log in a store that flushes and compacts by itself."""
    store = filled_store(spark, sf_dir, 1)
    own = Store(spark, scratch(spark, "own"), Options(target_run_bytes=1 << 12, staging_limit=1, compaction=Compaction(base_bytes=1 << 12)))
    log = store.log().select("key", F.when(F.col("op") == "P", F.col("value")).alias("value"), F.expr("seq % 4294967296").alias("n"))
    own.fill_from(log, "n", files=2)
    return text_pairs(own.scan())


def show_memtable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the committed batches, before a flush."""
    return introspect.memtable(filled_store(spark, sf_dir)).agg(F.sum("n_rows").alias("n_rows"))


def show_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the sorted runs, one for each key, after a flush."""
    store = filled_store(spark, sf_dir)
    store.flush()
    return introspect.sstable(store).join(store.run_table(), "run_id").agg(F.sum("n_rows").alias("n_rows"), F.sum("tombstones").alias("tombstones"))


def show_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels, and whether they hold runs, after one flush."""
    store = filled_store(spark, sf_dir)
    store.flush()
    return introspect.level(store).select("level", (F.size("run_ids") > 0).alias("held"))


def show_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return introspect.options(Store(spark, scratch(spark, "options"))).where("name <> 'root'")


def show_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests after three batches: one file each."""
    files = introspect.files(filled_store(spark, sf_dir))
    return files.where(F.col("file").endswith(".json")).select(F.regexp_replace("file", r"^0*|\.json$", "").alias("version"))


def channels_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels added in the order in which they appear, and read by another reader."""
    root = scratch(spark, "named")
    channels = Channels(spark, root)
    for r in first_seen(table(spark, sf_dir, "conversations"), "role", "conv_id", "turn").orderBy("channel_id").collect():
        channels.add(r["channel"])
        channels.add(r["channel"])
    return Channels(spark, root).names()


def channel_backlog_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel's messages, published to a channel log, streamed back to their end."""
    root = scratch(spark, "channels")
    out = f"{root}/out"
    channels = Channels(spark, root)
    log = conversation_log(spark, sf_dir)
    log.select("channel", "msg_id", F.col("payload").cast("binary").alias("payload")).write.parquet(channels.log_path)
    query = channels.stream("user").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.schema(T.StructType([T.StructField("msg_id", T.LongType()), T.StructField("payload", T.BinaryType())])).parquet(out)
    return got.select("msg_id", F.col("payload").cast("string").alias("payload"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_latest": lambda s, d: ops.scan(event_log(s, d)),
    "get_hit": lambda s, d: ops.get(event_log(s, d), HIT.encode()),
    "get_absent": lambda s, d: ops.get(event_log(s, d), ABSENT.encode()),
    "get_deleted": get_deleted,
    "multi_get": multi_get,
    "scan_in_in": scan_between(LOW, True, HIGH, True),
    "scan_ex_ex": scan_between(LOW, False, HIGH, False),
    "scan_in_unb": scan_between(LOW, True, None, True),
    "scan_unb_ex": scan_between(None, True, HIGH, False),
    "scan_inverted": scan_between(HIGH, True, LOW, True),
    "keys_range": lambda s, d: ops.keys(event_log(s, d), Bound.at(LOW), Bound.at(HIGH)),
    "latest_with_tombstones": lambda s, d: ops.latest(event_log(s, d)),
    "tombstones": lambda s, d: ops.tombstones(event_log(s, d)),
    "version_history": lambda s, d: ops.history(event_log(s, d)).select("key", "seq", "op", "version"),
    "merge_runs": merge_runs,
    "two_way_prefer_a": two_way,
    "concat_scan": concat_scan,
    "run_meta": run_meta,
    "prune_runs": lambda s, d: ops.overlapping(order_meta(s, d), Bound.at("0000005000"), Bound.at("0000005200")).select("run"),
    "prune_get": prune_get,
    "overlapping_runs": lambda s, d: ops.overlapping_pairs(order_meta(s, d)),
    "write_profile": lambda s, d: ops.write_profile(event_runs(s, d), "run"),
    "level_targets": level_targets,
    "publish_ids": lambda s, d: conversation_log(s, d).select("channel", "msg_id", F.octet_length("payload").cast("long").alias("bytes")),
    "channel_backlog": lambda s, d: backlog(conversation_log(s, d), "user"),
    "channels_show": lambda s, d: first_seen(table(s, d, "conversations"), "role", "conv_id", "turn"),
    "prefix_overlap": prefix_overlap,
    "display_values": display_values,
    "stream_latest": stream_latest,
    "channel_tail": channel_backlog_tail,
    "wal_crc": wal_crc,
    "store_scan": store_scan,
    "store_compacted": store_compacted,
    "store_range": store_range,
    "store_put_delete": store_put_delete,
    "store_auto": store_auto,
    "show_memtable": show_memtable,
    "show_sstable": show_sstable,
    "show_level": show_level,
    "show_options": show_options,
    "show_files": show_files,
    "channels_recovered": channels_recovered,
}

LOG = "log AS (SELECT lpad(CAST(user_id AS VARCHAR), 10, '0') AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END AS op, props AS value, event_id // 1000 AS run FROM events)"
NEWEST = "newest AS (SELECT key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS v FROM log) WHERE v = 1)"
ORDER_RUNS = "r AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, o_orderpriority AS value, i AS run FROM orders, (SELECT unnest(range(12)) AS i) WHERE o_orderkey >= i * 1000 AND o_orderkey < i * 1000 + 4000), m AS (SELECT run, min(key) AS first_key, max(key) AS last_key FROM r GROUP BY run)"
PUBLISHED = "p AS (SELECT role AS channel, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) + dense_rank() OVER (PARTITION BY role ORDER BY conv_id) - 1 AS msg_id, text AS payload FROM conversations)"
META = "meta AS (SELECT run, min(key) AS first_key, max(key) AS last_key, count(*) AS n_rows, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM log GROUP BY run)"


def live_where(condition: str = "true") -> str:
    return f"WITH {LOG}, {NEWEST} SELECT key, value FROM newest WHERE op = 'P' AND {condition}"


BETWEEN = f"key >= '{LOW}' AND key <= '{HIGH}'"
ORACLES: dict[str, str] = {
    "scan_latest": live_where(),
    "get_hit": live_where(f"key = '{HIT}'"),
    "get_absent": live_where(f"key = '{ABSENT}'"),
    "get_deleted": live_where("key = (SELECT min(key) FROM newest WHERE op = 'D')"),
    "multi_get": live_where("key IN (" + ", ".join(f"'{k}'" for k in WANTED) + ")"),
    "scan_in_in": live_where(BETWEEN),
    "scan_ex_ex": live_where(f"key > '{LOW}' AND key < '{HIGH}'"),
    "scan_in_unb": live_where(f"key >= '{LOW}'"),
    "scan_unb_ex": live_where(f"key < '{HIGH}'"),
    "scan_inverted": live_where("false"),
    "keys_range": f"WITH {LOG}, {NEWEST} SELECT key FROM newest WHERE op = 'P' AND {BETWEEN}",
    "latest_with_tombstones": f"WITH {LOG}, {NEWEST} SELECT * FROM newest",
    "tombstones": f"WITH {LOG}, {NEWEST} SELECT key, seq FROM newest WHERE op = 'D'",
    "version_history": f"WITH {LOG} SELECT key, seq, op, CAST(row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS INTEGER) AS version FROM log",
    "merge_runs": f"WITH {LOG}, {NEWEST} SELECT * FROM newest",
    "two_way_prefer_a": f"WITH {LOG} SELECT key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run % 2, seq DESC) AS v FROM log) WHERE v = 1",
    "concat_scan": "SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, o_orderpriority AS value FROM orders",
    "run_meta": f"WITH {LOG}, {META} SELECT * FROM meta",
    "prune_runs": f"WITH {ORDER_RUNS} SELECT run FROM m WHERE first_key <= '0000005200' AND last_key >= '0000005000'",
    "prune_get": f"WITH {ORDER_RUNS} SELECT run FROM m WHERE first_key <= '0000007000' AND last_key >= '0000007000'",
    "overlapping_runs": f"WITH {ORDER_RUNS} SELECT x.run AS a, y.run AS b FROM m x JOIN m y ON x.run < y.run AND x.first_key <= y.last_key AND y.first_key <= x.last_key",
    "write_profile": f"WITH {LOG}, {META} SELECT run, n_rows AS write_num, bytes AS write_bytes FROM meta",
    "level_targets": f"""WITH {LOG}, {META},
z AS (SELECT l AS level, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS real FROM (SELECT unnest(range(1, 5)) AS l) LEFT JOIN meta ON run % 4 + 1 = l GROUP BY l),
t4 AS (SELECT greatest(real, {POLICY.base_bytes}) AS t FROM z WHERE level = 4),
t3 AS (SELECT CASE WHEN t > {POLICY.base_bytes} THEN t // {POLICY.multiplier} ELSE 0 END AS t FROM t4),
t2 AS (SELECT CASE WHEN t > {POLICY.base_bytes} THEN t // {POLICY.multiplier} ELSE 0 END AS t FROM t3),
t1 AS (SELECT CASE WHEN t > {POLICY.base_bytes} THEN t // {POLICY.multiplier} ELSE 0 END AS t FROM t2),
a AS (SELECT 1 AS level, t FROM t1 UNION ALL SELECT 2, t FROM t2 UNION ALL SELECT 3, t FROM t3 UNION ALL SELECT 4, t FROM t4)
SELECT CAST(z.level AS INTEGER) AS level, real, CAST(t AS BIGINT) AS target, z.level = (SELECT min(level) FROM a WHERE t > 0) AS is_base FROM z JOIN a ON z.level = a.level""",
    "publish_ids": f"WITH {PUBLISHED} SELECT channel, msg_id, strlen(payload) AS bytes FROM p",
    "channel_backlog": f"WITH {PUBLISHED} SELECT msg_id, payload FROM p WHERE channel = 'user'",
    "channels_show": "SELECT row_number() OVER (ORDER BY c, t) AS channel_id, channel FROM (SELECT role AS channel, min(conv_id) AS c, arg_min(turn, (conv_id, turn)) AS t FROM conversations GROUP BY role)",
    "prefix_overlap": """WITH k AS (SELECT DISTINCT lpad(CAST(user_id AS VARCHAR), 10, '0') AS key FROM events),
f AS (SELECT key, min(key) OVER (PARTITION BY key[1:8]) AS first_key FROM k)
SELECT key, first_key, CAST(len(list_filter(range(1, 11), lambda i: key[1:i] = first_key[1:i])) AS INTEGER) AS overlap FROM f""",
    "display_values": f"WITH {LOG}, {NEWEST} SELECT key, value AS shown FROM newest WHERE op = 'P'",
    "stream_latest": live_where(),
    "channel_tail": f"WITH {PUBLISHED} SELECT msg_id, payload FROM p WHERE channel = 'user'",
    "store_scan": live_where(),
    "store_compacted": live_where(),
    "store_range": live_where(f"key >= '{LOW}' AND key < '{HIGH}'"),
    "store_put_delete": live_where(f"key NOT IN ('{WANTED[0]}', '{HIT}')") + f" UNION ALL VALUES ('{HIT}', 'anew'), ('{ABSENT}', 'first')",
    "store_auto": live_where(),
    "show_memtable": "SELECT count(*) AS n_rows FROM events",
    "show_sstable": f"WITH {LOG}, {NEWEST} SELECT count(*) AS n_rows, count(*) FILTER (op = 'D') AS tombstones FROM newest",
    "show_level": "SELECT CAST(l AS INTEGER) AS level, l = 0 AS held FROM (SELECT unnest(range(3)) AS l)",
    "show_options": "SELECT * FROM (VALUES ('target_run_bytes', '268435456'), ('staging_limit', '3'), ('staging_files', '64'), ('block_bytes', '16384'), ('bloom_fpp', '0.01'), ('auto', 'True'), ('compaction.multiplier', '4'), ('compaction.l0_trigger', '2'), ('compaction.max_levels', '2'), ('compaction.base_bytes', '2097152')) AS o(name, value)",
    "show_files": "SELECT CAST(unnest(range(1, 4)) AS VARCHAR) AS version",
    "channels_recovered": "SELECT row_number() OVER (ORDER BY c, t) AS channel_id, channel FROM (SELECT role AS channel, min(conv_id) AS c, arg_min(turn, (conv_id, turn)) AS t FROM conversations GROUP BY role)",
}
