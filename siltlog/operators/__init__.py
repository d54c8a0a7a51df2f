"""Reads of a mutation log as DataFrame to DataFrame functions.

A log has columns key, seq, op ('P' put, 'D' delete) and value. The newest row of a key, by seq, is
its state; (key, seq) must be unique. All functions are lazy; a range on the key is pushed below the
aggregation and into the scan by Catalyst.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DELETE, PUT, UNBOUNDED, Bound
from ..sources import scratch


def literal(key: bytes, kind: str) -> Column:
    return F.lit(key.decode()) if kind == "string" else F.lit(bytearray(key))


def within(df: DataFrame, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, key: str = "key") -> DataFrame:
    """Rows whose key lies in the range; none if the range is inverted."""
    kind = df.schema[key].dataType.simpleString()
    if lower.key is not None and upper.key is not None and lower.key > upper.key:
        return df.where(F.lit(False))
    if lower.key is not None:
        edge = literal(lower.key, kind)
        df = df.where(F.col(key) >= edge if lower.inclusive else F.col(key) > edge)
    if upper.key is not None:
        edge = literal(upper.key, kind)
        df = df.where(F.col(key) <= edge if upper.inclusive else F.col(key) < edge)
    return df


def latest(log: DataFrame) -> DataFrame:
    """The newest row of each key, deletions included: key, seq, op, value.

    The one place that defines recency. Partial aggregation keeps a row for each key and task.
    """
    newest = log.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("op", "value"), "seq").alias("_v"))
    return newest.select("key", "seq", F.col("_v.op").alias("op"), F.col("_v.value").alias("value"))


def live(newest: DataFrame) -> DataFrame:
    return newest.where(F.col("op") == PUT).select("key", "value")


def get(log: DataFrame, key: bytes) -> DataFrame:
    """The pair of a key: one row, or none if it was never put or is deleted."""
    return live(latest(within(log, Bound.at(key), Bound.at(key))))


def multi_get(log: DataFrame, wanted: DataFrame, broadcast: bool = False) -> DataFrame:
    """The pairs of the keys in ``wanted``; the join comes before the aggregation."""
    keys = wanted.select("key").distinct()
    return live(latest(log.join(F.broadcast(keys) if broadcast else keys, "key", "left_semi")))


def scan(log: DataFrame, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> DataFrame:
    """The live pairs in the range. Order them by key where order matters."""
    return live(latest(within(log, lower, upper)))


def keys(log: DataFrame, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> DataFrame:
    """The live keys in the range; values aren't read."""
    newest = within(log, lower, upper).groupBy("key").agg(F.max_by("op", "seq").alias("op"))
    return newest.where(F.col("op") == PUT).select("key")


def tombstones(log: DataFrame) -> DataFrame:
    return latest(log).where(F.col("op") == DELETE).select("key", "seq")


def dealt(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """``df`` written once by range of ``order``, with the ordinal ``__part`` of each row's range."""
    spark = df.sparkSession
    path = scratch(spark, name)
    rows = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__part", F.spark_partition_id())
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def history(log: DataFrame) -> DataFrame:
    """All versions, ``version`` 1 being the newest of its key.

    Rows are dealt by range of key and seq, and numbered within their part: a key of any size is spread
    over tasks. Only the first key of a part can have begun before it; its rows move up by what the parts
    before hold of it, a table of at most two rows a part.
    """
    rows = dealt(log, F.col("key"), F.desc("seq"), name="history")
    firsts = rows.groupBy("__part").agg(F.min("key").alias("key")).select("key").distinct()
    held = rows.join(F.broadcast(firsts), "key", "left_semi").groupBy("key", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    moved = held.select("key", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part", "key").orderBy(F.desc("seq")))
    numbered = rows.withColumn("version", inside).join(F.broadcast(moved), ["key", "__part"], "left")
    return numbered.withColumn("version", (F.col("version") + F.coalesce("__before", F.lit(0))).cast("int")).select(*log.columns, "version")


def concat(*runs: DataFrame) -> DataFrame:
    """Runs that share no key, end to end."""
    return reduce(DataFrame.unionByName, runs)


def merge(*runs: DataFrame) -> DataFrame:
    """Runs that may share keys: the newest row of each key over all."""
    return latest(concat(*runs))


def prefer(a: DataFrame, b: DataFrame) -> DataFrame:
    """All of ``a``, and of ``b`` the rows whose key ``a`` lacks. Keys are unique within each."""
    return a.unionByName(b.join(a.select("key"), "key", "left_anti").select(*a.columns))


def write_profile(log: DataFrame, *by: str) -> DataFrame:
    """Writes and their bytes of key and value, for each group."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("write_num"), F.sum(size).cast("long").alias("write_bytes"))


def run_meta(log: DataFrame, run: str = "run") -> DataFrame:
    """First and last key, rows and bytes of each run."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return log.groupBy(run).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("n_rows"), F.sum(size).cast("long").alias("bytes"))


def overlapping(meta: DataFrame, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> DataFrame:
    """The runs that can hold keys of the range."""
    reach = within(meta, Bound(lower.key, lower.inclusive), UNBOUNDED, "last_key")
    return within(reach, UNBOUNDED, Bound(upper.key, upper.inclusive), "first_key")


def overlapping_pairs(meta: DataFrame, run: str = "run") -> DataFrame:
    """Pairs of runs (a < b) whose key ranges, bounds included, meet.

    A sweep over the bounds in their order. The runs that meet one and begin after it follow it in the
    order of first keys, up to the number that have begun by its last key: they are joined by that
    ordinal, so that only pairs that meet are made. Bounds are counted by parts, none in one task.
    """
    bound = lambda key, end: F.struct(F.col(key).alias("key"), F.lit(end).alias("end"))
    bounds = meta.select(F.col(run).alias("run"), F.explode(F.array(bound("first_key", False), bound("last_key", True))).alias("at")).select("run", "at.key", "at.end")
    order = [F.col("key"), F.col("end"), F.col("run")]
    rows = dealt(bounds, *order, name="bounds")
    begun = F.sum((~F.col("end")).cast("long"))
    before = rows.groupBy("__part").agg(begun.alias("__n"))
    # One row for each part.
    before = before.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = begun.over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    at = rows.withColumn("at", inside).join(F.broadcast(before), "__part").select("run", "end", (F.col("at") + F.col("__before")).alias("at"))
    one = at.groupBy("run").agg(F.min(F.when(~F.col("end"), F.col("at"))).alias("at"), F.max(F.when(F.col("end"), F.col("at"))).alias("to"))
    met = one.where(F.col("to") > F.col("at")).select(F.col("run").alias("x"), F.explode(F.sequence(F.col("at") + 1, F.col("to"))).alias("at"))
    pairs = met.join(one.select(F.col("run").alias("y"), "at"), "at")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
