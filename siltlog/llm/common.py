"""Shared pieces of the document operators: scratch tables, exact distributed ranks, Arrow slices."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates words, everywhere in this package: space and the five ASCII controls 09 to 0D.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes up to which a table is broadcast, and rows of one key from which that key is joined by broadcast.
BROADCAST, HOT = 64 << 20, 1 << 18
#: Lists that collect the paths of scratch tables, the innermost last.
_MADE: list[list[str]] = []
#: What empties the caches that operators keep in a Python worker from task to task.
KEPT: list[Callable[[], None]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    A temporary folder serves only a local master, where driver and executors are one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="siltlog-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: later steps start from files.

    A lost executor then costs its running tasks only. The plan runs once, where a reliable
    checkpoint would compute the last stage twice.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/siltlog-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _MADE:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def made() -> Iterator[list[str]]:
    """The paths of the scratch tables that are written inside, in their order."""
    paths: list[str] = []
    _MADE.append(paths)
    try:
        yield paths
    finally:
        _MADE.remove(paths)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing will read again."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Empty what operators keep in this Python worker, which Spark reuses, and give free memory back to the system."""
    for clear in KEPT:
        clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sweep(spark: SparkSession) -> None:
    """Have Spark delete the shuffles and broadcasts of ended plans now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bytes_of(df: DataFrame) -> int:
    """About the bytes that the rows of ``df`` hold in memory."""

    def size(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.StringType, T.BinaryType)):
                return F.coalesce(F.aggregate(c, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16), F.lit(0)) + 16
            return F.greatest(F.size(c), F.lit(0)) * 8 + 16
        return F.lit(32 if isinstance(kind, T.StructType) else 8)

    each = sum((size(F.col(f.name), f.dataType).cast("long") for f in df.schema.fields), F.lit(32).cast("long"))
    return df.agg(F.sum(each)).first()[0] or 0


def small(df: DataFrame) -> DataFrame:
    """``df``, a table on disk, marked for broadcast if its rows are found to be few enough bytes."""
    return F.broadcast(df) if bytes_of(df) <= BROADCAST else df


def spread_join(rows: DataFrame, known: DataFrame, on: list[str], how: str = "inner", n: str = "_n", whole: bool = True) -> DataFrame:
    """``rows`` joined with the table ``known``, which says with ``n`` how many rows each of its keys has.

    A small table is broadcast, unless ``whole`` is False. Of a larger one only the hot keys are, at most
    one for each HOT rows, and all other keys meet by shuffle: no task gets the rows of a hot key.
    """
    if whole and bytes_of(known) <= BROADCAST:
        return rows.join(F.broadcast(known.drop(n)), on, how)
    hot, rest = F.broadcast(known.where(F.col(n) >= HOT).drop(n)), known.where(F.col(n) < HOT).drop(n)
    others = rows.join(hot.select(*on).distinct(), on, "left_anti").join(rest, on, how)
    return others if how == "left_anti" else rows.join(hot, on, "left_semi" if how == "left_semi" else "inner").unionByName(others)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column is called so."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """_k1 and _k2: 128 hash bits of a document's id, null or not, and its text."""
    whole = [doc_id.isNull(), doc_id, text.isNull(), text]
    return [F.xxhash64(*whole).alias("_k1"), F.xxhash64(F.lit(1), *whole).alias("_k2")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of ``text`` as an array; empty for null, empty or blank texts."""
    trimmed = F.expr(f"trim(BOTH ' \\t\\n\\u000b\\f\\r' FROM {text})") if isinstance(text, str) else F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>"))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``most`` bytes of ``text`` at the most, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        begin, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < len(sizes):
            yield batch.slice(begin)


def ordered(df: DataFrame, *order: Column, name: str = "ordered", parts: int | None = None) -> DataFrame:
    """``df`` in files by the given order, with ``_part`` and ``_at``: ordinals of file range and row.

    Range partitions split any hot key as long as the order is unique; equal rows stay in one part.
    The rows are written, so that ordinals and rows agree in every later use.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    return cut(rows, name)
