"""Where the log lies: sorted Parquet runs, and manifests that name the runs of each version.

All file access goes through Spark and Hadoop's FileSystem, so that any store Spark reaches will do.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
import zlib
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MUTATIONS, Options, Run


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a local one only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siltlog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Files:
    """The few file operations that a driver needs, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def listed(self, p: str) -> list[tuple[str, int]]:
        """Names and sizes of what lies in a folder; nothing if it isn't there."""
        at = self.path(p)
        return [(s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def older(self, p: str, age: float) -> list[str]:
        """Names of what lies in a folder and was last changed at least ``age`` seconds ago."""
        at, last = self.path(p), (time.time() - age) * 1000
        return [s.getPath().getName() for s in self.fs.listStatus(at) if s.getModificationTime() <= last] if self.fs.exists(at) else []

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, p: str, text: str) -> None:
        """Write a file that wasn't there, whole or not at all; FileExistsError if it was."""
        draft, target = self.path(f"{p}.{uuid.uuid4().hex}.tmp"), self.path(p)
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(draft, target, options)
        except Exception as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(p) from None
            raise

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)


@dataclass(frozen=True)
class Version:
    """A state of the log: runs, and the counters of what comes next."""

    number: int = 0
    next_run: int = 1
    runs: tuple[Run, ...] = ()
    note: str = ""
    extra: dict = field(default_factory=dict)

    def text(self) -> str:
        runs = [asdict(r) | {"first_key": r.first_key.hex(), "last_key": r.last_key.hex()} for r in self.runs]
        body = json.dumps({"number": self.number, "next_run": self.next_run, "note": self.note, "extra": self.extra, "runs": runs})
        return f"{zlib.crc32(body.encode()):08x}\n{body}"

    @staticmethod
    def of(text: str) -> Version:
        """The version of a manifest file; ValueError if its checksum isn't that of its content."""
        crc, _, body = text.partition("\n")
        if crc != f"{zlib.crc32(body.encode()):08x}":
            raise ValueError("a manifest's checksum doesn't match its content")
        d = json.loads(body)
        runs = tuple(Run(**(r | {"first_key": bytes.fromhex(r["first_key"]), "last_key": bytes.fromhex(r["last_key"])})) for r in d["runs"])
        return Version(d["number"], d["next_run"], runs, d["note"], d["extra"])


class Manifest:
    """Numbered versions, one file each. A commit that finds its number taken is refused."""

    def __init__(self, spark: SparkSession, root: str):
        self.files, self.root = Files(spark, root), f"{root}/manifest"

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n, _ in self.files.listed(self.root) if n.endswith(".json"))

    def load(self, number: int | None = None) -> Version:
        known = self.numbers()
        if not known and number is None:
            return Version()
        if number is not None and number not in known:
            raise KeyError(f"no version {number}")
        return Version.of(self.files.read(f"{self.root}/{(known[-1] if number is None else number):020d}.json"))

    def commit(self, version: Version) -> Version:
        self.files.create(f"{self.root}/{version.number:020d}.json", version.text())
        return version


def write_run(df: DataFrame, path: str, files: int, options: Options, rows: int | None = None) -> None:
    """Key-sorted Parquet files of disjoint ranges of key and seq. A key of many rows is spread over files.

    Pages hold about ``block_bytes`` and carry checksums. Each file has a Bloom filter of its keys, sized
    by the ``rows`` of all files, or fitted by the writer to what it meets if they aren't known.
    """
    spread = df.repartitionByRange(files, "key", F.desc("seq")) if files > 1 else df.coalesce(1)
    out = spread.sortWithinPartitions("key", F.desc("seq")).write
    out = out.option("parquet.page.size", str(options.block_bytes)).option("parquet.page.write-checksum.enabled", "true")
    if options.bloom_fpp:
        out = out.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(options.bloom_fpp))
        out = out.option("parquet.bloom.filter.expected.ndv#key", str(max(1, rows // files))) if rows is not None else out.option("parquet.bloom.filter.adaptive.enabled", "true")
    out.parquet(path)


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of the runs; a page that doesn't match its checksum fails the read."""
    if not paths:
        return spark.createDataFrame([], MUTATIONS)
    return spark.read.schema(MUTATIONS).option("parquet.page.verify-checksum.enabled", "true").parquet(*paths)


def runs_at(spark: SparkSession, path: str, level: int, first_id: int, unique: bool) -> list[Run]:
    """What a folder that write_run() filled holds: one run for each file that has rows.

    The bounds of a file are the keys of its first and last row. Only numbers are aggregated: the least of
    binary keys would have each task sort all of its rows.
    """
    rows = spark.read.schema(MUTATIONS).parquet(path).select("key", "op", "_metadata.file_path", "_metadata.file_size", F.col("_metadata.row_index").alias("at"))
    per = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("op") == "D", 1)).alias("t"), F.max("file_size").alias("s"))
    ends = per.select("*", F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.col("n") - 1))).alias("at"))
    found = {}
    for r in rows.select("file_path", "at", "key").join(F.broadcast(ends), ["file_path", "at"]).collect():
        found.setdefault(r["file_path"], []).append(r)
    files = sorted((sorted(f, key=lambda r: r["at"]) for f in found.values()), key=lambda f: (bytes(f[0]["key"]), f[0]["file_path"]))
    return [Run(first_id + i, level, a["file_path"], bytes(a["key"]), bytes(b["key"]), a["n"], a["s"], a["t"], unique) for i, (a, *_, b) in enumerate([*f, f[-1]] for f in files)]
