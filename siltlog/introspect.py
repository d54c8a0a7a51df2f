"""What the store holds, how it is set, and what an operation cost."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import readable
from .schema import STAGING, UNBOUNDED, Bound
from .store import Store


def memtable(store: Store) -> DataFrame:
    """Committed batches that no flush has merged yet, newest first."""
    return store.run_table().where(F.col("level") == STAGING).select("run_id", "n_rows", "bytes").orderBy(F.desc("run_id"))


def sstable(store: Store) -> DataFrame:
    return store.run_table().where(F.col("level") > STAGING).select("run_id", "bytes").orderBy("run_id")


def level(store: Store) -> DataFrame:
    """The runs of each level from 0 on; levels without runs have an empty list."""
    spark, top = store.spark, store.options.compaction.max_levels
    held = store.run_table().where(F.col("level") > STAGING).groupBy("level").agg(F.sort_array(F.collect_list("run_id")).alias("run_ids"))
    return spark.range(top + 1).select(F.col("id").cast("int").alias("level")).join(held, "level", "left").select("level", F.coalesce("run_ids", F.array().cast("array<bigint>")).alias("run_ids")).orderBy("level")


def options(store: Store) -> DataFrame:
    o = asdict(store.options)
    policy = o.pop("compaction")
    rows = [("root", store.root), *o.items(), *((f"compaction.{k}", v) for k, v in policy.items())]
    return store.spark.createDataFrame([(k, str(v)) for k, v in rows], "name string, value string")


def files(store: Store) -> DataFrame:
    """Sizes of the runs' files and of the manifest's."""
    runs = [(r.path.rsplit("/", 1)[-1], r.bytes) for r in store.state.runs]
    kept = [(n, size) for n, size in store.manifest.files.listed(store.manifest.root)]
    return store.spark.createDataFrame([*sorted(runs), *sorted(kept)], "file string, bytes long")


SHOWS: dict[str, Callable[[Store], DataFrame]] = {"memtable": memtable, "sstable": sstable, "level": level, "options": options, "files": files}


@dataclass
class Profile:
    """One operation: an id, its time, and its counts."""

    query_id: str
    operation: str
    query_time_ns: int = 0
    counts: dict[str, int] = field(default_factory=dict)
    plan: str = ""

    def text(self) -> str:
        lines = [f"query {self.query_id}: {self.operation}", f"time: {self.query_time_ns / 1e6:.3f} ms"]
        lines += [f"{k}: {readable(v) if k.endswith('bytes') else v}" for k, v in self.counts.items()]
        return "\n".join(lines)


def profiled(store: Store, operation: str, run: Callable[[], Any]) -> tuple[Any, Profile]:
    """The result of ``run`` and what it took; Spark's jobs carry the query's id."""
    profile = Profile(str(uuid.uuid4()), operation)
    store.spark.sparkContext.setJobDescription(f"{operation} {profile.query_id}")
    began = time.monotonic_ns()
    try:
        return run(), profile
    finally:
        profile.query_time_ns = time.monotonic_ns() - began
        store.spark.sparkContext.setJobDescription(None)


def scan_metrics(df: DataFrame) -> dict[str, int]:
    """What the file scans of an executed DataFrame measured: files, their bytes, rows read, time."""
    wanted = {"numFiles": "block_files", "filesSize": "block_bytes", "numOutputRows": "block_rows", "scanTime": "block_time_ms"}
    out = dict.fromkeys(wanted.values(), 0)
    left = [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            kids = node.children()
            left += [kids.apply(i) for i in range(kids.length())]
            if kind == "FileSourceScanExec":
                held = node.metrics()
                for name, as_name in wanted.items():
                    if held.contains(name):
                        out[as_name] += max(0, held.apply(name).value())
    return out


def profile_read(store: Store, operation: str, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, keys_only: bool = False, most: int = 10_000) -> tuple[list, Profile]:
    """The first ``most`` pairs (or keys) in the range by key, with what was read and what was pruned."""
    df = (store.keys if keys_only else store.scan)(lower, upper).orderBy("key").limit(most)
    rows, profile = profiled(store, operation, lambda: df.collect())
    opened = store.runs(lower, upper)
    pruned = [r for r in store.state.runs if r not in opened]
    profile.counts = {"runs": len(opened), "read_bytes": sum(r.bytes for r in opened), "filter_num": len(pruned), "filter_bytes": sum(r.bytes for r in pruned), "rows": len(rows)} | scan_metrics(df)
    profile.plan = df._jdf.queryExecution().toString()
    return rows, profile


def profile_write(store: Store, operation: str, pairs: list[tuple[bytes, bytes]], run: Callable[[], Any]) -> tuple[Any, Profile]:
    """What ``run`` returns, and what it wrote: pairs, the bytes of their runs, and what a flush made of them."""
    before = {r.path for r in store.state.runs}
    result, profile = profiled(store, operation, run)
    new = [r for r in store.state.runs if r.path not in before]
    profile.counts = {"write_num": len(pairs), "write_bytes": sum(len(k) + len(v) for k, v in pairs), "run_files": len(new), "run_bytes": sum(r.bytes for r in new), "flushed_files": sum(r.level > STAGING for r in new)}
    return result, profile
