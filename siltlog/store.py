"""The keyed store: writes append committed batches, reads resolve them, flush and compaction rewrite them."""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from . import operators as ops
from . import plans
from .schema import DELETE, MUTATIONS, PUT, RUNS, STAGING, UNBOUNDED, Bound, Options, Run, as_bytes, checked_key
from .sources import Manifest, Version, read_runs, runs_at, write_run

#: Bits of a sequence number that tell the rows of one batch apart; the version stands above them.
ORDINAL_BITS = 32


class Store:
    """A log under ``root``. Every write is one atomic commit of a new manifest version.

    Recency is decided by ``seq`` alone, never by where a row lies. Two writers at once: the slower
    one gets FileExistsError and its rows stay invisible.
    """

    def __init__(self, spark: SparkSession, root: str, options: Options | None = None, version: int | None = None):
        self.spark, self.root, self.options = spark, root.rstrip("/"), options or Options()
        self.manifest = Manifest(spark, self.root)
        self.fixed = version
        self.state = self.manifest.load(version)

    def at(self, version: int) -> Store:
        """The store as it was; reads only."""
        return Store(self.spark, self.root, self.options, version)

    # Writes

    def put(self, key: bytes | str, value: bytes | str) -> int:
        return self.fill([(key, value)])

    def delete(self, key: bytes | str) -> int:
        return self._batch([(checked_key(key), DELETE, None)])

    def fill(self, pairs: list[tuple[bytes | str, bytes | str]]) -> int:
        """Put pairs in their order, later ones winning; an empty value deletes. Returns the version."""
        return self._batch([(checked_key(k), PUT if as_bytes(v) else DELETE, as_bytes(v) or None) for k, v in pairs])

    def _batch(self, rows: list[tuple[bytes, str, bytes | None]]) -> int:
        if not rows:
            return self.state.number
        base = (self.state.number + 1) << ORDINAL_BITS
        log = self.spark.createDataFrame([(bytearray(k), base + i, op, bytearray(v) if v is not None else None) for i, (k, op, v) in enumerate(rows)], MUTATIONS)
        return self._commit_batch(log, plans.batch_files(len(rows), sum(len(k) + len(v or b"") for k, _, v in rows), 1))

    def fill_from(self, df: DataFrame, ordinal: str, files: int | None = None) -> int:
        """Put the rows (key, value, ordinal) of a DataFrame as one batch.

        ``ordinal`` orders the batch and must be unique in it, from 0 to below 2**32. A null or
        empty key, or a bad ordinal, fails the write; a null or empty value deletes. There are more
        than ``files`` files if the batch is too large for as many tasks to sort.
        """
        base = (self.state.number + 1) << ORDINAL_BITS
        n = F.col(ordinal).cast("long")
        ok = F.coalesce(F.octet_length("key") > 0, F.lit(False)) & F.coalesce((n >= 0) & (n < (1 << ORDINAL_BITS)), F.lit(False))
        seq = F.when(ok, n + base).otherwise(F.raise_error(F.lit("a key is empty or an ordinal is out of range")).cast("long"))
        value = F.col("value").cast("binary")
        gone = F.coalesce(F.octet_length(value) == 0, F.lit(True))
        log = df.select(F.col("key").cast("binary").alias("key"), seq.alias("seq"), F.when(gone, DELETE).otherwise(PUT).alias("op"), F.when(~gone, value).alias("value"))
        size = log.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(fn.record_bytes(F.col("key"), F.col("value")).cast("long")), F.lit(0)).alias("bytes")).first()
        return self._commit_batch(log, plans.batch_files(size["n"], size["bytes"], files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))))

    def _commit_batch(self, log: DataFrame, files: int) -> int:
        path = f"{self.root}/runs/batch-{self.state.number + 1:020d}-{self._tag()}"
        write_run(log, path, files, self.options)
        new = runs_at(self.spark, path, STAGING, self.state.next_run, False)
        number = self._commit(list(self.state.runs) + new, len(new), "batch")
        if self.options.auto:
            self.maintain()
        return number

    def maintain(self) -> bool:
        """Flush and compact as far as the thresholds ask for it; whether anything was done.

        A writer that comes first makes this one give up for now: the batch is committed already.
        """
        before = self.state.number
        try:
            if self.maybe_flush() != before:
                self.compact_all()
        except FileExistsError:
            self.state = self.manifest.load(self.fixed)
        return self.state.number != before

    @staticmethod
    def _tag() -> str:
        import uuid

        return uuid.uuid4().hex[:8]

    def _commit(self, runs: list[Run], made: int, note: str) -> int:
        if self.fixed is not None:
            raise ValueError("an old version can't be written to")
        self.state = self.manifest.commit(Version(self.state.number + 1, self.state.next_run + made, tuple(runs), note))
        return self.state.number

    # Reads

    def runs(self, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> list[Run]:
        """The runs that a read of this range opens."""
        return [r for r in self.state.runs if plans.reaches(r, lower, upper)]

    def log(self, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> DataFrame:
        """All mutations in the range."""
        return ops.within(read_runs(self.spark, [r.path for r in self.runs(lower, upper)]), lower, upper)

    def scan(self, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> DataFrame:
        """Live pairs in the range; unordered, see pairs()."""
        log = self.log(lower, upper)
        return ops.live(log if plans.settled(self.runs(lower, upper)) else ops.latest(log))

    def keys(self, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> DataFrame:
        log = self.log(lower, upper)
        return log.where(F.col("op") == PUT).select("key") if plans.settled(self.runs(lower, upper)) else ops.keys(log)

    def pairs(self, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> DataFrame:
        """Live pairs in ascending order of their keys."""
        return self.scan(lower, upper).orderBy("key")

    def get(self, key: bytes | str) -> bytes | None:
        end = Bound.at(key)
        row = self.scan(end, end).first()
        return bytes(row["value"]) if row else None

    def multi_get(self, wanted: DataFrame) -> DataFrame:
        """Live pairs of the keys in ``wanted`` (key)."""
        keys = wanted.select(F.col("key").cast("binary").alias("key"))
        if plans.settled(list(self.state.runs)):
            return ops.live(self.log()).join(keys.distinct(), "key", "left_semi")
        return ops.multi_get(self.log(), keys)

    # Maintenance

    def flush(self) -> int:
        """Merge all committed batches into sorted runs at level 0."""
        staged = [r for r in self.state.runs if r.level == STAGING]
        if not staged:
            return self.state.number
        return self._rewrite(staged, 0, False, "flush")

    def maybe_flush(self) -> int:
        return self.flush() if plans.pending_flush(list(self.state.runs), self.options) else self.state.number

    def compact(self) -> plans.Task | None:
        """Carry out the policy's next task; None if there is nothing to do."""
        task = plans.next_task(list(self.state.runs), self.options.compaction)
        if task:
            ids = {*task.upper, *task.lower}
            self._rewrite([r for r in self.state.runs if r.run_id in ids], task.to, task.bottom, "compaction")
        return task

    def compact_all(self, most: int = 1000) -> int:
        """Compact until the policy rests; returns the number of tasks."""
        for n in range(most):
            if self.compact() is None:
                return n
        raise RuntimeError("compaction doesn't come to rest")

    def _rewrite(self, old: list[Run], level: int, bottom: bool, note: str) -> int:
        """Replace runs by their merge. Deletions go only if no run outside can hold an older version."""
        gone = {r.run_id for r in old}
        rest = [r for r in self.state.runs if r.run_id not in gone]
        merged = ops.latest(read_runs(self.spark, [r.path for r in old]))
        met = {*plans.met(old, [r for r in rest if r.level != STAGING])}
        if bottom and not met:
            merged = merged.where(F.col("op") == PUT)
        path = f"{self.root}/runs/{note}-{self.state.number + 1:020d}-{self._tag()}"
        write_run(merged, path, plans.run_files(old, self.options), self.options, sum(r.n_rows for r in old))
        new = runs_at(self.spark, path, level, self.state.next_run, True)
        return self._commit(rest + new, len(new), note)

    def vacuum(self, keep: int = 1, age: float = 3600) -> list[str]:
        """Delete what the last ``keep`` versions don't name; returns the folders deleted.

        Folders younger than ``age`` seconds stay: another writer may be about to commit them.
        """
        numbers = self.manifest.numbers()
        kept = [self.manifest.load(n) for n in numbers[-keep:]] if numbers else []
        named = {r.path.rsplit("/", 2)[1] for v in kept for r in v.runs}
        files = self.manifest.files
        old = [n for n in files.older(f"{self.root}/runs", age) if n not in named]
        for n in old:
            files.delete(f"{self.root}/runs/{n}")
        for n in numbers[:-keep]:
            files.delete(f"{self.manifest.root}/{n:020d}.json")
        return old

    def sync(self) -> None:
        """Nothing to do: a committed batch is durable."""

    def close(self) -> None:
        self.flush()

    # What there is

    def run_table(self) -> DataFrame:
        return self.spark.createDataFrame([tuple((asdict(r) | {"first_key": bytearray(r.first_key), "last_key": bytearray(r.last_key)}).values()) for r in self.state.runs], RUNS)

    def with_options(self, **changes) -> Store:
        return Store(self.spark, self.root, replace(self.options, **changes))
