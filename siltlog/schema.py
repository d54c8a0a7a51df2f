"""The tables of the engine, and what a key, a value and a bound may be."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

PUT, DELETE = "P", "D"

MUTATIONS = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("seq", T.LongType(), False), T.StructField("op", T.StringType(), False), T.StructField("value", T.BinaryType())])
MESSAGES = T.StructType([T.StructField("channel", T.StringType(), False), T.StructField("msg_id", T.LongType(), False), T.StructField("payload", T.BinaryType(), False)])
CHANNELS = T.StructType([T.StructField("channel_id", T.LongType(), False), T.StructField("channel", T.StringType(), False)])
RUNS = T.StructType([
    T.StructField("run_id", T.LongType(), False), T.StructField("level", T.IntegerType(), False), T.StructField("path", T.StringType(), False),
    T.StructField("first_key", T.BinaryType()), T.StructField("last_key", T.BinaryType()), T.StructField("n_rows", T.LongType(), False),
    T.StructField("bytes", T.LongType(), False), T.StructField("tombstones", T.LongType(), False), T.StructField("unique", T.BooleanType(), False),
])

#: The level of runs that hold single committed batches, not yet merged by a flush.
STAGING = -1


def as_bytes(x: bytes | bytearray | str) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def checked_key(key: bytes | str) -> bytes:
    if not (out := as_bytes(key)):
        raise ValueError("a key can't be empty")
    return out


@dataclass(frozen=True)
class Bound:
    """One end of a key range; ``key`` of None is unbounded."""

    key: bytes | None = None
    inclusive: bool = True

    @staticmethod
    def at(key: bytes | str) -> Bound:
        return Bound(as_bytes(key), True)

    @staticmethod
    def past(key: bytes | str) -> Bound:
        return Bound(as_bytes(key), False)


UNBOUNDED = Bound()


@dataclass(frozen=True)
class Compaction:
    """The leveled policy's numbers."""

    multiplier: int = 4
    l0_trigger: int = 2
    max_levels: int = 2
    base_bytes: int = 2 << 20


@dataclass(frozen=True)
class Options:
    """How the store writes and when it maintains itself.

    A run aims at ``target_run_bytes``. Committed batches are flushed once they hold ``staging_limit``
    times that, or are ``staging_files``; compaction follows until the policy rests. With ``auto`` off
    both wait to be asked for. ``block_bytes`` is the page size within a run, ``bloom_fpp`` the share of
    absent keys that a run's Bloom filter lets through; 0 writes no filters.
    """

    target_run_bytes: int = 256 << 20
    staging_limit: int = 3
    staging_files: int = 64
    block_bytes: int = 16 << 10
    bloom_fpp: float = 0.01
    auto: bool = True
    compaction: Compaction = field(default_factory=Compaction)


@dataclass(frozen=True)
class Run:
    """One sorted Parquet file of the log."""

    run_id: int
    level: int
    path: str
    first_key: bytes
    last_key: bytes
    n_rows: int
    bytes: int
    tombstones: int
    unique: bool
