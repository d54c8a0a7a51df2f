"""Durable channels: an append-only message log read in batch, and followed with Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import CHANNELS, MESSAGES, as_bytes
from ..sources import Files, scratch


#: Messages of one delivery at the most.
PART = 4096


def publish_ids(messages: DataFrame, channel: str, call: str, order: str) -> DataFrame:
    """``messages`` with ``msg_id``: each publish call of a channel skips one id, then takes one for each value.

    Calls are dealt by range and written once, numbered within their part, and moved up by what the
    parts before hold of their channel: a channel of any size is spread over tasks, a call is whole in one.
    """
    spark = messages.sparkSession
    dealt = messages.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), channel, call)
    path = scratch(spark, "published")
    dealt.withColumn("__part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    before = Window.partitionBy(channel).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy(channel, "__part").agg((F.count(F.lit(1)) + F.count_distinct(call)).alias("__n"))
    parts = held.select(channel, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    by = Window.partitionBy("__part", channel)
    inside = F.row_number().over(by.orderBy(call, order)) + F.dense_rank().over(by.orderBy(call)) - 1
    return rows.withColumn("msg_id", inside).join(parts, [channel, "__part"]).withColumn("msg_id", (F.col("msg_id") + F.col("__before")).cast("long")).select(*messages.columns, "msg_id")


def backlog(messages: DataFrame, channel: str) -> DataFrame:
    """All messages of one channel; order them by msg_id where order matters."""
    return messages.where(F.col("channel") == channel).select("msg_id", "payload")


def first_seen(messages: DataFrame, channel: str, *order: str) -> DataFrame:
    """(channel_id, channel): channels by their first appearance, from 1.

    One row for each channel reaches the ranking; the messages are aggregated before it.
    """
    first = messages.groupBy(F.col(channel).alias("channel")).agg(F.min(F.struct(*order)).alias("_at"))
    return first.select(F.row_number().over(Window.orderBy("_at")).cast("long").alias("channel_id"), "channel")


def in_parts(messages: DataFrame, deliver: Callable[[list[tuple[int, bytes]]], None]) -> None:
    """Hand messages to ``deliver`` by id, PART at a time: the driver holds a task's rows, not all."""
    rows = ((r["msg_id"], bytes(r["payload"])) for r in messages.orderBy("msg_id").toLocalIterator())
    while some := list(islice(rows, PART)):
        deliver(some)


class Channels:
    """Channels under ``root``. Any number of publishers and readers.

    The message log is append-only, so that streams can follow its folder. Ids are claimed before they
    are used, by a file that can be created once only: of two publishers one claims anew.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log_path, self.dim_path = f"{self.root}/messages", f"{self.root}/names"
        self.files = Files(spark, self.root)

    def _read(self, path: str, schema) -> DataFrame:
        if any(n.endswith(".parquet") for n, _ in self.files.listed(path)):
            return self.spark.read.schema(schema).parquet(path)
        return self.spark.createDataFrame([], schema)

    def names(self) -> DataFrame:
        return self._read(self.dim_path, CHANNELS)

    def messages(self) -> DataFrame:
        return self._read(self.log_path, MESSAGES)

    def show(self) -> list[str]:
        """Names in the order in which the channels were added."""
        return [r["channel"] for r in self.names().orderBy("channel_id").select("channel").collect()]

    def exists(self, name: str) -> bool:
        return bool(self.names().where(F.col("channel") == name).take(1))

    def add(self, name: str) -> bool:
        """Register the channel if it is new; whether it was."""
        if self.exists(name):
            return False
        try:
            self.files.create(f"{self._claims(name)}/name", name)
        except FileExistsError:  # another adder of this name was first
            return False
        number = self._claim(f"{self.root}/claims/ids", 1, lambda: self.names().agg(F.max("channel_id")).first()[0] or 0)
        self.spark.createDataFrame([(number, name)], CHANNELS).coalesce(1).write.mode("append").parquet(self.dim_path)
        return True

    def _claims(self, name: str) -> str:
        return f"{self.root}/claims/channel-{name.encode().hex()}"

    def _claim(self, folder: str, n: int, last: Callable[[], int]) -> int:
        """The first of ``n`` numbers that are nobody else's; ``last`` is asked where none was claimed yet."""
        while True:
            names = [x for x, _ in self.files.listed(folder) if not x.endswith(".tmp")]
            first = int(self.files.read(f"{folder}/{max(names)}")) + 1 if names else last() + 1
            try:
                self.files.create(f"{folder}/{first:020d}", str(first + n - 1))
                return first
            except FileExistsError:
                continue

    def publish(self, name: str, values: list[bytes | str]) -> list[int]:
        """Append the values in order and return their ids. An empty value is refused, before any is written."""
        payloads = [as_bytes(v) for v in values]
        if not all(payloads):
            raise ValueError("a message can't be empty")
        self.add(name)
        if not payloads:
            return []
        held = lambda: self.messages().where(F.col("channel") == name).agg(F.max("msg_id")).first()[0]
        base = self._claim(f"{self._claims(name)}/ids", len(payloads) + 1, lambda: -1 if (last := held()) is None else last)
        ids = [base + 1 + i for i in range(len(payloads))]
        rows = [(name, i, bytearray(p)) for i, p in zip(ids, payloads)]
        self.spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(self.log_path)
        return ids

    def backlog(self, name: str) -> DataFrame:
        return backlog(self.messages(), name)

    def stream(self, name: str, files_per_trigger: int = 64) -> DataFrame:
        """The channel's messages as a streaming DataFrame, from the first on."""
        if not self.files.fs.exists(self.files.path(self.log_path)):
            self.files.fs.mkdirs(self.files.path(self.log_path))
        source = self.spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(self.log_path)
        return source.where(F.col("channel") == name).select("msg_id", "payload")

    def subscribe(self, name: str, deliver: Callable[[list[tuple[int, bytes]]], None], previous: bool = False, checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
        """Hand each batch of new messages to ``deliver``, by id; the channel is added if it is new.

        With ``previous`` the backlog comes first, if the channel was there before, and what it held
        isn't delivered again. A delivery is at most PART messages. ``once`` stops at the end of what there is.
        """
        known = not self.add(name)
        last = self.backlog(name).agg(F.max("msg_id")).first()[0]
        if previous and known:
            in_parts(self.backlog(name).where(F.col("msg_id") <= F.lit(last if last is not None else -1)), deliver)
        fresh = self.stream(name).where(F.col("msg_id") > F.lit(last if last is not None else -1))

        def batch(df: DataFrame, _: int) -> None:
            in_parts(df, deliver)

        writer = fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint or f"{self.root}/subscribers/{uuid.uuid4().hex}")
        return (writer.trigger(availableNow=True) if once else writer).start()
