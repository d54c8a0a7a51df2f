"""Sharding by balanced label propagation, under the law ``rows``: counts at most one apart.

Documents of equal text are linked. Labels start spread evenly over the rows; then in each round
the labels are counted within each group, and a document wishes to move to the shard that holds most
of its group, if that is more than stays with it. How many may move between each two shards is settled
on the driver from the counts of wishes, so that no shard takes in more than it has room for and gives
away: rows change places even where all shards are full. In every second round only shards with room
are wished for. Which rows go is drawn by a hash of the row. Rounds end when two in a row move none. At last rows beyond a shard's exact quota, unlinked ones first, fill the
shards below theirs.

Rows are kept by range of their group, and meet what is known of it by part and group: a group of any
size is split over as many tasks as it has parts. Every ranking runs over these parts and a table of counts by
part and shard, so that no task holds a shard. A null text counts as empty, size 1. A very long text is
only hashed. Null and repeated doc_ids are rows like others; columns other than id and text aren't
looked at. An empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ordered

GROUP = ["_h", "text_crc32", "size"]


def rows_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the text's hash; equal texts agree in all but doc_id."""
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.xxhash64(t).alias("_h"))


def pick(values: list, at: Column) -> Column:
    """The element of a short list of numbers."""
    return F.get(F.array(*(F.lit(int(v)).cast("long") for v in values)), at)


def loads(df: DataFrame, shards: int) -> list[int]:
    """Rows of each shard: at most ``shards`` numbers come to the driver."""
    held = {r[0]: r[1] for r in df.groupBy("_label").count().collect()}
    return [held.get(i, 0) for i in range(shards)]


def flows(asked: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many of the wishes asked[a, b] to move from a to b are granted: none takes in more than its room and what leaves it."""
    granted = asked.astype(float)
    for _ in range(10_000):
        into, most = granted.sum(0), room + granted.sum(1)
        over = into > most + 1e-6
        if not over.any():
            break
        granted[:, over] *= (most[over] / into[over]) * (1 - 1e-9)
    return granted


def propagate(rows: DataFrame, places: DataFrame, shards: int, rounds: int) -> DataFrame:
    """``rows`` with ``_label`` moved towards the labels of their groups.

    places: (_part, group) of linked rows. Linked rows alone count for the room of a shard: unlinked ones
    can give way to them later. A group that no shard can hold is drawn to as many shards as hold it.
    """
    cap, idle = max(1, sum(loads(rows, shards)) // shards), 0
    for r in range(rounds):
        linked = rows.where("_linked")
        room = np.maximum(0, cap - np.array(loads(linked, shards)))
        asking = room > 0 if r % 2 else room >= 0
        counts = linked.groupBy(*GROUP).agg(F.array(*(F.count(F.when(F.col("_label") == i, 1)) for i in range(shards))).alias("_c"), F.count(F.lit(1)).alias("_n"))
        c = F.col("_c")
        # Ties are broken by a hash of group and label, alike for all of a group: none swap sides.
        of = lambda n, i: F.struct(n.alias("n"), F.xxhash64("_h", i).alias("t"), i.alias("i"))
        ranked = F.sort_array(F.array(*(of((F.get(c, F.lit(i)) if asking[i] else F.lit(-1)).cast("long"), F.lit(i)) for i in range(shards))), asc=False)
        needed = F.least(F.ceil(F.col("_n") / cap), F.lit(shards)).cast("int")
        best = F.get(F.col("_ranked"), F.pmod(F.xxhash64("_part", "_at"), F.col("_k")).cast("int"))
        known = places.join(counts.withColumns({"_ranked": ranked, "_k": needed}), GROUP)
        wish = linked.join(known, ["_part", *GROUP]).withColumn("_best", best)
        moves = F.col("_best") > of(F.get(c, F.col("_label")), F.col("_label"))
        wish = cut(wish.where(moves).select("_part", "_at", "_label", F.col("_best.i").alias("_to")), "wishes")
        asked = np.zeros((shards, shards))
        for x in wish.groupBy("_label", "_to").count().collect():
            asked[x[0], x[1]] = x[2]
        granted = flows(asked, room)
        idle = 0 if granted.sum() >= 1 else idle + 1
        if idle == 2:
            break
        if idle:
            continue
        share = ((1 << 20) * granted / np.maximum(asked, 1)).astype(int).reshape(-1).tolist()
        draw = F.pmod(F.xxhash64("_part", "_at", F.lit(r)), F.lit(1 << 20))
        went = wish.where(draw < pick(share, F.col("_label") * shards + F.col("_to"))).select("_part", "_at", F.col("_to").cast("int").alias("_to"))
        rows = cut(rows.join(went, ["_part", "_at"], "left").withColumn("_label", F.coalesce("_to", "_label")).drop("_to"), "labels")
    return rows


def settle(rows: DataFrame, shards: int) -> DataFrame:
    """Exact quotas and gapless slots: ``shard`` and ``slot`` in place of ``_label``."""
    rows = ordered(rows.drop("_part", "_at"), ~F.col("_linked"), *map(F.col, GROUP), F.col("doc_id"), name="settling")
    inside = Window.partitionBy("_part", "_label")
    counts = rows.groupBy("_part", "_label").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_label").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).drop("_n")
    now = loads(rows, shards)
    total = sum(now)
    quota = [total // shards + (i < total % shards) for i in range(shards)]
    over = [max(0, n - q) for n, q in zip(now, quota)]
    stay = [min(n, q) for n, q in zip(now, quota)]
    sums = lambda some: [sum(some[:i]) for i in range(shards)]
    free_from = sums([q - s for q, s in zip(quota, stay)])
    df = rows.withColumn("_i", F.row_number().over(inside.orderBy("_at")).cast("long") - 1).join(starts, ["_part", "_label"])
    rank = F.col("_i") + F.col("_before")
    surplus = F.col("_rank") - pick(quota, F.col("_label")) + pick(sums(over), F.col("_label"))
    df = df.withColumn("_rank", rank).withColumn("_surplus", F.when(F.col("_rank") >= pick(quota, F.col("_label")), surplus))
    place = reduce(lambda a, i: F.when(F.col("_surplus") >= free_from[i], F.lit(i)).otherwise(a) if quota[i] > stay[i] else a, range(shards), F.lit(0))
    df = df.withColumn("shard", F.when(F.col("_surplus").isNull(), F.col("_label")).otherwise(place).cast("int"))
    slot = F.when(F.col("_surplus").isNull(), F.col("_rank")).otherwise(pick(stay, F.col("shard")) + F.col("_surplus") - pick(free_from, F.col("shard")))
    return df.withColumn("slot", slot.cast("long"))


def assign(docs: DataFrame, shards: int = 16, rounds: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (doc_id, text).

    ``rounds``: the most rounds of propagation; they end sooner when no row moves.
    """
    base = ordered(rows_of(docs), *map(F.col, GROUP), F.col("doc_id"), name="rows")
    by = base.groupBy("_part", *GROUP).agg(F.count(F.lit(1)).alias("_n"))
    groups = by.groupBy(*GROUP).agg(F.sum("_n").alias("_all")).where("_all > 1")
    places = cut(by.join(groups, GROUP, "left_semi").select("_part", *GROUP), "places")
    start = F.pmod(F.xxhash64("_part", "_at"), F.lit(shards)).cast("int")
    linked = places.withColumn("_linked", F.lit(True))
    rows = cut(base.join(linked, ["_part", *GROUP], "left").withColumns({"_linked": F.coalesce("_linked", F.lit(False)), "_label": start}), "start")
    done = settle(propagate(rows, places, shards, rounds), shards)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_edges(assigned: DataFrame) -> DataFrame:
    """groups' linked rows and those that don't lie in the shard that holds most of their group."""
    by = assigned.groupBy("text_crc32", "size", "shard").agg(F.count(F.lit(1)).alias("n"))
    one = by.groupBy("text_crc32", "size").agg(F.sum("n").alias("rows"), F.max("n").alias("together")).where("rows > 1")
    return one.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("linked"), F.coalesce(F.sum(F.col("rows") - F.col("together")), F.lit(0)).alias("apart"))
