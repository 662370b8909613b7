"""Consistent hashing, replicas, shards and nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ring_position


def ring(nodes: DataFrame, vnodes: int = 150) -> DataFrame:
    """Virtual nodes (pos, node_id) of ``nodes(node_id)``, one hash each."""
    rows = nodes.select("node_id", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("i"))
    return rows.select(ring_position(F.concat("node_id", F.lit("::vn"), F.col("i").cast("string"))).alias("pos"), "node_id")


#: Virtual nodes that a ring may have, as its table is sent to all tasks, and parts that it is looked up by.
MOST_SLOTS = 1_000_000
PARTS = 4096


def successor(keys: DataFrame, pos: Column, slots: DataFrame, part_of: Callable[[Column], Column], name: str) -> DataFrame:
    """Add ``name``: the payload of the first of ``slots(pos, payload)`` at or after ``pos``, around the end.

    ``part_of`` maps a position to one of PARTS numbers in order.  Slots are
    grouped by it, and each group knows the first slot after it, so a key looks at
    one small group only and is not shuffled.
    """
    if slots.count() > MOST_SLOTS:
        raise ValueError("the ring is too large to be sent to all tasks")
    w = Window.partitionBy(F.lit(0)).orderBy("part")  # PARTS rows
    held = slots.groupBy(part_of(F.col("pos")).alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("here"))
    table = slots.sparkSession.range(PARTS).select(F.col("id").alias("part")).join(held, "part", "left")
    first = F.col("here")[0]["payload"]
    after = F.coalesce(F.first(first, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.first(first, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    table = table.select("part", "here", after.alias("after"))
    rows = keys.withColumn("pos", pos).withColumn("part", part_of(F.col("pos")).cast("long"))
    met = rows.join(F.broadcast(table), "part")  # PARTS rows, at most MOST_SLOTS slots
    found = F.get(F.filter("here", lambda x: x["pos"] >= F.col("pos")), F.lit(0))["payload"]
    return met.withColumn(name, F.coalesce(found, "after")).drop("part", "here", "after")


def _by_number(pos: Column) -> Column:
    return F.floor(pos / ((1 << 32) // PARTS))


def by_hex(pos: Column) -> Column:
    """Part of a position written in hexadecimal digits."""
    return F.conv(F.substring(pos, 1, 3), 16, 10).cast("long")


def route(keys: DataFrame, r: DataFrame, key: str = "key") -> DataFrame:
    """Add pos and node_id: the first virtual node at or after the key's position, around the end."""
    return successor(keys, ring_position(F.col(key)), r.select("pos", F.col("node_id").alias("payload")), _by_number, "node_id")


def slot_replicas(r: DataFrame, k: int, healthy: list[str] | None = None, walk: int | None = None) -> DataFrame:
    """For each slot the first ``k`` distinct healthy nodes from it on, looking at ``walk`` slots, or as many as it takes."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "node_id")))
    row = r.agg(ordered.alias("s")).select(F.col("s.pos").alias("at"), F.concat("s.node_id", "s.node_id").alias("twice"), F.size("s").alias("n"))  # as large as the ring

    def nodes(i: Column, steps: Column) -> Column:
        seen = F.slice("twice", i + 1, steps)
        return F.slice(F.array_distinct(seen if healthy is None else F.filter(seen, lambda x: x.isin(healthy))), 1, k)

    rows = row.select("twice", "n", F.posexplode("at").alias("i", "pos"))
    if walk is not None:
        return rows.select("pos", nodes(F.col("i"), F.least("n", F.lit(walk))).alias("payload"))
    near = nodes(F.col("i"), F.least("n", F.lit(64 * k)))
    return rows.select("pos", F.when(F.size(near) >= k, near).otherwise(nodes(F.col("i"), F.col("n"))).alias("payload"))


def replicas(keys: DataFrame, r: DataFrame, k: int, key: str = "key", healthy: list[str] | None = None, capped: bool = False, n_nodes: int | None = None) -> DataFrame:
    """Add ``replicas``: the next ``k`` distinct healthy nodes around the ring, worked out once for each slot.

    With ``capped`` the walk looks at no more virtual nodes than there are nodes,
    as the established behaviour has it, and may find fewer.
    """
    slots = slot_replicas(r, k, healthy, n_nodes if capped else None)
    return successor(keys, ring_position(F.col(key)), slots, _by_number, "replicas")


def segment_of(keys: DataFrame, segments: DataFrame, shard: Column) -> DataFrame:
    """Segment whose closed range holds the shard index; ``segments(start, end, ...)`` has at most 256 rows."""
    rows = keys.withColumn("shard", shard)
    table = segments.select("*", F.explode(F.sequence("start", "end")).alias("shard"))
    return rows.join(F.broadcast(table), "shard", "left")  # one row a shard, 256 in all


def preferred(replica_list: Column, node: str) -> Column:
    """The node itself if it holds a replica, else the first."""
    return F.when(F.array_contains(replica_list, node), F.lit(node)).otherwise(F.element_at(replica_list, 1))


def repaired(replica_list: Column, live: list[str], every: list[str], k: int) -> Column:
    """Replicas on live nodes, filled up to ``k`` by other live nodes in order."""
    alive = F.filter(replica_list, lambda x: x.isin(live))
    others = F.array_except(F.array(*[F.lit(x) for x in sorted(live)]), alive)
    return F.slice(F.concat(alive, others), 1, k)


def node_load(placed: DataFrame) -> DataFrame:
    """Chunks and bytes on each node, of ``placed(replicas, size)``."""
    rows = placed.select(F.explode("replicas").alias("node_id"), "size")
    return rows.groupBy("node_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("size").alias("bytes"))
