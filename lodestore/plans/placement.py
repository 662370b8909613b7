"""Queries over the hash ring and the cluster."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import inventory as I
from ..operators import placement as P
from .catalog import Tables
from .registry import query

_V = 20
_POS = lambda k: f"('0x' || substr(sha256({k}), 1, 8))::bigint"
_RING = f"(select {_POS(chr(34) + 'node_id' + chr(34) + chr(32) + '|| ' + repr('::vn') + ' || i')} as pos, node_id from nodes, (select unnest(range(0, {_V})) as i))"
_KEYS = f"(select file_id, sha256 as key, size, {_POS('sha256')} as pos from files)"
# each key with its ring walked once around
_WALK = f"select k.file_id, k.size, r.node_id, (r.pos < k.pos)::int as turn, r.pos as slot from {_KEYS} k, {_RING} r"
_DISTINCT = f"select file_id, size, node_id, row_number() over (partition by file_id order by min(turn * 4294967296 + slot)) as place from ({_WALK}) where node_id <> 'node-3' group by 1, 2, 3"


def _keys(t: Tables):
    return t.files.select("file_id", F.col("sha256").alias("key"), "size")


@query("fn_hash_position", f"select file_id, {_POS('sha256')} as pos from files")
def _(t: Tables):
    return t.files.select("file_id", S.ring_position(F.col("sha256")).alias("pos"))


@query("fn_md5_shard", "select file_id, ('0x' || substr(md5(sha256), 1, 8))::bigint % 256 as shard from files")
def _(t: Tables):
    return t.files.select("file_id", S.md5_shard(F.col("sha256")).alias("shard"))


@query("fn_kafka_partition", f"select file_id, {_POS('sha256')} % 100 as partition from files")
def _(t: Tables):
    """The partition of a topic that a key's messages go to."""
    return t.files.select("file_id", F.pmod(S.ring_position(F.col("sha256")), F.lit(100)).alias("partition"))


@query("join_ring_route", f"select file_id, arg_min(node_id, turn * 4294967296 + slot) as node_id from ({_WALK}) group by 1")
def _(t: Tables):
    return P.route(_keys(t), P.ring(t.nodes, _V)).select("file_id", "node_id")


@query("join_ring_replicas", f"select file_id, string_agg(node_id, ',' order by place) as replicas from ({_DISTINCT}) where place <= 3 group by 1")
def _(t: Tables):
    healthy = [f"node-{i}" for i in (0, 1, 2, 4)]
    return P.replicas(_keys(t), P.ring(t.nodes, _V), 3, healthy=healthy).select("file_id", F.array_join("replicas", ",").alias("replicas"))


@query("join_ring_replicas_capped", f"select file_id, coalesce(string_agg(node_id, ',' order by first), '') as replicas from (select file_id, node_id, min(step) as first, row_number() over (partition by file_id order by min(step)) as place from (select file_id, node_id, row_number() over (partition by file_id order by turn, slot) as step from ({_WALK})) where step <= 5 group by 1, 2) where place <= 3 group by 1")
def _(t: Tables):
    return P.replicas(_keys(t), P.ring(t.nodes, _V), 3, capped=True, n_nodes=5).select("file_id", F.array_join("replicas", ",").alias("replicas"))


@query("join_ring_md5", f"select k.file_id, coalesce(min(r.pos), (select min(md5(node_id || '-' || i)) from nodes, (select unnest(range(0, {_V})) as i))) as slot from (select file_id, md5(sha256) as h from files) k left join (select md5(node_id || '-' || i) as pos from nodes, (select unnest(range(0, {_V})) as i)) r on r.pos >= k.h group by 1")
def _(t: Tables):
    r = t.nodes.select(F.explode(F.sequence(F.lit(0), F.lit(_V - 1))).alias("i"), "node_id").select(F.md5(F.concat("node_id", F.lit("-"), F.col("i").cast("string"))).alias("pos"), "node_id")
    slots = r.select("pos", F.col("pos").alias("payload"))
    return P.successor(t.files.select("file_id", "sha256"), F.md5("sha256"), slots, P.by_hex, "slot").select("file_id", "slot")


@query("join_preferred_shard", f"select file_id, case when bool_or(node_id = 'node-2' and place <= 3) then 'node-2' else arg_min(node_id, place) end as node from ({_DISTINCT}) group by 1")
def _(t: Tables):
    rows = P.replicas(_keys(t), P.ring(t.nodes, _V), 3, healthy=[f"node-{i}" for i in (0, 1, 2, 4)])
    return rows.select("file_id", P.preferred(F.col("replicas"), "node-2").alias("node"))


@query("join_segment_range", "select file_id, case when shard < 64 then 'seg-0' when shard < 128 then 'seg-1' when shard < 192 then 'seg-2' else 'seg-3' end as segment from (select file_id, ('0x' || substr(md5(sha256), 1, 8))::bigint % 256 as shard from files)")
def _(t: Tables):
    segments = t.spark.sql("select * from values (0L, 63L, 'seg-0'), (64L, 127L, 'seg-1'), (128L, 191L, 'seg-2'), (192L, 255L, 'seg-3') as s(start, end, segment)")
    return P.segment_of(t.files, segments, S.md5_shard(F.col("sha256"))).select("file_id", "segment")


@query("agg_shard_groups", "select ('0x' || substr(md5(sha256), 1, 8))::bigint % 256 as shard, count(*) as n, string_agg(file_id::varchar, ',' order by file_id) as ids from files group by 1")
def _(t: Tables):
    rows = t.files.groupBy(S.md5_shard(F.col("sha256")).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("file_id")).alias("ids"))
    return rows.select("shard", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("agg_ring_stats", f"select physical, slots, healthy, keys, nodes_with_keys from (select count(distinct node_id) as physical, count(*) as slots, count(distinct case when node_id <> 'node-3' then node_id end) as healthy from {_RING}), (select count(*) as keys, count(distinct node_id) as nodes_with_keys from (select file_id, arg_min(node_id, turn * 4294967296 + slot) as node_id from ({_WALK}) group by 1))")
def _(t: Tables):
    """The ring's slots and nodes, and how many keys they have."""
    r = P.ring(t.nodes, _V).join(F.broadcast(t.nodes.select("node_id", "healthy")), "node_id")  # one row a node
    slots = r.agg(F.count_distinct("node_id").alias("physical"), F.count(F.lit(1)).alias("slots"), F.count_distinct(F.when(F.col("healthy"), F.col("node_id"))).alias("healthy"))
    keys = P.route(_keys(t), P.ring(t.nodes, _V)).agg(F.count(F.lit(1)).alias("keys"), F.count_distinct("node_id").alias("nodes_with_keys"))
    return slots.crossJoin(keys)  # one row each


_PLACED = f"select * from ({_DISTINCT}) where place <= 2"


def _placed(t: Tables):
    return P.replicas(_keys(t), P.ring(t.nodes, _V), 2, healthy=[f"node-{i}" for i in (0, 1, 2, 4)])


@query("dist_store_chunk", f"select node_id, count(*) as chunks, sum(size)::bigint as bytes from ({_PLACED}) group by 1")
def _(t: Tables):
    return P.node_load(_placed(t))


@query("agg_node_stats", f"select node_id, count(*) as chunks, sum(size)::bigint as bytes from ({_PLACED}) group by 1")
def _(t: Tables):
    return P.node_load(_placed(t))


@query("agg_cluster_stats", f"select count(distinct file_id) as chunks, sum(size)::bigint as used, 5 * 107374182400 as capacity, round(sum(size) * 100.0::double / (5 * 107374182400), 6) as percent from ({_PLACED})")
def _(t: Tables):
    total = t.nodes.agg(F.sum("capacity").alias("capacity"))
    load = _placed(t).select("file_id", F.explode("replicas"), "size").agg(F.count_distinct("file_id").alias("chunks"), F.sum("size").alias("used"))
    return load.crossJoin(total).select("chunks", "used", "capacity", F.round(S.usage_percent(F.col("used"), F.col("capacity")), 6).alias("percent"))  # one row each


@query("dist_migrate", f"select file_id, arg_min(node_id, turn * 4294967296 + slot) as node_id from ({_WALK}) where node_id <> 'node-1' group by 1")
def _(t: Tables):
    return P.route(_keys(t), P.ring(t.nodes.where("node_id <> 'node-1'"), _V)).select("file_id", "node_id")


@query("dist_repair", f"select p.file_id, case when not p.has1 then p.list when p.other = 'node-0' then 'node-0,node-2' else p.other || ',node-0' end as replicas from (select file_id, bool_or(node_id = 'node-1') as has1, string_agg(node_id, ',' order by place) as list, max(case when node_id <> 'node-1' then node_id end) as other from ({_PLACED}) group by 1) p")
def _(t: Tables):
    live = ["node-0", "node-2", "node-4"]
    return _placed(t).select("file_id", F.array_join(P.repaired(F.col("replicas"), live, live, 2), ",").alias("replicas"))


@query("set_missing_nodes", f"select file_id, 4 - count(*) as missing from ({_PLACED}) group by 1")
def _(t: Tables):
    every = F.array(*[F.lit(f"node-{i}") for i in (0, 1, 2, 4)])
    return _placed(t).select("file_id", F.size(F.array_except(every, "replicas")).cast("long").alias("missing"))


@query("sort_least_loaded", "select arg_min(node_id, load * 100 + substr(node_id, 6)::int) as node_id from nodes where healthy")
def _(t: Tables):
    return t.nodes.where("healthy").agg(F.min_by("node_id", F.struct("load", "node_id")).alias("node_id"))


@query("dist_start_task", "select arg_min(node_id, load * 100 + substr(node_id, 6)::int) as node_id, min(load) + 10 as load from nodes where healthy")
def _(t: Tables):
    return t.nodes.where("healthy").agg(F.min_by("node_id", F.struct("load", "node_id")).alias("node_id"), (F.min("load") + 10).alias("load"))


@query("dist_cluster_api", "select count(*) as chunks, count(distinct sha256) as distinct_chunks, round((sum(size) - (select sum(size) from (select max(size) as size from files group by sha256))) / 1099511627776.0::double * 12 * 5000, 9) as annual_savings from files")
def _(t: Tables):
    rows = I.with_first(t.files).withColumn("first", F.col("file_id") == F.col("first_id"))
    saved = F.sum(F.when(F.col("first"), 0).otherwise(F.col("size")))
    return rows.agg(F.count(F.lit(1)).alias("chunks"), F.count_if("first").alias("distinct_chunks"), F.round(saved / 1099511627776.0 * 12 * 5000, 9).alias("annual_savings"))
