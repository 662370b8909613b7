"""Queries over fingerprints, reference counts and storage tiers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import dedup as D
from ..operators import lifecycle as Y
from ..operators import tiering as T
from .catalog import Tables
from .chunks import _BITS, _CAPACITY, _ERROR, _HASHES, _filter, _mod
from .registry import query

_GB = "1073741824.0::double"
_COST = lambda tier, size="size": f"({size} / {_GB} * case {tier} when 'hot' then 0.03::double when 'warm' then 0.01::double when 'cold' then 0.001::double else 0 end)"
_RULES = [("pinned", "hot", 1.0, "pinned"), ("archive_only", "cold", 1.0, "archive_only"), ("age_days < 30 and access_count < 1000", "hot", 0.85, "access"), ("age_days < 180", "warm", 0.75, "access"), ("age_days > 365", "cold", 0.7, "age"), ("refcount > 10", "warm", 0.65, "refcount"), ("size > 104857600 and ratio < 1.5", "cold", 0.6, "size")]
_CASE = lambda i, default: "case " + " ".join(f"when {r[0]} then {r[i]!r}" + ("::double" if i == 2 else "") for r in _RULES) + f" else {default} end"
_CLASS = f"select *, {_CASE(1, repr('warm'))} as new_tier, {_CASE(2, '0.5::double')} as confidence, {_CASE(3, repr('default'))} as reason from fingerprints"
_MOVES = f"select fp, tier, new_tier, round({_COST('tier')} - {_COST('new_tier')}, 9) as saving from ({_CLASS}) where tier <> new_tier and round({_COST('tier')} - {_COST('new_tier')}, 9) > 0"


@query("tier_classify", f"select fp, new_tier, confidence, reason, round({_COST('new_tier')}, 9) as cost from ({_CLASS})")
def _(t: Tables):
    return T.classify(t.fingerprints).select("fp", "new_tier", "confidence", "reason", F.round("cost", 9).alias("cost"))


@query("ext_tier_rules", "select fp, case when refcount = 0 then 'cold' else 'warm' end as new_tier from fingerprints")
def _(t: Tables):
    return T.classify(t.fingerprints, [(F.col("refcount") == 0, "cold", 1.0, "orphan")]).select("fp", "new_tier")


@query("tier_classify_simple", "select fp, case when age_days < 30 and access_count < 1000 then 'hot' when age_days < 180 then 'warm' else 'cold' end as new_tier from fingerprints")
def _(t: Tables):
    return T.classify_simple(t.fingerprints).select("fp", "new_tier")


for _name, _rows in (("tier_rule_tags", (0, 1)), ("tier_rule_access", (2, 3)), ("tier_rule_age", (4,)), ("tier_rule_refcount", (5,)), ("tier_rule_size", (6,))):
    _sql = "select fp, case " + " ".join(f"when {_RULES[i][0]} then '{_RULES[i][1]}'" for i in _rows) + " end as new_tier from fingerprints"

    @query(_name, _sql)
    def _(t: Tables, rows=_rows):
        rules = T.default_rules()
        return t.fingerprints.select("fp", S.first_of([(rules[i][0], rules[i][1]) for i in rows]).alias("new_tier"))


@query("fn_tier_cost", f"select fp, round({_COST('tier')}, 9) as cost from fingerprints")
def _(t: Tables):
    return t.fingerprints.select("fp", F.round(S.tier_cost(F.col("tier"), F.col("size")), 9).alias("cost"))


@query("join_tier_contexts", _MOVES)
def _(t: Tables):
    wanted = T.classify(t.fingerprints).select("fp", "new_tier", "cost")
    rows = t.fingerprints.join(wanted, "fp")
    return T.migrations(rows).select("fp", "tier", "new_tier", "saving")


@query("topk_migrations", _MOVES + " order by saving desc, fp limit 100")
def _(t: Tables):
    return T.migrations(T.classify(t.fingerprints)).select("fp", "tier", "new_tier", "saving").orderBy(F.col("saving").desc(), "fp").limit(100)


@query("tier_recommend", f"select tier, next_tier, count(*) as n, round(sum({_COST('tier')} - {_COST('next_tier')}), 6) as saving from (select *, case tier when 'hot' then 'warm' when 'warm' then 'cold' end as next_tier from fingerprints) where next_tier is not null group by 1, 2")
def _(t: Tables):
    return T.colder_saving(t.fingerprints)


@query("tier_age_migration", "select fp, tier from fingerprints where (tier = 'hot' and age_days >= 30) or (tier = 'warm' and age_days >= 180)")
def _(t: Tables):
    return t.fingerprints.where("(tier = 'hot' and age_days >= 30) or (tier = 'warm' and age_days >= 180)").select("fp", "tier")


@query("agg_tier_stats", "select tier, count(*) as n, sum(size)::bigint as bytes, round(avg(size), 4) as mean_size from fingerprints group by 1")
def _(t: Tables):
    return t.fingerprints.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.round(F.avg("size"), 4).alias("mean_size"))


@query("agg_cost", f"select hot, warm, cold, round(hot + warm + cold, 6) as monthly, round((hot + warm + cold) * 12, 6) as annual from (select round(sum(case when tier = 'hot' then {_COST('tier')} else 0 end), 6) as hot, round(sum(case when tier = 'warm' then {_COST('tier')} else 0 end), 6) as warm, round(sum(case when tier = 'cold' then {_COST('tier')} else 0 end), 6) as cold from fingerprints)")
def _(t: Tables):
    return T.cost_by_tier(t.fingerprints)


@query("agg_tier_savings", f"select round(sum({_COST('tier')}), 6) as current_cost, round(sum({_COST('new_tier')}), 6) as best_cost, round((sum({_COST('tier')}) - sum({_COST('new_tier')})) * 12, 6) as annual_saving from ({_CLASS})")
def _(t: Tables):
    now = F.sum(S.tier_cost(F.col("tier"), F.col("size")))
    rows = T.classify(t.fingerprints)
    return rows.agg(F.round(now, 6).alias("current_cost"), F.round(F.sum("cost"), 6).alias("best_cost"), F.round((now - F.sum("cost")) * 12, 6).alias("annual_saving"))


_USAGE = "(select tier, round(sum(size) * 100.0::double / (select sum(size) from fingerprints) * 2.7, 6) as percent from fingerprints group by 1)"


@query("tier_alerts", f"select tier, percent, case when percent >= 95 then 'critical' else 'warning' end as level from {_USAGE} where percent >= 80")
def _(t: Tables):
    total = t.fingerprints.agg(F.sum("size").alias("total"))
    usage = t.fingerprints.groupBy("tier").agg(F.sum("size").alias("size")).crossJoin(total)  # three rows and one
    return T.usage_alerts(usage.select("tier", F.round(F.col("size") * 100.0 / F.col("total") * 2.7, 6).alias("percent")))


@query("tier_alert_resolve", "select sample, value < 80 and before >= 80 as resolved from (select sample, value, lag(value) over (partition by node, metric order by sample) as before from metrics where metric = 'disk') where before is not null and value < 80 and before >= 80")
def _(t: Tables):
    w = Window.partitionBy("node", "metric").orderBy("sample")
    rows = t.metrics.where("metric = 'disk'").withColumn("before", F.lag("value").over(w))
    return rows.where("value < 80 and before >= 80").select("sample", F.lit(True).alias("resolved"))


@query("tier_dashboard", f"select n, bytes, round(cost * 12, 6) as annual from (select count(*) as n, sum(size)::bigint as bytes, sum({_COST('tier')}) as cost from fingerprints)")
def _(t: Tables):
    return t.fingerprints.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.round(F.sum(S.tier_cost(F.col("tier"), F.col("size"))) * 12, 6).alias("annual"))


@query("tier_migration_outcome", f"select part % 7 as batch, case when bool_and(refcount > 0) then 'completed' else 'failed' end as status, count(*) as n from fingerprints group by 1")
def _(t: Tables):
    ok = F.bool_and(F.col("refcount") > 0)
    return t.fingerprints.groupBy((F.col("part") % 7).alias("batch")).agg(F.when(ok, "completed").otherwise("failed").alias("status"), F.count(F.lit(1)).alias("n"))


@query("agg_migration_stats", "select count(*) filter (where refcount > 0) as succeeded, count(*) filter (where refcount = 0) as failed, sum(case when refcount > 0 then size else 0 end)::bigint as bytes from fingerprints")
def _(t: Tables):
    good = F.col("refcount") > 0
    return t.fingerprints.agg(F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"), F.sum(F.when(good, F.col("size")).otherwise(0)).alias("bytes"))


@query("tier_retrieve_order", "select part % 50 as blob, arg_min(tier, case tier when 'hot' then 0 when 'warm' then 1 else 2 end) as tier from fingerprints group by 1")
def _(t: Tables):
    rank = S.first_of([(F.col("tier") == "hot", 0), (F.col("tier") == "warm", 1)], 2)
    return t.fingerprints.groupBy((F.col("part") % 50).alias("blob")).agg(F.min_by("tier", rank).alias("tier"))


@query("win_next_cold_tier", "select fp, tier, case tier when 'hot' then 'warm' when 'warm' then 'cold' end as next_tier from fingerprints")
def _(t: Tables):
    """Where each content goes when its tier is full; tiers stand in a fixed order, and nothing follows the last."""
    return t.fingerprints.select("fp", "tier", T.next_colder(F.col("tier")).alias("next_tier"))


@query("flt_orphans", "select fp from fingerprints where refcount <= 0")
def _(t: Tables):
    return t.fingerprints.where("refcount <= 0").select("fp")


@query("flt_by_tier", "select fp from fingerprints where tier = 'hot' order by fp limit 1000")
def _(t: Tables):
    return t.fingerprints.where("tier = 'hot'").orderBy("fp").limit(1000).select("fp")


@query("flt_low_refcount", "select fp, refcount from fingerprints where refcount <= 25 order by fp limit 1000")
def _(t: Tables):
    return t.fingerprints.where("refcount <= 25").orderBy("fp").limit(1000).select("fp", "refcount")


@query("agg_fpdb_stats", "select coalesce(tier, 'all') as tier, count(*) as n, round(avg(refcount), 6) as mean_refcount, count(*) filter (where refcount = 0) as orphans from fingerprints group by rollup(tier)")
def _(t: Tables):
    rows = t.fingerprints.rollup("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("refcount"), 6).alias("mean_refcount"), F.count_if(F.col("refcount") == 0).alias("orphans"))
    return rows.withColumn("tier", F.coalesce("tier", F.lit("all")))


@query("agg_cache_stats", "select count(*) as n, sum(size)::bigint as bytes, round(avg(refcount), 6) as mean_refcount from fingerprints")
def _(t: Tables):
    return t.fingerprints.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.round(F.avg("refcount"), 6).alias("mean_refcount"))


@query("agg_index_stats", "select count(*) as n, sum(size)::bigint as bytes, sum(case when refcount > 1 then (refcount - 1) * size else 0 end)::bigint as saved from fingerprints where part % 19 <> 0")
def _(t: Tables):
    rows = t.fingerprints.where("part % 19 <> 0")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.sum(F.when(F.col("refcount") > 1, (F.col("refcount") - 1) * F.col("size")).otherwise(0)).alias("saved"))


_USES = "(select sha256(l_partkey::varchar) as fp, count(*) as delta from lineitem where l_linenumber = 1 group by 1)"


def _uses(t: Tables):
    return t.read("lineitem").where("l_linenumber = 1").groupBy(F.sha2(F.col("l_partkey").cast("string"), 256).alias("fp")).agg(F.count(F.lit(1)).alias("delta"))


@query("refcount_inc", f"select coalesce(f.fp, u.fp) as fp, coalesce(refcount, 0) + coalesce(delta, 0) as refcount from (select * from fingerprints where part % 2 = 0) f full outer join {_USES} u on f.fp = u.fp")
def _(t: Tables):
    rows = t.fingerprints.where("part % 2 = 0").select("fp", "refcount").join(_uses(t), "fp", "full_outer")
    return rows.select("fp", (F.coalesce("refcount", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("refcount"))


@query("refcount_dec", f"select f.fp, greatest(0, refcount - coalesce(delta, 0) * 2) as refcount from fingerprints f left join {_USES} u on f.fp = u.fp")
def _(t: Tables):
    rows = t.fingerprints.join(_uses(t), "fp", "left")
    return rows.select("fp", F.greatest(F.lit(0).cast("long"), F.col("refcount") - F.coalesce("delta", F.lit(0)) * 2).alias("refcount"))


@query("fpdb_increment", f"select f.fp, refcount + delta as refcount, access_count + 1 as access_count from fingerprints f join {_USES} u on f.fp = u.fp")
def _(t: Tables):
    return t.fingerprints.join(_uses(t), "fp").select("fp", (F.col("refcount") + F.col("delta")).alias("refcount"), (F.col("access_count") + 1).alias("access_count"))


@query("lmdb_refcount", f"select f.fp, greatest(0, refcount - delta) as refcount, access_count + 1 as access_count from fingerprints f join {_USES} u on f.fp = u.fp")
def _(t: Tables):
    return t.fingerprints.join(_uses(t), "fp").select("fp", F.greatest(F.lit(0).cast("long"), F.col("refcount") - F.col("delta")).alias("refcount"), (F.col("access_count") + 1).alias("access_count"))


@query("lmdb_expire", "select fp from fingerprints where accessed >= date '1998-06-01'")
def _(t: Tables):
    old = t.fingerprints.where("accessed < date '1998-06-01'").select("fp")
    return t.fingerprints.join(old, "fp", "left_anti").select("fp")


@query("lmdb_iter", "select fp from fingerprints order by fp limit 50")
def _(t: Tables):
    return t.fingerprints.orderBy("fp").limit(50).select("fp")


@query("fpdb_locations", "select fp, 'node-' || (part % 5) || ',node-9' as nodes from fingerprints where part % 2 = 0 union all select fp, 'node-9' from fingerprints where part % 2 = 1")
def _(t: Tables):
    here = F.array(F.concat(F.lit("node-"), (F.col("part") % 5).cast("string")))
    added = F.array_append(here, F.lit("node-9"))
    kept = F.when(F.col("part") % 2 == 1, F.filter(added, lambda x: x == "node-9")).otherwise(added)
    return t.fingerprints.select("fp", F.array_join(kept, ",").alias("nodes"))


@query("idx_get_by_hash", "select fp, refcount from fingerprints where fp = sha256('12') and part % 19 <> 0")
def _(t: Tables):
    return t.fingerprints.where((F.col("fp") == F.sha2(F.lit("12"), 256)) & (F.col("part") % 19 != 0)).select("fp", "refcount")


@query("idx_request_delete", "select 'del-' || substr(fp, 1, 16) as request_id from fingerprints where refcount = 0")
def _(t: Tables):
    return t.fingerprints.where("refcount = 0").select(F.concat(F.lit("del-"), F.substring("fp", 1, 16)).alias("request_id"))


_REFS = "(select l_partkey as key, l_shipdate::date as day, 1 as delta from lineitem union all select l_partkey, l_shipdate::date + 20 * l_linenumber, -1 from lineitem)"
_REQUESTS = "(select l_orderkey * 10 + l_linenumber as request_id, l_partkey as key, l_shipdate::date + 30 * l_linenumber as requested, case when l_linenumber <> 3 then l_shipdate::date + 30 * l_linenumber + 14 end as decided from lineitem where l_linenumber <= 3)"
_COUNTS = f"(select key, day, sum(sum(delta)) over (partition by key order by day) as n from {_REFS} group by key, day)"


@query("delete_workflow", f"""select request_id, refs_requested, refs_decided, case when state = 'restored' then later end as restored, state from (
    select *, case when refs_requested > 0 then 'refused' when decided is null then 'pending' when refs_decided > 0 then 'rejected' when later <= decided + 30 then 'restored' else 'authorized' end as state from (
        select r.*, coalesce(a.n, 0)::bigint as refs_requested, case when decided is not null then coalesce(b.n, 0)::bigint end as refs_decided, c.day as later from {_REQUESTS} r
        asof left join {_COUNTS} a on r.key = a.key and r.requested >= a.day
        asof left join {_COUNTS} b on r.key = b.key and r.decided >= b.day
        asof left join (select distinct key, day from {_REFS} where delta > 0) c on r.key = c.key and r.decided < c.day))""")
def _(t: Tables):
    """References come and go with shipments; what became of requests to delete, as of their days."""
    number, shipped = F.col("l_linenumber"), F.to_date("l_shipdate")
    lines = t.read("lineitem").select(F.col("l_partkey").alias("key"), "l_orderkey", "l_linenumber", shipped.alias("day"), F.date_add(shipped, 20 * number).alias("back"), F.date_add(shipped, 30 * number).alias("requested"))
    changes = lines.select("key", "day", F.lit(1).alias("delta")).unionByName(lines.select("key", F.col("back").alias("day"), F.lit(-1).alias("delta")))
    requests = lines.where(number <= 3).select((F.col("l_orderkey") * 10 + number).alias("request_id"), "key", "requested", F.when(number != 3, F.date_add("requested", 14)).alias("decided"))
    return Y.delete_states(requests, changes).select("request_id", "refs_requested", "refs_decided", "restored", "state")


@query("join_fp_lookup", "select q.key, f.fp is not null as found, coalesce(f.refcount, 0) as refcount from (select item_id as key, sha256((item_id * 7)::varchar) as fp from benchmark) q left join fingerprints f on q.fp = f.fp")
def _(t: Tables):
    keys = t.read("benchmark").select(F.col("item_id").alias("key"), F.sha2((F.col("item_id") * 7).cast("string"), 256).alias("fp"))
    rows = keys.join(t.fingerprints.select("fp", "refcount", F.lit(True).alias("there")), "fp", "left")
    return rows.select("key", F.coalesce("there", F.lit(False)).alias("found"), F.coalesce("refcount", F.lit(0)).alias("refcount"))


_LAYER = _filter("(select fp as x from fingerprints)")
_BIT = f"(select key, unnest(list_transform(range({_HASHES}), lambda i: (a + i * b) % {_BITS})) as p from (select key, {_mod('sha256(fp)', 8)} as a, {_mod('md5(fp)', 4)} as b from q))"


@query("join_layered_lookup", f"""with q as (select item_id as key, sha256((item_id * 7)::varchar) as fp from benchmark),
    probed as (select key, bool_and(coalesce((bits >> (p % 63)) & 1, 0) = 1) as maybe from {_BIT} left join {_LAYER} w on w.word = p // 63 group by key)
    select q.key, case when not maybe then 'bloom' when c.fp is not null then 'cache' when f.fp is not null then 'index' else 'miss' end as source
    from q join probed on probed.key = q.key left join (select fp from fingerprints where tier = 'hot') c on q.fp = c.fp left join fingerprints f on q.fp = f.fp""")
def _(t: Tables):
    """A filter of all fingerprints is asked first; what it may hold is looked for in the cache, then in the index."""
    words = D.bloom_words(t.fingerprints, "fp", _CAPACITY, _ERROR)
    keys = t.read("benchmark").select(F.col("item_id").alias("key"), F.sha2((F.col("item_id") * 7).cast("string"), 256).alias("fp"))
    probed = D.bloom_probe(keys, "fp", words, _CAPACITY, _ERROR)
    cache = t.fingerprints.where("tier = 'hot'").select("fp", F.lit("cache").alias("in_cache"))
    index = t.fingerprints.select("fp", F.lit("index").alias("in_index"))
    rows = probed.where("maybe").join(cache, "fp", "left").join(index, "fp", "left").select("key", F.coalesce("in_cache", "in_index", F.lit("miss")).alias("source"))
    return rows.unionByName(probed.where("not maybe").select("key", F.lit("bloom").alias("source")))


@query("fn_usage_percent", "select node_id, load * 100.0::double / 8 as percent from nodes")
def _(t: Tables):
    return t.nodes.select("node_id", S.usage_percent(F.col("load"), F.lit(8)).alias("percent"))


@query("fn_data_value", "select file_id, case when contains(lower(text), 'license') then 'LOW' when strlen(text) > 5000 then 'HIGH' else 'MEDIUM' end as value from files")
def _(t: Tables):
    return t.files.select("file_id", S.first_of([(F.lower("text").contains("license"), "LOW"), (F.col("size") > 5000, "HIGH")], "MEDIUM").alias("value"))


@query("lru_cache", "select tier, fp from (select tier, fp, row_number() over (partition by tier order by accessed desc, fp) as place from fingerprints) where place <= 20")
def _(t: Tables):
    place = F.row_number().over(Window.partitionBy("tier").orderBy(F.col("accessed").desc(), "fp"))
    return t.fingerprints.withColumn("place", place).where("place <= 20").select("tier", "fp")
