"""Queries over the audit trail and policy versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from .catalog import AS_OF, Tables
from .registry import query

_HASH = "sha256(concat_ws('|', " + ", ".join(f"coalesce({c}::varchar, '')" for c in A.HASHED) + "))"
_CHAIN = f"select *, coalesce(lag(entry_hash) over (order by line_no), '') as previous_hash from (select *, {_HASH} as entry_hash from audit_log)"
_LIMITS = {"video": 30, "log": 500, "document": 3000, "image": 365}
_SAVED = lambda a, b: f"case when {a} = 0 then 0.0::double else round((1 - {b} / {a}::double) * 100, 4) end"


@query("src_audit_jsonl", "select event_type, count(*) as n from audit_log group by 1")
def _(t: Tables):
    rows = t.audit_log.select(F.to_json(F.struct(*t.audit_log.columns)).alias("line"))
    parsed = rows.select(F.from_json("line", t.audit_log.schema).alias("e")).select("e.*")
    return parsed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("src_audit_pipe", "select line_no, actor, action, original_size from audit_log where line_no % 5 <> 0")
def _(t: Tables):
    parts = ["ts", "actor", "action", "data_id", "data_type", "original_size", "new_size"]
    line = F.when(F.col("line_no") % 5 == 0, F.concat_ws("|", "ts", "actor")).otherwise(F.concat_ws("|", *[F.col(c).cast("string") for c in parts]))
    rows = t.audit_log.select("line_no", F.split(line, r"\|").alias("p")).where(F.size("p") >= 7)
    return rows.select("line_no", F.col("p")[1].alias("actor"), F.col("p")[2].alias("action"), F.col("p")[5].cast("long").alias("original_size"))


@query("fn_entry_hash", f"select entry_id, {_HASH} as entry_hash from audit_log")
def _(t: Tables):
    return t.audit_log.select("entry_id", A.entry_hash().alias("entry_hash"))


@query("win_hash_chain", f"select line_no, entry_hash, previous_hash from ({_CHAIN})")
def _(t: Tables):
    return A.chained(t.audit_log).select("line_no", "entry_hash", "previous_hash")


@query("audit_verify_chain", f"select line_no, broken_link, changed from (select line_no, previous_hash <> coalesce(lag(entry_hash) over (order by line_no), '') as broken_link, entry_hash <> {_HASH} as changed from (select * replace (case when line_no % 100 = 4 then new_size + 1 else new_size end as new_size) from ({_CHAIN}) where line_no % 100 <> 7)) where broken_link or changed")
def _(t: Tables):
    changed = A.chained(t.audit_log).where("line_no % 100 <> 7").withColumn("new_size", F.when(F.col("line_no") % 100 == 4, F.col("new_size") + 1).otherwise(F.col("new_size")))
    return A.verify_chain(changed)


@query("sink_audit_append", f"select count(*) as n, count(distinct entry_hash) as hashes, max(line_no) as last_line from ({_CHAIN})")
def _(t: Tables):
    return A.chained(t.audit_log).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entry_hash").alias("hashes"), F.max("line_no").alias("last_line"))


@query("flt_audit_query", "select line_no, entry_id from audit_log where ts >= '1994-01-01' and ts <= '1996-12-31' and event_type in ('DATA_REDUCED', 'DATA_DELETED') and data_type in ('video', 'log') order by line_no limit 100 offset 10")
def _(t: Tables):
    return A.audit_query(t.audit_log, "1994-01-01", "1996-12-31", ["DATA_REDUCED", "DATA_DELETED"], ["video", "log"], offset=10, limit=100).select("line_no", "entry_id")


@query("flt_audit_simple", "select line_no from audit_log where action = 'keep' and ts >= '1995-01-01'")
def _(t: Tables):
    return A.audit_query(t.audit_log, "1995-01-01").where("action = 'keep'").select("line_no")


@query("flt_dedup_logs", "select line_no from audit_log where substr(ts, 1, 7) = '1995-03' and action = 'compress'")
def _(t: Tables):
    return t.audit_log.where("substr(ts, 1, 7) = '1995-03' and action = 'compress'").select("line_no")


@query("agg_audit_stats", "select case when grouping(event_type) = 0 then 'event_type' else 'data_type' end as dimension, coalesce(event_type, data_type) as value, count(*) as n from audit_log group by grouping sets ((event_type), (data_type))")
def _(t: Tables):
    return A.counts_by(t.audit_log, ["event_type", "data_type"])


@query("agg_compliance_metrics", "select case when grouping(event_type) = 0 then 'event_type' when grouping(data_type) = 0 then 'data_type' when grouping(action) = 0 then 'action' else 'classification' end as dimension, coalesce(event_type, data_type, action, classification) as value, count(*) as n from audit_log group by grouping sets ((event_type), (data_type), (action), (classification))")
def _(t: Tables):
    return A.counts_by(t.audit_log, ["event_type", "data_type", "action", "classification"])


@query("agg_reduction_by_type", f"select data_type, count(*) as n, sum(original_size)::bigint as original_bytes, sum(new_size)::bigint as new_bytes, {_SAVED('sum(original_size)', 'sum(new_size)')} as saved_percent from audit_log where event_type = 'DATA_REDUCED' group by 1")
def _(t: Tables):
    rows = t.audit_log.where("event_type = 'DATA_REDUCED'").groupBy("data_type").agg(F.count(F.lit(1)).alias("n"), F.sum("original_size").alias("original_bytes"), F.sum("new_size").alias("new_bytes"))
    return rows.withColumn("saved_percent", A.percent_saved(F.col("original_bytes"), F.col("new_bytes")))


@query("agg_compliance_summary", f"select entries, ingested, reduced, original_bytes, new_bytes, {_SAVED('original_bytes', 'new_bytes')} as saved_percent from (select count(*) as entries, count(*) filter (where event_type = 'DATA_INGESTED') as ingested, count(*) filter (where event_type = 'DATA_REDUCED') as reduced, sum(original_size)::bigint as original_bytes, sum(new_size)::bigint as new_bytes from audit_log)")
def _(t: Tables):
    return A.summary(t.audit_log)


_RETENTION = f"""select data_type, limit_days, count(*) filter (where age <= limit_days) as within, count(*) filter (where age > limit_days) as beyond from (
    select data_type, datediff('day', substr(ts, 1, 10)::date, date '{AS_OF}') as age, case data_type {' '.join(f"when '{k}' then {v}" for k, v in _LIMITS.items())} end::int as limit_days from audit_log) where limit_days is not null group by 1, 2"""


@query("agg_retention", _RETENTION)
def _(t: Tables):
    return A.retention(t.audit_log, _LIMITS, AS_OF)


@query("gdpr_check", f"select 'high' as severity, 'Data Retention' as category, data_type as subject, beyond as n from ({_RETENTION}) where beyond > 0")
def _(t: Tables):
    return A.retention_findings(t.audit_log, _LIMITS, AS_OF)


_CONTROLS = """select category, severity, n from (select 'CC7.2' as category, 'medium' as severity, count(*) filter (where event_type = 'ANOMALY_DETECTED' and action <> 'keep') as n, count(*) filter (where event_type = 'ANOMALY_DETECTED' and action <> 'keep') > 0 as hit from audit_log
    union all select 'CC7.1', 'medium', 0, count(*) filter (where event_type in ('DATA_INGESTED', 'DATA_REDUCED', 'ANOMALY_DETECTED')) = 0 from audit_log
    union all select 'CC6.1', 'low', 0, count(*) filter (where event_type = 'USER_ACCESS') = 0 from audit_log
    union all select 'CC8.1', 'medium', count(*) filter (where event_type in ('POLICY_CREATED', 'POLICY_UPDATED', 'POLICY_DELETED') and classification = 'LOW'), count(*) filter (where event_type in ('POLICY_CREATED', 'POLICY_UPDATED', 'POLICY_DELETED') and classification = 'LOW') > 0 from audit_log) where hit"""


@query("soc2_check", _CONTROLS)
def _(t: Tables):
    return A.control_findings(t.audit_log)


@query("set_findings_union", f"select category, severity, n from ({_CONTROLS}) union all select 'Data Retention', 'high', beyond from ({_RETENTION}) where beyond > 0")
def _(t: Tables):
    return A.control_findings(t.audit_log).unionByName(A.retention_findings(t.audit_log, _LIMITS, AS_OF).select("category", "severity", "n"))


@query("compliance_report", f"select 'entries' as section, count(*)::double as value from audit_log union all select 'findings', count(*)::double from (select 1 from ({_CONTROLS}) union all select 1 from ({_RETENTION}) where beyond > 0) union all select 'changes', count(*)::double from audit_log where event_type in ('POLICY_CREATED', 'POLICY_UPDATED')")
def _(t: Tables):
    log = t.audit_log
    findings = A.control_findings(log).select("n").unionByName(A.retention_findings(log, _LIMITS, AS_OF).select("n"))
    size = lambda name, df: df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("section"), "value")
    return size("entries", log).unionByName(size("findings", findings)).unionByName(size("changes", log.where("event_type in ('POLICY_CREATED', 'POLICY_UPDATED')")))


@query("agg_audit_report", "select action, count(*) as n, sum(original_size)::bigint as bytes_before, sum(coalesce(nullif(new_size, 0), original_size))::bigint as bytes_after from audit_log group by 1")
def _(t: Tables):
    after = F.coalesce(F.nullif("new_size", F.lit(0).cast("long")), "original_size")
    return t.audit_log.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("original_size").alias("bytes_before"), F.sum(after).alias("bytes_after"))


@query("agg_reducer_stats", "select case when grouping(action) = 0 then 'action' else 'classification' end as dimension, coalesce(action, classification) as value, count(*) as n from audit_log group by grouping sets ((action), (classification))")
def _(t: Tables):
    return A.counts_by(t.audit_log, ["action", "classification"])


@query("audit_archive_split", "select ts < '1995-06-01' as archived, count(*) as n, min(line_no) as first_line from audit_log group by 1")
def _(t: Tables):
    old, new = t.audit_log.where("ts < '1995-06-01'"), t.audit_log.where("ts >= '1995-06-01'")
    rows = old.withColumn("archived", F.lit(True)).unionByName(new.withColumn("archived", F.lit(False)))
    return rows.groupBy("archived").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))


@query("audit_processing_rows", f"select entry_id, data_type, original_size, new_size, {_SAVED('original_size', 'new_size')} as saved_percent from audit_log where event_type = 'DATA_REDUCED'")
def _(t: Tables):
    rows = t.audit_log.where("event_type = 'DATA_REDUCED'")
    return rows.select("entry_id", "data_type", "original_size", "new_size", A.percent_saved(F.col("original_size"), F.col("new_size")).alias("saved_percent"))


@query("audit_policy_changes", "select entry_id, ts, actor, event_type, policy_id from audit_log where event_type in ('POLICY_CREATED', 'POLICY_UPDATED')")
def _(t: Tables):
    return t.audit_log.where("event_type in ('POLICY_CREATED', 'POLICY_UPDATED')").select("entry_id", "ts", "actor", "event_type", "policy_id")


@query("audit_alerts", "select line_no, entry_id from audit_log where event_type = 'ANOMALY_DETECTED' order by line_no limit 10")
def _(t: Tables):
    return t.audit_log.where("event_type = 'ANOMALY_DETECTED'").orderBy("line_no").limit(10).select("line_no", "entry_id")


@query("audit_dashboard", "select round((sum(original_size) - sum(new_size)) / 1099511627776.0::double, 9) as saved_tb, round((1 - sum(new_size) / sum(original_size)::double) * 100, 4) as reduction from audit_log where event_type = 'DATA_REDUCED'")
def _(t: Tables):
    saved = (F.sum("original_size") - F.sum("new_size")) / 1099511627776.0
    return t.audit_log.where("event_type = 'DATA_REDUCED'").agg(F.round(saved, 9).alias("saved_tb"), F.round((1 - F.sum("new_size") / F.sum("original_size")) * 100, 4).alias("reduction"))


@query("sink_export_csv", "select entry_id, case when line_no % 3 = 0 then '''=' || actor else actor end as cell from audit_log")
def _(t: Tables):
    from ..sources.sinks import csv_safe

    cell = F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("="), "actor")).otherwise(F.col("actor"))
    return t.audit_log.select("entry_id", csv_safe(cell).alias("cell"))


@query("sink_export_audit", "select count(*) as n from audit_log where event_type = 'DATA_DELETED'")
def _(t: Tables):
    return t.audit_log.where("event_type = 'DATA_DELETED'").select(F.to_json(F.struct("entry_id", "ts")).alias("line")).agg(F.count("line").alias("n"))


# policy versions: conversations stand in, conversation = policy, turn = version
_VERSIONS = "(select conv_id as policy_id, turn as version, role as author, strlen(text)::bigint as config from conversations)"


def _versions(t: Tables):
    return t.read("conversations").select(F.col("conv_id").alias("policy_id"), F.col("turn").alias("version"), F.col("role").alias("author"), F.octet_length("text").cast("long").alias("config"))


@query("win_latest_version", f"select policy_id, max(version) as version, count(*) as versions, arg_max(config, version) as config from {_VERSIONS} group by 1")
def _(t: Tables):
    return A.latest_version(_versions(t))


@query("pol_list", f"select policy_id from {_VERSIONS} group by 1 having max(version) >= 2")
def _(t: Tables):
    return A.latest_version(_versions(t)).where("version >= 2").select("policy_id")


@query("pol_update", f"select policy_id, 'a=' || max(version) || ',b=2' as config, max(version) + 1 as version from {_VERSIONS} group by 1")
def _(t: Tables):
    rows = A.latest_version(_versions(t))
    current = F.create_map(F.lit("a"), F.lit("0"), F.lit("_x"), F.lit("9"), F.lit("b"), F.lit("2"))
    config = A.merged_config(current, F.create_map(F.lit("a"), F.col("version").cast("string")))
    text = F.array_join(F.transform(F.array_sort(F.map_keys(config)), lambda k: F.concat(k, F.lit("="), F.element_at(config, k))), ",")
    return rows.select("policy_id", text.alias("config"), (F.col("version") + 1).alias("version"))


@query("pol_rollback", f"select a.policy_id, max(a.version) + 1 as version, max(case when a.version = 0 then a.config end) as config from {_VERSIONS} a group by 1")
def _(t: Tables):
    v = _versions(t)
    target = v.where("version = 0").select("policy_id", F.col("config").alias("old"))
    return A.latest_version(v).join(target, "policy_id", "left").select("policy_id", (F.col("version") + 1).alias("version"), F.col("old").alias("config"))


@query("sync_upsert_version", f"select policy_id, max(version) as last, count(*) as version from {_VERSIONS} group by 1")
def _(t: Tables):
    return _versions(t).groupBy("policy_id").agg(F.max("version").alias("last"), F.count(F.lit(1)).alias("version"))


@query("sync_status", f"select count(distinct policy_id) as paths, max(version) as newest from {_VERSIONS}")
def _(t: Tables):
    return _versions(t).agg(F.count_distinct("policy_id").alias("paths"), F.max("version").alias("newest"))


@query("sync_list", f"select policy_id, max(version) as last from {_VERSIONS} group by 1 order by last desc, policy_id limit 40")
def _(t: Tables):
    return _versions(t).groupBy("policy_id").agg(F.max("version").alias("last")).orderBy(F.col("last").desc(), "policy_id").limit(40)


@query("fn_validate_policy", f"select policy_id, version, (case when author not in ('user', 'assistant') then 'author;' else '' end) || (case when config < 20 then 'config;' else '' end) as errors from {_VERSIONS}")
def _(t: Tables):
    checks = F.array(F.when(~F.col("author").isin("user", "assistant"), F.lit("author;")), F.when(F.col("config") < 20, F.lit("config;")))
    return _versions(t).select("policy_id", "version", F.array_join(F.filter(checks, lambda x: x.isNotNull()), "").alias("errors"))


@query("ext_policy_templates", """select data_type, case data_type when 'video' then 'surveillance' when 'log' then 'application_log' when 'document' then 'database_log' else 'archive' end as template,
    case data_type when 'video' then 30 when 'log' then 90 when 'document' then 365 else 3650 end as retention_days,
    sum(floor(original_size * case data_type when 'video' then 0.3::double when 'log' then 0.5::double when 'document' then 1.0::double else 0.1::double end)::bigint)::bigint as kept from audit_log group by 1""")
def _(t: Tables):
    """What each kind of data would keep under its built-in policy."""
    return A.under_templates(t.audit_log)


@query("audit_text_report", "select 1 as line, 'entries: ' || count(*) as text from audit_log union all select 2, 'reduced: ' || count(*) from audit_log where event_type = 'DATA_REDUCED'")
def _(t: Tables):
    row = A.summary(t.audit_log)
    lines = F.array(F.struct(F.lit(1).alias("line"), F.concat(F.lit("entries: "), F.col("entries").cast("string")).alias("text")), F.struct(F.lit(2).alias("line"), F.concat(F.lit("reduced: "), F.col("reduced").cast("string")).alias("text")))
    return row.select(F.explode(lines).alias("l")).select("l.line", "l.text")
