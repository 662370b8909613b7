"""Queries over metrics, tasks, health and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import ops as O
from ..sources.shared import shared_folder
from ..sources.sinks import export_report
from ..streaming.stores import StateLog
from .catalog import Tables
from .registry import query

_ALERTS = "select sample, node, metric, value, threshold, case when value >= threshold * 1.1::double then 'critical' else 'warning' end as level from (select *, case metric when 'cpu' then 80.0::double when 'memory' then 85.0::double when 'disk' then 90.0::double end as threshold from metrics) where value > threshold"
_N = lambda: F.count(F.lit(1)).alias("n")


@query("mon_alerts", _ALERTS)
def _(t: Tables):
    return O.alerts(t.metrics).select("sample", "node", "metric", "value", "threshold", "level")


@query("agg_alert_summary", f"select count(*) filter (where level = 'critical') as critical, count(*) filter (where level = 'warning') as warning from ({_ALERTS})")
def _(t: Tables):
    return O.alerts(t.metrics).agg(F.count_if(F.col("level") == "critical").alias("critical"), F.count_if(F.col("level") == "warning").alias("warning"))


@query("alert_history", f"select node, metric, max(sample) as last from ({_ALERTS}) group by 1, 2 order by last desc limit 100")
def _(t: Tables):
    return O.alerts(t.metrics).groupBy("node", "metric").agg(F.max("sample").alias("last")).orderBy(F.col("last").desc()).limit(100)


@query("agg_histogram", "select bound, count(*) filter (where value <= top) as n from metrics, (values ('10.0', 10.0::double), ('50.0', 50.0::double), ('90.0', 90.0::double), ('+Inf', 'infinity'::double)) b(bound, top) group by 1")
def _(t: Tables):
    return O.histogram(t.metrics, "value", [10.0, 50.0, 90.0])


@query("agg_dashboard_avg", "select metric, round(avg(value), 6) as mean from metrics where minute >= '2024-01-29 00:00' group by 1")
def _(t: Tables):
    return t.metrics.where("minute >= '2024-01-29 00:00'").groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("win_metrics_history", "select sample from metrics where minute >= '2024-01-28 12:00' and metric = 'cpu'")
def _(t: Tables):
    return t.metrics.where("minute >= '2024-01-28 12:00' and metric = 'cpu'").select("sample")


@query("win_rate_limit", "select sample, count(*) over (partition by node order by sample range between 59 preceding and current row) <= 10 as allowed from metrics")
def _(t: Tables):
    return O.rate_limited(t.metrics, F.col("sample"), 10).select("sample", "allowed")


@query("sink_prometheus", "select metric || '{node=\"' || node || '\"} ' || max(value)::bigint as line from metrics group by metric, node")
def _(t: Tables):
    from ..sources.sinks import prometheus_lines

    rows = t.metrics.groupBy("metric", "node").agg(F.max("value").cast("long").alias("value"))
    return prometheus_lines(rows.select(F.col("metric").alias("name"), F.concat(F.lit('node="'), "node", F.lit('"')).alias("labels"), "value"))


@query("sink_prometheus_sys", "select metric || '{host=\"all\"} ' || count(*) as line from metrics group by metric")
def _(t: Tables):
    from ..sources.sinks import prometheus_lines

    rows = t.metrics.groupBy("metric").agg(F.count(F.lit(1)).alias("value"))
    return prometheus_lines(rows.select(F.col("metric").alias("name"), F.lit('host="all"').alias("labels"), "value"))


@query("fn_json_extract", "select task_id, json_extract_string(result, '$.space_freed')::bigint as freed from tasks")
def _(t: Tables):
    return t.tasks.select("task_id", F.get_json_object("result", "$.space_freed").cast("long").alias("freed"))


@query("agg_operation_stats", "select coalesce(status, 'all') as status, coalesce(task_type, 'all') as task_type, count(*) as n, sum(json_extract_string(result, '$.space_freed')::bigint)::bigint as freed from tasks group by cube(status, task_type)")
def _(t: Tables):
    rows = t.tasks.cube("status", "task_type").agg(_N(), F.sum(F.get_json_object("result", "$.space_freed").cast("long")).alias("freed"))
    return rows.withColumn("status", F.coalesce("status", F.lit("all"))).withColumn("task_type", F.coalesce("task_type", F.lit("all")))


@query("agg_task_counts", "select status, count(*) as n from tasks group by 1")
def _(t: Tables):
    return t.tasks.groupBy("status").agg(_N())


@query("agg_state_stats", "select s.status, count(t.task_id) as n from (values ('pending'), ('running'), ('completed'), ('failed'), ('cancelled'), ('archived')) s(status) left join tasks t on t.status = s.status group by 1")
def _(t: Tables):
    states = t.spark.sql("select * from values ('pending'), ('running'), ('completed'), ('failed'), ('cancelled'), ('archived') as s(status)")
    return states.join(t.tasks.groupBy("status").agg(_N()), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_queue_stats", "select count(*) filter (where status = 'pending') as pending, count(*) filter (where status = 'running') as running, count(*) filter (where status = 'failed') as failed, count(*) filter (where retries >= 4) as dead from tasks")
def _(t: Tables):
    c = lambda s: F.count_if(F.col("status") == s).alias(s)
    return t.tasks.agg(c("pending"), c("running"), c("failed"), F.count_if(F.col("retries") >= 4).alias("dead"))


@query("sort_pending_tasks", "select task_id from tasks where status = 'pending' order by priority, created limit 50")
def _(t: Tables):
    return t.tasks.where("status = 'pending'").orderBy("priority", "created").limit(50).select("task_id")


@query("sort_scan_history", "select task_id from tasks where task_type = 'scan' order by created desc, task_id limit 20")
def _(t: Tables):
    return t.tasks.where("task_type = 'scan'").orderBy(F.col("created").desc(), "task_id").limit(20).select("task_id")


@query("ops_list", "select task_id, status from tasks where status = 'failed' order by created desc, task_id limit 50")
def _(t: Tables):
    return t.tasks.where("status = 'failed'").orderBy(F.col("created").desc(), "task_id").limit(50).select("task_id", "status")


@query("ops_approve", "select task_id, case when status = 'pending' and priority < 2 then 'approved' else status end as status from tasks")
def _(t: Tables):
    return t.tasks.select("task_id", F.when((F.col("status") == "pending") & (F.col("priority") < 2), "approved").otherwise(F.col("status")).alias("status"))


@query("user_tasks", "select task_id from tasks where user_id = 'u3' and status = 'completed' order by created desc, task_id limit 1000")
def _(t: Tables):
    return t.tasks.where("user_id = 'u3' and status = 'completed'").orderBy(F.col("created").desc(), "task_id").limit(1000).select("task_id")


@query("str_retry_queue", """select task_id, priority, retries + case when status = 'failed' then 1 else 0 end as attempts, case when status = 'failed' and retries >= 3 then 'dead' when rank <= 50 then 'running' else 'waiting' end as state
    from (select *, row_number() over (partition by status = 'failed' and retries >= 3 order by priority desc, created, task_id) as rank from tasks where status in ('failed', 'pending'))""")
def _(t: Tables):
    """Tasks that wait or have failed, put in twice; fifty run at a time, the most urgent first, and what failed too often is set aside."""
    given = t.tasks.where("status in ('failed', 'pending')")
    return O.retry_queue(given.unionByName(given.where("priority > 1")), slots=50).select("task_id", "priority", "attempts", "state")


@query("ext_task_handlers", "select task_id, task_type, case task_type when 'scan' then created * 2 when 'dedup' then created + retries end as outcome, case when task_type = 'archive' then 'no handler' end as problem from tasks")
def _(t: Tables):
    """Each kind of task goes through the handler that is registered for it."""
    handlers = O.Handlers("task_type")
    handlers.register("scan", lambda rows: rows.withColumn("outcome", F.col("created") * 2))
    handlers.register("dedup", lambda rows: rows.withColumn("outcome", F.col("created") + F.col("retries")))
    return handlers.run(t.tasks).select("task_id", "task_type", "outcome", "problem")


@query("ext_processors", "select line_no, action, case action when 'keep' then original_size when 'compress' then floor(original_size * 0.3::double)::bigint else floor(original_size * 0.1::double)::bigint end as kept from audit_log")
def _(t: Tables):
    """Each strategy has its processor."""
    processors = O.Handlers("action")
    for action, share in (("keep", 1.0), ("compress", 0.3), ("sample", 0.1)):
        processors.register(action, lambda rows, share=share: rows.withColumn("kept", F.floor(F.col("original_size") * share).cast("long")))
    return processors.run(t.audit_log).select("line_no", "action", "kept")


@query("ext_health_checks", "select metric, case when max(value) >= 95 then 'UNHEALTHY' when max(value) >= 80 then 'DEGRADED' else 'HEALTHY' end as status, count(*) as samples from metrics where metric <> 'memory' group by 1 union all select metric, case when avg(value) >= 90 then 'UNHEALTHY' else 'HEALTHY' end, count(*) from metrics where metric = 'memory' group by 1")
def _(t: Tables):
    """Each component has a check of its own."""
    checks = O.Handlers("metric")
    top = F.max("value")
    for metric in ("cpu", "disk"):
        checks.register(metric, lambda rows: rows.groupBy("metric").agg(S.first_of([(top >= 95, "UNHEALTHY"), (top >= 80, "DEGRADED")], "HEALTHY").alias("status"), F.count(F.lit(1)).alias("samples")))
    checks.register("memory", lambda rows: rows.groupBy("metric").agg(F.when(F.avg("value") >= 90, "UNHEALTHY").otherwise("HEALTHY").alias("status"), F.count(F.lit(1)).alias("samples")))
    return checks.run(t.metrics).select("metric", "status", "samples")


@query("str_schedule", "select task_id, case task_type when 'scan' then created + 3600 when 'dedup' then (created // 86400 + 1) * 86400 end as next_run from tasks")
def _(t: Tables):
    nxt = S.first_of([(F.col("task_type") == "scan", F.col("created") + 3600), (F.col("task_type") == "dedup", (F.floor(F.col("created") / 86400) + 1) * 86400)])
    return t.tasks.select("task_id", nxt.alias("next_run"))


@query("win_state_machine", "select task_id, before, status, before || '>' || status in ('pending>running', 'running>completed', 'running>failed', 'failed>pending') as legal from (select *, lag(status) over (partition by user_id order by created) as before from tasks) where before is not null and before <> status")
def _(t: Tables):
    return O.transitions(t.tasks, "user_id", "created", "status").select("task_id", "before", "status", "legal")


@query("win_eta", "select task_id, (sum(created) over (partition by user_id order by created))::bigint as done, round(sum(created) over (partition by user_id order by created) * 100.0::double / sum(created) over (partition by user_id), 6) as percent from tasks")
def _(t: Tables):
    return O.progress(t.tasks, "user_id", "created", "created").select("task_id", "done", "percent")


@query("join_left_channels", "select t.task_id, coalesce(c.name, t.task_id) as channel from tasks t left join (values ('u1', 'mail'), ('u2', 'chat')) c(id, name) on t.user_id = c.id order by t.created desc, t.task_id limit 100")
def _(t: Tables):
    channels = t.spark.sql("select * from values ('u1', 'mail'), ('u2', 'chat') as c(user_id, name)")
    rows = t.tasks.join(F.broadcast(channels), "user_id", "left")  # two rows
    return rows.orderBy(F.col("created").desc(), "task_id").limit(100).select("task_id", F.coalesce("name", "task_id").alias("channel"))


_BEATS = "(select node_id, healthy, case node_id when 'node-2' then 20 else load end as age from nodes)"


@query("join_health_nodes", f"select t.task_id, 'node-' || (created % 6) as node from tasks t left join {_BEATS} b on b.node_id = 'node-' || (created % 6) where t.status = 'running' and (b.node_id is null or not b.healthy or b.age > 15)")
def _(t: Tables):
    beats = t.nodes.select(F.col("node_id").alias("node"), "healthy", F.when(F.col("node_id") == "node-2", 20).otherwise(F.col("load")).alias("age"))
    rows = t.tasks.where("status = 'running'").withColumn("node", F.concat(F.lit("node-"), (F.col("created") % 6).cast("string")))
    return rows.join(beats, "node", "left").where("healthy is null or not healthy or age > 15").select("task_id", "node")


@query("str_recovery", f"select t.task_id from tasks t left join {_BEATS} b on b.node_id = 'node-' || (created % 6) where t.status = 'running' and (b.node_id is null or not b.healthy)")
def _(t: Tables):
    rows = t.tasks.where("status = 'running'").withColumn("node_id", F.concat(F.lit("node-"), (F.col("created") % 6).cast("string")))
    return rows.join(t.nodes.where("healthy").select("node_id"), "node_id", "left_anti").select("task_id")


@query("hb_recoverable", "select task_id, 'node-' || (created % 6) as node, 1 as version from tasks where status = 'running' and created % 6 = 3")
def _(t: Tables):
    """States that tasks left in a log, of those on nodes that are not healthy; what was finished since is gone."""
    log = StateLog(t.spark, shared_folder(t.spark, "tasks"))
    node = F.concat(F.lit("node-"), (F.col("created") % 6).cast("string"))
    state = F.to_json(F.struct(node.alias("node"), F.lit("ACTIVE").alias("status")))
    begun = t.tasks.where("status in ('running', 'completed')").select(F.col("task_id").alias("key"), state.alias("state"), F.lit(None).cast("timestamp").alias("expires"))
    log.commit(begun, 0)
    log.commit(t.tasks.where("status = 'completed'").select(F.col("task_id").alias("key"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("timestamp").alias("expires")), 1)
    held = log.current("2025-06-30").select(F.col("key").alias("task_id"), F.from_json("state", "node string, status string").alias("s"), "version").where("s.status = 'ACTIVE'")
    return held.join(t.nodes.where("not healthy"), F.col("s.node") == F.col("node_id"), "left_semi").select("task_id", F.col("s.node").alias("node"), "version")


@query("hb_expire", "select task_id from tasks where status in ('completed', 'failed', 'cancelled') and created < 500")
def _(t: Tables):
    return t.tasks.where("status in ('completed', 'failed', 'cancelled') and created < 500").select("task_id")


@query("hb_overall", "select case when bool_or(not healthy) then 'UNHEALTHY' when bool_or(load > 5) then 'DEGRADED' else 'HEALTHY' end as status from nodes")
def _(t: Tables):
    return O.overall_health(t.nodes.select(S.first_of([(~F.col("healthy"), "UNHEALTHY"), (F.col("load") > 5, "DEGRADED")], "HEALTHY").alias("status")))


@query("hb_disk", "select sample, case when value / 100 >= 0.9 then 'UNHEALTHY' when value / 100 >= 0.72 then 'DEGRADED' else 'HEALTHY' end as status from metrics where metric = 'disk'")
def _(t: Tables):
    return t.metrics.where("metric = 'disk'").select("sample", O.disk_health(F.col("value") / 100).alias("status"))


@query("hb_leader", "select min(node_id) as leader from nodes where healthy")
def _(t: Tables):
    return t.nodes.where("healthy").agg(F.min("node_id").alias("leader"))


@query("agg_cluster_health", "select count(*) filter (where healthy) as healthy, count(*) filter (where not healthy) as unhealthy from nodes")
def _(t: Tables):
    return t.nodes.agg(F.count_if("healthy").alias("healthy"), F.count_if(~F.col("healthy")).alias("unhealthy"))


_EXPERIMENT = "(select camera as method, frame as item, motion as reduction, 20 + level / 10.0::double as psnr from frames)"


def _experiment(t: Tables):
    return t.frames.select(F.col("camera").alias("method"), F.col("frame").alias("item"), F.col("motion").alias("reduction"), (20 + F.col("level") / 10.0).alias("psnr"))


@query("agg_m0_report", f"select count(*) as n, round(avg(reduction), 6) as mean_reduction, round(sum(reduction * (1 - reduction)) / sum(1 - reduction), 6) as output_weighted_reduction, round(avg(psnr), 6) as psnr from {_EXPERIMENT}")
def _(t: Tables):
    out = 1 - F.col("reduction")
    return _experiment(t).agg(_N(), F.round(F.avg("reduction"), 6).alias("mean_reduction"), F.round(F.sum(F.col("reduction") * out) / F.sum(out), 6).alias("output_weighted_reduction"), F.round(F.avg("psnr"), 6).alias("psnr"))


@query("agg_m1_report", f"select round(avg(reduction), 6) as mean_reduction, round(count(*) filter (where reduction > 0) / count(*)::double, 6) as positive, round(min(psnr), 6) as worst, round(avg(psnr), 6) as mean_psnr from {_EXPERIMENT}")
def _(t: Tables):
    return _experiment(t).agg(F.round(F.avg("reduction"), 6).alias("mean_reduction"), F.round(F.count_if(F.col("reduction") > 0) / F.count(F.lit(1)), 6).alias("positive"), F.round(F.min("psnr"), 6).alias("worst"), F.round(F.avg("psnr"), 6).alias("mean_psnr"))


@query("agg_m2_report", f"select method, round(avg(reduction), 6) as mean_reduction, case when avg(reduction) >= 0.5 then 'adopt' when avg(reduction) >= 0.2 then 'tune' else 'reject' end as advice from {_EXPERIMENT} group by 1")
def _(t: Tables):
    mean = F.avg("reduction")
    return _experiment(t).groupBy("method").agg(F.round(mean, 6).alias("mean_reduction"), S.first_of([(mean >= 0.5, "adopt"), (mean >= 0.2, "tune")], "reject").alias("advice"))


@query("agg_m3_report", "select task_type, count(*) as n, count(*) filter (where status = 'completed') as done, round(count(*) filter (where status = 'completed') / count(*)::double, 6) as rate from tasks group by 1")
def _(t: Tables):
    done = F.count_if(F.col("status") == "completed")
    return t.tasks.groupBy("task_type").agg(_N(), done.alias("done"), F.round(done / F.count(F.lit(1)), 6).alias("rate"))


@query("agg_roi", "select bytes, round((1e12::double / bytes), 6) as scale, round(bytes * 0.6::double / 1099511627776.0::double * 5000, 6) as yearly from (select sum(size)::bigint as bytes from files)")
def _(t: Tables):
    return t.files.agg(F.sum("size").alias("bytes")).select("bytes", F.round(F.try_divide(F.lit(1e12), F.col("bytes").cast("double")), 6).alias("scale"), F.round(F.col("bytes") * 0.6 / 1099511627776.0 * 5000, 6).alias("yearly"))


@query("agg_roi_v2", "select y as years, round(bytes * 365.0::double * y / 1099511627776.0::double, 6) as tb from (select sum(size)::bigint as bytes from files), (values (1), (3), (5)) v(y)")
def _(t: Tables):
    years = F.explode(F.array(F.lit(1), F.lit(3), F.lit(5)))
    return t.files.agg(F.sum("size").alias("bytes")).select("bytes", years.alias("years")).select("years", F.round(F.col("bytes") * 365.0 * F.col("years") / 1099511627776.0, 6).alias("tb"))


@query("agg_roi_web", "select round(sum(size) * 1000.0::double * 365 / 7 / 1125899906842624.0::double, 9) as pb from files")
def _(t: Tables):
    return t.files.agg(F.round(F.sum("size") * 1000.0 * 365 / 7 / 1125899906842624.0, 9).alias("pb"))


@query("sink_export_report", "select 'files' as item, count(*)::varchar as value from files union all select 'bytes', sum(size)::bigint::varchar from files")
def _(t: Tables):
    row = t.files.agg(F.count(F.lit(1)).cast("string").alias("files"), F.sum("size").cast("string").alias("bytes"))
    return row.select(F.explode(F.create_map(F.lit("files"), F.col("files"), F.lit("bytes"), F.col("bytes"))).alias("item", "value"))


_REPORTED = "(select event_type, count(*) as n, sum(original_size)::bigint as bytes, min(ts) as first, max(ts) as last from audit_log group by 1)"


@query("sink_compliance_export", f"""select 'json' as form, '{{"event_type":"' || event_type || '","n":' || n || ',"bytes":' || bytes || ',"first":"' || first || '","last":"' || last || '"}}' as line from {_REPORTED}
    union all select 'text', rpad(event_type, 20, ' ') || lpad(n::varchar, 12, ' ') || lpad(bytes::varchar, 20, ' ') || '  ' || first || ' to ' || last from {_REPORTED}
    union all select 'html', '<tr><td>' || event_type || '</td><td>' || n || '</td><td>' || bytes || '</td><td>' || first || '</td><td>' || last || '</td></tr>' from {_REPORTED}""")
def _(t: Tables):
    """A report by event, written in each form and read back line by line."""
    rows = t.audit_log.groupBy("event_type").agg(_N(), F.sum("original_size").alias("bytes"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    out = None
    for form in ("json", "text", "html"):
        path = shared_folder(t.spark, "report")
        export_report(rows, path, form)
        lines = t.spark.read.text(path).select(F.lit(form).alias("form"), F.col("value").alias("line"))
        out = lines if out is None else out.unionByName(lines)
    return out
