"""Queries over log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as L
from ..functions import scalar as S
from .catalog import Tables
from .registry import query

_LEVEL = "case " + " ".join(f"when regexp_matches(raw_line, '{p}') then '{k}'" for k, p in L.LEVELS.items()) + " else 'UNKNOWN' end"


def _key(field: str) -> str:
    parts = [f"nullif(regexp_extract(raw_line, '(?i){p.replace(chr(39), chr(39) * 2)}', 1), '')" for p in L.KEYWORDS[field]]
    return f"coalesce({', '.join(parts)})"


_PARSED = f"""select block_id, line_number, regexp_extract(raw_line, '\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}}') as ts, {_LEVEL} as level,
    {', '.join(f'{_key(f)} as {f}' for f in L.KEYWORDS)},
    nullif(regexp_extract(raw_line, '(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\\s', 1), '') as http_method,
    nullif(regexp_extract(raw_line, '\\s(\\d{{3}})\\s', 1), '')::int as status,
    case when contains(regexp_extract(raw_line, '(?i)([a-zA-Z_]\\w*Exception)\\s*:\\s*(.+)', 0), 'Exception') then regexp_extract(raw_line, '(?i)([a-zA-Z_]\\w*Exception)\\s*:\\s*(.+)', 1) end as exception, raw_line from log_lines"""
_BURST = f"""select block_id, count(*) as survivors, count(*) >= 5 as error_burst from (
    select block_id, epoch(ts::timestamp)::bigint as t, max(epoch(ts::timestamp)::bigint) over (partition by block_id order by line_number rows between current row and unbounded following) as latest
    from ({_PARSED}) where level = 'ERROR') where t > latest - 60 group by 1"""
_MEMORY = " or ".join(f"contains(lower(raw_line), '{w}')" for w in L.MEMORY_WORDS)
_BLOCKS = f"""select p.*, coalesce(b.error_burst, false) as error_burst from (
    select block_id, count(*) as total_lines, count(*) filter (where level = 'ERROR') as error_count, count(*) filter (where level = 'WARN') as warn_count, count(*) filter (where level = 'INFO') as info_count,
    count(*) filter (where level in ('DEBUG', 'TRACE')) as debug_count, count(distinct user_id) as unique_users, count(distinct order_id) as unique_orders, count(distinct session_id) as unique_sessions,
    min(ts) as start_time, max(ts) as end_time, bool_or(contains(lower(raw_line), 'circuit breaker')) as circuit_breaker_open, bool_or(level = 'ERROR' and ({_MEMORY})) as memory_warning,
    count(*) filter (where level = 'ERROR' and contains(lower(raw_line), 'timeout')) >= 3 as timeout_pattern, round(count(*) filter (where level <> 'UNKNOWN') / count(*)::double, 6) as format_valid
    from ({_PARSED}) group by 1) p left join ({_BURST}) b on p.block_id = b.block_id"""
_SCORED = f"""select *, round(least(1.0::double, least(0.5::double, error_count * 0.1::double) + least(0.2::double, warn_count * 0.02::double) + case when error_burst then 0.2::double else 0 end + case when circuit_breaker_open then 0.15::double else 0 end
    + case when timeout_pattern then 0.1::double else 0 end + case when memory_warning then 0.15::double else 0 end + least(0.1::double, unique_orders * 0.01::double) + case when unique_users > 10 then 0.05::double else 0 end), 6) as preserve_score from ({_BLOCKS})"""
_PARSED_COLUMNS = "block_id, line_number, ts, level, " + ", ".join(L.KEYWORDS) + ", http_method, status, exception"


def _parsed(t: Tables, *fields: str):
    return L.parse_lines(t.log_lines, fields=fields or L.FIELDS)


def _blocks(t: Tables):
    return L.blocks(_parsed(t, *L.BLOCK_FIELDS))


@query("src_log_lines", "select block_id, count(*) as n, sum(strlen(raw_line))::bigint as bytes from log_lines group by 1")
def _(t: Tables):
    return t.log_lines.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("raw_line").cast("long")).alias("bytes"))


@query("op_parse_line", f"select {_PARSED_COLUMNS} from ({_PARSED})")
def _(t: Tables):
    return _parsed(t).drop("raw_line")


@query("fn_log_level", f"select line_number, {_LEVEL} as level from log_lines")
def _(t: Tables):
    return t.log_lines.select("line_number", L.log_level(F.col("raw_line")).alias("level"))


def _forms(t: Tables):
    """Lines whose times are plain, ISO with fraction and zone, syslog, in seconds and in milliseconds since 1970; and lines without one."""
    at, day = F.col("ts"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    forms = [
        F.concat(day, F.lit(" ERROR plain")),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z INFO iso")),
        F.concat(F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" host app: WARN syslog")),
        F.unix_seconds(at.cast("timestamp")).cast("string"),
        F.unix_millis(at.cast("timestamp")).cast("string"),
        F.lit("DEBUG no time at all"),
    ]
    line = F.element_at(F.array(*forms), (F.col("event_id") % 6 + 1).cast("int"))
    return t.read("events").select(F.lit("b").alias("block_id"), F.col("event_id").alias("line_number"), line.alias("raw_line"))


_FORM_TIMES = "select event_id as line_number, case event_id % 6 when 2 then strftime(ts, '1900-%m-%d %H:%M:%S') when 5 then {none} else strftime(ts, '%Y-%m-%d %H:%M:%S') end as ts from events"


@query("fn_log_timestamp", _FORM_TIMES.format(none="'2025-06-30 00:00:00'"))
def _(t: Tables):
    stamp = L.log_timestamp(F.col("raw_line"), F.lit("2025-06-30 00:00:00").cast("timestamp_ntz"))
    return _forms(t).select("line_number", F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("op_parse_times", f"select line_number, ts, ['ERROR', 'INFO', 'WARN', 'UNKNOWN', 'UNKNOWN', 'DEBUG'][line_number % 6 + 1] as level, epoch(ts::timestamp)::bigint as seconds from ({_FORM_TIMES.format(none='null')})")
def _(t: Tables):
    """Parsed lines bear the time of their line, whatever its form."""
    rows = L.parse_lines(_forms(t))
    return rows.select("line_number", "ts", "level", L.seconds_of(F.col("ts")).alias("seconds"))


@query("fn_log_exception", f"select line_number, exception from ({_PARSED})")
def _(t: Tables):
    return t.log_lines.select("line_number", L.exception_type(F.col("raw_line")).alias("exception"))


@query("fn_keywords", f"select line_number, {', '.join(L.KEYWORDS)} from ({_PARSED})")
def _(t: Tables):
    return t.log_lines.select("line_number", *[L.keyword(F.col("raw_line"), f).alias(f) for f in L.KEYWORDS])


@query("fn_http_info", f"select line_number, http_method, status from ({_PARSED})")
def _(t: Tables):
    return t.log_lines.select("line_number", L.http_method(F.col("raw_line")).alias("http_method"), L.http_status(F.col("raw_line")).alias("status"))


@query("fn_entry_value", "select line_number, case when contains(raw_line, 'ERROR') then 'HIGH' when contains(raw_line, 'WARN') then 'MEDIUM' else 'LOW' end as value from log_lines")
def _(t: Tables):
    has = lambda w: F.col("raw_line").contains(w)
    return t.log_lines.select("line_number", S.first_of([(has("ERROR"), "HIGH"), (has("WARN"), "MEDIUM")], "LOW").alias("value"))


@query("agg_log_block", f"select * from ({_BLOCKS})")
def _(t: Tables):
    return _blocks(t)


@query("agg_log_stats", f"select count(*) as blocks, sum(total_lines)::bigint as total, sum(error_count)::bigint as errors, round(avg(total_lines), 4) as mean_lines, round(sum(error_count) / sum(total_lines)::double, 6) as error_rate from ({_BLOCKS})")
def _(t: Tables):
    b = _blocks(t)
    return b.agg(F.count(F.lit(1)).alias("blocks"), F.sum("total_lines").alias("total"), F.sum("error_count").alias("errors"), F.round(F.avg("total_lines"), 4).alias("mean_lines"), F.round(F.sum("error_count") / F.sum("total_lines"), 6).alias("error_rate"))


@query("agg_most_common_error", f"select block_id, arg_max(name, n * 1000000000 - first) as most_common_error from (select block_id, regexp_extract(raw_line, '([A-Z]\\w*Exception)', 1) as name, count(*) as n, min(line_number) as first from ({_PARSED}) where level = 'ERROR' and regexp_extract(raw_line, '([A-Z]\\w*Exception)', 1) <> '' group by 1, 2) group by 1")
def _(t: Tables):
    return L.most_common_error(_parsed(t, "level", "raw_line"))


@query("win_burst", _BURST)
def _(t: Tables):
    return L.bursts(_parsed(t, "ts", "level"))


@query("win_patterns", f"select block_id, circuit_breaker_open, memory_warning, timeout_pattern from ({_BLOCKS})")
def _(t: Tables):
    return _blocks(t).select("block_id", "circuit_breaker_open", "memory_warning", "timeout_pattern")


@query("log_preserve_score", f"select block_id, preserve_score from ({_SCORED})")
def _(t: Tables):
    return L.preserve_score(_blocks(t)).select("block_id", "preserve_score")


_ACTION = f"""select block_id, case when error_count > 0 and error_burst then 'preserve' when preserve_score >= 0.6 then 'sample' when preserve_score >= 0.3 or warn_count > 5 then 'compress' when preserve_score >= 0.1 then 'sample' else 'discard' end as block_action,
    case when error_count > 0 and error_burst then 1.0::double when preserve_score >= 0.6 then 1.0::double when preserve_score >= 0.3 or warn_count > 5 then 0.5::double when preserve_score >= 0.1 then 0.1::double else 0.0::double end as sample_rate from ({_SCORED})"""


@query("log_action", _ACTION)
def _(t: Tables):
    return L.block_action(L.preserve_score(_blocks(t))).select("block_id", "block_action", "sample_rate")


def _policy_sql(lexical: bool) -> str:
    key = (lambda x: x) if lexical else (lambda x: f"(case {x} when 'waste' then 0 when 'low' then 1 when 'medium' then 2 when 'high' then 3 when 'critical' then 4 end)")
    raised = lambda c, w, to: f"case when {w} and {key(c)} < {key(repr(to))} then '{to}' else {c} end"
    steps = [
        "case when error_count > 0 then 'critical' when warn_count > 0 then 'high' else 'medium' end",
        "case when error_burst or circuit_breaker_open then 'critical' else p0 end",
        raised("p1", "memory_warning", "high"),
        raised("p2", "timeout_pattern", "high"),
        f"case when rule is not null and {key('rule')} > {key('p3')} then rule else p3 end",
        raised("p4", "unique_orders > 0", "high"),
        raised("p5", "unique_sessions > 0", "medium"),
    ]
    sql = f"select *, case when substr(start_time, 12, 2)::int < 6 then 'low' when substr(start_time, 12, 2)::int between 9 and 17 then 'medium' end as rule from ({_BLOCKS})"
    for i, step in enumerate(steps):
        sql = f"select *, {step} as p{i} from ({sql})"
    return f"""select block_id, p6 as priority, case when p6 in ('critical', 'high') then 'preserve_intact' when p6 = 'medium' then 'downsample' when p6 = 'low' then 'archive' else 'delete' end as action,
        case p6 when 'critical' then 365 when 'high' then 180 when 'medium' then 90 when 'low' then 30 else 0 end as retention_days,
        case when p6 in ('critical', 'high') then 1.0::double when p6 = 'medium' then 0.3::double when p6 = 'low' then 0.1::double else 0.0::double end as sampling_rate, total_lines * 500 as original_size,
        (case when p6 in ('critical', 'high') then total_lines * 500 when p6 = 'medium' then floor(floor(total_lines * 500 * 0.3::double) * 0.3::double) when p6 = 'low' then floor(total_lines * 500 * 0.1::double * 0.2::double) else 0 end)::bigint as estimated_size from ({sql})"""


@query("log_policy_eval", _policy_sql(True))
def _(t: Tables):
    return L.policy(_blocks(t), "lexical")


@query("log_policy_ranked", _policy_sql(False))
def _(t: Tables):
    return L.policy(_blocks(t), "ranked")


@query("join_time_rules", f"select block_id, case when substr(start_time, 12, 2)::int < 6 then 'night' when substr(start_time, 12, 2)::int between 9 and 17 then 'business' end as rule from ({_BLOCKS})")
def _(t: Tables):
    rules = t.spark.sql("select * from values (1, 0, 6, 'night'), (2, 9, 18, 'business'), (3, 22, 9, 'late') as r(ord, start_hour, end_hour, reason)")
    b = _blocks(t).select("block_id", F.substring("start_time", 12, 2).cast("int").alias("hour"))
    # three rows of rules
    met = b.join(F.broadcast(rules), (F.col("hour") >= F.col("start_hour")) & (F.col("hour") < F.col("end_hour")), "left")
    return met.groupBy("block_id").agg(F.min_by("reason", "ord").alias("rule"))


def _sample_sql(keep: str) -> str:
    return f"""select block_id, line_number, level from (select *, level in ('ERROR', 'WARN') as urgent, count(*) over w as n, row_number() over (w order by line_number) as rn, row_number() over (w order by line_number desc) as back,
        row_number() over (w order by md5('42:' || line_number), line_number) as draw from ({_PARSED}) window w as (partition by block_id, level in ('ERROR', 'WARN'))) where urgent or {keep}"""


for _strategy, _keep in (("head", "rn <= floor(n * 0.3::double)"), ("tail", "back <= case when floor(n * 0.3::double) = 0 then n else floor(n * 0.3::double) end"), ("distributed", "(rn - 1) % 3 = 0"), ("random", "draw <= floor(n * 0.3::double)")):

    @query("log_sampling" if _strategy == "head" else f"log_sampling_{_strategy}", _sample_sql(_keep))
    def _(t: Tables, strategy=_strategy):
        return L.sample_lines(_parsed(t, "level"), strategy, 0.3).select("block_id", "line_number", "level")


@query("join_band_errors", f"select block_id, line_number from (select *, max(case when level = 'ERROR' then 1 else 0 end) over (partition by block_id order by line_number rows between 4 preceding and 5 following) as near from ({_PARSED})) where near = 1")
def _(t: Tables):
    return L.near_errors(_parsed(t, "level"), 10).select("block_id", "line_number")


@query("log_reduce", f"select block_id, count(*) as n, sum(strlen(raw_line))::bigint as bytes_before, sum(case when level in ('ERROR', 'WARN') then strlen(raw_line) else 0 end)::bigint as bytes_after from ({_PARSED}) group by 1")
def _(t: Tables):
    size = F.octet_length("raw_line").cast("long")
    return _parsed(t, "level", "raw_line").groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes_before"), F.sum(F.when(F.col("level").isin("ERROR", "WARN"), size).otherwise(0)).alias("bytes_after"))


@query("red_classify_log", f"select block_id, case when error_count > 0 then 'preserve' when warn_count > 0 then 'downsample' when unique_orders > 0 then 'keep_business' else 'archive' end as decision from ({_BLOCKS})")
def _(t: Tables):
    decision = S.first_of([(F.col("error_count") > 0, "preserve"), (F.col("warn_count") > 0, "downsample"), (F.col("unique_orders") > 0, "keep_business")], "archive")
    return _blocks(t).select("block_id", decision.alias("decision"))


@query("red_log_new_size", f"select block_id, (floor(total_lines * sample_rate)::bigint * bytes // total_lines)::bigint as new_size from (select b.block_id, total_lines, a.sample_rate, s.bytes from ({_BLOCKS}) b join ({_ACTION}) a on a.block_id = b.block_id join (select block_id, sum(strlen(raw_line))::bigint as bytes from log_lines group by 1) s on s.block_id = b.block_id)")
def _(t: Tables):
    size = t.log_lines.groupBy("block_id").agg(F.sum(F.octet_length("raw_line").cast("long")).alias("bytes"))
    b = L.block_action(L.preserve_score(_blocks(t))).join(size, "block_id")
    return b.select("block_id", F.expr("floor(total_lines * sample_rate) * bytes div total_lines").alias("new_size"))


@query("ext_log_rules", "select line_number, case when contains(raw_line, 'Exception') then 'keep' when contains(raw_line, 'timeout') then 'sample' else 'drop' end as decision from log_lines")
def _(t: Tables):
    rules = [("Exception", "keep"), ("timeout", "sample")]
    return t.log_lines.select("line_number", S.first_of([(F.col("raw_line").contains(p), d) for p, d in rules], "drop").alias("decision"))
