"""Queries that run the continuous operators over the events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import listing as L
from ..sources.mounted import local_path, write_files
from ..sources.shared import shared_folder
from ..streaming import jobs as J
from ..streaming import stateful as K
from ..streaming.stores import Conflict, GrowingFilter, StateLog
from .catalog import Tables
from .chunks import _CAPACITY as CAPACITY
from .chunks import _ERROR as ERROR
from .chunks import _filter
from .registry import query

def _folder(t: Tables) -> str:
    return shared_folder(t.spark, "streams")


def _events(t: Tables):
    # a file stream takes the table's folder; the glob picks the one table
    stream = t.spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    return stream.option("pathGlobFilter", "events.parquet").parquet(t.sf_dir).withColumn("time", F.col("ts").cast("timestamp"))


@query("str_dedup_consume", "select event_id, case event_type when 'purchase' then 'results' when 'signup' then 'requests' end as queue from events where event_type in ('purchase', 'signup')")
def _(t: Tables):
    return J.drain(J.dispatched(_events(t), {"purchase": "results", "signup": "requests"}).select("event_id", "queue"), _folder(t))


@query("src_kafka", "select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def _(t: Tables):
    return J.drain(_events(t).select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", "p.k"), _folder(t))


@query("str_lookup_state", "select count(distinct user_id) as users from events")
def _(t: Tables):
    return J.drain(J.first_sightings(_events(t), "user_id").select("user_id"), _folder(t)).agg(F.count(F.lit(1)).alias("users"))


#: Where the watermark stands at last, in microseconds: an hour behind the newest event, in whole milliseconds.
_MARK = "((select max(epoch_us(ts)) from events) // 1000 * 1000 - 3600000000)"


@query("str_metric_thresholds", f"""select strftime(to_timestamp(s) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as start, top, n
    from (select epoch_us(ts) // 10000000 * 10 as s, max(value) as top, count(*) as n from events group by 1) where top > 50 and (s + 10) * 1000000 <= {_MARK}""")
def _(t: Tables):
    return J.drain(J.thresholds(_events(t), 50.0), _folder(t))


@query("str_burst", """select strftime(e.ts, '%Y-%m-%d') as block_id, e.event_id as line_number, count(*) as survivors, count(*) >= 5 as error_burst
    from events e join events f on f.event_type = 'error' and strftime(e.ts, '%Y-%m-%d') = strftime(f.ts, '%Y-%m-%d')
        and f.ts > e.ts - interval 3600 second and (f.ts, f.event_id) <= (e.ts, e.event_id) where e.event_type = 'error' group by 1, 2""")
def _(t: Tables):
    errors = _events(t).where("event_type = 'error'").select(F.date_format("ts", "yyyy-MM-dd").alias("block_id"), F.col("event_id").alias("line_number"), "time")
    return J.drain(K.error_bursts(errors, 3600, 5), _folder(t))


@query("str_log_blocks", f"select strftime(start, '%Y-%m-%d %H:%M:%S') as start, n, errors from (select date_trunc('hour', ts) as start, count(*) as n, count(*) filter (where event_type = 'error') as errors from events group by 1) where epoch_us(start) + 3600000000 <= {_MARK}")
def _(t: Tables):
    return J.drain(J.blocks(_events(t)), _folder(t))


@query("str_sessions", f"select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts, event_id) as run from (select *, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 6 hour then 1 else 0 end as fresh from events)) group by user_id, run having epoch_us(max(ts)) + 21600000000 <= {_MARK}")
def _(t: Tables):
    return J.drain(J.sessions(_events(t), "6 hours"), _folder(t))


@query("str_heartbeat", f"""select user_id as node, ms as last_ms, ms + 21600000 as dead_ms from (
    select user_id, epoch_us(ts) // 1000 as ms, lead(epoch_us(ts) // 1000) over (partition by user_id order by ts, event_id) as later from events)
    where later - ms >= 21600000 or later is null and (ms + 21600000) * 1000 <= {_MARK}""")
def _(t: Tables):
    """Nodes that are silent for six hours, found by timers."""
    beats = _events(t).select(F.col("user_id").alias("node"), "time")
    return J.drain(K.deaths(beats, "6 hours", "1 hour"), _folder(t))


@query("bloom_sync", f"select word, bits from {_filter("(select distinct event_id::varchar as x from events where event_type = 'view')")}")
def _(t: Tables):
    """A filter that grows with a stream's batches; a batch that comes again changes nothing."""
    folder = _folder(t)
    grown = GrowingFilter(t.spark, f"{folder}/filter", CAPACITY, ERROR)
    items = _events(t).where("event_type = 'view'").select(F.col("event_id").cast("string").alias("item"))
    grown.follow(items, "item", f"{folder}/state").awaitTermination()
    grown.add(t.read("events").select(F.lit("again").alias("item")), "item", 0)
    return grown.words()


def _rewritten(batches):
    """Write (whole path, content) over what is there, and remove files whose content is null; on the executors."""
    import os

    import pyarrow as pa

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if content is None:
                if os.path.exists(path):
                    os.unlink(path)
            else:
                with open(path, "wb") as out:
                    out.write(content)
        yield pa.RecordBatch.from_arrays([batch.column(0)], ["path"])


@query("src_fs_events", """select 1 as generation, 'created' as kind, substr(path, 2) as path, size from files where file_id % 3 <> 0
    union all select 2, 'created', substr(path, 2), size from files where file_id % 3 = 0
    union all select 2, 'modified', substr(path, 2), size + 1 from files where file_id % 3 <> 0 and file_id % 5 = 0
    union all select 3, 'deleted', substr(path, 2), size + case when file_id % 3 <> 0 and file_id % 5 = 0 then 1 else 0 end from files where file_id % 7 = 0""")
def _(t: Tables):
    """Three generations of a tree; the stream is stopped and started again between them."""
    root, state, out = (shared_folder(t.spark, n) for n in ("tree", "snapshots", "changes"))
    path = F.substring("path", 2, 1 << 20)
    files = t.files.select("file_id", path.alias("path"), F.col("text").cast("binary").alias("content"))

    def rewrite(rows, content):
        whole = F.concat(F.lit(f"{local_path(root)}/"), "path")
        rows.select(whole.alias("path"), content.cast("binary").alias("content")).mapInArrow(_rewritten, "path string").write.format("noop").mode("overwrite").save()

    def follow():
        rows = L.changes(t.spark, state)
        rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
        return rows.schema

    write_files(files.where("file_id % 3 <> 0").select("path", "content"), root)
    L.take_snapshot(t.spark, root, state)
    follow()
    write_files(files.where("file_id % 3 = 0").select("path", "content"), root)
    rewrite(files.where("file_id % 3 <> 0 and file_id % 5 = 0"), F.concat(F.col("content").cast("string"), F.lit("!")))
    L.take_snapshot(t.spark, root, state)
    rewrite(files.where("file_id % 7 = 0"), F.lit(None))
    L.take_snapshot(t.spark, root, state)
    schema = follow()
    return t.spark.read.schema(schema).parquet(f"{out}/rows").withColumn("generation", F.col("generation").cast("int"))


@query("str_frame_motion", "select user_id as key, event_id as at, abs(value - before) as change from (select *, lag(value) over (partition by user_id order by event_id) as before from events) where abs(value - before) > 30")
def _(t: Tables):
    """Frames that differ from the one before of their camera, by a state that the stream keeps for each."""
    frames = _events(t).select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), "value")
    return J.drain(K.frame_motion(frames, 30.0), _folder(t))


@query("str_checkpoint", "select count(*) as n from events")
def _(t: Tables):
    """A stream that is stopped and started again on its checkpoint takes each event once."""
    folder = f"{_folder(t)}/{uuid.uuid4().hex}"
    for _ in range(2):
        run = _events(t).select("event_id").writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return t.spark.read.schema("event_id long").parquet(f"{folder}/rows").agg(F.count(F.lit(1)).alias("n"))


@query("str_state_log", """select task_id as key, case when priority = 3 then 'half' else 'begun' end as state, case when priority = 3 then 2 else 1 end as version
    from tasks where status = 'running' and not (priority = 3 and retries = 4) and not (priority <> 3 and created % 10 = 6) and priority <> 2""")
def _(t: Tables):
    """Two versions of tasks' states; a writer that missed the second is refused, and states that are taken out or expired are gone."""
    log = StateLog(t.spark, f"{_folder(t)}/log")
    running = t.tasks.where("status = 'running'")
    forever = F.lit(None).cast("timestamp")
    first = running.select(F.col("task_id").alias("key"), F.lit("begun").alias("state"), F.when(F.col("created") % 10 == 6, F.lit("2025-01-01").cast("timestamp")).alias("expires"))
    log.commit(first, 0)
    later = running.where("priority in (2, 3)")
    gone = F.when(F.col("priority") == 3, "half")
    log.commit(later.select(F.col("task_id").alias("key"), gone.alias("state"), F.when(F.col("retries") == 4, F.lit("2025-01-01").cast("timestamp")).alias("expires")), 1)
    try:
        log.commit(running.select(F.col("task_id").alias("key"), F.lit("stale").alias("state"), forever.alias("expires")), 1)
    except Conflict:
        pass
    return log.current("2025-06-30")
