"""The storage concepts (files, log lines, frames, ...) derived from the benchmark tables.

``Tables`` builds them as DataFrames; ``VIEWS`` states the same as SQL for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The reference time of all queries.
AS_OF = "2025-06-30"
EXTENSIONS = ["mp4", "mp3", "jpg", "pdf", "py", "zip", "db", "ttf", "xlsx", "xyz", "txt", "log", "tmp", "bak", "docx", "png", "wav", "tar", "js", "csv"]
DATA_TYPES = ["video", "log", "document", "image", "backup"]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def files(self) -> DataFrame:
        ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
        name = F.concat(F.when(F.col("doc_id") % 50 == 7, ".").otherwise(""), F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), ext)
        folder = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"))
        return self.read("documents").select(
            F.col("doc_id").alias("file_id"),
            F.col("source").alias("storage_id"),
            folder.alias("dir"),
            name.alias("name"),
            F.concat(folder, F.lit("/"), name).alias("path"),
            F.octet_length("text").cast("long").alias("size"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")).alias("mdate"),
            F.sha2("text", 256).alias("sha256"),
            "text",
        )

    @cached_property
    def log_lines(self) -> DataFrame:
        who, order, session = F.lpad(F.col("user_id").cast("string"), 8, "0"), F.lpad(F.col("event_id").cast("string"), 10, "0"), F.lpad(F.col("user_id").cast("string"), 16, "0")
        text = (
            F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), F.concat(F.lit("ERROR [svc] DatabaseException: connection lost userId="), who, F.lit(" orderId="), order))
            .when(F.col("event_type") == "error", F.concat(F.lit("ERROR [svc] request timeout after retry sessionId="), session))
            .when(F.col("event_type") == "purchase", F.concat(F.lit("INFO [svc] order placed orderId="), order, F.lit(" userId="), who))
            .when(F.col("event_type") == "signup", F.concat(F.lit("INFO [svc] POST /users HTTP/1.1 201 userId="), who))
            .when(F.col("event_type") == "click", F.concat(F.lit("DEBUG [svc] GET /item 200 sessionId="), session))
            .when(F.col("value") > 20, F.concat(F.lit("WARN [svc] slow view sessionId="), session))
            .otherwise(F.concat(F.lit("TRACE [svc] view "), order))
        )
        return self.read("events").select(
            F.date_format("ts", "yyyy-MM-dd").alias("block_id"),
            F.col("event_id").alias("line_number"),
            F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), text).alias("raw_line"),
        )

    @cached_property
    def audit_log(self) -> DataFrame:
        k = F.col("o_orderkey")
        event = (
            F.when(k % 97 == 0, "ANOMALY_DETECTED").when(k % 89 == 0, "POLICY_UPDATED").when(k % 83 == 0, "DATA_DELETED").when(k % 79 == 0, "POLICY_CREATED").when(F.col("o_orderstatus") == "F", "DATA_REDUCED").otherwise("DATA_INGESTED")
        )
        original = F.floor(F.col("o_totalprice")).cast("long")
        return self.read("orders").select(
            k.alias("line_no"),
            F.concat(F.lit("e"), k.cast("string")).alias("entry_id"),
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ts"),
            event.alias("event_type"),
            F.concat(F.lit("u"), (F.col("o_custkey") % 10).cast("string")).alias("actor"),
            F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("data_id"),
            F.element_at(F.array(*map(F.lit, DATA_TYPES)), (F.col("o_custkey") % 5 + 1).cast("int")).alias("data_type"),
            F.when(F.col("o_orderkey") % 3 == 0, "keep").when(F.col("o_orderkey") % 3 == 1, "compress").otherwise("sample").alias("action"),
            original.alias("original_size"),
            F.when(event == "DATA_REDUCED", F.floor(original * 0.25).cast("long")).otherwise(F.lit(0).cast("long")).alias("new_size"),
            F.element_at(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW")), (k % 3 + 1).cast("int")).alias("classification"),
            F.concat(F.lit("p"), (k % 4).cast("string")).alias("policy_id"),
        )

    @cached_property
    def fingerprints(self) -> DataFrame:
        use = self.read("lineitem").groupBy(F.col("l_partkey").alias("k")).agg(
            F.count_distinct("l_orderkey").alias("refcount"),
            F.count(F.lit(1)).alias("access_count"),
            F.to_date(F.min("l_shipdate")).alias("created"),
            F.to_date(F.max("l_shipdate")).alias("accessed"),
        )
        part = self.read("part").select(F.col("p_partkey").alias("k"), "p_size", "p_brand")
        return part.join(use, "k").select(
            F.sha2(F.col("k").cast("string"), 256).alias("fp"),
            F.col("k").alias("part"),
            (F.col("p_size").cast("long") * 4194304).alias("size"),
            F.when(F.col("k") % 17 == 0, 0).otherwise(F.col("refcount")).cast("long").alias("refcount"),
            "access_count",
            (F.col("k") * 7 % 800).cast("int").alias("age_days"),
            "created",
            "accessed",
            (F.lit(1.0) + (F.col("k") % 10) / 10.0).alias("ratio"),
            (F.col("k") % 41 == 0).alias("pinned"),
            (F.col("k") % 43 == 0).alias("archive_only"),
            F.element_at(F.array(F.lit("hot"), F.lit("warm"), F.lit("cold")), (F.col("k") % 3 + 1).cast("int")).alias("tier"),
        )

    @cached_property
    def frames(self) -> DataFrame:
        from pyspark.sql import Window

        w = Window.partitionBy("label").orderBy("vec_id")
        v = F.col("vec_id")
        return self.read("embeddings").select(
            F.col("label").cast("long").alias("camera"),
            (F.row_number().over(w) - 1).cast("long").alias("frame"),
            (v * 37 % 100 / 100.0).alias("motion"),
            (v % 7 == 0).alias("has_people"),
            (v % 11 == 0).alias("has_vehicles"),
            (v % 13 == 0).alias("has_faces"),
            (v % 4).cast("long").alias("person_count"),
            F.element_at(F.array(F.lit("indoor"), F.lit("parking"), F.lit("street")), (v % 3 + 1).cast("int")).alias("scene"),
            (v * 53 % 256).cast("long").alias("level"),
            F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("long")).alias("vec"),
        )

    @cached_property
    def tasks(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.read("orders").select(
            F.concat(F.lit("t"), k.cast("string")).alias("task_id"),
            k.alias("created"),
            F.element_at(F.array(F.lit("scan"), F.lit("dedup"), F.lit("archive")), (k % 3 + 1).cast("int")).alias("task_type"),
            F.concat(F.lit("u"), (F.col("o_custkey") % 7).cast("string")).alias("user_id"),
            F.element_at(F.array(*map(F.lit, ["pending", "running", "completed", "failed", "cancelled"])), (k % 5 + 1).cast("int")).alias("status"),
            (k % 4).cast("int").alias("priority"),
            F.concat(F.lit('{"space_freed": '), F.floor("o_totalprice").cast("long").cast("string"), F.lit("}")).alias("result"),
            (k % 5).cast("int").alias("retries"),
        )

    @cached_property
    def metrics(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("sample"),
            F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"),
            F.concat(F.lit("node-"), (F.col("user_id") % 5).cast("string")).alias("node"),
            F.element_at(F.array(F.lit("cpu"), F.lit("memory"), F.lit("disk")), (F.col("event_id") % 3 + 1).cast("int")).alias("metric"),
            (F.col("event_id") * 17 % 101).cast("double").alias("value"),
        )

    @cached_property
    def nodes(self) -> DataFrame:
        """The nodes that sent samples; their number bounds what is made of them."""
        k = F.col("k").cast("string")
        sent = self.read("events").groupBy((F.col("user_id") % 5).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return sent.select(F.concat(F.lit("node-"), k).alias("node_id"), F.lit(100 * 1073741824).cast("long").alias("capacity"), (F.col("k") != 3).alias("healthy"), (F.col("n") % 7).cast("int").alias("load"))


_EXT = "[" + ", ".join(f"'{x}'" for x in EXTENSIONS) + "]"
_TYPES = "[" + ", ".join(f"'{x}'" for x in DATA_TYPES) + "]"
_EVENT = "case when o_orderkey % 97 = 0 then 'ANOMALY_DETECTED' when o_orderkey % 89 = 0 then 'POLICY_UPDATED' when o_orderkey % 83 = 0 then 'DATA_DELETED' when o_orderkey % 79 = 0 then 'POLICY_CREATED' when o_orderstatus = 'F' then 'DATA_REDUCED' else 'DATA_INGESTED' end"

#: name -> SQL of the view.
VIEWS = {
    "files": f"""select doc_id as file_id, source as storage_id, '/' || source || '/' || lang as dir,
        (case when doc_id % 50 = 7 then '.' else '' end) || 'f' || doc_id || '.' || {_EXT}[doc_id % {len(EXTENSIONS)} + 1] as name,
        '/' || source || '/' || lang || '/' || (case when doc_id % 50 = 7 then '.' else '' end) || 'f' || doc_id || '.' || {_EXT}[doc_id % {len(EXTENSIONS)} + 1] as path,
        strlen(text)::bigint as size, date '2024-01-01' + (doc_id % 700)::int as mdate, sha256(text) as sha256, text from documents""",
    "log_lines": """select strftime(ts, '%Y-%m-%d') as block_id, event_id as line_number, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || case
        when event_type = 'error' and event_id % 2 = 0 then 'ERROR [svc] DatabaseException: connection lost userId=' || lpad(user_id::varchar, 8, '0') || ' orderId=' || lpad(event_id::varchar, 10, '0')
        when event_type = 'error' then 'ERROR [svc] request timeout after retry sessionId=' || lpad(user_id::varchar, 16, '0')
        when event_type = 'purchase' then 'INFO [svc] order placed orderId=' || lpad(event_id::varchar, 10, '0') || ' userId=' || lpad(user_id::varchar, 8, '0')
        when event_type = 'signup' then 'INFO [svc] POST /users HTTP/1.1 201 userId=' || lpad(user_id::varchar, 8, '0')
        when event_type = 'click' then 'DEBUG [svc] GET /item 200 sessionId=' || lpad(user_id::varchar, 16, '0')
        when value > 20 then 'WARN [svc] slow view sessionId=' || lpad(user_id::varchar, 16, '0')
        else 'TRACE [svc] view ' || lpad(event_id::varchar, 10, '0') end as raw_line from events""",
    "audit_log": f"""select o_orderkey as line_no, 'e' || o_orderkey as entry_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as ts, {_EVENT} as event_type,
        'u' || (o_custkey % 10) as actor, 'd' || o_custkey as data_id, {_TYPES}[o_custkey % 5 + 1] as data_type,
        case o_orderkey % 3 when 0 then 'keep' when 1 then 'compress' else 'sample' end as action, floor(o_totalprice)::bigint as original_size,
        case when {_EVENT} = 'DATA_REDUCED' then floor(floor(o_totalprice)::bigint * 0.25)::bigint else 0 end as new_size,
        ['HIGH', 'MEDIUM', 'LOW'][o_orderkey % 3 + 1] as classification, 'p' || (o_orderkey % 4) as policy_id from orders""",
    "fingerprints": """select sha256(p_partkey::varchar) as fp, p_partkey as part, p_size::bigint * 4194304 as size,
        case when p_partkey % 17 = 0 then 0 else refcount end::bigint as refcount, access_count, (p_partkey * 7 % 800)::int as age_days, created, accessed,
        1.0::double + (p_partkey % 10) / 10.0::double as ratio, p_partkey % 41 = 0 as pinned, p_partkey % 43 = 0 as archive_only, ['hot', 'warm', 'cold'][p_partkey % 3 + 1] as tier
        from part join (select l_partkey, count(distinct l_orderkey) as refcount, count(*) as access_count, min(l_shipdate)::date as created, max(l_shipdate)::date as accessed from lineitem group by 1) u on p_partkey = l_partkey""",
    "frames": """select label::bigint as camera, row_number() over (partition by label order by vec_id) - 1 as frame, vec_id * 37 % 100 / 100.0::double as motion,
        vec_id % 7 = 0 as has_people, vec_id % 11 = 0 as has_vehicles, vec_id % 13 = 0 as has_faces, vec_id % 4 as person_count,
        ['indoor', 'parking', 'street'][vec_id % 3 + 1] as scene, vec_id * 53 % 256 as level, list_transform(embedding, lambda x: floor(x::double * 1000)::bigint) as vec from embeddings""",
    "tasks": """select 't' || o_orderkey as task_id, o_orderkey as created, ['scan', 'dedup', 'archive'][o_orderkey % 3 + 1] as task_type, 'u' || (o_custkey % 7) as user_id,
        ['pending', 'running', 'completed', 'failed', 'cancelled'][o_orderkey % 5 + 1] as status, (o_orderkey % 4)::int as priority,
        '{"space_freed": ' || floor(o_totalprice)::bigint || '}' as result, (o_orderkey % 5)::int as retries from orders""",
    "metrics": """select event_id as sample, strftime(ts, '%Y-%m-%d %H:%M') as minute, 'node-' || (user_id % 5) as node, ['cpu', 'memory', 'disk'][event_id % 3 + 1] as metric,
        (event_id * 17 % 101)::double as value from events""",
    "nodes": "select 'node-' || (user_id % 5) as node_id, 107374182400 as capacity, user_id % 5 <> 3 as healthy, (count(*) % 7)::int as load from events group by user_id % 5",
}
