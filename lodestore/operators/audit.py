"""Audit trail: hash chain, queries, statistics, compliance checks, policy versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASHED = ["entry_id", "ts", "event_type", "actor", "data_id", "data_type", "action", "original_size", "new_size", "classification", "policy_id"]


def entry_hash(fields: list[str] = HASHED) -> Column:
    """SHA-256 of an entry's fields joined by a bar; the previous hash is no part of it."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]), 256)


def with_previous(rows: DataFrame, value: str, order: str, name: str, span: int = 100_000) -> DataFrame:
    """Add ``name``: the value of the row before in the order of a whole-number column, over the whole table.

    Rows are looked at by spans of that column, so no task sorts the whole table;
    only the last value of each span takes part in the window across spans.
    """
    rows = rows.withColumn("span", F.floor(F.col(order) / span))
    inside = Window.partitionBy("span").orderBy(order)
    ends = rows.groupBy("span").agg(F.max_by(value, order).alias("end"))
    ends = ends.select("span", F.lag("end").over(Window.partitionBy(F.lit(0)).orderBy("span")).alias("carried"))
    met = rows.withColumn("own", F.lag(value).over(inside)).withColumn("head", F.row_number().over(inside) == 1)
    met = met.join(ends, "span", "left")
    return met.withColumn(name, F.when(F.col("head"), F.col("carried")).otherwise(F.col("own"))).drop("span", "own", "head", "carried")


def chained(log: DataFrame) -> DataFrame:
    """Add entry_hash and previous_hash, the hash of the entry before in line order, empty for the first."""
    rows = with_previous(log.withColumn("entry_hash", entry_hash()), "entry_hash", "line_no", "previous_hash")
    return rows.withColumn("previous_hash", F.coalesce("previous_hash", F.lit("")))


def verify_chain(log: DataFrame, genesis: str = "") -> DataFrame:
    """Lines whose stored previous_hash differs from the line before or whose stored hash differs from their content.

    ``genesis`` is what the first line's previous_hash must be, for a trail whose
    beginning was archived.
    """
    rows = with_previous(log, "entry_hash", "line_no", "expected").withColumn("again", entry_hash())
    broken = F.col("previous_hash") != F.coalesce("expected", F.lit(genesis))
    changed = F.col("entry_hash") != F.col("again")
    return rows.where(broken | changed).select("line_no", broken.alias("broken_link"), changed.alias("changed"))


def audit_query(log: DataFrame, start: str | None = None, end: str | None = None, events: list[str] = (), types: list[str] = (), actors: list[str] = (), offset: int = 0, limit: int | None = None) -> DataFrame:
    """Entries within a closed time range and lists of values, in line order."""
    rows = log
    if start is not None:
        rows = rows.where(F.col("ts") >= start)
    if end is not None:
        rows = rows.where(F.col("ts") <= end)
    for column, values in (("event_type", events), ("data_type", types), ("actor", actors)):
        if values:
            rows = rows.where(F.col(column).isin(list(values)))
    if offset or limit is not None:
        rows = rows.orderBy("line_no").offset(offset)
    return rows if limit is None else rows.limit(limit)


def counts_by(log: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each of the columns, in one pass: dimension, value, n."""
    sets = [[c] for c in columns]
    rows = log.groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"g_{c}") for c in columns])
    which = F.coalesce(*[F.when(F.col(f"g_{c}") == 0, F.lit(c)) for c in columns])
    return rows.select(which.alias("dimension"), F.coalesce(*[F.when(F.col(f"g_{c}") == 0, F.col(c)) for c in columns]).alias("value"), "n")


def percent_saved(original: Column, new: Column) -> Column:
    return F.coalesce(F.round((1 - F.try_divide(new.cast("double"), original.cast("double"))) * 100, 4), F.lit(0.0))


def summary(log: DataFrame) -> DataFrame:
    """Counts, bytes before and after, share saved."""
    rows = log.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("event_type") == "DATA_INGESTED").alias("ingested"),
        F.count_if(F.col("event_type") == "DATA_REDUCED").alias("reduced"),
        F.sum("original_size").alias("original_bytes"),
        F.sum("new_size").alias("new_bytes"),
    )
    return rows.withColumn("saved_percent", percent_saved(F.col("original_bytes"), F.col("new_bytes")))


def retention(log: DataFrame, limits: dict[str, int], as_of: str) -> DataFrame:
    """Per data type with a limit: entries within and beyond it."""
    table = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    rows = log.withColumn("limit_days", F.try_element_at(table, F.col("data_type"))).where("limit_days is not null")
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date(F.substring("ts", 1, 10)))
    return rows.groupBy("data_type", "limit_days").agg(F.count_if(age <= F.col("limit_days")).alias("within"), F.count_if(age > F.col("limit_days")).alias("beyond"))


def retention_findings(log: DataFrame, limits: dict[str, int], as_of: str) -> DataFrame:
    """A finding for each data type with entries beyond its limit."""
    return retention(log, limits, as_of).where("beyond > 0").select(F.lit("high").alias("severity"), F.lit("Data Retention").alias("category"), F.col("data_type").alias("subject"), F.col("beyond").alias("n"))


def control_findings(log: DataFrame) -> DataFrame:
    """Findings of four controls over the whole period, from one aggregate."""
    event = F.col("event_type")
    sums = log.agg(
        F.count_if(event.isin("DATA_INGESTED", "DATA_REDUCED", "ANOMALY_DETECTED")).alias("monitored"),
        F.count_if(event == "ANOMALY_DETECTED").alias("anomalies"),
        F.count_if((event == "ANOMALY_DETECTED") & (F.col("action") == "keep")).alias("resolved"),
        F.count_if(event == "USER_ACCESS").alias("access"),
        F.count_if(event.isin("POLICY_CREATED", "POLICY_UPDATED", "POLICY_DELETED") & (F.col("classification") == "LOW")).alias("unapproved"),
    )
    checks = [
        ("CC7.1", "medium", F.col("monitored") == 0, F.col("monitored")),
        ("CC7.2", "medium", F.col("anomalies") > F.col("resolved"), F.col("anomalies") - F.col("resolved")),
        ("CC6.1", "low", F.col("access") == 0, F.col("access")),
        ("CC8.1", "medium", F.col("unapproved") > 0, F.col("unapproved")),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("category"), F.lit(s).alias("severity"), c.alias("hit"), n.alias("n")) for k, s, c, n in checks])
    return sums.select(F.explode(rows).alias("f")).where("f.hit").select("f.category", "f.severity", "f.n")


def latest_version(versions: DataFrame) -> DataFrame:
    """The newest version of each policy, with the number of its versions."""
    rows = versions.groupBy("policy_id").agg(F.max("version").alias("version"), F.count(F.lit(1)).alias("versions"), F.max_by("config", "version").alias("config"))
    return rows


def merged_config(current: Column, new: Column) -> Column:
    """``new`` over ``current``; keys that start with an underscore are dropped."""
    keep = F.map_filter(current, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_filter(F.map_concat(keep, new), lambda k, _: ~k.startswith("_"))


# Built-in policies as name: (retention in days, share that is kept), and the one of each kind of data.
TEMPLATES = {"surveillance": (30, 0.3), "application_log": (90, 0.5), "database_log": (365, 1.0), "archive": (3650, 0.1)}
TEMPLATE_OF = {"video": "surveillance", "log": "application_log", "document": "database_log"}


def under_templates(log: DataFrame, other: str = "archive") -> DataFrame:
    """By kind of data: its template (``other`` if it has none of its own), retention and the bytes that are kept."""
    name = F.coalesce(*[F.when(F.col("data_type") == k, v) for k, v in TEMPLATE_OF.items()], F.lit(other))
    rows = log.withColumn("template", name)
    of = lambda i: F.coalesce(*[F.when(F.col("template") == k, F.lit(v[i])) for k, v in TEMPLATES.items()])
    rows = rows.withColumn("retention_days", of(0)).withColumn("kept", F.floor(F.col("original_size") * of(1)).cast("long"))
    return rows.groupBy("data_type", "template", "retention_days").agg(F.sum("kept").alias("kept"))
