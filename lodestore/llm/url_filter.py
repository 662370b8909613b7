"""URL rules by a sort-merge range join over reversed hosts (DataFrame operations only).

A host's canonical key is its labels in reverse, each followed by a dot, so
``www.example.com`` becomes ``com.example.www.``.  A host and all its subdomains
are then one interval of keys, ``[key, key with its last dot replaced by "/")``,
because "/" is the character after "." and cannot stand in a host.  Intervals of
different hosts nest or are disjoint.

Pages are dealt evenly by a hash of their row, whatever their host; every bucket
gets the interval ends of all rules and is sorted by key.  One running window
over the sorted rows is the sweep: each interval end carries the stack of rules
that are active from there on, and a page takes the stack last seen.  The
longest rule of the stack that begins the page's path decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, null_salt, shuffle_partitions


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://``; both empty without one."""
    there = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    rest = F.substring_index(F.regexp_replace(url, r"(?s)^.*?://", ""), "#", 1)
    rest = F.substring_index(rest, "?", 1)
    cut = F.instr(rest, "/")
    host = F.when(cut > 0, F.substring_index(rest, "/", 1)).otherwise(rest)
    path = F.when(cut > 0, F.substr(rest, cut)).otherwise(F.lit(""))
    return (F.when(there, lower_ascii(host)).otherwise(F.lit("")), F.when(there, path).otherwise(F.lit("")))


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_bounds(rules: DataFrame) -> DataFrame:
    """Interval ends of the rules' hosts with the stack of rules active from there.

    A stack holds the rules of the host and of the hosts it lies in.  It is found
    by an equi-join of each rule host with its own parent domains, so it needs no
    sequential pass.  At an interval's end the stack of the next outer host holds.
    """
    rules = rules.select(
        lower_ascii(F.col("host")).alias("host"),
        F.coalesce(F.col("path"), F.lit("")).alias("path"),
        F.col("verdict"),
    ).where("host is not null and host <> '' and verdict is not null")
    # the same rule given twice: block is the safer reading
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    hosts = rules.groupBy("host").agg(
        F.collect_list(
            F.struct(
                F.length(F.concat("host", "path")).alias("len"),
                F.length("host").alias("host_len"),
                F.concat("host", "path").alias("rule"),
                F.col("path"),
                F.col("verdict"),
            )
        ).alias("own")
    )
    labels = F.split("host", r"\.")
    up = hosts.select("host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("k", "outer"))
    chain = (
        up.join(hosts.select(F.col("host").alias("outer"), "own"), "outer")
        .groupBy("host")
        .agg(
            F.flatten(F.collect_list("own")).alias("inner_stack"),
            F.flatten(F.collect_list(F.when(F.col("k") > 0, F.col("own")))).alias("outer_stack"),
        )
    )
    key = host_key(F.col("host"))
    return chain.select(key.alias("key"), F.col("inner_stack").alias("stack")).unionByName(
        chain.select(F.concat(F.substr(key, F.lit(1), F.length(key) - 1), F.lit("/")).alias("key"), F.col("outer_stack").alias("stack"))
    )


def url_filter(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id", default: str = "allow", buckets: int | None = None) -> DataFrame:
    """Judge every row of ``pages`` by ``rules(host, path, verdict)``.

    Returns id, host, path, rule (host and path of the deciding rule, else null)
    and verdict (the rule's, else ``default``); other columns of ``pages`` may
    have any name, as only the id and the url are read.  The rule with the most
    characters wins, at equal length the one with the longer host, then by text.
    A rule without host or verdict is ignored, a null path means every path;
    of the same rule with both verdicts ``block`` counts.  A null url, or one
    without ``://``, has empty host and path and gets ``default``.  Repeated
    rows are judged each.  No pages or no rules: no rows, or all by ``default``.
    """
    buckets = buckets or shuffle_partitions(pages.sparkSession)
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.select(
        F.pmod(F.xxhash64("id", "host", "path", null_salt(F.col("id"))), F.lit(buckets)).alias("bucket"),
        host_key(F.col("host")).alias("key"),
        F.lit(1).alias("kind"),
        "id", "host", "path",
        F.lit(None).cast("array<struct<len:int,host_len:int,rule:string,path:string,verdict:string>>").alias("stack"),
    )
    ends = rule_bounds(rules).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"),
        "key",
        F.lit(0).alias("kind"),
        F.lit(None).cast(pages.schema[id_col].dataType).alias("id"),
        F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("path"),
        "stack",
    )
    sweep = Window.partitionBy("bucket").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.unionByName(ends).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    best = F.array_max(
        F.transform(
            F.filter("stack", lambda r: F.col("path").startswith(r["path"])),
            lambda r: F.struct(r["len"], r["host_len"], r["rule"], r["verdict"]),
        )
    )
    return swept.withColumn("best", best).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
