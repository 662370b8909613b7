"""File inventories: statistics, duplicates, candidates for cleaning, differences of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S


def with_kind(files: DataFrame) -> DataFrame:
    """Add ext and category."""
    return files.withColumn("ext", S.extension(F.col("name"))).withColumn("category", S.category(F.col("ext")))


def visible(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Files that are not hidden and, if asked, lie no deeper than ``max_depth`` folders."""
    rows = files.where(~F.col("name").startswith("."))
    return rows if max_depth is None else rows.where(F.size(F.split("path", "/")) - 2 <= max_depth)


def local_scan(files: DataFrame, min_size: int = 0, excluded_ext: list[str] = (), excluded_paths: list[str] = ()) -> DataFrame:
    """Files of at least ``min_size`` without excluded extensions or path parts, in any case."""
    rows = files.where(F.col("size") >= min_size)
    if excluded_ext:
        rows = rows.where(~S.extension(F.col("name")).isin(list(excluded_ext)))
    for part in excluded_paths:
        rows = rows.where(~F.lower("path").contains(part.lower()))
    return rows


def storage_stats(files: DataFrame) -> DataFrame:
    """Count and bytes in all, by category and by extension, from one pass."""
    rows = with_kind(files).groupingSets([[], ["category"], ["ext"]], "category", "ext")
    out = rows.agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"), F.grouping("category").alias("gc"), F.grouping("ext").alias("ge"))
    level = F.when(F.col("gc") == 0, "category").when(F.col("ge") == 0, "extension").otherwise("total")
    return out.select(level.alias("level"), F.coalesce("category", "ext", F.lit("")).alias("name"), "n_files", "bytes")


def duplicate_groups(files: DataFrame, key: str = "sha256") -> DataFrame:
    """Groups of equal content: number, size, total and wasted bytes, share saved."""
    groups = files.where("size > 0").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.min("file_id").alias("first_id"))
    groups = groups.where("n > 1")
    return groups.select(key, "n", "size", "first_id", (F.col("n") * F.col("size")).alias("total"), ((F.col("n") - 1) * F.col("size")).alias("wasted"), F.round((1 - 1 / F.col("n")) * 100, 4).alias("saved_percent"))


def staged_duplicates(files: DataFrame) -> DataFrame:
    """Duplicate groups found by size first, then by a hash of the edges, then in full.

    Only files whose size, and then whose quick hash, occurs again are hashed.
    """
    rows = files.where("size > 0")
    again = rows.groupBy("size").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("size")
    rows = rows.join(again, "size", "left_semi").withColumn("quick", S.quick_hash(F.col("size"), F.col("text").cast("binary")))
    again = rows.groupBy("size", "quick").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("size", "quick")
    rows = rows.join(again, ["size", "quick"], "left_semi").withColumn("full", F.sha2("text", 256))
    return rows.groupBy("size", "full").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("full").alias("sha256"), "size", "n", ((F.col("n") - 1) * F.col("size")).alias("wasted"))


def with_first(files: DataFrame) -> DataFrame:
    """Add first_id, the smallest id of the file's content.

    An aggregate and a join instead of a window: one very common content is
    combined before the shuffle, and the join can be split.
    """
    firsts = files.groupBy("sha256").agg(F.min("file_id").alias("first_id"))
    return files.join(firsts, "sha256")


def duplicate_of(files: DataFrame) -> DataFrame:
    """Each copy with the first file of its content; empty files are no copies."""
    rows = with_first(files.where("size > 0")).where("file_id <> first_id")
    return rows.select("file_id", "size", F.col("first_id").alias("duplicate_of"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths added, deleted or changed in size or content between two snapshots (path, size, sha256)."""
    b = before.select("path", F.col("size").alias("old_size"), F.col("sha256").alias("old_sha"))
    a = after.select("path", F.col("size").alias("new_size"), F.col("sha256").alias("new_sha"))
    status = F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "deleted").when((F.col("old_sha") != F.col("new_sha")) | (F.col("old_size") != F.col("new_size")), "modified")
    return b.join(a, "path", "full_outer").withColumn("status", status).where("status is not null").select("path", "status", "old_size", "new_size")


def search_content(files: DataFrame, pattern: str, max_results: int, max_size: int = 10 << 20) -> DataFrame:
    """Lines that match ``pattern`` in any case: path, line number from 1, first 200 characters; in order of path and line."""
    lines = files.where(F.col("size") <= max_size).select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    hits = lines.where(F.col("line").rlike("(?i)" + pattern))
    return hits.select("path", (F.col("pos") + 1).cast("long").alias("line_number"), F.substring("line", 1, 200).alias("line")).orderBy("path", "line_number").limit(max_results)


def cleanup_plan(files: DataFrame, batch: int) -> DataFrame:
    """Copies beyond the first of each content, largest first, up to ``batch``; a plan, nothing is deleted."""
    rows = with_first(files.where("size > 0")).where("file_id <> first_id")
    return rows.orderBy(F.col("size").desc(), "file_id").limit(batch).select("file_id", "path", "size")


def suggestions(files: DataFrame, as_of: Column, large: int, wasteful: int) -> DataFrame:
    """Rows of advice: duplicates, temporary, large and old files with count and size, each if it passes its threshold."""
    rows = with_first(files).withColumn("copy", (F.col("size") > 0) & (F.col("file_id") != F.col("first_id")))
    old = (F.col("mdate") < as_of) & ~F.col("name").startswith(".")
    temp = S.temporary(F.col("name"))
    big = F.col("size") >= large
    kinds = {"duplicates": (F.col("copy"), F.col("bytes") > wasteful), "temp": (temp, F.col("n") > 0), "large": (big, F.col("bytes") > wasteful), "old": (old, F.col("n") > 0)}
    rows = rows.select("size", F.explode(F.array(*[F.when(c, F.lit(k)) for k, (c, _) in kinds.items()])).alias("action")).where("action is not null")
    sums = rows.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return sums.where(S.first_of([(F.col("action") == k, t) for k, (_, t) in kinds.items()], False))
