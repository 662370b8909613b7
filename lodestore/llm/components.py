"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored


def components(links: DataFrame, id_type: str) -> DataFrame:
    """id, component (smallest id of its component) for every id that ``links(a, b)`` names.

    Each step aggregates a node's smallest neighbour and joins it back, so a node
    with very many links is combined before the shuffle and split in the join.
    Steps repeat until the links no longer change; each is written out.  Null ids
    are ignored; no links: no rows.
    """

    def ordered(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        met = both.join(low, "u")
        if large:
            return ordered(met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        return ordered(met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))))

    def mark(e: DataFrame) -> tuple:
        # exact sums of hashes, so two different link sets do not look alike
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    held = Stored(ordered(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null")), "links", tidy=False)
    before = mark(held.df)
    while before[0]:
        new = Stored(star(star(held.df, True), False), "links", tidy=False)
        held.drop()
        held, after = new, mark(new.df)
        if after == before:
            break
        before = after
    e = held.df
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
