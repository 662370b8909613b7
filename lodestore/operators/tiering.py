"""Storage tiers: classification, cost, recommendations, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import TIER_COST, first_of, tier_cost

Rule = tuple[Column, str, float, str]


def default_rules() -> list[Rule]:
    """(condition, tier, confidence, reason) in order; the first that holds decides.

    As the established behaviour has it, a young fingerprint is hot only below
    1000 accesses, so later rules are met from 180 days on.
    """
    age, access = F.col("age_days"), F.col("access_count")
    return [
        (F.col("pinned"), "hot", 1.0, "pinned"),
        (F.col("archive_only"), "cold", 1.0, "archive_only"),
        ((age < 30) & (access < 1000), "hot", 0.85, "access"),
        (age < 180, "warm", 0.75, "access"),
        (age > 365, "cold", 0.7, "age"),
        (F.col("refcount") > 10, "warm", 0.65, "refcount"),
        ((F.col("size") > 100 << 20) & (F.col("ratio") < 1.5), "cold", 0.6, "size"),
    ]


def classify(ctx: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Add new_tier, confidence, reason and cost (a month) by the first rule that holds, else warm."""
    rules = rules if rules is not None else default_rules()
    out = ctx.withColumn("new_tier", first_of([(c, t) for c, t, _, _ in rules], "warm"))
    out = out.withColumn("confidence", first_of([(c, p) for c, _, p, _ in rules], 0.5)).withColumn("reason", first_of([(c, r) for c, _, _, r in rules], "default"))
    return out.withColumn("cost", tier_cost(F.col("new_tier"), F.col("size")))


def classify_simple(ctx: DataFrame) -> DataFrame:
    """Add new_tier by age and accesses only; the default is cold."""
    age = F.col("age_days")
    return ctx.withColumn("new_tier", first_of([((age < 30) & (F.col("access_count") < 1000), "hot"), (age < 180, "warm")], "cold"))


def migrations(classified: DataFrame) -> DataFrame:
    """Fingerprints whose tier should change with a saving."""
    saving = tier_cost(F.col("tier"), F.col("size")) - F.col("cost")
    return classified.withColumn("saving", F.round(saving, 9)).where((F.col("tier") != F.col("new_tier")) & (F.col("saving") > 0))


def colder_saving(ctx: DataFrame) -> DataFrame:
    """Monthly saving if each fingerprint moved one tier colder, by tier."""
    nxt = first_of([(F.col("tier") == "hot", "warm"), (F.col("tier") == "warm", "cold")])
    rows = ctx.withColumn("next_tier", nxt).where("next_tier is not null")
    cost = tier_cost(F.col("tier"), F.col("size")) - tier_cost(F.col("next_tier"), F.col("size"))
    return rows.groupBy("tier", "next_tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(cost), 6).alias("saving"))


def usage_alerts(usage: DataFrame, warning: float = 80.0, critical: float = 95.0) -> DataFrame:
    """Alerts of ``usage(tier, percent)`` at or above a threshold."""
    level = first_of([(F.col("percent") >= critical, "critical"), (F.col("percent") >= warning, "warning")])
    return usage.withColumn("level", level).where("level is not null")


def cost_by_tier(ctx: DataFrame) -> DataFrame:
    """Monthly cost of each tier in a column of its own, in all and for a year."""
    row = ctx.agg(*[F.round(F.sum(F.when(F.col("tier") == t, tier_cost(F.col("tier"), F.col("size"))).otherwise(0.0)), 6).alias(t) for t in TIER_COST])
    total = sum(F.col(t) for t in TIER_COST)
    return row.withColumn("monthly", F.round(total, 6)).withColumn("annual", F.round(total * 12, 6))


# Tiers from warm to cold.
TIERS = ["hot", "warm", "cold"]


def next_colder(tier: Column) -> Column:
    """The tier after this one; null after the last and for a tier that is none."""
    order = F.array(*map(F.lit, TIERS))
    place = F.array_position(order, tier)
    return F.when((place > 0) & (place < len(TIERS)), F.element_at(order, (place + 1).cast("int")))
