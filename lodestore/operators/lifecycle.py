"""Deletion with history: what a count was at a time, and what became of requests to delete.

Changes are added up by day, so a key has no more of them than the calendar has days.
Its history is one row: the days in order, the count after each, and the days on which
something was added.  A question meets it by key once, and all that is asked of it is
found there; no history goes on with a question.  Of each STEP-th day there is a mark,
so a question looks at the marks and at STEP days, however long a history is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import first_of

#: Days between two marks of a history; about the root of the days of seven years.
STEP = 50


def _marks(days: str) -> Column:
    return F.filter(days, lambda _, i: i % STEP == 0)


def _until(days: str, marks: str, at: Column) -> Column:
    """How many of a history's ``days`` lie not after ``at``; 0 without a history."""
    block = F.coalesce(F.array_size(F.filter(marks, lambda x: x <= at)), F.lit(0))
    begin = (block - 1) * STEP
    return F.when(block == 0, F.lit(0)).otherwise(begin + F.array_size(F.filter(F.slice(days, begin + 1, STEP), lambda x: x <= at)))


def histories(changes: DataFrame) -> DataFrame:
    """One row for each key of ``changes(key, day, delta)``: days, totals (after each day), added (days with something added), and the marks of both lists."""
    by_day = changes.where("day is not null").groupBy("key", "day").agg(F.sum("delta").cast("long").alias("delta"), F.max(F.col("delta") > 0).alias("up"))
    # dealt by key once, for the running count, the lists and the questions
    total = F.sum("delta").over(Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    counted = by_day.repartition("key").select("key", "day", "up", total.alias("total"))
    lists = counted.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("day", "total"))).alias("counts"), F.array_sort(F.collect_list(F.when(F.col("up"), F.col("day")))).alias("added"))
    flat = lists.select("key", F.col("counts.day").alias("days"), F.col("counts.total").alias("totals"), "added")
    return flat.select("*", _marks("days").alias("day_marks"), _marks("added").alias("added_marks"))


def delete_states(requests: DataFrame, changes: DataFrame, grace: int = 30) -> DataFrame:
    """What became of ``requests(request_id, key, requested, decided)`` given the ``changes(key, day, delta)`` of references.

    Only a content without references on the day may be requested to go (else
    ``refused``).  A request without a decision stays ``pending``; one that is decided is
    ``rejected`` if there are references by then, else ``authorized``.  A content that is
    referenced anew within ``grace`` days after that comes back from its backup (``restored``).
    Adds refs_requested, refs_decided, restored and state.  Changes without a day count nowhere.
    """
    known = [F.col(c).alias(f"h_{c}") for c in ("key", "days", "totals", "added", "day_marks", "added_marks")]
    met = requests.join(histories(changes).select(*known), F.col("key") == F.col("h_key"), "left")

    def count(at: str) -> Column:
        n = _until("h_days", "h_day_marks", F.col(at))
        return F.when(F.col(at).isNotNull(), F.coalesce(F.get("h_totals", n - 1), F.lit(0).cast("long")))

    later = F.when(F.col("decided").isNotNull(), F.get("h_added", _until("h_added", "h_added_marks", F.col("decided"))))
    rows = met.select(*requests.columns, count("requested").alias("refs_requested"), count("decided").alias("refs_decided"), later.alias("next"))
    back = F.col("next") <= F.date_add("decided", grace)
    state = first_of([(F.col("refs_requested") > 0, "refused"), (F.col("decided").isNull(), "pending"), (F.col("refs_decided") > 0, "rejected"), (F.coalesce(back, F.lit(False)), "restored")], "authorized")
    rows = rows.withColumn("state", state)
    return rows.withColumn("restored", F.when(F.col("state") == "restored", F.col("next"))).drop("next")
