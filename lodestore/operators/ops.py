"""Operations: metrics and alerts, tasks and queues, health, projections of savings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import first_of

# Thresholds by metric.
THRESHOLDS = {"cpu": 80.0, "memory": 85.0, "disk": 90.0}


def alerts(metrics: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Samples above their metric's threshold; critical from 1.1 times on."""
    limit = first_of([(F.col("metric") == k, float(v)) for k, v in thresholds.items()])
    rows = metrics.withColumn("threshold", limit).where("value > threshold")
    return rows.withColumn("level", F.when(F.col("value") >= F.col("threshold") * 1.1, "critical").otherwise("warning"))


def histogram(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts of values up to each bound, the last one unbounded: bound, n."""
    marks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(str(b)).alias("bound"), (F.col(value) <= b).alias("under")) for i, b in enumerate(bounds)], F.struct(F.lit(len(bounds)).alias("i"), F.lit("+Inf").alias("bound"), F.lit(True).alias("under")))
    return rows.select(F.explode(marks).alias("m")).groupBy("m.bound").agg(F.count_if("m.under").alias("n"))


def rate_limited(calls: DataFrame, time: Column, limit: int, window: int = 60) -> DataFrame:
    """Whether each call is among the first ``limit`` of its trailing window, all calls counted."""
    w = Window.partitionBy("node").orderBy(time).rangeBetween(-window + 1, 0)
    return calls.withColumn("allowed", F.count(F.lit(1)).over(w) <= limit)


# Allowed steps of a file's life.
TRANSITIONS = [("pending", "running"), ("running", "completed"), ("running", "failed"), ("failed", "pending")]


def transitions(steps: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Each change of state with whether it is allowed."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(order))
    rows = steps.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col(state)))
    legal = F.concat_ws(">", "before", state).isin([f"{a}>{b}" for a, b in TRANSITIONS])
    return rows.withColumn("legal", legal)


def overall_health(checks: DataFrame) -> DataFrame:
    """UNHEALTHY if any is, else DEGRADED if any is, else HEALTHY; UNKNOWN without checks. ``checks(status)``."""
    rank = first_of([(F.col("status") == "UNHEALTHY", 3), (F.col("status") == "DEGRADED", 2), (F.col("status") == "HEALTHY", 1)], 0)
    worst = F.coalesce(F.max(rank), F.lit(0))
    return checks.agg(first_of([(worst == 3, "UNHEALTHY"), (worst == 2, "DEGRADED"), (worst == 1, "HEALTHY")], "UNKNOWN").alias("status"))


def disk_health(used: Column, unhealthy: float = 0.9, degraded: float = 0.72) -> Column:
    return F.when(used >= unhealthy, "UNHEALTHY").when(used >= degraded, "DEGRADED").otherwise("HEALTHY")


def progress(tasks: DataFrame, key: str, order: str, amount: str) -> DataFrame:
    """Running share of the work done within each key."""
    w = Window.partitionBy(key)
    done = F.sum(amount).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return tasks.withColumn("done", done).withColumn("percent", F.round(done * 100.0 / F.sum(amount).over(w), 6))


def retry_queue(tasks: DataFrame, slots: int, most: int = 3) -> DataFrame:
    """State of each task of ``tasks(task_id, status, priority, created, retries)``: attempts, and running, waiting or dead.

    A task that is put in more than once is one task, as it was put in last.  A failed one
    is tried again unless it was ``most`` times, which sets it aside.  The ``slots`` most
    urgent ones run: by priority, then age, then id.
    """
    once = tasks.groupBy("task_id").agg(F.max(F.struct("created", "retries", "priority", "status")).alias("t")).select("task_id", "t.*")
    failed = F.col("status") == "failed"
    rows = once.withColumn("attempts", F.col("retries") + failed.cast("int")).withColumn("dead", failed & (F.col("retries") >= most))
    first = rows.where("not dead").orderBy(F.col("priority").desc(), "created", "task_id").limit(slots).select("task_id", F.lit("running").alias("runs"))
    state = F.when(F.col("dead"), "dead").otherwise(F.coalesce("runs", F.lit("waiting")))
    return rows.join(first, "task_id", "left").withColumn("state", state).drop("dead", "runs")


class Handlers:
    """Functions from rows to rows by the kind in a column."""

    def __init__(self, column: str):
        self.column = column
        self._by_kind: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, kind: str, handler: Callable[[DataFrame], DataFrame]) -> None:
        if kind in self._by_kind:
            raise ValueError(f"two handlers for {kind}")
        self._by_kind[kind] = handler

    def run(self, rows: DataFrame) -> DataFrame:
        """What the handlers make of their rows, and the rows of other kinds with a ``problem``."""
        known = F.col(self.column).isin(list(self._by_kind))
        out = rows.where(~F.coalesce(known, F.lit(False))).withColumn("problem", F.lit("no handler"))
        for kind, handler in self._by_kind.items():
            out = out.unionByName(handler(rows.where(F.col(self.column) == kind)), allowMissingColumns=True)
        return out
