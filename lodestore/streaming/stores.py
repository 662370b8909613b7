"""What streams keep beyond their own state: a filter that grows batch by batch, and a log of versioned states."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import bloom_words
from ..sources.shared import Store

_WORDS = "word long, bits long"


class GrowingFilter:
    """A bloom filter in a shared folder to which each batch of a stream adds once.

    A batch writes a filter of its own (the newest one's bits and its items') and then, as
    the last thing, the marker that bears its number.  A batch whose marker is there is
    passed over, so replays change nothing, and of two writers of one batch one wins.
    """

    def __init__(self, spark: SparkSession, folder: str, capacity: int, error: float):
        self.spark, self.folder, self.capacity, self.error = spark, folder.rstrip("/"), capacity, error
        self.store = Store(spark, folder)

    def _markers(self) -> list[str]:
        return [n for n in self.store.names(f"{self.folder}/batches") if n.endswith(".json")]

    def _filter(self) -> str | None:
        names = self._markers()
        return json.loads(self.store.read(f"{self.folder}/batches/{names[-1]}"))["filter"] if names else None

    def words(self) -> DataFrame:
        """The newest filter as rows (word, bits)."""
        path = self._filter()
        return self.spark.read.schema(_WORDS).parquet(path) if path else self.spark.createDataFrame([], _WORDS)

    def version(self) -> int:
        return len(self._markers())

    def add(self, items: DataFrame, column: str, batch: int) -> bool:
        """Add a batch's items; False if that batch had been added."""
        marker = f"{self.folder}/batches/{batch:012d}.json"
        if self.store.exists(marker):
            return False
        words = bloom_words(items, column, self.capacity, self.error).unionByName(self.words())
        path = f"{self.folder}/filters/{uuid.uuid4().hex}"
        words.groupBy("word").agg(F.bit_or("bits").alias("bits")).write.parquet(path)
        if self.store.create(marker, json.dumps({"filter": path})):
            return True
        self.store.delete(path)
        return False

    def follow(self, stream: DataFrame, column: str, checkpoint: str):
        """A running query that adds the stream's batches."""
        return stream.writeStream.foreachBatch(lambda rows, number: self.add(rows, column, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Conflict(ValueError):
    """Another writer was first."""


class StateLog:
    """States by key in a shared folder, as an append-only log of versions.

    A version adds or replaces many keys' states at once.  It names the version it was made
    from, and is refused if another has come since: its rows are written first, and its
    number is taken by creating a file, which only one writer can.
    """

    _SCHEMA = "key string, state string, expires timestamp"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.store = spark, folder.rstrip("/"), Store(spark, folder)

    def _versions(self) -> list[str]:
        return [n for n in self.store.names(f"{self.folder}/log") if n.endswith(".json")]

    def version(self) -> int:
        return len(self._versions())

    def commit(self, states: DataFrame, base: int) -> int:
        """Write ``states(key, state, expires)`` as the version after ``base``; a null state takes its key out, a null time never expires."""
        path = f"{self.folder}/states/{uuid.uuid4().hex}"
        states.select("key", "state", F.col("expires").cast("timestamp").alias("expires")).write.parquet(path)
        if self.version() != base or not self.store.create(f"{self.folder}/log/{base + 1:012d}.json", json.dumps({"path": path})):
            self.store.delete(path)
            raise Conflict(f"version {base + 1} has been written")
        return base + 1

    def current(self, as_of: str) -> DataFrame:
        """key, state, version: each key's newest state that has not expired at ``as_of``. A newer state that has expired hides older ones."""
        rows = None
        for number, name in enumerate(self._versions(), 1):
            path = json.loads(self.store.read(f"{self.folder}/log/{name}"))["path"]
            part = self.spark.read.schema(self._SCHEMA).parquet(path).withColumn("version", F.lit(number))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.spark.createDataFrame([], "key string, state string, version int")
        newest = rows.groupBy("key").agg(F.max(F.struct("version", "state", "expires")).alias("s")).select("key", "s.*")
        return newest.where(F.col("state").isNotNull() & (F.col("expires").isNull() | (F.col("expires") > F.lit(as_of).cast("timestamp")))).select("key", "state", "version")
