"""Continuous operators over several micro-batches and restarts, against plain loops."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lodestore.operators import dedup as D
from lodestore.operators import logs
from lodestore.streaming import stateful as K
from lodestore.streaming.stores import Conflict, GrowingFilter, StateLog

START = datetime(2025, 1, 1, tzinfo=timezone.utc)


class Feed:
    """Rows written file by file and read as a stream, one file a batch, over and over with one checkpoint."""

    def __init__(self, spark, folder, schema, operator):
        self.spark, self.folder, self.schema, self.operator, self.files = spark, folder, schema, operator, 0

    def add(self, *files):
        for rows in files:
            self.files += 1
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/in/{self.files:04d}")

    def run(self):
        stream = self.operator(self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{self.folder}/in"))
        query = stream.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(tuple(r) for r in self.spark.read.schema(stream.schema).parquet(f"{self.folder}/out").collect())


def test_motion_goes_on_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"c{rng.randrange(4)}", i, rng.random() * 100) for i in range(200)]
    feed = Feed(spark, str(tmp_path), "key string, at long, value double", lambda s: K.frame_motion(s, 30.0))

    def wanted(rows):
        last, out = {}, []
        for key, at, value in rows:
            if key in last and abs(value - last[key]) > 30:
                out.append((key, at, abs(value - last[key])))
            last[key] = value
        return sorted(out)

    feed.add(rows[:50], list(reversed(rows[50:90])))
    assert feed.run() == wanted(rows[:90])
    feed.add(rows[90:91], rows[91:])
    assert feed.run() == wanted(rows)


def ms(seconds):
    return round((START + timedelta(seconds=seconds)).timestamp() * 1000)


def test_a_silent_node_dies_once(spark, tmp_path):
    beat = lambda node, s: (node, START + timedelta(seconds=s))
    feed = Feed(spark, str(tmp_path), "node string, time timestamp", lambda s: K.deaths(s, "15 seconds", "2 seconds"))
    feed.add([beat("a", 0), beat("b", 0), beat("a", 10)], [beat("a", 20), beat("c", 20)])
    # the watermark is at 18: b died at 15, by a timer and not by a beat of its own
    assert feed.run() == [("b", ms(0), ms(15))]
    assert feed.run() == [("b", ms(0), ms(15))]
    feed.add([beat("b", 30), beat("a", 30)], [beat("b", 44.9), beat("a", 60)])
    # c died at 35 and a at 45, though a came back; b lives until 59.9 and the watermark is at 58
    assert feed.run() == sorted([("b", ms(0), ms(15)), ("c", ms(20), ms(35)), ("a", ms(30), ms(45))])
    feed.add([beat("d", 200)])
    assert feed.run() == sorted([("b", ms(0), ms(15)), ("c", ms(20), ms(35)), ("a", ms(30), ms(45)), ("b", ms(44.9), ms(59.9)), ("a", ms(60), ms(75))])


def test_bursts_equal_those_of_the_whole_log(spark, tmp_path):
    rng = random.Random(4)
    at, rows = 0.0, []
    for i in range(300):
        at += rng.choice([0.5, 3, 20, 70])
        rows.append((f"b{rng.randrange(3)}", i, START + timedelta(seconds=at)))
    feed = Feed(spark, str(tmp_path), "block_id string, line_number long, time timestamp", lambda s: K.error_bursts(s, 60, 3, "1 second"))
    out, held = [], {}
    for block, line, time in rows:
        held[block] = [t for t in held.get(block, []) if t > time - timedelta(seconds=60)] + [time]
        out.append((block, line, len(held[block]), len(held[block]) >= 3))
    feed.add(rows[:100], rows[100:170])
    assert feed.run() == sorted(out[:170])
    feed.add(rows[170:180], rows[180:])
    got = feed.run()
    assert got == sorted(out)
    parsed = spark.createDataFrame([(b, n, t.strftime("%Y-%m-%d %H:%M:%S"), "ERROR") for b, n, t in rows], "block_id string, line_number long, ts string, level string")
    last = {b: (n, burst) for b, _, n, burst in got}
    batch = {r["block_id"]: r["survivors"] for r in logs.bursts(parsed, 60, 3).collect()}
    assert all(abs(batch[b] - last[b][0]) <= 1 for b in batch)  # the log's times have whole seconds


def test_a_filter_grows_once_a_batch(spark, tmp_path):
    grown = GrowingFilter(spark, str(tmp_path / "filter"), 1000, 0.01)
    items = spark.createDataFrame([(f"i{n}",) for n in range(60)], "item string")
    parts = [items.where(F.col("item").rlike(r)) for r in ("[0-4]$", "[5-7]$", "[89]$")]
    assert grown.words().count() == 0
    assert [grown.add(p, "item", n) for n, p in enumerate(parts)] == [True] * 3
    whole = sorted(map(tuple, D.bloom_words(items, "item", 1000, 0.01).collect()))
    assert sorted(map(tuple, grown.words().collect())) == whole
    other = spark.createDataFrame([("other",)], "item string")
    assert not grown.add(other, "item", 1) and sorted(map(tuple, grown.words().collect())) == whole
    assert grown.version() == 3 and len([x for x in (tmp_path / "filter" / "filters").iterdir() if x.is_dir()]) == 3


def test_positions_are_those_of_the_digests(spark):
    import hashlib

    items = ["", "a", "Wörter", "x" * 1000]
    bits, hashes = D.bloom_shape(5000, 0.001)
    rows = spark.createDataFrame([(i,) for i in [*items, None]], "item string").select("item", D.bloom_positions(F.col("item"), 5000, 0.001).alias("p")).collect()
    for r in rows:
        if r["item"] is None:
            assert r["p"] is None
            continue
        a, b = (int(f(r["item"].encode()).hexdigest(), 16) for f in (hashlib.sha256, hashlib.md5))
        assert r["p"] == [(a + i * b) % bits for i in range(hashes)]
    with pytest.raises(ValueError):
        D.bloom_positions(F.col("item"), 10**9, 0.001)
    words = D.bloom_words(spark.createDataFrame([(i,) for i in items], "item string"), "item", 5000, 0.001)
    probed = D.bloom_probe(spark.createDataFrame([(i,) for i in [*items, None, "absent"]], "item string"), "item", words, 5000, 0.001).collect()
    assert {r["item"]: r["maybe"] for r in probed} == {**dict.fromkeys(items, True), None: False, "absent": False}


def test_of_two_writers_of_a_version_one_is_refused(spark, tmp_path):
    log = StateLog(spark, str(tmp_path / "log"))
    states = lambda *rows: spark.createDataFrame(rows, "key string, state string, expires timestamp")
    assert log.current("2025-01-01").count() == 0
    assert log.commit(states(("a", "1", None), ("b", "1", None), ("c", "1", datetime(2025, 1, 2))), 0) == 1
    with pytest.raises(Conflict):
        log.commit(states(("a", "lost", None)), 0)
    assert log.commit(states(("a", "2", None), ("b", None, None), ("d", "1", datetime(2024, 1, 1))), 1) == 2
    now = lambda t: {tuple(r) for r in log.current(t).collect()}
    assert now("2025-01-01") == {("a", "2", 2), ("c", "1", 1)}
    assert now("2025-01-03") == {("a", "2", 2)}
    assert len([x for x in (tmp_path / "log" / "states").iterdir() if x.is_dir()]) == 2
