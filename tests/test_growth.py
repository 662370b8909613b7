"""Steps whose work must grow no faster than their input."""

import lzma
import random
import tracemalloc
from datetime import date, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from lodestore.operators import archive, bundles, chunking, dedup, lifecycle, logs
from lodestore.plans import registry
from lodestore.sources import mounted


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _lines(spark, n, blocks=1):
    line = F.concat(F.date_format(F.timestamp_seconds(1704067200 + F.col("id")), "yyyy-MM-dd HH:mm:ss"), F.lit(" ERROR x"))
    return spark.range(n).select((F.col("id") % blocks).cast("string").alias("block_id"), F.col("id").alias("line_number"), line.alias("raw_line"))


def test_bursts_read_no_frame_of_all_that_follows(spark):
    """Such a frame is added up anew for each row, so a block's work grew with the square of its errors."""
    found = logs.bursts(logs.parse_lines(_lines(spark, 1000), fields=("ts", "level")), 60, 5)
    assert "unboundedfollowing" not in _plan(found).lower()
    assert [tuple(r) for r in found.collect()] == [("0", 60, True)]


def test_a_line_is_parsed_before_its_level_is_asked(spark):
    """A filter on the level went below the parse, with the patterns written out once more."""
    errors = logs.parse_lines(_lines(spark, 10), fields=("ts", "level")).where("level = 'ERROR'")
    assert not [x for x in _plan(errors).splitlines() if "Filter" in x and "RLIKE" in x.upper()]
    assert errors.count() == 10


def test_a_filter_grows_with_its_table(spark, tmp_path):
    """With room for 5000 keys, one that holds 30,000 found nearly all others too."""
    ids = list(range(30_000))
    rows = {"doc_id": ids, "text": [f"text {i}" for i in ids], "lang": ["en"] * len(ids), "source": ["src1"] * len(ids)}
    pq.write_table(pa.table(rows), tmp_path / "documents.parquet")
    found = {r["kind"]: (r["surely_found"], r["few_others"]) for r in registry.queries()["join_bloom_probe"](spark, str(tmp_path)).collect()}
    assert found == {"held": (30_000, True), "other": (0, True)}


def test_a_filter_too_large_to_send_is_joined(spark):
    items = spark.createDataFrame([(f"k{i}",) for i in range(500)], "k string")
    words = dedup.bloom_words(items, "k", 1000, 0.01)
    probe = items.unionByName(spark.createDataFrame([(f"o{i}",) for i in range(500)] + [(None,), ("k1",)], "k string"))
    sent, joined = (sorted(map(tuple, dedup.bloom_probe(probe, "k", words, 1000, 0.01, **limit).collect()), key=str) for limit in ({}, {"limit": 1}))
    assert joined == sent and len(joined) == 1002


def test_an_object_scan_lists_names_with_a_dot(spark, small):
    """Spark's readers pass over them, and the query's SQL had left them out as well."""
    found = [r["path"].split("/")[-1] for r in registry.queries()["src_scan_s3"](spark, small).collect()]
    assert len(found) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert any(name.startswith(".") for name in found)


def test_xz_sets_up_no_more_than_a_content_needs(spark, small):
    """Level 9 takes a dictionary of 64 MB for a text of a few KB; sizes must be those of the plain codec."""
    texts = [r["text"].encode() for r in spark.read.parquet(f"{small}/documents.parquet").where("text is not null").select("text").limit(100).collect()]
    for level in (6, 9):
        pack = archive.xz(level)
        for raw in [b"", b"x", *texts[:20], b"".join(texts) * 10]:
            packed = pack(raw)
            assert lzma.decompress(packed) == raw and len(packed) == len(lzma.compress(raw, preset=level))
            # the dictionary's size in the filter flags of the block header
            assert not raw or packed[12 + 4] <= (16 if len(raw) <= 1 << 20 else 36)


def test_requests_meet_histories_once(spark, small):
    """Each count and the next shipment had joins of their own, and rows went on with the lists they had met."""
    found = registry.queries()["delete_workflow"](spark, small)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join " in x for x in plan.splitlines()) == 1


def test_long_histories_are_found_at_each_end_of_a_block(spark):
    """More days than two marks apart, asked on, before and after every day."""
    first, n = date(2024, 1, 1), lifecycle.STEP * 3
    changes = [("k", first + timedelta(days=2 * i), 1 if i % 3 else -1) for i in range(n)] + [("k", None, 5)]
    asked = [(i, "k", first + timedelta(days=i - 2), first + timedelta(days=i)) for i in range(2 * n + 6)] + [(-1, None, first, first), (-2, "other", first, first)]
    rows = lifecycle.delete_states(spark.createDataFrame(asked, "request_id long, key string, requested date, decided date"), spark.createDataFrame(changes, "key string, day date, delta int"), grace=3)
    count = lambda key, day: sum(x for k, d, x in changes if k == key and d is not None and d <= day)
    assert {(r["request_id"], r["refs_requested"], r["refs_decided"]) for r in rows.collect()} == {(i, count(k, a), count(k, b)) for i, k, a, b in asked}


def _peak(run, batches):
    """Most bytes of Python's own that ``run`` holds while its batches are read."""
    tracemalloc.start()
    for _ in run(iter(batches)):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


class _Given:
    """Stands for files, to get at the function that their batches go through."""

    schema = {"file_id": type("Field", (), {"dataType": LongType()})}

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


def _texts(n, each):
    return pa.record_batch([pa.array(range(n), pa.int64()), pa.array([bytes([i % 251]) * each for i in range(n)], pa.binary())], ["file_id", "text"])


def test_segments_are_opened_one_at_a_time():
    """A batch of them was copied whole, with a row for each of its entries."""
    entries = [{"sha256": "0" * 64, "begin": 0, "at": i * 512, "length": 512} for i in range(128)]
    kind = pa.list_(pa.struct([("sha256", pa.string()), ("begin", pa.int64()), ("at", pa.int32()), ("length", pa.int32())]))
    packed = [archive.CODECS["gzip"][0](random.Random(i).randbytes(65536)) for i in range(100)]
    columns = [pa.array(["gzip"] * 100), pa.array([65536] * 100, pa.int64()), pa.array([entries] * 100, kind), pa.array(packed, pa.binary())]
    batch = pa.record_batch(columns, ["codec", "raw_bytes", "entries", "data"])
    assert _peak(bundles._unpack, [batch]) < 1 << 20
    assert sum(b.num_rows for b in bundles._unpack(iter([batch]))) == 12800


def test_chunks_are_handed_on_in_lots():
    """All chunks of a batch were held beside its texts."""
    batch = _texts(400, 100_000)
    run = chunking.content_parts(_Given(), "fast", shortest=256, longest=2048, bits=9)
    assert _peak(run, [batch]) < 16 << 20
    assert b"".join(x.as_py() for b in run(iter([batch])) for x in b.column("content")) == b"".join(x.as_py() for x in batch.column("text"))


def test_fingerprints_hold_one_text_at_a_time():
    """A batch was copied whole, and a long text taken as doubles at once."""
    run = chunking.polynomial_fingerprints(_Given())
    assert _peak(run, [_texts(400, 100_000)]) < 8 << 20
    assert _peak(run, [_texts(1, 20_000_000)]) < 48 << 20


def test_writers_hold_one_content_at_a_time(tmp_path):
    """A batch was turned into rows first."""
    writer = mounted.MountedFiles({"path": str(tmp_path)}).writer(StructType([StructField("path", StringType()), StructField("content", BinaryType())]), False)
    assert isinstance(writer, DataSourceArrowWriter)
    names = pa.array([f"a/f{i}" for i in range(100)])
    batch = pa.record_batch([names, pa.array([None] + [bytes([i]) * 100_000 for i in range(1, 100)], pa.binary())], ["path", "content"])
    assert _peak(lambda b: [writer.write(b)], [batch]) < 2 << 20
    assert [(tmp_path / "a" / f"f{i}").read_bytes() for i in range(100)] == [x.as_py() or b"" for x in batch.column("content")]


def test_a_bundle_cuts_its_contents_twice(spark, small, tmp_path, monkeypatch):
    """Once for the manifest and once for the container; its name and counts come from the manifest."""
    read = []
    made = bundles.identifier
    monkeypatch.setattr(bundles, "identifier", lambda files, pieces, kind: read.append(_plan(pieces)) or made(files, pieces, kind))
    files = spark.read.parquet(f"{small}/documents.parquet").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    files = files.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), "content")
    receipt = bundles.create(files, str(tmp_path / "b"), "fast", shortest=256, longest=2048, bits=9)
    assert "MapInArrow" not in read[0] and receipt["verified"]
