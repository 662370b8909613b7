"""Operators on small inputs with known answers."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestore.functions import scalar as S
from lodestore.operators import archive, audit, chunking, dedup, frames, inventory, logs, ops, placement
from lodestore.plans import registry
from lodestore.plans.catalog import Tables
from lodestore.sources import files, sinks


def test_duplicates_ignore_empty_files(spark):
    rows = spark.createDataFrame([(1, 5, "a", "12345"), (2, 5, "a", "12345"), (3, 0, "e", ""), (4, 0, "e", ""), (5, 7, "b", "1234567")], "file_id long, size long, sha256 string, text string")
    groups = inventory.duplicate_groups(rows).collect()
    assert [(g["n"], g["wasted"]) for g in groups] == [(2, 5)]
    staged = inventory.staged_duplicates(rows).collect()
    assert [(g["n"], g["wasted"]) for g in staged] == [(2, 5)]


def test_ring_positions_and_shards(spark):
    row = spark.range(1).select(S.ring_position(F.lit("a" * 64)).alias("pos"), S.md5_shard(F.lit("a" * 64)).alias("shard")).first()
    assert (row["pos"], row["shard"]) == (4292891902, 212)


def test_route_takes_next_slot_around_the_end(spark):
    ring = spark.createDataFrame([(10, "a"), (20, "b"), (4294967000, "c")], "pos long, node_id string")
    keys = spark.createDataFrame([(f"k{i}",) for i in range(200)], "key string")
    for r in placement.route(keys, ring).collect():
        want = "a" if r["pos"] <= 10 or r["pos"] > 4294967000 else "b" if r["pos"] <= 20 else "c"
        assert r["node_id"] == want


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_chunks_join_to_the_input(raw):
    data = np.frombuffer(raw, np.uint8)
    for cuts in (chunking.rabin_cuts(data, 64, 128, 512), chunking.fast_cuts(data, 64, 512, 7)):
        assert b"".join(raw[a:z] for a, z in zip(cuts[:-1], cuts[1:])) == raw
        assert all(z > a for a, z in zip(cuts[:-1], cuts[1:]))


def _plain_rabin(data, shortest, mean):
    """The rolling hash byte by byte."""
    starts, h = [0], 0
    for i, b in enumerate(data):
        h = (h * 2 + b) % (1 << 64)
        s = i - 47
        if i >= 48 and h % mean == 0 and s - starts[-1] >= shortest:
            starts.append(s)
    return starts


def test_rabin_cuts_equal_the_rolling_hash():
    data = np.random.default_rng(77).integers(0, 256, 60000, dtype=np.uint8)
    assert chunking.rabin_cuts(data, 256, 512, 1 << 30)[:-1] == _plain_rabin(data.tolist(), 256, 512)


def test_sightings(spark):
    rows = spark.createDataFrame([(1, 0, "x", 3), (1, 1, "y", 4), (2, 0, "x", 3), (3, 0, "x", 3)], "file_id long, chunk_index long, fp string, size long")
    assert sorted(r["seen"] for r in dedup.sightings(rows).collect()) == [1, 1, 2, 3]
    assert dedup.sightings(rows, 2).where("is_unique").count() == 3
    total = dedup.totals(rows).first()
    assert (total["n"], total["n_unique"], total["bytes"], total["stored"]) == (4, 2, 13, 7)


def test_bloom_holds_all_and_few_others(spark):
    items = spark.createDataFrame([(f"item{i}",) for i in range(500)], "k string")
    words = dedup.bloom_words(items, "k", 1000, 0.01)
    probe = items.unionByName(spark.createDataFrame([(f"other{i}",) for i in range(500)], "k string"))
    found = dedup.bloom_probe(probe, "k", words, 1000, 0.01).collect()
    assert all(r["maybe"] for r in found if r["k"].startswith("item"))
    assert sum(r["maybe"] for r in found if r["k"].startswith("other")) < 20
    assert abs(dedup.bloom_count(words, 1000, 0.01).first()[0] - 500) < 30


def test_chain_shows_changes(spark):
    rows = spark.createDataFrame([(i, f"e{i}", "2024-01-01", "X", "u", "d", "t", "a", i, 0, "LOW", "p") for i in range(6)], "line_no long, " + ", ".join(f"{c} string" for c in audit.HASHED[:7]) + ", original_size long, new_size long, classification string, policy_id string")
    chain = audit.chained(rows)
    assert audit.verify_chain(chain).count() == 0
    assert [r["line_no"] for r in audit.verify_chain(chain.where("line_no <> 3")).collect()] == [4]
    changed = chain.withColumn("new_size", F.when(F.col("line_no") == 2, 9).otherwise(F.col("new_size")))
    assert [(r["line_no"], r["changed"]) for r in audit.verify_chain(changed).collect()] == [(2, True)]


def test_log_lines_of_every_form(spark):
    """Lines and what each says, written out by hand."""
    made = [
        ('{"userId": "abcdef123456", "level": "info"}', {"user_id": "abcdef123456"}),
        ("{'sessionId': 'sess-0123456789ab'}", {"session_id": "sess-0123456789ab"}),
        ("user id: someone-42", {"user_id": "someone-42"}),
        ("X-User-ID: u7", {"user_id": "u7"}),
        ("uid=longenough1", {"user_id": "longenough1"}),
        ("orderNo=AB-1234567890", {"order_id": "AB-1234567890"}),
        ("sid: 0123456789abcdef", {"session_id": "0123456789abcdef"}),
        ("request_id=abcdefghij0123456789", {"transaction_id": "abcdefghij0123456789"}),
        ("from 10.0.0.7 now", {"ip_address": "10.0.0.7"}),
        ("2024-01-15T10:30:45.123Z java.io.IOEXCEPTION: after an Exception", {"time": "2024-01-15 10:30:45", "exception": "IOEXCEPTION"}),
        ("java.io.IOEXCEPTION: no", {}),
        ("2024-01-15  10:30:45 x NullPointerException : gone", {"time": "2024-01-15 10:30:45", "exception": "NullPointerException"}),
        ("Jan  5 10:30:45 host su: AT com.acme.MyException.run (A.java:3)", {"time": "1900-01-05 10:30:45", "exception": "com.acme.MyException.run"}),
        ("1705314645", {"time": "2024-01-15 10:30:45"}),
        ("1705314645123", {"time": "2024-01-15 10:30:45"}),
        ("nothing of the kind", {}),
    ]
    lines = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "i int, line string")
    line = F.col("line")
    stamp = F.date_format(logs.log_timestamp(line, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")
    got = lines.select("i", stamp.alias("time"), logs.exception_type(line).alias("exception"), *[logs.keyword(line, f).alias(f) for f in logs.KEYWORDS]).collect()
    for r in got:
        want = {"time": "2000-01-01 00:00:00"} | made[r["i"]][1]
        assert {k: v for k, v in r.asDict().items() if k != "i" and v is not None} == want


def test_burst_survivors_with_times_out_of_order(spark):
    seconds = [0, 100, 40, 90, 95, 99, 97]
    rows = [("b", i, f"2024-01-01 00:{s // 60:02d}:{s % 60:02d} ERROR x") for i, s in enumerate(seconds)]
    parsed = logs.parse_lines(spark.createDataFrame(rows, "block_id string, line_number long, raw_line string"))
    alive = []
    for s in seconds:
        alive = [t for t in [*alive, s] if t > s - 60]
    found = logs.bursts(parsed).first()
    assert (found["survivors"], found["error_burst"]) == (len(alive), len(alive) >= 5)


def test_sampling_tail_of_nothing_keeps_all(spark):
    rows = spark.createDataFrame([("b", i, "2024-01-01 00:00:00 INFO x") for i in range(3)], "block_id string, line_number long, raw_line string")
    assert logs.sample_lines(logs.parse_lines(rows), "tail", 0.1).count() == 3
    assert logs.sample_lines(logs.parse_lines(rows), "head", 0.1).count() == 0


def test_priorities_as_words_and_by_rank(spark):
    block = spark.createDataFrame([("b", 10, 1, 0, 0, 0, 0, 3, 0, False, False, False, False, "2024-01-01 12:00:00")], "block_id string, total_lines long, error_count long, warn_count long, info_count long, debug_count long, unique_users long, unique_orders long, unique_sessions long, error_burst boolean, circuit_breaker_open boolean, memory_warning boolean, timeout_pattern boolean, start_time string")
    assert logs.policy(block, "lexical").first()["priority"] == "medium"
    assert logs.policy(block, "ranked").first()["priority"] == "critical"
    with pytest.raises(ValueError):
        logs.policy(block, "other")


def test_ema_equals_the_recursion(spark):
    values = [(0, i, (i * 37) % 256) for i in range(700)]
    rows = frames.ema(spark.createDataFrame(values, "camera long, frame long, level long")).orderBy("frame").collect()
    want = None
    for (_, _, v), r in zip(values, rows):
        want = v if want is None else 0.95 * want + 0.05 * v
        assert abs(r["background"] - want) < 1e-6


def test_archive_round_trip(spark):
    rows = spark.createDataFrame([(1, "a", 4000, "x" * 4000), (2, "b", 3, "abc"), (3, "c", 0, None)], "file_id long, path string, size long, text string").withColumn("sha256", F.sha2("text", 256))
    made = archive.gzip_archive(rows).collect()
    assert [(r["file_id"], r["verified"]) for r in made] == [(1, True)]
    for codec in archive.CODECS:
        back = archive.unpacked(archive.packed(rows.select("file_id", "text"), "text", codec), "packed", codec)
        assert {r["file_id"]: r["unpacked"] and bytes(r["unpacked"]).decode() for r in back.collect()} == {1: "x" * 4000, 2: "abc", 3: None}


def test_codecs_cover_every_file(spark, small):
    texts = {r["file_id"]: r["text"] for r in Tables(spark, small).files.select("file_id", "text").collect()}
    want = {(i, name): len(pack(t.encode())) for i, t in texts.items() for name, (pack, _) in archive.CODECS.items()}
    got = registry.queries()["sink_tier_backend"](spark, small).collect()
    assert len(got) == len(want) and {(r["file_id"], r["codec"]): r["bytes"] for r in got} == want
    best = registry.queries()["topk_best_codec"](spark, small).collect()
    assert len(best) == len(texts)
    assert all((r["bytes"], r["codec"]) == min((want[r["file_id"], c], c) for c in archive.CODECS) for r in best)


def test_health_without_checks(spark):
    assert ops.overall_health(spark.createDataFrame([], "status string")).first()["status"] == "UNKNOWN"


def test_safe_paths(spark):
    paths = {"a/b.txt": True, "../x": False, "/abs": False, "c:x": False, "CON.txt": False, "a/b.": False, "a\\..\\b": False, "": False, "nested/item": True}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", S.safe_relative(F.col("p")).alias("ok")).collect()
    assert {r["p"]: r["ok"] for r in rows} == paths


def test_sizes_are_shown_as_established(spark):
    sizes = {0: "0.0 B", 1023: "1023.0 B", 1280: "1.2 KB", 1 << 20: "1.0 MB", 5 << 30: "5.0 GB", 1 << 50: "1.00 PB"}
    rows = spark.createDataFrame([(s,) for s in sizes], "s long").select("s", S.format_size(F.col("s")).alias("t")).collect()
    assert {r["s"]: r["t"] for r in rows} == sizes


def test_scan_and_exports(spark, tmp_path):
    (tmp_path / "in" / ".git").mkdir(parents=True)
    (tmp_path / "in" / "a.log").write_text("one\ntwo")
    (tmp_path / "in" / ".git" / "b.log").write_text("x")
    rows = files.scan(spark, str(tmp_path / "in")).collect()
    assert [(r["name"], r["size"]) for r in rows] == [("a.log", 7)]
    assert files.default_registry().read(spark, "s3", str(tmp_path / "in")).first()["sha256"] is None
    lines = files.log_lines(spark, str(tmp_path / "in" / "a.log")).orderBy("line_number").collect()
    assert [r["raw_line"] for r in lines] == ["one", "two"]
    out = spark.createDataFrame([("=1+1", 2), ("fine", 3)], "cell string, n int")
    sinks.write_csv(out, str(tmp_path / "out"))
    assert {r["cell"] for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()} == {"'=1+1", "fine"}
    assert sinks.export_audit(out, str(tmp_path / "json"), "json") == 2
