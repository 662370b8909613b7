"""Chunk rules, fingerprints, codecs and containers against plain versions."""

import bz2
import gzip
import hashlib
import lzma

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestore.functions import scalar as S
from lodestore.operators import archive as R
from lodestore.operators import chunking as C
from lodestore.operators import frames as V
from lodestore.operators import tiering as T
from lodestore.sources import sinks
from lodestore.sources.shared import Store


def plain_fast(data, shortest, longest, bits):
    """Cut where the rolling hash of the last bytes hits the target, byte by byte."""
    mask, out, h = (1 << bits) - 1, [0] if data else [], 0
    hits = set()
    for i, byte in enumerate(data):
        h = ((h << 1) ^ byte) & mask
        if h == C.FAST_TARGET & mask:
            hits.add(i + 1)
    pos = 0
    while pos < len(data):
        end = min(pos + longest, len(data))
        cut = next((p for p in range(pos + max(shortest, C.FAST_WINDOW), end + 1) if p in hits and p < len(data)), end)
        out.append(cut)
        pos = cut
    return out


def plain_rabin(data, shortest, mean, longest):
    n = len(data)
    if n < C.RABIN_WINDOW:
        return [0, n] if n else []
    starts, h = [0], 0
    for i, byte in enumerate(data):
        h = (2 * h + byte) % mean
        s = i - C.RABIN_WINDOW + 1
        if i >= C.RABIN_WINDOW and h == 0 and s - starts[-1] >= shortest:
            starts.append(s)
    out = []
    for a, z in zip(starts, [*starts[1:], n]):
        while z - a > longest:
            out.append(a)
            a += longest // 2
        out.append(a)
    return [*out, n]


@given(st.integers(0, 3000), st.integers(0, 10**6), st.sampled_from([(16, 200, 5), (64, 500, 8), (256, 2048, 9), (100, 900, 17)]))
@settings(max_examples=150, deadline=None)
def test_fast_cuts_are_those_of_a_loop(n, seed, params):
    data = np.random.default_rng(seed).integers(0, 4 if seed % 2 else 256, n).astype(np.uint8)
    assert C.fast_cuts(data, *params) == plain_fast(data.tolist(), *params)


@given(st.integers(0, 3000), st.integers(0, 10**6), st.sampled_from([(16, 32, 200), (64, 128, 700), (4, 1 << 17, 500)]))
@settings(max_examples=150, deadline=None)
def test_rabin_cuts_are_those_of_a_loop(n, seed, params):
    data = np.random.default_rng(seed).integers(0, 4 if seed % 2 else 256, n).astype(np.uint8)
    assert C.rabin_cuts(data, *params) == plain_rabin(data.tolist(), *params)


@given(st.binary(max_size=400))
@settings(max_examples=200, deadline=None)
def test_the_polynomial_takes_every_byte(data):
    h = 0
    for byte in data:
        h = (h * C.POLY_BASE + byte) % C.POLY_PRIME
    assert C.polynomial(data) == h


def test_parts_bear_their_bytes(spark):
    raw = [b"", bytes(range(256)) * 20, "Wörter ".encode() * 300, None]
    rows = spark.createDataFrame([(i, None if r is None else bytearray(r)) for i, r in enumerate(raw)], "file_id int, text binary")
    for rule, params in (("fast", {"shortest": 64, "longest": 500, "bits": 8}), ("rabin", {"shortest": 64, "mean": 128, "longest": 700})):
        got = C.content_parts(rows, rule, **params).orderBy("file_id", "chunk_index").collect()
        for i, r in enumerate(raw):
            mine = [p for p in got if p["file_id"] == i]
            assert b"".join(bytes(p["content"]) for p in mine) == (r or b"")
            assert all(p["fp"] == hashlib.sha256(p["content"]).hexdigest() and p["size"] == len(p["content"]) for p in mine)
    bare = C.content_chunks(rows, "fast", shortest=64, longest=500, bits=8)
    assert bare.columns == ["file_id", "chunk_index", "offset", "size", "fp"]


def test_the_smallest_codec_of_each_file(spark):
    texts = ["a" * 5000, "".join(chr(33 + i * 7 % 90) for i in range(3000)), "", None]
    files = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    sizes = {(r["file_id"], r["codec"]): r["bytes"] for r in R.codec_sizes(files).collect()}
    for i, t in enumerate(texts):
        raw = None if t is None else t.encode()
        want = {"gzip": lambda b: gzip.compress(b, 6, mtime=0), "bzip2": lambda b: bz2.compress(b, 9), "xz": lambda b: lzma.compress(b, preset=6)}
        assert {c: sizes[i, c] for c in want} == {c: None if raw is None else len(f(raw)) for c, f in want.items()}
    best = {r["file_id"]: (r["bytes"], r["codec"]) for r in R.best_codec(R.codec_sizes(files).where("bytes is not null")).collect()}
    assert best == {i: min((sizes[i, c], c) for c in ("gzip", "bzip2", "xz")) for i in range(3)}


def test_tiers_keep_contents_by_their_codec(spark):
    rows = spark.createDataFrame([(f"f{i}", t, bytearray(b"content " * i)) for i, t in enumerate(["hot", "warm", "cold", "other", None])] + [("null", "warm", None)], "fp string, tier string, content binary")
    blobs = R.tier_blobs(rows)
    assert {(r["fp"], r["codec"]) for r in blobs.collect()} == {("f0", "none"), ("f1", "zstd"), ("f2", "xz9"), ("f3", "none"), ("f4", "none"), ("null", "zstd")}
    assert {r["fp"]: None if r["content"] is None else bytes(r["content"]) for r in R.tier_contents(blobs).collect()} == {**{f"f{i}": b"content " * i for i in range(5)}, "null": None}
    damaged = blobs.withColumn("checksum", F.lit("other"))
    assert {r["content"] for r in R.tier_contents(damaged).collect()} == {None}


@pytest.mark.parametrize("form", ["tar", "tar.gz", "zip", "raw"])
def test_exports_come_back(spark, form):
    files = {f"d{i % 3}/ä{i}": bytes([i]) * (i * 40) for i in range(30)}
    rows = spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()] + [("null", None)], "path string, content binary").repartition(3)
    boxes = R.exported(rows, form, part_bytes=3000)
    assert boxes.count() > 3
    assert {r["path"]: bytes(r["content"]) for r in R.imported(boxes, form).collect()} == files | {"null": b""}
    assert R.imported(R.exported(rows.limit(0), form), form).count() == 0
    with pytest.raises(ValueError):
        R.exported(rows, "rar")


def test_reports_are_written_in_each_form(spark, tmp_path):
    rows = spark.createDataFrame([("a<b>&", 5, None), ("c", 123, "2025")], "name string, n long, first string")
    want = {
        "json": ['{"name":"a<b>&","n":5}', '{"name":"c","n":123,"first":"2025"}'],
        "text": [f"{'a<b>&':20}{5:>12}  ", f"{'c':20}{123:>12}  2025"],
        "html": ["<tr><td>a&lt;b&gt;&amp;</td><td>5</td><td></td></tr>", "<tr><td>c</td><td>123</td><td>2025</td></tr>"],
    }
    for form, lines in want.items():
        sinks.export_report(rows, str(tmp_path / form), form)
        assert sorted(r["value"] for r in spark.read.text(str(tmp_path / form)).collect()) == sorted(lines)
    with pytest.raises(ValueError):
        sinks.export_report(rows, str(tmp_path / "pdf"), "pdf")


def test_a_small_file_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "state.json")
    store = Store(spark, path)
    for text in ("first", "second, longer", "ü"):
        store.replace(path, text)
        assert store.read(path) == text
    assert [n for n in store.names(str(tmp_path)) if not n.startswith(".")] == ["state.json"]


def test_orders_and_hours(spark):
    tiers = spark.createDataFrame([("hot",), ("warm",), ("cold",), ("none",), (None,)], "t string")
    assert [r[0] for r in tiers.select(T.next_colder(F.col("t"))).collect()] == ["warm", "cold", None, None, None]
    rows = V.by_hour(spark.range(25).withColumn("hour", F.col("id")), "hour", V.DEFAULT_RULES["indoor"]).orderBy("id").collect()
    assert [(r["priority"], r["reason"]) for r in rows] == [("high", "night")] * 8 + [("medium", "business_hours")] * 14 + [("high", "night")] * 2 + [(None, None)]
    assert S.CATEGORIES


def test_queries_run_by_name(spark, small, tmp_path, capsys):
    from lodestore.__main__ import main

    assert main(["list"]) == 0 and "agg_dup_groups" in capsys.readouterr().out.split()
    assert main(["run", "no_such_query", "--data", small]) == 2
    assert main(["run", "agg_storage_stats", "--data", small, "--out", str(tmp_path / "out"), "--format", "json"], spark) == 0
    assert spark.read.json(str(tmp_path / "out")).count() > 0


def test_handlers_leave_no_row_out(spark):
    from lodestore.operators import ops as O

    handlers = O.Handlers("kind")
    handlers.register("a", lambda rows: rows.withColumn("x", F.lit(1)))
    with pytest.raises(ValueError):
        handlers.register("a", lambda rows: rows)
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "kind string")
    assert sorted(map(tuple, handlers.run(rows).select("kind", "x", "problem").collect()), key=str) == [("a", 1, None), ("b", None, "no handler"), (None, None, "no handler")]


def test_neighbours_over_spans(spark):
    frames = [(c, f, f * 10 + c) for c in (1, 2) for f in (0, 1, 2, 5, 6, 13, 14, 30)]
    rows = spark.createDataFrame(frames, "camera int, frame int, v int")
    both = V.with_neighbour(V.with_neighbour(rows, "v", "before", span=3), "v", "after", after=True, span=4).collect()
    for r in both:
        own = sorted(v for c, _, v in frames if c == r["camera"])
        at = own.index(r["v"])
        assert r["before"] == (own[at - 1] if at else None) and r["after"] == (own[at + 1] if at + 1 < len(own) else None)
