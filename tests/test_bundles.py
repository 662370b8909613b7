"""Bundles: what is written can be read back, and what is refused leaves nothing behind."""

import hashlib
import os
import random

import pytest
from lodestore.operators import bundles as B
from lodestore.sources.shared import Store

FILES = "path string, size long, sha256 string, content binary"


def listed(spark, contents, n=3):
    rows = [(p, len(c), hashlib.sha256(c).hexdigest(), bytearray(c)) for p, c in contents.items()]
    return spark.createDataFrame(rows, FILES).repartition(n)


@pytest.fixture()
def contents():
    rng = random.Random(3)
    words = ["Wörter", "stand", "in", "files", "again", "and", "über"]
    made = {f"dir{i % 4}/file{i}.txt": " ".join(rng.choices(words, k=rng.randint(0, 4000))).encode() for i in range(30)}
    made |= {"copy.txt": made["dir1/file1.txt"], "empty.txt": b"", "bytes.bin": bytes(range(256)) * 300}
    return made


@pytest.fixture()
def root(tmp_path):
    return str(tmp_path / "bundles")


def folders(root):
    return sorted(os.listdir(root)) if os.path.exists(root) else []


@pytest.mark.parametrize(("chunks", "params"), [(None, {}), ("fast", {"shortest": 256, "longest": 2048, "bits": 9}), ("rabin", {"shortest": 512, "mean": 1024, "longest": 8192})])
def test_files_come_back(spark, root, contents, chunks, params):
    receipt = B.create(listed(spark, contents), root, chunks, part_bytes=60_000, segment_bytes=7_001, **params)
    path = f"{root}/{receipt['id']}"
    assert folders(root) == [receipt["id"]] and receipt["parts"] > 3
    assert receipt["trials"][receipt["codec"]] == min(receipt["trials"].values())
    assert receipt["net_bytes"] > 0 and receipt["original_bytes"] == sum(map(len, contents.values()))
    assert os.listdir(f"{path}/data")[0].startswith("codec=") or any(x.startswith("codec=") for x in os.listdir(f"{path}/data"))
    got = {r["path"]: bytes(r["content"]) for r in B.restore(spark, path).collect()}
    assert got == contents
    chosen = spark.createDataFrame([("copy.txt",), ("empty.txt",)], "path string")
    assert {r["path"]: bytes(r["content"]) for r in B.restore(spark, path, chosen).collect()} == {p: contents[p] for p in ("copy.txt", "empty.txt")}
    with pytest.raises(B.Refused):
        B.restore(spark, path, spark.createDataFrame([("nowhere",)], "path string"))
    if not chunks:
        held = B.contents_of(spark, path).orderBy("part", "offset").collect()
        assert {r["sha256"]: r["length"] for r in held} == {hashlib.sha256(c).hexdigest(): len(c) for c in contents.values() if c}
        assert [r["sha256"] for r in held] == sorted(r["sha256"] for r in held)
        at = {}
        for r in held:
            assert r["offset"] == at.get(r["part"], 0)
            at[r["part"]] = r["offset"] + r["length"]


def test_a_second_run_reuses_the_bundle(spark, root, contents):
    first = B.create(listed(spark, contents), root)
    again = B.create(listed(spark, contents, 5), root)
    assert again["reused"] and {**again, "reused": False} == first
    assert len(folders(root)) == 1
    assert B.create(listed(spark, contents), root, "rabin")["id"] != first["id"]


def test_a_changed_file_is_refused(spark, root, contents):
    files = listed(spark, contents)
    changed = files.selectExpr("path", "size", "sha256", "if(path = 'copy.txt', cast('changed' as binary), content) as content")
    with pytest.raises(B.Refused, match="changed"):
        B.create(changed, root)
    assert folders(root) == []


def test_a_damaged_part_is_refused(spark, root, contents):
    receipt = B.create(listed(spark, contents), root, part_bytes=50_000)
    path = f"{root}/{receipt['id']}"
    folder = f"{path}/data/codec={receipt['codec']}"
    part = next(p for p in sorted(os.listdir(folder)) if p.endswith(".parquet"))
    rows = spark.read.parquet(f"{folder}/{part}").collect()
    spark.createDataFrame([r.asDict() | {"data": bytearray(b"broken")} for r in rows], spark.read.parquet(f"{folder}/{part}").schema).coalesce(1).write.parquet(f"{root}/other")
    os.remove(f"{folder}/{part}")
    os.remove(f"{folder}/.{part}.crc")
    (new,) = [x for x in os.listdir(f"{root}/other") if x.endswith(".parquet")]
    os.rename(f"{root}/other/{new}", f"{folder}/{part}")
    assert {r["problem"] for r in B.inspect(spark, path).collect()} == {"missing", "size"}
    with pytest.raises(Exception, match="can't be restored"):
        B.restore(spark, path).collect()
    with pytest.raises(B.Refused, match="damaged"):
        B.create(listed(spark, contents), root, part_bytes=50_000)


def test_no_gain_is_refused(spark, root):
    with pytest.raises(B.Refused, match="gained"):
        B.create(listed(spark, {"random.bin": os.urandom(2048)}), root)
    with pytest.raises(B.Refused, match="no files"):
        B.create(listed(spark, {"a": b"x"}).where("false"), root)
    assert folders(root) == []


@pytest.mark.parametrize("path", ["../escape", "/absolute", "C:/absolute", "file:stream", "a/../../b", ""])
def test_unsafe_paths_are_refused(spark, root, path):
    with pytest.raises(B.Refused):
        B.create(listed(spark, {path: b"x" * 90_000, "good.txt": b"y"}), root)


@pytest.mark.parametrize("paths", [("a/B.txt", "A/b.txt"), ("dir", "dir/file")])
def test_clashing_paths_are_refused(spark, root, paths):
    with pytest.raises(B.Refused):
        B.create(listed(spark, {p: b"x" * 90_000 for p in paths}), root)


def test_a_folder_without_a_receipt_is_no_bundle(spark, root, contents):
    receipt = B.create(listed(spark, contents), root)
    path = f"{root}/{receipt['id']}"
    os.remove(f"{path}/receipt.json")
    with pytest.raises(B.Refused):
        B.restore(spark, path)
    again = B.create(listed(spark, contents), root)
    assert again["id"] == receipt["id"] and not again["reused"] and folders(root) == [receipt["id"]]


def test_small_files_are_created_once(spark, tmp_path):
    store, path = Store(spark, str(tmp_path)), str(tmp_path / "one.json")
    assert store.create(path, "first") and not store.create(path, "second")
    assert store.read(path) == "first" and store.names(str(tmp_path)) == ["one.json"] or ".one.json.crc" in store.names(str(tmp_path))


def test_workers_hold_one_segment(spark, root, monkeypatch, tmp_path):
    """F16, F18: what a packing or opening worker is given is a segment; a whole part came in one batch before."""
    seen = tmp_path / "seen"
    seen.mkdir()

    def told(make):
        def made(*args):
            run, folder = make(*args), str(seen)

            def held(rows):
                with open(f"{folder}/{os.getpid()}", "a") as out:
                    out.write(f"{rows.num_rows} {rows.nbytes}\n")
                return run(rows)

            return held

        return made

    monkeypatch.setattr(B, "_packed", told(B._packed))
    monkeypatch.setattr(B, "_unpack", told(B._unpack))
    files = {f"f{i}": (b"%d " % i) * 2000 for i in range(40)} | {"long": b"a long one, " * 20_000}
    receipt = B.create(listed(spark, files), root, segment_bytes=10_000)
    assert receipt["parts"] == 1
    got = {r["path"]: bytes(r["content"]) for r in B.restore(spark, f"{root}/{receipt['id']}").collect()}
    assert got == files
    held = [tuple(map(int, line.split())) for f in seen.iterdir() for line in f.read_text().splitlines()]
    assert len(held) > 60 and max(n for _, n in held) < 25_000


def test_packing_is_dealt_to_many_tasks(spark, root):
    """one part is packed by several tasks, each a few segments; one task packed it all before."""
    files = {f"f{i}": (b"%d " % i) * 3000 for i in range(40)}
    receipt = B.create(listed(spark, files), root, segment_bytes=5_000)
    path = f"{root}/{receipt['id']}"
    assert receipt["parts"] == 1
    written = spark.read.parquet(f"{path}/data").selectExpr("input_file_name() as f", "segment").collect()
    assert len({r["f"] for r in written}) > 5 and sorted(r["segment"] for r in written) == list(range(len(written)))
    assert B.inspect(spark, path).count() == 0
    assert [x for x in sorted(os.listdir(path)) if not x.startswith(".")] == ["data", "manifest", "receipt.json"]


def test_a_content_that_lies_twice_is_told(spark, root, contents):
    """Contents are proved one by one where they lie; one that is there twice is still no good one."""
    receipt = B.create(listed(spark, contents), root, segment_bytes=7_001)
    path = f"{root}/{receipt['id']}"
    rows = spark.read.schema(B._SEGMENT).parquet(f"{path}/data")
    again = rows.where("segment = 0").selectExpr("part", "1000 as segment", "raw_bytes", "packed_bytes", "entries", "data").collect()
    spark.createDataFrame(again, rows.drop("codec").select("part", "segment", "raw_bytes", "packed_bytes", "entries", "data").schema).write.mode("append").parquet(f"{path}/data/codec={receipt['codec']}")
    assert "missing" in {r["problem"] for r in B.inspect(spark, path).collect()}
