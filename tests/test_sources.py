"""Mounted folders as a source and a sink, scans by frontier, and changes as a stream."""

import hashlib
import os
import stat

import pytest
from pyspark.sql import functions as F

from lodestore.sources import listing as L
from lodestore.sources import mounted as M


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "tree"
    contents = {"top.txt": b"top", "a/one.txt": b"one" * 50, "a/x/two.bin": bytes(range(256)), "a/x/deep/er/three.txt": b"", "b/one.txt": b"one" * 50, "b/y/four.log": b"4" * 5000, ".git/config": b"no", "a/__pycache__/m.pyc": b"no"}
    for path, content in contents.items():
        whole = root / path
        whole.parent.mkdir(parents=True, exist_ok=True)
        whole.write_bytes(content)
    return str(root), {p: c for p, c in contents.items() if ".git" not in p and "__pycache__" not in p}


def test_a_mounted_folder_is_read(spark, tree):
    root, contents = tree
    got = {r["path"]: r for r in M.mounted_files(spark, root, content=True).collect()}
    assert {p: bytes(r["content"]) for p, r in got.items()} == contents
    for p, r in got.items():
        assert r["sha256"] == hashlib.sha256(contents[p]).hexdigest() and r["size"] == len(contents[p])
        assert r["storage_id"] == (p.split("/")[0] if "/" in p else None) and r["name"] == os.path.basename(p)
    bare = M.mounted_files(spark, f"file://{root}", hashed=False).select("sha256", "content").distinct().collect()
    assert [tuple(r) for r in bare] == [(None, None)]


@pytest.mark.parametrize(
    ("where", "parts", "paths"),
    [
        ("storage_id = 'a'", 2, {"a/one.txt", "a/x/two.bin", "a/x/deep/er/three.txt"}),
        ("storage_id in ('b', 'none')", 2, {"b/one.txt", "b/y/four.log"}),
        ("path like 'b/y/%'", 3, {"b/y/four.log"}),
        ("size > 150", 5, {"a/x/two.bin", "b/y/four.log"}),
        ("size >= 150 and storage_id = 'a'", 2, {"a/one.txt", "a/x/two.bin"}),
        ("storage_id = 'a' and storage_id = 'b'", 0, set()),
    ],
)
def test_filters_leave_out_folders(spark, tree, where, parts, paths):
    root, _ = tree
    rows = M.mounted_files(spark, root).where(where)
    assert {r["path"] for r in rows.collect()} == paths
    assert rows.rdd.getNumPartitions() <= max(parts, 1)


def test_pushed_filters_open_no_other_folder(spark, tree):
    root, _ = tree
    reader = M.FolderReader({"path": root})
    left = list(reader.pushFilters([M.EqualTo(("storage_id",), "a"), M.StringStartsWith(("path",), "a/x/deep")]))
    assert [type(f) for f in left] == [M.StringStartsWith]
    assert [(p.path, p.deep) for p in reader.partitions()] == [("a", False), ("a/x", True)]


def test_files_are_written_all_or_none(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"s{i % 3}/d/f{i}", bytearray(b"x" * i)) for i in range(40)], "path string, content binary").repartition(4)
    M.write_files(rows, root)
    assert {r["path"]: r["size"] for r in M.mounted_files(spark, root).collect()} == {f"s{i % 3}/d/f{i}": i for i in range(40)}
    M.write_files(rows, root)  # the same again changes nothing
    assert not [n for n in os.listdir(root) if n.startswith(".")]
    more = rows.select(F.concat(F.lit("new/"), "path").alias("path"), "content")
    for bad in ("../escape", "s1/d/f1", "/abs"):
        clash = more.unionByName(spark.createDataFrame([(bad, bytearray(b"other"))], more.schema))
        with pytest.raises(Exception, match="unsafe path|another file"):
            M.write_files(clash, root)
        assert sorted(os.listdir(root)) == ["s0", "s1", "s2"] or not any(f for _, _, f in os.walk(f"{root}/new"))
        assert M.mounted_files(spark, root).count() == 40


def test_aborting_takes_moved_files_back(tmp_path):
    root = str(tmp_path)
    writer = M.FolderWriter(root)
    message = writer.write(iter([{"path": "a/b", "content": b"1"}, {"path": "c", "content": None}]))
    assert message.files == 2 and os.path.exists(f"{root}/a/b") and os.path.getsize(f"{root}/c") == 0
    writer.abort([message, None])
    assert not [f for _, _, files in os.walk(root) for f in files]


def walked(root):
    """A plain walk: path, size and digest of what a scan should find."""
    out = {}
    for folder, folders, names in os.walk(root):
        folders[:] = [d for d in folders if d not in (".git", ".venv", "__pycache__") and not os.path.islink(os.path.join(folder, d))]
        for n in names:
            p = os.path.join(folder, n)
            if stat.S_ISREG(os.lstat(p).st_mode):
                with open(p, "rb") as f:
                    out[os.path.relpath(p, root)] = (os.path.getsize(p), hashlib.sha256(f.read()).hexdigest())
    return out


def test_a_scan_is_a_walk(spark, tree):
    root, _ = tree
    os.symlink(f"{root}/a/one.txt", f"{root}/a/link")
    os.symlink(f"{root}/a", f"{root}/b/loop")
    os.mkfifo(f"{root}/b/pipe")
    os.link(f"{root}/a/one.txt", f"{root}/b/again.txt")
    report = L.scan_tree(spark, root)
    rows = report.files.collect()
    assert {r["path"]: (r["size"], r["sha256"]) for r in rows} == walked(root)
    assert report.complete and report.levels == 5
    assert {r["path"]: r["hardlink_of"] for r in rows if r["hardlink_of"]} == {"b/again.txt": "a/one.txt"}
    assert {(r["path"], r["error"]) for r in report.errors.collect()} == {("a/link", "no regular file"), ("b/pipe", "no regular file")}
    assert {r["sha256"] for r in L.scan_tree(spark, root, hashed=False).files.collect()} == {None}


def test_excluded_folders_and_roots(spark, tree):
    root, _ = tree
    got = {r["path"] for r in L.scan_tree(spark, root, exclude=f"{root}/a").files.collect()}
    assert got == {"top.txt", "b/one.txt", "b/y/four.log"}
    for bad, kwargs in ((f"{root}/a", {"exclude": f"{root}/a"}), (f"{root}/nowhere", {}), (f"{root}/top.txt", {})):
        with pytest.raises(ValueError):
            L.scan_tree(spark, bad, **kwargs)


def test_a_scan_stops_at_its_cap(spark, tree):
    report = L.scan_tree(spark, tree[0], most=2)
    assert not report.complete and report.levels == 2
    assert {r["path"] for r in report.files.collect()} == {"top.txt", "a/one.txt", "b/one.txt"}
    assert L.scan_tree(spark, tree[0], most=100).complete


def test_what_cannot_be_listed_is_an_error():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["/no/such/folder"])], ["path"])
    (out,) = L._listed(None)(iter([batch]))
    assert out.to_pylist()[0]["kind"] == "error" and "No such" in out.to_pylist()[0]["error"]
    gone = pa.RecordBatch.from_arrays([pa.array(["/no/such/file"]), *[pa.array([1], pa.int64())] * 3], ["path", "size", "mtime_ns", "inode"])
    (out,) = L._hashed(iter([gone]))
    assert out.to_pylist()[0]["sha256"] is None and "No such" in out.to_pylist()[0]["error"]


def test_a_file_that_changes_is_an_error(tree):
    import pyarrow as pa

    path = f"{tree[0]}/top.txt"
    info = os.lstat(path)
    for size, want in ((info.st_size, None), (info.st_size + 1, "changed while it was read")):
        batch = pa.RecordBatch.from_arrays([pa.array([path]), *[pa.array([x], pa.int64()) for x in (size, info.st_mtime_ns, info.st_ino)]], ["path", "size", "mtime_ns", "inode"])
        (out,) = L._hashed(iter([batch]))
        assert out.to_pylist()[0]["error"] == want


def test_changes_come_once_also_after_a_restart(spark, tmp_path, tree):
    root, contents = tree
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    want = {(1, "created", p) for p in contents}

    def drained():
        query = L.changes(spark, state).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        rows = spark.read.schema("generation long, kind string, path string, size long").parquet(f"{out}/rows").collect()
        assert len({tuple(r) for r in rows}) == len(rows)
        return {(r["generation"], r["kind"], r["path"]) for r in rows}

    assert L.take_snapshot(spark, root, state, buckets=3) == 1
    assert drained() == want
    assert drained() == want
    with open(f"{root}/top.txt", "w") as f:
        f.write("longer than before")
    os.remove(f"{root}/b/one.txt")
    os.makedirs(f"{root}/new")
    with open(f"{root}/new/file", "w") as f:
        f.write("x")
    assert L.take_snapshot(spark, root, state, buckets=3) == 2
    os.rename(f"{root}/new/file", f"{root}/new/other")
    assert L.take_snapshot(spark, root, state, buckets=3) == 3
    want |= {(2, "modified", "top.txt"), (2, "deleted", "b/one.txt"), (2, "created", "new/file"), (3, "deleted", "new/file"), (3, "created", "new/other")}
    assert drained() == want
