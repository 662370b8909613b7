"""Scans of mounted trees by frontier, snapshots of them, and the changes between snapshots as a stream.

One level of folders is listed at a time, all folders of a level in parallel; folders
that a scan skips are never opened.  A level is written before the next begins.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .mounted import digest, local_path, skipped
from .shared import Store, shared_folder

_ENTRY = "kind string, path string, name string, size long, mtime_ns long, device long, inode long, links long, error string"
_NAMES = [c.split()[0] for c in _ENTRY.split(", ")]
_TYPES = [pa.string() if c.endswith("string") else pa.int64() for c in _ENTRY.split(", ")]
ROWS = 4096


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _listed(exclude: str | None):
    """Entries of folders, those of a large one in several batches."""

    def entry(e: os.DirEntry) -> tuple | None:
        try:
            if e.is_dir(follow_symlinks=False):
                return None if skipped(e.name) or e.path == exclude else ("folder", e.path, e.name, *[None] * 6)
            info = e.stat(follow_symlinks=False)
            if not stat.S_ISREG(info.st_mode):
                # links to folders are passed over, like folders that are skipped
                return None if e.is_dir() else ("error", e.path, e.name, *[None] * 5, "no regular file")
            return ("file", e.path, e.name, info.st_size, info.st_mtime_ns, info.st_dev, info.st_ino, info.st_nlink, None)
        except OSError as error:
            return ("error", e.path, e.name, *[None] * 5, str(error))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for folder in batch.column(0).to_pylist():
                try:
                    with os.scandir(folder) as entries:
                        for e in entries:
                            if (row := entry(e)) is not None:
                                rows.append(row)
                            if len(rows) >= ROWS:
                                yield _rows(rows)
                                rows = []
                except OSError as error:
                    rows.append(("error", folder, os.path.basename(folder), *[None] * 5, str(error)))
            if rows:
                yield _rows(rows)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of files (path, size, mtime_ns, inode), or why there is none: a file must stay as it was while it is read."""
    for batch in batches:
        paths, sizes, times, inodes = (batch.column(i).to_pylist() for i in range(4))
        out = []
        for path, *before in zip(paths, sizes, times, inodes, strict=True):
            try:
                sha, info = digest(path), os.lstat(path)
                same = [info.st_size, info.st_mtime_ns, info.st_ino] == before
                out.append((path, sha if same else None, None if same else "changed while it was read"))
            except OSError as error:
                out.append((path, None, str(error)))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["path", "sha256", "error"])


@dataclass
class Report:
    """``files``: path (relative to the root), name, size, mtime_ns, links, hardlink_of and sha256; ``errors``: path, error; whether all of the tree was seen."""

    files: DataFrame
    errors: DataFrame
    complete: bool
    levels: int


def scan_tree(spark: SparkSession, root: str, exclude: str | None = None, most: int | None = None, hashed: bool = True) -> Report:
    """Scan a mounted folder.

    Links are not followed; a link to a file is an error, as is what can't be opened or
    changes while it is hashed.  ``exclude`` is a folder that is passed over; a root
    within it is refused.  With ``most``, no further level is listed once that many files
    are found, and the report is not complete.  Of the paths of one file the first by name
    is no hard link, the others say which it is.
    """
    root = os.path.abspath(local_path(root))
    exclude = os.path.abspath(local_path(exclude)) if exclude else None
    if exclude and (root + "/").startswith(exclude + "/"):
        raise ValueError("the root is excluded")
    if not os.path.isdir(root):
        raise ValueError("the root is no folder")
    out = shared_folder(spark, "scan")
    frontier = spark.createDataFrame([(root,)], "path string")
    found, level, complete, folders = 0, 0, True, 1
    while folders:
        listed = frontier.repartition(max(1, min(folders, 4096))) if folders > 1 else frontier
        listed.mapInArrow(_listed(exclude), _ENTRY).write.parquet(f"{out}/level={level}")
        entries = spark.read.schema(_ENTRY).parquet(f"{out}/level={level}")
        told = entries.agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "folder").alias("folders")).first()
        found, folders, level = found + told["files"], told["folders"], level + 1
        if most is not None and found >= most and folders:
            complete = False
            break
        frontier = entries.where("kind = 'folder'").select("path")
    entries = spark.read.schema(_ENTRY).parquet(*[f"{out}/level={i}" for i in range(level)])
    files, errors = entries.where("kind = 'file'").drop("kind", "error"), entries.where("kind = 'error'").select("path", "error")
    relative = F.substring("path", len(root.rstrip("/")) + 2, 1 << 20)
    firsts = files.where("links > 1").groupBy("device", "inode").agg(F.min("path").alias("first"))
    files = files.join(firsts, ["device", "inode"], "left").withColumn("hardlink_of", F.when(F.col("first") != F.col("path"), F.col("first")))
    if hashed:
        sums = files.select("path", "size", "mtime_ns", "inode").repartition(max(1, min(found // 64 + 1, 4096))).mapInArrow(_hashed, "path string, sha256 string, error string")
        sums.write.parquet(f"{out}/sums")
        sums = spark.read.schema("path string, sha256 string, error string").parquet(f"{out}/sums")
        errors = errors.unionByName(sums.where("error is not null").select("path", "error"))
        files = files.join(sums.where("error is null").drop("error"), "path")
    else:
        files = files.withColumn("sha256", F.lit(None).cast("string"))
    to_relative = F.substring("hardlink_of", len(root.rstrip("/")) + 2, 1 << 20)
    files = files.select(relative.alias("path"), "name", "size", "mtime_ns", "links", to_relative.alias("hardlink_of"), "sha256")
    return Report(files, errors.select(relative.alias("path"), "error"), complete, level)


# Changes.

#: Parts of a snapshot; a change stream has as many tasks a batch.
BUCKETS = 16
FORMAT = "lodestore_changes"


def take_snapshot(spark: SparkSession, root: str, state: str, buckets: int = BUCKETS) -> int:
    """List a mounted folder and add the listing to ``state`` as its next generation; returns its number, from 1.

    The listing is written first and its marker last, under a number that no other
    writer has.  A listing that is not complete is refused.
    """
    store, listing = Store(spark, state), f"{state.rstrip('/')}/listings"
    report = scan_tree(spark, root, hashed=False)
    written = f"{listing}/{os.path.basename(shared_folder(spark, 'listing'))}"
    rows = report.files.select("path", "size", "mtime_ns", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket"))
    rows.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(written)
    number = len(generations(store, state)) + 1
    while not store.create(f"{state.rstrip('/')}/generations/{number:09d}.json", json.dumps({"listing": written, "buckets": buckets})):
        number += 1
    return number


def generations(store: Store, state: str) -> list[str]:
    return [n for n in store.names(f"{state.rstrip('/')}/generations") if n.endswith(".json")]


class Between(InputPartition):
    """One bucket of two generations."""

    def __init__(self, bucket: int, before: str | None, after: str, generation: int):
        self.bucket, self.before, self.after, self.generation = bucket, before, after, generation


class TreeChanges(DataSource):
    """What was created, modified and deleted between the snapshots in ``path``; offsets are generations."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "generation long, kind string, path string, size long"

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(local_path(self.options["path"]))


class ChangeReader(DataSourceStreamReader):
    """Snapshots never change, so a batch that is read again gives the same rows."""

    def __init__(self, state: str):
        self.state = state

    def initialOffset(self) -> dict:
        return {"generation": 0}

    def latestOffset(self) -> dict:
        folder = os.path.join(self.state, "generations")
        names = [n for n in os.listdir(folder) if n.endswith(".json") and not n.startswith(".")] if os.path.isdir(folder) else []
        return {"generation": max((int(n[:9]) for n in names), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for g in range(start["generation"] + 1, end["generation"] + 1):
            after = self._marker(g)
            before = self._marker(g - 1)["listing"] if g > 1 else None
            out += [Between(b, before, after["listing"], g) for b in range(after["buckets"])]
        return out

    def _marker(self, generation: int) -> dict:
        with open(os.path.join(self.state, "generations", f"{generation:09d}.json")) as said:
            return json.load(said)

    def read(self, partition: Between) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        def held(listing: str | None) -> dict[str, tuple[int, int]]:
            folder = os.path.join(local_path(listing), f"bucket={partition.bucket}") if listing else ""
            if not os.path.isdir(folder):
                return {}
            tables = [pq.ParquetFile(os.path.join(folder, n)).read() for n in sorted(os.listdir(folder)) if n.endswith(".parquet")]
            return {p: (s, m) for t in tables for p, s, m in zip(*(t.column(c).to_pylist() for c in ("path", "size", "mtime_ns")), strict=True)}

        before, after = held(partition.before), held(partition.after)
        rows = [("deleted", p, before[p][0]) for p in before.keys() - after.keys()]
        rows += [("created" if p not in before else "modified", p, v[0]) for p, v in after.items() if before.get(p) != v]
        rows.sort()
        if rows:
            kinds, paths, sizes = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([partition.generation] * len(rows), pa.int64()), pa.array(kinds), pa.array(paths), pa.array(sizes, pa.int64())], ["generation", "kind", "path", "size"])

    def commit(self, end: dict) -> None:
        """Snapshots are kept; who takes them decides how long."""


def changes(spark: SparkSession, state: str) -> DataFrame:
    """A stream of generation, kind (created, modified, deleted), path and size."""
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format(FORMAT).option("path", state).load()
