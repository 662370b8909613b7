"""Mounted folders as a Spark data source: ``spark.read.format("lodestore_files")``, and the same for writing.

A partition is one folder two levels below the root with all that is below it (the
files beside such folders are partitions of their own).  Filters on the storage (the
first folder of a path) and on the start of a path leave out partitions, and filters on
sizes leave out files before any content is read.

Writers stage a task's files beside the tree and move them in when the task ends; what
a job moved is listed first, so aborting it takes every file back.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, StringStartsWith, WriterCommitMessage

from .files import SKIPPED

FORMAT = "lodestore_files"
_SCHEMA = "storage_id string, path string, name string, size long, mtime_ns long, sha256 string, content binary"
_ARROW = pa.schema([("storage_id", pa.string()), ("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64()), ("sha256", pa.string()), ("content", pa.binary())])
#: Bytes that are read at once, and rows and bytes of contents of a batch.
READ, ROWS, BATCH_BYTES = 1 << 20, 1000, 32 << 20
#: Where writers stage; readers never look into it.
PENDING = ".pending-"


def local_path(path: str) -> str:
    """The path of a mounted folder; other stores can't be opened as files."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"not a mounted folder: {path}")
    return path.removeprefix("file://").removeprefix("file:").rstrip("/") or "/"


def skipped(name: str) -> bool:
    return name in SKIPPED or name.startswith(PENDING)


def digest(path: str) -> str:
    made = sha256()
    with open(path, "rb") as stream:
        while block := stream.read(READ):
            made.update(block)
    return made.hexdigest()


def safe_join(root: str, path: str) -> str:
    """The place of a relative path below ``root``."""
    if not path or path.startswith("/") or any(p in ("", ".", "..") for p in path.split("/")):
        raise ValueError(f"unsafe path: {path}")
    return os.path.join(root, path)


class Folder(InputPartition):
    """A folder, relative to the root, and whether what is below its folders belongs to it."""

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class MountedFiles(DataSource):
    """Options: ``path``; ``hashed`` (true) and ``content`` (false) say what is read of each file."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("files are added, never replaced; write with mode append")
        if [f.name for f in schema.fields] != ["path", "content"]:
            raise ValueError("rows must be (path, content)")
        return BatchWriter(local_path(self.options["path"]))


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = local_path(options["path"])
        self.hashed = options.get("hashed", "true").lower() == "true"
        self.content = options.get("content", "false").lower() == "true"
        self.storages: set[str] | None = None
        self.starts: list[str] = []
        self.least = 0

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take what prunes; a start of a path prunes folders only, so Spark still looks at the rows."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("storage_id",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("storage_id",):
                self._only(set(f.value))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("size",):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            else:
                if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                    self.starts.append(f.value)
                yield f

    def _only(self, storages: set[str]) -> None:
        self.storages = storages if self.storages is None else self.storages & storages

    def _may_hold(self, folder: str) -> bool:
        return all(folder.startswith(s) or s.startswith(folder + "/") or not folder for s in self.starts)

    def partitions(self) -> list[InputPartition]:
        """Two levels are listed here; what is below them is listed by tasks."""
        found = [] if self.storages is not None or not os.path.isdir(self.root) else [Folder("", False)]
        for top in self._folders(""):
            if (self.storages is None or top in self.storages) and self._may_hold(top):
                found.append(Folder(top, False))
                found += [Folder(sub, True) for sub in self._folders(top) if self._may_hold(sub)]
        return [f for f in found if self._may_hold(f.path)]

    def _folders(self, path: str) -> list[str]:
        whole = os.path.join(self.root, path)
        if not os.path.isdir(whole):
            return []
        with os.scandir(whole) as entries:
            return sorted(os.path.join(path, e.name) for e in entries if e.is_dir(follow_symlinks=False) and not skipped(e.name))

    def _entries(self, folder: Folder) -> Iterator[os.DirEntry]:
        todo = [os.path.join(self.root, folder.path)]
        while todo:
            with os.scandir(todo.pop()) as entries:
                for e in entries:
                    if e.is_dir(follow_symlinks=False):
                        if folder.deep and not skipped(e.name):
                            todo.append(e.path)
                    elif e.is_file(follow_symlinks=False):
                        yield e

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for e in self._entries(partition):
            info = e.stat(follow_symlinks=False)
            if info.st_size < self.least:
                continue
            path = os.path.relpath(e.path, self.root)
            content = None
            if self.content:
                with open(e.path, "rb") as stream:
                    content = stream.read()
            sha = (sha256(content).hexdigest() if content is not None else digest(e.path)) if self.hashed else None
            rows.append((path.split("/")[0] if "/" in path else None, path, e.name, info.st_size, info.st_mtime_ns, sha, content))
            held += len(content or b"")
            if len(rows) >= ROWS or held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class Moved(WriterCommitMessage):
    def __init__(self, files: int):
        self.files = files


class FolderWriter(DataSourceWriter):
    """Adds files; one that is there already must have the same content."""

    def __init__(self, root: str):
        self.root, self.work = root, os.path.join(root, PENDING + uuid.uuid4().hex)

    def write(self, iterator: Iterator) -> Moved:
        attempt = os.path.join(self.work, uuid.uuid4().hex)
        os.makedirs(attempt, exist_ok=True)
        paths: list[str] = []
        for row in iterator:
            staged = safe_join(attempt, row["path"])
            safe_join(self.root, row["path"])
            os.makedirs(os.path.dirname(staged), exist_ok=True)
            with open(staged, "xb") as out:
                out.write(row["content"] if row["content"] is not None else b"")
            paths.append(row["path"])
        fresh = [p for p in paths if not self._there(attempt, p)]
        # listed before they are moved, so that an abort finds them
        with open(f"{attempt}.list", "x") as out:
            out.write("\0".join(fresh))
        for p in fresh:
            target = os.path.join(self.root, p)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            try:
                os.link(os.path.join(attempt, p), target)
            except FileExistsError:  # by another attempt at this very task
                self._there(attempt, p)
        shutil.rmtree(attempt)
        return Moved(len(paths))

    def _there(self, attempt: str, path: str) -> bool:
        old, new = os.path.join(self.root, path), os.path.join(attempt, path)
        if not os.path.lexists(old):
            return False
        if os.path.getsize(old) != os.path.getsize(new) or digest(old) != digest(new):
            raise ValueError(f"another file is there: {path}")
        return True

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.work, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for name in os.listdir(self.work) if os.path.isdir(self.work) else []:
            if name.endswith(".list"):
                with open(os.path.join(self.work, name)) as said:
                    for path in filter(None, said.read().split("\0")):
                        if os.path.lexists(whole := os.path.join(self.root, path)):
                            os.unlink(whole)
        shutil.rmtree(self.work, ignore_errors=True)


class BatchWriter(FolderWriter, DataSourceArrowWriter):
    """Takes a content out of its batch when it is written, so that a batch has no second copy."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Moved:
        pairs = (pair for batch in iterator for pair in zip(batch.column("path"), batch.column("content"), strict=True))
        return super().write({"path": path.as_py(), "content": content.as_buffer() if content.is_valid else None} for path, content in pairs)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MountedFiles)


def mounted_files(spark: SparkSession, root: str, hashed: bool = True, content: bool = False) -> DataFrame:
    """Files below a mounted folder: storage_id (its first folder), path, name, size, mtime_ns, sha256 and content, the last two if asked for."""
    register(spark)
    return spark.read.format(FORMAT).option("path", root).option("hashed", str(hashed).lower()).option("content", str(content).lower()).load()


def write_files(rows: DataFrame, root: str) -> None:
    """Write ``rows(path, content)`` as files below a mounted folder; all of them or none."""
    register(rows.sparkSession)
    rows.select("path", "content").write.format(FORMAT).option("path", root).mode("append").save()
