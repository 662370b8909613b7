"""The folder that all machines share, and small files on any store that Spark reaches."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared folder that ``spark.checkpoint.dir`` names; a private one only where one machine does all the work.

    It is for intermediate files, which go when the driver ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="lodestore-")
        spark.conf.set("spark.checkpoint.dir", named)
    path = f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        Store(spark, path).delete(path)
    except Exception:  # noqa: BLE001  the session has ended; nothing is left to talk to
        pass


class Store:
    """Files of the store that a path is on."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf, self._array = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway.new_array
        self.fs = self._path(root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def rename(self, old: str, new: str) -> bool:
        """Whether it was done; never onto what is there."""
        return not self.exists(new) and self.fs.rename(self._path(old), self._path(new))

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a small file that isn't there; False if another writer was first."""
        try:
            stream = self.fs.create(self._path(path), False)
        except Exception as error:  # py4j gives no class of its own for the store's
            if self.exists(path):
                return False
            raise error
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def replace(self, path: str, text: str) -> None:
        """Write a small file under another name and put it in the place of what is there; readers see either whole."""
        work = f"{path}.{uuid.uuid4().hex}"
        self.create(work, text)
        hadoop = self._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(self.fs.getUri(), self._conf)
        options = self._array(hadoop.Options.Rename, 1)
        options[0] = hadoop.Options.Rename.OVERWRITE
        try:
            context.rename(self._path(work), self._path(path), options)
        finally:
            self.delete(work)

    def names(self, path: str) -> list[str]:
        """Names in a folder, in order; none of a folder that isn't there."""
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(path)))

    def size(self, path: str) -> int:
        """Bytes of a file or of all files below a folder."""
        return self.fs.getContentSummary(self._path(path)).getLength()
