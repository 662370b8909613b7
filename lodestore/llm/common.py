"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import math
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as a word everywhere here: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text that one partition of a grouped stage should hold.
TARGET_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share; a private one only where none is named and one machine does all the work."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestore-"))
    return sc._jsc.sc().getCheckpointDir().get()


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # noqa: BLE001  the session has ended; nothing is left to talk to
        pass


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that have ended; for after stages that shuffled whole texts.

    It does so once the driver's JVM has collected them; the last events of a job may
    still hold its plan, hence the second time.
    """
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.2)


class Stored:
    """A DataFrame written to the shared folder and read back, which cuts lineage.

    It survives the loss of any executor.  ``drop()`` removes the files early;
    otherwise they go when the driver ends.  ``tidy`` is for plans that shuffle
    whole texts: their shuffle files go at once.
    """

    def __init__(self, df: DataFrame, name: str, tidy: bool = False):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        if tidy:
            release(self.spark)
        atexit.register(_drop_at_exit, self.spark, self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def stored(df: DataFrame, name: str) -> DataFrame:
    return Stored(df, name).df


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts_for(spark: SparkSession, nbytes: int, target: int = TARGET_BYTES) -> int:
    """Partitions so that each holds about ``target`` bytes; no fewer than the session's, unless these would hold under a megabyte."""
    nbytes = nbytes or 0
    return max(1, math.ceil(nbytes / target), min(shuffle_partitions(spark), math.ceil(nbytes / (1 << 20))))


def null_salt(c: Column) -> Column:
    """Tells rows apart that have no id, so that they are not all dealt to one place; null for the others."""
    return F.when(c.isNull(), F.monotonically_increasing_id())


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(c: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo ``m``; the split into learning and held-out rows."""
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(m))
