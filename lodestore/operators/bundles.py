"""Bundles: distinct contents packed into containers, with a manifest and a receipt.

A bundle is a folder named by its manifest's digest.  Distinct contents are dealt into
parts by the leading digits of their digest, so a part holds a range of digests and
about PART_BYTES, and lie there one after another.  A part is cut into segments, each
compressed under every codec; the codec with the fewest bytes over the whole set stays.
A segment's row tells which bytes of which contents it holds, so reading one content
opens only its segments.

Everything is written below a pending name first.  The folder gets its own name when all
parts and the manifest are there, and the receipt is written into it last: a folder
without a receipt is no bundle.  A run that finds a receipt verifies and reuses the bundle.
"""

from __future__ import annotations

import json
import math
import uuid
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources.shared import Store, shared_folder
from . import archive as A
from .chunking import content_parts

#: Bytes of a part and of a segment, before compression.
PART_BYTES, SEGMENT_BYTES = 64 << 20, 1 << 20
#: Segments that a task packs, on average.
TASK_SEGMENTS = 8
_ENTRY = "array<struct<sha256:string,begin:long,at:int,length:int>>"
_SEGMENT = f"part int, segment int, codec string, raw_bytes long, packed_bytes long, entries {_ENTRY}, data binary"


class Refused(ValueError):
    """A bundle that is not written, or one that is not to be trusted."""


def whole_contents(files: DataFrame) -> DataFrame:
    """Each file of ``files(path, content)`` as one piece: path, k, fp, content. Empty files have none."""
    return files.where(F.octet_length("content") > 0).select("path", F.lit(0).cast("long").alias("k"), F.sha2("content", 256).alias("fp"), "content")


def chunked_contents(files: DataFrame, strategy: str = "rabin", **params: int) -> DataFrame:
    """Each file cut into content-defined chunks: path, k, fp, content."""
    cut = content_parts(files.select(F.col("path").alias("file_id"), F.col("content").alias("text")), strategy, **params)
    return cut.select(F.col("file_id").alias("path"), F.col("chunk_index").alias("k"), "fp", "content")


def _first(problems: DataFrame, what: str) -> None:
    # all parts are looked at in one go; a limit asks a few, then a few more
    found = problems.agg(F.count(F.lit(1)).alias("n"), F.min(problems.columns[0]).alias("first")).first()
    if found["n"]:
        raise Refused(f"{what}: {found['first']}")


def check_paths(files: DataFrame) -> None:
    """Refuse paths that are unsafe, named twice whatever their case, or folders of other paths."""
    _first(files.where(~F.coalesce(S.safe_relative(F.col("path")), F.lit(False))).select("path"), "unsafe path")
    folded = files.select(F.lower("path").alias("path"))
    _first(folded.groupBy("path").count().where("count > 1"), "path named twice")
    parts = F.split("path", "/")
    above = folded.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path"), F.size(parts).alias("n"))
    _first(folded.join(above.where("n > 1").distinct(), "path", "left_semi"), "path is a folder too")


def _unchanged() -> Column:
    return F.coalesce((F.octet_length("content") == F.col("size")) & (F.sha2("content", 256) == F.col("sha256")), F.lit(False))


def check_files(files: DataFrame) -> None:
    """Refuse what :func:`check_paths` refuses, and contents that are not what ``files(path, size, sha256, content)`` says."""
    check_paths(files)
    check_sources(files)


def check_sources(files: DataFrame) -> None:
    """Refuse contents that changed since ``files(path, size, sha256, content)`` was listed."""
    _first(files.where(~_unchanged()).select("path"), "file has changed")


def identifier(files: DataFrame, pieces: DataFrame, kind: str) -> str:
    """What names the bundle: a digest of its files and pieces, whatever their order, added up on the executors."""
    rows = files.select(F.sha2(F.concat_ws("\0", F.lit("f"), "path", F.col("size").cast("string"), "sha256"), 256).alias("d"))
    rows = rows.unionByName(pieces.select(F.sha2(F.concat_ws("\0", F.lit("p"), "path", F.col("k").cast("string"), "fp"), 256).alias("d")))
    words = [F.sum(F.conv(F.substring("d", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    told = rows.agg(F.count(F.lit(1)).cast("string"), *words).first()
    return sha256("\0".join([kind, *(x or "0" for x in told)]).encode()).hexdigest()[:32]


def _slices(contents: DataFrame, placed: DataFrame, segment_bytes: int) -> DataFrame:
    """``contents(fp, content)`` cut where segments end: part, segment, sha256, begin, at, bytes. ``placed(fp, part, start, n)`` says where a content lies in its part."""
    first, last = F.floor(F.col("start") / segment_bytes), F.floor((F.col("start") + F.col("n") - 1) / segment_bytes)
    rows = contents.join(placed, "fp").select("part", "fp", "start", "n", "content", F.explode(F.sequence(first, last)).alias("segment"))
    edge = F.col("segment") * segment_bytes
    begin, end = F.greatest(F.lit(0), edge - F.col("start")), F.least(F.col("n"), edge + segment_bytes - F.col("start"))
    taken = F.substring("content", (begin + 1).cast("int"), (end - begin).cast("int"))
    return rows.select("part", F.col("segment").cast("int").alias("segment"), F.col("fp").alias("sha256"), begin.alias("begin"), (F.col("start") + begin - edge).cast("int").alias("at"), taken.alias("bytes"))


def _packed(codecs: tuple[str, ...]):
    """A segment under every codec, from its slices (part, segment, sha256, begin, at, bytes)."""
    entry = pa.struct([("sha256", pa.string()), ("begin", pa.int64()), ("at", pa.int32()), ("length", pa.int32())])
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("codec", pa.string()), ("raw_bytes", pa.int64()), ("packed_bytes", pa.int64()), ("entries", pa.list_(entry)), ("data", pa.binary())])

    def run(slices: pa.Table) -> pa.Table:
        slices = slices.sort_by("at")
        held = slices.column("bytes").to_pylist()
        whole = b"".join(held)
        entries = [{"sha256": fp, "begin": begin, "at": at, "length": len(x)} for fp, begin, at, x in zip(*(slices.column(c).to_pylist() for c in ("sha256", "begin", "at")), held, strict=True)]
        made = [A.CODECS[c][0](whole) for c in codecs]
        n = len(codecs)
        columns = [[slices["part"][0].as_py()] * n, [slices["segment"][0].as_py()] * n, list(codecs), [len(whole)] * n, [len(m) for m in made], [entries] * n, made]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def create(files: DataFrame, root: str, chunks: str | None = None, codecs: tuple[str, ...] = ("gzip", "bzip2", "xz"), part_bytes: int = PART_BYTES, segment_bytes: int = SEGMENT_BYTES, **params: int) -> dict:
    """Write ``files(path, size, sha256, content)`` as a bundle below ``root``; returns its receipt.

    ``chunks`` names a rule that cuts contents (see :func:`chunked_contents`); without
    one, contents are whole.  Refused are no files, what :func:`check_files` refuses, files
    that change while they are packed, and a bundle that with its manifest and receipt is
    not smaller than the files.  Then nothing is left behind, and sources are never changed.
    A bundle that is there already is verified and comes back with ``reused``.
    """
    spark = files.sparkSession
    store = Store(spark, root)
    pieces = chunked_contents(files, chunks, **params) if chunks else whole_contents(files)
    work = f"{root.rstrip('/')}/pending-{uuid.uuid4().hex}"
    try:
        # contents are read for the list of files, the list of pieces, the container and a last check; all else reads the lists
        files.select("path", "size", "sha256", _unchanged().alias("good")).write.parquet(f"{work}/files")
        seen = spark.read.schema("path string, size long, sha256 string, good boolean").parquet(f"{work}/files")
        check_paths(seen)
        _first(seen.where("not good").select("path"), "file has changed")
        seen.drop("good").write.parquet(f"{work}/manifest/files")
        named = spark.read.schema("path string, size long, sha256 string").parquet(f"{work}/manifest/files")
        total = named.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
        if not total["n"]:
            raise Refused("no files")
        pieces.select("path", "k", "fp", F.octet_length("content").cast("long").alias("n")).write.parquet(f"{work}/pieces")
        measured = spark.read.schema("path string, k long, fp string, n long").parquet(f"{work}/pieces")
        measured.select("path", "k", "fp").write.parquet(f"{work}/manifest/pieces")
        listed = spark.read.schema("path string, k long, fp string").parquet(f"{work}/manifest/pieces")
        name = identifier(named, listed, chunks or "whole")
        target = f"{root.rstrip('/')}/{name}"
        if store.exists(f"{target}/receipt.json"):
            _first(inspect(spark, target).select(F.concat_ws(" ", "problem", "subject")), "bundle is damaged")
            return json.loads(store.read(f"{target}/receipt.json")) | {"reused": True}
        parts = max(1, math.ceil((total["bytes"] or 0) / part_bytes))
        # digests are spread evenly, so their leading digits deal them into ranges of about one size
        part = F.floor(F.conv(F.substring("fp", 1, 8), 16, 10).cast("long") * parts / 4294967296).cast("int")
        sizes = measured.groupBy("fp").agg(F.max("n").alias("n")).select(part.alias("part"), "fp", "n")
        before = F.sum("n").over(Window.partitionBy("part").orderBy("fp").rowsBetween(Window.unboundedPreceding, -1))
        placed = sizes.withColumn("start", F.coalesce(before, F.lit(0)))
        once = pieces.groupBy("fp").agg(F.min("content").alias("content"))
        # a task packs a few segments, and holds one
        tasks = max(1, math.ceil((total["bytes"] or 0) / (TASK_SEGMENTS * segment_bytes)))
        dealt = _slices(once, placed, segment_bytes).repartition(tasks, "part", "segment")
        dealt.groupBy("part", "segment").applyInArrow(_packed(codecs), _SEGMENT).write.partitionBy("codec").option("compression", "uncompressed").parquet(f"{work}/data")
        store.delete(f"{work}/files")
        store.delete(f"{work}/pieces")
        segments = spark.read.schema(_SEGMENT).parquet(f"{work}/data")
        trials = {r["codec"]: r["bytes"] for r in segments.groupBy("codec").agg(F.sum("packed_bytes").alias("bytes")).collect()}  # a row a codec
        codec = min(codecs, key=lambda c: (trials.get(c, 0), codecs.index(c)))
        for other in codecs:
            if other != codec:
                store.delete(f"{work}/data/codec={other}")
        _first(inspect(spark, work).select(F.concat_ws(" ", "problem", "subject")), "bundle is damaged")
        check_sources(files)
        counts = listed.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fp").alias("contents")).first()
        unique = segments.where(F.col("codec") == codec).agg(F.sum("raw_bytes")).first()[0] or 0
        receipt = {
            "id": name, "kind": chunks or "whole", "codec": codec, "trials": trials, "file_count": total["n"], "pieces": counts["n"], "unique_contents": counts["contents"],
            "original_bytes": total["bytes"] or 0, "unique_bytes": unique, "dedup_bytes": (total["bytes"] or 0) - unique, "archive_bytes": store.size(f"{work}/data"),
            "manifest_bytes": store.size(f"{work}/manifest"), "parts": parts, "verified": True, "reused": False, "source_deleted": False,
        }
        receipt["net_bytes"] = receipt["original_bytes"] - receipt["archive_bytes"] - receipt["manifest_bytes"] - len(json.dumps(receipt))
        if receipt["net_bytes"] <= 0:
            raise Refused("nothing would be gained")
        if not store.rename(work, target) and not store.exists(f"{target}/receipt.json"):
            # another writer's folder that has no receipt was never finished
            store.delete(target)
            if not store.rename(work, target):
                raise Refused(f"{target} is being written")
        if not store.create(f"{target}/receipt.json", json.dumps(receipt)):
            return json.loads(store.read(f"{target}/receipt.json")) | {"reused": True}
        return receipt
    finally:
        store.delete(work)


def contents_of(spark: SparkSession, bundle: str) -> DataFrame:
    """Where a bundle's distinct contents lie: part, sha256, offset (in the part) and length."""
    segments = spark.read.schema(_SEGMENT).parquet(f"{bundle}/data")
    # all segments of a part but its last hold the same number of bytes
    size = segments.groupBy("part").agg(F.max("raw_bytes").alias("step"))
    rows = segments.join(size, "part").select("part", (F.col("segment") * F.col("step")).alias("start"), F.explode("entries").alias("e"))
    return rows.groupBy("part", "e.sha256").agg(F.min(F.col("start") + F.col("e.at")).alias("offset"), F.sum("e.length").cast("long").alias("length"))


def _unpack(prove: bool):
    """The pieces of contents (sha256, begin, n, bytes) in a segment (codec, raw_bytes, entries, data), and none if it can't be read; with ``prove``, one that is a whole content by its digest comes without bytes."""
    schema = pa.schema([("sha256", pa.string()), ("begin", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())])

    def run(segments: pa.Table) -> pa.Table:
        found = []
        for codec, raw_bytes, entries, data in zip(*(segments.column(c) for c in ("codec", "raw_bytes", "entries", "data")), strict=True):
            try:
                raw = A.CODECS[codec.as_py()][1](data.as_py())
            except Exception:  # noqa: BLE001  codecs raise errors of many kinds; what is missing is reported
                continue
            if len(raw) == raw_bytes.as_py():
                fps, begins, ats, ns = (entries.values.field(c).to_pylist() for c in ("sha256", "begin", "at", "length"))
                cut = [raw[at : at + n] for at, n in zip(ats, ns, strict=True)]
                if prove:
                    cut = [None if begin == 0 and sha256(x).hexdigest() == fp else x for fp, begin, x in zip(fps, begins, cut, strict=True)]
                found.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((fps, begins, ns, cut), schema, strict=True)], schema=schema))
        return pa.Table.from_batches(found, schema)

    return run


def _opened(segments: DataFrame, prove: bool = False) -> DataFrame:
    # a worker holds one segment; a batch of rows would hold tens of megabytes of them
    return segments.select("part", "segment", "codec", "raw_bytes", "entries", "data").groupBy("part", "segment").applyInArrow(_unpack(prove), "sha256 string, begin long, n long, bytes binary")


def _joined(parts: Column, name: str) -> Column:
    """The bytes ``name`` of an array of structs, one after another; one alone is not copied."""
    several = F.unhex(F.array_join(F.transform(parts[name], F.hex), ""))
    return F.when(F.size(parts) == 1, parts[0][name]).otherwise(several)


def blobs(spark: SparkSession, bundle: str, wanted: DataFrame | None = None) -> DataFrame:
    """fp and content of a bundle's distinct contents, each checked against its digest; ``wanted(fp)`` opens only segments that hold some of them."""
    segments = spark.read.schema(_SEGMENT).parquet(f"{bundle}/data")
    if wanted is not None:
        holds = segments.select("part", "segment", F.explode("entries.sha256").alias("fp")).join(wanted, "fp", "left_semi").select("part", "segment").distinct()
        segments = segments.join(holds, ["part", "segment"], "left_semi")
    cut = _opened(segments)
    if wanted is not None:
        cut = cut.join(wanted.select(F.col("fp").alias("sha256")), "sha256", "left_semi")
    whole = cut.groupBy("sha256").agg(F.array_sort(F.collect_list(F.struct("begin", "bytes"))).alias("p"))
    return whole.select(F.col("sha256").alias("fp"), _joined(F.col("p"), "bytes").alias("content")).where(F.sha2("content", 256) == F.col("fp"))


def inspect(spark: SparkSession, bundle: str) -> DataFrame:
    """What is wrong with a bundle, as rows (problem, subject): contents that are missing or damaged, unused ones, and files that can't be put together."""
    pieces = spark.read.schema("path string, k long, fp string").parquet(f"{bundle}/manifest/pieces")
    files = spark.read.schema("path string, size long, sha256 string").parquet(f"{bundle}/manifest/files")
    # contents are opened once, and only those that lie in several segments are put together; three questions are asked of what was found
    cut = _opened(spark.read.schema(_SEGMENT).parquet(f"{bundle}/data"), prove=True)
    found = cut.groupBy("sha256").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("begin", "bytes"))).alias("p"))
    proved = (F.size("p") == 1) & F.col("p")[0]["bytes"].isNull()
    path = shared_folder(spark, "there")
    found.where(proved | (F.sha2(_joined(F.col("p"), "bytes"), 256) == F.col("sha256"))).select(F.col("sha256").alias("fp"), "n").write.parquet(path)
    there = spark.read.schema("fp string, n long").parquet(path)
    needed = pieces.select("fp").distinct()
    missing = needed.join(there, "fp", "left_anti").select(F.lit("missing").alias("problem"), F.col("fp").alias("subject"))
    unused = there.join(needed, "fp", "left_anti").select(F.lit("unused").alias("problem"), F.col("fp").alias("subject"))
    sizes = pieces.join(there, "fp").groupBy("path").agg(F.sum("n").alias("n"))
    short = files.join(sizes, "path", "left").where(F.coalesce("n", F.lit(0)) != F.col("size")).select(F.lit("size").alias("problem"), F.col("path").alias("subject"))
    return missing.unionByName(unused).unionByName(short)


def restore(spark: SparkSession, bundle: str, paths: DataFrame | None = None) -> DataFrame:
    """path, size, sha256 and content of a bundle's files, or of ``paths(path)``.

    Refused are a folder without a receipt, a path that the bundle does not hold, and a
    bundle whose files can't be put together; a content is only given if its digest is right.
    """
    if not Store(spark, bundle).exists(f"{bundle}/receipt.json"):
        raise Refused("no bundle")
    files = spark.read.schema("path string, size long, sha256 string").parquet(f"{bundle}/manifest/files")
    pieces = spark.read.schema("path string, k long, fp string").parquet(f"{bundle}/manifest/pieces")
    wanted = None
    if paths is not None:
        _first(paths.join(files, "path", "left_anti").select("path"), "not in the bundle")
        files, pieces = files.join(paths, "path", "left_semi"), pieces.join(paths, "path", "left_semi")
        wanted = pieces.select("fp").distinct()
    rows = pieces.join(blobs(spark, bundle, wanted), "fp", "left")
    made = rows.groupBy("path").agg(F.bool_and(F.col("content").isNotNull()).alias("whole"), F.array_sort(F.collect_list(F.struct("k", "content"))).alias("p"))
    content = F.when(F.col("size") == 0, F.lit(b"")).when(F.col("whole"), _joined(F.col("p"), "content"))
    out = files.join(made, "path", "left").select("path", "size", "sha256", content.alias("content"))
    good = (F.octet_length("content") == F.col("size")) & (F.sha2("content", 256) == F.col("sha256"))
    return out.withColumn("content", F.when(F.coalesce(good, F.lit(False)), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("can't be restored: "), F.col("path"))).cast("binary")))
