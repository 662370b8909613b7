"""Archives: codecs, bundles of distinct contents, manifests and their verification."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def xz(level: int) -> Callable[[bytes], bytes]:
    """xz at a level, with a dictionary no larger than the content needs; a level's own takes up to 700 MB to set up, for each content.

    The smallest is a megabyte, so that hashes of short contents spread as with the level's own.
    """
    own = {6: 8 << 20, 9: 64 << 20}[level]

    def pack(content: bytes) -> bytes:
        size = min(own, max(1 << 20, 1 << max(0, len(content) - 1).bit_length()))
        return lzma.compress(content, filters=[{"id": lzma.FILTER_LZMA2, "preset": level, "dict_size": size}])

    return pack


# Codecs and their levels.
CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "gzip": (lambda b: gzip.compress(b, 6, mtime=0), gzip.decompress),
    "bzip2": (lambda b: bz2.compress(b, 9), bz2.decompress),
    "xz": (xz(6), lzma.decompress),
}


def packed(rows: DataFrame, content: str, codec: str) -> DataFrame:
    """Add ``packed``, the content compressed by a codec; a null content stays null."""
    pack = CODECS[codec][0]
    return _mapped(rows, content, "packed", pack)


def unpacked(rows: DataFrame, content: str, codec: str) -> DataFrame:
    """Add ``unpacked``, the compressed content restored."""
    return _mapped(rows, content, "unpacked", CODECS[codec][1])


def _mapped(rows: DataFrame, content: str, name: str, change: Callable[[bytes], bytes]) -> DataFrame:
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for x in batch.column(names.index(content)):
                raw = x.as_py()
                made.append(None if raw is None else change(raw.encode() if isinstance(raw, str) else bytes(raw)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, {name} binary")


def gzip_archive(files: DataFrame) -> DataFrame:
    """Files that gzip makes smaller, with sizes and a verified hash of the restored content."""
    rows = packed(files.select("file_id", "path", "size", "sha256", "text"), "text", "gzip")
    rows = rows.withColumn("packed_size", F.octet_length("packed").cast("long")).where("packed_size < size")
    return unpacked(rows, "packed", "gzip").select("file_id", "path", "size", "sha256", "packed", "packed_size", (F.sha2("unpacked", 256) == F.col("sha256")).alias("verified"))


def codec_sizes(files: DataFrame) -> DataFrame:
    """Bytes of each file under each codec: file_id, codec, bytes.  Each text is read once for all codecs."""
    id_type = files.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, codecs, sizes = [], [], []
            for i, x in enumerate(batch.column(1)):
                raw = x.as_py()
                raw = raw.encode() if isinstance(raw, str) else raw
                for codec, (pack, _) in CODECS.items():
                    ids.append(i)
                    codecs.append(codec)
                    sizes.append(None if raw is None else len(pack(raw)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(codecs, pa.string()), pa.array(sizes, pa.int64())], ["file_id", "codec", "bytes"])

    return files.select("file_id", "text").mapInArrow(run, f"file_id {id_type}, codec string, bytes long")


# Codec of each tier, and levels.
TIER_CODECS = {"hot": "none", "warm": "zstd", "cold": "xz9"}


def _tier_codecs() -> dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]]:
    import zstandard

    return {
        "none": (bytes, bytes),
        "zstd": (zstandard.ZstdCompressor(level=6).compress, zstandard.ZstdDecompressor().decompress),
        "xz9": (xz(9), lzma.decompress),
    }


def tier_blobs(files: DataFrame) -> DataFrame:
    """``files(fp, tier, content)`` as a tier's backend keeps them: fp, tier, codec, checksum of the content, data. A tier without a codec keeps contents as they are."""
    codec = F.coalesce(*[F.when(F.col("tier") == t, c) for t, c in TIER_CODECS.items()], F.lit("none"))
    rows = files.select("fp", "tier", codec.alias("codec"), F.sha2("content", 256).alias("checksum"), "content")
    return _by_codec(rows, "content", "data", 0).drop("content")


def tier_contents(blobs: DataFrame) -> DataFrame:
    """fp and content of what :func:`tier_blobs` made; null where the checksum is not the content's."""
    rows = _by_codec(blobs, "data", "content", 1)
    return rows.select("fp", F.when(F.sha2("content", 256) == F.col("checksum"), F.col("content")).alias("content"))


def _by_codec(rows: DataFrame, old: str, new: str, way: int) -> DataFrame:
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs = _tier_codecs()
        for batch in batches:
            made = [None if x.as_py() is None else codecs[c][way](x.as_py()) for c, x in zip(batch.column(names.index("codec")).to_pylist(), batch.column(names.index(old)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*names, new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, {new} binary")


#: Bytes of contents in one container of an export.
EXPORT_BYTES = 32 << 20


def _container(form: str, files: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    if form == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
            for path, content in files:
                box.writestr(zipfile.ZipInfo(path), content)
    else:
        with tarfile.open(fileobj=out, mode="w:gz" if form == "tar.gz" else "w") as box:
            for path, content in files:
                info = tarfile.TarInfo(path)
                info.size = len(content)
                box.addfile(info, io.BytesIO(content))
    return out.getvalue()


def exported(files: DataFrame, form: str, part_bytes: int = EXPORT_BYTES) -> DataFrame:
    """``files(path, content)`` in containers of a form (tar, tar.gz, zip), or as they are (raw): name, data.

    A container holds files up to ``part_bytes`` and is made where they are; its name is
    that of its first file. Null contents count as empty.
    """
    if form not in ("tar", "tar.gz", "zip", "raw"):
        raise ValueError(f"unknown form {form}")
    if form == "raw":
        return files.select(F.col("path").alias("name"), F.coalesce("content", F.lit(b"")).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{held[0][0]}.{form}"]), pa.array([_container(form, held)], pa.binary())], ["name", "data"])

        held: list[tuple[str, bytes]] = []
        size = 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((path, content.as_py() or b""))
                size += len(held[-1][1])
                if size >= part_bytes:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    return files.select("path", "content").mapInArrow(run, "name string, data binary")


def imported(containers: DataFrame, form: str) -> DataFrame:
    """path and content of the files in ``containers(name, data)``."""
    if form == "raw":
        return containers.select(F.col("name").alias("path"), F.col("data").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1):
                raw = io.BytesIO(data.as_py())
                if form == "zip":
                    with zipfile.ZipFile(raw) as box:
                        found = [(n, box.read(n)) for n in box.namelist()]
                else:
                    with tarfile.open(fileobj=raw) as box:
                        found = [(m.name, box.extractfile(m).read()) for m in box]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found]), pa.array([c for _, c in found], pa.binary())], ["path", "content"])

    return containers.select("name", "data").mapInArrow(run, "path string, content binary")


def best_codec(sizes: DataFrame) -> DataFrame:
    """The codec with the fewest bytes for each file; at a tie the first by name."""
    best = F.min(F.struct("bytes", "codec"))
    return sizes.groupBy("file_id").agg(best.alias("b")).select("file_id", "b.codec", "b.bytes")


def bundle(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest (path, size, sha256) and the distinct contents it names."""
    manifest = files.select("path", "size", "sha256")
    contents = files.where("size > 0").groupBy("sha256").agg(F.min_by("text", "file_id").alias("text"), F.max("size").alias("size"))
    return manifest, contents


def verify_manifest(manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """What is wrong between ``manifest(path, size, sha256)`` and ``blobs(sha256, size)``: missing and unused blobs, sizes that differ, paths named twice, paths that are also folders."""
    named = manifest.where("size > 0")
    missing = named.join(blobs, "sha256", "left_anti").select(F.lit("missing").alias("problem"), F.col("path").alias("subject"))
    unused = blobs.join(named, "sha256", "left_anti").select(F.lit("unused").alias("problem"), F.col("sha256").alias("subject"))
    sizes = named.join(blobs.select("sha256", F.col("size").alias("blob_size")), "sha256").where("size <> blob_size").select(F.lit("size").alias("problem"), F.col("path").alias("subject"))
    twice = manifest.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("twice").alias("problem"), F.col("path").alias("subject"))
    # each path against all folders above the others, by equality and not by prefix
    parts = F.split("path", "/")
    above = manifest.select(F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).distinct()
    folder = manifest.select("path").join(above, "path", "left_semi").select(F.lit("folder").alias("problem"), F.col("path").alias("subject"))
    return missing.unionByName(unused).unionByName(sizes).unionByName(twice).unionByName(folder)


def restored(manifest_chunks: DataFrame, blobs: DataFrame) -> DataFrame:
    """Put files together from ``manifest_chunks(file_id, chunk_index, fp)`` and ``blobs(fp, content)``: file_id, n, content (bytes).

    A file whose chunks are not all there is left out.
    """
    rows = manifest_chunks.join(blobs, "fp", "left")
    parts = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.count("content").alias("there"), F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("parts"))
    return parts.where("n = there").select("file_id", "n", F.unhex(F.array_join(F.transform("parts.content", F.hex), "")).alias("content"))


def restore_status(failed: Column, total: Column) -> Column:
    """COMPLETED, PARTIAL or FAILED by the number of failed files."""
    return F.when(failed == 0, "COMPLETED").when(failed < total, "PARTIAL").otherwise("FAILED")
