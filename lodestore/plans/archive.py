"""Queries over archives and restores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import archive as R
from ..operators import bundles as B
from ..operators import chunking as C
from ..sources.shared import shared_folder
from .catalog import Tables
from .registry import query

@query("sink_archive_gzip", "select file_id, true as verified from files where size >= 400")
def _(t: Tables):
    return R.gzip_archive(t.files).where("size >= 400").select("file_id", "verified")


@query("arc_restore_gzip", "select count(*) as n, true as verified from files where size >= 400")
def _(t: Tables):
    return R.gzip_archive(t.files).where("size >= 400").agg(F.count(F.lit(1)).alias("n"), F.bool_and("verified").alias("verified"))


@query("topk_best_codec")
def _(t: Tables):
    return R.best_codec(R.codec_sizes(t.files))


@query("sink_tier_backend")
def _(t: Tables):
    return R.codec_sizes(t.files)


_TIER = "['hot', 'warm', 'cold'][file_id % 3 + 1]"


@query("sink_tier_store", f"select sha256 as fp, {_TIER} as tier, case {_TIER} when 'hot' then 'none' when 'warm' then 'zstd' else 'xz9' end as codec, file_id, true as restored from files")
def _(t: Tables):
    """Contents kept by their tier's codec, written, read back and held against their checksums."""
    tier = F.element_at(F.array(F.lit("hot"), F.lit("warm"), F.lit("cold")), (F.col("file_id") % 3 + 1).cast("int"))
    files = t.files.select(F.concat_ws(":", F.col("file_id").cast("string"), "sha256").alias("fp"), tier.alias("tier"), F.col("text").cast("binary").alias("content"))
    path = shared_folder(t.spark, "tiers")
    R.tier_blobs(files).write.partitionBy("tier").parquet(path)
    blobs = t.spark.read.schema("fp string, codec string, checksum string, data binary, tier string").parquet(path)
    found = blobs.select("fp", "tier", "codec").join(R.tier_contents(blobs), "fp")
    sha = F.element_at(F.split("fp", ":"), 2)
    return found.select(sha.alias("fp"), "tier", "codec", F.element_at(F.split("fp", ":"), 1).cast("long").alias("file_id"), (F.sha2("content", 256) == sha).alias("restored"))


@query("sink_restore_export", "select form, substr(path, 2) as path, sha256 from files, (values ('tar'), ('tar.gz'), ('zip'), ('raw')) f(form)")
def _(t: Tables):
    """All files exported in every form, written, and read out of their containers again."""
    files = _listed(t).select("path", "content")
    out = None
    for form in ("tar", "tar.gz", "zip", "raw"):
        path = shared_folder(t.spark, "export")
        R.exported(files, form, 1 << 20).write.parquet(path)
        rows = R.imported(t.spark.read.schema("name string, data binary").parquet(path), form).select(F.lit(form).alias("form"), "path", F.sha2("content", 256).alias("sha256"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _listed(t: Tables):
    """Files as a bundle takes them; its paths are relative."""
    return t.files.select(F.substring("path", 2, 1 << 20).alias("path"), "size", "sha256", F.col("text").cast("binary").alias("content"))


def _bundled(t: Tables, chunks: str | None = None, **params: int) -> tuple[dict, str]:
    root = shared_folder(t.spark, "bundles")
    receipt = B.create(_listed(t), root, chunks, **params)
    return receipt, f"{root}/{receipt['id']}"


@query("sink_bundle", "select sha256, max(size)::bigint as length, count(*) as n_files from files where size > 0 group by 1")
def _(t: Tables):
    """A bundle is written; its contents, where they lie and how many files have them."""
    _, path = _bundled(t)
    files = t.spark.read.schema("path string, size long, sha256 string").parquet(f"{path}/manifest/files")
    held = B.contents_of(t.spark, path)
    return held.join(files, "sha256").groupBy("sha256", "length").agg(F.count(F.lit(1)).alias("n_files"))


@query("sink_bundle_restored", "select substr(path, 2) as path, size, sha256(text) as sha256 from files")
def _(t: Tables):
    """All files read back from a bundle."""
    restored = B.restore(t.spark, _bundled(t)[1])
    return restored.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


@query("sink_bundle_cdc", "select substr(path, 2) as path, size, sha256(text) as sha256 from files")
def _(t: Tables):
    """All files read back from a bundle of content-defined chunks."""
    restored = B.restore(t.spark, _bundled(t, "fast", shortest=256, longest=2048, bits=9)[1])
    return restored.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


@query("sink_bundle_receipt", """select count(*) as n_files, count(distinct sha256) filter (where size > 0) as unique_contents, sum(size)::bigint as original_bytes,
    sum(size)::bigint - (select sum(size) from (select max(size) as size from files group by sha256))::bigint as dedup_bytes, true as smallest, true as reused from files""")
def _(t: Tables):
    """A receipt, and that the smallest codec was kept and a second run finds the same bundle."""
    root = shared_folder(t.spark, "bundles")
    first, again = (B.create(_listed(t), root) for _ in range(2))
    smallest = first["trials"][first["codec"]] == min(first["trials"].values())
    counts = [F.lit(first[old]).cast("long").alias(new) for old, new in (("file_count", "n_files"), ("unique_contents", "unique_contents"), ("original_bytes", "original_bytes"), ("dedup_bytes", "dedup_bytes"))]
    return t.spark.range(1).select(*counts, F.lit(smallest).alias("smallest"), F.lit(again["reused"] and again["id"] == first["id"]).alias("reused"))


@query("join_restore_selected", "select substr(path, 2) as path, sha256(text) as sha256 from files where name like '%.log'")
def _(t: Tables):
    """Some files read from a bundle; only the segments that hold their contents are opened."""
    _, path = _bundled(t)
    chosen = _listed(t).where(F.col("path").endswith(".log")).select("path")
    return B.restore(t.spark, path, chosen).select("path", F.sha2("content", 256).alias("sha256"))


_PIECES = "(select file_id, o // 512 as chunk_index, least(512, size - o) as size, sha256(unhex(substr(h, 2 * o + 1, 1024))) as fp from (select file_id, hex(encode(text)) as h, size, unnest(range(0, size, 512)) as o from files))"
_BLOBS = "(select sha256, max(size) + case when min(file_id) % 31 = 0 then 1 else 0 end as size from files where size > 0 and file_id % 23 <> 0 group by 1 union all select 'extra', 5)"
_MANIFEST = "(select path, size, sha256 from files union all select path, size, sha256 from files where file_id % 101 = 0 union all select dir as path, 0 as size, '' as sha256 from files where file_id % 211 = 0)"


@query("join_manifest_verify", f"""select 'missing' as problem, path as subject from {_MANIFEST} m where size > 0 and sha256 not in (select sha256 from {_BLOBS})
    union all select 'unused', sha256 from {_BLOBS} where sha256 not in (select sha256 from {_MANIFEST} where size > 0)
    union all select 'size', path from {_MANIFEST} m join {_BLOBS} b on m.sha256 = b.sha256 where m.size > 0 and m.size <> b.size
    union all select 'twice', path from {_MANIFEST} group by path having count(*) > 1
    union all select 'folder', path from {_MANIFEST} where path in (select dir from files)""")
def _(t: Tables):
    manifest = t.files.select("path", "size", "sha256").unionByName(t.files.where("file_id % 101 = 0").select("path", "size", "sha256"))
    manifest = manifest.unionByName(t.files.where("file_id % 211 = 0").select(F.col("dir").alias("path"), F.lit(0).cast("long").alias("size"), F.lit("").alias("sha256")))
    blobs = t.files.where("size > 0 and file_id % 23 <> 0").groupBy("sha256").agg((F.max("size") + F.when(F.min("file_id") % 31 == 0, 1).otherwise(0)).alias("size"))
    extra = t.spark.sql("select 'extra' as sha256, 5L as size")
    return R.verify_manifest(manifest, blobs.unionByName(extra))


@query("set_equality", "select (select count(*) from (select sha256 from files except select sha256 from files where file_id % 2 = 0)) as only_left, (select count(*) from (select sha256 from files where file_id % 2 = 0 except select sha256 from files)) as only_right")
def _(t: Tables):
    left, right = t.files.select("sha256").distinct(), t.files.where("file_id % 2 = 0").select("sha256").distinct()
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(left.join(right, "sha256", "left_anti"), "only_left").crossJoin(n(right.join(left, "sha256", "left_anti"), "only_right"))  # one row each


def _chunks(t: Tables):
    return C.fixed_blocks(t.files, 512, 0)


def _chunk_blobs(t: Tables):
    return C.fixed_blocks(t.files, 512, 0, content=True).groupBy("fp").agg(F.min("content").alias("content"))


@query("join_restore_files", "select file_id, (size + 511) // 512 as n, sha256 from files where size > 0")
def _(t: Tables):
    rows = R.restored(_chunks(t).select("file_id", "chunk_index", "fp"), _chunk_blobs(t))
    return rows.select("file_id", "n", F.sha2("content", 256).alias("sha256"))


@query("join_restore_partial", "select file_id, sha256 from files where size > 0 and file_id % 4 = 0")
def _(t: Tables):
    chosen = t.files.where("file_id % 4 = 0").select("file_id")
    rows = R.restored(_chunks(t).select("file_id", "chunk_index", "fp").join(chosen, "file_id", "left_semi"), _chunk_blobs(t))
    return rows.select("file_id", F.sha2("content", 256).alias("sha256"))


@query("arc_add_file", "select file_id, (size + 511) // 512 as n from files where size > 0")
def _(t: Tables):
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "fp")))
    return _chunks(t).groupBy("file_id").agg(F.size(ordered).cast("long").alias("n"))




@query("join_manifest_verify_cdc", f"select file_id, chunk_index, p.fp from {_PIECES} p left join (select distinct fp from {_PIECES} where file_id % 7 <> 0) b on p.fp = b.fp where b.fp is null")
def _(t: Tables):
    there = _chunks(t).where("file_id % 7 <> 0").select("fp").distinct()
    return _chunks(t).join(there, "fp", "left_anti").select("file_id", "chunk_index", "fp")


@query("arc_verify", "select path from files where file_id % 13 = 0")
def _(t: Tables):
    now = t.files.select("path", F.when(F.col("file_id") % 13 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("now"))
    return t.files.select("path", "sha256").join(now, "path").where("sha256 <> now").select("path")


@query("join_check_sources", "select path from files where file_id % 17 = 0")
def _(t: Tables):
    now = t.files.select("path", (F.col("size") + F.when(F.col("file_id") % 17 == 0, 1).otherwise(0)).alias("size_now"))
    return t.files.join(now, "path").where("size <> size_now").select("path")


_LOST = f"(select distinct file_id from {_PIECES} p where fp not in (select fp from {_PIECES} where file_id % 7 <> 0))"


@query("arc_restore_status", f"select storage_id, case when sum((l.file_id is not null)::int) = 0 then 'COMPLETED' when sum((l.file_id is not null)::int) < count(*) then 'PARTIAL' else 'FAILED' end as status, sum((l.file_id is not null)::int)::bigint as failed from files f left join {_LOST} l on f.file_id = l.file_id where size > 0 group by 1")
def _(t: Tables):
    """Files are put together from a store that has lost the blocks which only some files held."""
    there = C.fixed_blocks(t.files.where("file_id % 7 <> 0"), 512, 0, content=True).groupBy("fp").agg(F.min("content").alias("content"))
    made = R.restored(_chunks(t).select("file_id", "chunk_index", "fp"), there).select("file_id", F.sha2("content", 256).alias("now"))
    rows = t.files.where("size > 0").join(made, "file_id", "left")
    failed = F.count_if(F.col("now").isNull() | (F.col("now") != F.col("sha256")))
    return rows.groupBy("storage_id").agg(R.restore_status(failed, F.count(F.lit(1))).alias("status"), failed.alias("failed"))


@query("arc_vault_catalog", "select path, size, sha256 = sha256(text) as verified from files")
def _(t: Tables):
    return t.files.select("path", "size", (F.col("sha256") == F.sha2("text", 256)).alias("verified"))


_NOW = "sha256(case when file_id % 29 = 0 then text || '!' else text end)"


@query("agg_verification", f"select count(*) filter (where sha256 = {_NOW}) as passed, count(*) filter (where sha256 <> {_NOW}) as failed, round(count(*) filter (where sha256 = {_NOW}) * 100.0::double / count(*), 6) as rate from files")
def _(t: Tables):
    """Contents, of which some have changed, are hashed again and held against what was listed."""
    now = t.files.select("sha256", F.when(F.col("file_id") % 29 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    good = F.col("sha256") == F.sha2("content", 256)
    return now.agg(F.count_if(good).alias("passed"), F.count_if(~good).alias("failed"), F.round(F.count_if(good) * 100.0 / F.count(F.lit(1)), 6).alias("rate"))


@query("sink_archive_manager", "select substr(path, 2) as path, size, sha256, (select count(*) from files g where g.sha256 = f.sha256) as copies from files f")
def _(t: Tables):
    """The manifest of an archive that keeps each content once."""
    _, path = _bundled(t)
    rows = t.spark.read.schema("path string, size long, sha256 string").parquet(f"{path}/manifest/files")
    return rows.join(rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies")), "sha256").select("path", "size", "sha256", "copies")


@query("arc_fetch_parallel", f"select count(distinct fp) as n from {_PIECES}")
def _(t: Tables):
    return _chunk_blobs(t).agg(F.count(F.lit(1)).alias("n"))


@query("cloud_sync_exclude", "select path from files where not contains(path, '.tmp') and not contains(path, '/src5/')")
def _(t: Tables):
    return t.files.where(~F.col("path").contains(".tmp") & ~F.col("path").contains("/src5/")).select("path")
