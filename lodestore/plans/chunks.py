"""Queries over chunks and bloom filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import dedup as D
from ..operators import inventory as I
from .catalog import Tables
from .registry import query

# blocks of bytes, as hexadecimal digits
_BLOCKS = "(select file_id, o // 448 as chunk_index, o as offset_, least(512, size - o) as size, sha256(unhex(substr(h, 2 * o + 1, 1024))) as fp from (select file_id, hex(encode(text)) as h, size, unnest(range(0, size, 448)) as o from files))"
_SEEN = f"(select *, row_number() over (partition by fp order by file_id, chunk_index) as seen from {_BLOCKS})"


def _blocks(t: Tables):
    return C.fixed_blocks(t.files, 512, 64)


@query("cdc_fixed", f"select file_id, chunk_index, offset_, size, fp from {_BLOCKS}")
def _(t: Tables):
    return _blocks(t).withColumnRenamed("offset", "offset_")


@query("cdc_fixed_sizes", "select file_id, sum(least(512, size - o))::bigint as bytes, count(*) as n from (select file_id, size, unnest(range(0, size, 448)) as o from files) group by 1")
def _(t: Tables):
    return C.fixed_blocks(t.files, 512, 64).groupBy("file_id").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def _rolling(bits: int, joined: str) -> str:
    """SQL of a rolling hash of the last ``bits`` bytes after each byte of each file: (file_id, i, h)."""
    terms = "b"
    for j in range(1, bits):
        terms = joined.format(a=terms, b=f"(coalesce(lag(b, {j}) over w, 0) << {j})")
    return f"""(select file_id, i, ({terms}) & {(1 << bits) - 1} as h from (
        select file_id, i, ('0x' || substr(x, 2 * i + 1, 2))::bigint as b from (select file_id, hex(encode(text)) as x, unnest(range(0, size)) as i from files)) window w as (partition by file_id order by i))"""


_CUT = "file_id, row_number() over (partition by file_id order by a) - 1 as chunk_index, a as offset_, z - a as size, sha256(unhex(substr(hex(encode(text)), 2 * a + 1, 2 * (z - a)))) as fp"

# from cut to cut: the first place that the rule allows, else the longest chunk
_FAST = f"""with recursive marks as (select file_id, list(i + 1 order by i) as places from {_rolling(9, "xor({a}, {b})")} where h = {C.FAST_TARGET & 511} group by file_id),
    walk(file_id, places, n, a, z) as (
        select f.file_id, coalesce(places, []), size, 0::bigint, null::bigint from files f left join marks m on m.file_id = f.file_id where size > 0
        union all
        select file_id, places, n, least(a + 2048, n, coalesce(list_filter(places, lambda x: x >= a + 256 and x <= least(a + 2048, n) and x < n)[1], n)), a from walk where a < n)
    select {_CUT} from (select w.file_id, w.z as a, w.a as z, text from walk w join files f on f.file_id = w.file_id where w.z is not null)"""

_RABIN = f"""with recursive marks as (select file_id, list(i - 47 order by i) as places from {_rolling(15, "({a} + {b})")} where h = 0 and i >= 48 group by file_id),
    walk(file_id, places, n, a, z) as (
        select f.file_id, case when size >= 48 then coalesce(places, []) else [] end, size, 0::bigint, null::bigint from files f left join marks m on m.file_id = f.file_id where size > 0
        union all
        select file_id, places, n, coalesce(list_filter(places, lambda x: x >= a + 4096)[1], n), a from walk where a < n),
    spans as (select file_id, z as a, a as z from walk where z is not null),
    halved as (select file_id, a + 65536 * k as a, case when z - a - 65536 * k > 131072 then a + 65536 * (k + 1) else z end as z from (
        select file_id, a, z, unnest(range(0, greatest(0, (z - a - 131072 + 65535) // 65536) + 1)) as k from spans))
    select {_CUT} from (select h.file_id, h.a, h.z, text from halved h join files f on f.file_id = h.file_id)"""


@query("cdc_fast", _FAST)
def _(t: Tables):
    return C.content_chunks(t.files, "fast", shortest=256, longest=2048, bits=9).withColumnRenamed("offset", "offset_")


@query("cdc_fast_sizes", "select file_id, size as bytes from files where size > 0")
def _(t: Tables):
    return C.content_chunks(t.files, "fast", shortest=256, longest=2048, bits=9).groupBy("file_id").agg(F.sum("size").alias("bytes"))


@query("cdc_rabin", _RABIN)
def _(t: Tables):
    return C.content_chunks(t.files, "rabin").withColumnRenamed("offset", "offset_")


@query("cdc_rabin_sizes", "select file_id, size as bytes, 0::bigint as first from files where size > 0")
def _(t: Tables):
    return C.content_chunks(t.files, "rabin", shortest=512, mean=1024, longest=8192).groupBy("file_id").agg(F.sum("size").alias("bytes"), F.min("offset").alias("first"))


@query("cdc_boundaries", f"select file_id, offset_, offset_ + size as until_ from ({_RABIN})")
def _(t: Tables):
    rows = C.content_chunks(t.files, "rabin")
    return rows.select("file_id", F.col("offset").alias("offset_"), (F.col("offset") + F.col("size")).alias("until_"))


@query("cdc_factory", f"select count(*) as n, sum(size)::bigint as bytes from {_BLOCKS}")
def _(t: Tables):
    return C.chunker("fixed", block=512, overlap=64)(t.files).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("ext_chunker", "select sum(size)::bigint as bytes from files")
def _(t: Tables):
    return C.chunker("fast", shortest=256, longest=2048, bits=9)(t.files).agg(F.sum("size").alias("bytes"))


_POLY = "list_reduce(list_prepend(0::hugeint, list_transform(range(size), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::hugeint)), lambda h, b: (h * 2 + b) % 4611686018427387847)::bigint"


@query("cdc_poly_fp", f"select file_id, {_POLY} as fp from (select file_id, size, hex(encode(text)) as h from files where size > 0)")
def _(t: Tables):
    return C.polynomial_fingerprints(t.files.where("size > 0").select("file_id", "text"))


@query("src_scan_node", f"select file_id, min(seen) = 1 as has_new, count(*) as n from {_SEEN} group by 1")
def _(t: Tables):
    return D.sightings(_blocks(t)).groupBy("file_id").agg((F.min("seen") == 1).alias("has_new"), F.count(F.lit(1)).alias("n"))


@query("win_first_seen", f"select file_id, chunk_index, seen, seen = 1 as is_unique from {_SEEN}")
def _(t: Tables):
    return D.sightings(_blocks(t)).select("file_id", "chunk_index", "seen", "is_unique")


@query("win_pipeline_check", f"select file_id, chunk_index, seen <= 2 as is_unique from {_SEEN}")
def _(t: Tables):
    return D.sightings(_blocks(t), uniques=2).select("file_id", "chunk_index", "is_unique")


_FILE = f"select file_id, count(*) as n, count(*) filter (where seen = 1) as n_unique, sum(size)::bigint as bytes, sum(case when seen = 1 then size else 0 end)::bigint as stored, round(1 - sum(case when seen = 1 then size else 0 end) / sum(size)::double, 6) as saved from {_SEEN} group by 1"


@query("agg_file_dedup", _FILE)
def _(t: Tables):
    return D.by_file(_blocks(t))


@query("m4_process", _FILE)
def _(t: Tables):
    return D.by_file(_blocks(t))


@query("agg_m4_report", f"select coalesce(file_id, -1) as file_id, sum(bytes)::bigint as bytes, sum(stored)::bigint as stored from ({_FILE}) group by rollup(file_id)")
def _(t: Tables):
    rows = D.by_file(_blocks(t)).rollup("file_id").agg(F.sum("bytes").alias("bytes"), F.sum("stored").alias("stored"))
    return rows.withColumn("file_id", F.coalesce("file_id", F.lit(-1)))


@query("agg_dir_dedup", f"select dir, sum(n)::bigint as n, sum(n_unique)::bigint as n_unique from ({_FILE}) c join files f on f.file_id = c.file_id group by 1")
def _(t: Tables):
    return D.by_file(_blocks(t)).join(t.files.select("file_id", "dir"), "file_id").groupBy("dir").agg(F.sum("n").alias("n"), F.sum("n_unique").alias("n_unique"))


_TOTAL = f"select n, n_unique, bytes, stored, round(n / n_unique::double, 6) as mean_refs, round(bytes / stored::double, 6) as factor from (select sum(k)::bigint as n, count(*) as n_unique, sum(k * size)::bigint as bytes, sum(size)::bigint as stored from (select fp, count(*) as k, max(size) as size from {_BLOCKS} group by 1))"


@query("agg_chunk_stats", _TOTAL)
def _(t: Tables):
    return D.totals(_blocks(t))


@query("agg_builder_stats", f"select n, n_unique, factor from ({_TOTAL})")
def _(t: Tables):
    return D.totals(_blocks(t)).select("n", "n_unique", "factor")


@query("agg_dedup_task", "select sum(case when rn = 1 then 1 else 0 end)::bigint as new_files, sum(case when rn > 1 then 1 else 0 end)::bigint as duplicates, round(sum(case when rn > 1 then size else 0 end) / sum(size)::double, 6) as saved from (select size, row_number() over (partition by sha256 order by file_id) as rn from files)")
def _(t: Tables):
    rows = I.with_first(t.files).withColumn("copy", F.col("file_id") != F.col("first_id"))
    return rows.agg(F.count_if(~F.col("copy")).alias("new_files"), F.count_if("copy").alias("duplicates"), F.round(F.sum(F.when(F.col("copy"), F.col("size")).otherwise(0)) / F.sum("size"), 6).alias("saved"))


@query("agg_scan_merge", f"select count(distinct fp) as distinct_chunks, count(distinct file_id) as scanned, max(size) as longest from {_BLOCKS}")
def _(t: Tables):
    even, odd = (C.fixed_blocks(t.files.where(F.col("file_id") % 2 == k), 512, 64) for k in (0, 1))
    return even.unionByName(odd).agg(F.count_distinct("fp").alias("distinct_chunks"), F.count_distinct("file_id").alias("scanned"), F.max("size").alias("longest"))


@query("set_distinct_chunks", f"select distinct fp from {_BLOCKS}")
def _(t: Tables):
    return _blocks(t).select("fp").distinct()


_CAPACITY, _ERROR = 5000, 0.001


_BITS, _HASHES = D.bloom_shape(_CAPACITY, _ERROR)


def _mod(digest: str, pieces: int) -> str:
    """SQL of a hexadecimal digest modulo the bits of the filter."""
    return f"list_reduce(list_prepend(0::bigint, list_transform(range({pieces}), lambda i: ('0x' || substr({digest}, 8 * i + 1, 8))::bigint)), lambda a, x: (a * 4294967296 + x) % {_BITS})"


def _filter(items: str) -> str:
    """SQL of the words of the filter of ``items(x)``."""
    return f"""(select p // 63 as word, bit_or(1::bigint << (p % 63))::bigint as bits from (
        select unnest(list_transform(range({_HASHES}), lambda i: (a + i * b) % {_BITS})) as p from (select {_mod("sha256(x)", 8)} as a, {_mod("md5(x)", 4)} as b from {items})) group by 1)"""


_WORDS = _filter("(select distinct sha256 as x from files)")


@query("bloom_build", f"select word, bits from {_WORDS}")
def _(t: Tables):
    return D.bloom_words(t.files, "sha256", _CAPACITY, _ERROR)


@query("agg_bloom_count", f"select floor(-{(_BITS + 7) // 8 * 8} * ln(1 - sum(bit_count(bits)) / {(_BITS + 7) // 8 * 8}.0::double) / {_HASHES})::bigint as estimate from {_WORDS}")
def _(t: Tables):
    return D.bloom_count(D.bloom_words(t.files, "sha256", _CAPACITY, _ERROR), _CAPACITY, _ERROR)


@query("set_bloom_or", f"select word, bits from {_WORDS}")
def _(t: Tables):
    parts = [D.bloom_words(t.files.where(F.col("file_id") % 2 == k), "sha256", _CAPACITY, _ERROR) for k in (0, 1)]
    return parts[0].unionByName(parts[1]).groupBy("word").agg(F.bit_or("bits").alias("bits"))


@query("join_bloom_probe", "select kind, case when kind = 'held' then count(*) else 0 end as surely_found, true as few_others from (select 'held' as kind from files union all select 'other' from files) group by 1")
def _(t: Tables):
    """All keys, and as many that the filter was not given: none of the first may be missed, and few of the second be found."""
    # a filter that holds more than its capacity finds too many others
    capacity = max(_CAPACITY, t.files.agg(F.count_distinct("sha256")).first()[0])
    words = D.bloom_words(t.files, "sha256", capacity, _ERROR)
    keys = t.files.select(F.lit("held").alias("kind"), "sha256").unionByName(t.files.select(F.lit("other").alias("kind"), F.sha2(F.concat("sha256", F.col("file_id").cast("string")), 256).alias("sha256")))
    found = D.bloom_probe(keys, "sha256", words, capacity, _ERROR)
    held = F.col("kind") == "held"
    n = F.count_if(F.col("maybe"))
    return found.groupBy("kind").agg(n.alias("n"), F.count(F.lit(1)).alias("all")).select("kind", F.when(held, F.col("n")).otherwise(F.lit(0)).alias("surely_found"), (held | (F.col("n") <= 10 + 5 * _ERROR * F.col("all"))).alias("few_others"))


@query("bloom_message", "select file_id, 'add' as kind from files where file_id % 3 = 0")
def _(t: Tables):
    message = F.to_json(F.struct(F.when(F.col("file_id") % 3 == 0, "add").otherwise("noise").alias("type"), F.lit(1).alias("version"), "file_id"))
    parsed = t.files.select(F.from_json(message, "type string, version int, file_id long").alias("m")).where("m.type = 'add' and m.version = 1")
    return parsed.select("m.file_id", F.col("m.type").alias("kind"))


@query("msg_decode", "select file_id, case file_id % 2 when 0 then 'request' else 'unknown' end as kind, case file_id % 2 when 0 then file_id::double else 0.0::double end as stamp from files")
def _(t: Tables):
    message = F.when(F.col("file_id") % 2 == 0, F.to_json(F.struct("file_id", F.lit("request").alias("type"), F.col("file_id").cast("double").alias("timestamp")))).otherwise(F.to_json(F.struct("file_id", F.lit("junk").alias("type"))))
    m = t.files.select(F.from_json(message, "file_id long, type string, timestamp double").alias("m")).select("m.*")
    return m.select("file_id", F.when(F.col("type").isin("request", "result", "sync"), F.col("type")).otherwise("unknown").alias("kind"), F.coalesce("timestamp", F.lit(0.0)).alias("stamp"))


@query("cdc_parallel", "select file_id, size as bytes from files where size > 0")
def _(t: Tables):
    spread = t.files.select("file_id", "text").repartition(8, "file_id")
    return C.content_chunks(spread, "fast", shortest=256, longest=2048, bits=9).groupBy("file_id").agg(F.sum("size").alias("bytes"))
