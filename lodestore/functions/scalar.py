"""Scalar column functions for file catalogs, fingerprints and log lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions by category.
CATEGORIES = {
    "video": ["mp4", "avi", "mkv", "mov", "wmv", "flv", "webm", "m4v", "rmvb", "3gp"],
    "audio": ["mp3", "wav", "flac", "aac", "ogg", "wma", "m4a", "ape", "dts"],
    "image": ["jpg", "jpeg", "png", "gif", "bmp", "svg", "webp", "ico", "tiff", "raw", "psd"],
    "document": ["pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "rtf", "odt", "pages", "numbers", "key"],
    "code": ["py", "js", "ts", "java", "c", "cpp", "h", "cs", "go", "rs", "php", "rb", "swift", "kt", "vue", "jsx", "tsx"],
    "archive": ["zip", "rar", "7z", "tar", "gz", "bz2", "xz", "iso", "cab", "tgz"],
    "database": ["db", "sqlite", "sqlite3", "mdb", "accdb", "dbf", "myd"],
    "font": ["ttf", "otf", "woff", "woff2", "eot"],
    "sheet": ["csv", "tsv", "xlsb"],
}

# Leading bytes (hex) by type; the first that fits counts.
MAGICS = [
    ("89504E470D0A1A0A", "png"),
    ("FFD8FF", "jpg"),
    ("474946383761", "gif"),
    ("474946383961", "gif"),
    ("52494646", "wav"),
    ("494433", "mp3"),
    ("1F8B", "gz"),
    ("504B0304", "zip"),
    ("52617221", "rar"),
    ("7F454C46", "elf"),
    ("4D5A", "exe"),
    ("25504446", "pdf"),
    ("D0CF11E0", "office"),
]

# Patterns of temporary file names.
TEMPORARY = [".tmp", ".temp", ".bak", ".old", "~", ".cache"]


def first_of(cases: list[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first true condition."""
    out = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def extension(name: Column) -> Column:
    """Lower-cased text after the last dot of a file name, empty without one."""
    return F.lower(F.regexp_extract(name, r"[^.].*\.([^.]+)$", 1))


def category(ext: Column) -> Column:
    """Category of an extension, ``other`` if none has it."""
    return first_of([(ext.isin(x), k) for k, x in CATEGORIES.items()], "other")


def magic_type(content: Column) -> Column:
    """Type by the first sixteen bytes, null if none is known."""
    head = F.hex(F.substring(content, 1, 16))
    return first_of([(head.startswith(m), t) for m, t in MAGICS])


def format_size(size: Column) -> Column:
    """Size in the largest unit that leaves it under 1024, one decimal; petabytes with two."""
    cases = [(size < 1024 ** (i + 1), F.concat(F.format_string("%.1f", F.bround(size / float(1024**i), 1)), F.lit(f" {u}"))) for i, u in enumerate(("B", "KB", "MB", "GB", "TB"))]
    return first_of(cases, F.concat(F.format_string("%.2f", F.bround(size / float(1024**5), 2)), F.lit(" PB")))


def quick_hash(size: Column, content: Column, edge: int = 1 << 20) -> Column:
    """MD5 of the size, the first ``edge`` bytes and, of contents over twice that, the last."""
    head = F.substring(content, 1, edge)
    tail = F.when(size > 2 * edge, F.substring(content, -edge, edge)).otherwise(F.lit(b""))
    return F.md5(F.concat(size.cast("string").cast("binary"), head, tail))


def safe_relative(path: Column) -> Column:
    """Whether a path may be restored: relative, no dot parts, no colon, no name that Windows reserves, no part ending in a dot or space."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: p != "")
    reserved = ["CON", "PRN", "AUX", "NUL", *[f"{p}{i}" for p in ("COM", "LPT") for i in range(1, 10)]]
    bad = F.exists(
        parts,
        lambda p: p.isin("..", ".") | p.contains(":") | p.endswith(".") | p.endswith(" ") | F.upper(F.substring_index(p, ".", 1)).isin(reserved),
    )
    return F.coalesce((F.size(parts) > 0) & ~F.regexp_replace(path, r"\\", "/").startswith("/") & ~path.contains("\0") & ~bad, F.lit(False))


def path_allowed(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of the roots or lies below one."""
    return reduce(lambda a, b: a | b, [(path == r.rstrip("/")) | path.startswith(r.rstrip("/") + "/") for r in roots], F.lit(False))


def temporary(name: Column) -> Column:
    return reduce(lambda a, b: a | b, [name.contains(p) for p in TEMPORARY])


def ring_position(key: Column) -> Column:
    """First four bytes of the key's SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")


def md5_shard(key: Column, shards: int = 256) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % shards


def usage_percent(used: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(used * 100.0, total.cast("double")), F.lit(0.0))


def savings(size: Column, compressed: Column) -> Column:
    return F.when(compressed > 0, size - compressed).otherwise(F.lit(0))


# Storage price by tier, a gigabyte and month.
TIER_COST = {"hot": 0.03, "warm": 0.01, "cold": 0.001}


def tier_cost(tier: Column, size: Column) -> Column:
    price = first_of([(tier == t, p) for t, p in TIER_COST.items()], 0.0)
    return size / float(1 << 30) * price
