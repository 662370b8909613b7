"""Log lines: parsing, block aggregates, anomalies, preservation, policy, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import first_of

# Patterns by level, the first that fits counts.
LEVELS = {
    "ERROR": r"(?i)\b(ERROR|FATAL|CRITICAL|SEVERE)\b",
    "WARN": r"(?i)\b(WARN|WARNING)\b",
    "INFO": r"(?i)\b(INFO|INFORMATION|NOTICE)\b",
    "DEBUG": r"(?i)\b(DEBUG|DBG)\b",
    "TRACE": r"(?i)\b(TRACE|VERBOSE)\b",
}

# Patterns of identifiers, the first that fits counts.
KEYWORDS = {
    "user_id": [r"user[_\s]?id[:\s=]+[\"']?([a-zA-Z0-9_\-]{8,32})", r"uid[:\s=]+[\"']?([a-zA-Z0-9_\-]{8,32})", r"[\"']userId[\"'][,\s:]+[\"']([a-zA-Z0-9_\-]{8,32})", r"X-User-ID[:\s]+(\S+)"],
    "order_id": [r"order[_\s]?id[:\s=]+[\"']?([a-zA-Z0-9_\-]{10,40})", r"orderNo[:\s=]+[\"']?([a-zA-Z0-9_\-]{10,40})", r"transaction[_\s]?id[:\s=]+[\"']?([a-zA-Z0-9_\-]{10,40})"],
    "session_id": [r"session[_\s]?id[:\s=]+[\"']?([a-zA-Z0-9_\-]{16,64})", r"sid[:\s=]+[\"']?([a-zA-Z0-9_\-]{16,64})", r"[\"']sessionId[\"'][,\s:]+[\"']([a-zA-Z0-9_\-]{16,64})"],
    "transaction_id": [r"transaction[_\s]?id[:\s=]+[\"']?([a-zA-Z0-9_\-]{20,64})", r"txn[_\s]?id[:\s=]+[\"']?([a-zA-Z0-9_\-]{20,64})", r"request[_\s]?id[:\s=]+[\"']?([a-zA-Z0-9_\-]{20,64})"],
    "ip_address": [r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b", r"X-Forwarded-For[:\s]+(\S+)", r"client_ip[:\s=]+(\S+)"],
}

# Patterns of exceptions (case does not count), methods, states and times of a line.
EXCEPTION = r"(?i)([a-zA-Z_]\w*Exception)\s*:\s*(.+)"
FRAME = r"(?i)at\s+([a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)+)\s*\(([^)]+)\)"
METHOD = r"(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s"
STATUS = r"\s(\d{3})\s"
ISO_TIME = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
PLAIN_TIME = r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}"
SYSLOG_TIME = r"[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
UNIX_TIME = r"^\d{10,13}$"

# Words of memory trouble.
MEMORY_WORDS = ["outofmemory", "oom", "heap", "memory", "gc", "garbage collection"]


def log_level(line: Column) -> Column:
    return first_of([(line.rlike(p), k) for k, p in LEVELS.items()], "UNKNOWN")


def keyword(line: Column, field: str) -> Column:
    found = [F.nullif(F.regexp_extract(line, "(?i)" + p, 1), F.lit("")) for p in KEYWORDS[field]]
    return F.coalesce(*found)


def log_timestamp(line: Column, as_of: Column) -> Column:
    """Time of a line (timestamp_ntz): ISO, plain, syslog, or seconds or milliseconds since 1970; else ``as_of``.

    A syslog time names no year; as the established behaviour has it, that is 1900.
    """
    iso = F.replace(F.substring(F.regexp_extract(line, ISO_TIME, 0), 1, 19), F.lit("T"), F.lit(" "))
    plain = F.regexp_replace(F.regexp_extract(line, PLAIN_TIME, 0), r"\s+", " ")
    syslog = F.regexp_replace(F.regexp_extract(line, SYSLOG_TIME, 0), r"\s+", " ")
    unix = F.try_to_number(F.nullif(F.regexp_extract(line, UNIX_TIME, 0), F.lit("")), F.lit("9999999999999")).cast("long")
    seconds = F.when(unix > 1_000_000_000_000, F.floor(unix / 1000)).otherwise(unix)
    when = lambda text: F.try_to_timestamp(F.nullif(text, F.lit(""))).cast("timestamp_ntz")
    named = F.try_to_timestamp(F.concat(F.lit("1900 "), F.nullif(syslog, F.lit(""))), F.lit("yyyy MMM d HH:mm:ss")).cast("timestamp_ntz")
    return F.coalesce(when(iso), when(plain), named, F.timestamp_seconds(seconds).cast("timestamp_ntz"), as_of)


def exception_type(line: Column) -> Column:
    """Name before the colon of ``XException: text``, else the method of a stack frame; null without one.

    Case does not count in either pattern, but what it matches must hold the word ``Exception``.
    """
    found = lambda p: F.when(F.regexp_extract(line, p, 0).contains("Exception"), F.regexp_extract(line, p, 1))
    return F.coalesce(found(EXCEPTION), found(FRAME))


def http_method(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, METHOD, 1), F.lit(""))


def http_status(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, STATUS, 1), F.lit("")).cast("int")


#: Fields that a line is parsed into.
FIELDS = ("ts", "level", *KEYWORDS, "http_method", "status", "exception", "raw_line")


def parse_lines(lines: DataFrame, as_of: str | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Parse ``lines(block_id, line_number, raw_line)`` into some ``fields``.

    ``ts`` is the line's time in whole seconds as :func:`log_timestamp` finds it, whatever
    its form; a line without one has ``as_of``.  A line is parsed once, before whatever
    filters or reads its fields, and lines are dealt out, as few bytes of them take long.
    """

    def parsed(line: Column) -> Column:
        raw = line["raw_line"]
        made = {
            "ts": lambda: F.date_format(log_timestamp(raw, F.lit(as_of).cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss"),
            "level": lambda: log_level(raw),
            **{f: (lambda f=f: keyword(raw, f)) for f in KEYWORDS},
            "http_method": lambda: http_method(raw),
            "status": lambda: http_status(raw),
            "exception": lambda: exception_type(raw),
            "raw_line": lambda: raw,
        }
        return F.struct(line["block_id"].alias("block_id"), line["line_number"].alias("line_number"), *[made[f]().alias(f) for f in FIELDS if f in fields])

    dealt = lines.select("block_id", "line_number", F.trim("raw_line").alias("raw_line")).repartition("line_number", "raw_line")
    # in a list of one, what is found in a line is neither written out for each use nor part of one long method
    return dealt.select(F.inline(F.transform(F.array(F.struct("block_id", "line_number", "raw_line")), parsed)))


def seconds_of(ts: Column) -> Column:
    """Seconds since 1970 of a time as :func:`parse_lines` writes it."""
    part = lambda at, n: F.substring(ts, at, n).cast("long")
    return F.unix_date(F.substring(ts, 1, 10).cast("date")) * F.lit(86400).cast("long") + part(12, 2) * 3600 + part(15, 2) * 60 + part(18, 2)


def bursts(parsed: DataFrame, window: int = 60, threshold: int = 5) -> DataFrame:
    """Per block: errors that survive pruning by each later error, and whether they make a burst.

    An error survives if it lies within ``window`` seconds before the latest time
    of itself and all later errors.
    """
    # from the last line back, as Spark adds up a frame of all that follows anew for each row
    later = Window.partitionBy("block_id").orderBy(F.col("line_number").desc()).rowsBetween(Window.unboundedPreceding, 0)
    errors = parsed.where("level = 'ERROR'").withColumn("t", seconds_of(F.col("ts")))
    alive = errors.withColumn("latest", F.max("t").over(later)).where(F.col("t") > F.col("latest") - window)
    return alive.groupBy("block_id").agg(F.count(F.lit(1)).alias("survivors")).select("block_id", "survivors", (F.col("survivors") >= threshold).alias("error_burst"))


#: Fields that :func:`blocks` reads.
BLOCK_FIELDS = ("ts", "level", "user_id", "order_id", "session_id", "raw_line")


def blocks(parsed: DataFrame) -> DataFrame:
    """One row for each block: counts by level, distinct identifiers, time range, anomalies, validity."""
    low = F.lower("raw_line")
    error = F.col("level") == "ERROR"
    memory = F.lit(False)
    for word in MEMORY_WORDS:
        memory = memory | low.contains(word)
    # what is told of a line goes on, and the line does not
    told = parsed.select(
        "block_id", "ts", "level", "user_id", "order_id", "session_id",
        low.contains("circuit breaker").alias("breaker"), (error & memory).alias("memory"), (error & low.contains("timeout")).alias("timeout"),
    )
    count = lambda c: F.count_if(c)
    base = told.groupBy("block_id").agg(
        F.count(F.lit(1)).alias("total_lines"),
        count(error).alias("error_count"),
        count(F.col("level") == "WARN").alias("warn_count"),
        count(F.col("level") == "INFO").alias("info_count"),
        count(F.col("level").isin("DEBUG", "TRACE")).alias("debug_count"),
        F.count_distinct("user_id").alias("unique_users"),
        F.count_distinct("order_id").alias("unique_orders"),
        F.count_distinct("session_id").alias("unique_sessions"),
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.coalesce(F.bool_or("breaker"), F.lit(False)).alias("circuit_breaker_open"),
        F.coalesce(F.bool_or("memory"), F.lit(False)).alias("memory_warning"),
        (count(F.col("timeout")) >= 3).alias("timeout_pattern"),
        F.round(count(F.col("level") != "UNKNOWN") / F.count(F.lit(1)), 6).alias("format_valid"),
    )
    out = base.join(bursts(parsed).select("block_id", "error_burst"), "block_id", "left")
    return out.withColumn("error_burst", F.coalesce("error_burst", F.lit(False)))


def most_common_error(parsed: DataFrame) -> DataFrame:
    """The exception named by most error lines of a block; at a tie the one seen first."""
    named = parsed.where("level = 'ERROR'").withColumn("name", F.regexp_extract("raw_line", r"([A-Z]\w*Exception)", 1)).where("name <> ''")
    counts = named.groupBy("block_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("line_number").alias("first"))
    best = counts.groupBy("block_id").agg(F.max_by("name", F.struct("n", -F.col("first"))).alias("most_common_error"))
    return best


def preserve_score(b: DataFrame) -> DataFrame:
    """Add the capped weighted score of how much a block is worth keeping."""
    flag = lambda c, w: F.when(F.col(c), w).otherwise(0.0)
    score = (
        F.least(F.lit(0.5), F.col("error_count") * 0.1)
        + F.least(F.lit(0.2), F.col("warn_count") * 0.02)
        + flag("error_burst", 0.2)
        + flag("circuit_breaker_open", 0.15)
        + flag("timeout_pattern", 0.1)
        + flag("memory_warning", 0.15)
        + F.least(F.lit(0.1), F.col("unique_orders") * 0.01)
        + F.when(F.col("unique_users") > 10, 0.05).otherwise(0.0)
    )
    return b.withColumn("preserve_score", F.round(F.least(F.lit(1.0), score), 6))


def block_action(b: DataFrame) -> DataFrame:
    """Add action and sampling rate of scored blocks."""
    s = F.col("preserve_score")
    case = [
        ((F.col("error_count") > 0) & F.col("error_burst"), ("preserve", 1.0)),
        (s >= 0.6, ("sample", 1.0)),
        ((s >= 0.3) | (F.col("warn_count") > 5), ("compress", 0.5)),
        (s >= 0.1, ("sample", 0.1)),
    ]
    return b.withColumn("block_action", first_of([(c, a) for c, (a, _) in case], "discard")).withColumn("sample_rate", first_of([(c, r) for c, (_, r) in case], 0.0))


_RANK = {"waste": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}


def policy(b: DataFrame, ordering: str = "lexical", time_rules: list[tuple[int, int, str]] = ((0, 6, "low"), (9, 18, "medium"))) -> DataFrame:
    """Priority, action, retention and size estimate of each block.

    Rules apply in turn, each raising or lowering the priority found so far.  With
    ``ordering="lexical"`` priorities compare as words, as the established
    behaviour has it; with ``"ranked"`` by importance.
    """
    if ordering not in ("lexical", "ranked"):
        raise ValueError(f"unknown ordering {ordering}")

    def key(c: Column) -> Column:
        return c if ordering == "lexical" else first_of([(c == k, v) for k, v in _RANK.items()])

    def raised(c: Column, when: Column, to: str) -> Column:
        return F.when(when & (key(c) < key(F.lit(to))), F.lit(to)).otherwise(c)

    # each step is a column of its own, so the plan stays a chain and not a tree
    steps = b.withColumn("p", first_of([(F.col("error_count") > 0, "critical"), (F.col("warn_count") > 0, "high")], "medium"))
    steps = steps.withColumn("p", F.when(F.col("error_burst") | F.col("circuit_breaker_open"), F.lit("critical")).otherwise(F.col("p")))
    for flag in ("memory_warning", "timeout_pattern"):
        steps = steps.withColumn("p", raised(F.col("p"), F.col(flag), "high"))
    hour = F.substring("start_time", 12, 2).cast("int")
    rule = first_of([((hour >= a) & (hour < z), p) for a, z, p in time_rules])
    steps = steps.withColumn("rule", rule).withColumn("p", F.when(F.col("rule").isNotNull() & (key(F.col("rule")) > key(F.col("p"))), F.col("rule")).otherwise(F.col("p")))
    steps = steps.withColumn("p", raised(F.col("p"), F.col("unique_orders") > 0, "high"))
    steps = steps.withColumn("p", raised(F.col("p"), F.col("unique_sessions") > 0, "medium"))
    p = F.col("p")
    kept = p.isin("critical", "high")
    rate = first_of([(kept, 1.0), (p == "medium", 0.3), (p == "low", 0.1)], 0.0)
    original = F.col("total_lines") * 500
    size = first_of([(kept, original), (p == "medium", F.floor(F.floor(original * 0.3) * 0.3)), (p == "low", F.floor(original * 0.1 * 0.2))], 0)
    return steps.select(
        "block_id",
        p.alias("priority"),
        first_of([(kept, "preserve_intact"), (p == "medium", "downsample"), (p == "low", "archive")], "delete").alias("action"),
        first_of([(p == "critical", 365), (p == "high", 180), (p == "medium", 90), (p == "low", 30)], 0).alias("retention_days"),
        rate.alias("sampling_rate"),
        original.alias("original_size"),
        size.cast("long").alias("estimated_size"),
    )


def sample_lines(parsed: DataFrame, strategy: str, rate: float, seed: int = 42) -> DataFrame:
    """Lines that a sampling strategy keeps in each block; errors and warnings always stay.

    ``head``, ``tail`` and ``distributed`` take the first, last, or every n-th of
    the other lines; any other strategy takes the share with the smallest hashes.
    """
    if rate >= 1.0:
        return parsed
    if rate <= 0.0:
        return parsed.where("level = 'ERROR'")
    urgent = F.col("level").isin("ERROR", "WARN")
    per_block = Window.partitionBy("block_id", urgent)
    n = F.count(F.lit(1)).over(per_block)
    take = F.floor(n * rate)
    place = lambda *order: F.row_number().over(per_block.orderBy(*order))
    rows = parsed.withColumn("urgent", urgent)
    if strategy == "head":
        keep = place("line_number") <= take
    elif strategy == "tail":
        keep = place(F.col("line_number").desc()) <= F.when(take == 0, n).otherwise(take)
    elif strategy == "distributed":
        keep = (place("line_number") - 1) % int(1 / rate) == 0
    else:
        keep = place(F.md5(F.concat(F.lit(f"{seed}:"), F.col("line_number").cast("string"))), "line_number") <= take
    return rows.withColumn("keep", F.col("urgent") | keep).where("keep").drop("keep", "urgent")


def near_errors(parsed: DataFrame, window: int) -> DataFrame:
    """Lines within ``window / 2`` lines of an error line of their block, by one windowed look at both sides."""
    w = Window.partitionBy("block_id").orderBy("line_number")
    half = window // 2
    rows = parsed.withColumn("i", F.row_number().over(w))
    flag = F.max((F.col("level") == "ERROR").cast("int")).over(Window.partitionBy("block_id").orderBy("i").rowsBetween(-half + 1, half))
    return rows.withColumn("near", flag).where("near = 1").drop("i", "near")
