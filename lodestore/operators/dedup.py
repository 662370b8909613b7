"""Chunk deduplication: first sightings, references, ratios, bloom filters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sightings(chunks: DataFrame, uniques: int = 1) -> DataFrame:
    """Add seen (the how manieth sighting of its fingerprint) and is_unique.

    ``uniques=2`` counts the first two sightings as unique, as a lookup that
    caches only on the second one does.
    """
    w = Window.partitionBy("fp").orderBy("file_id", "chunk_index")
    rows = chunks.withColumn("seen", F.row_number().over(w).cast("long"))
    return rows.withColumn("is_unique", F.col("seen") <= uniques)


def first_sightings(chunks: DataFrame) -> DataFrame:
    """Add is_unique for the first sighting of each fingerprint only; one very common chunk is no hot spot."""
    firsts = chunks.groupBy("fp").agg(F.min(F.struct("file_id", "chunk_index")).alias("first"))
    return chunks.join(firsts, "fp").withColumn("is_unique", F.struct("file_id", "chunk_index") == F.col("first")).drop("first")


def by_file(chunks: DataFrame, uniques: int = 1) -> DataFrame:
    """Per file: chunks, unique ones, bytes in all and stored, share saved."""
    rows = (first_sightings(chunks) if uniques == 1 else sightings(chunks, uniques)).groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_unique").alias("n_unique"), F.sum("size").alias("bytes"), F.sum(F.when(F.col("is_unique"), F.col("size")).otherwise(0)).alias("stored")
    )
    return rows.withColumn("saved", F.round(1 - F.col("stored") / F.col("bytes"), 6))


def totals(chunks: DataFrame) -> DataFrame:
    """Chunks, distinct ones, mean references, bytes, bytes once, and the factor between them."""
    once = chunks.groupBy("fp").agg(F.count(F.lit(1)).alias("k"), F.max("size").alias("size"))
    rows = once.agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_unique"), F.sum(F.col("k") * F.col("size")).alias("bytes"), F.sum("size").alias("stored"))
    return rows.withColumn("mean_refs", F.round(F.col("n") / F.col("n_unique"), 6)).withColumn("factor", F.round(F.col("bytes") / F.col("stored"), 6))


def bloom_shape(capacity: int, error: float) -> tuple[int, int]:
    """Bits and hash functions of a filter."""
    bits = int(-capacity * math.log(error) / math.log(2) ** 2)
    return bits, max(1, int(bits / capacity * math.log(2)))


def _remainder(digits: Column, pieces: int, bits: int) -> Column:
    """A hexadecimal number of ``pieces`` times eight digits modulo ``bits``, folded from the left in 64-bit steps."""
    piece = lambda i: F.conv(F.substring(digits, F.lit(8) * i + 1, F.lit(8)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(pieces - 1)), F.lit(0).cast("long"), lambda acc, i: F.pmod(acc * F.lit(1 << 32) + piece(i), F.lit(bits)))


def bloom_positions(item: Column, capacity: int, error: float) -> Column:
    """The bits of a filter that an item sets: two digests, the second added again and again. Null for a null item."""
    bits, hashes = bloom_shape(capacity, error)
    if bits >= 1 << 31:
        raise ValueError("a filter has fewer than 2 ** 31 bits")
    raw = item.cast("binary")
    pair = F.struct(_remainder(F.sha2(raw, 256), 8, bits).alias("a"), _remainder(F.md5(raw), 4, bits).alias("b"))
    # the pair is bound once and not written out for each bit
    return F.when(item.isNotNull(), F.flatten(F.transform(F.array(pair), lambda h: F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(h["a"] + i * h["b"], F.lit(bits))))))


def bloom_words(items: DataFrame, column: str, capacity: int, error: float) -> DataFrame:
    """The filter as rows (word, bits) of 63 bits; partial filters merge by ``bit_or``."""
    at = items.select(F.explode(bloom_positions(F.col(column), capacity, error)).alias("p"))
    bit = F.expr("shiftleft(1L, cast(p % 63 as int))")
    return at.select(F.floor(F.col("p") / 63).cast("long").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def bloom_count(words: DataFrame, capacity: int, error: float) -> DataFrame:
    """Estimated number of items, from the share of set bits."""
    bits, hashes = bloom_shape(capacity, error)
    m = (bits + 7) // 8 * 8
    return words.agg(F.sum(F.bit_count("bits")).alias("x")).select(F.floor(-m * F.log(1 - F.col("x") / m) / hashes).alias("estimate"))


def _bloom_joined(keys: DataFrame, column: str, words: DataFrame, capacity: int, error: float) -> DataFrame:
    at = keys.select(F.col(column).alias("bloom key")).where(F.col(column).isNotNull()).distinct().select("bloom key", F.explode(bloom_positions(F.col("bloom key"), capacity, error)).alias("p"))
    asked = at.select("bloom key", F.floor(F.col("p") / 63).cast("long").alias("word"), F.expr("shiftleft(1L, cast(p % 63 as int))").alias("bit"))
    hit = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    told = asked.join(words, "word", "left").groupBy("bloom key").agg(F.bool_and(hit).alias("maybe"))
    return keys.join(told, F.col(column) == F.col("bloom key"), "left").select(*[F.col(f"`{c}`") for c in keys.columns], F.coalesce("maybe", F.lit(False)).alias("maybe"))


def bloom_probe(keys: DataFrame, column: str, words: DataFrame, capacity: int, error: float, limit: int = 1 << 24) -> DataFrame:
    """Add ``maybe``: whether the filter may hold the key; false for a null one.

    A filter of at most ``limit`` bits is sent to all tasks.  The words of a larger one are
    joined to the positions of the distinct keys.
    """
    bits, hashes = bloom_shape(capacity, error)
    if bits > limit:
        return _bloom_joined(keys, column, words, capacity, error)
    table = np.zeros(bits // 63 + 1, np.int64)
    for row in words.collect():  # no more rows than the filter has words
        table[row["word"]] = row["bits"]
    names = keys.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positions = batch.column(len(names))
            there = positions.is_valid().to_numpy(zero_copy_only=False)
            at = positions.drop_null().flatten().to_numpy().reshape(-1, hashes)
            maybe = np.zeros(len(there), bool)
            maybe[there] = (table[at // 63] >> (at % 63) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(maybe)], [*names, "maybe"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields)
    probes = keys.select("*", bloom_positions(F.col(column), capacity, error).alias("bloom positions"))
    return probes.mapInArrow(run, f"{schema}, maybe boolean")
