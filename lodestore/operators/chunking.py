"""Cutting contents into chunks: fixed blocks as expressions, content-defined ones over Arrow batches.

Both content-defined rules look at a rolling hash of which only the low bits are
tested, so a cut depends on the last few bytes alone and all candidates of a text
come from a handful of shifted array operations; only the choice among
candidates walks, from cut to cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the two rules.
RABIN_MIN, RABIN_AVG, RABIN_MAX, RABIN_WINDOW = 4096, 32768, 131072, 48
FAST_MIN, FAST_MAX, FAST_WINDOW, FAST_BITS, FAST_TARGET = 2048, 16384, 48, 13, 0x1B8F


def fixed_blocks(files: DataFrame, block: int = 65536, overlap: int = 4096, content: bool = False) -> DataFrame:
    """Blocks of ``block`` bytes that overlap by ``overlap``: file_id, chunk_index, offset, size, fp and, if asked for, the block's bytes as ``content``."""
    step = block - overlap
    rows = files.where(F.octet_length("text") > 0).select("file_id", F.col("text").cast("binary").alias("c"), F.explode(F.sequence(F.lit(0), F.octet_length("text") - 1, F.lit(step))).alias("offset"))
    rows = rows.withColumn("part", F.substr("c", F.col("offset") + 1, F.lit(block)))
    return rows.select("file_id", (F.col("offset") / step).cast("long").alias("chunk_index"), F.col("offset").cast("long"), F.octet_length("part").cast("long").alias("size"), F.sha2("part", 256).alias("fp"), *([F.col("part").alias("content")] if content else []))


def rabin_cuts(data: np.ndarray, shortest: int = RABIN_MIN, mean: int = RABIN_AVG, longest: int = RABIN_MAX) -> list[int]:
    """Starts of the chunks and the end; ``mean`` is a power of two."""
    n = len(data)
    if n < RABIN_WINDOW:
        return [0, n] if n else []
    bits = mean.bit_length() - 1
    # sums wrap, but never in the bits that are tested
    kind = np.uint16 if bits <= 16 else np.uint64
    wide, low = data.astype(kind), np.zeros(n, kind)
    for j in range(bits):
        low[j:] += wide[: n - j] << kind(j)
    at = np.flatnonzero(low & kind(mean - 1) == 0)
    starts = [0]
    for s in (at[at >= RABIN_WINDOW] - RABIN_WINDOW + 1).tolist():
        if s - starts[-1] >= shortest:
            starts.append(s)
    out = []
    for a, z in zip(starts, [*starts[1:], n], strict=True):
        while z - a > longest:
            out.append(a)
            a += longest // 2
        out.append(a)
    return [*out, n]


def fast_cuts(data: np.ndarray, shortest: int = FAST_MIN, longest: int = FAST_MAX, bits: int = FAST_BITS) -> list[int]:
    """Starts of the chunks and the end."""
    n = len(data)
    mask = (1 << bits) - 1
    kind = np.uint16 if bits <= 16 else np.uint64
    wide, low = data.astype(kind), np.zeros(n + 1, kind)
    for j in range(min(bits, n)):
        low[j + 1 :] ^= wide[: n - j] << kind(j)
    at = np.flatnonzero((low & kind(mask)) == kind(FAST_TARGET & mask))
    out, pos = [0] if n else [], 0
    while n - pos > 0:
        k = int(np.searchsorted(at, pos + max(shortest, FAST_WINDOW)))
        limit = min(pos + longest, n)
        cut = int(at[k]) if k < len(at) and at[k] <= limit and at[k] < n else limit
        out.append(cut)
        pos = cut
    return out


CHUNKERS: dict[str, Callable[..., list[int]]] = {"rabin": rabin_cuts, "fast": fast_cuts}


def content_chunks(files: DataFrame, strategy: str, **params: int) -> DataFrame:
    """Content-defined chunks of ``files(file_id, text)``: file_id, chunk_index, offset, size, fp. A null or empty text has none."""
    return _cut(files, strategy, False, params)


#: Bytes of texts whose chunks are handed on at once.
LOT_BYTES = 4 << 20


def content_parts(files: DataFrame, strategy: str, **params: int) -> DataFrame:
    """As :func:`content_chunks`, with each chunk's bytes as ``content``; texts may be binary."""
    return _cut(files, strategy, True, params)


def _cut(files: DataFrame, strategy: str, content: bool, params: dict[str, int]) -> DataFrame:
    if strategy not in CHUNKERS:
        raise ValueError(f"unknown strategy {strategy}")
    cuts_of = CHUNKERS[strategy]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, index, offset, size, fp, parts, held = batch.column(0), [], [], [], [], [], [], 0

            def made() -> pa.RecordBatch:
                columns = [ids.take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (index, offset, size)), pa.array(fp, pa.string())]
                return pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.binary())] * content, ["file_id", "chunk_index", "offset", "size", "fp"] + ["content"] * content)

            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                raw = text.as_py() or b""
                cuts = cuts_of(np.frombuffer(raw, np.uint8), **params)
                rows += [i] * (len(cuts) - 1)
                index += range(len(cuts) - 1)
                offset += cuts[:-1]
                for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                    part = raw[a:z]
                    size.append(z - a)
                    fp.append(hashlib.sha256(part).hexdigest())
                    if content:
                        parts.append(part)
                held += len(raw)
                if held >= LOT_BYTES:
                    yield made()
                    rows, index, offset, size, fp, parts, held = [], [], [], [], [], [], 0
            if rows:
                yield made()

    kind = files.schema["file_id"].dataType.simpleString()
    schema = f"file_id {kind}, chunk_index long, offset long, size long, fp string" + ", content binary" * content
    return files.select("file_id", "text").mapInArrow(run, schema)


# Fixed values of the polynomial fingerprint.
POLY_BASE, POLY_PRIME = 2, 4611686018427387847
#: Bytes that are folded at once; their sum stays under the 53 bits of a double.
_STEP = 40
_PART = _STEP << 14


def polynomial(data: bytes) -> int:
    """The bytes as digits of base POLY_BASE, modulo POLY_PRIME; none give 0."""
    whole = len(data) // _STEP * _STEP
    weights = float(POLY_BASE) ** np.arange(_STEP - 1, -1, -1)
    out = 0
    # as doubles bytes take eight times their room, so a long text is folded part by part
    for at in range(0, whole, _PART):
        for digit in (np.frombuffer(data, np.uint8, min(_PART, whole - at), at).reshape(-1, _STEP) @ weights).tolist():
            out = (out * POLY_BASE**_STEP + int(digit)) % POLY_PRIME
    for byte in data[whole:]:
        out = (out * POLY_BASE + byte) % POLY_PRIME
    return out


def polynomial_fingerprints(files: DataFrame) -> DataFrame:
    """file_id and fp, the :func:`polynomial` fingerprint of all bytes of ``files(file_id, text)``; null for a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a text is taken out when its turn comes, so a batch has no second copy
            found = [None if not x.is_valid else polynomial(x.as_py()) for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["file_id", "fp"])

    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "text").mapInArrow(run, f"file_id {kind}, fp long")


def chunker(strategy: str, **params: int) -> Callable[[DataFrame], DataFrame]:
    """A function from files to chunks, by name: fixed, rabin or fast."""
    if strategy == "fixed":
        return lambda files: fixed_blocks(files, **params)
    return lambda files: content_chunks(files, strategy, **params)
