"""Vectorised text primitives over Arrow string buffers; no per-word Python objects.

Hashes are polynomial hashes modulo 2**64 with an odd base, taken from prefix sums
(a span's sum divided by the power of its start) and then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes that one vectorised step handles; bounds memory at about 100 times that.
PIECE = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, PIECE + 4096)
        with np.errstate(over="ignore"):
            made = []
            for b in (BASE, _INVERSE):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                made.append(np.multiply.accumulate(p))
        _powers = (made[0], made[1])
    return _powers


def lean(run):
    """``run`` of one or two tables, after which a worker's freed memory goes back to the machine; workers live on between stages."""

    def one(table: pa.Table) -> pa.Table:
        return tidied(run(table))

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        return tidied(run(left, right))

    # Spark tells by the number of arguments what to hand over
    return one if run.__code__.co_argcount == 1 else two


def tidied(x):
    """``x``, after freed memory went back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    return x


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix(data: np.ndarray) -> np.ndarray:
    """Running sums of byte times power; length n + 1."""
    p = powers(len(data))[0]
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, dat = column.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if off is not None and off.size else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(dat, np.uint8) if dat is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay under ``limit``; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; none crosses from one text into the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    before[cut] = True
    after[cut - 1] = True
    return np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1


def cuts(data: np.ndarray, gap: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Parts of a text of at most ``limit`` bytes that end after a byte of the table ``gap``, where there is one."""
    at = 0
    while at < len(data):
        end = min(len(data), at + limit)
        here = np.flatnonzero(gap[data[at:end]]) if end < len(data) else np.zeros(0, int)
        end = at + int(here[-1]) + 1 if len(here) else end
        yield at, end
        at = end


def _cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of one long text that end where a word ends."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            gap = np.flatnonzero(SPACE[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:
                while end < n and not SPACE[data[end]]:
                    end += 1
        yield at, end
        at = end


def word_parts(data: np.ndarray, fold_case: bool = True) -> Iterator[np.ndarray]:
    """Hashes of one long text's words, part by part."""
    for a, b in _cuts(data):
        yield _hash_words(data[a:b], np.array([0, b - a]), fold_case)[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold_case: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and where each text's words begin (n + 1)."""
    if len(offsets) == 2 and len(data) > 2 * PIECE:
        h = np.concatenate(list(word_parts(data, fold_case)))
        return h, np.array([0, len(h)])
    return _hash_words(data, offsets, fold_case)


def _hash_words(data: np.ndarray, offsets: np.ndarray, fold_case: bool) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = word_spans(data, offsets)
    sums = prefix(LOWER[data] if fold_case else data)
    return mix(span_hash(sums, starts, ends)), np.searchsorted(starts, offsets)


_STEP = [np.uint64(x | 1) for x in (0xD6E8FEB86659FD92, 0xA0761D6478BD642E, 0xE7037ED1A0B428DA, 0x8EBC6AF09C88C6E2, 0x589965CC75374CC2, 0x1D8E4E27C47D124E)]


def shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each text, not yet distinct.

    A text of fewer words, but at least one, has one shingle: the whole sequence.
    """
    n = len(words)
    if n >= width:
        run = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            run = (run ^ words[k : n - width + 1 + k]) * _STEP[k % len(_STEP)]
            run ^= run >> np.uint64(29)
        run = mix(run)
    else:
        run = np.zeros(0, np.uint64)
    counts = np.diff(bounds)
    full = np.maximum(counts - width + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < width))
    made = full.copy()
    made[short] = 1
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(out_bounds[-1], np.uint64)
    have = np.flatnonzero(full)
    if len(have):
        src = np.repeat(bounds[have] - out_bounds[have], full[have]) + np.flatnonzero(np.repeat(full > 0, made))
        out[np.flatnonzero(np.repeat(full > 0, made))] = run[src]
    for i in short:
        h = np.uint64(counts[i])
        for w in words[bounds[i] : bounds[i + 1]]:
            h = mix(np.array([h ^ w], np.uint64) * _STEP[0])[0]
        out[out_bounds[i]] = h
    return out, out_bounds


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of batches that are sorted by ``keys`` (whole numbers, none null) as tables that cut no group; memory is that of a batch and a group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        differs = np.zeros(n, bool)
        for c in columns:
            differs |= c != c[-1]
        start = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        goes_on = held and not start and all(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() == c[0] for k, c in zip(keys, columns, strict=True))
        if goes_on or not held and not start:
            held.append(batch)
            continue
        done = [*held, batch.slice(0, start)] if start else held
        yield pa.Table.from_batches(done)
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)
