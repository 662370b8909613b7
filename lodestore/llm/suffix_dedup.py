"""Removal of byte strings that an earlier document already holds, over sorted sampled suffixes.

Every string of ``SPAN`` bytes picks one of its k-mers, the one with the smallest
hash, as its anchor; equal strings pick alike.  So only suffixes that begin at
anchors need sorting: about one byte in fifteen.  A run of neighbouring strings
with the same anchor is one piece of text: the suffix at its anchor, as far as its
strings reach, and what stands before it.

1. Documents are dealt into buckets of bounded size.  Each bucket reports the
   hashes of its anchors; those that two documents hold are reported back.  This
   leaves suffixes out that stand alone and decides nothing else.
2. Each bucket hands on its different pieces with a shared anchor, each with its
   smallest document.  Sampled splitters range-partition them by the anchor's bytes.
3. Each range sorts its suffixes by multikey quicksort.  Neighbours that are equal to
   the last byte are one piece, held first by its smallest document.  Where one
   anchor has several pieces, all their strings are sorted likewise, to all 50 bytes,
   and equal neighbours give each string its smallest document.
4. An anchor with more pieces than HOT_LEAD (the rim of a very common line) is no
   task's own: its strings are range-partitioned by their own bytes and document.
   There equal strings may be cut by a boundary, so ranges exchange their edges: the
   first string of a range is compared with the last ones of the ranges before it.
5. Buckets cut the bytes out.

Hashes leave out and order; whatever is cut was found equal byte by byte.  What is
sent for a passage grows with the buckets that hold it, not with its copies, so a
passage that a third of all documents share is no hot spot.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .common import Stored, parts_for, release, shuffle_partitions, text_bytes

SPAN = 50
KMER = 20
#: Bytes of text in a bucket, on average, and buckets that one task goes through.
BUCKET, BUCKETS_A_TASK = 4 << 20, 8
#: Pieces of one anchor that a task compares; those of a commoner one are dealt by their strings.
HOT_LEAD = 100_000
#: Pieces handed on in one row; one piece in so many is looked at for splitters and common anchors; splitters at most.
LOT, SAMPLED, SPLITTERS = 1 << 16, 64, 4096
_WINDOW = SPAN - KMER + 1
_POSITION = np.uint64((1 << 22) - 1)


def pieces_of(data: np.ndarray, offsets: np.ndarray):
    """Runs of strings with one anchor, of at most a few MB of concatenated texts.

    Returns start, number of strings, text index, anchor position, anchor hash
    and hash of the whole run's bytes.
    """
    n = len(data)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n < SPAN:
        return none
    valid = np.ones(n - SPAN + 1, bool)
    for b in offsets[1:-1]:
        valid[max(0, b - SPAN + 1) : b] = False
    if not valid.any():
        return none
    sums = kernel.prefix(data)
    at = np.arange(n - KMER + 1)
    hashes = kernel.mix((sums[KMER:] - sums[:-KMER]) * kernel.powers(n)[1][at])
    low = (hashes & ~_POSITION) | at.astype(np.uint64)
    width = 1
    while width * 2 <= _WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = _WINDOW - width
    low = np.minimum(low[: len(low) - rest], low[rest:])
    anchor = (low & _POSITION).astype(np.int64)
    change = np.empty(len(anchor), bool)
    change[0] = True
    change[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    last = np.empty(len(anchor), bool)
    last[-1] = True
    last[:-1] = change[1:] | ~valid[1:]
    start = np.flatnonzero(change & valid)
    end = np.flatnonzero(last & valid)
    count = end - start + 1
    owner = np.searchsorted(offsets, start, "right") - 1
    place = anchor[start]
    whole = kernel.mix(kernel.span_hash(sums, start, start + count + SPAN - 1) + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (place - start).astype(np.uint64))
    return start, count, owner, place, hashes[place], whole


def walk(data: np.ndarray, offsets: np.ndarray):
    """``pieces_of`` over all texts of a bucket, with places counted in ``data``; long texts in overlapping parts."""
    for i, j in kernel.pieces(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= 2 * kernel.PIECE:
            start, count, owner, place, anchor, whole = pieces_of(data[lo:hi], offsets[i : j + 1] - lo)
            yield start + lo, count, owner + i, place + lo, anchor, whole
            continue
        for at in range(lo, hi, kernel.PIECE):
            stop = min(hi, at + kernel.PIECE + SPAN - 1)
            start, count, owner, place, anchor, whole = pieces_of(data[at:stop], np.array([0, stop - at]))
            yield start + at, count, owner + i, place + at, anchor, whole


class Bucket:
    """Ids, texts and pieces of one bucket, in the order of ids."""

    def __init__(self, table: pa.Table):
        self.table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        self.ids = self.table.column("id").to_numpy()
        self.data, self.offsets = kernel.strings(self.table.column("text"))
        made = list(zip(*walk(self.data, self.offsets), strict=True)) or [[np.zeros(0, np.int64)]] * 4 + [[np.zeros(0, np.uint64)]] * 2
        self.start, self.count, owner, self.place, anchor, self.whole = (np.concatenate(x) for x in made)
        self.doc = self.ids[owner]
        self.anchor = anchor & _LOW

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor hashes, and which of them two documents hold."""
        order = np.lexsort((self.doc, self.anchor))
        h, o = self.anchor[order], self.doc[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
        end = np.concatenate([at[1:], [len(h)]])[: len(at)] - 1
        return h[at], o[at] != o[end]

    def shared(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pieces with an anchor in the sorted ``wanted``: their indices, the number of the different piece that each is, and the index of each different one at its smallest document.

        Hashes order the pieces, bytes tell them apart; numbers follow the text.
        """
        at = np.flatnonzero(_member(wanted, self.anchor))
        at = at[np.lexsort((self.start[at], self.doc[at], self.whole[at]))]
        same = np.zeros(len(at), bool)
        same[1:] = self.whole[at[1:]] == self.whole[at[:-1]]
        pair = np.flatnonzero(same)
        same[pair] = self._equal(at[pair], at[pair - 1])
        first = np.flatnonzero(~same)
        number = np.empty(len(first), np.int64)
        by_text = np.argsort(self.start[at[first]], kind="stable")
        number[by_text] = np.arange(len(first))
        return at, number[np.cumsum(~same) - 1], at[first[by_text]]

    def _equal(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of two lists of pieces are the same bytes with the same anchor."""
        out = (self.count[x] == self.count[y]) & (self.place[x] - self.start[x] == self.place[y] - self.start[y])
        words = _words(self.data)
        end = self.start[x] + self.count[x] + SPAN - 1, self.start[y] + self.count[y] + SPAN - 1
        for k in range(0, SPAN + _WINDOW, 8):
            out &= _token(words, self.start[x] + k, end[0], 8) == _token(words, self.start[y] + k, end[1], 8)
        return out


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, first byte highest; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))


def _token(words: np.ndarray, at: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Up to ``width`` bytes from each place, but none from its end on."""
    left = np.clip(end - at, 0, width).astype(np.uint64)
    value = words[np.minimum(at, len(words) - 1)].astype(np.uint64)
    return np.where(left == 0, np.uint64(0), value >> (np.uint64(8) * (np.uint64(8) - np.maximum(left, np.uint64(1))))  << (np.uint64(8) * (np.uint64(8) - np.maximum(left, np.uint64(1)))))


def _six(values: np.ndarray) -> bytes:
    """The low six bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(blob: bytes) -> np.ndarray:
    raw = np.zeros((len(blob) // 6, 8), np.uint8)
    raw[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return raw.reshape(-1).view("<u8")


_LOW = np.uint64((1 << 48) - 1)


def _report(dests: int):
    def run(table: pa.Table) -> pa.Table:
        b = table.column("b")[0].as_py()
        h, _ = Bucket(table).anchors()
        cut = np.searchsorted((h >> np.uint64(16)) * np.uint64(dests) >> np.uint64(32), np.arange(dests + 1))
        some = np.flatnonzero(np.diff(cut))
        return pa.table({"d": pa.array(some, pa.int32()), "b": pa.array([b] * len(some), pa.int32()), "anchors": pa.array([_six(h[cut[d] : cut[d + 1]]) for d in some], pa.binary())})

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of one range of hashes: for each bucket the anchors that another bucket holds too."""
    buckets = table.column("b").to_numpy()
    blobs = [_from_six(x) for x in table.column("anchors").to_pylist()]
    h = np.concatenate(blobs)
    order = np.argsort(h, kind="stable")
    s = h[order]
    twin = np.zeros(len(s), bool)
    twin[1:] = s[1:] == s[:-1]
    twin[:-1] |= twin[1:].copy()
    keep = np.zeros(len(h), bool)
    keep[order] = twin
    rows, at = [], 0
    for b, blob in zip(buckets, blobs, strict=True):
        k = blob[keep[at : at + len(blob)]]
        at += len(blob)
        if len(k):
            rows.append((b, _six(k)))
    return pa.table({"b": pa.array([r[0] for r in rows], pa.int32()), "shared": pa.array([r[1] for r in rows], pa.binary())})


def _member(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``table``."""
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


class Pieces:
    """Pieces of text one after the other: bytes, lengths, places of the anchors in them, documents, buckets and their numbers there."""

    NAMES = {"text": np.uint8, "sizes": np.uint8, "places": np.uint8, "docs": np.int64, "buckets": np.int32, "numbers": np.int32}
    SCHEMA = "text binary, sizes binary, places binary, docs binary, buckets binary, numbers binary"

    def __init__(self, text, sizes, places, docs, buckets, numbers):
        self.text, self.sizes, self.places, self.docs, self.buckets, self.numbers = text, sizes, places, docs, buckets, numbers
        self.end = np.cumsum(sizes, dtype=np.int64)
        self.start = self.end - sizes
        self.anchor = self.start + places

    @classmethod
    def of_table(cls, table) -> Pieces:
        return cls(*(np.frombuffer(b"".join(x for x in table.column(c).to_pylist()), t) for c, t in cls.NAMES.items()))

    def take(self, at: np.ndarray) -> Pieces:
        size = self.sizes[at].astype(np.int64)
        to = np.cumsum(size) - size
        text = self.text[np.repeat(self.start[at] - to, size) + np.arange(size.sum())]
        return Pieces(text, self.sizes[at], self.places[at], self.docs[at], self.buckets[at], self.numbers[at])

    def row(self) -> list[bytes]:
        return [getattr(self, c).astype(t).tobytes() for c, t in self.NAMES.items()]

    def leads(self) -> np.ndarray:
        """The anchors' bytes, as strings of fixed width."""
        return np.ascontiguousarray(self.text[self.anchor[:, None] + np.arange(KMER)]).view(f"S{KMER}").reshape(-1)


def _claim(left: pa.Table, right: pa.Table) -> pa.Table:
    """The different pieces of one bucket whose anchor another document holds too, and a row with these anchors."""
    rows = []
    if left.num_rows:
        bucket, b = Bucket(left), left.column("b")[0].as_py()
        own, several = bucket.anchors()
        wanted = np.unique(np.concatenate([*(_from_six(x) for x in right.column("shared").to_pylist()), own[several]]))
        _, _, first = bucket.shared(wanted)
        rows.append([None] * len(Pieces.NAMES) + [b, _six(wanted)])
        for at in range(0, len(first), LOT):
            i = first[at : at + LOT]
            size = bucket.count[i] + SPAN - 1
            to = np.cumsum(size) - size
            text = bucket.data[np.repeat(bucket.start[i] - to, size) + np.arange(size.sum())]
            rows.append([*Pieces(text, size, bucket.place[i] - bucket.start[i], bucket.doc[i], np.full(len(i), b), at + np.arange(len(i))).row(), None, None])
    columns = [pa.array([r[k] for r in rows], pa.binary()) for k in range(len(Pieces.NAMES))]
    return pa.table([*columns, pa.array([r[-2] for r in rows], pa.int32()), pa.array([r[-1] for r in rows], pa.binary())], [*Pieces.NAMES, "b", "shared"])


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leads of one piece in SAMPLED, by its bytes' hash, so that of every anchor the same share of different pieces is seen."""
    for batch in batches:
        for i in range(batch.num_rows):
            p = Pieces.of_table(batch.slice(i, 1))
            hashes = kernel.mix(kernel.span_hash(kernel.prefix(p.text), p.start, p.end))
            seen = np.flatnonzero(hashes % np.uint64(SAMPLED) == 0)
            yield pa.RecordBatch.from_arrays([pa.array(p.take(seen).leads().astype(object), pa.binary()), pa.array(hashes[seen].view(np.int64))], ["lead", "piece"])


class Ranges:
    """Splitters between the ranges of leads, and the leads that have ranges of their own.

    More ranges than splitters are made by a hash of the lead inside each; equal
    leads stay together.
    """

    def __init__(self, leads: list[bytes], common: list[bytes], wanted: int):
        every = np.sort(np.array(leads, f"S{KMER}"))
        cuts = min(wanted, SPLITTERS)
        self.splitters = every[np.arange(1, cuts) * len(every) // cuts] if len(every) else every
        self.inside = math.ceil(wanted / cuts)
        self.common = np.sort(np.array(common, f"S{KMER}"))
        self.wanted = wanted

    def deal(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p = Pieces.of_table(batch.slice(i, 1))
                leads = p.leads()
                r = np.searchsorted(self.splitters, leads, "right").astype(np.int64)
                sums = kernel.prefix(p.text)
                if self.inside > 1:
                    r = r * self.inside + (kernel.mix(kernel.span_hash(sums, p.anchor, p.anchor + KMER)) % np.uint64(self.inside)).astype(np.int64)
                hot = _member(self.common, leads)
                if hot.any():  # equal pieces still meet
                    r[hot] = -1 - (kernel.mix(kernel.span_hash(sums, p.start[hot], p.end[hot])) % np.uint64(self.wanted)).astype(np.int64)
                order = np.argsort(r, kind="stable")
                names, first = np.unique(r[order], return_index=True)
                rows = [p.take(x).row() for x in np.split(order, first[1:])] if len(order) else []
                yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array([x[k] for x in rows], pa.binary()) for k in range(len(Pieces.NAMES)))], ["r", *Pieces.NAMES])


def multikey_order(n: int, token: Callable[[int, np.ndarray], np.ndarray], levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``n`` items by ``token(level, items)``, level by level, and for each place the first level at which its item differs from the one before (``levels`` if none).

    A level's tokens are read only for items that still tie with a neighbour.
    """
    order, depth = np.arange(n), np.full(n, levels)
    depth[:1] = 0
    tied, group = np.arange(n), np.zeros(n, np.int64)
    for k in range(levels):
        if not len(tied):
            break
        item = order[tied]
        key = token(k, item)
        by = np.lexsort((key, group))
        order[tied] = item[by]
        key = key[by]
        split = np.zeros(len(tied), bool)
        split[1:] = (key[1:] != key[:-1]) & (group[1:] == group[:-1])
        depth[tied[split]] = k
        # what differs from both neighbours is in its place
        new = np.concatenate([[True], (group[1:] != group[:-1]) | split[1:]])
        alone = new & np.concatenate([new[1:], [True]])
        group = np.cumsum(new)[~alone]
        tied = tied[~alone]
    return order, depth


def _firsts(order: np.ndarray, depth: np.ndarray, level: int, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run of items equal up to ``level`` that each place belongs to, and each run's smallest document."""
    head = depth < level
    return np.cumsum(head) - 1, np.minimum.reduceat(doc[order], np.flatnonzero(head))


_CUTS = [0, 8, 16, KMER, 28, 36, 44, 52, 60, 68, 76, 84]


def order_pieces(p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Pieces in the order of their suffixes from the anchor on, then of what stands before it, then of lengths; level 3 on have the same lead, level 17 are equal."""
    words = _words(p.text)

    def token(k: int, i: np.ndarray) -> np.ndarray:
        if k < 11:
            return _token(words, p.anchor[i] + _CUTS[k], p.end[i], _CUTS[k + 1] - _CUTS[k])
        if k < 15:
            return _token(words, p.start[i] + 8 * (k - 11), p.anchor[i], 8)
        return (p.sizes if k == 15 else p.places)[i].astype(np.uint64)

    return multikey_order(len(p.sizes), token, 17)


def order_strings(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings of SPAN bytes from each place on, in order; level 7 are equal."""
    words = _words(text)
    return multikey_order(len(at), lambda k, i: _token(words, at[i] + 8 * k, at[i] + SPAN, 8), 7)


def _strings(p: Pieces, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of some pieces: the piece, the number in it and the place."""
    count = p.sizes[i].astype(np.int64) - SPAN + 1
    piece = np.repeat(i, count)
    j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return piece, j, p.start[piece] + j


def judge(p: Pieces, apart: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each piece a bit for each of its strings that a smaller document holds; and the different pieces that must be compared by their strings (and were, unless ``apart``)."""
    n = len(p.sizes)
    order, depth = order_pieces(p)
    run, least = _firsts(order, depth, 17, p.docs)
    bits = np.zeros(n, np.uint32)
    later = p.docs[order] > least[run]
    every = ((np.uint64(1) << (p.sizes.astype(np.uint64) - np.uint64(SPAN - 1))) - np.uint64(1)).astype(np.uint32)
    bits[order[later]] = every[order[later]]
    holder, of_run = order[~later], run[~later]
    lead = (np.cumsum(depth < 3) - 1)[depth < 17]
    open_ = holder[(np.bincount(lead)[lead] > 1)[of_run]]
    if apart:
        return bits, holder
    piece, j, at = _strings(p, open_)
    if len(at):
        order, depth = order_strings(p.text, at)
        run, least = _firsts(order, depth, 7, p.docs[piece])
        cut = order[least[run] < p.docs[piece[order]]]
        np.bitwise_or.at(bits, piece[cut], np.uint32(1) << j[cut].astype(np.uint32))
    return bits, open_


_REPLY = "b int, numbers binary, bits binary"


def _replies(p: Pieces, bits: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    at = np.flatnonzero(bits)
    at = at[np.argsort(p.buckets[at], kind="stable")]
    names, first = np.unique(p.buckets[at], return_index=True)
    return [(int(b), p.numbers[i].tobytes(), bits[i].tobytes()) for b, i in zip(names, np.split(at, first[1:]), strict=True)] if len(at) else []


def _judge(table: pa.Table) -> pa.Table:
    """One range of leads: replies (bucket, numbers of pieces, bits of the strings to cut)."""
    p = Pieces.of_table(table)
    rows = _replies(p, judge(p, False)[0])
    return pa.table({"b": pa.array([r[0] for r in rows], pa.int32()), "numbers": pa.array([r[1] for r in rows], pa.binary()), "bits": pa.array([r[2] for r in rows], pa.binary())})


_STRING = "string binary, doc long, b int, number int, j int"


def _judge_common(table: pa.Table) -> pa.Table:
    """Some pieces of common leads: replies for the copies, and the strings of all others."""
    p = Pieces.of_table(table)
    bits, holder = judge(p, True)
    rows = _replies(p, bits)
    piece, j, at = _strings(p, holder)
    text = p.text[at[:, None] + np.arange(SPAN)]
    none, m = [None] * len(rows), len(at)
    return pa.table(
        {
            "string": pa.array([*none, *np.ascontiguousarray(text).view(f"V{SPAN}").reshape(-1).tolist()], pa.binary()),
            "doc": pa.array([*none, *p.docs[piece].tolist()], pa.int64()),
            "b": pa.array([*(r[0] for r in rows), *p.buckets[piece].tolist()], pa.int32()),
            "number": pa.array([*none, *p.numbers[piece].tolist()], pa.int32()),
            "j": pa.array([*none, *j.tolist()], pa.int32()),
            "numbers": pa.array([*(r[1] for r in rows), *[None] * m], pa.binary()),
            "bits": pa.array([*(r[2] for r in rows), *[None] * m], pa.binary()),
        }
    )


def _sorted_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of strings and documents: strings with a smaller document in it (``kind`` 0), those of its first string that have none (1) and its last string with its smallest document here (2)."""
    held = list(batches)
    table = pa.Table.from_batches(held) if held else None
    if table is None or not table.num_rows:
        return
    text, offsets = kernel.strings(table.column("string"))
    doc = table.column("doc").to_numpy()
    order, depth = order_strings(text, offsets[:-1])
    run, least = _firsts(order, depth, 7, doc)
    later = least[run] < doc[order]
    kind = np.where(later, 0, np.where(run == 0, 1, -1))
    out = table.take(pa.array(order)).append_column("kind", pa.array(kind.astype(np.int32)))
    yield from out.filter(pa.array(kind >= 0)).to_batches()
    edge = order[-1:]
    last = table.take(pa.array(edge)).set_column(1, "doc", pa.array([int(least[-1])], pa.int64()))
    yield from last.append_column("kind", pa.array([2], pa.int32())).to_batches()


def compare_across(strings: DataFrame, parts: int) -> DataFrame:
    """Bits of the strings to cut, by bucket and number, of ``strings`` held by few or many documents: sorted in ranges that exchange their edges."""
    ranged = strings.repartitionByRange(parts, "string", "doc").mapInArrow(_sorted_strings, _STRING + ", kind int")
    held = Stored(ranged, "sorted-strings").df
    # the ranges ascend by string and document, so the first range that ends with a string has its smallest document
    edges = held.where("kind = 2").groupBy("string").agg(F.min("doc").alias("first"))
    across = held.where("kind = 1").join(edges, "string").where("first < doc")
    cut = held.where("kind = 0").select("b", "number", "j").unionByName(across.select("b", "number", "j"))
    return cut.groupBy("b", "number").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("bits"))


def _pack_replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b = batch.column(0).to_numpy()
        numbers = batch.column(1).to_numpy().astype(np.int32)
        bits = batch.column(2).to_numpy().astype(np.uint32)
        order = np.argsort(b, kind="stable")
        names, first = np.unique(b[order], return_index=True)
        lots = np.split(order, first[1:]) if len(order) else []
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([numbers[i].tobytes() for i in lots], pa.binary()), pa.array([bits[i].tobytes() for i in lots], pa.binary())], ["b", "numbers", "bits"])


def _without_torn(data: np.ndarray, removed: np.ndarray) -> np.ndarray:
    """``removed`` and all other bytes of every character that it cuts into; the texts are valid UTF-8."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(first):
        return removed
    return np.repeat(np.bitwise_or.reduceat(removed, first), np.diff(np.append(first, len(data))))


def _cut(left: pa.Table, right: pa.Table, whole_characters: bool) -> pa.Table:
    bucket = Bucket(left)
    data, offsets = bucket.data, bucket.offsets
    at, number, first = bucket.shared(_from_six(b"".join(x for x in right.column("shared").to_pylist() if x)))
    bits = np.zeros(len(first), np.uint32)
    told = right.filter(right.column("numbers").is_valid())
    if told.num_rows:
        numbers, masks = (np.frombuffer(b"".join(told.column(c).to_pylist()), t) for c, t in (("numbers", np.int32), ("bits", np.uint32)))
        np.bitwise_or.at(bits, numbers, masks)
    start, count, doc = bucket.start[at], bucket.count[at], bucket.doc[at]
    # in this bucket, all but the smallest document of a piece hold it after another one
    every = doc > bucket.doc[first][number] if len(first) else np.zeros(0, bool)
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, start[every], 1)
    np.add.at(edge, start[every] + count[every] + SPAN - 1, -1)
    some = ~every & (bits[number] != 0) if len(first) else every
    start, mask = start[some], bits[number[some]]
    for j in range(_WINDOW):
        on = start[(mask >> np.uint32(j)) & np.uint32(1) == 1] + j
        np.add.at(edge, on, 1)
        np.add.at(edge, on + SPAN, -1)
    removed = np.cumsum(edge[:-1]) > 0
    if whole_characters:
        removed = _without_torn(data, removed)
    spans, kept = [], []
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        r = removed[a:z]
        turn = np.flatnonzero(np.diff(np.concatenate([[0], r.astype(np.int8), [0]]))).tolist()
        spans.append([{"start": x, "end": y} for x, y in zip(turn[::2], turn[1::2], strict=True)])
        kept.append(data[a:z][~r].tobytes())
    more = {c: bucket.table.column(c) for c in bucket.table.column_names if c.startswith("keep_")}
    return pa.table(
        {
            "id": pa.array(bucket.ids),
            "n_bytes": pa.array(np.diff(offsets)),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept": pa.array(kept, pa.binary()),
            **more,
        }
    )


def _tasks(spark: SparkSession, groups: int) -> int:
    return max(min(groups, shuffle_partitions(spark)), math.ceil(groups / BUCKETS_A_TASK))


def _compared(spark: SparkSession, claims: DataFrame) -> DataFrame:
    """Replies to the buckets for all pieces that they claim."""
    seen = Stored(claims.mapInArrow(_leads, "lead binary, piece long").distinct(), "leads").df
    n_seen = seen.count()
    nbytes = n_seen * SAMPLED * (SPAN + _WINDOW)
    ranges = max(1, math.ceil(nbytes / BUCKET), min(shuffle_partitions(spark), math.ceil(nbytes / (1 << 20))))
    # no more leads than so many splitters need, and no more common ones than a share of the pieces allows
    sample = seen.where(F.pmod(F.xxhash64("piece"), F.lit(max(1, n_seen // (32 * SPLITTERS)))) == 0).select("lead").toArrow().column(0).to_pylist()
    common = seen.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * SAMPLED > HOT_LEAD).orderBy(F.desc("n")).limit(1 << 16).select("lead").toArrow().column(0).to_pylist() if n_seen * SAMPLED > HOT_LEAD else []
    dealt = claims.mapInArrow(Ranges(sample, common, ranges).deal, "r long, " + Pieces.SCHEMA).repartition(_tasks(spark, ranges), "r")
    if not common:
        return dealt.groupBy("r").applyInArrow(kernel.lean(_judge), _REPLY)
    ranged = Stored(dealt, "ranges").df
    replies = ranged.where("r >= 0").groupBy("r").applyInArrow(kernel.lean(_judge), _REPLY)
    apart = Stored(ranged.where("r < 0").groupBy("r").applyInArrow(_judge_common, f"{_STRING}, numbers binary, bits binary"), "common-leads").df
    strings = apart.where("string is not null").select("string", "doc", "b", "number", "j")
    parts = max(1, math.ceil(strings.count() * SPAN / BUCKET))
    across = compare_across(strings, parts).mapInArrow(_pack_replies, _REPLY)
    return replies.unionByName(apart.where("numbers is not null").select("b", "numbers", "bits")).unionByName(across)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """What to cut so that no string of 50 bytes stays that also starts in a document with a smaller id.

    Texts are taken as UTF-8 bytes, whole; strings are judged on the input and
    never cross documents.  Returns id, n_bytes, spans (maximal removed runs as
    byte ranges ``start``, ``end``), kept (the bytes that stay) and the columns that
    ``keep`` names.  With ``whole_characters``
    the bytes left of a character that is cut into go too.  A null or
    empty text, or one under 50 bytes, loses nothing.  Rows with the same id
    count as one document that repeats itself, which is no reason to cut.  Null
    ids count as larger than all others and come back as null.  Empty input: no
    rows.  Columns not named are not read.  Ids are integers.
    """
    spark = docs.sparkSession
    nbytes = text_bytes(docs, text_col)
    buckets = parts_for(spark, nbytes, BUCKET)
    top = (1 << 63) - 1
    columns = [
        F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col))), F.lit(buckets)).cast("int").alias("b"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(top)).alias("id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    ]
    tasks = _tasks(spark, buckets)
    rows = docs.select(*columns).repartition(tasks, "b").groupBy("b")
    dests = parts_for(spark, nbytes // 3, BUCKET)
    reports = rows.applyInArrow(kernel.lean(_report(dests)), "d int, b int, anchors binary")
    told = reports.groupBy("d").applyInArrow(_shared, "b int, shared binary")
    claims = Stored(rows.cogroup(told.groupBy("b")).applyInArrow(kernel.lean(_claim), Pieces.SCHEMA + ", b int, shared binary"), "pieces")
    release(spark)
    told = Stored(_compared(spark, claims.df.where("b is null").select(*Pieces.NAMES)), "repeats")
    shared = Stored(claims.df.where("b is not null").select("b", "shared"), "shared-anchors")
    claims.drop()
    release(spark)
    null = lambda kind: F.lit(None).cast(kind)
    reply = shared.df.select("b", "shared", null("binary").alias("numbers"), null("binary").alias("bits")).unionByName(told.df.select("b", null("binary").alias("shared"), "numbers", "bits"))
    more = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    spans = T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType()))
    schema = T.StructType().add("id", T.LongType()).add("n_bytes", T.LongType()).add("spans", spans).add("kept", T.BinaryType())
    for i, c in enumerate(keep):
        schema = schema.add(f"keep_{i}", docs.schema[c].dataType)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        return _cut(left, right, whole_characters)

    out = docs.select(*columns, *more).repartition(tasks, "b").groupBy("b").cogroup(reply.groupBy("b")).applyInArrow(kernel.lean(cut), schema)
    return out.select(F.when(F.col("id") != top, F.col("id")).alias(id_col), "n_bytes", "spans", "kept", *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])
