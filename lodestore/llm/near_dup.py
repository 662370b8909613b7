"""Near duplicates by HyperMinHash sketches.

A text's shingles are dealt into buckets; a bucket keeps the smallest hash seen as
a register of its leading-zero count and some mantissa bits.  Empty buckets borrow
from others by fixed rules, so texts with few shingles compare as well.  Bands of
registers propose pairs, a Jaccard estimate corrected for chance collisions of
registers discards clear misses, and the rest is confirmed on full shingle sets.

Texts with equal shingle sets are one class and only its smallest id takes part.
A band bucket is never expanded into all its pairs: first every member is tried
against the bucket's smallest id.  What is not connected by then is compared inside
its buckets, in blocks of bounded size and by an inverted index of shingle
fingerprints, against the members of other groups only; nothing but the pairs that
reach the threshold leaves a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import Stored, parts_for, release, shuffle_partitions
from .components import components

#: Bands and registers a band: a pair at 0.8 escapes all bands with odds of about 5 in a million.
BANDS, ROWS = 40, 6
BUCKETS = BANDS * ROWS
#: Mantissa bits of a register.
MANTISSA = 10
#: Standard errors by which an estimate must fall short before a pair is discarded; smaller sets share registers, so their estimate is not used.
MARGIN, ESTIMATED = 5.0, 50
#: Members of a block of a center, and bytes of shingles on one side of a block of a bucket.
MEMBERS, SIDE_BYTES = 64, 24 << 20


def registers(values: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 64-bit minima, as 16 bits."""
    top = values >> np.uint64(11)
    exponent = np.frexp(top.astype(np.float64))[1].astype(np.int64)
    zeros = 53 - exponent
    mantissa = ((top << zeros.astype(np.uint64)) >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    return ((zeros << MANTISSA) | mantissa.astype(np.int64)).astype(np.uint16)


@lru_cache(1)
def _borrowing() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, BUCKETS, (48, BUCKETS)), rng.permuted(np.tile(np.arange(BUCKETS), (BUCKETS, 1)), axis=1)


def sketch(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers (texts x buckets) of shingle hashes; a text without shingles has zeros."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    spread = kernel.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    bucket = ((spread >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
    value = kernel.mix(hashes + np.uint64(0x9E3779B97F4A7C15))
    low = np.full(n * BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, owner * BUCKETS + bucket.astype(np.int64), value)
    seen = np.zeros(n * BUCKETS, bool)
    seen[owner * BUCKETS + bucket.astype(np.int64)] = True
    low, seen = low.reshape(n, BUCKETS), seen.reshape(n, BUCKETS)
    tries, order = _borrowing()
    some = seen.any(axis=1)
    rows, cols = np.nonzero(~seen & some[:, None])
    filled = low.copy()
    for attempt in tries:
        if not len(rows):
            break
        source = attempt[cols]
        hit = seen[rows, source]
        filled[rows[hit], cols[hit]] = low[rows[hit], source[hit]]
        rows, cols = rows[~hit], cols[~hit]
    for row in np.unique(rows):
        own = cols[rows == row]
        there = np.flatnonzero(seen[row])
        filled[row, own] = low[row, there[np.argmin(order[np.ix_(own, there)], axis=1)]]
    out = registers(filled)
    out[~some] = 0
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate of register rows, corrected for registers that agree by chance."""
    same = (a == b).mean(axis=1)
    # two independent minima with m and n values a bucket agree in leading zeros and mantissa
    m, n = np.maximum(n_a / BUCKETS, 1e-9), np.maximum(n_b / BUCKETS, 1e-9)
    chance = np.zeros(len(same))
    for z in range(40):
        width = 2.0 ** -(z + 1) / (1 << MANTISSA)
        low = 2.0 ** -(z + 1)
        chance += (1 << MANTISSA) * (m * n * width**2 * np.exp(-(m + n) * low * 1.5))
    chance = np.clip(chance, 0, 0.5)
    return (same - chance) / (1 - chance)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, n (shingles), same (hash of the whole set), registers; whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernel.strings(batch.column(1))
            for i, j in kernel.pieces(offsets):
                part = data[offsets[i] : offsets[j]]
                words, bounds = kernel.word_hashes(part, offsets[i : j + 1] - offsets[i])
                raw, cut = kernel.shingles(words, bounds, width)
                sets = [np.unique(raw[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                sizes = np.array([len(s) for s in sets])
                regs = sketch(np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(sizes.astype(np.int64)),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                    ],
                    ["id", "n", "same", "registers"],
                )

    idt = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {idt}, n long, same binary, registers binary")


def band_rows(reps: DataFrame, id_type: str) -> DataFrame:
    """One row (key, id) for each band of each sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                data, offsets = kernel.strings(part.column(1))
                regs = data.view(np.uint16).reshape(len(offsets) - 1, BANDS, ROWS).astype(np.uint64)
                key = np.tile(salt, (len(regs), 1))
                for k in range(ROWS):
                    key = kernel.mix(key * np.uint64(0x9FB21C651E98DF25) + regs[:, :, k])
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(regs)), BANDS)))
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), ids], ["key", "id"])

    return reps.select("id", "registers").mapInArrow(run, f"key long, id {id_type}")


def _least(threshold: float) -> float:
    return threshold - MARGIN * (threshold * (1 - threshold) / BUCKETS) ** 0.5


def _may_link(ra, rb, na, nb, threshold: float) -> np.ndarray:
    """Pairs whose sizes allow the threshold and whose corrected estimate doesn't clearly miss it."""
    out = np.minimum(na, nb) >= threshold * np.maximum(na, nb)
    at = np.flatnonzero(out & (np.minimum(na, nb) >= ESTIMATED))
    out[at] = estimate(ra[at], rb[at], na[at], nb[at]) >= _least(threshold)
    return out


def _plausible(pairs: DataFrame, sk: DataFrame, threshold: float, id_type: str) -> DataFrame:
    """Pairs (a, b) whose corrected estimate doesn't clearly miss the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (kernel.strings(batch.column(c))[0].view(np.uint16).reshape(-1, BUCKETS) for c in (2, 3))
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in (4, 5))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(_may_link(ra, rb, na, nb, threshold)))

    def side(x: str) -> DataFrame:
        return sk.select(F.col("id").alias(x), F.col("registers").alias(f"r{x}"), F.col("n").alias(f"n{x}"))

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, f"a {id_type}, b {id_type}")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int, id_type: str) -> DataFrame:
    """Pairs with 100 * common >= percent * union on the full sets.

    A center (``a``) with many members is dealt into blocks of them; its text goes to each
    block once, before its members' texts.
    """
    held = Stored(pairs, "pairs")
    many = held.df.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks"))
    side = lambda x: texts.select(F.col("id").alias(x), "text")
    members = held.df.join(many, "a").join(side("b"), "b").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role"), "b", "text")
    centers = many.join(side("a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("a").alias("b"), "text")
    dealt = centers.unionByName(members).repartition("a", "block").sortWithinPartitions("a", "block", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shingle_set(text: bytes) -> np.ndarray:
            data = np.frombuffer(text, np.uint8)
            words, bounds = kernel.word_hashes(data, np.array([0, len(data)]))
            return np.unique(kernel.shingles(words, bounds, width)[0])

        x = np.zeros(0, np.uint64)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (role, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).cast(pa.binary()), strict=True)):
                y = shingle_set(text.as_py())
                if not role:
                    x = y
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], ["a", "b"]).filter(pa.array(keep))

    return dealt.mapInArrow(run, f"a {id_type}, b {id_type}")


def _shingle_sets(texts: DataFrame, width: int, id_type: str) -> DataFrame:
    """Sorted distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernel.strings(batch.column(1))
            for i, j in kernel.pieces(offsets):
                words, bounds = kernel.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                raw, cut = kernel.shingles(words, bounds, width)
                sets = [np.unique(raw[a:z]).tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())], ["id", "shingles"])

    return texts.select("id", "text").mapInArrow(run, f"id {id_type}, shingles binary")


def block_links(left: list, right: list, percent: int) -> list[tuple]:
    """Links between different groups of one block, no more than connect them; left and right hold (id, group, registers, shingles).

    Estimates choose whom a member is held against, full sets decide.  Groups that
    a link has joined are one from then on.
    """
    every = np.concatenate([s for *_, s in right])
    sizes = np.array([len(s) for *_, s in right])
    owner = np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    regs = np.stack([r for _, _, r, _ in right])
    number: dict = {}
    root = np.array([number.setdefault(g, len(number)) for _, g, _, _ in right])
    mine_of = [number.setdefault(g, len(number)) for _, g, _, _ in left]
    joined = np.arange(len(number))
    out = []
    for (x, _, r, s), group in zip(left, mine_of, strict=True):
        mine = joined[group]
        at = np.flatnonzero(root != mine)
        at = at[_may_link(np.broadcast_to(r, (len(at), len(r))), regs[at], np.full(len(at), len(s)), sizes[at], percent / 100)]
        if not len(at):
            continue
        lo, hi = np.searchsorted(every, s, "left"), np.searchsorted(every, s, "right")
        n = hi - lo
        hits = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(owner[hits], minlength=len(right))[at]
        for k in at[100 * common >= percent * (len(s) + sizes[at] - common)].tolist():
            other = root[k]
            if other != mine:
                out.append((x, right[k][0]))
                root[root == other] = mine
                joined[joined == other] = mine
    return out


def _across_groups(placed: DataFrame, sk: DataFrame, texts: DataFrame, width: int, percent: int, id_type: str, block: int = 400) -> DataFrame:
    """Links (a, b) that connect the groups of ``placed(key, id, g)`` wherever members of different groups in a bucket reach the threshold.

    In a bucket the members outside its largest group are held against all
    others.  A bucket of more than ``block`` members, or of larger sets than a side of a
    block should hold, is dealt into blocks.
    """
    spark = placed.sparkSession
    several = placed.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("key")
    counts = placed.join(several, "key").join(sk.select("id", "n"), "id").groupBy("key", "g").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("n") * 8).alias("bytes"))
    plan = counts.groupBy("key").agg(F.sum("m").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("m", "g", "bytes")).alias("top"))
    cells = lambda m, size: F.ceil(F.greatest(m / block, size / SIDE_BYTES)).cast("int")
    plan = plan.select(
        "key",
        F.col("top.g").alias("main"),
        cells(F.col("n") - F.col("top.m"), F.col("bytes") - F.col("top.bytes")).alias("lefts"),
        cells(F.col("n"), F.col("bytes")).alias("rights"),
        "bytes",
        (F.col("bytes") - F.col("top.bytes")).alias("left_bytes"),
    )
    plan = Stored(plan, "bucket-plan").df
    sent = plan.agg(F.sum(F.col("bytes") * F.col("lefts") + F.col("left_bytes") * F.col("rights"))).first()[0] or 0
    rows = Stored(placed.join(plan.select("key", "main", "lefts", "rights"), "key"), "open-buckets")
    if rows.df.isEmpty():
        return spark.createDataFrame([], f"a {id_type}, b {id_type}")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.df.where("g <> main").select("key", "id", "g", own("lefts").alias("i"), every("rights").alias("j"), F.lit(0).alias("side"))
    right = rows.df.select("key", "id", "g", own("rights").alias("j"), every("lefts").alias("i"), F.lit(1).alias("side"))
    open_ = rows.df.select("id").distinct()
    sets = Stored(_shingle_sets(texts.join(open_, "id", "left_semi"), width, id_type).join(sk.select("id", "registers"), "id"), "shingle-sets")
    dealt = left.unionByName(right).join(sets.df, "id")
    dealt = dealt.repartition(max(shuffle_partitions(spark), parts_for(spark, sent, 4 * SIDE_BYTES)), "key", "i", "j").sortWithinPartitions("key", "i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, found = None, ([], []), []
        ids = lambda: pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k in (0, 1)], ["a", "b"])
        kind = None
        for batch in batches:
            kind = batch.column(1).type
            keys = zip(*(batch.column(k).to_pylist() for k in (0, 3, 4)), strict=True)
            rest = zip(*(batch.column(k).to_pylist() for k in (5, 1, 2, 6, 7)), strict=True)
            for key, (s, x, g, r, p) in zip(keys, rest, strict=True):
                if key != now:
                    if sides[0] and sides[1]:
                        found.extend(block_links(*sides, percent))
                    now, sides = key, ([], [])
                sides[s].append((x, g, np.frombuffer(r, np.uint16), np.frombuffer(p, np.uint64)))
            if len(found) > 10000:
                yield ids()
                found.clear()
        if sides[0] and sides[1]:
            found.extend(block_links(*sides, percent))
        if found:
            yield ids()

    pairs = dealt.select("key", "id", "g", "i", "j", "side", "registers", "shingles").mapInArrow(run, f"a {id_type}, b {id_type}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Group documents linked by ``100 * common shingles >= percent * union``.

    Words are runs of anything but ASCII white space, A-Z folded to lower case; a
    document's set holds its distinct runs of ``width`` words, or with fewer words
    the whole sequence.  Returns for each row id, n_shingles, component_id (smallest
    id reachable through links) and kept (id = component_id).  A null or empty text,
    or one without words, has an empty set and is linked with nothing.  Rows with
    the same id are one document, with the smallest of their texts (null before all).  A null id is left out of links and kept
    false.  Empty input: no rows.  Other columns are not read.
    """
    idt = docs.schema[id_col].dataType.simpleString()
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null")
    if ids.count() > ids.distinct().count():
        given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        one = given.where("id is not null").groupBy("id").agg(F.min(F.struct("text")).alias("t"))
        docs = given.select("id").join(one, "id").select("id", "t.text").unionByName(given.where("id is null"))
        docs = docs.select(F.col("id").alias(id_col), F.col("text").alias(text_col))
    held = Stored(sketches(docs, id_col, text_col, width), "sketches")
    sk = held.df
    full = sk.where("n > 0 and id is not null")
    classes = Stored(full.groupBy("same").agg(F.min("id").alias("rep")), "classes")
    reps = full.join(classes.df.select(F.col("rep").alias("id")), "id", "left_semi")
    rows = band_rows(reps, idt)
    shared = rows.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("other")).where("center < other").select("key", "center")
    cand = Stored(rows.join(shared.hint("shuffle_hash"), "key"), "band-members")
    members = cand.df
    involved = members.select("id").distinct()
    texts = Stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(involved, "id", "left_semi").dropDuplicates(["id"]), "candidate-texts")
    small = Stored(full.select("id", "n", "registers").join(involved, "id", "left_semi").dropDuplicates(["id"]), "candidate-sketches")

    def tried(pairs: DataFrame, name: str) -> Stored:
        return Stored(_confirmed(_plausible(pairs, small.df, percent / 100, idt), texts.df, width, percent, idt), name)

    # each member against the center it shares most bands with
    near = members.where("id <> center").groupBy("id", "center").agg(F.count(F.lit(1)).alias("bands"))
    best = near.groupBy("id").agg(F.max(F.struct(F.col("bands"), F.col("center"))).alias("m")).select(F.col("m.center").alias("a"), F.col("id").alias("b"))
    links = tried(best, "links-1").df
    groups = components(links, idt)

    def side(df: DataFrame, x: str) -> DataFrame:
        """The group of column ``x``, itself where it has no link yet."""
        return df.join(groups.select(F.col("id").alias(x), F.col("component").alias(f"g{x}")), x, "left").withColumn(f"g{x}", F.coalesce(f"g{x}", x))

    # then all centers that lie in other groups
    apart = side(side(near.select(F.col("center").alias("a"), F.col("id").alias("b")), "a"), "b").where("ga <> gb").select("a", "b")
    more = tried(apart, "links-2").df
    if not more.isEmpty():
        links = links.unionByName(more)
        groups = components(links, idt)
    # then, inside the buckets that still hold several groups, members of different groups
    placed = Stored(side(members.where("id <> center").select("key", F.col("id").alias("b")), "b").select("key", F.col("b").alias("id"), F.col("gb").alias("g")), "placed")
    more = Stored(_across_groups(placed.df, small.df, texts.df, width, percent, idt), "links-3").df
    if not more.isEmpty():
        groups = components(links.unionByName(more), idt)
    for done in (cand, texts, small, placed):
        done.drop()
    release(docs.sparkSession)
    final = sk.select("id", F.col("n").alias("n_shingles"), "same").join(classes.df, "same", "left").withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")))
    final = final.join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left")
    final = final.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")))
    out = Stored(final.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")), "near-duplicates")
    held.drop()
    return out.df
