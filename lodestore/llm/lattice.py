"""Near-duplicate vectors by lattice hashing.

A table takes DIMS random directions (rows of random rotations, so that tables that
share one see different parts of a difference), scales them and decodes each eight of
them to the nearest point of the E8 lattice; the points are the vector's cell.  Vectors
close to one another share a cell in some table, or one's cell is among the PROBES
cells that lie nearest to the other.  Vectors that meet are verified by cosine.

Equal vectors are one class from the start.  Of the cells only keys and ids are sent at
first; vectors follow into cells where some meet.  Large cells are compared in blocks.
A cell sends no pairs: for each member the number of vectors linked that no earlier
table (nor the other's cell) has counted, which the members' own cells tell, and the
smallest member it hangs together with.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, shuffle_partitions
from .components import components
from .kernel import mix, whole_groups

#: Tables, directions of each, and neighbouring cells that are probed.
TABLES, DIMS, PROBES = 8, 16, 8
#: Scale of the directions: a unit of distance is so many of the lattice's.
SCALE = 0.7
#: Members of a block of a large cell, on average, and pairs that are looked at together.
BLOCK, PAIRS = 256, 1 << 14
#: Cosines this near to the least are computed again, each by itself.
NARROW = 1e-9


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    half = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*whole, *half])


SHORTEST = _shortest()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    point = np.rint(x)
    rest = x - point
    odd = np.flatnonzero(point.sum(axis=1) % 2 != 0)
    worst = np.abs(rest[odd]).argmax(axis=1)
    point[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return point


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 to rows of eight."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


class Lattice:
    """The directions for vectors of ``width``, drawn from a seed."""

    def __init__(self, width: int, seed: int = 3, tables: int = TABLES, dims: int = DIMS, probes: int = PROBES, scale: float = SCALE):
        rng = np.random.default_rng(seed)
        turns = [np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(-(-tables * dims // width))]
        self.directions = np.concatenate(turns, axis=1)[:, : tables * dims] * np.sqrt(width) * scale
        self.shift = rng.uniform(0, 1, size=tables * dims)
        self.tables, self.dims, self.probes, self.width = tables, dims, probes, width

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of each row's cell, by table, and of the cells it probes, by table and nearness."""
        at = unit @ self.directions + self.shift
        own = np.empty((len(unit), self.tables), np.uint64)
        near = np.empty((len(unit), self.tables, self.probes), np.uint64)
        for t in range(self.tables):
            own[:, t], near[:, t] = self._table(at[:, t * self.dims : (t + 1) * self.dims], t)
        return own.view(np.int64), near.view(np.int64)

    def _table(self, at: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [at[:, k : k + 8] for k in range(0, self.dims, 8)]
        points = [decode(p) for p in parts]
        salt = np.uint64((t + 1) * 0x9E3779B97F4A7C15 % 2**64) ^ np.uint64(self.width)
        # a step to a shortest vector v changes the squared distance by 2 - 2 (rest, v)
        tops, costs = [], []
        for p, c in zip(parts, points, strict=True):
            cost = 2 - 2 * ((p - c) @ SHORTEST.T)
            top = np.argsort(cost, axis=1, kind="stable")[:, : self.probes]
            tops.append(top)
            costs.append(np.take_along_axis(cost, top, axis=1))
        moves: list[tuple[int, ...]] = [tuple(q if k == j else -1 for k in range(len(parts))) for j in range(len(parts)) for q in range(self.probes)]
        if len(parts) == 2:
            moves += list(itertools.product(range(4), repeat=2))
        price = np.stack([sum(costs[k][:, q] for k, q in enumerate(m) if q >= 0) for m in moves], axis=1)
        best = np.argsort(price, axis=1, kind="stable")[:, : self.probes]
        steps = np.array(moves)[best]
        near = np.empty((len(at), self.probes), np.uint64)
        zero = np.zeros((len(at), 8))
        for q in range(self.probes):
            moved = [c + np.where((steps[:, q, k] >= 0)[:, None], SHORTEST[np.take_along_axis(tops[k], np.maximum(steps[:, q, k], 0)[:, None], axis=1)[:, 0]], zero) for k, c in enumerate(points)]
            near[:, q] = _key(moved, salt)
        return _key(points, salt), near


def _key(points: list[np.ndarray], salt: np.uint64) -> np.ndarray:
    h = np.full(len(points[0]), salt)
    for column in np.concatenate(points, axis=1).T:
        h = mix(h ^ (2 * column).astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h


def _matrices(vectors: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each width and their matrix."""
    column = vectors.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat, width = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().to_numpy()
    end = np.cumsum(width)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        yield rows, flat[(end[rows] - w)[:, None] + np.arange(w)]


_DRAWN: dict[tuple, Lattice] = {}


def _lattice(width: int, options: dict) -> Lattice:
    name = (width, *sorted(options.items()))
    if name not in _DRAWN:
        _DRAWN[name] = Lattice(width, **options)
    return _DRAWN[name]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keyed(options: dict):
    """Rows (key, table, id, own): the cells a vector has and probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, x in _matrices(pa.chunked_array([batch.column(1)])):
                for lo in range(0, len(rows), 2048):
                    some = rows[lo : lo + 2048]
                    own, near = _lattice(x.shape[1], options).cells(_unit(x[lo : lo + 2048]))
                    n, tables, probes = near.shape
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(own.tolist(), pa.list_(pa.int64())), pa.array(near.reshape(n, -1).tolist(), pa.list_(pa.int64()))], ["id", "own", "near"])

    return run


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the first one that the links (a, b) join it to."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, low[a], least)
        np.minimum.at(new, low[b], least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


class _Cell:
    """Members of a cell, or of two blocks of one."""

    def __init__(self, part: pa.Table, rows: np.ndarray, x: np.ndarray):
        take = lambda c: part.column(c).to_numpy()[rows]
        order = np.argsort(take("id"), kind="stable")
        rows, self.x = rows[order], x[order]
        take = lambda c: part.column(c).to_numpy()[rows]
        self.ids, self.size, self.home, self.block = take("id"), take("size"), take("home"), take("block")
        matrix = lambda c: part.column(c).combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)[rows]
        self.own, self.near = matrix("own"), matrix("near")
        self.near = self.near.reshape(len(rows), self.own.shape[1], -1)

    def met(self, a: np.ndarray, b: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether b comes to a's cell of table ``t``, and a to b's."""
        to_a = (self.own[b, t] == self.own[a, t]) | (self.near[b, t] == self.own[a, t][:, None]).any(axis=1)
        to_b = (self.own[b, t] == self.own[a, t]) | (self.near[a, t] == self.own[b, t][:, None]).any(axis=1)
        return to_a, to_b

    def linked(self, table: int, key: int, across: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
        """For each member the vectors linked to it that this cell counts, and the first member it hangs together with."""
        n = len(self.ids)
        count, low = np.zeros(n, np.int64), np.arange(n)
        unit = _unit(self.x)
        step = max(1, PAIRS // n)
        for lo in range(0, n, step):
            near = unit[lo : lo + step] @ unit.T
            a, b = np.nonzero(near >= least - NARROW)
            a += lo
            keep = (a < b) & (self.home[a] | self.home[b])
            if across:
                keep &= self.block[a] != self.block[b]
            a, b = a[keep], b[keep]
            sure = near[a - lo, b] > least + NARROW
            at = np.flatnonzero(~sure)
            sure[at] = (unit[a[at]] * unit[b[at]]).sum(axis=1) >= least
            a, b = a[sure], b[sure]
            if not len(a):
                continue
            low = _spanning(n, np.concatenate([np.arange(n), a]), np.concatenate([low, b]))
            to_a, _ = self.met(a, b, table)
            mine = np.where(to_a, self.own[a, table] == key, self.own[b, table] == key)
            for t in range(table):
                if not mine.any():
                    break
                to_a, to_b = self.met(a, b, t)
                mine &= ~(to_a | to_b)
            a, b = a[mine], b[mine]
            np.add.at(count, a, self.size[b])
            np.add.at(count, b, self.size[a])
        return count, low


def _compared(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("key", "i", "j")):
            keys, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
            cut = np.flatnonzero((keys[1:] != keys[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True):
                if z - a < 2:
                    continue
                part = table.slice(a, z - a)
                for rows, x in _matrices(part.column("vector")):
                    if len(rows) > 1:
                        cell = _Cell(part, rows, x)
                        count, low = cell.linked(part.column("t")[0].as_py(), keys[a], bool(i[a] != j[a]), least)
                        said = (count > 0) | (low != np.arange(len(low)))
                        out.append((cell.ids[said], count[said], cell.ids[low][said]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["id", "links", "low"])

    return run


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """Links of vectors whose cosine is ``least`` or more, and the components they form.

    Returns id, n_links (other vectors linked directly), component_id (smallest id
    reachable, itself included) and kept (whether that is its own).  Links are those the
    lattice finds: pairs under ``least`` never, pairs above it nearly always.  Cosines are
    taken in double precision.

    Components travel in the type they have.  Vectors that are null, zero or hold null or non-finite components link with nothing,
    and vectors of different lengths do not link.  Rows with one id are one vector, the smallest
    of theirs; a row without an id is returned once, linked with nothing, without
    a component and kept.  No rows: none.  Other columns are not read.  ``options`` are
    those of :class:`Lattice`.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    good = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    named = vectors.select(F.col(id_col).alias("id"), F.when(good, v).alias("vector"))
    once = Stored(named.where("id is not null").groupBy("id").agg(F.min("vector").alias("vector")), "vectors").df
    classes = Stored(once.where("vector is not null").groupBy("vector").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("size")), "vector-classes").df
    keyed = Stored(classes.select("lead", "vector").mapInArrow(_keyed(options), "id long, own array<long>, near array<long>"), "vector-cells").df
    own = keyed.select("id", F.posexplode("own").alias("t", "key"), F.lit(True).alias("home"))
    probes = keyed.select("id", F.posexplode("near").alias("t", "key"), F.lit(False).alias("home"))
    per_table = options.get("probes", PROBES)
    cells = own.unionByName(probes.withColumn("t", F.floor(F.col("t") / per_table).cast("int")))
    shared = cells.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.max("home").alias("lived")).where("lived and members > 1").select("key", "members")
    met = Stored(cells.join(shared, "key").select("key", "t", "id", "home", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "vector-meetings").df
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # a block meets every block of its cell, itself included, once
    spread = met.select("*", block.alias("block")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = spread.select("key", "t", "id", "home", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    known = classes.select(F.col("lead").alias("id"), "vector", "size").join(keyed, "id")
    rows = dealt.join(known, "id")
    parts = max(shuffle_partitions(spark), -(-dealt.count() // 8192))
    sorted_ = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = Stored(sorted_.select("key", "i", "j", "t", "id", "home", "block", "vector", "size", "own", "near").mapInArrow(_compared(least), "id long, links long, low long"), "vector-links").df
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct(), "long")
    links = F.col("size") - 1 + F.coalesce("links", F.lit(0))
    told = classes.join(counts, classes["lead"] == counts["id"], "left").select("lead", F.col("vector").alias("of"), links.alias("n_links"))
    told = told.join(joined, F.col("lead") == F.col("id"), "left").select("of", "n_links", F.coalesce("component", "lead").alias("component"))
    members = once.join(told, F.col("vector") == F.col("of"), "left")
    component = F.coalesce("component", "id")
    out = members.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
    nameless = named.where("id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(nameless).withColumnRenamed("id", id_col)
