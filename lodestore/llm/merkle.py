"""A dataset manifest: Merkle trees over a table's rows, one a group, and one over the groups' roots.

Leaves are computed in one scan and written without their texts.  They are then
sorted by range over all groups, so a large group spreads over many partitions and many
small ones share one; a partition's rows of a group, counted, give the offsets that
turn places within a partition into places within the group.  Each partition builds
the subtrees that lie whole within it.  Only the nodes beside its borders are shuffled,
by their coordinate (group, block of FAN ** HEIGHT leaves), to finish the blocks there.
What is above is a smaller forest of the same kind, finished by coordinate, HEIGHT
levels at a time.  Proofs come back down the same way: a block gets the path above it
once and hands it to its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, parts_for
from .kernel import whole_groups


#: Nodes that become one (places are shifted by its three bits), and levels that a block spans.
FAN, HEIGHT = 8, 4
#: Rows that a task holds at a time while it builds subtrees, and bytes a row is reckoned as.
HELD, ROW_BYTES = 1 << 16, 160

_NODE = "g long, n long, level int, at long, h binary"
_SIDES = "array<struct<before:string,after:string>>"


def digest(*fields: Column) -> Column:
    """sha256, in hexadecimal, of the fields one after another: each ``-`` if null, else its UTF-8 bytes' count, a colon and itself."""
    said = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (hexadecimal) and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, side: F.sha2(F.concat(side["before"], node, side["after"]).cast("binary"), 256))


def siblings(proof: Column) -> Column:
    """A proof's digests, level by level and left to right, as one text."""
    return F.concat_ws("", F.transform(proof, lambda side: F.concat(side["before"], side["after"])))


def levels(n: int) -> int:
    """Levels above ``n`` nodes."""
    count = 0
    while n > 1:
        n, count = -(-n // FAN), count + 1
    return count


def _joined(nodes: list[bytes]) -> bytes:
    """The node above ``nodes``."""
    return sha256(b"".join(nodes).hex().encode()).digest()


def subtrees(a: int, nodes: list[bytes], n: int, height: int = HEIGHT) -> Iterator[tuple[int, int, bytes]]:
    """The largest whole subtrees of up to ``height`` levels over neighbouring leaves ``a``, ``a + 1`` ... of ``n``: (level, place, digest)."""
    top = min(height, levels(n))
    for level in range(top):
        z = a + len(nodes)
        lo, hi = -(-a // FAN), -(-n // FAN) if z == n else z // FAN
        if hi <= lo:
            yield from ((level, a + i, h) for i, h in enumerate(nodes))
            return
        yield from ((level, x, nodes[x - a]) for x in (*range(a, lo * FAN), *range(hi * FAN, z)))
        a, n, nodes = lo, -(-n // FAN), [_joined(nodes[max(j * FAN - a, 0) : (j + 1) * FAN - a]) for j in range(lo, hi)]
    yield from ((top, a + i, h) for i, h in enumerate(nodes))


def block_levels(nodes: list[tuple[int, int, bytes]], n: int, height: int = HEIGHT) -> list[tuple[int, list[bytes]]]:
    """All levels of a block from ``nodes`` (level, place, digest) that together cover it: first place and digests of each, up to its one root."""
    given: dict[int, dict[int, bytes]] = {}
    for level, at, h in nodes:
        given.setdefault(level, {})[at] = h
    out: list[tuple[int, list[bytes]]] = []
    here: dict[int, bytes] = {}
    for level in range(min(height, levels(n)) + 1):
        here |= given.get(level, {})
        order = sorted(here)
        out.append((order[0] if order else 0, [here[x] for x in order]))
        runs: dict[int, list[bytes]] = {}
        for x in order:
            runs.setdefault(x // FAN, []).append(here[x])
        here = {j: _joined(run) for j, run in runs.items()}
    return out


def _runs(table: pa.Table, *keys: str) -> Iterator[tuple[int, int]]:
    """Where rows with the same values of the whole-numbered ``keys`` begin and end."""
    rows = list(zip(*(table.column(k).to_pylist() for k in keys), strict=True))
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i] != rows[start]:
            yield start, i
            start = i


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    g, n, level, at, h = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(n, pa.int64()), pa.array(level, pa.int32()), pa.array(at, pa.int64()), pa.array(h, pa.binary())], ["g", "n", "level", "at", "h"])


def _build(height: int, most: int):
    """Whole subtrees over a partition's leaves (g, n, at, h), ``most`` at a time; neighbours need not come in order."""

    def built(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by([("g", "ascending"), ("at", "ascending")])
        gs, ns, ats, hs = (table.column(c).to_pylist() for c in ("g", "n", "at", "h"))
        rows, start = [], 0
        for i in range(1, len(gs) + 1):
            if i == len(gs) or gs[i] != gs[start] or ats[i] != ats[i - 1] + 1:
                rows += [(gs[start], ns[start], *node) for node in subtrees(ats[start], hs[start:i], ns[start], height)]
                start = i
        return _node_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                yield built(held)
                held = []
        if held:
            yield built(held)

    return run


def _finish(height: int):
    """Roots of blocks whose nodes (g, block, n, level, at, h) lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("g", "block")):
            gs, blocks, ns, *rest = (table.column(c).to_pylist() for c in ("g", "block", "n", "level", "at", "h"))
            nodes = list(zip(*rest, strict=True))
            rows = []
            for a, z in _runs(table, "g", "block"):
                (root,) = block_levels(nodes[a:z], ns[a], height)[-1][1]
                rows.append((gs[a], ns[a], min(height, levels(ns[a])), blocks[a], root))
            yield _node_batch(rows)

    return run


def _blocks(n: Column, height: int) -> Column:
    """Blocks of ``n`` leaves."""
    return F.shiftright(n + (FAN**height - 1), 3 * height)


def _above(nodes: DataFrame, parts: int, height: int) -> DataFrame:
    """Block roots from nodes (g, n, level, at, h) as nodes of the next stage, with their place among the blocks of the group."""
    near = nodes.select("g", F.expr(f"shiftright(at, 3 * ({height} - level))").alias("block"), "n", "level", "at", "h")
    roots = near.repartition(parts, "g", "block").sortWithinPartitions("g", "block").mapInArrow(_finish(height), _NODE)
    return roots.select("g", _blocks(F.col("n"), height).alias("n"), F.lit(0).alias("level"), "at", "h")


class Forest:
    """Trees over ``leaves`` (``h`` binary, ``group`` or none, columns to sort by), built up to their roots.

    ``rows``: leaves with g (number of their group), n (its leaves) and at (place).
    ``groups``: g, group, n.  ``roots``: g, h.
    """

    def __init__(self, leaves: DataFrame, order: list[str], n_rows: int, height: int = HEIGHT, held: int = HELD):
        spark = leaves.sparkSession
        self.height, self.parts = height, parts_for(spark, n_rows * ROW_BYTES)
        keys = [F.col(c).asc_nulls_first() for c in ("group", *order)]
        p = F.spark_partition_id()
        dealt = leaves.repartitionByRange(self.parts, *keys).sortWithinPartitions(*keys)
        placed = Stored(dealt.select("*", p.alias("p"), (F.monotonically_increasing_id() - F.shiftleft(p.cast("long"), 33)).alias("i")), "merkle-leaves").df
        spans = Stored(placed.groupBy("p", "group").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("rows")), "merkle-spans").df
        self.groups = Stored(spans.groupBy("group").agg(F.sum("rows").alias("n")).select(F.monotonically_increasing_id().alias("g"), "group", "n"), "merkle-groups").df
        before = Window.partitionBy("group").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        offsets = spans.select("p", "group", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"))
        named = offsets.join(self.groups.withColumnRenamed("group", "of"), F.col("group").eqNullSafe(F.col("of"))).select("p", "of", "g", "n", "shift")
        named = Stored(named.withColumnRenamed("p", "q"), "merkle-offsets").df
        self.rows = placed.join(named, (F.col("p") == F.col("q")) & F.col("group").eqNullSafe(F.col("of"))).withColumn("at", F.col("i") + F.col("shift")).drop("p", "q", "of", "i", "shift", "group")
        most = self.groups.agg(F.max("n")).first()[0] or 0
        built = Stored(self.rows.select("g", "n", "at", "h").mapInArrow(_build(height, held), _NODE), "merkle-subtrees").df
        top = F.lit(0)
        for level in range(height):
            top = top + (F.col("n") > FAN**level).cast("int")
        whole, ragged = built.where(F.col("level") == top), built.where(F.col("level") < top)
        done = whole.select("g", _blocks(F.col("n"), height).alias("n"), F.lit(0).alias("level"), "at", "h")
        self.stages = [self.rows.select("g", "n", "at", "h"), Stored(done.unionByName(_above(ragged, self.parts, height)), "merkle-blocks").df]
        most = -(-most // FAN**height)
        while most > 1:
            self.stages.append(Stored(_above(self.stages[-1], self._parts_above(len(self.stages) - 1), height), "merkle-blocks").df)
            most = -(-most // FAN**height)
        self.roots = self.stages[-1].select("g", "h")

    def _parts_above(self, stage: int) -> int:
        return max(1, self.parts // FAN ** (self.height * stage))

    def proofs(self, above: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """Each leaf's columns ``keep``, h and proof; ``above`` (g, path) is what follows a group's root on the way up."""
        tops = self.roots.select("g", F.lit(0).cast("long").alias("at"))
        tops = tops.join(above, "g") if above is not None else tops.withColumn("path", F.lit(None).cast(_SIDES))
        for stage in range(len(self.stages) - 2, 0, -1):
            tops = Stored(_down(self.stages[stage], tops, self._parts_above(stage), self.height), "merkle-paths").df
        return _down(self.rows, tops, self.parts, self.height, keep)


def _down(nodes: DataFrame, tops: DataFrame, parts: int, height: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Paths of ``nodes`` (g, n, at, h) under ``tops`` (g, at: the block, path)."""
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    under = nodes.select("g", F.shiftright("at", 3 * height).alias("block"), "at", "n", "h", kept.alias("kept"))
    head = tops.select("g", F.col("at").alias("block"), F.lit(-1).cast("long").alias("at"), F.col("path"))
    rows = under.unionByName(head, allowMissingColumns=True).repartition(parts, "g", "block").sortWithinPartitions("g", "block", "at")
    kind = under.schema["kept"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("g", "block")):
            for a, z in _runs(table, "g", "block"):
                part = table.slice(a + 1, z - a - 1)
                if not part.num_rows:
                    continue
                n, first = part.column("n")[0].as_py(), part.column("at")[0].as_py()
                upper = [(s["before"], s["after"]) for s in table.column("path")[a].as_py() or []]
                tree = block_levels([(0, first + i, h) for i, h in enumerate(part.column("h").to_pylist())], n, height)
                paths = {tree[-1][0]: upper}
                for at, run_ in reversed(tree[:-1]):
                    text = [h.hex() for h in run_]
                    below = {}
                    for i in range(len(text)):
                        j = (at + i) // FAN
                        lo, hi = max(j * FAN - at, 0), (j + 1) * FAN - at
                        below[at + i] = [("".join(text[lo:i]), "".join(text[i + 1 : hi])), *paths[j]]
                    paths = below
                # the path above is one for all, so it goes out as plain arrays
                sides = [paths[first + i] for i in range(part.num_rows)]
                flat = [s for p in sides for s in p]
                ends = [0]
                for p in sides:
                    ends.append(ends[-1] + len(p))
                values = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.string())], ["before", "after"])
                path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                whole = part.combine_chunks()
                columns = [whole.column(c).combine_chunks() if whole.column(c).num_chunks != 1 else whole.column(c).chunk(0) for c in ("g", "at", "h", "kept")]
                yield pa.RecordBatch.from_arrays([*columns, path], ["g", "at", "h", "kept", "path"])

    found = rows.select("g", "block", "at", "n", "h", "kept", "path").mapInArrow(run, f"g long, at long, h binary, kept {kind.simpleString()}, path {_SIDES}")
    return found.select("g", "at", "h", "path", *[F.col(f"kept.{c}") for c in keep])


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang", keep: dict[str, Column] | None = None, height: int = HEIGHT, held: int = HELD) -> DataFrame:
    """The Merkle manifest of a table: each row's id, leaf, subroot, root and proof.

    A leaf is the :func:`digest` of the row's ``fields``.  In each group leaves ascend
    by id; while several nodes remain, every FAN neighbours (at last fewer, even one)
    become the sha256 of their hexadecimal digests.  What remains is the subroot; the
    subroots, in order of their groups, null first and by UTF-8 bytes, give the root
    likewise.  ``proof`` lists, for each level from the leaf up to the root, the digests
    that stand before and after a node in its run; :func:`folded` leads from a leaf
    along it to the root.  ``keep`` names further columns to compute from a row.

    Rows with null in any field are leaves like others, null ids before all others.
    Rows of one group and id stand in the order of their leaves; rows alike throughout
    are leaves each.  A null group is a group.  No rows: none.  Other columns are not read.
    """
    keep = keep or {}
    spare = F.monotonically_increasing_id().alias("salt")
    group = F.col(group_col).cast("string").alias("group")
    leaves = docs.select(group, F.col(id_col).alias("id"), F.unhex(digest(*[F.col(c) for c in fields])).alias("h"), F.struct(*[c.alias(k) for k, c in keep.items()], F.lit(0).alias("none")).alias("more"), spare)
    stored = Stored(leaves, "merkle-rows").df
    trees = Forest(stored, ["id", "h", "salt"], stored.count(), height, held)
    subroots = trees.roots.join(trees.groups, "g").select(F.lit(None).cast("string").alias("group"), F.col("group").alias("name"), F.col("g").alias("tree"), "h")
    tops = Stored(subroots, "merkle-subroots").df
    upper = Forest(tops, ["name"], tops.count(), height, held)
    above = Stored(upper.proofs(keep=("tree",)).select(F.col("tree").alias("g"), "path"), "merkle-tops").df
    top = upper.roots.first()  # one row, or none of an empty table
    root = F.lit(bytes(top["h"]).hex() if top else None).cast("string").alias("root")
    named = trees.roots.select(F.col("g").alias("of"), F.lower(F.hex("h")).alias("subroot"))
    whole = trees.proofs(above, keep=("id", "more")).join(named, F.col("g") == F.col("of"))
    return whole.select(F.col("id").alias(id_col), F.lower(F.hex("h")).alias("leaf"), "subroot", root, F.col("path").alias("proof"), *[F.col(f"more.{k}").alias(k) for k in keep])
