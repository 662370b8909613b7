"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a sample (principal directions, then iterative
quantisation) turns vectors into binary codes.  Codes are cut into substrings and
each substring is indexed.  Of two codes within Hamming radius r some substring
differs in no more bits than its share, where the shares add up to r less the number
of substrings plus one; so probing the occupied buckets that near a query finds every
code within r.  What is found is ranked by the cosine of the original vectors.  The
radius is learned as well, so that it holds most true neighbours of the sample's own
vectors.

Rows are dealt into shards of bounded size, and each shard's index (codes, and the
buckets of each substring) is built once and written.  Shards and blocks of queries
form a grid of cells; a cell answers its queries, and the cells' best are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, shuffle_partitions

#: Rows that the rotation and the radius are learned on, at most.
SAMPLE = 4096
#: Share of the sample's true neighbours that the radius must hold.
COVER = 0.97
BITS, SUBSTRING = 64, 32
#: Rows and queries of a cell, at most on average.
CELL_ROWS, CELL_QUERIES = 1 << 14, 4096

class Codes:
    """Learned rotation, codes and radius."""

    def __init__(self, sample: np.ndarray, k: int):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.mean = unit.mean(axis=0)
        centred = unit - self.mean
        bits = min(BITS, sample.shape[1])
        _, vectors = np.linalg.eigh(centred.T @ centred)
        self.project = vectors[:, ::-1][:, :bits]
        low = centred @ self.project
        turn = np.linalg.qr(np.random.default_rng(1).normal(size=(bits, bits)))[0]
        for _ in range(40):
            left, _, right = np.linalg.svd(low.T @ np.where(low @ turn >= 0, 1.0, -1.0))
            turn = left @ right
        self.project = self.project @ turn
        self.parts = -(-bits // SUBSTRING)
        self.radius = self._radius(unit, k)

    def _radius(self, unit: np.ndarray, k: int) -> int:
        probe = unit[:512]
        near = probe @ unit.T
        near[np.arange(len(probe)), np.arange(len(probe))] = -np.inf
        k = min(k, len(unit) - 1)
        if k < 1:
            return 0
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        code = self.substrings(unit)
        apart = np.bitwise_count(code[: len(probe), None, :] ^ code[best]).sum(axis=2)
        return int(np.ceil(np.quantile(apart, COVER)))

    def substrings(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of 32-bit substrings."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        sign = (unit - self.mean) @ self.project >= 0
        sign = np.pad(sign, ((0, 0), (0, self.parts * SUBSTRING - sign.shape[1])))
        return np.packbits(sign, axis=1).view(">u4").astype(np.uint32)


class Index:
    """Codes of a shard's rows and the buckets of each substring; and what it did to answer: rows in all, probed and within the radius."""

    def __init__(self, code: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None):
        self.code = code
        self.tables = tables or [self._table(column) for column in code.T]
        self.all = self.probed = self.near = 0

    @staticmethod
    def _table(column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows in the order of a substring, its values, and where each value's rows begin."""
        order = np.argsort(column, kind="stable").astype(np.int32)
        value, first = np.unique(column[order], return_index=True)
        return order, value, np.append(first, len(order)).astype(np.int32)

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from the query's in at most ``radius`` bits."""
        parts = len(self.tables)
        share, rest = divmod(radius - parts + 1, parts)
        found = np.zeros(len(self.code), bool)
        for k, (order, value, first) in enumerate(self.tables):
            hit = np.flatnonzero(np.bitwise_count(value ^ query[k]).astype(int) <= share + (k < rest))
            size = first[hit + 1] - first[hit]
            at = np.repeat(first[hit] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            found[order[at]] = True
        rows = np.flatnonzero(found)
        near = rows[np.bitwise_count(self.code[rows] ^ query).sum(axis=1) <= radius]
        self.all, self.probed, self.near = self.all + len(found), self.probed + len(rows), self.near + len(near)
        return near


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    column = table.column("vector").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ids, flat.reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))


_INDEX = "i int, ids binary, vectors binary, code binary, orders binary, values binary, firsts binary, widths array<int>"


def _built(codes: Codes):
    """One shard's index as a row: ids, vectors, codes and, one after the other, the tables of its substrings."""

    def run(table: pa.Table) -> pa.Table:
        ids, vectors = _matrix(table.sort_by("id"))
        index = Index(codes.substrings(vectors))
        blobs = [ids, vectors, index.code, *(np.concatenate(x) for x in zip(*index.tables, strict=True))]
        row = {"i": pa.array([table.column("i")[0].as_py()], pa.int32())}
        row |= {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("ids", "vectors", "code", "orders", "values", "firsts"), blobs, strict=True)}
        return pa.table(row | {"widths": pa.array([[len(v) for _, v, _ in index.tables]], pa.list_(pa.int32()))})

    return run


def _loaded(row: dict, parts: int) -> tuple[np.ndarray, np.ndarray, Index]:
    ids = np.frombuffer(row["ids"], np.int64)
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
    widths = np.array(row["widths"])
    orders = np.frombuffer(row["orders"], np.int32).reshape(parts, -1)
    values = np.split(np.frombuffer(row["values"], np.uint32), np.cumsum(widths)[:-1])
    firsts = np.split(np.frombuffer(row["firsts"], np.int32), np.cumsum(widths + 1)[:-1])
    return ids, vectors, Index(np.frombuffer(row["code"], np.uint32).reshape(len(ids), parts), list(zip(orders, values, firsts, strict=True)))


def _answer(codes: Codes, k: int, every: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, asked = _matrix(right)
        out: list[tuple] = []
        if left.num_rows and len(queries):
            ids, vectors, index = _loaded(left.to_pylist()[0], codes.parts)
            length = np.sqrt((vectors * vectors).sum(axis=1))
            query_code = codes.substrings(asked)
            for i, (q, x) in enumerate(zip(queries.tolist(), asked, strict=True)):
                rows = np.arange(len(ids)) if every else index.within(query_code[i], codes.radius)
                rows = rows[ids[rows] != q]
                if not len(rows):
                    continue
                # row by row, so equal vectors have equal scores wherever they lie
                score = (vectors[rows] * x).sum(axis=1) / (length[rows] * np.sqrt((x * x).sum()))
                if len(rows) > 4 * k:
                    least = np.partition(score, len(rows) - k)[len(rows) - k]
                    rows, score = rows[score >= least], score[score >= least]
                best = np.lexsort((ids[rows], -score))[:k]
                out.extend((q, int(ids[rows[b]]), float(score[b])) for b in best)
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    return run


def _search(index: DataFrame, shards: int, queries: DataFrame, n_queries: int, codes: Codes, k: int, every: bool) -> DataFrame:
    """The best of each query within the radius, or of ``every`` row."""
    blocks = max(1, math.ceil(n_queries / CELL_QUERIES))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = shards * blocks
    left = index.select("*", spread(blocks).alias("j")).repartition(cells, "i", "j").groupBy("i", "j")
    right = queries.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("j"), spread(shards).alias("i"), "id", "vector").repartition(cells, "i", "j").groupBy("i", "j")
    found = left.cogroup(right).applyInArrow(_answer(codes, k, every), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` by cosine for every row of ``queries`` (same columns).

    Returns query_id, rank (from 1), vec_id and score, the cosine of the original
    vectors in double precision; ties go to the smaller id.  A row of the query's
    own id is no candidate; of rows with the same id the smallest vector counts.  Vectors that are
    null, zero, or hold null or non-finite components take no part, nor do those of
    another length than most.  A query with fewer than ``k`` found within the
    radius is held against all rows.  Empty input, or no other row: no rows.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        good = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.where(good & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("vector"))

    once = lambda df: usable(df).groupBy("id").agg(F.min("vector").alias("vector"))
    rows, asked = once(vectors), once(queries)
    widths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    if widths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = (x.where(F.size("vector") == widths["d"]) for x in (rows, asked))
    n_rows, n_queries = widths["count"], asked.count()
    sample = rows.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(SAMPLE).toPandas()
    codes = Codes(np.array(sample["vector"].tolist(), float), k)
    shards = max(math.ceil(n_rows / CELL_ROWS), min(shuffle_partitions(spark), math.ceil(n_rows / 2048)), 1)
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("i"), "id", "vector").repartition(shards, "i")
    index = Stored(dealt.groupBy("i").applyInArrow(_built(codes), _INDEX), "codes").df
    first = Stored(_search(index, shards, asked, n_queries, codes, k, False), "neighbours").df
    enough = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    rest = Stored(asked.join(enough, "id", "left_anti"), "queries-left").df
    n_rest = rest.count()
    if not n_rest:
        return first
    second = _search(index, shards, rest, n_rest, codes, k, True)
    return first.join(rest.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(*second.columns).unionByName(second)
