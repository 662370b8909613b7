"""Mixing sources to target weights by pivotal dependent rounding (DataFrame operations only).

A source's documents all have the same fractional number of copies, its target
over its size.  The whole part is taken for certain; the fraction is rounded by
pivotal sampling in words: two open documents swap mass, so that the words they
contribute together stay the same, until the copies of one are whole.  Documents
are dealt into small blocks by a hash, a block leaves one open document, and the
open documents of the blocks form blocks again: a reduction tree whose depth is
the logarithm of the largest source.  A source's words so differ from its target
by less than one document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, null_salt, stored

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Documents that one fold handles, on average.
BLOCK = 64
_ITEM = "struct<h:bigint,row:struct<id:{id},source:string,size:bigint,n:bigint>,base:int,f:double>"


def source_targets(sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """Targets of ``sizes(source, source_size, n)``: by weight, none above ``cap`` times its size.

    What a capped source leaves over goes to the others by weight until none is
    above.  That ends at ``min(cap, level * weight)``, and the level is the
    largest of those found by taking the i sources with the smallest cap for
    their weight as capped.  One row per source; only these rows are windowed.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("top", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("top") / F.col("w"))
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return rows.select("source", "source_size", "n", F.least("top", F.col("level") * F.col("w")).alias("target"))


def _fold(level: int, seed: int, id_type: str) -> Column:
    """Sequential pivotal rounding of the sorted array ``items``; state: decided rows and one open document."""
    item = _ITEM.format(id=id_type)
    a, b = "s.open", "e"
    wa, wb, fa, fb = f"{a}.row.size", f"{b}.row.size", f"{a}.f", f"{b}.f"
    up, down = f"least(1D - {fa}, {fb} * {wb} / {wa})", f"least({fa}, (1D - {fb}) * {wb} / {wa})"
    u = f"pmod(xxhash64({b}.h, {level}, {seed}), 1073741824) / 1073741824D"
    rises = f"({u} * ({up} + {down}) < {down})"
    # who is decided, and with how many copies; the other stays open with the rest of the mass
    a_full, b_none = f"1D - {fa} <= {fb} * {wb} / {wa}", f"1D - {fa} > {fb} * {wb} / {wa}"
    a_none = f"{fa} <= (1D - {fb}) * {wb} / {wa}"

    def done(x: str, plus: int) -> str:
        return f"named_struct('row', {x}.row, 'copies', {x}.base + {plus})"

    def kept(x: str, f: str) -> str:
        return f"named_struct('h', {x}.h, 'row', {x}.row, 'base', {x}.base, 'f', greatest(0D, least(1D, {f})))"

    cases = [
        (f"{rises} and {a_full}", done(a, 1), kept(b, f"{fb} - (1D - {fa}) * {wa} / {wb}")),
        (f"{rises} and {b_none}", done(b, 0), kept(a, f"{fa} + {fb} * {wb} / {wa}")),
        (a_none, done(a, 0), kept(b, f"{fb} + {fa} * {wa} / {wb}")),
    ]
    last = (done(b, 1), kept(a, f"{fa} - (1D - {fb}) * {wb} / {wa}"))
    say = lambda i: "case " + " ".join(f"when {c[0]} then {c[i]}" for c in cases) + f" else {last[i - 1]} end"
    fixed = f"({fb} = 0D or {wb} = 0)"
    return F.expr(
        f"aggregate(items, named_struct('done', cast(array() as array<struct<row:struct<id:{id_type},source:string,size:bigint,n:bigint>,copies:int>>), 'open', cast(null as {item})), "
        f"(s, e) -> case when {fixed} then named_struct('done', array_append(s.done, {done(b, 0)}), 'open', s.open) "
        "when s.open is null then named_struct('done', s.done, 'open', e) "
        f"else named_struct('done', array_append(s.done, {say(1)}), 'open', {say(2)}) end)"
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    cap: float = 2.0,
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = 11,
    block: int = BLOCK,
    row_col: str | None = None,
) -> DataFrame:
    """Decide how many copies of each document a mix takes.

    Returns id, source, size (words of the text, null text: 0), source_size,
    target (words), copies and taken (copies times size).  The sum of ``taken``
    over a source misses its target by less than one document, and no document
    is taken more than ``ceil(cap)`` times.  The result follows from ids and texts alone, so
    reruns agree; rows without an id are told apart by their place as well.  A null source is a source of its own and comes last; documents
    of size 0 are taken 0 times more than certain.  Rows with the same id are
    rounded each.  ``row_col`` names a column of whole numbers, one for each row, to return
    as well.  Empty input: no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    idt = docs.schema[id_col].dataType.simpleString()
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col), null_salt(F.col(id_col))).alias("mark"), (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("n_row"))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = stored(source_targets(sums, share, cap, weights), "mix-targets")
    most = targets.agg(F.max("n")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    t = targets.withColumnRenamed("source", "t_source")
    h = F.xxhash64("id", "size", "mark", F.lit(seed))
    open_ = (
        sized.join(t, sized["source"].eqNullSafe(t["t_source"]))
        .withColumn("rate", rate)
        .select(
            "source",
            F.ceil(F.col("n") / block).cast("long").alias("blocks"),
            F.struct(h.alias("h"), F.struct("id", "source", "size", F.col("n_row").alias("n")).alias("row"), F.floor("rate").cast("int").alias("base"), (F.col("rate") - F.floor("rate")).alias("f")).alias("item"),
        )
    )
    decided, left, level = [], most, 0
    while True:
        left = math.ceil(left / block)
        at = F.pmod(F.xxhash64("item.h", F.lit(level)), F.col("blocks"))
        grouped = open_.groupBy("source", at.alias("block")).agg(F.array_sort(F.collect_list("item")).alias("items"), F.max("blocks").alias("blocks"))
        done = stored(grouped.select("source", "blocks", _fold(level, seed, idt).alias("state")), f"mix-level{level}")
        decided.append(done.select(F.explode("state.done").alias("d")).select("d.row", "d.copies"))
        open_ = done.where("state.open is not null").select("source", F.ceil(F.col("blocks") / block).cast("long").alias("blocks"), F.col("state.open").alias("item"))
        level += 1
        if left <= 1:
            break
    u = F.pmod(F.xxhash64("item.h", F.lit(-1), F.lit(seed)), F.lit(1073741824)) / F.lit(1073741824.0)
    decided.append(open_.select("item.row", (F.col("item.base") + (u < F.col("item.f")).cast("int")).alias("copies")))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    out = out.select("row.id", "row.source", "row.size", F.col("row.n").alias("n_row"), "copies")
    return out.join(t, out["source"].eqNullSafe(t["t_source"])).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *([F.col("n_row").alias(row_col)] if row_col else [])
    )
