"""A training corpus from ``documents``: toxic documents go, near duplicates go, repeated passages go, sources are mixed, the rest is packed.

Each stage takes what the one before kept, as (spark, docs, sf_dir), and returns a
DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import mixing, near_dup, packing, suffix_dedup, toxicity
from lodestore.llm.common import crc_mod, stored, table

#: Random draws and iterative grouping are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, learned from the labelled rows that ``op9`` learns from."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0))


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` as doc_id, text and one struct of all its columns, so that names of theirs clash with none that an operator uses."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from the struct."""
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; five-word shingles, similarity 0.8 or more. Of rows with the same id the one with the smallest text stays, once, then by the other columns in order; rows without an id stay."""
    groups = near_dup.near_duplicates(docs)
    named = groups.where("doc_id is not null")
    rows, ids = named.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    packed = _packed(docs)
    if rows > ids:
        least = packed.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("text", "row")).alias("least"))
        packed = least.select("doc_id", "least.text", "least.row").unionByName(packed.where("doc_id is null"))
    dropped = named.where("not kept").select("doc_id").distinct()
    return _unpacked(packed.join(dropped, "doc_id", "left_anti"), docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the strings of 50 bytes that an earlier one holds; bytes left of a character that is cut into go. ``n_chars`` follows the text."""
    rest = [c for c in docs.columns if c != "text"]
    row = F.struct(F.col("text").isNull().alias("was_null"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"))
    cut = suffix_dedup.repeated_spans(docs.select("doc_id", "text", row.alias("row")), keep=("row",), whole_characters=True)
    text = F.when(~F.col("row.was_null"), F.col("kept").cast("string"))
    new = {"text": text}
    if "n_chars" in rest:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[new.get(c, F.col(f"row.rest.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows without an id and rows of one id are each a row of their own."""
    numbered = stored(_packed(docs).withColumn("number", F.monotonically_increasing_id()), "pipeline-numbered")
    given = numbered.select("number", "doc_id", "text", "row.source")
    mixed = mixing.mix_sources(given, row_col="number").where("copies > 0").select("number", "copies")
    copies = numbered.join(mixed, "number")
    return _unpacked(copies.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("toxicity", drop_toxic), ("near_dup", drop_near_duplicates), ("suffix_dedup", cut_repeated_passages), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
