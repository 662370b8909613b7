"""The corpus pipeline, each stage on its own input against a plain version; and the registered queries."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import check_packing, plain_cut, plain_groups, words

import __spark_entry__
import corpus_pipeline
from lodestore.llm import queries
from lodestore.llm.common import table


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    docs, out = table(spark, small, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, small).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(stages, spark, small):
    names = table(spark, small, "documents").columns
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == names


def test_toxic_documents_go(stages, spark, small):
    before, after = (texts(x) for x in stages["toxicity"])
    assert set(after) < set(before) and all(after[i] == before[i] for i in after)
    scored = {r["doc_id"]: r["predicted"] for r in queries.op9_toxicity(spark, small).collect()}
    assert set(after) == {i for i, p in scored.items() if not p}


def test_one_document_of_each_group_stays(stages):
    before, after = (texts(x) for x in stages["near_dup"])
    groups = plain_groups(before, 5, 80)
    assert after == {i: t for i, t in before.items() if groups[i][1] == i}


def test_repeated_passages_go(stages):
    before, after = (texts(x) for x in stages["suffix_dedup"])
    want = plain_cut(before)
    assert set(after) == set(before)
    for i, (size, removed, _) in want.items():
        assert (removed == 0) == (after[i] == before[i])
        assert size - removed - 3 * 4 <= len(after[i].encode()) <= size - removed
    assert all(r["n_chars"] == len(r["text"]) for r in stages["suffix_dedup"][1].collect())


def test_mix_repeats_documents_to_the_targets(stages):
    before, after = stages["mixing"]
    rows = before.select("doc_id", "text", "source").collect()
    size = Counter()
    for r in rows:
        size[r["source"]] += len(words(r["text"]))
    copies = Counter(r["doc_id"] for r in after.select("doc_id").collect())
    assert max(copies.values()) <= 2
    taken = sum(len(words(r["text"])) * copies[r["doc_id"]] for r in rows)
    longest = max(len(words(r["text"])) for r in rows)
    assert abs(taken - 1.5 * sum(size.values())) <= longest * len(size)


def test_mix_takes_rows_by_themselves(spark, small):
    """Two rows of one id, rows without an id and a plain one: each comes once or twice, and no row is lost."""
    rows = [(1, "one two", "en", "a", 7), (1, "one two three", "en", "a", 7), (None, "four five", "en", "a", 7), (None, "four five", "en", "a", 7), (2, "six", "en", "a", 7)]
    docs = spark.createDataFrame(rows, table(spark, small, "documents").schema)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mix(spark, docs, small).collect())
    assert set(got) == {r[:2] for r in rows}
    assert all(n <= 2 * sum(r[:2] == key for r in rows) for key, n in got.items())
    assert abs(sum(n * len(t.split()) for (_, t), n in got.items()) - 15) <= 3


def test_packing_holds_every_copy(stages):
    before, after = stages["packing"]
    docs, copies = texts(before), Counter(r["doc_id"] for r in before.select("doc_id").collect())
    pieces = after.collect()
    taken = Counter()
    for p in pieces:
        assert zlib.crc32(bytes(p["ids"])) == p["ids_crc32"]
        taken[p["doc_id"]] += p["length"]
    tokens = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    assert set(tokens) == set(docs)
    assert all(taken[i] == copies[i] * tokens[i] for i in docs)
    once = {i for i, n in copies.items() if n == 1}
    check_packing({i: docs[i] for i in once}, pieces_of(pieces, once))
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for group in by_sequence.values():
        at = 0
        for offset, length in sorted(group):
            assert offset == at
            at += length
        assert at <= 2048


def pieces_of(pieces, ids):
    """The pieces of some documents, each in a sequence of its own for the check of their ids."""
    return [p.asDict() | {"sequence_id": k, "offset": 0} for k, p in enumerate(pieces) if p["doc_id"] in ids]


def test_run_gives_the_last_stage(spark, small, stages):
    got = corpus_pipeline.run(spark, small)
    key = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = lambda df: sorted(tuple(r) for r in df.select(key).collect())
    assert rows(got) == rows(stages["packing"][1])


def test_stages_bear_awkward_rows(spark, small, tmp_path):
    names = table(spark, small, "documents").schema
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "word " * 30000, "en", "a", 1), (2, "word " * 30000, "en", "a", 1), (3, "ß" * 3000, None, "b", 1), (None, "some text here", "en", "a", 3)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, names)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{len(given)}-{k}")
            stage(spark, docs, small).write.parquet(path)
            docs = spark.read.parquet(path)
        if not given:
            assert docs.count() == 0


CLASHING = ("kept", "spans", "n_bytes", "text_was_null", "copies", "copy", "copy_number", "row", "id", "b", "size", "score", "least", "source_size", "keep_0", "a.b")


def test_stages_bear_columns_of_any_name(spark, small, tmp_path):
    docs = table(spark, small, "documents").where("doc_id < 60")
    more = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in CLASHING])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = [stage(spark, x, small) for x in (docs, more)]
        if k < 4:
            assert out[1].columns == more.columns
            path = str(tmp_path / str(k))
            out[1].write.parquet(path)
            more = spark.read.parquet(path)
            assert all(r[c] == f"{c}-{r['doc_id']}" for r in more.collect() for c in CLASHING)
            docs, plain = more.select(*docs.columns), out[0].collect()
            assert sorted(map(tuple, plain), key=str) == sorted(map(tuple, docs.collect()), key=str)
        else:
            assert sorted(map(tuple, out[0].collect()), key=str) == sorted(map(tuple, out[1].collect()), key=str)


def test_one_row_of_each_id_stays(spark, small):
    """Rows of one id with different texts: the smallest one decides, however the rows are dealt."""
    rows = [(i, t, "en", "a", i) for i, t in ((1, "b c d e f g"), (1, "a c d e f g"), (2, "a c d e f g"), (3, "z"), (None, "z"))]
    docs = spark.createDataFrame(rows, table(spark, small, "documents").schema)
    want = [(1, "a c d e f g"), (3, "z"), (None, "z")]
    for parts in (1, 3):
        got = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(parts), small).select("doc_id", "text").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_characters_are_not_torn(spark, small):
    """A replacement character that the text had stays; what a cut leaves of a character goes."""
    text = "".join(str(i) for i in range(60))
    docs = spark.createDataFrame([(1, "é" + text, "en", "a", 1), (2, "è" + text + "\ufffd", "en", "a", 1)], table(spark, small, "documents").schema)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.cut_repeated_passages(spark, docs, small).collect()}
    assert got == {1: ("é" + text, 111), 2: ("è\ufffd", 2)}


def test_registered_queries_run(spark, small):
    known = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {q.split("_")[0] for q in known} and "pipeline" in known
    n = table(spark, small, "documents").count()
    for name in ("op2_language", "op4_mixing", "op6_quality", "op7_near_dup", "op8_suffix_dedup", "op9_toxicity", "op12_merkle_manifest"):
        rows = known[name](spark, small)
        assert rows.count() == n and rows.select("doc_id").distinct().count() == n


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_match_sql(name, spark, small):
    from compare import connect, same_rows

    same_rows(queries.QUERIES[name](spark, small), connect(small), queries.ORACLE_SQL[name])


def test_held_out_accuracy(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    labels = table(spark, folder, "labels")
    got = queries.op6_quality(spark, folder).where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) >= 0.95
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    got = queries.op2_language(spark, folder).where("held_out").join(docs, "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.98


def test_held_out_toxicity(spark, small):
    """Most toxic documents are found and hardly any clean one is; a constant would find none."""
    folder = small.replace("sf0.001", "sf0.1")
    got = queries.op9_toxicity(spark, folder).where("held_out").join(table(spark, folder, "labels"), "doc_id").select("score", "predicted", "toxic").collect()
    toxic, clean = ([r for r in got if r["toxic"] == k] for k in (1, 0))
    assert len(toxic) > 80 and np.mean([r["predicted"] for r in toxic]) >= 0.85
    assert np.mean([r["predicted"] for r in clean]) <= 0.005
    above = np.array([r["score"] for r in toxic])[:, None] > np.array([r["score"] for r in clean])[None, :]
    assert above.mean() >= 0.95
