"""Objects of no bytes are objects: they are listed and counted as by the queries' SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestore.plans import registry
from lodestore.plans.catalog import VIEWS
from lodestore.sources import files

from compare import same_rows


@pytest.fixture(scope="module")
def blanks(spark, small, tmp_path_factory):
    """The smallest documents, some of them emptied; those of two sources and one with a dot are among them."""
    folder = str(tmp_path_factory.mktemp("blanks"))
    rows = spark.read.parquet(f"{small}/documents.parquet")
    blank = F.col("doc_id").isin(7, 20) | (F.col("doc_id") % 10 == 1)
    rows.withColumn("text", F.when(blank, "").otherwise(F.col("text"))).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    con.execute(f"create view files as {VIEWS['files']}")
    assert con.execute("select count(*) > 0 from files where size = 0 and starts_with(path, '/src1')").fetchone()[0]
    return folder, con


def test_adapters_count_empty_objects(spark, blanks):
    folder, con = blanks
    same_rows(registry.queries()["ext_adapters"](spark, folder), con, registry.oracle_sql()["ext_adapters"])


def test_connectors_count_empty_objects(spark, blanks):
    folder, con = blanks
    same_rows(registry.queries()["src_connectors"](spark, folder), con, registry.oracle_sql()["src_connectors"])


def test_a_prefix_lists_empty_objects(spark, blanks):
    folder, con = blanks
    same_rows(registry.queries()["src_cloud"](spark, folder), con, registry.oracle_sql()["src_cloud"])


def test_other_prefixes_are_not_listed(tmp_path, monkeypatch):
    """Not even to find the folders below them."""
    from lodestore.sources import mounted as M

    for p in ("src1/en", "src10/en", "src2/en"):
        (tmp_path / p).mkdir(parents=True)
    reader = M.FolderReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([M.StringStartsWith(("path",), "src1")]))
    seen, folders = [], reader._folders
    monkeypatch.setattr(reader, "_folders", lambda path: seen.append(path) or folders(path))
    assert [p.path for p in reader.partitions()] == ["", "src1", "src1/en", "src10", "src10/en"] and seen == ["", "src1", "src10"]


def test_a_scan_gives_empty_files(spark, tmp_path):
    made = {"a/full.txt": b"x", "a/none.txt": b"", "none.log": b"", "_k=1/p.txt": b"", ".dot/f.txt": b"x", "a/_under.txt": b"x", "a/.dot.txt": b"", "ab/f.txt": b"12"}
    for path, content in made.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    seen = {p: len(c) for p, c in made.items() if p in ("a/full.txt", "a/none.txt", "none.log", "_k=1/p.txt", "ab/f.txt")}
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        rows = files.scan(spark, root).collect()
        assert {r["path"].removeprefix(f"file:{tmp_path}/"): r["size"] for r in rows} == seen and all(len(r["sha256"]) == 64 and r["mdate"] for r in rows)
    names = lambda **k: {r["path"].removeprefix(f"file:{tmp_path}/") for r in files.scan(spark, str(tmp_path), hashed=False, **k).collect()}
    assert names(pattern="*.{txt,md}") == {p for p in seen if p.endswith(".txt")} and names(pattern="none.*") == {"a/none.txt", "none.log"}
    assert names(prefix="a") == {"a/full.txt", "a/none.txt", "ab/f.txt"} and names(prefix="a/n") == {"a/none.txt"}
    assert names(max_file=0) == {"a/none.txt", "none.log", "_k=1/p.txt"}
