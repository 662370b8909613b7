"""Plans: columns and filters reach the scan, nothing runs in Python that need not, no cross join of two large sides."""

import pytest

import __spark_entry__
from lodestore.plans import registry

QUERIES = registry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("agg_task_counts", {"o_orderkey"}),
        ("flt_dedup_logs", {"o_orderkey", "o_orderdate"}),
        ("fn_md5_shard", {"doc_id", "text"}),
        ("agg_alert_summary", {"event_id"}),
        ("agg_economics", {"text"}),
    ],
)
def test_only_needed_columns_are_read(name, columns, spark, small):
    text = plan(QUERIES[name](spark, small))
    read = {c.split(":")[0] for part in text.split("ReadSchema: struct<")[1:] for c in part.split(">")[0].split(",")}
    assert read == columns


def test_filters_reach_the_scan(spark, small):
    assert "EqualTo(source,src2)" in plan(QUERIES["scan_by_type"](spark, small))


@pytest.mark.parametrize("name", ["agg_storage_stats", "agg_duplicates_staged", "op_parse_line", "agg_log_block", "win_burst", "tier_classify", "join_ring_route", "cdc_fixed", "win_hash_chain", "win_ema_background", "join_manifest_verify", "agg_clip", "bloom_build", "agg_bloom_count", "delete_workflow", "fn_log_timestamp", "join_restore_files", "win_frame_diff"])
def test_no_python_where_expressions_do(name, spark, small):
    text = plan(QUERIES[name](spark, small))
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text


def test_entry_and_registry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)


def test_storage_filters_reach_a_mounted_source(spark, tmp_path):
    """One folder of three is opened, and Spark has nothing left to filter by storage."""
    from lodestore.sources import mounted as M

    for i in range(3):
        (tmp_path / f"s{i}" / "d").mkdir(parents=True)
        (tmp_path / f"s{i}" / "d" / "f").write_text("x" * i)
    rows = M.mounted_files(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 7
    one = rows.where("storage_id = 's1'")
    assert one.rdd.getNumPartitions() == 2 and one.count() == 1
    assert "storage_id" not in plan(one).split("Filter")[-1].split("\n")[0] or "Filter" not in plan(one)
