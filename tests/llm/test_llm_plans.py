"""The operators that must be DataFrame operations run nothing in Python."""

import pytest

from lodestore.llm import queries


@pytest.mark.parametrize("name", ["op1_url_filter", "op4_mixing"])
def test_no_python_on_the_executors(name, spark, small):
    df = queries.QUERIES[name](spark, small)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))


def test_pages_are_shuffled_once_without_their_html(spark, small):
    text = queries.QUERIES["op1_url_filter"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in text
