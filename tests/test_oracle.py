"""Every query with SQL gives the same rows in Spark and DuckDB."""

from __future__ import annotations

import pytest
from compare import differences

from verisift.catalog import all_queries

CHECKED = [q for q in all_queries() if q.sql is not None]


@pytest.mark.parametrize("query", CHECKED, ids=lambda q: q.name)
def test_same_rows(spark, sf_dir, query):
    assert differences(query.build(spark, sf_dir), query.sql, sf_dir) == []


def test_names_are_unique():
    names = [q.name for q in all_queries()]
    assert len(names) == len(set(names))
