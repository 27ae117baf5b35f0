"""The operators' registered queries against their SQL, over the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tablegeo.llm.queries import ORACLE, QUERIES
from tests.conftest import plain, rows


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(name, spark, data):
    connection = duckdb.connect()
    for table in os.listdir(data):
        connection.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{data}/{table}'")
    found = QUERIES[name](spark, data)
    cursor = connection.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    order = [names.index(c) for c in sorted(names)]
    assert sorted(found.columns) == sorted(names)
    assert rows(found) == sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
