from __future__ import annotations

import pytest
from compare import connect, same

from heliograph.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, data, name):
    assert same(QUERIES[name](spark, data), connect(data), ORACLE_SQL[name]) == ""
