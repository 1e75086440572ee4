"""Every query with SQL equals DuckDB on the same tables; the others run and keep their schema."""

from __future__ import annotations

import pytest
from compare import connect, same

from heliograph.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, data, db, name):
    assert same(QUERIES[name](spark, data), db, ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize("name", ["queue", "leases"])
def test_streams_equal_replays(spark, data, name):
    stream, replay = {"queue": ("stream_job_queue", "replay_job_queue"), "leases": ("stream_leases", "replay_leases")}[name]
    rows = lambda n: sorted((tuple(r) for r in QUERIES[n](spark, data).collect()), key=str)
    assert rows(stream) == rows(replay)


def test_entry_and_registers(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_training_data_operators():
    from pathlib import Path

    root = Path(__file__).parent.parent
    found = [p for p in [*root.glob("heliograph/**/*.py"), root / "bench.py"] if "llm" not in p.parts and p.exists() and ("heliograph.llm" in p.read_text() or "from .llm" in p.read_text() or "from ..llm" in p.read_text())]
    assert not found
