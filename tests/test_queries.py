"""Every library query against its SQL twin, run by DuckDB over the same tables."""

import decimal
import math
import os
from pathlib import Path

import duckdb
import pytest

from memlake import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="the test tables are not here")


def comparable(value):
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return str([comparable(v) for v in value])
    return str(value)


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{table}')")
    return connection


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_its_sql(spark, database, name):
    result = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(result.columns)
    assert len(set(columns)) == len(columns)
    got = sorted(tuple(comparable(r[c]) for c in columns) for r in result.collect())
    if name not in queries.ORACLES:
        # Greedy folds: tests/test_prefetch.py has their plain Python.
        assert got
        return
    found = database.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(comparable(row[i]) for i in at) for row in found.fetchall())


def test_every_oracle_has_a_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_the_entry_works_without_the_corpus_operators(tmp_path):
    """A copy of the repository without the corpus folders and the pipeline still imports and lists its queries."""
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "memlake", tmp_path / "memlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'pipeline' not in q and set(o) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == len(queries.QUERIES)
