"""Every corpus query that has SQL against it, run by DuckDB over the same tables."""

import decimal
import math
import os
from pathlib import Path

import duckdb
import pytest

from memlake.llm.queries import QUERIES
from memlake.llm.sql import ORACLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="the test tables are not here")


def comparable(value):
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else f"{float(value):.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    database = duckdb.connect()
    for table in Path(SF_DIR).glob("*.parquet"):
        database.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{table}')")
    result = QUERIES[name](spark, SF_DIR)
    columns = sorted(result.columns)
    got = sorted(tuple(comparable(r[c]) for c in columns) for r in result.collect())
    found = database.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(comparable(row[names.index(c)]) for c in columns) for row in found.fetchall())
