"""Every query of the core that has SQL, against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tallyrad.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    found.execute("SET TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        found.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return found


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "-"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    result = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(plain(dict(zip(columns, r))[c]) for c in order) for r in result.fetchall())
    assert got == want
