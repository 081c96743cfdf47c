"""Operators against their SQL twins, on whole tables."""

import duckdb
import pytest

from sluice.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import TABLES, canonical


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, name, size):
    folder = f"/root/testdata/{size}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    result = con.execute(ORACLE_SQL[name])
    expected = canonical([d[0] for d in result.description], result.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == expected
