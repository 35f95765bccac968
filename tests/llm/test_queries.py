"""The queries of the subpackage on the smallest tables, and those with SQL beside it."""

import os
from pathlib import Path

import pytest

from plotweave.llm import queries

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    import duckdb

    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    assert mine
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for p in Path(SF).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        rel = con.sql(queries.ORACLE_SQL[name])
        assert mine == sorted(rel.select(*[f'"{c}"' for c in cols]).fetchall(), key=repr)


def test_entry_lists_them():
    import __spark_entry__

    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
