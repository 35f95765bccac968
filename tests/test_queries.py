"""Every query of the library beside its SQL in DuckDB on the smallest tables."""

import os
from pathlib import Path

import pytest

from plotweave.plans import registry

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    if name in registry.ORACLE_SQL:
        rel = db.sql(registry.ORACLE_SQL[name])
        assert sorted(rel.columns) == cols
        theirs = sorted(rel.select(*[f'"{c}"' for c in cols]).fetchall(), key=repr)
        assert mine == theirs
    spark.catalog.clearCache()


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
