"""Work that several results share is done once: rows that come from a UDF are counted as they are made."""

import pytest
from pyspark.sql import functions as F

from plotweave.operators import funnel, stats


@pytest.fixture
def counted(spark):
    made = spark.sparkContext.accumulator(0)

    def rows(frames):
        for f in frames:
            made.add(len(f))
            yield f

    df = spark.range(100).selectExpr("id", "CAST(id * id % 17 + 1 AS DOUBLE) AS x1", "CAST(id % 13 + 1 AS DOUBLE) AS x2", "CAST(id % 7 + 1 AS DOUBLE) AS v")
    return df.mapInPandas(rows, df.schema), made


def test_specifications_share_a_pass(counted):
    df, made = counted
    specs = {"a": ["x1"], "b": ["x2"], "c": ["x1", "x2"]}
    found = stats.ols_all(df, "v", specs)
    assert made.value == 100
    for name, xs in specs.items():
        assert found[name].coef == pytest.approx(stats.ols(df, "v", xs).coef)


def test_specifications_have_their_own_rows(spark):
    df = spark.range(50).selectExpr("IF(id % 5 = 0, NULL, CAST(id % 11 AS DOUBLE)) AS x1", "IF(id % 3 = 0, DOUBLE('NaN'), CAST(id % 7 AS DOUBLE)) AS x2", "CAST(id * id % 19 AS DOUBLE) AS v")
    found = stats.ols_all(df, "v", {"a": ["x1"], "b": ["x2"], "c": ["x1", "x2"]})
    assert [found[s].n for s in "abc"] == [40, df.where(~F.isnan("x2")).count(), df.where("x1 IS NOT NULL").where(~F.isnan("x2")).count()]


def test_steps_of_a_funnel_share_their_rows(counted):
    df, made = counted
    log = funnel.count_log(funnel.exclude(df, ["positivity", "iqr_outliers"], ["v"], "v")).collect()
    assert [r["n"] for r in log] == [100, 100, 100]
    assert made.value == 100
