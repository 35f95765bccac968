"""What blocks and cross-validation no longer do, and that their results are those of plain computations."""

import numpy as np
from pyspark.sql import functions as F

from plotweave.operators import crossval, spreg


def test_cells_add_up_as_their_points_do(spark):
    """Most points are added up by whole cells; sums by start and centre are those of all points one by one."""
    rng = np.random.default_rng(3)
    xy = rng.integers(0, 300, (6000, 2)).astype(float)
    centres = xy[rng.permutation(len(xy))[:12]].reshape(3, 4, 2)
    cells = crossval._cells(spark.createDataFrame(xy.tolist(), "x double, y double"))
    assert cells.agg(F.sum("n")).first()[0] == len(xy)
    got = crossval._sums(cells, centres)
    for s in range(3):
        d = ((xy[:, None] - centres[s][None]) ** 2).sum(-1)
        own = d.argmin(1)
        plain = np.stack([np.bincount(own, w, 4) for w in (None, xy[:, 0], xy[:, 1], d.min(1))], 1)
        assert np.array_equal(got[s, :, :3], plain[:, :3]) and np.allclose(got[s], plain, rtol=1e-12)


def _rows(spark):
    return spark.range(60).selectExpr("id", "CAST(id * 37 % 61 AS DOUBLE) AS x", "CAST(id * 17 % 53 AS DOUBLE) AS y", "CAST(id % 3 AS STRING) AS fold", "CAST(id * id % 23 AS DOUBLE) AS v", "CAST(id % 11 AS DOUBLE) AS a", "CAST(id % 5 AS DOUBLE) AS b")


def test_least_squares_asks_for_no_links(spark, monkeypatch):
    monkeypatch.setattr(crossval, "training_links", lambda *a: 1 / 0)
    d = _rows(spark)
    got = {r.id: r.pred_trend for r in crossval.cross_validate(d, "v", {"both": ["a", "b"]}, 4, "ols").collect()}
    rows = d.toPandas()
    for f in "012":
        train, held = rows[rows.fold != f], rows[rows.fold == f]
        line = np.linalg.lstsq(np.column_stack([np.ones(len(train)), train.a, train.b]), train.v, rcond=None)[0]
        for r in held.itertuples():
            assert abs(got[r.id] - (line[0] + line[1] * r.a + line[2] * r.b)) < 1e-9


def test_models_need_no_pairs(spark, monkeypatch):
    """Predictions hang on coefficients alone; pairs of rows with a common neighbour only give their errors."""
    d = _rows(spark)
    links = crossval.training_links(d, 4)
    job = links.select(F.col("fold").alias("job"), "i", "j", "w")
    train = d.withColumn("job", F.explode(F.array(*map(F.lit, "012")))).where("job != fold")
    whole = spreg.fit_all(train, job, "v", ["b"])
    monkeypatch.setattr(spreg, "common_pairs", lambda *a: 1 / 0)
    got = crossval.cross_validate(d, "v", {"a": ["a"], "b": ["b"]}, 4).where("spec = 'b'").collect()
    assert len(got) == 60
    for r in got:
        f = whole[r.fold]
        value = d.where(F.col("id") == r.id).first().b if r.id < 2 else None
        assert abs(r.lambda_lag - f.coef[2]) < 1e-8
        assert value is None or abs(r.pred_trend - (f.coef[0] + f.coef[1] * value)) < 1e-8
