"""Jobs on the same links: a link is met once for all of them, and the columns are those of each job by itself."""

from pyspark.sql import functions as F

from plotweave.operators import spreg


def test_lags_of_jobs_on_the_same_links(spark):
    rows = spark.range(30).selectExpr("id", "explode(array('p', 'q')) AS job").selectExpr("job", "id", "CAST(id * id % 13 AS DOUBLE) AS y", "CAST(IF(job = 'p', id % 7, id % 5) AS DOUBLE) AS a")
    rows = rows.where("job = 'p' OR id != 29")  # a row that one job lacks
    links = spark.range(30).selectExpr("id AS i", "explode(array((id + 1) % 30, (id + 4) % 30)) AS j", "0.5D AS w")
    met = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            met.add(len(f))
            yield f

    both = {(r.job, r.id): tuple(r) for r in spreg.lagged(rows, links.mapInPandas(counted, links.schema), "y", ["a"]).collect()}
    assert len(both) == 59 and met.value <= 4 * 60
    for job in "pq":
        alone = spreg.lagged(rows.where(F.col("job") == job), links.withColumn("job", F.lit(job)), "y", ["a"]).collect()
        assert {(r.job, r.id): tuple(r) for r in alone} == {key: r for key, r in both.items() if key[0] == job}


def test_traces_meet_pairs_once_for_all_jobs(spark, monkeypatch):
    links = spark.range(30).selectExpr("id AS i", "explode(array((id + 1) % 30, (id + 4) % 30)) AS j", "0.5D AS w")
    squares = spark.range(30).selectExpr("explode(array('p', 'q')) AS job", "id").selectExpr("job", "id", "CAST(IF(job = 'p', id % 7, id % 5) AS DOUBLE) AS s2")
    pairs, asked, shared = spreg.common_pairs(links), [], spreg._shared_traces
    monkeypatch.setattr(spreg, "_shared_traces", lambda p, s: asked.append(1) or shared(p, s))
    got = spreg._traces(pairs, squares)
    assert asked == [1] and set(got) == {"p", "q"}
    for job in "pq":
        own = spreg._traces(pairs.withColumn("job", F.lit(job)), squares.where(F.col("job") == job))[job]
        assert abs(own - got[job]).max() < 1e-9
