import pytest
from pyspark.sql import functions as F

from changeloom.operators import contracts, nested, relational, review, search


@pytest.fixture(scope="module")
def one(spark):
    """Rows as one task reads them from one small file."""
    return spark.createDataFrame([(i, f"src/lib/f{i}.ts", '{"a":1}') for i in range(40)], "id int, path string, json string").coalesce(1)


def n_tasks(frame):
    return frame.rdd.getNumPartitions()


def test_scores_are_spread_and_worked_out_once(spark, one):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(x):
        seen.add(1)
        return float(x) if x % 2 else None

    found = search.scored(one, score("id"))
    assert n_tasks(found) == 4 and sorted(r.score for r in found.collect()) == [float(i) for i in range(1, 40, 2)] and seen.value == 40
    assert n_tasks(relational.spread(one)) == 4


def test_costly_rows_are_spread(one, monkeypatch):
    lines = one.select("id", F.col("path").alias("a"), F.upper("path").alias("b"))
    assert n_tasks(review.block_diff(lines, "a", "b", "id")) == 4
    assert n_tasks(contracts.hunks(one.select("path", F.lit("modified").alias("status"), F.lit("@@ -1 +1 @@\n-a\n+b").alias("patch")))) == 4
    read, before = [], nested.cut
    monkeypatch.setattr(nested, "cut", lambda d, name="step": (read.append(n_tasks(d)), before(d, name))[1])
    assert nested.attributes(one, "json", ["id"]).count() == 40 and read[0] == 4
