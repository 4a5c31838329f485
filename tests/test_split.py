import pytest
from pyspark.sql import functions as F

from sparkassay.operators import split as S


def sizes(df):
    return {r["_split"]: r["count"] for r in df.groupBy("_split").count().collect()}


@pytest.mark.parametrize(("n", "fraction", "want"), [(5, 0.2, (4, 1)), (5, 0.4, (3, 2)), (300, 0.2, (240, 60))])
def test_random_sizes(spark, n, fraction, want):
    got = sizes(S.random_split(spark.range(n), "id", fraction))
    assert (got["train"], got["test"]) == want


def test_temporal(spark):
    df = spark.createDataFrame([(v, i) for i, v in enumerate([3, 10, 1, 7, 4])], "v int, i int").withColumn("t", F.timestamp_seconds("i"))
    out = S.temporal_split(df, "t", "i", 0.4)
    assert [r["v"] for r in out.filter("_split = 'test'").orderBy("i").collect()] == [7, 4]


def test_stratified_partitions_rows(spark):
    df = spark.range(30).withColumn("y", F.sin("id"))
    got = sizes(S.stratified_split(df, "id", "y", 0.4))
    assert got == {"train": 18, "test": 12}


def test_folds_are_even(spark):
    got = sorted(r["count"] for r in S.k_folds(spark.range(17), "id", 5).groupBy("_fold").count().collect())
    assert got == [3, 3, 3, 4, 4]


def test_groups_stay_whole(spark):
    df = spark.range(200).withColumn("g", (F.col("id") % 13).cast("string")).withColumn("y", (F.col("id") % 2).cast("int"))
    out = S.group_folds(df, "g", "y", 4)
    assert out.count() == 200 and out.groupBy("g").agg(F.count_distinct("_fold").alias("n")).filter("n > 1").count() == 0


def test_butina_leads_with_most_neighbours(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 5)], "a long, b long")
    got = {r["id"]: r["cluster"] for r in S.butina(pairs, spark.range(1, 7), "id").collect()}
    assert got[1] == got[2] == got[3] == 1 and got[4] == got[5] and len(set(got.values())) == 3


def test_predefined(spark):
    df = spark.createDataFrame([(0, -1), (1, 0), (2, 1), (3, None)], "id int, f int")
    assert {r["id"]: r["_split"] for r in S.predefined_split(df, "f").collect()} == {0: "train", 1: "test", 2: "train"}
