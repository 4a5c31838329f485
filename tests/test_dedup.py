from pyspark.sql import functions as F

from sparkassay.operators import dedup as D

ROWS = [("CCC", 3, 0), ("CCC", 10, 1), ("CCC", 1, 2), ("CCCCC", 4, 3), ("CCC", 7, 4), ("CCCCC", 5, 5)]


def frame(spark):
    return spark.createDataFrame([(k, float(v), i) for k, v, i in ROWS], "k string, v double, i int")


def values(df):
    return {r["k"]: r["v"] for r in df.collect()}


def test_strategies(spark):
    df = frame(spark)
    assert values(D.keep_first(df, ["k"], ["i"])) == {"CCC": 3, "CCCCC": 4}
    assert values(D.keep_last(df, ["k"], ["i"])) == {"CCC": 7, "CCCCC": 5}
    assert values(D.keep_min(df, ["k"], "v")) == {"CCC": 1, "CCCCC": 4}
    assert values(D.keep_max(df, ["k"], "v")) == {"CCC": 10, "CCCCC": 5}
    assert values(D.keep_avg(df, ["k"], "v")) == values(D.keep_avg(df, ["k"], "v", 2)) == {"CCC": 5.25, "CCCCC": 4.5}
    assert values(D.keep_median(df, ["k"], "v")) == {"CCC": 5, "CCCCC": 4.5}
    assert D.keep_all(df).count() == 6


def test_random_is_a_row_of_its_key_and_repeatable(spark):
    df = frame(spark)
    a, b = (values(D.keep_random(x, ["k"], ["i"], 1)) for x in (df, df.orderBy(F.desc("i"))))
    assert a == b and a["CCC"] in (3, 10, 1, 7) and a["CCCCC"] in (4, 5)


def test_tie_votes_positive(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0), ("c", 1)], "k string, v int")
    assert values(D.vote(df, ["k"], "v")) == {"a": 1, "b": 0, "c": 1}


def test_auxiliary_is_part_of_the_key(spark):
    df = frame(spark).withColumn("aux", F.when(F.col("i") < 3, 10).otherwise(5))
    assert sorted(round(r["v"], 4) for r in D.keep_avg(df, ["k", "aux"], "v").collect()) == [4.5, 4.6667, 7]
