import pytest
from pyspark.sql import functions as F

from sparkassay.plans import config as C
from sparkassay.plans import pipeline as P
from sparkassay.plans import search as S


def frame(spark):
    x = spark.range(120).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.array(F.sin("id"), F.cos("id")).alias("v"))
    return x.withColumn("m", 10 + 3 * F.get("v", F.lit(0)) - 2 * F.get("v", F.lit(1)))


def data(**more):
    return C.Dataset("key", "m", vector_column="v", split="Random", split_params={"fraction": 0.25}, **more)


def test_build_and_predict(spark):
    rows = P.prepared(spark, data(log={"base": "log2"}), frame(spark))
    built = P.build(rows, C.Build(data(log={"base": "log2"}), "Ridge", {"alpha": 0.01}))
    assert built.scores["test"]["r2"] > 0.9 and rows.count() == 120
    out = built.predict(frame(spark).select("key", "m", F.col("v").alias("features")).unionByName(spark.createDataFrame([("none", 1.0, None)], "key string, m double, features array<double>")))
    assert out.filter("prediction IS NULL").count() == 1
    assert out.filter("abs(prediction - m) < 3").count() == 120


def test_search(spark):
    settings = C.Settings(cross_validation=2, n_trials=4, n_startup_trials=2, random_seed=1)
    config = C.Optimization(data(), ["Ridge", "Lasso"], settings)
    rows = P.prepared(spark, config.data, frame(spark))
    trials = S.optimize(rows, config)
    assert [t.params for t in trials] == [t.params for t in S.optimize(rows, config)]
    top = S.best(trials)
    assert top.value == max(t.value for t in trials) and S.trial_rows(spark, trials).count() == len(trials)
    assert S.best(trials, minimise_std_dev=True) in trials


def test_configs_are_strict():
    c = C.Build(data(), "Ridge", {"alpha": 1.0})
    assert C.read(C.write(c)) == c
    with pytest.raises(C.UnknownKeys):
        C.strict(C.Settings, {"n_bits": 3})
    assert C.json_schema(C.Build)["required"] == ["data", "algorithm"]
