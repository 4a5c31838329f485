import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from sparkassay.functions import mathx
from sparkassay.operators.transform import Base, Log, Threshold, z_scales


@pytest.mark.parametrize("base", list(Base))
@pytest.mark.parametrize("negate", [False, True])
@pytest.mark.parametrize("conversion", [0, 5, 6])
def test_log_round_trip(spark, base, negate, conversion):
    t = Log(base, negate, conversion)
    df = spark.createDataFrame([(x,) for x in (0.1, 1.0, 10.0, 123.0)], "y double")
    for r in df.select("y", t.inverse(t.forward(F.col("y"))).alias("z")).collect():
        assert math.isclose(r["y"], r["z"], rel_tol=1e-9)


def test_pxc50(spark):
    df = spark.createDataFrame([(x,) for x in (1000.0, 100.0, 10.0, 1.0, 0.1)], "y double")
    got = [r[0] for r in df.select(Log(negate=True, conversion=6).forward(F.col("y"))).collect()]
    assert [round(x, 9) for x in got] == [3, 4, 5, 6, 7]


def test_normal_functions(spark):
    zs = [-5.5, -3.0, -0.4, 0.0, 0.2, 0.7, 2.5, 4.5]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", mathx.erf(F.col("z")).alias("e"), mathx.normal_cdf(F.col("z")).alias("p")).collect()
    for r in rows:
        assert abs(r["e"] - math.erf(r["z"])) < 3e-16 and abs(r["p"] - NormalDist().cdf(r["z"])) < 3e-16
    ps = [1e-12, 0.001, 0.2, 0.5, 0.9, 0.99999]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", mathx.normal_quantile(F.col("p")).alias("z")).collect():
        assert math.isclose(r["z"], NormalDist().inv_cdf(r["p"]), rel_tol=1e-12, abs_tol=1e-15)


def test_threshold(spark):
    t = Threshold(7, 0.2)
    got = [r[0] for r in spark.createDataFrame([(9.5,), (7.0,), (4.0,)], "y double").select(t.forward(F.col("y"))).collect()]
    assert [round(x, 6) for x in got] == [1, 0.5, 0]


def test_vector_and_z_scales(spark):
    df = spark.createDataFrame([("0.7, 0.8, 1", "AC"), ("x", "AB")], "v string, s string")
    a, b = df.select(mathx.vector(F.col("v")).alias("v"), z_scales(F.col("s")).alias("z")).collect()
    assert a["v"] == [0.7, 0.8, 1.0] and b["v"] == [None] and b["z"] is None
    assert [round(x, 3) for x in a["z"]] == [0.54, -1.995, 2.155, 0.02, -0.675]


def test_log_of_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (-1.0,), (None,)], "y double")
    for base in Base:
        plain, limits = Log(base, True, 3), Log(base, True, 3, limits=True)
        rows = df.select(plain.forward(F.col("y")).alias("p"), limits.forward(F.col("y")).alias("l"), limits.inverse(limits.forward(F.col("y"))).alias("i")).collect()
        assert [tuple(r) for r in rows] == [(None, math.inf, 0.0)] * 2 + [(None, None, None)] * 2
