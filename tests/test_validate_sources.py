import pytest
from pyspark.sql import functions as F

from sparkassay.functions import mathx
from sparkassay.operators import validate as V
from sparkassay.sources import readers as R


def test_boolean_spellings(spark):
    rows = ["True", "true", "1", "1.0", "False", "false", "0", "0.0", "maybe", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "v string").select(mathx.boolean(F.col("v"))).collect()]
    assert got == [1, 1, 1, 1, 0, 0, 0, 0, None, None]


def test_issues_are_raised_with_rows(spark):
    df = spark.createDataFrame([(1, "5"), (2, "bad"), (3, None)], "line int, y string")
    with pytest.raises(V.RowIssues) as e:
        V.read_response(df, "y", False, "line")
    assert [r["line_number"] for r in e.value.rows.collect()] == [2]


def test_sets(spark):
    with pytest.raises(V.NoData):
        V.check_set(spark.range(0).withColumn("y", F.lit(1)), "y", True)
    with pytest.raises(V.NoData):
        V.check_set(spark.range(4).withColumn("y", F.col("id")), "y", False)
    V.check_set(spark.range(4).withColumn("y", F.col("id") % 2), "y", True)


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("k, y\nCC, 1.5\nCÉ, 2\n".encode("latin-1"))
    assert [(r["k"], r["y"]) for r in R.read_table(spark, str(p)).collect()] == [("CC", 1.5), ("CÉ", 2.0)]
    with pytest.raises(R.UnsupportedFormat):
        R.read_table(spark, "a.xlsx")
    with pytest.raises(R.MissingColumns):
        R.read_columns(spark, str(p), ["k", "nothing"])


def test_sdf(spark, tmp_path):
    p = tmp_path / "a.sdf"
    p.write_text("mol1\n x\n\n  0  0\nM  END\n> <id>\n7\n\n$$$$\nmol2\n x\n\nM  END\n> <id>\n8\n\n> <y>\n1.5\n\n$$$$\n")
    rows = R.read_table(spark, str(p)).orderBy("name").collect()
    assert [r["name"] for r in rows] == ["mol1", "mol2"] and rows[1]["properties"] == {"id": "8", "y": "1.5"}


def test_dated(spark, tmp_path):
    for name in ("assay.2024-02-01.csv", "assay.2024-01-01.csv"):
        (tmp_path / name).write_text("a\n1\n")
    assert [str(r["bucket"]) for r in R.dated_files(spark, str(tmp_path / "*.csv")).collect()] == ["2024-01-01", "2024-02-01"]
