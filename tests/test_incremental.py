from pyspark.sql import functions as F

from sparkassay.streaming import incremental as I


def _files(folder, texts):
    folder.mkdir(exist_ok=True)
    for day, text in texts.items():
        (folder / f"a.{day}.csv").write_text(text)


def _rows(keys):
    return "task,key,value\n" + "".join(f"t,k{j},>{j + 0.5}\n" for j in keys)


def test_buckets_one_by_one_equal_all_at_once(spark, tmp_path):
    _files(tmp_path / "in", {day: _rows(range(i, i + 4)) + "t,bad,none\n" for i, day in enumerate(("2024-01-01", "2024-02-01", "2024-03-01"))})
    history = I.History(spark, str(tmp_path / "h"), "task", "key", "value")
    for _ in range(2):  # a second run finds nothing new
        I.run(spark, str(tmp_path / "in"), history, str(tmp_path / "c"))
    assert sorted(r["key"] for r in history.read().collect()) == [f"k{j}" for j in range(6)]
    assert history.merge(history.read().select("task", "key", F.col("value").cast("string").alias("value"), "bucket")) == 0
    assert history.ready(6).first()["met"]


def test_five_dated_files(spark, tmp_path):
    """New rows, more of them, a renamed column, repeated rows, nothing but nulls: all are booked, in date order."""
    src, seen = tmp_path / "in", []
    _files(src, {"2024-02-01": _rows(range(3, 8)), "2024-01-01": _rows(range(5))})
    history = I.History(spark, str(tmp_path / "h"), "task", "key", "value")
    I.run(spark, str(src), history, str(tmp_path / "c"), lambda batch, before: seen.append((batch.count(), before.count())))
    assert seen == [(5, 0), (5, 5)]
    _files(src, {"2024-03-01": "missing_task,key,value\nt,k90,>1\n", "2024-04-01": "value,key,task\n3.5,k3,t\n", "2024-05-01": "task,key,value\n,,\n,,\n"})
    I.run(spark, str(src), history, str(tmp_path / "c"))
    ledger = [(str(r["bucket"]), r["state"], r["rows"]) for r in history.ledger().orderBy("bucket").collect()]
    assert ledger == [("2024-01-01", "processed", 5), ("2024-02-01", "processed", 3), ("2024-03-01", "bad header", 0), ("2024-04-01", "no new data", 0), ("2024-05-01", "no new data", 0)]
    assert sorted(r["key"] for r in history.read().collect()) == [f"k{j}" for j in range(8)]


def test_fan_out_goes_on_after_errors():
    def work(task):
        if task == "b":
            raise ValueError("no rows")
        return "processed"

    assert I.fan_out(["c", "b", "a"], work) == {"a": "processed", "b": "failed: no rows", "c": "processed"}


def test_states_and_classes(spark):
    rows = spark.createDataFrame([(0,), (1,), (60_000,), (60_001,), (80_001,)], "n long").select(I.memory_class(F.col("n")).alias("m")).collect()
    assert [r["m"] for r in rows] == [30, 60, 60, 90, 120]
    got = spark.range(1).select(I.status(F.lit(False), F.lit(False), F.lit(False), F.lit(True)).alias("a"), I.status(F.lit(False), F.lit(True), F.lit(True), F.lit(True)).alias("b"), I.retry(F.lit(5)).alias("c")).first()
    assert (got["a"], got["b"], got["c"]) == ("no new data", "locked", None)
    capped = spark.range(1).select(I.retry(F.lit(3), caps=(50, 10_000, 4)).alias("c")).first()["c"]
    assert tuple(capped) == (50, 2160, 4)
