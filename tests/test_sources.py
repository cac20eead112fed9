"""Tasks and results as data sources."""

import csv

import pytest
from pyspark.sql import functions as F
from tetragrid.sources import labelled, tables


def test_tasks_are_read_a_part_at_a_time(spark, tmp_path):
    for n, split in enumerate(("train", "test")):
        spark.createDataFrame([("ACGT", "2"), ("NA", "10"), ("a\nc", "10"), (None, "2")] * (3 - n), "s string, l string").repartition(3).write.csv(f"{tmp_path}/b/parts/{split}.csv", header=True, quoteAll=True)
        path = tmp_path / "a" / f"{split}.csv"
        path.parent.mkdir(exist_ok=True)
        with path.open("w", newline="") as out:
            csv.writer(out).writerows([("x", "x", "x"), ("gg", "1e3", "5"), ("", "7", ""), ("t", "1e3", "q")])
    (tmp_path / "half").mkdir()
    (tmp_path / "half" / "train.csv").write_text("s,l\nA,1\n")
    tables.register(spark)
    rows = spark.read.format("cgr_tasks").load(str(tmp_path))
    assert rows.columns == ["task", "split", "seq", "label_raw"] and rows.select("task").distinct().count() == 2
    parts = tables.parts_below(str(tmp_path))
    assert rows.rdd.getNumPartitions() == len(parts) >= 5
    for name, task in (("a", tmp_path / "a"), ("b/parts", tmp_path / "b" / "parts")):
        near = labelled.read_task(spark, str(tmp_path), name).drop("seq_id")
        far = labelled.load_task(spark, str(task / "train.csv"), str(task / "test.csv"), name).drop("seq_id")
        if name == "a":  # Spark's own reader takes a line break in quotes as the end of a row
            assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect()))
        assert near.where("seq is null or label is null").isEmpty()
    assert labelled.read_task(spark, str(tmp_path), "b/parts").where(F.col("seq") == "A\nC").count() == 5


def test_results_are_appended_and_seen_only_when_complete(spark, tmp_path):
    folder = f"file://{tmp_path}/results"
    for task in "ab":
        labelled.save_result(spark, folder, {"task": task, "mcc": 0.1, "unknown": 1})
    read = lambda: sorted((r.task, r.mcc, r.k) for r in spark.read.csv(folder, header=True, schema=labelled.RESULT_SCHEMA).collect())
    assert read() == [("a", 0.1, None), ("b", 0.1, None)]
    rows = spark.range(40).repartition(4).select(F.when(F.col("id") == 39, F.raise_error(F.lit("killed"))).otherwise(F.col("id").cast("string")).alias("task"))
    with pytest.raises(Exception, match="killed"):
        rows.write.format("cgr_results").mode("append").save(folder)
    assert read() == [("a", 0.1, None), ("b", 0.1, None)]  # a task that outlives the abort may leave a staged file, which no reader sees
    spark.range(40).repartition(4).select(F.col("id").cast("string").alias("task")).write.format("cgr_results").mode("append").save(folder)
    assert len(read()) == 42
    with pytest.raises(Exception, match="appended"):
        rows.write.format("cgr_results").mode("overwrite").save(folder)
