from pyspark.sql import Window
from pyspark.sql import functions as F
from tetragrid.operators.metrics import stratified_folds


def test_folds_are_those_of_ntile_and_no_class_is_one_group(spark):
    rows = [(i * 7 % 1009, 0 if i % 10 else 1, "x") for i in range(1000)] + [(2000 + i, 2, "y") for i in range(3)] + [(3000 + i, None, None) for i in range(6)]
    table = spark.createDataFrame(rows, "row_id long, label long, more string").repartition(3)
    for folds in (1, 4, 7):
        got = stratified_folds(table, folds)
        want = table.withColumn("fold", F.ntile(folds).over(Window.partitionBy("label").orderBy("row_id")) - 1)
        assert got.schema["fold"].dataType == want.schema["fold"].dataType
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "ntile" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert stratified_folds(table.where("false")).collect() == []
