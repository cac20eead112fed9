"""Labelled sequence tasks as CSV folders, and the table of results."""

from __future__ import annotations

import csv
import os
from datetime import datetime
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.metrics import label_codes
from . import tables

#: Fixed columns of a result row, in order.
RESULT_SCHEMA = "task string, method string, k string, grid_size int, feature_dim int, train_size bigint, test_size bigint, n_classes int, mcc double, auroc double, f1_macro double, accuracy double, best_params string, timestamp string"


def discover_tasks(spark: SparkSession, root: str) -> DataFrame:
    """(name, train_path, test_path) of every folder below root that holds train.csv and test.csv, by name; only paths are read.

    Either may be a file or a folder of parts.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    part = lambda group: F.regexp_extract("path", r"^(.*)/(train|test)\.csv(?:/[^/]*)?$", group)
    sides = files.select(part(1).alias("folder"), part(2).alias("side")).where("side <> ''")
    path = lambda side: F.max(F.when(F.col("side") == side, F.concat("folder", F.lit(f"/{side}.csv")))).alias(f"{side}_path")
    both = sides.groupBy("folder").agg(path("train"), path("test"))
    top = F.lit(root.split("://")[-1].removeprefix("file:").rstrip("/"))
    plain = F.regexp_replace("folder", "^[a-z0-9]+:/*(?=/)", "")
    name = F.when(plain == top, ".").otherwise(F.expr("substring(plain, length(top) + 2)"))
    both = both.where("train_path is not null and test_path is not null").withColumn("plain", plain).withColumn("top", top)
    return both.select(name.alias("name"), "train_path", "test_path").orderBy("name")


def load_task(spark: SparkSession, train_path: str, test_path: str, name: str = ".") -> DataFrame:
    """(seq_id, task, split, seq, label): the first column is the sequence, the second its label; names are ignored.

    An empty cell is an empty sequence; a row without a label fails the query
    that reads it.
    """

    def side(path: str, split: str) -> DataFrame:
        table = spark.read.csv(path, header=True)
        table = table.select(F.col(f"`{table.columns[0]}`").alias("seq"), F.col(f"`{table.columns[1]}`").alias("label_raw"))
        return table.withColumn("split", F.lit(split))

    return _coded(side(train_path, "train").unionByName(side(test_path, "test")).withColumn("task", F.lit(name)))


def _coded(rows: DataFrame) -> DataFrame:
    """(seq_id, task, split, seq, label) of one task's (task, split, seq, label_raw)."""
    rows = rows.withColumn("seq_id", F.monotonically_increasing_id())
    # Spark broadcasts the codes where they are few; an error in a row without a label comes when it is read
    coded = rows.join(label_codes(rows), "label_raw", "left").withColumn("label", F.coalesce("label", F.raise_error(F.lit("a row has no label")).cast("int")))
    return coded.select("seq_id", "task", "split", F.upper(F.coalesce("seq", F.lit(""))).alias("seq"), F.col("label").cast("int").alias("label"))


def read_task(spark: SparkSession, root: str, name: str) -> DataFrame:
    """As load_task, for a task below root, through the data source `cgr_tasks`: a partition for each CSV part."""
    tables.register(spark)
    return _coded(spark.read.format("cgr_tasks").load(root).where(F.col("task") == name))


def save_result(spark: SparkSession, path: str, result: dict) -> None:
    """Appends a result: a line of a local file that ends in .csv, with a header in a new one, else a part of a folder, which is seen when it is complete.

    Unknown keys are left out, missing ones empty.
    """
    schema = StructType.fromDDL(RESULT_SCHEMA)
    row = result | {"timestamp": datetime.now().isoformat()}
    place = urlparse(path)
    if path.endswith(".csv") and place.scheme in ("", "file"):
        new = not os.path.exists(place.path)
        with open(place.path, "a", newline="") as out:
            lines = csv.DictWriter(out, schema.names, restval="", extrasaction="ignore")
            if new:
                lines.writeheader()
            lines.writerow(row)
        return
    tables.register(spark)
    spark.createDataFrame([tuple(row.get(f.name) for f in schema)], schema).coalesce(1).write.format("cgr_results").mode("append").save(path)
