"""Classification metrics from (label, prediction) rows; what is joined is of the number of classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import ranged


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "prediction").agg(F.count("*").alias("cnt"))


def _by_class(rows: DataFrame) -> DataFrame:
    """(class, t, p, tp): rows of it, rows predicted as it, and both."""
    cells = confusion(rows)
    zero = F.lit(0).cast("long")
    side = lambda kind, t, p, tp: F.struct(F.col(kind).cast("long").alias("class"), t.alias("t"), p.alias("p"), tp.alias("tp"))
    both = F.when(F.expr("label = prediction"), F.col("cnt")).otherwise(zero)
    sides = cells.select(F.explode(F.array(side("label", F.col("cnt"), zero, both), side("prediction", zero, F.col("cnt"), zero))).alias("s")).select("s.*")
    return sides.groupBy("class").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))


def scores(rows: DataFrame) -> DataFrame:
    """One row: accuracy, macro_f1 and mcc; rows with a null on either side are left out."""
    rows = rows.where("label is not null and prediction is not null")
    s = _by_class(rows).agg(F.sum("t").cast("double").alias("s"), F.sum("tp").cast("double").alias("c"), F.sum(F.col("t") * F.col("p")).cast("double").alias("tp"), F.sum(F.col("p") * F.col("p")).cast("double").alias("pp"), F.sum(F.col("t") * F.col("t")).cast("double").alias("tt"), F.avg(2.0 * F.col("tp") / (F.col("t") + F.col("p"))).alias("macro_f1"))
    square = F.col("s") * F.col("s")
    below = F.sqrt(square - F.col("pp")) * F.sqrt(square - F.col("tt"))
    mcc = F.when(below == 0, F.lit(0.0)).otherwise((F.col("c") * F.col("s") - F.col("tp")) / below)
    return s.select((F.col("c") / F.col("s")).alias("accuracy"), "macro_f1", mcc.alias("mcc"))


def auroc(rows: DataFrame, *by: str) -> DataFrame:
    """auroc, from (positive, score), for each value of the columns by: how often a positive row stands above a negative one, ties half.

    Without by it is one row.  Rows are counted by score first, so the running
    sum is over distinct scores; it runs by range of scores, with one offset for
    each range.
    """
    at = rows.groupBy(*by, "score").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.sum(1 - F.col("positive").cast("long")).alias("q"))
    at = at.repartitionByRange(*by, "score").withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part", *by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("below", F.coalesce(F.sum("q").over(inside), F.lit(0)))
    parts = at.groupBy(*by, "part").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum(F.col("p") * (F.col("below") + F.col("q") / 2.0)).alias("won"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    parts = parts.withColumn("offset", F.coalesce(F.sum("q").over(before), F.lit(0)))
    whole = parts.groupBy(*by).agg(F.sum(F.col("won") + F.col("p") * F.col("offset")).alias("won"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return whole.select(*by, F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("won") / (F.col("p").cast("double") * F.col("q"))).otherwise(F.lit(float("nan"))).alias("auroc"))


def auroc_ovr(rows: DataFrame, classes: list[int]) -> DataFrame:
    """Mean of auroc over classes, each against the rest, from (label, probability array), in one pass; NaN if one is missing."""
    sides = [F.struct(F.lit(place).alias("kind"), (F.col("label") == kind).alias("positive"), F.col("probability")[place].alias("score")) for place, kind in enumerate(classes)]
    areas = auroc(rows.select(F.explode(F.array(*sides)).alias("s")).select("s.*"), "kind")
    return areas.agg(F.coalesce(F.avg("auroc"), F.lit(float("nan"))).alias("auroc"))


def best_candidate(rows: DataFrame) -> DataFrame:
    """One row, candidate and its mean score over folds, from (candidate, fold, score): the highest mean, of equal ones the least candidate; NaN comes last."""
    means = rows.groupBy("candidate").agg(F.avg("score").alias("mean_score"))
    return means.orderBy(F.isnan("mean_score"), F.desc_nulls_last("mean_score"), "candidate").limit(1)


def label_codes(*tables: DataFrame, label_col: str = "label_raw") -> DataFrame:
    """(label_raw, label): the rank of each label over all tables, from 0; numbers in order if every label is one."""
    every = tables[0].select(F.col(label_col).cast("string").alias("label_raw"))
    for t in tables[1:]:
        every = every.unionByName(t.select(F.col(label_col).cast("string").alias("label_raw")))
    every = every.where("label_raw is not null").distinct()
    number = F.expr("try_cast(label_raw as double)")
    numeric = F.min(number.isNotNull()).over(Window.partitionBy())
    order = Window.orderBy(F.when(F.col("numeric"), number), "label_raw")  # one row for each class
    return every.withColumn("numeric", numeric).select("label_raw", (F.dense_rank().over(order) - 1).alias("label"))


def stratified_folds(rows: DataFrame, folds: int = 4, *, id_col: str = "row_id") -> DataFrame:
    """rows with fold: each class cut into contiguous parts, the first ones larger."""
    rows_of = ranged(rows, "label", id_col)
    inside = Window.partitionBy("_part", "label").orderBy(id_col)
    sizes = rows_of.groupBy(F.col("_part").alias("_at"), F.col("label").alias("_label")).agg(F.count("*").alias("_n"))
    own = Window.partitionBy("_label")  # one row for each range of a class
    before = F.coalesce(F.sum("_n").over(own.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_at", "_label", before.alias("_before"), F.sum("_n").over(own).alias("_size"))
    placed = rows_of.withColumn("_nth", F.row_number().over(inside) - 1).join(F.broadcast(sizes), (F.col("_part") == F.col("_at")) & F.col("label").eqNullSafe(F.col("_label")))
    nth, least, larger = F.col("_before") + F.col("_nth"), F.floor(F.col("_size") / folds), F.col("_size") % folds
    cut = larger * (least + 1)
    fold = F.when(nth < cut, F.floor(nth / (least + 1))).otherwise(larger + F.floor((nth - cut) / F.greatest(least, F.lit(1))))
    return placed.select(*rows.columns, fold.cast("int").alias("fold"))
