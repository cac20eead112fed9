"""Extras that help choose a split threshold; described in notes only, with no code to match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def premature_leaves(leaves: DataFrame, max_depth: int) -> DataFrame:
    """Share of non-empty leaves above the deepest level."""
    return leaves.agg(F.avg((F.col("depth") < max_depth).cast("double")).alias("premature"))


def _by_class(features: DataFrame, labels: DataFrame, *sums: Column) -> DataFrame:
    """(label, idx, rows, total, classes) and sums over the slots there are; rows is a class's size, total that of all, and classes their number."""
    every = Window.partitionBy()  # one row for each class
    sizes = labels.where("label is not null").groupBy("label").agg(F.count("*").alias("rows"))
    sizes = sizes.withColumn("total", F.sum("rows").over(every)).withColumn("classes", F.count("*").over(every))
    return features.join(labels, "id").groupBy("label", "idx").agg(*sums).join(sizes, "label")


def class_means(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, idx, mean, variance) with absent slots as zeros, which class sizes account for."""
    sums = _by_class(features, labels, F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    mean = F.col("s") / F.col("rows")
    return sums.select("label", "idx", mean.alias("mean"), (F.col("ss") / F.col("rows") - mean * mean).alias("variance"), "rows", "total", "classes")


def fisher_scores(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(idx, fisher): variance between classes over variance inside them; null where either cannot be told."""
    n, m = F.col("rows"), F.col("mean")
    sums = class_means(features, labels).groupBy("idx").agg(F.sum(n * m).alias("s"), F.sum(n * m * m).alias("ss"), F.sum(n * F.col("variance")).alias("inside"), F.first("total").alias("total"), F.first("classes").alias("classes"))
    between = (F.col("ss") - F.col("s") * F.col("s") / F.col("total")) / (F.col("classes") - 1)
    known = (F.col("classes") > 1) & (F.col("total") > F.col("classes")) & (F.col("inside") > 0)
    return sums.select("idx", F.when(known, between / (F.col("inside") / (F.col("total") - F.col("classes")))).alias("fisher"))


def differing_slots(features: DataFrame, labels: DataFrame, tolerance: float) -> DataFrame:
    """One row, slots: how many slots have class means further apart than the tolerance; a class without the slot has mean 0."""
    slots = class_means(features, labels).groupBy("idx").agg(F.max("mean").alias("high"), F.min("mean").alias("low"), (F.count("*") < F.first("classes")).alias("lacks"))
    zero = F.lit(0.0)
    high, low = (F.when(F.col("lacks"), f(F.col(c), zero)).otherwise(F.col(c)) for f, c in ((F.greatest, "high"), (F.least, "low")))
    return slots.agg(F.count_if(high - low > tolerance).alias("slots"))


def mutual_information(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(idx, information), in nats, between the label and whether a slot is above its mean over all rows; an absent slot is 0."""
    means = _by_class(features, labels, F.sum("value").alias("s")).groupBy("idx").agg((F.sum("s") / F.first("total")).alias("middle"))
    above = _by_class(features.join(means, "idx"), labels, F.count_if(F.col("value") > F.col("middle")).alias("above"))
    f = lambda x: F.when(x > 0, x * F.log(x.cast("double"))).otherwise(F.lit(0.0))
    a, n = F.col("above"), F.col("rows")
    sums = above.groupBy("idx").agg(F.sum(f(a) + f(n - a) - f(n)).alias("own"), F.sum(a).alias("a"), F.first("total").alias("n"))
    own = (F.col("own") - f(F.col("a")) - f(F.col("n") - F.col("a")) + f(F.col("n"))) / F.col("n")
    return sums.select("idx", F.greatest(own, F.lit(0.0)).alias("information"))


def stability(results: DataFrame) -> DataFrame:
    """(method, k) with the number of tasks and the mean and sample variance of mcc and auroc over them; a NaN area is left out."""
    area = F.when(~F.isnan("auroc"), F.col("auroc"))
    return results.groupBy("method", "k").agg(F.countDistinct("task").alias("tasks"), F.avg("mcc").alias("mcc_mean"), F.var_samp("mcc").alias("mcc_variance"), F.avg(area).alias("auroc_mean"), F.var_samp(area).alias("auroc_variance"))


def depth_by_length(leaves: DataFrame, lengths: DataFrame) -> DataFrame:
    """Correlation of a sequence's mean leaf depth with its length."""
    depth = leaves.groupBy("id").agg(F.avg("depth").alias("depth"))
    return depth.join(lengths.select("id", "n"), "id").agg(F.corr("depth", "n").alias("correlation"))


#: Cells of the histogram that summarises a slot's values from 0 to 1, and the bins that are made of them.
CELLS, BINS = 4096, 10


def binned_information(features: DataFrame, labels: DataFrame, bins: int = BINS) -> DataFrame:
    """(idx, information), in nats, between the label and a slot's value in bins of about as many rows; an absent slot is 0.

    A slot is summarised by a histogram of a fixed number of cells for each
    label, which is made in one pass and adds up.  A cell belongs to the bin that
    the rows below it reach; its rows are not parted, so many zeros are one bin.
    """
    every = Window.partitionBy()  # one row for each class
    sizes = labels.where("label is not null").groupBy("label").agg(F.count("*").alias("rows")).withColumn("total", F.sum("rows").over(every))
    cell = F.least(F.floor(F.col("value") * CELLS), F.lit(CELLS - 1)).cast("int")
    held = features.join(labels.where("label is not null"), "id").groupBy("idx", "label", cell.alias("cell")).agg(F.count("*").alias("c"))
    # a class without a row in a slot has all its rows there as zeros
    slots = held.select("idx").distinct().join(F.broadcast(sizes), F.lit(True))
    seen = held.groupBy("idx", "label").agg(F.sum("c").alias("seen"))
    zeros = slots.join(seen, ["idx", "label"], "left").select("idx", "label", F.lit(0).alias("cell"), (F.col("rows") - F.coalesce("seen", F.lit(0))).alias("c"))
    cells = held.unionByName(zeros).groupBy("idx", "label", "cell").agg(F.sum("c").alias("c"))
    below = Window.partitionBy("idx").orderBy("cell").rangeBetween(Window.unboundedPreceding, -1)  # the cells of a slot, whose number is fixed
    cells = cells.withColumn("below", F.coalesce(F.sum("c").over(below), F.lit(0))).join(F.broadcast(sizes), "label")
    cells = cells.withColumn("bin", F.expr(f"least({bins} * below div total, {bins - 1})"))
    table = cells.groupBy("idx", "label", "bin").agg(F.sum("c").alias("c"), F.first("rows").alias("x"), F.first("total").alias("n"))
    table = table.withColumn("y", F.sum("c").over(Window.partitionBy("idx", "bin"))).where("c > 0")
    part = F.col("c") / F.col("n") * F.log(F.col("c").cast("double") * F.col("n") / (F.col("x").cast("double") * F.col("y")))
    return table.groupBy("idx").agg(F.greatest(F.sum(part), F.lit(0.0)).alias("information"))


def class_grid(features: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(label, row, col, mean) for every cell of the chaos game's grid of side 2^k: the heat map of each class; an absent slot is 0."""
    means = class_means(features, labels).select("label", "idx", "mean")
    cells = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4**k - 1).cast("long"))).alias("idx")
    every = labels.where("label is not null").select("label").distinct().select("label", cells)
    side = 2**k
    return every.join(means, ["label", "idx"], "left").select("label", F.expr(f"idx div {side}").alias("row"), (F.col("idx") % side).alias("col"), F.coalesce("mean", F.lit(0.0)).alias("mean"))
