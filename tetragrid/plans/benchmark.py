"""Random-forest benchmark over task, k and method, and its command line."""

from __future__ import annotations

import argparse
import itertools

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.bases import carry_pattern, clean, require_power_of_two
from ..operators import forest
from ..operators.fcgr import fcgr_counts, kmer_features, pooled, sparse_arrays
from ..operators.forest import candidates
from ..operators.metrics import auroc, auroc_ovr, scores, stratified_folds
from ..operators.quadtree import combined_features, qt_leaves, qt_slots
from ..sources.labelled import discover_tasks, load_task, save_result

METHODS = ("kmer", "adaptive", "kmer_qt")
#: The full grid; a depth of None is no bound.
FULL_GRID = {"n_estimators": (1000, 500, 200), "max_features": ("sqrt", "log2"), "max_depth": (20, None), "min_samples_split": (2, 5)}
SMALL_GRID = {"n_estimators": (200,), "max_features": ("sqrt", "log2"), "max_depth": (None,), "min_samples_split": (2,)}
SEED, FOLDS, DEEPEST = 42, 4, 30
#: Forests of Spark's own that are fitted side by side; each is a job over all partitions.
FITS_AT_ONCE = 4


def vector_rows(rows: DataFrame, size: int) -> DataFrame:
    """rows with a sparse vector column in place of indices and values: in Arrow batches, at the border of Spark's models only."""
    build = F.udf(lambda i, v: Vectors.sparse(size, i, v), VectorUDT(), useArrow=True)
    return rows.withColumn("features", build("indices", "values")).drop("indices", "values")


def _distributed(train: DataFrame, test: DataFrame, size: int, grid: dict, binary: bool) -> tuple[dict, DataFrame]:
    """The best candidate and the test rows' (label, prediction, probability), with Spark's own forest, level by level over all partitions.

    It has no least size of a split node and 32 cuts for each feature: a least
    size of 2 is its default, 5 is taken as two rows in each child, and a depth
    of None is 30.
    """
    train, test = (vector_rows(rows.drop("seq_id"), size) for rows in (train, test))
    trees = RandomForestClassifier(labelCol="label", featuresCol="features", seed=SEED)
    params = {"n_estimators": trees.numTrees, "max_features": trees.featureSubsetStrategy, "max_depth": trees.maxDepth, "min_samples_split": trees.minInstancesPerNode}
    to = {"max_depth": lambda v: DEEPEST if v is None else v, "min_samples_split": lambda v: 1 if v == 2 else 2}
    plain, maps = candidates(grid), []
    for chosen in plain:
        one = ParamGridBuilder()
        for n, v in chosen.items():
            one.addGrid(params[n], [to.get(n, lambda x: x)(v)])
        maps += one.build()
    judge = BinaryClassificationEvaluator(labelCol="label", numBins=0) if binary else MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    found = CrossValidator(estimator=trees, estimatorParamMaps=maps, evaluator=judge, numFolds=train.agg(F.max("fold")).first()[0] + 1, foldCol="fold", seed=SEED, parallelism=FITS_AT_ONCE).fit(train)
    best = max(range(len(maps)), key=lambda i: (found.avgMetrics[i], -i))
    seen = found.bestModel.transform(test).select(F.col("label").cast("long").alias("label"), F.col("prediction").cast("long").alias("prediction"), vector_to_array("probability").alias("probability"))
    return plain[best], seen


def train_and_evaluate(train: DataFrame, test: DataFrame, size: int, grid: dict = FULL_GRID, *, id_col: str = "seq_id", folds: int = FOLDS) -> dict:
    """Grid search with stratified folds, a refit, and the metrics of the test rows, from (id, label, indices, values).

    A table that fits is broadcast, and its forests are grown tree by tree in
    tasks, the whole grid from its largest forest; a larger one is left to
    Spark's own forest.
    """
    columns = [F.col(id_col).alias("seq_id"), F.col("label").cast("int").alias("label"), "indices", "values"]
    train = stratified_folds(train.select(columns), folds, id_col="seq_id")
    rows = train.unionByName(test.select(columns).withColumn("fold", F.lit(-1))).persist()
    sizes = rows.agg(F.count_if(F.col("fold") >= 0).alias("train"), F.count_if(F.col("fold") < 0).alias("test"), F.sum(F.size("indices")).alias("entries")).first()
    classes = [int(r.label) for r in rows.where("fold >= 0").select("label").distinct().orderBy("label").collect()]
    spark = rows.sparkSession
    if forest.fits(sizes.train + sizes.test, size, sizes.entries or 0):
        table, extra = forest.fetched(rows, size, "fold")
        best, seen = forest.searched(spark, table, extra["fold"], extra["fold"] < 0, grid, SEED)
    else:
        best, seen = _distributed(rows.where("fold >= 0"), rows.where("fold < 0"), size, grid, len(classes) == 2)
    seen = seen.persist()
    row = scores(seen).first()
    if len(classes) == 2:
        area = auroc(seen.select((F.col("label") == classes[1]).alias("positive"), F.col("probability")[classes[1]].alias("score"))).first().auroc
    elif len(classes) > 2:
        area = auroc_ovr(seen, classes).first().auroc
    else:
        area = float("nan")
    out = {"mcc": row.mcc, "auroc": area, "f1_macro": row.macro_f1, "accuracy": row.accuracy, "n_classes": len(classes), "train_size": sizes.train, "test_size": sizes.test, "best_params": str({k: best[k] for k in sorted(best)})}
    rows.unpersist()
    seen.unpersist()
    return out


def run_task(spark: SparkSession, rows: DataFrame, name: str, *, ks=(4, 5, 6, 7, 8), methods=METHODS, grid_size: int = 128, depth: int = 6, threshold: float = 0.05, grid: dict = FULL_GRID, output: str | None = None) -> list[dict]:
    """One result for each k that fits the grid and each method; the counts are made once, at the deepest level.

    What is printed about the sequences is observed in the scan that counts them.
    """
    require_power_of_two(grid_size, 0)
    if set(methods) - {"kmer"}:
        require_power_of_two(grid_size, depth)
    rows = rows.persist()
    scan, bases = Observation(), clean(F.col("seq"))
    fit = [k for k in ks if 2**k <= grid_size]
    for k in sorted(set(ks) - set(fit)):
        print(f"  SKIP k={k}: grid {grid_size} < {2**k}")
    deepest = max([*fit, depth, 1])
    observed = rows.observe(scan, F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"), F.sum(F.length("seq") - F.length(bases)).alias("dropped"), F.count_if(bases.rlike(carry_pattern(deepest))).alias("guarded"))
    counts = fcgr_counts(observed, deepest, id_col="seq_id", seq_col="seq").persist()
    counts.write.format("noop").mode("overwrite").save()
    seen = scan.get
    print(f"{name}: {seen['train']} train, {seen['test']} test")
    print(f"  {seen['dropped'] or 0} characters are no bases, {seen['guarded']} sequences have a run that can carry")
    results, adaptive = [], None
    for k, method in itertools.product(fit, methods):
        if method == "kmer":
            size, features, label = 4**k, kmer_features(pooled(counts, k), k), str(k)
        elif method == "adaptive":
            size, features, label = 4**depth, qt_slots(qt_leaves(pooled(counts, depth), depth, threshold), depth), f"d{depth}_p{threshold}"
        else:
            size, features, label = 4**k + 4**depth, combined_features(counts, k, depth, threshold), str(k)
        if method == "adaptive" and adaptive:
            seen = adaptive  # it does not depend on k
        else:
            table = sparse_arrays(rows, features)
            seen = train_and_evaluate(table.where("split = 'train'"), table.where("split = 'test'"), size, grid)
            adaptive = seen if method == "adaptive" else adaptive
        result = {"task": name, "method": method, "k": label, "grid_size": grid_size, "feature_dim": size} | seen
        print(f"  {method} k={label}: mcc {seen['mcc']:.4f} auroc {seen['auroc']:.4f} f1 {seen['f1_macro']:.4f} accuracy {seen['accuracy']:.4f}")
        if output:
            save_result(spark, output, result)
        results.append(result)
    counts.unpersist()
    rows.unpersist()
    return results


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="chaos-game features and random forests on labelled sequences")
    p.add_argument("--method", choices=[*METHODS, "all"], default="all")
    p.add_argument("--k-values", type=int, nargs="+", default=[4, 5, 6, 7, 8])
    p.add_argument("--grid-size", type=int, default=128)
    p.add_argument("--qt-max-depth", type=int, default=6)
    p.add_argument("--qt-split-threshold", type=float, default=0.05)
    p.add_argument("--n-workers", type=int, help="accepted; executors set the parallelism")
    p.add_argument("--n-jobs", type=int, default=-1, help="accepted; executors set the parallelism")
    p.add_argument("--output", default="benchmark_results.csv")
    p.add_argument("--tasks", nargs="+")
    p.add_argument("--data-root", default="data")
    p.add_argument("--list-tasks", action="store_true")
    p.add_argument("--full-grid", action="store_true", help="accepted; it is the default")
    p.add_argument("--small-grid", action="store_true", help="2 of the 24 candidates, 200 trees each")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    tasks = discover_tasks(spark, a.data_root).collect()
    if not tasks:
        print(f"no tasks below {a.data_root}")
        return
    if a.list_tasks:
        print(*(t.name for t in tasks), sep="\n")
        return
    chosen = [t for t in tasks if not a.tasks or t.name in a.tasks]
    if not chosen:
        print("none of the named tasks exists")
        return
    methods = METHODS if a.method == "all" else (a.method,)
    for t in chosen:
        rows = load_task(spark, t.train_path, t.test_path, t.name)
        run_task(spark, rows, t.name, ks=a.k_values, methods=methods, grid_size=a.grid_size, depth=a.qt_max_depth, threshold=a.qt_split_threshold, grid=SMALL_GRID if a.small_grid else FULL_GRID, output=a.output)


if __name__ == "__main__":
    main()
