"""The registered queries of the chaos-game operators and the same results as DuckDB SQL."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql
from ..functions.bases import clean, critical_value
from ..operators import diagnostics, fcgr, metrics, point, principal, quadtree
from ..session import shared_dir
from ..sources.labelled import discover_tasks, read_task
from ..streaming.chunks import chunk_counts, chunked_final_point, points, state_store, stream_cells, stream_final_point

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _id(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("id", "doc_id")


def _counts(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return fcgr.fcgr_counts(_read(spark, sf_dir, "documents"), k)


def clean_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = clean(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.length(b).cast("long").alias("n"))


def _fcgr(k: int) -> Query:
    return lambda s, d: _id(_counts(s, d, k).drop("n"))


def _kmer(k: int, normalize: bool) -> Query:
    return lambda s, d: _id(fcgr.kmer_features(_counts(s, d, k), k, normalize=normalize))


def kmer_pool_6_to_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(fcgr.kmer_features(fcgr.fcgr_counts(_read(spark, sf_dir, "documents"), 6, at=4), 4))


def _qt(depth: int, threshold: float, min_count: int = quadtree.MIN_COUNT, normalize: bool = True) -> Query:
    return lambda s, d: _id(quadtree.sequence_leaves(_read(s, d, "documents"), depth, threshold, min_count, normalize=normalize))


def qt_dense_d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    slots = quadtree.qt_slots(quadtree.sequence_leaves(docs, 3), 3)
    wide = quadtree.dense(docs, slots, 64)
    return wide.select(F.col("id").alias("doc_id"), F.posexplode("value").alias("idx", "value")).withColumn("idx", F.col("idx").cast("long"))


def combined_k3_d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(quadtree.sequence_features(_read(spark, sf_dir, "documents"), 3, 3))


def final_point_bits_p64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(point.final_point(_read(spark, sf_dir, "documents"), 64))


def final_point_stats_p64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(point.point_stats(point.final_point(_read(spark, sf_dir, "documents"), 64)))


def precision_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(point.precision_levels(_read(spark, sf_dir, "documents")))


def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.label_codes(_read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("label_raw")), _read(spark, sf_dir, "part").select(F.col("p_brand").alias("label_raw"))).withColumn("label", F.col("label").cast("long"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "labels").select(F.col("quality").cast("long").alias("label"), F.col("toxic").cast("long").alias("prediction"))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_verdicts(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.scores(_verdicts(spark, sf_dir))


def auroc_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.auroc(rows.select((F.col("quality") == 1).alias("positive"), F.col("n_chars").cast("double").alias("score")))


def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return metrics.stratified_folds(rows, id_col="doc_id").select("doc_id", "label", F.col("fold").cast("long").alias("fold"))


def chunked_fcgr_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_counts(_read(spark, sf_dir, "conversations"), 3).select(F.col("id").alias("conv_id"), "z", "cnt")


def diag_premature_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.premature_leaves(quadtree.sequence_leaves(_read(spark, sf_dir, "documents"), 4), 4)


def auroc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    score = lambda i: (F.col("n_chars") * (2 * i + 3) % 101).cast("double")
    label = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).otherwise(2)
    area = metrics.auroc_ovr(docs.select(label.alias("label"), F.array(*map(score, range(3))).alias("probability")), [0, 1, 2])
    return area.select(F.round("auroc", 12).alias("auroc"))  # a mean of sums whose order is free


#: Candidates of `best_candidate`: a text of more characters is taken as good.
LENGTHS = (100, 200, 400, 800, 1600)


def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).join(_read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = metrics.stratified_folds(rows, id_col="doc_id")
    right = lambda i, n: F.struct(F.lit(i).cast("long").alias("candidate"), (F.col("label") == (F.col("n_chars") > n).cast("int")).cast("double").alias("right"))
    rows = rows.select("fold", F.explode(F.array(*(right(i, n) for i, n in enumerate(LENGTHS)))).alias("c"))
    best = metrics.best_candidate(rows.groupBy("c.candidate", "fold").agg(F.round(F.avg("c.right"), 9).alias("score")))
    return best.withColumn("mean_score", F.round("mean_score", 9))


def rf_kmer_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full grid of random forests on frequencies of three bases of the labelled documents; a fifth of them, by hash, is the test set."""
    from .benchmark import train_and_evaluate

    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq_id"), F.col("quality").alias("label"), F.when(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0, "test").otherwise("train").alias("split"))
    seqs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), "text").join(labels.select("seq_id"), "seq_id", "left_semi")
    table = fcgr.sparse_arrays(labels, fcgr.kmer_features(fcgr.fcgr_counts(seqs, 3, id_col="seq_id"), 3))
    found = train_and_evaluate(table.where("split = 'train'"), table.where("split = 'test'"), 64)
    return spark.createDataFrame([found], "mcc double, auroc double, f1_macro double, accuracy double, n_classes long, train_size long, test_size long, best_params string")


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return fcgr.kmer_features(_counts(spark, sf_dir, 2), 2), labels


def diag_class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = lambda c: F.round(c, 9).alias(c)
    return diagnostics.class_means(*_labelled(spark, sf_dir)).select("label", "idx", rounded("mean"), rounded("variance"))


def diag_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.fisher_scores(*_labelled(spark, sf_dir)).withColumn("fisher", F.round("fisher", 6))


def diag_differing_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.differing_slots(*_labelled(spark, sf_dir), 0.002)


def diag_mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.mutual_information(*_labelled(spark, sf_dir)).withColumn("information", F.round("information", 9))


def diag_binned_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.binned_information(*_labelled(spark, sf_dir)).withColumn("information", F.round("information", 9))


def diag_class_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.class_grid(*_labelled(spark, sf_dir), 2).withColumn("mean", F.round("mean", 9))


def diag_principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first component of the frequencies of two bases, over all documents."""
    docs = _read(spark, sf_dir, "documents").select("doc_id")
    arrays = fcgr.sparse_arrays(docs, fcgr.kmer_features(_counts(spark, sf_dir, 2), 2), id_col="doc_id")
    found = principal.principal_components(arrays, 16).where("component = 0")
    return found.select("idx", F.round("loading", 6).alias("loading"), F.round("variance", 9).alias("variance"), F.round("share", 6).alias("share"))


def diag_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability over tasks of a table of results: each language is a task, and texts over k characters are taken as good."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("task"), "n_chars")
    rows = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("label")).join(docs, "doc_id")
    tasks = sorted(r.task for r in docs.select("task").distinct().collect())
    found = [metrics.scores(rows.where(F.col("task") == t).withColumn("prediction", (F.col("n_chars") > k).cast("long"))).select(F.lit(t).alias("task"), F.lit("length").alias("method"), F.lit(str(k)).alias("k"), "mcc") for t in tasks for k in LENGTHS[-2:]]
    areas = metrics.auroc(rows.select("task", (F.col("label") == 1).alias("positive"), F.col("n_chars").cast("double").alias("score")), "task")
    results = functools.reduce(DataFrame.unionByName, found).join(areas, "task")
    out = diagnostics.stability(results)
    return out.select("method", "k", "tasks", *(F.round(c, 9).alias(c) for c in out.columns[3:]))


def diag_depth_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = quadtree.sequence_leaves(_read(spark, sf_dir, "documents"), 4)
    lengths = clean_stats(spark, sf_dir).withColumnRenamed("doc_id", "id")
    return diagnostics.depth_by_length(leaves, lengths).withColumn("correlation", F.round("correlation", 9))


def extract_kmer_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(fcgr.extract_kmer_features(_read(spark, sf_dir, "documents"), 3, id_col="doc_id", seq_col="text"))


def extract_adaptive_d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(quadtree.extract_adaptive_features(_read(spark, sf_dir, "documents"), max_depth=3, id_col="doc_id", seq_col="text"))


def extract_combined_k2_d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(quadtree.extract_combined_features(_read(spark, sf_dir, "documents"), 2, qt_max_depth=3, id_col="doc_id", seq_col="text"))


def kmer_sparse_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrays, one row for each entry; a document without bases has one row, at -1."""
    docs = _read(spark, sf_dir, "documents").select("doc_id")
    arrays = fcgr.sparse_arrays(docs, fcgr.kmer_features(_counts(spark, sf_dir, 2), 2), id_col="doc_id")
    entries = arrays.select("doc_id", F.explode_outer(F.arrays_zip("indices", "values")).alias("e"))
    return entries.select("doc_id", F.coalesce("e.indices", F.lit(-1)).alias("idx"), F.coalesce("e.values", F.lit(0.0)).alias("value"))


def feature_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the features of each k are, and how many slots the documents fill of them."""
    counts = _counts(spark, sf_dir, 4)
    info = spark.createDataFrame([fcgr.feature_info(k) for k in range(1, 5)], "type string, k long, dimensions long")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.substring("z", 1, k).alias("z")) for k in range(1, 5))))
    used = counts.select(each.alias("c")).groupBy("c.k").agg(F.count_distinct("c.z").alias("used"))
    return info.join(used, "k", "left").select("type", "k", "dimensions", F.coalesce("used", F.lit(0)).alias("used"))


def point_floats_p64(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = point.bits_to_float("x_bits"), point.bits_to_float("y_bits")
    return final_point_bits_p64(spark, sf_dir).select("doc_id", x.alias("x"), y.alias("y"))


def point_fractions_p60(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _id(point.final_point(_read(spark, sf_dir, "documents"), 60))
    rows = rows.select("doc_id", point.bits_to_fraction("x_bits").alias("x"), point.bits_to_fraction("y_bits").alias("y"))
    return rows.select("doc_id", *(F.col(f"{c}.{part}").alias(f"{c}_{part}") for c in "xy" for part in ("numerator", "denominator")))


def point_from_float_p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.pmod("doc_id", F.lit(1000)) / 1000.0
    return _read(spark, sf_dir, "documents").select("doc_id", point.float_to_bits(20)(value).alias("bits"))


def point_update_p64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each end point after one more step, to the vertex (1, 0)."""
    x, y = point.updated(F.col("x_bits"), F.lit(1)), point.updated(F.col("y_bits"), F.lit(0))
    return final_point_bits_p64(spark, sf_dir).select("doc_id", x.alias("x_bits"), y.alias("y_bits"))


def point_shown_p64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return point.shown(final_point_bits_p64(spark, sf_dir)).select("doc_id", "point")


def csv_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents written as a task of CSV parts, then discovered and read through the data source."""
    root = f"{shared_dir(spark)}/tasks-{uuid.uuid4().hex}"
    rows = _read(spark, sf_dir, "documents").select("doc_id", clean(F.col("text")).alias("sequence")).join(_read(spark, sf_dir, "labels"), "doc_id")
    for split, test in (("train", False), ("test", True)):
        side = rows.where((F.pmod("doc_id", F.lit(5)) == 0) == F.lit(test))
        side.select("sequence", (F.col("quality") * 8 + 2).alias("kind"), "doc_id").write.csv(f"{root}/labelled/{split}.csv", header=True)
    task = discover_tasks(spark, root).first()
    return read_task(spark, root, task.name).select("task", "split", "seq", F.col("label").cast("long").alias("label"))


#: Triggers that the streamed conversations are spread over; which chunk comes in which is decided by a hash.
TRIGGERS = 5


def _streamed(spark: SparkSession, sf_dir: str, operator: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What the operator gives for the conversations, whose chunks come out of order over several triggers; each trigger is written once, under its number."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    chunks = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    dealt = chunks.withColumn("_trigger", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(TRIGGERS)))
    for n in range(TRIGGERS):
        dealt.where(F.col("_trigger") == n).drop("_trigger").coalesce(1).write.parquet(f"{base}/in/{n}")
    out = operator(spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*"))
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/trigger={n}")
    with state_store(spark):
        query = out.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def stream_fcgr_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = _streamed(spark, sf_dir, lambda chunks: stream_cells(chunks, 3), "append")
    return added.groupBy(F.col("id").alias("conv_id"), "z").agg(F.sum("cnt").alias("cnt"))


def stream_point_p64(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _streamed(spark, sf_dir, lambda chunks: stream_final_point(chunks, 64), "update")
    last = seen.groupBy("id").agg(F.max_by("tail", "iterations").alias("tail"), F.max("iterations").alias("iterations"))
    return points(last, 64).withColumnRenamed("id", "conv_id")


def chunked_point_p64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_final_point(_read(spark, sf_dir, "conversations"), 64).withColumnRenamed("id", "conv_id")


def sql_kmer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In SQL: the cells of each document by the table function, and whether its four bases are far from even."""
    sql.register(spark)
    text = """
        WITH even AS (
          SELECT d.doc_id, chi_square_p(4.0D * sum(w.cnt * w.cnt) / sum(w.cnt) - sum(w.cnt)) < 0.05 AS uneven
          FROM {docs} d, LATERAL kmer_windows(d.text, 1) w GROUP BY d.doc_id)
        SELECT c.doc_id, c.z, c.cnt, even.uneven
        FROM (SELECT d.doc_id, w.z, sum(w.cnt) AS cnt FROM {docs} d, LATERAL kmer_windows(d.text, 3) w GROUP BY d.doc_id, w.z) c JOIN even ON c.doc_id = even.doc_id"""
    return spark.sql(text, docs=_read(spark, sf_dir, "documents"))


def sql_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In SQL: each document's end point as bits, numbers and fractions, and the bits of a number."""
    sql.register(spark)
    text = """
        WITH p AS (SELECT doc_id, cgr_bits(text, 60, 'x') AS x_bits, cgr_bits(text, 60, 'y') AS y_bits FROM {docs})
        SELECT doc_id, x_bits, y_bits, cgr_to_float(x_bits) AS x, cgr_to_float(y_bits) AS y, cgr_to_fraction(x_bits).numerator AS x_numerator, cgr_from_float(pmod(doc_id, 1000) / 1000.0D, 20) AS bits
        FROM p"""
    return spark.sql(text, docs=_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "clean_stats": clean_stats, "fcgr_counts_k1": _fcgr(1), "fcgr_counts_k3": _fcgr(3), "fcgr_counts_k4": _fcgr(4), "fcgr_counts_k6": _fcgr(6),
    "kmer_freq_k3": _kmer(3, True), "kmer_raw_k3": _kmer(3, False), "kmer_pool_6_to_4": kmer_pool_6_to_4,
    "qt_leaves_d4_p05": _qt(4, 0.05), "qt_leaves_d3_p01": _qt(3, 0.01), "qt_d3_thr0": _qt(3, 0.0), "qt_d3_thr1_min0": _qt(3, 1.0, 0, False), "qt_dense_d3": qt_dense_d3,
    "combined_k3_d3": combined_k3_d3, "final_point_bits_p64": final_point_bits_p64, "final_point_stats_p64": final_point_stats_p64, "precision_levels": precision_levels,
    "label_encode": label_encode, "confusion": confusion, "scores": scores, "auroc_binary": auroc_binary, "stratified_folds": stratified_folds,
    "chunked_fcgr_k3": chunked_fcgr_k3, "diag_premature_leaves": diag_premature_leaves,
    "auroc_ovr": auroc_ovr, "best_candidate": best_candidate, "rf_kmer_eval": rf_kmer_eval,
    "diag_class_means": diag_class_means, "diag_fisher": diag_fisher, "diag_differing_slots": diag_differing_slots,
    "diag_mutual_information": diag_mutual_information, "diag_depth_by_length": diag_depth_by_length,
    "diag_binned_information": diag_binned_information, "diag_class_grid": diag_class_grid, "diag_principal_components": diag_principal_components, "diag_stability": diag_stability,
    "extract_kmer_k3": extract_kmer_k3, "extract_adaptive_d3": extract_adaptive_d3, "extract_combined_k2_d3": extract_combined_k2_d3, "kmer_sparse_k2": kmer_sparse_k2, "feature_info": feature_info,
    "point_floats_p64": point_floats_p64, "point_fractions_p60": point_fractions_p60, "point_from_float_p20": point_from_float_p20, "point_update_p64": point_update_p64, "point_shown_p64": point_shown_p64,
    "chunked_point_p64": chunked_point_p64, "sql_kmer_windows": sql_kmer_windows, "sql_points": sql_points,
    "csv_task": csv_task, "stream_fcgr_k3": stream_fcgr_k3, "stream_point_p64": stream_point_p64,
}

_CLEAN = "coalesce(regexp_replace(upper({0}), '[^ACGT]', '', 'g'), '')"
_DOCS = f"c AS (SELECT doc_id, {_CLEAN.format('text')} AS b FROM documents)"


def _cells(k: int, source: str = _DOCS) -> str:
    """CTEs that end in cells (doc_id, n, z, cnt); long runs take a recursive float walk."""
    pad, run = "A" * (k - 2) + "G" if k > 1 else "", 53 - k
    side = 2**k
    digit = " || ".join(f"(2 * ((gx >> {j}) & 1) + ((gy >> {j}) & 1))::VARCHAR" for j in range(k - 1, -1, -1))
    return f"""WITH RECURSIVE {source},
    g AS (SELECT *, regexp_matches(b, '[CG]{{{run},}}|[GT]{{{run},}}') AS long_run FROM c),
    walk AS (
      SELECT doc_id, b, 0::BIGINT AS i, 0.5::DOUBLE AS x, 0.5::DOUBLE AS y FROM g WHERE long_run
      UNION ALL
      SELECT doc_id, b, i + 1, (x + (substr(b, i + 1, 1) IN ('C', 'G'))::INT::DOUBLE) / 2, (y + (substr(b, i + 1, 1) IN ('G', 'T'))::INT::DOUBLE) / 2
      FROM walk WHERE i < length(b)),
    walked AS (
      SELECT doc_id, length(b) AS n, least(floor(x * {side}), {side - 1})::BIGINT AS gx, least(floor(y * {side}), {side - 1})::BIGINT AS gy FROM walk WHERE i > 0),
    cells AS (
      SELECT doc_id, n::BIGINT AS n, z, count(*)::BIGINT AS cnt FROM (
        SELECT doc_id, length(b) AS n, translate(reverse(substr('{pad}' || b, i::BIGINT, {k})), 'ATCG', '0123') AS z
        FROM (SELECT doc_id, b, unnest(generate_series(1, length(b))) AS i FROM g WHERE NOT long_run)
        UNION ALL SELECT doc_id, n, {digit} AS z FROM walked)
      GROUP BY ALL)"""


def _index(k: int) -> str:
    x = " + ".join(f"(substr(z, {j + 1}, 1)::BIGINT // 2) * {2 ** (k - 1 - j)}" for j in range(k))
    y = " + ".join(f"(substr(z, {j + 1}, 1)::BIGINT % 2) * {2 ** (k - 1 - j)}" for j in range(k))
    return f"(({x}) * {2**k} + ({y}))::BIGINT"


def _qt_sql(depth: int, threshold: float, min_count: int = quadtree.MIN_COUNT, normalize: bool = True) -> str:
    """CTEs that end in leaves (doc_id, depth, node, value), level by level with joins."""
    crit = critical_value(threshold)
    test = "false" if crit == float("inf") else f"tot >= {min_count} AND 4 * squares::DOUBLE / tot - tot > {crit!r}::DOUBLE"
    return f"""{_cells(depth)},
    kids AS (SELECT doc_id, d, substr(z, 1, d) AS node, sum(cnt) AS c FROM cells, generate_series(0, {depth - 1}) t(d) GROUP BY doc_id, d, substr(z, 1, d), substr(z, 1, d + 1)),
    flags AS (SELECT doc_id, d, node, {test} AS split FROM (SELECT doc_id, d, node, sum(c) AS tot, sum(c * c) AS squares FROM kids GROUP BY ALL)),
    leaf AS (
      SELECT c.doc_id, n, z, any_value(cnt) AS cnt, coalesce(min(d) FILTER (WHERE NOT split), {depth}) AS depth
      FROM cells c JOIN flags f ON c.doc_id = f.doc_id AND starts_with(z, node) AND substr(z, 1, d) = node GROUP BY c.doc_id, n, z),
    leaves AS (
      SELECT doc_id, depth::INTEGER AS depth, substr(z, 1, depth) AS node, sum(cnt)::DOUBLE / pow(4.0, {depth} - depth){" / n" if normalize else ""} AS value
      FROM leaf GROUP BY doc_id, n, depth, substr(z, 1, depth))"""


def _slots(depth: int) -> str:
    first = " + ".join(f"CASE WHEN depth > {j} THEN substr(node, {j + 1}, 1)::BIGINT * {4 ** (depth - 1 - j)} ELSE 0 END" for j in range(depth))
    return f"(SELECT doc_id, unnest(generate_series({first}, {first} + pow(4, {depth} - depth)::BIGINT - 1))::BIGINT AS idx, value FROM leaves)"


def _bits(precision: int) -> str:
    last = f"reverse(right(repeat('A', {precision}) || 'G' || b, {precision}))"
    return f"translate({last}, 'ATCG', '0011') AS x_bits, translate({last}, 'ATCG', '0101') AS y_bits"


def oracle_sql() -> dict[str, str]:
    out = {f"fcgr_counts_k{k}": f"{_cells(k)} SELECT doc_id, z, cnt FROM cells" for k in (1, 3, 4, 6)}
    out["clean_stats"] = f"WITH {_DOCS} SELECT doc_id, length(b)::BIGINT AS n FROM c"
    out["kmer_freq_k3"] = f"{_cells(3)} SELECT doc_id, {_index(3)} AS idx, cnt::DOUBLE / n AS value FROM cells"
    out["kmer_raw_k3"] = f"{_cells(3)} SELECT doc_id, {_index(3)} AS idx, cnt::DOUBLE AS value FROM cells"
    out["kmer_pool_6_to_4"] = f"{_cells(4)} SELECT doc_id, {_index(4)} AS idx, cnt::DOUBLE / n AS value FROM cells"
    out["qt_leaves_d4_p05"] = f"{_qt_sql(4, 0.05)} SELECT * FROM leaves"
    out["qt_leaves_d3_p01"] = f"{_qt_sql(3, 0.01)} SELECT * FROM leaves"
    out["qt_d3_thr0"] = f"{_qt_sql(3, 0.0)} SELECT * FROM leaves"
    out["qt_d3_thr1_min0"] = f"{_qt_sql(3, 1.0, 0, False)} SELECT * FROM leaves"
    out["qt_dense_d3"] = f"{_qt_sql(3, 0.05)} SELECT c.doc_id, i::BIGINT AS idx, coalesce(value, 0.0) AS value FROM c CROSS JOIN generate_series(0, 63) t(i) LEFT JOIN {_slots(3)} s ON s.doc_id = c.doc_id AND s.idx = i"
    out["combined_k3_d3"] = f"{_qt_sql(3, 0.05)} SELECT doc_id, {_index(3)} AS idx, cnt::DOUBLE / n AS value FROM cells UNION ALL SELECT doc_id, idx + 64, value FROM {_slots(3)}"
    out["final_point_bits_p64"] = f"WITH {_DOCS} SELECT doc_id, 64::INTEGER AS precision_bits, {_bits(64)}, length(b)::BIGINT AS iterations FROM c"
    out["final_point_stats_p64"] = f"""WITH {_DOCS}, p AS (SELECT doc_id, length(b)::BIGINT AS iterations, 64::INTEGER AS precision_bits, {_bits(64)} FROM c),
      u AS (SELECT doc_id, iterations, precision_bits, length(ltrim(x_bits, '0'))::INTEGER AS x_used_bits, length(ltrim(y_bits, '0'))::INTEGER AS y_used_bits FROM p)
      SELECT *, (precision_bits - greatest(x_used_bits, y_used_bits))::INTEGER AS precision_remaining, true AS can_handle_more FROM u"""
    levels = " UNION ALL ".join(f"SELECT doc_id, {p}::INTEGER AS precision_bits, {_bits(p)} FROM c" for p in point.LEVELS)
    out["precision_levels"] = f"""WITH {_DOCS}, p AS ({levels}), r AS (SELECT doc_id, precision_bits, (precision_bits - greatest(length(ltrim(x_bits, '0')), length(ltrim(y_bits, '0'))))::INTEGER AS precision_remaining FROM p)
      SELECT *, CASE WHEN precision_remaining > 10 THEN 'OK' ELSE 'LOW' END AS status FROM r"""
    out["label_encode"] = "SELECT label_raw, (dense_rank() OVER (ORDER BY label_raw) - 1)::BIGINT AS label FROM (SELECT o_orderstatus AS label_raw FROM orders UNION SELECT p_brand FROM part)"
    verdicts = "v AS (SELECT quality::BIGINT AS label, toxic::BIGINT AS prediction FROM labels)"
    out["confusion"] = f"WITH {verdicts} SELECT label, prediction, count(*)::BIGINT AS cnt FROM v GROUP BY ALL"
    out["scores"] = f"""WITH {verdicts}, k AS (SELECT label AS class FROM v UNION SELECT prediction FROM v),
      b AS (SELECT class, (SELECT count(*) FROM v WHERE label = class) AS t, (SELECT count(*) FROM v WHERE prediction = class) AS p, (SELECT count(*) FROM v WHERE label = class AND prediction = class) AS tp FROM k),
      s AS (SELECT sum(t)::DOUBLE AS s, sum(tp)::DOUBLE AS c, sum(t * p)::DOUBLE AS x, sum(p * p)::DOUBLE AS pp, sum(t * t)::DOUBLE AS tt, avg(2 * tp::DOUBLE / (t + p)) AS macro_f1 FROM b)
      SELECT c / s AS accuracy, macro_f1, CASE WHEN sqrt(s * s - pp) * sqrt(s * s - tt) = 0 THEN 0.0 ELSE (c * s - x) / (sqrt(s * s - pp) * sqrt(s * s - tt)) END AS mcc FROM s"""
    out["auroc_binary"] = """WITH r AS (SELECT quality = 1 AS pos, n_chars AS score FROM labels JOIN documents USING (doc_id)),
      m AS (SELECT pos, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS midrank FROM r),
      a AS (SELECT sum(midrank) FILTER (WHERE pos)::DOUBLE AS s, count(*) FILTER (WHERE pos)::DOUBLE AS p, count(*) FILTER (WHERE NOT pos)::DOUBLE AS q FROM m)
      SELECT CASE WHEN p > 0 AND q > 0 THEN (s - p * (p + 1) / 2) / (p * q) ELSE 'NaN'::DOUBLE END AS auroc FROM a"""
    out["stratified_folds"] = "SELECT doc_id, quality AS label, (ntile(4) OVER (PARTITION BY quality ORDER BY doc_id) - 1)::BIGINT AS fold FROM labels"
    chunks = f"c AS (SELECT conv_id AS doc_id, string_agg({_CLEAN.format('text')}, '' ORDER BY turn) AS b FROM conversations GROUP BY conv_id)"
    out["chunked_fcgr_k3"] = f"{_cells(3, chunks)} SELECT doc_id AS conv_id, z, cnt FROM cells"
    out["diag_premature_leaves"] = f"{_qt_sql(4, 0.05)} SELECT avg((depth < 4)::INT::DOUBLE) AS premature FROM leaves"
    out["auroc_ovr"] = """WITH r AS (SELECT k, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 2 END = k AS pos, n_chars * (2 * k + 3) % 101 AS score FROM documents, generate_series(0, 2) t(k)),
      m AS (SELECT k, pos, rank() OVER (PARTITION BY k ORDER BY score) + (count(*) OVER (PARTITION BY k, score) - 1) / 2.0 AS midrank FROM r),
      a AS (SELECT k, sum(midrank) FILTER (WHERE pos)::DOUBLE AS s, count(*) FILTER (WHERE pos)::DOUBLE AS p, count(*) FILTER (WHERE NOT pos)::DOUBLE AS q FROM m GROUP BY k)
      SELECT round(avg(CASE WHEN p > 0 AND q > 0 THEN (s - p * (p + 1) / 2) / (p * q) ELSE 'NaN'::DOUBLE END), 12) AS auroc FROM a"""
    lengths = ", ".join(f"({i}::BIGINT, {n})" for i, n in enumerate(LENGTHS))
    out["best_candidate"] = f"""WITH f AS (SELECT doc_id, quality, ntile(4) OVER (PARTITION BY quality ORDER BY doc_id) AS fold FROM labels),
      s AS (SELECT candidate, fold, round(avg((quality = (n_chars > least_chars)::INT)::INT::DOUBLE), 9) AS score FROM f JOIN documents USING (doc_id), (VALUES {lengths}) c(candidate, least_chars) GROUP BY ALL)
      SELECT candidate, round(avg(score), 9) AS mean_score FROM s GROUP BY candidate ORDER BY avg(score) DESC, candidate LIMIT 1"""
    labelled = f"""{_cells(2)}, l AS (SELECT doc_id, quality AS label FROM labels), slot AS (SELECT DISTINCT {_index(2)} AS idx FROM cells JOIN l USING (doc_id)),
      kf AS (SELECT doc_id, {_index(2)} AS idx, cnt::DOUBLE / n AS value FROM cells),
      wide AS (SELECT l.doc_id, label, s.idx, coalesce(value, 0.0) AS value FROM l CROSS JOIN slot s LEFT JOIN kf ON kf.doc_id = l.doc_id AND kf.idx = s.idx),
      means AS (SELECT label, idx, avg(value) AS mean, var_pop(value) AS variance, count(*) AS rows, bool_or(value > 0) AS seen FROM wide GROUP BY ALL)"""
    out["diag_class_means"] = f"{labelled} SELECT label, idx, round(mean, 9) AS mean, round(variance, 9) AS variance FROM means WHERE seen"
    out["diag_fisher"] = f"""{labelled}, w AS (SELECT idx, avg(value) AS middle, count(*) AS n FROM wide GROUP BY idx),
      v AS (SELECT idx, n, sum(rows * (mean - middle) ** 2) AS between_, sum(rows * variance) AS inside, count(*) AS classes FROM means JOIN w USING (idx) GROUP BY ALL)
      SELECT idx, CASE WHEN classes > 1 AND n > classes AND inside > 0 THEN round(between_ / (classes - 1) / (inside / (n - classes)), 6) END AS fisher FROM v"""
    out["diag_differing_slots"] = f"{labelled} SELECT count(*)::BIGINT AS slots FROM (SELECT idx FROM means GROUP BY idx HAVING max(mean) - min(mean) > 0.002)"
    out["diag_mutual_information"] = f"""{labelled}, w AS (SELECT idx, avg(value) AS middle, count(*)::DOUBLE AS n FROM wide GROUP BY idx),
      b AS (SELECT idx, label, n, value > middle AS above, count(*)::DOUBLE AS c FROM wide JOIN w USING (idx) GROUP BY ALL),
      p AS (SELECT idx, c, n, sum(c) OVER (PARTITION BY idx, label) AS x, sum(c) OVER (PARTITION BY idx, above) AS y FROM b)
      SELECT idx, round(greatest(sum(c / n * ln(c * n / (x * y))), 0.0), 9) AS information FROM p GROUP BY idx"""
    out["diag_binned_information"] = f"""{labelled}, w AS (SELECT idx, label, least(floor(value * 4096), 4095)::BIGINT AS cell, count(*) OVER (PARTITION BY idx)::BIGINT AS n FROM wide),
      b AS (SELECT idx, label, n, least(10 * (rank() OVER (PARTITION BY idx ORDER BY cell) - 1) // n, 9) AS bin FROM w),
      t AS (SELECT idx, label, bin, n::DOUBLE AS n, count(*)::DOUBLE AS c FROM b GROUP BY ALL),
      p AS (SELECT idx, c, n, sum(c) OVER (PARTITION BY idx, label) AS x, sum(c) OVER (PARTITION BY idx, bin) AS y FROM t)
      SELECT idx, round(greatest(sum(c / n * ln(c * n / (x * y))), 0.0), 9) AS information FROM p GROUP BY idx"""
    out["diag_class_grid"] = f"{labelled} SELECT l.label, i // 4 AS row, i % 4 AS col, round(coalesce(mean, 0.0), 9) AS mean FROM (SELECT DISTINCT label FROM l) l CROSS JOIN generate_series(0, 15) t(i) LEFT JOIN means m ON m.label = l.label AND m.idx = i"
    out["diag_principal_components"] = f"""{_cells(2)}, kf AS (SELECT doc_id, {_index(2)} AS idx, cnt::DOUBLE / n AS value FROM cells),
      wide AS (SELECT c.doc_id, i AS idx, coalesce(value, 0.0) AS value FROM c CROSS JOIN generate_series(0, 15) t(i) LEFT JOIN kf ON kf.doc_id = c.doc_id AND kf.idx = i),
      cov AS (SELECT a.idx AS i, b.idx AS j, covar_pop(a.value, b.value) AS v FROM wide a JOIN wide b USING (doc_id) GROUP BY ALL),
      lines AS (SELECT i, list(v ORDER BY j) AS line FROM cov GROUP BY i),
      matrix AS (SELECT list(line ORDER BY i) AS m FROM lines),
      power AS (
        SELECT 0 AS step, list_transform(range(16), lambda i: (1.0 + i * i)::DOUBLE) AS w FROM matrix
        UNION ALL
        SELECT step + 1, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) AS w FROM (SELECT step, list_transform(m, lambda line: list_dot_product(line, w)) AS u FROM power, matrix WHERE step < 2000)),
      last AS (SELECT w, list_transform(m, lambda line: list_dot_product(line, w)) AS u, (SELECT sum(v) FROM cov WHERE i = j) AS whole FROM power, matrix WHERE step = 2000),
      best AS (SELECT w, list_dot_product(w, u) AS variance, whole, CASE WHEN list_max(w) < -list_min(w) THEN -1 ELSE 1 END AS side FROM last)
      SELECT (i - 1)::BIGINT AS idx, round(side * w[i], 6) AS loading, round(variance, 9) AS variance, round(variance / whole, 6) AS share FROM best, generate_series(1, 16) t(i)"""
    ks = ", ".join(f"({k})" for k in LENGTHS[-2:])
    out["diag_stability"] = f"""WITH r AS (SELECT lang AS task, quality = 1 AS pos, n_chars AS score FROM labels JOIN documents USING (doc_id)),
      c AS (SELECT task, k, count(*) FILTER (pos AND score > k)::DOUBLE AS tp, count(*) FILTER (NOT pos AND score > k)::DOUBLE AS fp, count(*) FILTER (pos AND score <= k)::DOUBLE AS fn, count(*) FILTER (NOT pos AND score <= k)::DOUBLE AS tn
        FROM r, (VALUES {ks}) v(k) GROUP BY task, k),
      m AS (SELECT task, k, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc FROM c),
      k AS (SELECT task, pos, rank() OVER (PARTITION BY task ORDER BY score) + (count(*) OVER (PARTITION BY task, score) - 1) / 2.0 AS midrank FROM r),
      a AS (SELECT task, sum(midrank) FILTER (pos)::DOUBLE AS s, count(*) FILTER (pos)::DOUBLE AS p, count(*) FILTER (NOT pos)::DOUBLE AS q FROM k GROUP BY task),
      z AS (SELECT task, CASE WHEN p > 0 AND q > 0 THEN (s - p * (p + 1) / 2) / (p * q) END AS auroc FROM a)
      SELECT 'length' AS method, k::VARCHAR AS k, count(DISTINCT task)::BIGINT AS tasks, round(avg(mcc), 9) AS mcc_mean, round(var_samp(mcc), 9) AS mcc_variance, round(avg(auroc), 9) AS auroc_mean, round(var_samp(auroc), 9) AS auroc_variance
      FROM m JOIN z USING (task) GROUP BY k"""
    out["diag_depth_by_length"] = f"{_qt_sql(4, 0.05)}, d AS (SELECT doc_id, avg(depth) AS depth FROM leaves GROUP BY doc_id) SELECT round(corr(depth, length(b)), 9) AS correlation FROM d JOIN c USING (doc_id)"
    out["extract_kmer_k3"] = out["kmer_freq_k3"]
    out["extract_adaptive_d3"] = f"{_qt_sql(3, 0.05)} SELECT * FROM {_slots(3)}"
    out["extract_combined_k2_d3"] = f"{_qt_sql(3, 0.05)} SELECT doc_id, {_index(2)} AS idx, sum(cnt)::DOUBLE / n AS value FROM cells GROUP BY doc_id, n, idx UNION ALL SELECT doc_id, idx + 16, value FROM {_slots(3)}"
    out["kmer_sparse_k2"] = f"{_cells(2)} SELECT doc_id, coalesce({_index(2)}, -1) AS idx, coalesce(cnt::DOUBLE / cells.n, 0.0) AS value FROM documents LEFT JOIN cells USING (doc_id)"
    out["feature_info"] = f"{_cells(4)} SELECT 'kmer' AS type, k, pow(4, k)::BIGINT AS dimensions, count(DISTINCT substr(z, 1, k))::BIGINT AS used FROM generate_series(1, 4) t(k) LEFT JOIN cells ON true GROUP BY k"
    number = lambda c: f"('0b' || {c})::UBIGINT"
    p64 = f"WITH {_DOCS}, p AS (SELECT doc_id, {_bits(64)} FROM c)"
    out["point_floats_p64"] = f"{p64} SELECT doc_id, {number('x_bits')}::DOUBLE / pow(2, 64) AS x, {number('y_bits')}::DOUBLE / pow(2, 64) AS y FROM p"
    parts = ", ".join(f"{number(c + '_bits')}::VARCHAR AS {c}_numerator, '{2**60}' AS {c}_denominator" for c in "xy")
    out["point_fractions_p60"] = f"WITH {_DOCS}, p AS (SELECT doc_id, {_bits(60)} FROM c) SELECT doc_id, {parts} FROM p"
    out["point_from_float_p20"] = f"SELECT doc_id, lpad(bin(floor((doc_id % 1000) / 1000.0::DOUBLE * {2**20})::BIGINT), 20, '0') AS bits FROM documents"
    out["point_update_p64"] = f"{p64} SELECT doc_id, '1' || x_bits[:63] AS x_bits, '0' || y_bits[:63] AS y_bits FROM p"
    out["point_shown_p64"] = f"WITH f AS ({out['point_floats_p64']}) SELECT doc_id, printf('CGRPointPrecise(x=%.10f, y=%.10f, bits=64)', x, y) AS point FROM f"
    out["csv_task"] = f"WITH {_DOCS} SELECT 'labelled' AS task, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, b AS seq, (dense_rank() OVER (ORDER BY quality) - 1)::BIGINT AS label FROM c JOIN labels USING (doc_id)"
    out["stream_fcgr_k3"] = out["chunked_fcgr_k3"]
    out["stream_point_p64"] = f"WITH {chunks} SELECT doc_id AS conv_id, 64::INTEGER AS precision_bits, {_bits(64)}, length(b)::BIGINT AS iterations FROM c"
    out["chunked_point_p64"] = out["stream_point_p64"]
    out["sql_kmer_windows"] = f"""{_cells(3)}, even AS (
        SELECT doc_id, 4.0 * sum(c * c)::DOUBLE / sum(c) - sum(c) > {critical_value(0.05)!r}::DOUBLE AS uneven FROM (SELECT doc_id, substr(z, 1, 1) AS base, sum(cnt) AS c FROM cells GROUP BY ALL) GROUP BY doc_id)
      SELECT doc_id, z, cnt, uneven FROM cells JOIN even USING (doc_id)"""
    out["sql_points"] = f"""WITH {_DOCS}, p AS (SELECT doc_id, {_bits(60)} FROM c)
      SELECT doc_id, x_bits, y_bits, {number('x_bits')}::DOUBLE / pow(2, 60) AS x, {number('y_bits')}::DOUBLE / pow(2, 60) AS y, {number('x_bits')}::VARCHAR AS x_numerator, lpad(bin(floor((doc_id % 1000) / 1000.0::DOUBLE * {2**20})::BIGINT), 20, '0') AS bits FROM p"""
    return out
