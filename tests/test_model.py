"""Tasks from CSV folders, forests, results, the command line and the diagnostics, held against plain versions."""

import csv
import random
from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F
from tetragrid.functions.bases import chi_square_p, chi_square_tail
from tetragrid.operators import diagnostics, fcgr, metrics, point, principal, quadtree
from tetragrid.plans import benchmark, registry
from tetragrid.sources import labelled

TINY = {"n_estimators": (5,), "max_features": ("sqrt",), "max_depth": (None,), "min_samples_split": (2,)}


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="") as out:
        csv.writer(out).writerows([("any", "name", "more"), *rows])


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Two tasks whose labels show in the bases, and a folder that has no test.csv."""
    rng, top = random.Random(3), tmp_path_factory.mktemp("tasks")
    seq = lambda bases: "".join(rng.choice(bases) for _ in range(60))
    for name, kinds in (("a/two", {"neg": "ACGT", "pos": "ccccg"}), ("three", {"10": "ACGT", "9": "CCG", "2": "AAT"})):
        for split, n in (("train", 24), ("test", 8)):
            write(top / name / f"{split}.csv", [(seq(b), label, "x") for _ in range(n) for label, b in kinds.items()])
    write(top / "half" / "train.csv", [("ACGT", "1", "x")])
    return top


def test_tasks_are_found_and_loaded(spark, root):
    tasks = labelled.discover_tasks(spark, str(root)).collect()
    assert [t.name for t in tasks] == ["a/two", "three"]
    two = labelled.load_task(spark, tasks[0].train_path, tasks[0].test_path, "a/two")
    assert two.columns == ["seq_id", "task", "split", "seq", "label"]
    rows = two.collect()
    assert len(rows) == len({r.seq_id for r in rows}) == 64 and all(r.seq == r.seq.upper() for r in rows)
    assert {r.label for r in rows if set(r.seq) <= set("CG")} == {1}
    three = labelled.load_task(spark, tasks[1].train_path, tasks[1].test_path)
    assert {r.label for r in three.collect() if set(r.seq) <= set("AT")} == {0}  # 2 < 9 < 10, as numbers
    assert [t.name for t in labelled.discover_tasks(spark, str(root / "three")).collect()] == ["."]


def test_a_side_of_a_task_may_be_a_folder_of_parts(spark, tmp_path):
    for split in ("train", "test"):
        spark.createDataFrame([("ACGT", "2"), ("", "10"), ("gg", "10")], "s string, l string").repartition(2).write.csv(str(tmp_path / "parts" / f"{split}.csv"), header=True)
    (task,) = labelled.discover_tasks(spark, str(tmp_path)).collect()
    assert task.name == "parts"
    rows = labelled.load_task(spark, task.train_path, task.test_path, task.name).where("split = 'test'")
    assert sorted((r.seq, r.label) for r in rows.collect()) == [("", 1), ("ACGT", 0), ("GG", 1)]


def test_a_row_without_a_label_is_an_error(spark, tmp_path):
    for split in ("train", "test"):
        write(tmp_path / f"{split}.csv", [("ACGT", "1", "x"), ("ACGT", "", "x")])
    rows = labelled.load_task(spark, str(tmp_path / "train.csv"), str(tmp_path / "test.csv"))
    with pytest.raises(Exception, match="a row has no label"):
        rows.collect()


def test_the_command_line_writes_one_line_for_each_run(spark, root, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(benchmark, "SMALL_GRID", TINY)
    out = tmp_path / "r.csv"
    benchmark.main(["--data-root", str(root), "--list-tasks"])
    assert "a/two\nthree\n" in capsys.readouterr().out
    benchmark.main(["--data-root", str(root), "--tasks", "none"])
    assert "none of the named tasks" in capsys.readouterr().out
    benchmark.main(["--data-root", str(root), "--tasks", "a/two", "--k-values", "2", "4", "--grid-size", "8", "--qt-max-depth", "2", "--small-grid", "--output", str(out)])
    shown = capsys.readouterr().out
    assert "SKIP k=4" in shown and "a/two: 48 train, 16 test\n  0 characters are no bases, " in shown
    benchmark.main(["--data-root", str(root), "--tasks", "three", "--k-values", "2", "--method", "kmer", "--grid-size", "8", "--small-grid", "--output", str(out)])
    with out.open() as lines:
        rows = list(csv.DictReader(lines))
    assert list(rows[0]) == labelled.StructType.fromDDL(labelled.RESULT_SCHEMA).names
    assert [(r["task"], r["method"], r["k"], r["feature_dim"]) for r in rows] == [("a/two", "kmer", "2", "16"), ("a/two", "adaptive", "d2_p0.05", "16"), ("a/two", "kmer_qt", "2", "32"), ("three", "kmer", "2", "16")]
    for r in rows:
        assert float(r["accuracy"]) >= 0.9 and float(r["auroc"]) >= 0.9 and r["timestamp"] and "'n_estimators': 5" in r["best_params"]
    assert [(r["n_classes"], r["train_size"], r["test_size"]) for r in rows[2:]] == [("2", "48", "16"), ("3", "72", "24")]


def test_grids_are_guarded(spark):
    rows = spark.createDataFrame([(1, "ACGT")], "seq_id long, seq string")
    for grid, methods in ((100, ("kmer",)), (8, ("adaptive",))):
        with pytest.raises(ValueError, match="grid_size"):
            benchmark.run_task(spark, rows, "t", ks=(2,), methods=methods, grid_size=grid)


def test_a_result_may_go_to_a_folder(spark, tmp_path):
    for task in "ab":
        labelled.save_result(spark, str(tmp_path / "results"), {"task": task, "unknown": 1})
    got = spark.read.csv(str(tmp_path / "results"), header=True, schema=labelled.RESULT_SCHEMA)
    assert sorted(r.task for r in got.collect()) == ["a", "b"] and got.columns[-1] == "timestamp"


def plain_auroc(rows):
    pos, neg = ([s for p, s in rows if p == side] for side in (True, False))
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_areas_against_the_rest(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), [rng.randrange(6) / 6 for _ in range(3)]) for _ in range(200)]
    table = spark.createDataFrame(rows, "label int, probability array<double>").repartition(5)
    want = sum(plain_auroc([(label == c, p[c]) for label, p in rows]) for c in range(3)) / 3
    assert metrics.auroc_ovr(table, [0, 1, 2]).first().auroc == pytest.approx(want)
    assert str(metrics.auroc_ovr(table.where("label > 0"), [0, 1, 2]).first().auroc) == "nan"
    assert str(metrics.auroc_ovr(table.where("false"), [0, 1]).first().auroc) == "nan"


def test_of_equal_candidates_the_first_is_best(spark):
    nan = float("nan")
    rows = [(3, 0, 1.0), (3, 1, 0.5), (1, 0, 0.5), (1, 1, 1.0), (2, 0, 0.7), (2, 1, 0.7), (0, 0, nan), (0, 1, 1.0)]
    assert tuple(metrics.best_candidate(spark.createDataFrame(rows, "candidate long, fold int, score double")).first()) == (1, 0.75)


def test_diagnostics_are_those_of_dense_tables(spark):
    rng = random.Random(9)
    labels = [(i, i % 3) for i in range(90)] + [(90, None)]
    cells = {(i, j): rng.random() + (c or 0) * (j == 1) for i, c in labels for j in range(4) if rng.random() < 0.7 and not (j == 3 and c == 0)}
    features = spark.createDataFrame([(i, j, v) for (i, j), v in cells.items()], "id long, idx long, value double")
    table = spark.createDataFrame(labels, "id long, label int")
    fisher = dict(map(tuple, diagnostics.fisher_scores(features, table).collect()))
    told = dict(map(tuple, diagnostics.mutual_information(features, table).collect()))
    apart = 0
    for j in range(4):
        by = [[cells.get((i, j), 0.0) for i, c in labels if c == k] for k in range(3)]
        every = [v for own in by for v in own]
        mean, means = sum(every) / 90, [sum(own) / 30 for own in by]
        between, inside = sum(30 * (m - mean) ** 2 for m in means) / 2, sum((v - m) ** 2 for own, m in zip(by, means, strict=True) for v in own) / 87
        assert fisher[j] == pytest.approx(between / inside)
        a = sum(v > mean for v in every)
        want = sum(n / 90 * log(n * 90 / (30 * side)) for own in by for n, side in ((sum(v > mean for v in own), a), (sum(v <= mean for v in own), 90 - a)) if n)
        assert told[j] == pytest.approx(want)
        apart += max(means) - min(means) > 0.3
    assert diagnostics.differing_slots(features, table, 0.3).first().slots == apart > 0
    assert diagnostics.fisher_scores(features.where("false"), table).collect() == []


def test_principal_components_are_those_of_a_dense_solver(spark):
    rng = np.random.default_rng(2)
    dense = np.abs(rng.standard_normal((300, 5)) @ rng.standard_normal((5, 30)) + 0.1 * rng.standard_normal((300, 30)))
    dense[rng.random(dense.shape) < 0.5] = 0
    dense[:20] = 0
    rows = spark.createDataFrame([(np.flatnonzero(r).tolist(), r[r != 0].tolist()) for r in dense], "indices array<long>, values array<double>").repartition(3)
    values, vectors = np.linalg.eigh(np.cov(dense.T, bias=True))
    got = {}
    for r in principal.principal_components(rows, 30, 3).collect():
        got.setdefault(r.component, np.zeros(30))[r.idx] = r.loading
        assert r.variance == pytest.approx(values[-1 - r.component]) and r.share == pytest.approx(values[-1 - r.component] / values.sum())
    for j in range(3):
        own = vectors[:, -1 - j] * np.sign(vectors[np.abs(vectors[:, -1 - j]).argmax(), -1 - j])
        assert np.abs(got[j] - own).max() < 1e-6
    assert principal.principal_components(rows.limit(0), 30).collect() == []
    with pytest.raises(ValueError, match="too many"):
        principal.principal_components(rows, 1 << 30)


def test_binned_information_and_grids(spark):
    rng = random.Random(3)
    labels = [(i, i % 3) for i in range(200)] + [(900, None)]
    values = {(i, s): rng.random() * (1 + (i % 3 == s)) / 2 for i in range(200) for s in range(3) if rng.random() < 0.7}
    features = spark.createDataFrame([(i, s, v) for (i, s), v in values.items()] + [(900, 0, 0.5)], "id long, idx long, value double")
    table = spark.createDataFrame(labels, "id long, label int")
    got = {r.idx: r.information for r in diagnostics.binned_information(features, table, 4).collect()}
    for s in range(3):
        cells = {i: int(values.get((i, s), 0.0) * diagnostics.CELLS) for i in range(200)}
        joint = Counter((i % 3, 4 * sum(c < cells[i] for c in cells.values()) // 200) for i in range(200))
        x, y = Counter(), Counter()
        for (a, b), c in joint.items():
            x[a] += c
            y[b] += c
        assert got[s] == pytest.approx(sum(c / 200 * log(c * 200 / (x[a] * y[b])) for (a, b), c in joint.items()))
    grid = {(r.label, r.row, r.col): r.mean for r in diagnostics.class_grid(features, table, 1).collect()}
    assert len(grid) == 12 and grid[1, 1, 1] == 0.0
    assert grid[2, 1, 0] == pytest.approx(sum(values.get((i, 2), 0.0) for i in range(2, 200, 3)) / 66)


def test_stability_over_tasks(spark):
    rows = spark.createDataFrame([("a", "kmer", "4", 0.5, 0.8), ("b", "kmer", "4", 0.7, float("nan"))], "task string, method string, k string, mcc double, auroc double")
    r = diagnostics.stability(rows).first()
    assert (r.tasks, r.auroc_mean) == (2, 0.8) and r.mcc_variance == pytest.approx(0.02) and r.auroc_variance is None


def test_tail_probabilities_as_a_column(spark):
    got = spark.createDataFrame([(7.81472790325118,), (0.0,), (None,)], "x double").select(chi_square_p("x").alias("p")).collect()
    assert got[0].p == pytest.approx(0.05) and got[1].p == chi_square_tail(0.0) == 1.0 and got[2].p is None


def test_point_steps_and_text(spark):
    row = spark.createDataFrame([(0.375, 0.5)], "x double, y double")
    bits = row.select(point.float_to_bits(8)("x").alias("x_bits"), point.float_to_bits(8)("y").alias("y_bits"), F.lit(8).alias("precision_bits"))
    assert bits.first().x_bits == "01100000"
    moved = bits.withColumn("x_bits", point.updated(F.col("x_bits"), F.lit(1)))
    assert point.shown(moved).first().point == "CGRPointPrecise(x=0.6875000000, y=0.5000000000, bits=8)"
    tie = moved.withColumn("x_bits", F.lit("00000000001")).withColumn("y_bits", F.lit("00000000011"))
    assert point.shown(tie).first().point == "CGRPointPrecise(x=0.0004882812, y=0.0014648438, bits=8)"
    with pytest.raises(Exception, match="precision must be below 1024"):
        row.select(point.float_to_bits(1024)("x")).collect()


def test_batch_features_are_those_of_their_parts(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, "".join(rng.choice("AACGT") for _ in range(80))) for i in range(6)], "seq_id long, seq string")
    counts = fcgr.fcgr_counts(rows, 3, id_col="seq_id", seq_col="seq")
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    kmer = fcgr.extract_kmer_features(rows, 3, 8)
    tree = quadtree.extract_adaptive_features(rows, 8, 3)
    assert same(kmer, fcgr.kmer_features(counts, 3)) and same(tree, quadtree.qt_slots(quadtree.qt_leaves(counts, 3), 3))
    both = quadtree.extract_combined_features(rows, 3, 8, 3)
    assert same(both, kmer.unionByName(tree.withColumn("idx", F.col("idx") + 64)))
    assert fcgr.feature_info(3) == {"type": "kmer", "k": 3, "dimensions": 64}


def test_the_registered_forest_gives_one_row(spark):
    r = registry.rf_kmer_eval(spark, "/root/testdata/sf0.001").first()
    assert r.n_classes == 2 and r.train_size > r.test_size > 0 and 0 < r.accuracy <= 1
