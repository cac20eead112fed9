"""Forests grown in tasks: against a plain recursive tree, and the nested grid against one forest for each candidate."""

import itertools
import random

import numpy as np
import pytest
from tetragrid.operators import forest
from tetragrid.operators.metrics import best_candidate
from tetragrid.plans import benchmark

STOPS = [forest.Stop(d, s) for d in (3, None) for s in (2, 5)]


def data(rng, rows, size, classes, distinct):
    x = np.array([[rng.randrange(distinct) / 7 for _ in range(size)] for _ in range(rows)])
    x[:, size // 2] = 1.0  # a feature that never splits
    y = np.array([(int(7 * (r[0] + r[1])) + (rng.random() < 0.2)) % classes for r in x])
    y[:classes] = range(classes)
    return x, y


def plain_tree(x, y, classes, path, order, mtry, depth=0):
    """The tree as nested tuples (n, counts, depth, feature, threshold, left, right)."""
    size, count = x.shape[1], np.bincount(y, minlength=classes)
    if count.max() == len(y):
        return len(y), count, depth, None
    strides = [s for s in range(1, size + 1) if np.gcd(s, size) == 1]
    start, stride = path % size, strides[int(forest._mixed(np.array([path], np.uint64))[0]) % len(strides)]
    drawn, best = [order[(start + i * stride) % size] for i in range(size)], None
    for begin in range(0, size, mtry):
        for f in drawn[begin : begin + mtry]:
            values = sorted(set(x[:, f]))
            for low, high in itertools.pairwise(values):
                left = x[:, f] <= low
                score = sum(float((np.bincount(y[part], minlength=classes) ** 2).sum()) / part.sum() for part in (left, ~left))
                if best is None or score > best[0] + 1e-9:
                    best = score, f, (low + high) / 2
        if best:
            break
    if best is None:
        return len(y), count, depth, None
    left = x[:, best[1]] <= best[2]
    kids = [int(forest._mixed(np.array([path], np.uint64) * forest._GOLDEN + np.uint64(side))[0]) for side in (1, 2)]
    below = [plain_tree(x[part], y[part], classes, kid, order, mtry, depth + 1) for part, kid in ((left, kids[0]), (~left, kids[1]))]
    return len(y), count, depth, (best[1], best[2], *below)


def plain_share(node, row, stop):
    n, count, depth, split = node
    if split is None or n < stop.least or (stop.depth is not None and depth >= stop.depth):
        return count / n
    return plain_share(split[2] if row[split[0]] <= split[1] else split[3], row, stop)


@pytest.mark.parametrize(("classes", "distinct", "rule"), [(2, 5, "sqrt"), (3, 40, "log2"), (2, 1000, "sqrt")])
def test_trees_are_those_of_the_plain_recursion(classes, distinct, rule):
    rng = random.Random(classes * distinct)
    x, y = data(rng, 70, 9, classes, distinct)
    table = forest.Table.dense(x, y)
    train, seen = np.arange(50), np.arange(50, 70)
    got = forest.votes(table, train, seen, range(3), rule, STOPS, (1, 0, 0)) / forest.VOTE
    want = np.zeros_like(got)
    for t in range(3):
        g = np.random.default_rng([1, 0, 0, t])
        own, order, path = train[g.integers(0, 50, 50)], g.permutation(9), int(g.integers(0, 1 << 63))
        tree = plain_tree(x[own], y[own], classes, path, order, forest.tried(rule, 9))
        for k, stop in enumerate(STOPS):
            want[k] += [plain_share(tree, x[i], stop) for i in seen]
    assert np.abs(got - want).max() < 1e-6 and np.abs(got.sum(2) - 3).max() < 1e-6


def test_batches_do_not_change_a_forest(monkeypatch):
    x, y = data(random.Random(1), 60, 8, 2, 9)
    table = forest.Table.dense(x, y)
    whole = forest.votes(table, np.arange(40), np.arange(40, 60), range(12), "sqrt", STOPS, (7,))
    monkeypatch.setattr(forest, "HELD_VALUES", 200)
    assert (forest.votes(table, np.arange(40), np.arange(40, 60), range(12), "sqrt", STOPS, (7,)) == whole).all()
    parts = sum(forest.votes(table, np.arange(40), np.arange(40, 60), range(a, a + 4), "sqrt", STOPS, (7,)) for a in (0, 4, 8))
    assert (parts == whole).all()


GRID = {"n_estimators": (12, 5, 30), "max_features": ("sqrt", "log2"), "max_depth": (2, None), "min_samples_split": (2, 5)}


@pytest.mark.parametrize("classes", [2, 3])
def test_the_nested_grid_scores_every_candidate_as_its_own_forest_does(spark, classes):
    x, y = data(random.Random(classes), 80, 9, classes, 30)
    table, fold = forest.Table.dense(x, y), np.arange(80) % 4
    got = {(r.candidate, r.fold): r.score for r in forest.grid_scores(spark, table, fold, GRID, 3).collect()}
    assert len(got) == 24 * 4
    for i, c in enumerate(forest.candidates(GRID)):
        for f in range(4):
            train, seen = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            rule = GRID["max_features"].index(c["max_features"])
            own = forest.votes(table, train, seen, range(c["n_estimators"]), c["max_features"], [forest.Stop(c["max_depth"], c["min_samples_split"])], (3, f, rule))[0]
            if classes == 3:
                want = float((own.argmax(1) == y[seen]).mean())
            else:
                pairs = [(a > b) + (a == b) / 2 for a in own[y[seen] == 1, 1] for b in own[y[seen] == 0, 1]]
                want = float(np.mean(pairs))
            assert got[i, f] == pytest.approx(want, abs=1e-12)
    means = {i: np.mean([got[i, f] for f in range(4)]) for i in range(24)}
    best = best_candidate(forest.grid_scores(spark, table, fold, GRID, 3)).first()
    assert best.mean_score == pytest.approx(max(means.values()))


def test_large_tables_are_left_to_the_distributed_forest(spark, monkeypatch):
    x, y = data(random.Random(4), 60, 4, 2, 9)
    rows = spark.createDataFrame([(i, int(c), [0, 1, 2, 3], r.tolist()) for i, (r, c) in enumerate(zip(x, y, strict=True))], "seq_id long, label int, indices array<long>, values array<double>")
    grid = {"n_estimators": (3,), "max_features": ("sqrt",), "max_depth": (None,), "min_samples_split": (2, 5)}
    train, test = rows.where("seq_id < 40"), rows.where("seq_id >= 40")
    near = benchmark.train_and_evaluate(train, test, 4, grid)
    monkeypatch.setattr(forest, "TABLE_BYTES", 100)
    far = benchmark.train_and_evaluate(train, test, 4, grid)
    assert set(near) == set(far) and near["train_size"] == far["train_size"] == 40 and 0 <= far["accuracy"] <= 1


def test_a_table_is_ranked_some_features_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(np.abs(rng.standard_normal((200, 17))), 1) * (rng.random((200, 17)) < 0.3)
    x[:, 5] = 0
    whole = forest.Table.dense(x, np.zeros(200, int))
    monkeypatch.setattr(forest, "BLOCK_VALUES", 500)
    parts = forest.Table.dense(x, np.zeros(200, int))
    assert (whole.values[whole.first[None, :] + whole.ranks] == x).all()
    assert (whole.ranks == parts.ranks).all() and (whole.first == parts.first).all() and (whole.values == parts.values).all()
    wide = forest.Table.dense(np.arange(70_000.0)[:, None], np.zeros(70_000, int))
    assert wide.ranks.dtype == np.uint32 and wide.ranks[-1, 0] == 69_999
    assert forest.Table.dense(np.zeros((0, 3)), np.zeros(0, int)).ranks.shape == (0, 3)


def test_a_table_holds_its_values_and_guards_its_size():
    x = np.array([[0.5, 2.0], [0.25, 2.0], [0.5, 1.0]])
    t = forest.Table.dense(x, np.array([0, 1, 1]))
    assert (t.values[t.first[None, :] + t.ranks] == x).all() and t.ranks.dtype == np.uint16 and t.classes == 2
    assert forest.fits(1000, 4096, 10**6) and not forest.fits(10**6, 4096, 10**6) and not forest.fits(1000, 4096, 10**8)
    assert forest.tried("sqrt", 256) == 16 and forest.tried("log2", 256) == 8 and forest.tried("log2", 1) == 1


def test_a_row_drawn_several_times_is_sorted_once(monkeypatch):
    x, y = data(random.Random(8), 200, 9, 2, 50)
    table, seen, plain = forest.Table.dense(x, y), [], forest._best_splits

    def spied(table, row, *more):
        seen.append(row)
        return plain(table, row, *more)

    monkeypatch.setattr(forest, "_best_splits", spied)
    forest.votes(table, np.arange(150), np.arange(150, 200), [0], "sqrt", STOPS, (2,))
    assert all(len(set(row)) == len(row) for row in seen) and len(seen[0]) < 150


@pytest.mark.parametrize(("classes", "name", "value"), [(2, "PIECE_VALUES", 1), (3, "PIECE_VALUES", 60), (5, "PIECE_VALUES", 300), (2, "COLUMN_ROWS", 1), (4, "HELD_VALUES", 1), (3, "rank_bits", 33)])
def test_pieces_do_not_change_a_forest(monkeypatch, classes, name, value):
    x, y = data(random.Random(classes), 300, 11, classes, 40)
    table, train, seen = forest.Table.dense(x, y), np.arange(200), np.arange(200, 300)
    whole = forest.votes(table, train, seen, range(6), "sqrt", STOPS, (5,))
    if name == "rank_bits":
        monkeypatch.setattr(forest.Table, name, value)
    else:
        monkeypatch.setattr(forest, name, value)
    assert (forest.votes(table, train, seen, range(6), "sqrt", STOPS, (5,)) == whole).all()


@pytest.mark.parametrize("classes", [2, 3])
def test_trees_of_many_rows_are_those_of_the_plain_recursion(classes):
    x, y = data(random.Random(classes), 12_000, 3, classes, 6)
    train, seen = np.arange(11_900), np.arange(11_900, 12_000)
    got = forest.votes(forest.Table.dense(x, y), train, seen, [0], "sqrt", STOPS, (6,)) / forest.VOTE
    g = np.random.default_rng([6, 0])
    own, order, path = train[g.integers(0, len(train), len(train))], g.permutation(3), int(g.integers(0, 1 << 63))
    tree = plain_tree(x[own], y[own], classes, path, order, forest.tried("sqrt", 3))
    assert np.abs(got - [[plain_share(tree, x[i], stop) for i in seen] for stop in STOPS]).max() < 1e-6


def test_a_node_that_no_row_to_vote_on_reaches_is_not_split(monkeypatch):
    x, y = data(random.Random(9), 400, 9, 2, 60)
    table, sizes, plain = forest.Table.dense(x, y), [], forest._best_splits

    def spied(table, row, *more):
        sizes.append(len(row))
        return plain(table, row, *more)

    monkeypatch.setattr(forest, "_best_splits", spied)
    one = forest.votes(table, np.arange(350), np.array([377]), [0], "sqrt", STOPS, (2,))
    assert len(sizes) > 3 and all(a > b for a, b in itertools.pairwise(sizes))
    assert (one[:, 0] == forest.votes(table, np.arange(350), np.arange(350, 400), [0], "sqrt", STOPS, (2,))[:, 27]).all()
