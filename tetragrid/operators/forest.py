"""Random forests grown in tasks, and a whole grid of them read off the largest one.

A tree is a plain CART tree on a bootstrap sample: Gini impurity, thresholds in
the middle between two values that occur, as many features tried at a node as
the rule says, and more only while none of them splits it.  The choices at a
node come from a hash of its path, so a tree of less depth, or of larger split
nodes, is the same tree stopped earlier, and a smaller forest is the beginning
of a larger one.  So for each fold and rule for the features one forest is
grown, and rows that are pushed down with it are voted on wherever a candidate
of the grid stops: trees, depths and split sizes are prefixes of one run.

Tasks are batches of trees.  Each holds the table as ranks of its values, two or
four bytes for each, which is broadcast: `fits` is to be asked first.  The driver
ranks some features at a time and never holds the table as numbers.  Some trees
are grown at once, level by level; nodes of about one size are sorted together,
each row of a matrix a node's values of one feature.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import auroc, best_candidate

#: The most bytes of ranks that are broadcast, and of entries that are fetched to rank them, counted before.
TABLE_BYTES = 1 << 28
#: Values that are ranked at a time.
BLOCK_VALUES = 1 << 22
#: Trees of a task, rows of the trees that it grows at once, and values that it sorts at once unless a node has more rows.
BATCH_TREES, HELD_VALUES, PIECE_VALUES = 50, 1 << 20, 1 << 16
#: A node of so many rows reads its features' columns, a smaller one its rows.
COLUMN_ROWS = 1 << 13
#: Votes are summed as whole numbers of this part, so that sums do not depend on their order.
VOTE = 1 << 40

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fits(rows: int, size: int, entries: int) -> bool:
    """Whether a table of so many rows, features and entries that are not zero may be broadcast."""
    return rows * size * 4 <= TABLE_BYTES and entries * 16 <= TABLE_BYTES


@dataclass
class Table:
    """Rows as ranks among each feature's values; `values` holds these, those of feature f from first[f] on."""

    ranks: np.ndarray
    values: np.ndarray
    first: np.ndarray
    label: np.ndarray
    classes: int

    @functools.cached_property
    def columns(self) -> np.ndarray:
        """[feature, row]: the ranks again, for nodes of many rows."""
        return np.ascontiguousarray(self.ranks.T)

    @functools.cached_property
    def rank_bits(self) -> int:
        return int(np.diff(self.first, append=len(self.values)).max(initial=1)).bit_length()

    @staticmethod
    def of(rows: int, size: int, row: np.ndarray, index: np.ndarray, value: np.ndarray, label: np.ndarray) -> Table:
        """From the entries that are not zero."""
        order = np.argsort(index, kind="stable")
        row, index, value = row[order], index[order], value[order]
        ranks, values, counts = np.zeros((rows, size), np.uint16), [np.zeros(0)], [np.zeros(0, np.int64)]
        width = max(1, BLOCK_VALUES // max(rows, 1))
        for begin in range(0, size if rows else 0, width):
            end = min(size, begin + width)
            a, b = np.searchsorted(index, [begin, end])
            dense = np.zeros((rows, end - begin))
            dense[row[a:b], index[a:b] - begin] = value[a:b]
            by = np.argsort(dense, axis=0, kind="stable")
            ordered = np.take_along_axis(dense, by, 0)
            new = np.ones(dense.shape, bool)
            new[1:] = ordered[1:] != ordered[:-1]
            number = np.cumsum(new, 0) - 1
            if number[-1].max() >= 1 << 16 and ranks.dtype == np.uint16:
                ranks = ranks.astype(np.uint32)
            np.put_along_axis(ranks[:, begin:end], by, number.astype(ranks.dtype), 0)
            values.append(ordered.T[new.T])
            counts.append(new.sum(0))
        first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])[:size]
        return Table(ranks, np.concatenate(values), first, label.astype(np.int64), int(label.max(initial=0)) + 1)

    @staticmethod
    def dense(table: np.ndarray, label: np.ndarray) -> Table:
        row, index = np.nonzero(table)
        return Table.of(*table.shape, row, index, table[row, index], label)


def tried(rule: str, size: int) -> int:
    """How many features are tried at a node."""
    return max(1, int({"sqrt": math.sqrt, "log2": math.log2}[rule](size)))


@dataclass(frozen=True)
class Stop:
    """Where a candidate's trees end: at a depth (None: nowhere), and at nodes of fewer rows than least."""

    depth: int | None
    least: int


@dataclass(frozen=True)
class Code:
    """How a row's number, class and weight, from high to low, lie in one whole number."""

    classes: int
    class_bits: int
    weight_bits: int

    @property
    def bits(self) -> int:
        return self.class_bits + self.weight_bits

    def weights(self, code: np.ndarray, half: int) -> Iterator[np.ndarray]:
        """For each pair of classes the weights, of its second class times 2 ** half, so that one sum is two."""
        kind, weight = self.kind(code), code & code.dtype.type((1 << self.weight_bits) - 1)
        for pair in range((self.classes + 1) // 2):
            own = (kind & code.dtype.type(1)) * code.dtype.type((1 << half) - 1) + code.dtype.type(1)
            own *= weight
            yield own if self.classes <= 2 else own * (kind >> code.dtype.type(1) == code.dtype.type(pair))

    def kind(self, code: np.ndarray) -> np.ndarray:
        return (code >> code.dtype.type(self.weight_bits)) & code.dtype.type((1 << self.class_bits) - 1)

    def by_class(self, sums: Sequence[np.ndarray], half: int) -> list[np.ndarray]:
        """The sum of each class from those of `weights`."""
        low = sums[0].dtype.type((1 << half) - 1)
        return [sums[c // 2] >> sums[0].dtype.type(half) if c % 2 else sums[c // 2] & low for c in range(self.classes)]


def _best_of_piece(table: Table, code: Code, row: np.ndarray, start: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """Those of a piece's nodes that split, with the score, the feature and its ranks on both sides of the border; own holds each node's features.

    Nodes are the rows of a matrix as wide as the largest one.  What a smaller one lacks sorts behind all ranks and weighs nothing.
    """
    (n, width), m = own.shape, int(sizes.max())
    dtype = np.uint32 if table.rank_bits + code.bits <= 32 else np.uint64
    bits, low, beyond_all = dtype(code.bits), (1 << code.bits) - 1, dtype(((1 << table.rank_bits) - 1) << code.bits)
    if m >= COLUMN_ROWS and n == 1:
        drawn = row[start[0] : start[0] + m]
        rows, key = drawn >> code.bits, np.empty((width, m), dtype)
        for f, into in zip(own[0], key, strict=True):
            into[:] = table.columns[f].take(rows)
        key <<= bits
        key |= (drawn & low).astype(dtype)
    else:
        drawn = row[np.minimum(start[:, None] + np.arange(m), len(row) - 1)]
        filled = np.where(np.arange(m) < sizes[:, None], (drawn & low).astype(dtype), beyond_all)
        key = table.ranks.reshape(-1).take(((drawn >> code.bits) * table.ranks.shape[1])[:, None] + own[:, :, None]).astype(dtype)
        key <<= bits
        key |= filled[:, None]
        key = key.reshape(-1, m)
    key.sort(axis=1)
    change = key[:, 1:] ^ key[:, :-1]
    differs = change > dtype(low)
    # between two single rows of one class no border is the best: the score is convex along rows of a class
    change &= dtype(((1 << code.class_bits) - 1) << code.weight_bits)
    skipped = change == 0
    skipped[:, 1:] &= differs[:, :-1]
    skipped[:, :-1] &= differs[:, 1:]
    differs &= ~skipped
    if n > 1:
        differs &= key[:, 1:] < beyond_all
    border = np.flatnonzero(differs)
    if not len(border):
        return (border,) * 5
    group = border // (m - 1)
    border += group
    half = 16 if m << code.weight_bits < 1 << 16 else 32
    total = np.uint32 if half == 16 else np.uint64
    left, right = [], []
    for weight in code.weights(key if half == 16 else key.astype(total), half):
        run = weight.cumsum(1, dtype=total)
        left.append(run.take(border))
        right.append(run[:, -1].take(group) - left[-1])
    left, right = ([x.astype(float) for x in code.by_class(side, half)] for side in (left, right))
    here, beyond, score = sum(left[1:], left[0]), sum(right[1:], right[0]), np.zeros(len(border))
    for x, y in zip(left, right, strict=True):
        score += x * x / here + y * y / beyond
    heads = np.searchsorted(group, np.arange(0, n * width + 1, width))
    found = np.flatnonzero(heads[1:] > heads[:-1])
    best = np.array([a + score[a:b].argmax() for a, b in zip(heads[found].tolist(), heads[found + 1].tolist(), strict=True)])  # of equal ones the first feature drawn, the least value
    p, flat = border[best], key.reshape(-1)
    return found, score[best], own[found, group[best] % width], flat[p] >> bits, flat[p + 1] >> bits


def _best_splits(table: Table, row: np.ndarray, code: Code, sizes: np.ndarray, mtry: int, draw) -> tuple[np.ndarray, np.ndarray]:
    """Feature (-1: none) and least rank above the threshold of each node, from the codes of its rows.

    The rows lie node by node, as many as sizes says; draw(nodes, from, to) gives features in order.  Nodes of about one size
    make a piece; of a larger node some features do.
    """
    size, nodes = table.ranks.shape[1], len(sizes)
    start = np.cumsum(sizes) - sizes
    top = np.full(nodes, -1.0)
    feature, low, high = np.full(nodes, -1, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    asked = np.argsort(-sizes, kind="stable")
    for begin in range(0, size, mtry):
        own = draw(asked, begin, min(begin + mtry, size))
        falling, i = -sizes[asked], 0
        while i < len(asked):
            m = -int(falling[i])
            some = max(1, PIECE_VALUES // m)
            j = min(i + max(1, some // own.shape[1]), int(np.searchsorted(falling, min(8 - m * 3 // 4, 0), "right")))
            piece = asked[i:j]
            for k in range(0, own.shape[1], some):
                found, score, *split = _best_of_piece(table, code, row, start[piece], sizes[piece], own[i:j, k : k + some])
                better = score > top[piece[found]]
                at = piece[found[better]]
                top[at], feature[at], low[at], high[at] = (x[better] for x in (score, *split))
            i = j
        asked = asked[feature[asked] < 0]
        if not len(asked):
            break
    return feature, _cuts(table, feature, low, high)


def _cuts(table: Table, feature: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least rank above the middle between the feature's values of two ranks; the higher one where these are neighbours."""
    first = table.first[feature]
    below, above = table.values[first + low], table.values[first + high]
    threshold = (below + above) / 2
    threshold = np.where(threshold == above, below, threshold)  # neighbours whose middle rounds up
    low, high = low + 1, high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        under = open_ & (table.values[np.where(open_, first + middle, 0)] <= threshold)
        low, high = np.where(under, middle + 1, low), np.where(open_ & ~under, middle, high)
    return high


def votes(table: Table, train: np.ndarray, seen: np.ndarray, trees: Sequence[int], rule: str, stops: Sequence[Stop], seed: Sequence[int]) -> np.ndarray:
    """[stop, row of seen, class]: the votes of the trees with these numbers, grown on the rows train, as whole numbers of 1 / VOTE."""
    out = np.zeros((len(stops), len(seen), table.classes), np.int64)
    if not len(train) or not len(seen):
        return out
    own = Table(table.ranks[train], table.values, table.first, table.label[train], table.classes)
    guests, some = np.ascontiguousarray(table.ranks[seen].T), max(1, HELD_VALUES // max(len(train), len(seen)))
    for i in range(0, len(trees), some):
        out += _grown_votes(own, guests, trees[i : i + some], rule, stops, seed)
    return out


def _grown_votes(table: Table, guests: np.ndarray, trees: Sequence[int], rule: str, stops: Sequence[Stop], seed: Sequence[int]) -> np.ndarray:
    """The votes for the guests, ranks by feature and row, of trees that are grown at once, level by level, on all rows of the table.

    Rows and guests lie node by node; the left children of a level come before the right ones.  A node that no guest reaches is not split.
    """
    (rows, size), C, T, m = table.ranks.shape, table.classes, len(trees), guests.shape[1]
    mtry = tried(rule, size)
    strides = np.flatnonzero(np.gcd(np.arange(1, size + 1), size) == 1) + 1
    rngs = [np.random.default_rng([*seed, t]) for t in trees]
    drawn = [np.bincount(rng.integers(0, rows, rows), minlength=rows) for rng in rngs]
    sizes = np.array([np.count_nonzero(d) for d in drawn])
    row = np.concatenate([np.flatnonzero(d) for d in drawn])
    weight = np.concatenate([d[d > 0] for d in drawn])
    weight_bits = int(weight.max()).bit_length()
    code = Code(C, (C - 1).bit_length(), weight_bits)
    row = (row << code.class_bits | table.label[row]) << weight_bits | weight
    order = np.array([rng.permutation(size) for rng in rngs])
    path = np.array([rng.integers(0, 1 << 63) for rng in rngs]).astype(np.uint64)
    tree = np.arange(T)
    guest, guest_sizes = np.tile(np.arange(m), T), np.full(T, m)
    closed, share = np.zeros((len(stops), T), bool), np.zeros((len(stops), T, C), np.int64)
    leaf_guests, leaf_numbers, leaf_shares = [], [], []
    depth, leaf_count = 0, 0
    while len(path):
        start = np.cumsum(sizes) - sizes
        count = np.stack(code.by_class([np.add.reduceat(w, start) for w in code.weights(row, 32)], 32), 1)
        n = count.sum(1)
        ends = np.array([(count.max(1) == n) | (n < s.least) | (s.depth is not None and depth >= s.depth) for s in stops])
        share = np.where(closed[:, :, None], share, (count * VOTE + n[:, None] // 2) // n[:, None])
        wanted = np.flatnonzero(~ends.all(0) & (guest_sizes > 0))
        feature, cut = np.full(len(path), -1, np.int64), np.zeros(len(path), np.int64)
        if len(wanted):
            row = _of_nodes(wanted, sizes, row)
            start = (path[wanted] % np.uint64(size)).astype(np.int64)
            stride = strides[(_mixed(path[wanted]) % np.uint64(len(strides))).astype(np.int64)]
            owner = tree[wanted]
            draw = lambda which, a, b: order[owner[which][:, None], (start[which][:, None] + np.arange(a, b) * stride[which][:, None]) % size]  # noqa: B023, E731
            feature[wanted], cut[wanted] = _best_splits(table, row, code, sizes[wanted], mtry, draw)
        leaves, split = np.flatnonzero((feature < 0) & (guest_sizes > 0)), np.flatnonzero(feature >= 0)
        leaf_guests.append(_of_nodes(leaves, guest_sizes, guest))
        leaf_numbers.append(np.repeat(np.arange(leaf_count, leaf_count + len(leaves)), guest_sizes[leaves]))
        leaf_shares.append(share[:, leaves])
        leaf_count += len(leaves)
        if not len(split):
            break
        if len(split) < len(wanted):
            row = _of_nodes(np.flatnonzero(feature[wanted] >= 0), sizes[wanted], row)
        guest = _of_nodes(split, guest_sizes, guest)
        feature, cut = feature[split], cut[split]
        row, sizes = _parted(row, row >> code.bits, sizes[split], table.columns, feature, cut)
        guest, guest_sizes = _parted(guest, guest, guest_sizes[split], guests, feature, cut)
        path = _mixed(np.concatenate([path[split] * _GOLDEN + np.uint64(side) for side in (1, 2)]))
        tree, closed, share = np.tile(tree[split], 2), np.tile(ends[:, split], 2), np.tile(share[:, split], (1, 2, 1))
        depth += 1
    guest, number, share = np.concatenate(leaf_guests), np.concatenate(leaf_numbers), np.concatenate(leaf_shares, 1)
    out = np.zeros((len(stops), m, C), np.int64)
    for k, c in itertools.product(range(len(stops)), range(C)):
        out[k, :, c] = np.bincount(guest, share[k, :, c].take(number), m)  # whole numbers below 2 ** 53, so the float sums are exact
    return out


def _of_nodes(nodes: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Those of these nodes, of rows that lie node by node."""
    if len(nodes) == len(sizes):
        return rows
    inside = np.zeros(len(sizes), bool)
    inside[nodes] = True
    return rows.take(np.flatnonzero(np.repeat(inside, sizes)))


def _parted(rows: np.ndarray, number: np.ndarray, sizes: np.ndarray, columns: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows, which have these numbers in the columns, with those left of all nodes before those right of them, and how many each of these nodes has."""
    right = columns.reshape(-1).take(number + np.repeat(feature * columns.shape[1], sizes)) >= np.repeat(cut, sizes)
    on_right = np.add.reduceat(right, np.cumsum(sizes) - sizes, dtype=np.int64)
    return rows.take(np.concatenate([np.flatnonzero(~right), np.flatnonzero(right)])), np.concatenate([sizes - on_right, on_right])


def candidates(grid: dict) -> list[dict]:
    """The grid's candidates in order: parameters by name, the last one fastest."""
    names = sorted(grid)
    return [dict(zip(names, values, strict=True)) for values in itertools.product(*(grid[n] for n in names))]


def fetched(rows: DataFrame, size: int, *extra: str) -> tuple[Table, dict[str, np.ndarray]]:
    """The table of (seq_id, label, indices, values) in order of seq_id, and the extra columns; only for rows that fit."""
    held = rows.select("seq_id", F.col("label").cast("long").alias("label"), "indices", "values", *extra).orderBy("seq_id").toArrow()
    indices, values = (held.column(c).combine_chunks() for c in ("indices", "values"))
    row = np.repeat(np.arange(held.num_rows), indices.value_lengths().to_numpy())
    table = Table.of(held.num_rows, size, row, indices.flatten().to_numpy(), values.flatten().to_numpy(), held.column("label").to_numpy())
    return table, {c: held.column(c).to_numpy() for c in extra}


def grown(spark: SparkSession, table: Table, parts: Sequence[tuple[np.ndarray, np.ndarray]], rules: Sequence[str], stops: Sequence[Stop], trees: Sequence[int], seed: int) -> DataFrame:
    """(part, rule, stop, trees, row, label, p0, p1, ...): summed votes for the rows that each part (train, seen) sees, for each number of trees.

    rule and stop are places in their lists.
    """
    cuts = sorted({0, *trees})
    batches = [(part, rule, t, min(t + BATCH_TREES, b), b) for part in range(len(parts)) for rule in range(len(rules)) for a, b in itertools.pairwise(cuts) for t in range(a, b, BATCH_TREES)]
    sent = spark.sparkContext.broadcast((table, list(parts)))
    names = [[f"s{k}p{c}" for c in range(table.classes)] for k in range(len(stops))]
    flat = list(itertools.chain.from_iterable(names))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, split = sent.value
        for batch in found:
            for number in batch.column(0).to_pylist():
                part, rule, a, b, upto = batches[number]
                train, seen = split[part]
                sums = votes(own, train, seen, range(a, b), rules[rule], stops, (seed, part, rule))
                same = [pa.array(np.full(len(seen), x, np.int64)) for x in (part, rule, upto)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(seen.astype(np.int64)), pa.array(own.label[seen]), *(pa.array(v) for by_class in sums for v in by_class.T)], ["part", "rule", "upto", "row", "label", *flat])

    every = spark.range(0, len(batches), 1, max(1, len(batches)))
    fields = "part long, rule long, upto long, row long, label long, " + ", ".join(f"{n} long" for n in flat)
    total = [F.sum(n).alias(n) for n in flat]
    sums = every.mapInArrow(run, fields).groupBy("part", "rule", "upto", "row", "label").agg(*total)
    sizes = F.explode(F.filter(F.array(*(F.lit(t) for t in sorted(set(trees)))), lambda t: t >= F.col("upto")))
    sums = sums.withColumn("trees", sizes).groupBy("part", "rule", "trees", "row", "label").agg(*total)
    each = [F.struct(F.lit(k).cast("long").alias("stop"), *(F.col(n).alias(f"p{c}") for c, n in enumerate(own))) for k, own in enumerate(names)]
    return sums.withColumn("s", F.explode(F.array(*each))).select("part", "rule", "s.stop", "trees", "row", "label", *(f"s.p{c}" for c in range(table.classes)))


def predicted(grown_rows: DataFrame, classes: int) -> DataFrame:
    """The rows with prediction, the first class of most votes, and probability, the share of each."""
    each = [F.col(f"p{c}") for c in range(classes)]
    most = F.array_position(F.array(*each), F.greatest(*each) if classes > 1 else each[0]) - 1
    total = sum(each[1:], each[0]).cast("double")
    return grown_rows.withColumn("prediction", most.cast("long")).withColumn("probability", F.array(*(x / total for x in each)))


def grid_scores(spark: SparkSession, table: Table, fold: np.ndarray, grid: dict, seed: int) -> DataFrame:
    """(candidate, fold, score) of every candidate of the grid on every fold: the area under the curve for two classes, else the accuracy."""
    stops = [Stop(d, s) for d in grid["max_depth"] for s in grid["min_samples_split"]]
    parts = [(np.flatnonzero(fold != f), np.flatnonzero(fold == f)) for f in range(int(fold.max(initial=0)) + 1)]
    rules = list(grid["max_features"])
    rows = predicted(grown(spark, table, parts, rules, stops, grid["n_estimators"], seed), table.classes)
    numbers = [(rules.index(c["max_features"]), stops.index(Stop(c["max_depth"], c["min_samples_split"])), c["n_estimators"], i) for i, c in enumerate(candidates(grid))]
    known = F.broadcast(spark.createDataFrame(numbers, "rule long, stop long, trees int, candidate long"))
    rows = rows.join(known, ["rule", "stop", "trees"]).withColumnRenamed("part", "fold")
    if table.classes == 2:
        return auroc(rows.select("candidate", "fold", (F.col("label") == 1).alias("positive"), F.col("p1").alias("score")), "candidate", "fold").withColumnRenamed("auroc", "score")
    return rows.groupBy("candidate", "fold").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("score"))


def searched(spark: SparkSession, table: Table, fold: np.ndarray, test: np.ndarray, grid: dict, seed: int) -> tuple[dict, DataFrame]:
    """The best candidate over the folds of the other rows, and (row, label, prediction, probability) of the test rows by its forest on these."""
    train = np.flatnonzero(~test)
    inner = Table(table.ranks[train], table.values, table.first, table.label[train], table.classes)
    best = candidates(grid)[best_candidate(grid_scores(spark, inner, fold[train], grid, seed)).first().candidate]
    stop = Stop(best["max_depth"], best["min_samples_split"])
    rows = grown(spark, table, [(train, np.flatnonzero(test))], [best["max_features"]], [stop], [best["n_estimators"]], seed)
    return best, predicted(rows, table.classes).select("row", "label", "prediction", "probability")
