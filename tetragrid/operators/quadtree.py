"""Adaptive quadtree features: nodes split while their quadrants are not uniform.

A sequence's cells, sorted by their digits, are the leaves of the tree in order,
so each node is a stretch of them.  Counts that are dealt by id are sorted where
they are and folded level by level with sums over stretches; they are neither
multiplied by the levels nor shuffled again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.bases import critical_value, require_power_of_two, row_major, z_order
from .fcgr import Cells, cell_names, kmer_features, of_sequences, pooled

MAX_DEPTH, COMBINED_DEPTH, SPLIT_THRESHOLD, MIN_COUNT = 6, 4, 0.05, 8


def _heads(owner: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Where a stretch of equal (owner, node) begins."""
    return np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (node[1:] != node[:-1])))


def fold_leaves(owner: np.ndarray, cell: np.ndarray, count: np.ndarray, max_depth: int, crit: float, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, depth, node, count) of the leaves of cells sorted by (owner, cell); row is the leaf's first cell.

    Both sums of a level are over stretches of cells: the node's total, and the
    squares of its children's, which are the stretches one level down.
    """
    depth = np.full(len(cell), max_depth)
    open_ = np.ones(len(cell), bool)
    for d in range(max_depth):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        own, n = owner[at], count[at]
        child, node = cell[at] >> 2 * (max_depth - d - 1), cell[at] >> 2 * (max_depth - d)
        kids = _heads(own, child)
        kid = np.add.reduceat(n, kids)
        tops = _heads(own[kids], node[kids])
        total = np.add.reduceat(kid, tops)
        square = np.add.reduceat(kid * kid, tops)
        split = (total >= min_count) & (4.0 * square.astype(float) / total - total > crit)
        ends = np.repeat(~split, np.diff(kids[tops], append=len(at)))
        depth[at[ends]] = d
        open_[at[ends]] = False
    node = cell >> 2 * (max_depth - depth)
    heads = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1]) | (node[1:] != node[:-1])))
    return heads, depth[heads], node[heads], np.add.reduceat(count, heads)


def _cells(z: pa.Array, digits: int) -> np.ndarray:
    """Cells as numbers, from texts of so many digits."""
    z = z.cast(pa.string()) if not pa.types.is_string(z.type) else z
    text = np.frombuffer(z.buffers()[2], np.uint8)[z.offset * digits : (z.offset + len(z)) * digits].reshape(len(z), digits)
    out = np.zeros(len(z), np.int64)
    for j in range(digits):
        out = out << 2 | (text[:, j] - ord("0"))
    return out


def _nodes(node: np.ndarray, depth: np.ndarray) -> pa.Array:
    """Nodes as texts of their digits."""
    ends = np.concatenate([[0], np.cumsum(depth)])
    owner = np.repeat(np.arange(len(node)), depth)
    place = np.arange(ends[-1]) - ends[owner]
    text = ((node[owner] >> 2 * (depth[owner] - 1 - place) & 3) + ord("0")).astype(np.uint8)
    return pa.StringArray.from_buffers(len(node), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text))


def _fold(max_depth: int, crit: float, min_count: int, normalize: bool):
    """Rows (id, depth, node, value) of sorted rows (id, n, z, cnt); what is held is some batches, or the cells of one sequence."""

    def leaves(rows: pa.Table) -> pa.RecordBatch:
        ids, n = rows.column("id").combine_chunks(), rows.column("n").to_numpy()
        code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        owner = np.cumsum(np.append(0, (code[1:] != code[:-1]) | (n[1:] != n[:-1])))
        heads, depth, node, count = fold_leaves(owner, _cells(rows.column("z").combine_chunks(), max(max_depth, 1)) >> (2 if max_depth == 0 else 0), rows.column("cnt").to_numpy(), max_depth, crit, min_count)
        value = count.astype(float) / 4.0 ** (max_depth - depth)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(heads)), pa.array(depth.astype(np.int32)), _nodes(node, depth), pa.array(value / n[heads] if normalize else value)], ["id", "depth", "node", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            key = lambda b, i: (b.column(0)[i].as_py(), b.column(1)[i].as_py())
            if held and key(held[-1], -1) != key(batch, 0):
                yield leaves(pa.Table.from_batches(held))
                held = []
            last, cut = key(batch, len(batch) - 1), len(batch)
            if key(batch, 0) != last:  # the last sequence may go on in the next batch
                low, high = 0, len(batch) - 1
                while low < high:
                    middle = (low + high) // 2
                    low, high = (low, middle) if key(batch, middle) == last else (middle + 1, high)
                cut = low
                yield leaves(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield leaves(pa.Table.from_batches(held))

    return run


def qt_leaves(counts: DataFrame, max_depth: int = MAX_DEPTH, split_threshold: float = SPLIT_THRESHOLD, min_count: int = MIN_COUNT, *, normalize: bool = True) -> DataFrame:
    """(id, depth, node, value) of counts at max_depth; value is what each of the leaf's slots holds.  Empty leaves have no rows."""
    rows = counts.select("id", "n", "z", "cnt").repartition("id").sortWithinPartitions("id", "n", "z")
    fields = StructType([counts.schema["id"], *StructType.fromDDL("depth int, node string, value double").fields])
    return rows.mapInArrow(_fold(max_depth, critical_value(split_threshold), min_count, normalize), fields)


def sequence_leaves(seqs: DataFrame, max_depth: int = MAX_DEPTH, split_threshold: float = SPLIT_THRESHOLD, min_count: int = MIN_COUNT, *, normalize: bool = True, id_col: str = "doc_id", seq_col: str = "text") -> DataFrame:
    """(id, depth, node, value): the same leaves from the sequences, folded where their cells are counted."""
    return of_sequences(seqs, max(max_depth, 1), lambda cells: [_leaves(cells, max_depth, critical_value(split_threshold), min_count, normalize)], "depth int, node string, value double", id_col=id_col, seq_col=seq_col)


def _leaves(cells: Cells, max_depth: int, crit: float, min_count: int, normalize: bool) -> pa.RecordBatch:
    cell = cells.cell if max_depth else cells.cell >> 2
    heads, depth, node, count = fold_leaves(cells.owner, cell, cells.count, max_depth, crit, min_count)
    value = count.astype(float) / 4.0 ** (max_depth - depth)
    return cells.rows(heads, ("depth", pa.array(depth.astype(np.int32))), ("node", _nodes(node, depth)), ("value", pa.array(value / cells.lengths[cells.owner[heads]] if normalize else value)))


def qt_slots(leaves: DataFrame, max_depth: int) -> DataFrame:
    """(id, idx, value): each leaf spread over its slots in Z order."""
    stride = F.pow(F.lit(4.0), F.lit(max_depth) - F.col("depth")).cast("long")
    first = z_order(F.col("node")) * stride
    return leaves.select("id", F.explode(F.sequence(first, first + stride - 1)).alias("idx"), "value")


def dense(seqs: DataFrame, slots: DataFrame, size: int, *, id_col: str = "doc_id") -> DataFrame:
    """(id, value): all slots of every sequence in one array; one without bases holds zeros."""
    own = slots.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("at"))
    ids = seqs.select(F.col(id_col).alias("id"))
    joined = ids.join(own, ids["id"].eqNullSafe(own["id"]), "left").select(ids["id"], "at")
    every = F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))
    return joined.select("id", F.transform(every, lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0.0))).alias("value"))


def combined_features(counts: DataFrame, k: int, qt_max_depth: int = COMBINED_DEPTH, qt_split_threshold: float = SPLIT_THRESHOLD) -> DataFrame:
    """k-mer frequencies, then the quadtree's slots, from one table of counts at max(k, depth)."""
    kmer = kmer_features(pooled(counts, k), k)
    tree = qt_slots(qt_leaves(pooled(counts, qt_max_depth), qt_max_depth, qt_split_threshold), qt_max_depth)
    return kmer.unionByName(tree.select("id", (F.col("idx") + 4**k).alias("idx"), "value"))


def sequence_features(seqs: DataFrame, k: int, qt_max_depth: int = COMBINED_DEPTH, qt_split_threshold: float = SPLIT_THRESHOLD, *, id_col: str = "doc_id", seq_col: str = "text") -> DataFrame:
    """The same features from the sequences, in one pass: a count of a cell, or a leaf, is a row before leaves are spread over their slots."""
    deepest, crit = max(k, qt_max_depth, 1), critical_value(qt_split_threshold)

    def put_out(cells: Cells) -> Iterator[pa.RecordBatch]:
        own = cells.pooled(deepest - k)
        some = np.arange(len(own.cell))
        frequency = own.count / own.lengths[own.owner].astype(float)
        yield own.rows(some, ("depth", pa.nulls(len(some), pa.int32())), ("node", cell_names(own.cell, k)), ("value", pa.array(frequency)))
        yield _leaves(cells.pooled(deepest - max(qt_max_depth, 1)), qt_max_depth, crit, MIN_COUNT, True)

    rows = of_sequences(seqs, deepest, put_out, "depth int, node string, value double", id_col=id_col, seq_col=seq_col)
    stride = F.pow(F.lit(4.0), F.lit(qt_max_depth) - F.col("depth")).cast("long")
    first = z_order(F.col("node")) * stride + 4**k
    index = F.when(F.col("depth").isNull(), F.array(row_major(F.col("node"), k))).otherwise(F.sequence(first, first + stride - 1))
    return rows.select("id", F.explode(index).alias("idx"), "value")


def extract_adaptive_features(seqs: DataFrame, grid_size: int = 128, max_depth: int = MAX_DEPTH, split_threshold: float = SPLIT_THRESHOLD, min_count: int = MIN_COUNT, normalize: bool = True, *, id_col: str = "seq_id", seq_col: str = "seq") -> DataFrame:
    require_power_of_two(grid_size, max_depth)
    return qt_slots(sequence_leaves(seqs, max_depth, split_threshold, min_count, normalize=normalize, id_col=id_col, seq_col=seq_col), max_depth)


def extract_combined_features(seqs: DataFrame, k: int, grid_size: int = 128, qt_max_depth: int = COMBINED_DEPTH, qt_split_threshold: float = SPLIT_THRESHOLD, *, id_col: str = "seq_id", seq_col: str = "seq") -> DataFrame:
    require_power_of_two(grid_size, k)
    require_power_of_two(grid_size, qt_max_depth)
    return sequence_features(seqs, k, qt_max_depth, qt_split_threshold, id_col=id_col, seq_col=seq_col)
