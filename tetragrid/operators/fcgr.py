"""Chaos-game counts: a cell's count is how often its k bases end a prefix of the sequence.

The counts are windows over a padded string, taken where the sequences of an id
meet; only (id, bases) is shuffled.  Only the bases around a run long enough to
carry in float64 are walked one by one.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import carry_pattern, clean, padding, require_power_of_two, row_major


def walk(bases: str, side: int, found: Counter, x: float = 0.5, y: float = 0.5) -> tuple[float, float]:
    """Adds the cells of the float64 walk from a point and gives its end; a coordinate that rounds to 1 stays in the last row or column."""
    for base in bases:
        x, y = (x + (base in "CG")) / 2, (y + (base in "GT")) / 2
        found[min(int(x * side), side - 1), min(int(y * side), side - 1)] += 1
    return x, y


def named_cells(found: Counter, k: int) -> Counter:
    return Counter({"".join(str(2 * (i >> j & 1) + (j2 >> j & 1)) for j in range(k - 1, -1, -1)): n for (i, j2), n in found.items()})


#: Bases that are looked back on first for a point of the float64 walk; then four times as many, and so on.
LOOK_BACK = 128


def _path(bases: str, x: float, y: float) -> Iterator[tuple[float, float]]:
    for base in bases:
        x, y = (x + (base in "CG")) / 2, (y + (base in "GT")) / 2
        yield x, y


def end_point(bases: str, x: float = 0.5, y: float = 0.5) -> tuple[float, float]:
    """The end of the float64 walk over the bases from a point, from the last of them wherever these decide it.

    A step keeps the order of points, so where the walks from 0 and from 1 meet,
    all walks do.
    """
    back = LOOK_BACK
    while back < len(bases):
        tail = bases[-back:]
        low, high = ((0.0, 0.0), (1.0, 1.0))
        for low, high in zip(_path(tail, *low), _path(tail, *high), strict=True):  # noqa: B020
            pass
        if low == high:
            return low
        back *= 4
    for x, y in _path(bases, x, y):  # noqa: B020
        pass
    return x, y


def carried_cells(bases: str, first: int, last: int, k: int, start: tuple[float, float] | None) -> np.ndarray | None:
    """The cells, as numbers, of the float64 walk after each of bases[first:last].

    The walk is begun so far before them that walks from 0 and from 1 give the
    same cells.  start is the point before all bases; without it, None is the
    answer where the bases do not decide.
    """
    side, back = 2**k, LOOK_BACK
    cell = lambda v: min(int(v * side), side - 1)
    while True:
        begin = max(0, first - back)
        exact = begin == 0 and start is not None
        low, high = (start, start) if exact else ((0.0, 0.0), (1.0, 1.0))
        part, skip = bases[begin:last], first - begin
        cells = [(cell(x), cell(y)) for x, y in itertools.islice(_path(part, *low), skip, None)]
        if exact or cells == [(cell(x), cell(y)) for x, y in itertools.islice(_path(part, *high), skip, None)]:
            xy = np.array(cells, np.int64).reshape(-1, 2)
            places = np.arange(k)
            return ((xy[:, :1] >> places & 1) * 2 + (xy[:, 1:] >> places & 1) << 2 * places).sum(1)
        if begin == 0:
            return None
        back *= 4


#: Bases whose windows are counted at once.
STRETCH = 1 << 22
_DIGIT = np.zeros(256, np.int64)
_DIGIT[list(b"ATCG")] = range(4)


def _summed(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cells, place = np.unique(cells, return_inverse=True)
    counts = np.bincount(place, counts, len(cells)).astype(np.int64)
    return cells[counts != 0], counts[counts != 0]


def _distinct(cells: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells that occur, in order, and how often; few possible ones are counted in a table."""
    if 4**k > max(len(cells), 1 << 8):
        return np.unique(cells, return_counts=True)
    counts = np.bincount(cells)
    found = np.flatnonzero(counts)
    return found, counts[found]


def window_cells(bases: str, k: int, before: str = "", start: tuple[float, float] | None = (0.5, 0.5)) -> tuple[np.ndarray, np.ndarray] | None:
    """Cells, as numbers of k base-4 digits, and their counts over bases, which follow on the bases before; start is the point before both.

    A cell is that of the last k bases but for those within reach of a run that
    can carry: there the float64 walk is taken up again a bounded way before.  A
    long sequence is taken in stretches that overlap by k - 1 bases.  None if a
    run is not decided by what is known, which needs an unknown start.
    """
    text = before + bases
    codes = _DIGIT[np.frombuffer(((padding(k) + text)[-(len(bases) + k - 1) :] if k > 1 else bases).encode(), np.uint8)] if bases else np.zeros(0, np.int64)
    cells, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(begin: int, end: int) -> np.ndarray:
        value = np.zeros(end - begin, np.int64)
        for back in range(k):
            value += codes[begin + k - 1 - back : end + k - 1 - back] << 2 * (k - 1 - back)
        return value

    for at in range(0, len(bases), STRETCH):
        more, n = _distinct(of(at, min(at + STRETCH, len(bases))), k)
        cells, counts = _summed(np.concatenate([cells, more]), np.concatenate([counts, n])) if at else (more, n)
    done = len(before)
    for first, last in sorted((run.start(), min(len(text), run.end() + k + 1)) for axis in _carries(k) for run in axis.finditer(text)):
        first = max(first, done)
        if first < last:
            own = carried_cells(text, first, last, k, start)
            if own is None:
                return None
            plain = of(first - len(before), last - len(before))
            cells, counts = _summed(np.concatenate([cells, own, plain]), np.concatenate([counts, np.ones(len(own)), -np.ones(len(plain))]))
            done = last
    return cells, counts


@functools.cache
def _carries(k: int) -> list[re.Pattern]:
    """For each axis the runs that can carry; those of different axes may share bases."""
    return [re.compile(axis) for axis in carry_pattern(k).split("|")]


def cell_names(cells: np.ndarray, k: int) -> pa.Array:
    """The digits of each cell as text."""
    places = 2 * np.arange(k - 1, -1, -1)
    text = ((cells[:, None] >> places & 3) + ord("0")).astype(np.uint8)
    return pa.StringArray.from_buffers(len(cells), pa.py_buffer((np.arange(len(cells) + 1) * k).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text)))


#: Cells that a task puts together before it puts out a batch.
HELD_CELLS = 1 << 20


@dataclass
class Cells:
    """Cells of some sequences in order: owner is a sequence's place in ids and lengths; cell, a number of k digits, rises inside it."""

    ids: pa.Array
    lengths: np.ndarray
    owner: np.ndarray
    cell: np.ndarray
    count: np.ndarray

    def rows(self, at: np.ndarray, *columns: tuple[str, pa.Array]) -> pa.RecordBatch:
        """The columns, with the ids of the cells at these places."""
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(self.owner[at])), *(c for _, c in columns)], ["id", *(n for n, _ in columns)])

    def pooled(self, digits: int) -> Cells:
        """The cells of a coarser grid, by taking so many digits off the end."""
        cell = self.cell >> 2 * digits
        heads = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (self.owner[1:] != self.owner[:-1])))
        return Cells(self.ids, self.lengths, self.owner[heads], cell[heads], np.add.reduceat(self.count, heads))


def _sequences(k: int, put_out: Callable[[Cells], Iterable[pa.RecordBatch]]):
    """What put_out makes of the cells of sequences (id, bases) that are sorted by id and length; rows that share both are one sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        lengths, cells, counts, held, key = [], [], [], 0, None

        def of() -> Cells:
            size = list(map(len, cells))
            return Cells(pa.concat_arrays(ids), np.array(lengths, np.int64), np.repeat(np.arange(len(size)), size), np.concatenate(cells), np.concatenate(counts))

        for batch in batches:
            names = batch.column(0)
            for row, (name, bases) in enumerate(zip(names.to_pylist(), batch.column(1), strict=True)):
                bases = bases.as_py()
                name = name if name == name else "NaN"
                own, n = window_cells(bases, k)
                if key == (name, len(bases)):
                    held -= len(cells[-1])
                    cells[-1], counts[-1] = _summed(np.concatenate([cells[-1], own]), np.concatenate([counts[-1], n]))
                else:
                    if held >= HELD_CELLS:
                        yield from put_out(of())
                        ids, lengths, cells, counts, held = [], [], [], [], 0
                    key = name, len(bases)
                    ids.append(names.take(pa.array([row])))  # a slice would keep the whole batch
                    lengths.append(len(bases))
                    cells.append(own)
                    counts.append(n)
                held += len(cells[-1])
        if ids:
            yield from put_out(of())

    return run


def of_sequences(seqs: DataFrame, k: int, put_out: Callable[[Cells], Iterable[pa.RecordBatch]], fields: str, *, id_col: str, seq_col: str) -> DataFrame:
    """(id, fields) that put_out makes of the cells of each sequence, dealt by id.

    The bases are dealt and sorted, not the cells: a task holds the bases of its
    share, which can spill, and the cells of some sequences.
    """
    rows = seqs.select(F.col(id_col).alias("id"), clean(F.col(seq_col)).alias("b")).where("b <> ''")
    rows = rows.withColumn("n", F.length("b")).repartition("id").sortWithinPartitions("id", "n").select("id", "b")
    kind = seqs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_sequences(k, put_out), f"id {kind}, {fields}")


def _checked(k: int) -> None:
    if not 1 <= k <= 26:
        raise ValueError(f"k must be 1 to 26, not {k}")


def fcgr_counts(seqs: DataFrame, k: int, *, at: int | None = None, id_col: str = "doc_id", seq_col: str = "text") -> DataFrame:
    """(id, n, z, cnt), dealt by id: bases of the sequence, a cell's digits and its count; empty cells and sequences have no rows.

    A null sequence is empty.  Rows that repeat an id and have as many bases are
    counted together.  With `at`, the counts at k are pooled to this coarser k
    where they are made.
    """
    _checked(k)
    at = k if at is None else at
    if not 1 <= at <= k:
        raise ValueError(f"counts at {k} cannot be pooled to {at}")

    def put_out(cells: Cells) -> Iterator[pa.RecordBatch]:
        own = cells.pooled(k - at) if at < k else cells
        yield own.rows(np.arange(len(own.cell)), ("n", pa.array(own.lengths[own.owner])), ("z", cell_names(own.cell, at)), ("cnt", pa.array(own.count)))

    return of_sequences(seqs, k, put_out, "n long, z string, cnt long", id_col=id_col, seq_col=seq_col)


def pooled(counts: DataFrame, k: int) -> DataFrame:
    """The counts of a coarser grid: sums by the first k digits."""
    return counts.groupBy("id", "n", F.substring("z", 1, k).alias("z")).agg(F.sum("cnt").alias("cnt"))


def kmer_features(counts: DataFrame, k: int, *, normalize: bool = True) -> DataFrame:
    """(id, idx, value) of counts at k: row-major cell and its frequency, or its raw count."""
    value = F.col("cnt").cast("double")
    return counts.select("id", row_major(F.col("z"), k).alias("idx"), (value / F.col("n") if normalize else value).alias("value"))


def feature_info(k: int) -> dict:
    return {"type": "kmer", "k": k, "dimensions": 4**k}


def extract_kmer_features(seqs: DataFrame, k: int, grid_size: int = 128, *, id_col: str = "seq_id", seq_col: str = "seq") -> DataFrame:
    """Always normalised; the grid's size only bounds k."""
    require_power_of_two(grid_size, k)
    return kmer_features(fcgr_counts(seqs, k, id_col=id_col, seq_col=seq_col), k)


def sparse_arrays(seqs: DataFrame, features: DataFrame, *, id_col: str = "seq_id") -> DataFrame:
    """seqs with indices and values, sorted by index; a sequence without bases has empty arrays."""
    own = features.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("cells"))
    joined = seqs.join(own, seqs[id_col].eqNullSafe(own["id"]), "left")
    take = lambda f, kind: F.coalesce(F.col("cells").getField(f), F.array().cast(f"array<{kind}>")).alias("indices" if f == "idx" else "values")
    return joined.select(*[seqs[c] for c in seqs.columns], take("idx", "bigint"), take("value", "double"))
