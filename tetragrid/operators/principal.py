"""Principal components of sparse features, by subspace iteration.

What is iterated is a block of directions, one row for each slot.  Every step is
one pass over the rows: a task multiplies its sparse rows with the block and
back, and gives a partial sum for each slot.  Centring is implicit: the mean's
part is taken off the sum.  The driver holds a few numbers for each slot and
nothing for any row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directions beyond those asked for, which speed the iteration up; steps at most; and when loadings count as settled.
SPARE, STEPS, SETTLED = 8, 300, 1e-10
#: The most numbers of a block, which goes to every task.
BLOCK = 1 << 24


def _product(block: np.ndarray):
    """Rows (idx, sums): for each slot the sum over a task's rows (indices, values) of its value times the row's product with the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros(block.shape), np.zeros(len(block), bool)
        for batch in batches:
            size = np.diff(batch.column(0).offsets.to_numpy())
            index, value = (c.flatten().to_numpy() for c in batch.columns)
            row = np.repeat(np.arange(len(size)), size)
            used[index] = True
            for j in range(block.shape[1]):
                scores = np.bincount(row, value * block[index, j], len(size))
                total[:, j] += np.bincount(index, value * scores[row], len(block))
        at = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(total[at]), pa.list_(pa.float64()))], ["idx", "sums"])

    return run


def principal_components(arrays: DataFrame, size: int, components: int = 2) -> DataFrame:
    """(component, idx, loading, variance, share) from rows with sparse indices and values below size; the largest loading of each is positive.

    variance is that of the rows along the component, share its part of all.
    Components are numbered from 0; there are as many as the rows span at most.
    """
    width = min(size, components + SPARE)
    if size * width > BLOCK:
        raise ValueError(f"{size} slots are too many for {components} components")
    spark = arrays.sparkSession
    rows = arrays.select("indices", "values").persist()
    entry = F.explode(F.arrays_zip("indices", "values")).alias("e")
    sums = rows.select(entry).groupBy("e.indices").agg(F.sum("e.values").alias("s"), F.sum(F.col("e.values") * F.col("e.values")).alias("ss")).collect()
    n, mean = rows.count(), np.zeros(size)
    mean[[r.indices for r in sums]] = [r.s / max(n, 1) for r in sums]
    whole = sum(r.ss for r in sums) / max(n, 1) - mean @ mean
    block, last = np.linalg.qr(np.random.default_rng(1).standard_normal((size, width)))[0], None
    parts = ", ".join(f"sum(sums[{j}])" for j in range(width))
    for _ in range(STEPS if n else 0):
        got = rows.mapInArrow(_product(block), "idx long, sums array<double>").groupBy("idx").agg(F.expr(f"array({parts})").alias("sums")).collect()
        out = np.zeros(block.shape)
        for r in got:
            out[r.idx] = r.sums
        out = out / n - np.outer(mean, mean @ block)
        values, turn = np.linalg.eigh(block.T @ out)
        values, turn = values[::-1], turn[:, ::-1]
        now = (block @ turn)[:, :components]
        now = now * np.where(now[np.abs(now).argmax(0), np.arange(now.shape[1])] < 0, -1, 1)
        if last is not None and np.abs(now - last).max() < SETTLED:
            break
        last, block = now, np.linalg.qr(out @ turn)[0]
    rows.unpersist()
    found = [] if last is None else [(j, i, float(now[i, j]), float(values[j]), float(values[j] / whole)) for j in range(now.shape[1]) if values[j] > 1e-15 for i in range(size)]
    return spark.createDataFrame(found, "component long, idx long, loading double, variance double, share double")
