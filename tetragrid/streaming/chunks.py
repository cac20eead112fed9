"""Sequences that come in chunks, as streams and in batches, without ever holding a whole one.

The chunks of a sequence are numbered without gaps.  In a stream they may come
in any order over any number of triggers: those that are due are taken, the
others wait in the state, a bounded number of them for a bounded time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.bases import clean
from ..operators.fcgr import LOOK_BACK, cell_names, end_point, named_cells, walk, window_cells
from ..operators.point import PRECISION_BITS, point_bits
from ..operators.ranges import ranged

#: Chunks of one sequence that may wait for an earlier one.
MOST_WAITING = 1000

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which these operators need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class InOrder(StatefulProcessor):
    """Folds the chunks of a sequence in their order, whatever the order they come in.

    fold(own state, bases of the chunks that are due) gives the new state and the
    rows to put out.  A chunk whose number was passed, or waits already,
    is left out and counted as late.  Where more than `most` chunks wait, or the
    first has waited for `patience` milliseconds, the missing ones are given up:
    they are counted as gaps, and the walk goes on with what is there.
    """

    def __init__(self, fold: Callable, fields: str, start: tuple, first: int, patience: int | None, most: int):
        self.fold, self.fields, self.start, self.first, self.patience, self.most = fold, fields, start, first, patience, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"{self.fields}, due long, held long, gaps long, late long")
        self.waiting = handle.getMapState("waiting", "at long", "b string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        *own, due, held, gaps, late = self.state.get() or (*self.start, self.first, 0, 0, 0)
        fresh: dict[int, str] = {}
        for _, at, b in rows:
            if at < due or at in fresh or (held and self.waiting.containsKey((at,))):
                late += 1
            else:
                fresh[at] = b
        ready: list[str] = []
        due, held = self._take(ready, due, held, fresh)
        for at, b in fresh.items():
            self.waiting.updateValue((at,), (b,))
        held += len(fresh)
        while held > self.most:
            due, held, gaps = self._give_up(ready, due, held, gaps)
        yield from self._close(key, own, ready, due, held, gaps, late, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        *own, due, held, gaps, late = self.state.get()
        ready: list[str] = []
        if held:
            due, held, gaps = self._give_up(ready, due, held, gaps)
        yield from self._close(key, own, ready, due, held, gaps, late, timerValues)

    def _take(self, ready: list[str], due: int, held: int, fresh: dict[int, str]) -> tuple[int, int]:
        """Moves what is due to ready."""
        while True:
            if due in fresh:
                ready.append(fresh.pop(due))
            elif held and self.waiting.containsKey((due,)):
                ready.append(self.waiting.getValue((due,))[0])
                self.waiting.removeKey((due,))
                held -= 1
            else:
                return due, held
            due += 1

    def _give_up(self, ready: list[str], due: int, held: int, gaps: int) -> tuple[int, int, int]:
        first = min(k[0] for k in self.waiting.keys())  # noqa: SIM118
        return *self._take(ready, first, held, {}), gaps + first - due

    def _close(self, key: tuple, own: list, ready: list[str], due: int, held: int, gaps: int, late: int, times: TimerValues) -> list[Row]:
        own, out = self.fold(key[0], tuple(own), "".join(ready), gaps, late)
        self.state.update((*own, due, held, gaps, late))
        if self.patience is not None:
            timers = list(self.handle.listTimers())
            if held and (ready or not timers):
                for t in timers:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(times.getCurrentProcessingTimeInMs() + self.patience)
            elif not held:
                for t in timers:
                    self.handle.deleteTimer(t)
        return out


def _ordered(chunks: DataFrame, fold: Callable, fields: str, start: tuple, out: str, mode: str, id_col: str, order_col: str, seq_col: str, first: int, patience: int | None, most: int) -> DataFrame:
    # a chunk without a number is never due
    at = F.coalesce(F.col(order_col).cast("long"), F.lit(first - 1))
    rows = chunks.select(F.col(id_col).alias("id"), at.alias("at"), clean(F.col(seq_col)).alias("b"))
    kind = chunks.schema[id_col].dataType.simpleString()
    time = "None" if patience is None else "ProcessingTime"
    return rows.groupBy("id").transformWithState(InOrder(fold, fields, start, first, patience, most), f"id {kind}, {out}", mode, time)


def stream_final_point(chunks: DataFrame, precision: int = PRECISION_BITS, *, id_col: str = "conv_id", order_col: str = "turn", seq_col: str = "text", first: int = 0, patience: int | None = None, most: int = MOST_WAITING) -> DataFrame:
    """(id, tail, iterations, gaps, late) after each trigger that brought chunks, in update mode; `points` turns it into bits.

    The numbers of a sequence's chunks begin at `first`; patience is in
    milliseconds of processing time, None waits until too many do.  Patience is
    for queries that go on: with it Spark looks for timers again and again, so a
    trigger of what is available never ends.  The state is the last bases, how
    many came, and what waits.  To be started inside `state_store`.
    """

    def fold(name, own: tuple, bases: str, gaps: int, late: int) -> tuple[tuple, list[Row]]:
        tail, count = (own[0] + bases)[-precision:], own[1] + len(bases)
        return (tail, count), [Row(id=name, tail=tail, iterations=count, gaps=gaps, late=late)]

    return _ordered(chunks, fold, "tail string, iterations long", ("", 0), "tail string, iterations long, gaps long, late long", "update", id_col, order_col, seq_col, first, patience, most)


def points(states: DataFrame, precision: int = PRECISION_BITS) -> DataFrame:
    x, y = point_bits(F.col("tail"), precision)
    return states.select("id", F.lit(precision).alias("precision_bits"), x.alias("x_bits"), y.alias("y_bits"), "iterations")


def stream_cells(chunks: DataFrame, k: int, *, id_col: str = "conv_id", order_col: str = "turn", seq_col: str = "text", first: int = 0, patience: int | None = None, most: int = MOST_WAITING) -> DataFrame:
    """(id, z, cnt) that each trigger adds, in append mode: a sequence's counts are the sums by (id, z) of what was written.

    Chunks are taken as for the end point.  The state is the float64 point, the
    last bases before it, the point before these, and what waits; cells are
    counted by windows, and walked only near a run that can carry.
    """

    def fold(name, own: tuple, bases: str, gaps: int, late: int) -> tuple[tuple, list[Row]]:
        tail, x, y = own
        cells, counts = window_cells(bases, k, tail, (x, y))
        text = tail + bases
        if len(text) > 2 * LOOK_BACK:
            x, y = end_point(text[:-LOOK_BACK], x, y)
            text = text[-LOOK_BACK:]
        return (text, x, y), [Row(id=name, z=z, cnt=n) for z, n in zip(cell_names(cells, k).to_pylist(), counts.tolist(), strict=True)]

    return _ordered(chunks, fold, "tail string, x double, y double", ("", 0.5, 0.5), "z string, cnt long", "append", id_col, order_col, seq_col, first, patience, most)


def joined_chunks(chunks: DataFrame, *, id_col: str = "conv_id", order_col: str = "turn", seq_col: str = "text") -> DataFrame:
    """(id, seq): the batch form, each sequence's chunks in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("at"), clean(F.col(seq_col)).alias("b"))))
    return chunks.groupBy(F.col(id_col).alias("id")).agg(parts.alias("parts")).select("id", F.array_join(F.col("parts.b"), "").alias("seq"))


def _walk(k: int):
    """The float64 walk of sequences whose chunks come in order; what is held is the point and the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, own, found, kind = 2**k, None, Counter(), None

        def cells() -> pa.RecordBatch:
            names = named_cells(found, k)
            return pa.RecordBatch.from_arrays([pa.array([own[0]] * len(names), kind), pa.array(list(names), pa.string()), pa.array(list(names.values()), pa.int64())], ["id", "z", "cnt"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for cell, bases in zip(batch.column(0), batch.column(1), strict=True):
                if own != (name := (cell.as_py(),)):
                    if own:
                        yield cells()
                    own, found, x, y = name, Counter(), 0.5, 0.5
                x, y = walk(bases.as_py(), side, found, x, y)
        if own:
            yield cells()

    return run


def _window_counts(k: int):
    """Rows (id, z, cnt) of (id, before, b), the cells of each chunk; one with z null where the bases before it do not decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names, counts = [], [], []
            for row, (before, bases) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                found = window_cells(bases, k, before, None if len(before) >= LOOK_BACK else (0.5, 0.5))
                names.append(cell_names(found[0], k) if found else pa.nulls(1, pa.string()))
                counts.append(found[1] if found else np.zeros(1, np.int64))
                rows.append(np.full(len(counts[-1]), row))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.concat_arrays(names), pa.array(np.concatenate(counts))], ["id", "z", "cnt"])

    return run


def _before(rows: DataFrame, keep: int) -> DataFrame:
    """(id, at, b, before) of (id, at, b): the last bases of each sequence before each of its chunks, `keep` of them at most.

    Those of its range of (id, order) come by a window, those of earlier ranges
    by one row for each range.
    """
    rows = ranged(rows, "id", "at")
    inside = Window.partitionBy("_part", "id").orderBy("at", "b")
    ends = lambda col, over: F.right(F.array_join(F.collect_list(F.right(col, F.lit(keep))).over(over.rowsBetween(-keep, -1)), ""), F.lit(keep))
    placed = rows.withColumn("near", ends(F.col("b"), inside)).withColumn("nth", F.row_number().over(inside))
    tails = placed.groupBy("id", "_part").agg(F.max_by(F.right(F.concat("near", "b"), F.lit(keep)), "nth").alias("tail"))
    far = tails.select(F.col("id").alias("_id"), F.col("_part").alias("_at"), ends(F.col("tail"), Window.partitionBy("id").orderBy("_part")).alias("far")).where("far <> ''")  # at most one row for each range
    joined = placed.join(F.broadcast(far), F.col("id").eqNullSafe(F.col("_id")) & (F.col("_part") == F.col("_at")), "left")
    return joined.select("id", "at", "b", F.right(F.concat(F.coalesce("far", F.lit("")), "near"), F.lit(keep)).alias("before"))


def chunk_counts(chunks: DataFrame, k: int, *, id_col: str = "conv_id", order_col: str = "turn", seq_col: str = "text") -> DataFrame:
    """(id, z, cnt) of the sequences that the chunks make in order, without joining them.

    A chunk is counted where it is, with the last bases before it.  Only where
    these do not decide a run that can carry is the sequence walked in order.
    """
    rows = chunks.select(F.col(id_col).alias("id"), F.col(order_col).alias("at"), clean(F.col(seq_col)).alias("b")).where("b <> ''")
    kind = chunks.schema[id_col].dataType.simpleString()
    fields = f"id {kind}, z string, cnt long"
    found = _before(rows, LOOK_BACK).select("id", "before", "b").mapInArrow(_window_counts(k), fields)
    counts = found.groupBy("id", "z").agg(F.sum("cnt").alias("cnt"))
    open_ = counts.where("z is null").select(F.col("id").alias("_id"))
    same = F.col("id").eqNullSafe(F.col("_id"))
    walked = rows.join(open_, same, "left_semi").repartition("id").sortWithinPartitions("id", "at", "b").select("id", "b")
    return counts.join(open_, same, "left_anti").unionByName(walked.mapInArrow(_walk(k), fields))


def chunked_final_point(chunks: DataFrame, precision: int = PRECISION_BITS, *, id_col: str = "conv_id", order_col: str = "turn", seq_col: str = "text") -> DataFrame:
    """(id, precision_bits, x_bits, y_bits, iterations) of the sequences that the chunks make in order.

    A sequence's last chunks are those with fewer than `precision` bases after
    them: a suffix sum of base counts, by range of (id, order) and over the
    ranges, picks them, so at most `precision` + 1 chunks with bases are joined,
    however many a sequence has.  One without bases ends at the centre.
    """
    rows = chunks.select(F.col(id_col).alias("id"), F.col(order_col).alias("at"), clean(F.col(seq_col)).alias("b"))
    sizes = rows.groupBy("id").agg(F.sum(F.length("b")).cast("long").alias("iterations"))
    rows = ranged(rows.where("b <> ''").withColumn("n", F.length("b").cast("long")), "id", "at")
    later = Window.partitionBy("_part", "id").orderBy(F.desc("at"), F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("after", F.coalesce(F.sum("n").over(later), F.lit(0)))
    parts = rows.groupBy("id", "_part").agg(F.sum("n").alias("n"))
    beyond = Window.partitionBy("id").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    parts = parts.select(F.col("id").alias("_id"), F.col("_part").alias("_at"), F.coalesce(F.sum("n").over(beyond), F.lit(0)).alias("rest"))
    same = F.col("id").eqNullSafe(F.col("_id"))
    last = placed.join(F.broadcast(parts), same & (F.col("_part") == F.col("_at"))).where(F.col("after") + F.col("rest") < precision)
    tails = last.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", F.right("b", F.lit(precision)).alias("b")))).alias("parts"))
    tails = tails.select(F.col("id").alias("_id"), F.right(F.array_join("parts.b", ""), F.lit(precision)).alias("tail"))
    joined = sizes.join(tails, same, "left").select("id", F.coalesce("tail", F.lit("")).alias("tail"), "iterations")
    return points(joined, precision)
