"""Rows of a table of files, addressed by their place: the file, by a hash of its path, and the row's number in it.

Facts about rows are kept in the shared folder, in buckets of spans: a span is a
fixed number of rows of a file.  A task that reads the table again fetches the
facts about the spans it meets, one at a time, so rows are picked, passed over
or annotated where they stand, however the files are split: no text is shuffled
and nothing that grows with the table is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import opened
from .workspace import Workspace

#: Rows of a span, and rows of the table that a bucket of facts stands for, on the average.
SPAN_ROWS, BUCKET_ROWS = 4096, 1 << 16
#: Spans of a file lie this many buckets apart.
_STEP = 7919


def place() -> Column:
    return F.struct("file", "row")


def _scans_files(docs: DataFrame) -> bool:
    """Whether docs is one scan of files with nothing but projections and filters on it."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "_metadata" not in (c.lower() for c in docs.columns)


def placed(docs: DataFrame, ws: Workspace) -> DataFrame:
    """(doc, file, row): each row as a struct, and its place; a table that is no plain scan of Parquet files is copied to the workspace first."""
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    place = (F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    if _scans_files(docs):
        try:
            return docs.select(doc, *place)
        except AnalysisException:  # files of another format number no rows
            pass
    return ws.save(docs.select(doc), "copy").select("doc", *place)


def column_of(whole: DataFrame, name: str) -> Column:
    """A column of the rows of placed(), its name in any case."""
    fields = whole.schema["doc"].dataType.fields
    return F.col("doc").getField(next(f.name for f in fields if f.name.lower() == name.lower()))


class Facts:
    """A table with columns file and row, as tasks see it: the rows of one span at a time, in order of row."""

    def __init__(self, path: str, buckets: int, schema: pa.Schema):
        self.path, self.buckets, self.schema, self._span, self._rows = path, buckets, schema, None, None

    @staticmethod
    def save(df: DataFrame, ws: Workspace, name: str, rows: int, *order: str, each: int = BUCKET_ROWS) -> Facts:
        """Facts about a table of so many rows, each bucket about `each` of them."""
        buckets = max(1, rows // each)
        bucket = F.expr(f"int(pmod(pmod(file, {buckets}L) + pmod(span * {_STEP}L, {buckets}L), {buckets}L))")
        out = df.withColumn("span", F.expr(f"row div {SPAN_ROWS}L")).withColumn("bucket", bucket)
        out = out.repartition("bucket").sortWithinPartitions("bucket", "file", "span", "row", *order)
        path = f"{ws.base}/{name}"
        out.write.partitionBy("bucket").option("compression", "zstd").parquet(path)
        from pyspark.sql.pandas.types import to_arrow_schema

        return Facts(path, buckets, to_arrow_schema(df.schema))

    def of(self, file: int, row: int) -> pa.Table:
        """The facts of the span of a row."""
        span = row // SPAN_ROWS
        if (file, span) != self._span:
            system, path = opened(f"{self.path}/bucket={(file % self.buckets + span * _STEP % self.buckets) % self.buckets}")
            if system.get_file_info(path).type.name == "NotFound":
                self._rows = self.schema.empty_table()
            else:
                self._rows = pq.read_table(path, filesystem=system, filters=[("file", "=", file), ("span", "=", span)], columns=self.schema.names, partitioning=None).sort_by("row")
            self._span = file, span
        return self._rows

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_span": None, "_rows": None}

    def holds(self, file: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Which of some places the table has."""
        return self.find(file, row, "row")[0]

    def find(self, file: np.ndarray, row: np.ndarray, column: str) -> tuple[np.ndarray, np.ndarray]:
        """Which of some places the table has, and a whole-number column there, 0 elsewhere."""
        found, values = np.zeros(len(file), bool), np.zeros(len(file), np.int64)
        for a, b in stretches(file, row // SPAN_ROWS):
            facts = self.of(int(file[a]), int(row[a]))
            known = facts.column("row").to_numpy()
            if len(known):
                at = np.minimum(np.searchsorted(known, row[a:b]), len(known) - 1)
                found[a:b] = known[at] == row[a:b]
                values[a:b] = np.where(found[a:b], facts.column(column).to_numpy()[at], 0)
        return found, values


def stretches(*keys: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of rows in which no key changes."""
    if not len(keys[0]):
        return []
    starts = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))).tolist()
    return list(zip(starts, [*starts[1:], len(keys[0])], strict=True))


def places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(pc.cast(batch.column(c), pa.int64()).to_numpy() for c in ("file", "row"))
