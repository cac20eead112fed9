"""Labelled tasks and results as data sources.

`cgr_tasks` reads every task below a folder: a partition for each CSV part, a
record batch at a time.  `cgr_results` appends rows to a folder of CSV parts: a
task writes to a staging folder, and only a commit moves its part to where
readers look, so a write that fails or is killed adds nothing.

Both open files by URI with pyarrow; a store that only Spark can read is left to
`load_task` and Spark's own CSV writer.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pacsv
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

TASK_ROWS = "task string, split string, seq string, label_raw string"
#: Bytes of a part that are parsed at a time.
BLOCK_BYTES = 8 << 20
_SIDE = re.compile(r"(?:(.*)/)?(train|test)\.csv(?:/([^/_.][^/]*))?")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@dataclass
class Part(InputPartition):
    """One CSV part of one side of a task."""

    task: str
    split: str
    path: str


def parts_below(root: str) -> list[Part]:
    """The parts of every folder that has both sides, by task; a side is a file or a folder of parts."""
    system, top = opened(root)
    found: dict[str, list[Part]] = {}
    top = top.rstrip("/")
    for info in system.get_file_info(fs.FileSelector(top, recursive=True)):
        if info.is_file and (m := _SIDE.fullmatch(info.path[len(top) + 1 :])):
            found.setdefault(m[1] or ".", []).append(Part(m[1] or ".", m[2], info.path))
    return [p for task in sorted(found) if {p.split for p in found[task]} == {"train", "test"} for p in sorted(found[task], key=lambda p: (p.split, p.path))]


class TaskReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Part]:
        return parts_below(self.root)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.root)
        with system.open_input_stream(partition.path, compression=None) as file:
            try:
                first = pacsv.open_csv(file, read_options=pacsv.ReadOptions(block_size=BLOCK_BYTES), parse_options=pacsv.ParseOptions(newlines_in_values=True), convert_options=_as_text(system, partition.path))
            except pa.ArrowInvalid as problem:
                if "Empty CSV" in str(problem):
                    return
                raise
            for batch in first:
                seq, label = (batch.column(i).cast(pa.string()) for i in (0, 1))
                same = [pa.array([text] * len(batch), pa.string()) for text in (partition.task, partition.split)]
                yield pa.RecordBatch.from_arrays([*same, seq, label], ["task", "split", "seq", "label_raw"])


def _as_text(system: fs.FileSystem, path: str) -> pacsv.ConvertOptions:
    """All columns are text, and an empty one is null: only places count, names and what looks like a number do not."""
    with system.open_input_stream(path, compression=None) as file:
        head = io.TextIOWrapper(io.BytesIO(file.read(1 << 16)), "utf-8", errors="replace", newline="")
        names = next(csv.reader(head), [])
    return pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=False)


class TaskSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cgr_tasks"

    def schema(self) -> str:
        return TASK_ROWS

    def reader(self, schema: StructType) -> TaskReader:
        return TaskReader(self.options["path"])


@dataclass
class Staged(WriterCommitMessage):
    """A part that is complete but not yet to be seen; None if the task had no rows."""

    path: str | None


class ResultWriter(DataSourceWriter):
    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names, self.job = folder.rstrip("/"), names, uuid.uuid4().hex

    def _staging(self, path: str) -> str:
        return f"{path}/_staging/{self.job}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        system, top = opened(self.folder)
        path, out, lines = f"{self._staging(top)}/{uuid.uuid4().hex}.csv", None, None
        for row in iterator:
            if out is None:
                system.create_dir(self._staging(top), recursive=True)
                out = io.TextIOWrapper(system.open_output_stream(path, compression=None), "utf-8", newline="")
                lines = csv.writer(out)
                lines.writerow(self.names)
            lines.writerow(["" if v is None else v for v in row])
        if out is not None:
            out.close()
        return Staged(path if out is not None else None)

    def commit(self, messages: list[Staged | None]) -> None:
        system, top = opened(self.folder)
        for n, part in enumerate(m for m in messages if m is not None and m.path):
            system.move(part.path, f"{top}/part-{self.job}-{n:05d}.csv")
        self._clear(system, top)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*opened(self.folder))

    def _clear(self, system: fs.FileSystem, top: str) -> None:
        """What tasks left that were not committed; other jobs' staging stays."""
        if system.get_file_info(self._staging(top)).type != fs.FileType.NotFound:
            system.delete_dir(self._staging(top))


class ResultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cgr_results"

    def writer(self, schema: StructType, overwrite: bool) -> ResultWriter:
        if overwrite:
            raise ValueError("results are appended")
        return ResultWriter(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    for source in (TaskSource, ResultSource):
        spark.dataSource.register(source)
