"""SentencePiece encoding and decoding of whole texts by unigram Viterbi.

The model file is read once by the driver; what is broadcast is the double array
and the scores, bounded by the vocabulary.  Encoding and decoding work on slices
of a quarter of a megabyte, so memory does not grow with a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textkernel as K
from .piece_model import PieceModel

#: The public tokenizers' folder; it is never copied.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def load_model(spark: SparkSession, path: str = MODEL) -> PieceModel:
    """Reads a model file: a plain path on the driver, a URI through Spark."""
    if "://" in path:
        return PieceModel.load(bytes(spark.read.format("binaryFile").load(path).select("content").first().content))
    with open(path, "rb") as file:
        return PieceModel.load(file.read())


def _put(batch: pa.RecordBatch, a: int, b: int, column: pa.Array, name: str) -> pa.RecordBatch:
    part = batch.slice(a, b - a)
    return pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, name])


def encode_pieces(docs: DataFrame, model: PieceModel, *, text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """docs with ids_col, the ids of each text's pieces; every other column stays.

    A null or empty text has no ids.  A character without a piece is spelled in
    bytes.  Of segmentations of equal score the one whose last piece starts
    earliest wins.  Each row is cut by its own text, whatever its id: null and
    repeated ones are rows like others; an empty table gives an empty one.
    """
    _new(docs, ids_col)
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column(place))
            for a, b in K.slices(offsets):
                ids, bounds = shared.value.encode(data, offsets[a : b + 1])
                yield _put(batch, a, b, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32())), ids_col)

    return docs.mapInArrow(run, _schema(docs, f"{ids_col} array<int>"))


def decode_pieces(docs: DataFrame, model: PieceModel, *, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """docs with out_col, the text that each row's ids spell; null ids give an empty text, and null or unknown ids in a list an error."""
    _new(docs, out_col)
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(place)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            size = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            at = np.concatenate([[0], np.cumsum(size)])
            for a, b in K.slices(at, K.SLICE_BYTES // 4):
                text, offsets = shared.value.decode(ids[at[a] : at[b]].astype(np.int64), at[a : b + 1] - at[a])
                texts = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text)))
                yield _put(batch, a, b, texts.cast(pa.string()), out_col)

    return docs.mapInArrow(run, _schema(docs, f"{out_col} string"))


def _new(docs: DataFrame, name: str) -> None:
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the table has a column {name} already: name another")


def _schema(docs: DataFrame, more: str):
    from pyspark.sql.types import StructType

    return StructType([*docs.schema.fields, *StructType.fromDDL(more).fields])
