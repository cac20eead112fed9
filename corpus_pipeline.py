"""A corpus pipeline: quality, near duplicates, secrets, source mix, pieces.

Each stage reads what the one before wrote as Parquet in the folder that driver
and executors share.  Every stage takes any table with the columns doc_id, text
and source, keeps all other columns, whatever their names, and gives an empty
table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tetragrid.llm.ngram_join import one_of_each
from tetragrid.llm.pieces import encode_pieces, load_model
from tetragrid.llm.quality_rules import filter_quality
from tetragrid.llm.secret_scan import mask_secrets
from tetragrid.llm.source_mix import mixed
from tetragrid.llm.workspace import Workspace, read
from tetragrid.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null text counts as empty and fails the base rules; rows with a null or a
    repeated id are judged each by its own text.
    """
    ship(spark)
    return filter_quality(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least id.

    Of rows that repeat the least id one stays, a null id only where all of its
    group have it; rows without words have no copies and all stay.
    """
    ship(spark)
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars, where the table has it, becomes the length of the text.

    All rows stay, whatever their ids; a null text stays null and keeps its n_chars.
    """
    ship(spark)
    out = mask_secrets(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Rows that repeat an id are taken or left together, and so are null ids; a
    null source is a source of its own; a row without words has no size and goes
    by its hash.
    """
    ship(spark)
    return mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids and how many these are; all rows stay, a null text has none.

    A table that has piece_ids or n_pieces already is an error.
    """
    ship(spark)
    if "n_pieces" in (c.lower() for c in docs.columns):
        raise ValueError("the table has a column n_pieces already")
    return encode_pieces(docs, load_model(spark)).withColumn("n_pieces", F.size("piece_ids").cast("long"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("source_mix", source_mix), ("pieces", pieces)]

#: The boosted trees, the near-duplicate graph and the piece search have no SQL form; tests/llm/test_pipeline.py holds run() against a chain of plain stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    workspace = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = workspace.save(stage(spark, docs, sf_dir), name)
    return docs
