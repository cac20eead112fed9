"""The registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, periodic_runs, pii_scan, secret_scan, source_mix, spelling, warc
from .html_layout import html_text
from .language_id import language_id
from .media import media_columns
from .ngram_join import ORACLE_SQL as NGRAM_SQL
from .ngram_join import ngram_jaccard_join
from .pieces import decode_pieces, encode_pieces, load_model
from .quality_rules import quality_rules
from .spans import digest_columns
from .workspace import Workspace, read


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(read(spark, sf_dir, "documents"))


#: A conversation whose texts look like the template's own marks.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat_format.chat_digests(chat_format.format_chats(rows.unionByName(more)))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(read(spark, sf_dir, "documents"))
    return digest_columns(found, "doc_id", secret_scan.KINDS, ("assign", "access", "hex"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(read(spark, sf_dir, "documents"))


def op5_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(read(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_scan.pii_scan(read(spark, sf_dir, "documents"))
    found = Workspace(spark, "pii-scan").save(found, "found")
    return digest_columns(found, "doc_id", pii_scan.KINDS, pii_scan.KINDS)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each document, and whether they spell the text again."""
    model = load_model(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = decode_pieces(encode_pieces(docs, model), model)
    ids = F.array_join(F.col("piece_ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(ids, 256).alias("pieces_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("same_text"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = media_columns(read(spark, sf_dir, "documents"))[1]
    return features.withColumn("shard", F.substring_index("shard", "/", -1))  # the folder is another one in each run


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.count_words(read(spark, sf_dir, "documents")))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.planted(read(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(docs))


QUERIES = (op1_source_mix, op2_chat_format, op3_secret_scan, op4_ngram_jaccard_join, op5_html_layout, op6_warc, op7_quality_rules, op8_pii_scan, op9_sentencepiece, op10_media_columns, op11_spelling_variants, op12_language_id, op13_periodic_runs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    extra = f"SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'"
    return {"op1_source_mix": source_mix.ORACLE_SQL, "op2_chat_format": chat_format.oracle_sql(extra), "op4_ngram_jaccard_join": NGRAM_SQL, "op6_warc": warc.ORACLE_SQL, "op11_spelling_variants": spelling.ORACLE_SQL, "op13_periodic_runs": periodic_runs.ORACLE_SQL}
