"""Mixing sources to target weights by hash thresholds.

Each document has a hash of its id.  A source that is to give a share f of its
words gives the documents whose hash lies below a threshold, so the choice needs
no sort, a larger budget takes a superset, and reruns agree.  The threshold comes
from histograms: words by source and hash bucket; the bucket where the running
sum meets the budget is the boundary, and only the documents in it are counted
again, by the next bits, until the boundary holds one hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .places import Facts, column_of, placed, places
from .workspace import Workspace

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often.
MOST_REPEATS = 3
HASH_BITS, LEVEL_BITS = 60, 12
#: The plan has one row for each source; up to this many (some 10 MB) it is broadcast, beyond it joined by a shuffle of ids and sizes.
BROADCAST_SOURCES = 100_000
#: Rows that are repeated at a time.
TAKEN_ROWS = 1024


def hash60(id_: Column) -> Column:
    """Sixty bits of the id's MD5; a null id hashes as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: list[int], weights: list[int], most: int = MOST_REPEATS) -> list[float]:
    """Shares of all words by weight, none above `most` times its source's size; what is cut off goes to the others by weight."""
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    left, weight = sum(sizes), sum(weights)
    level = math.inf
    for i in order:
        if left / weight <= most * sizes[i] / weights[i]:
            level = left / weight
            break
        left -= most * sizes[i]
        weight -= weights[i]
    return [float(most * s) if most * s < w * level else w * level for s, w in zip(sizes, weights, strict=True)]


def _thresholds(docs: DataFrame, budgets: list[tuple[str | None, int, float]]) -> dict[str | None, int]:
    """For each source the hash below which its documents come nearest to its budget of words."""
    spark = docs.sparkSession
    open_ = {source: (0, need) for source, _, need in budgets if need > 0}
    found = {source: 0 for source, _, _ in budgets}
    left = HASH_BITS
    while open_:
        width = min(LEVEL_BITS, left)
        left -= width
        rows = [(source, prefix, float(need)) for source, (prefix, need) in open_.items()]
        state = spark.createDataFrame(rows, "source string, prefix long, need double")
        state = F.broadcast(state) if len(rows) <= BROADCAST_SOURCES else state
        near = docs.join(state, docs["source"].eqNullSafe(state["source"])).where(F.shiftright("hash", left + width) == F.col("prefix"))
        near = near.select(docs["source"], "size", "hash", "need", F.shiftright("hash", left).alias("bucket"))
        counted = near.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"), F.first("need").alias("need"))
        run = Window.partitionBy("source").orderBy("bucket")
        counted = counted.withColumn("upto", F.sum("words").over(run)).where("upto >= need")
        edge = counted.groupBy("source").agg(F.min(F.struct("bucket", "upto", "words", "low", "high")).alias("e")).select("source", "e.*")
        seen = {r.source: r for r in edge.collect()}
        following = {}
        for source, (prefix, need) in open_.items():
            if source not in seen:  # rounding: the budget is all that is left
                found[source] = (prefix + 1) << (left + width)
            elif seen[source].low == seen[source].high or not left:
                r = seen[source]
                inside = need - (r.upto - r.words)
                found[source] = r.low + (2 * inside >= r.words)
            else:
                r = seen[source]
                following[source] = (r.bucket, need - (r.upto - r.words))
        open_ = following
    return found


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs with the struct column mix: the row's source, size and hash."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumn("mix", F.struct(F.col(source_col).cast("string").alias("source"), size.alias("size"), hash60(F.col(id_col)).alias("hash")))


def _plan(docs: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """For each source its size, target, how often all its documents are taken, and below which hash once more."""
    sums = sorted(((r.source, r.words) for r in docs.groupBy("source").agg(F.sum("size").alias("words")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    wanted = targets([n for _, n in sums], [weights[i % len(weights)] for i in range(len(sums))], most) if sums else []
    whole = [min(most, int(t // n)) if n else 0 for (_, n), t in zip(sums, wanted, strict=True)]
    below = _thresholds(docs, [(s, n, t - k * n) for (s, n), t, k in zip(sums, wanted, whole, strict=True)])
    rows = [(s, n, t, k, below[s]) for (s, n), t, k in zip(sums, wanted, whole, strict=True)]
    plan = docs.sparkSession.createDataFrame(rows, "source string, source_size long, target double, whole int, below long")
    return F.broadcast(plan) if len(rows) <= BROADCAST_SOURCES else plan


def _repeats(hash_: Column, most: int) -> Column:
    return F.least(F.col("whole") + F.when(hash_ < F.col("below"), 1).otherwise(0), F.lit(most))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """How much of each document a mix of all sources takes.

    Returns id_col, size (words of the text, 0 for null), source_size and target
    (words of its source, and words that the mix takes of it), repeats, and taken
    (size times repeats).  Sources are weighted in order of code point, null
    last.  A source's taken words differ from its target by at most half the
    words that share one hash, that is, one document's.  Rows with the same id
    are taken or left together.  The driver holds one row for each source.
    Other columns are ignored, whatever their names; an empty table gives an
    empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    rows = _sized(rows, "id", "text", "source").select("id", "mix.source", "mix.size", "mix.hash")
    rows = Workspace(docs.sparkSession, "source-mix").save(rows, "sizes")
    plan = _plan(rows, weights, most)
    out = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).withColumn("repeats", _repeats(F.col("hash"), most))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The rows of docs, each as often as mix_sources takes it; all columns stay.

    No text is shuffled: sizes and hashes decide, and how often a row is taken is
    looked up by its place when the table is read again.  A null text or one
    without words has no size and is taken as often as its hash says; rows that
    repeat an id are taken or left together, null ids count as one id.  An empty
    table gives an empty one.
    """
    ws = Workspace(docs.sparkSession, "source-mix")
    whole = placed(docs, ws)
    rows = whole.select(column_of(whole, id_col).alias("id"), column_of(whole, text_col).alias("text"), column_of(whole, source_col).alias("source"), "file", "row")
    rows = ws.save(_sized(rows, "id", "text", "source").select("file", "row", "mix.source", "mix.size", "mix.hash"), "sizes")
    plan = _plan(rows, weights, most)
    taken = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).select("file", "row", _repeats(F.col("hash"), most).cast("long").alias("repeats")).where("repeats > 0")
    facts = Facts.save(taken, ws, "taken", rows.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, often = facts.find(*places(batch), "repeats")
            column = batch.column(0)
            for at in range(0, len(batch), TAKEN_ROWS):  # a row is repeated a few times at most
                own = np.repeat(np.arange(at, min(at + TAKEN_ROWS, len(batch))), often[at : at + TAKEN_ROWS])
                yield pa.RecordBatch.from_arrays([column.take(pa.array(own))], ["doc"])

    return whole.mapInArrow(run, StructType([whole.schema["doc"]])).select("doc.*")


#: The same rows from one sort for each source.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
  FROM documents),
s AS (
  SELECT source, n, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3)] AS w
  FROM (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source)),
o AS (
  SELECT *, (sum(n) OVER () - coalesce(sum(3 * n) OVER before, 0))::DOUBLE AS left_,
         (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS weight
  FROM s WINDOW before AS (ORDER BY 3 * n::DOUBLE / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT left_ / weight AS level FROM o WHERE left_ / weight <= 3 * n::DOUBLE / w ORDER BY 3 * n::DOUBLE / w LIMIT 1),
t AS (SELECT source, n, CASE WHEN 3 * n < w * level THEN (3 * n)::DOUBLE ELSE w * level END AS target FROM s, l),
k AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE least(3, floor(target / n)::BIGINT) END AS whole FROM t),
c AS (
  SELECT d.*, n, target, whole, target - whole * n AS need,
         sum(size) OVER (PARTITION BY d.source ORDER BY hash RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY d.source, hash) AS tied
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, n AS source_size, target, size * repeats AS taken, repeats::INTEGER AS repeats
FROM (SELECT *, least(3, whole + CASE WHEN need > 0 AND (upto < need OR (upto - tied < need AND 2 * (need - (upto - tied)) >= tied)) THEN 1 ELSE 0 END) AS repeats FROM c)
"""
