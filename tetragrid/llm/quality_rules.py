"""Quality rules: boosted trees over document statistics, after two fixed rules.

One pass over the texts computes the statistics; the model is fitted on a
bounded sample of labelled rows of them and scores all rows from its flattened
node arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .boosted_trees import Forest, fit
from .workspace import Workspace

#: Labelled rows that the model is fitted on at most; they are those with the least hash of their id.  Their ids are broadcast, their statistics go to the driver.
TRAIN_ROWS = 20_000
#: The sample is cut between buckets of so many bits of the hash.
SAMPLE_BITS = 12
#: The model may reject at most this share of the labelled good rows, as measured on rows that a fold held out.
GOOD_REJECTED = 0.002
SYMBOLS = b"#*$%&|<>"
#: Statistic, and whether the kept probability may only rise (1) or fall (-1) in it.
FEATURES = (("word_length", 0), ("symbols", -1), ("dup_lines", -1), ("repeats", -1), ("capitals", -1), ("exclamations", -1), ("stutter", -1), ("distinct", 0), ("digits", -1), ("log_words", 0))
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_TALLIES = ("n_lines", "n_capitals", "n_letters", "n_exclamations", "n_stutter", "n_distinct", "n_digits")
_CLASS = {name: np.zeros(256, bool) for name in ("symbol", "follow", "capital", "letter", "exclamation", "digit")}
_CLASS["symbol"][list(SYMBOLS)] = True
_CLASS["follow"][128:192] = True
_CLASS["capital"][65:91] = True
_CLASS["letter"][65:91] = True
_CLASS["letter"][97:123] = True
_CLASS["exclamation"][33] = True
_CLASS["digit"][48:58] = True
WINDOW = 5


def _within(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set in each range of bounds."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items with a key and an owner: whether an equal one stands earlier, and whether there is any equal one."""
    keys = K.mix(keys ^ K.mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    later, either = np.empty(len(keys), bool), np.empty(len(keys), bool)
    later[order] = same[:-1]
    either[order] = same[:-1] | same[1:]
    return later, either


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts for each document data[offsets[d]:offsets[d+1]]."""
    w = K.words(data, offsets)
    docs = len(offsets) - 1
    owner = np.repeat(np.arange(docs), w.counts())
    tally = lambda name: _within(_CLASS[name][w.data], w.offsets)
    out = {"n_words": w.counts(), "n_symbols": tally("symbol"), "n_capitals": tally("capital"), "n_letters": tally("letter"), "n_exclamations": tally("exclamation"), "n_digits": tally("digit")}
    chars = np.diff(w.offsets) - tally("follow")
    out["word_chars"] = chars - _within(K.is_separator(w.data), w.offsets)
    hashes = w.hashes(lower=False)
    later, _ = _repeated(hashes, owner)
    out["n_distinct"] = out["n_words"] - _within(later, w.first)
    stutter = np.zeros(len(hashes), bool)
    stutter[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    out["n_stutter"] = _within(stutter, w.first)
    grams, bounds = K.shingles(hashes, w.first, WINDOW)
    gram_owner = np.repeat(np.arange(docs), np.diff(bounds))
    _, twice = _repeated(grams, gram_owner)
    at = np.flatnonzero(twice)
    word = w.first[gram_owner[at]] + at - bounds[gram_owner[at]]
    cover = np.zeros(len(hashes) + WINDOW + 1, np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + WINDOW, -1)
    out["n_repeat_words"] = _within(np.cumsum(cover)[: len(hashes)] > 0, w.first)
    start, end = K.lines(w.data, w.offsets)
    line_doc = np.searchsorted(w.offsets, start, side="right") - 1
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    later, _ = _repeated(K.segment_hashes(w.data, start, end)[worded], line_doc[worded])
    out["n_lines"] = np.bincount(line_doc[worded], minlength=docs)
    out["n_dup_lines"] = np.bincount(line_doc[worded][later], minlength=docs)
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    ratio = lambda a, b: s[a] / np.maximum(s[b], 1)
    return np.stack([ratio("word_chars", "n_words"), ratio("n_symbols", "n_words"), ratio("n_dup_lines", "n_lines"), ratio("n_repeat_words", "n_words"), ratio("n_capitals", "n_letters"), ratio("n_exclamations", "n_words"), ratio("n_stutter", "n_words"), ratio("n_distinct", "n_words"), ratio("n_digits", "word_chars"), np.log1p(s["n_words"])], 1)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.utf8(batch.column(1))
        for a, b in K.slices(offsets):
            s = statistics(data, offsets[a : b + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(s[c].astype(np.int64)) for c in _COUNTS + _TALLIES)], ["id", *_COUNTS, *_TALLIES])


def fit_verdict(x: np.ndarray, y: np.ndarray, good_rejected: float = GOOD_REJECTED, folds: int = 4) -> tuple[Forest, float, float]:
    """The model, the margin below which a row is rejected, and the accuracy on rows held out from their fold's model.

    The cut is where at most good_rejected of the held-out good rows fall below
    it, and never above even odds.
    """
    monotone = np.array([m for _, m in FEATURES])
    fold = np.arange(len(y)) % folds
    held = np.zeros(len(y))
    for f in range(folds):
        held[fold == f] = fit(x[fold != f], y[fold != f], monotone).margin(x[fold == f])
    good = np.sort(held[y == 1])
    cut = min(0.0, float(good[int(len(good) * good_rejected)]) if len(good) else 0.0)
    return fit(x, y, monotone), cut, float(((held >= cut) == (y == 1)).mean())


def _marks(labels: DataFrame, label_id: str, label_col: str) -> DataFrame:
    """(id, y) of the usable labels."""
    marks = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    return marks.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")


def _sample(labels: DataFrame, label_id: str, label_col: str, train_rows: int) -> DataFrame:
    """(id, y) of at most train_rows usable labels: all, or whole hash buckets of the id below a threshold, so the choice needs no sort."""
    marks = _marks(labels, label_id, label_col).withColumn("lot", F.shiftrightunsigned(F.xxhash64(F.col("id").cast("string")), 64 - SAMPLE_BITS))
    upto, least = 0, 0
    for lot, n in sorted((r.lot, r["count"]) for r in marks.groupBy("lot").count().collect()):
        upto += n
        least = lot + 1 if upto <= train_rows else least
    return marks.where(F.col("lot") < least).drop("lot")


def _model(stats: DataFrame, sample: DataFrame, good_rejected: float) -> tuple[Forest, float, float] | None:
    """The verdict fitted on the statistics of the sample's ids, of rows that repeat an id the least ones; None without labels of both kinds."""
    counts = F.struct(*_COUNTS, *_TALLIES)
    rows = stats.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min(counts).alias("s")).select(F.xxhash64(F.col("id").cast("string")).alias("lot"), "id", "y", "s.*")
    rows = rows.toPandas().sort_values(["lot", "id"])
    if rows.y.nunique() < 2:
        return None
    return fit_verdict(features({c: rows[c].to_numpy() for c in _COUNTS + _TALLIES}), rows.y.to_numpy(float), good_rejected)


def _kept(s: dict[str, np.ndarray], model: tuple[Forest, float, float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """base_failed, kept and margin."""
    failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
    margin = model[0].margin(features(s)) if model else None
    return failed, ~failed & ((margin >= model[1]) if model else True), margin


def quality_rules(docs: DataFrame, labels: DataFrame | None, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", train_rows: int = TRAIN_ROWS, good_rejected: float = GOOD_REJECTED) -> DataFrame:
    """Statistics and verdict for each row of docs.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (fewer than 10 words, or over a fifth of them in repeated
    five-word windows), kept, and margin (the model's log odds of good quality,
    null where there is no model).  A null text counts as empty and fails the
    base rules.  Labels with a null id or label, or whose id has two different
    labels, are not used; without labels of both kinds only the base rules
    decide.  Rows with the same id, or without one, are judged each by its own
    text; an empty table gives an empty one.  Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "quality-rules")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = ", ".join(f"{c} long" for c in _COUNTS + _TALLIES)
    stats = ws.save(docs.mapInArrow(_statistics, f"id {docs.schema['id'].dataType.simpleString()}, {counts}"), "stats")
    model = None if labels is None else _model(stats, _sample(labels, label_id, label_col, train_rows), good_rejected)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = {c: batch.column(i + 1).to_numpy() for i, c in enumerate(_COUNTS + _TALLIES)}
            failed, kept, margin = _kept(s, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i + 1) for i in range(len(_COUNTS))), pa.array(failed), pa.array(kept), pa.nulls(len(batch), pa.float64()) if margin is None else pa.array(margin)], ["id", *_COUNTS, "base_failed", "kept", "margin"])

    counts = ", ".join(f"{c} long" for c in _COUNTS)
    out = stats.mapInArrow(judge, f"id {docs.schema['id'].dataType.simpleString()}, {counts}, base_failed boolean, kept boolean, margin double")
    return out.withColumnRenamed("id", id_col)


def filter_quality(docs: DataFrame, labels: DataFrame | None, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", train_rows: int = TRAIN_ROWS, good_rejected: float = GOOD_REJECTED) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns.

    The texts are not shuffled: a first pass picks the texts of the labelled
    sample, whose ids are broadcast, and computes their statistics; a second one
    judges every row where it is read.  Nulls, ties and rows that repeat an id are
    treated as quality_rules does.
    """
    model = None
    if labels is not None:
        kind = docs.schema[id_col].dataType.simpleString()
        sample = _sample(labels, label_id, label_col, train_rows)
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample.select("id")), "id", "left_semi")
        stats = texts.mapInArrow(_statistics, f"id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS + _TALLIES))
        model = _model(stats, sample, good_rejected)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column(place))
            for a, b in K.slices(offsets):
                _, kept, _ = _kept(statistics(data, offsets[a : b + 1]), model)
                yield batch.slice(a, b - a).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
