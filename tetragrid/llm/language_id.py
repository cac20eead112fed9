"""Language of a text by compression: the language whose dictionary makes the text smallest.

For each language a raw-content dictionary for zstandard is made of stretches of
texts that are labelled with it, chosen by hashes of their content.  A text is
compressed once with each dictionary, piece by piece, and the smallest total
names the language.  Where the margin to the next one is narrow, the answer is
kept but not accepted.

What is learned is bounded: a few hundred stretches of a language go to the
driver, and its dictionary is some kilobytes.  All texts are scored whole, where
they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of a language's dictionary, and of each stretch in it: the bound of the sample, with SAMPLE_TEXTS and STRETCH_CHARS.
DICTIONARY_BYTES, STRETCH_BYTES = 8192, 256
#: About so many texts of a language give a stretch of at most so many characters each.
SAMPLE_TEXTS, STRETCH_CHARS = 256, 600
#: More languages than this are an error: the dictionaries go to every task.
MAX_LANGUAGES = 1000
#: Bytes that are compressed at a time, and zstandard's level.
PIECE_BYTES, LEVEL = 2048, 6
#: A text of fewer bytes is compressed behind as many blanks.
SHORT_BYTES = 128
#: An answer is accepted from this margin on, as a share of the next smallest size.
MARGIN = 0.01
#: How fast a language's weight falls with the share by which it is larger than the smallest.
SHARPNESS = 100.0
UNKNOWN = "und"

_LETTERS = regex.compile(r"\p{L}+")


def letters(text: str | None) -> bytes:
    """The lower-cased runs of letters of a text, joined by spaces."""
    return " ".join(_LETTERS.findall((text or "").lower())).encode()


def dictionary(stretches: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    """The beginnings of the stretches, each from a whole word on, up to size bytes."""
    parts, left = [], size
    for text in stretches:
        part = letters(text.partition(" ")[2] or text)[: min(STRETCH_BYTES, left)]
        if part:
            parts.append(part)
            left -= len(part) + 1
        if left <= 0:
            break
    return b" ".join(parts)


def learn(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str) -> dict[str, bytes]:
    """The dictionary of each language of docs, the most frequent language first; rows without text or language teach nothing.

    Stretches are chosen, and placed, by a hash of the text, so that it does not
    matter how the table is cut, and equal texts count once.
    """
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    shares = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, SAMPLE_TEXTS / n))))
    rows = rows.withColumn("h", F.xxhash64("text")).where(F.expr("shiftrightunsigned(h, 11)") / F.lit(float(1 << 53)) < shares[F.col("lang")])
    start = F.expr(f"int(1 + pmod(xxhash64(h), greatest(1, length(text) - {STRETCH_CHARS})))")
    seen = rows.select("lang", "h", F.substring(F.col("text"), start, F.lit(STRETCH_CHARS)).alias("text")).distinct().collect()
    found: dict[str, list] = {lang: [] for lang in counts}
    for r in sorted(seen):
        found[r.lang].append(r.text)
    return {lang: d for lang in sorted(found, key=lambda lang: (-counts[lang], lang)) if (d := dictionary(found[lang]))}


class Judge:
    """The learned languages, ready to compress."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = list(dictionaries)
        self._coders = []
        for lang in self.languages:
            own = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            self._coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, data: bytes) -> np.ndarray:
        """The compressed size of the data for each language.

        A short text alone is stored as it is; behind blanks, which cost the same
        for each language, its matches count.
        """
        if len(data) < SHORT_BYTES:
            data = bytes(SHORT_BYTES) + data
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        return np.array([sum(len(coder(piece)) for piece in pieces) for coder in self._coders], np.int64)

    def of(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin and whether the margin is wide enough; ties go to the language learned from more texts."""
        data = letters(text)
        if not data or not self.languages:
            return UNKNOWN, 0.0, 0.0, False
        sizes = self.sizes(data)
        best = int(sizes.argmin())
        score = 1.0 / float(np.exp(-SHARPNESS * (sizes - sizes[best]) / sizes[best]).sum())
        if len(sizes) == 1:
            return self.languages[0], 1.0, 1.0, True
        second = int(np.partition(sizes, 1)[1])
        margin = (second - int(sizes[best])) / second
        return self.languages[best], score, margin, margin >= MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, margin, accepted) for each row of docs.

    The whole text is compressed.  lang_pred is the language of the smallest
    size (ties: the one learned from more texts), "und" for a null text, one without a
    letter, or where nothing was learned.  score, from 0 to 1, is the language's
    weight among all; margin the share that the next language is larger by;
    accepted is false below a margin of 1 %.  Ids may be null or repeat; other
    columns are ignored, whatever their names; an empty table gives an empty one.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(sent.value)
        for batch in batches:
            found = [judge.of(cell.as_py()) for cell in batch.column(1)]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "lang_pred", "score", "margin", "accepted"])

    fields = StructType([rows.schema["id"], *StructType.fromDDL("lang_pred string, score double, margin double, accepted boolean").fields])
    return rows.mapInArrow(run, fields).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: every fifth by the crc32 of its id; a null id counts as an empty text and is held out."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score, margin, accepted): learned from the rows that are not held out, applied to all."""
    learned = learn(docs.where(~held_out(id_col)), id_col=id_col, text_col=text_col, lang_col=lang_col)
    found = identify(docs, learned, id_col=id_col, text_col=text_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "margin", "accepted")
