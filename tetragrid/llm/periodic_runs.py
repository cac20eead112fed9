"""Periodic runs of words: stretches that repeat themselves, by divide and conquer (Main and Lorentz, 1984).

A run is a stretch of words with a smallest period q that holds two periods at
least and that no neighbouring word extends.  A text's words are interned, and
the line of ids is halved again and again.  At each midpoint two Z-functions
give, for every period at once, how far the comparison of the line with itself
reaches to both sides; where both reaches together come up to the period, a
repetition crosses the midpoint.  Of what is found those stay that no word
extends; of equal intervals the smallest period stays.

A piece of the line is halved on only where it can hold a run: a run of twelve
words or more has six words that stand again a period later, so a piece without
six words that occur twice in it has none.  Within a run of a period so short
that no other run fits, nothing is searched again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A run has this many words and two periods at least.
MIN_LENGTH = 12

_ODD = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def interned(words: list[bytes]) -> np.ndarray:
    """The number of each word, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def z_function(t: np.ndarray) -> np.ndarray:
    """For each place of t, how many items from there on are those at the start of t; 0 for the first place.

    Places whose item is not the first one have 0 and are never visited; matches
    are extended by blocks that double.
    """
    n = len(t)
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(t[1:] == t[0]) + 1
    if not len(at):
        return out
    items, z = t.tolist(), {}
    left = right = 0
    for i in at.tolist():
        k = 0
        if i < right:
            k = z.get(i - left, 0)
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        stop = min(n, i + k + 8)
        while i + k < stop and items[k] == items[i + k]:
            k += 1
        if i + k == stop < n:
            size = 16
            while i + k < n:
                size = min(size, n - i - k)
                apart = t[k : k + size] != t[i + k : i + k + size]
                first = int(apart.argmax())
                if apart[first]:
                    k += first
                    break
                k, size = k + size, 2 * size
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    out[at] = [z[i] for i in at.tolist()]
    return out


def _crossing(s: np.ndarray, lo: int, mid: int, hi: int) -> list[tuple[int, int, int]]:
    """(start, end, least period) of the repetitions of s[lo:hi] that reach over or to mid, as far as they go within it."""
    u, v, gap = s[lo:mid], s[mid:hi], np.array([-1])
    on = z_function(np.concatenate([v, gap, u, v]))  # how far what begins at a place goes on as what begins at mid
    back = z_function(np.concatenate([u[::-1], gap, v[::-1], u[::-1]]))  # the same to the left
    nu, nv = len(u), len(v)
    p = np.arange(1, nv + 1)
    after = np.append(on[nv + 1 + nu + 1 :], 0)
    before = back[nu + 1 + nv - p]
    q = np.arange(1, nu + 1)
    after_left = on[nv + 1 + nu - q]
    before_left = np.append(back[nu + 1 + nv + 1 :], 0)
    start, end, period = (np.concatenate(x) for x in ((mid - before, mid - q - before_left), (mid + p + after, mid + after_left), (p, q)))
    found = np.flatnonzero(end - start >= 2 * period)
    found = found[np.lexsort((period[found], end[found], start[found]))]
    start, end, period = start[found], end[found], period[found]
    first = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(found) else np.zeros(0, bool)
    return list(zip(start[first].tolist(), end[first].tolist(), period[first].tolist(), strict=True))


def runs_of(s: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the line s, by start, then period."""
    n, share = len(s), max(1, min_length // 2)
    if n < max(min_length, 2):
        return []
    marks = np.zeros(n - share + 1, np.uint64)
    for j in range(share):
        marks += (s[j : n - share + 1 + j].astype(np.uint64) + np.uint64(1)) * _ODD[j % len(_ODD)] ** np.uint64(1 + j // len(_ODD))
    order = np.argsort(marks, kind="stable")
    same = marks[order[1:]] == marks[order[:-1]]
    if not same.any():
        return []
    earlier = np.full(len(marks), -1, np.int64)  # where the marked words stood last before
    earlier[order[1:][same]] = order[:-1][same]
    found: dict[tuple[int, int], int] = {}
    todo: list[tuple[int, int, list[tuple[int, int]]]] = [(0, n, [])]
    while todo:
        lo, hi, short = todo.pop()
        if hi - lo < max(min_length, 2) or any(a <= lo and hi <= b for a, b in short) or earlier[lo : hi - share + 1].max() < lo:
            continue
        mid = (lo + hi) // 2
        for a, b, p in _crossing(s, lo, mid, hi):
            if b - a < min_length or (a == lo and a and s[a - 1] == s[a - 1 + p]) or (b == hi and b < n and s[b] == s[b - p]):
                continue  # too short, or part of a longer one that crosses the midpoint of a larger piece
            found[a, b] = min(p, found.get((a, b), p))
            if 2 * p <= min_length:
                short = [*short, (a, b)]
        todo += [(lo, mid, [x for x in short if x[0] < mid]), (mid, hi, [x for x in short if x[1] > mid])]
    return sorted((a, b - a, p) for (a, b), p in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run holds beyond its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) == 0


def _scan(min_length: int):
    """(id, n_words, runs, collapsed) of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            counts, found, texts = [], [], []
            for cell in batch.column(1).cast(pa.large_binary()):
                words = (cell.as_py() or b"").split()  # bytes split at the six separators and no others
                runs = runs_of(interned(words), min_length)
                counts.append(len(words))
                found.append([{"start": a, "length": n, "period": p} for a, n, p in runs])
                if runs:
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
                texts.append(b" ".join(words))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(id_col, n_words, runs, collapsed) for each row of docs, in a scan without a shuffle.

    Words are what stands between spaces, tabs, newlines, vertical tabs, form
    feeds and carriage returns, compared exactly.  runs holds (start, length,
    period) of every run of min_length words or more, by start, then period;
    starts count words from 0.  collapsed is the text's words but those that a
    run holds beyond its first period, joined by one space.  A null text, or one
    without words, has no runs and collapses to an empty text.  Null and repeated
    ids are rows like others; other columns are ignored, whatever their names; an
    empty table gives an empty one.  A text is worked on whole: memory goes with
    the longest one, time with n log n of its words.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    fields = StructType([rows.schema["id"], *StructType.fromDDL("n_words long, runs array<struct<start long, length long, period long>>, collapsed string").fields])
    return rows.mapInArrow(_scan(min_length), fields).withColumnRenamed("id", id_col)


def planted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of docs, with repetitions planted in a tenth of the texts.

    With h the crc32 of the id in decimal digits (a null id: of nothing) and
    g = h // 10, a text of n words whose h ends in 0 gets, for its words i >= a,
    the word a + (i - a) % p, where a = g % n and p = 1 + (n - a) // (3 + g % 8).
    """
    h = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), h.alias("h"))
    # another row is not looked at; chr(11) and the like are separators as well
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("g", F.floor(F.col("h") / 10).cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    text = F.array_join(F.expr("transform(sequence(0L, n - 1), i -> words[int(if(i < a, i, a + (i - a) % p))])"), " ")
    return rows.select(F.col("id").alias(id_col), F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias(text_col))


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the longest one (ties: least start, then least period), and digests of all runs and of the collapsed text."""
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length as l, r.start as s, r.period as p)))")
    rows = found.withColumn("top", longest)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return rows.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("top.s").alias("start"), (-F.col("top.l")).alias("length"), F.col("top.p").alias("period"),
        F.expr("-1000 * top.l div top.p").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The same rows from all pairs of equal six words of a text, whose distances are periods; the checksum is computed byte by byte.
ORACLE_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, hex(encode(coalesce(doc_id::VARCHAR, ''))) AS x FROM documents),
h AS (
  SELECT doc_id, ws, len(ws) AS n, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) AS h
  FROM d, crc),
f AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
l AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE ws END AS ws FROM f),
g AS (SELECT doc_id, unnest(range(0, n - 5)) AS i, unnest(list_transform(range(1, n - 4), lambda i: array_to_string(ws[i:i + 5], ' '))) AS gram FROM l WHERE n > 5),
e AS (SELECT doc_id, a.i, b.i - a.i AS q FROM g a JOIN g b USING (doc_id, gram) WHERE b.i > a.i),
m AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 AS same FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e) GROUP BY doc_id, q, k),
r AS (SELECT doc_id, start, same + q AS length, min(q) AS period FROM m WHERE same >= q AND same + q >= 12 GROUP BY doc_id, start, same + q),
s AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines, first({'s': start, 'l': length, 'p': period} ORDER BY length DESC, start, period) AS top
  FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM (SELECT doc_id, unnest(range(0, n)) AS i, unnest(ws) AS word FROM l) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT l.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.l::BIGINT AS length, top.p::BIGINT AS period, (1000 * top.l // top.p)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM l LEFT JOIN s USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
