"""Groups of spelling variants: words one edit apart, found by the parities of their letters.

A word's mask has a bit for each letter, set where the word has it an odd number
of times.  One inserted or deleted letter flips one bit and a replaced one two
at most, so of the mask's three bands one is equal in both words.  Words are
joined on an equal band together with the length, and verified.

A band alone is shared by ever more words as the vocabulary grows.  The edit
also leaves the word's first or second half as it is, so the key takes in one
half as well: what words share is then their half, a band and the length.  A pair
that meets under several keys is made under the first of them, so pairs are
verified once and nothing is made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: What a word is.
RUN, MIN_LENGTH, MIN_COUNT = r"[A-Za-zÀ-ÿ]", 7, 2
#: A word's form occurs so many times as often at least.
RATIO = 10
#: One in so many words is damaged by the query.
DAMAGE = 31
#: Bits of a mask: the letters a to z, and seven that share those from U+00C0 on.
BITS = 33
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGE) -> DataFrame:
    """(word, n): the words of at least MIN_LENGTH letters that all texts together have at least MIN_COUNT times.

    Words are maximal runs of RUN, with A-Z lowered.  Where damage divides the
    crc32 of "<id>:<word>", the letter at place crc32 % length is left out first;
    a null id counts as an empty text there.  A null text has no words.
    """
    own = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    # a shorter run stays too short, damaged or not
    runs = F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(f"{RUN}{{{MIN_LENGTH},}}"), F.lit(0))
    words = docs.select(own.alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    words = words.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = words.select(F.when(F.col("h") % damage == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def parity_mask(word: Column) -> Column:
    """A bit for each letter, set where the word has it an odd number of times; letters beyond a-z share seven bits."""
    bit = lambda c: F.when(F.ascii(c).between(97, 122), F.ascii(c) - 97).otherwise(26 + F.pmod(F.ascii(c), F.lit(BITS - 26)))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: F.when(c == "", m).otherwise(m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(c).cast("int")))))


#: The bits of each of the three bands: letters are dealt in turn, so that common ones are spread.
BANDS = tuple(sum(1 << i for i in range(b, BITS, 3)) for b in range(3))


def _keyed(words: DataFrame) -> DataFrame:
    """(key, grown, band, side, other, word, n, mask): a word under each key it can meet another one by.

    base is the length of the pair's shorter word.  A word stands as one of base
    length under all three bands, and as the grown one, whose single flipped bit
    leaves one of two bands equal, under two.
    """
    roles = [(grown, band, side) for grown in (0, 1) for band in range(3 - grown) for side in (0, 1)]
    role = F.explode(F.array(*(F.struct(F.lit(g).alias("grown"), F.lit(b).alias("band"), F.lit(s).alias("side")) for g, b, s in roles)))
    rows = words.select("word", "n", parity_mask(F.col("word")).alias("mask"), F.length("word").alias("size")).select("*", role.alias("r")).select("*", "r.*")
    rows = rows.withColumn("base", F.col("size") - F.col("grown")).withColumn("half", F.expr("base div 2"))
    first, second = F.xxhash64(F.substring(F.col("word"), F.lit(1), F.col("half"))), F.xxhash64(F.expr("right(word, base - half)"))
    band = F.element_at(F.array(*map(F.lit, BANDS)), F.col("band") + 1)
    key = F.xxhash64("band", "side", "base", F.col("mask").bitwiseAND(band), F.when(F.col("side") == 0, first).otherwise(second))
    return rows.select(key.alias("key"), "grown", "band", "side", F.when(F.col("side") == 1, first).otherwise(F.lit(0)).alias("other"), "word", "n", "mask")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every pair of words that differ by exactly one inserted, deleted or replaced letter, once."""
    keyed = _keyed(words)
    x, y = keyed.where("grown = 0").drop("grown").alias("x"), keyed.alias("y")
    apart = F.col("x.mask").bitwiseXOR(F.col("y.mask"))
    met = [apart.bitwiseAND(F.lit(b)) == 0 for b in BANDS]
    first_band = (F.col("x.band") == 0) | (~met[0] & ((F.col("x.band") == 1) | ~met[1]))
    may = (F.col("x.key") == F.col("y.key")) & ((F.col("y.grown") == 1) | (F.col("x.word") < F.col("y.word"))) & (F.col("x.band") == F.col("y.band")) & (F.col("x.side") == F.col("y.side"))
    may = may & (F.length("y.word") - F.length("x.word") == F.col("y.grown"))
    may = may & (F.bit_count(apart) <= 2 - F.col("y.grown")) & first_band & ((F.col("x.side") == 0) | (F.col("x.other") != F.col("y.other")))
    pairs = x.join(y, may & (F.levenshtein("x.word", "y.word", 1) == 1))
    return pairs.select(F.col("x.word").alias("word"), F.col("x.n").alias("n"), F.col("y.word").alias("near"), F.col("y.n").alias("near_n"))


def spelling_variants(words: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of (word, n), words being distinct.

    n_near is the number of words one edit away; form the one of them of largest
    n (ties: the first by code point) if that is at least ratio times the word's
    own, else null, and form_n its n; root is where the forms lead, the word
    itself if it has none.  Rows with a null word are left out; an empty table
    gives an empty one; other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than the word")
    ws = Workspace(words.sparkSession, "spelling")
    words = ws.save(words.select("word", "n").where("word is not null"), "words")
    pairs = ws.save(near_pairs(words), "pairs")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("top"))
    form_n = -F.col("top.less")
    chosen = form_n >= ratio * F.col("n")
    best = ws.save(best.select("word", "n_near", F.when(chosen, F.col("top.near")).alias("form"), F.when(chosen, form_n).alias("form_n")), "best")
    roots = ws.save(best.where("form is not null").select("word", F.col("form").alias("root")), "roots-0")
    most, longest = words.agg(F.max("n")).first()[0] or 1, 0
    while most >= ratio:  # each form is ratio times as frequent, which bounds the chain
        most, longest = most // ratio, longest + 1
    for step in range(1, max(longest - 1, 0).bit_length() + 1):  # each step doubles what was followed
        on = roots.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        roots = ws.save(roots.join(on, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root")), f"roots-{step}")
    rows = words.join(best, "word", "left").join(roots, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


#: The same rows by the words that are left when each letter in turn is taken away; the checksum is computed byte by byte.
ORACLE_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '{RUN}' || '{{{MIN_LENGTH},}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
own AS (SELECT id, run, count(*) AS c, hex(encode(id || ':' || run)) AS h FROM runs GROUP BY id, run),
summed AS (
  SELECT run, c, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) AS h
  FROM own, crc),
damaged AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM summed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM damaged WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(c) >= {MIN_COUNT}),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, length(word) + 1) r(i)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, l.n, w.word, w.n FROM less l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, w.n, l.word, l.n FROM less l JOIN words w ON w.word = l.rest),
best AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS top, max(other_n) AS top_n FROM near GROUP BY ALL),
forms AS (SELECT word, top AS form, top_n AS form_n FROM best WHERE top_n >= {RATIO} * n),
chain AS (SELECT word, word AS root, 0 AS step FROM words UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.root),
ends AS (SELECT word, last(root ORDER BY step) AS root FROM chain GROUP BY word)
SELECT w.word, form, root, w.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n FROM words w JOIN ends USING (word) LEFT JOIN best USING (word) LEFT JOIN forms USING (word)
"""
