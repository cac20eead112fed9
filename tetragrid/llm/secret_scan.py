"""Secret scans: fixed patterns, and a battery of randomness tests on other tokens.

A token that no pattern matches is read in the smallest encoding that holds it
(hexadecimal, base 32, base 36, base 64).  Encoded random bytes look uniform in
their alphabet, so three tests must all fail to reject randomness: chi-squared
uniformity of the symbols (in blocks of the alphabet that expect five or more),
the number of runs above and below the middle of the alphabet, and the lag-one
serial correlation.  Their least p value is corrected for three tests.

A run of symbols may be a key with a path or a prefix before it, so the whole is
tested, and so are its parts: those between the signs that base 64 has and its
URL form has not, the reverse, and those between any signs.  Parts that overlap
are one token with the least p value, corrected for how many were tested.

What passes may still be text.  Its p value under a text model is bounded by
the likelihood ratio of the model to the uniform distribution (Markov's
inequality), so it falls with the token's length; a token that the battery
rejects has the p value 1.  A text model steps between classes of characters by
fixed chances; from letter to letter one goes by fixed shares and another as the
corpus's own words do, whose pairs are counted first, and the larger bound of the
two holds.  The p values of all tokens that were tested are counted
in a fixed grid of length bands and log p buckets, and the Benjamini-Hochberg
step-up rule gives each band its own cut.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .spans import Span, apart, masked, ordered
from .workspace import Workspace

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
#: Parts of a run that one alphabet holds.
PARTS = tuple(re.compile(rf"[A-Za-z0-9{signs}]{{20,}}={{0,2}}") for signs in ("_-", "+/", ""))
#: Name and alphabet, smallest first.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Randomness is rejected below this p value, corrected for the three tests.
REJECT = 0.001
#: The false discovery rate among the tokens reported in a length band.
FALSE_DISCOVERIES = 0.01
#: Length bands: up to 23, 31, ... symbols, and longer.
BANDS = (23, 31, 39, 47, 63, 127)
#: Buckets of one unit of -ln p; the last one is open.
BUCKETS = 200
#: Text model: the characters of each class, and the chance of the next character's class after one of each class and at the start.
TEXT_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_-")
CLASS_STEPS = ((0.80, 0.08, 0.04, 0.08), (0.40, 0.42, 0.06, 0.12), (0.14, 0.16, 0.60, 0.10), (0.50, 0.30, 0.18, 0.02), (0.50, 0.30, 0.18, 0.02))
#: Shares of the letters a to z in English text, in thousandths.
LETTER_SHARES = (82, 15, 28, 43, 127, 22, 20, 61, 70, 1.5, 7.7, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 9.8, 24, 1.5, 20, 0.7)
#: What is typed along the keys, and the chance that the next key is a neighbour.
TYPED_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz")
TYPED = 0.8
#: Texts of about so many bytes are scanned before their spans are handed on.
SCAN_BYTES = 1 << 22
#: How many counted letters the fixed shares weigh as much as.
PRIOR_LETTERS = 300.0
LETTERS = 26


def base_spans(text: str) -> list[Span]:
    low = text.lower()
    out = []
    if any(name in low for name in ASSIGN_NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def chi_squared_p(statistic: float, freedom: int) -> float:
    """Upper tail by the Wilson-Hilferty approximation."""
    if freedom < 1:
        return 1.0
    z = ((statistic / freedom) ** (1 / 3) - (1 - 2 / (9 * freedom))) / math.sqrt(2 / (9 * freedom))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(symbols: list[int], base: int) -> tuple[float, float, float]:
    """p values of uniformity, runs and serial correlation if the symbols were uniform and independent."""
    n = len(symbols)
    blocks = max(2, min(base, n // 5))
    counts, sizes = [0] * blocks, [0] * blocks
    for v in range(base):
        sizes[v * blocks // base] += 1
    for v in symbols:
        counts[v * blocks // base] += 1
    chi = sum((c - n * s / base) ** 2 / (n * s / base) for c, s in zip(counts, sizes, strict=True))
    uniform = chi_squared_p(chi, blocks - 1)
    high = [2 * v >= base for v in symbols]
    ups = sum(high)
    downs = n - ups
    if ups and downs:
        mean = 2 * ups * downs / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))  # noqa: B905
        run_p = _two_sided((runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        run_p = 2.0 ** (1 - n)
    middle = sum(symbols) / n
    power = sum((v - middle) ** 2 for v in symbols)
    serial = sum((a - middle) * (b - middle) for a, b in zip(symbols, symbols[1:])) / power if power else 1.0  # noqa: B905
    return uniform, run_p, _two_sided((serial + 1 / n) * math.sqrt(n))


def _typed_steps() -> dict[tuple[str, str], float]:
    """ln of the chance of a character after another one where keys are typed in rows."""
    chars = "".join(TEXT_CLASSES)
    follow = {(a, b) for row in TYPED_ROWS for way in (row, row[::-1]) for line in (way, way.upper()) for a, b in zip(line, line[1:])}  # noqa: B905
    out: dict[tuple[str, str], float] = {}
    for last in ("", *chars):
        after = [c for c in chars if (last, c) in follow]
        for c in chars:
            out[last, c] = math.log((1 - TYPED) / len(chars) + (TYPED / len(after) if c in after else 0))
    return out


def _steps(pairs: np.ndarray) -> dict[tuple[str, str], float]:
    """ln of the chance of a character after another one or at the start, from counts of letter pairs (LETTERS + 1, LETTERS); the last row is of letters after no letter."""
    shares = np.array(LETTER_SHARES) / sum(LETTER_SHARES)
    after = (pairs + PRIOR_LETTERS * shares) / (pairs.sum(1, keepdims=True) + PRIOR_LETTERS)
    place = {c: (i, j) for i, chars in enumerate(TEXT_CLASSES) for j, c in enumerate(chars)}
    out: dict[tuple[str, str], float] = {}
    for last in ("", *place):
        kind, letter = place.get(last, (len(TEXT_CLASSES), LETTERS))
        letter = letter if kind < 2 else LETTERS
        for c, (own, nth) in place.items():
            out[last, c] = math.log(CLASS_STEPS[kind][own] * (after[letter, nth] if own < 2 else 1 / len(TEXT_CLASSES[own])))
    return out


class TextModel:
    """Models of text: with the letter pairs of the corpus, with fixed shares of letters for names that are not made of its words, and of rows of keys."""

    def __init__(self, pairs: np.ndarray | None = None):
        none = np.zeros((LETTERS + 1, LETTERS))
        self.models = [_steps(none), _typed_steps()] + ([] if pairs is None else [_steps(pairs)])

    def log_p(self, token: str, base: int) -> float:
        """ln of a bound on the chance that a text of any model is as likely under uniformity as this token."""
        steps = list(zip(("", *token), token))  # noqa: B905
        return min(0.0, max(sum(map(m.__getitem__, steps)) for m in self.models) + len(token) * math.log(base))


def random_token(token: str, model: TextModel) -> tuple[str, float] | None:
    """The encoding and the text model's ln p of a token that passes the battery; a token of digits alone is a number."""
    token = token.rstrip("=")
    own = set(token)
    if not own - set("0123456789"):
        return None
    for name, alphabet in ENCODINGS:
        if own <= set(alphabet):
            place = {c: i for i, c in enumerate(alphabet)}
            if 3 * min(battery([place[c] for c in token], len(alphabet))) < REJECT:
                return None
            return name, model.log_p(token, len(alphabet))
    return None


def random_parts(run: str, model: TextModel) -> list[tuple[int, int, int, float]]:
    """Start, end, tested length and ln p of what is random in a run: of its readings that overlap, the range of all that a cut may accept."""
    places = {(0, len(run))} | {m.span() for part in PARTS for m in part.finditer(run)}
    readings = [(seen[1], a - b, a, b) for a, b in places if (seen := random_token(run[a:b], model))]
    # clusters never overlap; they are kept by start, with the tested length and p of the reading that counts and when it came
    starts: list[int] = []
    held: list[tuple[int, int, float, int]] = []
    for turn, (p, _, a, b) in enumerate(sorted(readings)):
        i = bisect_left(starts, a)
        if i and held[i - 1][0] > a:
            i -= 1
        j = bisect_left(starts, b)
        if i == j:
            starts.insert(i, a)
            held.insert(i, (b, b - a, p, turn))
        elif p <= math.log(FALSE_DISCOVERIES):
            near = held[i:j]
            best = min(near, key=lambda t: t[2:])
            a, b = min(a, starts[i]), max(b, near[-1][0])
            starts[i:j], held[i:j] = [a], [(b, best[1], best[2], turn)]
    return [(a, b, size, min(0.0, p + math.log(len(places)))) for a, (b, size, p, _) in zip(starts, held, strict=True)]


def band(length: int) -> int:
    return sum(length > top for top in BANDS)


def scan_text(text: str, model: TextModel) -> tuple[list[Span], list[tuple[int, int, int, int]], list[int]]:
    """The base spans, of the other tokens that pass the battery start, end, band and bucket of -ln p, and the bands of all that were tested."""
    found = ordered(base_spans(text), KINDS)
    runs = {("random", *m.span()): m for m in TOKEN.finditer(text)}
    tokens, tested = {}, []
    for m in runs.values():
        bands = {band(m.end() - m.start())}
        for a, b, size, p in random_parts(m[0], model):
            a, b = m.start() + a, m.start() + b
            tokens["random", a, b] = (a, b, band(size), min(BUCKETS - 1, int(-p)))
            bands.add(band(size))
        tested += bands
    return found, [tokens[s] for s in apart(tokens, found)], tested


def _scan(model: TextModel):
    """(id, base spans, of the other random tokens start, end, band and -ln p bucket, and how many tokens of each band were tested)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, SCAN_BYTES):
            base, extra, tested = [], [], []
            for cell in batch.column(1):
                found, tokens, bands = scan_text(cell.as_py() or "", model)
                extra.append([{"start": a, "end": b, "band": d, "bucket": u} for a, b, d, u in tokens])
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                tested.append([bands.count(d) for d in range(len(BANDS) + 1)] if bands else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _BASE), pa.array(extra, _EXTRA), pa.array(tested, pa.list_(pa.int64()))], ["id", "base", "extra", "tested"])

    return run


_CODE = np.full(256, LETTERS, np.uint8)
_CODE[65:91] = _CODE[97:123] = np.arange(LETTERS)
_SIGN = np.zeros(256, bool)
_SIGN[list(b"".join(c.encode() for c in TEXT_CLASSES))] = True
_SIGN[list(b"=")] = True


def letter_pairs(data: np.ndarray) -> np.ndarray:
    """Counts of letters, their case ignored, after each letter or after none, in what is too short for a token."""
    cuts = np.flatnonzero(np.diff(_SIGN[data], prepend=False, append=False))
    long = np.zeros(len(data) + 1, np.int8)
    for a, b in zip(cuts[::2][(cuts[1::2] - cuts[::2]) >= 20], cuts[1::2][(cuts[1::2] - cuts[::2]) >= 20], strict=True):
        long[a] += 1
        long[b] -= 1
    code = _CODE[data].astype(np.int64)
    code[np.cumsum(long[:-1]) > 0] = LETTERS
    pairs = np.append(LETTERS, code[:-1]) * (LETTERS + 1) + code
    return np.bincount(pairs, minlength=(LETTERS + 1) ** 2).reshape(LETTERS + 1, LETTERS + 1)[:, :LETTERS]


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((LETTERS + 1, LETTERS), np.int64)
    for batch in batches:
        data, offsets = K.utf8(batch.column(0))
        for a, b in K.slices(offsets):
            total += letter_pairs(data[offsets[a] : offsets[b]])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["pair", "n"])


def text_model(docs: DataFrame, text_col: str = "text") -> TextModel:
    """The model of docs' own words; what is summed and sent to the driver is one row for each pair of letters."""
    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    pairs = np.zeros((LETTERS + 1) * LETTERS)
    pairs[[r.pair for r in counts]] = [r.n for r in counts]
    return TextModel(pairs.reshape(LETTERS + 1, LETTERS))


def sliced(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about so many bytes of a text column."""
    for batch in batches:
        yield from (batch.slice(a, b - a) for a, b in K.slices(K.utf8(batch.column(column))[1], size))


_BASE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_EXTRA = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("band", pa.int32()), ("bucket", pa.int32())]))


def discovery_cuts(counts: dict[tuple[int, int], int], tested: dict[int, int], rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """For each band the least bucket of -ln p that the step-up rule accepts, from counts by (band, bucket)."""
    cuts = {}
    for b, total in tested.items():
        passed, cut = 0, BUCKETS
        for bucket in range(BUCKETS - 1, -1, -1):
            passed += counts.get((b, bucket), 0)
            if passed and math.exp(-bucket) <= rate * passed / total:
                cut = bucket
        cuts[b] = cut
    return cuts


def _found(docs: DataFrame, id_col: str, text_col: str, model: TextModel) -> DataFrame:
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    base = "base array<struct<kind:string,start:bigint,end:bigint>>"
    extra = "extra array<struct<start:bigint,end:bigint,band:int,bucket:int>>"
    found = docs.mapInArrow(_scan(model), f"id {docs.schema['id'].dataType.simpleString()}, {base}, {extra}, tested array<bigint>")
    return Workspace(docs.sparkSession, "secret-scan").save(found, "found")


def _cuts(found: DataFrame, rate: float) -> list[int]:
    """The cut of each length band, from a grid of counts whose size is fixed."""
    grid = found.select(F.explode("extra").alias("t")).groupBy("t.band", "t.bucket").count().collect()
    sums = found.agg(*(F.sum(F.col("tested")[b]).alias(str(b)) for b in range(len(BANDS) + 1))).first()
    cuts = discovery_cuts({(r.band, r.bucket): r["count"] for r in grid}, {b: n for b, n in enumerate(sums) if n}, rate)
    return [cuts.get(b, BUCKETS) for b in range(len(BANDS) + 1)]


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """Secrets of each row of docs: id_col, base and extra spans as arrays of (kind, start, end) in code points.

    A null text counts as empty; rows with the same id are scanned each by its
    own text; texts are scanned whole.  Null ids stay; an empty table finds
    nothing.  Other columns are ignored.
    """
    found = _found(docs, id_col, text_col, text_model(docs, text_col))
    cut = F.array(*map(F.lit, _cuts(found, rate)))
    kept = F.filter("extra", lambda t: t["bucket"] >= F.element_at(cut, t["band"] + 1))
    extra = F.transform(kept, lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return found.select(F.col("id").alias(id_col), "base", extra.alias("extra"))


def mask_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_DISCOVERIES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret that secret_scan finds in the text replaced by mark; all columns stay, a null text stays null."""
    model = text_model(docs, text_col)
    cuts = _cuts(_found(docs, id_col, text_col, model), rate)
    position = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        found, tokens, _ = scan_text(text, model)
        return masked(text, found + [("random", a, b) for a, b, d, u in tokens if u >= cuts[d]], mark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, position, SCAN_BYTES):
            texts = [clean(cell.as_py()) for cell in batch.column(position)]
            yield batch.set_column(position, batch.schema.field(position), pa.array(texts, batch.schema.field(position).type))

    return docs.mapInArrow(run, docs.schema)
