"""Personal data: fixed patterns on the text, and the same patterns on a deobfuscated copy whose offsets are kept.

Rewriting is done by finite-state transducers that emit characters together with
the source range each came from.  The first has one state and gives every
look-alike, wide, mathematical or invisible character its ASCII form.  The second
reads words and turns runs of spelled digits into digits.  The third reads words
and signs and finds what stands for an at sign or a dot: a word or a sign in
brackets, a word between hyphens or underscores, or a word between spaces.  A
bare word is weak evidence, since prose has such words too: a bare "at" counts
only before a host with a disguised dot, and a bare "dot" only before a common
top-level domain or between numbers.  Where all signs are bare, the name must
have a sign or a digit in it, a word such as "mail" must come shortly before, or
the address must be all that its line has.

Spans found in the copy are mapped back by those ranges; one that lies inside a
span of its kind is dropped, one that goes beyond it is kept beside it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import Span, beyond, masked, ordered

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")
#: Characters that look like an ASCII one and have no compatibility form of it.
LOOK_ALIKES = {
    "A": "ΑАᎪᴀ", "B": "ΒВᏴʙ", "C": "СϹᏟᴄ", "D": "Ꭰᴅ", "E": "ΕЕᎬᴇ", "F": "Ϝ", "G": "Ԍɢ", "H": "ΗНᎻʜ", "I": "ΙІӀ", "J": "ЈᎫᴊ", "K": "ΚКᏦᴋ", "L": "Ꮮʟ", "M": "ΜМᎷᴍ", "N": "Νɴ",
    "O": "ΟОՕ", "P": "ΡРᏢᴘ", "Q": "Ԛ", "R": "Ꭱʀ", "S": "ЅՏᏚ", "T": "ΤТᎢᴛ", "U": "Սᴜ", "V": "ѴᏙᴠ", "W": "ԜᎳᴡ", "X": "ΧХ", "Y": "ΥҮ", "Z": "ΖᏃᴢ",
    "a": "аɑα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іıɩι", "j": "јϳ", "k": "κ", "l": "ӏǀ", "n": "ոп", "o": "оοօ", "p": "рρ", "q": "ԛգ", "r": "гᴦ", "s": "ѕꜱ", "t": "τ", "u": "υսʋ", "v": "νѵ", "w": "ԝѡա", "x": "хχ", "y": "уγү", "z": "ʐ",
    "-": "‐‑‒–−", ".": "․。", " ": "\u00a0\u2007\u202f\u2009\u3000",
}
#: Characters that show nothing.
INVISIBLE = frozenset("­​‌‍⁠﻿")
#: Spelled digits in the corpus's languages.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
#: Spelled digits in a row that make a number; a mixed run may hold digits too.
LEAST_SPELLED = 4
#: Words for the signs in the corpus's languages, and common top-level domains that are no frequent words.
AT_WORDS, DOT_WORDS = frozenset(("at", "arroba", "chez")), frozenset(("dot", "punto", "punkt", "point"))
DOMAINS = frozenset("com org net edu gov mil info biz int io dev app ai co uk de fr es nl eu ch ca au jp cn br ru pl se dk fi pt mx ar cl nz za kr gr cz hu ro ie".split())
#: What the transducers read: a word, or one other character.
_SYMBOL = re.compile(r"[^\W_]+|[\W_]")
#: The sign transducer: the next state for each state and class of symbol; states that end in a sign's name are final.
_SIGNS = {
    ("", " "): "space", ("", "("): "open", ("space", "("): "open", ("open", " "): "open",
    ("space", "at"): "word at", ("space", "@"): "word @", ("space", "dot"): "word dot", ("word at", " "): "bare at", ("word @", " "): "spaced at", ("word dot", " "): "bare dot",
    ("open", "at"): "inside at", ("open", "@"): "inside at", ("open", "dot"): "inside dot", ("open", "."): "inside dot", ("inside at", " "): "inside at", ("inside dot", " "): "inside dot",
    ("", "-"): "dash", ("space", "-"): "dash", ("dash", "at"): "dashed at", ("dash", "dot"): "dashed dot", ("dashed at", "-"): "enclosed at", ("dashed dot", "-"): "enclosed dot", ("enclosed at", " "): "enclosed at", ("enclosed dot", " "): "enclosed dot",
    ("inside at", ")"): "bracketed at", ("inside dot", ")"): "bracketed dot", ("bracketed at", " "): "closed at", ("bracketed dot", " "): "closed dot",
}
#: Final states: the sign they emit, and whether a bare word alone stands for it; None for a word between hyphens, which may be a compound.
_FINAL = {"enclosed at": ("@", None), "enclosed dot": (".", None), "bare at": ("@", True), "bare dot": (".", True), "spaced at": ("@", False), "bracketed at": ("@", False), "closed at": ("@", False), "bracketed dot": (".", False), "closed dot": (".", False)}
_CLASSES = dict.fromkeys("[({<", "(") | dict.fromkeys("])}>", ")") | {" ": " ", "@": "@", ".": ".", "-": "-", "_": "-"} | dict.fromkeys(AT_WORDS, "at") | dict.fromkeys(DOT_WORDS, "dot")
_MAY_SIGN = tuple(f" {w} " for w in sorted(DOT_WORDS))
_HAS_BRACKETS = re.compile(rf"[\[({{<]\x20?(?:{'|'.join(sorted(AT_WORDS | DOT_WORDS))}|@|\.)\x20?[\])}}>]|[A-Za-z0-9]\x20@\x20[A-Za-z0-9]|[-_](?:{'|'.join(sorted(AT_WORDS | DOT_WORDS))})[-_]")
#: Words that announce an address in the corpus's languages, and how many words before it they may stand.
CUES, CUE_WORDS = frozenset("mail email mails emails contact contacts write reach address correo contacto escribe escriba direccion courriel adresse contactez kontakt schreib schreiben mailto".split()), 4
#: Words that go on after an address, and never are a host.
JOINING = frozenset("at on in or and for to if by from is who the a an my our your this that".split())
_LAST_WORDS = re.compile(r"[^\W_]+")
#: Character references that stand for the signs.
_REFERENCE = re.compile(r"&(?:#0*(?:64|46)|#[xX]0*(?:40|2[eE])|commat|period);")
_HAS_SPELLED = re.compile(rf"(?:{'|'.join(sorted(SPELLED, key=len, reverse=True))})[\x20,.-]{{1,2}}(?:{'|'.join(sorted(SPELLED, key=len, reverse=True))}|[0-9])")
_LINK = re.compile(r"[A-Za-z0-9._%+-]+")
_HOST = re.compile(r"[A-Za-z0-9.-]*")
_HAS_IP = re.compile(r"[0-9]\.[0-9]+\.[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The contract's patterns: leftmost, without overlap in a kind; what fails its test is dropped."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text) if _HAS_IP.search(text) else ():
        if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m.groups())):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := NOT_DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _forms() -> dict[str, str]:
    """What a character shows as in ASCII: by its compatibility form, its value as a digit, or the table of look-alikes."""
    out = {}
    for code in range(0x80, 0x20000):
        c = chr(code)
        form = unicodedata.normalize("NFKC", c)
        digit = unicodedata.digit(c, None)
        if len(form) == 1 and form.isascii():
            out[c] = form
        elif digit is not None:
            out[c] = str(digit)
    out |= {c: plain for plain, odd in LOOK_ALIKES.items() for c in odd}
    return out | dict.fromkeys(INVISIBLE, "")


FORMS = _forms()


def _class(chars: Iterable[str]) -> re.Pattern[str]:
    """Any one of some characters, as ranges."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges) + "]")


#: Characters beyond the first plane make a slow class, so texts without them are searched for the others.
_FAR = re.compile("[\U00010000-\U0010ffff]")
_ODD_NEAR, _ODD = _class(c for c in FORMS if c < "\U00010000"), _class(FORMS)


class Tape:
    """A text and, for each of its characters, the source range it came from."""

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None):
        self.text = text
        self.start = list(range(len(text))) if start is None else start
        self.end = list(range(1, len(text) + 1)) if end is None else end

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Tape:
        """With each range replaced; every new character stands for the whole range."""
        parts, start, end, at = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            start += self.start[at:a]
            end += self.end[at:a]
            if new:
                start += [self.start[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
            at = b
        return Tape("".join([*parts, self.text[at:]]), start + self.start[at:], end + self.end[at:])

    def source(self, span: Span) -> Span:
        return span[0], self.start[span[1]], self.end[span[2] - 1]


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Runs of at least LEAST_SPELLED digits, one of them spelled out, as (start, end, digits): the transducer's state is the run so far and the separators after it."""
    out: list[tuple[int, int, str]] = []
    start, end, digits, words, gap = 0, 0, "", 0, 0

    def flush() -> None:
        if words and len(digits) >= LEAST_SPELLED:
            out.append((start, end, digits))

    for m in _SYMBOL.finditer(text):
        symbol = m[0]
        if symbol in " ,.-":
            gap += 1
            continue
        digit = SPELLED.get(symbol.lower()) or (symbol if len(symbol) == 1 and symbol in "0123456789" else None)
        if digits and (digit is None or not 1 <= gap <= 2):
            flush()
            digits, words = "", 0
        if digit is not None:
            start, end = (start if digits else m.start()), m.end()
            digits, words = digits + digit, words + (symbol not in "0123456789")
        gap = 0
    flush()
    return out


def disguised_signs(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, sign, bare) of what the sign transducer emits: from each symbol the longest way to a final state, else on from the next."""
    symbols = [(m.start(), m.end(), _CLASSES.get(m[0].lower(), "")) for m in _SYMBOL.finditer(text)]
    out, i = [], 0
    while i < len(symbols):
        state, j, last = "", i, None
        while j < len(symbols) and j - i < 9 and (state := _SIGNS.get((state, symbols[j][2]))):
            j += 1
            if state in _FINAL:
                last = (j, state)
        if last:
            out.append((symbols[i][0], symbols[last[0] - 1][1], *_FINAL[last[1]]))
            i = last[0] - (text[symbols[last[0] - 1][0]] == " ")  # a space may end one sign and begin the next
        else:
            i += 1
    return out


def _announced(text: str, chain: list[tuple[int, int, str, bool]], begin: int, at: int, last: int) -> bool:
    """Whether an address whose signs are all bare words is likely one: by its name, what comes before it, or because it stands alone."""
    start = end = chain[at][0]
    while start and (text[start - 1] in LOCAL):
        start -= 1
    if at > begin or not text[start:end].strip(".%+-").isalpha():
        return True
    line = text[text.rfind("\n", 0, start) + 1 : start]
    if any(w.lower() in CUES for w in _LAST_WORDS.findall(line[-200:])[-CUE_WORDS:]):
        return True
    after = _HOST.match(text, chain[last - 1][1]).end()
    rest = text[after : after + 200].partition("\n")[0]
    follows = _LAST_WORDS.match(rest.lstrip(" "))
    host = _HOST.match(text, chain[at][1])[0].strip(".-").lower()
    return not line.strip() and host not in JOINING and (not rest.strip(" .,;!?)") or rest[0] in ".,;!?)" or bool(follows and follows[0].lower() in JOINING))


def _accepted(text: str, signs: list[tuple[int, int, str, bool]]) -> list[tuple[int, int, str]]:
    """Which signs are to be rewritten: chains of names with signs between them that make an address or a number."""
    chains: list[list[tuple[int, int, str, bool]]] = []
    for sign in signs:
        before = _LINK.fullmatch(text, chains[-1][-1][1], sign[0]) if chains else None
        if before is None or sign[0] < chains[-1][-1][1]:
            chains.append([])
        chains[-1].append(sign)
    out: list[tuple[int, int, str]] = []
    for chain in chains:
        tail = _LINK.match(text, chain[-1][1])
        plain = tail is not None and text.startswith("@", tail.end())
        names = [text[a[1] : b[0]] for a, b in zip(chain, chain[1:])] + [_HOST.match(text, chain[-1][1])[0]]  # noqa: B905
        tops = [name.strip(".-").rpartition(".")[2].lower() for name in names]
        ats = [i for i, x in enumerate(chain) if x[2] == "@"]
        begin = 0
        for at, stop in zip([-1, *ats], [*ats, len(chain)], strict=True):
            # the host ends after the last name whose domain is plausible: any of letters after a bracketed dot, a common one after a bare word
            last = max((i + 1 for i in range(at + 1, stop) if (tops[i] in DOMAINS if chain[i][3] else len(tops[i]) >= 2 and tops[i].isalpha())), default=at + 1)
            host = [x[:3] for x in chain[at + 1 : last]]
            bare = at >= 0 and chain[at][3]
            if at < 0:
                if not ats and all(re.fullmatch(r"[0-9.]+", n.strip(".")) for n in names):
                    out += [x[:3] for x in chain]
                elif not ats:
                    out += [x[:3] for x in chain if not x[3] or x[:3] in host]
                continue
            if bare and (plain if stop == len(chain) else not chain[stop][3]):  # a word before a plainer at sign
                begin = at + 1
                continue
            if host and chain[at][3] is not False and all(x[3] for x in chain[at + 1 : last]) and not _announced(text, chain, begin, at, last):
                begin = at + 1
                continue
            own = "." in names[at].strip(".") and len(tops[at]) >= 2 and tops[at].isalpha()
            if host or own and not bare:
                out += [x[:3] for x in chain[begin : at + 1]] + host
                begin = last
            else:
                begin = at + 1
        if ats and plain:
            out += [x[:3] for x in chain[begin:] if not x[3]]
    return sorted(set(out))


def deobfuscated(text: str) -> Tape | None:
    """The rewritten text, None where nothing is to be rewritten."""
    tape = None
    if "&" in text and (found := [(m.start(), m.end(), "@" if m[0][-3:-1] in ("64", "40", "at") else ".") for m in _REFERENCE.finditer(text)]):
        tape = Tape(text).rewritten(found)
        text = tape.text
    odd = None if text.isascii() else _ODD if _FAR.search(text) else _ODD_NEAR
    if odd and odd.search(text):
        tape = (tape or Tape(text)).rewritten([(m.start(), m.end(), FORMS[m[0]]) for m in odd.finditer(text)])
    for may, edits in ((lambda low: _HAS_SPELLED.search(low), spelled_digits), (lambda low: any(w in low for w in _MAY_SIGN) or _HAS_BRACKETS.search(low), lambda t: _accepted(t, disguised_signs(t)))):
        now = text if tape is None else tape.text
        if may(now.lower()) and (found := edits(now)):
            tape = (tape or Tape(text)).rewritten(found)
    return tape


def scan_text(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and those found only after deobfuscation; a spelled number of 10 to 15 digits counts as a phone number."""
    found = ordered(base_spans(text), KINDS)
    tape = deobfuscated(text)
    if tape is None:
        return found, []
    more = [tape.source(s) for s in base_spans(tape.text)]
    for m in CARD.finditer(tape.text):
        _, a, b = tape.source(("phone", m.start(), m.end()))
        if b - a > 2 * (m.end() - m.start()) and 10 <= len(NOT_DIGITS.sub("", m[0])) <= 15:
            more.append(("phone", a, b))
    return found, ordered(beyond(more, found), KINDS)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [scan_text(cell.as_py() or "") for cell in batch.column(1)]
        columns = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in pair[i]] for pair in both], _SPANS) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "base", "extra"])


def pii_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of each row of docs: id_col, base and extra spans as arrays of (kind, start, end) in code points.

    A null text counts as empty; rows with the same id are scanned each by its
    own text; texts are scanned whole.  Null ids stay; an empty table finds
    nothing.  Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    found = docs.mapInArrow(_scan, f"id {docs.schema['id'].dataType.simpleString()}, base {spans}, extra {spans}")
    return found.withColumnRenamed("id", id_col)


def mask_pii(text: str | None, mark: str = "[PII]") -> str | None:
    """A text with every span replaced."""
    return None if text is None else masked(text, sum(scan_text(text), []), mark)
