"""Spans found in texts: code-point ranges with a kind."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[str, int, int]


def ordered(spans: Iterable[Span], kinds: Sequence[str]) -> list[Span]:
    """By start, then by the kind's place in kinds."""
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def apart(found: Iterable[Span], taken: Iterable[Span]) -> list[Span]:
    """Those of found, by start, that overlap neither one of taken nor an earlier one kept."""
    out: list[Span] = []
    busy = sorted((a, b) for _, a, b in taken)
    starts, ends = [a for a, _ in busy], list(accumulate((b for _, b in busy), max))
    for span in sorted(found, key=lambda s: (s[1], -s[2])):
        before = bisect_left(starts, span[2])  # of these the latest end decides
        if (not before or ends[before - 1] <= span[1]) and (not out or out[-1][2] <= span[1]):
            out.append(span)
    return out


def beyond(found: Iterable[Span], taken: Iterable[Span]) -> list[Span]:
    """Those of found, by start, that lie inside no other one of their kind, neither of taken nor of found."""
    reach: dict[str, int] = {}
    out: list[Span] = []
    rows = [(a, -b, 0, kind) for kind, a, b in taken] + [(a, -b, 1, kind) for kind, a, b in set(found)]
    for a, end, new, kind in sorted(rows):
        if -end > reach.get(kind, -1):
            reach[kind] = -end
            if new:
                out.append((kind, a, -end))
    return out


def masked(text: str, spans: Iterable[Span], mark: str) -> str:
    """The text with each span replaced; overlapping spans are replaced as one."""
    parts, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def digest_columns(found: DataFrame, id_col: str, kinds: tuple[str, ...], base_kinds: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and the string of all spans."""

    def text(spans):
        rank = F.create_map(*(x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))))
        keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank[s["kind"]].alias("k"), s["end"].alias("b"), s["kind"].alias("kind")))
        return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(id_col, *map(count, base_kinds), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "extra")).alias("spans"))
