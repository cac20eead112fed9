"""Piece models: the pieces of a SentencePiece file, a double-array trie over them, and unigram Viterbi on whole batches.

White space is one symbol here: a piece's marker U+2581 is stored as the byte
0x20, and a text's spaces are its own bytes.  A literal U+2581 in a text is thus
no marker; it is encoded by its bytes and decodes to itself.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: How far below the least score a character without a piece stands.
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes):
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        yield key >> 3, value


def read_pieces(model: bytes) -> list[tuple[str, float, int]]:
    """Piece, score and type of each id."""
    out = []
    for number, value in _fields(model):
        if number == 1:
            f = dict(_fields(value))
            out.append((f.get(1, b"").decode(), float(f.get(2, 0.0)), int(f.get(3, NORMAL))))
    return out


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value: from node s, byte c leads to t = base[s] + c where check[t] == s; value is the key's number or -1.

    Keys are sorted, so a node's keys are a range of them.
    """
    order = sorted(range(len(keys)), key=keys.__getitem__)
    base, check, value = {}, {}, {}
    taken = bytearray(1 << 20)
    taken[0] = 1
    first_free = 1
    todo = [(0, 0, len(order), 0)]
    while todo:
        node, lo, hi, depth = todo.pop()
        if lo < hi and len(keys[order[lo]]) == depth:
            value[node] = order[lo]
            lo += 1
        if lo == hi:
            continue
        children, starts = [], []
        for i in range(lo, hi):
            c = keys[order[i]][depth]
            if not children or children[-1] != c:
                children.append(c)
                starts.append(i)
        starts.append(hi)
        slot, tries = max(first_free, children[0] + 1), 0
        while True:
            slot = taken.find(0, slot)
            if slot < 0 or slot + 256 >= len(taken):
                slot = max(len(taken) - 256, 0) if slot < 0 else slot
                taken += bytes(len(taken))
                continue
            at = slot - children[0]
            if not any(taken[at + c] for c in children):
                break
            slot += 1
            tries += 1
        if tries > 64:  # what stands before is nearly full
            first_free = slot
        base[node] = at
        for c in children:
            taken[at + c] = 1
            check[at + c] = node
        todo += [(at + c, a, b, depth + 1) for c, a, b in zip(children, starts[:-1], starts[1:], strict=True)]
    size = max([0, *check]) + 257

    def table(found: dict[int, int], fill: int) -> np.ndarray:
        out = np.full(size, fill, np.int32)
        out[list(found)] = list(found.values())
        return out

    return table(base, 0), table(check, -1), table(value, -1)


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range in turn."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


@dataclass
class PieceModel:
    """Arrays of at most the vocabulary's size; the trie's values are ids."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    score: np.ndarray
    byte_id: np.ndarray
    unknown: int
    unknown_score: float
    breaks: np.ndarray
    text: np.ndarray
    text_at: np.ndarray

    @staticmethod
    def load(model: bytes) -> PieceModel:
        pieces = read_pieces(model)
        score = np.array([s for _, s, _ in pieces])
        plain = [i for i, (_, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)]
        as_bytes = [p.replace(MARK, " ").encode() for p, _, _ in pieces]
        base, check, value = double_array([as_bytes[i] for i in plain])
        value = np.where(value >= 0, np.array(plain, np.int32)[value], -1).astype(np.int32)
        byte_id = np.full(256, -1, np.int32)
        shown = []
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                byte_id[int(p[1:-1], 16)] = i
            shown.append(as_bytes[i] if kind in (NORMAL, USER_DEFINED) else bytes([int(p[1:-1], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else b"")
        unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        inner = set(b"".join(as_bytes[i] for i in plain if len(as_bytes[i]) > 1))
        breaks = np.zeros(256, bool)
        breaks[[c for c in b"\n\t" if c not in inner]] = True
        if any(b" " in as_bytes[i].lstrip(b" ") for i in plain):
            raise ValueError("a piece has white space after other characters: words cannot be encoded apart")
        normal = score[[i for i in plain if pieces[i][2] == NORMAL]]
        at = np.concatenate([[0], np.cumsum([len(x) for x in shown])])
        return PieceModel(base, check, value, score, byte_id, unknown, float(normal.min()) - UNKNOWN_PENALTY, breaks, np.frombuffer(b"".join(shown), np.uint8), at)

    def _matches(self, data: np.ndarray, end_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of every piece in the data that stays in its segment; a character without a piece of its own gets id -1."""
        start = np.flatnonzero((data & 0xC0) != 0x80)
        following = np.append(start[1:], len(data))
        alone = np.zeros(len(start), bool)
        rank, node, at, limit = np.arange(len(start)), np.zeros(len(start), np.int64), start.copy(), end_of[start]
        found = []
        while len(rank):
            to = self.base[node] + data[at]
            ok = self.check[to] == node
            rank, node, at, limit = rank[ok], to[ok].astype(np.int64), at[ok] + 1, limit[ok]
            ids = self.value[node]
            hit = ids >= 0
            found.append((start[rank[hit]], at[hit], ids[hit]))
            alone[rank[hit]] |= at[hit] == following[rank[hit]]
            more = at < limit
            rank, node, at, limit = rank[more], node[more], at[more], limit[more]
        lone = ~alone
        found.append((start[lone], following[lone], np.full(int(lone.sum()), -1, np.int32)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def segment(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best segmentation of each segment data[first[i]:first[i + 1]], and their bounds.

        All segments advance together, one byte position at a time.  Of equal
        scores the one whose last piece starts earliest wins.
        """
        size = np.diff(first)
        seg_of = np.repeat(np.arange(len(size)), size)
        start, end, ids = self._matches(data, first[1:][seg_of])
        score = np.where(ids >= 0, self.score[ids], self.unknown_score)
        step = end - first[seg_of[start]]
        order = np.lexsort((start, end, step))
        start, end, ids, score, step = start[order], end[order], ids[order], score[order], step[order]
        best, back = np.full(len(data) + 1, -np.inf), np.full(len(data) + 1, -1, np.int64)
        origin = np.zeros(len(data) + 1, bool)
        origin[first[:-1]] = True
        steps = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]])) if len(step) else np.zeros(0, np.int64)
        for a, b in zip(steps, np.append(steps[1:], len(step)), strict=True):
            s, e = start[a:b], end[a:b]
            value = np.where(origin[s], 0.0, best[s]) + score[a:b]
            group = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
            top = np.maximum.reduceat(value, group)
            width = np.diff(np.append(group, b - a))
            hit = np.flatnonzero(value == np.repeat(top, width))
            owner = np.repeat(np.arange(len(group)), width)[hit]
            chosen = hit[np.concatenate([[True], owner[1:] != owner[:-1]])]
            # an end that starts the next segment keeps its value for this one only: starts count as 0 by origin
            best[e[group]], back[e[group]] = top, a + chosen
        trail, seg = [], np.flatnonzero(size > 0)
        at = first[1:][seg]
        while len(seg):
            m = back[at]
            trail.append((seg, m))
            at = start[m]
            on = at > first[seg]
            seg, at = seg[on], at[on]
        if not trail:
            return np.zeros(0, np.int32), np.zeros(len(size) + 1, np.int64)
        seg, m = (np.concatenate(x) for x in zip(*trail, strict=True))
        depth = np.repeat(np.arange(len(trail)), [len(x) for x, _ in trail])
        order = np.lexsort((-depth, seg))
        seg, m = seg[order], m[order]
        lone = ids[m] < 0
        width = np.where(lone, end[m] - start[m], 1)
        out = np.repeat(ids[m], width)
        spread = np.repeat(lone, width)
        out[spread] = self.byte_id[data[_ragged(start[m[lone]], width[lone])]]
        out[out < 0] = self.unknown
        return out.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(seg, width, len(size)).astype(np.int64))])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the UTF-8 texts data[offsets[i]:offsets[i + 1]] and their bounds; each text gets a leading space.

        Texts fall into segments that no piece crosses; each distinct segment is
        searched once.
        """
        size = np.diff(offsets)
        full = size > 0
        wide = np.concatenate([[0], np.cumsum(size + full)])
        body = np.ones(int(wide[-1]), bool)
        body[wide[:-1][full]] = False
        text = np.full(int(wide[-1]), 32, np.uint8)
        text[body] = data[int(offsets[0]) : int(offsets[-1])]
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(len(size) + 1, np.int64)
        cut = np.zeros(len(text), bool)
        space = text == 32
        cut[0] = True
        cut[1:] = (space[1:] & ~space[:-1]) | self.breaks[text[:-1]] | self.breaks[text[1:]]
        cut[wide[:-1][full]] = True
        first = np.append(np.flatnonzero(cut), len(text))
        length = np.diff(first)
        distinct, which = _distinct(text, first[:-1], length)
        lone = _ragged(first[distinct], length[distinct])
        own = np.concatenate([[0], np.cumsum(length[distinct])])
        ids, bounds = self.segment(text[lone], own)
        count = np.diff(bounds)[which]
        total = np.concatenate([[0], np.cumsum(count)])
        return ids[_ragged(bounds[which], count)], total[np.searchsorted(first[:-1], wide)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 texts of the id lists ids[bounds[i]:bounds[i + 1]], their leading space taken off, and their offsets."""
        size = np.diff(self.text_at)[ids]
        text = self.text[_ragged(self.text_at[ids], size)]
        at = np.concatenate([[0], np.cumsum(size)])[bounds]
        full = at[1:] > at[:-1]
        lead = at[:-1][full]
        lead = lead[text[lead] == 32]
        keep = np.ones(len(text), bool)
        keep[lead] = False
        return text[keep], at - np.searchsorted(lead, at)


def _distinct(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct segments, and for each segment the place of its equal among them; equality is checked by bytes."""
    from . import textkernel as K

    hashes = K.segment_hashes(text, start, start + length, newline=True)
    _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    equal = length == length[one[which]]
    if equal.all():
        equal = text[_ragged(start, length)] == text[_ragged(start[one[which]], length)]
    if equal.all():
        return one, which
    seen: dict[bytes, int] = {}
    which = np.array([seen.setdefault(text[a : a + n].tobytes(), len(seen)) for a, n in zip(start, length, strict=True)])
    return np.unique(which, return_index=True)[1], which
