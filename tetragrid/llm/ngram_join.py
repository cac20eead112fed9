"""Self-join of documents on the Jaccard similarity of their word n-grams.

The method is prefix filtering.  Every document's distinct n-grams are put in
one global order, rare ones first; two documents over the threshold must share
an n-gram among the first |x| - ceil(t|x|) + 1 of each.  So only those prefix
n-grams are joined.  Length and positional filters thin the joined pairs, a
suffix filter thins them again once the sets are at hand, and each pair that is
left is verified once, by its exact overlap.

Rarity is counted, not estimated, at the cost of some bytes for each n-gram: a
task sends sorted fingerprints of the n-grams of a piece of a file, as
compressed differences, to the counters of their ranges; these answer with the
fingerprints and a byte for each.  A piece lies within a fixed range of rows of
one file, and who reads rows of that range again looks fingerprints up in all
its answers, so it does not matter how either scan was split.  A fingerprint has
ten bits more than the number of n-grams, so one in a thousand counts too many
and none too few.  N-grams of one document alone then never leave their task.

Groups of copies are never expanded into all their pairs:

* Texts with equal sets are one node, the place of the row with the least id;
  their other rows are passed over where they are read.
* Round 1 verifies, for each n-gram, one hub against the other nodes with that
  n-gram.  A frequent n-gram has a hub in each of its parts, and one of these is
  verified against the other hubs.  The hub is the node where it stands earliest, that is, the one with
  the fewest n-grams of its own: the middle of a group of near copies.
* Round 2 verifies every pair that passes the filters and is not yet joined by
  verified links.  What it leaves out is joined already, so the components are
  exact.

To verify, a node's set goes once to each hub it is paired with; a hub of very
many pairs has its set in several tasks.  Texts stay where they are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textkernel as K
from .components import connected_components
from .places import Facts, column_of, place, placed, places, stretches
from .workspace import Workspace

#: N-grams whose fingerprints are sent together at most, the rows of a file that share answers, and n-grams that one range of them has on the average.
PIECE_GRAMS, PIECE_ROWS, RANGE_GRAMS = 1 << 18, 1024, 1 << 19
#: Rows of the table whose answers lie in one bucket, on the average.
RARITY_ROWS = 1 << 13
#: Bits of a fingerprint beyond those of the number of n-grams.
SPARE_BITS = 10
#: A prefix n-gram that has more nodes than this is handled in several parts.
PART_NODES = 65_536
#: A key with more than this share of a table's rows is dealt to several tasks; there can be no more such keys, so these are broadcast.
SHARES = 1000
_NODE_BYTES = 16


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For slices of the rows: the first row's number, and each row's sorted distinct n-gram hashes."""
    data, offsets = K.utf8(column)
    for a, b in K.slices(offsets):
        w = K.words(data, offsets[a : b + 1])
        grams, bounds = K.shingles(w.hashes(), w.first, k)
        sets = []
        for d in range(b - a):
            own = grams[bounds[d] : bounds[d + 1]]
            own.sort()
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
        yield a, sets


def digest(grams: np.ndarray) -> bytes | None:
    """What equal sets share; None for the empty set."""
    return hashlib.blake2b(grams.tobytes(), digest_size=_NODE_BYTES).digest() if len(grams) else None


def _ceil(num: int, den: int):
    return -(-num // den)


def _scan(k: int):
    """(id, file, row, n, digest) of (id, text, file, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for _, sets in shingle_sets(batch.column(1), k):
                sizes += map(len, sets)
                digests += map(digest, sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())], ["id", "file", "row", "n", "digest"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch], k: int, copies: Facts) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Files, rows and sets of runs of rows of (text, file, row) that are no copies; a run lies within PIECE_ROWS rows of one file, and where it is cut does not matter."""
    for batch in batches:
        file, row = places(batch)
        keep = ~copies.holds(file, row)
        texts, file, row = batch.column(0).filter(pa.array(keep)), file[keep], row[keep]
        for begin, end in stretches(file, row // PIECE_ROWS):
            held, grams, first = [], 0, begin
            for a, sets in shingle_sets(texts.slice(begin, end - begin), k):
                held += sets
                grams += sum(map(len, sets))
                if grams >= PIECE_GRAMS or begin + a + len(sets) == end:
                    yield file[first : first + len(held)], row[first : first + len(held)], held
                    held, grams, first = [], 0, first + len(held)


def _prints(sets: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct fingerprints of some sets, sorted, and how many n-grams have each."""
    prints = np.concatenate(sets) >> np.uint64(64 - bits)
    prints.sort()
    at = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.zeros(0, np.int64)
    return prints[at], np.diff(at, append=len(prints))


def _packed(values: np.ndarray) -> bytes:
    """Small numbers with their bytes in planes, so that those that are all zero cost nothing."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, width).T.tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return planes.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _requests(k: int, bits: int, range_bits: int, copies: Facts):
    """Rows (part, file, row, grams, counts): the fingerprints of a piece in one range, and how often it has each."""
    cut = np.uint64(bits - range_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, row, sets in _pieces(batches, k, copies):
            prints, counts = _prints(sets, bits)
            if not len(prints):
                continue
            counts = counts.astype(np.uint32)
            part = (prints >> cut).astype(np.int64)
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = np.append(at[1:], len(part))
            own = [prints[a:b] - (prints[a] >> cut << cut) for a, b in zip(at, ends, strict=True)]
            columns = [pa.array(part[at].astype(np.int32)), pa.array(np.repeat(file[:1], len(at))), pa.array(np.repeat(row[:1], len(at)))]
            columns += [pa.array([_packed(np.diff(x, prepend=np.uint64(0))) for x in own], pa.binary()), pa.array([_packed(counts[a:b]) for a, b in zip(at, ends, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "file", "row", "grams", "counts"])

    return run


def level(count: np.ndarray) -> np.ndarray:
    """A count as one byte: itself up to 127, beyond that four steps for each doubling."""
    big = np.maximum(count, 128).astype(float)
    return np.where(count < 128, count, np.minimum(128 + np.floor(4 * np.log2(big / 128)), 255)).astype(np.uint8)


def least_count(levels: np.ndarray) -> np.ndarray:
    """The least count of a level."""
    return np.where(levels < 128, levels, np.floor(128 * 2 ** ((levels.astype(float) - 128) / 4))).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, row, part, grams, levels) that answer those of _requests, which come by part."""

    def answers(part: int, rows: list[tuple[int, int, bytes, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        prints = np.concatenate([x[3] for x in rows])
        own = np.concatenate([x[4] for x in rows])
        cuts = np.cumsum([0] + [len(x[3]) for x in rows])
        rows = [x[:3] for x in rows]
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        new = np.append(True, prints[1:] != prints[:-1])
        sums = np.add.reduceat(own[order], np.flatnonzero(new), dtype=np.int64)
        levels = np.empty(len(prints), np.uint8)
        levels[order] = level(sums)[np.cumsum(new) - 1]
        packed = [_packed(levels[a:b]) for a, b in zip(cuts, cuts[1:])]  # noqa: B905
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array([x[2] for x in rows], pa.binary()), pa.array(packed, pa.binary())], ["file", "row", "part", "grams", "levels"])

    held: list[tuple[int, int, bytes, np.ndarray, np.ndarray]] = []
    last = None
    for batch in batches:
        for part, file, row, grams, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != last and held:
                yield from answers(last, held)
                held = []
            last = part
            held.append((file, row, grams, np.cumsum(_unpacked(grams, np.uint64)), _unpacked(counts, np.uint32)))
    if held:
        yield from answers(last, held)


def prefix_length(n, num: int, den: int):
    return n - _ceil(num * n, den) + 1


class Rarity:
    """The levels of the n-grams of one piece's range of rows at a time, from all answers about it."""

    def __init__(self, facts: Facts, bits: int, range_bits: int):
        self.facts, self.shift, self.cut, self._at = facts, np.uint64(64 - bits), np.uint64(bits - range_bits), None

    def levels(self, file: int, row: int, grams: np.ndarray) -> np.ndarray:
        if self._at != (file, row // PIECE_ROWS):
            known = self.facts.of(file, row)
            rows = known.column("row").to_numpy()
            a, b = np.searchsorted(rows, [row // PIECE_ROWS * PIECE_ROWS, (row // PIECE_ROWS + 1) * PIECE_ROWS])
            own = known.slice(a, b - a)
            parts = [np.zeros(0, np.uint64)] + [(np.uint64(part) << self.cut) + np.cumsum(_unpacked(g, np.uint64)) for part, g in zip(own.column("part").to_pylist(), own.column("grams").to_pylist(), strict=True)]
            levels = [np.zeros(0, np.uint8)] + [_unpacked(x, np.uint8) for x in own.column("levels").to_pylist()]
            self._prints, first = np.unique(np.concatenate(parts), return_index=True)
            self._levels, self._at = np.concatenate(levels)[first], (file, row // PIECE_ROWS)
        prints = grams >> self.shift
        at = np.searchsorted(self._prints, prints)
        if len(prints) and (at.max() >= len(self._prints) or (self._prints[at] != prints).any()):
            raise ValueError("the table has n-grams that were not counted: it changed while it was read")
        return self._levels[at]


def _postings(k: int, num: int, den: int, bits: int, range_bits: int, copies: Facts, facts: Facts):
    """Prefix n-grams that other nodes have too as rows (gram, salt, file, row, n, pos); the salt is 0 unless the n-gram is handled in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = Rarity(facts, bits, range_bits)
        for file, row, sets in _pieces(batches, k, copies):
            out = []
            for f, r, grams in zip(file.tolist(), row.tolist(), sets, strict=True):
                often = rarity.levels(f, r, grams)
                order = np.argsort(often, kind="stable")[: prefix_length(len(grams), num, den)] if len(grams) else np.zeros(0, np.int64)
                shared = np.flatnonzero(often[order] > 1)
                if len(shared):
                    order = order[shared]
                    parts = 1 + least_count(often[order]) // PART_NODES
                    salt = np.where(parts > 1, 1 + (f ^ r * 0x9E3779B1) % parts, 0)
                    out.append((grams[order].view(np.int64), salt, f, r, len(grams), shared))
            if out:
                size = [len(x[0]) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([x[0] for x in out])), pa.array(np.concatenate([x[1] for x in out]).astype(np.int32))]
                    + [pa.array(np.repeat(np.array([x[i] for x in out], np.int64), size)) for i in (2, 3, 4)]
                    + [pa.array(np.concatenate([x[5] for x in out]).astype(np.int64))],
                    ["gram", "salt", "file", "row", "n", "pos"],
                )

    return run


def overlap(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets reach the threshold; a suffix filter on hash ranges comes first."""
    need = _ceil(num * (len(a) + len(b)), num + den)
    if min(len(a), len(b)) < need:
        return False
    pivots = np.linspace(0, 2.0**64, max(2, len(a) // 8), endpoint=False)[1:].astype(np.uint64)
    cuts_a, cuts_b = (np.diff(np.searchsorted(x, pivots), prepend=0, append=len(x)) for x in (a, b))
    if np.minimum(cuts_a, cuts_b).sum() < need:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum()) >= need


def _sets(k: int, wanted: Facts):
    """Rows (head_file, head_row, salt, file, row, grams): the set of each wanted row, for each time it is wanted."""
    names = ["head_file", "head_row", "salt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file, row = places(batch)
            keep = wanted.holds(file, row)
            file, row = file[keep], row[keep]
            for first, sets in shingle_sets(batch.column(0).filter(pa.array(keep)), k):
                uses = []
                for f, r in zip(file[first : first + len(sets)].tolist(), row[first : first + len(sets)].tolist(), strict=True):
                    known = wanted.of(f, r)
                    at = known.column("row").to_numpy()
                    a, b = np.searchsorted(at, r), np.searchsorted(at, r, side="right")
                    uses.append(known.slice(a, b - a))
                size = list(map(len, uses))
                which = np.repeat(np.arange(len(sets)), size)
                table = pa.concat_tables(uses).select([*names, "file", "row"]).combine_chunks()
                data = [sets[i].tobytes() for i in range(len(sets))]
                yield from (pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in table.slice(i, 256).columns), pa.array([data[j] for j in which[i : i + 256]], pa.binary())], [*names, "file", "row", "grams"]) for i in range(0, len(which), 256))

    return run


def _verify(num: int, den: int):
    """(head_file, head_row, file, row, linked) of sets that come by head and salt, the head's own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, grams = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            own = list(zip(*(batch.column(i).to_pylist() for i in (3, 4)), strict=True))
            keep, linked = [], []
            for i, (key, at, cell) in enumerate(zip(keys, own, batch.column(5), strict=True)):
                if at == key[:2]:
                    head, grams = key, np.frombuffer(cell.as_py(), np.uint64)
                    continue
                if key != head:
                    raise ValueError("a hub's set is missing")
                keep.append(i)
                linked.append(overlap(grams, np.frombuffer(cell.as_buffer(), np.uint64), num, den))
            kept = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(kept) for i in (0, 1, 3, 4)), pa.array(linked, pa.bool_())], ["head_file", "head_row", "file", "row", "linked"])

    return run


def _reach(n: Column, pos: Column, num: int, den: int) -> Column:
    """The largest set that still can match at a posting: enough n-grams are left from pos on for the overlap that the two sizes ask for."""
    return F.floor((n * den - pos * (num + den)) / F.lit(num))


def _may_match(x: str, y: str, num: int, den: int) -> Column:
    """Length and positional filter: each size lies within the other posting's reach."""
    left = F.least(F.col(f"{x}n") - F.col(f"{x}pos"), F.col(f"{y}n") - F.col(f"{y}pos"))
    return left * (num + den) >= (F.col(f"{x}n") + F.col(f"{y}n")) * num


def _matchable(posts: DataFrame, num: int, den: int) -> DataFrame:
    """The postings that may match another one of their n-gram, each with the n-gram's hub: (gram, salt, place, n, pos, hub, hub_n, hub_pos).

    In order of size, a posting matches one before it only if some reach before
    it comes up to its size, and one after it only if the next size is within
    its own reach.  All of this happens in one shuffle, by n-gram and salt.
    """
    group = Window.partitionBy("gram", "salt")
    by_size = group.orderBy("n", "pos", "file", "row")
    posts = posts.withColumn("reach", _reach(F.col("n"), F.col("pos"), num, den))
    posts = posts.withColumn("before", F.max("reach").over(by_size.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.lead("n").over(by_size))
    posts = posts.where("salt > 0 or before >= n or after <= reach")
    posts = posts.withColumn("first", F.min(F.struct("pos", "file", "row", "n")).over(group))
    return posts.select("gram", "salt", place().alias("place"), "n", "pos", F.struct("first.file", "first.row").alias("hub"), F.col("first.n").alias("hub_n"), F.col("first.pos").alias("hub_pos"))


def _hub_pairs(posts: DataFrame, num: int, den: int) -> DataFrame:
    """(head, place): each node with the hub of its n-grams where they may match, and the hubs of the parts of one n-gram; a pair once, whichever is the hub."""
    hubs = posts.where("salt > 0").select("gram", "hub_pos", "hub", "hub_n").distinct()
    first = hubs.groupBy("gram").agg(F.min(F.struct("hub_pos", "hub", "hub_n")).alias("h")).select("gram", "h.*")
    hubs = hubs.select("gram", F.col("hub").alias("place"), F.col("hub_n").alias("n"), F.col("hub_pos").alias("pos")).join(first, "gram")
    names = ["place", "n", "pos", "hub", "hub_n", "hub_pos"]
    pairs = posts.select(names).unionByName(hubs.select(names)).where("place <> hub").where(_may_match("", "hub_", num, den))
    pairs = pairs.groupBy(F.least("place", "hub").alias("a"), F.greatest("place", "hub").alias("b")).agg(F.min("hub").alias("head"))
    return pairs.select("head", F.when(F.col("a") == F.col("head"), F.col("b")).otherwise(F.col("a")).alias("place"))


def _hot(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys with over 1/SHARES of the rows; there are no more than SHARES of them."""
    counts, most = rows.groupBy(key).agg(F.count("*").alias("n")), rows.count() / SHARES
    return F.broadcast(counts.where(F.col("n") > max(most, 1)).select(key, F.ceil(F.col("n") / F.lit(max(most, 1.0))).alias("shares")))


def _open_pairs(posts: DataFrame, roots: DataFrame, tested: DataFrame, ws: Workspace, num: int, den: int) -> DataFrame:
    """(head, place): every pair with a common n-gram that may match, is not tested and whose nodes are in different components.

    A frequent n-gram's postings lie in a square of blocks, so that each pair
    meets in one of them and none has all.
    """
    posts = posts.select("gram", "place", "n", "pos").join(roots, "place", "left").withColumn("root", F.coalesce("root", "place"))
    posts = ws.save(posts, "rooted")
    mixed = ws.save(posts.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gram"), "mixed")
    posts = ws.save(posts.join(mixed, "gram", "left_semi"), "open")
    sides = F.coalesce(F.ceil(F.sqrt("shares")), F.lit(1)).cast("int")
    posts = posts.join(_hot(posts, "gram"), "gram", "left").withColumn("sides", sides).withColumn("own", F.pmod(F.xxhash64("place"), F.col("sides")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("sides") - 1))
    x, y = posts.withColumn("other", every).alias("x"), posts.withColumn("other", every).alias("y")
    same = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own"))
    pairs = x.join(y, same).where("x.place < y.place and x.root <> y.root").where(_may_match("x.", "y.", num, den))
    pairs = pairs.select(F.col("x.place").alias("head"), F.col("y.place").alias("place")).distinct()
    known = tested.select(F.least("head", "place").alias("head"), F.greatest("head", "place").alias("place"))
    return pairs.join(known, ["head", "place"], "left_anti")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, ws: Workspace, name: str, k: int, num: int, den: int) -> DataFrame:
    """(head, place, linked) for each pair, from the whole texts of the nodes' rows."""
    pairs = ws.save(pairs, f"{name}-pairs")
    hot = _hot(pairs, "head")
    salted = pairs.join(hot, "head", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    member = salted.select("head", F.pmod(F.xxhash64("place"), F.col("shares")).cast("int").alias("salt"), "place")
    heads = salted.groupBy("head").agg(F.max("shares").alias("shares")).select("head", F.explode(F.sequence(F.lit(0), F.col("shares").cast("int") - 1)).alias("salt"), F.col("head").alias("place"))
    uses = member.unionByName(heads).select("place.file", "place.row", F.col("head.file").alias("head_file"), F.col("head.row").alias("head_row"), "salt")
    wanted = Facts.save(uses, ws, f"{name}-wanted", size)
    sets = texts.mapInArrow(_sets(k, wanted), "head_file long, head_row long, salt int, file long, row long, grams binary")
    by_head = sets.repartition("head_file", "head_row", "salt").sortWithinPartitions("head_file", "head_row", "salt", F.expr("file <> head_file or row <> head_row"), "file", "row")
    tested = by_head.mapInArrow(_verify(num, den), "head_file long, head_row long, file long, row long, linked boolean")
    return ws.save(tested.select(F.struct(F.col("head_file").alias("file"), F.col("head_row").alias("row")).alias("head"), place().alias("place"), "linked"), f"{name}-tested")


def _classes(texts: DataFrame, ws: Workspace, k: int, num: int, den: int) -> tuple[DataFrame, int]:
    """(id, file, row, n, least) of each row of (id, text, file, row), and the number of rows; least is (no_id, id, file, row) of the class's row of least id, null for an empty set."""
    fields = StructType([texts.schema["id"], *StructType.fromDDL("file long, row long, n long, digest binary").fields])
    rows = ws.save(texts.mapInArrow(_scan(k), fields), "rows")
    own = F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row")
    nodes = ws.save(rows.where("digest is not null").groupBy("digest").agg(F.min(own).alias("least"), F.max("n").alias("n")), "nodes")
    size, grams = rows.count(), nodes.agg(F.sum("n")).first()[0] or 0
    texts = texts.select("text", "file", "row")
    copies = rows.select("file", "row").join(nodes.select("least.file", "least.row"), ["file", "row"], "left_anti")
    copies = Facts.save(copies, ws, "copies", size)
    bits = min(64, max(grams, 1).bit_length() + SPARE_BITS)
    range_bits = max(0, math.ceil(math.log2(max(grams, 1) / RANGE_GRAMS)))
    asked = texts.mapInArrow(_requests(k, bits, range_bits, copies), "part int, file long, row long, grams binary, counts binary")
    asked = asked.repartition(2**range_bits, "part").sortWithinPartitions("part")
    rarity = Facts.save(asked.mapInArrow(_count, "file long, row long, part int, grams binary, levels binary"), ws, "rarity", size, "part", each=RARITY_ROWS)
    posts = texts.mapInArrow(_postings(k, num, den, bits, range_bits, copies, rarity), "gram long, salt int, file long, row long, n long, pos long")
    posts = ws.save(_matchable(posts, num, den), "posts")
    ws.drop("rarity", "copies")
    tested = _verified(_hub_pairs(posts, num, den), texts, size, ws, "hub", k, num, den)
    edge = lambda t: t.where("linked").select(F.col("head").alias("a"), F.col("place").alias("b"))
    roots = connected_components(edge(tested), ws, "near").withColumnRenamed("node", "place")
    more = _verified(_open_pairs(posts, roots, tested, ws, num, den), texts, size, ws, "open", k, num, den)
    roots = connected_components(roots.select(F.col("place").alias("a"), F.col("root").alias("b")).unionByName(edge(more)), ws, "all")
    nodes = nodes.withColumn("node", F.struct("least.file", "least.row")).join(roots, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root"))
    nodes = ws.save(nodes, "rooted-nodes")
    # both sides of the joins below are shuffled, so that Spark can split what a large class or a frequent set has on the left
    least = ws.save(nodes.groupBy("root").agg(F.min("least").alias("class")), "least")
    nodes = ws.save(nodes.join(least, "root").select("digest", F.col("class").alias("least")), "classes")
    ws.drop("posts", "rooted", "mixed", "open", "hub-pairs", "open-pairs", "hub-wanted", "open-wanted", "hub-tested", "open-tested", "nodes", "rooted-nodes", "least")
    return rows.join(nodes, "digest", "left").select("id", "file", "row", "n", "least"), size


def ngram_jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of at least threshold[0]/threshold[1].

    Returns id_col, n_shingles (the size of the document's set) and component_id
    (the least id that links reach, its own included), a row for each input row.
    Words are compared with A-Z lowered.  A document of fewer than k words has
    its whole sequence as one n-gram; a null text, or one without words, has the
    empty set, links with nothing and is its own class.  Rows that repeat an id
    are documents of their own, each with the component of its text; a null id
    never becomes a component_id unless all rows of the class have it.  Other
    columns are ignored, whatever their names.  A table that is no plain scan of
    Parquet files is written to the workspace first; an empty one gives an empty
    result.
    """
    ws = Workspace(docs.sparkSession, "ngram-join")
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out, _ = _classes(placed(docs, ws).select("doc.id", "doc.text", "file", "row"), ws, k, *threshold)
    own = F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("least.id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """One row of docs of each class of ngram_jaccard_join, that with the least id; all columns stay.

    Of rows that repeat the least id one stays; a null id stays only where all
    of its class have it.  Rows without words all stay.  The rows are dropped
    where they are read: only their places are shuffled.
    """
    ws = Workspace(docs.sparkSession, "one-of-each")
    whole = placed(docs, ws)
    out, size = _classes(whole.select(column_of(whole, id_col).alias("id"), column_of(whole, text_col).cast("string").alias("text"), "file", "row"), ws, k, *threshold)
    copies = out.where("least is not null and (file <> least.file or row <> least.row)").select("file", "row")
    copies = Facts.save(copies, ws, "dropped", size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~copies.holds(*places(batch)))).select(["doc"])

    return whole.mapInArrow(run, StructType([whole.schema["doc"]])).select("doc.*")


#: The same rows by all pairs of documents with a common n-gram, and the closure of their links.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS gram
  FROM w),
n AS (SELECT doc_id, count(gram)::BIGINT AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * both_ >= 75 * (nx.n + ny.n - both_)),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT n.doc_id, n.n AS n_shingles, min(r.y) AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY ALL
"""
