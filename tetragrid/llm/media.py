"""Media columns: payloads as grey PNG images in tar shards, addressed by content.

A payload of a multiple of 64 bytes is an image 64 samples wide.  Of equal
payloads one is stored, that of the least place, which is decided on digests
alone; a task writes those of its rows to tar shards of its own, each image under
the digest of its bytes, each shard under the name of its first image.  So no
payload is shuffled, a digest has one address, and the address is the same
whenever the table is cut the same way.  Rows carry digest, shard, offset and
length.  Metadata columns need the first bytes of each range only.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import Facts, column_of, placed, places
from .store import Ranges, Roller
from .workspace import Workspace

WIDTH, TAR_BLOCK = 64, 512
SHARD_BYTES = 32 << 20
LEVEL = 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = len(SIGNATURE) + 25


def padded(data: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of the width."""
    return data + bytes((-len(data) % WIDTH) if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(payload: bytes) -> bytes:
    """An 8-bit grey image, its lines unfiltered."""
    lines = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth, from the first bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not an image")
    return struct.unpack(">IIB", head[16:25])


def samples(image: bytes) -> bytes:
    """The samples of an image that png() wrote."""
    width, height, _ = png_header(image)
    at, packed = len(SIGNATURE), []
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + size]
        if struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not read")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Sixteen hex digits: which of 8 x 8 equal areas of the image are brighter than the mean area."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(np.float64)
    columns = lines.reshape(len(lines), 8, WIDTH // 8).mean(2)
    cut = [i * len(lines) // 8 for i in range(9)]
    areas = np.stack([columns[min(a, len(lines) - 1) : max(b, a + 1)].mean(0) for a, b in zip(cut, cut[1:])])  # noqa: B905
    bits = (areas > areas.mean()).ravel()
    return np.packbits(bits).tobytes().hex()


STORED = "key string, digest string, shard string, offset long, length long"


def payload_key(text: Column) -> Column:
    """The digest of a text's payload: of its bytes, padded."""
    data = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    size = F.greatest(F.lit(WIDTH), F.ceil(F.octet_length(data) / WIDTH) * WIDTH).cast("int")
    return F.sha2(F.rpad(data, size, F.lit(b"\0")), 256)


def store_media(rows: DataFrame, folder: str, copies: Facts | None = None, *, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, digest, shard, offset, length) of each image; run it once and keep the rows.

    Rows at the places of copies (then rows has file and row) are passed over. A
    null text is empty.  Memory holds one image, and the digests of one shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tar, placed_here = Roller(folder, ".tar", shard_bytes), set()
        for batch in batches:
            if copies is not None:
                batch = batch.filter(pa.array(~copies.holds(*places(batch))))
            out = []
            for cell in batch.column(0).cast(pa.large_binary()):
                payload = padded(cell.as_py() or b"")
                key, image = hashlib.sha256(payload).hexdigest(), png(payload)
                if key in placed_here:
                    continue
                digest = hashlib.sha256(image).hexdigest()
                if tar.full():
                    tar.close(bytes(2 * TAR_BLOCK))
                shard, at, new = tar.place(digest)
                if new:
                    placed_here = set()
                placed_here.add(key)
                name = tarfile.TarInfo(f"{digest}.png")
                name.size = len(image)
                tar.write(name.tobuf(tarfile.USTAR_FORMAT))
                out.append((key, digest, shard, tar.at, len(image)))
                tar.write(image + bytes(-len(image) % TAR_BLOCK))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "digest", "shard", "offset", "length"])
        tar.close(bytes(2 * TAR_BLOCK))

    place = [] if copies is None else ["file", "row"]
    return rows.select(F.col(text_col).cast("string").alias("text"), *place).mapInArrow(run, STORED)


def _spread(stored: DataFrame) -> DataFrame:
    """Rows of one shard together, in order; an explicit number of partitions, since the rows are small and what they point to is not."""
    parts = max(int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")), stored.select("shard").distinct().count())
    return stored.repartition(parts, "shard").sortWithinPartitions("shard", "offset")


def media_headers(stored: DataFrame) -> DataFrame:
    """The rows of store_media with width, height and bit_depth, from a read of each range's first bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges()
        for batch in batches:
            rows = [png_header(files.read(shard, offset, HEADER_BYTES)) for shard, offset in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            more = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "width", "height", "bit_depth"])
        files.close()

    return _spread(stored).mapInArrow(run, f"{STORED}, width long, height long, bit_depth long")


def media_features(headers: DataFrame) -> DataFrame:
    """For each row of media_headers, in its order, what its stored bytes hold, and its place and header columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges()
        for batch in batches:
            rows = []
            for digest, shard, offset, length, *head in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length", "width", "height", "bit_depth")), strict=True):
                image = files.read(shard, offset, length)
                if hashlib.sha256(image).hexdigest() != digest:
                    raise ValueError(f"{shard} at {offset} does not hold {digest}")
                if png_header(image) != tuple(head):
                    raise ValueError(f"{shard} at {offset} has not the header that was read")
                payload = samples(image)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), digest, feature(payload)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            more = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *more, *map(batch.column, place)], ["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *place])
        files.close()

    place = ("height", "width", "bit_depth", "shard", "offset", "length")
    return headers.mapInArrow(run, "key string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height long, width long, bit_depth long, shard string, offset long, length long")


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stores docs' texts; for each row its address with header columns, and these with the features of the stored bytes.

    A null or empty text is stored as 64 bytes 0.  Rows with equal payloads have
    one address.  Rows that repeat an id, or have none, each have their own
    text's values; other columns are ignored, whatever their names; an empty
    table gives empty ones.  What is joined is ids, digests and addresses.
    """
    ws = Workspace(docs.sparkSession, "media")
    whole = placed(docs.select(id_col, text_col), ws)
    rows = whole.select(column_of(whole, id_col).alias("id"), column_of(whole, text_col).cast("string").alias("text"), "file", "row")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    keys = ws.save(rows.select("id", size.alias("n_bytes"), payload_key(F.col("text")).alias("key"), "file", "row"), "keys")
    first = keys.groupBy("key").agg(F.min(F.struct("file", "row")).alias("first"))
    copies = keys.select("file", "row").join(first.select("first.file", "first.row"), ["file", "row"], "left_anti")
    stored = ws.save(store_media(rows, f"{ws.base}/shards", Facts.save(copies, ws, "copies", keys.count())), "stored")
    headers = media_headers(stored)
    owners = keys.select(F.col("id").alias(id_col), "n_bytes", "key")
    # both sides are shuffled by key; Spark splits what a frequent payload has on the left
    return owners.join(headers, "key").drop("key"), owners.join(media_features(headers), "key").drop("key")
