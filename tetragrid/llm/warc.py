"""WARC archives: writing captures as transactions, reading them back, and assembling one nested row for each.

A capture is a request, a response (or a revisit of an equal payload) and a
metadata record; request and metadata name the response by WARC-Concurrent-To.
Each record is a gzip member of its own, so a file can be read from any record
on; tasks read stretches of files that end between transactions.

Payloads are never shuffled.  Which capture of a payload is the response is
decided on digests alone; that a row is a revisit, and of which page, is looked
up by the row's place when the table is read again to be written.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .places import Facts, column_of, placed, places
from .store import Ranges, Roller
from .workspace import Workspace

#: Payloads below this size are always responses.
REVISIT_BYTES = 1000
ARCHIVE_BYTES, STRETCH_BYTES = 64 << 20, 4 << 20
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
RECORD = "path string, record_id string, type string, concurrent_to string, refers_to string, uri string, page_id long, payload_bytes long, payload_digest string, fields map<string,string>"


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(parts))}>"


def packed(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head.encode() + block + b"\r\n\r\n") + deflate.flush()


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def transaction(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """The records of one capture."""
    own, uri = record_id("response", page_id, digest), _one_line(url)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    status = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    main = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        main += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("response", refers_to, digest))]
    body = b"" if revisit else payload
    meta = f"page_id: {'' if page_id is None else page_id}\r\n".encode()
    return b"".join(
        [
            packed([("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", page_id, digest)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")], f"GET {uri} HTTP/1.1\r\n\r\n".encode()),
            packed(main, f"{status}\r\n".encode() + body),
            packed([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", page_id, digest)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], meta),
        ]
    )


def write_archives(pages: DataFrame, revisits: Facts, folder: str, *, archive_bytes: int = ARCHIVE_BYTES, stretch_bytes: int = STRETCH_BYTES) -> DataFrame:
    """(path, offset, length) of stretches of whole transactions; run it once and keep the rows.

    pages has page_id, url, html, file and row; revisits the page (column best)
    that the row at a place is a revisit of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = Roller(folder, ".warc.gz", archive_bytes), []
        for batch in batches:
            again, best = revisits.find(*places(batch), "best")
            for page_id, url, html, revisit, of in zip(*(batch.column(i) for i in range(3)), again.tolist(), best.tolist(), strict=True):
                path, at, _ = out.place()
                payload = (html.as_py() or "").encode()
                data = transaction(page_id.as_py(), url.as_py(), payload, hashlib.sha1(payload).hexdigest(), of if revisit else None, revisit)
                out.write(data)
                if rows and rows[-1][0] == path and rows[-1][2] < stretch_bytes:
                    rows[-1][2] += len(data)
                else:
                    rows.append([path, at, len(data)])
        out.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "offset", "length"])

    return pages.select("page_id", "url", "html", "file", "row").mapInArrow(run, "path string, offset long, length long")


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of some bytes, one at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        inflate, parts, start = zlib.decompressobj(31), [], at
        while not inflate.eof:
            step = view[start : start + 65536]
            if not len(step):
                raise ValueError("a record is cut off")
            parts.append(inflate.decompress(step))
            start += len(step)
        at = start - len(inflate.unused_data)
        yield b"".join(parts)


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_records(stretches: DataFrame) -> DataFrame:
    """A row for each record; of payloads only length and digest, both computed from the bytes read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges()
        for batch in batches:
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows = []
                for record in members(files.read(path, offset, length)):
                    f, block = parsed(record)
                    kind, size, digest, page_id = f["WARC-Type"], None, None, None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        if f["WARC-Payload-Digest"] != f"sha1:{digest}":
                            raise ValueError(f"{f['WARC-Record-ID']} does not hold its digest's payload")
                    elif kind == "revisit":
                        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    elif kind == "metadata":
                        value = block.decode().removeprefix("page_id: ").strip()
                        page_id = int(value) if value else None
                    rows.append((path, f["WARC-Record-ID"], kind, f.get("WARC-Concurrent-To"), f.get("WARC-Refers-To"), f["WARC-Target-URI"], page_id, size, digest, list(f.items())))
                kinds = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())]
                names = ["path", "record_id", "type", "concurrent_to", "refers_to", "uri", "page_id", "payload_bytes", "payload_digest", "fields"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        files.close()

    parts = max(int(stretches.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return stretches.repartition(parts).mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: the response or revisit, with its request and metadata (null where missing).

    Records of one id are grouped by it, which is one capture's few records; a
    request or metadata record whose response is missing makes no row.
    """
    main = F.col("type").isin("response", "revisit")
    keyed = records.withColumn("capture", F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to"))).where("capture is not null")
    pick = lambda kind, *cols: F.max(F.when(F.col("type") == kind, F.struct(*cols))).alias(kind)
    named = F.struct("type", "record_id", "uri", "refers_to", "payload_bytes", "payload_digest")
    out = keyed.groupBy("capture").agg(F.max(F.when(main, named)).alias("response"), pick("request", "record_id", "uri"), pick("metadata", "record_id", "page_id"), F.count(F.when(main, 1)).alias("copies"))
    return out.where("response is not null").select("capture", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))), "response", "request", "metadata").drop("col")


def with_targets(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits take size and page from the record they name."""
    flat = captures.select(F.col("metadata.page_id").alias("page_id"), "capture", F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("named"), F.col("response.payload_bytes").alias("bytes"), F.col("response.payload_digest").alias("payload_digest"))
    wanted = flat.where("named is not null").select(F.col("named").alias("wanted")).distinct()
    pages = flat.where("record_type = 'response'").join(wanted, F.col("capture") == F.col("wanted"), "left_semi")
    pages = pages.select(F.col("capture").alias("at"), F.col("page_id").alias("to"), F.col("bytes").alias("to_bytes")).dropDuplicates(["at"])
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    own = flat.where("named is null").select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    # both sides are ids and digests; Spark splits what one named record has on the left
    out = flat.where("named is not null").join(pages, F.col("named") == F.col("at"), "left")
    return own.unionByName(out.select("page_id", F.coalesce("bytes", "to_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("to").alias("refers_to"))).select(*names)


def archive_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes a capture for each row, reads the archives back and returns one row for each capture.

    Of equal payloads of at least revisit_bytes the one with the largest id is
    the response.  A null html is an empty payload, a null url an empty target;
    line breaks in a url become spaces.  Rows that repeat the largest id and its
    payload are each a response; a null id ranks below all others.  Other
    columns are ignored, whatever their names; an empty table gives an empty one.
    """
    ws = Workspace(pages.sparkSession, "warc")
    whole = placed(pages.select(id_col, url_col, html_col), ws)
    cell = lambda name, kind: column_of(whole, name).cast(kind)
    rows = whole.select(cell(id_col, "long").alias("page_id"), cell(url_col, "string").alias("url"), F.coalesce(cell(html_col, "string"), F.lit("")).alias("html"), "file", "row")
    digests = ws.save(rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("bytes"), "file", "row"), "digests")
    large = digests.where(F.col("bytes") >= revisit_bytes)
    shared = large.groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1 and best is not null").select("digest", "best")
    again = large.join(shared, "digest").where(~F.col("best").eqNullSafe(F.col("page_id"))).select("file", "row", "best")
    revisits = Facts.save(again, ws, "revisits", digests.count())
    stretches = ws.save(write_archives(rows, revisits, f"{ws.base}/archives"), "stretches")
    captures = ws.save(assemble(read_records(stretches)), "captures")
    return with_targets(captures).withColumnRenamed("page_id", id_col)


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND best <> page_id THEN best END AS refers_to
FROM m
"""
