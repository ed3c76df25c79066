"""WARC writing and transaction assembly.

Writer: every page becomes a response or revisit record, a request and a metadata record that name the first through
WARC-Concurrent-To. Of equal payloads (SHA-256 and length) of at least ``min_revisit_bytes`` bytes the one with the smallest page_id
is the response. Records are built of SQL expressions; each is a gzip member of its own, so it can be read alone from its offset.
Archives of about ``file_bytes`` bytes are written by Spark's text writer, so they can lie in any store that Spark writes to.

Reader: archives come as binary files; records are cut out by Content-Length while unpacking in pieces, payloads are digested, and the
records of a capture are joined through their concurrent-to identifiers into one nested row. ``record_at`` reads one record alone.

Defined cases: null html is an empty payload; null urls leave the target empty; line breaks in urls are percent-encoded; rows without
page_id are dropped; an exact repeat of a row is one capture; an empty table gives empty archives and no rows; further columns
are ignored; a cut-off or foreign archive raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark_util import bounded_join, map_arrow, materialize, with_id

#: Fixed values of the format.
VERSION, CRLF = "WARC/1.1", "\r\n"
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2000-01-01T00:00:00Z"
#: Packed bytes after which an archive file is closed; a record that is larger is a file of its own.
FILE_BYTES = 16 << 20
_PIECE, _SLICE = 1 << 20, 4096
#: The last byte of a gzip member is the highest one of its length, 0 below 16 MB. Spark's text writer ends each value with a
#: separator, so this byte is written as the separator; an empty member behind a longer record makes it 0 there too.
_LAST = "\0"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hex digits are eight times 20 bits, so eight times four base32 digits."""
    hexa = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexa, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _uuid(kind: str, page_id: Column | None = None, url: Column | None = None) -> Column:
    """A record's id, by rule from its page, payload digest and url."""
    page_id, url = F.col("page_id") if page_id is None else page_id, F.col("url") if url is None else url
    h = F.md5(F.concat_ws("/", F.lit(kind), page_id.cast("string"), F.col("digest"), url).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind, record_id, fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record: its header lines, an empty line, its block."""
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def member(record: bytes) -> bytes:
    """A record as a gzip member whose last byte is 0."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    return out if out[-1] == 0 else out + zlib.compressobj(6, zlib.DEFLATED, 31).flush()


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write WARC files of ``pages`` (page_id, url, html) under ``path``."""
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    rows = with_id(pages, "page_id").select("page_id", url.alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("n", F.octet_length("payload"))
    # only digests of repeated payloads are gathered and joined back; the text is shuffled where they exceed the broadcast bound
    rows = rows.withColumn("same", F.unhex(F.sha2(F.col("payload").cast("binary"), 256)))
    first = rows.where(F.col("n") >= min_revisit_bytes).groupBy("same", "n").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("copies"))
    repeated = materialize(first.where("copies > 1").select("same", "n", "first"), "digests")
    rows = bounded_join(rows, repeated, ["same", "n"], "left", 160)
    revisit = F.col("first").isNotNull() & (F.col("first.page_id") < F.col("page_id"))
    main = _uuid("capture")
    target_id = _uuid("capture", F.col("first.page_id"), F.col("first.url"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    target = ("WARC-Target-URI", F.col("url"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    response = _record(F.lit("response"), main, [target, digest, ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.col("payload")))
    again = _record(F.lit("revisit"), main, [target, digest, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", target_id), ("WARC-Refers-To-Target-URI", F.col("first.url")), ("Content-Type", F.lit("application/http; msgtype=response"))], http)
    asked = F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    request = _record(F.lit("request"), _uuid("request"), [target, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http; msgtype=request"))], asked)
    fields = F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit(CRLF))
    metadata = _record(F.lit("metadata"), _uuid("metadata"), [target, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))], fields)
    records_ = rows.select(F.when(revisit, again).otherwise(response).alias("main"), request.alias("request"), metadata.alias("metadata"))

    def pack(batches):
        held, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                for k in range(3):
                    held.append(member(b.column(k)[i].as_buffer().to_pybytes() + RECORD_END.encode()))
                    size += len(held[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["file"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["file"])

    packed = map_arrow(records_, pack, "file binary").select(F.col("file").cast("string").alias("value"))
    packed.write.option("lineSep", _LAST).option("compression", "none").option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def _inflate(content: bytes, at: int) -> Iterator[tuple[bytes, int]]:
    """(piece, 0) for the pieces of the gzip member at ``at``, then (b"", its end). Input is fed in small slices, so that none is copied twice."""
    z, view = zlib.decompressobj(31), memoryview(content)
    while not z.eof:
        if at >= len(content):
            raise ValueError("the archive is cut off")
        piece = z.decompress(view[at : at + _SLICE], _PIECE)
        at = min(at + _SLICE, len(content))
        yield piece, 0
        while z.unconsumed_tail:
            yield z.decompress(z.unconsumed_tail, _PIECE), 0
    yield b"", at - len(z.unused_data)


def unpacked(content: bytes) -> Iterator[bytes]:
    """Pieces of a gzip file of any number of members, or of plain data."""
    if content[:2] != b"\x1f\x8b":
        for i in range(0, len(content), _PIECE):
            yield content[i : i + _PIECE]
        return
    at = 0
    while at < len(content):
        for piece, end in _inflate(content, at):
            if piece:
                yield piece
        at = end


def record_at(content: bytes, offset: int) -> tuple[dict[str, str], bytes]:
    """The record whose gzip member begins at ``offset``, without unpacking any other."""
    return next(records(b"".join(piece for piece, _ in _inflate(content, offset))))


def members(content: bytes) -> Iterator[tuple[int, int]]:
    """(offset, packed bytes) of every gzip member of an archive."""
    at = 0
    while at < len(content):
        for _, end in _inflate(content, at):
            pass
        yield at, end - at
        at = end


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record of an archive."""
    pieces, have = unpacked(content), bytearray()

    def need(n: int) -> bool:
        while len(have) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            have.extend(piece)
        return True

    while True:
        while need(1) and have[:1] in (b"\r", b"\n"):
            del have[:1]
        if not need(1):
            return
        while (end := have.find(b"\r\n\r\n")) < 0:
            if not need(len(have) + 1):
                raise ValueError("a record's header is cut off")
        lines = bytes(have[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        if not need(end + 4 + n):
            raise ValueError("a record's block is cut off")
        yield fields, bytes(have[end + 4 : end + 4 + n])
        del have[: end + 4 + n]


_FIELDS = "type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_bytes long, payload_digest string, page_id long, http_header string, payload binary"


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row a record; payloads of responses are digested here and, unless ``payloads``, not passed on."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in _FIELDS.split(", ")]

    def row(fields: dict[str, str], block: bytes):
        kind = fields["warc-type"]
        size = digest = page = payload = None
        head, _, body = block.partition(b"\r\n\r\n")
        if kind == "response":
            payload, size = body, len(body)
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            if digest != fields["warc-payload-digest"].removeprefix("sha1:"):
                raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
        elif kind == "revisit":
            digest = fields["warc-payload-digest"].removeprefix("sha1:")
            size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        elif kind == "metadata":
            page = next((int(x.split(":")[1]) for x in block.decode().split("\r\n") if x.lower().startswith("pageid:")), None)
        http = head.decode() if kind in ("response", "revisit", "request") else None
        return kind, fields["warc-record-id"], fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), size, digest, page, http, payload if payloads else None

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for fields, block in records(content.as_py()):
                    rows.append(row(fields, block))
                    held += len(block)
                    if len(rows) >= 2000 or held >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return map_arrow(files, run, _FIELDS)


def assemble(recs: DataFrame) -> DataFrame:
    """One nested row a capture: the main record with the request and metadata that are concurrent to it.

    Records of a capture meet on the identifier that their concurrent-to field names (a main record's own id); a partial aggregate
    runs before the shuffle. Of several requests or metadata records the one with the smallest id stands.
    """
    part = F.struct("record_id", "type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "http_header", "payload")
    other = F.struct("record_id", "target_uri", "http_header", "page_id")
    by = recs.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id"))
    return by.agg(F.min_by(F.when(F.col("type").isin("response", "revisit"), part), F.when(F.col("type").isin("response", "revisit"), F.col("record_id"))).alias("main"), F.min(F.when(F.col("type") == "request", other)).alias("request"), F.min(F.when(F.col("type") == "metadata", other)).alias("metadata")).where("main is not null")
