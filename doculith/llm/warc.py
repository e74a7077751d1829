"""WARC archives: records written per capture, read back, and joined into transactions through WARC-Concurrent-To."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doculith.llm.common import cut, lean, remove_folder, shared_folder, small_batches

CRLF = "\r\n"
#: Records per archive file; a reader streams them.
RECORDS_PER_FILE = 6_000
#: Archives are read in pieces between these bytes: the blank line behind a block, and the begin of the next record.
VERSION = b"WARC/"
SEAM = CRLF.encode() * 2 + VERSION
#: The RFC 4648 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1: each 10 hex digits are 8 digits to the base of 32, renamed."""
    hexed = F.sha1(payload)
    eights = [F.lpad(F.conv(F.substring(hexed, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*eights), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record_id(kind: str, *parts: Column) -> Column:
    """A name-based urn:uuid of the capture, the same in every run."""
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _record(kind: Column, uri: Column, rid: Column, date: str, content_type: str, block: Column, extra: list[tuple[str, Column]]) -> Column:
    lines = [F.concat(F.lit("WARC/1.1" + CRLF + "WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), uri), F.lit(f"Content-Type: {content_type}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in extra]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)  # concat_ws leaves out null lines


def roles(rows: DataFrame, least_bytes: int) -> DataFrame:
    """(pid, uri, digest, bytes, copies, lead, first) for each distinct row (pid, uri, digest, bytes).

    Of the captures with one payload of at least `least_bytes`, that with the largest page id is the response, of
    several the one with the largest uri, of equal rows one; `lead` marks its row, `first` names it for the others.
    """
    each = cut(rows.groupBy("pid", "uri", "digest", "bytes").agg(F.count("*").alias("copies")))
    large = F.col("bytes") >= least_bytes
    first = each.where(large).groupBy(F.col("digest").alias("d")).agg(F.max(F.struct("pid", "uri")).alias("first"))
    joined = each.join(first, F.col("digest") == F.col("d"), "left").drop("d")
    is_first = F.coalesce(F.col("pid").eqNullSafe(F.col("first.pid")) & (F.col("uri") == F.col("first.uri")), F.lit(False))
    return joined.withColumn("lead", is_first & large)


def write(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Three records for each row of pages: request, response or revisit, and metadata with the page's id; gzip text files in `folder`.

    A null payload is empty, a null url an empty target. Control characters and spaces in a url are escaped. Equal rows
    are numbered, so that each has records of its own.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    pages = pages.select(F.col(id_col).alias("pid"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7f]", "%20").alias("uri"), html.alias("html"))
    pages = pages.withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    role = cut(roles(pages.select("pid", "uri", "digest", F.octet_length("html").cast("long").alias("bytes")), least_bytes))
    shares = F.col("first").isNotNull()
    # Payloads go to the rows that are written as responses alone; equal rows give theirs once.
    full = role.where(F.col("lead") | ~shares).select(F.col("pid").alias("p"), F.col("uri").alias("u"), F.col("digest").alias("d"), "bytes", "copies", "lead", "first")
    same = pages["pid"].eqNullSafe(full["p"]) & (pages["uri"] == full["u"]) & (pages["digest"] == full["d"])
    found = pages.join(full, same).drop("p", "u", "d")
    if not role.where("copies > 1").isEmpty():
        repeated = found.where("copies > 1").groupBy("pid", "uri", "digest", "bytes", "copies", "lead", "first").agg(F.min("html").alias("html"))
        found = found.where("copies = 1").unionByName(repeated)
    responses = found.withColumn("no", F.explode(F.when(F.col("lead"), F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), "copies"))))
    revisits = role.where(shares).withColumn("begin", F.when(F.col("lead"), F.lit(2)).otherwise(F.lit(1)).cast("long")).where("copies >= begin")
    revisits = revisits.withColumn("no", F.explode(F.sequence("begin", "copies"))).drop("begin").withColumn("html", F.lit(None).cast("string"))
    rows = responses.unionByName(revisits)
    revisit = F.col("html").isNull()
    kind = F.when(revisit, "revisit").otherwise("response")
    rid = lambda name: record_id(name, F.col("pid"), F.col("uri"), F.col("digest"), F.col("no"))
    main, digest = rid("response"), F.concat(F.lit("sha1:"), F.col("digest"))
    origin = record_id("response", F.col("first.pid"), F.col("first.uri"), F.col("digest"), F.lit(1))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    host = F.regexp_extract("uri", r"^[^:]*://([^/?#]*)", 1)
    concurrent = [("WARC-Concurrent-To", main)]
    records = F.array(
        _record(F.lit("request"), F.col("uri"), rid("request"), date, "application/http; msgtype=request", F.concat(F.lit("GET "), F.col("uri"), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)), concurrent),
        _record(kind, F.col("uri"), main, date, "application/http; msgtype=response", F.when(revisit, head).otherwise(F.concat(head, F.col("html"))), [("WARC-Payload-Digest", digest), ("WARC-Refers-To", F.when(revisit, origin)), ("WARC-Profile", F.when(revisit, F.lit(PROFILE)))]),
        _record(F.lit("metadata"), F.col("uri"), rid("metadata"), date, "application/warc-fields", F.concat(F.lit("page-id: "), F.coalesce(F.col("pid").cast("string"), F.lit("")), F.lit(CRLF)), concurrent),
    )
    rows.select(F.explode(records).alias("value")).write.mode("overwrite").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def number(text: str | bytes | None) -> int | None:
    """A header's decimal number; null if it is none."""
    text = text.decode("ascii", "replace") if isinstance(text, bytes) else text or ""
    return int(text) if text.strip().isascii() and text.strip().isdigit() and len(text) < 19 else None


def headers_of(head: bytes) -> dict[str, list[str]]:
    """The values of a record's headers, by lower-cased name."""
    headers: dict[str, list[str]] = {}
    for line in head.decode("utf-8", "replace").split(CRLF)[1:]:
        name, _, value = line.partition(":")
        headers.setdefault(name.strip().lower(), []).append(value.strip())
    return headers


class Assembler:
    """Records from pieces of archives, which Spark cuts at every SEAM: a block that holds one is put together again.

    At most one record is held. A record is complete when it has as many bytes as Content-Length says; without a
    length that can be read it ends with its piece. What is cut off at a file's end is given as far as it goes.
    """

    def __init__(self):
        self.path, self.held, self.size, self.wanted = None, [], 0, 0

    def add(self, path: str, piece: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
        if path != self.path:
            yield from self.end()
            self.path = path
            self.held.append(piece[max(0, piece.find(VERSION)) :])  # of the first record of a file the seam has taken nothing
        else:
            self.held.append((SEAM if self.held else VERSION) + piece)
        self.size += len(self.held[-1])
        if len(self.held) == 1 or self.size >= self.wanted:
            yield from self.check()

    def check(self) -> Iterator[tuple[dict[str, list[str]], bytes]]:
        record = b"".join(self.held)
        while True:
            end = record.find(CRLF.encode() * 2)
            headers = headers_of(record if end < 0 else record[:end])
            length = number(headers.get("content-length", [None])[0])
            at = len(record) if end < 0 else end + 4
            self.held, self.wanted = [record], at + (length or 0)
            if length is not None and len(record) < self.wanted:
                return
            self.held, self.size = [], 0
            yield headers, record[at:] if length is None else record[at : self.wanted]
            # A reader may miss a seam that begins inside of what looked like one; the next record then stands in this piece.
            if length is None or not record.startswith(SEAM, self.wanted):
                return
            record = record[self.wanted + len(SEAM) - len(VERSION) :]
            self.size = len(record)

    def end(self) -> Iterator[tuple[dict[str, list[str]], bytes]]:
        if self.held:
            record = b"".join(self.held)
            head, _, block = record.partition(CRLF.encode() * 2)
            yield headers_of(head), block
        self.held, self.size = [], 0


RECORD = "record_id string, type string, uri string, concurrent_to string, refers_to string, digest string, payload_bytes bigint, payload binary, page_id bigint"
_RECORD = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("page_id", pa.int64())])


def _row(headers: dict[str, list[str]], block: bytes, payloads: bool) -> dict:
    get = lambda name: headers.get(name, [None])[0]
    row = {"record_id": get("warc-record-id"), "type": get("warc-type"), "uri": get("warc-target-uri"), "concurrent_to": get("warc-concurrent-to"), "refers_to": get("warc-refers-to")}
    if row["type"] in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        if row["type"] == "response":
            row |= {"digest": base64.b32encode(hashlib.sha1(body).digest()).decode(), "payload_bytes": len(body), "payload": body if payloads else None}
        else:
            lengths = [x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            row |= {"digest": (get("warc-payload-digest") or "").removeprefix("sha1:") or None, "payload_bytes": number(lengths[0]) if lengths else None}
    elif row["type"] == "metadata":
        found = [x.partition(b":")[2] for x in block.split(b"\r\n") if x.startswith(b"page-id:")]
        sign = -1 if found and found[0].strip().startswith(b"-") else 1
        n = number(found[0].strip().lstrip(b"-")) if found else None
        row["page_id"] = n if n is None else sign * n
    elif row["type"] == "request" and payloads:
        row["payload"] = block
    return row


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the gzip archives in `folder`. A response's digest and size are those of the bytes that were read.

    Spark streams the files in pieces, so a task holds one record and one batch, however large a file is. Headers that
    cannot be read are null.
    """

    def run(batches):
        records, rows, size = Assembler(), [], 0

        def flush():
            return pa.RecordBatch.from_pylist(rows, _RECORD)

        def found():
            for b in batches:
                for path, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    raw = value.as_buffer()
                    yield from records.add(path, raw.to_pybytes() if raw is not None else b"")
            yield from records.end()

        for headers, block in found():
            rows.append(_row(headers, block, payloads))
            size += len(block) if payloads else 0
            if len(rows) >= 5000 or size > 1 << 23:
                yield flush()
                rows, size = [], 0
        if rows:
            yield flush()

    pieces = spark.read.option("lineSep", SEAM.decode()).option("pathGlobFilter", "part-*").text(folder)
    return pieces.select("_metadata.file_path", "value").mapInArrow(lean(run), RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, request, response, metadata), joined through WARC-Concurrent-To.

    Requests and metadata name their response or revisit; a response that names its request instead is found
    from there. What is missing is null; of several records of one kind the least record id stays. Records
    without any link form captures of their own.
    """
    main = F.col("type").isin("response", "revisit")
    # A response may point at its request: the request then takes the response's id as its capture.
    pointed = records.where(main & F.col("concurrent_to").isNotNull()).select(F.col("concurrent_to").alias("request_id"), F.col("record_id").alias("response_id")).groupBy("request_id").agg(F.min("response_id").alias("response_id"))
    keyed = records.join(pointed, records["record_id"] == pointed["request_id"], "left")
    capture = F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "response_id", "record_id"))
    body = F.struct(*[c for c in records.columns])
    pick = lambda cond: F.min_by(F.when(cond, body), F.when(cond, F.col("record_id")))
    return keyed.groupBy(capture.alias("capture_id")).agg(pick(F.col("type") == "request").alias("request"), pick(main).alias("response"), pick(F.col("type") == "metadata").alias("metadata"))


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes the pages, reads the archives and returns (page_id, payload_bytes, payload_digest, record_type, refers_to, uri) for each row.

    Repeated rows come back as often as they are there: one of them is the response, the others revisit it, also within
    one page_id. A null page_id stays null and counts as the smallest; what revisits such a response has a null
    refers_to. A null html has the digest of no bytes. An empty table gives no row; other columns are not read.
    Without a folder the archives go to one of their own in the shared folder, which is deleted when they have been read.
    """
    spark = pages.sparkSession
    own = folder or scratch(spark)
    write(pages, own, least_bytes=least_bytes)
    captures = transactions(read(spark, own, payloads=False)).where(F.col("response").isNotNull())
    rows = captures.select("capture_id", F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("target"), F.col("response.uri").alias("uri"))
    with small_batches(spark):
        rows = cut(rows)  # the archives are read once, and a payload that many pages share is split in the join
    if folder is None:
        remove_folder(spark, own)
    firsts = rows.where(F.col("record_type") == "response").select(F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to"))
    return rows.join(firsts, "target", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri")
