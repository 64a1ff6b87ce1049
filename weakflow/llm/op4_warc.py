"""WARC archives with segmented records and chunked transfer framing.

``write_archive`` writes one record per page as gzipped WARC 1.1 files in the shared folder,
through Spark's text writer (whose line separator ends a record), so the files are committed
task by task and lie where all executors see them. A response is an HTTP message in chunked
framing; a message longer than ``SEGMENT_BYTES`` is written as a first segment and
continuation records that name it by ``WARC-Segment-Origin-ID``. A page whose payload equals
that of a page with a larger id is a revisit record that names the record of that page.

``read_archive`` parses the files record by record, whatever the payloads contain. Segments
are grouped by their origin, put in order by number, and their total length is verified; then
the chunked framing is decoded, length and digest are taken from the decoded payload, and the
digest is compared with the recorded one. ``status`` says ``ok`` or what does not fit: a changed
record, missing or wrong segments, and an archive that ends or breaks inside a record, whose
records before that place are read. ``read_payloads`` also returns the payloads.

Every row is stored with a number of its own first, so record ids are unique and a revisit names a
record that exists. A NULL html is an empty payload; a NULL url is left out of the record. Ids may be
of any type that can be cast to a string and back. Equal rows stay separate records. Of equal large
payloads, all rows with the largest id are responses, and revisits name one of them; rows without an id
are always responses. Cuts are made between characters, never inside one. Very long pages are cut into
segments; other columns are not read, whatever their names. An empty table gives no records. A file of
the archive is one gzip member, as Spark's writer makes it.
"""

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weakflow.operators.joins import spread_left_join
from weakflow.sources.staging import new_path, stage

REVISIT_FROM = 1000  # smaller payloads are always written whole
SEGMENT_BYTES = 48 << 10
CHUNK_BYTES = 8 << 10
RECORDS_PER_FILE = 500  # bounds what a reading task decompresses at once
_END = "\r\n\r\n"
_DATE = "2025-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def pieces(data: bytes, limit: int) -> list[bytes]:
    """UTF-8 text in pieces of at most ``limit`` bytes (at least one character each)."""
    out, at = [], 0
    while at < len(data):
        to = min(at + limit, len(data))
        while to < len(data) and data[to] & 0xC0 == 0x80 and to > at + 1:
            to -= 1
        while to < len(data) and data[to] & 0xC0 == 0x80:  # one character longer than the limit
            to += 1
        out.append(data[at:to])
        at = to
    return out


def chunked(payload: bytes, limit: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in pieces(payload, limit)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body (chunk extensions and trailers are passed over)."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        begin = line + 2
        if body[begin + size : begin + size + 2] != b"\r\n":
            raise ValueError("chunk without an end")
        out.append(body[begin : begin + size])
        at = begin + size + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def record_name(page: str | None, number: int) -> str:
    """The id of the record of a row; a page without an id leaves its place empty."""
    return f"urn:page:{'' if page is None else 'p' + quote(page, safe='')}:{number}"


def page_of(name: str) -> str | None:
    """The page that a record id names."""
    part = name.strip("<>").split(":")[2]
    return unquote(part[1:]) if part else None


def page_records(
    page: str | None, number: int, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment: int
) -> list[bytes]:
    """The records of one page, without the separator that ends a record; ``refers_to`` is the name of
    another record."""
    name = record_name(page, number)
    given = [("WARC-Date", _DATE), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        given.append(("WARC-Target-URI", re.sub(r"[\r\n]", " ", url)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload)
        about = [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", _PROFILE), kind]
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), *given, *about], block)]
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), *given, kind]
    if len(block) <= segment:
        return [_record(first, block)]
    blocks = pieces(block, segment)
    out = [_record([*first, ("WARC-Segment-Number", "1")], blocks[0])]
    for i, b in enumerate(blocks[1:], 2):
        more = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<{name};segment={i}>"),
            ("WARC-Date", _DATE),
            ("WARC-Segment-Number", str(i)),
            ("WARC-Segment-Origin-ID", f"<{name}>"),
        ]
        if i == len(blocks):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(more, b))
    return out


def with_revisits(pages: DataFrame) -> DataFrame:
    """Adds refers_to and refers_number, the page and number of the row that a row repeats, to stored
    rows (number, page, payload, digest).

    Groups of equal payloads are counted before any shuffle of rows, and only numbers, ids and digests
    are joined by digest, a hot one in parts; the payloads move once, by their numbers.
    """
    large = pages.filter((F.octet_length("payload") >= REVISIT_FROM) & F.col("page").isNotNull())
    large = large.select("number", "page", "digest")
    greatest = F.max(F.struct("page", (-F.col("number")).alias("low"))).alias("last")
    last = large.groupBy("digest").agg(greatest, F.count(F.lit(1)).alias("n")).filter("n > 1")
    last = stage(last.select("digest", F.col("last.page").alias("refers_to"), (-F.col("last.low")).alias("refers_number")), "warc-last")
    again = spread_left_join(large, last, "digest", right_unique=True).filter(F.col("page") < F.col("refers_to"))
    again = stage(again.select("number", "refers_to", "refers_number"), "warc-revisits")
    return pages.join(again, "number", "left")


def write_archive(
    df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", segment: int = SEGMENT_BYTES
) -> str:
    """Write the pages; the folder of the archives is returned."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("number", "page", "url", "payload", "digest", "refers_to", "refers_number")
        for batch in batches:
            out: list[bytes] = []
            for number, page, url, payload, digest, *of in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                refers = None if of[1] is None else record_name(*of)
                out += page_records(page, number, url, payload, digest, refers, segment)
                if len(out) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    rows = df.select(F.col(key).alias("page"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    digest = F.sha1(F.col("payload").cast("binary")).alias("digest")
    numbered = stage(rows.select(F.monotonically_increasing_id().alias("number"), "*", digest), "warc-pages")
    pages = with_revisits(numbered).select(
        "number",
        F.col("page").cast("string").alias("page"),
        "url",
        F.col("payload").cast("binary").alias("payload"),
        "digest",
        F.col("refers_to").cast("string").alias("refers_to"),
        "refers_number",
    )
    path = new_path(df.sparkSession, "warc")
    writer = pages.mapInArrow(records, "value string").write.option("lineSep", _END)
    writer.option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return path


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of an archive."""
    while True:
        line = stream.readline()
        while line == b"\r\n":
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends inside a record")
        yield fields, block


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head):
        return dechunked(body)
    return body


_PARSED = (
    "page string, record_type string, refers_to string, digest string, payload_bytes long, payload binary, "
    "origin string, number int, total long, block binary, status string"
)
CHANGED, BROKEN = "digest differs", "archive ends or breaks here"
_BREAKS = (ValueError, KeyError, TypeError, IndexError, EOFError, OSError, zlib.error)


def _parsed(fields: dict[str, str], block: bytes, keep: bool) -> dict:
    row = dict.fromkeys(re.findall(r"(\w+) \w+(?:, |$)", _PARSED))
    kind = fields["warc-type"]
    row["status"] = "ok"
    if "warc-segment-number" in fields:
        row["origin"] = fields.get("warc-segment-origin-id", fields["warc-record-id"])
        row["number"], row["block"] = int(fields["warc-segment-number"]), block
        if "warc-segment-total-length" in fields:
            row["total"] = int(fields["warc-segment-total-length"])
    if kind == "continuation":
        return row
    row["page"] = page_of(fields["warc-record-id"])
    row["record_type"] = kind
    row["digest"] = fields["warc-payload-digest"].partition(":")[2]
    if kind == "revisit":
        row["refers_to"] = page_of(fields["warc-refers-to"])
        row["payload_bytes"] = int(re.search(rb"(?i)content-length:\s*(\d+)", block)[1])
    elif row["origin"] is None:
        _decode(row, block, keep)
    return row


def _decode(row: dict, block: bytes, keep: bool) -> None:
    """Take payload, length and digest from the block, and say whether they fit the record."""
    try:
        payload = http_payload(block)
    except _BREAKS:
        row["status"], row["digest"] = "wrong chunked framing", None
        return
    found = hashlib.sha1(payload).hexdigest()
    row["status"] = "ok" if found == row["digest"] else CHANGED
    row["payload_bytes"], row["digest"], row["payload"] = len(payload), found, payload if keep else None


def _reassembled(group: pa.Table, keep: bool) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: r["number"])
    head, tail = rows[0], rows[-1]
    block = b"".join(r["block"] for r in rows)
    out = dict.fromkeys(_OUT.names) | {"page": head["page"], "record_type": head["record_type"]}
    if [r["number"] for r in rows] != list(range(1, len(rows) + 1)) or tail["total"] is None:
        out["status"] = "segments missing"
    elif tail["total"] != len(block):
        out["status"] = "wrong total length"
    else:
        out["digest"] = head["digest"]
        _decode(out, block, keep)
    return pa.Table.from_pylist([out], schema=_OUT)


_RESULT = (
    "page string, record_type string, refers_to string, digest string, payload_bytes long, payload binary, "
    "status string"
)
_OUT = pa.schema(
    [(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in
     (x.split() for x in _RESULT.split(", "))]
)


def read_payloads(spark: SparkSession, path: str, keep: bool = True) -> DataFrame:
    """(page, record_type, refers_to, digest, payload_bytes, payload, status) per page; the
    payload is left out unless ``keep``."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _parsed_schema()
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))
                found = parse_records(stream)
                while True:
                    try:
                        record = next(found, None)
                        if record is None:
                            break
                        rows.append(_parsed(*record, keep))
                    except _BREAKS:
                        rows.append(dict.fromkeys(schema.names) | {"status": BROKEN})
                        break
                    size += len(record[1])
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    parsed = stage(files.select("content").mapInArrow(records, _PARSED), "warc-records")
    whole = parsed.filter("origin IS NULL").select(
        "page", "record_type", "refers_to", "digest", "payload_bytes", "payload", "status"
    )
    split = parsed.filter("origin IS NOT NULL").groupBy("origin")
    return whole.unionByName(split.applyInArrow(lambda t: _reassembled(t, keep), _RESULT))


def _parsed_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in _PARSED.split(", "))])


def read_archive(spark: SparkSession, path: str, key: str = "page_id", key_type: str = "bigint") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to, status) per page."""
    found = read_payloads(spark, path, keep=False)
    return found.select(
        F.col("page").cast(key_type).alias(key),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(key_type).alias("refers_to"),
        "status",
    )
