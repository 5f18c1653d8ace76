"""Legacy archive converter: ARC files of version 1 and 2 to WARC files.

ARC records are read by their version's header line and declared length, never by searching for a
delimiter. From each, WARC identifiers, timestamps, types and payload digests are synthesised: the version block
becomes warcinfo, an HTTP message a response, anything else (dns: and the like) a resource; of
responses with equal payloads the one with the smallest page id stays a response and
the others become revisits of it. The header's IP address, result code and location are kept.

Archives are gzip files written and read by Spark's own sources, so they may be in any store that Spark reaches, and
hold any bytes. Their size is bounded (ARCHIVE_BYTES, or one larger record). A directory holds the files of all
tasks that have the same number within their task, so directories stay few. Payloads are not shuffled one by
one: decisions, a few numbers a record, are gathered by archive and meet the compressed archive.

Defined results: null html is an empty payload; a null page_id is kept, sorts last among
equal payloads, and a revisit of such a page refers to null; a null URL is ``about:blank``; of rows that
repeat a page_id with equal payloads one is the response; payloads under LEAST_BYTES are
never revisits; a page id in a foreign archive that is no whole number is null; other columns are ignored; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.workers import map_arrow
from .shared import fresh_path

ARCHIVE_BYTES = 32 << 20
LEAST_BYTES = 100
#: Header fields of a record by ARC version (fixed values of the format).
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
CAPTURED = "20000101000000"


@dataclass
class Record:
    """A capture: the target, its date (14 digits), and the HTTP message, whose head is empty for other kinds.

    ``kind`` is response, resource or, for a version block, warcinfo.
    """

    url: str
    date: str
    head: bytes
    payload: bytes
    page_id: int | None
    kind: str = "response"
    ip: str = "-"
    content_type: str = "-"
    result: str = "-"
    location: str = "-"


def _http(page_id: int | None, payload: bytes) -> bytes:
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode()


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 tidewheel\n{' '.join(ARC_FIELDS[version])}\n".encode()
    head = {1: f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain {len(body)}\n", 2: f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain 200 - - 0 {name} {len(body)}\n"}[version]
    return head.encode() + body


def arc_record(version: int, url: str | None, page_id: int | None, payload: bytes, name: str) -> bytes:
    """A record without its closing line feed."""
    url = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else "about:blank"
    message = _http(page_id, payload) + payload
    if version == 1:
        return f"{url} 0.0.0.0 {CAPTURED} text/html {len(message)}\n".encode() + message
    return f"{url} 0.0.0.0 {CAPTURED} text/html 200 - - 0 {name} {len(message)}\n".encode() + message


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:]) if v}


def _whole(x: str | None) -> int | None:
    """A page id from a header, null unless it is a whole number of 64 bits."""
    if x is None or not re.fullmatch(r"-?[0-9]{1,19}", x):
        return None
    return n if -(1 << 63) <= (n := int(x)) < 1 << 63 else None


def _capture(of: dict[str, str], message: bytes) -> Record:
    end = message.find(b"\r\n\r\n")
    more = (of["IP-address"], of["Content-type"], of.get("Result-code", "-"), of.get("Location", "-"))
    if end < 0 or not message.startswith(b"HTTP/"):
        return Record(of["URL"], of["Archive-date"], b"", message, None, "resource", *more)
    head, payload = message[: end + 4], message[end + 4 :]
    return Record(of["URL"], of["Archive-date"], head, payload, _whole(_headers(head).get("x-page-id")), "response", *more)


def read_arc(data: bytes) -> Iterator[Record]:
    """Records of an ARC file by declared lengths; the version block says which fields a header has."""
    at, version = 0, None
    while at < len(data):
        line_end = data.find(b"\n", at)
        if line_end < 0:
            raise ValueError(f"no header line at byte {at}")
        line = data[at:line_end].decode("utf-8", "replace").rstrip("\r")
        if not line:  # the line feed between records
            at = line_end + 1
            continue
        fields = line.split(" ")
        length = int(fields[-1])
        body = data[line_end + 1 : line_end + 1 + length]
        if len(body) < length:
            raise ValueError(f"record at byte {at} declares {length} bytes, {len(body)} are left")
        at = line_end + 1 + length
        if fields[0].startswith("filedesc:"):
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            yield Record(fields[0].removeprefix("filedesc:").lstrip("/"), fields[2], b"", body, None, "warcinfo")
            continue
        names = ARC_FIELDS[version or 1]
        if len(fields) != len(names):
            raise ValueError(f"{len(fields)} fields in a header of version {version}")
        yield _capture(dict(zip(names, fields, strict=True)), body)


def record_id(archive: str, index: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{archive}/{index}/{digest}'.encode()).digest())}>"


def _date(d: str) -> str:
    """14 digits (fewer are filled up with the least possible date) as a WARC date."""
    d = (re.sub(r"[^0-9]", "", d) + "00000101000000"[len(re.sub(r"[^0-9]", "", d)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(r: Record, digest: str, own_id: str, refers: dict | None) -> bytes:
    """A record without the last of its two closing line breaks."""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else r.kind}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {_date(r.date)}"]
    if r.kind == "warcinfo":
        made_from = re.sub(r"\s+", " ", r.payload.decode("utf-8", "replace")).strip()
        block = f"software: tidewheel\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC: {made_from}\r\n".encode()
        lines += [f"WARC-Filename: {r.url}", "Content-Type: application/warc-fields"]
    else:
        lines += [f"WARC-Target-URI: {r.url}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(r.payload)}"]
        lines += [f"{name}: {value}" for name, value, none in (("WARC-IP-Address", r.ip, "0.0.0.0"), ("X-ARC-Result-Code", r.result, "-"), ("X-ARC-Location", r.location, "-")) if value not in (none, "-")]
        lines.append(f"Content-Type: {'application/http; msgtype=response' if r.kind == 'response' else r.content_type if '/' in r.content_type else 'application/octet-stream'}")
        block = r.head if refers else r.head + r.payload
    if refers:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers['id']}", f"WARC-Refers-To-Target-URI: {refers['url']}"]
        if refers["page_id"] is not None:
            lines.append(f"WARC-Refers-To-Page: {refers['page_id']}")
    lines.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record, by declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        end = data.find(b"\r\n\r\n", at)
        head = _headers(data[at:end])
        begin, length = end + 4, int(head["content-length"])
        yield head, data[begin : begin + length]
        at = begin + length


def _inflate(content: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while content:
        d = zlib.decompressobj(31)
        out.append(d.decompress(content))
        out.append(d.flush())
        content = d.unused_data
    return b"".join(out)


#: Bytes of records: one row each, numbered within the file, which is numbered within its task.
_BYTES = "value binary, file int, idx int"


def _rows_of_files(files: Iterator[Iterator[bytes]]) -> Iterator[pa.RecordBatch]:
    values, numbers, places, room = [], [], [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(numbers, pa.int32()), pa.array(places, pa.int32())], names=["value", "file", "idx"])

    for number, records in enumerate(files):
        for place, value in enumerate(records):
            values.append(value)
            numbers.append(number)
            places.append(place)
            room += len(value)
            if len(values) >= 500 or room > 4 << 20:
                yield out()
                values, numbers, places, room = [], [], [], 0
    if values:
        yield out()


def _to_arc(archive_bytes: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        rows = ((page_id, url, (html or "").encode()) for batch in batches for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        row = next(rows, None)

        def records(number: int) -> Iterator[bytes]:
            nonlocal row
            version, name, room = 1 + (part + number) % 2, f"{part}-{number}.arc.gz", 0
            yield arc_version_block(version, name)
            while row and room < archive_bytes:
                page_id, url, payload = row
                yield arc_record(version, url, page_id, payload, name)
                room += len(payload) + 200
                row = next(rows, None)

        def files() -> Iterator[Iterator[bytes]]:
            number = 0
            while row:
                yield records(number)
                number += 1

        yield from _rows_of_files(files())

    return run


def _write(rows: DataFrame, path: str, line_end: str) -> None:
    """Each file's records in their order; a string of Spark is written as the bytes it was made of."""
    ordered = rows.sortWithinPartitions("file", "idx").select(F.col("value").cast("string").alias("value"), "file")
    ordered.write.partitionBy("file").option("maxRecordsPerFile", 0).option("lineSep", line_end).option("compression", "gzip").text(path)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of all archives below ``path``; the name of an archive is its place below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select(F.regexp_extract("_metadata.file_path", r"([^/]*/[^/]*)$", 1).alias("archive"), "content")


def write_arc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """``pages`` (page_id, url, html) as ARC files, every other one in version 2."""
    _write(map_arrow(pages.select(F.col("page_id").cast("long"), "url", "html"), _to_arc(archive_bytes), _BYTES), path, "\n")


def _summaries(batches):
    for batch in batches:
        for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = [(archive, i, r.page_id, r.url, hashlib.sha256(r.payload).hexdigest(), len(r.payload)) for i, r in enumerate(read_arc(_inflate(content.as_py()))) if r.kind == "response"]
            if rows:
                types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["archive", "idx", "page_id", "url", "digest", "bytes"])


def _converted(archive: str, content: bytes, revisits: list[dict]) -> Iterator[bytes]:
    first = {r["idx"]: r for r in revisits}
    for i, r in enumerate(read_arc(_inflate(content))):
        digest = hashlib.sha256(r.payload).hexdigest()
        f = first.get(i)
        refers = f and {"id": record_id(f["f_archive"], f["f_idx"], digest), "url": f["f_url"], "page_id": f["f_page"]}
        yield warc_record(r, digest, record_id(archive, i, digest), refers)


def _to_warc(batches):
    archives = (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True))
    yield from _rows_of_files(_converted(archive, content.as_py(), revisits or []) for archive, content, revisits in archives)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = LEAST_BYTES) -> None:
    """All ARC files below ``arc_path`` as WARC files below ``warc_path``, one for one."""
    records = map_arrow(_archives(spark, arc_path), _summaries, "archive string, idx int, page_id long, url string, digest string, bytes long").filter(F.col("bytes") >= least_bytes)
    order = F.struct(F.col("page_id").isNull(), "page_id", "archive", "idx")
    firsts = records.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("k"), F.min_by(F.struct("archive", "idx", "url", "page_id"), order).alias("f")).filter("k > 1")
    firsts = firsts.select("digest", "bytes", F.col("f.archive").alias("f_archive"), F.col("f.idx").alias("f_idx"), F.col("f.url").alias("f_url"), F.col("f.page_id").alias("f_page"))
    revisits = records.join(firsts, ["digest", "bytes"]).filter("archive <> f_archive or idx <> f_idx")
    by_archive = revisits.groupBy("archive").agg(F.collect_list(F.struct("idx", "f_archive", "f_idx", "f_url", "f_page")).alias("revisits"))
    joined = _archives(spark, arc_path).join(by_archive, "archive", "left").select("archive", "content", "revisits")
    _write(map_arrow(joined, _to_warc, _BYTES), warc_path, "\r\n")


def _read_back(batches):
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for head, block in read_warc(_inflate(content.as_py())):
                kind = head["warc-type"]
                if kind == "warcinfo":
                    continue
                end = block.find(b"\r\n\r\n") + 4 if kind != "resource" else 0
                http = _headers(block[:end])
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                if kind != "revisit" and hashlib.sha256(block[end:]).hexdigest() != digest:
                    raise ValueError(f"{head['warc-record-id']}: the payload does not have its digest")
                rows.append((_whole(http.get("x-page-id")), int(head["x-payload-length"]) if kind == "revisit" else len(block) - end, digest, kind, _whole(head.get("warc-refers-to-page")), head["warc-record-id"], head["warc-date"], head["warc-target-uri"], head.get("warc-ip-address")))
            if rows:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _RECORDS.split(", ")])


_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, date string, url string, ip string"


def read_records(spark: SparkSession, warc_path: str) -> DataFrame:
    """One row for each record of the WARC files below ``warc_path``; a payload that fails its digest is an error."""
    return map_arrow(_archives(spark, warc_path).select("content"), _read_back, _RECORDS)


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``pages`` to ARC, ARC to WARC, both in the shared folder, and the WARC records read back."""
    spark = pages.sparkSession
    if pages.isEmpty():
        return spark.createDataFrame([], _RECORDS)
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc, archive_bytes)
    convert(spark, arc, warc)
    return read_records(spark, warc)
