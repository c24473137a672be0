"""Legacy ARC archives converted to WARC: parse version-specific records, synthesise the new headers."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.plans.frames import written
from riskloom.session import shared_folder

#: Fields of a record line by the version number of the archive's version block (fixed by the format).
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
#: Version, reserved word and origin of a version block, then the line that names the fields (fixed by the format).
_ORIGIN = {1: b"1 0 riskloom", 2: b"2 0 riskloom"}
_NAMES = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
SMALLEST_REVISIT = 100
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _plain(url: str) -> str:
    """A url without blanks or control characters, which the one-line headers could not hold."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) or "-"


def arc_archive(url: str, html: str, version: int, date: str, filename: str) -> bytes:
    """An archive of one version block and one record that holds an HTTP response."""
    head = _ORIGIN[version] + b"\n" + _NAMES[version] + b"\n"
    body = html.encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    fields = {
        "url": _plain(url), "ip": "0.0.0.0", "date": date, "type": "text/html", "status": "200", "checksum": "-",
        "location": "-", "offset": "0", "filename": filename, "length": str(len(http)),
    }
    line = " ".join(fields[f] for f in ARC_FIELDS[version]).encode()
    top = b"filedesc://%s 0.0.0.0 %s text/plain" % (filename.encode(), date.encode())
    if version == 2:
        top += b" 200 - - 0 " + filename.encode()
    return top + b" %d\n" % len(head) + head + b"\n" + line + b"\n" + http + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an archive: header fields, HTTP head and payload. The version block says how to read the lines."""
    at, version = 0, 1
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.index(b"\n", at)
        parts = data[at:stop].rstrip(b"\r").decode("utf-8", "replace").split(" ")
        length = int(parts[-1])
        block = data[stop + 1 : stop + 1 + length]
        if len(block) != length:
            raise ValueError(f"archive ends inside the record at byte {at}")
        offset, at = at, stop + 1 + length
        if parts[0].startswith("filedesc://"):
            version = int(block.split(b" ", 1)[0])
            continue
        names = ARC_FIELDS[version]
        if len(parts) != len(names):
            raise ValueError(f"record line at byte {offset} has {len(parts)} fields, version {version} has {len(names)}")
        split = block.find(b"\r\n\r\n")
        head, payload = (block[: split + 4], block[split + 4 :]) if block.startswith(b"HTTP/") and split >= 0 else (b"", block)
        yield dict(zip(names, parts, strict=True)) | {"offset": offset, "head": head, "payload": payload}


def _iso(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


_RECORD = "key bigint, uri string, record_id string, date string, type string, head string, payload string, digest string, length bigint"
_RECORD_NAMES = [f.split()[0] for f in _RECORD.split(", ")]
_RECORD_KINDS = [pa.int64() if n in ("key", "length") else pa.string() for n in _RECORD_NAMES]


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of the archives of each (key, archive) batch; an archive's records are a batch."""
    for batch in batches:
        for key, data in zip(batch.column("key").to_pylist(), batch.column("archive"), strict=True):
            rows = []
            for r in parse_arc(data.as_py()):
                digest = hashlib.sha256(r["payload"]).hexdigest()
                name = uuid.uuid5(uuid.NAMESPACE_URL, f"{key}:{r['offset']}:{r['url']}:{r['date']}:{digest}")
                rows.append((key, r["url"], f"<urn:uuid:{name}>", _iso(r["date"]), r["type"], r["head"].decode("latin-1"), r["payload"].decode("utf-8"), digest, len(r["payload"])))
            columns = list(zip(*rows, strict=True)) or [()] * len(_RECORD_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _RECORD_KINDS, strict=True)], _RECORD_NAMES)


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, archive) of each (page_id, url, html) batch, in pieces of about 8 MB."""
    for batch in batches:
        keys, out, size = batch.column("page_id").to_pylist(), [], 0
        for key, url, html in zip(keys, batch.column("url"), batch.column("html"), strict=True):
            n = key or 0
            out.append(arc_archive(url.as_py() or "", html.as_py() or "", 1 + n % 2, f"2000010100{n // 60 % 60:02d}{n % 60:02d}", f"pages-{n % 97}.arc"))
            size += len(out[-1])
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(keys[: len(out)], pa.int64()), pa.array(out, pa.binary())], ["key", "archive"])
                keys, out, size = keys[len(out) :], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], ["key", "archive"])


def to_records(archives: DataFrame) -> DataFrame:
    """(key, archive) rows to one row per ARC record with the parts of its WARC equivalent, payload as text."""
    return archives.mapInArrow(_convert, _RECORD)


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """(key, archive): an ARC file image per page, versions 1 and 2 in turn by page_id; null url or html is empty."""
    return pages.select("page_id", "url", "html").mapInArrow(_images, "key bigint, archive binary")


def pages_to_records(pages: DataFrame) -> DataFrame:
    """`to_records(pages_to_arc(pages))` in one pass: the images never leave the task that parses them."""
    return pages.select("page_id", "url", "html").mapInArrow(lambda batches: _convert(_images(batches)), _RECORD)


def write_warc(records: DataFrame, path: str, records_per_file: int = 4000) -> None:
    """Writes the records of `to_records` as gzipped WARC 1.0 text files below `path`.

    The conversion is done once and kept in the shared folder; ids and digests are read from there without payloads.

    Of records with one digest and a payload of at least 100 bytes the smallest key is the response, the
    others are revisits without payload; smaller ones are all responses. Only (key, digest) rows are grouped
    and joined for that, so a page copied into a third of all rows is a partial row per task and payloads are
    shuffled once, by key.
    """
    kept = shared_folder(records.sparkSession, "tables", uuid.uuid4().hex)
    records.write.option("compression", "zstd").parquet(kept)
    records = records.sparkSession.read.parquet(kept)
    large = written(records.where(F.col("length") >= SMALLEST_REVISIT).select("key", "record_id", "digest"))
    first = large.groupBy("digest").agg(F.min(F.struct(F.col("key").isNull(), "key", "record_id")).alias("f"), F.count("*").alias("n")).where("n > 1")
    again = large.select("key", "digest").distinct().join(first, "digest").where(~F.col("key").eqNullSafe(F.col("f.key")))
    again = again.select(F.col("key").alias("__k"), F.col("digest").alias("__d"), F.col("f.key").alias("refers"), F.col("f.record_id").alias("refers_id"))
    rows = records.join(again, records["key"].eqNullSafe(again["__k"]) & (records["digest"] == again["__d"]), "left")
    revisit = F.col("refers_id").isNotNull()
    payload = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    body = F.concat("head", payload)
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), "record_id"),
        F.concat(F.lit("WARC-Date: "), "date"),
        F.concat(F.lit("WARC-Target-URI: "), "uri"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), "digest"),
        F.concat(F.lit("WARC-Source-Key: "), F.col("key").cast("string")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), "refers_id", F.lit("\r\nWARC-Refers-To-Key: "), F.col("refers").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(F.encode(body, "UTF-8")).cast("string")),
    ]
    value = F.concat(F.concat_ws("\r\n", F.lit("WARC/1.0"), *lines), F.lit("\r\n\r\n"), body)
    options = {"compression": "gzip", "lineSep": "\r\n\r\n", "maxRecordsPerFile": records_per_file}
    rows.select(value.alias("value")).write.options(**options).text(path)


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in raw.decode("utf-8").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped or plain WARC file, by the declared lengths."""
    gz = data[:2] == b"\x1f\x8b"
    unpack = zlib.decompressobj(31) if gz else None
    buffer, at = bytearray() if gz else bytearray(data), 0

    def more() -> bool:
        nonlocal at, buffer
        if unpack is None or at >= len(data):
            return False
        buffer += unpack.decompress(data[at : at + (1 << 18)])
        at += 1 << 18
        return True

    while True:
        while (split := buffer.find(b"\r\n\r\n")) < 0 and more():
            pass
        if split < 0:
            break
        head = _headers(bytes(buffer[:split]))
        stop = split + 4 + int(head["content-length"])
        while len(buffer) < stop + 4 and more():
            pass
        if len(buffer) < stop:
            raise ValueError(f"archive ends inside {head.get('warc-record-id')}")
        yield head, bytes(buffer[split + 4 : stop])
        del buffer[: stop + 4]


def read_warc(spark, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the WARC files below `path`, files spread over tasks; payloads are null if not asked for.

    Digests are checked against the payloads either way.
    """
    schema = "key bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, uri string, payload string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            names = [f.split()[0] for f in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for head, block in parse_warc(content.as_py()):
                    split = block.find(b"\r\n\r\n")
                    http, payload = (_headers(block[:split]), block[split + 4 :]) if split >= 0 else ({}, block)
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                    key, refers = head.get("warc-source-key"), head.get("warc-refers-to-key")
                    length = int(http.get("content-length", len(payload)))
                    rows.append((int(key) if key else None, kind, length, digest, int(refers) if refers else None, head["warc-target-uri"], payload.decode() if payloads else None))
                    size += len(payload)
                    if size > 4 << 20:
                        yield pack(rows)
                        rows, size = [], 0
                yield pack(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, schema)


def convert_pages(pages: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """ARC images of `pages`, converted, written below `path` as WARC files and read back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, uri, payload (null without `payloads`). Null html is an
    empty payload; a null page_id is never the smallest unless all are null, and comes back as null. Rows that
    repeat a page_id with one payload are all responses if it is the smallest. Other columns are ignored; an
    empty table gives no rows.
    """
    write_warc(pages_to_records(pages), path)
    return read_warc(pages.sparkSession, path, payloads).withColumnRenamed("key", "page_id")
