"""Legacy web archives: ARC files are parsed and converted to WARC, written and read back.

An ARC file starts with a version block whose second line gives the version; version 1
record lines have five fields and version 2 record lines ten, the last being the length
of what follows. Conversion makes up what ARC lacks: record identifiers (from address,
time and digest), times in ISO form, record types and digests. Of records with equal
payloads the one with the largest page id stays a response; the others become revisits.

Defined results: a null html is an empty payload and a null url an empty address; a null
page id stays null, and never wins against a number; repeated rows are records of their
own, of which equal page ids all stay responses only if they hold the largest id; an
empty table gives no archive; other columns are left behind.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.shared import tidy, written

# The field names of record lines in ARC version blocks.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes after which a new archive segment begins.
SEGMENT_BYTES = 1 << 18
_NOWHERE = uuid.UUID(int=0)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _address(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url) or "-"


def arc_bytes(records: list[tuple], version: int = 1, name: str = "legacy.arc") -> bytes:
    """One ARC file of (url, ip, 14-digit time, content type, content) records."""
    block = f"{version} 0 lodeweave\n{' '.join(FIELDS[version])}\n".encode()
    rest = "" if version == 1 else f" 200 - - 0 {name}"
    out = [f"filedesc://{name} 0.0.0.0 20240101000000 text/plain{rest} {len(block)}\n".encode(), block]
    for url, ip, at, kind, content in records:
        rest = "" if version == 1 else f" 200 {base32_sha1(content)} - 0 {name}"
        out += [f"\n{_address(url)} {ip} {at} {kind}{rest} {len(content)}\n".encode(), content]
    return b"".join([*out, b"\n"])


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file of version 1 or 2, found by their declared lengths."""
    at = data.index(b"\n") + 1
    size = int(data[:at].split()[-1])
    version = int(data[at : at + size].split(b" ", 1)[0])
    names = FIELDS[version]
    at += size
    while at < len(data):
        while data[at : at + 1] == b"\n":
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "replace").rsplit(" ", len(names) - 1)
        record = dict(zip(names, values, strict=True))
        size = int(record["Archive-length"])
        if end + 1 + size > len(data):
            raise ValueError(f"a record of {size} bytes ends beyond its archive")
        record["content"] = data[end + 1 : end + 1 + size]
        yield record
        at = end + 1 + size


def http_split(content: bytes) -> tuple[bytes, bytes]:
    """The header block of an HTTP message, blank line included, and its payload."""
    end = content.find(b"\r\n\r\n")
    return (content[: end + 4], content[end + 4 :]) if end >= 0 else (b"", content)


def http_field(head: bytes, name: str) -> str | None:
    wanted = name.lower().encode() + b":"
    for line in head.split(b"\r\n")[1:]:
        if line[: len(wanted)].lower() == wanted:
            return line[len(wanted) :].strip().decode()
    return None


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NOWHERE, f'{page_id} {digest}')}>"


def warc_bytes(page_id: int | None, url: str, ip: str, at: str, head: bytes, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the page `refers_to` without the payload."""
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", at), ("WARC-Target-URI", url), ("WARC-IP-Address", ip)]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", refers_to)]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def info_bytes(at: str, first: bytes) -> bytes:
    """The warcinfo record that begins an archive, named after the archive's first record."""
    block = b"software: lodeweave\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NOWHERE, hashlib.sha1(first).hexdigest())}>"), ("WARC-Date", at), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def legacy_archives(pages: DataFrame, version: int = 1, segment: int = SEGMENT_BYTES) -> DataFrame:
    """(archive) ARC files of the pages; the page id travels as a header of the stored HTTP message."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for page_id, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html")), strict=True):
                payload = (html.as_py() or "").encode()
                mark = "" if page_id.as_py() is None else f"X-Page-Id: {page_id.as_py()}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n".encode()
                held.append((url.as_py() or "", "0.0.0.0", "20240101000000", "text/html", head + payload))
                size += len(payload)
                if size >= segment:
                    yield pa.RecordBatch.from_arrays([pa.array([arc_bytes(held, version)], pa.binary())], ["archive"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([arc_bytes(held, version)], pa.binary())], ["archive"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(tidy(packed), "archive binary")


def converted(archives: DataFrame) -> DataFrame:
    """The records of ARC files as rows with everything that WARC wants."""
    names = ["page_id", "url", "ip", "at", "head", "payload", "digest"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.string()]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive"):
                rows = []
                for r in parse_arc(archive.as_py()):
                    head, payload = http_split(r["content"])
                    t, page_id = r["Archive-date"], http_field(head, "X-Page-Id")
                    at = f"{t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:14]}Z"
                    rows.append((None if page_id is None else int(page_id), r["URL"], r["IP-address"], at, head, payload, base32_sha1(payload)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.mapInArrow(tidy(convert), "page_id long, url string, ip string, at string, head binary, payload binary, digest string")


def deduplicated(records: DataFrame, min_bytes: int = 0, payloads: DataFrame | None = None) -> DataFrame:
    """`records` plus refers_to: the largest page id among equal payloads of at least min_bytes, null where that is the row's own.

    payloads: the same (page_id, payload) rows where they can be had without parsing archives again.
    The largest id by digest is summed up before the shuffle, and the join back lets hot digests be split.
    """
    seen = (records if payloads is None else payloads).where(F.length("payload") >= min_bytes)
    keep = seen.groupBy(F.sha1("payload").alias("_digest")).agg(F.max("page_id").alias("_winner"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    records = records.withColumn("_sha1", F.when(F.length("payload") >= min_bytes, F.sha1("payload")))
    joined = records.join(keep, F.col("_sha1") == F.col("_digest"), "left")
    other = F.col("_winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_winner"))
    return joined.withColumn("refers_to", F.when(other, F.col("_winner"))).drop("_sha1", "_digest", "_winner")


def warc_archives(records: DataFrame, segment: int = SEGMENT_BYTES) -> DataFrame:
    """(archive) WARC files of converted records with their refers_to, each with a warcinfo record first."""
    names = ["page_id", "url", "ip", "at", "head", "payload", "digest", "refers_to"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, at = [], 0, ""
            for row in zip(*(batch.column(c) for c in names), strict=True):
                values = [x.as_py() for x in row]
                held.append(warc_bytes(*values))
                at = at or values[3]
                size += len(held[-1])
                if size >= segment:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join([info_bytes(at, held[0]), *held])], pa.binary())], ["archive"])
                    held, size, at = [], 0, ""
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join([info_bytes(at, held[0]), *held])], pa.binary())], ["archive"])

    return records.select(*names).mapInArrow(tidy(packed), "archive binary")


def read_warc(archives: DataFrame) -> DataFrame:
    """One row per WARC record: page_id, url, record_id, payload_bytes, payload_digest, record_type, refers_to.

    The digest of a response is computed anew from its payload and held against the declared one.
    """
    names = ["page_id", "url", "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive"):
                rows = []
                for fields, block in parse_warc(archive.as_py()):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    head, payload = http_split(block)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and base32_sha1(payload) != digest:
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't have its digest")
                    page_id, refers = http_field(head, "X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                    rows.append((None if page_id is None else int(page_id), fields["WARC-Target-URI"], fields["WARC-Record-ID"], int(http_field(head, "Content-Length") or len(payload)), digest, fields["WARC-Type"], None if refers is None else int(refers)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.mapInArrow(tidy(parsed), "page_id long, url string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def through_archives(pages: DataFrame, version: int = 1, min_bytes: int = 0) -> DataFrame:
    """Pages written as ARC, converted to WARC in the shared folder, and read back."""
    payloads = pages.select(F.col("page_id").cast("long").alias("page_id"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    records = deduplicated(converted(legacy_archives(pages, version)), min_bytes, payloads)
    return read_warc(written(warc_archives(records), "warc", "zstd"))
