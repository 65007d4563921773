"""WARC records in ZIP packages, read by ranges without extraction (operator 5).

Writing: each task makes packages of about PACKAGE_BYTES. A package is a ZIP file with two stored members: an
archive of single-record gzip members and an index with a line (page_id, record type, offset, length) per
record. Of pages with equal payloads of at least LEAST_REVISIT bytes, the one with the largest id holds the
payload and the others are revisits of it; the digests are grouped, the texts stay where they are.

Reading: the end of a package gives its central directory, in its 32-bit or its ZIP64 form; the directory
gives the members' local headers, those the places of stored data. Index lines then give byte ranges of
records, which are read and decompressed one by one. Nothing is extracted to a disk.

Defined results: null html is an empty payload; a null url is written as an empty target; pages without an id
can't be referred to and are written as responses with an id of -1; rows that repeat an id and payload are one
response and, for long payloads, no revisit of themselves; an empty table writes no package and gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, shared_folder, written
from .files import RangeReader, write_file

LEAST_REVISIT = 1000
PACKAGE_BYTES = 8 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.txt"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_bytes(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no payload, but names its digest and length."""
    kind, body = ("response", payload) if refers_to is None else ("revisit", b"")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join(url.split())}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(http) + len(body)}"]).encode() + b"\r\n\r\n"
    return head + http + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    lengths = [line.split(b":")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    page = lambda v: int(v.rpartition(":")[2].rstrip(">"))
    return {
        "page_id": page(fields["warc-record-id"]), "record_type": fields["warc-type"], "url": fields["warc-target-uri"],
        "digest": fields["warc-payload-digest"].removeprefix("sha1:"), "payload": payload, "payload_bytes": int(lengths[0]),
        "refers_to": page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
    }


def package(records: list[bytes], index: list[str]) -> bytes:
    """A ZIP file of two stored members; `force_zip64` gives entries the 64-bit form that large ones need."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((ARCHIVE, b"".join(records)), (INDEX, "".join(index).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                member.write(data)
    return out.getvalue()


END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def directory(file: RangeReader) -> dict[str, tuple[int, int, int, int]]:
    """Members by name: (method, offset of the local header, stored bytes, plain bytes)."""
    tail = file.read(max(0, file.size - 22 - 65535 - 20), min(file.size, 22 + 65535 + 20))
    at = tail.rfind(END)
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at)  # the mark may stand in a comment
    if at < 0:
        raise ValueError("no end of a central directory")
    entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64 and (entries == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF):
        place = struct.unpack_from("<Q", tail, at - 12)[0]
        record = file.read(place, 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of a central directory")
        entries, size, offset = struct.unpack_from("<QQQ", record, 32)
    data, found, at = file.read(offset, size), {}, 0
    for _ in range(entries):
        if data[at : at + 4] != ENTRY:
            raise ValueError("broken central directory")
        method, stored, plain = struct.unpack_from("<H", data, at + 10)[0], *struct.unpack_from("<II", data, at + 20)
        n, extra, comment = struct.unpack_from("<HHH", data, at + 28)
        start = struct.unpack_from("<I", data, at + 42)[0]
        more, field = data[at + 46 + n : at + 46 + n + extra], 0
        while field + 4 <= len(more):
            tag, length = struct.unpack_from("<HH", more, field)
            if tag == 1:  # 64-bit values, only for fields that are full, in this order
                values = iter(struct.unpack_from(f"<{length // 8}Q", more, field + 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                stored = next(values) if stored == 0xFFFFFFFF else stored
                start = next(values) if start == 0xFFFFFFFF else start
            field += 4 + length
        found[data[at + 46 : at + 46 + n].decode()] = (method, start, stored, plain)
        at += 46 + n + extra + comment
    return found


def stored_range(file: RangeReader, entry: tuple[int, int, int, int]) -> tuple[int, int]:
    """First byte and number of bytes of a stored member's data."""
    method, start, stored, _ = entry
    if method != 0:
        raise ValueError("only stored members can be read by ranges")
    head = file.read(start, 30)
    if head[:4] != LOCAL:
        raise ValueError("broken local header")
    n, extra = struct.unpack_from("<HH", head, 26)
    return start + 30 + n + extra, stored


def read_package(uri: str) -> Iterator[dict]:
    """Records of a package, one range each."""
    file = RangeReader(uri)
    members = directory(file)
    base, _ = stored_range(file, members[ARCHIVE])
    index = file.read(*stored_range(file, members[INDEX])).decode()
    for line in index.splitlines():
        _, _, offset, length = line.split(" ")
        yield parse_record(zlib.decompress(file.read(base + int(offset), int(length)), wbits=31))
    file.close()


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is set for revisits."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"),
        F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"),
    )
    long = rows.where(F.col("page_id").isNotNull() & (F.col("size") >= LEAST_REVISIT)).select("digest", "size", "page_id")
    first = long.groupBy("digest", "size").agg(F.max("page_id").alias("response"), F.min("page_id").alias("__least")).where("__least < response")
    first = first.select(F.col("digest").alias("__digest"), F.col("size").alias("__size"), "response")
    joined = rows.join(first, (F.col("digest") == F.col("__digest")) & (F.col("size") == F.col("__size")), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("response"), F.col("response")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages; returns the manifest (uri, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, out, index, at, count = TaskContext.get().partitionId(), 0, [], [], 0, 0

        def close() -> pa.RecordBatch:
            uri = f"{folder}/pages-{task:06d}-{number:05d}.wacz"
            return pa.RecordBatch.from_pylist([{"uri": uri, "records": count, "bytes": write_file(uri, [package(out, index)])}])

        for batch in batches:
            for page, url_, html_, digest, refers in zip(*[c.to_pylist() for c in batch.columns]):
                page = -1 if page is None else page
                press = zlib.compressobj(1, wbits=31)
                data = press.compress(record_bytes(page, url_, html_.encode(), digest, refers)) + press.flush()
                out.append(data)
                index.append(f"{page} {'response' if refers is None else 'revisit'} {at} {len(data)}\n")
                at += len(data)
                count += 1
                if at >= PACKAGE_BYTES:
                    yield close()
                    number, out, index, at, count = number + 1, [], [], 0, 0
        if out:
            yield close()

    return written(with_revisits(pages, key, url, html).mapInArrow(run, "uri string, records long, bytes long"), "manifest")


def read_packages(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record. The digest of a
    response is computed from its payload and must be the one in its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                for r in read_package(uri):
                    if r["record_type"] == "response":
                        digest = hashlib.sha1(r["payload"]).hexdigest()
                        if digest != r["digest"] or len(r["payload"]) != r["payload_bytes"]:
                            raise ValueError(f"{uri}: payload of page {r['page_id']} is broken")
                    rows.append((r["page_id"], r["url"], r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"]))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return manifest.select("uri").repartition(partitions(manifest.sparkSession)).mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def warc_round_trip(pages: DataFrame) -> DataFrame:
    return read_packages(write_packages(pages, shared_folder(pages.sparkSession, "warc")))
