"""WARC records in ZIP packages: writing, and reading by ranges without extraction.

A package is a ZIP with two members stored without compression: ``archive/data.warc.gz`` (one gzip
member per record) and ``indexes/index.cdxj`` (one line per record with its place in the archive). The
reader finds the end-of-directory record from the last bytes, follows ZIP64 locators, parses the central
directory, locates the stored members, reads the index, and then reads records by their ranges.

Tasks write packages of bounded size to a shared folder through the file system of its URI; each
attempt writes names of its own, and only those that a finished task reports are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stayscope.llm.common import slices
from stayscope.session import materialise, scratch_path

PACKAGE_BYTES = 32 << 20
SAME_FROM = 1_000
READ_BYTES = 8 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint, package string"


def _header(value: str) -> str:
    return "".join(c if c.isprintable() else "%" + "%".join(f"{b:02X}" for b in c.encode()) for c in value)


def warc_record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit keeps the HTTP head, with the payload's length, and no payload."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:sha1:{digest}"
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(value: str | None) -> int | None:
    value = (value or "").strip("<>")
    return int(value.removeprefix("urn:page:")) if value.startswith("urn:page:") else None


def parse_record(raw: bytes) -> dict:
    """The fields of one uncompressed record; the digest of a payload at hand is recomputed and compared."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(named["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), len(payload))
    digest = base64.b32decode(named["warc-payload-digest"].partition(":")[2]).hex()
    kind = named["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {named['warc-record-id']} does not match its digest")
    return {
        "page_id": _page(named["warc-record-id"]), "url": named.get("warc-target-uri"), "record_type": kind,
        "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest,
        "refers_to": _page(named.get("warc-refers-to")),
    }


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def package(records: list[tuple[str, bytes]]) -> bytes:
    """A ZIP with the records, each given as (key, record), and their index."""
    data, index = io.BytesIO(), []
    for key, record in records:
        squeezed = zlib.compressobj(6, zlib.DEFLATED, 31)
        raw = squeezed.compress(record) + squeezed.flush()
        index.append(f"{key} {json.dumps({'offset': data.tell(), 'length': len(raw), 'filename': 'data.warc.gz'})}")
        data.write(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as packed:
        for name, content in ((DATA, data.getvalue()), (INDEX, "\n".join(index).encode())):
            packed.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), content)
    return out.getvalue()


def write_packages(records: DataFrame, folder: str, limit: int = PACKAGE_BYTES) -> DataFrame:
    """Write (page_id, url, html, size, digest, refers_to) rows below ``folder``; returns (package, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(folder)
        files.create_dir(root, recursive=True)
        held: list[tuple[str, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name, content = f"{uuid.uuid4().hex}.wacz", package(held)
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(content)
            return pa.RecordBatch.from_pydict({"package": [f"{folder.rstrip('/')}/{name}"], "records": [len(held)], "bytes": [len(content)]})

        for part in slices(batches, "html"):
            for row in part.to_pylist():
                record = warc_record(row["page_id"], row["url"], (row["html"] or "").encode(), row["size"], row["digest"], row["refers_to"])
                held.append((f"{_header(row['url'] or '-').replace(' ', '%20')} 20240101000000", record))
                size += len(record)
                if size >= limit:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return records.mapInArrow(run, "package string, records bigint, bytes bigint")


@dataclass
class Member:
    name: str
    offset: int
    size: int
    method: int


def _at(file, start: int, size: int) -> bytes:
    file.seek(start)
    return file.read(size)


def members_of(file, length: int) -> list[Member]:
    """Members of a ZIP of ``length`` bytes with the places of their data, from the (ZIP64) central directory."""
    tail_size = min(length, 22 + 0xFFFF)
    tail = _at(file, length - tail_size, tail_size)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a ZIP directory")
    count, size, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
        where = length - tail_size + end - 20
        mark, _, place, _ = struct.unpack("<IIQI", _at(file, where, 20))
        if mark != 0x07064B50:
            raise ValueError("no ZIP64 locator")
        wide = _at(file, place, 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of directory")
        count, size, start = struct.unpack_from("<QQQ", wide, 32)
    directory, at, out = _at(file, start, size), 0, []
    for _ in range(count):
        if directory[at: at + 4] != b"PK\x01\x02":
            raise ValueError("broken ZIP directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, names, extras, comments = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46: at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + names: at + 46 + names + extras]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # the fields that did not fit, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            extra = extra[4 + n:]
        local = _at(file, header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        out.append(Member(name, header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed, method))
        at += 46 + names + extras + comments
    return out


def records_of(file, length: int) -> Iterator[dict]:
    """All records of a package, read by the ranges that its indexes name."""
    stored = {m.name: m for m in members_of(file, length) if m.method == 0}
    for index in (m for n, m in sorted(stored.items()) if n.startswith("indexes/") and n.endswith(".cdxj")):
        places = [json.loads(line.split(b" ", 2)[2]) for line in _at(file, index.offset, index.size).split(b"\n") if line]
        places.sort(key=lambda p: (p["filename"], p["offset"]))
        at = 0
        while at < len(places):  # neighbours are read together, up to a bound
            end, first = at + 1, places[at]
            while end < len(places) and places[end]["filename"] == first["filename"] and (
                places[end]["offset"] + places[end]["length"] - first["offset"] <= READ_BYTES
            ):
                end += 1
            member, last = stored["archive/" + first["filename"]], places[end - 1]
            raw = _at(file, member.offset + first["offset"], last["offset"] + last["length"] - first["offset"])
            for place in places[at:end]:
                start = place["offset"] - first["offset"]
                yield parse_record(zlib.decompress(raw[start: start + place["length"]], 31))
            at = end


def read_packages(packages: DataFrame, column: str = "package") -> DataFrame:
    """The records of the packages whose URIs are in ``column``, one package at a time in a task; RECORD is the schema."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("package", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, path = file_system(uri)
                held, size = [], 0
                with files.open_input_file(path) as file:
                    for record in records_of(file, file.size()):
                        held.append(record | {"package": uri})
                        size += record["payload_bytes"]
                        if size >= READ_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    uris = packages.select(F.col(f"`{column}`").alias("package"))
    # names are tiny: without a count, run-time merging of partitions would leave all packages to one task
    return uris.repartition(max(1, uris.count()), "package").mapInArrow(run, RECORD).select(*names)


def archive_pages(pages: DataFrame, folder: str | None = None, same_from: int = SAME_FROM) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as packages and return the written packages.

    Of rows with equal payloads of at least ``same_from`` bytes those with the largest page_id are responses and
    the others revisits of it; repeated rows of that page_id are responses, too. Where no such row has a page_id
    all are responses. A null html is an empty payload, a null url leaves its header out, an empty table writes no
    package. Other columns are left out.
    """
    folder = folder or scratch_path(pages.sparkSession, "packages")
    rows = pages.select(
        F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    rows = rows.withColumns({"size": F.octet_length("html").cast("bigint"), "digest": F.sha1(F.col("html").cast("binary"))})
    copies = (
        rows.filter(F.col("size") >= same_from).groupBy("digest", "size")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    )
    marked = rows.join(copies, ["digest", "size"], "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    )
    # a revisit is written without its payload
    marked = marked.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))
    return materialise(write_packages(marked.select("page_id", "url", "html", "size", "digest", "refers_to"), folder), "manifest")
