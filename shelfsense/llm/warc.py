"""WARC archives: one gzip member per record, written and read in parts.

:func:`write` writes one archive per partition of its input, as
``application/http`` response records; records with equal payloads of at least
``revisit_from`` bytes are ``revisit`` records but for the one with the largest
id, to which they refer.  :func:`read` reads archives back: it streams a file,
inflates one gzip member after the other, frames each record by its
content-length, and verifies block and payload digests; a damaged archive raises
an error.  Memory is bounded by one record (and a piece of the file).

Archives go to a shared folder through the file system that its address names.
A file has a name of its own for each attempt of a task and counts only if the
manifest that ``write`` returns lists it, so a task that ran twice does no harm.

Defined results: a null payload is empty; a null id is written as ``none`` and
read back as null; of several rows with the largest id of a payload all are
responses; null ids are smaller than others.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

EOL = b"\r\n"
PIECE = 1 << 20


def file_system(address: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address; a plain path is a local (mounted) one."""
    address = re.sub(r"^file:/+", "/", address)
    return (fs.LocalFileSystem(), address) if address.startswith("/") else fs.FileSystem.from_uri(address)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def name_of(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def id_of(name: str) -> int | None:
    number = name.rstrip(">").rpartition(":")[2]
    return None if number == "none" else int(number)


def line(value: str) -> bytes:
    """A header value: one line, in UTF-8."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip().encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record.  A revisit has the HTTP header only, which tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + name_of(page_id).encode(),
            b"WARC-Date: " + date.encode(), b"WARC-Payload-Digest: " + digest.encode(), b"WARC-Block-Digest: " + sha1(block).encode(),
            b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    if url is not None:
        head.append(b"WARC-Target-URI: " + line(url))
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + name_of(refers_to).encode()]
    return EOL.join(head) + EOL + EOL + block + EOL + EOL


def members(stream) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one at a time."""
    rest = b""
    while True:
        rest = rest or stream.read(PIECE)
        if not rest:
            return
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if not rest and not (rest := stream.read(PIECE)):
                raise ValueError("the archive ends within a gzip member")
            out.append(inflate.decompress(rest))
            rest = inflate.unused_data
        yield b"".join(out)


def headers(data: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data.decode().split("\r\n")[1:])}


def parse(member: bytes) -> dict:
    """Fields of a record, its digests verified."""
    at = member.index(EOL + EOL)
    head = headers(member[:at])
    if not member.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    end = at + 4 + int(head["content-length"])
    block = member[at + 4:end]
    if member[end:] != EOL + EOL:
        raise ValueError(f"{head['warc-record-id']}: the content-length doesn't frame the record")
    if sha1(block) != head["warc-block-digest"]:
        raise ValueError(f"{head['warc-record-id']}: wrong block digest")
    http_end = block.index(EOL + EOL) + 4
    length, payload = int(headers(block[:http_end - 4])["content-length"]), block[http_end:]
    revisit = head["warc-type"] == "revisit"
    if not revisit and (len(payload) != length or sha1(payload) != head["warc-payload-digest"]):
        raise ValueError(f"{head['warc-record-id']}: wrong payload digest or length")
    return {"page_id": id_of(head["warc-record-id"]), "url": head.get("warc-target-uri"), "payload_bytes": length,
            "payload_digest": base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex(), "record_type": head["warc-type"],
            "refers_to": id_of(head["warc-refers-to"]) if revisit else None, "payload": None if revisit else payload}


def write(pages: DataFrame, folder: str, revisit_from: int = 1000, level: int = 6) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in ``folder``; the manifest (file, n_records, n_bytes), stored."""
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    first = (rows.where(F.octet_length("payload") >= revisit_from).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                 .where("n > 1 and first is not null").select("digest", "first"))
    rows = rows.join(first, "digest", "left").select("page_id", "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        name, out, n, size = f"{path}/part-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for page_id, url, data, refers_to in zip(*(c.to_pylist() for c in batch.columns[:2]), (x.as_buffer() for x in batch.column(2)), batch.column(3).to_pylist()):
                out = out or system.open_output_stream(name, compression=None)
                data = data.to_pybytes()
                deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = deflate.compress(record(page_id, url, data, sha1(data), refers_to, date)) + deflate.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name if folder.startswith(("/", "file:")) else f"{folder}/{name.rpartition('/')[2]}"], "n_records": [n], "n_bytes": [size]})

    return cut_lineage(rows.mapInArrow(run, "file string, n_records long, n_bytes long"))


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives that ``manifest`` lists, each file in the task that has its row."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads)
    fields = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, path = file_system(name)
                rows, seen, held = [], 0, 0
                with system.open_input_stream(path, compression=None) as stream:
                    for member in members(stream):
                        row = parse(member)
                        rows.append({k: row[k] for k in fields})
                        seen, held = seen + 1, held + (len(member) if payloads else 200)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if seen != n:
                    raise ValueError(f"{name}: {seen} records of {n}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    types = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return manifest.select("file", "n_records").mapInArrow(run, types)
