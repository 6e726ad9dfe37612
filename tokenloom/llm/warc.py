"""WARC archives: written by tasks into the shared folder, read back as streams.

Every record is a gzip member of its own.  The reader takes an archive in chunks, inflates one
member at a time, frames its block by Content-Length and checks the digests while the bytes pass;
it never holds a record.  Writers name their file anew on every attempt, and only the files
named in the result of a finished task are read, so a lost executor leaves nothing behind that counts.

Defined results: null html is an empty payload; a null url gets a ``urn:`` of the page; control characters in
a url are percent-encoded in the header; the smallest page_id of equal payloads is the response
(null ids never are, unless all are null), repeated rows of it are responses too; an empty table gives no archive and no
record.  A damaged archive gives a row with ``problem`` set for what could not be read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lookup import lookup_join
from ..plans.staging import new_path, stage

ARCHIVE_BYTES = 256 * 1024 * 1024
CHUNK = 1 << 18
# The pages carry no date.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ARCHIVE = "path string, records bigint, bytes bigint"
_RECORD = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint, problem string"
)


def _digest(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    name = "null" if page_id is None else str(page_id)
    target = f"urn:page:{name}" if url is None else url
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", target)
    digest = _digest(hashlib.sha1(payload))
    block = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    kind = "response" if refers_to is None else "revisit"
    more = ""
    if refers_to is None:
        block += payload
    else:
        # A revisit holds the head of the response only.
        more = f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:{refers_to}>\r\n"
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{name}>\r\n"
        f"WARC-Date: {DATE}\r\nWARC-Target-URI: {target}\r\n{more}"
        f"WARC-Payload-Digest: sha1:{digest}\r\n"
        f"WARC-Block-Digest: sha1:{_digest(hashlib.sha1(block))}\r\n"
        "Content-Type: application/http; msgtype=response\r\n"
        f"Content-Length: {len(block)}\r\n\r\n"
    ).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


class _Record:
    """Takes the inflated bytes of one record, in pieces of any size."""

    def __init__(self) -> None:
        self.head, self.fields, self.http = b"", None, b""
        self.left, self.in_payload, self.tail = 0, False, b""
        self.block, self.payload, self.payload_bytes = hashlib.sha1(), hashlib.sha1(), 0

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = self.head[:end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("no record starts here")
            self.fields = {
                k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])
            }
            self.left = int(self.fields["content-length"])
            data, self.head = self.head[end + 4 :], b""
        part, self.tail = data[: self.left], self.tail + data[self.left :]
        self.left -= len(part)
        self.block.update(part)
        if not self.in_payload:
            self.http += part
            end = self.http.find(b"\r\n\r\n")
            if end < 0:
                return
            self.in_payload, part, self.http = True, self.http[end + 4 :], self.http[:end]
        self.payload.update(part)
        self.payload_bytes += len(part)

    def row(self) -> tuple:
        if self.fields is None or self.left or self.tail != b"\r\n\r\n":
            raise ValueError("the record is cut short or badly framed")
        f = self.fields
        if f["warc-block-digest"] != f"sha1:{_digest(self.block)}":
            raise ValueError("the block does not have its digest")
        digest = f["warc-payload-digest"].removeprefix("sha1:")
        n = self.payload_bytes
        if f["warc-type"] == "response":
            if digest != _digest(self.payload):
                raise ValueError("the payload does not have its digest")
        else:
            head = self.http.decode("utf-8", "replace")
            n = int(re.search(r"(?mi)^content-length:\s*(\d+)", head)[1])
        number = lambda key: (
            int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", f.get(key, ""))) else None
        )
        return (
            number("warc-record-id"), f["warc-target-uri"], n, digest, f["warc-type"],
            number("warc-refers-to"), None,
        )


def records(chunks: Iterator[bytes]) -> Iterator[tuple]:
    """The rows of one archive, given its bytes in chunks."""
    member, parsed, at = zlib.decompressobj(31), _Record(), 0
    begun = False
    try:
        for chunk in chunks:
            while chunk:
                begun = True
                parsed.feed(member.decompress(chunk, CHUNK))
                while member.unconsumed_tail:
                    parsed.feed(member.decompress(member.unconsumed_tail, CHUNK))
                if not member.eof:
                    break
                parsed.feed(member.flush())
                yield parsed.row()
                chunk, at = member.unused_data, at + 1
                member, parsed, begun = zlib.decompressobj(31), _Record(), False
        if begun:
            raise ValueError("the archive ends inside a record")
    except (ValueError, KeyError, TypeError, zlib.error) as e:
        yield (None, None, None, None, None, None, f"record {at}: {e}")


def write_archives(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per page; ``(path, records, bytes)`` per archive written."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).alias("url"),
        payload.alias("html"),
        F.sha2(payload, 256).alias("same"),
        F.octet_length(payload).alias("size"),
    )
    groups = rows.filter(F.col("size") >= min_bytes).groupBy("same").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    shared = stage(groups.filter(F.col("n") > 1).select("same", "first"), "shared_payloads")
    joined = lookup_join(rows, shared, ["same"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    folder = new_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, name, n, size = None, "", 0, 0

        def close():
            out.close()
            return pd.DataFrame({"path": [name], "records": [n], "bytes": [size]})

        for batch in batches:
            for page_id, url, html, first in zip(
                batch.page_id, batch.url, batch.html, batch.first_id, strict=True
            ):
                if out is None:
                    name = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, n, size = system.open_output_stream(name, compression=None), 0, 0
                data = record(
                    None if pd.isna(page_id) else int(page_id),
                    url,
                    html.encode("utf-8", "surrogatepass"),
                    None if pd.isna(first) else int(first),
                )
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    ready = joined.select("page_id", "url", "html", refers.alias("first_id"))
    return stage(ready.mapInPandas(write, _ARCHIVE), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """The records of ``archives``; ``folder`` is any address on their file system."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(folder)
        names = [c.split()[0] for c in _RECORD.split(", ")]

        def frame(rows):
            return pd.DataFrame(rows, columns=names).astype(
                {"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"}
            )

        for batch in batches:
            for path in batch.path:
                with system.open_input_stream(path, compression=None) as stream:
                    rows = []
                    for row in records(iter(lambda: stream.read(CHUNK), b"")):
                        rows.append(row)
                        if len(rows) == 4096:
                            yield frame(rows)
                            rows = []
                    yield frame(rows)

    files = max(1, archives.count())
    return archives.select("path").repartition(files, "path").mapInPandas(read, _RECORD)
