"""WARC archives: one gzip member per record, written and read sequentially.

The reader decompresses a file in small blocks, one zlib stream per member,
cuts records by their Content-Length and checks the declared lengths and the
SHA-256 digests of block and payload while reading. A damaged record raises an
error that names the archive.

A page is a ``response`` record: an HTTP head and the html. Of pages with equal
payloads of at least MIN_REVISIT bytes the one with the smallest page_id is the
response; the others are ``revisit`` records (HTTP head only, with the length
and digest of the payload they stand for) that refer to it.

Cases: null html is an empty payload; a null page_id is always a response and
is read back as null; a null url has no target field; rows of equal page_id and
payload are all responses if that id is the smallest; an empty table gives no
archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import cut, table
from plurality.llm.files import own_name, shared_files
from plurality.session import scratch_path

MIN_REVISIT = 100
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 18
MANIFEST = "path string, n_records long"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed record."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Member:
    """Buffered reads from one gzip member, decompressed as they are asked for."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.zip, self.packed, self.ready = stream, zlib.decompressobj(31), rest, b""

    def fill(self) -> bool:
        if self.zip.eof:
            return False
        packed = self.packed or self.stream.read(READ_BYTES)
        if not packed:
            raise ValueError("archive ends inside a record")
        self.ready += self.zip.decompress(packed, READ_BYTES)
        self.packed = self.zip.unused_data if self.zip.eof else self.zip.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.ready.find(mark)) < 0:
            if not self.fill():
                raise ValueError("record without an end of its head")
        out, self.ready = self.ready[:at], self.ready[at + len(mark):]
        return out

    def parts(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.ready and not self.fill():
                raise ValueError("record shorter than its Content-Length")
            out, self.ready = self.ready[:n], self.ready[n:]
            n -= len(out)
            yield out

    def close(self) -> bytes:
        """Checks the record's end; returns the bytes that follow the member."""
        if b"".join(self.parts(4)) != b"\r\n\r\n":
            raise ValueError("record longer than its Content-Length")
        while self.fill():
            pass
        if self.ready:
            raise ValueError("more than one record in a member")
        return self.packed


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def read_records(stream) -> Iterator[tuple[dict[str, str], int, str, bytes]]:
    """(fields, payload length, payload digest, payload) of each record; revisits have an empty payload and the declared length and digest."""
    rest = b""
    while rest or (rest := stream.read(READ_BYTES)):
        source = _Member(stream, rest)
        fields = _fields(source.until(b"\r\n\r\n"))
        block, body, http, seen = hashlib.sha256(), hashlib.sha256(), b"", None
        payload = []
        for part in source.parts(int(fields["Content-Length"])):
            block.update(part)
            if seen is None:
                http += part
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                part, http, seen = http[at + 4:], http[:at], 0
            seen += len(part)
            body.update(part)
            payload.append(part)
        rest = source.close()
        if seen is None:
            raise ValueError("block without an HTTP head")
        size, digest = int(_fields(http)["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if block.hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
            raise ValueError(f"block digest of {fields['WARC-Record-ID']} does not match")
        if fields["WARC-Type"] == "response" and (size != seen or digest != body.hexdigest()):
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its length or digest")
        yield fields, size, digest, b"".join(payload)


def assign_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses). Only ids and digests meet by digest; the html moves once, by page_id."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    narrow = rows.select("page_id", "digest", F.octet_length("html").alias("size")).filter((F.col("size") >= MIN_REVISIT) & F.col("page_id").isNotNull())
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    first = cut(first.filter("refers_to < last").drop("last"))
    again = narrow.join(first, "digest").filter("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    return rows.join(cut(again), ["page_id", "digest"], "left")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives; returns their manifest (path, n_records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = shared_files(folder)
        done: list[tuple[str, int]] = []
        stream, path, size, n = None, "", 0, 0
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*[batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")], strict=True):
                if stream is None:
                    fs.create_dir(root, recursive=True)
                    name = own_name("pages") + ".warc.gz"
                    stream, path, size, n = fs.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None), f"{folder.rstrip('/')}/{name}", 0, 0
                packed = member(record(page_id.as_py(), url.as_py(), html.as_py(), digest.as_py(), refers_to.as_py(), refers_to.is_valid))
                stream.write(packed)
                size, n = size + len(packed), n + 1
                if size >= archive_bytes:
                    stream.close()
                    done.append((path, n))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((path, n))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["path", "n_records"])

    # the manifest is the commit: archives that no finished task reported are never read
    return cut(assign_revisits(pages).mapInArrow(run, MANIFEST))


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives in ``manifest``."""
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for uri, expected in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                fs, path = shared_files(uri)
                out: list[list] = [[], [], [], [], []]
                seen = 0
                with fs.open_input_stream(path, compression=None) as stream:
                    try:
                        for fields, size, digest, _ in read_records(stream):
                            target = fields.get("WARC-Refers-To")
                            row = (_page(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], _page(target) if target else None)
                            for column, value in zip(out, row, strict=True):
                                column.append(value)
                            seen += 1
                            if len(out[0]) >= 10_000:
                                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                                out = [[], [], [], [], []]
                    except (ValueError, KeyError, zlib.error) as error:
                        raise ValueError(f"{uri}: {error}") from error
                if seen != expected:
                    raise ValueError(f"{uri}: {seen} records, {expected} were written")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return manifest.repartition(n, "path").mapInArrow(run, ROWS)


def op5_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return read_archives(write_archives(pages, scratch_path(spark, "warc")))
