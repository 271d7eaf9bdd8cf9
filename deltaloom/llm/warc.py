"""WARC archives: one gzip member per record, written by executors and read back sequentially.

Files go to a folder that all executors share, through pyarrow's file systems (local, HDFS, S3, GCS). A file is written
under a temporary name and moved when whole, so a task that is repeated after a loss leaves no half file behind.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.text import named
from deltaloom.sources.scratch import Scratch

# Fixed values of the format.
VERSION = b"WARC/1.1"
CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT_BYTES = 100
MAX_FILE_BYTES = 1 << 28
READ_BYTES = 1 << 16
_NAMES = uuid.UUID("6f0d5a5e-58a6-4c0e-9a0a-2f1d7a4f3b11")


class WarcError(ValueError):
    """The archive breaks the format or one of its digests."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes = field(repr=False)

    @property
    def type(self) -> str:
        return self.headers["WARC-Type"]

    def http(self) -> tuple[dict[str, str], bytes]:
        """The HTTP headers of the block and its payload."""
        head, blank, payload = self.block.partition(CRLF + CRLF)
        if not blank:
            raise WarcError("an HTTP block without the empty line that ends its headers")
        return _fields(head.split(CRLF)[1:]), payload


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"a header line without a colon: {line[:80]!r}")
        out[name.strip().decode()] = value.strip().decode()
    return out


def _one_line(text: str) -> str:
    return " ".join(text.split()) or "urn:unknown"


def record_id(page_id: int | None, digest: str, place: str) -> str:
    """Rows may repeat a page and its payload, so the place in the archives goes in as well."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id} {digest} {place}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, place: str = "") -> bytes:
    """A response record, or a revisit record without payload, as one gzip member.

    A revisit names its payload by the digest, as its profile has it, and the page that holds it in a field of its own.
    """
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    block = CRLF.join(http) + CRLF + CRLF + (payload if refers_to is None else b"")
    lines = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest, place),
        "WARC-Date": date,
        "WARC-Target-URI": _one_line(url or ""),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "X-Page-ID": "" if page_id is None else str(page_id),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        lines |= {"WARC-Profile": REVISIT_PROFILE, "X-Refers-To-Page-ID": str(refers_to)}
    head = VERSION + CRLF + b"".join(f"{name}: {value}".encode() + CRLF for name, value in lines.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + CRLF + block + CRLF + CRLF) + packer.flush()


class WarcReader:
    """Reads a stream of records front to back. It holds one record and one piece of the file at a time."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream = stream
        self.packed = b""
        self.plain = b""
        self.member = None

    def _more(self) -> bool:
        """Unpacks another piece of the member at hand; False at its end."""
        if self.member is None or self.member.eof:
            return False
        if not self.packed:
            self.packed = self.stream.read(READ_BYTES)
            if not self.packed:
                raise WarcError("the file ends inside a gzip member")
        try:
            self.plain += self.member.decompress(self.packed, READ_BYTES)
        except zlib.error as problem:
            raise WarcError(f"a damaged gzip member: {problem}") from problem
        self.packed = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        return True

    def _next_member(self) -> bool:
        self.packed = self.packed or self.stream.read(READ_BYTES)
        if not self.packed:
            return False
        self.member, self.plain = zlib.decompressobj(31), b""
        return True

    def _line(self) -> bytes:
        while CRLF not in self.plain:
            if not self._more():
                raise WarcError("a record ends inside its headers")
        line, _, self.plain = self.plain.partition(CRLF)
        return line

    def _exactly(self, n: int) -> bytes:
        parts, got = [self.plain[:n]], len(self.plain[:n])
        self.plain = self.plain[n:]
        while got < n:
            if not self._more():
                raise WarcError(f"a record ends after {got} of {n} bytes")
            parts.append(self.plain[: n - got])
            self.plain = self.plain[n - got :]
            got += len(parts[-1])
        return b"".join(parts)

    def __iter__(self) -> Iterator[Record]:
        while self._next_member():
            if self._line() != VERSION:
                raise WarcError("a record that does not begin with its version")
            lines = []
            while line := self._line():
                lines.append(line)
            headers = _fields(lines)
            if not headers.get("Content-Length", "").isdigit():
                raise WarcError("a record without a content length")
            record = Record(headers, self._exactly(int(headers["Content-Length"])))
            if self._exactly(4) != CRLF + CRLF:
                raise WarcError("a record that is not closed by two empty lines")
            while self._more():
                pass
            if self.plain:
                raise WarcError("more than one record in a gzip member")
            verify(record)
            yield record


def verify(record: Record) -> None:
    """Block digest always; payload digest and length where the record holds its payload."""
    if (given := record.headers.get("WARC-Block-Digest")) and given != f"sha256:{hashlib.sha256(record.block).hexdigest()}":
        raise WarcError("a block digest does not hold")
    if record.type == "response":
        http, payload = record.http()
        if record.headers["WARC-Payload-Digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}" or int(http["Content-Length"]) != len(payload):
            raise WarcError("a payload digest or length does not hold")


# -- Spark ----------------------------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, payload, digest and refers_to, the page that holds the payload of a revisit.

    Revisits are found from ids and digests alone and are written as a table, so that Spark knows its size: a short one
    is broadcast, and payloads stay where they are. Else payloads meet it by digest and page, so the copies of one page
    are spread over all tasks, however many there are.
    """
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit("").cast("binary"))
    plain = named(pages, "page_id", "url", "html").select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    plain = plain.withColumn("digest", F.sha2("payload", 256))
    keys = plain.where(F.octet_length("payload") >= MIN_REVISIT_BYTES).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    keys = scratch.save(keys.select("page_id", F.unhex("digest").alias("digest"), "n"), "keys")
    keepers = keys.groupBy("digest").agg(F.min("page_id").alias("keeper"), F.sum("n").alias("n")).where("n > 1").select(F.col("digest").alias("held"), "keeper")
    revisits = keys.join(keepers, F.col("digest") == F.col("held")).where(~F.col("page_id").eqNullSafe(F.col("keeper")))
    revisits = scratch.save(revisits.select(F.lower(F.hex("held")).alias("held"), F.col("page_id").alias("page"), F.col("keeper").alias("refers_to")), "revisits")
    same = (F.col("digest") == F.col("held")) & F.col("page_id").eqNullSafe(F.col("page"))
    return plain.join(revisits, same, "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(pages: DataFrame, scratch: Scratch, folder: str, max_file_bytes: int = MAX_FILE_BYTES, date: datetime | None = None) -> DataFrame:
    """Writes every page and returns (path, records, bytes) per file; the files are written when that is evaluated."""
    stamp = (date or datetime(2024, 1, 1, tzinfo=timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number, out = TaskContext.get().partitionId(), 0, None
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        attempt = uuid.uuid4().hex

        def close() -> pd.DataFrame:
            out.close()
            store.move(f"{root}/{attempt}-{number}.part", f"{root}/{part:06d}-{number:04d}.warc.gz")
            return pd.DataFrame({"path": [f"{folder}/{part:06d}-{number:04d}.warc.gz"], "records": [records], "bytes": [size]})

        for batch in batches:
            for page_id, url, payload, digest, refers_to in batch.itertuples(index=False):
                if out is None:
                    out, records, size = store.open_output_stream(f"{root}/{attempt}-{number}.part"), 0, 0
                ids = [None if pd.isna(x) else int(x) for x in (page_id, refers_to)]
                member = encode_record(ids[0], url, bytes(payload), digest, ids[1], stamp, f"{part}-{number}-{records}")
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= max_file_bytes:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    return with_revisits(pages, scratch).mapInPandas(run, "path string, records bigint, bytes bigint")


READ_SCHEMA = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read_archives(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives in files(path), one task per few files, each file front to back.

    payload is null for revisits, and for all records if it is not asked for. Damage raises.
    """

    def rows(path: str) -> Iterator[tuple]:
        store, name = fs.FileSystem.from_uri(path)
        with store.open_input_stream(name, compression=None) as stream:
            for record in WarcReader(stream):
                h = record.headers
                http, payload = record.http()
                page, refers = (int(h[k]) if h.get(k) else None for k in ("X-Page-ID", "X-Refers-To-Page-ID"))
                held = payload if with_payload and record.type == "response" else None
                yield page, h["WARC-Target-URI"], int(http["Content-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:"), record.type, refers, held

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in READ_SCHEMA.split(", ")]

        def frame(found: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(found, columns=names)
            return out.astype({"page_id": "Int64", "refers_to": "Int64"})

        for batch in batches:
            for path in batch["path"]:
                found, held = [], 0
                for row in rows(path):
                    found.append(row)
                    held += len(row[-1] or b"") + 200
                    if held > 1 << 24:
                        yield frame(found)
                        found, held = [], 0
                if found:
                    yield frame(found)

    return files.select("path").mapInPandas(run, READ_SCHEMA)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and returns what a reader finds in them.

    A null html is an empty payload; payloads under 100 bytes are always responses. A row that repeats page and payload
    of the response is a response too; a row without page_id is a revisit where a numbered page holds its payload.
    No pages, no archives, no rows.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    files = scratch.save(write_archives(pages, scratch, scratch.path("archives")), "manifest")
    return read_archives(files.repartition(max(1, files.count()), "path"), with_payload=False)
