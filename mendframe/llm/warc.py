"""WARC archives: write whole-file gzip, normalise to a member per record, index, read back."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from mendframe.functions import tables

DATE = "2024-01-01T00:00:00Z"
READ_BYTES = 1 << 20  # of a file at a time
ARCHIVE_BYTES = 256 << 20  # uncompressed bytes after which a task starts its next archive
MIN_DEDUP_BYTES = 0
GZIP = 31  # zlib window bits of a gzip stream


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record_bytes(record_id: str, url: str | None, payload: bytes, sha1: str, refers_to: str | None) -> bytes:
    """One WARC record. A revisit has no payload; its digest and length are those of the whole one."""
    revisit = refers_to is not None
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{record_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = b"" if revisit else payload
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def _one_line(text: str | None) -> str:
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def inflate(stream: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, in pieces, read once."""
    engine, waiting = None, b""
    while True:
        chunk = waiting or stream.read(READ_BYTES)
        waiting = b""
        if not chunk:
            if engine is not None:
                raise EOFError("the archive ends inside a gzip member")
            return
        engine = engine or zlib.decompressobj(GZIP)
        piece = engine.decompress(chunk, READ_BYTES)
        if piece:
            yield piece
        if engine.eof:
            waiting, engine = engine.unused_data, None
        else:
            waiting = engine.unconsumed_tail


def read_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record as bytes) of each record of a WARC stream; holds one record at a time."""
    held = bytearray()

    def fill(size: int) -> bool:
        while len(held) < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                raise EOFError("the archive ends inside a header")
        headers = parse_headers(bytes(held[:end]))
        size = end + 4 + int(headers["content-length"]) + 4
        if not fill(size):
            raise EOFError("the archive ends inside a record")
        yield headers, bytes(held[:size])
        del held[:size]


def parse_headers(block: bytes) -> dict[str, str]:
    first, *lines = block.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {name.lower(): value for name, value in (line.split(": ", 1) for line in lines)}


def normalise(source: BinaryIO, target: BinaryIO) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Rewrite every record as a gzip member of its own; (offset, length, headers) of each."""
    offset = 0
    for headers, record in read_records(inflate(source)):
        engine = zlib.compressobj(6, zlib.DEFLATED, GZIP)
        member = engine.compress(record) + engine.flush()
        target.write(member)
        yield offset, len(member), headers
        offset += len(member)


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder: a mounted path, or a store that Arrow opens by its address."""
    if "://" in folder or folder.startswith("file:"):
        if folder.startswith("file:") and not folder.startswith("file://"):
            folder = "file://" + folder.removeprefix("file:")
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder


class _Committed:
    """A file that appears under its name only once it is whole; a repeated task replaces it."""

    def __init__(self, files: pafs.FileSystem, path: str, attempt: str) -> None:
        self.files, self.path, self.draft = files, path, f"{path}.{attempt}.draft"
        self.stream = files.open_output_stream(self.draft, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def commit(self) -> None:
        self.stream.close()
        self.files.move(self.draft, self.path)


def _attempt() -> tuple[int, str]:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId(), str(context.taskAttemptId())


def with_digests(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, sha1) of every page; the payload is the html in UTF-8, NULL is empty."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))


def with_revisits(pages: DataFrame, min_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """Add ``refers_to``: the smallest page id with the same payload where the row is not that page.

    Payloads are equal if digest and length are. Ids alone meet in the aggregation; a
    payload that fills a third of the pages is looked up as a hot key. Every row with the
    smallest id is a response, repeated rows included; rows without id refer to it
    where there is one. Payloads under ``min_bytes`` are all responses.
    """
    keys = pages.withColumn("size", F.octet_length("payload"))
    firsts = tables.cut(
        keys.where(F.col("size") >= min_bytes).groupBy("sha1", "size")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"),
        "firsts",
    )
    found = tables.lookup(keys, firsts, ["sha1", "size"])
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return found.withColumn("refers_to", F.when(other, F.col("first"))).drop("first", "size")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, payload, sha1, refers_to) rows as whole-file gzip archives; gives their paths."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _files(folder)
        part, attempt = _attempt()
        done, out, engine, size = [], None, None, 0

        def close() -> None:
            out.write(engine.flush())
            out.commit()
            done.append(out.path)

        for frame in frames:
            for page, url, payload, sha1, refers_to in zip(*(frame[c] for c in ("page_id", "url", "payload", "sha1", "refers_to"))):
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = _Committed(files, f"{root}/part-{part:06d}-{len(done):04d}.warc.gz", attempt)
                    engine, size = zlib.compressobj(6, zlib.DEFLATED, GZIP), 0
                record = record_bytes(page or "", url, bytes(payload), base32(sha1), refers_to)
                out.write(engine.compress(record))
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pd.DataFrame({"archive": done})

    texts = records.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "sha1",
                           F.col("refers_to").cast("string").alias("refers_to"))
    return texts.mapInPandas(write, "archive string")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with a member per record and a sidecar index; gives (archive, index_path, n_records).

    A task inflates its archive once, as a stream, and holds one record at a time.
    The index has a JSON line per record: its offset, length, id and type.
    """

    def rewrite(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _files(folder)
        _, attempt = _attempt()
        for frame in frames:
            for path in frame["archive"]:
                files.create_dir(root, recursive=True)
                target = f"{root}/{path.rsplit('/', 1)[-1]}"
                out, index = _Committed(files, target, attempt), _Committed(files, f"{target}.idx", attempt)
                n = 0
                with files.open_input_stream(path, compression=None) as source:
                    for offset, length, headers in normalise(source, out):
                        entry = {"offset": offset, "length": length, "id": headers["warc-record-id"], "type": headers["warc-type"]}
                        index.write(json.dumps(entry).encode() + b"\n")
                        n += 1
                out.commit()
                index.commit()
                yield pd.DataFrame({"archive": [target], "index_path": [f"{target}.idx"], "n_records": [n]})

    return archives.mapInPandas(rewrite, "archive string, index_path string, n_records long")


def read_archives(normalised: DataFrame, folder: str) -> DataFrame:
    """Every record through the sidecar index: its headers' word and its payload's own size and digest.

    Each record is read by offset and inflated by itself. A response whose digest is
    not the one in its header raises.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = _files(folder)
        columns = ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        for frame in frames:
            for path, index_path in zip(frame["archive"], frame["index_path"]):
                rows = []
                with files.open_input_file(path) as archive, files.open_input_stream(index_path, compression=None) as index:
                    for line in _lines(index):
                        rows.append(read_record(archive, line))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                yield pd.DataFrame(rows, columns=columns)

    return normalised.select("archive", "index_path").mapInPandas(
        read,
        "record_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string",
    )


def _lines(stream: BinaryIO) -> Iterator[dict]:
    rest = b""
    while chunk := stream.read(READ_BYTES):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from map(json.loads, whole)


def read_record(archive: BinaryIO, entry: dict) -> tuple:
    archive.seek(entry["offset"])
    record = zlib.decompress(archive.read(entry["length"]), GZIP)
    head, _, body = record.partition(b"\r\n\r\n")
    headers = parse_headers(head)
    sha1 = headers["warc-payload-digest"].removeprefix("sha1:")
    size = int(headers["x-payload-length"])
    if entry["type"] == "response":
        payload = body[: int(headers["content-length"])]
        if (len(payload), digest(payload)) != (size, sha1):
            raise ValueError(f"{entry['id']}: the payload is not the one its header names")
    refers_to = headers.get("warc-refers-to")
    return (_bare(entry["id"]), size, sha1, entry["type"], _bare(refers_to), headers["warc-target-uri"])


def _bare(record_id: str | None) -> str | None:
    return record_id and record_id.removeprefix("<urn:page:").removesuffix(">") or None


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages to archives, normalise those, read every record back.

    Gives (page_id, payload_bytes, payload_digest, record_type, refers_to), one row per
    row of ``pages`` (page_id, url, html). ``folder`` is shared by all tasks; by default
    a new one under ``spark.checkpoint.dir``. NULL html is an empty payload, a NULL url
    an empty one, a NULL id comes back as NULL; an empty table writes no archive. Files
    get their name when they are whole, so a task that runs again replaces its own.
    """
    spark = pages.sparkSession
    folder = folder or tables.scratch_path(spark, "warc")
    kind = pages.schema["page_id"].dataType
    records = with_revisits(with_digests(pages))
    archives = tables.cut(write_archives(records, f"{folder}/whole"), "archives")
    spread = archives.repartition(max(1, archives.count()), "archive")
    normalised = tables.cut(normalise_archives(spread, f"{folder}/records"), "normalised")
    found = read_archives(normalised.repartition(max(1, normalised.count()), "archive"), folder)
    return found.select(
        F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
