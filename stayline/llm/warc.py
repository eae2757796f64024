"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is a file of such frames, closed by a seek table in a
skippable frame (the public "zstd seekable format"), so any WARC reader can stream it and any frame can be read alone.
An index maps each record identifier to its bundle, its frame and its offset in that frame's decompressed bytes.

Records of equal payload are written once: the one with the smallest id is a `response`, the others are `revisit`s that
refer to it. Payloads below `least` bytes are all responses.

Bundles are written through Arrow's file systems under a URI that all executors share. Each attempt of a task writes new
files and the index, a table written by Spark, names those of the attempt that counted; files of lost attempts are never
named and so never read.

Defined results: a null payload is an empty one; a null URL leaves its header out and control characters in a URL are
percent-encoded; rows repeated with the smallest id are all responses; rows with a null id are written as responses of
their own; an empty table gives no bundle and an empty index; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import streamed, written
from stayline.sources.tables import new_path

#: Decompressed bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME, BUNDLE = 256 << 10, 256 << 20
LEVEL = 3
# Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, page_id long, path string, frame int, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def opened(uri: str):
    """Arrow's file system of a URI or local path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    """One WARC 1.1 record; first: the id of the response it revisits, if any."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    kind = "response" if first is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parsed(data: bytes, start: int = 0) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record at a place."""
    end = data.index(b"\r\n\r\n", start)
    first, *rest = data[start:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no record starts here")
    headers = dict(line.split(": ", 1) for line in rest)
    return headers, data[end + 4 : end + 4 + int(headers["Content-Length"])]


class Bundle:
    """A file being written: frames, then the seek table."""

    def __init__(self, folder: str):
        import zstandard

        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        system, inner = opened(self.path)
        self.out = system.open_output_stream(inner, compression=None)  # the frames are made here
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int]] = []
        self.open, self.size = bytearray(), 0

    def add(self, data: bytes) -> tuple[int, int]:
        place = len(self.frames), len(self.open)
        self.open += data
        if len(self.open) >= FRAME:
            self.flush()
        return place

    def flush(self) -> None:
        if self.open:
            packed = self.packer.compress(bytes(self.open))
            self.out.write(packed)
            self.frames.append((len(packed), len(self.open)))
            self.size += len(packed)
            self.open = bytearray()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


@lru_cache(maxsize=64)
def seek_table(path: str) -> list[tuple[int, int]]:
    """(offset, compressed size) of each frame, from the end of the file."""
    system, inner = opened(path)
    with system.open_input_file(inner) as f:
        size = f.size()
        n, _, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table in {path}")
        table = f.read_at(8 * n, size - 9 - 8 * n)
    places, at = [], 0
    for packed, _ in struct.iter_unpack("<II", table):
        places.append((at, packed))
        at += packed
    return places


def frame(path: str, number: int) -> bytes:
    """One frame, decompressed; nothing else of the file is read but the seek table."""
    import zstandard

    offset, size = seek_table(path)[number]
    system, inner = opened(path)
    with system.open_input_file(inner) as f:
        return zstandard.ZstdDecompressor().decompress(f.read_at(size, offset))


def write(pages: DataFrame, path: str | None = None, least: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write (page_id, url, html) as bundles under a path and return the index (record_id, page_id, path, frame, offset, length).

    A record is offset `offset` of its frame and `length` bytes long. Without a path, a new one in the shared folder.
    """
    folder = path or new_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    first = rows.where("page_id is not null").groupBy(F.col("digest").alias("of")).agg(F.min("page_id").alias("first"))
    of = (F.col("digest") == F.col("of")) & (F.octet_length("html") >= least)
    told = rows.join(first, of, "left").select("page_id", "url", "html", F.expr("CASE WHEN page_id > first THEN first END").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = opened(folder)
        system.create_dir(inner, recursive=True)
        bundle = None
        for batch in batches:
            out = []
            for page_id, url, html, earlier in zip(*(c.to_pylist() for c in batch.columns)):
                bundle = bundle or Bundle(folder)
                data = record(page_id, url, html.encode("utf-8", "replace"), earlier, date)
                number, offset = bundle.add(data)
                out.append((f"<urn:page:{page_id}>", page_id, bundle.path, number, offset, len(data)))
                if bundle.size >= BUNDLE:
                    bundle.close()
                    bundle = None
            if out:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                names = ["record_id", "page_id", "path", "frame", "offset", "length"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
        if bundle:
            bundle.close()

    return written(told.mapInArrow(run, INDEX))


def read(index: DataFrame) -> DataFrame:
    """The records that an index, or any rows of it, names: headers and payload, read frame by frame.

    `payload` is null for a revisit; `payload_bytes` and `payload_digest` are of the full payload either way.
    """

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        data = frame(group["path"][0].as_py(), group["frame"][0].as_py())
        out = []
        for offset in group["offset"].to_pylist():
            headers, block = parsed(data, offset)
            name = re.fullmatch(r"<urn:page:(-?\d+|None)>", headers["WARC-Record-ID"])[1]
            refers = headers.get("WARC-Refers-To")
            http, _, payload = block.partition(b"\r\n\r\n")
            length = int(re.search(rb"Content-Length: (\d+)", http)[1])
            kind = headers["WARC-Type"]
            if kind == "response" and digest(payload) != headers["WARC-Payload-Digest"][5:]:
                raise ValueError(f"payload of {name} is damaged")
            out.append((None if name == "None" else int(name), length, headers["WARC-Payload-Digest"][5:], kind, refers and int(refers[10:-1]), headers.get("WARC-Target-URI"), payload if kind == "response" else None))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], list(names))

    return streamed(index, ["path", "frame"], run, RECORDS)
