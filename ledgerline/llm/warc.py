"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole records up to ``frame_bytes``
of them (a longer record has a frame of its own), and ends with the seek table of the seekable format:
a skippable frame listing the compressed and uncompressed size of each frame. The index maps a record
identifier to its bundle, frame and offset within the frame's uncompressed bytes, so one record is read
by one ranged read of the footer and one of its frame.

Tasks write bundles under unique names into a folder that all executors share, and the index, which
Spark commits as a table, says which of them count; a task that is tried again leaves an unlisted file
and nothing else. Payloads of the same content are stored once: of the records with equal payloads the
one with the largest identifier is a response and the others are revisits that refer to it.

Defined results: identifiers are whole numbers or text of their digits, and other text stops the job with Spark's
cast error; a null payload is empty; a null url is written as empty; null identifiers sort below
all others and are kept; of rows that repeat identifier and payload the one with the smallest url is
the response and the rest revisit it; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26

# Fixed values of the formats: skippable frame and seek table magic numbers, line end, version line.
_SKIPPABLE = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1
_END = b"\r\n"
_VERSION = b"WARC/1.1"

INDEX = "page_id long, record_type string, refers_to long, bundle string, frame int, frame_at long, frame_size long, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _file(path: str):
    """(file system, path) for a URI that pyarrow knows, or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _name(page_id) -> bytes:
    return b"urn:page:" + (b"null" if page_id is None else str(page_id).encode())


def _number(name: bytes) -> int | None:
    return None if (tail := name.rsplit(b":", 1)[1]) == b"null" else int(tail)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has no payload of its own, but its digest and length."""
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    body = b"" if revisit else payload
    head = [
        _VERSION,
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <" + _name(page_id) + b">",
        b"WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "surrogatepass"),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Payload-Digest: sha1:" + digest,
        b"WARC-Payload-Length: " + str(len(payload)).encode(),
        *([b"WARC-Refers-To: <" + _name(refers_to) + b">", b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        b"Content-Type: text/html; charset=utf-8",
        b"Content-Length: " + str(len(body)).encode(),
    ]
    return _END.join(head) + _END * 2 + body + _END * 2


def parse(raw: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """Headers and block of a record."""
    head, _, rest = raw.partition(_END * 2)
    lines = head.split(_END)
    if lines[0] != _VERSION:
        raise ValueError("no WARC record here")
    headers = dict(x.split(b": ", 1) for x in lines[1:])
    size = int(headers[b"Content-Length"])
    if len(rest) != size + 4 or rest[size:] != _END * 2:
        raise ValueError("a record of another length")
    return headers, rest[:size]


class Bundle:
    """Writes one bundle file, frame by frame."""

    def __init__(self, path: str, frame_bytes: int):
        import zstandard

        self.path, self.limit = path, frame_bytes
        system, inner = _file(path)
        self.out, self.zip = system.open_output_stream(inner, compression=None), zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.at, self.parts, self.size, self.open_rows = 0, [], 0, []

    def add(self, raw: bytes, row: tuple) -> Iterator[tuple]:
        """Add a record; rows of the index come when their frame is complete."""
        if self.size and self.size + len(raw) > self.limit:
            yield from self.end_frame()
        self.open_rows.append((*row, self.size, len(raw)))
        self.parts.append(raw)
        self.size += len(raw)

    def end_frame(self) -> Iterator[tuple]:
        if not self.parts:
            return
        packed = self.zip.compress(b"".join(self.parts))
        self.out.write(packed)
        for *row, offset, length in self.open_rows:
            yield (*row, self.path, len(self.frames), self.at, len(packed), offset, length)
        self.frames.append((len(packed), self.size))
        self.at, self.parts, self.size, self.open_rows = self.at + len(packed), [], 0, []

    def close(self) -> Iterator[tuple]:
        yield from self.end_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(read, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed size, uncompressed size) of each frame; read(at, n) gives bytes of a bundle of that size."""
    n, _, magic = struct.unpack("<IBI", read(size - 9, 9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table at the end")
    flat = struct.unpack(f"<{2 * n}I", read(size - 9 - 8 * n, 8 * n))
    out, at = [], 0
    for packed, plain in zip(flat[::2], flat[1::2], strict=True):
        out.append((at, packed, plain))
        at += packed
    return out


def _rows(found: list[tuple], columns: str) -> pd.DataFrame:
    pdf = pd.DataFrame(found, columns=[x.split()[0] for x in columns.split(", ")])
    return pdf.astype({c: "Int64" for c in ("page_id", "refers_to")})


def _writer(folder: str, frame_bytes: int, bundle_bytes: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle = None
        for pdf in batches:
            found: list[tuple] = []
            for page_id, url, html, refers_to, revisit in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], pdf["revisit"], strict=True):
                page_id, refers_to = (None if x is None else int(x) for x in (page_id, refers_to))
                bundle = bundle or Bundle(f"{folder}/{uuid.uuid4().hex}.warc.zst", frame_bytes)
                raw = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, revisit)
                found.extend(bundle.add(raw, (page_id, "revisit" if revisit else "response", refers_to if revisit else None)))
                if bundle.at >= bundle_bytes:
                    found.extend(bundle.close())
                    bundle = None
            yield _rows(found, INDEX)
        if bundle:
            yield _rows(list(bundle.close()), INDEX)

    return write


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write all rows as records into bundles under ``folder``; returns the index as a table there.

    Payloads under ``least_bytes`` bytes are always responses. The choice of responses runs over
    identifiers and digests alone; payloads are shuffled once, by identifier and digest, so many copies
    of one payload don't meet in one task.
    """
    spark = pages.sparkSession
    system, inner = _file(folder)
    system.create_dir(f"{inner}/bundles", recursive=True)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html")
    ).withColumn("digest", F.unhex(F.sha2(F.col("html"), 256)))
    # a key of identifier and content that is never null, so that one exchange serves the join and the order of repeats
    rows = rows.withColumn("key", F.xxhash64("page_id", "digest"))
    keys = rows.filter(F.octet_length("html") >= least_bytes).select("key", "page_id", "digest").distinct()
    largest = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"))
    refers = keys.join(largest, "digest").select("key", "digest", "refers_to")
    repeats = Window.partitionBy("key", "digest", "page_id").orderBy("url")
    first = F.col("page_id").eqNullSafe(F.col("refers_to")) & (F.col("nth") == 1)
    chosen = (
        rows.join(refers, ["key", "digest"], "left")
        .withColumn("nth", F.row_number().over(repeats))
        .withColumn("revisit", (F.octet_length("html") >= least_bytes) & ~first)
        .select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"), "revisit")  # pandas makes floats of numbers with nulls
    )
    index = chosen.mapInPandas(_writer(f"{folder}/bundles", frame_bytes, bundle_bytes), INDEX)
    index.write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _reader(payloads: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        opened, source, frames = None, None, []
        last, plain = None, b""
        for pdf in batches:
            out = []
            for bundle, frame, offset, length in zip(pdf["bundle"], pdf["frame"], pdf["offset"], pdf["length"], strict=True):
                if (bundle, frame) != last:
                    if bundle != opened:
                        system, inner = _file(bundle)
                        source, opened = system.open_input_file(inner), bundle
                        frames = seek_table(lambda at, n, source=source: source.read_at(n, at), source.size())
                    at, packed, size = frames[frame]
                    plain, last = unzip.decompress(source.read_at(packed, at), max_output_size=size), (bundle, frame)
                headers, body = parse(plain[offset : offset + length])
                page_id, kind = _number(headers[b"WARC-Record-ID"][1:-1]), headers[b"WARC-Type"].decode()
                refers = _number(headers[b"WARC-Refers-To"][1:-1]) if kind == "revisit" else None
                out.append((page_id, int(headers[b"WARC-Payload-Length"]), headers[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), kind, refers, headers[b"WARC-Target-URI"].decode("utf-8", "surrogatepass"), body if payloads else None))
            yield _rows(out, RECORD)

    return read


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that an index, or a part of it, lists, read from their frames; a revisit's payload is empty."""
    wanted = index.select("bundle", "frame", "offset", "length")
    # each task reads whole runs of frames, in order
    return wanted.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInPandas(_reader(payloads), RECORD)
