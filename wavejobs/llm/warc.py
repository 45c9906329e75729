"""WARC records in seekable Zstandard bundles."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavejobs.llm.common import shared_dir

#: Uncompressed bytes that close a frame, and a bundle.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
#: Payloads below this size are never revisits.
LEAST_BYTES = 0
#: Fixed values of the seekable Zstandard format: magic numbers of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: The footer ends with its magic number; Spark's text writer puts it there as the row's line separator.
_END = struct.pack("<I", SEEKABLE)

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}" if page_id is not None else f"payload:{digest}"))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response with an HTTP block, or a revisit without one, of the page with that id."""
    digest = base32(hashlib.sha1(payload).digest())
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{record_id(page_id, digest)}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:uuid:{record_id(refers_to, digest)}>", f"X-Refers-To-Page: {refers_to}"]
        block = b""
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Records in independent frames; close() adds the seek table, all but its last four bytes."""

    def __init__(self, level: int = 3) -> None:
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.pending = self.total = 0

    def add(self, data: bytes) -> None:
        self.open.append(data)
        self.pending += len(data)
        self.total += len(data)
        if self.pending >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.open:
            data = b"".join(self.open)
            self.frames.append(self.packer.compress(data))
            self.sizes.append((len(self.frames[-1]), len(data)))
            self.open, self.pending = [], 0

    def close(self) -> bytes:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IB", len(self.sizes), 0) + _END
        return b"".join(self.frames) + (struct.pack("<II", SKIPPABLE, len(table)) + table)[: -len(_END)]


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from the footer."""
    frames, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("not a seekable bundle")
    at, found = 0, []
    start = len(content) - 9 - 8 * frames
    for i in range(frames):
        packed, size = struct.unpack_from("<II", content, start + 8 * i)
        found.append((at, packed, size))
        at += packed
    return found


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        stop = end + 4 + int(head["Content-Length"])
        yield at, stop + 4 - at, head, data[end + 4 : stop]
        at = stop + 4


def write(pages: DataFrame, path: str, least: int = LEAST_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Write a record for every row of pages to bundle files under path.

    Of records with equal payloads of at least `least` bytes the one with the
    smallest page_id is the response and the others revisit it. Only digests are
    grouped; pages then meet their group's smallest id by digest, a join in
    which Spark can split a hot payload. Each task streams its rows into bundles
    of bounded size, and each bundle is a file of its own.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("first"))
    joined = rows.join(firsts, "sha", "left").select("page_id", "url", "payload", "first")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle = Bundle()
        for part in batches:
            for page, url, data, first in zip(part["page_id"], part["url"], part["payload"], part["first"]):
                page, first = (None if pd.isna(x) else int(x) for x in (page, first))
                bundle.add(record(page, url, bytes(data), first, first is not None and page != first))
                if bundle.total >= bundle_bytes:
                    yield pd.DataFrame({"value": [bundle.close()]})
                    bundle = Bundle()
        if bundle.total:
            yield pd.DataFrame({"value": [bundle.close()]})

    packed = joined.select("page_id", "url", "payload", "first").mapInPandas(pack, "value binary")
    packed.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", _END.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


_INDEX = "record_id string, page_id long, file string, frame int, frame_offset long, frame_bytes long, offset long, length long"
_ROW = _INDEX + ", payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """All records of the bundles under path, with where they are: record id, file, frame and place within the frame.

    Every response's payload is checked against its digest.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _ROW.split(", ")]
        for part in batches:
            for file, content in zip(part["path"], part["content"]):
                content = bytes(content)
                for n, (at, packed, size) in enumerate(seek_table(content)):
                    data = zstandard.ZstdDecompressor().decompress(content[at : at + packed], max_output_size=size)
                    rows = []
                    for offset, length, head, block in records(data):
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        body = block.partition(b"\r\n\r\n")[2]
                        if head["WARC-Type"] == "response" and base32(hashlib.sha1(body).digest()) != digest:
                            raise ValueError(f"{file}, frame {n}: a payload doesn't match its digest")
                        rows.append(
                            (head["WARC-Record-ID"][10:-1], int(head["X-Page-ID"]) if "X-Page-ID" in head else None, file, n, at, packed, offset, length, int(head["X-Payload-Length"]), digest)
                            + (head["WARC-Type"], int(head["X-Refers-To-Page"]) if "X-Refers-To-Page" in head else None, head.get("WARC-Target-URI"), body if payloads else None)
                        )
                    yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(unpack, _ROW)


def store_index(spark: SparkSession, path: str) -> DataFrame:
    """Write where each record is beside the bundles, sorted by record id within files, and return it. One pass over the bundles."""
    names = [c.split()[0] for c in _INDEX.split(", ")]
    read(spark, path).select(names).sortWithinPartitions("record_id").write.mode("overwrite").parquet(f"{path}/_index")
    return stored_index(spark, path)


def stored_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(f"{path}/_index")


def fetch(spark: SparkSession, path: str, page_id: int) -> list[bytes]:
    """A page's records by the stored index, each from the bytes of its own frame: the file is opened at the frame's offset."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for r in stored_index(spark, path).where(F.col("page_id") == page_id).orderBy("record_id", "file", "frame_offset", "offset").toLocalIterator():
        file = jvm.org.apache.hadoop.fs.Path(r.file)
        stream = file.getFileSystem(conf).open(file)
        try:
            stream.seek(r.frame_offset)
            frame = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(r.frame_bytes)))
        finally:
            stream.close()
        out.append(zstandard.ZstdDecompressor().decompress(frame, max_output_size=1 << 30)[r.offset : r.offset + r.length])
    return out


def lookup(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """The records of many index rows (file, frame_offset, frame_bytes, offset, length): record_id and record.

    Of the bundles that are asked for, each is read once and only the frames
    that are asked for are decompressed. For single records see fetch().
    """
    wanted = index.groupBy("file").agg(F.collect_list(F.struct("record_id", "frame_offset", "frame_bytes", "offset", "length")).alias("wanted"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), "content")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for content, some in zip(part["content"], part["wanted"]):
                rows, frames = [], {}
                for w in some:
                    at = w["frame_offset"]
                    if at not in frames:
                        frames[at] = zstandard.ZstdDecompressor().decompress(bytes(content[at : at + w["frame_bytes"]]), max_output_size=1 << 30)
                    rows.append((w["record_id"], frames[at][w["offset"] : w["offset"] + w["length"]]))
                yield pd.DataFrame(rows, columns=["record_id", "record"])

    return files.join(wanted, "file").mapInPandas(cut, "record_id string, record binary")


def archive(pages: DataFrame, path: str | None = None, least: int = LEAST_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write pages to bundles, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload. A null page_id comes after all others: such
    a row is a revisit if its payload has a page with an id, and else a
    response; repeated rows of the smallest page_id are all responses. A null
    url has no target. An empty table gives no rows. Other columns aren't
    looked at.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least, bundle_bytes)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
