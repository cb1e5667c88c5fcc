"""Operator 7: WARC archives with one Zstandard dictionary each.

An archive starts with a skippable frame that holds its dictionary, built from its own first records; then each record
is a frame of its own, so a record can be read alone.  Records of equal payloads (by SHA-256, from ``SHORTEST`` bytes on)
refer to the one of smallest page_id and carry no payload.

Nulls: a null page is an empty payload, a null url an empty target.  A null page_id is never referred to while its group has
another id; a group of null ids only has responses.  Rows that repeat the smallest id and payload are each a response.
Control characters in urls are percent-encoded.  An empty table gives no archive and no row.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import common, files
from holdfast.session import new_folder

SHORTEST = 100
#: Fixed values of the Zstandard and WARC formats: magic number of the skippable frame with a dictionary, WARC version.
SKIPPABLE = 0x184D2A5D
VERSION = b"WARC/1.1"

#: Bytes of a dictionary, of the records it is built from, and of the records of one archive.
DICTIONARY, TRAINING, ARCHIVE = 64 << 10, 4 << 20, 512 << 20
DATE = "1970-01-01T00:00:00Z"
LEVEL = 3


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}')}>"


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to, revisit: bool, date: str = DATE) -> bytes:
    """One WARC record; a revisit has the headers of its payload only."""
    target = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "").encode())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    head = [
        VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + _record_id(page_id).encode(), b"WARC-Date: " + date.encode(), b"WARC-Target-URI: " + target,
        b"WARC-Payload-Digest: sha256:" + digest.encode(), b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block), b"X-Page-ID: " + (b"" if page_id is None else b"%d" % page_id),
    ]
    if revisit:
        head += [
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            b"WARC-Refers-To: " + _record_id(refers_to).encode(), b"X-Refers-To-Page: %d" % refers_to,
        ]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """A record's fields; the digest and size of a response are those of the payload that was read."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != VERSION:
        raise ValueError("not a WARC record")
    h = dict(line.split(b": ", 1) for line in lines)
    block = rest[: int(h[b"Content-Length"])]
    if len(block) != int(h[b"Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record of the wrong length")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = h[b"WARC-Type"].decode()
    digest, size = h[b"WARC-Payload-Digest"].decode().removeprefix("sha256:"), int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response":
        if (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
            raise ValueError("a payload that its headers do not describe")
    page = h[b"X-Page-ID"]
    refers = h.get(b"X-Refers-To-Page")
    return {
        "page_id": int(page) if page else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": int(refers) if refers else None, "url": h[b"WARC-Target-URI"].decode(), "payload": payload,
    }


def dictionary(samples: list[bytes]) -> bytes | None:
    """A dictionary of records, or None where there are too few to build one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=512, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return None


class Archive:
    """Writes one archive; its first records wait until the dictionary is built from them."""

    def __init__(self, uri: str):
        self.uri, self.out, self.waiting, self.held = uri, files.writer(uri), [], 0
        self.records = self.plain = self.bytes = 0
        self.compressor = None

    def add(self, data: bytes) -> None:
        self.records += 1
        self.plain += len(data)
        if self.compressor is None:
            self.waiting.append(data)
            self.held += len(data)
            if self.held >= TRAINING:
                self._start()
        else:
            self._frame(data)

    def _start(self) -> None:
        built = dictionary([w[: 128 << 10] for w in self.waiting])
        if built is not None:
            self._put(struct.pack("<II", SKIPPABLE, len(built)) + built)
        shared = zstandard.ZstdCompressionDict(built) if built is not None else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True, write_content_size=True)
        for w in self.waiting:
            self._frame(w)
        self.waiting = []

    def _frame(self, data: bytes) -> None:
        self._put(self.compressor.compress(data))

    def _put(self, data: bytes) -> None:
        self.bytes += len(data)
        self.out.write(data)

    def close(self) -> tuple[str, int, int, int]:
        if self.compressor is None:
            self._start()
        self.out.close()
        return self.uri, self.records, self.plain, self.bytes


def records(uri: str):
    """Records of an archive one by one; memory holds a record and a read buffer."""
    with files.reader(uri) as f:
        head = f.read(8)
        built = None
        if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
            built, head = zstandard.ZstdCompressionDict(f.read(struct.unpack("<I", head[4:])[0])), b""
        decompressor = zstandard.ZstdDecompressor(dict_data=built) if built else zstandard.ZstdDecompressor()
        data = head
        frame, out = decompressor.decompressobj(), []
        while True:
            if not data:
                data = f.read(1 << 20)
                if not data:
                    break
            out.append(frame.decompress(data))
            data = b""
            if frame.eof:
                data = frame.unused_data
                yield b"".join(out)
                frame, out = decompressor.decompressobj(), []
        if any(out):
            raise ValueError("an archive that ends inside a record")


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, size, refers_to (null for responses)."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    # Partial counts by digest, so a payload that most pages share is one row of each task.
    narrow = pages.select("page_id", payload.alias("payload")).select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size"))
    first = narrow.where(F.col("size") >= SHORTEST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest", "size",
        F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"),
    )


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages as archives; returns the stored list (uri, records, plain_bytes, bytes) of the archives."""
    spark = common.prepared(pages.sparkSession)
    folder = folder or new_folder(spark, "warc")

    def run(batches):
        archive, done = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if archive is None:
                    archive = Archive(files.fresh(folder, f"part-{TaskContext.get().partitionId():05d}", ".warc.zst"))
                revisit = r["refers_to"] is not None
                archive.add(record(r["page_id"], r["url"], r["payload"], r["digest"], r["size"], r["refers_to"], revisit))
                if archive.plain >= ARCHIVE:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2, 3))],
            names=["uri", "records", "plain_bytes", "bytes"],
        )

    listed = with_revisits(pages).mapInArrow(run, "uri string, records long, plain_bytes long, bytes long")
    return common.stored(listed, "archives")


_FIELDS = (
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
)
_TYPES = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def read(spark: SparkSession, archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the listed archives; each archive is read by one task, record by record."""
    fields = [f for f in _FIELDS if payloads or f[0] != "payload"]

    def run(batches):
        def rows(held):
            return pa.RecordBatch.from_arrays([pa.array([h[n] for h in held], t) for n, t in fields], names=[n for n, _ in fields])

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                held, size = [], 0
                for data in records(uri):
                    held.append(parsed(data))
                    size += len(data)
                    if len(held) >= common.BATCH_ROWS or size >= 16 << 20:
                        yield rows(held)
                        held, size = [], 0
                yield rows(held)

    return common.spread(spark, archives.select("uri")).mapInArrow(run, ", ".join(f"{n} {_TYPES[t]}" for n, t in fields))


def archived(pages: DataFrame) -> DataFrame:
    """The contract's result, from the archives as read back."""
    return read(pages.sparkSession, write(pages), payloads=False).drop("url")
