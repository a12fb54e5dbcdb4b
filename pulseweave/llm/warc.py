"""WARC archives as seekable Zstandard bundles with an index of record positions."""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseweave.llm.common import query, table
from pulseweave.session import materialize, shared_directory

#: Uncompressed bytes after which a frame, and compressed bytes after which a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 32 << 20
# Fixed values of the seekable format of Zstandard.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
INDEX = "page_id long, bundle string, frame int, frame_at long, frame_bytes long, offset long, length long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_ID, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record.  A revisit holds the HTTP header alone, which keeps the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    uri = " ".join((url or "").split())
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_uri(digest if page_id is None else page_id)}",
        f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[4:4] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_uri(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame at a bundle's end: compressed and plain size of each frame."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    body = entries + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(data) -> list[tuple[int, int]]:
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != _SEEKABLE or flags:
        raise ValueError("not a seekable bundle")
    return list(struct.iter_unpack("<II", data[-9 - 8 * n:-9]))


def parse(plain: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields, block) of each record of a frame."""
    at = 0
    while at < len(plain):
        split = plain.index(b"\r\n\r\n", at)
        lines = plain[at:split].decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = split + 4
        end = start + int(fields["Content-Length"])
        yield at, end + 4 - at, fields, plain[start:end]
        at = end + 4


class Writer:
    """Writes the records of one task into bundles; a bundle appears under its name when complete."""

    def __init__(self, directory: str, part: int, attempt: int, frame_bytes: int, bundle_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(directory)
        self.part, self.attempt = part, attempt
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.number, self.done = 0, []
        self._open()

    def _open(self):
        self.name = f"bundle-{self.part:06d}-{self.number:04d}.warc.zst"
        self.data, self.frames, self.waiting, self.size, self.rows = bytearray(), [], [], 0, []

    def add(self, page_id: int, data: bytes):
        self.waiting.append((page_id, self.size, len(data), data))
        self.size += len(data)
        if self.size >= self.frame_bytes:
            self._close_frame()
        if len(self.data) >= self.bundle_bytes:
            self.close()

    def _close_frame(self):
        frame = self.packer.compress(b"".join(w[3] for w in self.waiting))
        self.rows += [(p, self.name, len(self.frames), len(self.data), len(frame), at, n) for p, at, n, _ in self.waiting]
        self.frames.append((len(frame), self.size))
        self.data += frame
        self.waiting, self.size = [], 0

    def close(self):
        if self.waiting:
            self._close_frame()
        if self.frames:
            hidden = posixpath.join(self.root, f"_{self.name}.{self.attempt}")
            with self.fs.open_output_stream(hidden) as out:
                out.write(bytes(self.data) + seek_table(self.frames))
            self.fs.move(hidden, posixpath.join(self.root, self.name))
            self.done.extend(self.rows)
            self.number += 1
            self._open()


def _written(directory: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        w = Writer(directory, task.partitionId(), task.taskAttemptId(), frame_bytes, bundle_bytes)
        schema = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_at", pa.int64()),
                            ("frame_bytes", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])

        def index():
            columns = list(zip(*w.done)) or [()] * 7
            w.done = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                payload = row["payload"] or b""
                w.add(row["page_id"], record(row["page_id"], row["url"], payload, row["digest"], row["refers_to"]))
            yield index()
        w.close()
        yield index()

    return run


def write_archive(pages: DataFrame, directory: str, id_column: str = "page_id", url: str = "url", html: str = "html",
                  least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record per row into bundles in ``directory``; returns the index of positions.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the
    smallest id is a response and the others are revisits of it; shorter ones are all
    responses.  Equality is that of SHA-1 and length, found by one aggregation over
    digests; payloads move to no other task than the join with that small table asks for.
    A bundle is a row of independent Zstandard frames of about ``frame_bytes``
    and a seek table; the index gives each record's bundle, frame and place in the frame.

    Each task writes its own bundles through a file system that its URI names, under a
    hidden name that is moved into place once complete, so a repeated task replaces them
    by the same bundles.  The index is stored beside the bundles.  A NULL payload is
    empty, a NULL URL an empty target.  Rows that repeat an id are written each, and those
    that repeat the response's id and payload are responses too.  A row without id is a
    response named after its digest, and no other record refers to it.
    """
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    digests = materialize(rows.select("page_id", "sha1", "bytes"))
    first = digests.groupBy("sha1", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Per page, as a rule of one entry: the response each repeated payload refers to.
    key = lambda: F.concat("sha1", F.lit(":"), F.col("bytes").cast("string"))
    again = digests.where(F.col("bytes") >= least_bytes).join(first, ["sha1", "bytes"]).where("page_id > first") \
        .groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct(key(), "first"))).alias("responses"))
    marked = rows.join(again, "page_id", "left").withColumn("refers_to", F.try_element_at("responses", key()))
    dealt = marked.sortWithinPartitions("page_id", "sha1")
    encoded = dealt.select("page_id", "url", "payload", _base32(F.col("sha1")).alias("digest"), "refers_to")
    _folder(pages.sparkSession, directory)
    written = encoded.mapInArrow(_written(directory, frame_bytes, bundle_bytes), INDEX)
    path = posixpath.join(directory, "_index")
    written.write.mode("overwrite").parquet(path)
    return pages.sparkSession.read.schema(INDEX).parquet(path)


def _folder(spark: SparkSession, directory: str) -> None:
    """Make the folder; the URI's own scheme decides where."""
    fs, root = pafs.FileSystem.from_uri(directory)
    fs.create_dir(root, recursive=True)


def _base32(hexadecimal):
    """Base-32 text of a SHA-1 in hexadecimal: five digits make four letters."""
    number = lambda k: F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 10).cast("int")
    letter = lambda k, s: F.substring(
        F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(number(k), s).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[letter(k, s) for k in range(8) for s in (15, 10, 5, 0)])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for data in batch.column(0):
            data, at = memoryview(data.as_buffer()), 0
            for size, _ in read_seek_table(data):
                plain = unpack.decompress(data[at:at + size])
                at += size
                out = []
                for _, _, fields, block in parse(plain):
                    revisit = fields["WARC-Type"] == "revisit"
                    split = block.index(b"\r\n\r\n")
                    if revisit:
                        n = int(block[:split].rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        refers = int(fields["X-Refers-To-Page-ID"])
                    else:
                        n, digest, refers = len(block) - split - 4, base32_sha1(block[split + 4:]), None
                    out.append((int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, n, digest, fields["WARC-Type"], refers))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def read_archive(spark: SparkSession, directory: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the bundles.

    Responses are hashed again; a revisit's digest and length are those its record keeps.
    An archive without bundles gives an empty result.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(directory)
    return files.select("content").mapInArrow(_described, schema)


def fetch(index: DataFrame, directory: str) -> DataFrame:
    """(page_id, record) for index rows: seeks to each record's frame and unpacks only that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(directory)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            ids, records, held, plain = [], [], None, b""
            for r in batch.to_pylist():
                if held != (r["bundle"], r["frame_at"]):
                    with fs.open_input_file(posixpath.join(root, r["bundle"])) as f:
                        plain = unpack.decompress(f.read_at(r["frame_bytes"], r["frame_at"]))
                    held = r["bundle"], r["frame_at"]
                ids.append(r["page_id"])
                records.append(plain[r["offset"]:r["offset"] + r["length"]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(records, pa.binary())],
                                             names=["page_id", "record"])

    return index.sortWithinPartitions("bundle", "frame_at").mapInArrow(run, "page_id long, record binary")


_ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n,
  sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, n, min(page_id) AS first FROM p GROUP BY h, n)
SELECT page_id, n AS payload_bytes, """ + " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT) >> {s}) & 31) + 1, 1)"
    for k in range(8) for s in (15, 10, 5, 0)
) + """ AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h, n)
"""


@query("op10_warc", _ORACLE)
def op10_warc(spark: SparkSession, directory: str) -> DataFrame:
    pages = table(spark, directory, "pages", "page_id", "url", "html")
    archive = posixpath.join(shared_directory(spark), f"warc-{uuid.uuid4().hex}")
    if "://" not in archive and not archive.startswith("file:"):
        archive = f"file://{archive}"
    write_archive(pages, archive)
    return read_archive(spark, archive)
