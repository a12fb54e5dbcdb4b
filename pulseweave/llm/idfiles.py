"""Token ids in files of byte or bit planes, with an index that finds any range of ids."""

from __future__ import annotations

import json
import os
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulseweave.llm.common import query, table
from pulseweave.llm.tokens import mix, powers, runs
from pulseweave.session import shared_directory

#: Ids of a block, and ids after which a file is closed.
BLOCK_IDS, FILE_IDS = 1 << 16, 1 << 24
#: What follows every document.
END_ID = 0
#: Different pieces of text, and their code points, of which a worker keeps the ids before it starts anew.
KEPT_PIECES, KEPT_CODES = 1 << 20, 1 << 24

_MAGIC = b"IDPLANE1"
_FOOTER = struct.Struct("<QQQQIB8s")
#: Planes of a block of 32-bit ids by kind.
PLANES = {"byte": 4, "bit": 32}

INDEX = "file string, place long, doc_id long, first long, n_tokens long"


# Blocks


def transpose(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block: the k-th byte, or the k-th bit, of every id."""
    cells = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        cells = np.unpackbits(cells, axis=1, bitorder="little")
        return [np.packbits(p, bitorder="little").tobytes() for p in np.ascontiguousarray(cells.T)]
    return [p.tobytes() for p in np.ascontiguousarray(cells.T)]


def restore(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The ``n`` ids of a block; an empty plane stands for zeros."""
    cells = np.zeros((len(planes), n), np.uint8)
    for k, plane in enumerate(planes):
        if plane:
            raw = np.frombuffer(plane, np.uint8)
            cells[k] = np.unpackbits(raw, bitorder="little")[:n] if kind == "bit" else raw
    if kind == "bit":
        return np.packbits(np.ascontiguousarray(cells.T), axis=1, bitorder="little").view("<u4").ravel()
    return np.ascontiguousarray(cells.T).view("<u4").ravel()


# Files


class Writer:
    """Writes the documents of one task, in the order given, into files of whole documents.

    A file is its blocks (each plane a Zstandard frame, planes of zeros left out), the
    documents (null flags, ids and numbers of tokens), the index of the blocks (place and
    length of every plane) and a footer.  It appears under its name when it is complete.
    """

    def __init__(self, directory: str, part: int, attempt: int, kind: str, block_ids: int, file_ids: int):
        self.fs, self.root = pafs.FileSystem.from_uri(directory)
        self.part, self.attempt, self.kind = part, attempt, kind
        self.block_bytes, self.file_ids = 4 * block_ids, file_ids
        self.packer = zstandard.ZstdCompressor(level=3)
        self.number, self.out = 0, None

    def _open(self):
        self.name = f"ids-{self.part:07d}-{self.number:06d}.planes"
        self.hidden = posixpath.join(self.root, f"_{self.name}.{self.attempt}")
        self.out = self.fs.open_output_stream(self.hidden)
        self.out.write(_MAGIC)
        self.at, self.n_ids, self.waiting, self.blocks, self.docs = len(_MAGIC), 0, bytearray(), [], []

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def add(self, doc_id: int | None, ids: bytes):
        """``ids``: little-endian unsigned 32-bit integers."""
        if self.out is None:
            self._open()
        self.docs.append((doc_id, len(ids) // 4))
        self.n_ids += len(ids) // 4
        self.waiting += ids
        while len(self.waiting) >= self.block_bytes:
            self._block(self.waiting[:self.block_bytes])
            del self.waiting[:self.block_bytes]
        if self.n_ids >= self.file_ids:
            self.close()

    def _block(self, raw: bytearray):
        at = self.at
        planes = transpose(np.frombuffer(bytes(raw), "<u4"), self.kind)
        self.blocks.append((at, [self._put(self.packer.compress(p)) if any(p) else 0 for p in planes]))

    def close(self):
        if self.out is None:
            return
        if self.waiting:
            self._block(self.waiting)
        docs_at = self.at
        ids = [d for d, _ in self.docs]
        self._put(self.packer.compress(b"".join((
            np.array([d is None for d in ids], np.uint8).tobytes(), np.array([d or 0 for d in ids], "<i8").tobytes(),
            np.array([n for _, n in self.docs], "<i8").tobytes(),
        ))))
        index_at = self.at
        for at, lengths in self.blocks:
            self._put(struct.pack(f"<Q{len(lengths)}I", at, *lengths))
        self._put(_FOOTER.pack(docs_at, index_at, len(self.docs), self.n_ids, self.block_bytes // 4,
                               PLANES[self.kind], _MAGIC))
        self.out.close()
        self.fs.move(self.hidden, posixpath.join(self.root, self.name))
        self.out, self.number = None, self.number + 1


class Reader:
    """Reads one file; nothing but the footer, the index and the wanted blocks."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        end = self.file.size() - _FOOTER.size
        self.docs_at, self.index_at, self.n_docs, self.n_ids, self.block_ids, planes, magic = _FOOTER.unpack(
            self.file.read_at(_FOOTER.size, end))
        if magic != _MAGIC:
            raise ValueError(f"{path} is not a file of id planes")
        self.kind = {n: k for k, n in PLANES.items()}[planes]
        entry = struct.Struct(f"<Q{planes}I")
        self.blocks = [(e[0], e[1:]) for e in entry.iter_unpack(self.file.read_at(end - self.index_at, self.index_at))]
        self.unpacker = zstandard.ZstdDecompressor()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def documents(self) -> Iterator[tuple[int | None, int]]:
        """(doc_id, number of tokens) in order."""
        n = self.n_docs
        raw = self.unpacker.decompress(self.file.read_at(self.index_at - self.docs_at, self.docs_at), 17 * n)
        null = np.frombuffer(raw, np.uint8, n)
        ids, counts = np.frombuffer(raw, "<i8", n, n), np.frombuffer(raw, "<i8", n, 9 * n)
        for missing, d, count in zip(null.tolist(), ids.tolist(), counts.tolist()):
            yield (None if missing else d), count

    def block(self, k: int) -> np.ndarray:
        at, lengths = self.blocks[k]
        n = min(self.block_ids, self.n_ids - k * self.block_ids)
        raw = self.file.read_at(sum(lengths), at)
        size, planes, at = (n if self.kind == "byte" else -(-n // 8)), [], 0
        for length in lengths:
            planes.append(self.unpacker.decompress(raw[at:at + length], size) if length else b"")
            at += length
        return restore(planes, n, self.kind)

    def ids(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from place ``first`` on; unpacks only the blocks that hold them."""
        if n <= 0:
            return np.zeros(0, "<u4")
        low, high = first // self.block_ids, (first + n - 1) // self.block_ids
        found = np.concatenate([self.block(k) for k in range(low, high + 1)])
        return found[first - low * self.block_ids:][:n]


# Encoding


#: Kinds of code points; apostrophes, which may begin a contraction, are of no kind.
_LETTER, _POINT, _BLANK = 1, 2, 3


@lru_cache
def _kinds() -> np.ndarray:
    """Letters and digits, punctuation and blanks on which all tokenizers of the byte-level family agree."""
    kinds = np.zeros(0x110000, np.uint8)
    kinds[0x21:0x7F] = _POINT
    kinds[ord("'")] = 0
    kinds[[0x20, 0x0A]] = _BLANK
    for low, high in (("0", "9"), ("A", "Z"), ("a", "z"), ("À", "Ö"), ("Ø", "ö"), ("ø", "ɏ")):
        kinds[ord(low):ord(high) + 1] = _LETTER
    return kinds


def cuts(codes: np.ndarray) -> np.ndarray:
    """Places before which a text may be cut: a token ends there, whatever stands on the other side."""
    kind = _kinds()[codes]
    before, here = kind[:-1], kind[1:]
    solid = (before == _LETTER) | (before == _POINT)
    inner = (here + before == _LETTER + _POINT) & solid & (here != _BLANK) & (here != 0)
    return np.flatnonzero(inner | solid & (here == _BLANK)) + 1


@lru_cache(maxsize=2)
def _encoder(path: str) -> "_Encoder":
    return _Encoder(path)


class _Encoder:
    """Ids of many texts at once; the ids of pieces met before are looked up.

    The pattern of a byte-level tokenizer takes tokens from left to right and looks ahead
    only past white space.  So a text without added tokens may be cut before a blank that
    follows a visible character, and between a word and punctuation, and each different
    piece be encoded by itself.  Pieces are found by 64-bit hashes and then compared; a
    text with a piece that differs from what its hash stands for is encoded as a whole,
    as all texts are for tokenizers of another kind.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        self.separable = (
            spec.get("normalizer") is None and spec.get("post_processor") is None and spec.get("truncation") is None
            and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        )
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self._forget()

    def _forget(self):
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, entry of each
        self.code_at, self.id_at = np.zeros(1, np.int64), np.zeros(1, np.int64)  # borders of the entries
        self.codes, self.ids = np.zeros(0, np.uint32), np.zeros(0, "<u4")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [k for k, t in enumerate(texts) if self.separable and not any(x in t for x in self.added)]
        out = [b""] * len(texts)
        for first, run in runs([texts[k] for k in cut]):
            for k, ids in zip(cut[first:], self._run(run)):
                out[k] = ids
        for k in set(range(len(texts))).difference(cut):
            out[k] = self._whole(texts[k])
        return out

    def _run(self, texts: list[str]) -> list[bytes]:
        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)  # a text's end and its separator
        borders = np.zeros(len(codes) + 1, bool)
        borders[cuts(codes)] = True
        borders[ends] = borders[ends - 1] = borders[0] = True
        at = np.flatnonzero(borders)
        starts, stops = at[:-1], at[1:]
        real = np.ones(len(codes), bool)
        real[ends - 1] = False
        starts, stops = starts[real[starts]], stops[real[starts]]
        up, down = powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        hashes, one, which = np.unique(mix((sums[stops] - sums[starts]) * down[starts]), return_index=True, return_inverse=True)
        entry = self._entries(hashes, starts[one], stops[one], joined, codes)[which]

        length = stops - starts
        same = np.ones(len(entry), bool)
        stored = self.code_at[entry + 1] - self.code_at[entry] == length
        spread = np.repeat(self.code_at[entry] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        spread = np.minimum(spread, len(self.codes) - 1)
        agree = self.codes[spread] == codes[real]
        if not (stored.all() and agree.all()):
            whole = np.repeat(np.arange(len(entry)), length)
            same[whole[~agree]] = False
            same &= stored

        size = self.id_at[entry + 1] - self.id_at[entry]
        begin = np.cumsum(size) - size
        flat = self.ids[np.repeat(self.id_at[entry] - begin, size) + np.arange(size.sum())].tobytes()
        of_text = np.searchsorted(starts, np.concatenate([[0], ends]))
        marks = np.append(begin, size.sum())[of_text].tolist()
        out = [flat[4 * a:4 * b] for a, b in zip(marks, marks[1:])]
        for k in np.unique(np.searchsorted(of_text, np.flatnonzero(~same), side="right") - 1).tolist():
            out[k] = self._whole(texts[k])
        return out

    def _entries(self, hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray, joined: str, codes: np.ndarray) -> np.ndarray:
        """The entry of each of the sorted hashes; those not kept yet are encoded and kept."""
        if len(self.keys) + len(hashes) > KEPT_PIECES or len(self.codes) > KEPT_CODES:
            self._forget()
        at = np.searchsorted(self.keys, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != hashes[inside]
        if new.any():
            first, length = starts[new], stops[new] - starts[new]
            missing = [joined[a:b] for a, b in zip(first.tolist(), stops[new].tolist())]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)]
            n, code_ends = len(self.code_at) - 1, np.cumsum(length)
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), "<u4")])
            spread = np.repeat(first - code_ends + length, length) + np.arange(code_ends[-1])
            self.codes = np.concatenate([self.codes, codes[spread]])
            self.id_at = np.concatenate([self.id_at, self.id_at[-1] + np.cumsum(np.fromiter(map(len, found), np.int64))])
            self.code_at = np.concatenate([self.code_at, self.code_at[-1] + code_ends])
            keys = np.concatenate([self.keys, hashes[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.place = keys[order], np.concatenate([self.place, n + np.arange(len(found))])[order]
            at = np.searchsorted(self.keys, hashes)
        return self.place[at]


# Jobs


def write_ids(docs: DataFrame, directory: str, tokenizer: str, id_column: str = "doc_id", text: str = "text",
              end_id: int = END_ID, planes: str = "byte", block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> None:
    """Encode every whole text and write the ids, in ascending order of documents, into ``directory``.

    Documents are dealt out by ranges of (id, place in the input), so that one id with many
    rows is cut as well, and each range is encoded and written by one task: names of files
    ascend with the ids.  Blocks of ``block_ids`` ids are transposed into byte or bit planes.
    A repeated task writes the same files again, under hidden names that are moved into
    place.  A task holds a batch of texts, one document's ids, one block and the numbers
    of the documents of its file.

    A NULL text is empty; an empty text is its end id alone.  Rows without id come first.
    Rows that repeat an id are written each, in the order of the input.  An empty table
    writes no file.  Other columns are ignored.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_column).cast("long").alias("__id"), F.col(text).cast("string").alias("__text"),
                       F.monotonically_increasing_id().alias("__row"))
    ordered = rows.repartitionByRange(n, F.col("__id").asc_nulls_first(), "__row") \
        .sortWithinPartitions(F.col("__id").asc_nulls_first(), "__row").drop("__row")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder = TaskContext.get(), _encoder(tokenizer)
        out = Writer(directory, task.partitionId(), task.taskAttemptId(), planes, block_ids, file_ids)
        written = 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts)):
                out.add(doc_id, ids + end)
            written += batch.num_rows
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["n"])

    fs, root = pafs.FileSystem.from_uri(directory)
    fs.create_dir(root, recursive=True)
    ordered.mapInArrow(run, "n long").agg(F.sum("n")).first()


def _files(spark: SparkSession, directory: str) -> DataFrame:
    """(file): names of the files of ``directory``; their content is not read here."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.planes").load(directory)
    return found.select(F.substring_index("path", "/", -1).alias("file"))


def _scan(directory: str, describe, names: list[str], types: list[pa.DataType]):
    """Rows of each file: ``describe(file name, reader)`` yields lists of tuples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(directory)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with Reader(fs, posixpath.join(root, name)) as reader:
                    for rows in describe(name, reader):
                        columns = list(zip(*rows)) or [()] * len(names)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def _totals(name: str, reader: Reader) -> Iterator[list[tuple]]:
    yield [(name, reader.n_ids)]


def _with_start(rows: DataFrame, spark: SparkSession, directory: str) -> DataFrame:
    """Add ``start``, the ids of all files and documents before; the window has a row per file."""
    sizes = _files(spark, directory).mapInArrow(
        _scan(directory, _totals, ["file", "n_ids"], [pa.string(), pa.int64()]), "file string, n_ids long")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("file"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return rows.join(offsets, "file").withColumn("start", F.col("base") + F.col("first")).drop("base")


def index(spark: SparkSession, directory: str) -> DataFrame:
    """(file, place, doc_id, first, n_tokens, start) of every document: ``place`` in its file, its
    first id there and in the whole; read from the documents' tables alone, for :func:`fetch`."""

    def describe(name, reader):
        rows, first = [], 0
        for place, (doc_id, n) in enumerate(reader.documents()):
            rows.append((name, place, doc_id, first, n))
            first += n
            if len(rows) == 1 << 14:
                yield rows
                rows = []
        yield rows

    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["file", "place", "doc_id", "first", "n_tokens"]
    return _with_start(_files(spark, directory).mapInArrow(_scan(directory, describe, names, types), INDEX), spark, directory)


def checksums(spark: SparkSession, directory: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from all ids in the files.

    Blocks are unpacked one after the other; a document that spans blocks is summed
    across them, so a task holds one block whatever the documents' length.
    """

    def describe(name, reader):
        rows, first, k, block, base = [], 0, -1, memoryview(b""), 0
        for doc_id, n in reader.documents():
            crc, at = 0, first
            while at < first + n:
                if k < 0 or at >= base + len(block) // 4:
                    k, base = k + 1, (k + 1) * reader.block_ids
                    block = memoryview(reader.block(k)).cast("B")
                upto = min(first + n, base + len(block) // 4)
                crc = zlib.crc32(block[4 * (at - base):4 * (upto - base)], crc)
                at = upto
            rows.append((name, doc_id, first, n, crc))
            first += n
            if len(rows) == 1 << 14:
                yield rows
                rows = []
        yield rows

    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["file", "doc_id", "first", "n_tokens", "ids_crc32"]
    rows = _files(spark, directory).mapInArrow(
        _scan(directory, describe, names, types),
        "file string, doc_id long, first long, n_tokens long, ids_crc32 long")
    return _with_start(rows, spark, directory).select("doc_id", "start", "n_tokens", "ids_crc32")


def fetch(wanted: DataFrame, directory: str) -> DataFrame:
    """(doc_id, ids) for rows of :func:`index`: seeks to the blocks that hold each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(directory)
        held, reader = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != held:
                    if reader is not None:
                        reader.file.close()
                    held, reader = row["file"], Reader(fs, posixpath.join(root, row["file"]))
                ids = reader.ids(row["first"], row["n_tokens"])
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]], pa.int64()),
                                                  pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], names=["doc_id", "ids"])
        if reader is not None:
            reader.file.close()

    rows = wanted.select("file", "doc_id", "first", "n_tokens").sortWithinPartitions("file", "first")
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


@query("op12_idfiles")
def op12_idfiles(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents", "doc_id", "text")
    files = posixpath.join(shared_directory(spark), f"ids-{uuid.uuid4().hex}")
    if "://" not in files and not files.startswith("file:"):
        files = f"file://{files}"
    write_ids(docs, files, public_tokenizers.path("byte_bpe_50k.json"))
    return checksums(spark, files)
