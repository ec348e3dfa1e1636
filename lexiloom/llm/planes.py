"""Token ids in bit-plane files.

A file holds the ids of consecutive documents, cut into blocks of ``BLOCK_IDS`` ids (the last may be shorter). A
block is transposed into planes, one for each bit (or byte) of the ids that is ever set, and each plane is
compressed with zstandard on its own. After the blocks come the chunk index (where each block starts, how many ids
and planes it has, how long each plane is), the documents' ids and lengths, and a trailer that says where the
index is; so any block can be read alone.

    file     b"LXPL1\\n"  block*  index  documents  trailer
    block    plane*, lowest bits first
    index    zstd(for each block: offset u64, ids u32, planes u8, then the planes' sizes u32)
    documents  zstd(doc_id i64 * n, lengths u64 * n, nulls u8 * n)
    trailer  index offset u64, index size u64, documents size u64, blocks u64, n u64, bits of a plane u8, b"LXPL1\\n"

Numbers are little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.shared import documents, new_folder, staged
from lexiloom.llm.workers import release

MAGIC = b"LXPL1\n"
#: Byte planes at the lowest level: on the test corpus 1.30 bytes an id, against 1.50 for bit planes at level 3.
BLOCK_IDS, LEVEL, BITS = 65_536, 1, 8
_TRAILER = struct.Struct("<QQQQQB6s")


def filesystem(uri: str):
    """The file system of a shared folder, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = uri[5:]
        uri = "/" + uri.lstrip("/")
    elif uri.startswith("s3a:"):
        uri = "s3:" + uri[4:]
    return fs.FileSystem.from_uri(uri)


def to_planes(ids: np.ndarray, bits: int = 1) -> list[bytes]:
    """The planes of unsigned 32-bit ids, lowest bits first; those above the largest id are left out."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    width = int(ids.max(initial=0)).bit_length()
    if bits == 8:
        octets = ids.view(np.uint8).reshape(-1, 4)
        return [octets[:, k].tobytes() for k in range(-(-width // 8))]
    out = []
    for k in range(width):
        out.append(np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1, bitorder="little").tobytes())
    return out


def from_planes(planes: list[bytes], count: int, bits: int = 1) -> np.ndarray:
    if bits == 8:
        octets = np.zeros((count, 4), dtype=np.uint8)
        for k, p in enumerate(planes):
            octets[:, k] = np.frombuffer(p, dtype=np.uint8)
        return octets.reshape(-1).view("<u4")
    ids = np.zeros(count, dtype="<u4")
    for k, p in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=count, bitorder="little").astype("<u4") << np.uint32(k)
    return ids


class Writer:
    """Writes one file; ids arrive document by document and leave in blocks, so that memory holds about one block and
    the documents' lengths."""

    def __init__(self, stream, block_ids: int = BLOCK_IDS, bits: int = BITS, level: int = LEVEL) -> None:
        import zstandard

        self._stream, self._block, self._bits = stream, block_ids, bits
        self._zstd = zstandard.ZstdCompressor(level=level)
        self._held, self._at = bytearray(), 0
        self._index, self._docs, self._lengths = [], [], []
        self.ids = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self._stream.write(data)
        self._at += len(data)

    def _flush(self, size: int) -> None:
        ids = np.frombuffer(bytes(self._held[: size * 4]), dtype="<u4")
        del self._held[: size * 4]
        planes = [self._zstd.compress(p) for p in to_planes(ids, self._bits)]
        self._index.append((self._at, size, [len(p) for p in planes]))
        for p in planes:
            self._put(p)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document's ids, as little-endian unsigned 32-bit bytes."""
        self._docs.append(doc_id)
        self._lengths.append(len(ids) // 4)
        self.ids += len(ids) // 4
        self._held += ids
        while len(self._held) >= self._block * 4:
            self._flush(self._block)

    def close(self) -> int:
        """Ends the file; its size."""
        if self._held:
            self._flush(len(self._held) // 4)
        index = self._zstd.compress(b"".join(struct.pack(f"<QIB{len(s)}I", at, n, len(s), *s) for at, n, s in self._index))
        docs = np.array([d or 0 for d in self._docs], dtype="<i8").tobytes() + np.array(self._lengths, dtype="<u8").tobytes() + bytes(d is None for d in self._docs)
        docs = self._zstd.compress(docs)
        where = self._at
        self._put(index + docs)
        self._put(_TRAILER.pack(where, len(index), len(docs), len(self._index), len(self._docs), self._bits, MAGIC))
        return self._at


class Reader:
    """Reads a file: its documents in order, or any block."""

    def __init__(self, source) -> None:
        import zstandard

        self._source, self._zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        where, index, docs, blocks, n, self._bits, magic = _TRAILER.unpack(source.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a bit-plane file")
        table, at = self._zstd.decompress(source.read_at(index, where)), 0
        self.blocks: list[tuple[int, int, tuple[int, ...]]] = []
        for _ in range(blocks):
            offset, ids, planes = struct.unpack_from("<QIB", table, at)
            self.blocks.append((offset, ids, struct.unpack_from(f"<{planes}I", table, at + 13)))
            at += 13 + 4 * planes
        listed = self._zstd.decompress(source.read_at(docs, where + index))
        nulls = listed[16 * n :]
        self.doc_ids = [None if z else d for d, z in zip(np.frombuffer(listed, "<i8", n).tolist(), nulls, strict=True)]
        self.lengths = np.frombuffer(listed, "<u8", n, 8 * n).astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        offset, count, sizes = self.blocks[k]
        raw, planes, at = self._source.read_at(sum(sizes), offset), [], 0
        for s in sizes:
            planes.append(self._zstd.decompress(raw[at : at + s]))
            at += s
        return from_planes(planes, count, self._bits)

    def pieces(self) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(number of the document, some of its ids, whether they are its last), in order; a document of no ids has one
        empty piece."""
        k, held = 0, np.empty(0, dtype="<u4")
        for i, n in enumerate(self.lengths.tolist()):
            while True:
                if not len(held) and n:
                    held, k = self.block(k), k + 1
                part, held = held[:n], held[n:]
                n -= len(part)
                yield i, part, n == 0
                if n == 0:
                    break


_MANIFEST = "part int, path string, docs long, ids long, bytes long"


def write_ids(df: DataFrame, tokenizer: str, end_id: int | None, folder: str, bits: int = BITS) -> DataFrame:
    """Tokenizes df's texts (doc_id, text; null: empty) and writes their ids in ascending doc_id order, null first, one
    file for each range of doc_ids; gives the manifest (part, path, docs, ids, bytes), with the parts in order.

    Rows of equal doc_id, which may lie in several files, are ordered by a hash of the text. A task that runs again
    writes a file of another name, and the manifest, written once, names the files of the tasks that counted.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("*", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    order = ["doc_id", "_hash", "_row"]  # the row's own number deals equal rows to several files
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lexiloom.llm.token_ids import encoder

        part, writer, stream, path = TaskContext.get().partitionId(), None, None, ""
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer).encode(batch.column("text"), end_id), strict=True):
                if writer is None:
                    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.lxpl"
                    fs, inner = filesystem(path)
                    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    stream = fs.open_output_stream(inner)
                    writer = Writer(stream, bits=bits)
                writer.add(doc, ids)
        if writer is not None:
            size = writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "docs": [len(writer._docs)], "ids": [writer.ids], "bytes": [size]})
        release()

    return staged(ordered.mapInArrow(run, _MANIFEST), "manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """What the files hold: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, for each document.

    The manifest has a row for each file, as many as the tasks that wrote; the driver adds up where each starts.
    """
    spark, start, rows = manifest.sparkSession, 0, []
    for r in manifest.orderBy("part").collect():
        rows.append((r["path"], start))
        start += r["ids"]
    files = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for path, at in zip(frame["path"], frame["start"].tolist(), strict=True):
                fs, inner = filesystem(path)
                with fs.open_input_file(inner) as source:
                    reader = Reader(source)
                    crcs, crc = [], 0
                    for _, ids, last in reader.pieces():
                        crc = zlib.crc32(ids.tobytes(), crc)
                        if last:
                            crcs.append(crc)
                            crc = 0
                    starts = at + np.cumsum(reader.lengths) - reader.lengths
                    yield pd.DataFrame({"doc_id": pd.array(reader.doc_ids, dtype="Int64"), "start": starts, "n_tokens": reader.lengths, "ids_crc32": crcs})

    return files.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(manifest: DataFrame) -> DataFrame:
    """The documents' ids back: doc_id, ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for path in frame["path"]:
                fs, inner = filesystem(path)
                with fs.open_input_file(inner) as source:
                    reader, held = Reader(source), []
                    for i, ids, last in reader.pieces():
                        held.append(ids)
                        if last:
                            yield pd.DataFrame({"doc_id": pd.array([reader.doc_ids[i]], dtype="Int64"), "ids": [np.concatenate(held).astype(np.int64)]})
                            held = []

    return manifest.select("path").mapInPandas(run, "doc_id long, ids array<long>")


#: The id that ends a document of the query.
END_ID = 2


def op7_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids in bit-plane files, read back."""
    import public_tokenizers

    return read_documents(write_ids(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), END_ID, new_folder(spark, "planes")))
