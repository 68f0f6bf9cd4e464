"""Token ids in binary shards of fixed-width bit packing.

``write_ids`` range-partitions the documents by id, encodes them and writes one file per partition, so the files in order
hold the ids in ascending document order. Every id takes the least number of bits that the vocabulary needs; ids lie in
blocks of a fixed count, and a table of block offsets lets numpy unpack any block on its own. ``read_ids`` reads the files
back, block by block.

File layout (little-endian)::

    blocks        each ``block_ids`` ids of ``bits`` bits, lowest bit first, padded to a whole byte
    documents     int64 doc_id, uint8 null flag, uint64 first id, per document
    blocks table  uint64 byte offset per block
    footer        uint64 ids, documents, blocks; uint32 bits, block_ids; 8 bytes magic

A task writes to a name of its own and reports it in the manifest, so a lost or repeated attempt leaves a file that nobody
reads. The manifest has one row per file.

Defined results: a null text counts as empty and has the end id alone; a null ``doc_id`` comes first; rows that repeat a
``doc_id`` follow each other in an order of their texts; an empty table has no file and gives no row.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sceneframe.llm.text import whole_text
from sceneframe.llm.word_bpe import word_bpe
from sceneframe.session import scratch_path

END_ID = 2
BLOCK_IDS = 1 << 16
FOOTER = struct.Struct("<QQQII8s")
MAGIC = b"bitids01"
DOCUMENT = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("start", "<u8")])
MANIFEST = "file string, part int, n_ids long, n_docs long"


def bits_for(vocabulary: int) -> int:
    """Least number of bits for ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits`` bits each, lowest bit first."""
    spread = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8), bitorder="little").reshape(-1, 32)
    return np.packbits(spread[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of a packed block."""
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * bits).reshape(count, bits)
    return np.packbits(np.pad(flat, ((0, 0), (0, 32 - bits))).ravel(), bitorder="little").view("<u4")


class ShardWriter:
    """Streams documents into one file; memory holds one block of ids and the tables."""

    def __init__(self, sink, bits: int, block_ids: int = BLOCK_IDS):
        self.sink, self.bits, self.block_ids = sink, bits, block_ids
        self.pending, self.held, self.n_ids, self.size = [], 0, 0, 0
        self.documents, self.offsets = [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.documents.append((doc_id or 0, doc_id is None, self.n_ids))
        self.pending.append(ids)
        self.held += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.held >= self.block_ids:
            self._flush(self.held // self.block_ids * self.block_ids)

    def _flush(self, count: int) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        for at in range(0, count, self.block_ids):
            data = pack(ids[at:min(at + self.block_ids, count)], self.bits)
            self.offsets.append(self.size)
            self.size += len(data)
            self.sink.write(data)
        self.pending, self.held = [ids[count:].tobytes()], len(ids) - count

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        self.sink.write(np.array(self.documents, DOCUMENT).tobytes())
        self.sink.write(np.array(self.offsets, "<u8").tobytes())
        self.sink.write(FOOTER.pack(self.n_ids, len(self.documents), len(self.offsets), self.bits, self.block_ids, MAGIC))


class ShardReader:
    """Random access to one file: tables are read once, ids block by block."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size
        source.seek(size - FOOTER.size)
        self.n_ids, n_docs, n_blocks, self.bits, self.block_ids, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a packed id file")
        tables = n_docs * DOCUMENT.itemsize + n_blocks * 8
        source.seek(size - FOOTER.size - tables)
        data = source.read(tables)
        self.documents = np.frombuffer(data, DOCUMENT, n_docs)
        ends = np.frombuffer(data, "<u8", n_blocks, n_docs * DOCUMENT.itemsize)
        self.offsets = np.append(ends, np.uint64(size - FOOTER.size - tables))

    def block(self, k: int) -> np.ndarray:
        begin, end = int(self.offsets[k]), int(self.offsets[k + 1])
        self.source.seek(begin)
        return unpack(self.source.read(end - begin), self.bits, min(self.block_ids, self.n_ids - k * self.block_ids))

    def ids(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """Ids ``start`` to ``stop`` in parts of one block at most."""
        for k in range(start // self.block_ids, -(-stop // self.block_ids)):
            first = k * self.block_ids
            if k != getattr(self, "_at", None):
                self._at, self._now = k, self.block(k)
            yield self._now[max(start - first, 0):stop - first]

    def bounds(self) -> list[int]:
        return [*self.documents["start"].tolist(), self.n_ids]


def _filesystem(uri: str):
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_ids(docs: DataFrame, tokenizer: str, folder: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """Write the shards below ``folder`` and return their manifest in order, with ``start``, the ids before each file."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = word_bpe(tokenizer), None
        part = TaskContext.get().partitionId()
        for batch in batches:
            if out is None:
                fs, root = _filesystem(folder)
                fs.create_dir(root, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
                sink = fs.open_output_stream(f"{root}/{name}")
                out = ShardWriter(sink, bits_for(encoder.vocabulary))
            keys = iter(batch.column(0).to_pylist())
            for encoded in encoder.encode_all(batch.column(1), end_id):
                for ids in encoded.to_numpy(zero_copy_only=False):
                    out.add(next(keys), ids)
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({
                "file": pa.array([f"{folder}/{name}"]), "part": pa.array([part], pa.int32()),
                "n_ids": pa.array([out.n_ids], pa.int64()), "n_docs": pa.array([len(out.documents)], pa.int64())})

    ordered = (
        docs.select(F.col(key).cast("bigint").alias("key"), whole_text(text).cast("binary").alias("body"))
        .withColumn("tie", F.xxhash64("body"))
        .repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
        .select("key", "body")
    )
    files = sorted(ordered.mapInArrow(shard, MANIFEST).collect(), key=lambda r: r.part)  # one row per file
    rows, start = [], 0
    for r in files:
        rows.append((r.file, r.part, r.n_ids, r.n_docs, start))
        start += r.n_ids
    return docs.sparkSession.createDataFrame(rows, MANIFEST + ", start long")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                fs, path = _filesystem(file)
                with fs.open_input_file(path) as source:
                    shard = ShardReader(source, source.size())
                    bounds = shard.bounds()
                    for at in range(0, len(shard.documents), 4096):
                        part = shard.documents[at:at + 4096]
                        sums, counts = [], []
                        for start, stop in zip(bounds[at:at + 4096], bounds[at + 1:at + 4097]):
                            crc = 0
                            for ids in shard.ids(start, stop):
                                crc = zlib.crc32(ids.tobytes(), crc)
                            sums.append(crc)
                            counts.append(stop - start)
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(part["doc_id"], pa.int64(), mask=part["null"].astype(bool)),
                            "start": pa.array(part["start"].astype(np.int64) + before),
                            "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})

    # one file per task where there are tasks enough; files are of like size
    files = max(1, manifest.count())
    return manifest.repartition(files).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write to the shared folder and read back."""
    return read_ids(write_ids(docs, tokenizer, scratch_path(spark, "token-ids"), text, key))
