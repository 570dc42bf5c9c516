"""Token ids in fixed-width bit-packed files.

Each id takes the least number of bits that holds the vocabulary. A shard file is

    magic "SWBP", version u8, bits u8, block_ids u32
    blocks: block_ids ids each (the last may have fewer), packed low bit first, each block padded to a byte
    block offsets: u64 each, from the file's start
    documents: doc_id i64, null flag u8, first id u64 (in the shard) each
    footer: n_ids u64, n_blocks u64, n_docs u64, offset of the block offsets u64, magic "SWBP"

all little-endian. A reader takes the footer, then any block by its offset, and unpacks it with numpy.

Documents are range-partitioned by (doc_id, hash of text), tokenised and written one partition a task; a partition rolls
over to a new shard at ``SHARD_BYTES``. Shards are written under a name of their attempt and then renamed, so a task that
runs again replaces its shards. A manifest table lists the shards; running sums over it give each shard's first id.

Null text encodes as the end id alone. A null doc_id sorts first. Equal doc_ids sort by hash of text, then text. Empty
tables give no shards.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import tokens
from .common import materialize, scratch, table

MAGIC = b"SWBP"
HEAD = struct.Struct("<4sBBI")
FOOT = struct.Struct("<QQQQ4s")
DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("start", "<u8")])
BLOCK_IDS = 4096
SHARD_BYTES = 16 << 20
END_ID = 1
MANIFEST = "shard string, partition int, seq int, n_docs long, n_ids long, n_bytes long"


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids as bit fields, low bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    fields = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(fields.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed data as little-endian unsigned 32-bit integers."""
    if bits == 16:
        return np.frombuffer(data, dtype="<u2", count=n).astype("<u4")
    fields = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (fields.astype("<u4") << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype="<u4")


class ShardWriter:
    """Writes one shard to a binary file object."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.at = out.write(HEAD.pack(MAGIC, 1, bits, block_ids)) or HEAD.size
        self.offsets: list[int] = []
        self.docs: list[tuple[int, int, int]] = []
        self.pending, self.n_pending, self.n_ids = [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, self.n_ids))
        self.n_ids += len(ids)
        self.pending.append(ids)
        self.n_pending += len(ids)
        if self.n_pending >= 16 * self.block_ids:
            self._flush(self.n_pending // self.block_ids)

    def _flush(self, blocks: int, rest: bool = False) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, "<u4")
        for start in range(0, len(ids) if rest else blocks * self.block_ids, self.block_ids):
            data = pack(ids[start : start + self.block_ids], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        left = ids[len(ids) if rest else blocks * self.block_ids :]
        self.pending, self.n_pending = [left], len(left)

    def close(self) -> int:
        """Writes the tables and the footer; the file's size."""
        self._flush(0, rest=True)
        tail = np.array(self.offsets, "<u8").tobytes() + np.array(self.docs, DOC).tobytes()
        tail += FOOT.pack(self.n_ids, len(self.offsets), len(self.docs), self.at, MAGIC)
        self.out.write(tail)
        return self.at + len(tail)


class Shard:
    """Reads a shard from a seekable binary file object: documents by number, ids by position."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, io.SEEK_END)
        magic, version, self.bits, self.block_ids = HEAD.unpack(self._read(0, HEAD.size))
        self.n_ids, blocks, docs, at, end = FOOT.unpack(self._read(size - FOOT.size, FOOT.size))
        if magic != MAGIC or end != MAGIC or version != 1:
            raise ValueError("not a bit-packed shard")
        self.offsets = np.frombuffer(self._read(at, 8 * blocks), "<u8")
        self.ends = np.append(self.offsets[1:], at).astype("<u8")
        self.docs = np.frombuffer(self._read(at + 8 * blocks, DOC.itemsize * docs), DOC)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard, from the blocks that hold them alone."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        base = int(self.offsets[first])
        data = self._read(base, int(self.ends[last]) - base)
        parts = [unpack(data[int(self.offsets[b]) - base : int(self.ends[b]) - base], min(self.block_ids, self.n_ids - b * self.block_ids), self.bits) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block_ids : stop - first * self.block_ids]

    def bounds(self, k: int) -> tuple[int, int]:
        return int(self.docs["start"][k]), int(self.docs["start"][k + 1]) if k + 1 < len(self.docs) else self.n_ids

    def document(self, k: int) -> np.ndarray:
        return self.ids(*self.bounds(k))


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Tokenises docs (doc_id, text) into shards under folder, in ascending doc_id order; the manifest, with first_id (ids before the shard)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        bits = bits_for(max(enc.vocabulary, end_id + 1))
        fs, root = _filesystem(folder)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        end = np.array([end_id], "<u4").tobytes()
        done: list[tuple] = []
        writer = sink = None

        def finish() -> None:
            nonlocal writer
            size = writer.close()
            sink.close()
            name = f"shard-{part:06d}-{len(done):05d}.swbp"
            fs.move(f"{root}/_attempt-{attempt}.tmp", f"{root}/{name}")
            done.append((name, part, len(done), len(writer.docs), writer.n_ids, size))
            writer = None

        for batch in batches:
            for doc_id, encoded in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1).to_pylist()), strict=True):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/_attempt-{attempt}.tmp")
                    writer = ShardWriter(sink, bits)
                writer.add(doc_id, np.frombuffer(encoded + end, "<u4"))
                if writer.at >= shard_bytes:
                    finish()
        if writer is not None:
            finish()
        names = [f.split(" ")[0] for f in MANIFEST.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], kind) for i, kind in enumerate(kinds)], names)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    dealt = slim.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
    found = materialize(dealt.select("doc_id", "text").mapInArrow(write, MANIFEST), "bitpack-manifest")
    # two running sums, over partitions and within them, so no task sees all shards
    parts = found.groupBy("partition").agg(F.sum("n_ids").alias("n")).select("partition", F.coalesce(F.sum("n").over(Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("partition").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return found.join(parts, "partition").select("shard", "partition", "seq", "n_docs", "n_ids", "n_bytes", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("first_id"))


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary, little-endian unsigned 32-bit), read from the shards."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        names = ["doc_id", "start", "ids"]
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as file:
                    shard = Shard(file)
                    edges = np.append(shard.docs["start"], shard.n_ids).astype(np.int64)
                    k = 0
                    while k < len(shard.docs):  # about a million ids at a time, whole documents
                        stop = max(k + 1, int(np.searchsorted(edges, edges[k] + (1 << 20), side="right")) - 1)
                        data = shard.ids(int(edges[k]), int(edges[stop])).tobytes()
                        cut = 4 * (edges[k : stop + 1] - edges[k])
                        rows = pa.Array.from_buffers(pa.large_binary(), stop - k, [None, pa.py_buffer(cut.astype("<i8").tobytes()), pa.py_buffer(data)]).cast(pa.binary())
                        ids = pa.array(shard.docs["doc_id"][k:stop].copy(), mask=shard.docs["null"][k:stop].astype(bool))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(edges[k:stop] + first), rows], names)
                        k = stop

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("shard", "first_id").repartition(n, "shard").mapInArrow(read, "doc_id long, start long, ids binary")


def crc32(column: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(x.as_buffer()) for x in column], pa.int64())


def op4_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids and reads the files back: doc_id, start, n_tokens, ids_crc32."""
    folder = scratch(spark, "bitpack")
    manifest = materialize(write_shards(table(spark, sf_dir, "documents"), folder, tokens.public("word_bpe_49k.json")), "bitpack-shards")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([len(x.as_buffer()) // 4 for x in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, crc32(b.column(2))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_documents(manifest, folder).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
