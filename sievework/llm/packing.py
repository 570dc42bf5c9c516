"""Packing by power-of-two decomposition.

A document of n tokens is cut into floor(n / 2048) pieces of 2048 and one piece for each further binary digit of n, longest
first. Pieces of equal length form a bucket, each piece is a sequence of its own, so no sequence crosses documents and none
needs padding. Sequence ids number the buckets from long to short, each bucket in the order of scan partition and position.

Tokenising runs where the text is read and its pieces are written once; only counts per (partition, length) are shuffled to
number them. Null text is the end id alone; null doc_ids and repeated rows are packed like others; empty tables give none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import tokens
from .common import bounded_broadcast, materialize, table

MAX_LENGTH = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
PIECES = "doc_id long, start long, length long, doc_tokens long, part int, nth long, ids binary"
#: Bytes of ids in one batch to the JVM.
BATCH_BYTES = 4 << 20


def cut(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of n tokens, longest first."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, longest: int = MAX_LENGTH) -> DataFrame:
    """Pieces with ids (binary, little-endian unsigned 32-bit) and their number among those of their partition and length."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the longest piece must be a power of two")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        nth: dict[int, int] = {}
        cols: list[list] = [[] for _ in range(7)]
        names = [x.split(" ")[0] for x in PIECES.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.binary()]
        held = 0
        for batch in batches:
            for doc_id, encoded in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1).to_pylist()), strict=True):
                ids = encoded + end
                n, start = len(ids) // 4, 0
                for length in cut(n, longest):
                    i = nth.get(length, 0)
                    nth[length] = i + 1
                    for c, v in zip(cols, (doc_id, start, length, n, part, i, ids[4 * start : 4 * (start + length)]), strict=True):
                        c.append(v)
                    start += length
                held += len(ids)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)
                    cols, held = [[] for _ in range(7)], 0
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(split, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, longest: int = MAX_LENGTH) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids: one row per piece."""
    cut_up = materialize(pieces(docs, tokenizer, end_id, longest), "packing-pieces")
    counts = materialize(cut_up.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    lengths = counts.groupBy("length").agg(F.sum("n").alias("n"))  # a row for each power of two
    longer = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    lengths = lengths.select("length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("base"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("own", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(lengths), "length").select("part", "length", (F.col("base") + F.col("own")).alias("first"))
    df = cut_up.join(bounded_broadcast(materialize(firsts, "packing-firsts")), ["part", "length"])
    return df.select("doc_id", "start", "length", "doc_tokens", (F.col("first") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")


def digest(packed: DataFrame) -> DataFrame:
    """packed with ids_crc32 in the place of ids."""
    out = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long"

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array([zlib.crc32(x.as_buffer()) for x in b.column(6)], pa.int64())], [x.split(" ")[0] for x in out.split(", ")])

    return packed.mapInArrow(crc, out)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), tokens.public(TOKENIZER)))
