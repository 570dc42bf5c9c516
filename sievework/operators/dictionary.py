"""Dictionary matching: which of many strings lie in each text, by one pass of a trie automaton over every text.

The strings are dealt by hash into blocks of bounded size; a block's automaton is built once a task from the strings that were
sent to it, and every text is read once a block. Texts are not shuffled and not cut into runs of characters. Beyond a number of
blocks the strings meet the texts by the first three characters instead, as ``graph.contained`` does.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.text import grams

#: Strings of a block, and the most blocks.
SENT_STRINGS = 100_000
MOST_BLOCKS = 16


def _block(texts: DataFrame, text: str, keys: list[str], strings: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ahocorasick.Automaton()
        for s in strings:
            known.add_word(s, s)
        known.make_automaton()
        for b in batches:
            hits = pa.array([sorted({s for _, s in known.iter(t)}) if t else [] for t in b.column(len(keys)).to_pylist()], pa.list_(pa.string()))
            rows = pc.list_parent_indices(hits)
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(rows) for i in range(len(keys))], hits.flatten()], [*keys, "part"])

    kinds = dict(texts.dtypes)
    return texts.select(*keys, F.col(text).alias("__text")).mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "part string"]))


def find(parts: DataFrame, texts: DataFrame, text: str, keys: list[str], sent: int = SENT_STRINGS, most: int = MOST_BLOCKS) -> DataFrame:
    """keys of texts and part: a row for each of the strings (part) that a text holds, once a row of texts. Null and empty strings are in none."""
    held = parts.select("part").where("part <> ''").distinct()
    n = held.count()
    blocks = max(1, -(-n // sent))
    if blocks > most:
        runs = texts.select(*keys, F.col(text).alias("__text"), F.explode(grams(F.col(text))).alias("__g"))
        return runs.join(held.withColumn("__g", F.substring("part", 1, 3)), "__g").where(F.col("__text").contains(F.col("part"))).select(*keys, "part")
    out = None
    for number in range(blocks):
        strings = [r.part for r in held.where(F.pmod(F.xxhash64("part"), F.lit(blocks)) == number).collect()]  # about ``sent`` strings
        if strings:
            found = _block(texts, text, keys, strings)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else texts.select(*keys, F.lit("").alias("part")).limit(0)
