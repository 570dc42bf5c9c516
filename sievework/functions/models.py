"""Model hooks: what calls a remote model elsewhere is a function over columns or batches here, with deterministic defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.fusion import overlap
from .text import tokens

CAPITALISED = r"\p{Lu}[\p{L}\p{N}]*( \p{Lu}[\p{L}\p{N}]*)*"


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A unit vector of signed word-hash counts; zero for a text without words."""
    words = tokens(text)
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int")
    sign = lambda w: F.when(F.xxhash64(w, F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0)
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(words, lambda w: slot(w) == i), F.lit(0.0), lambda a, w: a + sign(w)))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(counts, lambda x: x / norm)).otherwise(counts)


def letter_counts(text: Column) -> Column:
    """How often each of a to z stands in a text: a cheap vector that any engine can count."""
    left = lambda x, c: F.length(F.replace(x["t"], F.lit(c), F.lit("")))
    counts = lambda x: F.array(*[(x["n"] - left(x, chr(c))).cast("double") for c in range(97, 123)])
    # an array of the lower text and its length alone, so that both are made once and not for each letter
    return F.transform(F.transform(F.array(F.lower(text)), lambda t: F.struct(t.alias("t"), F.length(t).alias("n"))), counts)[0]


def capitalised(text: Column) -> Column:
    """Entities (type, text) of a text: its runs of capitalised words, each once, in order."""
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(0)))
    return F.transform(runs, lambda t: F.struct(F.lit("term").alias("type"), t.alias("text")))


def next_to(text: Column, entities: Column) -> Column:
    """Relations (source, target, relation_type) of a text: each entity to the one after it."""
    pairs = F.transform(entities, lambda e, i: F.struct(e["text"].alias("source"), F.get(entities, i + 1)["text"].alias("target"), F.lit("next_to").alias("relation_type")))
    return F.filter(pairs, lambda p: p["target"].isNotNull())


@dataclass
class Hooks:
    """embed(text), score(query, text), split(question), entities(text) and relations(text, entities) are column functions; answer and recognize work on batches of rows."""

    embed: Callable[[Column], Column] = hashed_embedding
    score: Callable[[Column, Column], Column] = overlap
    answer: Callable[[str, str], str] = lambda query, context: context[:200]
    entities: Callable[[Column], Column] = capitalised
    relations: Callable[[Column, Column], Column] = next_to
    recognize: Callable[[bytes], str] = lambda image: ""
    split: Callable[[Column], Column] = field(default=lambda q: F.filter(F.split(q, r"[?？;；]\s*"), lambda x: F.trim(x) != ""))


def encode(rows: DataFrame, hooks: Hooks, text: str = "text") -> DataFrame:
    """rows with embedding; rows of blank text are left out."""
    return rows.where(F.trim(text) != "").withColumn("embedding", hooks.embed(F.col(text)))


def encode_once(rows: DataFrame, hooks: Hooks, text: str = "text") -> DataFrame:
    """encode(), with one call of the hook for all rows of equal text; for hooks that are dear and texts that repeat."""
    own = encode(rows.select(F.col(text).alias("__t")).distinct(), hooks, "__t")
    return rows.join(own, F.col(text) == F.col("__t")).drop("__t")


def extracted_entities(chunks: DataFrame, hooks: Hooks) -> DataFrame:
    """doc_id, chunk_id, chunk_index, pos, type, text: entities of whole chunks (doc_id, ord, chunk_id, text), blank ones left out."""
    found = chunks.select("doc_id", "chunk_id", F.col("ord").alias("chunk_index"), F.posexplode(hooks.entities(F.col("text"))).alias("i", "e"))
    return found.select("doc_id", "chunk_id", "chunk_index", F.struct("chunk_index", "i").alias("pos"), "e.type", "e.text").where(F.trim("text") != "")


def extracted_relations(chunks: DataFrame, hooks: Hooks) -> DataFrame:
    """doc_id, pos, source, target, relation_type: relations of whole chunks (doc_id, ord, text) between their entities."""
    found = chunks.withColumn("__e", hooks.entities(F.col("text"))).select("doc_id", "ord", F.posexplode(hooks.relations(F.col("text"), F.col("__e"))).alias("i", "r"))
    return found.select("doc_id", F.struct("ord", "i").alias("pos"), "r.source", "r.target", "r.relation_type")


def recognized(images: DataFrame, hooks: Hooks) -> DataFrame:
    """path, text of images (path, content) by the recognize hook; an image without content has an empty text."""

    def call(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pdf.assign(text=[hooks.recognize(bytes(c)) if c is not None else "" for c in pdf["content"]])[["path", "text"]]

    return images.select("path", "content").mapInPandas(call, "path string, text string")


def sub_questions(questions: DataFrame, hooks: Hooks) -> DataFrame:
    """query_id, part, text: the parts of each question, itself if it has none."""
    parts = hooks.split(F.col("text"))
    return questions.select("query_id", F.posexplode(F.when(F.size(parts) > 0, parts).otherwise(F.array("text"))).alias("part", "text"))


def predict_knowledge_base(scores: DataFrame, least: float = 0.6) -> DataFrame:
    """query_id, kb_id: the best knowledge base of (query_id, kb_id, confidence), null below least; an only one is taken as it is."""
    best = scores.groupBy("query_id").agg(F.max_by("kb_id", "confidence").alias("kb_id"), F.max("confidence").alias("c"), F.count("*").alias("n"))
    return best.select("query_id", F.when((F.col("n") == 1) | (F.col("c") >= least), F.col("kb_id")).alias("kb_id"))


def answers(contexts: DataFrame, hooks: Hooks) -> DataFrame:
    """query_id, answer for (query_id, query, context), by the answer hook on batches."""

    def call(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pdf.assign(answer=[hooks.answer(q, c) for q, c in zip(pdf["query"], pdf["context"], strict=True)])[["query_id", "answer"]]

    return contexts.select("query_id", "query", "context").mapInPandas(call, "query_id long, answer string")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of two vectors; 0 for a zero one."""
    n = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / n if n else 0.0
