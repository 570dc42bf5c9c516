"""Catalog operators: look-ups, counts, pages, searches, consistency checks and table rewrites for inserts, updates and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph import contained


def file_counts(kbs: DataFrame, files: DataFrame) -> DataFrame:
    n = files.groupBy(F.col("kb_id").alias("id")).agg(F.count("*").alias("n"))
    return kbs.join(n, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("file_count"))


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of rows in a total order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_counts(rows: DataFrame, by: str, size: int) -> DataFrame:
    """by, total, total_pages."""
    return rows.groupBy(by).agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size).cast("long"))


def named_hits(hits: DataFrame, files: DataFrame) -> DataFrame:
    """hits (doc_id, ...) plus file_name: a placeholder for a blank name, another for a missing file."""
    f = files.select(F.col("id").alias("doc_id"), F.col("name").alias("__name"))
    unknown = F.concat(F.lit("未知文件_"), F.col("doc_id").cast("string"))
    name = F.when(F.col("__name").isNull(), unknown).when(F.trim("__name") == "", F.concat(F.lit("文件_"), F.col("doc_id").cast("string"))).otherwise(F.col("__name"))
    return hits.join(f, "doc_id", "left").withColumn("file_name", name).drop("__name")


def contains(keyword: str, *cols: str) -> Column:
    """Case-insensitive containment in any of the columns."""
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(F.lower(c).contains(keyword.lower()), F.lit(False))
    return out


def like(keyword: str, *cols: str) -> Column:
    """LIKE %keyword% in any of the columns, case-insensitive, with the keyword's own wildcards."""
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(F.col(c).ilike(f"%{keyword}%"), F.lit(False))
    return out


def orphans(vectors: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, side: documents with vectors but no file, and files without vectors."""
    v, f = vectors.select("doc_id").distinct(), files.select(F.col("id").alias("doc_id")).distinct()
    return v.join(f, "doc_id", "left_anti").withColumn("side", F.lit("vector_only")).unionByName(f.join(v, "doc_id", "left_anti").withColumn("side", F.lit("file_only")))


def valid_chunks(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows fit to store with defaults filled in, rejected rows with a reason)."""
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    reason = F.when(F.col("chunk_id").isNull(), "no chunk_id").when(blank, "blank text").when(F.col("doc_id").isNull(), "no doc_id")
    df = raw.withColumn("reason", reason)
    good = df.where("reason is null").drop("reason").withColumns({"ord": F.coalesce("ord", F.lit(0)), "length": F.coalesce("length", F.length("text"))})
    return good, df.where("reason is not null")


def insert_absent(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored with the rows of new whose key it lacks; stored rows win, of equal new keys one."""
    return stored.unionByName(new.dropDuplicates([key]).join(stored.select(key), key, "left_anti").select(*stored.columns))


def delete_by(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key).distinct(), key, "left_anti").select(*stored.columns)


def cascade(kb_ids: DataFrame, files: DataFrame, vectors: DataFrame, history: DataFrame) -> dict[str, DataFrame]:
    """files, vectors and history without what belongs to the knowledge bases (kb_id)."""
    gone = files.join(kb_ids.select("kb_id"), "kb_id", "left_semi").select(F.col("id").alias("doc_id"))
    return {"files": delete_by(files, kb_ids, "kb_id"), "vectors": delete_by(vectors, gone, "doc_id"), "history": delete_by(history, kb_ids, "kb_id")}


def update(stored: DataFrame, changes: DataFrame, key: str, blank_keeps: bool) -> DataFrame:
    """stored with changes (key and new values, null: as it is); blank_keeps: an empty text changes nothing either."""
    cols = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in cols])
    value = lambda c: F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")) if blank_keeps else F.col(f"__{c}"), F.col(c))
    return stored.join(new, key, "left").select(*[value(c).alias(c) if c in cols else F.col(c) for c in stored.columns])


def last_rows(rows: DataFrame, by: str, order: Column, n: int) -> DataFrame:
    """The n rows of each group that come first in an order."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def by_code(rows: DataFrame, code: str, column: str = "code") -> DataFrame:
    """The rows of a code, upper and lower case alike."""
    return rows.where(F.lower(column) == code.lower())


def valid_code(code: Column) -> Column:
    """Letters, digits, _ and - alone."""
    return F.coalesce(code.rlike("^[a-zA-Z0-9_-]+$"), F.lit(False))


def kb_by_name(asked: DataFrame, bases: DataFrame) -> DataFrame:
    """asked (name), kb_id: the knowledge base (id, name) of an equal name, else the first by id whose name holds the asked one; null if none does."""
    names = asked.select(F.col("name").alias("asked")).distinct()
    held = contained(names.select(F.col("asked").alias("part")), bases.select(F.col("name").alias("whole"))).select(F.col("part").alias("asked"), F.col("whole").alias("name"))
    found = held.join(bases, "name").groupBy("asked").agg(F.min(F.struct((F.col("name") != F.col("asked")).alias("part"), "id")).alias("b"))
    return names.join(found, "asked", "left").select("asked", F.col("b.id").alias("kb_id"))


def api_hits(hits: DataFrame) -> DataFrame:
    """Hits as an interface shows them: chunkId, docId, content, titlePath, score, rerankScore (the reranker's, else the score)."""
    return hits.select(F.col("chunk_id").alias("chunkId"), F.col("doc_id").alias("docId"), F.col("text").alias("content"), F.to_json("path").alias("titlePath"), "score", F.coalesce("rerank_score", "score").alias("rerankScore"))


def of_base(files: DataFrame, kb_id) -> DataFrame:
    """The files of a knowledge base, last uploads first."""
    return files.where(F.col("kb_id") == kb_id).orderBy(F.desc("upload_time"), "id")


def edited(cards: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """cards (with published) after changes; published ones are read-only and stay."""
    return update(cards, changes.join(cards.where("published").select(key), key, "left_anti"), key, blank_keeps=False)


def removable(files: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (kb_id, id) plus status: deleted, forbidden where the file lies in another knowledge base, missing where there is none."""
    f = files.select("id", F.col("kb_id").alias("__own"))
    status = F.when(F.col("__own").isNull(), "missing").when(F.col("__own") == F.col("kb_id"), "deleted").otherwise("forbidden")
    return asked.join(f, "id", "left").select("kb_id", "id", status.alias("status"))


def encoded_path(path: Column) -> Column:
    """A title path as the JSON text that stores keep."""
    return F.to_json(path)


def decoded_path(text: Column) -> Column:
    """The title path of a JSON text: an array of titles; empty for null, blank or malformed texts."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def document_records(records: DataFrame, ids: DataFrame) -> DataFrame:
    """records (doc_id, ord, ..., title_path JSON) of the documents asked for (doc_id), in order, with the path decoded."""
    held = records.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return held.withColumn("title_path", decoded_path(F.col("title_path"))).orderBy("doc_id", "ord")


def existing(ids: DataFrame, records: DataFrame) -> DataFrame:
    """ids (chunk_id) plus found: whether a record of that id is stored."""
    held = records.select("chunk_id").distinct().withColumn("__f", F.lit(True))
    return ids.join(held, "chunk_id", "left").withColumn("found", F.coalesce("__f", F.lit(False))).drop("__f")
