"""Chunk quality: length, content, parameter-mixing and topic rules with risk scores and handling modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import is_parameter_line, token_count
from .optimize import topic_windows
from .vector import cosine


def measured(chunks: DataFrame, title_tokens: Column | None = None) -> DataFrame:
    """chunks (doc_id, ord, text) plus tokens, content_tokens, doc_tokens, median_tokens, param_tokens."""
    lines = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != "")
    w = Window.partitionBy("doc_id")
    df = chunks.withColumn("tokens", token_count(F.col("text")))
    title = title_tokens if title_tokens is not None else F.lit(0)
    params = F.aggregate(F.filter(lines, is_parameter_line), F.lit(0).cast("long"), lambda a, x: a + token_count(x))
    return df.withColumns({"content_tokens": F.col("tokens") - title, "doc_tokens": F.sum("tokens").over(w), "median_tokens": F.median("tokens").over(w), "param_tokens": params})


def rules(m: DataFrame) -> DataFrame:
    """m plus short_risk, long_risk, content_risk, hard, mixing_risk, total_risk, mode (merge before split)."""
    t, med, c = F.col("tokens"), F.col("median_tokens"), F.col("content_tokens")
    ratio = F.col("param_tokens") / F.nullif(t, F.lit(0))
    case = lambda *pairs: F.coalesce(*[F.when(cond, F.lit(v)) for cond, v in pairs], F.lit(0)).cast("long")
    short_doc = F.col("doc_tokens") < 3000
    df = m.withColumns({
        "short_risk": case((t < 80, 15), (t < 0.25 * med, 10), (t < 0.4 * med, 5)),
        "long_risk": case((t > 1000, 15), (t > 3.5 * med, 10), (t > 2.5 * med, 5)),
        "content_risk": case((c == 0, 60), (c <= 20, 40), (short_doc, 0), (c < 100, 15), (c < 200, 10)),
        "hard": c == 0,
        "mixing_risk": case((ratio.isNull() | (ratio < 0.2) | (ratio > 0.8), 0), ((ratio < 0.3) | (ratio > 0.7), 10), ((ratio < 0.4) | (ratio > 0.6), 18), (F.lit(True), 25)),
    })
    merge = (F.col("short_risk") > 0) | (F.col("content_risk") > 0)
    total = F.col("short_risk") + F.col("long_risk") + F.col("content_risk") + F.col("mixing_risk")
    return df.withColumn("total_risk", total).withColumn("mode", F.when(merge, "merge").when(total > 0, "split"))


def risky(judged: DataFrame, least: int = 40) -> DataFrame:
    return judged.where((F.col("total_risk") >= least) | F.col("hard"))


def summary(judged: DataFrame, least: int = 40) -> DataFrame:
    """doc_id, chunks, error_chunks, hard_chunks, total_risk, high_risk."""
    n = lambda c: F.count_if(c)
    return judged.groupBy("doc_id").agg(F.count("*").alias("chunks"), n(F.col("total_risk") > 0).alias("error_chunks"), n((F.col("total_risk") > 0) & F.col("hard")).alias("hard_chunks"), F.sum("total_risk").alias("total_risk"), n(F.col("total_risk") >= least).alias("high_risk"))


def short_runs(chunks: DataFrame, below: int = 150) -> DataFrame:
    """doc_id, first_ord, last_ord, n: runs of two or more neighbouring chunks under a number of tokens."""
    df = chunks.withColumn("tokens", token_count(F.col("text"))).where(F.col("tokens") < below)
    island = F.col("ord") - F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    return df.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.count("*").alias("n")).where("n >= 2").drop("island")


def neighbor_similarity(measured: DataFrame, embed, below: int = 150) -> DataFrame:
    """measured (doc_id, ord, text, tokens) plus neighbor_similarity: of chunks in a run of two or more neighbours under ``below`` tokens, the greater cosine with the chunk before and the one after.

    The chunks at a run's ends are compared with those beyond it too, however long those are. Null for all other chunks. Only
    chunks in runs and next to them are embedded. A neighbour has the ord before or after; a zero or null vector's cosine is 0.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    beside = lambda c, step: F.when(F.lag("ord", step).over(w) == F.col("ord") - step, F.lag(c, step).over(w))
    either = lambda c: F.coalesce(beside(c, 1), F.lit(False)) | F.coalesce(beside(c, -1), F.lit(False))
    df = measured.withColumn("__short", F.col("tokens") < below)
    df = df.withColumn("__run", F.col("__short") & either("__short"))
    df = df.withColumn("__wanted", F.col("__run") | either("__run"))
    df = df.withColumn("__v", F.when(F.col("__wanted"), embed(F.col("text"))))
    near = lambda step: F.when(beside("__wanted", step), cosine(F.col("__v"), beside("__v", step)))
    return df.withColumn("neighbor_similarity", F.when(F.col("__run"), F.greatest(near(1), near(-1)))).drop("__short", "__run", "__wanted", "__v")


def window_similarity(measured: DataFrame, embed, above: int = 800) -> DataFrame:
    """measured (doc_id, ord, text, tokens) plus least_similarity: the least cosine of windows next to each other in a chunk of more than ``above`` tokens, else null."""
    parts = measured.where(F.col("tokens") > above).select("doc_id", "ord", F.posexplode(topic_windows(F.col("text"), above)).alias("i", "part"))
    parts = parts.withColumn("v", embed(F.col("part")))
    pairs = parts.withColumn("n", F.lead("v").over(Window.partitionBy("doc_id", "ord").orderBy("i"))).where("n is not null")
    least = pairs.groupBy("doc_id", "ord").agg(F.min(cosine(F.col("v"), F.col("n"))).alias("least_similarity"))
    return measured.join(least, ["doc_id", "ord"], "left")


def topic_risk(similarity: Column, merge: bool) -> Column:
    """Risk of a similarity: between neighbours that should be one (merge), or of the least between parts of one chunk."""
    if merge:
        return F.when(similarity > 0.93, 60).when(similarity > 0.85, 40).when(similarity > 0.75, 15).otherwise(0)
    return F.when(similarity < 0.5, 60).when(similarity < 0.65, 35).when(similarity < 0.75, 20).otherwise(0)


def topic_rules(df: DataFrame) -> DataFrame:
    """df (neighbor_similarity, least_similarity, each null where it isn't known) plus merge_topic_risk, split_topic_risk, topic_hard: the worst bands are hard."""
    merge = F.coalesce(F.when(F.col("neighbor_similarity").isNotNull(), topic_risk(F.col("neighbor_similarity"), True)), F.lit(0))
    split = F.coalesce(F.when(F.col("least_similarity").isNotNull(), topic_risk(F.col("least_similarity"), False)), F.lit(0))
    hard = F.coalesce(F.col("neighbor_similarity") > 0.93, F.lit(False)) | F.coalesce(F.col("least_similarity") < 0.5, F.lit(False))
    return df.withColumns({"merge_topic_risk": merge.cast("long"), "split_topic_risk": split.cast("long"), "topic_hard": hard})


def validated(df: DataFrame, structure_risk: int = 20) -> DataFrame:
    """rules() rows with breaks_structure and topic_rules() columns: one total_risk, hard flag and mode over all rules."""
    structure = F.when(F.col("breaks_structure"), structure_risk).otherwise(0)
    merge = (F.coalesce(F.col("mode") == "merge", F.lit(False))) | (F.col("merge_topic_risk") > 0)
    total = F.col("total_risk") + structure + F.col("merge_topic_risk") + F.col("split_topic_risk")
    return df.withColumns({"total_risk": total.cast("long"), "hard": F.col("hard") | F.col("topic_hard"), "mode": F.when(merge, "merge").when(total > 0, "split")})
