"""Search of documentation pages: the pages that hold most of a question's words, for many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import dictionary


def search(pages: DataFrame, questions: DataFrame, k: int = 3, shown: int = 3000, by: str | None = None) -> DataFrame:
    """query_id, rank, page_id, title, content, score: the k pages whose content holds most of a question's words.

    pages (page_id, title, content) and questions (query_id, text). Words are parted by white space, count as often as the
    question repeats them, and are looked for as substrings, case aside: one pass over each page for the words of all questions.
    Equal scores go by page_id. content is cut to ``shown`` characters in the answer alone. With by, a column of both, a question
    sees its own pages. Null texts and pages without any of the words give no rows.
    """
    keys = [by] if by else []
    word = questions.select("query_id", *[F.col(x).alias(f"q_{x}") for x in keys], F.explode(F.split(F.lower("text"), r"\s+")).alias("part")).where("part <> ''")
    word = word.groupBy("query_id", *[f"q_{x}" for x in keys], "part").agg(F.count("*").alias("n"))
    held = dictionary.find(word, pages.select("page_id", *keys, F.lower("content").alias("t")), "t", ["page_id", *keys]).join(word, "part")
    if by:
        held = held.where(F.col(by) == F.col(f"q_{by}"))
    scored = held.groupBy("query_id", "page_id").agg(F.sum("n").alias("score"))
    first = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id")).cast("long")).where(F.col("rank") <= k)
    return first.join(pages.select("page_id", "title", F.substring("content", 1, shown).alias("content")), "page_id").select("query_id", "rank", "page_id", "title", "content", "score")
