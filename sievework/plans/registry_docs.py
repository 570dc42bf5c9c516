"""Queries of documentation pages and of chunks as they are stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import docs
from . import pipelines
from .registry import _PAGES, _PAIR, S, _chunks, _t, html_extract, query


@query(rf"""WITH {_PAGES}, w AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS part FROM benchmark),
n AS (SELECT item_id, part, count(*) AS n FROM w WHERE part <> '' GROUP BY 1, 2),
s AS (SELECT item_id AS query_id, page_id, any_value(title) AS title, any_value(left(content, 3000)) AS content, sum(n)::BIGINT AS score FROM n JOIN pg ON contains(lower(content), part) GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS rank, page_id, title, content, score FROM s QUALIFY rank <= 3""")
def docs_search_batch(spark, d):
    """The three pages that hold most words of each benchmark item."""
    return docs.search(html_extract(spark, d), _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query(rf"""WITH {S['chunks']}, b AS (SELECT doc_id, ord, text, CASE WHEN ord % 3 = 0 THEN [kb_id, text] ELSE [kb_id] END AS path, CASE WHEN ord % 5 <> 0 THEN ord // 10 END AS page, CASE WHEN ord % 4 = 0 THEN 'catalog' END AS kind FROM chunks),
fl AS (SELECT *, text = path[-1] AS s FROM b), {_PAIR}, r4 AS (SELECT *, sum(CASE WHEN lead_ THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS grp FROM r3),
m AS (SELECT doc_id, grp::BIGINT AS ord, doc_id || '_' || grp::BIGINT AS chunk_id, string_agg(text, chr(10) ORDER BY ord) AS text, any_value(path[1]) || coalesce(' > ' || max(CASE WHEN s THEN text END), '') AS path,
  coalesce(arg_max(page, CASE WHEN page IS NOT NULL THEN ord END), 1)::BIGINT AS page, CASE WHEN count(*) = 1 THEN coalesce(any_value(kind), 'text') ELSE 'text' END AS type FROM r4 GROUP BY doc_id, grp),
tk AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM m), po AS (SELECT chunk_id, term, count(*) AS tf FROM tk GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
kw AS (SELECT chunk_id, term, row_number() OVER (PARTITION BY chunk_id ORDER BY round(tf * ln((SELECT count(*) FROM m)::DOUBLE / df), 9) DESC, term) AS rank FROM po JOIN df USING (term)),
ks AS (SELECT chunk_id, string_agg(term, ',' ORDER BY rank) AS keywords FROM kw WHERE rank <= 10 GROUP BY chunk_id)
SELECT m.*, coalesce(keywords, '') AS keywords, length(text) AS length FROM m LEFT JOIN ks USING (chunk_id)""")
def processed_chunks(spark, d):
    """Chunks with a title of their own every third line, a page for four of five and a type for each fourth."""
    path = F.when(F.col("ord") % 3 == 0, F.array("kb_id", "text")).otherwise(F.array("kb_id"))
    rows = _chunks(spark, d).select("doc_id", "ord", "text", path.alias("path"), F.when(F.col("ord") % 5 != 0, F.floor(F.col("ord") / 10)).cast("long").alias("page"), F.when(F.col("ord") % 4 == 0, "catalog").alias("type"))
    return pipelines.post_processed(rows).withColumns({"path": F.array_join("path", " > "), "keywords": F.array_join("keywords", ",")})
