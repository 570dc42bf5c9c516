"""Further queries: document graphs, entity look-ups, tables of contents, titles, frames, tables, optimisation and validation."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import models, text as tx, titles
from ..operators import catalog, graph, layout, optimize, outline, quality, tables, vector
from ..sources import documents as docs_of, relations as rel
from . import pipelines
from .registry import _FUSED, _G, _LINES, _N2, _QM, _RERANKED, S, _chunks, _hits, _lines, _reranked, _t, _vectors, query


# ---- entities
@query("""WITH e AS (SELECT c_nationkey AS doc_id, c_mktsegment AS text, arg_max('C' || c_custkey, c_custkey) AS id FROM customer GROUP BY 1, 2),
r AS (SELECT DISTINCT a.c_nationkey AS doc_id, a.c_mktsegment AS source, b.c_mktsegment AS target FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1)
SELECT r.*, s.id AS source_id, t.id AS target_id FROM r JOIN e s ON s.doc_id = r.doc_id AND s.text = source JOIN e t ON t.doc_id = r.doc_id AND t.text = target""")
def link_entities(spark, d):
    c = _t(spark, d, "customer")
    ents = c.select(F.col("c_nationkey").alias("doc_id"), F.col("c_mktsegment").alias("text"), F.concat(F.lit("C"), "c_custkey").alias("entity_id"), F.col("c_custkey").alias("pos"))
    after = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_mktsegment").alias("target"))
    pairs = c.join(after, "c_custkey").select(F.col("c_nationkey").alias("doc_id"), F.col("c_mktsegment").alias("source"), "target").distinct()
    return graph.link_entities(pairs, ents)


@query("SELECT c_mktsegment AS text, arg_min('C' || c_custkey, c_custkey) AS entity_id FROM customer GROUP BY 1")
def entity_ids(spark, d):
    c = _t(spark, d, "customer")
    nodes = c.select(F.concat(F.lit("C"), "c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("text"), F.col("c_custkey").alias("pos"))
    return graph.first_of_text(c.select(F.col("c_mktsegment").alias("text")), nodes)


@query(f"""WITH {S['chunks']}, e AS (SELECT doc_id, regexp_extract(text, '[\\p{{L}}\\p{{N}}]+') AS text FROM chunks WHERE ord = 1), h AS (SELECT e.*, c.chunk_id, row_number() OVER (PARTITION BY e.doc_id, e.text ORDER BY c.ord) AS nth
  FROM e JOIN chunks c ON c.doc_id = e.doc_id AND contains(c.text, e.text) WHERE e.text <> '') SELECT * FROM h WHERE nth <= 3""")
def entities_in_chunks(spark, d):
    c = _chunks(spark, d)
    ents = c.where("ord = 1").select("doc_id", F.regexp_extract("text", tx.TOKEN, 0).alias("text")).where("text <> ''")
    return graph.entities_in_chunks(ents, c)


@query(f"WITH {_G}, n AS (SELECT type, text, row_number() OVER (PARTITION BY type ORDER BY text) AS nth FROM (SELECT DISTINCT type, text FROM entities)) SELECT type, string_agg(CASE WHEN nth <= 20 THEN text END, '、' ORDER BY nth) AS entities, count(*) AS n FROM n WHERE nth <= 50 GROUP BY type")
def known_entities(spark, d):
    return graph.known_list(rel.entities(spark, d))


_DOC_EDGES = "de AS (SELECT DISTINCT l_suppkey % 7 AS doc_id, 'S' || l_suppkey AS a, 'P' || (l_partkey % 200) AS b, l_suppkey || '-' || (l_partkey % 200) AS r FROM lineitem)"


@query(f"""WITH {_DOC_EDGES}, s AS (SELECT DISTINCT doc_id, a AS seed FROM de), h AS (SELECT s.doc_id, s.seed, de.b AS neighbor, r AS relation_id, row_number() OVER (PARTITION BY s.doc_id, s.seed ORDER BY r) AS seq FROM s JOIN de ON de.doc_id = s.doc_id AND de.a = s.seed)
SELECT doc_id, seed, neighbor, 1::BIGINT AS hop, 'out' AS direction, relation_id, seq FROM h WHERE seq <= 5""")
def document_neighbors(spark, d):
    x = _t(spark, d, "lineitem")
    e = x.select((F.col("l_suppkey") % 7).alias("doc_id"), F.concat(F.lit("S"), "l_suppkey").alias("source_id"), F.concat(F.lit("P"), F.col("l_partkey") % 200).alias("target_id"), F.concat_ws("-", "l_suppkey", F.col("l_partkey") % 200).alias("relation_id")).distinct()
    return graph.neighbors_in_documents(e, e.select("doc_id", F.col("source_id").alias("seed")).distinct(), 1, 5)


@query(f"""WITH {_G}, {_N2}, o AS (SELECT s_nationkey AS query_id, 'S' || s_suppkey AS seed, s_suppkey AS seed_pos FROM supplier), j AS (SELECT o.*, t AS neighbor, hop, d, relation_id, seq, row_number() OVER (PARTITION BY query_id, t ORDER BY seed_pos, seq) AS n FROM nb JOIN o USING (seed) WHERE seq <= 20)
SELECT query_id, neighbor, seed, hop::BIGINT AS hop, CASE WHEN d = 0 THEN 'out' ELSE 'in' END AS direction, relation_id, row_number() OVER (PARTITION BY query_id ORDER BY seed_pos, seq) AS place FROM j WHERE n = 1""")
def neighbors_of_several(spark, d):
    order = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("query_id"), F.concat(F.lit("S"), "s_suppkey").alias("seed"), F.col("s_suppkey").alias("seed_pos"))
    return graph.first_seen(graph.neighbors(rel.relations(spark, d), order.select("seed"), 2, 20), order)


@query(f"WITH {_G} SELECT entity_id, type, text, chunk_id AS doc_id FROM entities WHERE chunk_id = 7")
def document_nodes(spark, d):
    return graph.of_document(rel.entities(spark, d).withColumnRenamed("chunk_id", "doc_id"), 7)


_EXTRACTED = rf"""{S['chunks']}, cap AS (SELECT doc_id, chunk_id, ord, regexp_extract_all(text, '{models.CAPITALISED}') AS l FROM chunks), en AS (SELECT doc_id, chunk_id, ord, text, min(i) AS i FROM (SELECT doc_id, chunk_id, ord, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM cap) GROUP BY 1, 2, 3, 4),
no AS (SELECT *, doc_id || '_E' || (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, text) - 1) AS entity_id FROM (SELECT doc_id, text, 'term' AS type, arg_min(chunk_id, ord) AS chunk_id, min(ord) AS chunk_index, count(*) AS mentions FROM en GROUP BY 1, 2))"""


@query(f"WITH {_EXTRACTED} SELECT doc_id, text, type, chunk_id, chunk_index, mentions, entity_id FROM no")
def extracted_nodes(spark, d):
    return pipelines.document_graph(_chunks(spark, d), models.Hooks())[0].drop("pos")


@query(f"""WITH {_EXTRACTED}, pr AS (SELECT doc_id, ord, i, text AS source, lead(text) OVER (PARTITION BY doc_id, ord ORDER BY i) AS target FROM en), fp AS (SELECT doc_id, source, target, min(struct_pack(o := ord, i := i)) AS fst FROM pr WHERE target IS NOT NULL GROUP BY 1, 2, 3)
SELECT f.doc_id, f.source, f.target, 'next_to' AS relation_type, f.doc_id || '_R' || (row_number() OVER (PARTITION BY f.doc_id ORDER BY fst, f.source, f.target) - 1) AS relation_id, a.entity_id AS source_id, b.entity_id AS target_id FROM fp f JOIN no a ON a.doc_id = f.doc_id AND a.text = f.source JOIN no b ON b.doc_id = f.doc_id AND b.text = f.target""")
def extracted_edges(spark, d):
    return pipelines.document_graph(_chunks(spark, d), models.Hooks())[1]


# ---- catalog
@query("SELECT p_partkey AS id, p_brand AS code FROM part WHERE lower(p_brand) = 'brand#12'")
def code_lookup(spark, d):
    return catalog.by_code(_t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("code")), "BRAND#12")


@query("SELECT p_brand AS code, regexp_full_match(p_brand, '[a-zA-Z0-9_-]+') AS valid FROM part UNION ALL SELECT replace(p_brand, '#', '_'), true FROM part")
def code_validation(spark, d):
    codes = _t(spark, d, "part").select(F.col("p_brand").alias("code"))
    return codes.union(codes.select(F.replace("code", F.lit("#"), F.lit("_")))).select("code", catalog.valid_code(F.col("code")).alias("valid"))


@query("""WITH kb AS (SELECT DISTINCT source AS id, 'KB ' || source AS name FROM documents WHERE source IS NOT NULL), a AS (SELECT name AS asked FROM kb UNION SELECT id FROM kb UNION SELECT 'no such base')
SELECT asked, arg_min(id, (name <> asked)::INT || id) AS kb_id FROM a LEFT JOIN kb ON contains(name, asked) GROUP BY asked""")
def kb_by_name(spark, d):
    kb = rel.knowledge_bases(_t(spark, d, "documents").where("source is not null"))
    asked = kb.select("name").union(kb.select("id")).union(spark.createDataFrame([("no such base",)], "name string"))
    return catalog.kb_by_name(asked, kb)


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN 'v2' ELSE p_brand END AS card FROM part")
def card_update(spark, d):
    cards = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("card"))
    changes = cards.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "").otherwise("v2").alias("card"))
    return catalog.update(cards, changes, "id", blank_keeps=False)


@query(f"WITH {S['chunks']} SELECT doc_id, ord, md5(text) AS text_md5, '[\"' || kb_id || '\",\"' || doc_id || '\"]' AS title_path FROM chunks WHERE kb_id IS NOT NULL")
def chunk_records(spark, d):
    return _chunks(spark, d).where("kb_id is not null").select("doc_id", "ord", F.md5("text").alias("text_md5"), F.to_json(F.array("kb_id", F.col("doc_id").cast("string"))).alias("title_path"))


# ---- questions
@query(f"""WITH {_RERANKED} SELECT rr.chunk_id AS "chunkId", d.source AS "docId", md5(d.text) AS content_md5, '["' || d.source || '"]' AS "titlePath", round(fr.fused_score, 9) AS score, rr.rerank_score AS "rerankScore", rr.query_id FROM rr JOIN fr USING (query_id, chunk_id) JOIN documents d ON d.doc_id = rr.chunk_id WHERE new_rank <= 5""")
def hybrid_hits(spark, d):
    full = _reranked(spark, d).join(_t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.array("source").alias("path")), "chunk_id")
    out = catalog.api_hits(full.withColumn("score", F.round("fused_score", 9)))
    ids = full.select("query_id", F.col("chunk_id").alias("chunkId"), F.round("fused_score", 9).alias("score"))
    return out.join(ids, ["chunkId", "score"]).select("query_id", "chunkId", "docId", F.md5("content").alias("content_md5"), "titlePath", "score", "rerankScore").distinct()


@query(f"""WITH {_FUSED}, k AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM vs WHERE own)
SELECT query_id, count(*) AS hits, count(*) FILTER (chunk_id IN (SELECT vec_id FROM embeddings)) AS known, min(chunk_id) AS least FROM k WHERE rank <= 5 GROUP BY query_id""")
def recall_test(spark, d):
    """The vector stage of a recall test: each question's five best within its knowledge base, with their chunks joined back."""
    hits = _hits(spark, d, by="kb_id")["vector"].where("rank <= 5").join(_vectors(spark, d).select("chunk_id", F.lit(1).alias("there")), "chunk_id", "left")
    return hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.count("there").alias("known"), F.min("chunk_id").alias("least"))


@query(r"""WITH q AS (SELECT conv_id AS query_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id), p AS (SELECT query_id, list_filter(regexp_split_to_array(text, '[?？;；.]\s*'), lambda x: trim(x) <> '') AS l, text FROM q)
SELECT query_id, (i - 1)::INT AS part, l[i] AS text FROM (SELECT query_id, CASE WHEN len(l) > 0 THEN l ELSE [text] END AS l FROM p), unnest(range(1, len(l) + 1)) u(i)""")
def split_questions(spark, d):
    turns = _t(spark, d, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("text"))
    hooks = models.Hooks(split=lambda q: F.filter(F.split(q, r"[?？;；.]\s*"), lambda x: F.trim(x) != ""))
    return models.sub_questions(turns, hooks)


@query("SELECT query_id, CASE WHEN n = 1 OR c >= 0.6 THEN kb END AS kb_id FROM (SELECT o_custkey AS query_id, arg_max(o_orderpriority || o_orderkey, o_totalprice / 500000) AS kb, max(o_totalprice / 500000) AS c, count(*) AS n FROM orders GROUP BY 1)")
def predicted_base(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.concat("o_orderpriority", "o_orderkey").alias("kb_id"), (F.col("o_totalprice") / 500000).alias("confidence"))
    return models.predict_knowledge_base(o)


# ---- titles and tables of contents
_TOC = f"""{_LINES}, tc AS (SELECT n_regionkey::BIGINT AS doc_id, 1 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS line_no, (n_regionkey + 1) || '.' || (n_nationkey + 1) || ' ' || n_name || ' ' || (n_nationkey + 3) AS text FROM nation),
al AS (SELECT r_regionkey::BIGINT AS doc_id, 1 AS line_no, '目录' AS text FROM region UNION ALL SELECT * FROM tc UNION ALL SELECT doc_id, line_no + 100, text FROM ln)"""


def _toc_lines(spark, d):
    n = _t(spark, d, "nation")
    head = _t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit(1).cast("long").alias("line_no"), F.lit("目录").alias("text"))
    no = (1 + F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))).cast("long")
    entries = n.select(F.col("n_regionkey").cast("long"), no, F.concat((F.col("n_regionkey") + 1).cast("string"), F.lit("."), (F.col("n_nationkey") + 1).cast("string"), F.lit(" "), "n_name", F.lit(" "), (F.col("n_nationkey") + 3).cast("string")))
    return head.union(entries).union(_lines(spark, d).select("doc_id", F.col("line_no") + 100, "text"))


_TOC_RANGE = rf"""{_TOC}, en AS (SELECT doc_id, line_no, regexp_extract(text, '^[0-9]+(\.[0-9]+)+') AS core FROM al WHERE regexp_matches(text, '[0-9]$') AND regexp_matches(text, '^[0-9]+\.[0-9]')),
ag AS (SELECT DISTINCT en.doc_id, en.line_no, line_no - dense_rank() OVER (PARTITION BY en.doc_id ORDER BY en.line_no) AS isl FROM en WHERE EXISTS (SELECT 1 FROM al b WHERE b.doc_id = en.doc_id AND b.line_no > en.line_no AND contains(b.text, en.core))),
st AS (SELECT doc_id, min(s) AS s FROM (SELECT doc_id, min(line_no) AS s FROM ag GROUP BY doc_id, isl HAVING count(*) >= 2) GROUP BY doc_id),
fi AS (SELECT st.doc_id, s, en.core FROM st JOIN en ON en.doc_id = st.doc_id AND en.line_no = s),
tr AS (SELECT doc_id, s - 1 AS toc_start, (SELECT min(line_no) - 1 FROM al b WHERE b.doc_id = fi.doc_id AND b.line_no > s AND contains(b.text, core)) AS toc_end FROM fi)"""


@query(f"WITH {_TOC_RANGE} SELECT doc_id, s AS toc_start FROM st")
def toc_start(spark, d):
    return outline.toc_start(_toc_lines(spark, d))


@query(f"WITH {_TOC_RANGE} SELECT doc_id, toc_start, toc_end FROM tr")
def toc_range(spark, d):
    return outline.toc_range(_toc_lines(spark, d))


@query(rf"WITH {_TOC_RANGE} SELECT al.doc_id, line_no, text AS title FROM al JOIN tr USING (doc_id) WHERE line_no > toc_end AND regexp_matches(text, '^[0-9]+(\.[0-9]+|\s)')")
def titles_after_toc(spark, d):
    lines = _toc_lines(spark, d)
    return outline.after_toc(outline.titles(lines), outline.toc_range(lines)).select("doc_id", "line_no", "title")


_PREFIXED = "px AS (SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN '第三章 ' WHEN 1 THEN '二、' WHEN 2 THEN '（三）' WHEN 3 THEN p_size || '. ' WHEN 4 THEN p_size || '.1 ' WHEN 5 THEN '1.2.' || p_size || ', ' WHEN 6 THEN '(' || p_size || ') ' WHEN 7 THEN p_size || '、' ELSE '' END || p_name AS title FROM part)"


def _prefixed(spark, d):
    k, size = F.col("p_partkey") % 9, F.col("p_size").cast("string")
    forms = [F.lit("第三章 "), F.lit("二、"), F.lit("（三）"), F.concat(size, F.lit(". ")), F.concat(size, F.lit(".1 ")), F.concat(F.lit("1.2."), size, F.lit(", ")), F.concat(F.lit("("), size, F.lit(") ")), F.concat(size, F.lit("、")), F.lit("")]
    prefix = F.coalesce(*[F.when(k == i, x) for i, x in enumerate(forms)])
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(prefix, "p_name").alias("title"))


@query(f"WITH {_PREFIXED} SELECT id, CASE id % 9 WHEN 0 THEN 'chinese_chapter' WHEN 2 THEN 'bracket_chinese_num' WHEN 6 THEN 'bracket_number' WHEN 1 THEN CASE WHEN length(title) < 10 THEN 'chinese_num_dot' END WHEN 8 THEN NULL ELSE 'numbered_dotted' END AS type, CASE id % 9 WHEN 0 THEN 'high' WHEN 3 THEN 'high' WHEN 7 THEN 'high' WHEN 4 THEN 'medium' WHEN 8 THEN NULL WHEN 1 THEN CASE WHEN length(title) < 10 THEN 'medium' END ELSE 'low' END AS level FROM px")
def prefix_patterns(spark, d):
    p = _prefixed(spark, d).withColumn("p", titles.prefix_pattern(F.col("title")))
    return p.select("id", "p.type", "p.level")


@query(r"WITH " + _PREFIXED + r", f AS (SELECT id, title, CASE WHEN regexp_matches(title, '^第[一二三四五六七八九十百]+章\s+.') THEN 'rule_001' WHEN regexp_matches(title, '^[一二三四五六七八九十百]+[、,]\s*.') THEN 'rule_010' WHEN regexp_matches(title, '^[0-9]+\s+.') THEN 'rule_011' WHEN regexp_matches(title, '^[0-9]+[、,]\s*.') THEN 'rule_012' WHEN regexp_matches(title, '^[0-9]+(\.[0-9]+)+\s+.') THEN 'rule_013' WHEN regexp_matches(title, '^[0-9]+(\.[0-9]+)+[、,]\s*.') THEN 'rule_014' END AS format FROM px WHERE title <> '') SELECT * FROM f")
def title_formats(spark, d):
    return _prefixed(spark, d).where("title <> ''").select("id", "title", titles.title_format(F.col("title")).alias("format"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 5 THEN NULL ELSE (o_custkey % 500)::INT END AS number FROM orders")
def page_numbers(spark, d):
    k, n = F.col("o_orderkey") % 6, (F.col("o_custkey") % 500).cast("string")
    marks = [F.concat(F.lit("第 "), n, F.lit(" 页")), F.concat(n, F.lit("页")), F.concat(F.lit("- "), n, F.lit(" -")), F.concat(n, F.lit(" / 900")), F.concat(F.lit(" "), n), F.concat(F.lit("no "), n)]
    text = F.coalesce(*[F.when(k == i, x) for i, x in enumerate(marks)])
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), tx.page_number(text).alias("number"))


_RULED = [("第三章", "CN_CHAPTER"), ("第二部分", "CN_PART"), ("第十节", "CN_SECTION"), ("第四篇", "CN_ARTICLE"), ("第一百条", "CN_ITEM"), ("第3章", "NUM_CHAPTER"), ("第2部分", "NUM_PART"), ("第10节", "NUM_SECTION"), ("第4篇", "NUM_ARTICLE"), ("第100条", "NUM_ITEM"), ("3.2.1", "NUM_DECIMAL"), ("7 ", "NUM_SIMPLE"), ("十二、", "CN_LIST"), ("x", None)]


@query("SELECT p_partkey AS doc_id, 1::BIGINT AS line_no, CASE p_partkey % 14 " + " ".join(f"WHEN {i} THEN '{x}'" for i, (x, _) in enumerate(_RULED)) + " END || p_name AS title, CASE p_partkey % 14 " + " ".join(f"WHEN {i} THEN '{r}'" for i, (_, r) in enumerate(_RULED) if r) + " END AS rule FROM part WHERE p_partkey % 14 <> 13")
def title_rules(spark, d):
    k = F.col("p_partkey") % len(_RULED)
    prefix = F.coalesce(*[F.when(k == i, F.lit(x)) for i, (x, _) in enumerate(_RULED)])
    lines = _t(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).cast("long").alias("line_no"), F.concat(prefix, "p_name", F.lit("  ")).alias("text"))
    return outline.titles(lines).select("doc_id", "line_no", "title", "rule")


# ---- pages
_PG = """pl AS (SELECT o_custkey AS doc_id, o_orderkey AS page, k AS line_no, k * 100.0 AS top, 1000.0 AS height, text FROM (SELECT o_custkey, o_orderkey, 0 AS k, 'HEADER ' || (o_custkey % 10) AS text FROM orders UNION ALL SELECT o_custkey, o_orderkey, l_linenumber, 'item ' || min(l_partkey % 3) FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3
  UNION ALL SELECT o_custkey, o_orderkey, 9, CASE WHEN o_custkey % 2 = 0 THEN 'FOOT' ELSE (o_orderkey % 90)::VARCHAR END FROM orders))"""


def _pages(spark, d, *by):
    o, lines = _t(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page")), _t(spark, d, "lineitem")
    n = lines.count() + 2 * o.count()  # of the files' own counts
    head = o.select("doc_id", "page", F.lit(0).alias("line_no"), F.concat(F.lit("HEADER "), F.col("doc_id") % 10).alias("text"))
    body = rel.dealt(o, n, "page").join(rel.dealt(lines, n, "l_orderkey"), F.col("page") == F.col("l_orderkey")).groupBy("doc_id", "page", F.col("l_linenumber").alias("line_no")).agg(F.concat(F.lit("item "), F.min(F.col("l_partkey") % 3)).alias("text"))
    foot = o.select("doc_id", "page", F.lit(9).alias("line_no"), F.when(F.col("doc_id") % 2 == 0, "FOOT").otherwise((F.col("page") % 90).cast("string")).alias("text"))
    return rel.dealt(head.unionByName(body).unionByName(foot), n, *(by or ("doc_id",))).select("doc_id", "page", "line_no", (F.col("line_no") * 100.0).alias("top"), F.lit(1000.0).alias("height"), "text")


@query(f"""WITH {_PG}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no DESC) AS b FROM pl), s AS (SELECT doc_id, text, count(*) FILTER (a <= 3) AS u, count(*) FILTER (b <= 3) AS v FROM r GROUP BY 1, 2),
p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM pl GROUP BY 1) SELECT doc_id, page, line_no, text FROM r JOIN s USING (doc_id, text) JOIN p USING (doc_id) WHERE NOT (top <= 100 AND u >= 0.8 * pages) AND NOT (top > 100 AND top >= 900 AND v >= 0.8 * pages)""")
def frame_lines(spark, d):
    return layout.frame_lines(_pages(spark, d)).select("doc_id", "page", "line_no", "text")


@query(f"WITH {_PG} SELECT doc_id, page, line_no, text FROM pl WHERE NOT (line_no = 9 AND doc_id % 2 = 1)")
def page_number_removal(spark, d):
    return layout.without_page_numbers(_pages(spark, d)).select("doc_id", "page", "line_no", "text")


@query(f"WITH {_PG}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) AS n, count(*) OVER (PARTITION BY doc_id) AS c FROM pl) SELECT doc_id, n AS line_no, text FROM r WHERE c < 3 OR (n > 2 AND n <= c - 2 AND NOT regexp_matches(text, '^[0-9]+$'))")
def frame_elements(spark, d):
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line_no")).cast("long")
    el = _pages(spark, d).select("doc_id", n.alias("line_no"), F.lit("text").alias("type"), "text")
    return docs_of.without_frame(el).select("doc_id", "line_no", "text")


@query(f"WITH {_PG} SELECT doc_id, page, line_no FROM pl WHERE NOT (top BETWEEN 199 AND 401)")
def outside_tables(spark, d):
    pages = _pages(spark, d, "doc_id", "page")
    boxes = pages.select("doc_id", "page").distinct().withColumns({"y0": F.lit(200.0), "y1": F.lit(400.0)})
    return docs_of.outside_boxes(pages, boxes).select("doc_id", "page", "line_no")


# ---- chunk optimisation
@query(f"WITH {S['chunks']} SELECT DISTINCT c.doc_id, c.ord, c.chunk_id FROM chunks c JOIN chunks w ON w.doc_id = c.doc_id AND w.ord % 9 = 4 AND abs(c.ord - w.ord) <= 1")
def chunk_neighbors(spark, d):
    c = _chunks(spark, d)
    return optimize.with_neighbors(c, c.where("ord % 9 = 4").select("doc_id", "ord")).select("doc_id", "ord", "chunk_id")


@query(f"WITH {S['chunks']}, t AS (SELECT doc_id, ord, ord - row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM chunks WHERE length % 3 <> 0) SELECT doc_id, ord, min(ord) OVER (PARTITION BY doc_id, i) AS run FROM t")
def consecutive_chunks(spark, d):
    return optimize.consecutive(_chunks(spark, d).where("length % 3 <> 0").select("doc_id", "ord"))


@query(f"""WITH {S['chunks']}, c AS (SELECT doc_id, ord, coalesce(sum(length) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length FROM chunks), s AS (SELECT DISTINCT doc_id, 40 AS b, 240 AS e FROM chunks)
SELECT s.doc_id, b AS start, e AS "end", ord FROM s JOIN c ON c.doc_id = s.doc_id AND b < a + length AND e > a""")
def piece_sources(spark, d):
    c = _chunks(spark, d)
    at = F.coalesce(F.sum("length").over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = c.select("doc_id", "ord", at.alias("c_start"), (at + F.col("length")).alias("c_end"))
    spans = c.select("doc_id").distinct().withColumns({"start": F.lit(40), "end": F.lit(240)})
    return optimize.sources_of(spans, placed).select("doc_id", "start", "end", "ord")


@query(f"""WITH {S['chunks']}, p AS (SELECT doc_id, ord, text, CASE WHEN contains(text, '. ') THEN instr(text, '. ') - 1 ELSE instr(text, '.') - 1 END AS x FROM chunks) SELECT doc_id, ord, CASE WHEN x > 0 THEN '0:' || left(text, x::INT) || '|' || x || ':' || substr(text, x + 1) ELSE '0:' || text END AS pieces FROM p WHERE length(text) > 0""")
def chunk_pieces(spark, d):
    p = optimize.pieces(F.col("text"), optimize.split_places(F.col("text"), F.array(F.lit(". "))))
    shown = F.array_join(F.transform(p, lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["text"])), "|")
    return _chunks(spark, d).where("length > 0").select("doc_id", "ord", shown.alias("pieces"))


@query(f"""WITH {S['chunks']}, m AS (SELECT *, CASE WHEN ord % 5 IN (1, 2) THEN ord - ord % 5 + 1 ELSE ord END AS g FROM chunks), w AS (SELECT doc_id, g, max(ord) AS last_ord, string_agg(text, '' ORDER BY ord) AS t, bool_or(ord % 3 = 0) AS c FROM m GROUP BY 1, 2),
x AS (SELECT *, CASE WHEN NOT c THEN 0 WHEN contains(t, '. ') THEN instr(t, '. ') - 1 ELSE instr(t, '.') - 1 END AS cut FROM w), p AS (SELECT doc_id, g, last_ord, i, CASE WHEN cut <= 0 THEN t WHEN i = 0 THEN left(t, cut::INT) ELSE substr(t, cut::INT + 1) END AS text FROM x, (VALUES (0), (1)) v(i) WHERE i = 0 OR cut > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, i) AS ord, text, g AS first_ord, last_ord FROM p WHERE text <> ''""")
def optimized_chunks(spark, d):
    c = _chunks(spark, d)
    cuts = c.where("ord % 3 = 0").select("doc_id", "ord", F.array(F.lit(". ")).alias("fragments"))
    return optimize.optimized(c, c.where("ord % 5 in (1, 2)"), cuts)


@query(f"WITH {S['vectors']} SELECT vec_id AS chunk_id, vec_id % 3 = 0 AS has_graph, CASE WHEN vec_id % 3 = 0 THEN 'a,b' ELSE '' END AS related, CASE WHEN vec_id % 3 = 0 THEN 0.7 ELSE 0.0 END::DOUBLE AS graph_score FROM embeddings")
def enriched_hits(spark, d):
    hits = _t(spark, d, "embeddings").select(F.lit(1).alias("query_id"), F.col("vec_id").alias("chunk_id"))
    related = hits.where("chunk_id % 3 = 0").withColumns({"related_entities": F.array(F.lit("a"), F.lit("b")), "graph_score": F.lit(0.7)})
    return optimize.enrich(hits, related).select("chunk_id", "has_graph", F.array_join("related_entities", ",").alias("related"), "graph_score")


# ---- validation
@query(f"""WITH {S['vectors']}, p AS (SELECT chunk_id, kb_id, embedding AS a, lead(embedding) OVER (PARTITION BY kb_id ORDER BY chunk_id) AS b FROM vectors WHERE kb_id IS NOT NULL), s AS (SELECT chunk_id, round(list_cosine_similarity(a, b), 9) AS x, round(list_cosine_similarity(a, b) + 0.6, 9) AS y FROM p WHERE b IS NOT NULL)
SELECT chunk_id, CASE WHEN y > 0.93 THEN 60 WHEN y > 0.85 THEN 40 WHEN y > 0.75 THEN 15 ELSE 0 END::BIGINT AS merge_topic_risk, CASE WHEN x < 0.5 THEN 60 WHEN x < 0.65 THEN 35 WHEN x < 0.75 THEN 20 ELSE 0 END::BIGINT AS split_topic_risk, y > 0.93 OR x < 0.5 AS topic_hard FROM s""")
def topic_rules(spark, d):
    w = Window.partitionBy("kb_id").orderBy("chunk_id")
    p = _vectors(spark, d).where("kb_id is not null").withColumn("b", F.lead("embedding").over(w)).where("b is not null").withColumn("s", vector.cosine(F.col("embedding"), F.col("b")))
    return quality.topic_rules(p.select("chunk_id", F.round("s", 9).alias("least_similarity"), F.round(F.col("s") + 0.6, 9).alias("neighbor_similarity"))).select("chunk_id", "merge_topic_risk", "split_topic_risk", "topic_hard")


@query(f"""WITH {S['chunks']}, {_QM}, v AS (SELECT doc_id, ord, ord % 4 = 0 AS broken, CASE WHEN ord % 5 = 0 THEN 40 WHEN ord % 5 = 1 THEN 60 ELSE 0 END AS mt, ord % 5 = 1 AS th FROM chunks)
SELECT qa.doc_id, qa.ord, total_risk + CASE WHEN broken THEN 20 ELSE 0 END + mt AS total_risk, hard OR th AS hard, CASE WHEN coalesce(mode = 'merge', false) OR mt > 0 THEN 'merge' WHEN total_risk + CASE WHEN broken THEN 20 ELSE 0 END + mt > 0 THEN 'split' END AS mode FROM qa JOIN v USING (doc_id, ord)""")
def all_rules(spark, d):
    judged = quality.rules(quality.measured(_chunks(spark, d).select("doc_id", "ord", "text")))
    path = F.when(F.col("ord") % 4 == 0, F.array(F.lit("Intro"), F.lit("1.1 x"))).otherwise(F.array(F.lit("1 a"), F.lit("1.1 x")))
    judged = judged.withColumn("breaks_structure", titles.breaks_structure(path, [r"^[0-9]+ ", r"^[0-9]+\.[0-9]+"]))
    near = F.when(F.col("ord") % 5 == 0, 0.9).when(F.col("ord") % 5 == 1, 0.95)
    return quality.validated(quality.topic_rules(judged.withColumns({"neighbor_similarity": near, "least_similarity": F.lit(None).cast("double")}))).select("doc_id", "ord", "total_risk", "hard", "mode")


# ---- tables
@query("SELECT l_orderkey AS id, l_linenumber AS no, 'flag: ' || l_returnflag || ' | part: ' || l_partkey AS text FROM lineitem")
def row_texts(spark, d):
    row = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit(" "), F.lit("dropped"), F.lit("part"), F.col("l_partkey").cast("string"))
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("no"), tables.row_text(row).alias("text"))


@query("""SELECT l_orderkey AS table_id, 'no | part' || chr(10) || '---------' || chr(10) || string_agg(l_linenumber || ' | ' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey) AS text FROM lineitem GROUP BY 1""")
def table_texts(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    cells = F.transform("r", lambda x: F.array(x["l_linenumber"].cast("string"), x["l_partkey"].cast("string")))
    t = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(rows.alias("r"))
    return t.select("table_id", tables.table_text(F.array(F.lit("no"), F.lit("part")), cells).alias("text"))


@query("""WITH v AS (SELECT l_orderkey AS table_id, c AS col, max(CASE WHEN l_linenumber = 1 THEN CASE c WHEN 0 THEN l_returnflag ELSE l_linestatus END END) AS a, max(CASE WHEN l_linenumber = 2 THEN l_returnflag END) AS b FROM lineitem, (VALUES (0), (1)) v(c) WHERE l_linenumber <= 2 GROUP BY 1, 2)
SELECT table_id, col, concat_ws('.', a, CASE WHEN b IS DISTINCT FROM a THEN b END) AS header FROM v""")
def flat_headers(spark, d):
    x = _t(spark, d, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).alias("row"), F.explode(F.array(F.lit(0), F.lit(1))).alias("col"), "l_returnflag", "l_linestatus")
    cells = x.select("table_id", "row", "col", F.when((F.col("row") == 0) & (F.col("col") == 1), F.col("l_linestatus")).otherwise(F.col("l_returnflag")).alias("value"))
    return layout.flat_headers(cells.groupBy("table_id", "row", "col").agg(F.max("value").alias("value")), 2)


@query("SELECT o_custkey AS doc_id, count(*) AS n, sum(o_totalprice)::DOUBLE AS total FROM orders GROUP BY 1")
def merged_table_rows(spark, d):
    """All tables of a page (one page a customer, next to each other) fold into one: its members and rows."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("int")
    zero = F.lit(0.0)
    t = _t(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page"), n.alias("ord"), F.lit("t").alias("text"), F.col("o_totalprice").alias("row_count"), zero.alias("x0"), zero.alias("y0"), zero.alias("x1"), zero.alias("y1"))
    # a group reaches two places beyond its first member, so the parts of a page are added up
    return tables.merge_tables(t).groupBy("doc_id").agg(F.sum("members").alias("n"), F.sum("row_count").alias("total"))
