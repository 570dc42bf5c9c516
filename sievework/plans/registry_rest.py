"""Queries of what the other two modules leave: page marks, title patterns, parsed tables, images, answers, merged sources, states of records."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import models, text as tx, titles
from ..operators import catalog, fusion, graph, optimize, outline, tables, vector
from ..sources import documents as docs_of, relations as rel
from ..streaming import ingest as stream
from . import pipelines
from .registry import _LINES, _PAIR, _TITLES, S, _chunks, _lines, _t, query
from .registry_more import _PREFIXED, _prefixed


# ---- titles
_MARKED = f"""{_PREFIXED}, tl AS (SELECT p_size::BIGINT AS doc_id, id AS line_no, CASE WHEN id % 11 = 0 THEN '  ' ELSE title END AS text FROM px JOIN part ON p_partkey = id),
f AS (SELECT *, trim(text) AS t, row_number() OVER w - 1 AS i, coalesce(trim(lag(text) OVER w) = '', true) AS pe, coalesce(trim(lead(text) OVER w) = '', true) AS ne FROM tl WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
g AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, regexp_matches(t, '^第[一二三四五六七八九十百]+[章节篇]') AS ch, regexp_matches(t, '^[0-9]+[.][0-9]') AS dot, regexp_matches(t, '^[（(]') AS br, regexp_matches(t, '^[0-9]+[.、, ]') AS pu FROM f WHERE t <> ''),
cf AS (SELECT *, 2 * (pe OR ne OR i = 0 OR i = n - 1)::BIGINT + (length(t) < 80)::INT + (length(t) < 50)::INT + 5 * ch::INT + 4 * dot::INT + 3 * br::INT + 3 * pu::INT AS confidence FROM g)"""


def _marked(spark, d):
    sizes = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("doc_id"))
    text = F.when(F.col("id") % 11 == 0, "  ").otherwise(F.col("title"))
    return _prefixed(spark, d).join(sizes, "id").select("doc_id", F.col("id").alias("line_no"), text.alias("text"))


@query(rf"""WITH {_MARKED} SELECT doc_id, line_no, i AS index, length(t) AS length, len(regexp_split_to_array(t, '\s+')) AS word_count, pe AS prev_empty, ne AS next_empty, regexp_matches(t, '^[0-9]') AS starts_with_digit, regexp_matches(t, '^[一二三四五六七八九十百千零]') AS starts_with_chinese_num,
br AS starts_with_bracket, ch AS starts_with_chapter_keyword, dot AS has_dot_separated_numbers, pu AS has_punctuation_after_num, regexp_extract(t, '^第[一二三四五六七八九十百]+[章节篇]') AS prefix_pattern FROM g""")
def line_features(spark, d):
    return titles.line_features(_marked(spark, d)).drop("text", "title")


@query(f"WITH {_MARKED} SELECT doc_id, line_no, t AS title, confidence, CASE WHEN ch THEN 'chinese_chapter' END AS type FROM cf WHERE (confidence >= 3 OR ch OR dot OR br OR pu) AND (ch OR confidence >= 5)")
def title_candidates(spark, d):
    return titles.title_candidates(titles.line_features(_marked(spark, d))).select("doc_id", "line_no", "title", "confidence", "pattern.type")


@query(f"""WITH {_MARKED}, k AS (SELECT doc_id, count(*) AS n, string_agg(left(t, 30), '|' ORDER BY line_no) AS examples, min(line_no) FILTER (length(text) < 50) AS first FROM cf WHERE ch GROUP BY doc_id)
SELECT doc_id, 'level1' AS level, 'chinese_chapter' AS type, n, examples FROM k""")
def detected_patterns(spark, d):
    lines = _marked(spark, d)
    groups = titles.pattern_groups(titles.title_candidates(titles.line_features(lines)))
    return titles.pattern_hierarchy(groups, lines).join(groups, ["doc_id", "type"]).select("doc_id", "level", "type", "n", F.array_join("examples", "|").alias("examples"))


@query(r"""WITH f AS (SELECT p_size::BIGINT AS doc_id, p_partkey AS line_no, p_size || CASE p_partkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN '.1 ' ELSE '、' END || p_name AS title, CASE p_partkey % 3 WHEN 0 THEN 'rule_011' WHEN 1 THEN 'rule_013' ELSE 'rule_012' END AS format FROM part),
g AS (SELECT doc_id, format, count(*) AS n, min(line_no) AS first, arg_min(title, line_no) AS example FROM f GROUP BY 1, 2 HAVING count(*) >= 2) SELECT doc_id, format, n, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS level, example FROM g""")
def format_counts(spark, d):
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    sep = F.when(k == 0, " ").when(k == 1, ".1 ").otherwise("、")
    return titles.format_counts(_t(spark, d, "part").select(F.col("p_size").cast("long").alias("doc_id"), F.col("p_partkey").alias("line_no"), F.concat(size, sep, "p_name").alias("title")))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '1.1 x > 2 ' || p_type ELSE '1 ' || p_brand || ' > 1.1 x > 2 ' || p_type END AS path FROM part")
def same_format_titles(spark, d):
    path = F.array(F.concat(F.lit("1 "), "p_brand"), F.lit("1.1 x"), F.concat(F.lit("2 "), "p_type"))
    text = F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit("see 1 "), "p_brand")).otherwise("body")
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(titles.without_same_format(path, text), " > ").alias("path"))


@query(f"WITH {_LINES}, {_TITLES} SELECT doc_id, line_no, repeat('  ', (level - 1)::INT) || text || ' [line=' || line_no || ', level=' || level || ', rule=' || rule || ']' AS shown FROM tl")
def outline_tree(spark, d):
    return outline.tree_lines(outline.paths(outline.levels(outline.titles(_lines(spark, d)))))


# ---- pages
_MARKS = [("第 {} 页", "chinese"), ("{} / 900", "slash"), ("Page {}", "page_en"), ("{}", None), ("see {} there", None)]


@query("SELECT o_orderkey AS id, CASE WHEN k < 3 OR (k = 3 AND n < 1000) THEN n END AS num, CASE k WHEN 0 THEN 'chinese' WHEN 1 THEN 'slash' WHEN 2 THEN 'page_en' WHEN 3 THEN CASE WHEN n < 1000 THEN 'pure' END END AS format FROM (SELECT o_orderkey, o_orderkey % 5 AS k, (o_custkey * 7 % 2000)::INT AS n FROM orders)")
def page_marks(spark, d):
    n = (F.col("o_custkey") * 7 % 2000).cast("string")
    parts = [p.split("{}") for p, _ in _MARKS]
    text = F.coalesce(*[F.when(F.col("o_orderkey") % 5 == i, F.concat(F.lit(a), n, F.lit(b))) for i, (a, b) in enumerate(parts)])
    return _t(spark, d, "orders").withColumn("m", tx.page_mark(text)).select(F.col("o_orderkey").alias("id"), "m.num", "m.format")


@query("SELECT o_custkey AS doc_id, o_orderkey * 10 + 9 AS line_no FROM orders")
def page_number_lines(spark, d):
    """Every page (an order) has a mark at its foot and a number in its body that is no page number."""
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", page.alias("page"))
    foot = o.select("doc_id", "page", (F.col("o_orderkey") * 10 + 9).alias("line_no"), (F.lit(900.0) + F.col("page") % 2 * 0.2).alias("top"), F.concat(F.lit("Page "), "page").alias("text"))
    body = o.select("doc_id", "page", (F.col("o_orderkey") * 10 + 1).alias("line_no"), F.lit(300.0).alias("top"), (F.col("page") + 1).cast("string").alias("text"))
    lines = foot.unionByName(body).withColumn("m", tx.page_mark(F.col("text"))).select("doc_id", "page", "line_no", "top", "m.num", "m.format")
    return docs_of.page_number_lines(lines)


# ---- tables and images
@query(r"""WITH x AS (SELECT l_orderkey AS id, l_linenumber AS no, l_returnflag AS u, l_linestatus AS s, l_linenumber % 2 = 0 AS e FROM lineitem)
SELECT id, no, e AS two_level, u || '.a|' || u || CASE WHEN e THEN '' ELSE '.' || no END || '|' || s AS joined, u || '|a|' || u || CASE WHEN e THEN '' ELSE '|' || no END || '|' || s AS path FROM x""")
def two_level_headers(spark, d):
    upper = F.array(F.col("l_returnflag"), F.lit(" "), F.col("l_linestatus"))
    lower = F.array(F.lit("a"), F.when(F.col("l_linenumber") % 2 == 0, F.lit("")).otherwise(F.col("l_linenumber").cast("string")), F.lit(None).cast("string"))
    # the third cell below is null throughout: one blank of three, two where the second is blank too
    df = _t(spark, d, "lineitem").withColumns({"two": tables.two_level(upper, lower), "j": tables.join_levels(upper, lower)})
    return df.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("no"), F.col("two").alias("two_level"), F.array_join("j", "|").alias("joined"), F.array_join(tables.header_path(F.col("j")), "|").alias("path"))


_TABLES = """tb AS (SELECT o_custkey AS doc_id, o_orderkey AS table_id, o_orderkey % 2 = 0 OR row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS starts FROM orders),
ho AS (SELECT *, max(CASE WHEN starts THEN table_id END) OVER (PARTITION BY doc_id ORDER BY table_id) AS head_of FROM tb),
li AS (SELECT l_orderkey AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS r, l_partkey, l_suppkey FROM lineitem)"""


@query(f"""WITH {_TABLES}, b AS (SELECT doc_id, table_id, r + starts::INT AS row, head_of, r, l_partkey, l_suppkey FROM li JOIN ho USING (table_id))
SELECT doc_id, table_id, row, 'no ' || (head_of % 10) AS header, r::VARCHAR AS value FROM b UNION ALL SELECT doc_id, table_id, row, 'item', l_partkey || ' ' || l_suppkey FROM b""")
def parsed_tables(spark, d):
    """An order's lines are a table; those of odd orders go on under the headers of the customer's last even one (or the first)."""
    o = _t(spark, d, "orders")
    first = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) == 1
    tb = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("table_id"), F.col("o_orderkey").alias("table_no"), (F.col("o_orderkey") % 2 == 0).alias("fresh"), first.alias("first"))
    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), r.alias("r"), "l_partkey", "l_suppkey").join(tb.select("table_id", (F.col("fresh") | F.col("first")).cast("int").alias("up")), "table_id")
    cells = lambda *c: F.posexplode(F.array(*[x.cast("string") for x in c])).alias("col", "value")
    body = li.select("table_id", (F.col("r") + F.col("up")).alias("row"), cells(F.col("r"), F.col("l_partkey"), F.col("l_suppkey")))
    head = tb.where("fresh or first").select("table_id", F.lit(0).alias("row"), cells(F.concat(F.lit("no "), F.col("table_id") % 10), F.lit("item"), F.lit("item")))
    return tables.parsed(tb, body.unionByName(head)).withColumn("row", F.col("row").cast("long"))


@query("SELECT l_orderkey AS page, (r - 1) // 3 + 1 AS grp, count(*) AS members, min(r) * 30::DOUBLE AS x0, max(r) * 30::DOUBLE + 10 AS x1 FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) GROUP BY 1, 2")
def merged_images(spark, d):
    """Images in a row, 30 apart: a box of three has its centre 60 from the next one's."""
    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).cast("int")
    i = _t(spark, d, "lineitem").select(F.lit(1).alias("doc_id"), F.col("l_orderkey").alias("page"), r.alias("ord"), F.lit("").alias("text"))
    i = i.withColumns({"x0": F.col("ord") * 30.0, "x1": F.col("ord") * 30.0 + 10, "y0": F.lit(0.0), "y1": F.lit(10.0)})
    return tables.merge_images(i).select("page", F.col("grp").cast("long").alias("grp"), F.col("members").cast("long").alias("members"), "x0", "x1")


# ---- answers and contexts
@query("""SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'yes ' || c_name || chr(10) || 'more' WHEN 1 THEN '答案：' || c_name WHEN 2 THEN c_name WHEN 3 THEN '抱歉，无法生成答案。' ELSE '答案: ' || c_name END AS answer FROM customer""")
def clean_answers(spark, d):
    n = F.col("c_name")
    forms = [F.concat(F.lit("思考: a\nb\n答案：yes "), n, F.lit("\nmore \n")), F.concat(F.lit("  答案："), n), F.concat(n, F.lit("\n思考：t\nrest")), F.lit(""), F.concat(F.lit("答案: "), n)]
    answer = F.coalesce(*[F.when(F.col("c_custkey") % 5 == i, x) for i, x in enumerate(forms)])
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), tx.clean_answer(answer).alias("answer"))


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_name || '/seg/0' WHEN 1 THEN 'A ' || c_name || '/q/4' ELSE '' END AS entities FROM customer")
def answer_entities(spark, d):
    n = F.col("c_name")
    forms = [
        F.concat(F.lit('```json\n{"entities": [{"text": "'), n, F.lit('", "type": "seg"}, {"text": "no type"}]}\n```')),
        F.concat(F.lit('Here: {"entities": [{"text": "A\n'), n, F.lit('", "type": "q", "chunk_index": 4}]} Done')), F.lit("no {object"), F.lit('{"other": 1}'),
    ]
    answer = F.coalesce(*[F.when(F.col("c_custkey") % 4 == i, x) for i, x in enumerate(forms)])
    shown = F.array_join(F.transform(tx.answer_entities(answer), lambda e: F.concat_ws("/", e["text"], e["type"], e["chunk_index"].cast("string"))), "|")
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), shown.alias("entities"))


@query("""WITH r AS (SELECT s_nationkey AS query_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place, '[supplier] ' || s_name || ': 相关实体包括 P1, P' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ', P3' ELSE '' END AS p FROM supplier),
c AS (SELECT query_id, string_agg(p, ' | ' ORDER BY place) AS c FROM r WHERE place <= 5 GROUP BY 1) SELECT query_id, CASE WHEN length(c) > 200 THEN left(c, 200) || '...' ELSE c END AS context FROM c""")
def entity_contexts(spark, d):
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    own = F.concat(F.lit("P"), F.col("s_suppkey").cast("string"))
    near = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("P1"), own, F.lit("P3"), F.lit("P4"))).otherwise(F.array(F.lit("P1"), own))
    return optimize.entity_context(_t(spark, d, "supplier").select(F.col("s_nationkey").alias("query_id"), place.alias("place"), F.lit("supplier").alias("type"), F.col("s_name").alias("text"), near.alias("neighbors")))


@query(r"""WITH n AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS m FROM documents), t AS (SELECT doc_id, regexp_extract_all(repeat(text || ' ', ceil(900.0 / m)::INT), '[\p{L}\p{N}]+') AS t FROM n WHERE m > 0),
s AS (SELECT doc_id, t, len(t) AS n, CASE WHEN len(t) < 1200 THEN 150 WHEN len(t) < 1600 THEN 175 ELSE 200 END AS z FROM t), c AS (SELECT *, z // 2 AS h, ceil((n - z) / (z // 2))::BIGINT + 1 AS k FROM s),
w AS (SELECT *, list_transform(range(0, k), lambda i: array_to_string(t[i * h + 1 : i * h + z], ' ')) AS w, n - (k - 1) * h < 0.6 * z AS short FROM c)
SELECT doc_id, k - short::INT AS windows, md5(array_to_string(CASE WHEN short THEN list_append(w[1 : k - 2], w[k - 1] || chr(10) || w[k]) ELSE w END, '|')) AS windows_md5 FROM w""")
def topic_windows(spark, d):
    n = tx.token_count(F.col("text"))
    long = _t(spark, d, "documents").where(n > 0).select("doc_id", F.repeat(F.concat("text", F.lit(" ")), F.ceil(900 / n).cast("int")).alias("t"))
    return long.withColumn("w", optimize.topic_windows(F.col("t"))).select("doc_id", F.size("w").cast("long").alias("windows"), F.md5(F.array_join("w", "|")).alias("windows_md5"))


# ---- hits
@query("""WITH c AS (SELECT c_nationkey AS query_id, c_custkey AS chunk_id, c_mktsegment AS text, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank FROM customer), s AS (SELECT *, CASE WHEN rank IN (2, 4) THEN rank / 10 END AS rerank_score FROM c),
k AS (SELECT * FROM s WHERE rerank_score IS NOT NULL OR NOT EXISTS (SELECT 1 FROM s r WHERE r.query_id = s.query_id AND r.text = s.text AND r.rerank_score IS NOT NULL)),
o AS (SELECT query_id, chunk_id, rerank_score::DOUBLE AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, rank) AS new_rank FROM k) SELECT * FROM o WHERE new_rank <= 5""")
def padded_rerank(spark, d):
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    c = _t(spark, d, "customer").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("chunk_id"), F.col("c_mktsegment").alias("text"), rank.alias("rank"))
    scored = c.withColumn("rerank_score", F.when(F.col("rank").isin(2, 4), F.col("rank") / 10))
    return fusion.pad(scored, 5).select("query_id", "chunk_id", "rerank_score", "new_rank")


@query("""SELECT c_nationkey AS query_id, c_custkey AS chunk_id, c_custkey % 7 AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS text, CASE WHEN c_custkey % 2 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS vector_score,
CASE WHEN c_custkey % 3 = 0 THEN 7.0 ELSE 0.0 END::DOUBLE AS keyword_score, CASE WHEN c_custkey % 5 = 0 THEN 0.8 ELSE 0.0 END::DOUBLE AS graph_score, CASE WHEN c_custkey % 5 = 0 THEN 'a,b' END AS related FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0""")
def merged_sources(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("chunk_id"), (F.col("c_custkey") % 7).alias("doc_id"), F.col("c_name").alias("text"))
    found = fusion.merged(
        c.where("chunk_id % 2 = 0").withColumn("score", F.lit(0.5)), c.where("chunk_id % 3 = 0").drop("text").withColumn("score", F.lit(7.0)),
        c.where("chunk_id % 5 = 0").drop("text").withColumns({"score": F.lit(0.8), "related_entities": F.array(F.lit("a"), F.lit("b"))}),
    )
    return found.withColumn("related", F.array_join("related_entities", ",")).drop("related_entities")


@query("SELECT len(embedding)::BIGINT AS dim, count(*) AS n FROM embeddings GROUP BY 1")
def vector_dimensions(spark, d):
    return vector.dimensions(_t(spark, d, "embeddings"))


# ---- graph
@query("""WITH e AS (SELECT 'entities' AS metric, o_orderpriority AS kind, (o_custkey, c_mktsegment, o_orderpriority) AS k FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'relations', l_linestatus, (l_suppkey, l_returnflag, l_linestatus) FROM lineitem)
SELECT metric, kind, count(*) AS inputs, count(DISTINCT k) AS distinct_inputs FROM e GROUP BY GROUPING SETS ((metric, kind), (metric))""")
def graph_build_counts(spark, d):
    e = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("doc_id"), F.col("c_mktsegment").alias("text"), F.col("o_orderpriority").alias("type"))
    r = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_returnflag").alias("source"), F.lit("x").alias("target"), F.col("l_linestatus").alias("relation_type"))
    return graph.build_counts(e, r)


# ---- catalog
@query(f"WITH {S['files']} SELECT id, name, upload_time FROM files WHERE kb_id = 'src2'")
def files_of_base(spark, d):
    return catalog.of_base(rel.files(_t(spark, d, "documents")), "src2").select("id", "name", "upload_time")


@query("SELECT p_partkey AS id, p_size % 2 = 0 AS published, CASE WHEN p_partkey % 3 = 0 AND p_size % 2 = 1 THEN 'new' ELSE p_name END AS title FROM part")
def skill_edits(spark, d):
    cards = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2 == 0).alias("published"), F.col("p_name").alias("title"))
    return catalog.edited(cards, cards.where("id % 3 = 0").select("id", F.lit("new").alias("title")), "id")


@query(f"WITH {S['files']}, a AS (SELECT 'src1' AS kb_id, vec_id * 2 AS id FROM embeddings) SELECT a.kb_id, a.id, CASE WHEN f.id IS NULL OR f.kb_id IS NULL THEN 'missing' WHEN f.kb_id = a.kb_id THEN 'deleted' ELSE 'forbidden' END AS status FROM a LEFT JOIN files f USING (id)")
def file_removal(spark, d):
    asked = _t(spark, d, "embeddings").select(F.lit("src1").alias("kb_id"), (F.col("vec_id") * 2).alias("id"))
    return catalog.removable(rel.files(_t(spark, d, "documents")), asked)


# ---- ingest
@query(rf"""WITH {S['chunks']}, fl AS (SELECT doc_id, ord, text, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) < 20 AS s FROM chunks), {_PAIR},
r4 AS (SELECT *, sum(CASE WHEN lead_ AND NOT (last_ AND NOT first_ AND s) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS grp FROM r3), m AS (SELECT doc_id, grp::BIGINT AS ord, string_agg(text, chr(10) ORDER BY ord) AS text FROM r4 GROUP BY doc_id, grp)
SELECT doc_id, ord, doc_id || '_' || ord AS chunk_id, text, length(text) AS length FROM m WHERE trim(text) <> ''""")
def ingested_chunks(spark, d):
    return pipelines.ingest(_t(spark, d, "documents"), models.Hooks()).drop("embedding")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return stream.event_windows(_t(spark, d, "events")).withColumns({"window_start": F.date_format("window_start", "yyyy-MM-dd HH:mm"), "total": F.round("total", 6)})
