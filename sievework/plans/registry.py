"""Queries over the engine's operators, and the same in SQL for checking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as tx
from ..operators import catalog, context, fusion, graph, keyword, layout, outline, quality, vector
from ..sources import relations as rel

S = rel.SQL
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return rel.table(spark, d, name)


def _vectors(spark, d):
    return rel.vectors(_t(spark, d, "embeddings"), _t(spark, d, "documents"))


def _chunks(spark, d):
    return rel.chunks(_t(spark, d, "documents"))


def _first_vector(spark, d) -> list[float]:
    return _t(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


# ---- vector search
_KNN = f"WITH {S['vectors']}, q AS (SELECT embedding AS e FROM vectors WHERE chunk_id = 0) SELECT chunk_id, doc_id, kb_id, round(1 - list_sum(list_transform(list_zip(embedding, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS score FROM vectors, q"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("chunk_id", "doc_id", "kb_id", F.round("score", 6).alias("score"))


@query(f"{_KNN} ORDER BY score DESC, chunk_id LIMIT 5")
def knn_topk(spark, d):
    return _rounded(vector.top_k(_vectors(spark, d), _first_vector(spark, d), 5))


@query(f"{_KNN} WHERE kb_id IN ('src0', 'src1') ORDER BY score DESC, chunk_id LIMIT 5")
def knn_kb_filtered(spark, d):
    return _rounded(vector.top_k(_vectors(spark, d).where(F.col("kb_id").isin("src0", "src1")), _first_vector(spark, d), 5))


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, 1 - list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 20""")
def knn_batch(spark, d):
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    q = v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    return vector.top_k_batch(q, v, 20).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT count(*) AS total_chunks, count(DISTINCT vec_id) AS total_documents FROM embeddings")
def vector_stats(spark, d):
    return vector.stats(_vectors(spark, d))


@query(f"""WITH {S['vectors']}, p AS (SELECT chunk_id, embedding AS a, lead(embedding) OVER (PARTITION BY kb_id ORDER BY chunk_id) AS b FROM vectors WHERE kb_id IS NOT NULL)
SELECT chunk_id, round(list_cosine_similarity(a, b), 6) AS similarity, CASE WHEN list_cosine_similarity(a, b) > 0.93 THEN 60 WHEN list_cosine_similarity(a, b) > 0.85 THEN 40 WHEN list_cosine_similarity(a, b) > 0.75 THEN 15 ELSE 0 END AS merge_risk,
CASE WHEN list_cosine_similarity(a, b) < 0.5 THEN 60 WHEN list_cosine_similarity(a, b) < 0.65 THEN 35 WHEN list_cosine_similarity(a, b) < 0.75 THEN 20 ELSE 0 END AS split_risk FROM p WHERE b IS NOT NULL""")
def neighbor_similarity(spark, d):
    w = Window.partitionBy("kb_id").orderBy("chunk_id")
    p = _vectors(spark, d).where("kb_id is not null").withColumn("b", F.lead("embedding").over(w)).where("b is not null").withColumn("s", vector.cosine(F.col("embedding"), F.col("b")))
    return p.select("chunk_id", F.round("s", 6).alias("similarity"), quality.topic_risk(F.col("s"), True).alias("merge_risk"), quality.topic_risk(F.col("s"), False).alias("split_risk"))


# ---- questions: the first user turn of every conversation whose id divides by 20, with its whole text; documents as chunks
_QUESTIONS = """qs AS (SELECT conv_id AS query_id, arg_min(text, turn) AS text, 'src' || ((conv_id // 20) % 20) AS kb_id FROM conversations WHERE role = 'user' AND conv_id % 20 = 0 GROUP BY conv_id)"""
_BM25 = rf"""{_QUESTIONS}, docs AS (SELECT doc_id AS chunk_id, source, lower(text) AS t FROM documents), tok AS (SELECT chunk_id, unnest(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+')) AS term FROM docs),
post AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY 1, 2), len AS (SELECT chunk_id, source, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+')) AS dl FROM docs), n AS (SELECT count(*) AS n, avg(dl) AS al FROM len),
raw AS (SELECT term, count(*) AS df, ln(any_value(n.n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, n GROUP BY term), fl AS (SELECT 0.25 * avg(raw) AS fl FROM raw),
qt AS (SELECT query_id, kb_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM qs), q AS (SELECT query_id, kb_id, term, count(*) AS qf FROM qt GROUP BY 1, 2, 3),
sc AS (SELECT query_id, post.chunk_id, any_value(source = kb_id) AS own, sum(qf * CASE WHEN raw < 0 THEN fl ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al))) AS score FROM q JOIN raw USING (term) JOIN post USING (term) JOIN len USING (chunk_id), fl, n GROUP BY 1, 2),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc WHERE score > 0)"""


def _questions(spark, d):
    """query_id, text, kb_id: the first user turn of each conversation whose id divides by 20."""
    turns = _t(spark, d, "conversations").where("role = 'user' AND conv_id % 20 = 0")
    return turns.groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("text")).withColumn("kb_id", F.concat(F.lit("src"), F.floor(F.col("query_id") / 20).cast("long") % 20))


def _documents_as_chunks(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("kb_id"))


@query(f"WITH {_BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM kw WHERE rank <= 20")
def bm25_topk(spark, d):
    return keyword.search(_questions(spark, d), _documents_as_chunks(spark, d), 20).withColumn("score", F.round("score", 6))


@query(rf"""WITH {_BM25}, w AS (SELECT post.chunk_id, post.term AS keyword, round(tf * ln(n.n::DOUBLE / df), 9) AS weight FROM post JOIN raw USING (term), n),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY weight DESC, keyword) AS rank FROM w) SELECT chunk_id, keyword, round(weight, 6) AS weight, rank FROM r WHERE rank <= 10""")
def tfidf_keywords(spark, d):
    return keyword.keywords(_documents_as_chunks(spark, d), 10).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_BM25} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term HAVING count(*) > 1")
def term_stats(spark, d):
    return keyword.postings(_documents_as_chunks(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where("df > 1")


# ---- fusion
_DISTANCE = "1 - list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))"
_FUSED = f"""{_BM25}, vs AS (SELECT query_id, v.vec_id AS chunk_id, d.source = kb_id AS own, {_DISTANCE} AS score FROM qs JOIN embeddings q ON q.vec_id = query_id, embeddings v LEFT JOIN documents d ON d.doc_id = v.vec_id),
vh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM vs),
u AS (SELECT query_id, chunk_id, 0.5 / (60 + rank) AS v, NULL AS k FROM vh WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, NULL, 0.3 / (60 + rank) FROM kw WHERE rank <= 20),
f AS (SELECT query_id, chunk_id, coalesce(sum(v), 0) AS vector_part, coalesce(sum(k), 0) AS keyword_part, 0.0::DOUBLE AS graph_part, coalesce(sum(v), 0) + coalesce(sum(k), 0) AS fused_score FROM u GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused_score, 12) DESC, chunk_id) AS rank FROM f)"""


def _hits(spark, d, by=None):
    """Vector and keyword hits of the questions, with by within their own knowledge base."""
    asked = _questions(spark, d)
    v = _vectors(spark, d)
    q = asked.select("query_id", "kb_id").join(v.select(F.col("chunk_id").alias("query_id"), "embedding"), "query_id")
    return {"vector": vector.top_k_batch(q, v, 20, by=by), "keyword": keyword.search(asked, _documents_as_chunks(spark, d), 20, by=by)}


@query(f"WITH {_FUSED} SELECT query_id, chunk_id, round(vector_part, 9) AS vector_part, round(keyword_part, 9) AS keyword_part, graph_part, round(fused_score, 9) AS fused_score, rank FROM fr WHERE rank <= 20")
def rrf_fusion(spark, d):
    out = fusion.best(fusion.rrf(_hits(spark, d)), 20)
    return out.select("query_id", "chunk_id", *[F.round(c, 9).alias(c) for c in ("vector_part", "keyword_part", "graph_part", "fused_score")], "rank")


_RERANKED = rf"""{_FUSED}, ca AS (SELECT fr.query_id, fr.chunk_id, fr.rank, regexp_extract_all(lower(qd.text), '[\p{{L}}\p{{N}}]+') AS qt, regexp_extract_all(lower(cd.text), '[\p{{L}}\p{{N}}]+') AS ct
  FROM fr JOIN qs qd USING (query_id) JOIN documents cd ON cd.doc_id = fr.chunk_id WHERE rank <= 20),
rs AS (SELECT query_id, chunk_id, rank, coalesce(round(len(list_intersect(list_distinct(qt), ct))::DOUBLE / nullif(len(list_distinct(qt)), 0), 9), 0) AS rerank_score FROM ca),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS new_rank FROM rs)"""


def _reranked(spark, d, n=5, by=None):
    docs = _documents_as_chunks(spark, d).select("chunk_id", "text")
    fused = fusion.best(fusion.rrf(_hits(spark, d, by)), 20).join(_questions(spark, d).select("query_id", F.col("text").alias("query")), "query_id").join(docs, "chunk_id")
    return fusion.rerank(fused, n=n)


@query(f"WITH {_RERANKED} SELECT query_id, chunk_id, rerank_score, new_rank FROM rr WHERE new_rank <= 5 AND rerank_score >= 0.3")
def rerank_gate(spark, d):
    return fusion.gate(_reranked(spark, d)).select("query_id", "chunk_id", "rerank_score", "new_rank")


# the search within the question's knowledge base, as a copy of the global one on scoped hits
_SCOPED = rf"""{_RERANKED}, skw AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc WHERE score > 0 AND own),
svh AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM vs WHERE own),
su AS (SELECT query_id, chunk_id, 0.5 / (60 + rank) AS p FROM svh WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, 0.3 / (60 + rank) FROM skw WHERE rank <= 20),
sfr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(f, 12) DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, sum(p) AS f FROM su GROUP BY 1, 2)),
srs AS (SELECT query_id, chunk_id, rank, coalesce(round(len(list_intersect(list_distinct(qt), ct))::DOUBLE / nullif(len(list_distinct(qt)), 0), 9), 0) AS rerank_score FROM (SELECT sfr.*, regexp_extract_all(lower(qs.text), '[\p{{L}}\p{{N}}]+') AS qt,
  regexp_extract_all(lower(cd.text), '[\p{{L}}\p{{N}}]+') AS ct FROM sfr JOIN qs USING (query_id) JOIN documents cd ON cd.doc_id = sfr.chunk_id WHERE rank <= 20)),
srr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS new_rank FROM srs)"""


@query(f"""WITH {_SCOPED}, tp AS (SELECT query_id, max(rerank_score) AS top FROM srr WHERE new_rank <= 5 GROUP BY 1), ch AS (SELECT qs.query_id, coalesce(top, 0) >= 0.6 AS stay FROM qs LEFT JOIN tp USING (query_id))
SELECT query_id, chunk_id, rerank_score, 'kb' AS scope FROM srr JOIN ch USING (query_id) WHERE stay AND new_rank <= 5 UNION ALL SELECT query_id, chunk_id, rerank_score, 'global' FROM rr JOIN ch USING (query_id) WHERE NOT stay AND new_rank <= 5""")
def two_stage_fallback(spark, d):
    cols = ["query_id", "chunk_id", "rerank_score"]
    return fusion.fallback(_reranked(spark, d, by="kb_id").select(*cols), _reranked(spark, d).select(*cols), _questions(spark, d).select("query_id", "kb_id"))


@query(rf"""WITH {_RERANKED}, h AS (SELECT rr.query_id, rr.new_rank AS rank, d.source, rr.chunk_id AS ord, d.text FROM rr JOIN documents d ON d.doc_id = rr.chunk_id WHERE new_rank <= 5),
g AS (SELECT query_id, source, min(rank) AS first, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text FROM h GROUP BY 1, 2), c AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY first) AS context FROM g GROUP BY 1)
SELECT query_id, CASE WHEN length(context) > 3000 THEN left(context, 3000) || chr(10) || '...(内容截断)' ELSE context END AS context FROM c""")
def answer_context(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    hits = _reranked(spark, d).join(docs, "chunk_id").select("query_id", F.col("new_rank").alias("rank"), F.col("source").alias("doc_id"), F.col("chunk_id").alias("ord"), "text")
    return context.build(hits)


# ---- graph
_G = f"{S['entities']}, {S['relations']}"


@query(f"""WITH {_G} SELECT 'nodes' AS metric, type AS kind, count(*) AS n FROM entities GROUP BY type UNION ALL SELECT 'nodes', NULL, count(*) FROM entities
UNION ALL SELECT 'edges', relation_type, count(*) FROM relations GROUP BY relation_type UNION ALL SELECT 'edges', NULL, count(*) FROM relations""")
def graph_stats(spark, d):
    return graph.stats(rel.entities(spark, d), rel.relations(spark, d))


@query(f"WITH {_G} SELECT entity_id, type, text, chunk_id FROM entities WHERE contains(lower(text), 'red')")
def entity_text_search(spark, d):
    return graph.search(rel.entities(spark, d), "RED")


@query(f"WITH {_G} SELECT entity_id, type, text, chunk_id FROM entities WHERE type = 'nation'")
def entity_type_search(spark, d):
    return graph.search(rel.entities(spark, d), "ignored", "nation")


_N2 = """both_ AS (SELECT source_id AS a, target_id AS t, 0 AS d, relation_id FROM relations UNION ALL SELECT target_id, source_id, 1, relation_id FROM relations), s AS (SELECT entity_id AS seed FROM entities WHERE type = 'supplier'),
h1 AS (SELECT seed, t, 1 AS hop, 0 AS pos, d, relation_id, min(d) OVER (PARTITION BY seed, t) AS md, min(relation_id) OVER (PARTITION BY seed, t, d) AS low FROM s JOIN both_ ON a = seed WHERE t <> seed), k1 AS (SELECT * FROM h1 WHERE d = md),
f1 AS (SELECT seed, t, row_number() OVER (PARTITION BY seed ORDER BY d, low) AS pos FROM (SELECT DISTINCT seed, t, d, low FROM k1)),
h2 AS (SELECT f1.seed, b.t, 2 AS hop, f1.pos, b.d, b.relation_id FROM f1 JOIN both_ b ON b.a = f1.t WHERE b.t <> f1.seed AND NOT EXISTS (SELECT 1 FROM f1 x WHERE x.seed = f1.seed AND x.t = b.t)),
m2 AS (SELECT *, rank() OVER (PARTITION BY seed, t ORDER BY pos, d) AS rk FROM h2), k2 AS (SELECT *, min(relation_id) OVER (PARTITION BY seed, t) AS low FROM m2 WHERE rk = 1),
al AS (SELECT seed, t, hop, pos, d, low, relation_id FROM k1 UNION ALL SELECT seed, t, hop, pos, d, low, relation_id FROM k2),
nb AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hop, pos, d, low, relation_id) AS seq FROM al)"""


@query(f"WITH {_G}, {_N2} SELECT seed, t AS neighbor, hop::BIGINT AS hop, CASE WHEN d = 0 THEN 'out' ELSE 'in' END AS direction, relation_id, seq FROM nb WHERE seq <= 20")
def neighbors_2hop(spark, d):
    seeds = rel.entities(spark, d).where("type = 'supplier'").select(F.col("entity_id").alias("seed"))
    return graph.neighbors(rel.relations(spark, d), seeds, 2, 20)


@query(f"""WITH {_G}, {_N2} SELECT seed, chunk_id, round(0.8 - 0.1 * arg_min(hop, seq), 6)::DOUBLE AS score, string_agg(t, ',' ORDER BY seq) AS entities FROM nb JOIN entities e ON e.entity_id = nb.t WHERE seq <= 20 GROUP BY seed, chunk_id""")
def related_chunks(spark, d):
    nodes = rel.entities(spark, d)
    seeds = nodes.where("type = 'supplier'").select(F.col("entity_id").alias("seed"))
    return graph.related_chunks(graph.neighbors(rel.relations(spark, d), seeds, 2, 20), nodes).withColumn("score", F.round("score", 6))


_PATHS = f"""{_G}, e AS MATERIALIZED (SELECT source_id AS a, target_id AS b FROM relations), ends AS (SELECT * FROM (VALUES ('R0'), ('R1')) v(t)),
pa AS (SELECT s.entity_id AS source, x.b AS target, s.entity_id || '>' || x.b AS path, 1::BIGINT AS length FROM entities s JOIN e x ON x.a = s.entity_id JOIN ends ON t = x.b WHERE type = 'supplier'
UNION ALL SELECT s.entity_id, y.b, s.entity_id || '>' || x.b || '>' || y.b, 2 FROM entities s JOIN e x ON x.a = s.entity_id JOIN e y ON y.a = x.b JOIN ends ON t = y.b WHERE type = 'supplier' AND x.b NOT IN (s.entity_id, y.b) AND y.b <> s.entity_id
UNION ALL SELECT s.entity_id, z.b, s.entity_id || '>' || x.b || '>' || y.b || '>' || z.b, 3 FROM entities s JOIN e x ON x.a = s.entity_id JOIN e y ON y.a = x.b JOIN e z ON z.a = y.b JOIN ends ON t = z.b
  WHERE type = 'supplier' AND x.b NOT IN (s.entity_id, y.b, z.b) AND y.b NOT IN (s.entity_id, z.b) AND z.b <> s.entity_id)"""


def _paths(spark, d):
    nodes = rel.entities(spark, d)
    pairs = nodes.where("type = 'supplier'").select(F.col("entity_id").alias("source"), F.explode(F.array(F.lit("R0"), F.lit("R1"))).alias("target"))
    return graph.paths(rel.relations(spark, d), pairs, 3)


@query(f"WITH {_PATHS} SELECT * FROM pa")
def simple_paths(spark, d):
    return _paths(spark, d)


@query(f"WITH {_PATHS} SELECT DISTINCT source, target, path, n.chunk_id, 1.0::DOUBLE AS score FROM (SELECT *, unnest(string_split(path, '>')) AS entity_id FROM pa) JOIN entities n USING (entity_id)")
def path_retrieval(spark, d):
    return graph.path_chunks(_paths(spark, d), rel.entities(spark, d))


@query("""WITH raw AS (SELECT o_custkey AS doc_id, c_mktsegment AS text, o_orderpriority AS type, o_orderkey % 97 AS chunk_id, o_orderkey AS chunk_index FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT doc_id, text, type, arg_min(chunk_id, chunk_index) AS chunk_id, min(chunk_index) AS chunk_index, count(*) AS mentions FROM raw GROUP BY 1, 2, 3""")
def entity_dedup(spark, d):
    raw = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return graph.dedup_entities(raw.select(F.col("o_custkey").alias("doc_id"), F.col("c_mktsegment").alias("text"), F.col("o_orderpriority").alias("type"), (F.col("o_orderkey") % 97).alias("chunk_id"), F.col("o_orderkey").alias("chunk_index"), F.col("o_orderkey").alias("pos")))


@query("""WITH raw AS (SELECT l_suppkey AS doc_id, 'P' || (l_partkey % 50) AS source, l_returnflag AS target, l_linestatus AS relation_type, l_orderkey * 10 + l_linenumber AS pos FROM lineitem),
f AS (SELECT doc_id, source, target, relation_type, min(pos) AS pos FROM raw GROUP BY 1, 2, 3, 4), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, source, target, relation_type) - 1 AS i FROM f)
SELECT doc_id, source, target, relation_type, doc_id || '_R' || i AS relation_id, count(*) OVER (PARTITION BY doc_id) AS of_doc FROM n""")
def relation_dedup(spark, d):
    raw = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.concat(F.lit("P"), F.col("l_partkey") % 50).alias("source"), F.col("l_returnflag").alias("target"), F.col("l_linestatus").alias("relation_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return graph.dedup_relations(raw).select("doc_id", "source", "target", "relation_type", "relation_id", F.count("*").over(Window.partitionBy("doc_id")).alias("of_doc"))


@query("""WITH known AS (SELECT DISTINCT p_name AS text FROM part), m AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS mention FROM part UNION SELECT p_name FROM part),
e AS (SELECT mention, mention AS text, 'exact' AS how FROM m WHERE mention IN (SELECT text FROM known)), z AS (SELECT mention, text, row_number() OVER (PARTITION BY mention ORDER BY length(text) DESC, text) AS n FROM m JOIN known ON contains(text, mention) OR contains(mention, text) WHERE mention NOT IN (SELECT text FROM known))
SELECT * FROM e UNION ALL SELECT mention, text, 'fuzzy' FROM z WHERE n = 1""")
def entity_match(spark, d):
    parts = _t(spark, d, "part")
    mentions = parts.select(F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)).alias("mention")).union(parts.select("p_name")).distinct()
    return graph.match_known(mentions, parts.select(F.col("p_name").alias("text")))


# ---- outline over region / nation titles with customer lines below
_LINES = """ln AS (SELECT r_regionkey::BIGINT AS doc_id, row_number() OVER (PARTITION BY r_regionkey ORDER BY k1, k2, k3) AS line_no, text FROM (
  SELECT r_regionkey, -1 AS k1, -1 AS k2, -1 AS k3, (r_regionkey + 1) || ' ' || r_name AS text FROM region UNION ALL
  SELECT n_regionkey, n_nationkey, -1, -1, (n_regionkey + 1) || '.' || (n_nationkey + 1) || ' ' || n_name FROM nation UNION ALL
  SELECT n_regionkey, n_nationkey, 0, c_custkey, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey))"""
_TITLES = r"""ti AS (SELECT *, CASE WHEN regexp_matches(text, '^[0-9]+(\.[0-9]+)+') THEN 'NUM_DECIMAL' WHEN regexp_matches(text, '^[0-9]+\s+') THEN 'NUM_SIMPLE' END AS rule FROM ln),
lv AS (SELECT doc_id, rule, row_number() OVER (PARTITION BY doc_id ORDER BY min(line_no)) AS level FROM ti WHERE rule IS NOT NULL GROUP BY doc_id, rule), tl AS (SELECT ti.*, level FROM ti JOIN lv USING (doc_id, rule))"""


def _lines(spark, d):
    none = F.lit(-1).cast("long")
    region = _t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), none.alias("k1"), none.alias("k2"), none.alias("k3"), F.concat((F.col("r_regionkey") + 1).cast("string"), F.lit(" "), "r_name").alias("text"))
    nation = _t(spark, d, "nation")
    titles = nation.select(F.col("n_regionkey").cast("long"), F.col("n_nationkey").cast("long"), none, none, F.concat((F.col("n_regionkey") + 1).cast("string"), F.lit("."), (F.col("n_nationkey") + 1).cast("string"), F.lit(" "), "n_name"))
    body = _t(spark, d, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_regionkey").cast("long"), F.col("n_nationkey").cast("long"), F.lit(0).cast("long"), F.col("c_custkey"), "c_name")
    rows = region.union(titles).union(body)
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("k1", "k2", "k3")).cast("long").alias("line_no"), "text")


@query(f"WITH {_LINES}, {_TITLES} SELECT doc_id, line_no, text AS title, rule, level FROM tl")
def outline_levels(spark, d):
    return outline.levels(outline.titles(_lines(spark, d))).select("doc_id", "line_no", "title", "rule", "level")


@query(f"""WITH {_LINES}, {_TITLES} SELECT doc_id, line_no, CASE WHEN level = 1 THEN text ELSE max_by(CASE WHEN level = 1 THEN text END, CASE WHEN level = 1 THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) || ' > ' || text END AS path FROM tl""")
def title_paths(spark, d):
    return outline.paths(outline.levels(outline.titles(_lines(spark, d)))).select("doc_id", "line_no", F.array_join("path", " > ").alias("path"))


@query(f"""WITH {_LINES}, {_TITLES}, tp AS (SELECT doc_id, line_no, CASE WHEN level = 1 THEN text ELSE max_by(CASE WHEN level = 1 THEN text END, CASE WHEN level = 1 THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) || ' > ' || text END AS path FROM tl),
g AS (SELECT ln.*, tp.path, tp.path IS NOT NULL AS t, lag(tp.path IS NOT NULL) OVER (PARTITION BY ln.doc_id ORDER BY ln.line_no) AS pt FROM ln LEFT JOIN tp USING (doc_id, line_no)),
h AS (SELECT *, sum(CASE WHEN t AND NOT coalesce(pt, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS grp FROM g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp) AS ord, string_agg(text, chr(10) ORDER BY line_no) AS text, arg_max(path, CASE WHEN t THEN line_no END) AS path, min(line_no) AS first_line FROM h GROUP BY doc_id, grp""")
def chunk_by_title(spark, d):
    lines = _lines(spark, d)
    return outline.chunks_by_title(lines, outline.paths(outline.levels(outline.titles(lines))))


_PAIR = """r1 AS (SELECT *, sum(CASE WHEN s THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM fl), r2 AS (SELECT *, CASE WHEN s THEN row_number() OVER (PARTITION BY doc_id, run, s ORDER BY ord) ELSE 0 END AS p FROM r1),
r3 AS (SELECT *, NOT coalesce(lag(s) OVER w AND lag(p) OVER w % 2 = 1, false) AS lead_, lead(ord) OVER w IS NULL AS last_, lag(ord) OVER w IS NULL AS first_ FROM r2 WINDOW w AS (PARTITION BY doc_id ORDER BY ord))"""


@query(rf"""WITH {S['chunks']}, fl AS (SELECT doc_id, ord, text, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) < 20 AS s FROM chunks), {_PAIR},
r4 AS (SELECT *, sum(CASE WHEN lead_ AND NOT (last_ AND NOT first_ AND s) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS grp FROM r3)
SELECT doc_id, grp::BIGINT AS ord, string_agg(text, chr(10) ORDER BY ord) AS text, min(ord) AS first_ord, max(ord) AS last_ord FROM r4 GROUP BY doc_id, grp""")
def merge_short(spark, d):
    return outline.merge_short(_chunks(spark, d).select("doc_id", "ord", "text"), tx.token_count(F.col("text")) < 20)


@query(rf"""WITH {S['chunks']}, b AS (SELECT doc_id, ord, text, CASE WHEN ord % 3 = 0 THEN [kb_id, text] ELSE [kb_id] END AS path FROM chunks), fl AS (SELECT *, text = path[-1] AS s FROM b), {_PAIR},
r4 AS (SELECT *, sum(CASE WHEN lead_ THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS grp FROM r3)
SELECT doc_id, grp::BIGINT AS ord, string_agg(text, chr(10) ORDER BY ord) AS text, any_value(path[1]) || coalesce(' > ' || max(CASE WHEN s THEN text END), '') AS path, count(*) AS n FROM r4 GROUP BY doc_id, grp""")
def merge_title_only(spark, d):
    c = _chunks(spark, d).select("doc_id", "ord", "text", F.when(F.col("ord") % 3 == 0, F.array("kb_id", "text")).otherwise(F.array("kb_id")).alias("path"))
    counted = outline._pairs(c, F.col("text") == F.element_at("path", -1), fold_last=False).groupBy("doc_id", F.col("group").cast("long").alias("ord")).agg(F.count("*").alias("n"))
    return outline.merge_title_only(c).join(counted, ["doc_id", "ord"])


# ---- chunk quality
_QM = r"""tk AS (SELECT doc_id, ord, text, len(regexp_extract_all(text, '[\p{L}\p{N}]+'))::BIGINT AS tokens FROM chunks), me AS (SELECT *, tokens AS c, sum(tokens) OVER (PARTITION BY doc_id) AS dt, median(tokens) OVER (PARTITION BY doc_id) AS med FROM tk),
ru AS (SELECT doc_id, ord, tokens, CASE WHEN tokens < 80 THEN 15 WHEN tokens < 0.25 * med THEN 10 WHEN tokens < 0.4 * med THEN 5 ELSE 0 END::BIGINT AS short_risk, CASE WHEN tokens > 1000 THEN 15 WHEN tokens > 3.5 * med THEN 10 WHEN tokens > 2.5 * med THEN 5 ELSE 0 END::BIGINT AS long_risk,
  CASE WHEN c = 0 THEN 60 WHEN c <= 20 THEN 40 WHEN dt < 3000 THEN 0 WHEN c < 100 THEN 15 WHEN c < 200 THEN 10 ELSE 0 END::BIGINT AS content_risk, c = 0 AS hard,
  CASE WHEN tokens > 0 AND (regexp_matches(trim(text), '^\s*[\p{L}\p{N}_]+\s*(=|:|：)\s*.+') OR regexp_matches(trim(text), '^\s*["''\{\[\(].*') OR regexp_matches(trim(text), '^\s*-\s+[\p{L}\p{N}_]+\s*:') OR regexp_matches(trim(text), '^\s*[\p{L}\p{N}_]+\s*\|\s*')) THEN tokens ELSE 0 END AS pt FROM me),
rk AS (SELECT *, CASE WHEN tokens = 0 OR pt::DOUBLE / tokens < 0.2 OR pt::DOUBLE / tokens > 0.8 THEN 0 WHEN pt::DOUBLE / tokens < 0.3 OR pt::DOUBLE / tokens > 0.7 THEN 10 WHEN pt::DOUBLE / tokens < 0.4 OR pt::DOUBLE / tokens > 0.6 THEN 18 ELSE 25 END::BIGINT AS mixing_risk FROM ru),
qa AS (SELECT *, short_risk + long_risk + content_risk + mixing_risk AS total_risk, CASE WHEN short_risk > 0 OR content_risk > 0 THEN 'merge' WHEN short_risk + long_risk + content_risk + mixing_risk > 0 THEN 'split' END AS mode FROM rk)"""


def _judged(spark, d):
    return quality.rules(quality.measured(_chunks(spark, d).select("doc_id", "ord", "text")))


@query(f"WITH {S['chunks']}, {_QM} SELECT doc_id, ord, tokens, short_risk, long_risk, content_risk, hard, mixing_risk, total_risk, mode FROM qa")
def chunk_quality(spark, d):
    return _judged(spark, d).select("doc_id", "ord", "tokens", "short_risk", "long_risk", "content_risk", "hard", "mixing_risk", "total_risk", "mode")


@query(f"WITH {S['chunks']}, {_QM} SELECT doc_id, count(*) AS chunks, count(*) FILTER (total_risk > 0) AS error_chunks, count(*) FILTER (total_risk > 0 AND hard) AS hard_chunks, sum(total_risk)::BIGINT AS total_risk, count(*) FILTER (total_risk >= 40) AS high_risk FROM qa GROUP BY doc_id")
def quality_summary(spark, d):
    return quality.summary(_judged(spark, d))


@query(f"WITH {S['chunks']}, {_QM} SELECT doc_id, ord, total_risk, mode FROM qa WHERE total_risk >= 40 OR hard")
def risky_chunks(spark, d):
    return quality.risky(_judged(spark, d)).select("doc_id", "ord", "total_risk", "mode")


@query(rf"""WITH {S['chunks']}, t AS (SELECT doc_id, ord, ord - row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM chunks WHERE len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) < 150)
SELECT doc_id, min(ord) AS first_ord, max(ord) AS last_ord, count(*) AS n FROM t GROUP BY doc_id, island HAVING count(*) >= 2""")
def short_runs(spark, d):
    return quality.short_runs(_chunks(spark, d))


# ---- catalog
@query(f"WITH {S['files']} SELECT kb_id AS id, 'KB ' || kb_id AS name, count(*) AS file_count FROM files GROUP BY kb_id")
def kb_file_counts(spark, d):
    docs = _t(spark, d, "documents")
    return catalog.file_counts(rel.knowledge_bases(docs), rel.files(docs))


@query(f"WITH {S['history']} SELECT * FROM history WHERE kb_id = 'src3' ORDER BY timestamp DESC, id LIMIT 5 OFFSET 5")
def history_page(spark, d):
    return catalog.page(rel.history(_t(spark, d, "conversations")).where("kb_id = 'src3'"), [F.desc("timestamp"), "id"], 2, 5)


@query(f"WITH {S['history']} SELECT kb_id, count(*) AS total, ceil(count(*) / 10.0)::BIGINT AS total_pages FROM history GROUP BY kb_id")
def history_counts(spark, d):
    return catalog.page_counts(rel.history(_t(spark, d, "conversations")), "kb_id", 10)


@query(f"""WITH {S['files']} SELECT vec_id AS doc_id, CASE WHEN f.id IS NULL THEN '未知文件_' || vec_id WHEN trim(name) = '' THEN '文件_' || vec_id ELSE name END AS file_name FROM embeddings LEFT JOIN files f ON f.id = vec_id""")
def hits_with_names(spark, d):
    hits = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return catalog.named_hits(hits, rel.files(_t(spark, d, "documents"))).select("doc_id", "file_name")


@query("SELECT vec_id AS doc_id, 'vector_only' AS side FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'file_only' FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def orphans(spark, d):
    docs = _t(spark, d, "documents")
    return catalog.orphans(_vectors(spark, d), rel.files(docs))


@query("SELECT p_partkey AS id, p_name AS title, p_type AS description FROM part WHERE p_name ILIKE '%r_d%' OR p_type ILIKE '%r_d%'")
def skill_search(spark, d):
    return _t(spark, d, "part").where(catalog.like("R_D", "p_name", "p_type")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("description"))


@query("SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'published' ELSE 'draft' END AS status FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')")
def public_skill_search(spark, d):
    return _t(spark, d, "part").where(catalog.contains("Ring", "p_name", "p_brand")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, "published").otherwise("draft").alias("status"))


@query(f"WITH {S['chunks']} SELECT doc_id, count(*) AS chunks, sum(length)::BIGINT AS characters, max(ord) AS last_ord FROM chunks GROUP BY doc_id")
def doc_stats(spark, d):
    return _chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("length").alias("characters"), F.max("ord").alias("last_ord"))


@query(f"""WITH {S['files']}, {S['history']} SELECT 'files' AS relation, count(*) AS n FROM files WHERE kb_id NOT IN ('src0', 'src7') UNION ALL SELECT 'history', count(*) FROM history WHERE kb_id NOT IN ('src0', 'src7')
UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE source IN ('src0', 'src7'))""")
def cascade_delete(spark, d):
    docs = _t(spark, d, "documents")
    kbs = spark.createDataFrame([("src0",), ("src7",)], "kb_id string")
    left = catalog.cascade(kbs, rel.files(docs), _vectors(spark, d), rel.history(_t(spark, d, "conversations")))
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n") for name, df in left.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new ' || c_name FROM customer WHERE c_custkey % 3 = 0")
def insert_absent(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return catalog.insert_absent(c.where("id % 3 <> 0"), c.withColumn("name", F.concat(F.lit("new "), "name")), "id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 1 THEN 'renamed' ELSE c_name END AS name FROM customer")
def update_rows(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    changes = c.where("id % 5 < 2").select("id", F.when(F.col("id") % 5 == 1, "renamed").otherwise("").alias("name"))
    return catalog.update(c, changes, "id", blank_keeps=True)


@query(f"""WITH {S['chunks']}, r AS (SELECT CASE WHEN ord % 5 = 1 THEN NULL ELSE chunk_id END AS chunk_id, CASE WHEN ord % 7 = 2 THEN '  ' ELSE text END AS text FROM chunks)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN chunk_id IS NULL THEN 'no chunk_id' WHEN trim(text) = '' THEN 'blank text' ELSE 'stored' END AS reason FROM r) GROUP BY reason""")
def chunk_validation(spark, d):
    c = _chunks(spark, d)
    raw = c.withColumns({"chunk_id": F.when(F.col("ord") % 5 != 1, F.col("chunk_id")), "text": F.when(F.col("ord") % 7 == 2, "  ").otherwise(F.col("text"))})
    good, bad = catalog.valid_chunks(raw)
    return good.select(F.lit("stored").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


# ---- text and pages
_PAGES = r"""pg AS (SELECT page_id, CASE WHEN regexp_matches(html, '<title>[^<]+</title>') THEN trim(replace(regexp_extract(html, '<title>([^<]+)</title>', 1), ' | 在鸿云文档', '')) ELSE '未知标题' END AS title,
 trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '(?s)<script[^>]*>.*?</script>', '', 'g'), '<[^>]+>', chr(10), 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\n+', chr(10), 'g'), ' +', ' ', 'g')) AS content FROM pages)"""


@query(f"WITH {_PAGES} SELECT * FROM pg")
def html_extract(spark, d):
    return _t(spark, d, "pages").select("page_id", tx.html_title(F.col("html")).alias("title"), tx.html_content(F.col("html")).alias("content"))


@query(f"""WITH {_PAGES}, s AS (SELECT page_id, title, left(content, 3000) AS content, (contains(lower(content), 'the')::INT + contains(lower(content), 'nation')::INT + contains(lower(content), 'la')::INT)::BIGINT AS score FROM pg)
SELECT * FROM s WHERE score > 0 ORDER BY score DESC, page_id LIMIT 3""")
def docs_search(spark, d):
    p = html_extract(spark, d)
    score = sum(F.lower("content").contains(w).cast("long") for w in ["the", "nation", "la"])
    return p.select("page_id", "title", F.substring("content", 1, 3000).alias("content"), score.alias("score")).where("score > 0").orderBy(F.desc("score"), "page_id").limit(3)


@query("SELECT p_partkey AS id, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(p_name), {w!r})' for w in ws)} THEN '{m}'" for m, ws in tx.MODULES.items()) + " END AS module FROM part")
def module_routing(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), tx.module_of(F.col("p_name")).alias("module"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= 6")
def recent_history(spark, d):
    return context.recent(_t(spark, d, "conversations")).select("conv_id", "turn", "role", "back")


# ---- layout
_PL = """pl AS (SELECT o_custkey AS doc_id, o_orderkey AS page, k AS line_no, text FROM (SELECT o_custkey, o_orderkey, 0 AS k, 'HEADER ' || (o_custkey % 10) AS text FROM orders UNION ALL SELECT o_custkey, o_orderkey, l_linenumber, 'item ' || min(l_partkey) FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3))"""


def _page_lines(spark, d):
    o, lines = _t(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page")), _t(spark, d, "lineitem")
    n = lines.count() + o.count()  # of the files' own counts
    head = o.select("doc_id", "page", F.lit(0).alias("line_no"), F.concat(F.lit("HEADER "), F.col("doc_id") % 10).alias("text"))
    body = rel.dealt(o, n, "page").join(rel.dealt(lines, n, "l_orderkey"), F.col("page") == F.col("l_orderkey")).groupBy("doc_id", "page", F.col("l_linenumber").alias("line_no")).agg(F.concat(F.lit("item "), F.min("l_partkey")).alias("text"))
    return rel.dealt(head.unionByName(body), n, "doc_id")


@query(f"""WITH {_PL}, f AS (SELECT doc_id, page, unnest([{{'place': 'first', 'text': arg_min(text, line_no)}}, {{'place': 'last', 'text': arg_max(text, line_no)}}]) AS e FROM pl GROUP BY 1, 2), t AS (SELECT doc_id, count(DISTINCT page) AS total FROM pl GROUP BY 1)
SELECT doc_id, e.text AS text, e.place AS place, count(*) AS pages FROM f JOIN t USING (doc_id) GROUP BY doc_id, e.text, e.place, total HAVING count(*) >= 0.7 * total""")
def header_footer(spark, d):
    return layout.running_lines(_page_lines(spark, d))


_CELLS = "ce AS (SELECT l_suppkey AS table_id, l_orderkey * 10 + l_linenumber AS row, c AS col, CASE WHEN c = 0 AND l_linenumber % 2 = 0 THEN l_returnflag WHEN c = 1 AND l_linenumber % 3 = 0 THEN l_linestatus WHEN c = 2 THEN l_quantity::INT::VARCHAR ELSE '' END AS value, l_partkey, l_extendedprice FROM lineitem, (VALUES (0), (1), (2)) v(c))"


def _cells(spark, d):
    x = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("table_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), "l_partkey", "l_extendedprice", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("col"))
    value = F.when((F.col("col") == 0) & (F.col("l_linenumber") % 2 == 0), F.col("l_returnflag")).when((F.col("col") == 1) & (F.col("l_linenumber") % 3 == 0), F.col("l_linestatus")).when(F.col("col") == 2, F.col("l_quantity").cast("int").cast("string")).otherwise("")
    return x.select("table_id", "row", "col", value.alias("value"))


@query(f"""WITH {_CELLS}, u AS (SELECT table_id, row, col, max(value) AS value FROM ce GROUP BY 1, 2, 3), k AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY table_id, row) AS n FROM u)),
f AS (SELECT table_id, row, col, coalesce(last_value(nullif(trim(value), '') IGNORE NULLS) OVER (PARTITION BY table_id, col ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS value FROM k)
SELECT table_id, row, col, coalesce(last_value(nullif(value, '') IGNORE NULLS) OVER (PARTITION BY table_id, row ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS value FROM f""")
def fill_cells(spark, d):
    cells = _cells(spark, d).groupBy("table_id", "row", "col").agg(F.max("value").alias("value"))
    return layout.fill_right(layout.fill_down(cells))


@query(f"""WITH {_CELLS}, u AS (SELECT table_id, row, col, max(value) AS value FROM ce GROUP BY 1, 2, 3)
SELECT table_id, row, CASE WHEN col < 2 THEN 'flags' ELSE 'quantity' END AS header, coalesce(string_agg(CASE WHEN trim(value) <> '' THEN value END, ' ' ORDER BY col), '') AS value FROM u GROUP BY 1, 2, 3""")
def merge_headers(spark, d):
    cells = _cells(spark, d).groupBy("table_id", "row", "col").agg(F.max("value").alias("value"))
    headers = cells.select("table_id", "col").distinct().withColumn("header", F.when(F.col("col") < 2, "flags").otherwise("quantity"))
    return layout.merge_headers(cells, headers)


@query("SELECT l_suppkey AS table_id, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1) // 50 AS part, count(*) AS n FROM lineitem GROUP BY ALL".replace("SELECT l_suppkey AS table_id, (row", "SELECT table_id, part, count(*) AS n FROM (SELECT l_suppkey AS table_id, (row").replace(" AS part, count(*) AS n FROM lineitem GROUP BY ALL", " AS part FROM lineitem) GROUP BY 1, 2"))
def table_split(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("table_id"), (F.row_number().over(w) - 1).alias("row"))
    return layout.split_rows(rows).groupBy("table_id", "part").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS table_id, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_quantity) AS x1, max(l_tax) AS y1 FROM lineitem GROUP BY 1 HAVING (max(l_quantity) - min(l_quantity)) * 1000 >= 10000")
def boxes(spark, d):
    b = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("table_id"), F.col("l_quantity").alias("x0"), F.col("l_discount").alias("y0"), F.col("l_quantity").alias("x1"), F.col("l_tax").alias("y1"))
    m = layout.merged_box(b, "table_id")
    return m.where(layout.large_enough(F.col("x0"), F.lit(0.0), F.col("x1"), F.lit(1000.0)))


@query("""WITH RECURSIVE w AS (SELECT l_suppkey AS doc_id, l_orderkey AS page, l_linenumber::DOUBLE AS top, l_quantity AS x, l_partkey::VARCHAR AS text FROM lineitem), tops AS (SELECT DISTINCT doc_id, page, top FROM w),
s AS (SELECT doc_id, page, min(top) AS top FROM w GROUP BY ALL UNION ALL SELECT n.doc_id, n.page, n.top FROM (SELECT t.doc_id, t.page, t.top, row_number() OVER (PARTITION BY t.doc_id, t.page ORDER BY t.top) AS k FROM s JOIN tops t ON t.doc_id = s.doc_id AND t.page = s.page AND t.top > s.top + 3) n WHERE k = 1)
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY top) AS line_no, top, text FROM (SELECT w.doc_id, w.page, s.top, string_agg(text, ' ' ORDER BY x, text) AS text FROM w JOIN s ON s.doc_id = w.doc_id AND s.page = w.page AND w.top BETWEEN s.top AND s.top + 3 GROUP BY ALL)""")
def words_to_lines(spark, d):
    w = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("top"), F.col("l_partkey").cast("string").alias("text"))
    return layout.words_to_lines(w)


from . import registry_answers, registry_docs, registry_more, registry_rest, registry_stores, registry_validation  # noqa: E402, F401  add their queries
