"""Queries of the topic and structure rules on the given texts, with a hook that SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models
from ..operators import quality
from ..sources import relations as rel
from . import pipelines
from .registry import _QM, S, _chunks, _t, query

#: The letter counts of a text, and the cosine of two such lists (0 for a text without letters).
LETTERS = "list_transform(range(97, 123), lambda c: (length(lower({0})) - length(replace(lower({0}), chr(c::INT), '')))::DOUBLE)"
COSINE = "CASE WHEN list_sum({0}) > 0 AND list_sum({1}) > 0 THEN list_cosine_similarity({0}, {1}) ELSE 0 END"

# each run of two or more neighbouring chunks under 150 tokens; the greater cosine with the chunks on both sides of each member
_RUNS = rf"""tn AS MATERIALIZED (SELECT doc_id, ord, text, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS n FROM chunks),
ri AS (SELECT doc_id, ord, ord - row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM tn WHERE n < 150),
rm AS (SELECT doc_id, ord FROM ri QUALIFY count(*) OVER (PARTITION BY doc_id, island) >= 2),
lv AS MATERIALIZED (SELECT doc_id, ord, {LETTERS.format("text")} AS v FROM tn),
ps AS MATERIALIZED (SELECT a.doc_id, a.ord, {COSINE.format("a.v", "b.v")} AS s FROM lv a JOIN lv b ON b.doc_id = a.doc_id AND b.ord = a.ord + 1),
ns AS (SELECT doc_id, ord, max(s) AS s FROM (SELECT doc_id, ord, s FROM ps UNION ALL SELECT doc_id, ord + 1, s FROM ps) JOIN rm USING (doc_id, ord) GROUP BY doc_id, ord)"""

# windows of chunks over 800 tokens, half overlapping, a short last one joined with the one before; the least cosine of neighbours
_WINDOWS = rf"""wt AS (SELECT doc_id, ord, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS t FROM tn WHERE n > 800),
wz AS (SELECT *, len(t) AS m, CASE WHEN len(t) < 1200 THEN 150 WHEN len(t) < 1600 THEN 175 ELSE 200 END AS z FROM wt),
wc AS (SELECT *, z // 2 AS h, ceil((m - z) / (z // 2))::BIGINT + 1 AS k FROM wz),
ww AS (SELECT *, list_transform(range(0, k), lambda i: array_to_string(t[i * h + 1 : i * h + z], ' ')) AS w, m - (k - 1) * h < 0.6 * z AS short FROM wc),
wl AS (SELECT doc_id, ord, CASE WHEN short THEN list_append(w[1 : k - 2], w[k - 1] || chr(10) || w[k]) ELSE w END AS w FROM ww),
wv AS (SELECT doc_id, ord, i, {LETTERS.format("p")} AS v FROM (SELECT doc_id, ord, unnest(w) AS p, generate_subscripts(w, 1) AS i FROM wl)),
wn AS (SELECT doc_id, ord, v, lead(v) OVER (PARTITION BY doc_id, ord ORDER BY i) AS b FROM wv),
ls AS (SELECT doc_id, ord, min({COSINE.format("v", "b")}) AS s FROM wn WHERE b IS NOT NULL GROUP BY doc_id, ord)"""

_MERGE = "CASE WHEN {0} > 0.93 THEN 60 WHEN {0} > 0.85 THEN 40 WHEN {0} > 0.75 THEN 15 ELSE 0 END"
_SPLIT = "CASE WHEN {0} < 0.5 THEN 60 WHEN {0} < 0.65 THEN 35 WHEN {0} < 0.75 THEN 20 ELSE 0 END"

#: Six places of a double, half-way ones up: of its shortest decimal form, as round() of a double first multiplies and may miss them.
SIX = "round({0}::VARCHAR::DECIMAL(38, 20), 6)::DOUBLE"


@query(f"WITH {S['chunks']}, {_RUNS} SELECT doc_id, ord, {SIX.format('s')} AS neighbor_similarity, {_MERGE.format('s')}::BIGINT AS merge_topic_risk, s > 0.93 AS topic_hard FROM ns")
def short_run_topics(spark, d):
    """Chunks of short runs with the greater cosine with either neighbour, and its risk."""
    df = quality.neighbor_similarity(quality.measured(_chunks(spark, d).select("doc_id", "ord", "text")), models.letter_counts)
    judged = quality.topic_rules(df.withColumn("least_similarity", F.lit(None).cast("double"))).where("neighbor_similarity is not null")
    return judged.select("doc_id", "ord", F.round("neighbor_similarity", 6).alias("neighbor_similarity"), "merge_topic_risk", "topic_hard")


@query(f"WITH {S['chunks']}, {_RUNS}, {_WINDOWS} SELECT doc_id, ord, round(s, 6) AS least_similarity, {_SPLIT.format('s')}::BIGINT AS split_topic_risk, s < 0.5 AS topic_hard FROM ls")
def long_chunk_topics(spark, d):
    """Chunks of over 800 tokens with the least cosine of windows next to each other, and its risk."""
    df = quality.window_similarity(quality.measured(_chunks(spark, d).select("doc_id", "ord", "text")), models.letter_counts)
    judged = quality.topic_rules(df.withColumn("neighbor_similarity", F.lit(None).cast("double"))).where("least_similarity is not null")
    return judged.select("doc_id", "ord", F.round("least_similarity", 6).alias("least_similarity"), "split_topic_risk", "topic_hard")


#: Patterns of two title levels, for paths of a document's language and a line's first characters.
PATTERNS = ["^(en|de|fr)$", "^[A-Z]"]


@query(f"""WITH {S['chunks']}, {_QM}, {_RUNS}, {_WINDOWS},
st AS (SELECT chunks.doc_id, ord, NOT (regexp_matches(coalesce(lang, ''), '{PATTERNS[0]}') AND regexp_matches(substring(chunks.text, 1, 8), '{PATTERNS[1]}')) AS broken FROM chunks JOIN documents USING (doc_id)),
al AS (SELECT qa.doc_id, qa.ord, {SIX.format('ns.s')} AS neighbor_similarity, {SIX.format('ls.s')} AS least_similarity, broken AS breaks_structure, hard OR coalesce(ns.s > 0.93, false) OR coalesce(ls.s < 0.5, false) AS hard,
  coalesce(mode = 'merge', false) OR coalesce({_MERGE.format('ns.s')}, 0) > 0 AS merges, (total_risk + CASE WHEN broken THEN 20 ELSE 0 END + coalesce({_MERGE.format('ns.s')}, 0) + coalesce({_SPLIT.format('ls.s')}, 0))::BIGINT AS total_risk
  FROM qa JOIN st USING (doc_id, ord) LEFT JOIN ns USING (doc_id, ord) LEFT JOIN ls USING (doc_id, ord))
SELECT doc_id, ord, neighbor_similarity, least_similarity, breaks_structure, hard, CASE WHEN merges THEN 'merge' WHEN total_risk > 0 THEN 'split' END AS mode, total_risk FROM al""")  # fmt: skip
def validated_chunks(spark, d):
    """Every rule together on the lines of all documents."""
    docs = _t(spark, d, "documents")
    paths = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    rows = rel.chunks(docs).join(paths, "doc_id").select("doc_id", "ord", "text", F.array("lang", F.substring("text", 1, 8)).alias("path"))
    out = pipelines.judged(rows, models.Hooks(embed=models.letter_counts), PATTERNS)
    rounded = [F.round(c, 6).alias(c) for c in ("neighbor_similarity", "least_similarity")]
    return out.select("doc_id", "ord", *rounded, "breaks_structure", "hard", "mode", "total_risk")
