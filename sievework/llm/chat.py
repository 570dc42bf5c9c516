"""Chat formatting by multi-party perspective rotation (native DataFrame functions only).

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, the others as named
users and system turns as they are; only the assistant's words are to be learnt, which the mask and the spans say.

One row is one rendering. Only a dialogue of over ``PART_TURNS`` rows, which no task could hold, is given in parts of so many rows
each, in order; all parts are rendered for all of its speakers. Rows are numbered within their conversation by ranges of a global
order and the counts of the ranges before, so no task sees a whole conversation, however many of its turns are null or repeated.
Turns sort by number, ties by role and text. A null conv_id is a conversation of its own, a null turn sorts first, a null role
speaks as "unknown", a null text says nothing (an empty turn). Repeated rows are repeated turns. A conversation of system turns
alone has no participant and no rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import bounded_broadcast, materialize, table

PART_TURNS = 1024
SYSTEM = "system"


def _escaped(c: Column) -> Column:
    """Content can't hold a header: "<|" becomes "<\\|"."""
    return F.replace(c, F.lit("<|"), F.lit("<\\|"))


def _numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, no (rows of the conversation before this one), t (turn, role, text)."""
    df = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal rows are told apart by their place, so they too fall into several ranges
    ranged = df.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(n, "conv_id", "turn", "role", "text", "__place")
    ranged = materialize(ranged.withColumn("__range", F.spark_partition_id()).drop("__place"), "chat-ranged")
    counts = ranged.groupBy("conv_id", "__range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = materialize(counts.select(F.col("conv_id").alias("__c"), F.col("__range").alias("__r"), before.alias("__before")).where("__before > 0"), "chat-offsets")
    inside = F.row_number().over(Window.partitionBy("conv_id", "__range").orderBy("turn", "role", "text")) - 1
    rows = ranged.withColumn("__no", inside).join(bounded_broadcast(later), F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("__range") == F.col("__r")), "left")
    return rows.select("conv_id", (F.col("__no") + F.coalesce("__before", F.lit(0))).alias("no"), F.struct("turn", "role", "text").alias("t"))


def render(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, speaker, part, n_turns, text, mask (one 0 or 1 per turn), spans (array of start, end in characters of text)."""
    speaker = F.when(F.coalesce("role", F.lit("unknown")) != SYSTEM, F.coalesce("role", F.lit("unknown")))
    casts = conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.collect_set(speaker).alias("cast")).where(F.col("n") > part_turns)
    casts = bounded_broadcast(materialize(casts.select(F.col("conv_id").alias("__conv"), "cast"), "chat-casts"))
    turns = _numbered(conversations).withColumn("part", F.floor(F.col("no") / part_turns).cast("long"))
    parts = turns.groupBy("conv_id", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("no", "t"))), lambda x: x["t"]).alias("turns"))
    parts = parts.join(casts, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    here = F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda r: r != SYSTEM))
    parts = parts.select("conv_id", "part", "turns", F.explode(F.coalesce("cast", here)).alias("speaker"))

    def header(t: Column) -> Column:
        return F.when(t["role"] == F.col("speaker"), F.lit("<|assistant|>\n")).when(t["role"] == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user "), F.replace(_escaped(t["role"]), F.lit("\n"), F.lit(" ")), F.lit("|>\n")))

    said = F.transform("turns", lambda t: F.struct(header(t).alias("head"), _escaped(t["text"]).alias("body"), (t["role"] == F.col("speaker")).alias("own")))
    parts = parts.withColumn("said", said)

    def step(a: Column, s: Column) -> Column:
        start = a["at"] + F.length(s["head"])
        end = start + F.length(s["body"])
        spans = F.when(s["own"], F.concat(a["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(a["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return parts.select(
        "conv_id", "speaker", "part", F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("said", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "").alias("text"),
        F.array_join(F.transform("said", lambda s: F.when(s["own"], "1").otherwise("0")), "").alias("mask"),
        F.aggregate("said", zero, step, lambda a: a["spans"]).alias("spans"),
    )


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """render() over the whole table, its spans as text: start-end, joined by commas."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return render(table(spark, sf_dir, "conversations")).withColumn("spans", spans)


def oracle() -> str:
    return rf"""WITH t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, rid) - 1) // {PART_TURNS} AS part FROM
  (SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations)),
c AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> '{SYSTEM}'),
j AS (SELECT t.*, speaker, role = speaker AS own, CASE WHEN role = speaker THEN '<|assistant|>' || chr(10) WHEN role = '{SYSTEM}' THEN '<|system|>' || chr(10)
    ELSE '<|user ' || replace(replace(role, '<|', '<\|'), chr(10), ' ') || '|>' || chr(10) END AS head, replace(text, '<|', '<\|') AS body FROM t JOIN c ON c.conv_id IS NOT DISTINCT FROM t.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, role, text, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS s FROM j)
SELECT conv_id, speaker, part, count(*)::BIGINT AS n_turns, string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role, text, rid) AS text,
  string_agg(CASE WHEN own THEN '1' ELSE '0' END, '' ORDER BY turn NULLS FIRST, role, text, rid) AS mask,
  coalesce(string_agg(CASE WHEN own THEN s::BIGINT::VARCHAR || '-' || (s + length(body))::BIGINT::VARCHAR END, ',' ORDER BY turn NULLS FIRST, role, text, rid), '') AS spans
FROM o GROUP BY conv_id, speaker, part"""
