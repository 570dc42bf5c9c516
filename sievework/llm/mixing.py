"""Mixing sources to target weights (native DataFrame functions only).

Documents get hash-random keys. Within each source the key space is cut into 4096 ranges; each range is sorted, its token
counts are summed up, and the sums of the ranges before it are added: a prefix sum over the source in key order without
any task seeing the whole source. A source's target is then met exactly: whole epochs for all of its documents, then one
more of each document in key order until the budget is used up; the document on the edge gives the words still wanted.

Null text has size 0; null source is a source of its own and sorts last; rows with equal keys (the same doc_id and text) sort by
a hash of their other columns; rows that are equal in all columns share the edge in any order, which gives the same rows; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .common import SPACES, WORD, bounded_broadcast, materialize, table

SEED = "mix-1"
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Hex digits of a key that name its range.
RANGE_DIGITS = 3


def key(seed: str = SEED) -> Column:
    """128 hash-random bits in hex from doc_id and text."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat_ws("|", F.lit(seed), part("doc_id"), F.md5(part("text"))))


def size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to __skey, source_size, target: shares of the total by weight, none above max_epochs times its source.

    With sources sorted by cap / weight those at their cap are a prefix, found by two running sums.
    """
    cap = max_epochs * F.col("source_size")
    table_of_weights = F.array(*[F.lit(w) for w in weights])
    df = sizes.withColumn("__skey", skey()).withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    df = df.withColumn("w", F.get(table_of_weights, (F.col("no") - 1) % len(weights)).cast("long")).withColumn("ratio", cap.cast("double") / F.col("w"))
    every = Window.partitionBy()
    up = Window.orderBy("ratio", "no")
    df = df.withColumns({"total": F.sum("source_size").over(every), "w_from": F.sum("w").over(every) - F.sum("w").over(up) + F.col("w"), "cap_before": F.sum(cap).over(up) - cap})
    df = df.withColumn("capped", (F.col("total") - F.col("cap_before")).cast("double") * F.col("w") >= cap.cast("double") * F.col("w_from"))
    left = F.col("total") - F.sum(F.when(F.col("capped"), cap).otherwise(0)).over(every)
    open_w = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(every)
    return df.select("__skey", "source_size", F.when(F.col("capped"), cap.cast("double")).otherwise((F.col("w") * left).cast("double") / open_w).alias("target"))


def skey() -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def take(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """sized (__skey, __key, __size and more) plus source_size, target and __taken."""
    ranged = sized.withColumn("__range", F.substring("__key", 1, RANGE_DIGITS))
    inside = Window.partitionBy("__skey", "__range").orderBy("__key", *[c for c in sized.columns if c == "__tie"]).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__skey", "__range").agg(F.sum("__size").alias("sum"))
    earlier = Window.partitionBy("__skey").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.join(goals, "__skey").select("__skey", "__range", "source_size", "target", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("__offset"))
    df = ranged.withColumn("__before", F.coalesce(F.sum("__size").over(inside), F.lit(0))).join(sums, ["__skey", "__range"])
    goal = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    more = goal - epochs * F.col("source_size") - F.col("__offset") - F.col("__before")
    return df.withColumn("__taken", epochs * F.col("__size") + F.greatest(F.lit(0), F.least(F.col("__size"), more)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sized = materialize(docs.select("doc_id", skey().alias("__skey"), "source", size().alias("__size"), key(seed).alias("__key")), "mix-sizes")
    goals = materialize(targets(sized.groupBy("source").agg(F.sum("__size").alias("source_size")), weights), "mix-targets")
    return take(sized.drop("source"), bounded_broadcast(goals)).select("doc_id", F.col("__size").alias("size"), "source_size", "target", F.col("__taken").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, the one on its source's edge cut after its last wanted word.

    docs' own columns; a cut text also gets its own n_chars where docs has that column. Texts are shuffled once.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    slim = docs.select("source", size().alias("__size"))
    goals = materialize(targets(slim.groupBy("source").agg(F.sum("__size").alias("source_size")), weights), "mix-targets")
    tie = F.xxhash64(*[F.to_json(F.struct(c)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else c for c, f in zip(cols, docs.schema.fields, strict=True)])
    sized = docs.select(F.struct(*cols).alias("__row"), tie.alias("__tie"), skey().alias("__skey"), size().alias("__size"), key(seed).alias("__key"))
    df = take(sized, bounded_broadcast(goals)).where("__taken > 0").select("__row", "__size", "__taken")
    whole = (F.col("__taken") / F.col("__size")).cast("long")
    rest = F.col("__taken") - whole * F.col("__size")
    df = df.withColumn("__want", F.explode(F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))))
    pieces = F.regexp_extract_all(F.col("__row.text"), F.lit(rf"{SPACES[:-1]}*{WORD}"), F.lit(0))
    text = F.when(F.col("__want") < 0, F.col("__row.text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("__want").cast("int")), ""))
    df = df.withColumn("__text", text)
    new = {"text": F.col("__text")} | ({"n_chars": F.when(F.col("__want") < 0, F.col("__row.n_chars")).otherwise(F.length("__text").cast("long"))} if "n_chars" in docs.columns else {})
    return df.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def oracle() -> str:
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    return rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {weights} END AS w FROM d GROUP BY source),
r AS (SELECT *, {MAX_EPOCHS} * source_size AS cap, sum(source_size) OVER () AS total, {MAX_EPOCHS}.0 * source_size / w AS ratio FROM s),
c AS (SELECT *, sum(w) OVER (ORDER BY ratio DESC, source DESC NULLS FIRST) AS w_from, sum(cap) OVER (ORDER BY ratio, source NULLS LAST) - cap AS cap_before FROM r),
f AS (SELECT *, (total - cap_before)::DOUBLE * w >= cap::DOUBLE * w_from AS capped FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (w * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()))::DOUBLE / (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::DOUBLE END AS target FROM f),
p AS (SELECT d.*, source_size, target, floor(target)::BIGINT AS goal, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, goal - epochs * source_size - before)))::BIGINT AS taken FROM e"""
