"""The engine's relations from the tables of a folder, each with an explicit shape.

files, knowledge_bases, chunks, vectors, questions, history, entities and relations are views of the star-schema and corpus
tables; a deployment with its own catalog passes its own DataFrames to the operators instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: White space that a blank line may consist of.
BLANK = r"[ \t\r\f\x0B]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a partition of dealt().
PART_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df of about so many rows dealt by keys into partitions whose size does not grow with it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(10_000, max(least, -(-rows // PART_ROWS))), *keys)


def chunks(documents: DataFrame) -> DataFrame:
    """doc_id, kb_id, ord (from 1), chunk_id, text, length: the non-blank lines of each document; no shuffle."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(rf"[^ \t\r\f\x0B]"))
    rows = documents.select("doc_id", F.col("source").alias("kb_id"), F.posexplode(lines).alias("pos", "text"))
    number = (F.col("pos") + 1).cast("long")
    return rows.select("doc_id", "kb_id", number.alias("ord"), F.concat_ws("_", "doc_id", number).alias("chunk_id"), "text", F.length("text").cast("long").alias("length"))


def files(documents: DataFrame) -> DataFrame:
    """id, name, kb_id, size, upload_time: one per document."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + 60 * F.col("doc_id"))
    name = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("file_"), "doc_id", F.lit(".pdf"))).otherwise("")
    return documents.select(F.col("doc_id").alias("id"), name.alias("name"), F.col("source").alias("kb_id"), F.col("n_chars").alias("size"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("upload_time"))


def knowledge_bases(documents: DataFrame) -> DataFrame:
    """id, name: the sources."""
    return documents.select(F.col("source").alias("id"), F.concat(F.lit("KB "), "source").alias("name")).distinct()


def vectors(embeddings: DataFrame, documents: DataFrame) -> DataFrame:
    """chunk_id, doc_id, kb_id, embedding; a vector without a document has a null kb_id."""
    v = embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return v.join(documents.select("doc_id", F.col("source").alias("kb_id")), "doc_id", "left").select("chunk_id", "doc_id", "kb_id", "embedding")


def history(conversations: DataFrame) -> DataFrame:
    """id, kb_id, query, timestamp: the user turns."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + 60 * F.col("conv_id") + F.col("turn"))
    return conversations.where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("src"), F.col("conv_id") % 20).alias("kb_id"), F.col("text").alias("query"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("timestamp"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, type, text, chunk_id: graph nodes from regions, nations, suppliers, customers and parts."""
    node = lambda name, tag, key, text: table(spark, sf_dir, name).select(F.concat(F.lit(tag), F.col(key)).alias("entity_id"), F.lit(name).alias("type"), F.col(text).alias("text"), (F.col(key) % 97).cast("long").alias("chunk_id"))
    out = node("region", "R", "r_regionkey", "r_name")
    for args in (("nation", "N", "n_nationkey", "n_name"), ("supplier", "S", "s_suppkey", "s_name"), ("customer", "C", "c_custkey", "c_name"), ("part", "P", "p_partkey", "p_name")):
        out = out.unionByName(node(*args))
    return out


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relation_id, source_id, target_id, relation_type: graph edges from foreign keys and distinct (supplier, part) pairs."""

    def edge(df: DataFrame, kind: str, a: str, b: str) -> DataFrame:
        return df.select(F.concat_ws("-", F.col(a), F.col(b)).alias("relation_id"), F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit(kind).alias("relation_type"))

    def keyed(name: str, **ids: tuple[str, str]) -> DataFrame:
        return table(spark, sf_dir, name).select(*[F.concat(F.lit(tag), F.col(key)).alias(out) for out, (tag, key) in ids.items()])

    part_of = edge(keyed("nation", a=("N", "n_nationkey"), b=("R", "n_regionkey")), "PART_OF", "a", "b")
    supplier = edge(keyed("supplier", a=("S", "s_suppkey"), b=("N", "s_nationkey")), "LOCATED_IN", "a", "b")
    customer = edge(keyed("customer", a=("C", "c_custkey"), b=("N", "c_nationkey")), "LOCATED_IN", "a", "b")
    supplies = edge(keyed("lineitem", a=("S", "l_suppkey"), b=("P", "l_partkey")).distinct(), "SUPPLIES", "a", "b")
    return part_of.unionByName(supplier).unionByName(customer).unionByName(supplies)


#: The same relations as common table expressions of another engine, for checking.
SQL = {
    "chunks": r"""chunks AS (SELECT doc_id, source AS kb_id, i AS ord, doc_id || '_' || i AS chunk_id, l[i] AS text, length(l[i])::BIGINT AS length
  FROM (SELECT doc_id, source, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\r\f\x0B]')) AS l FROM documents), unnest(range(1, len(l) + 1)) u(i))""",
    "files": """files AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 <> 0 THEN 'file_' || doc_id || '.pdf' ELSE '' END AS name, source AS kb_id, n_chars AS size,
  strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%d %H:%M:%S') AS upload_time FROM documents)""",
    "vectors": "vectors AS (SELECT vec_id AS chunk_id, vec_id AS doc_id, source AS kb_id, embedding::DOUBLE[] AS embedding FROM embeddings LEFT JOIN documents ON doc_id = vec_id)",
    "history": """history AS (SELECT conv_id || '-' || turn AS id, 'src' || (conv_id % 20) AS kb_id, text AS query,
  strftime(TIMESTAMP '2024-01-01' + to_minutes(conv_id) + to_seconds(turn), '%Y-%m-%d %H:%M:%S') AS timestamp FROM conversations WHERE role = 'user')""",
    "entities": """entities AS (SELECT 'R' || r_regionkey AS entity_id, 'region' AS type, r_name AS text, (r_regionkey % 97)::BIGINT AS chunk_id FROM region UNION ALL SELECT 'N' || n_nationkey, 'nation', n_name, n_nationkey % 97 FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'supplier', s_name, s_suppkey % 97 FROM supplier UNION ALL SELECT 'C' || c_custkey, 'customer', c_name, c_custkey % 97 FROM customer UNION ALL SELECT 'P' || p_partkey, 'part', p_name, p_partkey % 97 FROM part)""",
    "relations": """relations AS (SELECT a || '-' || b AS relation_id, a AS source_id, b AS target_id, k AS relation_type FROM (SELECT 'N' || n_nationkey AS a, 'R' || n_regionkey AS b, 'PART_OF' AS k FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'LOCATED_IN' FROM supplier UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'LOCATED_IN' FROM customer
  UNION ALL SELECT DISTINCT 'S' || l_suppkey, 'P' || l_partkey, 'SUPPLIES' FROM lineitem))""",
}
