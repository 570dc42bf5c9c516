"""Chunk optimisation by given fragments and ids: neighbours, groups, split places, pieces and their source chunks; topic windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import tokens


def with_neighbors(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """chunks (doc_id, ord, ...) that are wanted (doc_id, ord) or next to one."""
    near = wanted.select("doc_id", F.explode(F.array(F.col("ord") - 1, F.col("ord"), F.col("ord") + 1)).alias("ord")).distinct()
    return chunks.join(near, ["doc_id", "ord"], "left_semi")


def consecutive(chunks: DataFrame) -> DataFrame:
    """chunks plus run: the first ord of the run of consecutive ords."""
    island = F.col("ord") - F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    return chunks.withColumn("__i", island).withColumn("run", F.min("ord").over(Window.partitionBy("doc_id", "__i"))).drop("__i")


def split_places(text: Column, fragments: Column) -> Column:
    """Sorted distinct places (0-based, above 0) of fragments in a text; a fragment that isn't found is looked up by its first half."""
    find = lambda f: F.call_function("instr", text, f) - 1
    place = lambda f: F.when(find(f) >= 0, find(f)).otherwise(find(F.substr(f, F.lit(1), F.floor(F.length(f) / 2).cast("int"))))
    return F.array_sort(F.array_distinct(F.filter(F.transform(fragments, place), lambda p: p > 0)))


def pieces(text: Column, places: Column) -> Column:
    """Pieces (start, end, text) of a text cut at places."""
    starts = F.concat(F.array(F.lit(0)), places)
    cut = F.transform(starts, lambda s, i: F.struct(s.cast("int").alias("start"), F.coalesce(F.get(places, i), F.length(text)).cast("int").alias("end")))
    return F.filter(F.transform(cut, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.substr(text, c["start"] + 1, c["end"] - c["start"]).alias("text"))), lambda c: c["end"] > c["start"])


def optimized(chunks: DataFrame, merges: DataFrame, fragments: DataFrame) -> DataFrame:
    """doc_id, ord (anew from 1), text, first_ord, last_ord: chunks (doc_id, ord, text) joined and cut as a model or a person says.

    Chunks of merges (doc_id, ord) that follow each other become one text without a separator; a text is then cut where the
    fragments (doc_id, ord, fragments array) of its chunks begin. A fragment that is not in the text cuts nothing.
    """
    runs = consecutive(merges.select("doc_id", "ord").distinct())
    df = chunks.select("doc_id", "ord", "text").join(runs, ["doc_id", "ord"], "left").join(fragments.select("doc_id", "ord", "fragments"), ["doc_id", "ord"], "left")
    whole = df.groupBy("doc_id", F.coalesce("run", "ord").alias("first_ord")).agg(F.max("ord").alias("last_ord"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("r"), F.flatten(F.collect_list("fragments")).alias("f"))
    whole = whole.withColumn("whole", F.array_join(F.transform("r", lambda x: x["text"]), ""))
    cut = whole.select("doc_id", "first_ord", "last_ord", F.posexplode(pieces(F.col("whole"), split_places(F.col("whole"), F.col("f")))).alias("i", "p"))
    return cut.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_ord", "i")).cast("long").alias("ord"), F.col("p.text").alias("text"), "first_ord", "last_ord")


def sources_of(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """spans (doc_id, start, end) with the chunks (doc_id, ord, c_start, c_end) that they overlap."""
    return spans.join(chunks, "doc_id").where((F.col("start") < F.col("c_end")) & (F.col("end") > F.col("c_start")))


def enrich(hits: DataFrame, related: DataFrame) -> DataFrame:
    """hits (query_id, chunk_id, ...) with has_graph, related_entities and graph_score, with defaults where related (query_id, chunk_id, related_entities, graph_score) has none."""
    df = hits.join(related, ["query_id", "chunk_id"], "left")
    return df.withColumns({"has_graph": F.col("graph_score").isNotNull(), "related_entities": F.coalesce("related_entities", F.array().cast("array<string>")), "graph_score": F.coalesce("graph_score", F.lit(0.0))})


def entity_context(related: DataFrame, longest: int = 200) -> DataFrame:
    """query_id, context from (query_id, place, type, text, neighbors array in order): five entities, three neighbours each."""
    df = related.where((F.col("place") <= 5) & (F.size("neighbors") > 0))
    part = F.concat(F.lit("["), "type", F.lit("] "), "text", F.lit(": 相关实体包括 "), F.array_join(F.slice("neighbors", 1, 3), ", "))
    out = df.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("p")))), lambda x: x["p"]), " | ").alias("c"))
    return out.select("query_id", F.when(F.length("c") > longest, F.concat(F.substring("c", 1, longest), F.lit("..."))).otherwise(F.col("c")).alias("context"))


def topic_windows(text: Column, above: int = 800) -> Column:
    """Windows of 150, 175 or 200 words, half overlapping, of a text of more than ``above`` words; a last one under 0.6 of the size joins the one before. Else null."""

    def cut(t: Column) -> Column:
        n = F.size(t)
        size = F.when(n < 1200, 150).when(n < 1600, 175).otherwise(200)
        step = F.floor(size / 2).cast("int")
        count = F.ceil((n - size) / step).cast("int") + 1
        windows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(t, i * step + 1, size), " "))
        short = (n - (count - 1) * step) < 0.6 * size
        return F.when(n > above, once(windows, lambda w: F.when(short & (count >= 2), last_two_joined(w)).otherwise(w)))

    def last_two_joined(w: Column) -> Column:
        k = F.size(w)
        return F.concat(F.slice(w, F.lit(1), k - 2), F.array(F.concat_ws("\n", F.get(w, k - 2), F.get(w, k - 1))))

    # words and windows are made once a text, not at each place they are used
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    return once(tokens(text, lower=False), cut)
