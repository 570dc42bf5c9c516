"""Page and table layout: running headers, page numbers, filled cells, merged headers, boxes and lines of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import page_number


def running_lines(lines: DataFrame, share: float = 0.7) -> DataFrame:
    """doc_id, text, place (first or last), pages: lines that are first or last on at least share of a document's pages (doc_id, page, line_no, text)."""
    edge = lines.groupBy("doc_id", "page").agg(F.min_by("text", "line_no").alias("first"), F.max_by("text", "line_no").alias("last"))
    total = edge.groupBy("doc_id").agg(F.count("*").alias("total"))
    seen = edge.select("doc_id", F.explode(F.array(F.struct(F.lit("first").alias("place"), F.col("first").alias("text")), F.struct(F.lit("last").alias("place"), F.col("last").alias("text")))).alias("e"))
    n = seen.groupBy("doc_id", F.col("e.text").alias("text"), F.col("e.place").alias("place")).agg(F.count("*").alias("pages"))
    return n.join(total, "doc_id").where(F.col("pages") >= share * F.col("total")).select("doc_id", "text", "place", "pages")


def without_running_lines(lines: DataFrame, share: float = 0.7) -> DataFrame:
    return lines.join(running_lines(lines, share).select("doc_id", "text").distinct(), ["doc_id", "text"], "left_anti")


def numbered_share(lines: DataFrame) -> DataFrame:
    """doc_id, share: of the pages whose first line is a page number."""
    first = lines.groupBy("doc_id", "page").agg(F.min_by("text", "line_no").alias("t"))
    return first.groupBy("doc_id").agg(F.avg(page_number(F.col("t")).isNotNull().cast("double")).alias("share"))


def frame_lines(lines: DataFrame, edge: int = 3, share: float = 0.8, zone: float = 0.1) -> DataFrame:
    """lines (doc_id, page, line_no, top, height, text) without running heads and feet.

    Those lie in the upper or lower zone of their page and are among the first or last ``edge`` lines on so large a share of the
    document's pages.
    """
    w = Window.partitionBy("doc_id", "page")
    df = lines.withColumns({"__a": F.row_number().over(w.orderBy("line_no")), "__b": F.row_number().over(w.orderBy(F.desc("line_no")))})
    # windows alone, so that lines dealt by doc_id stay where they are; each page has one first line
    seen = lambda c: F.count_if(F.col(c) <= edge).over(Window.partitionBy("doc_id", "text"))
    df = df.withColumns({"__up": seen("__a"), "__down": seen("__b"), "__pages": F.count_if(F.col("__a") == 1).over(Window.partitionBy("doc_id"))})
    head = (F.col("top") <= zone * F.col("height")) & (F.col("__up") >= share * F.col("__pages"))
    foot = (F.col("top") > zone * F.col("height")) & (F.col("top") >= (1 - zone) * F.col("height")) & (F.col("__down") >= share * F.col("__pages"))
    return df.where(~(head | foot)).select(*lines.columns)


def without_page_numbers(lines: DataFrame, share: float = 0.7) -> DataFrame:
    """lines (doc_id, page, line_no, text) without page numbers: first lines if so large a share of pages begins with one, else last lines likewise."""
    w = Window.partitionBy("doc_id", "page")
    df = lines.withColumns({"__n": page_number(F.col("text")).isNotNull(), "__first": F.col("line_no") == F.min("line_no").over(w), "__last": F.col("line_no") == F.max("line_no").over(w)})
    part = lambda c: F.count_if(F.col(c) & F.col("__n")) / F.count_if(F.col(c))
    shares = df.groupBy("doc_id").agg((part("__first") >= share).alias("__up"), (part("__last") >= share).alias("__down"))
    gone = F.col("__n") & ((F.col("__up") & F.col("__first")) | (~F.col("__up") & F.col("__down") & F.col("__last")))
    return df.join(shares, "doc_id").where(~gone).select(*lines.columns)


def fill_down(cells: DataFrame) -> DataFrame:
    """cells (table_id, row, col, value) with blank values from the last one above."""
    w = Window.partitionBy("table_id", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("value", F.coalesce(F.last(F.nullif(F.trim("value"), F.lit("")), ignorenulls=True).over(w), F.lit("")))


def fill_right(cells: DataFrame) -> DataFrame:
    """cells with blank values from the last one on the left."""
    w = Window.partitionBy("table_id", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("value", F.coalesce(F.last(F.nullif(F.col("value"), F.lit("")), ignorenulls=True).over(w), F.lit("")))


def merge_headers(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """table_id, row, header, value: columns of equal header (table_id, col, header) joined by a space, blanks left out."""
    df = cells.join(headers.where("header <> ''"), ["table_id", "col"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.trim("value") != "", F.struct("col", "value")))), lambda x: x["value"]), " ")
    return df.groupBy("table_id", "row", "header").agg(text.alias("value"))


def flat_headers(cells: DataFrame, header_rows: int) -> DataFrame:
    """table_id, col, header: the values of the header rows from top to bottom, joined by dots, blanks and repeats of the one above left out."""
    df = cells.where(F.col("row") < header_rows)
    up = F.array_sort(F.collect_list(F.when(F.trim("value") != "", F.struct("row", F.trim("value").alias("v")))))
    values = F.transform(up, lambda x: x["v"])
    kept = F.aggregate(values, F.array().cast("array<string>"), lambda a, v: F.when(F.try_element_at(a, F.lit(-1)).eqNullSafe(v), a).otherwise(F.concat(a, F.array(v))))
    return df.groupBy("table_id", "col").agg(up.alias("__up"), kept.alias("k")).select("table_id", "col", F.array_join("k", ".").alias("header"))


def split_rows(rows: DataFrame, size: int = 50) -> DataFrame:
    """rows (table_id, row, ...) plus part: parts of size rows."""
    return rows.withColumn("part", F.floor(F.col("row") / size).cast("long"))


def merged_box(boxes: DataFrame, by: str) -> DataFrame:
    return boxes.groupBy(by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def large_enough(x0: Column, y0: Column, x1: Column, y1: Column, least: float = 10_000) -> Column:
    """A box of at least an area; a missing box passes."""
    area = (x1 - x0) * (y1 - y0)
    return area.isNull() | (area >= least)


def words_to_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """doc_id, page, line_no, top, text: words (doc_id, page, x, top, text) put into the first line whose top is within tolerance.

    First fit depends on the order of words, so a page, bounded by its size, is folded as one array.
    """
    pages = words.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("top", "x", "text"))).alias("words"))
    empty = F.array().cast("array<struct<top:double,words:array<struct<x:double,text:string>>>>")

    def place(lines: Column, w: Column) -> Column:
        word = F.array(F.struct(w["x"].alias("x"), w["text"].alias("text")))
        at = F.array_position(F.transform(lines, lambda line: F.abs(line["top"] - w["top"]) <= tolerance), True)
        grown = F.transform(lines, lambda line, i: F.struct(line["top"].alias("top"), F.when(i + 1 == at, F.concat(line["words"], word)).otherwise(line["words"]).alias("words")))
        return F.when(at > 0, grown).otherwise(F.concat(lines, F.array(F.struct(w["top"].alias("top"), word.alias("words")))))

    folded = pages.select("doc_id", "page", F.posexplode(F.array_sort(F.aggregate("words", empty, place))).alias("i", "line"))
    text = F.array_join(F.transform(F.array_sort("line.words"), lambda w: w["text"]), " ")
    return folded.select("doc_id", "page", (F.col("i") + 1).cast("long").alias("line_no"), "line.top", text.alias("text"))
