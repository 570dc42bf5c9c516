"""Document files as lines: Word files by their XML, other formats from words or lines that a reader has extracted."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
LINES = "path string, line_no long, text string, page int, style string"


def word_lines(content: bytes) -> list[tuple[str, str]]:
    """(text, style) of a Word file's non-blank paragraphs outside tables, then its table rows as "a | b" without blank cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join("\n" if x.tag in (f"{_W}br", f"{_W}cr") else "\t" if x.tag == f"{_W}tab" else x.text or "" for x in e.iter() if x.tag in (f"{_W}t", f"{_W}br", f"{_W}cr", f"{_W}tab"))
    out = []
    for p in body.findall(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        if t := text(p).strip():
            out.append((t, style.get(f"{_W}val", "") if style is not None else ""))
    for row in body.iterfind(f"{_W}tbl/{_W}tr"):
        cells = [t for c in row.findall(f"{_W}tc") if (t := "\n".join(text(p) for p in c.findall(f"{_W}p")).strip())]
        if cells:
            out.append((" | ".join(cells), "Table"))
    return out


def read_word(spark: SparkSession, folder: str) -> DataFrame:
    """path, line_no, text, page (1), style of the Word files under a folder; a file that can't be read gives no lines."""

    def parse(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, i, t, 1, s) for i, (t, s) in enumerate(word_lines(bytes(content)), 1)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "line_no", "text", "page", "style"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(folder)
    return files.select("path", "content").mapInPandas(parse, LINES)


def outside_boxes(lines: DataFrame, boxes: DataFrame, slack: float = 1.0) -> DataFrame:
    """lines (doc_id, page, top, ...) that lie in no box (doc_id, page, y0, y1) of their page."""
    b = boxes.select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), "y0", "y1")
    inside = (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__p")) & (F.col("top") >= F.col("y0") - slack) & (F.col("top") <= F.col("y1") + slack)
    return lines.join(b, inside, "left_anti")


def page_number_lines(lines: DataFrame) -> DataFrame:
    """doc_id, line_no of the lines (doc_id, page, line_no, top, num, format) that are a document's page numbers.

    The first whose number is its page's fixes format and place; each further one has both and the number after the last.
    The candidates of one document, a few a page, are folded in order.
    """
    items = F.array_sort(F.collect_list(F.struct("page", "line_no", F.round("top", 0).alias("at"), "num", "format")))
    start = F.struct(F.lit(None).cast("int").alias("num"), F.lit(None).cast("double").alias("at"), F.lit(None).cast("string").alias("format"), F.array().cast("array<bigint>").alias("lines"))

    def step(a, x):
        first = a["num"].isNull() & (x["num"] == x["page"])
        more = (x["num"] == a["num"] + 1) & (x["at"] == a["at"]) & (x["format"] == a["format"])
        taken = F.struct(x["num"].cast("int").alias("num"), x["at"].cast("double").alias("at"), x["format"].alias("format"), F.concat(a["lines"], F.array(x["line_no"].cast("long"))).alias("lines"))
        return F.when(first | F.coalesce(more, F.lit(False)), taken).otherwise(a)

    return lines.where("num is not null").groupBy("doc_id").agg(items.alias("x")).select("doc_id", F.explode(F.aggregate("x", start, step, lambda a: a["lines"])).alias("line_no"))


def without_frame(elements: DataFrame, edge: int = 2) -> DataFrame:
    """elements (doc_id, line_no, type, text) without the texts among a document's first and last two and those that look like page marks.

    Documents of fewer than three elements stay as they are.
    """
    w = Window.partitionBy("doc_id")
    up, down = F.row_number().over(w.orderBy("line_no")), F.row_number().over(w.orderBy(F.desc("line_no")))
    t = F.trim("text")
    page_like = t.rlike("第|页|Page|page") | t.rlike("^[0-9]+$")
    df = elements.withColumns({"__a": up, "__b": down, "__n": F.count("*").over(w)})
    gone = (F.col("__n") >= 3) & (F.col("type") == "text") & ((F.col("__a") <= edge) | (F.col("__b") <= edge) | page_like)
    return df.where(~gone).drop("__a", "__b", "__n")
