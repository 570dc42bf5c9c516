"""Word files, page frames, title formats, tables, images and chunk optimisation on small hand-made cases."""

import zipfile

from pyspark.sql import functions as F

from sievework.functions import titles
from sievework.operators import optimize, tables
from sievework.sources import documents


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_word_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Ti</w:t></w:r><w:r><w:t>tle</w:t></w:r></w:p>{p(" ")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl>{p("after")}'
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (tmp_path / "broken.docx").write_bytes(b"no")
    out = documents.read_word(spark, f"file://{tmp_path}").orderBy("line_no")
    assert rows(out, "line_no", "text", "style") == [(1, "Title", "Heading1"), (2, "after", ""), (3, "a | b", "Table")]


def test_page_numbers(spark):
    lines = [(1, 1, 1, 700.2, 9, "plain"), (1, 1, 2, 700.2, 1, "plain"), (1, 2, 3, 700.0, 2, "plain"), (1, 3, 4, 10.0, 3, "plain"), (1, 3, 5, 700.4, 3, "plain"), (1, 4, 6, 700.0, 5, "plain")]
    df = spark.createDataFrame(lines, "doc_id int, page int, line_no int, top double, num int, format string")
    assert sorted(rows(documents.page_number_lines(df), "line_no")) == [(2,), (3,), (5,)]
    boxes = spark.createDataFrame([(1, 1, 690.0, 699.5)], "doc_id int, page int, y0 double, y1 double")
    assert sorted(rows(documents.outside_boxes(df, boxes), "line_no")) == [(3,), (4,), (5,), (6,)]
    frame = spark.createDataFrame([(1, i, "table" if i == 1 else "text", t) for i, t in enumerate(["Head", "cells", "第 1 章 says", "body", "12", "more", "foot", "end"])], "doc_id int, line_no int, type string, text string")
    assert rows(documents.without_frame(frame).orderBy("line_no"), "line_no") == [(1,), (3,), (5,)]
    assert documents.without_frame(frame.limit(2)).count() == 2


def test_titles(spark):
    df = spark.createDataFrame([("第一章 概述",), ("第一章概述",), ("一、x",), ("1 x",), ("1.2 x",), ("plain",)], "t string")
    assert rows(df.select(titles.title_format(F.col("t")).alias("f")), "f") == [("rule_001",), (None,), ("rule_010",), ("rule_011",), ("rule_013",), (None,)]
    df = spark.createDataFrame([(["1 a", "1.1 b", "2 c"], "body"), (["1 a", "2 c"], "has 1 a in it")], "p array<string>, t string")
    assert rows(df.select(titles.without_same_format(F.col("p"), F.col("t")).alias("x"), titles.breaks_structure(F.col("p"), ["^[0-9] "]).alias("b")), "x", "b") == [(["1.1 b", "2 c"], True), (["1 a", "2 c"], True)]
    lines = spark.createDataFrame([(1, 1, ""), (1, 2, "1 One"), (1, 3, ""), (1, 4, "A sentence.")], "doc_id int, line_no int, text string")
    assert rows(titles.title_candidates(titles.line_features(lines)), "line_no", "confidence", "pattern") == [(2, 7, None)]
    marked = spark.createDataFrame([(1, 1, "第二章 Two"), (1, 2, " \u3000 "), (1, 3, None), (1, 4, "（三）x"), (1, 5, "body" * 30), (1, 6, "[k"), (1, 7, "y"), (2, 1, "z")], "doc_id int, line_no int, text string")
    features = titles.line_features(marked)
    assert sorted(rows(features, "doc_id", "line_no", "index", "prev_empty", "next_empty")) == [(1, 1, 0, True, True), (1, 4, 3, True, False), (1, 5, 4, False, False), (1, 6, 5, False, False), (1, 7, 6, False, True), (2, 1, 0, True, True)]
    found = titles.title_candidates(features)
    assert sorted(rows(found, "doc_id", "line_no", "confidence")) == [(1, 1, 9), (1, 4, 7), (1, 6, 5)]
    groups = titles.pattern_groups(found)
    assert rows(groups, "type", "n", "examples") == [("chinese_chapter", 1, ["第二章 Two"])]
    assert rows(titles.pattern_hierarchy(groups, marked), "doc_id", "level", "type") == [(1, "level1", "chinese_chapter")]
    assert rows(titles.format_counts(lines.where("line_no = 2").withColumn("title", F.col("text")), 1), "format", "level") == [("rule_011", 1)]


def test_tables(spark):
    df = spark.createDataFrame([(["A", "", "B"], ["x", "y", ""], [["1", None, "3"]])], "u array<string>, l array<string>, r array<array<string>>")
    got = df.select(tables.two_level(F.col("u"), F.col("l")).alias("t"), tables.join_levels(F.col("u"), F.col("l")).alias("j"), tables.table_text(F.col("u"), F.col("r")).alias("x"), tables.header_path(tables.join_levels(F.col("u"), F.col("l"))).alias("h")).first()
    assert (got.t, got.j, got.x, got.h) == (False, ["A.x", "A.y", "B"], "A |  | B\n--------\n1 |  | 3", ["A", "x", "A", "y", "B"])
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, ""), (1, 1, 0, "a"), (1, 1, 1, "b"), (1, 2, 0, "1"), (1, 2, 1, "2")], "table_id int, row int, col int, value string")
    assert rows(tables.header_end(cells), "last") == [(1,)]
    t = spark.createDataFrame([(1, 1, o, f"t{o}", 2, 0.0, float(o), 1.0, o + 1.0) for o in (1, 3, 4, 6)], "doc_id int, page int, ord int, text string, row_count int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(rows(tables.merge_tables(t), "first", "members", "text", "y1")) == [(1, 2, "t1\n\nt3", 4.0), (4, 2, "t4\n\nt6", 7.0)]
    i = spark.createDataFrame([(1, 1, 1, "a", 0, 0, 10, 10), (1, 1, 2, "", 20, 0, 30, 10), (1, 1, 3, "c", 300, 0, 310, 10)], "doc_id int, page int, ord int, text string, x0 int, y0 int, x1 int, y1 int")
    assert rows(tables.merge_images(i).orderBy("grp"), "members", "text", "x1") == [(2, "a", 30.0), (1, "c", 310.0)]
    m = spark.createDataFrame([({"k": "v", "": "x"},)], "m map<string,string>")
    assert rows(m.select(tables.row_text(F.col("m")).alias("t")), "t") == [("k: v",)]


def test_optimize(spark):
    df = spark.createDataFrame([("abcdefghij", ["fgh", "abc", "hiZZ", "fgh"])], "t string, f array<string>")
    df = df.withColumn("p", optimize.split_places(F.col("t"), F.col("f"))).withColumn("x", optimize.pieces(F.col("t"), F.col("p")))
    assert df.first().p == [5, 7] and [r.text for r in df.first().x] == ["abcde", "fg", "hij"]
    chunks = spark.createDataFrame([(1, o) for o in (1, 2, 3, 5, 6, 9)], "doc_id int, ord int")
    assert sorted(rows(optimize.consecutive(chunks), "ord", "run")) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (9, 9)]
    assert sorted(rows(optimize.with_neighbors(chunks, chunks.where("ord = 2")), "ord")) == [(1,), (2,), (3,)]
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 9)], "doc_id int, start int, end int")
    places = spark.createDataFrame([(1, 1, 0, 4), (1, 2, 4, 9)], "doc_id int, ord int, c_start int, c_end int")
    assert sorted(rows(optimize.sources_of(spans, places), "start", "ord")) == [(0, 1), (0, 2), (5, 2)]
    text = " ".join(f"w{i}" for i in range(830))
    w = spark.createDataFrame([(text,), ("short",)], "t string").select(optimize.topic_windows(F.col("t")).alias("w")).collect()
    assert w[1].w is None and w[0].w[0].split()[-1] == "w149" and w[0].w[-1].split()[-1] == "w829"
    e = spark.createDataFrame([(1, 1, "T", "x", ["a", "b", "c", "d"]), (1, 2, "U", "y", [])], "query_id int, place int, type string, text string, neighbors array<string>")
    assert rows(optimize.entity_context(e), "context") == [("[T] x: 相关实体包括 a, b, c",)]
    hits = spark.createDataFrame([(1, "c", 0.5)], "query_id int, chunk_id string, score double")
    none = spark.createDataFrame([], "query_id int, chunk_id string, related_entities array<string>, graph_score double")
    assert rows(optimize.enrich(hits, none), "has_graph", "related_entities", "graph_score") == [(False, [], 0.0)]


def test_parsed_tables(spark):
    t = spark.createDataFrame([("d", 1, 1, False), ("d", 2, 2, False), ("d", 3, 3, True), ("e", 4, 1, None)], "doc_id string, table_id int, table_no int, fresh boolean")
    grids = {1: [["A", ""], ["A", "b"], ["1", "2"], ["", "3"]], 2: [["4", ""], ["5", "6"]], 3: [["k", "k", "k"], ["7", "8", "9"]], 4: [["only", "head"]]}
    cells = [(i, r, c, v) for i, g in grids.items() for r, row in enumerate(g) for c, v in enumerate(row)]
    got = tables.parsed(t, spark.createDataFrame(cells, "table_id int, row int, col int, value string"))
    # blank header cells take the one on their left, so the first table's second header is A.b; a header ends where its rows stop growing; equal headers are one
    assert sorted(rows(got, "doc_id", "table_id", "row", "header", "value")) == [
        ("d", 1, 2, "A", "1"), ("d", 1, 2, "A.b", "2"), ("d", 1, 3, "A", "1"), ("d", 1, 3, "A.b", "3"),
        ("d", 2, 0, "A", "4"), ("d", 2, 0, "A.b", "4"), ("d", 2, 1, "A", "5"), ("d", 2, 1, "A.b", "6"), ("d", 3, 1, "k", "7 8 9"),
    ]
    assert tables.parsed(t.limit(0), spark.createDataFrame([], "table_id int, row int, col int, value string")).count() == 0
