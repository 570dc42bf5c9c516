"""Parsed tables: the form on whole rows against one window or join a step on cells, and what is read once."""

import random

from pyspark.sql import Window, functions as F

from sievework.operators import layout, tables


def by_cells(t, cells):
    """tables.parsed() step by step on cells."""
    w = Window.partitionBy("doc_id").orderBy("table_no")
    starts = F.coalesce(F.col("fresh"), F.lit(False)) | (F.row_number().over(w) == 1)
    of = t.select("doc_id", "table_id", "table_no", starts.alias("starts")).withColumn("head_of", F.last(F.when(F.col("starts"), F.col("table_id")), ignorenulls=True).over(w))
    df = cells.join(tables.header_end(layout.fill_down(cells)), "table_id")
    head = layout.fill_down(layout.fill_right(df.where("row <= last").drop("last")))
    body = layout.fill_right(layout.fill_down(df.where("row > last").drop("last")))
    names = layout.flat_headers(head.join(of.where("starts").select("table_id"), "table_id", "left_semi"), 2**31 - 1)
    names = names.join(of.select(F.col("head_of").alias("table_id"), F.col("table_id").alias("own")), "table_id").select(F.col("own").alias("table_id"), "col", "header")
    rows = body.unionByName(head.join(of.where("not starts").select("table_id"), "table_id", "left_semi"))
    return layout.merge_headers(rows, names).join(of.select("doc_id", "table_id"), "table_id").select("doc_id", "table_id", "row", "header", "value")


def test_rows_equal_cells(spark):
    r = random.Random(3)
    of, cells = [], []
    for i in range(150):
        of.append((i // 5, i, r.randrange(100) * 1000 + i, r.choice([True, False, None])))
        width = r.randrange(1, 5)
        for row in range(r.randrange(0, 7)):
            cells += [(i, row, c, r.choice(["", " ", None, "a", " a", "b ", "c.d", "a"])) for c in range(width)]
    t = spark.createDataFrame(of, "doc_id int, table_id int, table_no int, fresh boolean")
    c = spark.createDataFrame(cells, "table_id int, row int, col int, value string")
    got, want = (sorted(map(tuple, f(t, c).collect()), key=str) for f in (tables.parsed, by_cells))
    assert got == want and len(got) > 300


def test_cells_are_read_once(spark):
    t = spark.createDataFrame([(1, 0, 0, True)], "doc_id int, table_id long, table_no int, fresh boolean")
    cells = spark.range(6).select((F.col("id") * 0).alias("table_id"), (F.col("id") / 2).cast("int").alias("row"), (F.col("id") % 2).cast("int").alias("col"), F.col("id").cast("string").alias("value"))
    out = tables.parsed(t, cells)
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((x.row, x.header, x.value) for x in out.collect()) == [(1, "0", "2"), (1, "1", "3"), (2, "0", "4"), (2, "1", "5")]
