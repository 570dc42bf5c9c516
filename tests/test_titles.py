"""Title formats: each is tried once a title, and first characters change no result."""

from pyspark.sql import functions as F

from sievework.functions import titles


def test_formats_are_told_once_a_path(spark):
    df = spark.createDataFrame([(["1 a", "2 b"], "x")], "p array<string>, t string")
    plan = df.select(titles.without_same_format(F.col("p"), F.col("t")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("RLIKE") <= len(titles.FORMATS) + len(titles.FIRST)


def test_title_format_is_the_first_that_fits(spark):
    plain = F.coalesce(*[F.when(F.col("t").rlike(f"(?U){p}"), F.lit(n)) for n, p in titles.FORMATS.items()])
    odd = [None, "", " ", "1", "1 ", "1　a", "٣ a", "1.2、a", "第三章 a", "第３条 a", "十、a", "十 \n", "第", "一百　x", "\n1 a", "a 1 b", "1.1.1 ", "第1节 x", "二,y"]
    df = spark.createDataFrame([(t,) for t in odd], "t string").select("t", titles.title_format(F.col("t")).alias("got"), plain.alias("want"))
    rows = df.collect()
    assert [r.got for r in rows] == [r.want for r in rows] and len({r.got for r in rows}) > 6
    paths = spark.createDataFrame([(None, "x"), (["1 a", None, "2 b"], None), ([], "x")], "p array<string>, t string")
    assert [r.x for r in paths.select(titles.without_same_format(F.col("p"), F.col("t")).alias("x")).collect()] == [None, [None, "2 b"], []]
