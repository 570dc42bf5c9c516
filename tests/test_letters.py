"""The letter counts of a text: lower case is made once a text."""

from pyspark.sql import functions as F

from sievework.functions import models


def test_letter_counts_lower_once(spark):
    texts = ["", "aAbz", "Éa ÀZz", "日a本", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", models.letter_counts(F.col("t")).alias("v"))
    assert df._jdf.queryExecution().analyzed().toString().count("lower(") == 1
    want = [[float(t.lower().count(chr(c))) for c in range(97, 123)] if t is not None else [None] * 26 for t in texts]
    assert [r.v for r in df.collect()] == want
