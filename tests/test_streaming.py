from sievework.functions import models
from sievework.plans import pipelines
from sievework.sources.relations import table
from sievework.streaming import ingest


def test_stream_ingest(spark, data, tmp_path):
    incoming, store = f"{tmp_path}/in", f"{tmp_path}/store"
    docs = table(spark, data, "documents").limit(30)
    docs.write.parquet(incoming)
    for _ in range(2):  # the second run finds nothing new
        q = ingest.ingest(spark, incoming, store, f"{tmp_path}/cp")
        q.awaitTermination()
    assert spark.read.parquet(f"{store}/status").where("status = 'completed'").count() == 30
    assert ingest.event_windows(table(spark, data, "events")).agg({"n": "sum"}).first()[0] == 1000


def test_ingest_and_ask(spark, data):
    from pyspark.sql import functions as F

    hooks = models.Hooks()
    stored = pipelines.ingest(table(spark, data, "documents").limit(20), hooks).withColumn("chunk_id", F.monotonically_increasing_id())
    first = stored.limit(3).select(F.col("chunk_id").alias("query_id"), "text", "embedding")
    got = pipelines.ask(first, stored, hooks).collect()
    assert len(got) == 3 and all(r.answer for r in got)


def test_ingest_by_title(spark):
    """Chunks follow the titles below the table of contents; a title alone joins the next chunk; null and empty texts give none."""
    text = "intro line\n1.1 Alpha\nbody of alpha\n\n1.2 Beta\n1.2.1 Gamma > x\nbody of gamma\nmore\n1.3 Delta"
    docs = spark.createDataFrame([(1, text), (2, "no titles here\nat all"), (3, None), (4, "")], "doc_id long, text string")
    got = {(r.doc_id, r.ord): (r.text, list(r.path)) for r in pipelines.outlined(docs).collect()}
    assert got[1, 1] == ("intro line", []) and got[2, 1] == ("no titles here\nat all", [])
    assert got[1, 2][0] == "1.1 Alpha\nbody of alpha" and got[1, 2][1] == ["1.1 Alpha"]
    assert got[1, 3][0] == "1.2 Beta\n1.2.1 Gamma > x\nbody of gamma\nmore" and got[1, 3][1][-1] == "1.2.1 Gamma > x"
    assert {k[0] for k in got} == {1, 2} and len([k for k in got if k[0] == 1]) == 4
    stored = pipelines.ingest(docs, models.Hooks(), short=1, by_title=True).collect()
    assert len(stored) == len(got) and all(len(r.embedding) == 64 for r in stored)


def test_judged_and_encode_once(spark):
    """Topic rules take the cosine of neighbouring short chunks and of windows within a long one; equal texts get one vector."""
    import math

    import numpy as np
    from pyspark.sql import functions as F

    hooks = models.Hooks()
    long_text = " ".join(f"a{i % 7}" for i in range(500)) + " " + " ".join(f"b{i % 7}" for i in range(500))
    rows = [(1, 1, "red green blue", ["1 a"]), (1, 2, "red green blue", ["1 a"]), (1, 3, long_text, ["x"]), (1, 4, "sun", []), (1, 6, "sun", []), (2, 1, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, ord long, text string, path array<string>")
    got = {(r.doc_id, r.ord): r for r in pipelines.judged(df, hooks, [r"^\d"]).collect()}
    assert len(got) == 6 and math.isclose(got[1, 1].neighbor_similarity, 1.0) and got[1, 1].merge_topic_risk == 60 and got[1, 1].hard
    assert math.isclose(got[1, 2].neighbor_similarity, 1.0) and got[1, 2].hard  # the chunk before counts as much as the one after
    assert all(got[k].neighbor_similarity is None for k in [(1, 3), (1, 4), (1, 6), (2, 1)])  # long ones, runs of one, gaps
    assert got[1, 3].total_risk - got[1, 3].split_topic_risk - got[1, 3].short_risk - got[1, 3].long_risk - got[1, 3].content_risk - got[1, 3].mixing_risk == 20
    assert got[1, 3].breaks_structure and not got[1, 1].breaks_structure and got[1, 1].split_topic_risk == 0
    words = long_text.split()
    size, step = 150, 75
    count = math.ceil((len(words) - size) / step) + 1
    windows = [" ".join(words[i * step : i * step + size]) for i in range(count)]
    if len(words) - (count - 1) * step < 0.6 * size:
        windows[-2:] = ["\n".join(windows[-2:])]
    vecs = [np.array(r.v) for r in spark.createDataFrame(list(enumerate(windows)), "i int, t string").select("i", hooks.embed(F.col("t")).alias("v")).orderBy("i").collect()]
    assert math.isclose(got[1, 3].least_similarity, min(models.similarity(a, b) for a, b in zip(vecs, vecs[1:])), abs_tol=1e-9)
    # windows overlap by half, so parts without a common word still reach about 0.5
    assert 0.5 <= got[1, 3].least_similarity < 0.65 and got[1, 3].split_topic_risk == 35 and not got[1, 3].hard
    once = models.encode_once(df, hooks).collect()
    plain = {(r.doc_id, r.ord): r.embedding for r in models.encode(df, hooks).collect()}
    assert {(r.doc_id, r.ord): r.embedding for r in once} == plain and len(plain) == 5


def test_recognized(spark):
    images = spark.createDataFrame([("a", bytearray(b"hi")), ("b", None)], "path string, content binary")
    got = models.recognized(images, models.Hooks(recognize=lambda image: image.decode().upper())).collect()
    assert sorted((r.path, r.text) for r in got) == [("a", "HI"), ("b", "")]


def test_neighbor_similarity_of_runs(spark):
    """Each member of a run takes the greater cosine with either side; the chunks beyond its ends count, however long."""
    import math

    from sievework.operators import quality

    long_text = "sun " * 100 + "moon " * 100
    rows = [(1, 1, "red green"), (1, 2, "red green"), (1, 3, "sun"), (1, 4, long_text), (1, 5, "alone"), (1, 6, long_text), (1, 7, ""), (1, 8, "x")]
    df = quality.measured(spark.createDataFrame(rows, "doc_id long, ord long, text string"))
    got = {r.ord: r.neighbor_similarity for r in quality.neighbor_similarity(df, models.Hooks().embed).collect()}
    assert math.isclose(got[1], 1.0) and math.isclose(got[2], 1.0) and math.isclose(got[3], math.sqrt(0.5), rel_tol=1e-6)
    assert got[4] is None and got[5] is None and got[6] is None
    assert got[7] == 0 and got[8] == 0  # a text without words has the zero vector
