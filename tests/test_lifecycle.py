"""The stateful upload stream, stopped and restarted; the embedding cache."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.functions import models
from sievework.sources import embedding_cache
from sievework.sources.versions import ChunkStore, Versions
from sievework.streaming import lifecycle


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def told(spark, path):
    rows = Versions(spark, path).read("statuses")
    return sorted((r.doc_id, r.at.strftime("%H:%M"), r.status) for r in rows.collect())


def test_lives_of_documents(spark, tmp_path):
    incoming, paths = f"{tmp_path}/in", [f"file://{tmp_path}/{x}" for x in ("store", "status")]

    def upload(name, *rows):
        spark.createDataFrame([(i, at(m), t, "s") for i, m, t in rows], lifecycle.UPLOADS).coalesce(1).write.mode("append").parquet(f"{incoming}")

    def run():
        q = lifecycle.follow(spark, incoming, *paths, f"{tmp_path}/cp", files=1)
        q.awaitTermination()
        assert q.exception() is None

    upload("a", (1, 0, None), (2, 0, None), (3, 1, "no announcement\nat all"), (4, 2, "  "), (None, 2, "nobody"))
    run()
    first = [(1, "00:00", "parsing"), (2, "00:00", "parsing"), (3, "00:01", "completed"), (4, "00:02", "failed")]
    assert told(spark, paths[1]) == first
    upload("b", (1, 5, "one\ntwo"), (3, 6, "no announcement\nat all"))
    run()  # the stream was stopped and goes on from its state
    second = sorted([*first, (1, "00:05", "completed"), (3, "00:06", "duplicate")])
    assert told(spark, paths[1]) == second
    run()
    assert told(spark, paths[1]) == second
    upload("c", (5, 200, "late"))
    run()
    upload("d", (1, 300, "one\nchanged"))
    run()
    upload("e", (6, 301, "x"))
    run()
    got = told(spark, paths[1])
    assert (2, "00:30", "timed_out") in got and len(got) == len(set(got)) == len(second) + 4
    store = ChunkStore(spark, paths[0])
    assert [(r.ord, r.text) for r in store.document(1).collect()] == [(1, "one"), (2, "changed")]
    assert store.read().select("doc_id").distinct().count() == 4


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    log = Versions(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([(1, "x")], "doc_id long, status string")
    for _ in range(2):
        base = log.snapshot()
        if base.facts.get("begun", -1) < 7:
            log.commit({"statuses": rows}, base, facts={"begun": 7})
    assert log.read("statuses").count() == 1


@pytest.fixture
def counted(spark):
    sent = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def embed(text: pd.Series) -> pd.Series:
        sent.add(len(text))
        return text.map(lambda t: None if t == "bad" else [float(len(t)), 1.0])

    return sent, models.Hooks(embed=embed)


def test_cache_calls_the_model_once_a_text(spark, tmp_path, counted):
    sent, hooks = counted
    root = f"file://{tmp_path}/cache"
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, " "), (5, None), (6, "bad")], "id long, text string")
    got = {r.id: r.embedding for r in embedding_cache.encode(rows, hooks, root, "m").collect()}
    assert got == {1: [1.0, 1.0], 2: [2.0, 1.0], 3: [1.0, 1.0], 6: None} and sent.value == 3
    more = rows.union(spark.createDataFrame([(7, "ccc")], rows.schema))
    assert {r.id: r.embedding for r in embedding_cache.encode(more, hooks, root, "m").collect()} == {**got, 7: [3.0, 1.0]}
    assert sent.value == 5  # the failed one again, and the new one
    good = more.where("text <> 'bad'")
    assert embedding_cache.encode(good, hooks, root, "m").count() == 4 and sent.value == 5
    embedding_cache.encode(good, hooks, root, "other model").count()
    assert sent.value == 8
    assert sorted((r.model, r.sent, r.failed) for r in embedding_cache.calls(spark, root).collect()) == [("m", 2, 1), ("m", 3, 1), ("other model", 3, 0)]


def test_an_edit_embeds_what_it_changes(spark, tmp_path, counted):
    from sievework.plans import pipelines

    sent, hooks = counted
    store, cache = ChunkStore(spark, f"file://{tmp_path}/s"), f"file://{tmp_path}/c"
    line = lambda i, n=25: " ".join(f"w{i}x{k}" for k in range(n))
    first = [(1, [line(i) for i in range(12)]), (2, [line(50), "short", line(51)]), (3, [line(60)])]
    frame = lambda docs: spark.createDataFrame([(i, "\n".join(t), "s") for i, t in docs], "doc_id long, text string, source string")
    key = lambda rows: sorted((r.doc_id, r.ord, r.chunk_id, r.text, r.embedding) for r in rows.collect())
    pipelines.reingest(frame(first), store, hooks, cache)
    whole = pipelines.ingest(frame(first), models.Hooks(embed=hooks.embed))
    before = sent.value
    assert key(store.read()) == key(whole)
    sent_by_whole = sent.value - before
    edited = [(1, first[0][1][:4] + ["put in here " + line(99)] + first[0][1][4:]), (3, [])]
    before = sent.value
    pipelines.reingest(frame(edited), store, hooks, cache)
    assert sent.value - before == 1 and sent_by_whole >= 15
    now = frame([edited[0], first[1], edited[1]])
    assert key(store.read()) == key(pipelines.ingest(now, models.Hooks(embed=hooks.embed)))
