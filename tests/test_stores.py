"""Versioned stores and the stored keyword index: pinned readers, lost races, half-written versions, equal searches."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import keyword, keyword_index
from sievework.sources.versions import ChunkStore, Conflict, Versions, reset



@pytest.fixture(autouse=True)
def few_folders(monkeypatch):
    monkeypatch.setattr(keyword_index, "FOLDER_TOKENS", 2_000)


CHUNK = "doc_id long, ord long, chunk_id string, text string"


def chunks(spark, *rows):
    return spark.createDataFrame([(d, o, f"{d}_{o}", t) for d, o, t in rows], CHUNK)


def texts(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.ord, r.text) for r in df.collect())


def test_versions_are_pinned(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/s")
    assert store.read() is None and store.log.versions() == []
    store.append(chunks(spark, (1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "n")))
    old = store.read()
    store.delete_documents(spark.createDataFrame([(1,), (None,)], "doc_id long"))
    store.append(chunks(spark, (1, 3, "again")))
    store.upsert(chunks(spark, (2, 1, "C"), (3, 1, "new")))
    assert texts(old) == texts(store.read(0)) == [(-1, 1, "n"), (1, 1, "a"), (1, 2, "b"), (2, 1, "c")]
    assert texts(store.read(1)) == [(2, 1, "c")]
    now = [(1, 3, "again"), (2, 1, "C"), (3, 1, "new")]
    assert texts(store.read()) == now
    store.add_absent(chunks(spark, (2, 1, "lost"), (4, 1, "first"), (4, 2, "x")))
    assert texts(store.read()) == [*now, (4, 1, "first"), (4, 2, "x")]
    store.replace_documents(chunks(spark, (4, 9, "only")))
    before = texts(store.read())
    store.compact()
    assert texts(store.read()) == before == [*now, (4, 9, "only")]
    assert [r.ord for r in store.document(1).collect()] == [3]
    assert store.log.vacuum(1) > 0 and texts(store.read()) == before
    with pytest.raises(ValueError):
        store.read(0)
    store.clear()
    assert store.read().count() == 0


def test_half_written_and_lost_races(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/s")
    store.append(chunks(spark, (1, 1, "a")))
    base = store.log.snapshot()
    store.log.stage({"rows": chunks(spark, (9, 9, "stopped here"))}, base)  # never published
    assert texts(store.read()) == [(1, 1, "a")]
    late = store.log.stage({"rows": chunks(spark, (2, 1, "late"))}, base)
    store.append(chunks(spark, (3, 1, "first")))
    with pytest.raises(Conflict):
        store.log.publish(late)
    assert texts(store.read()) == [(1, 1, "a"), (3, 1, "first")] and len(store.log.versions()) == 2
    assert store.log.vacuum(2) == 2


def test_reset_names_errors(spark, tmp_path):
    good, bad = ChunkStore(spark, f"file://{tmp_path}/a"), ChunkStore(spark, f"file://{tmp_path}/b")
    good.append(chunks(spark, (1, 1, "a")))
    bad.clear = lambda: 1 / 0
    assert reset({"bad": bad, "good": good}) == {"bad": "division by zero", "good": ""} and good.read().count() == 0


def ranked(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 40))), f"k{i % 3}") for i in range(900)] + [(1000, None, "k1"), (1001, "", None), (1002, "w1 w2", None)]
    asked = [(i, " ".join(word() for _ in range(rng.randint(1, 6))), f"k{i % 4}") for i in range(25)] + [(90, "", "k1"), (91, None, "k1"), (92, "nowhere", "k0")]
    return spark.createDataFrame(rows, "chunk_id long, text string, kb string"), spark.createDataFrame(asked, "query_id long, text string, kb string")


@pytest.mark.parametrize("block", [4, 256])
def test_index_equals_search(spark, corpus, tmp_path, monkeypatch, block):
    monkeypatch.setattr(keyword_index, "BLOCK", block)
    rows, asked = corpus
    path = f"file://{tmp_path}/i"
    keyword_index.append(spark, path, rows.where("chunk_id < 300"))
    first = keyword_index.append(spark, path, rows.where("chunk_id >= 300"))
    want = ranked(keyword.search(asked, rows, 5))
    assert ranked(keyword_index.search(spark, path, asked, 5)) == want and len(want) > 80
    keyword_index.remove(spark, path, rows.where("chunk_id % 4 = 1"))
    left = ranked(keyword.search(asked, rows.where("chunk_id % 4 <> 1"), 5))
    assert ranked(keyword_index.search(spark, path, asked, 5)) == left != want
    keyword_index.merge(spark, path)
    assert ranked(keyword_index.search(spark, path, asked, 5)) == left
    assert ranked(keyword_index.search(spark, path, asked, 5, version=first)) == want
    keyword_index.append(spark, path, rows.where("chunk_id % 4 = 1"))
    assert ranked(keyword_index.search(spark, path, asked, 5)) == want


def test_search_in_windows_and_blocks(spark, corpus, monkeypatch):
    rows, asked = corpus
    want = {by: ranked(keyword.search(asked, rows, 5, by=by)) for by in (None, "kb")}
    words = {r.chunk_id: (r.text or "").split() for r in rows.collect()}
    for r in asked.where("query_id < 25").collect():  # every chunk that holds an asked word counts
        hits = [x for x in want[None] if x[0] == r.query_id]
        assert len(hits) <= 5 and all(set(words[x[2]]) & set(r.text.split()) for x in hits)
    monkeypatch.setattr(keyword, "BLOCK_TERMS", 20)
    monkeypatch.setattr(keyword, "WINDOW", 7)
    for by in (None, "kb"):
        assert ranked(keyword.search(asked, rows.repartition(3), 5, by=by)) == want[by]


def test_search_moves_no_pairs(spark, corpus):
    """Only each task's best rows of a query are shuffled, not every pair of a query and a chunk that share a word."""
    rows, asked = corpus
    plan = keyword.search(asked, rows, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(query_id" in plan and "Join" not in plan
    assert not any("chunk_id" in line for line in plan.split("\n") if "Exchange hashpartitioning" in line)


def test_keyed_index(spark, corpus, tmp_path):
    rows, asked = corpus
    path = f"file://{tmp_path}/k"
    keyword_index.append(spark, path, rows, by="kb")
    assert ranked(keyword_index.search(spark, path, asked, 4, by="kb")) == ranked(keyword.search(asked, rows, 4, by="kb"))
    with pytest.raises(ValueError):
        keyword_index.append(spark, path, rows, by=None)


def test_index_search_moves_no_pairs(spark, corpus, tmp_path, monkeypatch):
    """Shuffled are the asked terms' postings, once, and each task's best rows; also in windows of one block and blocks of few terms."""
    rows, asked = corpus
    path = f"file://{tmp_path}/m"
    monkeypatch.setattr(keyword_index, "BLOCK", 8)
    keyword_index.append(spark, path, rows)
    found = keyword_index.search(spark, path, asked, 5)
    deals = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]
    assert len(deals) == 2 and "query_id" in deals[0] and "window" in deals[1]
    monkeypatch.setattr(keyword_index, "WINDOW", 1)
    monkeypatch.setattr(keyword, "BLOCK_TERMS", 20)
    assert ranked(keyword_index.search(spark, path, asked, 5)) == ranked(found)


def test_search_reads_asked_folders_and_skips_blocks(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "BLOCK", 8)
    rows, asked = corpus
    path = f"file://{tmp_path}/p"
    keyword_index.append(spark, path, rows)
    log = Versions(spark, path)
    posts = keyword_index.asked_postings(log, log.snapshot(), spark.createDataFrame([("w7",), ("w9",)], "term string"))
    assert log.snapshot().facts["folders"] > 4
    assert 1 <= posts.select(F.spark_partition_id(), "bucket").select("bucket").distinct().count() <= 2
    plan = posts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    keyword_index.append(spark, path, rows.limit(0))
    assert ranked(keyword_index.search(spark, path, asked, 3)) == ranked(keyword.search(asked, rows, 3))


def test_empty_index(spark, corpus, tmp_path):
    rows, asked = corpus
    path = f"file://{tmp_path}/e"
    keyword_index.append(spark, path, rows.limit(0))
    assert keyword_index.search(spark, path, asked).count() == 0
