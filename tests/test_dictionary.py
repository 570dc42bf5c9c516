"""Strings found in texts by one pass, in one block or several, and by runs of characters beyond."""

import random

import pytest

from sievework.operators import dictionary, graph


@pytest.mark.parametrize("sizes", [{}, {"sent": 7}, {"sent": 5, "most": 1}])
def test_find_equals_containment(spark, sizes):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé日") for _ in range(n))
    parts = [word(rng.randint(1, 5)) for _ in range(40)] + ["", None, "x" * 50]
    rows = [(rng.choice([None, i]), i, word(rng.randint(0, 25))) for i in range(150)] + [(1, 900, None), (1, 901, ""), (2, 902, "x" * 60)]
    texts = spark.createDataFrame(rows, "doc_id long, ord long, body string")
    got = dictionary.find(spark.createDataFrame([(p,) for p in parts], "part string"), texts, "body", ["doc_id", "ord"], **sizes).collect()
    want = [(d, o, p) for d, o, t in rows for p in {x for x in parts if x} if t and p in t]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key) and len(want) > 300


def test_no_strings_and_no_shuffle_of_texts(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "b")], "id long, t string")
    none = spark.createDataFrame([], "part string")
    assert dictionary.find(none, texts, "t", ["id"]).count() == 0 == dictionary.find(none, texts.limit(0), "t", ["id"]).count()
    plan = dictionary.find(spark.createDataFrame([("b",)], "part string"), texts, "t", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_entities_in_chunks(spark):
    chunks = spark.createDataFrame([(1, o, f"1_{o}", t) for o, t in enumerate(["Ann met Bob", "Bob", "nobody", "Ann, Ann", "Ann", "Ann"])] + [(2, 0, "2_0", "Ann")], "doc_id long, ord long, chunk_id string, text string")
    entities = spark.createDataFrame([(1, "Ann"), (1, "Bob"), (1, "Bob"), (1, "Cy"), (2, "Bob")], "doc_id long, text string")
    got = sorted(map(tuple, graph.entities_in_chunks(entities, chunks).collect()))
    assert got == [(1, "Ann", "1_0", 1), (1, "Ann", "1_3", 2), (1, "Ann", "1_4", 3), (1, "Bob", "1_0", 1), (1, "Bob", "1_1", 2)]


def test_entities_meet_their_own_documents_alone(spark):
    """Entities of other documents give no places to move: chunks are joined by document, not searched for all entities."""
    chunks = spark.createDataFrame([(d, 0, f"{d}_0", "a b c") for d in range(30)], "doc_id long, ord long, chunk_id string, text string")
    entities = spark.createDataFrame([(d, "abc"[d % 3]) for d in range(30)] + [(1, ""), (2, None)], "doc_id long, text string")
    out = graph.entities_in_chunks(entities, chunks)
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(d, "abc"[d % 3]) for d in range(30)]
