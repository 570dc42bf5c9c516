from sievework.operators import docs, outline
from sievework.plans import pipelines


def test_docs_search(spark):
    pages = spark.createDataFrame([(1, "a", "The router and the Plugin", "x"), (2, "b", "plugins", "y"), (3, "c", None, "x"), (4, "d", "", "x"), (5, "e", "ROUTER plugin z", "x")], "page_id long, title string, content string, module string")
    asked = spark.createDataFrame([(1, " router  PLUGIN plugin ", "x"), (2, None, "x"), (3, "", "y"), (4, "plugin", "y"), (5, "absent", "x")], "query_id long, text string, module string")
    got = [(r.query_id, r.rank, r.page_id, r.content, r.score) for r in docs.search(pages, asked, k=2, shown=3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1, "The", 3), (1, 2, 5, "ROU", 3), (4, 1, 1, "The", 1), (4, 2, 2, "plu", 1)]
    own = [(r.query_id, r.page_id) for r in docs.search(pages, asked, k=3, by="module").orderBy("query_id", "rank").collect()]
    assert own == [(1, 1), (1, 5), (4, 2)]
    assert docs.search(pages.limit(0), asked).count() == 0 and docs.search(pages, asked.limit(0)).count() == 0


def test_post_processed(spark):
    rows = [(1, 1, " 1 Head ", ["1 Head"], 4, "catalog"), (1, 2, "body of it", ["1 Head ", "1.1 Part"], None, None), (1, 3, "alone", ["a", "a"], None, "catalog"), (1, 4, "2 End", ["2 End"], 9, None), (2, 1, None, [], None, None), (2, 2, "", [], 2, None)]
    got = {r.chunk_id: r for r in pipelines.post_processed(spark.createDataFrame(rows, "doc_id long, ord long, text string, path array<string>, page long, type string"), 2).collect()}
    assert sorted(got) == ["1_1", "1_2", "1_3", "2_1", "2_2"]
    joined = got["1_1"]
    assert (joined.text, joined.path, joined.page, joined.type) == ("1 Head\nbody of it", ["1 Head", "1.1 Part"], 4, "text") and joined.keywords == ["1", "body"]
    assert (got["1_2"].path, got["1_2"].page, got["1_2"].type, got["1_2"].length) == (["a", "a"], 1, "catalog", 5)
    assert got["1_3"].page == 9 and got["2_1"].keywords == [] and got["2_1"].length == 0 and got["2_2"].page == 2
    bare = spark.createDataFrame(rows[2:4], "doc_id long, ord long, text string, path array<string>, page long, type string").drop("page", "type")
    assert sorted((r.page, r.type) for r in pipelines.post_processed(bare).collect()) == [(1, "text"), (1, "text")]
    assert outline.merge_title_only(bare.limit(0)).count() == 0
