"""Topic rules on cosines that lie on a limit or half-way between two rounded values, beside their SQL."""

import pytest

from oracle import connect, same
from sievework.plans import registry


def text(**letters):
    return "".join(c * n for c, n in letters.items())


def folder(spark, tmp_path, *pairs):
    rows = [(i, f"{a}\n{b}", "en", "src0", len(a) + len(b) + 1) for i, (a, b) in enumerate(pairs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/parts")
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    return str(tmp_path)


# cosines of 3/4, 41/640 and 323/640: the first is on a limit, the others are half-way in the sixth place
PAIRS = [(text(a=1, b=1, c=1), text(a=3, b=3, c=3, d=4, e=2, f=1)), ("a", text(a=41, b=638, c=29, d=5, e=3)), ("a", text(a=323, b=551, c=39, d=10, e=7))]


@pytest.mark.parametrize("name", ["short_run_topics", "validated_chunks"])
def test_exact_cosines(spark, tmp_path, name):
    d = folder(spark, tmp_path, *PAIRS)
    got = registry.QUERIES[name](spark, d)
    same(got, connect(d), registry.ORACLES[name])
    assert {(r.doc_id, r.neighbor_similarity) for r in got.collect()} == {(0, 0.75), (1, 0.064063), (2, 0.504688)}
    if name == "short_run_topics":
        assert {(r.doc_id, r.merge_topic_risk) for r in got.collect()} == {(0, 0), (1, 0), (2, 0)}
