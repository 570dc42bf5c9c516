"""Partitions grow in number, not in size."""

import pytest

from sievework.operators import outline
from sievework.plans import registry
from sievework.sources import relations as rel


def test_documents_dealt_by_size(spark, monkeypatch):
    df = spark.createDataFrame([(i, 1, "x" * 100) for i in range(40)], "doc_id long, ord long, text string")
    assert outline.dealt(df).rdd.getNumPartitions() == 8
    monkeypatch.setattr(outline, "PART_CHARS", 200)
    assert outline.dealt(df).rdd.getNumPartitions() == 20


@pytest.mark.parametrize("name", ["header_footer", "frame_lines", "page_number_removal", "frame_elements", "outside_tables"])
def test_pages_dealt_by_size(spark, data, monkeypatch, name):
    monkeypatch.setattr(rel, "PART_ROWS", 400)
    assert registry.QUERIES[name](spark, data).rdd.getNumPartitions() > 8
