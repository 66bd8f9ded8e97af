import os

import pytest

from pagewright.llm import queries

D = os.environ.get("PAGEWRIGHT_DATA", "/root/testdata/sf0.001")
COLUMNS = {
    "p2_found": {"field": "string", "page_a": "string", "page_b": "string"},
    "p3_found": {"page_id": "string", "field": "string", "line_no": "int", "kind": "string"},
    "p5_found": {"page_id": "string", "line_no": "int"},
    "p6_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p7_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p8_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs_with_its_columns(spark, name):
    df = queries.QUERIES[name](spark, D)
    assert name not in COLUMNS or dict(df.dtypes) == COLUMNS[name]
    assert df.count() >= 0
