import json

from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.operators import shred

JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab/", max_size=3),
    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abc", min_size=1, max_size=2), x, max_size=3),
    max_leaves=12,
)


def brute(value, path="", parent="", top=True):
    if isinstance(value, dict):
        if not top:
            yield path, parent
        for k, v in value.items():
            yield from brute(v, f"{path}/{k}" if path else k, "" if top else path, False)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from brute(v, f"{path}/{i}" if path else str(i), parent, False)


@settings(max_examples=150, deadline=None)
@given(st.lists(JSON, max_size=5))
def test_round_trip_through_levels(records):
    assert shred.assemble(shred.shred(records)) == records


@settings(max_examples=150, deadline=None)
@given(st.lists(JSON, max_size=5))
def test_nodes_from_levels_equal_a_walk(records):
    got = sorted((int(r), p, q) for rec, ps, qs in shred.nodes(shred.shred(records, objects_only=True)) for r, p, q in zip(rec, ps, qs, strict=True))
    assert got == sorted((i, p, q) for i, v in enumerate(records) for p, q in brute(v))


def test_tables_of_every_kind_of_text(spark):
    doc = {"blocks": [None, {"lines": [{"spans": []}, "x"], "box": {}}], "rows": [[{"t": 1}]]}
    texts = [json.dumps(doc), json.dumps(json.dumps([{"a": {"b": 1}}])), "", None, '{"a": {', '"plain"', "7"]
    df = spark.createDataFrame([(str(i), t, i) for i, t in enumerate(texts)], "id string, js string, record_id int")
    got = {tuple(r)[1:] for r in shred.flat_nodes(df, "id", None, {"js": "t.js"}).collect()}
    assert got == {
        ("0", 0, "blocks/1", ""), ("0", 0, "blocks/1/lines/0", "blocks/1"), ("0", 0, "blocks/1/box", "blocks/1"), ("0", 0, "rows/0/0", ""), ("1", 0, "0", ""), ("1", 0, "0/a", "0"),
    }
    values = {(r.record_id, r.node_path, r.parent_path, r.name, r.type, r.value) for r in shred.flat_values(df, "id", None, {"js": "t.js"}).collect()}
    assert ("0", "rows/0/0/t", "rows/0/0", "t", "number", "1") in values and ("0", "blocks/0", "", "blocks", "null", None) in values and ("0", "blocks/1/lines/1", "blocks/1", "lines", "string", "x") in values


def test_empty_table_and_deep_nesting(spark):
    df = spark.createDataFrame([], "id string, js string")
    assert shred.flat_nodes(df, "id", None, {"js": "t"}).count() == 0
    deep = "[" * 300 + '{"a": 1}' + "]" * 300
    assert shred.flat_nodes(spark.createDataFrame([("x", deep)], "id string, js string"), "id", None, {"js": "t"}).count() == 1
