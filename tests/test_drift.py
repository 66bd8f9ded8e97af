import json

import pytest

from pagewright.operators import drift

SCHEMA = "source_table string, stream_key string, seq int, ident string, json string, version double"


def run(spark, rows, block=drift.BLOCK):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in drift.changes(df, block=block).collect())


def rec(seq, value, key="k", table="settings", version=None, ident=""):
    return (table, key, seq, ident, None if value is None else value if isinstance(value, str) else json.dumps(value), version)


def test_each_kind_of_change(spark):
    got = run(spark, [rec(1, {"a": 1, "b": {"c": "x"}, "d": "same"}), rec(2, {"a": "1", "e": "same", "n": []})])
    assert got == sorted(
        [("settings", "k", 2, "retyped", "a", ""), ("settings", "k", 2, "removed", "b.c", ""), ("settings", "k", 2, "renamed", "d", "e"), ("settings", "k", 2, "added", "n", "")]
    )


def test_renamed_with_another_type_is_also_retyped(spark):
    assert run(spark, [rec(1, {"a": 5}), rec(2, {"b": "5"})]) == [("settings", "k", 2, "renamed", "a", "b"), ("settings", "k", 2, "retyped", "b", "")]


def test_ambiguous_empty_and_null_values_are_never_renamed(spark):
    got = run(spark, [rec(1, {"a": 1, "b": 1, "c": "", "d": None, "e": [1]}), rec(2, {"x": 1, "y": "", "z": None, "w": [1]})])
    assert {g[3] for g in got} == {"added", "removed"} and len(got) == 9


def test_null_keeps_the_last_known_type(spark):
    assert run(spark, [rec(1, {"a": 1}), rec(2, {"a": None}), rec(3, {"a": 2}), rec(4, {"a": "2"})]) == [("settings", "k", 4, "retyped", "a", "")]
    assert run(spark, [rec(1, {"a": None}), rec(2, {"a": "x"})]) == []


def test_broken_null_repeated_and_unordered_records(spark):
    rows = [rec(3, {"a": 1, "b": 2}), rec(1, {"a": 1}), rec(2, '{"a": 1, "b"'), rec(4, None), rec(5, "[1]"), rec(3, {"a": 1, "b": 2}), (None,) * 6]
    assert run(spark, rows) == [("settings", "k", 3, "added", "b", "")]


def test_versions_are_compared_on_every_page(spark):
    rows = [rec(1, None, table="pages", version=1.0), rec(2, {"a": 1}, table="pages", version=None), rec(3, None, table="pages", version=None), rec(4, {"a": 1}, table="pages", version=2.0)]
    assert [(g[2], g[3]) for g in run(spark, rows)] == [(2, "version"), (4, "version")]


@pytest.mark.parametrize("block", [1, 2, 3])
def test_blocks_give_the_same_changes_as_whole_streams(spark, block):
    values = [{"a": 1}, {"a": None}, None, {"a": None, "b": {}}, {"a": "s", "b": {"c": True}}, "broken", {"a": None}, {"a": 3.5, "zz": "v"}, {"q": "v"}]
    rows = [rec(i, v, table="pages", version=float(i // 3)) for i, v in enumerate(values)] + [rec(i, {"x": i} if i % 2 else {"y": i - 1}, key="hot") for i in range(12)]
    assert run(spark, rows, block) == run(spark, rows)


def test_empty_table_and_union_schema(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([rec(1, {"a": 1, "b": "x"}), rec(2, {"a": "1", "b": None, "c": {"d": True}})], SCHEMA)
    got = {(r.field, r.types, r.promoted, r.records) for r in drift.union_schema(df).collect()}
    assert got == {("a", "number,string", "text", 2), ("b", "null,string", "string", 2), ("c.d", "boolean", "boolean", 1)}
    flat = drift.unify(df, ["seq"], [("a", "text"), ("b", "string"), ("c.d", "boolean")]).orderBy("seq").collect()
    assert [tuple(r) for r in flat] == [(1, "1", "x", None), (2, "1", None, True)]


def test_promotion_lattice():
    assert [drift.promote(*x) for x in ({"null"}, {"null", "number"}, {"number", "string"}, {"array"})] == ["null", "number", "text", "array"]
