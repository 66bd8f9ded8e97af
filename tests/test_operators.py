import math

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import geometry, islands, matching, relational
from pagewright.sources.tables import once, once_wide


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_escape_is_one_pass(spark):
    assert one(spark, T.escape_tex(F.lit(r"a\{b}&%"))) == r"a\textbackslash{}\{b\}\&\%"
    assert one(spark, T.escape_tex(F.lit(None).cast("string"))) is None and one(spark, T.escape_tex(F.lit(""))) == ""


def test_page_ranges(spark):
    assert one(spark, T.page_range(F.lit("3，8-12, 9"))) == [3, 8, 9, 10, 11, 12]
    for bad in ("12-8", "1,", "x", "", "0", "1-99999"):
        assert one(spark, T.page_range(F.lit(bad))) is None


def test_byte_prefix_ends_between_characters(spark):
    assert one(spark, T.utf8_prefix(F.lit("aé水b"), 5)) == "aé" and one(spark, T.utf8_prefix(F.lit("aé水b"), 6)) == "aé水" and one(spark, T.utf8_prefix(F.lit("ab"), 9)) == "ab"


def test_numbers_names_and_paths(spark):
    assert [one(spark, T.short_number(F.lit(x))) for x in (1.5, 2.0, -0.0, 1e-9, 12.3456789)] == ["1.5", "2", "0", "0", "12.345679"]
    assert one(spark, T.safe_name(F.lit(" a/b 水:c "))) == "a-b-水-c"
    assert one(spark, T.safe_path(F.lit("a\\b//c.png"))) == "a/b/c.png"
    for bad in ("/a", "C:\\x", "a/../b", ""):
        assert one(spark, T.safe_path(F.lit(bad))) is None


def test_tex_document(spark):
    good = "% c\n\\documentclass{article}\\begin{document}x\\end{document}\n"
    assert one(spark, T.is_tex_document(F.lit(good))) and not one(spark, T.is_tex_document(F.lit("x" + good)))


def test_affine_round_trip():
    m = (0.5, 0.1, -0.2, 0.8, 0.3, 0.4)
    a, b, c, d, e, f = geometry.inverse(m)
    x, y = m[0] * 0.3 + m[2] * 0.7 + m[4], m[1] * 0.3 + m[3] * 0.7 + m[5]
    assert math.isclose(a * x + c * y + e, 0.3) and math.isclose(b * x + d * y + f, 0.7)


def test_touching_boxes_do_not_intersect(spark):
    df = spark.createDataFrame([("p", "a", 0.0, 0.0, 0.5, 0.5), ("p", "b", 0.5, 0.0, 1.0, 0.5), ("p", "c", 0.4, 0.4, 0.6, 0.6), ("p", "d", None, None, None, None)], "page string, id string, x0 double, y0 double, x1 double, y1 double")
    got = geometry.pairs(df, "page", "id").where(geometry.intersects(geometry.sides("a"), geometry.sides("b"))).select("a.id", F.col("b.id").alias("o")).collect()
    assert {tuple(r) for r in got} == {("a", "c"), ("b", "c")}
    assert geometry.grown(df, "page").first()[1:] == (1, 0.6)


def test_islands_coverage_and_capacity(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 4, 9, 9)], "k string, x int")
    assert sorted(r.island for r in islands.islands(df, ["k"], "x", F.lit(2)).collect()) == [0, 0, 0, 1, 1]
    spans = spark.createDataFrame([("a", 0.0, 2.0), ("a", 1.0, 3.0), ("a", 5.0, 6.0), ("a", 7.0, 7.0), ("a", None, 1.0)], "k string, s double, e double")
    assert islands.covered(spans, ["k"], "s", "e").first().covered == 4.0
    assert one(spark, islands.capped(F.array(F.lit(5), F.lit(9), F.lit(4)), 10)) == [0, 2]
    batches = spark.createDataFrame([(1, i, i == 3) for i in range(8)], "p int, i int, solo boolean")
    assert [r.batch for r in islands.batches(batches, ["p"], [F.col("i")], F.col("solo"), 3).orderBy("i").collect()] == [1, 1, 1, 2, 3, 3, 3, 4]


def test_roots_with_orphans_and_cycles(spark):
    df = spark.createDataFrame([("b", "1", None), ("b", "2", "1"), ("b", "3", "2"), ("b", "4", "gone"), ("b", "5", "6"), ("b", "6", "5")], "book string, id string, up string")
    got = {r.node: (r.root, r.depth) for r in relational.roots(df, "id", "up", ["book"]).collect()}
    assert got == {"1": ("1", 0), "2": ("1", 1), "3": ("1", 2), "4": ("4", 0), "5": (None, None), "6": (None, None)}


def test_upsert_and_as_of(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, relational.insert_or_ignore(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    left = spark.createDataFrame([("u", 5), ("u", 1), ("v", 9), ("u", None)], "u string, t int")
    right = spark.createDataFrame([("u", 2, 20), ("u", 5, 50), ("u", 5, 40), ("u", 6, 60)], "u string, t int, n int")
    got = {(r.u, r.t): r.last_n for r in relational.as_of(left, right, ["u"], "t", ["n"]).collect()}
    assert got == {("u", 5): 50, ("u", 1): None, ("v", 9): None, ("u", None): None}


def test_matching(spark):
    df = spark.createDataFrame([("p", ["the old mill", "", None, "abc"], ["the old mi1l", "another line", "abc"]), ("q", None, [])], "k string, a array<string>, b array<string>")
    assert {tuple(r)[:3] for r in matching.best_matches(df, "k", "a", "b", least=0.9).collect()} == {("p", 0, 0), ("p", 3, 2)}
    assert ("p", 0, 0) in {tuple(r) for r in matching.anchored(df, "k", "a", "b").collect()}


def test_rows_that_arrived_twice(spark):
    df = spark.createDataFrame([(1, "x", 5), (1, "x", 6), (None, "y", 7), (None, "y", 8)], "k int, t string, at int")
    assert once(df, ["k"]).count() == 2 and once_wide(df, ["k"]).count() == 2 and once_wide(df.limit(0), ["k"]).count() == 0


def test_cut_tables(spark):
    from pagewright.session import cut

    df = spark.createDataFrame([(1, "a", None), (2, None, [1])], "k int, t string, a array<int>")
    assert sorted(map(str, cut(df).collect())) == sorted(map(str, df.collect())) and cut(df.limit(0)).count() == 0
    assert "ExistingRDD" not in cut(df)._jdf.queryExecution().toString()
