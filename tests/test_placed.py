"""Operators on places and orders against plain Python."""

import random
from itertools import accumulate

from pyspark.sql import functions as F

from pagewright.functions import scanners
from pagewright.functions import text as T
from pagewright.operators import islands, matching, relational
from pagewright.sources import records


def test_scanners():
    assert scanners.balanced(r"a{b\}{c}}% }" + "\n") and not scanners.balanced("}{") and not scanners.balanced("{")
    assert scanners.environments(r"\begin{a}\begin{b}\end{b}\end{a}") and not scanners.environments(r"\begin{a}\begin{b}\end{a}\end{b}") and not scanners.environments(r"\end{a}")
    text = r"x \& {a & b} \begin{m} & \end{m} y & z & % &" + "\n"
    assert scanners.mark_count(text) == 2 and text[scanners.first_mark(text)] == "&" and scanners.before_mark(text).endswith("y ") and scanners.after_mark(text).startswith(" z")
    assert scanners.first_mark("no") is None and scanners.after_mark("no") is None and scanners.before_mark("no") == "no"


def test_scanned_rows(spark):
    df = spark.createDataFrame([(1, "{}", "x"), (2, None, "x"), (3, "", "x"), (4, "{" * 50000, "x")], "k long, text string, balanced string")
    assert [tuple(r) for r in scanners.scanned(df, "k", "text", {"balanced": scanners.balanced}, "boolean").orderBy("k").collect()] == [(1, True), (2, None), (3, True), (4, False)]
    assert scanners.scanned(df.limit(0), "k", "text", {"balanced": scanners.balanced}, "boolean").count() == 0


def test_prefix_sums_of_a_hot_group(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.choice([1, 2, None]), i) for i in range(4000)] + [(None, 7, 5, 7), (None, 9, 1, 9)]
    rng.shuffle(rows)
    got = {(r.g, r.at): (r.before, r.whole) for r in relational.prefix_sums(spark.createDataFrame(rows, "g string, at int, v int, part int"), ["g"], ["at"], F.col("v")).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == g)
        sums = list(accumulate((r[2] or 0 for r in mine), initial=0))
        want |= {(g, r[1]): (s, sums[-1]) for r, s in zip(mine, sums, strict=False)}
    assert got == want
    empty = spark.createDataFrame([], "g string, at int")
    assert relational.prefix_sums(empty, ["g"], ["at"], F.lit(1)).count() == 0


def test_deep_trees(spark):
    rows = [("b", str(i), str(i - 1) if i else None, i % 37 == 5) for i in range(150)] + [("b", "x", "y", False), ("b", "y", "x", False)]
    df = spark.createDataFrame(rows, "book string, id string, up string, good boolean")
    got = {r.node: r for r in relational.paths(df, "id", "up", ["book"], "id").collect()}
    assert all((got[str(i)].root, got[str(i)].depth, got[str(i)].path) == ("0", i, "/".join(map(str, range(i + 1)))) for i in range(150)) and got["x"].root is None and got["y"].path is None
    near = {r.node: (r.found, r.depth) for r in relational.nearest_above(df, "id", "up", ["book"], F.col("good")).collect()}
    assert near == {str(i): (str(at), i - at) for i in range(5, 150) for at in [max(k for k in range(5, i + 1) if k % 37 == 5)]}


def test_bands():
    box = lambda y, h=0.05: (0.1, y, 0.9, y + h)
    assert abs(matching.band_score(box(0.1), box(0.1)) - 1) < 1e-9 and matching.band_score(box(0.1), box(0.5)) < 0


def test_assigned_bands(spark):
    box = lambda y, h=0.05: [0.1, y, 0.9, y + h]
    rows = [("p", [box(0.1), None, box(0.3), box(0.5, 0.4)], [box(0.1), box(0.2), box(0.3), box(0.6)]), ("q", [], [box(0.1)]), ("r", None, None), ("s", [[0.1, None, 0.2, 0.3]], [box(0.1)])]
    df = spark.createDataFrame(rows, "k string, a array<array<double>>, b array<array<double>>")
    # the second has no box, the last is too tall to anchor; both are paired in the gaps
    assert sorted(tuple(r) for r in matching.assigned_bands(df, "k", "a", "b").collect()) == [("p", 0, 0), ("p", 1, 1), ("p", 2, 2), ("p", 3, 3), ("s", 0, 0)]


def test_matches_need_near_boxes(spark):
    line = "array<struct<text: string, bbox: array<double>>>"
    rows = [("p", [("a long enough line", [0.1, 0.1, 0.5, 0.2]), ("another line here", None)], [("a long enough line", [0.1, 0.8, 0.5, 0.9]), ("another line here", [0.1, 0.8, 0.5, 0.9])])]
    df = spark.createDataFrame(rows, f"k string, a {line}, b {line}")
    assert [(r.line_no, r.match_no) for r in matching.best_matches(df, "k", "a", "b").collect()] == [(1, 1)]


def test_gutters(spark):
    mass = [3] * 40 + [0] * 5 + [2] * 5 + [0] * 5 + [4] * 45
    df = spark.createDataFrame([("p", i, m) for i, m in enumerate(mass)] + [("q", i, 0) for i in range(100)], "p string, x int, m int")
    assert [tuple(r) for r in islands.gutters(df, "p", "x", "m", 28, 71, 2, 20).collect()] == [("p", 40, 5)]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_text_rules(spark):
    assert one(spark, T.redact(F.lit('k3y {"API_KEY": "abc", "x": "https://a.b/c"} data:image/png;base64,QUJD'), "k3y")) == '[hidden] {"API_KEY": "[hidden]", "x": "https://a.b/c"} [data]'
    for spec, pages, want in (("odd", 5, [1, 3, 5]), ("even", 1, []), ("even", 4, [2, 4]), ("3，1-2", 4, [1, 2, 3]), ("1-9", 4, None), ("2-", 4, None), ("5-2", 9, None)):
        assert one(spark, T.selection(F.lit(spec), F.lit(pages))) == want, spec
    for url, want in (("https://a.b:80/c", True), ("https://u:p@a.b", False), ("ftp://a.b", False), ("https://a.b/?q", False), ("https://a.b/#f", False)):
        assert (one(spark, T.base_url(F.lit(url))) is not None) is want, url
    assert [one(spark, T.url_path(F.lit(x))) for x in ("", "v1", "/v1", "//h/x", "a/../b", "x?y")] == ["", "/v1", "/v1", None, None, None]
    doc = "% c\n\\RequirePackage[a]{b}\n\\PassOptionsToClass{x}{y}\\documentclass[12pt]{book}"
    assert one(spark, T.is_tex_document(F.lit(doc))) and not one(spark, T.is_tex_document(F.lit("text \\documentclass{book}")))


def test_contained_paths(spark):
    rows = ["a/b", "../a", "a/../../b", "a/../b", "/srv/x", "/srv/../x", "/etc/x", "C:\\x", "", None]
    got = {r.p: r.inside for r in records.contained(spark.createDataFrame([(x,) for x in rows], "p string"), "p", "/srv").collect()}
    assert got == {"a/b": True, "../a": False, "a/../../b": False, "a/../b": True, "/srv/x": True, "/srv/../x": False, "/etc/x": False, "C:\\x": False, "": False, None: None}


def test_bad_records_stay_apart(spark, tmp_path):
    (tmp_path / "x").write_text('{"k": 1, "body": "{}"}\n{"k": 2, "body": "{"}\nnot json\n{"k": 4, "body": null}\n')
    got = [(r.k, r.outcome) for r in records.isolated(spark, str(tmp_path), "k int, body string", "body").collect()]
    assert sorted(got, key=str) == sorted([(1, "row"), (2, "error"), (None, "error"), (4, "error")], key=str)
