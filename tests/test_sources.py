from pagewright.sources import drifting, sidecars


def test_drifting_files(spark, tmp_path):
    shapes = [("select 1 as a, 'x' as b", "0"), ("select cast(2 as bigint) as a, 'y' as b, true as c", "1"), ("select 'three' as a, 1.5D as d", "2"), ("select 'four' as a, 1.5D as d", "3")]
    paths = []
    for sql, name in shapes:
        spark.sql(sql).toPandas().to_parquet(p := f"{tmp_path}/{name}.parquet")
        paths.append(p)
    assert drifting.union_schema(drifting.headers(spark, paths)) == [("a", "string"), ("b", "string"), ("c", "boolean"), ("d", "double")]
    got = sorted(tuple(r) for r in drifting.read(spark, paths).collect())
    assert got == sorted([("1", "x", None, None), ("2", "y", True, None), ("three", None, None, 1.5), ("four", None, None, 1.5)])
    log = {tuple(r)[:3] for r in drifting.differences(drifting.headers(spark, paths)).collect()}
    assert log >= {(1, "added", "c"), (2, "retyped", "a"), (2, "removed", "b"), (2, "removed", "c"), (2, "added", "d")} and not any(x[0] == 3 for x in log)


def test_promotion():
    assert [drifting.promote(*p) for p in (("int", "bigint"), ("bigint", "float"), ("void", "date"), ("date", "timestamp_ntz"), ("boolean", "int"))] == ["bigint", "double", "date", "timestamp_ntz", "string"]


def test_promotion_of_nested_types():
    pairs = [("struct<a:int,b:string>", "struct<a:bigint,c:date>"), ("array<int>", "array<double>"), ("decimal(10,2)", "decimal(8,4)"), ("struct<a:int>", "array<int>"), ("map<string,int>", "map<string,bigint>")]
    assert [drifting.promote(*p) for p in pairs] == ["struct<a:bigint,b:string,c:date>", "array<double>", "decimal(12,4)", "string", "map<string,bigint>"]


def test_structs_merge(spark, tmp_path):
    for n, sql in enumerate(("select 1 as k, named_struct('a', 1, 'b', 'x') as s", "select 2 as k, named_struct('a', 5000000000L, 'c', true) as s", "select 3 as k, cast(null as struct<a: int>) as s")):
        spark.sql(sql).coalesce(1).write.parquet(f"{tmp_path}/{n}")
    paths = drifting.listed(spark, str(tmp_path))
    assert len(paths) == 3
    got = {r.k: None if r.s is None else tuple(r.s) for r in drifting.read(spark, paths).collect()}
    assert got == {1: (1, "x", None), 2: (5000000000, None, True), 3: None}


def test_measurements(spark, tmp_path):
    head = f"{sidecars.MAGIC}\n{','.join(sidecars.HEADER)}\n"
    (tmp_path / "a.csv").write_text(head + "t1,1,2,3,4\nt2,1,-2,3,4\nt3,1,2,3,4\nt3,1,2,3,4\nt4,NaN,1,1,1\nt5,1,1\n")
    (tmp_path / "b.csv").write_text("other\n" + head + "t1,1,2,3,4\n")
    good, bad = sidecars.measurements(spark, str(tmp_path))
    assert [r.token for r in good.collect()] == ["t1"]
    assert sorted((r.token, r.problem) for r in bad.collect()) == [("", "format"), ("t2", "value"), ("t3", "token"), ("t3", "token"), ("t4", "value"), ("t5", "columns")]


def test_log_lines_meet_their_page(spark):
    log = spark.createDataFrame([("d", r"Overfull \hbox (12.5pt too wide) in paragraph at lines 40--41"), ("d", r"Underfull \hbox (badness 10000) detected at line 3"), ("d", "noise")], "doc string, line string")
    pages = spark.createDataFrame([("d", "p1", 10), ("d", "p2", 40)], "doc string, page_id string, start_line int")
    assert sorted(tuple(r)[1:] for r in sidecars.log_warnings(log, pages).collect() if r.page_id) == [("p2", 40, "overfull", "h", 12.5)]
    tall = spark.createDataFrame([("d", r"Overfull \vbox (3.0pt too high) has occurred while \output is active")], "doc string, line string")
    assert [r.page_id for r in sidecars.log_warnings(tall, pages).collect()] == [None]
    got = sidecars.log_warnings(tall, pages.where("page_id = 'p1'")).first()
    assert (got.page_id, got.line_no, got.box, got.amount) == ("p1", None, "v", 3.0)
