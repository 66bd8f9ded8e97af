from pagewright.llm import repeated as R

SCHEMA = "page_id string, book_id string, text string, key string"


def test_brute_force_on_a_skewed_book(spark):
    rows = []
    for i in range(60):  # one book holds most pages
        lines = [f"Line {i} of body {'abcdefghij'[i % 10] * (i + 1)}"]
        if i % 4 == 0:
            lines.append(f"Scanned  for the Library, copy {i}.")
        if i % 20 == 0:
            lines.append("Rare notice")
        rows.append((f"p{i}", "hot", "\n".join(lines), "x"))
    rows += [(f"q{i}", "cold", "SCANNED FOR THE LIBRARY; COPY\n12 34\n12 34", "x") for i in range(4)]
    rows += [("n", "hot", None, "x"), ("e", "hot", "", "x"), ("l", "hot", "word " * 50000, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    pages, where = {}, []
    for page, book, text, _ in rows:
        for n, k in enumerate(R.line_keys(text) if text else []):
            if k:
                pages.setdefault((book, k), set()).add(page)
                where.append((book, k, page, n))
    size = {b: sum(1 for r in rows if r[1] == b and r[2]) for b in ("hot", "cold")}
    want = {(p, n) for b, k, p, n in where if len(pages[b, k]) >= 5 and len(pages[b, k]) >= 0.2 * size[b]}
    found = R.frequent_lines(df)
    assert {(r.page_id, r.line_no) for r in found.collect()} == want and len(want) == 15
    texts = {r.page_id: r.text for r in R.without_lines(df, found).collect()}
    assert texts["p0"] == "Line 0 of body a\nRare notice" and texts["n"] is None and texts["e"] == "" and texts["q0"] == rows[60][2]


def test_what_makes_lines_alike():
    a, b, c = R.line_keys("Share this page, No. 12!\n  sharе THIS  page (no)\n12 — 34")
    assert a == b and c == ""
    assert R.line_keys("résumé")[0] != R.line_keys("resume")[0]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert R.frequent_lines(df).count() == 0


def test_rows_that_arrive_twice_count_once(spark):
    rows = [(f"p{i}", "b", f"body {'abcdefghij'[i]}\nTHE TITLE {i}" if i < 5 else f"body {'abcdefghij'[i] * 3}", "x") for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(f"p{i}", 1) for i in range(5)}
    for d in (df, df.union(df), df.union(df.limit(4))):
        got = [(r.page_id, r.line_no) for r in R.frequent_lines(d).collect()]
        assert len(got) == len(set(got)) and set(got) == want
