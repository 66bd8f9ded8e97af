import itertools
import unicodedata

import pytest

from pagewright.llm import lookalike as L


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("соре", "cope"), ("Ｆｕｌｌ　１２", "Full 12"), ("résumé", "résumé"), ("zero​width﻿", "zerowidth"), ("no break here", "no break here"), ("⽔⻓⼈", "水长人"),
        ("ﬁne", "fine"), ("well‐kept", "well-kept"), ("Τhe", "The"), ("ё", "ë"), ("里", "里"), ("a­b", "ab"), ("bro­\nken", "bro-\nken"), ("Ⅳ", "IV"),
    ],
)
def test_same_look(a, b):
    change = L.rewriter()
    assert change(a) == change(b)


@pytest.mark.parametrize(("a", "b"), [("é", "è"), ("a", "A"), ("x²", "x2"), ("①", "1"), ("½", "1/2"), ("a  b", "a b"), ("a\nb", "a b"), ("l", "1"), ("O", "0"), ("末", "未"), ("曰", "日"), ("ß", "ss")])
def test_different_look(a, b):
    change = L.rewriter()
    assert change(a) != change(b)


def test_classes_are_transitive_and_disjoint():
    found = L.classes()
    assert len(list(itertools.chain(*found))) == len(set(itertools.chain(*found)))
    table = L.representatives()
    assert all(rep not in table for rep in table.values())
    assert all(unicodedata.normalize("NFC", r) == r for r in table.values())


def test_representatives_follow_counts():
    assert L.representatives({"，": 9, ",": 2})[","] == "，" and L.representatives({"，": 2, ",": 9})["，"] == ","
    assert L.representatives({"​": 10**6})["​"] == ""


def test_pairs_of_pages(spark):
    long = "The northern lighthouse illuminates the quarry of Selbarholm."
    rows = [
        ("b", "1", long, None), ("b", "2", long.replace("o", "о"), ""), ("b", "3", long, "x"), ("b", "3", long, "x"), ("c", "4", long.replace("e", "е"), None), ("b", "5", "short а", None),
        ("b", "6", "short a", None), ("b", "7", long.upper(), None), (None, "8", long.replace("a", "а"), None), ("b", "9", long.replace("a", "а"), None),
    ]
    df = spark.createDataFrame(rows, "book_id string, page_id string, text string, extraction_text string")
    got = {tuple(r) for r in L.same_look(df, "book_id", "page_id", ["text", "extraction_text"], L.corpus_table(df, ["text", "extraction_text"])).collect()}
    assert got == {("text", "1", "2"), ("text", "1", "9"), ("text", "2", "3"), ("text", "2", "9"), ("text", "3", "9")}
    empty = df.limit(0)
    assert L.same_look(empty, "book_id", "page_id", ["text"], L.corpus_table(empty, ["text"])).count() == 0


def test_one_form_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "ｃat", "о"), (2, None, ""), (3, "cat", "o" * 20000)], "s int, text string, c string")
    got = {r.s: r for r in L.canonical(df, ["text"], L.corpus_table(df, ["text"])).collect()}
    assert got[1].text == got[3].text == "cat" and got[2].text is None and got[1].c == "о"


def test_strata_keep_their_punctuation(spark):
    df = spark.createDataFrame([("水，山，人",)] * 5 + [("a, b",), ("a， b",), ("a, c",)], "text string")
    tables = L.corpus_table(df, ["text"])
    change = L.rewriter(tables)
    assert change("a， b") == "a, b" and change("水,山") == "水，山"


def test_classes_with_links(spark):
    text = "The northern lighthouse records the quarry of a village, No. 7"
    rows = [("a", "b", text, None), ("b", "b", text, ""), ("c", "b", text.replace("a", "а"), None), ("d", "b", text + "!", None), ("e", "other", text.replace("a", "а"), None), ("f", None, text, None), ("c", "b", text.replace("a", "а"), None)]
    df = spark.createDataFrame(rows, "page_id string, book_id string, text string, extraction_text string")
    fields = ["text", "extraction_text"]
    got = L.look_classes(df, "book_id", "page_id", fields, L.corpus_table(df, fields)).collect()
    assert {r.i for r in got} == {"a", "b", "c"} and len(got) == 3 and len({(r.f1, r.f2) for r in got}) == 1 and len({(r.r1, r.r2) for r in got}) == 2
    pairs = {tuple(r) for r in L.same_look(df, "book_id", "page_id", fields, L.corpus_table(df, fields)).collect()}
    assert pairs == {("text", "a", "c"), ("text", "b", "c")}
