"""Queries of the text problems: pN_found and its companions, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import leakage, lookalike, repeated, scans, spam, tokens
from pagewright.session import cut
from pagewright.sources.tables import KEYS, once_wide, spread, table

FIELDS = ["text", "extraction_text"]


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pages = spread(table(spark, d, "pages").select("page_id", "book_id", *FIELDS))
    return lookalike.same_look(pages, "book_id", "page_id", FIELDS, lookalike.corpus_table(pages, FIELDS), keep=cut)


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every value that has another spelling in its book, with its class, its spelling, and the number of values linked to it."""
    pages = spread(table(spark, d, "pages").select("page_id", "book_id", *FIELDS))
    c = lookalike.look_classes(pages, "book_id", "page_id", FIELDS, lookalike.corpus_table(pages, FIELDS), keep=cut)
    spellings = c.groupBy("field", "f1", "f2", "r1", "r2").agg(F.count("*").alias("same"))
    sizes = spellings.groupBy("field", "f1", "f2").agg(F.sum("same").alias("all"))
    met = c.join(spellings, ["field", "f1", "f2", "r1", "r2"]).join(sizes, ["field", "f1", "f2"])
    name = F.when(F.col("field") == 0, FIELDS[0]).otherwise(FIELDS[1])
    code = lambda a, b: F.concat(F.lpad(F.lower(F.hex(a)), 16, "0"), F.lpad(F.lower(F.hex(b)), 16, "0"))
    return met.select(name.alias("field"), F.col("i").alias("page_id"), code("f1", "f2").alias("class"), code("r1", "r2").alias("spelling"), (F.col("all") - F.col("same")).alias("links"))


def p2_texts(spark: SparkSession, d: str) -> DataFrame:
    """Both fields of every page in the one consistent form."""
    pages = once_wide(table(spark, d, "pages").select("page_id", *FIELDS), KEYS["pages"])
    return lookalike.canonical(pages, FIELDS, lookalike.corpus_table(pages, FIELDS))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    columns = ["page_id", "book_id", "number", *FIELDS, "header_segments_json", "footer_segments_json"]
    return scans.noise(spread(table(spark, d, "pages").select(*columns)), cut)


def p3_texts(spark: SparkSession, d: str) -> DataFrame:
    """Both fields of every page as continuous paragraphs."""
    columns = ["page_id", "book_id", "number", *FIELDS, "header_segments_json", "footer_segments_json"]
    return scans.repaired(once_wide(table(spark, d, "pages").select(*columns), KEYS["pages"]), cut)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pages = spread(table(spark, d, "pages").select("page_id", "book_id", "text"))
    return repeated.frequent_lines(pages, keep=cut).select("page_id", "line_no")


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every page's text without the lines excessive in its book."""
    pages = table(spark, d, "pages").select("page_id", "book_id", "text")
    return repeated.without_lines(once_wide(pages, KEYS["pages"]), repeated.frequent_lines(pages, keep=cut))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(documents(spark, d), "doc_id", "text")


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts decoded from their ids again."""
    return tokens.decode_column(p6_ids(spark, d), "ids", "text").select("doc_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(documents(spark, d), table(spark, d, "eval_items").select("item_id", "text"), keep=cut)


def p7_changed(spark: SparkSession, d: str) -> DataFrame:
    """Documents in which half of an item stands with its numbers, names and units consistently changed (re-parameterised)."""
    return leakage.leaked(documents(spark, d), table(spark, d, "eval_items").select("item_id", "text"), changed=True, keep=cut)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.flagged(documents(spark, d))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of each document's text in each kind of line."""
    return spam.page_shares(documents(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_classes, p2_texts, p3_found, p3_texts, p5_found, p5_texts, p6_ids, p6_decoded, p7_found, p7_changed, p8_found, p8_shares)}
SQL = {
    # decoding gives every text back, an empty one for null
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
