"""Lines that repeat within one source (a book): found by counting pages, removed by a join back.

Lines are normalised to their letters (look-alikes folded, case, spacing, punctuation and digits dropped) and hashed. Each page
adds a hash once; pages per (book, hash) are counted with map-side combine. A frequent line stands on at least a fifth of a
book's pages, so a book has at most five times as many as a page has lines: that table stays small, and it is joined back
salted, because one book, and one line in it, may hold a third of all rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.lookalike import rewriter

#: Parts of each (book, line) group in the join back.
SALT = 16


class _Letters(dict):
    """Translation table that keeps letters and marks; filled as characters are met."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        kept = c if c == "\n" else c.casefold() if unicodedata.category(c)[0] in "LM" else None
        self[code] = kept
        return kept


@lru_cache(maxsize=1)
def letters() -> dict:
    return _Letters({i: _Letters().__missing__(i) for i in range(128)})


def line_keys(text: str) -> list[str]:
    """The letters of each line (split at line feeds); '' for a line without a letter."""
    return rewriter()(text).translate(letters()).split("\n")


def hashed_lines(pages: DataFrame) -> DataFrame:
    """(book_id, page_id, line_no, key) of every line with a letter of `pages` (page_id, book_id, text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest as digest

        for batch in batches:
            books, ids = batch.column("book_id"), batch.column("page_id")
            take, line, key = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text:
                    for n, k in enumerate(line_keys(text)):
                        if k:
                            take.append(i)
                            line.append(n)
                            key.append(digest(k) - (1 << 63))
            where = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([books.take(where), ids.take(where), pa.array(line, pa.int32()), pa.array(key, pa.int64())], names=["book_id", "page_id", "line_no", "key"])

    return pages.select("book_id", "page_id", "text").mapInArrow(run, "book_id string, page_id string, line_no int, key long")


def frequent_lines(pages: DataFrame, least_pages: int = 5, share: float = 0.2, keep: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """(book_id, page_id, line_no) of lines whose like stands on at least `least_pages` pages and on a `share` of the book's
    pages with non-empty text. Rows of one page_id are one page, however often they arrived. Null and empty texts have no lines; a null
    book is a book of its own; lines without a letter never count. `keep` cuts the lineage of the hashed lines, which are read twice;
    texts are read once and never shuffled."""
    lines = keep(hashed_lines(pages))
    counted = lines.groupBy("book_id", "key", "page_id").agg(F.lit(1).alias("one")).groupBy("book_id", "key").agg(F.count("*").alias("n"))
    sizes = pages.where("text <> ''").select("book_id", "page_id").distinct().groupBy("book_id").agg(F.count("*").alias("pages"))
    frequent = (
        counted.where(F.col("n") >= least_pages)
        .join(sizes, counted["book_id"].eqNullSafe(sizes["book_id"]))
        .where(F.col("n") >= share * F.col("pages"))
        .select(counted["book_id"].alias("b"), F.col("key").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("s"))
    )
    salted = lines.withColumn("salt", F.pmod(F.hash("page_id"), F.lit(SALT)))
    met = salted.join(frequent, salted["book_id"].eqNullSafe(frequent["b"]) & (salted["key"] == frequent["k"]) & (salted["salt"] == frequent["s"]))
    return met.select("book_id", "page_id", "line_no").distinct()


def without_lines(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, text): every page's text without the lines of `found` (page_id, line_no); a null text stays null."""
    cut = found.groupBy("page_id").agg(F.collect_set("line_no").alias("cut"))  # no more than a page has lines
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (x, i) -> not array_contains(cut, i)), '\\n')")
    return pages.join(cut, "page_id", "left").select("page_id", F.when(F.col("cut").isNull(), F.col("text")).otherwise(kept).alias("text"))

