"""Queries of the general corpus problems: drifting schemas (1) and nested records (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import drift, shred
from pagewright.session import scratch
from pagewright.sources import drifting
from pagewright.sources.tables import KEYS, once_wide, table

PAGE_JSON = {"blocks_json": "pages.blocks_json", "extraction_json": "pages.extraction_json", "layout_source_json": "pages.layout_source_json"}


def drift_records(spark: SparkSession, d: str, once: bool = False) -> DataFrame:
    """The three kinds of drifting records as one table of streams. Rows that arrived twice are here twice; `drift.changes` counts equal
    rows of a stream once."""

    def stream(name: str, key: str, seq: str, ident: str, text: str, version: str) -> DataFrame:
        rows = table(spark, d, name)
        used = [c for c in dict.fromkeys([*KEYS[name], key, seq, ident, text, version]) if c in rows.columns]
        return (once_wide(rows.select(*used), KEYS[name]) if once else rows).selectExpr(
            f"'{name}' as source_table", f"{key} as stream_key", f"cast({seq} as int) as seq", f"{ident} as ident", f"{text} as json", f"cast({version} as double) as version"
        )

    return (
        stream("settings", "install_id", "file_no", "''", "value", "null")
        .union(stream("books", "id", "file_no", "''", "layout_json", "null"))
        .union(stream("pages", "source_id", "source_page", "page_id", "layout_source_json", "layout_schema_version"))
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(drift_records(spark, d))


def p1_schema(spark: SparkSession, d: str) -> DataFrame:
    return drift.union_schema(drift_records(spark, d, once=True))


def _p1_table(spark: SparkSession, d: str, name: str, keys: list[str], text: str) -> DataFrame:
    records = once_wide(table(spark, d, name).selectExpr(*keys, f"{text} as json"), KEYS[name])
    # the union schema of one record kind: as many rows as there are distinct field paths
    kinds = drift.union_schema(records.select(F.lit(name).alias("source_table"), "json")).select("field", "promoted").orderBy("field").collect()
    return drift.unify(records, keys, [(r.field, r.promoted) for r in kinds])


def p1_settings(spark: SparkSession, d: str) -> DataFrame:
    return _p1_table(spark, d, "settings", ["install_id", "file_no"], "value")


def p1_books(spark: SparkSession, d: str) -> DataFrame:
    return _p1_table(spark, d, "books", ["id", "file_no"], "layout_json")


def p1_layouts(spark: SparkSession, d: str) -> DataFrame:
    return _p1_table(spark, d, "pages", ["page_id", "source_id", "source_page", "layout_schema_version"], "layout_source_json")


def p1_files(spark: SparkSession, d: str) -> DataFrame:
    """Settings as files whose headers drift: the records of each copy (file_no) are written with a column for each field that they hold,
    of its type there, and the files are read again as one table through their headers."""
    records = once_wide(table(spark, d, "settings").selectExpr("install_id", "file_no", "value as json"), KEYS["settings"])
    folder = scratch(spark, "drift")
    copies = [r.file_no for r in records.select("file_no").distinct().orderBy("file_no").collect()]  # as many as releases wrote copies
    for n in copies:
        some = records.where(F.col("file_no") == n)
        kinds = drift.union_schema(some.select(F.lit("settings").alias("source_table"), "json")).select("field", "promoted").orderBy("field").collect()
        drift.unify(some, ["install_id", "file_no"], [(r.field, r.promoted) for r in kinds]).coalesce(1).write.parquet(f"{folder}/{n:06d}")
    return drifting.read(spark, drifting.listed(spark, folder))


def _nested(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = once_wide(table(spark, d, "pages").select("page_id", *PAGE_JSON), KEYS["pages"])
    books = once_wide(table(spark, d, "books").select("id", "file_no", "layout_json"), KEYS["books"])
    return pages, books


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pages, books = _nested(spark, d)
    return shred.flat_nodes(pages, "page_id", None, PAGE_JSON).union(shred.flat_nodes(books, "id", "file_no", {"layout_json": "books.layout_json"}))


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    pages, books = _nested(spark, d)
    return shred.flat_values(pages, "page_id", None, PAGE_JSON).union(shred.flat_values(books, "id", "file_no", {"layout_json": "books.layout_json"}))


QUERIES = {f.__name__: f for f in (p1_found, p1_schema, p1_files, p1_settings, p1_books, p1_layouts, p4_found, p4_values)}
_LEAVES = """with recursive src as (select distinct 'settings' as t, install_id as a, cast(file_no as varchar) as b, value as j from settings union all select distinct 'books', id, cast(file_no as varchar), layout_json from books union all select distinct 'pages', page_id, '', layout_source_json from pages),
 up as (select t, a, b, k.key as path, k.value as v from src, json_each(case when json_valid(j) and json_type(j) = 'OBJECT' then j end) k union all
  select t, a, b, up.path || '.' || k.key, k.value from up, json_each(case when json_type(up.v) = 'OBJECT' then up.v end) k),
 leaf as (select t, path, case json_type(v) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' when 'ARRAY' then 'array' when 'OBJECT' then 'object' else 'number' end as kind from up where json_type(v) <> 'OBJECT' or v::varchar = '{}')
"""
SQL: dict[str, str] = {
    "p1_schema": _LEAVES + """select t as source_table, path as field, string_agg(distinct kind, ',' order by kind) as types, case count(distinct kind) filter (kind <> 'null') when 0 then 'null' when 1 then max(kind) filter (kind <> 'null') else 'text' end as promoted, count(*) as records from leaf group by t, path""",
    "p4_found": """with p as (select distinct page_id, blocks_json, extraction_json, layout_source_json from pages),
 src as (select 'pages.blocks_json' as f, page_id as id, 0 as n, blocks_json as j from p union all select 'pages.extraction_json', page_id, 0, extraction_json from p
  union all select 'pages.layout_source_json', page_id, 0, layout_source_json from p union all select distinct 'books.layout_json', id, file_no, layout_json from books),
 dec as (select f, id, n, case when json_type(j) = 'VARCHAR' then case when json_valid(j->>'$') then j->>'$' end else j end as j from src where json_valid(j)),
 o as (select dec.f, dec.id as rid, dec.n, ltrim(replace(replace(replace(substr(t.fullkey, 2), '[', '/'), ']', ''), '.', '/'), '/') as path from dec, json_tree(dec.j) t where t.type = 'OBJECT' and t.fullkey <> '$')
 select f as source_field, rid as record_id, cast(n as integer) as file_no, path as node_path,
 case when regexp_full_match(path, '[0-9/]+') then '' else regexp_replace(path, '(^|/)[^/]*[^0-9/][^/]*(/[0-9]+)*$', '') end as parent_path from o""",
}
