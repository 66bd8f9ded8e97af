"""Queries over nested page content: blocks, lines, spans, cells and regions as arrays inside a row, without an explode where the
built-in higher-order functions can say it. Added to those of `reference`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.operators import relational as R
from pagewright.plans.reference import books, files, pages, query

#: Elements of blocks_json, where it is an array; valid layouts.
BLK = """, blk as (select page_id, cast(je.key as bigint) as ord, je.value as b from pg, json_each(case when json_valid(blocks_json) and json_type(blocks_json) = 'ARRAY' then blocks_json end) je where json_type(je.value) = 'OBJECT')
"""
LAY = """, lay as (select * exclude (layout_source_json), case when json_valid(layout_source_json) and json_type(layout_source_json) = 'OBJECT' then layout_source_json end as l from pg)
"""
SPANS = "array<struct<spans: array<struct<text: string>>, latex: string, number: string>>"
BLOCK = f"struct<type: string, role: string, text: string, latex: string, level: string, lines: {SPANS}, cells: array<struct<lines: {SPANS}>>>"


def valid(column: str, kind: str) -> Column:
    """A JSON text if it is whole and begins as `[` or `{`, else null."""
    return F.when(F.try_parse_json(column).isNotNull() & F.ltrim(column).startswith(kind), F.col(column))


def blocks(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per block (an object) of blocks_json: page_id, ord, b."""
    array = F.from_json(valid("blocks_json", "["), "array<string>")
    got = pages(s, d, "blocks_json", *columns).select("page_id", *columns, F.posexplode(array).alias("ord", "b"))
    return got.where(F.col("b").startswith("{")).withColumn("ord", F.col("ord").cast("bigint"))


def layouts(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return pages(s, d, "layout_source_json", *columns).withColumn("l", valid("layout_source_json", "{")).drop("layout_source_json")


def get(path: str, column: str = "l") -> Column:
    return F.get_json_object(column, path)


# --- projection of nested records ---------------------------------------------------------------------------------------

_SAY = "coalesce(list_aggregate(list_transform({}, lambda x: coalesce(list_aggregate(list_transform(x.spans, lambda y: y.text), 'string_agg', ''), '')), 'string_agg', {}), '')"


@query(BLK + """, typed as (select page_id, ord, from_json(b, '{"type":"VARCHAR","latex":"VARCHAR","lines":[{"spans":[{"text":"VARCHAR"}],"latex":"VARCHAR","number":"VARCHAR"}],"cells":[{"lines":[{"spans":[{"text":"VARCHAR"}]}]}]}') as b from blk
  where b->>'$.type' in ('text', 'equation', 'table', 'latex', 'figure')),
 said as (select page_id, ord, case b.type when 'latex' then coalesce(b.latex, '') when 'text' then """ + _SAY.format("b.lines", "chr(10)") + """
  when 'equation' then coalesce(list_aggregate(list_transform(b.lines, lambda x: coalesce(x.latex, '') || case when x.number <> '' then ' ' || x.number else '' end), 'string_agg', chr(10)), '')
  when 'table' then coalesce(list_aggregate(list_transform(b.cells, lambda c: """ + _SAY.format("c.lines", "' '") + """), 'string_agg', chr(10)), '') else '' end as t from typed)
 select page_id, string_agg(t, chr(10) || chr(10) order by ord) as plain from said group by page_id""")
def prj15_content_text(s: SparkSession, d: str) -> DataFrame:
    """The plain text of nested content: spans joined, lines by a line feed, the lines of a cell by a space, blocks by a blank line."""
    array = F.filter(F.from_json(valid("blocks_json", "["), f"array<{BLOCK}>"), lambda b: b["type"].isin("text", "equation", "table", "latex", "figure"))
    spans = lambda x: F.array_join(F.transform(F.coalesce(x["spans"], F.array()), lambda y: y["text"]), "")
    join = lambda lines, by: F.coalesce(F.array_join(F.transform(lines, lambda x: F.coalesce(spans(x), F.lit(""))), by), F.lit(""))
    number = lambda x: F.when(x["number"] != "", F.concat(F.lit(" "), x["number"])).otherwise("")
    said = lambda b: (
        F.when(b["type"] == "latex", F.coalesce(b["latex"], F.lit("")))
        .when(b["type"] == "text", join(b["lines"], "\n"))
        .when(b["type"] == "equation", F.coalesce(F.array_join(F.transform(b["lines"], lambda x: F.concat(F.coalesce(x["latex"], F.lit("")), number(x))), "\n"), F.lit("")))
        .when(b["type"] == "table", F.coalesce(F.array_join(F.transform(b["cells"], lambda c: join(c["lines"], " ")), "\n"), F.lit("")))
        .otherwise("")
    )
    return pages(s, d, "blocks_json").select("page_id", array.alias("a")).where(F.size("a") > 0).select("page_id", F.array_join(F.transform("a", said), "\n\n").alias("plain"))


@query(LAY + """select page_id, case when result_status is null then null when not coalesce(try_cast(l->>'$.source_readable' as boolean), true) then 'no_result' when l->>'$.source_disposition' = 'page_preserved' then 'page_preserved'
 when l->>'$.source_disposition' = 'regions_preserved' then 'regions_preserved' when coalesce(current_revision_id, '') <> '' and result_status = 'auto_passed' then 'editable'
 when coalesce(current_revision_id, '') <> '' and result_status = 'completed_with_issues' then 'partial_content' else 'no_result' end as category from lay""")
def prj02_outcome_category(s: SparkSession, d: str) -> DataFrame:
    """Ordered rules over a result: none gives null, an unreadable source (readable if not said) no_result, then what is kept, then content."""
    return layouts(s, d, "result_status", "current_revision_id").select("page_id", category().alias("category"))


def category() -> Column:
    kept, has = get("$.source_disposition"), F.coalesce("current_revision_id", F.lit("")) != ""
    return (
        F.when(F.col("result_status").isNull(), None)
        .when(~F.coalesce(get("$.source_readable").try_cast("boolean"), F.lit(True)), "no_result")
        .when(kept.isin("page_preserved", "regions_preserved"), kept)
        .when(has & (F.col("result_status") == "auto_passed"), "editable")
        .when(has & (F.col("result_status") == "completed_with_issues"), "partial_content")
        .otherwise("no_result")
    )


@query(LAY + """select page_id, case when manual_protected = 1 then 'protected_existing' when result_status is null then 'no_result' when l->>'$.source_disposition' in ('page_preserved', 'regions_preserved') then l->>'$.source_disposition'
 when coalesce(current_revision_id, '') <> '' and result_status = 'auto_passed' then 'editable' when coalesce(current_revision_id, '') <> '' and result_status = 'completed_with_issues' then 'partial_content' else 'no_result' end as shown from lay""")
def prj03_override(s: SparkSession, d: str) -> DataFrame:
    """What is protected comes before its category; without one, no_result."""
    shown = F.when(F.col("manual_protected") == 1, "protected_existing").otherwise(F.coalesce(category(), F.lit("no_result")))
    return layouts(s, d, "result_status", "current_revision_id", "manual_protected").select("page_id", shown.alias("shown"))


def optional(df: DataFrame, **wanted: object) -> DataFrame:
    """A predicate for each argument that is given."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


@query("select page_id, status, page_kind from pg where status = 'ready'")
def prj06_optional_filter(s: SparkSession, d: str) -> DataFrame:
    return optional(pages(s, d, "status", "page_kind"), status="ready", page_kind=None).select("page_id", "status", "page_kind")


@query("select p as wanted, count(*) as n from pg, (values (null), ('ready'), ('failed')) v(p) where p is null or pg.status = p group by p")
def prj07_nullable_parameter(s: SparkSession, d: str) -> DataFrame:
    """A parameter that may be null is no restriction: one pass over the counts of each status."""
    counts = pages(s, d, "status").groupBy("status").agg(F.count("*").alias("c"))
    wanted = s.createDataFrame([(None,), ("ready",), ("failed",)], "wanted string")
    return wanted.join(F.broadcast(counts), F.col("wanted").isNull() | (F.col("status") == F.col("wanted"))).groupBy("wanted").agg(F.sum("c").alias("n"))


@query(LAY + """select page_id, case when status in ('processing', 'uploaded') then 'interrupted' else status end as state, try_cast(l->>'$.canvas_width_bp' as double) as width,
 case when json_type(l, '$.regions') = 'ARRAY' then json_array_length(l, '$.regions') end as regions from lay""")
def prj09_row_decode(s: SparkSession, d: str) -> DataFrame:
    """Nested JSON as typed columns; a state of an older release gets its name of today."""
    state = F.when(F.col("status").isin("processing", "uploaded"), "interrupted").otherwise(F.col("status"))
    regions = get("$.regions")
    count = F.when(regions.startswith("["), F.json_array_length(regions).cast("bigint"))
    return layouts(s, d, "status").select("page_id", state.alias("state"), get("$.canvas_width_bp").try_cast("double").alias("width"), count.alias("regions"))


_KEPT = {"font_family": "songti", "margin_mm": "20", "paragraph_indent": "2", "line_height": "1.5"}


@query(""", d as (select unnest(['font_family', 'margin_mm', 'paragraph_indent', 'line_height']) as field, unnest(['songti', '20', '2', '1.5']) as preset),
 v as (select id, file_no, case when json_valid(layout_json) and json_type(layout_json) = 'OBJECT' then layout_json end as l from bk)
 select id, file_no, field, coalesce(l->>('$.' || field), preset) as value from v, d""")
def prj10_defaults(s: SparkSession, d: str) -> DataFrame:
    """The fields of a record that are still in use, with presets for those it lacks; retired fields are dropped."""
    own = F.from_json(valid("layout_json", "{"), "map<string,string>")
    presets = F.create_map(*[F.lit(x) for kv in _KEPT.items() for x in kv])
    said = F.map_filter(F.coalesce(own, F.from_json(F.lit("{}"), "map<string,string>")), lambda k, v: k.isin(*_KEPT) & v.isNotNull())
    return books(s, d).select("id", "file_no", F.explode(F.map_zip_with(presets, said, lambda k, a, b: F.coalesce(b, a))).alias("field", "value"))


@query("select page_id, to_json(struct_pack(number := number, source_id := source_id, source_page := source_page, source_version := source_version, position := position, width := width, height := height, status := status, page_kind := page_kind, page_side := page_side, selected := selected))::varchar as frozen from pg")
def prj11_frozen_source(s: SparkSession, d: str) -> DataFrame:
    """A source record as one frozen value, keyed by its page: rows, so that a book's pages are never put into one map."""
    fields = ["number", "source_id", "source_page", "source_version", "position", "width", "height", "status", "page_kind", "page_side", "selected"]
    return pages(s, d, *fields).select("page_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("frozen"))


@query(""", v as (select id, install_id, file_no, content_format, render_strategy, case when json_valid(layout_json) then layout_json end as l from bk)
 select id, file_no, coalesce(l->>'$.font_family', 'songti') as font_family, 'frozen' as content_format, render_strategy from v""")
def prj13_settings_overlay(s: SparkSession, d: str) -> DataFrame:
    """A record overlaid with the settings of one run: fields of a struct replaced, the others kept."""
    record = F.struct(F.coalesce(get("$.font_family", "layout_json"), F.lit("songti")).alias("font_family"), "content_format", "render_strategy")
    return books(s, d).withColumn("layout_json", F.when(F.try_parse_json("layout_json").isNotNull(), F.col("layout_json"))).select("id", "file_no", record.withField("content_format", F.lit("frozen")).alias("r")).select("id", "file_no", "r.*")


@query(BLK + """select page_id, '[' || string_agg(json_object('type', b->>'$.type', 'role', b->>'$.role')::varchar, ',' order by ord) || ']' as shown from blk group by page_id""")
def prj14_without_owned_fields(s: SparkSession, d: str) -> DataFrame:
    """Blocks without the fields the program owns."""
    array = F.filter(F.from_json(valid("blocks_json", "["), "array<struct<type: string, role: string, bbox: string, block_id: string>>"), lambda b: b.isNotNull())
    shown = F.to_json(F.transform(array, lambda b: b.dropFields("bbox", "block_id")), {"ignoreNullFields": "false"})
    return pages(s, d, "blocks_json").select("page_id", F.size(array).alias("n"), shown.alias("shown")).where("n > 0").select("page_id", "shown")


@query("select page_id, string_agg(region_id, ',' order by ord, region_id) as figures from box where kind = 'figure' and x0 is not null and region_id is not null group by page_id")
def prj18_asset_filter(s: SparkSession, d: str) -> DataFrame:
    """Elements that hold a predicate, kept inside the row: located figures, in their order."""
    array = F.from_json(get("$.regions"), "array<struct<region_id: string, kind: string, `order`: bigint, bbox: array<double>>>")
    some = F.filter(array, lambda r: (r["kind"] == "figure") & F.get(r["bbox"], F.lit(0)).isNotNull() & r["region_id"].isNotNull())
    names = F.transform(F.array_sort(F.transform(some, lambda r: F.struct(r["order"].isNull().alias("last"), r["order"], r["region_id"]))), lambda x: x["region_id"])
    return layouts(s, d).select("page_id", F.array_join(names, ",").alias("figures")).where("figures <> ''")


@query("""select id, row_number() over (partition by id order by file_no) as revision, file_no, case when json_valid(layout_json) then layout_json->>'$.font_family' end as font from bk""")
def prj19_history(s: SparkSession, d: str) -> DataFrame:
    """Snapshots of a record in the order of their copies, decoded."""
    font = get("$.font_family", "layout_json")
    b = books(s, d).withColumn("layout_json", F.when(F.try_parse_json("layout_json").isNotNull(), F.col("layout_json")))
    return b.select("id", F.row_number().over(Window.partitionBy("id").orderBy("file_no")).cast("bigint").alias("revision"), "file_no", font.alias("font"))


@query(""", v as (select id, file_no, case when json_valid(layout_json) and json_type(layout_json) = 'OBJECT' then layout_json end as l, lag(title) over (partition by id order by file_no) as old from bk)
 select id, file_no, list_contains(json_keys(l), 'font_size_pt') as provided, case when list_contains(json_keys(l), 'font_size_pt') then l->>'$.font_size_pt' else '11' end as size from v where l is not null""")
def prj20_partial_update(s: SparkSession, d: str) -> DataFrame:
    """An update in which a field that was given, be it null, replaces the old value, and one that wasn't given doesn't."""
    given = F.array_contains(F.json_object_keys("l"), "font_size_pt")
    b = books(s, d).withColumn("l", valid("layout_json", "{")).where("l is not null")
    return b.select("id", "file_no", given.alias("provided"), F.when(given, get("$.font_size_pt")).otherwise("11").alias("size"))


@query("""select page_id, '[' || string_agg(json_object('revision_id', page_id || '-r2', 'kind', kind, 'text', text)::varchar, ',' order by ord) || ']' as stamped from seg group by page_id""")
def prj21_restamp(s: SparkSession, d: str) -> DataFrame:
    """All children of a record get its revision."""
    array = F.from_json(F.when(F.try_parse_json("header_segments_json").isNotNull(), F.col("header_segments_json")), "array<struct<revision_id: string, kind: string, text: string>>")
    stamped = F.transform(array, lambda x: x.withField("revision_id", F.concat("page_id", F.lit("-r2"))))
    return pages(s, d, "header_segments_json").select("page_id", F.size(array).alias("n"), F.to_json(stamped, {"ignoreNullFields": "false"}).alias("stamped")).where("n > 0").select("page_id", "stamped")


@query("""select pg.page_id, pg.book_id, pg.source_page, f.position, f.filename, f.id is null as unjoined from pg left join fl f on f.book_id = pg.book_id and f.id = pg.source_id""")
def prj23_records_in_order(s: SparkSession, d: str) -> DataFrame:
    """Files and page records in position order; records without a file come last. Sorted by ranges, not within one task."""
    f = files(s, d).select("book_id", F.col("id").alias("source_id"), "position", "filename", F.lit(True).alias("there"))
    met = pages(s, d, "book_id", "source_id", "source_page").join(f, ["book_id", "source_id"], "left")
    return met.select("page_id", "book_id", "source_page", "position", "filename", F.col("there").isNull().alias("unjoined")).orderBy("book_id", F.col("position").asc_nulls_last(), "source_page", "page_id")


@query(BLK + "select page_id, page_id || '-b' || cast(ord as varchar) as block_id, b->>'$.type' as kind from blk")
def str28_child_ids(s: SparkSession, d: str) -> DataFrame:
    """Ids of children from their parent's and their place."""
    return blocks(s, d).select("page_id", F.concat("page_id", F.lit("-b"), "ord").alias("block_id"), get("$.type", "b").alias("kind"))


# --- arrays -------------------------------------------------------------------------------------------------------------


@query("""select page_id, string_agg(case when kind = 'page_number' then '#' else text end, '|' order by ord) as replaced from seg group by page_id""")
def arr02_replace_by_key(s: SparkSession, d: str) -> DataFrame:
    """Elements of an array replaced by their key, the others kept."""
    array = F.from_json(F.when(F.try_parse_json("header_segments_json").isNotNull(), F.col("header_segments_json")), "array<struct<kind: string, text: string>>")
    by_key = F.create_map(F.lit("page_number"), F.lit("#"))
    made = F.transform(array, lambda x: F.coalesce(F.try_element_at(by_key, x["kind"]), x["text"]))
    return pages(s, d, "header_segments_json").where(F.size(array) > 0).select("page_id", F.when(F.exists(made, lambda x: x.isNotNull()), F.array_join(made, "|")).alias("replaced"))


@query("""select page_id, array_to_string(list_concat(w[1:1], ['+', '+'], w[2:]), ' ') as spliced from (select page_id, string_split(text, ' ') as w from pg where text <> '')""")
def arr03_splice(s: SparkSession, d: str) -> DataFrame:
    """Elements put into an array at a place."""
    w = F.split("text", " ", -1)
    spliced = F.concat(F.slice(w, 1, 1), F.array(F.lit("+"), F.lit("+")), F.slice(w, F.lit(2), F.size(w)))
    return pages(s, d, "text").where("text <> ''").select("page_id", F.array_join(spliced, " ").alias("spliced"))


@query(BLK + """, cell as (select page_id, ord, cast(t.key as bigint) as c, try_cast(b->>'$.rows' as bigint) as nr, try_cast(b->>'$.columns' as bigint) as nc, try_cast(t.value->>'$.row' as bigint) as r,
  try_cast(t.value->>'$.column' as bigint) as k, coalesce(try_cast(t.value->>'$.row_span' as bigint), 1) as rs, coalesce(try_cast(t.value->>'$.column_span' as bigint), 1) as cs from blk, json_each(b, '$.cells') t where b->>'$.type' = 'table'),
 slot as (select page_id, ord, c, nr, nc, r, k, rs, cs, a.x as sr, e.x as sk from cell, unnest(range(r, r + rs)) a(x), unnest(range(k, k + cs)) e(x))
 select page_id, ord, count(*) as slots, count(*) - count(distinct (sr, sk)) as overlaps, bool_and(r + rs <= nr and k + cs <= nc) as inside from slot group by page_id, ord""")
def arr04_grid(s: SparkSession, d: str) -> DataFrame:
    """The slots that the cells of a table take with their spans: whether they lie inside the table, and how many are taken twice."""
    cell = "struct<`row`: bigint, `column`: bigint, row_span: bigint, column_span: bigint>"
    t = blocks(s, d).where(get("$.type", "b") == "table").select("page_id", "ord", F.from_json("b", f"struct<`rows`: bigint, `columns`: bigint, cells: array<{cell}>>").alias("t"))
    some = t.select("page_id", "ord", F.col("t.rows").alias("nr"), F.col("t.columns").alias("nc"), F.expr("filter(t.cells, c -> c.row is not null and c.column is not null)").alias("cells"))
    slots = F.expr("flatten(transform(cells, c -> flatten(transform(sequence(c.row, c.row + coalesce(c.row_span, 1) - 1), r -> transform(sequence(c.column, c.column + coalesce(c.column_span, 1) - 1), k -> named_struct('r', r, 'k', k))))))")
    inside = F.expr("forall(cells, c -> c.row + coalesce(c.row_span, 1) <= nr and c.column + coalesce(c.column_span, 1) <= nc)")
    return some.withColumn("slot", slots).where(F.size("slot") > 0).select("page_id", "ord", F.size("slot").cast("bigint").alias("slots"), (F.size("slot") - F.size(F.array_distinct("slot"))).cast("bigint").alias("overlaps"), inside.alias("inside"))


@query(BLK + "select page_id, array_to_string((list(b->>'$.type' order by ord))[:3], ',') as first, least(count(*), 3) as kept, count(*) > 3 as more from blk where b->>'$.type' is not null group by page_id")
def arr05_bounded_list(s: SparkSession, d: str) -> DataFrame:
    """At most the first three elements, and whether there are more."""
    kinds = F.filter(F.transform(F.from_json(valid("blocks_json", "["), "array<struct<type: string>>"), lambda b: b["type"]), lambda t: t.isNotNull())
    some = pages(s, d, "blocks_json").select("page_id", kinds.alias("k")).where(F.size("k") > 0)
    return some.select("page_id", F.array_join(F.slice("k", 1, 3), ",").alias("first"), F.least(F.size("k"), F.lit(3)).cast("bigint").alias("kept"), (F.size("k") > 3).alias("more"))


@query(""", o as (select book_id, id, row_number() over (partition by book_id order by position, id) as p, count(*) over (partition by book_id) as n from fl)
 select book_id, id, p as was, case when p = 1 then n else p - 1 end as now from o""")
def arr06_move(s: SparkSession, d: str) -> DataFrame:
    """The first element of each order moved to its end, the others renumbered: no element between needs to be looked at."""
    w = Window.partitionBy("book_id")
    o = files(s, d).select("book_id", "id", F.row_number().over(w.orderBy("position", "id")).cast("bigint").alias("was"), F.count("*").over(w).alias("n"))
    return o.select("book_id", "id", "was", F.when(F.col("was") == 1, F.col("n")).otherwise(F.col("was") - 1).alias("now"))


@query(""", f as (select book_id, id, position, parent_id from fl), t as (select book_id, id, id as root, 0 as depth, lpad(cast(position as varchar), 6, '0') || id as path from f where parent_id is null or not exists (select 1 from f p where p.book_id = f.book_id and p.id = f.parent_id)
  union all select f.book_id, f.id, t.root, t.depth + 1, t.path || '/' || lpad(cast(f.position as varchar), 6, '0') || f.id from f join t on t.book_id = f.book_id and f.parent_id = t.id)
 select book_id, id, root, cast(depth as bigint) as depth, path, row_number() over (partition by book_id order by path) as visit from t""")
def arr07_depth_first(s: SparkSession, d: str) -> DataFrame:
    """Trees of files flattened in depth-first order: root, depth, and a sort key of the places on the way down."""
    f = files(s, d).select("book_id", "id", "parent_id", F.concat(F.lpad(F.col("position").cast("string"), 6, "0"), "id").alias("step"))
    t = R.paths(f, "id", "parent_id", ["book_id"], "step")
    return t.select("book_id", F.col("node").alias("id"), "root", "depth", "path", F.row_number().over(Window.partitionBy("book_id").orderBy("path")).cast("bigint").alias("visit"))


# --- JSON gates ---------------------------------------------------------------------------------------------------------

_KEYS = ["schema_version", "page_kind", "blank", "blocks", "unresolved_spans", "fixed_layout_version"]


@query(f"""select page_id, case when extraction_json is null or extraction_json = '' then 'missing' when not json_valid(extraction_json) then 'broken' when json_type(extraction_json) <> 'OBJECT' then 'not an object'
 when coalesce(extraction_json->>'$.schema_version', '') <> '2' then 'version' when len(list_filter(json_keys(extraction_json), lambda k: k not in ({', '.join(f"'{k}'" for k in _KEYS)}))) > 0 then 'keys'
 when coalesce(json_array_length(extraction_json, '$.blocks'), 0) > 2000 then 'size' else 'good' end as verdict from pg""")
def jsn04_whole_document(s: SparkSession, d: str) -> DataFrame:
    """Gates on a whole document, first that fails: it must decode to an object, of version 2, with known keys only and at most 2,000 blocks."""
    x = F.col("extraction_json")
    keys = F.array_except(F.json_object_keys(x), F.array(*map(F.lit, _KEYS)))
    verdict = (
        F.when(x.isNull() | (x == ""), "missing").when(F.try_parse_json(x).isNull(), "broken").when(~F.ltrim(x).startswith("{"), "not an object")
        .when(F.coalesce(F.get_json_object(x, "$.schema_version"), F.lit("")) != "2", "version").when(F.size(keys) > 0, "keys")
        .when(F.coalesce(F.json_array_length(F.get_json_object(x, "$.blocks")), F.lit(0)) > 2000, "size").otherwise("good")
    )
    return pages(s, d, "extraction_json").select("page_id", verdict.alias("verdict"))


@query(BLK + """select page_id, ord, json_object('type', b->>'$.type', 'role', b->>'$.role', 'latex', b->>'$.latex')::varchar as stripped from blk""")
def jsn03_strip_keys(s: SparkSession, d: str) -> DataFrame:
    """Only trusted keys are read; all others are gone before anything looks at them."""
    return blocks(s, d).select("page_id", "ord", F.to_json(F.from_json("b", "struct<type: string, role: string, latex: string>"), {"ignoreNullFields": "false"}).alias("stripped"))


@query(""", e as (select page_id, cast(t.key as bigint) as ord, t.value->>'$' as reason from pg, json_each(case when json_valid(extraction_json) and json_type(extraction_json) = 'OBJECT' then extraction_json end, '$.unresolved_spans') t)
 select page_id, ord, reason from e""")
def jsn05_errors_with_ordinal(s: SparkSession, d: str) -> DataFrame:
    """An array of findings inside a record as rows with their place."""
    array = F.from_json(F.get_json_object(valid("extraction_json", "{"), "$.unresolved_spans"), "array<string>")
    return pages(s, d, "extraction_json").select("page_id", F.posexplode(array).alias("ord", "reason")).withColumn("ord", F.col("ord").cast("bigint"))


@query(BLK + """, m as (select page_id, ord, b->>'$.type' as kind, trim(coalesce(b->>'$.text', '')) as t, coalesce(case when json_type(b, '$.level') in ('UBIGINT', 'BIGINT') and cast(b->>'$.level' as bigint) between 1 and 6 then cast(b->>'$.level' as bigint) end, 2) as level,
  case when json_type(b, '$.latex') = 'VARCHAR' then b->>'$.latex' else '' end as latex from blk where b->>'$.type' in ('heading', 'paragraph', 'equation', 'quote')),
 h as (select page_id, ord, case when kind = 'heading' and t <> '' and not starts_with(t, '#') then repeat('#', level) || ' ' || t when kind = 'equation' and latex <> '' and not contains(t, latex)
  then case when t <> '' then t || chr(10) || chr(10) else '' end || '$$' || chr(10) || latex || chr(10) || '$$' else t end as t from m)
 select page_id, string_agg(t, chr(10) || chr(10) order by ord) as markdown from h where t <> '' group by page_id""")
def str21_markdown(s: SparkSession, d: str) -> DataFrame:
    """Flat blocks of the older shape as Markdown: headings of their level, equations set apart."""
    array = F.filter(F.from_json(valid("blocks_json", "["), f"array<{BLOCK}>"), lambda b: b["type"].isin("heading", "paragraph", "equation", "quote"))
    level = lambda b: F.coalesce(F.when(b["level"].try_cast("int").between(1, 6), b["level"].try_cast("int")), F.lit(2))

    def said(b: Column) -> Column:
        t, latex = F.trim(F.coalesce(b["text"], F.lit(""))), F.coalesce(b["latex"], F.lit(""))
        shown = F.concat(F.when(t != "", F.concat(t, F.lit("\n\n"))).otherwise(""), F.lit("$$\n"), latex, F.lit("\n$$"))
        head = F.concat(F.repeat(F.lit("#"), level(b)), F.lit(" "), t)
        return F.when((b["type"] == "heading") & (t != "") & ~t.startswith("#"), head).when((b["type"] == "equation") & (latex != "") & ~F.contains(t, latex), shown).otherwise(t)

    return pages(s, d, "blocks_json").select("page_id", F.array_join(F.filter(F.transform(array, said), lambda t: t != ""), "\n\n").alias("markdown")).where("markdown <> ''")
