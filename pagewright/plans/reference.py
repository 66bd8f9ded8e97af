"""Queries of the document application's data operators, over its own tables, each with the same query in DuckDB's SQL.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import geometry as G
from pagewright.operators import islands as I
from pagewright.operators import matching as M
from pagewright.operators import relational as R
from pagewright.sources.tables import KEYS, once, once_wide, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = WITH + sql if any(x in sql for x in ("pg", "fl", "at_", "bk", "box", "seg")) else sql
        return f

    return add


#: The tables without second arrivals; the boxes of layout regions; the margin segments.
WITH = """with recursive pg as (select distinct * exclude (ingested_at) from pages), fl as (select distinct * from source_files),
at_ as (select distinct * exclude (ingested_at) from page_attempts), bk as (select distinct * exclude (ingested_at) from books),
box as (select page_id, book_id, je.value->>'$.region_id' as region_id, je.value->>'$.kind' as kind, try_cast(je.value->>'$.order' as bigint) as ord,
  je.value->>'$.parent_id' as parent_id, try_cast(je.value->>'$.bbox[0]' as double) as x0, try_cast(je.value->>'$.bbox[1]' as double) as y0,
  try_cast(je.value->>'$.bbox[2]' as double) as x1, try_cast(je.value->>'$.bbox[3]' as double) as y1
  from pg, json_each(case when json_valid(layout_source_json) then layout_source_json end, '$.regions') je),
seg as (select page_id, book_id, cast(je.key as bigint) as ord, je.value->>'$.kind' as kind, je.value->>'$.text' as text
  from pg, json_each(case when json_valid(header_segments_json) then header_segments_json end) je)
"""


def pages(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Pages once each. Rows that carry texts aren't sorted for it."""
    df = table(s, d, "pages")
    keep = once_wide if not columns or {"text", "extraction_text"} & set(columns) else once
    return keep(df.select(*dict.fromkeys([*KEYS["pages"], *columns])) if columns else df.drop("ingested_at"), KEYS["pages"])


def files(s: SparkSession, d: str) -> DataFrame:
    return once(table(s, d, "source_files"), KEYS["source_files"])


def attempts(s: SparkSession, d: str) -> DataFrame:
    return once(table(s, d, "page_attempts").drop("ingested_at"), KEYS["page_attempts"])


def books(s: SparkSession, d: str) -> DataFrame:
    return once(table(s, d, "books").drop("ingested_at"), KEYS["books"])


def items(df: DataFrame, column: str, path: str | None = None) -> DataFrame:
    """Elements of a JSON array (at `path` of a valid document) with their place: lateral explode with ordinal."""
    valid = F.when(F.try_parse_json(column).isNotNull(), F.col(column))
    array = F.from_json(F.get_json_object(valid, path) if path else valid, "array<string>")
    return df.select("*", F.posexplode(array).alias("_pos", "_item"))


def boxes(s: SparkSession, d: str) -> DataFrame:
    got = items(pages(s, d, "book_id", "layout_source_json"), "layout_source_json", "$.regions")
    get = lambda p: F.get_json_object("_item", p)
    return got.select(
        "page_id", "book_id", get("$.region_id").alias("region_id"), get("$.kind").alias("kind"), get("$.order").try_cast("bigint").alias("ord"), get("$.parent_id").alias("parent_id"),
        *[get(f"$.bbox[{i}]").try_cast("double").alias(n) for i, n in enumerate(G.SIDES)],
    )


def segments(s: SparkSession, d: str) -> DataFrame:
    got = items(pages(s, d, "book_id", "header_segments_json"), "header_segments_json")
    return got.select("page_id", "book_id", F.col("_pos").cast("bigint").alias("ord"), F.get_json_object("_item", "$.kind").alias("kind"), F.get_json_object("_item", "$.text").alias("text"))


def rnd(c: Column) -> Column:
    return F.round(c, 6)


# --- sources and sinks -------------------------------------------------------------------------------------------------


@query("select filename, case when lower(filename) like '%.pdf' then 'pdf' when regexp_matches(lower(filename), '\\.(png|jpe?g)$') then 'image' else 'error' end as handler, count(*) as n from fl group by all")
def src01_dispatch(s: SparkSession, d: str) -> DataFrame:
    name = F.lower("filename")
    handler = F.when(name.endswith(".pdf"), "pdf").when(name.rlike(r"\.(png|jpe?g)$"), "image").otherwise("error")
    return files(s, d).groupBy("filename", handler.alias("handler")).agg(F.count("*").alias("n"))


@query("select book_id, id, filename, unnest(range(1, page_count + 1)) as source_page from fl where kind = 'pdf'")
def src02_pages_of_files(s: SparkSession, d: str) -> DataFrame:
    return files(s, d).where("kind = 'pdf' and page_count > 0").select("book_id", "id", "filename", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("page_count"))).alias("source_page"))


@query("select page_id, number, status, text from pg where not exists (select 1 from at_ where at_.book_id = pg.book_id and at_.page_number = pg.number and at_.attempt > 1)")
def jon09_pages_without_attempt(s: SparkSession, d: str) -> DataFrame:
    """Pages that were never asked for again."""
    again = attempts(s, d).where("attempt > 1").select("book_id", F.col("page_number").alias("number")).distinct()
    return pages(s, d, "book_id", "number", "status", "text").join(again, ["book_id", "number"], "left_anti").select("page_id", "number", "status", "text")


@query("""select id, file_no, title, status from (select *, row_number() over (partition by id order by file_no desc) as r from bk) where r = 1""")
def snk12_upsert_newest(s: SparkSession, d: str) -> DataFrame:
    """Copies of a book in order of their number, each replacing the one before."""
    return R.newest(books(s, d), ["id"], [F.col("file_no").desc()]).select("id", "file_no", "title", "status")


@query("""select book_id, number, text from pg where content_revision > 1 union all select book_id, number, text from pg
 where content_revision <= 1 or content_revision is null""")
def snk13_insert_or_ignore(s: SparkSession, d: str) -> DataFrame:
    p = pages(s, d, "book_id", "number", "text", "content_revision")
    had = p.where("content_revision > 1").select("book_id", "number", "text")
    return R.insert_or_ignore(had, p.select("book_id", "number", "text"), ["book_id", "number"])


@query("""select pg.page_id, pg.number, f.filename, case when pg.layout_source_json is null then 'missing' else 'present' end as layout
 from pg left join fl f on f.book_id = pg.book_id and f.id = pg.source_id""")
def snk01_snapshot_rows(s: SparkSession, d: str) -> DataFrame:
    f = files(s, d).select("book_id", F.col("id").alias("source_id"), "filename")
    return pages(s, d, "book_id", "number", "source_id", "layout_source_json").join(f, ["book_id", "source_id"], "left").select(
        "page_id", "number", "filename", F.when(F.col("layout_source_json").isNull(), "missing").otherwise("present").alias("layout")
    )


# --- projection, JSON --------------------------------------------------------------------------------------------------


@query("""select id, file_no, layout_json->>'$.font_family' as font, try_cast(layout_json->>'$.margin_mm' as double) as margin
 from (select id, file_no, case when json_valid(layout_json) then layout_json end as layout_json from bk)""")
def prj01_json_path(s: SparkSession, d: str) -> DataFrame:
    valid = F.when(F.try_parse_json("layout_json").isNotNull(), F.col("layout_json"))
    return books(s, d).select("id", "file_no", F.get_json_object(valid, "$.font_family").alias("font"), F.get_json_object(valid, "$.margin_mm").try_cast("double").alias("margin"))


@query("""select id, file_no, coalesce(try_cast(layout_json->>'$.line_height' as double), 1.5) as line_height
 from (select id, file_no, case when json_valid(layout_json) then layout_json end as layout_json from bk)""")
def prj04_json_default(s: SparkSession, d: str) -> DataFrame:
    valid = F.when(F.try_parse_json("layout_json").isNotNull(), F.col("layout_json"))
    return books(s, d).select("id", "file_no", F.coalesce(F.get_json_object(valid, "$.line_height").try_cast("double"), F.lit(1.5)).alias("line_height"))


@query("select page_id, status from pg where status in ('ready', 'failed') and text is not null and number <> 1")
def prj05_filters(s: SparkSession, d: str) -> DataFrame:
    return pages(s, d, "status", "text", "number").where(F.col("status").isin("ready", "failed") & F.col("text").isNotNull() & (F.col("number") != 1)).select("page_id", "status")


@query("select id, case when lower(filename) like '%.pdf' then 'pdf' else 'image' end as kind from fl")
def prj08_folded_like(s: SparkSession, d: str) -> DataFrame:
    return files(s, d).select("id", F.when(F.lower("filename").endswith(".pdf"), "pdf").otherwise("image").alias("kind"))


@query("select page_id, book_id, ord, kind, text from seg")
def jon07_lateral_json(s: SparkSession, d: str) -> DataFrame:
    return segments(s, d)


@query("""select page_id, region_id, kind, case when x0 < x1 and y0 < y1 and x0 >= 0 and y0 >= 0 and x1 <= 1 and y1 <= 1 then 'located' else 'unlocated' end as place from box""")
def jsn02_bad_box_downgrade(s: SparkSession, d: str) -> DataFrame:
    good = F.expr("x0 < x1 and y0 < y1 and x0 >= 0 and y0 >= 0 and x1 <= 1 and y1 <= 1")
    return boxes(s, d).select("page_id", "region_id", "kind", F.when(good, "located").otherwise("unlocated").alias("place"))


# --- joins -------------------------------------------------------------------------------------------------------------


@query("select pg.page_id, pg.number, fl.filename, fl.kind, fl.position from pg join fl on fl.book_id = pg.book_id and fl.id = pg.source_id")
def jon01_pages_of_files(s: SparkSession, d: str) -> DataFrame:
    f = files(s, d).select("book_id", F.col("id").alias("source_id"), "filename", "kind", "position")
    return pages(s, d, "book_id", "number", "source_id").join(f, ["book_id", "source_id"]).select("page_id", "number", "filename", "kind", "position")


@query("""select page_id, n // 50 as page_no, n as row_no from (select pg.page_id, row_number() over (partition by pg.book_id
 order by fl.position, pg.source_page, pg.number) - 1 as n from pg join fl on fl.book_id = pg.book_id and fl.id = pg.source_id)""")
def jon04_listing(s: SparkSession, d: str) -> DataFrame:
    f = files(s, d).select("book_id", F.col("id").alias("source_id"), F.col("position").alias("file_position"))
    joined = pages(s, d, "book_id", "number", "source_id", "source_page").join(f, ["book_id", "source_id"])
    return R.page_of(joined, ["book_id"], ["file_position", "source_page", "number"], 50).select("page_id", "page_no", "row_no")


@query("""select pg.page_id, a.attempt, a.returned, a.total_tokens from pg join (select *, row_number() over (partition by book_id, page_number
 order by attempt desc) as r from at_) a on a.book_id = pg.book_id and a.page_number = pg.number and a.r = 1""")
def jon06_newest_attempt(s: SparkSession, d: str) -> DataFrame:
    last = R.newest(attempts(s, d), ["book_id", "page_number"], [F.col("attempt").desc()]).select("book_id", F.col("page_number").alias("number"), "attempt", "returned", "total_tokens")
    return pages(s, d, "book_id", "number").join(last, ["book_id", "number"]).select("page_id", "attempt", "returned", "total_tokens")


@query("select distinct id from bk where exists (select 1 from pg where pg.book_id = bk.id)")
def jon08_semi(s: SparkSession, d: str) -> DataFrame:
    return books(s, d).join(table(s, d, "pages").select(F.col("book_id").alias("id")), "id", "left_semi").select("id").distinct()


@query(""", up as (select book_id, id as node, id as root, 0 as depth from fl where parent_id is null or not exists
 (select 1 from fl p where p.book_id = fl.book_id and p.id = fl.parent_id)
 union all select fl.book_id, fl.id, up.root, up.depth + 1 from fl join up on fl.book_id = up.book_id and fl.parent_id = up.node)
select book_id, node, root, depth from up""")
def jon10_roots(s: SparkSession, d: str) -> DataFrame:
    return R.roots(files(s, d), "id", "parent_id", ["book_id"])


@query("""select book_id, page_id, pos from (select book_id, page_id, row_number() over (partition by book_id order by position, number) - 1 as pos from pg where selected = 1)""")
def jon11_selection_order(s: SparkSession, d: str) -> DataFrame:
    """The place of each selected page in its book's order, joined to the page."""
    chosen = pages(s, d, "book_id", "position", "number", "selected").where("selected = 1")
    return R.prefix_sums(chosen, ["book_id"], ["position", "number", "page_id"], F.lit(1)).select("book_id", "page_id", F.col("before").alias("pos"))


@query("select a.page_id, a.region_id as a_id, b.region_id as b_id from box a join box b on a.page_id = b.page_id and a.region_id < b.region_id where a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1")
def jon14_intersecting(s: SparkSession, d: str) -> DataFrame:
    return G.pairs(boxes(s, d), "page_id", "region_id").where(G.intersects(G.sides("a"), G.sides("b"))).selectExpr("a.page_id as page_id", "a.region_id as a_id", "b.region_id as b_id")


@query("select page_id, region_id, part from box join (values ('left', 0.0, 0.0, 0.5, 1.0), ('right', 0.5, 0.0, 1.0, 1.0), ('top', 0.0, 0.0, 1.0, 0.5), ('whole', 0.0, 0.0, 1.0, 1.0)) v(part, a, b, c, e) on v.a <= x0 and v.b <= y0 and v.c >= x1 and v.e >= y1")
def jon15_containing(s: SparkSession, d: str) -> DataFrame:
    """The parts of a page (four, broadcast) in which each region lies."""
    v = s.createDataFrame([("left", 0.0, 0.0, 0.5, 1.0), ("right", 0.5, 0.0, 1.0, 1.0), ("top", 0.0, 0.0, 1.0, 0.5), ("whole", 0.0, 0.0, 1.0, 1.0)], "part string, a double, b double, c double, e double")
    inside = G.contains([F.col(x) for x in ("a", "b", "c", "e")], [F.col(x) for x in G.SIDES])
    return boxes(s, d).join(F.broadcast(v), inside).select("page_id", "region_id", "part")


@query("""select page_id, arg_min(region_id, (area, region_id)) as region_id from (select page_id, region_id, (x1 - x0) * (y1 - y0) as area from box
 where x0 <= 0.5 and 0.5 <= x1 and y0 <= 0.5 and 0.5 <= y1) group by page_id""")
def jon18_smallest_containing(s: SparkSession, d: str) -> DataFrame:
    return boxes(s, d).where("0.5 between x0 and x1 and 0.5 between y0 and y1").groupBy("page_id").agg(F.min_by("region_id", F.struct(G.area([F.col(c) for c in G.SIDES]), F.col("region_id"))).alias("region_id"))


@query("""select e.event_id, p.event_id as last_event_id from (select * from events where event_type = 'error') e
 asof left join (select * from events where event_type = 'purchase') p on e.user_id = p.user_id and e.ts >= p.ts""")
def jon21_as_of(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", "user_id", "ts", "event_type")
    return R.as_of(e.where("event_type = 'error'").drop("event_type"), e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), ["user_id"], "ts", ["event_id"]).select("event_id", "last_event_id")


@query("""select a.page_id, a.region_id as a_id, b.region_id as b_id from box a join box b on a.page_id = b.page_id and a.region_id < b.region_id
 where least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0.1 and least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.1""")
def jon23_collisions(s: SparkSession, d: str) -> DataFrame:
    w, h = G.overlap(G.sides("a"), G.sides("b"))
    return G.pairs(boxes(s, d), "page_id", "region_id").where((w > 0.1) & (h > 0.1)).selectExpr("a.page_id as page_id", "a.region_id as a_id", "b.region_id as b_id")


@query("""select coalesce(p.book_id, a.book_id) as book_id, coalesce(p.number, a.page_number) as number, case when a.book_id is null then 'left' else 'right' end as side
 from (select distinct book_id, number from pg where selected = 1) p full join (select distinct book_id, page_number from at_ where returned = 1) a on p.book_id = a.book_id and p.number = a.page_number where p.book_id is null or a.book_id is null""")
def jon27_exact_key_sets(s: SparkSession, d: str) -> DataFrame:
    """Keys of selected pages against keys of answered requests: those that only one side has."""
    answered = table(s, d, "page_attempts").where("returned = 1").select("book_id", F.col("page_number").alias("number"))
    return R.same_keys(table(s, d, "pages").where("selected = 1").select("book_id", "number"), answered, ["book_id", "number"])


def _readings(s: SparkSession, d: str) -> DataFrame:
    """Lines of both readings of a page as arrays."""
    return pages(s, d, "text", "extraction_text").where("text <> '' and extraction_text <> ''").select("page_id", F.split("text", "\n").alias("a"), F.split("extraction_text", "\n").alias("b"))


@query()
def jon19_fuzzy_best(s: SparkSession, d: str) -> DataFrame:
    """Lines of the kept text against lines of the first reading of the same page."""
    return M.best_matches(_readings(s, d), "page_id", "a", "b")


@query()
def jon20_anchored(s: SparkSession, d: str) -> DataFrame:
    """Lines of the kept text against lines of the first reading, in order."""
    return M.anchored(_readings(s, d), "page_id", "a", "b")


# --- aggregation -------------------------------------------------------------------------------------------------------


@query("""select book_id, count(*) as pages, count(*) filter (status = 'ready') as ready, count(*) filter (status = 'failed') as failed,
 count(*) filter (result_status is null) as unrated, count(*) filter (manual_protected = 1) as protected from pg group by book_id""")
def agg01_conditional_counts(s: SparkSession, d: str) -> DataFrame:
    return pages(s, d, "book_id", "status", "result_status", "manual_protected").groupBy("book_id").agg(
        F.count("*").alias("pages"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("result_status").isNull()).alias("unrated"), F.count_if(F.col("manual_protected") == 1).alias("protected"),
    )


@query("select book_id, status, render_strategy, count(*) as n from pg group by all")
def agg04_group_counts(s: SparkSession, d: str) -> DataFrame:
    return pages(s, d, "book_id", "status", "render_strategy").groupBy("book_id", "status", "render_strategy").agg(F.count("*").alias("n"))


@query("""select book_id, page_number, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(total_tokens) as bigint) as total_tokens, count(*) > 0 and bool_and(total_tokens is not null) as complete,
 min(sent_at) as first_sent from at_ group by book_id, page_number""")
def agg05_nullable_sums(s: SparkSession, d: str) -> DataFrame:
    """Sums that stay null where nothing is known, completeness, and the first time."""
    return attempts(s, d).groupBy("book_id", "page_number").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("total_tokens").alias("total_tokens"), F.bool_and(F.col("total_tokens").isNotNull()).alias("complete"), F.min("sent_at").alias("first_sent")
    )


@query("select book_id, coalesce(max(number), 0) + 1 as next_number from pg group by book_id")
def agg08_next_number(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").groupBy("book_id").agg((F.coalesce(F.max("number"), F.lit(0)) + 1).alias("next_number"))


@query("""select book_id, round(median(y1 - y0), 6) as height, count(*) as n from box where y1 > y0 group by book_id""")
def agg11_median_height(s: SparkSession, d: str) -> DataFrame:
    return boxes(s, d).where("y1 > y0").groupBy("book_id").agg(rnd(F.median(F.col("y1") - F.col("y0"))).alias("height"), F.count("*").alias("n"))


@query("""select book_id, list_sort(list(w))[least(count(*), cast(floor(count(*) * 0.7) as bigint) + 1)] as w70 from (select book_id, round(x1 - x0, 6) as w from box where x1 > x0) group by book_id""")
def agg13_by_index(s: SparkSession, d: str) -> DataFrame:
    """The value at 70 % of the sorted places, found by rank: no array of a group is built, and no group is one task's."""
    b = boxes(s, d).where("x1 > x0").select("book_id", rnd(F.col("x1") - F.col("x0")).alias("w"))
    c = b.groupBy("book_id", "w").agg(F.count("*").alias("c"))  # equal values have one place
    n = R.prefix_sums(c, ["book_id"], ["w"], F.col("c")).withColumn("at", F.least("whole", F.floor(F.col("whole") * 0.7) + 1))
    return n.where("before < at and at <= before + c").select("book_id", F.col("w").alias("w70"))


@query("select page_id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from box where x0 is not null group by page_id")
def agg16_union_box(s: SparkSession, d: str) -> DataFrame:
    return boxes(s, d).where("x0 is not null").groupBy("page_id").agg(*[(F.min if c.endswith("0") else F.max)(c).alias(c) for c in G.SIDES])


@query("""select book_id, arg_max(page_number, (attempt, returned, -page_number)) as page_number from at_ group by book_id""")
def agg18_lexicographic(s: SparkSession, d: str) -> DataFrame:
    return attempts(s, d).groupBy("book_id").agg(F.max_by("page_number", F.struct("attempt", "returned", -F.col("page_number"))).alias("page_number"))


@query("""select page_id, string_agg(kind, ',' order by first) as kinds from (select page_id, kind, min(ord) as first from box where kind is not null and ord is not null group by page_id, kind) group by page_id""")
def agg19_ordered_distinct(s: SparkSession, d: str) -> DataFrame:
    first = boxes(s, d).where("kind is not null and ord is not null").groupBy("page_id", "kind").agg(F.min("ord").alias("first"))
    return first.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "kind"))), lambda x: x["kind"]), ",").alias("kinds"))


@query("select lang, cast(floor(n_chars / 100) as bigint) as bin, count(*) as n from documents where n_chars is not null group by all")
def agg25_histogram(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("n_chars is not null").groupBy("lang", F.floor(F.col("n_chars") / 100).alias("bin")).agg(F.count("*").alias("n"))


# --- windows, islands, folds -------------------------------------------------------------------------------------------


@query("""select user_id, island, count(*) as n, min(ts) as first, max(ts) as last from (select *, cast(sum(nw) over (partition by user_id order by ts rows unbounded preceding) as bigint) as island
 from (select user_id, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) > 3600000000 then 1 else 0 end as nw from events)) group by user_id, island""")
def win01_islands(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", "ts", F.expr("cast(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) as bigint)").alias("us"))
    return I.islands(e, ["user_id"], "us", F.lit(3600000000)).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query()
def win09_capacity(s: SparkSession, d: str) -> DataFrame:
    """Lines of a page kept within 300 characters; lines that don't fit are passed over. A fold has no SQL form."""
    return pages(s, d, "text").where("text <> ''").select("page_id", F.array_join(I.capped(F.transform(F.split("text", "\n"), lambda x: F.length(x)), 300), ",").alias("kept"))


@query("""select book_id, id, cast(sum(page_count) over w - page_count + 1 as bigint) as starts, cast(sum(page_count) over w as bigint) as ends from fl where page_count is not null window w as (partition by book_id order by position, id rows unbounded preceding)""")
def win10_offsets(s: SparkSession, d: str) -> DataFrame:
    return I.offsets(files(s, d).where("page_count is not null"), ["book_id"], [F.col("position"), F.col("id")], "page_count").select("book_id", "id", "starts", "ends")


@query()
def win11_batches(s: SparkSession, d: str) -> DataFrame:
    """Up to three neighbouring regions together; figures and tables alone."""
    return I.batches(boxes(s, d), ["page_id"], [F.col("ord"), F.col("region_id")], F.col("kind").isin("figure", "table"), 3).groupBy("page_id", "batch").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


@query("""select page_id, cast(floor(((pos + 1) * 4 - 1) / n) as bigint) as chunk from (select page_id, row_number() over (partition by book_id order by number) - 1 as pos, count(*) over (partition by book_id) as n from pg)""")
def win12_chunks(s: SparkSession, d: str) -> DataFrame:
    p = R.prefix_sums(pages(s, d, "book_id", "number"), ["book_id"], ["number", "page_id"], F.lit(1))
    return p.select("page_id", I.chunk_of(F.col("before"), F.col("whole"), F.lit(4)).alias("chunk"))


@query("""select page_id, coalesce(cast(sum(w) over (partition by book_id order by number rows between unbounded preceding and 1 preceding) as bigint), 0) as before from (select page_id, book_id, number, case when status = 'ready' then 1 else 3 end as w from pg)""")
def win13_protected(s: SparkSession, d: str) -> DataFrame:
    need = F.when(F.col("status") == "ready", 1).otherwise(3)
    return R.prefix_sums(pages(s, d, "book_id", "number", "status"), ["book_id"], ["number", "page_id"], need).select("page_id", "before")


@query("select book_id, page_number, max(attempt) filter (returned = 0) as lost, max(attempt) filter (returned = 1) as kept from at_ group by all")
def win14_last_of_each(s: SparkSession, d: str) -> DataFrame:
    return attempts(s, d).groupBy("book_id", "page_number").agg(F.max(F.when(F.col("returned") == 0, F.col("attempt"))).alias("lost"), F.max(F.when(F.col("returned") == 1, F.col("attempt"))).alias("kept"))


@query("select page_id, row_number() over (partition by book_id order by position, number) - 1 as place from pg where status <> 'failed'")
def win16_renumber(s: SparkSession, d: str) -> DataFrame:
    p = pages(s, d, "book_id", "position", "number", "status").where("status <> 'failed'")
    return R.prefix_sums(p, ["book_id"], ["position", "number", "page_id"], F.lit(1)).select("page_id", F.col("before").alias("place"))


# --- order, top-k, sets ------------------------------------------------------------------------------------------------


@query("""select book_id, page_number, attempt, sent_at from at_ where returned = 0 order by sent_at desc, book_id, page_number, attempt limit 5""")
def srt03_newest_errors(s: SparkSession, d: str) -> DataFrame:
    """The five newest lost requests (a top-k report), shown oldest first."""
    top = attempts(s, d).where("returned = 0").orderBy(F.desc("sent_at"), "book_id", "page_number", "attempt").limit(5)
    return top.orderBy("sent_at").select("book_id", "page_number", "attempt", "sent_at")


@query("""select book_id, arg_min(page_id, (coalesce(error = '', true), status <> 'failed', number)) as page_id from pg group by book_id""")
def srt06_boolean_keys(s: SparkSession, d: str) -> DataFrame:
    key = F.struct(F.coalesce(F.col("error") == "", F.lit(True)), F.col("status") != "failed", F.col("number"))
    return pages(s, d, "book_id", "error", "status", "number").groupBy("book_id").agg(F.min_by("page_id", key).alias("page_id"))


@query("""select page_id, len(list_filter(['header', 'body', 'footer'], lambda x: not list_contains(k, x))) as missing, len(list_intersect(k, ['figure', 'column'])) > 0 as pictured
 from (select page_id, list(distinct kind) filter (kind is not null) as k from box group by page_id) where k is not null""")
def set02_differences(s: SparkSession, d: str) -> DataFrame:
    want, seen = F.array(*map(F.lit, ("header", "body", "footer"))), F.array(F.lit("figure"), F.lit("column"))
    k = boxes(s, d).groupBy("page_id").agg(F.collect_set("kind").alias("k")).where(F.size("k") > 0)
    return k.select("page_id", F.size(F.array_except(want, F.col("k"))).cast("bigint").alias("missing"), F.arrays_overlap("k", seen).alias("pictured"))


@query("select page_id, count(*) as n from pages group by page_id having count(*) > 1")
def set06_duplicate_keys(s: SparkSession, d: str) -> DataFrame:
    """Keys of rows that arrived more than once."""
    return table(s, d, "pages").groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1")


@query("select md5(text) as h, count(*) as copies, min(doc_id) as doc_id from documents where text <> '' group by text having count(*) > 1")
def set07_exact_copies(s: SparkSession, d: str) -> DataFrame:
    """Groups of equal texts by hash; the hash of the whole text stands for it in the shuffle."""
    return table(s, d, "documents").where("text <> ''").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id")).where("copies > 1")


# --- scalar functions --------------------------------------------------------------------------------------------------


@query(r"""select doc_id, array_to_string(list_transform(string_split(text, ''), lambda c: case c when '\' then '\textbackslash{}' when '&' then '\&' when '%' then '\%' when '$' then '\$' when '#' then '\#' when '_' then '\_' when '{' then '\{' when '}' then '\}' when '~' then '\textasciitilde{}' when '^' then '\textasciicircum{}' else c end), '') as tex from documents""")
def str01_escape(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.escape_tex(F.col("text")).alias("tex"))


@query()
def str05_plain(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.plain_text(F.col("text")).alias("plain"))


@query("select doc_id, octet_length(encode(text)) as bytes, length(text) as chars, octet_length(encode(text)) > 400 as longer from documents")
def str11_byte_sizes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), F.length("text").cast("bigint").alias("chars"), (F.octet_length("text") > 400).alias("longer"))


@query("select doc_id, case when text is not null then substr(text, 1, coalesce(list_max(list_filter(range(0, 401), lambda n: octet_length(encode(substr(text, 1, n))) <= 400)), 0)) end as head from documents")
def str11_byte_prefix(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.utf8_prefix(F.col("text"), 400).alias("head"))


@query("""select vec_id, case when r in ('-0', '') then '0' else r end as shown from (select vec_id, rtrim(rtrim(printf('%.6f', cast(embedding[1] as double)), '0'), '.') as r from embeddings)""")
def str15_numbers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", T.short_number(F.element_at("embedding", 1).cast("double")).alias("shown"))


@query(r"""select id, file_no, regexp_replace(regexp_replace(title, '[^\p{L}\p{N}_-]+', '-', 'g'), '^-+|-+$', '', 'g') as name from bk""")
def str16_safe_names(s: SparkSession, d: str) -> DataFrame:
    return books(s, d).select("id", "file_no", T.safe_name(F.col("title")).alias("name"))


@query("select page_id, 'v1-' || substr(sha256(page_id || '|' || coalesce(text, '')), 1, 20) as stable from pg")
def str27_stable_ids(s: SparkSession, d: str) -> DataFrame:
    return pages(s, d, "text").select("page_id", T.stable_id("v1-", F.col("page_id"), F.col("text")).alias("stable"))


@query("""select doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') as line from documents""")
def str13_fold_space(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.collapse_space(F.col("text")).alias("line"))


@query("""select page_id, region_id, round(0.5 * x0 + 0.1, 6) as x0, round(0.5 * y0 + 0.2, 6) as y0, round(0.5 * x1 + 0.1, 6) as x1, round(0.5 * y1 + 0.2, 6) as y1 from box where x0 is not null and x0 < x1 and y0 < y1""")
def mth02_mapped_boxes(s: SparkSession, d: str) -> DataFrame:
    box = G.mapped((0.5, 0.0, 0.0, 0.5, 0.1, 0.2), [F.col(c) for c in G.SIDES])
    return boxes(s, d).where("x0 is not null and x0 < x1 and y0 < y1").select("page_id", "region_id", *[rnd(b).alias(c) for b, c in zip(box, G.SIDES, strict=True)])


@query("""select page_id, region_id, cast(floor(x0 * 1400) as bigint) as px0, cast(ceil(y1 * 2000) as bigint) as py1 from box where x0 is not null""")
def mth03_pixels(s: SparkSession, d: str) -> DataFrame:
    px = G.pixels([F.col(c) for c in G.SIDES], F.lit(1400), F.lit(2000))
    return boxes(s, d).where("x0 is not null").select("page_id", "region_id", px[0].alias("px0"), px[3].alias("py1"))


@query("select page_id, round_even(width / 7.0 * 4, 0) / 4 as quarter, round(sqrt(power(width, 2) + power(height, 2)), 6) as diagonal from pg where width is not null and height is not null")
def mth08_rounding(s: SparkSession, d: str) -> DataFrame:
    return pages(s, d, "width", "height").where("width is not null and height is not null").select(
        "page_id", (F.bround(F.col("width") / F.lit(7.0) * 4, 0) / 4).alias("quarter"), rnd(F.hypot(F.col("width").cast("double"), F.col("height").cast("double"))).alias("diagonal")
    )


@query("""select book_id, page_number, attempt, cast(date_diff('second', sent_at, timestamp '2026-01-01') as bigint) as waited from at_ where sent_at is not null""")
def dte02_waited(s: SparkSession, d: str) -> DataFrame:
    return attempts(s, d).where("sent_at is not null").select("book_id", "page_number", "attempt", F.expr("timestampdiff(SECOND, cast(sent_at as timestamp_ntz), timestamp_ntz'2026-01-01 00:00:00')").alias("waited"))


@query("""select page_id, string_agg(coalesce(case kind when 'text' then 'T' when 'page_number' then 'N' end, kind), '' order by ord) as codes from seg group by page_id""")
def arr01_remap(s: SparkSession, d: str) -> DataFrame:
    names = F.create_map(F.lit("text"), F.lit("T"), F.lit("page_number"), F.lit("N"))
    kinds = segments(s, d).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("ord", "kind"))).alias("k"))
    return kinds.select("page_id", F.array_join(F.transform("k", lambda x: F.coalesce(F.try_element_at(names, x["kind"]), x["kind"])), "").alias("codes"))


@query()
def itr02_grown_boxes(s: SparkSession, d: str) -> DataFrame:
    """Boxes grown until none meets another; page by page."""
    return G.grown(boxes(s, d).where("x0 < x1 and y0 < y1"), "page_id")
