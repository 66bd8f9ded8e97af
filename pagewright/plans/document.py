"""More queries of the document application's operators: nested content, overlays, arrays, text functions, layout analytics.

As in `reference`, names begin with the operator's id and rows that arrived twice count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import geometry as G
from pagewright.operators import islands as I
from pagewright.operators import relational as R
from pagewright.plans.reference import attempts, books, boxes, files, items, pages, query, rnd, segments
from pagewright.sources.tables import table



@query(""", b as (select page_id, case when json_valid(blocks_json) then blocks_json end as j from pg), bl as (select page_id, cast(x.key as bigint) as block, x.value as v from b, json_each(b.j) x where json_type(b.j) = 'ARRAY'),
 li as (select page_id, block, cast(y.key as bigint) as line, y.value as v from bl, json_each(bl.v, '$.lines') y),
 sp as (select page_id, block, line, cast(z.key as bigint) as span, z.value->>'$.kind' as kind, z.value->>'$.text' as text from li, json_each(li.v, '$.spans') z)
 select page_id, block, line, count(*) as spans, string_agg(text, '' order by span) as text, arg_max(kind, (length(text), -span)) as kind from sp where text is not null group by page_id, block, line""")
def src10_lines_of_spans(s: SparkSession, d: str) -> DataFrame:
    """Blocks, lines and spans exploded; each line's text and the kind of its longest span."""
    b = items(pages(s, d, "blocks_json").where("ltrim(blocks_json) like '[%'"), "blocks_json")
    lines = b.select("page_id", F.col("_pos").cast("bigint").alias("block"), F.posexplode(F.from_json(F.get_json_object("_item", "$.lines"), "array<string>")).alias("line", "_line"))
    spans = lines.select("page_id", "block", F.col("line").cast("bigint").alias("line"), F.posexplode(F.from_json(F.get_json_object("_line", "$.spans"), "array<struct<kind string, text string>>")).alias("span", "x")).where("x.text is not null")
    parts = F.sort_array(F.collect_list(F.struct("span", "x.text")))  # the spans of one line
    return spans.groupBy("page_id", "block", "line").agg(F.count("*").alias("spans"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), F.max_by("x.kind", F.struct(F.length("x.text"), -F.col("span"))).alias("kind"))


@query("select page_id, number, source_version + 1 as source_version, cast(null as varchar) as result_status from pg where status = 'failed' union all select page_id, number, source_version, result_status from pg where status <> 'failed'")
def snk16_conditional_update(s: SparkSession, d: str) -> DataFrame:
    failed = F.col("status") == "failed"
    return pages(s, d, "number", "status", "source_version", "result_status").where("status is not null").select(
        "page_id", "number", F.when(failed, F.col("source_version") + 1).otherwise(F.col("source_version")).alias("source_version"), F.when(~failed, F.col("result_status")).alias("result_status")
    )


@query("select book_id, page_number, attempt from at_ where not exists (select 1 from (select distinct id from bk where status = 'failed') x where x.id = at_.book_id)")
def snk15_cascading_delete(s: SparkSession, d: str) -> DataFrame:
    gone = table(s, d, "books").where("status = 'failed'").select(F.col("id").alias("book_id")).distinct()
    return attempts(s, d).join(gone, "book_id", "left_anti").select("book_id", "page_number", "attempt")


@query("""select pg.page_id, coalesce(nullif(pg.text, ''), nullif(pg.extraction_text, ''), '') as text, coalesce(b.paper_size, 'a4') as paper from pg
 left join (select * from (select *, row_number() over (partition by id order by file_no desc) r from bk) where r = 1) b on b.id = pg.book_id""")
def prj12_overlay(s: SparkSession, d: str) -> DataFrame:
    """Fields of a page over those of its first reading and its book."""
    b = R.newest(books(s, d), ["id"], [F.col("file_no").desc()]).select(F.col("id").alias("book_id"), "paper_size")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return pages(s, d, "book_id", "text", "extraction_text").join(b, "book_id", "left").select("page_id", F.coalesce(blank("text"), blank("extraction_text"), F.lit("")).alias("text"), F.coalesce("paper_size", F.lit("a4")).alias("paper"))


@query("""select f.book_id, count(*) as files, cast(sum(f.page_count) as bigint) as claimed, string_agg(f.filename, ',' order by f.position, f.id) as names from fl f group by f.book_id""")
def prj22_book_files(s: SparkSession, d: str) -> DataFrame:
    """A book's files in order; a book has few."""
    order = F.sort_array(F.collect_list(F.struct("position", "id", "filename")))
    return files(s, d).groupBy("book_id").agg(F.count("*").alias("files"), F.sum("page_count").alias("claimed"), F.array_join(F.transform(order, lambda x: x["filename"]), ",").alias("names"))


@query(""", up as (select page_id, region_id as node, region_id as at_id, parent_id, kind, 0 as depth from box where region_id is not null union all
 select up.page_id, up.node, b.region_id, b.parent_id, b.kind, up.depth + 1 from up join box b on b.page_id = up.page_id and b.region_id = up.parent_id)
 select page_id, node, arg_min(at_id, depth) as column_id, min(depth) as depth from up where kind = 'column' group by page_id, node""")
def jon22_nearest_ancestor(s: SparkSession, d: str) -> DataFrame:
    """Nearest region at or above each region that is a column."""
    b = boxes(s, d).where("region_id is not null").select("page_id", "region_id", "parent_id", "kind")
    return R.nearest_above(b, "region_id", "parent_id", ["page_id"], F.col("kind") == "column").withColumnRenamed("found", "column_id")


@query("select page_id, bool_or(a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1) as collides from (select * from box where kind = 'figure') a join (select page_id, x0, y0, x1, y1 from box where kind <> 'figure') b using (page_id) where a.x0 is not null and b.x0 is not null group by page_id")
def jon28_collision_gate(s: SparkSession, d: str) -> DataFrame:
    b = boxes(s, d).where("x0 is not null")
    fig, rest = b.where("kind = 'figure'").alias("a"), b.where("kind <> 'figure'").alias("b")
    return fig.join(rest, F.col("a.page_id") == F.col("b.page_id")).groupBy(F.col("a.page_id").alias("page_id")).agg(F.bool_or(G.intersects(G.sides("a"), G.sides("b"))).alias("collides"))


@query("""select pg.page_id, case when f.id is null then 'missing file' when pg.source_page > f.page_count - 1 then 'beyond file' end as problem from pg left join fl f on f.book_id = pg.book_id and f.id = pg.source_id where f.id is null or pg.source_page > f.page_count - 1""")
def jon29_all_or_errors(s: SparkSession, d: str) -> DataFrame:
    """Entries without a file, or beyond its pages, of which the last isn't put out."""
    f = files(s, d).select("book_id", F.col("id").alias("source_id"), "page_count", F.lit(True).alias("there"))
    met = pages(s, d, "book_id", "source_id", "source_page").join(f, ["book_id", "source_id"], "left")
    return met.select("page_id", F.when(F.col("there").isNull(), "missing file").when(F.col("source_page") > F.col("page_count") - 1, "beyond file").alias("problem")).where("problem is not null")


@query("""select book_id, kind, count(*) as n, round(median(y1 - y0), 6) as height, round(max(x1 - x0), 6) as widest from box where y0 < y1 and kind is not null group by all""")
def agg15_style_groups(s: SparkSession, d: str) -> DataFrame:
    h, w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    return boxes(s, d).where("y0 < y1 and kind is not null").groupBy("book_id", "kind").agg(F.count("*").alias("n"), rnd(F.median(h)).alias("height"), rnd(F.max(w)).alias("widest"))


@query("select book_id, max(case status when 'failed' then 3 when 'processing' then 2 when 'uploaded' then 1 else 0 end) as worst, bool_and(status = 'ready') as all_ready, bool_or(error is not null and error <> '') as any_error from pg group by book_id")
def agg17_worst(s: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("status") == "failed", 3).when(F.col("status") == "processing", 2).when(F.col("status") == "uploaded", 1).otherwise(0)
    return pages(s, d, "book_id", "status", "error").groupBy("book_id").agg(F.max(rank).alias("worst"), F.bool_and(F.col("status") == "ready").alias("all_ready"), F.bool_or(F.col("error").isNotNull() & (F.col("error") != "")).alias("any_error"))


@query("select l_linenumber as x, cast(sum(l_quantity) as bigint) as mass, count(*) as n from lineitem group by l_linenumber")
def agg26_projection(s: SparkSession, d: str) -> DataFrame:
    """Sums of a grid along one axis."""
    return table(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("x")).agg(F.sum("l_quantity").cast("bigint").alias("mass"), F.count("*").alias("n"))


@query(""", k as (select page_id, region_id, row_number() over (partition by page_id order by ord, region_id) as slot, x0 is not null as located, y0, x0 from box),
 s as (select page_id, slot, row_number() over (partition by page_id order by slot) as r from k where located), l as (select page_id, region_id, row_number() over (partition by page_id order by y0, x0, region_id) as r from k where located)
 select l.page_id, l.region_id, s.slot from l join s on s.page_id = l.page_id and s.r = l.r union all select page_id, region_id, slot from k where not located""")
def win08_slots(s: SparkSession, d: str) -> DataFrame:
    """Located regions sorted by place among the slots of located ones; the others keep their slot."""
    w = Window.partitionBy("page_id")
    k = boxes(s, d).withColumn("slot", F.row_number().over(w.orderBy("ord", "region_id")).cast("bigint")).withColumn("located", F.col("x0").isNotNull())
    free = k.where("located").select("page_id", "slot", F.row_number().over(w.orderBy("slot")).alias("r"))
    placed = k.where("located").select("page_id", "region_id", F.row_number().over(w.orderBy("y0", "x0", "region_id")).alias("r"))
    return placed.join(free, ["page_id", "r"]).select("page_id", "region_id", "slot").unionByName(k.where("not located").select("page_id", "region_id", "slot"))


@query("""select b.page_id, b.region_id from box b where x0 < x1 and not exists (select 1 from box a where a.page_id = b.page_id and a.region_id <> b.region_id and a.x0 <= b.x0 and a.y0 <= b.y0 and a.x1 >= b.x1 and a.y1 >= b.y1)""")
def win15_not_contained(s: SparkSession, d: str) -> DataFrame:
    b = boxes(s, d)
    a = b.select(F.col("page_id").alias("p"), F.col("region_id").alias("r"), *[F.col(c).alias(f"a{c}") for c in G.SIDES])
    inside = (F.col("p") == F.col("page_id")) & (F.col("r") != F.col("region_id")) & G.contains([F.col(f"a{c}") for c in G.SIDES], [F.col(c) for c in G.SIDES])
    return b.where("x0 < x1").join(a, inside, "left_anti").select("page_id", "region_id")


@query("select page_id, len(a) = len(b) and len(list_intersect(a, b)) = len(a) as same, len(list_intersect(a, b)) = len(a) as within from (select page_id, list(distinct kind) filter (ord < 2) as a, list(distinct kind) as b from box where kind is not null and ord is not null group by page_id) where a is not null")
def set04_set_equality(s: SparkSession, d: str) -> DataFrame:
    k = boxes(s, d).where("kind is not null and ord is not null").groupBy("page_id").agg(F.collect_set(F.when(F.col("ord") < 2, F.col("kind"))).alias("a"), F.collect_set("kind").alias("b")).where("size(a) > 0")
    within, back = F.size(F.array_except("a", "b")) == 0, F.size(F.array_except("b", "a")) == 0
    return k.select("page_id", (within & back).alias("same"), within.alias("within"))


@query()
def str04_images(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.array_join(T.image_names(F.col("text")), ",").alias("images"))


@query(r"""select page_id, try_cast(nullif(regexp_extract(error, '\b([1-5][0-9][0-9])\b', 1), '') as integer) as code, case when regexp_matches(error, '(?i)time') then 'timeout' when regexp_matches(error, '(?i)refus|connect') then 'network' when error is null or error = '' then 'none' else 'other' end as reason from pg""")
def str12_error_classes(s: SparkSession, d: str) -> DataFrame:
    e = F.col("error")
    reason = F.when(e.rlike("(?i)time"), "timeout").when(e.rlike("(?i)refus|connect"), "network").when(e.isNull() | (e == ""), "none").otherwise("other")
    return pages(s, d, "error").select("page_id", F.nullif(F.regexp_extract("error", r"\b([1-5][0-9][0-9])\b", 1), F.lit("")).try_cast("int").alias("code"), reason.alias("reason"))


@query("""select id, file_no, sha256('{"file":"' || filename || '","pages":' || coalesce(cast(page_count as varchar), 'null') || '}') as digest from bk""")
def str26_digest(s: SparkSession, d: str) -> DataFrame:
    """Digest of canonical JSON: sorted keys, compact, nulls kept."""
    canon = F.to_json(F.struct(F.col("filename").alias("file"), F.col("page_count").alias("pages")), {"ignoreNullFields": "false"})
    return books(s, d).select("id", "file_no", F.sha2(canon, 256).alias("digest"))


@query("select page_id, region_id, round(greatest(0.0, x0 - 0.02), 6) as x0, round(least(1.0, x1 + 0.02), 6) as x1, round(greatest(0.0, 0.05 - y0) + greatest(0.0, y1 - 0.95), 6) as over from box where x0 is not null")
def mth04_padding(s: SparkSession, d: str) -> DataFrame:
    zero, one = F.lit(0.0), F.lit(1.0)
    return boxes(s, d).where("x0 is not null").select(
        "page_id", "region_id", rnd(F.greatest(zero, F.col("x0") - 0.02)).alias("x0"), rnd(F.least(one, F.col("x1") + 0.02)).alias("x1"), rnd(F.greatest(zero, 0.05 - F.col("y0")) + F.greatest(zero, F.col("y1") - 0.95)).alias("over")
    )


@query("select page_id, round(width * 72.27 / 72, 6) as width_pt, round(least(595.28 / width, 841.89 / height), 6) as scale, round((595.28 - width * least(595.28 / width, 841.89 / height)) / 2, 6) as left_margin from pg where width > 0 and height > 0")
def mth09_fit(s: SparkSession, d: str) -> DataFrame:
    scale = F.least(F.lit(595.28) / F.col("width"), F.lit(841.89) / F.col("height"))
    return pages(s, d, "width", "height").where("width > 0 and height > 0").select("page_id", rnd(F.col("width") * 72.27 / 72).alias("width_pt"), rnd(scale).alias("scale"), rnd((595.28 - F.col("width") * scale) / 2).alias("left_margin"))


@query("""select id, file_no, try_cast(regexp_replace(created_at, 'Z$', '+00:00') as timestamptz) at time zone 'UTC' as created from bk""")
def dte01_iso_times(s: SparkSession, d: str) -> DataFrame:
    """Times as ISO text in several spellings, in UTC."""
    return books(s, d).select("id", "file_no", F.col("created_at").try_cast("timestamp").alias("created"))


@query("select page_id, string_agg(number, ',' order by ord) as renumbered from (select page_id, ord, text || ':' || (row_number() over (partition by page_id order by ord) - 1) as number from seg where text is not null) group by page_id")
def arr08_renumber(s: SparkSession, d: str) -> DataFrame:
    """Elements of an array renumbered after some were taken out."""
    kept = segments(s, d).where("text is not null").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("x"))
    return kept.select("page_id", F.array_join(F.transform("x", lambda e, i: F.concat(e["text"], F.lit(":"), i.cast("string"))), ",").alias("renumbered"))


@query("""select page_id, region_id, ord, concat_ws(',', case when x0 is null then 'no box' when not (x0 < x1 and y0 < y1) then 'empty box' when x0 < 0 or y0 < 0 or x1 > 1 or y1 > 1 then 'outside' end, case when kind is null then 'no kind' end,
 case when parent_id is not null and not exists (select 1 from box p where p.page_id = box.page_id and p.region_id = box.parent_id) then 'no parent' end) as problems from box""")
def jsn01_salvage(s: SparkSession, d: str) -> DataFrame:
    """Elements kept one by one, each with what is wrong with it."""
    b = boxes(s, d)
    known = b.select("page_id", F.col("region_id").alias("parent_id"), F.lit(True).alias("there")).distinct()
    place = F.when(F.col("x0").isNull(), "no box").when(~F.coalesce(F.expr("x0 < x1 and y0 < y1"), F.lit(False)), "empty box").when(F.expr("x0 < 0 or y0 < 0 or x1 > 1 or y1 > 1"), "outside")
    return b.join(known, ["page_id", "parent_id"], "left").select(
        "page_id", "region_id", "ord", F.concat_ws(",", place, F.when(F.col("kind").isNull(), "no kind"), F.when(F.col("parent_id").isNotNull() & F.col("there").isNull(), "no parent")).alias("problems")
    )


@query("""select layout_schema_version as version, count(*) as n, count(*) filter (json_valid(layout_source_json)) as good, count(*) filter (case when json_valid(layout_source_json) then layout_source_json end->>'$.canvas' is not null) as nested from pg group by 1""")
def jsn06_version_dispatch(s: SparkSession, d: str) -> DataFrame:
    good = F.try_parse_json("layout_source_json").isNotNull()
    nested = F.get_json_object(F.when(good, F.col("layout_source_json")), "$.canvas").isNotNull()
    return pages(s, d, "layout_schema_version", "layout_source_json").groupBy(F.col("layout_schema_version").alias("version")).agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.count_if(nested).alias("nested"))


@query("""select book_id, page_number, max(attempt) as attempt, count(*) as n, coalesce(bool_or(total_tokens is null), false) as unknown from at_ group by all having count(*) > 1""")
def agg10_repeated_requests(s: SparkSession, d: str) -> DataFrame:
    return attempts(s, d).groupBy("book_id", "page_number").agg(F.max("attempt").alias("attempt"), F.count("*").alias("n"), F.bool_or(F.col("total_tokens").isNull()).alias("unknown")).where("n > 1")


@query("select page_id, cast(len(p) as bigint) as n, p[1] as first from (select page_id, string_split(text, chr(10)) as p from pg where text is not null)")
def arr05_split(s: SparkSession, d: str) -> DataFrame:
    p = F.split("text", "\n")
    return pages(s, d, "text").where("text is not null").select("page_id", F.size(p).cast("bigint").alias("n"), F.element_at(p, 1).alias("first"))


@query()
def itr01_growing_rows(s: SparkSession, d: str) -> DataFrame:
    """A page's first region grown by the rows it crosses, three unrolled steps; `crossing` tells whether rows still cross."""
    b = boxes(s, d).where("y0 < y1")
    one = R.newest(b, ["page_id"], [F.col("ord").asc(), F.col("region_id").asc()]).select("page_id", F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    rows = b.select("page_id", "y0", "y1")
    for _ in range(3):
        met = one.join(rows, "page_id").groupBy("page_id", "top", "bottom").agg(F.min(F.when((F.col("y0") < F.col("bottom")) & (F.col("y1") > F.col("top")), F.col("y0"))).alias("lo"), F.max(F.when((F.col("y0") < F.col("bottom")) & (F.col("y1") > F.col("top")), F.col("y1"))).alias("hi"))
        one = met.select("page_id", F.least("top", "lo").alias("top"), F.greatest("bottom", "hi").alias("bottom"))
    crossing = (F.col("y0") < F.col("bottom")) & (F.col("y1") > F.col("top")) & ((F.col("y0") < F.col("top")) | (F.col("y1") > F.col("bottom")))
    return one.join(rows, "page_id").groupBy("page_id", "top", "bottom").agg(F.bool_or(crossing).alias("crossing"))


@query("select book_id, id, floor(coalesce(sum(page_count) over (partition by book_id order by position, id rows between unbounded preceding and 1 preceding), 0) / 40) as volume from fl where page_count is not null")
def win13_volumes(s: SparkSession, d: str) -> DataFrame:
    """Files put into volumes of forty pages by what comes before them."""
    return I.protected(files(s, d).where("page_count is not null"), ["book_id"], [F.col("position"), F.col("id")], "page_count").select("book_id", "id", F.floor(F.col("before") / 40).cast("double").alias("volume"))
