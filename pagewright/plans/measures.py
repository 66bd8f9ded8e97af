"""Rollups, identity joins, geometry, text and response rules over the tables. Added to the queries of `reference`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.operators import geometry as G
from pagewright.plans.content import LAY, get, layouts
from pagewright.plans.reference import attempts, books, boxes, files, pages, query, rnd

# --- rollups ------------------------------------------------------------------------------------------------------------


@query("select book_id, count(*) as n, count(*) filter (case when layout_schema_version >= 2 then current_revision_id is not null else result_status is not null end) as completed from pg group by book_id")
def agg02_completed(s: SparkSession, d: str) -> DataFrame:
    """What completed means depends on the version of the record."""
    done = F.when(F.col("layout_schema_version") >= 2, F.col("current_revision_id").isNotNull()).otherwise(F.col("result_status").isNotNull())
    return pages(s, d, "book_id", "layout_schema_version", "current_revision_id", "result_status").groupBy("book_id").agg(F.count("*").alias("n"), F.count_if(done).alias("completed"))


@query("select book_id, count(*) filter (result_status = 'failed') as failed, count(*) filter (result_status = 'auto_passed') as passed, count(*) filter (result_status is null) as open from pg group by book_id")
def agg03_counts_by_status(s: SparkSession, d: str) -> DataFrame:
    r = F.col("result_status")
    return pages(s, d, "book_id", "result_status").groupBy("book_id").agg(F.count_if(r == "failed").alias("failed"), F.count_if(r == "auto_passed").alias("passed"), F.count_if(r.isNull()).alias("open"))


@query("select (select count(*) from pg) as pages, (select count(*) from at_) as attempts, (select count(*) from at_ where total_tokens is null) as unknown")
def agg09_scalar_counts(s: SparkSession, d: str) -> DataFrame:
    a = attempts(s, d).agg(F.count("*").alias("attempts"), F.count_if(F.col("total_tokens").isNull()).alias("unknown"))
    return pages(s, d, "number").agg(F.count("*").alias("pages")).join(a)


_GAPS = """, o as (select page_id, region_id, y0, y1, y0 - lag(y1) over (partition by page_id order by y0, y1, region_id) as gap from box where y0 < y1),
 t as (select page_id, greatest(1.2 * median(y1 - y0), coalesce(2 * (median(gap) filter (gap > 0)), 0)) as th from o group by page_id)
"""


def gaps(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Bands of each page from top to bottom with the gap before each; and the gap that parts groups of them: 1.2 times the median
    height, or twice the median of the gaps between bands that don't touch, whichever is more."""
    w = Window.partitionBy("page_id").orderBy("y0", "y1", "region_id")
    o = boxes(s, d).where("y0 < y1").select("page_id", "region_id", "y0", "y1", (F.col("y0") - F.lag("y1").over(w)).alias("gap"))
    height, between = F.median(F.col("y1") - F.col("y0")), F.median(F.when(F.col("gap") > 0, F.col("gap")))
    return o, o.groupBy("page_id").agg(F.greatest(1.2 * height, F.coalesce(2 * between, F.lit(0.0))).alias("th"))


@query(_GAPS + "select page_id, round(th, 6) as th from t")
def agg12_gap_threshold(s: SparkSession, d: str) -> DataFrame:
    return gaps(s, d)[1].select("page_id", rnd(F.col("th")).alias("th"))


@query(_GAPS + "select page_id, region_id, cast(sum(case when round(gap - th, 9) > 0 then 1 else 0 end) over (partition by page_id order by y0, y1, region_id rows unbounded preceding) as bigint) as band from o join t using (page_id)")
def win02_bands(s: SparkSession, d: str) -> DataFrame:
    """Groups of bands, parted where a gap is more than the page's threshold."""
    o, t = gaps(s, d)
    w = Window.partitionBy("page_id").orderBy("y0", "y1", "region_id").rowsBetween(Window.unboundedPreceding, 0)
    return o.join(t, "page_id").select("page_id", "region_id", F.sum(F.when(F.round(F.col("gap") - F.col("th"), 9) > 0, 1).otherwise(0)).over(w).alias("band"))


@query(LAY + """, c as (select book_id, page_id, number, l->>'$.body_font_family' as family, try_cast(l->>'$.body_font_size_bp' as double) as size from lay where l->>'$.source_disposition' = 'transcribed'),
 g as (select book_id, family, count(*) as n, min((number, page_id)) as first, median(size) as mid, max(size) / min(size) as spread from c where family is not null and size > 0 group by book_id, family),
 r as (select *, sum(n) over (partition by book_id) as total, row_number() over (partition by book_id order by n desc, first) as place from g)
 select book_id, family, n, round(mid, 6) as size from r where place = 1 and total >= 2 and n >= 0.8 * total and spread <= 1.12""")
def agg14_mode(s: SparkSession, d: str) -> DataFrame:
    """The most frequent font of a book (ties: the one seen first) with the median of its sizes, where at least two pages say one, four
    fifths of them agree, and the largest size is at most 1.12 times the smallest."""
    size = get("$.body_font_size_bp").try_cast("double")
    c = layouts(s, d, "book_id", "number").where(get("$.source_disposition") == "transcribed").select("book_id", "number", "page_id", get("$.body_font_family").alias("family"), size.alias("size")).where("family is not null and size > 0")
    g = c.groupBy("book_id", "family").agg(F.count("*").alias("n"), F.min(F.struct("number", "page_id")).alias("first"), F.median("size").alias("mid"), (F.max("size") / F.min("size")).alias("spread"))
    w = Window.partitionBy("book_id")
    r = g.withColumn("total", F.sum("n").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), "first")))
    return r.where("place = 1 and total >= 2 and n >= 0.8 * total and spread <= 1.12").select("book_id", "family", "n", rnd(F.col("mid")).alias("size"))


@query("""select book_id, arg_max(kind, (weight, n, kind)) as kind, max(n) filter (true) as most, round(max(weight), 6) as weight from (select book_id, kind, count(*) as n, round(sum((x1 - x0) * (y1 - y0)), 6) as weight
 from box where y0 < y1 and x0 < x1 and kind is not null group by book_id, kind) group by book_id""")
def agg15_heaviest_style(s: SparkSession, d: str) -> DataFrame:
    """Of the groups of each book the heaviest, by the greatest tuple."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    g = boxes(s, d).where("y0 < y1 and x0 < x1 and kind is not null").groupBy("book_id", "kind").agg(F.count("*").alias("n"), rnd(F.sum(area)).alias("weight"))
    return g.groupBy("book_id").agg(F.max_by("kind", F.struct("weight", "n", "kind")).alias("kind"), F.max("n").alias("most"), rnd(F.max("weight")).alias("weight"))


@query(""", c as (select book_id, count(*) as total, count(*) filter (status = 'ready') as ready, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'interrupted') as stopped from pg where selected = 1 group by book_id),
 n as (select id, arg_max(status, file_no) as was from bk group by id)
 select n.id as book_id, coalesce(ready, 0) as completed, case when coalesce(total, 0) = 0 then 'uploaded' when was in ('processing', 'pausing') then was when ready = total then 'ready' when was = 'paused' then 'paused'
 when failed > 0 then 'failed' when stopped > 0 then 'interrupted' else 'uploaded' end as status from n left join c on c.book_id = n.id""")
def agg20_book_rollup(s: SparkSession, d: str) -> DataFrame:
    """A book's state from the counts of its pages' states, by ordered rules."""
    st = F.col("status")
    c = pages(s, d, "book_id", "status", "selected").where("selected = 1").groupBy("book_id").agg(F.count("*").alias("total"), F.count_if(st == "ready").alias("ready"), F.count_if(st == "failed").alias("failed"), F.count_if(st == "interrupted").alias("stopped"))
    n = books(s, d).groupBy(F.col("id").alias("book_id")).agg(F.max_by("status", "file_no").alias("was"))
    status = (
        F.when(F.coalesce("total", F.lit(0)) == 0, "uploaded").when(F.col("was").isin("processing", "pausing"), F.col("was")).when(F.col("ready") == F.col("total"), "ready")
        .when(F.col("was") == "paused", "paused").when(F.col("failed") > 0, "failed").when(F.col("stopped") > 0, "interrupted").otherwise("uploaded")
    )
    return n.join(c, "book_id", "left").select("book_id", F.coalesce("ready", F.lit(0)).alias("completed"), status.alias("status"))


@query("select book_id, count(*) filter (result_status is null) as open, count(*) filter (result_status = 'failed') as failed, case when count(*) filter (result_status is null) > 0 then 'refused' when count(*) filter (result_status = 'failed') > 0 then 'failed' else 'succeeded' end as gate from pg group by book_id")
def agg21_finish_gate(s: SparkSession, d: str) -> DataFrame:
    """A run ends only when every page has a result, and fails with any that failed."""
    c = pages(s, d, "book_id", "result_status").groupBy("book_id").agg(F.count_if(F.col("result_status").isNull()).alias("open"), F.count_if(F.col("result_status") == "failed").alias("failed"))
    return c.withColumn("gate", F.when(F.col("open") > 0, "refused").when(F.col("failed") > 0, "failed").otherwise("succeeded"))


_QUALITY = "case when bool_or(status = 'failed') then 'compile_failed' when bool_or(coalesce(result_status, '') in ('completed_with_issues', 'failed')) then 'needs_review' when not bool_and(result_status is not null) then 'unverified' else 'passed' end"


@query(f"select book_id, bool_and(current_revision_id is not null) as complete, count(*) filter (current_revision_id is null) as missing, {_QUALITY} as quality from pg where selected = 1 group by book_id")
def agg22_manifest(s: SparkSession, d: str) -> DataFrame:
    """Whether an output holds every page, and how good it is."""
    has = F.col("current_revision_id").isNotNull()
    return pages(s, d, "book_id", "current_revision_id", "status", "result_status", "selected").where("selected = 1").groupBy("book_id").agg(F.bool_and(has).alias("complete"), F.count_if(~has).alias("missing"), quality().alias("quality"))


def quality() -> Column:
    """The worst of what was found: a failed compilation, errors or warnings, results that nobody checked."""
    result = F.col("result_status")
    return (
        F.when(F.bool_or(F.col("status") == "failed"), "compile_failed").when(F.bool_or(F.coalesce(result, F.lit("")).isin("completed_with_issues", "failed")), "needs_review")
        .when(~F.bool_and(result.isNotNull()), "unverified").otherwise("passed")
    )


@query(f"select book_id, page_kind, {_QUALITY} as quality from pg group by book_id, page_kind")
def agg23_quality(s: SparkSession, d: str) -> DataFrame:
    return pages(s, d, "book_id", "page_kind", "status", "result_status").groupBy("book_id", "page_kind").agg(quality().alias("quality"))


@query("""select page_id, count(*) filter (x0 < 0.05 or y0 < 0.05 or x1 > 0.95 or y1 > 0.95) as outside, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, round(max(greatest(0.05 - x0, 0.05 - y0, x1 - 0.95, y1 - 0.95, 0)) filter (x0 is not null), 6) as overflow,
 count(*) filter (x0 is null) as missing, count(*) filter (kind is null) as unmapped from box group by page_id""")
def agg24_glyphs(s: SparkSession, d: str) -> DataFrame:
    """Conditional aggregates of boxes against a frame, in one pass."""
    out = F.greatest(0.05 - F.col("x0"), 0.05 - F.col("y0"), F.col("x1") - 0.95, F.col("y1") - 0.95, F.lit(0.0))
    return boxes(s, d).groupBy("page_id").agg(
        F.count_if(F.expr("x0 < 0.05 or y0 < 0.05 or x1 > 0.95 or y1 > 0.95")).alias("outside"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        rnd(F.max(F.when(F.col("x0").isNotNull(), out))).alias("overflow"), F.count_if(F.col("x0").isNull()).alias("missing"), F.count_if(F.col("kind").isNull()).alias("unmapped"),
    )


@query("select book_id, page_number, attempt, case when coalesce(input_tokens, output_tokens, total_tokens) is not null then input_tokens is not null and output_tokens is not null and total_tokens is not null end as complete from at_")
def agg27_usage_record(s: SparkSession, d: str) -> DataFrame:
    """Null if nothing is known of a request's usage, else whether all of it is."""
    known = [F.col(c).isNotNull() for c in ("input_tokens", "output_tokens", "total_tokens")]
    return attempts(s, d).select("book_id", "page_number", "attempt", F.when(known[0] | known[1] | known[2], known[0] & known[1] & known[2]).alias("complete"))


# --- identity joins -----------------------------------------------------------------------------------------------------


@query("""select pg.book_id, count(*) filter (f.id is null) as lacking, count(*) filter (f.id is null) = 0 as within from pg left join fl f on f.book_id = pg.book_id and f.id = pg.source_id and pg.source_page <= f.page_count where pg.selected = 1 group by pg.book_id""")
def jon12_subset(s: SparkSession, d: str) -> DataFrame:
    """Whether all pages that a book asks for are among those its files have."""
    f = files(s, d).select("book_id", F.col("id").alias("source_id"), "page_count", F.lit(True).alias("there"))
    met = pages(s, d, "book_id", "source_id", "source_page", "selected").where("selected = 1").join(f, ["book_id", "source_id"], "left")
    lacks = ~F.coalesce(F.col("there") & (F.col("source_page") <= F.col("page_count")), F.lit(False))
    return met.groupBy("book_id").agg(F.count_if(lacks).alias("lacking"), (F.count_if(lacks) == 0).alias("within"))


@query(""", v as (select book_id, source_id, max(source_version) as version from pg where source_id is not null group by all)
 select pg.book_id, bool_and(pg.source_version is not distinct from v.version) as current, count(*) filter (pg.source_version is distinct from v.version) as stale from pg join v on v.book_id = pg.book_id and v.source_id = pg.source_id group by pg.book_id""")
def jon13_versions(s: SparkSession, d: str) -> DataFrame:
    """Versions that pages hold against the version of their file, null-safe."""
    p = pages(s, d, "book_id", "source_id", "source_version").where("source_id is not null")
    v = p.groupBy("book_id", "source_id").agg(F.max("source_version").alias("version"))
    same = F.col("source_version").eqNullSafe(F.col("version"))
    return p.join(v, ["book_id", "source_id"]).groupBy("book_id").agg(F.bool_and(same).alias("current"), F.count_if(~same).alias("stale"))


@query(""", b as (select page_id, region_id, x0, y0, x1, y1, x0 + 0.01 as u0, x1 + 0.01 as u1, (x1 - x0) * (y1 - y0) as area from box where x0 < x1 and y0 < y1),
 m as (select a.page_id, a.region_id as a_id, b.region_id as b_id, greatest(0, least(a.x1, b.u1) - greatest(a.x0, b.u0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) as met, a.area + b.area as areas from b a join b b on b.page_id = a.page_id)
 select page_id, a_id, b_id, round(met / (areas - met), 6) as iou from m where round(met / (areas - met), 9) >= 0.82""")
def jon16_iou(s: SparkSession, d: str) -> DataFrame:
    """Boxes of a page against the same boxes moved a hundredth to the right: pairs of nearly the same place, intersection over union at least 0.82."""
    b = boxes(s, d).where("x0 < x1 and y0 < y1").withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    other = b.select("page_id", F.col("region_id").alias("b_id"), (F.col("x0") + 0.01).alias("u0"), F.col("y0").alias("v0"), (F.col("x1") + 0.01).alias("u1"), F.col("y1").alias("v1"), F.col("area").alias("other"))
    met = F.greatest(F.lit(0.0), F.least("x1", "u1") - F.greatest("x0", "u0")) * F.greatest(F.lit(0.0), F.least("y1", "v1") - F.greatest("y0", "v0"))
    m = b.join(other, "page_id").withColumn("met", met).withColumn("iou", F.col("met") / (F.col("area") + F.col("other") - F.col("met")))
    return m.where(F.round("iou", 9) >= 0.82).select("page_id", F.col("region_id").alias("a_id"), "b_id", rnd(F.col("iou")).alias("iou"))


@query(""", b as (select page_id, region_id, x0, y0, x1, y1 from box where x0 < x1 and y0 < y1), m as (select a.page_id, a.region_id as a_id, b.region_id as b_id from b a join b b on b.page_id = a.page_id and b.region_id <> a.region_id
  and round(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)), 9) >= 0.6)
 select page_id, a_id, min(b_id) as b_id from m group by page_id, a_id having count(*) = 1""")
def jon17_unique_overlap(s: SparkSession, d: str) -> DataFrame:
    """The one other region that holds at least 0.6 of a region; none if there are several."""
    b = boxes(s, d).where("x0 < x1 and y0 < y1").select("page_id", "region_id", *G.SIDES)
    other = b.select("page_id", F.col("region_id").alias("b_id"), *[F.col(c).alias(f"o{c}") for c in G.SIDES])
    met = F.greatest(F.lit(0.0), F.least("x1", "ox1") - F.greatest("x0", "ox0")) * F.greatest(F.lit(0.0), F.least("y1", "oy1") - F.greatest("y0", "oy0")) / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    m = b.join(other, "page_id").where(F.col("b_id") != F.col("region_id")).where(F.round(met, 9) >= 0.6)
    return m.groupBy("page_id", F.col("region_id").alias("a_id")).agg(F.min("b_id").alias("b_id"), F.count("*").alias("n")).where("n = 1").drop("n")


@query(""", o as (select page_id, region_id, kind, x0 from box where region_id is not null), n as (select page_id, region_id, x0 + 0.5 as x0 from box where kind = 'figure' and region_id is not null)
 select o.page_id, o.region_id, coalesce(n.x0, o.x0) as x0, n.region_id is not null as touched from o left join n on n.page_id = o.page_id and n.region_id = o.region_id""")
def jon24_merge_touched(s: SparkSession, d: str) -> DataFrame:
    """Solved elements replace the original ones of their key, the others stay."""
    b = boxes(s, d).where("region_id is not null")
    solved = b.where("kind = 'figure'").select("page_id", "region_id", (F.col("x0") + 0.5).alias("new"), F.lit(True).alias("hit"))
    return b.join(solved, ["page_id", "region_id"], "left").select("page_id", "region_id", F.coalesce("new", "x0").alias("x0"), F.col("hit").isNotNull().alias("touched"))


_SAME = ["install_id", "title", "filename", "status", "error", "created_at", "page_count", "completed_pages", "selection_confirmed", "paper_size", "content_format", "render_strategy", "upload_confirmed", "output_settings_version"]


@query("select a.id, a.file_no, " + " and ".join(f"a.{c} is not distinct from b.{c}" for c in _SAME) + " as same, a.title is not distinct from b.title and a.filename is not distinct from b.filename as alike from bk a join bk b on b.id = a.id and b.file_no = a.file_no + 1")
def jon25_identity(s: SparkSession, d: str) -> DataFrame:
    """Whether a record and its next copy are the same in fourteen fields, null-safe; and in the two that name it."""
    b = books(s, d)
    nxt = b.select("id", (F.col("file_no") - 1).alias("file_no"), *[F.col(c).alias(f"_{c}") for c in _SAME])
    same = lambda names: F.struct(*names).eqNullSafe(F.struct(*[F.col(f"_{c}").alias(c) for c in names]))
    return b.join(nxt, ["id", "file_no"]).select("id", "file_no", same(_SAME).alias("same"), same(["title", "filename"]).alias("alike"))


@query(""", e as (select page_id, number, content_revision as revision, coalesce(current_revision_id, '') as rid from pg), r as (select page_id, case when number % 7 = 0 then content_revision + 1 else content_revision end as revision, coalesce(current_revision_id, '') as rid from pg where number % 11 <> 0)
 select e.page_id, case when r.page_id is null then 'missing' when e.revision is distinct from r.revision then 'revision' when e.rid <> r.rid then 'id' end as mismatch from e left join r on r.page_id = e.page_id where r.page_id is null or e.revision is distinct from r.revision or e.rid <> r.rid""")
def jon26_frozen_entries(s: SparkSession, d: str) -> DataFrame:
    """Frozen entries against revisions of their identity; what doesn't match says why."""
    p = pages(s, d, "number", "content_revision", "current_revision_id")
    rid = F.coalesce("current_revision_id", F.lit(""))
    e = p.select("page_id", F.col("content_revision").alias("revision"), rid.alias("rid"))
    now = F.when(F.col("number") % 7 == 0, F.col("content_revision") + 1).otherwise(F.col("content_revision"))
    r = p.where("number % 11 <> 0").select("page_id", now.alias("now"), rid.alias("now_id"), F.lit(True).alias("there"))
    why = F.when(F.col("there").isNull(), "missing").when(~F.col("revision").eqNullSafe(F.col("now")), "revision").when(F.col("rid") != F.col("now_id"), "id")
    return e.join(r, "page_id", "left").select("page_id", why.alias("mismatch")).where("mismatch is not null")


@query(""", w as (select book_id, number, arg_min(source_id, page_id) as source_id, arg_min(source_page, page_id) as source_page, arg_min(source_version, page_id) as source_version from pg group by book_id, number)
 select pg.page_id, pg.source_id is not distinct from f.id and coalesce(pg.source_page <= f.page_count, false) and pg.source_version is not distinct from 1 as same from pg left join fl f on f.book_id = pg.book_id and f.id = pg.source_id""")
def jon30_identity_guard(s: SparkSession, d: str) -> DataFrame:
    """Whether a page is still the one of its file, page and version that a request was made for."""
    f = files(s, d).select("book_id", F.col("id").alias("source_id"), "page_count", F.lit(True).alias("there"))
    met = pages(s, d, "book_id", "source_id", "source_page", "source_version").join(f, ["book_id", "source_id"], "left")
    same = (F.col("there").isNotNull() | F.col("source_id").isNull()) & F.coalesce(F.col("source_page") <= F.col("page_count"), F.lit(False)) & F.col("source_version").eqNullSafe(F.lit(1))
    return met.select("page_id", same.alias("same"))


@query(""", x as (select page_id, book_id, number, source_id, source_page, source_version from pg where status = 'failed'), e as (select book_id, count(*) as n, count(*) filter (not exists (select 1 from fl where fl.book_id = x.book_id and fl.id = x.source_id and x.source_page between 1 and fl.page_count)) as bad from x group by book_id)
 select book_id, n, bad, bad = 0 as taken from e""")
def jon31_all_or_none(s: SparkSession, d: str) -> DataFrame:
    """Error records of a book, taken only if each of them has its source: one that hasn't rejects all."""
    f = files(s, d).select("book_id", F.col("id").alias("source_id"), "page_count", F.lit(True).alias("there"))
    x = pages(s, d, "book_id", "source_id", "source_page", "status").where("status = 'failed'").join(f, ["book_id", "source_id"], "left")
    bad = ~F.coalesce(F.col("there") & F.col("source_page").between(1, F.col("page_count")), F.lit(False))
    return x.groupBy("book_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), (F.count_if(bad) == 0).alias("taken"))


@query(""", b as (select * from box where x0 < x1 and y0 < y1 and region_id is not null)
 select a.page_id, a.region_id as inner_id, b.region_id as outer_id from b a join b b on b.page_id = a.page_id and a.region_id <> b.region_id and round(a.x0 - b.x0 + 0.015, 9) >= 0 and round(a.y0 - b.y0 + 0.015, 9) >= 0 and round(b.x1 - a.x1 + 0.015, 9) >= 0 and round(b.y1 - a.y1 + 0.015, 9) >= 0""")
def jon32_contained(s: SparkSession, d: str) -> DataFrame:
    """Regions that lie in another of their page, by a tolerance of 0.015."""
    b = boxes(s, d).where("x0 < x1 and y0 < y1 and region_id is not null").select("page_id", "region_id", *G.SIDES)
    other = b.select("page_id", F.col("region_id").alias("outer_id"), *[F.col(c).alias(f"o{c}") for c in G.SIDES])
    near = [F.round(c + 0.015, 9) >= 0 for c in (F.col("x0") - F.col("ox0"), F.col("y0") - F.col("oy0"), F.col("ox1") - F.col("x1"), F.col("oy1") - F.col("y1"))]
    return b.join(other, "page_id").where((F.col("region_id") != F.col("outer_id")) & near[0] & near[1] & near[2] & near[3]).select("page_id", F.col("region_id").alias("inner_id"), "outer_id")


@query(""", i as (select * from box where kind = 'figure') select b.page_id, b.region_id, count(*) as issues from box b join i on i.page_id = b.page_id and i.region_id <> b.region_id
 and (i.x0 is null or b.x0 is null or (b.x0 < i.x1 and i.x0 < b.x1 and b.y0 < i.y1 and i.y0 < b.y1)) where b.kind <> 'figure' group by b.page_id, b.region_id""")
def jon33_affected(s: SparkSession, d: str) -> DataFrame:
    """Elements that an issue's area touches; an issue or element without a place affects all."""
    b = boxes(s, d)
    i = b.where("kind = 'figure'").select("page_id", F.col("region_id").alias("i_id"), *[F.col(c).alias(f"i{c}") for c in G.SIDES])
    touch = F.expr("ix0 is null or x0 is null or (x0 < ix1 and ix0 < x1 and y0 < iy1 and iy0 < y1)")
    return b.where("kind <> 'figure'").join(i, "page_id").where(touch & (F.col("region_id") != F.col("i_id"))).groupBy("page_id", "region_id").agg(F.count("*").alias("issues"))


# --- geometry -----------------------------------------------------------------------------------------------------------


@query("select page_id, region_id, round(1.25 * x0 - 0.2 * y0 + 0.1, 6) as u, round(0.3 * x0 + 0.9 * y0 - 0.05, 6) as v, round(x0, 6) as x, round(y0, 6) as y from box where x0 is not null")
def mth01_affine(s: SparkSession, d: str) -> DataFrame:
    """Points mapped by an affine map, and mapped back by its inverse."""
    a, b, c, e, f, g = 1.25, -0.2, 0.1, 0.3, 0.9, -0.05
    det = a * f - b * e
    u, v = a * F.col("x0") + b * F.col("y0") + c, e * F.col("x0") + f * F.col("y0") + g
    x, y = (f * (u - c) - b * (v - g)) / det, (a * (v - g) - e * (u - c)) / det
    return boxes(s, d).where("x0 is not null").select("page_id", "region_id", rnd(u).alias("u"), rnd(v).alias("v"), rnd(x).alias("x"), rnd(y).alias("y"))


@query("select page_id, round(width * 72.27 / 72, 6) as pt, round(width * 72 / 72.27, 6) as bp, round(width * 72 / 25.4, 6) as mm_bp from pg where width is not null")
def mth05_units(s: SparkSession, d: str) -> DataFrame:
    w = F.col("width")
    return pages(s, d, "width").where("width is not null").select("page_id", rnd(w * 72.27 / 72).alias("pt"), rnd(w * 72 / 72.27).alias("bp"), rnd(w * 72 / 25.4).alias("mm_bp"))


@query(""", b as (select * from box where x0 < x1 and y0 < y1 and region_id is not null)
 select a.page_id, a.region_id as a_id, b.region_id as b_id, round(greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.y1 - a.y0, b.y1 - b.y0) * greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.x1 - a.x0, b.x1 - b.x0)
 - abs((a.y0 + a.y1 - b.y0 - b.y1) / 2) / greatest(a.y1 - a.y0, b.y1 - b.y0) * 0.3, 6) as score from b a join b b on b.page_id = a.page_id and a.region_id < b.region_id""")
def mth06_band_score(s: SparkSession, d: str) -> DataFrame:
    """How well two boxes share a band: the shares of height and width they have in common, less 0.3 of their centres' distance."""
    b = boxes(s, d).where("x0 < x1 and y0 < y1 and region_id is not null").select("page_id", "region_id", *G.SIDES)
    o = b.select("page_id", F.col("region_id").alias("b_id"), *[F.col(c).alias(f"o{c}") for c in G.SIDES])
    return b.join(o, "page_id").where("region_id < b_id").select("page_id", F.col("region_id").alias("a_id"), "b_id", rnd(G.band_score(*[F.col(c) for c in G.SIDES], *[F.col(f"o{c}") for c in G.SIDES])).alias("score"))


@query("select page_id, region_id, round(greatest(0.1 - x0, 0.1 - y0, x1 - 0.9, y1 - 0.9, 0), 6) as outside from box where x0 is not null")
def mth07_outside(s: SparkSession, d: str) -> DataFrame:
    return boxes(s, d).where("x0 is not null").select("page_id", "region_id", rnd(F.greatest(0.1 - F.col("x0"), 0.1 - F.col("y0"), F.col("x1") - 0.9, F.col("y1") - 0.9, F.lit(0.0))).alias("outside"))


@query("select page_id, round(sqrt(power(1.25 * width, 2) + power(0.3 * width, 2)), 6) as canvas_w, round(sqrt(power(-0.2 * height, 2) + power(0.9 * height, 2)), 6) as canvas_h from pg where width is not null and height is not null")
def mth10_canvas(s: SparkSession, d: str) -> DataFrame:
    """Lengths of a page's sides after an affine map."""
    w, h = F.col("width"), F.col("height")
    return pages(s, d, "width", "height").where("width is not null and height is not null").select("page_id", rnd(F.hypot(1.25 * w, 0.3 * w)).alias("canvas_w"), rnd(F.hypot(-0.2 * h, 0.9 * h)).alias("canvas_h"))


@query(""", b as (select *, x1 - x0 as w from box where x0 < x1), n as (select page_id, region_id, x0, case when w <= 0.8 then least(greatest(x0, 0.1), 0.9 - w) - x0 else 0 end as dx from b)
 select page_id, region_id, round(dx, 6) as dx, case when round(abs(dx), 9) <= 0.05 then round(x0 + dx, 6) else round(x0, 6) end as x0 from n""")
def mth11_nudge(s: SparkSession, d: str) -> DataFrame:
    """Boxes moved into a frame, if they fit in and it takes at most 0.05; others stay."""
    w = F.col("x1") - F.col("x0")
    dx = F.when(w <= 0.8, F.least(F.greatest("x0", F.lit(0.1)), 0.9 - w) - F.col("x0")).otherwise(0.0)
    n = boxes(s, d).where("x0 < x1").select("page_id", "region_id", "x0", dx.alias("dx"))
    return n.select("page_id", "region_id", rnd(F.col("dx")).alias("dx"), rnd(F.when(F.round(F.abs("dx"), 9) <= 0.05, F.col("x0") + F.col("dx")).otherwise(F.col("x0"))).alias("x0"))


@query(""", b as (select *, case ord % 3 when 0 then 'left' when 1 then 'anchor' else 'right' end as al from box where x0 < x1 and y0 < y1 and ord is not null), x as (select *, case al when 'anchor' then x0 - 0.02 when 'right' then x0 - (x1 - x0) else x0 end as l from b)
 select page_id, region_id, al, round(l, 6) as mx0, round(y1 - 0.03, 6) as my0, round(l + (x1 - x0), 6) as mx1, round(y1 + 0.01, 6) as my1 from x""")
def mth12_measured_box(s: SparkSession, d: str) -> DataFrame:
    """The box that measured text takes from its anchor, by its alignment, around its baseline."""
    al = F.when(F.col("ord") % 3 == 0, "left").when(F.col("ord") % 3 == 1, "anchor").otherwise("right")
    w = F.col("x1") - F.col("x0")
    left = F.when(F.col("al") == "anchor", F.col("x0") - 0.02).when(F.col("al") == "right", F.col("x0") - w).otherwise(F.col("x0"))
    b = boxes(s, d).where("x0 < x1 and y0 < y1 and ord is not null").withColumn("al", al).withColumn("l", left)
    return b.select("page_id", "region_id", "al", rnd(F.col("l")).alias("mx0"), rnd(F.col("y1") - 0.03).alias("my0"), rnd(F.col("l") + w).alias("mx1"), rnd(F.col("y1") + 0.01).alias("my1"))


@query(LAY + "select page_id, round(coalesce(try_cast(l->>'$.own_size_bp' as double), try_cast(l->>'$.body_font_size_bp' as double) * 0.9, 11), 6) as size from lay")
def mth13_font_size(s: SparkSession, d: str) -> DataFrame:
    """A line's own size, else a share of its page's, else eleven."""
    return layouts(s, d).select("page_id", rnd(F.coalesce(get("$.own_size_bp").try_cast("double"), get("$.body_font_size_bp").try_cast("double") * 0.9, F.lit(11.0))).alias("size"))
