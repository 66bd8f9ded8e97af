"""Text rules, answers of two providers, sources and sinks, page analysis with its full rules. Added to the queries of `reference`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import scanners
from pagewright.functions import text as T
from pagewright.operators import islands as I
from pagewright.operators import matching as M
from pagewright.operators import relational as R
from pagewright.plans.content import LAY, get, layouts, valid
from pagewright.plans.reference import attempts, books, boxes, files, pages, query, rnd
from pagewright.session import scratch
from pagewright.sources import records
from pagewright.sources.tables import table

# --- text ---------------------------------------------------------------------------------------------------------------


@query(r"""select page_id, regexp_matches(coalesce(extraction_json, ''), 'body_latex') as has_body, regexp_matches('% note' || chr(10) || '\documentclass{' || coalesce(page_kind, '') || '}', '^(\s|%[^\r\n]*(\r\n?|\n|$))*\\documentclass\s*(\[[^\[\]]*\]\s*)?\{[^{}]+\}') as whole from pg""")
def str02_is_document(s: SparkSession, d: str) -> DataFrame:
    """Whether a text begins with its class, after nothing but space, comments and packages."""
    made = F.concat(F.lit("% note\n\\documentclass{"), F.coalesce("page_kind", F.lit("")), F.lit("}"))
    return pages(s, d, "extraction_json", "page_kind").select("page_id", F.coalesce("extraction_json", F.lit("")).rlike("body_latex").alias("has_body"), T.is_tex_document(made).alias("whole"))


@query(r"""select id, case when number % 4 = 0 then null else filename end as safe from (select id, filename, row_number() over (partition by book_id order by id) as number from fl)""")
def str03_resource_names(s: SparkSession, d: str) -> DataFrame:
    """Names kept relative to their folder; absolute paths and such that leave it are refused. Every fourth name is made to leave it."""
    w = Window.partitionBy("book_id").orderBy("id")
    name = F.when(F.row_number().over(w) % 4 == 0, F.concat(F.lit("a\\..\\..\\"), "filename")).otherwise(F.concat(F.lit("./"), "filename"))
    return files(s, d).select("id", name.alias("name")).select("id", T.safe_path(F.col("name")).alias("safe"))


_COMMANDS = r"(?i)\\(?:documentclass|usepackage|input|include|includegraphics|write|openout|read|catcode|csname|def|gdef|edef|xdef|newcommand|renewcommand|directlua|special|immediate|shellescape|loop|repeat|verbatim)\b"
_DOCUMENT = r"(?i)\\(?:begin|end)\s*\{document\}"
_WIDTH = r"\\(?:linewidth|columnwidth|textwidth)\s*="


@query(f"""select doc_id, regexp_matches(text, '{_COMMANDS}') as command, regexp_matches(text, '{_DOCUMENT}') as document, regexp_matches(text, '{_WIDTH}') as width, contains(text, '^^') as escape from documents""")
def str06_forbidden(s: SparkSession, d: str) -> DataFrame:
    """The four kinds of what a fragment may not hold: commands, a document of its own, widths set, coded characters."""
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", t.rlike(_COMMANDS).alias("command"), t.rlike(_DOCUMENT).alias("document"), t.rlike(_WIDTH).alias("width"), F.contains(t, F.lit("^^")).alias("escape"))


@query()
def str07_balanced(s: SparkSession, d: str) -> DataFrame:
    """Whether braces and environments close in order, comments and escapes left out."""
    return scanners.scanned(table(s, d, "documents"), "doc_id", "text", {"balanced": scanners.balanced, "environments": scanners.environments}, "boolean")


@query()
def str08_alignment(s: SparkSession, d: str) -> DataFrame:
    """The place of the first `&` outside braces, environments and comments, and the number of such."""
    return scanners.scanned(table(s, d, "documents"), "doc_id", "text", {"first": scanners.first_mark, "marks": scanners.mark_count}, "int")


@query()
def str09_split_at_anchor(s: SparkSession, d: str) -> DataFrame:
    """A text before and after that place."""
    return scanners.scanned(table(s, d, "documents"), "doc_id", "text", {"before": scanners.before_mark, "after": scanners.after_mark}, "string")


@query(r"""select install_id, file_no, regexp_replace(regexp_replace(regexp_replace(replace(v, 'reader-a0', '[hidden]'), 'data:image/[a-zA-Z0-9.+-]+;base64,[A-Za-z0-9+/=]+', '[data]', 'g'), '("(?:authorization|x-goog-api-key|api_key)"\s*:\s*")[^"\r\n]*', '\1[hidden]', 'gi'),
 '("inlineData"\s*:\s*\{[^{}]*"data"\s*:\s*")[A-Za-z0-9+/=]+', '\1[data]', 'g') as clean from (select distinct install_id, file_no, case when file_no % 2 = 0 then value || '{"API_Key": "s3cret", "inlineData": {"mime": "x", "data": "QUJD"}}' else value end as v from settings)""")
def str10_redact(s: SparkSession, d: str) -> DataFrame:
    """A key by its letters, inline images, headers that hold keys, and inline data are hidden; addresses stay."""
    extra = F.when(F.col("file_no") % 2 == 0, F.concat("value", F.lit('{"API_Key": "s3cret", "inlineData": {"mime": "x", "data": "QUJD"}}'))).otherwise(F.col("value"))
    v = table(s, d, "settings").select("install_id", "file_no", "value").dropDuplicates(["install_id", "file_no"]).select("install_id", "file_no", extra.alias("v"))
    return v.select("install_id", "file_no", T.redact(F.col("v"), "reader-a0").alias("clean"))


@query(r"""select page_id, number, 'HTTP ' || cast(400 + number % 3 as varchar) || ': ' || concat_ws('; ', case when length(m) > 60 then substr(m, 1, 60) || '…' else nullif(m, '') end, 'code=' || nullif(status, '')) as message
 from (select page_id, number, status, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') as m from pg)""")
def str13_error_message(s: SparkSession, d: str) -> DataFrame:
    """A message put together of parts, each with its space folded and its own cap."""
    m = T.collapse_space(F.coalesce("text", F.lit("")))
    p = pages(s, d, "number", "status", "text").select("page_id", "number", "status", m.alias("m"))
    said = F.when(F.length("m") > 60, F.concat(F.substring("m", 1, 60), F.lit("…"))).otherwise(F.nullif("m", F.lit("")))
    return p.select("page_id", "number", F.concat(F.lit("HTTP "), (F.col("number") % 3 + 400).cast("string"), F.lit(": "), F.concat_ws("; ", said, F.concat(F.lit("code="), F.nullif("status", F.lit(""))))).alias("message"))


_LOG = r"""case position % 5 when 0 then '! LaTeX Error: File `' || filename || ''' not found.' when 1 then 'l.' || position || ' Undefined control sequence' when 2 then 'The font "' || directory || '" cannot be found' when 3 then '! Bad /srv/books/' || filename || ' here' else 'Output written' end"""


@query(f"""select id, case when regexp_matches(line, 'File .*not found') then 'missing file ' || regexp_extract(line, 'File [`'']([^`'']+)['']', 1) when contains(line, 'Undefined control sequence') then 'unknown command'
 when regexp_matches(lower(line), 'font.*(cannot be found|not loadable)') then 'missing font' when starts_with(line, '!') then substr(regexp_replace(regexp_replace(line, '^[! ]+', ''), '(^|\\s)/(?:[^\\s/]+/)+[^\\s"''`]*', '\\1[path]', 'g'), 1, 240) else 'not set' end as reason from (select id, {_LOG} as line from fl)""")
def str14_log_reasons(s: SparkSession, d: str) -> DataFrame:
    """Why a compilation failed, first reason that matches, with paths masked; over log lines made of the files' names."""
    line = F.expr("case pmod(position, 5) when 0 then concat('! LaTeX Error: File `', filename, '\\' not found.') when 1 then concat('l.', position, ' Undefined control sequence') when 2 then concat('The font \"', directory, '\" cannot be found') when 3 then concat('! Bad /srv/books/', filename, ' here') else 'Output written' end")
    return files(s, d).select("id", line.alias("line")).select("id", T.log_reason(F.col("line")).alias("reason"))


@query(r"""select install_id, file_no, case when regexp_matches(u, '^https?://[^/?#@:\s]+(:\d+)?(/[^?#\s]*)?$') then u end as base, regexp_extract(u, '^https?://([^/:?#@\s]+)', 1) as host, case when p is null or p = '' then p when regexp_matches(p, '^[a-z]+:|^//|[?#]') or list_contains(string_split(p, '/'), '..') then null
 when starts_with(p, '/') then p else '/' || p end as path from (select install_id, file_no, rtrim(trim(v->>'$.base_url'), '/') || case when file_no % 3 = 0 then '?key=1' else '' end as u, trim(v->>'$.responses_path') as p from (select distinct install_id, file_no, case when json_valid(value) then value end as v from settings)) where u is not null""")
def str17_urls(s: SparkSession, d: str) -> DataFrame:
    """Base addresses without a slash at the end, null if they hold credentials, a query or a fragment; paths relative, with a slash
    before, null if they leave their root. Every third address is given a query."""
    v = F.when(F.try_parse_json("value").isNotNull(), F.col("value"))
    t = table(s, d, "settings").select("install_id", "file_no", "value").dropDuplicates(["install_id", "file_no"]).withColumn("v", v)
    u = F.concat(F.expr("rtrim('/', trim(get_json_object(v, '$.base_url')))"), F.when(F.col("file_no") % 3 == 0, "?key=1").otherwise(""))
    t = t.select("install_id", "file_no", u.alias("u"), F.trim(F.get_json_object("v", "$.responses_path")).alias("p")).where("u is not null")
    return t.select("install_id", "file_no", T.base_url(F.col("u")).alias("base"), F.regexp_extract("u", r"^https?://([^/:?#@\s]+)", 1).alias("host"), T.url_path(F.col("p")).alias("path"))


@query(LAY + """select page_id, name, case when regexp_matches(name, 'song|simsun|ming|宋') then 'songti' when regexp_matches(name, 'hei|simhei|黑') then 'heiti' when regexp_matches(name, 'kai|楷') then 'kaiti' end as family from (select page_id, lower(l->>'$.body_font_family') as name from lay)""")
def str18_font_family(s: SparkSession, d: str) -> DataFrame:
    """A font's family by a word in its name."""
    n = F.col("name")
    family = F.when(n.rlike("song|simsun|ming|宋"), "songti").when(n.rlike("hei|simhei|黑"), "heiti").when(n.rlike("kai|楷"), "kaiti")
    return layouts(s, d).select("page_id", F.lower(get("$.body_font_family")).alias("name")).select("page_id", "name", family.alias("family"))


@query()
def str19_ratio(s: SparkSession, d: str) -> DataFrame:
    """Similarity of the first lines of both readings of a page, by longest common blocks."""
    first = lambda c: F.split(c, "\n")[0]
    return M.ratios(pages(s, d, "text", "extraction_text").select("page_id", first("text").alias("a"), first("extraction_text").alias("b")), "page_id", "a", "b")


@query(""", e as (select book_id, id, page_count as n, case position % 4 when 0 then 'odd' when 1 then 'even' when 2 then '1, 3-5' else '7-2' end as spec from fl where page_count is not null)
 select book_id, id, spec, case spec when 'odd' then list_aggregate(range(1, n + 1, 2), 'string_agg', ',') when 'even' then coalesce(list_aggregate(range(2, n + 1, 2), 'string_agg', ','), '') when '1, 3-5' then case when n >= 5 then '1,3,4,5' end end as pages from e""")
def str22_page_ranges(s: SparkSession, d: str) -> DataFrame:
    """Pages of each file that an expression names: odd, even, or numbers and ranges; null if it is wrong or leaves the file."""
    p = F.pmod("position", F.lit(4))
    e = files(s, d).where("page_count is not null").select("book_id", "id", F.col("page_count").cast("int").alias("n"), F.when(p == 0, "odd").when(p == 1, "even").when(p == 2, "1, 3-5").otherwise("7-2").alias("spec"))
    return e.select("book_id", "id", "spec", F.array_join(T.selection(F.col("spec"), F.col("n")), ",").alias("pages"))


@query("""select page_id, sha256('{"book_id":' || coalesce('"' || book_id || '"', 'null') || ',"number":' || coalesce(cast(number as varchar), 'null') || ',"selected":' || coalesce(cast(selected as varchar), 'null') || ',"status":' || coalesce('"' || status || '"', 'null') || '}') as digest from pg""")
def str26_canonical_digest(s: SparkSession, d: str) -> DataFrame:
    """Digest of canonical JSON: a flat record as a map, its keys in order, compact, nulls kept."""
    return pages(s, d, "status", "selected", "number", "book_id").select("page_id", F.sha2(T.canonical_json(["status", "selected", "number", "book_id"]), 256).alias("digest"))


# --- answers of two providers -------------------------------------------------------------------------------------------

_ANSWER = """, ans as (select book_id, page_number, attempt, input_tokens, case when attempt % 2 = 1 then '{"status":"' || case page_number % 4 when 0 then 'incomplete","incomplete_details":{"reason":"max_output_tokens"},"' when 1 then 'completed","' when 2 then 'queued","' else 'completed","request_id":"rq-' || page_number || '","' end
  || 'output":[{"type":"message","content":[{"type":"output_text","text":"' || case when page_number % 8 = 3 then '' else 'said' end || '"}]}],"usage":{"input_tokens":' || coalesce(cast(input_tokens as varchar), 'null') || ',"output_tokens":' || coalesce(cast(output_tokens as varchar), '"many"') || ',"total_tokens":' || coalesce(cast(total_tokens as varchar), '-1') || '}}'
 else '{"responseId":"id-' || page_number || '","candidates":[{"finishReason":"' || case page_number % 3 when 0 then 'MAX_TOKENS' when 1 then 'STOP' else 'SAFETY' end || '","content":{"parts":[{"text":"said"},{"text":"thought","thought":true}]}}],"usageMetadata":{"promptTokenCount":' || coalesce(cast(input_tokens as varchar), 'null')
  || ',"candidatesTokenCount":' || coalesce(cast(output_tokens as varchar), 'null') || case when page_number % 2 = 0 then ',"thoughtsTokenCount":7' else '' end || ',"totalTokenCount":' || coalesce(cast(total_tokens as varchar), 'null') || '}}' end as j from at_)
"""


def answers(s: SparkSession, d: str) -> DataFrame:
    """Stored answers in the shapes of two providers, made of the ledger's numbers."""
    n, say = F.col("page_number"), F.concat
    text = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    first = say(
        F.lit('{"status":"'), F.when(n % 4 == 0, 'incomplete","incomplete_details":{"reason":"max_output_tokens"},"').when(n % 4 == 1, 'completed","').when(n % 4 == 2, 'queued","').otherwise(say(F.lit('completed","request_id":"rq-'), n.cast("string"), F.lit('","'))),
        F.lit('output":[{"type":"message","content":[{"type":"output_text","text":"'), F.when(n % 8 == 3, "").otherwise("said"), F.lit('"}]}],"usage":{"input_tokens":'), text("input_tokens", "null"), F.lit(',"output_tokens":'), text("output_tokens", '"many"'),
        F.lit(',"total_tokens":'), text("total_tokens", "-1"), F.lit("}}"),
    )
    second = say(
        F.lit('{"responseId":"id-'), n.cast("string"), F.lit('","candidates":[{"finishReason":"'), F.when(n % 3 == 0, "MAX_TOKENS").when(n % 3 == 1, "STOP").otherwise("SAFETY"), F.lit('","content":{"parts":[{"text":"said"},{"text":"thought","thought":true}]}}],"usageMetadata":{"promptTokenCount":'),
        text("input_tokens", "null"), F.lit(',"candidatesTokenCount":'), text("output_tokens", "null"), F.when(n % 2 == 0, ',"thoughtsTokenCount":7').otherwise(""), F.lit(',"totalTokenCount":'), text("total_tokens", "null"), F.lit("}}"),
    )
    return attempts(s, d).select("book_id", "page_number", "attempt", F.when(F.col("attempt") % 2 == 1, first).otherwise(second).alias("j"))


@query(_ANSWER + """, u as (select *, case when json_type(j, '$.usage') = 'OBJECT' then 'first' else 'second' end as shape from ans),
 c as (select book_id, page_number, attempt, shape, case when json_type(j, p.a) in ('UBIGINT', 'BIGINT') and cast(j->>p.a as bigint) >= 0 then cast(j->>p.a as bigint) end as a, case when json_type(j, p.b) in ('UBIGINT', 'BIGINT') and cast(j->>p.b as bigint) >= 0 then cast(j->>p.b as bigint) end as b,
  case when shape = 'first' then 0 else coalesce(cast(j->>'$.usageMetadata.thoughtsTokenCount' as bigint), 0) end as t, case when json_type(j, p.c) in ('UBIGINT', 'BIGINT') and cast(j->>p.c as bigint) >= 0 then cast(j->>p.c as bigint) end as c
  from u join (values ('first', '$.usage.input_tokens', '$.usage.output_tokens', '$.usage.total_tokens'), ('second', '$.usageMetadata.promptTokenCount', '$.usageMetadata.candidatesTokenCount', '$.usageMetadata.totalTokenCount')) p(s, a, b, c) on p.s = u.shape)
 select book_id, page_number, attempt, a as input_tokens, b + t as output_tokens, c as total_tokens from c""")
def str23_usage(s: SparkSession, d: str) -> DataFrame:
    """Usage of both shapes in one: whole numbers from 0 on or null; the second shape's output is candidates and thoughts."""
    count = lambda p: F.when(get(p, "j").rlike(r"^\d+$"), get(p, "j").cast("bigint"))
    first = get("$.usage", "j").isNotNull()
    pick = lambda a, b: F.when(first, count(a)).otherwise(count(b))
    thoughts = F.coalesce(count("$.usageMetadata.thoughtsTokenCount"), F.lit(0))
    return answers(s, d).select(
        "book_id", "page_number", "attempt", pick("$.usage.input_tokens", "$.usageMetadata.promptTokenCount").alias("input_tokens"),
        F.when(first, count("$.usage.output_tokens")).otherwise(count("$.usageMetadata.candidatesTokenCount") + thoughts).alias("output_tokens"), pick("$.usage.total_tokens", "$.usageMetadata.totalTokenCount").alias("total_tokens"),
    )


@query(_ANSWER + """select book_id, page_number, attempt, case when j->>'$.candidates[0].finishReason' is not null then case j->>'$.candidates[0].finishReason' when 'MAX_TOKENS' then 'truncated' when 'STOP' then 'complete' else 'incomplete' end
 when j->>'$.status' = 'incomplete' then case when j->>'$.incomplete_details.reason' = 'max_output_tokens' then 'truncated' else 'incomplete' end when coalesce(j->>'$.status', '') <> 'completed' then 'unknown' when coalesce(j->>'$.output[0].content[0].text', '') = '' then 'incomplete' else 'complete' end as completion from ans""")
def str24_completion(s: SparkSession, d: str) -> DataFrame:
    """How an answer ended, of both shapes."""
    finish, status = get("$.candidates[0].finishReason", "j"), get("$.status", "j")
    second = F.when(finish == "MAX_TOKENS", "truncated").when(finish == "STOP", "complete").otherwise("incomplete")
    cut = F.when(get("$.incomplete_details.reason", "j") == "max_output_tokens", "truncated").otherwise("incomplete")
    first = F.when(status == "incomplete", cut).when(F.coalesce(status, F.lit("")) != "completed", "unknown").when(F.coalesce(get("$.output[0].content[0].text", "j"), F.lit("")) == "", "incomplete").otherwise("complete")
    return answers(s, d).select("book_id", "page_number", "attempt", F.when(finish.isNotNull(), second).otherwise(first).alias("completion"))


@query(_ANSWER + """select book_id, page_number, attempt, substr(coalesce(case when page_number % 5 = 0 then 'hd-' || page_number end, nullif(j->>'$.request_id', ''), nullif(j->>'$.responseId', ''), nullif(j->>'$.id', '')), 1, 200) as request_id from ans""")
def str25_request_id(s: SparkSession, d: str) -> DataFrame:
    """The first id that isn't empty, of the headers, then of the body; at most 200 characters."""
    header = F.when(F.col("page_number") % 5 == 0, F.concat(F.lit("hd-"), F.col("page_number").cast("string")))
    body = [F.nullif(get(p, "j"), F.lit("")) for p in ("$.request_id", "$.responseId", "$.id")]
    return answers(s, d).select("book_id", "page_number", "attempt", F.substring(F.coalesce(header, *body), 1, 200).alias("request_id"))


@query("""select page_id, case when extraction_json is null then 'missing' when not json_valid(extraction_json) then 'invalid JSON' when json_type(extraction_json) <> 'OBJECT' then 'not an object' when json_type(extraction_json, '$.blocks') is null then 'missing blocks' end as reason,
 case when json_valid(extraction_json) and json_type(extraction_json) = 'OBJECT' and json_type(extraction_json, '$.blocks') is null then '$.blocks' else '$' end as path, substr(extraction_json, 1, 20) as head from pg
 where extraction_json is null or not json_valid(extraction_json) or json_type(extraction_json) <> 'OBJECT' or json_type(extraction_json, '$.blocks') is null""")
def str29_parse_errors(s: SparkSession, d: str) -> DataFrame:
    """Where a record fails to parse and why, with the beginning of what was there."""
    x = F.col("extraction_json")
    lacks = ~F.array_contains(F.json_object_keys(x), "blocks")
    reason = F.when(x.isNull(), "missing").when(F.try_parse_json(x).isNull(), "invalid JSON").when(~F.ltrim(x).startswith("{"), "not an object").when(lacks, "missing blocks")
    p = pages(s, d, "extraction_json").select("page_id", reason.alias("reason"), F.substring(x, 1, 20).alias("head")).where("reason is not null")
    return p.select("page_id", "reason", F.when(F.col("reason") == "missing blocks", "$.blocks").otherwise("$").alias("path"), "head")


# --- page analysis ------------------------------------------------------------------------------------------------------

_COLUMNS = """, b as (select page_id, cast(floor(x0 * 100) as bigint) as a, cast(ceil(x1 * 100) as bigint) as z from box where x0 < x1 and y1 > 0.12 and y0 < 0.88),
 c as (select page_id, x, count(*) as mass from (select page_id, unnest(range(a, z)) as x from b) group by page_id, x),
 e as (select p.page_id, x.x, coalesce(c.mass, 0) as mass from (select distinct page_id from b) p cross join range(0, 100) x(x) left join c on c.page_id = p.page_id and c.x = x.x),
 m as (select *, coalesce(sum(mass) over (partition by page_id order by x rows between unbounded preceding and 1 preceding), 0) as before, sum(mass) over (partition by page_id) as total from e),
 l as (select *, x - row_number() over (partition by page_id order by x) as island from m where x between 28 and 71 and mass = 0),
 r as (select page_id, min(x) as lo, max(x) + 1 as hi, min(before) as lm, any_value(total) - min(before) as rm from l group by page_id, island)
"""


@query(_COLUMNS + "select page_id, arg_max(lo, (hi - lo, -lo)) as gutter, max(hi - lo) as width from r where hi - lo >= 2 and lm > 20 and rm > 20 group by page_id")
def win03_gutter(s: SparkSession, d: str) -> DataFrame:
    """The gutter of a page: the widest empty run of columns in its middle with enough mass on both sides (the first of equals). Columns
    are hundredths of the width; a box lies on all it crosses."""
    b = boxes(s, d).where("x0 < x1 and y1 > 0.12 and y0 < 0.88").select("page_id", F.floor(F.col("x0") * 100).alias("a"), F.ceil(F.col("x1") * 100).alias("z")).where("a < z")
    own = b.select("page_id", F.explode(F.sequence("a", F.col("z") - 1)).alias("x")).where("x between 0 and 99").groupBy("page_id", "x").agg(F.count("*").alias("mass"))
    every = b.select("page_id").distinct().select("page_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(99).cast("bigint"))).alias("x"))
    return I.gutters(every.join(own, ["page_id", "x"], "left").fillna(0, ["mass"]), "page_id", "x", "mass", 28, 71, 2, 20)


@query("""select lang, least(220, greatest(90, coalesce(arg_max(bin, (round(v, 6), -bin)), 160) + 20)) as threshold from (select lang, bin, n0 * (n1 - n0) * power(s0 / n0 - (s1 - s0) / (n1 - n0), 2) as v from
 (select lang, bin, sum(n) over w as n0, sum(bin * n) over w as s0, sum(n) over (partition by lang) as n1, sum(bin * n) over (partition by lang) as s1
 from (select lang, least(255, cast(floor(n_chars / 10) as bigint)) as bin, cast(count(*) as double) as n from documents where n_chars is not null and lang is not null group by all)
 window w as (partition by lang order by bin rows unbounded preceding)) where n0 < n1) group by lang""")
def win04_otsu(s: SparkSession, d: str) -> DataFrame:
    """The level that parts a histogram best (the lowest of equals), raised by 20 and kept between 90 and 220."""
    level = F.least(F.lit(255), F.floor(F.col("n_chars") / 10))
    h = table(s, d, "documents").where("n_chars is not null and lang is not null").groupBy("lang", level.alias("bin")).agg(F.count("*").alias("n"))
    return I.otsu(h, ["lang"], "bin", "n").select("lang", F.least(F.lit(220), F.greatest(F.lit(90), F.col("threshold") + 20)).cast("bigint").alias("threshold"))


_COVER = """, o as (select a.page_id, a.region_id, a.x0, a.x1, greatest(a.x0, b.x0) as lo, least(a.x1, b.x1) as hi from box a join box b on b.page_id = a.page_id and b.region_id <> a.region_id and b.x0 < a.x1 and a.x0 < b.x1 and b.y0 < a.y1 and a.y0 < b.y1 where a.x0 < a.x1 and a.y0 < a.y1 and b.x0 < b.x1),
 g as (select page_id, region_id, greatest(0, hi - greatest(lo, coalesce(max(hi) over (partition by page_id, region_id order by lo, hi rows between unbounded preceding and 1 preceding), lo))) as own from o),
 k as (select page_id, region_id, sum(own) as covered from g group by page_id, region_id)
"""


@query(_COVER + """select b.page_id, b.region_id, round((b.x1 - b.x0) - coalesce(k.covered, 0), 6) as remaining, round((b.x1 - b.x0) - coalesce(k.covered, 0) - greatest(0.08, 0.18 * (b.x1 - b.x0)), 9) >= 0 as flagged from box b left join k on k.page_id = b.page_id and k.region_id = b.region_id where b.x0 < b.x1 and b.y0 < b.y1 and b.region_id is not null""")
def win05_uncovered(s: SparkSession, d: str) -> DataFrame:
    """What of each region's width no other region of its page covers, and whether that is much: at least 0.08 and 18 %."""
    b = boxes(s, d).where("x0 < x1 and y0 < y1 and region_id is not null").select("page_id", "region_id", "x0", "y0", "x1", "y1")
    o = b.select("page_id", F.col("region_id").alias("o_id"), *[F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")])
    met = b.join(o, "page_id").where("region_id <> o_id and ox0 < x1 and x0 < ox1 and oy0 < y1 and y0 < oy1").select("page_id", "region_id", F.greatest("x0", "ox0").alias("lo"), F.least("x1", "ox1").alias("hi"))
    k = I.covered(met, ["page_id", "region_id"], "lo", "hi").select("page_id", "region_id", "covered")
    left = (F.col("x1") - F.col("x0")) - F.coalesce("covered", F.lit(0.0))
    return b.join(k, ["page_id", "region_id"], "left").select("page_id", "region_id", rnd(left).alias("remaining"), (F.round(left - F.greatest(F.lit(0.08), 0.18 * (F.col("x1") - F.col("x0"))), 9) >= 0).alias("flagged"))


_SECTIONS = """, v as (select distinct page_id, y from (select page_id, y0 as y from box where kind = 'header' and y0 < y1 union all select page_id, y1 from box where kind = 'header' and y0 < y1)),
 q as (select b.page_id, b.region_id, b.x0, b.y0, (select count(*) from v where v.page_id = b.page_id and v.y <= b.y0) as section, case when b.x1 - b.x0 >= 0.55 then 0 when (b.x0 + b.x1) / 2 < 0.5 then 1 else 2 end as col from box b where b.x0 < b.x1 and b.y0 < b.y1 and b.region_id is not null)
"""


@query(_SECTIONS + "select page_id, region_id, section, row_number() over (partition by page_id order by section, col, y0, x0, region_id) - 1 as place from q")
def win06_sections(s: SparkSession, d: str) -> DataFrame:
    """Reading order: regions by the number of dividers at or above them, their column, then from top to bottom."""
    b = boxes(s, d).where("x0 < x1 and y0 < y1 and region_id is not null")
    # the tops and bottoms of headers are an array of the page: no more than it has regions
    v = boxes(s, d).where("kind = 'header' and y0 < y1").select("page_id", F.explode(F.array("y0", "y1")).alias("y")).groupBy("page_id").agg(F.collect_set("y").alias("ys"))
    width = F.col("x1") - F.col("x0")
    column = F.when(width >= 0.55, 0).when((F.col("x0") + F.col("x1")) / 2 < 0.5, 1).otherwise(2)
    q = b.join(v, "page_id", "left").withColumn("section", F.coalesce(F.size(F.filter("ys", lambda y: y <= F.col("y0"))), F.lit(0)).cast("bigint")).withColumn("section", F.greatest("section", F.lit(0).cast("bigint"))).withColumn("col", column)
    w = Window.partitionBy("page_id").orderBy("section", "col", "y0", "x0", "region_id")
    return q.select("page_id", "region_id", "section", (F.row_number().over(w) - 1).cast("bigint").alias("place"))


@query(""", c as (select page_id, y0 as cut from box where kind in ('header', 'title') and y0 < y1 union select page_id, y1 from box where kind in ('header', 'title') and y0 < y1 union select distinct page_id, 0.0 from box union select distinct page_id, 1.0 from box),
 t as (select page_id, cut as top, lead(cut) over (partition by page_id order by cut) as bottom from c), f as (select t.page_id, t.top, t.bottom, exists (select 1 from box b where b.page_id = t.page_id and b.kind in ('header', 'title') and b.y0 <= t.top and b.y1 >= t.bottom) as spans from t where bottom > top)
 select page_id, round(top, 6) as top, round(bottom, 6) as bottom, side from f, (values ('full'), ('left'), ('right')) x(side) where (side = 'full') = spans""")
def win07_region_bands(s: SparkSession, d: str) -> DataFrame:
    """Strips of a page between the edges of what spans it: whole where something spans the strip, else its left and right half."""
    b = boxes(s, d)
    across = b.where("kind in ('header', 'title') and y0 < y1")
    cuts = across.select("page_id", F.explode(F.array("y0", "y1")).alias("top")).union(b.select("page_id", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("top"))).distinct()
    t = cuts.withColumn("bottom", F.lead("top").over(Window.partitionBy("page_id").orderBy("top"))).where("bottom > top")
    # edges of what spans a page as an array of it
    spans = across.groupBy("page_id").agg(F.collect_list(F.struct("y0", "y1")).alias("s"))
    full = F.coalesce(F.exists("s", lambda x: (x["y0"] <= F.col("top")) & (x["y1"] >= F.col("bottom"))), F.lit(False))
    sides = F.when(F.col("full"), F.array(F.lit("full"))).otherwise(F.array(F.lit("left"), F.lit("right")))
    return t.join(spans, "page_id", "left").withColumn("full", full).select("page_id", rnd(F.col("top")).alias("top"), rnd(F.col("bottom")).alias("bottom"), F.explode(sides).alias("side"))


# --- order and sets -----------------------------------------------------------------------------------------------------


@query("select page_id, book_id, number from (select page_id, book_id, number, row_number() over (partition by book_id order by number, page_id) as r from pg) where r > 10 and r <= 10 + least(900, 500)")
def srt02_pagination(s: SparkSession, d: str) -> DataFrame:
    """A page of each book's listing from an offset on; the asked limit of 900 is clamped to 500."""
    n = R.prefix_sums(pages(s, d, "book_id", "number"), ["book_id"], ["number", "page_id"], F.lit(1))
    return n.where(f"before >= 10 and before < 10 + {min(900, 500)}").select("page_id", "book_id", "number")


@query("select book_id, arg_max(page_number, (sent_at, page_number, attempt)) as page_number, max(sent_at) as sent_at from at_ where sent_at is not null group by book_id")
def srt04_latest(s: SparkSession, d: str) -> DataFrame:
    """The latest of each group, by a maximum instead of a sort."""
    return attempts(s, d).where("sent_at is not null").groupBy("book_id").agg(F.max_by("page_number", F.struct("sent_at", "page_number", "attempt")).alias("page_number"), F.max("sent_at").alias("sent_at"))


@query("select book_id, page_number, attempt, row_number() over (partition by book_id order by sent_at desc nulls last, page_number desc, attempt desc) as newest from at_")
def srt05_newest_first(s: SparkSession, d: str) -> DataFrame:
    """Lists from the newest on: places counted without taking a book into one task."""
    a = attempts(s, d).withColumn("_t", -F.unix_micros(F.col("sent_at").cast("timestamp"))).withColumn("_t", F.coalesce("_t", F.lit(1 << 62)))
    a = a.select("book_id", "page_number", "attempt", "_t", (-F.col("page_number")).alias("_p"), (-F.col("attempt")).alias("_a"))
    return R.prefix_sums(a, ["book_id"], ["_t", "_p", "_a"], F.lit(1)).select("book_id", "page_number", "attempt", (F.col("before") + 1).alias("newest"))


@query("select page_id, row_number() over (partition by book_id order by source_page nulls last, page_id) as place from pg")
def srt08_missing_last(s: SparkSession, d: str) -> DataFrame:
    """Source order with what has none last."""
    p = pages(s, d, "book_id", "source_page").withColumn("_none", F.col("source_page").isNull().cast("int"))
    return R.prefix_sums(p, ["book_id"], ["_none", "source_page", "page_id"], F.lit(1)).select("page_id", (F.col("before") + 1).alias("place"))


@query("select 'page' as what, page_id as id from pg union all select 'file', id from fl union all select 'book', id from bk")
def set01_union_all(s: SparkSession, d: str) -> DataFrame:
    made = [x.select(F.lit(n).alias("what"), F.col(c).alias("id")) for n, x, c in (("page", pages(s, d, "number"), "page_id"), ("file", files(s, d), "id"), ("book", books(s, d), "id"))]
    return made[0].unionAll(made[1]).unionAll(made[2])


# --- sources and sinks --------------------------------------------------------------------------------------------------


@query("""select f.book_id, f.id, f.source_page from (select book_id, id, unnest(range(1, page_count + 3)) as source_page from fl where page_count > 0) f where not exists (select 1 from pg where pg.book_id = f.book_id and pg.source_id = f.id and pg.source_page = f.source_page)""")
def src04_pages_to_split(s: SparkSession, d: str) -> DataFrame:
    """The asked pages of each file, two more than it had, that aren't there yet: asking again gives nothing more."""
    asked = files(s, d).where("page_count > 0").select("book_id", "id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("page_count") + 2)).alias("source_page"))
    there = pages(s, d, "book_id", "source_id", "source_page").select("book_id", F.col("source_id").alias("id"), "source_page").distinct()
    return asked.join(there, ["book_id", "id", "source_page"], "left_anti")


_TURNS = "(1, 1, 0, 0, 1, 0, 0), (2, -1, 0, 0, 1, 1, 0), (3, -1, 0, 0, -1, 1, 1), (4, 1, 0, 0, -1, 0, 1), (5, 0, 1, 1, 0, 0, 0), (6, 0, 1, -1, 0, 1, 0), (7, 0, -1, -1, 0, 1, 1), (8, 0, -1, 1, 0, 0, 1)"


@query(f"""select page_id, t.o as orientation, a, b, c, e, tx * case when t.o > 4 then height else width end as tx, ty * case when t.o > 4 then width else height end as ty, case when t.o > 4 then height else width end as out_w from pg join (values {_TURNS}) t(o, a, b, c, e, tx, ty) on t.o = 1 + pg.number % 8 where width is not null and height is not null""")
def src07_orientation(s: SparkSession, d: str) -> DataFrame:
    """The affine map of each of the eight orientations an image may be stored in (here by the page's number), and the width it then has."""
    rows = [tuple(int(x) for x in part.strip("( )").split(",")) for part in _TURNS.split("), ")]
    turns = s.createDataFrame(rows, "orientation int, a int, b int, c int, e int, tx int, ty int")
    p = pages(s, d, "number", "width", "height").where("width is not null and height is not null").withColumn("orientation", (F.col("number") % 8 + 1).cast("int"))
    turned = F.col("orientation") > 4
    wide, high = F.when(turned, F.col("height")).otherwise(F.col("width")), F.when(turned, F.col("width")).otherwise(F.col("height"))
    return p.join(F.broadcast(turns), "orientation").select("page_id", "orientation", "a", "b", "c", "e", (F.col("tx") * wide).alias("tx"), (F.col("ty") * high).alias("ty"), wide.alias("out_w"))


@query("""select id, file_no, case when json_valid(layout_json) and json_type(layout_json) = 'OBJECT' then 'row' else 'error' end as outcome from bk""")
def src19_failures_apart(s: SparkSession, d: str) -> DataFrame:
    """Records written as a file each and read again: a bad one gives an error row, the good ones stay."""
    out = scratch(s, "uploads")
    b = books(s, d).select("id", "file_no", F.coalesce("layout_json", F.lit("")).alias("layout_json"))
    b.select(F.to_json(F.struct("id", "file_no", "layout_json")).alias("value")).write.text(out)
    return records.isolated(s, out, "id string, file_no int, layout_json string", "layout_json").select("id", "file_no", "outcome")


@query("""select page_id, book_id, number, status from pg where selected = 1""")
def snk02_atomic_json(s: SparkSession, d: str) -> DataFrame:
    """Rows exported as JSON and read again: the commit of the writing job makes all of them visible at once, or none."""
    out = scratch(s, "export")
    rows = pages(s, d, "book_id", "number", "status", "selected").where("selected = 1").select("page_id", "book_id", "number", "status")
    return records.exported(rows, out, "json")


@query("""select page_id, 'json' as format, 'available' as state from pg where text is not null union all select page_id, 'tex', case when render_strategy = 'custom_latex' then 'available' when status = 'failed' then 'failed' else 'pending' end from pg where text is not null
 union all select page_id, 'zip', case when selected = 1 then 'available' else 'pending' end from pg where text is not null""")
def snk05_formats(s: SparkSession, d: str) -> DataFrame:
    """Three formats of a page settled apart: what is available stays so, whatever the others come to."""
    tex = F.when(F.col("render_strategy") == "custom_latex", "available").when(F.col("status") == "failed", "failed").otherwise("pending")
    each = F.create_map(F.lit("json"), F.lit("available"), F.lit("tex"), tex, F.lit("zip"), F.when(F.col("selected") == 1, "available").otherwise("pending"))
    return pages(s, d, "text", "render_strategy", "status", "selected").where("text is not null").select("page_id", F.explode(each).alias("format", "state"))


@query("""select book_id, id, cast(ends - page_count + 1 as bigint) as first, cast(ends as bigint) as last, part, case when part and bad > 0 then 'partial, needs_review' when part then 'partial' when bad > 0 then 'needs_review' else 'passed' end as quality from
 (select f.book_id, f.id, f.page_count, sum(f.page_count) over (partition by f.book_id order by f.position, f.id rows unbounded preceding) as ends, coalesce(c.n, 0) < f.page_count as part, coalesce(c.bad, 0) as bad from fl f left join (select book_id, source_id, count(*) as n, count(*) filter (result_status = 'failed') as bad from pg group by all) c on c.book_id = f.book_id and c.source_id = f.id where f.page_count is not null)""")
def snk06_manifest(s: SparkSession, d: str) -> DataFrame:
    """Output pages of each file: where they begin and end, whether all are there, and how good they are."""
    c = pages(s, d, "book_id", "source_id", "result_status").groupBy("book_id", F.col("source_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("result_status") == "failed").alias("bad"))
    f = I.offsets(files(s, d).where("page_count is not null"), ["book_id"], [F.col("position"), F.col("id")], "page_count").join(c, ["book_id", "id"], "left")
    part, bad = F.coalesce("n", F.lit(0)) < F.col("page_count"), F.coalesce("bad", F.lit(0)) > 0
    quality = F.when(part & bad, "partial, needs_review").when(part, "partial").when(bad, "needs_review").otherwise("passed")
    return f.select("book_id", "id", F.col("starts").alias("first"), F.col("ends").alias("last"), part.alias("part"), quality.alias("quality"))


@query("""select 'page,' || page_id || ',' || coalesce(status, '') as line from pg where selected = 1""")
def snk07_text_export(s: SparkSession, d: str) -> DataFrame:
    """Rows exported as lines of text and read again."""
    out = scratch(s, "export")
    rows = pages(s, d, "status", "selected").where("selected = 1").select(F.concat_ws(",", F.lit("page"), "page_id", F.coalesce("status", F.lit(""))).alias("value"))
    return records.exported(rows, out, "text").withColumnRenamed("value", "line")


@query()
def snk09_bounded_bodies(s: SparkSession, d: str) -> DataFrame:
    """Bodies kept up to 300 bytes, cut between characters, with a mark where something was cut."""
    return pages(s, d, "text").where("text is not null").select("page_id", T.utf8_prefix(F.col("text"), 300).alias("body"), (F.octet_length("text") > 300).alias("truncated"))


@query(LAY + """select page_id, coalesce(layout_schema_version, 0) as version, l->>'$.body_font_family' as family from lay where l is not null and layout_schema_version is not null and number % 5 <> 0""")
def src14_versioned_cache(s: SparkSession, d: str) -> DataFrame:
    """Analyses saved beside their version and read again: those of pages that changed since are passed over."""
    out = scratch(s, "analysis")
    p = layouts(s, d, "layout_schema_version", "number").where("l is not null")
    records.save_versioned(p.select("page_id", F.col("layout_schema_version").alias("version"), F.col("l").alias("body")), out)
    now = p.select("page_id", F.when(F.col("number") % 5 == 0, -1).otherwise(F.col("layout_schema_version")).alias("version"))
    return records.load_versioned(s, out, now).select("page_id", "version", F.get_json_object("body", "$.body_font_family").alias("family"))


@query("""select pg.page_id, pg.book_id, case when not exists (select 1 from at_ where at_.book_id = pg.book_id and at_.page_number = pg.number and at_.returned = 1) then 'new' else 'again' end as state from pg where pg.status = 'failed' and not exists (select 1 from at_ where at_.book_id = pg.book_id and at_.page_number = pg.number and at_.attempt >= 3)""")
def snk14_insert_select(s: SparkSession, d: str) -> DataFrame:
    """Rows inserted where nothing stands in the way, with a state of what there was before."""
    a = attempts(s, d).groupBy("book_id", F.col("page_number").alias("number")).agg(F.max("attempt").alias("last"), F.max("returned").alias("got"))
    p = pages(s, d, "book_id", "number", "status").where("status = 'failed'").join(a, ["book_id", "number"], "left").where("last is null or last < 3")
    return p.select("page_id", "book_id", F.when(F.coalesce("got", F.lit(0)) == 1, "again").otherwise("new").alias("state"))


# --- matching of placed lines, iteration --------------------------------------------------------------------------------


def placed_lines(s: SparkSession, d: str) -> DataFrame:
    """Per page the lines (text, bbox) of its blocks and of its first reading, and the boxes of its regions from top to bottom."""
    block = "array<struct<lines: array<struct<spans: array<struct<text: string>>, bbox: array<double>>>>>"
    lines = lambda c: F.flatten(F.transform(F.filter(c, lambda b: b["lines"].isNotNull()), lambda b: F.transform(b["lines"], lambda x: F.struct(F.array_join(F.transform(x["spans"], lambda y: y["text"]), "").alias("text"), x["bbox"].alias("bbox")))))
    own, first = F.from_json(valid("blocks_json", "["), block), F.from_json(F.get_json_object(valid("extraction_json", "{"), "$.blocks"), block)
    regions = F.from_json(F.get_json_object(valid("layout_source_json", "{"), "$.regions"), "array<struct<bbox: array<double>>>")
    bands = F.array_sort(F.transform(F.filter(regions, lambda r: F.size(r["bbox"]) == 4), lambda r: F.struct(F.get(r["bbox"], F.lit(1)).alias("y"), r["bbox"].alias("b"))))
    return pages(s, d, "blocks_json", "extraction_json", "layout_source_json").select("page_id", lines(own).alias("a"), lines(first).alias("b"), F.transform(bands, lambda x: x["b"]).alias("bands"))


@query()
def jon19_placed(s: SparkSession, d: str) -> DataFrame:
    """The line of the first reading that each placed line matches best: length, similarity, lead, and boxes that have 0.3 in common."""
    return M.best_matches(placed_lines(s, d), "page_id", "a", "b")


@query()
def jon20_bands(s: SparkSession, d: str) -> DataFrame:
    """Lines assigned to the bands of their page by the score of their boxes, in order; gaps of equal length filled."""
    p = placed_lines(s, d).select("page_id", F.transform("a", lambda x: x["bbox"]).alias("a"), "bands")
    return M.assigned_bands(p, "page_id", "a", "bands")


@query()
def itr06_solved_layout(s: SparkSession, d: str) -> DataFrame:
    """A page's layout solved in steps: lines matched by their text, others assigned to bands; how many of its lines each step settles."""
    p = placed_lines(s, d)
    matched = M.best_matches(p, "page_id", "a", "b").select("page_id", "line_no", F.lit("text").alias("how"))
    bands = M.assigned_bands(p.select("page_id", F.transform("a", lambda x: x["bbox"]).alias("a"), "bands"), "page_id", "a", "bands")
    rest = bands.join(matched, ["page_id", "line_no"], "left_anti").select("page_id", "line_no", F.lit("band").alias("how"))
    settled = matched.union(rest).groupBy("page_id").agg(F.count_if(F.col("how") == "text").alias("by_text"), F.count_if(F.col("how") == "band").alias("by_band"))
    whole = p.select("page_id", F.size("a").cast("bigint").alias("lines")).where("lines > 0")
    return whole.join(settled, "page_id", "left").fillna(0).select("page_id", "lines", "by_text", "by_band", (F.col("lines") - F.col("by_text") - F.col("by_band")).alias("open"))


_TRY = """, b as (select page_id, region_id, x0, x1, x1 - x0 as w from box where x0 < x1 and region_id is not null), n as (select *, case when w <= 0.8 and round(abs(least(greatest(x0, 0.1), 0.9 - w) - x0), 9) <= 0.05 then least(greatest(x0, 0.1), 0.9 - w) else x0 end as nx from b),
 p as (select page_id, region_id, round(0.1 - x0, 9) > 0 or round(x1 - 0.9, 9) > 0 as was, round(0.1 - nx, 9) > 0 or round(nx + w - 0.9, 9) > 0 as now from n)
"""


@query(_TRY + "select page_id, count(*) filter (was) as before, count(*) filter (now) as after, count(*) filter (now) < count(*) filter (was) and count(*) filter (now and not was) = 0 as accepted from p group by page_id")
def itr03_accepted(s: SparkSession, d: str) -> DataFrame:
    """A candidate layout (boxes nudged into their frame) taken only if it has strictly fewer problems and none that is new."""
    w = F.col("x1") - F.col("x0")
    into = F.least(F.greatest("x0", F.lit(0.1)), 0.9 - w)
    nx = F.when((w <= 0.8) & (F.round(F.abs(into - F.col("x0")), 9) <= 0.05), into).otherwise(F.col("x0"))
    out = lambda a, b: (F.round(0.1 - a, 9) > 0) | (F.round(b - 0.9, 9) > 0)
    n = boxes(s, d).where("x0 < x1 and region_id is not null").withColumn("nx", nx)
    p = n.select("page_id", out(F.col("x0"), F.col("x1")).alias("was"), out(F.col("nx"), F.col("nx") + w).alias("now"))
    c = p.groupBy("page_id").agg(F.count_if("was").alias("before"), F.count_if("now").alias("after"), F.count_if(F.col("now") & ~F.col("was")).alias("new"))
    return c.select("page_id", "before", "after", ((F.col("after") < F.col("before")) & (F.col("new") == 0)).alias("accepted"))


@query("""select book_id, number, place from (select pg.book_id, pg.number, row_number() over (partition by pg.book_id order by pg.manual_protected, pg.number) as place from pg where pg.result_status = 'failed' and not exists (select 1 from at_ where at_.book_id = pg.book_id and at_.page_number = pg.number and at_.attempt >= 3)) where place <= 3""")
def itr04_targets(s: SparkSession, d: str) -> DataFrame:
    """Up to three targets of each book that weren't tried often yet; the planner cuts each group to three before the shuffle."""
    tried = attempts(s, d).where("attempt >= 3").select("book_id", F.col("page_number").alias("number")).distinct()
    p = pages(s, d, "book_id", "number", "result_status", "manual_protected").where("result_status = 'failed'").join(tried, ["book_id", "number"], "left_anti")
    return p.withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy("manual_protected", "number")).cast("bigint")).where("place <= 3").select("book_id", "number", "place")


@query(""", up as (select book_id, id as node, id as above, parent_id from fl union all select up.book_id, up.node, f.id, f.parent_id from up join fl f on f.book_id = up.book_id and f.id = up.parent_id)
 select book_id, node, above from up""")
def itr05_closure(s: SparkSession, d: str) -> DataFrame:
    """Every file with all that is above it, and itself."""
    t = R.paths(files(s, d), "id", "parent_id", ["book_id"], "id")
    return t.select("book_id", "node", F.explode(F.split("path", "/")).alias("above"))


@query(""", gone as (select page_id, region_id from box where ord = 0), kept as (select page_id, region_id, parent_id, row_number() over (partition by page_id order by ord, region_id) - 1 as place from box b where ord > 0)
 select k.page_id, k.region_id, k.place, case when exists (select 1 from gone g where g.page_id = k.page_id and g.region_id = k.parent_id) then null else k.parent_id end as parent_id from kept k""")
def arr08_remove_and_cascade(s: SparkSession, d: str) -> DataFrame:
    """The first element of each page taken out: the others are renumbered, and what named it as parent loses that."""
    b = boxes(s, d)
    gone = b.where("ord = 0").select("page_id", F.col("region_id").alias("parent_id"), F.lit(True).alias("gone")).distinct()
    place = (F.row_number().over(Window.partitionBy("page_id").orderBy("ord", "region_id")) - 1).cast("bigint")
    kept = b.where("ord > 0").select("page_id", "region_id", "parent_id", place.alias("place"))
    return kept.join(gone, ["page_id", "parent_id"], "left").select("page_id", "region_id", "place", F.when(F.col("gone").isNull(), F.col("parent_id")).alias("parent_id"))


@query("""select id, case position % 3 when 0 then false else true end as inside from fl""")
def src15_contained(s: SparkSession, d: str) -> DataFrame:
    """Whether a saved path stays in its folder, told before anything is opened. Every third path is made to leave it."""
    path = F.when(F.col("position") % 3 == 0, F.concat(F.lit("a/../../"), "filename")).when(F.col("position") % 3 == 1, F.concat(F.lit("a/../"), "filename")).otherwise(F.concat(F.lit("./b/"), "filename"))
    return records.contained(files(s, d).select("id", path.alias("path")), "path", "/srv").select("id", "inside")
