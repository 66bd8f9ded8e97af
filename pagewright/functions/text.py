"""Scalar functions on text as Column expressions; they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that TeX reserves and how they are written.
TEX = {
    "\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}",
}


def escape_tex(c: Column) -> Column:
    """One pass over the characters: replacements hold reserved characters themselves, so chained replacing would be wrong."""
    table = F.create_map(*[F.lit(x) for pair in TEX.items() for x in pair])
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")


_SPACE = r"(?:\s|%[^\r\n]*(?:\r\n?|\n|\z))*"
_OPTIONS = rf"(?:\[[^\[\]]*\]{_SPACE})?"
_BRACED = rf"\{{[^{{}}]+\}}{_SPACE}"


def is_tex_document(c: Column) -> Column:
    """Whether a text begins with its class, after nothing but space, comments and packages that are asked for or given options."""
    before = rf"(?:\\RequirePackage{_SPACE}{_OPTIONS}{_BRACED}{_OPTIONS}|\\PassOptionsTo(?:Package|Class){_SPACE}{_BRACED}{_BRACED})*"
    return c.rlike(rf"\A{_SPACE}{before}\\documentclass{_SPACE}{_OPTIONS}\{{[^{{}}]+\}}")


def plain_text(c: Column) -> Column:
    """Comments, commands and markup taken out, white space folded."""
    c = F.regexp_replace(c, r"(?m)(?<!\\)%.*$", "")
    c = F.regexp_replace(c, r"\\[A-Za-z]+\*?|\\.", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[{}$&~^_\[\]]", " "), r"\s+", " "))


def image_names(c: Column) -> Column:
    """Names of included images in order of first mention (TeX and Markdown), as an array."""
    tex = F.regexp_extract_all(c, F.lit(r"\\includegraphics(?:\[[^\]]*\])?\{([^}]*)\}"), 1)
    md = F.regexp_extract_all(c, F.lit(r"!\[[^\]]*\]\(([^)\s]*)\)"), 1)
    return F.array_distinct(F.concat(tex, md))


def safe_path(c: Column) -> Column:
    """A relative path with forward slashes; null for absolute paths and such that leave their folder."""
    parts = F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    bad = c.rlike(r"^([A-Za-z]:|[\\/])") | F.exists(parts, lambda x: x == "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def redact(c: Column, key: str = "") -> Column:
    """A key by its letters, inline images, values of fields that hold keys, and inline data hidden. Addresses stay."""
    if key:
        c = F.replace(c, F.lit(key), F.lit("[hidden]"))
    c = F.regexp_replace(c, r"data:image/[a-zA-Z0-9.+-]+;base64,[A-Za-z0-9+/=]+", "[data]")
    c = F.regexp_replace(c, r'(?i)("(?:authorization|x-goog-api-key|api_key)"\s*:\s*")[^"\r\n]*', "$1[hidden]")
    return F.regexp_replace(c, r'("inlineData"\s*:\s*\{[^{}]*"data"\s*:\s*")[A-Za-z0-9+/=]+', "$1[data]")


def log_reason(c: Column) -> Column:
    """Why a compilation failed, of one line of its log; the first rule that matches. Paths are masked, reasons capped."""
    said = F.regexp_replace(F.regexp_replace(c, "^[! ]+", ""), r"(^|\s)/(?:[^\s/]+/)+[^\s\"'`]*", "$1[path]")
    return (
        F.when(c.rlike("File .*not found"), F.concat(F.lit("missing file "), F.regexp_extract(c, "File [`']([^`']+)[`']", 1)))
        .when(F.contains(c, F.lit("Undefined control sequence")), "unknown command")
        .when(F.lower(c).rlike("font.*(cannot be found|not loadable)"), "missing font")
        .when(c.startswith("!"), F.substring(said, 1, 240))
        .otherwise("not set")
    )


def base_url(c: Column) -> Column:
    """An http address of host, port and path; null with credentials, a query or a fragment."""
    return F.when(c.rlike(r"^https?://[^/?#@:\s]+(:\d+)?(/[^?#\s]*)?$"), c)


def url_path(c: Column) -> Column:
    """A path with a slash before it (an empty one stays empty); null if it has a scheme, host, query or fragment, or leaves its root."""
    bad = c.rlike(r"^[a-z]+:|^//|[?#]") | F.array_contains(F.split(c, "/"), "..")
    return F.when(c == "", c).when(~bad, F.when(c.startswith("/"), c).otherwise(F.concat(F.lit("/"), c)))


def selection(spec: Column, pages: Column) -> Column:
    """`odd`, `even`, or numbers and ranges -> sorted distinct page numbers; null if the expression is wrong or leaves 1..`pages`."""
    chosen = page_range(F.when(~spec.isin("odd", "even"), spec))
    every = lambda first: F.when(pages >= first, F.sequence(F.lit(first), F.greatest(pages, F.lit(first)), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.when(spec == "odd", every(1)).when(spec == "even", every(2)).when(F.forall(chosen, lambda p: p <= pages), chosen)


def canonical_json(fields: list[str]) -> Column:
    """A flat record as compact JSON with its keys in order and its nulls kept, whatever the order of `fields`."""
    return F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})


def utf8_prefix(c: Column, limit: int) -> Column:
    """The longest prefix of at most `limit` bytes of UTF-8 that ends between characters."""
    sizes = F.transform(F.split(c, ""), lambda x: F.octet_length(x))
    fit = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full")),
        lambda s, v: F.when(~s["full"] & (s["used"] + v <= limit), F.struct((s["used"] + v).alias("used"), (s["n"] + 1).alias("n"), F.lit(False).alias("full"))).otherwise(
            F.struct(s["used"].alias("used"), s["n"].alias("n"), F.lit(True).alias("full"))
        ),
        lambda s: s["n"],
    )
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.substring(c, F.lit(1), fit))


def short_number(c: Column) -> Column:
    """At most six decimals, no exponent, no trailing zeros."""
    s = F.format_string("%.6f", c)
    s = F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")
    return F.when(s.isin("-0", ""), "0").otherwise(s)


def safe_name(c: Column) -> Column:
    """Letters and digits of any script, `-` and `_`; runs of others become one `-`."""
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_-]+", "-"), r"^-+|-+$", "")


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def stable_id(prefix: str, *parts: Column) -> Column:
    """Version, dash and 20 hex digits of a hash of the parts (null as an empty text)."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 20))


def page_range(c: Column) -> Column:
    """`3,8-12` -> sorted distinct numbers; null if any part isn't a number or an ascending range of at most 10000."""
    parts = F.split(F.regexp_replace(F.regexp_replace(c, r"[，、;；]", ","), r"\s", ""), ",")
    good = F.forall(parts, lambda p: p.rlike(r"^[1-9]\d{0,5}(-[1-9]\d{0,5})?$"))
    lo = lambda p: F.split(p, "-")[0].cast("int")
    hi = lambda p: F.element_at(F.split(p, "-"), -1).cast("int")
    fine = good & F.forall(parts, lambda p: F.when(good, (lo(p) <= hi(p)) & (hi(p) - lo(p) < 10000)).otherwise(False))
    return F.when(fine, F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(lo(p), hi(p)))))))
