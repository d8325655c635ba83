"""HTML expressions: plain text, metadata, headings; regular expressions inside one stage, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import stripped

ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def none_if_empty(x: Column) -> Column:
    return F.when(x != "", x)


def text(html: Column) -> Column:
    """Without scripts and styles, each tag a line break, blank lines collapsed; entities stay as they are."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", "\n"), r"\n\s*\n", "\n\n")
    return stripped(out)


def clean(x: Column) -> Column:
    """Six entities decoded, white space single."""
    for entity, char in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(x, r"\s+", " "))


def meta(html: Column, name: str) -> Column:
    """The content of a meta tag by name or property, whichever attribute comes first; null without one."""
    n = name.replace(".", r"\.")
    a = F.regexp_extract(html, rf"(?is)<meta\s+[^>]*(?:name|property)=[\"']{n}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)
    b = F.regexp_extract(html, rf"(?is)<meta\s+[^>]*content=[\"']([^\"']*)[\"'][^>]*(?:name|property)=[\"']{n}[\"']", 1)
    return F.coalesce(none_if_empty(clean(a)), none_if_empty(clean(b)))


def title(html: Column) -> Column:
    """The title element, else og:title, else the first level-one heading without tags in it."""
    of = lambda tag: none_if_empty(clean(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>([^<]+)</{tag}>", 1)))
    return F.coalesce(of("title"), meta(html, "og:title"), of("h1"))


def canonical(html: Column) -> Column:
    a = F.regexp_extract(html, r"(?is)<link\s+[^>]*rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']+)[\"']", 1)
    b = F.regexp_extract(html, r"(?is)<link\s+[^>]*href=[\"']([^\"']+)[\"'][^>]*rel=[\"']canonical[\"']", 1)
    return F.coalesce(none_if_empty(a), none_if_empty(b))


def language(html: Column) -> Column:
    """The primary tag of the html element's lang, else of the language meta tag."""
    lang = none_if_empty(F.regexp_extract(html, r"(?is)<html[^>]*\slang=[\"']([^\"']+)[\"']", 1))
    return F.lower(F.split_part(F.coalesce(lang, meta(html, "language"), meta(html, "content-language")), F.lit("-"), F.lit(1)))


def keywords(html: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(meta(html, "keywords"), F.lit("")), ","), lambda x: F.btrim(x)), lambda x: x != "")


def headings(html: Column) -> Column:
    """array<struct(level, text, anchor)> of headings without tags inside, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>[^<]+</h[1-6]>"), F.lit(0))
    one = lambda x, pattern: F.regexp_extract(x, pattern, 1)
    return F.transform(found, lambda x: F.struct(one(x, "(?i)^<h([1-6])").cast("int").alias("level"), clean(one(x, ">([^<]+)<")).alias("text"), none_if_empty(one(x, r"(?i)^<h[1-6][^>]*\sid=[\"']([^\"']+)[\"']")).alias("anchor")))


def metadata(html: Column) -> Column:
    """All of a page's metadata in one struct; dates are tried by name and by property."""
    return F.struct(
        title(html).alias("title"), F.coalesce(meta(html, "description"), meta(html, "og:description")).alias("description"), canonical(html).alias("canonical_url"),
        language(html).alias("language"), keywords(html).alias("keywords"), meta(html, "author").alias("author"),
        F.coalesce(meta(html, "article:published_time"), meta(html, "date")).alias("published"), F.coalesce(meta(html, "article:modified_time"), meta(html, "last-modified")).alias("modified"),
        meta(html, "og:image").alias("og_image"), meta(html, "og:type").alias("og_type"), meta(html, "og:site_name").alias("og_site_name"), headings(html).alias("headings"),
    )


def links(html: Column) -> Column:
    """array<struct(attrs, inner)> of anchors in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\s+[^>]*>.*?</a>"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"(?is)^<a\s+([^>]*)>", 1).alias("attrs"), F.regexp_extract(x, r"(?is)^<a\s+[^>]*>(.*)</a>$", 1).alias("inner")))


def needs_rendering(html: Column, markdown: Column) -> Column:
    """Whether a page seems to be drawn by scripts: no text, or a framework's mark and little text."""
    marks = ('id="root"', 'id="app"', "__NEXT_DATA__", "ng-app", "data-reactroot", "window.__NUXT__", "enable JavaScript")
    mark = F.lit(False)
    for m in marks:
        mark = mark | html.contains(m)
    size = F.length(F.coalesce(markdown, F.lit("")))
    return (size == 0) | (mark & (size < 500))
