"""Links of pages, and the ordered gate that admits URLs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quern.functions import html, patterns, urls

SPECIAL = r"(?i)^(javascript:|mailto:|tel:|data:|#|void\()"
BLOCKED_EXTENSIONS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".tar", ".gz", ".rar", ".7z", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico", ".mp3", ".mp4", ".avi", ".mov", ".exe", ".dmg", ".css", ".js", ".woff", ".woff2", ".ttf")


def extract(pages: DataFrame, keys: Iterable[str] = ("page_id",), domains: Iterable[str] = ()) -> DataFrame:
    """One row a link: keys, position, href, text, is_internal, is_nofollow, anchor.

    Special schemes and what isn't http(s) after resolving go; of links to one scheme, authority and path, the
    first stays, so only positions of one page are compared and nothing is gathered across pages. ``domains``
    default to the page's own authority; hosts below them are internal too."""
    keys = list(keys)
    one = pages.select(*keys, "url", F.posexplode(html.links(F.col("html"))).alias("position", "a"))
    raw = F.regexp_extract("a.attrs", r"""href=["']([^"']+)["']""", 1)
    found = one.withColumn("raw", F.btrim(raw)).where((F.col("raw") != "") & ~F.col("raw").rlike(SPECIAL))
    found = found.withColumn("href", urls.resolve(F.col("url"), F.col("raw"))).where(F.col("href").rlike("(?i)^https?://"))
    found = found.withColumn("key", F.regexp_extract("href", r"^([^?#]*)", 1))
    first = W.Window.partitionBy(*keys, "key").orderBy("position")
    host, own = urls.authority(F.col("href")), urls.authority(F.col("url"))
    internal = (host == own) | (urls.same_site(urls.host(F.col("href")), domains) if list(domains) else urls.host(F.col("href")).endswith(F.concat(F.lit("."), urls.host(F.col("url")))))
    text = html.clean(F.regexp_replace("a.inner", r"<[^>]+>", " "))
    return found.withColumn("n", F.row_number().over(first)).where("n = 1").select(
        *keys, "position", "href", text.alias("text"), internal.alias("is_internal"), F.col("a.attrs").contains("nofollow").alias("is_nofollow"), html.none_if_empty(urls.part(F.col("href"), 5)).alias("anchor"),
    )


def targets(url: Column, page: Column) -> Column:
    """array<string>: where a page's links lead, resolved, http(s) only, each once in order."""
    raw = F.transform(html.links(page), lambda a: F.btrim(F.regexp_extract(a["attrs"], r"""href=["']([^"']+)["']""", 1)))
    found = F.transform(F.filter(raw, lambda r: (r != "") & ~r.rlike(SPECIAL)), lambda r: urls.resolve(url, r))
    return F.array_distinct(F.filter(found, lambda h: h.rlike("(?i)^https?://")))


def gate(
    url: Column, depth: Column, domains: Iterable[str] = (), subdomains: bool = True, prefixes: Iterable[str] = (), include: Iterable[str] = (), exclude: Iterable[str] = (),
    extensions: Iterable[str] = BLOCKED_EXTENSIONS, max_depth: int | None = None, seen: Column | None = None, schemes: Iterable[str] = ("http", "https"),
) -> Column:
    """Why a URL isn't admitted, the first reason in a fixed order, or 'allowed'."""
    domains, prefixes, include = list(domains), list(prefixes), list(include)
    scheme, host, path = urls.scheme(url), urls.host(url), urls.path(url)
    blocked = F.lower(path).rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$") if list(extensions) else F.lit(False)
    start = F.lit(not prefixes)
    for p in prefixes:
        start = start | path.startswith(p)
    steps = [
        (url.isNull() | (scheme == "") | (urls.authority(url) == ""), "invalid_url"), (~scheme.isin(*schemes), "invalid_scheme"),
        (seen if seen is not None else F.lit(False), "already_seen"), (depth > max_depth if max_depth is not None else F.lit(False), "max_depth_exceeded"),
        (~urls.same_site(host, domains, subdomains) if domains else F.lit(False), "domain_not_allowed"), (~start, "path_not_allowed"), (blocked, "blocked_extension"),
        (patterns.matches_any(url, exclude), "excluded_pattern"), (~patterns.matches_any(url, include) if include else F.lit(False), "no_include_match"),
    ]
    return F.coalesce(*[F.when(test, F.lit(name)) for test, name in steps], F.lit("allowed"))


def unseen(candidates: DataFrame, seen: DataFrame, key: str = "url_key") -> DataFrame:
    """Candidates whose key wasn't seen."""
    return candidates.join(seen.select(key).distinct(), key, "left_anti")


def allowed_domains(configured: Iterable[str], seeds: Iterable[str]) -> list[str]:
    """Configured domains and the seeds' hosts, without ports, each once."""
    from urllib.parse import urlsplit

    return sorted({d.lower().split(":")[0] for d in configured} | {urlsplit(s).netloc.lower().split(":")[0] for s in seeds})
