"""URL expressions: parts, normal form, domains, extensions and output paths, all native columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path, query, fragment, as RFC 3986 splits a reference.
SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
TRACKING = ("fbclid", "gclid", "ref", "source", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
#: Suffixes of two labels under which names are registered; a bounded subset of the public list.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "co.in", "co.kr", "co.za", "com.tr", "com.ar", "com.sg", "com.hk", "com.tw", "github.io")


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, SPLIT, n)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column) -> Column:
    return F.lower(part(url, 2))


def path(url: Column) -> Column:
    return part(url, 3)


def host(url: Column) -> Column:
    """The authority in lower case up to its first colon."""
    return F.split_part(authority(url), F.lit(":"), F.lit(1))


def registered_domain(url: Column) -> Column:
    """The label under the longest known suffix, with it; a suffix of one label otherwise; the host if it has no dot."""
    labels = F.split(host(url), r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    return F.when(last(2).isin(*SUFFIXES), last(3)).otherwise(last(2))


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normal_query(query: Column, drop: Iterable[str] = (), ordered: bool = True) -> Column:
    """The query without tracking keys, by key and value, encoded anew."""
    gone = [*TRACKING, *drop]
    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.struct(_decoded(F.split_part(x, F.lit("="), F.lit(1))).alias("k"), _decoded(F.regexp_replace(x, "^[^=]*=?", "")).alias("v")))
    kept = F.filter(pairs, lambda p: ~p["k"].isin(*gone))
    keys = F.array_distinct(F.transform(kept, lambda p: p["k"]))
    rows = F.array_sort(kept) if ordered else F.flatten(F.transform(keys, lambda k: F.filter(kept, lambda p: p["k"] == k)))
    return F.array_join(F.transform(rows, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def normalize(url: Column, drop: Iterable[str] = (), strip_www: bool = False, keep_fragment: bool = False, ordered: bool = True) -> Column:
    """One form for URLs of one page: lower-case scheme and authority, no default port, single slashes, no slash at
    the end, no tracking keys, sorted query, no fragment. What has no scheme stays as it is, but for its path."""
    s, a = scheme(url), authority(url)
    a = F.when(s == "http", F.regexp_replace(a, ":80$", "")).when(s == "https", F.regexp_replace(a, ":443$", "")).otherwise(a)
    if strip_www:
        a = F.regexp_replace(a, r"^www\.", "")
    p = F.regexp_replace(F.regexp_replace(path(url), "/+", "/"), ";[^/]*$", "")
    p = F.regexp_replace(F.regexp_replace(p, "%7[Ee]", "~"), "/+$", "")
    p = F.when(p == "", F.lit("/")).otherwise(p)
    q = normal_query(part(url, 4), drop, ordered)
    out = F.concat(F.when(s != "", F.concat(s, F.lit(":"))).otherwise(""), F.when(a != "", F.concat(F.lit("//"), a)).otherwise(""), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.concat(out, F.when(part(url, 5) != "", F.concat(F.lit("#"), part(url, 5))).otherwise("")) if keep_fragment else out


def extension(url: Column) -> Column:
    """The lower-case extension of the path with its dot, empty if there is none of at most ten characters."""
    e = F.lower(F.regexp_extract(path(url), r"(\.[^./]{1,9})$", 1))
    return e


def output_path(url: Column) -> Column:
    """Where a page's Markdown goes: index.md for the root, a folder's index without an extension, else the name and .md."""
    p = F.regexp_replace(path(url), "^/+|/+$", "")
    bare = F.regexp_replace(p, r"\.(html|htm|php|aspx|asp)$", "")
    last = F.regexp_extract(bare, "([^/]*)$", 1)
    return F.when(p == "", F.lit("index.md")).when(last.contains("."), F.concat(bare, F.lit(".md"))).otherwise(F.concat(bare, F.lit("/index.md")))


def resolve(base: Column, ref: Column) -> Column:
    """A reference against its page's URL, dot segments removed natively, as RFC 3986 does it."""
    b_scheme, b_auth, b_path = part(base, 1), part(base, 2), path(base)
    r_path, q = path(ref), F.regexp_extract(ref, r"^[^?#]*(\?[^#]*)", 1)
    fragment = F.regexp_extract(ref, "(#.*)$", 1)
    folder = F.regexp_extract(b_path, "^(.*/)", 1)
    joined = F.when(r_path.startswith("/"), r_path).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), r_path))
    walked = F.aggregate(
        F.split(joined, "/"), F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x))),
    )
    clean = F.concat(F.array_join(walked, "/"), F.when(joined.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(""))
    root = F.concat(b_scheme, F.lit("://"), b_auth)
    return (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref).when(ref.startswith("//"), F.concat(b_scheme, F.lit(":"), ref))
        .when(r_path == "", F.concat(root, b_path, F.when(q != "", q).otherwise(F.regexp_extract(base, r"(\?[^#]*)", 1)), fragment))
        .otherwise(F.concat(root, F.when(joined.contains("/."), clean).otherwise(joined), q, fragment))
    )


def same_site(host_: Column, domains: Iterable[str], subdomains: bool = True) -> Column:
    """Whether a host is one of the domains or, if so wished, below one."""
    hit = F.lit(False)
    for d in domains:
        d = d.lower().split(":")[0]
        hit = hit | (host_ == d) | (host_.endswith("." + d) if subdomains else F.lit(False))
    return hit
