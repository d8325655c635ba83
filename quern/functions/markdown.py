"""Markdown from HTML: marks by expressions, and content blocks kept by size, link share or a query's BM25 score."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.html import ENTITIES

DROPPED = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript", "iframe", "svg")
#: What becomes of tags, in this order; other tags go.
MARKS = (
    *((rf"(?is)<h{n}[^>]*>(.*?)</h{n}>", "\n\n" + "#" * n + " $1\n\n") for n in range(1, 7)),
    (r"(?is)<(?:b|strong)>(.*?)</(?:b|strong)>", "**$1**"), (r"(?is)<(?:i|em)>(.*?)</(?:i|em)>", "*$1*"), (r"(?is)<code>(.*?)</code>", "`$1`"),
    (r"(?is)<a\s[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "[$2]($1)"), (r"(?is)<img\s[^>]*src=[\"']([^\"']*)[\"'][^>]*>", "![]($1)"),
    (r"(?is)<li[^>]*>", "\n- "), (r"(?is)<br\s*/?>", "\n"), (r"(?is)</?(?:p|div|section|article|main|ul|ol|table|tr|blockquote|pre|title|body|head|html)(?:\s[^>]*)?>", "\n\n"), (r"(?s)<[^>]+>", ""),
)


def chain(links: bool = True, images: bool = True, dropped: Iterable[str] = DROPPED) -> list[tuple[str, str]]:
    """All replacements (pattern, replacement), comments and dropped elements first, white space last."""
    out = [(r"(?s)<!--.*?-->", "")]
    out += [(rf"(?is)<{t}(?:\s[^>]*)?>.*?</{t}>", "") for t in dropped]
    for pattern, to in MARKS:
        if to == "[$2]($1)" and not links:
            to = "$2"
        if to == "![]($1)" and not images:
            to = ""
        out.append((pattern, to))
    return [*out, (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")]


def markdown(html: Column, links: bool = True, images: bool = True, dropped: Iterable[str] = DROPPED) -> Column:
    """The page as Markdown; six entities are decoded after the tags are gone."""
    for pattern, to in chain(links, images, dropped):
        html = F.regexp_replace(html, pattern, to)
    for entity, char in ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(char))
    return html


def chosen(*forms: Column) -> Column:
    """The first form that isn't empty."""
    return F.coalesce(*[F.when(F.btrim(x) != "", x) for x in forms])


def _words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def blocks(docs: DataFrame, key: str, text: str = "markdown") -> DataFrame:
    """(key, block, content, words, link_share) of the parts between blank lines, in order."""
    b = docs.select(key, F.posexplode(F.split(text, r"\n\n+")).alias("block", "content")).where("content <> ''")
    linked = F.aggregate(F.regexp_extract_all("content", F.lit(r"\[([^\]]*)\]\([^)]*\)"), F.lit(1)), F.lit(0), lambda s, x: s + F.length(x))
    return b.select(key, "block", "content", F.size(_words(F.col("content"))).alias("words"), (linked / F.length("content")).alias("link_share"))


def pruned(parts: DataFrame, least_words: int = 5, most_links: float = 0.5) -> DataFrame:
    """Blocks of enough words that aren't mostly links; headings stay."""
    return parts.where(F.col("content").rlike("^#") | ((F.col("words") >= least_words) & (F.col("link_share") <= most_links)))


def bm25(parts: DataFrame, key: str, query: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``parts`` with ``score``, BM25 of the query over all blocks; document frequencies and the mean length are one aggregate of all."""
    terms = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    rows = parts.withColumn("w", _words(F.col("content")))
    count = lambda t: F.size(F.filter("w", lambda x: x == t))
    rows = rows.withColumns({f"tf{i}": count(t) for i, t in enumerate(terms)})
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    scored = rows.crossJoin(F.broadcast(whole))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size("w") / F.col("mean")))
    return scored.select(*parts.columns, score.alias("score"))


def joined(parts: DataFrame, key: str) -> DataFrame:
    """(key, markdown): the blocks put together in order."""
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", "content"))).alias("x"))
    return rows.select(key, F.array_join(F.transform("x", lambda x: x["content"]), "\n\n").alias("markdown"))
