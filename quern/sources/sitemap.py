"""Sitemaps as rows: entries, indexes of one level, discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.html import clean

PLACES = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap.xml", "/sitemaps.xml")
FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")


def timestamp(x: Column) -> Column:
    """The first of four formats that fits, in UTC; null if none."""
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in FORMATS])


def _field(x: Column, name: str) -> Column:
    v = clean(F.regexp_extract(x, rf"(?is)<(?:\w+:)?{name}[^>]*>(.*?)</(?:\w+:)?{name}>", 1))
    return F.when(v != "", v)


def entries(bodies: DataFrame, kind: str = "url") -> DataFrame:
    """Entries (source, loc, lastmod, changefreq, priority) of sitemap bodies (source, body), with or without a namespace."""
    found = F.regexp_extract_all("body", F.lit(rf"(?is)<(?:\w+:)?{kind}>.*?</(?:\w+:)?{kind}>"), F.lit(0))
    e = bodies.select("source", F.explode(found).alias("e"))
    return e.select("source", _field(F.col("e"), "loc").alias("loc"), timestamp(_field(F.col("e"), "lastmod")).alias("lastmod"), _field(F.col("e"), "changefreq").alias("changefreq"), F.expr("try_cast(regexp_extract(e, '(?is)<(?:[a-z]+:)?priority[^>]*>([^<]*)<', 1) AS DOUBLE)").alias("priority")).where("loc IS NOT NULL")


def all_entries(roots: DataFrame, bodies: DataFrame) -> DataFrame:
    """Entries of the roots (source) and, where a root is an index, of the sitemaps it names, one level deep; each loc once with its newest date."""
    mine = bodies.join(roots.select("source").distinct(), "source", "left_semi")
    named = entries(mine, "sitemap").select(F.col("loc").alias("source")).distinct()
    below = bodies.join(named, "source", "left_semi")
    rows = entries(mine).unionByName(entries(below))
    return rows.groupBy("loc").agg(F.max("lastmod").alias("lastmod"), F.max_by("changefreq", F.coalesce("lastmod", F.lit("1970-01-01").cast("timestamp"))).alias("changefreq"), F.max("priority").alias("priority"))


def discovered(sites: DataFrame, available: DataFrame, directives: DataFrame) -> DataFrame:
    """(base, source): the first usual place that is there, and what robots files name."""
    places = sites.select("base", F.posexplode(F.array(*[F.concat("base", F.lit(p)) for p in PLACES])).alias("n", "source"))
    there = places.join(available.select("source").distinct(), "source", "left_semi").groupBy("base").agg(F.min_by("source", "n").alias("source"))
    return there.unionByName(directives.select("base", "source")).distinct()
