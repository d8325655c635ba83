"""The crawl frontier: priorities, admission of a wave, and its bookkeeping."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quern.functions import urls

SEED_PRIORITY = 1000.0
DOCS = ("/docs", "/documentation", "/guide", "/tutorial", "/reference", "/api")
ARCHIVES = ("/archive", "/tag", "/category", "/page/", "/author", "/feed")


def _any(url: Column, words: Iterable[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower(url).contains(w)
    return hit


def priority(url: Column, depth: Column) -> Column:
    """100 / (depth + 1), half more for documentation, half of it for archives."""
    return F.lit(100.0) / (depth + 1) * F.when(_any(url, DOCS), 1.5).otherwise(1.0) * F.when(_any(url, ARCHIVES), 0.5).otherwise(1.0)


def admit(candidates: DataFrame, seen: DataFrame, room: int) -> DataFrame:
    """Candidates (url_key, url, depth, priority) not seen, each key once (least depth, then highest priority, then URL), the ``room`` of highest priority."""
    one = W.Window.partitionBy("url_key").orderBy("depth", F.desc("priority"), "url")
    fresh = candidates.join(seen.select("url_key"), "url_key", "left_anti").withColumn("n", F.row_number().over(one)).where("n = 1").drop("n")
    return fresh.orderBy(F.desc("priority"), "url_key").limit(room)


def top(frontier: DataFrame, k: int) -> DataFrame:
    """The ``k`` pending items to fetch next."""
    return frontier.where("status = 'pending'").orderBy(F.desc("priority"), F.asc("discovered_at"), "url_key").limit(k)


def returned(frontier: DataFrame, failed: DataFrame) -> DataFrame:
    """Items of ``failed`` (url_key) go back to pending at half their priority, one retry more."""
    mark = failed.select("url_key", F.lit(True).alias("again"))
    again = F.col("again").isNotNull()
    return frontier.join(mark, "url_key", "left").withColumns({
        "status": F.when(again, "pending").otherwise(F.col("status")), "priority": F.when(again, F.col("priority") / 2).otherwise(F.col("priority")),
        "retries": F.col("retries") + again.cast("int"),
    }).drop("again")


def stats(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("status").agg(F.count(F.lit(1)).alias("items"), F.max("depth").alias("max_depth"))


def by_domain(frontier: DataFrame) -> DataFrame:
    """(domain, pending, in_progress, completed, failed, items) of each host."""
    count = lambda k: F.count_if(F.col("status") == k).alias(k)
    return frontier.groupBy(urls.host(F.col("url")).alias("domain")).agg(count("pending"), count("in_progress"), count("completed"), count("failed"), F.count(F.lit(1)).alias("items"))
