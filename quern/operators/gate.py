"""The quality gate of pages: blocked URLs, short texts, few words, exact duplicates, language."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.hashing import squeezed
from quern.functions.text import language_hint, word_count
from quern.sources.crawl import written

BLOCKED_URLS = (r"/login", r"/signin", r"/signup", r"/register", r"/cart", r"/checkout", r"/search\?", r"/404")


def own_reason(url: Column, text: Column, min_length: int = 100, min_words: int = 10, blocked: Iterable[str] = BLOCKED_URLS) -> Column:
    """The first failure that a page has by itself; null if none."""
    t = F.coalesce(text, F.lit(""))
    return F.coalesce(
        F.when(url.rlike("(?i)" + "|".join(f"(?:{b})" for b in blocked)) if list(blocked) else F.lit(False), "blocked_pattern"),
        F.when(F.length(t) < min_length, "too_short"), F.when(word_count(t) < min_words, "low_word_count"),
    )


def gated(pages: DataFrame, key: str, url: str | None = None, text: str = "text", min_length: int = 100, min_words: int = 10, languages: Iterable[str] = (), blocked: Iterable[str] = BLOCKED_URLS, duplicates: bool = True, keep: Iterable[str] | None = None) -> DataFrame:
    """``pages`` with ``reason`` ('passed' or the first failure) and ``duplicate_of``, the first page of equal content.

    Only pages that fail nothing of their own claim their content, in order of ``key``, even if their language
    then rejects them. Texts are looked at once: a narrow table of keys, own failures and 128-bit content hashes is
    written, and equal hashes meet in it, counted before they are shuffled. With ``keep`` the result has these columns
    and the key besides, which the narrow table then carries; without it all columns are joined back by key."""
    languages = list(languages)
    wrong = F.coalesce(~language_hint(F.col(text)).isin(*languages), F.lit(False)) if languages else F.lit(False)
    judged = pages.withColumn("own", own_reason(F.col(url) if url else F.lit(""), F.col(text), min_length, min_words, blocked)).withColumn("wrong", wrong)
    failure = lambda double: F.coalesce("own", F.when(double, "duplicate_content"), F.when(F.col("wrong"), "wrong_language"), F.lit("passed"))
    if not duplicates:
        out = judged.withColumn("duplicate_of", F.lit(None).cast(pages.schema[key].dataType)).withColumn("reason", failure(F.lit(False))).drop("own", "wrong")
        return out if keep is None else out.select(key, *keep, "reason", "duplicate_of")
    carried = [c for c in keep or () if c != key]
    # a row that fails by itself has a hash of its own, so that the join spreads such rows
    narrow = written(judged.select(key, *carried, "own", "wrong", F.when(F.col("own").isNull(), F.md5(squeezed(F.col(text)))).otherwise(F.concat(F.lit("-"), F.col(key).cast("string"))).alias("digest")))
    first = narrow.where("own is null").groupBy("digest").agg(F.min(key).alias("duplicate_of"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    double = F.col("duplicate_of").isNotNull() & (F.col("duplicate_of") != F.col(key))
    out = narrow.join(first, "digest", "left").withColumn("duplicate_of", F.when(double, F.col("duplicate_of"))).withColumn("reason", failure(F.col("duplicate_of").isNotNull()))
    out = out.select(key, *carried, "reason", "duplicate_of")
    return out if keep is not None else pages.join(out, key)
