"""Change detection between snapshots, conditional fetches, deletions, events and staleness."""

from __future__ import annotations

import difflib
import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.hashing import content_hash

#: What changes on a page without meaning anything: times, relative times, counters, session ids.
NOISE = (r"(?i)\b\d{1,2}:\d{2}(:\d{2})?( ?[ap]m)?\b", r"(?i)\b\d+ (second|minute|hour|day|week|month|year)s? ago\b", r"(?i)\b[\d,]+ (view|comment|like|share)s?\b", r"(?i)\bsession[_-]?id=\w+")


def denoised(text: Column, noise: Iterable[str] = NOISE) -> Column:
    for pattern in noise:
        text = F.regexp_replace(text, pattern, "")
    return text


def normalized(text: Column, strip: Iterable[str] = (), lower: bool = False) -> Column:
    """Patterns stripped, white space single, lower case if wished."""
    t = F.btrim(F.regexp_replace(denoised(text, strip), r"\s+", " "))
    return F.lower(t) if lower else t


def noise_hash(text: Column, noise: Iterable[str] = NOISE) -> Column:
    return content_hash(denoised(text, noise))


def has_changed(old: Column, new: Column) -> Column:
    return old.isNull() | (old != new)


def events(old: DataFrame, new: DataFrame, key: str, content: str, gone: str | None = None) -> DataFrame:
    """(key, event): created, changed, unchanged; deleted for a tombstone, or for what the new snapshot doesn't have.

    Contents meet as hashes, so the join carries a key and 16 bytes a side."""
    a = old.select(F.col(key), F.md5(F.col(content)).alias("old_hash"), F.lit(True).alias("was"))
    b = new.select(F.col(key), F.md5(F.col(content)).alias("new_hash"), (F.col(gone) if gone else F.lit(False)).alias("gone"), F.lit(True).alias("now"))
    event = (
        F.when(F.col("now").isNull() | (F.col("gone") & F.col("was").isNotNull()), "deleted").when(F.col("was").isNull(), "created")
        .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "changed").otherwise("unchanged")
    )
    return a.join(b, key, "full").select(key, event.alias("event"))


def response(status: Column, had_validators: Column | None = None) -> Column:
    """unchanged, deleted, changed or failed, by HTTP status."""
    return F.when(status == 304, "unchanged").when(status.isin(404, 410), "deleted").when(status.between(200, 299), "changed").otherwise("failed")


def conditional_headers(etag: Column, modified: Column) -> Column:
    """map of the validators that a page has."""
    pairs = F.array(F.when(etag.isNotNull(), F.struct(F.lit("If-None-Match").alias("k"), etag.alias("v"))), F.when(modified.isNotNull(), F.struct(F.lit("If-Modified-Since").alias("k"), modified.alias("v"))))
    return F.map_from_entries(F.filter(pairs, lambda x: x.isNotNull()))


def deletion(status: Column, error_count: Column, threshold: int = 2) -> Column:
    """deleted once so many not-found answers follow one another, pending_deletion before."""
    return F.when(status.isin(404, 410), F.when(error_count + 1 >= threshold, "deleted").otherwise("pending_deletion"))


def sitemap_skip(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Pages to check: all but those whose sitemap entry (loc, lastmod) isn't newer than the last crawl."""
    s = sitemap.select(F.col("loc").alias("url"), "lastmod").groupBy("url").agg(F.max("lastmod").alias("lastmod"))
    return pages.join(s, "url", "left").where(F.col("lastmod").isNull() | F.col("last_crawled").isNull() | (F.col("lastmod") > F.col("last_crawled"))).drop("lastmod")


def needs_recrawl(tombstone: Column, last_crawled: Column, now: Column, max_age_hours: float | None, force: Column | bool = False) -> Column:
    forced = force if isinstance(force, Column) else F.lit(force)
    if max_age_hours is None:
        old = F.lit(True)
    else:
        old = F.unix_micros(now.cast("timestamp")) - F.unix_micros(last_crawled.cast("timestamp")) > F.lit(int(max_age_hours * 3_600_000_000)).cast("long")
    return F.when(forced, True).when(tombstone, False).when(last_crawled.isNull(), True).otherwise(old)


def diff_ratio(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """``pairs`` with ``ratio``, the sequence matcher's likeness of two texts, and ``significant`` (a tenth or more differs)."""

    @F.arrow_udf("double")
    def ratio(a, b):
        import pyarrow as pa

        return pa.array([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    return pairs.withColumn("ratio", ratio(F.col(old), F.col(new))).withColumn("significant", 1 - F.col("ratio") >= 0.1)


class Emitter:
    """Hands event rows to handlers on the driver; a handler that fails doesn't stop the others."""

    def __init__(self):
        self.handlers: list[Callable[[dict], None]] = []
        self.errors: list[Exception] = []

    def on(self, handler: Callable[[dict], None]) -> None:
        self.handlers.append(handler)

    def emit(self, rows: DataFrame) -> int:
        n = 0
        for row in rows.toLocalIterator():
            n += 1
            for h in self.handlers:
                try:
                    h(row.asDict(recursive=True))
                except Exception as e:  # noqa: BLE001
                    self.errors.append(e)
        return n


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def parsed(line: str) -> dict:
    return json.loads(line)
