"""The crawl and sync jobs: waves of set-based plans over pages, versions and links."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quern.functions import hashing, html, text, urls
from quern.operators import changes, frontier, gate, links, metrics
from quern.sources import robots as R
from quern.sources.config import Crawl, Sync
from quern.sources.crawl import checkpoints


@dataclass
class Hooks:
    """Functions of the user: texts to texts for redaction, and rows on the driver once a run has ended."""

    redact: list[Callable[[str], str]] = field(default_factory=list)
    on_page: list[Callable[[dict], None]] = field(default_factory=list)
    on_error: list[Callable[[dict], None]] = field(default_factory=list)
    on_change: list[Callable[[dict], None]] = field(default_factory=list)
    on_deletion: list[Callable[[dict], None]] = field(default_factory=list)
    errors: list[Exception] = field(default_factory=list)

    def redacted(self, column: Column) -> Column:
        """The column through every redaction in one Arrow call; one that fails leaves the text as it was."""
        if not self.redact:
            return column
        functions = list(self.redact)

        @F.arrow_udf("string")
        def run(values):
            import pyarrow as pa

            def one(x):
                for f in functions:
                    try:
                        x = f(x) if x is not None else None
                    except Exception:  # noqa: BLE001 - a user's function may fail in any way
                        pass
                return x

            return pa.array([one(v) for v in values.to_pylist()], pa.string())

        return run(column)

    def call(self, which: str, rows: DataFrame) -> None:
        handlers = getattr(self, which)
        if handlers:
            emitter = changes.Emitter()
            emitter.handlers = handlers
            emitter.emit(rows)
            self.errors += emitter.errors


@dataclass
class Crawled:
    documents: DataFrame
    log: DataFrame
    links: DataFrame
    seen: DataFrame
    #: url, page_id and status_code of what answered 404 or 410
    gone: DataFrame
    seconds: float = 0.0

    def metrics(self) -> DataFrame:
        return metrics.run(self.log)


def complete(results: DataFrame) -> DataFrame:
    """Fetch results with the columns that a fetcher may leave out, as nulls."""
    missing = {"etag": "string", "last_modified": "string", "latency_ms": "double"}
    return results.withColumns({c: F.lit(None).cast(kind) for c, kind in missing.items() if c not in results.columns})


def extracted(results: DataFrame) -> DataFrame:
    """Text, metadata, hash and counts of fetched pages, all in one projection."""
    m = html.metadata(F.col("html"))
    out = results.withColumn("m", m).withColumn("markdown", html.text(F.col("html")))
    return out.withColumns({
        "title": F.col("m.title"), "description": F.col("m.description"), "canonical_url": F.col("m.canonical_url"), "language": F.col("m.language"), "headings": F.col("m.headings"),
        "plain_text": text.plain(F.col("markdown")), "content_hash": hashing.content_hash(F.col("markdown")), "word_count": text.word_count(F.col("markdown")), "char_count": F.length("markdown").cast("long"),
        "outlinks": links.targets(F.col("url"), F.col("html")),
    }).drop("m")


def crawl(spark: SparkSession, config: Crawl, fetch: Callable[[DataFrame], DataFrame], rules: DataFrame | Callable[[DataFrame], DataFrame] | None = None, hooks: Hooks | None = None, checkpoint: Callable[[DataFrame], DataFrame] | None = None) -> Crawled:
    """Documents reached from the seeds, wave by wave, until a wave is empty or ``max_pages`` are discovered.

    ``fetch`` gives results (url, status, status_code, html, and etag, last_modified and latency_ms if it has them) for
    requests (url). ``rules`` are robots rules, or a function that has them for a wave, as robots.gathered does. A wave filters before it
    fetches, admits by priority, extracts, passes the gate and lists the internal links of what passed; each
    wave's results are checkpointed, so a lost executor costs a wave at most. The cap counts what is admitted,
    whether or not it can be fetched."""
    checkpoints(spark)
    cut = checkpoint or (lambda df: df.checkpoint())
    hooks = hooks or Hooks()
    began = time.monotonic()
    domains = links.allowed_domains(config.allowed_domains, config.seeds)
    filters = dict(domains=domains, subdomains=config.subdomains, prefixes=config.prefixes, include=config.include, exclude=config.exclude, max_depth=config.max_depth)
    candidates = spark.createDataFrame([(s,) for s in config.seeds], "url string").select("url", F.lit(0).alias("depth"), F.lit(frontier.SEED_PRIORITY).alias("priority"), F.lit(None).cast("string").alias("referrer_url"))
    seen = spark.createDataFrame([], "url_key string")
    documents = log = all_links = gone = None
    known = 0
    while True:
        gated = candidates.withColumn("url_key", urls.normalize(F.col("url"))).withColumn("why", links.gate(F.col("url"), F.col("depth"), **filters)).where("why = 'allowed'").drop("why")
        wave = cut(frontier.admit(gated, seen, config.max_pages - known))
        if not (n := wave.count()):
            break
        known += n
        seen = seen.unionByName(wave.select("url_key"))
        of_wave = rules(wave) if callable(rules) else rules
        allowed = R.check(wave, of_wave, mode=config.robots, allow=list(config.robots_allow)) if of_wave is not None else wave.withColumn("robots_allowed", F.lit(True))
        got = complete(fetch(allowed.where("robots_allowed").select("url")))
        results = cut(extracted(wave.join(got, "url")))
        entry = results.select("url", urls.host(F.col("url")).alias("domain"), (F.col("status") == "success").alias("success"), F.col("status_code").cast("string").alias("status"), "latency_ms", F.length("html").cast("long").alias("bytes"), F.lit("created").alias("change"), "depth")
        log = entry if log is None else log.unionByName(entry)
        lost = results.where(F.col("status_code").isin(404, 410)).select("url", hashing.doc_id(F.col("url_key")).alias("page_id"), "status_code")
        gone = lost if gone is None else gone.unionByName(lost)
        q = config.quality
        good = results.where("status = 'success'")
        passed = gate.gated(good, "url_key", "url", "markdown", q.min_length, q.min_words, q.languages, duplicates=False).where("reason = 'passed'")
        documents = passed if documents is None else documents.unionByName(passed)
        out = links.extract(passed, ("url_key", "depth"), domains).where("is_internal")
        all_links = out if all_links is None else all_links.unionByName(out)
        if known >= config.max_pages:
            break
        nxt = out.select(F.col("href").alias("url"), (F.col("depth") + 1).alias("depth"), F.col("url_key").alias("referrer_url"))
        candidates = nxt.withColumn("priority", frontier.priority(F.col("url"), F.col("depth")))
    if documents is None:
        raise ValueError("no seed was admitted")
    if config.quality.duplicates:
        first = W.Window.partitionBy("content_hash").orderBy("depth", "url_key")
        documents = documents.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    for column in ("markdown", "html", "plain_text"):
        documents = documents.withColumn(column, hooks.redacted(F.col(column)))
    documents = documents.withColumn("doc_id", hashing.doc_id(F.col("url_key"))).drop("reason", "duplicate_of", "priority", "status")
    hooks.call("on_page", documents)
    hooks.call("on_error", log.where("NOT success"))
    return Crawled(documents, log, all_links, seen, gone, time.monotonic() - began)


def versioned(documents: DataFrame, pages: DataFrame, site_id: str, run: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for pages and versions: a version only where content is new or changed, a page for every document."""
    known = pages.where(F.col("site_id") == site_id).select("page_id", F.col("content_hash").alias("old_hash"), "first_seen", F.col("version_count").alias("old_count"), F.col("current_version_id").alias("old_version"))
    rows = complete(documents).withColumnRenamed("doc_id", "page_id").join(known, "page_id", "left")
    changed = changes.has_changed(F.col("old_hash"), F.col("content_hash"))
    rows = rows.withColumn("changed", changed).withColumn("version_id", F.when(changed, hashing.version_id(F.col("content_hash"), now)).otherwise(F.col("old_version")))
    versions = rows.where("changed").select(
        "version_id", "page_id", F.lit(site_id).alias("site_id"), F.lit(run).alias("run_id"), "url", "markdown", "html", "plain_text", "content_hash", "title", "description", "status_code", "language", "headings",
        "outlinks", "word_count", "char_count", now.alias("crawled_at"), now.alias("created_at"), F.lit(False).alias("is_tombstone"), F.lit(None).cast("string").alias("extra"),
    )
    new_pages = rows.select(
        "page_id", F.lit(site_id).alias("site_id"), "url", "canonical_url", F.col("version_id").alias("current_version_id"), "content_hash", "etag", "last_modified",
        F.coalesce("first_seen", now).alias("first_seen"), now.alias("last_seen"), now.alias("last_crawled"), "depth", "referrer_url", "status_code", F.lit(False).alias("is_tombstone"), F.lit(0).alias("error_count"),
        (F.coalesce("old_count", F.lit(0)) + F.col("changed").cast("int")).alias("version_count"),
    )
    return new_pages, versions


def tombstones(gone: DataFrame, pages: DataFrame, site_id: str, run: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for pages and versions of the known live pages among ``gone`` (page_id, status_code): both say that the page is no more."""
    lost = gone.groupBy("page_id").agg(F.max("status_code").alias("gone_code"))
    dead = pages.where((F.col("site_id") == site_id) & ~F.col("is_tombstone")).join(lost, "page_id").withColumn("version_id", hashing.version_id(F.lit("tombstone"), now))
    fresh = {"is_tombstone": F.lit(True), "status_code": F.col("gone_code"), "last_crawled": now, "current_version_id": F.col("version_id"), "error_count": F.coalesce("error_count", F.lit(0)) + 1}
    none = {"html": "string", "plain_text": "string", "title": "string", "description": "string", "language": "string", "extra": "string", "headings": "array<struct<level:int,text:string,anchor:string>>"}
    versions = dead.select(
        "version_id", "page_id", "site_id", F.lit(run).alias("run_id"), "url", F.lit("").alias("markdown"), F.lit("tombstone").alias("content_hash"), F.col("gone_code").alias("status_code"), F.array().cast("array<string>").alias("outlinks"),
        F.lit(0).cast("long").alias("word_count"), F.lit(0).cast("long").alias("char_count"), now.alias("crawled_at"), now.alias("created_at"), F.lit(True).alias("is_tombstone"), *[F.lit(None).cast(kind).alias(c) for c, kind in none.items()],
    )
    return dead.withColumns(fresh).select(*pages.columns), versions


def noise_free(pages: DataFrame, versions: DataFrame, noise: Iterable[str] = changes.NOISE) -> DataFrame:
    """Stored pages with the noise-free hash of their current version's text as ``content_hash``, as ``sync`` compares it."""
    current = versions.select("page_id", F.col("version_id").alias("current_version_id"), changes.noise_hash(F.col("markdown"), noise).alias("bare"))
    return pages.join(current, ["page_id", "current_version_id"], "left").withColumn("content_hash", F.col("bare")).drop("bare")


def sync(pages: DataFrame, fetch: Callable[[DataFrame], DataFrame], config: Sync, now: Column, sitemap: DataFrame | None = None) -> DataFrame:
    """Each page to check with its outcome: unchanged, changed, deleted, pending_deletion or failed.

    Filters come before the limit; the sitemap strategy leaves out what its newest entry shows unchanged; with the headers
    strategy requests carry the pages' validators, so that an answer of 304 needs no body; answers and noise-free hashes
    are compared in one plan. ``pages`` has url, content_hash (noise-free), last_crawled, error_count and is_tombstone,
    and etag and last_modified if it has any."""
    from quern.functions import patterns

    due = pages.where(~F.col("is_tombstone") & patterns.included(F.col("url"), config.include, config.exclude))
    if config.max_age_hours is not None:
        due = due.where(changes.needs_recrawl(F.col("is_tombstone"), F.col("last_crawled"), now, config.max_age_hours))
    if "sitemap" in config.expanded() and sitemap is not None:
        due = changes.sitemap_skip(due, sitemap)
    if config.max_pages is not None:
        due = due.orderBy(F.asc_nulls_first("last_crawled"), "url").limit(config.max_pages)
    validators = [c for c in ("etag", "last_modified") if "headers" in config.expanded() and c in due.columns]
    got = complete(fetch(due.select("url", *validators))).select("url", "status_code", F.col("html").alias("new_html"), F.col("etag").alias("new_etag"), F.col("last_modified").alias("new_modified"), "latency_ms")
    due = due.drop("status_code", "latency_ms")
    noise = config.noise if config.noise is not None else changes.NOISE
    rows = due.join(got, "url", "left").withColumn("new_text", html.text(F.col("new_html"))).withColumn("new_hash", changes.noise_hash(F.col("new_text"), noise))
    same = ~changes.has_changed(F.col("content_hash"), F.col("new_hash"))
    answer = changes.response(F.coalesce("status_code", F.lit(0)))
    gone = changes.deletion(F.col("status_code"), F.coalesce("error_count", F.lit(0)), config.deletion_threshold)
    outcome = F.coalesce(gone, F.when((answer == "changed") & same, "unchanged").otherwise(answer))
    errors = F.when(outcome.isin("unchanged", "changed"), 0).otherwise(F.coalesce("error_count", F.lit(0)) + 1)
    return rows.withColumn("outcome", outcome).withColumn("error_count", errors)


def merged(outcomes: DataFrame, pages: DataFrame, site_id: str, run: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for pages and versions from what ``sync`` found, which has page_id; ``pages`` are the stored ones.

    Changed pages get a version and the new validators; unchanged and pending ones were crawled now; deleted ones
    become tombstones; failed ones only count an error."""
    found = outcomes.select("page_id", "outcome", F.col("error_count").alias("errors"), F.col("status_code").alias("code"), "new_etag", "new_modified")
    stored = pages.where(F.col("site_id") == site_id)
    new = outcomes.where("outcome = 'changed'").select("page_id", "url", F.col("new_html").alias("html"), "status_code", F.col("new_etag").alias("etag"), F.col("new_modified").alias("last_modified"))
    new = extracted(new).drop("canonical_url").join(stored.select("page_id", "canonical_url", "depth", "referrer_url"), "page_id").withColumnRenamed("page_id", "doc_id")
    changed_pages, versions = versioned(new, pages, site_id, run, now)
    dead_pages, dead_versions = tombstones(outcomes.where("outcome = 'deleted'").select("page_id", "status_code"), pages, site_id, run, now)
    rest = stored.join(found.where("outcome IN ('unchanged', 'pending_deletion', 'failed')"), "page_id")
    seen = F.col("outcome") != "failed"
    rest = rest.withColumns({
        "last_crawled": F.when(seen, now).otherwise(F.col("last_crawled")), "last_seen": F.when(F.col("outcome") == "unchanged", now).otherwise(F.col("last_seen")), "error_count": F.col("errors"),
        "etag": F.coalesce("new_etag", "etag"), "last_modified": F.coalesce("new_modified", "last_modified"), "status_code": F.coalesce(F.when(F.col("outcome") != "unchanged", F.col("code")), F.col("status_code")),
    })
    return changed_pages.unionByName(dead_pages).unionByName(rest.select(*pages.columns)), versions.unionByName(dead_versions)


def finished(log: DataFrame, seconds: float | None = None) -> dict:
    """A run's record: counts, histograms, domains and whether it is complete or partial; with ``seconds`` how long it took and pages a second."""
    row = metrics.run(log).first().asDict()
    if seconds is not None:
        row |= {"seconds": seconds, "pages_per_second": row["pages_crawled"] / seconds if seconds > 0 else 0.0}
    row["status_codes"] = {r["status"]: r["n"] for r in metrics.histogram(log, "status").collect()}  # a row a status
    return row
