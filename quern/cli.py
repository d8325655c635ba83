"""The command line: crawl and sync sites, list sites and runs, show and set the user's configuration."""

from __future__ import annotations

import argparse
import logging
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.functions import hashing
from quern.operators import history, job, publish
from quern.sources import fetch as sources
from quern.sources.config import Crawl, Quality, Sync, UserConfig
from quern.sources.crawl import written
from quern.sources.store import Store, open_store

log = logging.getLogger("quern")


def setup_logging(level: str = "INFO", file: str | None = None, as_json: bool = False) -> None:
    """Console lines, or JSON objects, and a file if wished."""
    form = '{"ts": "%(asctime)s", "level": "%(levelname)s", "logger": "%(name)s", "message": "%(message)s"}' if as_json else "%(asctime)s %(levelname)s %(name)s %(message)s"
    handlers: list[logging.Handler] = [logging.StreamHandler(), *([logging.FileHandler(file)] if file else [])]
    logging.basicConfig(level=level, format=form, handlers=handlers, force=True)


def session() -> SparkSession:
    return SparkSession.builder.appName("quern").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def table(rows: list[dict]) -> str:
    if not rows:
        return "(none)"
    names = list(rows[0])
    cells = [names] + [["" if r[n] is None else str(r[n]) for n in names] for r in rows]
    widths = [max(len(c[i]) for c in cells) for i in range(len(names))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(c, widths)).rstrip() for c in cells)


def crawl(spark: SparkSession, store: Store, args) -> dict:
    config = Crawl(seeds=tuple(args.seeds), max_pages=args.max_pages, max_depth=args.max_depth, include=tuple(args.include), exclude=tuple(args.exclude), robots="off", quality=Quality(args.min_length, args.min_words))
    web = spark.read.parquet(args.pages) if args.pages else None
    get = (lambda r: sources.captured(r, web)) if web is not None else (lambda r: sources.fetch(r, sources.http()))
    done = job.crawl(spark, config, get)
    site, run, now = hashing.site_id(config.seeds), hashing.run_id(), datetime.now(timezone.utc)
    record = job.finished(done.log, done.seconds)
    at, stored = F.lit(now).cast("timestamp"), store.read("pages")
    pages, versions = job.versioned(done.documents, stored, site, run, at)
    lost_pages, lost_versions = job.tombstones(done.gone, stored, site, run, at)
    store.save("versions", versions.unionByName(lost_versions))
    store.save("pages", pages.unionByName(lost_pages))
    old = store.get("sites", site_id=site)
    store.save("sites", [{"site_id": site, "name": config.seeds[0], "seeds": list(config.seeds), "created_at": old["created_at"] if old else now, "updated_at": now, "last_crawl_at": now, "total_pages": store.count_pages(site), "total_runs": (old["total_runs"] if old else 0) + 1, "is_active": True}])
    store.save("runs", [{"run_id": run, "site_id": site, "status": record["status"], "created_at": now, "started_at": now, "completed_at": datetime.now(timezone.utc), "seeds": list(config.seeds)}])
    if args.output:
        publish.write_json_lines(done.documents.select("doc_id", "url", "title", "markdown", "depth"), args.output)
    return record | {"site_id": site, "run_id": run}


def sync(spark: SparkSession, store: Store, args) -> dict:
    """Checks the site's pages again and writes what has changed."""
    site = store.get("sites", site_id=args.site)
    if site is None:
        raise SystemExit(f"no site {args.site}")
    config = Sync(site_id=args.site, strategies=tuple(args.strategies), max_age_hours=args.max_age_hours, max_pages=args.max_pages, include=tuple(args.include), exclude=tuple(args.exclude), deletion_threshold=args.deletion_threshold)
    web = spark.read.parquet(args.pages) if args.pages else None
    get = (lambda r: sources.captured(r, web)) if web is not None else (lambda r: sources.fetch(r, sources.http()))
    run, now = hashing.run_id(), datetime.now(timezone.utc)
    at, stored = F.lit(now).cast("timestamp"), store.find("pages", site_id=args.site)
    found = written(job.sync(job.noise_free(stored, store.find("versions", site_id=args.site)), get, config, at))  # fetched once
    pages, versions = job.merged(found, stored, args.site, run, at)
    pages = written(pages)
    store.save("versions", versions)
    store.save("pages", pages)
    counts = {r.outcome: r["count"] for r in found.groupBy("outcome").count().collect()}
    status = "partial" if counts.get("failed") else "completed"
    store.save("sites", [site | {"updated_at": now, "total_pages": store.count_pages(args.site), "total_runs": (site["total_runs"] or 0) + 1}])
    store.save("runs", [{"run_id": run, "site_id": args.site, "status": status, "created_at": now, "started_at": now, "completed_at": datetime.now(timezone.utc), "seeds": site["seeds"]}])
    return {"run_id": run, "status": status} | {k: counts.get(k, 0) for k in ("unchanged", "changed", "deleted", "pending_deletion", "failed")}


def listing(store: Store, limit: int, status: str | None):
    """Newest runs of each site up to the limit, then the status filter, then the newest of all."""
    rows = history.latest(store.read("runs"), ["site_id"], ["-created_at", "run_id"], limit)
    rows = rows.where(F.col("status") == status) if status else rows
    return rows.orderBy(F.desc_nulls_last("started_at"), "run_id").limit(limit)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("quern")
    p.add_argument("--store")
    p.add_argument("--config", default=str(Path.home() / ".quern.json"))
    sub = p.add_subparsers(dest="verb", required=True)
    c = sub.add_parser("crawl")
    c.add_argument("seeds", nargs="+")
    c.add_argument("--pages", help="captured pages (url, html) to crawl instead of the network")
    c.add_argument("--output")
    c.add_argument("--max-pages", type=int, default=100)
    c.add_argument("--max-depth", type=int, default=5)
    c.add_argument("--min-length", type=int, default=100)
    c.add_argument("--min-words", type=int, default=10)
    c.add_argument("--include", nargs="*", default=[])
    c.add_argument("--exclude", nargs="*", default=[])
    y = sub.add_parser("sync")
    y.add_argument("site")
    y.add_argument("--pages", help="captured pages (url, html) to check against instead of the network")
    y.add_argument("--strategies", nargs="+", default=["headers", "hash"])
    y.add_argument("--max-age-hours", type=float)
    y.add_argument("--max-pages", type=int)
    y.add_argument("--deletion-threshold", type=int, default=2)
    y.add_argument("--include", nargs="*", default=[])
    y.add_argument("--exclude", nargs="*", default=[])
    sub.add_parser("sites")
    for name in ("runs", "list"):
        r = sub.add_parser(name)
        r.add_argument("--site")
        r.add_argument("--status")
        r.add_argument("--limit", type=int, default=20)
    g = sub.add_parser("config")
    g.add_argument("action", choices=["show", "set", "reset", "path"])
    g.add_argument("pair", nargs="*")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    user = UserConfig(args.config)
    if args.verb == "config":
        if args.action == "set":
            user.set(*args.pair)
        elif args.action == "reset":
            user.reset()
        print(user.path if args.action == "path" else table([{"key": k, "value": v} for k, v in user.load().items()]))
        return 0
    spark = spark or session()
    store = open_store(spark, {"root": args.store or user.load()["store"]})
    if args.verb == "crawl":
        print(table([crawl(spark, store, args)]))
    elif args.verb == "sync":
        print(table([sync(spark, store, args)]))
    elif args.verb == "sites":
        print(table([r.asDict() for r in store.sites().select("site_id", "name", "total_pages", "total_runs", "created_at").collect()]))
    else:
        rows = store.runs(args.site, args.limit) if args.site else listing(store, args.limit, args.status)
        print(table([r.asDict() for r in rows.select("run_id", "site_id", "status", "started_at", "completed_at").collect()]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
